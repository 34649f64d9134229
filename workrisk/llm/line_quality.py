"""Line-first cleaning: every line of a text is judged alone, failing lines go,
and a document goes that loses too much of its text.

Rules of a line, in this order; the first that holds removes it:

* ``navigation``: at least a fifth of its words are menu separators;
* ``symbols``: more than one symbol character in three words;
* ``shouting``: at least a third of its words end in two exclamation marks;
* ``monotone``: ten words or more, of which less than a third differ;
* ``repeated``: it equals an earlier line of the text, and has three words or more;
* ``boilerplate``: it is a licence, cookie, or rights notice, or the like;
* ``punctuation``: it doesn't end as a sentence does.

The last two spare lines of thirty words and more, which are text that mentions
such a thing, or breaks off.

A short document can't be judged by how often its passages repeat, one sentence
being most of it. Where Limits say so, it is judged by its lines instead: a line
with a sentence that ends inside it has its punctuation, a repeated line goes but
doesn't count as lost, and the document stays if a line does, half of whose words
differ or more, and if it doesn't lose too much.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from workrisk.llm.common import bounded_batches, field_ddl, id_text, only

# What the rules look for.
SEPARATORS = ("|", ">", "<", "»", "«", "•", "·", "/", "::")
SYMBOLS = "#*$%&|<>"
ENDINGS = ".!?:;,…\"'”’»)]}。！？"
SENTENCE_ENDINGS = ".!?。！？"
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "is licensed",
    "terms of (use|service)",
    "privacy policy",
    "cookie (policy|settings)",
    "(uses|accept) cookies",
    "enable javascript",
    "subscribe to our",
    "sign up for our",
    "click here to",
    "powered by",
    "skip to (main )?content",
    "lorem ipsum",
)
#: Lines of so many words are no notices or headings.
LONG_LINE = 30
RULES = ("navigation", "symbols", "shouting", "monotone", "repeated", "boilerplate", "punctuation")

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(f"[{re.escape(SYMBOLS)}]")
_NOTICE = re.compile("|".join(BOILERPLATE), re.IGNORECASE | re.ASCII)


@dataclass(frozen=True)
class Limits:
    """When a document goes: few words (or, by lines, none that stand up), repeated
    passages, or too much removed."""

    least_words: int = 50
    repeat_percent: int = 50
    lost_percent: int = 50
    short_by_lines: bool = False


def line_fault(words: list[str], line: str, seen: bool, short: bool = False) -> str | None:
    """The first rule that a line with words breaks; ``short`` is said of a short
    document's line."""
    n = len(words)
    if 5 * sum(map(words.count, SEPARATORS)) >= n:
        return "navigation"
    symbols = len(_SYMBOLS.findall(line))
    if 3 * symbols > n:
        return "symbols"
    if "!!" in line and 3 * sum(w.endswith("!!") for w in words) >= n:
        return "shouting"
    if n >= 10 and 3 * len(set(words)) < n:
        return "monotone"
    if seen and n >= 3:
        return "repeated"
    if n >= LONG_LINE:
        return None
    if _NOTICE.search(line):
        return "boilerplate"
    if words[-1][-1] in ENDINGS or short and any(w[-1] in SENTENCE_ENDINGS for w in words):
        return None
    return "punctuation"


@dataclass
class Report:
    """What is known of one text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    lost_words: int
    faults: Counter
    cleaned: str


def repeat_words(words: list[str]) -> int:
    """Words in windows of three that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    again = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k : k + len(windows)] |= again
    return int(inside.sum())


def is_short(text: str, least_words: int) -> bool:
    return sum(1 for _ in islice(_WORDS.finditer(text), least_words)) < least_words


def judge(text: str, limits: Limits = Limits()) -> Report:
    """Statistics, verdict and cleaned text of a whole text."""
    words, faults, kept_lines, seen, lost, dup = [], Counter(), [], set(), 0, 0
    short, stay, twice = limits.short_by_lines and is_short(text, limits.least_words), [], 0
    for line in text.split("\n"):
        own = _WORDS.findall(line)
        if not own:
            kept_lines.append(line)
            continue
        words += own
        again = line in seen
        dup += again
        seen.add(line)
        fault = line_fault(own, line, again, short)
        if fault:
            faults[fault] += 1
            lost += len(own)
            twice += len(own) if fault == "repeated" else 0
        else:
            kept_lines.append(line)
            if short:
                stay += own
    n, repeated = len(words), repeat_words(words)
    if short:
        failed = not stay or 2 * len(set(stay)) < len(stay)
        kept = not failed and 100 * (lost - twice) <= limits.lost_percent * n
    else:
        failed = n < limits.least_words or 100 * repeated > limits.repeat_percent * n
        kept = not failed and 100 * lost <= limits.lost_percent * n
    return Report(n, sum(map(len, words)), len(_SYMBOLS.findall(text)), dup, repeated, failed, kept, lost, faults, "\n".join(kept_lines))


def judge_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Statistics, verdict, faults by rule and cleaned text of every row.

    A null or empty text, or one of white space, has no words and fails. Rows
    that repeat are judged one by one; columns other than doc_id and text are
    not read; an empty table gives an empty result. One pass without a shuffle.
    """
    bounded_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            found = [judge(t, limits) for t in batch.column(1).to_pylist()]
            columns = [pa.array([getattr(r, n) for r in found], pa.int64()) for n in names]
            columns += [pa.array([getattr(r, n) for r in found], pa.bool_()) for n in ("base_failed", "kept")]
            columns += [pa.array([r.lost_words for r in found], pa.int64())]
            columns += [pa.array([r.faults[rule] for r in found], pa.int64()) for rule in RULES]
            columns += [pa.array([r.cleaned for r in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names, "base_failed", "kept", "lost_words", *(f"{r}_lines" for r in RULES), "cleaned"])

    ddl = ", ".join([field_ddl(docs, "doc_id"), *(f"{n} long" for n in names), "base_failed boolean, kept boolean, lost_words long", *(f"{r}_lines long" for r in RULES), "cleaned string"])
    return id_text(docs).mapInArrow(run, ddl)


def clean_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, texts cleaned (and
    n_chars, where there is one, counted anew)."""
    bounded_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            names = batch.schema.names
            found = [judge(t or "", limits) for t in batch.column("text").to_pylist()]
            new = {"text": pa.array([r.cleaned for r in found], batch.schema.field("text").type)}
            if "n_chars" in names:
                new["n_chars"] = pa.array([len(r.cleaned) for r in found]).cast(batch.schema.field("n_chars").type)
            whole = pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)
            yield whole.filter(pa.array([r.kept for r in found], pa.bool_()))

    return docs.mapInArrow(run, schema)
