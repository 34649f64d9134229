"""Parsing and normalising of loosely formatted fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pattern of a work's id.
WORK_ID = r"(WS/MP\d+/\d{4}-\d{4}/\d+)"
#: All white space of Unicode, as ranges of a character class.
SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACE_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Shapes of a date whose parts stand between hyphens, in the order they are tried.
DAY_FIRST = ("d-MMM-yyyy", "d-M-yyyy", "yyyy-M-d", "d-MMM-yy", "d-M-yy", "M-d-yyyy", "M-d-yy", "yyyy-MMM-d", "MMM-d-yyyy", "MMM-d-yy", "MMM-yyyy", "yyyyMMdd")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(_SPACE_CHARACTERS))


def _single(c: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(c, f"[{SPACES}]+", " ")


def _some(c: Column) -> Column:
    """Null where a text is empty."""
    return F.nullif(c, F.lit(""))


def parse_amount(c: Column) -> Column:
    """Rupees with signs, commas or currency marks; a parenthesised amount is negative."""
    text = strip(c)
    digits = F.regexp_replace(text, r"[^0-9.\-]", "")
    number = F.when(digits.isin("", "-", "."), None).otherwise(digits).try_cast("double")
    return F.when(text.rlike(r"^\(.*\)$"), -number).otherwise(number)


def _dated(c: Column, shape: str) -> Column:
    """Years of two digits from 69 on are of the last century."""
    day = F.try_to_date(c, shape)
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day) if shape.endswith("-yy") else day


def parse_date(c: Column) -> Column:
    """Day-first dates in the export's format, then in other usual ones: parts
    between hyphens, slashes, points or blanks, months by name or number, years of
    two or four digits, after a weekday, before a time, with the month first only
    where the day can't be. A year leads year, month, day."""
    text = strip(c)
    plain = F.regexp_replace(text, r"(?i)^(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?[,.]?[ ]+", "")
    plain = F.regexp_replace(plain, f"[T{SPACES}]+\\d{{1,2}}:\\d{{2}}.*$", "")
    plain = F.regexp_replace(plain, r"(?i)(?<=\d)(st|nd|rd|th)\b", "")
    plain = F.regexp_replace(plain, "(?i)" + "|".join(f"(?<={m[:3]}){m[3:]}" for m in (*MONTHS, "Sept") if m[3:]), "")
    plain = F.regexp_replace(plain, r"(?<=\d)(?=[A-Za-z])|(?<=[A-Za-z])(?=\d)", "-")
    plain = F.regexp_replace(plain, f"[-/.,{SPACES}]+", "-")
    return F.coalesce(F.try_to_date(text, "d-MMM-yyyy"), *[_dated(plain, p) for p in DAY_FIRST])


def work_id(c: Column) -> Column:
    return _some(F.regexp_extract(c, WORK_ID, 1))


def without_work_id(c: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(c, WORK_ID, ""), "^[ \\-–—]+", "")
    return _some(strip(rest))


def title_case(c: Column) -> Column:
    """A capital at the start of every run of letters."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def district(c: Column) -> Column:
    """The place before the first parenthesis of an authority's name."""
    name = title_case(strip(F.regexp_extract(c, r"^([^(]+)\(", 1)))
    return F.when(name.isin("", "Nan"), None).otherwise(name)


def member_name(c: Column) -> Column:
    """A member's name without its terms in parentheses."""
    bare = F.regexp_replace(c, f"[{SPACES}]*\\((?:\\d{{4}}-\\d{{2,4}}|NaN-NaN)\\)", "")
    return _some(strip(_single(bare)))


def normalise(c: Column) -> Column:
    """Lower case, letters, digits and single blanks."""
    plain = F.regexp_replace(F.lower(c), f"[^\\p{{L}}\\p{{N}}_{SPACES}]", " ")
    return _some(strip(_single(plain)))


def is_mojibake(c: Column, share: float = 0.30) -> Column:
    """At least this share of question marks: the script was lost on export."""
    marks = F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit("")))
    return F.coalesce((F.length(c) > 0) & (marks >= share * F.length(c)), F.lit(False))


def fixed(c: Column, digits: int) -> Column:
    """A number with so many digits behind the point, the binary value rounded as C's
    printf does: 1.985 is a little above the middle, 1.005 a little below. Only what
    lies exactly between goes to the even digit."""
    step = float(10**digits)
    high = c.cast("float").cast("double")  # products of either half are exact
    middle = F.rint(c * 2 * step)
    beyond = (high * (2 * step) - middle) + (c - high) * (2 * step)
    between = (F.abs(middle) % 2 == 1) & (F.abs(beyond) < 1e-3)
    near = F.when(between & (beyond > 0), (middle + 1) / (2 * step)).when(between & (beyond < 0), (middle - 1) / (2 * step)).otherwise(F.bround(c, digits))
    return F.format_string(f"%.{digits}f", near)


def rupees(c: Column) -> Column:
    """An amount in words of the Indian system."""
    return (
        F.when(c.isNull(), F.lit("an unrecorded amount"))
        .when(c >= 1e7, F.concat(F.lit("Rs "), fixed(c / 1e7, 2), F.lit(" crore")))
        .when(c >= 1e5, F.concat(F.lit("Rs "), fixed(c / 1e5, 2), F.lit(" lakh")))
        .otherwise(F.concat(F.lit("Rs "), F.format_number(F.bround(c, 0), 0)))
    )


def indian_grouping(c: Column) -> Column:
    """12,34,567: the last three digits, then pairs."""
    whole = F.abs(F.bround(c, 0)).cast("decimal(30,0)").cast("string")
    head = F.regexp_replace(F.substring(whole, 1, 30), r"(\d{3})$", "")
    pairs = F.regexp_replace(head, r"(?<=\d)(?=(\d{2})+$)", ",")
    grouped = F.when(F.length(whole) <= 3, whole).otherwise(F.concat(pairs, F.lit(","), F.substr(whole, F.length(whole) - 2)))
    return F.when(c.isNull(), F.lit("—")).otherwise(F.concat(F.when(c < 0, "-").otherwise(""), grouped))


def compact_rupees(c: Column) -> Column:
    """₹1.2Cr, ₹3.4L, ₹5.6K."""
    part = lambda unit, mark: F.concat(F.lit("₹"), fixed(c / unit, 1), F.lit(mark))
    return (
        F.when(c.isNull(), F.lit("—"))
        .when(c >= 1e7, part(1e7, "Cr"))
        .when(c >= 1e5, part(1e5, "L"))
        .when(c >= 1e3, part(1e3, "K"))
        .otherwise(F.concat(F.lit("₹"), fixed(c, 0)))
    )


def percent(c: Column, digits: int = 1) -> Column:
    return F.when(c.isNull(), F.lit("—")).otherwise(F.concat(fixed(c, digits), F.lit("%")))


def ordinal(c: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    n = c.cast("long")
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.when(c.isNull(), F.lit("—")).otherwise(F.concat(n.cast("string"), end))


def shown_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd MMM yyyy"), F.lit("—"))


def shortened(c: Column, most: int = 90) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)
