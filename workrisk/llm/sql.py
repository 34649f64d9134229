"""DuckDB SQL that holds the queries of this subpackage against the tables."""

from __future__ import annotations

from workrisk.llm import importance, variants

#: CTEs: a table of one list, crc.t, that CRC32 runs through byte by byte.
CRC_TABLE = """
crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)
  )
)"""


def crc32(text: str) -> str:
    """The CRC32 of the UTF-8 bytes of a string expression, beside the table crc."""
    digits = "'0123456789ABCDEF'"
    byte = f"16 * (strpos({digits}, substr(hex(encode({text})), 2 * k + 1, 1)) - 1) + strpos({digits}, substr(hex(encode({text})), 2 * k + 2, 1)) - 1"
    each = f"list_transform(range(strlen({text})), lambda k: ({byte})::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {each}), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295)"


def lowered(text: str) -> str:
    """A to Z alone in lower case."""
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def importance_sql() -> str:
    """importance.resample for single words."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    n = importance.BUCKETS
    return f"""
WITH {CRC_TABLE.strip()},
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{word}') AS w FROM documents),
found AS (SELECT r, unnest(w) AS word FROM docs),
wanted AS (SELECT unnest(regexp_extract_all({lowered("coalesce(text, '')")}, '{word}')) AS word FROM benchmark),
known AS (SELECT word, {crc32("word")} % {n} AS bucket FROM (SELECT word FROM found UNION SELECT word FROM wanted), crc),
s AS (SELECT bucket, count(*) AS s FROM found JOIN known USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN known USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM found) + {n}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + {n}))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM found JOIN known USING (word) JOIN gains USING (bucket) GROUP BY r),
drawn AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    (('0x' || left(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM docs LEFT JOIN weights USING (r)
),
scored AS (SELECT r, doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln(u))))::BIGINT AS score FROM drawn),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS fit
  FROM scored WHERE n_features >= {importance.LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {importance.PERCENT} * fit // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)"""


def variants_sql() -> str:
    """variants.group_variants. Near words meet through the text around one place:
    a replacement leaves it equal, an insertion makes it the shorter word."""
    size = variants.LEAST_LENGTH
    return f"""
WITH RECURSIVE {CRC_TABLE.strip()},
found AS (
  SELECT doc_id, unnest(regexp_extract_all({lowered("text")}, '[{variants.LETTERS}]{{{size},}}')) AS run FROM documents
),
runs AS (SELECT doc_id, run, count(*) AS times, coalesce(doc_id::VARCHAR, '') || ':' || run AS named FROM found GROUP BY doc_id, run),
hashed AS (SELECT run, times, {crc32("named")} AS h FROM runs, crc),
words AS (
  SELECT CASE WHEN h % {variants.SLIP} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed
),
v AS (SELECT word, sum(times)::BIGINT AS n FROM words GROUP BY word HAVING sum(times) >= {variants.LEAST_COUNT} AND length(word) >= {size}),
holes AS (
  SELECT word, n, k, substr(word, 1, k) AS a, substr(word, k + 2) AS b FROM (SELECT word, n, unnest(range(length(word)))::INT AS k FROM v)
),
shorter AS (SELECT DISTINCT long.word AS x, long.n AS x_n, v.word AS y, v.n AS y_n FROM holes long JOIN v ON v.word = long.a || long.b),
near AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.k = y.k AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT x, y, y_n FROM shorter UNION ALL SELECT y, x, x_n FROM shorter
),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
own AS (
  SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {variants.RATIO} * n THEN near END AS form, CASE WHEN near_n >= {variants.RATIO} * n THEN near_n END AS form_n
  FROM v LEFT JOIN best USING (word)
),
path AS (
  SELECT word, word AS at FROM own
  UNION ALL SELECT path.word, own.form FROM path JOIN own ON own.word = path.at WHERE own.form IS NOT NULL
)
SELECT own.word, own.n, own.n_near, own.form, own.form_n, path.at AS root
FROM own JOIN path USING (word) JOIN own AS last ON last.word = path.at WHERE last.form IS NULL"""


def _components(nodes: str, links: str) -> str:
    """CTEs after WITH RECURSIVE: low (a, root), the smallest id that each node of
    ``nodes`` (a, id) reaches by ``links`` (a, b, both ways)."""
    return f"""
reach AS (SELECT a, a AS b FROM {nodes} UNION SELECT reach.a, {links}.b FROM reach JOIN {links} ON {links}.a = reach.b),
low AS (SELECT reach.a, min(id) AS root FROM reach JOIN {nodes} ON {nodes}.a = reach.b GROUP BY reach.a)"""


def near_duplicates_sql(shingle: int = 5, percent: int = 75) -> str:
    """hyperminhash.near_duplicates, by comparing the full sets of all documents that
    share a shingle."""
    return f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS a, doc_id AS id, regexp_extract_all({lowered("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT a, CASE WHEN len(w) < {shingle} THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + {shingle - 1}], ' ') END AS s
  FROM (SELECT a, w, unnest(range(1, greatest(2, len(w) - {shingle - 2}))) AS k FROM docs WHERE len(w) > 0)
),
sizes AS (SELECT a, count(*) AS n FROM sets GROUP BY a),
shared AS (SELECT x.a, y.a AS b, count(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.a <> y.a GROUP BY ALL),
links AS (SELECT shared.a, shared.b FROM shared JOIN sizes x ON x.a = shared.a JOIN sizes y ON y.a = shared.b WHERE 100 * shared.n >= {percent} * (x.n + y.n - shared.n)),
{_components("docs", "links").strip()}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, root AS component_id, id = root AS kept FROM docs JOIN low USING (a) LEFT JOIN sizes USING (a)"""


def neighbours_sql(threshold: float = 0.98) -> str:
    """pca_neighbours.link, by comparing all vectors of a label."""
    return f"""
WITH RECURSIVE vecs AS (SELECT row_number() OVER () AS a, vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (
  SELECT a, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM vecs
  WHERE id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS (SELECT x.a, y.a AS b FROM usable x JOIN usable y ON x.label = y.label AND len(x.u) = len(y.u) AND x.a <> y.a WHERE list_dot_product(x.u, y.u) >= {threshold}::DOUBLE),
{_components("vecs", "links").strip()},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, root::BIGINT AS component_id, id = root AS kept FROM vecs JOIN low USING (a) LEFT JOIN counts USING (a)"""
