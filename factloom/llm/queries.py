"""One query per operator, at production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .host_quality import keep_by_rules
from .html_templates import extract_text
from .line_dedup import dedup_lines
from .near_dup import near_duplicates
from .packing import pack_documents
from .pu_quality import keep_good
from .secret_scan import CHARS, find_secrets, labelled_samples
from .substring_dedup import repeated_passages
from .token_counts import UNKNOWN, VOCABULARY, read_pieces, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Lower-cased runs of letters and digits, bytes beyond ASCII counting as letters.
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS size FROM bs GROUP BY item_id)
SELECT ds.doc_id, bs.item_id, count(*)::INTEGER AS shared, any_value(n.size)::INTEGER AS item_shingles
FROM ds JOIN bs ON ds.s = bs.s JOIN n ON n.item_id = bs.item_id
GROUP BY ds.doc_id, bs.item_id HAVING count(*) * 10 >= any_value(n.size) * 6
"""


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id
      JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id
      HAVING count(*) >= 0.5 * (any_value(nx.size) + any_value(ny.size) - count(*))),
r AS (SELECT DISTINCT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT node AS doc_id, min(reach) AS group_id FROM r GROUP BY node
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_chars", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))


OP4_SQL = r"""
WITH l AS (SELECT doc_id, i, line, trim(line, E' \t\r') AS k FROM
           (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
c AS (SELECT k, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM l WHERE k <> '' GROUP BY k),
m AS (SELECT l.*, coalesce(c.docs >= 5 AND c.first <> l.doc_id, false) AS gone FROM l LEFT JOIN c USING (k)),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
             count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped FROM m GROUP BY doc_id)
SELECT t.doc_id, t.text, CASE WHEN t.n_dropped > 0 THEN length(t.text) ELSE d.n_chars END AS n_chars, t.n_lines, t.n_dropped
FROM t JOIN documents d USING (doc_id)
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = keep_good(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), with_score=True)
    return kept.select("doc_id", F.round("__score", 4).alias("score"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, i - 1 AS first, md5(array_to_string(w[i:i + 49], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
k AS (SELECT s FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
p AS (SELECT doc_id, first FROM s WHERE s IN (SELECT s FROM k)),
g AS (SELECT *, CASE WHEN first - lag(first) OVER (PARTITION BY doc_id ORDER BY first) <= 50 THEN 0 ELSE 1 END AS new FROM p),
t AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY first) AS span FROM g)
SELECT doc_id, min(first)::INTEGER AS first_word, (max(first) + 50 - min(first))::INTEGER AS n_words FROM t GROUP BY doc_id, span
"""

def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TOKEN = "[A-Za-z0-9_+/-]+"


def op2_sql() -> str:
    """Trains both models from the same samples, scores the tokens, and splits those that are no secrets as a whole."""
    samples = ", ".join(f"({_quoted(t)}, {y})" for t, y in labelled_samples())
    code = lambda text, i: f"CASE WHEN {i} < 1 THEN {len(CHARS)} ELSE strpos('{CHARS.decode()}', substr({text}, {i}, 1)) - 1 END"
    best = "arg_max(struct_pack(i := x.j, j := y.j), struct_pack(g := y.sum - x.sum, a := -y.j, b := -x.j)) AS p, max(y.sum - x.sum) AS g"
    return f"""
WITH RECURSIVE samples(text, y) AS (VALUES {samples}),
cut AS (SELECT y, regexp_extract(text, '^[A-Za-z0-9_+/-]*') AS text FROM samples),
tri AS (SELECT y, {code("text", "i - 2")} AS a, {code("text", "i - 1")} AS b, {code("text", "i")} AS c FROM (SELECT y, text, unnest(range(1, length(text) + 1)) AS i FROM cut)),
n3 AS (SELECT y, a, b, c, count(*) AS n FROM tri GROUP BY ALL), n2 AS (SELECT y, b, c, count(*) AS n FROM tri GROUP BY ALL), n1 AS (SELECT y, c, count(*) AS n FROM tri GROUP BY ALL),
s3 AS (SELECT y, a, b, count(*) AS n FROM tri GROUP BY ALL), s2 AS (SELECT y, b, count(*) AS n FROM tri GROUP BY ALL), s1 AS (SELECT y, count(*) AS n FROM tri GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(text, '{_TOKEN}') AS toks, regexp_extract_all(text, '[^A-Za-z0-9_+/-]+') AS seps, regexp_matches(text, '^[A-Za-z0-9_+/-]') AS early FROM documents),
u AS (SELECT rid, doc_id, unnest(range(1, len(toks) + 1)) AS k, toks, seps, early FROM d WHERE regexp_matches(text, '[A-Za-z0-9_+/-]{{16,}}')),
t AS (SELECT row_number() OVER () AS tid, doc_id, toks[k] AS tok, (coalesce(list_sum(list_transform(toks[1:k - 1], lambda w: length(w))), 0) + coalesce(list_sum(list_transform(seps[1:CASE WHEN early THEN k - 1 ELSE k END], lambda w: length(w))), 0))::INTEGER AS first FROM u WHERE length(toks[k]) >= 16),
ch AS (SELECT tid, i, {code("tok", "i - 2")} AS a, {code("tok", "i - 1")} AS b, {code("tok", "i")} AS c FROM (SELECT tid, tok, unnest(range(1, length(tok) + 1)) AS i FROM t)),
need AS (SELECT a, b, c, y FROM (SELECT DISTINCT a, b, c FROM ch), (SELECT unnest([0, 1]) AS y)),
p AS (SELECT need.*, (coalesce(n3.n, 0) + 4 * ((coalesce(n2.n, 0) + 4 * ((coalesce(n1.n, 0) + 0.05::DOUBLE) / (s1.n + {len(CHARS) + 1} * 0.05::DOUBLE))) / (coalesce(s2.n, 0) + 4))) / (coalesce(s3.n, 0) + 4) AS p
  FROM need JOIN s1 USING (y) LEFT JOIN n1 USING (y, c) LEFT JOIN n2 USING (y, b, c) LEFT JOIN s2 USING (y, b) LEFT JOIN n3 USING (y, a, b, c) LEFT JOIN s3 USING (y, a, b)),
r AS (SELECT a, b, c, round((ln(max(p) FILTER (y = 1)) - ln(max(p) FILTER (y = 0))) * 1048576)::BIGINT AS r FROM p GROUP BY a, b, c),
cum AS (SELECT tid, i AS j, (sum(r) OVER (PARTITION BY tid ORDER BY i))::BIGINT AS sum FROM ch JOIN r USING (a, b, c) UNION ALL SELECT tid, 0, 0 FROM t),
total AS (SELECT tid, max(j) AS n, arg_max(sum, j) AS sum FROM cum GROUP BY tid),
whole AS (SELECT tid, 0::BIGINT AS i, n AS j, sum AS g FROM total WHERE round(sum / 1048576, 4) > 12),
seg AS (SELECT tid, 0::BIGINT AS s, n AS e, p.i AS i, p.j AS j, g FROM (SELECT total.tid, n, {best} FROM total JOIN cum x ON x.tid = total.tid JOIN cum y ON y.tid = total.tid AND y.j - x.j >= 16 WHERE total.tid NOT IN (SELECT tid FROM whole) GROUP BY total.tid, n)
  UNION ALL
  SELECT tid, s, e, p.i, p.j, g FROM (SELECT half.tid, half.s, half.e, {best} FROM (SELECT tid, s, i AS e FROM seg WHERE round(g / 1048576, 4) > 12 UNION ALL SELECT tid, j, e FROM seg WHERE round(g / 1048576, 4) > 12) half
    JOIN cum x ON x.tid = half.tid AND x.j >= half.s JOIN cum y ON y.tid = half.tid AND y.j <= half.e AND y.j - x.j >= 16 GROUP BY ALL)),
found AS (SELECT * FROM whole UNION ALL SELECT tid, i, j, g FROM seg WHERE round(g / 1048576, 4) > 12)
SELECT doc_id, (first + i)::INTEGER AS start, (j - i)::INTEGER AS length, substr(tok, i::INTEGER + 1, 4) AS preview, round(g / 1048576, 4) AS score FROM found JOIN t USING (tid)
"""


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_by_rules(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lower(nullif(regexp_extract(coalesce(source, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')), source, '') AS host, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS size,
                  len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS words FROM documents),
c AS (SELECT *, strlen(regexp_replace(t, '[ -@\[-`{-~\t\n\r]+', '', 'g')) AS letters,
             size - strlen(regexp_replace(t, '[A-Z]+', '', 'g')) AS capitals,
             size - strlen(regexp_replace(t, '[#$%&*|!<>{}\\^~=_]+', '', 'g')) AS symbols,
             regexp_split_to_array(t, '[ \n]') AS w FROM d),
p AS (SELECT *, list_reduce(list_transform(range(2, len(w) + 1), lambda i: CASE WHEN w[i] = w[i - 1] AND w[i] <> '' THEN 1 ELSE 0 END), lambda a, x: CASE WHEN x = 0 THEN (a // 2) * 2 WHEN a % 2 = 1 THEN a - 1 ELSE a + 3 END, 0) // 2 AS repeats FROM c),
f AS (SELECT doc_id, host, CASE WHEN words < 1 THEN 1 ELSE 0 END + CASE WHEN words > 0 AND size > 20 * words THEN 2 ELSE 0 END
             + CASE WHEN words > 0 AND letters * 10 < size * 6 THEN 4 ELSE 0 END + CASE WHEN words > 0 AND capitals * 10 > size * 3 THEN 8 ELSE 0 END
             + CASE WHEN words > 0 AND symbols * 20 > size THEN 16 ELSE 0 END + CASE WHEN words > 0 AND repeats * 10 > words * 2 THEN 32 ELSE 0 END AS failed FROM p),
h AS (SELECT host, count(*) AS n, count(*) FILTER (failed > 0) AS k FROM f GROUP BY host),
m AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v, avg(1.0::DOUBLE / n) AS u FROM h),
s AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * u, 1e-6) - 1, 1.0), 10000.0) AS s FROM m),
r AS (SELECT host, n, k, m, (k + m * s) / (n + s) AS rate, n + s + 1 AS size FROM h, s)
SELECT doc_id, host, failed::INTEGER AS failed, n AS host_docs, k AS host_failures, round(rate, 6) AS host_rate
FROM f JOIN r USING (host) WHERE rate - 1.645 * sqrt(rate * (1 - rate) / size) <= least(0.5, 2 * m) AND failed = 0
"""

def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op7_sql() -> str:
    """Forward scores of every distinct word, character by character, over the pieces of the vocabulary file."""
    pieces = read_pieces(VOCABULARY)
    longest = max(len(p.decode()) for p in pieces)
    ranked = ", ".join(_quoted(p.decode()) for p in pieces)
    return f"""
WITH RECURSIVE ranked AS (SELECT unnest(l) AS piece, generate_subscripts(l, 1) - 1 AS rank FROM (SELECT [{ranked}] AS l)),
norm AS (SELECT ln(sum(1.0::DOUBLE / (rank + 10))) AS z FROM ranked), piece AS (SELECT piece, -ln(rank + 10) - z AS score FROM ranked, norm),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+') AS words FROM documents),
u AS (SELECT rid, unnest(words) AS w FROM d), word AS (SELECT DISTINCT w, '▁' || w AS x FROM u),
place AS (SELECT w, x, unnest(range(0, length(x))) AS i FROM word),
cand AS (SELECT w, i, i + 1 AS e, {UNKNOWN}::DOUBLE AS score, strlen(substr(x, i + 1, 1)) AS n FROM place
  UNION ALL SELECT w, i, i + length(piece), score, 1 FROM (SELECT w, i, substr(x, i + 1, l) AS part FROM place, (SELECT unnest(range(1, {longest + 1})) AS l) WHERE i + l <= length(x)) JOIN piece ON piece = part),
st AS (SELECT w, 0::BIGINT AS d, [struct_pack(s := 0::DOUBLE, t := 0::BIGINT)] AS best FROM word
  UNION ALL
  SELECT w, d, list_append(best, top) FROM (SELECT st.w, st.d + 1 AS d, any_value(st.best) AS best, max(struct_pack(s := st.best[cand.i + 1].s + cand.score, t := st.best[cand.i + 1].t - cand.n)) AS top FROM st JOIN cand ON cand.w = st.w AND cand.e = st.d + 1 GROUP BY st.w, st.d)),
counted AS (SELECT w, -best[-1].t AS n FROM st JOIN word USING (w) WHERE d = length(x)),
c AS (SELECT rid, count(*) AS n_words, sum(n) AS n_tokens FROM u JOIN counted USING (w) GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_tokens, 0)::BIGINT AS n_tokens FROM d LEFT JOIN c USING (rid)
"""


def op6_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


QUERIES = {"op1_decontaminate": op1_decontaminate, "op10_near_dup": op10_near_dup,
    "op4_line_dedup": op4_line_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_substring_dedup": op9_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_host_quality": op3_host_quality,
    "op7_token_counts": op7_token_counts,
    "op6_html_templates": op6_html_templates}


class _Made(Mapping):
    """SQL by query; what is a function is called when it is asked for, as it reads a file or makes samples."""

    def __init__(self, made: dict):
        self._made = made

    def __getitem__(self, name: str) -> str:
        sql = self._made[name]
        return sql() if callable(sql) else sql

    def __iter__(self):
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)


SQL = _Made({"op1_decontaminate": OP1_SQL, "op10_near_dup": OP10_SQL, "op2_secret_scan": op2_sql,
    "op4_line_dedup": OP4_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op3_host_quality": OP3_SQL} | ({"op7_token_counts": op7_sql} if Path(VOCABULARY).exists() else {}))
