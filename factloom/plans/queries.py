"""Queries over the test tables, one for each operator, and DuckDB SQL for the same results."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.model import StubModel
from ..functions.parsers import candidates_column, decisions_column, synthesis_column
from ..functions.vectors import cosine, l2_normalize
from ..operators import curate, reconcile, serve, settle
from ..operators import transcripts as tr
from ..operators.components import connected_components
from ..operators.similarity import similar_links, similar_pairs
from ..schema import conform, live, problems
from ..settings import Settings
from ..sources import sessions
from ..sources.fixtures import FACTS_SQL, facts_view
from ..sources.store import FactStore
from ..sources.workspace import shared_dir
from . import jobs
from .jobs import settle_job

#: Random test vectors never come near the default thresholds.
TEST = replace(Settings(), duplicate_above=0.35, supersede_from=0.10, supersede_below=0.30, cluster_from=0.38, chunk_max_tokens=300, chunk_overlap_tokens=40)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name; ``{facts}`` in its SQL is the fact view."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("{facts}", FACTS_SQL)
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def probe(spark: SparkSession, sf: str) -> list[float]:
    """The query vector: one row of the table."""
    return table(spark, sf, "embeddings").where("vec_id = 7").select("embedding").first().embedding


def turns(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "Assistant")
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("line_no"), role.alias("role"), "text").where("role is not null")


TURNS_SQL = "turns AS (SELECT conv_id AS session, turn AS line_no, CASE role WHEN 'user' THEN 'Human' ELSE 'Assistant' END AS role, text FROM conversations WHERE role IN ('user', 'assistant'))"
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"
_SCORE = f"list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[])"


# serving


@query(f"WITH {{facts}}, t AS (SELECT *, {_SCORE} AS s FROM facts WHERE lifecycle = 'accepted' ORDER BY s DESC, id LIMIT 20) SELECT id, content, round(s, 4) AS score FROM t WHERE superseded_by IS NULL")
def recall_topk(spark, sf):
    found = serve.recall(facts_view(spark, sf), probe(spark, sf), 20)
    return found.select("id", "content", F.round("score", 4).alias("score"))


@query(f"WITH {{facts}}, t AS (SELECT *, {_SCORE} AS s FROM facts WHERE lifecycle = 'accepted' AND scope = 'personal' ORDER BY s DESC, id LIMIT 5) SELECT id, scope, round(s, 4) AS score FROM t WHERE superseded_by IS NULL")
def recall_scoped(spark, sf):
    return serve.recall(facts_view(spark, sf), probe(spark, sf), 5, "Personal").select("id", "scope", F.round("score", 4).alias("score"))


@query(
    f"WITH {{facts}}, t AS (SELECT *, {_SCORE} AS s FROM facts WHERE lifecycle = 'accepted' ORDER BY s DESC, id LIMIT 5) "
    "SELECT coalesce(string_agg('- (' || scope || '/' || category || coalesce(' [' || entity || ']', '') || ') ' || content, chr(10) ORDER BY s DESC, id), 'Nothing relevant is known.') AS text FROM t WHERE superseded_by IS NULL"
)
def recall_lines(spark, sf):
    return serve.recall_text(serve.recall(facts_view(spark, sf), probe(spark, sf), 5))


@query(f"WITH {{facts}} SELECT id, superseded_by, round({_SCORE}, 4) AS score FROM facts WHERE lifecycle = 'accepted' ORDER BY {_SCORE} DESC, id LIMIT 10")
def search_vector(spark, sf):
    return serve.vector_search(facts_view(spark, sf), probe(spark, sf)).select("id", "superseded_by", F.round("score", 4).alias("score"))


@query("WITH {facts} SELECT id, entity, lifecycle FROM facts WHERE content ILIKE '%THE%' OR entity ILIKE '%THE%' ORDER BY id LIMIT 10")
def search_keyword(spark, sf):
    return serve.keyword_search(facts_view(spark, sf), "THE").select("id", "entity", "lifecycle")


@query(r"WITH {facts} SELECT id FROM facts WHERE content ILIKE '%\%\%%' ESCAPE '\' OR entity ILIKE '%\%\%%' ESCAPE '\' ORDER BY id LIMIT 10")
def search_escaped(spark, sf):
    return serve.keyword_search(facts_view(spark, sf), "%%").select("id")


@query("WITH {facts} SELECT id, category, conf_pct FROM facts WHERE scope = 'project' AND lifecycle = 'candidate' AND source_project = 'src3' AND superseded_by IS NULL")
def list_filtered(spark, sf):
    return serve.list_facts(facts_view(spark, sf), scope="project", lifecycle="candidate", source_project="src3", only_live=True).select("id", "category", "conf_pct")


@query("WITH {facts}, t AS (SELECT * FROM facts WHERE scope = 'project' ORDER BY id LIMIT 20) SELECT id FROM t WHERE superseded_by IS NULL")
def list_limit_then_live(spark, sf):
    return serve.list_then_live(facts_view(spark, sf), 20, scope="project").select("id")


@query("WITH {facts} SELECT id, content, scope, entity FROM facts WHERE id = '00000042'")
def get_by_id(spark, sf):
    return serve.get_by_id(facts_view(spark, sf), "00000042").select("id", "content", "scope", "entity")


@query("WITH {facts} SELECT id, content FROM facts WHERE starts_with(id, '0000012') ORDER BY id")
def prefix_candidates(spark, sf):
    return serve.with_prefix(facts_view(spark, sf), "0000012").select("id", "content").orderBy("id")


@query("WITH {facts} SELECT id, category FROM facts WHERE starts_with(id, '00000123')")
def find_by_prefix(spark, sf):
    return serve.find_by_prefix(facts_view(spark, sf), "00000123").select("id", "category")


@query("""WITH {facts} SELECT CASE grouping(scope, lifecycle, category) WHEN 7 THEN 'total' WHEN 3 THEN 'scope' WHEN 5 THEN 'lifecycle' ELSE 'category' END AS dimension,
coalesce(scope, lifecycle, category, 'all') AS value, count(*) AS n FROM facts GROUP BY GROUPING SETS ((), (scope), (lifecycle), (category))""")
def stats_grouping_sets(spark, sf):
    return serve.statistics(facts_view(spark, sf))


@query("WITH {facts} SELECT category, count(*) AS n FROM facts GROUP BY category ORDER BY n DESC, category")
def stats_by_category(spark, sf):
    return serve.by_category(facts_view(spark, sf))


@query("WITH {facts} SELECT id, content, scope, category, entity, source_project, source_session, lifecycle, superseded_by, conf_pct FROM facts")
def export_projection(spark, sf):
    return serve.export_rows(facts_view(spark, sf)).select("id", "content", "scope", "category", "entity", "source_project", "source_session", "lifecycle", "superseded_by", "conf_pct")


@query("WITH {facts} SELECT count(DISTINCT len(embedding)) AS n_dims, min(len(embedding))::INTEGER AS low, max(len(embedding))::INTEGER AS high FROM facts")
def embedding_dim_check(spark, sf):
    return serve.dimensions(facts_view(spark, sf))


# sessions


def _files(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("source").alias("project"), (F.col("doc_id") % 7 == 0).alias("aside"), F.col("doc_id").cast("string").alias("key"), (F.col("doc_id") * 60).alias("mtime"), F.octet_length("text").cast("bigint").alias("size"))


@query("SELECT source AS project, count(*) AS sessions, count(*) FILTER (doc_id % 7 = 0) AS asides FROM documents GROUP BY source ORDER BY sessions DESC, project")
def sessions_per_project(spark, sf):
    return sessions.per_project(_files(spark, sf))


@query("SELECT '-home-' || source AS project, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY source")
def exclusion_anti_join(spark, sf):
    files = _files(spark, sf).withColumn("project", X.encode_project(F.concat(F.lit("/home/"), "project")))
    gone = spark.createDataFrame([("/home/src1",), ("/home/src2",)], "path string")
    out = files.join(sessions.excluded_projects(files.select("project").distinct(), gone), "project", "left_anti")
    return out.groupBy("project").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT source) AS n FROM documents WHERE source IN ('src1', 'src2', 'nowhere')")
def excluded_count(spark, sf):
    gone = spark.createDataFrame([("src1",), ("src2",), ("nowhere",)], "path string")
    return sessions.excluded_projects(_files(spark, sf).select("project").distinct(), gone).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT doc_id::VARCHAR AS key, doc_id * 60 AS mtime, strlen(text) AS size FROM documents),
c AS (SELECT doc_id::VARCHAR AS key, doc_id * 60 - CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS cm, strlen(text) - CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END AS o FROM documents WHERE doc_id % 2 = 0)
SELECT key, coalesce(o, 0) AS "offset" FROM f LEFT JOIN c USING (key) WHERE c.cm IS NULL OR mtime > cm OR size > o""")
def cursor_needs_processing(spark, sf):
    files = _files(spark, sf)
    n = F.col("key").cast("bigint")
    cursor = files.where(n % 2 == 0).select("key", (F.col("mtime") - F.when(n % 5 == 0, 1).otherwise(0)).alias("mtime"), (F.col("size") - F.when(n % 3 == 0, 10).otherwise(0)).alias("offset"))
    return sessions.needs_processing(files, cursor).select("key", "offset")


# vectors


@query(f"WITH {{facts}} SELECT a.id AS a, b.id AS b, round({_COS}, 4) AS score FROM facts a JOIN facts b ON a.id < b.id AND a.n % 7 = 3 AND b.n % 7 = 3 AND a.n < 300 AND b.n < 300")
def cosine_pairs(spark, sf):
    f = facts_view(spark, sf).where("n % 7 = 3 and n < 300").select("id", "embedding")
    a, b = f.toDF("a", "v"), f.toDF("b", "w")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cosine("v", "w"), 4).alias("score"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 3) + 0.0) AS unit FROM embeddings WHERE vec_id < 50")
def l2_normalized(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id < 50")
    return e.select("vec_id", F.transform(l2_normalize(F.transform("embedding", lambda x: x * 3)), lambda x: F.round(x.cast("double"), 3) + F.lit(0.0)).alias("unit"))


# text


@query("SELECT doc_id, (strlen(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_estimate("text").alias("tokens"))


@query(f"WITH {TURNS_SQL} SELECT session, count(*) AS turns FROM turns GROUP BY session HAVING count(*) FILTER (role = 'Human') >= 4")
def min_turn_gate(spark, sf):
    return tr.min_turn_gate(turns(spark, sf), 4).groupBy("session").agg(F.count("*").alias("turns"))


_MERGED = """t AS (SELECT * FROM turns WHERE line_no % 3 <> 1),
m AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY session ORDER BY line_no) = role THEN 0 ELSE 1 END AS new FROM t),
k AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY line_no) - 1 AS turn FROM m),
merged AS (SELECT session, turn::BIGINT AS turn, role, string_agg(text, chr(10) ORDER BY line_no) AS text FROM k GROUP BY ALL)"""


@query(f"WITH {TURNS_SQL}, {_MERGED} SELECT * FROM merged")
def merge_turns(spark, sf):
    return tr.merge_turns(turns(spark, sf).where("line_no % 3 <> 1"))


@query(f"WITH {TURNS_SQL}, {_MERGED} SELECT session, string_agg(role || ': ' || text || chr(10) || chr(10), '' ORDER BY turn) AS text FROM merged GROUP BY session")
def format_conversation(spark, sf):
    return tr.format_conversation(tr.merge_turns(turns(spark, sf).where("line_no % 3 <> 1")))


@query(f"""WITH {TURNS_SQL}, l AS (SELECT *, max(CASE WHEN role = 'Human' THEN line_no END) OVER (PARTITION BY session) AS last FROM turns)
SELECT session, line_no, role, CASE WHEN role = 'Human' THEN trim(text, E' \\t\\n\\r') ELSE text END AS text FROM l WHERE line_no >= last AND trim(text, E' \\t\\n\\r') <> ''""")
def aside_turns(spark, sf):
    return tr.aside_turns(turns(spark, sf))


def _coded():
    """Texts with two fenced blocks, of n % 40 and 3 lines."""
    body = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 40 + 1).cast("int")), lambda k: F.concat(F.lit("line "), k.cast("string"))), "\n")
    return F.concat(F.lit("before\n```rust\n"), body, F.lit("\n```\nbetween\n```\na\nb\n```\nafter"))


@query("""WITH d AS (SELECT doc_id, (doc_id % 40 + 1)::INTEGER AS n, array_to_string(list_transform(range(1, doc_id % 40 + 2), lambda k: 'line ' || k), chr(10)) AS body FROM documents)
SELECT doc_id, E'before\\n' || CASE WHEN n > 20 THEN '[code block: rust, ' || n || E' lines]\\n' ELSE E'```rust\\n' || body || E'\\n```\\n' END || E'between\\n```\\na\\nb\\n```\\nafter\\n' AS text FROM d""")
def code_fence_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tr.shorten_code(_coded(), 20).alias("text"))


@query(r"""WITH d AS (SELECT doc_id, '<system-reminder>a' || chr(10) || 'b</system-reminder>' || substr(text, 1, 40) || '<bash-input>ls</bash-input><local-command-caveat>x</local-command-caveat></bash-stdout>' AS t FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<local-command-caveat>.*?</local-command-caveat>', '', 'g'), '(?s)<system-reminder>.*?</system-reminder>', '', 'g'), '</?(local-command-caveat|local-command-stdout|local-command-stderr|bash-input|bash-stdout|bash-stderr)>', '', 'g') AS text FROM d""")
def xml_strip(spark, sf):
    t = F.concat(F.lit("<system-reminder>a\nb</system-reminder>"), F.substring("text", 1, 40), F.lit("<bash-input>ls</bash-input><local-command-caveat>x</local-command-caveat></bash-stdout>"))
    return table(spark, sf, "documents").select("doc_id", X.strip_noise(t).alias("text"))


#: Chunks of talk(session, text) at TEST's sizes: items are paragraphs, or the lines of one that is too long; each step takes one.
_CHUNKS = """long AS (SELECT * FROM talk WHERE strlen(text) // 4 > 300),
par AS (SELECT session, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS pi FROM long),
item AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY pi, li) AS k, line, li, x, strlen(x) // 4 AS n FROM (
  SELECT session, pi, 1::BIGINT AS li, false AS line, p AS x FROM par WHERE strlen(p) // 4 <= 300 UNION ALL
  SELECT session, pi, generate_subscripts(string_split(p, chr(10)), 1), true, unnest(string_split(p, chr(10))) FROM par WHERE strlen(p) // 4 > 300)),
st AS (SELECT session, 0::BIGINT AS k, '' AS held, 0::BIGINT AS weight, []::VARCHAR[] AS recent, NULL::VARCHAR AS out, NULL::BIGINT AS out_n FROM long
  UNION ALL
  SELECT session, k, CASE WHEN NOT over THEN held WHEN line THEN '' ELSE array_to_string(list_transform(recent[1:take], lambda e: e || chr(10) || chr(10)), '') END || x || chr(10) || CASE WHEN line THEN '' ELSE chr(10) END,
    CASE WHEN NOT over THEN weight WHEN line THEN 0 ELSE coalesce(list_sum(list_transform(recent[1:take], lambda e: strlen(e) // 4)), 0) END::BIGINT + n,
    CASE WHEN line THEN []::VARCHAR[] ELSE list_append(recent, x)[-5:] END, CASE WHEN over THEN held END, CASE WHEN over THEN weight END
  FROM (SELECT s.*  REPLACE (i.k AS k), i.line, i.x, i.n, s.held <> '' AND (i.line AND i.li = 1 OR s.weight + i.n > 300) AS over,
        len(list_filter(range(1, len(s.recent) + 1), lambda j: list_sum(list_transform(s.recent[1:j], lambda e: strlen(e) // 4)) <= 40)) AS take
        FROM st s JOIN item i ON i.session = s.session AND i.k = s.k + 1)),
ended AS (SELECT session, k, out, out_n FROM st WHERE out IS NOT NULL UNION ALL SELECT session, k + 1, held, weight FROM st QUALIFY k = max(k) OVER (PARTITION BY session) AND held <> ''),
chunks AS (SELECT session::VARCHAR AS session, 'p' AS project, (row_number() OVER (PARTITION BY session ORDER BY k) - 1)::INTEGER AS chunk_index, out AS text, out_n AS approx_tokens FROM ended
  UNION ALL SELECT session::VARCHAR, 'p', 0, text, strlen(text) // 4 FROM talk WHERE strlen(text) // 4 <= 300)"""


@query(f"""WITH RECURSIVE {TURNS_SQL}, t AS (SELECT * FROM turns), m AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY session ORDER BY line_no) = role THEN 0 ELSE 1 END AS new FROM t),
g AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY line_no) - 1 AS turn FROM m), merged AS (SELECT session, turn, role, string_agg(text, chr(10) ORDER BY line_no) AS text FROM g GROUP BY ALL),
talk AS (SELECT session, string_agg(role || ': ' || text || chr(10) || chr(10), '' ORDER BY turn) AS text FROM merged GROUP BY session), {_CHUNKS} SELECT * FROM chunks""")
def chunk_conversations(spark, sf):
    talk = tr.format_conversation(tr.merge_turns(turns(spark, sf))).withColumn("project", F.lit("p"))
    return tr.chunk(talk.select(F.col("session").cast("string").alias("session"), "project", "text"), TEST)


def _json_lines(spark, sf):
    """Conversations as transcript lines: users' texts as strings, assistants' as blocks."""
    message = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.when(F.col("role") == "assistant", F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))).alias("content")).alias("message")))
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    c = table(spark, sf, "conversations")
    value = F.when(F.col("role") == "assistant", message).otherwise(plain)
    return c.select(F.lit("p").alias("project"), F.col("conv_id").cast("string").alias("session"), F.lit(False).alias("aside"), F.col("turn").alias("line_no"), value.alias("value"))


@query(f"WITH {TURNS_SQL} SELECT session::VARCHAR AS session, line_no, role, CASE WHEN role = 'Assistant' AND NOT ends_with(text, chr(10)) THEN text || chr(10) ELSE text END AS text FROM turns WHERE text <> ''")
def transcript_turns(spark, sf):
    return tr.record_turns(_json_lines(spark, sf), TEST).select("session", "line_no", "role", "text")


@query(f"""WITH RECURSIVE {TURNS_SQL}, t AS (SELECT session, line_no, role, CASE WHEN role = 'Assistant' AND NOT ends_with(text, chr(10)) THEN text || chr(10) ELSE text END AS text FROM turns
  WHERE text <> '' AND session IN (SELECT session FROM turns WHERE text <> '' GROUP BY session HAVING count(*) FILTER (role = 'Human') >= 4)),
m AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY session ORDER BY line_no) = role THEN 0 ELSE 1 END AS new FROM t),
g AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY line_no) - 1 AS turn FROM m), merged AS (SELECT session, turn, role, string_agg(text, chr(10) ORDER BY line_no) AS text FROM g GROUP BY ALL),
talk AS (SELECT session, string_agg(role || ': ' || text || chr(10) || chr(10), '' ORDER BY turn) AS text FROM merged GROUP BY session HAVING bool_or(trim(text, E' \\t\\n\\r') <> '')), {_CHUNKS} SELECT * FROM chunks""")
def preprocess_transcripts(spark, sf):
    return tr.preprocess(_json_lines(spark, sf), TEST)


@query("SELECT doc_id, substr('d' || doc_id || '-0123-4567', 1, 8) AS short, string_split('/x/p' || doc_id || '.jsonl', '/')[3][:-7] AS session FROM documents")
def short_names(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("doc_id").cast("string")
    return d.select("doc_id", X.short_id(F.concat(F.lit("d"), n, F.lit("-0123-4567"))).alias("short"), X.session_of(F.concat(F.lit("/x/p"), n, F.lit(".jsonl"))).alias("session"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '<think>x' || doc_id || '</think> ' || chr(10) || text END AS t FROM documents)
SELECT doc_id, CASE WHEN contains(t, '</think>') THEN trim(substr(t, strpos(t, '</think>') + 8), E' \\t\\n\\r') ELSE t END AS text FROM d""")
def strip_thinking(spark, sf):
    d = table(spark, sf, "documents")
    t = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("<think>x"), F.col("doc_id").cast("string"), F.lit("</think> \n"), "text"))
    return d.withColumn("t", t).select("doc_id", X.after_thinking("t").alias("text"))


# reconciling


def _candidates(spark, sf):
    """Facts as candidates with some wrong scopes and categories."""
    n = F.col("n")
    return facts_view(spark, sf).withColumns({
        "scope": F.when(n % 17 == 0, "team").when(n % 13 == 0, F.upper("scope")).otherwise(F.col("scope")),
        "category": F.when(n % 19 == 0, "rumour").otherwise(F.col("category")),
        "confidence": F.col("conf_pct") / 100,
        "scope_confidence": ((n * 3) % 100) / 100,
    })


_CANDIDATES = """c AS (SELECT * REPLACE (CASE WHEN n % 17 = 0 THEN 'team' WHEN n % 13 = 0 THEN upper(scope) ELSE scope END AS scope, CASE WHEN n % 19 = 0 THEN 'rumour' ELSE category END AS category), (n * 3) % 100 AS trust FROM facts),
g AS (SELECT * REPLACE (CASE WHEN lower(scope) = 'personal' AND trust < 75 THEN 'project' ELSE lower(scope) END AS scope),
CASE WHEN lower(scope) NOT IN ('personal', 'project') THEN 'invalid_scope' WHEN category = 'rumour' THEN 'invalid_category' WHEN conf_pct < 60 THEN 'low_confidence' END AS outcome,
lower(scope) = 'personal' AND trust < 75 AS demoted FROM c)"""


@query(f"WITH {{facts}}, {_CANDIDATES} SELECT id, scope, category, demoted, coalesce(outcome, CASE WHEN conf_pct >= 85 THEN 'accepted' ELSE 'candidate' END) AS outcome FROM g")
def validate_gate_demote(spark, sf):
    out = reconcile.gate(_candidates(spark, sf), TEST)
    return out.select("id", "scope", "category", "demoted", F.coalesce("outcome", "lifecycle").alias("outcome"))


def _split(spark, sf):
    f = facts_view(spark, sf).withColumn("entity", F.concat(F.lit("l"), F.col("label").cast("string")))
    return f.where("n % 3 = 2"), live(f.where("n % 3 <> 2"))


_SPLIT = """f AS (SELECT * REPLACE ('l' || label AS entity) FROM facts), inc AS (SELECT * FROM f WHERE n % 3 = 2), store AS (SELECT * FROM f WHERE n % 3 <> 2 AND superseded_by IS NULL)"""
_BEST = f"""p AS (SELECT a.id, b.id AS match_id, {_COS} AS s FROM inc a JOIN store b ON b.scope = 'personal' OR (a.scope = 'project' AND b.source_project = a.source_project)),
best AS (SELECT id, arg_min(match_id, (-round(s, 12), match_id)) AS match_id, max(s) AS s FROM p GROUP BY id)"""


@query(f"WITH {{facts}}, {_SPLIT}, {_BEST} SELECT id, match_id, round(s, 4) AS score FROM best")
def dedup_best_match(spark, sf):
    return reconcile.best_match(*_split(spark, sf)).select("id", "match_id", F.round("score", 4).alias("score"))


@query(f"WITH {{facts}}, {_SPLIT}, {_BEST} SELECT id FROM inc WHERE id NOT IN (SELECT id FROM best WHERE s > 0.35)")
def dedup_anti_join(spark, sf):
    new, old = _split(spark, sf)
    return new.join(reconcile.best_match(new, old).where(F.col("score") > 0.35), "id", "left_anti").select("id")


_BAND = f"""band AS (SELECT a.id, b.id AS old_id, {_COS} AS s, b.created_at FROM inc a JOIN store b ON a.entity = b.entity AND a.source_project = b.source_project WHERE {_COS} >= 0.10 AND {_COS} < 0.30)"""


@query(f"WITH {{facts}}, {_SPLIT}, {_BAND} SELECT id, old_id, round(s, 4) AS score FROM band")
def supersession_pairs(spark, sf):
    return reconcile.supersession_pairs(*_split(spark, sf), TEST).select("id", "old_id", F.round("score", 4).alias("score"))


@query(f"""WITH {{facts}}, {_SPLIT}, {_BEST}, {_BAND}, o AS (SELECT i.id, CASE WHEN conf_pct < 60 THEN 'low_confidence' WHEN s > 0.35 THEN 'duplicate' ELSE lifecycle END AS outcome, match_id FROM inc i LEFT JOIN best USING (id)),
b AS (SELECT id, arg_min(old_id, (-epoch_us(created_at), old_id)) AS old_id, count(*) AS k FROM band GROUP BY id)
SELECT o.id, outcome, CASE WHEN outcome = 'duplicate' THEN match_id WHEN outcome <> 'low_confidence' THEN old_id END AS ref_id, CASE WHEN outcome IN ('duplicate', 'low_confidence') THEN 0 ELSE coalesce(k, 0) END AS n_superseded FROM o LEFT JOIN b ON o.id = b.id""")
def reconcile_outcomes_snapshot(spark, sf):
    new, old = _split(spark, sf)
    new = new.withColumns({"confidence": F.col("conf_pct") / 100, "scope_confidence": F.lit(1.0)})
    return reconcile.reconcile_snapshot(new, old, TEST)


@query(f"""WITH RECURSIVE {{facts}}, {_SPLIT},
c AS (SELECT *, row_number() OVER (PARTITION BY source_project ORDER BY id) AS k FROM inc WHERE scope = 'project'),
every AS (SELECT id, scope, source_project, entity, embedding, created_at, true AS stored FROM store UNION ALL SELECT id, scope, source_project, entity, embedding, created_at, false FROM c),
o AS (SELECT a.id, list(struct_pack(id := b.id, s := round({_COS}, 12), same := coalesce(b.source_project = a.source_project AND b.entity = a.entity, false), at := epoch_us(b.created_at), stored := b.stored)) AS others
  FROM c a JOIN every b ON (b.scope = 'personal' OR b.source_project = a.source_project) AND (b.stored OR b.id < a.id) GROUP BY a.id),
st AS (SELECT DISTINCT source_project AS project, 0::BIGINT AS k, []::VARCHAR[] AS added, []::VARCHAR[] AS dead, NULL::VARCHAR AS id, NULL::VARCHAR AS outcome, NULL::VARCHAR AS ref_id, []::VARCHAR[] AS superseded FROM c
  UNION ALL
  SELECT project, k, CASE WHEN kept THEN list_append(added, id) ELSE added END, CASE WHEN kept THEN list_concat(dead, ids) ELSE dead END, id, outcome,
    CASE WHEN outcome = 'duplicate' THEN best.id WHEN kept THEN ids[1] END, CASE WHEN kept THEN ids ELSE []::VARCHAR[] END
  FROM (SELECT *, outcome IN ('accepted', 'candidate') AS kept, list_transform(list_sort(list_transform(list_filter(alive, lambda x: x.same AND x.s >= 0.10 AND x.s < 0.30), lambda x: struct_pack(t := -x.at, id := x.id))), lambda x: x.id) AS ids
    FROM (SELECT *, CASE WHEN conf_pct < 60 THEN 'low_confidence' WHEN best.d < -0.35 THEN 'duplicate' ELSE lifecycle END AS outcome
      FROM (SELECT *, list_sort(list_transform(alive, lambda x: struct_pack(d := -x.s, id := x.id)))[1] AS best
        FROM (SELECT st.project, c.k, st.added, st.dead, c.id, c.conf_pct, c.lifecycle, list_filter(coalesce(o.others, []), lambda x: NOT list_contains(st.dead, x.id) AND (x.stored OR list_contains(st.added, x.id))) AS alive
          FROM st JOIN c ON c.source_project = st.project AND c.k = st.k + 1 LEFT JOIN o ON o.id = c.id)))))
SELECT id, outcome, ref_id, superseded FROM st WHERE k > 0""")
def reconcile_ordered(spark, sf):
    new, old = _split(spark, sf)
    new = new.where("scope = 'project'").withColumns({"confidence": F.col("conf_pct") / 100, "scope_confidence": F.lit(1.0), "seq": F.col("id")})
    return reconcile.reconcile_ordered(new, old, TEST)


@query(f"WITH {{facts}}, {_SPLIT}, {_BAND}, e AS (SELECT old_id, min(id) AS new_id FROM band GROUP BY old_id) SELECT f.id, coalesce(e.new_id, f.superseded_by) AS superseded_by FROM facts f LEFT JOIN e ON e.old_id = f.id")
def apply_supersession(spark, sf):
    edges = reconcile.supersession_pairs(*_split(spark, sf), TEST).select(F.col("id").alias("new_id"), "old_id")
    return reconcile.link_back(facts_view(spark, sf), edges).select("id", "superseded_by")


def _one_changed(spark, sf, column, value):
    from ..sources.store import updated

    return updated(facts_view(spark, sf), "00000010", column, value, F.current_timestamp())


@query("WITH {facts} SELECT id, CASE WHEN id = '00000010' THEN 'accepted' ELSE lifecycle END AS lifecycle FROM facts")
def update_lifecycle(spark, sf):
    return _one_changed(spark, sf, "lifecycle", "accepted").select("id", "lifecycle")


@query("WITH {facts} SELECT id, CASE WHEN id = '00000010' THEN 'project' ELSE scope END AS scope FROM facts")
def update_scope(spark, sf):
    return _one_changed(spark, sf, "scope", "project").select("id", "scope")


@query("WITH {facts} SELECT id FROM facts WHERE id <> '00000010'")
def delete_row(spark, sf):
    store = _store(spark, sf)
    store.delete("00000010")
    return store.read().select("id")


@query("""WITH RECURSIVE {facts}, l AS (SELECT id, CASE WHEN n % 4 <> 3 AND id < (SELECT max(id) FROM facts) THEN lpad((n + 1)::VARCHAR, 8, '0') END AS next FROM facts),
r AS (SELECT id, id AS head, 0::BIGINT AS length FROM l UNION ALL SELECT r.id, l.next, r.length + 1 FROM r JOIN l ON l.id = r.head WHERE l.next IS NOT NULL)
SELECT id, max(head) AS head, max(length) AS length FROM r GROUP BY id""")
def supersession_chain(spark, sf):
    f = facts_view(spark, sf)
    last = f.agg(F.max("id").alias("last"))
    next_ = F.when((F.col("n") % 4 != 3) & (F.col("id") < F.col("last")), F.lpad((F.col("n") + 1).cast("string"), 8, "0"))
    return reconcile.supersession_chains(f.crossJoin(F.broadcast(last)).select("id", next_.alias("superseded_by")))


# consolidation

_EDGES = f"live AS (SELECT * FROM facts WHERE superseded_by IS NULL AND scope = 'project'), e AS (SELECT a.id AS a, b.id AS b, {_COS} AS s FROM live a JOIN live b ON a.id < b.id WHERE {_COS} >= 0.38)"
_CLUSTERS = f"""{_EDGES}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach),
k AS (SELECT node AS id, min(reach) AS cluster FROM r GROUP BY node), cl AS (SELECT id, cluster FROM k WHERE cluster IN (SELECT cluster FROM k GROUP BY cluster HAVING count(*) BETWEEN 2 AND 10))"""
_PROMOTED = """pr AS (SELECT cluster, list(cl.id ORDER BY cl.id) AS ids, count(DISTINCT source_project) AS n_projects FROM cl JOIN facts USING (id) GROUP BY cluster HAVING count(DISTINCT source_project) >= 3)"""


@query(f"WITH {{facts}}, {_EDGES} SELECT a, b, round(s, 4) AS score FROM e")
def similarity_edges(spark, sf):
    rows = live(facts_view(spark, sf)).where("scope = 'project'")
    return similar_pairs(rows, 0.38).select("a", "b", F.round("score", 4).alias("score"))


@query(f"WITH RECURSIVE {{facts}}, {_CLUSTERS} SELECT id::BIGINT AS node, cluster::BIGINT AS component FROM k")
def connected_components_edges(spark, sf):
    rows = live(facts_view(spark, sf)).where("scope = 'project'")
    return connected_components(similar_links(rows, 0.38, F.col("id").cast("long")))


@query(f"WITH RECURSIVE {{facts}}, {_CLUSTERS} SELECT id, cluster FROM cl")
def similarity_clusters(spark, sf):
    return settle.clusters(facts_view(spark, sf), TEST)


@query(f"WITH RECURSIVE {{facts}}, {_CLUSTERS}, {_PROMOTED} SELECT cluster, ids, n_projects FROM pr")
def promotion_candidates(spark, sf):
    return settle.promotions(facts_view(spark, sf), TEST).select("cluster", "ids", "n_projects")


@query(f"""WITH RECURSIVE {{facts}}, {_CLUSTERS}, v AS (SELECT cluster, category, count(*) AS n FROM cl JOIN facts USING (id) GROUP BY ALL)
SELECT cluster, arg_min(category, (-n, category)) AS category FROM v GROUP BY cluster""")
def majority_category(spark, sf):
    f = facts_view(spark, sf)
    return settle.vote(settle.clusters(f, TEST).join(f.select("id", "category"), "id"), "cluster", "category", "pattern")


@query(f"""WITH RECURSIVE {{facts}}, {_CLUSTERS}, {_PROMOTED}, lv AS (SELECT * FROM facts WHERE superseded_by IS NULL AND entity IS NOT NULL),
ok AS (SELECT entity FROM lv GROUP BY entity HAVING count(*) BETWEEN 3 AND 10 AND count(DISTINCT source_session) > 1 AND NOT bool_or(source_session = 'settling')),
lf AS (SELECT * FROM lv WHERE entity IN (SELECT entity FROM ok) AND id NOT IN (SELECT unnest(ids) FROM pr)),
vc AS (SELECT entity, category, count(*) AS n FROM lf GROUP BY ALL), vs AS (SELECT entity, scope, count(*) AS n FROM lf GROUP BY ALL)
SELECT entity, list(id ORDER BY id) AS ids, max(conf_pct) AS conf, (SELECT arg_min(category, (-n, category)) FROM vc WHERE vc.entity = lf.entity) AS category,
(SELECT arg_min(scope, (-n, scope)) FROM vs WHERE vs.entity = lf.entity) AS scope FROM lf GROUP BY entity HAVING count(*) >= 3""")
def entity_synthesis_candidates(spark, sf):
    f = facts_view(spark, sf)
    out = settle.entity_groups(f, settle.promotions(f, TEST), TEST)
    return out.select("entity", "ids", F.round(F.col("confidence").cast("double") * 100).cast("int").alias("conf"), "category", "scope")


def _batches(spark, sf):
    """Facts as curation batches of ten with made decisions."""
    f = facts_view(spark, sf)
    n = F.col("n")
    c = f.select((n / 10).cast("bigint").alias("batch"), (n % 10).cast("int").alias("index"), "id", "scope", (F.col("conf_pct") / 100).alias("confidence"), "n")
    action = F.when(n % 10 == 9, None).when(n % 5 == 1, "drop").when(n % 7 == 2, "keep_as_project").when(n % 4 == 3, "merge").otherwise("keep")
    target = F.when(action == "merge", ((n * 3) % 12).cast("int"))
    return c, c.select("batch", "index", action.alias("action"), target.alias("target")).where("action is not null")


_BATCHES = """c AS (SELECT (n // 10)::BIGINT AS batch, (n % 10)::INTEGER AS index, id, scope, conf_pct, n FROM facts),
dec AS (SELECT *, CASE WHEN action = 'merge' THEN ((n * 3) % 12)::INTEGER END AS target FROM (SELECT *, CASE WHEN n % 10 = 9 THEN NULL WHEN n % 5 = 1 THEN 'drop' WHEN n % 7 = 2 THEN 'keep_as_project' WHEN n % 4 = 3 THEN 'merge' ELSE 'keep' END AS action FROM c)),
lost AS (SELECT DISTINCT s.batch, CASE WHEN s.conf_pct >= t.conf_pct THEN t.index ELSE s.index END AS index FROM dec s JOIN c t ON t.batch = s.batch AND t.index = s.target)"""


@query(f"WITH {{facts}}, {_BATCHES} SELECT d.id, CASE WHEN d.action = 'keep_as_project' THEN 'project' ELSE d.scope END AS scope FROM dec d WHERE coalesce(d.action, 'keep') <> 'drop' AND NOT EXISTS (SELECT 1 FROM lost l WHERE l.batch = d.batch AND l.index = d.index)")
def curation_apply(spark, sf):
    return curate.apply_decisions(*_batches(spark, sf)).select("id", "scope")


@query(f"WITH {{facts}}, {_BATCHES} SELECT batch, index FROM lost")
def merge_resolution(spark, sf):
    return curate.merge_losers(*_batches(spark, sf))


# model output


def _answers(spark, sf):
    """Documents as extraction answers, whole, fenced, cut off or broken."""
    n, item = F.col("doc_id"), F.to_json(F.struct(F.substring("text", 1, 60).alias("content"), F.lit("project").alias("scope"), F.lit("fact").alias("category"), (F.col("doc_id") % 100 / 100).alias("confidence")))
    both = F.concat(item, F.lit(","), item)
    response = (
        F.when(n % 6 == 0, F.concat(F.lit("["), both, F.lit("]"))).when(n % 6 == 1, F.concat(F.lit("Here:\n```json\n["), item, F.lit("]\n```"))).when(n % 6 == 2, F.concat(F.lit("["), both, F.lit(',{"content": "cut')))
        .when(n % 6 == 3, F.concat(F.lit("["), item, F.lit("]\n["), item, F.lit("]"))).when(n % 6 == 4, item).otherwise("I found nothing.")
    )
    return table(spark, sf, "documents").select("doc_id", response.alias("response"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END::INTEGER AS items, doc_id % 6 = 5 AS failed FROM documents")
def parse_model_json(spark, sf):
    p = _answers(spark, sf).withColumn("p", candidates_column(spark, F.col("response")))
    return p.select("doc_id", F.size("p.items").alias("items"), F.col("p.error").isNotNull().alias("failed"))


@query("""SELECT doc_id, pos::INTEGER AS pos, substr(text, 1, 60) AS content, round(doc_id % 100 / 100, 2) AS confidence FROM documents, range(0, 2) r(pos)
WHERE doc_id % 6 <> 5 AND (doc_id % 6 IN (0, 2, 3) OR pos = 0)""")
def extract_explode(spark, sf):
    p = _answers(spark, sf).select("doc_id", candidates_column(spark, F.col("response")).alias("p"))
    return p.select("doc_id", F.posexplode("p.items").alias("pos", "c")).select("doc_id", "pos", "c.content", F.round("c.confidence", 2).alias("confidence"))


def _uuid_sql(text: str) -> str:
    h = f"sha256({text})"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


def _store(spark, sf) -> FactStore:
    """A store of all facts."""
    store = FactStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.insert(conform(facts_view(spark, sf)))
    return store


def _percent():
    return F.round(F.col("confidence").cast("double") * 100).cast("int").alias("conf_pct")


@query(f"""WITH RECURSIVE {{facts}}, {_CLUSTERS}, {_PROMOTED}, lv AS (SELECT * FROM facts WHERE superseded_by IS NULL AND entity IS NOT NULL),
ok AS (SELECT entity FROM lv GROUP BY entity HAVING count(*) BETWEEN 3 AND 10 AND count(DISTINCT source_session) > 1),
lf AS (SELECT * FROM lv WHERE entity IN (SELECT entity FROM ok) AND id NOT IN (SELECT unnest(ids) FROM pr)),
vc AS (SELECT entity, category, count(*) AS n FROM lf GROUP BY ALL), vs AS (SELECT entity, scope, count(*) AS n FROM lf GROUP BY ALL), vp AS (SELECT cluster, category, count(*) AS n FROM cl JOIN facts USING (id) GROUP BY ALL),
made AS (SELECT 'promotion' AS kind, ids, 'personal' AS scope, (SELECT arg_min(category, (-n, category)) FROM vp WHERE vp.cluster = pr.cluster) AS category, NULL::VARCHAR AS entity, 80 AS conf_pct FROM pr
  UNION ALL SELECT 'synthesis', list(id ORDER BY id), (SELECT arg_min(scope, (-n, scope)) FROM vs WHERE vs.entity = lf.entity), (SELECT arg_min(category, (-n, category)) FROM vc WHERE vc.entity = lf.entity), entity, max(conf_pct) FROM lf GROUP BY entity HAVING count(*) >= 3),
new AS (SELECT {_uuid_sql("kind || chr(31) || array_to_string(ids, ',')")} AS id, * EXCLUDE (kind) FROM made),
old AS (SELECT unnest(ids) AS old_id, id AS new_id FROM new)
SELECT id, scope, category, entity, 'candidate' AS lifecycle, ids[1] AS supersedes, NULL::VARCHAR AS superseded_by, conf_pct FROM new
UNION ALL SELECT id, scope, category, entity, lifecycle, NULL, coalesce(new_id, superseded_by), conf_pct FROM facts LEFT JOIN (SELECT old_id, min(new_id) AS new_id FROM old GROUP BY old_id) ON old_id = id""")
def settle_persist(spark, sf):
    """A consolidation with the deterministic model, written to a store and read back: the new rows and the old ones with their links."""
    store = _store(spark, sf)
    settle_job(store, lambda: StubModel(64), TEST, as_of=F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    return store.read().select("id", "scope", "category", "entity", "lifecycle", "supersedes", "superseded_by", _percent())


# the store


@query("WITH {facts} SELECT id, content, scope, category, entity, source_project, lifecycle, superseded_by, conf_pct, embedding_dim FROM facts UNION ALL SELECT 'zz', 'made up', 'project', 'fact', NULL, NULL, 'accepted', NULL, 90, 64")
def store_insert(spark, sf):
    store = _store(spark, sf)
    store.insert_placeholder("zz", "made up", dim=64, confidence=0.9)
    return store.read().select("id", "content", "scope", "category", "entity", "source_project", "lifecycle", "superseded_by", _percent(), "embedding_dim")


@query("WITH {facts} SELECT id, CASE WHEN id = '00000012' THEN 'accepted' ELSE lifecycle END AS lifecycle, CASE WHEN id = '00000013' THEN 'personal' ELSE scope END AS scope FROM facts")
def store_accept_promote(spark, sf):
    store = _store(spark, sf)
    store.accept("00000012")
    store.promote("00000013")
    return store.read().select("id", "lifecycle", "scope")


@query("WITH {facts} SELECT id, superseded_by FROM (SELECT id, CASE WHEN n % 10 = 1 THEN 'new-' || (n % 3) ELSE superseded_by END AS superseded_by FROM facts) UNION ALL SELECT 'new-' || k, NULL FROM range(0, 3) r(k)")
def store_settle(spark, sf):
    store = _store(spark, sf)
    facts = facts_view(spark, sf)
    rows = conform(facts.where("n < 3").withColumns({"id": F.concat(F.lit("new-"), F.col("n").cast("string")), "superseded_by": F.lit(None).cast("string")}))
    edges = facts.where("n % 10 = 1").select(F.concat(F.lit("new-"), (F.col("n") % 3).cast("string")).alias("new_id"), F.col("id").alias("old_id"))
    store.settle(rows, edges)
    return store.read().select("id", "superseded_by")


@query("WITH {facts} SELECT id, content, scope, entity, source_project, superseded_by, false AS has_vector FROM facts")
def export_json(spark, sf):
    rows = serve.export_json(conform(facts_view(spark, sf)))
    return rows.select("id", *[F.get_json_object("json", f"$.{c}").alias(c) for c in ("content", "scope", "entity", "source_project", "superseded_by")], F.contains("json", F.lit('"embedding"')).alias("has_vector"))


@query("""WITH {facts} SELECT id, CASE WHEN n % 7 = 0 THEN 'missing content' WHEN n % 7 = 1 THEN 'invalid scope: team' WHEN n % 7 = 2 THEN 'invalid category: rumour' WHEN n % 7 = 3 THEN 'invalid lifecycle: gone' ELSE 'embedding_dim differs from the embedding' END AS reason FROM facts WHERE n % 7 < 5""")
def unsound_rows(spark, sf):
    n = F.col("n") % 7
    bad = facts_view(spark, sf).withColumns({
        "content": F.when(n != 0, F.col("content")), "scope": F.when(n == 1, "team").otherwise(F.col("scope")), "category": F.when(n == 2, "rumour").otherwise(F.col("category")),
        "lifecycle": F.when(n == 3, "gone").otherwise(F.col("lifecycle")), "embedding_dim": F.when(n == 4, 3).otherwise(F.col("embedding_dim")),
    })
    return bad.withColumn("reason", problems()).where("reason is not null").select("id", "reason")


@query("WITH {facts} SELECT id, scope, category, content, CASE WHEN n % 2 = 0 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM facts WHERE n % 3 = 0")
def outcome_preview(spark, sf):
    f = facts_view(spark, sf)
    return jobs.outcome_preview(f, f.where("n % 3 = 0").select("id", F.when(F.col("n") % 2 == 0, "duplicate").otherwise("accepted").alias("outcome")))


@query(f"WITH {{facts}}, t AS (SELECT * FROM facts WHERE lifecycle = 'accepted' ORDER BY {_SCORE} DESC, id LIMIT 1) SELECT id FROM t WHERE superseded_by IS NULL")
def recall_limit_clamped(spark, sf):
    return serve.recall(facts_view(spark, sf), probe(spark, sf), 0).select("id")


@query("""WITH {facts}, d AS (SELECT * FROM facts WHERE id = '00000042')
SELECT 'id' AS name, id AS value FROM d UNION ALL SELECT 'content', content FROM d UNION ALL SELECT 'scope', scope FROM d UNION ALL SELECT 'entity', entity FROM d UNION ALL SELECT 'superseded_by', superseded_by FROM d""")
def row_detail(spark, sf):
    return serve.detail(facts_view(spark, sf), "00000042").where(F.col("name").isin("id", "content", "scope", "entity", "superseded_by"))


# sessions, ids and bytes


@query("""WITH f AS (SELECT doc_id::VARCHAR AS key, doc_id * 60 AS mtime, strlen(text) AS size FROM documents),
c AS (SELECT doc_id::VARCHAR AS key, doc_id * 60 - CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS cm, strlen(text) - CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END AS o FROM documents WHERE doc_id % 2 = 0),
t AS (SELECT key FROM f LEFT JOIN c USING (key) WHERE c.cm IS NULL OR mtime > cm OR size > o)
SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM f) - (SELECT count(*) FROM t) AS skipped_by_cursor, (SELECT count(*) FROM t WHERE key::BIGINT % 4 = 1) AS skipped_short""")
def run_counters(spark, sf):
    files = _files(spark, sf)
    n = F.col("key").cast("bigint")
    cursor = files.where(n % 2 == 0).select("key", (F.col("mtime") - F.when(n % 5 == 0, 1).otherwise(0)).alias("mtime"), (F.col("size") - F.when(n % 3 == 0, 10).otherwise(0)).alias("offset"))
    todo = sessions.needs_processing(files, cursor)
    found = jobs.job_counters(files, todo, todo.where(n % 4 != 1))
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


@query("""WITH f AS (SELECT doc_id::VARCHAR AS key, doc_id * 60 AS mtime, doc_id % 3 AS k FROM documents)
SELECT key, CASE WHEN k = 2 THEN mtime ELSE mtime + 5 END AS mtime, CASE k WHEN 2 THEN 7 ELSE 9 END::BIGINT AS "offset" FROM f WHERE k > 0 UNION ALL SELECT key, mtime, 7 FROM f WHERE k = 0 AND key::BIGINT % 2 = 0 UNION ALL SELECT key, mtime + 5, 9 FROM f WHERE k = 0 AND key::BIGINT % 2 = 1""")
def cursor_marked(spark, sf):
    """Files of residue 1 and odd ones of residue 0 were read on; the rest of the cursor stays."""
    f, n = _files(spark, sf), F.col("key").cast("bigint")
    on = (n % 3 == 1) | ((n % 3 == 0) & (n % 2 == 1))
    return sessions.mark_processed(f.where(n % 3 != 1).select("key", "mtime", F.lit(7).cast("long").alias("offset")), f.where(on).select("key", (F.col("mtime") + 5).alias("mtime"), F.lit(9).cast("long").alias("offset")))


def _write_sessions(spark, sf) -> str:
    """The first conversations as transcript files of three projects, every fifth an aside; their folder."""
    root = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    rows = _json_lines(spark, sf).where("session < 40").groupBy("session").agg(F.sort_array(F.collect_list(F.struct("line_no", "value"))).alias("lines")).collect()
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in rows:
        k = int(r.session)
        name = f"p{k % 3}/s0/subagents/agent-aside_question-{k}.jsonl" if k % 5 == 0 else f"p{k % 3}/{k}.jsonl"
        out = fs.create(path(f"{root}/{name}"), True)
        out.write(bytearray("".join(x.value + "\n" for x in r.lines).encode()))
        out.close()
    for other in ("p0/notes.txt", "p1/s0/subagents/agent-other.jsonl"):
        fs.create(path(f"{root}/{other}"), True).close()
    return root


_FROM_FILES = f"""{TURNS_SQL}, f AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_no FROM conversations WHERE conv_id < 40),
g AS (SELECT 'p' || (conv_id % 3) AS project, CASE WHEN conv_id % 5 = 0 THEN 'agent-aside_question-' || conv_id ELSE conv_id::VARCHAR END AS session, conv_id % 5 = 0 AS aside, line_no, role, text FROM f)"""


@query(f"WITH {_FROM_FILES} SELECT project, session, aside, count(*) AS lines FROM g WHERE project <> 'p2' GROUP BY ALL")
def discovered_lines(spark, sf):
    files = sessions.discover(spark, _write_sessions(spark, sf), exclude=["p2"])
    return sessions.raw_lines(spark, files).groupBy("project", "session", "aside").agg(F.count("*").alias("lines"))


@query(f"WITH {_FROM_FILES} SELECT project, session, aside, line_no, CASE role WHEN 'user' THEN 'Human' ELSE 'Assistant' END AS role, CASE WHEN role = 'assistant' AND NOT ends_with(text, chr(10)) THEN text || chr(10) ELSE text END AS text FROM g WHERE role IN ('user', 'assistant') AND text <> ''")
def turns_from_files(spark, sf):
    return tr.record_turns(sessions.raw_lines(spark, sessions.discover(spark, _write_sessions(spark, sf))), TEST)


@query(f"WITH {_FROM_FILES} SELECT session, line_no - 2 AS line_no, CASE role WHEN 'user' THEN 'Human' ELSE 'Assistant' END AS role, CASE WHEN role = 'assistant' AND NOT ends_with(text, chr(10)) THEN text || chr(10) ELSE text END AS text FROM g WHERE line_no >= 2 AND role IN ('user', 'assistant') AND text <> ''")
def turns_after_an_offset(spark, sf):
    """Each file from the byte at which its third line begins."""
    files = sessions.discover(spark, _write_sessions(spark, sf))
    ends = sessions.raw_lines(spark, files).where("line_no < 2").groupBy("session").agg(F.sum(F.octet_length("value") + 1).cast("long").alias("offset"))
    return tr.record_turns(sessions.raw_lines(spark, files.join(ends, "session")), TEST).select("session", "line_no", "role", "text")


def _one_chunk_each(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("session"), F.col("source").alias("project"), F.lit(0).alias("chunk_index"), F.substring("text", 1, 200).alias("text"))


@query("SELECT doc_id::VARCHAR AS session, source AS project, 0 AS chunk_index, 'no idea' AS answer FROM documents WHERE contains(substr(text, 1, 200), 'the')")
def dead_letters(spark, sf):
    _, dead = jobs.extract(_one_chunk_each(spark, sf), lambda: StubModel(16, {"the": "no idea"}, in_last=True))
    return dead.select("session", "project", "chunk_index", "answer")


@query("""SELECT doc_id::VARCHAR AS session, i::INTEGER AS index, CASE WHEN i = 1 THEN 'project' ELSE 'personal' END AS scope FROM documents, range(0, 3) r(i) WHERE i > 0""")
def curated_batches(spark, sf):
    """Three candidates a document, of which the model drops the first and makes the second one of the project."""
    c = _one_chunk_each(spark, sf).select("session", "project", "chunk_index", F.col("text").alias("source"), F.explode(F.array(*map(F.lit, range(3)))).alias("index"), F.lit("personal").alias("scope"), F.lit("fact").alias("category"), F.lit("x").alias("content"), F.lit(0.9).alias("confidence"))
    answer = '[{"index": 0, "action": "drop"}, {"index": 1, "action": "keep_as_project"}]'
    return jobs.curate_candidates(c, lambda: StubModel(16, {"CANDIDATES": answer}), TEST).select("session", "index", "scope")


@query(
    f"WITH {{facts}}, t AS (SELECT *, {_SCORE} AS s FROM facts WHERE lifecycle = 'accepted' AND scope = 'project' ORDER BY s DESC, id LIMIT 5) "
    "SELECT coalesce(string_agg('- (' || scope || '/' || category || coalesce(' [' || entity || ']', '') || ') ' || content, chr(10) ORDER BY s DESC, id), 'Nothing relevant is known.') AS text FROM t WHERE superseded_by IS NULL"
)
def recall_tool(spark, sf):
    """The request as a caller makes it: text, limit and scope, with a model that embeds every text alike."""
    vector = list(probe(spark, sf))

    class Fixed(StubModel):
        def embed(self, texts):
            return [vector for _ in texts]

    return spark.createDataFrame([(jobs.recall(_store(spark, sf), "anything", lambda: Fixed(64), 5, "Project"),)], "text string")


@query("""SELECT source AS project, CASE WHEN doc_id % 4 = 1 THEN 'agent-aside_question-' || doc_id ELSE 's' || doc_id END AS session, doc_id % 4 = 1 AS aside, doc_id AS line_no FROM documents WHERE doc_id % 4 <> 2""")
def session_paths(spark, sf):
    n = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("s1/subagents/agent-aside_question-"), n)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("s1/subagents/agent-other-"), n)).otherwise(F.concat(F.lit("s"), n))
    d = table(spark, sf, "documents").select(F.concat(F.lit("hdfs://host/root/"), "source", F.lit("/"), name, F.lit(".jsonl")).alias("path"), F.col("doc_id").alias("offset"), F.lit("x").alias("value"))
    return sessions.session_lines(d).drop("value")


@query(f"SELECT doc_id, {_uuid_sql('doc_id || chr(31) || lang || chr(31) || substr(text, 1, 20)')} AS id FROM documents")
def stable_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.stable_id("doc_id", "lang", F.substring("text", 1, 20)).alias("id"))


_CUT = "substr(t, 1, coalesce(list_max(list_filter(range(0, 42), lambda k: strlen(substr(t, 1, k)) <= 41)), 0)::INTEGER)"


@query(f"SELECT doc_id, {_CUT} AS cut, CASE WHEN strlen(t) <= 41 THEN t ELSE {_CUT} || '...' END AS shown FROM (SELECT doc_id, substr(text, doc_id % 7 + 1, 60) AS t FROM documents)")
def byte_truncation(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.col("text").substr((F.col("doc_id") % 7 + 1).cast("int"), F.lit(60)).alias("t"))
    return t.select("doc_id", X.truncate_bytes(spark, "t", 41).alias("cut"), X.preview(spark, "t", 41).alias("shown"))


@query("SELECT vec_id, (len(embedding) * 4)::INTEGER AS bytes, list_transform(embedding, lambda x: round(x::DOUBLE, 5) + 0.0) AS vector FROM embeddings WHERE vec_id < 50")
def blob_codec(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id < 50").select("vec_id", V.to_blob(spark, F.col("embedding")).alias("blob"))
    return e.select("vec_id", F.octet_length("blob").alias("bytes"), F.transform(V.from_blob(spark, F.col("blob")), lambda x: F.round(x.cast("double"), 5) + F.lit(0.0)).alias("vector"))


@query("""SELECT doc_id, i AS index, CASE WHEN doc_id % 5 = 4 THEN 'keep' WHEN i = 0 THEN ['keep', 'drop', 'keep_as_project', 'keep'][(doc_id % 4 + 1)::INTEGER] WHEN i = 1 THEN 'merge' ELSE 'keep' END AS action,
CASE WHEN doc_id % 5 <> 4 AND i = 1 THEN (doc_id % 9)::INTEGER END AS target, CASE WHEN doc_id % 5 = 4 THEN 'unparseable response' WHEN i = 0 THEN 'r' || doc_id WHEN i = 1 THEN NULL ELSE 'no decision' END AS reason
FROM documents, (SELECT unnest(range(0, 3))::INTEGER AS i)""")
def parse_curation(spark, sf):
    """Plain, fenced, after thinking, in prose, or unreadable answers for three candidates; the first decision for one holds."""
    n = F.col("doc_id").cast("string")
    action = F.element_at(F.array(*map(F.lit, ("keep", "drop", "keep_as_project", "wait"))), (F.col("doc_id") % 4 + 1).cast("int"))
    items = F.concat(F.lit('[{"index": 0, "action": "'), action, F.lit('", "reason": "r'), n, F.lit('"}, {"index": 1, "action": "merge:'), (F.col("doc_id") % 9).cast("string"), F.lit('"}, {"index": 0, "action": "drop"}, {"index": 9, "action": "drop"}]'))
    way = F.col("doc_id") % 5
    answer = F.when(way == 0, items).when(way == 1, F.concat(F.lit("```json\n"), items, F.lit("\n```"))).when(way == 2, F.concat(F.lit("<think>[]</think>\n"), items)).when(way == 3, F.concat(F.lit("Decisions: "), items, F.lit(" as asked."))).otherwise("[{]")
    d = table(spark, sf, "documents").select("doc_id", F.explode(decisions_column(spark, answer, F.lit(3))).alias("d"))
    return d.select("doc_id", "d.index", "d.action", "d.target", "d.reason")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN 'fact ' || doc_id END AS content, CASE WHEN doc_id % 4 = 0 THEN 'habit' WHEN doc_id % 4 <> 3 THEN 'pattern' END AS category, CASE WHEN doc_id % 4 = 1 THEN 0.5::DOUBLE WHEN doc_id % 4 <> 3 THEN 0.8::DOUBLE END AS confidence, doc_id % 4 = 3 AS failed FROM documents""")
def parse_synthesis(spark, sf):
    n, way = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    one = lambda rest: F.concat(F.lit('{"content": "fact '), n, F.lit(f'"{rest}}}'))
    answer = F.when(way == 0, one(', "category": "habit"')).when(way == 1, F.concat(F.lit("```\n"), one(', "confidence": 0.5'), F.lit("\n```"))).when(way == 2, F.concat(F.lit("Here: "), one(""), F.lit("!"))).otherwise("none")
    d = table(spark, sf, "documents").select("doc_id", synthesis_column(spark, answer).alias("r"))
    return d.select("doc_id", "r.content", "r.category", "r.confidence", F.col("r.error").isNotNull().alias("failed"))
