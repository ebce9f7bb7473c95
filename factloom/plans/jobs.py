"""The batch jobs: reconcile transcripts into the store, consolidate it, and answer from it."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.model import Factory, chat_column, embed_column
from ..functions.parsers import candidates_column, decisions_column, synthesis_column
from ..functions.text import preview, tail_bytes
from ..operators import curate, reconcile, serve, settle
from ..operators.transcripts import min_turn_gate, preprocess_turns, record_turns
from ..schema import conform
from ..settings import Settings
from ..sources.sessions import discover, load_cursor, mark_processed, needs_processing, raw_lines, read_ends, store_cursor
from ..sources.store import FactStore
from ..sources.workspace import materialize, ship_package

DEPTHS = ("chunks", "extract", "curate", "reconcile", "commit")


@dataclass
class Report:
    """What a job found: tables by stage, and counters."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


def extract(chunks: DataFrame, factory: Factory, max_tokens: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(candidates, dead letters): answers are parsed once and written, since a model may not repeat itself."""
    spark = chunks.sparkSession
    ask = prompts.extraction(F.col("project"), F.col("session"), F.col("text"))
    answered = chunks.withColumn("answer", chat_column(spark, factory, prompts.EXTRACT, ask, prompts.EXTRACT_SHOTS, max_tokens))
    parsed = materialize(answered.withColumn("p", candidates_column(spark, F.col("answer"))), "answers")
    failed = F.col("answer").isNull() | F.col("p.error").isNotNull()
    dead = parsed.where(failed).select("session", "project", "chunk_index", "answer", F.coalesce("p.error", F.lit("no answer")).alias("error"))
    rows = parsed.where(~failed).select("session", "project", "chunk_index", F.col("text").alias("source"), F.posexplode("p.items").alias("index", "c"))
    return rows.select("session", "project", "chunk_index", "index", "source", "c.*"), dead


def curate_candidates(candidates: DataFrame, factory: Factory, s: Settings, max_tokens: int = 4096) -> DataFrame:
    """The candidates that the second model lets stay; it sees each chunk's candidates with the end of its text."""
    spark = candidates.sparkSession
    ship_package(spark)
    most = s.curation_tail_bytes

    @F.pandas_udf("string")
    def tail(col: pd.Series) -> pd.Series:
        return col.map(lambda x: tail_bytes(x, most))

    keyed = candidates.withColumn("batch", F.concat_ws("\u001f", "project", "session", F.col("chunk_index").cast("string")))
    batches = keyed.groupBy("batch").agg(F.first("source").alias("source"), F.sort_array(F.collect_list(F.struct("index", "scope", "category", "content"))).alias("items"))
    text = F.when(F.octet_length("source") > most, tail("source")).otherwise(F.col("source"))
    answered = batches.withColumn("answer", chat_column(spark, factory, prompts.CURATE, prompts.curation(text, F.col("items")), None, max_tokens))
    decided = materialize(answered.select("batch", F.explode(decisions_column(spark, F.col("answer"), F.size("items"))).alias("d")).select("batch", "d.*"), "decisions")
    return curate.apply_decisions(keyed, decided).drop("batch")


def reconcile_records(records: DataFrame, store: FactStore, factory: Factory, s: Settings | None = None, depth: str = "commit", resumed: DataFrame | None = None, as_of=None) -> Report:
    """Raw transcript lines to facts.  ``depth`` stops after a stage: chunks, extract, curate, reconcile; commit writes.

    Short of commit, candidates are compared with the store as it is; on commit
    each sees its predecessors.  Cheap checks come before the model is asked for vectors.
    """
    s = s or Settings()
    spark = records.sparkSession
    level = DEPTHS.index(depth)
    report = Report()

    def keep(name: str, df: DataFrame) -> DataFrame:
        report.tables[name] = materialize(df, name)
        report.counts[name] = report.tables[name].count()
        return report.tables[name]

    report.tables["turns"] = turns = materialize(record_turns(records, s), "turns")
    chunks = keep("chunks", preprocess_turns(turns, s, resumed))
    if level < 1:
        return report
    found, dead = extract(chunks, factory)
    found = keep("extracted", found)
    keep("dead_letters", dead)
    if level < 2:
        return report
    found = keep("curated", curate_candidates(found, factory, s))
    report.counts["curated_out"] = report.counts["extracted"] - report.counts["curated"]
    if level < 3:
        return report
    now = F.current_timestamp() if as_of is None else as_of
    named = found.select("content", "scope", "category", "entity", "confidence", "scope_confidence", F.col("project").alias("source_project"), F.col("session").alias("source_session"), "chunk_index", F.col("index").alias("pos"))
    named = reconcile.candidate_ids(named).dropDuplicates(["id"]).withColumn("seq", F.concat_ws("\u001f", "source_session", F.lpad(F.col("chunk_index").cast("string"), 8, "0"), F.lpad(F.col("pos").cast("string"), 8, "0")))
    # rows that an earlier run of the same lines made are not judged again
    known = store.read()
    named = materialize(named, "named")
    report.counts["known"] = named.join(known.select("id"), "id", "left_semi").count()
    named = named.join(known.select("id"), "id", "left_anti")
    checked = reconcile.gate(named, s).select("id", F.col("outcome").alias("early"))
    worth = named.join(checked, "id").withColumn("embedding", F.when(F.col("early").isNull(), embed_column(spark, factory, F.col("content")))).drop("early")
    incoming = keep("incoming", worth.withColumn("created_at", now))
    if level < 4:
        out = keep("outcomes", reconcile.reconcile_snapshot(incoming, known, s))
    else:
        out = keep("outcomes", reconcile.reconcile_ordered(incoming, known, s))
        rows = materialize(conform(reconcile.to_rows(incoming, out, s, now)), "rows")
        edges = out.select(F.col("id").alias("new_id"), F.explode("superseded").alias("old_id"))
        if rows.limit(1).count():
            store.settle(rows, edges, now)
    report.counts |= {f"outcome_{r.outcome}": r.n for r in out.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    return report


def reconcile_job(spark: SparkSession, root: str, store: FactStore, factory: Factory, s: Settings | None = None, depth: str = "commit", exclude=(), limit: int | None = None, session_prefix: str | None = None, cursor: str | None = None) -> Report:
    """Discovery, then ``reconcile_records``; the prefix applies after the limit.

    ``cursor`` is the path of the saved cursor.  A committing run skips the files
    that it has as they are and reads of the others only what was appended; it is
    saved after the commit, so a run that fails is made again.  Sessions with too
    few human turns stay where they were, and are read from there when they grow.
    Runs short of commit read everything and leave the cursor alone.
    """
    s = s or Settings()
    files = discover(spark, root, exclude, limit)
    if session_prefix:
        files = files.where(F.col("session").startswith(session_prefix))
    files = materialize(files, "files")
    if cursor is None or depth != "commit":
        report = reconcile_records(raw_lines(spark, files), store, factory, s, depth)
        report.counts["files"] = files.count()
        return report
    seen = load_cursor(spark, cursor)
    todo = materialize(needs_processing(files, seen), "todo")
    lines = materialize(raw_lines(spark, todo), "lines")
    resumed = todo.where("offset > 0").select("session")
    report = reconcile_records(lines, store, factory, s, depth, resumed)
    passed = min_turn_gate(report.tables["turns"], s.min_human_turns, resumed).select("session").union(resumed).distinct()
    done = materialize(read_ends(todo.join(passed, "session", "left_semi"), lines), "done")
    store_cursor(spark, cursor, mark_processed(seen, done))
    report.counts |= job_counters(files, todo, done)
    return report


def job_counters(files: DataFrame, todo: DataFrame, done: DataFrame) -> dict[str, int]:
    """How many files there were, how many of them the cursor had, and how many had too few turns."""
    n, m = files.count(), todo.count()
    return {"files": n, "skipped_by_cursor": n - m, "skipped_short": m - done.count()}


def settle_job(store: FactStore, factory: Factory, s: Settings | None = None, dry_run: bool = False, as_of=None) -> Report:
    """Promotions and syntheses.  The preview comes first; an empty one ends the job, and an item whose text can't be made is left for next time."""
    s = s or Settings()
    spark = store.spark
    promoted, groups = settle.preview(store.read(), s)
    report = Report({"promotions": promoted, "syntheses": groups}, {"promotions": promoted.count(), "syntheses": groups.count()})
    if dry_run or not (report.counts["promotions"] or report.counts["syntheses"]):
        return report
    facts = store.read()
    texts = facts.select("id", "content")
    same = lambda df, kind: df.select(F.lit(kind).alias("kind"), "ids", "category", *[F.col(c) if c in df.columns else d.alias(c) for c, d in (("scope", F.lit("personal")), ("entity", F.lit(None).cast("string")), ("confidence", F.lit(0.8).cast("float")))])
    todo = same(promoted, "promotion").unionByName(same(groups, "synthesis"))
    inside = todo.select("kind", "ids", F.explode("ids").alias("id")).join(texts, "id").groupBy("kind", "ids").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "content"))), lambda x: x["content"]).alias("contents"))
    todo = todo.join(inside, ["kind", "ids"])
    ask = F.when(F.col("kind") == "promotion", F.concat(F.lit(prompts.PROMOTE + "\n\n"), prompts.facts(F.col("contents")))).otherwise(F.concat(F.lit(prompts.SYNTHESIZE + "\n\n"), prompts.facts(F.col("contents"), F.coalesce("entity", F.lit("")))))
    answered = materialize(todo.withColumn("r", synthesis_column(spark, chat_column(spark, factory, "Answer with one JSON object.", ask, None, 4096))), "texts")
    made = answered.where("r.error is null").withColumn("content", F.col("r.content")).drop("r")
    made = materialize(made.withColumn("embedding", embed_column(spark, factory, F.col("content"))), "made")
    report.counts["failed"] = report.counts["promotions"] + report.counts["syntheses"] - made.count()
    now = F.current_timestamp() if as_of is None else as_of
    if made.limit(1).count():
        store.settle(settle.settled_rows(made, now), settle.settlement_edges(made), now)
    return report


def recall(store: FactStore, query: str, factory: Factory, limit: int = 5, scope: str | None = None, strict_k: bool = False) -> str:
    """The answer to a recall request as text; a wrong scope is answered with the reason."""
    try:
        serve.check_scope(scope)
    except ValueError as e:
        return str(e)
    found = serve.recall(store.read(), factory().embed([query])[0], limit, scope, strict_k)
    return serve.recall_text(found).first().text


def outcome_preview(incoming: DataFrame, outcomes: DataFrame) -> DataFrame:
    return incoming.select("id", "scope", "category", "content").join(outcomes, "id")


def chunk_preview(chunks: DataFrame, lines: int = 3, most: int = 100) -> DataFrame:
    """(session, chunk_index, approx_tokens, line): the first lines of each chunk, cut short."""
    each = chunks.select("session", "chunk_index", "approx_tokens", F.posexplode(F.slice(F.split("text", "\n"), 1, lines)).alias("k", "line"))
    return each.select("session", "chunk_index", "approx_tokens", "k", preview(chunks.sparkSession, "line", most).alias("line"))
