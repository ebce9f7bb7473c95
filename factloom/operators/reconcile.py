"""Reconciling candidates with the store: validation, gates, duplicates and supersession.

Two semantics, both well defined.  In snapshot mode every candidate is compared
with the store as it was before: a plain relational plan.  In ordered mode each
candidate sees the rows that its predecessors added: a left fold, run in one
task for each set of projects that can influence one another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..schema import CATEGORIES, SCOPES, live
from ..settings import Settings
from ..sources.workspace import materialize, ship_package
from .similarity import latest_within, nearest, pairs_within


def gate(candidates: DataFrame, s: Settings) -> DataFrame:
    """Adds ``scope`` (lower-cased, demoted), ``category``, ``lifecycle`` and ``outcome``.

    outcome is the first failure, in this order: scope, category, confidence; null
    for those that pass.  Comparisons are in DOUBLE.
    """
    scope, category = F.lower("scope"), F.lower("category")
    confidence, trust = F.col("confidence").cast("double"), F.col("scope_confidence").cast("double")
    low = F.lit(s.demote_below)
    return candidates.withColumns({
        "outcome": F.when(scope.isNull() | ~scope.isin(*SCOPES), "invalid_scope")
        .when(category.isNull() | ~category.isin(*CATEGORIES), "invalid_category")
        .when(F.coalesce(confidence, F.lit(0.5)) < s.drop_below, "low_confidence"),
        "demoted": F.coalesce((scope == "personal") & (F.coalesce(trust, F.lit(0.5)) < low), F.lit(False)),
        "lifecycle": F.when(confidence >= s.accept_from, "accepted").otherwise("candidate"),
    }).withColumns({"scope": F.when(F.col("demoted"), "project").otherwise(scope), "category": category})


def best_match(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """(id, match_id, score): the nearest live store row that each incoming row may duplicate.

    A project row is compared with its own project's rows and with personal ones,
    a personal row with personal ones.  Ties go to the least id.  A project is a
    key, and so are the personal rows, which every row with a vector meets.
    """
    old, project = live(store), F.struct(F.lit(False).alias("personal"), F.col("source_project").alias("project"))
    shared = F.struct(F.lit(True).alias("personal"), F.lit("").alias("project"))
    full = F.size("embedding") > 0
    own = F.when((F.col("scope") == "project") & F.col("source_project").isNotNull(), project)
    new = incoming.select("id", "embedding", F.explode(F.array_compact(F.array(own, F.when(full, shared)))).alias("k"))
    key = F.when(F.col("scope") == "personal", F.when(full, shared)).when(F.col("scope").isNotNull() & F.col("source_project").isNotNull(), project)
    best = F.min(F.struct((-F.col("score")).alias("s"), "match_id"))
    found = nearest(new, old.select("id", "embedding", key.alias("k")))
    return found.groupBy("id").agg(best.alias("b")).select("id", "b.match_id", (-F.col("b.s")).alias("score"))


def _of_one_entity(incoming: DataFrame, store: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """Both with the key of ``similarity``: rows supersede those of their entity and project."""
    both = F.when(F.col(entity).isNotNull() & F.col("source_project").isNotNull(), F.struct(F.col(entity).alias("entity"), F.col("source_project").alias("project"))).alias("k")
    return incoming.select("id", "embedding", both), store.where("superseded_by is null").select("id", "embedding", both, "created_at")


def supersession_pairs(incoming: DataFrame, store: DataFrame, s: Settings, entity: str = "entity") -> DataFrame:
    """(id, old_id, score, created_at): live store rows of one entity and project within the supersession band."""
    new, old = _of_one_entity(incoming, store, entity)
    pairs = pairs_within(new, old, s.supersede_from, s.supersede_below, F.unix_micros("created_at"))
    return pairs.select("id", "old_id", "score", F.timestamp_micros("x").alias("created_at"))


def reconcile_snapshot(incoming: DataFrame, store: DataFrame, s: Settings, entity: str = "entity") -> DataFrame:
    """(id, outcome, ref_id, n_superseded): what becomes of each incoming row against the store as it is.

    outcome is invalid_scope, invalid_category, low_confidence, duplicate, accepted
    or candidate; ref_id is the duplicate's row, or the most recent superseded one.
    """
    gated = gate(incoming, s)
    passed = gated.where("outcome is null")
    dup = materialize(best_match(passed, store).where(F.col("score") > s.duplicate_above).select("id", "match_id"), "duplicates")
    new, live_rows = _of_one_entity(passed.join(dup, "id", "left_anti"), store, entity)
    old = latest_within(new, live_rows, s.supersede_from, s.supersede_below, F.unix_micros("created_at")).withColumnRenamed("n", "n_superseded")
    return (
        gated.select("id", "outcome", "lifecycle")
        .join(dup, "id", "left")
        .join(old, "id", "left")
        .select("id", F.coalesce("outcome", F.when(F.col("match_id").isNotNull(), F.lit("duplicate")), "lifecycle").alias("outcome"), F.coalesce("match_id", "old_id").alias("ref_id"), F.coalesce("n_superseded", F.lit(0)).cast("bigint").alias("n_superseded"))
    )


class _Rows:
    """The rows that candidates meet, as arrays: unit vectors by length, and what decides who may meet whom."""

    def __init__(self, old: pd.DataFrame, new: pd.DataFrame):
        name = lambda values: pd.factorize(values.where(values.map(lambda x: isinstance(x, str))))[0]  # noqa: E731 - -1 for none
        n, self.n = len(old) + len(new), len(old)
        self.ids = np.array([*old["id"], *new["id"]], object)
        self.personal = np.array([*(old["scope"] == "personal"), *(new["scope"] == "personal")], bool)
        self.project = name(pd.concat([old["source_project"], new["source_project"]], ignore_index=True))
        self.entity = name(pd.concat([old["entity"], new["entity"]], ignore_index=True))
        self.at = np.array([x.timestamp() for x in [*old["created_at"], *new["created_at"]]])
        self.live = np.zeros(n, bool)
        self.live[: self.n] = True
        self.units: dict[int, np.ndarray] = {}
        self.place = np.zeros(n, np.int64)  # of a row among those of its length
        self.width = np.zeros(n, np.int64)
        vectors = [np.asarray(v, np.float64) for v in [*old["embedding"], *new["embedding"]]]
        for w in {len(v) for v in vectors}:
            rows = [k for k, v in enumerate(vectors) if len(v) == w]
            m = np.array([vectors[k] for k in rows]).reshape(len(rows), w)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            self.units[w] = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            self.place[rows], self.width[rows] = np.arange(len(rows)), w

    def cosines(self, row: int, others: np.ndarray) -> np.ndarray:
        """Rounded, so that equal vectors tie wherever they lie; 0 for other lengths."""
        out = np.zeros(len(others))
        same = np.flatnonzero(self.width[others] == self.width[row])
        units = self.units[self.width[row]]
        out[same] = np.round(units[self.place[others[same]]] @ units[self.place[row]], 12)
        return out


def fold(new: pd.DataFrame, old: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """Ordered reconciliation of gated candidates against rows that they may meet."""
    old = old[old["superseded_by"].isna()]
    new = new.sort_values(["seq", "id"])
    rows = _Rows(old, new)
    out = []
    for me, r in enumerate(new.itertuples(), rows.n):
        if isinstance(r.outcome, str):
            out.append((r.id, r.outcome, None, []))
            continue
        own = rows.project == rows.project[me] if rows.project[me] >= 0 else np.zeros(len(rows.live), bool)
        may = np.flatnonzero(rows.live & (rows.personal | own if r.scope == "project" else rows.personal))
        if len(may):
            score = rows.cosines(me, may)
            top = min(may[score == score.max()], key=lambda k: rows.ids[k])
            if score.max() > s.duplicate_above:
                out.append((r.id, "duplicate", rows.ids[top], []))
                continue
        same = np.flatnonzero(rows.live & own & (rows.entity == rows.entity[me])) if rows.entity[me] >= 0 else np.zeros(0, np.int64)
        score = rows.cosines(me, same)
        band = sorted(same[(score >= s.supersede_from) & (score < s.supersede_below)], key=lambda k: (-rows.at[k], rows.ids[k]))
        rows.live[band] = False
        rows.live[me] = True
        out.append((r.id, r.lifecycle, rows.ids[band[0]] if band else None, [rows.ids[k] for k in band]))
    return pd.DataFrame(out, columns=["id", "outcome", "ref_id", "superseded"])


def reconcile_ordered(incoming: DataFrame, store: DataFrame, s: Settings) -> DataFrame:
    """(id, outcome, ref_id, superseded): each candidate, in order of ``seq``, sees what its predecessors did.

    Projects meet only through personal rows.  Without a personal candidate, each
    project is folded in a task of its own, beside the personal rows; with one,
    all are folded in order in one task, as the semantics demand.
    """
    spark = incoming.sparkSession
    ship_package(spark)
    gated = gate(incoming, s)
    names = ["id", "scope", "source_project", "entity", "embedding", "created_at"]
    new = materialize(gated.select(*names, "seq", "lifecycle", "outcome"), "gated")
    mixed = bool(new.where("scope = 'personal' and outcome is null").limit(1).count())
    key = F.lit("") if mixed else F.coalesce("source_project", F.lit(""))
    old = materialize(live(store).select(*names, "superseded_by"), "live")
    if mixed:
        seen = old.withColumn("group", key)
    else:
        groups = new.select(key.alias("group")).distinct()
        personal = old.where("scope = 'personal'").crossJoin(groups)
        seen = old.where("scope <> 'personal'").withColumn("group", key).unionByName(personal)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return fold(left, right, s)

    return new.withColumn("group", key).groupBy("group").cogroup(seen.groupBy("group")).applyInPandas(run, "id string, outcome string, ref_id string, superseded array<string>")


def to_rows(incoming: DataFrame, outcomes: DataFrame, s: Settings, as_of: Column) -> DataFrame:
    """The new fact rows of reconciled candidates; ``supersedes`` is the most recent row that each replaces."""
    kept = outcomes.where(F.col("outcome").isin("accepted", "candidate"))
    return gate(incoming, s).drop("outcome", "lifecycle").join(kept, "id").select(
        "id", "content", "embedding", F.size("embedding").alias("embedding_dim"), "scope", "category", "entity", "source_project", "source_session",
        as_of.alias("source_timestamp"), as_of.alias("created_at"), as_of.alias("updated_at"), F.lit(None).cast("timestamp").alias("accessed_at"),
        F.col("outcome").alias("lifecycle"), F.col("confidence").cast("float").alias("confidence"), F.col("ref_id").alias("supersedes"), F.lit(None).cast("string").alias("superseded_by"),
    )


def link_back(store: DataFrame, edges: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The store with ``superseded_by`` set from edges (new_id, old_id); of several, the least new_id."""
    e = edges.groupBy(F.col("old_id").alias("__old")).agg(F.min("new_id").alias("__new"))
    hit = F.col("__new").isNotNull()
    out = store.join(e, store["id"] == F.col("__old"), "left")
    changes = {"superseded_by": F.coalesce("__new", "superseded_by")}
    if as_of is not None:
        changes["updated_at"] = F.when(hit, as_of).otherwise(F.col("updated_at"))
    return out.withColumns(changes).select(*store.columns)


def supersession_chains(store: DataFrame, most: int = 100) -> DataFrame:
    """(id, head, length): the end of each row's chain of ``superseded_by`` links.

    Pointers double each round, so a chain of n takes log n joins; a link to a
    missing row ends there.
    """
    state = store.select("id", F.coalesce("superseded_by", "id").alias("head"), F.when(F.col("superseded_by").isNull(), 0).otherwise(1).cast("bigint").alias("length"))
    for _ in range(max(1, most).bit_length()):
        state = materialize(state, "chains")
        step = state.select(F.col("id").alias("__id"), F.col("head").alias("__head"), F.col("length").alias("__length"))
        joined = state.join(step, F.col("head") == F.col("__id"), "left")
        moved = (F.col("__length") > 0) & (F.col("head") != F.col("id"))
        state = joined.select("id", F.when(moved, F.col("__head")).otherwise(F.col("head")).alias("head"), (F.col("length") + F.when(moved, F.col("__length")).otherwise(0)).alias("length"))
        if not joined.where(moved).limit(1).count():
            break
    return state


def candidate_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("id", stable_id("source_session", "chunk_index", "pos", "content"))
