"""Consolidation: facts that recur across projects are promoted, those about one entity are synthesised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..schema import SETTLED, live
from ..settings import Settings
from ..sources.workspace import materialize
from .components import connected_components
from .similarity import similar_links


def clusters(facts: DataFrame, s: Settings, scope: str | None = "project") -> DataFrame:
    """(id, cluster): live rows in similarity clusters of 2 to ``max_cluster``; cluster is the least id."""
    rows = live(facts)
    if scope:
        rows = rows.where(F.col("scope") == scope)
    numbered = materialize(rows.select("id", "embedding", F.xxhash64("id").alias("h")), "settling")
    found = connected_components(similar_links(numbered, s.cluster_from, F.col("h")))
    named = found.join(numbered.select("id", "h"), found["node"] == F.col("h")).select("id", "component")
    least = named.groupBy("component").agg(F.min("id").alias("cluster"), F.count("*").alias("n")).where(F.col("n").between(2, s.max_cluster))
    return named.join(least, "component").select("id", "cluster")


def vote(members: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """(key, value): the most frequent ``value`` by ``key``, ties to the least, ``default`` where there is none."""
    n = members.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    top = n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value))).alias("t"))
    return members.select(key).distinct().join(top, key, "left").select(key, F.coalesce(F.col(f"t.{value}"), F.lit(default)).alias(value))


def promotions(facts: DataFrame, s: Settings) -> DataFrame:
    """(cluster, ids, n_projects, category): clusters with rows of at least ``promote_projects`` projects."""
    members = clusters(facts, s).join(facts.select("id", "source_project", "category"), "id")
    members = materialize(members, "members")
    wide = members.groupBy("cluster").agg(F.count_distinct("source_project").alias("n_projects"), F.sort_array(F.collect_list("id")).alias("ids")).where(F.col("n_projects") >= s.promote_projects)
    return wide.join(vote(members, "cluster", "category", "pattern"), "cluster").select("cluster", "ids", "n_projects", "category")


def entity_groups(facts: DataFrame, promoted: DataFrame, s: Settings) -> DataFrame:
    """(entity, ids, category, scope, confidence): entities whose rows are worth one synthesis.

    A group has 3 to ``max_cluster`` live rows of more than one session, none of
    them made by consolidation, and at least ``synthesis_facts`` that no promotion
    takes; those are its ids.
    """
    rows = live(facts).where("entity is not null")
    size = F.count("*")
    ok = rows.groupBy("entity").agg(size.alias("n"), F.count_distinct("source_session").alias("sessions"), F.bool_or(F.col("source_session") == SETTLED).alias("settled"))
    ok = ok.where(F.col("n").between(s.synthesis_facts, s.max_cluster) & (F.col("sessions") > 1) & ~F.col("settled")).select("entity")
    taken = promoted.select(F.explode("ids").alias("id"))
    left = materialize(rows.join(ok, "entity", "left_semi").join(taken, "id", "left_anti").select("id", "entity", "category", "scope", "confidence"), "entity-rows")
    groups = left.groupBy("entity").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"), F.greatest(F.max("confidence"), F.lit(0.0)).alias("confidence")).where(F.col("n") >= s.synthesis_facts)
    return groups.join(vote(left, "entity", "category", "pattern"), "entity").join(vote(left, "entity", "scope", "project"), "entity").select("entity", "ids", "category", "scope", "confidence")


def preview(facts: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(promotions, entity groups) as written tables; nothing is generated or stored."""
    p = materialize(promotions(facts, s), "promotions")
    return p, materialize(entity_groups(facts, p, s), "syntheses")


def settled_rows(made: DataFrame, as_of: Column) -> DataFrame:
    """Fact rows of generated texts: columns kind, ids, content, embedding, scope, category, entity, confidence.

    The id follows from the sources, so a repeated run makes the same row.  The
    new row supersedes the first of its sources and starts as a candidate.
    """
    return made.select(
        stable_id("kind", F.array_join("ids", ",")).alias("id"), "content", "embedding", F.size("embedding").alias("embedding_dim"), "scope", "category", "entity",
        F.lit(None).cast("string").alias("source_project"), F.lit(SETTLED).alias("source_session"),
        as_of.alias("source_timestamp"), as_of.alias("created_at"), as_of.alias("updated_at"), F.lit(None).cast("timestamp").alias("accessed_at"),
        F.lit("candidate").alias("lifecycle"), F.col("confidence").cast("float").alias("confidence"), F.element_at("ids", 1).alias("supersedes"), F.lit(None).cast("string").alias("superseded_by"),
    )


def settlement_edges(made: DataFrame) -> DataFrame:
    """(new_id, old_id) of the sources of generated rows."""
    return made.select(stable_id("kind", F.array_join("ids", ",")).alias("new_id"), F.explode("ids").alias("old_id"))
