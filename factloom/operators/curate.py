"""Applying curation decisions to candidates: a join and two anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_losers(candidates: DataFrame, decisions: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, index) of the less confident side of each merge; the source of the merge wins ties.

    A target out of range makes no merge; a merge with itself loses itself.
    """
    c = candidates.select(batch, "index", "confidence")
    m = decisions.where("action = 'merge'").select(batch, "index", "target")
    source = m.join(c, [batch, "index"])
    target = c.select(F.col(batch).alias("__batch"), F.col("index").alias("__index"), F.col("confidence").alias("__confidence"))
    both = source.join(target, (F.col(batch) == F.col("__batch")) & (F.col("target") == F.col("__index")))
    lost = F.when(F.col("confidence") >= F.col("__confidence"), F.col("__index")).otherwise(F.col("index"))
    return both.select(batch, lost.alias("index")).distinct()


def apply_decisions(candidates: DataFrame, decisions: DataFrame, batch: str = "batch") -> DataFrame:
    """The candidates (batch, index, ...) that stay, with ``scope`` set to project where decided.

    The first decision for a candidate holds: ``rank`` orders them if present, else the action's name and the
    target; a candidate without any stays.
    """
    order = F.struct(*[c for c in ("rank", "action", "target") if c in decisions.columns])
    first = decisions.groupBy(batch, "index").agg(F.min_by(F.struct("action", "target"), order).alias("d")).select(batch, "index", "d.action", "d.target")
    stay = candidates.join(merge_losers(candidates, first, batch), [batch, "index"], "left_anti")
    out = stay.join(first.select(batch, "index", "action"), [batch, "index"], "left").where("coalesce(action, 'keep') <> 'drop'")
    return out.withColumn("scope", F.when(F.col("action") == "keep_as_project", "project").otherwise(F.col("scope"))).select(*candidates.columns)
