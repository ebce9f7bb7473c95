"""Reading the fact table: filtered lists, keyword search, exact vector top-k, statistics and export."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_like
from ..functions.vectors import cosine, vector_literal
from ..schema import SCOPES

_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def list_facts(facts: DataFrame, scope=None, category=None, lifecycle=None, entity=None, source_project=None, limit: int | None = None, only_live: bool = False) -> DataFrame:
    """Rows that match every given value; the filters reach the Parquet scan.  A limit takes the least ids."""
    given = {"scope": scope, "category": category, "lifecycle": lifecycle, "entity": entity, "source_project": source_project}
    tests = [F.col(c) == v for c, v in given.items() if v is not None] + [F.col("superseded_by").isNull()] * only_live
    out = facts.where(reduce(Column.__and__, tests)) if tests else facts
    return out if limit is None else out.orderBy("id").limit(limit)


def list_then_live(facts: DataFrame, limit: int, **filters) -> DataFrame:
    """The limit comes first and superseded rows go afterwards, so fewer than ``limit`` may remain."""
    return list_facts(facts, limit=limit, **filters).where(F.col("superseded_by").isNull())


def get_by_id(facts: DataFrame, id_: str) -> DataFrame:
    return facts.where(F.col("id") == id_)


def with_prefix(facts: DataFrame, prefix: str) -> DataFrame:
    """The rows whose id starts with ``prefix``, or is it, for a full UUID."""
    if _UUID.fullmatch(prefix):
        return get_by_id(facts, prefix.lower())
    return facts.where(F.col("id").startswith(prefix))


def find_by_prefix(facts: DataFrame, prefix: str) -> DataFrame:
    """The one row whose id starts with ``prefix`` (or is it, for a full UUID); none or several are an error."""
    found = with_prefix(facts, prefix)
    ids = [r.id for r in found.select("id").orderBy("id").limit(5).collect()]
    if not ids:
        raise LookupError(f"nothing starts with {prefix!r}")
    if len(ids) > 1:
        raise LookupError(f"{prefix!r} is ambiguous: {', '.join(ids)}")
    return found


def keyword_search(facts: DataFrame, needle: str, limit: int = 10) -> DataFrame:
    """Rows with ``needle`` in the content or the entity, case folded; candidates and superseded rows too."""
    pattern = f"%{escape_like(needle)}%"
    return facts.where(F.ilike("content", F.lit(pattern)) | F.ilike("entity", F.lit(pattern))).orderBy("id").limit(limit)


def scored(facts: DataFrame, query, score: str = "score") -> DataFrame:
    return facts.withColumn(score, cosine("embedding", vector_literal(query)))


def vector_search(facts: DataFrame, query, k: int = 10, scope: str | None = None) -> DataFrame:
    """The ``k`` accepted rows nearest to ``query`` by cosine, ties by id, with their score.

    Each task keeps its own best k, so k rows a task travel, not the table.
    """
    return scored(list_facts(facts, scope=scope, lifecycle="accepted"), query).orderBy(F.desc("score"), "id").limit(k)


def check_scope(scope: str | None) -> str | None:
    if scope is not None and scope.lower() not in SCOPES:
        raise ValueError(f"invalid scope: {scope}")
    return scope and scope.lower()


def recall(facts: DataFrame, query, limit: int = 5, scope: str | None = None, strict_k: bool = False) -> DataFrame:
    """Top-k, then without superseded rows, so fewer than ``limit`` may remain; with ``strict_k`` they go first."""
    k = max(1, limit)
    if strict_k:
        return vector_search(facts.where(F.col("superseded_by").isNull()), query, k, check_scope(scope))
    return vector_search(facts, query, k, check_scope(scope)).where(F.col("superseded_by").isNull())


def recall_line() -> Column:
    entity = F.when(F.col("entity").isNotNull(), F.concat(F.lit(" ["), "entity", F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.lit("- ("), "scope", F.lit("/"), "category", entity, F.lit(") "), "content")


def recall_text(found: DataFrame) -> DataFrame:
    """One row, ``text``: a line for each row by descending score, or a notice that there is none."""
    rows = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", recall_line().alias("line"))))
    text = F.array_join(F.transform(rows, lambda r: r["line"]), "\n")
    return found.agg(F.when(F.count("*") == 0, F.lit("Nothing relevant is known.")).otherwise(text).alias("text"))


def search(facts: DataFrame, text: str, model=None, k: int = 10) -> DataFrame:
    """By vector where a model is given, else by keyword; superseded rows stay in either."""
    return vector_search(facts, model.embed([text])[0], k) if model else keyword_search(facts, text, k)


def statistics(facts: DataFrame) -> DataFrame:
    """(dimension, value, n): all rows, and those by scope, lifecycle and category, in one pass."""
    g = F.grouping_id("scope", "lifecycle", "category")
    sets = facts.select("scope", "lifecycle", "category").groupingSets([[], ["scope"], ["lifecycle"], ["category"]], "scope", "lifecycle", "category")
    return sets.agg(F.count("*").alias("n"), g.alias("g")).select(
        F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "scope").when(F.col("g") == 5, "lifecycle").otherwise("category").alias("dimension"),
        F.coalesce("scope", "lifecycle", "category", F.lit("all")).alias("value"),
        "n",
    )


def by_category(facts: DataFrame) -> DataFrame:
    return facts.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def export_rows(facts: DataFrame) -> DataFrame:
    return facts.drop("embedding", "embedding_dim")


def export_json(facts: DataFrame) -> DataFrame:
    """(id, json): each row as pretty-printed JSON, without the vector."""
    rows = export_rows(facts)
    return rows.select("id", F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def dimensions(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count_distinct(F.size("embedding")).alias("n_dims"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"))


def detail(facts: DataFrame, prefix: str) -> DataFrame:
    """(name, value): the columns of the one row that ``prefix`` names, without the vector."""
    row = export_rows(find_by_prefix(facts, prefix))
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in row.columns])
    return row.select(F.inline(pairs))
