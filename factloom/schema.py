"""The fact table: its columns, and the checks that a row must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCOPES = ("personal", "project")
CATEGORIES = tuple("fact preference decision pattern context interest humor opinion".split())
LIFECYCLES = ("candidate", "accepted")
#: The session of rows that consolidation made.
SETTLED = "settling"

FACTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), False),
    T.StructField("embedding_dim", T.IntegerType(), False),
    T.StructField("scope", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("entity", T.StringType()),
    T.StructField("source_project", T.StringType()),
    T.StructField("source_session", T.StringType(), False),
    T.StructField("source_timestamp", T.TimestampType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
    T.StructField("accessed_at", T.TimestampType()),
    T.StructField("lifecycle", T.StringType(), False),
    T.StructField("confidence", T.FloatType(), False),
    T.StructField("supersedes", T.StringType()),
    T.StructField("superseded_by", T.StringType()),
])

CANDIDATE = "content string, scope string, category string, entity string, confidence double, scope_confidence double"


def conform(df: DataFrame) -> DataFrame:
    """The columns of the fact table in order, cast; absent optional ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in FACTS.fields])


def problems() -> Column:
    """The first reason for which a stored row is unsound, or null."""
    needed = [f.name for f in FACTS.fields if not f.nullable]
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in needed])
    return (
        F.when(missing != "", F.concat(F.lit("missing "), missing))
        .when(~F.lower("scope").isin(*SCOPES), F.concat(F.lit("invalid scope: "), "scope"))
        .when(~F.lower("category").isin(*CATEGORIES), F.concat(F.lit("invalid category: "), "category"))
        .when(~F.lower("lifecycle").isin(*LIFECYCLES), F.concat(F.lit("invalid lifecycle: "), "lifecycle"))
        .when(F.size("embedding") != F.col("embedding_dim"), F.lit("embedding_dim differs from the embedding"))
    )


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("superseded_by").isNull())
