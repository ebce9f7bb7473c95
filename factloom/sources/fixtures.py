"""The fact table as a view over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATEGORIES


def facts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings joined to documents, with the other columns derived from the id.

    ``conf_pct`` is the confidence as an integer percentage, on which exact
    comparisons are made.
    """
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 200).alias("content"), "source")
    n = F.col("vec_id")
    id_ = lambda x: F.lpad(x.cast("string"), 8, "0")
    personal = n % 5 == 0
    percent = 50 + (n * 7) % 50
    when = F.timestamp_seconds(F.lit(1704067200) + n * 60)
    return e.join(d, F.col("vec_id") == F.col("doc_id")).select(
        id_(n).alias("id"),
        "content",
        "embedding",
        F.size("embedding").alias("embedding_dim"),
        F.when(personal, "personal").otherwise("project").alias("scope"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (n % 8 + 1).cast("int")).alias("category"),
        F.when(n % 11 != 0, F.concat(F.lit("l"), F.col("label").cast("string"), F.lit("-"), (n % 12).cast("string"))).alias("entity"),
        F.when(~personal, F.col("source")).alias("source_project"),
        F.concat(F.lit("s"), (n % 50).cast("string")).alias("source_session"),
        when.alias("source_timestamp"),
        when.alias("created_at"),
        when.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("accessed_at"),
        F.when(percent >= 85, "accepted").otherwise("candidate").alias("lifecycle"),
        (percent / 100).cast("float").alias("confidence"),
        F.lit(None).cast("string").alias("supersedes"),
        F.when(n % 9 == 0, id_(n + 1)).alias("superseded_by"),
        percent.cast("int").alias("conf_pct"),
        "label",
        n.alias("n"),
    )


FACTS_SQL = """facts AS (
SELECT lpad(vec_id::VARCHAR, 8, '0') AS id, substr(text, 1, 200) AS content, embedding, len(embedding)::INTEGER AS embedding_dim,
       CASE WHEN vec_id % 5 = 0 THEN 'personal' ELSE 'project' END AS scope,
       ['fact', 'preference', 'decision', 'pattern', 'context', 'interest', 'humor', 'opinion'][(vec_id % 8 + 1)::INTEGER] AS category,
       CASE WHEN vec_id % 11 <> 0 THEN 'l' || label || '-' || (vec_id % 12) END AS entity,
       CASE WHEN vec_id % 5 <> 0 THEN source END AS source_project, 's' || (vec_id % 50) AS source_session,
       TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS created_at,
       CASE WHEN 50 + (vec_id * 7) % 50 >= 85 THEN 'accepted' ELSE 'candidate' END AS lifecycle,
       CASE WHEN vec_id % 9 = 0 THEN lpad((vec_id + 1)::VARCHAR, 8, '0') END AS superseded_by,
       (50 + (vec_id * 7) % 50)::INTEGER AS conf_pct, label, vec_id AS n
FROM embeddings JOIN documents ON vec_id = doc_id)"""
