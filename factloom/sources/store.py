"""The fact store: immutable Parquet snapshots and a pointer to the current one.

A write makes the next snapshot and then replaces the pointer file in one
rename, so readers see all of a change or none.  One writer at a time.  Paths
are those of Hadoop file systems, so the store may lie anywhere Spark can write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reconcile import link_back
from ..schema import FACTS, LIFECYCLES, SCOPES, conform, problems
from .workspace import materialize


class StoreError(ValueError):
    pass


class FactStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        if self.version() is None:
            self._write(spark.createDataFrame([], FACTS), 0)

    # pointer

    def version(self) -> int | None:
        """The current snapshot's number.  Pointer files are named by it; the highest counts."""
        if not self._fs.exists(self._path("")):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        found = [int(n[8:]) for n in names if n.startswith("CURRENT-") and n[8:].isdigit()]
        return max(found, default=None)

    def _write(self, rows: DataFrame, version: int) -> None:
        conform(rows).write.mode("overwrite").parquet(f"{self.root}/v={version}")
        temporary = self._path(f".pointer-{version}")
        self._fs.create(temporary, True).close()
        if not self._fs.rename(temporary, self._path(f"CURRENT-{version}")):
            raise StoreError(f"another writer made version {version}")

    def commit(self, rows: DataFrame) -> int:
        version = (self.version() or 0) + 1
        self._write(rows, version)
        return version

    # reads

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(FACTS).parquet(f"{self.root}/v={self.version() if version is None else version}")

    def unsound(self) -> DataFrame:
        """Rows that break the schema's rules, with the reason."""
        return self.read().withColumn("reason", problems()).where("reason is not null")

    # writes

    def _checked(self, rows: DataFrame, store: DataFrame) -> DataFrame:
        rows = materialize(conform(rows), "insert")
        bad = rows.withColumn("reason", problems()).where("reason is not null").select("id", "reason").limit(1).collect()
        if bad:
            raise StoreError(f"{bad[0].id}: {bad[0].reason}")
        dims = [r[0] for r in rows.select("embedding_dim").union(store.select("embedding_dim")).distinct().limit(3).collect()]
        if len(dims) > 1:
            raise StoreError(f"embedding dimensions differ: {sorted(dims)}")
        twice = rows.groupBy("id").count().where("count > 1").select("id").union(rows.join(store, "id", "left_semi").select("id")).limit(1).collect()
        if twice:
            raise StoreError(f"the id {twice[0].id} is taken")
        return rows

    def insert(self, rows: DataFrame) -> int:
        """Adds rows; all are checked before anything is written."""
        store = self.read()
        return self.commit(store.unionByName(self._checked(rows, store)))

    def settle(self, rows: DataFrame, edges: DataFrame, as_of=None) -> int:
        """Adds rows and back-links (new_id, old_id) in one snapshot; an id that is taken changes nothing."""
        store = self.read()
        new = self._checked(rows, store)
        return self.commit(link_back(store.unionByName(new), edges, F.current_timestamp() if as_of is None else as_of))

    def _update(self, id_: str, column: str, value: str, allowed: tuple[str, ...]) -> int:
        if value.lower() not in allowed:
            raise StoreError(f"invalid {column}: {value}")
        store = self.read()
        if not store.where(F.col("id") == id_).limit(1).count():
            raise StoreError(f"no row {id_}")
        return self.commit(updated(store, id_, column, value.lower(), F.current_timestamp()))

    def update_lifecycle(self, id_: str, lifecycle: str) -> int:
        return self._update(id_, "lifecycle", lifecycle, LIFECYCLES)

    def update_scope(self, id_: str, scope: str) -> int:
        return self._update(id_, "scope", scope, SCOPES)

    def accept(self, id_: str) -> int:
        return self.update_lifecycle(id_, "accepted")

    def promote(self, id_: str) -> int:
        return self.update_scope(id_, "personal")

    def delete(self, id_: str) -> int:
        """Removes a row; one that isn't there is no error, and links to it stay."""
        return self.commit(self.read().where(F.col("id") != id_))

    def insert_placeholder(self, id_: str, content: str, dim: int = 768, confidence: float = 0.5, accept_from: float = 0.85, **columns) -> int:
        """A row with a zero vector, for trying things out."""
        now = F.current_timestamp()
        given = dict(source_session="debug", scope="project", category="fact", entity=None, source_project=None) | columns
        row = self.spark.range(1).select(
            F.lit(id_).alias("id"), F.lit(content).alias("content"), F.array_repeat(F.lit(0.0).cast("float"), dim).alias("embedding"), F.lit(dim).alias("embedding_dim"),
            *[F.lit(v).cast("string").alias(k) for k, v in given.items()], *[now.alias(c) for c in ("source_timestamp", "created_at", "updated_at")],
            F.lit("accepted" if confidence >= accept_from else "candidate").alias("lifecycle"), F.lit(confidence).alias("confidence"),
        )
        return self.insert(row)


def updated(store: DataFrame, id_: str, column: str, value: str, as_of) -> DataFrame:
    """The store with one value changed and updated_at set."""
    here = F.col("id") == id_
    return store.withColumns({column: F.when(here, value).otherwise(F.col(column)), "updated_at": F.when(here, as_of).otherwise(F.col("updated_at"))})
