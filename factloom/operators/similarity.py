"""Cosines of many pairs by blocks: matrix products in Arrow tasks instead of a row-by-row theta join.

Rows that may meet share a key.  The rows of a key are dealt to blocks, and each
pair of blocks is one row of work, dealt to tasks by the pair: so a task holds
two blocks and a strip of their products at a time, whatever the table's size, a
key of very many rows is the work of many tasks, and one product of BLAS
replaces as many interpreted expressions as there are pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import map_arrow, materialize
from .components import Stars

#: Rows and numbers of a block at most (but for chance), and products of a strip.
ROWS, NUMBERS, STRIP = 8192, 1 << 20, 1 << 21


def _rows(df: DataFrame, id_: str, vector: str, key: Column | None, more: Column | None, tag: str) -> DataFrame:
    """(k, id, v, x) of the rows that have an id and a key; a vector that is null becomes empty."""
    v = F.coalesce(F.col(vector).cast("array<float>"), F.array().cast("array<float>"))
    rows = df.select((F.lit("") if key is None else key).alias("k"), F.col(id_).cast("string").alias("id"), v.alias("v"), (F.lit(None) if more is None else more).cast("bigint").alias("x"))
    return materialize(rows.where("id is not null and k is not null"), tag)


def _size(*tables: DataFrame) -> int:
    """Rows of a block, by the longest vector."""
    longest = [t.agg(F.max(F.size("v"))).first()[0] or 1 for t in tables]
    return max(1, min(ROWS, NUMBERS // max(1, *longest)))


def _counts(rows: DataFrame, size: int, name: str) -> DataFrame:
    return rows.groupBy("k").agg(F.ceil(F.count("*") / size).cast("int").alias(name))


def _dealt(rows: DataFrame, counts: DataFrame, own: str, tag: str) -> DataFrame:
    """(k, counts, b, ids, vecs, xs): the rows of each key in as many blocks as the column ``own`` of ``counts`` says."""
    names = [c for c in counts.columns if c != "k"]
    dealt = rows.join(counts, "k").withColumn("b", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
    blocks = dealt.groupBy("k", *names, "b").agg(F.collect_list(F.struct("id", "v", "x")).alias("r"))
    return materialize(blocks.select("k", *names, "b", F.col("r.id").alias("ids"), F.col("r.v").alias("vecs"), F.col("r.x").alias("xs")), tag)


def _work(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, ids, vecs, xs, ids, vecs, xs): blocks i and j of a key; each side has the numbers of those that it meets in ``meets``."""
    one = left.select("k", F.col("b").alias("i"), F.explode("meets").alias("j"), "ids", "vecs", "xs")
    other = right.select("k", F.explode("meets").alias("i"), F.col("b").alias("j"), F.col("ids").alias("ids2"), F.col("vecs").alias("vecs2"), F.col("xs").alias("xs2"))
    return one.hint("merge").join(other, ["k", "i", "j"]).select("i", "j", "ids", "vecs", "xs", "ids2", "vecs2", "xs2")


def _between(left: DataFrame, right: DataFrame, more: Column | None, tag: str, size: int | None) -> DataFrame:
    """The work of each row of ``left`` with those of ``right`` that have its key ``k``."""
    x, y = _rows(left, "id", "embedding", F.col("k"), None, f"{tag}-left"), _rows(right, "id", "embedding", F.col("k"), more, f"{tag}-right")
    size = size or _size(x, y)
    counts = materialize(_counts(x, size, "n").join(_counts(y, size, "m"), "k"), f"{tag}-counts")  # keys of one side only meet nothing
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one, other = _dealt(x, counts, "n", f"{tag}-left-blocks"), _dealt(y, counts, "m", f"{tag}-right-blocks")
    return _work(one.withColumn("meets", upto("m")), other.withColumn("meets", upto("n")))


def _units(vecs: pa.Scalar) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors that have it, and those vectors over their norms; zeros stay zeros."""
    rows = vecs.values
    size = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = {}
    for width in np.unique(size[size > 0]):
        places = np.flatnonzero(size == width)
        m = (flat if len(places) == len(size) else flat[np.repeat(size == width, size)]).reshape(-1, width)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        found[int(width)] = places, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return found


def _strips(x: pa.Scalar, y: pa.Scalar):
    """(first row, cosines) of the rows of x with all of y, some rows at a time; 0 for vectors of different or no length."""
    n, m, a, b = len(x), len(y), _units(x), _units(y)
    step = max(1, STRIP // max(1, m))
    plain = a.keys() == b.keys() and len(a) == 1 and all(len(u[0]) == k for us, k in ((a, n), (b, m)) for u in us.values())
    for i in range(0, n, step):
        if plain:
            (_, u), (_, v) = *a.values(), *b.values()
            yield i, u[i : i + step] @ v.T
            continue
        score = np.zeros((min(step, n - i), m))
        for width in a.keys() & b.keys():
            (p, u), (q, v) = a[width], b[width]
            here = (p >= i) & (p < i + step)
            score[np.ix_(p[here] - i, q)] = u[here] @ v.T
        yield i, score


def similar_pairs(df: DataFrame, at_least: float, id_: str = "id", vector: str = "embedding", size: int | None = None) -> DataFrame:
    """(a, b, score), a < b: the pairs of rows with a cosine of at least ``at_least``."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (np.array(batch.column(c)[k].as_py(), object) for c in (2, 5))
                for first, score in _strips(batch.column(3)[k], batch.column(6)[k]):
                    i, j = np.nonzero(score >= at_least)
                    score, i = score[i, j], i + first
                    if batch.column(0)[k].as_py() == batch.column(1)[k].as_py():
                        once = x[i] < y[j]
                        i, j, score = i[once], j[once], score[once]
                    a, b = np.minimum(x[i], y[j]), np.maximum(x[i], y[j])
                    yield pa.record_batch([pa.array(a.tolist(), pa.string()), pa.array(b.tolist(), pa.string()), pa.array(score)], names=["a", "b", "score"])

    return map_arrow(_among(df, id_, vector, None, size), run, "a string, b string, score double")


def similar_links(df: DataFrame, at_least: float, node: Column, id_: str = "id", vector: str = "embedding", size: int | None = None) -> DataFrame:
    """(a, b): edges between the bigints ``node`` of the rows, with the nodes and the connected components of ``similar_pairs``.

    A task keeps stars of what it finds, so a dense graph doesn't travel: no more rows
    leave a task than there are nodes in its blocks.
    """

    def run(batches):
        stars = Stars()
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (4, 7))
                same = batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                for first, score in _strips(batch.column(3)[k], batch.column(6)[k]):
                    i, j = np.nonzero(score >= at_least)
                    i += first
                    once = (i < j) & (x[i] != y[j]) if same else x[i] != y[j]
                    stars.add(x[i[once]], y[j[once]])
        yield from stars.batches(["a", "b"])

    return map_arrow(_among(df, id_, vector, node, size), run, "a long, b long")


def _among(df: DataFrame, id_: str, vector: str, more: Column | None, size: int | None) -> DataFrame:
    """The work of each row with every other that has a vector too."""
    rows = _rows(df.where(F.size(vector) > 0), id_, vector, None, more, "vectors")
    blocks = _dealt(rows, materialize(_counts(rows, size or _size(rows), "n"), "vectors-counts"), "n", "vectors-blocks")
    return _work(blocks.withColumn("meets", F.sequence("b", F.col("n") - 1)), blocks.withColumn("meets", F.sequence(F.lit(0), "b")))


def nearest(left: DataFrame, right: DataFrame, size: int | None = None) -> DataFrame:
    """(id, match_id, score): for each row of ``left`` the nearest row of ``right`` with its key in each pair of blocks.

    Columns id, embedding and k, the key; a null meets nothing.  Scores are rounded to
    12 places, and of equal ones the least id counts, so a minimum over the rows of
    an id has the nearest of all.
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, others = batch.column(2)[k].values, np.array(batch.column(5)[k].as_py(), object)
                order = np.argsort(others)
                names = pa.array(others[order].tolist(), pa.string())
                vecs = batch.column(6)[k]
                ordered = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), vecs.values.take(pa.array(order)))[0]
                for first, score in _strips(batch.column(3)[k], ordered):
                    np.rint(np.multiply(score, 1e12, out=score), out=score)
                    best = score.argmax(1)  # the first of equal ones
                    yield pa.record_batch([ids.slice(first, len(best)), names.take(pa.array(best)), pa.array(score[np.arange(len(best)), best] / 1e12)], names=["id", "match_id", "score"])

    return map_arrow(_between(left, right, None, "nearest", size), run, "id string, match_id string, score double")


def pairs_within(left: DataFrame, right: DataFrame, low: float, below: float, more: Column, size: int | None = None) -> DataFrame:
    """(id, old_id, score, x): the pairs of rows with the same key and a cosine from ``low`` to under ``below``; x is ``more``, a bigint of the row of ``right``."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, old, x = batch.column(2)[k].values, batch.column(5)[k].values, batch.column(7)[k].values
                for first, score in _strips(batch.column(3)[k], batch.column(6)[k]):
                    i, j = np.nonzero((score >= low) & (score < below))
                    for at in range(0, len(i), 100_000):
                        a, b = i[at : at + 100_000], j[at : at + 100_000]
                        yield pa.record_batch([ids.take(pa.array(a + first)), old.take(pa.array(b)), pa.array(score[a, b]), x.take(pa.array(b))], names=["id", "old_id", "score", "x"])

    return map_arrow(_between(left, right, more, "within", size), run, "id string, old_id string, score double, x bigint")


def latest_within(left: DataFrame, right: DataFrame, low: float, below: float, more: Column, size: int | None = None) -> DataFrame:
    """(id, old_id, n): of the pairs of ``pairs_within`` the number for each id, and the old_id of the largest x, ties to the least; null comes last.

    Each pair of blocks gives a row an id, so the pairs themselves don't travel.
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, old, x = batch.column(2)[k].values, batch.column(5)[k].values, batch.column(7)[k].values
                order = pc.sort_indices(pa.table({"x": x, "id": old}), sort_keys=[("x", "descending"), ("id", "ascending")], null_placement="at_end")
                rank = np.empty(len(order), np.int64)
                rank[order.to_numpy()] = np.arange(len(order))
                for first, score in _strips(batch.column(3)[k], batch.column(6)[k]):
                    hit = (score >= low) & (score < below)
                    n = hit.sum(1)
                    i = np.flatnonzero(n)
                    top = order.take(pa.array(np.where(hit[i], rank, len(rank)).min(1))) if len(i) else order.slice(0, 0)
                    yield pa.record_batch([ids.take(pa.array(i + first)), old.take(top), x.take(top), pa.array(n[i])], names=["id", "old_id", "x", "n"])

    found = map_arrow(_between(left, right, more, "latest", size), run, "id string, old_id string, x bigint, n bigint")
    first = F.min_by("old_id", F.struct(F.col("x").isNull(), -F.col("x"), "old_id"))
    return found.groupBy("id").agg(first.alias("old_id"), F.sum("n").alias("n"))
