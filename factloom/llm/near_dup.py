"""MinHash near-duplicates with sequential Bayesian verification.

1. One scan gives each document a fingerprint of its set of word shingles and
   ``bands * rows`` MinHash values, 16 bits each.  Documents of equal sets are
   represented by the one of least doc_id.
2. Representatives that agree in all rows of a band share a bucket.  First every
   document is paired with the least representative of its buckets, which links
   most members of large groups with one edge each.  Then every pair of a bucket
   whose members lie in different components so far is a candidate too, so the
   result is that of all pairs of all buckets, without a cap on partners.  Large
   buckets are cut into blocks; each pair of blocks is compared in a task of its
   own, where the signatures lie, and only pairs that pass step 3 leave it.
3. Candidates' signatures are compared batch by batch.  With a uniform prior on
   the similarity, after m matches of n the posterior P(S >= threshold) is that
   of at most m successes in n + 1 trials of chance ``threshold``; pairs under
   ``miss`` are pruned.
4. Survivors are verified by the exact Jaccard similarity of their shingle sets.
5. Groups are the connected components of the verified pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.workspace import map_arrow, materialize
from . import _kernels as K

SHINGLE, THRESHOLD, BANDS, ROWS = 3, 0.5, 48, 4
#: Documents of a block of a large bucket.
BLOCK = 4096


def least_matches(hashes: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, least matches of the first n values at which a pair is kept)."""
    out = []
    for n in range(batch, hashes + 1, batch):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append((n, m))
    return out


def signatures(h: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    """(rows, hashes) MinHash values of 16 bits; ``starts`` are the non-empty rows' first shingles."""
    x = (h >> K.U(32)).astype(np.uint32)
    seed = K.mix(np.arange(1, 2 * hashes + 1, dtype=K.U))
    xor, mul = seed[:hashes].astype(np.uint32), seed[hashes:].astype(np.uint32) | np.uint32(1)
    out = np.empty((len(starts), hashes), np.uint16)
    for k in range(hashes):
        out[:, k] = np.minimum.reduceat((x ^ xor[k]) * mul[k], starts).astype(np.uint16)
    return out


def one_row_each(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with one row for each doc_id but null: of several rows, the one of least text that isn't null."""
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    many = materialize(src.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if many.isEmpty():
        return src
    least = src.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return src.join(many, "doc_id", "left_anti").unionByName(least)


def sketch(docs: DataFrame, n: int, hashes: int) -> DataFrame:
    """(doc_id, f1, f2, sig) of the documents that have words."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, buf, off in K.text_slices(batch.column(1), lower=True):
                h, row = K.shingles(*K.words(buf, off), n)
                if not len(h):
                    continue
                starts = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
                rows = row[starts]
                sig = signatures(h, starts, hashes)
                # the fingerprint adds up mixed distinct shingles, so order and repeats don't count
                order = np.lexsort((h, row))
                hs, rs = h[order], row[order]
                once = np.concatenate([[True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])])
                hs, rs = hs[once], rs[once]
                at = np.concatenate([[0], np.flatnonzero(rs[1:] != rs[:-1]) + 1])
                f1, f2 = np.add.reduceat(hs, at), np.add.reduceat(K.mix(hs), at)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * hashes), len(rows), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
                yield pa.record_batch([ids.slice(i, j - i).take(pa.array(rows)), pa.array(K.as_signed(f1)), pa.array(K.as_signed(f2)), raw], names=["doc_id", "f1", "f2", "sig"])

    return map_arrow(docs, run, "doc_id long, f1 long, f2 long, sig binary")


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width), dtype)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(dtype).reshape(len(column), width)


def band_rows(sketches: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, doc_id), ``bands`` rows a document."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column(1), np.uint16, bands * rows).reshape(-1, bands, rows)
            packed = np.zeros(sig.shape[:2], K.U)
            for r in range(rows):
                packed = packed * K.U(0x9E3779B97F4A7C15) + sig[:, :, r].astype(K.U) + K.U(1)
            key = K.mix(packed + K.mix(np.arange(bands, dtype=K.U) + K.U(77))[None, :])
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)
            yield pa.record_batch([pa.array(K.as_signed(key.ravel())), pa.array(ids)], names=["key", "doc_id"])

    return map_arrow(sketches.select("doc_id", "sig"), run, "key long, doc_id long")


def unpruned(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, keep: list[tuple[int, int]]) -> np.ndarray:
    """The places of the pairs (x[a], y[b]) of signatures that no batch of values prunes."""
    alive, matches, last = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in keep:
        matches = matches + (x[a[alive], last:n] == y[b[alive], last:n]).sum(1)
        ok = matches >= least
        alive, matches, last = alive[ok], matches[ok], n
    return alive


def bayes_filter(pairs: DataFrame, sketches: DataFrame, hashes: int, keep: list[tuple[int, int]]) -> DataFrame:
    """The pairs (a, b) that the batches of signature values don't prune."""

    def run(batches):
        for record in batches:
            each = np.arange(record.num_rows)
            take = pa.array(unpruned(_matrix(record.column(2), np.uint16, hashes), _matrix(record.column(3), np.uint16, hashes), each, each, keep))
            yield pa.record_batch([record.column(0).take(take), record.column(1).take(take)], names=["a", "b"])

    x = sketches.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa"))
    y = sketches.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
    return map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb"), run, "a long, b long")


def _whole_groups(batches, width: int):
    """Tables of whole groups from sorted batches whose first ``width`` columns name the group."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(width)])
        start = int(np.argmax((key == key[:, -1:]).all(0)))
        if held and (start or name != tuple(key[:, 0])):
            if name == tuple(key[:, 0]):
                held.append(batch.slice(0, start))
            else:
                start, batch = 0, batch
            yield pa.Table.from_batches(held)
            held = []
            key, batch = key[:, start:], batch.slice(start)
            start = int(np.argmax((key == key[:, -1:]).all(0)))
        if start:
            yield pa.Table.from_batches([batch.slice(0, start)])
            batch = batch.slice(start)
        held.append(batch)
        name = tuple(key[:, -1])
    if held:
        yield pa.Table.from_batches(held)


def bucket_pairs(open_: DataFrame, sketches: DataFrame, hashes: int, keep: list[tuple[int, int]], block: int) -> DataFrame:
    """The distinct pairs (a, b), a < b, of documents of one bucket but two labels that the signatures don't prune.

    ``open_`` has (key, n, doc_id, label), n being the documents of the bucket.
    """
    cut = open_.join(sketches.select("doc_id", "sig"), "doc_id").withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    each = cut.select("key", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), "doc_id", "label", "sig")
    rows = each.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc_id", "label", "sig")

    def run(batches):
        for table in _whole_groups(batches, 3):
            key, low, high, of, ids, label = (table.column(k).to_numpy() for k in range(6))
            sig = np.concatenate([_matrix(c, np.uint16, hashes) for c in table.column(6).chunks])
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            size = np.diff(np.append(new, len(key)))
            end = np.repeat(new + size, size)
            first = np.arange(len(key))
            for step in range(1, int(size.max())):
                first = first[first + step < end[first]]
                a, b = first, first + step
                # a pair of one block is compared where that block meets itself
                ok = (label[a] != label[b]) & ((low[a] == high[a]) | (of[a] != of[b]))
                a, b = a[ok], b[ok]
                left = unpruned(sig, sig, a, b, keep)
                if len(left):
                    x, y = ids[a[left]], ids[b[left]]
                    yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return map_arrow(rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high"), run, "a long, b long").where("a < b").distinct()


def verify(pairs: DataFrame, docs: DataFrame, n: int, threshold: float, broadcast_ids: int) -> DataFrame:
    """The pairs whose exact Jaccard similarity reaches ``threshold``, as a written table (a, b)."""
    pairs = materialize(pairs, "survivors")
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    small = ids.count() <= broadcast_ids
    texts = docs.withColumnRenamed("doc_id", "id")
    texts = texts.join(F.broadcast(ids) if small else ids, "id", "left_semi")

    def run(batches):
        for batch in batches:
            one, two = batch.column(2), batch.column(3)
            ok = np.zeros(batch.num_rows, bool)
            sets: dict[tuple[int, int], np.ndarray] = {}
            size = K.text_buffer(one)[1] + K.text_buffer(two)[1]
            for i, j in K.slices(size):
                for side, column in ((0, one), (1, two)):
                    buf, off = K.text_buffer(column.slice(i, j - i), lower=True)
                    h, row = K.shingles(*K.words(buf[off[0] : off[-1]], off - off[0]), n)
                    at = K.row_starts(row, j - i)
                    for k in range(j - i):
                        sets[side, k] = np.unique(h[at[k] : at[k + 1]])
                for k in range(j - i):
                    x, y = sets[0, k], sets[1, k]
                    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    ok[i + k] = both >= threshold * (len(x) + len(y) - both) - 1e-9
            take = pa.array(np.flatnonzero(ok))
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take)], names=["a", "b"])

    x = texts.withColumnsRenamed({"id": "a", "text": "ta"})
    y = texts.withColumnsRenamed({"id": "b", "text": "tb"})
    found = map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "ta", "tb"), run, "a long, b long")
    return materialize(found, "verified")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, batch: int = 32, miss: float = 0.005, broadcast_ids: int = 2_000_000, block: int = BLOCK) -> DataFrame:
    """(doc_id, group_id) of every document that has a near-duplicate.

    Two documents are near-duplicates if the Jaccard similarity of their sets of
    ``n``-word shingles is at least ``threshold``; a text of fewer words has one
    shingle.  group_id is the least doc_id of the connected component.  Words
    are lower-cased runs of letters and digits.  Documents without words (null,
    empty, punctuation only) and those with a null doc_id are in no group.  Rows
    that share a doc_id count as one document, whose text is the least of theirs
    that isn't null.  Texts of any length are compared whole; other columns are
    ignored; an empty table gives an empty result.  At the defaults a pair at the
    threshold is found with chance 0.95 and one at 0.6 with 0.998.
    """
    hashes = bands * rows
    keep = least_matches(hashes, batch, threshold, miss)
    docs = one_row_each(docs)
    table = materialize(sketch(docs, n, hashes), "sketch")
    groups = table.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
    dup = materialize(table.select("doc_id", "f1", "f2").join(groups, ["f1", "f2"]).where("doc_id <> rep").select("doc_id", "rep"), "copies")
    reps = table.select("doc_id", "sig").join(dup.select("doc_id"), "doc_id", "left_anti")
    # buckets are counted before they travel, so one of very many documents is no task's alone
    each = band_rows(reps, bands, rows)
    centers = each.groupBy("key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last")).where("center < last").select("key", "center")
    hits = materialize(each.join(centers, "key").select("key", "doc_id", "center"), "buckets")
    first = materialize(hits.where("doc_id > center").groupBy(F.col("doc_id").alias("b")).agg(F.min("center").alias("a")).select("a", "b"), "first")
    linked = verify(bayes_filter(first, table, hashes, keep), docs, n, threshold, broadcast_ids)
    label = materialize(connected_components(linked), "labels")
    named = hits.join(label, hits["doc_id"] == label["node"], "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x < y").select("key", "n")
    open_ = materialize(named.join(mixed, "key").select("key", "n", "doc_id", "label"), "open")
    rest = bucket_pairs(open_, table, hashes, keep, block).join(first, ["a", "b"], "left_anti")
    edges = linked.union(verify(rest, docs, n, threshold, broadcast_ids)).union(dup.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    return connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """One document of each group stays, that of least doc_id; all columns are kept.

    Documents outside groups, those without words and those with a null doc_id
    stay.  Rows that share a doc_id stay or go together.  An empty table stays
    empty.
    """
    gone = materialize(near_duplicates(docs, **params).where("doc_id <> group_id").select(F.col("doc_id").alias("__dup_id")), "duplicates")
    return docs.join(gone, docs["doc_id"] == gone["__dup_id"], "left_anti")
