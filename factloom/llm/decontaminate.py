"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item of a few dozen words inside a document of thousands has a tiny
Jaccard similarity, so one signature length for all documents can't find it.
Documents and items are therefore partitioned by the size of their shingle sets
(powers of two), and each pair of classes has its own one-permutation MinHash
signature: the hash range is cut into ``bins`` by its top bits and each bin keeps
the document's smallest shingle.  All signatures of a document are read off one
sorted pass: a shingle is the smallest of its bin unless the one before it has the
same top bits.

The minima that are shingles of an item estimate how much of it the document
holds.  ``bins`` is the least power of two at which a document that holds
``threshold`` of an item shows a quarter of that or more among its minima with
chance 1 - ``miss``; pairs with fewer are pruned, the others are verified by their
exact shingle containment.  Where items are too short for that, all shingles are
looked up, and pruning is exact.

The documents are scanned once, without a shuffle.  The item index is broadcast
in blocks of at most ``max_index`` shingles: a larger benchmark is searched
block by block, with the union of the blocks' exact results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import map_arrow, materialize
from . import _kernels as K

RESULT = "doc_id long, item_id long, shared int, item_shingles int"


def _fewer(n: int, p: float, k: int) -> float:
    """The chance of fewer than ``k`` successes in ``n`` trials of chance ``p`` < 1."""
    log = lambda m: math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1) + m * math.log(p) + (n - m) * math.log1p(-p)
    return sum(math.exp(log(m)) for m in range(k))


def sketch_for(size: int, item: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bins, least hits at which a pair is kept) for documents of up to ``size`` shingles and items of ``item`` or more.

    A shingle is its bin's minimum with p = (1 - exp(-x)) / x at x shingles a
    bin; an item shares at least threshold * item of them, each with chance p.
    Where 64 bins a shingle are too few, each of the 48 bits' values is a bin, so
    all shingles are looked up.
    """
    need = max(1, math.ceil(threshold * item - 1e-9))
    bins = 16
    while bins < 64 * max(size, 1):
        x = size / bins
        if _fewer(need, (1 - math.exp(-x)) / x, -(-need // 4)) <= miss:
            return bins, -(-need // 4)
        bins *= 2
    return 1 << 48, need


def bins_for(size: int, item: int, threshold: float, miss: float) -> int:
    """Bins of the signature of a document of up to ``size`` shingles for items of ``item`` or more."""
    return sketch_for(size, item, threshold, miss)[0]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the range, value) for each value of the ranges [low, high)."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return which, low[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)


class Index:
    """The shingles of a block of items, as sorted arrays; ``verified`` counts the documents that were verified exactly."""

    def __init__(self, shingle: np.ndarray, item: np.ndarray, n: int, threshold: float, miss: float):
        order = np.argsort(shingle, kind="stable")
        self.shingle, self.item = shingle[order], item[order]
        self.ids, sizes = np.unique(item, return_counts=True)
        self.sizes = sizes
        self.n, self.threshold, self.verified = n, threshold, 0
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[self._bits(self.shingle >> K.U(16))] = True
        # items by the size of their shingle set: their shingles, and for each class of documents bits of a bin and least hits
        kind = np.log2(np.maximum(sizes, 1)).astype(np.int64)[np.searchsorted(self.ids, self.item)] if len(item) else np.zeros(0, np.int64)
        self.classes = []
        for k in np.unique(kind):
            mine = kind == k
            sketches = [sketch_for(1 << c, 1 << int(k), threshold, miss) for c in range(48)]
            self.classes.append((self.shingle[mine] >> K.U(16), self.item[mine], np.array([int(math.log2(b)) for b, _ in sketches]), np.array([m for _, m in sketches])))

    @staticmethod
    def _bits(low: np.ndarray) -> np.ndarray:
        return (low & K.U((1 << 22) - 1)).astype(np.int64)

    def search(self, h: np.ndarray, row: np.ndarray, n_rows: int) -> list[tuple[int, int, int, int]]:
        """(row, item, shared, item's shingles) of the contained items."""
        key = np.sort((row.astype(K.U) << K.U(48)) | (h >> K.U(16)))
        if not len(key) or not len(self.item):
            return []
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        size = np.bincount((key >> K.U(48)).astype(np.int64), minlength=n_rows)
        kind = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        at = np.flatnonzero(self.bitmap[self._bits(key)])
        rows, low = (key[at] >> K.U(48)).astype(np.int64), key[at] & K.U((1 << 48) - 1)
        # how a shingle differs from the one before it in its row, from the top
        differs = np.where(at > 0, key[at] ^ key[at - 1], K.U(2**64 - 1))
        wanted = np.zeros(n_rows, bool)
        for shingle, item, bits, least in self.classes:
            least_of = (differs >> (K.U(48) - bits[kind[rows]].astype(K.U))) != 0
            a, b = np.searchsorted(shingle, low[least_of], "left"), np.searchsorted(shingle, low[least_of], "right")
            which, place = _spread(a, b)
            if len(which):
                pair = np.stack([rows[least_of][which], item[place]])
                pair, hits = np.unique(pair, axis=1, return_counts=True)
                wanted[pair[0][hits >= least[kind[pair[0]]]]] = True
        self.verified += int(wanted.sum())
        starts = K.row_starts(row, n_rows)
        out = []
        for k in np.flatnonzero(wanted):
            mine = np.unique(h[starts[k] : starts[k + 1]])
            _, place = _spread(np.searchsorted(self.shingle, mine, "left"), np.searchsorted(self.shingle, mine, "right"))
            items, shared = np.unique(self.item[place], return_counts=True)
            total = self.sizes[np.searchsorted(self.ids, items)]
            enough = shared >= np.ceil(self.threshold * total - 1e-9)
            out += [(int(k), int(i), int(s), int(t)) for i, s, t in zip(items[enough], shared[enough], total[enough])]
        return out


def item_shingles(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct (shingle, item_id) of the items; items under ``n`` words have none."""

    def shingle(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, buf, off in K.text_slices(batch.column(1), lower=True):
                h, row = K.windows(*K.words(buf, off), n)
                yield pa.record_batch([pa.array(K.as_signed(h)), ids.slice(i, j - i).take(pa.array(row))], names=["shingle", "item_id"])

    src = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(src, shingle, "shingle long, item_id long").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.6, miss: float = 1e-4, max_index: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles) where a document holds at least
    ``threshold`` of an item's distinct ``n``-word shingles.

    Words are lower-cased runs of letters and digits (bytes beyond ASCII count
    as letters).  Null and empty texts, and texts and items under ``n`` words,
    match nothing; items with a null item_id are skipped; item rows that share
    an item_id make one item.  A document with a null doc_id is searched and
    reported with it; repeated document rows are reported once each.  Texts of
    any length are searched whole.  Other columns are ignored.  An empty table
    on either side gives an empty result.
    """
    spark = docs.sparkSession
    index = materialize(item_shingles(benchmark, n), "items")
    total = index.count()
    blocks = max(1, -(-total // max_index))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = None
    for b in range(blocks):
        part = index if blocks == 1 else index.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = part.toArrow()
        block = Index(rows["shingle"].to_numpy().view(K.U), rows["item_id"].to_numpy(), n, threshold, miss)
        sent = spark.sparkContext.broadcast(block)

        def search(batches, sent=sent):
            index = sent.value
            for batch in batches:
                ids = batch.column(0)
                for i, j, buf, off in K.text_slices(batch.column(1), lower=True):
                    h, row = K.windows(*K.words(buf, off), index.n)
                    found = index.search(h, row, j - i)
                    if found:
                        r, item, shared, size = zip(*found)
                        yield pa.record_batch([ids.slice(i, j - i).take(pa.array(r)), pa.array(item, pa.int64()), pa.array(shared, pa.int32()), pa.array(size, pa.int32())], names=["doc_id", "item_id", "shared", "item_shingles"])

        found = map_arrow(src, search, RESULT)
        result = found if result is None else result.unionByName(found)
    return result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents that hold no test item, all columns kept.

    The flagged ids are written first, so the anti-join sees their true size;
    a document with a null doc_id is never dropped.  Of rows that share a doc_id
    all go if one holds an item.  Null and empty texts stay; an empty table stays
    empty; an empty benchmark drops nothing.
    """
    bad = materialize(contaminated(docs, benchmark, **params).select(F.col("doc_id").alias("__bad_id")).where("__bad_id is not null").distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"] == bad["__bad_id"], "left_anti")
