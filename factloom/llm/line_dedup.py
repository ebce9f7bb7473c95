"""Line dedup over a sharded minimal perfect hash.

One scan counts, for each distinct line hash, the documents that hold the line
and the least of their ids.  The lines of enough documents to be removed form the
index, cut into shards by bits of the hash.  A shard is a minimal perfect hash
(levels of bit arrays: a key settles at the first level where no other key wants
its bit; its slot is the rank of that bit) over compact arrays of fingerprints,
document counts and first documents.  Documents then probe the arrays: a key
outside the index lands on a slot with another fingerprint and counts once.

Up to ``max_broadcast`` bytes of shards are broadcast and probed where the
documents lie, without a shuffle.  Beyond that only line hashes travel, 8 bytes
with their document, each to a task that is sent its shard.  A shard is sent to as
many tasks as it takes for all to have work, and the documents of its lines are
spread over them, so a line of very many documents is no task's alone; a task
reads its lines as a stream.  Both ways give the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import map_arrow, materialize
from . import _kernels as K

MIN_DOCS = 5
_NONE = np.iinfo(np.int64).max


class Shard:
    """A minimal perfect hash and its arrays; ``pack`` and ``unpack`` turn it into bytes and back."""

    GAMMA = 1.5

    def __init__(self, keys: np.ndarray, counts: np.ndarray, firsts: np.ndarray):
        levels, left, seed = [], keys, 0
        while len(left):
            size = max(64, int(len(left) * self.GAMMA) + 63 & ~63)
            at = self._place(left, seed, size)
            wanted = np.bincount(at, minlength=size)
            levels.append(wanted == 1)
            left = left[wanted[at] != 1]
            seed += 1
        self.sizes = np.array([len(x) for x in levels], np.int64)
        self.bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        self._rank()
        slot = self.slots(keys)
        n = len(keys)
        self.prints, self.counts, self.firsts = np.zeros(n, np.uint32), np.zeros(n, np.int32), np.zeros(n, np.int64)
        self.prints[slot] = self._print(keys)
        self.counts[slot] = np.minimum(counts, 2**31 - 1)
        self.firsts[slot] = firsts

    @staticmethod
    def _place(keys: np.ndarray, seed: int, size: int) -> np.ndarray:
        return (K.mix(keys + K.mix(np.array([seed + 1], K.U))) % K.U(size)).astype(np.int64)

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (K.mix(keys ^ K.U(0x5851F42D4C957F2D)) >> K.U(32)).astype(np.uint32)

    def _rank(self) -> None:
        words = np.packbits(self.bits).reshape(-1, 8)
        each = np.unpackbits(words, axis=1).sum(1)
        self.before = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its bit."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for seed, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self._place(keys[left], seed, int(size)) + base
            hit = self.bits[at]
            p = at[hit]
            word = p >> 6
            ones = self.before[word]
            inside = np.cumsum(self.bits.reshape(-1, 64), axis=1, dtype=np.uint8) if not hasattr(self, "_inside") else self._inside
            self._inside = inside
            out[left[hit]] = ones + inside[word, p & 63] - 1
            left = left[~hit]
            base += int(size)
        return out

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that hold the line, least of them); (1, none) for lines outside the index."""
        count, first = np.ones(len(keys), np.int32), np.full(len(keys), _NONE)
        if len(self.counts):
            slot = self.slots(keys)
            known = np.flatnonzero(slot >= 0)
            known = known[self.prints[slot[known]] == self._print(keys[known])]
            count[known], first[known] = self.counts[slot[known]], self.firsts[slot[known]]
        return count, first

    def pack(self) -> bytes:
        head = np.array([len(self.sizes), len(self.bits), len(self.counts)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.sizes, np.packbits(self.bits), self.prints, self.counts, self.firsts))

    @classmethod
    def unpack(cls, blob: bytes) -> Shard:
        self = cls.__new__(cls)
        levels, bits, n = np.frombuffer(blob, np.int64, 3)
        at = 24
        self.sizes = np.frombuffer(blob, np.int64, levels, at)
        at += 8 * levels
        self.bits = np.unpackbits(np.frombuffer(blob, np.uint8, bits // 8, at)).astype(bool)
        at += bits // 8
        self.prints = np.frombuffer(blob, np.uint32, n, at)
        self.counts = np.frombuffer(blob, np.int32, n, at + 4 * n)
        self.firsts = np.frombuffer(blob, np.int64, n, at + 8 * n)
        self._rank()
        return self


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, line offsets by row) of the lines that aren't blank, without outer spaces."""
    start, end, at = K.runs(buf, offsets, K.NOT_NEWLINE)
    full_end = end.copy()
    space = ~K.NOT_SPACE
    # a few blanks at either end are skipped one by one, more of them by whole runs
    before, after = np.arange(len(start)), np.arange(len(start))
    for _ in range(8):
        before = before[(start < end)[before]]
        before = before[space[buf[start[before]]]]
        start[before] += 1
        after = after[(start < end)[after]]
        after = after[space[buf[end[after] - 1]]]
        end[after] -= 1
        if not len(before) and not len(after):
            break
    else:
        first, last, _ = K.runs(buf, offsets, space)
        if len(first) and len(before):
            k = np.maximum(np.searchsorted(first, start[before], "right") - 1, 0)
            inside = (first[k] <= start[before]) & (start[before] < last[k])
            start[before] = np.where(inside, np.minimum(last[k], end[before]), start[before])
        if len(first) and len(after):
            k = np.maximum(np.searchsorted(first, end[after], "left") - 1, 0)
            inside = (first[k] < end[after]) & (end[after] <= last[k])
            end[after] = np.where(inside, np.maximum(first[k], start[after]), end[after])
    keep = start < end
    before = np.concatenate([[0], np.cumsum(keep)])
    start, end, full_end = start[keep], end[keep], full_end[keep]
    return K.hash_spans(buf, start, end)[0], start, full_end, before[at]


def line_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """(line, docs, first): each line hash of ``min_docs`` or more documents."""

    def count(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, buf, off in K.text_slices(batch.column(1)):
                h, _, _, at = lines(buf, off)
                row = np.repeat(np.arange(j - i), np.diff(at))
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                once = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
                h, row = h[once], row[once]
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                many = np.diff(np.append(new, len(h)))
                first = np.minimum.reduceat(ids[i:j][row], new) if len(new) else np.zeros(0, np.int64)
                yield pa.record_batch([pa.array(K.as_signed(h[new])), pa.array(many, pa.int64()), pa.array(first, pa.int64())], names=["line", "docs", "first"])

    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = map_arrow(src, count, "line long, docs long, first long")
    return rows.groupBy("line").agg(F.sum("docs").alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= min_docs)


def build_index(counts: DataFrame, shard_lines: int) -> DataFrame:
    """(shard, n_shards, blob): shards of about ``shard_lines`` lines, written to the shared folder."""
    counts = materialize(counts, "lines")
    n = max(1, -(-counts.count() // shard_lines))

    def build(key, table):
        keys = table["line"].to_numpy().view(K.U)
        shard = Shard(keys, table["docs"].to_numpy(), table["first"].to_numpy())
        return pa.table({"shard": [key[0].as_py()], "n_shards": [n], "blob": [shard.pack()]}, schema=pa.schema([("shard", pa.int64()), ("n_shards", pa.int64()), ("blob", pa.binary())]))

    sharded = counts.withColumn("shard", F.shiftrightunsigned("line", 33) % n)
    return materialize(sharded.groupBy("shard").applyInArrow(build, "shard long, n_shards long, blob binary"), "index")


def _shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> K.U(33)) % K.U(n)).astype(np.int64)


def _probe(shards: dict[int, Shard], n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count, first = np.ones(len(h), np.int32), np.full(len(h), _NONE)
    which = _shard_of(h, n)
    for s in np.unique(which) if n > 1 else [0]:
        if s in shards:
            at = np.flatnonzero(which == s)
            count[at], first[at] = shards[s].probe(h[at])
    return count, first


def _rewrite(buf: np.ndarray, off: np.ndarray, start: np.ndarray, at: np.ndarray, drop: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Texts without the dropped lines: (new text or None where nothing changes, lines, dropped), by row."""
    total = np.diff(at)
    lost = np.add.reduceat(np.append(drop.astype(np.int64), 0), np.minimum(at[:-1], len(drop))) * (total > 0) if len(total) else total
    texts: list = [None] * len(total)
    for r in np.flatnonzero(lost):
        raw = buf[off[r] : off[r + 1]].tobytes()
        gone = np.sort(start[at[r] : at[r + 1]][drop[at[r] : at[r + 1]]] - off[r])
        pieces, pos, g = [], 0, 0
        for line in raw.split(b"\n"):
            end = pos + len(line)
            if g < len(gone) and gone[g] < end:
                g += 1
            else:
                pieces.append(line)
            pos = end + 1
        texts[r] = b"\n".join(pieces).decode("utf-8", "replace")
    return texts, total, lost


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it while ``taken`` has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, shard_lines: int = 1_000_000, max_broadcast: int = 128 << 20) -> DataFrame:
    """``docs`` with repeated lines removed, and __n_lines, __n_dropped appended.

    A line that occurs in ``min_docs`` or more documents stays in the document of
    least doc_id and is removed from all others, with its line break.  Lines are
    compared without outer blanks and tabs; blank lines are kept and not counted,
    and repeats inside one document count once.  Every column is kept; n_chars,
    where present as an integer, is recomputed for changed texts.  A null text
    stays null, a text whose lines all go becomes empty.  Rows with a null doc_id
    are neither counted nor changed.  Rows that repeat a doc_id count as often as
    they occur and keep or lose lines alike.  An empty table stays empty.  Where
    docs has a column of an appended name, underscores are put before the new one.
    """
    spark = docs.sparkSession
    index = build_index(line_counts(docs, min_docs), shard_lines)
    size, n = index.agg(F.sum(F.length("blob")), F.max("n_shards")).first()
    n = int(n or 1)
    names = docs.columns
    lines_name, dropped_name = fresh("__n_lines", names), fresh("__n_dropped", names)
    where = {c: names.index(c) for c in ("doc_id", "text")}
    resize = "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType))
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema.fields), T.StructField(lines_name, T.LongType()), T.StructField(dropped_name, T.LongType())])

    def edit(batch, i, j, buf, off, start, at, drop):
        texts, total, lost = _rewrite(buf, off, start, at, drop)
        columns = [batch.column(k).slice(i, j - i) for k in range(len(names))]
        changed = np.flatnonzero(lost)
        if len(changed):
            mask = pa.array(lost > 0)
            new = pa.array([texts[r] for r in changed], columns[where["text"]].type)
            columns[where["text"]] = pc.replace_with_mask(columns[where["text"]], mask, new)
            if resize:
                k = names.index("n_chars")
                columns[k] = pc.replace_with_mask(columns[k], mask, pc.cast(pc.utf8_length(new), columns[k].type))
        return pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=[*names, lines_name, dropped_name])

    def ids_of(batch):
        column = batch.column(where["doc_id"])
        known = pc.is_valid(column).to_numpy(zero_copy_only=False)
        return pc.fill_null(pc.cast(column, pa.int64()), -1).to_numpy(zero_copy_only=False), known

    if (size or 0) <= max_broadcast:
        sent = spark.sparkContext.broadcast({r.shard: bytes(r.blob) for r in index.select("shard", "blob").toLocalIterator()})

        def run(batches):
            shards = {s: Shard.unpack(b) for s, b in sent.value.items()}
            for batch in batches:
                ids, known = ids_of(batch)
                for i, j, buf, off in K.text_slices(batch.column(where["text"])):
                    h, start, _, at = lines(buf, off)
                    row = np.repeat(np.arange(i, j), np.diff(at))
                    count, first = _probe(shards, n, h)
                    drop = (count >= min_docs) & (first != ids[row]) & known[row]
                    yield edit(batch, i, j, buf, off, start, at, drop)

        return map_arrow(docs, run, schema)

    def emit(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, buf, off in K.text_slices(batch.column(1)):
                h, start, _, at = lines(buf, off)
                row = np.repeat(np.arange(j - i), np.diff(at))
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                once = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
                h, row = h[once], row[once]
                yield pa.record_batch([ids.slice(i, j - i).take(pa.array(row)), pa.array(K.as_signed(h)), pa.array(_shard_of(h, n))], names=["doc_id", "line", "shard"])

    def lookup(batches):
        key = shard = None
        for batch in batches:
            place = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(a, b - a)
                if key != (here := tuple(place[:, a])):
                    key, shard = here, None
                if part.column(4)[0].is_valid:  # the blob comes before the lines of its shard
                    shard, part = Shard.unpack(part.column(4)[0].as_py()), part.slice(1)
                if shard is None or not part.num_rows:
                    continue
                ids = part.column(2).to_numpy()
                count, first = shard.probe(part.column(3).to_numpy().view(K.U))
                yield pa.record_batch([part.column(2), part.column(3)], names=["doc_id", "line"]).filter(pa.array((count >= min_docs) & (first != ids)))

    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, -(-2 * tasks // n))
    probes = map_arrow(src, emit, "doc_id long, line long, shard long").select("shard", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "doc_id", "line", F.lit(None).cast("binary").alias("blob"))
    blobs = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("line"), "blob")
    routed = probes.union(blobs).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").isNull())
    hits = map_arrow(routed, lookup, "doc_id long, line long")
    own, mine = fresh("__id", names), fresh("__gone", names)
    gone = materialize(hits.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("line").alias(mine)), "gone")
    joined = docs.join(gone, docs["doc_id"] == gone[own], "left").select(*(docs[c] for c in names), gone[mine])

    def apply(batches):
        for batch in batches:
            gone_column = batch.column(len(names))
            for i, j, buf, off in K.text_slices(batch.column(where["text"])):
                h, start, _, at = lines(buf, off)
                drop = np.zeros(len(h), bool)
                for r in range(j - i):
                    bad = gone_column[i + r].as_py()
                    if bad:
                        part = slice(at[r], at[r + 1])
                        drop[part] = np.isin(K.as_signed(h[part]), np.array(bad, np.int64))
                yield edit(batch, i, j, buf, off, start, at, drop)

    return map_arrow(joined, apply, schema)


def drop_repeated_lines(docs: DataFrame, **params) -> DataFrame:
    """The columns of ``docs`` after ``dedup_lines``, without the documents that lose all their text.

    Documents that had no text before, null or empty, stay, as do those with a
    null doc_id, whose lines aren't touched; repeated rows and all else are as in
    ``dedup_lines``.
    """
    out = dedup_lines(docs, **params)
    return out.where((F.col("text").isNull()) | (F.col("text") != "") | (F.col(out.columns[-1]) == 0)).select(*docs.columns)
