"""Long repeated passages by recompression.

Each document is a sequence of word names.  Rounds replace, all over the corpus,
maximal runs of a symbol and then pairs of neighbouring symbols by new symbols.
A pair is merged when the first symbol's name puts it in the left class of the
round and the second's in the right class, so pairs can't overlap and a merge
depends on the two names alone.  New names are fingerprints of what they stand
for: they are the same wherever the same words are, in every task, without a
table of names.  So equal passages get equal symbols in their interior, and only
a few symbols at their ends depend on what surrounds them.

1. One scan emits high-level symbols with their document: of those left after the
   rounds the ones of 4 words or more (ten on average), and where more than a
   symbol's greatest length has none of these, the shorter ones there, so that no
   stretch of text is without any.  Spark finds those of two or more documents.
2. A second scan parses again and takes every place of a shared symbol.  Around
   it, each window of ``min_words`` words that contains the symbol is emitted by
   its fingerprint.  Spark keeps the windows that occur in two or more documents:
   that is the exact verification, of all partners at once, with no cap.  Windows
   that a task itself has seen in two documents are verified there; of each, one
   row goes on to the others, so a passage of very many documents is a few rows a
   task where its windows meet.
3. The kept windows of a document are joined into maximal spans.

The shared symbols are broadcast up to ``max_broadcast`` of them.  Beyond that
their places are joined in Spark and meet the texts of their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import map_arrow, materialize
from . import _kernels as K

MIN_WORDS, ROUNDS, LONGEST, LEAST = 50, 8, 16, 4
#: Windows that a task holds before it verifies and hands them on.
_HELD = 1_000_000


def parse(names: np.ndarray, at: np.ndarray, rounds: int, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, first word, row) of the symbols left after the rounds; a symbol ends where the next begins.

    No symbol covers more than ``longest`` words: longer merges don't happen, and
    a longer run is cut into equal symbols and a rest.  How many words a symbol
    covers is settled by its name, so this too depends on names alone.
    """
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.arange(len(names))
    total = len(names)
    for r in range(rounds):
        if not len(names):
            break
        size = np.diff(np.append(start, total))
        # runs: neighbours of one name in one row become a symbol of name and count
        new = np.concatenate([[True], (names[1:] != names[:-1]) | (row[1:] != row[:-1])])
        if not new.all():
            first = np.flatnonzero(new)
            place = np.arange(len(names)) - np.repeat(first, np.diff(np.append(first, len(names))))
            first = np.flatnonzero(place % np.maximum(longest // size, 1) == 0)
            count = np.diff(np.append(first, len(names)))
            run = names[first]
            many = count > 1
            run[many] = K.mix(run[many] + count[many].astype(K.U) * K.U(0xD1342543DE82EF95))
            names, start, row, size = run, start[first], row[first], size[first] * count
        # pairs: a left symbol before a right one of the same row
        left = (K.mix(names + K.U(2 * r + 1)) & K.U(1)) == 0
        k = np.flatnonzero(left[:-1] & ~left[1:] & (row[1:] == row[:-1]) & (size[1:] + size[:-1] <= longest))
        names = names.copy()
        names[k] = K.mix(names[k] * K.U(0x9E3779B97F4A7C15) + names[k + 1] + K.U(r + 1))
        keep = np.ones(len(names), bool)
        keep[k + 1] = False
        names, start, row = names[keep], start[keep], row[keep]
    return names, start, row


def revealing(start: np.ndarray, row: np.ndarray, at: np.ndarray, longest: int) -> np.ndarray:
    """The places of the symbols to compare: those of a quarter of ``longest`` words, and all in gaps between such of over ``longest`` words."""
    end = np.append(start[1:], at[-1])
    high = end - start >= max(longest // LEAST, 1)
    before = np.maximum(np.maximum.accumulate(np.where(high, end, 0)), at[row])
    after = np.minimum(np.minimum.accumulate(np.where(high, start, at[-1])[::-1])[::-1], at[row + 1])
    return np.flatnonzero(high | (after - before > longest))


def _parsed(column: pa.Array, rounds: int, n: int):
    """For each slice of a text column: (first row, end row, words, their offsets by row, symbol names, starts, ends, rows)."""
    longest = max(1, min(LONGEST, n // 3))
    for i, j, buf, off in K.text_slices(column, lower=True):
        word, at = K.words(buf, off)
        if not len(word):
            continue
        name, start, row = parse(word, at, rounds, longest)
        end = np.append(start[1:], len(word))
        k = revealing(start, row, at, longest)
        k = k[np.diff(at)[row[k]] >= n]  # shorter texts have no window
        if len(k):
            yield i, j, word, at, name[k], start[k], end[k], row[k]


def _symbols(docs: DataFrame, rounds: int, n: int) -> DataFrame:
    """(symbol, doc_id, first, size): the symbols to compare."""

    def run(batches):
        for batch in batches:
            for i, j, _, at, name, start, end, row in _parsed(batch.column(1), rounds, n):
                yield pa.record_batch([pa.array(K.as_signed(name)), batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array((start - at[row]).astype(np.int32)), pa.array((end - start).astype(np.int32))], names=["symbol", "doc_id", "first", "size"])

    return map_arrow(docs, run, "symbol long, doc_id long, first int, size int")


def _covering(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the window starts s, low <= s and s + n <= high, that cover [start, end)."""
    a, b = np.maximum(low, end - n), np.minimum(start, high - n)
    ok = a <= b
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, a[ok], 1)
    np.add.at(edge, b[ok] + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _emit_windows(word, at, start, end, row, n):
    """(hash, row, window's first word in the row) around the symbols [start, end)."""
    mask = _covering(start, end, at[row], at[row + 1], n, max(len(word), 1))
    h, r = K.windows(word, at, n)
    counts = np.diff(at)
    per = np.maximum(counts - n + 1, 0)
    position = np.arange(len(h)) - np.repeat(np.cumsum(per) - per, per)
    ok = mask[at[r] + position]
    return h[ok], r[ok], position[ok]


WINDOW = "window long, doc_id long, first int, shared boolean"


def _verified(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The rows of windows, those of two documents marked as shared.

    Their places get a key of their own each, as they need no partner any more;
    one row without a place tells other tasks that the window is shared.
    """
    h, doc, first = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h, kind="stable")
    h, doc, first = h[order], doc[order], first[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    many = np.minimum.reduceat(doc, new) < np.maximum.reduceat(doc, new)
    shared = np.repeat(many, np.diff(np.append(new, len(h))))
    own = K.mix(doc.view(K.U) * K.U(0x9E3779B97F4A7C15) + first.astype(K.U))
    told = new[many]
    columns = [np.concatenate([np.where(shared, own, h), h[told]]), np.concatenate([doc, doc[told]]), np.concatenate([first, np.full(len(told), -1)]), np.concatenate([shared, np.ones(len(told), bool)])]
    return pa.record_batch([pa.array(K.as_signed(columns[0])), pa.array(columns[1]), pa.array(columns[2].astype(np.int32)), pa.array(columns[3])], names=["window", "doc_id", "first", "shared"])


def _verify_as_they_come(found):
    """Batches of ``_verified`` rows from (hash, doc_id, first) arrays."""
    parts, size = [], 0
    for part in found:
        parts.append(part)
        size += len(part[0])
        if size > _HELD:
            yield _verified(parts)
            parts, size = [], 0
    if size:
        yield _verified(parts)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, rounds: int = ROUNDS, max_broadcast: int = 8_000_000) -> DataFrame:
    """(doc_id, first_word, n_words): maximal spans of each document all of whose
    ``min_words``-word windows occur in another document too and hold a symbol
    that reveals them.  No other spans are reported; what this misses is in README.

    Words are lower-cased runs of letters and digits, counted from 0.  Spans that
    overlap or touch are one.  Repeats inside a single document don't count.
    Null and empty texts, and those of fewer words, have no spans; rows with a
    null doc_id are ignored; rows that share a doc_id are parts of one document,
    whose spans are merged as if each started at word 0.  Very long texts are
    read whole; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = min_words

    symbols = _symbols(src, rounds, n)
    shared = symbols.groupBy("symbol").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("symbol")
    shared = materialize(shared, "shared")
    count = shared.count()
    if count <= max_broadcast:
        sent = spark.sparkContext.broadcast(np.sort(shared.toArrow()["symbol"].to_numpy().view(K.U)))

        def run(batches):
            known = sent.value
            if not len(known):
                return
            filter_ = np.zeros(1 << 24, bool)
            filter_[(known >> K.U(40)).astype(np.int64)] = True

            def found():
                for batch in batches:
                    ids = batch.column(0).to_numpy()
                    for i, j, word, at, name, start, end, row in _parsed(batch.column(1), rounds, n):
                        maybe = np.flatnonzero(filter_[(name >> K.U(40)).astype(np.int64)])
                        where = np.minimum(np.searchsorted(known, name[maybe]), len(known) - 1)
                        hit = maybe[known[where] == name[maybe]]
                        h, r, position = _emit_windows(word, at, start[hit], end[hit], row[hit], n)
                        yield h, ids[i:j][r], position

            yield from _verify_as_they_come(found())

        windows = map_arrow(src, run, WINDOW)
    else:
        places = symbols.join(shared, "symbol", "left_semi").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("first").alias("__first"), F.collect_list("size").alias("__size"))
        joined = src.join(places, src["doc_id"] == places["__id"]).select("doc_id", "text", "__first", "__size")

        def run(batches):
            def found():
                for batch in batches:
                    ids = batch.column(0).to_numpy()
                    for i, j, buf, off in K.text_slices(batch.column(1), lower=True):
                        word, at = K.words(buf, off)
                        first, size = batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i)
                        row = np.repeat(np.arange(j - i), pc.list_value_length(first).to_numpy())
                        start = at[row] + first.flatten().to_numpy(zero_copy_only=False)
                        end = start + size.flatten().to_numpy(zero_copy_only=False)
                        fits = end <= at[row + 1]
                        h, r, position = _emit_windows(word, at, start[fits], end[fits], row[fits], n)
                        yield h, ids[i:j][r], position

            yield from _verify_as_they_come(found())

        windows = map_arrow(joined, run, WINDOW)
    by = Window.partitionBy("window")
    kept = windows.withColumns({"low": F.min("doc_id").over(by), "high": F.max("doc_id").over(by), "any": F.max("shared").over(by)}).where("first >= 0 and (any or low < high)").select("doc_id", "first")
    starts = kept.groupBy("doc_id").agg(F.collect_list("first").alias("firsts"))

    def spans(batches):
        for batch in batches:
            out_id, out_first, out_n = [], [], []
            for k in range(batch.num_rows):
                s = np.unique(batch.column(1)[k].values.to_numpy())
                new = np.concatenate([[True], s[1:] > s[:-1] + n])
                a = s[new]
                b = s[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)] + n
                out_id += [batch.column(0)[k].as_py()] * len(a)
                out_first.append(a)
                out_n.append(b - a)
            if out_id:
                yield pa.record_batch([pa.array(out_id, pa.int64()), pa.array(np.concatenate(out_first).astype(np.int32)), pa.array(np.concatenate(out_n).astype(np.int32))], names=["doc_id", "first_word", "n_words"])

    return map_arrow(starts, spans, "doc_id long, first_word int, n_words int")
