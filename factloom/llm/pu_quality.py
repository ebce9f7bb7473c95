"""Quality classifier learned from positives and unlabelled text.

Trusted positives are the documents labelled of good quality and not toxic;
everything else is unlabelled web text, a mixture of good and bad.  A linear
model over hashed features minimises the non-negative unbiased risk

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with the logistic loss, where pi is the share of good text.  pi is estimated
first: a positive-against-unlabelled discriminator scores every document of the
corpus, and pi is the least ratio, over score thresholds, of the unlabelled mass
above the threshold to that of held-out positives, each with its confidence bound.

Features of a text: its distinct words, the distinct beginnings of 4 and 5 bytes
of its words, and the cuts reached by its shares of symbols, inner capitals, repeated
words, digits and long words.  Each is weighted by its document-frequency log ratio between the
two samples where that is significant, else by 0.

Document frequencies are counted over every document and every trusted positive,
near copies once.  The fit covers every document too: unlabelled rows are cut by
a hash into shards of about ``max_unlabelled``, each trained in its own task
against the same ``max_positives`` positives, and the weights are averaged.  Only
that sample of labelled rows is bounded.  Negative labels are never used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import map_arrow, materialize
from . import _kernels as K
from .line_dedup import fresh
from .near_dup import signatures

#: Features are named by so many bits of a hash: enough that words of a web corpus don't share a name.
BITS = 40
_HEADS = (4, 5)
_BINS = 1000
#: Near copies share one of so many keys, each of 6 MinHash values: unrelated texts of a large corpus hardly ever do.
_KEYS = 16
#: Features that a task holds before it hands their counts on.
_HELD = 1_000_000
#: Marks of documents: a copy of another one, counted as a positive, in the sample of positives, held out for the prior.
_COPY, _COUNTED, _SAMPLED, _HELD_OUT = 1, 2, 4, 8
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Marks other than those of ordinary sentences, which would weigh too much in short texts.
_SYMBOL = ~(K.ALNUM | ~K.NOT_SPACE)
_SYMBOL[list(b".,;:'\"()-?")] = False
_CUTS = np.array([0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7])


def _share(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def features(column: pa.Array):
    """For each slice of a text column: (first row, end row, feature ids, their offsets by row)."""
    low, low_off = K.text_buffer(column, lower=True)
    raw, raw_off = K.text_buffer(column)
    for i, j in K.slices(low_off):
        off = low_off[i : j + 1] - low_off[i]
        buf = low[low_off[i] : low_off[j]]
        start, end, at = K.runs(buf, off, K.ALNUM)
        word, *heads = K.hash_spans(buf, start, end, *(np.minimum(start + k, end) for k in _HEADS))
        heads = [h + K.U(k) for k, h in zip(_HEADS, heads)]
        n = j - i
        row = np.repeat(np.arange(n), np.diff(at))
        same = np.concatenate([[False], (word[1:] == word[:-1]) & (row[1:] == row[:-1])]) if len(word) else np.zeros(0, bool)
        roff = raw_off[i : j + 1] - raw_off[i]
        rbuf = raw[raw_off[i] : raw_off[j]]
        long_ = (end - start) > 24
        inner = np.zeros(len(rbuf), bool)  # capitals inside words
        inner[1:] = _UPPER[rbuf[1:]] & K.ALNUM[rbuf[:-1]]
        inner[roff[:-1][roff[:-1] < len(rbuf)]] = False
        stats = [_share(_SYMBOL[rbuf], roff), _share(inner, roff), _share(same, at), _share(_DIGIT[rbuf], roff), _share(long_, at)]
        over = [(s[:, None] >= _CUTS).nonzero() for s in stats]  # one feature for each cut that a share reaches
        dense = [c.astype(K.U) + K.U((k + 1) << 40) for k, (_, c) in enumerate(over)]
        ids = np.concatenate([(x >> K.U(64 - BITS)).astype(np.int64) for x in (word, *map(K.mix, heads), *map(K.mix, dense))])
        rows = np.concatenate([row, row, row, *(r for r, _ in over)])
        key = np.sort((rows << BITS) | ids)
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        yield i, j, key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(n + 1))


def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def significant(counts: DataFrame, n_p: int, n_u: int) -> DataFrame:
    """(feature, ratio): log of the document share in positives over that in unlabelled text, where significant.

    ``counts`` has (feature, p, u), the documents of either kind that hold it.
    Unlabelled text holds the positives' mixture, so a true ratio is at most
    1 / pi; larger ones, and the small ones near it, are noise and left out.
    """
    a, b = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    pooled = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = F.abs(a - b) / F.sqrt(pooled * (1 - pooled) * (1 / (n_p + 1) + 1 / (n_u + 1)))
    return counts.select("feature", F.greatest(F.log(a / b), F.lit(-4.0)).alias("ratio"), z.alias("z")).where("z >= 2.5 and ratio <= -0.7").select("feature", "ratio")


def lookup(ids: np.ndarray, live: np.ndarray) -> np.ndarray:
    """The place of each id among the sorted ``live`` ones, or -1."""
    out = np.full(len(ids), -1)
    if len(live):
        maybe = np.zeros(1 << 16, bool)
        maybe[live & 0xFFFF] = True
        k = np.flatnonzero(maybe[ids & 0xFFFF])
        at = np.minimum(np.searchsorted(live, ids[k]), len(live) - 1)
        hit = live[at] == ids[k]
        out[k[hit]] = at[hit]
    return out


def _sub(ids: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = at[rows + 1] - at[rows]
    new = np.concatenate([[0], np.cumsum(size)])
    return ids[np.repeat(at[rows] - new[:-1], size) + np.arange(new[-1])], new


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(risk, its slopes) at the scores of positive and of unlabelled rows.

    The non-negative risk at ``prior``; with 0, that of the plain discriminator of
    positives against unlabelled rows, each side of equal weight.
    """
    # d/ds of log(1 + e^-s) is sigmoid(s) - 1; of log(1 + e^s) it is sigmoid(s)
    gp_pos, gp_neg, gu = (_sigmoid(sp) - 1) / len(sp), _sigmoid(sp) / len(sp), _sigmoid(su) / len(su)
    positive, negative = np.logaddexp(0, -sp).mean(), np.logaddexp(0, su).mean()
    if not prior:
        return positive + negative, gp_pos, gu
    negative -= prior * np.logaddexp(0, sp).mean()
    # max(0, .) has no slope where the estimated negative risk is below 0
    if negative >= 0:
        return prior * positive + negative, prior * gp_pos - prior * gp_neg, gu
    return prior * positive, prior * gp_pos, 0 * gu


def train(ids: np.ndarray, at: np.ndarray, positive: np.ndarray, ratio: np.ndarray, prior: float, epochs: int = 30, rate: float = 0.03, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the ``risk`` at ``prior``.

    Rows are CSR: the places of their features among ``ratio``, from which the
    weights start and to which they are drawn.
    """
    dim, w, b = len(ratio), ratio.copy(), 0.0
    m, v, mb, vb, step = np.zeros(dim), np.zeros(dim), 0.0, 0.0, 0
    w_mean, b_mean, taken = np.zeros(dim), 0.0, 0  # of the second half of the steps
    rng = np.random.default_rng(seed)
    p_rows, u_rows = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(p_rows) or not len(u_rows):
        return w, b
    batches = max(1, len(u_rows) // 2000)
    for _ in range(epochs):
        for ps, us in zip(np.array_split(rng.permutation(p_rows), batches), np.array_split(rng.permutation(u_rows), batches)):
            if not len(ps) or not len(us):
                continue
            pi_, pa_ = _sub(ids, at, ps)
            ui_, ua_ = _sub(ids, at, us)
            _, gp, gv = risk(_sum(w[pi_], pa_) + b, _sum(w[ui_], ua_) + b, prior)
            grad = np.bincount(pi_, np.repeat(gp, np.diff(pa_)), dim) + np.bincount(ui_, np.repeat(gv, np.diff(ua_)), dim) + 1e-3 * (w - ratio)
            gb = gp.sum() + gv.sum()
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            w -= scale * m / (np.sqrt(v) + 1e-8)
            b -= scale * mb / (np.sqrt(vb) + 1e-8)
            if 2 * step > epochs * batches:
                w_mean, b_mean, taken = w_mean + w, b_mean + b, taken + 1
    return (w_mean / taken, b_mean / taken) if taken else (w, b)


def estimate_prior(held: np.ndarray, corpus: np.ndarray) -> float:
    """The share of positives, from histograms of scores: the least upper bound of mass ratios."""
    n_p, n_u = held.sum(), corpus.sum()
    if not n_p or not n_u:
        return 0.5
    above_p, above_u = np.cumsum(held[::-1]) / n_p, np.cumsum(corpus[::-1]) / n_u
    slack = np.sqrt(np.log(40) / (2 * n_u)) + np.sqrt(np.log(40) / (2 * n_p))
    ok = above_p > 0.05
    best = np.argmin(np.where(ok, (above_u + slack) / np.maximum(above_p, 1e-9), np.inf))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


def _bin(score: np.ndarray) -> np.ndarray:
    return np.clip(((np.tanh(score / 20) + 1) / 2 * _BINS).astype(np.int64), 0, _BINS - 1)


def _copies(batches):
    """(rid, doc_id, keys): the keys by which near copies of a text are found; null for texts without words."""
    for batch in batches:
        for i, j, buf, off in K.text_slices(batch.column(2), lower=True):
            h, row = K.shingles(*K.words(buf, off), 3)
            has, keys = np.zeros(j - i, bool), np.zeros(0, np.int64)
            if len(h):
                at = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
                has[row[at]] = True
                sig = signatures(h, at, 6 * _KEYS).reshape(len(at), _KEYS, 6).astype(K.U)
                key = np.broadcast_to(np.arange(_KEYS, dtype=K.U), sig.shape[:2])
                for part in (0, 3):
                    key = K.mix(key ^ K.mix(sig[:, :, part] | (sig[:, :, part + 1] << K.U(16)) | (sig[:, :, part + 2] << K.U(32)) | K.U(1 << 48)))
                keys = K.as_signed(key.reshape(-1))
            off = np.concatenate([[0], np.cumsum(has * _KEYS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(keys), mask=pa.array(~has))
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], names=["rid", "doc_id", "keys"])


def _added(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, place = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return ids, *(np.bincount(place, np.concatenate([x[k] for x in parts]), len(ids)).astype(np.int64) for k in (1, 2))


def _count(stream):
    """(feature, p, u): counted positives and documents other than copies that hold it, added up by task."""
    parts, size = [], 0
    for _, mark, column in stream:
        for i, j, f, at in features(column):
            m = np.repeat(mark[i:j], np.diff(at))
            parts.append(_added([(f, (m & _COUNTED) != 0, (m & _COPY) == 0)]))
            size += len(parts[-1][0])
            if size > _HELD:
                parts = [_added(parts)]
                size = len(parts[0][0])
                if 2 * size > _HELD:
                    yield pa.record_batch([pa.array(x) for x in parts[0]], names=["feature", "p", "u"])
                    parts, size = [], 0
    if parts:
        yield pa.record_batch([pa.array(x) for x in _added(parts)], names=["feature", "p", "u"])


def _csr(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, offsets, marks) of the rows, ordered by rid."""
    rows = rows.sort_by("rid")
    sizes = pc.list_value_length(rows["features"]).to_numpy()
    ids = rows["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), rows["mark"].to_numpy()


class Model:
    """Feature names, their weights and a bias; a score of 0 or more keeps a text."""

    def __init__(self, live: np.ndarray, w: np.ndarray, b: float):
        self.live, self.w, self.b = live, np.append(w, 0.0), float(b)

    def sums(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _sum(self.w[lookup(ids, self.live)], at) + self.b

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for i, j, f, at in features(column):
            out[i:j] = self.sums(f, at)
        return out


def _marked(texts: DataFrame, marks: DataFrame, function, schema: str, max_broadcast: int) -> DataFrame:
    """``function`` of the (rid, mark, texts) of each batch of a task, all that ``marks`` doesn't hold having mark 0.

    Up to ``max_broadcast`` marks are broadcast and looked up where the texts lie; beyond that they are joined.
    """
    if marks.count() > max_broadcast:
        src = texts.join(marks, "rid", "left").select("rid", "text", F.coalesce("mark", F.lit(0)).cast("long").alias("mark"))
        return map_arrow(src, lambda batches: function((b.column(0), b.column(2).to_numpy(), b.column(1)) for b in batches), schema)
    rows = marks.toArrow().sort_by("rid")
    sent = texts.sparkSession.sparkContext.broadcast((rows["rid"].to_numpy(), rows["mark"].to_numpy().astype(np.uint8)))

    def stream(batches):
        rid, mark = sent.value
        for b in batches:
            at = lookup(b.column(0).to_numpy(), rid)
            yield b.column(0), np.where(at >= 0, mark[at] if len(mark) else 0, 0).astype(np.int64), b.column(1)

    return map_arrow(texts.select("rid", "text"), lambda batches: function(stream(batches)), schema)


def _fit_shards(rows: DataFrame, shards: int, positives: tuple[np.ndarray, np.ndarray], ratio: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """(weights, bias): the mean over shards of all unlabelled rows, each trained against the same positives."""
    sent = rows.sparkSession.sparkContext.broadcast((*positives, ratio))

    def one(table):
        p_ids, p_at, ratio = sent.value
        u_ids, u_at, _ = _csr(table)
        positive = np.arange(len(p_at) + len(u_at) - 2) < len(p_at) - 1
        w, b = train(np.concatenate([p_ids, u_ids]), np.concatenate([p_at, p_at[-1] + u_at[1:]]), positive, ratio, prior)
        # whole numbers, so that sums don't depend on the order of the shards
        delta = np.round(np.append(w - ratio, [b, 2.0**-40]) * 2.0**40).astype(np.int64)
        at = np.flatnonzero(delta)
        return pa.table({"place": at, "delta": delta[at]})

    cut = rows.where(F.col("mark").bitwiseAND(_COPY) == 0).withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)))
    found = cut.repartition(shards, "shard").groupBy("shard").applyInArrow(one, "place long, delta long").groupBy("place").agg(F.sum("delta").alias("delta")).toArrow()
    total = np.zeros(len(ratio) + 2, np.int64)
    total[found["place"].to_numpy()] = found["delta"].to_numpy()
    mean = total[:-1] / 2.0**40 / max(total[-1], 1)
    return ratio + mean[:-1], float(mean[-1])


def fit(docs: DataFrame, labels: DataFrame, max_positives: int = 10_000, max_unlabelled: int = 20_000, max_broadcast: int = 8_000_000) -> tuple[Model, float]:
    """(model, estimated share of good text).

    ``max_positives`` bounds the labelled documents of the gradient fit, a fifth of
    which is held out for the prior; ``max_unlabelled`` is the size of the shards
    into which all documents are cut for it.  Features are counted over all.
    """
    names = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    # rows are named and ordered by a hash, so the model doesn't depend on how they lay
    texts = docs.where("doc_id is not null").select(*names).withColumn("rid", F.xxhash64("doc_id", "text"))
    good = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False)).alias("ok")).groupBy("doc_id").agg(F.min("ok").alias("ok")).where("ok")
    part = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000))
    keyed = map_arrow(texts.select("rid", "doc_id", "text"), _copies, "rid long, doc_id long, keys array<long>")
    keyed = materialize(keyed.join(good, "doc_id", "left").select("rid", "doc_id", F.coalesce("ok", F.lit(False)).alias("good"), "keys"), "keys")
    # copies would make the words of a text that was copied often look typical of unlabelled text
    by = Window.partitionBy("key").orderBy("rid")
    seen = keyed.select("rid", "good", F.explode("keys").alias("key")).select("rid", (F.rank().over(by) > 1).alias("u"), (F.col("good") & (F.min(F.when(F.col("good"), F.col("rid"))).over(by) < F.col("rid"))).alias("p"))
    lost = seen.where("u or p").groupBy("rid").agg(F.max("u").alias("u"), F.max("p").alias("p"))
    rows = materialize(keyed.join(lost, "rid", "left").select("rid", "doc_id", F.coalesce("u", F.lit(False)).alias("copy"), (F.col("good") & ~F.coalesce("p", F.lit(False))).alias("positive")), "rows")
    n_u, n_good = rows.agg(F.count_if(~F.col("copy")), F.count_if("positive")).first()
    sampled = F.col("positive") & (part(1) < min(1_000_000, round(1e6 * max_positives / max(n_good, 1))))
    held_out = sampled & (part(2) % 5 == 0)
    bit = lambda is_so, value: F.when(is_so, value).otherwise(0)
    rows = rows.select("rid", (bit(F.col("copy"), _COPY) + bit(F.col("positive") & ~held_out, _COUNTED) + bit(sampled, _SAMPLED) + bit(held_out, _HELD_OUT)).alias("mark"))
    n_p = rows.where(F.col("mark").bitwiseAND(_COUNTED) > 0).count()
    marks = materialize(rows.where("mark > 0").dropDuplicates(["rid"]), "marks")
    counts = _marked(texts, marks, _count, "feature long, p long, u long", max_broadcast).groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    found = significant(counts, n_p, n_u).toArrow().sort_by("feature")
    live, ratio = found["feature"].to_numpy(), found["ratio"].to_numpy().copy()
    sent_live = docs.sparkSession.sparkContext.broadcast(live)

    def places(stream):
        for rid, mark, column in stream:
            for i, j, f, at in features(column):
                where = lookup(f, sent_live.value)
                off = np.concatenate([[0], np.cumsum(where >= 0)])[at]
                yield pa.record_batch([rid.slice(i, j - i), pa.array(mark[i:j]), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(where[where >= 0], pa.int32()))], names=["rid", "mark", "features"])

    rows = materialize(_marked(texts, marks, places, "rid long, mark long, features array<int>", max_broadcast), "features")
    # the bound on positives makes this side small at every scale
    ids, at, mark = _csr(rows.where(F.col("mark").bitwiseAND(_SAMPLED) > 0).toArrow())
    out = (mark & _HELD_OUT) != 0
    shards = max(1, -(-n_u // max_unlabelled))

    # the discriminator, and the histograms of its scores of held-out positives and of all documents
    w, b = _fit_shards(rows, shards, _sub(ids, at, np.flatnonzero(~out)), ratio, 0.0)
    h_ids, h_at = _sub(ids, at, np.flatnonzero(out))
    held = np.bincount(_bin(_sum(w[h_ids], h_at) + b), minlength=_BINS)
    sent = docs.sparkSession.sparkContext.broadcast((w, b))

    def histogram(batches):
        total = np.zeros(_BINS, np.int64)
        w, b = sent.value
        for batch in batches:
            size = pc.list_value_length(batch.column(0)).to_numpy()
            score = _sum(w[batch.column(0).flatten().to_numpy()], np.concatenate([[0], np.cumsum(size)])) + b
            total += np.bincount(_bin(score), minlength=_BINS)
        k = np.flatnonzero(total)
        yield pa.record_batch([pa.array(k), pa.array(total[k])], names=["bin", "n"])

    corpus = np.zeros(_BINS, np.int64)
    for r in map_arrow(rows.select("features"), histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        corpus[r.bin] = r.n
    prior = estimate_prior(held, corpus)
    # positives that were held out for the prior join the final fit
    return Model(live, *_fit_shards(rows, shards, (ids, at), ratio, prior)), prior


def keep_good(docs: DataFrame, labels: DataFrame, with_score: bool = False, **params) -> DataFrame:
    """The documents that the classifier keeps, all columns as they are.

    With ``with_score``, __score is appended (behind underscores, where docs has a
    column of that name): the log-odds, 0 or more for kept ones.  ``params`` are those of ``fit``.  Null and empty texts have the score of a text without words.  Rows are
    judged one by one, so those that repeat a doc_id are kept or dropped by their
    own text; a null doc_id doesn't matter.  Labels may repeat a doc_id: it is
    trusted if all its rows are good.  Nulls count as quality 0 and toxic 0.
    Without any positive or any document nothing can be learned, and all are
    kept.  Texts of any length are read whole.
    """
    spark = docs.sparkSession
    model, prior = fit(docs, labels, **params)
    names = docs.columns
    score_name = fresh("__score", names)
    if not model.w.any():
        return docs.withColumn(score_name, F.lit(0.0)) if with_score else docs
    sent = spark.sparkContext.broadcast(model)
    at = names.index("text")

    def run(batches):
        for batch in batches:
            score = sent.value.scores(pc.cast(batch.column(at), pa.string()))
            take = pa.array(np.flatnonzero(score >= 0))
            columns = [c.take(take) for c in batch.columns]
            if with_score:
                columns.append(pa.array(score).take(take))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, score_name] if with_score else names)

    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    return map_arrow(docs, run, T.StructType([*fields, T.StructField(score_name, T.DoubleType())] if with_score else fields))
