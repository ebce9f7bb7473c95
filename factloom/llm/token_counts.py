"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a white-space delimited word behind the word mark.  Its best
segmentation under a unigram model is the one of greatest total score; the best
score of a prefix depends on the prefix alone, so all words that begin alike
share it.  Each task inserts its distinct pre-tokens in a trie and computes the
forward score of every node once, level by level for all nodes of a depth
together; the nodes where words end store the token count.  What a word has
beyond ``_DEEP`` bytes it hardly shares with another: it goes on from the stored
scores on its own.  Documents then add up the counts of their words, and no word
travels: there is no shuffle.

A task keeps the counts of words it has seen (up to ``remember`` of them, then
it starts anew), so only new words enter a trie.

The vocabulary comes from a public tokenizer file and isn't trained.  The file
ranks its pieces; the score of rank r is that of Zipf's law, -log(r + 10), up to
a constant.  A character that no piece covers costs ``UNKNOWN`` and counts as
many tokens as it has UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import map_arrow
from . import _kernels as K

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = -30.0
_MARK = "▁".encode()
#: Bytes of a word that enter the trie.
_DEEP = 256


def read_pieces(path: str) -> dict[bytes, float]:
    """The ordinary pieces of a vocabulary file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = np.log(sum(1 / (r + 10) for r in range(len(ids))))
    return {model.id_to_piece(i).encode(): float(-np.log(r + 10) - norm) for r, i in enumerate(ids)}


def segment(word: bytes, pieces: dict[bytes, float], longest: int, known: list[tuple[float, int]] | None = None) -> tuple[float, int]:
    """(score, tokens) of the best segmentation of one pre-token; ties go to fewer tokens.

    ``known`` has (score, -tokens) of its first prefixes, that of no byte first.
    """
    n = len(word)
    best = known or [(0.0, 0)]
    done = len(best)
    best = best + [(-np.inf, 0)] * (n + 1 - done)
    for d in range(done, n + 1):
        if d < n and word[d] & 0xC0 == 0x80:
            continue
        found = (-np.inf, 0)
        back = d - 1
        while back > 0 and word[back] & 0xC0 == 0x80:
            back -= 1
        if best[back][0] > -np.inf:
            found = (best[back][0] + UNKNOWN, best[back][1] - (d - back))
        for length in range(1, min(longest, d) + 1):
            s = pieces.get(word[d - length : d])
            if s is not None and best[d - length][0] > -np.inf:
                found = max(found, (best[d - length][0] + s, best[d - length][1] - 1))
        best[d] = found
    return best[n][0], -best[n][1]


class Vocabulary:
    """Pieces in hash tables that are probed for arrays of hashes at once."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.lengths = sorted({len(p) for p in pieces})
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.hash = K.Prefix(joined).hash(at[:-1], at[1:])
        self.score = np.fromiter(pieces.values(), float)
        order = np.argsort(self.hash)
        self.hash, self.score = self.hash[order], self.score[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.hash >> K.U(42)).astype(np.int64)] = True

    def scores(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -np.inf)
        k = np.flatnonzero(self.maybe[(h >> K.U(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[k]), len(self.hash) - 1)
        hit = self.hash[at] == h[k]
        out[k[hit]] = self.score[at[hit]]
        return out

    def counts(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The token count of each distinct word [start, end), through one trie."""
        out = np.zeros(len(start), np.int32)
        if not len(start):
            return out
        # the part in the trie ends where a character ends
        size = np.minimum(end - start, _DEEP)
        for _ in range(3):
            inside = np.flatnonzero(start + size < end)
            size[inside] -= (buf[(start + size)[inside]] & 0xC0) == 0x80
        short = np.argsort(-size, kind="stable")
        m = len(_MARK)
        length = size[short] + m
        base = np.concatenate([[0], np.cumsum(length)])
        text = np.empty(base[-1], np.uint8)
        for k in range(m):
            text[base[:-1] + k] = _MARK[k]
        place = np.arange(base[-1]) - np.repeat(base[:-1], length)
        body = place >= m
        text[body] = buf[np.repeat(start[short] - m, length)[body] + place[body]]
        sums = K.Prefix(text)
        base = base[:-1]
        node = [np.zeros(len(short), np.int64)]  # node of each word at each depth, longest words first
        score, count = [np.zeros(1)], [np.zeros(1, np.int32)]
        for d in range(1, int(length[0]) + 1):
            alive = int(np.searchsorted(-length, -d, "right"))
            _, rep, mine = np.unique(sums.hash(base[:alive], base[:alive] + d), return_index=True, return_inverse=True)
            node.append(mine)
            best, tokens = np.full(len(rep), -np.inf), np.zeros(len(rep), np.int32)
            pos = base[rep] + d
            # inside a character nothing ends
            cut = (d == length[rep]) | ((text[np.minimum(pos, len(text) - 1)] & 0xC0) != 0x80)
            live = np.flatnonzero(cut)
            if len(live):
                word, p = rep[live], pos[live]
                b, t = np.full(len(live), -np.inf), np.zeros(len(live), np.int32)
                # a character without a piece of its own
                chars = np.ones(len(live), np.int64)
                for w in range(1, 4):
                    chars = np.where((chars == w) & (d > w) & ((text[np.maximum(p - w, 0)] & 0xC0) == 0x80), w + 1, chars)
                for w in np.unique(chars):
                    if w <= d:
                        k = np.flatnonzero(chars == w)
                        up = node[d - w][word[k]]
                        b[k], t[k] = score[d - w][up] + UNKNOWN, count[d - w][up] + w
                for n in self.lengths:
                    if n > d:
                        break
                    up = node[d - n][word]
                    before = score[d - n][up]
                    s = self.scores(sums.hash(p - n, p)) + before
                    c = count[d - n][up] + 1
                    better = (s > b) | ((s == b) & (c < t) & (s > -np.inf))
                    b, t = np.where(better, s, b), np.where(better, c, t)
                best[live], tokens[live] = b, t
            score.append(best)
            count.append(tokens)
            ends = np.flatnonzero(length[:alive] == d)
            out[short[ends]] = tokens[mine[ends]]
        for k in np.flatnonzero(start[short] + size[short] < end[short]):
            known = [(float(score[d][node[d][k]]), -int(count[d][node[d][k]])) for d in range(length[k] + 1)]
            w = short[k]
            out[w] = segment(_MARK + buf[start[w] : end[w]].tobytes(), self.pieces, self.longest, known)[1]
        return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, remember: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, n_tokens), a row for each document row.

    Words are runs of characters other than blank, tab, line feed and carriage
    return.  Null and empty texts have 0 words and 0 tokens; a null or repeated
    doc_id is passed on; texts and words of any length are counted whole; of
    segmentations of equal score the one of fewest tokens counts; other columns
    are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_pieces(vocabulary)))

    def run(batches):
        vocabulary = sent.value
        known, counts = np.zeros(0, K.U), np.zeros(0, np.int32)
        for batch in batches:
            ids = batch.column(0)
            for i, j, buf, off in K.text_slices(batch.column(1)):
                start, end, at = K.runs(buf, off, K.NOT_SPACE)
                h = K.hash_spans(buf, start, end)[0]
                distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                where = np.searchsorted(known, distinct)
                old = where < len(known)
                old[old] = known[where[old]] == distinct[old]
                count = np.zeros(len(distinct), np.int32)
                count[old] = counts[where[old]]
                new = np.flatnonzero(~old)
                if len(new):
                    count[new] = vocabulary.counts(buf, start[first[new]], end[first[new]])
                    if len(known) + len(new) > remember:
                        known, counts = np.zeros(0, K.U), np.zeros(0, np.int32)
                        where = np.zeros(len(distinct), np.int64)
                    known = np.insert(known, where[new], distinct[new])
                    counts = np.insert(counts, where[new], count[new])
                total = np.concatenate([[0], np.cumsum(count[inverse], dtype=np.int64)])
                yield pa.record_batch([ids.slice(i, j - i), pa.array(np.diff(at).astype(np.int64)), pa.array(total[at[1:]] - total[at[:-1]])], names=["doc_id", "n_words", "n_tokens"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(src, run, "doc_id long, n_words long, n_tokens long")
