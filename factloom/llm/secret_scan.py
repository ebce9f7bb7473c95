"""Secret scans by character Markov models.

Candidate tokens are maximal runs of letters, digits, ``_ - + /`` of at least
``min_length`` characters.  All else ends a token, ``=`` and ``.`` too, so what
follows a name and a sign is a token of its own, and so is each part of a dotted
one.  Two second-order Markov models over these characters
are trained from labelled samples, one on random strings (keys, hashes, tokens)
and one on ordinary identifiers and words.  A token is a secret when the log of
its likelihood ratio exceeds ``threshold``, the log prior odds against secrets.
Where a whole token doesn't, its best-scoring stretches of at least ``min_length``
characters that do are secrets: those inside paths and behind prefixes.
The scan runs once over the documents, without a shuffle; the model is two small
tables of a fixed size.
"""

from __future__ import annotations

import base64
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import map_arrow
from . import _kernels as K

CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/"
_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(CHARS, np.uint8)] = np.arange(len(CHARS))
_TOKEN = _CODE >= 0
_A = len(CHARS) + 1  # the last code stands for the start
RESULT = "doc_id long, start int, length int, preview string, score double"

_WORDS = """get set add remove update delete create find load save read write open close start stop run build make parse format
user name value key index count size list map table row column file path data text string number type class object item node
tree graph edge vertex parent child root leaf head tail first last next previous current total average maximum minimum
request response server client session token cookie header body message event handler listener callback promise future
account customer order product invoice payment address street city country language license version release public private
static final abstract interface implementation exception error warning message information configuration environment
development production document paragraph sentence word letter character encoding decoding compression encryption
the and for with that this from have which their there would about other could into than them these some when
der die und das nicht eine einen werden auf sich haben dass wurde sind auch nach schule kinder freundschaft geschwindigkeit
le la les des une est dans pour que qui sur avec pas plus mais entreprise gouvernement quelquefois longtemps aujourd
el los las una por para con como pero sus este entre desde cuando trabajo nacional gobierno desarrollo conocimiento
ing tion ment able less ness ful ous ive ance ence er or ist ism ity ly ed en re un in dis pre anti inter over under
eau eaux eux aux oui ai oi ou que qui tre ier ment elle eur age ique aire eille oir ette euse ain ein un on en an
cion mente ado ido oso ero ista dad aje que gui rre lla ñe ia ie ue ui
schaft keit heit ung lich isch bar sam ver zer ent ge be auf aus ein vor nach tz pf sch ch st""".split()


_SHORT = """abc api app asm avx aws bin bit bz cdn cfg cjk cls cmd cpp cpu crc css csv ctx dbg dev dir dll dns doc dtd err etc exe ext ffi fmt fs ftp
gcc git gnu gpu gz html http ios ip iso jis jpg js json lib lin log lzma md mod mp net ns obj opt os pdf php png posix proc pty py python rb rpc
rsa sh sha sql src ssl str sub sys tar tcp tls tmp txt udp ui uri url usb utf uuid var vm win xhtml xml xz yml zip zlib""".split()


def labelled_samples(n: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """Strings with label 1 for random secrets and 0 for ordinary identifiers, ``n`` of each."""
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", CHARS[:62].decode()]
    out = []
    for k in range(n):
        length = rng.randint(16, 64)
        kind = k % 7
        if kind < 5:
            out.append(("".join(rng.choice(alphabets[kind]) for _ in range(length)), 1))
        elif kind == 5:
            out.append((base64.b64encode(rng.randbytes(length)).decode().rstrip("="), 1))
        else:
            out.append((base64.urlsafe_b64encode(rng.randbytes(length)).decode().rstrip("="), 1))
    digits = lambda low, high: "".join(str(rng.randint(0, 9)) for _ in range(rng.randint(low, high)))
    # short names with digits, as of encodings, machines and versions
    mixed = lambda: rng.choice((f"{rng.choice(_SHORT)}{digits(1, 3)}", f"{rng.choice(_SHORT)}{digits(1, 2)}{rng.choice(_SHORT)}", digits(1, 3), rng.choice(_SHORT), rng.choice(_WORDS)))
    for k in range(n):
        words = [rng.choice(_WORDS) for _ in range(rng.randint(2, 7))]
        style = k % 17
        if style == 0:
            text = "_".join(words)
        elif style == 1:
            text = "-".join(words)
        elif style == 2:
            text = words[0] + "".join(w.title() for w in words[1:])
        elif style == 3:
            text = "_".join(words).upper()
        elif style == 4:
            text = "/".join(words)
        elif style == 5:
            text = "_".join(words) + str(rng.randint(0, 2030))
        elif style == 6:
            text = digits(10, 24)  # numbers and times
        elif style == 9:
            text = rng.choice(CHARS.decode()) * rng.randint(3, 30)  # rulers and blanks
        elif style == 10:
            text = "/" + "/".join(mixed() for _ in range(rng.randint(3, 7)))
        elif style in (11, 12):
            text = rng.choice("_-").join(mixed() for _ in range(rng.randint(3, 6)))
            text = text.upper() if style == 12 else text
        elif style == 13:
            text = rng.choice("_-+/").join(digits(1, 6) for _ in range(rng.randint(3, 6))) + rng.choice(("", f"e{rng.choice('+-')}{digits(1, 2)}"))
        elif style == 14:
            run = rng.choice((CHARS[:26], CHARS[26:52], CHARS[52:62], CHARS[52:62] + CHARS[:26], CHARS[52:62] + CHARS[26:52])).decode()
            text = run[rng.randint(0, len(run) // 2) :]  # letters in their order
        elif style == 15:
            text = rng.choice("_-/").join(w if rng.random() < 0.5 else rng.choice(_SHORT) for w in words)
        elif style == 16:
            text = "".join(rng.choice((w.title(), rng.choice(_SHORT).upper())) for w in words)
        else:
            text = "".join(words)
            text = {7: text.title(), 8: text.upper()}.get(style, text)
        out.append((text, 0))
    return out


def train(samples: list[tuple[str, int]], smoothing: float = 0.05) -> np.ndarray:
    """table[a, b, c] = log P(c | a, b; random) - log P(c | a, b; ordinary).

    Trigram counts back off to bigram and unigram ones, so an unseen context
    isn't decisive.  Samples with characters outside the alphabet are cut there.
    Values are multiples of 2**-20, so that sums of them are exact in any order.
    """
    logs = []
    for label in (1, 0):
        one, two, three = np.zeros(_A), np.zeros((_A, _A)), np.zeros((_A, _A, _A))
        for text, y in samples:
            if y != label:
                continue
            code = _CODE[np.frombuffer(text.encode(), np.uint8)]
            code = np.concatenate([[_A - 1, _A - 1], code[: np.argmax(code < 0)] if (code < 0).any() else code])
            np.add.at(one, code[2:], 1)
            np.add.at(two, (code[1:-1], code[2:]), 1)
            np.add.at(three, (code[:-2], code[1:-1], code[2:]), 1)
        p1 = (one + smoothing) / (one + smoothing).sum()
        p2 = (two + 4 * p1) / (two.sum(-1, keepdims=True) + 4)
        p3 = (three + 4 * p2) / (three.sum(-1, keepdims=True) + 4)
        logs.append(np.log(p3))
    return np.round((logs[0] - logs[1]) * 2.0**20) / 2.0**20


def score_text(table: np.ndarray, token: str) -> float:
    """The log-likelihood ratio of one token, character by character."""
    a = b = _A - 1
    total = 0.0
    for ch in token.encode():
        c = int(_CODE[ch])
        total += float(table[a, b, c])
        a, b = b, c
    return total


def stretches(ratio: np.ndarray, base: np.ndarray, min_length: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in ``ratio`` of the secrets of each token [base[k], base[k + 1]).

    A token that scores above the threshold is taken whole.  Of another one the
    stretch of the greatest sum is taken if that is above it, and what is left on
    either side is searched again.
    """
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    s, e = base[:-1], base[1:]
    whole = np.round(total[e] - total[s], 4) > threshold
    starts, ends = [s[whole]], [e[whole]]
    s, e = s[~whole], e[~whole]
    while True:
        fits = e - s >= min_length
        s, e = s[fits], e[fits]
        if not len(s):
            break
        n = e - s - min_length + 1  # places where a stretch may begin, or end
        at = np.concatenate([[0], np.cumsum(n)])
        token = np.repeat(np.arange(len(s)), n)
        begin = np.arange(at[-1]) - at[token] + s[token]
        sums = total[begin] - total[s[token]]
        drop = np.ptp(sums) + 1
        # each token lies below all before it, so the running minimum starts anew
        low = np.minimum.accumulate(sums - token * drop) + token * drop
        gain = total[begin + min_length] - total[s[token]] - low
        best = np.maximum.reduceat(gain, at[:-1])
        hit = np.flatnonzero(best > threshold)
        if not len(hit):
            break
        left, right, upto, from_ = [], [], [], []
        for k in hit:
            i, j = at[k], at[k + 1]
            last = i + int(np.argmax(gain[i:j]))
            first = i + int(np.argmin(sums[i : last + 1]))
            a, b = begin[first], begin[last] + min_length
            if round(total[b] - total[a], 4) > threshold:
                left.append(a)
                right.append(b)
                upto += [s[k], b]
                from_ += [a, e[k]]
        starts.append(np.array(left, np.int64))
        ends.append(np.array(right, np.int64))
        s, e = np.array(upto, np.int64), np.array(from_, np.int64)
    s, e = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(s)
    return s[order], e[order]


def samples_of(labelled: DataFrame, max_samples: int = 200_000) -> list[tuple[str, int]]:
    """The rows (text, label) of a table of labelled strings, 1 for secrets and 0 for ordinary ones.

    Of more than ``max_samples`` rows a sample by hash is taken.  Rows with a null
    are left out, repeated rows count as often as they occur.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label")).where("text is not null and label is not null")
    share = max_samples / max(rows.count(), 1)
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1_000_000)) < round(share * 1_000_000))
    return sorted((r.text, r.label) for r in rows.toLocalIterator())


def find_secrets(docs: DataFrame, samples: list[tuple[str, int]] | DataFrame | None = None, min_length: int = 16, threshold: float = 12.0) -> DataFrame:
    """(doc_id, start, length, preview, score): every token, or stretch of one, that scores as a secret.

    The models are trained from ``samples``, pairs of a string and its label or a
    table of them (``samples_of``); without any, from ``labelled_samples``.  A score
    that only equals the threshold is no secret; of stretches of equal score the
    one that ends first is taken, and it starts as early as that score allows.

    start and length count characters; preview is the first four characters, so
    the result doesn't spread the secret; score is rounded to 4 places.  Null and
    empty texts have none; rows with a null doc_id are reported under it; every
    row is scanned, so repeated rows repeat their findings.  Texts and tokens of
    any length are scored whole; other columns are ignored; an empty table gives
    an empty result.
    """
    if isinstance(samples, DataFrame):
        samples = samples_of(samples)
    table = train(samples if samples is not None else labelled_samples())
    sent = docs.sparkSession.sparkContext.broadcast(table.astype(np.float64))

    def run(batches):
        table = sent.value
        for batch in batches:
            ids = batch.column(0)
            for i, j, buf, off in K.text_slices(batch.column(1)):
                start, end, at = K.runs(buf, off, _TOKEN)
                long_ = np.flatnonzero(end - start >= min_length)
                if not len(long_):
                    continue
                row = np.searchsorted(at, long_, "right") - 1
                s, e = start[long_], end[long_]
                size = e - s
                base = np.concatenate([[0], np.cumsum(size)])
                place = np.arange(base[-1]) - np.repeat(base[:-1], size)
                code = _CODE[buf[np.repeat(s, size) + place]]
                b = np.where(place >= 1, np.roll(code, 1), _A - 1)
                a = np.where(place >= 2, np.roll(code, 2), _A - 1)
                ratio = table[a, b, code]
                total = np.concatenate([[0.0], np.cumsum(ratio)])
                first, last = stretches(ratio, base, min_length, threshold)
                if not len(first):
                    continue
                score = np.round(total[last] - total[first], 4)
                hit = np.searchsorted(base, first, "right") - 1
                char = np.cumsum((buf & 0xC0) != 0x80)  # characters up to each byte
                char = np.concatenate([[0], char])
                r, s = row[hit], s[hit] + first - base[hit]
                e = s + last - first
                preview = [buf[x : x + 4].tobytes().decode() for x in s]
                yield pa.record_batch([ids.slice(i, j - i).take(pa.array(r)), pa.array((char[s] - char[off[r]]).astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.array(preview), pa.array(score)], names=["doc_id", "start", "length", "preview", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(src, run, RESULT)
