"""Best-fit packing by bin completion branch and bound.

Documents longer than a bin are cut into full bins and a rest, so that every
piece fits.  Documents are dealt to groups by a hash of their id, their tokens and
their number among equals, so that neither a null id nor a repeated one makes a
large group; groups are solved independently, so the work is linear and no group
outgrows a task.  A group ends with at most one bin more than its share of a
packing without groups would have, one in some 500.

A group is packed by best-fit decreasing first, which is the incumbent.  Bin
completion then searches for fewer bins: it takes the largest piece left, lists
the fillings around it that no other filling dominates, fullest first, and
branches on them.  A node is pruned when its waste so far, with that which can't
be avoided, leaves no room for a solution with fewer bins than the incumbent.
The search ends at the lower bound, or after ``nodes`` fillings of a group, with
the incumbent: every piece is always packed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import map_arrow, materialize

CAPACITY = 2048
NODES = 2000
RESULT = "group_id long, bin_id long, slot int, doc_id long, piece int, start_token long, n_tokens int"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of indices; ``sizes`` descend."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r is set where a bin with r left exists
    bins: list[list[int]] = []
    for k, s in enumerate(sizes):
        fits = free >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        room[r - s].append(b)
        free |= 1 << (r - s)
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Martello and Toth's L2: the best over thresholds of bins that large pieces force."""
    arr = np.sort(np.asarray(sizes, np.int64))
    if not len(arr):
        return 0
    prefix = np.concatenate([[0], np.cumsum(arr)])
    best = int(-(-prefix[-1] // capacity))
    for a in np.unique(np.concatenate([[0], arr[arr <= capacity // 2]])):
        big = len(arr) - np.searchsorted(arr, capacity - a, "right")
        lo, mid, hi = np.searchsorted(arr, a, "left"), np.searchsorted(arr, capacity // 2, "right"), np.searchsorted(arr, capacity - a, "right")
        middle = hi - mid
        small = prefix[mid] - prefix[lo]
        spare = middle * capacity - (prefix[hi] - prefix[mid])
        best = max(best, int(big + middle + max(0, -(-(small - spare) // capacity))))
    return best


def _sums(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """For each place k, and one past the last, the sums up to ``room`` of pieces from k on: bit t is set where t is one."""
    mask = (1 << (room + 1)) - 1
    out = [1] * (len(sizes) + 1)
    for k in range(len(sizes) - 1, -1, -1):
        b, left, step = out[k + 1], min(counts[k], room // sizes[k]), 1
        while left:
            take = min(step, left)
            b |= b << (take * sizes[k])
            left -= take
            step *= 2
        out[k] = b & mask
    return out


def fillings(sizes: list[int], counts: list[int], room: int, waste: int) -> Iterator[tuple[int, dict[int, int]] | None]:
    """The fillings of ``room`` that leave at most ``waste`` and that no other dominates: (rest, pieces by place).

    ``sizes`` descend.  A filling is dominated when a piece outside it could take
    the place of pieces inside it that are smaller, or many and no larger
    together; the pieces that it sets free then fit wherever it was.  Fillings
    come fullest first, of equal ones those of larger pieces first, one by one as
    they are asked for; the bit sets of reachable sums keep the enumeration out of
    dead ends, so every step ends in a filling.  None stands for a dominated one.
    """
    reach = _sums(sizes, counts, room)
    down = [-s for s in sizes]
    n = len(sizes)

    def dominated(rest: int, taken: dict[int, int]) -> bool:
        inside = _sums([sizes[k] for k in taken], list(taken.values()), room)[0]
        for k in range(n):
            s = sizes[k]
            if s > room:
                continue
            if k in taken:
                if s <= rest and taken[k] < counts[k]:
                    return True
                continue
            # sums inside from s - rest up to s; 0 is one, of no piece
            low = max(0, s - rest)
            if inside >> low & ((1 << (s - low + 1)) - 1):
                return True
        return False

    for total in range(room, max(room - waste, 0) - 1, -1):
        if not reach[0] >> total & 1:
            continue
        # depth first without recursion: (place, left before it, pieces taken there)
        path: list[tuple[int, int, int]] = []
        k, left, most = 0, total, None
        while True:
            if left:
                if most is None:
                    k = max(k, bisect_left(down, -left))
                    most = min(counts[k], left // sizes[k]) if k < n else -1
                s, c = (sizes[k], most) if k < n else (0, -1)
                while c >= 0 and not reach[k + 1] >> (left - c * s) & 1:
                    c -= 1
                if c >= 0:
                    if c:
                        path.append((k, left, c))
                        left -= c * s
                    else:
                        path.append((k, left, 0))
                    k, most = k + 1, None
                    continue
            else:
                taken = {k: c for k, _, c in path if c}
                yield None if dominated(room - total, taken) else (room - total, taken)
            # back to the last place where fewer pieces may do
            while path and not path[-1][2]:
                path.pop()
            if not path:
                break
            k, left, c = path.pop()
            most = c - 1


def pack(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Bins of indices of ``sizes`` (each 1 to capacity), as few as the search finds.

    ``nodes`` bounds the fillings that the search looks at, over all pieces and
    whatever their number; with an infinite bound the result is optimal.  Ties
    between equal sizes are settled by the order of ``sizes``.
    """
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    down = [sizes[k] for k in order]
    best = best_fit(down, capacity)
    bound = lower_bound(down, capacity)
    if len(best) > bound:
        total = sum(down)
        by: dict[int, list[int]] = {}
        for k, s in enumerate(down):
            by.setdefault(s, []).append(k)
        kinds = sorted(by, reverse=True)
        counts = [len(by[s]) for s in kinds]
        used = 0

        def assemble() -> list[list[int]]:
            rest = {s: ids[::-1] for s, ids in by.items()}
            out = []
            for at, _, taken, _ in stack:
                one = [rest[kinds[at]].pop()]
                for k, c in taken.items():
                    one += [rest[kinds[k]].pop() for _ in range(c)]
                out.append(one)
            return out

        def node(left: int, lost: int, bins: int):
            """A bin around the largest piece left, its fillings still to come; None where it can't lead to fewer bins."""
            spare = (len(best) - 1) * capacity - total - lost
            if spare < 0 or bins + -(-left // capacity) >= len(best):
                return None
            at = next(k for k, c in enumerate(counts) if c)
            counts[at] -= 1
            room = capacity - kinds[at]
            usable = [k for k in range(at, len(kinds)) if counts[k] and kinds[k] <= room]
            found = fillings([kinds[k] for k in usable], [counts[k] for k in usable], room, min(spare, room))
            return [at, (found, usable), {}, lost]

        # one entry a bin: the largest piece, its fillings, the one that is taken, the waste of the bins before
        stack = [node(total, 0, 0)]
        left = [total]
        while stack and used < nodes and len(best) > bound:
            top = stack[-1]
            for k, c in top[2].items():
                counts[k] += c
            top[2] = {}
            one = None
            for f in top[1][0]:
                used += 1
                if f is not None and top[3] + f[0] > (len(best) - 1) * capacity - total:
                    break  # fillings only get emptier
                if f is not None or used >= nodes:
                    one = f
                    break
            if one is None:
                counts[top[0]] += 1
                stack.pop()
                left.pop()
                continue
            rest, chosen = one
            top[2] = {top[1][1][k]: c for k, c in chosen.items()}
            for k, c in top[2].items():
                counts[k] -= c
            now = left[-1] - (capacity - rest)
            if not now:
                best = assemble()
                continue
            deeper = node(now, top[3] + rest, len(stack))
            if deeper:
                stack.append(deeper)
                left.append(now)
    return [[order[k] for k in b] for b in best]


def token_estimate(text="text"):
    """A text's tokens as this engine estimates them: its UTF-8 bytes by four, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) / 4).cast("long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = 2000, nodes: int = NODES) -> DataFrame:
    """(group_id, bin_id, slot, doc_id, piece, start_token, n_tokens): every piece of every document once.

    Bins hold at most ``capacity`` tokens and are numbered within their group.  A document
    of more is cut into full pieces, each a bin of its own, and a rest that is
    packed.  Null and empty texts have no tokens and no row; rows with a null
    doc_id are packed like others, under a null id; rows that repeat a doc_id are
    packed once each.  Among pieces of equal size those of lesser doc_id come
    first.  Other columns are ignored; an empty table gives an empty result.
    Groups have about ``group_docs`` documents at every scale and for any ids.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_estimate().alias("tokens")).where("tokens > 0")
    # equal rows are counted before they travel, and numbered where they meet
    lengths = materialize(src.groupBy("doc_id", "tokens").agg(F.count("*").alias("n")), "lengths")
    groups = max(1, -(-(lengths.agg(F.sum("n")).first()[0] or 0) // group_docs))

    def run(batches):
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, tokens = x.values.field("doc_id"), x.values.field("tokens").to_numpy()
                full, rest = tokens // capacity, tokens % capacity
                # full pieces take a bin each, rests are packed
                doc = np.repeat(np.arange(len(tokens)), full)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
                part = np.flatnonzero(rest)
                bins = pack(rest[part].tolist(), capacity, nodes)
                of = part[np.array([k for one in bins for k in one], np.int64)]
                size = np.array([len(one) for one in bins], np.int64)
                bin_ = np.concatenate([np.arange(len(doc)), len(doc) + np.repeat(np.arange(len(bins)), size)])
                slot = np.concatenate([np.zeros(len(doc), np.int64), np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)])
                piece = np.concatenate([piece, full[of]])
                n = np.concatenate([np.full(len(doc), capacity), rest[of]])
                columns = [np.full(len(n), key), bin_, slot.astype(np.int32), ids.take(pa.array(np.concatenate([doc, of]))), piece.astype(np.int32), piece * capacity, n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["group_id", "bin_id", "slot", "doc_id", "piece", "start_token", "n_tokens"])

    each = lengths.select("doc_id", "tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    # solving costs far more than the bytes that it reads suggest, so the number of tasks follows the groups
    dealt = each.select(F.pmod(F.xxhash64("doc_id", "tokens", "copy"), F.lit(groups)).alias("group_id"), "doc_id", "tokens").repartition(max(1, groups // 4), "group_id")
    return map_arrow(dealt.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tokens"))).alias("x")), run, RESULT)
