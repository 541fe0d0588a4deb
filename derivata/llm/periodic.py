"""Periodic runs of words in documents, found with a suffix tree.

For the words of a document numbered from 0, a run is a stretch with smallest period q that no neighbouring word extends.
Every run of two periods or more ends with exactly one branching tandem repeat: a square w[i:i + 2q] = xx whose next word
differs from the word one period before it. In the suffix tree, i and i + q are then leaves beneath the node of depth q,
in different children of it. So, for each inner node, only the leaves of its smaller children are looked at (the largest
child is left out): leaf i pairs with i + q and with i - q where these are leaves of the node too. Each leaf is looked at
log n times at most, as its subtree doubles each time. Rotating a branching repeat to the left, word by word, gives its
run; repeats of a multiple of a period are merged into the run of the least period with the same end.

The tree is held as arrays: suffixes in order, found by doubling the compared length for those still tied, common
prefixes of neighbours, and inner nodes as ranges of that order. All documents of about ``SEGMENT`` bytes make one array
without common nodes. Memory is some 4 (10 + log2 of the longest repeat) bytes a word of a segment, or of one longer text.
Words are told apart by their bytes; hashes only number them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import hash_spans, joined, released, same_spans, slices, spans, text_buffers

#: Leaves that are looked at together.
LEAVES = 1 << 20


def word_numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word: equal for words of equal bytes only."""
    _, at, number = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
    if not same_spans(buf, starts, ends, buf, starts[at[number]], ends[at[number]]).all():
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(buf[a:b].tobytes(), len(known)) for a, b in zip(starts, ends, strict=True)], np.int64)
    return number


def suffixes(w: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All suffixes in the order of (document, words), and for each k the places of the first 2^k words among those of all."""
    n = len(w)
    key = doc * (int(w.max()) + 1) + w
    order = np.argsort(key, kind="stable")
    rank, slots, values = np.empty(n, np.int32), np.arange(n), key[order]
    levels: list[np.ndarray] = []
    tied, h = order, 1
    while True:
        # `tied` fills `slots`; equal neighbours by `values` stay tied, all others have their place.
        new = np.ones(len(tied), bool)
        new[1:] = values[1:] != values[:-1]
        rank[tied] = slots[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        levels.append(rank.copy())
        more = ~new
        more[:-1] |= ~new[1:]
        tied, slots = tied[more], slots[more]
        if not len(tied):
            return order, levels
        after = tied + h
        inside = after < end[tied]
        key = rank[tied].astype(np.int64) * (n + 1)
        key[inside] += rank[after[inside]] + 1
        by = np.argsort(key, kind="stable")
        tied, values = tied[by], key[by]
        order[slots] = tied
        h *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """n + 1 numbers: how many words each suffix shares with the one before it in the order; 0 at both ends."""
    out = np.zeros(len(order) + 1, np.int64)
    some = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[some].copy(), order[some + 1].copy()
    last_a, last_b = end[a], end[b]
    for k in range(len(levels) - 2, -1, -1):
        inside = np.flatnonzero((a < last_a) & (b < last_b))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        a[same] += 1 << k
        b[same] += 1 << k
    out[some + 1] = a - order[some]
    return out


def _next_less(depth: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each place of ``at``, the nearest place in the direction of ``step`` with a lesser depth. Pointers of all places
    jump along each other's."""
    to = np.arange(len(depth))
    to[at] += step
    left = at
    while len(left := left[depth[to[left]] >= depth[left]]):
        to[left] = to[to[left]]
    return to[at]


def inner_nodes(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(depth, lo, hi) of the nodes, whose leaves are places lo to hi - 1, for each of their children but the largest one,
    with its own leaves from a to b - 1."""
    at = np.flatnonzero(depth > 0)
    if not len(at):
        return (at,) * 5
    lo, hi = _next_less(depth, at, -1), _next_less(depth, at, 1)
    by = np.argsort(lo * (len(depth) + 1) + hi, kind="stable")
    at, lo, hi = at[by], lo[by], hi[by]
    first = np.ones(len(at), bool)
    first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(at)) - 1
    left = np.where(first, lo, np.concatenate([[0], at[:-1]]))
    # Children end at each boundary of a node, and the last one at the node's own end.
    a, b = np.concatenate([left, at[tails]]), np.concatenate([at, hi[tails]])
    node = np.concatenate([np.cumsum(first) - 1, np.arange(len(heads))])
    line = np.lexsort((a, node))
    a, b, node = a[line], b[line], node[line]
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    largest = np.maximum.reduceat(b - a, starts)
    keep = np.ones(len(a), bool)
    keep[np.minimum.reduceat(np.where(b - a == largest[node], np.arange(len(a)), len(a)), starts)] = False
    node = heads[node[keep]]
    return depth[at[node]], lo[node], hi[node], a[keep], b[keep]


def _ragged(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 0 .. n[row] - 1) of all rows."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def branching_repeats(w: np.ndarray, begin: np.ndarray, end: np.ndarray, order: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of all branching tandem repeats."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    q, lo, hi, a, b = inner_nodes(depth)
    found = []
    stops = np.cumsum(b - a)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + LEAVES, "right")))
        row, k = _ragged(b[at:to] - a[at:to])
        row += at
        leaf, p = order[a[row] + k], q[row]
        for i, fits in ((leaf, leaf + p < end[leaf]), (leaf - p, leaf - p >= begin[leaf])):
            other = place[np.where(fits, i + p if i is leaf else i, 0)]
            some = np.flatnonzero(fits & (other >= lo[row]) & (other < hi[row]))
            first, period = i[some], p[some]
            stop = first + 2 * period
            on = stop < end[first]
            differ = ~on
            differ[on] = w[stop[on]] != w[stop[on] - period[on]]
            found.append((stop[differ], period[differ]))
        at = to
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop, period = (np.concatenate(x) for x in zip(*found, strict=True))
    n = len(w) + 1
    both = np.unique(stop * n + period)
    return both // n, both % n


def rotated(w: np.ndarray, first: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Where the stretch of a period begins that ends with each tandem repeat; ``first`` is where its document begins."""
    start = stop - 2 * period
    left, step = np.arange(len(stop)), 4
    while len(left):
        room = np.minimum(step, start[left] - first[left])
        row, k = _ragged(room)
        at = start[left][row] - k - 1
        differ = w[at] != w[at + period[left][row]]
        reach = room.copy()
        np.minimum.at(reach, row[differ], k[differ])
        start[left] -= reach
        left = left[reach == step]
        step = min(2 * step, LEAVES)
    return start


def runs(w: np.ndarray, first: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of ``least`` words and ``exponent`` (2 or more) periods at least, by start and
    period, in one array of words; document d has those from first[d] to first[d + 1] - 1."""
    if not len(w):
        return (np.zeros(0, np.int64),) * 3
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    begin, end = first[:-1][doc], first[1:][doc]
    order, levels = suffixes(w, doc, end)
    stop, period = branching_repeats(w, begin, end, order, common_prefixes(order, levels, end))
    out = []
    while len(stop):
        # Of repeats with one end (they are in order) the least period first; what it covers are its multiples.
        head = np.diff(stop, prepend=-1) != 0
        s, q = stop[head], period[head]
        edge = begin[s - 1]
        start = rotated(w, edge, s, q)
        long = s - start >= np.maximum(least, exponent * q)
        out.append((start[long], (s - start)[long], q[long]))
        left = ~head & (2 * period > (s - start)[np.cumsum(head) - 1])
        stop, period = stop[left], period[left]
    start, length, period = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _collapsed(buf, starts, ends, first, run_start, run_length, run_period) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of all documents, and the offsets of each one's text; a run keeps its first period. A document's first
    word always stays, so that each word that goes has a blank before it."""
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, run_start + run_period, 1)
    np.add.at(edge, run_start + run_length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    text, at = joined(buf, starts, ends)
    stops = at + ends - starts
    out = np.zeros(len(text) + 1, np.int64)
    np.add.at(out, at[gone] - 1, 1)
    np.add.at(out, stops[gone], -1)
    keep = np.cumsum(out[:-1]) == 0
    have = first[1:] > first[:-1]
    inside = np.zeros(len(text) + 1, np.int64)  # blanks between documents belong to none
    np.add.at(inside, at[first[:-1][have]], 1)
    np.add.at(inside, stops[first[1:][have] - 1], -1)
    keep &= np.cumsum(inside[:-1]) > 0
    new = np.concatenate([[0], np.cumsum(keep)])
    sizes = np.zeros(len(first) - 1, np.int64)
    sizes[have] = new[stops[first[1:][have] - 1]] - new[at[first[:-1][have]]]
    return text[keep], np.concatenate([[0], np.cumsum(sizes)])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _rows(batch: pa.RecordBatch, least: int, exponent: int) -> pa.RecordBatch:
    buf, off = text_buffers(batch.column(batch.schema.get_field_index("text")))
    starts, ends, first = spans(buf, off)
    start, length, period = runs(word_numbers(buf, starts, ends) if len(starts) else starts, first, least, exponent)
    text, cuts = _collapsed(buf, starts, ends, first, start, length, period) if len(starts) else (buf[:0], np.zeros(len(off), np.int64))
    cut = np.searchsorted(start, first)
    own = start - np.repeat(first[:-1], np.diff(cut))
    found = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (own, length, period)], fields=list(_RUN)))
    kept = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))).cast(pa.string())
    keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(np.diff(first), pa.int64()), found, kept], names=[*(batch.schema.names[i] for i in keep), "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """``docs`` with n_words, runs (array of structs start, length, period, by start and period) and collapsed: the text's
    words joined by one blank, without those that any run contains after its first period.

    Words are separated by space and \\x09-\\x0D. A null or blank text has no words, no runs (an empty array) and an empty
    collapsed text. Repeated rows give repeated rows; an empty table an empty result. Columns named like the new ones are
    replaced, others pass unchanged. ``exponent`` is 2 at least."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    new = ("n_words", "runs", "collapsed")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in new}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{text_col}`").cast("string").alias("text"))

    def rows(batches):
        with released():
            for whole in batches:
                for batch in slices(whole, "text"):
                    yield _rows(batch, least, exponent)

    kinds = "".join(f"{n} {t}, " for n, t in inner.dtypes if n != "text")
    out = inner.mapInArrow(rows, f"{kinds}n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *new)


def strongest(found: Column) -> Column:
    """Of an array of runs, the one of the greatest length / period; of ties the least start, then the least period."""
    better = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    by = lambda x, y: F.when(better(x, y) != 0, -F.signum(better(x, y))).otherwise(F.signum(F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]))).cast("int")
    return F.try_element_at(F.array_sort(found, by), F.lit(1))


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_runs, the strongest run (start, length, period, exponent_milli; nulls if none), and the digests of the list of
    runs and of the collapsed text."""
    out = periodic_runs(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), "text").withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return out.select(
        F.col("id").alias(id_col),
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
