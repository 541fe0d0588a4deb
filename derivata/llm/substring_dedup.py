"""Removal of word sequences that occur more than once in a corpus.

Method: fixed-block anchors. With a window of ``W`` words, blocks are ``(W + 1) // 2`` words long and every window
holds exactly one block that starts at a multiple of the block length. So a window can repeat only if its block's
words also start somewhere else.

1. Anchors: the non-overlapping blocks of all documents are the index; every rolling run of a block's length is a
   probe. Both go by hash to buckets, as packed and sorted arrays that each map task has made unique first. A block
   that only its own position probes is cold.
2. Extension: a hit is extended to both sides by the windows around it, up to a block's length each way, and from hit
   to hit along a repeat. All windows around hot blocks are counted by the BLAKE2b digest (128 bits) of their words, not
   compared occurrence by occurrence, as a passage of k occurrences has k * k pairs. A window is bucketed by the least
   hash of its inner word runs, so the windows of one long repeat stay together and their answer is one interval.
   Overlapping windows make up the maximal repeats.
3. The words that intervals cover are removed.

A map task sends one message a window, however often it holds the window, and settles repeats inside itself. So a
passage in a third of all documents costs each bucket one entry a map flush, not one a copy.

Hashes of words and blocks only choose what is looked at: what they mistake for equal is told apart by the digests.
Nulls and empty texts have no words and are kept as they are. Ids may be of any type; a null id is an id like any other.
Repeated rows are occurrences of their own: they remove each other's long passages. Other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import buckets, cut, drop
from .words import joined, mix, released, rolling, slices, spans, text_buffers, word_hashes

WINDOW = 35
#: Bytes of text, and windows, after which a map task sends what it has.
FLUSH, FLUSH_WINDOWS = 24 << 20, 1 << 20
#: Words in the runs whose least hash chooses a window's bucket.
RUN = 8
LOW = np.uint64((1 << 48) - 1)

_MESSAGE = "bucket int, probes binary, hashes binary, places binary, owners binary"
_ANSWER = "k1 bigint, k2 bigint, found binary"


def _planes(x: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bytes in planes of one byte each, which compress well once sorted."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(x: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(x, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _groups(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], names=[n for n, _ in schema])


_MESSAGE_PA = [("bucket", pa.int32()), ("probes", pa.binary()), ("hashes", pa.binary()), ("places", pa.binary()), ("owners", pa.binary())]
_ANSWER_PA = [("k1", pa.int64()), ("k2", pa.int64()), ("found", pa.binary())]


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """(rows, 2) int64 of k1 and k2."""
    return np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("k1", "k2")], 1).astype(np.int64)


def _packed(items: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*items, strict=True)]


def _anchor_messages(n_buckets: int, window: int):
    block = (window + 1) // 2
    edge = np.uint64(n_buckets)

    def send(held):
        keys = np.concatenate([x[0] for x in held])
        probes = np.concatenate([x[1] for x in held])
        hashes, owner, place = _packed([x[2:] for x in held])
        probes.sort()
        bounds = _groups(probes)[:-1]
        # The low bit tells whether the run starts more than once in this flush.
        more = np.diff(np.append(bounds, len(probes))) > 1
        probes = probes[bounds]
        at = mix(probes, 1) % edge
        order = np.argsort(at, kind="stable")
        probes, more, at = probes[order], more[order], at[order]
        cuts = np.searchsorted(at, np.arange(n_buckets + 1, dtype=np.uint64))
        own_at = mix(hashes, 1) % edge
        order = np.argsort(own_at, kind="stable")
        hashes, owner, place, own_at = hashes[order], owner[order], place[order], own_at[order]
        own_cuts = np.searchsorted(own_at, np.arange(n_buckets + 1, dtype=np.uint64))
        rows = []
        for b in range(n_buckets):
            p, q = slice(cuts[b], cuts[b + 1]), slice(own_cuts[b], own_cuts[b + 1])
            if cuts[b] == cuts[b + 1]:
                continue
            names, local = np.unique(owner[q], return_inverse=True)
            rows.append((b, _planes(probes[p], 6) + np.packbits(more[p]).tobytes(), _planes(hashes[q], 6), np.stack([local, place[q]]).astype("<u4").tobytes(), keys[names].tobytes()))
        if rows:
            yield _batch(rows, _MESSAGE_PA)

    def run(batches):
        held, size, base = [], 0, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                buf, off = text_buffers(batch.column(batch.schema.get_field_index("text")))
                h, first = word_hashes(buf, off)
                n = np.diff(first)
                owner_of = np.repeat(np.arange(len(n)), n)
                inside = np.arange(len(h)) - np.repeat(first[:-1], n)
                r = rolling(h, block, 11) & LOW
                fits = (inside + block <= np.repeat(n, n))[: len(r)]
                # A block counts only if some window around it fits in the document.
                own = fits & (inside[: len(r)] % block == 0) & (np.repeat(n, n)[: len(r)] >= window)
                held.append((_keys(batch), r[fits & (np.repeat(n, n)[: len(r)] >= window)], r[own], owner_of[: len(r)][own] + base, inside[: len(r)][own] // block))
                base += len(n)
                size += len(buf)
                if size >= FLUSH:
                    yield from send(held)
                    held, size, base = [], 0, 0
        if held:
            yield from send(held)

    return lambda batches: _released(run(batches))


def _released(rows):
    with released():
        yield from rows


def _digests(buf: np.ndarray, off: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """(n, 2) uint64: the digest of the words of each window, by number of its first word, joined by one blank."""
    if not len(at):
        return np.zeros((0, 2), np.uint64)
    starts, ends, _ = spans(buf, off)
    text, place = joined(buf, starts, ends)
    data, new = memoryview(text), hashlib.blake2b
    lo, hi = place[at].tolist(), (place + ends - starts)[at + window - 1].tolist()
    return np.frombuffer(b"".join([new(data[a:b], digest_size=16).digest() for a, b in zip(lo, hi, strict=True)]), "<u8").reshape(-1, 2)


def _answers(owners: np.ndarray, keys: np.ndarray, place: np.ndarray):
    """Rows (k1, k2, found) from places by owner."""
    order = np.lexsort((place, owners))
    owners, place = owners[order], place[order].astype("<u4")
    cuts = _groups(owners)
    return [(int(keys[owners[a]][0]), int(keys[owners[a]][1]), place[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _hot_anchors(table: pa.Table) -> pa.Table:
    probes, hashes, owner, place, keys, base = [], [], [], [], [], 0
    for p, h, w, k in zip(*(table.column(c).to_pylist() for c in ("probes", "hashes", "places", "owners")), strict=True):
        n = len(p) * 8 // 49 if len(p) else 0
        while 6 * n + (n + 7) // 8 < len(p):
            n += 1
        values = _unplaned(p[: 6 * n], 6)
        probes += [values, values[np.unpackbits(np.frombuffer(p[6 * n :], np.uint8), count=n).astype(bool)]]
        names, at = np.frombuffer(k, np.int64).reshape(-1, 2), np.frombuffer(w, "<u4").reshape(2, -1)
        hashes.append(_unplaned(h, 6))
        owner.append(at[0].astype(np.int64) + base)
        place.append(at[1])
        keys.append(names)
        base += len(names)
    seen = np.sort(np.concatenate(probes))
    repeated = np.unique(seen[1:][seen[1:] == seen[:-1]])
    hashes, owner, place, keys = (np.concatenate(x) for x in (hashes, owner, place, keys))
    at = np.searchsorted(repeated, hashes)
    hot = (at < len(repeated)) & (repeated[np.minimum(at, max(len(repeated) - 1, 0))] == hashes) if len(repeated) else np.zeros(len(hashes), bool)
    rows = _answers(owner[hot], keys, place[hot])
    return pa.Table.from_batches([_batch(rows, _ANSWER_PA)] if rows else [], pa.schema(_ANSWER_PA))


def _minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones, in log(width) passes."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _window_messages(n_buckets: int, window: int):
    block, run_words = (window + 1) // 2, min(RUN, window)
    edge = np.uint64(n_buckets)

    def send(held):
        keys = np.concatenate([x[0] for x in held])
        first, second, least, owner, place = _packed([x[1:] for x in held])
        order = np.lexsort((second, first))
        first, second, least, owner, place = (x[order] for x in (first, second, least, owner, place))
        start = np.ones(len(first), bool)
        start[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        group = np.cumsum(start) - 1
        size = np.bincount(group)
        settled = size[group] > 1
        # Repeats inside this flush are settled here; one message still tells the others of them.
        rows = []
        local = _answers(owner[settled], keys, place[settled])
        for k1, k2, found in local:
            rows.append((int(mix(np.array([k2], np.int64).view(np.uint64), 3)[0] % edge), b"", b"", found, np.array([k1, k2], np.int64).tobytes()))
        first, second, least, owner, place, size = first[start], second[start], least[start], owner[start], place[start], size
        at = mix(least, 2) % edge
        order = np.argsort(at, kind="stable")
        first, second, owner, place, at, size = (x[order] for x in (first, second, owner, place, at, size))
        cuts = np.searchsorted(at, np.arange(n_buckets + 1, dtype=np.uint64))
        for b in range(n_buckets):
            q = slice(cuts[b], cuts[b + 1])
            if cuts[b] == cuts[b + 1]:
                continue
            asks = size[q] == 1
            names, mine = np.unique(owner[q], return_inverse=True)
            where = np.where(asks, place[q], 0xFFFFFFFF)
            rows.append((b, _planes(first[q], 8), _planes(second[q], 8), np.stack([mine, where]).astype("<u4").tobytes(), keys[names].tobytes()))
        if rows:
            yield _batch(rows, _MESSAGE_PA)

    def windows(batch, base):
        """Digest (two halves), least inner hash, owner and place of every window around a hot block."""
        buf, off = text_buffers(batch.column(batch.schema.get_field_index("text")))
        h, start = word_hashes(buf, off)
        n = np.diff(start)
        if len(h) < window:
            return None
        hot = np.zeros(len(h) + block, bool)
        for d, parts in enumerate(batch.column(batch.schema.get_field_index("found")).to_pylist()):
            for part in parts:
                hot[start[d] + np.frombuffer(part, "<u4").astype(np.int64) * block] = True
        inside = np.arange(len(h)) - np.repeat(start[:-1], n)
        fits = inside + window <= np.repeat(n, n)
        anchor = np.minimum(np.arange(len(h)) - inside + -(-inside // block) * block, len(h))
        p = np.flatnonzero(fits & hot[anchor])
        first, second = _digests(buf, off, p, window).T
        least = _minima(rolling(h, run_words, 23), window - run_words + 1)[p]
        return _keys(batch), first, second, least, np.repeat(np.arange(len(n)), n)[p] + base, inside[p]

    def run(batches):
        held, size, count, base = [], 0, 0, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                if (got := windows(batch, base)) is not None:
                    held.append(got)
                    base += batch.num_rows
                    count += len(got[1])
                size += batch.nbytes
                if (size >= FLUSH or count >= FLUSH_WINDOWS) and held:
                    yield from send(held)
                    held, size, count, base = [], 0, 0, 0
        if held:
            yield from send(held)

    return lambda batches: _released(run(batches))


def _repeated_windows(table: pa.Table) -> pa.Table:
    rows, first, second, owner, place, keys, base = [], [], [], [], [], [], 0
    for a, b, w, k in zip(*(table.column(c).to_pylist() for c in ("probes", "hashes", "places", "owners")), strict=True):
        names = np.frombuffer(k, np.int64).reshape(-1, 2)
        if not a:
            rows.append((int(names[0][0]), int(names[0][1]), w))
            continue
        at = np.frombuffer(w, "<u4").reshape(2, -1)
        first.append(_unplaned(a, 8))
        second.append(_unplaned(b, 8))
        owner.append(at[0].astype(np.int64) + base)
        place.append(at[1])
        keys.append(names)
        base += len(names)
    if first:
        first, second, owner, place, keys = (np.concatenate(x) for x in (first, second, owner, place, keys))
        order = np.lexsort((second, first))
        first, second, owner, place = first[order], second[order], owner[order], place[order]
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        found = np.zeros(len(first), bool)
        found[1:] |= same
        found[:-1] |= same
        found &= place != 0xFFFFFFFF
        rows += _answers(owner[found], keys, place[found])
    return pa.Table.from_batches([_batch(rows, _ANSWER_PA)] if rows else [], pa.schema(_ANSWER_PA))


def _removal(window: int, schema: pa.Schema, digest: bool):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                column = batch.column(batch.schema.get_field_index("text"))
                buf, off = text_buffers(column)
                data = buf.tobytes()
                texts, n_words, n_removed, shas = [], [], [], []
                starts, ends, first = spans(buf, off)
                for d, parts in enumerate(batch.column(batch.schema.get_field_index("found")).to_pylist()):
                    s, e = starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]]
                    keep = np.ones(len(s), bool)
                    if parts:
                        edge = np.zeros(len(s) + 1, np.int32)
                        at = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in parts])).astype(np.int64)
                        edge[at] += 1
                        np.subtract.at(edge, at + window, 1)
                        keep = np.cumsum(edge[:-1]) == 0
                    n_words.append(len(s))
                    n_removed.append(int(len(s) - keep.sum()))
                    if digest:
                        shas.append(hashlib.sha256(b" ".join([data[a:b] for a, b in zip(s[keep].tolist(), e[keep].tolist(), strict=True)])).hexdigest())
                    else:
                        texts.append(_joined(data[off[d] : off[d + 1]], s - off[d], e - off[d], keep) if n_removed[-1] else None)
                out = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
                if digest:
                    out["kept_sha256"] = pa.array(shas, pa.string())
                else:
                    out["text"] = pa.array([t if t is not None else x for t, x in zip(texts, column.to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([out[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    return run


def _joined(data: bytes, s: np.ndarray, e: np.ndarray, keep: np.ndarray) -> str:
    """The text without the dropped words: each run of kept words with its own white space, runs joined by a line break."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    return b"\n".join(data[s[a] : e[b - 1]] for a, b in zip(edge[::2], edge[1::2], strict=True)).decode("utf-8")


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(k1, k2, found): for each document with repeats, binaries of little-endian uint32 word numbers at which a
    repeated window starts. k1 and k2 are the :func:`_key` of its id and text."""
    spark = docs.sparkSession
    n = buckets(spark)
    keyed = docs.select(*_key(id_col, text_col), F.col(f"`{text_col}`").alias("text"))
    anchors = keyed.mapInArrow(_anchor_messages(n, window), _MESSAGE).groupBy("bucket").applyInArrow(_hot_anchors, _ANSWER)
    hot, path = cut(anchors.groupBy("k1", "k2").agg(F.collect_list("found").alias("found")), "anchors")
    near = keyed.join(hot.hint("shuffle_hash"), ["k1", "k2"])
    windows = near.mapInArrow(_window_messages(n, window), _MESSAGE).groupBy("bucket").applyInArrow(_repeated_windows, _ANSWER)
    out, _ = cut(windows.groupBy("k1", "k2").agg(F.collect_list("found").alias("found")), "windows")
    drop(spark, path)
    return out


def _key(id_col: str, text_col: str):
    """k1 and k2: the first 128 bits of the SHA-256 of id and text, as two bigints."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in (id_col, text_col)]
    digest = F.sha2(F.concat(parts[0], F.lit("\x00"), parts[1]), 256)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint").alias(k) for at, k in ((1, "k1"), (17, "k2"))]


def _applied(docs: DataFrame, id_col: str, text_col: str, window: int, extra: list[tuple[str, str]], digest: bool, keep: list[str]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    found = repeated_starts(docs, id_col, text_col, window).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("found").alias("_found"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text_col}
    inner = docs.select(*[F.col(f"`{c}`").alias(names[c]) for c in names if c in keep], *_key(id_col, text_col), F.col(f"`{text_col}`").alias("text"))
    joined = inner.join(found.hint("shuffle_hash"), (inner.k1 == found._k1) & (inner.k2 == found._k2), "left")
    joined = joined.select(*[names[c] for c in names if c in keep], "text", F.coalesce("_found", F.array().cast("array<binary>")).alias("found"))
    fields = [joined.schema[names[c]] for c in names if c in keep] + ([] if digest else [joined.schema["text"]])
    schema = StructType(fields + [StructField(n, _parse_datatype_string(t)) for n, t in extra])
    out = joined.mapInArrow(_removal(window, to_arrow_schema(schema), digest), schema)
    return out.select(*[F.col(names[c] if c != text_col else "text").alias(c) for c in docs.columns if c in keep and not (digest and c == text_col)], *[n for n, _ in extra])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with every word removed that lies in a window of ``window`` words found elsewhere too; adds n_words
    and n_removed (these names replace columns so named). Untouched texts stay byte for byte as they are."""
    docs = docs.drop("n_words", "n_removed")
    return _applied(docs, id_col, text_col, window, [("n_words", "bigint"), ("n_removed", "bigint")], False, docs.columns)


def substring_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed and kept_sha256: the digest of the kept words joined by one space."""
    return _applied(docs.select(id_col, text_col), id_col, text_col, window, [("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")], True, [id_col])
