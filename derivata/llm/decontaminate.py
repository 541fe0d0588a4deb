"""Benchmark decontamination with an Aho-Corasick automaton.

Benchmark texts are normalised (A-Z lower-cased; words of digits, letters and all beyond ASCII) and cut into windows
of ten words; a shorter text is one window. An automaton over all windows scans the normalised words of a document
once, and each find is mapped back to word numbers and to places in the original text.

Each distinct word of the benchmark has a number, written as two symbols of separate small alphabets, so a pattern is a
string of twenty symbols, whatever its words are, and nodes have few branches. A document's words become numbers once, by
hash and then by bytes; a run of other words is one symbol that is in no pattern.

One automaton holds up to about ``PART_WORDS`` words of benchmark, a proven bound on what is collected and broadcast. A
larger benchmark is dealt to parts of that size by runs of its words, with one automaton and one scan of the documents a
part; finds are then put together by the text's digest, so that no worker ever holds more than one automaton and nothing
is left out.

A null document or benchmark text has no words. Items without words match nothing. Items of equal text, and repeated
documents, each count. Null item ids are left out of the list of ids, but their windows still hit.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, hash_spans, released, same_spans, slices, spans, text_buffers

WINDOW = 10
#: Words of benchmark in an automaton, about, and in a run of an item that stays together.
PART_WORDS, RUN_WORDS = 50_000, 5_000
#: Where the alphabets of a number's two digits begin; the second has 256 symbols.
HIGH, LOW = 0x1000, 0x100

#: Bytes that are no part of a word, once A-Z are lower case.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def normal_words(buf: np.ndarray, off: np.ndarray):
    """Lower-cased bytes, with word starts and ends and each document's first word."""
    low = LOWER[buf]
    return low, *spans(low, off, OUTSIDE)


def _look(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First byte, last byte and length (31 at most) of each word as one number."""
    return low[starts].astype(np.int64) | low[ends - 1].astype(np.int64) << 8 | np.minimum(ends - starts, 31) << 16


class _Scanner:
    """The automaton of a part of the benchmark, rows (item id or None, words joined by blanks)."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in rows:
            words = [self.number.setdefault(w, len(self.number)) for w in text.encode().split(b" ")]
            for k in range(max(len(words) - window + 1, 1)):
                found.setdefault(tuple(words[k : k + window]), set()).add(item)
        self.sizes = np.array([len(p) for p in found], np.int64)
        self.owners = [sorted(s - {None}) for s in found.values()]
        self.automaton = ahocorasick.Automaton()
        for j, pattern in enumerate(found):
            self.automaton.add_word("".join(chr(HIGH + n // 256) + chr(LOW + n % 256) for n in pattern), j)
        if found:
            self.automaton.make_automaton()
        self.spelling = np.frombuffer(b"".join(self.number), np.uint8)
        lens = np.fromiter(map(len, self.number), np.int64, len(self.number))
        ends = np.cumsum(lens)
        starts = ends - lens
        hashes = hash_spans(self.spelling, starts, ends)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts, self.ends = hashes[order], starts[order], ends[order]
        self.numbers = order  # words are numbered as they came
        self.looks = np.zeros(1 << 21, bool)
        self.looks[_look(self.spelling, starts, ends)] = True

    def numbers_of(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words of no pattern."""
        out = np.full(len(starts), -1, np.int64)
        maybe = np.flatnonzero(self.looks[_look(low, starts, ends)])
        hashes = hash_spans(low, starts[maybe], ends[maybe])
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        maybe, at = maybe[found], at[found]
        same = same_spans(low, starts[maybe], ends[maybe], self.spelling, self.starts[at], self.ends[at])
        out[maybe[same]] = self.numbers[at[same]]
        for i in maybe[~same].tolist():  # words of the hash of another word
            out[i] = self.number.get(low[starts[i] : ends[i]].tobytes(), -1)
        return out

    def finds(self, low, starts, ends, first) -> np.ndarray:
        """Rows (first word, end, pattern) of all occurrences, over the words of the batch."""
        if not len(self.sizes) or not len(starts):
            return np.zeros((0, 3), np.int64)
        number = self.numbers_of(low, starts, ends)
        known = number >= 0
        head = np.zeros(len(starts), bool)  # first words of documents, which a symbol of no pattern precedes
        head[first[:-1][np.diff(first) > 0]] = True
        broken = ~known & (head | np.concatenate([[True], known[:-1]]))
        stop = np.cumsum(head + np.where(known, 2, broken))
        symbols = np.ones(int(stop[-1]), "<u4")
        words = np.flatnonzero(known)
        last = stop[words] - 1
        symbols[last - 1], symbols[last] = HIGH + number[words] // 256, LOW + number[words] % 256
        hits = np.fromiter((end << 32 | j for end, j in self.automaton.iter(symbols.tobytes().decode("utf-32-le"))), np.int64)
        pattern = hits & 0xFFFFFFFF
        end = words[np.searchsorted(last, hits >> 32)] + 1 if len(words) else hits
        return np.stack([end - self.sizes[pattern], end, pattern], 1)

    def by_document(self, low, starts, ends, first) -> tuple[list[np.ndarray], list[list[str]]]:
        """For each document, its intervals of words and the ids of its items, sorted."""
        finds = self.finds(low, starts, ends, first)
        doc = np.searchsorted(first, finds[:, 0], "right") - 1
        order = np.argsort(doc, kind="stable")
        finds, cuts = finds[order], np.searchsorted(doc[order], np.arange(len(first)))
        intervals, ids = [], []
        for d in range(len(first) - 1):
            if cuts[d] == cuts[d + 1]:
                intervals.append(finds[:0, :2])
                ids.append([])
                continue
            mine = finds[cuts[d] : cuts[d + 1]]
            intervals.append(mine[:, :2] - first[d])
            ids.append(sorted(set().union(*(self.owners[p] for p in np.unique(mine[:, 2]).tolist()))))
        return intervals, ids


@functools.lru_cache(1)
def _scanner(rows: tuple, window: int) -> _Scanner:
    return _Scanner(rows, window)


_ADDED = {True: ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"], False: ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]}


def _measured(batch: pa.RecordBatch, names: list[str], words, intervals: list[np.ndarray], ids: list[list[str]], digests: bool) -> pa.RecordBatch:
    """The batch's columns ``names`` and what was found."""
    buf, off = text_buffers(batch.column(batch.schema.get_field_index("text")))
    _, starts, ends, first = words
    n_words, n_hit, places = np.diff(first), [], []
    for d, found in enumerate(intervals):
        if not len(found):
            n_hit.append(0)
            places.append([])
            continue
        edge = np.zeros(n_words[d] + 1, np.int64)
        np.add.at(edge, found[:, 0], 1)
        np.subtract.at(edge, found[:, 1], 1)
        hit = np.cumsum(edge[:-1]) > 0
        n_hit.append(int(hit.sum()))
        if not digests:
            cuts = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            begin, stop = starts[first[d] + cuts[::2]], ends[first[d] + cuts[1::2] - 1]
            lead = np.concatenate([[0], np.cumsum((buf[off[d] : off[d + 1]] & 0xC0) != 0x80)]) if len(cuts) else None
            places.append([{"start": int(lead[a - off[d]]), "end": int(lead[b - off[d]])} for a, b in zip(begin, stop, strict=True)])
    more = [pa.array(n_words.astype(np.int64)), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64())]
    if digests:
        more.append(pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()))
    else:
        more += [pa.array(ids, pa.list_(pa.string())), pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    more.append(pa.array([n > 0 for n in n_hit], pa.bool_()))
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *more], names=[*names, *_ADDED[digests]])


def _whole(rows, window: int, names: list[str], digests: bool):
    """Scan and measure, with the one automaton of the whole benchmark."""

    def run(batches):
        with released():
            scanner = _scanner(rows.value, window)
            for whole in batches:
                for batch in slices(whole, "text"):
                    words = normal_words(*text_buffers(batch.column(batch.schema.get_field_index("text"))))
                    yield _measured(batch, names, words, *scanner.by_document(*words), digests)

    return run


def _part(rows, window: int):
    """Rows (t, found, ids) of the texts that a part of the benchmark hits: word intervals as little-endian uint32."""

    def run(batches):
        with released():
            scanner = _scanner(rows.value, window)
            for whole in batches:
                for batch in slices(whole, "text"):
                    intervals, ids = scanner.by_document(*normal_words(*text_buffers(batch.column(batch.schema.get_field_index("text")))))
                    hit = [d for d, x in enumerate(intervals) if len(x)]
                    columns = [batch.column(batch.schema.get_field_index("t")).take(pa.array(hit, pa.int64())), pa.array([intervals[d].astype("<u4").tobytes() for d in hit], pa.binary()), pa.array([ids[d] for d in hit], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["t", "found", "ids"])

    return run


def _together(names: list[str], digests: bool):
    """Measure texts by what all parts found in them."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found, ids = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("found", "ids"))
                intervals = [np.frombuffer(b"".join(x or ()), "<u4").reshape(-1, 2).astype(np.int64) for x in found]
                words = normal_words(*text_buffers(batch.column(batch.schema.get_field_index("text"))))
                yield _measured(batch, names, words, intervals, [sorted(x or ()) for x in ids], digests)

    return run


def _runs(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words, n): runs of at most about ``RUN_WORDS`` words of each item, such that each window is in one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), upper, upper.lower())
    words = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    begins = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(RUN_WORDS))
    runs = words.select("item", "w", F.explode(begins).alias("k")).select("item", F.slice("w", F.col("k") + 1, RUN_WORDS + window - 1).alias("w"))
    return runs.select("item", F.array_join("w", " ").alias("words"), F.size("w").alias("n")).distinct()


def _applied(docs, benchmark, text_col, item_col, item_text, window, digests, extra):
    spark, added = docs.sparkSession, _ADDED[digests]
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text_col or not digests}
    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{text_col}`").cast("string").alias("text"))
    kept = list(names.values())
    out_schema = ", ".join([*(f"{n} {t}" for n, t in df.dtypes if n in kept), extra])
    runs = _runs(benchmark, item_col, item_text, window)
    parts = max(1, math.ceil((runs.agg(F.sum("n")).first()[0] or 0) / PART_WORDS))

    def rows(k: int):
        """A part's rows, of about ``PART_WORDS`` words, as a broadcast."""
        mine = runs if parts == 1 else runs.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k)
        return spark.sparkContext.broadcast(tuple(sorted(((r.item, r.words) for r in mine.select("item", "words").collect()), key=lambda x: (x[0] or "", x[1]))))

    if parts == 1:
        out = df.mapInArrow(_whole(rows(0), window, kept, digests), out_schema)
    else:
        keyed = df.withColumn("t", F.sha2("text", 256))
        texts = keyed.select("t", "text").where("text IS NOT NULL")
        scans = [texts.mapInArrow(_part(rows(k), window), "t string, found binary, ids array<string>").dropDuplicates(["t"]) for k in range(parts)]
        all_found = functools.reduce(DataFrame.unionByName, scans).groupBy("t").agg(F.collect_list("found").alias("found"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
        out = keyed.join(all_found, "t", "left").mapInArrow(_together(kept, digests), out_schema)
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in added], *added)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (ids as strings, sorted), spans (character places of the hit
    passages in the text, end exclusive) and contaminated. Columns with these names are replaced."""
    extra = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>, contaminated boolean"
    return _applied(docs, benchmark, text_col, item_col, item_text, window, False, extra)


def decontamination_digests(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    extra = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return _applied(docs.select(id_col, text_col), benchmark, text_col, "item_id", "text", WINDOW, True, extra)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with the columns of ``docs``."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return decontaminate(inner, benchmark, names[text_col]).where("NOT contaminated").select(*[F.col(n).alias(c) for c, n in names.items()])
