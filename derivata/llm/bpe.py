"""Byte-level BPE over Arrow batches: vectorised splitting, then tokens for distinct words only.

The splitter finds the word bounds of the byte-level pattern (contractions, then runs of letters, of numbers or of
other symbols with one space before, then white space) from each code point's class, for a whole batch at once. What
class a code point has is asked of the tokenizers library, once a code point, so both agree on Unicode.

:class:`Speculator` encodes words by speculation: greedy longest match proposes tokens; a proposal is the exact BPE
result if and only if every adjacent pair is compatible, that is if no merge across the border happens before one of
its two sides is absorbed by its own token. All pairs of a batch are tested at once; only failing words are merged
exactly. :class:`Library` has the tokenizers library encode each distinct word.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa

from .words import SEGMENT, hash_spans, same_spans, text_buffers

_LETTER, _NUMBER, _OTHER, _SPACE, _UNKNOWN = 1, 2, 3, 4, 255
#: The contractions that the byte-level pattern splits off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Bytes of distinct words, with their ids, that a worker keeps, about, before it starts anew.
MOST_BYTES = 96 << 20
#: A place where a text can be cut: the blank begins a word whatever stands before.
_CUT = re.compile(rb"[0-9A-Za-z] (?=[0-9A-Za-z])")


def default_path() -> str:
    """The file of the public byte-level vocabulary; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(2)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(1)
def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class Splitter:
    """Word bounds of the byte-level pattern; special tokens are words of their own."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        spec = json.loads(self.tokenizer.to_str())
        added, before, model = spec["added_tokens"], spec["pre_tokenizer"] or {}, spec["model"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that match with their surroundings are not supported")
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level splitting without a normalizer or a prefix blank is supported")
        if model["type"] != "BPE" or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "dropout", "ignore_merges")):
            raise ValueError("only plain byte-level BPE is supported")
        self.special = sorted((t["content"].encode() for t in added), key=len, reverse=True)

    def _ask(self, c: int) -> int:
        if 0xD800 <= c < 0xE000:
            return _OTHER
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for kind, before in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")):
            if len(pieces(before + chr(c))) == 1:
                return kind
        return _SPACE

    def _classes(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (new := points[kinds == _UNKNOWN]).size:
            for c in np.unique(new).tolist():
                self.kinds[c] = self._ask(c)
            kinds = self.kinds[points]
        return kinds

    def _specials(self, data: bytes, off: np.ndarray) -> list[tuple[int, int]]:
        found, at = [], 0
        hits = {s: data.find(s) for s in self.special}
        while hits := {s: p if p >= at else data.find(s, at) for s, p in hits.items() if p >= 0}:
            hits = {s: p for s, p in hits.items() if p >= 0}
            if not hits:
                break
            s = min(hits, key=lambda s: (hits[s], -len(s)))
            p, at = hits[s], hits[s] + 1
            if np.searchsorted(off, p, "right") == np.searchsorted(off, p + len(s), "left"):  # inside one document
                found.append((p, p + len(s)))
                at = p + len(s)
        return found

    def parts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray | None:
        """Edges of parts of about ``SEGMENT`` bytes, document edges among them; None where the whole is short."""
        if len(buf) <= 2 * SEGMENT or any(b" " in s for s in self.special):
            return None
        data, out = buf.tobytes(), [0]
        for end in off[1:].tolist():
            while end - out[-1] > 2 * SEGMENT and (m := _CUT.search(data, out[-1] + SEGMENT, end)):
                out.append(m.start() + 1)
            if end > out[-1]:
                out.append(end)
        return np.array(out)

    def split(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts of all words, which tile the buffer, and the index of each document's first word."""
        if not len(buf):
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        data = buf.tobytes()
        lead = (buf & 0xC0) != 0x80
        places = np.flatnonzero(lead)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
        kinds = self._classes(points)
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        special = self._specials(data, off)
        for a, b in special:
            edge[[a, b]] = True
        first = edge[places]
        last = np.append(first[1:], True)
        before = np.concatenate([[0], kinds[:-1]]).astype(np.uint8)
        before[first] = 0
        after = np.append(kinds[1:], 0).astype(np.uint8)
        after[last] = 0
        space = kinds == _SPACE
        blank = np.concatenate([[False], points[:-1] == 0x20]) & ~first
        start = np.where(space, (before != _SPACE) | ((after != 0) & (after != _SPACE)), (before != kinds) & ~blank)
        self._contractions(points, first, start)
        if special:
            number = np.searchsorted(places, [x for a, b in special for x in (a, b)])
            for a, b in zip(number[::2], number[1::2], strict=True):
                start[a:b] = False
                start[a] = True
        starts = places[start]
        return starts, np.searchsorted(starts, off)

    def _contractions(self, points: np.ndarray, first: np.ndarray, start: np.ndarray) -> None:
        at = np.flatnonzero((points == 0x27) & start)
        n = len(points)
        for suffix in CONTRACTIONS:
            end = at + 1 + len(suffix)
            ok = end <= n
            for i, c in enumerate(suffix):
                p = np.minimum(at + 1 + i, n - 1)
                ok &= (points[p] == ord(c)) & ~first[p]
            hit = at[ok]
            start[hit + 1] = False
            rest = hit + 1 + len(suffix)
            rest = rest[rest < n]
            # What is left of the letter run is a word; other kinds have their start already.
            start[rest[(self.kinds[points[rest]] == _LETTER) & ~first[rest]]] = True
            at = at[~ok]


class _Index:
    """Numbers of 64-bit hashes in sorted arrays: a large one, and a small one of what came last.

    A Python dictionary of as many words takes several times the memory, which idle workers keep."""

    def __init__(self):
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is new."""
        out = np.full(len(hashes), -1, np.int64)
        for known, numbers in self.parts:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                same = known[at] == hashes
                out[same] = numbers[at[same]]
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        self.parts[1] = self._joined(self.parts[1], (hashes, numbers.astype(np.int32)))
        if len(self.parts[1][0]) > 50_000 + len(self.parts[0][0]) // 4:
            self.parts = [self._joined(*self.parts), (np.zeros(0, np.uint64), np.zeros(0, np.int32))]

    @staticmethod
    def _joined(a, b):
        hashes, numbers = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], numbers[order]


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 10, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(len(values), len(self.data) // 2), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class _Words:
    """Token ids of distinct words, kept between batches. A word is found by its hash and known by its bytes.

    What is kept is bounded by ``MOST_BYTES``; beyond, the worker starts anew."""

    def __init__(self, path: str):
        self.path, self.splitter = path, Splitter(path)
        self.forget()

    def forget(self) -> None:
        self.index = _Index()
        self.spelling, self.ids = _Grown(np.uint8), _Grown(np.int32)
        self.ids_end, self.spelling_end = _Grown(np.int32), _Grown(np.int32)
        self.ids_end.add(np.zeros(1))
        self.spelling_end.add(np.zeros(1))

    def held(self) -> int:
        """Bytes of what is kept, about."""
        return self.spelling.n + 4 * self.ids.n + 20 * self.ids_end.n

    def of_words(self, words: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Encode words and keep them; their numbers."""
        k = self.ids_end.n - 1
        found = self.of_words(words)
        n = np.fromiter(map(len, found), np.int64, len(found))
        self.ids_end.add(self.ids.n + np.cumsum(n))
        self.ids.add(np.fromiter(itertools.chain.from_iterable(found), np.int32, int(n.sum())))
        self.spelling_end.add(self.spelling.n + np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
        self.spelling.add(np.frombuffer(b"".join(words), np.uint8))
        return np.arange(k, k + len(words))

    def _part(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, first = self.splitter.split(buf, off)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        if self.held() > MOST_BYTES:
            self.forget()
        ends = np.append(starts[1:], len(buf))
        # Hashes only find what may be equal; the bytes decide, of words here and of words kept.
        distinct, where, back = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~same_spans(buf, starts, ends, buf, starts[where[back]], ends[where[back]]))
        number = self.index.find(distinct)
        known = np.flatnonzero(number >= 0)
        kept_end = self.spelling_end.data
        same = same_spans(buf, starts[where[known]], ends[where[known]], self.spelling.data, kept_end[number[known]], kept_end[number[known] + 1])
        number[known[~same]] = -1
        data = buf.tobytes()
        spelt = lambda at: [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        if len(new := np.flatnonzero(number < 0)):
            number[new] = self._learn(spelt(where[new]))
            fresh = np.setdiff1d(new, known)
            self.index.add(distinct[fresh], number[fresh])
        word = number[back]
        if len(odd):
            word[odd] = self._learn(spelt(odd))
        begin = self.ids_end.data[word].astype(np.int64)
        n = self.ids_end.data[word + 1] - begin
        stops = np.cumsum(n)
        ids = self.ids.data[np.arange(int(stops[-1])) - np.repeat(stops - n - begin, n)]
        return ids, np.concatenate([[0], stops])[first]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and where each one's begin (n + 1 values). Long texts go in parts that no word crosses."""
        edges = self.splitter.parts(buf, off)
        if edges is None:
            return self._part(buf, off)
        parts, stops = [np.zeros(0, np.int32)], [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            parts.append(self._part(buf[a:b], np.array([0, b - a]))[0])
            stops.append(stops[-1] + len(parts[-1]))
        return np.concatenate(parts), np.array(stops, np.int64)[np.searchsorted(edges, off)]


class Library(_Words):
    """Distinct words through the tokenizers library.

    Words of a space and something after it go to the library many at a time, as one text: it splits them before each
    space, and the tokens' lengths tell which are whose. Other words go one by one."""

    #: Words in one text.
    JOINED = 512

    def __init__(self, path: str):
        super().__init__(path)
        size = library(path).get_vocab_size(with_added_tokens=True)
        self.lens = np.array([len(library(path).id_to_token(i) or "") for i in range(size)], np.int64)

    def of_words(self, words: list[bytes]) -> list[list[int]]:
        many = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == 0x20 and w[1:2].isalpha()]
        chosen = set(many)
        single = [i for i in range(len(words)) if i not in chosen]
        runs = [many[k : k + self.JOINED] for k in range(0, len(many), self.JOINED)]
        texts = [b"".join([words[i] for i in run]).decode("utf-8") for run in runs] + [words[i].decode("utf-8") for i in single]
        got = [e.ids for e in library(self.path).encode_batch_fast(texts, add_special_tokens=False)]
        out: list[list[int]] = [[]] * len(words)
        for run, ids in zip(runs, got, strict=False):
            stops = np.cumsum(self.lens[ids])
            cuts = np.searchsorted(stops, np.cumsum([len(words[i]) for i in run])) + 1
            lo = 0
            for i, hi in zip(run, cuts.tolist(), strict=True):
                out[i] = ids[lo:hi]
                lo = hi
        for i, ids in zip(single, got[len(runs) :], strict=True):
            out[i] = ids
        return out


class Speculator(_Words):
    """Greedy proposals, tested by pair compatibility, with exact merging where a test fails."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte = {c: bytes([b]) for b, c in enumerate(byte_chars())}
        plain = lambda s: b"".join(byte[c] for c in s)
        self.token = {plain(s): i for s, i in model["vocab"].items()}
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*self.token.values(), *self.added.values()]) + 1
        self.size = size
        self.spelt: list[bytes] = [b""] * size
        for s, i in [*self.token.items(), *self.added.items()]:
            self.spelt[i] = s
        # The greatest length of a token by its first three bytes.
        self.reach: dict[bytes, int] = {}
        for t in self.token:
            if len(t) > 2:
                self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 2))
        # Merge r joins left[t] and right[t] into t; rank[t] = r. Bytes have rank -1 and no parts.
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.rank = np.full(size, -1)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.twice: set[int] = set()  # tokens that several merges make; words with them are merged exactly
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = plain(a), plain(b)
            x, y, t = self.token[a], self.token[b], self.token[a + b]
            self.merge[x, y] = (r, t)
            if self.left[t] >= 0:
                self.twice.add(t)
            self.left[t], self.right[t], self.rank[t] = x, y, r
        keys = np.array([x * size + y for x, y in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.sound = np.zeros(size, np.int8)  # 1: exact merging of its bytes gives the token; 2: it doesn't
        self.failed = self.proposed = 0
        lens = np.array([len(s) for s in self.spelt], np.int64)
        self.flat, self.flat_at, self.flat_n = np.frombuffer(b"".join(self.spelt), np.uint8), np.cumsum(lens) - lens, lens

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first, with a heap of the pairs that stand side by side."""
        ids = [self.token[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, t, x, y = heapq.heappop(heap)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = t, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merge.get((t, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], t, ids[after[i]]))
            if (k := before[i]) >= 0 and (m := self.merge.get((ids[k], t))):
                heapq.heappush(heap, (m[0], k, m[1], ids[k], t))
        return [t for t in ids if t >= 0]

    def _greedy(self, word: bytes) -> list[int]:
        out, at, n, token, reach = [], 0, len(word), self.token, self.reach
        while at < n:
            for end in range(min(n, at + reach.get(word[at : at + 3], 2)), at, -1):
                if (t := token.get(word[at:end])) is not None:
                    break
            out.append(t)
            at = end
        return out

    def _rank_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = x * self.size + y
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((x >= 0) & (y >= 0) & (self.pair_keys[at] == keys), self.pair_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether exact merging of the bytes of a and b gives (a, b), for sound tokens.

        While a is built, its last piece goes through a's right spine (a, its right part, that one's right part, ...),
        each until the rank at which the piece is absorbed; so does b's first piece through b's left spine. A merge of
        two such pieces ruins the border if it comes before x is absorbed, and no later than y is: equal pairs are
        merged from the left."""
        ok = np.ones(len(a), bool)
        never = np.iinfo(np.int64).max - 1
        todo = np.arange(len(a))
        x, x_end = a.astype(np.int64), np.full(len(a), never)
        while len(todo):
            y, y_end = b[todo].astype(np.int64), np.full(len(todo), never)
            part = np.arange(len(todo))
            while len(part):
                r = self._rank_of(x[part], y)
                bad = (r < x_end[part]) & (r <= y_end)
                ok[todo[part[bad]]] = False
                y, y_end = self.left[y], self.rank[y]
                go = (y >= 0) & ~bad
                part, y, y_end = part[go], y[go], y_end[go]
            x, x_end = self.right[x], self.rank[x]
            go = (x >= 0) & ok[todo]
            todo, x, x_end = todo[go], x[go], x_end[go]
        return ok

    def of_words(self, words: list[bytes]) -> list[list[int]]:
        out = [[self.added[w]] if w in self.added else self._greedy(w) for w in words]
        lens = np.array([len(x) for x in out])
        flat = np.fromiter((t for x in out for t in x), np.int64, int(lens.sum()))
        for t in np.unique(flat[self.sound[flat] == 0]).tolist():
            spelt = self.spelt[t]
            self.sound[t] = 1 if spelt in self.added or (t not in self.twice and self.exact(spelt) == [t]) else 2
        word = np.repeat(np.arange(len(out)), lens)
        bad = np.zeros(len(out), bool)
        bad[word[self.sound[flat] == 2]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)
        bad[word[inner[~fine[back]]]] = True
        self.proposed += len(out)
        self.failed += int(bad.sum())
        for i in np.flatnonzero(bad).tolist():
            out[i] = self.exact(words[i])
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, special tokens included."""
        n = self.flat_n[ids]
        return self.flat[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - self.flat_at[ids], n)]


@functools.lru_cache(2)
def speculator(path: str) -> Speculator:
    return Speculator(path)


@functools.lru_cache(2)
def by_library(path: str) -> Library:
    return Library(path)


def encoded(words: _Words, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, ids and id offsets of a text column (null: empty)."""
    buf, off = text_buffers(column)
    ids, cuts = words.encode(buf, off)
    return buf, off, ids, cuts
