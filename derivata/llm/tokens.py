"""BPE encoding and decoding of text columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .words import released, slices


def _texts(words: bpe.Speculator, buf, off, ids, cuts):
    """Decoded bytes and their offsets; where they differ from the source, as the library's lossy decoding has them."""
    n = words.flat_n[ids]
    ends = np.concatenate([[0], np.cumsum(n)])[cuts]
    out = words.decode(ids)
    if np.array_equal(ends, off) and np.array_equal(out, buf):
        return out.tobytes(), ends
    parts = [out[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return b"".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _rows(words: bpe.Speculator, batch: pa.RecordBatch, digests: bool) -> pa.RecordBatch:
    buf, off, ids, cuts = bpe.encoded(words, batch.column(batch.schema.get_field_index("text")))
    data, ends = _texts(words, buf, off, ids, cuts)
    keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
    at, to = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)), list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    n = pa.array(np.diff(cuts).astype(np.int64))
    if digests:
        raw = ids.astype("<u4").tobytes()
        more = [n, pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in at], pa.string()), pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in to], pa.string())]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    else:
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids, pa.int32()))
        more = [n, lists, pa.array([data[a:b].decode() for a, b in to], pa.string())]
        names = ["n_tokens", "ids", "decoded"]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *more], names=[*(batch.schema.names[i] for i in keep), *names])


def _run(path: str, digests: bool):
    def run(batches):
        words = bpe.speculator(path)
        with released():
            for whole in batches:
                for batch in slices(whole, "text"):
                    yield _rows(words, batch, digests)

    return run


def _applied(docs: DataFrame, text_col: str, path: str | None, extra: str, digests: bool) -> DataFrame:
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text_col or not digests}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = ", ".join(f"{n} {t}" for n, t in inner.dtypes if n != "text")
    out = inner.mapInArrow(_run(path or bpe.default_path(), digests), f"{kinds}, {extra}")
    taken = {x.split()[0] for x in extra.split(", ")}
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in taken], *[x.split()[0] for x in extra.split(", ")])


def bpe_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids (array of int) and decoded, the text that the ids give back.

    A null text is empty: no ids, and an empty decoded text. Strings of special tokens in a text are encoded as these
    tokens, as the library does by default. Columns named like the new ones are replaced, others pass unchanged."""
    return _applied(docs, text_col, path, "n_tokens bigint, ids array<int>, decoded string", False)


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_tokens, and the digests of ids (little-endian unsigned 32-bit) and of the decoded text."""
    return _applied(docs.select(id_col, text_col), text_col, path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", True)
