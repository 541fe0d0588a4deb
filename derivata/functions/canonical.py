"""Canonical JSON and digests, time stamps, and names."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DIGEST = "^[0-9a-f]{64}$"


def canonical_json(document, ascii_only: bool = False) -> str:
    """Sorted keys, no blanks; NaN and infinities are refused."""
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)


def digest_of(document, ascii_only: bool = False) -> str:
    return hashlib.sha256(canonical_json(document, ascii_only).encode("utf-8")).hexdigest()


def _canonical_udf(ascii_only: bool):
    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else canonical_json(json.loads(x), ascii_only))

    return run


def canonical_column(text: Column, ascii_only: bool = False) -> Column:
    """The canonical form of JSON texts. to_json neither sorts keys nor keeps nulls, hence an Arrow function."""
    return _canonical_udf(ascii_only)(text)


def digest_column(text: Column, ascii_only: bool = False) -> Column:
    return F.sha2(canonical_column(text, ascii_only), 256)


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike(DIGEST), F.lit(False))


def stamp(text: Column) -> Column:
    """A timestamp from ISO 8601 with an offset; null without one."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))


def base_name(path: Column, most: int = 255) -> Column:
    return F.substring(F.trim(F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)/*$", 1)), 1, most)


def padded_id(prefix: str, number: Column, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.format_string(f"%0{digits}d", number.cast("bigint")))


def three_decimals(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.3f", value)).otherwise("not evaluated")


def frame_times(duration: Column, fps: float, most: int) -> Column:
    """0, 1/fps, ... below the duration, at most so many."""
    n = F.least(F.ceil(duration * fps), F.lit(most)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i / F.lit(float(fps)))).otherwise(F.array().cast("array<double>"))


def merged_maps(first: Column, second: Column) -> Column:
    """Both maps' entries; the second's where both have a key. A null map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(first, empty), F.coalesce(second, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def nested(document: Column, path: str, default: str) -> Column:
    """A field of a JSON text by its path, or a default where it is absent or null."""
    return F.coalesce(F.get_json_object(document, f"$.{path}"), F.lit(default))


def random_id(prefix: str) -> Column:
    """A new random id; digests of content are the ids that repeat."""
    return F.concat(F.lit(f"{prefix}_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))
