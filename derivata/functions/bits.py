"""Hash and score expressions: 64-bit perceptual hashes in bigint, 32-bit fingerprints, distances and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 64
UINT32 = 0xFFFFFFFF


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside higher-order functions nothing shares an expression."""
    return F.get(F.transform(F.array(value), body), 0)


def hash_from_hex(hex_text: Column) -> Column:
    """The signed bigint of a 16-digit hex hash; null where it isn't one."""
    clean = F.lower(F.trim(hex_text))
    return F.when(clean.rlike("^[0-9a-f]{1,16}$"), F.conv(clean, 16, -10).cast("bigint"))


def hash_to_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; 64 where either is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(HASH_BITS))


def hamming_hex(a: Column, b: Column) -> Column:
    return hamming(hash_from_hex(a), hash_from_hex(b))


def hamming32(a: Column, b: Column) -> Column:
    """Differing bits of two 32-bit values kept in bigint, whatever their sign was."""
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(UINT32)))


def score64(distance: Column) -> Column:
    """1 at no distance, 0 at 32 bits and beyond."""
    return F.greatest(F.lit(0.0), 1 - distance / F.lit(32.0))


def score32(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / F.lit(16.0))


def hash_from_coefficients(vector: Column) -> Column:
    """64 coefficients to bits: the first counts as 0, a bit is 1 above the median, first coefficient highest."""
    v = F.transform(vector, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x.cast("double")))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(63) - i)
    pack = lambda v, median: F.aggregate(F.transform(v, lambda x, i: F.when(x > median, bit(i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    middle = lambda v: let(F.sort_array(v), lambda s: (F.get(s, 31) + F.get(s, 32)) / 2)
    return F.when(F.size(vector) == HASH_BITS, let(v, lambda v: let(middle(v), lambda m: pack(v, m))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; null for empty vectors or unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    value = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-12))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def chained(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first case that holds."""
    return reduce(lambda tail, case: F.when(case[0], case[1]).otherwise(tail), reversed(cases), otherwise)
