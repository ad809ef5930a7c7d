"""Stable identifiers, hash splits and shuffle keys, all in the JVM."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 16 hex digits of sha1 over the parts joined by pipes; a null part is empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(joined.cast("binary")), 1, 16))


def box_text(b: Column) -> Column:
    return F.format_string("(%d, %d, %d, %d)", b.x1, b.y1, b.x2, b.y2)


def bucket(value: Column, seed: int, modulus: int = 10_000) -> Column:
    """sha256 of "seed:value" as one big number, modulo: eight 32-bit pieces weighed by their place."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")).cast("binary"), 256)
    total = F.lit(0).cast("long")
    for k in range(8):
        total = total + F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") * pow(16, 8 * (7 - k), modulus)
    return total % modulus


def split_name(value: Column, fraction: float, seed: int) -> Column:
    """val for a share of keys, train for the others; rows of one key never part."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    return F.when(bucket(value, seed) < int(fraction * 10_000), "val").otherwise("train")


def group_key(*fields: str) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))


def shuffle_key(value: Column, seed: int) -> Column:
    """A distributed, reproducible random order: sort by this, then by the id."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")).cast("binary"), 256)


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
