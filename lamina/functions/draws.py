"""Deterministic draws from hashes of stable keys: the same on every cluster and in SQL."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(parts: tuple) -> Column:
    return F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def h32(*key) -> Column:
    """A whole number from 0 to 2^32 - 1: the first 8 hex digits of the key's MD5."""
    return F.conv(F.left(F.md5(_text(key).cast("binary")), F.lit(8)), 16, 10).cast("long")


def order_key(*key) -> Column:
    """A key to sort by for a seeded shuffle."""
    return F.md5(_text(key).cast("binary"))


def unit(*key) -> Column:
    """A number in (0, 1)."""
    return (h32(*key) + 0.5) / float(1 << 32)


def below(n: Column | int, *key) -> Column:
    """A whole number from 0 to n - 1."""
    return F.pmod(h32(*key), n if isinstance(n, Column) else F.lit(n))


def weighted_clock(weight: Column, *key) -> Column:
    """Keys whose smallest k are a draw of k without replacement in proportion to weight; null for weights <= 0."""
    return F.when(weight > 0, -F.log(unit(*key)) / weight)


def blake2b(text: Column | str, size: int = 8) -> Column:
    """A BLAKE2b digest of a text's UTF-8 bytes, `size` bytes as hex: for keys that other systems made. No JVM
    function has it, so this is a pandas function; SHA-2 and MD5 are native."""
    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.blake2b(t.encode(), digest_size=size).hexdigest() if isinstance(t, str) else None)

    return digest(text)
