"""Hashes of privacy-unit keys: 64 bits, bit j of which says whether the unit is in world j."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PrivacyConfig, signed

def key_hash(key: Column, algorithm: str = "xxhash64") -> Column:
    """A signed 64-bit hash; null for a null key. `md5` takes the digest's first 16 hex digits, which any engine has."""
    if algorithm == "md5":
        return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 16), 16, -10).cast("long")
    return F.when(key.isNotNull(), F.xxhash64(key))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A second hash, by multiplication and shifts."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def repair(values: np.ndarray) -> np.ndarray:
    """Hashes with exactly 32 bits set: as many set (or unset) bits as are too many (or few) are flipped, those that a second
    hash of value and place puts first."""
    out, places = np.empty(len(values), np.uint64), np.arange(64, dtype=np.uint64)
    for at in range(0, len(values), 1 << 14):
        x = values[at : at + (1 << 14)].astype(np.uint64)
        bits = (x[:, None] >> places) & np.uint64(1) == 1
        surplus = bits.sum(axis=1) - 32
        wrong = bits == (surplus > 0)[:, None]
        first = np.where(wrong, _mixed(x[:, None] ^ _mixed(places + np.uint64(1))), np.uint64((1 << 64) - 1))
        rank = first.argsort(axis=1, kind="stable").argsort(axis=1)
        bits ^= wrong & (rank < np.abs(surplus)[:, None])
        out[at : at + len(x)] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _repair_series(h: pd.Series) -> pd.Series:
    there = h.notna().to_numpy()
    out = pd.Series([None] * len(h), dtype="Int64")
    out[there] = repair(h[there].astype("int64").to_numpy().view(np.uint64)).view(np.int64)
    return out


def pac_hash(h: Column, query_hash: int, repaired: bool = False) -> Column:
    """A key hash scrambled for one query; with `repaired`, exactly half of the worlds hold each unit."""
    mixed = h.bitwiseXOR(F.lit(signed(query_hash)))
    return F.pandas_udf(_repair_series, "long")(mixed) if repaired else mixed


def pu_hash(keys: list[Column], config: PrivacyConfig) -> Column:
    """The membership bits of a unit; parts of a composite key are hashed apart and combined by xor."""
    parts = [key_hash(k, config.pac_hash) for k in keys]
    return pac_hash(reduce(lambda a, b: a.bitwiseXOR(b), parts), config.query_hash, config.pac_hash_repair)
