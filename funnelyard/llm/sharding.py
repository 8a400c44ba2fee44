"""Sharding: jump consistent hashing of stable keys, without a ring table (Lamping and Veach, 2014).

A key's shard depends on the key and the number of shards only. Growing from n to n + 1 shards moves a
1 / (n + 1) share of the keys, every one of them into the new shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelyard.llm.common import drop_clashing, rank_within

#: Fixed value: the multiplier of the published generator, as high and low 32 bits.
_MULTIPLIER = 2862933555777941757
_C_HIGH, _C_LOW = divmod(_MULTIPLIER, 1 << 32)
_MASK = (1 << 32) - 1


def key_halves(*keys: Column) -> tuple[Column, Column]:
    """High and low 32 bits of a key's 64-bit seed: the first 16 hex digits of an md5 over its text.

    Null and empty keys differ, and so do ("a", "bc") and ("ab", "c"): each part carries its length.
    """
    parts = [F.when(k.isNull(), F.lit("n")).otherwise(F.concat(F.length(k.cast("string")), F.lit(":"), k.cast("string"))) for k in keys]
    digest = F.md5(F.concat(*parts))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return half(1), half(9)


def _times(h: Column, lo: Column) -> tuple[Column, Column]:
    """(h, lo) * multiplier + 1 modulo 2**64, in limbs that stay below 2**63."""
    c1, c0 = divmod(_C_LOW, 1 << 16)
    p1 = lo * c1
    s = lo * c0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(s, 32) + F.shiftright(p1, 16)
    high = (carry + h * c0 + F.shiftleft((h * c1).bitwiseAND(0xFFFF), 16)
            + lo * (_C_HIGH & 0xFFFF) + F.shiftleft((lo * (_C_HIGH >> 16)).bitwiseAND(0xFFFF), 16))
    return high.bitwiseAND(_MASK), s.bitwiseAND(_MASK)


def jump(h: Column, lo: Column, shards: int) -> Column:
    """struct(b: shard among `shards`, j: the least shard count under which the key would move on).

    The published loop ends after about ln(shards) jumps. It runs for many more steps than that; for
    the (practically unseen) rest, `when` runs the loop for as many steps as it can ever take.
    """
    def step(s: Column, _: Column) -> Column:
        high, low = _times(s["h"], s["l"])
        leap = (s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double"))
        moved = F.struct(s["j"].alias("b"), F.floor(leap).cast("long").alias("j"), high.alias("h"), low.alias("l"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), h.alias("h"), lo.alias("l"))
    first = min(shards, 16 + 8 * math.ceil(math.log(shards + 1)))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(first)), start, step)
    if first < shards:
        out = F.when(out["j"] >= shards, out).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step))
    return out


def assign_shards(df: DataFrame, keys: list[str], shards: int, grown: str | None = "grown_shard") -> DataFrame:
    """Adds `shard` (0 to shards - 1) and, unless `grown` is None, the shard with one shard more.

    Row-local: no shuffle and no state. All columns of `df` stay; columns named like the new ones are
    replaced. Rows with equal keys, null keys among them, share a shard; an empty table stays empty.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    out = drop_clashing(df, [c for c in ("shard", grown) if c and c not in keys])
    out = out.withColumn("__jump", jump(*key_halves(*[F.col(f"`{k}`") for k in keys]), shards))
    out = out.withColumn("shard", F.col("__jump.b").cast("int"))
    if grown:
        out = out.withColumn(grown, F.when(F.col("__jump.j") == shards, F.lit(shards)).otherwise(F.col("shard")).cast("int"))
    return out.drop("__jump")


def number_slots(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Adds `slot`, gapless from 0 inside each shard, without holding a shard in one task."""
    return rank_within(drop_clashing(df, ["slot"]), ["shard"], order, shards, "slot")
