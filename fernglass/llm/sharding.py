"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_unit, running_before


def _cost(key: Column, shard: int, weight: float) -> Column:
    return F.struct((-F.log(hash_unit(key, F.lit(shard))) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(cost, shard) of the shard (int, from 0) that holds the key.

    Each pair of key and shard has a fixed uniform value u; the shard with the least -ln(u) / weight holds the key.
    So a shard gets a share of the keys in proportion to its weight; a further shard takes keys from all others
    and moves none between them; a change of one weight moves keys to or from that shard only. A weight of 0 takes
    no keys. Equal costs go to the lower shard. A null key counts as an empty string.
    """
    costs = [_cost(key, s, w) for s, w in enumerate(weights) if w > 0]
    if not costs:
        raise ValueError("at least one shard needs a positive weight")
    return F.least(*costs) if len(costs) > 1 else costs[0]


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0) -> DataFrame:
    """Deals rows to shards by their key alone.

    Returns key, size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32 (unsigned, of the UTF-8
    bytes; null for a null text), law ('key'), shard, slot (place in the shard, gapless from 0, in an order given
    by a hash of the key) and grown_shard (the shard once another of grown_weight is added). Rows with the same key
    meet in one shard and get slots of their own. Other columns aren't read, whatever their names. An empty table
    gives an empty result.
    """
    k, t = F.col(key), F.col(text).cast("string")
    dealt = df.select(
        k.alias(key),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(k, weights).alias("_best"),
        hash_unit(k).alias("_u"),
    )
    grown = F.least("_best", _cost(F.col(key), len(weights), grown_weight))
    dealt = dealt.select(key, "size", "text_crc32", "law", F.col("_best.shard").alias("shard"), grown["shard"].alias("grown_shard"), "_u")
    slots = running_before(cut(dealt), ["shard"], ["_u", key, "text_crc32", "size"], F.lit(1), "slot")
    return slots.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
