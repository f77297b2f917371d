"""Sharding by rendezvous hashing: every (record key, shard) pair gets a score, the highest wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, largest_group, numbered


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a record key by weighted rendezvous hashing.

    A shard's score is -weight / ln(u), u in (0, 1) from a hash of key and shard; ties go to the
    lower shard. The key, the shard and the weights alone decide: adding a shard, or raising the
    weight of one, moves records only into it. A null key is a key like any other.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one of them positive")
    scores = []
    for shard, weight in enumerate(weights):
        # 52 bits of the hash, shifted by half a step: never 0 or 1.
        u = (F.call_function("shiftrightunsigned", F.xxhash64(key, F.lit(shard)), F.lit(12)) + F.lit(0.5)) / F.lit(2.0**52)
        if weight > 0:
            scores.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(-shard).alias("shard")))
    return (-F.array_max(F.array(*scores))["shard"]).cast("int")


def rendezvous_shards(docs: DataFrame, weights: list[float], *, grown: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts each row into a shard: key, size, text_crc32, law ('key'), shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 8. slot: 0, 1, ... without gaps in each
    shard, in an order that the key's hash gives. grown_shard: the shard under the weights
    `grown` (default: one more shard of the last weight).

    Nulls: a null text has size 8 and checksum 0; rows with a null key share one shard. Repeated
    rows stay, each with a slot of its own (ties by size and checksum; equal rows are alike). An
    empty table gives an empty result. Further columns are not read. Equal texts under
    different keys are placed independently: only the key decides.
    """
    grown = grown or [*weights, weights[-1]]
    rows = docs.select(
        F.col(key).alias("key"),
        (bytes_of(text) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = cut(rows.select("*", shard_of(F.col("key"), weights).alias("shard"), shard_of(F.col("key"), grown).alias("grown_shard"), F.xxhash64("key", "text_crc32", "size").alias("_h")))
    slots = numbered(placed, ["shard"], ["_h", "key", "size", "text_crc32"], largest_group(placed, ["shard"]), "slot")
    return slots.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
