"""What the corpus operators share: reading, cutting lineage, numbering rows without a
single-task sort, fixed-size bitmap filters and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.lake import unused
from ..sources.store import cut, discard, release, scratch_path, shared_dir

__all__ = ["bitmap", "bytes_of", "components", "cut", "discard", "filter_bits", "largest_group", "maybe_in", "numbered", "release", "scratch_path", "shared_dir", "slices", "spread", "table", "unused"]

#: Rows that one numbering window holds on average.
BUCKET_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(text: str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.octet_length(F.coalesce(F.col(text), F.lit("")))


def slices(batch: pa.RecordBatch, rows: int = 250) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many rows: bounds what Python copies of long values hold at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def spread(order_hash: Column, buckets: int) -> Column:
    """A bucket from 0 to buckets - 1 that never falls as a 64-bit hash rises."""
    top = F.shiftright(order_hash, 32) + F.lit(2**31)
    return F.floor(top * F.lit(buckets) / F.lit(2.0**32)).cast("long")


def numbered(df: DataFrame, group: list[str], order: list[str], largest: int, number: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Adds `number`: 0, 1, ... within each group, by order[0] (a 64-bit hash), then the rest of order.

    sums: for each new column, the column whose sum over the preceding rows of the group it
    gets. largest: the rows of the largest group. Groups are split by the hash into buckets of
    about BUCKET_ROWS rows at most, each sorted by itself; the buckets' totals give the offsets.
    So no task sorts a whole group, however large.
    """
    sums = sums or {}
    df = df.withColumn("_bucket", spread(F.col(order[0]), max(1, math.ceil(largest / BUCKET_ROWS))))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())))
    starts = totals.select(
        *(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"),
        *(F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_from{i}") for i in range(len(sums))),
    )
    ranked = df.withColumn("_rank", F.row_number().over(within) - 1)
    for i, c in enumerate(sums.values()):
        ranked = ranked.withColumn(f"_sum{i}", F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c))
    same = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return ranked.join(starts, same).select(
        *(c for c in df.columns if c != "_bucket"),
        (F.col("_rank") + F.col("_from")).cast("long").alias(number),
        *((F.col(f"_sum{i}") + F.col(f"_from{i}")).alias(new) for i, new in enumerate(sums)),
    )


def largest_group(df: DataFrame, group: list[str]) -> int:
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def filter_bits(rows: int, most: int = 28) -> int:
    """Bits (as a power of two) of a filter of so many hashes: 128 for each, 2**most (32 MB) in all at most.

    Beyond some ten million hashes a filter lets more rows through that it need not; none is lost.
    """
    return min(most, max(16, math.ceil(math.log2(128 * max(1, rows)))))


def bitmap(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """A filter of 2**bits bits over a 64-bit hash column: rows (_word, _map) of 4 KB each.

    Its size depends on bits alone (2**bits / 32768 rows), so it may be broadcast.
    """
    at = F.col(column).bitwiseAND(F.lit(2**bits - 1))
    return hashes.select(F.bitmap_bucket_number(at + 1).alias("_word"), F.bitmap_bit_position(at + 1).alias("_bit")).groupBy("_word").agg(F.bitmap_construct_agg("_bit").alias("_map"))


def maybe_in(df: DataFrame, column: str, filter_: DataFrame, bits: int, how: str = "left_semi") -> DataFrame:
    """Rows whose hash may be in the filter: all that are, and a few that are not. left_anti: the others."""
    at = F.col(column).bitwiseAND(F.lit(2**bits - 1))
    bit = F.bitmap_bit_position(at + 1)
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(filter_), (F.bitmap_bucket_number(at + 1) == F.col("_word")) & hit, how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (u, v): rows (node, component).

    component is the smallest node reachable. Alternating large-star and small-star rounds
    (Kiveris et al., 2014): each is a grouped minimum, which combines before the shuffle, and
    a join whose hot node adaptive execution splits. Every round is cut into the shared folder,
    and rounds go on until one changes nothing.
    """
    e = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v")))
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(e.select("v", "v").distinct()).toDF("node", "component")
        state = now
