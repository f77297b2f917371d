"""Exact deduplication by a log-structured merge index of text digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, cut, discard, filter_bits, maybe_in, scratch_path

#: Rows of a memtable, and so of a run of level 0.
MEMTABLE_ROWS = 250_000
#: Runs of one level that compaction merges into one of the next.
FAN_IN = 8


class DigestIndex:
    """A log-structured merge index: digest -> the identifier that stays.

    Level 0: each task that reads a batch is a writer; its rows, sorted by digest, leave it in
    files of MEMTABLE_ROWS rows at most, with minima and maxima in their footers. Once FAN_IN
    batches have come they are merged into one of the next level, so a digest is rewritten once a
    level; merged runs are removed. compact() merges all that is left. A merge combines equal
    digests in the task that reads them, then in the task of their digest: the identifier that
    stays and the number of rows remain, again in digest order. lookup() reads a run only for
    digests that pass its filter, a bitmap that the first lookup writes beside it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "min"):
        if keep not in ("min", "max"):
            raise ValueError("keep must be 'min' or 'max'")
        self.spark, self.path, self.keep = spark, path or scratch_path(spark, "digests"), keep
        #: Per level, the folders of its runs; each has a filter beside it.
        self.levels: list[list[str]] = [[]]
        self._made = 0
        self._bits: dict[str, int] = {}

    def _write(self, rows: DataFrame, level: int) -> None:
        run = f"{self.path}/level-{level:02d}-{self._made:05d}"
        self._made += 1
        rows.write.option("maxRecordsPerFile", MEMTABLE_ROWS).parquet(run)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def flush(self, rows: DataFrame) -> None:
        """Adds a batch of (digest, id); full levels are merged into the next."""
        self._write(rows.select("digest", "id", F.lit(1).cast("long").alias("rows")).sortWithinPartitions("digest"), 0)
        level = 0
        while len(self.levels[level]) >= FAN_IN:
            self._merge(level, level + 1)
            level += 1

    def _merged(self, runs: list[str]) -> DataFrame:
        best = F.min if self.keep == "min" else F.max
        return self.spark.read.parquet(*runs).groupBy("digest").agg(best("id").alias("id"), F.sum("rows").alias("rows")).sortWithinPartitions("digest")

    def _merge(self, level: int, into: int) -> None:
        old = self.levels[level]
        self.levels[level] = []
        self._write(self._merged(old), into)
        for run in old:
            discard(self.spark, run)
            discard(self.spark, f"{run}-filter")

    def compact(self) -> DataFrame:
        """Merges all levels into one run, and returns it: digest, id, rows."""
        every = [run for level in self.levels for run in level]
        if not every:
            return self.spark.createDataFrame([], "digest string, id long, rows long")
        top = len(self.levels)
        self.levels = [[] for _ in range(top)]
        self.levels[top - 1] = every
        self._merge(top - 1, top)
        return self.spark.read.parquet(self.levels[top][0])

    def _filter(self, run: str) -> tuple[DataFrame, int]:
        """A run's filter and its bits; it is written once."""
        path = f"{run}-filter"
        if run not in self._bits:
            held = self.spark.read.parquet(run)
            self._bits[run] = filter_bits(held.count())
            bitmap(held.select(F.xxhash64("digest").alias("h")), "h", self._bits[run]).write.parquet(path)
        return self.spark.read.parquet(path), self._bits[run]

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, id, rows) of those digests that the index holds; a run is read for the digests that pass its filter."""
        found = None
        asked = digests.select("digest").distinct().withColumn("_h", F.xxhash64("digest"))
        for run in (run for level in self.levels for run in level):
            hits = maybe_in(asked, "_h", *self._filter(run)).select("digest")
            part = self.spark.read.parquet(run).join(hits, "digest", "left_semi")
            found = part if found is None else found.union(part)
        if found is None:
            return self.spark.createDataFrame([], "digest string, id long, rows long")
        best = F.min if self.keep == "min" else F.max
        return found.groupBy("digest").agg(best("id").alias("id"), F.sum("rows").alias("rows"))


def exact_groups(docs: DataFrame, *, keep: str = "min", id: str = "doc_id", text: str = "text", digest: Column | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts hold the same bytes; null counts as empty. Of equal rows the
    smallest id stays (keep="max": the largest). digest: the index's key (default: SHA-256 of the
    text); whatever it is, hits count only after their bytes prove equal, and those of a digest
    whose bytes differ are grouped by their bytes.

    Repeated rows: if several rows carry the id that stays, all of them have kept = true. A null
    id stays only where a group has no other; then keep_id is null. An empty table gives an empty
    result; columns of other names are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    rows = rows.withColumn("digest", F.col("sha") if digest is None else digest)
    index = DigestIndex(spark, keep=keep)
    index.flush(rows)
    merged = index.compact()
    groups = merged.where("rows > 1").select(F.col("digest").alias("d"), F.col("id").alias("keep"), F.col("rows").alias("size"))
    # Hits: the texts of rows whose digest came more than once, and few others, go to a shuffle. Equal least
    # and greatest bytes prove all of a digest's equal; both combine in the reading task, so a group of
    # copies, however large, sends one text from each task.
    bits = filter_bits(groups.count())
    shared = bitmap(groups.select(F.xxhash64("d").alias("h")), "h", bits)
    hits = maybe_in(rows.withColumn("h", F.xxhash64("digest")), "h", shared, bits)
    checked = cut(hits.groupBy("digest").agg((F.min("text") == F.max("text")).alias("same")))
    one = lambda keep, size: (F.col("id").alias(id), keep.alias("keep_id"), size.cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
    known = rows.select("id", "sha", "digest").join(groups, F.col("digest") == F.col("d"), "left")
    single = F.col("d").isNull()
    odd = checked.where("not same").select("digest")
    if odd.isEmpty():
        return known.select(*one(F.when(single, F.col("id")).otherwise(F.col("keep")), F.when(single, F.lit(1)).otherwise(F.col("size"))))
    # Digests whose bytes differ (none with SHA-256): their rows are grouped by the bytes themselves.
    sure = known.join(odd, "digest", "left_anti").select(*one(F.when(single, F.col("id")).otherwise(F.col("keep")), F.when(single, F.lit(1)).otherwise(F.col("size"))))
    apart = rows.join(odd, "digest", "left_semi")
    by_bytes = apart.groupBy(F.col("text").alias("t")).agg((F.min if keep == "min" else F.max)("id").alias("keep"), F.count(F.lit(1)).alias("size"))
    return sure.union(apart.join(by_bytes, F.col("text") == F.col("t")).select(*one(F.col("keep"), F.col("size"))))
