"""Retrieval measures: joins with the ground truth and windows over ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def at_cutoffs(results: DataFrame, truth: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(query, k, tp, fp, precision, recall, f1) for each query of results or truth.

    results: (query, candidate, rank); truth: (query, candidate). Nothing found: precision 0.
    Nothing to find: recall 1, and with nothing found precision 1 too.
    """
    hits = results.join(truth.distinct().withColumn("hit", F.lit(1)), ["query", "candidate"], "left")
    per = hits.select("query", F.explode(F.array(*map(F.lit, cutoffs))).alias("k"), "rank", "hit").where("rank <= k").groupBy("query", "k").agg(F.count(F.lit(1)).alias("found"), F.count("hit").alias("tp"))
    wanted = truth.distinct().groupBy("query").agg(F.count(F.lit(1)).alias("wanted"))
    grid = results.select("query").union(truth.select("query")).distinct().select("query", F.explode(F.array(*map(F.lit, cutoffs))).alias("k"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    all_ = grid.join(per, ["query", "k"], "left").join(wanted, "query", "left").select("query", "k", zero("found"), zero("tp"), zero("wanted"))
    p = F.when(F.col("found") > 0, F.col("tp") / F.col("found")).when(F.col("wanted") == 0, 1.0).otherwise(0.0)
    r = F.when(F.col("wanted") > 0, F.col("tp") / F.col("wanted")).otherwise(1.0)
    f = F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0)
    return all_.select("query", "k", "tp", (F.col("found") - F.col("tp")).alias("fp"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def macro(measures: DataFrame) -> DataFrame:
    """(k, precision, recall, f1, precision_std): means over the queries, and the population's deviation."""
    return measures.groupBy("k").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")), F.round(F.stddev_pop("precision"), 6).alias("precision_std"))


def average_precision(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(query, ap): a candidate that comes again counts once; the sum of precisions at hits over what there is to find."""
    once = results.groupBy("query", "candidate").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query").orderBy("rank")
    at = once.withColumn("i", F.row_number().over(w)).join(truth.distinct().withColumn("hit", F.lit(1)), ["query", "candidate"], "left")
    hits = at.withColumn("seen", F.count("hit").over(Window.partitionBy("query").orderBy("i"))).where("hit = 1").groupBy("query").agg(F.sum(F.col("seen") / F.col("i")).alias("s"))
    wanted = truth.distinct().groupBy("query").agg(F.count(F.lit(1)).alias("wanted"))
    return wanted.join(hits, "query", "left").select("query", F.round(F.coalesce("s", F.lit(0.0)) / F.col("wanted"), 6).alias("ap"))
