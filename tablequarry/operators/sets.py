"""Exact set measures between columns: overlap, containment, Jaccard, posting lists and their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import cut

KEY = ["table_name", "column_name"]
PAIR = ["q_table", "q_column", "c_table", "c_column"]
#: Columns of one value that a row holds.
BLOCK = 1_024


def ranked(pairs: DataFrame, score: Column, k: int | None, *, by: list[str] | None = None, then: list[str] | None = None) -> DataFrame:
    """The k best rows for each query, by falling score, then by candidate."""
    by = by or ["q_table", "q_column"]
    then = then or [c for c in ("c_table", "c_column") if c in pairs.columns]
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *then)
    out = pairs.withColumn("score", score).withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def posting_lists(values: DataFrame) -> DataFrame:
    """(value, postings, frequency): the sorted columns that hold each value.

    The whole list of a value stands in one row, as an index lookup wants it. Searches over a lake
    use `posting_blocks`, whose rows are bounded.
    """
    return values.groupBy("value").agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("postings")).withColumn("frequency", F.size("postings").cast("long"))


def posting_blocks(values: DataFrame) -> DataFrame:
    """(value, part, parts, cols): values of several columns, their columns in sorted blocks of about BLOCK at most."""
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select("value", F.ceil(F.col("f") / BLOCK).alias("parts"))
    return values.join(shared, "value").groupBy("value", F.pmod(F.xxhash64(*KEY), F.col("parts")).alias("part"), "parts").agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("cols"))


def token_order(values: DataFrame) -> DataFrame:
    """(value, frequency, token_id, group_id): values numbered from the rarest on.

    Values with one posting list share a group. The order is by frequency, then by a hash of the
    list, then by value. Lists are numbered in 4,096 buckets of that hash within their frequency,
    values in as many buckets of their own within a long list, so no task sorts all values of
    one column; only totals of buckets and of the distinct frequencies are summed in one task.
    """
    lists = cut(posting_lists(values).select("value", "frequency", F.md5(F.to_json("postings")).alias("list")))
    groups = lists.groupBy("frequency", "list").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.substring("list", 1, 3)  # rises with the hash
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = groups.groupBy("frequency", bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"))
    starts = totals.groupBy("frequency").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    earlier = Window.orderBy("frequency").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("frequency", zero(F.sum("n").over(earlier)).alias("n0"), zero(F.sum("g").over(earlier)).alias("g0"))
    at = before("frequency", "bucket")
    totals = totals.select("frequency", "bucket", zero(F.sum("n").over(at)).alias("n1"), zero(F.sum("g").over(at)).alias("g1")).join(starts, "frequency")
    inner = before("frequency", "bucket", "list")
    groups = groups.withColumn("bucket", bucket).select("*", zero(F.sum("n").over(inner)).alias("n2"), zero(F.count(F.lit(1)).over(inner)).alias("g2")).join(totals, ["frequency", "bucket"])
    groups = groups.select("frequency", "list", "n", (F.col("n0") + F.col("n1") + F.col("n2")).alias("first"), (F.col("g0") + F.col("g1") + F.col("g2") + 1).alias("group_id"))
    # Values of a long list: a leading part of the value orders buckets, each sorted by itself.
    placed = lists.join(groups, ["frequency", "list"]).withColumn("lead", F.when(F.col("n") > BLOCK, F.substring("value", 1, 6)).otherwise(""))
    leads = placed.groupBy("frequency", "list", "lead").agg(F.count(F.lit(1)).alias("m"))
    leads = leads.select("frequency", "list", "lead", zero(F.sum("m").over(before("frequency", "list", "lead"))).alias("skipped"))
    nth = F.row_number().over(Window.partitionBy("frequency", "list", "lead").orderBy("value"))
    numbered = placed.withColumn("nth", nth).join(leads, ["frequency", "list", "lead"])
    return numbered.select("value", "frequency", (F.col("first") + F.col("skipped") + F.col("nth")).cast("long").alias("token_id"), F.col("group_id").cast("long"))


def token_sets(values: DataFrame, order: DataFrame) -> DataFrame:
    """(table_name, column_name, tokens): each column's values as sorted token ids of an order."""
    return values.join(order.select("value", "token_id"), "value").groupBy(*KEY).agg(F.sort_array(F.collect_list("token_id")).alias("tokens"))


def set_sizes(values: DataFrame) -> DataFrame:
    return values.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))


def overlaps(values: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(q_table, q_column, c_table, c_column, overlap, q_size, c_size) of all columns that share a value.

    Values with one posting list count together, so pairs are formed once per distinct list and
    not once per value. A value that more than BLOCK columns hold is met in pairs of blocks, each
    a row of its own, so neither rows nor tasks grow with it. queries: (table_name, column_name)
    of the columns that ask.
    """
    blocks = cut(posting_blocks(values))
    lists = blocks.where("parts = 1").groupBy("cols").agg(F.count(F.lit(1)).alias("n"))
    one = lists.select(F.explode("cols").alias("q"), "cols", "n")
    hot = blocks.where("parts > 1").select("value", F.explode("cols").alias("q"))
    if queries is not None:
        asked = queries.select(F.struct(*KEY).alias("q")).distinct()
        one, hot = one.join(asked, "q", "left_semi"), hot.join(asked, "q", "left_semi")
    hot = hot.join(blocks.where("parts > 1").select("value", "cols"), "value").select("q", "cols", F.lit(1).cast("long").alias("n"))
    pairs = one.union(hot).select("q", F.explode("cols").alias("c"), "n").where("q != c").groupBy("q", "c").agg(F.sum("n").cast("long").alias("overlap"))
    sizes = set_sizes(values)
    named = lambda p: sizes.select(F.struct(*KEY).alias(p), F.col("size").alias(f"{p}_size"))
    return pairs.join(named("q"), "q").join(named("c"), "c").select(
        F.col("q.table_name").alias("q_table"), F.col("q.column_name").alias("q_column"), F.col("c.table_name").alias("c_table"), F.col("c.column_name").alias("c_column"), "overlap", "q_size", "c_size"
    )


def exact_overlaps(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """overlaps of the given (q_table, q_column, c_table, c_column) alone."""
    asked = pairs.select(*PAIR).distinct()
    q = values.select("value", *(F.col(c).alias(f"q_{c[:-5]}") for c in KEY))
    c = values.select("value", *(F.col(c).alias(f"c_{c[:-5]}") for c in KEY))
    both = q.join(asked, PAIR[:2]).join(c, ["value", *PAIR[2:]])
    sizes = set_sizes(values)
    named = lambda p: sizes.select(F.col("table_name").alias(f"{p}_table"), F.col("column_name").alias(f"{p}_column"), F.col("size").alias(f"{p}_size"))
    return both.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("overlap")).join(named("q"), PAIR[:2]).join(named("c"), PAIR[2:]).select(*PAIR, "overlap", "q_size", "c_size")


#: Measures of an overlap row.
MEASURES = {
    "overlap": lambda: F.col("overlap").cast("double"),
    "containment": lambda: F.round(F.col("overlap") / F.col("q_size"), 6),
    "min_overlap": lambda: F.round(F.col("overlap") / F.least("q_size", "c_size"), 6),
    "jaccard": lambda: F.round(F.col("overlap") / (F.col("q_size") + F.col("c_size") - F.col("overlap")), 6),
}


def top_columns(values: DataFrame, measure: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    return ranked(overlaps(values, queries), MEASURES[measure](), k).select("q_table", "q_column", "c_table", "c_column", "score", "rank")


def containment_pairs(values: DataFrame, threshold: float) -> DataFrame:
    """Columns that hold at least `threshold` of a query column's values, by a prefix filter.

    A candidate misses at most size - need of the query's values; so it holds one of the query's
    size - need + 1 rarest. Only these meet the postings; what is found is then counted in full.
    """
    order = values.groupBy("value").agg(F.count(F.lit(1)).alias("frequency"))
    sizes = set_sizes(values).withColumn("need", F.ceil(F.col("size") * F.lit(threshold) - 1e-9).cast("long"))
    rank = Window.partitionBy(*KEY).orderBy("frequency", "value")
    probes = values.join(order, "value").join(sizes, KEY).withColumn("r", F.row_number().over(rank)).where("r <= size - need + 1 and frequency > 1")
    q = probes.select("value", *(F.col(c).alias(f"q_{c[:-5]}") for c in KEY))
    c = values.select("value", *(F.col(c).alias(f"c_{c[:-5]}") for c in KEY))
    other = (F.col("q_table") != F.col("c_table")) | (F.col("q_column") != F.col("c_column"))
    found = q.join(c, "value").where(other).select(*PAIR).distinct()
    return exact_overlaps(values, cut(found)).join(sizes.select(F.col("table_name").alias("q_table"), F.col("column_name").alias("q_column"), "need"), PAIR[:2]).where("overlap >= need").select(*PAIR, "overlap", "q_size")


def top_overlaps(values: DataFrame, k: int, *, sample: int = 64) -> DataFrame:
    """The k largest overlaps of each column, with a bound: (q_table, q_column, c_table, c_column, score, rank).

    First a query's `sample` rarest shared values name candidates; the k-th best of their exact
    overlaps is a floor. A column that reaches the floor holds one of the query's
    size - floor + 1 rarest values, so only these are probed next, and what they find is counted
    in full. A query with fewer than k candidates probes all its values: its floor is 1.
    """
    order = values.groupBy("value").agg(F.count(F.lit(1)).alias("frequency"))
    sizes = set_sizes(values)
    rank = Window.partitionBy(*KEY).orderBy("frequency", "value")
    # Values that no other column holds come first in the order and name nobody.
    probes = cut(values.select(*KEY, "value").join(order, "value").withColumn("r", F.row_number().over(rank)).where("frequency > 1").withColumn("s", F.row_number().over(rank)))
    q = probes.select("value", "r", "s", *(F.col(c).alias(f"q_{c[:-5]}") for c in KEY))
    c = values.select("value", *(F.col(c).alias(f"c_{c[:-5]}") for c in KEY))
    other = (F.col("q_table") != F.col("c_table")) | (F.col("q_column") != F.col("c_column"))
    # A candidate of many probes is worth counting: the 2k that most of them name.
    named = q.where(F.col("s") <= sample).join(c, "value").where(other).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("hits"))
    likely = Window.partitionBy(*PAIR[:2]).orderBy(F.desc("hits"), *PAIR[2:])
    first = cut(exact_overlaps(values, named.withColumn("o", F.row_number().over(likely)).where(F.col("o") <= 2 * k)))
    kth = Window.partitionBy(*PAIR[:2]).orderBy(F.desc("overlap"))
    floor = first.withColumn("o", F.row_number().over(kth)).where(F.col("o") == k).select(*PAIR[:2], F.col("overlap").alias("floor"))
    need = sizes.select(F.col("table_name").alias("q_table"), F.col("column_name").alias("q_column"), "size").join(floor, PAIR[:2], "left").select(*PAIR[:2], (F.col("size") - F.coalesce("floor", F.lit(1)) + 1).alias("prefix"))
    found = q.join(need, PAIR[:2]).where("r <= prefix").join(c, "value").where(other).select(*PAIR).distinct().join(first.select(*PAIR), PAIR, "left_anti")
    counted = first.unionByName(exact_overlaps(values, cut(found)))
    return ranked(counted, MEASURES["overlap"](), k).select(*PAIR, "score", "rank")


def is_subset(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the given column pairs whose query column lies whole within the candidate."""
    return exact_overlaps(values, pairs).where("overlap = q_size").select(*PAIR)


def covered_pairs(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """The given column pairs with `covered`: whether a third column holds all values of both."""
    within = containment_pairs(values, 1.0)
    q = within.select("q_table", "q_column", F.struct(F.col("c_table").alias("table_name"), F.col("c_column").alias("column_name")).alias("whole"))
    c = q.select(F.col("q_table").alias("c_table"), F.col("q_column").alias("c_column"), "whole")
    asked = pairs.select(*PAIR).distinct()
    found = asked.join(q, PAIR[:2]).join(c, [*PAIR[2:], "whole"]).select(*PAIR).distinct().withColumn("covered", F.lit(True))
    return asked.join(found, PAIR, "left").select(*PAIR, F.coalesce("covered", F.lit(False)).alias("covered"))


def text_values(values: DataFrame) -> DataFrame:
    """values other than strings of digits alone: those that count as words."""
    return values.where(~F.col("value").rlike("^[0-9]+$"))


def numeric_columns(cells: DataFrame) -> DataFrame:
    """(table_name, column_name) of columns whose values, null ones aside, all read as numbers; a column without values is none."""
    number = F.col("value").try_cast("double").isNotNull()
    return cells.where("value is not null").groupBy(*KEY).agg(F.min(number.cast("int")).alias("all")).where("all = 1").select(*KEY)


def candidate_union(*found: DataFrame) -> DataFrame:
    """(q_table, c_table) that any of several searches names."""
    tables = [f.select("q_table", "c_table") for f in found]
    return reduce(DataFrame.union, tables).where("q_table != c_table").distinct()


def candidate_intersection(*found: DataFrame) -> DataFrame:
    """(c_table, c_column) that each of several buffered queries names."""
    return reduce(lambda a, b: a.intersect(b), [f.select("c_table", "c_column") for f in found])


def without(results: DataFrame, known: DataFrame) -> DataFrame:
    """results less as many equal rows of `known` as it holds (a difference of bags)."""
    return results.exceptAll(known.select(*results.columns))


def rare_values(values: DataFrame, most_columns: int) -> DataFrame:
    """Values that fewer than most_columns columns hold (the noise cut-off)."""
    kept = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < most_columns).select("value")
    return values.join(kept, "value", "left_semi")


def name_and_value_match(values: DataFrame, k: int | None) -> DataFrame:
    """Columns of other tables of the same normalised name that share a value, by min-normalised overlap."""
    from ..functions.text import attribute_name

    names = values.select(*KEY).distinct().withColumn("bare", F.regexp_replace(attribute_name(F.col("column_name")), "^[a-z]+_", ""))
    side = lambda p: names.select(*(F.col(c).alias(f"{p}_{c[:-5]}") for c in KEY), "bare")
    # Names come first: only columns of one name are counted.
    alike = cut(side("q").join(side("c"), "bare").where("q_table != c_table"))
    return ranked(exact_overlaps(values, alike), MEASURES["min_overlap"](), k).select(*PAIR, "score", "rank")


def profile(cells: DataFrame) -> DataFrame:
    """Rows, non-null, distinct, lengths and whether most values are text, of every column in one pass."""
    from ..functions.text import is_text_value

    v = F.col("value")
    return cells.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_nonnull"), F.count_distinct("value").alias("n_distinct"), F.min(F.length(v)).cast("long").alias("min_len"), F.max(F.length(v)).cast("long").alias("max_len"), F.round(F.avg(F.length(v)), 6).alias("avg_len"), (2 * F.count_if(is_text_value(v)) > F.count("value")).alias("is_text")
    )


def modes(values: DataFrame) -> DataFrame:
    """Every most frequent value of each column."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("freq"))
    return values.withColumn("r", F.rank().over(w)).where("r = 1").drop("r")


def functional_dependencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(lhs, rhs): column pairs in which each non-null lhs value has one rhs value, null ones aside; all in two aggregations."""
    as_text = [F.col(f"`{c}`").cast("string").alias(f"y{i}") for i, c in enumerate(columns)]
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("lhs"), F.col(f"`{c}`").cast("string").alias("x")) for c in columns))).alias("p"), *as_text).select("p.*", *(f"y{i}" for i in range(len(columns)))).where("x is not null")
    # One or several: the least and the greatest of a lhs value's rhs values tell; null where it has none.
    per = rows.groupBy("lhs", "x").agg(*((F.min(f"y{i}") == F.max(f"y{i}")).alias(f"o{i}") for i in range(len(columns))))
    least = per.groupBy("lhs").agg(*(F.min(F.col(f"o{i}").cast("int")).alias(f"h{i}") for i in range(len(columns))))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("rhs"), F.col(f"h{i}").alias("holds")) for i, c in enumerate(columns))))
    return least.select("lhs", each.alias("p")).where("p.holds = 1 and lhs != p.rhs").select("lhs", "p.rhs")
