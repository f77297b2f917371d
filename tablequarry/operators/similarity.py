"""Several kinds of evidence that two columns hold alike things, and how they add up."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.vectors import norm
from ..sources.store import cut, stored
from .sets import KEY, MEASURES, PAIR, overlaps, ranked
from .vectors import pivot_eps_join, pivot_sample

#: Frequent tokens that settle shingles where they are read; others meet in a join.
KNOWN_TOKENS = 200_000
#: Stands for the frequency of a token without weight.
WEIGHTLESS = 2**62


def name_features(values: DataFrame, q: int = 3) -> DataFrame:
    """(table_name, column_name, item): q-grams of the column's name without a prefix such as `c_`."""
    names = values.select(*KEY).distinct()
    return names.select(*KEY, F.explode(text.qgrams(F.regexp_replace(F.lower("column_name"), "^[a-z]+_", ""), q)).alias("item")).distinct()


def format_features(values: DataFrame) -> DataFrame:
    return values.where("value != ''").select(*KEY, text.format_descriptor(F.col("value")).alias("item")).distinct()


def token_features(values: DataFrame, *, max_share: float = 0.5, stop_words: tuple[str, ...] = (), known_tokens: int = KNOWN_TOKENS) -> DataFrame:
    """One token for each shingle of each value: that of greatest inverse frequency, the first of equals.

    A token's frequency is the number of the column's values that have it. Stop words and tokens
    in more than max_share of the values weigh nothing, so they stand for a shingle only where it
    has no other; a column all of whose tokens weigh nothing has no features.

    Only counts by column and token are shuffled, not tokens by place. A shingle of one token
    stands for itself. The others are settled as they are read, by the most frequent tokens
    (known_tokens of them at most): a single token that is not among those is the rarest; where
    several are not, these alone meet their frequencies in a join.
    """
    spark = values.sparkSession
    sizes = stored(values.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")), "sizes")
    s, many = F.col("s"), lambda t: F.size(t) > 1
    one = lambda t: F.size(t) == 1
    told = lambda c, n, alone, met: F.transform(c, lambda t: F.struct(t.alias("token"), F.lit(n).cast("long").alias("n"), F.lit(alone).alias("alone"), F.lit(met).alias("met")))
    every, singles, others = (F.array_distinct(F.flatten(x)) for x in (s, F.filter(s, one), F.filter(s, many)))
    each = F.when(~F.exists(s, many), told(every, 1, True, False)).when(~F.exists(s, one), told(every, 1, False, True))
    each = each.otherwise(F.concat(told(every, 1, False, False), told(singles, 0, True, False), told(others, 0, False, True)))
    counts = values.select(*KEY, text.shingle_tokens(F.col("value")).alias("s")).select(*KEY, F.explode(each).alias("x")).select(*KEY, "x.*")
    counts = counts.groupBy(*KEY, "token").agg(F.sum("n").alias("df"), F.max("alone").alias("alone"), F.max("met").alias("met"))
    weighs = F.col("df") <= F.lit(max_share) * F.col("size")
    if stop_words:
        weighs = weighs & ~F.col("token").isin(*stop_words)
    # Tokens without weight come after all others. sizes, some and mixed have a row a column.
    counts = stored(counts.join(sizes, KEY).select(*KEY, "token", F.when(weighs, F.col("df")).otherwise(F.lit(WEIGHTLESS)).alias("df"), "alone", "met"), "tokens")
    some = stored(counts.where(F.col("df") < WEIGHTLESS).select(*KEY).distinct(), "weighing")
    counts = counts.join(some, KEY, "left_semi")
    met = counts.where("met")
    mixed = stored(met.select(*KEY).distinct(), "mixed")

    # The least power of two over which there are no more than known_tokens.
    level = F.floor(F.log2(F.col("df").cast("double")) + 1e-9).cast("int")
    held, least = 0, 63
    for power, n in sorted(met.groupBy(level.alias("p")).count().collect(), reverse=True):  # 63 rows at most
        held += n
        if held > known_tokens:
            break
        least = power
    else:
        least = 0
    known: dict[tuple, dict[str, int]] = {}
    for t, c, token, df in met.where(level >= least).select(*KEY, "token", "df").collect():  # known_tokens rows at most
        known.setdefault((t, c), {})[token] = df
    frequent = spark.sparkContext.broadcast(known)

    rows = values.where(~F.col("value").rlike(text.DIGITS)).join(mixed, KEY, "left_semi").select(*KEY, F.filter(text.shingle_tokens(F.col("value")), many).alias("s")).where(F.size("s") > 0)
    settled = stored(rows.mapInArrow(lambda batches: _settle(batches, frequent.value), "table_name string, column_name string, item string, rest array<string>").distinct(), "settled")
    found = [settled.where("item is not null").select(*KEY, "item")]
    if least:
        rest = settled.where("rest is not null").withColumn("id", F.monotonically_increasing_id()).select(*KEY, "id", F.posexplode("rest").alias("pos", "token"))
        found.append(rest.join(met, [*KEY, "token"]).groupBy(*KEY, "id").agg(F.min_by("token", F.struct("df", "pos")).alias("item")).select(*KEY, "item"))
    alone = counts.where("alone").select(*KEY, F.col("token").alias("item"))
    both = reduce(DataFrame.unionByName, found, alone.join(mixed, KEY, "left_semi")).distinct()
    return both.unionByName(alone.join(mixed, KEY, "left_anti"))


def _settle(batches: Iterator[pa.RecordBatch], known: dict[tuple, dict[str, int]]) -> Iterator[pa.RecordBatch]:
    """Rows (table_name, column_name, s: shingles as lists of tokens) -> each one's rarest token, or those of its tokens that are not known where they are several."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            number = {k: i for i, k in enumerate(dict.fromkeys(names))}
            lists = b.column(2)
            shingles, row = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
            place, coded = np.asarray(pc.list_parent_indices(shingles)), shingles.flatten().dictionary_encode()
            words, code = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
            column = np.array([number[k] for k in names])[row]  # of each shingle
            pairs, back = np.unique(column[place] * len(words) + code, return_inverse=True)
            own = [known.get(k, {}) for k in number]
            df = np.array([own[p // len(words)].get(words[p % len(words)], 0) for p in pairs.tolist()], dtype=np.int64)[back]
            start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # no shingle is without tokens
            low = np.minimum.reduceat(df, start)
            best = np.minimum.reduceat(np.where(df == low[place - place[0]], np.arange(len(df)), len(df)), start)
            names = list(number)
            out: dict[tuple, None] = {}
            unknown = np.add.reduceat((df == 0).astype(np.int64), start)
            end = np.r_[start[1:], len(df)]
            for p in np.unique(column[place[start]][unknown < 2] * len(words) + code[best][unknown < 2]).tolist():
                out[(*names[p // len(words)], words[p % len(words)], None)] = None
            for i in np.flatnonzero(unknown > 1).tolist():
                tokens = tuple(dict.fromkeys(words[code[j]] for j in range(start[i], end[i]) if not df[j]))
                out[(*names[column[place[start[i]]]], *((tokens[0], None) if len(tokens) == 1 else (None, tokens)))] = None
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.list_(pa.string())), strict=True)], ["table_name", "column_name", "item", "rest"])


def feature_jaccard(features: DataFrame, *, held: bool = False) -> DataFrame:
    """(q_table, q_column, c_table, c_column, score): Jaccard similarity of the columns' items; pairs that share one.

    held: the features are read from a stored table, so they need not be stored again.
    """
    items = features.withColumnRenamed("item", "value")
    return overlaps(items if held else stored(items, "features")).select(*PAIR, MEASURES["jaccard"]().alias("score"))


def histograms(numbers: DataFrame, bins: int) -> DataFrame:
    """(table_name, column_name, bin, density) of numeric cells (table_name, column_name, x); infinities and NaN do not count.

    Bins split each column's own range evenly; the greatest value falls in the last one.
    """
    x = numbers.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    ends = x.groupBy(*KEY).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    # Bins are few per column: counts combine before the shuffle.
    counted = x.join(ends, KEY).groupBy(*KEY, at.alias("bin"), "n", width.alias("width")).agg(F.count(F.lit(1)).alias("c"))
    return counted.select(*KEY, "bin", F.round(F.col("c") / (F.col("n") * F.when(F.col("width") > 0, F.col("width")).otherwise(1.0)), 6).alias("density"))


def histogram_overlap(numbers: DataFrame, bins: int) -> DataFrame:
    """Similarity of numeric columns: the shared mass of their histograms, each over its own range."""
    h = numbers.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    # A row a column: its size being known, Spark sends it to the numbers instead of shuffling these.
    ends = stored(h.groupBy(*KEY).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")), "ends")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    mass = h.join(ends, KEY).groupBy(*KEY, at.alias("bin"), "n").agg(F.count(F.lit(1)).alias("c")).select(F.struct(*KEY).alias("k"), "bin", (F.col("c") / F.col("n")).alias("mass"))
    a, b = mass.select(F.col("k").alias("q"), "bin", F.col("mass").alias("mq")), mass.select(F.col("k").alias("c"), "bin", F.col("mass").alias("mc"))
    both = a.join(b, "bin").where("q != c").groupBy("q", "c").agg(F.round(F.sum(F.least("mq", "mc")), 6).alias("score"))
    return both.select(F.col("q.table_name").alias("q_table"), F.col("q.column_name").alias("q_column"), F.col("c.table_name").alias("c_table"), F.col("c.column_name").alias("c_column"), "score")


def hashed_word_vectors(words: DataFrame, dim: int = 32) -> DataFrame:
    """(item, vector): a vector for each word out of its MD5, where no trained vectors are at hand; dim at most 32."""
    digit = lambda i: F.conv(F.substring(F.md5("item"), i, 1), 16, 10).cast("double") - 7.5
    return words.select("item").distinct().select("item", F.array(*(digit(i) for i in range(1, dim + 1))).alias("vector"))


def embedding_similarity(features: DataFrame, words: DataFrame, threshold: float, dim: int) -> DataFrame:
    """(q_table, q_column, c_table, c_column, score): columns whose words' mean vectors have a cosine of `threshold` or more.

    features: as token_features gives; words: (item, vector), a trained table or hashed_word_vectors;
    words without a vector and columns without such words take no part. Unit vectors meet in the
    epsilon join: a cosine of t is a distance of sqrt(2 - 2 t).
    """
    mean = features.join(words, "item").groupBy(*KEY).agg(F.array(*(F.avg(F.col("vector")[i].cast("double")) for i in range(dim))).alias("m"))
    unit = cut(mean.withColumn("norm", norm(F.col("m"))).where("norm > 0").select(*KEY, F.xxhash64(*KEY).alias("vec_id"), F.transform("m", lambda x: x / F.col("norm")).alias("embedding")))
    if unit.isEmpty():
        return unit.sparkSession.createDataFrame([], "q_table string, q_column string, c_table string, c_column string, score double")
    near = pivot_eps_join(unit, unit, (2 - 2 * threshold) ** 0.5 + 1e-6, pivot_sample(unit, 3))
    side = lambda p: unit.select(F.col("vec_id").alias(f"{p}_id"), F.col("table_name").alias(f"{p}_table"), F.col("column_name").alias(f"{p}_column"))
    scored = near.join(side("q"), "q_id").join(side("c"), "c_id").select(*PAIR, F.round(1 - F.col("dist") * F.col("dist") / 2, 6).alias("score"))
    return scored.where(F.col("score") >= threshold)


def evidence(parts: dict[str, DataFrame]) -> DataFrame:
    """Column pairs with a score per kind of evidence, 0 where a kind found none."""
    long = reduce(DataFrame.unionByName, (df.select(*PAIR, F.lit(k).alias("kind"), "score") for k, df in parts.items()))
    return long.groupBy(*PAIR).agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in parts))


def column_query(found: DataFrame, kinds: list[str], k: int, aggregator: Column | None = None) -> DataFrame:
    """The k best columns of other tables for each query column, by the mean of the evidence or an aggregator."""
    score = aggregator if aggregator is not None else F.round(reduce(Column.__add__, map(F.col, kinds)) / len(kinds), 8)
    return ranked(found.where("q_table != c_table"), score, k).select(*PAIR, "score", "rank")


def table_query(found: DataFrame, kinds: list[str], k: int) -> DataFrame:
    """The k best tables for each query table: (q_table, c_table, score, rank).

    For each query column and table its best column per kind counts. Each kind's scores become
    their share of scores not greater, among all of that query column; the weighted mean over
    the query's columns with these shares as weights, then the mean over the kinds, ranks tables.
    """
    best = found.where("q_table != c_table").groupBy("q_table", "q_column", "c_table").agg(*(F.max(c).alias(c) for c in kinds))
    shares = best.select("q_table", "c_table", *kinds, *(F.cume_dist().over(Window.partitionBy("q_table", "q_column").orderBy(c)).alias(f"w_{c}") for c in kinds))
    per = shares.groupBy("q_table", "c_table").agg(*((F.sum(F.col(c) * F.col(f"w_{c}")) / F.sum(f"w_{c}")).alias(c) for c in kinds))
    return ranked(per, F.round(reduce(Column.__add__, map(F.col, kinds)) / len(kinds), 6), k, by=["q_table"], then=["c_table"]).select("q_table", "c_table", "score", "rank")


def score_ecdf(scores: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, mass, cumulative): the distribution of scores in [0, 1] over even bins."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    counts = scores.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    grid = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = grid.join(counts, "bin", "left").join(F.broadcast(total))  # one row
    mass = F.coalesce(F.col("n"), F.lit(0)) / F.col("total")
    return filled.select("bin", F.round(mass, 6).alias("mass"), F.round(F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.col("total"), 6).alias("cumulative"))


def column_sentences(values: DataFrame, most: int = 512) -> DataFrame:
    """(table_name, column_name, sentence): a column told as text of at most `most` tokens, its most frequent values first.

    Each value brings a token or more, be it the comma before it, so `most` values are enough.
    """
    w = Window.partitionBy(*KEY).orderBy(F.desc("freq"), "value")
    top = values.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("r", "value"))).alias("v"))
    facts = values.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("value")).alias("hi"), F.min(F.length("value")).alias("lo"), F.round(F.avg(F.length("value")), 2).alias("mean"))
    mean = F.format_string("%.2f", "mean")
    return facts.join(top, KEY).select(*KEY, text.sentence(F.col("column_name"), F.col("n"), F.col("hi"), F.col("lo"), mean, F.transform("v", lambda x: x["value"]), most).alias("sentence"))


def keyword_search(values: DataFrame, keywords: list[str], k: int, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Tables for keywords, by BM25 over the tokens of their values and column names: (table_name, score, rank)."""
    words = values.select("table_name", F.explode(text.tokens(F.col("value"))).alias("token"))
    tf = words.groupBy("table_name", "token").agg(F.count(F.lit(1)).alias("tf"))
    lengths = tf.groupBy("table_name").agg(F.sum("tf").alias("len"))
    facts = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    asked = tf.where(F.col("token").isin([w.lower() for w in keywords]))
    df = asked.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = asked.join(df, "token").join(lengths, "table_name").join(F.broadcast(facts)).groupBy("table_name").agg(F.round(F.sum(part), 6).alias("score"))  # facts: one row
    best = scored.orderBy(F.desc("score"), "table_name").limit(k)  # each task keeps k; only those are ranked together
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "table_name")))


def training_texts(sentences: DataFrame, *, augment: tuple[int, int] = (1, 5), train: tuple[int, int] = (8, 10), seed: int = 7) -> DataFrame:
    """(table_name, column_name, sentence, augmented, part) for training an encoder elsewhere.

    A hash of the column decides which share `augment` of the sentences gets its words shuffled,
    and which share `train` is for training, the rest being for development.
    """
    from ..functions.hashing import hash32

    h = lambda what: hash32(F.concat_ws(":", F.lit(what), *KEY))
    return sentences.select(*KEY, "sentence", F.when(h("augment") % augment[1] < augment[0], text.shuffled(F.col("sentence"), seed)).otherwise(F.col("sentence")).alias("augmented"), F.when(h("part") % train[1] < train[0], "train").otherwise("dev").alias("part"))
