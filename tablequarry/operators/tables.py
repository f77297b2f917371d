"""Whole-table search: complement scores, unionability, alignment and synthesised semantics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import greedy, hotelling_from_moments, hypergeometric_cdfs, rounded
from ..sources.store import cut
from .sets import KEY, PAIR, overlaps, ranked
from .vectors import weight_matrix

#: Between the two column names of a pair: no name has it.
AND = "\u001f"
#: Groups whose sums of products a task holds at once.
MOMENT_GROUPS = 256


def attribute_pairs(schema: DataFrame) -> DataFrame:
    """(a, b, freq, freq_a, freq_b), a < b: in how many tables two attributes stand together and alone. schema: (table_name, attr)."""
    s = schema.distinct()
    single = s.groupBy("attr").agg(F.count(F.lit(1)).alias("freq"))
    both = s.select("table_name", F.col("attr").alias("a")).join(s.select("table_name", F.col("attr").alias("b")), "table_name").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("freq"))
    return both.join(single.select(F.col("attr").alias("a"), F.col("freq").alias("freq_a")), "a").join(single.select(F.col("attr").alias("b"), F.col("freq").alias("freq_b")), "b")


def schema_benefit(schema: DataFrame) -> DataFrame:
    """(q_table, c_table, added, benefit): the candidate's attribute that goes best with the query's.

    Of each attribute the query lacks: the mean over the query's attributes q of
    freq(attribute, q) / freq(q).
    """
    s = schema.distinct()
    pairs = attribute_pairs(schema)
    together = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "freq", F.col("freq_b").alias("freq_y")).union(pairs.select("b", "a", "freq", "freq_a"))
    q = s.select(F.col("table_name").alias("q_table"), F.col("attr").alias("y"))
    n = q.groupBy("q_table").agg(F.count(F.lit(1)).alias("n"))
    per = q.join(together, "y").groupBy("q_table", "x").agg(F.sum(F.col("freq") / F.col("freq_y")).alias("s")).join(n, "q_table")
    new = per.join(q.select("q_table", F.col("y").alias("x")), ["q_table", "x"], "left_anti").select("q_table", F.col("x").alias("attr"), F.round(F.col("s") / F.col("n"), 6).alias("benefit"))
    found = new.join(s.select(F.col("table_name").alias("c_table"), "attr"), "attr").where("q_table != c_table")
    w = Window.partitionBy("q_table", "c_table").orderBy(F.desc("benefit"), "attr")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").select("q_table", "c_table", F.col("attr").alias("added"), "benefit")


def schema_complement(values: DataFrame, entity_columns: DataFrame, schema: DataFrame, k: int) -> DataFrame:
    """(q_table, c_table, score, rank): cover of the query's entities times schema_benefit; tables without shared entities are left out."""
    e = values.join(entity_columns, KEY, "left_semi")
    cover = overlaps(e).select("q_table", "c_table", (F.col("overlap") / F.col("q_size")).alias("cover")).groupBy("q_table", "c_table").agg(F.max("cover").alias("cover"))
    return ranked(cover.join(schema_benefit(schema), ["q_table", "c_table"]), F.round(F.col("cover") * F.col("benefit"), 6), k, by=["q_table"], then=["c_table"]).select("q_table", "c_table", "score", "rank")


def label_weights(labels: DataFrame, n: int = 2, m: int = 2) -> DataFrame:
    """(table_name, label, weight): (sum of 1 / rank) ** n / (tables that have the label) ** m. labels: (table_name, label, rank)."""
    v = labels.groupBy("table_name", "label").agg(F.sum(F.lit(1.0) / F.col("rank")).alias("v"))
    count = v.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    return v.join(count, "label").select("table_name", "label", (F.pow("v", F.lit(float(n))) / F.pow("count", F.lit(float(m)))).alias("weight"))


def entity_complement(labels: DataFrame) -> DataFrame:
    """(q_table, c_table, score): the sum, over common labels, of the product of their weights."""
    w = label_weights(labels)
    q, c = w.select(F.col("table_name").alias("q_table"), "label", F.col("weight").alias("wq")), w.select(F.col("table_name").alias("c_table"), "label", F.col("weight").alias("wc"))
    return q.join(c, "label").where("q_table != c_table").groupBy("q_table", "c_table").agg(F.round(F.sum(F.col("wq") * F.col("wc")), 6).alias("score"))


def entity_complement_search(labels: DataFrame, name_similarity: DataFrame, k: int) -> DataFrame:
    """entity_complement times the normalised best matching of column names, ranked."""
    from .vectors import best_matching

    schema = best_matching(name_similarity, normalised=True).select("q_table", "c_table", F.col("score").alias("schema"))
    both = entity_complement(labels).withColumnRenamed("score", "entity").join(schema, ["q_table", "c_table"])
    return ranked(both, F.round(F.col("entity") * F.col("schema"), 6), k, by=["q_table"], then=["c_table"]).select("q_table", "c_table", "score", "rank")


def set_unionability(pairs: DataFrame) -> DataFrame:
    """Overlap pairs with the hypergeometric probability of at most their overlap: population |A| + |B|, |A| marked, |B| drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, q, c = (b.column(x).to_numpy() for x in ("overlap", "q_size", "c_size"))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in PAIR), pa.array(np.round(hypergeometric_cdfs(t, q + c, q, c), 6), pa.float64())], [*PAIR, "score"])

    return pairs.select(*PAIR, "overlap", "q_size", "c_size").mapInArrow(run, "q_table string, q_column string, c_table string, c_column string, score double")


def moments(vectors: DataFrame, group: str, dim: int, embedding: str = "embedding") -> DataFrame:
    """(group, n, sums, products): what means and covariances need, combined before the shuffle.

    Matrix products make the sums of each partition's groups, MOMENT_GROUPS of them at once.
    """
    rows = vectors.where(F.col(embedding).isNotNull()).select(F.col(group).alias("g"), F.col(embedding).cast("array<double>").alias("v"))
    kind = f"g {rows.schema['g'].dataType.simpleString()}, n long, sums array<double>, products array<double>"

    def batch(held: dict, key: pa.DataType) -> pa.RecordBatch:
        n, sums, products = zip(*held.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(held), key), pa.array(n, pa.int64()), pa.array(list(sums), pa.list_(pa.float64())), pa.array(list(products), pa.list_(pa.float64()))], ["g", "n", "sums", "products"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            if not len(b):
                continue
            x = np.asarray(b.column("v").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(b), -1)[:, :dim]
            at: dict = {}
            for i, g in enumerate(b.column("g").to_pylist()):
                at.setdefault(g, []).append(i)
            for g, i in at.items():
                n, sums, products = held.get(g, (0, 0.0, 0.0))
                held[g] = (n + len(i), sums + x[i].sum(axis=0), products + (x[i].T @ x[i]).ravel())
                if len(held) == MOMENT_GROUPS:
                    yield batch(held, b.schema.field("g").type)
                    held = {}
        if held:
            yield batch(held, b.schema.field("g").type)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products, g = 0, 0.0, 0.0, None
        for b in batches:
            if len(b):
                g = b.column("g").slice(0, 1)
                n += sum(b.column("n").to_pylist())
                total = lambda c: np.asarray(b.column(c).flatten().to_numpy(zero_copy_only=False)).reshape(len(b), -1).sum(axis=0)  # noqa: E731, B023
                sums, products = sums + total("sums"), products + total("products")
        yield batch({g[0].as_py(): (n, sums, products)}, g.type)

    return rows.mapInArrow(part, kind).groupBy("g").applyInArrow(merge, kind).withColumnRenamed("g", group)


def language_unionability(vectors: DataFrame, group: str, dim: int, embedding: str = "embedding") -> DataFrame:
    """(q, c, score) of all ordered pairs of groups: Hotelling's test that their mean vectors agree, as 1 - F; -1 where undefined."""
    m = moments(vectors, group, dim, embedding).withColumnRenamed(group, "g")
    q, c = (m.select(F.col("g").alias(p), F.struct("n", "sums", "products").alias(f"m{p}")) for p in ("q", "c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [round(hotelling_from_moments(a, d, dim), 6) for a, d in zip(b.column("mq").to_pylist(), b.column("mc").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("c"), pa.array(score, pa.float64())], ["q", "c", "score"])

    # Pairs of groups, not of vectors: each group is one row of moments.
    return q.join(c, F.col("q") != F.col("c")).mapInArrow(run, f"q {m.schema['g'].dataType.simpleString()}, c {m.schema['g'].dataType.simpleString()}, score double")


def ensemble(scores: DataFrame, kinds: list[str], k: int) -> DataFrame:
    """Column pairs by the greatest of their shares of not greater scores, over the kinds of evidence."""
    shares = scores.where("q_table != c_table").select(*PAIR, *(F.round(F.cume_dist().over(Window.partitionBy("q_table", "q_column").orderBy(c)), 6).alias(c) for c in kinds))
    return ranked(shares, F.greatest(*kinds), k).select(*PAIR, "score", "rank")


def alignments(weights: DataFrame) -> DataFrame:
    """(q_table, c_table, c, score): the product of the c best pairs of a greedy one-to-one alignment, for each c.

    Every given pair takes part, those whose weight is (or rounds to) 0 as the last ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).to_pydict()
        rows, cols = sorted(set(t["q_column"])), sorted(set(t["c_column"]))
        w = weight_matrix(t, rows, cols)
        given = weight_matrix(t | {"score": [1.0] * len(t["score"])}, rows, cols) > 0
        product = rounded(np.cumprod([w[p] for p in greedy(w, given)]), 9)
        yield pa.RecordBatch.from_pylist([{"q_table": t["q_table"][0], "c_table": t["c_table"][0], "c": k + 1, "score": float(x)} for k, x in enumerate(product)], schema=pa.schema([("q_table", pa.string()), ("c_table", pa.string()), ("c", pa.int32()), ("score", pa.float64())]))

    return weights.groupBy("q_table", "c_table").applyInArrow(run, "q_table string, c_table string, c int, score double")


def c_alignment(weights: DataFrame, k: int) -> DataFrame:
    """Tables by the goodness of their best c-alignment: the share of alignments of c pairs that score no higher."""
    goodness = alignments(weights).withColumn("goodness", F.round(F.cume_dist().over(Window.partitionBy("c").orderBy("score")), 6))
    best = goodness.groupBy("q_table", "c_table").agg(F.max_by(F.struct("c", "goodness"), F.struct("goodness", "c")).alias("b")).select("q_table", "c_table", "b.c", "b.goodness")
    return ranked(best, F.col("goodness"), k, by=["q_table"], then=["c_table"]).select("q_table", "c_table", "c", "score", "rank")


def synthesised_columns(values: DataFrame) -> DataFrame:
    """(table_name, column_name, label_table, label_column, share): what a column is, told by the lake's other columns.

    Each value votes for the column that covers most of its own column (ties by name); share is
    the part of the column's values that vote for the label.
    """
    pairs = overlaps(values).where("q_table != c_table").select("q_table", "q_column", "c_table", "c_column", (F.col("overlap") / F.col("q_size")).alias("s"))
    q = values.select(F.col("table_name").alias("q_table"), F.col("column_name").alias("q_column"), "value")
    c = values.select(F.col("table_name").alias("c_table"), F.col("column_name").alias("c_column"), "value")
    held = q.join(c, "value").join(pairs, PAIR)
    best = held.groupBy("q_table", "q_column", "value").agg(F.min_by(F.struct("c_table", "c_column"), F.struct(-F.col("s"), "c_table", "c_column")).alias("label"))
    sizes = values.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
    votes = best.groupBy(F.col("q_table").alias("table_name"), F.col("q_column").alias("column_name"), "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.join(sizes, KEY).select(*KEY, F.col("label.c_table").alias("label_table"), F.col("label.c_column").alias("label_column"), F.round(F.col("n") / F.col("size"), 6).alias("share"))


def pair_values(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Distinct non-null value pairs of the given (table, column, column), as values of a column named by both, AND between."""
    out = None
    for t in sorted({t for t, *_ in pairs}):
        each = [F.struct(F.lit(f"{a}{AND}{b}").alias("column_name"), F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat(F.col(a).cast("string"), F.lit(AND), F.col(b).cast("string"))).alias("value")) for u, a, b in pairs if u == t]
        rows = tables[t].select(F.lit(t).alias("table_name"), F.explode(F.array(*each)).alias("p")).select("table_name", "p.*").where("value is not null").distinct()
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no pair of columns is given")
    return out


def synthesised_search(values: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Tables by relations: for each pair of query columns the candidate pair with the best relation cover times both columns' covers; summed by table."""
    rel = overlaps(pairs).where("q_table != c_table").select("q_table", "c_table", "q_column", "c_column", (F.col("overlap") / F.col("q_size")).alias("rel"))
    side = lambda p, k: F.element_at(F.split(F.col(f"{p}_column"), AND), k)
    rel = rel.select("q_table", "c_table", "q_column", "rel", *(side(p, k).alias(f"{p}{k}") for p in "qc" for k in (1, 2)))
    col = overlaps(values).select("q_table", "c_table", *(F.col(c) for c in ("q_column", "c_column")), (F.col("overlap") / F.col("q_size")).alias("s"))
    for n in (1, 2):
        rel = rel.join(col.select("q_table", "c_table", F.col("q_column").alias(f"q{n}"), F.col("c_column").alias(f"c{n}"), F.col("s").alias(f"s{n}")), ["q_table", "c_table", f"q{n}", f"c{n}"])
    best = rel.groupBy("q_table", "c_table", "q_column").agg(F.max(F.col("rel") * F.col("s1") * F.col("s2")).alias("s"))
    return ranked(best.groupBy("q_table", "c_table").agg(F.sum("s").alias("s")), F.round("s", 6), k, by=["q_table"], then=["c_table"]).select("q_table", "c_table", "score", "rank")


def relation_column_search(columns: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Tables by relations and the meaning of their columns: (q_table, c_table, score, rank).

    A pair of query columns and a pair of candidate columns that share values score the share of
    either pair's values, multiplied by the two best of the four ways in which their columns tell
    a common label; each query pair counts once per table, with its best. columns: (table_name,
    column_name, label_table, label_column, share); pairs: as pair_values gives.
    """
    shared = overlaps(pairs).where("q_table != c_table")
    side = lambda p: F.split(F.col(f"{p}_column"), AND)
    rel = shared.select(*PAIR, (F.col("overlap") / F.col("q_size") * (F.col("overlap") / F.col("c_size"))).alias("rel"), F.explode(side("q")).alias("qc"), side("c").alias("cs")).select(*PAIR, "rel", "qc", F.explode("cs").alias("cc"))
    rel = cut(rel)
    told = lambda p: columns.select(F.col("table_name").alias(f"{p}_table"), F.col("column_name").alias(f"{p}c"), "label_table", "label_column", F.col("share").alias(f"{p}_share"))
    # Only columns of pairs that share values are compared, not all that have a common label.
    met = rel.select("q_table", "qc", "c_table", "cc").distinct().join(told("q"), ["q_table", "qc"]).join(told("c"), ["c_table", "cc", "label_table", "label_column"])
    ways = met.groupBy("q_table", "qc", "c_table", "cc").agg(F.max(F.col("q_share") * F.col("c_share")).alias("m"))
    four = rel.join(ways, ["q_table", "qc", "c_table", "cc"], "left").groupBy(*PAIR, "rel").agg(F.sort_array(F.collect_list(F.coalesce("m", F.lit(0.0))), asc=False).alias("ms"))
    best = four.groupBy("q_table", "c_table", "q_column").agg(F.max(F.col("rel") * F.col("ms")[0] * F.col("ms")[1]).alias("s"))
    return ranked(best.groupBy("q_table", "c_table").agg(F.sum("s").alias("s")), F.round("s", 6), k, by=["q_table"], then=["c_table"]).select("q_table", "c_table", "score", "rank")
