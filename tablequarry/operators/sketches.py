"""MinHash sketches, banded collisions and the size-partitioned containment search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import PRIME, hash32, permutations
from ..functions.stats import best_bands, containment_bands, size_partitions
from ..sources.store import cut
from .sets import KEY, MEASURES, PAIR, exact_overlaps, ranked

#: Permutations of a signature.
NUM_PERM = 256
#: Weights of needless candidates and of misses in the choice of bands.
RECALL = (0.1, 0.9)
#: Share of pairs at the threshold that bands may miss in expectation.
MOST_MISSES = 0.05
#: Columns whose minima a task holds at once (2 KB each).
SKETCHED = 4_096
SKETCH = ["table_name", "column_name", "size", "signature"]


def signatures(values: DataFrame, num_perm: int = NUM_PERM, seed: int = 1) -> DataFrame:
    """(table_name, column_name, size, signature): elementwise minima, so sketches of parts merge by minimum.

    Values are hashed by Spark; each task then keeps the minima of SKETCHED columns at most, as
    arrays, and sends one row for each.
    """
    a, b = (np.array(x, dtype=np.uint64) for x in zip(*permutations(num_perm, seed), strict=True))
    hashed = values.select(*KEY, (hash32(F.col("value")) % F.lit(PRIME)).alias("h"))

    def batch(held: dict) -> pa.RecordBatch:
        n, sig = zip(*held.values(), strict=True)
        tables, columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(tables, pa.string()), pa.array(columns, pa.string()), pa.array(n, pa.int64()), pa.array([x.astype(np.int64) for x in sig], pa.list_(pa.int64()))], SKETCH)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for rows in batches:
            if not len(rows):
                continue
            # Rows of one column together, by a dictionary of the names.
            names = [rows.column(c).dictionary_encode() for c in (0, 1)]
            code = names[0].indices.to_numpy().astype(np.int64) * len(names[1].dictionary) + names[1].indices.to_numpy()
            order = np.argsort(code, kind="stable")
            h, code = rows.column(2).to_numpy()[order].astype(np.uint64), code[order]
            edges = np.flatnonzero(np.diff(code, prepend=-1))
            for first, end in zip(edges, [*edges[1:], len(code)], strict=True):
                key = names[0].dictionary[int(code[first]) // len(names[1].dictionary)].as_py(), names[1].dictionary[int(code[first]) % len(names[1].dictionary)].as_py()
                n, least = held.get(key, (0, None))
                for at in range(first, end, 4_096):
                    low = ((h[at : min(at + 4_096, end), None] * a + b) % np.uint64(PRIME)).min(axis=0)
                    least = low if least is None else np.minimum(least, low)
                held[key] = n + int(end - first), least
                if len(held) >= SKETCHED:
                    yield batch(held)
                    held = {}
        if held:
            yield batch(held)

    parts = hashed.mapInArrow(part, "table_name string, column_name string, size long, signature array<long>")
    return parts.groupBy(*KEY).agg(F.sum("size").alias("size"), F.array(*(F.min(F.col("signature")[i]) for i in range(num_perm))).alias("signature"))


def merge(parts: DataFrame, num_perm: int) -> DataFrame:
    """Union of sketches of one column that were made apart."""
    return parts.groupBy(*KEY).agg(F.array(*(F.min(F.col("signature")[i]) for i in range(num_perm))).alias("signature"))


def cardinality(signature, num_perm: int):
    """Estimate of the distinct values from the minima."""
    from ..functions.hashing import PRIME

    return F.lit(float(num_perm)) / F.aggregate(signature, F.lit(0.0), lambda s, m: s + m / F.lit(float(PRIME))) - 1


def _sides(sig: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda p: sig.select(*(F.col(c).alias(f"{p}_{c[:-5]}") for c in KEY), F.col("signature").alias(f"{p}_sig"), F.col("size").alias(f"{p}_size"))
    return side("q"), side("c")


def _buckets(sig: DataFrame, bands: int, rows: int) -> DataFrame:
    """(k, band, bucket), k the column."""
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.cast("long").alias("band"), F.concat_ws(",", F.slice("signature", b * rows + 1, rows).cast("array<string>")).alias("bucket"))))
    return sig.select(F.struct(*KEY).alias("k"), each.alias("b")).select("k", "b.band", "b.bucket")


def band_collisions(sig: DataFrame, bands: int, rows: int) -> DataFrame:
    """(q_table, q_column, c_table, c_column, hits): column pairs that agree on whole bands, and on how many: an equi-join on (band, bucket)."""
    keyed = _buckets(sig, bands, rows).select("k", "band", F.md5("bucket").alias("bucket"))
    pairs = keyed.withColumnRenamed("k", "q").join(keyed.withColumnRenamed("k", "c"), ["band", "bucket"]).where("q != c").groupBy("q", "c").agg(F.count(F.lit(1)).alias("hits"))
    return pairs.select(F.col("q.table_name").alias("q_table"), F.col("q.column_name").alias("q_column"), F.col("c.table_name").alias("c_table"), F.col("c.column_name").alias("c_column"), "hits")


def collision_ranked(sig: DataFrame, bands: int, rows: int, k: int) -> DataFrame:
    """The k columns that share most buckets with each: (q_table, q_column, c_table, c_column, score, rank)."""
    return ranked(band_collisions(sig, bands, rows), F.col("hits"), k).select(*PAIR, "score", "rank")


def bucket_counts(sig: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band, bucket, columns): how many columns each bucket holds."""
    return _buckets(sig, bands, rows).groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("columns"))


def estimated_jaccard(sig: DataFrame, pairs: DataFrame, num_perm: int) -> DataFrame:
    q, c = _sides(sig)
    joined = pairs.join(q, ["q_table", "q_column"]).join(c, ["c_table", "c_column"])
    same = F.aggregate(F.zip_with("q_sig", "c_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return joined.select("q_table", "q_column", "c_table", "c_column", F.round(same / F.lit(float(num_perm)), 6).alias("score"))


def lsh_search(values: DataFrame, threshold: float, num_perm: int = NUM_PERM) -> DataFrame:
    """Columns whose Jaccard similarity reaches the threshold: (q_table, q_column, c_table, c_column, score).

    Bands are chosen so that a pair at the threshold is rarely missed: a miss weighs ten times a
    needless candidate. Candidates, and no others, are verified exactly.
    """
    sig = cut(signatures(values, num_perm))
    found = cut(band_collisions(sig, *best_bands(threshold, num_perm, RECALL)).drop("hits"))
    return exact_overlaps(values, found).select(*PAIR, MEASURES["jaccard"]().alias("score")).where(F.col("score") >= threshold)


def ensemble_plan(threshold: float, num_perm: int, most_rows: int) -> dict[int, tuple[int, int] | None]:
    """x -> (bands, rows) for an indexed set of up to 2**x times the query's size; None: probe values instead.

    Sketches of very different sizes share too few minima: where no bands keep the misses among
    pairs at the threshold down to MOST_MISSES, the query's values find its partners.
    """
    return {x: containment_bands(threshold, 2.0**x, num_perm, most_rows, most_misses=MOST_MISSES) for x in range(-10, 41)}


def ensemble_candidates(values: DataFrame, *, threshold: float, num_perm: int, parts: int, most_rows: int, bounds: list[tuple[int, int]] | None) -> DataFrame:
    """(q_table, q_column, c_table, c_column): pairs that may reach the containment threshold."""
    sig = cut(signatures(values, num_perm))
    if bounds is None:
        bounds = size_partitions({r[0]: r[1] for r in sig.groupBy("size").count().collect()}, parts)
    plan = ensemble_plan(threshold, num_perm, most_rows)
    upper = F.coalesce(*(F.when(F.col("size") <= hi, F.lit(hi)) for _, hi in bounds), F.lit(bounds[-1][1]))
    every = sorted({p[1] for p in plan.values() if p})
    # A band of r rows begins at every r-th minimum.
    band = lambda r: F.transform(F.sequence(F.lit(0), F.lit(num_perm // r - 1)), lambda i: F.struct(F.lit(r).alias("rows"), i.alias("band"), F.xxhash64(F.slice("signature", i * r + 1, r)).alias("bucket")))
    keyed = sig.select(F.struct(*KEY).alias("k"), "size", upper.alias("upper"), F.explode(F.concat(*map(band, every))).alias("b")).select("k", "size", "upper", "b.*")
    q = keyed.select(F.col("k").alias("q"), F.col("size").alias("q_size"), "rows", "band", "bucket")
    c = keyed.select(F.col("k").alias("c"), "upper", "rows", "band", "bucket")
    ratio = lambda upper, size: F.least(F.greatest(F.ceil(F.log2(F.col(upper) / F.col(size))), F.lit(-10)), F.lit(40)).cast("int")
    code = F.create_map(*(F.lit(v) for x, p in plan.items() for v in (x, p[0] * 100 + p[1] if p else 0)))
    chosen = F.element_at(code, ratio("upper", "q_size"))
    hits = q.join(c, ["rows", "band", "bucket"]).where((F.col("q") != F.col("c")) & (F.col("rows") == chosen % 100) & (F.col("band") < F.floor(chosen / 100))).select("q", "c").distinct()
    # Beyond the sketches' reach: of the size - need + 1 values of the query with the least hashes a candidate holds one.
    sized = sig.select(*KEY, "size", upper.alias("upper"))
    far = [x for x, p in plan.items() if p is None]
    need = F.ceil(F.col("size") * F.lit(threshold) - 1e-9).cast("long")
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.xxhash64("value"), "value"))
    probes = values.join(sized, KEY).withColumn("r", nth).where(F.col("r") <= F.col("size") - need + 1).select(F.struct(*KEY).alias("q"), F.col("size").alias("q_size"), "value")
    held = values.join(sized, KEY).select(F.struct(*KEY).alias("c"), "upper", "value")
    more = probes.join(held, "value").where((F.col("q") != F.col("c")) & ratio("upper", "q_size").isin(far)).select("q", "c").distinct()
    return hits.union(more).distinct().select(F.col("q.table_name").alias("q_table"), F.col("q.column_name").alias("q_column"), F.col("c.table_name").alias("c_table"), F.col("c.column_name").alias("c_column"))


def ensemble_search(values: DataFrame, *, threshold: float = 0.8, k: int = 10, num_perm: int = NUM_PERM, parts: int = 8, most_rows: int = 4, bounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """Containment search: index columns in partitions by size, bands tuned to each partition and query size.

    For each ratio of a partition's upper size to the query's, on a grid of powers of two, (bands,
    rows) minimise the expected errors; a query probes each partition with its own, or with its
    values where sketches cannot tell (`ensemble_plan`). Candidates, and no others, are verified
    exactly, and the k best with at least the threshold returned.
    """
    found = ensemble_candidates(values, threshold=threshold, num_perm=num_perm, parts=parts, most_rows=most_rows, bounds=bounds)
    exact = exact_overlaps(values, cut(found))
    return ranked(exact.where(F.col("overlap") / F.col("q_size") >= threshold), MEASURES["containment"](), k).select(*PAIR, "score", "rank")


def equal_signatures(sig: DataFrame) -> DataFrame:
    """(table_name, column_name, first_table, first_column, columns): each column with the first of those of its signature, and their number."""
    same = sig.groupBy("signature").agg(F.min(F.struct(*KEY)).alias("first"), F.count(F.lit(1)).alias("columns"))
    return sig.join(same, "signature").select(*KEY, F.col("first.table_name").alias("first_table"), F.col("first.column_name").alias("first_column"), "columns")
