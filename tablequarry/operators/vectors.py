"""Search over vectors: nearest neighbours, epsilon joins, pivots and grids, embedding table search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import planes, sign_bits
from ..functions.stats import assignment
from ..functions.vectors import cosine
from ..sources.store import cut

#: Query vectors that one task holds against the blocks of all vectors.
QUERY_BLOCK = 2_000
#: Vectors that a block of queries meets in one task.
VECTOR_PART = 20_000


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def knn(vectors: DataFrame, queries: DataFrame, k: int, *, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(q_id, c_id, score, rank): the k nearest others of each query by cosine, exactly.

    Queries are dealt into blocks; each block meets all vectors in batches of one matrix product,
    and each batch keeps k candidates a query. A final ranking merges them.
    """
    asked = queries.select(F.col(id).alias("q_id"), F.col(embedding).alias("q"))
    n = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("q_id"), F.lit(n))).select("block", F.lit(0).alias("kind"), F.col("q_id").alias("id"), F.col("q").alias("v"))
    parts = max(1, math.ceil(vectors.count() / VECTOR_PART))
    # Every part of the vectors meets every block of queries; a part's rows go once to each block.
    part = F.pmod(F.xxhash64(F.col(id)), F.lit(parts))
    rows = vectors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"), part.alias("part"), F.lit(1).alias("kind"), F.col(id).alias("id"), F.col(embedding).alias("v"))
    asks = blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "kind", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        kind, ids = t["kind"].to_numpy(), t["id"].to_numpy()
        v = _matrix(t["v"].combine_chunks())
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        q, c = kind == 0, kind == 1
        score = np.round(v[q] @ v[c].T, 6)
        score[ids[q][:, None] == ids[c][None, :]] = -2
        out = []
        for i, row in enumerate(score):
            best = np.lexsort((ids[c], -row))[:k]
            out += [(int(ids[q][i]), int(ids[c][j]), float(row[j])) for j in best if row[j] > -2]
        yield pa.RecordBatch.from_arrays([pa.array([x[p] for x in out], t_) for p, t_ in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["q_id", "c_id", "score"])

    found = rows.unionByName(asks).groupBy("block", "part").applyInArrow(run, "q_id long, c_id long, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "c_id"))).where(F.col("rank") <= k)


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k pivots from a bounded sample: farthest points first, beginning with the one farthest from the mean."""
    pivots = [int(np.argmax(np.linalg.norm(sample - sample.mean(axis=0), axis=1)))]
    near = np.linalg.norm(sample - sample[pivots[0]], axis=1)
    while len(pivots) < min(k, len(sample)):
        pivots.append(int(np.argmax(near)))
        near = np.minimum(near, np.linalg.norm(sample - sample[pivots[-1]], axis=1))
    return sample[pivots]


def pivot_sample(vectors: DataFrame, k: int, *, rows: int = 1_000, id: str = "vec_id", embedding: str = "embedding") -> list[list[float]]:
    """Pivots from the `rows` vectors of the smallest id hashes."""
    got = vectors.where(F.col(embedding).isNotNull()).orderBy(F.xxhash64(id), id).limit(rows).select(embedding).collect()
    return choose_pivots(np.array([r[0] for r in got], dtype=float), k).tolist()


def pivot_eps_join(queries: DataFrame, vectors: DataFrame, eps: float, pivots: list[list[float]], *, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(q_id, c_id, dist) of pairs within eps.

    Vectors fall into grid cells by their distances to the first two pivots, cells being eps wide;
    a query goes to its own and the neighbouring ones. In a cell the triangle inequality over all
    pivots excludes pairs, and a matrix product gives the distances of the rest. The vectors are
    dealt into parts, so that no task holds a whole dense cell; queries go to each part.
    """
    base = np.array(pivots)
    grid = min(2, len(base))
    parts = max(1, math.ceil(vectors.count() / VECTOR_PART))

    def coordinates(side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = np.sqrt(np.maximum(((_matrix(b.column("v"))[:, None, :] - base[None]) ** 2).sum(axis=2), 0))
                cell = np.floor(d[:, :grid] / eps).astype(np.int64)
                key = [str(list(map(int, c))) for c in cell]
                near = [[str([int(x) + s for x, s in zip(c, shift, strict=True)]) for shift in np.array(np.meshgrid(*[[-1, 0, 1]] * grid)).T.reshape(-1, grid).tolist()] for c in cell] if side == 0 else [[k] for k in key]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(list(d), pa.list_(pa.float64())), pa.array(near, pa.list_(pa.string()))], ["id", "v", "d", "cells"])

        return run

    def placed(df: DataFrame, side: int) -> DataFrame:
        rows = df.where(F.col(embedding).isNotNull()).select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
        part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if side == 0 else F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        return rows.mapInArrow(coordinates(side), "id long, v array<double>, d array<double>, cells array<string>").select("id", "v", "d", F.explode("cells").alias("cell")).select("id", "v", "d", "cell", F.lit(side).alias("side"), part.alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        side, ids = t["side"].to_numpy(), t["id"].to_numpy()
        v, d = _matrix(t["v"].combine_chunks()), _matrix(t["d"].combine_chunks())
        q, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: list[list[np.ndarray]] = [[], [], []]
        for k in range(0, len(q) if len(c) else 0, 256):
            a = q[k : k + 256]
            near = (v[a] ** 2).sum(axis=1)[:, None] + (v[c] ** 2).sum(axis=1)[None] - 2 * v[a] @ v[c].T <= eps * eps + 1e-6
            for p in range(len(base)):
                near &= np.abs(d[a, p][:, None] - d[c, p][None]) <= eps + 1e-9
            i, j = np.nonzero(near & (ids[a][:, None] != ids[c][None]))
            dist = np.sqrt(((v[a[i]] - v[c[j]]) ** 2).sum(axis=1))
            for x, y in zip(out, (ids[a[i]], ids[c[j]], dist), strict=True):
                x.append(y[dist <= eps])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, dtype), *x])) for x, dtype in zip(out, (np.int64, np.int64, np.float64), strict=True)], ["q_id", "c_id", "dist"])

    return placed(queries, 0).unionByName(placed(vectors, 1)).groupBy("cell", "part").applyInArrow(run, "q_id long, c_id long, dist double")


def vector_joinable(matches: DataFrame, items: DataFrame, threshold: float, k: int) -> DataFrame:
    """Fuzzy joinability: (q_col, c_col, score, rank), the share of a query column's vectors that have a match in a column.

    matches: (q_id, c_id); items: (id, col). A query vector counts once, however many it matches.
    """
    q, c = items.select(F.col("id").alias("q_id"), F.col("col").alias("q_col")), items.select(F.col("id").alias("c_id"), F.col("col").alias("c_col"))
    hit = matches.join(q, "q_id").join(c, "c_id").where("q_col != c_col").select("q_col", "c_col", "q_id").distinct().groupBy("q_col", "c_col").agg(F.count(F.lit(1)).alias("n"))
    sizes = q.groupBy("q_col").agg(F.count(F.lit(1)).alias("size"))
    scored = hit.join(sizes, "q_col").select("q_col", "c_col", F.round(F.col("n") / F.col("size"), 6).alias("score")).where(F.col("score") >= threshold)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q_col").orderBy(F.desc("score"), "c_col"))).where(F.col("rank") <= k)


def mean_vectors(vectors: DataFrame, group: str, dim: int, embedding: str = "embedding") -> DataFrame:
    """(group, n, mean): componentwise means, combined before the shuffle."""
    return vectors.where(F.col(embedding).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.round(F.avg(F.col(embedding)[i].cast("double")), 6) for i in range(dim))).alias("mean"))


def two_part_vectors(vectors: DataFrame, at: int, dim: int, *, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, embedding): vectors whose cosine is the mean of two: of the first `at` components about their mean, and of the rest.

    For encodings of a column's own features followed by those of its context.
    """
    means = vectors.where(F.col(embedding).isNotNull()).agg(F.array(*(F.avg(F.col(embedding)[i].cast("double")) for i in range(at))).alias("m"))
    both = vectors.where(F.col(embedding).isNotNull()).join(F.broadcast(means))  # one row
    first = F.zip_with(F.slice(embedding, 1, at), "m", lambda x, m: x.cast("double") - m)
    rest = F.transform(F.slice(embedding, at + 1, dim - at), lambda x: x.cast("double"))
    unit = lambda a: F.transform(a, lambda x: x / F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, y: s + y * y)))
    parts = both.select(F.col(id), first.alias("a"), rest.alias("b"))
    return parts.select(id, F.concat(unit(F.col("a")), unit(F.col("b"))).alias(embedding))


def projection_bits(vectors: DataFrame, bits: int, dim: int, *, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    return vectors.select(F.col(id).alias("id"), sign_bits(F.col(embedding), planes(bits, dim)).alias("bits"))


def weight_matrix(pairs: dict[str, list], rows: list[str], cols: list[str]) -> np.ndarray:
    """The greatest score of each row (q_column) and column (c_column)."""
    w, at, of = np.zeros((len(rows), len(cols))), {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
    np.maximum.at(w, ([at[x] for x in pairs["q_column"]], [of[x] for x in pairs["c_column"]]), pairs["score"])
    return w


def best_matching(weights: DataFrame, *, normalised: bool = False) -> DataFrame:
    """(q_table, c_table, score, n_pairs): the one-to-one matching of columns with the greatest total weight, per table pair.

    weights: (q_table, q_column, c_table, c_column, score). A table pair's columns fit one task.
    normalised: divides by n_q + n_c - matched, columns being those that occur in weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).to_pydict()
        rows, cols = sorted(set(t["q_column"])), sorted(set(t["c_column"]))
        w = weight_matrix(t, rows, cols)
        pairs = assignment(w)
        total = math.fsum(w[p] for p in pairs)
        score = total / (len(rows) + len(cols) - len(pairs)) if normalised else total
        yield pa.RecordBatch.from_pylist([{"q_table": t["q_table"][0], "c_table": t["c_table"][0], "score": round(score, 6), "n_pairs": len(pairs)}])

    return weights.groupBy("q_table", "c_table").applyInArrow(run, "q_table string, c_table string, score double, n_pairs long")


def embedding_table_search(items: DataFrame, neighbours: DataFrame, vectors: DataFrame, threshold: float, k: int, *, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Tables for tables by column embeddings: candidates from the columns' neighbours, verified by the best matching.

    items: (id, table_name, column_name); neighbours: (q_id, c_id), which only name candidate
    tables. The matching weighs all column pairs of a candidate table whose cosine is over the threshold.
    """
    side = lambda p: items.select(F.col("id").alias(f"{p}_id"), F.col("table_name").alias(f"{p}_table"), F.col("column_name").alias(f"{p}_column"))
    candidates = neighbours.join(side("q"), "q_id").join(side("c"), "c_id").where("q_table != c_table").select("q_table", "c_table").distinct()
    full = lambda p: side(p).join(vectors.select(F.col(id).alias(f"{p}_id"), F.col(embedding).alias(f"{p}_v")), f"{p}_id")
    pairs = candidates.join(full("q"), "q_table").join(full("c"), "c_table")
    weights = pairs.select("q_table", "q_column", "c_table", "c_column", F.round(cosine(F.col("q_v"), F.col("c_v")), 6).alias("score")).where(F.col("score") > threshold)
    w = Window.partitionBy("q_table").orderBy(F.desc("score"), "c_table")
    return best_matching(weights).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def simhash(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, simhash): 64 bits, each set where more of the words' hashes have it than not. Words count as often as they occur."""
    from ..functions.text import tokens

    # Equal words of a document are counted first, so its votes are added once for each distinct word.
    words = docs.select(F.col(id).alias("id"), F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("n"))
    half = lambda at: F.conv(F.substring(F.md5("w"), at, 8), 16, 10).cast("long")
    words = words.select("id", "n", half(1).alias("low"), half(9).alias("high"))
    vote = lambda b: F.sum((F.call_function("shiftright", F.col("low" if b < 32 else "high"), F.lit(b % 32)).bitwiseAND(F.lit(1)) * 2 - 1) * F.col("n"))
    bit = lambda b: F.lit(2**b if b < 63 else -(2**63)).cast("long")
    total = reduce(Column.bitwiseOR, (F.when(vote(b) > 0, bit(b)).otherwise(F.lit(0).cast("long")) for b in range(64)))
    return words.groupBy("id").agg(total.alias("simhash"))


def hamming_pairs(hashes: DataFrame, most: int, bits: int = 64) -> DataFrame:
    """(a, b, distance) of rows whose hashes differ in at most `most` bits: they agree on one of most + 1 bands.

    Equal hashes are joined once: a is the smallest id of a hash and b that of another, and
    every further id of a hash pairs with its smallest at distance 0.
    """
    one = cut(hashes.groupBy("simhash").agg(F.min("id").alias("rep")))
    width = math.ceil(bits / (most + 1))
    bands = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.call_function("shiftright", F.col("simhash"), F.lit(i * width)).bitwiseAND(F.lit(2 ** min(width, bits - i * width) - 1)).alias("bucket")) for i in range(most + 1))))
    keyed = one.select("rep", "simhash", bands.alias("b"))
    x, y = keyed.select(F.col("rep").alias("a"), F.col("simhash").alias("ha"), "b"), keyed.select(F.col("rep").alias("b_"), F.col("simhash").alias("hb"), "b")
    d = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    pairs = x.join(y, "b").where(F.col("a") < F.col("b_")).select("a", F.col("b_").alias("b"), d.alias("distance")).where(F.col("distance") <= most).distinct()
    copies = hashes.join(one, "simhash").where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    return pairs.union(copies)
