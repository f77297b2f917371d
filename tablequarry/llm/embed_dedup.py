"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors, cosine >= t means a squared distance of at most 2 - 2t. Vectors are rotated and
split into blocks of few dimensions. If every block's squared distance exceeded its share of that
budget, the sum would exceed the whole; so partners lie within its share in one block at least.
Each block range-joins on its own: cells along its leading coordinate, then the block's distances
by matrix products, tile by tile. What a block finds is verified by exact cosines in double
precision, and a pair counts only in the first block that finds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

#: Vectors of a cell that one side of a tile holds, and rows of it multiplied at once.
TILE_ROWS, STRIP = 8_192, 1_024
#: Rotated coordinates are rounded to this step, so that a block's decision on a pair is the same everywhere.
STEP = 2.0**-24


def rotation(dim: int, seed: int = 20_240_229) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine up to rounding."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows over their lengths, scaled first so that no square over- or underflows."""
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _turned(raw: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return np.round(_unit(raw) @ turn / STEP) * STEP


def _flat(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _edges(dim: int, blocks: int) -> list[tuple[int, int]]:
    cuts = [round(k * dim / blocks) for k in range(blocks + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class _Tile:
    """Joins one side of a tile with itself or with the other side, in one block."""

    def __init__(self, turn: np.ndarray, spans: list[tuple[int, int]], budgets: np.ndarray, block: int, cosine: float):
        self.turn, self.spans, self.budgets, self.block, self.cosine = turn, spans, budgets, block, cosine

    def pairs(self, a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index arrays of verified pairs; b None: within a."""
        (low, high), budget = self.spans[self.block], self.budgets[self.block]
        ta, same = _turned(a, self.turn), b is None
        b, tb = (a, ta) if same else (b, _turned(b, self.turn))
        xa, xb = (t[:, low:high].astype(np.float32) for t in (ta, tb))
        na, nb = (np.einsum("ij,ij->i", x, x) for x in (xa, xb))
        ua, ub = _unit(a), _unit(b)
        for s in range(0, len(a), STRIP):
            for t in range(s if same else 0, len(b), STRIP):
                # Single precision with room to spare finds candidates; the rest is exact.
                near = na[s : s + STRIP, None] + nb[None, t : t + STRIP] - 2 * (xa[s : s + STRIP] @ xb[t : t + STRIP].T) <= budget + 1e-4
                i, j = np.nonzero(near)
                i, j = i + s, j + t
                if same:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), 65_536):
                    p, q = i[k : k + 65_536], j[k : k + 65_536]
                    d = (ta[p] - tb[q]) ** 2
                    found = np.stack([d[:, x:y].sum(axis=1) for x, y in self.spans], axis=1) <= self.budgets
                    first = found[:, self.block] & ~found[:, : self.block].any(axis=1)
                    p, q = p[first], q[first]
                    linked = np.einsum("ij,ij->i", ua[p], ub[q]) >= self.cosine
                    yield p[linked], q[linked]


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.9, blocks: int = 4, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link when their cosine, in double precision, is at least `cosine` (over 0). n_links
    counts the other vectors linked directly, component_id is the smallest id reachable by links,
    itself included, kept says that it is the row's own. Identical vectors are joined once and
    counted as often as they occur.

    A vector that is null, empty, zero, or holds a null or non-finite component links with
    nothing; vectors of different dimension do not link with each other. Rows without an id count
    as links of others, and their component is that of the identical vectors. Repeated rows count
    each. An empty table gives an empty result; further columns are not read.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0 and at most 1")
    v = F.col("v")
    kind = "float" if dict(vectors.dtypes)[embedding] == "array<float>" else "double"
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(embedding).cast(f"array<{kind}>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    good = F.coalesce((F.size("v") > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value.
    rows = rows.select("id", F.when(good, F.transform(v, lambda x: (x + F.lit(0.0)).cast(kind))).alias("v"))
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times")).select(F.monotonically_increasing_id().alias("class"), "v", "rep", "times"))
    links = edges = None
    for (dim,) in sorted(tuple(r) for r in classes.select(F.size("v")).distinct().collect()):
        l, e = _join(classes.where(F.size("v") == dim), dim, blocks, cosine)
        links, edges = (l, e) if links is None else (links.union(l), edges.union(e))
    if links is None:
        return vectors.select(F.col(id), F.lit(0).cast("long").alias("n_links"), F.col(id).alias("component_id"), F.lit(True).alias("kept"))
    found = components(edges)
    # Components carry class numbers; the smallest id in each names it.
    named = classes.select("class", "rep").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    more = links.groupBy("class").agg(F.sum("n").alias("n"))
    facts = classes.select("class", "v", "times").join(named.join(names, "component").select("class", "component_id"), "class").join(more, "class", "left").select("v", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), "component_id")
    linked = rows.where("v is not null").join(facts, "v").select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _join(classes: DataFrame, dim: int, blocks: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(class, n): rows linked with a class, in parts; (u, v): links that connect the same classes as all links."""
    spans = _edges(dim, min(blocks, dim))
    turn, long = rotation(dim), pa.int64()
    whole = 2 - 2 * cosine + 1e-9

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _turned(_flat(batch.column("v")), turn)
            energy = np.stack([(t[:, a:b] ** 2).sum(axis=1) for a, b in spans], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("v"), batch.column("times"), pa.array(list(t[:, [a for a, _ in spans]]), pa.list_(pa.float64())), pa.array(list(energy), pa.list_(pa.float64()))], ["class", "v", "times", "lead", "energy"])

    placed = cut(classes.select("class", "v", "times").mapInArrow(leads, f"class long, v {classes.schema['v'].dataType.simpleString()}, times long, lead array<double>, energy array<double>"))
    # Each block's share of the budget is in proportion to its share of all vectors' energy.
    energy = np.array(placed.select(*(F.sum(F.col("energy")[k]) for k in range(len(spans)))).first(), dtype=float)
    budgets = whole * energy / energy.sum()
    cells = placed.select("class", "v", "times", F.posexplode("lead").alias("block", "x"))
    reach = F.element_at(F.array(*(F.lit(float(math.sqrt(b)) + STEP) for b in budgets)), F.col("block") + 1)
    cells = cells.withColumn("reach", reach).withColumn("cell", F.floor(F.col("x") / F.col("reach")))
    sizes = cells.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("rows"))
    # A cell of many vectors is dealt into chunks; each pair of chunks of a cell, or of neighbouring cells, is a tile.
    sizes = cut(sizes.select("block", "cell", F.ceil(F.col("rows") / TILE_ROWS).alias("chunks")))
    upper = sizes.select("block", (F.col("cell") - 1).alias("cell"), F.col("chunks").alias("above"))
    lower = sizes.select("block", (F.col("cell") + 1).alias("cell"), F.col("chunks").alias("below"))
    cells = cells.join(sizes, ["block", "cell"]).join(upper, ["block", "cell"], "left").join(lower, ["block", "cell"], "left").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")))
    # Roles: (cell, home chunk, other chunk, whether the other is of the cell above, side).
    each = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    role = lambda cell, i, j, up, side: F.struct(cell.alias("c"), i.alias("i"), j.alias("j"), F.lit(up).alias("up"), side.alias("side"))
    cell, chunk, zero = F.col("cell"), F.col("chunk"), F.lit(0)
    roles = F.concat(
        F.transform(each(F.col("chunks")), lambda o: role(cell, F.least(chunk, o), F.greatest(chunk, o), False, F.when(chunk <= o, zero).otherwise(1))),
        F.transform(each(F.coalesce("above", zero)), lambda o: role(cell, chunk, o, True, zero)),
        F.transform(each(F.coalesce("below", zero)), lambda o: role(cell - 1, o, chunk, True, F.lit(1))),
    )
    tiles = cells.select("block", "class", "v", "times", F.explode(roles).alias("t")).select("block", "t.*", "class", "v", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        key, times, side = (rows[c].to_numpy() for c in ("class", "times", "side"))
        raw = _flat(rows["v"].combine_chunks() if isinstance(rows["v"], pa.ChunkedArray) else rows["v"])
        within = not rows["up"][0].as_py() and rows["i"][0].as_py() == rows["j"][0].as_py()
        tile = _Tile(turn, spans, budgets, rows["block"][0].as_py(), cosine)
        a, b = (np.arange(len(key)), None) if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        n, label, edges = np.zeros(len(key), dtype=np.int64), np.arange(len(key)), []
        for p, q in tile.pairs(raw[a], None if within else raw[b]) if len(a) and (within or len(b)) else ():
            p, q = a[p], (a if within else b)[q]
            np.add.at(n, p, times[q])
            np.add.at(n, q, times[p])
            # Links whose ends have one label already connect nothing new.
            while (new := label[p] != label[q]).any():
                p, q = p[new], q[new]
                edges.append((key[p[0]], key[q[0]]))
                label[label == label[q[0]]] = label[p[0]]
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(n[hit]), pa.nulls(len(hit), long)], ["class", "n", "other"])
        if edges:
            u, v = np.array(edges, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), long), pa.array(v)], ["class", "n", "other"])

    found = cut(tiles.groupBy("block", "c", "i", "j", "up").applyInArrow(run, "class long, n long, other long"))
    return found.where("n is not null").select("class", "n"), found.where("other is not null").select(F.col("class").alias("u"), F.col("other").alias("v"))
