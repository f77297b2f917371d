"""Exact Jaccard join of word n-gram sets by pivots, Voronoi regions and triangle-inequality windows.

Jaccard distance is a metric, but over 5-word shingles almost every document is at distance 1
from any given pivot, where the triangle inequality excludes nothing. So pivots are not drawn
blindly: documents that share a rare shingle which a partner of theirs must share gather round
one of them, the pivot, and form its region (`_regions`). A document that several pivots claim is
replicated into all their regions. Distances to the pivot then decide most of a region at once
(`_rays`), and what the pivot leaves open is joined recursively with new pivots (`_join_region`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bitmap, components, cut, maybe_in, release, slices

#: Members, and bytes of shingles, of a region that one task joins; larger ones are joined in tiles.
TILE_ROWS, TILE_BYTES = 1_500, 24_000_000
#: Documents that the innermost join multiplies at once.
BLOCK = 256
#: A filter has 16 bits for each hash in it, and 2**27 (16 MB) at most.
MOST_FILTER_BITS = 27
#: Shingles beyond the prefix that a document's window has at least; see `window_sizes`.
SLACK = 60


class _Words(dict):
    """word -> 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted. Words: A-Z lowered, split at space and \\t to \\r."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    ids = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    mixed = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(words) - size + 1 + k]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def _least(n: int, threshold: int) -> int:
    """Shingles that a set of n shares at least with any partner."""
    return -(-threshold * n // 100)


def window_sizes(n: int, threshold: int) -> tuple[int, int]:
    """(window, probes) of a set of n shingles.

    Let a = _least(n) and s(n) a slack that never falls as n grows. Two partners' windows, their
    n - a + s(n) smallest hashes, share at least the smaller slack. As a partner has at least a
    shingles, that is s(a) or more; so, in any common order, the first window - s(a) + 1 of one
    window and those of the other share one. These probes are taken rarest first.
    """
    slack = lambda m: min(_least(m, threshold), max(-(-m // 10), SLACK))
    window = n - _least(n, threshold) + slack(n)
    return window, window - slack(_least(n, threshold)) + 1


def _sets(docs: DataFrame, width: int, emit, schema: str) -> DataFrame:
    """emit(list of (id, set hash, set)) -> columns, over Arrow batches of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [(key, s, xxhash.xxh3_128_digest(s.tobytes())) for key, s in ((k, shingles(t, width)) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))]
                yield emit(found)

    return docs.mapInArrow(run, schema)


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _batch(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], list(types))


def _regions(texts: DataFrame, classes: DataFrame, width: int, threshold: int) -> DataFrame:
    """(id, n, pivot): for each pair of partners there is a pivot whose region holds both."""
    spark = texts.sparkSession
    long = pa.int64()

    def windows(found):
        sizes = [window_sizes(len(s), threshold)[0] if len(s) else 0 for _, s, _ in found]
        return _batch({"h": np.concatenate([np.empty(0, np.int64), *(s[:k] for (_, s, _), k in zip(found, sizes, strict=True))]), "c": np.repeat(np.array([_halves(d)[0] for *_, d in found], dtype=np.int64), sizes)}, {"h": long, "c": long})

    counted = _sets(texts, width, windows, "h long, c long").groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("a"), F.max("c").alias("b"))
    shared = cut(counted.where("a != b").select("h", "df"))  # in the windows of different sets
    release(spark)
    bits = min(MOST_FILTER_BITS, max(16, math.ceil(math.log2(16 * max(1, shared.count())))))
    mask = np.zeros(2**bits // 8, dtype=np.uint8)
    for word, data in bitmap(shared, "h", bits).collect():  # 2**bits / 8 bytes in all
        mask[(word - 1) * 4096 : word * 4096] = np.frombuffer(data, np.uint8)[: len(mask)]
    mask = spark.sparkContext.broadcast(mask)

    def probes(found):
        rows = []
        for key, s, digest in found:
            if len(s) and key is not None:  # rows without an id take part through their class's representative
                w = s[: window_sizes(len(s), threshold)[0]]
                at = w & np.int64(2**bits - 1)
                w = w[(mask.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                rows.append((key, _halves(digest)[0], len(s), w))
        sizes = [len(r[-1]) for r in rows]
        each = lambda k: np.repeat(np.array([r[k] for r in rows], dtype=np.int64), sizes)
        return _batch({"id": each(0), "c": each(1), "n": each(2), "h": np.concatenate([np.empty(0, np.int64), *(r[-1] for r in rows)])}, {"id": long, "c": long, "n": long, "h": long})

    # Two shuffles: by hash, then by document, where one copy of each set, and of each row, remains.
    rows = _sets(texts, width, probes, "id long, c long, n long, h long").join(shared, "h")
    rows = rows.join(classes.select(F.col("rep").alias("id"), "c"), ["id", "c"], "left_semi").dropDuplicates(["id", "c", "h"])
    rank = Window.partitionBy("id", "c").orderBy("df", "h")
    least = lambda n: F.ceil(F.lit(threshold) * n / 100).cast("long")
    slack = lambda n: F.least(least(n), F.greatest(F.ceil(n / 10).cast("long"), F.lit(SLACK)))
    n = F.col("n")
    window = n - least(n) + slack(n)
    # Shingles of the window that no other set has come first; the rest of the probes are the rarest shared ones.
    left = window - slack(least(n)) + 1 - (window - F.count(F.lit(1)).over(Window.partitionBy("id", "c")))
    probing = cut(rows.select("id", "n", "h", F.row_number().over(rank).alias("r"), left.alias("left")).where("r <= left").select("id", "n", "h"))
    pivots = probing.groupBy("h").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).where("pivot != other").select("h", "pivot")
    return probing.join(pivots, "h").select("id", "n", "pivot").distinct()


def _rays(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact overlap of each region's members with its pivot: (id, pivot, n, n_pivot, shared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, n, m = [], [], []
            for a, b in (x for part in slices(batch) for x in zip(part.column("s").to_pylist(), part.column("ps").to_pylist(), strict=True)):
                a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                a, b, k = (a, b, 1) if len(a) <= len(b) else (b, a, -1)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                shared.append(int((b[at] == a).sum()))
                n.append((len(a), len(b))[::k][0])
                m.append((len(a), len(b))[::k][1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("pivot"), *(pa.array(x, pa.int64()) for x in (n, m, shared))], ["id", "pivot", "n", "n_pivot", "shared"])

    joined = regions.where("id != pivot").join(sets, "id").join(sets.select(F.col("id").alias("pivot"), F.col("s").alias("ps")), "pivot")
    return joined.select("id", "pivot", "s", "ps").mapInArrow(run, "id long, pivot long, n long, n_pivot long, shared long")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b."""
    tokens, column, times = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    column = np.where(times[column] > 1, number[column], -1)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    width = 1 << 14
    for low in range(0, int(number[-1]) + 1 if len(tokens) else 0, width):
        take = (column >= low) & (column < low + width)
        grid = np.zeros((len(a) + len(b), min(width, int(number[-1]) + 1 - low)), dtype=np.float32)
        grid[row[take], column[take] - low] = 1
        out += grid[: len(a)] @ grid[len(a) :].T
    return out


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _join_region(sets: list[np.ndarray], wanted, threshold: int) -> list[tuple[int, int]]:
    """Links that connect what the region's wanted pairs connect, by pivots recursively.

    wanted(i, j) -> which pairs of index arrays are asked for. Each level picks pivots far from
    each other; a member belongs to the Voronoi region of its nearest one, and is replicated into
    every region whose pivot is within twice the greatest distance of a link of that: a partner
    may be at home there. A region that stays large although it was split is joined in blocks.
    """
    size = np.array([len(s) for s in sets])
    reach = 1 - threshold / 100
    links, union = [], _Union(len(sets))

    def block(a: np.ndarray, b: np.ndarray) -> None:
        fits = np.minimum.outer(size[a], size[b]) * 100 >= np.maximum.outer(size[a], size[b]) * threshold
        fits &= wanted(a, b)
        if not fits.any():
            return
        shared = _overlaps([sets[i] for i in a], [sets[i] for i in b])
        both = size[a][:, None] + size[b][None, :] - shared
        for i, j in np.argwhere(fits & (100 * shared >= threshold * both)):
            if a[i] != b[j] and union.link(int(a[i]), int(b[j])):
                links.append((int(a[i]), int(b[j])))

    def split(home: np.ndarray, guests: np.ndarray) -> None:
        """Joins home with home and with guests."""
        everyone = np.concatenate([home, guests])
        if len(everyone) > BLOCK:
            pivots, nearest, rows = [int(home[0])], np.full(len(everyone), 2.0), []
            for _ in range(8):
                near = _overlaps([sets[pivots[-1]]], [sets[i] for i in everyone])[0]
                d = 1 - near / (size[pivots[-1]] + size[everyone] - near)
                rows.append(d)
                nearest = np.minimum(nearest, d)
                if nearest[: len(home)].max() <= reach:
                    break
                pivots.append(int(home[np.argmax(nearest[: len(home)])]))
            rows = np.array(rows)
            at = rows.argmin(axis=0)
            parts = []
            for k in range(len(rows)):
                own = at[: len(home)] == k
                # Guests may be partners of any home; homes of another region count once, in the lower region.
                close = rows[k] <= nearest + 2 * reach + 1e-9
                visiting = close.copy()
                visiting[: len(home)] &= at[: len(home)] > k
                parts.append((home[own], everyone[visiting]))
            if max(len(h) + len(g) for h, g in parts) <= 0.8 * len(everyone):
                for h, g in parts:
                    if len(h):
                        split(h, g)
                return
        for x in range(0, len(home), BLOCK):
            for y in range(x, len(home), BLOCK):
                block(home[x : x + BLOCK], home[y : y + BLOCK])
            for y in range(0, len(guests), BLOCK):
                block(home[x : x + BLOCK], guests[y : y + BLOCK])

    everyone = np.arange(len(sets))
    if len(sets) > 1:
        split(everyone, everyone[:0])
    return links


def _residues(rays: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links between members of a region that its pivot leaves open: (u, v).

    Members linked with the pivot are connected already, so a pair counts only if one of the two
    is not; and partners' distances to the pivot differ by the greatest link distance at most.
    """
    reach = 1 - threshold / 100
    all_ = F.col("n") + F.col("n_pivot") - F.col("shared")
    m = rays.select("id", "pivot", "n", (1 - F.col("shared") / all_).alias("d"), (100 * F.col("shared") >= threshold * all_).alias("ball"))
    # Facts of pivots are written before they meet members, and the members left before they are counted:
    # a join that no aggregation shares its stage with can be split where one pivot has most rows.
    nearest = cut(m.where("not ball").groupBy("pivot").agg(F.min("d").alias("near")))
    m = cut(m.join(nearest, "pivot").where(~F.col("ball") | (F.col("d") >= F.col("near") - reach - 1e-9)).drop("near"))
    counts = m.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all")).where("rows > 1")
    tiles = F.greatest(F.ceil(F.col("rows") / TILE_ROWS), F.ceil(F.col("all") * 8 / TILE_BYTES))
    m = m.join(cut(counts.select("pivot", tiles.alias("tiles"))), "pivot").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("tiles")))
    m = m.join(sets, "id").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")).select("pivot", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "d", "ball", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("id")
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        id_, d, ball, chunk = (rows[c].to_numpy() for c in ("id", "d", "ball", "chunk"))
        found = _join_region(
            [np.frombuffer(x, np.int64) for x in rows["s"].to_pylist()],
            lambda a, b: ~np.logical_and.outer(ball[a], ball[b]) & (np.abs(np.subtract.outer(d[a], d[b])) <= reach + 1e-9) & ((i == j) | np.not_equal.outer(chunk[a], chunk[b])),
            threshold,
        )
        yield pa.RecordBatch.from_arrays([pa.array([int(id_[x[k]]) for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return m.groupBy("pivot", "i", "j").applyInArrow(run, "u long, v long")


def jaccard_components(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Two documents link when 100 * |intersection| >= threshold * |union| of their sets of distinct
    width-word shingles; component_id is the smallest id reachable by links, itself included, and
    kept says that it is the row's own. Equal sets meet first, so copies form no pairs, and links
    inside what is known to be connected are not sought; all links between components are found.

    A null, empty or blank text has an empty set and links with nothing. Rows that share an id
    are one document with each of their texts. Rows with a null id take part through rows of
    equal sets only. An empty table gives an empty result; further columns are not read.
    """
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    long = pa.int64()

    def describe(found):
        c = [_halves(d) for *_, d in found]
        return _batch({"id": [k for k, *_ in found], "n": [len(s) for _, s, _ in found], "c": [a for a, _ in c], "c2": [b for _, b in c]}, {"id": long, "n": long, "c": long, "c2": long})

    known = cut(_sets(texts, width, describe, "id long, n long, c long, c2 long"))
    classes = cut(known.where("n > 0").groupBy("c", "c2").agg(F.min("id").alias("rep")))
    regions = cut(_regions(texts, classes.where("rep is not null"), width, threshold))
    release(docs.sparkSession)
    members = regions.select("id").union(regions.select("pivot")).distinct()
    bits = 23
    some = maybe_in(texts.withColumn("_h", F.xxhash64("id")), "_h", bitmap(members.select(F.xxhash64("id").alias("h")), "h", bits), bits).select("id", "text")
    sets = _sets(some, width, lambda found: _batch({"id": [k for k, *_ in found], "s": [s.tobytes() for _, s, _ in found]}, {"id": long, "s": pa.binary()}), "id long, s binary")
    sets = cut(sets.join(members, "id", "left_semi").dropDuplicates(["id", "s"]))
    rays = cut(_rays(regions, sets))
    release(docs.sparkSession)
    linked = rays.where(100 * F.col("shared") >= threshold * (F.col("n") + F.col("n_pivot") - F.col("shared"))).select(F.col("id").alias("u"), F.col("pivot").alias("v"))
    # Rows that share an id with rows of other classes are one node.
    found = components(linked.union(_residues(rays, sets, threshold)))
    classes = classes.join(found, F.col("rep") == F.col("node"), "left").select("c", "c2", F.coalesce("component", "rep").alias("component"))
    alone = known.where("n = 0").select("id", "n", F.col("id").alias("component"))
    rest = known.where("n > 0").join(classes, ["c", "c2"]).select("id", "n", "component")
    return alone.union(rest).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
