"""Temperature mixing: source shares to the power of an exponent, realised as block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, largest_group, numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Exponents that one pass over the sources' totals tries; each pass narrows the interval to a part.
GRID, PASSES = 33, 6
#: Sources up to which their weights are broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def solve_exponent(totals: DataFrame, *, entropy: float | None, max_repeat: float | None, budget: float | None) -> float:
    """The exponent, in [0, 1], of the weights share ** exponent / sum.

    entropy: that of the weights, in nats. max_repeat: the most that a source is read over, at the
    given budget of tokens or (None) at the least budget that reads every source whole once. Both
    fall as the exponent rises; it is bisected, on a grid of GRID exponents a pass over the
    sources' totals, to the smallest that meets max_repeat or the one that meets entropy. Where
    none in [0, 1] does, the nearer end is taken.
    """
    if (entropy is None) == (max_repeat is None):
        raise ValueError("give either entropy or max_repeat")
    all_ = totals.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not all_[0] or all_[1] < 2:
        return 1.0
    low, high = 0.0, 1.0
    shares = totals.select((F.col("tokens") / F.lit(float(all_[0]))).alias("p"))
    for _ in range(PASSES):
        grid = [low + (high - low) * k / (GRID - 1) for k in range(GRID)]
        each = shares.select("p", F.explode(F.array(*map(F.lit, grid))).alias("a"))
        raw, log = F.pow("p", "a"), F.ln("p")
        sums = each.groupBy("a").agg(F.sum(raw).alias("z"), F.sum(raw * log).alias("l"), F.max(raw / F.col("p")).alias("most"), F.min(raw / F.col("p")).alias("least"))
        # H = ln z - a * sum(raw * ln p) / z; a source is read weight * budget / tokens times.
        rows = {r.a: r for r in sums.collect()}  # GRID rows
        value = [(math.log(r.z) - r.a * r.l / r.z) if entropy is not None else (r.most / r.least if budget is None else r.most / r.z * budget / all_[0]) for r in (rows[a] for a in grid)]
        goal = entropy if entropy is not None else max_repeat
        at = next((k for k, v in enumerate(value) if v <= goal), None)
        if at is None:
            return high
        if at == 0:
            return low
        low, high = grid[at - 1], grid[at]
    return high


def uses(docs: DataFrame, *, entropy: float | None = None, max_repeat: float | None = None, budget: int | None = None, block_tokens: int = 1_000_000, seed: int = 17, id: str = "doc_id", source: str = "source", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(doc, pass, tokens, block, slot): one row per use of a document; doc holds all its columns. See mix."""
    count = (word_count(text) if tokens is None else tokens).cast("long")
    key = lambda of: F.xxhash64(F.lit(seed), of(id), of(text))
    # Narrow rows decide: words are counted once, and texts are not moved for it.
    narrow = cut(docs.select(F.col(source).cast("string").alias("source"), count.alias("tokens"), key(F.col).alias("key")))
    facts = cut(narrow.groupBy("source").agg(F.sum("tokens").alias("all"), F.count(F.lit(1)).alias("rows")))
    exponent = solve_exponent(facts.where(F.col("all") > 0).select(F.col("all").alias("tokens")), entropy=entropy, max_repeat=max_repeat, budget=budget)
    sources, all_, raw = facts.agg(F.count(F.lit(1)), F.sum("all"), F.sum("rows")).first()
    all_ = float(all_ or 0) or 1.0
    weights = facts.withColumn("raw", F.when(F.col("all") > 0, F.pow(F.col("all") / F.lit(all_), F.lit(exponent))).otherwise(0.0))
    z, times = weights.agg(F.sum("raw"), F.max(F.when(F.col("all") > 0, F.col("all") / F.col("raw")))).first()
    z = z or 1.0
    # weight * budget >= tokens for every source at the least such budget.
    whole = float(budget) if budget is not None else (times or 0.0) * z
    goal = F.when(F.col("all") > 0, F.greatest(F.col("raw") / F.lit(z) * F.lit(whole), F.lit(0.0)))
    # At the least budget, one source's goal is its tokens but for rounding.
    ratio = F.round(goal / F.col("all"), 9)
    weights = weights.select(F.col("source").alias("s"), "all", F.coalesce(ratio, F.lit(1.0)).alias("times"))
    weights = F.broadcast(weights) if (sources or 0) <= BROADCAST_SOURCES else weights
    each = narrow.join(weights, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("times") - 1, F.lit(0)).cast("int"))).alias("pass"))
    each = cut(each.withColumn("h", F.xxhash64("key", "pass")))
    placed = numbered(each, ["source", "pass"], ["h", "key", "tokens"], largest_group(each, ["source", "pass"]), "rank", {"before": "tokens"})
    stream = F.col("pass") * F.col("all") + F.col("before")
    limit = F.col("times") * F.col("all")
    taken = placed.where((stream < limit) | (F.col("all") == 0) | ((F.col("tokens") == 0) & (stream <= limit)))
    blocks = max(1, math.ceil(whole / block_tokens))
    part = F.coalesce(stream / F.when(limit > 0, limit), F.col("rank") / F.lit(float(raw or 1)))
    taken = taken.withColumn("block", F.least(F.floor(part * blocks), F.lit(blocks - 1)).cast("long"))
    taken = cut(taken.select("key", "pass", "tokens", "block", F.xxhash64("h", F.lit(seed)).alias("h")))
    slots = numbered(taken, ["block"], ["h", "key", "pass"], largest_group(taken, ["block"]), "slot").drop("h")
    # Rows with one key are equal in id and text: each use is matched to one of them by its number.
    nth = Window.partitionBy("key").orderBy("key")
    nth_use = Window.partitionBy("key", "pass").orderBy("block", "slot")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).withColumn("key", key(F.col("doc").getField))
    rows = rows.withColumn("nth", F.row_number().over(nth))
    chosen = slots.withColumn("nth_use", F.row_number().over(nth_use)).select(F.col("key").alias("k"), "pass", "tokens", "block", "slot", "nth_use")
    return rows.join(chosen, (F.col("key") == F.col("k")) & (F.col("nth") == F.col("nth_use"))).select("doc", "pass", "tokens", "block", "slot")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per use of a document: its columns, then _pass, _tokens, _block and _slot.

    options: those of uses(). Source i gets weight_i * budget tokens. It is read in whole passes,
    each in a permutation of its own; in the last, partial pass documents are taken in order
    until the rest of the budget is met, so a source exceeds its tokens by less than one
    document. budget None: the least that reads every source whole at least once, so no document
    is lost. The output is a sequence of blocks of about block_tokens tokens; each holds an equal
    part of every source's stream, so that every block has the target weights, in a permuted
    order: _slot is 0, 1, ... within _block.

    Tokens are words of the text unless `tokens` gives a column. Documents without tokens (null or
    blank text) go along with the passes of their source; a source without any tokens is read
    once. A null source is a source. Repeated rows are documents of their own. An empty table
    gives an empty result. Columns _pass, _tokens, _block and _slot of docs, if any, are
    replaced; uses() keeps them, and others may have any name.
    """
    new = ("pass", "tokens", "block", "slot")
    own = [c for c in docs.columns if c.lower() not in {f"_{n}" for n in new}]
    return uses(docs, **options).select(*(F.col("doc").getField(c).alias(c) for c in own), *(F.col(c).alias(f"_{c}") for c in new))
