"""Numeric routines and column expressions."""

import itertools
import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablequarry.functions import hashing, stats, text


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.integers(1, 5))
def test_assignment_is_optimal(seed, n, m):
    w = np.random.default_rng(seed).random((n, m))
    pairs = stats.assignment(w)
    assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
    v = w if n <= m else w.T
    best = max(sum(v[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(v.shape[1]), v.shape[0]))
    total = sum(w[p] for p in pairs)
    assert math.isclose(total, best) and total >= sum(w[p] for p in stats.greedy(w)) - 1e-12


def test_assignment_of_the_toy():
    # Three agents, four receivers: 3 + 2 + 4.
    w = np.array([[3, 0, 2, 0], [0, 2, 0, 1], [1, 0, 4, 2]])
    assert stats.assignment(w) == [(0, 0), (1, 1), (2, 2)]
    assert stats.assignment(np.zeros((2, 2))) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 30), st.integers(1, 30), st.integers(0, 30), st.integers(0, 30))
def test_hypergeometric(t, population, marked, drawn):
    marked, drawn = min(marked, population), min(drawn, population)
    exact = sum(math.comb(marked, k) * math.comb(population - marked, drawn - k) for k in range(0, t + 1) if k <= marked and k <= drawn) / math.comb(population, drawn)
    assert abs(stats.hypergeometric_cdf(t, population, marked, drawn) - exact) < 1e-9


def test_f_distribution():
    assert abs(stats.f_cdf(3.0, 5, 10) - 0.934442437906) < 1e-9
    assert abs(stats.f_cdf(1.0, 7, 7) - 0.5) < 1e-9
    assert stats.f_cdf(0, 3, 3) == 0


def test_hotelling():
    r = np.random.default_rng(0)
    a, b = r.standard_normal((40, 3)), r.standard_normal((50, 3))
    as_moments = lambda x: {"n": len(x), "sums": x.sum(axis=0).tolist(), "products": (x.T @ x).ravel().tolist()}
    assert abs(stats.hotelling_score(a, b) - stats.hotelling_from_moments(as_moments(a), as_moments(b), 3)) < 1e-9
    assert stats.hotelling_score(a, b + 5) < 1e-6 < 0.01 < stats.hotelling_score(a, b)
    assert stats.hotelling_score(a[:1], b) == -1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=7), st.integers(1, 4))
def test_size_partitions_are_optimal(sizes, parts):
    keys = sorted(sizes)
    cost = lambda group: sum(sizes[k] * (group[-1] - k) / group[-1] for k in group)
    found = stats.size_partitions(sizes, parts)
    groups = [[k for k in keys if lo <= k <= hi] for lo, hi in found]
    assert sum(groups, []) == keys and len(groups) <= parts
    best = min(sum(cost(keys[a:b]) for a, b in zip((0, *cut), (*cut, len(keys)), strict=True)) for n in range(min(parts, len(keys))) for cut in itertools.combinations(range(1, len(keys)), n))
    assert abs(sum(map(cost, groups)) - best) < 1e-9


def test_bands():
    b, r = stats.best_bands(0.5, 64)
    assert b * r <= 64 and 0.3 < (1 / b) ** (1 / r) < 0.7
    low, high = stats.containment_bands(0.8, 1, 64, 4), stats.containment_bands(0.8, 64, 64, 4)
    assert low[1] >= high[1]  # a large set needs fewer rows to a band


def test_text(spark):
    rows = [("Ab-12 (x) é",), ("12.50",), ("ann@x.org",), ("",), ("abc",), ("abcd",)]
    df = spark.createDataFrame(rows, "v string")
    c = F.col("v")
    got = {r.v: r for r in df.select("v", text.alnum(c).alias("a"), text.attribute_name(c).alias("n"), text.format_descriptor(c).alias("f"), text.qgrams(c).alias("q"), text.is_text_value(c).alias("t"), text.shingle_list(c).alias("s")).collect()}
    assert got["Ab-12 (x) é"].a == "ab12x" and got["Ab-12 (x) é"].n == "ab-12é"
    assert got["12.50"].f == "d" and got["ann@x.org"].f == "lqlpl" and got["Ab-12 (x) é"].f == "ciwplpw"
    assert got["abc"].q == ["abc"] and got["abcd"].q == ["abc", "bcd"] and got[""].q == [""]
    assert not got["12.50"].t and got["abc"].t
    assert got["Ab-12 (x) é"].s[0] == "ab-12"


#: Parts and classes of the descriptor, as the tests' own expressions.
PARTS = [("a", r"(?:[0-9]+[a-zA-Z]|[a-zA-Z]+[0-9])[a-zA-Z0-9]*"), ("d", r"\+?[0-9]+(?:,[0-9]+)*\.[0-9]+"), ("e", r"-[0-9]+(?:,[0-9]+)*\.[0-9]+"), ("i", r"\+?[0-9]+(?:,[0-9]+)*"), ("j", r"-[0-9]+(?:,[0-9]+)*"), ("q", r"(?=.*[0-9,.])(?=.*[@$€£])[0-9@$€£]+"), ("c", r"[A-Z][a-z][a-z-]*"), ("u", r"[A-Z][A-Z.-]*"), ("l", r"[a-z][a-z-]*"), ("p", r"""[!"#%&'()*+,\-./:;<=>?\[\\\]^_`{|}~]+"""), ("s", r"[@$€£]+"), ("w", r"\s+")]


def plain_descriptor(v):
    """Class by class at each place, until none fits."""
    v, out = v.replace("\n", " ").strip(), ""
    while v:
        k, m = next(((k, m) for k, p in PARTS if (m := re.match(p, v))), (None, None))
        if m is None:
            break
        out, v = out + k, v[m.end() :]
    return out


def test_format_descriptors_against_plain_version(spark):
    r = random.Random(2)
    rows = ["$100", "$ 5", "$", "5$", "a@b.c", "+1,234.5", "-7", "-7.25", "1,2,3", "12ab", "ab12-x", "McDonald", "A.B.C", "x-1", "é x", "x é", " \n a\tB ", "€5,-", "@", "@.", "[a]", "\ue000q", "a" * 3_000 + "$" * 50, "-", "+", "a\u00a0b"]
    rows += ["".join(r.choice("aB1-+,.$€@ (\n_é") for _ in range(r.randint(0, 12))) for _ in range(600)]
    df = spark.createDataFrame([(v,) for v in rows], "v string")
    got = [(x.v, x.f) for x in df.select("v", text.format_descriptor(F.col("v")).alias("f")).collect()]
    assert [(v, f) for v, f in got if f != plain_descriptor(v)] == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 40), st.integers(1, 40)), min_size=1, max_size=8))
def test_hypergeometric_of_many_rows(rows):
    t, a, b = (np.array(x) for x in zip(*rows, strict=True))
    t = np.minimum(t, np.minimum(a, b))
    assert np.allclose(stats.hypergeometric_cdfs(t, a + b, a, b), [stats.hypergeometric_cdf(*map(int, x)) for x in zip(t, a + b, a, b, strict=True)], atol=1e-12)


def test_minhash_estimates_jaccard(spark):
    from tablequarry.operators import sketches

    r = random.Random(1)
    common = [str(r.random()) for _ in range(300)]
    a, b = common + [str(r.random()) for _ in range(100)], common + [str(r.random()) for _ in range(100)]
    df = spark.createDataFrame([("a", "x", v) for v in a] + [("b", "x", v) for v in b], "table_name string, column_name string, value string")
    sig = sketches.signatures(df, 128)
    pairs = spark.createDataFrame([("a", "x", "b", "x")], "q_table string, q_column string, c_table string, c_column string")
    assert abs(sketches.estimated_jaccard(sig, pairs, 128).first().score - 0.6) < 0.15
    # Sketches of parts merge to the sketch of the whole.
    parts = sketches.signatures(df.where("value < '0.5'"), 128).union(sketches.signatures(df.where("value >= '0.5'"), 128))
    key = lambda d: sorted((x.table_name, list(x.signature)) for x in d.collect())
    assert key(sketches.merge(parts, 128)) == key(sig)
    assert len(set(hashing.permutations(64))) == 64
