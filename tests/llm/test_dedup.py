"""Exact, line and near-duplicate operators against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablequarry.llm import embed_dedup, exact_dedup, jaccard, line_dedup
from tablequarry.llm.common import components, numbered

SCHEMA = "doc_id long, text string, n string, kept string"


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(parts)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


EXACT = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (6, "a "), (7, "long " * 40_000), (8, "long " * 40_000), (9, "b"), (9, "b")]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep):
    found = exact_dedup.exact_groups(documents(spark, EXACT), keep=keep)
    expected = []
    for i, t in EXACT:
        same = [j for j, u in EXACT if (u or "") == (t or "")]
        k = (min if keep == "min" else max)(same)
        expected.append((i, k, len(same), i == k, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(expected)


def test_exact_groups_verifies_bytes(spark):
    """With a digest that collides, the bytes decide."""
    rows = [(i, f"text {i % 7}") for i in range(60)]
    found = exact_dedup.exact_groups(documents(spark, rows), keep="max", digest=F.length("text").cast("string"))
    assert got(found, "doc_id", "keep_id", "group_size") == sorted((i, max(j for j in range(60) if j % 7 == i % 7), sum(j % 7 == i % 7 for j in range(60))) for i in range(60))


def test_exact_groups_null_ids_and_empty(spark):
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0
    found = exact_dedup.exact_groups(documents(spark, [(None, "a"), (2, "a"), (None, "c"), (None, "c")]))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()), key=str) == sorted([(None, 2, 2, False), (2, 2, 2, True), (None, None, 2, True), (None, None, 2, True)], key=str)


def test_index_over_several_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}", keep="min")
    for batch in ([("a", 5), ("b", 2)], [("a", 3), ("c", 9)], [("b", 7)]):
        index.flush(spark.createDataFrame(batch, "digest string, id long"))
    asked = spark.createDataFrame([("a",), ("c",), ("z",), ("c",)], "digest string")
    assert got(index.lookup(asked), "digest", "id", "rows") == [("a", 3, 2), ("c", 9, 1)]
    assert got(index.compact(), "digest", "id", "rows") == [("a", 3, 2), ("b", 2, 2), ("c", 9, 1)]
    assert got(index.lookup(asked), "digest", "id", "rows") == [("a", 3, 2), ("c", 9, 1)]
    assert sum(map(len, index.levels)) == 1


def test_index_merges_levels_and_bounds_memtables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 10)
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}", keep="max")
    r, expected = random.Random(4), {}
    for k in range(5):
        batch = [(f"d{r.randrange(40)}", 100 * k + j) for j in range(35)]
        for d, i in batch:
            best, n = expected.get(d, (i, 0))
            expected[d] = max(best, i), n + 1
        index.flush(spark.createDataFrame(batch, "digest string, id long").coalesce(1))
    # Five batches, two of which make a level: 1 + 4.
    assert [len(level) for level in index.levels] == [1, 0, 1]
    runs = [spark.read.parquet(str(f)).collect() for f in (tmp_path / index.levels[0][0].rsplit("/", 1)[-1]).glob("*.parquet")]
    assert len(runs) == 4 and all(len(x) <= 10 and [y.digest for y in x] == sorted(y.digest for y in x) for x in runs)
    assert got(index.compact(), "digest", "id", "rows") == sorted((d, i, n) for d, (i, n) in expected.items())
    # Nothing but the one run is left.
    assert [p.name for p in tmp_path.iterdir()] == [index.levels[-1][0].rsplit("/", 1)[-1]]


def brute_lines(rows, least):
    """(id, lines, deleted, text): whole comparison of every two places that begin a common run.

    Places whose lines before differ are extended line by line; the later one loses a run of `least` words.
    """
    word = re.compile(line_dedup.WORD)
    full = {i: [(p, x, len(word.findall(x))) for p, x in enumerate(t.split("\n")) if word.search(x)] for i, t in rows if t is not None}
    at, gone = {}, {i: set() for i in full}
    for i in sorted(full):
        for k, (_, x, _) in enumerate(full[i]):
            at.setdefault(x, []).append((i, k))
    for places in at.values():
        for b, (j, q) in enumerate(places):
            for i, p in places[:b]:
                if p and q and full[i][p - 1][1] == full[j][q - 1][1]:
                    continue
                n = 0
                while p + n < len(full[i]) and q + n < len(full[j]) and full[i][p + n][1] == full[j][q + n][1]:
                    n += 1
                if sum(w for *_, w in full[j][q : q + n]) >= least:
                    gone[j].update(range(full[j][q][0], full[j][q + n - 1][0] + 1))
    return sorted(((i, 0 if t is None else len(t.split("\n")), len(gone.get(i, ())), "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) if gone.get(i) else t) for i, t in rows), key=str)


def test_lines_against_brute_force(spark):
    r = random.Random(3)
    pool = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(0, 7))) for _ in range(25)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14)))) for i in range(40)]
    rows += [(50, rows[3][1]), (51, None), (52, ""), (53, "\n \n"), (54, "\n".join(["one two three four"] * 9)), (55, "w " * 30_000), (56, "x\n" + "w " * 30_000)]
    # Runs of 12 and 4 words, repeated in the middle and at the end of a document, go whole.
    rows += [(60, "p " * 12 + "\n" + "q " * 4), (61, "r\n" + "p " * 12 + "\n" + "q " * 4 + "\ns " + "t " * 20), (62, "p " * 12 + "\n\n" + "q " * 4)]
    rows += [(70 + k, "\n".join([f"own {k}", *rows[n][1].split("\n")[1:6], f"end {k}"])) for k, n in enumerate((3, 9, 9, 20))]
    found = line_dedup.dedup_lines(documents(spark, rows), min_words=9)
    assert found.columns == ["doc_id", "text", "n", "kept", "n_lines", "n_deleted"]
    expected = brute_lines(rows, 9)
    assert sorted(((x.doc_id, x.n_lines, x.n_deleted, x.text) for x in found.collect()), key=str) == expected
    assert {i: n for i, _, n, _ in expected if 60 <= i < 70} == {60: 0, 61: 2, 62: 3}


def test_lines_edge_cases(spark):
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0
    same = "one two three\nfour five six"
    twice = got(line_dedup.dedup_lines(documents(spark, [(1, same), (1, same), (2, same)]), min_words=4), "doc_id", "n_deleted", "text")
    assert twice == [(1, 0, same), (1, 0, same), (2, 2, "")]
    # A null id comes first.
    assert sorted(x.n_deleted for x in line_dedup.dedup_lines(documents(spark, [(None, same), (1, same)]), min_words=4).collect()) == [0, 2]
    clash = spark.createDataFrame([(1, same, 7, 8, 9), (2, same, 7, 8, 9)], "doc_id long, text string, _gone int, n_lines int, th int")
    assert got(line_dedup.dedup_lines(clash, min_words=4), "doc_id", "_gone", "th", "n_lines", "n_deleted") == [(1, 7, 9, 2, 0), (2, 7, 9, 2, 2)]


def brute_jaccard(rows, width=5):
    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    s = {i: sets(t) for i, t in rows}
    up = {i: i for i in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s[i]), find(i)) for i in s)


def near_copies(seed, groups=8, size=9):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows, line = [], [word() for _ in range(30)]
    for g in range(groups):
        base = [word() for _ in range(r.choice((12, 60, 200, 500)))] + (line if g % 2 else [])
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 35))):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "Two words"), (504, "two WORDS"), (505, "a b c d e"), (506, "a b c d e f"), (507, "z " * 20_000), (508, "z " * 20_000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, seed):
    rows = near_copies(seed)
    assert got(jaccard.jaccard_components(documents(spark, rows)), "doc_id", "n_shingles", "component_id") == brute_jaccard(rows)


def test_jaccard_in_tiles(spark, monkeypatch):
    """Regions that one task may not hold are joined in tiles, with the same result."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", 4)
    rows = near_copies(5, groups=2, size=30)
    assert got(jaccard.jaccard_components(documents(spark, rows)), "doc_id", "n_shingles", "component_id") == brute_jaccard(rows)


def test_jaccard_edge_cases(spark):
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "other words of its own here"), (4, "A b c d e f")]
    found = jaccard.jaccard_components(documents(spark, rows))
    assert sorted(((x.doc_id, x.component_id) for x in found.collect()), key=str) == sorted([(3, 3), (3, 3), (None, 3), (None, None), (4, 3)], key=str)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 40), st.sampled_from([60, 80, 95]))
def test_region_join_finds_all_links(seed, n, threshold):
    r = random.Random(seed)
    base = r.sample(range(1000), 30)
    sets_ = [np.array(sorted(set(r.sample(base, r.randint(20, 30)) + r.sample(range(1000), r.randint(0, 3)))), dtype=np.int64) for _ in range(n)]
    old, jaccard.BLOCK = jaccard.BLOCK, 6
    try:
        links = jaccard._join_region(sets_, lambda a, b: np.ones((len(a), len(b)), dtype=bool), threshold)
    finally:
        jaccard.BLOCK = old
    union = jaccard._Union(n)
    for a, b in links:
        union.link(a, b)
    brute = jaccard._Union(n)
    for a in range(n):
        for b in range(a):
            s = len(np.intersect1d(sets_[a], sets_[b]))
            if 100 * s >= threshold * (len(sets_[a]) + len(sets_[b]) - s):
                brute.link(a, b)
    assert [union.find(k) for k in range(n)] == [brute.find(k) for k in range(n)]


@given(st.integers(1, 5000), st.sampled_from([50, 80, 90, 100]))
def test_windows_are_consistent(n, threshold):
    window, probes = jaccard.window_sizes(n, threshold)
    assert 1 <= probes <= window <= n
    # Slack never falls with the size, which the pair argument needs.
    assert window - n + jaccard._least(n, threshold) <= jaccard.window_sizes(n + 1, threshold)[0] - n - 1 + jaccard._least(n + 1, threshold)


def brute_links(rows, cosine):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, dtype=np.float32).astype(float))
    items = [(i, v / np.linalg.norm(v)) for i, vs in good.items() for v in vs]
    n = [sum(k != j and len(u) == len(v) and float(u @ v) >= cosine for j, (_, v) in enumerate(items)) for k, (_, u) in enumerate(items)]
    union = jaccard._Union(len(items))
    for k, (_, u) in enumerate(items):
        for j, (_, v) in enumerate(items[:k]):
            if len(u) == len(v) and float(u @ v) >= cosine:
                union.link(k, j)
    low = {}
    for k, (i, _) in enumerate(items):
        low[union.find(k)] = min(i, low.get(union.find(k), i))
    out = [(i, n[k], low[union.find(k)]) for k, (i, _) in enumerate(items)]
    return sorted(out + [(i, 0, i) for i, _ in rows if i not in good])


@pytest.mark.parametrize("tile", [8_192, 5])
def test_embeddings_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE_ROWS", tile)
    r = np.random.default_rng(4)
    rows = []
    for _ in range(12):
        base = r.standard_normal(16)
        rows += [(len(rows) + k, (base + r.standard_normal(16) * r.choice([0.05, 0.3, 0.5])).tolist()) for k in range(6)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, [x * 3 for x in rows[0][1]]), (103, None), (104, []), (105, [0.0] * 16), (106, [float("nan")] + [1.0] * 15), (107, [None] + [1.0] * 15), (108, [1.0, 2.0]), (109, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n_links int").repartition(3)
    assert got(embed_dedup.near_duplicates(df), "vec_id", "n_links", "component_id") == brute_links(rows, 0.9)


def test_embeddings_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.near_duplicates(df).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(25)] + [(200, 200 + k) for k in range(1, 20)]
    union = jaccard._Union(300)
    for a, b in edges:
        union.link(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got(components(spark.createDataFrame(edges, "u long, v long")), "node", "component") == sorted((x, union.find(x)) for x in nodes)


def test_numbering(spark, monkeypatch):
    from tablequarry.llm import common

    monkeypatch.setattr(common, "BUCKET_ROWS", 7)
    df = spark.range(200).select("id", (F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"), (F.col("id") % 5).alias("t"))
    rows = numbered(df, ["g"], ["h", "id"], 67, "k", {"before": "t"}).collect()
    for g in range(3):
        own = sorted((x for x in rows if x.g == g), key=lambda x: x.k)
        assert [x.k for x in own] == list(range(len(own))) and [x.h for x in own] == sorted(x.h for x in own)
        assert [x.before for x in own] == [sum(y.t for y in own[:j]) for j in range(len(own))]


def test_no_folder_of_its_own_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tablequarry.llm import common

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)
