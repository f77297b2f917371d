"""Operators on small lakes, and every query against its SQL on the smallest tables."""

import json
from pathlib import Path

import duckdb
import pytest

from tablequarry.operators import evaluation, graph, sets, similarity, tables, vectors
from tablequarry.plans import queries
from tablequarry.sources import lake

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(ROOT).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows, columns):
    fix = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([[fix(r[k]) for k in order] for r in rows], key=str)


#: Quick ones; the slow ones share their parts.
CHECKED = ["column_profile", "posting_lists", "token_order", "overlap_topk", "overlap_prefix_filter", "jaccard_topk", "attr_value_match", "lsh_candidates", "lsh_collision_topk", "lsh_ensemble_topk", "format_sim", "token_value_sim", "column_sentence", "histogram_density", "vector_knn", "pivot_filtered_eps_join", "simhash_neardup", "c_alignment_greedy", "schema_complement_topk", "hypergeom_unionability", "synth_column_semantics", "class_closure", "type_scores", "kb_column_types", "santos_kb_topk", "santos_synth_topk", "infogather_join_topk", "fd_pairs", "precision_recall_at_k", "map_at_k", "keyword_search", "covered_pairs", "subset_columns", "token_sets", "score_then_size", "results_without_known", "csv_cells", "n_triples", "web_tables", "ranked_files", "lake_parts", "entity_matches", "column_classes", "semantic_unionability", "column_semantics", "santos_intent_topk", "santos_relation_topk", "embedding_evidence"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, ROOT)
    theirs = sql.execute(queries.SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(theirs.fetchall(), columns)


def values(spark, columns):
    rows = [(t, c, v, 1) for (t, c), vs in columns.items() for v in vs]
    return spark.createDataFrame(rows, "table_name string, column_name string, value string, freq long")


def test_prefix_filter_equals_full_count(spark):
    import random

    r = random.Random(6)
    v = values(spark, {(f"t{k}", "c"): r.sample([str(x) for x in range(40)], r.randint(1, 25)) for k in range(12)})
    for t in (0.3, 0.8, 1.0):
        full = {(x.q_table, x.c_table, x.overlap) for x in sets.overlaps(v).collect() if x.overlap >= t * x.q_size - 1e-9}
        assert {(x.q_table, x.c_table, x.overlap) for x in sets.containment_pairs(v, t).collect()} == full


@pytest.mark.parametrize("block", [1_024, 3])
def test_overlaps_in_blocks_and_with_a_bound(spark, monkeypatch, block):
    """Values that many columns hold, in blocks of columns; the k-th bound changes nothing."""
    import random

    monkeypatch.setattr(sets, "BLOCK", block)
    r = random.Random(7)
    columns = {(f"t{k}", c): {"all", *r.sample([str(x) for x in range(60)], r.randint(1, 40))} for k in range(9) for c in "xy"}
    v = values(spark, columns).repartition(3)
    expected = {(*q, *c): len(columns[q] & columns[c]) for q in columns for c in columns if q != c}
    assert {(x.q_table, x.q_column, x.c_table, x.c_column): x.overlap for x in sets.overlaps(v).collect()} == expected
    asked = spark.createDataFrame([("t3", "x")], "table_name string, column_name string")
    assert sets.overlaps(v, asked).count() == 17
    for k in (4, 30):
        best = lambda q: sorted(((-n, p[2:]) for p, n in expected.items() if p[:2] == q))[:k]  # noqa: E731, B023
        assert {tuple(x) for x in sets.top_overlaps(v, k, sample=3).collect()} == {(*q, *c, float(-n), i + 1) for q in columns for i, (n, c) in enumerate(best(q))}
    order = [x.value for x in sets.token_order(v).orderBy("token_id").collect()]
    held = {x: sum(x in s for s in columns.values()) for x in order}
    assert len(order) == 61 and [held[x] for x in order] == sorted(held.values()) and order[-1] == "all"


def test_lsh_recall(spark):
    """The sketches' searches against the exact ones, on sets of very unequal sizes."""
    import random

    from tablequarry.operators import sketches

    r, columns = random.Random(3), {}
    for g in range(12):
        base = [f"{g}-{x}" for x in range(r.choice((8, 60, 400, 1500)))]
        for k in range(6):
            own = r.sample(base, max(1, int(len(base) * r.choice((0.05, 0.5, 0.85, 0.95)))))
            columns[f"t{g}", f"c{k}"] = own + [f"{g}-{k}-{x}" for x in range(r.randint(0, len(own) // 3))]
    v = values(spark, columns)
    s = {k: set(x) for k, x in columns.items()}
    inside = {(*q, *c) for q in s for c in s if q != c and len(s[q] & s[c]) >= 0.8 * len(s[q])}
    found = {(x.q_table, x.q_column, x.c_table, x.c_column) for x in sketches.ensemble_search(v, threshold=0.8, k=100).collect()}
    assert found <= inside and len(found) >= 0.95 * len(inside) > 50
    alike = {(*q, *c) for q in s for c in s if q != c and len(s[q] & s[c]) >= 0.5 * len(s[q] | s[c])}
    found = {(x.q_table, x.q_column, x.c_table, x.c_column) for x in sketches.lsh_search(v, 0.5).collect()}
    assert found <= alike and len(found) >= 0.95 * len(alike) > 30
    # Sizes whose ratio sketches cannot bridge go by values.
    plan = sketches.ensemble_plan(0.8, 256, 4)
    assert plan[0] and plan[6] and plan[7] is None


def test_lsh_recall_on_the_tables(spark, sql):
    """lsh_ensemble_topk equals the exact search (its SQL); lsh_candidates misses none either."""
    exact = {tuple(r) for r in sql.execute(f"WITH {queries.values_sql()}, {queries.OVERLAPS_SQL} SELECT q_table, q_column, c_table, c_column FROM p WHERE {queries.JACCARD_SQL} >= 0.5").fetchall()}
    found = {tuple(r)[:4] for r in queries.lsh_candidates(spark, ROOT).select("q_table", "q_column", "c_table", "c_column").collect()}
    assert found <= exact and len(found) >= 0.95 * len(exact)


def test_set_predicates(spark):
    v = values(spark, {("a", "x"): "ab", ("b", "x"): "abc", ("c", "x"): "bz"})
    pairs = spark.createDataFrame([("a", "x", "b", "x"), ("b", "x", "a", "x"), ("a", "x", "c", "x")], "q_table string, q_column string, c_table string, c_column string")
    assert [tuple(r) for r in sets.is_subset(v, pairs).collect()] == [("a", "x", "b", "x")]
    cells = spark.createDataFrame([("t", "n", "1"), ("t", "n", "-2.5e3"), ("t", "n", None), ("t", "s", "1"), ("t", "s", "1a"), ("t", "e", None)], "table_name string, column_name string, value string")
    assert [tuple(r) for r in sets.numeric_columns(cells).collect()] == [("t", "n")]
    assert sorted(tuple(r) for r in sets.candidate_union(pairs, pairs).collect()) == [("a", "b"), ("a", "c"), ("b", "a")]
    assert [tuple(r) for r in sets.candidate_intersection(pairs.where("q_table = 'a'"), pairs.where("c_table = 'b'")).collect()] == [("b", "x")]
    twice = pairs.union(pairs.limit(1))
    assert sets.without(twice, pairs).count() == 1
    order = sets.token_order(v)
    ids = {r.value: r.token_id for r in order.collect()}
    assert {r.table_name: list(r.tokens) for r in sets.token_sets(v, order).collect()}["b"] == sorted(ids[x] for x in "abc")


def test_sampling_and_indexes(spark, tmp_path):
    v = values(spark, {(f"t{k}", "c"): "abc" for k in range(20)})
    assert lake.sampled_count(v, 7).select("table_name").distinct().count() == 7
    parts = {(r.table_name, r.part) for r in lake.partitioned(v, 4).collect()}
    assert len(parts) == 20 and {p for _, p in parts} <= set(range(4))
    lake.save_index(sets.posting_lists(v), f"file://{tmp_path}/index", files=2)
    assert {(r.value, r.frequency) for r in lake.load_index(spark, f"file://{tmp_path}/index").collect()} == {(x, 20) for x in "abc"}
    ranked = sets.top_columns(v, "overlap", 5)
    lake.save_ranked(ranked, f"file://{tmp_path}/r", [2, 5], fmt="parquet")
    assert {r.k: r["count"] for r in spark.read.parquet(f"file://{tmp_path}/r").groupBy("k").count().collect()} == {2: 40, 5: 100}


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).selectExpr("id", "id % 7 as g").write.jdbc(url, "NUMBERS")
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    assert lake.jdbc_tables(spark, url, listing="SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'", **options) == ["NUMBERS"]
    assert {tuple(r) for r in lake.jdbc_counts(spark, url, "NUMBERS", ["id", "g"], **options).collect()} == {("NUMBERS", "id", 100, 100), ("NUMBERS", "g", 100, 7)}
    found = lake.jdbc_lake(spark, url, ["NUMBERS"], split={"NUMBERS": ("id", 0, 100)}, parts=4, **options)
    assert found.tables["NUMBERS"].rdd.getNumPartitions() == 4 and found.column_values().count() == 107


def test_kept_tables_follow_their_files(spark, tmp_path):
    from tablequarry.sources.store import kept

    path, made = f"file://{tmp_path}/n", []
    table = lambda: kept(spark, "n", [path], lambda: made.append(1) or spark.read.parquet(path))
    spark.range(3).write.parquet(path)
    assert table().count() == table().count() == 3 and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert table().count() == 5 and len(made) == 2


def test_names_with_dots_and_bars(spark):
    """Names that hold separators of other systems do not mix tables up."""
    rows = spark.createDataFrame([("a.b", "c|d", "e", "f.g", 0.9), ("a", "b.c|d", "e.f", "g", 0.7)], "q_table string, q_column string, c_table string, c_column string, score double")
    widths = spark.createDataFrame([(t, c, 3.0) for r in rows.collect() for t, c in ((r[0], r[1]), (r[2], r[3]))], "table_name string, column_name string, width double")
    found = graph.column_graph(rows, rows, widths, 0.1)
    assert {r.src for r in found.collect()} == {f"a.b{graph.OF}c|d", f"a{graph.OF}b.c|d"}
    x = spark.createDataFrame([(1, "p"), (2, "q")], "`m|n` int, o string")
    assert {r.column_name for r in tables.pair_values({"t": x}, [("t", "m|n", "o")]).collect()} == {f"m|n{tables.AND}o"}


def test_searches_without_sql_against_plain_versions(spark, sql):
    """The optimal matchings of tables, from the pair scores of the SQL."""
    import numpy as np

    from tablequarry.functions.stats import assignment

    def matched(pairs, normalised=False):
        by = {}
        for qt, qc, ct, cc, s in pairs:
            by.setdefault((qt, ct), []).append((qc, cc, s))
        out = {}
        for key, own in by.items():
            q, c = sorted({x[0] for x in own}), sorted({x[1] for x in own})
            w = np.zeros((len(q), len(c)))
            for a, b, s in own:
                w[q.index(a), c.index(b)] = s
            m = assignment(w)
            total = sum(w[p] for p in m)
            out[key] = round(total / (len(q) + len(c) - len(m)) if normalised else total, 6)
        return out

    def top(scores, k):
        for q in {q for q, _ in scores}:
            for i, (s, c) in enumerate(sorted((-s, c) for (x, c), s in scores.items() if x == q)[:k]):
                yield q, c, pytest.approx(-s, abs=2e-6), i + 1

    by_name = lambda rows: sorted((r.q_table, r.c_table, r.score, r["rank"]) for r in rows)
    pairs = sql.execute(f"WITH {queries.values_sql()}, {queries.OVERLAPS_SQL} SELECT q_table, q_column, c_table, c_column, round(overlap / least(q_size, c_size), 6) FROM p WHERE q_table <> c_table").fetchall()
    assert by_name(queries.bipartite_match_topk(spark, ROOT).collect()) == sorted(top(matched(pairs), 10), key=lambda x: (x[0], x[1]))
    names = sql.execute(f"SELECT q_table, q_column, c_table, c_column, score FROM ({queries.SQL['qgram_name_sim']})").fetchall()
    schema = matched(names, True)
    entity = {(q, c): s for q, c, s in sql.execute(f"SELECT q_table, c_table, score FROM ({queries.SQL['entity_complement_labels']})").fetchall()}
    # Products of two rounded scores may round either way at the last place, so ranks are held by their scores.
    both = {k: entity[k] * schema[k] for k in entity if k in schema}
    found = queries.entity_complement_topk(spark, ROOT).collect()
    assert all(r.score == pytest.approx(both[r.q_table, r.c_table], abs=2e-6) for r in found)
    for q in {q for q, _ in both}:
        best = sorted((s for (x, _), s in both.items() if x == q), reverse=True)[:5]
        assert [r.score for r in sorted((r for r in found if r.q_table == q), key=lambda r: r["rank"])] == pytest.approx(best, abs=2e-6)


def test_top_k_are_nested(spark):
    v = values(spark, {("a", "x"): "abcd", ("b", "x"): "abc", ("c", "x"): "ab", ("d.e#f", "x"): "a"})
    five, ten = ({tuple(r) for r in sets.top_columns(v, "overlap", k).collect()} for k in (2, 10))
    assert five < ten and ("a", "x", "b", "x", 3.0, 1) in five


def test_lakes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,ann\n2,\n", encoding="latin1")
    (tmp_path / "groundtruth.csv").write_text("q,c\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.csv").write_text('id,note\n7,"x\ny, z"\n8\n')
    (tmp_path / "groundtruth_sales.csv").write_text("k\n1\n")
    paths = lake.csv_paths(spark, f"file://{tmp_path}")
    # Files of one name stay apart, and only a whole name is skipped.
    assert list(paths) == ["a", "groundtruth_sales", "sub/a"]
    cells = sorted(((r.table_name, r.column_name, r.value) for r in lake.csv_cells(spark, f"file://{tmp_path}", encoding="ISO-8859-1").collect()), key=str)
    assert cells == sorted([("a", "id", "1"), ("a", "name", "ann"), ("a", "id", "2"), ("a", "name", None), ("sub/a", "id", "7"), ("sub/a", "note", "x\ny, z"), ("groundtruth_sales", "k", "1")], key=str)
    assert [r.id for r in lake.csv_lake(spark, {"a": paths["a"]}, head=1).tables["a"].collect()] == ["1"]
    paths = {"a": paths["a"]}
    found = lake.csv_lake(spark, paths, encoding="ISO-8859-1")
    assert {tuple(r) for r in found.counts().collect()} == {("a", "id", 2, 2), ("a", "name", 1, 1)}
    (tmp_path / "kb.nt").write_text('<http://x/Anna>\t<http://x#knows>\t<http://x/Bo> .\n')
    assert [tuple(r) for r in lake.triples(spark, f"file://{tmp_path}/kb.nt").collect()] == [("anna", "knows", "bo")]
    (tmp_path / "w.json").write_text(json.dumps({"title": "t", "relation": [["h", "1", "2"], ["g", "x", "y"]]}) + "\n")
    assert [(r.row_id, r.cells) for r in lake.json_tables(spark, f"file://{tmp_path}/w.json").collect()] == [(0, ["h", "g"]), (1, ["1", "x"]), (2, ["2", "y"])]


def test_histograms_leave_infinities_out(spark):
    x = spark.createDataFrame([("t", "c", float(v)) for v in (1, 2, 3, float("inf"), float("nan"))] + [("t", "d", 5.0), ("t", "e", None)], "table_name string, column_name string, x double")
    got = {(r.column_name, r.bin): r.density for r in similarity.histograms(x, 2).collect()}
    assert got == {("c", 0): round(1 / 3, 6), ("c", 1): round(2 / 3, 6), ("d", 0): 1.0}


def test_pagerank_sums_to_one_and_matches_power_iteration(spark):
    edges = [("0", "1"), ("1", "2"), ("1", "3"), ("2", "4")]
    df = spark.createDataFrame([(a, b, 0.5) for a, b in edges] + [(b, a, 0.5) for a, b in edges], "src string, dst string, weight double")
    got = {r.node: r.score for r in graph.pagerank(df, spark.createDataFrame([("0",)], "source string"), iterations=9).collect()}
    p, out = {"0": 1.0}, {str(k): [b if a == str(k) else a for a, b in edges if str(k) in (a, b)] for k in range(5)}
    for _ in range(9):
        q = {"0": 0.3}
        for u, m in p.items():
            for v in out[u]:
                q[v] = q.get(v, 0) + 0.7 * m / len(out[u])
        p = q
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got[k] - p[k]) < 1e-9 for k in p)


def test_matching_and_alignment(spark):
    w = [("q", "A1", "t", "R1", 0.3), ("q", "A1", "t", "R3", 0.2), ("q", "A2", "t", "R2", 0.2), ("q", "A3", "t", "R3", 0.4), ("q", "A1", "u", "R1", 0.9)]
    df = spark.createDataFrame(w, "q_table string, q_column string, c_table string, c_column string, score double")
    assert {(r.c_table, r.score, r.n_pairs) for r in vectors.best_matching(df).collect()} == {("t", 0.9, 3), ("u", 0.9, 1)}
    assert {(r.c_table, r.c): r.score for r in tables.alignments(df).collect()} == {("t", 1): 0.4, ("t", 2): 0.12, ("t", 3): 0.024, ("u", 1): 0.9}
    assert tables.c_alignment(df, 5).count() == 2


def test_alignments_keep_pairs_of_weight_0(spark, sql):
    """Scores that round to 0 are pairs still, as in SQL; products round as there."""
    w = [("q", "A1", "t", "R1", 0.5), ("q", "A2", "t", "R2", 0.0), ("q", "A1", "t", "R2", 0.0), ("q", "A3", "u", "R1", 0.0), ("q", "A1", "v", "R1", 0.000005), ("q", "A2", "v", "R2", 0.0003)]
    df = spark.createDataFrame(w, "q_table string, q_column string, c_table string, c_column string, score double")
    found = {(r.c_table, r.c): r.score for r in tables.alignments(df).collect()}
    assert found == {("t", 1): 0.5, ("t", 2): 0.0, ("u", 1): 0.0, ("v", 1): 0.0003, ("v", 2): sql.execute("SELECT round(0.0003::DOUBLE * 0.000005::DOUBLE, 9)").fetchone()[0]}


def test_embedding_tables_weigh_all_column_pairs(spark):
    """Neighbours name candidate tables only: with one each, the matching still sees every pair."""
    import numpy as np

    from tablequarry.functions.stats import assignment

    r = np.random.default_rng(4)
    base = r.standard_normal((4, 8))
    v = {10 * t + c: base[c] + r.standard_normal(8) * 0.4 for t in range(6) for c in range(4)}
    e = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "vec_id long, embedding array<double>")
    items = spark.createDataFrame([(i, f"t{i // 10}", str(i % 10)) for i in v], "id long, table_name string, column_name string")
    cos = lambda a, b: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    near = {(a // 10, max((b for b in v if b != a), key=lambda b: cos(v[a], v[b])) // 10) for a in v}
    expected = {}
    for q, c in near:
        if q != c:
            w = np.array([[s if (s := cos(v[10 * q + i], v[10 * c + j])) > 0.3 else 0 for j in range(4)] for i in range(4)])
            expected[f"t{q}", f"t{c}"] = sum(w[p] for p in assignment(w)), len(assignment(w))
    found = vectors.embedding_table_search(items, vectors.knn(e, e, 1), e, 0.3, 60).collect()
    assert {(x.q_table, x.c_table): (x.score, x.n_pairs) for x in found} == {k: (pytest.approx(s, abs=1e-5), n) for k, (s, n) in expected.items()}
    assert max(n for _, n in expected.values()) == 4


def test_language_unionability_reads_whole_vectors(spark, tmp_path, monkeypatch):
    """Labels that agree in the first 8 components and differ in the others are not unionable."""
    import numpy as np

    from tablequarry.functions.stats import hotelling_score

    r = np.random.default_rng(5)
    x = {g: r.standard_normal((90, 64)) for g in range(3)}
    x[1][:, 8:] += 2
    rows = [(100 * g + i, v.tolist(), g) for g, vs in x.items() for i, v in enumerate(vs)] + [(999, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(tables, "MOMENT_GROUPS", 2)
    found = {(q, c): s for q, c, s in queries.nl_unionability(spark, str(tmp_path)).collect()}
    assert found == {(q, c): pytest.approx(hotelling_score(x[q], x[c]), abs=2e-6) for q in x for c in x if q != c}
    assert found[0, 1] < 1e-6 < 0.01 < found[0, 2]


def test_measures_and_their_empty_sets(spark):
    results = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", "z", 1)], "query string, candidate string, rank int")
    truth = spark.createDataFrame([("a", "x"), ("a", "w"), ("c", "v")], "query string, candidate string")
    got = {(r.query, r.k): (r.precision, r.recall) for r in evaluation.at_cutoffs(results, truth, [1, 2]).collect()}
    assert got["a", 1] == (1.0, 0.5) and got["a", 2] == (0.5, 0.5) and got["b", 1] == (0.0, 1.0) and got["c", 1] == (0.0, 0.0)
    assert {r.query: r.ap for r in evaluation.average_precision(results, truth).collect()} == {"a": 0.5, "c": 0.0}


def test_closure_stops_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "class string, parent string")
    assert {(r["class"], r.ancestor, r.level) for r in graph.class_closure(edges).collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "c", 2), ("b", "a", 2), ("c", "b", 2)}


def test_stream_keeps_signatures(spark, tmp_path):
    from tablequarry.operators.sketches import signatures
    from tablequarry.streaming import sketches

    rows = spark.createDataFrame([("t", "c", str(k)) for k in range(50)], "table_name string, column_name string, value string")
    source = f"file://{tmp_path}/in"
    for k in range(2):
        rows.where(f"cast(value as int) % 2 = {k}").write.mode("append").parquet(source)
        sketches.maintain(spark.readStream.schema(rows.schema).parquet(source), f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    assert list(sketches.current(spark.read.parquet, f"file://{tmp_path}/out").first().signature) == list(signatures(rows).first().signature)


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top / "tablequarry", tmp_path / "tablequarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    if (top / "corpus_pipeline.py").exists():
        shutil.copy(top / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'overlap_topk' in q and not any(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_entities_hold_every_word_of_a_value(spark):
    import math
    import random

    r = random.Random(3)
    words = ["red", "blue", "ring", "bolt", "gear", "big"]
    labels = [(" ".join(r.choices(words, k=r.randint(1, 4))), f"e{k:02d}") for k in range(40)] + [("", "none")]
    asked = sorted({" ".join(r.choices([*words, "odd"], k=r.randint(1, 3))) for _ in range(40)} | {"", "--", "Red"})
    v = spark.createDataFrame([("t", "c", x, 1) for x in asked], "table_name string, column_name string, value string, freq long")
    got = {}
    for x in graph.entity_matches(v, spark.createDataFrame(labels, "label string, entity string"), 3).collect():
        got.setdefault(x.value, []).append((x.rank, x.entity, x.score))
    docs = [(e, t.split()) for t, e in labels if t]
    mean = sum(len(t) for _, t in docs) / len(docs)
    want = {}
    for x in asked:
        ws = set("".join(c if c.isalnum() else " " for c in x.lower()).split())
        scored = []
        for e, t in docs:
            if ws and ws <= set(t):
                idf = lambda w: math.log((len(docs) - (n := sum(w in u for _, u in docs)) + 0.5) / (n + 0.5) + 1)
                scored.append((-round(sum(idf(w) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in ws), 6), e))
        if scored:
            want[x] = [(k + 1, e, -s) for k, (s, e) in enumerate(sorted(scored)[:3])]
    assert {k: sorted(x) for k, x in got.items()} == {k: [(n, e, pytest.approx(s, abs=2e-6)) for n, e, s in x] for k, x in want.items()}


def test_types_stay_below_the_best_top_type(spark):
    v = values(spark, {("t", "c"): ["rome", "oslo", "bolt", "else"]})
    labels = spark.createDataFrame([("rome", "r"), ("oslo", "o"), ("bolt", "b")], "label string, entity string")
    types = spark.createDataFrame([("r", "place"), ("r", "city"), ("o", "place"), ("b", "product")], "entity string, type string")
    tops = spark.createDataFrame([("place", "place"), ("place", "city"), ("product", "product")], "top string, type string")
    halved = spark.createDataFrame([("place", 0.5)], "type string, penalty double")
    of = lambda p: {r.type: r.score for r in graph.column_semantics(v, labels, types, tops, p).collect()}
    assert of(None) == {"place": round(2 / 3, 6), "city": round(1 / 3, 6)}
    assert of(halved) == {"place": round(1 / 3, 6), "city": round(1 / 3, 6)}


def test_intent_column(spark):
    found = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 1.0), ("r", "a", 1.0)], "q_table string, c_table string, score double")
    intent = spark.createDataFrame([("q", "city"), ("r", "nowhere")], "q_table string, type string")
    meaning = spark.createDataFrame([("b", "x", "city", 1.0), ("a", "x", "place", 1.0)], "table_name string, column_name string, type string, score double")
    # A query whose intent no candidate has keeps all of them.
    assert sorted(tuple(r) for r in graph.with_intent(found, intent, meaning).collect()) == [("q", "b", 1.0), ("r", "a", 1.0)]


def test_relation_scores_take_the_two_best_ways(spark):
    columns = spark.createDataFrame([("a", "x", "l", "m", 0.5), ("a", "y", "l", "n", 0.8), ("b", "u", "l", "m", 0.4), ("b", "v", "l", "n", 1.0), ("b", "v", "l", "m", 0.1)], "table_name string, column_name string, label_table string, label_column string, share double")
    sep = tables.AND
    pairs = values(spark, {("a", f"x{sep}y"): ["1", "2"], ("b", f"u{sep}v"): ["1", "3", "4", "5"]})
    got = {(r.q_table, r.c_table): r.score for r in tables.relation_column_search(columns, pairs, 5).collect()}
    # Shares 1/2 and 1/4; the ways are x-u 0.2, x-v 0.05, y-v 0.8 and y-u none.
    assert got == {("a", "b"): pytest.approx(0.125 * 0.8 * 0.2), ("b", "a"): pytest.approx(0.125 * 0.8 * 0.2)}


def test_embedding_evidence_of_given_vectors(spark):
    features = spark.createDataFrame([("a", "x", "one"), ("b", "x", "two"), ("c", "x", "far"), ("d", "x", "unknown")], "table_name string, column_name string, item string")
    words = spark.createDataFrame([("one", [1.0, 0.0]), ("two", [0.8, 0.6]), ("far", [-1.0, 0.0])], "item string, vector array<double>")
    got = {(r.q_table, r.c_table): r.score for r in similarity.embedding_similarity(features, words, 0.8, 2).collect()}
    assert got == {("a", "b"): 0.8, ("b", "a"): 0.8}
    assert similarity.embedding_similarity(features.limit(0), words, 0.8, 2).count() == 0


def plain_token_features(columns, max_share=0.5, stop=()):
    import re

    out = set()
    for key, vs in columns.items():
        told = {v: [t for s in re.split(r"[^\w\s@&-]+", v.lower()) if (t := re.findall(r"\w{2,}", s))] for v in vs}
        df = {}
        for shingles in told.values():
            for token in {t for s in shingles for t in s}:
                df[token] = df.get(token, 0) + 1
        weighing = {t: n for t, n in df.items() if n <= max_share * len(vs) and t not in stop}
        if weighing:
            out |= {(*key, min(s, key=lambda t: (weighing.get(t, 2**62), s.index(t)))) for shingles in told.values() for s in shingles}
    return out


@pytest.mark.parametrize("known", [0, 3, 40, 200_000])
def test_token_features_by_known_and_unknown_tokens(spark, known):
    """However many frequent tokens settle shingles as they are read, the rest meet in a join."""
    import random

    r = random.Random(8)
    word = lambda: f"w{min(int(r.expovariate(0.05)), 90)}"
    text = lambda: "".join(r.choice([" ", " ", ", ", "; ", "-"]) + word() for _ in range(r.randint(0, 12)))
    columns = {("a", "c"): {text() for _ in range(700)}, ("b", "c"): {text() for _ in range(40)}, ("c", "c"): {"one two", "one"}, ("d", "c"): {"1", "22", "333", "22 333"}, ("e", "c"): {"only this"}, ("f", "c"): {""}}
    v = values(spark, {k: sorted(c) for k, c in columns.items()}).repartition(2)
    assert {tuple(x) for x in similarity.token_features(v, known_tokens=known).collect()} == plain_token_features(columns)
    found = similarity.token_features(v, known_tokens=known, stop_words=("w3", "w4")).collect()
    assert len(found) == len(set(found)) and {tuple(x) for x in found} == plain_token_features(columns, stop=("w3", "w4"))


def test_token_features_write_less_than_they_read(spark):
    """Tokens are not kept by place: what stays in the shared folder is smaller than the texts."""
    import random

    r = random.Random(9)
    texts = [" ".join(f"word{min(int(r.expovariate(0.02)), 400)}" for _ in range(200)) for _ in range(500)]
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    used = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = used()
    assert similarity.token_features(values(spark, {("a", "c"): texts})).count() > 0
    assert used() - before < sum(map(len, texts))
