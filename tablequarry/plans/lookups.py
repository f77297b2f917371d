"""Named queries of predicates, set operations between results, and sketches' utilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets, sketches
from . import catalog
from .catalog import OVERLAPS_SQL, top_sql, values, values_sql
from .queries import BARE, NAME_SQL, SIG_SQL, SQL, attr_value_match, containment_topk, jaccard_sql, jaccard_topk, lsh_candidates, overlap_topk, qgram_name_sim, query, signatures, token_order

WORDS_SQL = f"WITH {values_sql().replace('cv AS (', 'lv AS (')}, cv AS (SELECT * FROM lv WHERE NOT regexp_full_match(value, '[0-9]+'))"


@query(f"{WORDS_SQL}, {OVERLAPS_SQL} {top_sql('overlap::DOUBLE', 10)}")
def word_overlap_topk(spark, root):
    """Overlaps of words alone: strings of digits name no candidate."""
    return sets.top_columns(sets.text_values(values(spark, root)), "overlap", 10)


@query(f"WITH {values_sql()} SELECT table_name, column_name FROM cells WHERE value IS NOT NULL GROUP BY ALL HAVING bool_and(try_cast(value AS DOUBLE) IS NOT NULL)")
def numeric_columns(spark, root):
    return sets.numeric_columns(catalog.lake(spark, root).cells())


@query(f"WITH {values_sql()}, {OVERLAPS_SQL} SELECT q_table, q_column, c_table, c_column FROM p WHERE overlap = q_size")
def subset_columns(spark, root):
    v = values(spark, root)
    return sets.containment_pairs(v, 1.0).select(*sets.PAIR)


@query(f"""WITH {values_sql()}, {OVERLAPS_SQL}, sb AS (SELECT q_table AS t, q_column AS c, c_table AS wt, c_column AS wc FROM p WHERE overlap = q_size)
    SELECT q_table, q_column, c_table, c_column, EXISTS (SELECT 1 FROM sb x JOIN sb y ON x.wt = y.wt AND x.wc = y.wc WHERE x.t = q_table AND x.c = q_column AND y.t = c_table AND y.c = c_column) AS covered
    FROM p WHERE q_table <> c_table AND {BARE.format('q_column')} = {BARE.format('c_column')}""")
def covered_pairs(spark, root):
    """Columns of one name that share a value, and whether a third column holds both whole."""
    return sets.covered_pairs(values(spark, root), sets.name_and_value_match(values(spark, root), None))


@query(f"WITH o AS ({SQL['token_order']}), {values_sql()} SELECT table_name, column_name, count(*) AS size, md5(string_agg(token_id::VARCHAR, ',' ORDER BY token_id)) AS tokens_md5 FROM cv JOIN o USING (value) GROUP BY ALL")
def token_sets(spark, root):
    found = sets.token_sets(values(spark, root), token_order(spark, root))
    return found.select("table_name", "column_name", F.size("tokens").cast("long").alias("size"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("tokens_md5"))


@query(f"""WITH m AS ({SQL['attr_value_match']}), s AS (SELECT q_table, c_table, round(max(score), 6) AS score, count(*) AS n_pairs FROM m GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY q_table ORDER BY score DESC, n_pairs, c_table)::INT AS rank FROM s QUALIFY rank <= 10""")
def score_then_size(spark, root):
    """Tables by their best match; of equal ones, that with fewer matches first."""
    tables = attr_value_match(spark, root).groupBy("q_table", "c_table").agg(F.max("score").alias("s"), F.count(F.lit(1)).alias("n_pairs"))
    return sets.ranked(tables, F.round("s", 6), 10, by=["q_table"], then=["n_pairs", "c_table"]).select("q_table", "c_table", "score", "n_pairs", "rank")


@query(f"SELECT DISTINCT q_table, c_table FROM (SELECT q_table, c_table FROM ({SQL['overlap_topk']}) UNION ALL SELECT q_table, c_table FROM (WITH {values_sql()}, {NAME_SQL}, {jaccard_sql('s', 'nf')} SELECT * FROM s)) WHERE q_table <> c_table")
def candidate_tables(spark, root):
    return sets.candidate_union(overlap_topk(spark, root), qgram_name_sim(spark, root))


@query(f"WITH l AS ({SQL['lsh_candidates']}) SELECT c_table, c_column FROM l WHERE q_table = 'customer' AND q_column = 'c_nationkey' INTERSECT SELECT c_table, c_column FROM l WHERE q_table = 'supplier' AND q_column = 's_nationkey'")
def buffered_queries(spark, root):
    """Columns that a sketch search finds for each of two buffered query columns."""
    found = lsh_candidates(spark, root)
    of = lambda t, c: found.where((F.col("q_table") == t) & (F.col("q_column") == c))
    return sets.candidate_intersection(of("customer", "c_nationkey"), of("supplier", "s_nationkey"))


@query(f"SELECT q_table, q_column, c_table, c_column FROM ({SQL['overlap_topk']}) EXCEPT ALL SELECT q_table, q_column, c_table, c_column FROM ({SQL['jaccard_topk']})")
def results_without_known(spark, root):
    return sets.without(overlap_topk(spark, root).select(*sets.PAIR), jaccard_topk(spark, root))


@query(f"SELECT q_table, q_column, c_table, c_column FROM ({SQL['overlap_topk']}) UNION SELECT q_table, q_column, c_table, c_column FROM ({SQL['containment_topk']})")
def merged_results(spark, root):
    from ..sources.lake import merged

    return merged(f(spark, root).select(*sets.PAIR) for f in (overlap_topk, containment_topk))


@query(f"WITH {values_sql()}, {SIG_SQL} SELECT table_name, column_name, first(table_name) OVER w AS first_table, first(column_name) OVER w AS first_column, count(*) OVER (PARTITION BY signature) AS columns FROM g WINDOW w AS (PARTITION BY signature ORDER BY table_name, column_name)")
def equal_signatures(spark, root):
    return sketches.equal_signatures(signatures(spark, root))
