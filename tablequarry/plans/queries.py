"""The library's named queries: (spark, folder of parquet tables) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, text
from ..functions.stats import best_bands
from ..operators import evaluation, graph, sets, similarity, sketches, tables, vectors
from ..sources.store import cut, kept
from . import catalog
from .catalog import OVERLAPS_SQL, TEXT, top_sql, values, values_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


JSON = "to_json(list({'table_name': table_name, 'column_name': column_name} ORDER BY table_name, column_name))"
DIGITS = "len(regexp_replace(value, '[^0-9]', '', 'g'))"


@query(f"""WITH {values_sql()} SELECT table_name, column_name, count(*) AS n_rows, count(value) AS n_nonnull, count(DISTINCT value) AS n_distinct, min(length(value)) AS min_len,
    max(length(value)) AS max_len, round(avg(length(value)), 6) AS avg_len, 2 * count_if(NOT regexp_full_match(value, '[0-9]+') AND 2 * {DIGITS} <= length(value)) > count(value) AS is_text FROM cells GROUP BY ALL""")
def column_profile(spark, root):
    return sets.profile(catalog.lake(spark, root).cells())


@query(f"WITH {values_sql()} SELECT table_name, column_name, count(value) AS n_nonnull, count(DISTINCT value) AS n_distinct FROM cells GROUP BY ALL")
def null_distinct_counts(spark, root):
    return catalog.lake(spark, root).counts()


@query(f"WITH {values_sql()} SELECT * FROM cv WHERE ('0x' || substr(md5('lake' || table_name), 1, 8))::BIGINT % 5 < 2")
def lake_sample(spark, root):
    from ..sources.lake import sampled

    return sampled(values(spark, root), 2, 5, salt="lake")


@query(f"WITH {values_sql()}, r AS (SELECT *, rank() OVER (PARTITION BY table_name, column_name ORDER BY freq DESC) AS r FROM cv) SELECT table_name, column_name, value, freq FROM r WHERE r = 1")
def column_modes(spark, root):
    return sets.modes(values(spark, root))


@query(f"WITH {values_sql()} SELECT value, {JSON}::VARCHAR AS postings, count(*) AS frequency FROM cv GROUP BY value")
def posting_lists(spark, root):
    return sets.posting_lists(values(spark, root)).withColumn("postings", F.to_json("postings"))


@query(f"""WITH {values_sql()}, l AS (SELECT value, count(*) AS frequency, md5({JSON}) AS list FROM cv GROUP BY value)
    SELECT value, frequency, row_number() OVER (ORDER BY frequency, list, value) AS token_id, dense_rank() OVER (ORDER BY frequency, list) AS group_id FROM l""")
def token_order(spark, root):
    return sets.token_order(values(spark, root))


@query(f"WITH {values_sql()}, {OVERLAPS_SQL} {top_sql('overlap::DOUBLE', 10)}")
def overlap_topk(spark, root):
    return sets.top_columns(values(spark, root), "overlap", 10)


@query(SQL["overlap_topk"])
def overlap_bound_topk(spark, root):
    return sets.top_overlaps(values(spark, root), 10)


@query(f"WITH {values_sql()}, {OVERLAPS_SQL} SELECT q_table, q_column, c_table, c_column, overlap, q_size FROM p WHERE overlap >= ceil(0.7 * q_size - 1e-9)")
def overlap_prefix_filter(spark, root):
    return sets.containment_pairs(values(spark, root), 0.7)


@query(f"WITH {values_sql()}, {OVERLAPS_SQL} {top_sql('round(overlap / q_size, 6)', 10)}")
def containment_topk(spark, root):
    return sets.top_columns(values(spark, root), "containment", 10)


@query(f"WITH {values_sql()}, {OVERLAPS_SQL} {top_sql('round(overlap / least(q_size, c_size), 6)', 10)}")
def min_overlap_topk(spark, root):
    return sets.top_columns(values(spark, root), "min_overlap", 10)


@query(f"WITH {values_sql()}, {OVERLAPS_SQL} {top_sql('round(overlap / (q_size + c_size - overlap), 6)', 10)}")
def jaccard_topk(spark, root):
    return sets.top_columns(values(spark, root), "jaccard", 10)


@query(f"WITH {values_sql()}, {OVERLAPS_SQL} {top_sql('round(overlap / q_size, 6)', 10, where=chr(34) + 'q_table' + chr(34) + ' IN (SELECT table_name FROM ' + '(VALUES (' + repr('orders') + '), (' + repr('lineitem') + ')) v(table_name))')}")
def query_columns_only(spark, root):
    asked = spark.createDataFrame([(t, c) for t in ("orders", "lineitem") for c in catalog.COLUMNS[t]], "table_name string, column_name string")
    return sets.top_columns(values(spark, root), "containment", 10, asked)


BARE = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\(.*?\\)', '', 'g'), '\\s+', '', 'g'), '^[a-z]+_', '')"


@query(f"WITH {values_sql()}, {OVERLAPS_SQL} " + top_sql("round(overlap / least(q_size, c_size), 6)", 60, where=f"q_table <> c_table AND {BARE.format('q_column')} = {BARE.format('c_column')}"))
def attr_value_match(spark, root):
    return sets.name_and_value_match(values(spark, root), 60)


@query(f"WITH {values_sql()}, n AS (SELECT value FROM cv GROUP BY value HAVING count(*) < 5) SELECT table_name, column_name, count(*) AS kept FROM cv WHERE value IN (SELECT value FROM n) GROUP BY ALL")
def noise_cutoff(spark, root):
    return sets.rare_values(values(spark, root), 5).groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("kept"))


NUM = sketches.NUM_PERM
PERMS = hashing.permutations(NUM)
HASHED_SQL = f"h AS (SELECT table_name, column_name, ('0x' || substr(md5(value), 1, 8))::BIGINT % {hashing.PRIME} AS h FROM cv)"
SIG_SQL = f"{HASHED_SQL}, g AS (SELECT table_name, column_name, count(*) AS size, [{', '.join(f'min(({a}::BIGINT * h + {b}) % {hashing.PRIME})' for a, b in PERMS)}] AS signature FROM h GROUP BY ALL)"
ESTIMATE = f"round(len(list_filter(list_zip(a.signature, b.signature), lambda z: z[1] = z[2])) / {NUM}, 6)"


def signatures(spark: SparkSession, root: str) -> DataFrame:
    return sketches.signatures(values(spark, root))


@query(f"WITH {values_sql()}, {SIG_SQL} SELECT table_name, column_name, size, array_to_string(signature, ',') AS signature FROM g")
def minhash_signature(spark, root):
    return signatures(spark, root).withColumn("signature", F.array_join("signature", ","))


@query(f"WITH {values_sql()}, {SIG_SQL} SELECT table_name, column_name, round({NUM} / list_sum(list_transform(signature, lambda m: m / {hashing.PRIME}::DOUBLE)) - 1, 6) AS estimate FROM g")
def minhash_cardinality(spark, root):
    return signatures(spark, root).select("table_name", "column_name", F.round(sketches.cardinality(F.col("signature"), NUM), 6).alias("estimate"))


PAIR_SQL = "a.table_name AS q_table, a.column_name AS q_column, b.table_name AS c_table, b.column_name AS c_column"
DIFFERENT = "(a.table_name <> b.table_name OR a.column_name <> b.column_name)"


@query(f"WITH {values_sql()}, {SIG_SQL} SELECT {PAIR_SQL}, {ESTIMATE} AS score FROM g a JOIN g b ON {DIFFERENT} WHERE len(list_filter(list_zip(a.signature, b.signature), lambda z: z[1] = z[2])) > 0")
def minhash_jaccard(spark, root):
    sig = cut(signatures(spark, root))
    return sketches.estimated_jaccard(sig, sketches.band_collisions(sig, NUM, 1), NUM)


BANDS, ROWS = best_bands(0.5, NUM, sketches.RECALL)
BAND_SQL = f"bd AS (SELECT table_name, column_name, band, array_to_string(signature[band * {ROWS} + 1:(band + 1) * {ROWS}], ',') AS bucket FROM (SELECT unnest(range({BANDS})) AS band, * FROM g)), hi AS (SELECT {PAIR_SQL}, count(*) AS hits FROM bd a JOIN bd b ON a.band = b.band AND a.bucket = b.bucket AND {DIFFERENT} GROUP BY ALL)"
JACCARD_SQL = "round(overlap / (q_size + c_size - overlap), 6)"


@query(f"WITH {values_sql()}, {SIG_SQL}, {BAND_SQL}, {OVERLAPS_SQL} SELECT q_table, q_column, c_table, c_column, {JACCARD_SQL} AS score FROM p JOIN hi USING (q_table, q_column, c_table, c_column) WHERE {JACCARD_SQL} >= 0.5")
def lsh_candidates(spark, root):
    return sketches.lsh_search(values(spark, root), 0.5)


@query(f"WITH {values_sql()}, {SIG_SQL}, {BAND_SQL} SELECT q_table, q_column, c_table, c_column, hits AS score, row_number() OVER (PARTITION BY q_table, q_column ORDER BY hits DESC, c_table, c_column)::INT AS rank FROM hi QUALIFY rank <= 10")
def lsh_collision_topk(spark, root):
    return sketches.collision_ranked(signatures(spark, root), BANDS, ROWS, 10)


@query(f"WITH {values_sql()}, {SIG_SQL}, {BAND_SQL} SELECT band, bucket, count(*) AS columns FROM bd GROUP BY ALL")
def lsh_bucket_counts(spark, root):
    return sketches.bucket_counts(signatures(spark, root), BANDS, ROWS)


def _ensemble_sql() -> str:
    """Partitions are the engine's own to choose: whatever they are, a pair over the threshold that is missed shows."""
    return f"WITH {values_sql()}, {OVERLAPS_SQL} " + top_sql("round(overlap / q_size, 6)", 10, where="overlap / q_size >= 0.8")


@query(_ensemble_sql())
def lsh_ensemble_topk(spark, root):
    return sketches.ensemble_search(values(spark, root), threshold=0.8, k=10)


# Similarity of names, formats and tokens.

NAME_SQL = r"""nf0 AS (SELECT DISTINCT table_name, column_name, regexp_replace(lower(column_name), '^[a-z]+_', '') AS nm FROM cv),
    nf AS (SELECT DISTINCT table_name, column_name, unnest(CASE WHEN length(nm) <= 3 THEN [nm] ELSE list_transform(range(1, length(nm) - 1), lambda i: substr(nm, i, 3)) END) AS item FROM nf0)"""


def _format_sql() -> str:
    parts = dict(text.FORMAT_PARTS)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    letter = f"CASE WHEN regexp_full_match(x, {quoted(parts['q'])}) THEN CASE WHEN regexp_matches(array_to_string(t[i:], ''), '[0-9,.]') THEN 'q' ELSE 's' END " + " ".join(f"WHEN regexp_full_match(x, {quoted(parts[k])}) THEN '{k}'" for k in "alcuwdeijp") + " ELSE 'x' END"
    return f"""ff0 AS (SELECT *, regexp_extract_all(regexp_replace(replace(value, chr(10), ' '), {quoted(f'^[{text._SPACE}]+|[{text._SPACE}]+$')}, '', 'g'), {quoted(text.FORMAT_PATTERN)}) AS t FROM cv WHERE value <> ''),
    ff AS (SELECT DISTINCT table_name, column_name, regexp_replace(array_to_string(list_transform(t, lambda x, i: {letter}), ''), 'x.*$', '') AS item FROM ff0)"""


FORMAT_SQL = _format_sql()
TOKEN_SQL = rf"""tk1 AS (SELECT table_name, column_name, value, generate_subscripts(s, 1) AS n, unnest(s) AS shingle FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(lower(value), '{text.SHINGLE_BREAK}'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS s FROM cv)),
    tk0 AS (SELECT table_name, column_name, value, n, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM (SELECT *, regexp_extract_all(shingle, '{text.SHINGLE_TOKEN}') AS t FROM tk1)),
    tz AS (SELECT table_name, column_name, count(*) AS size FROM cv GROUP BY ALL),
    td AS (SELECT table_name, column_name, token, CASE WHEN df <= 0.5 * size THEN df END AS df FROM (SELECT table_name, column_name, token, count(DISTINCT value) AS df FROM tk0 GROUP BY ALL) JOIN tz USING (table_name, column_name)),
    tf AS (SELECT DISTINCT table_name, column_name, item FROM (SELECT table_name, column_name, value, n, arg_min(token, (coalesce(df, 4611686018427387904), pos)) AS item FROM tk0 JOIN td USING (table_name, column_name, token) GROUP BY ALL)
        WHERE (table_name, column_name) IN (SELECT (table_name, column_name) FROM td WHERE df IS NOT NULL))"""


def jaccard_sql(name: str, features: str) -> str:
    return f"""{name}n AS (SELECT table_name, column_name, count(*) AS n FROM {features} GROUP BY ALL),
        {name} AS (SELECT q_table, q_column, c_table, c_column, round(shared / (x.n + y.n - shared), 6) AS score FROM (SELECT {PAIR_SQL}, count(*) AS shared FROM {features} a JOIN {features} b ON a.item = b.item AND {DIFFERENT} GROUP BY ALL)
        JOIN {name}n x ON x.table_name = q_table AND x.column_name = q_column JOIN {name}n y ON y.table_name = c_table AND y.column_name = c_column)"""


@query(f"WITH {values_sql()}, {NAME_SQL}, {jaccard_sql('s', 'nf')} SELECT * FROM s")
def qgram_name_sim(spark, root):
    return similarity.feature_jaccard(similarity.name_features(values(spark, root)))


@query(f"WITH {values_sql()}, {FORMAT_SQL} SELECT * FROM ff")
def format_descriptors(spark, root):
    return similarity.format_features(values(spark, root))


@query(f"WITH {values_sql(TEXT)}, {FORMAT_SQL}, {jaccard_sql('s', 'ff')} SELECT * FROM s")
def format_sim(spark, root):
    return similarity.feature_jaccard(similarity.format_features(values(spark, root, TEXT)))


@query(f"WITH {values_sql(TEXT)}, {TOKEN_SQL}, {jaccard_sql('s', 'tf')} SELECT * FROM s")
def token_value_sim(spark, root):
    return similarity.feature_jaccard(similarity.token_features(values(spark, root, TEXT)))


@query(r"""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS alnum, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS spaced,
    regexp_replace(regexp_replace(lower(p_name), '\(.*?\)', '', 'g'), '\s+', '', 'g') AS attribute, lower(p_name) IN ('nan', '-', 'unknown', 'other (unknown)', 'null', 'na', '', ' ') AS missing FROM part""")
def normalised_names(spark, root):
    c = F.col("p_name")
    return read(spark, root, "part").select("p_partkey", text.alnum(c).alias("alnum"), text.alnum_spaced(c).alias("spaced"), text.attribute_name(c).alias("attribute"), text.is_null_string(c).alias("missing"))


@query(f"""WITH {values_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY freq DESC, value) AS r FROM cv),
    w AS (SELECT table_name, column_name, column_name || ' contains ' || count(*) || ' values (' || max(length(value)) || ', ' || min(length(value)) || ', ' || printf('%.2f', round(avg(length(value)), 2)) || '): ' || string_agg(value, ', ' ORDER BY r) FILTER (r <= 512) AS s FROM r GROUP BY table_name, column_name)
    SELECT table_name, column_name, array_to_string(regexp_extract_all(s, '{text.SENTENCE_TOKEN}')[1:512], ' ') AS sentence FROM w""")
def column_sentence(spark, root):
    return similarity.column_sentences(values(spark, root))


NUMBERS = {"customer": ["c_acctbal"], "supplier": ["s_acctbal"], "part": ["p_retailprice", "p_size"], "orders": ["o_totalprice"], "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "events": ["value"]}
NUMBERS_SQL = "x AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c}::DOUBLE AS x FROM {t}" for t, cs in NUMBERS.items() for c in cs) + "), "
HISTOGRAM_SQL = """f AS (SELECT * FROM x WHERE isfinite(x)), e AS (SELECT table_name, column_name, min(x) AS lo, max(x) AS hi, count(*) AS n, (max(x) - min(x)) / 30 AS width FROM f GROUP BY ALL),
    b AS (SELECT table_name, column_name, CASE WHEN width > 0 THEN least(floor((x - lo) / width), 29) ELSE 0 END::INT AS bin, n, width FROM f JOIN e USING (table_name, column_name))"""


def numbers(spark: SparkSession, root: str) -> DataFrame:
    flat = lambda t: read(spark, root, t).select(F.lit(t).alias("table_name"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in NUMBERS[t]))).alias("p")).select("table_name", "p.*")
    return reduce(DataFrame.unionByName, map(flat, NUMBERS))


@query(f"WITH {NUMBERS_SQL} {HISTOGRAM_SQL} SELECT table_name, column_name, bin, round(count(*) / (n * CASE WHEN width > 0 THEN width ELSE 1.0 END), 6) AS density FROM b GROUP BY table_name, column_name, bin, n, width")
def histogram_density(spark, root):
    return similarity.histograms(numbers(spark, root), 30)


@query(f"WITH {NUMBERS_SQL} {HISTOGRAM_SQL}, m AS (SELECT table_name, column_name, bin, count(*) / n AS mass FROM b GROUP BY table_name, column_name, bin, n) SELECT {PAIR_SQL}, round(sum(least(a.mass, b.mass)), 6) AS score FROM m a JOIN m b ON a.bin = b.bin AND {DIFFERENT} GROUP BY ALL")
def distribution_sim(spark, root):
    return similarity.histogram_overlap(numbers(spark, root), 30)


BUCKET_SCORES_SQL = f"{SIG_SQL}, {BAND_SQL}, {OVERLAPS_SQL}, sc AS (SELECT {JACCARD_SQL} AS score FROM p JOIN hi USING (q_table, q_column, c_table, c_column))"


@query(f"WITH {values_sql()}, {BUCKET_SCORES_SQL}, t AS (SELECT least(floor(score * 50), 49)::INT AS bin, count(*) AS n FROM sc GROUP BY 1), gr AS (SELECT unnest(range(50))::INT AS bin) SELECT bin, round(coalesce(n, 0) / (SELECT sum(n) FROM t), 6) AS mass, round(sum(coalesce(n, 0)) OVER (ORDER BY bin) / (SELECT sum(n) FROM t), 6) AS cumulative FROM gr LEFT JOIN t USING (bin)")
def score_ecdf(spark, root):
    v = values(spark, root)
    pairs = cut(sketches.band_collisions(signatures(spark, root), BANDS, ROWS))
    return similarity.score_ecdf(sets.exact_overlaps(v, pairs).select(sets.MEASURES["jaccard"]().alias("score")))


EVIDENCE = ["name", "format", "value", "distribution"]
EVIDENCE_SQL = f"""WITH {values_sql()}, {NUMBERS_SQL} {HISTOGRAM_SQL}, {NAME_SQL}, {FORMAT_SQL}, {TOKEN_SQL}, {jaccard_sql('sn', 'nf')}, {jaccard_sql('sf', 'ff')}, {jaccard_sql('sv', 'tf')},
    m AS (SELECT table_name, column_name, bin, count(*) / n AS mass FROM b GROUP BY table_name, column_name, bin, n),
    sd AS (SELECT {PAIR_SQL}, round(sum(least(a.mass, b.mass)), 6) AS score FROM m a JOIN m b ON a.bin = b.bin AND {DIFFERENT} GROUP BY ALL),
    al AS (SELECT *, 'name' AS kind FROM sn UNION ALL SELECT *, 'format' FROM sf UNION ALL SELECT *, 'value' FROM sv UNION ALL SELECT *, 'distribution' FROM sd),
    ev AS (SELECT q_table, q_column, c_table, c_column, {', '.join(f"coalesce(max(score) FILTER (kind = '{k}'), 0.0) AS {k}" for k in EVIDENCE)} FROM al GROUP BY ALL)"""


def evidence(spark: SparkSession, root: str, tokens: DataFrame | None = None) -> DataFrame:
    """The four kinds of evidence. tokens: the lake's token features where they are stored already."""
    v = values(spark, root)
    j = similarity.feature_jaccard
    value = j(similarity.token_features(v)) if tokens is None else j(tokens, held=True)
    return similarity.evidence({"name": j(similarity.name_features(v)), "format": j(similarity.format_features(v)), "value": value, "distribution": similarity.histogram_overlap(numbers(spark, root), 30)})


@query(f"{EVIDENCE_SQL} {top_sql('round(((name + format) + value + distribution) / 4, 8)', 10, 'ev', 'q_table <> c_table')}")
def d3l_column_query(spark, root):
    return similarity.column_query(evidence(spark, root), EVIDENCE, 10)


@query(f"""{EVIDENCE_SQL}, be AS (SELECT q_table, q_column, c_table, {', '.join(f'max({k}) AS {k}' for k in EVIDENCE)} FROM ev WHERE q_table <> c_table GROUP BY ALL),
    sh AS (SELECT *, {', '.join(f'cume_dist() OVER (PARTITION BY q_table, q_column ORDER BY {k}) AS w_{k}' for k in EVIDENCE)} FROM be),
    pe AS (SELECT q_table, c_table, round(({' + '.join(f'sum({k} * w_{k}) / sum(w_{k})' for k in EVIDENCE)}) / 4, 6) AS score FROM sh GROUP BY ALL)
    SELECT q_table, c_table, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_table ORDER BY score DESC, c_table)::INT AS rank FROM pe) WHERE rank <= 5""")
def d3l_table_query(spark, root):
    return similarity.table_query(evidence(spark, root), EVIDENCE, 5)


@query(f"""{EVIDENCE_SQL}, sh AS (SELECT q_table, q_column, c_table, c_column, {', '.join(f'round(cume_dist() OVER (PARTITION BY q_table, q_column ORDER BY {k}), 6) AS {k}' for k in EVIDENCE)} FROM ev WHERE q_table <> c_table)
    {top_sql(f"greatest({', '.join(EVIDENCE)})", 10, 'sh')}""")
def unionability_ensemble(spark, root):
    return tables.ensemble(evidence(spark, root), EVIDENCE, 10)


KEYWORDS = ["nation", "standard", "brass", "building", "high"]


@query(f"""WITH {values_sql(TEXT)}, w AS (SELECT table_name, unnest(regexp_extract_all(lower(value), '[a-z0-9]+')) AS token FROM cv), tf AS (SELECT table_name, token, count(*) AS tf FROM w GROUP BY ALL),
    ln AS (SELECT table_name, sum(tf) AS len FROM tf GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL), f AS (SELECT count(*) AS n, avg(len) AS mean FROM ln),
    s AS (SELECT table_name, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (token) JOIN ln USING (table_name), f WHERE token IN ({', '.join(repr(k) for k in KEYWORDS)}) GROUP BY table_name)
    SELECT table_name, score, row_number() OVER (ORDER BY score DESC, table_name)::INT AS rank FROM s QUALIFY rank <= 5""")
def keyword_search(spark, root):
    return similarity.keyword_search(values(spark, root, TEXT), KEYWORDS, 5)


# Vectors. Query vectors are those whose id is divisible by 20, against all.

ASKED = "vec_id % 20 = 0"
COSINE = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
KNN_SQL = f"kn AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id)::INT AS rank FROM (SELECT a.vec_id AS q_id, b.vec_id AS c_id, {COSINE} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0))"


@query(f"WITH {KNN_SQL} SELECT * FROM kn WHERE rank <= 10")
def vector_knn(spark, root):
    e = read(spark, root, "embeddings")
    return vectors.knn(e, e.where(ASKED), 10)


EPS_SQL = "ep AS (SELECT a.vec_id AS q_id, b.vec_id AS c_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)"


def eps_pairs(spark: SparkSession, root: str, eps: float, pivots: int) -> DataFrame:
    e = read(spark, root, "embeddings")
    return vectors.pivot_eps_join(e.where(ASKED), e, eps, vectors.pivot_sample(e, pivots))


@query(f"WITH {EPS_SQL} SELECT q_id, c_id, round(d, 6) AS dist FROM ep WHERE d <= 1.05")
def vector_eps_join(spark, root):
    return eps_pairs(spark, root, 1.05, 2).withColumn("dist", F.round("dist", 6))


@query(f"WITH {EPS_SQL} SELECT q_id, c_id, round(d, 6) AS dist FROM ep WHERE d <= 1.1")
def pivot_filtered_eps_join(spark, root):
    return eps_pairs(spark, root, 1.1, 5).withColumn("dist", F.round("dist", 6))


@query("""WITH i AS (SELECT vec_id, 'col' || (vec_id % 7) AS col FROM embeddings), mt AS (SELECT a.vec_id AS q_id, b.vec_id AS c_id FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.0),
    hi AS (SELECT q.col AS q_col, c.col AS c_col, count(DISTINCT q_id) AS n FROM mt JOIN i q ON q.vec_id = q_id JOIN i c ON c.vec_id = c_id WHERE q.col <> c.col GROUP BY ALL), z AS (SELECT col AS q_col, count(*) AS size FROM i GROUP BY ALL),
    s AS (SELECT q_col, c_col, round(n / size, 6) AS score FROM hi JOIN z USING (q_col)) SELECT *, row_number() OVER (PARTITION BY q_col ORDER BY score DESC, c_col)::INT AS rank FROM s WHERE score >= 0.01 QUALIFY rank <= 5""")
def pexeso_topk(spark, root):
    e = read(spark, root, "embeddings")
    items = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("col"), F.col("vec_id") % 7).alias("col"))
    return vectors.vector_joinable(vectors.pivot_eps_join(e, e, 1.0, vectors.pivot_sample(e, 3)), items, 0.01, 5)


@query(f"SELECT label, count(*) AS n, array_to_string([{', '.join(f'round(round(avg(embedding[{i}]::DOUBLE), 6) * 1000000)::BIGINT' for i in range(1, 65))}], ',') AS mean FROM embeddings GROUP BY label")
def mean_vectors(spark, root):
    found = vectors.mean_vectors(read(spark, root, "embeddings"), "label", 64)
    return found.select("label", "n", F.array_join(F.transform("mean", lambda x: F.round(x * 1_000_000).cast("long")), ",").alias("mean"))


@query("SELECT vec_id AS id, " + " || ".join("CASE WHEN list_dot_product(embedding::DOUBLE[], [" + ", ".join(map(str, p)) + "]::DOUBLE[]) >= 0 THEN '1' ELSE '0' END" for p in hashing.planes(16, 64)) + " AS bits FROM embeddings")
def rp_lsh_bits(spark, root):
    return vectors.projection_bits(read(spark, root, "embeddings"), 16, 64)


SIMHASH_SQL = f"""wd AS (SELECT doc_id AS id, ('0x' || substr(m, 1, 8))::BIGINT AS lo, ('0x' || substr(m, 9, 8))::BIGINT AS hi FROM (SELECT doc_id, md5(unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS m FROM documents)),
    sh AS (SELECT id, ({' + '.join(f"CASE WHEN sum((({'lo' if b < 32 else 'hi'} >> {b % 32}) & 1) * 2 - 1) > 0 THEN {2**b if b < 63 else -(2**63)} ELSE 0 END" for b in range(64))})::BIGINT AS simhash FROM wd GROUP BY id)"""


@query(f"WITH {SIMHASH_SQL} SELECT * FROM sh")
def simhash_documents(spark, root):
    return vectors.simhash(read(spark, root, "documents"))


@query(f"""WITH {SIMHASH_SQL}, o AS (SELECT simhash, min(id) AS rep FROM sh GROUP BY 1)
    SELECT a.rep AS a, b.rep AS b, bit_count(xor(a.simhash, b.simhash))::INT AS distance FROM o a JOIN o b ON a.rep < b.rep AND bit_count(xor(a.simhash, b.simhash)) <= 2
    UNION ALL SELECT rep, id, 0 FROM sh JOIN o USING (simhash) WHERE id <> rep""")
def simhash_neardup(spark, root):
    return vectors.hamming_pairs(vectors.simhash(read(spark, root, "documents")), 2)


@query()
def embedding_table_topk(spark, root):
    e = read(spark, root, "embeddings")
    items = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("t"), (F.col("vec_id") / 10).cast("long")).alias("table_name"), (F.col("vec_id") % 10).cast("string").alias("column_name"))
    return vectors.embedding_table_search(items, vectors.knn(e, e, 10), e, 0.3, 60)  # 0.7 finds nothing here: see README


@query()
def signature_vector_search(spark, root):
    sig = cut(signatures(spark, root))
    v = sig.select(F.xxhash64("table_name", "column_name").alias("vec_id"), F.col("signature").cast("array<double>").alias("embedding"), "table_name", "column_name")
    items = v.select(F.col("vec_id").alias("id"), "table_name", "column_name")
    return vectors.embedding_table_search(items, vectors.knn(v, v, 10), v, 0.7, 60)


@query()
def bipartite_match_topk(spark, root):
    w = sets.overlaps(values(spark, root)).where("q_table != c_table").withColumn("score", sets.MEASURES["min_overlap"]())
    return sets.ranked(vectors.best_matching(w), F.col("score"), 10, by=["q_table"], then=["c_table"]).select("q_table", "c_table", "score", "n_pairs", "rank")


GREEDY_SQL = """ca0 AS (SELECT q_table, c_table, list({'s': score, 'q': q_column, 'c': c_column} ORDER BY score DESC, q_column, c_column) AS e FROM (SELECT q_table, q_column, c_table, c_column, round(overlap / q_size, 6) AS score FROM p WHERE q_table <> c_table) GROUP BY ALL),
    ca1 AS (SELECT q_table, c_table, list_reduce(list_prepend({'s': [0.0::DOUBLE][2:1], 'q': [''][2:1], 'c': [''][2:1]}, list_transform(e, lambda x: {'s': [x.s::DOUBLE], 'q': [x.q], 'c': [x.c]})),
        lambda a, x: CASE WHEN list_contains(a.q, x.q[1]) OR list_contains(a.c, x.c[1]) THEN a ELSE {'s': list_concat(a.s, x.s), 'q': list_concat(a.q, x.q), 'c': list_concat(a.c, x.c)} END).s AS s FROM ca0),
    ca2 AS (SELECT q_table, c_table, i::INT AS c, round(list_product(s[1:i]), 9) AS score FROM ca1, unnest(range(1, len(s) + 1)) AS u(i)),
    ca3 AS (SELECT *, round(cume_dist() OVER (PARTITION BY c ORDER BY score), 6) AS g FROM ca2),
    ca4 AS (SELECT q_table, c_table, arg_max(c, (g, c)) AS c, max(g) AS score FROM ca3 GROUP BY ALL)"""


@query(f"WITH {values_sql()}, {OVERLAPS_SQL}, {GREEDY_SQL} SELECT q_table, c_table, c, score, row_number() OVER (PARTITION BY q_table ORDER BY score DESC, c_table)::INT AS rank FROM ca4 QUALIFY rank <= 10")
def c_alignment_greedy(spark, root):
    return tables.c_alignment(sets.overlaps(values(spark, root)).where("q_table != c_table").withColumn("score", sets.MEASURES["containment"]()), 10)


# Tables: complements, unionability, synthesised semantics.

SCHEMA = [(t, c.split("_", 1)[-1]) for t, cs in catalog.COLUMNS.items() for c in cs]
SCHEMA_SQL = f"sc AS (SELECT DISTINCT * FROM (VALUES {', '.join(map(str, SCHEMA))}) v(table_name, attr))"
ATTR_SQL = """atf AS (SELECT attr, count(*) AS freq FROM sc GROUP BY 1), ap AS (SELECT x.attr AS a, y.attr AS b, count(*) AS freq FROM sc x JOIN sc y ON x.table_name = y.table_name AND x.attr <> y.attr GROUP BY ALL)"""
BENEFIT_SQL = """qn AS (SELECT table_name, count(*) AS n FROM sc GROUP BY 1), pr AS (SELECT q.table_name AS q_table, ap.a AS attr, round(sum(ap.freq / atf.freq) / any_value(qn.n), 6) AS benefit FROM sc q JOIN ap ON ap.b = q.attr JOIN atf ON atf.attr = q.attr JOIN qn ON qn.table_name = q.table_name
    WHERE NOT EXISTS (SELECT 1 FROM sc z WHERE z.table_name = q.table_name AND z.attr = ap.a) GROUP BY ALL),
    bn AS (SELECT q_table, c.table_name AS c_table, attr AS added, benefit FROM pr JOIN sc c USING (attr) WHERE q_table <> c.table_name QUALIFY row_number() OVER (PARTITION BY q_table, c.table_name ORDER BY benefit DESC, attr) = 1)"""


def schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEMA, "table_name string, attr string")


@query(f"WITH {SCHEMA_SQL}, {ATTR_SQL} SELECT a, b, ap.freq, x.freq AS freq_a, y.freq AS freq_b FROM ap JOIN atf x ON x.attr = a JOIN atf y ON y.attr = b WHERE a < b")
def attr_freq_pairs(spark, root):
    return tables.attribute_pairs(schema(spark))


@query(f"WITH {SCHEMA_SQL}, {ATTR_SQL}, {BENEFIT_SQL} SELECT * FROM bn")
def schema_benefit(spark, root):
    return tables.schema_benefit(schema(spark))


#: The columns that hold a table's entities: the leading ones.
ENTITY = [(t, cs[0]) for t, cs in catalog.COLUMNS.items()]


@query(f"""WITH {values_sql()}, {SCHEMA_SQL}, {ATTR_SQL}, {BENEFIT_SQL}, en AS (SELECT * FROM (VALUES {', '.join(map(str, ENTITY))}) v(table_name, column_name)), ev AS (SELECT cv.* FROM cv JOIN en USING (table_name, column_name)),
    sz AS (SELECT table_name, column_name, count(*) AS size FROM ev GROUP BY ALL), co AS (SELECT q_table, c_table, max(o / size) AS cover FROM (SELECT {PAIR_SQL}, count(*) AS o FROM ev a JOIN ev b ON a.value = b.value AND {DIFFERENT} GROUP BY ALL) JOIN sz ON sz.table_name = q_table AND sz.column_name = q_column GROUP BY ALL)
    SELECT q_table, c_table, round(cover * benefit, 6) AS score, row_number() OVER (PARTITION BY q_table ORDER BY round(cover * benefit, 6) DESC, c_table)::INT AS rank FROM co JOIN bn USING (q_table, c_table) QUALIFY rank <= 5""")
def schema_complement_topk(spark, root):
    return tables.schema_complement(values(spark, root), spark.createDataFrame(ENTITY, "table_name string, column_name string"), schema(spark), 5)


LABELS_SQL = "lb AS (SELECT table_name, lower(value) AS label, row_number() OVER (PARTITION BY table_name, column_name ORDER BY freq DESC, value) AS rank FROM cv), lv AS (SELECT table_name, label, sum(1.0::DOUBLE / rank) AS v FROM lb GROUP BY ALL), lw AS (SELECT table_name, label, pow(v, 2) / pow(count(*) OVER (PARTITION BY label), 2) AS weight FROM lv)"


def labels(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("table_name", "column_name").orderBy(F.desc("freq"), "value")
    return values(spark, root).select("table_name", F.lower("value").alias("label"), F.row_number().over(w).alias("rank"))


@query(f"WITH {values_sql()}, {LABELS_SQL} SELECT a.table_name AS q_table, b.table_name AS c_table, round(sum(a.weight * b.weight), 6) AS score FROM lw a JOIN lw b ON a.label = b.label AND a.table_name <> b.table_name GROUP BY ALL")
def entity_complement_labels(spark, root):
    return tables.entity_complement(labels(spark, root))


@query()
def entity_complement_topk(spark, root):
    return tables.entity_complement_search(labels(spark, root), qgram_name_sim(spark, root), 5)


#: After p: the hypergeometric score of each pair.
HYPER_SQL = """lf AS (SELECT i, sum(CASE WHEN i = 0 THEN 0 ELSE ln(greatest(i, 1)) END) OVER (ORDER BY i) AS f FROM range(0, (SELECT 2 * max(size) + 1 FROM sz)) r(i)), la AS (SELECT list(f ORDER BY i) AS f FROM lf)
    SELECT q_table, q_column, c_table, c_column, least(1.0, round(list_sum(list_transform(range(0, overlap + 1), lambda k: exp(f[q_size + 1] - f[k + 1] - f[q_size - k + 1] + f[c_size + 1] - f[c_size - k + 1] - f[k + 1] - f[q_size + c_size + 1] + f[c_size + 1] + f[q_size + 1]))), 6)) AS score FROM p, la"""


@query(f"WITH {values_sql()}, {OVERLAPS_SQL}, {HYPER_SQL}")
def hypergeom_unionability(spark, root):
    return tables.set_unionability(sets.overlaps(values(spark, root)))


@query()
def nl_unionability(spark, root):
    return tables.language_unionability(read(spark, root, "embeddings"), "label", 64)


@query(f"""WITH {values_sql()}, {OVERLAPS_SQL}, v AS (SELECT a.table_name AS q_table, a.column_name AS q_column, a.value, arg_min((b.table_name, b.column_name), (-overlap / q_size, b.table_name, b.column_name)) AS label FROM cv a JOIN cv b ON a.value = b.value AND a.table_name <> b.table_name
    JOIN p ON p.q_table = a.table_name AND p.q_column = a.column_name AND p.c_table = b.table_name AND p.c_column = b.column_name GROUP BY ALL)
    SELECT q_table AS table_name, q_column AS column_name, label[1] AS label_table, label[2] AS label_column, round(count(*) / any_value(size), 6) AS share FROM v JOIN sz ON sz.table_name = q_table AND sz.column_name = q_column GROUP BY ALL""")
def synth_column_semantics(spark, root):
    return tables.synthesised_columns(values(spark, root))


PAIRS = [(t, a, b) for t, cs in catalog.COLUMNS.items() for i, a in enumerate(cs) for b in cs[i + 1 :]]
FD_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{a}' AS lhs, '{b}' AS rhs FROM (SELECT {a}, count(DISTINCT {b}::VARCHAR) AS n FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) HAVING max(n) = 1" for t, x, y in PAIRS for a, b in ((x, y), (y, x)))
#: A pair of columns is a relation where one of them determines the other.
RELATIONS_SQL = f"fd AS ({FD_SQL}), rp AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{a}' || chr(31) || '{b}' AS column_name, {a}::VARCHAR || chr(31) || {b}::VARCHAR AS value FROM {t} WHERE EXISTS (SELECT 1 FROM fd WHERE table_name = '{t}' AND (lhs = '{a}' AND rhs = '{b}' OR lhs = '{b}' AND rhs = '{a}'))" for t, a, b in PAIRS) + ") WHERE value IS NOT NULL)"
REL_OVERLAP = f"rz AS (SELECT table_name, column_name, count(*) AS size FROM rp GROUP BY ALL), ro AS (SELECT o.*, o.overlap / rz.size AS rel FROM (SELECT {PAIR_SQL}, count(*) AS overlap FROM rp a JOIN rp b ON a.value = b.value AND a.table_name <> b.table_name GROUP BY ALL) o JOIN rz ON rz.table_name = q_table AND rz.column_name = q_column)"


def dependencies(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, lhs, rhs) of all tables; an index, made once a session."""
    each = lambda: reduce(DataFrame.union, (sets.functional_dependencies(read(spark, root, t), cs).select(F.lit(t).alias("table_name"), "lhs", "rhs") for t, cs in catalog.COLUMNS.items()))
    return kept(spark, "dependencies", [f"{root}/{t}.parquet" for t in catalog.COLUMNS], each)


def relation_pairs(spark: SparkSession, root: str) -> DataFrame:
    # Names of columns, no more than the schema has.
    found = {(r.table_name, frozenset((r.lhs, r.rhs))) for r in dependencies(spark, root).collect()}
    pairs = [(t, a, b) for t, a, b in PAIRS if (t, frozenset((a, b))) in found]
    return tables.pair_values({t: read(spark, root, t) for t in catalog.COLUMNS}, pairs)


@query(f"WITH {RELATIONS_SQL}, {REL_OVERLAP} SELECT q_table, q_column, c_table, c_column, round(rel, 6) AS score FROM ro")
def synth_relation_semantics(spark, root):
    return sets.overlaps(relation_pairs(spark, root)).where("q_table != c_table").select("q_table", "q_column", "c_table", "c_column", sets.MEASURES["containment"]().alias("score"))


@query(f"""WITH {values_sql()}, {OVERLAPS_SQL}, {RELATIONS_SQL}, {REL_OVERLAP}, rs AS (SELECT *, split_part(q_column, chr(31), 1) AS q1, split_part(q_column, chr(31), 2) AS q2, split_part(c_column, chr(31), 1) AS c1, split_part(c_column, chr(31), 2) AS c2 FROM ro),
    b AS (SELECT rs.q_table, rs.c_table, rs.q_column, max(rel * (x.overlap / x.q_size) * (y.overlap / y.q_size)) AS s FROM rs JOIN p x ON x.q_table = rs.q_table AND x.c_table = rs.c_table AND x.q_column = q1 AND x.c_column = c1 JOIN p y ON y.q_table = rs.q_table AND y.c_table = rs.c_table AND y.q_column = q2 AND y.c_column = c2 GROUP BY ALL)
    SELECT q_table, c_table, score, row_number() OVER (PARTITION BY q_table ORDER BY score DESC, c_table)::INT AS rank FROM (SELECT q_table, c_table, round(sum(s), 6) AS score FROM b GROUP BY q_table, c_table) QUALIFY rank <= 5""")
def santos_synth_topk(spark, root):
    return tables.synthesised_search(values(spark, root), relation_pairs(spark, root), 5)


# Graphs and knowledge.

GRAPH_SQL = f"""{OVERLAPS_SQL}, {NAME_SQL}, {jaccard_sql('sn', 'nf')}, vs AS (SELECT q_table, q_column, c_table, c_column, round(overlap / (q_size + c_size - overlap), 6) AS v FROM p),
    wi AS (SELECT table_name, column_name, avg(length(value)) AS w FROM cv GROUP BY ALL),
    ed AS (SELECT q_table || chr(31) || q_column AS src, c_table || chr(31) || c_column AS dst, round((coalesce(v, 0) + coalesce(sn.score, 0) + least(x.w, y.w) / greatest(x.w, y.w)) / 3, 6) AS weight FROM vs FULL JOIN sn USING (q_table, q_column, c_table, c_column) JOIN wi x ON x.table_name = q_table AND x.column_name = q_column JOIN wi y ON y.table_name = c_table AND y.column_name = c_column),
    ge AS (SELECT * FROM ed WHERE weight >= 0.4)"""


def graph_of(spark: SparkSession, root: str) -> DataFrame:
    v = values(spark, root)
    value = sets.overlaps(v).withColumn("score", sets.MEASURES["jaccard"]())
    widths = v.groupBy("table_name", "column_name").agg(F.avg(F.length("value")).alias("width"))
    return graph.column_graph(value, similarity.feature_jaccard(similarity.name_features(v)), widths, 0.4)


@query(f"WITH {values_sql()}, {GRAPH_SQL} SELECT * FROM ge")
def column_graph(spark, root):
    return graph_of(spark, root)


PPR_SQL = "st AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM ge), so AS (SELECT DISTINCT src AS source FROM ge), i0 AS (SELECT source, source AS node, 1.0::DOUBLE AS score FROM so), " + ", ".join(
    f"i{k} AS (SELECT source, node, sum(score) AS score FROM (SELECT i.source, st.dst AS node, i.score * st.p * 0.7 AS score FROM i{k - 1} i JOIN st ON st.src = i.node UNION ALL SELECT source, source, 0.3 FROM so) GROUP BY ALL)" for k in range(1, 21)
)


def page_ranks(edges: DataFrame) -> DataFrame:
    return graph.pagerank(edges, edges.select(F.col("src").alias("source")).distinct())


@query(f"WITH {values_sql()}, {GRAPH_SQL}, {PPR_SQL} SELECT source, node, round(score, 6) AS score FROM i20")
def ppr_fixed_iter(spark, root):
    return page_ranks(graph_of(spark, root)).withColumn("score", F.round("score", 6))


DIRECT_SQL = f"di AS (SELECT q_table || chr(31) || q_column AS source, c_table || chr(31) || c_column AS via, round(overlap / least(q_size, c_size), 6) AS weight FROM p WHERE q_table <> c_table AND {BARE.format('q_column')} = {BARE.format('c_column')})"
HOLISTIC_SQL = "ho AS (SELECT di.source, i20.node, round(sum(di.weight * i20.score), 6) AS score FROM di JOIN i20 ON i20.source = di.via WHERE di.source <> i20.node GROUP BY ALL)"


def direct_matches(spark: SparkSession, root: str) -> DataFrame:
    m = sets.name_and_value_match(values(spark, root), None)
    return m.select(F.concat_ws(graph.OF, "q_table", "q_column").alias("source"), F.concat_ws(graph.OF, "c_table", "c_column").alias("node"), F.col("score").alias("weight"))


@query(f"WITH {values_sql()}, {GRAPH_SQL}, {PPR_SQL}, {DIRECT_SQL}, {HOLISTIC_SQL} SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, node)::INT AS rank FROM ho QUALIFY rank <= 10")
def infogather_join_topk(spark, root):
    return graph.holistic(direct_matches(spark, root), page_ranks(graph_of(spark, root)), 10)


@query()
def infogather_union_topk(spark, root):
    found = graph.holistic(direct_matches(spark, root), page_ranks(graph_of(spark, root)), 60)
    part = lambda c, k: F.element_at(F.split(c, graph.OF), k)
    w = found.select(part("source", 1).alias("q_table"), part("source", 2).alias("q_column"), part("node", 1).alias("c_table"), part("node", 2).alias("c_column"), "score").where("q_table != c_table")
    return sets.ranked(vectors.best_matching(w), F.col("score"), 10, by=["q_table"], then=["c_table"]).select("q_table", "c_table", "score", "n_pairs", "rank")


PARENTS_SQL = r"""pt AS (SELECT DISTINCT lower(p_type) AS t FROM part), e1 AS (SELECT t AS class, regexp_replace(t, '\s+\S+$', '') AS parent FROM pt), e2 AS (SELECT parent AS class, regexp_replace(parent, '\s+\S+$', '') AS parent FROM e1),
    pe AS (SELECT * FROM (SELECT * FROM e1 UNION SELECT * FROM e2 UNION SELECT parent, 'product' FROM e2) WHERE class <> parent)"""


def parents(spark: SparkSession, root: str) -> DataFrame:
    up = lambda c: F.regexp_replace(c, r"\s+\S+$", "")
    e1 = read(spark, root, "part").select(F.lower("p_type").alias("class")).distinct().select("class", up("class").alias("parent"))
    e2 = e1.select(F.col("parent").alias("class"), up("parent").alias("parent"))
    return e1.union(e2).union(e2.select(F.col("parent").alias("class"), F.lit("product").alias("parent"))).where("class != parent").distinct()


@query(f"WITH RECURSIVE {PARENTS_SQL}, cl AS (SELECT class, parent AS ancestor, 1 AS level FROM pe UNION SELECT cl.class, pe.parent, level + 1 FROM cl JOIN pe ON pe.class = cl.ancestor) SELECT class, ancestor, min(level)::INT AS level FROM cl WHERE class <> ancestor GROUP BY ALL")
def class_closure(spark, root):
    return graph.class_closure(parents(spark, root))


@query(f"""WITH RECURSIVE {PARENTS_SQL}, cl AS (SELECT class, parent AS ancestor FROM pe UNION SELECT cl.class, pe.parent FROM cl JOIN pe ON pe.class = cl.ancestor),
    n AS (SELECT lower(p_type) AS class, count(*) AS n FROM part GROUP BY 1), s AS (SELECT class, CASE WHEN n <= 10 THEN 1.0 ELSE 1 / log10(n) END AS s FROM n)
    SELECT class, round(min(s), 6) AS score FROM (SELECT * FROM s UNION ALL SELECT ancestor, s FROM cl JOIN s USING (class) WHERE class <> ancestor) GROUP BY class""")
def type_scores(spark, root):
    counts = read(spark, root, "part").groupBy(F.lower("p_type").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return graph.type_scores(counts, graph.class_closure(parents(spark, root)))


KB_SQL = """kl AS (SELECT lower(n_name) AS label, 'nation' || n_nationkey AS entity FROM nation UNION SELECT lower(r_name), 'region' || r_regionkey FROM region),
    kt AS (SELECT 'nation' || n_nationkey AS entity, 'country' AS type FROM nation UNION SELECT 'region' || r_regionkey, 'continent' FROM region UNION SELECT entity, 'place' FROM kl),
    kf AS (SELECT 'nation' || n_nationkey AS subject, 'located in' AS relation, 'region' || n_regionkey AS object FROM nation)"""


def knowledge(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, r = read(spark, root, "nation"), read(spark, root, "region")
    of = lambda t, k: F.concat(F.lit(t), F.col(k))
    kb = n.select(F.lower("n_name").alias("label"), of("nation", "n_nationkey").alias("entity")).union(r.select(F.lower("r_name"), of("region", "r_regionkey"))).distinct()
    types = n.select(of("nation", "n_nationkey").alias("entity"), F.lit("country").alias("type")).union(r.select(of("region", "r_regionkey"), F.lit("continent"))).union(kb.select("entity", F.lit("place"))).distinct()
    return kb, types, n.select(of("nation", "n_nationkey").alias("subject"), F.lit("located in").alias("relation"), of("region", "n_regionkey").alias("object"))


@query(f"""WITH {values_sql()}, {KB_SQL}, h AS (SELECT table_name, column_name, type, count(DISTINCT lower(value)) AS hits FROM cv JOIN kl ON kl.label = lower(value) JOIN kt USING (entity) GROUP BY ALL), z AS (SELECT table_name, column_name, count(*) AS size FROM cv GROUP BY ALL)
    SELECT table_name, column_name, type, round(hits / size, 6) AS score, row_number() OVER (PARTITION BY table_name, column_name ORDER BY round(hits / size, 6) DESC, type)::INT AS rank FROM h JOIN z USING (table_name, column_name)""")
def kb_column_types(spark, root):
    kb, types, _ = knowledge(spark, root)
    return graph.annotate_columns(values(spark, root), kb, types)


PLACES_SQL = "pl AS (SELECT DISTINCT table_name, a, b, x, y FROM (SELECT 'suppliers' AS table_name, 'nation' AS a, 'region' AS b, n_name AS x, r_name AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'customers', 'region', 'nation', r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))"


def places(spark: SparkSession, root: str) -> DataFrame:
    where = read(spark, root, "nation").join(read(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = read(spark, root, "supplier").join(where, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("suppliers").alias("table_name"), F.lit("nation").alias("a"), F.lit("region").alias("b"), F.col("n_name").alias("x"), F.col("r_name").alias("y"))
    c = read(spark, root, "customer").join(where, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("customers"), F.lit("region"), F.lit("nation"), "r_name", "n_name")
    return s.union(c).distinct()


KB_REL_SQL = """wy AS (SELECT table_name, a, b, a AS sc, b AS oc, lower(x) AS sl, lower(y) AS ol FROM pl UNION ALL SELECT table_name, a, b, b, a, lower(y), lower(x) FROM pl), pn AS (SELECT table_name, a, b, count(*) AS n FROM pl GROUP BY ALL),
    kr AS (SELECT table_name, sc AS subject_column, oc AS object_column, relation, round(count(DISTINCT (sl, ol)) / any_value(n), 6) AS score FROM wy JOIN kl s ON s.label = sl JOIN kl o ON o.label = ol JOIN kf ON subject = s.entity AND object = o.entity JOIN pn USING (table_name, a, b) GROUP BY table_name, a, b, sc, oc, relation)"""


@query(f"WITH {KB_SQL}, {PLACES_SQL}, {KB_REL_SQL} SELECT * FROM kr")
def kb_relations(spark, root):
    kb, _, facts = knowledge(spark, root)
    return graph.annotate_relations(places(spark, root), kb, facts)


@query(f"""WITH {KB_SQL}, {PLACES_SQL}, {KB_REL_SQL}, t AS (SELECT table_name AS tn, subject_column || '|' || object_column AS pair, subject_column || '-' || relation || '-' || object_column AS triple, score FROM kr),
    b AS (SELECT q.tn AS q_table, c.tn AS c_table, q.pair, max(q.score * c.score) AS s FROM t q JOIN t c ON q.triple = c.triple AND q.tn <> c.tn GROUP BY ALL) SELECT q_table, c_table, score, row_number() OVER (PARTITION BY q_table ORDER BY score DESC, c_table)::INT AS rank FROM (SELECT q_table, c_table, round(sum(s), 6) AS score FROM b GROUP BY q_table, c_table)""")
def santos_kb_topk(spark, root):
    rel = kb_relations(spark, root)
    return graph.triple_search(rel.withColumn("triple", F.concat_ws("-", "subject_column", "relation", "object_column")), 10)


@query(FD_SQL)
def fd_pairs(spark, root):
    return dependencies(spark, root)


# Measures: nearest vectors against vectors of the same label.

TRUTH_SQL = f"{KNN_SQL}, re AS (SELECT q_id AS query, c_id AS candidate, rank FROM kn WHERE rank <= 10), tr AS (SELECT a.vec_id AS query, b.vec_id AS candidate FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)"
AT_SQL = """ca AS (SELECT DISTINCT query, k FROM (SELECT query FROM re UNION SELECT query FROM tr), (SELECT unnest([1, 5, 10]) AS k)),
    fo AS (SELECT query, k, count(*) AS found, count(tr.candidate) AS tp FROM re LEFT JOIN tr USING (query, candidate), (SELECT unnest([1, 5, 10]) AS k) WHERE rank <= k GROUP BY ALL), wa AS (SELECT query, count(*) AS wanted FROM tr GROUP BY 1),
    ms AS (SELECT query, k, coalesce(tp, 0) AS tp, coalesce(found, 0) - coalesce(tp, 0) AS fp, CASE WHEN coalesce(found, 0) > 0 THEN tp / found WHEN coalesce(wanted, 0) = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN coalesce(wanted, 0) > 0 THEN coalesce(tp, 0) / wanted ELSE 1.0 END AS r FROM ca LEFT JOIN fo USING (query, k) LEFT JOIN wa USING (query)),
    me AS (SELECT query, k, tp, fp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM ms)"""


def retrieval(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, root, "embeddings")
    found = vectors.knn(e, e.where(ASKED), 10).select(F.col("q_id").alias("query"), F.col("c_id").alias("candidate"), "rank")
    q, c = e.where(ASKED).select(F.col("vec_id").alias("query"), "label"), e.select(F.col("vec_id").alias("candidate"), "label")
    return found, q.join(c, "label").where("query != candidate").select("query", "candidate")


@query(f"WITH {TRUTH_SQL}, {AT_SQL} SELECT * FROM me")
def precision_recall_at_k(spark, root):
    return evaluation.at_cutoffs(*retrieval(spark, root), [1, 5, 10])


@query(f"WITH {TRUTH_SQL}, {AT_SQL} SELECT k, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(stddev_pop(precision), 6) AS precision_std FROM me GROUP BY k")
def macro_measures(spark, root):
    return evaluation.macro(evaluation.at_cutoffs(*retrieval(spark, root), [1, 5, 10]))


@query(f"WITH {TRUTH_SQL}, h AS (SELECT query, rank, count(*) OVER (PARTITION BY query ORDER BY rank) AS seen FROM re JOIN tr USING (query, candidate)), s AS (SELECT query, sum(seen / rank) AS s FROM h GROUP BY 1) SELECT query, round(coalesce(s, 0) / count(*), 6) AS ap FROM tr LEFT JOIN s USING (query) GROUP BY query, s")
def map_at_k(spark, root):
    return evaluation.average_precision(*retrieval(spark, root))


H32 = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


@query(f"""SELECT table_name, column_name, sentence, CASE WHEN {H32.format("'augment:' || table_name || ':' || column_name")} % 5 < 1 THEN array_to_string(list_transform(list_sort(list_transform(range(1, len(string_split(sentence, ' ')) + 1),
    lambda i: {{'k': md5(string_split(sentence, ' ')[i] || ':' || i || ':7'), 'w': string_split(sentence, ' ')[i]}})), lambda x: x.w), ' ') ELSE sentence END AS augmented,
    CASE WHEN {H32.format("'part:' || table_name || ':' || column_name")} % 10 < 8 THEN 'train' ELSE 'dev' END AS part FROM ({SQL["column_sentence"]})""")
def training_texts(spark, root):
    return similarity.training_texts(column_sentence(spark, root))


@query(f"""WITH mn AS (SELECT [{', '.join(f'avg(embedding[{i}]::DOUBLE)' for i in range(1, 49))}] AS m FROM embeddings), tv AS (SELECT vec_id, list_transform(range(1, 49), lambda i: embedding[i]::DOUBLE - m[i]) AS a, embedding[49:64]::DOUBLE[] AS b FROM embeddings, mn),
    sc AS (SELECT x.vec_id AS q_id, y.vec_id AS c_id, round((list_cosine_similarity(x.a, y.a) + list_cosine_similarity(x.b, y.b)) / 2, 6) AS score FROM tv x JOIN tv y ON x.vec_id <> y.vec_id AND x.vec_id % 20 = 0)
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id)::INT AS rank FROM sc QUALIFY rank <= 10""")
def two_part_knn(spark, root):
    v = vectors.two_part_vectors(read(spark, root, "embeddings"), 48, 64)
    return vectors.knn(v, v.where(ASKED), 10)
