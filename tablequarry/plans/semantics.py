"""Named queries of meaning: entities, classes, triples with an intent column, embedding evidence, relation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, sets, similarity, tables
from ..sources.store import cut, stored
from .catalog import OVERLAPS_SQL, TEXT, of_columns, top_sql, values, values_sql
from .queries import EVIDENCE, EVIDENCE_SQL, HYPER_SQL, KB_REL_SQL, KB_SQL, PAIR_SQL, PLACES_SQL, REL_OVERLAP, RELATIONS_SQL, SQL, TOKEN_SQL, evidence, kb_relations, knowledge, places, query, read, relation_pairs, synth_column_semantics

# Products beside places: each part's name and type is an entity.

PRODUCTS_SQL = f"""{KB_SQL}, al AS (SELECT * FROM kl UNION SELECT lower(p_name), 'part:' || lower(p_name) FROM part UNION SELECT lower(p_type), 'type:' || lower(p_type) FROM part),
    tp AS (SELECT * FROM kt UNION SELECT 'part:' || lower(p_name), 'product' FROM part UNION SELECT 'part:' || lower(p_name), split_part(lower(p_name), ' ', -1) FROM part UNION SELECT 'type:' || lower(p_type), 'line' FROM part)"""


def products(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(labels, types) of places and products."""
    labels, types, _ = knowledge(spark, root)
    part = read(spark, root, "part").select(F.lower("p_name").alias("n"), F.lower("p_type").alias("t"))
    name, line = F.concat(F.lit("part:"), "n"), F.concat(F.lit("type:"), "t")
    labels = labels.union(part.select("n", name)).union(part.select("t", line)).distinct()
    types = types.union(part.select(name, F.lit("product"))).union(part.select(name, F.element_at(F.split("n", " "), -1))).union(part.select(line, F.lit("line"))).distinct()
    return labels, types


MATCH_SQL = f"""{PRODUCTS_SQL}, lw AS (SELECT entity, regexp_extract_all(label, '[a-z0-9]+') AS ws FROM al WHERE regexp_matches(label, '[a-z0-9]')),
    wd AS (SELECT word, count(*) AS df FROM (SELECT entity, ws, unnest(list_distinct(ws)) AS word FROM lw) GROUP BY 1), ft AS (SELECT count(*) AS entities, avg(len(ws)) AS mean FROM lw),
    vw AS (SELECT value, list_distinct(regexp_extract_all(lower(value), '[a-z0-9]+')) AS ws FROM (SELECT DISTINCT value FROM cv)),
    me AS (SELECT value, entity, round(sum(ln((entities - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
        FROM (SELECT v.value, l.entity, len(l.ws) AS n, w.word, len(list_filter(l.ws, lambda x: x = w.word)) AS tf, entities, mean, l.ws AS lws, len(v.ws) AS asked
            FROM (SELECT value, ws, unnest(ws) AS word FROM vw) w JOIN vw v USING (value) JOIN (SELECT entity, ws, unnest(list_distinct(ws)) AS word FROM lw) l ON l.word = w.word, ft) JOIN wd USING (word)
        GROUP BY value, entity, lws HAVING count(*) = any_value(asked)),
    em AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, entity)::INT AS rank FROM me QUALIFY rank <= 3)"""


def matches(spark: SparkSession, root: str) -> DataFrame:
    return graph.entity_matches(values(spark, root), products(spark, root)[0])


@query(f"WITH {values_sql()}, {MATCH_SQL} SELECT * FROM em")
def entity_matches(spark, root):
    """The three entities that each value of the lake names best."""
    return matches(spark, root)


CLASS_SQL = f"{MATCH_SQL}, cc AS (SELECT table_name, column_name, type AS class, sum(freq)::BIGINT AS n FROM lv JOIN em USING (value) JOIN tp USING (entity) GROUP BY ALL)"
LV_SQL = values_sql().replace("cv AS (", "lv AS (")


@query(f"WITH {LV_SQL}, {CLASS_SQL.replace('FROM cv', 'FROM lv')} SELECT * FROM cc")
def column_classes(spark, root):
    return graph.column_classes(values(spark, root), matches(spark, root), products(spark, root)[1])


@query(f"WITH {LV_SQL}, {CLASS_SQL.replace('FROM cv', 'FROM lv')}, cv AS (SELECT table_name, column_name, class AS value, n AS freq FROM cc QUALIFY rank() OVER (PARTITION BY table_name, column_name ORDER BY n DESC) = 1), {OVERLAPS_SQL}, {HYPER_SQL}")
def semantic_unionability(spark, root):
    """The hypergeometric score of columns' dominant classes."""
    return tables.set_unionability(sets.overlaps(graph.majority_classes(column_classes(spark, root))))


# Triples of column types and relations.

TOPS = [("place", "place"), ("place", "country"), ("place", "continent")]
TRIPLE_SQL = f"""{KB_SQL}, {PLACES_SQL}, {KB_REL_SQL}, pv AS (SELECT DISTINCT table_name, a AS column_name, x AS value FROM pl UNION SELECT table_name, b, y FROM pl), tops(top, type) AS (VALUES {', '.join(map(repr, TOPS))}),
    kn AS (SELECT DISTINCT table_name, column_name, lower(value) AS label, type FROM pv JOIN kl ON kl.label = lower(value) JOIN kt USING (entity)), fn AS (SELECT table_name, column_name, count(DISTINCT label) AS found FROM kn GROUP BY ALL),
    bt AS (SELECT table_name, column_name, arg_min(top, (-n, top)) AS top FROM (SELECT table_name, column_name, top, count(DISTINCT label) AS n FROM kn JOIN tops USING (type) GROUP BY ALL) GROUP BY ALL),
    cs AS (SELECT table_name, column_name, type, round(count(*) / any_value(found), 6) AS score FROM kn JOIN bt USING (table_name, column_name) JOIN tops USING (top, type) JOIN fn USING (table_name, column_name) GROUP BY ALL),
    cl AS (SELECT table_name, column_name, type, round(score * CASE type WHEN 'place' THEN 0.5 ELSE 1.0 END, 6) AS score FROM cs),"""
TRIPLES = "SELECT table_name, subject_column, object_column, (s.type, relation, o.type) AS triple, round(s.score * kr.score * o.score, 6) AS score FROM kr JOIN {0} s USING (table_name) JOIN {0} o USING (table_name) WHERE s.column_name = subject_column AND o.column_name = object_column"


def place_values(spark: SparkSession, root: str) -> DataFrame:
    p = places(spark, root)
    return p.select("table_name", F.col("a").alias("column_name"), F.col("x").alias("value")).union(p.select("table_name", "b", "y")).distinct()


def meanings(spark: SparkSession, root: str, penalised: bool) -> DataFrame:
    """Types of the places' columns; on the lake's side the broadest type counts half."""
    labels, types, _ = knowledge(spark, root)
    tops = spark.createDataFrame(TOPS, "top string, type string")
    penalties = spark.createDataFrame([("place", 0.5)], "type string, penalty double") if penalised else None
    return graph.column_semantics(place_values(spark, root), labels, types, tops, penalties)


@query(f"WITH {TRIPLE_SQL} x AS (SELECT 1) SELECT * FROM cl")
def column_semantics(spark, root):
    return meanings(spark, root, True)


@query(f"""WITH {TRIPLE_SQL} tq AS ({TRIPLES.format('cs')}), tc AS ({TRIPLES.format('cl')}),
    b AS (SELECT q.table_name AS q_table, c.table_name AS c_table, q.subject_column, q.object_column, max(q.score * c.score) AS s FROM tq q JOIN tc c ON q.triple = c.triple AND q.table_name <> c.table_name GROUP BY ALL),
    sc AS (SELECT q_table, c_table, round(sum(s), 6) AS score FROM b GROUP BY ALL), hi AS (SELECT DISTINCT i.table_name AS q_table, l.table_name AS c_table FROM cs i JOIN cl l USING (type) WHERE i.column_name = 'nation'),
    kp AS (SELECT * FROM sc WHERE (q_table, c_table) IN (SELECT (q_table, c_table) FROM hi) OR q_table NOT IN (SELECT q_table FROM sc JOIN hi USING (q_table, c_table)))
    SELECT *, row_number() OVER (PARTITION BY q_table ORDER BY score DESC, c_table)::INT AS rank FROM kp QUALIFY rank <= 10""")
def santos_intent_topk(spark, root):
    """Tables of the same triples that also have a column of the type of the query's nation column."""
    relations = kb_relations(spark, root)
    asked, lake = (meanings(spark, root, p) for p in (False, True))
    found = graph.triple_scores(graph.table_triples(asked, relations), graph.table_triples(lake, relations))
    intent = asked.where("column_name = 'nation'").select(F.col("table_name").alias("q_table"), "type")
    return sets.ranked(graph.with_intent(found, intent, lake), F.col("score"), 10, by=["q_table"], then=["c_table"]).select("q_table", "c_table", "score", "rank")


@query(f"""WITH {RELATIONS_SQL}, {REL_OVERLAP}, rs AS (SELECT ro.*, overlap / z.size AS rel_c, split_part(q_column, chr(31), 1) AS q1, split_part(q_column, chr(31), 2) AS q2, split_part(c_column, chr(31), 1) AS c1, split_part(c_column, chr(31), 2) AS c2 FROM ro JOIN rz z ON z.table_name = c_table AND z.column_name = c_column),
    ss AS ({SQL['synth_column_semantics']}), ww AS (SELECT {PAIR_SQL}, max(a.share * b.share) AS m FROM ss a JOIN ss b ON a.label_table = b.label_table AND a.label_column = b.label_column GROUP BY ALL),
    fo AS (SELECT r.*, q.qc, c.cc FROM rs r, LATERAL (SELECT unnest([q1, q2]) AS qc) q, LATERAL (SELECT unnest([c1, c2]) AS cc) c),
    fm AS (SELECT fo.q_table, fo.q_column, fo.c_table, fo.c_column, rel * rel_c AS rel, list_reverse_sort(list(coalesce(m, 0.0))) AS ms FROM fo LEFT JOIN ww ON ww.q_table = fo.q_table AND ww.c_table = fo.c_table AND ww.q_column = qc AND ww.c_column = cc GROUP BY ALL),
    b AS (SELECT q_table, c_table, q_column, max(rel * ms[1] * ms[2]) AS s FROM fm GROUP BY ALL)
    SELECT q_table, c_table, score, row_number() OVER (PARTITION BY q_table ORDER BY score DESC, c_table)::INT AS rank FROM (SELECT q_table, c_table, round(sum(s), 6) AS score FROM b GROUP BY q_table, c_table) QUALIFY rank <= 5""")
def santos_relation_topk(spark, root):
    return tables.relation_column_search(synth_column_semantics(spark, root), relation_pairs(spark, root), 5)


# Embedding evidence. Hashes of words stand for trained vectors here, so only equal words bring columns near, and 0.2 is asked.

DIM = 32
EMBEDDED_SQL = f"""wv AS (SELECT item, [{', '.join(f"('0x' || substr(md5(item), {i}, 1))::INT - 7.5" for i in range(1, DIM + 1))}]::DOUBLE[] AS vector FROM (SELECT DISTINCT item FROM tf)),
    mv AS (SELECT table_name, column_name, [{', '.join(f'avg(vector[{i}])' for i in range(1, DIM + 1))}] AS m FROM tf JOIN wv USING (item) GROUP BY ALL),
    sb AS (SELECT {PAIR_SQL}, round(list_cosine_similarity(a.m, b.m), 6) AS score FROM mv a JOIN mv b ON (a.table_name <> b.table_name OR a.column_name <> b.column_name) WHERE round(list_cosine_similarity(a.m, b.m), 6) >= 0.2)"""


def embedded(spark: SparkSession, root: str, tokens: DataFrame | None = None) -> DataFrame:
    """tokens: the whole lake's token features where they are stored already; a column's do not depend on the others."""
    features = stored(similarity.token_features(values(spark, root, TEXT)), "features") if tokens is None else of_columns(tokens, TEXT)
    return similarity.embedding_similarity(features, similarity.hashed_word_vectors(features, DIM), 0.2, DIM)


@query(f"WITH {values_sql(TEXT)}, {TOKEN_SQL}, {EMBEDDED_SQL} SELECT * FROM sb")
def embedding_evidence(spark, root):
    return embedded(spark, root)


FIVE = [*EVIDENCE, "embedding"]


@query(f"""WITH four AS ({EVIDENCE_SQL} SELECT * FROM ev), fifth AS (WITH {values_sql(TEXT)}, {TOKEN_SQL}, {EMBEDDED_SQL} SELECT * FROM sb),
    e5 AS (SELECT q_table, q_column, c_table, c_column, {', '.join(f'coalesce({k}, 0.0) AS {k}' for k in EVIDENCE)}, coalesce(score, 0.0) AS embedding FROM four FULL JOIN fifth USING (q_table, q_column, c_table, c_column))
    {top_sql(f"round((((({EVIDENCE[0]} + {EVIDENCE[1]}) + {EVIDENCE[2]}) + {EVIDENCE[3]}) + embedding) / 5, 8)", 10, 'e5', 'q_table <> c_table')}""")
def d3l_five_column_query(spark, root):
    """The column query over all five kinds of evidence."""
    tokens = stored(similarity.token_features(values(spark, root)), "features")
    four = cut(evidence(spark, root, tokens))  # read once for each kind
    parts = {k: four.select(*sets.PAIR, F.col(k).alias("score")) for k in EVIDENCE}
    return similarity.column_query(similarity.evidence(parts | {"embedding": embedded(spark, root, tokens)}), FIVE, 10)
