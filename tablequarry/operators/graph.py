"""Column graphs, personalised PageRank, holistic scores, class hierarchies and what a knowledge base tells of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.store import cut
from .sets import ranked

#: Between a table and its column in a node's name: no name has it.
OF = "\u001f"
#: Iterations between cuts.
CUT_EVERY = 4


def column_graph(value_similarity: DataFrame, name_similarity: DataFrame, widths: DataFrame, least: float) -> DataFrame:
    """(src, dst, weight): columns whose mean of value, name and width similarity is at least `least`.

    Similarities: (q_table, q_column, c_table, c_column, score); widths: (table_name, column_name,
    width), the mean length of values. Nodes are named by table and column, OF between.
    """
    key = ["q_table", "q_column", "c_table", "c_column"]
    both = value_similarity.select(*key, F.col("score").alias("v")).join(name_similarity.select(*key, F.col("score").alias("n")), key, "full_outer")
    side = lambda p: widths.select(F.col("table_name").alias(f"{p}_table"), F.col("column_name").alias(f"{p}_column"), F.col("width").alias(f"w{p}"))
    both = both.join(side("q"), ["q_table", "q_column"]).join(side("c"), ["c_table", "c_column"])
    width = F.least("wq", "wc") / F.greatest("wq", "wc")
    weight = F.round((F.coalesce("v", F.lit(0.0)) + F.coalesce("n", F.lit(0.0)) + width) / 3, 6)
    return both.select(F.concat_ws(OF, "q_table", "q_column").alias("src"), F.concat_ws(OF, "c_table", "c_column").alias("dst"), weight.alias("weight")).where(F.col("weight") >= least)


def pagerank(edges: DataFrame, sources: DataFrame, *, reset: float = 0.3, iterations: int = 20) -> DataFrame:
    """(source, node, score): personalised PageRank by power iteration, all sources at once.

    Every iteration is a join with the edges and a sum, which combines before its shuffle; every
    CUT_EVERY of them are cut. After n iterations (1 - reset) ** n of the mass may still be on its
    way: 0.08 % after 20. A node without edges returns its mass to nobody.
    """
    edges = cut(edges)
    total = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    step = cut(edges.join(total, "src").select(F.col("src").alias("node"), "dst", (F.col("weight") / F.col("all")).alias("p")))
    start = sources.select(F.col("source"), F.col("source").alias("node"), F.lit(1.0).alias("score"))
    now = start = cut(start)
    for k in range(1, iterations + 1):
        moved = now.join(step, "node").select("source", F.col("dst").alias("node"), (F.col("score") * F.col("p") * (1 - reset)).alias("score"))
        now = moved.union(start.select("source", "node", F.lit(reset).alias("score"))).groupBy("source", "node").agg(F.sum("score").alias("score"))
        now = cut(now) if k % CUT_EVERY == 0 else now
    return now


def holistic(direct: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """(source, node, score, rank): over direct matches d of a column, the sum of their weights times pagerank(d -> node).

    direct: (source, node, weight); ranks: as pagerank gives.
    """
    d = direct.select("source", F.col("node").alias("via"), "weight")
    r = ranks.select(F.col("source").alias("via"), "node", "score")
    summed = d.join(r, "via").where("source != node").groupBy("source", "node").agg(F.sum(F.col("weight") * F.col("score")).alias("s"))
    return ranked(summed, F.round("s", 6), k, by=["source"], then=["node"]).select("source", "node", "score", "rank")


def class_closure(edges: DataFrame) -> DataFrame:
    """(class, ancestor, level) from (class, parent): all ancestors with their least distance; cycles end by themselves."""
    edges = cut(edges.select("class", "parent"))
    found = cut(edges.select("class", F.col("parent").alias("ancestor"), F.lit(1).alias("level")).where(F.col("class") != F.col("ancestor")).distinct())
    front, level = found, 1
    while True:
        level += 1
        up = edges.select(F.col("class").alias("ancestor"), F.col("parent"))
        front = front.join(up, "ancestor").select("class", F.col("parent").alias("ancestor"), F.lit(level).alias("level")).where("class != ancestor").distinct()
        front = cut(front.join(found.select("class", "ancestor"), ["class", "ancestor"], "left_anti"))
        if front.isEmpty():
            return found
        found = found.union(front)


def type_scores(counts: DataFrame, closure: DataFrame) -> DataFrame:
    """(class, score): the least of min(1, 1 / log10(count)) over a class and all below it. counts: (class, n)."""
    own = counts.select("class", F.when(F.col("n") <= 10, F.lit(1.0)).otherwise(1 / F.log10("n")).alias("s"))
    below = closure.join(own, "class").select(F.col("ancestor").alias("class"), "s")
    return own.union(below).groupBy("class").agg(F.round(F.min("s"), 6).alias("score"))


def annotate_columns(values: DataFrame, labels: DataFrame, types: DataFrame) -> DataFrame:
    """(table_name, column_name, type, score, rank) by a knowledge base: the share of a column's values that have an entity of the type.

    labels: (label, entity), label in lower case; types: (entity, type).
    """
    known = values.select("table_name", "column_name", F.lower("value").alias("label")).distinct().join(labels, "label").join(types, "entity")
    hits = known.groupBy("table_name", "column_name", "type").agg(F.count_distinct("label").alias("hits"))
    sizes = values.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("table_name", "column_name").orderBy(F.desc("score"), "type")
    return hits.join(sizes, ["table_name", "column_name"]).select("table_name", "column_name", "type", F.round(F.col("hits") / F.col("size"), 6).alias("score")).withColumn("rank", F.row_number().over(w))


def annotate_relations(pairs: DataFrame, labels: DataFrame, facts: DataFrame) -> DataFrame:
    """(table_name, subject_column, object_column, relation, score): the share of a column pair's rows that a relation joins, either way round.

    pairs: (table_name, a, b, x, y), distinct value pairs; facts: (subject, relation, object).
    """
    total = pairs.groupBy("table_name", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    s, o = labels.select(F.col("label").alias("sl"), F.col("entity").alias("subject")), labels.select(F.col("label").alias("ol"), F.col("entity").alias("object"))
    ways = pairs.select("table_name", "a", "b", F.col("a").alias("sc"), F.col("b").alias("oc"), F.lower("x").alias("sl"), F.lower("y").alias("ol")).union(pairs.select("table_name", "a", "b", F.col("b"), F.col("a"), F.lower("y"), F.lower("x")))
    hits = ways.join(s, "sl").join(o, "ol").join(facts, ["subject", "object"]).groupBy("table_name", "a", "b", "sc", "oc", "relation").agg(F.count_distinct("sl", "ol").alias("hits"))
    return hits.join(total, ["table_name", "a", "b"]).select("table_name", F.col("sc").alias("subject_column"), F.col("oc").alias("object_column"), "relation", F.round(F.col("hits") / F.col("n"), 6).alias("score"))


def column_semantics(values: DataFrame, labels: DataFrame, types: DataFrame, tops: DataFrame, penalties: DataFrame | None = None) -> DataFrame:
    """(table_name, column_name, type, score): a column's types below the top type that most of its known values have.

    The score is the share of the column's known values with the type; on the lake's side it is
    multiplied by the type's penalty. tops: (top, type), each type below a top type, itself
    included; penalties: (type, penalty), 1 where absent.
    """
    known = cut(values.select("table_name", "column_name", F.lower("value").alias("label")).distinct().join(labels, "label").join(types, "entity").select("table_name", "column_name", "label", "type").distinct())
    by = ["table_name", "column_name"]
    found = known.groupBy(*by).agg(F.count_distinct("label").alias("found"))
    best = known.join(tops, "type").groupBy(*by, "top").agg(F.count_distinct("label").alias("n")).groupBy(*by).agg(F.min_by("top", F.struct(-F.col("n"), "top")).alias("top"))
    scored = known.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n")).join(best, by).join(tops, ["top", "type"], "left_semi").join(found, by).select(*by, "type", (F.col("n") / F.col("found")).alias("s"))
    if penalties is not None:
        scored = scored.join(penalties, "type", "left").withColumn("s", F.col("s") * F.coalesce("penalty", F.lit(1.0)))
    return scored.select(*by, "type", F.round("s", 6).alias("score"))


def table_triples(semantics: DataFrame, relations: DataFrame) -> DataFrame:
    """(table_name, subject_column, object_column, triple, score): types of both columns and the relation between, their scores multiplied.

    semantics: as column_semantics gives; relations: as annotate_relations gives.
    """
    side = lambda p: semantics.select("table_name", F.col("column_name").alias(f"{p}_column"), F.col("type").alias(f"{p}_type"), F.col("score").alias(f"{p}_score"))
    both = relations.join(side("subject"), ["table_name", "subject_column"]).join(side("object"), ["table_name", "object_column"])
    return both.select("table_name", "subject_column", "object_column", F.struct(F.col("subject_type").alias("subject"), "relation", F.col("object_type").alias("object")).alias("triple"), F.round(F.col("subject_score") * F.col("score") * F.col("object_score"), 6).alias("score"))


def with_intent(found: DataFrame, intent: DataFrame, semantics: DataFrame) -> DataFrame:
    """Rows (q_table, c_table, ...) whose candidate has a column of a type of the query's intent column.

    intent: (q_table, type). A query none of whose candidates has such a column keeps all.
    """
    has = intent.join(semantics.select(F.col("table_name").alias("c_table"), "type").distinct(), "type").select("q_table", "c_table").distinct()
    held = found.join(has, ["q_table", "c_table"], "left_semi")
    others = found.join(held.select("q_table").distinct(), "q_table", "left_anti")
    return held.unionByName(others)


def entity_matches(values: DataFrame, labels: DataFrame, k: int = 3, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(value, entity, score, rank): the k entities whose label holds every word of a value, by BM25.

    labels: (label, entity). A value meets labels by its rarest word alone, and the labels found
    are then compared in full; values with a word that no label has, or with more words than any
    label, meet none.
    """
    words = lambda c: F.array_distinct(text.tokens(F.col(c)))
    known = cut(labels.select("entity", text.tokens(F.col("label")).alias("all"), words("label").alias("words")).where(F.size("all") > 0))
    posted = known.select("entity", "all", F.explode("words").alias("word"))
    facts = known.agg(F.count(F.lit(1)).alias("entities"), F.avg(F.size("all")).alias("mean"), F.max(F.size("words")).alias("most"))
    idf = F.ln((F.col("entities") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    df = posted.groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(facts.select("entities")))  # facts: one row
    weights = df.select("word", "df", idf.alias("idf"))
    asked = values.select("value").distinct().select("value", words("value").alias("words")).join(F.broadcast(facts.select("most"))).where((F.size("words") > 0) & (F.size("words") <= F.col("most")))
    each = asked.select("value", F.size("words").alias("n"), F.explode("words").alias("word")).join(weights, "word")
    probes = each.groupBy("value", "n").agg(F.sort_array(F.collect_list(F.struct("df", "word", "idf"))).alias("ws")).where(F.size("ws") == F.col("n"))
    met = probes.withColumn("word", F.col("ws")[0]["word"]).join(posted, "word").where(F.forall("ws", lambda w: F.array_contains("all", w["word"]))).join(F.broadcast(facts.select("mean")))
    tf = lambda w: F.size(F.filter("all", lambda x: x == w["word"]))
    score = F.aggregate("ws", F.lit(0.0), lambda s, w: s + w["idf"] * tf(w) * (k1 + 1) / (tf(w) + k1 * (1 - b + b * F.size("all") / F.col("mean"))))
    return ranked(met, F.round(score, 6), k, by=["value"], then=["entity"]).select("value", "entity", "score", "rank")


def column_classes(values: DataFrame, matches: DataFrame, types: DataFrame) -> DataFrame:
    """(table_name, column_name, class, n): the classes of the entities that a column's rows match, each as often as its value occurs."""
    of = matches.select("value", "entity").join(types.select("entity", F.col("type").alias("class")).distinct(), "entity")
    return values.join(of, "value").groupBy("table_name", "column_name", "class").agg(F.sum("freq").cast("long").alias("n"))


def majority_classes(classes: DataFrame) -> DataFrame:
    """A column's most frequent classes, all of equals, as its values: (table_name, column_name, value, freq)."""
    w = Window.partitionBy("table_name", "column_name").orderBy(F.desc("n"))
    return classes.withColumn("r", F.rank().over(w)).where("r = 1").select("table_name", "column_name", F.col("class").alias("value"), F.col("n").alias("freq"))


def triple_scores(semantics: DataFrame, lake: DataFrame | None = None) -> DataFrame:
    """(q_table, c_table, score) of tables that tell the same triples: the best product of scores per query column pair, summed.

    semantics: (table_name, subject_column, object_column, triple, score); lake: the same on the
    candidates' side, where its scores differ.
    """
    q = semantics.select(F.col("table_name").alias("q_table"), F.concat_ws(OF, "subject_column", "object_column").alias("pair"), "triple", F.col("score").alias("sq"))
    c = (semantics if lake is None else lake).select(F.col("table_name").alias("c_table"), "triple", F.col("score").alias("sc"))
    best = q.join(c, "triple").where("q_table != c_table").groupBy("q_table", "c_table", "pair").agg(F.max(F.col("sq") * F.col("sc")).alias("s"))
    return best.groupBy("q_table", "c_table").agg(F.round(F.sum("s"), 6).alias("score"))


def triple_search(semantics: DataFrame, k: int) -> DataFrame:
    """The k best tables of each by triple_scores: (q_table, c_table, score, rank)."""
    return ranked(triple_scores(semantics), F.col("score"), k, by=["q_table"], then=["c_table"]).select("q_table", "c_table", "score", "rank")
