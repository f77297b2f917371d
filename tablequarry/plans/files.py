"""Named queries that write the sinks and read the sources, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets
from ..sources import lake
from ..sources.store import scratch_path
from .catalog import COLUMNS, values, values_sql
from .queries import SQL, overlap_topk, query, read

CSV_TABLES = ["region", "nation", "supplier", "part"]


@query(f"WITH {values_sql({t: COLUMNS[t] for t in CSV_TABLES})} SELECT * FROM cv")
def csv_cells(spark, root):
    """Tables as folders of CSV files, read in one scan."""
    path = scratch_path(spark, "csv")
    for t in CSV_TABLES:
        read(spark, root, t).select(*COLUMNS[t]).write.option("header", True).csv(f"{path}/{t}")
    found = lake.csv_cells(spark, path).where("value is not null")
    return found.groupBy(F.element_at(F.split("table_name", "/"), 1).alias("table_name"), "column_name", "value").agg(F.count(F.lit(1)).alias("freq"))


@query(f"WITH {values_sql({t: COLUMNS[t] for t in CSV_TABLES})} SELECT table_name, column_name, count(value) AS n_nonnull, count(DISTINCT value) AS n_distinct FROM cells GROUP BY ALL")
def csv_counts(spark, root):
    """The same tables, each by a reader of its own."""
    path = scratch_path(spark, "csv")
    for t in CSV_TABLES:
        read(spark, root, t).select(*COLUMNS[t]).write.option("header", True).csv(f"{path}/{t}")
    return lake.csv_lake(spark, {t: f"{path}/{t}" for t in CSV_TABLES}).counts()


@query("SELECT 'nation' || n_nationkey AS subject, 'located_in' AS predicate, 'region' || n_regionkey AS object FROM nation")
def n_triples(spark, root):
    path = scratch_path(spark, "triples")
    uri = lambda *c: F.concat(F.lit("<http://kb.example/"), *c, F.lit(">"))
    line = F.concat_ws("\t", uri(F.lit("Nation"), "n_nationkey"), uri(F.lit("located_in")), uri(F.lit("Region"), "n_regionkey"))
    read(spark, root, "nation").select(F.concat(line, F.lit(" .")).alias("value")).write.text(path)
    return lake.triples(spark, path)


@query("SELECT 'region' || n_regionkey AS table_name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS row_id, n_nationkey || '|' || n_name AS cells FROM nation")
def web_tables(spark, root):
    """One table a region, as JSON objects of columns."""
    path = scratch_path(spark, "json")
    listed = read(spark, root, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    columns = F.array(F.col("rows.n_nationkey").cast("array<string>"), F.col("rows.n_name"))
    listed.select(F.to_json(F.struct(F.concat(F.lit("region"), "n_regionkey").alias("title"), columns.alias("relation"))).alias("value")).write.text(path)
    return lake.json_tables(spark, path).withColumn("cells", F.array_join("cells", "|"))


CUTOFFS = [1, 5, 10]


@query(f"SELECT k, o.* FROM ({SQL['overlap_topk']}) o, (SELECT unnest({CUTOFFS})::INT AS k) WHERE rank <= k")
def ranked_files(spark, root):
    """One ranking written for several k at once, and read back."""
    path = scratch_path(spark, "ranked")
    lake.save_ranked(overlap_topk(spark, root), path, CUTOFFS, fmt="parquet")
    return spark.read.parquet(path)


@query(f"WITH {values_sql()} SELECT value, count(*) AS frequency FROM cv GROUP BY value HAVING count(*) > 1")
def saved_index(spark, root):
    """Posting lists written as an index, and the values of several columns looked up in it."""
    path = scratch_path(spark, "index")
    lake.save_index(sets.posting_lists(values(spark, root)), path)
    return lake.load_index(spark, path).where("frequency > 1").select("value", "frequency")


H32 = "('0x' || substr(md5(table_name), 1, 8))::BIGINT"


@query(f"WITH {values_sql()} SELECT DISTINCT table_name, ({H32} % 4)::INT AS part, table_name IN (SELECT table_name FROM (SELECT DISTINCT table_name FROM cv) ORDER BY md5(table_name), table_name LIMIT 5) AS sampled FROM cv")
def lake_parts(spark, root):
    """Whole tables dealt into parts, and a sample of five tables."""
    v = values(spark, root)
    chosen = lake.sampled_count(v, 5).select("table_name").distinct().withColumn("sampled", F.lit(True))
    return lake.partitioned(v, 4).select("table_name", "part").distinct().join(chosen, "table_name", "left").select("table_name", "part", F.coalesce("sampled", F.lit(False)).alias("sampled"))
