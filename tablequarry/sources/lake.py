"""A lake is a set of named tables; every search runs on its cells or its columns' value sets."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unused(columns: Iterable[str], stem: str) -> str:
    """A column name that none of `columns` has, whatever the case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


class Lake:
    """Named DataFrames with the columns that take part.

    cells(): (table_name, column_name, value) of every row, null values included.
    column_values(): (table_name, column_name, value, freq), the distinct non-null values.
    Values are strings. Each table is scanned once, whatever the number of its columns.
    """

    def __init__(self, tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None):
        if not tables:
            raise ValueError("a lake needs a table")
        self.tables = tables
        self.columns = columns or {name: list(df.columns) for name, df in tables.items()}

    def cells(self) -> DataFrame:
        def flat(name: str) -> DataFrame:
            each = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in self.columns[name]]
            return self.tables[name].select(F.lit(name).alias("table_name"), F.explode(F.array(*each)).alias("x")).select("table_name", "x.*")

        return reduce(DataFrame.unionByName, map(flat, self.columns))

    def column_values(self) -> DataFrame:
        return self.cells().where("value is not null").groupBy("table_name", "column_name", "value").agg(F.count(F.lit(1)).alias("freq"))

    def counts(self) -> DataFrame:
        """(table_name, column_name, n_nonnull, n_distinct) of every column, in one pass."""
        return self.cells().groupBy("table_name", "column_name").agg(F.count("value").alias("n_nonnull"), F.count_distinct("value").alias("n_distinct"))

    def restricted(self, wanted: dict[str, list[str]]) -> Lake:
        return Lake({t: self.tables[t] for t in wanted}, wanted)


def parquet_lake(spark: SparkSession, root: str, columns: dict[str, list[str]]) -> Lake:
    return Lake({t: spark.read.parquet(f"{root}/{t}.parquet").select(*c) for t, c in columns.items()}, columns)


def _wanted(name: str, skip: Iterable[str]) -> bool:
    """Whether a table takes part: its last name is none of `skip`."""
    return name.rsplit("/", 1)[-1] not in set(skip)


def csv_lake(spark: SparkSession, paths: dict[str, str], *, encoding: str = "UTF-8", skip: Iterable[str] = ("groundtruth",), sep: str = ",", head: int | None = None) -> Lake:
    """CSV files with a header line each, as strings; malformed lines are dropped.

    head: the first so many rows of each file, in the file's order.
    """
    tables = {}
    for name, path in paths.items():
        if not _wanted(name, skip):
            continue
        df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, mode="DROPMALFORMED", inferSchema=False)
        if head is not None:
            # A file's rows come in its order within a part, and parts in theirs.
            at = unused(df.columns, "_at")
            df = df.withColumn(at, F.monotonically_increasing_id()).orderBy(at).limit(head).drop(at)
        tables[name] = df
    return Lake(tables)


def csv_paths(spark: SparkSession, root: str, *, skip: Iterable[str] = ("groundtruth", "small_join", "large_join")) -> dict[str, str]:
    """Table name -> path of the CSV files below a root, listed by Spark's own readers, so that any store will do.

    A table's name is its path below the root without `.csv`, so files of one name in several folders stay apart.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(root).select("path").collect()
    below = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    names = {re.sub("^file:/+", "/", r.path).removeprefix(below).removesuffix(".csv"): r.path for r in listed}
    return {n: p for n, p in sorted(names.items()) if _wanted(n, skip)}


def csv_cells(spark: SparkSession, root: str, *, encoding: str = "UTF-8", skip: Iterable[str] = ("groundtruth", "small_join", "large_join"), sep: str = ",") -> DataFrame:
    """(table_name, column_name, value) of all CSV files below a root in one scan, however many there are.

    Tables are named by their paths. A file is one task's text, parsed as one document, so quoted
    line breaks stay in their cells; rows with more or fewer fields than the header are dropped.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(root).select("path", "content")
    below = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    leave = set(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = re.sub("^file:/+", "/", path).removeprefix(below).removesuffix(".csv")
                if name.rsplit("/", 1)[-1] in leave:
                    continue
                rows = csv.reader(io.StringIO(content.decode(encoding, errors="replace"), newline=""), delimiter=sep)
                header = next(rows, None)
                held: list[list] = [[], []]
                for row in rows:
                    if len(row) != len(header):
                        continue
                    held[0] += header
                    held[1] += [x if x != "" else None for x in row]
                    if len(held[0]) >= 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(held[0])), pa.array(held[0], pa.string()), pa.array(held[1], pa.string())], ["table_name", "column_name", "value"])
                        held = [[], []]
                if held[0]:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(held[0])), pa.array(held[0], pa.string()), pa.array(held[1], pa.string())], ["table_name", "column_name", "value"])

    return files.mapInArrow(run, "table_name string, column_name string, value string")


def jdbc_tables(spark: SparkSession, url: str, *, listing: str = "SELECT table_name FROM information_schema.tables WHERE table_schema = 'public'", **options: str) -> list[str]:
    """The tables of a database, by a query that the database answers."""
    return sorted(r[0] for r in spark.read.format("jdbc").options(url=url, query=listing, **options).load().collect())


def jdbc_counts(spark: SparkSession, url: str, table: str, columns: Iterable[str], **options: str) -> DataFrame:
    """(table_name, column_name, n_nonnull, n_distinct), counted by the database itself."""
    each = " UNION ALL ".join(f"SELECT CAST('{table}' AS VARCHAR(256)) AS table_name, CAST('{c}' AS VARCHAR(256)) AS column_name, count(\"{c}\") AS n_nonnull, count(DISTINCT \"{c}\") AS n_distinct FROM {table}" for c in columns)
    return spark.read.format("jdbc").options(url=url, query=each, **options).load()


def jdbc_lake(spark: SparkSession, url: str, tables: Iterable[str], *, split: dict[str, tuple[str, int, int]] | None = None, parts: int = 8, **options: str) -> Lake:
    """Tables of a database. split: for a table, a whole-numbered column and its bounds; it is read in `parts` ranges at once."""

    def load(t: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=t, **options)
        if split and t in split:
            column, low, high = split[t]
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
        return reader.load()

    return Lake({t: load(t) for t in tables})


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object) of tab- or space-separated N-Triples, lower-cased, last segment of each URI."""
    part = lambda k: F.regexp_extract(F.lower(F.element_at(F.split(F.rtrim(F.regexp_replace("value", r"\s*\.\s*$", "")), r"\t|(?<=>)\s+(?=[<\"])", 3), k)), r"([^/#<>]*)>?$", 1)
    return spark.read.text(path).where(F.trim("value") != "").select(part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"))


def json_tables(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, row_id, cells) of web tables, one JSON object with a `relation` of columns a line."""
    parsed = spark.read.text(path).select(F.input_file_name().alias("file"), F.from_json("value", "relation array<array<string>>, title string").alias("j"))
    rows = F.transform(F.sequence(F.lit(0), F.size(F.element_at("j.relation", 1)) - 1), lambda i: F.transform("j.relation", lambda c: F.get(c, i)))
    return parsed.select(F.coalesce("j.title", "file").alias("table_name"), F.posexplode(rows).alias("row_id", "cells"))


def sampled(values: DataFrame, keep: int, of: int, *, salt: str = "") -> DataFrame:
    """A deterministic share keep/of of the tables: those whose name hashes under it."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("table_name"))), 1, 8), 16, 10).cast("long")
    return values.where(h % of < keep)


def sampled_count(values: DataFrame, count: int, *, salt: str = "") -> DataFrame:
    """Exactly `count` tables (or all, if fewer): those whose names hash lowest."""
    names = values.select("table_name").distinct().withColumn("h", F.md5(F.concat(F.lit(salt), F.col("table_name"))))
    return values.join(names.orderBy("h", "table_name").limit(count).select("table_name"), "table_name", "left_semi")


def partitioned(values: DataFrame, parts: int, *, salt: str = "") -> DataFrame:
    """values with `part`, 0 .. parts - 1: whole tables dealt by their names' hashes."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("table_name"))), 1, 8), 16, 10).cast("long")
    return values.withColumn("part", (h % parts).cast("int"))


def save_index(index: DataFrame, path: str, key: str = "value", files: int = 64) -> None:
    """Writes an index (posting lists, signatures) in ranges of its key, so that a lookup reads few files."""
    index.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_ranked(results: DataFrame, path: str, cutoffs: Iterable[int], *, fmt: str = "csv") -> None:
    """One ranking, many cut-offs, in one job: path/k=... holds the first k of each query."""
    ks = F.array(*(F.lit(k) for k in sorted(set(cutoffs))))
    out = results.withColumn("k", F.explode(F.filter(ks, lambda k: F.col("rank") <= k))).write.mode("overwrite").partitionBy("k")
    (out.option("header", True).csv if fmt == "csv" else out.parquet)(path)


def merged(results: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results).distinct()
