"""The tables and columns that the named queries treat as a lake, and SQL that flattens them alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lake import Lake, parquet_lake
from ..sources.store import kept

#: All text and whole-number columns; doubles and timestamps have no common rendering as strings.
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    "events": ["event_id", "user_id", "event_type", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "labels": ["doc_id", "quality", "toxic"],
    "embeddings": ["vec_id", "label"],
    "benchmark": ["item_id", "text"],
    "pages": ["page_id", "url", "html"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
TEXT = {"region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"], "documents": ["text", "lang", "source"], "benchmark": ["text"], "pages": ["url", "html"], "conversations": ["role", "text"]}


def lake(spark: SparkSession, root: str, columns: dict[str, list[str]] = COLUMNS) -> Lake:
    return parquet_lake(spark, root, columns)


def values(spark: SparkSession, root: str, columns: dict[str, list[str]] = COLUMNS) -> DataFrame:
    """The lake's distinct values, flattened once a session for all queries, as an index is built beforehand."""
    every = kept(spark, "column-values", [f"{root}/{t}.parquet" for t in COLUMNS], lambda: lake(spark, root).column_values())
    return every if columns is COLUMNS else of_columns(every, columns)


def of_columns(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    return df.where(reduce(Column.__or__, ((F.col("table_name") == t) & F.col("column_name").isin(cs) for t, cs in columns.items())))


def cells_sql(columns: dict[str, list[str]] = COLUMNS) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {t}" for t, cs in columns.items() for c in cs)


def values_sql(columns: dict[str, list[str]] = COLUMNS) -> str:
    """CTEs: cells and cv (table_name, column_name, value, freq)."""
    return f"cells AS ({cells_sql(columns)}), cv AS (SELECT table_name, column_name, value, count(*) AS freq FROM cells WHERE value IS NOT NULL GROUP BY ALL)"


#: CTEs after cv: sz (sizes) and p (overlaps of column pairs with both sizes).
OVERLAPS_SQL = """sz AS (SELECT table_name, column_name, count(*) AS size FROM cv GROUP BY ALL),
    p AS (SELECT o.*, a.size AS q_size, b.size AS c_size FROM (
        SELECT a.table_name AS q_table, a.column_name AS q_column, b.table_name AS c_table, b.column_name AS c_column, count(*) AS overlap
        FROM cv a JOIN cv b ON a.value = b.value AND (a.table_name <> b.table_name OR a.column_name <> b.column_name) GROUP BY ALL) o
        JOIN sz a ON a.table_name = q_table AND a.column_name = q_column JOIN sz b ON b.table_name = c_table AND b.column_name = c_column)"""


def top_sql(score: str, k: int, source: str = "p", where: str = "true") -> str:
    return f"""SELECT q_table, q_column, c_table, c_column, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_table, q_column ORDER BY score DESC, c_table, c_column)::INT AS rank
        FROM (SELECT *, {score} AS score FROM {source} WHERE {where})) WHERE rank <= {k}"""
