"""From raw documents to packed training sequences: five stages, each written and read again.

All but the last return the columns of documents; run() applies them to a table of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablequarry import ship
from tablequarry.llm import jaccard, line_dedup, mixing, packing, quality
from tablequarry.llm.common import bitmap, cut, discard, filter_bits, maybe_in, scratch_path, table, unused
from tablequarry.llm.queries import ENCODING


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that score under 0.3.

    A null text is scored as an empty one; rows that repeat a text are scored alike, so all or
    none of them go. Long texts are read whole. An empty table stays empty; columns of any name pass.
    """
    ship(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = unused(docs.columns, "score")
    return quality.with_score(docs, model, score=score).where(F.col(score) >= 0.3).drop(score)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of 50 words or more go, and documents of which nothing else is left.

    Null and empty texts stay, as do rows that repeat the first one's id and text; other ties go
    by id, then by place in the text. n_chars, if there, follows a changed text. An empty table
    stays empty; columns of any name pass.
    """
    ship(spark)
    found = line_dedup.lines_removed(docs)
    found = found.where((F.col("n_deleted") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_deleted") > 0, F.char_length("text").cast("long")).otherwise(F.col("doc").getField("n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Documents without words are no copies of each other and stay. Rows that share an id are one
    document, which stays or goes as a whole; rows without an id stay. An empty table stays
    empty; columns of any name pass.
    """
    ship(spark)
    gone = cut(jaccard.jaccard_components(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone")).distinct())
    bits = filter_bits(gone.count())
    filter_ = cut(bitmap(gone.select(F.xxhash64("gone").alias("h")), "h", bits))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    hashed = rows.withColumn("h", F.xxhash64("doc.doc_id"))
    # Only texts that may go meet the list of those that do.
    unsure = maybe_in(hashed, "h", filter_, bits).join(gone, F.col("doc.doc_id") == F.col("gone"), "left_anti").select("doc")
    return maybe_in(hashed, "h", filter_, bits, "left_anti").select("doc").union(unsure).select("doc.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources are read up to 1.25 times, every document once at least.

    A null source is a source; null and blank texts go along with theirs. Repeated rows are
    documents of their own. An empty table stays empty; columns of any name pass.
    """
    ship(spark)
    return mixing.uses(docs, max_repeat=1.25).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every use of every document in sequences of 2048 tokens: see packing.pack.

    A null text is an empty one, its end token alone. Long texts give several pieces; repeated
    rows and rows without an id are packed each. An empty table gives no pieces.
    """
    ship(spark)
    return packing.pack(docs, ENCODING)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", packed),
]

#: A trained classifier has no SQL; tests/llm hold run() against a brute-force version of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again; a stage's folder goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
