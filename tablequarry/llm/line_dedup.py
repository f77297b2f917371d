"""Line deduplication by winnowing: repeated runs of lines go, their first occurrence stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bitmap, cut, filter_bits, maybe_in

WORD = r"[^\x20\x09-\x0D]+"


def _fingerprints(texts: DataFrame, min_words: int) -> DataFrame:
    """(id, th, at, h, windows): the selected lines with the windows in which they are least.

    Blank lines do not count. Windows are the shortest runs of lines with min_words words: from
    each line on, and to each line. So a run shared by two places with that many words shares
    whole windows, which cover it: a line that no window inside the run from a line on reaches
    is the end of one inside it. The least line hash of a window (the last of equal ones) is the
    fingerprint that both places select.
    windows: (first, last, key), the first and last line and a hash of all its lines.
    """
    lines = texts.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("id", "th", "pos", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("w")).where("w > 0")
    lines = lines.dropDuplicates(["id", "th", "pos"])  # rows that repeat id and text
    by = Window.partitionBy("id", "th")
    lines = lines.withColumn("c", F.sum("w").over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w"))
    lines = lines.select("*", F.count(F.lit(1)).over(by.orderBy("c").rangeBetween(Window.unboundedPreceding, min_words - 1)).alias("end"), F.sum("w").over(by).alias("all"))
    # Line `begin` (from 0) is the last one from which there are enough words: as many lines end that far before.
    lines = lines.withColumn("e", F.col("c") + F.col("w"))
    lines = lines.select("*", F.count(F.lit(1)).over(by.orderBy("e").rangeBetween(Window.unboundedPreceding, -min_words)).alias("begin"))
    per = lines.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "end", ((F.col("all") - F.col("c")) >= min_words).alias("full"), "begin", (F.col("e") >= min_words).alias("led")))).alias("x"), F.max("all").alias("all")).where(F.col("all") >= min_words)
    # Window i (from 0) holds the lines i .. end - 1, numbered among those that are not blank.
    run = lambda x, i: F.slice("x", i + 1, (x["end"] - i).cast("int"))
    least = lambda r: F.array_max(F.transform(r, lambda y: F.struct(F.bitwise_not(y["h"]).alias("neg"), y["pos"].alias("pos"))))
    made = lambda r, first, last: F.struct(least(r).alias("least"), first.alias("first"), last.alias("last"), F.xxhash64(F.transform(r, lambda y: y["h"])).alias("key"))
    window = lambda x, i: F.when(x["full"], made(run(x, i), x["pos"], F.element_at(F.col("x"), x["end"].cast("int"))["pos"]))
    opening = lambda x: F.element_at(F.col("x"), (x["begin"] + 1).cast("int"))
    led = lambda x, i: F.slice("x", (x["begin"] + 1).cast("int"), (i + 1 - x["begin"]).cast("int"))
    # Not again those that are also the shortest from their first line on.
    found = F.concat(F.transform("x", window), F.transform("x", lambda x, i: F.when(x["led"] & (opening(x)["end"] != i + 1), made(led(x, i), opening(x)["pos"], x["pos"]))))
    windows = per.select("id", "th", F.explode(found).alias("v")).where("v is not null").select("id", "th", F.bitwise_not(F.col("v.least.neg")).alias("h"), F.col("v.least.pos").alias("at"), F.struct("v.first", "v.last", "v.key").alias("v"))
    return windows.groupBy("id", "th", "at", "h").agg(F.collect_list("v").alias("windows"))


def repeated_lines(texts: DataFrame, min_words: int) -> DataFrame:
    """(id, th, pos): the lines that repeat earlier ones; texts has id, th (a hash of the text) and text."""
    prints = cut(_fingerprints(texts, min_words))
    place = F.struct("id", "th", "at")
    shared = prints.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("h")
    # A match of fingerprints extends both ways as far as a window round it does: equal windows are equal
    # runs, longer runs are their unions. Whole groups are compared with their first place, so a line
    # that is everywhere makes no pairs.
    found = cut(prints.join(shared, "h").select("h", "id", "th", F.explode("windows").alias("v")).select("h", F.col("v.key").alias("key"), "id", "th", F.col("v.first").alias("first"), F.col("v.last").alias("last")))
    start = F.struct("id", "th", "first")
    # Cut, so that the join reads two plain shuffles and the side of a very common run can be split.
    origin = cut(found.groupBy("h", "key").agg(F.min(start).alias("a"), F.max(start).alias("b")).where("a != b").select("h", "key", "a"))
    later = found.join(origin, ["h", "key"]).where(start > F.col("a"))
    # Overlapping and touching windows merge into whole runs.
    return later.select("id", "th", F.explode(F.sequence("first", "last")).alias("pos")).distinct()


def lines_removed(docs: DataFrame, *, min_words: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text, n_lines, n_deleted): each row as it was, its text without repeated runs, and counts. See dedup_lines."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    key, body = F.col("doc").getField(id), F.col("doc").getField(text)
    th = F.xxhash64(body)
    gone = repeated_lines(rows.where(body.isNotNull()).select(key.alias("id"), th.alias("th"), body.alias("text")), min_words)
    gone = cut(gone.groupBy("id", "th").agg(F.collect_list("pos").alias("gone")))
    # Texts that lose nothing stay where they are; only the others meet their lines in a shuffle.
    bits = filter_bits(gone.count())
    filter_ = cut(bitmap(gone.select(F.xxhash64("id", "th").alias("h")), "h", bits))
    hashed = rows.withColumn("_th", th).withColumn("_h", F.xxhash64(key, F.col("_th")))
    lines = F.split(body, "\n")
    count = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long")  # noqa: E731  size(null) may be -1
    touched = maybe_in(hashed, "_h", filter_, bits).join(gone.select(F.col("id").alias("_id"), F.col("th").alias("_t"), "gone"), key.eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_t")), "left")
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    touched = touched.select("doc", F.when(F.col("gone").isNull(), body).otherwise(rest).alias("text"), count(F.size(lines)).alias("n_lines"), count(F.size("gone")).alias("n_deleted"))
    untouched = maybe_in(hashed, "_h", filter_, bits, "left_anti").select("doc", body.alias("text"), count(F.size(lines)).alias("n_lines"), F.lit(0).cast("long").alias("n_deleted"))
    return touched.union(untouched)


def dedup_lines(docs: DataFrame, *, min_words: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, its text without repeated runs, then n_lines and n_deleted.

    A run of lines (split at newlines, compared byte by byte through 64-bit hashes) that has
    min_words words or more goes whole if equal lines, blank ones aside, stand at an earlier
    place: in a document of a smaller id, or before it in the same one. Runs of fewer words stay.
    Every deleted line has an equal one that stays.

    A null text stays null, with no lines; an empty one has one line. Null ids come first. Rows
    that repeat both id and text are alike: what goes in one goes in all. An empty table gives an
    empty result. Columns n_lines and n_deleted of docs, if any, are replaced; others may have
    any name.
    """
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    return lines_removed(docs, min_words=min_words, id=id, text=text).select(*(F.col("text").alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in own), "n_lines", "n_deleted")
