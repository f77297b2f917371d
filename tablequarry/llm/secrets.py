"""Secret scan with corpus-wide ownership: who else holds the same candidate value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: The kinds in their listed order, and their patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The kind that the method adds: long mixed strings outside the others' spans; `=` may pad their end.
RARE = r"[A-Za-z0-9+/_-]{24,}={0,2}"
RARE_ONLY = rf"(?:{ASSIGN})|(?:{ACCESS})|({HEX})|({RARE})"
KINDS = ("assign", "access", "hex", "rare")


def _found(text: Column, pattern: str, value_group: int) -> Column:
    """Matches with the length of the piece before each; pieces and matches alternate in the text."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if not value_group else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    lengths = F.transform(F.slice(pieces, 1, F.size(matches)), F.length)
    zipped = F.arrays_zip(lengths.alias("gap"), F.transform(matches, F.length).alias("long"), values.alias("value"))
    return F.when(text.rlike(pattern), zipped)


def secret_spans(docs: DataFrame, *, id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = "lang", max_owners: int = 1, max_repositories: int = 2) -> tuple[DataFrame, DataFrame]:
    """Finds secrets and who owns them: (documents, occurrences).

    occurrences: row, id, owner, repository, kind, start, end (code points, end exclusive),
    value_hash, n_owners, n_repositories, n_occurrences, owner_specific. A value's repositories
    are its distinct (owner, repository) pairs. A value that at most max_owners owners hold, in
    at most max_repositories repositories, looks live; one that more hold is a copied example or
    an owner's own template. `rare` candidates (24 or more characters, with 3 digits and letters,
    that meet no span of another kind) count only where they look live.
    documents: one row per input row with row, id.

    Nulls: a null text is empty; null owners, or null repositories of an owner, are one owner or
    repository. Repeated rows are scanned each. An empty table gives empty results. Columns of
    other names are not read, so none can clash.
    """
    repo = F.col(repository) if repository else F.lit(None).cast("string")
    body = F.coalesce(F.col(text), F.lit(""))
    scanned = cut(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id).alias("id"),
            F.col(owner).cast("string").alias("owner"),
            repo.cast("string").alias("repository"),
            _found(body, ASSIGN, 2).alias("assign"),
            _found(body, ACCESS, 0).alias("access"),
            _found(body, HEX, 0).alias("hex"),
            _found(body, RARE_ONLY, 4).alias("rare"),
        )
    )
    each = None
    for kind in KINDS:
        some = scanned.where(F.col(kind).isNotNull()).select("row", "id", "owner", "repository", F.lit(kind).alias("kind"), F.posexplode(kind).alias("i", "m"))
        each = some if each is None else each.union(some)
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("*", (F.coalesce(F.sum(F.col("m.gap") + F.col("m.long")).over(before), F.lit(0)) + F.col("m.gap")).alias("start")).select("row", "id", "owner", "repository", "kind", "start", (F.col("start") + F.col("m.long")).alias("end"), F.col("m.value").alias("value"))
    mixed = F.length(F.regexp_replace("value", "[^0-9]", "")) >= 3
    good = (
        ((F.col("kind") == "assign") & (F.length("value") >= 6))
        | F.col("kind").isin("access", "hex")
        | ((F.col("kind") == "rare") & mixed & F.col("value").rlike("[A-Za-z]") & ~F.col("value").rlike(HEX) & ~F.col("value").rlike(ACCESS))
    )
    each = each.where(good)
    # A rare candidate goes if another kind's span began before its end and ends behind its start.
    around = Window.partitionBy("row").orderBy("start")
    base = F.col("kind") != "rare"
    reached = F.max(F.when(base, F.col("end"))).over(around.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(base, F.col("start"))).over(around.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    clear = (F.coalesce(reached, F.col("start")) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    each = each.withColumn("clear", base | clear).where("clear")
    each = cut(each.select("row", "id", "owner", "repository", "kind", "start", "end", F.sha2("value", 256).alias("value_hash")))
    # Distinct repositories, then owners, each combined before its shuffle: a value that fills the corpus stays a few rows.
    held = each.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n")).groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    held = held.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_occurrences"))
    known = each.join(held, "value_hash").withColumn("owner_specific", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    return scanned.select("row", "id"), known.where((F.col("kind") != "rare") | F.col("owner_specific"))


def secret_report(docs: DataFrame, *, id: str = "doc_id", **options) -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_rare, n_live, n_copied, most_owners, most_repositories.

    spans: kind:start:end by start, then kind as listed, comma-joined; base_sha256 hashes those
    of the first three kinds. n_live and n_copied: spans whose value looks live or copied.
    most_owners and most_repositories: those of its most widely held value, 0 without spans.
    """
    rows, spans = secret_spans(docs, id=id, **options)
    of = lambda kind: F.count_if(F.col("kind") == kind)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    label = F.struct("start", order.alias("k"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    join = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: x["s"]), ",")
    per = spans.groupBy("row").agg(
        *(of(k).alias(f"n_{k}") for k in KINDS),
        join(F.collect_list(F.when(F.col("kind") != "rare", label))).alias("base"),
        join(F.collect_list(label)).alias("spans"),
        F.count_if("owner_specific").alias("n_live"),
        F.count_if(~F.col("owner_specific")).alias("n_copied"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repositories").alias("most_repositories"),
    )
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(per, "row", "left").select(
        F.col("id").alias(id), number("n_assign"), number("n_access"), number("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), number("n_rare"), number("n_live"), number("n_copied"), number("most_owners"), number("most_repositories")
    )
