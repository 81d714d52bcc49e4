"""Secret scans: candidate spans by pattern, then how many repositories and owners of the corpus each candidate has.

A value that many owners hold is a copied example, and so is one that an owner has put into many repositories: a template
is copied, a credential is used. One that few owners hold in few repositories looks live. Candidates are of four kinds: the
three base kinds, and ``owned``, a long token of mixed letters and digits outside the base spans, which becomes a span
only where one owner alone holds it, in few repositories. Everything is a DataFrame expression.
"""

from __future__ import annotations

from math import log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import fold_running, join_counted
from sigloom.scratch import table

# The patterns of the base kinds and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"
KINDS = ("assign", "access", "hex", "owned")

#: A token of at least 16 letters and digits, both among them.
OWNED = r"((?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}(?![A-Za-z0-9]))"
#: Owners that make a value an example, in a corpus of ten owners at most, and more for each tenfold of owners.
WIDE, WIDER = 3, 3
#: Repositories, of however few owners, that make it one in a corpus of ten repositories at most, and more for each tenfold.
SPREAD, SPREADER = 8, 8


def wide_from(owners: int) -> int:
    """The number of owners from which a value is an example: a credential that a few owners share may be live still, and
    the more owners a corpus has, the more of them may."""
    return WIDE + int(WIDER * max(0.0, log10(max(owners, 1)) - 1))


def spread_from(repositories: int) -> int:
    """The number of repositories from which a value is an example, whoever owns them: an owner's services may share a
    credential, and the more repositories a corpus has, the more of them may."""
    return SPREAD + int(SPREADER * max(0.0, log10(max(repositories, 1)) - 1))


def spans(text: Column, pattern: str, value: int, least: int, kind: int) -> Column:
    """Array of (start, end, kind, hash of the value's group) of the leftmost matches, none overlapping.

    The text between matches comes from a split by the same pattern, so offsets are sums of lengths in code
    points. Matches with a shorter value than ``least`` fall away only after matching.
    """
    whole, held = F.regexp_extract_all(text, F.lit(f"(?:{pattern})"), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), held.alias("held"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.sha2(x["held"], 256).alias("value")))
        kept = F.when(F.length(x["held"]) >= least, F.concat(acc["found"], one)).otherwise(acc["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    return F.when(text.rlike(pattern), fold_running(parts, start, step, "found")["found"]).otherwise(start["found"])


def owner_of(source: Column) -> tuple[Column, Column]:
    """(owner, repository) of a source. ``owner/repository/...``, also behind a scheme and a host, gives both; a source
    without a slash is the only repository of its owner; null is an owner of its own."""
    path = F.split(F.coalesce(F.regexp_replace(source, "^[a-z]+://[^/]*/", ""), F.lit("")), "/")
    return path[0], F.array_join(F.slice(path, 1, 2), "/")


def scan(docs: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, owner, repository, base, extra): arrays of spans of every whole text; null is empty. A table without the
    column ``source`` has one owner."""
    text = F.coalesce(F.col("text"), F.lit(""))
    owner, repository = owner_of(F.col(source) if source in docs.columns else F.lit("").cast("string"))
    base = F.concat(spans(text, ASSIGN, 2, 6, 0), spans(text, ACCESS, 1, 20, 1), spans(text, HEX, 1, 24, 2))
    found = docs.select("doc_id", owner.alias("owner"), repository.alias("repository"), base.alias("base"), spans(text, OWNED, 1, 16, 3).alias("extra"))
    apart = F.filter("extra", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return found.withColumn("extra", apart)


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_owners, n_repos, n) over the corpus, n counting its spans. Each value meets each repository once before
    they are counted, so a value in a third of all rows is one row for each task and repository."""
    each = found.select("owner", "repository", F.explode(F.transform(F.concat("base", "extra"), lambda x: x["value"])).alias("value"))
    by_repository = each.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n"))


def find_secrets(docs: DataFrame, source: str = "source", wide: int | None = None, spread: int | None = None) -> DataFrame:
    """(doc_id, base, live, examples, all): span arrays (start, kind, end, value, n_owners, n_repos, live), each by start,
    then kind, but for ``base``, which has the base spans' start, kind and end alone.

    ``live`` are spans whose value has fewer than ``wide`` owners (by default ``wide_from`` the corpus's owners) and is in
    fewer than ``spread`` repositories (by default ``spread_from`` the corpus's); the rest are ``examples``. ``all`` has the
    base spans and those of ``owned`` values with a single owner and fewer than ``spread`` repositories. Null sources
    count as one owner; repeated rows each return; null and empty texts and rows without a candidate return empty
    arrays; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    found = table(scan(docs, source).withColumn("row", F.monotonically_increasing_id()))
    if wide is None:
        wide = wide_from(found.select("owner").distinct().count())
    if spread is None:
        spread = spread_from(found.select("owner", "repository").distinct().count())
    counts = table(ownership(found))
    each = table(found.select("row", F.explode(F.concat("base", "extra")).alias("s")).select("row", "s.*"))
    told = join_counted(each, counts, ["value"], "n").where((F.col("kind") < 3) | ((F.col("n_owners") == 1) & (F.col("n_repos") < spread)))
    one = F.struct("start", "kind", "end", "value", "n_owners", "n_repos", ((F.col("n_owners") < wide) & (F.col("n_repos") < spread)).alias("live"))
    by_row = told.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("all"))
    out = found.join(by_row, "row", "left").withColumn("all", F.coalesce("all", F.array().cast(by_row.schema["all"].dataType)))
    return out.select(
        "doc_id", F.sort_array(F.transform("base", lambda x: F.struct(x["start"], x["kind"], x["end"]))).alias("base"),
        F.filter("all", lambda x: x["live"]).alias("live"), F.filter("all", lambda x: ~x["live"]).alias("examples"), "all")


def digest(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest columns of ``find_secrets`` for each row of ``docs``, with the owners:repositories of each span, and how
    many spans look live and how many are examples. Nulls, empty texts, ties and repeated rows are as there."""
    found = find_secrets(docs)
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    held = F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["n_owners"], x["n_repos"])), ",")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("all")).alias("spans"), held.alias("owners_repos"),
        F.size("live").cast("long").alias("n_live"), F.size("examples").cast("long").alias("n_example"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every live-looking span replaced by ``mark``; examples stay; other columns as they are.

    Null and empty texts stay; ``docs`` may lack the column ``source``; an empty table gives no rows. Documents are matched by ``doc_id``, which should be unique: the spans of repeated ids are not mixed, since
    rows with equal ids and different texts keep their own through the text's hash.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.withColumn("_sg_key", key)
    hits = find_secrets(docs.withColumn("doc_id", F.struct("doc_id", key.alias("k")))).where(F.size("live") > 0)
    hits = hits.groupBy("doc_id").agg(F.first("live").alias("_sg_live")).select(F.col("doc_id.doc_id").alias("_sg_id"), F.col("doc_id.k").alias("_sg_k"), "_sg_live")
    joined = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("_sg_id")) & (F.col("_sg_key") == F.col("_sg_k")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        fresh = x["end"] > acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.when(x["start"] >= acc["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit("")))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("_sg_live", start, step)
    text = F.when(F.col("_sg_live").isNull(), F.col("text")).otherwise(F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))))
    return joined.withColumn("text", text).select(*docs.columns)
