"""Line dedup: a segment-partition edit join over the distinct lines of a corpus.

A line of length l is cut into one more segments than the edits allowed, so a line within that many edits holds one
of them unchanged; where it may sit depends only on the lengths. Keys are hashes of (length, segment, content). A
key's bucket with two lines is a candidate pair at once. Larger buckets are joined, and those over ``HOT`` lines are
cut finer first, down to keys that make every bucket a star, so no bucket is ever expanded into all its pairs.
Candidates are verified by a banded bit-parallel edit distance. Everything is a DataFrame expression, and only
candidates' texts travel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import components, join_counted
from sigloom.scratch import mark, release, table

#: Edits allowed, the shortest line (in code points) that is compared, and the lines a bucket may hold to be joined.
EDITS, SHORTEST, HOT = 1, 16, 64
#: Segments for each edit that candidates are compared by before their distance is told.
AGREE = 16
#: Segments of the finer cut, and the candidate lines (24 bytes each) that may be broadcast.
FINE, BROADCAST = 16, 1_000_000


def explode_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, text_key, pos, line, h1, h2) of every line of ``shortest`` code points or more; pos counts all lines."""
    each = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return each.where(F.length("line") >= shortest).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def segment_keys(line: Column, edits: int) -> list[Column]:
    """The keys under which a line is found: its own segments, and the substrings that may be a segment of a line
    shorter by up to ``edits``, where both the left and the right part leave enough edits."""
    size, out = F.length(line), []
    for short in range(edits + 1):
        other = size - short
        for i in range(edits + 1):
            begin, end = F.floor(other * i / (edits + 1)), F.floor(other * (i + 1) / (edits + 1))
            for shift in range(max(-i, short - (edits - i)), min(i, short + edits - i) + 1):
                inside = (begin + shift >= 0) & (end + shift <= size) & (end > begin)
                out.append(F.when(inside, F.xxhash64(F.lit(i), other, F.substring(line, (begin + shift + 1).cast("int"), (end - begin).cast("int")))))
    return out


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two texts, exact up to ``edits`` and larger beyond it.

    The band's cells of a column are the bits of one number; it slides down a row at each character of ``b``. Lengths
    must differ by ``edits`` at most and ``a`` be longer than ``edits``, or the result is ``edits`` + 1.
    """
    width = 2 * edits + 1
    ones, top = (1 << width) - 1, 1 << (2 * edits)
    m, n = F.length(a), F.length(b)
    chars, inv = F.split(a, ""), lambda x: x.bitwiseXOR(F.lit(ones))
    # Which cells of each column match: ``a`` moved by every place of the band, beside ``b``.
    moved = [F.concat(F.array_repeat(F.lit(""), edits - k), chars) if k <= edits else F.slice(chars, F.lit(k - edits + 1), F.greatest(m - (k - edits), F.lit(0))) for k in range(width)]
    mark = lambda bit: lambda p, q: F.when(p == q, bit).otherwise(0)
    bits = [F.zip_with(x, F.split(b, ""), mark(1 << k)) for k, x in enumerate(moved)]
    matches = F.slice(reduce(lambda x, y: F.zip_with(x, y, lambda p, q: F.coalesce(p, F.lit(0)) + F.coalesce(q, F.lit(0))), bits), F.lit(1), n)
    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"), F.lit(0).alias("j"), m.alias("m"))

    def column(acc: Column, pm: Column) -> Column:
        j, vp, vn, rows = acc["j"], acc["vp"], acc["vn"], acc["m"]
        zero = F.array((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(ones)))
        more = F.transform(zero, lambda d0: F.struct(d0.alias("d0"), vn.bitwiseOR(inv(d0.bitwiseOR(vp))).alias("hp"), d0.bitwiseAND(vp).alias("hn")))

        def last(s: Column) -> Column:
            down, bit = F.shiftright(s["d0"], 1), rows - 1 - j + edits  # bit: of the last row, once the band reaches it
            along = F.call_function("shiftright", s["hp"], bit) % 2 - F.call_function("shiftright", s["hn"], bit) % 2
            grown = F.when(j + 1 + edits <= rows, F.when(s["d0"].bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)).otherwise(along)
            return F.struct(s["hn"].bitwiseOR(inv(down.bitwiseOR(s["hp"]))).alias("vp"), s["hp"].bitwiseAND(down).alias("vn"), (acc["d"] + grown).alias("d"), (j + 1).alias("j"), rows.alias("m"))

        return F.element_at(F.transform(more, last), 1)

    return F.when((F.abs(m - n) <= edits) & (m > edits), F.aggregate(matches, start, column, lambda s: s["d"])).otherwise(edits + 1)


def segments_agree(a: Column, b: Column, edits: int) -> Column:
    """Whether all but ``edits`` of ``AGREE`` segments for each edit of ``a`` lie in ``b``, moved by ``edits`` at most: true
    for every pair within ``edits``, as an edit changes one segment, and cheap beside their distance."""
    size, parts = F.length(a), AGREE * edits
    found = []
    for i in range(parts):
        begin, end = F.floor(size * i / parts).cast("int"), F.floor(size * (i + 1) / parts).cast("int")
        own = F.substring(a, begin + 1, end - begin)
        there = reduce(lambda p, q: p | q, [(begin + k >= 0) & (F.substring(b, begin + k + 1, end - begin) == own) for k in range(-edits, edits + 1)])
        found.append(there.cast("int"))
    return reduce(lambda p, q: p + q, found) >= parts - edits


def _pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b, of ``members`` (key, uid) of small buckets."""
    a, b = members.select("key", F.col("uid").alias("a")), members.select("key", F.col("uid").alias("b"))
    return a.join(b, "key").where("a < b").select("a", "b")


def _counted(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("a"), F.max("uid").alias("b")).where("n > 1 and a < b")


def _finer(texts: DataFrame) -> DataFrame:
    """Candidate pairs for one edit among ``texts`` (uid, line): all but one of ``FINE`` segments must agree.

    Buckets that are still hot are cut to single positions: lines equal but for one masked character, or equal once
    one character is left out, share a key whose bucket is a star around one line.
    """
    line, size = F.col("line"), F.length("line")

    def cut(k: Column, short: int) -> Column:
        other = size - short
        begin, end = F.floor(other * k / FINE).cast("int"), F.floor(other * (k + 1) / FINE).cast("int") + short
        left, right = F.substring(line, F.lit(1), begin), F.substring(line, end + 1, size)
        return F.struct(F.xxhash64(k, other, left, right, F.xxhash64(F.lit(9), right)).alias("key"), F.substring(line, begin + 1, end - begin).alias("part"), F.lit(short).alias("short"))

    steps = F.sequence(F.lit(0), F.lit(FINE - 1))
    cuts = F.concat(F.transform(steps, lambda k: cut(k, 0)), F.transform(steps, lambda k: cut(k, 1)))
    keyed = table(texts.select("uid", F.explode(cuts).alias("x")).select("uid", "x.*"))
    stats = table(_counted(keyed))
    two = stats.where("n = 2").select("a", "b")
    some = _pairs(keyed.join(stats.where(F.col("n").between(3, HOT)).select("key"), "key", "left_semi").select("key", "uid").distinct())
    rest = keyed.join(stats.where(F.col("n") > HOT).select("key"), "key", "left_semi")
    place = F.sequence(F.lit(1), F.length("part"))
    gone = lambda p, mark: F.xxhash64("key", F.lit(mark), F.substring("part", F.lit(1), p - 1), p if mark == "mask" else F.lit(0), F.substring("part", p + 1, F.length("part")))
    joined = lambda p: F.xxhash64("key", F.concat(F.substring("part", F.lit(1), p - 1), F.substring("part", p + 1, F.length("part"))))
    masks = rest.where("short = 0 and length(part) > 0").select("uid", F.explode(F.transform(place, lambda p: gone(p, "mask"))).alias("key"))
    stars = masks.groupBy("key").agg(F.min("uid").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    masked = masks.join(stars, "key").where("a < uid").select("a", F.col("uid").alias("b"))
    whole = rest.where("short = 0").select(F.xxhash64("key", "part").alias("key"), F.col("uid").alias("a"))
    shorter = rest.where("short = 1 and length(part) > 0").select("uid", F.explode(F.array_distinct(F.transform(place, joined))).alias("key"))
    dropped = shorter.join(whole, "key").select(F.least("a", "uid").alias("a"), F.greatest("a", "uid").alias("b")).where("a < b")
    return reduce(DataFrame.unionByName, [two, some, masked, dropped])


def line_links(lines: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """(distinct lines (h1, h2, uid), links (a, b) of uids): links have the connected sets of all pairs of distinct
    lines within ``edits`` edits.

    Buckets over ``HOT`` lines are cut finer for one edit. For more edits there is no such cut, and joining them in pairs
    would make the square of their size, so they are an error.
    """
    keys = segment_keys(F.col("line"), edits)
    named = [f"k{i}" for i in range(len(keys))]
    distinct = table(lines.select("h1", "h2", *[k.alias(c) for k, c in zip(keys, named)]).groupBy("h1", "h2").agg(*[F.max(c).alias(c) for c in named]).withColumn("uid", F.monotonically_increasing_id()))
    every = distinct.select("uid", F.explode(F.array(*named)).alias("key")).where("key is not null")
    stats = table(_counted(every))
    two = stats.where("n = 2").select("a", "b")
    larger = table(every.join(stats.where("n > 2").select("key", "n"), "key"))
    if edits > 1 and (over := larger.agg(F.max("n")).first()[0] or 0) > HOT:
        raise ValueError(f"{over} lines share a segment: with {edits} edits at most {HOT} may; use one edit or raise HOT")
    some = _pairs(larger.where(F.col("n") <= HOT).select("key", "uid"))
    pairs = two.unionByName(some)
    ids = lambda p: p.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    hot = larger.where(F.col("n") > HOT).select("uid").distinct()
    wanted = table(distinct.join(ids(pairs).unionByName(hot).distinct(), "uid", "left_semi").select("h1", "h2", "uid"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted  # beyond it, lines are shuffled by hash
    texts = table(lines.select("h1", "h2", "line").join(wanted, ["h1", "h2"]).groupBy("uid").agg(F.max("line").alias("line")))
    if edits == 1:
        pairs = pairs.unionByName(_finer(texts.join(hot, "uid", "left_semi")))
    candidates = table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left, right = texts.select(F.col("uid").alias("a"), F.col("line").alias("x")), texts.select(F.col("uid").alias("b"), F.col("line").alias("y"))
    near = candidates.join(left, "a").join(right, "b").where(F.abs(F.length("x") - F.length("y")) <= edits)
    # Few bytes, but dear ones: they go to all cores, not to as few tasks as their size asks for.
    near = near.repartition(2 * lines.sparkSession.sparkContext.defaultParallelism, "a", "b").where(segments_agree(F.col("x"), F.col("y"), edits))
    return distinct.select("h1", "h2", "uid"), near.where(banded_distance(F.col("x"), F.col("y"), edits) <= edits).select("a", "b")


def removed_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, text_key, removed): for documents that lose lines, the array of (line, kept_doc, kept_line).

    Lines are one class if equal or linked by near-equal lines. A class keeps its first line, by doc_id (nulls first)
    and then place; the others are removed, each with the place of the one kept. Lines under ``shortest`` code points
    never go. Rows with equal doc_id and text are one document; null texts have no lines, and an empty text is one short
    line; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    since = mark(spark)
    lines = explode_lines(docs, shortest)
    distinct, links = line_links(lines, edits)
    roots = components(links)
    named = distinct.join(roots, distinct.uid == roots.node).select("h1", "h2", "root")
    classes = table(named.join(distinct.select(F.col("uid").alias("root"), F.col("h1").alias("c1"), F.col("h2").alias("c2")), "root").select("h1", "h2", "c1", "c2"))
    spots = lines.select("doc_id", "text_key", "pos", "h1", "h2").join(classes, ["h1", "h2"], "left")
    spots = table(spots.select("doc_id", "text_key", "pos", F.coalesce("c1", "h1").alias("c1"), F.coalesce("c2", "h2").alias("c2")))
    first = table(spots.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "pos", "text_key")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    release(spark, since, keep=2)
    gone = join_counted(spots, first, ["c1", "c2"], "n").where(~F.struct("doc_id", "pos", "text_key").eqNullSafe(F.col("kept")))
    return gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct(F.col("pos").alias("line"), F.col("kept.doc_id").alias("kept_doc"), F.col("kept.pos").alias("kept_line")))).alias("removed"))


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) for every row of ``docs``, repeated ones included, with the handling of nulls,
    ties and short lines of ``removed_lines``; null texts have no lines; an empty table gives no rows."""
    gone = removed_lines(docs)
    each = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    held = gone.select(F.col("doc_id").alias("_sg_id"), F.col("text_key").alias("_sg_key"), "removed")
    joined = each.join(held, F.col("doc_id").eqNullSafe(F.col("_sg_id")) & (F.col("text_key") == F.col("_sg_key")), "left")
    empty = F.array().cast(gone.schema["removed"].dataType)
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", empty).alias("removed"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines; a document that keeps no line has an empty text; other columns stay. A null text
    stays null; of equal lines the first in order of doc_id (nulls first) and place stays; repeated rows, alike in id and
    text, all lose the same lines; columns of any name are kept; an empty table gives no rows."""
    gone = removed_lines(docs).select(F.col("doc_id").alias("_sg_id"), F.col("text_key").alias("_sg_key"), F.transform("removed", lambda x: x["line"]).alias("_sg_gone"))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_sg_id")) & (F.xxhash64("text") == F.col("_sg_key")), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_sg_gone", i))
    return joined.withColumn("text", F.when(F.col("_sg_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
