"""Personal data: validated numbers and dates are permuted by a keyed Feistel network within their own format.

A pseudonym keeps length, punctuation, calendar validity and check digit, and depends on the value and the key
alone, so equal values stay linked across documents and different ones stay apart. Everything is a DataFrame
expression: a text is split by one pattern, its hits are classified, checked and permuted, and it is joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import fold_running

# The patterns of the kinds, in the order in which they are tried. Unbounded groups are possessive: the
# matcher would otherwise call itself once a repetition, and a long text would end the executor.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
KINDS = tuple(PATTERNS)
#: All kinds but e-mail begin with a digit, a plus or a bracket, so other places are left after one comparison.
ANY = PATTERNS["email"] + "|(?=[0-9+(])(?:" + "|".join(PATTERNS[k] for k in KINDS[1:]) + ")"
ROUNDS = 8
#: Days from 1900-01-01 that dates are permuted among: a product, so that a date is a pair of digits.
DAYS = (270, 271)


def _prf(key: str, tweak: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), value.cast("string")), 256)


def feistel_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, tweak: str) -> Column:
    """(l, r) of the permuted pair of numbers, 0 <= left < sizes[0] and 0 <= right < sizes[1]."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        add = F.conv(F.substring(_prf(key, tweak, i, F.when(even, acc["r"]).otherwise(acc["l"])), 1, 15), 16, 10).cast("long")
        return F.struct(F.when(even, F.pmod(acc["l"] + add, F.lit(sizes[0]))).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + add, F.lit(sizes[1]))).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _shifted(text: Column, key: str, tweak: str, turn: Column, value: Column) -> Column:
    """Each letter or digit moved on in its own class by a byte of a key stream, 32 of which are one digest of ``value``."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / 32).cast("int")), lambda b: _prf(key, tweak, turn, F.concat_ws("|", value, b)))

    def moved(stream: Column) -> Column:
        def move(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(F.element_at(stream, F.floor(i / 32).cast("int") + 1), (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            return (F.when(c.between("0", "9"), F.char(F.pmod(F.ascii(c) - 48 + by, F.lit(10)) + 48))
                    .when(c.between("a", "z"), F.char(F.pmod(F.ascii(c) - 97 + by, F.lit(26)) + 97))
                    .when(c.between("A", "Z"), F.char(F.pmod(F.ascii(c) - 65 + by, F.lit(26)) + 65)).otherwise(c))

        return F.array_join(F.transform(F.split(text, ""), move), "")

    return F.when(text == "", text).otherwise(F.transform(F.array(blocks), moved)[0])  # the stream is made once, not for each letter


def _one(text: Column, key: str, tweak: str) -> Column:
    """A single letter or digit permuted within its class, as a pair of numbers."""
    out = text
    for first, size in (("0", 10), ("a", 26), ("A", 26)):
        at = F.ascii(text) - ord(first)
        pair = feistel_pair(F.floor(at * 2 / size), at % (size // 2), (2, size // 2), key, f"{tweak}:{first}")
        out = F.when(at.between(0, size - 1), F.char(pair["l"] * (size // 2) + pair["r"] + ord(first))).otherwise(out)
    return out


def feistel_text(text: Column, key: str, tweak: str) -> Column:
    """``text`` permuted among texts of the same length and character classes."""
    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, _shifted(acc["l"], key, tweak, i, acc["r"])).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(_shifted(acc["r"], key, tweak, i, acc["l"])).alias("r"))

    return F.when(half == 0, _one(text, key, tweak)).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda a: F.concat(a["l"], a["r"])))


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn's sum of a string of digits; ``double_last``: the last one counts double, as before a check digit."""

    def add(acc: Column, x: Column) -> Column:
        d = F.when(x["double"], x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)).otherwise(x["d"])
        return acc + d

    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), ((i % 2 == 0) == F.lit(double_last)).alias("double")))
    return F.aggregate(each, F.lit(0), add)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in turn by those of ``digits``."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct((acc["i"] + is_digit.cast("int")).alias("i"), F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(shape, ""), start, put, lambda a: a["out"])


def _date(hit: Column) -> tuple[Column, Column]:
    """The day of a hit (null if the calendar has none) and its style's format."""
    style = F.when(hit.contains("-"), "yyyy-MM-dd").when(hit.contains("/"), "MM/dd/yyyy").otherwise("dd.MM.yyyy")
    parts = F.split(hit, "[-/.]")
    at = lambda k: F.get(parts, F.lit(k)).cast("int")
    year = F.when(hit.contains("-"), at(0)).otherwise(at(2))
    month = F.when(hit.contains("/"), at(0)).otherwise(at(1))
    day = F.when(hit.contains("-"), at(2)).when(hit.contains("/"), at(1)).otherwise(at(0))
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 29).otherwise(28)).otherwise(31)
    valid = month.between(1, 12) & (day >= 1) & (day <= last) & (year >= 1)
    return F.when(valid, F.make_date(year, month, day)), style


def classify(hit: Column) -> Column:
    """The kind of a hit, or null where its value fails the kind's check."""
    full = lambda kind: hit.rlike(f"^(?:{PATTERNS[kind]})$")
    octets = F.forall(F.split(hit, r"\."), lambda x: x.cast("int") <= 255)
    days = F.datediff(_date(hit)[0], F.lit("1900-01-01").cast("date"))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    return (F.when(hit.contains("@"), "email").when(full("date"), F.when(days.between(0, DAYS[0] * DAYS[1] - 1), "date"))
            .when(full("ip"), F.when(octets, "ip")).when(full("phone") & ~full("card"), "phone")
            .when(full("card"), F.when(luhn_sum(digits, False) % 10 == 0, "card").when(full("phone"), "phone")))


def pseudonym(hit: Column, kind: Column, key: str) -> Column:
    """``hit`` permuted within its kind's format; without a kind it stays."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    local, domain = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    octet = lambda k: F.get(F.split(hit, r"\."), F.lit(k)).cast("int")
    pair = feistel_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), (65536, 65536), key, "ip")
    four = lambda p: F.concat_ws(".", F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)
    day, style = _date(hit)
    since = F.datediff(day, F.lit("1900-01-01").cast("date"))
    moved = feistel_pair(F.floor(since / DAYS[1]), since % DAYS[1], DAYS, key, "date")
    on = F.date_add(F.lit("1900-01-01").cast("date"), (moved["l"] * DAYS[1] + moved["r"]).cast("int"))
    dated = F.when(style == "yyyy-MM-dd", F.date_format(on, "yyyy-MM-dd")).when(style == "MM/dd/yyyy", F.date_format(on, "MM/dd/yyyy")).otherwise(F.date_format(on, "dd.MM.yyyy"))
    body = feistel_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    card = F.concat(body, F.pmod(10 - luhn_sum(body, True) % 10, F.lit(10)).cast("string"))
    country = F.regexp_extract(hit, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    number = F.regexp_replace(F.substring(hit, F.length(country) + 1, F.length(hit)), "[^0-9]", "")
    phone = F.concat(country, _refill(F.substring(hit, F.length(country) + 1, F.length(hit)), feistel_text(number, key, "phone")))
    return (F.when(kind == "email", F.concat(feistel_text(local, key, "email"), F.lit("@"), domain)).when(kind == "date", dated)
            .when(kind == "ip", four(pair)).when(kind == "phone", phone).when(kind == "card", _refill(hit, card)).otherwise(hit))


def pseudonymise(docs: DataFrame, key: str, found: str | None = None) -> DataFrame:
    """``docs`` with ``text`` pseudonymised and, if ``found`` names it, a column of what was found: an array of (kind,
    start, end) in code points of the original text.

    Of an e-mail address the name is permuted and the domain stays. Null texts stay null and empty ones empty, with
    nothing found; equal values, ties of kinds included, become the same wherever they stand; repeated rows each
    return; other columns stay as they are, and one called ``found`` is an error; an empty table gives no rows.
    """
    if found in docs.columns:
        raise ValueError(f"there is a column {found!r} already")
    text = F.col("text")
    gaps = F.when(text.rlike("[@0-9]"), F.split(text, ANY, -1))
    hits = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0))
    told = F.transform(F.arrays_zip(F.col("_sg_gaps").alias("gap"), hits.alias("hit")), lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.when(x["hit"].isNotNull(), classify(x["hit"])).alias("kind")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def place(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(x["kind"].alias("kind"), begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["kind"].isNotNull(), F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    parts = docs.withColumn("_sg_gaps", gaps).withColumn("_sg_parts", F.when(F.size("_sg_gaps") > 1, told))
    new = F.array_join(F.transform("_sg_parts", lambda x: F.concat(x["gap"], F.coalesce(pseudonym(x["hit"], x["kind"], key), F.lit("")))), "")
    done = parts if found is None else parts.withColumn(found, F.coalesce(fold_running(F.col("_sg_parts"), start, place, "found")["found"], empty))
    done = done.withColumn("text", F.when(F.col("_sg_parts").isNull(), text).otherwise(new))
    return done.drop("_sg_gaps", "_sg_parts")


def pii_report(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_<kind>..., spans): the pseudonymised text, counts, and kind:start:end comma-joined.

    One row for each row of ``docs``, repeated ones included; null and empty texts have no spans; other columns are
    ignored; an empty table gives no rows.
    """
    done = pseudonymise(docs.select("doc_id", "text"), key, "_sg_found")
    count = lambda kind: F.size(F.filter("_sg_found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("_sg_found", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return done.select("doc_id", "text", *map(count, KINDS), spans.alias("spans"))
