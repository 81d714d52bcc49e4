import datetime
import hashlib
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sigloom.llm import pii, secrets

KEY = "k"


def prf(tweak, turn, value):
    return hashlib.sha256(f"{KEY}|{tweak}|{turn}|{value}".encode()).hexdigest()


def pair(left, right, sizes, tweak):
    for i in range(8):
        add = lambda v: int(prf(tweak, i, v)[:15], 16)  # noqa: B023, E731
        if i % 2 == 0:
            left = (left + add(right)) % sizes[0]
        else:
            right = (right + add(left)) % sizes[1]
    return left, right


def moved(text, tweak, turn, value):
    out = ""
    for i, c in enumerate(text):
        by = int(prf(tweak, turn, f"{value}|{i // 32}")[i % 32 * 2 :][:2], 16)
        first, size = ("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26)
        out += chr((ord(c) - ord(first) + by) % size + ord(first)) if c.isascii() and c.isalnum() else c
    return out


def permuted(text, tweak):
    if len(text) == 1:
        for first, size in (("0", 10), ("a", 26), ("A", 26)):
            at = ord(text) - ord(first)
            if 0 <= at < size:
                p = pair(at * 2 // size, at % (size // 2), (2, size // 2), f"{tweak}:{first}")
                return chr(p[0] * (size // 2) + p[1] + ord(first))
        return text
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for i in range(8):
        if i % 2 == 0:
            left = moved(left, tweak, i, right) if left else left
        else:
            right = moved(right, tweak, i, left) if right else right
    return left + right


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))


def refill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def day_of(hit):
    n = [int(x) for x in re.split("[-/.]", hit)]
    y, m, d = n if "-" in hit else (n[2], n[0], n[1]) if "/" in hit else n[::-1]
    try:
        at = (datetime.date(y, m, d) - datetime.date(1900, 1, 1)).days
    except ValueError:
        return None
    return at if 0 <= at < 270 * 271 else None


def classified(hit):
    full = lambda kind: re.fullmatch(pii.PATTERNS[kind], hit)
    if "@" in hit:
        return "email"
    if full("date"):
        return "date" if day_of(hit) is not None else None
    if full("ip"):
        return "ip" if all(int(x) <= 255 for x in hit.split(".")) else None
    if full("phone") and not full("card"):
        return "phone"
    if full("card"):
        return "card" if luhn(re.sub(r"\D", "", hit)) % 10 == 0 else "phone" if full("phone") else None
    return None


def pseudonym(hit, kind):
    digits = re.sub(r"\D", "", hit)
    if kind == "email":
        local, domain = hit.split("@")
        return f"{permuted(local, 'email')}@{domain}"
    if kind == "date":
        at = day_of(hit)
        p = pair(at // 271, at % 271, (270, 271), "date")
        day = datetime.date(1900, 1, 1) + datetime.timedelta(p[0] * 271 + p[1])
        return day.strftime("%Y-%m-%d" if "-" in hit else "%m/%d/%Y" if "/" in hit else "%d.%m.%Y")
    if kind == "ip":
        a, b, c, d = map(int, hit.split("."))
        p = pair(a * 256 + b, c * 256 + d, (65536, 65536), "ip")
        return f"{p[0] // 256}.{p[0] % 256}.{p[1] // 256}.{p[1] % 256}"
    if kind == "card":
        body = permuted(digits[:-1], "card")
        return refill(hit, body + str(-luhn(body + "0") % 10))
    if kind == "phone":
        country = m.group() if (m := re.match(r"\+[0-9]{1,3}(?=[ .(-])", hit)) else ""
        rest = hit[len(country) :]
        return country + refill(rest, permuted(re.sub(r"\D", "", rest), "phone"))
    return hit


def brute(text):
    """(text, spans) by matching from left to right with another engine."""
    if text is None:
        return None, ""
    out, spans, at = "", [], 0
    for m in re.finditer("|".join(f"(?:{p})" for p in pii.PATTERNS.values()), text):
        kind = classified(m.group())
        out += text[at : m.start()] + (pseudonym(m.group(), kind) if kind else m.group())
        at = m.end()
        spans += [f"{kind}:{m.start()}:{m.end()}"] * bool(kind)
    return out + text[at:], ",".join(spans)


ROWS = [
    (1, "call +1 (988) 555-2485 or mail jo.Doe42@mail.example.com, ip 192.168.7.255."), (2, "card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112"),
    (3, "born 1985-02-28, 28.02.1985 and 02/28/1985; never 1985-02-30 or 13/45/1999"), (4, None), (5, ""), (6, "999.1.1.1 and 1.2.3.4.5 stay"), (7, "é🙂 mail jo.Doe42@mail.example.com"), (8, "x" * 60000 + "@"),
    (8, "x" * 60000 + "@"), (9, "a@b.c Z@b.c 7@b.c -@b.c " + "Long.Name_" * 9 + "@host.example 555 123 4567 (212) 555-0199 +44 20 7946 0958"), (None, "1899-12-31 1900-01-01 2100-05-05 2000-02-29 1900-02-29"),
]


def test_spans_and_pseudonyms_match_brute_force(spark):
    whole = duckdb.connect().execute("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' WHERE regexp_matches(text, '[@0-9]')").fetchall() if Path("/root/testdata/sf0.01").exists() else []
    many = (50, " ".join(f"1{k % 10}.2.3.{k % 256} u{k}@h.io" for k in range(3000)))  # more spans than one chunk of the fold
    rows = [*ROWS, *whole, many]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, found int")
    got = pii.pii_report(df, KEY).collect()
    assert sorted(((r.doc_id, r.text, r.spans) for r in got), key=repr) == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    for r in got:
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k + ":") for s in r.spans.split(",")) for k in pii.KINDS]
    assert pii.pii_report(df.limit(0), KEY).count() == 0


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a@b.c", 7)], "doc_id long, text string, found int")
    got = pii.pseudonymise(df, KEY)
    assert got.columns == df.columns and got.first().found == 7 and got.first().text == brute("a@b.c")[0]
    assert [tuple(x) for x in pii.pseudonymise(df, KEY, "spans").first().spans] == [("email", 0, 5)]
    with pytest.raises(ValueError):
        pii.pseudonymise(df, KEY, "found")


def test_no_text_stops_a_task(spark):
    """A megabyte of repetitions that a backtracking matcher could follow into the ground."""
    parts = ["a@b.c" + ".c" * 500_000, "1.1" * 330_000, "+1 1" * 250_000, "a.b/c" * 200_000, "a@" * 500_000, "1" * 1_000_000, "x" * 1_000_000 + "1", "token=" * 160_000, "A" * 15 + "1" + "b-" * 400_000, "AKIA" * 250_000, "(1" * 500_000, "1 " * 500_000]
    df = spark.createDataFrame(list(enumerate(parts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.pii_report(df, KEY).collect()}
    assert len(got) == len(parts) and got[0].spans == f"email:0:{len(parts[0])}" and got[6].text == parts[6]
    assert secrets.secret_report(df).count() == len(parts)


def test_permutations(spark):
    n = pii.DAYS[0] * pii.DAYS[1]
    pairs = spark.range(n).select(pii.feistel_pair(F.floor(F.col("id") / pii.DAYS[1]), F.col("id") % pii.DAYS[1], pii.DAYS, "k", "t").alias("p"))
    assert pairs.distinct().count() == n
    texts = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    assert texts.select(pii.feistel_text(F.col("t"), "k", "t").alias("x")).distinct().count() == 1000
    moved = texts.select(pii.feistel_text(F.col("t"), "k", "t").alias("x"), pii.feistel_text(F.col("t"), "other", "t").alias("y")).where("x = y").count()
    assert moved < 30
    letters = spark.createDataFrame([(c,) for c in "abcdefghijklmnopqrstuvwxyz"], "t string").select("t", pii.feistel_text(F.col("t"), "k", "t").alias("x")).collect()
    assert len({r.x for r in letters}) == 26 and len({(ord(r.x) - ord(r.t)) % 26 for r in letters}) > 5  # no common step
