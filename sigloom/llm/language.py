"""Language identification by error-correcting output codes over hashed letter n-grams.

Each language has a codeword of signs. For each bit a binary naive Bayes classifier over letter pairs and triples
tells the languages of its two signs apart; a text's margins are compared to every codeword by a loss weighted with
the bits' reliability, and the nearest codeword wins. Near ties are flagged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import SLICE, kept, map_slices, small_batches

#: Hash buckets of n-grams, and labelled texts of each language that are learned from (about).
BUCKETS, SAMPLE = 1 << 13, 1_500
#: Values of the hash that draws them.
DRAWS = 1 << 62
#: Texts under this score are rejected, and those whose two best losses are this near are ambiguous.
REJECT, NEAR = 0.3, 0.02
TOLD = "_sg_told"


def _letter_table() -> np.ndarray:
    held = kept("language")
    if "letters" not in held:
        held["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return held["letters"]


def grams(text: str | None) -> np.ndarray:
    """Buckets of the letter pairs and triples of the whole lower-cased text; every run of other characters is one gap.
    Empty if the text has no letter."""
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[c]
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.where(letter, c, 0)
    c = np.concatenate((np.zeros(1, np.uint32), c[letter | np.concatenate(([True], letter[:-1]))], np.zeros(1, np.uint32)))
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.concatenate((two >> shift, three >> shift)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 over 4; a null id counts as an empty text, so it is not held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def share_of(count: int, sample: int) -> int:
    """The draws under which a row of a language of ``count`` rows is learned from: exact for any count, never none."""
    return DRAWS if count <= sample else max(1, DRAWS * sample // count)


def gram_counts(train: DataFrame) -> dict[str, np.ndarray]:
    """Counts of each bucket by language: languages x BUCKETS numbers, whatever the sample."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own[lang] = own.get(lang, 0) + np.bincount(grams(text), minlength=BUCKETS)
        at = {lang: np.flatnonzero(n) for lang, n in own.items()}
        names = [lang for lang, k in at.items() for _ in range(len(k))]
        flat = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(flat(at.values(), np.int32)), pa.array(flat([own[x][k] for x, k in at.items()], np.int64))], ["lang", "bucket", "n"])

    found = map_slices(train.select("lang", "text"), run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for r in found.collect():
        out.setdefault(r.lang, np.zeros(BUCKETS))[r.bucket] = r.n
    return out


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of signs: every dichotomy up to 5 languages, else the best-separated of random dense codes."""
    if k < 2:
        return np.ones((k, 1), np.int8)
    if k <= 5:
        return np.array([[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for b in range(2 ** (k - 1) - 1)] for i in range(k)], np.int8)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    tried = [rng.choice(np.array([-1, 1], np.int8), (k, bits)) for _ in range(50)]
    apart = lambda c: int((bits - np.abs(c.astype(int) @ c.T - 2 * bits * np.eye(k, dtype=int))).min() + (np.abs(c.sum(0)) < k).all())
    return max(tried, key=apart)


def fit(counts: dict[str, np.ndarray]) -> dict:
    """The model: languages, codewords, weights (BUCKETS x bits) of the log odds, and the bits' reliability."""
    langs = sorted(counts)
    code = codewords(len(langs))
    p = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS) for x in langs]) if langs else np.zeros((0, BUCKETS))
    weights, trust = np.zeros((BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1])
    for b in range(code.shape[1] if len(langs) > 1 else 0):
        plus, minus = p[code[:, b] > 0].mean(0), p[code[:, b] < 0].mean(0)
        weights[:, b] = np.log(plus / minus)
        margin = (p @ weights[:, b]) * code[:, b]  # each language's own text, on average
        trust[b] = max(margin.min(), 1e-3)
    return {"langs": langs, "code": code, "weights": weights, "trust": trust}


def decode(model: dict, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codeword, score, ambiguous) of rows of margins, by the logistic loss weighted with each bit's reliability."""
    code, trust = model["code"].astype(np.float64), model["trust"]
    loss = np.stack([(np.logaddexp(0, -4 * margins * c / trust) * trust).sum(1) / trust.sum() for c in code], 1)
    like = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
    two = np.sort(loss, 1)
    near = two[:, 1] - two[:, 0] < NEAR if loss.shape[1] > 1 else np.zeros(len(loss), bool)
    return loss.argmin(1), like.max(1) / like.sum(1), near


def labelled_sample(docs: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` rows of each language, drawn by a hash of id and text, among rows that are not held out and have a
    language and a text. Every language has its share, however many there are and however large they are."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = [(r["lang"], share_of(r["count"], sample)) for r in known.groupBy("lang").count().collect()]
    shares = F.broadcast(docs.sparkSession.createDataFrame(sizes, "lang string, _share long"))  # a row for each language
    return known.select("doc_id", "text", "lang").join(shares, "lang").where(F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(DRAWS)) < F.col("_share"))


def told(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, ambiguous) of each text."""
    pred, score, flag = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    margins, rows = [], []
    for k, text in enumerate(texts if model["langs"] else ()):
        if len(g := grams(text)):
            rows.append(k)
            margins.append(np.bincount(g, minlength=BUCKETS).astype(np.float32) @ model["weights"] / len(g))
    if rows:
        best, score[rows], flag[rows] = decode(model, np.array(margins, np.float64))
        for k, b in zip(rows, best.tolist()):
            pred[k] = model["langs"][b]
    return pred, score, flag


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with the column ``_sg_told`` (lang_pred, score, ambiguous).

    Learns from ``labelled_sample``. Null, empty and letterless texts, and all texts if nothing can be learned, are
    ``und`` with score 0; of tied codewords the first language by name wins, flagged as ambiguous; repeated rows each
    return; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        counts = gram_counts(labelled_sample(docs, sample))
    model = docs.sparkSession.sparkContext.broadcast(fit(counts))  # languages x bits and BUCKETS x bits numbers

    @F.arrow_udf("struct<lang_pred: string, score: double, ambiguous: boolean>")
    def tell(texts: pa.Array) -> pa.Array:
        parts = [told(model.value, texts.slice(at, SLICE).to_pylist()) for at in range(0, len(texts), SLICE)]
        flat = [pa.array([x for p in parts for x in p[0]], pa.string()), *[pa.array(np.concatenate([np.empty(0, kind), *[p[k] for p in parts]]).astype(kind)) for k, kind in ((1, np.float64), (2, bool))]]
        return pa.StructArray.from_arrays(flat, ["lang_pred", "score", "ambiguous"])

    return docs.withColumn(TOLD, tell("text"))


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row of ``docs``, by ``identify`` and with its handling of
    nulls, empty texts, ties and repeated rows; other columns are ignored."""
    return identify(docs.select("doc_id", "text", "lang")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), f"{TOLD}.*")


def keep_identified(docs: DataFrame, least: float = REJECT) -> DataFrame:
    """Rows of ``docs`` whose language is told with a score of ``least`` or more; all columns as they are. Null and empty texts
    and those without letters have no language and go; rows with null ids and repeated rows are judged like others; a tie
    of languages has a low score; columns of any name stay; an empty table gives no rows."""
    kept = identify(docs).where((F.col(f"{TOLD}.lang_pred") != "und") & (F.col(f"{TOLD}.score") >= least))
    return kept.select(*docs.columns)
