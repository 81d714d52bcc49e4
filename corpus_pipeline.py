"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm.language import keep_identified
from sigloom.llm.lines import drop_lines
from sigloom.llm.packing import pack_documents
from sigloom.llm.secrets import redact
from sigloom.llm.similar import keep_first_alike
from sigloom.scratch import mark, new_folder, release


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go, null and empty texts with them; repeated rows stay; no rows give none."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, also if one edit apart; the first of each class stays. A null text stays null, and a document
    that loses every line has an empty text; every row stays; no rows give none."""
    return drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word similarity of 0.8 or more stays, that of the smallest doc_id (a null
    id before others). Null, empty and wordless texts are one group; of repeated rows one stays; no rows give none."""
    return keep_first_alike(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced by a mark; null and empty texts and every row stay; no rows give none."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is tokenized and packed into sequences; null and empty texts are their end id alone; repeated rows
    are packed as often as they come; no rows give none."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]
#: No stage but the last could be told in SQL: their rows are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the table ``documents`` of ``sf_dir``. Once a stage is written, what it read of earlier
    ones and its own scratch tables go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since = mark(spark)
        made = stage(spark, docs, sf_dir)
        folder = new_folder(spark, name)
        made.write.parquet(folder)
        docs = spark.read.parquet(folder)
        release(spark, max(0, since - (name != STAGES[0][0])), keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
