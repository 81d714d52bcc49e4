"""Readers and writers of recordings, augmented data, features and result files."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def write_wide_csv(rows: DataFrame, path: str, key: str, at: str, subject: Column, game: Column, channels: list[str]) -> None:
    """A file ``path/SxxGyAllChannels.csv`` for each recording ``key``: a header and its rows' channels in order of ``at``.

    Tasks write the files, a batch of rows at a time, so recordings may be of any length, and a file needs no folder of its
    own and no step of the driver. A file gets its name when it is whole. Arrow must know the file system of ``path``.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place)
    first = F.row_number().over(W.partitionBy(key).orderBy(at)) == 1
    lines = rows.select(F.when(first, F.format_string("S%02dG%dAllChannels.csv", subject, game)).alias("name"), F.to_csv(F.struct(*channels)).alias("line"))
    lines.mapInArrow(_written(store.makeQualified(place).toString(), ",".join(channels)), "files long").write.format("noop").mode("overwrite").save()


def _written(path: str, header: str):
    """Of rows (name, line), those without a name being lines of the file named before, how many files were written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = FileSystem.from_uri(path)
        out, made, n, name = None, f"{folder}/_{uuid.uuid4().hex}", 0, None
        for batch in batches:
            names, lines = batch.columns
            begins = np.flatnonzero(names.is_valid())
            parts = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], begins, [len(lines)]]).astype(np.int32), lines), "\n")
            for begin, part in zip([None, *begins], parts):
                if begin is not None:
                    if out:
                        out.close()
                        store.move(made, name)
                    out, name, n = store.open_output_stream(made, buffer_size=1 << 16), f"{folder}/{names[begin]}", n + 1
                    out.write(f"{header}\n".encode())
                if len(text := part.as_buffer()):
                    out.write(text)
                    out.write(b"\n")
        if out:
            out.close()
            store.move(made, name)
        yield pa.RecordBatch.from_pydict({"files": [n]})

    return write


def read_wide_csv(spark: SparkSession, path: str, channels: list[str], subjects: list[int] | None = None) -> DataFrame:
    """(subject_id, game, idx, one column for each channel) of files ``.../SxxGyAllChannels.csv``.

    Only the named channels are kept. ``path`` names files, or with ``subjects`` their folder, and then no other subject's
    files are listed or read; missing files are skipped, and a folder without any gives no rows. Folders are listed whole, not
    file by file, and one file's first line names the columns of all. Spark reads a file in ranges of bytes, several of them a
    task. A row's place counts from 0 over the whole file: its number within its range, which tasks count as they read, behind
    the rows of the ranges before, which only files large enough to be cut have; a first pass counts their rows. Values have no
    line breaks in them.
    """
    reader = lambda: spark.read.option("ignoreMissingFiles", "true")
    folder, _, name = path.rpartition("/")
    if subjects is not None:
        folder, name = path, "S{" + ",".join(f"{s:02d}" for s in subjects) + "}G*AllChannels.csv"
    if folder and re.search(r"[*?\[{]", name) and name.count("{") == name.count("}"):
        path, listed = folder, lambda: reader().option("pathGlobFilter", name)
    else:
        listed = reader
    head = listed().text(path).where((F.col("_metadata.file_block_start") == 0) & F.col("value").rlike(r"\S")).select("value").first()
    columns = spark.read.csv(spark.sparkContext.parallelize([head.value], 1), header=True).columns if head else channels
    raw = listed().schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path, header=True)

    part = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    cut = F.col("_metadata.file_size") > _least_cut(spark)  # no file up to that size has a second range
    kept = lambda rows: rows.select(*part, *[F.col(c).cast("double").alias(c) for c in channels])
    counts = raw.where(cut).select(*part).groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # A row for each range of a cut file, of some megabytes, so the table is small beside the input.
    large = kept(raw.where(cut)).join(F.broadcast(offsets), ["_file", "_block"], "left")
    small = kept(raw.where(~cut)).withColumn("_before", F.when(F.col("_block") == 0, 0).cast("long"))
    known = F.coalesce("_before", F.raise_error(F.lit("a file was cut in other ranges when its rows were counted")).cast("long")).alias("_before")
    result = T.StructType([T.StructField(c, T.IntegerType()) for c in ("subject_id", "game", "idx")] + [T.StructField(c, T.DoubleType()) for c in channels])
    return small.unionByName(large).select("_file", "_block", known, *channels).mapInArrow(_numbered, result)


def _least_cut(spark: SparkSession) -> int:
    """Bytes that a range of a file has at least, unless it is the file's last."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    return min(size(spark.conf.get(f"spark.sql.files.{c}")) for c in ("maxPartitionBytes", "openCostInBytes"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(subject, game, place, channels) of rows (file, range, rows before it, channels), which come in order of reading."""
    held, n = None, 0
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        files, blocks = batch.column(0), batch.column(1)
        other = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(other) + 1])
        lengths = np.diff(starts, append=size)
        ranges = [(files[i].as_py(), blocks[i].as_py()) for i in starts.tolist()]
        place = np.arange(size) - np.repeat(starts, lengths)
        if ranges[0] == held:
            place[: lengths[0]] += n
        held, n = ranges[-1], int(place[-1]) + 1
        names = [re.search(r"S(\d+)G(\d+)AllChannels\.csv$", f) for f, _ in ranges]
        if None in names:
            raise ValueError(f"not named SxxGyAllChannels.csv: {ranges[names.index(None)][0]}")
        ids = np.repeat(np.array([[int(k) for k in m.groups()] for m in names], np.int32), lengths, axis=0)
        idx = pa.array(place + batch.column(2).to_numpy()).cast(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), idx, *batch.columns[3:]], ["subject_id", "game", "idx", *batch.schema.names[3:]])


def read_partitioned(spark: SparkSession, path: str, dataset: str, known: tuple[str, ...], subjects: list[int] | None = None) -> DataFrame:
    """Rows of a dataset, its name in any case, and of some or all subjects; folders of others are not read."""
    if dataset.lower() not in {k.lower() for k in known}:
        raise ValueError(f"unknown dataset {dataset!r}: one of {', '.join(known)}")
    rows = spark.read.parquet(path).where(F.col("dataset") == dataset.lower())
    return rows if subjects is None else rows.where(F.col("subject_id").isin(subjects))


def write_dataset(rows: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "technique")) -> DataFrame:
    """Write rows in a folder for each value of ``by``, and beside them the counts, which are returned."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/data")
    counts = rows.sparkSession.read.parquet(f"{path}/data").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").json(f"{path}/counts")
    return counts


def write_by_subject(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("subject_id").parquet(path)


def feature_cache(spark: SparkSession, root: str, config: dict, make) -> DataFrame:
    """The features of ``make()`` under a folder named by the configuration's hash; read if it is there."""
    path = f"{root}/{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    """(model_name, classification_type, accuracy, precision, recall, f1_score, roc_auc) of ``*_results.json``."""
    names = ("accuracy", "precision", "recall", "f1_score", "roc_auc")
    schema = T.StructType().add("model_name", "string").add("classification_type", "string").add("metrics", T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    return spark.read.schema(schema).json(f"{path}/*_results.json", multiLine=True).select("model_name", "classification_type", "metrics.*")


def read_history_json(spark: SparkSession, path: str) -> DataFrame:
    """(phase, metric, epoch, value) of training histories; epochs count from 1."""
    part = "STRUCT<loss: ARRAY<DOUBLE>, accuracy: ARRAY<DOUBLE>>"
    raw = spark.read.schema(f"train {part}, val {part}").json(path, multiLine=True)
    lists = raw.selectExpr("stack(4, 'train', 'loss', train.loss, 'train', 'accuracy', train.accuracy, 'val', 'loss', val.loss, 'val', 'accuracy', val.accuracy) AS (phase, metric, values)")
    return lists.select("phase", "metric", F.posexplode("values").alias("at", "value")).select("phase", "metric", (F.col("at") + 1).alias("epoch"), "value")


def metrics_summary(averaged: DataFrame, per_class: DataFrame, confidence: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row of overall, per-class and confidence figures and the confusion matrix, in class order, for a JSON file."""
    overall = averaged.agg(F.map_from_entries(F.collect_list(F.struct("average", F.struct("precision", "recall", "f1")))).alias("overall_metrics"))
    each = per_class.agg(F.sort_array(F.collect_list(F.struct("class", "precision", "recall", "f1", "support"))).alias("per_class_metrics"))
    rows = matrix.groupBy("y_true").agg(F.transform(F.sort_array(F.collect_list(F.struct("y_pred", "n"))), lambda x: x["n"]).alias("row"))
    cells = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("y_true", "row"))), lambda x: x["row"]).alias("confusion_matrix"))
    return overall.crossJoin(each).crossJoin(confidence.select(F.struct("*").alias("confidence_stats"))).crossJoin(cells)


def read_metrics_summary(spark: SparkSession, path: str) -> DataFrame:
    """(part, name, value) of documents of ``metrics_summary``: overall figures by average, those of each class, confidence
    and the cells of the matrix."""
    prf = "precision DOUBLE, recall DOUBLE, f1 DOUBLE"
    doc = spark.read.schema(f"overall_metrics MAP<STRING, STRUCT<{prf}>>, per_class_metrics ARRAY<STRUCT<class INT, {prf}, support DOUBLE>>, confidence_stats MAP<STRING, DOUBLE>, confusion_matrix ARRAY<ARRAY<DOUBLE>>").json(path)
    row = lambda part, name, value: F.struct(F.lit(part).alias("part"), name.alias("name"), value.alias("value"))
    named = lambda key, c: F.concat_ws(":", key, F.lit(c))
    three = ("precision", "recall", "f1")
    overall = F.flatten(F.transform(F.map_entries("overall_metrics"), lambda e: F.array(*[row("overall", named(e["key"], c), e["value"][c]) for c in three])))
    classes = F.flatten(F.transform("per_class_metrics", lambda e: F.array(*[row("class", named(e["class"].cast("string"), c), e[c]) for c in (*three, "support")])))
    confidence = F.transform(F.map_entries("confidence_stats"), lambda e: row("confidence", e["key"], e["value"]))
    cells = F.flatten(F.transform("confusion_matrix", lambda r, i: F.transform(r, lambda n, j: row("matrix", F.concat_ws(":", i, j), n))))
    return doc.select(F.explode(F.concat(overall, classes, confidence, cells)).alias("e")).select("e.*")
