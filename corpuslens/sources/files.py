"""Readers and writers of raw corpora, feature tables and model artifacts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from corpuslens.operators.features import drop_missing
from corpuslens.operators.relational import map_label
from corpuslens.schema import COLUMNS, FEATURE_SCHEMA, ID, LABEL, STATEMENT_SCHEMA

ARTICLE_COLUMNS = ("title", "text")


def with_row_id(df: DataFrame, path: str, *fields: str, out: str = ID) -> DataFrame:
    """A stable key from the file and the content; equal rows of a file get tie numbers.

    A quoted multi-line file is read by one task, so its copies of a row - one
    window group - are never more than what one task has read already.
    """
    content = [F.coalesce(F.col(f).cast("string"), F.lit("\u0000")) for f in (path, *fields)]
    marked = df.withColumn("_h", F.xxhash64(*content))
    tie = F.row_number().over(Window.partitionBy("_h").orderBy(F.hash(*content)))
    key = F.concat_ws("-", F.lower(F.hex("_h")), tie.cast("string"))
    return marked.withColumn(out, key).drop("_h")


def _tree(spark: SparkSession, extension: str):
    return spark.read.option("recursiveFileLookup", True).option(
        "pathGlobFilter", f"*{extension}"
    )


def read_tree(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """Lines of every file under `folder` with exactly that extension, with the file name."""
    return _tree(spark, extension).text(folder).select("value", F.col("_metadata.file_name").alias("file_name"))


def read_statements(spark: SparkSession, folder: str, extension: str = ".tsv") -> DataFrame:
    """Statement files (tab-separated, no header) with `split`, `label` and `doc_id`.

    The split comes from the file name, never from listing order. An unknown
    label stops the job.
    """
    rows = (
        _tree(spark, extension)
        .schema(STATEMENT_SCHEMA)
        .option("sep", "\t")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .csv(folder)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    keyed = with_row_id(rows, "path", *STATEMENT_SCHEMA.names)
    split = F.regexp_extract("path", rf"([^/]+){re.escape(extension)}(/[^/]*)?$", 1)
    # A distributed writer leaves `train.tsv/part-...tsv`: the folder names the split.
    folder_name = F.regexp_extract("path", rf"([^/]+){re.escape(extension)}/[^/]*$", 1)
    name = F.when(folder_name != "", folder_name).otherwise(split)
    return keyed.withColumns({"split": name, LABEL: map_label(F.col(LABEL))}).drop("path")


def read_articles(spark: SparkSession, folder: str, fake_file: str = "Fake.csv") -> DataFrame:
    """Article files, one per class: `doc_id, part, text, label`.

    One scan yields both corpora: `part` is `title` or `text`. A folder with the
    file's name, as a distributed writer leaves it, counts as that file.
    """
    # The columns are addressed by header name, so files may carry others; a file
    # with another header than the first one is an error, never a silent misread.
    reader = (
        _tree(spark, ".csv")
        .option("header", True)
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
    )
    rows = reader.csv(folder).select(*ARTICLE_COLUMNS, F.col("_metadata.file_path").alias("path"))
    keyed = with_row_id(rows, "path", *ARTICLE_COLUMNS)
    fake = F.concat(F.lit("/"), F.col("path")).rlike(f"/{re.escape(fake_file)}(/[^/]*)?$")
    label = F.when(fake, 1).otherwise(0)
    return keyed.select(
        ID,
        label.alias(LABEL),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("text")) for c in ARTICLE_COLUMNS])
        ).alias("_p"),
    ).select(ID, "_p.part", "_p.text", LABEL)


def write_features(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = "split") -> None:
    """The processed table, one folder per split (or corpus)."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if by and by in df.columns:
        writer = writer.partitionBy(by)
    writer.format(fmt).save(path)


def read_features(spark: SparkSession, path: str, fmt: str = "parquet", extra: str = "") -> DataFrame:
    """The processed table without rows that miss a value or whose text is empty.

    `extra` names further columns of the table (DDL), such as the key and the split.
    """
    schema = FEATURE_SCHEMA
    if extra:
        schema = T.StructType(T.StructType.fromDDL(extra).fields + schema.fields)
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("enforceSchema", False)
    return drop_missing(reader.format(fmt).load(path))


class DatasetRegistry:
    """Name -> reader. An unknown name is an error unless a default is set."""

    def __init__(self, readers: dict[str, Callable[[], DataFrame]], default: str | None = None):
        self.readers, self.default = readers, default

    def load(self, name: str) -> DataFrame:
        if name not in self.readers:
            if self.default is None:
                raise KeyError(f"unknown dataset {name}; known: {sorted(self.readers)}")
            name = self.default
        return self.readers[name]()


def fit_or_load(path: str, estimator, df: DataFrame) -> PipelineModel:
    """The stored model if there is a whole one, else a fitted model that is stored first.

    An empty file `_COMPLETE` is written last: a folder without it was cut off by a failure.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    complete = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(hadoop, "_COMPLETE")
    if files.exists(complete):
        return PipelineModel.load(path)
    stages = estimator if isinstance(estimator, Pipeline) else Pipeline(stages=[estimator])
    model = stages.fit(df)
    model.write().overwrite().save(path)
    files.create(complete).close()
    return model


def columns_in_order(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in COLUMNS], *COLUMNS)
