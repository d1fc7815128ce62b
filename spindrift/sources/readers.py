"""File sources as frames, and the writers that pair with them. All paths are Hadoop paths, so object stores need no code."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_rows(spark: SparkSession, path: str, separator: str = ",", schema: str | None = None) -> DataFrame:
    """A delimited file with a header; without a schema all columns are strings, so that no pass over the data infers them."""
    reader = spark.read.option("header", True).option("sep", separator).option("multiLine", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def row_lines(rows: DataFrame, columns: list[str], mark: str = "：", separator: str = "; ") -> DataFrame:
    """Each row as one line 'column：value; ...' of its non-empty values, in a column ``line``."""
    parts = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(c + mark), F.col(c).cast("string"))) for c in columns]
    return rows.withColumn("line", F.concat_ws(separator, *parts))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """(path, subject, sender, text) of .eml files: plain parts, else HTML parts without markup."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                mail = email.message_from_bytes(bytes(content), policy=email.policy.default)
                body = mail.get_body(preferencelist=("plain", "html"))
                rows.append((path_, str(mail["subject"] or ""), str(mail["from"] or ""), body.get_content() if body else ""))
            yield pd.DataFrame(rows, columns=["path", "subject", "sender", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, subject string, sender string, text string")


def ranked_passages(rows: DataFrame, query: str, texts: str, marks: str) -> DataFrame:
    """(query, pos, passage, mark) from parallel arrays, as question answering benchmarks store their passages."""
    both = F.posexplode(F.arrays_zip(F.col(texts).alias("t"), F.col(marks).alias("m")))
    return rows.select(query, both.alias("pos", "z")).select(query, "pos", F.col("z.t").alias("passage"), F.col("z.m").alias("mark"))
