"""Files in and out: texts, binary documents behind a decoder, grids and words; JSON, CSV and run reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions.textops import reject_reason

#: Largest accepted binary document, and the first bytes it must have.
MAX_BINARY, MAGIC = 25_000_000, b"%PDF"
WORDS = "doc_id bigint, page int, seq int, text string, x0 double, x1 double, top double, bottom double, bold boolean"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, raw, reject_reason): one row for each text file; the id is the hash of the file's name, refused texts keep their reason."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
    return files.select(F.xxhash64("file").alias("doc_id"), "file", "raw", reject_reason(F.col("raw")).alias("reject_reason"))


def binary_reject_reason(content: Column) -> Column:
    """empty, too_large or not_pdf, first failure first, or null."""
    return F.when(content.isNull() | (F.length(content) == 0), "empty").when(F.length(content) > MAX_BINARY, "too_large").when(~F.startswith(content, F.lit(MAGIC)), "not_pdf")


def read_binaries(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc_id, file, content, reject_reason) of the binary documents under a path, sub-folders too; refused ones keep their reason and lose their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    reason = binary_reject_reason(F.col("content"))
    return files.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("file"), F.when(reason.isNull(), F.col("content")).alias("content"), reason.alias("reject_reason"))


def decode_words(files: DataFrame, decoder: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """words (see operators.geometry) and an error for each document that could not be decoded: (words columns, error STRING).

    decoder gives (page, seq, text, x0, x1, top, bottom, bold) of a document's content. One bad document gives one row with its
    error and stops nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in WORDS.split(", ")] + ["error"]
        for pdf in batches:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                try:
                    rows = [(doc_id, *w, None) for w in decoder(bytes(content))]
                except Exception as problem:  # noqa: BLE001
                    rows = [(doc_id, *[None] * 8, f"{type(problem).__name__}: {problem}"[:200])]
                yield pd.DataFrame(rows, columns=names)

    return files.where("content IS NOT NULL").select("doc_id", "content").mapInPandas(run, WORDS + ", error string")


def without_text_layer(files: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id): documents none of whose pages holds a word."""
    return files.where("reject_reason IS NULL").select("doc_id").join(words.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_anti")


def to_json(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, json): each row as one JSON object, nulls included."""
    return df.select(id_col, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, keep: list[str] | None = None) -> None:
    """A folder of CSV files with header and CRLF line ends, quoted where needed; with ``order`` the rows of the files, one after the other, in that order."""
    df = df.orderBy(*order) if order else df
    df.select(*(keep or df.columns)).write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def csv_text(df: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """(keys, csv): each key's rows as CSV with header and CRLF line ends, in reading order, which the columns ``order`` give; equal places by their text."""
    quoted = lambda c: F.when(F.col(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c), F.lit("")))
    line = F.concat_ws(",", *[quoted(c) for c in columns])
    head = ",".join(f'"{c}"' if "," in c else c for c in columns)
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], line.alias("l")))).alias("ls"))
    return lists.select(*keys, F.concat(F.lit(head + "\r\n"), F.array_join(F.transform("ls", lambda x: F.concat(x["l"], F.lit("\r\n"))), "")).alias("csv"))


def run_report(summaries: DataFrame, flags: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(doc_id, file, rows, pages, pages_with_rows, columns_detected, columns_mapped, columns_unmapped, strategies, flags, csv, error): one row for each document.

    files: doc_id, file, pages INT, csv, error of the run's files; a file with an error stays in the report with its error alone."""
    told = flags.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule", "severity", "n"))).alias("flags"))
    null = F.lit(None).cast("string")
    known = summaries.select("doc_id", null.alias("file"), F.lit(None).cast("int").alias("pages"), null.alias("csv"), null.alias("error")) if files is None else files.select("doc_id", "file", "pages", "csv", "error")
    out = known.join(summaries, "doc_id", "left").join(told, "doc_id", "left")
    flags_ = F.coalesce("flags", F.array().cast("array<struct<rule:string,severity:string,n:bigint>>"))
    return out.select(
        "doc_id", "file", F.when(F.col("error").isNull(), F.coalesce("n_rows", F.lit(0))).alias("rows"), "pages", "pages_with_rows", F.col("labels").alias("columns_detected"), F.col("mapped").alias("columns_mapped"),
        F.col("unmapped").alias("columns_unmapped"), "strategies", flags_.alias("flags"), F.when(F.col("error").isNull(), F.col("csv")).alias("csv"), "error",
    )
