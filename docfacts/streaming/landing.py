"""A landing folder as a stream: submissions are de-duplicated by content and go through the text path batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docfacts.operators import jobs
from docfacts.plans import pipeline

SCHEMA = "doc_id bigint, raw string, received_at timestamp"


def submissions(spark: SparkSession, folder: str, lateness: str = "7 days") -> DataFrame:
    """The stream of new submissions (doc_id, raw, received_at, key): JSON lines, each content once within the lateness."""
    stream = spark.readStream.schema(SCHEMA).json(folder)
    keyed = stream.where("raw IS NOT NULL").withColumn("key", jobs.job_key(F.col("raw"), "1"))
    return keyed.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["key"])


def run(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream: packages of every batch to ``out``/packages, flags to ``out``/flags, under the batch's number, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        done = pipeline.extract(batch.select("doc_id", "raw"))
        flags, _ = done.validate()
        done.packages.write.mode("overwrite").parquet(f"{out}/packages/batch={number}")
        flags.write.mode("overwrite").parquet(f"{out}/flags/batch={number}")

    return submissions(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
