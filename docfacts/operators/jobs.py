"""Idempotent submission: each distinct content is one piece of work, and later copies are answered from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def job_key(content: Column, *parts: str) -> Column:
    """The key of a submission: hash of its content's hash and of what else decides the result (versions, model, seed)."""
    return F.sha2(F.concat_ws("|", F.sha2(content, 256), *[F.lit(p) for p in parts]), 256)


def submit(submissions: DataFrame, done: DataFrame | None = None, content: str = "content", id_col: str = "doc_id", parts: tuple[str, ...] = ("1",)) -> tuple[DataFrame, DataFrame]:
    """(work, replays): one row for each new key with its first submission (by id) and their number; and the key of every other submission.

    done: earlier keys (column key). Null contents are no submission. Copies are pre-aggregated, so one content may be any share of all."""
    keyed = submissions.where(F.col(content).isNotNull()).select(F.col(id_col).alias("id"), job_key(F.col(content), *parts).alias("key"))
    new = keyed if done is None else keyed.join(done.select("key").distinct(), "key", "left_anti")
    work = new.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_submissions"))
    firsts = work.select(F.col("first_id").alias("id"), F.lit(True).alias("first"))
    replays = keyed.join(firsts, "id", "left").where("first IS NULL").select("id", "key")
    return work, replays


#: Each error's code, whether another try may help, and its HTTP status.
ERRORS = {
    "extraction_error": (False, 500), "input_rejected": (False, 422), "job_not_found": (False, 404), "unsupported_projection": (False, 409), "llm_transient": (True, 503),
    "llm_permanent": (False, 502), "llm_output_invalid": (False, 502), "block_extraction_failed": (False, 500), "internal_error": (False, 500),
}


def error(code: str, message: Column, stage: str, details: Column | None = None) -> Column:
    """STRUCT<code, message, stage, retryable, http_status, details MAP<STRING, STRING>> of a failed job."""
    retryable, status = ERRORS[code]
    none = F.create_map().cast("map<string,string>")
    return F.struct(F.lit(code).alias("code"), message.alias("message"), F.lit(stage).alias("stage"), F.lit(retryable).alias("retryable"), F.lit(status).alias("http_status"), (none if details is None else details).alias("details"))


def text_jobs(submitted: DataFrame, packages: DataFrame, metrics: DataFrame, reason: Column) -> DataFrame:
    """(doc_id, kind, status, error, needs_review, n_packages): the state of each submitted text (doc_id, raw).

    Refused texts (reason: their reject reason, else null) have failed; those of which a block is degraded, or that didn't
    pass validation, are partial; the others succeeded. packages and metrics are those of the text path.
    """
    blocks = packages.groupBy("doc_id").agg(F.max("degraded").alias("degraded"), F.count(F.lit(1)).alias("n_packages"))
    out = submitted.withColumn("reason", reason).select("doc_id", "reason").join(blocks, "doc_id", "left").join(metrics.select("doc_id", "passed", "needs_review"), "doc_id", "left")
    refused = F.coalesce("reason", F.when(F.col("passed").isNull(), F.lit("too_short")))
    status = F.when(refused.isNotNull(), "failed").when(F.coalesce("degraded", F.lit(False)) | ~F.col("passed"), "partial").otherwise("succeeded")
    fault = F.when(refused.isNotNull(), error("input_rejected", refused, "input_validation"))
    return out.select("doc_id", F.lit("text").alias("kind"), status.alias("status"), fault.alias("error"), "needs_review", F.coalesce("n_packages", F.lit(0)).alias("n_packages"))


def guide_jobs(files: DataFrame, rows: DataFrame, flags: DataFrame) -> DataFrame:
    """(doc_id, kind, status, error, needs_review, row_count): the state of each guide (doc_id, reject_reason, error).

    Refused files and those that could not be decoded have failed; guides with a flag of an error are partial.
    """
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("row_count"))
    grave = flags.groupBy("doc_id").agg(F.max(F.col("severity") == "error").alias("failed"), F.max(F.col("severity").isin("error", "warn")).alias("flagged"))
    out = files.select("doc_id", "reject_reason", F.col("error").alias("broken")).join(counts, "doc_id", "left").join(grave, "doc_id", "left")
    bad = F.col("reject_reason").isNotNull() | F.col("broken").isNotNull()
    status = F.when(bad, "failed").when(F.coalesce("failed", F.lit(False)) | F.col("row_count").isNull(), "partial").otherwise("succeeded")
    fault = F.when(F.col("reject_reason").isNotNull(), error("input_rejected", F.col("reject_reason"), "input_validation")).when(F.col("broken").isNotNull(), error("internal_error", F.col("broken"), "dental_guide"))
    return out.select("doc_id", F.lit("dental_guide").alias("kind"), status.alias("status"), fault.alias("error"), F.when(~bad, F.coalesce("flagged", F.lit(False))).alias("needs_review"), F.when(~bad, F.coalesce("row_count", F.lit(0))).alias("row_count"))


def projection(jobs: DataFrame, form: str = "json") -> DataFrame:
    """jobs with ``refusal``: the error of a job that has no such projection; CSV is that of guides alone."""
    if form not in ("json", "csv"):
        raise ValueError(f"a job is read as json or csv, not {form}")
    wrong = F.when((F.lit(form) == "csv") & (F.col("kind") != "dental_guide"), error("unsupported_projection", F.lit("this job has packages, not benefit rows"), "serialize", F.create_map(F.lit("job_kind"), F.col("kind"))))
    return jobs.withColumn("refusal", wrong)


def kept_jobs(jobs: DataFrame, most: int = 1000, created: str = "created_at", id_col: str = "doc_id") -> DataFrame:
    """The newest ``most`` jobs, by creation and then id: the bound of a job store. The cut is found by a top-k, then applied to all rows."""
    edge = jobs.select(F.struct(F.col(created).alias("c"), F.col(id_col).alias("i")).alias("x")).orderBy(F.desc("x")).limit(most).agg(F.min("x").alias("least"))
    return jobs.join(F.broadcast(edge), F.struct(F.col(created).alias("c"), F.col(id_col).alias("i")) >= F.col("least")).select(jobs["*"])
