"""Raw text to pages without repeated headers, and to one flat text with offsets (stage 1 of the text path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfacts.functions import textops as X
from docfacts.functions.tables import spread

#: A page's first line; a parameter.
PAGE_ANCHOR = r"(?m)^[ \t]*(\d{1,4})[ \t]+(?:19|20)\d{2}\s+Evidence of Coverage"
#: Least length of a repeated line, pages it must stand on, lines of a page's head and foot.
MIN_LENGTH, MIN_PAGES, HEAD_LINES, FOOT_LINES = 15, 2, 5, 3


def pages(docs: DataFrame, raw: str = "raw", anchor: str = PAGE_ANCHOR, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page_seq INT, page INT, body): the text from each page anchor to the next.

    Text before the first anchor, or of a document without one, is a page without number. Null and empty texts give no row.
    Columns to carry come along.
    """
    parts = F.split(F.regexp_replace(F.translate(F.col(raw), X.OPEN, ""), anchor, X.OPEN + "$0"), X.OPEN, -1)
    cut = docs.select("doc_id", *carry, F.posexplode(parts).alias("page_seq", "body")).where("body <> ''")
    return cut.select("doc_id", "page_seq", F.nullif(F.regexp_extract("body", "^" + anchor.replace("(?m)^", ""), 1), F.lit("")).cast("int").alias("page"), "body", *carry)


def page_lines(pages_: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page_seq, page, line_no INT, line, key, in_zone): folded lines with their digit-masked form and whether they stand in the page's head or foot.

    Folding is done once for each page, not for each line: it neither makes nor removes line ends. Carried columns stand in
    a page's first line."""
    split = pages_.withColumn("ls", X.lines(X.fold(F.col("body")))).withColumn("n", F.size("ls"))
    # The outer form, without its empty row: for the inner one Spark infers a filter on the lines' number and folds every page for it once more.
    rows = split.select("doc_id", "page_seq", "page", "n", *carry, F.posexplode_outer("ls").alias("line_no", "line")).where("line_no IS NOT NULL")
    zone = (F.col("line_no") < HEAD_LINES) | (F.col("line_no") >= F.col("n") - FOOT_LINES)
    return rows.select("doc_id", "page_seq", "page", "line_no", "line", F.regexp_replace(F.trim(X.squeeze(F.col("line"))), r"\d+", "#").alias("key"), zone.alias("in_zone"), *[F.when(F.col("line_no") == 0, F.col(c)).alias(c) for c in carry])


def mark_boilerplate(lines: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """lines with ``boilerplate`` (the key repeats over pages and stands in a head or foot somewhere) and ``dropped`` (a later copy inside a head or foot).

    The first copy stays, and so do copies in the middle of a page. Keys shorter than MIN_LENGTH are never boilerplate.
    """
    same = Window.partitionBy("doc_id", "key")
    order = same.orderBy("page_seq", "line_no")
    distinct = F.size(F.collect_set("page_seq").over(same)) if min_pages > 2 else F.when(F.max("page_seq").over(same) > F.min("page_seq").over(same), 2).otherwise(1)
    boiler = (F.char_length("key") >= MIN_LENGTH) & (distinct >= min_pages) & F.max("in_zone").over(same)
    marked = lines.withColumns({"boilerplate": boiler, "nth": F.row_number().over(order)})
    return marked.withColumn("dropped", F.col("boilerplate") & F.col("in_zone") & (F.col("nth") > 1)).drop("nth")


def normalize(docs: DataFrame, raw: str = "raw", anchor: str = PAGE_ANCHOR) -> DataFrame:
    """(doc_id, text, flat, page_starts ARRAY<STRUCT<start, page>>, n_pages, n_dropped, n_chars, content_sha256).

    docs: doc_id, raw. text keeps the lines, flat has single blanks; page starts are places in flat. Documents that
    reject_reason refuses, or with too little text left, give no row. One shuffle, by document.
    """
    carry = ("content_sha256", "n_chars")
    usable = docs.select("doc_id", F.col(raw).alias("raw")).where(X.reject_reason(F.col("raw")).isNull())
    usable = usable.withColumns({"content_sha256": F.sha2("raw", 256), "n_chars": F.char_length("raw")})
    marked = mark_boilerplate(page_lines(spread(pages(usable, "raw", anchor, carry), "doc_id"), carry))
    clean = F.trim(F.regexp_replace("line", "[ \t]+", " "))
    kept = marked.withColumn("clean", F.trim(F.regexp_replace(clean, r"(?U)^[\s\x1F]+|[\s\x1F]+$", "")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("dropped") & (F.col("clean") != ""), F.struct("line_no", "clean")))), lambda x: x["clean"]), "\n")
    paged = kept.groupBy("doc_id", "page_seq").agg(F.first("page", ignorenulls=True).alias("page"), text.alias("t"), F.count_if("dropped").alias("d"), *[F.max(c).alias(c) for c in carry])
    whole = paged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("page_seq", "page", "t")))).alias("ps"), F.sum("d").alias("n_dropped"), *[F.max(c).alias(c) for c in carry])
    # Pages begin and end without white space, so a page's place in flat is the sum of the squeezed pages before it and their blanks.
    squeezed = F.transform("ps", lambda p: X.squeeze(p["t"]))
    whole = whole.select("doc_id", "n_dropped", *carry, "ps", F.size("ps").alias("n_pages"), F.array_join(F.transform("ps", lambda p: p["t"]), "\n").alias("text"), squeezed.alias("fs"))
    whole = whole.withColumns({"flat": F.array_join("fs", " "), "at": X.running(F.transform("fs", lambda f: F.char_length(f) + 1))})
    starts = F.zip_with("ps", "at", lambda p, at: F.struct(at.alias("start"), p["page"].alias("page")))
    out = whole.withColumn("page_starts", starts).where(F.char_length("flat") >= X.MIN_CHARS)
    return out.select("doc_id", "text", "flat", "page_starts", "n_pages", "n_dropped", "n_chars", "content_sha256")
