"""The reader of unruled tables: positioned words to lines, column bands and rows.

words: doc_id, page, seq, text, x0, x1, top, bottom. Everything is worked out by page, and a page is bounded; what carries
over pages (labels, headings) does so over one row for each page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfacts.functions.tables import durable
from docfacts.operators.readers import CODE_TOKEN, HEADER_TOKENS

#: Points of a line's tolerance, of a gap between columns, of a cell over several rows; the page's margins.
LINE, GAP, SPAN, TOP, BOTTOM = 3, 5, 20, 0.06, 0.95
#: Most words of a header line, most points between stacked header lines, points before the first code without a header.
HEADER_WORDS, STACKED, LEAD = 12, 30, 30
PAGE = ["doc_id", "page"]


def _header_word(text: Column) -> Column:
    word = F.regexp_replace(F.lower(text), r"^[:?,.]+|[:?,.]+$", "")
    return F.exists(F.array(*[F.lit(t) for t in HEADER_TOKENS]), lambda t: F.contains(word, t))


def lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, line, words ARRAY<STRUCT<x0, seq, text, x1, top, bottom>>, top, bottom, left, has_code, score, pure): words of one
    line, left to right; a line is a third of a point's height, rounded half to even. score counts its distinct header words."""
    per = words.groupBy(*PAGE, F.bround(F.col("top") / LINE, 0).cast("int").alias("line")).agg(F.array_sort(F.collect_list(F.struct("x0", "seq", "text", "x1", "top", "bottom"))).alias("words"))
    first = F.element_at("words", 1)
    texts = F.transform("words", lambda w: F.regexp_replace(F.lower(w["text"]), r"^[:?,.]+|[:?,.]+$", ""))
    return per.select(
        *PAGE, "line", "words", first["top"].alias("top"), first["bottom"].alias("bottom"), first["x0"].alias("left"), F.exists("words", lambda w: w["text"].rlike(CODE_TOKEN)).alias("has_code"),
        F.size(F.filter(F.array_distinct(texts), lambda t: F.exists(F.array(*[F.lit(k) for k in HEADER_TOKENS]), lambda k: F.contains(t, k)))).alias("score"), F.forall("words", lambda w: _header_word(w["text"])).alias("pure"),
    )


def page_frames(lines_: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, page, width, height, code_right, first_code, header_line, body_top): what decides about a page that holds codes.

    The header is the line before the first code with most header words, two at least and at most HEADER_WORDS words; of equal
    ones the last."""
    codes = lines_.where("has_code")
    right = F.array_max(F.transform(F.filter("words", lambda w: w["text"].rlike(CODE_TOKEN)), lambda w: w["x1"]))
    per = codes.groupBy(*PAGE).agg(F.max(right).alias("code_right"), F.min("top").alias("first_code"))
    heads = lines_.join(per, PAGE).where((F.col("top") < F.col("first_code")) & (F.size("words") <= HEADER_WORDS) & (F.col("score") >= 2))
    heads = heads.groupBy(*PAGE).agg(F.max_by(F.struct("line", "top", "bottom"), F.struct("score", "line")).alias("h"))
    out = per.join(heads, PAGE, "left").join(sizes.select(*PAGE, "width", "height"), PAGE)
    return out.select(*PAGE, "width", "height", "code_right", "first_code", F.col("h.line").alias("header_line"), F.col("h.top").alias("header_top"), F.coalesce(F.col("h.bottom") + 1, F.col("first_code") - LEAD).alias("body_top"))


def body_lines(lines_: DataFrame, frames: DataFrame) -> DataFrame:
    """Lines of the body with furniture and heading marks: furniture stands in a margin without a code; a heading begins in the code column without one."""
    body = lines_.join(frames, PAGE).where(F.col("top") >= F.col("body_top"))
    furniture = ((F.col("top") < F.col("height") * TOP) | (F.col("bottom") > F.col("height") * BOTTOM)) & ~F.col("has_code")
    body = body.withColumn("furniture", furniture)
    return body.withColumn("heading", ~F.col("has_code") & (F.col("left") <= F.col("code_right") + 2) & ~F.col("furniture"))


def bands(lines_: DataFrame, body: DataFrame, frames: DataFrame) -> DataFrame:
    """(doc_id, page, band INT, lo, hi): the page's columns, cut in the middle of the gaps of GAP points or more that no word of data or header crosses.

    Gaps are those between the union of the words' intervals (gaps and islands); the space left of all words is no gap."""
    data = body.where("NOT heading AND NOT furniture").select(*PAGE, "width", F.explode("words").alias("__w"))
    head = lines_.join(frames.select(*PAGE, "width", F.col("header_line").alias("line")), [*PAGE, "line"]).select(*PAGE, "width", F.explode("words").alias("__w"))
    iv = data.unionByName(head).select(*PAGE, "width", F.floor("__w.x0").alias("a"), F.least(F.floor("__w.x1") + 1, F.floor("width")).alias("b")).where("a < b")
    before = Window.partitionBy(*PAGE).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    gaps = iv.withColumn("reach", F.max("b").over(before)).where(F.col("a") - F.col("reach") >= GAP)
    cuts = gaps.select(*PAGE, "width", ((F.col("reach") + F.col("a")) / 2).alias("cut"))
    per = frames.select(*PAGE, "width").join(cuts.groupBy(*PAGE).agg(F.array_sort(F.collect_set("cut")).alias("cuts")), PAGE, "left")
    edges = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.col("width").cast("double")))
    per = per.withColumn("edges", edges)
    return per.select(*PAGE, F.posexplode(F.expr("transform(sequence(0, size(edges) - 2), i -> struct(edges[i] AS lo, edges[i + 1] AS hi))")).alias("band", "e")).select(*PAGE, "band", "e.lo", "e.hi")


def words_in_bands(words: DataFrame, bands_: DataFrame) -> DataFrame:
    """words with the band that holds their middle: a range join inside the page."""
    mid = (F.col("x0") + F.col("x1")) / 2
    return words.join(bands_, PAGE).where((mid >= F.col("lo")) & (mid < F.col("hi"))).drop("lo", "hi")


def labels(lines_: DataFrame, frames: DataFrame, bands_: DataFrame) -> DataFrame:
    """(doc_id, page, labels ARRAY<STRING>): the words of the header line, and of a neighbouring line of header words alone, by band."""
    heads = frames.where("header_line IS NOT NULL").select(*PAGE, "header_line", "header_top")
    nth = Window.partitionBy(*PAGE).orderBy("line")
    near = lines_.withColumns({"prev": F.lag("line").over(nth), "next": F.lead("line").over(nth)}).join(heads, PAGE)
    stacked = ((F.col("next") == F.col("header_line")) | (F.col("prev") == F.col("header_line"))) & F.col("pure") & (F.size("words") <= HEADER_WORDS) & (F.abs(F.col("top") - F.col("header_top")) < STACKED)
    used = near.where((F.col("line") == F.col("header_line")) | F.coalesce(stacked, F.lit(False))).select(*PAGE, F.explode("words").alias("__w")).select(*PAGE, "__w.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.bround("top", 0).alias("t"), "x0", "seq", "text"))), lambda w: w["text"]), " ")
    per = words_in_bands(used, bands_).groupBy(*PAGE, "band").agg(text.alias("label"))
    return bands_.join(per, [*PAGE, "band"], "left").groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", F.coalesce("label", F.lit("")).alias("label")))), lambda x: x["label"]).alias("labels"))


def richer_labels(labels_: DataFrame) -> DataFrame:
    """labels where a page with as many columns as the pages before it takes, column by column, the longest label so far (of equally long ones the latest).

    Runs of pages of equal width are found first; over such a run the longest label is a running maximum."""
    doc = Window.partitionBy("doc_id").orderBy("page")
    wide = labels_.withColumn("n", F.size("labels")).withColumn("new", (F.col("n") != F.coalesce(F.lag("n").over(doc), F.lit(-1))).cast("int"))
    runs = wide.withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0))).select("doc_id", "page", "run", F.posexplode("labels").alias("band", "label"))
    so_far = Window.partitionBy("doc_id", "run", "band").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    longest = F.max(F.struct(F.char_length("label").alias("n"), F.col("page").alias("p"), F.col("label").alias("l"))).over(so_far)
    return runs.withColumn("b", longest).groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", F.col("b.l").alias("l")))), lambda x: x["l"]).alias("labels"))


def nearest_code_line(body: DataFrame) -> DataFrame:
    """(doc_id, page, line, anchor): the code line that each other data line belongs to: the nearest without a heading in between, of equally near ones the upper.

    Headings cut the page into sections; inside one the last code line above and the first below are the only candidates."""
    run = Window.partitionBy(*PAGE).orderBy("top", "line").rowsBetween(Window.unboundedPreceding, 0)
    parts = body.where("NOT furniture").withColumn("section", F.sum(F.col("heading").cast("int")).over(run)).where("NOT heading")
    up = Window.partitionBy(*PAGE, "section").orderBy("top", "line").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*PAGE, "section").orderBy("top", "line").rowsBetween(0, Window.unboundedFollowing)
    code = F.when(F.col("has_code"), F.struct("top", "line"))
    near = parts.withColumns({"above": F.last(code, ignorenulls=True).over(up), "below": F.first(code, ignorenulls=True).over(down)})
    lower = F.col("above").isNull() | (F.col("below.top") - F.col("top") < F.col("top") - F.col("above.top"))
    return near.where("above IS NOT NULL OR below IS NOT NULL").select(*PAGE, "line", F.when(F.col("below").isNotNull() & lower, F.col("below.line")).otherwise(F.col("above.line")).alias("anchor"))


def bind_rows(body: DataFrame, bands_: DataFrame) -> DataFrame:
    """(doc_id, page, y, grp, cells ARRAY<STRING>): one row for each code line, with the words of its wrapped lines, by band; grp is the heading above on the page."""
    anchors = nearest_code_line(body)
    words = body.select(*PAGE, "line", F.explode("words").alias("__w")).select(*PAGE, "line", "__w.*").join(anchors, [*PAGE, "line"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x0", "seq", "text"))), lambda w: w["text"]), " ")
    cells = words_in_bands(words, bands_).groupBy(*PAGE, "anchor", "band").agg(text.alias("cell"))
    run = Window.partitionBy(*PAGE).orderBy("top", "line").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.col("heading"), F.array_join(F.transform("words", lambda w: w["text"]), " "))
    heads = body.withColumn("grp", F.last(title, ignorenulls=True).over(run)).where("has_code").select(*PAGE, F.col("line").alias("anchor"), "grp", F.col("top").alias("y"))
    grid = heads.join(bands_.select(*PAGE, "band"), PAGE).join(cells, [*PAGE, "anchor", "band"], "left")
    return grid.groupBy(*PAGE, "anchor", "y", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", F.coalesce("cell", F.lit("")).alias("c")))), lambda x: x["c"]).alias("cells"))


def spread_merged_cells(rows: DataFrame, rects: DataFrame, words: DataFrame, bands_: DataFrame) -> DataFrame:
    """rows where a rectangle of SPAN points or more over two rows or more puts its text into its band of all of them; of several the later counts.

    rects: doc_id, page, seq, x0, x1, top, bottom. Containment joins inside the page."""
    tall = rects.where(F.col("bottom") - F.col("top") >= SPAN).select(*PAGE, F.col("seq").alias("r"), F.col("x0").alias("rx0"), F.col("x1").alias("rx1"), F.col("top").alias("rt"), F.col("bottom").alias("rb"))
    covered = tall.join(rows.select(*PAGE, "anchor", "y"), PAGE).where("y >= rt AND y <= rb").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "r"))).where("n >= 2")
    mid = (F.col("x0") + F.col("x1")) / 2
    inside = tall.join(words, PAGE).where((mid >= F.col("rx0")) & (mid <= F.col("rx1")) & (F.col("top") >= F.col("rt")) & (F.col("top") <= F.col("rb")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.bround("top", 0).alias("t"), "x0", "seq", "text"))), lambda w: w["text"]), " ")
    texts = inside.groupBy(*PAGE, "r").agg(text.alias("text"))
    banded = covered.join(bands_, PAGE).where("(rx0 + rx1) / 2 >= lo AND (rx0 + rx1) / 2 < hi").join(texts, [*PAGE, "r"])
    last = banded.groupBy(*PAGE, "anchor", "band").agg(F.max_by("text", "r").alias("text"))
    fills = last.groupBy(*PAGE, "anchor").agg(F.map_from_entries(F.collect_list(F.struct("band", "text"))).alias("fills"))
    out = rows.join(fills, [*PAGE, "anchor"], "left")
    return out.withColumn("cells", F.transform("cells", lambda c, i: F.coalesce(F.try_element_at("fills", i), c))).drop("fills")


def read_words(words: DataFrame, sizes: DataFrame, rects: DataFrame | None = None, strategy: str = "geometric") -> DataFrame:
    """Raw rows (see readers) of the unruled tables of pages; pages without words or codes give none.

    sizes: doc_id, page, width, height. A group and the fullest labels carry over the pages of a document."""
    lines_ = durable(lines(words.where("text IS NOT NULL AND text <> ''")))
    frames = durable(page_frames(lines_, sizes))
    body = durable(body_lines(lines_, frames))
    bands_ = durable(bands(lines_, body, frames))
    rows = bind_rows(body, bands_)
    if rects is not None:
        rows = spread_merged_cells(rows, rects, words, bands_)
    titles = body.where("heading").groupBy(*PAGE).agg(F.max_by(F.array_join(F.transform("words", lambda w: w["text"]), " "), F.struct("top", "line")).alias("t"))
    all_pages = frames.select(*PAGE).join(titles, PAGE, "left")
    carried = all_pages.select(*PAGE, F.last("t", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    named = rows.join(richer_labels(labels(lines_, frames, bands_)), PAGE, "left").join(carried, PAGE, "left")
    nth = Window.partitionBy(*PAGE).orderBy("y", "anchor")
    return named.select(*PAGE, F.lit(strategy).alias("strategy"), F.lit(1).alias("segment"), (F.row_number().over(nth) - 1).cast("int").alias("row_seq"), F.coalesce("grp", "carried").alias("grp"), "labels", "cells")
