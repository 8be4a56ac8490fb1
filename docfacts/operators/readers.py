"""Table readers of the guide path: cell grids, Markdown pipe tables, and the choice of the best reading of a page.

Readers give raw rows: doc_id, page, strategy, segment, row_seq, grp (the section heading), labels, cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of table headers.
HEADER_TOKENS = (
    "code codes description descriptions benefit benefits frequency limitation limitations periodicity coverage network category service "
    "prior authorization required ada procedure pays member cost share copay copayment tier plan"
).split()
#: A procedure code as a token.
CODE_TOKEN = r"^[A-Z]\d{4}[A-Z]?$"
#: A reading that is good enough to stop at; share of a cell's words that must stand on the page; pages read by the costly reader.
GOOD_ENOUGH, WORD_SUPPORT, PAGE_BUDGET = 0.8, 0.6, 25
RAW_ROW = ["doc_id", "page", "strategy", "segment", "row_seq", "grp", "labels", "cells"]


def find_code(text: Column) -> Column:
    """The first procedure code among a text's tokens, or null."""
    return F.try_element_at(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"[\s,;/]+"), lambda t: t.rlike(CODE_TOKEN)), F.lit(1))


def row_code(cells: Column) -> Column:
    """The code of the first cell that has one."""
    return F.try_element_at(F.filter(F.transform(cells, find_code), lambda c: c.isNotNull()), F.lit(1))


def good_row(cells: Column) -> Column:
    """A row with a code and some cell after the first that is longer than three characters."""
    return row_code(cells).isNotNull() & F.exists(F.slice(cells, F.lit(2), F.size(cells)), lambda c: F.char_length(F.trim(c)) > 3)


def reader_scores(raw_rows: DataFrame) -> DataFrame:
    """(doc_id, page, strategy, n_rows, score): the share of good rows of each reading of a page."""
    return raw_rows.groupBy("doc_id", "page", "strategy").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(good_row(F.col("cells")).cast("int")).alias("score"))


def carry(df: DataFrame, doc: str, page: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """df with, for each name, the last non-null value at or before the row in its document.

    First inside the page, then from the last page before that has one: a document of any length is spread by its pages.
    """
    inside = Window.partitionBy(doc, page).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__v_{k}": v for k, v in values.items()})
    here = df.withColumns({f"__h_{k}": F.last(f"__v_{k}", ignorenulls=True).over(inside) for k in values})
    ends = df.groupBy(doc, page).agg(*[F.max_by(F.when(F.col(f"__v_{k}").isNotNull(), F.struct(F.col(f"__v_{k}").alias("v"))), F.when(F.col(f"__v_{k}").isNotNull(), F.struct(*order))).alias(f"__e_{k}") for k in values])
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(doc).alias("__d"), F.col(page).alias("__p"), *[F.last(f"__e_{k}", ignorenulls=True).over(before)["v"].alias(f"__b_{k}") for k in values])
    out = here.join(ends, here[doc].eqNullSafe(ends["__d"]) & here[page].eqNullSafe(ends["__p"]), "left")
    out = out.withColumns({k: F.coalesce(f"__h_{k}", f"__b_{k}") for k in values})
    return out.drop("__d", "__p", *[f"__{x}_{k}" for k in values for x in "vhb"])


def classify_grid(cells: Column, code_anywhere: bool = False) -> Column:
    """blank, header, heading, data or other of a grid row: a header has no code and two header words or more, a heading text in
    its first cell alone, data a code in its first cell (with code_anywhere, in any)."""
    tokens = F.array_distinct(F.split(F.lower(F.array_join(cells, " ")), r"[^a-z0-9_]+"))
    has_code = row_code(cells).isNotNull()
    header = ~has_code & (F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in HEADER_TOKENS]))) >= 2)
    lone = (F.get(cells, F.lit(0)) != "") & ~F.exists(F.slice(cells, F.lit(2), F.size(cells)), lambda c: c != "")
    data = has_code if code_anywhere else find_code(F.get(cells, F.lit(0))).isNotNull()
    return F.when(~F.exists(cells, lambda c: c != ""), "blank").when(header, "header").when(lone, "heading").when(data, "data").otherwise("other")


def read_grids(grids: DataFrame, strategy: str = "ruled", code_anywhere: bool = False) -> DataFrame:
    """Raw rows of cut cell grids (doc_id, page, table_seq, row_seq, cells).

    A header begins a segment; headings and headers carry over rows, tables and pages of the document. Null cells are blank,
    null cell lists give no row. Repeated rows stay.
    """
    clean = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    rows = grids.where("cells IS NOT NULL").select("doc_id", "page", "table_seq", "row_seq", clean.alias("cells")).withColumn("kind", classify_grid(F.col("cells"), code_anywhere))
    place = ["table_seq", "row_seq"]
    rows = carry(rows, "doc_id", "page", place, {"labels": F.when(F.col("kind") == "header", F.col("cells")), "grp": F.when(F.col("kind") == "heading", F.get("cells", F.lit(0)))})
    nth = Window.partitionBy("doc_id", "page").orderBy(*place)
    rows = rows.withColumn("segment", F.sum((F.col("kind") == "header").cast("int")).over(nth.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    rows = rows.where("kind = 'data'").withColumn("row_seq", (F.row_number().over(nth) - 1).cast("int"))
    return rows.select("doc_id", "page", F.lit(strategy).alias("strategy"), "segment", "row_seq", "grp", "labels", "cells")


#: Markdown's alignment row and headings.
ALIGNMENT = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"
MD_HEADING = r"^\s*(?:#{1,6}\s+|\*\*)([^*#]+?)(?:\*\*)?\s*$"


def read_markdown(docs: DataFrame, text: str = "text", strategy: str = "markdown") -> DataFrame:
    """Raw rows of the pipe tables of each text (doc_id, text): a row with a code is data, any other begins a table; headings and
    short lines without a final period name the group. Page is 0. Null texts give no row."""
    from docfacts.functions.textops import lines

    rows = docs.select("doc_id", F.posexplode(lines(F.col(text))).alias("line_no", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+$", "")))
    rows = rows.where((F.col("line") != "") & ~F.col("line").rlike(ALIGNMENT))
    piped = F.regexp_count("line", F.lit(r"\|")) >= 2
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    rows = rows.withColumn("cells", F.when(piped, cells)).withColumn("code", F.when(piped, row_code(F.col("cells"))))
    header = piped & F.col("code").isNull() & F.exists("cells", lambda c: c != "")
    named = F.nullif(F.trim(F.regexp_extract("line", MD_HEADING, 1)), F.lit(""))
    group = F.when(~piped, F.coalesce(named, F.when((F.char_length("line") < 60) & ~F.endswith("line", F.lit(".")), F.col("line"))))
    run = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"header": header, "group": group})
    rows = rows.withColumns({"segment": F.sum(F.col("header").cast("int")).over(run).cast("int"), "labels": F.last(F.when(F.col("header"), F.col("cells")), ignorenulls=True).over(run), "grp": F.last("group", ignorenulls=True).over(run)})
    data = rows.where("code IS NOT NULL")
    return data.select("doc_id", F.lit(0).alias("page"), F.lit(strategy).alias("strategy"), "segment", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1).cast("int").alias("row_seq"), "grp", "labels", "cells")


def best_reading(readings: list[DataFrame], good_enough: float = GOOD_ENOUGH) -> DataFrame:
    """(doc_id, page, strategy, score) of the reading taken for each page: the first that is good enough, else the best, of equal
    ones the earlier; pages on which every reading scores 0 have none. readings in order of preference."""
    scored = reduce(DataFrame.unionByName, [reader_scores(r).withColumn("priority", F.lit(i)) for i, r in enumerate(readings)])
    rank = F.struct(F.when(F.col("score") >= good_enough, F.lit(len(readings)) - F.col("priority")).otherwise(0).alias("enough"), F.col("score"), -F.col("priority"))
    return scored.where("score > 0").groupBy("doc_id", "page").agg(F.max_by(F.struct("strategy", "score"), rank).alias("b")).select("doc_id", "page", "b.strategy", "b.score")


def page_outcomes(readings: list[DataFrame], pages: DataFrame, fallback: DataFrame | None = None, mode: str = "auto", budget: int = PAGE_BUDGET) -> DataFrame:
    """(doc_id, page, outcome, strategy): what becomes of each page of ``pages`` (doc_id, page, has_codes, has_text) or of a reading.

    outcome: read (by the strategy of best_reading), fallback (by the costly reader), over_budget (it would have been read by the
    costly reader, but ``budget`` earlier pages of the document were), none (no rows) or unreadable (none, without text).
    mode "auto": the costly reader gets the pages that hold codes or no text and that no other reading could read. "always": it
    gets every page first, and the other readings those of which it gives no row. Its rows count whatever their score.
    """
    if mode not in ("auto", "always"):
        raise ValueError(f"mode is auto or always, not {mode}")
    best = best_reading(readings).select("doc_id", "page", "strategy")
    told = pages.select("doc_id", "page", "has_codes", "has_text").distinct().join(best, ["doc_id", "page"], "full").fillna(False, ["has_codes"]).fillna(True, ["has_text"])
    if fallback is None:
        told = told.withColumns({"sent": F.lit(False), "nth": F.lit(0), "got": F.lit(None).cast("string")})
    else:
        sent = F.lit(True) if mode == "always" else F.col("strategy").isNull() & (F.col("has_codes") | ~F.col("has_text"))
        told = told.withColumn("sent", sent).withColumn("nth", F.sum(F.col("sent").cast("int")).over(Window.partitionBy("doc_id").orderBy("page")))
        costly = fallback.groupBy("doc_id", "page").agg(F.min("strategy").alias("got"))
        told = told.join(costly, ["doc_id", "page"], "left")
    within = F.col("sent") & (F.col("nth") <= budget)
    outcome = F.when(within & F.col("got").isNotNull(), "fallback").when(F.col("strategy").isNotNull(), "read").when(F.col("sent") & ~within, "over_budget").when(F.col("has_text"), "none").otherwise("unreadable")
    return told.select("doc_id", "page", outcome.alias("outcome"), F.when(within & F.col("got").isNotNull(), F.col("got")).otherwise(F.col("strategy")).alias("strategy"))


def choose(readings: list[DataFrame], fallback: DataFrame | None = None, pages: DataFrame | None = None, mode: str = "auto", budget: int = PAGE_BUDGET) -> DataFrame:
    """Raw rows of the reading of each page that page_outcomes names; pages beyond the budget are named there, and told by guide.checks.

    Without ``pages`` the rows of best_reading, and no costly reader."""
    if fallback is None or pages is None:
        best = best_reading(readings).select("doc_id", "page", "strategy")
        return reduce(DataFrame.unionByName, readings).join(best, ["doc_id", "page", "strategy"], "left_semi")
    told = page_outcomes(readings, pages, fallback, mode, budget)
    rows = reduce(DataFrame.unionByName, readings).join(told.where("outcome = 'read'").select("doc_id", "page", "strategy"), ["doc_id", "page", "strategy"], "left_semi")
    return rows.unionByName(fallback.join(told.where("outcome = 'fallback'").select("doc_id", "page"), ["doc_id", "page"], "left_semi"))


def verify_cells(raw_rows: DataFrame, page_text: DataFrame) -> DataFrame:
    """Rows of a costly reader against the page's text (doc_id, page, text): rows whose code isn't on the page go, and cells of which
    fewer than WORD_SUPPORT of the words (three letters or digits at least) are there become blank. Pages without text aren't checked."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[a-z0-9]{3,}"), F.lit(0)))
    joined = raw_rows.join(page_text.select("doc_id", "page", F.col("text").alias("__t")), ["doc_id", "page"], "left").withColumn("__w", words(F.col("__t")))
    there = F.coalesce(F.trim("__t"), F.lit("")) != ""
    joined = joined.where(~there | F.contains(F.col("__t"), row_code(F.col("cells"))))
    kept = lambda c: (F.size(words(c)) == 0) | (F.size(F.array_intersect(words(c), F.col("__w"))) / F.size(words(c)) >= WORD_SUPPORT)
    return joined.withColumn("cells", F.when(there, F.transform("cells", lambda c: F.when(kept(c), c).otherwise(""))).otherwise(F.col("cells"))).select(*RAW_ROW)
