"""Flat documents to a header block and package blocks, and the columns of interleaved tables (stage 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions import textops as X

#: A package's heading line: number and title are its groups; a parameter.
PACKAGE_HEADING = r"(?im)^\s*(?:Optional\s+)?supplemental\s+(?:benefit\s+)?package\s+(\d+)\s*[-:]\s*(.+)$"
#: Phrases of the cost column.
COST_CUES = [
    "the plan will pay up to", "you pay", "coverage is available from", "talk to your provider", "exclusions & limitations", "exclusions and limitations",
    "claims for covered benefits", "your costs for these services", "services must be rendered", "you must pay any extra",
]
CODE_LINE = r"^\s*(?:[•\-*]\s*)?D\d{4}\b"
#: Lines looked at on either side when a line's column is undecided.
SMOOTHING = 3


def blocks(docs: DataFrame, heading: str = PACKAGE_HEADING) -> DataFrame:
    """(doc_id, block_seq, block_id, kind, ordinal, heading, text, flat, start, end, pages): the header and the packages.

    docs: doc_id, text, flat, page_starts. A package reaches from its heading to the next; what is before the first heading
    is the header, the whole document where there's none. start and end are places in flat; pages are those of the first
    and the last character. Of several packages of one number the later ones get ids with a suffix. Row by row, no shuffle.
    """
    trimmed = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    cut = docs.withColumn("cs", X.cut_at(F.col("text"), heading))
    package = lambda k: F.struct(F.concat(F.get("cs", 2 * k - 1), F.get("cs", 2 * k)).alias("text"), trimmed(F.get("cs", 2 * k - 1)).alias("heading"))
    head = F.struct(F.get("cs", F.lit(0)).alias("text"), F.lit(None).cast("string").alias("heading"))
    n = F.floor(F.size("cs") / 2).cast("int")
    cut = cut.withColumn("bs", F.concat(F.array(head), F.when(n > 0, F.transform(F.sequence(F.lit(1), n), package)).otherwise(F.array().cast("array<struct<text:string,heading:string>>"))))
    # Blocks end at line ends and begin at lines, which have no white space at their edges: their squeezed texts tile the flat text.
    cut = cut.withColumns({"fs": F.transform("bs", lambda b: X.squeeze(b["text"])), "numbers": F.transform("bs", lambda b: F.regexp_extract(b["heading"], heading, 1))})
    cut = cut.withColumn("at", X.running(F.transform("fs", F.char_length)))
    rows = cut.select("*", F.posexplode(F.arrays_zip("bs", "fs", "at", "numbers")).alias("block_seq", "b")).where("b.fs <> ''")
    rows = rows.withColumns({"s": F.least(F.col("b.at"), F.char_length("flat") - 1), "e": F.least(F.col("b.at") + F.char_length("b.fs"), F.char_length("flat")), "heading": F.col("b.bs.heading")})
    number = F.col("b.numbers")
    before = F.size(F.filter(F.slice("numbers", F.lit(1), F.col("block_seq")), lambda x: x == number))
    pages = F.array_sort(F.array_distinct(F.array_compact(F.array(X.page_at(F.col("page_starts"), F.col("s")), X.page_at(F.col("page_starts"), F.greatest(F.col("e") - 1, F.col("s")))))))
    is_head = F.col("heading").isNull()
    return rows.select(
        "doc_id", "block_seq",
        F.when(is_head, "header").otherwise(F.concat(F.lit("pkg_"), number, F.when(before > 0, F.concat(F.lit("_"), (before + 1).cast("string"))).otherwise(""))).alias("block_id"),
        F.when(is_head, "header").otherwise("package").alias("kind"), F.when(~is_head, number.try_cast("int")).alias("ordinal"), "heading",
        trimmed(F.col("b.bs.text")).alias("text"), F.left(F.col("b.fs"), F.col("e") - F.col("s")).alias("flat"), F.col("s").alias("start"), F.col("e").alias("end"), pages.alias("pages"),
    )


def column_of(line: Column) -> Column:
    """cost, benefit or ? of a logical line: cost phrases first, then code bullets."""
    low = F.lower(line)
    cost = F.lit(False)
    for cue in COST_CUES:
        cost = cost | low.contains(cue)
    return F.when(cost, "cost").when(line.rlike(CODE_LINE), "benefit").otherwise("?")


def line_columns(text: Column) -> Column:
    """ARRAY<STRUCT<line, label>>: logical lines with their column; an undecided line takes the majority of the decided
    lines within SMOOTHING before it (as already decided) and after it; a tie, or no decided line, is benefit."""

    def labelled(all_lines: Column) -> Column:
        def smooth(first: Column) -> Column:
            def step(done: Column, i: Column) -> Column:
                near = F.concat(F.slice(done, F.greatest(i - SMOOTHING, F.lit(0)) + 1, F.least(i, F.lit(SMOOTHING))), F.slice(first, i + 2, SMOOTHING))
                major = X.let(near, lambda w: F.when(F.size(F.filter(w, lambda x: x == "cost")) > F.size(F.filter(w, lambda x: x == "benefit")), "cost").otherwise("benefit"))
                return F.concat(done, F.array(F.when(F.get(first, i) != "?", F.get(first, i)).otherwise(major)))

            return F.aggregate(F.sequence(F.lit(0), F.size(first) - 1), F.array().cast("array<string>"), step)

        labels = X.let(F.transform(all_lines, column_of), smooth)
        return F.when(F.size(all_lines) > 0, F.arrays_zip(all_lines.alias("line"), labels.alias("label"))).otherwise(F.array().cast("array<struct<line:string,label:string>>"))

    return X.let(X.logical_lines(text), labelled)
