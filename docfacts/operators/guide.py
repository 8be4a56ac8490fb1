"""Raw rows of any reader to benefit rows, group names, checks and the six-column table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfacts.operators import mapping, model, readers

#: A description that begins with its group's name; bounds of group names; share of missing descriptions that is told.
PREFIXED = r"^([^()]{3,45}?)\s*\(([^()].{25,})\)\s*$"
LONG_GROUP, MAX_GROUP, MISSING_SHARE = 40, 60, 0.1
#: The columns of the exported table, in order.
CSV_COLUMNS = ["Benefit Group", "Dental Code", "Description", "Frequency/Limitations", "In-Network Coverage", "Out-of-Network Coverage"]
TABLE = ["doc_id", "page", "strategy", "segment"]
FIELDS = ["description", "frequency", "in_network", "out_network"]


def tidy_group(group: Column) -> Column:
    """A group's name without a long caveat in parentheses; null for blank."""
    text = F.regexp_replace(F.regexp_replace(group, r"\s+", " "), r"^[ .;]+|[ .;]+$", "")
    cut = F.when((F.char_length(text) > LONG_GROUP) & F.contains(text, F.lit("(")), F.regexp_replace(F.split_part(text, F.lit("("), F.lit(1)), r"^[ \-–,]+|[ \-–,]+$", "")).otherwise(text)
    return F.nullif(cut, F.lit(""))


def carried_roles(raw_rows: DataFrame) -> DataFrame:
    """(table keys, roles): each table's own roles; one without a code column takes the best roles so far if the best table has as many labels.

    Tables are gone through in reading order, by page and segment; the best is the first with the most roles. One list for each
    document, of its tables, not of its rows.
    """
    widths = raw_rows.groupBy(*TABLE).agg(F.max(F.coalesce(F.size("labels"), F.lit(0))).alias("w"))
    tables = mapping.table_roles(raw_rows, TABLE, ["row_seq"]).join(widths, TABLE)
    entry = F.struct("page", "segment", "strategy", "w", F.map_entries("roles").alias("own"))
    kind = "array<struct<key:string,value:int>>"
    start = F.struct(F.array().cast(kind).alias("best"), F.lit(-1).alias("w"), F.array().cast(f"array<struct<page:int,segment:int,strategy:string,roles:{kind}>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        no_code = ~F.exists(t["own"], lambda r: r["key"] == "code")
        own = F.when(no_code & (acc["w"] == t["w"]), acc["best"]).otherwise(t["own"])
        better = (F.size(own) > F.size(acc["best"])) | (acc["w"] <= 0)
        done = F.concat(acc["out"], F.array(F.struct(t["page"].cast("int").alias("page"), t["segment"].cast("int").alias("segment"), t["strategy"].alias("strategy"), own.alias("roles"))))
        return F.struct(F.when(better, own).otherwise(acc["best"]).alias("best"), F.when(better, t["w"]).otherwise(acc["w"]).cast("int").alias("w"), done.alias("out"))

    lists = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("ts"))
    found = lists.select("doc_id", F.explode(F.aggregate("ts", start, step, lambda acc: acc["out"])).alias("t"))
    return found.select("doc_id", "t.page", "t.strategy", "t.segment", F.map_from_entries("t.roles").alias("roles"))


def benefit_rows(raw_rows: DataFrame, page_text: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, strategy, segment, row_seq, dental_code, description, frequency, in_network, out_network, benefit_group, group_source, verified).

    Cells are taken by the roles of their table's columns (a table without code column takes the best roles so far, see
    carried_roles). The code is taken out of the description; a group column holds against a heading; "prefix (long text)" splits
    into group and description. With page_text (doc_id, page, text) rows whose code isn't on their page go; pages without text
    can't be checked (verified is false)."""
    roles = carried_roles(raw_rows)
    rows = raw_rows.join(roles, TABLE).withColumn("dental_code", readers.row_code(F.col("cells"))).where("dental_code IS NOT NULL")
    cell = lambda role: F.nullif(F.trim(F.regexp_replace(F.get("cells", F.try_element_at("roles", F.lit(role))), r"\s+", " ")), F.lit(""))
    rows = rows.withColumns({f: cell(f) for f in [*FIELDS, "group"]})
    rows = rows.withColumn("description", F.regexp_replace(F.replace("description", "dental_code", F.lit("")), r"^[ \-–—:]+|[ \-–—:]+$", ""))
    prefix = F.trim(F.regexp_extract("description", PREFIXED, 1))
    split = F.col("description").rlike(PREFIXED)
    rows = rows.withColumns({
        "benefit_group": tidy_group(F.when(F.col("group").isNotNull(), F.col("group")).when(split, prefix).otherwise(F.col("grp"))),
        "group_source": F.when(F.col("group").isNotNull(), "column").when(split | F.col("grp").isNotNull(), "heading").otherwise("missing"),
        "description": F.when(split, F.trim(F.regexp_extract("description", PREFIXED, 2))).otherwise(F.col("description")),
    })
    if page_text is None:
        rows = rows.withColumn("verified", F.lit(True))
    else:
        rows = rows.join(page_text.select("doc_id", "page", F.col("text").alias("__t")), ["doc_id", "page"], "left")
        there = F.coalesce("__t", F.lit("")) != ""
        rows = rows.where(~there | F.contains(F.col("__t"), F.col("dental_code"))).withColumn("verified", there)
    return rows.select(*TABLE, "row_seq", "dental_code", *FIELDS, "benefit_group", "group_source", "verified")


def deduplicate(rows: DataFrame) -> DataFrame:
    """The first row, in reading order, of those of a document with equal code, description, frequency and coverages; groups don't count, nulls are equal.

    By aggregation with pre-aggregation, so many copies never meet in one task."""
    others = [c for c in rows.columns if c not in ("doc_id", "dental_code", *FIELDS)]
    order = F.struct("page", "segment", "row_seq", F.col("strategy"))
    kept = rows.groupBy("doc_id", "dental_code", *FIELDS).agg(F.min_by(F.struct(*others), order).alias("first"))
    return kept.select("doc_id", "dental_code", *FIELDS, "first.*").select(*rows.columns)


def name_groups(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """rows whose group isn't from a column, named by their code: names (doc_id, dental_code, name) of a model, else the offline rules
    on the first row of each code. Names that are blank, digits alone or longer than MAX_GROUP are ignored."""
    pending = rows.where("group_source <> 'column'")
    first = pending.groupBy("doc_id", "dental_code").agg(F.min_by(F.struct("description", "benefit_group"), F.struct("page", "segment", "row_seq")).alias("r"))
    if names is None:
        names = first.select("doc_id", "dental_code", model.group_name(F.col("r.description"), F.col("r.benefit_group")).alias("name"))
    usable = names.where((F.trim("name") != "") & (F.char_length("name") <= MAX_GROUP) & ~F.col("name").rlike(r"^\d+$")).join(first.select("doc_id", "dental_code"), ["doc_id", "dental_code"], "left_semi")
    out = rows.join(usable.groupBy("doc_id", "dental_code").agg(F.min("name").alias("name")), ["doc_id", "dental_code"], "left")
    take = F.col("name").isNotNull() & (F.col("group_source") != "column")
    return out.withColumns({"benefit_group": F.when(take, F.col("name")).otherwise(F.col("benefit_group")), "group_source": F.when(take, "llm").otherwise(F.col("group_source"))}).select(*rows.columns)


#: Codes named by one call of a model.
BATCH = 40


def group_batches(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """(doc_id, batch INT, codes, lines): the codes to be named of each document, by batches in reading order, with a line for the prompt each."""
    pending = rows.where("group_source <> 'column'")
    first = pending.groupBy("doc_id", "dental_code").agg(F.min(F.struct("page", "segment", "row_seq")).alias("at"), F.min_by(F.struct("description", "benefit_group"), F.struct("page", "segment", "row_seq")).alias("r"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "dental_code")) - 1
    line = F.concat_ws(" | ", "dental_code", F.coalesce("r.description", F.lit("-")), F.concat(F.lit("section heading: "), F.coalesce("r.benefit_group", F.lit("-"))))
    numbered = first.select("doc_id", "dental_code", nth.alias("nth"), line.alias("line")).withColumn("batch", F.floor(F.col("nth") / size).cast("int"))
    lists = numbered.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("nth", "dental_code", "line"))).alias("x"))
    return lists.select("doc_id", "batch", F.transform("x", lambda v: v["dental_code"]).alias("codes"), F.transform("x", lambda v: v["line"]).alias("lines"))


def batch_names(batches: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, degraded): names (doc_id, dental_code, name) of a model's replies, for name_groups; degraded (doc_id) documents whose naming stopped.

    replies: doc_id, batch, reply (JSON: groups with code and benefit_group). A batch without a reply, or with one that isn't
    such JSON, fails; it and the document's later batches name nothing. Codes that a batch didn't ask for are ignored.
    """
    parsed = F.from_json("reply", "groups array<struct<code:string,benefit_group:string>>")["groups"]
    told = batches.join(replies.select("doc_id", "batch", parsed.alias("groups")), ["doc_id", "batch"], "left")
    failed = told.where("groups IS NULL").groupBy("doc_id").agg(F.min("batch").alias("stop"))
    good = told.join(failed, "doc_id", "left").where("stop IS NULL OR batch < stop")
    pairs = good.select("doc_id", "codes", F.explode("groups").alias("g")).where(F.array_contains("codes", F.col("g.code")))
    return pairs.select("doc_id", F.col("g.code").alias("dental_code"), F.trim(F.regexp_replace("g.benefit_group", r"\s+", " ")).alias("name")), failed.select("doc_id")


def summaries(raw_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, n_rows, pages_with_rows, strategies MAP<STRING, INT>, labels, mapped, unmapped, filled_share): one row for each document.

    filled_share: filled cells of the five columns besides the group's own text, rounded half to even to 4 places."""
    per = raw_rows.groupBy("doc_id", "strategy").agg(F.countDistinct("page").cast("int").alias("n"))
    used = per.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "n")))).alias("strategies"), F.sum("n").alias("pages_with_rows"))
    tables = raw_rows.groupBy("doc_id", "page", "segment").agg(F.first("labels").alias("labels"))  # one label list for each table
    heads = tables.groupBy("doc_id").agg(F.max_by("labels", F.struct(F.size(mapping.label_roles(F.coalesce("labels", F.array().cast("array<string>")))), -F.col("page"), -F.col("segment"))).alias("labels"))
    filled = sum((F.count(c) for c in ("benefit_group", *FIELDS)), F.lit(0))
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.bround(filled / (F.count(F.lit(1)) * 5), 4).alias("filled_share"))
    best = carried_roles(raw_rows).groupBy("doc_id").agg(F.max_by("roles", F.struct(F.size("roles"), -F.col("page"), -F.col("segment"))).alias("best"))
    heads = heads.join(best, "doc_id", "left")
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    return used.join(heads, "doc_id", "left").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "pages_with_rows", "strategies", labels.alias("labels"), F.array_sort(F.coalesce(F.map_keys("best"), F.array().cast("array<string>"))).alias("mapped"), mapping.unmapped_labels(labels).alias("unmapped"), "filled_share")


def checks(rows: DataFrame, summary: DataFrame, pages: DataFrame | None = None, degraded: DataFrame | None = None) -> DataFrame:
    """(doc_id, rule, severity, n): what each document's rows lack: no_rows, unmapped_columns, column_not_present by column,
    coverage_unqualified, descriptions_missing, pages_unreadable, pages_over_budget, grouping_degraded, rows_not_verifiable,
    repeated_codes. pages: (doc_id, page, outcome) of readers.page_outcomes, also for documents without any row; degraded: (doc_id)
    of batch_names."""
    per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in FIELDS], F.count_if(~F.col("verified")).alias("loose"), (F.count(F.lit(1)) - F.countDistinct("dental_code")).alias("again"))
    all_ = summary.select("doc_id", "labels", "mapped", "unmapped")
    if pages is not None:
        lost = pages.groupBy("doc_id").agg(F.count_if(F.col("outcome") == "unreadable").alias("unread"), F.count_if(F.col("outcome") == "over_budget").alias("over"))
        all_ = all_.join(lost, "doc_id", "full")
        empty = F.array().cast("array<string>")
        all_ = all_.withColumns({c: F.coalesce(c, empty) for c in ("labels", "mapped", "unmapped")})
    else:
        all_ = all_.withColumns({"unread": F.lit(0), "over": F.lit(0)})
    stopped = F.lit(False) if degraded is None else F.col("stopped")
    if degraded is not None:
        all_ = all_.join(degraded.select("doc_id", F.lit(True).alias("stopped")).distinct(), "doc_id", "left").fillna(False, ["stopped"])
    all_ = all_.join(per, "doc_id", "left").fillna(0)
    there = F.col("n") > 0
    flag = lambda test, rule, severity, n: F.when(test, F.struct(F.lit(f"dental_guide.{rule}").alias("rule"), F.lit(severity).alias("severity"), n.cast("bigint").alias("n")))
    flags = F.array_compact(F.array(
        flag(~there, "no_rows", "error", F.lit(0)), flag(F.size("unmapped") > 0, "unmapped_columns", "warn", F.size("unmapped")),
        *[flag(~F.array_contains("mapped", c), f"column_not_present:{c}", "warn", F.col("n")) for c in ("frequency", "in_network", "out_network")],
        flag(mapping.unqualified_coverage(F.col("labels")), "coverage_unqualified", "warn", F.lit(1)), flag(there & ((F.col("n") - F.col("n_description")) > F.col("n") * MISSING_SHARE), "descriptions_missing", "warn", F.col("n") - F.col("n_description")),
        flag(F.col("unread") + F.col("over") > 0, "pages_unreadable", "warn", F.col("unread") + F.col("over")), flag(F.col("over") > 0, "pages_over_budget", "warn", F.col("over")), flag(stopped, "grouping_degraded", "warn", F.lit(1)),
        flag(F.col("loose") > 0, "rows_not_verifiable", "warn", F.col("loose")), flag(F.col("again") > 0, "repeated_codes", "info", F.col("again")),
    ))
    return all_.select("doc_id", F.explode(flags).alias("f")).select("doc_id", "f.*")


def clean_cell(value: Column, missing: str = "-") -> Column:
    """Single blanks, no blanks, periods, semicolons and bars at the ends, ``missing`` for nothing."""
    text = F.regexp_replace(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), r"^[ .;|]+|[ .;|]+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(missing))


def csv_table(rows: DataFrame, missing: str = "-") -> DataFrame:
    """The six exported columns, all text, in order."""
    return rows.select(*[clean_cell(F.col(c), missing).alias(name) for c, name in zip(("benefit_group", "dental_code", *FIELDS), CSV_COLUMNS)])


def guide(raw_rows: DataFrame, page_text: DataFrame | None = None, names: DataFrame | None = None, use_model: bool = True) -> DataFrame:
    """Benefit rows of chosen raw rows, without repeats, with groups named."""
    rows = deduplicate(benefit_rows(raw_rows, page_text))
    return name_groups(rows, names) if use_model else rows


