"""Columns that are added, renamed, removed or retyped from issue to issue of a file series (problem 5).

Similarity flooding: each issue is a small schema graph (its table, the columns in their order, their types). The
similarity of every pair of columns of two consecutive issues starts from fields, labels and contents, and is
propagated over pairs whose graph neighbours are alike until it converges. From the converged scores one consistent
set of correspondences is chosen among the pairs that satisfy the stated conditions: where a column has one such partner
the condition decides, where several compete (labels that stand twice, columns of equal contents) the scores do. Then
cells are cast and united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfacts.functions.tables import durable
from docfacts.operators import skew

#: Share of the common codes whose cells must be equal, for unmapped columns with different labels.
SAME_CONTENT = 0.8
#: A dental code, alone in its cell.
CODE_FORM = r"^\s*[A-Za-z][0-9]{4}[A-Za-z]?\s*$"
#: Forms of the column types, first match holds; any other filled cell is text.
TYPE_FORMS = [("whole", r"^[+-]?\d+$"), ("decimal", r"^[+-]?\d+\.\d+$"), ("percent", r"^[+-]?\d+(\.\d+)?\s*%$"), ("dollar", r"^\$"), ("date", r"^\d{4}-\d{2}-\d{2}$")]


def bare(label: Column) -> Column:
    """A label without letter case, white space and punctuation."""
    return F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}\p{M}]+", "")


def filled(cell: Column) -> Column:
    return F.coalesce(~F.upper(F.trim(cell)).isin("", "-", "N/A"), F.lit(False))


def cell_type(cell: Column) -> Column:
    out = None
    for name, form in TYPE_FORMS:
        test = F.trim(cell).rlike(form)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("text")


def latest_reports(reports: DataFrame) -> DataFrame:
    """The latest report of each guide (by reported_at, then report_id)."""
    return reports.where("guide_id IS NOT NULL").groupBy("guide_id").agg(F.max_by(F.struct("series_id", "issued_on", "columns_detected", "columns_mapped", "columns_unmapped"), F.struct("reported_at", "report_id")).alias("r")).select("guide_id", "r.*")


def guides(reports: DataFrame) -> DataFrame:
    """(guide_id, series_id, issued_on, cols): one row for each guide, from its latest report (by reported_at, then report_id).

    cols is ARRAY<STRUCT<idx, label, field>>; field is the mapped field, null for an unmapped column. The detected labels
    less the unmapped ones line up with the mapped fields. Reports without guide or detected columns are left out.
    """
    latest = latest_reports(reports)
    unmapped = F.coalesce(F.col("columns_unmapped"), F.array().cast("array<string>"))
    mapped = F.coalesce(F.col("columns_mapped"), F.array().cast("array<string>"))
    latest = latest.where("columns_detected IS NOT NULL").withColumns({"u": unmapped, "m": mapped})
    cols = F.expr("""transform(columns_detected, (l, i) -> struct(i AS idx, l AS label,
        CASE WHEN NOT array_contains(u, l) THEN get(m, size(filter(slice(columns_detected, 1, i), x -> NOT array_contains(u, x)))) END AS field))""")
    return latest.select("guide_id", "series_id", "issued_on", cols.alias("cols"))


def consecutive(issues: DataFrame) -> DataFrame:
    """(earlier, later): each guide of a series with the one before it by issued_on, then guide_id; null series and dates are left out.

    The order is worked out within the months of a series and then over its months, so a series of any size is spread over tasks.
    """
    issues = issues.where("series_id IS NOT NULL AND issued_on IS NOT NULL").select("series_id", "guide_id", "issued_on", F.date_trunc("month", "issued_on").alias("m"))
    inner = Window.partitionBy("series_id", "m").orderBy("issued_on", "guide_id")
    within = issues.withColumn("earlier", F.lag("guide_id").over(inner))
    last = issues.groupBy("series_id", "m").agg(F.max_by("guide_id", F.struct("issued_on", "guide_id")).alias("last"))
    before = last.select("series_id", "m", F.lag("last").over(Window.partitionBy("series_id").orderBy("m")).alias("before"))
    heads = within.where("earlier IS NULL").join(before, ["series_id", "m"]).select(F.col("before").alias("earlier"), F.col("guide_id").alias("later"))
    return within.where("earlier IS NOT NULL").select("earlier", F.col("guide_id").alias("later")).union(heads.where("earlier IS NOT NULL"))


def data_cells(cells: DataFrame, issues: DataFrame) -> DataFrame:
    """(guide_id, page, table_seq, row_seq, code, idx, label, field, cell): the cells of the data rows, filled ones only."""
    counted = cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    entries = issues.join(counted, issues["guide_id"] == counted["doc_id"]).select("guide_id", "cols", "n")
    rows = cells.select("doc_id", "page", "table_seq", "row_seq", "cells")
    total = rows.count()
    rows = skew.lookup(rows, {"guide_id": F.col("doc_id")}, entries, "cols", "n", total, F.struct("page", "table_seq", "row_seq"), how="inner")
    at = F.expr("try_element_at(filter(cols, c -> c.field = 'code'), 1).idx")
    code = F.get(F.col("cells"), at)
    rows = rows.withColumn("code", F.when(code.rlike(CODE_FORM), F.upper(F.trim(code)))).where("code IS NOT NULL")
    long = rows.select(F.col("doc_id").alias("guide_id"), "page", "table_seq", "row_seq", "code", F.explode("cols").alias("c"), "cells")
    long = long.select("guide_id", "page", "table_seq", "row_seq", "code", "c.*", F.expr("get(cells, c.idx)").alias("cell"))
    return long.where(filled(F.col("cell")))


def column_types(long: DataFrame) -> DataFrame:
    """(guide_id, types MAP<INT, STRING>): of each column with filled cells the type of more than half of them, else text.

    Counted per column, pre-aggregated, so that a large guide doesn't meet in one task; only a guide's columns do."""
    names = [name for name, _ in TYPE_FORMS]
    kind = long.select("guide_id", "idx", cell_type(F.col("cell")).alias("t"))
    counts = kind.groupBy("guide_id", "idx").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("t") == name).alias(name) for name in names])
    major = F.coalesce(*[F.when(F.col(name) * 2 > F.col("n"), name) for name in names], F.lit("text"))
    return counts.select("guide_id", "idx", major.alias("type")).groupBy("guide_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "type"))).alias("types"))


def shared_content(long: DataFrame, pairs: DataFrame, leftover: DataFrame) -> DataFrame:
    """(earlier, later, shares ARRAY<STRUCT<a, b, share>>): for leftover columns a, b the share of common codes with equal cells.

    A code that stands in several rows counts once, by its first row with a filled cell.
    """
    cells = long.where("field IS NULL").join(leftover, ["guide_id", "idx"], "left_semi")
    cells = cells.groupBy("guide_id", "idx", "code").agg(F.min_by(F.trim("cell"), F.struct("page", "table_seq", "row_seq")).alias("cell"))
    a = cells.join(pairs, cells["guide_id"] == pairs["earlier"]).select("earlier", "later", "code", F.col("idx").alias("a"), F.col("cell").alias("cell_a"))
    b = cells.join(pairs, cells["guide_id"] == pairs["later"]).select("earlier", "later", "code", F.col("idx").alias("b"), F.col("cell").alias("cell_b"))
    both = a.join(b, ["earlier", "later", "code"]).groupBy("earlier", "later", "a", "b").agg(F.avg((F.col("cell_a") == F.col("cell_b")).cast("double")).alias("share"))
    return both.groupBy("earlier", "later").agg(F.collect_list(F.struct("a", "b", "share")).alias("shares"))


#: Types of columns, and the numbers of pairs of columns that are flooded at once.
KINDS, AT_ONCE = [*(name for name, _ in TYPE_FORMS), "text"], 1_000_000


def flood_many(starts: list[np.ndarray], types_a: list[list[str]], types_b: list[list[str]], rounds: int = 60, stop: float = 1e-4) -> list[np.ndarray]:
    """Converged similarities of the column pairs of many pairs of schema graphs, the largest of each being 1.

    A pair's score flows to the pairs of their left and right neighbours, to the pair of their types and of their tables and
    back from these, each edge carrying an equal part of what leaves a pair; the start scores flow in at every round. All graphs
    are flooded together, padded to one size; one that has converged stands still.
    """
    n, m = max(x.shape[0] for x in starts), max(x.shape[1] for x in starts)
    start, mask = np.zeros((len(starts), n, m)), np.zeros((len(starts), n, m))
    ta, tb = np.zeros((len(starts), n, len(KINDS))), np.zeros((len(starts), m, len(KINDS)))
    for k, (x, a, b) in enumerate(zip(starts, types_a, types_b)):
        start[k, : x.shape[0], : x.shape[1]], mask[k, : x.shape[0], : x.shape[1]] = x, 1
        ta[k, range(len(a)), [KINDS.index(t) for t in a]] = 1
        tb[k, range(len(b)), [KINDS.index(t) for t in b]] = 1
    members = np.maximum(ta.sum(1) * tb.sum(1), 1)
    cells = np.maximum(mask.sum((1, 2)), 1)[:, None, None]
    score, live = start.copy(), np.arange(len(starts))
    for _ in range(rounds):
        x, a, b = start[live] + score[live], ta[live], tb[live].transpose(0, 2, 1)
        side = np.zeros_like(x)
        side[:, 1:, 1:] += x[:, :-1, :-1] / 2
        side[:, :-1, :-1] += x[:, 1:, 1:] / 2
        kind = ((a.transpose(0, 2, 1) @ x) * b).sum(2) / members[live]  # mean over the pairs of two columns of one type
        nxt = (x + 0.3 * side + 0.3 * ((a * kind[:, None, :]) @ b) + 0.05 * x.sum((1, 2), keepdims=True) / cells[live]) * mask[live]
        nxt /= np.maximum(nxt.max((1, 2), keepdims=True), 1e-12)
        moved = np.abs(nxt - score[live]).max((1, 2)) >= stop
        score[live] = nxt
        live = live[moved]
        if not len(live):
            break
    return [score[k, : x.shape[0], : x.shape[1]] for k, x in enumerate(starts)]


def flood(start: np.ndarray, types_a: list[str], types_b: list[str], rounds: int = 60, stop: float = 1e-4) -> np.ndarray:
    """flood_many() for one pair of schema graphs."""
    return flood_many([start], [types_a], [types_b], rounds, stop)[0]


def dice(a: str, b: str) -> float:
    """Share of common pairs of neighbouring characters of two labels."""
    x, y = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else float(a == b)


def allowed(a: list, b: list, shares: dict[tuple[int, int], float]) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
    """(start scores, ranks of the pairs that satisfy a condition) of the columns of two issues; columns have idx, label, bare, field, type.

    Rank 0: columns of one field; 1: unmapped columns of equal bare labels; 2: unmapped columns that share enough content."""
    start = np.zeros((len(a), len(b)))
    rank: dict[tuple[int, int], int] = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x["field"] is not None or y["field"] is not None:
                if x["field"] == y["field"]:
                    rank[i, j], start[i, j] = 0, 1
            elif x["bare"] == y["bare"]:
                rank[i, j], start[i, j] = 1, 0.95
            else:
                share = shares.get((x["idx"], y["idx"]), 0.0)
                start[i, j] = 0.9 * share + 0.05 * dice(x["bare"], y["bare"])
                if share >= SAME_CONTENT - 1e-12:
                    rank[i, j] = 2
    return start, rank


def consistent(rank: dict[tuple[int, int], int], score: np.ndarray) -> list[tuple[int, int]]:
    """One set of pairs in which each column stands once: by rank, then by converged score, then the earlier columns."""
    out, used_a, used_b = [], set(), set()
    for i, j in sorted(rank, key=lambda p: (rank[p], -round(score[p], 9), p)):
        if i not in used_a and j not in used_b:
            out.append((i, j))
            used_a.add(i)
            used_b.add(j)
    return out


def correspondences(a: list, b: list, shares: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """One consistent set of corresponding columns (places in a and b) of two issues (see allowed and consistent)."""
    start, rank = allowed(a, b, shares)
    return consistent(rank, flood(start, [x["type"] for x in a], [y["type"] for y in b])) if len(a) and len(b) else []


def all_correspondences(issues: list[tuple[list, list, dict]]) -> Iterator[tuple[list, list, list[tuple[int, int]]]]:
    """(a, b, correspondences) of many pairs of issues (a, b, shares), flooded together; those of like size in one go."""
    order = sorted(range(len(issues)), key=lambda k: len(issues[k][0]) * len(issues[k][1]))
    while order:
        n, m = max(len(issues[k][0]) for k in order), max(len(issues[k][1]) for k in order)
        few = max(1, AT_ONCE // max(n * m, 1))
        now, order = order[-few:], order[:-few]
        made = [allowed(*issues[k]) for k in now]
        live = [i for i, k in enumerate(now) if len(issues[k][0]) and len(issues[k][1])]
        scores = flood_many([made[i][0] for i in live], [[c["type"] for c in issues[now[i]][0]] for i in live], [[c["type"] for c in issues[now[i]][1]] for i in live]) if live else []
        found = dict(zip(live, scores))
        for i, k in enumerate(now):
            yield issues[k][0], issues[k][1], consistent(made[i][1], found[i]) if i in found else []


def matched(reports: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, cells, links): links has a row for each column of two consecutive issues:
    earlier, later, a, label_a, type_a, b, label_b, type_b, where one side is null for a column without partner."""
    issues = durable(guides(reports))
    long = durable(data_cells(cells, issues))
    typed = issues.join(column_types(long), "guide_id", "left")
    column = lambda c: F.struct(c["idx"].alias("idx"), c["label"].alias("label"), bare(c["label"]).alias("bare"), c["field"].alias("field"), F.coalesce(F.try_element_at("types", c["idx"]), F.lit("text")).alias("type"))
    lists = durable(typed.select("guide_id", "series_id", "issued_on", F.transform("cols", column).alias("cols")))
    columns = lists.select("guide_id", "series_id", "issued_on", F.explode("cols").alias("c")).select("guide_id", "series_id", "issued_on", "c.*")
    side = lambda name, c: lists.select(F.col("guide_id").alias(name), F.col("cols").alias(c))
    wide = durable(consecutive(issues).join(side("earlier", "ca"), "earlier").join(side("later", "cb"), "later"))
    # Unmapped columns without a partner of their label: only their contents are compared.
    alone = lambda own, other: F.filter(own, lambda c: c["field"].isNull() & ~F.exists(other, lambda o: o["field"].isNull() & (o["bare"] == c["bare"])))
    loose = wide.select("earlier", "later", F.transform(alone("ca", "cb"), lambda c: c["idx"]).alias("ia"), F.transform(alone("cb", "ca"), lambda c: c["idx"]).alias("ib")).where("size(ia) > 0 AND size(ib) > 0")
    left, right = loose.select(F.col("earlier").alias("guide_id"), F.explode("ia").alias("idx")), loose.select(F.col("later").alias("guide_id"), F.explode("ib").alias("idx"))
    shares = shared_content(long, loose.select("earlier", "later"), left.union(right).distinct())
    wide = wide.join(shares, ["earlier", "later"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, of = [], {}
            issues_ = [(list(ca), list(cb), {(s["a"], s["b"]): s["share"] for s in got} if got is not None else {}) for ca, cb, got in zip(pdf["ca"], pdf["cb"], pdf["shares"])]
            for k, (a, b, _) in enumerate(issues_):
                of[id(a)] = (pdf["earlier"].iloc[k], pdf["later"].iloc[k])
            for a, b, pairs_ in all_correspondences(issues_):
                in_a, in_b = {i for i, _ in pairs_}, {j for _, j in pairs_}
                links = [(a[i], b[j]) for i, j in pairs_] + [(x, None) for i, x in enumerate(a) if i not in in_a] + [(None, y) for j, y in enumerate(b) if j not in in_b]
                rows += [(*of[id(a)], *(p[k] if p is not None else None for p in (x, y) for k in ("idx", "label", "bare", "type"))) for x, y in links]
            yield pd.DataFrame(rows, columns=["earlier", "later", "a", "label_a", "bare_a", "type_a", "b", "label_b", "bare_b", "type_b"]).astype({"a": "Int32", "b": "Int32"})

    schema = "earlier bigint, later bigint, a int, label_a string, bare_a string, type_a string, b int, label_b string, bare_b string, type_b string"
    return columns, long, wide.select("earlier", "later", "ca", "cb", "shares").mapInPandas(run, schema)


def changes(reports: DataFrame, cells: DataFrame) -> DataFrame:
    """(guide_id, change_kind, column_label): what changed in each guide against the one before it in its series.

    added, removed, renamed (labels differ by more than letter case, white space and punctuation) and retyped. The label
    is the later guide's, for removed the earlier one's. A guide reported twice counts once; the order of columns is no
    change; guides without cells have text columns; the first issue of a series, and guides without series or date,
    give no row. Columns besides the named ones are not read.
    """
    _, _, links = matched(reports, cells)
    kinds = F.array_compact(F.array(
        F.when(F.col("a").isNull(), F.struct(F.lit("added").alias("k"), F.col("label_b").alias("l"))),
        F.when(F.col("b").isNull(), F.struct(F.lit("removed").alias("k"), F.col("label_a").alias("l"))),
        F.when(F.col("bare_a") != F.col("bare_b"), F.struct(F.lit("renamed").alias("k"), F.col("label_b").alias("l"))),
        F.when(F.col("type_a") != F.col("type_b"), F.struct(F.lit("retyped").alias("k"), F.col("label_b").alias("l"))),
    ))
    return links.select(F.col("later").alias("guide_id"), F.explode(kinds).alias("c")).select("guide_id", F.col("c.k").alias("change_kind"), F.col("c.l").alias("column_label")).distinct()


def every_cell(reports: DataFrame, cells: DataFrame, named: DataFrame) -> DataFrame:
    """(series_id, guide_id, page, table_seq, row_seq, code, column_name, column_type, cell): all cells there are, header and section rows' too.

    named: guide_id, idx, name. code is null in rows without one and in guides without a code column. A cell whose column
    no report names is text under the label that its guide's first header row has there, or under none.
    """
    head = F.when(F.col("row_seq") == 0, F.struct("page", "table_seq"))
    counted = cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("cells", head).alias("heads"))
    series = latest_reports(reports).select(F.col("guide_id").alias("doc_id"), "series_id")
    code_at = guides(reports).select(F.col("guide_id").alias("doc_id"), F.expr("try_element_at(filter(cols, c -> c.field = 'code'), 1).idx").alias("at"))
    names = named.groupBy("guide_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "name"))).alias("names")).withColumnRenamed("guide_id", "doc_id")
    entries = counted.join(series, "doc_id", "left").join(code_at, "doc_id", "left").join(names, "doc_id", "left").select(F.col("doc_id").alias("g"), F.struct("series_id", "at", "names", "heads").alias("about"), "n")
    rows = skew.lookup(cells.select("doc_id", "page", "table_seq", "row_seq", "cells"), {"g": F.col("doc_id")}, entries, "about", "n", cells.count(), F.struct("page", "table_seq", "row_seq"))
    code = F.get("cells", F.col("about.at"))
    rows = rows.withColumn("code", F.when(code.rlike(CODE_FORM), F.upper(F.trim(code))))
    long = rows.select(F.col("doc_id").alias("guide_id"), "page", "table_seq", "row_seq", "code", "about", F.posexplode("cells").alias("idx", "cell"))
    long = long.withColumn("name", F.try_element_at("about.names", F.col("idx")))
    label = F.coalesce("name.column_name", F.get("about.heads", F.col("idx")))
    return long.select("about.series_id", "guide_id", "page", "table_seq", "row_seq", "code", label.alias("column_name"), F.coalesce("name.column_type", F.lit("text")).alias("column_type"), "cell")


def united(reports: DataFrame, cells: DataFrame, every: bool = False) -> DataFrame:
    """(series_id, guide_id, page, table_seq, row_seq, dental_code, column_name, column_type, value, number, day): every
    filled data cell under one name for its column throughout the series; with ``every``, all cells: value is null for
    unfilled ones, dental_code null in rows without a code (see every_cell). Types and shares are those of filled data
    cells either way.

    The name of a mapped column is its field; that of an unmapped one is its label in the first issue of the chain of
    corresponding columns. Chains are followed by pointer doubling. column_type is the chain's one type, "number" where
    its types are numbers of several kinds, else "text"; value is the trimmed text, number and day its cast.
    """
    columns, long, links = matched(reports, cells)
    nodes = columns.select("guide_id", "idx", "series_id", "label", "field", "type")
    step = links.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("later").alias("guide_id"), F.col("b").alias("idx"), F.col("earlier").alias("to_guide"), F.col("a").alias("to_idx"))
    step = nodes.select("guide_id", "idx").join(step, ["guide_id", "idx"], "left")
    ptr = durable(step.select("guide_id", "idx", F.coalesce("to_guide", "guide_id").alias("to_guide"), F.coalesce("to_idx", "idx").alias("to_idx"), F.col("to_guide").isNull().alias("done")))
    settled, moving = ptr.where("done"), ptr.where("NOT done")
    while moving.limit(1).count():  # only columns whose chain isn't followed to its end are read and written again
        known = settled.union(moving).select(F.col("guide_id").alias("to_guide"), F.col("idx").alias("to_idx"), F.col("to_guide").alias("g2"), F.col("to_idx").alias("i2"), F.col("done").alias("d2"))
        nxt = durable(moving.join(known, ["to_guide", "to_idx"]).select("guide_id", "idx", F.col("g2").alias("to_guide"), F.col("i2").alias("to_idx"), F.col("d2").alias("done")))
        settled, moving = settled.union(nxt.where("done")), nxt.where("NOT done")
    ptr = settled.drop("done")
    first = nodes.select(F.col("guide_id").alias("to_guide"), F.col("idx").alias("to_idx"), F.coalesce("field", "label").alias("column_name"))
    named = nodes.join(ptr, ["guide_id", "idx"]).join(first, ["to_guide", "to_idx"])
    kinds = named.groupBy("to_guide", "to_idx").agg(F.collect_set("type").alias("kinds"))
    numbers = F.size(F.array_except("kinds", F.array(*[F.lit(k) for k in ("whole", "decimal", "percent", "dollar")]))) == 0
    kinds = kinds.select("to_guide", "to_idx", F.when(F.size("kinds") == 1, F.element_at("kinds", 1)).when(numbers, F.lit("number")).otherwise(F.lit("text")).alias("column_type"))
    named = named.join(kinds, ["to_guide", "to_idx"]).select("guide_id", "idx", F.struct("series_id", "column_name", "column_type").alias("name"))
    if every:
        rows = every_cell(reports, cells, named)
    else:
        counted = long.groupBy("guide_id", "idx").agg(F.count(F.lit(1)).alias("n"))
        entries = named.join(counted, ["guide_id", "idx"]).select(F.col("guide_id").alias("g"), F.col("idx").alias("i"), "name", "n")
        rows = skew.lookup(long.select("guide_id", "page", "table_seq", "row_seq", "code", "idx", "cell"), {"g": F.col("guide_id"), "i": F.col("idx")}, entries, "name", "n", long.count(), F.struct("page", "table_seq", "row_seq"), how="inner").select("*", "name.*")
    value = F.when(filled(F.col("cell")), F.trim("cell"))
    number = F.when(F.col("column_type") != "text", F.regexp_replace(value, r"[$,%\s]", "").try_cast("double"))
    day = F.when(F.col("column_type") == "date", value.try_cast("date"))
    return rows.select("series_id", "guide_id", "page", "table_seq", "row_seq", F.col("code").alias("dental_code"), "column_name", "column_type", value.alias("value"), F.when(F.col("column_type") != "date", number).alias("number"), day.alias("day"))
