"""The guide path on small grids, Markdown and positioned words."""

from pyspark.sql import functions as F

from docfacts.operators import geometry, guide, mapping, readers
from docfacts.plans import pipeline

GRID = "doc_id long, page int, table_seq int, row_seq int, cells array<string>"
HEAD = ["Code", "Description", "Frequency/Limitations", "In-network coverage", "Out-of-network coverage"]


def grid(spark, rows, doc=1):
    return spark.createDataFrame([(doc, p, 0, i, c) for i, (p, c) in enumerate(rows)], GRID)


def test_ruled_reader_carries_header_and_heading_over_pages(spark):
    rows = [(1, HEAD), (1, ["Exams", "", "", "", ""]), (1, ["D0120", "Periodic check", "1 per year", "100%", "80%"]), (1, ["", None, "", "", ""]), (2, ["D0140", "Limited check", "2 per year", "100%", "50%"]), (2, ["Total", "x", "y", "", ""])]
    got = readers.read_grids(grid(spark, rows)).orderBy("page").collect()
    assert [(r["page"], r["grp"], r["labels"], r["cells"][0]) for r in got] == [(1, "Exams", HEAD, "D0120"), (2, "Exams", HEAD, "D0140")]
    assert [r["score"] for r in readers.reader_scores(readers.read_grids(grid(spark, rows))).collect()] == [1.0, 1.0]


def test_reordered_columns_unseen_labels_and_no_header(spark):
    unseen = [(1, ["How it goes", "Who covers it", "Billing", "Wording"])] + [(1, ["every 6 months", f"{n}0%", f"D010{n}", f"a long description {n}"]) for n in range(5)]
    rows = pipeline.read_guides(readers.read_grids(grid(spark, unseen), code_anywhere=True)).rows.orderBy("dental_code").collect()
    assert [(r["dental_code"], r["description"], r["frequency"], r["in_network"]) for r in rows][0] == ("D0100", "a long description 0", "every 6 months", "00%")
    bare = [(1, [f"D020{n}", f"description number {n}", "once per lifetime", "not covered", "50%"]) for n in range(3)]
    r = guide.benefit_rows(readers.read_grids(grid(spark, bare))).orderBy("dental_code").first()
    assert (r["description"], r["frequency"], r["in_network"], r["out_network"]) == ("description number 0", "once per lifetime", "not covered", "50%")


def test_label_vocabulary(spark):
    labels = ["Code Description", "Benefit Limitations", "Non-Participating Provider", "ADA Code", "Coverage", "Service category", "Website icon", "", None]
    got = spark.createDataFrame([(labels,)], "l array<string>").select(F.transform("l", mapping.label_role), mapping.label_roles(F.col("l")), mapping.unmapped_labels(F.col("l")), mapping.unqualified_coverage(F.array(F.lit("Coverage")))).first()
    assert got[0] == ["description", "frequency", "out_network", "code", "in_network", "group", None, None, None]
    assert got[1] == {"description": 0, "frequency": 1, "out_network": 2, "code": 3, "in_network": 4, "group": 5} and got[2] == ["Website icon"] and got[3] is True


def test_rows_are_built_checked_named_and_exported(spark):
    rows = [(1, HEAD), (1, ["D1110", "Cleaning of adults (removal of plaque, calculus and stains)", "2 per year", "100%", " "]), (1, ["D1110", "Cleaning of adults (removal of plaque, calculus and stains)", "2 per year", "100%", ""]), (1, ["D2740", "D2740 - crown of porcelain", None, "50%", "40%"]), (1, ["D9999", "not on the page", "", "", ""])]
    text = spark.createDataFrame([(1, 1, "D1110 D2740")], "doc_id long, page int, text string")
    got = pipeline.read_guides(readers.read_grids(grid(spark, rows)), text)
    by = {r["dental_code"]: r for r in got.rows.collect()}
    assert set(by) == {"D1110", "D2740"}
    assert (by["D1110"]["benefit_group"], by["D1110"]["description"], by["D1110"]["group_source"]) == ("Cleaning of adults", "removal of plaque, calculus and stains", "llm") or by["D1110"]["description"].startswith("removal")
    assert by["D2740"]["description"] == "crown of porcelain" and by["D2740"]["benefit_group"] == "Crowns"
    exported = {r["Dental Code"]: r.asDict() for r in got.table.collect()}
    assert list(exported["D2740"]) == guide.CSV_COLUMNS and exported["D2740"]["Frequency/Limitations"] == "-"


def test_repeats_keep_the_first_row_and_ignore_groups(spark):
    schema = "doc_id long, page int, strategy string, segment int, row_seq int, dental_code string, description string, frequency string, in_network string, out_network string, benefit_group string"
    rows = [(1, 2, "r", 1, 0, "D1", None, "f", None, None, "later"), (1, 1, "r", 1, 5, "D1", None, "f", None, None, "first"), (1, 1, "r", 1, 6, "D1", "d", "f", None, None, "other"), (2, 1, "r", 1, 0, "D1", None, "f", None, None, "g")]
    df = spark.createDataFrame(rows, schema)
    kept = guide.deduplicate(df)
    assert sorted(r["benefit_group"] for r in kept.collect()) == ["first", "g", "other"]
    assert sorted(map(tuple, guide.deduplicate(kept).collect()), key=str) == sorted(map(tuple, kept.collect()), key=str)
    assert guide.deduplicate(df.limit(0)).count() == 0


def test_markdown_tables(spark):
    text = "# Exams\n\n| Code | Description |\n|---|---|\n| D0120 | Check  it |\n| x | y |\n\nMajor services\n| D2740 | Crown |\nThis is a sentence that ends with a period.\n|| D0140 | z |\n"
    got = readers.read_markdown(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("row_seq").collect()
    assert [(r["grp"], r["labels"], r["cells"]) for r in got] == [("Exams", ["Code", "Description"], ["D0120", "Check it"]), ("Major services", ["x", "y"], ["D2740", "Crown"]), ("Major services", ["x", "y"], ["D0140", "z"])]


def words_of(lines):
    rows = []
    for top, words in lines:
        rows += [(1, 1, len(rows) + i, t, float(a), float(b), float(top), float(top + 10)) for i, (t, a, b) in enumerate(words)]
    return rows


PAGE = [
    (10, [("Running", 200, 250), ("header", 260, 300)]), (60, [("In-network", 400, 460), ("Out-of-network", 480, 560)]), (72, [("Code", 20, 50), ("Description", 100, 170), ("Frequency", 250, 310), ("coverage", 400, 450), ("coverage", 480, 530)]),
    (90, [("Exams", 20, 60)]), (105, [("Periodic", 100, 140)]), (115, [("D0120", 20, 50), ("check", 100, 150), ("2", 250, 256), ("yearly", 258, 290), ("100%", 400, 430), ("80%", 480, 510)]), (127, [("established", 100, 160)]), (140, [("X-rays", 20, 60)]),
    (152, [("full", 100, 120)]), (164, [("D0210", 20, 50), ("series", 100, 150), ("1", 250, 256), ("yearly", 258, 290), ("100%", 400, 430), ("50%", 480, 510)]), (780, [("Page", 300, 320), ("7", 322, 328)]),
]
WORDS, SIZE = "doc_id long, page int, seq int, text string, x0 double, x1 double, top double, bottom double", "doc_id long, page int, width double, height double"


def test_unruled_table_with_stacked_header_wrapped_lines_and_furniture(spark):
    words, size = spark.createDataFrame(words_of(PAGE), WORDS), spark.createDataFrame([(1, 1, 600.0, 800.0)], SIZE)
    got = geometry.read_words(words, size).orderBy("row_seq").collect()
    assert [(r["grp"], r["cells"]) for r in got] == [("Exams", ["D0120", "Periodic check established", "2 yearly", "100%", "80%"]), ("X-rays", ["D0210", "full series", "1 yearly", "100%", "50%"])]
    assert got[0]["labels"] == ["Code", "Description", "Frequency", "In-network coverage", "Out-of-network coverage"]
    assert geometry.read_words(words.where("text = 'Page'"), size).count() == 0


def test_merged_cell_covers_its_rows(spark):
    page = [x for x in PAGE if x[0] not in (90, 140)]
    words, size = spark.createDataFrame(words_of(page), WORDS), spark.createDataFrame([(1, 1, 600.0, 800.0)], SIZE)
    rects = spark.createDataFrame([(1, 1, 0, 240.0, 330.0, 112.0, 130.0), (1, 1, 1, 240.0, 330.0, 112.0, 180.0)], "doc_id long, page int, seq int, x0 double, x1 double, top double, bottom double")
    assert [r["cells"][2] for r in geometry.read_words(words, size, rects).collect()] == ["2 yearly 1 yearly"] * 2


def test_best_reading_fallback_and_verification(spark):
    rows = [(1, HEAD), (1, ["D0120", "Periodic check", "1", "2", "3"]), (2, ["x", "D0140", "", "", ""])]
    ruled = readers.read_grids(grid(spark, rows))
    loose = readers.read_grids(grid(spark, rows), "grid", code_anywhere=True)
    best = {r["page"]: (r["strategy"], r["score"]) for r in readers.best_reading([ruled, loose]).collect()}
    assert best == {1: ("ruled", 1.0), 2: ("grid", 1.0)}
    costly = readers.read_grids(grid(spark, [(3, ["D0999", "scan"])]), "costly")
    pages = spark.createDataFrame([(1, 1, True, True), (1, 3, True, True), (1, 4, False, True)], "doc_id long, page int, has_codes boolean, has_text boolean")
    chosen = readers.choose([ruled, loose], costly, pages)
    assert sorted((r["page"], r["strategy"]) for r in chosen.collect()) == [(1, "ruled"), (2, "grid"), (3, "costly")]
    text = spark.createDataFrame([(1, 1, "D0120 Periodic check"), (1, 2, "nothing")], "doc_id long, page int, text string")
    assert [r["cells"][:3] for r in readers.verify_cells(loose, text).collect()] == [["D0120", "Periodic check", "1"]]


def test_pages_beyond_the_budget_are_told(spark):
    raw = "doc_id long, page int, strategy string, segment int, row_seq int, grp string, labels array<string>, cells array<string>"
    ruled = spark.createDataFrame([(1, 1, "ruled", 1, 0, None, None, ["D0120", "A long text"])], raw)
    costly = spark.createDataFrame([(1, p, "costly", 1, 0, None, None, ["D0120", "x"]) for p in (1, 2, 3, 4)], raw)
    pages = spark.createDataFrame([(1, 1, True, True), (1, 2, True, True), (1, 3, False, False), (1, 4, True, False), (1, 5, False, True), (2, 1, False, False)], "doc_id long, page int, has_codes boolean, has_text boolean")
    got = {tuple(r)[:3] for r in readers.page_outcomes([ruled], pages, costly, budget=2).collect()}
    assert got == {(1, 1, "read"), (1, 2, "fallback"), (1, 3, "fallback"), (1, 4, "over_budget"), (1, 5, "none"), (2, 1, "unreadable")}
    always = {tuple(r)[:3] for r in readers.page_outcomes([ruled], pages, costly, "always", budget=2).collect()}
    assert always == {(1, 1, "fallback"), (1, 2, "fallback"), (1, 3, "over_budget"), (1, 4, "over_budget"), (1, 5, "over_budget"), (2, 1, "unreadable")}
    rows = guide.benefit_rows(readers.choose([ruled], costly, pages, budget=2))
    told = guide.checks(rows, guide.summaries(ruled, rows), readers.page_outcomes([ruled], pages, costly, budget=2))
    assert {(r["doc_id"], r["n"]) for r in told.collect() if r["rule"] == "dental_guide.pages_unreadable"} == {(1, 1), (2, 1)}
    assert {r["doc_id"] for r in told.collect() if r["rule"] == "dental_guide.no_rows"} == {2}


def test_a_table_without_code_column_takes_the_best_roles_so_far(spark):
    raw = "doc_id long, page int, strategy string, segment int, row_seq int, grp string, labels array<string>, cells array<string>"
    full, other = ["Code", "Description", "Frequency"], ["Description", "Code", "Frequency"]
    rows = spark.createDataFrame([
        (1, 1, "ruled", 1, 0, None, full, ["D0120", "First description", "1 per year"]), (1, 2, "ruled", 1, 0, None, ["Colour", "Shape", "Size"], ["D0140", "Second description", "2 per year"]),
        (1, 3, "ruled", 1, 0, None, other, ["Third description", "D0150", "3 per year"]), (1, 4, "ruled", 1, 0, None, ["x", "y"], ["D0160", "Fourth description"]),
    ], raw)
    roles = {r["page"]: r["roles"] for r in guide.carried_roles(rows).collect()}
    assert roles[1] == {"code": 0, "description": 1, "frequency": 2} and roles[3] == {"description": 0, "code": 1, "frequency": 2} and roles[2]["code"] == 0


def test_jobs_states_and_errors(spark):
    from docfacts.operators import jobs

    files_ = spark.createDataFrame([(1, None, None), (2, "not_pdf", None), (3, None, "ValueError: x"), (4, None, None)], "doc_id long, reject_reason string, error string")
    rows = spark.createDataFrame([(1,), (1,)], "doc_id long")
    flags = spark.createDataFrame([(1, "info"), (4, "error")], "doc_id long, severity string")
    got = {r["doc_id"]: (r["status"], r["error"] and r["error"]["http_status"], r["row_count"]) for r in jobs.guide_jobs(files_, rows, flags).collect()}
    assert got == {1: ("succeeded", None, 2), 2: ("failed", 422, None), 3: ("failed", 500, None), 4: ("partial", None, 0)}
    kept = jobs.kept_jobs(spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, None)], "doc_id long, created_at long"), 2)
    assert {r["doc_id"] for r in kept.collect()} == {1, 2}
