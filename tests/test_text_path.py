"""The text path on a small document with two packages over two pages, and on damaged copies of it."""

import pytest
from pyspark.sql import functions as F

from docfacts.operators import merge, model, rules, scanners, segment
from docfacts.plans import pipeline

HEAD = "{page} 2024 Evidence of Coverage for Harbor Select (HMO)\nChapter 4 Medical Benefits Chart (what is covered)\nHMO-MAPD 1234567ABC_01 Revised 10/06/2023 Customer Service\n"
DOC = (
    HEAD.format(page=7) + "Welcome to the plan.\nOptional supplemental package 1 – Preventive dental package\nPremium $13.00 monthly premium\nPreventive services include the following procedures, limitations and codes listed below:\nTwo oral exams each year (from the following codes):\n"
    "• D0120 – Periodic check – established\npatient\n• D0140 – Limited check\n• D0120 – Again\n" + HEAD.format(page=8) + "The plan will pay up to $500 for preventive dental benefits each year\n"
    "You pay no copay for the preventive dental benefits listed.\n• Services must be rendered by a contracted provider.\nOptional supplemental package 2 - Dental package\nPremium $32.00 monthly premium\nServices, limitations and codes of this package are listed below:\n"
    "Three fillings per year\n• D2140 - Filling\nYou pay 20% for fillings listed.\nYou pay 50% as your portion of the covered charges for crowns"
)


@pytest.fixture(scope="module")
def done(spark):
    texts = [(1, DOC), (2, DOC.replace("$13.00 monthly premium\n", "$13.00 monthly premium\nPremium $14.00 monthly premium\n")), (3, "Nothing to be read here, though the text is long enough."), (4, None), (5, "short"), (6, DOC.replace("Premium $13.00 monthly premium\n", ""))]
    return pipeline.extract(spark.createDataFrame(texts, "doc_id long, raw string"))


def test_pages_keep_one_header_and_unusable_texts_go(done):
    docs = {r["doc_id"]: r for r in done.docs.collect()}
    assert set(docs) == {1, 2, 3, 6}
    assert docs[1]["flat"].count("Evidence of Coverage for Harbor") == 1 and docs[1]["n_dropped"] == 3
    assert [p["page"] for p in docs[1]["page_starts"]] == [7, 8] and [p["page"] for p in docs[3]["page_starts"]] == [None]


def test_spans_slice_to_their_quotes_and_blocks_tile_the_document(done):
    flats = {r["doc_id"]: r["flat"] for r in done.docs.collect()}
    rows = done.candidates.collect()
    assert rows and all(flats[r["doc_id"]][r["start"] : r["end"]] == r["quote"] for r in rows)
    spans = sorted((r["start"], r["end"]) for r in done.blocks.where("doc_id = 1").collect())
    assert spans[0][0] == 0 and spans[-1][1] == len(flats[1]) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_packages_hold_what_the_text_says(done):
    p1, p2 = sorted(done.packages.where("doc_id = 1").collect(), key=lambda r: r["block_seq"])
    assert (p1["premium"]["amount_usd"], p1["premium"]["span"], p1["premium"]["status"]) == (13.0, "monthly", "found")
    assert [c["code"] for c in p1["codes"]] == ["D0120", "D0140"] and p1["codes"][0]["description"] == "Periodic check - established patient"
    assert [(s["name"], s["limit_count"], s["codes"]) for s in p1["services"]] == [("Oral exams", 2.0, ["D0120", "D0140", "D0120"])]
    assert p1["cost_share"][0]["service_ids"] == ["pkg_1.svc_oral_exams"] and p1["cost_share"][0]["source"] == "merged"
    assert [x["kind"] for x in p1["exclusions"]] == ["network_restriction"]
    assert [(s["percent"], s["status"]) for s in p2["cost_share"]] == [(20.0, "found"), (50.0, "truncated")]
    assert p2["pages"] == [8] and p1["pages"] == [7, 8]


def test_two_different_premiums_are_ambiguous_and_a_missing_one_fails(done):
    assert done.packages.where("doc_id = 2 AND block_id = 'pkg_1'").first()["premium"]["status"] == "ambiguous"
    flags, metrics = done.validate()
    found = {(r["doc_id"], r["rule"], r["path"]) for r in flags.collect()}
    assert (6, "invariants.premium_missing", "/packages/0/premium") in found and (3, "segmentation.no_packages", "/packages") in found
    assert (1, "review.low_certainty", "/packages/1/cost_share/1") in found and (1, "document.truncated", "/document/truncated") in found
    by_doc = {r["doc_id"]: r for r in metrics.collect()}
    assert by_doc[1]["passed"] and by_doc[1]["needs_review"] and not by_doc[6]["passed"] and by_doc[1]["groundedness_rate"] == 1.0


def test_rules_fire_on_tampered_packages(spark, done):
    one = done.packages.where("doc_id = 1 AND block_id = 'pkg_1'")
    cases = {
        "groundedness.not_in_source": one.withColumn("premium", F.col("premium").withField("evidence", F.col("premium.evidence").withField("quote", F.lit("Premium $9.99 invented")))),
        "groundedness.offset_mismatch": one.withColumn("premium", F.col("premium").withField("evidence", F.col("premium.evidence").withField("start", F.lit(1)))),
        "numeric.not_in_evidence": one.withColumn("premium", F.col("premium").withField("amount_usd", F.lit(130.0))),
        "references.unknown_code": one.withColumn("services", F.transform("services", lambda s: s.withField("codes", F.array(F.lit("D9999"))))),
        "references.unknown_service": one.withColumn("cost_share", F.transform("cost_share", lambda s: s.withField("service_ids", F.array(F.lit("nobody"))))),
    }
    clean = {r["rule"] for r in rules.validate(done.docs.where("doc_id = 1"), one)[0].collect()}
    for rule, packages in cases.items():
        found = {r["rule"] for r in rules.validate(done.docs.where("doc_id = 1"), packages)[0].collect()}
        assert rule in found and rule not in clean


def test_model_replies_repair_degrade_and_are_checked(spark, done):
    blocks = done.blocks.where("doc_id = 1")
    good = model.stub_replies(blocks).select("doc_id", "block_id", F.to_json("reply").alias("reply"))
    text = {r["block_id"]: r["reply"] for r in good.collect()}
    strange = text["pkg_1"].replace('"services":[{', '"services":[{"note":1,')
    rows = [(1, "pkg_1", 1, "no JSON"), (1, "pkg_1", 2, text["pkg_1"]), (1, "pkg_2", 1, strange), (1, "pkg_2", 2, '{"surprise":1}')]
    parsed = model.parse_replies(spark.createDataFrame(rows, "doc_id long, block_id string, attempt int, reply string"))
    errors = {(r["block_id"], r["attempt"]): r["errors"] for r in parsed.collect()}
    assert errors["pkg_1", 1] == ["not_json"] and errors["pkg_1", 2] == [] and errors["pkg_2", 1] == ["unknown_field:services"] and errors["pkg_2", 2] == ["unknown_field"]
    settled = {r["block_id"]: r for r in model.settle(blocks, parsed).collect()}
    assert (settled["pkg_1"]["degraded"], settled["pkg_1"]["n_calls"], settled["pkg_1"]["n_repairs"]) == (False, 2, 1) and settled["pkg_2"]["degraded"]
    packages = merge.merge(done.docs, blocks, scanners.scan_packages(blocks), model.settle(blocks, parsed))
    kept = packages.where("block_id = 'pkg_2'").first()
    assert kept["degraded"] and kept["services"] == [] and len(kept["cost_share"]) == 2 and kept["cost_share"][0]["source"] == "deterministic"


def test_invented_quotes_and_numbers_are_withheld(spark, done):
    blocks = done.blocks.where("doc_id = 1 AND block_id = 'pkg_2'")
    reply = model.reply_json({"services": [{"name": "Gold teeth", "category": "luxury", "codes": ["D2140", "D7777"], "evidence_quote": "Nine gold teeth"}, {"name": "Fillings", "category": "luxury", "limit_count": 9, "codes": ["D2140", "D7777"], "evidence_quote": "Three fillings per year"}], "cost_share": [{"type": "copay", "amount_usd": 99, "applies_to": "all", "evidence_quote": "Premium $32.00 monthly premium"}], "exclusions": [{"text": "x", "evidence_quote": "not there"}], "truncated": False})
    parsed = model.parse_replies(spark.createDataFrame([(1, "pkg_2", 1, reply)], "doc_id long, block_id string, attempt int, reply string"))
    p = merge.merge(done.docs, blocks, scanners.scan_packages(blocks), model.settle(blocks, parsed)).first()
    assert [(s["status"], s["limit_count"], s["codes"], s["dropped_codes"], s["category"]) for s in p["services"]] == [("unverified", None, [], [], None), ("found", 3.0, ["D2140"], ["D7777"], "other")]
    assert p["cost_share"][-1]["status"] == "unverified" and p["cost_share"][-1]["amount_usd"] is None and p["exclusions"] == []


def test_columns_of_interleaved_lines(spark):
    text = "Two exams each year\n• D0120 - Check\nYou pay nothing\nsome more words\nFree line\n• D0140 - Check"
    got = spark.createDataFrame([(text,), ("",)], "t string").select(segment.line_columns(F.col("t")).alias("x")).collect()
    assert [(x["line"][:9], x["label"]) for x in got[0]["x"]] == [("Two exams", "benefit"), ("• D0120 -", "benefit"), ("You pay n", "cost"), ("Free line", "benefit"), ("• D0140 -", "benefit")] and got[1]["x"] == []


def test_empty_input_gives_empty_results(spark):
    done = pipeline.extract(spark.createDataFrame([], "doc_id long, raw string"))
    assert done.packages.count() == 0 and done.validate()[0].count() == 0


def test_work_of_the_path_is_planned_once(spark, done):
    """Pages are folded once; flags join only documents with packages, and no rule makes the pointers again."""
    from docfacts.operators import normalize

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(normalize.normalize(spark.createDataFrame([(1, DOC)], "doc_id long, raw string"))).count("ArrowEvalPython") == 1
    flags = plan(done.validate()[0])
    assert flags.count("Join") == 1 and "Window" not in flags


def test_references_and_clashes_of_packages(spark):
    share, kinds = "struct<type:string,amount_usd:double,percent:double,status:string,service_ids:array<string>>", "doc_id long, block_seq int, premium struct<status:string>, exclusions array<string>, codes array<struct<code:string,description:string>>, services array<struct<service_id:string,codes:array<string>>>, cost_share array<"
    codes, services = [("D1", "one"), ("D2", None)], [("a", ["D1", "D3", "D3"]), ("b", ["D2", None]), ("c", None)]
    shares = [("copay", 1.0, None, "found", ["a", "b", "z"]), ("coinsurance", None, 1.0, "found", ["b", "a", "a"]), (None, None, None, "found", None), ("coinsurance", None, None, "found", ["c"])]
    rows = [(1, 4, ("found",), ["x"], codes, services, shares), (1, 6, ("not_stated",), [], [], [], []), (2, 1, ("found",), ["x"], [("D3", "three")], [("a", ["D3"])], [("copay", None, None, "found", ["a", "a"])])]
    packages = spark.createDataFrame(rows, kinds + share + ">")
    got = lambda df: sorted((r["doc_id"], r["rule"].split(".")[1], r["path"].removeprefix("/packages")) for r in df.collect())
    assert got(rules.references(packages)) == [(1, "code_without_description", "/0/codes/1"), (1, "unknown_code", "/0/services/0"), (1, "unknown_code", "/0/services/0"), (1, "unknown_code", "/0/services/1"), (1, "unknown_service", "/0/cost_share/0")]
    assert got(rules.invariants(packages)) == [(1, "coinsurance_without_percent", "/0/cost_share/3"), (1, "conflicting_cost_share", "/0"), (1, "conflicting_cost_share", "/0"), (1, "exclusions_not_stated", "/2/exclusions"), (1, "premium_missing", "/2/premium"), (2, "copay_without_amount", "/0/cost_share/0")]
