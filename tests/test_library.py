"""Skew-safe joins, jobs, files, streaming, and the registry against DuckDB."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from docfacts.operators import jobs, skew
from docfacts.sources import files


def test_lookup_with_hot_and_null_keys(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(3000)], "id long, k string")
    counted = big.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.concat("k", F.lit("!")))
    out = skew.lookup(big, {"k2": F.col("k")}, counted.withColumnRenamed("k", "k2"), "v", "n", 3000, F.col("id")).collect()
    assert len(out) == 3000 and all(r["v"] == (None if r["k"] is None else r["k"] + "!") for r in out)
    assert skew.lookup(big, {"k2": F.col("k")}, counted.withColumnRenamed("k", "k2"), "v", "n", 3000, F.col("id"), how="inner").count() == 2500
    assert skew.hot_part(counted, "n", 3000).count() <= skew.HOT_PARTS


def test_salted_pairs_equal_a_plain_join(spark):
    a = spark.createDataFrame([("h", 1), ("h", 2), ("c", 3)], "k string, x int")
    b = spark.createDataFrame([("h", i) for i in range(500)] + [("c", 1000), ("z", 1)], "k string, y int")
    assert sorted(map(tuple, skew.salted_pairs(a, b, ["k"], 502, "y").collect())) == sorted(map(tuple, a.join(b, "k").collect()))


def test_submissions_are_answered_once(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z"), (4, None, "w")], "doc_id long, content string, key string")
    work, replays = jobs.submit(df)
    assert sorted((r["first_id"], r["n_submissions"]) for r in work.collect()) == [(1, 2), (2, 1)] and [r["id"] for r in replays.collect()] == [3]
    again, _ = jobs.submit(df, work)
    assert again.count() == 0


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF words")
    (tmp_path / "in/b.pdf").write_bytes(b"nothing")
    (tmp_path / "in/c.pdf").write_bytes(b"%PDF bad")
    (tmp_path / "in/t.txt").write_text("A text that is long enough to be used at all, really.")
    found = files.read_binaries(spark, str(tmp_path / "in"))
    assert sorted(r["reject_reason"] or "" for r in found.collect()) == ["", "", "not_pdf"]

    def decoder(content):
        if b"bad" in content:
            raise ValueError("broken")
        return iter([(1, 0, "D0120", 1.0, 2.0, 3.0, 4.0, False)])

    words = files.decode_words(found, decoder).collect()
    assert sorted((r["text"], r["error"]) for r in words if r["text"]) == [("D0120", None)] and [r["error"] for r in words if r["error"]] == ["ValueError: broken"]
    assert files.without_text_layer(found, spark.createDataFrame(words, files.WORDS + ", error string")).count() == 1
    assert files.read_texts(spark, str(tmp_path / "in/t.txt")).first()["reject_reason"] is None
    df = spark.createDataFrame([(1, 'say "hi", now', None)], "k int, a string, b string")
    assert files.csv_text(df, ["k"], ["a", "b"], ["a"]).first()["csv"] == 'a,b\r\n"say ""hi"", now",\r\n'
    assert files.to_json(df, "k").first()["json"] == '{"k":1,"a":"say \\"hi\\", now","b":null}'


def test_landing_folder_streams_new_contents_once(spark, tmp_path):
    import json

    from docfacts.streaming import landing

    folder, out = tmp_path / "land", tmp_path / "out"
    folder.mkdir()
    text = "1 2024 Evidence of Coverage for X Plan\nOptional supplemental package 1 - Dental package\nPremium $9.00 monthly premium\n"
    (folder / "1.json").write_text("\n".join(json.dumps({"doc_id": i, "raw": text, "received_at": "2030-01-01T00:00:00Z"}) for i in (1, 2)))
    landing.run(spark, str(folder), str(out), str(tmp_path / "cp")).awaitTermination()
    (folder / "2.json").write_text(json.dumps({"doc_id": 3, "raw": text, "received_at": "2030-01-01T01:00:00Z"}))
    landing.run(spark, str(folder), str(out), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(out / "packages")).count() == 1


CHECKED = [
    "text_reject_reasons", "collapse_text", "normalized_documents", "page_at_offset", "regex_scan_offsets", "logical_lines", "segment_packages", "scan_cost_share", "scan_limits", "scan_codes", "limit_overlap_join", "merged_packages", "reply_contract", "invariant_flags",
    "grid_rows", "reader_scores", "label_roles", "benefit_rows_dedup", "guide_csv", "markdown_tables", "whitespace_columns", "nearest_code_line", "geometric_rows", "job_keys",
]


@pytest.mark.parametrize("name", CHECKED)
def test_queries_agree_with_their_sql(spark, sf, name):
    import duckdb

    from docfacts.plans import registry

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    got = [tuple(tidy(r[c]) for c in columns) for r in df.collect()]
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = [tuple(tidy(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str) and got


def test_the_core_does_not_import_the_llm_subpackage():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docfacts")
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path) as f:
                assert "docfacts.llm" not in f.read(), path


def test_calls_retry_passing_faults_and_keep_the_others(spark):
    import random

    from docfacts.operators import calls

    waits = []
    state = {"n": 0}

    def flaky():
        state["n"] += 1
        if state["n"] < 3:
            raise calls.Fault.of_status(429)
        return "ok"

    assert calls.with_retry(flaky, 3, 0.5, 8.0, waits.append, random.Random(1)) == ("ok", None, 3) and len(waits) == 2 and waits[0] <= 0.5 and waits[1] <= 1.0
    assert calls.with_retry(lambda: (_ for _ in ()).throw(calls.Fault.of_status(400)), 3, 0.5, 8.0, waits.append, random.Random(1)) == (None, "http_400", 1)
    assert calls.with_retry(lambda: 1 / 0, 3, 0.5, 8.0, waits.append, random.Random(1)) == (None, "ZeroDivisionError", 1)


def test_batch_entries(spark, tmp_path):
    from docfacts.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1 2024 Evidence of Coverage for X Plan\nOptional supplemental package 1 - Dental package\nPremium $9.00 monthly premium\n")
    assert main(["text", str(tmp_path / "in"), str(tmp_path / "out")], spark) == 0
    assert spark.read.json(str(tmp_path / "out/packages")).count() == 1
    spark.createDataFrame([(1, 1, 0, 0, ["Code", "Description"]), (1, 1, 0, 1, ["D0120", "Periodic check"])], "doc_id long, page int, table_seq int, row_seq int, cells array<string>").write.parquet(str(tmp_path / "grids"))
    assert main(["guides", str(tmp_path / "grids"), str(tmp_path / "g")], spark) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "g/csv")).first()["Dental Code"] == "D0120"
    nodes = spark.createDataFrame([(1, "/x", None, "premium", "found", 1.0, "gone", 0, 4, None, None, None, None), (1, "/y", None, "premium", "found", 1.0, "text", 0, 4, None, None, None, None)], "doc_id long, path string, package string, kind string, status string, confidence double, quote string, start int, end int, amount_usd double, percent double, span_start int, span_end int")
    nodes.write.parquet(str(tmp_path / "nodes"))
    spark.createDataFrame([(1, "some text")], "doc_id long, flat string").write.parquet(str(tmp_path / "docs"))
    assert main(["validate", str(tmp_path / "nodes"), str(tmp_path / "docs"), str(tmp_path / "v")], spark) == 1
    assert {r["rule"] for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {"groundedness.not_in_source", "groundedness.offset_mismatch"}
    assert main(["validate", str(tmp_path / "nodes"), str(tmp_path / "docs"), str(tmp_path / "f"), "--fix-offsets"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "f")).where("path = '/y'").first()["start"] == 5
