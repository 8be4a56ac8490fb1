"""Nested records, units and schema drift."""

import json
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfacts.operators import drift, nested, units


def index_of(texts):
    raw = [t.encode() for t in texts]
    return nested.Index(b"".join(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))


def test_structural_index_accepts_exactly_complete_json():
    texts = ['{"a": [1, -2.5e3, true, null, "x\\"y"], "b": {}}', "[]", "1", '"s"', " {} ", "null", "", " ", "{", "}", "[1,]", "[,1]", '{"a"}', '{"a":}', '{"a" 1}', "{1:2}", "[1 2]", "[}", '{"a":1,}', '"abc', "01", "tru", "[] []", '{"a":1]', '"\\x"', '"\\u12"', '"a\nb"', '{"a":1,"b"', "nul", "{}x", '[{"a":[[{}]]}]', '"\\\\"', '"\\\\\\""']
    rng = random.Random(5)
    base = json.dumps({"p": [{"k": "a,b:{}[]\\\"", "n": [1.5, None, {"z": []}]}, "é", ""], "q": False})
    for _ in range(1500):
        at = rng.randrange(len(base))
        texts.append(rng.choice([base[:at], base[:at] + rng.choice('{}[],:"\\1 n') + base[at + 1 :], base[:at] + base[at + 1 :], base[:at] + rng.choice('{}[],:" ') + base[at:]]))

    def ok(t):
        try:
            json.loads(t)
            return not any(x in t for x in ("NaN", "Infinity"))
        except ValueError:
            return False

    got = index_of(texts).complete.tolist()
    assert [(t, g) for t, g in zip(texts, got) if g != ok(t)] == []


def payload(**package):
    return json.dumps({"packages": [{"package_id": "p", "ordinal": 1} | package]})


DELIVERY = "run_id string, delivery_id long, received_at timestamp, payload string, extra string"


def linked(spark, rows):
    df = spark.createDataFrame([(r, i, None, p, "x") for i, (r, p) in enumerate(rows)], DELIVERY)
    return {tuple(r) for r in nested.linked_rows(df).collect()}


def test_shapes_of_nested_records(spark):
    rows = [
        ("a", payload(benefit_domains="dental", premium=[{"evidence": [{"start": "12"}]}], services={"service_id": "s", "codes": "D1"}, exclusions=[{"exclusion_id": "x"}, None, {"exclusion_id": "y"}])),
        ("b", json.dumps(payload(benefit_domains=["d", "d"], premium={"evidence": {"start": 7.0}}, services=[{"service_id": "s", "codes": [{"code": "D2"}, "D3"]}, {"service_id": "t", "codes": None}]))),
        ("c", json.dumps({"result": {"packages": {"q": {"ordinal": 2, "premium": None}}}})), ("d", payload()[:-1]), ("e", None), ("f", ""), ("g", "[]"), ("h", '{"packages": {}}'), ("i", '{"packages": {"package_id": "lone", "ordinal": "3"}}'), (None, payload()),
    ]
    got = linked(spark, rows)
    assert {r[1:] for r in got if r[0] == "a"} == {(1, "p", "package", 0, 0, "p"), (1, "p", "benefit_domain", 0, 0, "dental"), (1, "p", "premium_start", 0, 0, "12"), (1, "p", "service", 0, 0, "s"), (1, "p", "service_code", 0, 0, "D1"), (1, "p", "exclusion", 0, 0, "x"), (1, "p", "exclusion", 2, 0, "y")}
    assert {r[3:] for r in got if r[0] == "b"} == {("package", 0, 0, "p"), ("benefit_domain", 0, 0, "d"), ("benefit_domain", 1, 0, "d"), ("premium_start", 0, 0, "7"), ("service", 0, 0, "s"), ("service", 1, 0, "t"), ("service_code", 0, 0, "D2"), ("service_code", 0, 1, "D3")}
    assert {r for r in got if r[0] == "c"} == {("c", 2, "q", "package", 0, 0, "q")} and {r for r in got if r[0] == "i"} == {("i", 3, "lone", "package", 0, 0, "lone")}
    assert not {r for r in got if r[0] in set("defgh")} and {r for r in got if r[0] is None} == {(None, 1, "p", "package", 0, 0, "p")}


def test_a_run_delivered_again_counts_once_by_its_latest_complete_delivery(spark):
    got = linked(spark, [("a", payload(benefit_domains=["old"])), ("a", payload(benefit_domains=["new"])), ("a", payload(benefit_domains=["cut"])[:-2])])
    assert {r[6] for r in got if r[3] == "benefit_domain"} == {"new"}
    assert linked(spark, [("a", payload())] * 3) == {("a", 1, "p", "package", 0, 0, "p")}


def test_deliveries_without_a_run_id_are_not_one_run(spark):
    got = linked(spark, [(None, payload(benefit_domains=["x"])), (None, payload(benefit_domains=["y"])), ("a", payload(benefit_domains=["old"])), ("a", payload(benefit_domains=["new"]))])
    assert {(r[0], r[6]) for r in got if r[3] == "benefit_domain"} == {(None, "x"), (None, "y"), ("a", "new")}


def test_all_nodes_are_linked(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": "x"}]}', 5), (2, "{", 6), (3, None, 7)], "id long, payload string, node long")
    got = [r for r in nested.nodes(df, ["id"], "payload").orderBy("node").collect()]
    kinds = [(r["name"], r["pos"], r["kind"], r["value"]) for r in got]
    assert kinds == [(None, 0, "object", None), ("a", 0, "array", None), (None, 0, "number", "1"), (None, 1, "object", None), ("b", 0, "string", "x")]
    parents = {r["node"]: r["parent"] for r in got}
    assert [parents[k] for k in range(5)] == [None, 0, 1, 1, 3]


def test_bad_values_in_a_record_end_nothing(spark):
    start = lambda x: json.dumps({"packages": [{"package_id": "p", "premium": {"evidence": {"start": 0}}}]}).replace(": 0}", f": {x}}}")
    layers = payload()
    for _ in range(6):
        layers = json.dumps(layers)
    rows = [
        ("int", '{"packages": [{"package_id": "p", "ordinal": 2147483648}, {"package_id": "q", "ordinal": -2147483647.0}]}'), ("lone", r'{"packages": [{"package_id": "\ud800 \ud83d\ude00 \\ud800 \udc00\udc01"}]}'),
        ("ten", '{"packages": ' + "[" * 10 + '{"package_id": ' + "[" * 10 + '"p"' + "]" * 10 + "}" + "]" * 10 + "}"), ("layers", layers), ("big", start("1e16")), ("huge", start("1e400")), ("long", start("9" * 400)), ("part", start("1.5e0")), ("deep", "[" * 30_000 + "]" * 30_000),
        ("twice", '{"packages": [{"package_id": "a", "package_id": "b", "services": [{"service_id": "x"}], "services": null}]}'), ("slash", '{"packages": "\\'), ("after", payload()),
    ]
    got = linked(spark, rows)
    of = lambda run: {r[1:3] + r[3:4] + r[6:] for r in got if r[0] == run}
    assert of("int") == {(None, "p", "package", "p"), (-2147483647, "q", "package", "q")}
    assert {r[3] for r in of("lone")} == {"\ufffd \U0001f600 \\ud800 \ufffd\ufffd"}
    assert of("ten") == {(None, "p", "package", "p")} and of("layers") == {(1, "p", "package", "p")} == of("after")
    assert {r[3] for r in of("big")} == {"p", "1" + "0" * 16} and {r[3] for r in of("huge")} == {"p"} == {r[3] for r in of("part")} and {r[3] for r in of("long")} == {"p", "9" * 400}
    assert of("twice") == {(None, "b", "package", "b")} and not of("deep") and not of("slash")


def test_texts_and_names_are_those_of_a_json_reader():
    rng = random.Random(8)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind < 3:
            return "".join(rng.choice('ab"\\/\n\té€\U0001f600{}[],: ') for _ in range(rng.randrange(6)))
        if kind < 5:
            return rng.choice([None, True, False, 0, -3, 12345678901234567890])
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 5 else {value(0) if rng.random() < 0.2 else rng.choice("kmn"): value(depth - 1) for _ in range(rng.randrange(4))} | {"z": 1}

    values = [json.loads(json.dumps({str(k): v for k, v in enumerate([value(4)])})) for _ in range(300)]
    index = index_of([json.dumps(v, ensure_ascii=rng.random() < 0.5) for v in values])

    def walk(v, name, out):
        kind = isinstance(v, (dict, list))
        out.append((name, None if kind or v is None else v if isinstance(v, str) else json.dumps(v)))
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            walk(x, k if isinstance(v, dict) else None, out)
        return out

    names = index.names.to_pylist()
    got = [(names[k] if k >= 0 else None, t) for k, t in zip(index.key[index.nodes].tolist(), index.texts(index.nodes).to_pylist())]
    assert index.complete.all() and got == [x for v in values for x in walk(v, None, [])]


def test_conversion_graph_composes_and_checks_cycles():
    ways = units.compose([("f", "c", Fraction(5, 9), Fraction(-160, 9)), ("c", "k", Fraction(1), Fraction(27315, 100))])
    k, c = ways["f", "k"]
    assert k * 212 + c == Fraction(37315, 100) and ways["k", "f"] == (1 / k, -c / k)
    with pytest.raises(ValueError):
        units.compose([("a", "b", Fraction(2), Fraction(0)), ("b", "c", Fraction(2), Fraction(0)), ("a", "c", Fraction(5), Fraction(0))])
    with pytest.raises(ValueError):
        units.compose([("a", "b", Fraction(0), Fraction(1))])


def test_service_limits_per_year(spark):
    cases = {
        "2 per year": 2000, "One (1) of (D1, D2) within any twenty-four months": 500, "6:36 MONTHS": 2000, "4x/yr": 4000, "3 P.A.": 3000, "dos veces al año; not on same date as D1004": 2000, "una vez cada 24 meses": 500, "every other year": 500, "every 3rd year": 333,
        "Semi-annually": 2000, "Quarterly": 4000, "twice in any 180-day period": 4056, "1 per quadrant every seven (7) calendar years": 143, "2 / 60 MO": 400, "max. 3 service per 12-month period, up to the yearly cap": 3000, "６ｘ per 36Ｍ": 2000, "once every 2 wks": 26000,
        "ages 20 3 exams per year": 3000, "$20 2 exams per year": 2000, "twenty-four per year": 24_000, "Twenty four visits per year": 24_000, "20 4 visits per year": 4000, "4000000000 per year": 4_000_000_000_000, "1 per 20 years": 50, "9" * 30 + " per year": None, "9" * 18 + " per day": None,
        "1 per tooth per lifetime": None, "Up to $1500 per year": None, "Not within 6 months of D1363": None, "Ages 0-6 only": None, "1 per visit": None, "2 per date of service": None, "Covered after 12 months of enrollment": None, "": None, None: None, "-": None, "No set limit": None,
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "row_id long, frequency string, per_year string")
    got = {r["row_id"]: r["per_year"] for r in units.service_limits_per_year(df).collect()}
    assert {t: got.get(i) for i, t in enumerate(cases)} == cases


def test_affine_conversion_of_rows(spark):
    edges = [("f", "c", Fraction(5, 9), Fraction(-160, 9)), ("c", "k", Fraction(1), Fraction(27315, 100))]
    df = spark.createDataFrame([("f", 212), ("c", -300), ("k", 5), ("f", None), ("x", 1), (None, 1), ("f", -40)], "unit string, q long")
    got = {(r["unit"], r["q"]): r["out"] for r in units.convert(df, units.conversion_table(spark, edges, "k"), "unit", F.col("q"), F.lit(1), "out").collect()}
    assert got == {("f", 212): 373, ("k", 5): 5, ("f", -40): 233}


def test_premiums_per_year(spark):
    rows = [
        (10.0, None, "monthly", None, 12000), (1000.0, "US cents", "/wk", None, 52000), (0.84, "hundred USD", "26 times a year", "", 218400), (5.0, "usd", None, "You pay $5.00 twice a month", 12000), (None, None, None, "Рrеmіum: $1,560.00 each plan year", 156000),
        (None, "cents", "monthly", "$2.00 per quarter (optional)", 800), (7.0, "$", "unknown", "＄７.00 every six months", 1400), (7.0, "$", "one_time", "$7.00 monthly", None), (None, None, None, "A fee of $7.00 due once", None), (None, None, None, "Premium may change each year", None),
        (7.0, "euro", "monthly", None, None), (float("nan"), "$", "monthly", None, None), (-1.0, "$", "monthly", None, None), (7.0, "$", None, None, None), (None, None, None, None, None), (0.005, "$", "annual", None, 1),
        (None, None, None, "25.50 USD per month", 30_600), (None, None, None, "USD 25.50 per month", 30_600), (None, None, None, "30 dollars each year, 12 visits", 3000), (None, None, None, "250 cents monthly", 3000), (None, None, None, "Plan 4 $5.00 monthly", 6000), (2e12, "$", "annual", None, 200_000_000_000_000), (1e17, "$", "annual", None, None), (1e300, "$", "annual", None, None), (float("inf"), "$", "annual", None, None),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "premium_id long, amount double, amount_unit string, cadence string, evidence_quote string")
    got = {r["premium_id"]: r["per_year"] for r in units.premiums_per_year(df).collect()}
    assert {i: got.get(i) for i in range(len(rows))} == {i: r[4] for i, r in enumerate(rows)}


REPORT = "report_id long, guide_id long, series_id string, issued_on timestamp, reported_at timestamp, columns_detected array<string>, columns_mapped array<string>, columns_unmapped array<string>, page int"


def test_drift_between_issues(spark):
    from datetime import datetime as dt

    day = lambda m, k=1: dt(2030, m, k)
    reports = spark.createDataFrame([
        (1, 10, "s", day(1), day(1), ["Code", "Fee", "Color", "Old"], ["code"], ["Fee", "Color", "Old"], 0), (2, 10, "s", day(1), day(2), ["Code", "Fee", "Color", "Old"], ["code"], ["Fee", "Color", "Old"], 0),
        (3, 20, "s", day(1, 9), day(9), ["F E E", "Service code", "Shade", "New"], ["code"], ["F E E", "Shade", "New"], 0), (4, 30, "t", day(3), day(3), ["Code"], ["code"], None, 0), (5, None, "s", day(4), day(4), ["x"], [], ["x"], 0), (6, 40, None, day(5), day(5), None, None, None, 0),
    ], REPORT)
    a = [["Code", "Fee", "Color", "Old"]] + [[f"D010{n}", str(n), f"c{n}", "-"] for n in range(5)] + [["D0100", "9", "other", ""]]
    b = [["F E E", "Service code", "Shade", "New"]] + [[f"{n}.50", f"D010{n}", f"c{n}" if n else "changed", None] for n in range(5)] + [["x", "Section", "", ""]]
    cells = spark.createDataFrame([(g, 1, 0, i, c) for g, rows in ((10, a), (20, b)) for i, c in enumerate(rows)] + [(99, 1, 0, 0, ["?"]), (10, 1, 0, 9, None)], "doc_id long, page int, table_seq int, row_seq int, cells array<string>")
    got = {tuple(r) for r in drift.changes(reports, cells).collect()}
    assert got == {(20, "renamed", "Service code"), (20, "retyped", "F E E"), (20, "renamed", "Shade"), (20, "removed", "Old"), (20, "added", "New")}
    table = drift.united(reports, cells).collect()
    assert {(r["guide_id"], r["column_name"]) for r in table} == {(g, c) for g in (10, 20) for c in ("code", "Fee", "Color")}
    assert {(r["column_type"]) for r in table if r["column_name"] == "Fee"} == {"number"} and sorted(r["number"] for r in table if r["column_name"] == "Fee" and r["guide_id"] == 20) == [0.5, 1.5, 2.5, 3.5, 4.5]
    assert drift.changes(reports.limit(0), cells.limit(0)).count() == 0


def test_all_cells_are_united(spark):
    from datetime import datetime as dt

    day = lambda m: dt(2030, m, 1)
    reports = spark.createDataFrame([
        (1, 10, "s", day(1), day(1), ["Code", "Fee"], ["code"], ["Fee"], 0), (2, 20, "s", day(2), day(2), ["F E E", "Code"], ["code"], ["F E E"], 0),
        (3, 30, "t", day(3), day(3), ["Fee"], [], ["Fee"], 0), (4, 40, "u", day(4), day(4), None, None, None, 0),
    ], REPORT)
    rows = {10: [["Code", "Fee"], ["D0100", "1"], ["D0101", " n/a"], ["Section", ""]], 20: [["F E E", "Code"], ["-", "D0100"], [None, "D0101"], ["2", "D0102", "beyond"]], 30: [["Fee"], ["7"]], 40: [["Fee"], ["7"]], 50: [["Fee"], ["7"]]}
    cells = spark.createDataFrame([(g, 1, 0, i, c) for g, table in rows.items() for i, c in enumerate(table)] + [(10, 1, 0, 9, None)], "doc_id long, page int, table_seq int, row_seq int, cells array<string>")
    got = [r for r in drift.united(reports, cells, every=True).collect()]
    assert len(got) == sum(len(c) for table in rows.values() for c in table)
    of = {(r["guide_id"], r["row_seq"], r["column_name"]): (r["series_id"], r["dental_code"], r["value"], r["number"]) for r in got}
    assert of[10, 1, "Fee"] == ("s", "D0100", "1", 1.0) and of[10, 2, "Fee"] == ("s", "D0101", None, None) and of[10, 3, "Fee"] == ("s", None, None, None) and of[10, 3, "code"] == ("s", None, "Section", None)
    assert of[20, 1, "Fee"] == of[20, 2, "Fee"][:1] + ("D0100", None, None) and of[20, 3, "Fee"] == ("s", "D0102", "2", 2.0) and of[20, 3, None] == ("s", "D0102", "beyond", None)
    assert of[30, 1, "Fee"][:3] == ("t", None, "7") and of[40, 1, "Fee"][:3] == ("u", None, "7") and of[50, 1, "Fee"][:3] == (None, None, "7")


def test_scores_choose_between_competing_columns():
    col = lambda idx, label, kind="text", field=None: {"idx": idx, "label": label, "bare": label.lower().replace(" ", ""), "field": field, "type": kind}
    # Both leftovers of the later issue hold the same contents; neighbours and names tell which is which.
    a = [col(0, "Code", field="code"), col(1, "Waiting months", "whole"), col(2, "Notes"), col(3, "Fee", "dollar")]
    b = [col(0, "Fee", "dollar"), col(1, "Age limit", "whole"), col(2, "Code", field="code"), col(3, "Waiting span", "whole"), col(4, "Notes")]
    assert dict(drift.correspondences(a, b, {(1, 1): 0.9, (1, 3): 0.9})) == {0: 2, 1: 3, 2: 4, 3: 0}
    # A label that stands twice: the copy beside the same neighbour wins.
    a, b = [col(0, "Code", field="code"), col(1, "Fee", "dollar"), col(2, "End")], [col(0, "Fee", "text"), col(1, "Other"), col(2, "Code", field="code"), col(3, "Fee", "dollar"), col(4, "End")]
    assert dict(drift.correspondences(a, b, {}))[1] == 3


def test_flooding_converges_and_prefers_like_neighbours():
    start = np.array([[1.0, 0, 0], [0, 0.4, 0.4], [0, 0, 1.0]])
    score = drift.flood(start, ["text", "whole", "text"], ["text", "whole", "text"])
    assert score.max() == pytest.approx(1) and score[1, 1] > score[1, 2]
