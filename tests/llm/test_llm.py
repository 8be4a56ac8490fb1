"""The training-data operators on small fixtures, against brute force."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfacts.functions.textfold import plain
from docfacts.llm import canon_map, eval_leak, forced_bpe, format_copies, natural_cuts, one_form

pytest.importorskip("tiktoken")


@pytest.fixture(scope="session")
def enc():
    import os

    if not os.path.exists(forced_bpe.VOCABULARY):
        pytest.skip("no vocabulary here")
    return forced_bpe.Encoder()


# -- 1 ---------------------------------------------------------------------------------------------------------------


def test_copies_hidden_by_formatting(spark):
    rows = [
        (1, 1, "D0120", "Check - up"), (2, 1, "check up", " d-0120 "), (3, 1, "D0120", "Chéck up"), (4, 1, "D0120", "Check up"), (5, 2, "D0120", "Check up"), (6, 1, None, "Check up"), (7, 1, "D0120", None), (8, 1, "", "!!"), (9, 1, "--", " "), (10, None, "A", "B"),
        (11, None, "b", "a"), (12, 1, "D0120", "Сheck up"), (13, 1, "x" * 50_000, "y"), (14, 1, "Y.", "X" * 50_000), (4, 1, "D0120", "Check up"),
    ]
    df = spark.createDataFrame(rows, "row_id long, guide_id long, dental_code string, description string").withColumn("value", F.lit(1)).withColumn("n", F.lit(2))
    lines, members = format_copies.collapse(df)
    assert {(r["keep_id"], r["copy_id"]) for r in members.collect()} == {(1, 2), (1, 4), (8, 9), (10, 11), (13, 14)}
    assert {(r["keep_id"], r["n_copies"]) for r in lines.collect()} == {(1, 4), (3, 1), (5, 1), (8, 2), (10, 2), (12, 1), (13, 2)}
    empty, none = format_copies.collapse(df.limit(0))
    assert empty.count() == none.count() == 0


def test_a_group_that_holds_a_third_of_all_rows(spark):
    df = spark.range(6000).select(F.col("id").alias("row_id"), F.lit(1).cast("long").alias("guide_id"), F.when(F.col("id") % 3 == 0, "D1").otherwise(F.concat(F.lit("D"), F.col("id").cast("string"))).alias("dental_code"), F.lit("Same Text").alias("description"))
    lines, members = format_copies.collapse(df)
    assert members.count() == 2000 and lines.agg(F.max("n_copies")).first()[0] == 2001  # every third row, and row 1


# -- 3 ---------------------------------------------------------------------------------------------------------------

TERMS = [(1, "group", "Oral Examinations", ["Checkups"]), (2, "group", "Crowns and Caps", None), (3, "group", "Partial Dentures", []), (4, "group", "Fluoride Treatments", ["Fluoride varnish"]), (5, "column", "Minimum Age", None), (6, "group", None, None)]
CASES = {
    "ORAL EXAMINATIONS (CONT.)": 1, "checkup": 1, "chckps.": 1, "Examinations, Oral": 1, "oralexaminations": 1, "Oal  Exaimnations": 1, "sec. 5 oral examinations": 1, "oral exmntns": 1, "oral examin": 1, "Crowns & Caps": 2, "caps crowns": 2, "crwns and caps": 2,
    "partial dent": 3, "* Fluoride_varnish [A]": 4, "Partial refund": -1, "Crown Street office": -1, "12": -1, "": -1, "-": -1, "xx": -1, "risk pool": -1, "Ｏral Eхaminations": 1, "Checkups": 1, "x" * 40_000: -1,
}


def test_values_map_to_the_entry_they_name(spark):
    terms = spark.createDataFrame(TERMS, "term_id long, list_name string, term string, aliases array<string>")
    rows = [("group", i, v) for i, v in enumerate(CASES)] + [("group", 900, "Oral Examinations"), ("group", 901, None), ("column", 1, "minimum aeg"), ("column", 2, "Oral Examinations"), ("other", 3, "Minimum Age"), ("column", 1, "minimum aeg")]
    records = spark.createDataFrame(rows, "src string, record_id long, entered string").withColumn("term_id", F.lit(-7))
    got = {(r["src"], r["record_id"], r["entered"]): r["term_id"] for r in canon_map.map_records(records, terms).collect()}
    assert {v: got["group", i, v] for i, v in enumerate(CASES)} == CASES
    assert got["column", 1, "minimum aeg"] == 5 and got["column", 2, "Oral Examinations"] == -1 and got["other", 3, "Minimum Age"] == -1 and len(got) == len(CASES) + 3
    assert canon_map.map_records(records.limit(0), terms).count() == 0 and {r["term_id"] for r in canon_map.map_records(records, terms.limit(0)).collect()} == {-1}


def test_blocks_of_names_give_what_one_block_gives(spark):
    terms = spark.createDataFrame(TERMS, "term_id long, list_name string, term string, aliases array<string>")
    values = spark.createDataFrame([("group", v) for v in CASES if v], "src string, entered string")
    one = {r["entered"]: r["term_id"] for r in canon_map.map_values(values, terms).collect()}
    assert {r["entered"]: r["term_id"] for r in canon_map.map_values(values, terms, block=1).collect()} == one


def test_bound_of_similarity_on_made_up_headings():
    """Held-out accuracy: headings and edits of a generator that had no part in setting the bound."""
    things = "Harbor Copper Walnut Meadow Lantern Saddle Turbine Orchard Pebble Violin Glacier Compass Marble Falcon Timber Canyon Ribbon Quartz Bramble Cottage".split()
    kinds = "Repairs Rentals Storage Lessons Surveys Deliveries Polishing Auctions Permits Tours".split()
    strange = "office memo invoice budget printer holiday picnic schedule agenda minutes draft archive parking kitchen elevator badge".split()
    rng = random.Random(3)
    names = [(i, f"{thing} {kinds[i % 10]}" if i % 2 else f"{thing} {things[(i + 7) % 20]} {kinds[i % 10]}") for i, thing in enumerate(things)]
    index = canon_map.Names(names)

    def typo(w):
        k, c = rng.randrange(1, len(w)), rng.choice("abcdefghijklmnopqrstuvwxyz")
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[: k - 1] + w[k] + w[k - 1] + w[k + 1 :]])

    def variant(text):
        words = text.split()
        edits = [
            lambda: [*words[:-1], typo(words[-1])], lambda: [typo(w) for w in words], lambda: rng.sample(words, len(words)), lambda: [*words[:-1], words[-1][: max(4, len(words[-1]) - 3)]],
            lambda: [w[0] + "".join(c for c in w[1:] if c not in "aeiou") for w in words], lambda: ["Sec. 4", *words, "(cont.)"],
        ]
        done = rng.choice(edits)()
        return rng.choice([" ".join(done), " ".join(done).upper(), "_".join(done)])

    entry = lambda v: index.entry(v, canon_map.LEAST_SIMILARITY)[2]
    chosen = [rng.choice(names) for _ in range(1000)]
    assert sum(entry(variant(t)) == i for i, t in chosen) >= 970
    assert sum(entry(" ".join(rng.sample(strange, rng.randrange(1, 4)))) == -1 for _ in range(1000)) >= 990
    half = [rng.choice([f"{rng.choice(things)} {rng.choice(strange)}", f"{rng.choice(strange)} {rng.choice(kinds)}"]) for _ in range(1000)]
    assert sum(entry(v) == -1 for v in half) >= 900


def test_distance_counts_swaps():
    def slow(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(2))
        assert canon_map.distance(a, b, 3) == min(slow(a, b), 4)


def test_blocks_of_names_give_the_result_of_one_block(spark):
    names = [(1, "Caps"), (2, "Crown"), (3, "Full Dentures"), (4, "Partial Dentures"), (5, "Crown Repairs"), (6, "Denture"), (7, "Dentures")]
    terms = spark.createDataFrame([(i, "group", n, None) for i, n in names], "term_id long, list_name string, term string, aliases array<string>")
    values = spark.createDataFrame([("group", v) for v in ("caps and crown repairs", "caps, partial dentures", "x crown y caps", "partial dentures full", "dentures", "denture", "prtial dentrs", "strange")], "src string, entered string")
    one, many = ({tuple(r) for r in canon_map.map_values(values, terms, block=b).collect()} for b in (50, 1))
    assert one == many and {("group", "caps and crown repairs", 5), ("group", "x crown y caps", 2), ("group", "dentures", 7)} <= one


# -- 6 ---------------------------------------------------------------------------------------------------------------

LOOK = ["café au lait", "café au lait", "ｃａｆé au lait", "café au　lait", "ca​fé﻿ au lait", "саfé аu lаit", "𝐜𝐚fé au lait", "ca­fé au lait"]


def test_texts_that_look_the_same_pair_up(spark):
    rows = [("d", 1, i, t) for i, t in enumerate(LOOK)] + [("d", 1, 50, "Café au lait"), ("d", 1, 51, "cafe au lait"), ("d", 1, 52, "café au  lait"), ("d", 1, 53, "café au\tlait"), ("d", 2, 54, LOOK[1]), ("d", 1, 55, None), ("d", 1, 56, ""), ("d", 1, 57, "​"), ("d", None, 58, LOOK[0]), ("e", 1, 59, LOOK[0]), ("d", 1, 0, LOOK[0])]
    df = spark.createDataFrame(rows, "src string, grp long, id long, text string").withColumn("form", F.lit("x"))
    got = {(r["id_a"], r["id_b"]) for r in one_form.lookalikes(df.drop("form")).collect()}
    assert got == {(a, b) for a in range(len(LOOK)) for b in range(a + 1, len(LOOK))}
    assert one_form.lookalikes(df.limit(0)).count() == 0


def test_forms_are_those_of_unicode(spark):
    rng = random.Random(2)
    alphabet = ["a", "e", "o", "ﬁ", "é", "é", "̣", "́", "̈", "各", "가", "각", "ᄀ", "ᅡ", "²", "½", "–", "’", "-", "‑", " ", "\n", "ﾊ", "ﾞ", "Å", "ệ", "😀", "о", "Ρ", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 12))) for _ in range(300)] + ["x" * 20_000 + "ẹ́", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["form"] for r in one_form.forms(df).collect()}
    wrong = [(t, got[i]) for i, t in enumerate(texts) if t is not None and unicodedata.normalize("NFD", got[i]) != unicodedata.normalize("NFD", plain(t))]
    assert wrong == [] and got[len(texts) - 2] is None and got[len(texts) - 1] == ""
    again = spark.createDataFrame([(i, t) for i, t in got.items()], "id long, text string")
    assert {r["id"]: r["form"] for r in one_form.forms(again).collect()} == got


def test_letters_of_many_alphabets_and_long_texts(spark):
    look = ["A plan", "\u13aa plan", "A pl\u0251n", "\ua4ee plan", "A p\u217can", "\u0391 \u03c1lan", "A pla\u0578", "A plan\U000e0101"]
    long = "\u0430b\u0301 c " * 20_000
    rows = [("d", "g", i, t) for i, t in enumerate(look)] + [("d", "g", 50, long), ("d", "g", 51, long.replace("\u0430", "a")), ("d", "g", 52, "e" + "\u0301\u0323" * 3_000), ("d", "g", 53, "e" + "\u0323" * 3_000 + "\u0301" * 3_000), ("d", "g", 54, "\u00df")]
    df = spark.createDataFrame(rows, "src string, grp string, id long, text string")
    pairs = {(r["id_a"], r["id_b"]) for r in one_form.lookalikes(df).collect()}
    assert pairs == {(a, b) for a in range(len(look)) for b in range(a + 1, len(look))} | {(50, 51), (52, 53)}
    got = {(r["id"], r["class_id"], r["n_texts"]) for r in one_form.classes(df.union(df.where("id < 2"))).collect()}
    assert got == {(i, 0, len(look)) for i in range(len(look))} | {(50, 50, 2), (51, 50, 2), (52, 52, 2), (53, 52, 2)}
    assert one_form.classes(df.limit(0)).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------------------------


def test_ids_equal_those_of_the_whole_text(spark, enc):
    rng = random.Random(3)
    alphabet = "ab '\n\t s'llIl1٣é é中。  　  !?.,-—'ve ‘’😀\x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["don't <|endoftext|> it's", "a" * 50_000, " " * 9_000 + "x", "", None, "x'll", "!'s", "\r\n\r\n  y"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").withColumn("ids", F.lit(3))
    rows = forced_bpe.encode_column(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r["ids"] == (enc.bpe.encode_ordinary(texts[r["doc_id"]]) if texts[r["doc_id"]] else [])
    assert forced_bpe.encode_column(df.limit(0)).count() == 0


def test_no_cut_lies_inside_a_token(enc):
    text = "Coverage isn't limited to 2 visits per year; see page 14.".encode()
    cuts = set(enc.cuts(np.frombuffer(text, np.uint8)).tolist())
    at, edges = 0, set()
    for i in enc.bpe.encode_ordinary(text.decode()):
        at += len(enc.bpe.decode_single_token_bytes(i))
        edges.add(at)
    assert cuts and cuts <= edges


# -- 8 ---------------------------------------------------------------------------------------------------------------

ITEM = "A nurse on the Opal plan loses 2 crowns before May, and the portal shows $30. Then Opal pays 14 days late, so who settles the claim?"


def brute(documents, items, n=13):
    word = re.compile(r"[^\W_]+")
    grams = {}
    for i, t in items:
        w = [x.lower() for x in word.findall(t or "")]
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = set()
    for d, t in documents:
        w = [x.lower() for x in word.findall(t or "")]
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                out |= {(d, i) for i in grams.get(tuple(w[a : a + k]), ())}
    return out


@pytest.mark.parametrize("most_broadcast", [1_000_000, 1])
def test_leaks_are_those_of_brute_force(spark, most_broadcast):
    words = ITEM.split()
    items = [(1, ITEM), (2, "Short question, only five words"), (3, None), (4, "..."), (5, ITEM.replace("Opal", "Jade").replace("14", "15"))]
    documents = [
        (1, "x " + ITEM.upper().replace(" ", " , ") + " y"), (2, " ".join(words[:13])), (3, " ".join(words[:12])), (4, "we ask: SHORT question only-five_words!"), (5, "short question only five more words"), (6, None), (7, ""), (8, ITEM.replace("Opal", "Jade").replace("14", "99")),
        (9, ITEM.replace("nurse", "welder")), (10, " ".join(words[:10]) + " break " + " ".join(words[10:])), (11, "z " * 30_000 + ITEM), (2, " ".join(words[:13])), (12, ITEM.replace("Opal", "Jade", 1)),
    ]
    d = spark.createDataFrame(documents, "doc_id long, text string").withColumn("h", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = eval_leak.leaks(d, i, most_broadcast=most_broadcast).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["verbatim"]} == brute(documents, items)
    assert any(r["doc_id"] == 8 and r["item_id"] == 1 and not r["verbatim"] for r in rows)
    assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})
    assert eval_leak.found(d.limit(0), i).count() == 0 and eval_leak.found(d, i.limit(0)).count() == 0


def test_a_bitmap_never_says_no_to_a_member(spark):
    df = spark.range(50_000).select(F.xxhash64("id").alias("h"))
    bits = eval_leak.bitmap(df, "h")
    members = np.array([r[0] for r in df.collect()], np.int64).view(np.uint64)
    others = np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64)
    assert bits.has(members).all() and bits.has(others).mean() < 0.02 and not eval_leak.bitmap(df.limit(0), "h").has(members).any()


def test_other_parameters_are_the_same_question(spark):
    i = spark.createDataFrame([(1, "The plan of Opal pays 12 dollars and then Opal asks for 14 days more of patience from us all")], "item_id long, text string")
    d = spark.createDataFrame([(3, "Years ago the plan of Opal pays 14 dollars and then Opal asks for 12 days more of patience from us all"), (4, "The plan of Zirconia pays 12 dollars and then Opal asks for 14 days more of patience from us all"), (1, "The plan of Opal pays 99 dollars and then Opal asks for 70 weeks more of patience from us all"), (2, "The plan of Opal pays 99 dollars and then Jade asks for 99 days more of patience from us all")], "doc_id long, text string")
    got = {r["doc_id"]: r["verbatim"] for r in eval_leak.leaks(d, i).collect()}
    assert got == {1: False, 3: False, 4: True}  # 4 holds thirteen words of its own too


@pytest.mark.parametrize("most_broadcast", [1_000_000, 1])
def test_every_window_of_a_repeated_template_counts(spark, most_broadcast):
    numbers = [str(n) for n in range(1, 41)]
    prices = [w for metal in ("Copper", "Cobalt", "Nickel", "Zinc", "Silver", "Gold") for w in f"{metal} {len(metal)} dollars per month or".split()]
    items = [(1, " ".join(numbers)), (2, "We list " + " ".join(prices))]
    documents = [(a, " ".join(numbers[a : a + 13])) for a in range(28)] + [(100 + a, " ".join(prices[a : a + 13])) for a in range(len(prices) - 12)]
    documents += [(200, " ".join(numbers[:12])), (201, " ".join(numbers[:12]) + " 99"), (202, " ".join(reversed(numbers))), (203, " ".join(numbers))]
    d, i = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = eval_leak.leaks(d, i, most_broadcast=most_broadcast).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["verbatim"]} == brute(documents, items)
    assert {tuple(r) for r in eval_leak.found(d, i).collect()} == brute(documents, items)
    assert {r["n_windows"] for r in rows if r["doc_id"] == 203} == {28}


# -- 9 ---------------------------------------------------------------------------------------------------------------


def check_pieces(text, pieces, enc, limit, overlap):
    count = lambda s: len(enc.bpe.encode_ordinary(s))
    pos = 0
    for k, p in enumerate(pieces):
        assert p["piece"] == k and p["text"] == text[p["start"] : p["end"]] and p["core_start"] == pos and p["n_tokens"] == count(p["text"])
        assert p["n_tokens"] <= limit
        pos = p["end"]
        if k:
            lap = text[p["start"] : p["core_start"]]
            assert count(lap) <= overlap and p["start"] >= pieces[k - 1]["start"]
            earlier = [m.end() for m in re.finditer(r"\s+", text[: p["start"]]) if pieces[k - 1]["start"] <= m.end() < p["start"]]
            if earlier and re.search(r"\s\S", lap) and text[earlier[-1] : p["start"]].strip():
                assert count(text[earlier[-1] : p["core_start"]]) > overlap
    assert pos == len(text)


def test_pieces_fit_tile_and_overlap(spark, enc):
    rng = random.Random(4)
    sentence = lambda: " ".join(rng.choice(["plan", "pays", "the", "déjà", "coverage", "D0120", "don't", "中文"]) for _ in range(rng.randrange(3, 30))).capitalize() + rng.choice([". ", "! ", "? ", ".\n", ".\n\n", ".\r\n\r\n", "。"])
    texts = ["".join(sentence() for _ in range(n)) for n in (1, 5, 40, 160)] + ["x" * 9_000, "ab12" * 3_000, "。".join("这个计划支付费用" * 20 for _ in range(20)), "word " * 2_000, "", None, " " * 3_000 + "a", "　".join("字词" * 9 for _ in range(200)), "😀" * 800]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("piece", F.lit(0))
    got = {}
    for r in natural_cuts.cut(df, 128, 16).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(range(len(texts)))
    for i, text in enumerate(texts):
        check_pieces(text or "", sorted(got[i], key=lambda r: r["piece"]), enc, 128, 16)
    prose = [r["boundary"] for r in got[3]]
    assert sum(b in ("sentence", "paragraph", "section", "end") for b in prose) == len(prose)
    assert natural_cuts.cut(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        natural_cuts.cut(df, 10, 6)


def test_weakest_boundaries_are_merged_first():
    assert natural_cuts.merge([10, 10, 10, 10], [3, 1, 3], 25, 2) == [0, 1, 3]
    assert natural_cuts.merge([5, 5, 5], [1, 2], 100, 10) == [0] and natural_cuts.merge([50, 60], [1], 100, 10) == [0, 1] and natural_cuts.merge([7], [], 5, 1) == [0]
