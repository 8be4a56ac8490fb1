"""Deterministic scanners: one candidate for each match of a pattern, with its exact place (stage 3a)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions import textops as X

#: Words for counts.
COUNT_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
_COUNT = "|".join([*COUNT_WORDS, r"\d{1,3}"])


@dataclass(frozen=True)
class Scanner:
    """kind, pattern with its groups, confidence, and the group numbers of what it reads."""

    kind: str
    pattern: str
    confidence: float
    amount: int = 0
    percent: int = 0
    span: int = 0
    scope: int = 0
    count: int = 0
    unit: int = 0
    fixed_amount: float | None = None
    share: str | None = None


#: The scanners of packages, in order. The patterns are fixed values.
PACKAGE_SCANNERS = [
    Scanner("premium", r"(?i:Premium\s+\$\s?(\d[\d,]*(?:\.\d{1,2})?)\s*(monthly|annual|per month)?\s*premium?)", 0.99, amount=1, span=2),
    Scanner("benefit_maximum", r"(?i:plan will pay up to\s+\$\s?(\d[\d,]*(?:\.\d{1,2})?)\s+for\s+(.{3,80}?)\s+(each year|per year|per calendar year))", 0.97, amount=1, scope=2, span=3),
    Scanner("network_restriction", r"(?i:Coverage is available from\s+(.{3,60}?providers only))", 0.95, scope=1),
    Scanner("code", r"\b(D\d{4})\b\s*[-–]\s*(.+?)(?=\s*(?:•|\bD\d{4}\b)|$)", 0.97),
    Scanner("cost_share", r"(?i:You pay no copay for\s+([^.]{3,120})\.)", 0.94, scope=1, fixed_amount=0.0, share="copay"),
    Scanner("cost_share", r"(?i:You pay\s+(\d{1,3})\s?%\s+(?:as your portion of the covered charges\s+)?for\s+([^.]{3,160})(?:\.|$))", 0.94, percent=1, scope=2, share="coinsurance"),
    Scanner("cost_share", r"(?i:You pay\s+\$\s?(\d[\d,]*(?:\.\d{1,2})?)\s+(?:copay\s+)?for\s+([^.]{3,160})(?:\.|$))", 0.94, amount=1, scope=2, share="copay"),
    Scanner("limit", rf"(?i:(?<![\d.,$])\b({_COUNT})\s+([A-Za-z][A-Za-z \-]{{2,40}}?)\s+(each year|per year|per calendar year|each month|per month)\b)", 0.9, count=1, unit=2, span=3),
]

CANDIDATE = "kind string, scanner int, quote string, start int, end int, confidence double, amount_usd double, percent double, span string, applies_to string, code string, description string, count double, unit string, share string"


def cadence(word: Column) -> Column:
    """monthly or annual of a wording, or null."""
    return F.when(F.lower(word).contains("month"), "monthly").when(F.lower(word).rlike("annual|year"), "annual")


def period(word: Column) -> Column:
    """per_calendar_year, per_year, per_month or per_lifetime of a wording, or null."""
    w = F.lower(word)
    return F.when(w.contains("calendar year"), "per_calendar_year").when(w.contains("year"), "per_year").when(w.contains("month"), "per_month").when(w.contains("lifetime"), "per_lifetime")


def _group(s: Scanner, quote: Column, n: int) -> Column:
    return F.nullif(F.regexp_extract(quote, s.pattern.replace(r"(?<![\d.,$])", ""), n), F.lit("")) if n else F.lit(None).cast("string")


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def _candidate(s: Scanner, number: int, m: Column, base: Column) -> Column:
    q = m["quote"]
    counts = F.create_map(*[F.lit(x) for k, v in COUNT_WORDS.items() for x in (k, float(v))])
    count = F.lower(_group(s, q, s.count))
    amount = F.lit(s.fixed_amount).cast("double") if s.fixed_amount is not None else _number(_group(s, q, s.amount))
    span = cadence(_group(s, q, s.span)) if s.kind == "premium" else period(_group(s, q, s.span))
    return F.struct(
        F.lit(s.kind).alias("kind"), F.lit(number).alias("scanner"), q.alias("quote"), (base + m["start"]).cast("int").alias("start"), (base + m["end"]).cast("int").alias("end"),
        F.lit(s.confidence).alias("confidence"), amount.alias("amount_usd"), _number(_group(s, q, s.percent)).alias("percent"), span.alias("span"), F.trim(_group(s, q, s.scope)).alias("applies_to"),
        F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("description"),
        F.nullif(F.coalesce(F.try_element_at(counts, count), count.try_cast("double")), F.lit(0.0)).alias("count") if s.count else F.lit(None).cast("double").alias("count"),
        F.lower(F.trim(_group(s, q, s.unit))).alias("unit"), F.lit(s.share).cast("string").alias("share"),
    )


def regex_candidates(flat: Column, base: Column, s: Scanner, number: int) -> Column:
    """The candidates of one scanner over a block's flat text; limits whose unit is part of another statement are left out."""
    found = F.transform(X.regex_scan(flat, s.pattern), lambda m: _candidate(s, number, m, base))
    return F.filter(found, lambda c: ~c["unit"].contains("premium") & ~c["unit"].rlike("^(for|of|and) ")) if s.kind == "limit" else found


def code_candidates(text: Column, flat: Column, base: Column, s: Scanner, number: int) -> Column:
    """Codes with descriptions, looked for in each logical line and placed in the flat text after the code before, else anywhere."""
    quotes = F.flatten(F.transform(X.logical_lines(text), lambda line: F.transform(X.regex_scan(X.collapse(line, compose=False), s.pattern), lambda m: F.trim(m["quote"]))))
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<quote:string,at:int>>").alias("found"))

    def step(acc: Column, q: Column) -> Column:
        after = F.instr(F.substring(flat, acc["cursor"] + 1, F.char_length(flat)), q)
        place = X.let(after, lambda i: F.when(i > 0, acc["cursor"] + i - 1).otherwise(F.instr(flat, q) - 1))
        return X.let(place, lambda at: F.struct(F.when(at >= 0, at + F.char_length(q)).otherwise(acc["cursor"]).cast("int").alias("cursor"), F.when(at >= 0, F.concat(acc["found"], F.array(F.struct(q.alias("quote"), at.cast("int").alias("at"))))).otherwise(acc["found"]).alias("found")))

    placed = F.aggregate(quotes, start, step, lambda acc: acc["found"])
    edge_free = r"^(D\d{4})\s*[-–]\s*(?s:(.*))$"
    null = F.lit(None).cast("string")
    return F.transform(placed, lambda p: F.struct(
        F.lit("code").alias("kind"), F.lit(number).alias("scanner"), p["quote"].alias("quote"), (base + p["at"]).cast("int").alias("start"), (base + p["at"] + F.char_length(p["quote"])).cast("int").alias("end"),
        F.lit(s.confidence).alias("confidence"), F.lit(None).cast("double").alias("amount_usd"), F.lit(None).cast("double").alias("percent"), null.alias("span"), null.alias("applies_to"),
        F.regexp_extract(p["quote"], edge_free, 1).alias("code"), F.regexp_replace(F.regexp_replace(F.regexp_extract(p["quote"], edge_free, 2), r"\s*[•·]\s*$", ""), r"^[ .;]+|[ .;]+$", "").alias("description"),
        F.lit(None).cast("double").alias("count"), null.alias("unit"), null.alias("share"),
    ))


def scan_packages(blocks: DataFrame, scanners: list[Scanner] | None = None) -> DataFrame:
    """(doc_id, block_id, seq, candidate columns): all candidates of the package blocks, by scanner and place. Row by row, no shuffle."""
    found = [code_candidates(F.col("text"), F.col("flat"), F.col("start"), s, i) if s.kind == "code" else regex_candidates(F.col("flat"), F.col("start"), s, i) for i, s in enumerate(scanners or PACKAGE_SCANNERS)]
    return blocks.where("kind = 'package'").select("doc_id", "block_id", F.posexplode(F.concat(*found)).alias("seq", "c")).select("doc_id", "block_id", "seq", "c.*")


#: The header's two facts.
TITLE, FORM = r"\b(20\d{2})\s+Evidence of Coverage for\s+([^\n]{3,80})", r"(?i)([A-Z]{2,}-?[A-Z]*\s+\d{5,}[A-Z0-9_]*)\s+Revised"


def scan_header(blocks: DataFrame) -> DataFrame:
    """(doc_id, kind, value, quote, start, end, confidence): plan name, year and document type by the first title, form number by the first form line."""
    one = blocks.where("kind = 'header'").withColumns({"t": F.try_element_at(X.regex_scan(F.col("flat"), TITLE), F.lit(1)), "f": F.try_element_at(X.regex_scan(F.col("flat"), FORM), F.lit(1))})
    plan = F.regexp_replace(F.split_part(F.regexp_extract("t.quote", TITLE, 2), F.lit(" Chapter"), F.lit(1)), r"^[ .]+|[ .]+$", "")
    fact = lambda kind, value, m, c: F.when(F.col(m).isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.col(f"{m}.quote").alias("quote"), (F.col("start") + F.col(f"{m}.start")).alias("start"), (F.col("start") + F.col(f"{m}.end")).alias("end"), F.lit(c).alias("confidence")))
    facts = F.array_compact(F.array(fact("plan_name", plan, "t", 0.95), fact("plan_year", F.regexp_extract("t.quote", TITLE, 1), "t", 0.99), fact("document_type", F.lit("evidence_of_coverage"), "t", 0.97), fact("form_id", F.trim(F.regexp_extract("f.quote", FORM, 1)), "f", 0.9)))
    return one.select("doc_id", F.explode(facts).alias("x")).select("doc_id", "x.*")


def prescan_text(candidates: DataFrame) -> DataFrame:
    """(doc_id, block_id, prescan): the literals of a block as lines, its codes on one line, limits left out; "- (no literals found)" for none."""
    line = F.when(~F.col("kind").isin("code", "limit"), F.concat(F.lit("- "), F.col("kind"), F.lit(": "), F.coalesce(F.col("amount_usd").cast("string"), F.col("percent").cast("string"), "applies_to"), F.lit(" (from: "), F.trim("quote"), F.lit(")")))
    per = candidates.groupBy("doc_id", "block_id").agg(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("seq", line.alias("l"))))).alias("ls"), F.array_sort(F.collect_list(F.when(F.col("kind") == "code", F.struct("seq", "code")))).alias("cs"))
    codes = F.when(F.size("cs") > 0, F.array(F.concat(F.lit("- codes present in this block: "), F.array_join(F.transform("cs", lambda c: c["code"]), ", ")))).otherwise(F.array().cast("array<string>"))
    all_lines = F.concat(F.transform("ls", lambda x: x["l"]), codes)
    return per.select("doc_id", "block_id", F.when(F.size(all_lines) > 0, F.array_join(all_lines, "\n")).otherwise("- (no literals found)").alias("prescan"))
