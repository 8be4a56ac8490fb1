"""The model's reading of a block: its contract, the replies table, and offline rules that honour the same contract (stage 3b)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfacts.functions import textops as X
from docfacts.functions.textfold import nfkc
from docfacts.operators.scanners import COUNT_WORDS

SERVICE = "struct<name:string,category:string,limit_count:double,limit_unit:string,limit_period:string,limit_raw:string,codes:array<string>,evidence_quote:string>"
COST_SHARE = "struct<type:string,amount_usd:double,percent:double,applies_to:string,evidence_quote:string>"
EXCLUSION = "struct<text:string,kind:string,evidence_quote:string>"
#: The contract of a reply; unknown fields are an error.
CONTRACT = (
    "struct<package_name:string,package_name_evidence:string,benefit_domains:array<string>,network_restriction:string,network_restriction_evidence:string,"
    f"services:array<{SERVICE}>,cost_share:array<{COST_SHARE}>,exclusions:array<{EXCLUSION}>,truncated:boolean>"
)
#: Fields that each member of a list must have.
REQUIRED = {"services": ("name", "evidence_quote"), "cost_share": ("type", "applies_to", "evidence_quote"), "exclusions": ("text", "evidence_quote")}


def _ddl(fields: str) -> T.StructType:
    return T._parse_datatype_string(fields)


def prompt(blocks: DataFrame, prescan: DataFrame) -> DataFrame:
    """(doc_id, block_id, prompt): the block's two columns and the literals read, as one text for a model."""
    columns = blocks.where("kind = 'package'").select("doc_id", "block_id", F.expr("text"))
    from docfacts.operators.segment import line_columns

    split = columns.withColumn("ls", line_columns(F.col("text")))
    part = lambda label: F.array_join(F.transform(F.filter("ls", lambda x: x["label"] == label), lambda x: x["line"]), "\n")
    joined = split.join(prescan, ["doc_id", "block_id"], "left")
    return joined.select("doc_id", "block_id", F.concat(F.lit("<document>\n"), "text", F.lit("\n</document>\n<benefits>\n"), part("benefit"), F.lit("\n</benefits>\n<costs>\n"), part("cost"), F.lit("\n</costs>\n<literals>\n"), F.coalesce("prescan", F.lit("- (no literals found)")), F.lit("\n</literals>")).alias("prompt"))


def _strange(known: list[str]):
    return lambda m: F.size(F.array_except(F.map_keys(m), F.array(*[F.lit(k) for k in known]))) > 0


def _lacks(field: str):
    return lambda m: m[field].isNull()


def parse_replies(replies: DataFrame) -> DataFrame:
    """replies (doc_id, block_id, attempt, reply) -> (doc_id, block_id, attempt, parsed, errors): the JSON of each reply against the contract.

    errors names what is wrong, and is empty for a reply that satisfies the contract: not_json, unknown_field (at the top
    or in a list's member), missing_field. parsed is null where there is an error. A null reply is not_json.
    """
    parsed = F.from_json("reply", _ddl(CONTRACT.replace("truncated:boolean", "truncated:boolean,_bad:string")), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    df = replies.withColumn("reply", nfkc(F.col("reply"))).withColumn("p", parsed)
    known = [f.name for f in _ddl(CONTRACT).fields]
    top = F.json_object_keys("reply")
    errors = [
        F.when(F.col("reply").isNull() | top.isNull() | F.col("p._bad").isNotNull(), "not_json"),
        F.when(F.size(F.array_except(F.coalesce(top, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))) > 0, "unknown_field"),
    ]
    for name, kind in (("services", SERVICE), ("cost_share", COST_SHARE), ("exclusions", EXCLUSION)):
        members = F.from_json(F.get_json_object("reply", f"$.{name}"), "array<map<string,string>>")
        errors.append(F.when(F.exists(F.coalesce(members, F.array().cast("array<map<string,string>>")), _strange([f.name for f in _ddl(kind).fields])), f"unknown_field:{name}"))
        need = F.coalesce(F.col(f"p.{name}"), F.array().cast(f"array<{kind}>"))
        errors += [F.when(F.exists(need, _lacks(field)), f"missing_field:{name}.{field}") for field in REQUIRED[name]]
    df = df.withColumn("errors", F.array_distinct(F.array_compact(F.array(*errors))))
    fields = F.struct(*[F.col(f"p.{k}").alias(k) for k in known])
    return df.select("doc_id", "block_id", "attempt", F.when(F.size("errors") == 0, fields).alias("parsed"), "errors")


def settle(blocks: DataFrame, parsed: DataFrame, attempts: int = 2) -> DataFrame:
    """(doc_id, block_id, reply, degraded, n_calls, n_repairs) of every package block: the first attempt that satisfies the contract.

    A block whose attempts all fail, or that has no reply, is degraded: it keeps what the scanners read. Calls count the
    attempts up to the one that is used, also for degraded blocks.
    """
    best = parsed.where(F.col("attempt") <= attempts).groupBy("doc_id", "block_id").agg(F.min_by("parsed", F.when(F.size("errors") == 0, F.col("attempt"))).alias("reply"), F.min(F.when(F.size("errors") == 0, F.col("attempt"))).alias("used"), F.count(F.lit(1)).alias("n"))
    out = blocks.where("kind = 'package'").select("doc_id", "block_id").join(best, ["doc_id", "block_id"], "left")
    calls = F.coalesce("used", "n", F.lit(0)).cast("bigint")
    return out.select("doc_id", "block_id", "reply", F.col("reply").isNull().alias("degraded"), calls.alias("n_calls"), F.greatest(calls - 1, F.lit(0)).alias("n_repairs"))


def totals(settled: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(doc_id, calls, repairs, retries, failures, blocks_degraded ARRAY<STRING>): sums over the blocks of each document.

    settled: rows of settle(). asked: rows of calls.ask(), whose calls beyond the first of a prompt are retries and whose errors are failures.
    """
    out = settled.groupBy("doc_id").agg(F.sum("n_calls").alias("calls"), F.sum("n_repairs").alias("repairs"), F.array_sort(F.collect_list(F.when(F.col("degraded"), F.col("block_id")))).alias("blocks_degraded"))
    if asked is None:
        return out.select("doc_id", "calls", "repairs", F.lit(0).cast("bigint").alias("retries"), F.lit(0).cast("bigint").alias("failures"), "blocks_degraded")
    tries = asked.groupBy("doc_id").agg(F.sum(F.greatest(F.col("calls") - 1, F.lit(0))).cast("bigint").alias("retries"), F.count("error").alias("failures"))
    return out.join(tries, "doc_id", "left").fillna(0, ["retries", "failures"]).select("doc_id", "calls", "repairs", "retries", "failures", "blocks_degraded")


# -- offline rules ---------------------------------------------------------------------------------------------------

_SPAN = r"(each year|per year|per calendar year|each month|per month)"
#: The patterns, words and ordered lists of the offline rules.
NAME = r"(?i)(?:Optional\s+)?supplemental\s+package\s+\d+\s*[-:]\s*[^\n.]{3,80}"
NETWORK = r"(?i)Coverage is available from\s+(.{3,60}?providers only)"
SERVICE_FORM = rf"(?i:\b(?:One|Two|Three|Four|Five|Six|Seven|\d{{1,2}})\s+[A-Za-z][A-Za-z \-]{{2,40}}?\s+{_SPAN}\b)"
XRAY = r"(?i:Dental X-rays include[^.]*\.)"
ZERO_COPAY = r"(?i:You pay no copay for\s+([^.]{3,120})\.)"
COINSURANCE = r"(?i:You pay\s+(\d{1,3})\s?%[^.]*?for\s+([^.]{3,160})(?:\.|$))"
DOMAINS = [("dental", "dental"), ("vision", "vision"), ("hearing", "hearing"), ("over-the-counter", "otc")]
CATEGORIES = [
    ("exam", "diagnostic"), ("x-ray", "diagnostic"), ("cleaning", "preventive"), ("prophylaxis", "preventive"), ("fluoride", "preventive"), ("filling", "restorative"),
    ("restorative", "restorative"), ("endodontic", "endodontic"), ("periodontic", "periodontic"), ("oral surgery", "oral_surgery"), ("vision", "vision"), ("eyewear", "vision"),
]
EXCLUSION_KINDS = [("claims", "claims_process"), ("out-of-pocket", "accumulator")]
#: Benefit groups by what a description contains, first match holds.
GROUP_RULES = [
    ("bitewing", "Bitewing X-rays"), ("panoramic", "X-rays"), ("cone beam", "X-rays"), ("cephalometric", "X-rays"), ("periapical", "Intraoral X-rays (inside the mouth)"),
    ("intraoral", "Intraoral X-rays (inside the mouth)"), ("radiographic", "X-rays"), ("photographic image", "X-rays"), ("periodontal evaluation", "Additional exam"),
    ("oral evaluation", "Exams"), ("oral exam", "Exams"), ("re-evaluation", "Exams"), ("prophylaxis", "Prophylaxis adult"), ("fluoride", "Fluoride treatment"), ("sealant", "Sealants"),
    ("space maintainer", "Space maintainers"), ("amalgam", "Amalgam"), ("resin-based composite", "Resin-based composite"), ("inlay", "Inlay/Onlay restorations"), ("onlay", "Inlay/Onlay restorations"),
    ("crown", "Crowns"), ("pontic", "Bridges"), ("retainer", "Bridges"), ("root canal", "Endodontics"), ("pulp", "Endodontics"), ("apicoectomy", "Endodontics"), ("scaling", "Periodontics"),
    ("gingiv", "Periodontics"), ("osseous", "Periodontics"), ("denture", "Dentures"), ("implant", "Implants"), ("extraction", "Extractions"), ("removal of tooth", "Extractions"),
    ("anesthesia", "Anesthesia"), ("sedation", "Anesthesia"), ("consultation", "Adjunctive general services"),
]


def first_rule(text: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """The value of the first rule whose phrase a text in lower case contains."""
    out = None
    for phrase, value in rules:
        test = text.contains(phrase)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def group_name(description: Column, heading: Column) -> Column:
    """A benefit group by description, else the section heading, else "-"."""
    return first_rule(F.lower(F.coalesce(description, F.lit(""))), GROUP_RULES, F.coalesce(F.nullif(F.trim(heading), F.lit("")), F.lit("-")))


def _first(flat: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.trim(F.regexp_extract(flat, pattern, group)), F.lit(""))


def stub_services(flat: Column) -> Column:
    """Services by quantity phrases and X-ray sentences; a service's codes are those up to the next one."""
    form = rf"(?i)^(\w+)\s+(.+?)\s+{_SPAN}$"
    counts = F.create_map(*[F.lit(x) for k, v in COUNT_WORDS.items() if v < 8 for x in (k, float(v))])

    def build(m: Column, until: Column) -> Column:
        read = F.struct(
            m["quote"].rlike(form).alias("parsed"), F.trim(F.regexp_extract(m["quote"], form, 2)).alias("unit"), F.lower(F.regexp_extract(m["quote"], form, 1)).alias("count"),
            F.lower(F.regexp_extract(m["quote"], form, 3)).alias("span"),
        )

        def whole(r: Column) -> Column:
            name = F.when(r["parsed"], F.concat(F.upper(F.left(r["unit"], F.lit(1))), F.substring(r["unit"], F.lit(2), F.char_length(r["unit"])))).otherwise("Dental X-rays")
            return F.struct(
                name.alias("name"), X.let(F.lower(name), lambda n: first_rule(n, CATEGORIES, F.lit("other"))).alias("category"), F.when(r["parsed"], F.coalesce(F.try_element_at(counts, r["count"]), r["count"].try_cast("double"))).alias("limit_count"),
                F.when(r["parsed"], F.lower(r["unit"])).otherwise("study").alias("limit_unit"), F.when(~r["parsed"], "per_year").when(r["span"].contains("calendar"), "per_calendar_year").when(r["span"].contains("month"), "per_month").otherwise("per_year").alias("limit_period"),
                m["quote"].alias("limit_raw"), F.regexp_extract_all(F.substring(flat, m["end"] + 1, until - m["end"]), F.lit(r"\bD\d{4}\b"), F.lit(0)).alias("codes"), m["quote"].alias("evidence_quote"),
            )

        return X.let(read, whole)

    def both(xrays: Column) -> Column:
        phrases = F.filter(X.regex_scan(flat, SERVICE_FORM), lambda m: ~F.exists(xrays, lambda x: (x["start"] <= m["start"]) & (m["end"] <= x["end"])))
        return F.array_sort(F.transform(F.concat(phrases, xrays), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.trim(m["quote"]).alias("quote"))))

    def services(found: Column) -> Column:
        spans = F.transform(found, lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["quote"].alias("quote"), F.coalesce(F.get(found, i + 1)["start"], F.char_length(flat)).alias("until")))
        return F.transform(F.filter(spans, lambda m: ~m["quote"].rlike(r"^(?:\$|\d[\d,]*\s+for\b)")), lambda m: build(m, m["until"]))

    return X.let(X.let(X.regex_scan(flat, XRAY), both), services)


def stub_exclusions(flat: Column) -> Column:
    """Bulleted sentences that are no codes: the first sentence of each, cut at the next package, 25 characters at least."""
    chunks = F.split(flat, "•", -1)
    texts = F.transform(F.slice(chunks, F.lit(2), F.size(chunks)), lambda c: F.trim(F.regexp_extract(F.trim(F.split_part(F.trim(c), F.lit("Optional supplemental package"), F.lit(1))), r"^(?s:.*?[.;](?=\s)|.*)", 0)))
    kept = F.filter(texts, lambda t: (F.char_length(t) >= 25) & ~t.rlike(r"^D\d{4}\b"))

    def kind(t: Column) -> Column:
        low = F.lower(t)
        out = F.when(low.contains("contracted provider") & low.contains("rendered"), "network_restriction")
        for phrase, value in EXCLUSION_KINDS:
            out = out.when(low.contains(phrase), value)
        return out.when(low.startswith("you must pay"), "member_liability").when(low.contains("excluded"), "service_excluded").otherwise("other")

    return F.transform(kept, lambda t: F.struct(t.alias("text"), kind(t).alias("kind"), t.alias("evidence_quote")))


def stub_reply(flat: Column) -> Column:
    """A reply of the contract by surface rules alone; quotes are verbatim, what isn't said is null."""
    name, net = _first(flat, NAME), _first(flat, NETWORK, 1)
    copays = F.transform(X.regex_scan(flat, ZERO_COPAY), lambda m: F.struct(F.lit("copay").alias("type"), F.lit(0.0).alias("amount_usd"), F.lit(None).cast("double").alias("percent"), F.trim(F.regexp_extract(m["quote"], ZERO_COPAY, 1)).alias("applies_to"), F.trim(m["quote"]).alias("evidence_quote")))
    shares = F.transform(X.regex_scan(flat, COINSURANCE), lambda m: F.struct(F.lit("coinsurance").alias("type"), F.lit(None).cast("double").alias("amount_usd"), F.regexp_extract(m["quote"], COINSURANCE, 1).try_cast("double").alias("percent"), F.trim(F.regexp_extract(m["quote"], COINSURANCE, 2)).alias("applies_to"), F.trim(m["quote"]).alias("evidence_quote")))
    domains = F.array_sort(F.array_compact(F.array(*[F.when(F.lower(flat).contains(k), v) for k, v in DOMAINS])))
    return F.struct(
        name.alias("package_name"), name.alias("package_name_evidence"), domains.alias("benefit_domains"), net.alias("network_restriction"), _first(flat, NETWORK).alias("network_restriction_evidence"),
        stub_services(flat).alias("services"), F.concat(copays, shares).alias("cost_share"), stub_exclusions(flat).alias("exclusions"), (~F.rtrim(flat).rlike(r"[.:;]$")).alias("truncated"),
    )


def stub_replies(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, reply, degraded, n_calls, n_repairs): the offline reading of every package block, in the shape of settle()."""
    return blocks.where("kind = 'package'").select("doc_id", "block_id", stub_reply(F.col("flat")).alias("reply"), F.lit(False).alias("degraded"), F.lit(1).cast("bigint").alias("n_calls"), F.lit(0).cast("bigint").alias("n_repairs"))


def reply_json(example: dict) -> str:
    """A reply as a model writes it."""
    return json.dumps(example)
