"""Scanner candidates and the model's reading to packages with evidence (stage 4).

Numbers come from the scanners, meaning from the model, and nothing enters without a quote found in the source. All of a
package is worked out in its own row (its lists are as short as a page or two of text allows), so the stage shuffles
once, to bring candidates, reply and document together by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions import textops as X

#: Names that enumerations allow, words that say nothing about a service, and the numbers of the merge policy.
CATEGORIES = ["diagnostic", "preventive", "restorative", "endodontic", "periodontic", "oral_surgery", "vision", "other"]
PERIODS = ["per_year", "per_calendar_year", "per_month", "per_lifetime"]
SHARE_TYPES = ["copay", "coinsurance", "deductible", "unknown"]
EXCLUSION_KINDS = ["service_excluded", "network_restriction", "member_liability", "claims_process", "accumulator", "other"]
STOPWORDS = ["the", "and", "for", "listed", "services", "service", "dental", "your", "you", "of", "a"]
AGREED, AGREED_MOST, CONTRADICTED_MOST, PAIR_DISTANCE = 0.02, 0.99, 0.75, 40


def coerce(value: Column, allowed: list[str], otherwise: Column) -> Column:
    """A value of an enumeration, null for null, ``otherwise`` for a strange one."""
    return F.when(value.isNull() | (value == ""), F.lit(None).cast("string")).when(value.isin(*allowed), value).otherwise(otherwise)


def evidence(quote: Column) -> Column:
    """A quote's place inside the package, else anywhere in the document, with its page; null if it isn't in the source."""
    return X.let(_locate(quote), lambda at: F.when(at.isNotNull(), F.struct(X.collapse(quote, compose=False).alias("quote"), at["start"].alias("start"), at["end"].alias("end"), X.page_at(F.col("page_starts"), at["start"]).alias("page"))))


def _locate(quote: Column) -> Column:
    """X.locate of a quote in doc_flat between start and end, in whose place ``inside`` is, cut out once for all quotes of a package."""

    def place(needle: Column) -> Column:
        at = X.let(F.instr("inside", needle), lambda i: F.when(i > 0, F.col("start") + i).otherwise(F.instr("doc_flat", needle)))
        return X.let(at, lambda i: F.when((i > 0) & (needle != ""), F.struct((i - 1).cast("int").alias("start"), (i - 1 + F.char_length(needle)).cast("int").alias("end"))))

    return X.let(X.collapse(quote, compose=False), place)


def cut_off(ev: Column) -> Column:
    """Whether evidence reaches the package's end without an end of its sentence."""
    return F.coalesce((ev["end"] >= F.col("end") - 1) & ~F.rtrim(ev["quote"]).rlike(r"[.!?:;]$"), F.lit(False))


def _status(ev: Column) -> Column:
    return F.when(cut_off(ev), "truncated").otherwise("found")


def _single(kind: str) -> Column:
    """The candidates of a kind, and whether their amounts differ."""
    c = F.filter("cands", lambda x: x["kind"] == kind)
    first = F.try_element_at(c, F.lit(1))
    several = F.size(F.array_distinct(F.transform(c, lambda x: x["amount_usd"]))) > 1
    return F.struct(first.alias("first"), (F.size(c) > 0).alias("there"), several.alias("several"), F.size(c).alias("n"))


def _inputs(docs: DataFrame, blocks: DataFrame, candidates: DataFrame, replies: DataFrame) -> DataFrame:
    grouped = candidates.groupBy("doc_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "quote", "amount_usd", "percent", "span", "applies_to", "code", "description", "count", "unit", "share", "confidence", F.col("start").alias("c_start"), F.col("end").alias("c_end")))).alias("cands"))
    out = blocks.where("kind = 'package'").join(docs.select("doc_id", F.col("flat").alias("doc_flat"), "page_starts"), "doc_id")
    out = out.join(grouped, ["doc_id", "block_id"], "left").join(replies, ["doc_id", "block_id"], "left")
    empty = F.array().cast(grouped.schema["cands"].dataType)
    out = out.withColumn("inside", F.substring("doc_flat", F.col("start") + 1, F.col("end") - F.col("start")))
    return out.withColumns({"cands": F.coalesce("cands", empty), "degraded": F.coalesce("degraded", F.lit(True))})


def _list(field: str, kind: str) -> Column:
    return F.coalesce(F.col(f"reply.{field}"), F.array().cast(f"array<{kind}>"))


def merge(docs: DataFrame, blocks: DataFrame, candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """One row for each package: name, premium, benefit_maximum, network, domains, codes, services, cost_share, exclusions.

    Fields are STRUCT<status, confidence, source, evidence, ...>. A missing premium cadence is monthly, a missing period of a
    maximum per_year; several different amounts are ambiguous and give none. A package without a reply keeps what the scanners
    read and is degraded.
    """
    from docfacts.operators import model

    df = _inputs(docs, blocks, candidates, replies)
    df = df.withColumns({"p": _single("premium"), "m": _single("benefit_maximum"), "w": _single("network_restriction"), "name_ev": evidence(F.col("heading"))})
    df = df.withColumns({"p_ev": evidence(F.col("p.first.quote")), "m_ev": evidence(F.col("m.first.quote")), "w_ev": evidence(F.col("w.first.quote")), "net_ev": evidence(F.coalesce(F.col("reply.network_restriction_evidence"), F.col("reply.network_restriction")))})
    name = F.struct(F.when(F.col("name_ev").isNotNull(), X.collapse(F.col("heading"), compose=False)).alias("value"), F.when(F.col("name_ev").isNotNull(), "found").otherwise("not_stated").alias("status"), F.when(F.col("name_ev").isNotNull(), 0.99).otherwise(0.0).alias("confidence"), F.lit("deterministic").alias("source"), F.col("name_ev").alias("evidence"))

    def amount(x: str, ev: str, default: str) -> Column:
        ok = F.col(f"{x}.there") & ~F.col(f"{x}.several")
        return F.struct(
            F.when(ok, F.col(f"{x}.first.amount_usd")).alias("amount_usd"), F.when(ok, F.coalesce(F.col(f"{x}.first.span"), F.lit(default))).alias("span"), F.when(ok, F.col(f"{x}.first.applies_to")).alias("applies_to"),
            F.when(~F.col(f"{x}.there"), "not_stated").when(F.col(f"{x}.several"), "ambiguous").otherwise("found").alias("status"), F.when(ok, F.col(f"{x}.first.confidence")).otherwise(0.0).alias("confidence"),
            F.lit("deterministic").alias("source"), F.col(ev).alias("evidence"),
        )

    said = F.col("reply.network_restriction")
    agreed = F.coalesce(F.contains(F.lower(X.collapse(F.col("w.first.quote"), compose=False)), F.lower(X.collapse(said, compose=False))) & (said != ""), F.lit(False))
    by_model = said.isNotNull() & (said != "") & F.col("net_ev").isNotNull()
    network = F.struct(
        F.when(F.col("w.there"), F.col("w.first.applies_to")).when(by_model, X.collapse(said, compose=False)).alias("value"), F.when(F.col("w.there") | by_model, "found").otherwise("not_stated").alias("status"),
        F.when(F.col("w.there"), F.least(F.lit(AGREED_MOST), F.col("w.first.confidence") + F.when(agreed, AGREED).otherwise(0.0))).when(by_model, 0.8).otherwise(0.0).alias("confidence"),
        F.when(F.col("w.there"), F.when(agreed, "merged").otherwise("deterministic")).when(by_model, "llm").otherwise("deterministic").alias("source"), F.when(F.col("w.there"), F.col("w_ev")).when(by_model, F.col("net_ev")).alias("evidence"),
    )
    named = F.transform(F.filter(F.array(*[F.lit(x) for x in ("dental", "hearing", "vision")]), lambda d: F.contains(F.lower(F.coalesce("heading", F.lit(""))), d)), lambda d: d)
    told = F.array_sort(F.array_distinct(F.transform(_list("benefit_domains", "string"), lambda d: F.lower(d))))
    df = df.withColumn("all_codes", F.filter("cands", lambda c: c["kind"] == "code"))
    df = df.withColumn("code_names", F.transform("all_codes", lambda y: y["code"]))
    first_codes = F.filter(F.transform("all_codes", lambda c, i: F.struct(c["code"].alias("code"), c["description"].alias("description"), c["quote"].alias("quote"), i.alias("i"))), lambda x: F.array_position(F.col("code_names"), x["code"]) == x["i"] + 1)
    codes = F.transform(first_codes, lambda x: F.struct(x["code"].alias("code"), F.nullif(x["description"], F.lit("")).alias("description"), evidence(x["quote"]).alias("evidence")))
    df = df.withColumns({"name": name, "premium": amount("p", "p_ev", "monthly"), "benefit_maximum": amount("m", "m_ev", "per_year"), "network": network, "domains": F.when(F.size(told) > 0, told).otherwise(named), "codes": codes})
    df = df.withColumns({"declared": F.transform("codes", lambda c: c["code"]), "limits": F.filter("cands", lambda c: c["kind"] == "limit")})
    no_codes = F.array().cast("array<string>")

    def matched_service(s: Column) -> Column:
        def with_limit(ev: Column) -> Column:
            match = F.try_element_at(F.filter("limits", lambda c: (c["c_start"] < ev["end"]) & (ev["start"] < c["c_end"])), F.lit(1))
            kept = s["limit_count"].isNull() | F.array_contains(X.amounts(ev["quote"]), s["limit_count"]) | F.contains(ev["quote"], F.floor(s["limit_count"]).cast("string"))
            told = F.coalesce(s["codes"], no_codes)
            return F.struct(s.alias("s"), ev.alias("ev"), match.alias("m"), kept.alias("kept"), F.filter(told, lambda c: F.array_contains(F.col("declared"), c)).alias("own"), F.filter(told, lambda c: ~F.array_contains(F.col("declared"), c)).alias("dropped"), cut_off(ev).alias("cut"))

        return X.let(evidence(s["evidence_quote"]), with_limit)

    def service(y: Column) -> Column:
        x, ev, match, there, matched, kept = y["s"], y["ev"], y["m"], y["ev"].isNotNull(), y["m"].isNotNull(), y["kept"]
        note = F.when(matched & (x["limit_count"] != match["count"]), "the scanner read another count from the same phrase").when(~matched & ~kept, "the count was not in the evidence and was dropped")
        return F.struct(
            F.concat("block_id", F.lit(".svc_"), X.slug(x["name"])).alias("service_id"), x["name"].alias("name"), F.when(there, coerce(x["category"], CATEGORIES, F.lit("other"))).alias("category"),
            F.when(there, F.when(matched, match["count"]).when(kept, x["limit_count"])).alias("limit_count"), F.when(there, F.when(matched, match["unit"]).otherwise(x["limit_unit"])).alias("limit_unit"),
            F.when(there, F.when(matched, match["span"]).otherwise(coerce(x["limit_period"], PERIODS, F.lit(None).cast("string")))).alias("limit_period"), F.when(there, F.when(matched, X.collapse(match["quote"], compose=False)).otherwise(x["limit_raw"])).alias("limit_raw"),
            F.when(there, y["own"]).otherwise(no_codes).alias("codes"), F.when(there, y["dropped"]).otherwise(no_codes).alias("dropped_codes"),
            F.when(~there, "unverified").when(y["cut"] & F.coalesce(F.col("reply.truncated"), F.lit(False)), "truncated").otherwise("found").alias("status"),
            F.when(~there, 0.0).when(note.isNull(), 0.9).otherwise(0.8).alias("confidence"), F.when(~there, "llm").when(note.isNull(), "merged").otherwise("llm").alias("source"), ev.alias("evidence"), F.when(there, note).otherwise("the quote is not in the source").alias("notes"),
        )

    df = df.withColumn("matched", F.transform(_list("services", model.SERVICE), matched_service)).withColumn("services", F.transform("matched", service))
    words = lambda s: F.filter(F.split(F.lower(s["name"]), r"\W+"), lambda t: (t != "") & ~t.isin(*STOPWORDS))
    df = df.withColumn("known", F.transform(F.filter("services", lambda s: s["status"] == "found"), lambda s: F.struct(s["service_id"].alias("id"), F.lower(s["name"]).alias("name"), F.coalesce(s["category"].isin("preventive", "diagnostic"), F.lit(False)).alias("early"), F.transform(words(s), lambda t: F.regexp_replace(t, "s+$", "")).alias("words"))))
    df = df.withColumns({
        "scanned": F.transform(F.filter("cands", lambda c: c["kind"] == "cost_share"), lambda c: F.struct(c.alias("c"), evidence(c["quote"]).alias("ev"))),
        "told": F.filter(F.transform(_list("cost_share", model.COST_SHARE), lambda s: F.struct(s.alias("s"), evidence(s["evidence_quote"]).alias("ev"))), lambda x: x["ev"].isNotNull()),
    })
    # Greedy pairing: each scanned share takes the first unused told one whose evidence begins less than PAIR_DISTANCE away.
    start = F.array().cast("array<int>")

    def pair(done: Column, c: Column) -> Column:
        free = F.filter(F.transform("told", lambda x, j: F.struct(x["ev"]["start"].alias("at"), j.alias("j"))), lambda x: ~F.array_contains(done, x["j"]) & (F.abs(x["at"] - c["ev"]["start"]) < PAIR_DISTANCE))
        return F.concat(done, F.array(F.coalesce(F.try_element_at(free, F.lit(1))["j"], F.lit(-1))))

    df = df.withColumn("pairs", F.aggregate("scanned", start, pair))

    def services_of(text: Column) -> Column:
        def ids(low: Column) -> Column:
            hit = lambda s: F.contains(low, s["name"]) | ((F.size(s["words"]) > 0) & F.forall(s["words"], lambda t: F.contains(low, t))) | (F.contains(low, F.lit("preventive")) & s["early"])
            return F.array_sort(F.array_distinct(F.transform(F.filter("known", hit), lambda s: s["id"])))

        return F.when(text.isNull(), no_codes).otherwise(X.let(F.lower(X.collapse(text, compose=False)), ids))

    def scanned_share(x: Column, i: Column) -> Column:
        j = F.get(F.col("pairs"), i)
        told = F.get(F.col("told"), F.when(j >= 0, j))["s"]
        c = x["c"]
        text = F.coalesce(F.nullif(told["applies_to"], F.lit("")), c["applies_to"])
        clash = F.coalesce(~told["percent"].eqNullSafe(c["percent"]) & told["percent"].isNotNull(), F.lit(False)) | F.coalesce(~told["amount_usd"].eqNullSafe(c["amount_usd"]) & told["amount_usd"].isNotNull(), F.lit(False))
        return F.struct(
            F.concat("block_id", F.lit(".cs_"), (i + 1).cast("string")).alias("cost_share_id"), c["share"].alias("type"), c["amount_usd"].alias("amount_usd"), c["percent"].alias("percent"), text.alias("applies_to"), services_of(text).alias("service_ids"),
            _status(x["ev"]).alias("status"), F.when(clash, F.least(c["confidence"], F.lit(CONTRADICTED_MOST))).otherwise(c["confidence"]).alias("confidence"), F.when(j >= 0, "merged").otherwise("deterministic").alias("source"), x["ev"].alias("evidence"),
            F.when(clash, "the scanner read other numbers from the same sentence").alias("notes"),
        )

    loose = F.filter(F.transform("told", lambda x, j: F.struct(x.alias("x"), j.alias("j"))), lambda y: ~F.array_contains("pairs", y["j"]))

    def told_share(y: Column, k: Column) -> Column:
        s, ev = y["x"]["s"], y["x"]["ev"]
        ok = (s["amount_usd"].isNull() | F.array_contains(X.amounts(ev["quote"]), s["amount_usd"])) & (s["percent"].isNull() | F.array_contains(X.percents(ev["quote"]), s["percent"]))
        return F.struct(
            F.concat("block_id", F.lit(".cs_"), (F.size("scanned") + k + 1).cast("string")).alias("cost_share_id"), F.when(s["type"].isin(*SHARE_TYPES), s["type"]).otherwise("unknown").alias("type"), F.when(ok, s["amount_usd"]).alias("amount_usd"),
            F.when(ok, s["percent"]).alias("percent"), s["applies_to"].alias("applies_to"), services_of(s["applies_to"]).alias("service_ids"), F.when(ok, "found").otherwise("unverified").alias("status"), F.when(ok, 0.85).otherwise(0.0).alias("confidence"),
            F.lit("llm").alias("source"), ev.alias("evidence"), F.when(~ok, "the numbers are not in the evidence").alias("notes"),
        )

    def exclusion(x: Column, i: Column) -> Column:
        return X.let(evidence(x["evidence_quote"]), lambda ev: F.struct(F.concat("block_id", F.lit(".ex_"), (i + 1).cast("string")).alias("exclusion_id"), X.collapse(x["text"], compose=False).alias("text"), coerce(x["kind"], EXCLUSION_KINDS, F.lit("other")).alias("kind"), _status(ev).alias("status"), F.lit(0.9).alias("confidence"), F.lit("llm").alias("source"), ev.alias("evidence")))

    df = df.withColumns({
        "cost_share": F.concat(F.transform("scanned", scanned_share), F.transform(loose, told_share)),
        "exclusions": F.filter(F.transform(_list("exclusions", model.EXCLUSION), exclusion), lambda x: x["evidence"].isNotNull()),
    })
    return df.select("doc_id", "block_id", "block_seq", "ordinal", "name", "premium", "benefit_maximum", "network", "domains", "codes", "services", "cost_share", "exclusions", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "pages", "degraded")


def document_info(docs: DataFrame, header: DataFrame) -> DataFrame:
    """(doc_id, plan_name, plan_year, document_type, form_id, pages, truncated, n_chars): the header's facts whose quote is in the source."""
    facts = header.join(docs.select("doc_id", "flat"), "doc_id").where(F.contains("flat", X.collapse(F.col("quote"), compose=False)))
    wide = facts.groupBy("doc_id").agg(*[F.max(F.when(F.col("kind") == k, F.struct("value", "quote", "start", "end", "confidence"))).alias(k) for k in ("plan_name", "plan_year", "document_type", "form_id")])
    base = docs.select("doc_id", F.array_sort(F.array_distinct(F.array_compact(F.transform("page_starts", lambda p: p["page"])))).alias("pages"), (~F.col("flat").rlike(r"[.!?:;]$")).alias("truncated"), F.char_length("flat").alias("n_chars"))
    return base.join(wide, "doc_id", "left")
