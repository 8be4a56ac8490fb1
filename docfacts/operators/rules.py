"""Validation of merged packages (stage 5): evidence nodes in long form, rules as relations of nodes and children to flags.

The rules run in order: the first withholds values whose quote isn't in the source, and the others see what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions import textops as X
from docfacts.functions.tables import durable

#: The bound of low confidence, and statuses that need a human.
LOW_CONFIDENCE, REVIEW = 0.7, ["ambiguous", "unverified", "truncated"]
FLAG = ["doc_id", "rule", "severity", "path"]


def _flag(rule: str | Column, severity: str | Column, path: Column | str = "path") -> list[Column]:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return [F.col("doc_id"), as_col(rule).alias("rule"), as_col(severity).alias("severity"), (F.col(path) if isinstance(path, str) else path).alias("path")]


def evidence_nodes(packages: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, package, kind, status, confidence, quote, start, end, amount_usd, percent, span_start, span_end): every field that carries evidence.

    packages: rows of merge(). path is a JSON pointer by the package's place in its document; document fields have a null package.
    """
    ordered = _pathed(packages)
    null = F.lit(None).cast("double")

    def node(kind: str, path: Column, x: Column, status: Column, amount: Column, percent: Column, confidence: Column) -> Column:
        return F.struct(path.alias("path"), F.lit(kind).alias("kind"), status.alias("status"), confidence.cast("double").alias("confidence"), x["evidence"]["quote"].alias("quote"), x["evidence"]["start"].alias("start"), x["evidence"]["end"].alias("end"), amount.cast("double").alias("amount_usd"), percent.cast("double").alias("percent"))

    single = F.array(*[node(k, F.concat("base", F.lit(f"/{k}")), F.col(k), F.col(f"{k}.status"), F.col(f"{k}.amount_usd") if k in ("premium", "benefit_maximum") else null, null, F.col(f"{k}.confidence")) for k in ("name", "premium", "benefit_maximum", "network")])

    def many(k: str, status: Callable[[Column], Column], amount: Callable[[Column], Column], percent: Callable[[Column], Column], confidence: Callable[[Column], Column]) -> Column:
        return F.transform(k, lambda x, i: node(k, F.concat("base", F.lit(f"/{k}/"), i.cast("string")), x, status(x), amount(x), percent(x), confidence(x)))

    none = lambda x: null
    lists = [
        many("services", lambda x: x["status"], none, none, lambda x: x["confidence"]), many("codes", lambda x: F.lit(None).cast("string"), none, none, none),
        many("cost_share", lambda x: x["status"], lambda x: x["amount_usd"], lambda x: x["percent"], lambda x: x["confidence"]), many("exclusions", lambda x: x["status"], none, none, lambda x: x["confidence"]),
    ]
    rows = ordered.select("doc_id", F.col("block_id").alias("package"), "span_start", "span_end", F.explode(F.concat(single, *lists)).alias("n")).select("doc_id", "package", "n.*", "span_start", "span_end")
    if info is None:
        return rows
    facts = F.array(*[F.struct(F.lit(f"/document/{k}").alias("path"), F.lit("document").alias("kind"), F.when(F.col(k).isNotNull(), "found").otherwise("not_stated").alias("status"), F.col(f"{k}.confidence").alias("confidence"), F.col(f"{k}.quote").alias("quote"), F.col(f"{k}.start").cast("int").alias("start"), F.col(f"{k}.end").cast("int").alias("end"), null.alias("amount_usd"), null.alias("percent")) for k in ("plan_name", "plan_year", "document_type", "form_id")] + [F.struct(F.lit("/document/issuer").alias("path"), F.lit("document").alias("kind"), F.lit("not_stated").alias("status"), null.alias("confidence"), F.lit(None).cast("string").alias("quote"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), null.alias("amount_usd"), null.alias("percent"))])
    top = info.select("doc_id", F.lit(None).cast("string").alias("package"), F.explode(facts).alias("n"), F.lit(None).cast("int").alias("span_start"), F.lit(None).cast("int").alias("span_end")).select("doc_id", "package", "n.*", "span_start", "span_end")
    return rows.unionByName(top)


def _by_doc():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id")


def ground(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes with found_start, found_end, withheld: quotes looked for again, inside the package and then anywhere; offsets corrected; values of missing quotes withheld."""
    at = X.locate(F.col("flat"), F.col("quote"), F.coalesce("span_start", F.lit(0)), F.coalesce("span_end", F.char_length("flat")))
    out = nodes.join(docs.select("doc_id", "flat"), "doc_id").withColumn("at", at)
    gone = F.col("quote").isNotNull() & F.col("at").isNull()
    return out.withColumns({
        "found_start": F.col("at.start"), "found_end": F.col("at.end"), "withheld": gone, "status": F.when(gone & F.col("status").isNotNull(), "unverified").otherwise(F.col("status")),
        "amount_usd": F.when(~gone, F.col("amount_usd")), "percent": F.when(~gone, F.col("percent")),
    }).drop("flat", "at")


def groundedness(grounded: DataFrame) -> DataFrame:
    """missing_evidence, not_in_source (errors), offset_mismatch, out_of_package_span (warnings)."""
    n = grounded
    missing = n.where(F.col("quote").isNull() & F.col("status").isNotNull() & ~F.col("status").isin("not_stated", "unverified")).select(*_flag("groundedness.missing_evidence", "error"))
    lost = n.where("withheld").select(*_flag("groundedness.not_in_source", "error"))
    moved = n.where("found_start IS NOT NULL AND (found_start <> start OR found_end <> end)").select(*_flag("groundedness.offset_mismatch", "warn"))
    outside = n.where("found_start IS NOT NULL AND span_start IS NOT NULL AND NOT (found_start >= span_start AND found_start < span_end)").select(*_flag("groundedness.out_of_package_span", "warn"))
    return missing.unionByName(lost).unionByName(moved).unionByName(outside)


def numeric(grounded: DataFrame) -> DataFrame:
    """not_in_evidence: an amount or a percentage that its own quote doesn't hold."""
    claims = grounded.where("quote IS NOT NULL").withColumn("bad", F.array_compact(F.array(F.when(F.col("amount_usd").isNotNull() & ~F.array_contains(X.amounts(F.col("quote")), F.col("amount_usd")), F.lit("money")), F.when(F.col("percent").isNotNull() & ~F.array_contains(X.percents(F.col("quote")), F.col("percent")), F.lit("percent")))))
    return claims.select("doc_id", "path", F.explode("bad").alias("b")).select(*_flag("numeric.not_in_evidence", "error"))


def _pathed(packages: DataFrame) -> DataFrame:
    """packages with base, the pointer of a package; they may have it already."""
    return packages if "base" in packages.columns else packages.withColumn("base", F.concat(F.lit("/packages/"), (F.col("block_seq") - F.min("block_seq").over(_by_doc())).cast("string")))


def invariants(packages: DataFrame) -> DataFrame:
    """premium_missing, coinsurance_without_percent, copay_without_amount, conflicting_cost_share (errors), exclusions_not_stated (warning)."""
    p = _pathed(packages)
    out = p.where("premium.status = 'not_stated'").select(*_flag("invariants.premium_missing", "error", F.concat("base", F.lit("/premium"))))
    out = out.unionByName(p.where("size(exclusions) = 0").select(*_flag("invariants.exclusions_not_stated", "warn", F.concat("base", F.lit("/exclusions")))))
    shares = p.select("doc_id", "base", F.posexplode("cost_share").alias("j", "s"))
    lacking = F.when((F.col("s.type") == "coinsurance") & F.col("s.percent").isNull(), "invariants.coinsurance_without_percent").when((F.col("s.type") == "copay") & F.col("s.amount_usd").isNull(), "invariants.copay_without_amount")
    out = out.unionByName(shares.where(lacking.isNotNull() & (F.col("s.status") == "found")).select(*_flag(lacking, "error", F.concat("base", F.lit("/cost_share/"), F.col("j").cast("string")))))
    of = lambda kind: F.array_distinct(F.flatten(F.transform(F.filter("cost_share", lambda s: s["type"] == kind), lambda s: F.coalesce(s["service_ids"], F.array().cast("array<string>")))))
    both = p.select("doc_id", "base", F.explode(F.array_intersect(of("copay"), of("coinsurance"))).alias("sid"))
    return out.unionByName(both.select(*_flag("invariants.conflicting_cost_share", "error", "base")))


def _strange(used: Column, own: Column) -> Column:
    """The elements of a list that another lacks, repeats and nulls too; a null list has none."""
    known = F.coalesce(own, F.array().cast("array<string>"))
    return F.filter(used, lambda x: ~F.coalesce(F.array_contains(known, x), F.lit(False)))


def references(packages: DataFrame) -> DataFrame:
    """unknown_code, unknown_service (errors) against the package's own, inside its row, and code_without_description (warning)."""
    p = _pathed(packages)
    used = p.select("doc_id", "base", F.posexplode("services").alias("j", "s"), F.col("codes.code").alias("own")).select("doc_id", "base", "j", F.explode(_strange(F.col("s.codes"), F.col("own"))).alias("code"))
    out = used.select(*_flag("references.unknown_code", "error", F.concat("base", F.lit("/services/"), F.col("j").cast("string"))))
    named = p.select("doc_id", "base", F.posexplode("cost_share").alias("j", "s"), F.col("services.service_id").alias("own")).select("doc_id", "base", "j", F.explode(_strange(F.col("s.service_ids"), F.col("own"))).alias("sid"))
    out = out.unionByName(named.select(*_flag("references.unknown_service", "error", F.concat("base", F.lit("/cost_share/"), F.col("j").cast("string")))))
    bare = p.select("doc_id", "base", F.posexplode("codes").alias("j", "c")).where("c.description IS NULL")
    return out.unionByName(bare.select(*_flag("references.code_without_description", "warn", F.concat("base", F.lit("/codes/"), F.col("j").cast("string")))))


def review(grounded: DataFrame, packages: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """degraded and low_certainty of packages, document.truncated; low_certainty is information where only the confidence is low."""
    low = F.col("status").isin(*REVIEW)
    weak = grounded.where(F.col("package").isNotNull() & (F.coalesce(low, F.lit(False)) | (F.col("confidence") < LOW_CONFIDENCE) & (F.coalesce("status", F.lit("")) != "not_stated")))
    out = weak.select(*_flag("review.low_certainty", F.when(F.coalesce(low, F.lit(False)), "warn").otherwise("info")))
    out = out.unionByName(_pathed(packages).where("degraded").select(*_flag("review.degraded", "warn", "base")))
    return out if info is None else out.unionByName(info.where("truncated").select(*_flag("document.truncated", "warn", F.lit("/document/truncated"))))


def no_packages(docs: DataFrame, packages: DataFrame) -> DataFrame:
    """segmentation.no_packages of documents without a package."""
    return docs.select("doc_id").join(packages.select("doc_id"), "doc_id", "left_anti").select(*_flag("segmentation.no_packages", "warn", F.lit("/packages")))


#: The rules, in the order in which flags are listed; a new check is a new entry.
RULES: list[tuple[str, Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]]] = [
    ("groundedness", lambda nodes, packages, info: groundedness(nodes)),
    ("numeric", lambda nodes, packages, info: numeric(nodes)),
    ("invariants", lambda nodes, packages, info: invariants(packages)),
    ("references", lambda nodes, packages, info: references(packages)),
    ("review", review),
]


def validate(docs: DataFrame, packages: DataFrame, info: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(flags, metrics): all flags of RULES and of documents without packages; and for each document fields_total,
    fields_grounded (quotes anywhere in the document), fields_null, groundedness_rate (4 places, half to even), passed, needs_review."""
    # Pointers and the header's facts are worked out once: nearly every rule needs them.
    packages, docs, info = durable(_pathed(packages)), durable(docs.select("doc_id", "flat")), None if info is None else durable(info)
    nodes = durable(ground(evidence_nodes(packages, info), docs))
    flags = no_packages(docs, packages)
    for _, rule in RULES:
        flags = flags.unionByName(rule(nodes, packages, info))
    counts = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fields_total"), F.count_if(F.col("found_start").isNotNull()).alias("fields_grounded"), F.count_if(F.col("quote").isNull()).alias("fields_null"))
    grave = flags.groupBy("doc_id").agg(F.max(F.col("severity") == "error").alias("failed"), F.max(F.col("severity").isin("error", "warn")).alias("flagged"))
    metrics = docs.select("doc_id").join(counts, "doc_id", "left").join(grave, "doc_id", "left").fillna(0, ["fields_total", "fields_grounded", "fields_null"])
    rate = F.bround(F.col("fields_grounded") / F.greatest(F.col("fields_total") - F.col("fields_null"), F.lit(1)), 4)
    return flags, metrics.select("doc_id", "fields_total", "fields_grounded", "fields_null", rate.alias("groundedness_rate"), (~F.coalesce("failed", F.lit(False))).alias("passed"), F.coalesce("flagged", F.lit(False)).alias("needs_review"))


def needs_review(packages: DataFrame, grounded: DataFrame) -> DataFrame:
    """(doc_id, package, needs_review): packages that are degraded or hold a field of low certainty."""
    low = F.coalesce(F.col("status").isin(*REVIEW), F.lit(False)) | ((F.col("confidence") < LOW_CONFIDENCE) & (F.coalesce("status", F.lit("")) != "not_stated"))
    weak = grounded.where(F.col("package").isNotNull()).groupBy("doc_id", "package").agg(F.max(F.coalesce(low, F.lit(False))).alias("weak"))
    own = packages.select("doc_id", F.col("block_id").alias("package"), "degraded")
    return own.join(weak, ["doc_id", "package"], "left").select("doc_id", "package", (F.col("degraded") | F.coalesce("weak", F.lit(False))).alias("needs_review"))


def revalidate(nodes: DataFrame, docs: DataFrame, fix_offsets: bool = False) -> DataFrame:
    """Committed nodes checked again against their source; with fix_offsets the nodes with their corrected places instead of flags.

    Besides the rules on evidence: amounts that are not positive (but for copays) and percentages outside 0..100.
    """
    checked = ground(nodes, docs)
    if fix_offsets:
        return checked.withColumns({"start": F.coalesce("found_start", "start"), "end": F.coalesce("found_end", "end")}).drop("found_start", "found_end", "withheld")
    odd = F.when((F.col("amount_usd") < 0) | ((F.col("amount_usd") == 0) & (F.col("kind") != "cost_share")), "numeric.not_positive").when((F.col("percent") < 0) | (F.col("percent") > 100), "numeric.percent_range")
    return groundedness(checked).unionByName(numeric(checked)).unionByName(checked.where(odd.isNotNull()).select(*_flag(odd, "error")))


def code_shapes(packages: DataFrame) -> DataFrame:
    """code.bad_shape: declared codes that aren't a letter D and four digits, once for each package."""
    bad = _pathed(packages).where(F.exists("codes", lambda c: ~c["code"].rlike(r"^D\d{4}$")))
    return bad.select(*_flag("code.bad_shape", "error", F.concat("base", F.lit("/codes"))))


def review_missing(packages: DataFrame, grounded: DataFrame, told: DataFrame) -> DataFrame:
    """review.flag_missing: packages with fields of low certainty whose committed needs_review (told: doc_id, package, needs_review) is not true."""
    due = needs_review(packages, grounded).where("needs_review").select("doc_id", "package")
    said = told.where("needs_review").select("doc_id", "package")
    base = _pathed(packages).select("doc_id", F.col("block_id").alias("package"), "base")
    return due.join(said, ["doc_id", "package"], "left_anti").join(base, ["doc_id", "package"]).select(*_flag("review.flag_missing", "error", "base"))
