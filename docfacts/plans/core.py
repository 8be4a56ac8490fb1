"""Queries of the document operators over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions import textops as X
from docfacts.functions.tables import durable, table
from docfacts.operators import calls, geometry, guide, jobs, mapping, merge, model, normalize, readers, rules, scanners, segment
from docfacts.plans import corpus, pipeline
from docfacts.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _put(form: str, column: str) -> str:
    """SQL of an expression with its column put in."""
    return form.replace("{0}", column)


# -- shared inputs ---------------------------------------------------------------------------------------------------

#: Page anchor and package heading of the table ``documents``.
DOC_ANCHOR = r"(?m)^[ \t]*(\d{1,4})[ \t]+(?:19|20)\d{2}\s+Evidence of Benefits"
DOC_HEADING = r"(?im)^[ \t]*Optional[ \t]+package[ \t]+(\d+)[ \t]*[-:][ \t]*(.+)$"


#: Written stages of the synthesised documents, by application and directory: queries of one session normalise once.
_STAGES: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, d: str, name: str, make: Callable[[], object]) -> object:
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STAGES:
        _STAGES[key] = make()
    return _STAGES[key]


def _extraction(spark: SparkSession, d: str) -> pipeline.Extraction:
    return _once(spark, d, "packages", lambda: pipeline.extract(corpus.plan_docs(spark, d), docs=_docs(spark, d), blocks=_blocks(spark, d)))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "docs", lambda: durable(normalize.normalize(corpus.plan_docs(spark, d))))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "blocks", lambda: durable(segment.blocks(_docs(spark, d))))


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    done = _extraction(spark, d)
    return done.docs, done.blocks, done.packages


_WS = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_FOLD = "translate({0}, '–—−‐‑' || chr(173) || chr(1) || chr(2), '-----')"
_COLLAPSE = "trim(regexp_replace(" + _FOLD + f", '{_WS}+', ' ', 'g'))"
_LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_LINES = f"CASE WHEN {{0}} = '' THEN [] ELSE string_split_regex(regexp_replace({{0}}, '(?:{_LINE_END})$', ''), '{_LINE_END}') END"

#: Common tables of the synthesised documents: docs, pages, lines, n (text and flat), heads, b (blocks).
_NORM = rf"""
docs AS ({corpus.PLAN_DOCS}),
pages AS (SELECT doc_id, unnest(generate_series(0, len(ps) - 1)) AS page_seq, unnest(ps) AS body FROM (
  SELECT doc_id, string_split(regexp_replace(raw, '(?m)^(\d+ 2024 Evidence of Coverage)', chr(1) || '\1', 'g'), chr(1)) AS ps FROM docs)),
lines AS (SELECT doc_id, page_seq, page, n, unnest(generate_series(0, n - 1)) AS line_no, unnest(ls) AS line FROM (
  SELECT doc_id, page_seq, CAST(regexp_extract(body, '^\d+') AS INT) AS page, ls, len(ls) AS n FROM (SELECT *, string_split(rtrim(body, chr(10)), chr(10)) AS ls FROM pages WHERE body <> ''))),
keyed AS (SELECT *, regexp_replace({_put(_COLLAPSE, "line")}, '\d+', '#', 'g') AS key, line_no < 5 OR line_no >= n - 3 AS in_zone FROM lines),
marked AS (SELECT *, boiler AND in_zone AND nth > 1 AS dropped FROM (SELECT *, length(key) >= 15 AND min(page_seq) OVER k <> max(page_seq) OVER k AND bool_or(in_zone) OVER k AS boiler,
  row_number() OVER (PARTITION BY doc_id, key ORDER BY page_seq, line_no) AS nth FROM keyed WINDOW k AS (PARTITION BY doc_id, key))),
kept AS (SELECT doc_id, page_seq, any_value(page) AS page, string_agg(trim({_put(_FOLD, "line")}), chr(10) ORDER BY line_no) AS t FROM marked WHERE NOT dropped AND trim(line) <> '' GROUP BY doc_id, page_seq),
starts AS (SELECT doc_id, page_seq, page, CAST(coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY page_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM kept),
n AS (SELECT doc_id, text, rtrim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM (SELECT doc_id, string_agg(t, chr(10) ORDER BY page_seq) AS text FROM kept GROUP BY doc_id)),
cuts AS (SELECT doc_id, text, flat, unnest(generate_series(1, len(ps))) AS i, unnest(ps) AS piece FROM (
  SELECT doc_id, text, flat, string_split(regexp_replace(text, '(?m)^(Optional supplemental package \d+ *[-:])', chr(1) || '\1', 'g'), chr(1)) AS ps FROM n)),
b AS (SELECT doc_id, flat AS doc_flat, i - 1 AS block_seq, CASE WHEN i = 1 THEN 'header' ELSE 'pkg_' || regexp_extract(piece, 'package (\d+)', 1) END AS block_id, CASE WHEN i = 1 THEN 'header' ELSE 'package' END AS kind,
    CASE WHEN i > 1 THEN regexp_extract(piece, '^[^\n]*') END AS heading, trim(piece, chr(10)) AS btext, CAST(pos AS INT) AS start, CAST(least(pos + length(rtrim(regexp_replace(piece, '\n$', ' '))) + CASE WHEN piece LIKE '%' || chr(10) THEN 1 ELSE 0 END, length(flat)) AS INT) AS "end"
  FROM (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM cuts) WHERE piece <> ''),
p AS (SELECT *, substring(doc_flat, start + 1, "end" - start) AS flat FROM b WHERE kind = 'package')"""


def _scan_sql(source: str, text: str, keys: str, pattern: str, base: str = "0", before: str = "") -> str:
    """SELECT of keys, quote, start, end of every match, by marking and splitting; before: what must stand before a match, instead of look-behind."""
    form, mark = (f"({before})({pattern})", "'\\1' || chr(1) || '\\2' || chr(2)") if before else (f"({pattern})", "chr(1) || '\\1' || chr(2)")
    return f"""SELECT {keys}, piece AS quote, CAST(base + coalesce(pos, 0) AS INT) AS start, CAST(base + coalesce(pos, 0) + length(piece) AS INT) AS "end", i AS nth FROM (
  SELECT *, sum(length(piece)) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos FROM (
    SELECT {keys}, base, unnest(generate_series(1, len(ps))) AS i, unnest(ps) AS piece FROM (
      SELECT {keys}, {base} AS base, string_split_regex(regexp_replace(translate({text}, chr(1) || chr(2), ''), '{form}', {mark}, 'g'), '[' || chr(1) || chr(2) || ']') AS ps FROM {source}))) WHERE i % 2 = 0"""


# -- normalisation ---------------------------------------------------------------------------------------------------


@query(rf"""
SELECT doc_id, CASE WHEN text IS NULL OR length(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) = 0 THEN 'empty' WHEN strlen(text) > 2000000 THEN 'too_large'
  WHEN length(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) < 40 THEN 'too_short'
  WHEN 1 - len(regexp_extract_all(text, '[\x00-\x08\x0e-\x1b\x7f-\x{{84}}\x{{86}}-\x{{9f}}\p{{Cf}}\p{{Co}}]')) / length(text) < 0.85 THEN 'not_printable' END AS reason FROM documents""")
def text_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.reject_reason(F.col("text")).alias("reason"))


@query(f"SELECT doc_id, sha256({_put(_COLLAPSE, 'text')}) AS collapsed_sha256, length({_put(_COLLAPSE, 'text')}) AS n_chars FROM documents WHERE text IS NOT NULL")
def collapse_text(spark: SparkSession, d: str) -> DataFrame:
    flat = X.collapse(F.col("text"), compose=False)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(flat, 256).alias("collapsed_sha256"), F.char_length(flat).cast("bigint").alias("n_chars"))


@query()
def collapse_text_composed(spark: SparkSession, d: str) -> DataFrame:
    flat = X.collapse(F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", flat.alias("flat"))


@query(f"WITH {_NORM} SELECT doc_id, page_seq, page, line_no, key FROM marked WHERE dropped")
def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = normalize.page_lines(normalize.pages(corpus.plan_docs(spark, d)))
    return normalize.mark_boilerplate(lines).where("dropped").select("doc_id", F.col("page_seq").cast("bigint").alias("page_seq"), "page", F.col("line_no").cast("bigint").alias("line_no"), "key")


@query(f"WITH {_NORM} SELECT n.doc_id, sha256(text) AS text_sha256, flat, sha256(raw) AS content_sha256 FROM n JOIN docs USING (doc_id)")
def normalized_documents(spark: SparkSession, d: str) -> DataFrame:
    return normalize.normalize(corpus.plan_docs(spark, d)).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "flat", "content_sha256")


@query()
def normalized_corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("raw"))
    return normalize.normalize(docs, anchor=DOC_ANCHOR).select("doc_id", "flat", "n_pages", "n_dropped", "content_sha256")


@query(f"WITH {_NORM} SELECT doc_id, page, start FROM starts")
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode("page_starts").alias("p")).select("doc_id", "p.page", "p.start")


_PREMIUM = r"Premium\s+\$\s?\d[\d,]*(?:\.\d+)?\s*(?:monthly|annual|per month)?\s*premium"


@query(f"""WITH {_NORM}, m AS ({_scan_sql("n", "flat", "doc_id", _PREMIUM)})
SELECT m.doc_id, m.start, starts.page FROM m ASOF JOIN starts ON m.doc_id = starts.doc_id AND m.start >= starts.start""")
def page_at_offset(spark: SparkSession, d: str) -> DataFrame:
    found = _docs(spark, d).select("doc_id", "page_starts", F.explode(X.regex_scan(F.col("flat"), _PREMIUM)).alias("m"))
    return found.select("doc_id", "m.start", X.page_at(F.col("page_starts"), F.col("m.start")).alias("page"))


@query(_scan_sql("(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)", "text", "doc_id", "[A-Z][a-z]{7,}").replace(", i AS nth", ""))
def regex_scan_offsets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(X.regex_scan(F.col("text"), "[A-Z][a-z]{7,}")).alias("m")).select("doc_id", "m.*")


@query(rf"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, {_put(_LINES, "text")} AS ls FROM documents WHERE text IS NOT NULL)),
c AS (SELECT doc_id, i, trim(regexp_replace(line, '{_WS}+', ' ', 'g')) AS line FROM l),
k AS (SELECT doc_id, i, line, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY i) > 1 AND regexp_matches(line, '^[a-z(\[]') THEN 0 ELSE 1 END AS fresh FROM c WHERE line <> ''),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM k)
SELECT doc_id, CAST(grp AS BIGINT) AS line_no, string_agg(line, ' ' ORDER BY i) AS line FROM g GROUP BY doc_id, grp""")
def logical_lines(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(X.logical_lines(F.col("text"))).alias("i", "line"))
    return found.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


# -- segmentation ----------------------------------------------------------------------------------------------------


@query(f"WITH {_NORM} SELECT doc_id, block_id, kind, heading, start, \"end\" FROM b")
def segment_packages(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("doc_id", "block_id", "kind", "heading", "start", "end")


@query()
def segment_corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("raw"))
    return segment.blocks(normalize.normalize(docs, anchor=DOC_ANCHOR), heading=DOC_HEADING).select("doc_id", "block_seq", "block_id", "kind", "heading", "start", "end")


_CUES = " OR ".join(f"contains(lower(line), '{c}')" for c in segment.COST_CUES)


@query(rf"""WITH {_NORM}, l AS (SELECT doc_id, block_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, block_id, string_split(btext, chr(10)) AS ls FROM p)),
k AS (SELECT doc_id, block_id, i, trim(line) AS line, CASE WHEN i > 1 AND regexp_matches(line, '^[a-z(\[]') THEN 0 ELSE 1 END AS fresh FROM l WHERE trim(line) <> ''),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, block_id ORDER BY i) AS grp FROM k),
j AS (SELECT doc_id, block_id, grp, string_agg(line, ' ' ORDER BY i) AS line FROM g GROUP BY doc_id, block_id, grp)
SELECT doc_id, block_id, CASE WHEN {_CUES} THEN 'cost' WHEN regexp_matches(line, '^\s*(?:[•*-]\s*)?D\d{{4}}\b') THEN 'benefit' ELSE '?' END AS label, count(*) AS n_lines FROM j GROUP BY ALL""")
def column_classify(spark: SparkSession, d: str) -> DataFrame:
    lines = _blocks(spark, d).where("kind = 'package'").select("doc_id", "block_id", F.explode(X.logical_lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id", "block_id", segment.column_of(F.col("line")).alias("label")).agg(F.count(F.lit(1)).alias("n_lines"))


@query()
def column_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).where("kind = 'package'").select("doc_id", "block_id", F.posexplode(segment.line_columns(F.col("text"))).alias("i", "x")).select("doc_id", "block_id", "i", "x.*")


# -- scanners --------------------------------------------------------------------------------------------------------


def _scan(spark: SparkSession, d: str, kinds: list[int]) -> DataFrame:
    found = scanners.scan_packages(_blocks(spark, d), [scanners.PACKAGE_SCANNERS[k] for k in kinds])
    return found.drop("seq", "scanner", "code", "description", "confidence")


def _scanned(pattern: str, columns: str) -> str:
    return f"WITH {_NORM}, m AS ({_scan_sql('p', 'flat', 'doc_id, block_id', pattern, 'start')}) SELECT doc_id, block_id, quote, start, \"end\", {columns} FROM m"


_NUM = "CAST(replace(regexp_extract(quote, '\\$\\s?(\\d[\\d,]*(?:\\.\\d+)?)', 1), ',', '') AS DOUBLE)"


@query(_scanned(r"(?i:Premium\s+\$\s?\d[\d,]*(?:\.\d{1,2})?\s*(?:monthly|annual|per month)?\s*premium?)", f"{_NUM} AS amount_usd, CASE WHEN contains(lower(quote), 'month') THEN 'monthly' WHEN regexp_matches(lower(quote), 'annual|year') THEN 'annual' END AS cadence"))
def scan_premium(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, [0]).select("doc_id", "block_id", "quote", "start", "end", "amount_usd", F.col("span").alias("cadence"))


@query(_scanned(r"(?i:plan will pay up to\s+\$\s?\d[\d,]*(?:\.\d{1,2})?\s+for\s+.{3,80}?\s+(?:each year|per year|per calendar year))", f"{_NUM} AS amount_usd, CASE WHEN contains(quote, 'calendar year') THEN 'per_calendar_year' ELSE 'per_year' END AS period, regexp_extract(quote, ' for (.{{3,80}}?) (?:each year|per year|per calendar year)', 1) AS applies_to".replace("{{", "{").replace("}}", "}")))
def scan_maximum(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, [1]).select("doc_id", "block_id", "quote", "start", "end", "amount_usd", F.col("span").alias("period"), "applies_to")


@query(_scanned(r"(?i:Coverage is available from\s+.{3,60}?providers only)", "regexp_extract(quote, 'available from (.*)', 1) AS network"))
def scan_network(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, [2]).select("doc_id", "block_id", "quote", "start", "end", F.col("applies_to").alias("network"))


_COPAY, _COINS, _DOLLAR = r"(?i:You pay no copay for\s+[^.]{3,120}\.)", r"(?i:You pay\s+\d{1,3}\s?%\s+(?:as your portion of the covered charges\s+)?for\s+[^.]{3,160}(?:\.|$))", r"(?i:You pay\s+\$\s?\d[\d,]*(?:\.\d{1,2})?\s+(?:copay\s+)?for\s+[^.]{3,160}(?:\.|$))"


@query(f"""WITH {_NORM}, m AS (SELECT *, 'copay' AS kind FROM ({_scan_sql("p", "flat", "doc_id, block_id", _COPAY, "start")}) UNION ALL SELECT *, 'coinsurance' FROM ({_scan_sql("p", "flat", "doc_id, block_id", _COINS, "start")})
  UNION ALL SELECT *, 'copay' FROM ({_scan_sql("p", "flat", "doc_id, block_id", _DOLLAR, "start")}))
SELECT doc_id, block_id, quote, start, "end", kind AS share, CASE WHEN contains(quote, 'no copay') THEN 0.0 WHEN kind = 'copay' THEN {_NUM} END AS amount_usd,
  CASE WHEN kind = 'coinsurance' THEN CAST(regexp_extract(quote, '(\\d+)\\s?%', 1) AS DOUBLE) END AS percent, regexp_replace(regexp_extract(quote, ' for (.*)', 1), '\\.$', '') AS applies_to FROM m""")
def scan_cost_share(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, [4, 5, 6]).select("doc_id", "block_id", "quote", "start", "end", "share", "amount_usd", "percent", "applies_to")


_LIMIT = r"(?i:\b(?:one|two|three|four|five|six|seven|eight|nine|ten|\d{1,3})\s+[A-Za-z][A-Za-z -]{2,40}?\s+(?:each year|per year|per calendar year|each month|per month)\b)"
_LIMITS = f"""lim AS (SELECT *, lower(regexp_extract(quote, '^(\\w+)', 1)) AS c, lower(regexp_extract(quote, '(?i)^\\w+\\s+(.*?)\\s+(?:each year|per year|per calendar year|each month|per month)$', 1)) AS unit FROM ({_scan_sql("p", "flat", "doc_id, block_id", _LIMIT, "start", "^|[^0-9A-Za-z_.,$]")})),
limits AS (SELECT doc_id, block_id, quote, start, "end", coalesce(TRY_CAST(c AS DOUBLE), CAST(list_position(['one','two','three','four','five','six','seven','eight','nine','ten'], c) AS DOUBLE)) AS count, unit,
  CASE WHEN contains(lower(quote), 'calendar year') THEN 'per_calendar_year' WHEN regexp_matches(lower(quote), 'year$') THEN 'per_year' ELSE 'per_month' END AS period FROM lim WHERE NOT contains(unit, 'premium') AND NOT regexp_matches(unit, '^(for|of|and) '))"""


@query(f"WITH {_NORM}, {_LIMITS} SELECT * FROM limits")
def scan_limits(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, [7]).select("doc_id", "block_id", "quote", "start", "end", "count", "unit", F.col("span").alias("period"))


_CODES = r"""codes AS (SELECT doc_id, block_id, regexp_extract(piece, '^(D\d{4}) - (.*)$', 1) AS code, regexp_extract(piece, '^D\d{4} - (.*)$', 1) AS description, i FROM (
  SELECT doc_id, block_id, unnest(generate_series(1, len(ls))) AS i, regexp_replace(unnest(ls), '^• ', '') AS piece FROM (SELECT doc_id, block_id, string_split(replace(btext, chr(10) || 'patient', ' patient'), chr(10)) AS ls FROM p)) WHERE regexp_matches(piece, '^D\d{4} - '))"""


@query(f"WITH {_NORM}, {_CODES} SELECT doc_id, block_id, code, description, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY i) AS nth FROM codes")
def scan_codes(spark: SparkSession, d: str) -> DataFrame:
    found = scanners.scan_packages(_blocks(spark, d), [scanners.PACKAGE_SCANNERS[3]])
    return found.select("doc_id", "block_id", "code", "description", (F.col("seq") + 1).cast("bigint").alias("nth"))


@query(rf"""WITH {_NORM}, h AS (SELECT doc_id, substring(doc_flat, start + 1, "end" - start) AS flat FROM b WHERE kind = 'header'),
t AS (SELECT doc_id, flat, regexp_extract(flat, '\b20\d{{2}}\s+Evidence of Coverage for\s+[^\n]{{3,80}}') AS q, regexp_extract(flat, '[A-Z]{{2,}}-?[A-Z]*\s+\d{{5,}}[A-Z0-9_]*\s+Revised') AS f FROM h)
SELECT doc_id, 'plan_name' AS kind, trim(split_part(regexp_extract(q, 'for (.*)', 1), ' Chapter', 1), ' .') AS value, q AS quote FROM t UNION ALL SELECT doc_id, 'plan_year', left(q, 4), q FROM t
UNION ALL SELECT doc_id, 'document_type', 'evidence_of_coverage', q FROM t UNION ALL SELECT doc_id, 'form_id', replace(f, ' Revised', ''), f FROM t""")
def scan_header(spark: SparkSession, d: str) -> DataFrame:
    return scanners.scan_header(_blocks(spark, d)).select("doc_id", "kind", "value", "quote")


@query(f"WITH {_NORM}, m AS ({_scan_sql('p', 'flat', 'doc_id, block_id', _PREMIUM, 'start')}) SELECT doc_id, block_id, count(*) AS n_premiums, count(DISTINCT quote) > 1 AS ambiguous FROM m GROUP BY ALL")
def candidate_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, [0]).groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("n_premiums"), (F.countDistinct("amount_usd") > 1).alias("ambiguous"))


@query()
def prescan_literals(spark: SparkSession, d: str) -> DataFrame:
    return scanners.prescan_text(scanners.scan_packages(_blocks(spark, d)))


# -- model and merge -------------------------------------------------------------------------------------------------


@query(f"""WITH {_NORM}, q AS (SELECT doc_id, block_id, start, "end", doc_flat, 'You pay 20% for fillings.' AS quote FROM p),
w AS (SELECT *, strpos(substring(doc_flat, start + 1, "end" - start), quote) AS a, strpos(doc_flat, quote) AS g FROM q)
SELECT doc_id, block_id, CAST(CASE WHEN a > 0 THEN start + a - 1 WHEN g > 0 THEN g - 1 END AS INT) AS found_start, a > 0 AS in_window FROM w""")
def quote_in_window(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    rows = segment.blocks(docs).where("kind = 'package'").select("doc_id", "block_id", "start", "end").join(docs.select("doc_id", "flat"), "doc_id")
    at = X.locate(F.col("flat"), F.lit("You pay 20%  for fillings."), F.col("start"), F.col("end"))
    rows = rows.withColumn("at", at)
    return rows.select("doc_id", "block_id", F.col("at.start").alias("found_start"), ((F.col("at.start") >= F.col("start")) & (F.col("at.end") <= F.col("end"))).alias("in_window"))


_SERVICE = r"(?i:\b(?:One|Two|Three|Four|Five|Six|Seven|\d{1,2})\s+[A-Za-z][A-Za-z -]{2,40}?\s+(?:each year|per year|per calendar year|each month|per month)\b)"
#: Services of the offline reading, each with the first limit whose interval overlaps its own.
_SERVICES = f"""{_LIMITS}, found AS (SELECT *, regexp_extract(quote, '(?i)^\\w+\\s+(.*?)\\s+(?:each year|per year|per calendar year|each month|per month)$', 1) AS own,
  coalesce(lead(start) OVER (PARTITION BY doc_id, block_id ORDER BY start), 1000000000) AS nxt FROM ({_scan_sql("p", "flat", "doc_id, block_id", _SERVICE, "start")})),
sv AS (SELECT f.doc_id, f.block_id, f.own, regexp_extract_all(substring(p.doc_flat, f."end" + 1, least(f.nxt, p."end") - f."end"), '\\bD\\d{{4}}\\b') AS codes,
  arg_min(l.count, l.start) AS count, arg_min(l.unit, l.start) AS unit, arg_min(l.period, l.start) AS period
  FROM found f JOIN p ON p.doc_id = f.doc_id AND p.block_id = f.block_id LEFT JOIN limits l ON l.doc_id = f.doc_id AND l.block_id = f.block_id AND l.start < f."end" AND f.start < l."end" GROUP BY f.doc_id, f.block_id, f.own, f.start, f."end", f.nxt, p.doc_flat, p."end")"""


@query(f"""WITH {_NORM}, {_SERVICES}
SELECT doc_id, block_id, block_id || '.svc_' || left(replace(lower(own), ' ', '_'), 40) AS service_id, upper(left(own, 1)) || substring(own, 2) AS name, count AS limit_count, unit AS limit_unit, period AS limit_period, array_to_string(codes, ',') AS codes FROM sv""")
def limit_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    _, _, packages = _merged(spark, d)
    s = packages.select("doc_id", "block_id", F.explode("services").alias("s")).select("doc_id", "block_id", "s.*")
    return s.select("doc_id", "block_id", "service_id", "name", "limit_count", "limit_unit", "limit_period", F.array_join("codes", ",").alias("codes"))


@query(f"WITH {_NORM}, {_CODES} SELECT doc_id, block_id, code, arg_min(description, i) AS description FROM codes GROUP BY ALL")
def declared_codes(spark: SparkSession, d: str) -> DataFrame:
    _, _, packages = _merged(spark, d)
    return packages.select("doc_id", "block_id", F.explode("codes").alias("c")).select("doc_id", "block_id", "c.code", "c.description")


@query(f"""WITH {_NORM}, m AS ({_scan_sql('p', 'flat', 'doc_id, block_id', _PREMIUM, 'start')}), a AS (SELECT doc_id, block_id, count(DISTINCT {_NUM}) AS k, min({_NUM}) AS amount FROM m GROUP BY ALL)
SELECT p.doc_id, p.block_id, CASE WHEN k IS NULL THEN 'not_stated' WHEN k > 1 THEN 'ambiguous' ELSE 'found' END AS premium_status, CASE WHEN k = 1 THEN amount END AS premium, p.start AS span_start, p."end" AS span_end FROM p LEFT JOIN a USING (doc_id, block_id)""")
def merged_packages(spark: SparkSession, d: str) -> DataFrame:
    _, _, packages = _merged(spark, d)
    return packages.select("doc_id", "block_id", F.col("premium.status").alias("premium_status"), F.col("premium.amount_usd").alias("premium"), "span_start", "span_end")


@query()
def cost_share_pairing(spark: SparkSession, d: str) -> DataFrame:
    _, _, packages = _merged(spark, d)
    return packages.select("doc_id", "block_id", F.explode("cost_share").alias("s")).select("doc_id", "block_id", "s.cost_share_id", "s.type", "s.amount_usd", "s.percent", "s.applies_to", F.array_join("s.service_ids", ",").alias("service_ids"), "s.status", "s.source")


@query(f"""WITH {_NORM}, {_SERVICES}, x AS (SELECT *, 'x' AS k FROM ({_scan_sql("p", "flat", "doc_id, block_id", _COPAY, "start")}) UNION ALL SELECT *, 'x' FROM ({_scan_sql("p", "flat", "doc_id, block_id", _COINS, "start")}) UNION ALL SELECT *, 'x' FROM ({_scan_sql("p", "flat", "doc_id, block_id", _DOLLAR, "start")})),
c AS (SELECT doc_id, block_id, lower(regexp_replace(regexp_extract(quote, ' for (.*)', 1), '\\.$', '')) AS scope FROM x),
cat AS (SELECT *, lower(own) AS low, list_filter(string_split_regex(lower(own), '\\W+'), lambda t: t <> '' AND NOT list_contains({merge.STOPWORDS!r}, t)) AS words, regexp_matches(lower(own), 'exam|x-ray|cleaning|prophylaxis|fluoride') AS early FROM sv)
SELECT DISTINCT c.doc_id, c.block_id, scope, c.block_id || '.svc_' || left(replace(low, ' ', '_'), 40) AS service_id FROM c JOIN cat USING (doc_id, block_id)
WHERE contains(scope, low) OR (len(words) > 0 AND len(list_filter(words, lambda t: NOT contains(scope, regexp_replace(t, 's+$', '')))) = 0) OR (contains(scope, 'preventive') AND early)""")
def service_match(spark: SparkSession, d: str) -> DataFrame:
    _, _, packages = _merged(spark, d)
    s = packages.select("doc_id", "block_id", F.explode("cost_share").alias("s"))
    return s.select("doc_id", "block_id", F.lower("s.applies_to").alias("scope"), F.explode("s.service_ids").alias("service_id")).distinct()


@query(f"""WITH {_NORM}, e AS (SELECT doc_id, block_id, unnest(generate_series(1, len(ls))) AS i, trim(unnest(ls)) AS chunk FROM (SELECT doc_id, block_id, string_split(flat, '•')[2:] AS ls FROM p)),
t AS (SELECT doc_id, block_id, i, trim(regexp_extract(chunk, '^(?:[^.;]|[.;][^\\s])*[.;]?')) AS text FROM e)
SELECT doc_id, block_id, text, CASE WHEN contains(lower(text), 'contracted provider') AND contains(lower(text), 'rendered') THEN 'network_restriction' WHEN contains(lower(text), 'claims') THEN 'claims_process' WHEN contains(lower(text), 'out-of-pocket') THEN 'accumulator'
  WHEN starts_with(lower(text), 'you must pay') THEN 'member_liability' WHEN contains(lower(text), 'excluded') THEN 'service_excluded' ELSE 'other' END AS kind FROM t WHERE length(text) >= 25 AND NOT regexp_matches(text, '^D\\d{{4}}\\b')""")
def exclusions(spark: SparkSession, d: str) -> DataFrame:
    _, _, packages = _merged(spark, d)
    return packages.select("doc_id", "block_id", F.explode("exclusions").alias("x")).select("doc_id", "block_id", "x.text", "x.kind")


def _faulty_replies(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, block_id, attempt, reply): replies with a fault in the first attempt of some blocks, in both of others."""
    replies = model.stub_replies(_blocks(spark, d)).select("doc_id", "block_id", F.to_json("reply").alias("reply"))
    fault = F.pmod("doc_id", F.lit(6))
    bad = F.when(fault == 1, F.lit("no JSON here")).when(fault == 2, F.regexp_replace("reply", r"^\{", '{"surprise":1,')).when(fault == 3, F.lit('{"services":[{"name":"x"}],"cost_share":[],"exclusions":[],"truncated":false}')).otherwise(F.col("reply"))
    first = replies.select("doc_id", "block_id", F.lit(1).alias("attempt"), bad.alias("reply"))
    second = replies.where(fault.between(1, 2)).select("doc_id", "block_id", F.lit(2).alias("attempt"), "reply")
    return first.unionByName(second)


@query(f"""WITH {_NORM} SELECT doc_id, block_id, doc_id % 6 = 3 AS degraded, CAST(CASE WHEN doc_id % 6 IN (1, 2) THEN 2 ELSE 1 END AS BIGINT) AS n_calls FROM p""")
def reply_contract(spark: SparkSession, d: str) -> DataFrame:
    return model.settle(_blocks(spark, d), model.parse_replies(_faulty_replies(spark, d))).select("doc_id", "block_id", "degraded", "n_calls")


@query(f"""WITH {_NORM} SELECT doc_id, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(n - 1) AS BIGINT) AS repairs, coalesce(string_agg(block_id, ',' ORDER BY block_id) FILTER (doc_id % 6 = 3), '') AS blocks_degraded
FROM (SELECT doc_id, block_id, CASE WHEN doc_id % 6 IN (1, 2) THEN 2 ELSE 1 END AS n FROM p) GROUP BY doc_id""")
def call_totals(spark: SparkSession, d: str) -> DataFrame:
    settled = model.settle(_blocks(spark, d), model.parse_replies(_faulty_replies(spark, d)))
    return model.totals(settled).select("doc_id", "calls", "repairs", F.array_join("blocks_degraded", ",").alias("blocks_degraded"))


@query()
def model_prompts(spark: SparkSession, d: str) -> DataFrame:
    blocks = _blocks(spark, d)
    return model.prompt(blocks, scanners.prescan_text(scanners.scan_packages(blocks)))


# -- validation ------------------------------------------------------------------------------------------------------


def _tampered(packages: DataFrame) -> DataFrame:
    """The packages with a strange quote, a wrong amount and an unknown code in some documents."""
    k = F.pmod("doc_id", F.lit(13))
    premium = F.col("premium").withField("evidence", F.when(k == 1, F.col("premium.evidence").withField("quote", F.lit("Premium $1.00 made up"))).otherwise(F.col("premium.evidence"))).withField("amount_usd", F.when(k == 2, F.col("premium.amount_usd") * 10).otherwise(F.col("premium.amount_usd")))
    services = F.transform("services", lambda s: s.withField("codes", F.when(k == 3, F.concat(s["codes"], F.array(F.lit("D0000X")))).otherwise(s["codes"])))
    return packages.withColumns({"premium": premium, "services": services})


@query()
def validation_flags(spark: SparkSession, d: str) -> DataFrame:
    docs, blocks, packages = _merged(spark, d)
    flags, _ = rules.validate(docs, _tampered(packages), merge.document_info(docs, scanners.scan_header(blocks)))
    return flags


@query()
def validation_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs, blocks, packages = _merged(spark, d)
    return rules.validate(docs, _tampered(packages), merge.document_info(docs, scanners.scan_header(blocks)))[1]


@query(f"""WITH {_NORM}, {_LIMITS}, n_lim AS (SELECT doc_id, block_id, block_seq, count(l.quote) AS k FROM p LEFT JOIN limits l USING (doc_id, block_id) GROUP BY ALL)
SELECT doc_id, 'references.unknown_code' AS rule, '/packages/' || CAST(block_seq - 1 AS VARCHAR) || '/services/' || CAST(j AS VARCHAR) AS path FROM (SELECT *, unnest(generate_series(0, k - 1)) AS j FROM n_lim WHERE doc_id % 13 = 3 AND k > 0)""")
def unknown_codes(spark: SparkSession, d: str) -> DataFrame:
    _, _, packages = _merged(spark, d)
    return rules.references(_tampered(packages)).where("rule = 'references.unknown_code'").select("doc_id", "rule", "path")


@query(f"""WITH {_NORM}, m AS ({_scan_sql('p', 'flat', 'doc_id, block_id', _PREMIUM, 'start')}), a AS (SELECT doc_id, block_id, count(DISTINCT quote) AS k FROM m GROUP BY ALL)
SELECT doc_id, 'numeric.not_in_evidence' AS rule, '/packages/' || CAST(block_seq - 1 AS VARCHAR) || '/premium' AS path FROM p JOIN a USING (doc_id, block_id) WHERE k = 1 AND doc_id % 13 = 2""")
def numeric_fidelity(spark: SparkSession, d: str) -> DataFrame:
    docs, _, packages = _merged(spark, d)
    return rules.numeric(rules.ground(rules.evidence_nodes(_tampered(packages)), docs)).select("doc_id", "rule", "path")


@query(f"""WITH {_NORM}, m AS ({_scan_sql('p', 'flat', 'doc_id, block_id', _PREMIUM, 'start')})
SELECT doc_id, 'invariants.premium_missing' AS rule, '/packages/' || CAST(block_seq - 1 AS VARCHAR) || '/premium' AS path FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = p.doc_id AND m.block_id = p.block_id)
UNION ALL SELECT doc_id, 'invariants.exclusions_not_stated', '/packages/' || CAST(block_seq - 1 AS VARCHAR) || '/exclusions' FROM p WHERE NOT contains(flat, '• Services must')
UNION ALL SELECT doc_id, 'invariants.conflicting_cost_share', '/packages/' || CAST(block_seq - 1 AS VARCHAR) FROM p WHERE contains(flat, 'no copay for the preventive') AND contains(flat, 'You pay 10% for cleanings.')""")
def invariant_flags(spark: SparkSession, d: str) -> DataFrame:
    _, _, packages = _merged(spark, d)
    return rules.invariants(packages).select("doc_id", "rule", "path")


@query(f"""WITH {_NORM} SELECT doc_id, 'code.bad_shape' AS rule, '/packages/' || CAST(block_seq - 1 AS VARCHAR) || '/codes' AS path FROM p WHERE doc_id % 13 = 4""")
def code_shape_flags(spark: SparkSession, d: str) -> DataFrame:
    _, _, packages = _merged(spark, d)
    strange = F.transform("codes", lambda c, i: c.withField("code", F.when((F.pmod("doc_id", F.lit(13)) == 4) & (i == 0), F.lit("X12")).otherwise(c["code"])))
    return rules.code_shapes(packages.withColumn("codes", strange)).select("doc_id", "rule", "path")


_INVARIANT_ERRORS = f"""e AS (SELECT DISTINCT doc_id FROM p WHERE NOT EXISTS (SELECT 1 FROM ({_scan_sql('p', 'flat', 'doc_id, block_id', _PREMIUM, 'start')}) m WHERE m.doc_id = p.doc_id AND m.block_id = p.block_id)
  OR (contains(flat, 'no copay for the preventive') AND contains(flat, 'You pay 10% for cleanings.')))"""


@query(f"""WITH {_NORM}, {_INVARIANT_ERRORS} SELECT d.doc_id, 'text' AS kind, CASE WHEN d.doc_id % 17 = 0 THEN 'failed' WHEN e.doc_id IS NOT NULL THEN 'partial' ELSE 'succeeded' END AS status,
CASE WHEN d.doc_id % 17 = 0 THEN 'input_rejected' END AS error_code, CASE WHEN d.doc_id % 17 = 0 THEN 'too_short' END AS error_message, CASE WHEN d.doc_id % 17 = 0 THEN 422 END AS http_status,
CASE WHEN d.doc_id % 17 <> 0 THEN true END AS needs_review, CASE WHEN d.doc_id % 17 = 0 THEN 0 ELSE 2 END AS n_packages, 'unsupported_projection' AS csv_refusal FROM docs d LEFT JOIN e USING (doc_id)""")
def job_status(spark: SparkSession, d: str) -> DataFrame:
    """States of the synthesised documents, of which every seventeenth is cut to a few characters and refused."""
    done = _extraction(spark, d)
    metrics = _once(spark, d, "metrics", lambda: durable(done.validate()[1]))
    usable = F.pmod("doc_id", F.lit(17)) != 0
    sent = corpus.plan_docs(spark, d).withColumn("raw", F.when(usable, F.col("raw")).otherwise(F.left("raw", F.lit(20))))
    found = jobs.projection(jobs.text_jobs(sent, done.packages.where(usable), metrics.where(usable), X.reject_reason(F.col("raw"))), "csv")
    return found.select("doc_id", "kind", "status", F.col("error.code").alias("error_code"), F.col("error.message").alias("error_message"), F.col("error.http_status").alias("http_status"), "needs_review", "n_packages", F.col("refusal.code").alias("csv_refusal"))


# -- guide path: grids -----------------------------------------------------------------------------------------------

_TOKENS = "[" + ", ".join(f"'{t}'" for t in readers.HEADER_TOKENS) + "]"
_CODE_OF = r"list_filter(string_split_regex(trim({0}), '[\s,;/]+'), lambda t: regexp_full_match(t, '[A-Z]\d{4}[A-Z]?'))[1]"
_GRID = rf"""
g AS (SELECT doc_id, page, table_seq, row_seq, list_transform(cells, lambda c: trim(coalesce(c, ''))) AS cells FROM guide_cells WHERE cells IS NOT NULL),
f AS (SELECT *, list_filter(list_transform(cells, lambda c: {_put(_CODE_OF, "c")}), lambda c: c IS NOT NULL)[1] AS code, len(list_filter(list_distinct(string_split_regex(lower(array_to_string(cells, ' ')), '[^a-z0-9_]+')), lambda t: list_contains({_TOKENS}, t))) AS hits FROM g),
k AS (SELECT *, CASE WHEN len(list_filter(cells, lambda c: c <> '')) = 0 THEN 'blank' WHEN code IS NULL AND hits >= 2 THEN 'header' WHEN cells[1] <> '' AND len(list_filter(cells[2:], lambda c: c <> '')) = 0 THEN 'heading' WHEN code IS NOT NULL THEN 'data' ELSE 'other' END AS kind FROM f),
w AS (SELECT *, last_value(CASE WHEN kind = 'header' THEN cells END IGNORE NULLS) OVER o AS labels, last_value(CASE WHEN kind = 'heading' THEN cells[1] END IGNORE NULLS) OVER o AS grp FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY page, table_seq, row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY table_seq, row_seq) - 1 AS row_seq, grp, labels, cells, code FROM w WHERE kind = 'data')"""


def _grid_rows(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_grids(table(spark, d, "guide_cells"), code_anywhere=True)


@query(f"WITH {_GRID} SELECT doc_id, page, row_seq, grp, array_to_string(labels, '|') AS labels, array_to_string(cells, '|') AS cells FROM r")
def grid_rows(spark: SparkSession, d: str) -> DataFrame:
    return _grid_rows(spark, d).select("doc_id", "page", F.col("row_seq").cast("bigint").alias("row_seq"), "grp", F.array_join("labels", "|").alias("labels"), F.array_join("cells", "|").alias("cells"))


@query(f"WITH {_GRID.replace(chr(39) + 'heading' + chr(39) + ' WHEN code IS NOT NULL THEN', chr(39) + 'heading' + chr(39) + ' WHEN ' + _put(_CODE_OF, 'cells[1]') + ' IS NOT NULL THEN')} SELECT doc_id, page, row_seq, array_to_string(cells, '|') AS cells FROM r")
def ruled_rows(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_grids(table(spark, d, "guide_cells")).select("doc_id", "page", F.col("row_seq").cast("bigint").alias("row_seq"), F.array_join("cells", "|").alias("cells"))


@query(f"WITH {_GRID} SELECT doc_id, page, count(*) AS n_rows, avg(CASE WHEN len(list_filter(cells[2:], lambda c: length(trim(c)) > 3)) > 0 THEN 1 ELSE 0 END) AS score FROM r GROUP BY ALL")
def reader_scores(spark: SparkSession, d: str) -> DataFrame:
    return readers.reader_scores(_grid_rows(spark, d)).select("doc_id", "page", "n_rows", "score")


_ANY_SCORES = f"(WITH {_GRID} SELECT doc_id, page, avg(CASE WHEN len(list_filter(cells[2:], lambda c: length(trim(c)) > 3)) > 0 THEN 1 ELSE 0 END) AS score FROM r GROUP BY ALL)"
_RULED_SCORES = _ANY_SCORES.replace("'heading' WHEN code IS NOT NULL THEN", "'heading' WHEN " + _put(_CODE_OF, "cells[1]") + " IS NOT NULL THEN")
_CHOICE = f"""SELECT doc_id, page, CASE WHEN coalesce(a.score, 0) >= 0.8 THEN 'ruled' WHEN coalesce(b.score, 0) >= 0.8 THEN 'grid' WHEN coalesce(a.score, 0) >= coalesce(b.score, 0) THEN 'ruled' ELSE 'grid' END AS strategy, a.score AS ruled, b.score AS grid
FROM {_RULED_SCORES} a FULL JOIN {_ANY_SCORES} b USING (doc_id, page) WHERE greatest(coalesce(a.score, 0), coalesce(b.score, 0)) > 0"""


@query(f"SELECT doc_id, page, strategy, CASE strategy WHEN 'ruled' THEN ruled ELSE grid END AS score FROM ({_CHOICE})")
def reader_choice(spark: SparkSession, d: str) -> DataFrame:
    grids = table(spark, d, "guide_cells")
    return readers.best_reading([readers.read_grids(grids), readers.read_grids(grids, "grid", code_anywhere=True)])


_PHRASES = ", ".join(f"('{p}', {len(p)}, {k}, '{role}')" for k, (role, phrases) in enumerate(mapping.ROLE_PHRASES) for p in phrases)
_LABELS = f"""lab AS (SELECT DISTINCT label, trim(regexp_replace(translate(regexp_replace(lower(label), '[^a-z0-9/ -]', ' ', 'g'), '/-', '  '), '\\s+', ' ', 'g')) AS norm FROM (SELECT unnest(columns_detected) AS label FROM extraction_report)),
phr AS (SELECT * FROM (VALUES {_PHRASES}) AS v(phrase, n, k, role)),
hit AS (SELECT label, arg_max(role, n * 100 - k) AS role FROM lab JOIN phr ON contains(norm, phrase) GROUP BY label),
roles AS (SELECT label, coalesce(role, CASE WHEN {" OR ".join(f"contains(norm, '{h}')" for h in mapping.COVERAGE_HINTS)} THEN 'in_network' END) AS role FROM lab LEFT JOIN hit USING (label))"""


@query(f"WITH {_LABELS} SELECT * FROM roles")
def label_roles(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "extraction_report").select(F.explode("columns_detected").alias("label")).distinct()
    return labels.select("label", mapping.label_role(F.col("label")).alias("role"))


@query(f"""WITH {_LABELS}, c AS (SELECT report_id, unnest(generate_series(0, len(columns_detected) - 1)) AS idx, unnest(columns_detected) AS label FROM extraction_report)
SELECT report_id, role, CAST(min(idx) AS INT) AS idx FROM c JOIN roles USING (label) WHERE role IS NOT NULL GROUP BY ALL""")
def label_mapping(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extraction_report").select("report_id", F.explode(mapping.label_roles(F.col("columns_detected"))).alias("role", "idx"))


@query(f"WITH {_LABELS} SELECT report_id, label FROM (SELECT report_id, unnest(columns_detected) AS label FROM extraction_report) JOIN roles USING (label) WHERE role IS NULL AND trim(label) <> ''")
def unmapped_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extraction_report").select("report_id", F.explode(mapping.unmapped_labels(F.col("columns_detected"))).alias("label"))


_OUTCOMES = f"""
c AS (SELECT doc_id, page, strategy FROM ({_CHOICE}) WHERE (doc_id + page) % 4 <> 0),
p AS (SELECT DISTINCT doc_id, page, doc_id % 2 = 0 AS has_codes, doc_id % 5 <> 0 AS has_text FROM guide_cells),
f AS (SELECT DISTINCT doc_id, page FROM {_ANY_SCORES} WHERE doc_id % 3 = 0),
t AS (SELECT p.*, c.strategy, f.doc_id IS NOT NULL AS got FROM p LEFT JOIN c USING (doc_id, page) LEFT JOIN f USING (doc_id, page)),
s AS (SELECT t.*, mode, mode = 'always' OR (strategy IS NULL AND (has_codes OR NOT has_text)) AS sent FROM t, (VALUES ('auto'), ('always')) AS m(mode)),
n AS (SELECT *, sum(CASE WHEN sent THEN 1 ELSE 0 END) OVER (PARTITION BY mode, doc_id ORDER BY page) AS nth FROM s)
"""


@query(f"""WITH {_OUTCOMES} SELECT mode, doc_id, page, CASE WHEN sent AND nth <= 1 AND got THEN 'fallback' WHEN strategy IS NOT NULL THEN 'read' WHEN sent AND nth > 1 THEN 'over_budget' WHEN has_text THEN 'none' ELSE 'unreadable' END AS outcome,
CASE WHEN sent AND nth <= 1 AND got THEN 'costly' ELSE strategy END AS strategy FROM n""")
def page_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Both modes of the costly reader over pages of which some are lost to the other readers, with a budget of one page."""
    grids = table(spark, d, "guide_cells")
    lost = F.pmod(F.col("doc_id") + F.col("page"), F.lit(4)) != 0
    readings = [readers.read_grids(grids).where(lost), readers.read_grids(grids, "grid", code_anywhere=True).where(lost)]
    pages = grids.select("doc_id", "page").distinct().select("*", (F.col("doc_id") % 2 == 0).alias("has_codes"), (F.col("doc_id") % 5 != 0).alias("has_text"))
    costly = readers.read_grids(grids, "costly", code_anywhere=True).where("doc_id % 3 = 0")
    both = [readers.page_outcomes(readings, pages, costly, mode, budget=1).select(F.lit(mode).alias("mode"), "*") for mode in ("auto", "always")]
    return both[0].unionByName(both[1])


_OFTEN = " OR ".join(f"contains(lower(cell), '{w}')" for w in mapping.FREQUENCY_WORDS)
_ROLE_STATS = rf"""
c AS (SELECT doc_id, page, segment, unnest(generate_series(0, len(cells) - 1)) AS idx, unnest(cells) AS cell FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page, segment ORDER BY row_seq) AS nth FROM g2) WHERE nth <= 40),
st AS (SELECT doc_id, page, segment, idx, coalesce(count(*) FILTER (trim(cell) <> '' AND regexp_matches(regexp_extract(trim(cell), '^\S+'), '^[A-Z]\d{{4}}[A-Z]?$')) / nullif(count(*) FILTER (trim(cell) <> ''), 0), 0) AS code,
  coalesce(count(*) FILTER (trim(cell) <> '' AND (regexp_matches(trim(cell), '(?i)^\$?\s?\d[\d,]*(?:\.\d{{1,2}})?\s?%?(?:\s*(?:copay|coinsurance))?$') OR lower(trim(cell)) IN ('not covered', 'no charge', 'covered in full', 'n/a'))) / nullif(count(*) FILTER (trim(cell) <> ''), 0), 0) AS money,
  coalesce(count(*) FILTER (trim(cell) <> '' AND ({_OFTEN})) / nullif(count(*) FILTER (trim(cell) <> ''), 0), 0) AS freq, avg(length(cell)) AS length FROM c GROUP BY ALL),
r1 AS (SELECT doc_id, page, segment, 'code' AS role, max(idx) AS idx FROM (SELECT *, max(code) OVER (PARTITION BY doc_id, page, segment) AS top FROM st) WHERE code = top AND top >= 0.6 GROUP BY ALL),
r2 AS (SELECT * FROM r1 UNION ALL SELECT doc_id, page, segment, CASE nth WHEN 1 THEN 'in_network' ELSE 'out_network' END, idx FROM (
  SELECT doc_id, page, segment, idx, row_number() OVER (PARTITION BY doc_id, page, segment ORDER BY idx) AS nth FROM st WHERE money >= 0.6 AND NOT EXISTS (SELECT 1 FROM r1 WHERE r1.doc_id = st.doc_id AND r1.page = st.page AND r1.segment = st.segment AND r1.idx = st.idx)) WHERE nth <= 2),
r3 AS (SELECT * FROM r2 UNION ALL SELECT doc_id, page, segment, 'frequency', max(idx) FROM (
  SELECT *, max(freq) OVER (PARTITION BY doc_id, page, segment) AS top FROM st WHERE NOT EXISTS (SELECT 1 FROM r2 WHERE r2.doc_id = st.doc_id AND r2.page = st.page AND r2.segment = st.segment AND r2.idx = st.idx)) WHERE freq = top AND top >= 0.4 GROUP BY ALL),
r4 AS (SELECT * FROM r3 UNION ALL SELECT doc_id, page, segment, 'description', max(idx) FROM (
  SELECT *, max(length) OVER (PARTITION BY doc_id, page, segment) AS top FROM st WHERE NOT EXISTS (SELECT 1 FROM r3 WHERE r3.doc_id = st.doc_id AND r3.page = st.page AND r3.segment = st.segment AND r3.idx = st.idx)) WHERE length = top AND top >= 8 GROUP BY ALL)"""


@query(f"""WITH {_GRID}, sg AS (SELECT *, CAST(sum(CASE WHEN kind = 'header' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY table_seq, row_seq) AS INT) AS segment FROM w),
g2 AS (SELECT doc_id, page, segment, table_seq * 1000000 + row_seq AS row_seq, cells FROM sg WHERE kind = 'data'), {_ROLE_STATS} SELECT doc_id, page, segment, role, CAST(idx AS INT) AS idx FROM r4""")
def role_inference(spark: SparkSession, d: str) -> DataFrame:
    rows = _grid_rows(spark, d).withColumn("labels", F.lit(None).cast("array<string>"))
    return mapping.table_roles(rows, guide.TABLE, ["row_seq"]).select("doc_id", "page", "segment", F.explode("roles").alias("role", "idx"))


@query()
def guide_rows(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.read_guides(_grid_rows(spark, d)).rows


@query()
def guide_summaries(spark: SparkSession, d: str) -> DataFrame:
    found = pipeline.read_guides(_grid_rows(spark, d)).summaries
    return found.select("doc_id", "n_rows", "pages_with_rows", F.array_join("mapped", ",").alias("mapped"), F.array_join("unmapped", "|").alias("unmapped"), "filled_share")


_NAMED = """
f AS (SELECT guide_id, dental_code, arg_min(coalesce(description, '-'), (coalesce(page, -1), row_id)) AS description, arg_min(coalesce(benefit_group, '-'), (coalesce(page, -1), row_id)) AS grp, min((coalesce(page, -1), row_id)) AS place FROM benefit_rows WHERE row_id % 3 <> 0 AND dental_code IS NOT NULL GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY guide_id ORDER BY place, dental_code) - 1 AS nth FROM f)"""


@query(f"""WITH {_NAMED} SELECT guide_id AS doc_id, CAST(nth // 4 AS INT) AS batch, string_agg(dental_code, ',' ORDER BY nth) AS codes, sha256(string_agg(dental_code || ' | ' || description || ' | section heading: ' || grp, chr(10) ORDER BY nth)) AS lines_sha256 FROM n GROUP BY ALL""")
def group_batches(spark: SparkSession, d: str) -> DataFrame:
    found = guide.group_batches(_named_rows(spark, d), size=4)
    return found.select("doc_id", "batch", F.array_join("codes", ",").alias("codes"), F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha256"))


@query(f"""WITH {_NAMED}, b AS (SELECT guide_id, dental_code, nth // 4 AS batch FROM n), s AS (SELECT guide_id, min(batch) AS stop FROM b WHERE (guide_id + batch) % 5 = 3 GROUP BY guide_id)
SELECT b.guide_id AS doc_id, dental_code, trim(regexp_replace('Group of ' || dental_code, '\\s+', ' ', 'g')) AS name, s.stop IS NOT NULL AS degraded FROM b LEFT JOIN s USING (guide_id) WHERE s.stop IS NULL OR batch < s.stop""")
def batch_names(spark: SparkSession, d: str) -> DataFrame:
    """Names out of replies of which some are no JSON: such a batch, and the document's later ones, name nothing."""
    batches = guide.group_batches(_named_rows(spark, d), size=4)
    reply = F.to_json(F.struct(F.transform("codes", lambda c: F.struct(c.alias("code"), F.concat(F.lit("Group  of "), c).alias("benefit_group"))).alias("groups")))
    replies = batches.select("doc_id", "batch", F.when(F.pmod(F.col("doc_id") + F.col("batch"), F.lit(5)) != 3, reply).otherwise("sorry").alias("reply"))
    names, degraded = guide.batch_names(batches, replies)
    return names.join(degraded.select("doc_id", F.lit(True).alias("degraded")), "doc_id", "left").fillna(False, ["degraded"])


def _named_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benefit_rows").where("dental_code IS NOT NULL")
    source = F.when(F.col("row_id") % 3 == 0, "column").otherwise("heading")
    return rows.select(F.col("guide_id").alias("doc_id"), "page", F.lit(0).alias("segment"), F.col("row_id").alias("row_seq"), "dental_code", "description", "benefit_group", source.alias("group_source"))


def _csv_cell(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, '[",\r\n]') THEN '"' || replace({c}, '"', '""') || '"' ELSE coalesce({c}, '') END"""


@query(f"""SELECT guide_id, sha256('dental_code,description,frequency' || chr(13) || chr(10) || string_agg({_csv_cell("dental_code")} || ',' || {_csv_cell("description")} || ',' || {_csv_cell("frequency")} || chr(13) || chr(10), '' ORDER BY page NULLS FIRST, row_id)) AS csv_sha256, count(*) AS n_lines FROM benefit_rows GROUP BY guide_id""")
def guide_csv_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benefit_rows")
    texts = files.csv_text(rows, ["guide_id"], ["dental_code", "description", "frequency"], ["page", "row_id"])
    return texts.select("guide_id", F.sha2("csv", 256).alias("csv_sha256")).join(rows.groupBy("guide_id").agg(F.count(F.lit(1)).alias("n_lines")), "guide_id")


@query()
def guide_reports(spark: SparkSession, d: str) -> DataFrame:
    """Run reports of the guides of guide_cells."""
    found = pipeline.read_guides(_grid_rows(spark, d))
    known = table(spark, d, "extraction_report").groupBy(F.col("guide_id").alias("doc_id")).agg(F.max("file_name").alias("file"), F.max("n_pages").alias("pages"), F.max("csv_path").alias("csv"))
    return files.run_report(found.summaries, found.flags, known.withColumn("error", F.when(F.col("doc_id") % 11 == 0, "not_pdf"))).drop("strategies")


@query()
def guide_checks(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.read_guides(_grid_rows(spark, d)).flags


_KEY = "guide_id, dental_code, description, frequency, in_network, out_network"


@query(f"SELECT {_KEY}, row_id FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY page, row_id) AS nth FROM benefit_rows) WHERE nth = 1")
def benefit_rows_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benefit_rows").select(F.col("guide_id").alias("doc_id"), "page", "strategy", F.lit(0).alias("segment"), F.col("row_id").alias("row_seq"), "dental_code", *guide.FIELDS)
    return guide.deduplicate(rows).select(F.col("doc_id").alias("guide_id"), "dental_code", *guide.FIELDS, F.col("row_seq").alias("row_id"))


_GROUPS = "CASE " + " ".join(f"WHEN contains(lower(coalesce(description, '')), '{k}') THEN '{v}'" for k, v in model.GROUP_RULES) + " ELSE coalesce(nullif(trim(benefit_group), ''), '-') END"


@query(f"SELECT row_id, {_GROUPS} AS named_group FROM benefit_rows")
def group_naming(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benefit_rows").select("row_id", model.group_name(F.col("description"), F.col("benefit_group")).alias("named_group"))


_TIDY = r"trim(regexp_replace(benefit_group, '\s+', ' ', 'g'), ' .;')"


@query(rf"SELECT row_id, nullif(CASE WHEN length({_TIDY}) > 40 AND contains({_TIDY}, '(') THEN trim(split_part({_TIDY}, '(', 1), ' -–,') ELSE {_TIDY} END, '') AS tidy FROM benefit_rows")
def tidy_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benefit_rows").select("row_id", guide.tidy_group(F.col("benefit_group")).alias("tidy"))


def _cell_sql(c: str) -> str:
    return f"coalesce(nullif(trim(trim(regexp_replace({c}, '{_WS}+', ' ', 'g')), ' .;|'), ''), '-')"


@query("SELECT " + ", ".join(f'{_cell_sql(c)} AS "{n}"' for c, n in zip(("benefit_group", "dental_code", *guide.FIELDS), guide.CSV_COLUMNS)) + " FROM benefit_rows")
def guide_csv(spark: SparkSession, d: str) -> DataFrame:
    return guide.csv_table(table(spark, d, "benefit_rows"))


@query("""SELECT carrier_id, strategy, count(*) AS n_rows, count(DISTINCT guide_id) AS n_guides, avg((CASE WHEN benefit_group IS NULL THEN 0 ELSE 1 END + CASE WHEN description IS NULL THEN 0 ELSE 1 END + CASE WHEN frequency IS NULL THEN 0 ELSE 1 END
  + CASE WHEN in_network IS NULL THEN 0 ELSE 1 END + CASE WHEN out_network IS NULL THEN 0 ELSE 1 END) / 5.0) AS filled FROM benefit_rows GROUP BY carrier_id, strategy""")
def rows_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("benefit_group", *guide.FIELDS)), F.lit(0)) / 5
    return table(spark, d, "benefit_rows").groupBy("carrier_id", "strategy").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("guide_id").alias("n_guides"), F.avg(filled).alias("filled"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, regexp_replace(unnest(ls), '^{_WS}+|{_WS}+$', '', 'g') AS line FROM (SELECT doc_id, {_put(_LINES, "text")} AS ls FROM documents WHERE text IS NOT NULL)),
m AS (SELECT *, len(regexp_extract_all(line, '\|')) >= 2 AS piped FROM l WHERE line <> '' AND NOT regexp_matches(line, '{readers.ALIGNMENT}')),
c AS (SELECT *, CASE WHEN piped THEN list_transform(string_split(regexp_replace(line, '^\|+|\|+$', '', 'g'), '|'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) END AS cells FROM m),
k AS (SELECT *, list_filter(list_transform(cells, lambda x: {_put(_CODE_OF, "x")}), lambda x: x IS NOT NULL)[1] AS code FROM c)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS row_seq, code, array_to_string(cells, '|') AS cells FROM k WHERE code IS NOT NULL""")
def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.read_markdown(table(spark, d, "documents").where("text IS NOT NULL"))
    return rows.select("doc_id", F.col("row_seq").cast("bigint").alias("row_seq"), readers.row_code(F.col("cells")).alias("code"), F.array_join("cells", "|").alias("cells"))


@query()
def markdown_guide(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return pipeline.read_guides(readers.read_markdown(docs)).rows.select("doc_id", "dental_code", *guide.FIELDS, "benefit_group", "group_source")


@query()
def cell_verification(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = readers.read_markdown(docs)
    texts = docs.select("doc_id", F.lit(0).alias("page"), "text")
    return readers.verify_cells(rows, texts).select("doc_id", "row_seq", F.array_join("cells", "|").alias("cells"))


# -- guide path: geometry --------------------------------------------------------------------------------------------

_WORDS = f"words AS ({corpus.GUIDE_WORDS})"


def _sizes(words: DataFrame) -> DataFrame:
    return words.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))


def _frame(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    words = corpus.guide_words(spark, d)
    lines = durable(geometry.lines(words))
    frames = durable(geometry.page_frames(lines, _sizes(words)))
    body = durable(geometry.body_lines(lines, frames))
    return words, lines, frames, body, durable(geometry.bands(lines, body, frames))


@query(f"WITH {_WORDS} SELECT doc_id, page, CAST(round_even(top / 3, 0) AS INT) AS line, string_agg(text, ' ' ORDER BY x0, seq) AS line_text FROM words GROUP BY ALL")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return geometry.lines(corpus.guide_words(spark, d)).select("doc_id", "page", "line", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("line_text"))


_BANDS = """iv AS (SELECT doc_id, page, floor(x0) AS a, floor(x1) + 1 AS b FROM words WHERE top >= 83 AND NOT (text = 'Section') OR top = 72),
reach AS (SELECT doc_id, page, a, max(b) OVER (PARTITION BY doc_id, page ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM iv),
cuts AS (SELECT DISTINCT doc_id, page, (m + a) / 2 AS cut FROM reach WHERE a - m >= 5),
edges AS (SELECT doc_id, page, cut AS lo FROM cuts UNION ALL SELECT DISTINCT doc_id, page, 0.0 FROM words),
bands AS (SELECT doc_id, page, CAST(row_number() OVER o - 1 AS INT) AS band, lo, coalesce(lead(lo) OVER o, 600.0) AS hi FROM edges WINDOW o AS (PARTITION BY doc_id, page ORDER BY lo))"""


@query(f"WITH {_WORDS}, {_BANDS} SELECT * FROM bands")
def whitespace_columns(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, d)[4]


@query(f"WITH {_WORDS}, {_BANDS} SELECT w.doc_id, w.page, w.seq, b.band FROM words w JOIN bands b ON w.doc_id = b.doc_id AND w.page = b.page AND (w.x0 + w.x1) / 2 >= b.lo AND (w.x0 + w.x1) / 2 < b.hi")
def word_bands(spark: SparkSession, d: str) -> DataFrame:
    words, _, _, _, bands = _frame(spark, d)
    return geometry.words_in_bands(words, bands).select("doc_id", "page", "seq", "band")


@query(f"""WITH {_WORDS}, l AS (SELECT doc_id, page, CAST(round_even(top / 3, 0) AS INT) AS line, min(top) AS top, bool_or(regexp_full_match(text, '[A-Z]\\d{{4}}[A-Z]?')) AS has_code, bool_or(text = 'Section') AS heading FROM words WHERE top >= 83 GROUP BY ALL)
SELECT a.doc_id, a.page, a.line, arg_min(c.line, abs(c.top - a.top) * 10000 + c.top) AS anchor FROM l a JOIN l c ON a.doc_id = c.doc_id AND a.page = c.page AND c.has_code
WHERE NOT a.heading AND NOT EXISTS (SELECT 1 FROM l h WHERE h.doc_id = a.doc_id AND h.page = a.page AND h.heading AND h.top > least(a.top, c.top) AND h.top < greatest(a.top, c.top)) GROUP BY ALL""")
def nearest_code_line(spark: SparkSession, d: str) -> DataFrame:
    return geometry.nearest_code_line(_frame(spark, d)[3])


@query(f"""WITH r AS (SELECT c_custkey AS doc_id FROM customer)
SELECT doc_id, 1 AS page, CAST(k AS INT) AS row_seq, 'Section' AS grp, 'D' || lpad(CAST((doc_id * 3 + k) % 10000 AS VARCHAR), 4, '0') || '|' || CASE WHEN doc_id % 2 = 0 THEN 'service number' || CAST(k AS VARCHAR) || ' wrapped' ELSE 'wrapped service number' || CAST(k AS VARCHAR) END
  || '|' || CAST(1 + doc_id % 4 AS VARCHAR) || ' yearly|' || CAST(10 * (doc_id % 11) AS VARCHAR) || '%' AS cells FROM r CROSS JOIN (VALUES (0), (1), (2)) AS v(k)""")
def geometric_rows(spark: SparkSession, d: str) -> DataFrame:
    words = corpus.guide_words(spark, d)
    return geometry.read_words(words, _sizes(words)).select("doc_id", "page", "row_seq", "grp", F.array_join("cells", "|").alias("cells"))


@query("""SELECT c_custkey AS doc_id, CAST(k AS INT) AS row_seq, CASE WHEN k < 2 THEN CAST(1 + c_custkey % 4 AS VARCHAR) || ' yearly ' || CAST(1 + c_custkey % 4 AS VARCHAR) || ' yearly' ELSE CAST(1 + c_custkey % 4 AS VARCHAR) || ' yearly' END AS frequency
FROM customer CROSS JOIN (VALUES (0), (1), (2)) AS v(k)""")
def merged_cells(spark: SparkSession, d: str) -> DataFrame:
    words, _, _, body, bands = _frame(spark, d)
    rects = _sizes(words).select("doc_id", "page", F.lit(0).alias("seq"), F.lit(240.0).alias("x0"), F.lit(320.0).alias("x1"), F.lit(115.0).alias("top"), F.lit(175.0).alias("bottom"))
    rows = geometry.spread_merged_cells(geometry.bind_rows(body, bands), rects, words, bands)
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y")) - 1
    return rows.select("doc_id", nth.cast("int").alias("row_seq"), F.get("cells", F.lit(2)).alias("frequency"))


# -- jobs ------------------------------------------------------------------------------------------------------------


@query("SELECT sha256(concat_ws('|', sha256(text), '1')) AS key, min(doc_id) AS first_id, count(*) AS n_submissions FROM documents WHERE text IS NOT NULL GROUP BY 1")
def job_keys(spark: SparkSession, d: str) -> DataFrame:
    return jobs.submit(table(spark, d, "documents"), content="text")[0]


@query("""WITH k AS (SELECT doc_id AS id, sha256(concat_ws('|', sha256(text), '1')) AS key FROM documents WHERE text IS NOT NULL)
SELECT id, key FROM k WHERE id NOT IN (SELECT min(id) FROM k GROUP BY key)""")
def job_replays(spark: SparkSession, d: str) -> DataFrame:
    return jobs.submit(table(spark, d, "documents"), content="text")[1]


@query("SELECT doc_id FROM documents ORDER BY received_at DESC NULLS LAST, doc_id DESC LIMIT 100")
def kept_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred jobs, the bound of a job store."""
    return jobs.kept_jobs(table(spark, d, "documents").select("doc_id", "received_at"), 100, "received_at").select("doc_id")


class _FlakyOffline:
    """A client for tests of the calls: some prompts fail once and then pass, others never pass."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def complete(self, prompt: str) -> str:
        kind = len(prompt) % 3
        if kind == 1 and prompt not in self.seen:
            self.seen.add(prompt)
            raise calls.Fault.of_status(503)
        if kind == 2:
            raise calls.Fault.of_status(400)
        return "{}"


@query(f"WITH {_NORM} SELECT doc_id, block_id, CASE WHEN length(btext) % 3 = 2 THEN 'http_400' END AS error, CASE WHEN length(btext) % 3 = 1 THEN 2 ELSE 1 END AS calls FROM p")
def model_calls(spark: SparkSession, d: str) -> DataFrame:
    prompts = _blocks(spark, d).where("kind = 'package'").select("doc_id", "block_id", F.col("text").alias("prompt"))
    return calls.ask(prompts, _FlakyOffline, base=0.0).select("doc_id", "block_id", "error", "calls")
