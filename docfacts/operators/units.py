"""Quantities in different units and scales to one unit (problem 4).

Conversions are edges of a graph; each edge is an affine function with rational factors. The shortest composition
from every unit to every other is worked out once, cycles are checked to agree, and values are converted by an
equi-join on source unit and canonical target.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions.tables import durable, spread
from docfacts.functions.textfold import plain_text
from docfacts.operators import skew

#: An edge: source, target, factor, offset: target = source * factor + offset.
Edge = tuple[str, str, Fraction, Fraction]

#: How many of the finer span fit into the coarser one, as rates: a rate per month is twelve times that per year.
RATE_EDGES: list[Edge] = [(a, "year", Fraction(n), Fraction(0)) for a, n in (
    ("half_year", 2), ("quarter", 4), ("month", 12), ("half_month", 24), ("two_weeks", 26), ("week", 52), ("day", 365),
)]
#: Scales on which a moment is counted; those of days begin at different days.
MOMENT_EDGES: list[Edge] = [
    ("unix_second", "unix_day", Fraction(1, 86_400), Fraction(0)), ("unix_day", "julian_day", Fraction(1), Fraction(4_881_175, 2)), ("sheet_day", "unix_day", Fraction(1), Fraction(-25_569)),
]
#: Money scales.
MONEY_EDGES: list[Edge] = [("dollar", "cent", Fraction(100), Fraction(0)), ("hundred_dollars", "dollar", Fraction(100), Fraction(0))]


def compose(edges: list[Edge]) -> dict[tuple[str, str], tuple[Fraction, Fraction]]:
    """(source, target) -> (factor, offset) by the shortest composition; each edge also holds backwards.

    Raises ValueError if two ways between the same units disagree, or a factor is zero.
    """
    out: dict[str, list[tuple[str, Fraction, Fraction]]] = {}
    for a, b, k, c in edges:
        if k == 0:
            raise ValueError(f"the conversion from {a} to {b} can't be turned round")
        out.setdefault(a, []).append((b, k, c))
        out.setdefault(b, []).append((a, 1 / k, -c / k))
    best: dict[tuple[str, str], tuple[Fraction, Fraction]] = {}
    for source in out:
        best[source, source] = (Fraction(1), Fraction(0))
        queue = deque([source])
        while queue:
            unit = queue.popleft()
            k0, c0 = best[source, unit]
            for nxt, k, c in out[unit]:
                way = (k0 * k, c0 * k + c)
                if (source, nxt) not in best:
                    best[source, nxt] = way
                    queue.append(nxt)
                elif best[source, nxt] != way:
                    raise ValueError(f"two ways from {source} to {nxt} disagree: {best[source, nxt]} and {way}")
    return best


def conversion_table(spark: SparkSession, edges: list[Edge], target: str) -> DataFrame:
    """(unit, target, num, den, off_num, off_den): how to reach the target; one row for each unit of the graph."""
    rows = [(a, b, k.numerator, k.denominator, c.numerator, c.denominator) for (a, b), (k, c) in compose(edges).items() if b == target]
    if any(max(abs(p * s), abs(q * r), q * s) >= 10**12 for _, _, p, q, r, s in rows):
        raise ValueError(f"a conversion to {target} has a factor of more than twelve digits")
    return spark.createDataFrame(rows, "unit string, target string, num bigint, den bigint, off_num bigint, off_den bigint")


def convert(df: DataFrame, table: DataFrame, unit: str, num: Column, den: Column, out: str) -> DataFrame:
    """df with ``out`` = the quantity num / den of column ``unit`` in the table's target, as BIGINT, halves rounded up.

    The table has one row for each unit of a fixed graph, which bounds the broadcast. Rows whose unit is null or not
    in the graph, whose quantity is null or has no positive denominator, or whose result is negative or beyond BIGINT
    (9.2e18 or more), are left out. The arithmetic is exact: integers of up to 38 digits.
    """
    joined = df.join(F.broadcast(table.withColumnRenamed("unit", "__u")), F.col(unit) == F.col("__u"))
    joined = joined.withColumns({"__n": num.try_cast("decimal(24,0)"), "__d": den.try_cast("decimal(24,0)")}).where("__d > 0")
    about = "(cast(__n AS double) / cast(__d AS double)) * (cast(num AS double) / den) + cast(off_num AS double) / off_den"
    joined = joined.where(f"abs({about}) < 9.2e18 AND __n * cast(num * off_den AS decimal(12,0)) + __d * cast(den * off_num AS decimal(12,0)) >= 0")
    joined = joined.withColumns({
        "__top": F.expr("__n * cast(num * off_den AS decimal(12,0)) + __d * cast(den * off_num AS decimal(12,0))"),
        "__bottom": F.expr("__d * cast(den * off_den AS decimal(12,0))"),
    })
    # The remainder decides on rounding; doubling the numerator could pass 38 digits.
    rest = F.expr("CASE WHEN (__top % __bottom) >= __bottom - (__top % __bottom) THEN 1 ELSE 0 END")
    result = (F.expr("__top div __bottom") + rest).alias(out)
    return joined.select(*df.columns, result)


# -- reading quantities from text ------------------------------------------------------------------------------------

#: Words for numbers.
NUMBER_WORDS = {w: n for n, ws in {
    1: "one once single un una uno une einmal ein eine", 2: "two twice dos deux zweimal zwei", 3: "three thrice tres trois dreimal drei", 4: "four cuatro quatre vier",
    5: "five cinco cinq", 6: "six seis sechs", 7: "seven siete", 8: "eight ocho huit", 9: "nine nueve", 10: "ten diez dix", 11: "eleven once_", 12: "twelve doce douze zwölf",
    13: "thirteen", 14: "fourteen", 15: "fifteen quince", 16: "sixteen", 17: "seventeen", 18: "eighteen dieciocho", 19: "nineteen", 20: "twenty veinte", 24: "veinticuatro",
    30: "thirty treinta", 40: "forty cuarenta", 50: "fifty cincuenta", 60: "sixty sesenta", 70: "seventy", 80: "eighty", 90: "ninety",
}.items() for w in ws.split()}
#: Numbers of services and spans; one of more digits is beyond every result.
WIDE = "decimal(22,0)"
#: Ordinal words.
ORDINAL_WORDS = {"other": 2, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "tenth": 10}
#: Spellings of the spans of time.
SPAN_WORDS = {
    "year": "years year yrs yr y annum annually annual yearly años año anual anualmente ans an jahre jahr",
    "half_year": "half-years half-year semester semesters semestre semestres",
    "quarter": "quarters quarter quarterly qtrs qtr trimestre trimestres",
    "month": "months month mos mo m monthly meses mes mensual mois monate monat",
    "week": "weeks week wks wk w weekly semanas semana semaines semaine wochen woche",
    "day": "days day d daily días día jours jour tage tag",
}
_SPAN = "|".join(sorted((w for ws in SPAN_WORDS.values() for w in ws.split()), key=lambda w: (-len(w), w)))
_KIND = r"(?:(?:any|a|an|the|each|every|rolling|consecutive|calendar|plan|benefit|contract|policy|service|coverage|full|given|single|period of|successive)[ -]+)*"
_WHAT = r"(?:\s*(?:x\b|×|times?\b|veces\b|vez\b|fois\b|mal\b|(?:visit|service|treatment|procedure|exam|unit|image|set|application|session|cleaning)(?:\(s\)|s)?(?![a-z])|of \([^)]*\)|\([^)]*\)|(?:per|for each|por|for any|in each) (?:quadrant|tooth|teeth|arch|side|site|member|person|area|surface|provider|diente|cuadrante)\b|only\b|,))*"
_LINK = r"\s*(?:/|:|per\b|every\b|each\b|in\b|within\b|over\b|during\b|cada\b|por\b|al\b|en\b|a\b|par\b|pro\b|im\b|alle\b|tous les\b|p\.)\s*"
#: A number of services, and the span it is for.
COUNTED = rf"(?<![$\d.,a-z-])(\d+){_WHAT}(?:{_LINK}{_KIND}(\d+)?(?:st|nd|rd|th)?[ -]*{_KIND}({_SPAN})(?![a-z])|[ -]*(p\.? ?a\b)|[ -]+(yearly|annually|quarterly|monthly|weekly|daily)\b)"
#: A span alone.
SPANNED = rf"^(?:limited to |limit |allowed |covered |available |only |payable |max\.? )*(?:(?:every|each|per|cada|alle|tous les)\b\s*{_KIND}(\d+)?(?:st|nd|rd|th)?[ -]*{_KIND}({_SPAN})(?![a-z])|(semi-? ?annually|semi-? ?annual|half-? ?yearly|bi-? ?annually|biennially|bi-? ?monthly|yearly|annually|annual|quarterly|monthly|weekly|daily|p\.? ?a)\b)"
#: Adverbs for a rate of one: span number and span.
ADVERBS = {
    "semiannually": (1, "half_year"), "semiannual": (1, "half_year"), "halfyearly": (1, "half_year"), "biannually": (1, "half_year"), "biennially": (2, "year"), "bimonthly": (2, "month"),
    "yearly": (1, "year"), "annually": (1, "year"), "annual": (1, "year"), "quarterly": (1, "quarter"), "monthly": (1, "month"), "weekly": (1, "week"), "daily": (1, "day"), "pa": (1, "year"),
}


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


#: Marks behind tens and in front of units that were written as words; only such are joined.
TENS_MARK, UNIT_MARK = "\u0001", "\u0002"


def normal_words(text: Column) -> Column:
    """Plain characters, lower case, single blanks, numbers in digits: "One (1) per twenty-four months" is "1 per 24 months"."""
    t = F.translate(F.lower(plain_text(text)), TENS_MARK + UNIT_MARK, "")
    t = F.trim(F.regexp_replace(t, r"[\s\x{85}\x{2028}\x{2029}_]+", " "))
    digits = {w: f"{n}{TENS_MARK}" if n in range(20, 100, 10) else f"{UNIT_MARK}{n}" if n < 10 else str(n) for w, n in NUMBER_WORDS.items()}
    digits |= {w: str(n) for w, n in ORDINAL_WORDS.items()}
    numbers = _map(digits)
    words = F.regexp_extract_all(t, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    t = F.array_join(F.transform(words, lambda w: F.when(w.isin(*digits), F.try_element_at(numbers, w)).otherwise(w)), "")
    t = F.regexp_replace(t, f"([2-9])0{TENS_MARK}[- ]{UNIT_MARK}([1-9])", "$1$2")
    return F.regexp_replace(F.translate(t, TENS_MARK + UNIT_MARK, ""), r"\b(\d+) \(\1\)", "$1")


def _groups(form: str, n: int) -> Column:
    """The groups of the first match in column __t, all empty without a match; the pattern runs twice, not once for each group."""
    return F.split(F.regexp_replace(F.regexp_extract("__t", form, 0), form, "|".join(f"${i + 1}" for i in range(n))), r"\|", n)


def read_rate(df: DataFrame, text: str) -> DataFrame:
    """df with services, spans DECIMAL and span STRING read from a limit's wording; null where it states no number per span.

    The first number with a span counts, else a span alone that begins the text, which allows one service. Conditions
    that follow (teeth, codes, ages, gaps, sums) aren't looked at.
    """
    spans = _map({w: unit for unit, ws in SPAN_WORDS.items() for w in ws.split()})
    adverb_n, adverb_unit = _map({k: str(n) for k, (n, _) in ADVERBS.items()}), _map({k: u for k, (_, u) in ADVERBS.items()})
    df = df.withColumn("__t", normal_words(F.col(text)))
    df = df.withColumns({"__m": _groups(COUNTED, 5), "__sm": _groups(SPANNED, 3)})
    got = {f"__{n}": F.get(F.col("__m"), F.lit(i)) for i, n in enumerate(("c", "n", "u", "pa", "av"))}
    got |= {f"__s{n}": F.get(F.col("__sm"), F.lit(i)) for i, n in enumerate(("n", "u", "av"))}
    df = df.withColumns(got)
    adverb = F.regexp_replace(F.concat(F.when(F.col("__c") != "", F.concat("__pa", "__av")).otherwise(F.col("__sav"))), r"[ .-]", "")
    df = df.withColumn("__adv", adverb)
    counted = F.coalesce(F.col("__c"), F.lit("")) != ""
    unit = F.coalesce(F.try_element_at(adverb_unit, F.col("__adv")), F.try_element_at(spans, F.when(counted, F.col("__u")).otherwise(F.col("__su"))))
    number = F.coalesce(F.try_element_at(adverb_n, F.col("__adv")), F.when(counted, F.nullif(F.col("__n"), F.lit(""))).otherwise(F.nullif(F.col("__sn"), F.lit(""))), F.lit("1"))
    df = df.withColumns({"services": F.when(unit.isNotNull(), F.when(counted, F.col("__c").try_cast(WIDE)).otherwise(F.lit(1).cast(WIDE))), "spans": number.try_cast(WIDE), "span": unit})
    return df.drop("__t", "__m", "__sm", "__adv", *got)


#: What a money unit's spelling means.
MONEY_WORDS = {"usd": "dollar", "$": "dollar", "dollars": "dollar", "dollar": "dollar", "us$": "dollar", "cents": "cent", "cent": "cent", "¢": "cent", "us cents": "cent", "usd hundreds": "hundred_dollars", "hundred usd": "hundred_dollars", "hundreds usd": "hundred_dollars", "hundreds of usd": "hundred_dollars"}
#: How a payment's span is told, first match holds.
CADENCES = [
    ("half_month", r"(twice|2 times) (a|per|each) month|semi-? ?monthly|half-? ?monthly|24 times (a|per) year|quincenal"),
    ("two_weeks", r"every (two|2|other) weeks?|26 times (a|per) year|bi-? ?weekly|fortnight|two-week"),
    ("half_year", r"every (six|6) months|half-? ?year|semi-? ?annual|(twice|2 times) (a|per|each) (plan |calendar )?year|semestr|bi-? ?annual"),
    ("quarter", r"every (three|3) months|quarter|\bqtr|trimestr|4 times (a|per) year|four times (a|per) year"),
    ("month", r"\bmonth|\bmo\b|\bmes\b|mensual|12 times (a|per) year"),
    ("week", r"\bweek|\bwk\b|\bsemana|52 times (a|per) year"),
    ("year", r"year|\byr\b|\bannual|\bp\. ?a\b|\baño|\banno|\bannum"),
    ("day", r"\bdaily\b|\b(per|a|each) day\b"),
]
#: Payments that recur over no span of time.
NO_SPAN = r"per[ _]visit|one[ _-]time|\bonce (at|only|on|upon)|due once"


def read_cadence(text: Column) -> Column:
    """The unit of RATE_EDGES that a wording names, or null."""
    out = F.when(text.rlike(NO_SPAN), F.lit(None).cast("string"))
    for unit, form in CADENCES:
        out = out.when(text.rlike(form), F.lit(unit))
    return out


def service_limits_per_year(rows: DataFrame, id_col: str = "row_id", text: str = "frequency") -> DataFrame:
    """(id, per_year): services per year times 1,000 of every limit that allows a number of services per span of time.

    Null, empty and placeholder texts, limits by lifetime, visit or date, waiting times and ages give no row, nor do
    results beyond BIGINT. Repeated rows stay repeated. Texts may use other widths, styles and look-alike letters. Columns
    besides the two are not read. Each distinct wording is read once and joined back; wordings that many rows share are
    joined by broadcast (skew.lookup).
    """
    table = conversion_table(rows.sparkSession, RATE_EDGES, "year")
    rows = rows.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text <> ''")
    counted = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    # Written before it is filtered: a condition on what is read would be pushed down and the text read once more for it.
    read = durable(read_rate(spread(counted, F.xxhash64("text")), "text").select(F.col("text").alias("wording"), "n", "services", "spans", "span"))
    read = convert(read, table, "span", F.col("services") * 1000, F.col("spans"), "per_year").select("wording", "per_year", "n")
    total = read.agg(F.sum("n")).first()[0] or 0
    out = skew.lookup(rows, {"wording": F.col("text")}, read, "per_year", "n", total, F.col("id"), how="inner")
    return out.select(F.col("id").alias(id_col), "per_year")


#: Amounts of money in a text: behind a sign or code, else in front of one.
SUM_BEHIND = r"(?:us ?\$|\$|\busd) ?([0-9][0-9,]*(?:\.[0-9]+)?)(.*)$"
SUM_BEFORE = r"(?<![0-9.,])([0-9][0-9,]*(?:\.[0-9]+)?) ?(usd\b|us dollars?\b|dollars?\b|us cents?\b|cents?\b|¢)(.*)$"


def read_quote(quote: Column) -> Column:
    """STRUCT<value, unit, tail> of the first amount that a quote (plain, lower case) states, or null: unit is dollar or cent, tail what follows."""
    behind = F.when(F.regexp_extract(quote, SUM_BEHIND, 1) != "", F.struct(F.regexp_extract(quote, SUM_BEHIND, 1).alias("value"), F.lit("dollar").alias("unit"), F.regexp_extract(quote, SUM_BEHIND, 2).alias("tail")))
    unit = F.when(F.regexp_extract(quote, SUM_BEFORE, 2).rlike("cent|¢"), "cent").otherwise("dollar")
    before = F.when(F.regexp_extract(quote, SUM_BEFORE, 1) != "", F.struct(F.regexp_extract(quote, SUM_BEFORE, 1).alias("value"), unit.alias("unit"), F.regexp_extract(quote, SUM_BEFORE, 3).alias("tail")))
    return F.coalesce(behind, before)


def premiums_per_year(rows: DataFrame, id_col: str = "premium_id") -> DataFrame:
    """(id, per_year): cents per year of every premium that states an amount over a span of time.

    rows: id, amount DOUBLE, amount_unit, cadence and evidence_quote STRING. Where amount is null, amount, unit and cadence
    are those of the quote; where only the cadence is missing (null, blank, "unknown"), the quote's; a null or blank unit
    means dollars, an unknown one gives no row. A quote's amount stands behind $, US$ or USD, else before USD, dollars or
    cents. One-time and per-visit amounts, amounts that are negative or not a number, results beyond BIGINT, and rows
    without an amount give no row. Repeated rows stay repeated.
    """
    low = lambda c: F.lower(F.trim(plain_text(F.col(c))))
    wide = rows.select(F.col(id_col).alias("id"), "amount", low("amount_unit").alias("unit"), low("cadence").alias("cad"), F.col("evidence_quote").alias("raw"))
    missing = F.col("cad").isNull() | F.col("cad").isin("", "unknown", "-", "n/a", "none")
    there = F.col("amount").isNotNull()
    needed = F.when(~there | missing, F.col("raw"))  # only these rows' quotes are looked at
    wide = wide.withColumn("quote", F.regexp_replace(F.lower(plain_text(needed)), r"\s+", " ")).withColumn("said", read_quote(F.col("quote")))
    told = F.when(F.col("said").isNotNull() & ~F.col("said.tail").rlike(NO_SPAN), F.coalesce(read_cadence(F.col("said.tail")), read_cadence(F.col("quote"))))
    named = F.when(F.coalesce("unit", F.lit("")) != "", F.try_element_at(_map(MONEY_WORDS), F.col("unit"))).otherwise(F.lit("dollar"))
    money = F.when(there, named).otherwise(F.col("said.unit"))
    span = F.when(there & ~missing, read_cadence(F.col("cad"))).otherwise(told)
    quoted = F.regexp_replace("said.value", ",", "").try_cast("decimal(26,6)")
    value = F.when(there, F.when(~F.isnan("amount"), F.col("amount").try_cast("decimal(26,6)"))).otherwise(quoted)
    read = wide.select("id", value.alias("value"), F.concat(money, F.lit(" per "), span).alias("unit")).where("value >= 0 AND unit IS NOT NULL")
    table = conversion_table(rows.sparkSession, premium_edges(), "cent per year")
    return convert(read, table, "unit", F.col("value") * 1000000, F.lit(1000000), "per_year").select(F.col("id").alias(id_col), "per_year")


def premium_edges() -> list[Edge]:
    """From an amount of a money unit over a span to cents per year, as products of both graphs' compositions."""
    money, spans = compose(MONEY_EDGES), compose(RATE_EDGES)
    edges = [(f"{a} per {x}", "cent per year", k * r, Fraction(0)) for (a, b), (k, _) in money.items() if b == "cent" for (x, y), (r, _) in spans.items() if y == "year"]
    return [e for e in edges if e[0] != e[1]]
