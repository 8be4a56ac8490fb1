"""Column labels and contents to column roles (guide path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfacts.functions.textops import let

#: Phrases of each role; of phrases in one label the longest holds, of equally long ones the earlier role.
ROLE_PHRASES = [
    ("out_network", ["out of network", "out of plan", "outofnetwork", "non participating", "nonparticipating", "non par", "out network"]),
    ("in_network", ["in network", "in plan", "innetwork", "participating", "par provider", "preferred provider"]),
    ("description", ["description", "code description", "description of benefits", "benefit description", "service description", "nomenclature", "benefit", "service", "procedure", "what it covers", "covers"]),
    ("code", ["code", "codes", "ada code", "cdt code", "procedure code", "dental code", "code number"]),
    ("frequency", ["frequency", "limitation", "limitations", "periodicity", "how often", "frequency limitation", "limits", "benefit limitations"]),
    ("group", ["service category", "benefit group", "benefit category", "category", "class", "service type", "benefit type"]),
]
#: Phrases of a coverage column that doesn't say for which network.
COVERAGE_HINTS = ["coverage", "plan pays", "you pay", "member pays", "copay", "coinsurance", "cost share", "you owe"]
#: What cells of a frequency column and of a column of shares hold.
FREQUENCY_WORDS = ["per ", "every", "each ", "year", "month", "visit", "unlimited", "once", " of (", "lifetime", "as needed", "not within", "day"]
NOT_COVERED = ["not covered", "no charge", "covered in full", "n/a"]
CODE_CELL, MONEY_CELL = r"^[A-Z]\d{4}[A-Z]?$", r"(?i)^\$?\s?\d[\d,]*(?:\.\d{1,2})?\s?%?(?:\s*(?:copay|coinsurance))?$"
#: Rows looked at, and the shares and lengths that decide.
SAMPLE_ROWS, SHARE, FREQUENCY_SHARE, CODE_FLOOR, MIN_DESCRIPTION, ALL_ROLES = 40, 0.6, 0.4, 0.4, 8, 5


def normal_label(label: Column) -> Column:
    """Lower case; slashes and hyphens are blanks; other signs go."""
    kept = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9/ -]", " ")
    return F.trim(F.regexp_replace(F.translate(kept, "/-", "  "), r"\s+", " "))


def label_role(label: Column) -> Column:
    """The role that a label names, or null; a bare coverage column counts as in_network."""

    def role(norm: Column) -> Column:
        hits = [F.when(F.contains(norm, F.lit(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(-k).alias("o"), F.lit(role).alias("r"))) for k, (role, phrases) in enumerate(ROLE_PHRASES) for p in phrases]
        hint = F.lit(False)
        for h in COVERAGE_HINTS:
            hint = hint | F.contains(norm, F.lit(h))
        return F.coalesce(F.array_max(F.array_compact(F.array(*hits)))["r"], F.when(hint, "in_network"))

    return let(normal_label(label), role)


def label_roles(labels: Column) -> Column:
    """MAP<role, column>: the first column of each role."""

    def first(roles: Column) -> Column:
        entries = F.transform(roles, lambda r, i: F.struct(r.alias("r"), i.alias("i")))
        return F.map_from_entries(F.filter(entries, lambda x: x["r"].isNotNull() & (F.array_position(roles, x["r"]) == x["i"] + 1)))

    return let(F.transform(labels, label_role), first)


def unqualified_coverage(labels: Column) -> Column:
    """Whether a coverage column exists and no label says for which network."""
    hint = lambda x: F.exists(F.array(*[F.lit(h) for h in COVERAGE_HINTS]), lambda h: F.contains(normal_label(x), h))
    return F.exists(labels, hint) & ~F.exists(labels, lambda x: F.contains(normal_label(x), F.lit("network")) | F.contains(normal_label(x), F.lit("participating")))


def unmapped_labels(labels: Column) -> Column:
    """Labels with text that name no role."""
    return F.filter(labels, lambda x: (F.trim(x) != "") & label_role(x).isNull())


def column_statistics(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, stats ARRAY<STRUCT<idx, code, money, freq, length>>): shares of the filled cells and mean length, of the first SAMPLE_ROWS rows of each table."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    cells = rows.withColumn("__n", nth).where(F.col("__n") <= SAMPLE_ROWS).select(*keys, F.posexplode("cells").alias("idx", "cell"))
    full = F.trim(F.coalesce("cell", F.lit(""))) != ""
    low = F.lower(F.col("cell"))
    often = F.exists(F.array(*[F.lit(w) for w in FREQUENCY_WORDS]), lambda w: F.contains(low, w))
    share = lambda test: F.coalesce(F.count_if(full & test) / F.nullif(F.count_if(full), F.lit(0)), F.lit(0.0))
    code = F.regexp_extract(F.trim("cell"), r"^\S+", 0).rlike(CODE_CELL)
    money = F.trim("cell").rlike(MONEY_CELL) | F.trim(low).isin(*NOT_COVERED)
    per = cells.groupBy(*keys, "idx").agg(share(code).alias("code"), share(money).alias("money"), share(often).alias("freq"), F.avg(F.char_length(F.coalesce("cell", F.lit("")))).alias("length"))
    return per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "code", "money", "freq", "length"))).alias("stats"))


def infer_roles(stats: Column, known: Column) -> Column:
    """MAP<role, column> of a table from its header's roles and its columns' statistics.

    Roles that the cells contradict are dropped first: a code column with few codes, a description or coverage column of codes.
    Missing roles are then claimed by contents, in the order code, in_network and out_network, frequency, description; equal
    scores go to the rightmost column.
    """
    stat = lambda role, f: F.try_element_at(F.filter(stats, lambda s: s["idx"] == F.try_element_at(known, F.lit(role))), F.lit(1))[f]
    contradicted = lambda k: (
        ((k == "code") & (F.coalesce(stat("code", "code"), F.lit(0.0)) < CODE_FLOOR)) | ((k == "description") & (F.coalesce(stat("description", "code"), F.lit(0.0)) >= SHARE))
        | ((k == "in_network") & (F.coalesce(stat("in_network", "code"), F.lit(0.0)) >= SHARE)) | ((k == "out_network") & (F.coalesce(stat("out_network", "code"), F.lit(0.0)) >= SHARE))
    )
    roles = F.map_filter(known, lambda k, v: ~contradicted(k))
    state = F.struct(roles.alias("m"))

    def claim(acc: Column, role: str, pick: Column) -> Column:
        free = ~F.map_contains_key(acc["m"], F.lit(role)) & pick.isNotNull() & ~F.array_contains(F.map_values(acc["m"]), pick)
        return F.struct(F.when(free, F.map_concat(acc["m"], F.create_map(F.lit(role), F.coalesce(pick, F.lit(-1))))).otherwise(acc["m"]).alias("m"))

    def best(acc: Column, field: str, least: float, taken: bool) -> Column:
        open_ = stats if not taken else F.filter(stats, lambda s: ~F.array_contains(F.map_values(acc["m"]), s["idx"]))
        top = F.array_max(F.transform(open_, lambda s: F.struct(s[field].alias("x"), s["idx"].alias("idx"))))
        return F.when(top["x"] >= least, top["idx"])

    def steps(acc: Column, i: Column) -> Column:
        with_code = claim(acc, "code", best(acc, "code", SHARE, False))
        return F.when(i == 0, with_code).when(i == 1, _shares(acc, stats, claim)).when(i == 2, claim(acc, "frequency", best(acc, "freq", FREQUENCY_SHARE, True))).otherwise(claim(acc, "description", best(acc, "length", MIN_DESCRIPTION, True)))

    return F.aggregate(F.array(*[F.lit(i) for i in range(4)]), state, steps, lambda acc: acc["m"])


def _shares(acc: Column, stats: Column, claim) -> Column:
    money = F.transform(F.filter(stats, lambda s: ~F.array_contains(F.map_values(acc["m"]), s["idx"]) & (s["money"] >= SHARE)), lambda s: s["idx"])
    first, second = F.get(money, F.lit(0)), F.get(money, F.lit(1))
    return claim(claim(acc, "in_network", first), "out_network", second)


def table_roles(rows: DataFrame, keys: list[str], order: list[str], labels: str = "labels") -> DataFrame:
    """(keys, roles MAP<STRING, INT>): the roles of each table's columns, by its labels, and by its contents where these name fewer than five."""
    stats = column_statistics(rows, keys, order)
    heads = rows.groupBy(*keys).agg(F.min_by(labels, F.struct(*order)).alias("labels"))
    known = heads.withColumn("known", F.when(F.col("labels").isNull(), F.create_map().cast("map<string,int>")).otherwise(label_roles(F.col("labels"))))
    joined = known.join(stats, keys, "left")
    return joined.select(*keys, F.when((F.size("known") >= ALL_ROLES) | F.col("stats").isNull(), F.col("known")).otherwise(infer_roles(F.col("stats"), F.col("known"))).alias("roles"))
