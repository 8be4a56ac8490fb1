"""Text that looks the same brought to one form (problem 6).

Texts are taken apart into positioned code points; the code points are broadcast-joined with their decompositions and
look-alikes; combining marks are ordered by class; each letter with its marks is composed again by a join, and the text
is put together. Everything runs in the JVM on the distinct texts that can change at all. Rows carry a short identifier
in place of their text, and ASCII characters that no mark follows stay together, because nothing can change them.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfacts.functions.textfold import shape_map
from docfacts.functions.tables import durable, spread
from docfacts.operators import skew

#: Texts of these characters alone are their own form: ASCII, Latin-1 letters, dashes, quotation marks, bullet, signs that nothing looks like.
STABLE = r"^[\x00-\x7F¡¿À-ÿ–—‘’“”•€]*$"
#: First and last code points of the letters of a Korean syllable.
KOREAN_HEADS, KOREAN_VOWELS, KOREAN_TAILS = (0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2)


@functools.lru_cache(maxsize=1)
def code_point_map() -> list[tuple[str, list[str], list[int]]]:
    """(character, what it becomes, the combining class of each): for every character that changes, by Unicode's own rules.

    Compatibility decomposition, then look-alike letters, hyphens, spaces and invisible characters, until nothing changes.
    The table has as many rows as Unicode has such characters (under 30,000): that is the bound of its broadcast.
    """
    shapes = shape_map()
    out = []
    for c in range(0x110000):
        ch = chr(c)
        if 0xD800 <= c < 0xE000 or unicodedata.category(ch) in ("Cn", "Co"):
            continue
        form = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch.translate(shapes)).translate(shapes))
        marks = [unicodedata.combining(x) for x in form]
        if form != ch or any(marks):
            out.append((ch, list(form), marks))
    return out


@functools.lru_cache(maxsize=1)
def composition_map() -> list[tuple[str, str]]:
    """(decomposed cluster, composed character) of every character that Unicode composes."""
    out = []
    for c in range(0xC0, 0x30000):
        ch = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        form = unicodedata.normalize("NFD", ch)
        if len(form) > 1 and unicodedata.normalize("NFC", form) == ch:
            out.append((form, ch))
    return out


#: Longest decomposed cluster that Unicode composes.
LONGEST = 4
#: The positioned pieces of a text: a run of ASCII characters up to the one that a mark may follow, else one character.
PIECE = r"[\x00-\x7F]+(?=[\x00-\x7F]|\z)|(?s:.)"


def unstable(text: Column) -> Column:
    """Whether a text may change at all."""
    return ~text.rlike(STABLE)


def one_form(texts: DataFrame, text: str = "text") -> DataFrame:
    """(text, form, n) for each distinct text that may change; form is its one consistent form, "" for invisible characters alone; n rows hold it.

    Of two texts that look the same the forms are equal: widths and styles, composed and combined accents in any order,
    joined letters, invisible characters, kinds of space and hyphen, and look-alike letters of other alphabets. Letter
    case, accents, words, plain punctuation, plain spaces, tabs and line ends stay. Nulls and texts that can't change
    (see STABLE) give no row. Repeated texts count in n. A text is taken apart where it is read and put together by its
    position; its rows carry its identifier, a 64-bit hash and a rank among the texts of that hash, so their bytes grow
    with the text's length and not with its square.
    """
    spark: SparkSession = texts.sparkSession
    mapping = F.broadcast(spark.createDataFrame(code_point_map(), "ch string, becomes array<string>, classes array<int>"))
    compose = F.broadcast(spark.createDataFrame(composition_map(), "cluster_ string, composed string"))
    counted = texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull() & unstable(F.col("text"))).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    keyed = spread(counted.withColumn("h", F.xxhash64("text")), "h")  # all that follows is by h
    keyed = durable(keyed.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("text"))))
    points = spread(keyed, "h").select("h", "r", F.posexplode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("pos", "ch"))
    known = points.join(mapping, "ch", "left")
    parts = F.coalesce(F.arrays_zip(F.col("becomes").alias("c"), F.col("classes").alias("k")), F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("k"))))
    long = known.select("h", "r", "pos", F.posexplode(parts).alias("sub", "x")).select("h", "r", F.struct("pos", "sub").alias("at"), F.col("x.c").alias("c"), F.col("x.k").alias("k"))
    clusters = _clusters(long)
    # Of a cluster's beginnings the longest that Unicode composes; what is left of the cluster follows as it is.
    heads = F.when(F.col("several"), F.sequence(F.lit(2), F.least(F.char_length("cluster"), F.lit(LONGEST)))).otherwise(F.array().cast("array<int>"))
    tried = clusters.withColumn("n", F.explode_outer(heads)).withColumn("head", F.expr("left(cluster, n)"))
    tried = tried.join(compose, F.col("head") == F.col("cluster_"), "left").withColumn("n", F.when(F.col("composed").isNotNull(), F.col("n")).otherwise(0))
    best = tried.groupBy("h", "r", "first").agg(F.max(F.struct("n", "composed", "cluster")).alias("b"))
    piece = F.when(F.col("b.n") > 0, F.concat("b.composed", F.expr("substring(b.cluster, b.n + 1)"))).otherwise(F.col("b.cluster"))
    built = best.select("h", "r", "first", piece.alias("piece")).groupBy("h", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "piece"))), lambda x: x["piece"]), "").alias("form"))
    return spread(keyed, "h").join(built, ["h", "r"], "left").select("text", F.coalesce("form", F.lit("")).alias("form"), "n")


def _clusters(long: DataFrame) -> DataFrame:
    """(h, r, first, cluster, several): the characters of each cluster, marks ordered by class and then by place behind the character they follow."""
    order = Window.partitionBy("h", "r").orderBy("at")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    code, before = F.ascii("c"), F.ascii(F.lag("c").over(order))
    syllable = (code.between(*KOREAN_VOWELS) & before.between(*KOREAN_HEADS)) | (code.between(*KOREAN_TAILS) & before.between(*KOREAN_VOWELS))
    marked = long.withColumn("starts", (F.col("k") == 0) & ~F.coalesce(syllable, F.lit(False)))
    numbered = marked.withColumns({"first": F.sum(F.col("starts").cast("int")).over(run), "base": F.sum((F.col("k") == 0).cast("int")).over(run)})
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "k", "at", "c"))), lambda x: x["c"]), "")
    return numbered.groupBy("h", "r", "first").agg(together.alias("cluster"), (F.count(F.lit(1)) > 1).alias("several"))


def forms(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the column ``form``: the one form of each row's text; null stays null. Columns called ``form`` are replaced."""
    entries = durable(one_form(rows, text).withColumnsRenamed({"text": "__t", "n": "__n"}))
    rows = rows.drop("form") if text != "form" else rows
    keyed = rows.withColumn("__key", F.when(unstable(F.col(text)), F.col(text)))
    found = skew.lookup(keyed, {"__t": F.col("__key")}, entries, "form", "__n", rows.count(), F.struct(*[c for c, t in rows.dtypes if "map" not in t]))
    return found.withColumn("form", F.coalesce("form", F.col(text))).drop("__key")


def classes(rows: DataFrame) -> DataFrame:
    """rows (src, grp, id, text) -> distinct (src, id, class_id, n_texts): the rows whose group holds a text that looks the same and differs.

    class_id is the smallest id of the rows of the group that look like the row, n_texts the number of their distinct
    texts: one row for each member of a class instead of all its pairs. Rows that are left out are those of lookalikes().
    """
    rows = rows.where("grp IS NOT NULL AND id IS NOT NULL AND text <> ''").select("src", F.col("grp").cast("string").alias("grp"), "id", "text").distinct()
    formed = durable(forms(rows).where("form <> ''"))
    texts = formed.groupBy("src", "grp", "form", "text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    sets = texts.groupBy("src", "grp", "form").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n")).where("n_texts > 1")
    sets = sets.select(F.struct("src", "grp", "form").alias("key"), F.struct("class_id", "n_texts").alias("class"), "n")
    entries = durable(sets.select(F.to_json("key").alias("k"), "class", "n"))
    keyed = formed.withColumn("kk", F.to_json(F.struct("src", "grp", "form")))
    found = skew.lookup(keyed, {"k": F.col("kk")}, entries, "class", "n", formed.count(), F.col("id"), how="inner")
    return found.select("src", "id", "class.class_id", "class.n_texts").distinct()


def lookalikes(rows: DataFrame) -> DataFrame:
    """rows (src, grp, id, text) -> distinct (src, id_a, id_b), id_a < id_b: rows of one group whose texts look the same but differ.

    Null and empty texts, and null groups, pair with nothing; nor do texts of invisible characters alone. Texts equal letter
    for letter are no pair. At least one text of a pair is one that can change, so those are joined with all rows of their
    group that have their form; the rows of a hot group and form are spread over tasks (skew.salted_pairs).
    """
    rows = rows.where("grp IS NOT NULL AND id IS NOT NULL AND text <> ''").select("src", F.col("grp").cast("string").alias("grp"), "id", "text").distinct()
    formed = durable(forms(rows).where("form <> ''"))
    odd = formed.where(unstable(F.col("text"))).select("src", "grp", "form", F.col("id").alias("id_u"), F.col("text").alias("text_u"))
    near = formed.join(odd.select("src", "grp", "form").distinct(), ["src", "grp", "form"], "left_semi")
    pairs = skew.salted_pairs(odd, near, ["src", "grp", "form"], near.count(), "id")
    pairs = pairs.where((F.col("text") != F.col("text_u")) & (F.col("id") != F.col("id_u")) & (~unstable(F.col("text")) | (F.col("id") < F.col("id_u"))))
    return pairs.select("src", F.least("id", "id_u").alias("id_a"), F.greatest("id", "id_u").alias("id_b")).distinct()
