"""Column expressions for text with exact character offsets.

Everything here works inside one row: no shuffle, and (but for nfkc on non-ASCII rows) no Python. Offsets are 0-based
code points, intervals are half open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfacts.functions.textfold import nfkc

#: Marks put round matches; both are taken out of every text by fold().
OPEN, CLOSE = "\u0001", "\u0002"
#: Dashes brought to the plain one.
DASHES = "–—−‐‑"
#: A line's end, in the wider sense in which form feeds and separators end lines too.
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Limits of a usable text: bytes, characters, share of printable characters.
MAX_BYTES, MIN_CHARS, MIN_PRINTABLE = 2_000_000, 40, 0.85


def fold(text: Column, compose: bool = True) -> Column:
    """Compatibility forms composed, dashes plain, soft hyphens and the two marks removed."""
    # Translating walks a text character by character with a look-up for each; ASCII text without marks has nothing to bring over.
    return let(nfkc(text) if compose else text, lambda t: F.when((F.octet_length(t) == F.char_length(t)) & ~_marked(t), t).otherwise(F.translate(t, DASHES + "­" + OPEN + CLOSE, "-" * len(DASHES))))


def _marked(text: Column) -> Column:
    """Whether a text holds one of the two marks."""
    return F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))


def unmarked(text: Column) -> Column:
    """A text without the two marks."""
    return let(text, lambda t: F.when(_marked(t), F.translate(t, OPEN + CLOSE, "")).otherwise(t))


def squeeze(text: Column) -> Column:
    """Runs of white space (the separators 0x1C-0x1F too) to one blank, without trimming."""
    # Single blanks, nearly all of the white space, stay as they are and are no matches.
    return F.regexp_replace(text, r"(?U) [\s\x1C-\x1F]+|[\s\x1C-\x1F&&[^ ]][\s\x1C-\x1F]*", " ")


def collapse(text: Column, compose: bool = True) -> Column:
    """The one form in which texts are compared: folded, squeezed, trimmed. Idempotent; null stays null."""
    return F.trim(squeeze(fold(text, compose)))


def lines(text: Column) -> Column:
    """The lines of a text; a last line end adds no empty line, and an empty text has no line."""
    body = F.regexp_replace(text, rf"(?:{LINE_END})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END, -1))


def reject_reason(raw: Column, max_bytes: int = MAX_BYTES, min_chars: int = MIN_CHARS, min_printable: float = MIN_PRINTABLE) -> Column:
    """Why a text can't be used, first failure first, or null: empty (null too), too_large, too_short, not_printable."""
    stripped = F.regexp_replace(raw, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    strange = F.regexp_count(raw, F.lit(r"[\p{C}&&[^\t-\r\x1c-\x1f\x85]]"))
    return (
        F.when(raw.isNull() | (F.char_length(stripped) == 0), "empty")
        .when(F.octet_length(raw) > max_bytes, "too_large")
        .when(F.char_length(stripped) < min_chars, "too_short")
        .when(1 - strange / F.char_length(raw) < min_printable, "not_printable")
    )


def running(sizes: Column, block: int = 64) -> Column:
    """ARRAY<INT>: for each element of an array of sizes the sum of those before it.

    Arrays can only grow by being copied, so sums run inside blocks of ``block`` elements, and once over the blocks: a
    text of n matches costs n times the block, not n times n.
    """

    def sums(xs: Column, base: Column) -> Column:
        return F.aggregate(xs, F.array(base.cast("int")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def over(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda k: F.slice(xs, k * block + 1, F.lit(block)))
        return let(parts, lambda ps: let(sums(F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)), F.lit(0)), lambda bases: F.flatten(F.transform(ps, lambda p, k: F.slice(sums(p, F.get(bases, k)), F.lit(1), F.size(p))))))

    return let(sizes, lambda xs: F.when(F.size(xs) > 0, over(xs)).otherwise(F.array().cast("array<int>")))


def cut_at(text: Column, pattern: str) -> Column:
    """ARRAY<STRING>: the text cut before and after each match of a pattern; the 2nd, 4th ... piece are the matches, leftmost first and without overlap."""
    return F.split(F.regexp_replace(unmarked(text), f"({pattern})", f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)


def regex_scan(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<quote, start, end>>: every match of a pattern, leftmost first and without overlap.

    The matches are marked by one replacement and cut out by one split, so look-around at a match's edges works. The
    pattern may have groups; re-read them from the quote. Null gives null.
    """

    def matches(pieces: Column) -> Column:
        placed = F.arrays_zip(pieces.alias("quote"), running(F.transform(pieces, F.char_length)).alias("start"))
        odd = F.filter(placed, lambda p, i: i % 2 == 1)
        return F.transform(odd, lambda p: F.struct(p["quote"].alias("quote"), p["start"].alias("start"), (p["start"] + F.char_length(p["quote"])).alias("end")))

    return let(cut_at(text, pattern), lambda pieces: F.when(F.size(pieces) > 1, matches(pieces)).when(pieces.isNotNull(), F.array().cast("array<struct<quote:string,start:int,end:int>>")))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once: expressions inside lists are otherwise evaluated wherever they are named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def locate(flat: Column, quote: Column, window_start: Column, window_end: Column) -> Column:
    """STRUCT<start, end> of a quote's first place wholly inside the window, else of its first place anywhere, else null.

    The quote is collapsed first; its compatibility forms must be composed already (see nfkc), so that this works inside lists.
    """

    def place(needle: Column) -> Column:
        # A first place that doesn't begin before the window is the answer, inside or not; only for others the window is cut out.
        inside = lambda first: let(F.instr(F.substring(flat, window_start + 1, window_end - window_start), needle), lambda i: F.when(i > 0, window_start + i).otherwise(first))
        at = let(F.instr(flat, needle), lambda i: F.when((i == 0) | (i > window_start), i).otherwise(inside(i)))
        return let(at, lambda i: F.when((i > 0) & (needle != ""), F.struct((i - 1).cast("int").alias("start"), (i - 1 + F.char_length(needle)).cast("int").alias("end"))))

    return let(collapse(quote, compose=False), place)


def flat_offset(text: Column, at: Column) -> Column:
    """The place in the squeezed text of place ``at`` of the text. For one place; pages and blocks add up lengths (see running)."""
    flat = F.rtrim(squeeze(text))
    return F.least(F.char_length(squeeze(F.left(text, at))), F.char_length(flat))


def page_at(starts: Column, at: Column) -> Column:
    """The page of a place: starts is ARRAY<STRUCT<start, page>> in order; the last that begins at or before the place."""
    return F.try_element_at(F.filter(starts, lambda p: p["start"] <= at), F.lit(-1))["page"]


def logical_lines(text: Column) -> Column:
    """Lines with wrapping undone: a line beginning with a small letter, ( or [ continues the one before; blank lines go."""
    clean = F.filter(F.transform(lines(text), lambda x: F.trim(squeeze(x))), lambda x: x != "")
    joined = F.array_join(F.transform(clean, lambda x, i: F.when((i > 0) & x.rlike(r"^[a-z(\[]"), F.concat(F.lit(" "), x)).otherwise(F.concat(F.lit(OPEN), x))), "")
    return F.filter(F.split(joined, OPEN, -1), lambda x: x != "")


def slug(text: Column) -> Column:
    """Lower case, other characters than letters and digits to _, 40 characters at most, "item" where nothing is left."""
    name = F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(40))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("item"))


#: An amount of dollars, and a percentage.
MONEY, PERCENT = r"\$\s?(\d[\d,]*(?:\.\d{1,2})?)", r"(\d{1,3}(?:\.\d+)?)\s?%"


def amounts(quote: Column) -> Column:
    """ARRAY<DOUBLE>: the dollar amounts of a quote, and 0.0 where it says that there's no copay."""
    flat = collapse(quote, compose=False)
    found = F.transform(F.regexp_extract_all(flat, F.lit(MONEY), F.lit(1)), lambda m: F.regexp_replace(m, ",", "").cast("double"))
    return F.when(flat.rlike(r"(?i)\bno copay\b"), F.concat(found, F.array(F.lit(0.0)))).otherwise(found)


def percents(quote: Column) -> Column:
    """ARRAY<DOUBLE>: the percentages of a quote."""
    return F.transform(F.regexp_extract_all(collapse(quote, compose=False), F.lit(PERCENT), F.lit(1)), lambda m: m.cast("double"))
