"""Evaluation passages inside a training corpus (problem 8).

Template canonicalisation: numbers, names and units become typed placeholders; windows of template words are hashed on
both sides and hash-joined; the slots of matching windows are then compared. Equal slots are a verbatim leak, slots that
differ but correspond one to one are the same question with other parameters.

Workers get two bitmaps of bounded size, of the names and of the items' window hashes. A bitmap may also say yes to a word
or hash that isn't in it; that makes a few more candidates and never another result, because candidates are joined on
the whole hash and compared word by word, and names are looked up in their table.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.functions.tables import durable
from docfacts.llm.forced_bpe import blocks
from docfacts.operators import skew

#: Consecutive words that make a passage; an item of fewer words must stand whole.
WINDOW = 13
#: Bits of a bitmap for each of its members, and the least and most bits of a bitmap (32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 15, 1 << 28
#: Item windows that are broadcast for the join; of more, the join is a shuffle with hot windows salted.
MOST_BROADCAST = 100_000
#: Words that are units.
UNITS = frozenset("day days week weeks month months year years hour hours minute minutes dollar dollars cent cents percent usd km miles mile kg mg ml visit visits times".split())
WORD = re.compile(r"[^\W_]+")
SENTENCE_START = re.compile(r"(?:^|[.!?:;]\s+|\n\s*)[\"'(\[]*([^\W_]+)")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Bitmap:
    """A set of 64-bit hashes of which two bits each are kept: never says no to a member."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash (uint64) may be a member."""
        out = np.ones(len(hashes), bool)
        for shift in (0, 31):
            at = (hashes >> np.uint64(shift)) & self.mask
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def __contains__(self, word: str) -> bool:
        import xxhash

        return bool(self.has(np.array([xxhash.xxh64_intdigest(word)], np.uint64))[0])


def bitmap(hashes: DataFrame, column: str) -> Bitmap:
    """The bitmap of a column of 64-bit hashes, put together of parts of 32,768 bits in Spark; its size follows the count, up to MOST_BITS."""
    n = hashes.count()
    size = min(max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()), MOST_BITS)
    places = hashes.select(F.explode(F.array(*[F.shiftrightunsigned(column, k).bitwiseAND(F.lit(size - 1)) for k in (0, 31)])).alias("at"))
    parts = places.groupBy(F.floor(F.col("at") / 32_768).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32_768).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for part, bits in parts.toLocalIterator():
        out[part * 4096 : (part + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return Bitmap(out)


def slot(word: str, names: Container[str]) -> str | None:
    """The placeholder of a word in lower case, or None if the word stands for itself."""
    if any(c.isdigit() for c in word):
        return "#number"
    if word in UNITS:
        return "#unit"
    return "#name" if word in names else None


class Hashes(dict):
    """Word as written -> 64-bit hash of its template word."""

    def __init__(self, names: Container[str], most: int = 1_000_000):
        super().__init__()
        self.names, self.most = names, most

    def __missing__(self, word: str) -> int:
        import xxhash

        low = word.lower()
        h = xxhash.xxh64_intdigest(slot(low, self.names) or low)
        if len(self) >= self.most:
            self.clear()
        self[word] = h
        return h


def windows(ids: np.ndarray, ends: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, hashes) of all windows of consecutive words that stay within their text; ends: end of each word's text."""
    n = len(ids)
    h = ids.copy()
    for size in range(1, max(sizes, default=0) + 1):
        if size > 1:
            h = h[: n - size + 1] if n >= size else h[:0]
            h = h * FACTOR + ids[size - 1 : n]
        if size in sizes:
            at = np.flatnonzero(np.arange(len(h)) + size <= ends[: len(h)])
            yield size, at, h[at]


def proper_names(items: DataFrame) -> DataFrame:
    """(word, h): words that the items write with a capital inside a sentence and never in lower case, and their hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            rows = []
            for text in pdf["text"].dropna():
                firsts = {m.start(1) for m in SENTENCE_START.finditer(text)}
                for m in WORD.finditer(text):
                    if m.start() not in firsts:
                        word = m.group()
                        rows.append((word.lower(), word[0].isupper() and len(word) > 1 and not word.isupper()))
            words = pd.DataFrame(rows, columns=["word", "upper"]).groupby("word", as_index=False)["upper"].min()
            yield words.assign(h=np.array([xxhash.xxh64_intdigest(w) for w in words["word"]], np.uint64).view(np.int64))

    words = items.select("text").mapInPandas(run, "word string, upper boolean, h bigint")
    return words.groupBy("word", "h").agg(F.min("upper").alias("always")).where("always").select("word", "h")


def item_windows(items: DataFrame, names: Container[str], window: int = WINDOW) -> DataFrame:
    """(item_id, size, h, item_words): the distinct windows of each item, several of one template too; the whole item if it has fewer words; none without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes(names)
        for pdf in batches:
            rows = []
            for item_id, text in zip(pdf["item_id"], pdf["text"]):
                written = WORD.findall(text) if isinstance(text, str) else []
                size = min(window, len(written))
                if not size:
                    continue
                ids = np.array([known[w] for w in written], np.uint64)
                for _, at, h in windows(ids, np.full(len(ids), len(ids)), [size]):
                    rows += [(item_id, size, x, [w.lower() for w in written[a : a + size]]) for a, x in zip(at.tolist(), h.view(np.int64).tolist())]
            yield pd.DataFrame(rows, columns=["item_id", "size", "h", "item_words"])

    return items.select("item_id", "text").where("item_id IS NOT NULL").mapInPandas(run, "item_id bigint, size int, h bigint, item_words array<string>").dropDuplicates(["item_id", "h", "item_words"])


def document_windows(documents: DataFrame, names: Container[str], sizes: list[int], wanted: Bitmap) -> DataFrame:
    """(doc_id, size, h, words): the corpus windows of these sizes whose hash may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes(names)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at_byte = np.concatenate(([0], np.cumsum([len(t) if t else 0 for t in texts])))
            for a, b in blocks(at_byte):
                written: list[str] = []
                lengths = []
                for t in texts[a:b]:
                    found = WORD.findall(t) if t else []
                    written += found
                    lengths.append(len(found))
                if not written:
                    continue
                ids = np.fromiter(map(known.__getitem__, written), np.uint64, len(written))
                stops = np.cumsum(lengths)
                doc = np.repeat(np.arange(a, b), lengths)
                for size, at, h in windows(ids, np.repeat(stops, lengths), sizes):
                    hit = wanted.has(h)
                    at, h = at[hit], h[hit].view(np.int64)
                    if len(at):
                        words = pa.array([[w.lower() for w in written[p : p + size]] for p in at.tolist()], pa.list_(pa.string()))
                        columns = [batch.column(0).take(pa.array(doc[at])), pa.array(np.full(len(at), size, np.int32)), pa.array(h), words]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "h", "words"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, size int, h bigint, words array<string>")


def candidates(documents: DataFrame, items: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(pairs, names): pairs has doc_id, item_id, item_words and words of the windows of equal template; names are those of the items."""
    names = durable(proper_names(items))
    known = bitmap(names, "h")
    iw = durable(item_windows(items, known, window))
    sizes = {r["size"]: r["n"] for r in iw.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    hits = document_windows(documents, known, sorted(sizes), bitmap(iw, "h"))
    if sum(sizes.values()) <= most_broadcast:
        return hits.join(F.broadcast(iw), ["size", "h"]), names
    hits = durable(hits)
    return skew.salted_pairs(iw, hits, ["size", "h"], hits.count(), "doc_id"), names


def reparameterised(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Of pairs of differing windows those in which only numbers, units and names differ, one value always standing for one value."""
    pairs = durable(pairs.where(F.col("item_words") != F.col("words")).select("doc_id", "item_id", "item_words", "words").distinct())
    words = pairs.select("*", F.explode(F.array_distinct(F.concat("item_words", "words"))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(names.select(F.col("word").alias("name")), F.col("word") == F.col("name")).select("name", F.lit(True).alias("named"), "n")
    named = skew.lookup(words, {"name": F.col("word")}, counted, "named", "n", words.count(), F.struct("doc_id", "item_id", "word"))
    known = named.groupBy("doc_id", "item_id", "item_words", "words").agg(F.collect_set(F.when(F.col("named"), F.col("word"))).alias("names"))
    is_slot = lambda w: w.rlike(r"\p{N}") | w.isin(*UNITS) | F.array_contains("names", w)
    slots = F.filter(F.arrays_zip("item_words", "words"), lambda p: is_slot(p["item_words"]))
    values = [F.size(F.array_distinct(x)) for x in (slots, F.transform(slots, lambda p: p["item_words"]), F.transform(slots, lambda p: p["words"]))]
    differ = F.filter(F.arrays_zip("item_words", "words"), lambda p: p["item_words"] != p["words"])
    only_slots = F.forall(differ, lambda p: is_slot(p["item_words"]) & is_slot(p["words"]))
    return known.where((values[0] == values[1]) & (values[0] == values[2]) & only_slots).select("doc_id", "item_id", "item_words")


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, item_id, verbatim BOOLEAN, n_windows BIGINT): every document that holds a passage of an item.

    A passage is ``window`` consecutive words of the item, or the whole of an item with fewer; letter case, punctuation
    and spacing don't count. verbatim: some window has the item's own numbers, names and units; else all matching windows
    differ from it in such slots, one value always standing for one value. n_windows counts the item's distinct windows
    (by their own words) found either way. Null and empty texts hold nothing, items without words are held by nothing; repeated rows change nothing.
    """
    pairs, names = candidates(documents, items, window, most_broadcast)
    pairs = durable(pairs)
    same = pairs.where(F.col("item_words") == F.col("words")).select("doc_id", "item_id", "item_words", F.lit(True).alias("same"))
    both = same.union(reparameterised(pairs, names).withColumn("same", F.lit(False)))
    return both.groupBy("doc_id", "item_id").agg(F.max("same").alias("verbatim"), F.countDistinct("item_words").alias("n_windows"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the verbatim leaks, those with a window of equal template whose slots are equal."""
    pairs, _ = candidates(documents, items)
    return pairs.where(F.col("item_words") == F.col("words")).select("doc_id", "item_id").distinct()
