"""Freely typed values to the entries of a reference list (problem 3).

A multi-pattern automaton over the names and aliases finds mentions inside each distinct value in one pass, and the
longest mentions that don't overlap win. Values without a mention go to token-set similarity. Values that name no
entry are reported with -1.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.functions.tables import durable, spread
from docfacts.functions.textfold import plain
from docfacts.operators import skew

#: About as many names are in one automaton; a longer reference list is gone through in blocks by hash.
BLOCK_NAMES = 20_000
#: About as many distinct values are mapped in one group.
GROUP_VALUES = 20_000
#: Least similarity of a value without a mention to the entry it is mapped to.
LEAST_SIMILARITY = 0.65
#: Words that join names, and words that are written round a heading.
JOINING = frozenset("and of the for to in y et und de".split())
AROUND = frozenset("cont continued see note notes sec section class item no p page part misc rev new old benefits benefit coverage".split())
#: Rank of what is no mention.
NO_RANK = (0, 0, 0)
VOWELS = re.compile(r"[aeiou]")


def normal(value: str) -> str:
    """Words in lower case with plain characters: "Sec. 5 Oral_Examinations (cont.)" is "sec 5 oral examinations cont"."""
    text = plain(value).lower().replace("&", " and ")
    return " ".join(re.findall(r"[^\W_]+", text))


def skeleton(word: str) -> str:
    """A word's first letter and the consonants after it."""
    return word[:1] + VOWELS.sub("", word[1:])


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def slack(n: int) -> int:
    """Typing errors allowed in a word of n letters."""
    return 0 if n < 3 else 1 if n < 6 else 2 if n < 9 else 3 if n < 12 else 4


@functools.lru_cache(maxsize=500_000)
def alike(entered: str, word: str) -> float:
    """How well an entered word stands for a word of a name: 1 the same, 0 not at all."""
    if entered == word:
        return 1.0
    if len(entered) >= 3 and word.startswith(entered):
        return 0.92
    if len(entered) >= 2 and len(word) > 3 and entered == skeleton(word):
        return 0.92
    most = slack(len(word))
    if not most or len(set(entered) ^ set(word)) > 2 * most:
        return 0.0
    d = distance(entered, word, most)
    if d > most or (len(word) == 3 and sorted(entered) != sorted(word)):
        return 0.0
    return 1 - d / max(len(word), len(entered))


#: Characters counted apart for the bound on edit distance; all others count together.
COUNTED = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}


def bag(text: str) -> np.ndarray:
    """How often each character stands in a text: two texts' edit distance is at least the larger one-sided difference of their bags."""
    out = np.zeros(len(COUNTED) + 1, np.int16)
    for c in text:
        out[COUNTED.get(c, len(COUNTED))] += 1
    return out


def deletions(word: str, most: int) -> set[str]:
    """The word with up to ``most`` characters left out: two words within that distance have one of them in common."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Words:
    """Index of the names' words: finds all that an entered word may stand for (see alike) without looking at each."""

    def __init__(self, words: Iterable[str]):
        self.sorted = sorted(set(words))
        self.near: dict[str, list[str]] = {}
        self.skeletons: dict[str, list[str]] = {}
        for word in self.sorted:
            self.skeletons.setdefault(skeleton(word), []).append(word)
            for part in deletions(word, slack(len(word))):
                self.near.setdefault(part, []).append(word)
        self.longest_slack = max((slack(len(w)) for w in self.sorted), default=0)
        self.most_letters = max(map(len, self.sorted), default=0)
        self.found: dict[str, dict[str, float]] = {}

    def like(self, entered: str) -> dict[str, float]:
        """Word of a name -> how well the entered word stands for it; only those above 0."""
        got = self.found.get(entered)
        if got is None:
            near = set(self.skeletons.get(entered, ()))
            if len(entered) <= self.most_letters + self.longest_slack:
                for part in deletions(entered, min(self.longest_slack, slack(len(entered) + self.longest_slack))):
                    near.update(self.near.get(part, ()))
            a = bisect_left(self.sorted, entered)
            while a < len(self.sorted) and self.sorted[a].startswith(entered):
                near.add(self.sorted[a])
                a += 1
            got = {w: s for w in near if (s := alike(entered, w))}
            if len(self.found) < 100_000:
                self.found[entered] = got
        return got


class Names:
    """The automaton, the word sets and their index of a block of names."""

    def __init__(self, names: Iterable[tuple[int, str]]):
        import ahocorasick

        self.entries: list[tuple[int, tuple[str, ...], str]] = []
        self.automaton = ahocorasick.Automaton()
        forms: dict[str, tuple[int, int]] = {}
        for term_id, name in names:
            text = normal(name)
            if not text:
                continue
            words = tuple(w for w in text.split() if w not in JOINING) or tuple(text.split())
            self.entries.append((term_id, words, "".join(text.split())))
            for form in {text, text.replace(" ", "")}:
                for key in {form, form + "s", form[:-1] if form.endswith("s") else form}:
                    if len(key) > 2:
                        rank = (0 if key == form else 1, term_id)
                        if key not in forms or rank < forms[key]:
                            forms[key] = rank
        for key, (other, term_id) in forms.items():
            self.automaton.add_word(f" {key} ", (len(key), other, term_id))
        self.automaton.make_automaton()
        self.words = Words(w for _, words, _ in self.entries for w in words)
        self.with_word: dict[str, list[int]] = {}
        for k, (_, words, _) in enumerate(self.entries):
            self.with_word.setdefault(max(words, key=len), []).append(k)  # a name's longest word must be found anyway
        solids = [(joined, k) for k, (_, _, joined) in enumerate(self.entries)] + [(bare, k) for k, (_, words, joined) in enumerate(self.entries) if (bare := "".join(words)) != joined]
        self.solids = sorted(solids, key=lambda x: len(x[0]))
        self.solid_sizes = np.array([len(t) for t, _ in self.solids])
        self.bags = np.array([bag(t) for t, _ in self.solids]) if solids else np.zeros((0, len(COUNTED) + 1), np.int16)

    def _solid_candidates(self, text: str) -> set[int]:
        """Names whose solid text may be within the edit distance that reaches LEAST_SIMILARITY: by length, then by bags for all of them at once."""
        n = len(text)
        low, high = (int(x) for x in np.searchsorted(self.solid_sizes, (n * LEAST_SIMILARITY - 2, n / LEAST_SIMILARITY + 2)))
        if low >= high:
            return set()
        diff = self.bags[low:high] - bag(text)
        bound = np.maximum(np.maximum(diff, 0).sum(1), np.maximum(-diff, 0).sum(1))
        most = np.maximum(1, ((1 - LEAST_SIMILARITY) * np.maximum(self.solid_sizes[low:high], n)).astype(int))
        return {self.solids[low + i][1] for i in np.flatnonzero(bound <= most).tolist()}

    def mention(self, text: str) -> tuple[tuple[int, int, int], int] | None:
        """(rank, entry) of the longest mention; of equally long ones the first. rank: length, and with less for a later place and another form."""
        if not len(self.automaton):
            return None
        spans = [(n, n - end, -other, term_id) for end, (n, other, term_id) in self.automaton.iter(f" {text} ")]
        best = max(spans, key=lambda s: s[:2], default=None)
        return (best[:3], best[3]) if best else None

    def similar(self, text: str) -> tuple[float, int]:
        """(similarity, entry) of the closest name; equal similarity: the smaller id."""
        tokens = text.split()
        words = [w for w in tokens if w not in JOINING and not w.isdigit()]
        core = [w for w in words if len(w) > 1 and w not in AROUND] or words
        solid, best = "".join(tokens), (0.0, -1)
        bare = "".join(core)
        found = {k for e in words for w in self.words.like(e) for k in self.with_word.get(w, ())}
        for k in found | self._solid_candidates(solid) | self._solid_candidates(bare):
            term_id, name, joined = self.entries[k]
            score = max(self._sets(core, words, name), self._solid(solid, joined), self._solid(bare, "".join(name)))
            if score > best[0] or (score == best[0] and term_id < best[1]):
                best = (score, term_id)
        return best

    @staticmethod
    def _sets(core: list[str], words: list[str], name: tuple[str, ...]) -> float:
        if not core:
            return 0.0
        free, total = list(words), 0.0
        for word in sorted(name, key=len, reverse=True):
            found = max(((alike(e, word), -k) for k, e in enumerate(free)), default=(0.0, 0))
            if not found[0]:
                return 0.0
            total += found[0]
            free.pop(-found[1])
        strange = sum(e in core for e in free)
        return total / (len(name) + 1.5 * strange)

    @staticmethod
    def _solid(text: str, name: str) -> float:
        n = max(len(name), len(text))
        if n < 5:
            return 0.0
        most = max(1, int((1 - LEAST_SIMILARITY) * n))
        if len(set(text) ^ set(name)) > 2 * most:
            return 0.0
        d = distance(text, name, most)
        return 1 - d / n if d <= most else 0.0

    def entry(self, value: str, least: float) -> tuple[float, tuple[int, int, int], int]:
        """(score, rank, term) of a value: a mention scores 1 and ranks above a similar name, whose rank is all 0."""
        text = normal(value)
        found = self.mention(text)
        if found is not None:
            return 1.0, *found
        score, term_id = self.similar(text) if text else (0.0, -1)
        return (score, NO_RANK, term_id) if score >= least else (0.0, NO_RANK, -1)


def map_values(values: DataFrame, terms: DataFrame, least: float = LEAST_SIMILARITY, block: int = BLOCK_NAMES, group: int = GROUP_VALUES) -> DataFrame:
    """values (src, entered, ...) -> (src, entered, term_id) for each distinct entered value; -1 if it names no entry.

    terms: term_id, list_name, term, aliases. A value is compared with the names of the list called like its src. Names
    are split into blocks of about ``block`` and values into groups of about ``group`` by hash; each group meets each
    block in a task of its own, so that a task's size is bounded however long the list and however many the values. Of
    several blocks the best score counts, then the longer mention, the earlier one, the form as written, the smaller id:
    the result of one block. Null values are left out.
    """
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    names = terms.where("term_id IS NOT NULL AND list_name IS NOT NULL").select("list_name", "term_id", F.explode(F.concat(F.array("term"), aliases)).alias("name")).where("name IS NOT NULL").distinct()
    distinct = values.where("entered IS NOT NULL").select("src", "entered").distinct()
    least_groups = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks, n_groups = names.count() // block + 1, max(distinct.count() // group + 1, least_groups)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = distinct.withColumn("g", F.pmod(F.xxhash64("src", "entered"), F.lit(n_groups)).cast("int")).withColumn("b", every(n_blocks))
    right = names.withColumn("b", F.pmod(F.xxhash64("list_name", "name"), F.lit(n_blocks)).cast("int")).withColumn("g", every(n_groups))

    def run(pdf: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        lists = {src: Names(zip(own["term_id"], own["name"])) for src, own in part.groupby("list_name")}
        got = [lists[s].entry(v, least) if s in lists else (0.0, NO_RANK, -1) for s, v in zip(pdf["src"], pdf["entered"])]
        ranks = {k: [g[1][i] for g in got] for i, k in enumerate(("length", "place", "form"))}
        return pd.DataFrame({"src": pdf["src"], "entered": pdf["entered"], "score": [g[0] for g in got], **ranks, "term_id": [g[2] for g in got]})

    schema = "src string, entered string, score double, length int, place int, form int, term_id long"
    left, right = spread(left, "g", "b"), spread(right, "g", "b")
    mapped = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(run, schema)
    best = F.max_by("term_id", F.struct("score", "length", "place", "form", -F.col("term_id")))
    return mapped.groupBy("src", "entered").agg(best.alias("term_id")) if n_blocks > 1 else mapped.select("src", "entered", "term_id")


def map_records(records: DataFrame, terms: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """records (src, record_id, entered) -> distinct (src, record_id, entered, term_id).

    Values that are letter for letter a term of their list need no mapping and are left out; those that are an alias stay.
    Nulls are left out; any other value, empty too, is kept and is -1 if it names nothing. Each distinct value is mapped
    once; values that a large share of the records hold are joined back by broadcast (skew.lookup), the others by shuffle.
    """
    exact = terms.select(F.col("list_name").alias("src"), F.col("term").alias("entered")).distinct()
    cases = records.where("entered IS NOT NULL").join(exact, ["src", "entered"], "left_anti").select("src", "record_id", "entered")
    counted = cases.groupBy("src", "entered").agg(F.count(F.lit(1)).alias("n"))
    total = cases.count()
    counted = durable(counted)
    entries = durable(map_values(counted, terms, least).join(counted, ["src", "entered"]).withColumnsRenamed({"src": "s", "entered": "e"}))
    return skew.lookup(cases, {"s": F.col("src"), "e": F.col("entered")}, entries, "term_id", "n", total, F.col("record_id")).select("src", "record_id", "entered", "term_id").distinct()
