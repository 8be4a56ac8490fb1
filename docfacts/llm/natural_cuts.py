"""Documents cut into pieces under a token limit, at natural boundaries and with an overlap (problem 9).

Agglomerative merging: a text begins as atomic segments; adjacent segments stand in a heap ordered by the strength of
the boundary between them, and the weakest boundaries are merged away first while both sides and the overlap fit.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docfacts.llm.forced_bpe import VOCABULARY, Encoder, blocks, encoder, text_buffer

#: Tokens of a piece, and of its overlap with the piece before.
LIMIT, OVERLAP = 512, 64
#: Strength of a boundary: inside a word, between words, between lines, sentences, paragraphs, sections.
CHARACTER, WORD, LINE, SENTENCE, PARAGRAPH, SECTION = range(6)
STRENGTH_NAMES = ("character", "word", "line", "sentence", "paragraph", "section")
#: White space in UTF-8, and its runs.
SPACE = rb"(?:[\t-\r\x1c- ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
SPACES = re.compile(SPACE + rb"+")
#: What marks a boundary, in UTF-8; the cut lies after the match of SENTENCE_END, and before that of BREAK.
SENTENCE_END = re.compile("[.!?]+(?:[\"')\\]]|”|’|»)*(?=".encode() + SPACE + ")|…|(?:。|！|？|；)(?:”|’|」|』|）)*".encode())
BREAK = re.compile(rb"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))*[ \t]*")
HEADING = re.compile(rb"(?:#{1,6}\s|\d{1,4}\s+\d{4}\s|(?:chapter|section|part|article|optional package)\s+\w+|Q:)", re.IGNORECASE)


def boundaries(raw: bytes) -> dict[int, int]:
    """Byte -> strength of the ends of lines, sentences, paragraphs and sections inside a text; the cut lies before the white space."""
    out = {m.end(): SENTENCE for m in SENTENCE_END.finditer(raw)}
    for m in BREAK.finditer(raw):
        found = m.group()
        lines = found.count(b"\n") + found.count(b"\r") - found.count(b"\r\n")
        at = m.start()
        while at and raw[at - 1] in b" \t":
            at -= 1
        if lines > 2 or (lines > 1 and HEADING.match(raw, m.end())):
            out[at] = SECTION
        else:
            out[at] = max(PARAGRAPH if lines > 1 else LINE, out.get(at, 0))
    out.pop(0, None)
    out.pop(len(raw), None)
    return out


def merge(sizes: list[int], strengths: list[int], limit: int, overlap: int) -> list[int]:
    """Numbers of the segments that begin a piece: sizes of the segments, strengths of the boundaries between neighbours.

    Weakest boundary first, of equally weak ones the smaller union, then the earlier. A union must fit the limit together
    with an overlap, unless it begins the text.
    """
    n = len(sizes)
    size, right, left, alive = list(sizes), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strengths[i], size[i] + size[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, both, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or right[a] != b or both != size[a] + size[b]:
            continue
        if both + (overlap if a else 0) > limit:
            continue
        size[a], alive[b], right[a] = both, False, right[b]
        if right[a] < n:
            left[right[a]] = a
            heapq.heappush(heap, (strengths[right[a] - 1], size[a] + size[right[a]], a, right[a]))
        if left[a] >= 0:
            heapq.heappush(heap, (strengths[a - 1], size[left[a]] + size[a], left[a], a))
    return [i for i in range(n) if alive[i]]


class Cutter:
    """Cuts one text, given as UTF-8 with its certain cuts (edges) and the number of tokens before each of them.

    Tokens of any span are exact: those between two certain cuts are a difference, and what is left at either end is
    encoded by itself, because a certain cut is one in every part of the text too.
    """

    def __init__(self, enc: Encoder, raw: bytes, edges: list[int], before: list[int], limit: int, overlap: int):
        self.cache, self.raw, self.edges, self.before, self.limit, self.overlap = enc.cache, raw, edges, before, limit, overlap

    def tokens(self, a: int, b: int) -> int:
        i, j = bisect_left(self.edges, a), bisect_right(self.edges, b) - 1
        if i > j:
            return len(self.cache[self.raw[a:b]]) // 4 if b > a else 0
        n = self.before[j] - self.before[i]
        if self.edges[i] > a:
            n += len(self.cache[self.raw[a : self.edges[i]]]) // 4
        if b > self.edges[j]:
            n += len(self.cache[self.raw[self.edges[j] : b]]) // 4
        return n

    def atoms(self, core: int) -> dict[int, int]:
        """Byte -> strength of the boundaries of the atomic segments: sentences; inside one of more than ``core`` tokens its
        lines and words; inside such a word its certain cuts, and where these are too far apart its characters."""
        marks = boundaries(self.raw)
        stops = [0, *sorted(p for p, s in marks.items() if s >= SENTENCE), len(self.raw)]
        out = {p: marks[p] for p in stops[1:-1]}
        for a, b in zip(stops, stops[1:]):
            if self.tokens(a, b) <= core:
                continue
            words = {m.start(): WORD for m in SPACES.finditer(self.raw, a, b) if a < m.start()}
            words |= {p: marks[p] for p in words if p in marks}
            out |= words
            inner = [a, *sorted(words), b]
            for x, y in zip(inner, inner[1:]):
                if self.tokens(x, y) <= core:
                    continue
                places = [x, *self.edges[bisect_right(self.edges, x) : bisect_left(self.edges, y)], y]
                for p, q in zip(places, places[1:]):
                    if p > x:
                        out[p] = CHARACTER
                    if self.tokens(p, q) > core:
                        chars = [k for k in range(p + 1, q) if self.raw[k] & 0xC0 != 0x80]
                        step = max(1, min(16, core // 4))  # a character has four tokens at most
                        out |= dict.fromkeys(chars[step - 1 :: step], CHARACTER)
        return out

    def overlap_start(self, low: int, end: int) -> int:
        """Start of the longest run of whole words (characters, where there are no words) before ``end`` that fits the overlap, not before ``low``."""
        if not self.overlap:
            return end
        begin, width = end, 6 * self.overlap
        while True:  # look back until a word too many is seen
            begin = max(low, end - width)
            starts = [m.end() for m in SPACES.finditer(self.raw, begin, end) if m.end() < end]
            if begin == low and low < end and not SPACES.match(self.raw, low, end):
                starts.insert(0, low)
            if begin == low or (starts and self.tokens(starts[0], end) > self.overlap):
                break
            width *= 2
        a, b = 0, len(starts)
        while a < b:  # more words never have fewer tokens
            mid = (a + b) // 2
            if self.tokens(starts[mid], end) <= self.overlap:
                b = mid
            else:
                a = mid + 1
        if a < len(starts):
            return starts[a]
        at = fits = end
        while at > low:  # no whole word fits: characters
            at -= 1
            if self.raw[at] & 0xC0 != 0x80:
                if self.tokens(at, end) > self.overlap:
                    break
                fits = at
        return fits

    def pieces(self) -> list[tuple[int, int, int, int, int]]:
        """(start, core start, end, tokens, strength of the boundary at the end) of each piece, in bytes; a text within the limit is one piece."""
        n = len(self.raw)
        if self.before[-1] - self.before[0] <= self.limit:
            return [(0, 0, n, self.before[-1] - self.before[0], SECTION)]
        limit = self.limit
        while True:
            best = self.atoms(limit - self.overlap)
            starts = [0, *sorted(best)]
            sizes = [self.tokens(a, b) for a, b in zip(starts, [*starts[1:], n])]
            heads = [starts[i] for i in merge(sizes, [best[p] for p in starts[1:]], limit, self.overlap)]
            out: list[tuple[int, int, int, int, int]] = []
            over = 0
            for at, end in zip(heads, [*heads[1:], n]):
                start = self.overlap_start(out[-1][0], at) if out else 0
                size = self.tokens(start, end)
                over = max(over, size - self.limit)
                out.append((start, at, end, size, best.get(end, SECTION)))
            if over <= 0 or limit - over <= self.overlap:
                return out
            limit -= over  # unions over cuts that aren't certain may have a few tokens more than their parts: leave that much room and cut again


def cut(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece INT, start, core_start, end INT, n_tokens INT, boundary STRING, text STRING): each document in pieces.

    Pieces are numbered from 0; each is text[start:end] (characters) and has at most ``limit`` tokens. The cores
    [core_start, end) tile the text; [start, core_start) repeats the end of the piece before: as many whole words as fit
    in ``overlap`` tokens, characters where there are no words, however far back they begin. boundary tells what the piece ends at. A document within
    the limit is one piece; null and empty texts are one empty piece. Repeated rows come out repeatedly; other columns
    are not read. No shuffle. Only where the limit is less than one character's tokens, pieces are longer.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in blocks(offsets):
                _, edges, before, first = enc.split(data, offsets[a : b + 1])
                rows: list[tuple] = []
                doc: list[int] = []
                totals = np.diff(before[first]).tolist()
                raw_block = data[offsets[a] : offsets[b]].tobytes()
                heads = (np.frombuffer(raw_block, np.uint8) & 0xC0) != 0x80
                for k in range(a, b):
                    lo, hi = int(offsets[k] - offsets[a]), int(offsets[k + 1] - offsets[a])
                    raw = raw_block[lo:hi]
                    if totals[k - a] <= limit:
                        doc.append(k)
                        n_chars = int(np.count_nonzero(heads[lo:hi]))
                        rows.append((0, 0, 0, n_chars, totals[k - a], "end", raw))
                        continue
                    i, j = first[k - a], first[k - a + 1] + 1
                    cutter = Cutter(enc, raw, (edges[i:j] - edges[i]).tolist(), before[i:j].tolist(), limit, overlap)
                    chars = None if raw.isascii() else np.concatenate((np.flatnonzero(heads[lo:hi]), [hi - lo]))
                    for number, (start, at, end, n, strength) in enumerate(cutter.pieces()):
                        places = (start, at, end) if chars is None else np.searchsorted(chars, (start, at, end)).tolist()
                        doc.append(k)
                        rows.append((number, *places, n, STRENGTH_NAMES[strength] if end < len(raw) else "end", raw[start:end]))
                columns = list(zip(*rows))
                kinds = [pa.int32()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "piece", "start", "core_start", "end", "n_tokens", "boundary", "text"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start int, core_start int, end int, n_tokens int, boundary string, text string")
