"""Byte-level BPE of a whole corpus by forced-boundary splitting (problem 7).

A pair of bytes that occurs inside no token of the vocabulary can never be merged over, so the text may be cut
between the two without changing its ids. The cuts are found for a whole Arrow batch at once with a 256 x 256 table
over the text's bytes; each distinct fragment is encoded once per worker, and the ids are put together again.

The pre-tokeniser's pattern looks at whole runs, so three further conditions make a cut safe: no cut after white
space (a run of white space depends on what follows it), none before an apostrophe (it may begin a contraction), and
none inside a character.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabulary lies on every machine; a parameter of each operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments kept by a worker, and the longest that is kept, in bytes.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 48
#: Bytes of text handled at once inside a batch.
BLOCK_BYTES = 4_000_000
#: Last UTF-8 bytes of the white space outside ASCII. No cut is made after any character that ends like these.
WIDE_SPACE_ENDS = sorted({chr(c).encode()[-1] for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)})


class Fragments(dict):
    """Fragment (bytes) -> ids as the bytes of int32, filled as fragments come."""

    def __init__(self, encoder: "Encoder"):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, fragment: bytes) -> bytes:
        ids = np.asarray(self.encoder.bpe.encode_ordinary(fragment.decode("utf-8")), np.int32).tobytes()
        if len(fragment) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[fragment] = ids
        return ids


class Encoder:
    """Encodes texts of one vocabulary; made once in each Python worker."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("forced", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forced = np.ones((256, 256), bool)
        for token in ranks:
            self.forced[list(token[:-1]), list(token[1:])] = False
        self.forced[:, 0x80:0xC0] = False  # inside a character
        self.forced[:, ord("'")] = False
        self.forced[[*range(9, 14), *range(28, 33), *WIDE_SPACE_ENDS], :] = False
        self.forced = self.forced.ravel()
        self.cache = Fragments(self)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions p of the UTF-8 bytes such that a cut between p - 1 and p is certain."""
        if len(data) < 2:
            return np.empty(0, np.int64)
        pair = data[:-1].astype(np.uint16) * np.uint16(256) + data[1:]
        return np.flatnonzero(self.forced[pair]) + 1

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(ids of each fragment, the fragments' edges, number of ids before each edge, number of each text's first edge)."""
        base = offsets[0]
        data, offsets = data[base : offsets[-1]], offsets.astype(np.int64) - base
        edge = np.zeros(len(data) + 1, bool)
        edge[self.cuts(data)] = edge[offsets] = True
        edges = np.flatnonzero(edge)
        raw = data.tobytes()
        fragments = [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        found = list(map(self.cache.__getitem__, fragments))
        before = np.zeros(len(edges), np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, out=before[1:])
        return found, edges, before, np.searchsorted(edges, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[offsets[i]:offsets[i + 1]], one after the other, and where each text's ids begin."""
        found, _, before, first = self.split(data, offsets)
        return np.frombuffer(b"".join(found), np.int32), before[first]

    def count(self, text: str) -> int:
        """Number of ids of one text."""
        raw = text.encode("utf-8")
        edges = [0, *self.cuts(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
        return sum(len(self.cache[raw[a:b]]) for a, b in zip(edges, edges[1:]) if b > a) // 4


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's own encoder of a vocabulary."""
    return Encoder(path)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = column.fill_null("").cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text each; at least one row in each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def encode_column(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, ids ARRAY<INT>): the token ids of each document's whole text, without special tokens.

    Null and empty texts get an empty list; strings that look like special tokens are ordinary text. Repeated rows
    stay repeated; other columns are not read. No shuffle: every row is encoded where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in blocks(offsets):
                ids, starts = enc.encode(data, offsets[a : b + 1])
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    out = documents.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)
