"""Deeply nested JSON records into linked flat rows (problem 2).

Vectorised structural indexing: for a whole Arrow batch of payloads the quote, bracket and delimiter bitmaps are built
over the bytes at once, the nesting depth is the prefix sum of the brackets outside strings, a node's parent is the
last opener one level up, and its position is the number of delimiters before it under that parent. Values are cut out
by their spans, many at once, as an Arrow array over the same buffer. Neither records nor tokens are walked by a Python
loop; only distinct numbers that aren't written in plain digits are read one by one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from decimal import Decimal, InvalidOperation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.functions.tables import durable

QUOTE, BACKSLASH, COLON, COMMA = 34, 92, 58, 44
OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY = 123, 125, 91, 93
#: Token kinds: a structural byte stands for itself, besides these two.
STRING, SCALAR = 1, 2
SCALAR_FORM = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"
#: Bytes of payload indexed at once.
BLOCK_BYTES = 1_000_000


def _table(chars: bytes, value: int = 1) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = value
    return out


STRUCTURAL, SPACE, ESCAPES = _table(b"{}[]:,").astype(bool), _table(b" \n\r\t").astype(bool), _table(b'"\\/bfnrtu').astype(bool)
HEX = np.full(256, 255, np.uint8)
HEX[list(b"0123456789abcdef")] = range(16)
HEX[list(b"ABCDEF")] = range(10, 16)


def _rows(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each place of the buffer lies in."""
    return np.searchsorted(offsets, at, "right") - 1


class Index:
    """The structure of many JSON texts in one buffer.

    Arrays over the tokens: kind, start and end (bytes), doc, parent (token of the opener, -1 at the root), pos (place
    in a list, or number of the member), key (number of the member's name, -1 without one). ``nodes`` has the tokens
    that are values; ``complete`` says of each text whether it is one complete JSON value. ``names`` has the distinct
    member names. Escapes of unpaired surrogates are read as U+FFFD.
    """

    def __init__(self, raw: bytes, offsets: np.ndarray):
        b = np.frombuffer(raw, np.uint8)
        n, docs = len(b), len(offsets) - 1
        bad = np.zeros(docs, bool)
        slashes = np.flatnonzero(b == BACKSLASH)
        quote = b == QUOTE
        if len(slashes):
            escaped, raw, b = self._escapes(raw, b, slashes, offsets, bad)
            quote[escaped] = False
        self.raw = raw
        begins, stops = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0]
        parity = np.concatenate(([False], np.logical_xor.accumulate(quote)))
        inside = parity[1:] ^ np.repeat(parity[begins], stops - begins)  # opening quote in, closing out
        odd = parity[offsets[1:]] ^ parity[offsets[:-1]]
        text = inside | quote
        structural = STRUCTURAL[b] & ~text
        plain = ~(text | structural | SPACE[b])
        head, tail = plain.copy(), plain.copy()
        head[1:] &= ~plain[:-1]
        tail[:-1] &= ~plain[1:]
        head[begins], tail[stops - 1] = plain[begins], plain[stops - 1]
        opening = quote & inside
        self.start = np.flatnonzero(structural | head | opening)
        self.kind = np.where(opening[self.start], STRING, np.where(head[self.start], SCALAR, b[self.start])).astype(np.uint8)
        first, after_last = np.searchsorted(self.start, offsets[:-1]), np.searchsorted(self.start, offsets[1:])
        self.doc = np.repeat(np.arange(docs), after_last - first)
        m = len(self.start)
        self.end = self.start + 1
        closing = np.flatnonzero(quote & ~inside)
        strings = np.flatnonzero(self.kind == STRING)
        if len(strings):
            where = np.searchsorted(closing, self.start[strings])
            ok = where < len(closing)
            self.end[strings[ok]] = closing[where[ok]] + 1
        scalars = np.flatnonzero(self.kind == SCALAR)
        self.end[scalars] = np.flatnonzero(tail) + 1
        control = np.flatnonzero(b < 32)
        bad[_rows(offsets, control[inside[control]])] = True
        opener = (self.kind == OPEN_OBJECT) | (self.kind == OPEN_ARRAY)
        closer = (self.kind == CLOSE_OBJECT) | (self.kind == CLOSE_ARRAY)
        depth_sum = np.concatenate(([0], np.cumsum(opener.astype(np.int64) - closer)))
        depth = depth_sum[1:] - depth_sum[first[self.doc]] if m else depth_sum[1:]
        level = np.where(opener, depth - 1, np.where(closer, depth + 1, depth))  # number of openers the token stands under
        bad |= odd.astype(bool) | (after_last == first) | (depth_sum[after_last] != depth_sum[first])
        bad[self.doc[(depth < 0) | (closer & (level < 1))]] = True
        # The parent is the last opener before the token whose depth is the token's level: one search over (depth, place).
        tops = np.flatnonzero(opener)
        wide = m + 1
        keys = np.sort(depth[tops] * wide + tops)
        where = np.searchsorted(keys, level * wide + np.arange(m)) - 1
        found = (where >= 0) & (level >= 1)
        found[found] = keys[where[found]] // wide == level[found]
        self.parent = np.full(m, -1, np.int64)
        self.parent[found] = keys[where[found]] % wide
        stray = found & (self.doc[self.parent] != self.doc)
        bad[self.doc[stray | ((level >= 1) & ~found)]] = True
        self._check(bad, opener, closer, first, level)
        if len(scalars):
            forms = self._cut(self.start[scalars], self.end[scalars], pa.binary()).dictionary_encode()
            good = pc.match_substring_regex(forms.dictionary, SCALAR_FORM).to_numpy(zero_copy_only=False)
            bad[self.doc[scalars[~good[forms.indices.to_numpy()]]]] = True
        self.complete = ~bad
        self._link(bad, level)

    @staticmethod
    def _escapes(raw: bytes, b: np.ndarray, slashes: np.ndarray, offsets: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray]:
        """(places of escaped bytes, the buffer with U+FFFD for unpaired surrogates, its array); marks texts with escapes that don't exist."""
        doc = _rows(offsets, slashes)
        heads = np.ones(len(slashes), bool)
        heads[1:] = (np.diff(slashes) > 1) | (doc[1:] != doc[:-1])
        run = slashes[heads][np.cumsum(heads) - 1]
        first = (slashes - run) % 2 == 0
        escaped, doc = slashes[first] + 1, doc[first]
        there = escaped < offsets[1:][doc]
        escaped, doc = escaped[there], doc[there]
        bad[doc[~ESCAPES[b[escaped]]]] = True
        unit = b[escaped] == ord("u")
        units, doc = escaped[unit], doc[unit]
        short = units + 4 >= offsets[1:][doc]
        bad[doc[short]] = True
        units, doc = units[~short], doc[~short]
        digits = np.stack([HEX[b[units + k]] for k in (1, 2, 3, 4)]) if len(units) else np.zeros((4, 0), np.uint8)
        bad[doc[(digits > 15).any(0)]] = True
        top = (digits[0].astype(np.int32) << 8) | (digits[1] << 4) | digits[2]
        high, low = (top & 0xFC0) == 0xD80, (top & 0xFC0) == 0xDC0
        pair = high[:-1] & low[1:] & (np.diff(units) == 6)
        lone = high | low
        lone[:-1] &= ~pair
        lone[1:] &= ~pair
        if lone.any():
            b = b.copy()
            for k, digit in enumerate(b"fffd", 1):
                b[units[lone] + k] = digit
            raw = b.tobytes()
        return escaped, raw, b

    def _check(self, bad: np.ndarray, opener: np.ndarray, closer: np.ndarray, first: np.ndarray, level: np.ndarray) -> None:
        """Marks texts whose neighbouring tokens can't stand side by side, or with more than one value at the root."""
        k, m = self.kind, len(self.kind)
        if not m:
            return
        in_object = np.zeros(m, bool)
        has = self.parent >= 0
        in_object[has] = k[self.parent[has]] == OPEN_OBJECT
        prev = np.concatenate(([0], k[:-1]))
        prev[first[first < m]] = 0  # the first token of a text has none before it
        fresh = prev == 0
        value_end = (prev == STRING) | (prev == SCALAR) | (prev == CLOSE_OBJECT) | (prev == CLOSE_ARRAY)
        value_start = (k == STRING) | (k == SCALAR) | opener
        is_key = (k == STRING) & in_object & ((prev == OPEN_OBJECT) | (prev == COMMA))
        key_before = np.concatenate(([False], is_key[:-1])) & ~fresh
        may_start = fresh | (prev == COLON) | (~in_object & ((prev == COMMA) | (prev == OPEN_ARRAY)))
        ok = np.where(value_start, is_key | (may_start & ~key_before), False)
        ok |= (k == COLON) & key_before
        ok |= (k == COMMA) & value_end & ~key_before & has
        partner = np.zeros(m, np.uint8)
        partner[has] = k[self.parent[has]] + 2  # the closing bracket's code follows the opening one's by two
        ok |= closer & (k == partner) & ((prev == partner - 2) | (value_end & ~key_before))
        bad[self.doc[~ok]] = True
        roots = np.bincount(self.doc[(level == 0) & value_start], minlength=len(bad))
        bad |= roots != 1

    def _link(self, bad: np.ndarray, level: np.ndarray) -> None:
        k, m = self.kind, len(self.kind)
        good = ~bad[self.doc] if m else np.zeros(0, bool)
        prev = np.concatenate(([0], k[:-1])) if m else k
        in_object = np.zeros(m, bool)
        has = self.parent >= 0
        in_object[has] = k[self.parent[has]] == OPEN_OBJECT
        is_key = (k == STRING) & in_object & ((prev == OPEN_OBJECT) | (prev == COMMA))
        value = good & ~is_key & ((k == STRING) | (k == SCALAR) | (k == OPEN_OBJECT) | (k == OPEN_ARRAY))
        # Tokens of one parent stand side by side once they are ordered by level; the closing bracket is the last of them.
        order = np.argsort(level.astype(np.uint16) if level.max(initial=0) < 1 << 16 else level, kind="stable")
        parents = self.parent[order]
        heads = np.ones(m, bool)
        heads[1:] = (parents[1:] != parents[:-1]) | (self.doc[order][1:] != self.doc[order][:-1])
        begins = np.flatnonzero(heads)
        comma = k[order] == COMMA
        commas = np.cumsum(comma)
        base = (commas[begins] - comma[begins])[np.cumsum(heads) - 1] if m else commas
        self.pos = np.zeros(m, np.int64)
        self.pos[order] = commas - base
        self.nodes = np.flatnonzero(value)
        self.is_null = np.zeros(m, bool)
        scalars = self.nodes[k[self.nodes] == SCALAR]
        self.is_null[scalars] = np.frombuffer(self.raw, np.uint8)[self.start[scalars]] == ord("n")
        members = self.nodes[in_object[self.nodes]]
        named = self._strings(members - 2).dictionary_encode()
        self.names: pa.StringArray = named.dictionary
        ids = named.indices.to_numpy().astype(np.int64)
        self.key = np.full(m, -1, np.int64)
        self.key[members] = ids
        pair = self.parent[members] * max(len(self.names), 1) + ids
        _, last = np.unique(pair[::-1], return_index=True)
        if len(last) < len(members):  # of members of one name the last counts, as in JSON readers; what stands under the others goes too
            gone = np.ones(len(members), bool)
            gone[len(members) - 1 - last] = False
            close = np.arange(m)
            ends = order[np.concatenate((begins[1:], [m])) - 1]
            close[parents[begins][parents[begins] >= 0]] = ends[parents[begins] >= 0]
            edge = np.zeros(m + 1, np.int64)
            np.add.at(edge, members[gone], 1)
            np.add.at(edge, close[members[gone]] + 1, -1)
            self.nodes = self.nodes[np.cumsum(edge)[self.nodes] == 0]
        self.alone = self._alone()
        self.under = self.nodes[self.parent[self.nodes] >= 0]
        own = self.nodes[self.key[self.nodes] >= 0]
        keys = self.key[own]
        self.by_key = own[np.argsort(keys.astype(np.uint16) if len(self.names) < 1 << 16 else keys, kind="stable")]
        self.key_ends = np.cumsum(np.bincount(keys, minlength=len(self.names)))
        self.row = np.full(m + 1, -1, np.int64)

    def _alone(self) -> np.ndarray:
        """For each token what it stands for where a single value is usual: itself, of a list of one the element (however deep), of other lists and null -1."""
        m = len(self.kind)
        out = np.arange(m)
        lists = self.kind == OPEN_ARRAY
        below = self.nodes[self.parent[self.nodes] >= 0]
        count = np.bincount(self.parent[below], minlength=m)
        out[lists] = -1
        only = below[lists[self.parent[below]] & (count[self.parent[below]] == 1)]
        out[self.parent[only]] = only
        out[self.is_null] = -1
        while True:  # each round doubles the depth
            nxt = np.where(out >= 0, out[out], -1)
            if (nxt == out).all():
                return out
            out = nxt

    # -- cutting texts out ------------------------------------------------------------------------------------------
    def _cut(self, start: np.ndarray, end: np.ndarray, kind: pa.DataType) -> pa.Array:
        """The spans as one Arrow array: in order and without overlap, they and the gaps between them tile the buffer."""
        if not len(start):
            return pa.array([], kind)
        offs = np.empty(2 * len(start), np.int32)
        offs[0::2], offs[1::2] = start, end
        tiles = pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(self.raw)])
        return tiles.take(pa.array(np.arange(0, len(offs), 2)))

    def _strings(self, at: np.ndarray) -> pa.StringArray:
        """The values of string tokens, given in order: without quotes and escapes."""
        out = self._cut(self.start[at] + 1, self.end[at] - 1, pa.string())
        odd = pc.match_substring(out, "\\") if len(at) else pa.array([], pa.bool_())
        if pc.any(odd).as_py():
            where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            spans = self._cut(self.start[at[where]], self.end[at[where]], pa.binary())
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(spans)], pa.int32()), spans), b",")[0].as_py()
            read = pa.array(json.loads("[" + joined.decode("utf-8", "replace") + "]"), pa.string())
            out = pc.replace_with_mask(out, odd, read)
        return out

    def texts(self, nodes: np.ndarray) -> pa.StringArray:
        """Texts of values, in any order: strings without quotes and escapes, other scalars as written; null for -1, null and containers."""
        there = nodes >= 0
        there[there] = ~(self.is_null[nodes[there]] | np.isin(self.kind[nodes[there]], (OPEN_OBJECT, OPEN_ARRAY)))
        if not there.any():
            return pa.nulls(len(nodes), pa.string())
        uniq, back = np.unique(nodes[there], return_inverse=True)
        strings = self.kind[uniq] == STRING
        found = pa.concat_arrays([self._strings(uniq[strings]), self._cut(self.start[uniq[~strings]], self.end[uniq[~strings]], pa.string())])
        place = np.empty(len(uniq), np.int64)
        place[np.concatenate((np.flatnonzero(strings), np.flatnonzero(~strings)))] = np.arange(len(uniq))
        take = np.zeros(len(nodes), np.int64)
        take[there] = place[back]
        return found.take(pa.array(take, mask=~there))

    # -- moving from nodes to nodes; each returns (row of the given nodes, node) -----------------------------------
    def members(self, at: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Members of a name under the given objects."""
        k = pc.index(self.names, name).as_py() if len(self.names) else -1
        return self._under(at, self.by_key[self.key_ends[k - 1] if k else 0 : self.key_ends[k]] if k >= 0 else self.nodes[:0])

    def children(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All direct children of the given openers, in order."""
        return self._under(at, self.under)

    def _under(self, at: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.row[at] = np.arange(len(at))
        rows = self.row[self.parent[nodes]]
        self.row[at] = -1
        there = rows >= 0
        return rows[there], nodes[there]

    def single(self, at: np.ndarray) -> np.ndarray:
        """A list of one is its element; lists of another length and null become -1."""
        return np.where(at >= 0, self.alone[at], -1) if len(self.alone) else np.full(len(at), -1, np.int64)

    def member(self, at: np.ndarray, name: str) -> np.ndarray:
        """For each node (-1: none) the single value of a member, or -1."""
        out = np.full(len(at), -1, np.int64)
        known = np.flatnonzero(at >= 0)
        uniq, back = np.unique(at[known], return_inverse=True)
        rows, nodes = self.members(uniq, name)
        found = np.full(len(uniq), -1, np.int64)
        found[rows] = nodes
        out[known] = found[back]
        return self.single(out)

    def items(self, at: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, node, pos) of the elements of a member that is usually a list; a value alone is a list of one, and an
        element that is a list of one is its element. Null elements are left out, and keep their place."""
        rows, nodes = self.members(at, name)
        lists = self.kind[nodes] == OPEN_ARRAY
        r, child = self.children(nodes[lists])
        rows = np.concatenate((rows[~lists], rows[lists][r]))
        pos = np.concatenate((np.zeros((~lists).sum(), np.int64), self.pos[child]))
        nodes = self.single(np.concatenate((nodes[~lists], child)))
        keep = nodes >= 0
        return rows[keep], nodes[keep], pos[keep]


def _whole(text: str) -> str | None:
    """A number written as 12, 12.0, 1.2e1, "12" or "1,200" as a whole number in digits; None for anything else.

    Numbers of any length are read; one that no double can hold (1e400) is none, as in JSON readers.
    """
    m = re.fullmatch(r"\s*([+-]?)(\d[\d,]*)(?:\.(0*))?\s*", text)
    if m:
        digits = m[2].replace(",", "").lstrip("0") or "0"
        return ("-" if m[1] == "-" and digits != "0" else "") + digits
    try:
        x = Decimal(text.strip())
    except InvalidOperation:
        return None
    if not x.is_finite() or x.adjusted() > 308:
        return None
    return f"{x:.0f}" if x == x.to_integral_value() else None


def whole_numbers(texts: pa.StringArray) -> pa.StringArray:
    """The whole numbers that texts are (see _whole), else null; those in plain digits stay as they are."""
    plain = pc.match_substring_regex(texts, r"^(?:0|-?[1-9][0-9]*)$")
    odd = texts.filter(pc.invert(pc.fill_null(plain, True))).dictionary_encode()
    if not len(odd):
        return texts
    read = pa.array([_whole(t) for t in odd.dictionary.to_pylist()], pa.string()).take(odd.indices)
    return pc.replace_with_mask(texts, pc.invert(pc.fill_null(plain, True)), read)


def indexes(raw: bytes, offsets: np.ndarray, docs: np.ndarray) -> Iterator[tuple[Index, np.ndarray]]:
    """(index, number of the document of each text): the texts, then the JSON in those that are JSON strings, layer by
    layer. An inner text is shorter than the string it stands in, so the layers end."""
    while len(docs):
        index = Index(raw, offsets)
        yield index, docs
        roots = index.nodes[index.parent[index.nodes] < 0]
        roots = roots[index.kind[roots] == STRING]
        inner = index.texts(roots)
        docs = docs[index.doc[roots]]
        if not len(docs):
            return
        offsets = np.frombuffer(inner.buffers()[1], np.int32)[inner.offset : inner.offset + len(inner) + 1].astype(np.int64)
        raw = inner.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
        offsets = offsets - offsets[0]


def by_batch(df: DataFrame, carry: list[str], payload: str, schema: str, rows_of: Callable[[Index, np.ndarray, int], tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """carry columns and the rows that rows_of makes of each index and layer: (number of the document, columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(carry)).fill_null("").cast(pa.string())
            _, offs, data = column.buffers()
            offsets = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            raw = data.to_pybytes() if data is not None else b""
            a = 0
            while a < len(column):
                e = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, "right")) - 1)
                e = min(e, len(column))
                texts = indexes(raw[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a], np.arange(a, e))
                for layer, (index, docs) in enumerate(texts):
                    which, columns = rows_of(index, docs, layer)
                    if len(which):
                        take = pa.array(which)
                        carried = [batch.column(i).take(take) for i in range(len(carry))]
                        yield pa.RecordBatch.from_arrays([*carried, *columns], names=[*(f"c{i}" for i in range(len(carried))), *(f"v{i}" for i in range(len(columns)))])
                a = e

    types = [df.schema[c].dataType.simpleString() for c in carry]
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [x.split()[1] for x in schema.split(", ")]
    ddl = ", ".join([f"c{i} {t}" for i, t in enumerate(types)] + [f"v{i} {t}" for i, t in enumerate(kinds)])
    out = df.select(*carry, F.col(payload).cast("string")).mapInArrow(run, ddl)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *[F.col(f"v{i}").alias(x) for i, x in enumerate(names)])


def nodes(df: DataFrame, carry: list[str], payload: str) -> DataFrame:
    """Every value of every payload as a row: carry columns, layer, node, parent, name, pos, kind, value.

    node numbers count the values of a text from 0 in the order in which they begin, parent is the node of the enclosing
    object or list (null at the root), name the member's name (null in lists), pos the place under the parent, kind one
    of object, array, string, number, boolean and null. value is a scalar's text: strings without quotes and escapes,
    others as written; null for containers and null. A payload that is not one complete JSON value gives no row, nor
    does null; of members of one name the last counts. A JSON string that holds JSON gives its own row in layer 0 and
    those of the JSON inside in layer 1, and so on.
    """
    kinds = pa.array(["object", "array", "string", "null", "boolean", "number"])

    def rows_of(index: Index, docs: np.ndarray, layer: int) -> tuple[np.ndarray, list[pa.Array]]:
        at = index.nodes
        rank = np.zeros(len(index.kind) + 1, np.int64)
        rank[at] = np.arange(len(at))
        first = np.searchsorted(index.doc[at], index.doc[at])
        parent = index.parent[at]
        key = index.key[at]
        code = np.full(256, 5, np.int8)
        code[[OPEN_OBJECT, OPEN_ARRAY, QUOTE, ord("n"), ord("t"), ord("f")]] = [0, 1, 2, 3, 4, 4]
        byte = np.frombuffer(index.raw, np.uint8)[index.start[at]]
        return docs[index.doc[at]], [
            pa.array(np.full(len(at), layer, np.int32)), pa.array(np.arange(len(at)) - first), pa.array(rank[parent] - first, mask=parent < 0),
            index.names.take(pa.array(key, mask=key < 0)), pa.array(index.pos[at]), kinds.take(pa.array(code[byte])), index.texts(at),
        ]

    return by_batch(df, carry, payload, "layer int, node bigint, parent bigint, name string, pos bigint, kind string, value string", rows_of)


#: Names of a package's own fields; an object under "packages" without any of them maps package ids to packages.
PACKAGE_FIELDS = ("package_id", "ordinal", "name", "premium", "services", "benefit_domains", "exclusions", "cost_share", "benefit_maximum")
KINDS = ("package", "benefit_domain", "premium_start", "service", "service_code", "exclusion")


def package_rows(index: Index, docs: np.ndarray, layer: int = 0) -> tuple[np.ndarray, list[pa.Array]]:
    """The linked rows of extraction results; the kinds and fields are those of linked_rows."""

    def objects(at: np.ndarray) -> np.ndarray:
        at = at[at >= 0]
        return at[index.kind[at] == OPEN_OBJECT]

    roots = objects(index.single(index.nodes[index.parent[index.nodes] < 0]))
    wrapped = index.member(roots, "result")
    roots = objects(np.where((wrapped >= 0) & ~np.isin(np.arange(len(roots)), index.members(roots, "packages")[0]), wrapped, roots))
    _, at = index.members(roots, "packages")
    known = np.zeros(len(at), bool)
    for name in PACKAGE_FIELDS:
        known[index.members(at, name)[0]] = True
    mapped = at[(index.kind[at] == OPEN_OBJECT) & ~known]
    _, named = index.children(mapped)
    _, listed, _ = index.items(roots, "packages")
    listed = objects(listed[~np.isin(listed, mapped)])
    key, named = index.key[named], index.single(named)
    keep = named >= 0
    keep[keep] = index.kind[named[keep]] == OPEN_OBJECT
    packages = np.concatenate((listed, named[keep]))
    labels = pa.concat_arrays([pa.nulls(len(listed), pa.string()), index.names.take(pa.array(key[keep]))])
    ids = pc.coalesce(index.texts(index.member(packages, "package_id")), labels)
    whole = whole_numbers(index.texts(index.member(packages, "ordinal")))
    near = pc.cast(pc.if_else(pc.match_substring_regex(whole, "^-?[0-9]{1,10}$"), whole, None), pa.int64())
    ordinals = pc.cast(pc.if_else(pc.less(pc.abs(near), 1 << 31), near, None), pa.int32())

    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

    def emit(row: np.ndarray, at: np.ndarray, below: np.ndarray, values: pa.Array) -> None:
        there = pc.is_valid(values).to_numpy(zero_copy_only=False)
        parts.append((row[there], at[there], below[there], values.drop_null()))

    every, none = np.arange(len(packages)), np.zeros(len(packages), np.int64)
    emit(every, none, none, ids)
    row, node, at = index.items(packages, "benefit_domains")
    emit(row, at, np.zeros_like(at), index.texts(node))
    start = index.member(index.member(index.member(packages, "premium"), "evidence"), "start")
    emit(every, none, none, whole_numbers(index.texts(start)))
    row, node, at = index.items(packages, "services")
    emit(row, at, np.zeros_like(at), index.texts(index.member(node, "service_id")))
    r, code, below = index.items(node, "codes")
    objects_ = index.kind[code] == OPEN_OBJECT
    inner = np.where(objects_, index.member(np.where(objects_, code, -1), "code"), code)
    emit(row[r], at[r], below, index.texts(inner))
    row, node, at = index.items(packages, "exclusions")
    emit(row, at, np.zeros_like(at), index.texts(index.member(node, "exclusion_id")))

    row, at, below = (np.concatenate([p[i] for p in parts]) for i in range(3))
    kind = np.repeat(np.arange(len(parts), dtype=np.int8), [len(p[0]) for p in parts])
    take = pa.array(row)
    return docs[index.doc[packages[row]]], [
        ordinals.take(take), ids.take(take), pa.array(KINDS).take(pa.array(kind)),
        pa.array(at.astype(np.int32)), pa.array(below.astype(np.int32)), pa.concat_arrays([p[3] for p in parts]),
    ]


def linked_rows(deliveries: DataFrame, run_col: str = "run_id", id_col: str = "delivery_id", time_col: str = "received_at", payload: str = "payload") -> DataFrame:
    """(run, ordinal, package_id, kind, pos, sub_pos, item): packages, domains, premium starts, services, codes, exclusions.

    A value alone where a list is usual is a list of one, a list of one where a value is usual is that value; packages
    may be a list, an object by package id or a single package, in the root or under "result", and the payload may be a
    JSON string that holds the JSON. Missing, null and empty optional fields give no row; null elements give none and keep
    their place. An ordinal outside INT is null; unpaired surrogates are read as U+FFFD. A run delivered again counts once: its latest complete delivery that holds a package (by time, null first, then id). Null,
    empty and incomplete payloads give nothing. Each delivery without a run id is a run of its own. Columns besides the four named
    ones are not read.
    """
    keyed = deliveries.select(F.col(run_col).alias("run"), F.struct(F.col(time_col).alias("t"), F.col(id_col).alias("i")).alias("delivery"), F.col(payload).alias("payload"))
    rows = durable(by_batch(keyed, ["run", "delivery"], "payload", "ordinal int, package_id string, kind string, pos int, sub_pos int, item string", package_rows))
    latest = rows.where("run IS NOT NULL").groupBy("run").agg(F.max("delivery").alias("latest"))
    rows = rows.withColumnRenamed("run", "run_")
    kept = rows.join(latest, (F.col("run_") == F.col("run")) & (F.col("delivery") == F.col("latest")), "left_semi").union(rows.where("run_ IS NULL"))
    return kept.select(F.col("run_").alias(run_col), "ordinal", "package_id", "kind", "pos", "sub_pos", "item").distinct()
