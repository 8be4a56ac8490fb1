"""Bringing differently encoded characters to plain ones: an Arrow UDF that ASCII rows never reach."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: By alphabet, letters with the shape of Latin ones, and those Latin letters.
LOOKALIKE = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХЬҮԌԚԜѴԀӀаеѕіјорсухһԁԛԝӏѵѡүҽ", "ABESIJKMHOPCTYXbYGQWVdIaesijopcyxhdqwlvwye"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺͿϜαγιορυϲϳν", "ABEZHIKMNOPTYXCMJFayiopucjv"),
    "Armenian": ("ՍՏՕԼսհոռցզգյօ", "USOLuhnngqqjo"),
    "Coptic": ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "BHIKMNOPCTYXopc"),
    "Cherokee": ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWMHYGhZbRWSVSLCPKdGB"),
    "Lisu": ("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"),
    "Canadian syllabics": ("ᐯᑌᑭᑯᑕᒍᒪᕼᖇᖴᗅᗪᗰᗷ᙭", "VUPdCJLHRFADMBX"),
    "Latin extensions": ("ɑɡɩᴄᴏᴜᴠᴡᴢꜱ", "agicouvwzs"),
}
#: Hyphens that look like the plain one.
HYPHENS = "‐‑⁃˗᠆"
#: Characters that show nothing though their category isn't format (fillers, joiners, variation selectors).
UNSEEN = "͏ᅟᅠ឴឵⠀ㅤﾠ" + "".join(map(chr, (*range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))))


@functools.lru_cache(maxsize=1)
def shape_map() -> dict[int, str]:
    """Code point -> what it looks like, for look-alike letters, hyphens, spaces and invisible characters."""
    letters = {ord(a): b for pair in LOOKALIKE.values() for a, b in zip(*pair, strict=True)}
    out = letters | {ord(c): "-" for c in HYPHENS} | {ord(c): "" for c in UNSEEN}
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind == "Zs":
            out[c] = " "
        elif kind == "Cf":
            out[c] = ""
    return out


def plain(text: str) -> str:
    """The text with widths and styles, look-alike letters, spaces and hyphens brought to the plain characters."""
    shapes = shape_map()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKD", text.translate(shapes)).translate(shapes))


@F.pandas_udf(T.StringType())
def _plain(texts: pd.Series) -> pd.Series:
    return texts.map(plain, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def _odd(text: Column) -> Column:
    """Null for ASCII text: a UDF sees every row whatever ``when`` it stands in, so the guard is on its argument."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), text)


def plain_text(text: Column) -> Column:
    """plain() of a column; null stays null."""
    return F.coalesce(_plain(_odd(text)), text)


def nfkc(text: Column) -> Column:
    """Compatibility composition of a column; null stays null."""
    return F.coalesce(_nfkc(_odd(text)), text)
