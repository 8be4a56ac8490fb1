"""SQL with the results of the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

import unicodedata

#: Letters, digits and combining marks in lower case.
_CANON = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"

_TUPLES = f"""
WITH t AS (
  SELECT row_id, guide_id, least(a, b) AS lo, greatest(a, b) AS hi
  FROM (SELECT row_id, guide_id, {_CANON.format("dental_code")} AS a, {_CANON.format("description")} AS b FROM benefit_rows WHERE dental_code IS NOT NULL AND description IS NOT NULL)
)"""

_PLAIN: dict[str, str] = {
    "p1_found": _TUPLES + """
SELECT DISTINCT keep_id, row_id AS copy_id FROM (SELECT row_id, min(row_id) OVER (PARTITION BY guide_id, lo, hi) AS keep_id FROM t) WHERE row_id <> keep_id""",
    "p1_lines": _TUPLES + """
SELECT guide_id, min(row_id) AS keep_id, count(*) AS n_copies FROM t GROUP BY guide_id, lo, hi""",
    "p8_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, hash(array_to_string(w[k : k + least(13, len(w)) - 1], ' ')) AS h
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, hash(array_to_string(w[k : k + n - 1], ' ')) AS h
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (n, h)""",
    "p8_leaks": r"""
WITH s AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '(^|[.!?:;]\s+|\n\s*)(["''(\[]*)([\p{L}\p{N}]+)', '\1\2' || chr(1) || '\3', 'g'), '\x01?[\p{L}\p{N}]+')) AS w FROM eval_items WHERE text IS NOT NULL),
names AS (SELECT list(word) AS words FROM (SELECT lower(w) AS word FROM s WHERE NOT starts_with(w, chr(1)) GROUP BY 1 HAVING bool_and(regexp_matches(w, '^\p{Lu}') AND length(w) > 1 AND w <> upper(w)))),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
units AS (SELECT [{UNITS}] AS us),
words AS (SELECT DISTINCT unnest(w) AS x FROM d UNION SELECT unnest(w) FROM i),
plain AS (SELECT map_from_entries(list((x, p))) AS m FROM (SELECT x, CASE WHEN regexp_matches(x, '\p{N}') THEN '#number' WHEN list_contains(us, x) THEN '#unit' ELSE '#name' END AS p FROM words, names, units
  WHERE regexp_matches(x, '\p{N}') OR list_contains(us, x) OR list_contains(names.words, x))),
it AS (SELECT item_id, w, list_transform(w, lambda x: coalesce(m[x], x)) AS t FROM i, plain),
iw AS (SELECT DISTINCT item_id, n, hash(array_to_string(t[k : k + n - 1], ' ')) AS h, w[k : k + n - 1] AS a FROM (SELECT *, least(13, len(w)) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS k FROM it WHERE len(w) > 0)),
dt AS (SELECT doc_id, w, list_transform(w, lambda x: coalesce(m[x], x)) AS t FROM d, plain),
dw AS (SELECT doc_id, n, hash(array_to_string(t[k : k + n - 1], ' ')) AS h, w[k : k + n - 1] AS b FROM (SELECT doc_id, w, t, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM dt, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
j AS (SELECT doc_id, item_id, a, b, list_filter(list_zip(a, b), lambda p: m[p[1]] IS NOT NULL) AS slots FROM dw JOIN iw USING (n, h), plain)
SELECT doc_id, item_id, bool_or(a = b) AS verbatim, count(DISTINCT a) AS n_windows FROM j
WHERE a = b OR (len(list_distinct(slots)) = len(list_distinct(list_transform(slots, lambda p: p[1]))) AND len(list_distinct(slots)) = len(list_distinct(list_transform(slots, lambda p: p[2])))) GROUP BY doc_id, item_id""".replace(
        "{UNITS}", ", ".join(f"'{u}'" for u in "day days week weeks month months year years hour hours minute minutes dollar dollars cent cents percent usd km miles mile kg mg ml visit visits times".split())
    ),
}


#: Fixed values, apart from the operator's table: by alphabet, ends of the names of letters that look like a Latin letter.
_NAMED = {
    "CYRILLIC CAPITAL LETTER ": "A:A BYELORUSSIAN-UKRAINIAN_I:I DZE:S EM:M EN:H ER:P ES:C HA:X IE:E JE:J KA:K O:O TE:T U:Y VE:B STRAIGHT_U:Y KOMI_SJE:G QA:Q WE:W IZHITSA:V KOMI_DE:D",
    "CYRILLIC SMALL LETTER ": "A:a BYELORUSSIAN-UKRAINIAN_I:i DZE:s ER:p ES:c HA:x IE:e JE:j O:o U:y SHHA:h KOMI_DE:d QA:q WE:w PALOCHKA:l IZHITSA:v OMEGA:w STRAIGHT_U:y ABKHASIAN_CHE:e",
    "GREEK CAPITAL LETTER ": "ALPHA:A BETA:B EPSILON:E ZETA:Z ETA:H IOTA:I KAPPA:K MU:M NU:N OMICRON:O RHO:P TAU:T UPSILON:Y CHI:X YOT:J",
    "GREEK SMALL LETTER ": "ALPHA:a GAMMA:y IOTA:i OMICRON:o RHO:p UPSILON:u NU:v",
    "LATIN SMALL LETTER ": "ALPHA:a SCRIPT_G:g IOTA:i",
    "LATIN LETTER SMALL CAPITAL ": "C:c O:o U:u V:v W:w Z:z S:s",
}


def _letters() -> dict[str, str]:
    out = {unicodedata.lookup(head + part.split(":")[0].replace("_", " ")): part.split(":")[1] for head, parts in _NAMED.items() for part in parts.split()}
    out["\u042c"], out["\u04c0"], out["\u03f3"], out["\u03f2"] = "b", "I", "j", "c"
    return out


def _form(text: str) -> str:
    """SQL of the one form of a text, from Unicode's properties: characters that become one other, or nothing, by translate; Latin ligatures by replace; composition by DuckDB."""
    letters, single, gone, longer = _letters(), [], [], []
    for c in range(0x20000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if 0xD800 <= c < 0xE000 or kind in ("Cn", "Co", "Cs"):
            continue
        plain = lambda t: "".join(letters.get(x, " " if unicodedata.category(x) == "Zs" else "" if unicodedata.category(x) == "Cf" else x) for x in t)
        form = plain(unicodedata.normalize("NFKC", plain(unicodedata.normalize("NFKC", ch)) if ch not in letters else letters[ch]))
        if 0xFE00 <= c <= 0xFE0F or c == 0x34F:
            form = ""
        elif ch in "\u2010\u2011\u2043\u02d7":
            form = "-"
        if form == ch or "'" in (ch, form):
            continue
        if not form:
            gone.append(ch)
        elif len(form) == 1:
            single.append((ch, form))
        elif 0xFB00 <= c <= 0xFB06:
            longer.append((ch, form))
    out = f"translate({text}, '{''.join(a for a, _ in single)}{''.join(gone)}', '{''.join(b for _, b in single)}')"
    for a, b in longer:
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize({out})"


def _looks() -> dict[str, str]:
    texts = """t AS (SELECT 'description' AS src, CAST(guide_id AS VARCHAR) AS grp, row_id AS id, description AS text FROM benefit_rows
  UNION ALL SELECT 'quote', plan_key, premium_id, evidence_quote FROM premium_fields)"""
    forms = f"f AS (SELECT src, grp, id, text, {_form('text')} AS form FROM t WHERE text IS NOT NULL)"
    return {
        "p6_found": f"WITH {texts}, {forms} SELECT DISTINCT a.src, a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.src = b.src AND a.grp = b.grp AND a.form = b.form AND a.id < b.id AND a.text <> b.text WHERE a.form <> ''",
        "p6_classes": f"""WITH {texts}, {forms}, g AS (SELECT src, grp, form, min(id) AS class_id, count(DISTINCT text) AS n_texts FROM f WHERE form <> '' AND grp IS NOT NULL GROUP BY ALL)
SELECT DISTINCT src, id, class_id, n_texts FROM f JOIN g USING (src, grp, form) WHERE n_texts > 1""",
        "p6_forms": f"WITH {texts}, {forms} SELECT src, id, form FROM f UNION ALL SELECT src, id, NULL FROM t WHERE text IS NULL",
    }


def __getattr__(name: str) -> dict[str, str]:
    """SQL, made when it is asked for: the tables of characters take a second."""
    if name == "SQL":
        return _PLAIN | _looks()
    raise AttributeError(name)
