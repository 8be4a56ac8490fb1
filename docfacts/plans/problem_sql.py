"""SQL with the results of the queries of problems 2, 4 and 5."""

from __future__ import annotations


def _one(x: str) -> str:
    """A list of one is its element; another list is nothing."""
    return f"CASE WHEN json_type({x}) = 'ARRAY' THEN CASE WHEN json_array_length({x}) = 1 THEN json_extract({x}, '$[0]') END WHEN json_type({x}) <> 'NULL' THEN {x} END"


def _many(x: str) -> str:
    """A value alone is a list of one."""
    return f"CASE WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN [] ELSE [{x}] END"


_OWN = "['package_id', 'ordinal', 'name', 'premium', 'services', 'benefit_domains', 'exclusions', 'cost_share', 'benefit_maximum']"

P2 = f"""
WITH raw AS (SELECT run_id, received_at, delivery_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM service_output),
one AS (SELECT run_id, received_at, delivery_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END ELSE j END AS j FROM raw WHERE j IS NOT NULL),
root AS (SELECT run_id, received_at, delivery_id, CASE WHEN json_exists(j, '$.packages') THEN j -> '$.packages' ELSE j -> '$.result.packages' END AS ps FROM one WHERE json_type(j) = 'OBJECT'),
pk AS (
  SELECT run_id, received_at, delivery_id, unnest(json_extract(ps, '$[*]')) AS p, NULL AS k FROM root WHERE json_type(ps) = 'ARRAY'
  UNION ALL SELECT run_id, received_at, delivery_id, ps, NULL FROM root WHERE json_type(ps) = 'OBJECT' AND list_has_any(json_keys(ps), {_OWN})
  UNION ALL SELECT run_id, received_at, delivery_id, json_extract(ps, '$."' || k || '"'), k FROM (SELECT *, unnest(json_keys(ps)) AS k FROM root WHERE json_type(ps) = 'OBJECT' AND NOT list_has_any(json_keys(ps), {_OWN}))),
pkg AS (SELECT run_id, received_at, delivery_id, p, TRY_CAST(TRY_CAST({_one("(p -> '$.ordinal')")} ->> '$' AS DOUBLE) AS INT) AS ordinal, coalesce({_one("(p -> '$.package_id')")} ->> '$', k) AS package_id FROM pk WHERE json_type(p) = 'OBJECT'),
prem AS (SELECT *, {_one("(p -> '$.premium')")} AS pr FROM pkg), ev AS (SELECT *, {_one("(pr -> '$.evidence')")} AS e FROM prem), st AS (SELECT *, {_one("(e -> '$.start')")} AS s FROM ev),
sv AS (SELECT run_id, received_at, delivery_id, ordinal, package_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS x FROM (SELECT *, {_many("(p -> '$.services')")} AS l FROM pkg)),
sc AS (SELECT run_id, received_at, delivery_id, ordinal, package_id, pos, unnest(generate_series(0, len(l) - 1)) AS sub, unnest(l) AS x FROM (SELECT *, {_many("(x -> '$.codes')")} AS l FROM sv)),
al AS (
  SELECT run_id, received_at, delivery_id, ordinal, package_id, 'package' AS kind, 0 AS pos, 0 AS sub_pos, package_id AS item FROM pkg
  UNION ALL SELECT run_id, received_at, delivery_id, ordinal, package_id, 'benefit_domain', unnest(generate_series(0, len(l) - 1)), 0, unnest(l) ->> '$' FROM (SELECT *, {_many("(p -> '$.benefit_domains')")} AS l FROM pkg)
  UNION ALL SELECT run_id, received_at, delivery_id, ordinal, package_id, 'premium_start', 0, 0, CAST(TRY_CAST(TRY_CAST(s ->> '$' AS DOUBLE) AS BIGINT) AS VARCHAR) FROM st
  UNION ALL SELECT run_id, received_at, delivery_id, ordinal, package_id, 'service', pos, 0, x ->> '$.service_id' FROM sv
  UNION ALL SELECT run_id, received_at, delivery_id, ordinal, package_id, 'service_code', pos, sub, CASE WHEN json_type(x) = 'OBJECT' THEN x ->> '$.code' ELSE x ->> '$' END FROM sc
  UNION ALL SELECT run_id, received_at, delivery_id, ordinal, package_id, 'exclusion', unnest(generate_series(0, len(l) - 1)), 0, unnest(l) ->> '$.exclusion_id' FROM (SELECT *, {_many("(p -> '$.exclusions')")} AS l FROM pkg)),
newest AS (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY received_at DESC NULLS LAST, delivery_id DESC) AS r FROM al WHERE item IS NOT NULL)
SELECT DISTINCT run_id, ordinal, package_id, kind, CAST(pos AS INT) AS pos, CAST(sub_pos AS INT) AS sub_pos, item FROM newest WHERE r = 1"""

P2_NODES = """
WITH raw AS (SELECT delivery_id, payload::JSON AS j FROM service_output WHERE payload IS NOT NULL AND json_valid(payload)),
text AS (
  SELECT delivery_id, 0 AS layer, j FROM raw
  UNION ALL SELECT delivery_id, 1, (j ->> '$')::JSON FROM raw WHERE json_type(j) = 'VARCHAR' AND json_valid(j ->> '$')),
t AS (SELECT delivery_id, layer, x.id, x.parent AS up, x.key, x.type, x.value FROM text, json_tree(text.j) x),
n AS (SELECT *, row_number() OVER (PARTITION BY delivery_id, layer ORDER BY id) - 1 AS node, row_number() OVER (PARTITION BY delivery_id, layer, up ORDER BY id) - 1 AS pos FROM t)
SELECT n.delivery_id, n.layer, n.node, p.node AS parent, CASE WHEN p.type = 'OBJECT' THEN n.key END AS name, n.pos,
  CASE n.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind,
  CASE WHEN n.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN n.value ->> '$' END AS value
FROM n LEFT JOIN n p ON p.delivery_id = n.delivery_id AND p.layer = n.layer AND p.id = n.up"""

P4_DAYS = """
WITH t AS (SELECT row_id, epoch(extracted_at) AS s, floor(epoch(extracted_at) / 86400) AS day, row_id % 3 AS k FROM benefit_rows WHERE extracted_at IS NOT NULL)
SELECT row_id, CASE k WHEN 0 THEN 'unix_second' WHEN 1 THEN 'unix_day' ELSE 'sheet_day' END AS unit, CAST(CASE k WHEN 0 THEN floor(s) WHEN 1 THEN day ELSE day + 25569 END AS BIGINT) AS told,
  CAST(CASE k WHEN 0 THEN floor(floor(s) / 86400.0 + 2440588.0) ELSE day + 2440588 END AS BIGINT) AS julian_day FROM t"""

_TYPE = r"CASE WHEN regexp_full_match(v, '[+-]?\d+') THEN 'whole' WHEN regexp_full_match(v, '[+-]?\d+\.\d+') THEN 'decimal' WHEN regexp_full_match(v, '[+-]?\d+(\.\d+)?\s*%') THEN 'percent' WHEN v LIKE '$%' THEN 'dollar' WHEN regexp_full_match(v, '\d{4}-\d{2}-\d{2}') THEN 'date' ELSE 'text' END"

P5 = rf"""
WITH g AS (SELECT DISTINCT ON (guide_id) guide_id, series_id, issued_on, columns_detected AS det, coalesce(columns_mapped, []) AS m, coalesce(columns_unmapped, []) AS u FROM extraction_report WHERE guide_id IS NOT NULL ORDER BY guide_id, reported_at DESC NULLS LAST, report_id DESC),
c0 AS (SELECT guide_id, m, unnest(generate_series(1, len(det))) AS idx, unnest(det) AS label, u FROM g WHERE det IS NOT NULL),
c AS (SELECT guide_id, idx, label, regexp_replace(lower(label), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g') AS bare, CASE WHEN NOT list_contains(u, label) THEN m[CAST(sum(CASE WHEN list_contains(u, label) THEN 0 ELSE 1 END) OVER (PARTITION BY guide_id ORDER BY idx) AS INT)] END AS field FROM c0),
pr AS (SELECT earlier, later FROM (SELECT guide_id AS later, lag(guide_id) OVER (PARTITION BY series_id ORDER BY issued_on, guide_id) AS earlier FROM g WHERE series_id IS NOT NULL AND issued_on IS NOT NULL AND det IS NOT NULL) WHERE earlier IS NOT NULL),
code AS (SELECT guide_id, min(idx) AS ci FROM c WHERE field = 'code' GROUP BY guide_id),
rw AS (SELECT doc_id AS guide_id, page, table_seq, row_seq, cells, upper(trim(cells[ci])) AS code FROM guide_cells JOIN code ON doc_id = code.guide_id WHERE regexp_full_match(cells[ci], '\s*[A-Za-z][0-9]{{4}}[A-Za-z]?\s*')),
lg AS (SELECT r.guide_id, page, table_seq, row_seq, code, c.idx, c.field, trim(cells[c.idx]) AS v FROM rw r JOIN c ON c.guide_id = r.guide_id WHERE cells[c.idx] IS NOT NULL AND upper(trim(cells[c.idx])) NOT IN ('', '-', 'N/A')),
tn AS (SELECT guide_id, idx, {_TYPE} AS t, count(*) AS n FROM lg GROUP BY ALL),
ty AS (SELECT guide_id, idx, CASE WHEN max(n) * 2 > sum(n) THEN arg_max(t, n) ELSE 'text' END AS t FROM tn GROUP BY ALL),
ct AS (SELECT c.*, coalesce(t, 'text') AS t FROM c LEFT JOIN ty USING (guide_id, idx)),
ma AS (SELECT earlier, later, a.idx AS i, b.idx AS j FROM pr JOIN ct a ON a.guide_id = earlier JOIN ct b ON b.guide_id = later WHERE a.field = b.field OR (a.field IS NULL AND b.field IS NULL AND a.bare = b.bare)),
la AS (SELECT earlier, later, a.idx FROM pr JOIN ct a ON a.guide_id = earlier WHERE a.field IS NULL AND NOT EXISTS (SELECT 1 FROM ma WHERE ma.earlier = pr.earlier AND ma.later = pr.later AND ma.i = a.idx)),
lb AS (SELECT earlier, later, b.idx FROM pr JOIN ct b ON b.guide_id = later WHERE b.field IS NULL AND NOT EXISTS (SELECT 1 FROM ma WHERE ma.earlier = pr.earlier AND ma.later = pr.later AND ma.j = b.idx)),
fc AS (SELECT guide_id, idx, code, arg_min(v, CAST(page AS BIGINT) * 1000000000 + table_seq * 1000000 + row_seq) AS v FROM lg WHERE field IS NULL GROUP BY ALL),
sh AS (SELECT la.earlier, la.later, la.idx AS i, lb.idx AS j, avg(CASE WHEN x.v = y.v THEN 1.0 ELSE 0.0 END) AS share FROM la JOIN lb USING (earlier, later) JOIN fc x ON x.guide_id = la.earlier AND x.idx = la.idx JOIN fc y ON y.guide_id = lb.later AND y.idx = lb.idx AND y.code = x.code GROUP BY ALL HAVING share >= 0.8),
mc AS (SELECT earlier, later, i, j FROM (SELECT *, row_number() OVER (PARTITION BY earlier, later, i ORDER BY share DESC, j) AS ri, row_number() OVER (PARTITION BY earlier, later, j ORDER BY share DESC, i) AS rj FROM sh) WHERE ri = 1 AND rj = 1),
mt AS (SELECT * FROM ma UNION ALL SELECT * FROM mc)
SELECT DISTINCT * FROM (
  SELECT later AS guide_id, 'added' AS change_kind, b.label AS column_label FROM pr JOIN ct b ON b.guide_id = later WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.earlier = pr.earlier AND mt.later = pr.later AND mt.j = b.idx)
  UNION ALL SELECT later, 'removed', a.label FROM pr JOIN ct a ON a.guide_id = earlier WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.earlier = pr.earlier AND mt.later = pr.later AND mt.i = a.idx)
  UNION ALL SELECT mt.later, 'renamed', b.label FROM mt JOIN ct a ON a.guide_id = mt.earlier AND a.idx = mt.i JOIN ct b ON b.guide_id = mt.later AND b.idx = mt.j WHERE a.bare <> b.bare
  UNION ALL SELECT mt.later, 'retyped', b.label FROM mt JOIN ct a ON a.guide_id = mt.earlier AND a.idx = mt.i JOIN ct b ON b.guide_id = mt.later AND b.idx = mt.j WHERE a.t <> b.t)"""

SQL: dict[str, str] = {"p2_found": P2, "p2_nodes": P2_NODES, "p4_days": P4_DAYS, "p5_found": P5}
