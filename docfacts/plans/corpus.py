"""Benefit documents and page words made of the test tables by plain SQL that Spark and DuckDB read alike.

One document for each customer: two packages over two pages, with what a rule looks for left out, doubled or cut off by the
customer's number. Integers and names only; line ends are chr(10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docfacts.functions.tables import spread, table

_CODE = "'D' || lpad(CAST((c_custkey * {a} + {b}) % 10000 AS STRING), 4, '0')"
_N = "chr(10)"


def _code(a: int, b: int) -> str:
    return _CODE.format(a=a, b=b)


#: Both pages' running header; its page number differs.
_HEADER = "'{page} 2024 Evidence of Coverage for ' || c_mktsegment || ' Select ' || CAST(c_nationkey AS STRING) || ' (HMO)' || chr(10) || 'Chapter 4 Medical Benefits Chart (what is covered)' || chr(10) || 'HMO-MAPD ' || CAST(1000000 + c_custkey AS STRING) || 'B_01 Revised 10/06/2023 Customer Service' || chr(10)"

PLAN_DOCS = f"""
SELECT c_custkey AS doc_id,
  {_HEADER.format(page=115)}
  || 'Members may add the packages below to the plan.' || {_N}
  || 'Optional supplemental package 1 - Preventive dental package' || {_N}
  || 'These services are offered for an additional premium.' || {_N}
  || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Premium $' || CAST(10 + c_custkey % 40 AS STRING) || '.00 monthly premium' || {_N} END
  || CASE WHEN c_custkey % 11 = 3 THEN 'Premium $' || CAST(60 + c_custkey % 9 AS STRING) || '.00 monthly premium' || {_N} END
  || 'Two oral exams each year (from the following codes):' || {_N}
  || '• ' || {_code(37, 11)} || ' - Periodic oral check - established' || {_N} || 'patient' || {_N}
  || '• ' || {_code(41, 23)} || ' - Limited oral check' || {_N}
  || CASE WHEN c_custkey % 6 = 2 THEN '• ' || {_code(37, 11)} || ' - Periodic oral check again' || {_N} ELSE '' END
  || CASE WHEN c_custkey % 5 = 1 THEN 'Three' ELSE 'Two' END || ' cleanings per year' || {_N}
  || '• ' || {_code(43, 31)} || ' - Adult cleaning' || {_N}
  || 'The plan will pay up to $' || CAST(500 + 100 * (c_custkey % 5) AS STRING) || ' for preventive dental benefits each year' || {_N}
  || {_HEADER.format(page=116)}
  || 'Coverage is available from ' || c_mktsegment || ' providers only.' || {_N}
  || 'You pay no copay for the preventive dental benefits listed.' || {_N}
  || CASE WHEN c_custkey % 4 = 1 THEN 'You pay 10% for cleanings.' || {_N} ELSE '' END
  || 'Exclusions & Limitations:' || {_N}
  || '• Services must be rendered by a contracted provider.' || {_N}
  || '• You must pay any extra costs outside of the codes.' || {_N}
  || 'Optional supplemental package 2 - Dental and vision package' || {_N}
  || 'Premium $' || CAST(30 + c_custkey % 25 AS STRING) || '.00 monthly premium' || {_N}
  || '4 fillings per calendar year' || {_N}
  || '• ' || {_code(47, 41)} || ' - Resin filling' || {_N}
  || 'The plan will pay up to $1,000 for dental benefits each year' || {_N}
  || 'You pay 20% for fillings.' || {_N}
  || CASE WHEN c_custkey % 3 = 0 THEN 'You pay $' || CAST(5 + c_custkey % 20 AS STRING) || ' copay for eyewear.' || {_N} ELSE '' END
  || 'You pay 50% as your portion of the covered charges for crowns and bridges'
  || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '.' END AS raw
FROM customer
""".replace("|| CASE WHEN c_custkey % 11 = 3 THEN 'Premium $' || CAST(60 + c_custkey % 9 AS STRING) || '.00 monthly premium' || chr(10) END", "|| CASE WHEN c_custkey % 11 = 3 THEN 'Premium $' || CAST(60 + c_custkey % 9 AS STRING) || '.00 monthly premium' || chr(10) ELSE '' END")

#: One page of words for each customer: a heading, three code lines with a wrapped line each, in four columns.
GUIDE_WORDS = """
WITH r AS (SELECT c_custkey AS doc_id, k FROM customer CROSS JOIN (VALUES (0), (1), (2)) AS v(k)),
w AS (
  SELECT doc_id, k * 10 + 0 AS seq, 'D' || lpad(CAST((doc_id * 3 + k) % 10000 AS STRING), 4, '0') AS text, 20 AS x0, 50 AS x1, 120 + 40 * k AS top FROM r
  UNION ALL SELECT doc_id, k * 10 + 1, 'service', 100, 150, 120 + 40 * k FROM r
  UNION ALL SELECT doc_id, k * 10 + 2, 'number' || CAST(k AS STRING), 154, 190, 120 + 40 * k FROM r
  UNION ALL SELECT doc_id, k * 10 + 3, CAST(1 + doc_id % 4 AS STRING), 250, 256, 120 + 40 * k FROM r
  UNION ALL SELECT doc_id, k * 10 + 4, 'yearly', 260, 295, 120 + 40 * k FROM r
  UNION ALL SELECT doc_id, k * 10 + 5, CAST(10 * (doc_id % 11) AS STRING) || '%', 400, 430, 120 + 40 * k FROM r
  UNION ALL SELECT doc_id, k * 10 + 6, 'wrapped', 100, 160, CASE WHEN doc_id % 2 = 0 THEN 132 ELSE 108 END + 40 * k FROM r
  UNION ALL SELECT doc_id, 90, 'Section', 20, 70, 100 FROM r WHERE k = 0
  UNION ALL SELECT doc_id, 91, 'Code', 20, 45, 72 FROM r WHERE k = 0
  UNION ALL SELECT doc_id, 92, 'Description', 100, 170, 72 FROM r WHERE k = 0
  UNION ALL SELECT doc_id, 93, 'Frequency', 250, 310, 72 FROM r WHERE k = 0
  UNION ALL SELECT doc_id, 94, 'Coverage', 400, 450, 72 FROM r WHERE k = 0
)
SELECT doc_id, 1 AS page, CAST(seq AS INT) AS seq, text, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, CAST(top AS DOUBLE) AS top, CAST(top + 10 AS DOUBLE) AS bottom FROM w
"""


def plan_docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, raw): the documents."""
    return spark.sql(PLAN_DOCS.replace("FROM customer", "FROM {customer}"), customer=spread(table(spark, d, "customer"), "c_custkey")).toDF("doc_id", "raw")


def guide_words(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, page, seq, text, x0, x1, top, bottom): the pages' words."""
    return spark.sql(GUIDE_WORDS.replace("FROM customer", "FROM {customer}"), customer=spread(table(spark, d, "customer"), "c_custkey")).toDF("doc_id", "page", "seq", "text", "x0", "x1", "top", "bottom")
