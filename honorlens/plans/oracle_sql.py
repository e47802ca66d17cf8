"""DuckDB SQL for the fact binding, shared by every oracle query.

It mirrors ``sources/facts.py`` column by column; doubles are rounded to 6
decimals on both sides before comparison."""

from __future__ import annotations

FACT_CTE = """fact AS (
  SELECT o.o_custkey AS id,
         c.c_name AS name,
         CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 'organization'
              WHEN o.o_orderstatus = 'F' THEN 'female'
              WHEN o.o_orderstatus = 'O' THEN 'male'
              ELSE 'other' END AS gender,
         c.c_mktsegment = 'MACHINERY' AS is_org,
         o.o_orderpriority AS category,
         CAST(year(o.o_orderdate) AS INTEGER) AS award_year,
         CAST(floor(year(o.o_orderdate) / 2) * 2 AS INTEGER) AS decade,
         n.n_name AS birth_country,
         r.r_name AS birth_continent,
         CAST(trunc(l.l_quantity) AS INTEGER) AS age_at_award,
         l.l_extendedprice AS prize_amount,
         l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax) AS prize_amount_adjusted,
         CASE WHEN CAST(l.l_shipdate AS DATE) >= CAST(o.o_orderdate AS DATE)
              THEN round(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) / 365.25, 1)
         END AS lifespan,
         l.l_partkey AS partkey
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
persons AS (SELECT * FROM fact WHERE NOT is_org)"""


def with_fact(body: str) -> str:
    """Prefix a query with the fact and persons CTEs."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {FACT_CTE},\n{body[5:]}"
    return f"WITH {FACT_CTE}\n{body}"
