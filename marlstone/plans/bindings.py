"""Views that stand in for market, portfolio and filing data, derived from the test tables.

One SQL text serves both engines: {table} is the table's DataFrame in Spark and its name in the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

VIEWS["bars"] = """
SELECT CASE l_returnflag WHEN 'A' THEN 'EQ' WHEN 'N' THEN 'BD' ELSE 'EW' END AS ticker, CAST(l_shipdate AS DATE) AS date,
  MIN(l_extendedprice / l_quantity) AS open, MAX(l_extendedprice / l_quantity) AS high, MIN(l_extendedprice / l_quantity) AS low,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
  CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
FROM {lineitem} GROUP BY 1, 2
"""

# Metrics of a part: NULL by a different modulus of its size for each.
VIEWS["candidates"] = """
SELECT CAST(p_partkey AS STRING) AS ticker, p_name AS company, p_type AS sector,
  CASE WHEN p_size % 7 <> 0 THEN p_retailprice / 40 - 5 END AS pe,
  CASE WHEN p_size % 11 <> 0 THEN CAST(p_partkey % 37 AS DOUBLE) - 3 END AS pfcf,
  CASE WHEN p_size % 13 <> 0 THEN CAST(p_partkey % 41 AS DOUBLE) / 100 END AS roe,
  CASE WHEN p_size % 17 <> 0 THEN CAST(p_partkey % 31 AS DOUBLE) / 100 END AS roic,
  CASE WHEN p_size % 5 <> 0 THEN CAST(p_partkey % 43 AS DOUBLE) / 100 END AS op_margin,
  CASE WHEN p_size % 19 <> 0 THEN CAST(p_partkey % 29 AS DOUBLE) / 100 END AS profit_margin,
  CASE WHEN p_size % 6 <> 0 THEN CAST(p_partkey % 16 AS DOUBLE) / 10 END AS de,
  CASE WHEN p_size % 4 <> 0 THEN CAST(p_partkey % 27 AS DOUBLE) - 14 END AS insider_pct
FROM {part}
"""

VIEWS["fills"] = """
SELECT event_id AS id, CAST(user_id % 5 AS STRING) AS account_number, CASE WHEN event_type = 'error' THEN 'Money Movement' ELSE 'Trade' END AS transaction_type,
  CAST(user_id AS STRING) AS symbol, CASE WHEN event_type IN ('purchase', 'signup') THEN 'Buy to Open' ELSE 'Sell to Close' END AS action,
  CAST({qty} + 1 AS BIGINT) AS quantity, CAST(value AS DECIMAL(18,2)) AS price, ts AS executed_at
FROM {events}
"""

VIEWS["portfolio_daily"] = """
SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 5 AS STRING) AS account_number, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS nlv,
  CAST(MIN(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS cash_balance, CAST(MAX(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS equity_buying_power, CAST(COUNT(*) AS INT) AS position_count,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 100 AS daily_pl
FROM {orders} GROUP BY 1, 2
"""

VIEWS["position_daily"] = """
SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 5 AS STRING) AS account_number, CAST(l_suppkey AS STRING) AS symbol, CASE WHEN l_suppkey % 7 = 0 THEN 'Short' ELSE 'Long' END AS direction,
  CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, MAX(l_extendedprice / l_quantity) AS mark_price, MIN(l_extendedprice / l_quantity) AS cost_basis, CAST(1 AS DOUBLE) AS multiplier
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4
"""

VIEWS["nodes"] = """
SELECT doc_id AS node, source AS ticker, CAST(doc_id AS STRING) AS accession, '10-K' AS form,
  CASE doc_id % 4 WHEN 0 THEN 'business' WHEN 1 THEN 'risk_factors' WHEN 2 THEN 'mdna' ELSE 'financial_statements' END AS label,
  split_part(text, chr(10), 1) AS title, text, substr(text, 1, 200) AS summary, '' AS questions
FROM {documents}
"""

VIEWS["components"] = """
SELECT CAST(c_custkey % 300 AS STRING) AS thesis, c_custkey AS pos, 'part ' || CAST(c_custkey % 7 AS STRING) AS name,
  CAST(c_nationkey % 6 * 5 AS INT) AS weight, CAST(c_custkey * 37 % 101 AS INT) AS score
FROM {customer}
"""

VIEWS["theses"] = """
SELECT CAST(c_custkey AS STRING) AS thesis,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'value' WHEN 'MACHINERY' THEN 'systematic' WHEN 'FURNITURE' THEN 'short' WHEN 'HOUSEHOLD' THEN 'yolo' ELSE 'other' END AS bucket,
  CASE c_nationkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'watchlist' ELSE 'draft' END AS status,
  CASE c_custkey % 6 WHEN 0 THEN 'green' WHEN 1 THEN 'blue' WHEN 2 THEN 'orange' WHEN 3 THEN 'red' WHEN 4 THEN 'danger' ELSE 'Red' END AS color,
  c_acctbal AS balance, c_custkey AS number
FROM {customer}
"""

VIEWS["requests"] = """
SELECT event_id AS id, CAST(user_id % 20 AS STRING) AS ticker,
  CASE event_type WHEN 'view' THEN '10-K' WHEN 'click' THEN 'Form 4' WHEN 'purchase' THEN '10-q/A' WHEN 'signup' THEN ' DEF 14A ' ELSE 'S-8' END AS form, ts AS requested_at
FROM {events}
"""

#: What differs between the engines.
_SPARK = {"qty": "CAST(get_json_object(props, '$.k') AS BIGINT)"}
_DUCK = {"qty": "CAST(json_extract(props, '$.k') AS BIGINT)"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    for key, value in _SPARK.items():
        text = text.replace("{" + key + "}", value)
    tables = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def with_views(sql: str) -> str:
    """Oracle SQL with the views that it names put before it."""
    used, text = [], sql
    for name, body in VIEWS.items():
        if re.search(rf"\b{name}\b", sql):
            for key, value in _DUCK.items():
                body = body.replace("{" + key + "}", value)
            used.append(f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', body)})")
    text = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I)
    if not used:
        return sql
    return ("WITH RECURSIVE " if re.match(r"\s*WITH\s+RECURSIVE\b", sql, flags=re.I) else "WITH ") + ", ".join(used) + (", " + text if text != sql else " " + sql)
