"""The declaration model laid over the driver tables: nodes, edges, claims.

Texts are in the SQL that Spark and DuckDB share, so the same projection feeds the
queries and their oracles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerline.functions.session import shuffle_width
from ledgerline.sources.tables import TABLES, register

DECLS = """
SELECT 'region.' || CAST(r_regionkey AS STRING) AS name, 'region' AS module, 'region' AS kind, 'region' AS library FROM region
UNION ALL SELECT 'nation.' || CAST(n_nationkey AS STRING), 'nation.' || CAST(n_regionkey AS STRING), 'nation', 'nation' FROM nation
UNION ALL SELECT 'customer.' || CAST(c_custkey AS STRING), 'customer.' || c_mktsegment, 'customer', 'customer' FROM customer
UNION ALL SELECT 'supplier.' || CAST(s_suppkey AS STRING), 'supplier.' || CAST(s_nationkey AS STRING), 'supplier', 'supplier' FROM supplier
UNION ALL SELECT 'part.' || CAST(p_partkey AS STRING), 'part.' || p_brand, 'part', 'part' FROM part
UNION ALL SELECT 'orders.' || CAST(o_orderkey AS STRING), 'orders.' || o_orderpriority, 'orders', 'orders' FROM orders
"""

PART_EDGES = """
SELECT 'part.' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS src, 'part.' || CAST(p_partkey AS STRING) AS dst FROM part WHERE p_partkey > 1
UNION SELECT 'part.' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING), 'part.' || CAST(p_partkey AS STRING) FROM part WHERE p_partkey > 3
"""

EDGES = f"""
SELECT 'region.' || CAST(n_regionkey AS STRING) AS src, 'nation.' || CAST(n_nationkey AS STRING) AS dst FROM nation
UNION SELECT 'nation.' || CAST(c_nationkey AS STRING), 'customer.' || CAST(c_custkey AS STRING) FROM customer
UNION SELECT 'nation.' || CAST(s_nationkey AS STRING), 'supplier.' || CAST(s_suppkey AS STRING) FROM supplier
UNION SELECT 'customer.' || CAST(o_custkey AS STRING), 'orders.' || CAST(o_orderkey AS STRING) FROM orders
UNION SELECT 'supplier.' || CAST(l_suppkey AS STRING), 'orders.' || CAST(l_orderkey AS STRING) FROM lineitem
UNION SELECT 'part.' || CAST(l_partkey AS STRING), 'orders.' || CAST(l_orderkey AS STRING) FROM lineitem
UNION {PART_EDGES}
"""

#: Claims: the dearest orders, by family and importance.
DEAREST = 499_000
CLAIMS = f"""
SELECT 'claim.' || CAST(o_orderkey AS STRING) AS id, o_orderpriority AS family,
  CASE o_orderstatus WHEN 'O' THEN 'headline' WHEN 'F' THEN 'major' ELSE 'supporting' END AS importance,
  'orders.' || CAST(o_orderkey AS STRING) AS declaration
FROM orders WHERE o_totalprice >= {DEAREST}
"""

#: A cyclic graph for component tests: p -> p*p+1 modulo the number of parts.
CYCLIC = """
SELECT 'c.' || CAST(p_partkey AS STRING) AS src, 'c.' || CAST((p_partkey * p_partkey + 1) % n AS STRING) AS dst
FROM part, (SELECT count(*) AS n FROM part) AS sized WHERE p_partkey <> (p_partkey * p_partkey + 1) % n
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A DataFrame of projection SQL over the tables of a folder; only those it names are opened."""
    register(spark, sf_dir, [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN|,) {t}\b", sql)])
    return spark.sql(sql)


def consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges as they lie by consumer: what joins on ``dst`` moves them once, for their being distinct and for the join."""
    every = frame(spark, sf_dir, re.sub(r"\bUNION\b(?! ALL)", "UNION ALL", EDGES))
    return every.repartition(shuffle_width(every), "dst").distinct()
