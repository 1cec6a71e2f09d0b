"""Screening rows made from the star-schema tables, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read

# A part becomes an inspection; some values are missing, malformed or unsure by its key.
EVIDENCE = """
SELECT p_partkey AS inspection_id, 'common_or_generic_name' AS field, p_name AS value, 0.9 AS confidence FROM {part}
UNION ALL SELECT p_partkey, 'mrp', CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'ask ' || p_brand
  ELSE '₹' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) END, 0.92 FROM {part}
UNION ALL SELECT p_partkey, 'net_quantity', CAST(p_size AS STRING) || CASE WHEN p_partkey % 5 = 0 THEN ' pieces' ELSE ' g' END,
  CASE WHEN p_partkey % 13 = 0 THEN 0.4 ELSE 0.88 END FROM {part}
UNION ALL SELECT p_partkey, 'date_of_manufacture', CASE WHEN p_partkey % 17 = 0 THEN 'see pack' ELSE '12 AUG 2026' END, 0.9 FROM {part}
UNION ALL SELECT p_partkey, 'consumer_care_contact', CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE 'care@example.com' END, 0.9 FROM {part}
UNION ALL SELECT p_partkey, 'country_of_origin', 'India', 0.9 FROM {part} WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 'responsible_party_name_and_address', p_brand || ' Foods, Plot 5, Pune', 0.9 FROM {part} WHERE p_partkey % 6 <> 0
"""

CONTEXTS = """
SELECT p_partkey AS inspection_id,
  CASE p_partkey % 3 WHEN 0 THEN 'domestic' WHEN 1 THEN 'imported' ELSE 'elsewhere' END AS package_scope,
  CASE WHEN p_partkey % 10 = 0 THEN 'review' ELSE 'good' END AS quality_status,
  CASE WHEN p_partkey % 50 = 1 THEN 0 ELSE 5 END AS line_count
FROM {part}
"""

# An event becomes a correction of the part whose key is its user's.
CORRECTIONS = """
SELECT event_id AS seq, user_id AS inspection_id,
  CASE event_type WHEN 'click' THEN 'mrp' WHEN 'view' THEN 'net_quantity' WHEN 'purchase' THEN 'consumer_care_contact' ELSE 'colour' END AS field,
  CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_type = 'click' THEN '₹' || CAST(event_id AS STRING)
    WHEN event_type = 'view' THEN CAST(event_id AS STRING) || ' g' ELSE 'help@example.com' END AS corrected_text
FROM {events}
"""

# Two boxes for each line item, on a panel for each order.
BOXES = """
SELECT l_orderkey AS panel, l_linenumber AS line,
  CAST(l_partkey % 900 AS INT) AS x1, CAST(l_suppkey % 90 * 10 AS INT) AS y1,
  CAST(l_partkey % 900 + 20 + l_linenumber * 7 AS INT) AS x2, CAST(l_suppkey % 90 * 10 + 12 + l_linenumber AS INT) AS y2
FROM {lineitem}
"""


def frame(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in tables})


def plain(sql: str) -> str:
    """The same for an engine that has the tables as views."""
    return sql.format(**{t: t for t in ("part", "events", "lineitem", "orders", "customer", "supplier", "documents", "pages")})
