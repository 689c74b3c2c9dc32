"""Views over the given tables that stand in for frames, captures, catalogues and pixels.

Spark and DuckDB run the same text, except for ``pixels``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "frames": """
SELECT o_orderkey AS frame_id, concat('f', CAST(o_orderkey AS VARCHAR(20)), '.fits') AS path, substr(o_orderpriority,1,1) AS filter, o_orderdate AS obs_time,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 5e0 + (o_orderkey % 7)/1e1 ELSE 28e-1 + ((o_orderkey*7919) % 400)/1e3 END AS fwhm,
  CASE WHEN o_orderkey % 41 = 0 THEN 9e-1 ELSE 4e-1 + ((o_orderkey*104729) % 100)/1e3 END AS eccentricity,
  CASE WHEN o_orderkey % 37 = 0 THEN 50 ELSE 5000 + (o_orderkey*31337) % 1000 END AS stars, o_totalprice/1e3 AS psf_snr,
  CASE WHEN o_orderkey % 43 = 0 THEN 7e-2 ELSE 5e-2 + ((o_custkey*17) % 10)/1e4 END AS background, 10 + (o_orderkey*13) % 80 AS altitude, CASE WHEN o_orderkey % 53 = 0 THEN 3e4 ELSE 1e5 + (o_custkey*19) % 1000 END AS psf_flux,
  CASE o_orderstatus WHEN 'F' THEN 180 WHEN 'O' THEN 180 ELSE 60 END AS exposure FROM orders""",
    "capture": """
SELECT event_id AS frame_id, user_id AS card, event_type AS target, ts, value, substr(event_type,1,1) AS filter FROM events""",
    "catalogue": """
SELECT c_custkey AS star_id, (c_custkey*137.50776405e0) % 360e0 AS ra, degrees(asin(2e0*((c_custkey*7919) % 9973)/9973e0 - 1e0)) AS dec,
  c_acctbal/2e3 AS plx, ((c_custkey*53) % 200 - 100)/1e1 AS pmra, ((c_custkey*71) % 200 - 100)/1e1 AS pmdec, 8e0 + ((c_custkey*37) % 100)/1e1 AS g FROM customer""",
    "field": """
SELECT c_custkey AS star_id, 324.745e0 + CASE WHEN c_custkey % 3 = 0 THEN ((c_custkey*7919) % 2000 - 1000)/4e3 ELSE ((c_custkey*7919) % 5000 - 2500)/1e3 END AS ra,
  57.514e0 + CASE WHEN c_custkey % 3 = 0 THEN ((c_custkey*104729) % 2000 - 1000)/8e3 ELSE ((c_custkey*104729) % 3000 - 1500)/1e3 END AS dec,
  CASE WHEN c_custkey % 3 = 0 THEN 1.08e0 + ((c_custkey*11) % 20 - 10)/1e3 ELSE 2e-1 + ((c_custkey*13) % 3000)/1e3 END AS plx,
  CASE WHEN c_custkey % 3 = 0 THEN -2.4e0 + ((c_custkey*7) % 10)/1e2 ELSE ((c_custkey*53) % 200 - 100)/1e1 END AS pmra,
  CASE WHEN c_custkey % 3 = 0 THEN -4.6e0 + ((c_custkey*3) % 10)/1e2 ELSE ((c_custkey*71) % 200 - 100)/1e1 END AS pmdec, 9e0 + ((c_custkey*37) % 70)/1e1 AS g FROM customer""",
    "placed": """
SELECT c_custkey AS star_id, (((c_custkey - CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END)*7919) % 4000)/2e0 + CASE WHEN c_custkey % 10 = 1 THEN 4e-1 ELSE 0e0 END AS x,
  (((c_custkey - CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END)*6701) % 4000)/2e0 AS y, 8e0 + ((c_custkey*37) % 100)/1e1 AS g FROM customer""",
    "detections": """
SELECT p_partkey AS det_id, (((p_partkey - p_partkey % 2)*7919) % 4000)/2e0 + ((p_partkey*29) % 40 - 20)/2e1 AS x,
  (((p_partkey - p_partkey % 2)*6701) % 4000)/2e0 + ((p_partkey*31) % 40 - 20)/2e1 AS y,
  p_retailprice AS flux, 1 + p_size % 12 AS half_width FROM part""",
    "headers": """
SELECT conv_id AS image_id, concat(role, CAST(turn AS VARCHAR(10))) AS key, text AS value FROM conversations""",
    "files": """
SELECT doc_id AS file_id, source AS folder, lang AS channel, n_chars AS size, sha1(text) AS digest FROM documents""",
    "flats": """
SELECT p_partkey AS flat_id, concat('flat', CAST(p_partkey AS VARCHAR(20))) AS path, substr(p_type,1,1) AS filter, 1 + p_size % 2 AS binning, ((p_partkey*7) % 5)/2e0 + 1e0 AS exposure, -10e0 + (p_partkey % 7) AS temp, 100 AS gain FROM part""",
    "darks": """
SELECT s_suppkey AS dark_id, concat('dark', CAST(s_suppkey AS VARCHAR(20))) AS path, CASE WHEN s_suppkey % 4 = 0 THEN 'master' ELSE 'raw' END AS kind, 1 + s_suppkey % 2 AS binning, (s_suppkey % 5)/2e0 + 1e0 AS exposure, -10e0 + (s_suppkey % 9) AS temp, 100 AS gain FROM supplier""",
}

PIXELS_SPARK = """
SELECT vec_id AS image_id, CAST(floor(pos/8) AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST(v AS DOUBLE) AS v
FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, v"""

PIXELS_DUCKDB = """
SELECT vec_id AS image_id, CAST((i-1)//8 AS INT) AS y, CAST((i-1)%8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v
FROM (SELECT vec_id, embedding, unnest(range(1,65)) AS i FROM embeddings)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the stand-in views as a DataFrame."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    text = PIXELS_SPARK if name == "pixels" else VIEWS[name]
    for t in TABLES:
        if f"FROM {t}" in text:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def with_views(names: str, sql: str) -> str:
    """SQL with the named views (separated by spaces) in front; further CTEs may follow."""
    body = sql.strip()
    recursive = body.upper().startswith("RECURSIVE ")
    if recursive:
        body = body[len("RECURSIVE "):].lstrip()
    ctes = ",\n".join(f"{n} AS ({PIXELS_DUCKDB if n == 'pixels' else VIEWS[n]})" for n in names.split())
    link = ",\n" if re.match(r"\w+(\([\w, ]+\))? AS (MATERIALIZED )?\(", body) else "\n"
    return ("WITH RECURSIVE " if recursive else "WITH ") + ctes + link + body
