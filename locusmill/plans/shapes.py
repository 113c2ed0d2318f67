"""Genetic tables derived from the star schema, in DataFrames and in SQL.

markers from part, samples from customer (or supplier), one call per part and customer (or
supplier) that share orders; the dosage is arithmetic on the order lines' numbers. Nothing is
crossed: calls grow with lineitem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dosage(s: Column) -> Column:
    return F.when(s % 29 == 0, None).when(s % 7 == 0, 2).when(s % 3 == 0, 1).otherwise(0).cast("int")


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """marker, sample (customer), g."""
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    x = l.join(o, l["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("l_partkey").alias("marker"), F.col("o_custkey").alias("sample"))
    s = F.sum(F.col("l_linenumber") * 5 + F.col("l_quantity").cast("bigint"))
    return x.agg(s.alias("s")).select("marker", "sample", _dosage(F.col("s")).alias("g"))


def supplier_calls(spark: SparkSession, sf: str) -> DataFrame:
    """marker, sample (supplier), g."""
    s = F.sum(F.col("l_linenumber") * 5 + F.col("l_quantity").cast("bigint"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("marker"), F.col("l_suppkey").alias("sample")).agg(s.alias("s")).select("marker", "sample", _dosage(F.col("s")).alias("g"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """sample, y, status, x1."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("sample"), F.col("c_acctbal").alias("y"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("status"), F.col("c_nationkey").alias("x1"))


def markers(spark: SparkSession, sf: str) -> DataFrame:
    """marker, contig, pos, grp, ftype, size."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("marker"), (1 + F.col("p_partkey") % 22).cast("string").alias("contig"), (F.col("p_partkey") * 1000 + 1).alias("pos"), F.col("p_brand").alias("grp"), F.col("p_type").alias("ftype"), F.col("p_size").alias("size"))


def phenotyped(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).join(samples(spark, sf), "sample")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """contig, beg, end, label around each marker."""
    m = markers(spark, sf)
    return m.select("contig", F.greatest(F.col("pos") - 500 * F.col("size"), F.lit(1)).alias("beg"), (F.col("pos") + 500 * F.col("size")).alias("end"), F.col("grp").alias("label"))


def genes(spark: SparkSession, sf: str) -> DataFrame:
    """gene, contig, tx_start, tx_end from suppliers, spread over the markers' span."""
    s = table(spark, sf, "supplier")
    start = F.col("s_suppkey") * 20000 + 1
    return s.select(F.concat(F.lit("G"), F.col("s_suppkey")).alias("gene"), (1 + F.col("s_suppkey") % 22).cast("string").alias("contig"), start.alias("tx_start"), (start + 15000).alias("tx_end"))


_D = "CASE WHEN s % 29 = 0 THEN NULL WHEN s % 7 = 0 THEN 2 WHEN s % 3 = 0 THEN 1 ELSE 0 END AS g"
_S = "sum(l_linenumber * 5 + CAST(l_quantity AS BIGINT)) AS s"
SQL = {
    "calls": f"calls AS (SELECT marker, sample, {_D} FROM (SELECT l_partkey AS marker, o_custkey AS sample, {_S} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) t)",
    "scalls": f"scalls AS (SELECT marker, sample, {_D} FROM (SELECT l_partkey AS marker, l_suppkey AS sample, {_S} FROM lineitem GROUP BY 1, 2) t)",
    "samples": "samples AS (SELECT c_custkey AS sample, c_acctbal AS y, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS status, c_nationkey AS x1 FROM customer)",
    "markers": "markers AS (SELECT p_partkey AS marker, CAST(1 + p_partkey % 22 AS VARCHAR) AS contig, p_partkey * 1000 + 1 AS pos, p_brand AS grp, p_type AS ftype, p_size AS size FROM part)",
    "regions": "regions AS (SELECT contig, greatest(pos - 500 * size, 1) AS beg, pos + 500 * size AS \"end\", grp AS label FROM markers)",
    "genes": "genes AS (SELECT 'G' || s_suppkey AS gene, CAST(1 + s_suppkey % 22 AS VARCHAR) AS contig, s_suppkey * 20000 + 1 AS tx_start, s_suppkey * 20000 + 15001 AS tx_end FROM supplier)",
    "qc": "qc AS (SELECT marker, count(g) AS ns, count(*) AS n, CAST(coalesce(sum(g), 0) AS DOUBLE) AS ac, CAST(coalesce(sum(g * g), 0) AS DOUBLE) AS sumsq, count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 2) AS n2 FROM calls GROUP BY 1)",
    "freq": "freq AS (SELECT *, ns / CAST(n AS DOUBLE) AS callrate, CASE WHEN ns > 0 THEN ac / (2.0 * ns) END AS af, CASE WHEN ns > 0 THEN least(ac / (2.0 * ns), 1 - ac / (2.0 * ns)) END AS maf, floor(least(ac, 2.0 * ns - ac) + 0.5) AS mac, CASE WHEN ns > 0 THEN sumsq / ns - (ac / ns) * (ac / ns) END AS var FROM qc)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
