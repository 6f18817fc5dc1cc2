"""Deterministic interval views over the base tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

L = F.col
#: Line numbers repeat inside an order: a row id is its order and line number times this, and a rest of part, quantity and supplier.
LINE = 10**9


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chrom(c):
    return F.concat(F.lit("chr"), (1 + L(c).cast("bigint") % 22).cast("string"))


def reads(spark, sf_dir, length=None, where=None):
    li = _read(spark, sf_dir, "lineitem")
    li = li.filter(where) if where is not None else li
    start = (L("l_orderkey").cast("bigint") * 7919 + L("l_partkey").cast("bigint") * 104729 + L("l_linenumber").cast("bigint") * 31) % 1000000
    size = F.lit(36).cast("bigint") if length is None else length
    line = L("l_orderkey").cast("bigint") * 10 + L("l_linenumber")
    detail = ((L("l_partkey").cast("bigint") * 51 + L("l_quantity").cast("bigint")) * 10007 + L("l_suppkey").cast("bigint")) % LINE
    return li.select((line * LINE + detail).alias("_ord"), _chrom("l_suppkey").alias("chrom"), start.alias("initial"), (start + size).alias("final"), F.concat(F.lit("p"), (L("l_partkey") % 50).cast("string")).alias("name"), F.when(L("l_linestatus") == "O", "+").otherwise("-").alias("orientation"), L("l_quantity").cast("bigint").alias("score"))


def reg_a(spark, sf_dir):
    return reads(spark, sf_dir, 10 + L("l_quantity").cast("bigint") * 4, L("l_returnflag") == "R")


def reg_b(spark, sf_dir):
    start = (L("o_orderkey").cast("bigint") * 15485863) % 1000000
    price = F.floor("o_totalprice").cast("bigint")
    return _read(spark, sf_dir, "orders").select(L("o_orderkey").cast("bigint").alias("_ord"), _chrom("o_custkey").alias("chrom"), start.alias("initial"), (start + 20 + price % 180).alias("final"), L("o_orderpriority").alias("name"), F.when(L("o_orderstatus") == "F", "-").otherwise("+").alias("orientation"), price.alias("score"))


def genes(spark, sf_dir):
    start = (L("p_partkey").cast("bigint") * 32452843) % 1000000
    return _read(spark, sf_dir, "part").select(L("p_partkey").cast("bigint").alias("_ord"), _chrom("p_partkey").alias("chrom"), start.alias("initial"), (start + 200 + L("p_size").cast("bigint") * 20).alias("final"), L("p_name").alias("name"), F.when(L("p_size") % 2 == 0, "+").otherwise("-").alias("orientation"), L("p_size").cast("bigint").alias("score"))


def sizes(spark, sf_dir):
    return spark.range(1, 23).select(F.concat(F.lit("chr"), L("id").cast("string")).alias("chrom"), F.lit(1200000).cast("bigint").alias("length"))


def dna(spark, sf_dir):
    low = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return _read(spark, sf_dir, "documents").select("doc_id", F.translate(low, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))


_READ = """SELECT (l_orderkey::BIGINT * 10 + l_linenumber) * 1000000000 + ((l_partkey::BIGINT * 51 + trunc(l_quantity)::BIGINT) * 10007 + l_suppkey::BIGINT) % 1000000000 AS _ord, 'chr' || (1 + l_suppkey::BIGINT % 22) AS chrom,
  (l_orderkey::BIGINT * 7919 + l_partkey::BIGINT * 104729 + l_linenumber::BIGINT * 31) % 1000000 AS initial, {size} AS size, 'p' || (l_partkey % 50) AS name,
  CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS orientation, trunc(l_quantity)::BIGINT AS score FROM lineitem"""
CTE = f"""reads AS (SELECT * EXCLUDE (size), initial + size AS final FROM ({_READ.format(size="36::BIGINT")})),
reg_a AS (SELECT * EXCLUDE (size), initial + size AS final FROM ({_READ.format(size="10 + trunc(l_quantity)::BIGINT * 4")} WHERE l_returnflag = 'R')),
reg_b AS (SELECT o_orderkey::BIGINT AS _ord, 'chr' || (1 + o_custkey::BIGINT % 22) AS chrom, (o_orderkey::BIGINT * 15485863) % 1000000 AS initial,
  (o_orderkey::BIGINT * 15485863) % 1000000 + 20 + floor(o_totalprice)::BIGINT % 180 AS final, o_orderpriority AS name,
  CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS orientation, floor(o_totalprice)::BIGINT AS score FROM orders),
genes AS (SELECT p_partkey::BIGINT AS _ord, 'chr' || (1 + p_partkey::BIGINT % 22) AS chrom, (p_partkey::BIGINT * 32452843) % 1000000 AS initial,
  (p_partkey::BIGINT * 32452843) % 1000000 + 200 + p_size::BIGINT * 20 AS final, p_name AS name,
  CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS orientation, p_size::BIGINT AS score FROM part),
chroms AS (SELECT 'chr' || i AS chrom, 0::BIGINT AS initial, 1200000::BIGINT AS final FROM range(1, 23) t(i)),
dna AS (SELECT doc_id, translate(translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"""
