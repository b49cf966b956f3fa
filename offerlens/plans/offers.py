"""The offer view: order lines as retail offers, one row each, as of a fixed moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import dates, numbers

AS_OF = "1998-06-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offer_view(spark: SparkSession, sf_dir: str, active: bool = False) -> DataFrame:
    """lineitem with its order, part, supplier and nation; with active, only active offers.

    Lines meet orders and parts in shuffled hash joins: of the two sides only orders and parts are held, by partition, and
    lines aren't sorted. An active offer's two dates are tested in their own tables, before these are shuffled.
    """
    t = lambda n: table(spark, sf_dir, n)
    lines, orders = t("lineitem"), t("orders")
    if active:
        lines, orders = lines.filter(F.coalesce(F.col("l_shipdate") >= as_of(), F.lit(True))), orders.filter(F.coalesce(F.col("o_orderdate") <= as_of(), F.lit(True)))
    joined = (
        lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    reference = F.col("l_extendedprice") / F.col("l_quantity")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
    state = dates.status(F.col("o_orderdate"), F.col("l_shipdate"), F.lit(False), as_of())
    out = joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offer_id"), F.col("l_suppkey").alias("source_id"), F.col("s_name").alias("retailer_key"), F.col("n_name").alias("region"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category_primary"), F.element_at(F.split("p_name", " "), -1).alias("category_secondary"),
        F.lower("p_type").alias("main_key"), F.lower(F.element_at(F.split("p_name", " "), -1)).alias("sub_key"), F.lower(F.element_at(F.split("p_name", " "), -1)).alias("category_key"),
        F.col("p_size").alias("size"), numbers.money(price).alias("price"), numbers.money(reference).alias("reference"), numbers.money(price / F.col("p_size")).alias("unit_price"), F.lit("kg").alias("unit"),
        F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"), F.col("o_orderdate").alias("valid_from"), F.col("l_shipdate").alias("valid_to"), state.alias("status"), (state == "active").alias("is_active"),
        (F.col("l_returnflag") == "R").alias("program_required"), (F.col("l_linestatus") == "F").alias("comparison_safe"), (1 - F.col("l_tax")).alias("confidence"), (F.col("l_linenumber") % 3).alias("channel_no"),
        F.concat_ws("::", "s_name", "p_name", "p_brand", numbers.cents(price).cast("string")).alias("dedupe_key"),
    )
    return out.filter("is_active") if active else out


def money_sql(x: str) -> str:
    """Two decimals of x >= 0 as SQL: printing rounds the exact value, and only eighths can lie halfway between two cents."""
    return f"(CASE WHEN ({x}) * 8 = floor(({x}) * 8) THEN floor(({x}) * 100 + 0.5) / 100 ELSE CAST(printf('%.2f', CAST({x} AS DOUBLE)) AS DOUBLE) END)"


def cents_sql(x: str) -> str:
    return f"CAST(round({money_sql(x)} * 100) AS BIGINT)"


_PRICE = "l_extendedprice * (1 - l_discount) / l_quantity"
#: The same view for an SQL engine with LIST types.
OFFERS_SQL = f"""offers AS (
  SELECT l_orderkey * 10 + l_linenumber AS offer_id, l_suppkey AS source_id, s_name AS retailer_key, n_name AS region, p_name AS title, p_brand AS brand, p_type AS category_primary,
    string_split(p_name, ' ')[-1] AS category_secondary, lower(p_type) AS main_key, lower(string_split(p_name, ' ')[-1]) AS sub_key, lower(string_split(p_name, ' ')[-1]) AS category_key,
    p_size AS size, {money_sql(_PRICE)} AS price, {money_sql('l_extendedprice / l_quantity')} AS reference,
    {money_sql(f'{_PRICE} / p_size')} AS unit_price, 'kg' AS unit, l_discount AS discount, l_quantity AS quantity, o_orderdate AS valid_from, l_shipdate AS valid_to,
    CASE WHEN o_orderdate > TIMESTAMP '{AS_OF}' THEN 'upcoming' WHEN l_shipdate < TIMESTAMP '{AS_OF}' THEN 'expired' WHEN o_orderdate IS NOT NULL OR l_shipdate IS NOT NULL THEN 'active' ELSE 'unknown' END AS status,
    status = 'active' AS is_active, l_returnflag = 'R' AS program_required, l_linestatus = 'F' AS comparison_safe, 1 - l_tax AS confidence, l_linenumber % 3 AS channel_no,
    s_name || '::' || p_name || '::' || p_brand || '::' || CAST({cents_sql(_PRICE)} AS VARCHAR) AS dedupe_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
