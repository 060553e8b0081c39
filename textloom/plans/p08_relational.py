"""Relational coverage on the star schema and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.registry import load, query
from textloom.streaming import answers


@query("rel_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark, d):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("rel_revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def revenue_by_nation(spark, d):
    t = {n: load(spark, d, n) for n in ("customer", "orders", "lineitem", "nation", "region")}
    dims = t["nation"].join(F.broadcast(t["region"].where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows at most
    c = t["customer"].join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = t["orders"].join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t["lineitem"].join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.round(F.sum(price), 2).alias("revenue"))


@query("rel_full_outer", "SELECT coalesce(s_nationkey, c_nationkey) AS nation, s, c FROM (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON s_nationkey = c_nationkey")
def full_outer(spark, d):
    s = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("s"))
    c = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("c"))
    return s.join(c, "nation", "full")


@query("rel_rollup", "SELECT n_regionkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def rollup(spark, d):
    n = F.broadcast(load(spark, d, "nation").select("n_nationkey", "n_regionkey"))  # 25 rows
    return load(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("rel_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    return load(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("rel_top_per_group", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_per_group(spark, d):
    n = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return load(spark, d, "customer").withColumn("n", n).where("n <= 3").select("c_mktsegment", "c_custkey", "c_acctbal")


@query("rel_orders_without_returns", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderstatus")
def without_returns(spark, d):
    back = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, d, "orders").join(back, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("rel_part_promo_share", "SELECT p_brand, round(sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice ELSE 0 END), 2) AS promo, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def promo_share(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    j = load(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").agg(F.round(F.sum(F.when(F.col("p_type").startswith("PROMO"), F.col("l_extendedprice")).otherwise(0)), 2).alias("promo"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("rel_monthly_orders", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def monthly_orders(spark, d):
    return load(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("str_windowed_counts", "SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    w = answers.windowed_counts(load(spark, d, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("str_sessions", "SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, g, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS s FROM events)) GROUP BY ALL) GROUP BY user_id")
def sessions(spark, d):
    return answers.sessions(load(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))
