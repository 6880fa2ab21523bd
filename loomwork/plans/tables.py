"""Queries over the star tables: joins, set operations, windows and top lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query


@query("""SELECT r_name, n_name, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def star_join_rollup(table):
    j = table("lineitem").join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def pricing_summary(table):
    return table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def customers_without_finished(table):
    done = table("orders").where("o_orderstatus = 'F'")
    return table("customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def orders_per_customer(table):
    sums = table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return table("customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("""WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) SELECT * FROM r WHERE rank <= 3""")
def top_parts_per_brand(table):
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table("part").select("p_brand", "p_partkey", "p_retailprice", F.row_number().over(order).alias("rank")).where("rank <= 3")


@query("""SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def shared_nations(table):
    return table("customer").select(F.col("c_nationkey").alias("nation")).intersect(table("supplier").select("s_nationkey"))


@query("""SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45""")
def parts_never_bulk(table):
    return table("part").select("p_partkey").subtract(table("lineitem").where("l_quantity > 45").select("l_partkey"))


@query("""WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), p AS (SELECT o_custkey, count(*) AS kinds FROM d GROUP BY 1) SELECT kinds, count(*) AS n FROM p GROUP BY 1""")
def priority_variety(table):
    return table("orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("kinds")).groupBy("kinds").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'a' WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'b' WHEN o_orderstatus = 'P' THEN 'c' END AS basket, o_totalprice FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY basket) AS have FROM b WHERE basket IS NOT NULL),
h AS (SELECT coalesce(max(have) FILTER (basket = 'a'), 0) AS a, coalesce(max(have) FILTER (basket = 'b'), 0) AS b, coalesce(max(have) FILTER (basket = 'c'), 0) AS c FROM r),
s1 AS (SELECT *, least(a, 20) AS ga, least(b, 60) AS gb, least(c, 20) AS gc FROM h), s2 AS (SELECT *, least(b, gb + 100 - ga - gb - gc) AS hb FROM s1), s3 AS (SELECT *, least(c, gc + 100 - ga - hb - gc) AS hc FROM s2), s4 AS (SELECT *, least(a, ga + 100 - ga - hb - hc) AS ha FROM s3)
SELECT o_orderkey, basket, rn AS position FROM r, s4 WHERE rn <= CASE basket WHEN 'a' THEN ha WHEN 'b' THEN hb ELSE hc END""")
def basket_queue(table):
    """A queue of 100 from three baskets with shares of 20, 60 and 20; what one lacks goes to the second, the third, the first."""
    from ..operators.scheduling import basket_queue as queue

    o = table("orders")
    basket = F.when(F.col("o_orderpriority") == "1-URGENT", "a").when(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp"), "b").when(F.col("o_orderstatus") == "P", "c")
    return queue(o.select("o_orderkey", "o_totalprice", basket.alias("basket")), "basket", {"a": 20, "b": 60, "c": 20}, ["b", "c", "a"], [F.desc("o_totalprice"), F.col("o_orderkey")], 100).select("o_orderkey", "basket", "position")
