"""The relational substrate on the star schema (extension): scans, joins, grouping sets, windows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.plans.common import Registry, table

reg = Registry()


@reg.add(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@reg.add(
    """SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = per_order.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@reg.add("SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def customers_without_urgent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@reg.add("SELECT c_mktsegment, o_orderpriority, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)")
def segment_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return j.cube("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@reg.add("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def flag_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@reg.add("SELECT * FROM (SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3")
def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"), "rank")


@reg.add("SELECT o_orderkey, date_diff('day', lag(o_orderdate) OVER w, o_orderdate)::INTEGER AS gap, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("gap"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running")
    )


_SETS = {"union_nations": ("UNION", "unionByName"), "intersect_nations": ("INTERSECT", "intersect"), "except_nations": ("EXCEPT", "subtract")}


def _set_query(name: str, word: str, method: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
        s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
        return getattr(c, method)(s).distinct()

    run.__name__ = name
    reg.add(f"SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 {word} SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")(run)


for _name, (_word, _method) in _SETS.items():
    _set_query(_name, _word, _method)


@reg.add("SELECT p_partkey, p_name, round(p_retailprice, 2) AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def dearest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_name", F.round("p_retailprice", 2).alias("price"))
