"""Scans, projections, joins, aggregations, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..operators import features, joins, stats
from ..operators.totals import exact_quantiles, with_totals
from ..plans import flow
from . import Registry

R = Registry()
add = R.add
c = F.col


def r2(x):
    return F.round(x, 2)


def revenue():
    return c("l_extendedprice") * (1 - c("l_discount"))


def per_customer():
    return W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


REV = "l_extendedprice * (1 - l_discount)"

# --- scans and projections
add("src_view_sql", lambda t: t.sql("SELECT r_regionkey, r_name FROM {region}", "region"), "SELECT r_regionkey, r_name FROM region")
add("src_path_sql", lambda t: t.spark.sql(f"SELECT n_nationkey, n_name FROM parquet.`{t.sf_dir}/nation.parquet`"), "SELECT n_nationkey, n_name FROM nation")
add("src_bound_parameters", lambda t: t.spark.sql("SELECT c_custkey, c_acctbal FROM {customer} WHERE c_acctbal > :least AND c_mktsegment = :segment", args={"least": 5000.0, "segment": "BUILDING"}, customer=t.customer), "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
add("src_date_spine", lambda t: t.orders.agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day")), "SELECT CAST(unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY)) AS DATE) AS day FROM orders")
add("prj_columns", lambda t: t.customer.select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer")
add("prj_star", lambda t: t.nation.select("*"), "SELECT * FROM nation")
add("prj_qualified_star", lambda t: t.nation.alias("n").join(t.region.alias("r"), c("n.n_regionkey") == c("r.r_regionkey")).select("n.*", "r.r_name"), "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
add("prj_computed", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.round(revenue(), 4).alias("revenue"), F.round(c("l_extendedprice") * 0.1, 4).alias("bonus")), f"SELECT l_orderkey, l_linenumber, round({REV}, 4) AS revenue, round(l_extendedprice * 0.1, 4) AS bonus FROM lineitem")
add("prj_rename_drop", lambda t: t.supplier.withColumnsRenamed({"s_name": "supplier"}).drop("s_acctbal"), "SELECT s_suppkey, s_name AS supplier, s_nationkey FROM supplier")
add("prj_cte_ratio", lambda t: t.lineitem.groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("total"), F.sum(c("l_extendedprice") * c("l_discount")).alias("off")).select("l_returnflag", r2(c("off") * 100 / c("total")).alias("pct_off")), "WITH s AS (SELECT l_returnflag, sum(l_extendedprice) AS total, sum(l_extendedprice * l_discount) AS off FROM lineitem GROUP BY 1) SELECT l_returnflag, round(off * 100 / total, 2) AS pct_off FROM s")
add("prj_filter_compare", lambda t: t.orders.where("o_totalprice > 200000").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
add("prj_filter_logic", lambda t: t.customer.where(((c("c_mktsegment") == "AUTOMOBILE") | (c("c_acctbal") < 0)) & ~c("c_nationkey").isin(1, 2, 3)).select("c_custkey"), "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'AUTOMOBILE' OR c_acctbal < 0) AND c_nationkey NOT IN (1, 2, 3)")
add("prj_between", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(c("l_quantity").between(10, 20), F.lit(False)).alias("ok")), "SELECT l_orderkey, l_linenumber, coalesce(l_quantity BETWEEN 10 AND 20, false) AS ok FROM lineitem")
add("prj_scalar_subquery", lambda t: t.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders})", "orders"), "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
add("prj_date_window", lambda t: t.orders.where(c("o_orderdate") >= F.date_sub(F.lit("1998-01-01").cast("date"), 90)).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-01-01' - INTERVAL 90 DAY")
add("prj_regex_filter", lambda t: t.part.where(c("p_type").rlike("E$|^S")).select("p_partkey"), "SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'E$|^S')")
add("prj_implication", lambda t: t.orders.select("o_orderkey", (~(c("o_totalprice") > 300000) | (c("o_orderpriority") != "5-LOW")).alias("ok")), "SELECT o_orderkey, (NOT (o_totalprice > 300000) OR o_orderpriority <> '5-LOW') AS ok FROM orders")
add("prj_all_positive", lambda t: t.lineitem.where((c("l_quantity") > 0) & (c("l_tax") > 0) & (c("l_discount") > 0)).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 0 AND l_tax > 0 AND l_discount > 0")
add("prj_issue_count", lambda t: t.customer.select("c_custkey", ((c("c_acctbal") < 0).cast("int") + (c("c_nationkey") > 20).cast("int") + (F.length("c_name") > 17).cast("int")).alias("issues")).where("issues > 1"), "SELECT * FROM (SELECT c_custkey, (c_acctbal < 0)::INT + (c_nationkey > 20)::INT + (length(c_name) > 17)::INT AS issues FROM customer) WHERE issues > 1")
add("prj_drop_nulls", lambda t: t.events.withColumn("v", F.when(c("value") > 50, c("value"))).na.drop("all").na.drop(subset=["v"]).select("event_id"), "SELECT event_id FROM events WHERE value > 50")
add("prj_grid", lambda t: t.region.select("r_name").crossJoin(t.orders.select("o_orderstatus").distinct()), "SELECT r_name, o_orderstatus FROM region CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders)")
add("prj_pairwise_columns", lambda t: t.part.select("p_partkey", *[r2(c(a).cast("double") * c(b)).alias(f"{a}_x_{b}") for a, b in (("p_size", "p_size"), ("p_size", "p_retailprice"), ("p_retailprice", "p_retailprice"))]), "SELECT p_partkey, round(p_size::DOUBLE * p_size, 2) AS p_size_x_p_size, round(p_size::DOUBLE * p_retailprice, 2) AS p_size_x_p_retailprice, round(p_retailprice * p_retailprice, 2) AS p_retailprice_x_p_retailprice FROM part")
add("prj_lookup_array", lambda t: t.orders.select("o_orderkey", F.element_at(F.array(F.lit("w"), F.lit("s"), F.lit("f"), F.lit("a")), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int")).alias("tag")), "SELECT o_orderkey, ['w','s','f','a'][(o_orderkey % 4) + 1] AS tag FROM orders")
add("prj_case", lambda t: t.part.select("p_partkey", F.when(c("p_size") < 10, "small").when(c("p_size") < 30, "medium").otherwise("large").alias("class"), F.when(c("p_retailprice") > 1200, r2(c("p_retailprice") * 2)).otherwise(c("p_retailprice")).alias("price")), "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, CASE WHEN p_retailprice > 1200 THEN round(p_retailprice * 2, 2) ELSE p_retailprice END AS price FROM part")
add("prj_map_lookup", lambda t: t.orders.select("o_orderkey", F.try_element_at(F.create_map(F.lit("O"), F.lit("open"), F.lit("F"), F.lit("filled")), "o_orderstatus").alias("status")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS status FROM orders")
add("prj_cut_labels", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", num.cut(c("l_quantity"), [0, 10, 25, 50], ["low", "mid", "high"]).alias("band")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'low' WHEN l_quantity > 10 AND l_quantity <= 25 THEN 'mid' WHEN l_quantity > 25 AND l_quantity <= 50 THEN 'high' END AS band FROM lineitem")
add("prj_cut_equal_width", lambda t: with_totals(t.part, lo=F.min("p_size"), hi=F.max("p_size")).select("p_partkey", F.greatest(F.ceil((c("p_size") - c("lo")) * 4 / (c("hi") - c("lo"))), F.lit(1)).cast("int").alias("bin")), "SELECT p_partkey, greatest(ceil((p_size - lo) * 4.0 / (hi - lo)), 1)::INT AS bin FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)")
add("prj_digitize", lambda t: t.orders.select("o_orderkey", num.digitize(c("o_totalprice"), [F.lit(e) for e in exact_quantiles(t.orders, "o_totalprice", [0.25, 0.5, 0.75])]).alias("bin")), "SELECT o_orderkey, (o_totalprice >= a)::INT + (o_totalprice >= b)::INT + (o_totalprice >= d)::INT AS bin FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS d FROM orders)")

# --- joins
add("join_inner", lambda t: t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
add("join_star", lambda t: t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).where("o_totalprice > 100000").groupBy("n_name").agg(F.round(F.sum(revenue()), 4).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders")), f"SELECT n_name, round(sum({REV}), 4) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000 GROUP BY n_name")
add("join_merge_suffixes", lambda t: joins.merge_spread(t.customer.select(c("c_nationkey").alias("key"), c("c_name").alias("name")), t.supplier.select(c("s_nationkey").alias("key"), c("s_name").alias("name")), ["key"]), "SELECT c_nationkey AS key, c_name AS name_x, s_name AS name_y FROM customer JOIN supplier ON c_nationkey = s_nationkey")
add("join_left", lambda t: t.customer.join(t.orders.where("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey"), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
add("join_child_totals", lambda t: t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey")).groupBy("o_orderkey").agg(r2(F.sum(c("l_quantity") * c("l_extendedprice"))).alias("total"), F.count("*").alias("n_items")), "SELECT o_orderkey, round(sum(l_quantity * l_extendedprice), 2) AS total, count(*) AS n_items FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
add("join_semi", lambda t: t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
add("join_invalid_keys", lambda t: joins.invalid_keys(t.labels.withColumn("doc_id", F.when(c("doc_id") % 7 == 0, c("doc_id") + 10**9).when(c("doc_id") % 5 > 0, c("doc_id"))), "doc_id", t.documents, "doc_id", allow_null=False), "WITH l AS (SELECT CASE WHEN doc_id % 7 = 0 THEN doc_id + 1000000000 WHEN doc_id % 5 > 0 THEN doc_id END AS doc_id, quality, toxic FROM labels) SELECT * FROM l WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents)")
add("join_orphan_values", lambda t: joins.orphan_values(t.events.withColumn("user_id", c("user_id") * 100), "user_id", t.customer, "c_custkey"), "SELECT DISTINCT user_id * 100 AS value FROM events WHERE user_id * 100 NOT IN (SELECT c_custkey FROM customer)")
add("join_childless", lambda t: joins.childless(t.documents, "doc_id", t.labels.withColumnRenamed("doc_id", "of"), "of").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
add("join_cascade_counts", lambda t: joins.cascade_counts(t.customer, "c_custkey", t.orders, "o_custkey").select("c_custkey", "child_count"), "SELECT c_custkey, count(*) AS child_count FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
add("join_key_overlap", lambda t: joins.overlap([t.customer.select(c("c_nationkey").alias("k")), t.supplier.select(c("s_nationkey").alias("k"))], "k"), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
add("join_self_reference", lambda t: t.orders.where(c("o_orderkey") == c("o_custkey")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey = o_custkey")
add("join_add_aligned", lambda t: joins.add_aligned(t.customer.groupBy(c("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("v")), t.supplier.groupBy(c("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("v")), "k", "v").select("k", r2("v").alias("v")), "SELECT coalesce(a.k, b.k) AS k, round(coalesce(a.v, 0) + coalesce(b.v, 0), 2) AS v FROM (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, sum(s_acctbal) AS v FROM supplier GROUP BY 1) b ON a.k = b.k")
add("join_map_back", lambda t: t.part.select("p_partkey", r2(c("p_retailprice") - F.avg("p_retailprice").over(W.partitionBy("p_brand"))).alias("over_mean")), "SELECT p_partkey, round(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand), 2) AS over_mean FROM part")
add("join_upsert", lambda t: joins.upsert(t.supplier.select("s_suppkey", "s_acctbal"), t.supplier.where("s_acctbal < 2000").select(F.when(c("s_acctbal") < 0, -1 - c("s_suppkey")).otherwise(c("s_suppkey")).alias("s_suppkey"), F.lit(0.0).alias("s_acctbal")), ["s_suppkey"]), "WITH n AS (SELECT CASE WHEN s_acctbal < 0 THEN -1 - s_suppkey ELSE s_suppkey END AS s_suppkey, 0.0::DOUBLE AS s_acctbal FROM supplier WHERE s_acctbal < 2000) SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM n) UNION ALL SELECT * FROM n")
add("join_delete_cascade", lambda t: joins.delete_cascade(c("c_acctbal") < 0, t.customer, "c_custkey", [(t.orders, "o_custkey")])[1].select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")

# --- aggregations
add("agg_counts", lambda t: t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(c("o_orderstatus") == "F").alias("n_filled"), F.sum(F.when(c("o_totalprice") > 100000, 1).otherwise(0)).alias("n_large"), F.countDistinct("o_custkey").alias("n_customers"), F.count(F.when(c("o_totalprice") > 200000, 1)).alias("n_top")), "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_filled, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)::BIGINT AS n_large, count(DISTINCT o_custkey) AS n_customers, count(CASE WHEN o_totalprice > 200000 THEN 1 END) AS n_top FROM orders GROUP BY 1")
add("agg_named_rounded", lambda t: t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(r2(F.sum("l_quantity")).alias("sum_qty"), F.round(F.sum(revenue()), 4).alias("revenue"), r2(F.avg("l_extendedprice")).alias("avg_price"), F.min("l_discount").alias("min_disc"), F.max("l_discount").alias("max_disc"), F.count("*").alias("n")), f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({REV}), 4) AS revenue, round(avg(l_extendedprice), 2) AS avg_price, min(l_discount) AS min_disc, max(l_discount) AS max_disc, count(*) AS n FROM lineitem GROUP BY 1, 2")
add("agg_over_aggregates", lambda t: t.lineitem.groupBy("l_linestatus").agg(r2(F.max("l_extendedprice") - F.min("l_extendedprice")).alias("span"), r2(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("unit")), "SELECT l_linestatus, round(max(l_extendedprice) - min(l_extendedprice), 2) AS span, round(sum(l_extendedprice) / sum(l_quantity), 2) AS unit FROM lineitem GROUP BY 1")
add("agg_quantiles", lambda t: t.orders.groupBy("o_orderstatus").agg(r2(F.median("o_totalprice")).alias("median"), *[r2(F.percentile("o_totalprice", q)).alias(f"p{int(q * 100)}") for q in (0.05, 0.25, 0.75, 0.95)]), "SELECT o_orderstatus, round(median(o_totalprice), 2) AS median, round(quantile_cont(o_totalprice, 0.05), 2) AS p5, round(quantile_cont(o_totalprice, 0.25), 2) AS p25, round(quantile_cont(o_totalprice, 0.75), 2) AS p75, round(quantile_cont(o_totalprice, 0.95), 2) AS p95 FROM orders GROUP BY 1")
add("agg_quantile_exclusive", lambda t: t.spark.range(1).select(*[r2(F.lit(v)).alias(f"q{i}") for i, v in enumerate(stats.quantiles_exclusive(t.supplier, "s_acctbal", [0.25, 0.5, 0.75]), 1)]), "WITH s AS (SELECT s_acctbal AS x, row_number() OVER (ORDER BY s_acctbal) AS i, count(*) OVER () AS n FROM supplier), " + ", ".join(f"k{j} AS (SELECT max(CASE WHEN i = floor((n + 1) * {q}) THEN x END) AS lo, max(CASE WHEN i = floor((n + 1) * {q}) + 1 THEN x END) AS hi, max((n + 1) * {q} - floor((n + 1) * {q})) AS f FROM s)" for j, q in enumerate((0.25, 0.5, 0.75), 1)) + " SELECT " + ", ".join(f"round(k{j}.lo + k{j}.f * (k{j}.hi - k{j}.lo), 2) AS q{j}" for j in (1, 2, 3)) + " FROM k1, k2, k3")
add("agg_quartiles_plain", lambda t: t.spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(("q1", "q3"), stats.order_statistics(t.part, "p_retailprice", lambda n: [(n + 1) // 4, 3 * (n + 1) // 4]), strict=True)]), "WITH s AS (SELECT list_sort(list(p_retailprice)) AS v FROM part) SELECT v[floor((len(v) + 1) / 4)::INT] AS q1, v[floor(3 * (len(v) + 1) / 4)::INT] AS q3 FROM s")
add("agg_spread", lambda t: t.lineitem.groupBy("l_returnflag").agg(*[F.round(f("l_quantity"), 4).alias(n) for n, f in (("sd", F.stddev_samp), ("var", F.var_samp), ("sd_pop", F.stddev_pop), ("var_pop", F.var_pop))]), "SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS sd, round(var_samp(l_quantity), 4) AS var, round(stddev_pop(l_quantity), 4) AS sd_pop, round(var_pop(l_quantity), 4) AS var_pop FROM lineitem GROUP BY 1")
add("agg_mode", lambda t: stats.mode(t.lineitem, ["l_returnflag"], "l_quantity"), "SELECT l_returnflag, l_quantity AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_quantity) AS k FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE k = 1")
add("agg_shape", lambda t: t.orders.agg(F.round(num.adjusted_skew(c("o_totalprice")), 4).alias("skew"), F.round(num.adjusted_kurtosis(c("o_totalprice")), 4).alias("kurt")), "SELECT round(skewness(o_totalprice), 4) AS skew, round(kurtosis(o_totalprice), 4) AS kurt FROM orders")
add("agg_skew_population", lambda t: t.orders.agg(F.round(F.skewness("o_totalprice"), 4).alias("g1")), "SELECT round(avg(power((o_totalprice - m) / s, 3)), 4) AS g1 FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
add("agg_corr_covar_regression", lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(num.safe_corr(c("l_quantity"), c("l_extendedprice")), 6).alias("r"), r2(F.covar_samp("l_quantity", "l_extendedprice")).alias("cov"), r2(F.regr_slope("l_extendedprice", "l_quantity")).alias("slope"), r2(F.regr_intercept("l_extendedprice", "l_quantity")).alias("intercept"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r_squared")), "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_extendedprice), 2) AS cov, round(regr_slope(l_extendedprice, l_quantity), 2) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared FROM lineitem GROUP BY 1")
LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
add("agg_corr_pairs", lambda t: stats.correlation_pairs(t.lineitem, LI, 4), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, r, CASE WHEN abs(r) >= .9 THEN 'very strong' WHEN abs(r) >= .7 THEN 'strong' WHEN abs(r) >= .5 THEN 'moderate' WHEN abs(r) >= .3 THEN 'weak' ELSE 'none' END AS strength FROM (SELECT round(corr({a}, {b}), 4) AS r FROM lineitem)" for i, a in enumerate(LI) for b in LI[i + 1 :]))
add("agg_spearman", lambda t: stats.average_ranks(stats.average_ranks(t.part, "p_size", "a"), "p_retailprice", "b").agg(F.round(F.corr("a", "b"), 6).alias("rho")), "SELECT round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)")
add("agg_conditional_mean", lambda t: t.events.groupBy("event_type").agg(F.round(F.avg((c("value") > 50).cast("int")), 6).alias("share")), "SELECT event_type, round(avg((value > 50)::INT), 6) AS share FROM events GROUP BY 1")
add("agg_computed_key", lambda t: t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")), "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
add("agg_dependent_keys", lambda t: t.part.join(t.lineitem, c("p_partkey") == c("l_partkey")).groupBy("p_partkey", "p_brand", "p_retailprice").agg(r2(F.sum("l_extendedprice") - c("p_retailprice") * F.sum("l_quantity")).alias("margin")), "SELECT p_partkey, p_brand, p_retailprice, round(sum(l_extendedprice) - p_retailprice * sum(l_quantity), 2) AS margin FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2, 3")
add("agg_value_counts", lambda t: stats.value_counts(t.customer, "c_mktsegment", True).select("c_mktsegment", "n", F.round("share", 6).alias("share")), "SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")
add("agg_describe", lambda t: stats.describe(t.part, ["p_size", "p_retailprice"], 3), " UNION ALL ".join(f"SELECT '{k}' AS \"column\", count({k}) AS count, round(avg({k}), 3) AS mean, round(stddev_samp({k}), 3) AS std, round(min({k})::DOUBLE, 3) AS min, round(quantile_cont({k}, .25), 3) AS q25, round(quantile_cont({k}, .5), 3) AS median, round(quantile_cont({k}, .75), 3) AS q75, round(max({k})::DOUBLE, 3) AS max FROM part" for k in ("p_size", "p_retailprice")))
add("agg_profile", lambda t: stats.profile(t.customer, ["c_acctbal", "c_nationkey"], 3), " UNION ALL ".join(f"SELECT '{k}' AS \"column\", count(*) FILTER (WHERE {k} IS NULL) AS nulls, count(DISTINCT {k}) AS n_unique, round(avg({k}), 3) AS mean, round(stddev_samp({k}), 3) AS std, round(skewness({k}), 3) AS skew, round(kurtosis({k}), 3) AS kurtosis, count(*) FILTER (WHERE {k} = 0) AS zeros, count(*) FILTER (WHERE {k} < 0) AS negatives FROM customer" for k in ("c_acctbal", "c_nationkey")))
add("agg_profile_text", lambda t: stats.profile_text(t.customer, "c_mktsegment"), "SELECT sum(n)::BIGINT AS n, count(*) AS n_unique, first(v ORDER BY n DESC, v) AS top, max(n) AS top_count, count(*) / sum(n) > 0.5 AS high_cardinality FROM (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1)")
add("agg_null_summary", lambda t: stats.null_summary(t.events.select(F.when(c("value") > 20, c("value")).alias("v"), "user_id"), ["v", "user_id"]), "SELECT *, CASE WHEN pct = 0 THEN 'complete' WHEN pct < 5 THEN 'good' WHEN pct < 20 THEN 'moderate' WHEN pct < 50 THEN 'poor' WHEN pct < 80 THEN 'critical' ELSE 'mostly empty' END AS status FROM (SELECT 'v' AS \"column\", count(*) FILTER (WHERE NOT value > 20) AS nulls, round(avg((NOT value > 20)::INT) * 100, 4) AS pct FROM events UNION ALL SELECT 'user_id', count(*) FILTER (WHERE user_id IS NULL), round(avg((user_id IS NULL)::INT) * 100, 4) FROM events)")
add("agg_null_overlap", lambda t: t.events.select(F.when(c("value") > 20, c("value")).alias("a"), F.when(c("value") > 40, c("user_id")).alias("b")).agg(F.round(num.safe_corr(c("a").isNull().cast("int"), c("b").isNull().cast("int")), 6).alias("r"), F.count_if(c("a").isNull() & c("b").isNull()).alias("both")), "SELECT round(corr((NOT value > 20)::INT, (NOT value > 40)::INT), 6) AS r, count(*) FILTER (WHERE NOT value > 20) AS both FROM events")
add("agg_distinct", lambda t: t.part.select("p_brand").distinct(), "SELECT DISTINCT p_brand FROM part")
add("agg_dedup_first", lambda t: joins.drop_duplicates(t.orders, ["o_custkey"], [c("o_orderdate"), c("o_orderkey")]).select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
add("agg_dedup_last", lambda t: joins.drop_duplicates(t.orders, ["o_custkey"], [c("o_orderdate"), c("o_orderkey")], "last").select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
add("agg_duplicate_groups", lambda t: joins.duplicate_rows(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"]), "SELECT p_partkey, p_brand, p_size, n AS group_size, md5(p_brand || '|' || p_size) AS group_hash FROM (SELECT p_partkey, p_brand, p_size, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part) WHERE n > 1")
add("agg_duplicate_stats", lambda t: t.documents.groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum(c("n") - 1), F.lit(0)).alias("removable")), "SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS removable FROM (SELECT count(*) AS n FROM documents GROUP BY text) WHERE n > 1")
add("agg_most_complete", lambda t: joins.most_complete(t.orders.select("o_custkey", "o_orderkey", F.when(c("o_totalprice") > 150000, c("o_totalprice")).alias("p")), ["o_custkey"], [c("o_orderkey")]).select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_totalprice > 150000)::INT DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
add("agg_merge_rows", lambda t: joins.merge_rows(t.orders.select("o_custkey", "o_orderkey", F.when(c("o_totalprice") > 150000, c("o_totalprice")).alias("p")), ["o_custkey"], [c("o_orderkey")]), "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice > 150000) AS p FROM orders GROUP BY 1")
add("agg_composite_key", lambda t: t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1"), "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
add("agg_percent_of_total", lambda t: t.customer.groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("s")).select("c_mktsegment", r2(c("s") * 100 / F.sum("s").over(W.partitionBy())).alias("pct")), "SELECT c_mktsegment, round(sum(c_acctbal) * 100 / sum(sum(c_acctbal)) OVER (), 2) AS pct FROM customer GROUP BY 1")
add("agg_rfm", lambda t: features.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice"), "SELECT o_custkey, date_diff('day', max(o_orderdate)::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) AS recency, count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary FROM orders GROUP BY 1")
add("agg_segment_profile", lambda t: t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("size"), r2(F.count("*") * 100 / F.sum(F.count("*")).over(W.partitionBy())).alias("pct"), r2(F.avg("c_acctbal")).alias("mean"), F.mode("c_nationkey", True).alias("nation")), "WITH m AS (SELECT c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, c_nationkey) AS k FROM customer GROUP BY 1, 2) SELECT a.c_mktsegment, a.size, a.pct, a.mean, m.c_nationkey AS nation FROM (SELECT c_mktsegment, count(*) AS size, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS pct, round(avg(c_acctbal), 2) AS mean FROM customer GROUP BY 1) a JOIN m ON a.c_mktsegment = m.c_mktsegment AND m.k = 1")
add("agg_funnel", lambda t: t.orders.agg(F.count("*").alias("a"), F.count_if(c("o_totalprice") > 100000).alias("b"), F.count_if(c("o_totalprice") > 200000).alias("d")).select(r2(F.try_divide(c("b") * 100, "a")).alias("to_b"), r2(F.try_divide(c("d") * 100, "b")).alias("to_c")), "SELECT round(count(*) FILTER (WHERE o_totalprice > 100000) * 100 / count(*), 2) AS to_b, round(count(*) FILTER (WHERE o_totalprice > 200000) * 100 / count(*) FILTER (WHERE o_totalprice > 100000), 2) AS to_c FROM orders")
add("agg_probability", lambda t: t.orders.agg(F.round(F.avg(((c("o_orderstatus") == "F") & (c("o_totalprice") > 100000)).cast("int")), 6).alias("joint"), F.round(F.count_if((c("o_orderstatus") == "F") & (c("o_totalprice") > 100000)) / F.count_if(c("o_orderstatus") == "F"), 6).alias("conditional")), "SELECT round(avg((o_orderstatus = 'F' AND o_totalprice > 100000)::INT), 6) AS joint, round(count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000) / count(*) FILTER (WHERE o_orderstatus = 'F'), 6) AS conditional FROM orders")
add("agg_sparse_matrix", lambda t: t.lineitem.groupBy("l_suppkey").agg(r2(F.sum("l_quantity")).alias("total"), F.count_if(c("l_tax") != 0).alias("nnz"), F.round(F.avg(F.when(c("l_tax") != 0, c("l_tax"))), 6).alias("mean_nz")), "SELECT l_suppkey, round(sum(l_quantity), 2) AS total, count(*) FILTER (WHERE l_tax <> 0) AS nnz, round(avg(CASE WHEN l_tax <> 0 THEN l_tax END), 6) AS mean_nz FROM lineitem GROUP BY 1")
add("agg_rowwise", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.array(c("l_quantity"), c("l_tax") * 100, c("l_discount") * 100).alias("v")).select("l_orderkey", "l_linenumber", F.round(F.array_max("v") - F.array_min("v"), 4).alias("span"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / 3, 4).alias("mean")), "SELECT l_orderkey, l_linenumber, round(greatest(l_quantity, l_tax * 100, l_discount * 100) - least(l_quantity, l_tax * 100, l_discount * 100), 4) AS span, round((l_quantity + l_tax * 100 + l_discount * 100) / 3, 4) AS mean FROM lineitem")
add("agg_pivot", lambda t: t.orders.groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0), "SELECT year(o_orderdate) AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
add("agg_rollup", lambda t: t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
add("agg_cube", lambda t: t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
add("agg_crosstab", lambda t: stats.crosstab(t.customer, "c_mktsegment", "c_nationkey").select("c_mktsegment", "c_nationkey", "observed", F.round("expected", 4).alias("expected")), "SELECT c_mktsegment, c_nationkey, count(*) AS observed, round(sum(count(*)) OVER (PARTITION BY c_mktsegment) * sum(count(*)) OVER (PARTITION BY c_nationkey) / sum(count(*)) OVER (), 4) AS expected FROM customer GROUP BY 1, 2")
add("agg_chi_square", lambda t: stats.chi_square(t.orders, "o_orderstatus", "o_orderpriority").select(F.round("chi2", 4).alias("chi2"), "dof"), "WITH g AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS x FROM g) SELECT round(sum(o * o / x) - sum(o), 4) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM e")
add("agg_anova", lambda t: stats.anova(t.customer, "c_mktsegment", "c_acctbal").select(F.round("f", 4).alias("f"), "df_between", "df_within"), "WITH p AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), g AS (SELECT avg(c_acctbal) AS g FROM customer) SELECT round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 4) AS f, count(*) - 1 AS df_between, (sum(n) - count(*))::BIGINT AS df_within FROM p, g")
add("agg_t_test", lambda t: stats.t_test(t.customer, "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal").select(F.round("t", 5).alias("t")), "SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) AS t FROM (SELECT avg(c_acctbal) AS m, var_samp(c_acctbal) AS v, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING') a, (SELECT avg(c_acctbal) AS m, var_samp(c_acctbal) AS v, count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY') b")
add("agg_approx_quantile", lambda t: t.orders.agg(F.approx_percentile("o_totalprice", F.array(F.lit(0.25), F.lit(0.75)), 100).alias("q")))

# --- windows
add("win_running_range", lambda t: t.orders.select("o_orderkey", F.count("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderdate")).alias("n"), r2(F.sum("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderdate"))).alias("s")), "SELECT o_orderkey, count(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS n, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS s FROM orders")
add("win_share_of_counts", lambda t: t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("pct", r2(c("n") * 100.0 / F.sum("n").over(W.partitionBy()))), "SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM orders GROUP BY 1")
add("win_ranks", lambda t: t.part.select("p_partkey", F.rank().over(W.partitionBy("p_brand").orderBy(c("p_size").desc())).alias("rank"), F.dense_rank().over(W.partitionBy("p_brand").orderBy(c("p_size").desc())).alias("dense"), F.row_number().over(W.partitionBy("p_brand").orderBy(c("p_size").desc(), "p_partkey")).alias("row"), stats.average_rank("p_size", ["p_brand"]).alias("avg_rank")), "SELECT p_partkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS row, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS avg_rank FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC)")
add("win_quantile_bins", lambda t: features.quantile_bins(t.supplier, "s_acctbal", 5, "bin").select("s_suppkey", "bin"), "SELECT s_suppkey, 1 + (s_acctbal > a)::INT + (s_acctbal > b)::INT + (s_acctbal > d)::INT + (s_acctbal > e)::INT AS bin FROM supplier, (SELECT quantile_cont(s_acctbal, .2) AS a, quantile_cont(s_acctbal, .4) AS b, quantile_cont(s_acctbal, .6) AS d, quantile_cont(s_acctbal, .8) AS e FROM supplier)")
SW = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
add("win_cumulative", lambda t: t.orders.select("o_orderkey", *[F.round(f("o_totalprice").over(per_customer().rowsBetween(W.unboundedPreceding, 0)), 6).alias(n) for n, f in (("s", F.sum), ("m", F.max), ("a", F.avg))]), f"SELECT o_orderkey, round(sum(o_totalprice) OVER w, 6) AS s, round(max(o_totalprice) OVER w, 6) AS m, round(avg(o_totalprice) OVER w, 6) AS a FROM orders WINDOW w AS ({SW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
add("win_lags", lambda t: t.orders.select("o_orderkey", F.lag("o_totalprice", 1).over(per_customer()).alias("lag1"), F.lead("o_totalprice", 1).over(per_customer()).alias("lead1"), r2(c("o_totalprice") - F.lag("o_totalprice", 1).over(per_customer())).alias("diff"), F.round(F.try_divide(c("o_totalprice"), F.lag("o_totalprice", 1).over(per_customer())) - 1, 6).alias("pct")), f"SELECT o_orderkey, lag(o_totalprice) OVER w AS lag1, lead(o_totalprice) OVER w AS lead1, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS diff, round(o_totalprice / lag(o_totalprice) OVER w - 1, 6) AS pct FROM orders WINDOW w AS ({SW})")
add("win_cumprod", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.abs(F.round(F.exp(F.sum(F.ln(1 + c("l_tax"))).over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_tax").rowsBetween(W.unboundedPreceding, 0))) - 1, 6)).alias("growth")), "SELECT l_orderkey, l_linenumber, abs(round(exp(sum(ln(1 + l_tax)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_tax ROWS UNBOUNDED PRECEDING)) - 1, 6)) AS growth FROM lineitem")
add("win_group_percentile", lambda t: with_totals(t.lineitem, ["l_returnflag"], p=F.percentile("l_extendedprice", 0.95)).where("l_extendedprice > p").select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem JOIN (SELECT l_returnflag AS f, quantile_cont(l_extendedprice, 0.95) AS p FROM lineitem GROUP BY 1) ON l_returnflag = f WHERE l_extendedprice > p")
add("win_within_std", lambda t: features.scale(t.orders, "o_totalprice", "z_sample", "z").where("abs(z) <= 2").select("o_orderkey"), "SELECT o_orderkey FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) WHERE abs(o_totalprice - m) <= 2 * s")
add("win_group_total", lambda t: t.orders.select("o_orderkey", r2(F.sum("o_totalprice").over(W.partitionBy("o_custkey"))).alias("ltv")), "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS ltv FROM orders")
add("win_peaks", lambda t: t.orders.select("o_orderkey", ((c("o_totalprice") > F.lag("o_totalprice").over(per_customer())) & (c("o_totalprice") > F.lead("o_totalprice").over(per_customer()))).alias("peak")).where("peak").select("o_orderkey"), f"SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice > lag(o_totalprice) OVER w AND o_totalprice > lead(o_totalprice) OVER w AS peak FROM orders WINDOW w AS ({SW})) WHERE peak")
add("win_last_vs_previous", lambda t: t.orders.withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy(c("o_orderdate").desc(), c("o_orderkey").desc()))).where("n <= 2").groupBy("o_custkey").agg(F.max(F.when(c("n") == 1, c("o_totalprice"))).alias("now"), F.max(F.when(c("n") == 2, c("o_totalprice"))).alias("before")).select("o_custkey", r2(num.change(c("now"), c("before"))).alias("change")), "SELECT o_custkey, round(CASE WHEN before = 0 THEN 0 ELSE (now - before) / before * 100 END, 2) AS change FROM (SELECT o_custkey, max(CASE WHEN n = 1 THEN o_totalprice END) AS now, max(CASE WHEN n = 2 THEN o_totalprice END) AS before FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 2 GROUP BY 1)")
add("win_failure_run", lambda t: t.orders.groupBy("o_custkey").agg(F.max(F.when(c("o_orderstatus") == "F", c("o_orderdate"))).alias("ok"), F.collect_list("o_orderdate").alias("d")).select("o_custkey", F.size(F.filter("d", lambda x: c("ok").isNull() | (x > c("ok")))).alias("run")), "SELECT o_custkey, count(*) FILTER (WHERE ok IS NULL OR o_orderdate > ok)::INT AS run FROM (SELECT *, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) OVER (PARTITION BY o_custkey) AS ok FROM orders) GROUP BY 1")
add("win_transitions", lambda t: t.orders.withColumn("prev", F.lag("o_orderstatus").over(per_customer())).where(c("prev").isNotNull() & ~(F.concat("prev", "o_orderstatus").isin("FF", "FO", "OO"))).select("o_orderkey"), f"SELECT o_orderkey FROM (SELECT o_orderkey, lag(o_orderstatus) OVER ({SW}) || o_orderstatus AS p FROM orders) WHERE p NOT IN ('FF', 'FO', 'OO')")

# --- sorts and sets
add("sort_top_k", lambda t: t.customer.orderBy(c("c_acctbal").desc_nulls_last(), "c_custkey").limit(25).select("c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
add("sort_top_k_per_group", lambda t: t.part.withColumn("n", F.row_number().over(W.partitionBy("p_brand").orderBy(c("p_retailprice").desc(), "p_partkey"))).where("n <= 3").select("p_brand", "p_partkey", "n"), "SELECT p_brand, p_partkey, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 3")
add("sort_having", lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
add("sort_report_builder", lambda t: flow.metric_report(t.orders, "o_totalprice", "o_orderpriority", ("o_orderdate", "1995-01-01"), 1000, 3), "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1 HAVING round(sum(o_totalprice), 2) >= 1000 ORDER BY total DESC, o_orderpriority LIMIT 3")
add("sort_arg_max", lambda t: t.orders.groupBy("o_orderstatus").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("worst")), "SELECT o_orderstatus, last(o_orderkey ORDER BY o_totalprice, o_orderkey) AS best, first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS worst FROM orders GROUP BY 1")
add("sort_by_abs", lambda t: t.customer.orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(10).select("c_custkey"), "SELECT c_custkey FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 10")
add("set_union_by_name", lambda t: t.customer.select("c_custkey", "c_name").unionByName(t.supplier.select(c("s_suppkey").alias("c_custkey"), "s_acctbal"), allowMissingColumns=True), "SELECT c_custkey, c_name, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
add("set_difference", lambda t: t.part.select("p_size").subtract(t.nation.select("n_nationkey")), "SELECT p_size FROM part EXCEPT SELECT n_nationkey FROM nation")
add("set_intersection", lambda t: t.customer.select("c_nationkey").intersect(t.supplier.select("s_nationkey")), "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
add("set_union", lambda t: t.customer.select("c_nationkey").union(t.supplier.select("s_nationkey")).distinct(), "SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
add("set_except_all", lambda t: t.customer.select("c_nationkey").exceptAll(t.supplier.select("s_nationkey")), "SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
