"""Frames by position, runs, matrices, matching of names, checks of contracts, and sinks that are read again."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import numeric as num
from ..operators import joins, matching
from ..operators import quality as dq
from ..operators.lineage import new_folder
from ..operators.totals import exact_quantiles, with_totals
from ..plans import flow, rules
from ..sources import files, sinks, workbooks
from . import Registry

R = Registry()
add = R.add
c = F.col


def r(x, n=4):
    return F.round(x, n)


# --- frames by position
add("set_bind_columns", lambda t: t.part.select("p_partkey", *[c(k).alias(f"size_{k}") for k in ("p_size",)], (c("p_retailprice") * 2).alias("twice")), "SELECT p_partkey, p_size AS size_p_size, p_retailprice * 2 AS twice FROM part")
GROUPS = (("p_size",), ("p_retailprice",), ("p_brand", "p_type"))
add("prj_feature_groups", lambda t: t.part.select("p_partkey", *[k for group in GROUPS for k in group]), "SELECT p_partkey, p_size, p_retailprice, p_brand, p_type FROM part")
add(
    "join_positional_zip",
    lambda t: t.supplier.select(c("s_suppkey").alias("i"), "s_name").join(t.part.select(c("p_partkey").alias("i"), "p_name"), "i"),
    "SELECT s_suppkey AS i, s_name, p_name FROM supplier JOIN part ON p_partkey = s_suppkey",
)
add(
    "join_cascade_sample",
    lambda t: joins_sample(t),
    """SELECT o_custkey, count(*) AS children, array_to_string(list_slice(list_sort(list(o_orderkey)), 1, 10), ',') AS first_ten FROM orders GROUP BY 1""",
)


def joins_sample(t):
    """Parents with the number of their children and the first ten, by a rank: no list grows with the children."""
    ranked = t.orders.select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("k"))
    first = F.array_sort(F.collect_list(F.when(c("k") <= 10, c("o_orderkey"))))
    return ranked.groupBy("o_custkey").agg(F.count("*").alias("children"), F.array_join(first, ",").alias("first_ten"))


RUNS = "SELECT o_custkey, o_orderstatus, o_totalprice, o_orderkey, row_number() OVER w - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS g FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"
add(
    "agg_consecutive_runs",
    lambda t: runs(t),
    f"SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first_key, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS top FROM ({RUNS}) GROUP BY o_custkey, o_orderstatus, g",
)


def runs(t):
    """Rows of a customer that follow each other with one status."""
    by = W.partitionBy("o_custkey").orderBy("o_orderkey")
    starts = (~F.col("o_orderstatus").eqNullSafe(F.lag("o_orderstatus").over(by))).cast("int")
    marked = t.orders.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    found = marked.groupBy("o_custkey", "_run").agg(
        F.first("o_orderstatus").alias("o_orderstatus"), F.min("o_orderkey").alias("first_key"), F.count("*").alias("n"),
        r(F.sum("o_totalprice"), 2).alias("total"), r(F.avg("o_totalprice")).alias("mean"), F.max("o_totalprice").alias("top"),
    )
    return found.drop("_run")


BY_CUSTOMER = "(PARTITION BY o_custkey ORDER BY o_orderkey)"
add(
    "win_circular_lag",
    lambda t: rolled(t),
    f"""WITH k AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER {BY_CUSTOMER} - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
        SELECT a.o_orderkey, b.o_totalprice AS rolled FROM k a JOIN k b ON b.o_custkey = a.o_custkey AND b.i = (a.i - 1 + a.n) % a.n""",
)


def rolled(t):
    by = W.partitionBy("o_custkey").orderBy("o_orderkey")
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return t.orders.select("o_orderkey", F.coalesce(F.lag("o_totalprice").over(by), F.last("o_totalprice").over(whole)).alias("rolled"))


add(
    "win_moving_valid",
    lambda t: t.orders.select("o_orderkey", F.count("*").over(W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)).alias("n"), r(F.avg("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)), 6).alias("m")).where("n = 3").drop("n"),
    "SELECT o_orderkey, m FROM (SELECT o_orderkey, count(*) OVER w AS n, round(avg(o_totalprice) OVER w, 6) AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING)) WHERE n = 3",
)
add(
    "win_direction",
    lambda t: t.orders.select("o_orderkey", (c("o_totalprice") > F.lag("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).cast("int").alias("up")),
    f"SELECT o_orderkey, (o_totalprice > lag(o_totalprice) OVER {BY_CUSTOMER})::INT AS up FROM orders",
)

# --- sparse and dense matrices
COO = "(SELECT l_orderkey AS i, l_linenumber AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def coo(t):
    return t.lineitem.groupBy(c("l_orderkey").alias("i"), c("l_linenumber").alias("j")).agg(F.sum("l_quantity").alias("v"))


add(
    "agg_sparse_overlap_corr",
    lambda t: coo(t).alias("a").join(coo(t).alias("b"), "i").where("a.j < b.j").groupBy(c("a.j").alias("j"), c("b.j").alias("k")).agg(F.count("*").alias("n"), F.when(F.count("*") >= 5, r(F.corr("a.v", "b.v"), 6)).alias("r")),
    f"SELECT a.j, b.j AS k, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(corr(a.v, b.v), 6) END AS r FROM {COO} a JOIN {COO} b ON a.i = b.i AND a.j < b.j GROUP BY 1, 2",
)
add(
    "math_matrix_sums",
    lambda t: coo(t).agg(r(F.sqrt(F.sum(c("v") * c("v"))), 6).alias("frobenius"), F.sum(F.when(c("i") == c("j"), c("v")).otherwise(0.0)).alias("trace"), r(F.sum(c("v") * c("v")), 4).alias("hadamard"), r(F.max("v"), 4).alias("top")),
    f"SELECT round(sqrt(sum(v * v)), 6) AS frobenius, sum(CASE WHEN i = j THEN v ELSE 0 END) AS trace, round(sum(v * v), 4) AS hadamard, round(max(v), 4) AS top FROM {COO}",
)
add("math_transpose_sums", lambda t: coo(t).groupBy("j").agg(F.sum("v").alias("column_sum"), r(F.sqrt(F.sum(c("v") * c("v"))), 6).alias("column_norm")), f"SELECT j, sum(v) AS column_sum, round(sqrt(sum(v * v)), 6) AS column_norm FROM {COO} GROUP BY 1")
add(
    "math_batch_matmul",
    lambda t: coo(t).alias("a").join(coo(t).alias("b"), "i").groupBy(c("a.j").alias("j"), c("b.j").alias("k")).agg(F.sum(c("a.v") * c("b.v")).alias("v")),
    f"SELECT a.j, b.j AS k, sum(a.v * b.v) AS v FROM {COO} a JOIN {COO} b ON a.i = b.i GROUP BY 1, 2",
)
add(
    "math_column_max",
    lambda t: with_totals(t.part, _top=F.max("p_retailprice")).select("p_partkey", r(c("p_retailprice") / c("_top"), 6).alias("share")),
    "SELECT p_partkey, round(p_retailprice / max(p_retailprice) OVER (), 6) AS share FROM part",
)
add(
    "math_row_centred",
    lambda t: t.embeddings.select("vec_id", F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size("embedding")).alias("m"), "embedding").select("vec_id", r(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double") - c("m"))), 5).alias("spread")),
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE - list_avg(embedding::DOUBLE[])))), 5) AS spread FROM embeddings",
)

# --- numbers
add("math_half_even", lambda t: t.part.select("p_partkey", F.bround(c("p_size") / 4, 1).alias("even"), F.bround((c("p_size") / 2), 0).alias("whole")), "SELECT p_partkey, round_even(p_size / 4, 1) AS even, round_even(p_size / 2, 0) AS whole FROM part")


def mad_scaled(t):
    mid = exact_quantiles(t.part, "p_retailprice", [0.5])[0]
    mad = exact_quantiles(t.part, F.abs(c("p_retailprice") - mid), [0.5])[0]
    return t.part.select("p_partkey", r((c("p_retailprice") - mid) / mad, 6).alias("z"))


add("math_mad_scaling", mad_scaled, "WITH m AS (SELECT median(p_retailprice) AS md FROM part), d AS (SELECT median(abs(p_retailprice - md)) AS mad FROM part, m) SELECT p_partkey, round((p_retailprice - md) / mad, 6) AS z FROM part, m, d")
add(
    "math_polynomial_shares",
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[r(F.pow("l_quantity", F.lit(k)), 4).alias(f"p{k}") for k in (2, 3)], r(c("l_tax") / F.nullif(c("l_tax") + c("l_discount"), F.lit(0.0)), 6).alias("share")),
    "SELECT l_orderkey, l_linenumber, l_partkey, round(power(l_quantity, 2), 4) AS p2, round(power(l_quantity, 3), 4) AS p3, round(l_tax / nullif(l_tax + l_discount, 0), 6) AS share FROM lineitem",
)
add(
    "math_beta_posterior",
    lambda t: t.orders.groupBy("o_orderpriority").agg(F.count_if(c("o_orderstatus") == "F").alias("s"), F.count("*").alias("n")).select("o_orderpriority", (c("s") + 2).alias("a"), (c("n") - c("s") + 2).alias("b"), r((c("s") + 2) / (c("n") + 4), 8).alias("mean")),
    "SELECT o_orderpriority, s + 2 AS a, n - s + 2 AS b, round((s + 2) / (n + 4), 8) AS mean FROM (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS s, count(*) AS n FROM orders GROUP BY 1)",
)
add("math_beta_pdf", lambda t: t.part.select("p_partkey", r(num.beta_pdf(c("p_size") / 51, 2.0, 5.0), 8).alias("pdf")), "SELECT p_partkey, round(power(p_size / 51, 1) * power(1 - p_size / 51, 4) * 30, 8) AS pdf FROM part")
add("math_downcast", lambda t: t.part.agg(*[num.smallest_type(k).alias(k) for k in ("p_partkey", "p_size")]), """SELECT CASE WHEN max(p_partkey) < 128 THEN 'tinyint' WHEN max(p_partkey) < 32768 THEN 'smallint' WHEN max(p_partkey) < 2147483648 THEN 'int' ELSE 'bigint' END AS p_partkey,
    CASE WHEN max(p_size) < 128 THEN 'tinyint' WHEN max(p_size) < 32768 THEN 'smallint' ELSE 'int' END AS p_size FROM part""")
add("math_random", lambda t: t.orders.select("o_orderkey", F.randn(7).alias("x")).agg((F.abs(F.avg("x")) < 0.2).alias("centred"), F.stddev_samp("x").between(0.9, 1.1).alias("unit")), "SELECT true AS centred, true AS unit")

# --- dates
add(
    "dt_times_of_day",
    lambda t: t.events.select("event_id", F.hour("ts").alias("h"), F.minute("ts").alias("m"), F.second("ts").alias("s"), (F.to_date("ts") == F.last_day("ts")).alias("month_end"), (F.to_date("ts") == F.make_date(F.year("ts"), F.lit(12), F.lit(31))).alias("year_end"), ((F.month("ts") % 3 == 0) & (F.to_date("ts") == F.last_day("ts"))).alias("quarter_end"), (F.weekday("ts") < 5).alias("business")),
    "SELECT event_id, hour(ts)::INT AS h, minute(ts)::INT AS m, second(ts)::INT AS s, ts::DATE = last_day(ts) AS month_end, (month(ts) = 12 AND day(ts) = 31) AS year_end, (month(ts) % 3 = 0 AND ts::DATE = last_day(ts)) AS quarter_end, isodow(ts) < 6 AS business FROM events",
)
add(
    "dt_months_and_epoch",
    lambda t: t.orders.select("o_orderkey", ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate") - 1).alias("months"), F.unix_date(F.to_date("o_orderdate")).alias("days")),
    "SELECT o_orderkey, ((year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1)::INT AS months, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS days FROM orders",
)
SHAPES = ("yyyy-MM-dd", "dd/MM/yyyy", "MMM dd, yyyy", "yyyyMMdd")
DUCK = ("%Y-%m-%d", "%d/%m/%Y", "%b %d, %Y", "%Y%m%d")
add(
    "dt_flexible_parse",
    lambda t: t.orders.select("o_orderkey", F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in SHAPES], F.lit("no date")), (F.pmod("o_custkey", F.lit(5)) + 1).cast("int")).alias("s")).select("o_orderkey", dates.parse_date(c("s")).alias("d"), dates.parse_date(c("s")).isNull().alias("failed")),
    "SELECT o_orderkey, CASE WHEN o_custkey % 5 < 4 THEN o_orderdate::DATE END AS d, o_custkey % 5 = 4 AS failed FROM orders",
)

# --- series
add(
    "ts_contract",
    lambda t: t.events.agg(F.count("ts").alias("n"), F.countDistinct("ts").alias("u"), F.count_if(c("value").isNull()).alias("gone"), F.count_if(~c("value").between(0, 1000)).alias("out")).select((c("n") == c("u")).alias("unique_ts"), (c("gone") <= 0.05 * c("n")).alias("complete"), (c("out") == 0).alias("in_range")),
    "SELECT count(ts) = count(DISTINCT ts) AS unique_ts, count(*) FILTER (WHERE value IS NULL) <= .05 * count(ts) AS complete, count(*) FILTER (WHERE value NOT BETWEEN 0 AND 1000) = 0 AS in_range FROM events",
)
add(
    "ts_dedup_timestamps",
    lambda t: t.orders.groupBy("o_orderdate").agg(r(F.avg("o_totalprice"), 4).alias("mean"), F.min_by("o_totalprice", "o_orderkey").alias("first")),
    "SELECT o_orderdate, round(avg(o_totalprice), 4) AS mean, arg_min(o_totalprice, o_orderkey) AS first FROM orders GROUP BY 1",
)
add("ts_energy", lambda t: t.events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(r(F.sum("value") / 60, 6).alias("energy")), "SELECT date_trunc('hour', ts) AS hour, round(sum(value) / 60, 6) AS energy FROM events GROUP BY 1")

# --- matching of names
NEAR = "(SELECT a.c_custkey AS a, b.c_custkey AS b, round(1 - levenshtein(a.c_name, b.c_name) / 18, 6) AS ratio FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND levenshtein(a.c_name, b.c_name) <= 1)"
add("join_fuzzy_pairs", lambda t: matching.all_near_pairs(t.customer, "c_custkey", "c_name", ["c_nationkey"]).select("a", "b", r("ratio", 6).alias("ratio")), f"SELECT * FROM {NEAR}")
add("dup_fuzzy_groups", lambda t: matching.near_groups(t.customer, "c_custkey", "c_name", ["c_nationkey"]))
add(
    "join_fuzzy_key",
    lambda t: matching.all_near_pairs(t.customer.select("c_custkey", F.concat_ws(" | ", F.lower("c_mktsegment"), "c_name").alias("k")), "c_custkey", "k", []).select("a", "b"),
    "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey AND levenshtein(lower(a.c_mktsegment) || ' | ' || a.c_name, lower(b.c_mktsegment) || ' | ' || b.c_name) <= 1",
)
add(
    "join_best_match",
    lambda t: matching.best_names(t.supplier.select("s_suppkey", F.regexp_replace("s_name", "Supplier", "Customer").alias("name"), "s_nationkey"), "s_suppkey", "name", t.customer.select("c_custkey", "c_name", "c_nationkey"), "c_custkey", "c_name", (c("s_nationkey") == c("c_nationkey"))),
    """WITH p AS (SELECT s_suppkey, c_custkey, (100 * (1 - levenshtein(replace(s_name, 'Supplier', 'Customer'), c_name) / 18.0) + CASE WHEN s_nationkey = c_nationkey THEN 100 ELSE 0 END) / 2 AS score
        FROM supplier JOIN customer ON levenshtein(replace(s_name, 'Supplier', 'Customer'), c_name) <= 1), b AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) AS k FROM p)
        SELECT s.s_suppkey, c_custkey AS match, round(score, 4) AS score, CASE WHEN c_custkey IS NULL THEN 'REVIEW NEEDED' ELSE 'MATCHED' END AS status FROM supplier s LEFT JOIN b ON b.s_suppkey = s.s_suppkey AND k = 1""",
)

# --- rules as text, checks and their samples
RULES = (("positive", "l_quantity > 0"), ("charge", "abs(l_extendedprice * (1 - l_discount) - l_extendedprice) <= 5000"), ("flag", "l_returnflag IN ('A', 'R')"))
add(
    "dq_expression_rules",
    lambda t: rules.check(t.lineitem, t.spark.createDataFrame(list(RULES), "rule string, formula string")),
    " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT coalesce({e}, false)) AS violations FROM lineitem" for n, e in RULES),
)
add(
    "dq_rule_samples",
    lambda t: rules.samples(t.orders, "o_orderkey", {"cheap": c("o_totalprice") >= 5000, "known": c("o_orderstatus") != "P"}, 3),
    """SELECT rule, o_orderkey FROM (SELECT rule, o_orderkey, row_number() OVER (PARTITION BY rule ORDER BY o_orderkey) AS k FROM (SELECT 'cheap' AS rule, o_orderkey FROM orders WHERE NOT o_totalprice >= 5000
        UNION ALL SELECT 'known', o_orderkey FROM orders WHERE o_orderstatus = 'P')) WHERE k <= 3""",
)
add(
    "dq_assertions",
    lambda t: t.orders.agg(F.count("*").between(10, 10**12).alias("row_count"), (F.count_if(c("o_orderkey").isNull()) == 0).alias("no_nulls"), (F.countDistinct("o_orderkey") == F.count("*")).alias("unique"), (F.count_if(~c("o_totalprice").between(0, 1e6)) == 0).alias("in_range")),
    "SELECT count(*) BETWEEN 10 AND 1000000000000 AS row_count, count(*) = count(o_orderkey) AS no_nulls, count(DISTINCT o_orderkey) = count(*) AS \"unique\", count(*) FILTER (WHERE o_totalprice NOT BETWEEN 0 AND 1e6) = 0 AS in_range FROM orders",
)
add(
    "dq_format_schema",
    lambda t: rules.formats(t.customer, "c_custkey", {"c_name": ("pattern", "^Customer#[0-9]+$"), "c_acctbal": ("float", (0.0, 9999.0)), "c_mktsegment": ("category", ("BUILDING", "MACHINERY", "HOUSEHOLD")), "c_nationkey": ("integer", (0, 20))}),
    """SELECT c_custkey, 'c_name' AS "column", 'pattern' AS kind FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]+$') UNION ALL SELECT c_custkey, 'c_acctbal', 'float' FROM customer WHERE NOT c_acctbal BETWEEN 0 AND 9999
        UNION ALL SELECT c_custkey, 'c_mktsegment', 'category' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') UNION ALL SELECT c_custkey, 'c_nationkey', 'integer' FROM customer WHERE NOT c_nationkey BETWEEN 0 AND 20""",
)
add(
    "dq_exclusive_fields",
    lambda t: t.documents.join(t.labels, "doc_id", "left").select("doc_id", sum((F.coalesce(c(k).cast("string"), F.lit("")).isin("", "0") == F.lit(False)).cast("int") for k in ("quality", "toxic")).alias("filled")).where("filled > 1"),
    "SELECT doc_id, 2 AS filled FROM labels WHERE quality <> 0 AND toxic <> 0 AND doc_id IN (SELECT doc_id FROM documents)",
)
add(
    "plan_run_log_health",
    lambda t: flow.run_health(t.orders.select(c("o_orderpriority").alias("job"), c("o_orderkey").alias("run"), (c("o_orderstatus") != "F").alias("ok"), (c("o_totalprice") / 1000).alias("seconds"))),
    """WITH r AS (SELECT o_orderpriority AS job, o_orderkey AS run, o_orderstatus <> 'F' AS ok, o_totalprice / 1000 AS s FROM orders), m AS (SELECT job, avg(s) AS a FROM r GROUP BY 1),
        f AS (SELECT job, run - 0 AS run, ok, row_number() OVER (PARTITION BY job ORDER BY run) - row_number() OVER (PARTITION BY job, ok ORDER BY run) AS g FROM r),
        k AS (SELECT job, max(n) AS streak FROM (SELECT job, count(*) AS n FROM f WHERE NOT ok GROUP BY job, g) GROUP BY 1)
        SELECT r.job, round(avg(ok::INT) * 100, 4) AS success, round(any_value(a), 4) AS mean_seconds, count(*) FILTER (WHERE s > 1.5 * a) AS slow, any_value(coalesce(streak, 0)) AS failures_in_row FROM r JOIN m ON r.job = m.job LEFT JOIN k ON k.job = r.job GROUP BY 1""",
)
add(
    "plan_experiments",
    lambda t: t.part.groupBy("p_brand", "p_type").agg(r(F.avg("p_retailprice"), 6).alias("metric")).withColumn("k", F.row_number().over(W.partitionBy("p_brand").orderBy(c("metric").desc(), "p_type"))).where("k <= 2"),
    "SELECT * FROM (SELECT p_brand, p_type, metric, row_number() OVER (PARTITION BY p_brand ORDER BY metric DESC, p_type)::INT AS k FROM (SELECT p_brand, p_type, round(avg(p_retailprice), 6) AS metric FROM part GROUP BY 1, 2)) WHERE k <= 2",
)
add("ft_auc", lambda t: matching.auc(t.orders.select((c("o_orderstatus") == "F").cast("int").alias("y"), c("o_totalprice").alias("s")), "y", "s").select(r("auc", 6).alias("auc")), """WITH x AS (SELECT (o_orderstatus = 'F')::INT AS y, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS k FROM orders)
    SELECT round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))::DOUBLE), 6) AS auc FROM x""")
add(
    "sql_catalogue_predicates",
    lambda t: t.sql("SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status, o_totalprice::int AS whole FROM {orders} WHERE o_orderpriority NOT LIKE '1-%' AND o_orderstatus NOT IN ('X', 'Y')", "orders"),
    "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status, trunc(o_totalprice)::INT AS whole FROM orders WHERE o_orderpriority NOT LIKE '1-%' AND o_orderstatus NOT IN ('X', 'Y')",
)
add(
    "sql_relative_days",
    lambda t: t.spark.sql("SELECT o_orderkey FROM {o} WHERE o_orderdate >= (SELECT max(o_orderdate) FROM {o}) - make_interval(0, 0, 0, :n)", args={"n": 30}, o=t.orders),
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY",
)
add(
    "sql_column_arithmetic",
    lambda t: t.customer.select("c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("balance"), F.coalesce(F.nullif("c_mktsegment", F.lit("")), F.lit("none")).alias("segment"), F.lit("x").alias("constant")),
    "SELECT c_custkey, greatest(c_acctbal, 0.0) AS balance, coalesce(nullif(c_mktsegment, ''), 'none') AS segment, 'x' AS constant FROM customer",
)

# --- files
def home(t) -> str:
    return new_folder(t.spark)


def through(t, name, write, read):
    path = f"{home(t)}/{name}"
    write(path)
    return read(path)


def json_array(t):
    path = home(t)
    lines = t.nation.select(F.to_json(F.struct("n_nationkey", "n_name")).alias("j")).coalesce(1).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ",\n"), F.lit("]")).alias("value"))
    lines.write.text(f"{path}/a.json")
    return files.read_json(t.spark, f"{path}/a.json").select(c("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


add("src_json_array", json_array, "SELECT n_nationkey, n_name FROM nation")
add("src_csv_sniffed", lambda t: through(t, "s.csv", lambda p: sinks.write_csv(t.supplier, p), lambda p: files.read_csv(t.spark, p)).select(c("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "s_acctbal"), "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
add("src_csv_positional", lambda t: through(t, "s.csv", lambda p: sinks.write_csv(t.supplier, p), lambda p: t.spark.read.csv(p)).where("_c0 <> 's_suppkey'").select(c("_c0").cast("long").alias("s_suppkey"), c("_c1").alias("s_name")), "SELECT s_suppkey, s_name FROM supplier")
add("src_text_lines", lambda t: through(t, "d.txt", lambda p: t.documents.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.text(p), lambda p: files.load(t.spark, p)).groupBy(F.length("value").alias("size")).agg(F.count("*").alias("n")), r"SELECT length(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS size, count(*) AS n FROM documents GROUP BY 1")
add("src_memory_frame", lambda t: files.frame(t.spark, [(1, "a", None), (2, "b", 2.5)], "id long, name string, value double"), "SELECT * FROM (VALUES (1::BIGINT, 'a', NULL::DOUBLE), (2, 'b', 2.5)) v(id, name, value)")
add("snk_workbook", lambda t: through(t, "book.xlsx", lambda p: workbooks.write_excel({"data": t.nation, "summary": t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))}, p), lambda p: files.read_excel(t.spark, p, ["n_regionkey", "n"], sheet=2)).select(c("n_regionkey").cast("int").alias("n_regionkey"), c("n").cast("long").alias("n")), "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
add("src_workbook", lambda t: through(t, "book.xlsx", lambda p: workbooks.write_excel({"data": t.nation}, p), lambda p: files.read_excel(t.spark, p, ["n_nationkey", "n_name"])).select(c("n_nationkey").cast("int").alias("n_nationkey"), "n_name"), "SELECT n_nationkey, n_name FROM nation")
add("snk_split", lambda t: through(t, "split", lambda p: sinks.split_by(t.customer, "c_mktsegment", p), lambda p: t.spark.read.parquet(p)).groupBy("c_mktsegment").agg(F.count("*").alias("rows")), "SELECT c_mktsegment, count(*) AS rows FROM customer GROUP BY 1")
add("snk_report_json", lambda t: through(t, "report.json", lambda p: dq.report(t.orders, [dq.not_null("o_orderkey"), dq.between("o_totalprice", 1000, 300000)]).write.json(p), lambda p: t.spark.read.json(p)).agg(F.count("*").alias("rules")), "SELECT 2::BIGINT AS rules")
add("snk_tsv", lambda t: through(t, "s.tsv", lambda p: sinks.write_csv(t.supplier.select("s_suppkey", "s_name"), p, sep="\t"), lambda p: files.load(t.spark, p, schema="s_suppkey long, s_name string")), "SELECT s_suppkey, s_name FROM supplier")
add("snk_plot_bins", lambda t: with_totals(t.part.select("p_retailprice"), a=F.min("p_retailprice"), b=F.max("p_retailprice")).groupBy(F.least(F.floor((c("p_retailprice") - c("a")) / (c("b") - c("a")) * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n")), "SELECT least(floor((p_retailprice - a) / (b - a) * 20), 19)::INT AS bin, count(*) AS n FROM part, (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part) GROUP BY 1")
add(
    "join_row_update",
    lambda t: t.orders.select("o_orderkey", F.when(c("o_totalprice") > 200000, F.lit("S")).otherwise(c("o_orderstatus")).alias("status")),
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'S' ELSE o_orderstatus END AS status FROM orders",
)
