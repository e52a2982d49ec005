"""Time series, data quality, features, hierarchies, sinks and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import graph, joins, models, stats
from ..operators import quality as dq
from ..operators import timeseries as ts
from ..operators.lineage import new_folder
from ..plans import flow
from ..sources import files, sinks
from ..streaming import events as ev
from . import Registry

R = Registry()
add = R.add
c = F.col


def r(x, n=4):
    return F.round(x, n)


def ev_clean(t):
    return t.events.withColumn("ts", c("ts").cast("timestamp"))


#: A daily series of orders.
DAILY = "(SELECT date_trunc('day', o_orderdate) AS d, round(sum(o_totalprice), 2) AS v, count(*) AS n FROM orders GROUP BY 1)"


def daily(t):
    return t.orders.groupBy(F.date_trunc("day", "o_orderdate").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count("*").alias("n"))


SPINE = "(SELECT unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 DAY)) AS bin FROM s)"

# --- time series
add("ts_resample_month", lambda t: ts.resample(t.orders, "o_orderdate", "month", {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)}).select(F.to_date("bin").alias("month"), "n", "total"), "SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
add("ts_resample_spine", lambda t: ts.resample(daily(t), "d", "day", {"v": F.sum("v")}).select(F.to_date("bin").alias("day"), F.round("v", 2).alias("v")), f"WITH s AS {DAILY} SELECT bin::DATE AS day, v FROM {SPINE} LEFT JOIN s ON bin = d")
add("ts_gaps", lambda t: ts.gaps(daily(t), "d", "day").select(F.to_date("bin").alias("day")), f"WITH s AS {DAILY} SELECT bin::DATE AS day FROM {SPINE} WHERE bin NOT IN (SELECT d FROM s)")
add("ts_gap_islands", lambda t: ts.gap_islands(daily(t), "d", "day", 86400).select(F.to_date("start").alias("start"), F.to_date("end").alias("stop"), "missing"), f"WITH s AS {DAILY}, g AS (SELECT bin, bin - INTERVAL 1 DAY * row_number() OVER (ORDER BY bin) AS k FROM {SPINE} WHERE bin NOT IN (SELECT d FROM s)) SELECT min(bin)::DATE AS start, max(bin)::DATE AS stop, count(*) AS missing FROM g GROUP BY k")
filled = lambda t: ts.resample(daily(t), "d", "day", {"v": F.sum("v")})
add("ts_fill", lambda t: filled(t).select(F.to_date("bin").alias("day"), r(ts.ffill("v", "bin"), 2).alias("f"), r(ts.bfill("v", "bin"), 2).alias("b")), f"WITH s AS {DAILY}, x AS (SELECT bin, v FROM {SPINE} LEFT JOIN s ON bin = d) SELECT bin::DATE AS day, last_value(v IGNORE NULLS) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f, first_value(v IGNORE NULLS) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM x")
add("ts_interpolate", lambda t: ts.interpolate(filled(t).withColumn("day", F.unix_date(F.to_date("bin"))), "v", "day").select("day", r("v", 6).alias("v")), f"WITH s AS {DAILY}, x AS (SELECT date_diff('day', DATE '1970-01-01', bin::DATE) AS day, v FROM {SPINE} LEFT JOIN s ON bin = d), y AS (SELECT day, v, last_value(v IGNORE NULLS) OVER a AS x0, last_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER a AS t0, first_value(v IGNORE NULLS) OVER b AS x1, first_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER b AS t1 FROM x WINDOW a AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT day::INT AS day, round(CASE WHEN v IS NOT NULL THEN v WHEN x1 IS NULL THEN x0 WHEN x0 IS NULL THEN NULL ELSE x0 + (x1 - x0) * (day - t0) / (t1 - t0) END, 6) AS v FROM y")
add("ts_frequency", lambda t: ts.infer_frequency(daily(t), "d"), f"WITH s AS {DAILY}, g AS (SELECT epoch(d) - epoch(lag(d) OVER (ORDER BY d)) AS x FROM s) SELECT CASE WHEN m < 120 THEN 'T' WHEN m < 7200 THEN 'H' WHEN m < 172800 THEN 'D' WHEN m < 691200 THEN 'W' WHEN m < 3024000 THEN 'M' ELSE 'Y' END AS frequency FROM (SELECT median(x) AS m FROM g)")
add("ts_completeness", lambda t: daily(t).agg(F.count("*").alias("n"), (F.datediff(F.max("d"), F.min("d")) + 1).alias("expected")).select("n", "expected", r(c("n") * 100 / c("expected"), 4).alias("pct")), f"SELECT n, expected::INT AS expected, round(n * 100 / expected, 4) AS pct FROM (SELECT count(*) AS n, date_diff('day', min(d)::DATE, max(d)::DATE) + 1 AS expected FROM {DAILY})")
add("ts_rolling_trailing", lambda t: daily(t).select(F.to_date("d").alias("day"), r(ts.rolling("v", 7, "d", F.avg, least=3), 6).alias("m"), r(ts.rolling("v", 7, "d", F.stddev_pop, least=1), 4).alias("sd")), f"SELECT d::DATE AS day, round(CASE WHEN count(v) OVER w >= 3 THEN avg(v) OVER w END, 6) AS m, round(stddev_pop(v) OVER w, 4) AS sd FROM {DAILY} WINDOW w AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
add("ts_rolling_centered", lambda t: daily(t).select(F.to_date("d").alias("day"), r(ts.rolling("v", 24, "d", F.avg, center=True), 6).alias("m")), f"SELECT d::DATE AS day, round(avg(v) OVER (ORDER BY d ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), 6) AS m FROM {DAILY}")
add("ts_rolling_before", lambda t: daily(t).select(F.to_date("d").alias("day"), r(ts.rolling("v", 6, "d", F.avg, least=6, exclude_current=True), 6).alias("m"), r(ts.rolling("v", 6, "d", F.max, least=6, exclude_current=True), 2).alias("hi")), f"SELECT d::DATE AS day, round(CASE WHEN count(v) OVER w >= 6 THEN avg(v) OVER w END, 6) AS m, round(CASE WHEN count(v) OVER w >= 6 THEN max(v) OVER w END, 2) AS hi FROM {DAILY} WINDOW w AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)")
add("ts_rolling_full", lambda t: daily(t).select(F.to_date("d").alias("day"), F.count("v").over(W.orderBy("d").rowsBetween(-7, 0)).alias("k"), r(F.max("v").over(W.orderBy("d").rowsBetween(-7, 0)) - F.min("v").over(W.orderBy("d").rowsBetween(-7, 0)), 2).alias("span"), r(c("v") - F.first("v").over(W.orderBy("d").rowsBetween(-7, 0)), 2).alias("move")).where("k = 8").drop("k"), f"SELECT day, span, move FROM (SELECT d::DATE AS day, count(v) OVER w AS k, round(max(v) OVER w - min(v) OVER w, 2) AS span, round(v - first_value(v) OVER w, 2) AS move FROM {DAILY} WINDOW w AS (ORDER BY d ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) WHERE k = 8")
add("ts_rolling_corr", lambda t: daily(t).select(F.to_date("d").alias("day"), r(ts.rolling_corr("v", "n", 30, "d"), 4).alias("k")).where("k is not null"), f"SELECT day, round(k, 4) AS k FROM (SELECT d::DATE AS day, CASE WHEN count(v) OVER w = 30 THEN corr(v, n::DOUBLE) OVER w END AS k FROM {DAILY} WINDOW w AS (ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE k IS NOT NULL AND NOT isnan(k)")
add("ts_rolling_time", lambda t: ev_clean(t).withColumn("u", F.unix_micros("ts")).select("event_id", r(F.avg("value").over(W.partitionBy("event_type").orderBy("u").rangeBetween(-3599999999, 0)), 6).alias("m")), "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), 6) AS m FROM events")
add("ts_velocity", lambda t: daily(t).select(F.to_date("d").alias("day"), (c("v") - F.lag("v").over(W.orderBy("d"))).alias("dv"), F.datediff("d", F.lag("d").over(W.orderBy("d"))).alias("dt")).where(F.abs("dv") > 100000 * c("dt")).select("day"), f"SELECT day FROM (SELECT d::DATE AS day, v - lag(v) OVER (ORDER BY d) AS dv, date_diff('day', (lag(d) OVER (ORDER BY d))::DATE, d::DATE) AS dt FROM {DAILY}) WHERE abs(dv) > 100000 * dt")
add("ts_sequence", lambda t: ts.neighbours(ev_clean(t).select("event_id", "ts"), "event_id", ["ts"]).agg(F.count_if(c("ts") < c("prev_ts")).alias("backward"), F.count_if(c("ts") == c("prev_ts")).alias("same")), "SELECT count(*) FILTER (WHERE ts < prev) AS backward, count(*) FILTER (WHERE ts = prev) AS same FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS prev FROM events)")
add("ts_weekend_share", lambda t: ev_clean(t).agg(F.count_if(F.weekday("ts") >= 5).alias("w"), F.count("*").alias("n")).select(F.when(c("w") == 0, "weekday_only").when(c("w") == c("n"), "weekend_only").otherwise("all_days").alias("pattern")), "SELECT CASE WHEN w = 0 THEN 'weekday_only' WHEN w = n THEN 'weekend_only' ELSE 'all_days' END AS pattern FROM (SELECT count(*) FILTER (WHERE isodow(ts) >= 6) AS w, count(*) AS n FROM events)")
add("ts_anomalies", lambda t: ts.anomalies(daily(t), "v", "d", 24, 2.5).select(F.to_date("d").alias("day"), "z_flag", "iqr_flag", "rolling_flag", "anomaly"), f"WITH s AS {DAILY}, b AS (SELECT avg(v) AS m, stddev_samp(v) AS sd, quantile_cont(v, .25) AS q1, quantile_cont(v, .75) AS q3 FROM s), x AS (SELECT d::DATE AS day, abs(v - m) > 2.5 * sd AS z_flag, (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS iqr_flag, coalesce(stddev_samp(v) OVER w > 0 AND abs(v - avg(v) OVER w) > 2.5 * stddev_samp(v) OVER w, false) AS rolling_flag FROM s, b WINDOW w AS (ORDER BY d ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)) SELECT *, (z_flag OR iqr_flag OR rolling_flag) AS anomaly FROM x")
add("ts_ewma", lambda t: ts.ewma(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey", 0.3).select("o_custkey", "o_orderkey", r("ewma", 6).alias("ewma")), "WITH RECURSIVE s AS (SELECT o_custkey, o_orderkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), e AS (SELECT o_custkey, o_orderkey, x AS y, i FROM s WHERE i = 1 UNION ALL SELECT s.o_custkey, s.o_orderkey, 0.3 * s.x + 0.7 * e.y, s.i FROM e JOIN s ON s.o_custkey = e.o_custkey AND s.i = e.i + 1) SELECT o_custkey, o_orderkey, round(y, 6) AS ewma FROM e")
add("ts_autocorrelation", lambda t: ts.autocorrelation(daily(t), "v", "d", 5).select("lag", r("r", 5).alias("r")), " UNION ALL ".join(f"SELECT {k} AS lag, round(corr(v, l), 5) AS r FROM (SELECT v, lag(v, {k}) OVER (ORDER BY d) AS l FROM {DAILY})" for k in range(1, 6)))
add("ts_cross_correlation", lambda t: ts.cross_correlation(daily(t).withColumn("n", c("n").cast("double")), "v", "n", "d", 2).select("lag", r("r", 5).alias("r")), "WITH z AS (SELECT d, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS x, (n - avg(n) OVER ()) / stddev_pop(n) OVER () AS y FROM " + DAILY + ") " + " UNION ALL ".join(f"SELECT {k} AS lag, round(sum(x * l) / count(*), 5) AS r FROM (SELECT x, {'lag' if k >= 0 else 'lead'}(y, {abs(k)}) OVER (ORDER BY d) AS l FROM z)" for k in range(-2, 3)))
add("ts_decompose", lambda t: ts.decompose(daily(t), "v", "d", 7).select(F.to_date("d").alias("day"), r("trend", 2).alias("trend"), r("seasonal", 2).alias("seasonal"), r("resid", 2).alias("resid")), f"WITH s AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS i FROM {DAILY}), q AS (SELECT *, CASE WHEN count(v) OVER w = 7 THEN avg(v) OVER w END AS trend FROM s WINDOW w AS (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), m AS (SELECT i % 7 AS p, avg(v - trend) AS x FROM q GROUP BY 1), n AS (SELECT p, x - avg(x) OVER () AS seasonal FROM m) SELECT d::DATE AS day, round(trend, 2) AS trend, round(seasonal, 2) AS seasonal, round(v - trend - seasonal, 2) AS resid FROM q JOIN n ON i % 7 = p")
add("ts_growth_text", lambda t: daily(t).groupBy(F.year("d").alias("y")).agg(F.sum("v").alias("v")).withColumn("g", (c("v") / F.lag("v").over(W.orderBy("y")) - 1) * 100).select("y", F.when(c("g") > 10, "strong growth").when(c("g") > 0, "growth").when(c("g") > -5, "flat").otherwise("decline").alias("text")), f"SELECT y, CASE WHEN g > 10 THEN 'strong growth' WHEN g > 0 THEN 'growth' WHEN g > -5 THEN 'flat' ELSE 'decline' END AS text FROM (SELECT y, (v / lag(v) OVER (ORDER BY y) - 1) * 100 AS g FROM (SELECT year(d) AS y, sum(v) AS v FROM {DAILY} GROUP BY 1))")

# --- data quality
RULES = lambda: [dq.not_null("o_orderkey"), dq.between("o_totalprice", 1000, 300000), dq.matches("o_orderpriority", "[1-3]-"), dq.is_in("o_orderstatus", ["F", "O"]), dq.unique("o_custkey", "o_orderkey")]
FAIL = {"o_orderkey_not_null": "o_orderkey IS NULL", "o_totalprice_between": "NOT coalesce(o_totalprice BETWEEN 1000 AND 300000, false)", "o_orderpriority_matches": "NOT regexp_matches(o_orderpriority, '^[1-3]-')", "o_orderstatus_in": "o_orderstatus NOT IN ('F', 'O')", "o_custkey_unique": "n > 1"}
NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"
add("dq_report", lambda t: dq.report(t.orders, RULES()), " UNION ALL ".join(f"SELECT '{k}' AS rule, 'high' AS severity, count(*) FILTER (WHERE {f}) AS failed, count(*) FILTER (WHERE NOT ({f})) AS passed, round(count(*) FILTER (WHERE NOT ({f})) / count(*) * 100, 2) AS pass_rate FROM {NUMBERED}" for k, f in FAIL.items()))
add("dq_violations", lambda t: dq.violations(t.orders, RULES(), "o_orderkey"), " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS rule, 'high' AS severity FROM {NUMBERED} WHERE {f}" for k, f in FAIL.items()))
add("dq_summary", lambda t: dq.summary(dq.violations(t.orders, RULES(), "o_orderkey"), "o_orderkey"), "SELECT rule, 'high' AS severity, count(*) AS violations, count(DISTINCT o_orderkey) AS rows FROM (" + " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS rule FROM {NUMBERED} WHERE {f}" for k, f in FAIL.items()) + ") GROUP BY 1")
add("dq_split_valid", lambda t: dq.split_valid(t.orders, RULES()[:4]).select("o_orderkey", "valid", F.size("errors").alias("n")), "SELECT o_orderkey, k = 0 AS valid, k AS n FROM (SELECT o_orderkey, " + " + ".join(f"({f})::INT" for f in list(FAIL.values())[:4]) + " AS k FROM orders)")
add("dq_within_std", lambda t: dq.report(t.orders, [dq.within_std(t.orders, "o_totalprice", 2)]).select("failed"), "SELECT count(*) FILTER (WHERE abs(o_totalprice - m) > 2 * s) AS failed FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)")
add("dq_temporal", lambda t: dq.violations(t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")), [dq.ordered("o_orderdate", "l_shipdate")], "id").select("id"), "SELECT l_orderkey || '-' || l_linenumber AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate")
add("dq_formula", lambda t: dq.report(t.lineitem, [dq.close_to("price", c("l_extendedprice") * (1 - c("l_discount")), c("l_extendedprice") - c("l_extendedprice") * c("l_discount")), dq.close_to("tax", c("l_tax") * 100, F.lit(4.0))]).select("rule", "failed"), "SELECT 'price' AS rule, 0::BIGINT AS failed UNION ALL SELECT 'tax', count(*) FILTER (WHERE abs(l_tax * 100 - 4) > 0.01) FROM lineitem")
add("dq_conditional", lambda t: dq.report(t.orders, [dq.implies("big", c("o_totalprice") > 200000, c("o_orderpriority") != "5-LOW"), dq.exclusive("one", ["o_orderkey", "o_custkey"])]).select("rule", "failed"), "SELECT 'big' AS rule, count(*) FILTER (WHERE o_totalprice > 200000 AND o_orderpriority = '5-LOW') AS failed FROM orders UNION ALL SELECT 'one', count(*) FILTER (WHERE o_orderkey <> 0 AND o_custkey <> 0) FROM orders")
add("dq_type_check", lambda t: t.events.agg(F.count_if(c("event_type").try_cast("double").isNull()).alias("not_number"), F.count_if(F.get_json_object("props", "$.k").try_cast("int").isNull()).alias("not_int")), "SELECT count(*) FILTER (WHERE try_cast(event_type AS DOUBLE) IS NULL) AS not_number, count(*) FILTER (WHERE try_cast(props->>'$.k' AS INT) IS NULL) AS not_int FROM events")
add("dq_table_rules", lambda t: ev_clean(t).agg(F.count("*").alias("volume"), F.round(F.avg(c("user_id").isNotNull().cast("int")), 4).alias("complete"), F.round(F.avg((c("value") < 0).cast("int")), 4).alias("negative"), F.count_if(~c("event_type").isin("click", "view", "purchase")).alias("other_types")), "SELECT count(*) AS volume, round(avg((user_id IS NOT NULL)::INT), 4) AS complete, round(avg((value < 0)::INT), 4) AS negative, count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'purchase')) AS other_types FROM events")
HALVES = ("o_orderdate < TIMESTAMP '1998-01-01'", "o_orderdate >= TIMESTAMP '1998-01-01'")
add("dq_drift", lambda t: dq.drift(t.orders.where(HALVES[0]), t.orders.where(HALVES[1]), ["o_totalprice", "o_custkey"]), " UNION ALL ".join(f"SELECT *, CASE WHEN abs(mean_change) > 50 THEN 'high' WHEN abs(mean_change) > 25 THEN 'medium' WHEN abs(mean_change) > 10 OR abs(std_change) > 20 OR range_grew THEN 'low' ELSE 'none' END AS severity FROM (SELECT '{k}' AS \"column\", round((b.m - a.m) * 100 / abs(a.m), 4) AS mean_change, round((b.s - a.s) * 100 / abs(a.s), 4) AS std_change, (b.lo < a.lo OR b.hi > a.hi) AS range_grew FROM (SELECT avg({k}) AS m, stddev_samp({k}) AS s, min({k}) AS lo, max({k}) AS hi FROM orders WHERE {HALVES[0]}) a, (SELECT avg({k}) AS m, stddev_samp({k}) AS s, min({k}) AS lo, max({k}) AS hi FROM orders WHERE {HALVES[1]}) b)" for k in ("o_totalprice", "o_custkey")))
add("dq_ks", lambda t: stats.ks_statistic(t.orders.where(HALVES[0]), t.orders.where(HALVES[1]), "o_totalprice").select(r("ks", 6).alias("ks")), f"WITH b AS (SELECT o_totalprice AS x, ({HALVES[0]})::INT AS a FROM orders), p AS (SELECT x, sum(a) AS a, sum(1 - a) AS b FROM b GROUP BY 1) SELECT round(max(abs(ca / ta - cb / tb)), 6) AS ks FROM (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(a) OVER () AS ta, sum(b) OVER (ORDER BY x) AS cb, sum(b) OVER () AS tb FROM p)")
EDGES = [50000.0, 100000.0, 150000.0, 200000.0, 300000.0]
BIN = " + ".join(f"(o_totalprice >= {e})::INT" for e in EDGES)
add("dq_psi", lambda t: stats.psi(t.orders.where(HALVES[0]), t.orders.where(HALVES[1]), "o_totalprice", EDGES).select(r("psi", 6).alias("psi")), f"WITH b AS (SELECT {BIN} AS k, ({HALVES[0]}) AS a FROM orders), s AS (SELECT k, greatest(count(*) FILTER (WHERE a) / sum(count(*) FILTER (WHERE a)) OVER (), 1e-4) AS p, greatest(count(*) FILTER (WHERE NOT a) / sum(count(*) FILTER (WHERE NOT a)) OVER (), 1e-4) AS q FROM b GROUP BY 1) SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM s")
add("dq_new_values", lambda t: t.part.where("p_retailprice >= 1000").select("p_size").subtract(t.part.where("p_retailprice < 920").select("p_size")), "SELECT p_size FROM part WHERE p_retailprice >= 1000 EXCEPT SELECT p_size FROM part WHERE p_retailprice < 920")
OUT = {"iqr": "SELECT quantile_cont(l_extendedprice, .25) - 0.25 * (quantile_cont(l_extendedprice, .75) - quantile_cont(l_extendedprice, .25)) AS lo, quantile_cont(l_extendedprice, .75) + 0.25 * (quantile_cont(l_extendedprice, .75) - quantile_cont(l_extendedprice, .25)) AS hi FROM lineitem", "z": "SELECT avg(l_extendedprice) - 1.5 * stddev_samp(l_extendedprice) AS lo, avg(l_extendedprice) + 1.5 * stddev_samp(l_extendedprice) AS hi FROM lineitem", "mad": "SELECT median(l_extendedprice) - 1.0 * mad(l_extendedprice) / 0.6745 AS lo, median(l_extendedprice) + 1.0 * mad(l_extendedprice) / 0.6745 AS hi FROM lineitem", "percentile": "SELECT quantile_cont(l_extendedprice, .01) AS lo, quantile_cont(l_extendedprice, .99) AS hi FROM lineitem"}
for _how, _k in (("iqr", 0.25), ("z", 1.5), ("mad", 1.0), ("percentile", None)):
    add(f"dq_outliers_{_how}", lambda t, h=_how, k=_k: stats.fences(t.lineitem, "l_extendedprice", h, k).where("l_extendedprice < low or l_extendedprice > high").select("l_orderkey", "l_linenumber"), f"SELECT l_orderkey, l_linenumber FROM lineitem, ({OUT[_how]}) WHERE l_extendedprice < lo OR l_extendedprice > hi")
add("dq_outlier_cap", lambda t: stats.fences(t.lineitem, "l_extendedprice", "z", 1.5).select("l_orderkey", "l_linenumber", r(ft.treat_outliers("l_extendedprice", c("low"), c("high"), "cap"), 4).alias("v")), f"SELECT l_orderkey, l_linenumber, round(greatest(least(l_extendedprice, hi), lo), 4) AS v FROM lineitem, ({OUT['z']})")
add("dq_outlier_impact", lambda t: stats.fences(t.lineitem, "l_extendedprice", "z", 1.5).withColumn("in_", c("l_extendedprice").between(c("low"), c("high"))).agg(r(F.avg("l_extendedprice"), 3).alias("with_"), r(F.avg(F.when(c("in_"), c("l_extendedprice"))), 3).alias("without")), f"SELECT round(avg(l_extendedprice), 3) AS with_, round(avg(CASE WHEN l_extendedprice BETWEEN lo AND hi THEN l_extendedprice END), 3) AS without FROM lineitem, ({OUT['z']})")
MISS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS v FROM orders)"
miss = lambda t: t.orders.select("o_orderkey", F.when(c("o_orderkey") % 5 > 0, c("o_totalprice")).alias("v"))
for _how, _sql in (("mean", "avg(v)"), ("median", "median(v)"), ("zero", "min(0)")):
    add(f"dq_fill_{_how}", lambda t, h=_how: ft.fill(miss(t), "v", h).select("o_orderkey", r("v", 3).alias("v")), f"SELECT o_orderkey, round(coalesce(v, (SELECT {_sql} FROM {MISS})), 3) AS v FROM {MISS}")
add("dq_fill_mode", lambda t: ft.fill(t.part.select("p_partkey", F.when(c("p_partkey") % 4 > 0, c("p_size")).alias("v")), "v", "mode"), "WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_size END AS v FROM part) SELECT p_partkey, coalesce(v, (SELECT v FROM m WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)) AS v FROM m")
add("dq_missing_t", lambda t: miss(t).join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").agg(F.avg(F.when(c("v").isNull(), c("o_custkey"))).alias("a"), F.avg(F.when(c("v").isNotNull(), c("o_custkey"))).alias("b")).select(r(c("a") - c("b"), 4).alias("gap")), "SELECT round(avg(CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END) - avg(CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END), 4) AS gap FROM orders")
add("dq_sentinels", lambda t: t.customer.select("c_custkey", ft.sentinels(F.when(c("c_custkey") % 3 == 0, "N/A").otherwise(c("c_mktsegment"))).alias("s")), "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS s FROM customer")

# --- features
add("ft_label_encode", lambda t: ft.label_encode(t.customer, "c_mktsegment", "code").select("c_custkey", c("code").cast("int").alias("code")), "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS code FROM customer")
add("ft_one_hot", lambda t: ft.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"]).drop("o_orderstatus"), "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS o_orderstatus_F, (o_orderstatus = 'O')::INT AS o_orderstatus_O, (o_orderstatus = 'P')::INT AS o_orderstatus_P FROM orders")
add("ft_target_encode", lambda t: ft.target_encode(t.customer, "c_mktsegment", "c_acctbal").select("c_mktsegment", r("encoded", 4).alias("encoded")), "SELECT c_mktsegment, round((sum(c_acctbal) + 10 * (SELECT avg(c_acctbal) FROM customer)) / (count(*) + 10), 4) AS encoded FROM customer GROUP BY 1")
add("ft_frequency_encode", lambda t: ft.frequency_encode(t.part, "p_brand").select("p_brand", r("frequency", 6).alias("frequency")), "SELECT p_brand, round(count(*) / sum(count(*)) OVER (), 6) AS frequency FROM part GROUP BY 1")
add("ft_group_rare", lambda t: ft.group_rare(t.part.select("p_partkey", "p_brand"), "p_brand", 0.04), "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) / count(*) OVER () < 0.04 THEN '__RARE__' ELSE p_brand END AS p_brand FROM part")
add("ft_binary_encode", lambda t: ft.label_encode(t.part, "p_brand", "k").select("p_partkey", *[F.getbit(c("k").cast("long"), F.lit(i)).cast("int").alias(f"b{i}") for i in range(3)]), "SELECT p_partkey, " + ", ".join(f"((k >> {i}) & 1)::INT AS b{i}" for i in range(3)) + " FROM (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS k FROM part)")
add("ft_class_metrics", lambda t: ft.class_metrics(t.labels, "quality", "toxic"), "WITH p AS (SELECT quality AS a, toxic AS p FROM labels), k AS (SELECT unnest([0, 1]) AS class), s AS (SELECT class, count(*) FILTER (WHERE a = class) AS support, count(*) FILTER (WHERE p = class) AS guessed, count(*) FILTER (WHERE a = class AND p = class) AS hits FROM p, k GROUP BY 1) SELECT class, support, round(coalesce(hits / nullif(guessed, 0), 0), 6) AS precision, round(coalesce(hits / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * (hits / nullif(guessed, 0)) * (hits / nullif(support, 0)) / nullif(hits / nullif(guessed, 0) + hits / nullif(support, 0), 0), 0), 6) AS f1 FROM s")
add("ft_regression_metrics", lambda t: ft.regression_metrics(t.part.withColumn("guess", c("p_size") * 20 + 900.0), "p_retailprice", "guess"), "SELECT round(avg(e * e), 4) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT p_retailprice AS y, p_retailprice - (p_size * 20 + 900.0) AS e FROM part)")
add("ft_segment_metrics", lambda t: t.labels.join(t.documents, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), r(F.avg((c("quality") == 1).cast("int")), 6).alias("share")).where("n >= 10"), "SELECT lang, count(*) AS n, round(avg((quality = 1)::INT), 6) AS share FROM labels JOIN documents USING (doc_id) GROUP BY 1 HAVING count(*) >= 10")
add("ft_fold_leakage", lambda t: t.orders.withColumn("f", ft.fold("o_custkey", 5)).groupBy("o_custkey").agg(F.countDistinct("f").alias("n")).where("n > 1").agg(F.count("*").alias("leaks")), "SELECT 0::BIGINT AS leaks")
add("ft_cramers_v", lambda t: stats.chi_square(t.orders, "o_orderstatus", "o_orderpriority").select(r("cramers_v", 6).alias("v")), "WITH g AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS x FROM g) SELECT round(sqrt((sum(o * o / x) - sum(o)) / (sum(o) * least(count(DISTINCT a) - 1, count(DISTINCT b) - 1))), 6) AS v FROM e")
add("ft_kmeans_sizes", lambda t: kmeans_sizes(t))


def kmeans_sizes(t):
    """Sizes of five clusters of standardised part features."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    data = VectorAssembler(inputCols=["p_size", "p_retailprice"], outputCol="raw").transform(t.part)
    data = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(data).transform(data)
    return KMeans(k=5, seed=1).fit(data).transform(data).groupBy("prediction").agg(F.count("*").alias("n"))


# --- hierarchies: every order key's parent is half of it
TREE = "(SELECT o_orderkey AS n, CASE WHEN o_orderkey > 1 THEN o_orderkey // 2 END AS p FROM orders)"
tree = lambda t: t.orders.select(c("o_orderkey").alias("n"), F.when(c("o_orderkey") > 1, F.floor(c("o_orderkey") / 2)).alias("p"))
add("graph_depths", lambda t: graph.depths(tree(t), "n", "p"), f"WITH RECURSIVE e AS {TREE}, d AS (SELECT n, 0 AS depth FROM e WHERE p IS NULL UNION SELECT e.n, d.depth + 1 FROM e JOIN d ON e.p = d.n) SELECT n, depth FROM d")
add("graph_orphans", lambda t: graph.orphans(t.orders.where("o_orderstatus = 'O'").select(c("o_orderkey").alias("n"), F.floor(c("o_orderkey") / 2).alias("p")), "n", "p").select("n"), "WITH e AS (SELECT o_orderkey AS n, o_orderkey // 2 AS p FROM orders WHERE o_orderstatus = 'O') SELECT n FROM e WHERE p NOT IN (SELECT n FROM e)")
add("graph_cycles", lambda t: graph.cycles(tree(t).withColumn("p", F.when(c("n") == 4, F.lit(9)).otherwise(c("p"))), "n", "p"), "SELECT n FROM (VALUES (4::BIGINT), (9)) v(n) WHERE (SELECT count(*) FROM orders WHERE o_orderkey IN (4, 9)) = 2")
add("graph_reachable", lambda t: graph.reachable(tree(t).where("p is not null"), "n", "p"), f"WITH RECURSIVE e AS (SELECT n, p FROM {TREE} WHERE p IS NOT NULL), r AS (SELECT n, p, 1 AS hops FROM e UNION SELECT r.n, e.p, r.hops + 1 FROM r JOIN e ON r.p = e.n) SELECT n, p, min(hops) AS hops FROM r GROUP BY 1, 2")
add("graph_many_parents", lambda t: graph.many_parents(t.lineitem.select("l_partkey", "l_suppkey").distinct(), "l_partkey", "l_suppkey").select("l_partkey", "n_parents"), "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_parents FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
add("graph_lineage", lambda t: t.spark.createDataFrame([(*graph.sql_sources(s), i) for i, s in enumerate(("INSERT INTO mart.sales SELECT * FROM raw.orders o JOIN raw.items i ON o.id = i.id", "create view v as select 1 from mart.sales"))], "target string, sources array<string>, i int").select("i", "target", F.array_join("sources", ",").alias("sources")), "SELECT * FROM (VALUES (0, 'mart.sales', 'raw.items,raw.orders'), (1, 'v', 'mart.sales')) v(i, target, sources)")

# --- pipelines, sinks and streams
add("plan_chain", lambda t: flow.chain(t.orders, lambda d: d.where("o_totalprice > 1000"), lambda d: d.groupBy("o_orderstatus").agg(F.count("*").alias("n"))), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
add("plan_introspect", lambda t: flow.introspect(t.part))
add("plan_run_health", lambda t: t.orders.groupBy("o_orderpriority").agg(r(F.avg((c("o_orderstatus") == "F").cast("int")) * 100, 2).alias("success"), F.count_if(c("o_totalprice") > 250000).alias("slow")), "SELECT o_orderpriority, round(avg((o_orderstatus = 'F')::INT) * 100, 2) AS success, count(*) FILTER (WHERE o_totalprice > 250000) AS slow FROM orders GROUP BY 1")
def written(t, name, write, read):
    path = f"{new_folder(t.spark)}/{name}"
    write(path)
    return read(path)


add("snk_parquet_partitioned", lambda t: written(t, "p", lambda p: sinks.write_parquet(t.customer, p, ["c_mktsegment"]), lambda p: t.spark.read.parquet(p).where("c_mktsegment = 'BUILDING'").select("c_custkey")), "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
add("snk_csv_roundtrip", lambda t: written(t, "c.csv", lambda p: sinks.write_csv(t.supplier, p), lambda p: files.load(t.spark, p, schema="s_suppkey long, s_name string, s_nationkey int, s_acctbal double")), "SELECT * FROM supplier")
add("snk_csv_filtered", lambda t: written(t, "f.csv", lambda p: sinks.write_csv(t.orders.where("o_totalprice > 300000").select("o_orderkey", "o_totalprice"), p), lambda p: files.read_csv(t.spark, p)).select(c("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
add("snk_csv_safe", lambda t: sinks.csv_safe(t.documents.select("doc_id", "text")).select("doc_id", F.md5("text").alias("h")), r"SELECT doc_id, md5(regexp_replace(replace(text, ',', ';'), '[\r\n]+', ' ', 'g')) AS h FROM documents")
add("snk_json_roundtrip", lambda t: written(t, "j.jsonl", lambda p: sinks.write_json(t.nation, p), lambda p: files.load(t.spark, p, schema="n_nationkey int, n_name string, n_regionkey int")), "SELECT * FROM nation")
add("snk_manifest", lambda t: sinks.manifest(t.customer, "c_mktsegment").select("value", "rows"), "SELECT c_mktsegment AS value, count(*) AS rows FROM customer GROUP BY 1")
add("snk_snapshots", lambda t: written(t, "s", lambda p: [sinks.snapshot(t.region, p, v) for v in ("a", "b", "c")], lambda p: sinks.versions(t.spark, p, 2)), "SELECT * FROM (VALUES ('a', true), ('b', false), ('c', false)) v(v, stale)")
add("src_folder_merge", lambda t: written(t, "m", lambda p: [sinks.write_csv(t.nation.where(f"n_regionkey = {k}"), f"{p}/r{k}") for k in range(5)], lambda p: files.read_folder(t.spark, p)).select(c("n_nationkey").cast("int").alias("n_nationkey"), (F.length("source_file") > 0).alias("named")), "SELECT n_nationkey, true AS named FROM nation")
add("stm_event_ids", lambda t: ev.event_id(t.events.withColumn("d", F.to_date("ts")), ["user_id", "event_id", "d"]).select("event_id", "event_key"), "SELECT event_id, md5(user_id || '_' || event_id || '_' || ts::DATE) AS event_key FROM events")
add("stm_versions", lambda t: ev.normalise_versions(t.events.select("event_id", (F.pmod("event_id", F.lit(2)) + 1).cast("int").alias("version"))).select("event_id", "session_id", "country"), "SELECT event_id, NULL::VARCHAR AS session_id, 'UNKNOWN' AS country FROM events")
add("stm_session_labels", lambda t: t.events.select("event_id", F.concat(F.lit("sess_"), F.floor(c("event_id") / 10)).alias("session")), "SELECT event_id, 'sess_' || (event_id // 10) AS session FROM events")
add("stm_windowed", lambda t: stream_windows(t), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
add("stm_sessions", lambda t: ev.sessions(ev_clean(t), "ts", "30 minutes", "user_id"), "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")


def stream_windows(t):
    """Hourly counts by a stream over the events, all of it drained."""
    home = new_folder(t.spark)
    t.events.write.parquet(f"{home}/in")
    live = ev.stream(t.spark, f"{home}/in", t.events.schema).withColumn("ts", c("ts").cast("timestamp"))
    counts = ev.windowed(live, "ts", "1 hour", "1 day", ["event_type"], "value")
    return ev.drain(counts, f"{home}/out", f"{home}/state", "complete")


# --- models and transforms
add("ft_vif", lambda t: models.vif(t.part, ["p_size", "p_retailprice"]).select("column", r("vif", 6).alias("vif"), "level"), " UNION ALL ".join(f"SELECT '{k}' AS \"column\", round(1 / (1 - power(corr(p_size, p_retailprice), 2)), 6) AS vif, 'low' AS level FROM part" for k in ("p_size", "p_retailprice")))
add("ft_pca_variance", lambda t: models.pca_variance(t.part, ["p_size", "p_retailprice"]).select("component", r("share", 6).alias("share")), "SELECT 1 AS component, round((1 + abs(corr(p_size, p_retailprice))) / 2, 6) AS share FROM part UNION ALL SELECT 2, round((1 - abs(corr(p_size, p_retailprice))) / 2, 6) FROM part")
add("ft_linear_fit", lambda t: models.linear_fit(t.part, ["p_size"], "p_retailprice").select("term", r("weight", 4).alias("weight")), "SELECT 'intercept' AS term, round(regr_intercept(p_retailprice, p_size), 4) AS weight FROM part UNION ALL SELECT 'p_size', round(regr_slope(p_retailprice, p_size), 4) FROM part")
add("ft_mutual_information", lambda t: models.mutual_information(t.orders, "o_orderstatus", "o_orderpriority").select(r("mi", 8).alias("mi")), "WITH g AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM g) SELECT round(sum(p * ln(p / (pa * pb))), 8) AS mi FROM e")
add("ft_benjamini_hochberg", lambda t: models.benjamini_hochberg(t.nation.select("n_nationkey", (c("n_nationkey") * c("n_nationkey") / 2000.0).alias("p")), "p").select("n_nationkey", "selected"), "WITH t AS (SELECT n_nationkey, n_nationkey * n_nationkey / 2000.0 AS p, rank() OVER (ORDER BY n_nationkey) AS k, count(*) OVER () AS n FROM nation) SELECT n_nationkey, p <= (SELECT max(p) FROM t WHERE p <= 0.05 * k / n) AS selected FROM t")
add("ft_box_cox", lambda t: models.box_cox(t.orders, "o_totalprice", "y").select("o_orderkey", r("y", 3).alias("y")))
add("ts_detrend", lambda t: models.detrend(daily(t).withColumn("day", F.unix_date(F.to_date("d"))), "v", "day", "x").select("day", r("x", 2).alias("x")), f"SELECT day::INT AS day, round(v - a - b * day, 2) AS x FROM (SELECT date_diff('day', DATE '1970-01-01', d::DATE) AS day, v FROM {DAILY}), (SELECT regr_intercept(v, day) AS a, regr_slope(v, day) AS b FROM (SELECT date_diff('day', DATE '1970-01-01', d::DATE) AS day, v FROM {DAILY}))")
add("ts_savitzky_golay", lambda t: daily(t).select(F.to_date("d").alias("day"), r(models.savitzky_golay("v", "d"), 4).alias("s")), f"SELECT d::DATE AS day, round((-3 * lag(v, 2) OVER w + 12 * lag(v, 1) OVER w + 17 * v + 12 * lead(v, 1) OVER w - 3 * lead(v, 2) OVER w) / 35, 4) AS s FROM {DAILY} WINDOW w AS (ORDER BY d)")
add("ft_time_split", lambda t: models.time_split(t.orders, "o_orderdate", 4).groupBy("fold").agg(F.count("*").alias("n")), "SELECT least(floor((epoch(o_orderdate) - a) * 4 / (b - a)) + 1, 4)::BIGINT AS fold, count(*) AS n FROM orders, (SELECT epoch(min(o_orderdate)) AS a, epoch(max(o_orderdate)) AS b FROM orders) GROUP BY 1")
add("nest_schema_evolution", lambda t: t.events.select("event_id", F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n")), "SELECT unnest(json_keys(props)) AS key, count(*) AS n FROM events GROUP BY 1")
add("prj_seeded_sample", lambda t: t.orders.orderBy(F.xxhash64("o_orderkey", F.lit(7)), "o_orderkey").limit(100).agg(F.count("*").alias("n")), "SELECT 100::BIGINT AS n")
