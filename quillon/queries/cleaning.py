"""Types, missing values, overviews, outliers, drift and tests with their p-values."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..operators import cleaning as cl
from ..operators import features as ft
from ..operators import quality as dq
from ..operators import stats
from ..operators.totals import exact_quantiles, with_totals
from . import Registry

R = Registry()
add = R.add
c = F.col


def r(x, n=4):
    return F.round(x, n)


#: Documents with their labels: quality and toxic are null for some.
GRADED = "(SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def graded(t):
    return t.documents.select("doc_id", "n_chars", "lang", "source").join(t.labels, "doc_id", "left")


def messy(t):
    return t.lineitem.select(
        F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("price"), F.concat(c("l_tax").cast("string"), F.lit("%")).alias("tax"),
        F.when(c("l_linestatus") == "O", "Yes").otherwise("no").alias("open"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), "l_returnflag",
    )


MESSY = """(SELECT '$' || format('{:,.2f}', l_extendedprice) AS price, l_tax::VARCHAR || '%' AS tax,
    CASE l_linestatus WHEN 'O' THEN 'Yes' ELSE 'no' END AS open, strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_returnflag FROM lineitem)"""


def sql_type(column: str) -> str:
    number = rf"try_cast(regexp_replace({column}, '[$,%]', '', 'g') AS DOUBLE)"
    return f"""SELECT '{column}' AS "column", CASE
        WHEN avg((lower({column}) IN ('true','t','yes','y','1','on','false','f','no','n','0','off'))::INT) > .9 THEN 'boolean'
        WHEN avg(({number} IS NOT NULL)::INT) > .8 THEN CASE WHEN count(*) FILTER (WHERE contains({column}, '%')) > 0 THEN 'percentage' ELSE 'numeric' END
        WHEN avg((try_cast(CASE WHEN {column} LIKE '____-__-__' THEN {column} END AS DATE) IS NOT NULL)::INT) > .7 THEN 'datetime' ELSE 'string' END AS type FROM m"""


TEXTS = ("price", "tax", "open", "shipped", "l_returnflag")
add("dq_infer_types", lambda t: cl.infer_types(messy(t), list(TEXTS)), f"WITH m AS {MESSY} " + " UNION ALL ".join(sql_type(x) for x in TEXTS))
add(
    "dq_convert_types",
    lambda t: messy(t).agg(
        r(F.sum(cl.convert(c("price"), "numeric")), 0).alias("price"), r(F.sum(cl.convert(c("tax"), "percentage")), 4).alias("tax"),
        F.count_if(cl.convert(c("open"), "boolean")).alias("open"), F.min(cl.convert(c("shipped"), "datetime")).alias("first"),
        F.count(cl.convert(c("l_returnflag"), "numeric")).alias("bad"),
    ),
    """SELECT round(sum(round(l_extendedprice, 2)), 0) AS price, round(sum(l_tax / 100), 4) AS tax, count(*) FILTER (WHERE l_linestatus = 'O') AS open,
        min(l_shipdate)::DATE AS first, 0::BIGINT AS bad FROM lineitem""",
)

# --- missing values
NUMBERS = ("n_chars", "quality", "toxic")


def sql_skew(x: str) -> str:
    return f"(avg(power({x} - m_{x}, 3)) / power(stddev_pop({x}), 3))"


SKEWED = "WITH g AS (SELECT *, " + ", ".join(f"avg({x}) OVER () AS m_{x}" for x in NUMBERS) + f" FROM {GRADED}) "
add(
    "dq_fill_rule",
    lambda t: cl.fill_rule(graded(t), list(NUMBERS)),
    SKEWED + " UNION ALL ".join(
        f"""SELECT '{x}' AS "column", CASE WHEN avg(({x} IS NULL)::INT) > .7 THEN 'drop' WHEN avg(({x} IS NULL)::INT) > .5 THEN 'flag'
        WHEN abs({sql_skew(x)}) > 1 THEN 'median' ELSE 'mean' END AS rule FROM g"""
        for x in NUMBERS
    ),
)
add(
    "dq_fill_by_rule",
    lambda t: cl.fill_by_rule(t.events.select("event_id", F.when(c("event_type") != "error", c("value")).alias("value")), ["value"]).select("event_id", r("value", 6).alias("value")),
    """WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events), m AS (SELECT avg(v) AS a FROM e),
        s AS (SELECT abs(avg(power(v - a, 3)) / power(stddev_pop(v), 3)) AS k, median(v) AS md, any_value(a) AS a FROM e, m)
        SELECT event_id, round(coalesce(v, CASE WHEN k > 1 THEN md ELSE a END), 6) AS value FROM e, s""",
)
add("dq_fill_unknown", lambda t: graded(t).select("doc_id", F.coalesce(c("quality").cast("string"), F.lit("Unknown")).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic")), f"SELECT doc_id, coalesce(quality::VARCHAR, 'Unknown') AS quality, coalesce(toxic, 0) AS toxic FROM {GRADED}")
add("dq_drop_missing", lambda t: graded(t).dropna(subset=["quality", "toxic"]).select("doc_id"), f"SELECT doc_id FROM {GRADED} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
add("dq_fill_mode", lambda t: with_mode(t), f"WITH m AS (SELECT quality FROM {GRADED} WHERE quality IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT doc_id, coalesce(g.quality, m.quality) AS quality FROM {GRADED} g, m")
add(
    "dq_fill_along",
    lambda t: graded(t).select("doc_id", F.last("quality", ignorenulls=True).over(W.partitionBy("source").orderBy("doc_id")).alias("ahead"),
        F.first("quality", ignorenulls=True).over(W.partitionBy("source").orderBy("doc_id").rowsBetween(0, W.unboundedFollowing)).alias("back"), c("quality").isNull().alias("was_missing")),
    f"""SELECT doc_id, last_value(quality IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS ahead,
        first_value(quality IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back, quality IS NULL AS was_missing FROM {GRADED}""",
)


def with_mode(t):
    rows = graded(t)
    top = rows.where("quality is not null").groupBy(c("quality").alias("q")).agg(F.count("*").alias("n")).agg(F.min_by("q", F.struct(-c("n"), "q")).alias("_mode"))
    return rows.crossJoin(F.broadcast(top)).select("doc_id", F.coalesce("quality", "_mode").alias("quality"))


#: Regularised incomplete beta function I_x(a, b) by Simpson's rule over t = sin(u)^2, as a scalar SQL expression.
def sql_beta(x: str, a: str, b: str, n: int = 4000) -> str:
    return f"""(SELECT sum(CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * CASE WHEN u = 0 THEN CASE WHEN {a} > .5 THEN 0 ELSE 2 * exp(-lb) END
        ELSE 2 * exp((2 * {a} - 1) * ln(sin(u)) + (2 * {b} - 1) * ln(cos(u)) - lb) END) * any_value(h) / 3
        FROM (SELECT i, i * h AS u, h, lb FROM range(0, {n + 1}) r(i), (SELECT asin(sqrt({x})) / {n} AS h, lgamma({a}) + lgamma({b}) - lgamma({a} + {b}) AS lb)))"""


def sql_f_tail(f: str, d1: str, d2: str) -> str:
    return sql_beta(f"({d2} / ({d2} + {d1} * {f}))", f"({d2} / 2.0)", f"({d1} / 2.0)")


def sql_t_tails(t: str, v: str) -> str:
    return sql_beta(f"({v} / ({v} + {t} * {t}))", f"({v} / 2.0)", "0.5")


WELCH = """SELECT *, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)) AS dof FROM
    (SELECT {k} AS k, avg({x}) FILTER (WHERE {a}) AS m1, avg({x}) FILTER (WHERE {b}) AS m0, var_samp({x}) FILTER (WHERE {a}) AS v1, var_samp({x}) FILTER (WHERE {b}) AS v0,
    count({x}) FILTER (WHERE {a}) AS n1, count({x}) FILTER (WHERE {b}) AS n0 FROM {table})"""
add(
    "dq_missing_mechanism",
    lambda t: cl.mechanism(graded(t), "quality", ["n_chars", "doc_id"]),
    "WITH w AS (" + " UNION ALL ".join(WELCH.format(k=f"'{x}'", x=x, a="quality IS NULL", b="quality IS NOT NULL", table=GRADED) for x in ("n_chars", "doc_id"))
    + f"), p AS (SELECT k, {sql_t_tails('t', 'dof')} AS p FROM w), e AS (SELECT count(*) FILTER (WHERE p < .05) AS evidence FROM p), s AS (SELECT avg((quality IS NULL)::INT) * 100 AS pct FROM {GRADED}) "
    + "SELECT 'quality' AS \"column\", round(pct, 4) AS pct, evidence, CASE WHEN evidence > 0 THEN 'MAR' WHEN pct < 5 THEN 'MCAR' ELSE 'MNAR' END AS verdict FROM e, s",
)

# --- overviews
add(
    "agg_overview",
    lambda t: cl.overview(graded(t).drop("doc_id")),
    f"""WITH g AS (SELECT * EXCLUDE (doc_id) FROM {GRADED}), d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM g)), s AS (SELECT count(*) AS rows,
        sum((n_chars IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT + (quality IS NULL)::INT + (toxic IS NULL)::INT)::BIGINT AS missing FROM g)
        SELECT rows, 5 AS columns, missing, rows - n AS duplicates, round((rows - n) * 100 / rows, 4) AS duplicate_pct, 3 AS number_columns, 2 AS text_columns, 0 AS time_columns FROM d, s""",
)
add(
    "agg_issues",
    lambda t: cl.issues(t.documents.select("doc_id", "lang", F.lit("x").alias("kind"), c("n_chars").cast("string").alias("size")).withColumn("gone", F.when(c("lang") == "en", 1)), ["lang", "kind", "size", "gone"]),
    """WITH d AS (SELECT lang, n_chars::VARCHAR AS size, CASE WHEN lang = 'en' THEN 1 END AS gone FROM documents), n AS (SELECT count(*) AS n, count(DISTINCT size) AS s, count(gone) AS g, count(DISTINCT lang) AS l FROM d)
        SELECT 'kind' AS "column", 'Zero Variance' AS issue, 'High' AS severity UNION ALL SELECT 'gone', 'Mostly Missing', 'High' FROM n WHERE n - g > .5 * n
        UNION ALL SELECT 'gone', 'Zero Variance', 'High' UNION ALL SELECT 'size', 'High Cardinality', 'Medium' FROM n WHERE s > .5 * n
        UNION ALL SELECT 'lang', 'High Cardinality', 'Medium' FROM n WHERE l > .5 * n UNION ALL SELECT 'size', 'Numeric Text', 'Low'""",
)
add(
    "agg_duplicate_advice",
    lambda t: duplicate_advice(t),
    """WITH e AS (SELECT md5(text) AS k, count(*) AS n FROM documents GROUP BY 1), f AS (SELECT lang, source, n_chars, count(*) AS n FROM documents GROUP BY ALL)
        SELECT 'exact' AS kind, count(*) AS groups, sum(n - 1)::BIGINT AS removable, 'safe_to_remove' AS advice FROM e WHERE n > 1
        UNION ALL SELECT 'key', count(*), sum(n - 1)::BIGINT, 'review_required' FROM f WHERE n > 1""",
)
add("agg_one_to_one", lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")


def duplicate_advice(t):
    exact = t.documents.groupBy(F.md5("text").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    keyed = t.documents.groupBy("lang", "source", "n_chars").agg(F.count("*").alias("n")).where("n > 1")
    one = lambda df, kind, advice: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("groups"), F.sum(c("n") - 1).alias("removable"), F.lit(advice).alias("advice"))
    return one(exact, "exact", "safe_to_remove").unionAll(one(keyed, "key", "review_required"))


SHAPE = """CASE WHEN abs(skew) < .5 AND abs(kurtosis) < .5 THEN 'normal-like' WHEN abs(skew) < .5 THEN CASE WHEN kurtosis > 0 THEN 'symmetric, heavy tails' ELSE 'symmetric, light tails' END
    WHEN abs(skew) < 1 THEN 'moderately skewed' ELSE 'highly skewed' END"""
add(
    "agg_distribution_report",
    lambda t: cl.distribution_report(t.part, "p_retailprice", 3),
    f"""WITH b AS (SELECT avg(p_retailprice) AS a, quantile_cont(p_retailprice, .25) AS q1, quantile_cont(p_retailprice, .75) AS q3 FROM part), s AS (SELECT round(avg(p_retailprice), 3) AS mean,
        round(median(p_retailprice), 3) AS median, round(stddev_samp(p_retailprice), 3) AS std, round(avg(power(p_retailprice - a, 3)) / power(stddev_pop(p_retailprice), 3), 3) + 0.0 AS skew,
        round(avg(power(p_retailprice - a, 4)) / power(stddev_pop(p_retailprice), 4) - 3, 3) AS kurtosis,
        round(avg((p_retailprice < q1 - 1.5 * (q3 - q1) OR p_retailprice > q3 + 1.5 * (q3 - q1))::INT) * 100, 3) AS outlier_pct FROM part, b),
        m AS (SELECT p_retailprice AS mode FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT *, {SHAPE} AS shape FROM s, m""",
)

# --- outliers
add(
    "dq_severity",
    lambda t: cl.severities(t.events, "event_id", "value", 0.0, 500.0),
    """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events), k AS (SELECT event_id, abs(value - m) / sd AS z, CASE WHEN abs(value) > 1e308 THEN 'impossible'
        WHEN value < 0 OR value > 500 THEN 'domain' WHEN abs(value - m) / sd > 3 THEN 'statistical' END AS kind FROM events, s)
        SELECT event_id, kind, CASE WHEN kind <> 'statistical' OR z > 5 THEN 'critical' WHEN z > 4 THEN 'high' ELSE 'medium' END AS severity FROM k WHERE kind IS NOT NULL""",
)
FENCE = "(SELECT quantile_cont(value, .25) AS q1, quantile_cont(value, .75) AS q3, quantile_cont(value, .05) AS p5, quantile_cont(value, .95) AS p95, avg(value) AS m, stddev_samp(value) AS sd FROM events)"


def fenced(t):
    q1, q3, p5, p95 = exact_quantiles(t.events, "value", [0.25, 0.75, 0.05, 0.95])
    return t.events.withColumn("out", (c("value") < q1 - 1.5 * (q3 - q1)) | (c("value") > q3 + 1.5 * (q3 - q1))), p5, p95


def treatments(t):
    rows, p5, p95 = fenced(t)
    rows = with_totals(rows, _mean=F.avg(F.when(~c("out"), c("value"))))
    winsor = F.greatest(F.least("value", F.lit(p95)), F.lit(p5))
    return rows.select("event_id", c("out").alias("flag"), F.when(~c("out"), c("value")).alias("kept"), r(winsor, 6).alias("winsor"), r(F.when(c("out"), c("_mean")).otherwise(c("value")), 6).alias("imputed"))


add(
    "dq_outlier_treatments",
    treatments,
    f"""WITH e AS (SELECT event_id, value, p5, p95, (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS flag FROM events, {FENCE})
        SELECT event_id, flag, CASE WHEN NOT flag THEN value END AS kept, round(greatest(least(value, p95), p5), 6) AS winsor,
        round(CASE WHEN flag THEN (SELECT avg(value) FROM e WHERE NOT flag) ELSE value END, 6) AS imputed FROM e""",
)


def consensus(t):
    rows, _, _ = fenced(t)
    mid = exact_quantiles(t.events, "value", [0.5])[0]
    mad = exact_quantiles(t.events, F.abs(c("value") - mid), [0.5])[0]
    rows = with_totals(rows, _m=F.avg("value"), _s=F.stddev_samp("value"))
    votes = c("out").cast("int") + (F.abs(c("value") - c("_m")) > 3 * c("_s")).cast("int") + (0.6745 * F.abs(c("value") - mid) / mad > 3.5).cast("int")
    return rows.select("event_id", votes.alias("votes")).where("votes >= 2")


add(
    "dq_outlier_consensus",
    consensus,
    f"""WITH d AS (SELECT median(value) AS md FROM events), a AS (SELECT median(abs(value - md)) AS mad FROM events, d)
        SELECT * FROM (SELECT event_id, (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::INT + (abs(value - m) > 3 * sd)::INT + (.6745 * abs(value - md) / mad > 3.5)::INT AS votes
        FROM events, d, a, {FENCE}) WHERE votes >= 2""",
)
add("dq_lof", lambda t: cl.local_outlier_factor(t.part, "p_partkey", "p_retailprice").select("p_partkey", (c("lof") > 1.5).alias("outlier")))

# --- drift
OLD, NEW = "(SELECT * FROM documents WHERE lang IN ('en', 'de'))", "(SELECT * FROM documents WHERE lang NOT IN ('en', 'de'))"
add(
    "dq_null_drift",
    lambda t: cl.null_drift(graded(t).where("lang in ('en', 'de')"), graded(t).where("lang not in ('en', 'de')"), ["quality", "source"]).select("column", r("before").alias("before"), r("after").alias("after"), "drifted"),
    " UNION ALL ".join(
        f"""SELECT '{x}' AS "column", round(b, 4) AS before, round(a, 4) AS after, abs(a - b) > 5 AS drifted FROM (SELECT avg(({x} IS NULL)::INT) FILTER (WHERE lang IN ('en', 'de')) * 100 AS b,
        avg(({x} IS NULL)::INT) FILTER (WHERE lang NOT IN ('en', 'de')) * 100 AS a FROM {GRADED})"""
        for x in ("quality", "source")
    ),
)


def scored_drift(t):
    before, after = t.customer, t.customer.drop("c_mktsegment").withColumn("c_acctbal", c("c_acctbal").cast("string")).withColumn("c_new", F.lit(1))
    found = dq.schema_drift(before, after)
    sizes = {k: len(v) for k, v in found.items()}
    names = list(sizes)
    severe = after.agg(F.count("*").alias("a")).crossJoin(before.agg(F.count("*").alias("b"))).select(F.when(F.abs(c("a") - c("b")) > 0.2 * c("b"), 10).otherwise(0).alias("severe"))
    return severe.select(*[F.lit(sizes[k]).alias(k) for k in names], cl.drift_score(sizes[names[0]], sizes[names[1]], sizes[names[2]], c("severe")).alias("score"))


def ks_verdict(t):
    a, b = t.orders.where("o_orderstatus = 'F'"), t.orders.where("o_orderstatus = 'O'")
    one = stats.ks_statistic(a, b, "o_totalprice").crossJoin(a.agg(F.count("o_totalprice").alias("n"))).crossJoin(b.agg(F.count("o_totalprice").alias("m")))
    tail = one.withColumn("p", dist.ks_tail(c("ks"), c("n"), c("m")))
    return tail.select(r("ks", 6).alias("ks"), r("p", 6).alias("p"), (c("p") < 0.05).alias("drifted"))


add("dq_drift_score", scored_drift)
add(
    "dq_ks_verdict",
    ks_verdict,
    """WITH x AS (SELECT o_totalprice AS x, (o_orderstatus = 'F')::INT AS a, (o_orderstatus = 'O')::INT AS b FROM orders WHERE o_orderstatus IN ('F', 'O')), n AS (SELECT sum(a) AS n, sum(b) AS m FROM x),
        d AS (SELECT max(abs(ra / n - rb / m)) AS ks, any_value(n) AS n, any_value(m) AS m FROM (SELECT sum(a) OVER w AS ra, sum(b) OVER w AS rb FROM x WINDOW w AS (ORDER BY x)), n),
        p AS (SELECT ks, least(1, greatest(0, (SELECT 2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * ks * ks * n * m / (n + m))) FROM range(1, 101) r(k)))) AS p FROM d)
        SELECT round(ks, 6) AS ks, round(p, 6) AS p, p < .05 AS drifted FROM p""",
)

# --- tests with p-values
add(
    "agg_anova_p",
    lambda t: stats.anova(t.orders, "o_orderpriority", "o_totalprice").withColumn("p", dist.f_tail(c("f"), c("df_between"), c("df_within"))).select(r("f", 5).alias("f"), r("p", 5).alias("p")),
    f"""WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS w FROM g),
        f AS (SELECT (sum(g.n * power(m - gm, 2)) / (any_value(k) - 1)) / (any_value(w) / (any_value(s.n) - any_value(k))) AS f, any_value(k) - 1.0 AS d1, (any_value(s.n) - any_value(k))::DOUBLE AS d2 FROM g, s)
        SELECT round(f, 5) AS f, round({sql_f_tail('f', 'd1', 'd2')}, 5) AS p FROM f""",
)


def welch(t):
    x = lambda s, f: f(F.when(c("o_orderstatus") == s, c("o_totalprice")))
    one = t.orders.agg(*[x(s, f).alias(f"{n}{i}") for i, s in enumerate(("O", "F")) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    a, b = c("v0") / c("n0"), c("v1") / c("n1")
    one = one.select(((c("m1") - c("m0")) / F.sqrt(a + b)).alias("t"), ((a + b) * (a + b) / (a * a / (c("n0") - 1) + b * b / (c("n1") - 1))).alias("dof"))
    return one.withColumn("p", dist.t_tails(c("t"), c("dof"))).select(r("t", 5).alias("t"), r("dof", 3).alias("dof"), r("p", 5).alias("p"))


add("agg_t_test_p", welch, "WITH w AS (" + WELCH.format(k="1", x="o_totalprice", a="o_orderstatus = 'F'", b="o_orderstatus = 'O'", table="orders") + f") SELECT round(t, 5) AS t, round(dof, 3) AS dof, round({sql_t_tails('t', 'dof')}, 5) AS p FROM w")
CHI = """WITH o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS x FROM o),
    s AS (SELECT sum(power(n - x, 2) / x) AS chi2 FROM e), k AS (SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM o)"""
add(
    "agg_chi_square_p",
    lambda t: stats.chi_square(t.orders, "o_orderstatus", "o_orderpriority").withColumn("p", dist.chi2_tail(c("chi2"), c("dof"))).select(r("chi2", 5).alias("chi2"), "dof", r("p", 5).alias("p")),
    CHI + """, h AS (SELECT chi2, dof, sqrt(chi2 / 2) / 4000 AS h FROM s, k)
        SELECT round(chi2, 5) AS chi2, dof, round(1 - sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END *
        CASE WHEN i = 0 THEN 0 ELSE 2 * power(i * h, dof - 1) * exp(-power(i * h, 2)) END) * h / 3 / gamma(dof / 2.0), 5) AS p FROM h, range(0, 4001) r(i) GROUP BY chi2, dof, h""",
)


def correlations(t):
    pairs = (("p_size", "p_retailprice"), ("p_size", "p_partkey"), ("p_retailprice", "p_partkey"))
    one = t.part.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r"), F.count("*").alias("n")) for a, b in pairs]).alias("x")).select(F.inline("x"))
    tested = one.withColumn("p", dist.corr_tails(c("r"), c("n")))
    return tested.select("a", "b", r("r", 5).alias("r"), r("p", 5).alias("p"), (c("p") < 0.05 / len(pairs)).alias("bonferroni"))


CORR_P = sql_beta("x", "((n - 2) / 2.0)", "0.5")
add(
    "agg_corr_p",
    correlations,
    "WITH s AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM part" for a, b in (("p_size", "p_retailprice"), ("p_size", "p_partkey"), ("p_retailprice", "p_partkey")))
    + f"), u AS (SELECT *, least(1, greatest(0, 1 - r * r)) AS x FROM s), p AS (SELECT a, b, r, {CORR_P} AS p FROM u) SELECT a, b, round(r, 5) AS r, round(p, 5) AS p, p < .05 / 3 AS bonferroni FROM p",
)


def spearman_p(t):
    ranks = stats.average_ranks(stats.average_ranks(t.part, "p_size", "x"), "p_retailprice", "y")
    one = ranks.agg(F.corr("x", "y").alias("rho"), F.count("*").alias("n"))
    return one.withColumn("p", dist.corr_tails(c("rho"), c("n"))).select(r("rho", 5).alias("rho"), r("p", 5).alias("p"))


add(
    "agg_spearman_p",
    spearman_p,
    f"""WITH k AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS y FROM part),
        s AS (SELECT corr(x, y) AS rho, count(*) AS n FROM k), u AS (SELECT *, least(1, greatest(0, 1 - rho * rho)) AS x FROM s) SELECT round(rho, 5) AS rho, round({CORR_P}, 5) AS p FROM u""",
)
KENDALL = """WITH g AS (SELECT p_size AS x, round(p_retailprice / 100)::INT AS y, count(*) AS n FROM part GROUP BY 1, 2), p AS (SELECT a.n * b.n AS w, sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x = b.x AS tx, a.y = b.y AS ty FROM g a, g b
    WHERE (a.x, a.y) <> (b.x, b.y)), z AS (SELECT sum(w * s) AS s, sum(w) FILTER (WHERE NOT tx) AS nx, sum(w) FILTER (WHERE NOT ty) AS ny FROM p) SELECT round(s / sqrt(nx::DOUBLE * ny), 6) AS tau FROM z"""


def kendall(t):
    """Kendall's tau-b of two binned columns from their cells' counts, by running sums over the cells of the grid."""
    cells = t.part.groupBy(c("p_size").alias("x"), F.round(c("p_retailprice") / 100).cast("int").alias("y")).agg(F.count("*").alias("n"))
    lower = W.partitionBy("y").orderBy("x").rangeBetween(W.unboundedPreceding, -1)
    xs, ys = cells.select("x").distinct(), cells.select("y").distinct()
    grid = xs.join(F.broadcast(ys)).join(cells, ["x", "y"], "left").fillna(0, ["n"])  # bins of both columns: a table of bounded size
    below = grid.withColumn("_left", F.coalesce(F.sum("n").over(lower), F.lit(0)))
    column = W.partitionBy("x").orderBy("y")
    pairs = below.select("n", F.coalesce(F.sum("_left").over(column.rangeBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("up"), F.coalesce(F.sum("_left").over(column.rangeBetween(1, W.unboundedFollowing)), F.lit(0)).alias("down"))
    total = pairs.agg(F.sum(c("n") * (c("up") - c("down"))).alias("s"), F.sum("n").alias("all"))
    ties = lambda k: cells.groupBy(k).agg(F.sum("n").alias("m")).agg(F.sum(c("m") * (c("m") - 1) / 2).alias(f"t{k}"))
    pairs_of = c("all") * (c("all") - 1) / 2
    return total.crossJoin(ties("x")).crossJoin(ties("y")).select(r(F.try_divide(c("s"), F.sqrt((pairs_of - c("tx")) * (pairs_of - c("ty")))), 6).alias("tau"))


add("agg_kendall", kendall, KENDALL)


def rfm_scores(t):
    base = ft.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice")
    for column, out in (("recency", "r"), ("frequency", "f"), ("monetary", "m")):
        base = ft.quantile_bins(base, column, 5, out)
    score = F.concat((6 - c("r")).cast("string"), c("f").cast("string"), c("m").cast("string"))
    return base.select("o_custkey", score.alias("score"), ft.rfm_label(score).alias("label"))


EDGES = ", ".join(f"quantile_cont({v}, {q}) AS {v}{i}" for v in "rfm" for i, q in enumerate((0.2, 0.4, 0.6, 0.8)))
BIN = lambda v: "(1 + " + " + ".join(f"({v} > {v}{i})::INT" for i in range(4)) + ")"
add(
    "ft_rfm_labels",
    rfm_scores,
    f"""WITH g AS (SELECT o_custkey, date_diff('day', max(o_orderdate)::DATE, (SELECT max(o_orderdate) FROM orders)::DATE) AS r, count(*) AS f, round(sum(o_totalprice), 2) AS m FROM orders GROUP BY 1), e AS (SELECT {EDGES} FROM g),
        s AS (SELECT o_custkey, (6 - {BIN('r')})::VARCHAR || {BIN('f')} || {BIN('m')} AS score FROM g, e) SELECT o_custkey, score, CASE WHEN score IN ('555','554','544','545','454','455','445') THEN 'Champions'
        WHEN score IN ('543','444','435','355','354','345','344') THEN 'Loyal Customers' WHEN score IN ('553','551','552','541','542','533','532','531','452','451') THEN 'Potential Loyalists'
        WHEN score IN ('512','511','422','421','412','411','311') THEN 'New Customers' WHEN score IN ('155','154','144','214','215','115','114') THEN 'At Risk' WHEN score IN ('155','254','245') THEN 'Can''t Lose Them' ELSE 'Others' END AS label FROM s""",
)
