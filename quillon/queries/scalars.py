"""Scalar functions on text, dates, numbers, and nested values."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions import numeric as num
from ..operators.features import scale
from ..operators.stats import fences
from . import Registry

R = Registry()
add = R.add
c = F.col

#: Odd names, addresses and numbers that the text functions are shown on.
SAMPLES = ["  O'Neil   mary-ann ", "JOHN  SMITH", "12 N Main St. Apt 4", "visit https://a.example/x?y=1 now", "a@b.co", "not an email", "+1 (555) 123-4567", "555.123.4567", "<b>bold</b> &amp; more", "Ünïcode çafé", "$1,234.50", "12%", "Yes", "off", "N/A", "ab12cd345", "Passw0rd", "one. Two! Three?", ""]


def samples(t):
    """All documents, and the samples under negative numbers."""
    own = t.spark.createDataFrame([(-1 - i, s) for i, s in enumerate(SAMPLES)], "i long, s string")
    return t.documents.select(c("doc_id").alias("i"), c("text").alias("s")).unionAll(own)


def values() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    own = "(VALUES " + ", ".join(f"({-1 - i}, {q(s)})" for i, s in enumerate(SAMPLES)) + ") v(i, s)"
    return f"(SELECT doc_id AS i, text AS s FROM documents UNION ALL SELECT i, s FROM {own})"


def addresses(t):
    return t.customer.select(c("c_custkey").alias("i"), F.concat(c("c_custkey").cast("string"), F.lit("  Oak St. Ste "), c("c_nationkey").cast("string"), F.lit(", "), "c_mktsegment", F.lit(" Hwy  Fl 3 blvd. Pl")).alias("s"))


ADDRESSES = "(SELECT c_custkey AS i, c_custkey || '  Oak St. Ste ' || c_nationkey || ', ' || c_mktsegment || ' Hwy  Fl 3 blvd. Pl' AS s FROM customer)"


#: The character references that the tables hold.
SQL_HTML = "regexp_replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', '', 'g')"
SPACES = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def sql_title(x: str) -> str:
    runs = f"regexp_extract_all(lower({x}), '\\p{{L}}+|[^\\p{{L}}]+')"
    return f"array_to_string(list_transform({runs}, lambda p: CASE substr(p, 1, 1) WHEN 'ß' THEN 'Ss' ELSE upper(substr(p, 1, 1)) END || substr(p, 2)), '')"


def sql_upper(x: str) -> str:
    return f"replace(replace(upper({x}), 'ß', 'SS'), 'ẞ', 'SS')"


#: What the SQL replaces, stated apart from the library's tables.
STREETS = (("st", "street"), ("ave", "avenue"), ("blvd", "boulevard"), ("dr", "drive"), ("ln", "lane"), ("rd", "road"), ("ct", "court"), ("pl", "place"), ("apt", "apartment"), ("ste", "suite"), ("fl", "floor"), ("hwy", "highway"))
BROKEN = (("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ('â€"', "-"), ("â€¢", "•"), ("Ã©", "é"), ("Ã¨", "è"), ("\0", ""), ("\ufeff", ""))


def sql_expand(x: str) -> str:
    x = f"lower({x})"
    for short, full in STREETS:
        x = rf"regexp_replace({x}, '\b{short}\.?\b', '{full}', 'g')"
    return x


def sql_encoding(x: str) -> str:
    quote = lambda v: "chr(0)" if v == "\0" else "'" + v.replace("'", "''") + "'"
    for wrong, right in BROKEN:
        x = f"replace({x}, {quote(wrong)}, {quote(right)})"
    return x


def on_samples(name: str, make, sql: str | None, table=samples, source: str | None = None, digest: bool = True) -> None:
    """The function on all texts of a table; long results are compared by their MD5."""
    seen = (lambda x: F.md5(x.cast("string"))) if digest else (lambda x: x)
    result = sql and (f"md5(({sql})::VARCHAR)" if digest else sql)
    add(name, lambda t: table(t).select("i", seen(make(c("s"))).alias("r")), sql and f"SELECT i, {result} AS r FROM {source or values()}")


on_samples("str_lower_strip", lambda s: F.lower(F.trim(s)), "lower(trim(s))")
on_samples("str_upper", F.upper, sql_upper("s"))
on_samples("str_squeeze", text.squeeze, r"trim(regexp_replace(s, '\s+', ' ', 'g'))")
on_samples("str_title", text.title, sql_title("s"))
on_samples("str_literal_replace", lambda s: F.replace(s, F.lit("$"), F.lit("")), "replace(s, '$', '')")
on_samples("str_dict_replace", lambda s: F.when(s == "Yes", "yes").when(s == "off", "no").otherwise(s), "CASE s WHEN 'Yes' THEN 'yes' WHEN 'off' THEN 'no' ELSE s END")
on_samples("str_regex_replace", text.strip_special, r"regexp_replace(s, '[^a-zA-Z0-9\s]', '', 'g')")
on_samples("str_strip_html", text.strip_html, SQL_HTML.format("s"))
on_samples("str_strip_urls", text.strip_urls, r"regexp_replace(s, 'https?://\S+|www\.\S+', '', 'g')")
on_samples("str_accents", text.strip_accents, "strip_accents(s)")
on_samples("str_emails_removed", text.strip_emails, r"regexp_replace(s, '\S+@\S+\.\S+', '', 'g')")
on_samples("str_ascii", text.to_ascii, "regexp_replace(strip_accents(s), '[^\\x00-\\x7F]', '', 'g')")
on_samples("str_fix_encoding", text.fix_encoding, sql_encoding("s"))
on_samples("str_expand_abbreviations", text.expand_abbreviations, sql_expand("s"), addresses, ADDRESSES)
on_samples("str_clean_name", lambda s: text.clean(s, "name"), "strip_accents(" + sql_title("regexp_replace(" + SPACES.format("s") + r", '[^a-zA-Z0-9\s\-'']', '', 'g')") + ")")
on_samples("str_clean_address", lambda s: text.clean(s, "address"), sql_title(sql_expand(SPACES.format("s"))), addresses, ADDRESSES)
on_samples("str_clean_description", lambda s: text.clean(s, "description"), SPACES.format("regexp_replace(" + SQL_HTML.format(sql_encoding("s")) + r", 'https?://\S+|www\.\S+', '', 'g')"))
on_samples("str_clean_code", lambda s: text.clean(s, "code"), "regexp_replace(" + sql_upper("trim(s)") + r", '\s+', '', 'g')")
on_samples("str_phone", text.phone, r"CASE WHEN length(regexp_replace(s, '\D', '', 'g')) = 10 THEN regexp_replace(regexp_replace(s, '\D', '', 'g'), '^(...)(...)(....)$', '(\1) \2-\3') WHEN length(regexp_replace(s, '\D', '', 'g')) = 11 AND regexp_replace(s, '\D', '', 'g') LIKE '1%' THEN regexp_replace(regexp_replace(s, '\D', '', 'g'), '^1(...)(...)(....)$', '+1 (\1) \2-\3') ELSE s END")
on_samples("str_is_email", text.is_email, f"regexp_matches(s, '{text.EMAIL}')")
on_samples("str_is_url", text.is_url, r"regexp_matches(s, '(?i)^https?://[^\s/$.?#].[^\s]*$')")
on_samples("str_is_phone", text.is_phone, r"length(regexp_replace(s, '\D', '', 'g')) BETWEEN 10 AND 15")
on_samples("str_password", text.strong_password, "regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[a-z]') AND regexp_matches(s, '[0-9]') AND length(s) >= 8")
on_samples("str_extract_first", lambda s: text.extract_first(s, r"(\d+)", "0000", "CUS-"), r"'CUS-' || coalesce(nullif(regexp_extract(s, '(\d+)', 1), ''), '0000')")
on_samples("str_extract_all", lambda s: F.array_join(F.regexp_extract_all(s, F.lit(r"(\d+)"), 1), ","), r"array_to_string(regexp_extract_all(s, '(\d+)'), ',')")
on_samples("str_split_first", lambda s: F.lower(F.get(F.split(F.trim(s), r"\s+"), F.lit(0))), r"lower(regexp_split_to_array(trim(s), '\s+')[1])")
on_samples("str_contains", lambda s: s.rlike("[A-Z]{2,}"), "regexp_matches(s, '[A-Z]{2,}')")
on_samples("str_match_start", lambda s: s.rlike("^(?:[0-9]+)"), "regexp_matches(s, '^(?:[0-9]+)')")
on_samples("str_hash", lambda s: F.md5(s), "md5(s)")
on_samples("str_match_key", text.match_key, SPACES.format(r"regexp_replace(lower(s), '[^\w\s]', '', 'g')"))
on_samples("str_boolean", text.as_boolean, "CASE WHEN lower(trim(s)) IN ('true','t','yes','y','1','on') THEN true WHEN lower(trim(s)) IN ('false','f','no','n','0','off') THEN false END")
on_samples("str_number", text.as_number, r"try_cast(regexp_replace(s, '[$€£¥,%\s]', '', 'g') AS DOUBLE) / CASE WHEN trim(s) LIKE '%\%' ESCAPE '\' THEN 100 ELSE 1 END", digest=False)
on_samples("str_tokens", lambda s: F.size(text.tokens(s)), r"len(list_filter(regexp_split_to_array(lower(regexp_replace(s, '[^\w\s]', ' ', 'g')), '\s+'), lambda x: x <> ''))::INT")
on_samples("str_sentences", lambda s: F.size(text.sentences(s)), "len(list_filter(regexp_split_to_array(s, '[.!?]'), lambda x: trim(x) <> ''))::INT")
on_samples("str_sanitise", lambda s: F.regexp_replace(s, "[^a-zA-Z0-9 _-]", ""), "regexp_replace(s, '[^a-zA-Z0-9 _-]', '', 'g')")
add("str_concat", lambda t: t.supplier.select("s_suppkey", F.concat_ws("_", c("s_suppkey").cast("string"), "s_name").alias("key")), "SELECT s_suppkey, s_suppkey || '_' || s_name AS key FROM supplier")
add("str_format", lambda t: t.supplier.select("s_suppkey", F.format_number("s_acctbal", 2).alias("money"), F.format_string("%05d", c("s_suppkey")).alias("code")), "SELECT s_suppkey, format('{:,.2f}', s_acctbal) AS money, printf('%05d', s_suppkey) AS code FROM supplier")
add("str_redact", lambda t: t.documents.select("doc_id", F.md5(F.regexp_replace(F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"), "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[ssn]")).alias("digest")), r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '[0-9]{3}-[0-9]{2}-[0-9]{4}', '[ssn]', 'g')) AS digest FROM documents")
add("str_pii_counts", lambda t: t.documents.agg(F.sum(F.regexp_count("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))).cast("long").alias("emails"), F.count_if(c("text").rlike("[0-9]{3}-[0-9]{3}-[0-9]{4}")).alias("with_phone")), r"SELECT sum(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')))::BIGINT AS emails, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{3}-[0-9]{3}-[0-9]{4}')) AS with_phone FROM documents")
add("str_jaro_winkler", lambda t: t.supplier.alias("a").join(t.supplier.alias("b"), c("b.s_suppkey") == c("a.s_suppkey") + 1).select(c("a.s_suppkey").alias("k"), F.round(text.jaro_winkler(c("a.s_name"), c("b.s_name")), 6).alias("jw")), "SELECT a.s_suppkey AS k, round(jaro_winkler_similarity(a.s_name, b.s_name), 6) AS jw FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
add("str_sequence_ratio", lambda t: t.nation.select("n_nationkey", F.round(text.sequence_ratio(c("n_name"), F.lit("NATION_1")), 6).alias("ratio")))
add("str_token_sort_ratio", lambda t: t.nation.select("n_nationkey", F.round(text.token_sort_ratio(F.concat_ws(" ", "n_name", F.lit("of")), F.concat_ws(" ", F.lit("of"), "n_name")), 4).alias("ratio")), "SELECT n_nationkey, 100.0::DOUBLE AS ratio FROM nation")
add("str_levenshtein", lambda t: t.nation.select("n_nationkey", F.levenshtein("n_name", F.lit("FRANCE")).alias("d")), "SELECT n_nationkey, levenshtein(n_name, 'FRANCE')::INT AS d FROM nation")
add("str_change_log", lambda t: samples(t).select("i", F.explode(F.filter(F.array(F.struct(F.lit("strip").alias("rule"), F.trim("s").alias("after")), F.struct(F.lit("squeeze").alias("rule"), text.squeeze(c("s")).alias("after"))), lambda x: x["after"] != c("s"))).alias("x")).select("i", "x.rule", "x.after"), f"SELECT i, 'strip' AS rule, trim(s) AS after FROM {values()} WHERE trim(s) <> s UNION ALL SELECT i, 'squeeze', trim(regexp_replace(s, '\\s+', ' ', 'g')) FROM {values()} WHERE trim(regexp_replace(s, '\\s+', ' ', 'g')) <> s")

# --- dates
D = "o_orderdate"
add("dt_components", lambda t: t.orders.select("o_orderkey", *[dates.calendar(c(D))[k].alias(k) for k in ("year", "quarter", "month", "week", "day", "day_of_year", "day_of_week", "is_weekend", "is_month_start", "is_month_end", "season")]), "SELECT o_orderkey, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, month(o_orderdate) AS month, week(o_orderdate) AS week, day(o_orderdate) AS day, dayofyear(o_orderdate) AS day_of_year, isodow(o_orderdate) - 1 AS day_of_week, isodow(o_orderdate) >= 6 AS is_weekend, day(o_orderdate) = 1 AS is_month_start, o_orderdate::DATE = last_day(o_orderdate) AS is_month_end, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season FROM orders")
add("dt_to_date", lambda t: t.orders.select("o_orderkey", F.to_date(D).alias("d")), "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders")
add("dt_parse_coerce", lambda t: t.spark.createDataFrame([(0, "2023-01-31"), (1, "2023-13-45"), (2, "31/12/2022"), (3, "invalid"), (4, None), (5, "2024-02-29"), (6, "2023-02-29")], "i int, s string").select("i", F.try_to_date("s", "yyyy-MM-dd").alias("d")), "SELECT i, try_cast(CASE WHEN s LIKE '____-__-__' THEN s END AS DATE) AS d FROM (VALUES (0, '2023-01-31'), (1, '2023-13-45'), (2, '31/12/2022'), (3, 'invalid'), (4, NULL), (5, '2024-02-29'), (6, '2023-02-29')) v(i, s)")
add("dt_parse_formats", lambda t: t.spark.createDataFrame([(0, "2023-01-31"), (1, "31/12/2022"), (2, "12/31/2022"), (3, "20230131"), (4, "Jan 05, 2024"), (5, "x")], "i int, s string").select("i", dates.parse_date(c("s")).alias("d")), "SELECT * FROM (VALUES (0, DATE '2023-01-31'), (1, DATE '2022-12-31'), (2, DATE '2022-12-31'), (3, DATE '2023-01-31'), (4, DATE '2024-01-05'), (5, NULL)) v(i, d)")
add("dt_names_and_formats", lambda t: t.orders.select("o_orderkey", F.date_format(D, "EEEE").alias("day"), F.date_format(D, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(D, "HH").alias("hour")), "SELECT o_orderkey, dayname(o_orderdate) AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%H') AS hour FROM orders")
add("dt_periods", lambda t: t.orders.select("o_orderkey", F.to_date(F.date_trunc("month", D)).alias("month"), dates.week_end(c(D)).alias("week_end")), "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, (date_trunc('week', o_orderdate) + INTERVAL 6 DAY)::DATE AS week_end FROM orders")
add("dt_cyclic", lambda t: t.orders.select("o_orderkey", *[(F.round(x, 6) + F.lit(0.0)).alias(n) for n, x in zip(("s", "k"), dates.cyclic(F.month(D), 12), strict=True)]), "SELECT o_orderkey, round(sin(month(o_orderdate) * (2 * pi() / 12)), 6) + 0.0::DOUBLE AS s, round(cos(month(o_orderdate) * (2 * pi() / 12)), 6) + 0.0::DOUBLE AS k FROM orders")
add("dt_since", lambda t: t.orders.select("o_orderkey", *[v.alias(k) for k, v in dates.since(c(D), F.lit("1999-01-01").cast("date")).items()]), "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1999-01-01') AS days, trunc(date_diff('day', o_orderdate::DATE, DATE '1999-01-01') / 7)::INT AS weeks, 1999 - year(o_orderdate) AS years FROM orders")
add("dt_arithmetic", lambda t: t.orders.select("o_orderkey", F.date_add(F.to_date(D), 7).alias("d7"), F.add_months(F.to_date(D), 1).alias("m1")), "SELECT o_orderkey, (o_orderdate::DATE + 7)::DATE AS d7, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS m1 FROM orders")
add("dt_age_hours", lambda t: t.events.agg(F.round(dates.age_hours(F.max("ts"), F.lit("2030-01-01").cast("timestamp")), 4).alias("age")), "SELECT round((epoch(TIMESTAMP '2030-01-01') - epoch(max(ts))) / 3600, 4) AS age FROM events")
add("dt_window_literal", lambda t: t.orders.where(c(D).between("1995-03-01", "1995-03-31")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-03-31'")

# --- numbers
P = "p_retailprice"
add("math_scalars", lambda t: t.part.select("p_partkey", *[F.round(x, 6).alias(n) for n, x in (("sq", F.sqrt(P)), ("cb", F.cbrt(P)), ("ln", F.ln(P)), ("pw", F.pow("p_size", F.lit(2))), ("ab", F.abs(c(P) - 1200)))]), "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS sq, round(cbrt(p_retailprice), 6) AS cb, round(ln(p_retailprice), 6) AS ln, round(power(p_size, 2), 6) AS pw, round(abs(p_retailprice - 1200), 6) AS ab FROM part")
add("math_clip", lambda t: t.part.select("p_partkey", num.clip(c("p_size"), F.lit(10), F.lit(40)).alias("v")), "SELECT p_partkey, greatest(least(p_size, 40), 10) AS v FROM part")
add("math_winsorise", lambda t: fences(t.orders, "o_totalprice", "percentile", 5).withColumnsRenamed({"low": "lo", "high": "hi"}).select("o_orderkey", F.round(num.clip(c("o_totalprice"), c("lo"), c("hi")), 4).alias("v")), "SELECT o_orderkey, round(greatest(least(o_totalprice, hi), lo), 4) AS v FROM orders, (SELECT quantile_cont(o_totalprice, .05) AS lo, quantile_cont(o_totalprice, .95) AS hi FROM orders)")
add("math_overtime", lambda t: t.part.select("p_partkey", F.least("p_size", F.lit(40)).alias("base"), F.greatest(c("p_size") - 40, F.lit(0)).alias("over")), "SELECT p_partkey, least(p_size, 40) AS base, greatest(p_size - 40, 0) AS over FROM part")
add("math_scaling", lambda t: scale(scale(scale(t.part, P, "min_max", "mm"), P, "z", "z"), P, "robust", "rb").select("p_partkey", *[F.round(k, 6).alias(k) for k in ("mm", "z", "rb")]), "SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS mm, round((p_retailprice - m) / s, 6) AS z, round((p_retailprice - md) / iqr, 6) AS rb FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s, median(p_retailprice) AS md, quantile_cont(p_retailprice, .75) - quantile_cont(p_retailprice, .25) AS iqr FROM part)")
add("math_scaler_choice", lambda t: t.lineitem.agg(F.abs(F.skewness("l_extendedprice")).alias("s")).select(F.when(c("s") > 1, "robust").when(c("s") < 0.5, "standard").otherwise("robust").alias("scaler")), "SELECT CASE WHEN abs(s) > 1 THEN 'robust' WHEN abs(s) < 0.5 THEN 'standard' ELSE 'robust' END AS scaler FROM (SELECT avg(power((l_extendedprice - m) / d, 3)) AS s FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS d FROM lineitem))")
VEC = "(SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
pair = lambda t: t.embeddings.select("vec_id", c("embedding").cast("array<double>").alias("x")).join(t.embeddings.select((c("vec_id") - 1).alias("vec_id"), c("embedding").cast("array<double>").alias("y")), "vec_id")
add("math_distances", lambda t: pair(t).select("vec_id", F.round(num.distance(c("x"), c("y"), 2), 5).alias("l2"), F.round(num.distance(c("x"), c("y"), 1), 5).alias("l1"), F.round(num.distance(c("x"), c("y"), 3), 5).alias("l3"), F.round(num.dot(c("x"), c("y")), 5).alias("dot")), f"SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(x, y), lambda p: power(p[1] - p[2], 2)))), 5) AS l2, round(list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))), 5) AS l1, round(power(list_sum(list_transform(list_zip(x, y), lambda p: power(abs(p[1] - p[2]), 3))), 1.0 / 3), 5) AS l3, round(list_sum(list_transform(list_zip(x, y), lambda p: p[1] * p[2])), 5) AS dot FROM {VEC}")
add("math_norms", lambda t: pair(t).select("vec_id", F.round(num.norm(c("x"), 1), 5).alias("n1"), F.round(num.norm(c("x"), 2), 5).alias("n2"), F.round(num.norm(c("x"), math.inf), 5).alias("ninf"), F.round(num.norm(c("x"), -math.inf), 5).alias("nmin"), num.norm(c("x"), 0).alias("n0")), f"SELECT vec_id, round(list_sum(list_transform(x, lambda p: abs(p))), 5) AS n1, round(sqrt(list_sum(list_transform(x, lambda p: p * p))), 5) AS n2, round(list_max(list_transform(x, lambda p: abs(p))), 5) AS ninf, round(list_min(list_transform(x, lambda p: abs(p))), 5) AS nmin, len(list_filter(x, lambda p: p <> 0))::DOUBLE AS n0 FROM {VEC}")
add("math_matmul", lambda t: t.lineitem.select(c("l_suppkey").alias("i"), (c("l_partkey") % 10).alias("k"), c("l_quantity").alias("v")).groupBy("i", "k").agg(F.sum("v").alias("v")).alias("a").join(t.part.select((c("p_partkey") % 10).alias("k"), (c("p_size") % 3).alias("j"), c("p_size").cast("double").alias("w")).groupBy("k", "j").agg(F.sum("w").alias("w")).alias("b"), "k").groupBy("i", "j").agg(F.round(F.sum(c("v") * c("w")), 2).alias("v")), "WITH a AS (SELECT l_suppkey AS i, l_partkey % 10 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT p_partkey % 10 AS k, p_size % 3 AS j, sum(p_size::DOUBLE) AS w FROM part GROUP BY 1, 2) SELECT i, j, round(sum(v * w), 2) AS v FROM a JOIN b ON a.k = b.k GROUP BY 1, 2")
add("math_mahalanobis", lambda t: mahalanobis(t), "WITH m AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b, var_samp(p_size) AS va, var_samp(p_retailprice) AS vb, covar_samp(p_size, p_retailprice) AS k FROM part) SELECT p_partkey, round(sqrt((vb * (p_size - a) * (p_size - a) - 2 * k * (p_size - a) * (p_retailprice - b) + va * (p_retailprice - b) * (p_retailprice - b)) / (va * vb - k * k)), 5) AS d FROM part, m")
add("math_interactions", lambda t: t.part.select("p_partkey", F.round(c("p_size") * c(P), 4).alias("mul"), F.round(c("p_size") / (c(P) + 1e-8), 8).alias("ratio"), F.round(c(P) - c("p_size"), 4).alias("sub")), "SELECT p_partkey, round(p_size * p_retailprice, 4) AS mul, round(p_size / (p_retailprice + 1e-8), 8) AS ratio, round(p_retailprice - p_size, 4) AS sub FROM part")
add("math_probability", lambda t: t.spark.range(1, 11).select("id", F.round(num.poisson_pmf(c("id").cast("int"), 3.0), 8).alias("poisson"), F.round(num.geometric_pmf(c("id"), 0.3), 8).alias("geometric"), F.round(num.cauchy_cdf(c("id")), 8).alias("cauchy")), "SELECT id, round(power(3.0, id) * exp(-3.0) / factorial(id::INT), 8) AS poisson, round(power(0.7, id - 1) * 0.3, 8) AS geometric, round(atan(id) / pi() + 0.5, 8) AS cauchy FROM range(1, 11) t(id)")
add("math_normal_cdf", lambda t: t.spark.range(-3, 4).select("id", F.round(num.normal_cdf(c("id").cast("double")), 5).alias("p")), "SELECT * FROM (VALUES (-3::BIGINT, 0.00135), (-2, 0.02275), (-1, 0.15866), (0, 0.5), (1, 0.84134), (2, 0.97725), (3, 0.99865)) v(id, p)")
add("math_change", lambda t: t.customer.select("c_custkey", F.round(num.change(c("c_acctbal"), c("c_nationkey").cast("double")), 4).alias("pct")), "SELECT c_custkey, round(CASE WHEN c_nationkey = 0 THEN 0 ELSE (c_acctbal - c_nationkey) / c_nationkey * 100 END, 4) AS pct FROM customer")
add("math_currency", lambda t: t.orders.select("o_orderkey", (F.pmod("o_orderkey", F.lit(3))).alias("cur"), "o_totalprice").join(F.broadcast(t.spark.createDataFrame([(0, 1.0), (1, 1.25), (2, 0.5)], "cur long, rate double")), "cur").select("o_orderkey", F.round(c("o_totalprice") * c("rate"), 4).alias("v")), "SELECT o_orderkey, round(o_totalprice * rate, 4) AS v FROM orders JOIN (VALUES (0, 1.0::DOUBLE), (1, 1.25), (2, 0.5)) r(cur, rate) ON o_orderkey % 3 = cur")


def mahalanobis(t):
    """Distance to the mean under the sample covariance of two columns; the five moments are one row."""
    m = t.part.agg(F.avg("p_size").alias("a"), F.avg(P).alias("b"), F.var_samp("p_size").alias("va"), F.var_samp(P).alias("vb"), F.covar_samp("p_size", P).alias("k"))
    x, y = c("p_size") - c("a"), c(P) - c("b")
    return t.part.crossJoin(F.broadcast(m)).select("p_partkey", F.round(F.sqrt((c("vb") * x * x - 2 * c("k") * x * y + c("va") * y * y) / (c("va") * c("vb") - c("k") * c("k"))), 5).alias("d"))


# --- nested
add("nest_json_path", lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")), "SELECT event_id, props->>'$.k' AS k FROM events")
add("nest_struct_field", lambda t: t.nation.select(F.struct("n_name", F.struct("n_regionkey").alias("at")).alias("s")).where("s.at.n_regionkey = 2").select("s.n_name"), "SELECT n_name FROM nation WHERE n_regionkey = 2")
add("nest_decimal_cast", lambda t: t.part.select("p_partkey", F.format_number(c(P).cast("string").cast("decimal(18,3)"), 3).alias("d")), "SELECT p_partkey, format('{:,.3f}', p_retailprice) AS d FROM part")
ITEMS = lambda t: t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("items"))
add("nest_collect_and_size", lambda t: ITEMS(t).select("l_orderkey", F.size("items").alias("n"), F.element_at("items", 1)["l_quantity"].alias("first")), "SELECT l_orderkey, count(*)::INT AS n, first(l_quantity ORDER BY l_linenumber, l_quantity) AS first FROM lineitem GROUP BY 1")
add("nest_explode_aggregate", lambda t: ITEMS(t).select(F.inline("items")).groupBy("l_linenumber").agg(F.round(F.avg("l_quantity"), 4).alias("q")), "SELECT l_linenumber, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY 1")
add("nest_array_tags", lambda t: t.part.select("p_partkey", F.array_contains(F.split("p_type", " "), "STEEL").alias("steel"), F.size(F.split("p_type", " ")).alias("n")), "SELECT p_partkey, list_contains(string_split(p_type, ' '), 'STEEL') AS steel, len(string_split(p_type, ' '))::INT AS n FROM part")
add("nest_json_from_text", lambda t: t.events.select("event_id", F.get_json_object(F.regexp_extract(F.concat(F.lit("say: "), "props", F.lit(" end")), r"(?s)(\{.*\})", 1), "$.k").alias("k")), "SELECT event_id, props->>'$.k' AS k FROM events")
add("nest_validate_mean", lambda t: ITEMS(t).select("l_orderkey", F.round(F.aggregate("items", F.lit(0.0), lambda a, x: a + x["l_quantity"]) / F.size("items"), 4).alias("mean")), "SELECT l_orderkey, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
add("nest_map_from_group", lambda t: t.nation.groupBy("n_regionkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey")))).alias("m")).select("n_regionkey", F.size("m").alias("n"), F.array_join(F.map_keys("m"), ",").alias("names")), "SELECT n_regionkey, count(*)::INT AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
add("nest_one_hot", lambda t: t.customer.select("c_custkey", *[(c("c_mktsegment") == v).cast("int").alias(v) for v in ("BUILDING", "MACHINERY")]), "SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS BUILDING, (c_mktsegment = 'MACHINERY')::INT AS MACHINERY FROM customer")
