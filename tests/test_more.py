"""Operators without SQL against brute force, and results in special cases."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon import catalogue
from quillon.functions import distributions as dist
from quillon.operators import cleaning, graph, joins, matching, quality, stats, timeseries
from quillon.plans import flow, rules
from quillon.sources import files, workbooks
from quillon.streaming import events

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


def one(df):
    return df.collect()[0]


def test_tails(spark):
    row = one(spark.range(1).select(
        dist.t_tails(F.lit(2.228), F.lit(10)).alias("t"), dist.f_tail(F.lit(3.33), F.lit(2), F.lit(30)).alias("f"), dist.chi2_tail(F.lit(3.841), F.lit(1)).alias("c"),
        dist.chi2_tail(F.lit(18.307), F.lit(10)).alias("c10"), dist.normal_tails(F.lit(1.96)).alias("z"), dist.ks_tail(F.lit(0.136), F.lit(200), F.lit(200)).alias("k"), dist.t_tails(F.lit(None), F.lit(3)).alias("none"),
    ))
    assert row.t == pytest.approx(0.05, abs=1e-4) and row.f == pytest.approx(0.0494, abs=2e-4) and row.c == pytest.approx(0.05, abs=1e-4)
    assert row.c10 == pytest.approx(0.05, abs=1e-4) and row.z == pytest.approx(0.05, abs=1e-4) and row.k == pytest.approx(0.0494, abs=1e-3) and row.none is None


def test_anova_of_large_means(spark):
    df = spark.createDataFrame([(g, 1e9 + x + g) for g in range(3) for x in (0, 1, 2, 3)], "g int, x double")
    row = one(stats.anova(df, "g", "x").withColumn("p", dist.f_tail(F.col("f"), F.col("df_between"), F.col("df_within"))))
    assert row.f == pytest.approx(2.4, rel=1e-6) and row.p == pytest.approx(0.146104, abs=1e-4)


def test_f_tail_of_many_rows(spark):
    """With four degrees between, P is x^h (1 + h (1 - x)) for h half of those within."""
    for f, within in ((1.4191018602304444, 149995), (1.0, 8999995)):
        x, h = within / (within + 4 * f), within / 2
        want = math.exp(h * math.log(x)) * (1 + h * (1 - x))
        assert one(spark.range(1).select(dist.f_tail(F.lit(f), F.lit(4), F.lit(within)).alias("p"))).p == pytest.approx(want, abs=1e-7)


def test_merge_suffixes_is_spread_and_whole(spark, tmp_path):
    spark.range(300).selectExpr("cast(nullif(id % 3, 2) as int) c_nationkey", "concat('c', id % 50) c_name").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(40).selectExpr("cast(nullif(id % 4, 2) as int) s_nationkey", "concat('s', id % 7) s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["join_merge_suffixes"](spark, str(tmp_path))
    assert got.columns == ["key", "name_x", "name_y"] and got.rdd.getNumPartitions() > 100
    duck = duckdb.connect()
    for t in ("customer", "supplier"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(ORACLE["join_merge_suffixes"]).fetchall())


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_pairs_and_greedy_groups(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("ab", k=rng.randint(0, 5))), rng.randrange(2)) for i in range(60)] + [(60, None, 0), (61, "ab", None)]
    df = spark.createDataFrame(rows, "id long, s string, g int")
    first = {}
    for i, s, g in rows:
        if s is not None and g is not None:
            first.setdefault((g, s), i)
    want = {(first[g, s], i) for i, s, g in rows if s is not None and g is not None and first[g, s] != i}
    ids = [(i, s, g) for (g, s), i in first.items()]
    want |= {(min(i, j), max(i, j)) for i, s, g in ids for j, u, h in ids if i != j and g == h and edit(s, u) <= 1}
    pairs = matching.near_pairs(df, "id", "s", ["g"])
    assert {(r.a, r.b) for r in pairs.collect()} == want
    leader = {}
    for i, _, _ in rows:
        if i not in leader:
            leader[i] = i
            for a, b in sorted(want):
                if a == i:
                    leader.setdefault(b, i)
    assert dict(map(tuple, matching.greedy_groups(df, "id", pairs).collect())) == leader


def test_greedy_groups_by_rounds_and_in_one_task(spark):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(150)} | {(i, i + 1) for i in range(80, 99)})
    leader = {}
    for i in range(100):
        if i not in leader:
            leader[i] = i
            for a, b in pairs:
                if a == i:
                    leader.setdefault(b, i)
    df = spark.createDataFrame(pairs, "a long, b long")
    for most in (0, 40, 500_000):
        assert dict(map(tuple, matching.greedy_groups(spark.range(100), "id", df, most).collect())) == leader


def fuzzy_tables(spark, folder):
    """Customers of distinct names, copies of names over segments and nations, a gap of one character, an empty name, nulls."""
    names = [f"Customer#{i:09d}" for i in range(200)] + [f"Customer#{i:09d}" for i in range(5)] * 3 + ["Customer#00000000", "", "x", None]
    rows = [(i, n, i % 2 if n else 0, "AB"[i % 3 == 0]) for i, n in enumerate(names)] + [(900, "x", None, "A")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    return rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dup_fuzzy_groups_broadcasts_no_keys(spark, tmp_path):
    fuzzy_tables(spark, tmp_path)
    customer = spark.read.parquet(f"{tmp_path}/customer.parquet")
    assert "Broadcast" not in plan_of(matching.near_pairs(customer, "c_custkey", "c_name", ["c_nationkey"]))
    leaders = dict(map(tuple, QUERIES["dup_fuzzy_groups"](spark, str(tmp_path)).collect()))
    assert len(leaders) == customer.count() and leaders[200] == leaders[0] == 0 and leaders[900] == 900


def greedy_leaders(rows):
    """A pass over all rows (id, text, block) in order, every row compared with every later one."""
    leader = {}
    for i, s, g in sorted(rows):
        if leader.setdefault(i, i) == i and s is not None and g is not None:
            for j, u, h in rows:
                if j > i and h == g and u is not None and edit(s, u) <= 1:
                    leader.setdefault(j, i)
    return leader


def test_dup_fuzzy_groups_follow_links_of_copies(spark, tmp_path):
    rows = [(0, "x", 1), (1, "xy", 1), (2, "xy", 1), (3, "xyz", 1), (4, "x", 1), (5, "xyz", 1), (6, "xy", 2), (7, None, 1), (8, None, 1), (9, "x", None)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted(map(tuple, QUERIES["dup_fuzzy_groups"](spark, str(tmp_path)).collect()))
    assert got == sorted(greedy_leaders(rows).items()) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 0), (5, 3), (6, 6), (7, 7), (8, 8), (9, 9)]


def test_near_groups_as_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None] + ["".join(rng.choices("abc", k=rng.randint(0, 4))) for _ in range(9)]), rng.choice([0, 1, 2, None])) for i in rng.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "id long, s string, g int")
    want = greedy_leaders(rows)
    for most in (0, 500_000):
        assert sorted(map(tuple, matching.near_groups(df, "id", "s", ["g"], most).collect())) == sorted(want.items())
    assert dict(map(tuple, matching.greedy_groups(df, "id", matching.all_near_pairs(df, "id", "s", ["g"])).collect())) == want


@pytest.mark.parametrize("name", ["join_fuzzy_pairs", "join_fuzzy_key"])
def test_fuzzy_queries_equal_their_sql_on_copies(spark, tmp_path, name):
    fuzzy_tables(spark, tmp_path)
    got = QUERIES[name](spark, str(tmp_path))
    assert "Broadcast" not in plan_of(got)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    pairs = lambda rows: sorted((a, b) for a, b, *_ in rows)
    assert pairs(got.select("a", "b").collect()) == pairs(duck.execute(ORACLE[name]).fetchall())


def test_cycles_of_any_length(spark):
    n = 300
    ring = [(k, (k + 1) % n) for k in range(n)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 5), (3000, 3000), (4000, None)]
    got = {r.n for r in graph.cycles(spark.createDataFrame(ring, "n long, p long"), "n", "p").collect()}
    assert got == set(range(n)) | {3000}
    with pytest.raises(ValueError):
        graph.cycles(spark.createDataFrame([(1, 2), (1, 3)], "n long, p long"), "n", "p")
    assert graph.cycles(spark.createDataFrame([], "n long, p long"), "n", "p").count() == 0


def test_last_of_a_descending_order(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 3)], "k int, v int")
    assert one(joins.drop_duplicates(df, ["k"], [F.col("v").desc()], "last")).v == 1
    assert one(joins.drop_duplicates(df, ["k"], [F.col("v")], "last")).v == 3
    part = spark.createDataFrame([(1, None, "x"), (1, 5, None), (1, 6, "y")], "k int, v int, s string")
    assert tuple(one(joins.merge_rows(part, ["k"], [F.col("v").asc_nulls_first()]))) == (1, 5, "x")


def test_lof(spark):
    rng = random.Random(1)
    x = [rng.gauss(0, 1) for _ in range(80)] + [25.0]
    got = {r.id: r.lof for r in cleaning.local_outlier_factor(spark.createDataFrame(list(enumerate(x)), "id long, v double"), "id", "v", 5).collect()}
    near = {i: sorted((abs(x[i] - x[j]), j) for j in range(len(x)) if j != i)[:5] for i in range(len(x))}
    reach = lambda i: 1 / (sum(max(d, near[j][-1][0]) for d, j in near[i]) / 5)
    for i in range(len(x)):
        assert got[i] == pytest.approx(sum(reach(j) for _, j in near[i]) / 5 / reach(i), rel=1e-9)
    assert got[80] > 5


def test_schema_drift_score(spark):
    assert one(spark.range(1).select(cleaning.drift_score(1, 1, 1, F.lit(10)).alias("s"))).s == 63
    assert one(spark.range(1).select(cleaning.drift_score(9, 9, 0, F.lit(0)).alias("s"))).s == 100
    old, new = spark.createDataFrame([], "a int, b int"), spark.createDataFrame([], "a string, c int")
    assert {k: len(v) for k, v in quality.schema_drift(old, new).items()} == {"added": 1, "removed": 1, "retyped": 1}


def test_ranks_and_order_statistics(spark):
    v = [5.0, 1.0, 1.0, 3.0, 9.0, 3.0, 3.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(99, None)], "i int, x double")
    ranks = {r.i: r.k for r in stats.average_ranks(df, "x", "k").collect()}
    assert [ranks[i] for i in range(7)] == [6, 1.5, 1.5, 4, 7, 4, 4] and ranks[99] is None
    import statistics

    assert stats.quantiles_exclusive(df, "x", [0.25, 0.5, 0.75]) == pytest.approx(statistics.quantiles(v, n=4))
    assert one(matching.auc(spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 2.0), (1, 3.0)], "y int, s double"), "y", "s")).auc == pytest.approx(3.5 / 4)


def test_neighbours(spark):
    rows = [(i, i * 7 % 11) for i in random.Random(2).sample(range(1000), 300)]
    got = {r.i: r.prev_v for r in timeseries.neighbours(spark.createDataFrame(rows, "i long, v int"), "i", ["v"]).collect()}
    before = None
    for i, v in sorted(rows):
        assert got[i] == before
        before = v


def test_workbook_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & <b>"), (2, None)], "n int, s string")
    workbooks.write_excel({"x": df, "y": df.limit(1)}, str(tmp_path / "b.xlsx"))
    assert [tuple(r) for r in files.read_excel(spark, str(tmp_path / "b.xlsx"), ["n", "s"]).collect()] == [("1", "a & <b>"), ("2", None)]
    df.write.parquet(str(tmp_path / "in"))
    live = events.stream(spark, str(tmp_path / "in"), df.schema)
    assert events.drain(live, str(tmp_path / "out"), str(tmp_path / "state")).count() == 2


def test_rules_and_health(spark):
    with pytest.raises(ValueError):
        rules.formula("(select 1)")
    log = spark.createDataFrame([("a", k, k not in (2, 3, 5), 1.0 + 9 * (k == 6)) for k in range(1, 8)], "job string, run int, ok boolean, seconds double")
    row = one(flow.run_health(log))
    assert (row.failures_in_row, row.slow, row.success) == (2, 1, pytest.approx(4 / 7 * 100, abs=1e-3))
    assert math.isclose(row.mean_seconds, 16 / 7, abs_tol=1e-4)
