import datetime

import pytest
from pyspark.sql import functions as F

from quillon.functions import dates, numeric, text
from quillon.operators import graph, joins, quality, stats
from quillon.plans import flow
from quillon.sources import files, sinks
from quillon.streaming import events


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(make(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    ("given", "make", "want"),
    [
        ("o'neil mary-ann", text.title, "O'Neil Mary-Ann"),
        ("  a \n b ", text.squeeze, "a b"),
        ("Straße café", text.strip_accents, "Straße cafe"),
        ("<b>x</b> &amp; y", text.strip_html, "x & y"),
        ("12 N Main St.", lambda c: text.clean(c, "address"), "12 N Main Street."),
        ("  jOHN   o'neil! ", lambda c: text.clean(c, "name"), "John O'Neil"),
        (" ab 12 ", lambda c: text.clean(c, "code"), "AB12"),
        ("555-123-4567", text.phone, "(555) 123-4567"),
        ("1 555 123 4567", text.phone, "+1 (555) 123-4567"),
        ("12345", text.phone, "12345"),
        ("Hello, World!", text.match_key, "hello world"),
        (None, text.match_key, ""),
        ("$1,234.50", text.as_number, 1234.5),
        ("12%", text.as_number, 0.12),
        ("abc", text.as_number, None),
        ("YES", text.as_boolean, True),
        ("maybe", text.as_boolean, None),
        ("One. Two! Three?", text.sentences, ["One", "Two", "Three"]),
        ("The cat, the hat", text.tokens, ["the", "cat", "the", "hat"]),
        (None, text.is_email, False),
        ("31/12/2022", dates.parse_date, datetime.date(2022, 12, 31)),
        ("nonsense", dates.parse_date, None),
    ],
)
def test_scalar(spark, given, make, want):
    assert one(spark, given, make) == want


def test_similarities(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("abcd", "bcde"), ("a b", "b a"), (None, "x"), ("", "")], "a string, b string")
    got = df.select(text.jaro_winkler(F.col("a"), F.col("b")), text.sequence_ratio(F.col("a"), F.col("b")), text.token_sort_ratio(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx(0.961111, abs=1e-5)
    assert got[1][1] == 0.75
    assert got[2][2] == 100
    assert [r[0] for r in got[3:]] == [0.0, 1.0]


def test_distances_of_published_example(spark):
    df = spark.createDataFrame([([3.0, 6.0, 9.0], [1.0, 0.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(*[F.round(numeric.distance(F.col("a"), F.col("b"), p), 6) for p in (2, 1, 3)]).first()
    assert tuple(got) == (10.198039, 16.0, 9.028715)


def test_cut_leaves_lowest_edge_out(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (200.0,), (None,)], "x double")
    assert [r[0] for r in df.select(numeric.cut(F.col("x"), [0, 50, 200], ["Low", "Medium"])).collect()] == [None, "Low", "Medium", None]


def test_upsert_and_cascade(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, joins.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    children = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "c int, k int")
    parent, child = joins.delete_cascade(F.col("k") == 1, old, "k", [(children, "k")])
    assert [r.k for r in parent.collect()] == [2]
    assert sorted(r.c for r in child.collect()) == [11, 12]


def test_null_keys(spark):
    child = spark.createDataFrame([(1,), (9,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (None,)], "id int")
    assert [r.k for r in joins.invalid_keys(child, "k", parent, "id").collect()] == [9]
    assert sorted(str(r.k) for r in joins.invalid_keys(child, "k", parent, "id", allow_null=False).collect()) == ["9", "None"]


def test_rules_and_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, x int")
    found = quality.violations(df, [quality.between("x", 0, 10), quality.between("x", 0, 10, nulls_fail=False)], "id").collect()
    assert sorted(r.id for r in found) == [2, 3, 3]
    assert quality.fingerprint(df) == quality.fingerprint(df.select("x", "id"))
    assert quality.schema_drift(df, df.withColumn("y", F.lit(1)).drop("x"))["removed"] == ["x"]


def test_profile_of_empty_table(spark):
    df = spark.createDataFrame([], "x double")
    assert stats.describe(df, ["x"]).first()["count"] == 0
    assert stats.value_counts(df, "x").count() == 0


def test_cycles_and_orphans(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 9), (4, None)], "n int, p int")
    assert sorted(r.n for r in graph.cycles(df, "n", "p").collect()) == [1, 2]
    assert [r.n for r in graph.orphans(df, "n", "p").collect()] == [3]
    assert [tuple(r) for r in graph.depths(df, "n", "p").collect()] == [(4, 0)]


def test_no_path_is_cut_silently(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4)], "n int, p int")
    assert sorted(tuple(r) for r in graph.depths(df, "n", "p").collect()) == [(k, k - 1) for k in range(1, 6)]
    assert graph.reachable(df.where("p is not null"), "n", "p").count() == 10
    for cut in (lambda: graph.depths(df, "n", "p", most=2), lambda: graph.reachable(df.where("p is not null"), "n", "p", most=2)):
        with pytest.raises(RuntimeError):
            cut()
    with pytest.raises(RuntimeError):
        graph.depths(spark.createDataFrame([(1, None), (2, 1), (1, 2)], "n int, p int"), "n", "p")


def test_files_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, "c\nd")], "id int, s string")
    sinks.write_csv(sinks.csv_safe(df), f"{tmp_path}/x.csv")
    assert sorted(r.s for r in files.load(spark, f"{tmp_path}/x.csv").collect()) == ["a;b", "c d"]
    with pytest.raises(ValueError, match="Unsupported"):
        files.load(spark, "x.pdf")
    found = files.file_tree(spark, f"{tmp_path}/x.csv").collect()
    assert all(len(r.md5) == 32 for r in found)


def test_excel(spark, tmp_path):
    import zipfile

    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert [tuple(r) for r in files.load(spark, f"{tmp_path}/b.xlsx", columns=["name", "n"]).collect()] == [("Ann", "7")]


def test_archives(spark, tmp_path):
    import io
    import zipfile

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "x")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("i.zip", inner.getvalue())
        z.writestr("t.txt", "yy")
    assert sorted((r.member, r.size) for r in files.read_archives(spark, str(tmp_path)).collect()) == [("i.zip!/deep.txt", 1), ("t.txt", 2)]


def test_retry_and_needs(spark):
    calls = []

    @flow.retry(times=3, wait=0)
    def unsteady():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert unsteady() == "done" and len(calls) == 3
    with pytest.raises(ValueError, match="misses"):
        flow.needs("gone")(lambda df: df)(spark.range(1))


def test_report_cache(spark):
    now, made = [0.0], []
    cache = flow.ReportCache(10, lambda: now[0])
    make = lambda: made.append(1) or spark.range(1)
    cache.get("q", make), cache.get("q", make)
    assert len(made) == 1
    now[0] = 11
    cache.get("q", make)
    assert len(made) == 2


def test_unknown_event_version(spark):
    df = spark.createDataFrame([(1, 3)], "id int, version int")
    with pytest.raises(Exception, match="unknown schema version"):
        events.normalise_versions(df).collect()


def test_stream_micro_batches(spark, tmp_path):
    spark.range(20).repartition(4).write.parquet(f"{tmp_path}/in")
    seen = []
    live = events.stream(spark, f"{tmp_path}/in", "id long", files=1)
    events.micro_batches(live, lambda df, k: seen.append(df.count()), f"{tmp_path}/state")
    assert sum(seen) == 20 and len(seen) > 1
