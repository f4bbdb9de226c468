"""The engine: oracles on the smallest tables, closed forms, planted causes, sources, dialects, streams."""

import io
import math
import os
import zipfile

import duckdb
import pytest

from pyspark.sql import functions as F

from plumbline.functions import columns, stats
from plumbline.functions import series as S
from plumbline.functions.stats import Moments
from plumbline.operators import customers, experiment, profile, quality, repair
from plumbline.plans import catalogue, dialect, evidence, outlooks, render, roles  # noqa: F401
from plumbline.sources import demo, preview, readers, urls, xlsx

SF = "/root/testdata/sf0.001"


def _plain(v):
    return float(v) if type(v).__name__ == "Decimal" else v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name[:-8]} as select * from read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    order = lambda rows: sorted(rows, key=str)
    want = order(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    got = order(tuple(_plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-4)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(spark, name):
    catalogue.QUERIES[name](spark, SF).collect()


def test_distributions():
    assert math.isclose(stats.norm_sf(1.959963985), 0.025, rel_tol=1e-8)
    assert math.isclose(stats.norm_ppf(0.975), 1.959963985, rel_tol=1e-8)
    assert math.isclose(stats.t_sf(2.228138852, 10), 0.025, rel_tol=1e-7)
    assert math.isclose(stats.chi2_sf(3.841458821, 1), 0.05, rel_tol=1e-7)
    assert math.isclose(stats.f_sf(4.964602744, 1, 10), 0.05, rel_tol=1e-6)
    assert stats.gammainc_upper(2.0, 30.0) < 1e-11


def test_tests():
    a, b = Moments.of([1, 2, 3, 4, 5]), Moments.of([2, 3, 4, 5, 6])
    t = stats.welch(a, b)
    assert math.isclose(t.statistic, -1.0) and math.isclose(t.p, 0.34659, rel_tol=1e-4)
    assert stats.welch(Moments(5, 1, 0), Moments(5, 2, 0)).p == 0
    assert stats.two_proportions(2400, 100_000, 2000, 100_000).p < 1e-8
    assert math.isclose(stats.chi_square([[10, 20], [20, 10]]).statistic, 6.6667, rel_tol=1e-4)
    assert stats.benjamini_hochberg([0.001, 0.2, 0.03, 0.9], 0.1) == [True, False, True, False]
    assert math.isclose(stats.anova([Moments.of([1, 2, 3]), Moments.of([2, 3, 4]), Moments.of([5, 6, 7])]).statistic, 13.0)
    low, high = stats.bootstrap([1, 2, 3, 4, 5] * 10)
    assert low < 3 < high
    assert stats.correlation(0.9, 30).p < 1e-6 < stats.correlation(0.01, 30).p


def test_series():
    assert S.mann_kendall(list(range(20)))["trend"] == "increasing"
    wave = [math.sin(2 * math.pi * i / 12) for i in range(72)]
    assert S.season(wave, (4, 7, 12))[0] == 12
    assert S.change_points([10.0, 10.1] * 20 + [30.0, 30.2] * 20) == [40]
    assert S.rolling_z([10.0] * 30 + [50.0])[-1] > 100
    assert S.cusum([0, 1] * 20 + [9] * 12)
    f = S.forecast([float(i) for i in range(24)], 4)
    assert len(f) == 4 and f[-1]["value"] > 23
    spike = S.anomalies([100.0, 101, 99, 100, 102, 98, 100, 160, 101, 99, 100, 101], [str(i) for i in range(12)])
    assert [x["label"] for x in spike] == ["7"]


def test_analyse_runs_without_warnings(spark):
    out = roles.analyse(demo.generate(spark, "ecommerce", 8000), grain="month")
    assert out["warnings"] == [] and out["roles"]["revenue"] == "revenue" and out["report"]["markdown"].startswith("# ")
    empty = roles.analyse(demo.generate(spark, "ecommerce", 100).limit(0))
    assert "report" in empty


def test_quality_measures_each_dimension(spark):
    nothing = spark.createDataFrame([(None, None, None)] * 40, "a string, b double, d timestamp")
    r = quality.dimensions(nothing, "2026-01-01", date="d", amounts=("b",), categories=("a",), measures=("b",)).first()
    assert r["completeness"] == 0 and r["uniqueness"] == 0 and r["consistency"] == 60 and r["score"] < 60
    out = roles.analyse(nothing)["quality"]
    assert out["score"] < 60 and not out["usable"]
    rows = [(f"x{i % 5}", float(i % 10), f"2025-12-{1 + i % 28:02d}") for i in range(100)] + [(" x1", -5.0, "2025-12-01"), ("X1", 9000.0, "2025-12-02")]
    df = spark.createDataFrame(rows, "a string, b double, d string").selectExpr("a", "b", "cast(d as timestamp) d")
    r = quality.dimensions(df, "2026-01-10", date="d", amounts=("b",), categories=("a",), measures=("b",)).first()
    assert r["completeness"] == 100 and r["validity"] < 100 and r["accuracy"] < 100 and r["timeliness"] == 100 - 1.5 * (13 - 7) and r["uniqueness"] == 100 and not r["critical"]
    assert quality.dimensions(df.limit(0), "2026-01-10", date="d").first()["timeliness"] == 100


def test_granularity_rules(spark):
    def of(days):
        r = profile.date_granularity(spark.createDataFrame([(d,) for d in days], "d string").selectExpr("cast(d as timestamp) d"), "d").first()
        return r["dates"], r["granularity"], r["gaps"]

    assert of(["2025-01-01", "2025-01-02"]) == (2, None, None)
    assert of(["2025-01-01", "2025-01-02", "2025-01-03", "2025-01-06", None, "2025-01-06"]) == (4, "daily", 1)
    assert of([f"2025-{m:02d}-01" for m in range(1, 13)]) == (12, "monthly", 0)
    assert of(["1900-01-01", "1950-01-01", "2000-01-01"]) == (3, "irregular", None)
    assert of(["2025-01-01 00:00:10", "2025-01-01 00:00:11", "2025-01-01 00:00:12", "2025-01-01 00:09:12"]) == (4, "minute", 1)
    assert of([]) == (0, None, None)


def test_short_ids_and_masks(spark):
    def fnv(text):
        h = 2166136261
        units = text.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 16777619) % 2**32
        digits = ""
        while h:
            h, d = divmod(h, 36)
            digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d] + digits
        return digits.rjust(7, "0")

    texts = ["", "a", "Zoë", "日本語", "😀 smile", "x" * 300]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r[0] for r in df.select(columns.short_id(F.col("t"))).collect()][1:] == [fnv(x) for x in texts][1:]
    forms = {m: [r[0] for r in spark.createDataFrame([("ab@c.de",), ("abc",), ("abcdef",), ("",), (None,)], "t string").select(columns.redacted("t", m)).collect()] for m in ("redact", "partial", "bucket", "hash")}
    assert forms["redact"] == ["•" * 7, "•" * 3, "•" * 6, "", ""] and forms["partial"] == ["a•••@c.de", "••••", "••••cdef", "", ""]
    assert forms["bucket"] == ["AB•••", "AB•••", "AB•••", "", ""] and forms["hash"][:2] == ["ID-" + fnv("ab@c.de"), "ID-" + fnv("abc")]


def test_detectors_against_closed_forms():
    assert S.rolling_z([0.0, 0.0, 0.0, 0.001]) == [0.0, 0.0, 0.0, 1.0]  # a flat window: a thousandth of its level, of one at least
    z = S.rolling_z([1.0, 1.0, 1.0, 5.0, 2.0])
    assert math.isclose(z[3], 4000.0) and math.isclose(z[4], 1.0 / math.sqrt(3))  # no median deviation: the standard deviation
    assert S.cusum([1.0, 2.0]) == [] and S.cusum([3.0] * 10) == []
    y = [0.0] * 10 + [1.0] * 10
    assert S.cusum(y, threshold=2.0) == [4, 9, 14, 19]  # steps of 1 - 0.5 in population deviations


def test_customers(spark):
    assert math.isclose(customers.predicted_clv(10, 0.8), 40)  # the present period is not part of it
    assert math.isclose(customers.predicted_clv(10, 0.5, 0.0, 2), 7.5)
    assert math.isclose(customers.expected_lifetime(0.75), 4)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(c, f"2024-0{m}-10 00:00:00") for c in range(20) for m in range(1, 7)], "c int, d string").withColumn("d", F.col("d").cast("timestamp"))
    cells = customers.cohorts(df, "c", "d").collect()
    assert all(r["retention"] == 1.0 for r in cells) and len(cells) == 6


def test_experiments():
    arms = [{"arm": "control", "n": 100_000, "successes": 2000}, {"arm": "offer", "n": 100_000, "successes": 2400}]
    assert experiment.decide(arms, "control")["decision"] == "ship"
    assert experiment.decide([arms[0] | {"n": 60_000}, arms[1] | {"n": 40_000}], "control")["decision"] == "invalid"
    n = experiment.sample_size_proportion(0.02, 0.1)
    assert 75_000 < n < 85_000 and math.isclose(experiment.power_proportion(0.02, 0.1, n), 0.8, abs_tol=0.01)
    assert math.isclose(experiment.detectable_lift(0.02, n), 0.1, rel_tol=0.01)
    assert math.isclose(experiment.sequential_alpha(4, 4), 0.05, rel_tol=1e-9)
    cells = {(t, a): Moments(1000, 10 + 2 * (t and a) + a, 4.0) for t in (True, False) for a in (True, False)}
    assert math.isclose(experiment.difference_in_differences(cells)[0], 2.0)


def test_repair_and_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("order_date;region;units;price\n13/05/2011; East;3;2.5\n14/05/2011;N/A;4;1.5\n01/06/2011;West;-;2\n")
    df, report = readers.ingest(spark, str(tmp_path / "x.csv"), "units", "price")
    assert report["dates"] == {"order_date": "d/M/yyyy"} and "Revenue" in df.columns
    rows = df.orderBy("order_date").collect()
    assert rows[0]["order_date"].day == 13 and rows[1]["region"] is None and rows[2]["units"] is None and rows[0]["Revenue"] == 7.5
    assert preview.sniff("a,b\n1,x\n2,y")["types"] == ["bigint", "string"]
    (tmp_path / "y.ndjson").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.load(spark, str(tmp_path / "y.ndjson")).count() == 2
    with pytest.raises(ValueError):
        readers.load(spark, "z.doc")
    assert repair.FORMATS[0].startswith("yyyy")


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c></row><row r="2"><c r="A2"><v>5</v></c><c r="C2" s="1"><v>45000</v></c></row><row r="3"><c r="A3" t="e"><v>#N/A</v></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}/>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>n</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "b.xlsx").write_bytes(out.getvalue())
    rows = [tuple(r) for r in readers.load(spark, str(tmp_path / "b.xlsx")).collect()]
    assert rows[0] == ("5", None, "2023-03-15") and rows[1][0] is None
    assert xlsx.column_index("AB12") == 27 and xlsx.is_date_format("dd/mm/yyyy") and not xlsx.is_date_format("0.00")


def test_urls_and_dialects():
    assert urls.raw_url("https://github.com/a/b/blob/main/x.csv") == "https://raw.githubusercontent.com/a/b/main/x.csv"
    assert urls.unsupported("https://h/x.pdf") == ".pdf" and urls.is_html(b"\n<!DOCTYPE html>")
    spark_sql = dialect.translate("SELECT \"a b\", date_diff('month', x, y) AS m, 'VARCHAR \"q\"' FROM t", "spark")[0]
    assert "`a b`" in spark_sql and "'VARCHAR \"q\"'" in spark_sql and "year(y) * 12" in spark_sql
    assert "SAFE_CAST(x AS STRING)" in dialect.translate("SELECT TRY_CAST(x AS VARCHAR) FROM t", "bigquery")[0]
    assert "DATE_TRUNC(d, MONTH)" in dialect.translate("SELECT date_trunc('month', d) FROM t", "bigquery")[0]
    assert "TRUNC(d, 'MM')" in dialect.translate("SELECT date_trunc('month', d) FROM t", "hive")[0]
    assert dialect.translate("SELECT x FROM t QUALIFY row_number() OVER (ORDER BY x) = 1", "hive")[1]


def test_render():
    assert render.same_numbers("up 5 % to 10", "It rose to 10, 5 % more") and not render.same_numbers("up 5", "up 6")
    assert render.grounded("grew 12.0 to 99", [12.0]) == [99.0]
    with pytest.raises(ValueError):
        render.Chart("x", "line", [], {}, " ")
    assert abs(sum(quality.WEIGHTS["core"]) - 1) < 1e-9 and abs(sum(quality.WEIGHTS["sql"]) - 1) < 1e-9


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from plumbline.streaming import windows

    spark.read.parquet(f"{SF}/events.parquet").limit(400).write.parquet(str(tmp_path / "in"))
    events = windows.stream(spark, str(tmp_path / "in"))
    for name, df in (("tumbling", windows.window_kpis(events, "ts", "value", ["event_type"])), ("sessions", windows.session_kpis(events, "ts", "user_id", "value"))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).where(F.col("n") < 1).count() == 0
    q = windows.cusum_alarms(events, "event_type", "value", 0.0, 1.0).writeStream.outputMode("append").format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "alarms")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("alarms").count() > 0
