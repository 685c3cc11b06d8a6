import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions.search import instant, rank_below
from tideline.operators import vintages
from tideline.operators.store import VintageStore

D = dt.date.fromisoformat
ROW = "series_id string, period date, period_unit string, value double"


def observed(spark, *rows):
    return spark.createDataFrame([(s, D(p), "quarter", v) for s, p, v in rows], ROW)


def known(store):
    return sorted((r.source, r.series_id, str(r.period), str(r.vintage_date), r.value) for r in store.read().collect())


def test_rows_are_replaced_by_key(spark, tmp_path):
    store = VintageStore(spark, str(tmp_path / "s"))
    assert store.read().count() == 0
    assert store.write("nom", observed(spark, ("a", "2023-01-01", 1.0)), "2023-06-01") == 1
    assert store.write("nom", observed(spark, ("b", "2023-01-01", 2.0)), "2023-06-01") == 1
    assert known(store) == [("nom", "a", "2023-01-01", "2023-06-01", 1.0), ("nom", "b", "2023-01-01", "2023-06-01", 2.0)]
    store.write("nom", observed(spark, ("a", "2023-01-01", 3.0), ("a", "2023-04-01", 4.0)), "2023-06-01")
    store.write("oad", observed(spark, ("a", "2023-01-01", 9.0)), "2023-06-01")
    store.write("nom", observed(spark, ("a", "2023-01-01", 5.0)), "2023-07-01")
    want = [("nom", "a", "2023-01-01", "2023-06-01", 3.0), ("nom", "a", "2023-01-01", "2023-07-01", 5.0), ("nom", "a", "2023-04-01", "2023-06-01", 4.0), ("nom", "b", "2023-01-01", "2023-06-01", 2.0), ("oad", "a", "2023-01-01", "2023-06-01", 9.0)]
    assert known(store) == want
    more = observed(spark, ("a", "2023-01-01", 6.0), ("c", "2023-01-01", 7.0)).withColumns({"source": F.lit("nom"), "vintage_date": F.when(F.col("series_id") == "a", "2023-07-01").otherwise("2022-01-01")})
    assert store.load_history(more) == 2
    assert known(store) == sorted([("nom", "a", "2023-01-01", "2023-07-01", 6.0), ("nom", "c", "2023-01-01", "2022-01-01", 7.0), *(w for w in want if w[4] != 5.0)])


def test_random_writes_against_a_dict(spark, tmp_path):
    rng = random.Random(7)
    store, want = VintageStore(spark, str(tmp_path / "s"), file_rows=5), {}
    days = ["2021-12-30", "2022-01-02", "2022-05-01", "2022-05-02"]
    for step in range(7):
        rows = {(rng.choice("ab"), rng.choice("xyz"), f"2020-0{rng.randrange(1, 5)}-01", rng.choice(days)): float(rng.randrange(100)) for _ in range(rng.randrange(1, 12))}
        frame = spark.createDataFrame([(s, i, D(p), "month", D(d), v) for (s, i, p, d), v in rows.items()], "source string, series_id string, period date, period_unit string, vintage_date date, value double")
        assert store.load_history(frame) == len(rows)
        want |= rows
        if step == 3:
            assert store.compact("a") <= 2 and store.vacuum() > 0
        if step % 3 == 0:
            assert known(store) == sorted((*k, v) for k, v in want.items())
    assert known(store) == sorted((*k, v) for k, v in want.items())


def test_a_reader_sees_all_of_a_write_or_nothing(spark, tmp_path, monkeypatch):
    store = VintageStore(spark, str(tmp_path / "s"))
    store.write("nom", observed(spark, ("a", "2023-01-01", 1.0)), "2023-06-01")
    before = store.read()
    with monkeypatch.context() as m:
        m.setattr(VintageStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.write("nom", observed(spark, ("a", "2023-01-01", 2.0)), "2023-06-01")
    assert [r.value for r in store.read().collect()] == [1.0]
    store.write("nom", observed(spark, ("a", "2023-01-01", 3.0)), "2023-06-01")
    assert [r.value for r in before.collect()] == [1.0]  # an older state stays readable until it is vacuumed
    number, entries = store._entries()
    with pytest.raises(RuntimeError):
        store._commit(number, entries)


def scanned(df):
    """(rows, files) that the plan's scans read."""
    df.collect()
    found, open_ = [0, 0], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            open_.append(node.plan())
        if name.startswith("Scan parquet"):
            found[0] += node.metrics().apply("numOutputRows").value()
            found[1] += node.metrics().apply("numFiles").value()
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return found


def test_one_series_skips_row_groups_and_days_skip_folders(spark, tmp_path):
    spark.conf.set("parquet.block.size", str(64 << 10))
    try:
        store = VintageStore(spark, str(tmp_path / "s"))
        rows = spark.range(60_000).selectExpr("'nom' AS source", "concat('s', lpad(cast(id % 3000 AS string), 4, '0')) AS series_id", "add_months(date '2000-01-01', cast(id div 3000 AS int)) AS period", "'month' AS period_unit", "date '2020-01-01' AS vintage_date", "cast(id AS double) AS value", "md5(cast(id AS string)) AS metadata")
        for year in (2020, 2021):
            store.load_history(rows.withColumn("vintage_date", F.lit(f"{year}-01-01").cast("date")))
    finally:
        spark.conf.unset("parquet.block.size")
    one = store.history("nom", "s1500")
    assert one.count() == 40
    n, _ = scanned(one)
    assert 40 <= n < 60_000  # of 120,000
    assert scanned(store.read("nom"))[1] == 2 and scanned(store.read("nom", "2020-06-01"))[1] == 1
    assert store.read_as_of("nom", "2020-06-01").count() == 60_000


def test_small_folders_become_one(spark, tmp_path):
    store = VintageStore(spark, str(tmp_path / "s"))
    for day in ("2022-01-01", "2022-01-02", "2022-01-03", "2023-01-01"):
        store.write("nom", observed(spark, ("a", "2021-01-01", float(day[-1]))), day)
    before = known(store)
    assert len(store._entries()[1]) == 4 and store.compact("nom") == 2 and store.compact("nom") == 2 and store.compact("none") == 0
    assert known(store) == before and store.vacuum() == 3 and known(store) == before
    assert [r.value for r in store.read_as_of("nom", "2022-01-02").collect()] == [2.0]
    store.write("nom", observed(spark, ("a", "2021-01-01", 9.0)), "2022-01-02")
    assert [r.value for r in store.history("nom", "a").collect()] == [1.0, 9.0, 3.0, 1.0]


def test_as_of_very_many_days(spark):
    """20,000 days and spans of all lengths: no nested loop, and each day has what a search over the sorted vintages finds."""
    rng = random.Random(1)
    rows = [(k, D("2000-01-01") + dt.timedelta(rng.choice([rng.randrange(21_000), rng.randrange(40)])), rng.random()) for k in "abcd" for _ in range(60)]
    rows += [("a", D("2010-01-01"), 1.0), ("a", D("2010-01-01"), 3.0), ("a", D("2010-01-01"), 2.0), ("e", None, 1.0)]
    observations = spark.createDataFrame(rows, "k string, vintage_date date, value double")
    days = spark.range(20_000).selectExpr("date_add(date '2000-01-05', cast(id AS int)) AS asof_date")
    got = vintages.as_of_many(observations, days, ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = {(r.k, r.asof_date): (r.vintage_date, r.value) for r in got.collect()}
    want = {}
    for k in "abcd":
        own = sorted((d, v) for x, d, v in rows if x == k)
        at, last = 0, None
        for i in range(20_000):
            day = D("2000-01-05") + dt.timedelta(i)
            while at < len(own) and own[at][0] <= day:
                last, at = own[at], at + 1
            if last:
                want[k, day] = last
    assert found == want and got.count() == len(want)
    few = vintages.as_of_many(observations, days.where("asof_date < '2000-02-01'"), ["k"])
    assert {(r.k, r.asof_date): (r.vintage_date, r.value) for r in few.collect()} == {x: v for x, v in want.items() if x[1] < D("2000-02-01")}


def test_places_among_bounds(spark):
    bounds = [-5, 0, 0, 7]
    rows = spark.createDataFrame([(x,) for x in (-9, -5, 0, 1, 7, 8, None)], "x long")
    assert [r[0] for r in rows.select(rank_below(F.col("x"), bounds)).collect()] == [0, 0, 1, 3, 3, 4, None]
    assert [r[0] for r in rows.select(rank_below(F.col("x"), [])).collect()] == [0] * 6 + [None]
    times = spark.sql("SELECT timestamp_ntz '2024-03-31 02:30:01' AS a, timestamp_ntz '2024-03-31 02:30:02' AS b")
    kind = times.schema["a"].dataType
    assert times.select(instant(F.col("b"), kind) - instant(F.col("a"), kind)).first()[0] == 1
