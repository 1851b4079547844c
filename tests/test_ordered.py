"""Chunked ordered operators against plain Python, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from faresight.operators import ordered

ROWS = []
_rnd = random.Random(7)
for i in range(900):
    key = "hot" if i % 3 else f"k{_rnd.randrange(12)}"
    day = 0 if _rnd.random() < 0.4 else _rnd.randrange(40)
    ROWS.append((key, day, i, float(_rnd.randrange(100))))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "key string, day int, id int, v double").repartition(5)


def expected(fn):
    out = {}
    groups = {}
    for row in sorted(ROWS, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    for rows in groups.values():
        out.update(fn(rows))
    return out


@pytest.fixture(scope="module", autouse=True)
def ranges(spark):
    """Ranges whatever the size, but where a test asks for plain windows."""
    spark.conf.set(ordered.PLAIN_SETTING, "0")
    yield
    spark.conf.unset(ordered.PLAIN_SETTING)


@pytest.fixture(params=["reused", "stored", "planned", "plain"])
def way(request, spark):
    """The ways to cut ranges: one exchange that both sides read, with and without adaptive execution, and a checkpoint."""
    spark.conf.set(ordered.STORE_SETTING, str(request.param == "stored").lower())
    spark.conf.set("spark.sql.adaptive.enabled", str(request.param != "planned").lower())
    spark.conf.set(ordered.PLAIN_SETTING, str(2**80 if request.param == "plain" else 0))
    yield request.param
    spark.conf.set(ordered.PLAIN_SETTING, "0")
    spark.conf.unset(ordered.STORE_SETTING)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lags(table, way):
    got = ordered.lag_values(table, "key", ["day", "id"], "v", [1, 3])
    want = expected(
        lambda rows: {
            r[2]: (rows[i - 1][3] if i >= 1 else None, rows[i - 3][3] if i >= 3 else None) for i, r in enumerate(rows)
        }
    )
    assert {r["id"]: (r["v_lag_1"], r["v_lag_3"]) for r in got.collect()} == want
    assert got.columns == [*table.columns, "v_lag_1", "v_lag_3"]


def test_lags_across_short_ranges(spark):
    # More ranges than rows: a lag reaches several ranges back.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        df = spark.createDataFrame([("a", d, float(d)) for d in range(6)], "key string, day int, v double").repartition(3)
        got = ordered.lag_values(df, "key", ["day"], "v", [1, 3])
        assert [(r["v_lag_1"], r["v_lag_3"]) for r in got.orderBy("day").collect()] == [
            (None, None), (0.0, None), (1.0, None), (2.0, 0.0), (3.0, 1.0), (4.0, 2.0)
        ]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_null_values_and_null_keys(spark, way):
    data = [("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0), (None, 0, 5.0), (None, 1, 6.0), (None, 2, 7.0), ("b", 0, 8.0)]
    df = spark.createDataFrame(data, "key string, day int, v double")
    got = ordered.lag_values(df, "key", ["day"], "v", [1]).collect()
    assert {(r["key"], r["day"]): r["v_lag_1"] for r in got} == {
        ("a", 0): None, ("a", 1): 1.0, ("a", 2): None, (None, 0): None, (None, 1): 5.0, (None, 2): 6.0, ("b", 0): None
    }
    got = ordered.row_index(df, "key", ["day"]).collect()
    assert {(r["key"], r["day"]): r["row_index"] for r in got} == {(k, d): d + 1 for k, d, _ in data}
    assert ordered.row_index(df.filter("false"), "key", ["day"]).count() == 0


def test_row_index(table, way):
    got = ordered.row_index(table, "key", ["day", "id"], total="n")
    want = expected(lambda rows: {r[2]: (i + 1, len(rows)) for i, r in enumerate(rows)})
    assert {r["id"]: (r["row_index"], r["n"]) for r in got.collect()} == want


def test_row_index_without_keys(table, way):
    got = ordered.row_index(table, [], [F.desc("day"), "id"])
    order = sorted(ROWS, key=lambda r: (-r[1], r[2]))
    assert {r["id"]: r["row_index"] for r in got.collect()} == {r[2]: i + 1 for i, r in enumerate(order)}


def test_running(table, way):
    outputs = {"total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v"), "n": ("count", "v")}
    got = ordered.running(table, "key", ["day", "id"], outputs)

    def run(rows):
        seen, out = [], {}
        for r in rows:
            seen.append(r[3])
            out[r[2]] = (sum(seen), min(seen), max(seen), len(seen))
        return out

    assert {r["id"]: (r["total"], r["low"], r["high"], r["n"]) for r in got.collect()} == expected(run)


def test_a_hot_key_is_dealt_to_many_ranges(table, spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = ordered._ranges(table, ["key"], ["day", "id"], table.columns)
    sizes = [r[0] for r in cut.filter("key = 'hot'").groupBy(ordered._RANGE).count().select("count").collect()]
    assert len(sizes) >= parts // 2 and max(sizes) < 2 * len(ROWS) / parts


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_building_a_plan_starts_no_job(table, spark):
    before = jobs(spark)
    for df in (
        ordered.lag_values(table, "key", ["day", "id"], "v", [1, 3]), ordered.row_index(table, [], ["day", "id"], total="n"),
        ordered.running(table, "key", ["day", "id"], {"n": ("count", "v")}),
    ):
        assert jobs(spark) == before
        df.collect()
        # A column that the result does not need does not part the two sides either.
        df.select(df.columns[-1]).collect()
        before = jobs(spark)
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_small_inputs_use_one_plain_window(spark, tmp_path):
    spark.createDataFrame(ROWS, "key string, day int, id int, v double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    shuffles = lambda: ordered.row_index(df, "key", ["day", "id"])._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    for limit, many in (("1000000000", False), ("10", True)):
        spark.conf.set(ordered.PLAIN_SETTING, limit)
        assert (shuffles() > 1) == many
    spark.conf.set(ordered.PLAIN_SETTING, "1000000000")
    assert "SinglePartition" not in ordered.row_index(df, [], ["day", "id"])._jdf.queryExecution().executedPlan().toString().split("Exchange rangepartitioning")[-1]
    spark.conf.set(ordered.PLAIN_SETTING, "0")


def test_no_task_holds_the_whole_table(table, spark):
    """The only single partition is that of the sums, one a range."""
    plan = ordered.row_index(table, [], ["day", "id"])._jdf.queryExecution().executedPlan().toString().split("\n")
    at = [i for i, line in enumerate(plan) if "Exchange SinglePartition" in line]
    assert at and all("HashAggregate" in plan[i + 1] for i in at)


def test_top_k_trims_before_the_shuffle(table):
    plan = ordered.top_k(table, "key", ["v", "id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")
