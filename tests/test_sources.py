"""Sources and sinks."""

import datetime as dt
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from faresight.plans import catalog, model, queries_scoring
from faresight.plans.answer import request_snapshots
from faresight.schemas import ALLOWED, FOREIGN_KEYS, SCHEMAS
from faresight.session import work_dir
from faresight.sources import star, tables


def test_every_schema_is_readable(spark):
    for name, ddl in SCHEMAS.items():
        assert spark.createDataFrame([], ddl).columns, name
    for child, column, parent, key in FOREIGN_KEYS:
        assert column in spark.createDataFrame([], SCHEMAS[child]).columns
        assert key in spark.createDataFrame([], SCHEMAS[parent]).columns
    assert ALLOWED["tier"][0] == "BLUE"


def test_formats(spark, tmp_path):
    rows = spark.createDataFrame([("C1", Decimal("10.00"))], "code string, discount_value decimal(10,2)")
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        rows.write.format(fmt).save(path)
        got = tables.read_table(spark, "coupons", path, fmt).select("code", "discount_value", "usage_limit").first()
        assert tuple(got) == ("C1", Decimal("10.00"), None)
    spark.createDataFrame([("DEL", "Delhi", True)], "iata_code string, name string, is_active boolean").write.csv(str(tmp_path / "csv"), header=True)
    csv = spark.read.csv(str(tmp_path / "csv"), header=True, schema="iata_code string, name string, is_active boolean")
    assert csv.first()["is_active"] is True


def test_history_limit_keeps_the_earliest(spark):
    rows = spark.createDataFrame([(float(p), dt.datetime(2026, 1, d)) for p, d in ((900, 3), (10, 1), (1000, 2), (99999, 1))] + [(None, dt.datetime(2026, 1, 1))], "price double, recorded_at timestamp")
    assert tables.fare_history(rows).count() == 2
    assert tables.fare_history(rows, limit=1).first()["price"] == 1000.0


def test_append_and_offers(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.createDataFrame([("A", "B", Decimal("1.00"), dt.date(2026, 1, 1))], "origin_code string, destination_code string, price decimal(10,2), departure_date date")
    tables.append_history(rows, path)
    tables.append_history(rows, path)
    assert tables.read_table(spark, "price_history", path).filter("departure_date = date '2026-01-01'").count() == 2
    offer = spark.sql("select named_struct('id', 'o1', 'seats_available', 3) as offer")
    tables.write_offers(offer, str(tmp_path / "offers"))
    assert tables.read_offers(spark, str(tmp_path / "offers")).select("offer.id", "offer.seats_available").first() == ("o1", 3)


def test_row_gate(spark):
    assert tables.require_rows(spark.range(50), 50) and not tables.require_rows(spark.range(49), 50)


def test_work_dir_follows_the_cluster_setting(spark, tmp_path):
    shared = SimpleNamespace(conf={"spark.checkpoint.dir": str(tmp_path)})
    assert work_dir(shared, "x").startswith(str(tmp_path))
    unset = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://head:7077"))
    with pytest.raises(RuntimeError):
        work_dir(unset, "x")
    assert work_dir(spark, "x") != work_dir(spark, "x")


def test_model_round_trip(spark, sf, tmp_path):
    history = star.price_history(spark, sf)
    keys = ["l_orderkey", "l_linenumber", "departure_date", "l_partkey", "l_suppkey"]
    path = str(tmp_path / "features")
    model.fare_features(history, star.AS_OF, star.ORDER, keep=keys).write.parquet(path)
    features = spark.read.parquet(path)
    fitted = model.train_fare_model(features, keys, rounds=5, depth=4)
    # Boosting ends where the validation rows stop gaining; a tolerance that no round can meet ends it at once.
    assert fitted.metrics["samples"] > 100 and 1 <= fitted.metrics["estimators"] <= 5
    assert model.train_fare_model(features, keys, rounds=5, depth=1, tolerance=0.0).metrics["estimators"] == 5
    assert model.train_fare_model(features, keys, rounds=5, depth=1, tolerance=0.5).metrics["estimators"] == 1
    fitted.save(str(tmp_path / "model"))
    loaded = model.FareModel.load(spark, str(tmp_path / "model"))
    assert loaded.metrics == fitted.metrics

    o, d = star.bounded_history(spark, sf).filter("origin_code <> destination_code").select("origin_code", "destination_code").orderBy("origin_code").first()
    asked = spark.createDataFrame([(1, f" {o.lower()}", d, "1998-07-01"), (2, o, o, None), (3, o, "XXX", None), (4, o, d, "bad")], "request_id int, origin string, destination string, departure_date string")
    snaps, rejects = request_snapshots(asked, star.bounded_history(spark, sf), star.routes(spark, sf), star.AS_OF)
    assert {r["request_id"]: r["reject_reasons"] for r in rejects.collect()} == {2: ["same_place"], 3: ["unsupported_route"], 4: ["departure_date"]}
    assert snaps.count() == 1
    fc = model.forecast_fares(snaps, loaded, star.AS_OF)
    rows = fc.orderBy("day").collect()
    assert [r["day"] for r in rows] == list(range(1, 31))
    assert rows[0]["origin_code"] == o and all(800 <= r["lower"] <= r["upper"] for r in rows)
    assert rows[29]["days_until_dep"] == 0 and rows[0]["days_until_dep"] == 29
    same = model.forecast_fares(snaps, fitted, star.AS_OF).orderBy("day").collect()
    assert [r["price"] for r in rows] == [r["price"] for r in same]


def test_queries_share_one_model_and_measure_held_out_rows(spark, sf, monkeypatch):
    train, fitted = model.train_fare_model, []

    def small(features, keys):
        fitted.append(train(features, keys, rounds=3, depth=3))
        return fitted[-1]

    monkeypatch.setattr(model, "train_fare_model", small)
    monkeypatch.setattr(queries_scoring, "_FITTED", {})
    assert (model.ROUNDS, model.DEPTH) == (900, 9)
    got = catalog.QUERIES["train_model"](spark, sf).first().asDict()
    want = fitted[0].metrics
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert catalog.QUERIES["answer_requests"](spark, sf).count() > 0
    assert catalog.QUERIES["train_model_invariants"](spark, sf).first().rounds_in_bounds and len(fitted) == 1


def test_no_request_is_lost(spark, sf):
    history = star.bounded_history(spark, sf)
    o, d = history.filter("origin_code <> destination_code").select("origin_code", "destination_code").orderBy("origin_code", "destination_code").first()
    routes = star.routes(spark, sf).unionByName(star.routes(spark, sf).limit(1).withColumns({"origin_code": F.lit("Z01"), "destination_code": F.lit("Z02")}))
    asked = spark.createDataFrame([(1, o, d, None), (2, "Z01", "Z02", None), (3, "Z02", "Z01", None), (4, o, d, "1998-09-01")], "request_id int, origin string, destination string, departure_date string")
    snaps, rejects = request_snapshots(asked, history, routes, star.AS_OF)
    assert sorted(r["request_id"] for r in snaps.collect()) == [1, 4]
    assert {r["request_id"]: r["reject_reasons"] for r in rejects.collect()} == {2: ["no_fare"], 3: ["unsupported_route"]}


def test_too_few_rows_train_nothing(spark):
    empty = spark.createDataFrame([], "price double")
    assert model.train_fare_model(empty, ["price"]) is None


def test_unseen_category_is_zero(spark):
    encoders = model.fit_encoders(spark.createDataFrame([("b",), ("A",), ("a",), (None,)], "c string"), ["c"])
    coded = model.apply_encoders(spark.createDataFrame([("a",), ("B",), ("z",), (None,)], "c string"), encoders, ["c"])
    assert sorted(r["c"] for r in coded.collect()) == [0, 0, 1, 2]


def test_split_is_stable(spark):
    df = spark.range(2000)
    train, test = model.split(df, ["id"])
    again, _ = model.split(df.repartition(7), ["id"])
    assert train.count() + test.count() == 2000 and 320 < test.count() < 480
    assert train.exceptAll(again).isEmpty()
    assert train.join(test, "id").isEmpty()


def test_features_have_the_inputs_in_order(spark, sf):
    out = model.fare_features(star.price_history(spark, sf), star.AS_OF, star.ORDER)
    assert out.columns[:16] == model.FEATURES
    assert out.select([F.count_if(F.col(c).isNull()).alias(c) for c in model.FEATURES]).first() == tuple([0] * 16)
