"""What training reads."""

from pyspark.sql import functions as F

from faresight.plans import model


def test_training_reads_its_features_once(spark):
    """The size gate, the dictionaries and the stored numbers read the features; boosting and the metrics do not."""
    n = 800
    number = {c: (F.col("id") * (i + 3) % 17).cast("double").alias(c) for i, c in enumerate(model.FEATURES)}
    text = {c: F.format_string("N%02d", F.col("id") % 7).alias(c) for c in model.CATEGORIES}
    rows = spark.range(n).select("id", *(number | text).values(), (F.col("id") % 50 * 100.0 + 900).alias("price"), F.lit(1.0).alias("weight"))
    read = spark.sparkContext.accumulator(0)

    def tally(chunks):
        for chunk in chunks:
            read.add(len(chunk))
            yield chunk

    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    fitted = model.train_fare_model(rows.mapInPandas(tally, rows.schema), ["id"], rounds=3, depth=2)
    assert fitted.metrics["samples"] > 0 and fitted.trees.getNumTrees >= 1
    assert read.value <= 3 * n
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held
