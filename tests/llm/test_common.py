from pagewright.llm.common import bounded_batches, durable, drop_durable, spread


def test_batches_are_bounded_and_smaller_ones_kept(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(rows)
    spark.conf.unset(size)
    bounded_batches(spark)
    assert (spark.conf.get(rows), spark.conf.get(size).removesuffix("b")) == ("500", str(16 << 20))
    spark.conf.set(rows, "100")
    bounded_batches(spark)
    assert spark.conf.get(rows) == "100"
    spark.conf.set(rows, "500")


def test_durable_results_can_be_dropped(spark):
    kept = durable(spark.range(10), "x")
    assert sorted(r.id for r in kept.collect()) == [*range(10)] and kept.columns == ["id"]
    drop_durable(kept)
    assert spread(spark.range(3)).count() == 3
