"""Tables that cut lineage."""

from pyspark.sql import functions as F

from loomgraph.operators import graphs


def test_sizes_stay_those_of_the_rows(spark):
    """Loops of joins don't carry products of estimated sizes on, which grow to millions of digits in the driver."""
    known = front = graphs.cut(spark.range(20).select("id", F.lit("a").alias("x")))
    for _ in range(5):
        front = graphs.cut(front.join(known.withColumnRenamed("x", "y"), "id").groupBy("id").agg(F.max("x").alias("x")))
        known = graphs.cut(known.join(front.select("id"), "id", "left_anti").unionByName(front))
    assert known.count() == 20
    assert len(str(front._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10


def test_rows_and_types_stay(spark):
    df = spark.sql("SELECT 1 AS a, array(named_struct('b', CAST(NULL AS STRING))) AS c, TIMESTAMP'2020-01-01' AS t")
    got = graphs.cut(df)
    assert got.collect() == df.collect() and got.dtypes == df.dtypes
    assert graphs.cut(df.limit(0)).isEmpty()
