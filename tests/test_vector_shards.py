import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridemill.operators import search
from stridemill.sources import vectors


@pytest.fixture()
def place(spark, tmp_path):
    vectors.register(spark)
    return str(tmp_path / "stored")


def stored(df, place, mode="append", shards=4):
    df.write.format("vector_shards").option("shards", shards).mode(mode).save(place)


def read(spark, place):
    return spark.read.format("vector_shards").load(place)


def test_rounding_is_to_the_nearest_even():
    exact = np.array([0.0, -0.0, 1.0, -2.5, math.inf, -math.inf, 2.0**-126], np.float32)
    assert vectors.from_bf16(vectors.to_bf16(exact)).tobytes() == exact.tobytes()
    one, ulp = 1.0, 2.0**-7
    x = np.array([one + ulp / 2, one + 3 * ulp / 2, one + ulp * 0.51, one + ulp * 0.49, 3.4e38], np.float32)
    assert vectors.from_bf16(vectors.to_bf16(x)).tolist() == [one, one + 2 * ulp, one + ulp, one, math.inf]
    assert np.isnan(vectors.from_bf16(vectors.to_bf16(np.array([math.nan], np.float32))))[0]
    every = np.arange(1 << 16, dtype="<u2")
    back = vectors.from_bf16(every)
    assert (vectors.to_bf16(back) == every)[~np.isnan(back)].all()


def test_round_trip_and_pruning(spark, place):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    stored(df.repartition(3), place)
    got = {r["vec_id"]: (r["embedding"], r["colocation_index"]) for r in read(spark, place).collect()}
    want = {r["vec_id"]: r["embedding"] for r in df.collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == (vectors.from_bf16(vectors.to_bf16(np.array(v, np.float32))).tolist(), k % 4)
    third = read(spark, place).filter("colocation_index = 2")
    assert third.rdd.getNumPartitions() == 3 and {r["vec_id"] % 4 for r in third.collect()} == {2}
    assert read(spark, place).rdd.getNumPartitions() == 12
    # what was stored is what is found
    stored_vectors = read(spark, place).select("vec_id", "embedding")
    rounded = spark.createDataFrame([(k, v[0]) for k, v in got.items()], "vec_id long, embedding array<float>")
    found = [sorted(map(tuple, search.search_dot(x, x.filter("vec_id % 50 = 0")).collect())) for x in (stored_vectors, rounded)]
    assert found[0] == found[1]


def test_append_and_overwrite(spark, place):
    df = spark.range(10).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0)).alias("embedding"))
    stored(df, place)
    stored(df.withColumn("vec_id", F.col("vec_id") + 10), place)
    assert read(spark, place).count() == 20
    files = set(os.listdir(place))
    stored(df.limit(3), place, "overwrite")
    assert read(spark, place).count() == 3 and not files & set(os.listdir(place)) - {"_vectors"}
    with pytest.raises(Exception, match="shards"):
        stored(df, place, shards=2)
    assert read(spark, place).count() == 3
    stored(df.limit(0), place, "overwrite")
    assert read(spark, place).count() == 0


def test_a_failed_write_leaves_nothing_readable(spark, place):
    good = spark.range(0, 100, 1, 4).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    bad = good.withColumn("embedding", F.when(F.col("vec_id") == 99, F.lit(None)).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="null"):
        stored(bad, place)
    with pytest.raises(Exception, match="no vectors"):
        read(spark, place).count()
    stored(good, place)
    with pytest.raises(Exception, match="null"):
        stored(bad, place)
    assert read(spark, place).count() == 100
    longer = good.withColumn("embedding", F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")))
    with pytest.raises(Exception, match="lengths"):
        stored(longer, place)
    assert read(spark, place).count() == 100
