import numpy as np

from thawline.operators import response
from thawline.streaming.response import stream_response, windowed_forcing


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    f = np.random.RandomState(3).rand(20) * 4
    rows = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(f)], "scenario string, k long, f double")
    for i, part in enumerate((rows.where("k < 8"), rows.where("k between 6 and 13"), rows.where("k > 13"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del i
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_response(stream, list(response.FIXED), 4.08).writeStream.format("memory").queryName("responses").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("responses").toPandas().sort_values(["mode", "k"]).y.to_numpy()
    d = response.forcing_increments(rows.drop("scenario"), 4.08)
    expect = response.pc_convolution(d, response.fixed_params(rows)).toPandas().sort_values(["mode", "k"]).y.to_numpy()
    np.testing.assert_allclose(got, expect, atol=1e-9)


def test_windows_of_events(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/event*.parquet")
    query = windowed_forcing(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("windows").count() == windowed_forcing(events).count() > 0
