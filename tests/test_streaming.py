import pandas as pd

from stepframe.streaming.totals import running_totals, windowed_totals


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(1, "a", 1.0, "2020-01-01 00:00:10"), (2, "b", 2.0, "2020-01-01 00:00:20"), (3, "a", None, "2020-01-01 00:01:10"), (4, "a", 4.0, "2020-01-01 00:01:20")]
    for k in (0, 2):
        spark.createDataFrame(rows[k : k + 2], "i long, k string, v double, t string").selectExpr("i", "k", "v", "cast(t as timestamp) t").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("i long, k string, v double, t timestamp").option("maxFilesPerTrigger", 1).parquet(src)

    def collect(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).toPandas()

    got = collect(running_totals(stream, "k", "i", "v"), "r", "append").sort_values("i")
    assert got["total"].tolist() == [1.0, 2.0, 1.0, 5.0] and got["n"].tolist() == [1, 1, 2, 3]
    got = collect(windowed_totals(stream, "t", "k", "v", "1 minute", "10 minutes"), "w", "complete").sort_values(["start", "k"])
    assert got[["k", "n"]].values.tolist() == [["a", 1], ["b", 1], ["a", 2]] and pd.isna(got["total"]).sum() == 0
