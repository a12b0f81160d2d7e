from cadastra.streaming import updates


def test_windowed_population(spark, tmp_path):
    rows = [(1, "2024-01-01 00:01:00", "a", "4"), (2, "2024-01-01 00:02:00", "a", None), (3, "2024-01-01 00:12:00", "b", "2"), (4, "2024-01-01 02:00:00", "b", "1")]
    df = spark.createDataFrame(rows, "id long, ts string, area string, value string").selectExpr("id", "cast(ts as timestamp) ts", "area", "value")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    areas = spark.createDataFrame([("a", "A"), ("b", "B")], "area string, name string")
    out = updates.population_by_window(updates.enrich(stream, areas, "area"), "name")
    q = out.writeStream.format("memory").queryName("pop").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["name"], r["households"], r["updates"]) for r in spark.table("pop").collect()} == {("A", 5.0, 2), ("B", 2.0, 1)}
