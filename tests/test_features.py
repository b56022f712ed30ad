import json

from quartier.sources import features

ROWS = [({"id": str(i), "name": "né \n[x] {y}", "note": None}, "Point" if i % 3 else "Polygon", json.dumps([i, -i] if i % 3 else [[[0, 0], [1, i], [1, 1], [0, 0]]])) for i in range(500)]


def plain(rows):
    return sorted(((sorted(r.properties.items()), r.kind, r.coordinates) for r in rows), key=str)


def test_written_in_parts_and_read_in_parts(spark, tmp_path):
    features.register(spark)
    df = spark.createDataFrame([*ROWS, ({}, None, None)], features.SCHEMA).repartition(3)
    path = str(tmp_path / "c")
    for mode, times in (("overwrite", 1), ("append", 2), ("overwrite", 1)):
        df.write.format("features").mode(mode).save(path)
        back = spark.read.format("features").option("part_bytes", 997).load(path)
        assert plain(back.collect()) == sorted(plain(df.collect()) * times, key=str)
    assert back.rdd.getNumPartitions() > 30
    names = [f.name for f in (tmp_path / "c").iterdir()]
    assert names and all(n.startswith("part-") for n in names)
    for f in (tmp_path / "c").iterdir():  # any GeoJSON tool reads such a file
        held = json.loads(f.read_text())
        assert held["type"] == "FeatureCollection" and all(x["type"] == "Feature" for x in held["features"])
    assert plain(spark.read.format("features").load(path).collect()) == plain(df.collect())


def test_other_collections_and_pushed_kinds(spark, tmp_path):
    features.register(spark)
    collection = {"type": "FeatureCollection", "crs": {"a": [1]}, "features": [{"type": "Feature", "properties": {"n": 1, "s": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": None, "geometry": None}]}
    (tmp_path / "one.geojson").write_text(json.dumps(collection, indent=2))
    (tmp_path / "none.geojson").write_text("{}")
    got = spark.read.format("features").load(str(tmp_path)).collect()
    assert plain(got) == [([("n", "1"), ("s", "x")], "Point", "[1, 2]"), ([], None, None)]
    points = spark.read.format("features").load(str(tmp_path)).where("kind = 'Point' AND coordinates IS NOT NULL")
    assert [r.kind for r in points.collect()] == ["Point"]
    assert "= Point" not in points._jdf.queryExecution().executedPlan().toString()  # the reader compares


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    features.register(spark)
    bad = spark.createDataFrame([*ROWS[:50], ({}, "Point", "no json")], features.SCHEMA).repartition(2)
    try:
        bad.write.format("features").mode("append").save(str(tmp_path / "c"))
        raise AssertionError("the write should fail")
    except Exception as e:
        assert "should fail" not in str(e)
    assert not [f for f in (tmp_path / "c").glob("part-*")]
