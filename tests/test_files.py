"""Readers and writers on small files."""

from verdance.sources import files


def test_geojson_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", -97.5, 30.25), (2, None, None, 1.0)], "id long, name string, longitude double, latitude double")
    files.write_points_geojson(df, str(tmp_path / "points"))
    back = files.read_points_geojson(spark, str(tmp_path / "points"), "id: bigint, name: string")
    assert sorted(map(tuple, back.collect())) == [(1, "a", -97.5, 30.25), (2, None, None, None)]
    names = files.read_points_geojson(spark, str(tmp_path / "points"), "id: bigint", geometry=False)
    assert names.columns == ["id"] and sorted(r[0] for r in names.collect()) == [1, 2]


def test_feature_collection(spark, tmp_path):
    p = tmp_path / "c.geojson"
    p.write_text('{"type": "FeatureCollection", "features": [\n{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"id": 5}},\n{"type": "Feature", "geometry": null, "properties": {"id": 6}}]}')
    rows = files.read_points_geojson(spark, str(p), "id: bigint")
    assert sorted(map(tuple, rows.collect()), key=str) == [(5, 1.0, 2.0), (6, None, None)]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "x"), (None, "y")], "v double, name string")
    files.write_csv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "t"), "v double, name string").collect()), key=str) == [(1.5, "x"), (None, "y")]
    assert files.read_csv(spark, str(tmp_path / "t"), "v double, name string", ["name"]).columns == ["name"]


def test_income_tables(spark, tmp_path):
    us = tmp_path / "us.csv"
    us.write_text('GEO_ID,NAME,B19013_001E,B19013_001M\nGeography,Name,Estimate,Margin\n1500000US060855001001,a,71000,5\n1500000US060855001002,b,"250,000+",**\n1500000US060855001003,c,-,-\n1500000US060855001004,d,"2,500-",1\n')
    assert sorted(map(tuple, files.read_us_income(spark, str(us)).collect())) == [("060855001001", 71000.0)]
    assert sorted(map(tuple, files.read_us_income(spark, str(us), bounded=True).collect())) == [("060855001001", 71000.0), ("060855001002", 250000.0), ("060855001004", 2500.0)]
    ca = tmp_path / "ca.csv"
    ca.write_bytes("ALT_GEO_CODE,GEO_LEVEL,GEO_NAME,CHARACTERISTIC_ID,C1_COUNT_TOTAL\n59150001,Dissemination area,Montréal,243,137000\n59150002,Dissemination area,x,243,..\n59150003,Dissemination area,x,7,1\n48000001,Dissemination area,x,243,1\n".encode("latin-1"))
    assert [(r[0], round(r[1], 6)) for r in files.read_canadian_income(spark, str(ca), "5915").collect()] == [("59150001", 100000.0)]


def test_canadian_income_among_other_columns(spark, tmp_path):
    """The columns of a census profile: others before, between and behind, one name twice."""
    head = "CENSUS_YEAR,DGUID,ALT_GEO_CODE,GEO_LEVEL,GEO_NAME,TNR_SF,DATA_QUALITY_FLAG,CHARACTERISTIC_ID,CHARACTERISTIC_NAME,CHARACTERISTIC_NOTE,C1_COUNT_TOTAL,SYMBOL,C2_COUNT_MEN,SYMBOL"
    rows = ['2021,x,59150001,Dissemination area,Montr\u00e9al,1.5,00000,243,"Median, total",,137000,,1,', "2021,x,59150002,Dissemination area,b,1,0,243,m,,..,x,,", "2021,x,59150003,Census tract,b,1,0,243,m,,5,,,", "2021,x,59150004,Dissemination area,b,1,0,24,m,,5,,,"]
    p = tmp_path / "ca.csv"
    p.write_bytes("\n".join([head, *rows]).encode("latin-1"))
    assert [(r[0], round(r[1], 6)) for r in files.read_canadian_income(spark, str(p), "5915").collect()] == [("59150001", 100000.0)]


def test_csv_by_name(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("other,name,v,last\n1,x,2.5,3\n1,y,none,3\n")
    assert sorted(map(tuple, files.read_csv(spark, str(p), "v double, name string").collect()), key=str) == [(2.5, "x"), (None, "y")]


def test_geojson_of_mixed_layouts(spark, tmp_path):
    """Feature lines, a collection with a feature to each line, one on a single line, one spread out."""
    feature = lambda k: '{"type": "Feature", "properties": {"id": %d}, "geometry": {"type": "Point", "coordinates": [%d, 1]}}' % (k, k)
    folder = tmp_path / "all"
    folder.mkdir()
    (folder / "a.json").write_text(f"{feature(1)}\n{feature(2)}\n")
    (folder / "b.json").write_text('{\n"type": "FeatureCollection",\n"name": "b",\n"features": [\n' + f"{feature(3)},\n{feature(4)}\n]\n}}\n")
    (folder / "c.json").write_text('{"type": "FeatureCollection", "features": [' + f"{feature(5)}, {feature(6)}]}}")
    (folder / "d.json").write_text('{"type": "FeatureCollection", "features": [' + feature(7).replace(", ", ",\n") + "]}")
    (folder / "e.json").write_text("")
    rows = files.read_points_geojson(spark, str(folder), "id: bigint")
    assert sorted(map(tuple, rows.collect())) == [(k, float(k), 1.0) for k in range(1, 8)]
    assert sorted(r[0] for r in files.read_points_geojson(spark, str(folder), "id: bigint", geometry=False).collect()) == list(range(1, 8))
