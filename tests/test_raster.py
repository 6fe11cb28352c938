import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieplane.sources import raster


def lines(spark, tiles=3, rows=50, cols=20, seed=1):
    rng = np.random.default_rng(seed)
    data = {t: rng.integers(0, 256, (rows + t, cols + t)).astype(np.uint8) for t in range(tiles)}
    return data, spark.createDataFrame([(t, r, bytearray(a[r].tobytes())) for t, a in data.items() for r in range(len(a))], raster.SCHEMA)


def test_round_trip_and_pushed_filters(spark, tmp_path):
    raster.register(spark)
    data, df = lines(spark)
    path = str(tmp_path / "r")
    raster.write_lines(df, path, strip=7)
    back = spark.read.format("raster").load(path)
    got = {(r.tile, r.row): bytes(r.pixels) for r in back.collect()}
    assert got == {(t, r): a[r].tobytes() for t, a in data.items() for r in range(len(a))}
    some = back.filter("tile = 1 AND row >= 10 AND row < 13")
    assert sorted((r.tile, r.row) for r in some.collect()) == [(1, 10), (1, 11), (1, 12)]
    assert some.rdd.getNumPartitions() <= 2 < back.rdd.getNumPartitions()  # only the strips that hold these lines are read


def test_only_strips_of_the_filter_are_planned(tmp_path, spark):
    raster.register(spark)
    _, df = lines(spark, rows=100)
    path = str(tmp_path / "r")
    raster.write_lines(df, path, strip=10)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

    reader = raster.RasterReader(path, {})
    rest = list(reader.pushFilters([EqualTo(("tile",), 2), GreaterThan(("row",), 14), LessThanOrEqual(("row",), 31), IsNotNull(("pixels",)), In(("tile",), (1, 2))]))
    assert [type(f).__name__ for f in rest] == ["IsNotNull"]
    strips = reader.partitions()
    assert {s.tile for s in strips} == {2} and sorted(s.first + i for s in strips for i in range(s.begin, s.end)) == list(range(15, 32))


def test_files_without_an_index_are_not_read(spark, tmp_path):
    raster.register(spark)
    _, df = lines(spark)
    path = tmp_path / "r"
    writer = raster.RasterWriter(str(path), False)
    message = writer.write(iter(df.filter("tile = 0").collect()))
    assert raster.committed(str(path)) == [] and list(path.glob("*.img"))
    assert spark.read.format("raster").load(str(path)).count() == 0
    writer.commit([message])
    assert spark.read.format("raster").load(str(path)).count() == 50
    lost = writer.write(iter(df.filter("tile = 1").collect()))
    writer.abort([lost])
    assert len(list(path.glob("*.img"))) == 1
    assert sum(len(json.loads(p.read_text())) for p in path.glob("_index-*.json")) == 1


def test_overwrite_replaces_what_was_there(spark, tmp_path):
    raster.register(spark)
    _, df = lines(spark)
    path = str(tmp_path / "r")
    raster.write_lines(df, path)
    df.filter("tile = 2").coalesce(1).write.format("raster").mode("overwrite").save(path)
    assert {r.tile for r in spark.read.format("raster").load(path).collect()} == {2}


def test_a_file_of_another_origin(spark, tmp_path):
    raster.register(spark)
    image = np.arange(60, dtype=np.uint8).reshape(6, 10)
    label = 'OBJECT = IMAGE\r\nRECORD_BYTES = 16\r\n^IMAGE = 20\r\nLINES = 6\r\nLINE_SAMPLES = 10 <SAMPLES>\r\nLINE_PREFIX_BYTES = 4\r\nLINE_SUFFIX_BYTES = 2\r\nSAMPLE_BITS = 8\r\nFILTER = "RED <1>"\r\nEND\r\n'
    body = b"".join(b"pppp" + line.tobytes() + b"ss" for line in image)
    (tmp_path / "a.img").write_bytes(label.encode().ljust(19 * 16) + body)
    got = spark.read.format("raster").load(str(tmp_path / "a.img")).orderBy("row").collect()
    assert [bytes(r.pixels) for r in got] == [line.tobytes() for line in image]
    (tmp_path / "raw").write_bytes(b"xyz" + body)
    got = spark.read.format("raster").options(offset=3, stride=16, prefix=4, lines=6, samples=10, tile=7, first=100).load(str(tmp_path / "raw")).filter("row = 102").collect()
    assert [(r.tile, bytes(r.pixels)) for r in got] == [(7, image[2].tobytes())]
    with pytest.raises(ValueError):
        raster.read_label(b"A = 1\n")
    with pytest.raises(ValueError):
        raster.layout_of({"LINES": "1", "LINE_SAMPLES": "2", "SAMPLE_BITS": "16"})


def test_samples_as_bytes(spark):
    df = spark.createDataFrame([([0, 7, 16, 255],), ([],)], "v array<int>").select("v", raster.pixels_of(F.col("v")).alias("p"))
    assert [bytes(r.p) for r in df.collect()] == [bytes([0, 7, 16, 255]), b""]
    assert [r.b for r in df.filter("size(v) > 0").select(raster.values_of(F.col("p")).alias("b")).collect()] == [[0, 7, 16, 255]]
    x = spark.createDataFrame([(v,) for v in (-20000.0, 1.0, 2.0, 3.0)], "v double")
    assert tuple(raster.byte_range(x, "v").first()) == (1.0, 3.0)
    assert [r.b for r in x.select(raster.to_byte(F.col("v"), F.lit(1.0), F.lit(3.0)).alias("b")).collect()] == [0, 0, 127, 255]


def test_stripes_are_replaced(spark):
    rng = np.random.default_rng(3)
    image = np.tile(np.arange(0, 60, 2), (12, 1)) + rng.integers(0, 2, (12, 30))
    clean = image.copy()
    image[:, 9] = 200
    px = spark.createDataFrame([(0, r, c, float(image[r, c])) for r in range(12) for c in range(30)] + [(1, 0, 0, 5.0)], "tile int, row int, col int, v double")
    got = {(r.tile, r.row, r.col): r.v for r in raster.repair_stripes(px).collect()}
    inner = image[:, 1:29]
    scale = lambda v: int(max(0.0, min(1.0, (v - inner.min()) / (inner.max() - inner.min()))) * 255)
    assert got[1, 0, 0] == 0
    for r in range(12):
        for c in range(30):
            near = [1, 2, 2, 1] @ clean[r, [7, 8, 10, 11]] // 6 if c == 9 else clean[r, c]
            assert got[0, r, c] == scale(near)


def test_vertices_keep_their_order(spark, tmp_path):
    from tieplane.sources import sinks

    df = spark.createDataFrame([(i, float(9 - i), 0.5, float(i)) for i in range(10)], "line int, x double, y double, z double").repartition(4)
    sinks.ascii_ply(df, str(tmp_path / "p"), ("line",))
    text = "".join(f.read_text() for f in sorted((tmp_path / "p").glob("part-*"))).splitlines()
    assert text[2] == "element vertex 10" and [line.split()[0] for line in text[7:]] == [f"{9 - i:.6f}" for i in range(10)]
