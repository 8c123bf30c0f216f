"""Rasters in all layouts, byte for byte, and what a window reads."""

import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.sources import geotiff as G


def image(f):
    """All bands of a file, put together from its blocks."""
    head, blocks = G.header(f)
    out = np.full((head["bands"], head["height"], head["width"]), np.nan)
    for b in blocks:
        f.seek(b["at"])
        out[b["band"] - 1, b["row"] : b["row"] + b["height"], b["col"] : b["col"] + b["width"]] = G.decoded(f.read(b["length"]), b)
    return head, out


@pytest.mark.parametrize("kind", ["u1", "u2", "i2", "i4", "f4", "f8"])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("layout", [{"rows": 7}, {"rows": 100}, {"tile": 16}, {"rows": 5, "apart": True}, {"tile": 32, "apart": True}, {"rows": 9, "compression": 1}])
def test_layouts(kind, order, layout):
    values = (np.random.default_rng(0).normal(60, 30, (3, 37, 50))).astype(kind)
    head, got = image(io.BytesIO(G.encoded(values, (10.0, 20.0, 0.5, -0.25), 32614, order=order, **layout)))
    assert np.array_equal(got, values.astype(float))
    assert (head["crs"], head["x0"], head["y0"], head["x_step"], head["y_step"]) == (32614, 10.0, 20.0, 0.5, -0.25)


def lzw(data):
    """A plain encoder: codes of 9 to 12 bits, cleared before the table is full."""
    table, size, word, codes = {bytes([k]): k for k in range(256)}, 258, b"", [(256, 9)]
    for b in data:
        longer = word + bytes([b])
        if longer in table:
            word = longer
            continue
        codes.append((table[word], size.bit_length() if size > 511 else 9))
        table[longer], size, word = size, size + 1, bytes([b])
        if size == 4094:
            codes.append((256, 12))
            table, size = {bytes([k]): k for k in range(256)}, 258
    codes.append((table[word], max(9, size.bit_length())))
    codes.append((257, max(9, (size + 1).bit_length())))
    bits = "".join(f"{code:0{width}b}" for code, width in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("n, most", [(1, 256), (300, 2), (3000, 3), (20_000, 256), (60_000, 20)])
def test_lzw(n, most):
    data = np.random.default_rng(n).integers(0, most, n).astype("u1").tobytes()
    assert G.unpacked_lzw(lzw(data)) == data


def test_packed_bytes():
    assert G.unpacked_bits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x80])) == bytes.fromhex("aaaaaa80002aaaaaaaaa")
    # the example of the public specification: 7 7 7 8 8 7 7 6 6
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert G.unpacked_lzw(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_differenced_integers():
    values = np.random.default_rng(1).integers(0, 60_000, (20, 30)).astype("<u2")
    differences = np.diff(values, axis=1, prepend=np.uint16(0)).astype("<u2")
    b = {"compression": 8, "predictor": 2, "dtype": "<u2", "block_height": 20, "block_width": 30, "samples": 1, "height": 20, "width": 30, "band": 1}
    assert np.array_equal(G.decoded(zlib.compress(differences.tobytes()), b), values)


def test_unknown_things_raise():
    b = {"compression": 7, "predictor": 1, "dtype": "<u1", "block_height": 1, "block_width": 1, "samples": 1, "height": 1, "width": 1, "band": 1}
    with pytest.raises(ValueError):
        G.decoded(b"", b)
    with pytest.raises(ValueError):
        G.header(io.BytesIO(b"GIF89a" + bytes(20)))
    with pytest.raises(ValueError):
        G.header(io.BytesIO(struct.pack("<2sHI", b"II", 7, 8) + bytes(20)))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files of different layouts, one in a folder below, and one of another kind."""
    top = tmp_path_factory.mktemp("rasters")
    (top / "below").mkdir()
    rng = np.random.default_rng(2)
    images = {"a": rng.random((1, 100, 80)), "b": rng.integers(0, 255, (2, 64, 64)).astype("u1"), "c": rng.random((1, 30, 200)).astype("f4")}
    (top / "a.tif").write_bytes(G.encoded(images["a"], (0.0, 1.0, 0.01, -0.01), 4326, rows=10))
    (top / "b.tiff").write_bytes(G.encoded(images["b"], tile=16, order=">"))
    (top / "below" / "c.tif").write_bytes(G.encoded(images["c"], (5.0, 5.0, 1.0, -1.0), 32614, rows=8, compression=1))
    (top / "notes.txt").write_text("no raster")
    return top, images


def test_tables(spark, folder):
    top, images = folder
    rows = G.pixels(G.read_blocks(spark, str(top))).select(F.regexp_extract("path", r"(\w)\.tiff?$", 1).alias("k"), "band", "r", "c", "v").toPandas()
    for k, image_ in images.items():
        own = rows[rows["k"] == k]
        got = np.full(image_.shape, np.nan)
        got[own["band"] - 1, own["r"], own["c"]] = own["v"]
        assert len(own) == image_.size and np.array_equal(got, image_.astype(float))


def test_a_window_reads_its_blocks_only(spark, folder):
    top, images = folder
    window = (25, 10, 45, 30)
    index = G.block_index(spark, str(top / "a.tif"))
    blocks = G.read_blocks(spark, str(top / "a.tif"), 1, window)
    assert index.count() == 10 and sorted(r["row"] for r in blocks.collect()) == [20, 30, 40]
    got = G.pixels(blocks, window).toPandas().pivot(index="r", columns="c", values="v")
    assert np.array_equal(got.to_numpy(), images["a"][0, 25:45, 10:30])
    assert G.read_blocks(spark, str(top / "b.tiff"), 2, (0, 0, 17, 17)).count() == 4


def test_whole_files_where_ranges_cannot_be_read(spark, folder, monkeypatch):
    top, _ = folder
    window = (5, 5, 20, 20)
    want = sorted(map(str, G.read_blocks(spark, str(top), 1, window).collect()))
    monkeypatch.setattr(G, "_ranged", lambda path: False)
    assert sorted(map(str, G.read_blocks(spark, str(top), 1, window).collect())) == want
    assert G.read_headers(spark, str(top)).count() == 3


def test_headers(spark, folder):
    got = {r["path"][-5:]: r for r in G.read_headers(spark, str(folder[0])).collect()}
    a, b = got["a.tif"], got[".tiff"]
    assert (a["width"], a["height"], a["bands"], a["crs"], a["left"], a["bottom"], a["right"], a["top"]) == pytest.approx((80, 100, 1, 4326, 0.0, 0.0, 0.8, 1.0))
    assert (b["bands"], b["crs"], b["left"]) == (2, None, None)


def test_scaling(spark):
    rows = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("b", 51.0), ("b", 0.0)], "path string, v double")
    assert sorted(map(tuple, G.unit_scaled(rows).collect())) == [("a", 0.5), ("a", 1.0), ("b", 0.0), ("b", 0.2)]
