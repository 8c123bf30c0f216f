"""GeoTIFF files as tables of blocks, and tables of pixels as GeoTIFF files.

Files are listed by Spark, headers are read on the executors, and every strip or
tile becomes a row with its place in the file and in the raster.  Which of them
are read is a filter on these rows, so a window or a band costs only its own
blocks; blocks are dealt out anew and read by ranges, each bounded by its own
size.  Stores that only Spark reads hand over whole files instead.

Reads classic and big TIFF of either byte order, in strips or tiles, samples
together or by plane, plain, PackBits, LZW or deflate, with differenced integers;
anything else raises.  The writer makes deflated strips.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The numbers of the tags that are read and written.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_LENGTH, PLANES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_LENGTH, FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS = 33550, 33922, 34735
#: The size and the struct code of each type of field.
FIELD = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
KIND = {1: "u", 2: "i", 3: "f"}
#: Schemes of which ranges can be read; files of others come whole through Spark.
RANGED = ("file", "hdfs", "s3", "s3a", "gs", "abfs")

HEADER = "path string, width long, height long, bands int, dtype string, crs int, x0 double, y0 double, x_step double, y_step double"
BLOCK = "band int, row long, col long, height int, width int, at long, length long, dtype string, compression int, predictor int, samples int, block_height int, block_width int"
VALUES = "path string, band int, row long, col long, height int, width int, values array<double>"


def tags(f) -> tuple[str, dict[int, tuple]]:
    """(byte order, values by tag) of the first image of a file."""
    start = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    magic = struct.unpack(f"{order}H", start[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(f"{order}Q", start[8:16])[0] if big else struct.unpack(f"{order}I", start[4:8])[0]
    count, size, word = (8, 20, "Q") if big else (2, 12, "I")
    f.seek(at)
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", f.read(count))[0]
    found: dict[int, tuple] = {}
    entries = f.read(n * size)
    for k in range(n):
        entry = entries[k * size : (k + 1) * size]
        tag, kind, many = struct.unpack(f"{order}HH{word}", entry[: 12 if big else 8])
        if kind not in FIELD:
            continue
        width, code = FIELD[kind]
        raw = entry[12 if big else 8 :]
        if width * many > len(raw):
            f.seek(struct.unpack(f"{order}{word}", raw)[0])
            raw = f.read(width * many)
        found[tag] = struct.unpack(f"{order}{many}s" if code == "s" else f"{order}{many * len(code)}{code[0]}", raw[: width * many])
    return order, found


def header(f) -> tuple[dict, list[dict]]:
    """What a file says of its raster, and its blocks."""
    order, t = tags(f)
    one = lambda tag, default=None: t.get(tag, (default,))[0]
    width, height, bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, kind = one(BITS, 1), KIND.get(one(FORMAT, 1))
    if bits not in (8, 16, 32, 64) or kind is None or len(set(t.get(BITS, (bits,)))) > 1:
        raise ValueError(f"samples of {bits} bits, format {one(FORMAT, 1)}")
    dtype = f"{order}{kind}{bits // 8}"
    crs = next((t[GEO_KEYS][k + 3] for key in (3072, 2048) for k in range(4, len(t.get(GEO_KEYS, ())) - 3, 4) if t[GEO_KEYS][k] == key), None)
    scale, tie = t.get(PIXEL_SCALE, (None, None)), t.get(TIE_POINT, (0, 0, 0, None, None))
    placed = scale[0] is not None and tie[3] is not None
    place = {"x0": tie[3] - tie[0] * scale[0], "y0": tie[4] + tie[1] * scale[1], "x_step": scale[0], "y_step": -scale[1]} if placed else dict.fromkeys(("x0", "y0", "x_step", "y_step"))
    tiled = TILE_AT in t
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    at, length = (t[TILE_AT], t[TILE_LENGTH]) if tiled else (t[STRIP_AT], t[STRIP_LENGTH])
    across, down = -(-width // bw), -(-height // bh)
    apart = one(PLANES, 1) == 2 and bands > 1
    blocks = []
    for k, (a, n) in enumerate(zip(at, length)):
        plane, rest = divmod(k, across * down)
        row, col = rest // across * bh, rest % across * bw
        for band in [plane + 1] if apart else range(1, bands + 1):
            blocks.append(
                {"band": band, "row": row, "col": col, "height": min(bh, height - row), "width": min(bw, width - col), "at": a, "length": n, "dtype": dtype, "compression": one(COMPRESSION, 1),
                 "predictor": one(PREDICTOR, 1), "samples": 1 if apart else bands, "block_height": bh if tiled else min(bh, height - row), "block_width": bw}
            )
    return {"width": width, "height": height, "bands": bands, "dtype": dtype, "crs": crs, **place}, blocks


def unpacked_bits(raw: bytes) -> bytes:
    """PackBits: runs of one byte, and bytes as they are."""
    out, k = bytearray(), 0
    while k < len(raw):
        n = raw[k]
        if n < 128:
            out += raw[k + 1 : k + 2 + n]
            k += n + 2
        else:
            out += raw[k + 1 : k + 2] * (257 - n) if n > 128 else b""
            k += 2 if n > 128 else 1
    return bytes(out)


def unpacked_lzw(raw: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    out = bytearray()
    table: list[bytes] = []
    bits = held = k = 0
    width, before = 9, b""
    while True:
        while bits < width:
            if k >= len(raw):
                return bytes(out)
            held, bits, k = (held << 8 | raw[k]) & 0xFFFFFF, bits + 8, k + 1
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, before = [bytes([b]) for b in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        # a writer widens its codes one entry early
        width = min(12, max(9, (len(table) + 1).bit_length()))


def decoded(raw: bytes, b: dict) -> np.ndarray:
    """(height, width) of one band of a block, as doubles."""
    c = b["compression"]
    if c in (8, 32946):
        raw = zlib.decompress(raw)
    elif c == 5:
        raw = unpacked_lzw(raw)
    elif c == 32773:
        raw = unpacked_bits(raw)
    elif c != 1:
        raise ValueError(f"compression {c}")
    kind, shape = np.dtype(b["dtype"]), (b["block_height"], b["block_width"], b["samples"])
    values = np.frombuffer(raw, kind, int(np.prod(shape))).reshape(shape)
    if b["predictor"] == 2 and kind.kind in "ui":
        values = np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))
    elif b["predictor"] != 1:
        raise ValueError(f"predictor {b['predictor']}")
    return values[: b["height"], : b["width"], 0 if b["samples"] == 1 else b["band"] - 1].astype(np.float64)


def _open(path: str):
    store, inner = pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path.replace("s3a://", "s3://", 1))
    return store.open_input_file(inner)


def _files(spark: SparkSession, path: str | list[str], whole: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content") if whole else files.select("path").repartition(spark.sparkContext.defaultParallelism)


def _ranged(path: str | list[str]) -> bool:
    first = path if isinstance(path, str) else path[0]
    return "://" not in first or first.split(":", 1)[0] in RANGED


def _table(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


def read_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each file: size, bands, sample type, EPSG code, place of the upper left corner, and steps.

    Place and code are null where a file has none.  No pixel is read."""
    ranged = _ranged(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, p in enumerate(batch.column("path").to_pylist()):
                with _open(p) if ranged else io.BytesIO(batch.column("content")[k].as_py()) as f:
                    rows.append({"path": p, **header(f)[0]})
            yield _table(rows, HEADER)

    found = _files(spark, path, not ranged).mapInArrow(run, HEADER)
    return found.select("*", F.col("x0").alias("left"), F.col("y0").alias("top"), (F.col("x0") + F.col("width") * F.col("x_step")).alias("right"), (F.col("y0") + F.col("height") * F.col("y_step")).alias("bottom"))


def block_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each block and band: where it lies in the raster and in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("path").to_pylist():
                with _open(p) as f:
                    yield _table([{"path": p, **b} for b in header(f)[1]], f"path string, {BLOCK}")

    return _files(spark, path, False).mapInArrow(run, f"path string, {BLOCK}")


def read_index(index: DataFrame) -> DataFrame:
    """The values of the blocks of an index, read by ranges where they are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                with _open(b["path"]) as f:
                    f.seek(b["at"])
                    values = decoded(f.read(b["length"]), b)
                yield _table([{**b, "values": values.reshape(-1)}], VALUES)

    return index.repartition("path", "at").mapInArrow(run, VALUES)


def read_blocks(spark: SparkSession, path: str | list[str], band: int | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, band, row, col, height, width, values) of the blocks that a window touches.

    ``window`` is (row, col, end row, end col), ends excluded; blocks come whole.
    Values run along rows."""
    inside = F.lit(True) if band is None else F.col("band") == band
    if window:
        r0, c0, r1, c1 = window
        inside = inside & (F.col("row") < r1) & (F.col("row") + F.col("height") > r0) & (F.col("col") < c1) & (F.col("col") + F.col("width") > c0)
    if _ranged(path):
        return read_index(block_index(spark, path).where(inside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = content.as_py()
                for b in header(io.BytesIO(raw))[1]:
                    if band in (None, b["band"]) and (not window or (b["row"] < r1 and b["row"] + b["height"] > r0 and b["col"] < c1 and b["col"] + b["width"] > c0)):
                        yield _table([{"path": p, **b, "values": decoded(raw[b["at"] : b["at"] + b["length"]], b).reshape(-1)}], VALUES)

    return _files(spark, path, True).mapInArrow(run, VALUES)


def pixels(blocks: DataFrame, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, band, r, c, v): one row for each pixel of the blocks, cut at the window."""
    rows = blocks.select("path", "band", "row", "col", "width", F.posexplode("values").alias("i", "v"))
    rows = rows.select("path", "band", (F.col("row") + F.floor(F.col("i") / F.col("width"))).alias("r"), (F.col("col") + F.col("i") % F.col("width")).alias("c"), "v")
    if window:
        r0, c0, r1, c1 = window
        rows = rows.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))
    return rows


def unit_scaled(rows: DataFrame) -> DataFrame:
    """Pixels of a file divided by 255 if any of them is above 1."""
    most = rows.groupBy("path").agg(F.max("v").alias("_most"))
    return rows.join(most, "path").withColumn("v", F.when(F.col("_most") > 1, F.col("v") / 255.0).otherwise(F.col("v"))).drop("_most")


def encoded(values: np.ndarray, place: tuple[float, float, float, float] | None = None, crs: int | None = None, rows: int = 64, tile: int | None = None, order: str = "<", compression: int = 8, apart: bool = False) -> bytes:
    """A file of (bands, height, width): strips of ``rows`` rows, or square tiles; compression 1 or 8."""
    bands, height, width = values.shape
    kind = values.dtype.newbyteorder(order)
    bh, bw = (tile, tile) if tile else (rows, width)
    planes = values[:, :, :, None] if apart else np.moveaxis(values, 0, 2)[None]
    bodies = []
    for plane in planes:
        for r in range(0, height, bh):
            for c in range(0, width, bw):
                part = plane[r : r + bh, c : c + bw]
                if tile:
                    part = np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1]), (0, 0)))
                raw = part.astype(kind).tobytes()
                bodies.append(zlib.compress(raw) if compression == 8 else raw)
    at = np.cumsum([8, *(len(b) for b in bodies)]).tolist()
    sample = {"u": 1, "i": 2, "f": 3}[kind.kind]
    fields = {WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [8 * kind.itemsize] * bands), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [1]), SAMPLES: ("H", [bands]), PLANES: ("H", [2 if apart else 1]), FORMAT: ("H", [sample] * bands)}
    lengths = [len(b) for b in bodies]
    fields |= {TILE_WIDTH: ("I", [tile]), TILE_HEIGHT: ("I", [tile]), TILE_AT: ("I", at[:-1]), TILE_LENGTH: ("I", lengths)} if tile else {STRIP_AT: ("I", at[:-1]), ROWS: ("I", [rows]), STRIP_LENGTH: ("I", lengths)}
    if place:
        x0, y0, x_step, y_step = place
        fields |= {PIXEL_SCALE: ("d", [x_step, -y_step, 0.0]), TIE_POINT: ("d", [0.0, 0.0, 0.0, x0, y0, 0.0])}
    if crs:
        fields[GEO_KEYS] = ("H", [1, 1, 0, 2, 1024, 0, 1, 2 if crs == 4326 else 1, 2048 if crs == 4326 else 3072, 0, 1, crs])
    entries, behind, tail = [], b"", at[-1] + 2 + 12 * len(fields) + 4
    for tag, (code, v) in sorted(fields.items()):
        raw = struct.pack(f"{order}{len(v)}{code}", *v)
        inline = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", tail + len(behind))
        behind += b"" if len(raw) <= 4 else raw + b"\0" * (len(raw) % 2)
        entries.append(struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4, "d": 12}[code], len(v)) + inline)
    start = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at[-1])
    return start + b"".join(bodies) + struct.pack(f"{order}H", len(entries)) + b"".join(entries) + struct.pack(f"{order}I", 0) + behind


def write_rasters(rows: DataFrame, folder: str, height: int, width: int, above: float | None = None, crs: int = 4326, fill: float = float("nan")) -> DataFrame:
    """One GeoTIFF for each ``name`` of pixels (name, r, c, v, x0, y0, x_step, y_step); returns (name, path).

    Doubles, with ``fill`` where there is no pixel; with ``above``, bytes that
    say whether a pixel is over it.  A raster is written by one task.  A file is
    put under its name when it is whole, so a task that runs again does no harm."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        values = np.full((height, width), fill)
        values[part["r"].to_numpy(), part["c"].to_numpy()] = part["v"].to_numpy()
        if above is not None:
            values = (values > above).astype(np.uint8)
        first = part.iloc[0]
        store, inner = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(inner, recursive=True)
        name = f"{inner}/{first['name']}.tif"
        draft = f"{name}.{np.random.default_rng().integers(1 << 62)}"
        with store.open_output_stream(draft) as f:
            f.write(encoded(values[None], tuple(float(first[c]) for c in ("x0", "y0", "x_step", "y_step")), crs))
        store.move(draft, name)
        return pd.DataFrame({"name": [first["name"]], "path": [name]})

    return rows.select("name", "r", "c", "v", "x0", "y0", "x_step", "y_step").groupBy("name").applyInPandas(one, "name string, path string")
