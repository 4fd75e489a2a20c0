"""Binary files as DataFrames, from columns of bytes, and back: PNG tiles, GeoTIFF rasters, LAS point clouds, zipped KML.

Readers take rows of (keys, content), one file a row, as `binaryFile` gives them; rows of a file leave in bounded batches. Files that are
none of the kind raise an error, except where a function says otherwise.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points of a cloud that leave a file at once.
CHUNK = 1_000_000
#: Points of a cloud that are one file, and in one task, when clouds are written.
FILE_POINTS = 250_000
_PNG = b"\x89PNG\r\n\x1a\n"


def scan(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, content) of the files below a folder whose names fit a pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def scan_tiles(spark: SparkSession, folder: str, suffix: str = "png") -> DataFrame:
    """(z, x, y, content) of tile files {z}/{x}/{y}.png below a folder; others are left out."""
    at = rf"(\d+)/(\d+)/(\d+)\.{suffix}$"
    files = scan(spark, folder, f"*.{suffix}").filter(F.col("path").rlike(at))
    return files.select(*[F.regexp_extract("path", at, i).cast("long").alias(n) for i, n in ((1, "z"), (2, "x"), (3, "y"))], "content")


# PNG: eight bits a channel, grey, RGB or RGBA, not interlaced.


def encode_png(pixels: np.ndarray) -> bytes:
    """An array of rows, columns and four channels as a file."""
    h, w, _ = pixels.shape
    raw = np.zeros((h, 1 + w * 4), np.uint8)
    raw[:, 1:] = pixels.reshape(h, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Rows, columns and four channels of a file; what has no alpha is opaque."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("only eight-bit grey, RGB and RGBA files that aren't interlaced are read")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * channels)
    out, above = np.zeros((h, w, channels), np.uint8), np.zeros((w, channels), np.uint8)
    for r in range(h):
        line, how = raw[r, 1:].reshape(w, channels), raw[r, 0]
        if how == 1:
            line = np.cumsum(line, axis=0, dtype=np.uint8)
        elif how == 2:
            line = line + above
        elif how in (3, 4):
            line = _left_and_above(line, above, how)
        elif how:
            raise ValueError(f"filter {how}")
        out[r] = above = line
    if channels < 3:
        out = np.concatenate([np.repeat(out[:, :, :1], 3, axis=2), out[:, :, 1:]], axis=2)
    return out if out.shape[2] == 4 else np.concatenate([out, np.full((h, w, 1), 255, np.uint8)], axis=2)


def _left_and_above(line: np.ndarray, above: np.ndarray, how: int) -> np.ndarray:
    """Undoes the filters that look at the pixel to the left: the mean with the one above, or the closest of three."""
    out, left, corner = np.zeros_like(line), np.zeros(line.shape[1], np.int64), np.zeros(line.shape[1], np.int64)
    for x in range(len(line)):
        up = above[x].astype(np.int64)
        if how == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[x] = (line[x] + guess) % 256
        left, corner = out[x].astype(np.int64), up
    return out


def write_png(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): a file of each group of pixels (row, col, r, g, b, a), clear where there is none."""

    def work(table: pa.Table) -> pa.Table:
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        image = np.zeros((int(row.max()) + 1, int(col.max()) + 1, 4), np.uint8)
        for k, c in enumerate("rgba"):
            image[row, col, k] = table[c].to_numpy()
        return pa.table({**{k: table[k][:1] for k in keys}, "content": [encode_png(image)]})

    own = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys)
    return pixels.groupBy(*keys).applyInArrow(work, f"{own}, content binary")


def _unpacked(files: DataFrame, keys: list[str], columns: dict[str, pa.DataType], spark_types: str, read) -> DataFrame:
    """Rows of every file: `read` gives batches of columns from its bytes; the file's keys stand beside them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                for part in read(batch.column("content")[i].as_py()):
                    n = len(next(iter(part.values())))
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(k)[i], n) for k in keys] + [pa.array(part[c], t) for c, t in columns.items()], names=[*keys, *columns])

    own = "".join(f"`{k}` {files.schema[k].dataType.simpleString()}, " for k in keys)
    return files.select(*keys, "content").mapInArrow(work, own + spark_types)


def read_png(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, r, g, b, a) of every pixel of tiles."""

    def read(data: bytes):
        image = decode_png(data)
        row, col = np.indices(image.shape[:2])
        yield {"row": row.ravel(), "col": col.ravel(), **{c: image[:, :, k].ravel().astype(np.int32) for k, c in enumerate("rgba")}}

    return _unpacked(files, keys, {"row": pa.int32(), "col": pa.int32(), **dict.fromkeys("rgba", pa.int32())}, "row int, col int, r int, g int, b int, a int", read)


# GeoTIFF: one band of heights, with an alpha band or a no-data value at most; plain or deflated strips or tiles.

_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q", 6: "b", 8: "h", 9: "i"}
_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def tiff_tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of a file's first directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        code = _SIZES.get(kind)
        if code is None:
            continue
        size = struct.calcsize("<" + code) * n
        place = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        part = data[place : place + size]
        tags[tag] = (part.rstrip(b"\0").decode("latin-1"),) if code == "s" else struct.unpack(f"{order}{n}{code}" if len(code) == 1 else order + code * n, part)
    return order, tags


def tiff_descriptor(data: bytes) -> dict:
    """Size, bounds, pixel sides, coordinate system and no-data value; files without a place on Earth and pictures are refused."""
    _, t = tiff_tags(data)
    if 33550 not in t or 33922 not in t:
        raise ValueError("the raster has no georeference")
    samples, extra = t.get(277, (1,))[0], t.get(338, ())
    if samples - len(extra) != 1 or any(x not in (1, 2) for x in extra):
        raise ValueError("only one band of heights, with an alpha band at most, is read")
    w, h, (sx, sy, *_), tie = t[256][0], t[257][0], t[33550], t[33922]
    x0, y0 = tie[3] - tie[0] * sx, tie[4] + tie[1] * sy
    keys = t.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    nodata = t.get(42113, ("",))[0].strip()
    return {"width": w, "height": h, "min_x": x0, "max_y": y0, "max_x": x0 + w * sx, "min_y": y0 - h * sy, "pixel_x": sx, "pixel_y": sy, "epsg": codes.get(3072, codes.get(2048)), "nodata": float(nodata) if nodata else None}


def decode_tiff(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Heights and which of them are valid: finite, not no-data, not clear."""
    order, t = tiff_tags(data)
    w, h, samples = t[256][0], t[257][0], t.get(277, (1,))[0]
    kind = np.dtype(order + _KINDS[t.get(339, (1,))[0], t[258][0]])
    tiled = 324 in t
    bw, bh = (t[322][0], t[323][0]) if tiled else (w, t.get(278, (h,))[0])
    out = np.zeros((-(-h // bh) * bh, -(-w // bw) * bw, samples), kind.newbyteorder("="))
    across = -(-w // bw)
    for k, (offset, size) in enumerate(zip(t[324 if tiled else 273], t[325 if tiled else 279], strict=True)):
        part = data[offset : offset + size]
        if (how := t.get(259, (1,))[0]) in (8, 32946):
            part = zlib.decompress(part)
        elif how != 1:
            raise ValueError(f"compression {how}")
        block = np.frombuffer(part, kind)
        block = block[: len(block) // (bw * samples) * bw * samples].reshape(-1, bw, samples)
        r, c = k // across * bh, k % across * bw
        out[r : r + len(block), c : c + bw] = block
    out = out[:h, :w]
    z = out[:, :, 0].astype(np.float64)
    good, nodata = np.isfinite(z), tiff_descriptor(data)["nodata"]
    if nodata is not None:
        good &= ~np.isclose(z, nodata)
    if samples > 1:
        alpha = out[:, :, 1].astype(np.float64)
        good &= np.isfinite(alpha) & (alpha > 0)
    return z, good


def encode_tiff(z: np.ndarray, min_x: float, max_y: float, pixel: float, epsg: int = 3857, nodata: float | None = None) -> bytes:
    """Heights as a file of one deflated strip of 32-bit numbers."""
    body = zlib.compress(z.astype("<f4").tobytes(), 6)
    texts = {42113: f"{nodata}".encode() + b"\0"} if nodata is not None else {}
    doubles = {33550: (pixel, pixel, 0.0), 33922: (0.0, 0.0, 0.0, min_x, max_y, 0.0)}
    shorts = {258: (32,), 259: (8,), 262: (1,), 277: (1,), 339: (3,), 34735: (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg)}
    longs = {256: (z.shape[1],), 257: (z.shape[0],), 273: (0,), 278: (z.shape[0],), 279: (len(body),)}
    tags = sorted([(k, 2, len(v), v) for k, v in texts.items()] + [(k, 12, len(v), struct.pack(f"<{len(v)}d", *v)) for k, v in doubles.items()] + [(k, 3, len(v), struct.pack(f"<{len(v)}H", *v)) for k, v in shorts.items()] + [(k, 4, len(v), struct.pack(f"<{len(v)}I", *v)) for k, v in longs.items()])
    after = 8 + 2 + 12 * len(tags) + 4
    more = b""
    entries = []
    strip = after + sum(len(v) for *_, v in tags if len(v) > 4)
    for k, kind, n, v in tags:
        v = struct.pack("<I", strip) if k == 273 else v
        entries.append(struct.pack("<HHI", k, kind, n) + (v.ljust(4, b"\0") if len(v) <= 4 else struct.pack("<I", after + len(more))))
        more += v if len(v) > 4 else b""
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(entries) + b"\0\0\0\0" + more + body


def write_tiff(raster: DataFrame, keys: list[str], min_x: str, max_y: str, pixel: float, nodata: float = -9999.0) -> DataFrame:
    """(keys, content): a file of each group of samples (row, col, z), with the no-data value where there is none."""

    def work(table: pa.Table) -> pa.Table:
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        z = np.full((int(row.max()) + 1, int(col.max()) + 1), nodata)
        z[row, col] = table["z"].to_numpy()
        z[np.isnan(z)] = nodata
        return pa.table({**{k: table[k][:1] for k in keys}, "content": [encode_tiff(z, table[min_x][0].as_py(), table[max_y][0].as_py(), pixel, nodata=nodata)]})

    own = ", ".join(f"`{k}` {raster.schema[k].dataType.simpleString()}" for k in keys)
    return raster.groupBy(*keys).applyInArrow(work, f"{own}, content binary")


def read_tiff(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, z, valid) of every sample of rasters."""

    def read(data: bytes):
        z, good = decode_tiff(data)
        row, col = np.indices(z.shape)
        for k in range(0, z.size, CHUNK):
            part = slice(k, k + CHUNK)
            yield {"row": row.ravel()[part], "col": col.ravel()[part], "z": z.ravel()[part], "valid": good.ravel()[part]}

    return _unpacked(files, keys, {"row": pa.int32(), "col": pa.int32(), "z": pa.float64(), "valid": pa.bool_()}, "row int, col int, z double, valid boolean", read)


def describe_tiff(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, width, height, bounds, pixel sides, epsg, nodata, id): a row a raster, from its tags alone; id is a digest of the file."""
    numbers = ("min_x", "max_y", "max_x", "min_y", "pixel_x", "pixel_y")
    columns = {"width": pa.int32(), "height": pa.int32(), **dict.fromkeys(numbers, pa.float64()), "epsg": pa.int32(), "nodata": pa.float64()}
    types = "width int, height int, " + "".join(f"{n} double, " for n in numbers) + "epsg int, nodata double"
    found = _unpacked(files, keys, columns, types, lambda data: [{k: [v] for k, v in tiff_descriptor(data).items()}])
    return found.join(files.select(*keys, F.sha2("content", 256).alias("id")), keys)


# LAS: versions 1.0 to 1.4, not compressed.


def las_header(data: bytes) -> dict:
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    head, start, records = struct.unpack("<HII", data[94:104])
    kind, size, count = struct.unpack("<BHI", data[104:111])
    scale, offset = struct.unpack("<3d", data[131:155]), struct.unpack("<3d", data[155:179])
    if (major, minor) >= (1, 4) and head >= 255:
        count = struct.unpack("<Q", data[247:255])[0] or count
    crs, at = None, head
    for _ in range(records):
        _, _, number, length, _ = struct.unpack("<H16sHH32s", data[at : at + 54])
        part = data[at + 54 : at + 54 + length]
        if number == 2112:
            crs = part.rstrip(b"\0").decode("utf-8", "replace")
        elif number == 34735 and crs is None:
            keys = struct.unpack(f"<{length // 2}H", part)
            codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
            code = codes.get(3072, codes.get(2048))
            crs = f"EPSG:{code}" if code else None
        at += 54 + length
    return {"start": start, "kind": kind & 0x3F, "size": size, "count": count, "scale": scale, "offset": offset, "crs": crs}


def encode_las(x: np.ndarray, y: np.ndarray, z: np.ndarray, classes: np.ndarray, scale: float = 0.01, epsg: int = 32632) -> bytes:
    """Points of kind 0 with a class."""
    keys = struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, epsg)
    record = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34735, len(keys), b"") + keys
    body = np.zeros(len(x), np.dtype([("xyz", "<i4", 3), ("intensity", "<u2"), ("flags", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]))
    body["xyz"] = np.rint(np.stack([x, y, z], axis=1) / scale)
    body["class"] = classes
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes((1, 2))
    head[94:111] = struct.pack("<HIIBHI", 227, 227 + len(record), 1, 0, body.itemsize, len(x))
    head[131:179] = struct.pack("<6d", *(scale,) * 3, 0.0, 0.0, 0.0)
    return bytes(head) + record + body.tobytes()


def write_las(points: DataFrame, keys: list[str], most: int = FILE_POINTS) -> DataFrame:
    """(keys, part, content): files of each group of points (x, y, z, class), one up to `most` points, else as many of about that size as it takes.

    Points of a large group are dealt over its parts by chance, so a task holds one part. The groups of more than `most` points are at
    most the points over `most`; their table of parts is what is broadcast.
    """
    large = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    large = large.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.ceil(F.col("__n") / most).alias("__parts"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    part = F.coalesce(F.floor(F.rand(7) * F.col("__parts")), F.lit(0)).cast("int")
    points = points.join(F.broadcast(large), same, "left").select(*keys, "x", "y", "z", "class", part.alias("part"))

    def work(table: pa.Table) -> pa.Table:
        return pa.table({**{k: table[k][:1] for k in (*keys, "part")}, "content": [encode_las(*(table[c].to_numpy() for c in ("x", "y", "z", "class")))]})

    own = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in (*keys, "part"))
    return points.groupBy(*keys, "part").applyInArrow(work, f"{own}, content binary")


def read_las(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, z, class) of every point of clouds, a million at once."""

    def read(data: bytes):
        h = las_header(data)
        rows = np.frombuffer(data, np.uint8, h["count"] * h["size"], h["start"]).reshape(h["count"], h["size"])
        for k in range(0, h["count"], CHUNK):
            part = np.ascontiguousarray(rows[k : k + CHUNK])
            xyz = part[:, :12].copy().view("<i4") * np.array(h["scale"]) + np.array(h["offset"])
            kind = part[:, 15] & 0x1F if h["kind"] < 6 else part[:, 16]
            yield {"x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "class": kind.astype(np.int32)}

    return _unpacked(files, keys, {**dict.fromkeys("xyz", pa.float64()), "class": pa.int32()}, "x double, y double, z double, class int", read)


def las_crs(files: DataFrame) -> str | None:
    """The coordinate system of all clouds; different ones raise an error. Only headers are looked at, and two systems at most returned."""
    found = _unpacked(files.select("content"), [], {"crs": pa.string()}, "crs string", lambda data: [{"crs": [las_header(data)["crs"]]}])
    systems = [r["crs"] for r in found.distinct().limit(2).collect()]
    if len(systems) > 1:
        raise ValueError(f"point clouds in different coordinate systems: {systems}")
    return systems[0] if systems else None


# KMZ: a zip file with a KML file in it.


def write_kmz(texts: DataFrame, keys: list[str]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                f = io.BytesIO()
                with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("doc.kml", text or "")
                out.append(f.getvalue())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.binary())], names=[*keys, "content"])

    own = "".join(f"`{k}` {texts.schema[k].dataType.simpleString()}, " for k in keys)
    return texts.select(*keys, "text").mapInArrow(work, own + "content binary")


def read_kmz(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the first KML file of each archive; archives without one raise an error."""

    def read(data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            name = next((n for n in z.namelist() if n.lower().endswith(".kml")), None)
            if name is None:
                raise ValueError("the archive holds no KML file")
            yield {"text": [z.read(name).decode("utf-8", "replace")]}

    return _unpacked(files, keys, {"text": pa.string()}, "text string", read)
