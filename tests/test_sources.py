"""Files are decoded as they lie in a folder, whatever they are named."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from gravure.operators import pixels as px
from gravure.registry.pixels import digest
from gravure.sources import scan

W, H = 5, 3
PIXELS = [[(x * 50, y * 100, x * y + 7) for x in range(W)] for y in range(H)]


def _bmp(top_down, bits=24):
    line = lambda row: b"".join(bytes(p[::-1]) + b"\0" * (bits // 8 - 3) for p in row)
    rows = PIXELS if top_down else PIXELS[::-1]
    body = b"".join(line(r) + b"\0" * (-len(line(r)) % 4) for r in rows)
    head = struct.pack("<IiiHHIIiiII", 40, W, -H if top_down else H, 1, bits, 0, len(body), 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + head + body


def _png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + b"".join(map(bytes, row)) for row in PIXELS)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", W, H, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _decoded(spark, folder, files):
    folder.mkdir()
    for name, content in files.items():
        (folder / name).write_bytes(content)
    rows = scan.decode_scan(spark, str(folder))
    data = b"".join(bytes(p[::-1]) for row in PIXELS for p in row)
    seen = {r.origin.rsplit("/", 1)[1]: (r.width, r.height, r.channels, bytes(r.data)) == (W, H, 3, data) for r in rows.collect()}
    whole = spark.read.format("image").option("dropInvalid", "true").load(str(folder)).select("image.origin")
    assert rows.select("origin").exceptAll(whole).isEmpty()
    return rows, seen


def test_plain_bmp_files_are_decoded_from_their_bytes(spark, tmp_path):
    rows, seen = _decoded(spark, tmp_path / "plain", {"1.bmp": _bmp(True), "a b%2.BMP": _bmp(False)})
    assert seen == {"1.bmp": True, "a%20b%252.BMP": True}
    lines = px.unpack_raster(rows.withColumn("image_id", F.lit(1).cast("long")).limit(1), lines=True)
    pixels = px.unpack_raster(rows.withColumn("image_id", F.lit(1).cast("long")).limit(1))
    assert digest(lines).collect() == digest(pixels).collect()


def test_other_files_are_decoded_too(spark, tmp_path):
    files = {"1.bmp": _bmp(True), "2.bmp": _png(), "3.png": _png(), "4.bmp": _bmp(False, 32), "5.bmp": _bmp(True)[:-9], "6.bmp": b"text", "7.png": b"", "8": _bmp(True)}
    _, seen = _decoded(spark, tmp_path / "mixed", files)
    assert {n: seen[n] for n in ("1.bmp", "2.bmp", "3.png", "4.bmp", "8")} == dict.fromkeys(("1.bmp", "2.bmp", "3.png", "4.bmp", "8"), True)
    assert not {"6.bmp", "7.png"} & set(seen)


def _read(rows):
    return sorted((r.origin, r.width, r.height, r.channels, bytes(r.data)) for r in rows.collect())


def test_a_mounted_folder_is_not_listed_by_the_driver(spark, tmp_path):
    """Plain files are listed and read by tasks: no scan of files is planned. Names and folders are those that Spark lists."""
    names = ("1.bmp", "a [b]{c}*?#&é.bmp", "_x.bmp", ".y.bmp", "_a=1.bmp", "deep/er/2.bmp", "_no/3.bmp", "4._COPYING_")
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(_bmp(True))
    rows = scan.decode_scan(spark, f"file://{tmp_path}")
    tree = rows._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in tree and "Scan image" not in tree and "BatchScan" not in tree
    whole = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(str(tmp_path))
    got = _read(rows)
    assert got == _read(whole.select("image.*").withColumnRenamed("nChannels", "channels")) and len(got) == 4
    (tmp_path / "o [d]d.bmp").write_bytes(_png())
    (tmp_path / "z{1}.png").write_bytes(_png())
    assert _read(scan.decode_scan(spark, str(tmp_path))) == _read(whole.sparkSession.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(str(tmp_path)).select("image.*").withColumnRenamed("nChannels", "channels"))


def test_many_other_files_go_to_the_image_source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "FILES_AT_ONCE", 2)
    files = {f"{k}.png": _png() for k in range(3)} | {"9.bmp": _bmp(True), "8.bmp": _bmp(False)}
    _, seen = _decoded(spark, tmp_path / "many", files)
    assert seen == dict.fromkeys(files, True)
