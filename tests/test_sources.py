"""Byte ranges of rasters, windows as a data source, map coordinates."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotile.functions import geodesy
from chronotile.sources import rasters, tiff, windows


def write_tiff(image, strip, big=False, pack=bytes, how=1, planes=False, extra=(), smaller=()):
    """A TIFF in strips; ``smaller`` images follow as overviews. ``extra`` are (tag, type, values)."""
    body, rows = b"", []
    head = 16 if big else 8
    for level, img in enumerate((image, *smaller)):
        h, w, n = img.shape
        parts = [pack(np.ascontiguousarray(img[y : y + strip, :, b]).tobytes()) for b in range(n) for y in range(0, h, strip)] if planes else [pack(img[y : y + strip].tobytes()) for y in range(0, h, strip)]
        places = []
        for part in parts:
            places.append(head + len(body))
            body += part + b"\0" * (len(part) % 2)
        tags = [(254, 4, (int(level > 0),)), (256, 4, (w,)), (257, 4, (h,)), (258, 3, (8,) * n), (259, 3, (how,)), (277, 3, (n,)), (278, 4, (strip,)), (284, 3, (2 if planes else 1,))]
        tags += [(273, 16 if big else 4, tuple(places)), (279, 4, tuple(map(len, parts)))] + (list(extra) if level == 0 else [])
        rows.append(sorted(tags))
    out, links = body, []
    for tags in rows:
        values = b""
        at = head + len(out)
        links.append(at)
        size = (8 + 20 * len(tags) + 8) if big else (2 + 12 * len(tags) + 4)
        entries = b""
        for tag, kind, vals in tags:
            raw = struct.pack(f"<{len(vals)}{ {3: 'H', 4: 'I', 12: 'd', 16: 'Q'}[kind] }", *vals)
            room = 8 if big else 4
            if len(raw) <= room:
                cell = raw.ljust(room, b"\0")
            else:
                cell = struct.pack("<Q" if big else "<I", at + size + len(values))
                values += raw
            entries += struct.pack("<HHQ" if big else "<HHI", tag, kind, len(vals)) + cell
        out += (struct.pack("<Q" if big else "<H", len(tags)) + entries, values)[0] + b"@" * (8 if big else 4) + values
    links.append(0)
    for k, at in enumerate(links[:-1]):
        n = len(rows[k])
        place = at - head + (8 + 20 * n if big else 2 + 12 * n)
        word = struct.pack("<Q" if big else "<I", links[k + 1])
        out = out[:place] + word + out[place + len(word) :]
    start = struct.pack("<2sHHHQ", b"II", 43, 8, 0, links[0]) if big else struct.pack("<2sHI", b"II", 42, links[0])
    return start + out


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("planes", [False, True])
def test_directories_planes_and_overviews(big, planes):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 255, (90, 120, 3)).astype(np.uint8)
    half, quarter = image[::2, ::2], image[::4, ::4]
    data = write_tiff(image, 8, big, zlib.compress, 8, planes, smaller=(half, quarter))
    assert len(tiff.directories(tiff.Held(data))) == 3
    reader = rasters.Reader(data)
    assert (reader.window(0, 0, 90, 120) == image).all() and (reader.window(5, 7, 30, 40) == image[5:35, 7:47]).all()
    assert (rasters.pixels(data, 60) == half).all()
    assert rasters.Reader(data, 24, 30).width == 60 and rasters.Reader(data, 23, 30).width == 30 and rasters.Reader(data, 91, 120).width == 120


def test_georeference_of_keys():
    image = np.zeros((4, 5, 1), np.uint8)
    keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, 32633)
    extra = [(33550, 12, (10.0, 10.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 500000.0, 5000000.0, 0.0)), (34735, 3, keys)]
    assert rasters.header(write_tiff(image, 4, extra=extra))[4:] == ([10.0, 0.0, 500000.0, 0.0, -10.0, 5000000.0], 32633)
    point = tuple(2 if k == 11 else v for k, v in enumerate(keys))
    assert rasters.header(write_tiff(image, 4, extra=[*extra[:2], (34735, 3, point)]))[4] == [10.0, 0.0, 499995.0, 0.0, -10.0, 5000005.0]
    own = (*keys[:-1], 32767)
    assert rasters.header(write_tiff(image, 4, extra=[*extra[:2], (34735, 3, own)]))[5] is None
    matrix = (2.0, 0.5, 0, 7.0, 0.25, -2.0, 0, 9.0, 0, 0, 0, 0, 0, 0, 0, 1)
    degrees = (1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326)
    assert rasters.header(write_tiff(image, 4, True, extra=[(34264, 12, matrix), (34735, 3, degrees)]))[4:] == ([2.0, 0.5, 7.0, 0.25, -2.0, 9.0], 4326)


def _png(image, colour=2, palette=b"", orientation=None):
    def part(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = image.shape[:2]
    raw = b"".join(b"\0" + line.tobytes() for line in image)
    exif = part(b"eXIf", b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 274, 3, 1, orientation, 0, 0)) if orientation else b""
    return rasters.PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + exif + (part(b"PLTE", palette) if palette else b"") + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_png_palette_and_turns():
    index = np.array([[0, 1, 2], [2, 1, 0]], np.uint8)
    colours = np.array([[9, 8, 7], [1, 2, 3], [200, 100, 0]], np.uint8)
    assert (rasters.pixels(_png(index, 3, colours.tobytes())) == colours[index]).all()
    image = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    want = {1: image, 2: image[:, ::-1], 3: image[::-1, ::-1], 4: image[::-1], 5: image.swapaxes(0, 1), 6: np.rot90(image, -1), 7: np.rot90(image, 2).swapaxes(0, 1), 8: np.rot90(image)}
    for k, turned in want.items():
        assert (rasters.pixels(_png(image, orientation=k)) == turned).all(), k


def sparse_tiff(path, h, w, strip, filled):
    """A BigTIFF of h by w RGB pixels whose strips are holes of the file but for ``filled`` {index: byte}."""
    n, line = -(-h // strip), w * 3
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8), (259, 3, 1, 1), (277, 3, 1, 3), (278, 4, 1, strip)]
    directory = 16 + 8 + 20 * (len(tags) + 2) + 8
    first = directory + 16 * n
    tags += [(273, 16, n, directory), (279, 16, n, directory + 8 * n)]
    with open(path, "wb") as file:
        file.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(tags)))
        for tag, kind, count, value in sorted(tags):
            file.write(struct.pack("<HHQQ", tag, kind, count, value))
        file.write(struct.pack("<Q", 0))
        sizes = [min(strip, h - k * strip) * line for k in range(n)]
        file.write(np.cumsum([first, *sizes[:-1]]).astype("<u8").tobytes() + np.array(sizes, "<u8").tobytes())
        for k, value in filled.items():
            file.seek(first + k * strip * line)
            file.write(bytes([value]) * sizes[k])
        file.truncate(first + sum(sizes))


def test_large_pair_is_read_by_ranges(spark, tmp_path):
    """More than 4 GB: planned into many partitions, and a part of it read without touching the rest."""
    h, w, strip = 40_000, 36_000, 8
    for name, value in (("a.tif", 40), ("b.tif", 90)):
        sparse_tiff(tmp_path / name, h, w, strip, {2500: value})
    assert (tmp_path / "a.tif").stat().st_size > 4 * 2**30
    a, b = str(tmp_path / "a.tif"), f"file:{tmp_path}/b.tif"
    whole = windows.pair_windows(spark, a, b, size=2048)
    assert whole.rdd.getNumPartitions() >= 8
    area = (20_000, 5_000, 20_007, 5_600)
    some = windows.pair_windows(spark, a, b, 7, 256, 0.25, area)
    rows = some.collect()
    wanted = [(y, x) for y in windows.starts(h, 256, 0.25) for x in windows.starts(w, 256, 0.25) if y <= 20_007 and y + 256 > 20_000 and x <= 5_600 and x + 256 > 5_000]
    assert sorted((r.y0, r.x0) for r in rows) == wanted and {r.pair_id for r in rows} == {7}
    for r in rows:
        before, after = (np.frombuffer(v, np.uint8).reshape(256, 256, 3) for v in (r.before, r.after))
        line = slice(20_000 - r.y0, 20_008 - r.y0)
        assert (before[line] == 40).all() and (after[line] == 90).all() and before.sum() == before[line].sum()
    seen = []
    run = windows.planned(h, w, 256, 0.25, area)[0]
    list(windows.read_run(1, a, b, run, lambda path: seen.append(tiff.Ranges(path)) or seen[-1]))
    lines = -(-(run[0][2] + strip) // strip) * strip
    assert all(r.fetched < lines * w * 3 * 1.05 + 400_000 for r in seen) and sum(r.fetched for r in seen) < 0.02 * 2 * h * w * 3


def test_windows_equal_those_of_whole_files(spark, tmp_path):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 255, (300, 420, 3)).astype(np.uint8), rng.integers(0, 255, (150, 210, 3)).astype(np.uint8)
    files = {"a.tif": write_tiff(a, 16, True, zlib.compress, 8), "b.tif": write_tiff(b, 9, planes=True), "junk.tif": b"junk"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    path = {name: str(tmp_path / name) for name in files}
    given = [(1, "a.tif", "b.tif"), (2, "junk.tif", "a.tif"), (3, "a.tif", "a.tif"), (None, "a.tif", "a.tif")]
    held = spark.createDataFrame([(p, bytearray(files[x]), bytearray(files[y])) for p, x, y in given[:3]], "pair_id long, before binary, after binary")
    want = sorted(map(tuple, rasters.window_pairs(held, 64, 0.25).collect()), key=str)
    pairs = spark.createDataFrame([(p, path[x], path[y]) for p, x, y in given] + [(4, None, path["a.tif"])], "pair_id long, before string, after string")
    rows = windows.window_rows(pairs, 64, 0.25, run=3)
    got = rows.collect()
    assert sorted((tuple(r) for r in got if r.pair_id in (1, 2, 3)), key=str) == want
    assert len([r for r in got if r.pair_id is None]) == len([r for r in got if r.pair_id == 3])
    assert [r.error for r in got if r.pair_id == 4] == ["no path"]
    assert rows.where("pair_id = 1").select(F.spark_partition_id().alias("p")).distinct().count() == 4
    single = windows.pair_windows(spark, path["a.tif"], path["b.tif"], 1, 64)
    assert sorted((tuple(r) for r in single.collect()), key=str) == [r for r in want if r[0] == 1]
    assert [r.error is None for r in windows.pair_windows(spark, path["junk.tif"], path["a.tif"]).collect()] == [False]
    assert windows.window_rows(pairs.limit(0)).count() == 0


def to_utm(lng, lat, zone, south):
    """The forward direction, from coefficients of its own: geodetic to conformal latitude exactly, then the series of the other way."""
    f = 1 / 298.257223563
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    phi, lam = math.radians(lat), math.radians(lng - (6 * zone - 183))
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.asinh(math.sin(lam) / math.hypot(t, math.cos(lam)))
    x = eta + sum(a * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, a in enumerate(alpha, 1))
    y = xi + sum(a * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, a in enumerate(alpha, 1))
    scale = 0.9996 * 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    return 500000 + scale * x, scale * y + (10_000_000 if south else 0)


def test_map_coordinates(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        zone, lat = int(rng.integers(1, 61)), float(rng.uniform(-80, 84))
        lng = 6 * zone - 183 + float(rng.uniform(-4, 4))
        rows.append((k, *to_utm(lng, lat, zone, lat < 0), (32700 if lat < 0 else 32600) + zone, lng, lat))
    rows += [(400, 6378137 * math.radians(12.5), 6378137 * math.asinh(math.tan(math.radians(48.25))), 3857, 12.5, 48.25), (401, 7.5, 8.5, None, 7.5, 8.5), (402, 1.0, 2.0, 4326, 1.0, 2.0)]
    df = spark.createDataFrame([*rows, (403, 1.0, 2.0, 2056, None, None)], "k int, x double, y double, epsg int, lng double, lat double")
    for r in df.withColumn("at", geodesy.lng_lat(F.col("x"), F.col("y"), F.col("epsg"))).collect():
        assert r.at is None if r.lng is None else abs(r.at.lng - r.lng) < 1e-7 and abs(r.at.lat - r.lat) < 1e-7


def test_meridian_length():
    """On its meridian a zone measures the length of the meridian, here summed up in small steps."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    phi = np.radians((np.arange(100_000) + 0.5) * 50 / 100_000)
    length = (a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5).sum() * math.radians(50) / 100_000
    assert abs(to_utm(9.0, 50.0, 32, False)[1] - 0.9996 * length) < 1e-3


def test_bounds_follow_curved_edges(spark):
    df = spark.createDataFrame([(32633, 10)], "epsg int, px int")
    t = F.array(*(F.lit(float(v)) for v in (1000, 0, 300000, 0, -1000, 8000000)))
    b = df.select(geodesy.bounds(t, F.lit(400), F.lit(300), F.col("epsg")).alias("b")).first().b
    corners = df.select(F.explode(F.array(*(geodesy.lng_lat(F.lit(x), F.lit(y), F.col("epsg")) for x in (3e5, 7e5) for y in (7.7e6, 8e6)))).alias("p")).select("p.*").collect()
    assert b.north > max(p.lat for p in corners) + 0.05 and b.west == pytest.approx(min(p.lng for p in corners), abs=1e-9)


def test_inspected_bounds_and_sidecars(spark, tmp_path):
    image = np.zeros((300, 400, 1), np.uint8)
    keys = (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32633)
    extra = [(33550, 12, (10.0, 10.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 498000.0, 5001500.0, 0.0)), (34735, 3, keys)]
    (tmp_path / "own.tif").write_bytes(write_tiff(image, 64, extra=extra))
    for name in ("world.tif", "zone.tif", "both.tif", "none.tif", "lambert.tif", "after.tif"):
        (tmp_path / name).write_bytes(write_tiff(image, 64))
    lines = "10\n0\n0\n-10\n498005\n5001495\n"
    texts = {"zone.tfw": lines, "zone.prj": 'PROJCS["WGS_1984_UTM_Zone_33N",GEOGCS["GCS_WGS_1984"]]', "world.wld": "0.001\n0\n0\n-0.001\n8.0005\n49.9995\n", "lambert.tfw": lines}
    texts |= {"lambert.prj": 'PROJCS["France_Lambert"]', "both.wld": "9\n0\n0\n-9\n0\n0", "both.tfw": "0.5\n0\n0\n-0.5\n10.25\n49.75", "own.tfw": "9\n0\n0\n-9\n0\n0", "none.tfw": "1 2 3"}
    texts |= {"after.tif.wld": "0.5\n0\n0\n-0.5\n10.25\n49.75", "both.prj": "junk"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    sidecars = spark.read.text(str(tmp_path), wholetext=True, pathGlobFilter="*.{tfw,wld,prj}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    files = rasters.inspected(rasters.files(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")))
    sidecars = sidecars.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    got = {r.path.rsplit("/", 1)[1]: r for r in rasters.georeferenced(files, sidecars).collect()}
    assert {k: (v.source, v.epsg) for k, v in got.items()} == {
        "own.tif": ("embedded", 32633), "world.tif": ("worldfile", 4326), "zone.tif": ("worldfile", 32633), "both.tif": ("worldfile", 4326),
        "none.tif": ("none", None), "lambert.tif": ("none", None), "after.tif": ("worldfile", 4326),
    }
    assert got["own.tif"].bounds == got["zone.tif"].bounds and got["own.tif"].transform == got["zone.tif"].transform
    assert got["own.tif"].bounds.west < 15 < got["own.tif"].bounds.east and 45.1 < got["own.tif"].bounds.south < 45.2
    assert [round(v, 6) for v in got["world.tif"].bounds] == [8.0, 49.7, 8.4, 50.0] and got["both.tif"].transform == [0.5, 0.0, 10.0, 0.0, -0.5, 50.0]
    assert json.dumps(got["none.tif"].bounds) == "null"
