import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotile.operators import catalog, masks, methods, pixels, regions, registration, review, rules, signals, tiling
from chronotile.sources import rasters
from chronotile.streaming import events

PIXEL = "pair_id long, y int, x int, r1 int, g1 int, b1 int, r2 int, g2 int, b2 int"


def scene(spark, before, after, pair=0):
    h, w, _ = before.shape
    data = [(pair, y, x, *map(int, before[y, x]), *map(int, after[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(data, PIXEL)


def test_components_match_flood_fill(spark):
    rng = np.random.default_rng(2)
    grid = rng.random((3, 30, 40)) < 0.4
    on = spark.createDataFrame([(p, y, x) for p, y, x in np.argwhere(grid).tolist()], "pair_id long, y int, x int")
    got = {}
    for r in masks.components(on).collect():
        got.setdefault((r.pair_id, r.label), set()).add((r.y, r.x))
    want = set()
    for p in range(3):
        left = {tuple(v) for v in np.argwhere(grid[p]).tolist()}
        while left:
            todo, part = [left.pop()], set()
            while todo:
                y, x = todo.pop()
                part.add((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                todo += near
            want.add((p, frozenset(part)))
    assert {(p, frozenset(s)) for (p, _), s in got.items()} == want


@pytest.mark.parametrize("tile", [7, 512])
def test_components_join_across_tiles(spark, tile):
    rng = np.random.default_rng(4)
    grid = rng.random((2, 40, 50)) < 0.45
    grid[1] = False
    grid[1, 3, :], grid[1, :, 9] = True, True
    on = spark.createDataFrame([(p, y, x) for p, y, x in np.argwhere(grid).tolist()], "pair_id long, y int, x int").coalesce(2)
    rows = masks.components(on, tile).collect()
    label = {(r.pair_id, r.y, r.x): r.label for r in rows}
    assert len(rows) == len(label) == grid.sum()
    for p, y, x in label:
        for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
            if (p, y + dy, x + dx) in label:
                assert label[p, y, x] == label[p, y + dy, x + dx]
    whole = {(r.pair_id, r.y, r.x): r.label for r in masks.components(on, 1000).collect()}
    assert len({(k[0], v) for k, v in label.items()}) == len({(k[0], v) for k, v in whole.items()})


def test_shift_over_tiles(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 255, (48, 64))
    b = np.roll(a, (-2, 3), (0, 1))
    g = spark.createDataFrame([(7, y, x, int(a[y, x]), int(b[y, x])) for y in range(48) for x in range(64)], "pair_id long, y int, x int, g1 int, g2 int")
    assert [(r.pair_id, r.dy, r.dx) for r in registration.shifts(g, 24).collect()] == [(7, -2, 3)]


def test_matches_over_the_whole_pair(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(30, 4)), rng.normal(size=(25, 4))
    table = lambda m: spark.createDataFrame([(1, k, v.tolist()) for k, v in enumerate(m)], "pair_id long, id long, v array<double>")
    got = {(r.id, r.other) for r in registration.ratio_matches(table(a), table(b), 0.8, part=8).collect()}
    d = np.sqrt(((a[:, None] - b) ** 2).sum(-1))
    order = np.sort(d, 1)
    assert got == {(k, int(d[k].argmin())) for k in range(30) if order[k, 0] < 0.8 * order[k, 1]} and got


def test_clusters_of_a_pair_do_not_depend_on_others(spark):
    rng = np.random.default_rng(7)
    one, two = rng.integers(40, 60, (12, 12, 3)), rng.integers(0, 255, (12, 12, 3))
    one[3:7, 4:9] = (50, 50, 50)
    changed = one.copy()
    changed[3:7, 4:9] = (220, 30, 200)
    alone = methods.feature_mask(scene(spark, one, changed, 1))
    both = methods.feature_mask(scene(spark, one, changed, 1).union(scene(spark, two, two[::-1], 2)))
    on = lambda df: {(r.y, r.x) for r in df.filter("pair_id = 1 and on = 1").collect()}
    assert on(alone) == on(both) == {(y, x) for y in range(3, 7) for x in range(4, 9)}


def test_identical_images_show_no_change(spark):
    image = np.random.default_rng(42).integers(0, 255, (16, 16, 3))
    df = scene(spark, image, image)
    assert df.transform(signals.change_vectors).agg(F.max("cva")).first()[0] == 0
    assert signals.structural_change(df).agg(F.max("dssim")).first()[0] < 1e-9
    assert signals.classical_score(df).agg(F.max("score")).first()[0] < 1e-6


def test_inserted_block_is_found(spark):
    before = np.random.default_rng(1).integers(40, 60, (24, 24, 3))
    after = before.copy()
    after[8:16, 8:16] = (205, 60, 190)
    score = signals.classical_score(scene(spark, before, after))
    mask = masks.core_mask(score, border=0, least=4)
    rows = mask.filter("on = 1").collect()
    inside = sum(7 <= r.y <= 16 and 7 <= r.x <= 16 for r in rows)
    assert rows and inside >= 0.9 * len(rows)


def test_known_shift(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 255, (32, 32))
    b = np.roll(a, (3, -2), (0, 1))
    g = spark.createDataFrame([(0, y, x, int(a[y, x]), int(b[y, x])) for y in range(32) for x in range(32)], "pair_id long, y int, x int, g1 int, g2 int")
    moves = registration.shifts(g)
    assert [(r.dy, r.dx) for r in moves.collect()] == [(3, -2)]
    back = registration.shifted_back(g, moves)
    assert back.filter("g1 <> g2").count() == 0 and back.count() == 29 * 30


def test_greedy_suppression(spark):
    rng = random.Random(3)
    data = [(r, k, rng.randrange(100, 900), rng.randrange(60), rng.randrange(60), rng.randrange(5, 40), rng.randrange(5, 40)) for r in range(40) for k in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(data, "run_id long, region_id int, area long, x int, y int, w int, h int")
    got = {(r.run_id, r.region_id) for r in regions.suppress_overlaps(df, 0.3).collect()}

    def iou(a, b):
        w = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        h = max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
        return w * h / (a[5] * a[6] + b[5] * b[6] - w * h)

    want = set()
    for run in range(40):
        kept = []
        for row in sorted((d for d in data if d[0] == run), key=lambda d: (-d[2], d[1])):
            if all(iou(row, k) <= 0.3 for k in kept):
                kept.append(row)
        want |= {(d[0], d[1]) for d in kept}
    assert got == want


def test_rule_ties_go_to_the_first_class(spark):
    row = spark.range(1).select(rules.best([("a", F.lit(0.3)), ("b", F.lit(0.5)), ("c", F.lit(0.5))], 0.28, "none").alias("x")).first().x
    assert (row.name, row.score) == ("b", 0.5)
    row = spark.range(1).select(rules.best([("a", F.lit(0.1))], 0.28, "none", 0.3).alias("x")).first().x
    assert (row.name, row.score) == ("none", 0.3)


def test_perfect_and_empty_measures(spark):
    counts = spark.createDataFrame([(0, 0, 0, 9), (5, 0, 0, 4), (0, 3, 2, 1)], "tp long, fp long, fn long, tn long")
    got = [(r.iou, r.dice, r.f1, r.precision, r.recall) for r in review.measures(counts).collect()]
    assert got == [(1.0,) * 5, (1.0,) * 5, (0.0,) * 5]


def test_constant_scores_blend_to_a_constant(spark):
    cells = spark.createDataFrame([(0, y, x, y0, x0, 0.7) for y0 in (0, 4, 8) for x0 in (0, 4, 8) for y in range(y0, y0 + 8) for x in range(x0, x0 + 8)], "pair_id long, y int, x int, y0 int, x0 int, score double")
    out = {(r.y, r.x): r.score for r in tiling.blended(cells, 8, 3).collect()}
    assert all(v == pytest.approx(0.7) for (y, x), v in out.items() if 0 < y < 15 and 0 < x < 15)
    assert out[0, 0] == 0


def test_failed_passes_are_left_out():
    calls = []

    def fails_once(a, b):
        calls.append(1)
        if len(calls) == 2:
            raise ValueError
        return np.ones(a.shape[:3])

    one = np.zeros((1, 2, 2, 3), np.uint8)
    assert (tiling.averaged(fails_once, "full")(one, one) == 1).all() and len(calls) == 3


def test_blur_keeps_constants_and_mirrors(spark):
    df = spark.createDataFrame([(0, y, x, float(y == 0)) for y in range(5) for x in range(5)], "pair_id long, y int, x int, v double")
    out = {(r.y, r.x): r.v for r in pixels.blur(df, ["v"], pixels.gaussian(3)).collect()}
    assert out[0, 2] == pytest.approx(0.5) and out[1, 2] == pytest.approx(0.25) and out[2, 2] == 0


def _png(image):
    h, w, n = image.shape
    raw = b"".join(bytes([1]) + np.concatenate([row[0], np.diff(row.astype(int), axis=0).ravel() % 256]).astype(np.uint8).tobytes() for row in image)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[n], 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def _tiff(image):
    h, w, n = image.shape
    tags = [(256, 4, 1, w), (257, 4, 1, h), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, n), (279, 4, 1, image.size)]
    at = 8 + image.size + image.size % 2
    geo = at + 2 + 12 * (len(tags) + 2) + 4
    tags += [(33550, 12, 3, geo), (33922, 12, 6, geo + 24)]
    body = b"".join(struct.pack("<HHII", *t) for t in tags)
    return b"II*\0" + struct.pack("<I", at) + image.tobytes() + b"\0" * (image.size % 2) + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0) + struct.pack("<9d", 0.5, 0.25, 0, 0, 0, 0, 70, 28, 0)


def test_corners():
    image = np.zeros((60, 60))
    for y, x in ((10, 10), (10, 40), (40, 25)):
        image[y : y + 8, x : x + 8] = 200
    assert regions.strong_corners(image) == 12
    assert regions.strong_corners(np.full((20, 20), 7.0)) == 0 and regions.strong_corners(image[:4]) == 0


def test_rasters(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 255, (4, 5, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(_png(image))
    (tmp_path / "b.TIF").write_bytes(_tiff(image))
    (tmp_path / "c.tif").write_bytes(b"junk")
    (tmp_path / "d.txt").write_bytes(b"x")
    files = rasters.files(spark, str(tmp_path))
    info = {r.path.rsplit("/", 1)[1]: r for r in rasters.inspected(files).collect()}
    assert {k: (v.format, v.width, v.height, v.bands) for k, v in info.items()} == {"a.png": ("PNG", 5, 4, 3), "b.TIF": ("TIFF", 5, 4, 3), "c.tif": (None, None, None, None)}
    assert info["b.TIF"].transform == [0.5, 0.0, 70.0, 0.0, -0.25, 28.0]
    lines = rasters.pixel_rows(files).collect()
    assert [(r.path.rsplit("/", 1)[1], r.y, r.rgb) for r in lines if r.error] == [("c.tif", None, None)]
    lines = [r for r in lines if not r.error]
    assert len(lines) == 8 and all(bytes(r.rgb) == image[r.y].tobytes() for r in lines)


def _lzw(raw):
    """Codes of 9 to 12 bits as TIFF writes them."""
    bits, table, width, word = "", {}, 9, b""

    def clear():
        nonlocal table, width, bits
        bits += format(256, f"0{width}b")
        table, width = {bytes([k]): k for k in range(256)}, 9

    clear()
    for k in raw:
        more = word + bytes([k])
        if more in table:
            word = more
            continue
        bits += format(table[word], f"0{width}b")
        table[more] = len(table) + 2
        width = 9 if len(table) + 2 < 512 else 10 if len(table) + 2 < 1024 else 11 if len(table) + 2 < 2048 else 12
        word = bytes([k])
        if len(table) + 2 >= 4094:
            bits += format(table[word], f"0{width}b")
            word = b""
            clear()
    if word:
        bits += format(table[word], f"0{width}b")
        width = 9 if len(table) + 3 < 512 else 10 if len(table) + 3 < 1024 else 11 if len(table) + 3 < 2048 else 12
    bits += format(257, f"0{width}b")
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8)


def _packed_tiff(image, side, pack, how, predictor=1):
    """A TIFF of compressed square tiles, or of strips of ``side`` lines if that is negative."""
    h, w, n = image.shape
    chunk_h, chunk_w = abs(side), side if side > 0 else w
    chunks = []
    for y in range(0, h, chunk_h):
        for x in range(0, w, chunk_w):
            part = image[y : y + chunk_h, x : x + chunk_w]
            if side > 0:
                part = np.pad(part, ((0, chunk_h - part.shape[0]), (0, chunk_w - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1)
            chunks.append(pack(np.ascontiguousarray(part).tobytes()))
    places, at = [], 8
    for c in chunks:
        places.append(at)
        at += len(c)
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    where, sizes = (324, 325) if side > 0 else (273, 279)
    tags = {256: w, 257: h, 258: image.dtype.itemsize * 8, 259: how, 277: n, 317: predictor, 339: kind, where: places, sizes: [len(c) for c in chunks]}
    tags |= {322: chunk_w, 323: chunk_h} if side > 0 else {278: chunk_h}
    first, more, body = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, v in sorted(tags.items()):
        v = v if isinstance(v, list) else [v]
        value = struct.pack(f"<{len(v)}I", *v)
        body += struct.pack("<HHI", tag, 4, len(v)) + (value if len(v) == 1 else struct.pack("<I", first + len(more)))
        more += value if len(v) > 1 else b""
    return b"II*\0" + struct.pack("<I", at) + b"".join(chunks) + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0) + more


def _bits_of_runs(raw):
    return b"".join(bytes([len(raw[k : k + 100]) - 1]) + raw[k : k + 100] for k in range(0, len(raw), 100)) + b"\x80"


@pytest.mark.parametrize("side", [16, -7])
@pytest.mark.parametrize(("how", "pack"), [(1, bytes), (8, zlib.compress), (5, _lzw), (32773, _bits_of_runs)])
@pytest.mark.parametrize(("kind", "predictor"), [("u1", 1), ("u1", 2), ("u2", 2), ("f4", 1)])
def test_tiff_windows(side, how, pack, kind, predictor):
    rng = np.random.default_rng(3)
    image = (np.cumsum(rng.integers(0, 3, (45, 70, 3)), 1) % 200).astype(kind)
    reader = rasters.Reader(_packed_tiff(image, side, pack, how, predictor))
    assert (reader.window(0, 0, 45, 70) == image).all()
    assert (reader.window(13, 30, 20, 37) == image[13:33, 30:67]).all()
    assert (rasters.pixels(_packed_tiff(image, side, pack, how, predictor)) == image.astype(np.uint8)).all()


def test_scaled_reads_match_whole_image_interpolation():
    image = np.random.default_rng(5).integers(0, 255, (40, 60, 3)).astype(np.uint8)
    reader = rasters.Reader(_packed_tiff(image, 16, zlib.compress, 8))
    whole = np.empty((25, 90, 3))
    for y in range(25):
        for x in range(90):
            sy, sx = min(max((y + 0.5) * 40 / 25 - 0.5, 0), 39), min(max((x + 0.5) * 60 / 90 - 0.5, 0), 59)
            a, c = int(sy), int(sx)
            b, d = min(a + 1, 39), min(c + 1, 59)
            u, v = sy - a, sx - c
            whole[y, x] = (image[a, c] * (1 - u) + image[b, c] * u) * (1 - v) + (image[a, d] * (1 - u) + image[b, d] * u) * v
    assert np.allclose(reader.scaled(25, 90, 0, 0, 25, 90), whole)
    assert np.allclose(reader.scaled(25, 90, 7, 33, 11, 40), whole[7:18, 33:73])
    assert rasters.pixels(_packed_tiff(image, 16, zlib.compress, 8), 30).shape == (20, 30, 3)


def test_window_pairs_reach_the_canvas(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 255, (100, 150, 3)).astype(np.uint8), rng.integers(0, 255, (50, 75, 3)).astype(np.uint8)
    rows = [(1, _packed_tiff(a, 16, zlib.compress, 8), _packed_tiff(b, -9, _lzw, 5)), (2, b"junk", b"junk")]
    pairs = spark.createDataFrame([(p, bytearray(x), bytearray(y)) for p, x, y in rows], "pair_id long, before binary, after binary")
    tiles = rasters.window_pairs(pairs, 64, 0.25)
    got = tiles.collect()
    assert [r.pair_id for r in got if r.error] == [2] and len(got) == 7
    for r in (r for r in got if not r.error):
        assert (np.frombuffer(r.before, np.uint8).reshape(r.h, r.w, 3) == a[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w]).all()
    good = tiles.filter("error is null")
    scored = tiling.scored_tiles(good).join(good.select("pair_id", "y0", "x0", "height", "width"), ["pair_id", "y0", "x0"])
    flat = scored.select("*", F.posexplode("scores").alias("k", "score"))
    flat = flat.withColumns({"y": F.col("y0") + F.floor(F.col("k") / F.col("w")), "x": F.col("x0") + F.col("k") % F.col("w")})
    out = {(r.y, r.x): r.score for r in tiling.on_canvas(flat, 40, 45).collect()}

    def shrunk(v, n):
        m = np.zeros((n, len(v)))
        for k in range(len(v)):
            for d in range(n):
                m[d, k] = max(0, min((k + 1) * n / len(v), d + 1) - max(k * n / len(v), d))
        return m / m.sum(1, keepdims=True)

    total, weights = np.zeros((40, 45)), np.zeros((40, 45))
    for r in scored.collect():
        y, x = round(r.y0 * 0.4), round(r.x0 * 0.3)
        h, w = min(max(1, round(r.h * 0.4)), 40 - y), min(max(1, round(r.w * 0.3)), 45 - x)
        small = shrunk(range(r.h), h) @ np.array(r.scores).reshape(r.h, r.w) @ shrunk(range(r.w), w).T
        weight = np.maximum(np.outer(np.hanning(h + 2)[1:-1], np.hanning(w + 2)[1:-1]), 1e-3)
        total[y : y + h, x : x + w] += small * weight
        weights[y : y + h, x : x + w] += weight
    assert len(out) == (weights > 0).sum() and all(v == pytest.approx(total[k] / weights[k]) for k, v in out.items())


def test_tree_of_any_depth(spark):
    nodes = [(k, k - 1 if k else None, f"n{k}", k, "", True) for k in range(70)]
    shape = "id long, parent_id long, name string, level int, path string, is_active boolean"
    tree = catalog.closure(spark.createDataFrame(nodes, shape).coalesce(1))
    assert tree.count() == 70 * 71 // 2
    with pytest.raises(ValueError, match="cycle"):
        catalog.closure(spark.createDataFrame([(1, 2, "a", 0, "", True), (2, 1, "b", 0, "", True)], shape).coalesce(1))


def test_shadows_match_brute_force(spark):
    rng = np.random.default_rng(6)
    before, after = rng.integers(90, 110, (40, 50)), rng.integers(80, 110, (40, 50))
    after[4:20, 18:26] -= 60
    after[30:33, 3:6] -= 60
    boxes = [(0, 1, 8, 5, 10, 12), (0, 2, 0, 25, 6, 6), (0, 3, 44, 34, 9, 9)]
    gray = spark.createDataFrame([(0, y, x, int(before[y, x]), int(after[y, x])) for y in range(40) for x in range(50)], "pair_id long, y int, x int, g1 int, g2 int")
    got = {r.region_id: (r.shadow_px, r.spread_x, r.spread_y) for r in regions.shadows(gray, spark.createDataFrame(boxes, "pair_id long, region_id long, x int, y int, w int, h int"), cell=16).collect()}
    want = {}
    for _, k, x, y, w, h in boxes:
        dx, dy = int(w * 0.6), int(h * 0.6)
        x0, x1, y0, y1 = max(0, x - dx), min(50, x + w + dx), max(0, y - dy), min(40, y + h + dy)
        d = (before - after)[y0:y1, x0:x1].astype(float)
        on = d > max(25, 1.5 * d.std())
        on[max(0, y - y0) : y - y0 + h, max(0, x - x0) : x - x0 + w] = False

        def crossed(m, f, edge):
            p = np.pad(m, 1, constant_values=edge)
            return f.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])

        opened = crossed(crossed(on, np.logical_and, True), np.logical_or, False)
        if opened.any():
            ys, xs = np.nonzero(opened)
            want[k] = (len(ys), np.ptp(xs), np.ptp(ys))
    assert got == want and 1 in want


def test_streams_agree_with_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(2):
        source.filter(f"event_id % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.file_stream(spark, str(tmp_path / "in"), source.schema)
    name = "windowed"
    q = events.counts_by_window(stream, delay="60 days").writeStream.outputMode("complete").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.value, 4)) for r in df.collect())
    assert key(spark.table(name)) == key(events.counts_by_window(source))

    log = source.select(F.col("user_id").alias("run_id"), (F.col("event_id") % 4).alias("region_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "confirmed").otherwise("pending").alias("status"))
    log.write.parquet(str(tmp_path / "log_in"))
    out = str(tmp_path / "log")
    q = events.file_stream(spark, str(tmp_path / "log_in"), log.schema).writeStream.foreachBatch(events.keep_latest(out)).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, events.read_latest(spark, out).collect())) == sorted(map(tuple, review.latest(log).collect()))


def test_region_pipeline_keeps_what_the_reference_keeps(spark):
    from chronotile.operators import regions as G

    rows = [(area, x, conf, kind) for area in (900, 1000, 2999, 3000, 8000) for x in (50, 80, 200) for conf in (0.1, 0.23, 0.24, 0.3) for kind in ("Building", "Unclassified")]
    rows = [(k, 0, 0, 0, x, x, area, conf, kind) for k, (area, x, conf, kind) in enumerate(rows)]
    rows += [(1000, 0, 0, 0, 1000, 1000, 990000, 0.9, "Building"), (1001, 0, 0, 0, 1000, 800, 270000, 0.9, "Building"), (1002, 0, 0, 0, 1000, 800, 290000, 0.9, "Building")]
    df = spark.createDataFrame([(r[0], *r) for r in rows], "run_id long, region_id int, a int, x int, y int, w int, h int, area long, confidence double, object_type string").drop("a")
    for registered in (True, False):
        floor, cover = (1000, 0.75) if registered else (1400, 0.92)
        want = {r[0] for r in rows if r[6] >= floor and r[6] / (r[4] * r[5]) >= 0.15 and not (r[4] * r[5] > cover * 1000000 and r[6] / (r[4] * r[5]) < 0.35) and not (r[7] < 0.24 and r[6] < 3 * floor)}
        assert {r.run_id for r in G.region_pipeline(df, 1000000, 1000, registered).collect()} == want
