import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bindings.maskdata import HEIGHT, WIDTH, counts_text, rectangle_texts
from quillwork.operators import masks as M
from quillwork.sources.files import _image_facts


def runs_of(picture):
    flat = picture.T.ravel().astype(int)
    change = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate(([0], change, [flat.size]))).tolist()
    return ([0] + runs) if flat[0] else runs


def masks(spark, *pictures):
    rows = [(i, ([p.shape[0], p.shape[1]], counts_text(runs_of(p)))) for i, p in enumerate(pictures)]
    return spark.createDataFrame(rows, "id int, mask struct<size:array<int>,counts:string>")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_round_trip(seed):
    rng = np.random.default_rng(seed)
    picture = rng.random((17, 23)) < 0.4
    runs, height, width = M.checked_runs([17, 23], counts_text(runs_of(picture)))
    assert runs.tolist() == runs_of(picture)
    assert (M.grid_of(runs, height, width) == picture).all()


def test_stats(spark):
    block = np.zeros((30, 40), bool)
    block[5:12, 8:20] = True
    wrap = np.zeros((6, 5), bool)
    wrap[4:, 1] = wrap[:2, 2] = True
    empty = np.zeros((4, 4), bool)
    rows = M.mask_stats(masks(spark, block, wrap, empty)).orderBy("id").collect()
    assert tuple(rows[0])[2:] == (84, 8, 5, 12, 7, None)
    assert (rows[1]["area"], rows[1]["x"], rows[1]["w"], rows[1]["y"], rows[1]["h"]) == (4, 1, 2, 0, 6)
    assert tuple(rows[2])[2:] == (0, 0, 0, 0, 0, None)


@pytest.mark.parametrize("size,counts", [([2, 2], "!"), ([0, 2], "4"), ([2, 2], ""), ([2], "4"), (None, "4"), ([2, 2], "3"), ([3, 3], "o")])
def test_unsound_masks(spark, size, counts):
    df = spark.createDataFrame([((size, counts),)], "mask struct<size:array<int>,counts:string>")
    assert M.mask_stats(df).first()["problem"]
    assert M.explode_polygons(df).count() == 0


def polygons(spark, picture):
    rows = M.explode_polygons(masks(spark, picture)).orderBy("ring").collect()
    return [r["points"] for r in rows]


def test_outlines(spark):
    square = np.zeros((30, 30), bool)
    square[5:20, 5:20] = True
    found = polygons(spark, square)
    assert len(found) == 1 and 4 <= len(found[0]) <= 12 and all(0 <= c <= 1 for p in found[0] for c in p)
    two = np.zeros((40, 60), bool)
    two[2:8, 2:8] = two[15:35, 20:50] = True
    found = polygons(spark, two)
    assert len(found) == 2 and max(p[0] for p in found[0]) > max(p[0] for p in found[1])
    speck = np.zeros((20, 20), bool)
    speck[10, 10] = True
    assert polygons(spark, speck) == [] and polygons(spark, np.zeros((20, 20), bool)) == []


def test_circle_loses_most_vertices():
    r, c = np.mgrid[:200, :200]
    circle = (r - 100) ** 2 + (c - 100) ** 2 < 70 * 70
    raw = M.outlines(circle, tolerance=0.0)[0]
    thin = M.outlines(circle)[0]
    assert 8 <= len(thin) < 0.35 * len(raw)


def annotation_rows(spark, rows):
    return spark.createDataFrame(rows, "asset_id long, seq long, width int, height int, kind string, class_index int, "
                                       "points array<array<double>>, mask struct<size:array<int>,counts:string>")


def test_later_shapes_win(spark):
    half = np.zeros((20, 10), bool)
    half[:, :5] = True
    mask = ([20, 10], counts_text(runs_of(half)))
    whole = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    df = annotation_rows(spark, [(1, 1, 10, 20, "polygon", 0, whole, None), (1, 2, 10, 20, "mask", 4, None, mask),
                                 (1, 3, 10, 20, "bbox", 2, None, None), (1, 4, 10, 20, "classification", 2, None, None)])
    row = M.class_layers(df).first()
    layer = np.frombuffer(zlib.decompress(row["layer"]), np.uint8).reshape(20, 10)
    assert (layer[:, :5] == 5).all() and (layer[:, 5:] == 1).all() and row["boxes"] == 1
    pixels = {r["value"]: r["pixels"] for r in M.class_pixels(M.class_layers(df)).collect()}
    assert pixels == {5: 100, 1: 100}


def test_layers_do_not_depend_on_parts(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 2, i, 40, 30, "polygon", i % 7, rng.random((3, 2)).tolist(), None) for i in range(60)]
    df = annotation_rows(spark, rows)
    one = {r["asset_id"]: bytes(zlib.decompress(r["layer"])) for r in M.class_layers(df).collect()}
    many = {r["asset_id"]: bytes(zlib.decompress(r["layer"])) for r in M.class_layers(df, limit=4, fan_in=2).collect()}
    assert one == many and len(one) == 2


def test_png_header():
    assert _image_facts(M.png_bytes(np.zeros((7, 9), np.uint8)))[:3] == ("PNG", 9, 7)
    assert _image_facts(b"GIF89a" + (3).to_bytes(2, "little") + (4).to_bytes(2, "little"))[1:3] == (3, 4)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x06\x03" + b"\0" * 9
    assert _image_facts(jpeg) == ("JPEG", 6, 5, 3, "RGB")
    assert _image_facts(b"\x89PNG\r\n\x1a\n") == (None,) * 5 and _image_facts(b"") == (None,) * 5


def test_fill_covers_the_area():
    square = M.fill_polygon(np.array([[2.0, 3.0], [8.0, 3.0], [8.0, 9.0], [2.0, 9.0]]), 12, 12)
    assert square.sum() == 36 and square[3:9, 2:8].all()
    triangle = M.fill_polygon(np.array([[0.0, 0.0], [100.0, 0.0], [0.0, 100.0]]), 100, 100)
    assert abs(int(triangle.sum()) - 5000) <= 60


def test_columns(spark):
    df = masks(spark, np.ones((3, 4), bool)).withColumn("m2", M.mask_column(F.lit(3), F.lit(4), F.col("mask.counts")))
    assert M.mask_stats(df, "m2").first()["area"] == 12


def test_facts_of_a_batch_are_those_of_single_masks():
    rng = np.random.default_rng(6)
    sizes, texts = [], []
    for i in range(400):
        h, w = rng.integers(1, 40, 2).tolist()
        cuts = np.sort(rng.integers(0, h * w + 1, rng.integers(0, 9)))
        sizes.append([h, w])
        texts.append(counts_text(np.diff([0, *cuts, h * w]).tolist()))
    texts[5:60:5] = [t + "1" for t in texts[5:60:5]]
    texts[6:60:7] = [t[:-1] + "\x7f" for t in texts[6:60:7]]
    texts[7:60:11] = ["".join(map(chr, rng.integers(40, 120, 6))) for _ in texts[7:60:11]]
    sizes += [None, None, [3], [0, 4], [3, None], [4, 4], [4, 4], [4, 4]]
    texts += [None, "1", "1", "1", "1", None, "", "日"]
    got = M.batch_facts(sizes, texts)
    for i, (size, text) in enumerate(zip(sizes, texts)):
        try:
            runs, height, _ = M.checked_runs(size, text)
            expected = [int(runs[1::2].sum()), *M._extent(runs, height), None]
        except ValueError as e:
            expected = [None] * 5 + [None if size is None and text is None else str(e)]
        assert [None if x is pd.NA else x for x in got.iloc[i]] == expected
    assert len(M.batch_facts([], [])) == 0
    joined = [b"".join(p) for _, p in M._parts_of(list(range(5)), [b"aa", b"bbb", b"c", b"dddddd", b"e"], 4)]
    assert joined == [b"aa", b"bbbc", b"dddddd", b"e"]


def test_texts_of_rectangles_are_those_of_their_runs():
    x, y, w, h = (a.ravel() for a in np.meshgrid([0, 1, 19], [0, 3, 14], [1, 2, 4, 33], [4, 17, 28]))
    expected = []
    for a, b, c, d in zip(x.tolist(), y.tolist(), w.tolist(), h.tolist()):
        runs = [a * HEIGHT + b] + [d, HEIGHT - d] * (c - 1) + [d]
        expected.append(counts_text(runs + [HEIGHT * WIDTH - sum(runs)]))
    assert rectangle_texts(x, y, w, h) == expected and rectangle_texts(x[:0], y[:0], w[:0], h[:0]) == []


def test_zeros_that_lead_a_picture_are_compressed_once():
    rng = np.random.default_rng(8)
    M._after_zeros.cache_clear()
    for top in (0, 40, 200, 210, 300):
        picture = np.zeros((300, 400), np.uint8)
        picture[top:top + 30, 100:200] = rng.integers(0, 9, (len(picture[top:top + 30]), 100))
        body = np.concatenate((np.zeros((300, 1), np.uint8), picture), axis=1).tobytes()
        assert zlib.compress(body, 6) in M.png_bytes(picture)
    kept = M._after_zeros.cache_info()
    assert kept.hits >= 1 and kept.misses == 2


def test_only_painted_rows_of_a_layer_are_compressed():
    rng = np.random.default_rng(9)
    for top, bottom in ((0, 0), (0, 50), (50, 50), (13, 29), (0, 7), (44, 50)):
        layer = np.zeros((50, 70), np.uint8)
        layer[top:bottom] = rng.integers(0, 9, (bottom - top, 70))
        assert zlib.decompress(M._packed(layer, top, bottom)) == layer.tobytes()


def test_pixels_around_a_polygon_are_those_of_the_whole_picture():
    rng = np.random.default_rng(10)
    for _ in range(40):
        points = rng.normal(15, 20, (4, 2))
        x, y = np.meshgrid(np.arange(37) + 0.5, np.arange(23) + 0.5)
        odd = np.zeros((23, 37), bool)
        for (x0, y0), (x1, y1) in zip(points, np.roll(points, -1, axis=0)):
            odd ^= ((y0 <= y) != (y1 <= y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
        rows, columns, inside = M._filled(points, 23, 37)
        assert (M.fill_polygon(points, 23, 37) == odd).all() and (inside == odd[rows, columns]).all()
