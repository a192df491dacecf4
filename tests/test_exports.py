import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindings.maskdata import counts_text
from quillwork.operators import annotations as A
from quillwork.sinks import image_formats as X
from quillwork.sinks import items as I
from quillwork.sinks import pieces as P
from test_masks import runs_of

CLASSES = [(0, "cat"), (1, "dog & co")]
POLYGON = [[0.2, 0.2], [0.6, 0.2], [0.6, 0.8], [0.2, 0.8]]
PICTURE = np.zeros((200, 100), bool)
PICTURE[40:120, 10:50] = True


@pytest.fixture
def tables(spark):
    images = spark.createDataFrame(
        [(1, "a/cat.jpg", 100, 200, None), (2, "cat.png", 100, 200, "valid"), (3, "x.jpg", None, None, "test"),
         (4, "none.jpg", 50, 50, "train")], "asset_id long, file_name string, width int, height int, split string")
    rows = [("k1", 1, "cat", "bbox", 0.1, 0.2, 0.4, 0.4, None, None), ("k2", 1, "cat", "classification", None, None, None, None, None, None),
            ("k3", 2, "dog & co", "polygon", None, None, None, None, POLYGON, None), ("k4", 3, "cat", "bbox", 0.1, 0.1, 0.2, 0.2, None, None),
            ("k5", 2, "cat", "mask", None, None, None, None, None, ([200, 100], counts_text(runs_of(PICTURE)))),
            ("k6", 1, "cat", "bbox", 0.5, 0.5, 0.0001, 0.0001, None, None), ("k7", 1, "cat", "bbox", 0.5, None, 0.1, 0.1, None, None)]
    anns = spark.createDataFrame(rows, "ann_key string, asset_id long, class_name string, kind string, x double, y double, w double, "
                                       "h double, points array<array<double>>, mask struct<size:array<int>,counts:string>")
    classes = spark.createDataFrame(CLASSES, "class_index int, name string")
    return X.unique_names(images), anns, classes


def test_unique_names(tables):
    assert {r["asset_id"]: r["stem"] + r["ext"] for r in tables[0].collect()} == {
        1: "cat.jpg", 2: "cat_2.png", 3: "x.jpg", 4: "none.jpg"}
    assert X.name_collisions(tables[0]).count() == 0


def files_of(pieces, glue=""):
    """Whole files from their pieces."""
    out = {}
    for r in P.in_order(pieces).collect():
        out.setdefault(r["path"], []).extend([r["line"]] if r["line"] is not None else [])
    return {path: glue.join(lines) for path, lines in out.items()}


def test_unique_names_keep_clear_of_numbered_files(spark):
    names = ["x/a.jpg", "y/a.jpg", "a_2.jpg", "z/a.jpg", "b_2.jpg", "q/b_2.jpg"]
    images = spark.createDataFrame(list(enumerate(names)), "asset_id long, file_name string")
    named = X.unique_names(images)
    assert X.name_collisions(named).count() == 0
    assert {r["asset_id"]: r["stem"] for r in named.collect()} == {0: "a", 1: "a_3", 2: "a_2", 3: "a_4", 4: "b_2", 5: "b_2_2"}


def test_yolo(tables):
    files = files_of(X.yolo(*tables), "\n")
    assert files["train/labels/cat.txt"].split("\n")[0] == "0 0.300000 0.400000 0.400000 0.400000"
    lines = files["valid/labels/cat_2.txt"].split("\n")
    assert lines[0] == "1 0.400000 0.500000 0.400000 0.600000"
    assert lines[1].startswith("0 0.100000 0.200000 ") and len(lines[1].split()) % 2 == 1
    assert files["train/labels/none.txt"] == "" and len(files) == 4
    assert "nc: 2" in X.data_yaml(["cat", "dog"]) and "['cat', 'dog']" in X.data_yaml(["cat", "dog"])
    assert {(r["asset_id"], r["n"]) for r in X.skipped(tables[1]).collect()} == {(1, 1)}


def test_coco(tables):
    images, anns, classes = tables
    numbered = X.coco_images(images)
    rows = X.coco_annotations(numbered, images, anns, classes).orderBy("split", "id").collect()
    first = next(r for r in rows if r["split"] == "train")
    assert first["bbox"] == [10.0, 40.0, 40.0, 80.0] and first["area"] == 3200.0 and first["category_id"] == 1
    poly, mask = [r for r in rows if r["split"] == "valid"]
    assert json.loads(poly["segmentation"]) == [[20.0, 40.0, 60.0, 40.0, 60.0, 160.0, 20.0, 160.0]]
    assert mask["area"] == 3200.0 and json.loads(mask["segmentation"])["size"] == [200, 100]
    assert mask["bbox"] == [10.0, 40.0, 40.0, 80.0] and [poly["id"], mask["id"]] == [0, 1]
    assert {(r["split"], r["id"]) for r in numbered.collect()} == {("train", 0), ("train", 1), ("valid", 0)}


def counting(spark):
    """A text column that counts how often it is worked out."""
    worked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        worked.add(1)
        return text

    return worked, seen.asNondeterministic()


def test_coco_ids_without_ranking_objects(spark, tables):
    images, anns, classes = tables
    numbered = X.coco_images(images)
    order = ("split", "id")
    plain, ranked = ([tuple(r) for r in X.coco_annotations(numbered, images, anns, classes, crowded=n).orderBy(*order).collect()] for n in (9, 0))
    assert plain == ranked and len(plain) == 4
    twice = images.unionByName(images)
    rows = X.coco_annotations(X.coco_images(twice), twice, anns, classes).collect()
    assert len(rows) == 16 and len({(r["split"], r["id"]) for r in rows}) == 16
    worked, seen = counting(spark)
    X.coco_annotations(numbered, images, anns.withColumn("ann_key", seen("ann_key")), classes).collect()
    assert worked.value <= anns.count()


def test_names_and_lines_are_made_once(spark, tables):
    worked, seen = counting(spark)
    images = spark.createDataFrame([(i, f"img_{i % 3}.jpg") for i in range(20)], "asset_id long, file_name string")
    assert X.unique_names(images.withColumn("file_name", seen("file_name"))).count() == 20
    assert worked.value == 20
    worked, seen = counting(spark)
    lines = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "key string, seq int, line string")
    found = P.separated(lines.withColumn("line", seen("line")), "key").collect()
    assert sorted((r["key"], r["line"]) for r in found) == [("a", ",y"), ("a", "x"), ("b", "z")]
    assert worked.value == 3


def test_voc(tables):
    files = files_of(X.voc(*tables))
    assert "<xmin>10</xmin><ymin>40</ymin><xmax>50</xmax><ymax>120</ymax>" in files["train/cat.xml"]
    assert "<name>dog &amp; co</name>" in files["valid/cat_2.xml"] and len(files) == 3


def test_classification(tables):
    rows = {r["filename"]: r for r in X.classification(tables[0], tables[1]).collect()}
    assert (rows["cat.jpg"]["label"], rows["cat.jpg"]["target"]) == ("cat", "train/cat/cat.jpg")
    assert rows["none.jpg"]["target"] == "train/_unlabeled_/none.jpg" and rows["none.jpg"]["label"] is None


def test_createml(tables):
    pieces = X.createml(*tables).withColumnRenamed("image", "path").drop("split")
    rows = {image: json.loads(line) for image, line in files_of(pieces).items()}
    assert rows["cat.jpg"]["annotations"][0] == {"label": "cat", "coordinates": {"x": 30.0, "y": 80.0, "width": 40.0, "height": 80.0}}
    assert rows["none.jpg"]["annotations"] == [] and len(rows) == 3
    assert rows["cat_2.png"]["annotations"][0]["coordinates"]["height"] == 120.0
    assert X.reduced_shapes(tables[1]).first()["reduced"] == 2


def test_tfcsv(tables):
    rows = X.tfcsv(*tables).collect()
    assert ("train", "cat.jpg", 100, 200, "cat", 10, 40, 50, 120) in {tuple(r) for r in rows}
    assert all(r["xmin"] < r["xmax"] and r["ymin"] < r["ymax"] for r in rows) and len(rows) == 4
    assert 'id: 1\n  name: "cat"' in X.label_map(["cat", "dog"])


def test_segmentation_classes():
    assert X.segmentation_classes(["cat"]) == "0: background\n1: cat\n"


def test_validation_with_masks(tables):
    bad = tables[1].withColumn("mask", F.when(F.col("kind") == "mask", F.struct(
        F.array(F.lit(3), F.lit(3)).alias("size"), F.lit("4").alias("counts"))))
    reasons = {r["ann_key"]: r["reason"] for r in A.validate(bad).collect()}
    assert reasons["k5"] and reasons["k7"] == "box sides missing" and reasons["k1"] is None
    assert all(r["reason"] is None for r in A.validate(tables[1]).filter("kind = 'mask'").collect())


@pytest.mark.parametrize("n,ratios,expected", [
    (10, (0.7, 0.2, 0.1), (7, 2, 1)), (11, (0.8, 0.2, 0.0), (9, 2, 0)), (3, (0.34, 0.33, 0.33), (1, 1, 1)),
    (1, (0.7, 0.2, 0.1), (1, 0, 0)), (1000, (0.69, 0.2, 0.1), None), (7, (0.5, 0.5, 0.0), (3, 4, 0))])
def test_split_sizes(spark, n, ratios, expected):
    sizes = A.split_sizes(F.col("id"), dict(zip(A.SPLITS, ratios)))
    row = spark.range(n, n + 1).select(*[sizes[s].alias(s) for s in A.SPLITS]).first()
    assert sum(row) == n
    if expected:
        assert tuple(row) == expected


def test_auto_split_is_stable(spark):
    assets = spark.range(400).select(F.col("id").alias("asset_id"), F.lit(1).alias("dataset_id"))
    states = spark.createDataFrame([(5, 1, "approved", "test")], "asset_id long, dataset_id int, status string, split string")
    one = {r["asset_id"]: (r["split"], r["status"]) for r in A.auto_split(assets, states).collect()}
    two = {r["asset_id"]: (r["split"], r["status"]) for r in A.auto_split(assets.repartition(13), states).collect()}
    other = {r["asset_id"]: (r["split"], r["status"]) for r in A.auto_split(assets, states, seed=1).collect()}
    assert one == two != other and one[5][1] == "approved" and one[6][1] == "unannotated"
    assert [sum(s == k for s, _ in one.values()) for k in A.SPLITS] == [280, 80, 40]
    assert A.auto_split(assets, states, only_annotated=True).count() == 1
    with pytest.raises(ValueError):
        A.auto_split(assets, states, (0.5, 0.2, 0.1))


def test_items(spark, tmp_path):
    df = spark.createDataFrame([("1", {"text": "a, \"b\""}, "x", 0.5), ("2", {"other": "c"}, "y", 1.0)],
                               "item_id string, data map<string,string>, label string, confidence double")
    wide = I.wide_items(df)
    assert wide.columns == ["item_id", "other", "text", "label", "confidence"]
    path = I.write_cleaned(wide, str(tmp_path), "t.csv")
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert {r["text"] for r in back.collect()} == {"a, \"b\"", None}
    images = spark.createDataFrame([("1", "a.jpg", 1, 1, "cat"), ("2", "b.jpg", 1, 1, "emu")],
                                   "item_id string, file_name string, width int, height int, label string")
    assert [r["category_id"] for r in I.coco_items(images, ["cat", "dog"]).orderBy("id").collect()] == [0, -1]
    assert {r["content"] for r in I.yolo_items(images, ["cat"]).collect()} == {"0\n", "-1\n"}
    I.write_lines(I.json_items(images), str(tmp_path / "lines"), ["item_id"])
    assert spark.read.json(str(tmp_path / "lines")).count() == 2


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    import json
    import os

    from pyspark.sql import functions as F

    from quillwork.sinks import files as Fi

    pieces = spark.range(400).selectExpr("concat('d', id % 3, '/f', id % 7, '.txt') as path", "1 as place", "id as seq",
                                         "concat('line ', id, ' é') as line").repartition(5)
    heads = spark.createDataFrame([("empty.txt", 0, None, None), ("d0/f0.txt", 0, None, "head"), (None, 0, None, "lost")],
                                  "path string, place int, seq long, line string")
    assert Fi.write_files(pieces.unionByName(heads), str(tmp_path / "out")) == 22
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "out"): open(os.path.join(d, f), encoding="utf-8").read()
             for d, _, fs in os.walk(tmp_path / "out") for f in fs}
    expected = {"empty.txt": ""}
    for i in range(400):
        expected.setdefault(f"d{i % 3}/f{i % 7}.txt", "head\n" if i % 21 == 0 else "")
        expected[f"d{i % 3}/f{i % 7}.txt"] += f"line {i} é\n"
    assert found == expected
    broken = pieces.withColumn("line", F.when(F.col("seq") < 390, F.col("line")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        Fi.write_files(broken, str(tmp_path / "none"))
    assert [f for _, _, fs in os.walk(tmp_path / "none") for f in fs] == []
    assert Fi.write_files(pieces.limit(0), str(tmp_path / "nothing")) == 0


def test_many_small_files_take_few_archives(spark, tmp_path):
    import hashlib
    import os
    import zipfile

    from bindings import exports
    from quillwork.sinks import files as Fi

    small = spark.range(6000).selectExpr("concat('d', id % 3, '/f', id % 1000, '.txt') as path", "1 as place", "id as seq",
                                         "concat('line ', id, ' é') as line")
    long = spark.range(5000).selectExpr("'d1/long.txt' as path", "2 as place", "id as seq", "repeat(cast(id as string), 100) as line")
    heads = spark.createDataFrame([("empty.txt", 0, None, None), (None, 0, None, "lost")], "path string, place int, seq long, line string")
    pieces = small.unionByName(long).unionByName(heads)
    expected = {"empty.txt": "", "d1/long.txt": "".join(f"{str(i) * 100}\n" for i in range(5000))}
    for i in range(6000):
        name = f"d{i % 3}/f{i % 1000}.txt"
        expected[name] = expected.get(name, "") + f"line {i} é\n"
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        archives = Fi.write_archives(pieces, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {}
    for name in [r["archive"] for r in archives.collect()]:
        with zipfile.ZipFile(tmp_path / "out" / name) as archive:
            assert archive.testzip() is None and not set(archive.namelist()) & set(found)
            found |= {n: archive.read(n).decode() for n in archive.namelist()}
    assert found == expected
    assert sorted(os.listdir(tmp_path / "out")) == ["_writing", *sorted(r["archive"] for r in archives.collect())]
    assert not os.listdir(tmp_path / "out/_writing")
    # the query's files: a handful of archives instead of 3002 blocks of the disk
    made = []
    keep, exports.new_path = exports.new_path, lambda *a: made.append(str(tmp_path / "query")) or made[0]
    try:
        rows = exports.packed_files(spark, pieces).collect()
    finally:
        exports.new_path = keep
    assert {(r["path"], r["size"], r["digest"]) for r in rows} == {
        (p, len(c.encode()), hashlib.md5(c.encode()).hexdigest()) for p, c in expected.items()}
    assert len(rows) == len(expected) == 3002 and len([f for _, _, fs in os.walk(made[0]) for f in fs]) < 100
    broken = pieces.withColumn("line", F.when(F.col("seq") < 4990, F.col("line")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        Fi.write_archives(broken, str(tmp_path / "none"))
    assert [f for _, _, fs in os.walk(tmp_path / "none") for f in fs] == []
    assert Fi.write_archives(pieces.limit(0), str(tmp_path / "nothing")).count() == 0


def test_a_long_file_is_written_by_many_tasks(spark, tmp_path):
    from quillwork.sinks import files as Fi

    lines = spark.range(4000).selectExpr("if(id < 3900, 'a/long.txt', concat('b', id % 3, '.txt')) as path", "cast(id >= 2000 as int) as place",
                                         "id as seq", "concat('line ', id) as line")
    w = Fi.Written
    got = Fi.moves([w("d", 7, 1, "x", "x"), None, w("a", 0, 2, "p", "x"), w(None), w("b", 3, 1, "x", "x"), w("e", 9, 3, "x", "z")])
    assert got == [{"attempt": "a", "skip": 0, "more": ["b", "d", "e"]}, {"attempt": "b", "skip": 1, "more": []},
                   {"attempt": "d", "skip": 1, "more": []}, {"attempt": "e", "skip": 1, "more": []}]
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert Fi.write_files(lines, str(tmp_path / "out")) == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (tmp_path / "out/a/long.txt").read_text().splitlines() == [f"line {i}" for i in range(3900)]
    for i in range(3):
        assert (tmp_path / f"out/b{i}.txt").read_text().splitlines() == [f"line {j}" for j in range(3900, 4000) if j % 3 == i]
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["_writing", "a", "b0.txt", "b1.txt", "b2.txt"]
    assert not list((tmp_path / "out/_writing").iterdir())


def test_documents_per_split_are_json(spark, tmp_path):
    import json

    from quillwork.sinks import files as Fi
    from quillwork.sinks import image_formats as X

    images = spark.createDataFrame([(1, "a", ".jpg", "train", 100, 50), (2, "b", ".jpg", None, 10, 10), (3, "c", ".png", "test", 20, 20)],
                                   "asset_id long, stem string, ext string, split string, width int, height int")
    anns = spark.createDataFrame([(1, "k1", "bbox", "cat", 0.1, 0.2, 0.3, 0.4), (1, "k2", "bbox", "dog", 0.0, 0.0, 0.5, 0.5),
                                  (3, "k3", "bbox", "cat", 0.5, 0.5, 0.5, 0.5)],
                                 "asset_id long, ann_key string, kind string, class_name string, x double, y double, w double, h double")
    anns = anns.selectExpr("*", "cast(null as array<array<double>>) as points")
    classes = spark.createDataFrame([(0, "cat"), (1, "dog")], "class_index int, name string")
    for pieces in (X.coco_documents(images, anns, classes), X.createml_documents(images, anns, classes)):
        Fi.write_files(pieces, str(tmp_path / "out"))
    coco = json.loads((tmp_path / "out/train/_annotations.coco.json").read_text())
    assert [i["file_name"] for i in coco["images"]] == ["a.jpg", "b.jpg"] and [a["bbox"] for a in coco["annotations"]] == [[10, 10, 30, 20], [0, 0, 50, 25]]
    assert [c["name"] for c in coco["categories"]] == ["cat", "dog"]
    records = json.loads((tmp_path / "out/train/_annotations.createml.json").read_text())
    assert [(r["image"], len(r["annotations"])) for r in records] == [("a.jpg", 2), ("b.jpg", 0)]
    assert len(json.loads((tmp_path / "out/test/_annotations.createml.json").read_text())) == 1
