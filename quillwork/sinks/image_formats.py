"""Export formats for image annotations, as tables of files, documents or rows.

Per-image documents come as sorted pieces (path, place, seq, line), see ``pieces``: one shape however many
annotations an image carries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import json_text, xml_escape
from ..operators.annotations import SPLITS, has_rect, with_rect
from ..operators.masks import mask_facts, mask_polygons
from ..operators.ranking import with_rank, with_running_total
from ..scratch import materialise
from . import pieces as P

UNLABELED = "_unlabeled_"
CROWDED = 100_000  # annotations of an image that one task numbers


# ---- selection ----------------------------------------------------------------------------------

def select_assets(assets: DataFrame, states: DataFrame, annotations: DataFrame,
                  include_unannotated: bool = False) -> DataFrame:
    """Assets with status, split and the verdict ``rejected``, ``unannotated`` or ``kept``.

    A missing state counts as annotated where annotations exist.
    """
    marked = annotations.select("asset_id").distinct().withColumn("_m", F.lit(True))
    joined = (assets.join(states.select("asset_id", "status", "split"), "asset_id", "left")
              .join(marked, "asset_id", "left"))
    blank = (F.col("status") == "unannotated") | (F.col("status").isNull() & F.col("_m").isNull())
    verdict = (F.when(F.col("status") == "rejected", "rejected")
               .when(blank & F.lit(not include_unannotated), "unannotated").otherwise("kept"))
    return joined.withColumn("verdict", F.coalesce(verdict, F.lit("kept"))).drop("_m")


def selection_counts(selected: DataFrame) -> DataFrame:
    return selected.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("kept", "rejected", "unannotated")])


def split_of(split: Column) -> Column:
    return F.when(split.isin(*SPLITS), split).otherwise("train")


def split_warnings(images: DataFrame) -> DataFrame:
    """(images, assigned, unassigned, warning)."""
    assigned = F.count_if(F.col("split").isin(*SPLITS))
    facts = images.agg(F.count("*").alias("images"), assigned.alias("assigned"))
    warning = (F.when((F.col("images") > 0) & (F.col("assigned") == 0), "no split assigned, everything goes to train")
               .when(F.col("assigned") < F.col("images"), "some images have no split and go to train"))
    return facts.select("images", "assigned", (F.col("images") - F.col("assigned")).alias("unassigned"),
                        warning.alias("warning"))


def unique_names(images: DataFrame, order_by: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Images plus (stem, ext): repeated stems get ``_2``, ``_3`` in order, by the distributed rank.

    Where files are called ``a_2`` or the like already, the repeats of ``a`` are numbered from the largest such number
    on, so no two images have the same name.
    """
    base = F.element_at(F.split(F.coalesce("file_name", F.concat(F.col("asset_id").cast("string"), F.lit(".jpg"))), "/"), -1)
    stem = F.regexp_extract(base, r"^(.+?)(\.[^.]*)?$", 1)
    ext = F.regexp_extract(base, r"^.+?(\.[^.]*)?$", 1)
    # written, since the rows are sampled for their ranges, ranged, and read once more for the numbers
    named = materialise(images.withColumns({"_stem": stem, "ext": ext}), "stems")
    ranked = with_rank(named, [F.col(c) for c in order_by], ["_stem"], "_r")
    own = named.select(F.regexp_extract("_stem", r"^(.+)_([1-9]\d{0,17})$", 1).alias("_base"),
                       F.regexp_extract("_stem", r"^(.+)_([1-9]\d{0,17})$", 2).alias("_no")).filter("_base <> ''")
    last = own.groupBy("_base").agg(F.max(F.col("_no").cast("long")).alias("_last"))
    repeated = ranked.filter("_r > 1").join(last, F.col("_stem") == F.col("_base"), "left").drop("_base")
    ranked = ranked.filter("_r = 1").withColumn("_last", F.lit(None).cast("long")).unionByName(repeated)
    number = F.coalesce("_last", F.lit(1)) + F.col("_r") - 1
    full = F.when(F.col("_r") == 1, F.col("_stem")).otherwise(F.concat_ws("_", "_stem", number.cast("string")))
    # Every format reads the names several times; the table is one narrow row per image.
    return materialise(ranked.withColumn("stem", full).drop("_stem", "_r", "_last"), "names")


def name_collisions(named: DataFrame) -> DataFrame:
    """Stems that still occur more than once (a literal ``a_2`` beside a numbered one)."""
    return named.groupBy("stem").agg(F.count("*").alias("n")).filter("n > 1")


def _shapes(annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """Annotations that are not classifications, with class index and rectangle."""
    index = classes.select("class_index", F.col("name").alias("class_name"))
    shapes = with_rect(annotations.filter("kind <> 'classification'"))
    # a row a class; the shapes are not shuffled by the few names
    return shapes.join(F.broadcast(index), "class_name", "left").withColumn("class_index", F.coalesce("class_index", F.lit(0)))


def _image_facts(images: DataFrame) -> DataFrame:
    return images.select("asset_id", "stem", "ext", "width", "height", split_of(F.col("split")).alias("split"))


def _objects(annotations: DataFrame, images: DataFrame, classes: DataFrame) -> DataFrame:
    """The shapes of the images, with image facts."""
    return _shapes(annotations, classes).join(_image_facts(images), "asset_id")


def skipped(annotations: DataFrame) -> DataFrame:
    """(asset_id, kind, n): objects left out because their geometry is missing or invalid."""
    return with_rect(annotations.filter("kind <> 'classification'")).filter("rect is null").groupBy(
        "asset_id", "kind").agg(F.count("*").alias("n"))


def _documents(lines: DataFrame, images: DataFrame, path: Column, head: Column | None = None,
               tail: Column | None = None) -> DataFrame:
    """(path, place, seq, line): head, the lines (asset_id, seq, line) and the end of each image's file.

    Without a head the piece at place 0 has no line; it says that the file exists, if only empty.
    """
    owners = images.withColumn("path", path)
    parts = [P.frame(owners, 0, head, "path"), P.body(owners, lines, "asset_id", 1, "path")]
    if tail is not None:
        parts.append(P.frame(owners, 2, tail, "path"))
    return P.joined(*parts)


def _sized(images: DataFrame) -> DataFrame:
    return images.filter("width > 0 and height > 0")


# ---- formats ------------------------------------------------------------------------------------

def yolo(images: DataFrame, annotations: DataFrame, classes: DataFrame, seq: str = "ann_key") -> DataFrame:
    """Label files: ``class cx cy w h`` per box or polygon, class and vertices per mask outline."""
    objects = _objects(annotations, images, classes).filter("rect is not null or kind = 'mask'")
    x, y, w, h = (F.col(f"rect.{c}") for c in ("x", "y", "w", "h"))
    six = "%.6f"
    box = F.format_string(f"%d {six} {six} {six} {six}", F.col("class_index"), x + w / 2, y + h / 2, w, h)
    lines = objects.filter("kind <> 'mask'").select("asset_id", F.col(seq).alias("seq"), box.alias("line"))
    if "mask" in annotations.columns:
        rings = objects.filter("kind = 'mask'").select(
            "asset_id", F.col(seq).alias("seq"), "class_index",
            F.explode_outer(mask_polygons(F.col("mask.size"), F.col("mask.counts"))).alias("ring")).filter("ring is not null")
        flat = F.transform("ring", lambda p: F.format_string(f"{six} {six}", G.clamp01(p[0]), G.clamp01(p[1])))
        lines = lines.unionByName(rings.select("asset_id", "seq", F.concat_ws(
            " ", F.col("class_index").cast("string"), F.array_join(flat, " ")).alias("line")))
    path = F.concat(split_of(F.col("split")), F.lit("/labels/"), "stem", F.lit(".txt"))
    return _documents(lines, images, path)


def data_yaml(class_names: Sequence[str]) -> str:
    names = ", ".join("'" + n.replace("'", "''") + "'" for n in class_names)
    return (f"train: train/images\nval: valid/images\ntest: test/images\n\nnc: {len(class_names)}\n"
            f"names: [{names}]\n")


def coco_images(images: DataFrame, order_by: Sequence[str] = ("asset_id",)) -> DataFrame:
    """(split, id, asset_id, file_name, width, height): ids count from 0 within each split."""
    rows = _sized(images).select(split_of(F.col("split")).alias("split"), "asset_id",
                                 F.concat("stem", "ext").alias("file_name"), "width", "height")
    return with_rank(rows, [F.col(c) for c in order_by], ["split"], "_r").withColumn(
        "id", F.col("_r") - 1).drop("_r")


def coco_categories(classes: DataFrame) -> DataFrame:
    return classes.select((F.col("class_index") + 1).alias("id"), "name", F.lit("none").alias("supercategory"))


def coco_annotations(numbered: DataFrame, images: DataFrame, annotations: DataFrame, classes: DataFrame,
                     seq: str = "ann_key", crowded: int = CROWDED) -> DataFrame:
    """(split, id, image_id, category_id, bbox, area, segmentation, iscrowd), pixels with 2 decimals.

    ``numbered`` is the result of ``coco_images``; ids are exact positions in (image, seq) order: the objects of the images
    before, by a running total over images, and the place in the image. Where an image has more than ``crowded`` objects,
    or an asset is more than one image, all objects are ranked over all partitions.
    """
    shapes = _shapes(annotations, classes).filter(has_rect(annotations))
    facts = _image_facts(_sized(images)).join(numbered.select("asset_id", F.col("id").alias("image_id")), "asset_id")
    owners = facts.join(shapes.groupBy("asset_id").agg(F.count("*").alias("_n")), "asset_id")
    owners = materialise(owners.withColumn("_copies", F.count("*").over(Window.partitionBy("asset_id"))), "coco-owners")
    plain = owners.filter((F.col("_n") > crowded) | (F.col("_copies") > 1)).limit(1).count() == 0
    if plain:
        owners = with_running_total(owners, "_n", [F.col("image_id")], ["split"], "_upto")
        owners = owners.withColumn("_before", F.col("_upto") - F.col("_n")).drop("_upto")
    owners = owners.drop("_n", "_copies")
    width, height = F.col("width"), F.col("height")
    sides = [F.round(F.col("rect.x") * width, 2), F.round(F.col("rect.y") * height, 2),
             F.round(F.col("rect.w") * width, 2), F.round(F.col("rect.h") * height, 2)]
    ring = F.flatten(F.transform(G.clamp_points(F.col("points")), lambda p: F.array(
        F.round(p[0] * width, 2), F.round(p[1] * height, 2))))
    segmentation = F.when(F.col("kind") == "polygon", F.to_json(F.array(ring))).otherwise("[]")
    area = F.round(F.element_at("bbox", 3) * F.element_at("bbox", 4), 2)
    objects = shapes.join(owners, "asset_id")
    if "mask" in annotations.columns:
        segmentation = F.when(F.col("kind") == "mask", F.to_json("mask")).otherwise(segmentation)
        facts = mask_facts(F.col("mask.size"), F.col("mask.counts"))
        objects = objects.withColumn("_area", facts["area"])
        area = F.when(F.col("kind") == "mask", F.col("_area").cast("double")).otherwise(area)
    rows = (objects.withColumns({"bbox": F.array(*sides), "segmentation": segmentation}).withColumn("area", area)
            .select("asset_id", "split", F.col(seq).alias("seq"), (F.col("class_index") + 1).alias("category_id"),
                    "bbox", "area", "segmentation", "image_id", *(["_before"] if plain else [])))
    order = [F.col(c) for c in ("seq", "category_id", "bbox", "segmentation")]
    if plain:  # the rows of an asset lie together after the join
        place = F.col("_before") + F.row_number().over(Window.partitionBy("asset_id").orderBy(*order))
        ranked = rows.withColumn("_r", place)
    else:
        ranked = with_rank(rows, [F.col("image_id"), *order], ["split"], "_r")
    return ranked.select("split", (F.col("_r") - 1).alias("id"), "image_id", "category_id", "bbox", "area",
                         "segmentation", F.lit(0).alias("iscrowd"))


def yolo_dataset(images: DataFrame, annotations: DataFrame, classes: DataFrame, seq: str = "ann_key") -> DataFrame:
    """Pieces of the label files and of ``data.yaml``, which names the classes in order of their index."""
    names = [r["name"] for r in classes.orderBy("class_index").collect()]  # a row a class
    labels = yolo(images, annotations, classes, seq)
    yaml = images.sparkSession.range(1).select(F.lit("data.yaml").alias("path"))
    return P.joined(labels, P.frame(yaml, 0, F.lit(data_yaml(names).rstrip("\n")), "path"))


def _split_path(name: str) -> Column:
    return F.concat("split", F.lit(f"/_annotations.{name}.json"))


def coco_documents(images: DataFrame, annotations: DataFrame, classes: DataFrame, seq: str = "ann_key") -> DataFrame:
    """(path, place, seq, line): pieces of one COCO document per split."""
    numbered = coco_images(images)
    numbered = materialise(numbered, "coco-images")
    shapes = coco_annotations(numbered, images, annotations, classes, seq)
    splits = numbered.select("split").distinct().withColumn("path", _split_path("coco"))
    image_lines = numbered.select(_split_path("coco").alias("path"), F.col("id").alias("seq"),
                                  F.to_json(F.struct("id", "file_name", "width", "height")).alias("line"))
    shape = F.concat(F.lit('{"id":'), "id", F.lit(',"image_id":'), "image_id", F.lit(',"category_id":'), "category_id", F.lit(',"bbox":'),
                     F.to_json("bbox"), F.lit(',"area":'), F.col("area").cast("string"), F.lit(',"segmentation":'), "segmentation",
                     F.lit(',"iscrowd":'), "iscrowd", F.lit("}"))
    shape_lines = shapes.select(_split_path("coco").alias("path"), F.col("id").alias("seq"), shape.alias("line"))
    named = coco_categories(classes).agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "name", "supercategory")))).alias("named"))
    tails = splits.withColumn("named", F.lit(named.first()["named"]))  # a row a class
    return P.joined(P.frame(splits, 0, F.lit('{"images":['), "path"), P.body(splits, P.separated(image_lines, "path"), "path", 1, "path"),
                    P.frame(splits, 2, F.lit('],"annotations":['), "path"), P.body(splits, P.separated(shape_lines, "path"), "path", 3, "path"),
                    P.frame(tails, 4, F.concat(F.lit('],"categories":'), "named", F.lit("}")), "path"))


def createml_documents(images: DataFrame, annotations: DataFrame, classes: DataFrame, seq: str = "ann_key") -> DataFrame:
    """(path, place, seq, line): pieces of one CreateML document, a list of records, per split."""
    records = materialise(createml(images, annotations, classes, seq).withColumn("path", _split_path("createml")), "createml")
    first = records.groupBy("path").agg(F.min("image").alias("first"))
    glued = records.join(first, "path").withColumn("line", F.when(
        (F.col("place") == 0) & (F.col("image") > F.col("first")), F.concat(F.lit(","), "line")).otherwise(F.col("line")))
    body = glued.select("path", F.lit(1).alias("place"), F.struct("image", F.col("place").alias("part"), "seq").alias("seq"), "line")
    return P.joined(P.frame(first, 0, F.lit("["), "path"), body, P.frame(first, 2, F.lit("]"), "path"))


def _corners(low_x: int, low_y: int, min_side: int) -> dict[str, Column]:
    """Integer pixel corners inside the image, half-even rounding, never closer than ``min_side``."""
    width, height = F.col("width").cast("int"), F.col("height").cast("int")
    x, y = F.col("rect.x"), F.col("rect.y")

    def whole(c: Column) -> Column:
        return F.bround(c).cast("int")

    xmin, ymin = whole(x * width), whole(y * height)
    if min_side:
        xmin, ymin = F.least(width - 1, xmin), F.least(height - 1, ymin)
    xmin, ymin = F.greatest(F.lit(low_x), xmin), F.greatest(F.lit(low_y), ymin)
    xmax = F.greatest(xmin + min_side, F.least(width, whole((x + F.col("rect.w")) * width)))
    ymax = F.greatest(ymin + min_side, F.least(height, whole((y + F.col("rect.h")) * height)))
    return {"xmin": xmin, "ymin": ymin, "xmax": xmax, "ymax": ymax}


def voc(images: DataFrame, annotations: DataFrame, classes: DataFrame, seq: str = "ann_key") -> DataFrame:
    """One XML document per sized image."""
    objects = _objects(annotations, _sized(images), classes).filter(has_rect(annotations))
    box = _corners(1, 1, 0)
    sides = F.concat(*[F.concat(F.lit(f"<{k}>"), v.cast("string"), F.lit(f"</{k}>")) for k, v in box.items()])
    node = F.concat(F.lit("<object><name>"), xml_escape(F.coalesce("class_name", F.lit(""))),
                    F.lit("</name><pose>Unspecified</pose><truncated>0</truncated><difficult>0</difficult><bndbox>"),
                    sides, F.lit("</bndbox></object>"))
    lines = objects.select("asset_id", F.col(seq).alias("seq"), node.alias("line"))
    split = split_of(F.col("split"))
    head = F.concat(F.lit("<annotation><folder>"), split, F.lit("</folder><filename>"),
                    xml_escape(F.concat("stem", "ext")), F.lit("</filename><size><width>"), F.col("width").cast("string"),
                    F.lit("</width><height>"), F.col("height").cast("string"), F.lit("</height><depth>3</depth></size>"))
    return _documents(lines, _sized(images), F.concat(split, F.lit("/"), "stem", F.lit(".xml")), head,
                      F.lit("</annotation>"))


def classification(images: DataFrame, annotations: DataFrame, seq: str = "ann_key") -> DataFrame:
    """(filename, split, target, seq, label): manifest rows, one a label; an image without labels has one with NULL.

    The first label names the target folder.
    """
    labels = annotations.filter("kind = 'classification' and class_name <> ''").select(
        "asset_id", F.col(seq).alias("seq"), F.col("class_name").alias("label"))
    first = labels.groupBy("asset_id").agg(F.min_by("label", F.struct("seq", "label")).alias("first"))
    rows = images.join(first, "asset_id", "left").join(labels, "asset_id", "left")
    folder = F.trim(F.regexp_replace(F.coalesce("first", F.lit("")), r"[/\\]", "_"))
    folder = F.when(folder == "", UNLABELED).otherwise(folder)
    name = F.concat("stem", "ext")
    return rows.select(name.alias("filename"), split_of(F.col("split")).alias("split"),
                       F.concat_ws("/", split_of(F.col("split")), folder, name).alias("target"), "seq", "label")


def createml(images: DataFrame, annotations: DataFrame, classes: DataFrame, seq: str = "ann_key") -> DataFrame:
    """(split, image, place, seq, line): pieces of one JSON record per image; coordinates are box centres in pixels."""
    objects = _objects(annotations, _sized(images), classes).filter(has_rect(annotations))
    x, y, w, h = (F.col(f"rect.{c}") for c in ("x", "y", "w", "h"))
    width, height = F.col("width"), F.col("height")
    place = F.struct(F.round((x + w / 2) * width, 2).alias("x"), F.round((y + h / 2) * height, 2).alias("y"),
                     F.round(w * width, 2).alias("width"), F.round(h * height, 2).alias("height"))
    lines = objects.select("asset_id", F.col(seq).alias("seq"), F.to_json(F.struct(
        F.col("class_name").alias("label"), place.alias("coordinates"))).alias("line"))
    owners = _sized(images).select("asset_id", split_of(F.col("split")).alias("split"), F.concat("stem", "ext").alias("image"))
    head = F.concat(F.lit('{"image":'), json_text(F.col("image")), F.lit(',"annotations":['))
    return P.joined(P.frame(owners, 0, head, "split", "image"),
                    P.body(owners, P.separated(lines, "asset_id"), "asset_id", 1, "split", "image"),
                    P.frame(owners, 2, F.lit("]}"), "split", "image"))


def reduced_shapes(annotations: DataFrame) -> DataFrame:
    """(reduced): polygons and masks that box-only formats reduce to rectangles."""
    return annotations.agg(F.count_if(F.col("kind").isin("polygon", "mask")).alias("reduced"))


def tfcsv(images: DataFrame, annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """(split, filename, width, height, class, xmin, ymin, xmax, ymax): one row per object."""
    objects = _objects(annotations, _sized(images), classes).filter(has_rect(annotations))
    box = _corners(0, 0, 1)
    return objects.select("split", F.concat("stem", "ext").alias("filename"), F.col("width").cast("int").alias("width"),
                          F.col("height").cast("int").alias("height"), F.col("class_name").alias("class"),
                          *[v.alias(k) for k, v in box.items()])


def label_map(class_names: Sequence[str]) -> str:
    return "".join(f'item {{\n  id: {i}\n  name: "{n}"\n}}\n\n' for i, n in enumerate(class_names, 1))


def segmentation_classes(class_names: Sequence[str]) -> str:
    return "\n".join(["0: background"] + [f"{i}: {n}" for i, n in enumerate(class_names, 1)]) + "\n"
