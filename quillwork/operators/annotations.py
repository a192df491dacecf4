"""Image annotation tables: checks, analytics, queue, tags, splits, state.

Annotations are rows (ann_key, asset_id, class_name, kind, x, y, w, h, points[, mask]) with normalised
geometry; assets are (asset_id, dataset_id, file_name, width, height, created_at); states are
(asset_id, dataset_id, status, split) and may be missing, which means ``unannotated``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import collapse
from .masks import mask_facts
from .ranking import Pages, page, with_neighbors, with_rank

STATUSES = ("unannotated", "annotated", "approved", "rejected")
SPLITS = ("train", "valid", "test")
KINDS = ("bbox", "polygon", "mask", "classification")
# Size limits as shares of the frame, tag limits, class colours by position.
SIZE_LIMITS = ((0.003, "tiny"), (0.03, "small"), (0.15, "medium"))
MAX_TAG_CHARS = 64
MAX_TAGS = 40
PALETTE = ("#f97316", "#3b82f6", "#22c55e", "#eab308", "#a855f7", "#ef4444",
           "#14b8a6", "#f43f5e", "#8b5cf6", "#84cc16", "#06b6d4", "#d946ef")


# ---- geometry -----------------------------------------------------------------------------------

def validate(annotations: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Cleaned geometry plus ``reason`` (NULL when usable); boxes are trimmed, points clamped.

    A mask column is checked only when there is one. With ``images`` (asset_id, width, height) a mask must have the
    size of its image where that is known.
    """
    x, y, w, h, points = (F.col(c) for c in ("x", "y", "w", "h", "points"))
    x0, y0 = G.clamp01(x), G.clamp01(y)
    x1, y1 = G.clamp01(x + w), G.clamp01(y + h)
    box, polygon = F.col("kind") == "bbox", F.col("kind") == "polygon"
    complete = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    reason = (F.when(~F.col("kind").isin(*KINDS), "unknown kind")
              .when(box & ~complete, "box sides missing")
              .when(box & ((x1 - x0 <= 0) | (y1 - y0 <= 0)), "box outside the image")
              .when(polygon & (F.coalesce(F.size(points), F.lit(0)) < 3), "polygon needs 3 points"))
    if "mask" in annotations.columns:
        facts = mask_facts(F.col("mask.size"), F.col("mask.counts"))
        annotations = annotations.withColumn("_m", facts)
        masked = F.col("kind") == "mask"
        reason = reason.when(masked & F.col("mask").isNull(), "mask missing").when(
            masked & F.col("_m.problem").isNotNull(), F.col("_m.problem"))
        if images is not None:
            sizes = images.select(F.col("asset_id").alias("_a"), F.array(F.col("height").cast("int"), F.col("width").cast("int")).alias("_s"))
            annotations = annotations.join(sizes, F.col("asset_id") == F.col("_a"), "left")
            known = ~F.exists("_s", lambda v: v.isNull())
            reason = reason.when(masked & known & (F.col("_s") != F.col("mask.size")), "mask size differs from the image")
    clean = {"x": F.when(box, x0), "y": F.when(box, y0), "w": F.when(box, x1 - x0), "h": F.when(box, y1 - y0),
             "points": F.when(polygon, G.clamp_points(points))}
    return annotations.withColumn("reason", reason).withColumns(clean).drop("_m", "_a", "_s")


def with_rect(annotations: DataFrame, name: str = "rect") -> DataFrame:
    """The normalised rectangle of a box, polygon or mask; NULL without usable geometry."""
    points = F.col("points")
    rect = (F.when(F.col("kind") == "bbox", G.bbox_rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
            .when((F.col("kind") == "polygon") & (F.size(points) >= 2), G.bounds(G.clamp_points(points))))
    if "mask" in annotations.columns:
        annotations = annotations.withColumn("_m", mask_facts(F.col("mask.size"), F.col("mask.counts")))
        height, width = (F.get(F.col("mask.size"), F.lit(i)) for i in (0, 1))
        m = F.col("_m")
        framed = G.rect(m["x"] / width, m["y"] / height, m["w"] / width, m["h"] / height)
        rect = rect.when((F.col("kind") == "mask") & (m["w"] > 0) & (m["h"] > 0), framed)
    return annotations.withColumn(name, rect).drop("_m")


def has_rect(annotations: DataFrame) -> Column:
    """Whether ``with_rect`` gives these annotations a rectangle; without masks told by the sides and points alone."""
    if "mask" in annotations.columns:
        return F.col("rect").isNotNull()
    sides = [F.col(c).isNotNull() for c in ("x", "y", "w", "h")]
    return ((F.col("kind") == "bbox") & sides[0] & sides[1] & sides[2] & sides[3]) | (
        (F.col("kind") == "polygon") & (F.size("points") >= 2))


def polygon_facts(annotations: DataFrame) -> DataFrame:
    """(ann_key, area, x, y, w, h) of the polygons."""
    points = F.col("points")
    found = annotations.filter("kind = 'polygon'").withColumn("_b", G.bounds(points))
    return found.select("ann_key", G.polygon_area(points).alias("area"), "_b.*")


def crop_remap(annotations: DataFrame, crops: DataFrame) -> DataFrame:
    """Annotations of cropped assets in the new frame, with ``kept`` false where nothing is left.

    ``crops`` holds (asset_id, cx, cy, cw, ch), normalised.
    """
    out = annotations.join(crops, "asset_id")
    cx, cy, cw, ch = (F.col(c) for c in ("cx", "cy", "cw", "ch"))
    nx, ny = (F.col("x") - cx) / cw, (F.col("y") - cy) / ch
    x0, y0 = F.greatest(F.lit(0.0), nx), F.greatest(F.lit(0.0), ny)
    x1, y1 = F.least(F.lit(1.0), nx + F.col("w") / cw), F.least(F.lit(1.0), ny + F.col("h") / ch)
    moved = F.transform("points", lambda p: F.array((F.get(p, F.lit(0)) - cx) / cw, (F.get(p, F.lit(1)) - cy) / ch))
    inside = F.exists(moved, lambda p: F.get(p, F.lit(0)).between(0, 1) & F.get(p, F.lit(1)).between(0, 1))
    box, polygon = F.col("kind") == "bbox", F.col("kind") == "polygon"
    kept = F.when(box, (x1 > x0) & (y1 > y0)).when(polygon, inside).otherwise(True)
    return out.select(*[c for c in annotations.columns if c not in ("x", "y", "w", "h", "points")],
                      F.when(box & kept, x0).alias("x"), F.when(box & kept, y0).alias("y"),
                      F.when(box & kept, x1 - x0).alias("w"), F.when(box & kept, y1 - y0).alias("h"),
                      F.when(polygon & kept, G.clamp_points(moved)).alias("points"), kept.alias("kept"))


# ---- analytics ----------------------------------------------------------------------------------

def _unpivot(wide: DataFrame, section: str) -> DataFrame:
    rows = [F.struct(F.lit(section).alias("section"), F.lit(c).alias("name"), F.col(c).cast("long").alias("count"))
            for c in wide.columns]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def summary(assets: DataFrame, states: DataFrame) -> DataFrame:
    """(section, name, count): images per status and per split, from one aggregate over each table."""
    facts = states.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES[1:]],
                       *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    total = assets.agg(F.count("*").alias("total"))
    wide = facts.unionByName(total, allowMissingColumns=True)
    wide = wide.agg(*[F.max(c).alias(c) for c in wide.columns])
    status = wide.select("total", *STATUSES[1:], (F.col("total") - sum((F.col(s) for s in STATUSES[1:]), F.lit(0)))
                         .alias("unannotated"))
    split = wide.select(*SPLITS, (F.col("total") - sum((F.col(s) for s in SPLITS), F.lit(0))).alias("unassigned"))
    return _unpivot(status, "status").unionAll(_unpivot(split, "split"))


def class_balance(annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_index, name, annotations, images), unused classes included.

    Pairs (class, image) are counted first, so a dominant class is spread over its images.
    """
    pairs = annotations.groupBy("class_name", "asset_id").agg(F.count("*").alias("n"))
    used = pairs.groupBy("class_name").agg(F.sum("n").alias("annotations"), F.count("*").alias("images"))
    zero = F.lit(0).cast("long")
    return classes.join(used, F.col("name") == F.col("class_name"), "left").select(
        "class_index", "name", F.coalesce("annotations", zero).alias("annotations"),
        F.coalesce("images", zero).alias("images"))


def kind_mix(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("kind").agg(F.count("*").alias("count"))


def density(annotations: DataFrame) -> DataFrame:
    """(bucket, images): images by number of annotations."""
    per_image = annotations.groupBy("asset_id").agg(F.count("*").alias("n"))
    n = F.col("n")
    bucket = (F.when(n <= 2, n.cast("string")).when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 25, "11-25")
              .otherwise("26+"))
    return per_image.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("images"))


def sizes(annotations: DataFrame) -> DataFrame:
    """(bucket, count): boxes by share of the frame; shapes without box sides are ``unsized``."""
    area = F.col("w") * F.col("h")
    bucket = F.when(area.isNull(), "unsized")
    for limit, name in SIZE_LIMITS:
        bucket = bucket.when(area < limit, name)
    sized = annotations.filter("kind <> 'classification' or (w is not null and h is not null)")
    return sized.groupBy(bucket.otherwise("large").alias("bucket")).agg(F.count("*").alias("count"))


def split_status(states: DataFrame) -> DataFrame:
    """One row per split (``unassigned`` without one) with a count per status."""
    return states.groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def coverage(assets: DataFrame, states: DataFrame, annotations: DataFrame) -> DataFrame:
    """(total, labelled, empty, annotations, average): touched images without annotations are empty."""
    total = assets.agg(F.count("*").alias("total"))
    touched = states.agg(F.count_if(F.col("status") != "unannotated").alias("touched"))
    marked = annotations.groupBy("asset_id").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("labelled"), F.coalesce(F.sum("n"), F.lit(0)).alias("annotations"))
    wide = total.unionByName(touched, True).unionByName(marked, True)
    wide = wide.agg(*[F.max(c).alias(c) for c in wide.columns])
    return wide.select("total", "labelled", F.greatest(F.col("touched") - F.col("labelled"), F.lit(0)).alias("empty"),
                       "annotations", F.round(F.when(F.col("labelled") > 0, F.col("annotations") / F.col("labelled"))
                                              .otherwise(0.0), 2).alias("average"))


def findings(assets: DataFrame, states: DataFrame, annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """(level, finding, subject, value) over the small report tables."""
    balance = class_balance(annotations, classes)
    used = balance.filter("annotations > 0").agg(
        F.max("annotations").alias("most"), F.min("annotations").alias("least"),
        F.min_by("name", F.struct("annotations", "class_index")).alias("rarest"))

    def row(df: DataFrame, level: str, finding: str, subject: Column, value: Column) -> DataFrame:
        return df.select(F.lit(level).alias("level"), F.lit(finding).alias("finding"), subject.cast("string").alias("subject"),
                         value.cast("double").alias("value"))

    cover = coverage(assets, states, annotations)
    box = sizes(annotations).filter("bucket <> 'unsized'").agg(
        F.sum(F.when(F.col("bucket") == "tiny", F.col("count")).otherwise(0)).alias("tiny"), F.sum("count").alias("all"))
    none = F.lit(None)
    parts = [
        row(used.filter("most / least >= 10"), "warn", "imbalance", F.col("rarest"), F.floor(F.col("most") / F.col("least"))),
        row(balance.filter("annotations between 1 and 9"), "warn", "few examples", F.col("name"), F.col("annotations")),
        row(balance.filter("annotations = 0"), "info", "unused class", F.col("name"), F.lit(0)),
        row(cover.filter("empty > 0"), "info", "reviewed without annotations", none, F.col("empty")),
        row(box.filter("tiny / all > 0.3"), "warn", "many tiny boxes", none, F.round(F.col("tiny") / F.col("all") * 100)),
        row(cover.filter("labelled / total < 0.5"), "info", "mostly unlabelled", none, F.col("labelled"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


# ---- queue and tags -----------------------------------------------------------------------------

def with_state(assets: DataFrame, states: DataFrame) -> DataFrame:
    joined = assets.join(states.select("asset_id", "status", "split"), "asset_id", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("unannotated")))


BY_AGE = ["created_at", "asset_id"]


def queued(assets: DataFrame, states: DataFrame, status: str | None = None, split: str | None = None) -> DataFrame:
    rows = with_state(assets, states)
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.filter(F.col("split") == split) if split else rows


def queue(assets: DataFrame, states: DataFrame, annotations: DataFrame, status: str | None = None,
          split: str | None = None, skip: int = 0, limit: int = 100, pages: Pages | None = None) -> DataFrame:
    """One page (at most 500 rows) in created order; only the page's annotations are counted."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1..500")
    shown = page(queued(assets, states, status, split), BY_AGE, skip, limit, "asset_id", pages)
    counts = annotations.join(F.broadcast(shown.select("asset_id")), "asset_id", "left_semi").groupBy("asset_id").agg(
        F.count("*").alias("annotation_count"))
    return shown.join(counts, "asset_id", "left").withColumn(
        "annotation_count", F.coalesce("annotation_count", F.lit(0)))


def neighbors(assets: DataFrame, states: DataFrame | None = None, status: str | None = None,
              split: str | None = None) -> DataFrame:
    """(dataset_id, asset_id, prev_id, next_id) in queue order under the same filters."""
    rows = assets
    if states is not None and (status or split):
        rows = with_state(assets, states)
        if status:
            rows = rows.filter(F.col("status") == status)
        if split:
            rows = rows.filter(F.col("split") == split)
    return with_neighbors(rows.select("dataset_id", "asset_id", "created_at"), "asset_id",
                          [F.col("created_at"), F.col("asset_id")], ["dataset_id"]).drop("created_at")


def normalize_tags(tags: Column) -> Column:
    """Trimmed, collapsed, lower-cased tags without blanks and repeats, in order; NULL when there are too many."""
    clean = F.transform(tags, lambda t: F.substring(F.lower(collapse(t)), 1, MAX_TAG_CHARS))
    kept = F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != "")))
    return F.when(F.size(kept) <= MAX_TAGS, kept)


def tag_counts(tagged: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, images), most frequent first."""
    flat = tagged.select("asset_id", F.explode(F.array_distinct(F.col(tags))).alias("tag"))
    return flat.groupBy("tag").agg(F.count("*").alias("images")).orderBy(F.desc("images"), "tag")


# ---- state --------------------------------------------------------------------------------------

def bulk_state(states: DataFrame, asset_ids: DataFrame, status: str, only_from: str | None = None) -> DataFrame:
    """States with the new status where a row exists; ``updated`` marks the changed rows."""
    keys = asset_ids.select("asset_id").distinct().withColumn("_k", F.lit(True))
    hit = F.coalesce(F.col("_k"), F.lit(False))
    if only_from:
        hit = hit & (F.col("status") == only_from)
    joined = states.join(keys, "asset_id", "left").withColumn("updated", hit)
    return joined.withColumn("status", F.when(F.col("updated"), status).otherwise(F.col("status"))).drop("_k")


def set_state(states: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert of status and split; ``changes`` has (asset_id, dataset_id, new_status, new_split, set_split).

    A missing status keeps the old one; the split changes only where ``set_split`` is true, also to NULL.
    """
    c = changes.select("asset_id", F.col("dataset_id").alias("_d"), "new_status", "new_split", "set_split")
    out = states.join(c, "asset_id", "full_outer")
    return out.select(
        "asset_id", F.coalesce("dataset_id", "_d").alias("dataset_id"),
        F.coalesce("new_status", "status", F.lit("unannotated")).alias("status"),
        F.when(F.col("set_split"), F.col("new_split")).otherwise(F.col("split")).alias("split"))


def resolve_state(saved: DataFrame, states: DataFrame) -> DataFrame:
    """Status after a save (asset_id, explicit_status, annotation_count)."""
    joined = saved.join(states.select("asset_id", "status"), "asset_id", "left")
    status = (F.when(F.col("explicit_status").isNotNull(), F.col("explicit_status"))
              .when(F.col("annotation_count") == 0, "unannotated")
              .when(F.col("status").isin("approved", "rejected"), F.col("status")).otherwise("annotated"))
    return joined.select("asset_id", status.alias("status"))


def replace(current: DataFrame, replacement: DataFrame, asset_ids: DataFrame, classes: DataFrame
            ) -> tuple[DataFrame, DataFrame]:
    """(annotations after the save, rejected rows of foreign classes)."""
    names = classes.select(F.col("name").alias("class_name")).distinct()
    good = replacement.join(names, "class_name", "left_semi").select(*replacement.columns)
    bad = replacement.join(names, "class_name", "left_anti").select(*replacement.columns)
    rest = current.join(asset_ids.select("asset_id").distinct(), "asset_id", "left_anti").select(*current.columns)
    return rest.unionByName(good), bad


def class_table(names: DataFrame) -> DataFrame:
    """(dataset_id, name, class_index, color, next_index, clashes) in (order, name) order per dataset."""
    ranked = with_rank(names, [F.col("order_index"), F.col("name")], ["dataset_id"], "_r")
    clash = names.groupBy("dataset_id", F.lower("name").alias("_low")).agg(F.count("*").alias("clashes"))
    top = names.groupBy("dataset_id").agg((F.max("order_index") + 1).alias("next_index"))
    color = F.element_at(F.array(*[F.lit(c) for c in PALETTE]), ((F.col("_r") - 1) % len(PALETTE) + 1).cast("int"))
    joined = ranked.withColumn("_low", F.lower("name")).join(clash, ["dataset_id", "_low"]).join(top, "dataset_id")
    return joined.select("dataset_id", "name", (F.col("_r") - 1).alias("class_index"),
                         color.alias("color"), "next_index",
                         (F.col("clashes") - 1).alias("clashes"))


# ---- splitting ----------------------------------------------------------------------------------

def split_sizes(n: Column, ratios: dict[str, float]) -> dict[str, Column]:
    """Exact sizes by largest remainder; a zero ratio gets none, a surplus goes round in turns."""
    whole = {s: F.floor(n * F.lit(float(r))) for s, r in ratios.items()}
    live = [s for s, r in ratios.items() if r > 0]
    left = n - sum(whole.values(), F.lit(0))
    rest = {s: n * F.lit(float(ratios[s])) - whole[s] for s in live}
    extra = F.greatest(left - len(live), F.lit(0))
    out = {}
    for s in ratios:
        if s not in live:
            out[s] = whole[s]
            continue
        ahead = sum((F.when((rest[o] > rest[s]) | ((rest[o] == rest[s]) & F.lit(o > s)), 1).otherwise(0)
                     for o in live if o != s), F.lit(0))
        turn = len(live) - 1 - live.index(s)
        rounds = F.floor(extra / len(live)) + F.when(extra % len(live) > turn, 1).otherwise(0)
        out[s] = whole[s] + F.when(ahead < left, 1).otherwise(0) + rounds
    return out


def auto_split(assets: DataFrame, states: DataFrame, ratios: Sequence[float] = (0.7, 0.2, 0.1), seed: int = 42,
               only_annotated: bool = False) -> DataFrame:
    """(asset_id, dataset_id, status, split): exact sizes per dataset, stable for a seed, status kept.

    Images are ranked by a seeded hash with the distributed rank, so one huge dataset is no bottleneck.
    """
    if abs(sum(ratios) - 1.0) > 0.01:
        raise ValueError("ratios must sum to 1")
    rows = with_state(assets.select("asset_id", "dataset_id"), states)
    if only_annotated:
        rows = rows.filter(F.col("status").isin("annotated", "approved"))
    keyed = rows.select("asset_id", "dataset_id", "status", F.md5(
        F.concat_ws(":", F.lit(str(seed)), F.col("asset_id").cast("string"))).alias("_h"))
    ranked = with_rank(keyed, [F.col("_h"), F.col("asset_id")], ["dataset_id"], "_r")
    totals = rows.groupBy("dataset_id").agg(F.count("*").alias("_n"))
    size = split_sizes(F.col("_n"), dict(zip(SPLITS, ratios)))
    totals = totals.select("dataset_id", size["train"].alias("_a"), (size["train"] + size["valid"]).alias("_b"))
    split = F.when(F.col("_r") <= F.col("_a"), "train").when(F.col("_r") <= F.col("_b"), "valid").otherwise("test")
    return ranked.join(totals, "dataset_id").select("asset_id", "dataset_id", "status", split.alias("split"))
