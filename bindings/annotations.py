"""Image annotation tables on orders (images) and lineitem (annotations)."""

from pyspark.sql import functions as F

from quillwork.operators import annotations as A
from quillwork.operators import masks as M
from quillwork.operators.ranking import store_pages

from .base import INPUTS, load, register


def points(x="px", y="py"):
    x, y = F.col(x), F.col(y)
    return F.when(F.col("kind") == "polygon", F.array(F.array(x, y), F.array(x + 0.2, y), F.array(x, y + 0.3)))


def anns(spark, sf):
    return load(spark, sf, "annotations").withColumn("points", points()).drop("px", "py")


def assets(spark, sf):
    return load(spark, sf, "assets")


def states(spark, sf):
    return load(spark, sf, "states")


def classes(spark, sf):
    return load(spark, sf, "classes")


def flat(column="points"):
    """Points as text, rounded, for comparison."""
    return F.array_join(F.transform(F.flatten(column), lambda v: F.format_number(v, 4)), " ").alias("points")


def flat_sql(*pairs: str) -> str:
    return " || ' ' || ".join(f"format('{{:.4f}}', {p})" for p in pairs)


def c01(e: str) -> str:
    return f"greatest(0, least(1, {e}))"


@register("ann_validate", f"""
    WITH b AS (SELECT *, {c01('x')} AS x0, {c01('y')} AS y0, {c01('x + w')} AS x1, {c01('y + h')} AS y1 FROM annotations)
    SELECT ann_key, CASE WHEN kind = 'bbox' AND (x1 - x0 <= 0 OR y1 - y0 <= 0) THEN 'box outside the image' END AS reason,
           CASE WHEN kind = 'bbox' THEN round(x0, 6) END AS x, CASE WHEN kind = 'bbox' THEN round(y0, 6) END AS y,
           CASE WHEN kind = 'bbox' THEN round(x1 - x0, 6) END AS w, CASE WHEN kind = 'bbox' THEN round(y1 - y0, 6) END AS h,
           CASE WHEN kind = 'polygon' THEN {flat_sql(c01('px'), c01('py'), c01('px + 0.2'), c01('py'), c01('px'), c01('py + 0.3'))}
           END AS points FROM b""")
def ann_validate(spark, sf):
    out = A.validate(anns(spark, sf))
    return out.select("ann_key", "reason", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")], flat())


@register("ann_norm_rect", f"""
    SELECT ann_key, round(CASE kind WHEN 'bbox' THEN {c01('x')} WHEN 'polygon' THEN {c01('px')} END, 6) AS x,
           round(CASE kind WHEN 'bbox' THEN {c01('y')} WHEN 'polygon' THEN {c01('py')} END, 6) AS y,
           round(CASE kind WHEN 'bbox' THEN greatest(0, least(w, 1 - {c01('x')}))
                 WHEN 'polygon' THEN {c01('px + 0.2')} - {c01('px')} END, 6) AS w,
           round(CASE kind WHEN 'bbox' THEN greatest(0, least(h, 1 - {c01('y')}))
                 WHEN 'polygon' THEN {c01('py + 0.3')} - {c01('py')} END, 6) AS h FROM annotations""")
def ann_norm_rect(spark, sf):
    out = A.with_rect(anns(spark, sf))
    return out.select("ann_key", *[F.round(f"rect.{c}", 6).alias(c) for c in ("x", "y", "w", "h")])


@register("ann_polygon_area", """SELECT ann_key, round(CAST(0.03 AS DOUBLE), 6) AS area, round(px, 6) AS x, round(py, 6) AS y,
    round(px + 0.2 - px, 6) AS w, round(py + 0.3 - py, 6) AS h FROM annotations WHERE kind = 'polygon'""")
def ann_polygon_area(spark, sf):
    out = A.polygon_facts(anns(spark, sf))
    return out.select("ann_key", *[F.round(c, 6).alias(c) for c in ("area", "x", "y", "w", "h")])


INPUTS["crops"] = """
    SELECT o_orderkey AS asset_id, CAST(0.25 AS DOUBLE) AS cx, CAST(0.125 AS DOUBLE) AS cy, CAST(0.5 AS DOUBLE) AS cw,
           CAST(0.625 AS DOUBLE) AS ch FROM {orders} WHERE o_orderkey % 5 = 0"""


@register("ann_crop_remap", """
    WITH b AS (SELECT a.*, (x - cx) / cw AS nx, (y - cy) / ch AS ny, w / cw AS nw, h / ch AS nh, (px - cx) / cw AS ax,
               (px + 0.2 - cx) / cw AS bx, (py - cy) / ch AS ay, (py + 0.3 - cy) / ch AS cy2
               FROM annotations a JOIN crops USING (asset_id)),
    k AS (SELECT *, greatest(0, nx) AS x0, greatest(0, ny) AS y0, least(1, nx + nw) AS x1, least(1, ny + nh) AS y1 FROM b),
    r AS (SELECT *, CASE kind WHEN 'bbox' THEN x1 > x0 AND y1 > y0
            WHEN 'polygon' THEN (ax BETWEEN 0 AND 1 AND ay BETWEEN 0 AND 1) OR (bx BETWEEN 0 AND 1 AND ay BETWEEN 0 AND 1)
                 OR (ax BETWEEN 0 AND 1 AND cy2 BETWEEN 0 AND 1) ELSE true END AS kept FROM k)
    SELECT ann_key, kept, CASE WHEN kind = 'bbox' AND kept THEN round(x0, 6) END AS x,
           CASE WHEN kind = 'bbox' AND kept THEN round(y0, 6) END AS y,
           CASE WHEN kind = 'bbox' AND kept THEN round(x1 - x0, 6) END AS w,
           CASE WHEN kind = 'bbox' AND kept THEN round(y1 - y0, 6) END AS h FROM r""")
def ann_crop_remap(spark, sf):
    out = A.crop_remap(anns(spark, sf), load(spark, sf, "crops"))
    return out.select("ann_key", "kept", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")])


# ---- analytics ----------------------------------------------------------------------------------

def counts_sql(section: str, column: str, names: list[str], rest: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    parts = [f"SELECT '{section}' AS section, '{n}' AS name, count(*) AS count FROM states WHERE {column} = '{n}'" for n in names]
    parts.append(f"""SELECT '{section}', '{rest}', (SELECT count(*) FROM assets) -
        (SELECT count(*) FROM states WHERE {column} IN ({listed}))""")
    return " UNION ALL ".join(parts)


@register("ann_summary", "SELECT 'status' AS section, 'total' AS name, count(*) AS count FROM assets UNION ALL "
          + counts_sql("status", "status", ["annotated", "approved", "rejected"], "unannotated") + " UNION ALL "
          + counts_sql("split", "split", ["train", "valid", "test"], "unassigned"))
def ann_summary(spark, sf):
    return A.summary(assets(spark, sf), states(spark, sf))


@register("ann_class_balance", """SELECT class_index, name, count(a.ann_key) AS annotations, count(DISTINCT asset_id) AS images
    FROM classes LEFT JOIN annotations a ON class_name = name GROUP BY class_index, name""")
def ann_class_balance(spark, sf):
    return A.class_balance(anns(spark, sf), classes(spark, sf))


@register("ann_kind_mix", "SELECT kind, count(*) AS count FROM annotations GROUP BY kind")
def ann_kind_mix(spark, sf):
    return A.kind_mix(load(spark, sf, "annotations"))


@register("ann_density", """SELECT CASE WHEN n <= 2 THEN CAST(n AS VARCHAR) WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10'
    WHEN n <= 25 THEN '11-25' ELSE '26+' END AS bucket, count(*) AS images
    FROM (SELECT count(*) AS n FROM annotations GROUP BY asset_id) p GROUP BY bucket""")
def ann_density(spark, sf):
    return A.density(load(spark, sf, "annotations"))


SIZES = """SELECT CASE WHEN w * h IS NULL THEN 'unsized' WHEN w * h < 0.003 THEN 'tiny' WHEN w * h < 0.03 THEN 'small'
    WHEN w * h < 0.15 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS count FROM annotations
    WHERE kind <> 'classification' GROUP BY bucket"""


@register("ann_sizes", SIZES)
def ann_sizes(spark, sf):
    return A.sizes(load(spark, sf, "annotations"))


@register("ann_split_status", """SELECT coalesce(split, 'unassigned') AS split,
    count(*) FILTER (status = 'unannotated') AS unannotated, count(*) FILTER (status = 'annotated') AS annotated,
    count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected
    FROM states GROUP BY 1""")
def ann_split_status(spark, sf):
    return A.split_status(states(spark, sf))


COVER = """SELECT (SELECT count(*) FROM assets) AS total, count(DISTINCT asset_id) AS labelled,
    greatest((SELECT count(*) FROM states WHERE status <> 'unannotated') - count(DISTINCT asset_id), 0) AS empty,
    count(*) AS annotations, round(count(*) / count(DISTINCT asset_id), 2) AS average FROM annotations
    WHERE asset_id % 4 <> 1"""


@register("ann_empty_images", COVER)
def ann_empty_images(spark, sf):
    return A.coverage(assets(spark, sf), states(spark, sf), anns(spark, sf).filter("asset_id % 4 <> 1"))


@register("ann_findings", f"""
    WITH b AS (SELECT class_index, name, count(a.ann_key) AS n FROM classes
               LEFT JOIN annotations a ON class_name = name GROUP BY class_index, name),
    z AS ({SIZES}), c AS ({COVER.replace('WHERE asset_id % 4 <> 1', '')})
    SELECT 'warn' AS level, 'imbalance' AS finding, (SELECT name FROM b WHERE n > 0 ORDER BY n, class_index LIMIT 1) AS subject,
           floor(max(n) / min(n)) AS value FROM b WHERE n > 0 HAVING max(n) / min(n) >= 10
    UNION ALL SELECT 'warn', 'few examples', name, n FROM b WHERE n BETWEEN 1 AND 9
    UNION ALL SELECT 'info', 'unused class', name, 0 FROM b WHERE n = 0
    UNION ALL SELECT 'info', 'reviewed without annotations', NULL, empty FROM c WHERE empty > 0
    UNION ALL SELECT 'warn', 'many tiny boxes', NULL, round(t * 100) FROM (SELECT sum(count) FILTER (bucket = 'tiny') / sum(count) AS t
        FROM z WHERE bucket <> 'unsized') q WHERE t > 0.3
    UNION ALL SELECT 'info', 'mostly unlabelled', NULL, labelled FROM c WHERE labelled / total < 0.5""")
def ann_findings(spark, sf):
    return A.findings(assets(spark, sf), states(spark, sf), anns(spark, sf), classes(spark, sf))


# ---- queue and tags -----------------------------------------------------------------------------

QUEUE = """
    WITH p AS (SELECT a.*, coalesce(status, 'unannotated') AS status, split FROM assets a LEFT JOIN states s USING (asset_id)
               WHERE status = 'annotated' AND split = 'train' ORDER BY created_at, asset_id LIMIT 200 OFFSET 100)
    SELECT asset_id, file_name, status, split, (SELECT count(*) FROM annotations n WHERE n.asset_id = p.asset_id)
           AS annotation_count FROM p"""


@register("ann_queue_stored", QUEUE)
def ann_queue_stored(spark, sf):
    rows = A.queued(assets(spark, sf), states(spark, sf), "annotated", "train")
    out = A.queue(assets(spark, sf), states(spark, sf), load(spark, sf, "annotations"), "annotated", "train", 100, 200,
                  store_pages(rows, A.BY_AGE, rows_per_part=150))
    return out.select("asset_id", "file_name", "status", "split", "annotation_count")


@register("ann_queue", QUEUE)
def ann_queue(spark, sf):
    out = A.queue(assets(spark, sf), states(spark, sf), load(spark, sf, "annotations"), "annotated", "train", 100, 200)
    return out.select("asset_id", "file_name", "status", "split", "annotation_count")


@register("ann_neighbors", """SELECT dataset_id, asset_id, lag(asset_id) OVER w AS prev_id, lead(asset_id) OVER w AS next_id
    FROM (SELECT a.* FROM assets a JOIN states s USING (asset_id) WHERE status = 'approved') x
    WINDOW w AS (PARTITION BY dataset_id ORDER BY created_at, asset_id)""")
def ann_neighbors(spark, sf):
    return A.neighbors(assets(spark, sf), states(spark, sf), "approved")


INPUTS["tag_text"] = """
    SELECT o_orderkey AS asset_id, concat(' ', o_orderpriority, ' ,', lower(o_orderpriority), ', ,  Blurry   Photo,',
           o_orderstatus) AS tags FROM {orders}"""


@register("ann_tag_normalize", """SELECT asset_id, lower(o_orderpriority) || ',blurry photo,' || lower(o_orderstatus) AS tags
    FROM (SELECT o_orderkey AS asset_id, * FROM orders) o""")
def ann_tag_normalize(spark, sf):
    out = load(spark, sf, "tag_text").select("asset_id", A.normalize_tags(F.split("tags", ",")).alias("tags"))
    return out.withColumn("tags", F.array_join("tags", ","))


@register("ann_tag_counts", """SELECT tag, count(*) AS images FROM (SELECT lower(o_orderpriority) AS tag FROM orders
    UNION ALL SELECT 'blurry photo' FROM orders UNION ALL SELECT lower(o_orderstatus) FROM orders) t GROUP BY tag""")
def ann_tag_counts(spark, sf):
    return A.tag_counts(load(spark, sf, "tag_text").select("asset_id", A.normalize_tags(F.split("tags", ",")).alias("tags")))


# ---- state --------------------------------------------------------------------------------------

@register("ann_bulk_state", """SELECT asset_id, dataset_id, split, asset_id % 3 = 0 AND status = 'annotated' AS updated,
    CASE WHEN asset_id % 3 = 0 AND status = 'annotated' THEN 'approved' ELSE status END AS status FROM states""")
def ann_bulk_state(spark, sf):
    return A.bulk_state(states(spark, sf), assets(spark, sf).filter("asset_id % 3 = 0"), "approved", "annotated")


INPUTS["state_changes"] = """
    SELECT o_orderkey AS asset_id, o_custkey % 3 AS dataset_id, CASE WHEN o_orderkey % 10 = 0 THEN 'rejected' END AS new_status,
           CASE WHEN o_orderkey % 15 = 0 THEN 'test' END AS new_split, o_orderkey % 2 = 0 AS set_split
    FROM {orders} WHERE o_orderkey % 5 = 0"""


@register("ann_set_state", """
    SELECT asset_id, coalesce(s.dataset_id, c.dataset_id) AS dataset_id, coalesce(new_status, status, 'unannotated') AS status,
           CASE WHEN set_split THEN new_split ELSE split END AS split
    FROM states s FULL JOIN state_changes c USING (asset_id)""")
def ann_set_state(spark, sf):
    return A.set_state(states(spark, sf), load(spark, sf, "state_changes"))


@register("ann_resolve_state", """
    WITH s AS (SELECT o_orderkey AS asset_id, CASE WHEN o_orderkey % 11 = 0 THEN 'approved' END AS e, o_orderkey % 3 AS n FROM orders)
    SELECT asset_id, CASE WHEN e IS NOT NULL THEN e WHEN n = 0 THEN 'unannotated'
           WHEN status IN ('approved', 'rejected') THEN status ELSE 'annotated' END AS status
    FROM s LEFT JOIN states USING (asset_id)""")
def ann_resolve_state(spark, sf):
    saved = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("asset_id"), F.when(F.col("o_orderkey") % 11 == 0, "approved").alias("explicit_status"),
        (F.col("o_orderkey") % 3).alias("annotation_count"))
    return A.resolve_state(saved, states(spark, sf))


@register("ann_replace", """
    SELECT 'kept' AS side, asset_id, count(*) AS n FROM annotations WHERE asset_id % 7 <> 0 GROUP BY asset_id
    UNION ALL SELECT 'kept', asset_id, count(*) FROM annotations WHERE asset_id % 7 = 0 AND class_name <> 'R' GROUP BY asset_id
    UNION ALL SELECT 'rejected', asset_id, count(*) FROM annotations WHERE asset_id % 7 = 0 AND class_name = 'R' GROUP BY asset_id""")
def ann_replace(spark, sf):
    current = load(spark, sf, "annotations").select("ann_key", "asset_id", "class_name")
    fresh = current.filter("asset_id % 7 = 0").withColumn("ann_key", F.concat(F.lit("new-"), "ann_key"))
    ids = assets(spark, sf).filter("asset_id % 7 = 0")
    kept, bad = A.replace(current, fresh, ids, classes(spark, sf).filter("name <> 'R'"))
    parts = [df.groupBy("asset_id").agg(F.count("*").alias("n")).withColumn("side", F.lit(s))
             for df, s in ((kept, "kept"), (bad, "rejected"))]
    return parts[0].unionAll(parts[1])


INPUTS["class_names"] = """
    SELECT p_size AS dataset_id, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_type END AS name,
           CAST(min(p_partkey) % 17 AS INT) AS order_index
    FROM {part} GROUP BY p_size, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_type END"""


PALETTE = ", ".join(f"'{c}'" for c in A.PALETTE)


@register("ann_class_admin", f"""
    SELECT dataset_id, name, row_number() OVER (PARTITION BY dataset_id ORDER BY order_index, name) - 1 AS class_index,
           [{PALETTE}][(row_number() OVER (PARTITION BY dataset_id ORDER BY order_index, name) - 1) % 12 + 1] AS color,
           max(order_index) OVER (PARTITION BY dataset_id) + 1 AS next_index,
           count(*) OVER (PARTITION BY dataset_id, lower(name)) - 1 AS clashes FROM class_names""")
def ann_class_admin(spark, sf):
    return A.class_table(load(spark, sf, "class_names"))


@register("ann_auto_split", """
    WITH r AS (SELECT a.asset_id, a.dataset_id, coalesce(status, 'unannotated') AS status,
               row_number() OVER (PARTITION BY a.dataset_id ORDER BY md5('7:' || a.asset_id), a.asset_id) AS r,
               count(*) OVER (PARTITION BY a.dataset_id) AS n FROM assets a LEFT JOIN states s USING (asset_id)),
    p AS (SELECT *, CAST(floor(n * 0.7) AS BIGINT) AS a, CAST(floor(n * 0.2) AS BIGINT) AS b, CAST(floor(n * 0.1) AS BIGINT) AS c FROM r),
    q AS (SELECT *, n - a - b - c AS spare, n * CAST(0.7 AS DOUBLE) - a AS fa, n * CAST(0.2 AS DOUBLE) - b AS fb,
          n * CAST(0.1 AS DOUBLE) - c AS fc FROM p),
    z AS (SELECT *, a + CASE WHEN (fb >= fa)::INT + (fc > fa)::INT < spare THEN 1 ELSE 0 END AS na,
          b + CASE WHEN (fa > fb)::INT + (fc > fb)::INT < spare THEN 1 ELSE 0 END AS nb FROM q)
    SELECT asset_id, dataset_id, status, CASE WHEN r <= na THEN 'train' WHEN r <= na + nb THEN 'valid' ELSE 'test' END AS split FROM z""")
def ann_auto_split(spark, sf):
    return A.auto_split(assets(spark, sf), states(spark, sf), (0.7, 0.2, 0.1), 7)


# ---- masks --------------------------------------------------------------------------------------

def rect_masks(spark, sf):
    """A rectangular mask per line item: left column, top row and sides from its keys, in a 48 x 64 frame."""
    from .maskdata import rectangle_counts

    r = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_partkey") % 20).cast("int").alias("left"), (F.col("l_suppkey") % 15).cast("int").alias("top"),
        (4 + F.col("l_partkey") % 30).cast("int").alias("w"), (4 + F.col("l_orderkey") % 25).cast("int").alias("h"))
    counts = rectangle_counts(F.col("left"), F.col("top"), F.col("w"), F.col("h"))
    broken = F.when(F.col("l_orderkey") % 9 == 0, F.concat(counts, F.lit("1"))).otherwise(counts)
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    M.mask_column(F.lit(48), F.lit(64), broken).alias("mask"))


RECT = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 20 AS INT) AS l, CAST(l_suppkey % 15 AS INT) AS t,
    CAST(4 + l_partkey % 30 AS INT) AS w, CAST(4 + l_orderkey % 25 AS INT) AS h, l_orderkey % 9 = 0 AS bad FROM lineitem"""


@register("ann_mask_stats", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT bad THEN CAST(w * h AS BIGINT) END AS area,
    CASE WHEN NOT bad THEN l END AS x, CASE WHEN NOT bad THEN t END AS y, CASE WHEN NOT bad THEN w END AS w,
    CASE WHEN NOT bad THEN h END AS h, CASE WHEN bad THEN 'runs do not cover the mask' END AS problem FROM ({RECT}) r""")
def ann_mask_stats(spark, sf):
    return M.mask_stats(rect_masks(spark, sf)).drop("mask")


@register("ann_validate_masks", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN bad THEN 'runs do not cover the mask'
    WHEN o_orderkey % 3 = 1 THEN 'mask size differs from the image' END AS reason
    FROM ({RECT}) r LEFT JOIN orders ON o_orderkey = l_orderkey""")
def ann_validate_masks(spark, sf):
    """Masks of 64 x 48 on images that have this size, another one, or none."""
    none = F.lit(None).cast("double")
    masks = rect_masks(spark, sf).withColumns({"asset_id": F.col("l_orderkey"), "kind": F.lit("mask"), "x": none, "y": none,
                                               "w": none, "h": none, "points": F.lit(None).cast("array<array<double>>")})
    width = F.when(F.col("o_orderkey") % 3 == 0, 64).when(F.col("o_orderkey") % 3 == 1, 65)
    images = load(spark, sf, "orders").select(F.col("o_orderkey").alias("asset_id"), width.alias("width"), F.lit(48).alias("height"))
    return A.validate(masks, images).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reason")


@register("ann_mask_polygons", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 AS ring,
    {flat_sql('l / 64', 't / 48', '(l + w - 1) / 64', 't / 48', '(l + w - 1) / 64', '(t + h - 1) / 48', 'l / 64', '(t + h - 1) / 48',
              'l / 64', '(t + 1) / 48')} AS points FROM ({RECT}) r WHERE NOT bad""")
def ann_mask_polygons(spark, sf):
    out = M.explode_polygons(rect_masks(spark, sf))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ring", flat())
