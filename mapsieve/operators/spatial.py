"""Joins by distance and containment, greedy matching, components and clusters.

Pairs are met by page, or for pages with many shapes by page and grid cell: a cell is as wide as the
largest distance, and one side stands in its own cell while the other is looked up in nine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapsieve.functions import scores
from mapsieve.functions.geometry import angle_degrees, distance, in_polygon, point_segment_distance, segment_crossing
from mapsieve.operators.storage import written


def near_pairs(a: DataFrame, b: DataFrame, limit: float, page: str = "page_id", grid: bool = True) -> DataFrame:
    """Pairs of rows of one page at most ``limit`` apart, with ``distance``.

    Both sides hold page, cx and cy; columns of a get the prefix a_ and of b the prefix b_.
    """
    named = lambda df, p: df.select(*(F.col(x).alias(f"{p}{x}") for x in df.columns))
    left, right = named(a, "a_"), named(b, "b_")
    far = distance(F.col("a_cx"), F.col("a_cy"), F.col("b_cx"), F.col("b_cy"))
    on = F.col(f"a_{page}") == F.col(f"b_{page}")
    if grid:
        cell = lambda c: F.floor(F.col(c) / limit)
        around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
        left = left.withColumn("__gx", cell("a_cx")).withColumn("__gy", cell("a_cy"))
        right = right.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around)).withColumn("__hx", cell("b_cx") + F.col("__dx")).withColumn("__hy", cell("b_cy") + F.col("__dy"))
        on = on & (F.col("__gx") == F.col("__hx")) & (F.col("__gy") == F.col("__hy"))
    return left.join(right, on).withColumn("distance", far).filter(F.col("distance") <= limit).drop("__gx", "__gy", "__dx", "__dy", "__hx", "__hy")


def circle_text_relations(circles: DataFrame, texts: DataFrame, limit: float = 100.0, least: float = 0.3) -> DataFrame:
    """Texts within ``limit`` of a circle (page_id, idx, cx, cy, radius | w, h, text), with angle, confidence and class."""
    pairs = near_pairs(circles, texts, limit)
    angle = angle_degrees(F.col("a_cx"), F.col("a_cy"), F.col("b_cx"), F.col("b_cy"))
    pairs = pairs.withColumn("angle", angle).withColumn("confidence", scores.relationship(F.col("distance"), F.col("angle"), F.col("b_w"), F.col("b_h"), F.col("a_radius"), limit))
    return pairs.filter(F.col("confidence") > least).withColumn("relationship", scores.relationship_type(F.col("distance")))


def match_greedily(pairs: DataFrame, page: str, a: str, b: str, score: str) -> DataFrame:
    """One-to-one pairs of each page, best score first (ties: smaller a, smaller b)."""
    rows = pairs.groupBy(page).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(a).alias("a"), F.col(b).alias("b")))).alias("rows"))
    free = lambda kept, r: ~F.exists(kept, lambda k: (k["a"] == r["a"]) | (k["b"] == r["b"]))
    kept = F.aggregate("rows", F.filter("rows", lambda r: F.lit(False)), lambda acc, r: F.when(free(acc, r), F.array_append(acc, r)).otherwise(acc))
    return rows.select(page, F.explode(kept).alias("k")).select(page, F.col("k.a").alias(a), F.col("k.b").alias(b), (-F.col("k.s")).alias(score))


def within_radius(points: DataFrame, cx: float, cy: float, radius: float) -> DataFrame:
    far = distance(F.col("cx"), F.col("cy"), F.lit(cx), F.lit(cy))
    return points.withColumn("distance", far).filter(F.col("distance") <= radius).orderBy("distance", *[c for c in ("page_id", "idx") if c in points.columns])


def with_existence(boxes: DataFrame, points: DataFrame, page: str, key: str, name: str) -> DataFrame:
    """Boxes (page, key, x1, y1, x2, y2) marked where a point (page, cx, cy) lies in them, borders included."""
    inside = (F.col(f"p.{page}") == F.col(f"b.{page}")) & F.col("p.cx").between(F.col("b.x1"), F.col("b.x2")) & F.col("p.cy").between(F.col("b.y1"), F.col("b.y2"))
    hit = boxes.alias("b").join(points.alias("p"), inside, "left_semi").select(page, key).withColumn(name, F.lit(True))
    return boxes.join(hit, [page, key], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def containing_region(points: DataFrame, regions: DataFrame, page: str, key: str) -> DataFrame:
    """Points with the first region (page, region_id, contour) that holds them, or null."""
    p, r = points.alias("p"), regions.alias("r")
    hit = p.join(r, (F.col(f"p.{page}") == F.col(f"r.{page}")) & in_polygon(F.col("p.cx"), F.col("p.cy"), F.col("r.contour"))).groupBy(F.col(f"p.{page}").alias(page), F.col(f"p.{key}").alias(key)).agg(F.min("r.region_id").alias("region_id"))
    return points.join(hit, [page, key], "left")


def road_distance(points: DataFrame, roads: DataFrame, page: str, key: str) -> DataFrame:
    """Points with the distance to the nearest road (page, x1, y1, x2, y2) of the page, infinite without one."""
    p, r = points.alias("p"), roads.alias("r")
    far = point_segment_distance(F.col("p.cx"), F.col("p.cy"), F.col("r.x1"), F.col("r.y1"), F.col("r.x2"), F.col("r.y2"))
    least = p.join(r, F.col(f"p.{page}") == F.col(f"r.{page}")).groupBy(F.col(f"p.{page}").alias(page), F.col(f"p.{key}").alias(key)).agg(F.min(far).alias("road_distance"))
    return points.join(least, [page, key], "left").withColumn("road_distance", F.coalesce("road_distance", F.lit(float("inf"))))


def crossings(lines: DataFrame, page: str, key: str) -> DataFrame:
    """Points where two lines (page, key, x1, y1, x2, y2) of a page meet."""
    a, b = lines.alias("a"), lines.alias("b")
    ends = lambda t: {k: F.col(f"{t}.{k}") for k in ("x1", "y1", "x2", "y2")}
    pairs = a.join(b, (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    met = pairs.select(F.col(f"a.{page}").alias(page), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), segment_crossing(ends("a"), ends("b")).alias("at"))
    return met.filter("at is not null").select(page, "a", "b", "at.x", "at.y")


def text_of_circle(circles: DataFrame, texts: DataFrame, page: str, key: str, factor: float = 1.5) -> DataFrame:
    """Circles with the first text (by idx) nearer than factor * radius, or null."""
    c, t = circles.alias("c"), texts.alias("t")
    close = (F.col(f"c.{page}") == F.col(f"t.{page}")) & (distance(F.col("c.cx"), F.col("c.cy"), F.col("t.cx"), F.col("t.cy")) < F.col("c.radius") * factor)
    found = c.join(t, close).groupBy(F.col(f"c.{page}").alias(page), F.col(f"c.{key}").alias(key)).agg(F.min_by("t.text", "t.idx").alias("circle_text"))
    return circles.join(found, [page, key], "left")


def near_edges(points: DataFrame, limit: float, page: str = "page_id", key: str = "idx") -> DataFrame:
    """(page, a, b, distance, strength) of pairs of a page at most ``limit`` apart, a < b.

    Points meet in grid cells as wide as the limit.  As a pair is the same both ways, a cell meets
    itself and four of its eight neighbours.
    """
    cells = points.select(page, F.col(key).alias("k"), "cx", "cy", F.floor(F.col("cx") / limit).alias("gx"), F.floor(F.col("cy") / limit).alias("gy"))
    ahead = F.array(*(F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    other = cells.select(page, "k", "cx", "cy", "gx", "gy", F.explode(ahead).alias("d")).select(page, *(F.col(x).alias(f"b_{x}") for x in ("k", "cx", "cy")), (F.col("gx") + F.col("d.x")).alias("gx"), (F.col("gy") + F.col("d.y")).alias("gy"), ((F.col("d.x") == 0) & (F.col("d.y") == 0)).alias("own"))
    far = distance(F.col("cx"), F.col("cy"), F.col("b_cx"), F.col("b_cy"))
    pairs = cells.join(other, [page, "gx", "gy"]).filter((F.col("k") < F.col("b_k")) | (~F.col("own") & (F.col("k") != F.col("b_k")))).withColumn("distance", far).filter(F.col("distance") <= limit)
    return pairs.select(page, F.least("k", "b_k").alias("a"), F.greatest("k", "b_k").alias("b"), "distance", (1 - F.col("distance") / limit).alias("strength"))


def ranked_relations(relations: DataFrame) -> DataFrame:
    """Relations of circle_text_relations with their ``place`` in their page, most confident first (ties: nearer, smaller circle, smaller text)."""
    order = [F.desc("confidence"), "distance", "a_idx", "b_idx"]
    return relations.withColumn("place", F.row_number().over(Window.partitionBy("a_page_id").orderBy(*order)))


def address_price_pairs(addresses: DataFrame, prices: DataFrame, limit: float = 100.0, page: str = "page_id") -> DataFrame:
    """Every address (page, idx, cx, cy) of a page with every price of it: address, price, distance and whether it is near or far."""
    a, b = addresses.alias("a"), prices.alias("b")
    far = distance(F.col("a.cx"), F.col("a.cy"), F.col("b.cx"), F.col("b.cy"))
    pairs = a.join(b, F.col(f"a.{page}") == F.col(f"b.{page}")).select(F.col(f"a.{page}").alias(page), F.col("a.idx").alias("address"), F.col("b.idx").alias("price"), far.alias("distance"))
    return pairs.withColumn("relation", F.when(F.col("distance") < limit, "near").otherwise("far"))


def components(nodes: DataFrame, edges: DataFrame, page: str = "page_id", key: str = "idx") -> DataFrame:
    """Nodes (page, key) with the smallest key that they are connected to, a page at a time.

    Pages are brought together by one shuffle and streamed in order through union-find; for pages
    that are too large for that there is components_by_rounds.
    """
    rows = nodes.select(F.col(page).cast("long").alias("p"), F.col(key).cast("long").alias("a"), F.col(key).cast("long").alias("b")).unionByName(edges.select(F.col(page).cast("long").alias("p"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    found = rows.repartition("p").sortWithinPartitions("p").mapInArrow(_united, "p long, a long, component long")
    kind = {f.name: f.dataType for f in nodes.schema}
    return found.select(F.col("p").cast(kind[page]).alias(page), F.col("a").cast(kind[key]).alias(key), F.col("component").cast(kind[key]).alias("component"))


def _united(batches):
    """Components of rows (p, a, b) sorted by p; the last page of a batch waits for the next."""
    import numpy as np
    import pyarrow as pa

    def solve(table):
        p, a, b = (table.column(i).to_numpy() for i in range(3))
        # nodes in order of page and key; every node is told the least node that it is tied to until none changes
        order = np.lexsort((np.concatenate([a, b]), np.concatenate([p, p])))
        page, node = np.concatenate([p, p])[order], np.concatenate([a, b])[order]
        new = np.append(True, (page[1:] != page[:-1]) | (node[1:] != node[:-1]))
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.cumsum(new) - 1
        page, node = page[new], node[new]
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(node))
        while (root[x] != root[y]).any():
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            while (root != root[root]).any():
                root = root[root]
        return pa.RecordBatch.from_arrays([pa.array(v, type=pa.int64()) for v in (page, node, node[root])], names=["p", "a", "component"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        pages = table.column(0).to_numpy()
        cut = int(np.searchsorted(pages, pages[-1]))
        if cut:
            yield solve(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None:
        yield solve(held)


def components_by_rounds(nodes: DataFrame, edges: DataFrame, page: str = "page_id", key: str = "idx", rounds: int = 60) -> DataFrame:
    """As components, by rounds of minimum labels with a jump each; no page need fit into a task."""
    both = written(edges.select(page, F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(page, F.col("b").alias("x"), F.col("a").alias("y"))))
    labels = nodes.select(page, key).distinct().withColumn("component", F.col(key))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed(key, "y"), [page, "y"]).groupBy(page, F.col("x").alias(key)).agg(F.min("component").alias("low"))
        moved = labels.join(near, [page, key], "left").withColumn("next", F.least("component", F.coalesce("low", "component")))
        jump = moved.select(page, F.col(key).alias("next"), F.col("next").alias("far"))
        moved = written(moved.join(jump, [page, "next"], "left").select(page, key, "component", F.least("next", F.coalesce("far", "next")).alias("next")))
        labels = moved.select(page, key, F.col("next").alias("component"))
        if moved.filter("next <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def dbscan(points: DataFrame, eps: float = 150.0, page: str = "page_id", key: str = "idx") -> DataFrame:
    """Clusters of points with a neighbour within eps, numbered by their first key from 0; -1 for points alone."""
    found = components(points, near_edges(points, eps, page, key), page, key)
    sized = found.withColumn("n", F.count("*").over(Window.partitionBy(page, "component")))
    first = sized.filter("n > 1").select(page, "component").distinct().withColumn("cluster", F.row_number().over(Window.partitionBy(page).orderBy("component")) - 1)
    return sized.join(first, [page, "component"], "left").select(page, key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def nearest_segment(point: tuple[Column, Column], segments: DataFrame) -> DataFrame:
    return segments.withColumn("distance", point_segment_distance(*point, *(F.col(c) for c in ("x1", "y1", "x2", "y2"))))


def merged_lines(lines: DataFrame, page: str = "page_id", key: str = "idx", angle: float = 5.0, near: float = 20.0) -> DataFrame:
    """Near-parallel lines (page, key, x1, y1, x2, y2) with close midpoints as one from end to end, along the first line's main axis."""
    from mapsieve.functions.geometry import parallel_difference
    from mapsieve.operators.fold import seed_groups

    slope = lambda a: angle_degrees(a["x1"], a["y1"], a["x2"], a["y2"])
    mid = lambda a: ((a["x1"] + a["x2"]) / 2, (a["y1"] + a["y2"]) / 2)
    hit = lambda s, r: (parallel_difference(slope(s), slope(r)) < angle) & (distance(*mid(s), *mid(r)) < near)
    groups = seed_groups(lines.select(page, key, "x1", "y1", "x2", "y2"), [page], [F.col(key)], hit)
    m = F.col("members")
    ends = F.flatten(F.transform(m, lambda x, i: F.array(*(F.struct(x[a].alias("x"), x[b].alias("y"), (i * 2 + k).alias("i")) for k, (a, b) in enumerate((("x1", "y1"), ("x2", "y2")))))))
    flat = F.abs(m[0]["x2"] - m[0]["x1"]) > F.abs(m[0]["y2"] - m[0]["y1"])
    along = F.transform(ends, lambda e: F.struct(F.when(flat, e["x"]).otherwise(e["y"]).alias("t"), e["i"].alias("i"), e["x"].alias("x"), e["y"].alias("y")))
    low = F.array_min(along)
    back = F.array_max(F.transform(along, lambda e: F.struct(e["t"].alias("t"), (-e["i"]).alias("i"), e["x"].alias("x"), e["y"].alias("y"))))
    one = F.size(m) == 1
    out = groups.withColumn("low", low).withColumn("high", back)
    pick = lambda c, other: F.when(one, m[0][c]).otherwise(F.col(other))
    return out.select(page, "group", pick("x1", "low.x").alias("x1"), pick("y1", "low.y").alias("y1"), pick("x2", "high.x").alias("x2"), pick("y2", "high.y").alias("y2"), F.size(m).alias("line_count"))


def regions_at(regions: DataFrame, pdf_path: str, page: int, x: float, y: float) -> DataFrame:
    """Regions (pdf_path, page_number, nx1, ny1, nx2, ny2) that hold a point of a page in shares of its size, borders included."""
    return regions.filter((F.col("pdf_path") == pdf_path) & (F.col("page_number") == page) & F.lit(x).between(F.col("nx1"), F.col("nx2")) & F.lit(y).between(F.col("ny1"), F.col("ny2")))


def graph_summary(nodes: DataFrame, edges: DataFrame, page: str = "page_id", key: str = "idx") -> DataFrame:
    """A row a page: nodes, edges, components and mean degree."""
    parts = components(nodes, edges, page, key).groupBy(page).agg(F.count("*").alias("nodes"), F.countDistinct("component").alias("components"))
    counts = edges.groupBy(page).agg(F.count("*").alias("edges"))
    return parts.join(counts, page, "left").withColumn("edges", F.coalesce("edges", F.lit(0))).withColumn("mean_degree", 2 * F.col("edges") / F.col("nodes"))
