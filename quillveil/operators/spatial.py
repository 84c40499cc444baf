"""Joins by place on equality keys: intervals by bins of offsets, boxes by cells of a grid.

Each row stands in all bins that it touches. A pair may share several; it is taken in the first one that both touch, so that each pair comes
once and no distinct is needed. No task holds a document's or page's rows: a bin is a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import stored
from .layout import iou, same_box

#: Characters of one bin, units of one cell.
BIN, CELL = 256, 32.0
#: Entities of a page that may meet each other by page.
FEW = 64
PAGE = ("doc_id", "page_number")


def _right(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(c).alias(f"__r_{c}" if c in keys else c) for c in df.columns))


def _same(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(k) == F.col(f"__r_{k}"))
    return out


def _bins(first: Column, last: Column, size: float) -> Column:
    return F.sequence(F.floor(first / size), F.floor(last / size))


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("doc_id",), a: tuple[str, str] = ("start", "end"), b: tuple[str, str] = ("r_start", "r_end"), width: int = BIN) -> DataFrame:
    """Pairs of rows with equal keys whose half-open intervals share a place (start < other end, end > other start).

    Columns other than the keys must differ in name. Null keys, and empty or null intervals, meet nothing. A row takes a key for each bin
    of `width` that it touches.
    """
    lo, hi, r_lo, r_hi = (F.col(c) for c in (*a, *b))
    own = left.where(lo < hi).withColumn("__bin", F.explode(_bins(lo, hi - 1, width)))
    other = _right(right, keys).where(r_lo < r_hi).withColumn("__r_bin", F.explode(_bins(r_lo, r_hi - 1, width)))
    first = F.greatest(F.floor(lo / width), F.floor(r_lo / width)) == F.col("__bin")
    met = own.join(other, _same(keys) & (F.col("__bin") == F.col("__r_bin")) & first & (lo < r_hi) & (hi > r_lo))
    return met.drop("__bin", "__r_bin", *(f"__r_{k}" for k in keys))


def _edges(box: Column) -> tuple[Column, Column, Column, Column]:
    return box["x"], box["y"], box["x"] + F.greatest(box["width"], F.lit(0.0)), box["y"] + F.greatest(box["height"], F.lit(0.0))


def _cells(box: Column, size: float) -> Column:
    x0, y0, x1, y1 = _edges(box)
    return F.flatten(F.transform(_bins(x0, x1, size), lambda i: F.transform(_bins(y0, y1, size), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def box_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = PAGE, a: str = "bbox", b: str = "r_bbox", cell: float = CELL) -> DataFrame:
    """Pairs of rows of one page whose boxes (x, y, width, height) touch or overlap; columns other than the keys must differ in name.

    Boxes with a null side meet nothing. A box takes a key for each cell that it touches.
    """
    p, q = F.col(a), F.col(b)
    x0, y0, x1, y1 = _edges(p)
    u0, v0, u1, v1 = _edges(q)
    own = left.withColumn("__cell", F.explode(_cells(p, cell)))
    other = _right(right, keys).withColumn("__r_cell", F.explode(_cells(q, cell)))
    first = (F.col("__cell.i") == F.greatest(F.floor(x0 / cell), F.floor(u0 / cell))) & (F.col("__cell.j") == F.greatest(F.floor(y0 / cell), F.floor(v0 / cell)))
    touch = (x0 <= u1) & (x1 >= u0) & (y0 <= v1) & (y1 >= v0)
    met = own.join(other, _same(keys) & (F.col("__cell") == F.col("__r_cell")) & first & touch)
    return met.drop("__cell", "__r_cell", *(f"__r_{k}" for k in keys))


def within(rows: DataFrame, boxes: DataFrame, a: str = "r_bbox", b: str = "bbox") -> DataFrame:
    """The rows whose box touches the one around all `boxes`, whatever their pages: others can't meet any, and needn't be dealt to cells."""
    x0, y0, x1, y1 = _edges(F.col(b))
    region = boxes.agg(F.min(x0).alias("__x0"), F.min(y0).alias("__y0"), F.max(x1).alias("__x1"), F.max(y1).alias("__y1"))
    u0, v0, u1, v1 = _edges(F.col(a))
    met = rows.join(F.broadcast(region), (u0 <= F.col("__x1")) & (u1 >= F.col("__x0")) & (v0 <= F.col("__y1")) & (v1 >= F.col("__y0")))
    return met.drop("__x0", "__y0", "__x1", "__y1")


def _corner(box: Column, size: Column, around: bool) -> Column:
    """The cell of a box's corner, or that and the eight around it."""
    i, j = F.floor(box["x"] / size), F.floor(box["y"] / size)
    if not around:
        return F.array(F.struct(i.alias("i"), j.alias("j")))
    return F.array(*(F.struct((i + di).alias("i"), (j + dj).alias("j")) for di in (-1, 0, 1) for dj in (-1, 0, 1)))


def near_anti_join(found: DataFrame, taken: DataFrame, keys: Sequence[str] = PAGE, tolerance: float = 2.0) -> DataFrame:
    """Rows of `found` (bbox) with no row of `taken` on their page whose box has all four numbers within `tolerance`."""
    size = F.lit(tolerance)
    t = taken.select(*(F.col(k).alias(f"__r_{k}") for k in keys), F.col("bbox").alias("__b")).distinct()
    t = t.withColumn("__r_cell", F.explode(_corner(F.col("__b"), size, True)))
    close = _same(keys) & (F.col("__cell") == F.col("__r_cell"))
    for k in ("x", "y", "width", "height"):
        close = close & (F.abs(F.col(f"bbox.{k}") - F.col(f"__b.{k}")) < tolerance)
    return found.withColumn("__cell", F.get(_corner(F.col("bbox"), size, False), F.lit(0))).join(t, close, "left_anti").drop("__cell")


def _levels(box: Column, tolerance: float) -> Column:
    """Cell sizes, as powers of two, in which boxes that could be one place lie in neighbouring cells: two, since such boxes differ little in size."""
    need = F.greatest(F.lit(tolerance), F.greatest(box["width"], box["height"]) / 4)
    level = F.ceil(F.log2(need))
    return F.array(level, level + 1)


def _met_whole(rows: DataFrame, keys: Sequence[str], takes) -> DataFrame:
    """(u, v) of pairs within pages of few entities, met by page."""
    u, v = (rows.select(*(F.col(k).alias(f"{p}_{k}") for k in (*keys, "id", "box", "low"))) for p in "uv")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"u_{k}").eqNullSafe(F.col(f"v_{k}"))
    return u.join(v, same & (F.col("u_id") < F.col("v_id")) & takes).select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))


def _met_in_cells(nodes: DataFrame, keys: Sequence[str], takes, tolerance: float) -> DataFrame:
    """(u, v) of pairs within pages of many entities, met in grid cells."""

    def dealt(prefix: str, around: bool) -> DataFrame:
        out = nodes.withColumn("level", F.explode(_levels(F.col("box"), tolerance)))
        out = out.withColumn("cell", F.explode(_corner(F.col("box"), F.pow(F.lit(2.0), F.col("level")), around)))
        return out.select(*(F.col(c).alias(f"{prefix}_{c}") for c in (*keys, "id", "box", "low", "level", "cell")))

    u, v = dealt("u", False), dealt("v", True)
    same = (F.col("u_level") == F.col("v_level")) & (F.col("u_cell") == F.col("v_cell"))
    for k in keys:
        same = same & F.col(f"u_{k}").eqNullSafe(F.col(f"v_{k}"))
    # Two levels may both bring a pair.
    return u.join(v, same & (F.col("u_id") < F.col("v_id")) & takes).select(F.col("u_id").alias("u"), F.col("v_id").alias("v")).distinct()


def places(entities: DataFrame, scratch: str, keys: Sequence[str] = PAGE, overlap: float = 0.8, tolerance: float = 5.0) -> DataFrame:
    """What `dedupe.by_place` keeps, for pages of any size: one entity a place.

    A sort numbers the entities in their order; from then on pairs, rounds and places are pairs of numbers, and whole entities travel only to be numbered and to be
    kept. Pairs that may be one place meet by page where a page has `FEW` entities at most, else in grid cells; there, of entities with equal boxes and texts the
    first stands for all. Those that no earlier one takes begin a place; those that a beginner takes belong to the first such place and take nobody; when they are
    gone others begin, and so on: as many rounds as the longest chain of boxes that take each other in turn. What a place keeps is found by sums over its members,
    so no task holds a large page or place.
    """
    columns = entities.columns
    order = [*keys, F.floor(F.col("bbox.y") / tolerance), F.col("bbox.x"), "pattern_ordinal", "text_index", *columns]
    rows = stored(entities.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), f"{scratch}/entities")
    box = F.struct(*(F.col(f"bbox.{k}").alias(k) for k in ("x", "y", "width", "height")))
    # An entity without a whole box is a place of its own.
    whole = rows.where(" AND ".join(f"bbox.{k} IS NOT NULL" for k in ("x", "y", "width", "height"))).select(*keys, F.col("__id").alias("id"), box.alias("box"), F.lower("text").alias("low"))
    many = stored(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > FEW).select(*(F.col(k).alias(f"__{k}") for k in keys)), f"{scratch}/many")
    among = F.lit(True)
    for k in keys:
        among = among & F.col(k).eqNullSafe(F.col(f"__{k}"))
    takes = F.coalesce(iou(F.col("u_box"), F.col("v_box")) > overlap, F.lit(False)) | ((F.col("u_low") == F.col("v_low")) & same_box(F.col("u_box"), F.col("v_box"), tolerance))
    edges, twins = _met_whole(whole.join(many, among, "left_anti"), keys, takes), None
    if not many.isEmpty():
        # Texts that are null are equal to none.
        alike = (*keys, "box", "low", "own")
        large = whole.join(many, among, "left_semi").withColumn("own", F.when(F.col("low").isNull(), F.col("id")))
        nodes = stored(large.groupBy(*alike).agg(F.min("id").alias("id")), f"{scratch}/nodes")
        twin = F.lit(True)
        for k in alike:
            twin = twin & F.col(k).eqNullSafe(F.col(f"__{k}"))
        twins = large.join(nodes.select(F.col("id").alias("node"), *(F.col(k).alias(f"__{k}") for k in alike)), twin).where("id <> node").select("id", "node")
        twins = stored(twins, f"{scratch}/twins")
        edges = edges.unionByName(_met_in_cells(nodes, keys, takes, tolerance))

    left, chosen, step = stored(edges, f"{scratch}/edges-0"), None, 0
    while not left.isEmpty():
        step += 1
        pairs = stored(left.join(left.select(F.col("v").alias("u")).distinct(), "u", "left_anti"), f"{scratch}/pairs-{step}")
        chosen = pairs if chosen is None else chosen.unionByName(pairs)
        # An edge to a taken one stays until its own end is settled: that may begin an earlier place, which is then the first to take it.
        settled = pairs.select("u").union(pairs.select("v")).distinct()
        left = stored(left.join(settled, "u", "left_anti"), f"{scratch}/edges-{step}")
    members = chosen.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("place")) if chosen is not None else None
    if twins is not None:
        # Those that stand behind another share its place.
        behind = twins.select("id", F.col("node").alias("place"))
        if members is not None:
            behind = twins.join(members.select(F.col("id").alias("node"), "place"), "node", "left").select("id", F.coalesce("place", "node").alias("place"))
        members = behind if members is None else members.unionByName(behind)
    if members is None:
        return rows.select(*columns)
    members = stored(members, f"{scratch}/members")
    fate = members.unionByName(members.select(F.col("place").alias("id"), "place").distinct())
    e = F.struct(*columns)
    fate = fate.select(F.col("id").alias("__i"), F.col("place").alias("__place"))
    met = stored(rows.join(fate, F.col("__id") == F.col("__i")).select(F.col("__i").alias("id"), F.col("__place").alias("place"), e.alias("e")), f"{scratch}/met")
    first = met.where("id = place").select(F.col("place").alias("p"), F.col("e").alias("first"))
    later = met.where("id <> place").join(first.select("p", F.col("first.bbox").alias("b"), F.col("first.detection_method").alias("m")), F.col("place") == F.col("p")).drop("p")
    later = stored(later.withColumn("two", (iou(F.col("b"), F.col("e.bbox")) <= overlap) & (F.col("m") != F.col("e.detection_method"))).drop("b", "m"), f"{scratch}/later")
    last = later.where("two").groupBy(F.col("place").alias("p")).agg(F.max("id").alias("last"), F.max_by("e.confidence", "id").alias("sure"))
    best = later.join(last.select("p", "last"), F.col("place") == F.col("p"), "left").where("last IS NULL OR id > last")
    best = best.groupBy(F.col("place").alias("q")).agg(F.min_by("e", F.struct(F.negative("e.confidence").alias("rank"), F.col("id").alias("id"))).alias("best"))
    f = F.col("first")
    mean = F.struct(*(((f["confidence"] + F.col("sure")) / 2 if c == "confidence" else F.lit("ml_ner") if c == "detection_method" else f[c]).alias(c) for c in columns))
    begun = first.join(last.withColumnRenamed("p", "r"), F.col("p") == F.col("r"), "left").select("p", F.when(F.col("last").isNull(), f).otherwise(mean).alias("base"))
    kept = begun.join(best, F.col("p") == F.col("q"), "left").select(F.when(F.col("best.confidence") > F.col("base.confidence"), F.col("best")).otherwise(F.col("base")).alias("k")).select("k.*")
    alone = rows.join(fate, F.col("__id") == F.col("__i"), "left_anti")
    return alone.select(*columns).unionByName(kept)
