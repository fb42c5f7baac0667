"""Regions, boxes and sizes as arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schemas import REGIONS

Box = tuple[Column, Column, Column, Column]


def _half(size: Column) -> Column:
    return F.floor(size / 2).cast("int")


def _spot(name: str, width: Column, height: Column, across: int, down: int, middle: int) -> Box:
    """A rectangle named by its place: ``across`` x ``down`` pixels, ``middle`` along a centred side."""
    zero = F.lit(0)
    if "center" in name:
        left, right = _half(width) - middle // 2, _half(width) + middle // 2
    elif "left" in name:
        left, right = zero, F.lit(across)
    else:
        left, right = width - across, width
    if "middle" in name:
        top, bottom = _half(height) - middle // 2, _half(height) + middle // 2
    elif "top" in name:
        top, bottom = zero, F.lit(down)
    else:
        top, bottom = height - down, height
    return left, top, right, bottom


def region_box(name: str, width: Column, height: Column) -> Box:
    """Rectangle of a scan region (x1, y1, x2, y2)."""
    zero = F.lit(0)
    if name.startswith("full_edge_"):
        return {"top": (zero, zero, width, F.lit(100)), "bottom": (zero, height - 100, width, height),
                "left": (zero, zero, F.lit(100), height), "right": (width - 100, zero, width, height)}[name[10:]]
    if name.startswith("edge_"):
        return _spot(name, width, height, 100, 100, 300)
    return _spot(name, width, height, 200, 200, 200 if "middle" in name else 300)


def _box_struct(name: str, box: Box) -> Column:
    return F.struct(F.lit(name).alias("region"), *[
        value.cast("int").alias(corner) for corner, value in zip(("x1", "y1", "x2", "y2"), box, strict=True)])


def region_boxes(width: Column, height: Column) -> Column:
    """Array of the 18 scan regions of a page."""
    return F.array(*[_box_struct(name, region_box(name, width, height)) for name in REGIONS])


def corner_boxes(width: Column, height: Column) -> Column:
    """The four corners of 15 % used for prediction."""
    across, down = F.floor(width * 0.15).cast("int"), F.floor(height * 0.15).cast("int")
    zero = F.lit(0)
    return F.array(
        _box_struct("top_left", (zero, zero, across, down)),
        _box_struct("top_right", (width - across, zero, width, down)),
        _box_struct("bottom_left", (zero, height - down, across, height)),
        _box_struct("bottom_right", (width - across, height - down, width, height)))


def manual_boxes(width: Column, height: Column) -> Column:
    """The six 200 pixel corners shown for manual labelling."""
    names = ("top_left", "top_right", "bottom_left", "bottom_right", "top_center", "bottom_center")
    return F.array(*[_box_struct(n, _spot(n, width, height, 200, 200, 200)) for n in names])


def regions_of(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Names of the scan regions that contain a point, in scan order."""
    def inside(name: str) -> Column:
        left, top, right, bottom = region_box(name, width, height)
        return (x >= left) & (x < right) & (y >= top) & (y < bottom)

    return F.array_compact(F.array(*[
        F.when(inside(name), F.struct(F.lit(rank).alias("scan_rank"), F.lit(name).alias("region")))
        for rank, name in enumerate(REGIONS)]))


def rescale(box: dict[str, Column], shown: tuple[Column, Column], original: tuple[Column, Column]) -> dict[str, Column]:
    """A box drawn on a shown image, in pixels of the original, kept inside it."""
    (shown_w, shown_h), (width, height) = shown, original
    low_x, high_x = F.least(box["x1"], box["x2"]), F.greatest(box["x1"], box["x2"])
    low_y, high_y = F.least(box["y1"], box["y2"]), F.greatest(box["y1"], box["y2"])

    def place(value: Column, size: Column, shown_size: Column, top: Column) -> Column:
        scaled = F.floor(value * (size / shown_size)).cast("int")
        return F.greatest(F.lit(0), F.least(scaled, top))

    return {"x1": place(low_x, width, shown_w, width - 1), "x2": place(high_x, width, shown_w, width),
            "y1": place(low_y, height, shown_h, height - 1), "y2": place(high_y, height, shown_h, height)}


def capped_size(width: Column, height: Column, limit: int = 2500) -> tuple[Column, Column]:
    """Size with the longest side at most ``limit``, aspect kept."""
    large = F.greatest(width, height) > limit
    wide = width > height
    new_width = F.when(wide, F.lit(limit)).otherwise(F.floor(width * limit / height))
    new_height = F.when(wide, F.floor(height * limit / width)).otherwise(F.lit(limit))
    return (F.when(large, new_width).otherwise(width).cast("int"),
            F.when(large, new_height).otherwise(height).cast("int"))


def size_at_300dpi(width: Column, height: Column, dpi: Column) -> tuple[Column, Column]:
    scale = F.lit(300) / F.coalesce(dpi, F.lit(72))
    return F.floor(width * scale).cast("int"), F.floor(height * scale).cast("int")


def points(pixels: Column, dpi: int = 300) -> Column:
    """Length on the printed page."""
    return pixels * 72.0 / dpi
