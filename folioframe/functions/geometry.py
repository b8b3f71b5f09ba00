"""Box expressions. A box is an array x1, y1, x2, y2; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(*[c.cast("double") for c in (x1, y1, x2, y2)])


def area(b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b[2] - b[0]) * F.greatest(zero, b[3] - b[1])


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(zero, w) * F.greatest(zero, h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union has no area."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def from_xywh(b: Column, width: Column, height: Column) -> Column:
    """Corner form of x, y, w, h within the page."""
    return F.array(
        F.greatest(F.lit(0.0), b[0]), F.greatest(F.lit(0.0), b[1]), F.least(width, b[0] + b[2]), F.least(height, b[1] + b[3])
    )


def padded(b: Column, pad: Column, width: Column, height: Column) -> Column:
    """Grown by ``pad`` and cut to the page; null if nothing is left."""
    out = F.array(
        F.greatest(F.lit(0.0), b[0] - pad), F.greatest(F.lit(0.0), b[1] - pad), F.least(width, b[2] + pad), F.least(height, b[3] + pad)
    )
    return F.when((out[2] > out[0]) & (out[3] > out[1]), out)


def _clamped(v: list[Column], width: Column, height: Column) -> Column:
    zero = F.lit(0)
    x1, y1 = F.greatest(zero, F.least(v[0], width)), F.greatest(zero, F.least(v[1], height))
    x2, y2 = F.greatest(zero, F.least(v[2], width)), F.greatest(zero, F.least(v[3], height))
    # at least one pixel where the page has room for it
    x2 = F.when(x2 <= x1, F.least(width, x1 + 1)).otherwise(x2)
    y2 = F.when(y2 <= y1, F.least(height, y1 + 1)).otherwise(y2)
    return F.array(x1, y1, x2, y2)


def clamp_truncated(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels towards zero, within the page."""
    return _clamped([b[i].cast("int") for i in range(4)], width.cast("int"), height.cast("int"))


def clamp_rounded(b: Column, width: Column, height: Column) -> Column:
    """Nearest whole pixels (halves to even), within the page."""
    return _clamped([F.bround(b[i].cast("double")).cast("int") for i in range(4)], width.cast("int"), height.cast("int"))


def relative(b: Column) -> Column:
    """To the 0-1000 scale: a coordinate up to 1 counts as a share of 1; cut to the scale."""
    one = lambda v: F.when(v <= 1.0, v * 1000.0).otherwise(v)
    return F.transform(b, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), one(v.cast("double")))))


def absolute(b: Column, width: Column, height: Column) -> Column:
    """Pixels of a relative box."""
    r = relative(b)
    scaled = F.array(*[r[i] / 1000.0 * (width if i % 2 == 0 else height) for i in range(4)])
    return clamp_rounded(scaled, width, height)


def area_ratio(xywh: Column, width: Column, height: Column) -> Column:
    return xywh[2] * xywh[3] / F.greatest(F.lit(1.0), width * height)


def has_min_edge(b: Column, least: int = 28) -> Column:
    return ((b[2] - b[0]) >= least) & ((b[3] - b[1]) >= least)


def whole_boxes(page: Column) -> Column:
    """The boxes of a page that have four coordinates."""
    return F.filter(page, lambda b: F.size(b) == 4)


def bbox_target(rel_bbox: Column) -> Column:
    """Compact JSON of relative boxes page by page; pages without boxes drop out; null if none is left."""
    pages = F.filter(
        F.transform(rel_bbox, lambda p: F.transform(whole_boxes(p), lambda b: F.transform(b, lambda v: v.cast("double")))),
        lambda p: F.size(p) > 0,
    )
    return F.when(F.size(pages) > 0, F.to_json(pages))


def aligned_types(boxes: Column, types: Column, filler: str = "unknown") -> Column:
    """One type per box of a page."""
    return F.transform(boxes, lambda b, i: F.coalesce(F.get(types, i), F.lit(filler)))


def page_boxes(raw: Column) -> Column:
    """Boxes of one page from JSON text: a flat list of numbers is one box; null, empty and unreadable texts give none."""
    flat = F.from_json(raw, "array<double>")
    nested = F.from_json(raw, "array<array<double>>")
    none = F.array().cast("array<array<double>>")
    return F.coalesce(F.when(raw.rlike(r"^\s*\[\s*-?\d"), F.array(flat)).otherwise(nested), none)


def mask_box(xywh: Column, width: Column, height: Column) -> Column:
    """Corners of a mask's box; the whole page where it has none."""
    return F.coalesce(from_xywh(xywh, width, height), box(F.lit(0), F.lit(0), width, height))
