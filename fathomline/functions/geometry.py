"""Areas of rectangles on a page."""

from __future__ import annotations

import math
from collections.abc import Iterable


def clipped(box: dict, width: float, height: float) -> tuple[float, float, float, float] | None:
    """A rectangle (x0, y0, x1, y1; corners in any order) inside the page; None where nothing of it is, or a number is missing."""
    corners = [box[k] for k in ("x0", "y0", "x1", "y1")]
    if any(c is None or not math.isfinite(c) for c in corners):
        return None
    (x0, x1), (y0, y1) = sorted(corners[::2]), sorted(corners[1::2])
    x0, y0, x1, y1 = max(0.0, x0), max(0.0, y0), min(width, x1), min(height, y1)
    return (x0, y0, x1, y1) if x1 > x0 and y1 > y0 else None


def union_area(boxes: Iterable[tuple[float, float, float, float]]) -> float:
    """Area that rectangles cover together: strips between neighbouring edges, in each the length that is covered."""
    boxes = list(boxes)
    edges, total = sorted({x for b in boxes for x in (b[0], b[2])}), 0.0
    for left, right in zip(edges, edges[1:], strict=False):
        top, covered = float("-inf"), 0.0
        for low, high in sorted((b[1], b[3]) for b in boxes if b[0] <= left and b[2] >= right):
            covered += max(0.0, high - max(low, top))
            top = max(top, high)
        total += covered * (right - left)
    return total
