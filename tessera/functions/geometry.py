"""Resolution choice, tiling and padding geometry of images, as arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def best_resolution(width: Column, height: Column, candidates: list[tuple[int, int]]) -> Column:
    """The (width, height) with the most effective pixels, then the least waste, then the first listed."""
    rows = []
    for i, (w, h) in enumerate(candidates):
        scale = F.least(F.lit(float(w)) / width, F.lit(float(h)) / height)
        effective = F.least((width * scale).cast("int").cast("long") * (height * scale).cast("int").cast("long"), (width * height).cast("long"))
        rows.append(F.struct((-effective).alias("e"), (F.lit(w * h) - effective).alias("waste"), F.lit(i).alias("i"), F.lit(w).alias("width"), F.lit(h).alias("height")))
    best = F.array_min(F.array(*rows))
    return F.struct(best["width"].alias("width"), best["height"].alias("height"))


def tile_boxes(width: Column, height: Column, patch: int) -> Column:
    """(x, y, right, bottom) of all tiles, by rows; tiles at the right and lower edges may stick out."""
    step = lambda n: F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(patch))
    row = lambda y: F.transform(step(width), lambda x: F.struct(x.alias("x"), y.alias("y"), (x + patch).alias("right"), (y + patch).alias("bottom")))
    return F.flatten(F.transform(step(height), row))


def fit_and_pad(width: Column, height: Column, target_w: Column, target_h: Column) -> Column:
    """(new_width, new_height, x, y) of an image scaled to fit its target and pasted in its middle."""
    by_w, by_h = target_w / width, target_h / height
    narrow = by_w < by_h
    new_w = F.when(narrow, target_w).otherwise(F.least(F.ceil(width * by_h).cast("int"), target_w))
    new_h = F.when(narrow, F.least(F.ceil(height * by_w).cast("int"), target_h)).otherwise(target_h)
    return F.struct(new_w.alias("new_width"), new_h.alias("new_height"), F.floor((target_w - new_w) / 2).cast("int").alias("x"), F.floor((target_h - new_h) / 2).cast("int").alias("y"))


def square_offsets(width: Column, height: Column) -> Column:
    """(side, x, y) of an image in the middle of its smallest square."""
    side = F.greatest(width, height)
    return F.struct(side.alias("side"), F.floor((side - width) / 2).cast("int").alias("x"), F.floor((side - height) / 2).cast("int").alias("y"))
