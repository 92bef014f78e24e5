"""Boxes: parsing, normalising, overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that a box's edges go by.
EDGES = {"l": ("left", "x1", "l"), "b": ("bottom", "y1", "b"), "r": ("right", "x2", "r"), "t": ("top", "y2", "t")}


def parse_box(json: Column) -> Column:
    """struct(l, b, r, t) of a list of four numbers or of a map with named edges; null otherwise."""

    def edges(value: Column) -> Column:
        listed = [F.try_variant_get(value, f"$[{k}]", "double") for k in range(4)]
        named = [[F.try_variant_get(value, f"$.{n}", "double") for n in names] for names in EDGES.values()]
        return F.array(*(F.coalesce(a, *b) for a, b in zip(listed, named)))

    found = F.transform(F.array(F.try_parse_json(json)), edges)
    complete = F.filter(found, lambda e: F.forall(e, lambda x: x.isNotNull()))
    return F.try_element_at(F.transform(complete, lambda e: F.struct(*(e[k].alias(n) for k, n in enumerate(EDGES)))), F.lit(1))


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def normalise_box(box: Column, width: Column, height: Column) -> Column:
    """struct(x, y, width, height) in page shares, origin top left; null for an empty box or page."""
    valid = (box["r"] > box["l"]) & (box["t"] > box["b"]) & (width > 0) & (height > 0)
    return F.when(
        valid,
        F.struct(
            clamp(box["l"] / width).alias("x"),
            clamp(1 - box["t"] / height).alias("y"),
            clamp((box["r"] - box["l"]) / width).alias("width"),
            clamp((box["t"] - box["b"]) / height).alias("height"),
        ),
    )


def overlap_ratio(x0: Column, w0: Column, x1: Column, w1: Column) -> Column:
    """Horizontal overlap as a share of the narrower box."""
    shared = F.greatest(F.lit(0.0), F.least(x0 + w0, x1 + w1) - F.greatest(x0, x1))
    return shared / F.greatest(F.least(w0, w1), F.lit(1e-6))
