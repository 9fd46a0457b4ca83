"""Cutting long texts into embedding windows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BOUNDARY = r"\n|[.?!] |[。；，]"


def let(value: Column, body) -> Column:
    """Bind an expression once for use inside ``body`` (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def query_windows(text: Column, window: int = 2000, max_windows: int = 10, snap: int = 400) -> Column:
    """Array of windows: equal segments snapped to a boundary when the budget covers the text,
    otherwise windows of full width with both ends pinned and the rest spread evenly."""
    most = max(2, max_windows)

    def nearest(x: Column) -> Column:
        return F.floor(x + 0.5).cast("int")

    def plan(size: Column) -> Column:
        count = F.least(F.ceil(size / F.lit(window)), F.lit(most)).cast("int")

        def cut(i: Column) -> Column:
            ideal = nearest(i * size / count)
            ceiling = F.least(size - 1, ideal + snap)
            at = F.regexp_instr(F.substr(text, ideal + 1, ceiling - ideal + 2), F.lit(BOUNDARY))
            snapped = let(at, lambda p: F.when((p > 0) & (ideal + p - 1 <= ceiling), ideal + p).otherwise(F.least(ideal, ceiling)))
            return F.when(i == 0, 0).when(i == count, size).otherwise(snapped)

        covered = let(
            F.transform(F.sequence(F.lit(0), count), cut),
            lambda cuts: F.filter(
                F.transform(
                    F.sequence(F.lit(1), count),
                    lambda i: F.substr(
                        text, F.element_at(cuts, i) + 1, F.element_at(cuts, i + 1) - F.element_at(cuts, i)
                    ),
                ),
                lambda w: F.length(w) > 0,
            ),
        )
        stride = (size - count * window) / (count - 1) + window
        sampled = F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.substr(
                text,
                F.when(i == 0, 1).when(i == count - 1, size - window + 1).otherwise(nearest(i * stride) + 1),
                F.lit(window),
            ),
        )
        return F.when(size <= window, F.array(text)).when(size <= count * window, covered).otherwise(sampled)

    return let(F.length(text), plan)
