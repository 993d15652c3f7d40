"""Relative paths inside one root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inside_root(path: Column) -> Column:
    """The path with its ``.`` and ``..`` steps resolved, or null when it leaves the root."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("left"))

    def step(state: Column, part: Column) -> Column:
        kept, left = state["kept"], state["left"]
        up = part == ".."
        return F.struct(
            F.when(up, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(part.isin("", "."), kept)
            .otherwise(F.concat(kept, F.array(part)))
            .alias("kept"),
            (left | (up & (F.size(kept) == 0))).alias("left"),
        )

    walked = F.aggregate(F.split(path, "/"), start, step)
    return F.when(~path.startswith("/") & ~walked["left"], F.array_join(walked["kept"], "/"))
