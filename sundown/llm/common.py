"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.session import cut_lineage

ROWS_A_TASK = 50_000
# ASCII white space as the contracts write it.
SPACE = r"[\x20\x09-\x0D]+"


def raw_text(column: str) -> Column:
    """A text as its UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, underscored until no column of ``df`` has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``function`` over Arrow batches; a batch is a bounded number of rows of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def cut_small(df: DataFrame, rows: int) -> DataFrame:
    """:func:`cut_lineage` of a result of about ``rows`` rows, in as many files as that needs."""
    tasks = 1 + rows // ROWS_A_TASK
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.coalesce(tasks) if tasks < most else df)


def together(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as one partition if its about ``rows`` rows are what a task takes: then groupings need no shuffle."""
    return df.coalesce(1) if rows <= ROWS_A_TASK else df


def _beside(df: DataFrame, rows: int) -> DataFrame:
    """The other side of a join of tables that :func:`together` made one partition: neither shuffled nor broadcast."""
    return df.hint("merge") if rows <= ROWS_A_TASK else df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id that occurs in an edge with the smallest id reachable from it.

    Each round every node joins the neighbour that comes first in a hashed order, and the edges
    are contracted. The first round's order is the plain hash of the id, so stars whose centre
    was chosen by it close at once; later ones are fresh, and a long chain shrinks by a constant
    factor a round. Hubs are summed up before they are shuffled, and the tables of a round lie in
    the shared folder. As soon as the edges left are as few as a task takes, a round's steps are one
    task each, whatever the number of shuffle partitions.
    """
    current = cut_lineage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    first_left = left = current.count()
    nodes = 2 * left
    current = together(current, left)
    labels = together(cut_small(
        current.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("component", F.col("id")), nodes
    ), first_left)
    round_ = 0
    while left:
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = current.select(F.explode(ways).alias("way")).select("way.u", "way.v")

        def rank(name: str) -> Column:
            hashed = F.xxhash64(name, F.lit(round_)) if round_ else F.xxhash64(name)
            return F.struct(hashed.alias("h"), F.col(name).alias("n"))

        moves = together(cut_small(
            both.groupBy("u")
            .agg(F.min(rank("v")).alias("best"))
            .filter(F.col("best") < rank("u"))
            .select("u", F.col("best.n").alias("to")),
            2 * left,
        ), left)
        labels = together(cut_small(
            labels.join(_beside(moves, first_left), labels.component == moves.u, "left")
            .select("id", F.coalesce("to", "component").alias("component")),
            nodes,
        ), first_left)
        first = current.join(_beside(moves, left), "u", "left").select(F.coalesce("to", "u").alias("u"), "v")
        moved = _beside(moves.select(F.col("u").alias("v"), "to"), left)
        current = together(cut_small(
            first.join(moved, "v", "left").select("u", F.coalesce("to", "v").alias("v")).filter("u <> v").distinct(), left
        ), left)
        left = current.count()
        current = together(current, left)
        round_ += 1
    least = labels.groupBy("component").agg(F.min("id").alias("least"))
    return labels.join(_beside(least, first_left), "component").select("id", F.col("least").alias("component"))
