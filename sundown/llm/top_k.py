"""Exact top-k inner products by pivot-table elimination.

Distances of every vector to a fixed set of pivots are computed once. For a query q and a
candidate x the triangle inequality gives |q - x| >= max over pivots |d(q, p) - d(x, p)|, so the
inner product is at most (|q|^2 + |x|^2 - that^2) / 2. Within a block of candidates a query
evaluates those with the largest bounds first, and then the others whose bound reaches the k-th
score found.
Blocks of candidates are cut by nearest pivot and distance. A query first searches the block it
lies in itself, which gives it a k-th score to beat, its floor. The least and largest distances to
each pivot within a block bound a whole pair of blocks, queries of the one and candidates of the
other, in the same way: only pairs whose bound reaches the least floor are sent anywhere, and in
them candidates fall by their own bound. Neighbouring blocks with few queries share the candidates
sent to them. A task holds one block of candidates and as many queries at most; what is left of
every block is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.session import cut_lineage

SCALE = 64
PIVOTS = 24
BLOCK_ROWS = 4_096
SAMPLE_ROWS = 2_000  # from which the pivots are chosen
STEP = 256  # candidates evaluated for a floor where there is none
TILE = 32  # queries evaluated together
SPARSE = 4  # so many times the candidates that the bounds leave are evaluated, if that is one product
EXACT = float(1 << 53)  # sums of products below this are exact as doubles


def integer_vector(column: str) -> Column:
    """floor(64 * x) of every component; null for vectors that are null or hold null or non-finite components."""
    values = F.transform(column, lambda x: x.cast("double"))
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(good, F.lit(False)) & (F.size(values) > 0), F.transform(values, lambda x: F.floor(x * SCALE).cast("bigint")))


def choose_pivots(vectors: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Far apart from each other: each next pivot has the largest distance to the chosen ones."""
    if not len(vectors):
        return vectors
    chosen = [0]
    nearest = ((vectors - vectors[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(vectors)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
    return vectors[chosen]


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, then their roots."""
    square = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (vectors @ pivots.T)
    return np.sqrt(np.maximum(square, 0).astype(np.float64))


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, query_pivots: np.ndarray, floors: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
    vector_pivots: np.ndarray, k: int,
) -> tuple[list[tuple[int, int, int]], int]:
    """[(query_id, vec_id, score)] of each query's k best in the block that reach its floor, and how many were evaluated.

    Ties go to smaller ids; a floor that is NaN is none.
    """
    out: list[tuple[int, int, int]] = []
    evaluated = 0
    if not len(vectors):
        return out, evaluated
    norms = (vectors**2).sum(1)
    own = (queries**2).sum(1)
    # Cauchy and Schwarz: no sum of products is larger than the root of the norms' product.
    largest = float(max(norms.max(initial=0), own.max(initial=0)))
    table = np.ascontiguousarray(vector_pivots.T)
    points = vectors.astype(np.float64) if largest < EXACT else vectors
    asked = queries.astype(points.dtype)
    for begin in range(0, len(queries), TILE):
        tile = slice(begin, begin + TILE)
        names, some = query_ids[tile], asked[tile]
        gap = np.zeros((len(some), len(vectors)))
        for row, distance in zip(table, query_pivots[tile].T):
            np.maximum(gap, np.abs(row - distance[:, None]), out=gap)
        # A little more than the bound, for the rounding of the roots.
        bound = np.floor((own[tile, None] + norms - gap * gap * (1 - 1e-12)) / 2 + 1e-6)
        least = floors[tile].astype(np.float64)
        for i in np.flatnonzero(np.isnan(least)):
            # The k-th score of the candidates with the largest bounds is a floor for the others.
            first = np.argpartition(-bound[i], STEP - 1)[:STEP] if len(vectors) > STEP else np.arange(len(vectors))
            scores = (points[first] @ some[i])[ids[first] != names[i]]
            evaluated += len(first)
            if len(scores) >= k:
                least[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
        if points.dtype != np.float64:
            least -= np.abs(least) * 1e-15  # a score beyond ``EXACT`` may have been rounded up
        open_ = ~(bound < least[:, None])
        held = np.flatnonzero(open_.any(0))
        # One product for the tile, unless its queries look for different candidates.
        together = len(held) * len(some) <= SPARSE * np.count_nonzero(open_)
        scores = some @ points[held].T if together else None
        evaluated += scores.size if together else int(np.count_nonzero(open_))
        for i, name in enumerate(names):
            part = held if together else np.flatnonzero(open_[i])
            found = scores[i] if together else points[part] @ some[i]
            kept = ~(found < least[i]) & (ids[part] != name)
            part, found = part[kept], found[kept].astype(np.int64)
            best = np.lexsort((ids[part], -found))[:k]
            out.extend(zip([int(name)] * len(best), ids[part[best]].tolist(), found[best].tolist()))
    return out, evaluated


def _summary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The reach of a block's rows of one width: least and largest distance to each pivot, largest norm, least floor (null: none)."""
    pivots = np.array(rows["pivots"].tolist(), np.float64)
    norm = max(float((np.array(v, np.float64) ** 2).sum()) for v in rows["v"])
    floor = rows["floor"].min(skipna=False) if "floor" in rows else np.nan
    return pd.DataFrame({
        "home": [key[0]], "width": [key[1]], "low": [pivots.min(0).tolist()], "high": [pivots.max(0).tolist()], "norm": [norm],
        "least": [None if floor != floor else floor],
    })


_SUMMARY = "home int, width int, low array<double>, high array<double>, norm double, least double"


def block_pairs(asked: DataFrame, candidates: DataFrame, blocks: int) -> DataFrame:
    """(q_block, block, width) of the pairs whose bound reaches the least floor of the pair's queries.

    Only the summaries of the blocks meet, a few numbers each.
    """
    mine = asked.groupBy(F.col("q_block").alias("home"), "width").applyInPandas(_summary, _SUMMARY)
    theirs = candidates.groupBy(F.col("block").alias("home"), "width").applyInPandas(_summary, _SUMMARY).select(
        F.col("home").alias("block"), "width", F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("norm").alias("_norm"))
    met = mine.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(theirs, ["block", "width"])
    apart = F.zip_with(
        F.arrays_zip("low", "high"), F.arrays_zip("_low", "_high"),
        lambda a, b: F.greatest(F.lit(0.0), a["low"] - b["_high"], b["_low"] - a["high"]))
    gap = F.aggregate(apart, F.lit(0.0), lambda most, x: F.greatest(most, x))
    bound = (F.col("norm") + F.col("_norm") - gap * gap * (1 - 1e-9)) / 2 * (1 + 1e-12) + 1
    return met.filter(F.col("least").isNull() | (bound >= F.col("least"))).select(F.col("home").alias("q_block"), "block", "width")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, *, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all vectors but its own id.

    ``queries`` has the columns of ``vectors``. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without id; of rows that repeat an id one counts, the
    least vector. Vectors of different lengths never meet. Fewer candidates than k give all of
    them; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession

    def prepared(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("bigint").alias("id"), integer_vector(embedding).alias("v"))
        return rows.filter("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))

    ready = cut_lineage(prepared(vectors))
    sample = ready.orderBy(F.xxhash64("id", F.lit(4)), "id").limit(SAMPLE_ROWS).collect()  # bounded by its parameter
    tables = {
        w: choose_pivots(np.array([r["v"] for r in sample if r["width"] == w], np.int64)) for w in {r["width"] for r in sample}
    }
    shared = spark.sparkContext.broadcast(tables)

    def with_pivots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for width, rows in pdf.groupby("width"):
                pivots = shared.value.get(width, np.empty((0, width), np.int64))
                found = _distances(np.array(rows["v"].tolist(), np.int64), pivots)
                nearest = found.argmin(1) if len(pivots) else np.zeros(len(rows), np.int64)
                yield rows.assign(pivots=list(found), nearest=nearest.astype(np.int32))

    schema = "id bigint, v array<bigint>, width int, pivots array<double>, nearest int"
    table = cut_lineage(ready.mapInPandas(with_pivots, schema))
    count = table.count()
    # Blocks by nearest pivot keep alike vectors together; ranges bound their rows.
    blocks = max(1, -(-count // BLOCK_ROWS))
    candidates = table.repartitionByRange(blocks, "width", "nearest", F.element_at(F.concat("pivots", F.array(F.lit(0.0))), 1), "id")
    candidates = cut_lineage(candidates.withColumn("block", F.spark_partition_id()))
    asked = cut_lineage(candidates.join(prepared(queries).select("id"), "id", "left_semi"))

    def search(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int]] = []
        for width, some in mine.groupby("width"):
            others = theirs[theirs["width"] == width]
            if len(others):
                found, _ = search_block(
                    np.array(some["v"].tolist(), np.int64), some["id"].to_numpy(), np.array(some["pivots"].tolist(), np.float64),
                    some["floor"].to_numpy(np.float64), np.array(others["v"].tolist(), np.int64), others["id"].to_numpy(),
                    np.array(others["pivots"].tolist(), np.float64), k,
                )
                rows += found
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    def searched(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("q_group", "block").cogroup(right.groupBy("q_group", "block")).applyInPandas(
            search, "query_id bigint, vec_id bigint, score bigint"
        )

    # Alone in its own block: at most BLOCK_ROWS queries a block.
    none = F.lit(None).cast("double")
    home = cut_lineage(searched(
        asked.withColumns({"q_group": F.col("block"), "floor": none}), candidates.withColumn("q_group", F.col("block"))
    ))
    floors = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select(
        F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).cast("double").alias("floor")
    )
    left = cut_lineage(asked.join(floors, "id", "left").withColumnRenamed("block", "q_block"))
    most = left.groupBy("q_block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    group = F.floor(F.col("q_block") / max(1, BLOCK_ROWS // most)).cast("int")
    pairs = cut_lineage(block_pairs(left, candidates, blocks).filter("q_block <> block"))
    sent = cut_lineage(pairs.select(group.alias("q_group"), "block", "width").distinct())
    away = searched(left.join(pairs, ["q_block", "width"]).withColumn("q_group", group), candidates.join(sent, ["block", "width"]))
    best = home.unionByName(away)
    ranked = best.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k).alias("best")
    )  # at most k of every block
    return ranked.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score")
    )
