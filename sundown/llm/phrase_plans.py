"""Collocations over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sundown.llm.collocations import collocations
from sundown.sources.tables import Tables


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(Tables(spark, folder).documents)


QUERIES = {"op12_collocations": op12_collocations}

ORACLES = {
    "op12_collocations": r"""
        WITH pieces AS (
          SELECT lang, row_number() OVER () AS piece_id,
                 list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
          FROM (SELECT coalesce(lang, 'und') AS lang,
                       unnest(regexp_split_to_array(
                         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents)),
        words AS (SELECT lang, piece_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM pieces),
        runs AS (
          SELECT lang, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z
          FROM words WINDOW p AS (PARTITION BY piece_id ORDER BY i)),
        f AS (
          SELECT lang, 1 AS k, x AS phrase, count(*) AS a FROM runs GROUP BY ALL
          UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM runs WHERE y IS NOT NULL GROUP BY ALL
          UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM runs WHERE z IS NOT NULL GROUP BY ALL),
        totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS parts FROM f WHERE k >= 2 AND a >= 10),
        cuts AS (
          SELECT c.lang, c.phrase, c.k, c.a, s.j,
                 array_to_string(c.parts[1:s.j], ' ') AS lp, array_to_string(c.parts[s.j + 1:c.k], ' ') AS rp
          FROM c, (VALUES (1), (2)) AS s(j) WHERE s.j < c.k),
        valued AS (
          SELECT cuts.lang, cuts.phrase, cuts.k, cuts.a, cuts.j, x.a AS l, y.a AS r,
                 ((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
          FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.lp
               JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.rp),
        weakest AS (
          SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM valued),
        held AS (
          SELECT lang, phrase, max(a) AS a FROM (
            SELECT lang, array_to_string(parts[1:2], ' ') AS phrase, a FROM c WHERE k = 3
            UNION ALL SELECT lang, array_to_string(parts[2:3], ' '), a FROM c WHERE k = 3) GROUP BY lang, phrase),
        kept AS (
          SELECT w.* FROM weakest w LEFT JOIN held h ON h.lang = w.lang AND h.phrase = w.phrase
          WHERE w.place = 1 AND (h.a IS NULL OR 100 * h.a < 50 * w.a)),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT ranked.lang, rank, phrase, a, l, r, n, score
        FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
    """,
}
