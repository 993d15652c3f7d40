"""Phrase collocations from depth-truncated suffix subtrees, partitioned by word prefixes.

1. Texts are cut into pieces and words, and the words are counted (the first level of all trees).
   Every word starts a suffix, truncated to ``longest`` words of its piece.
2. Vertical partitioning: prefixes of two words are dealt to as many groups as the suffixes fill at
   ``GROUP_SUFFIXES`` each. Where both words are frequent ones (more than one word of ``FREQUENT``;
   by count there are fewer than ``FREQUENT`` of them), the whole suffix is the prefix, so no prefix
   takes more than that share. A task counts the equal suffixes of ``BUFFER_WORDS`` words and sends
   a group's as one sorted, compressed block.
3. Each group builds its subtree alone: its blocks' suffixes in sorted order, a node of depth k
   wherever the first k words change, its count the total of the leaves below. Nodes above a
   prefix (the trunk) are summed over the groups.
4. A phrase's halves are frequent nodes themselves, so scores join nodes only, never the corpus.

Null and empty texts have no words, a null language is ``und``; repeated rows count again; a text
of any length is read whole; an empty table gives no rows; other columns are not read. Counts are
longs, scores are computed in 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sundown.llm.common import raw_text
from sundown.session import cut_lineage

LONGEST = 3  # words of a phrase
LEAST = 10  # occurrences of a phrase
SHARE = (50, 100)  # of a phrase's occurrences inside a longer one, from which it goes
TOP = 2_000
UNIT = 1_000_000
NO_LANGUAGE = "und"

BUFFER_WORDS = 2_000_000
GROUP_SUFFIXES = 4_000_000
FREQUENT = 10_000

_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d", b"\n" * 9)


class _Ids(dict):
    """Word to number in order of appearance; the empty word, which ends a piece, is 0."""

    def __init__(self) -> None:
        super().__init__({b"": 0})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def pieces_of(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, each piece followed by an empty word."""
    found: list[bytes] = []
    for piece in text.lower().translate(_BREAKS).split(b"\n"):
        words = piece.split()
        if words:
            found += words
            found.append(b"")
    return found


def count_suffixes(numbers: np.ndarray, longest: int, known: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of word numbers (0: the piece ended) of the distinct truncated suffixes, and their counts."""
    padded = np.concatenate([numbers, np.zeros(longest - 1, np.int64)])
    starts = np.flatnonzero(numbers)
    columns = [padded[starts]]
    for k in range(1, longest):
        columns.append(np.where(columns[-1] > 0, padded[starts + k], 0))
    code = columns[0]
    for column in columns[1:-1]:
        code = code * known + column
        if known**longest >= 1 << 63:
            code = np.unique(code, return_inverse=True)[1]  # below the number of starts again
    if longest > 1:
        code = code * known + columns[-1]
    _, first, many = np.unique(code, return_index=True, return_counts=True)
    return [column[first] for column in columns], many


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], _Ids]]:
    """Word numbers per language of bounded stretches of texts, and the numbers' words."""
    held: dict[str, list[np.ndarray]] = {}
    ids, size = _Ids(), 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = pieces_of(text)
            if words:
                held.setdefault(lang, []).append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
                size += len(words)
            if size >= BUFFER_WORDS:
                yield {k: np.concatenate(v) for k, v in held.items()}, ids
                held, ids, size = {}, _Ids(), 0
    if held:
        yield {k: np.concatenate(v) for k, v in held.items()}, ids


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held, ids in _buffers(batches):
        words = pa.array(list(ids), pa.binary())
        for lang, numbers in held.items():
            many = np.bincount(numbers, minlength=len(ids))
            many[0] = 0
            found = np.flatnonzero(many)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), words.take(pa.array(found)), pa.array(many[found])], ["lang", "word", "f"]
            )


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) of (lang, text)."""
    return texts.mapInArrow(_word_counts, "lang string, word binary, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def pack(words: list[bytes], columns: list[np.ndarray], many: np.ndarray) -> bytes:
    """Sorted suffixes as one compressed value: their words, then the columns as differences and numbers."""
    used, places = np.unique(np.concatenate(columns), return_inverse=True)
    text = b"\n".join(words[i] for i in used.tolist())
    numbers = np.concatenate([places, many]).astype(np.uint32 if many.max() < 1 << 32 else np.uint64)
    numbers[1 : len(many)] = np.diff(numbers[: len(many)])  # the first column never falls
    head = np.array([len(many), len(text), numbers.itemsize], np.int64).tobytes()
    body = head + text + numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(block: bytes, longest: int) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    body = pa.decompress(block[8:], decompressed_size=int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    rows, size, width = np.frombuffer(body, np.int64, 3).tolist()
    raw = np.frombuffer(body, np.uint8, offset=24 + size).reshape(width, -1).T
    numbers = np.ascontiguousarray(raw).view(np.uint32 if width == 4 else np.uint64).ravel().astype(np.int64)
    columns = [numbers[k * rows : (k + 1) * rows] for k in range(longest)]
    return body[24 : 24 + size].split(b"\n"), [np.cumsum(columns[0]), *columns[1:]], numbers[longest * rows :]


def _blocks(longest: int, groups: int, frequent: dict[str, set[bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, ids in _buffers(batches):
            words = list(ids)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            for lang, numbers in held.items():
                columns, many = count_suffixes(numbers, longest, len(ids))
                heavy = np.fromiter((w in frequent.get(lang, ()) for w in words), bool, len(words))
                whole = heavy[columns[0]] & heavy[columns[1]]
                mixed = np.full(len(many), xxhash.xxh3_64_intdigest(lang), np.uint64)
                for k, column in enumerate(columns):
                    step = (mixed ^ hashes[column]) * np.uint64(0x9E3779B97F4A7C15)
                    step ^= step >> np.uint64(29)
                    mixed = step if k < 2 else np.where(whole, step, mixed)
                part = (mixed % np.uint64(groups)).astype(np.int64) * 2 + whole
                order = np.argsort(part, kind="stable")  # suffixes stay sorted
                edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
                for first, after in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    rows = order[first:after]
                    block = pack(words, [c[rows] for c in columns], many[rows])
                    value = int(part[rows[0]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([value // 2]), pa.array([bool(value % 2)]), pa.array([lang]), pa.array([block], pa.binary())],
                        ["part", "single", "lang", "block"],
                    )

    return run


def _subtree(longest: int, least: int):
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("f", pa.int64()), ("whole", pa.bool_())])

    def nodes(lang: str, single: bool, blocks: list[bytes]) -> Iterator[pa.Table]:
        """The nodes of one language's suffixes; ``single``: of prefixes that are whole suffixes."""
        numbers: dict[bytes, int] = {b"": 0}
        parts, counts = [], []
        for block in blocks:
            words, columns, many = unpack(block, longest)
            known = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            parts.append(np.stack([known[c] for c in columns]))
            counts.append(many)
        columns, many = np.concatenate(parts, axis=1), np.concatenate(counts)
        order = np.lexsort(columns[::-1])
        columns, many = columns[:, order], many[order]
        names = pa.array(list(numbers), pa.binary())
        changed = np.zeros(len(many), bool)
        changed[0] = True
        changed[1:] |= columns[0][1:] != columns[0][:-1]
        for k in range(2, longest + 1):
            changed[1:] |= columns[k - 1][1:] != columns[k - 1][:-1]
            first = np.flatnonzero(changed)
            totals = np.add.reduceat(many, first)
            whole = not single or k == longest  # the node's subtree is all in this group
            at = (columns[k - 1][first] > 0) & (np.full(len(first), not whole) | (totals >= least))
            first, totals = first[at], totals[at]
            phrase = names.take(pa.array(columns[0][first]))
            for column in columns[1:k]:
                phrase = pc.binary_join_element_wise(phrase, names.take(pa.array(column[first])), pa.scalar(b" ", pa.binary()))
            yield pa.table(
                [pa.array([lang] * len(first), pa.string()), phrase, pa.array(np.full(len(first), k, np.int32)), pa.array(totals),
                 pa.array(np.full(len(first), whole))], schema=schema,
            )

    def run(table: pa.Table) -> pa.Table:
        held: dict[tuple[str, bool], list[bytes]] = {}
        for lang, single, block in zip(*(table.column(c).to_pylist() for c in ("lang", "single", "block")), strict=True):
            held.setdefault((lang, single), []).append(block)
        return pa.concat_tables([t for (lang, single), blocks in held.items() for t in nodes(lang, single, blocks)] or [schema.empty_table()])

    return run


def frequent_phrases(
    texts: DataFrame, words: DataFrame, longest: int = LONGEST, least: int = LEAST, group_suffixes: int = GROUP_SUFFIXES, frequent: int = FREQUENT
) -> DataFrame:
    """(lang, phrase, words, f): phrases of up to ``longest`` words with at least ``least`` occurrences."""
    if longest < 2:
        raise ValueError("phrases have two words or more")
    total = words.agg(F.sum("f")).first()[0] or 0
    known: dict[str, set[bytes]] = {}
    for r in words.filter(F.col("f") * frequent > total).collect():  # fewer than ``frequent`` rows, by count
        known.setdefault(r["lang"], set()).add(bytes(r["word"]))
    blocks = texts.mapInArrow(_blocks(longest, 1 + total // group_suffixes, known), "part bigint, single boolean, lang string, block binary")
    nodes = cut_lineage(
        blocks.groupBy("part").applyInArrow(_subtree(longest, least), "lang string, phrase binary, words int, f bigint, whole boolean")
    )
    one = words.filter(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f")
    trunk = nodes.filter("NOT whole").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    rest = nodes.filter("whole").select("lang", "phrase", "words", "f")
    return one.unionByName(rest).unionByName(trunk).withColumn("phrase", F.col("phrase").cast("string"))


def scored(frequent: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of two words and more, by their weakest cut."""
    split = F.split("phrase", " ")

    def part(start: int | Column, length: int | Column) -> Column:
        return F.array_join(F.slice(split, start, length), " ")

    halves = [
        F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), half.alias("part")))
        for k in range(1, longest)
        for left, half in ((True, part(F.lit(1), F.lit(k))), (False, part(F.lit(k + 1), F.lit(longest))))
    ]
    cuts = frequent.filter("words >= 2").select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.filter(F.array(*halves), lambda h: h.isNotNull())).alias("h")
    )
    joined = cuts.select("lang", "phrase", "words", "a", "h.k", "h.left", F.col("h.part").alias("part")).join(
        frequent.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]
    )
    both = joined.groupBy("lang", "phrase", "words", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    exact = "decimal(18,0)"
    score = F.expr(f"(CAST({UNIT} AS decimal(7,0)) * (CAST(a AS {exact}) * CAST(a AS {exact}))) div (CAST(l AS {exact}) * CAST(r AS {exact}))")
    return (
        both.withColumn("score", score)
        .groupBy("lang", "phrase", "words", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")
    )


def inside_longer(frequent: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, held): the largest count of a longer phrase that holds the phrase's words in a row."""
    split = F.split("phrase", " ")
    parts = [
        F.when(
            (F.col("words") > size) & (F.col("words") >= start + size - 1),
            F.array_join(F.slice(split, start, size), " "),
        )
        for size in range(2, longest)
        for start in range(1, longest - size + 2)
    ]
    held = F.array_distinct(F.array_compact(F.array(*parts))) if parts else F.array().cast("array<string>")
    return (
        frequent.filter("words > 2")
        .select("lang", "f", F.explode(held).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("held"))
    )


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), raw_text(text).alias("text"))
    counted = cut_lineage(word_counts(texts))
    words = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = cut_lineage(frequent_phrases(texts, counted, longest, least))
    kept = (
        scored(frequent, longest)
        .join(inside_longer(frequent, longest), ["lang", "phrase"], "left")
        .filter(F.coalesce(F.col("held") * SHARE[1] < F.col("a") * SHARE[0], F.lit(True)))
    )
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # The planner cuts every task's rows to the first ``top`` before it deals them by language.
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
