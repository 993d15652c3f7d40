"""Passages that repeat anywhere in the corpus, found by FM-indexes over shards.

A window is ``words`` consecutive words of one text. It goes if its words also start anywhere else.

1. Every row's words are written once, compressed, under a number of their own, in buckets.
2. Sharding. Of the hashes of the ``GRAM``-word grams in a window the smallest is its anchor, so
   equal windows have equal anchors. Consecutive windows of one anchor form a segment. Anchors
   that stand at one place only can't belong to a repeated window; all other segments get a digest of
   their words, equal segments become one with a weight, whose words are fetched from one of its texts,
   and these are dealt to shards by anchor. A shard so holds every occurrence of its windows, and no
   text meets all shards.
3. Where one anchor's different segments pass ``HOT_BYTES`` (a short passage in many surroundings),
   its windows are dealt singly by their own hash, those that occur once left out.
4. Each shard builds an FM-index over its segments: suffix order by prefix doubling, the
   Burrows-Wheeler transform in a wavelet matrix, word numbers from the shard's own dictionary.
   Stretches of its segments are streamed through it, all in lockstep from their last word to
   their first, and the weight of a match's suffix interval counts its occurrences. The interval of
   a match's last ``SEED`` words is known from the suffix order, from there on each word is a step.
   A match that stays at two and more reaches window after window in one step each; one that falls
   below rules out every window that holds it, and the search goes on before them. Runs of windows
   found twice are reported.
5. The runs are laid over the texts and the words that they cover are removed.

Words are compared as they are, so two different windows never count as equal; hashes only decide
which windows meet, and equal words have equal hashes. Rows are judged on the input, so all copies
lose a repeated window. Null and empty texts have no words; rows without doc_id and rows that
repeat one are texts like any other; texts of any length are read whole; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sundown.llm.common import SPACE, map_batches, raw_text
from sundown.session import cut_bucketed, cut_lineage

WORDS = 35
GRAM = 8  # words of an anchor
SEGMENT_WINDOWS = 1_024
SHARD_BYTES = 4 << 20
HOT_BYTES = 1 << 20
BATCH_BYTES = 16 << 20
TEXT_BYTES = 1 << 20  # of texts whose anchors are found together
LONG_WORD = 256  # bytes
SEED = 16  # last words of a match, which the index looks up at once
STRETCH = 64  # windows of one search
CHUNK = 8_192

_MIX = np.random.default_rng(35_012).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


# Masks of a word's last bytes, by their number.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_BELOW = np.array([(1 << k) - 1 for k in range(64)], np.uint64)


class Words:
    """Texts of words, joined by one space: the place of every word, and each text's first word."""

    def __init__(self, texts: list[bytes]) -> None:
        self.joined = b" ".join(texts)
        self.bytes = np.frombuffer(self.joined + bytes(8), np.uint8)
        spaces = np.flatnonzero(self.bytes[:-8] == 32)
        self.starts = np.concatenate([[0], spaces + 1])
        self.ends = np.append(spaces, len(self.joined))
        self.texts = np.searchsorted(self.starts, np.cumsum([0] + [len(t) + 1 for t in texts]))

    def span(self, first: int, after: int) -> bytes:
        """Some consecutive words of one text."""
        return self.joined[self.starts[first] : self.ends[after - 1]]

    def hashes(self) -> np.ndarray:
        """A hash of every word, eight of its bytes at a time."""
        eight = np.ndarray(len(self.bytes) - 7, "<u8", self.bytes, strides=(1,))
        at, left = self.starts, self.ends - self.starts
        out, rest = left.astype(np.uint64) * _MIX[-2], np.arange(len(left))
        for _ in range(LONG_WORD // 8):
            mixed = (out[rest] ^ (eight[at] & _BYTES[np.minimum(left, 8)])) * _MIX[-1]
            out[rest] = mixed ^ (mixed >> np.uint64(31))
            more = left > 8
            rest, at, left = rest[more], at[more] + 8, left[more] - 8
            if not len(rest):
                break
        for word, start, many in zip(rest.tolist(), at.tolist(), left.tolist(), strict=True):
            out[word] ^= np.uint64(xxhash.xxh3_64_intdigest(self.joined[start : start + many]))
        return out


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values."""
    count, held = len(values) - width + 1, 1
    while 2 * held <= width:
        values = np.minimum(values[:-held], values[held:])
        held *= 2
    return np.minimum(values[:count], values[width - held : width - held + count])


def anchors(words: Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window, and the hash of every gram, as if the texts were one."""
    hashed = words.hashes()
    grams = np.zeros(len(hashed) - gram + 1, np.uint64)
    for k in range(gram):
        grams ^= hashed[k : k + len(grams)]
        grams *= _MIX[k]
        grams ^= grams >> np.uint64(31)
    return least(grams, size - gram + 1), grams


def segments_of(found: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window and number of windows of each segment; ``texts`` are the texts' first words and the end of the last."""
    change = np.empty(len(found), bool)
    change[0] = True
    np.not_equal(found[1:], found[:-1], out=change[1:])
    change[texts[:-1]] = True
    # Windows that reach into the next text are none.
    edge = np.zeros(len(found) + 1, np.int8)
    edge[texts[1:-1] - size + 1] = 1
    edge[texts[1:-1]] -= 1
    change &= np.cumsum(edge[:-1], dtype=np.int8) == 0
    first = np.flatnonzero(change)
    text = np.searchsorted(texts, first, "right") - 1
    many = np.minimum(np.append(first[1:], len(found)), texts[text + 1] - size + 1) - first
    if many.max() > SEGMENT_WINDOWS:
        pieces = -(-many // SEGMENT_WINDOWS)
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        text, first, many = (np.repeat(a, pieces) for a in (text, first, many))
        first, many = first + piece * SEGMENT_WINDOWS, np.minimum(many - piece * SEGMENT_WINDOWS, SEGMENT_WINDOWS)
    return text, first, many


def anchor_repeats(grams: np.ndarray, width: int, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Whether a segment's anchor stands at more than one place of it: then even its own windows may be equal."""
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    out = np.empty(len(first), bool)
    for start in range(0, len(first), CHUNK):
        begin = first[start : start + CHUNK]
        last = begin + many[start : start + CHUNK] - 1
        out[start : start + CHUNK] = begin + view[begin].argmin(axis=1) != last + width - 1 - view[last][:, ::-1].argmin(axis=1)
    return out


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit vector with a running count per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels = []
        current = symbols
        for shift in range(bits - 1, -1, -1):
            bit = ((current >> shift) & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((shift, packed, before, len(bit) - int(before[-1])))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        known = np.arange(1 << bits)
        self.starts = self._down(known, np.zeros(len(known), np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, packed, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & _BELOW[at & 63])
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._down(symbols, at) - self.starts[symbols]


def suffix_order(text: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of ``text``; every 0 ends a segment and is smaller than all words and than the zeros after it.

    With it, for each place, the interval of the suffixes that begin with the same ``seed`` words.
    Suffixes are ordered by their first few words, then by twice as many; those that stand alone stay where they are.
    """
    size, ends = len(text), text == 0
    count = int(ends.sum())
    symbols = np.where(ends, np.cumsum(ends), text + count)
    bits = int(symbols.max()).bit_length()
    depth = max(1, min(62 // bits, seed))
    key = symbols.copy()
    for k in range(1, min(depth, size)):
        key <<= bits
        key[: size - k] |= symbols[k:]
    order = np.argsort(key)
    key = key[order]
    slots = np.arange(size)  # of the suffixes that share their place with others
    rank, after = np.empty(size, np.int64), np.empty(size, np.int64)
    low = high = None
    while True:
        # Groups of equal keys: a suffix's rank is the first slot of its group.
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(first, len(key)))
        members = order[slots]
        rank[members] = np.repeat(slots[first], many)
        after[members] = np.repeat(slots[first] + many, many)
        if depth >= seed and low is None:
            low, high = rank.copy(), after.copy()
        slots = slots[np.repeat(many > 1, many)]
        if not len(slots):
            return (order, rank, after) if low is None else (order, low, high)
        members = order[slots]
        step = min(depth, seed - depth) if depth < seed else depth
        key = rank[members] * size + rank[members + step]
        way = np.argsort(key)
        order[slots], key = members[way], key[way]
        depth += step


class FmIndex:
    """Weighted counts of word sequences in segments of word numbers (from 1); ``seed`` words of a match are looked up at once."""

    def __init__(self, segments: list[np.ndarray], weights: np.ndarray, seed: int = 1) -> None:
        lengths = np.array([len(s) for s in segments])
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.seed = seed
        self.text = np.zeros(int(self.ends[-1]) + 1, np.int64)
        words = np.ones(len(self.text), bool)
        words[self.ends] = False
        self.text[words] = np.concatenate(segments)
        order, self.low, self.high = suffix_order(self.text, seed)
        known = int(self.text.max()) + 1
        self.matrix = WaveletMatrix(self.text[order - 1], max(1, (known - 1).bit_length()))  # before the first word stands an end
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=known))])
        self.weight = np.concatenate([[0], np.cumsum(np.repeat(weights, lengths + 1)[order])])

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the intervals of the matches with the symbol before them."""
        both = self.matrix.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        first = self.smaller[symbols]
        return first + both[: len(symbols)], first + both[len(symbols) :]

    def repeated(self, size: int, least: int = 2) -> np.ndarray:
        """Whether ``size`` words from each place of the text occur in total weight ``least`` or more."""
        if self.seed > size:
            raise ValueError("a seed lies inside the window")
        found = np.zeros(len(self.text), bool)
        # A search decides a stretch of a segment's windows, from the last to the first.
        stretches = np.maximum(self.ends - size - self.starts + STRETCH, 0) // STRETCH
        start = np.repeat(self.starts, stretches)
        start += STRETCH * (np.arange(len(start)) - np.repeat(np.cumsum(stretches) - stretches, stretches))
        window = np.minimum(start + STRETCH - 1, np.repeat(self.ends - size, stretches))  # the window to decide
        last = window + size - 1  # last word of the match
        at = last - self.seed + 1
        low, high = self.low[at], self.high[at]
        while len(at):
            often = self.weight[high] - self.weight[low] >= least
            full = often & (at == window)
            found[window[full]] = True
            # A match that is too rare rules out all windows that hold it.
            rare = ~often
            short = rare & (last - at < size)
            window = np.where(full, window - 1, np.where(short, last - size, window))
            last = np.where(rare, window + size - 1, last)
            at = np.where(rare, last - self.seed + 1, at - 1)
            going = window >= start
            if not going.all():
                start, window, last, at, low, high, often = (a[going] for a in (start, window, last, at, low, high, often))
            again, on = np.flatnonzero(~often), np.flatnonzero(often)
            low[again], high[again] = self.low[at[again]], self.high[at[again]]
            low[on], high[on] = self.extend(self.text[at[on]], low[on], high[on])
        return found


def repeated_runs(contents: pa.Array, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, first and last window of the runs of windows that occur twice or more, counted by weight."""
    words = pc.split_pattern(contents, b" ")
    numbers = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    segments = np.split(numbers, np.cumsum(pc.list_value_length(words).to_numpy())[:-1])
    index = FmIndex(segments, weights, min(SEED, size))
    edge = np.diff(np.concatenate([[0], index.repeated(size).astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    owner = np.searchsorted(index.ends, first)
    return owner, first - index.starts[owner], last - index.starts[owner]


def packed(words: bytes) -> bytes:
    return len(words).to_bytes(8, "little") + pa.compress(words, codec="zstd", asbytes=True)


def unpacked(held: bytes) -> bytes:
    return pa.decompress(held[8:], decompressed_size=int.from_bytes(held[:8], "little"), codec="zstd", asbytes=True)


def _keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = [text.split() for text in batch.column("text").to_pylist()]
    joined = [b" ".join(w) for w in words]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), pa.array([hashlib.sha256(j).digest() for j in joined], pa.binary()),
            pa.array([len(w) for w in words], pa.int64()), pa.array([packed(j) for j in joined], pa.binary()),
        ],
        ["doc_id", "key", "n_words", "held"],
    )


def _segments(size: int, gram: int):
    names = ["id", "start", "windows", "places", "anchor"]
    types = [np.int64, np.int32, np.int32, np.int32, np.int64]

    def found_in(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        words = Words(texts)
        found, grams = anchors(words, size, gram)
        text, first, many = segments_of(found, words.texts, size)
        places = 1 + anchor_repeats(grams, size - gram + 1, first, many)
        columns = [np.array(ids)[text], first - words.texts[text], many, places, found[first].view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t, copy=False)) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for row, value in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), strict=True):
                ids.append(row)
                texts.append(unpacked(value))
                held += len(texts[-1])
                if held >= TEXT_BYTES:
                    yield found_in(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield found_in(ids, texts)

    return run


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], wide: int) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded bytes; column ``wide`` holds the long values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[wide]) + 100
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, dict, bytes]]:
    """Text, part and the part's words."""
    for batch in batches:
        for row, held, parts in zip(*(batch.column(c).to_pylist() for c in ("id", "held", "parts")), strict=True):
            words = Words([unpacked(held)])
            for p in parts:
                yield row, p, words.span(p["start"], p["start"] + p["windows"] + size - 1)


def _digests(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for row, p, content in _parts(batches, size):
            yield row, p["start"], p["windows"], p["anchor"], hashlib.blake2b(content, digest_size=16).digest()

    names = ["id", "start", "windows", "anchor", "segment"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return lambda batches: _batched(rows(batches), names, types, 4)


def _contents(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, p, content in _parts(batches, size):
            yield p["segment"], p["copies"], p["anchor"], len(content), content

    names = ["segment", "copies", "anchor", "bytes", "content"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return lambda batches: _batched(rows(batches), names, types, 4)


def _single_windows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for segment, copies, content in zip(*(batch.column(c).to_pylist() for c in ("segment", "copies", "content")), strict=True):
                words = content.split(b" ")
                for i in range(len(words) - size + 1):
                    yield segment, copies, i, hashlib.blake2b(b" ".join(words[i : i + size]), digest_size=16).digest()

    names, types = ["segment", "copies", "place", "window"], [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    return lambda batches: _batched(rows(batches), names, types, 3)


def _window_contents(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content, parts in zip(batch.column("content").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                words = content.split(b" ")
                for p in parts:
                    yield p["window"], p["copies"], b" ".join(words[p["place"] : p["place"] + size])

    names, types = ["segment", "copies", "content"], [pa.binary(), pa.int64(), pa.binary()]
    return lambda batches: _batched(rows(batches), names, types, 2)


def _searched(size: int):
    def run(table: pa.Table) -> pa.Table:
        owner, first, last = repeated_runs(table.column("content").combine_chunks(), table.column("copies").to_numpy(), size)
        return pa.table({"segment": table.column("segment").take(pa.array(owner)), "first": pa.array(first), "last": pa.array(last)})

    return run


def _search(shards: DataFrame, size: int, shard_bytes: int) -> DataFrame:
    """(segment, first, last) of (segment, copies, anchor, bytes, content); equal anchors meet."""
    total = shards.agg(F.sum("bytes")).first()[0] or 0
    dealt = shards.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(1 + total // shard_bytes)))
    return dealt.select("shard", "segment", "copies", "content").groupBy("shard").applyInArrow(
        _searched(size), "segment binary, first bigint, last bigint"
    )


def _search_single(hot: DataFrame, size: int, shard_bytes: int) -> DataFrame:
    """The same for segments whose anchors are too frequent: their windows one by one."""
    windows = cut_lineage(hot.select("segment", "copies", "content").mapInArrow(
        _single_windows(size), "segment binary, copies bigint, place bigint, window binary"
    ))
    shared = (
        windows.groupBy("window")
        .agg(F.sum("copies").alias("copies"), F.min(F.struct("segment", "place")).alias("of"))
        .filter("copies > 1")
    )
    fetched = (
        shared.groupBy(F.col("of.segment").alias("segment"))
        .agg(F.collect_list(F.struct("window", "copies", F.col("of.place").alias("place"))).alias("parts"))  # a segment's windows
        .join(hot.select("segment", "content"), "segment")
        .mapInArrow(_window_contents(size), "segment binary, copies bigint, content binary")
    )
    found = _search(cut_lineage(fetched.withColumns({"anchor": F.col("segment"), "bytes": F.octet_length("content")})), size, shard_bytes)
    return found.select(F.col("segment").alias("window")).join(windows, "window").select(
        "segment", F.col("place").alias("first"), F.col("place").alias("last")
    )


def repeated_segments(
    texts: DataFrame, size: int = WORDS, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """(id, first, last): runs of repeated windows in texts (id, held) of ``size`` words and more."""
    if not 0 < gram <= size:
        raise ValueError("an anchor has at least one word and lies inside the window")
    cut = cut_lineage(texts.mapInArrow(_segments(size, gram), "id bigint, start int, windows int, places int, anchor bigint"))
    shared = cut.groupBy("anchor").agg(F.sum("places").alias("n")).filter("n > 1").select("anchor")
    parts = (
        cut.select("id", "start", "windows", "anchor").join(shared, "anchor", "left_semi")
        .groupBy("id")
        .agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("parts"))  # of one text
    )
    held = cut_lineage(
        texts.join(parts, "id").mapInArrow(_digests(size), "id bigint, start int, windows int, anchor bigint, segment binary")
    )
    # Of equal segments the words of one are fetched.
    owners = (
        held.groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"), F.min_by("start", "id").alias("start"),
            F.first("windows").alias("windows"), F.first("anchor").alias("anchor"),
        )
        .groupBy("id")
        .agg(F.collect_list(F.struct("segment", "copies", "start", "windows", "anchor")).alias("parts"))  # of one text
    )
    classes = cut_lineage(texts.join(owners, "id").mapInArrow(
        _contents(size), "segment binary, copies bigint, anchor bigint, bytes bigint, content binary"
    ))
    heavy = cut_lineage(classes.groupBy("anchor").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > hot_bytes).select("anchor"))
    found = _search(classes.join(heavy, "anchor", "left_anti"), size, shard_bytes)
    if not heavy.isEmpty():
        found = found.unionByName(_search_single(classes.join(heavy, "anchor", "left_semi"), size, shard_bytes))
    return held.select("id", "start", "segment").join(cut_lineage(found), "segment").select(
        "id", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")
    )


def _kept(size: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, digests, texts = [], [], []
        for held, runs in zip(batch.column("held").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            words = Words([unpacked(held)])
            edge = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(edge, [r["first"] for r in runs], 1)
            np.add.at(edge, [r["last"] + size for r in runs], -1)
            covered = np.cumsum(edge[:-1]) > 0
            change = np.diff(np.concatenate([[0], ~covered, [0]]))  # stretches of words that stay
            stay = zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True)
            left = b" ".join([words.span(first, after) for first, after in stay])
            removed.append(int(covered.sum()))
            digests.append(hashlib.sha256(left).hexdigest())
            texts.append(left)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary())],
            ["id", "n_removed", "kept_sha256", "kept_text"],
        )

    return run


def _cleaned(docs: DataFrame, doc_id: str, text: str, size: int, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(id, doc_id, key, n_words) of the rows, and (id, n_removed, kept_sha256, kept_text) of those that lose words."""
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw_text(text).alias("text"))
    keyed = map_batches(source, _keyed, "doc_id bigint, key binary, n_words bigint, held binary")
    # Texts are dealt by their number once; both joins below find them in place.
    rows = cut_bucketed(keyed.withColumn("id", F.monotonically_increasing_id()), "id")
    texts = rows.filter(F.col("n_words") >= size).select("id", "held")
    laid = repeated_segments(texts, size, **limits).groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # of one text
    cleaned = map_batches(texts.join(laid, "id"), _kept(size), "id bigint, n_removed bigint, kept_sha256 string, kept_text binary")
    return rows.select("id", "doc_id", "key", "n_words"), cleaned


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, **limits: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row: the digest of the words that stay, joined by one space."""
    rows, cleaned = _cleaned(docs, doc_id, text, words, **limits)
    return rows.join(cleaned.drop("kept_text"), "id", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("kept_sha256", F.lower(F.hex("key"))).alias("kept_sha256"),
    )


def cleaned_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, **limits: int) -> DataFrame:
    """doc_id, n_removed, text per row; a text that loses nothing stays as it is, the others keep their words, joined by one space."""
    rows, cleaned = _cleaned(docs, doc_id, text, words, **limits)
    spaced = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " "))
    named = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.unhex(F.sha2(spaced.cast("binary"), 256)).alias("key")
    )
    # Rows with the same words lose the same ones.
    kept = rows.select("id", "key").join(cleaned, "id").dropDuplicates(["key"]).select(
        "key", "n_removed", F.col("kept_text").cast("string").alias("kept"))
    return named.join(kept, "key", "left").select(
        "doc_id", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept", "text").alias("text")
    )
