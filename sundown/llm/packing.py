"""Best-fit packing of token pieces by a configuration linear program.

Only the histogram of piece lengths, at most one count per possible length, reaches the driver.
A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest
sequences whose configurations cover the whole histogram.

1. Where there are more than ``GROUPS`` lengths, neighbours form groups of about equal numbers of
   pieces; a group's pieces count as its longest.
2. Multiplicative weights: in each of ``PHASES`` every group is covered once more, the one covered
   least first, by the dearest configuration that holds it. What a configuration covers beyond that
   lowers its groups' prices by a small power; the sum of all phases is scaled to cover every group
   once.
3. A knapsack dynamic program over all groups prices the configurations, ``PRICINGS`` times a phase
   with the prices of the moment. Any prices bound the number of sequences from below; the phases
   end when the amounts are within ``GAP`` of the best bound. Pieces shorter than a ``SMALL``-th of a
   sequence need no program, they fill the room that the others leave.
4. Amounts are rounded to whole sequences, largest first, as long as there are pieces; groups are
   read back as their pieces. What is left is packed best fit, longest piece first, into the room
   that configurations leave and into new sequences.

A piece finds its place from its rank among the pieces of its length, which two sums give without
sorting.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sundown.llm.common import raw_text
from sundown.llm.tokens import END, encoder
from sundown.session import cut_lineage

CAPACITY = 4096
GROUPS = 512
PHASES = 48  # in each, every group is covered once more
PRICINGS = 8  # knapsacks of a phase
RATE = 0.05
GAP = 0.001
SMALL = 16  # pieces shorter than this part of a sequence fill the room that the others leave

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, rank_in_part bigint"


def cut_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token pieces of every row; ``ids`` are little-endian unsigned 32-bit integers.

    A null text is empty and holds the end id alone. ``rank_in_part`` counts the earlier pieces
    of the same length in the same task.
    """
    names = [f.split()[0] for f in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                out: list[tuple] = []
                for name, value in zip(rows.column("doc_id").to_pylist(), rows.column("text")):
                    ids = encode(value.as_py()) + END
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start : start + 4 * capacity]
                        length = len(cut) // 4
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        out.append((name, piece, start // 4, length, cut, part, rank))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw_text(text).alias("text"))
    return source.mapInArrow(run, _PIECES)


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each length (lengths falling): each its own, or neighbours of about equal numbers of pieces."""
    if len(lengths) <= groups:
        return np.arange(len(lengths))
    target = counts.sum() / groups
    middle = np.cumsum(counts) - counts / 2
    _, group = np.unique((middle / target).astype(np.int64), return_inverse=True)
    return group


class Knapsack:
    """The dearest configuration for every room, lengths repeating freely."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, capacity: int) -> None:
        self.lengths, self.prices, self.capacity = lengths, prices, capacity
        order = np.argsort(lengths, kind="stable")
        sizes, worth = lengths[order], prices[order]
        self.best = np.zeros(capacity + 1)
        self.took = np.full(capacity + 1, -1)
        upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
        for room in range(1, capacity + 1):
            self.best[room] = self.best[room - 1]
            n = upto[room]
            if n:
                value = self.best[room - sizes[:n]] + worth[:n]
                i = int(value.argmax())
                if value[i] > self.best[room]:
                    self.best[room], self.took[room] = value[i], order[i]

    def configuration(self, room: int) -> dict[int, int]:
        """{index of a length: copies}"""
        chosen: dict[int, int] = {}
        while room > 0:
            i = int(self.took[room])
            if i < 0:
                room -= 1
                continue
            chosen[i] = chosen.get(i, 0) + 1
            room -= int(self.lengths[i])
        return chosen

    def columns(self) -> list[dict[int, int]]:
        """The dearest configuration, and the dearest with each length."""
        found = [self.configuration(self.capacity)]
        for i, length in enumerate(self.lengths.tolist()):
            config = self.configuration(self.capacity - length)
            config[i] = config.get(i, 0) + 1
            found.append(config)
        return found


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations with amounts that cover the counts, and a lower bound of the number of sequences."""
    size = len(lengths)
    weight = lengths * counts / lengths.dot(counts)  # of a whole group; the logarithm falls with its cover
    cover = np.zeros(size)
    found: dict[tuple, float] = {}
    bound, best = 0.0, (np.inf, [])
    for phase in range(1, PHASES + 1):
        waiting = np.argsort(cover, kind="stable")
        for chosen in np.array_split(waiting, max(1, min(PRICINGS, size // 4))):
            price = weight * np.exp(-RATE * (cover - cover.mean())) / counts
            sack = Knapsack(lengths, price, capacity)
            bound = max(bound, float(price.dot(counts)) / float(sack.best[capacity]))
            for i in chosen.tolist():
                need = phase - cover[i]
                if need <= 0:
                    continue
                config = sack.configuration(capacity - int(lengths[i]))
                config[i] = config.get(i, 0) + 1
                # More copies than there are pieces cover nothing more.
                config = {j: min(k, int(counts[j])) for j, k in config.items()}
                amount = need * counts[i] / config[i]
                for j, k in config.items():
                    cover[j] += amount * k / counts[j]
                key = tuple(sorted(config.items()))
                found[key] = found.get(key, 0.0) + amount
        # For the bound, a group that only cheap configurations hold may be as dear as it makes them.
        price = weight * np.exp(-RATE * (cover - cover.mean())) / counts
        sack = Knapsack(lengths, price, capacity)
        dearest = price + sack.best[capacity - lengths]
        raised = price + float(sack.best[capacity]) - dearest
        bound = max(bound, float(raised.dot(counts)) / float(Knapsack(lengths, raised, capacity).best[capacity]))
        if phase % 4 == 0:
            least = float(cover.min())
            value = sum(found.values()) / least
            if value < best[0]:
                best = (value, [(dict(key), amount / least) for key, amount in found.items()])
            if value <= bound * (1 + GAP):
                break
    return best[1], bound


def plan_with_bound(
    histogram: dict[int, int], capacity: int = CAPACITY
) -> tuple[list[tuple[list[tuple[int, int]], int]], float]:
    """[(configuration as [(length, copies)], sequences)] that hold exactly the pieces of the histogram, and the program's lower bound.

    The bound holds for any packing; with groups it is that of the shortest piece of each.
    """
    sizes = sorted((l for l, n in histogram.items() if n > 0), reverse=True)
    if not sizes:
        return [], 0.0
    lengths = np.array(sizes, np.int64)
    counts = np.array([histogram[l] for l in sizes], np.int64)
    total = float(lengths.dot(counts)) / capacity
    large = lengths * SMALL >= capacity
    small = {int(l): int(n) for l, n in zip(lengths[~large], counts[~large])}
    lengths, counts = lengths[large], counts[large]
    if not len(lengths):
        return _best_fit(small, capacity), total
    group = grouped(lengths, counts)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    longest, pieces = lengths[first], np.add.reduceat(counts, first)
    solved, bound = fractional(longest, pieces, capacity)
    if len(first) < len(lengths):
        shortest = lengths[np.append(first[1:], len(lengths)) - 1]
        bound = fractional_bound(shortest, pieces, capacity)
    queues = [[[int(l), int(n)] for l, n in zip(lengths[group == g], counts[group == g])] for g in range(len(first))]
    left = pieces.copy()
    plan: list[tuple[list[tuple[int, int]], int]] = []
    for config, amount in sorted(solved, key=lambda c: -c[1]):
        many = min([int(np.ceil(amount - 1e-6)), *(int(left[g]) // k for g, k in config.items())])
        if amount < 0.5 or many < 1:
            continue
        for g, k in config.items():
            left[g] -= many * k
        while many:
            # As many equal sequences as the pieces at the heads of the queues give.
            taken = [(g, *_head(queues[g], k)) for g, k in config.items()]
            run = min([many, *(n for _, _, n in taken)])
            plan.append((_merged([p for _, chosen, _ in taken for p in chosen]), run))
            for g, chosen, _ in taken:
                _take(queues[g], chosen, run)
            many -= run
    rest = dict(small)
    for queue in queues:
        for length, n in queue:
            if n:
                rest[length] = rest.get(length, 0) + n
    return _best_fit(rest, capacity, plan), max(bound, total)


def fractional_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> float:
    """A lower bound from prices in proportion to the lengths, by the fullest configuration."""
    sack = Knapsack(lengths, lengths.astype(float), capacity)
    return float(lengths.dot(counts)) / float(sack.best[capacity])


def _merged(config: list[tuple[int, int]]) -> list[tuple[int, int]]:
    held: dict[int, int] = {}
    for length, k in config:
        held[length] = held.get(length, 0) + k
    return sorted(held.items(), reverse=True)


def _head(queue: list[list[int]], k: int) -> tuple[list[tuple[int, int]], int]:
    """The next ``k`` pieces of a group as [(length, copies)], and how many sequences can take the same."""
    while queue and not queue[0][1]:
        queue.pop(0)
    if queue[0][1] >= k:
        return [(queue[0][0], k)], queue[0][1] // k
    chosen, need = [], k
    for length, n in queue:
        if n:
            chosen.append((length, min(n, need)))
            need -= chosen[-1][1]
            if not need:
                break
    return chosen, 1


def _take(queue: list[list[int]], chosen: list[tuple[int, int]], run: int) -> None:
    for length, k in chosen:
        next(q for q in queue if q[0] == length)[1] -= k * run


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    return plan_with_bound(histogram, capacity)[0]


def _best_fit(
    histogram: dict[int, int], capacity: int, begun: list[tuple[list[tuple[int, int]], int]] | None = None
) -> list[tuple[list[tuple[int, int]], int]]:
    """Longest piece first into the open sequence with the least room; equal sequences are kept as one with a count.

    ``begun`` are sequences that hold pieces already.
    """
    open_: dict[int, list[list]] = {}  # room -> [[configuration, sequences]]
    rooms: list[int] = []

    def put(room: int, config: list[tuple[int, int]], many: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([config, many])

    for config, many in begun or []:
        put(capacity - sum(l * k for l, k in config), config, many)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, [(length, each)], left // each)
                    left %= each
                else:
                    put(capacity - left * length, [(length, left)], 1)
                    left = 0
                continue
            room = rooms[at]
            group = open_[room]
            config, many = group.pop()
            if not group:
                del open_[room]
                rooms.pop(at)
            each = min(room // length, left)
            used = min(many, left // each)
            put(room - each * length, [*config, (length, each)], used)
            if many > used:
                put(room, config, many - used)
            left -= each * used
    return [(config, many) for group in open_.values() for config, many in group]


class Places:
    """Where the piece of a length with a rank goes."""

    def __init__(self, plan: list[tuple[list[tuple[int, int]], int]]) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        filled: dict[int, int] = {}
        sequence = 0
        for config, many in plan:
            offset = 0
            for length, copies in config:
                rows.setdefault(length, []).append((filled.get(length, 0), copies, sequence, offset))
                filled[length] = filled.get(length, 0) + copies * many
                offset += copies * length
            sequence += many
        self.sequences = sequence
        self.rows = {length: np.array(found, np.int64).T for length, found in rows.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequences, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths).tolist():
            here = np.flatnonzero(lengths == length)
            first, copies, sequence, offset = self.rows[length]
            at = np.searchsorted(first, ranks[here], side="right") - 1
            turn = ranks[here] - first[at]
            sequences[here] = sequence[at] + turn // copies[at]
            offsets[here] = offset[at] + turn % copies[at] * length
        return sequences, offsets


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece.

    Null and empty texts are the end id alone; null and repeated doc_ids are packed like others;
    an empty table gives no rows; other columns are ignored.
    """
    pieces = cut_lineage(cut_pieces(docs, vocabulary, capacity, doc_id, text))
    counts = cut_lineage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = Places(plan_sequences(histogram, capacity))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids", (F.col("base") + F.col("rank_in_part")).alias("rank")
    )
    kept = ["doc_id", "piece", "start", "length", "ids"]
    shared = docs.sparkSession.sparkContext.broadcast(places)  # bounded by the program's steps and the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, offsets = shared.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequences), pa.array(offsets)], [*kept, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"
    )
