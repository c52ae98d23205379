"""Dealing the records of a group to shards and bins: balanced, as few as fit, or first fit.

Placing depends on what was placed before, so a group (a project, an owner) is placed in one
task, from rows of an id and two numbers; groups are dealt out over all tasks, which walk them one after another.
Of a group of more than HELD records only the distinct sizes and their counts meet in a task: records of one size are
placed in turn, so that their rank by id names their place in that turn, and a join tells each its bin.
Ids are compared by their UTF-8 bytes. Every placing takes logarithmic time in the shards.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.groups import folded, in_batches

#: Records of a shard; targets and bytes of a bin. Then records of a group that a task holds, and placings that it gives at once.
SHARD_RECORDS, BIN_TARGETS, BIN_BYTES = 512, 64, 1_000_000
HELD, PIECE = 100_000, 50_000
#: Records beyond which a group is refused, for one who wants that; by default none is.
MOST: int | None = None

Record = tuple[bytes, int, int]
#: Bytes, content bytes, and how many records of a group have them.
Size = tuple[int, int, int]
#: Bytes and content bytes, the rank of the first of some records that have them, and the shards of these.
Piece = tuple[int, int, int, np.ndarray]


def _largest_first(records: list[Record], second: bool = True) -> list[int]:
    return sorted(range(len(records)), key=lambda i: (-records[i][1], -records[i][2] if second else 0, records[i][0]))


def balanced(records: list[Record], count: int, second: bool = True, order: list[int] | None = None) -> list[int]:
    """The shard of each of the records (id, bytes, content bytes), the largest first, each to the lightest shard.

    Lightest by bytes, then content bytes (if ``second``), then records, then number.
    """
    if count == 1:
        return [0] * len(records)
    heap, shard = [(0, 0, 0, k) for k in range(count)], [0] * len(records)
    for i in _largest_first(records, second) if order is None else order:
        size, content, n, k = heap[0]
        heapq.heapreplace(heap, (size + records[i][1], content + records[i][2] * second, n + 1, k))
        shard[i] = k
    return shard


def balanced_counted(sizes: Iterable[Size], count: int, content: int, records: int) -> Iterator[Piece]:
    """What ``balanced`` gives, from the distinct sizes, the largest first; ``content`` is the sum of their absolute content bytes, ``records`` of their counts.

    A shard is one integer of its bytes, content bytes, records and number, which has their order and grows by one sum.
    """
    heap = list(range(count))
    for size, more, n in sizes:
        step = ((size * (2 * content + 1) + more) * (records + 1) + 1) * count
        for a in range(0, n, PIECE):
            yield size, more, a, np.array([heapq.heapreplace(heap, heap[0] + step) % count for _ in range(a, min(a + PIECE, n))])


def _counts(records: int, total: int, content: int, most: int, envelope: int) -> range:
    """The numbers of shards to try: with fewer, one shard at least has too much, whichever has what."""
    up = lambda a, b: -(-a // b)
    # bytes and commas of all shards, beside what surrounds them
    room, used = most - envelope + 1, total + records
    least = up(used, room) if room > 0 else records + 1 if used > 0 else 1
    return range(max(1, up(total, most), up(content, most), up(records, SHARD_RECORDS), least), records + 1)


def fewest_counted(sizes: Iterable[Size], most: int, envelope: int) -> Iterator[Piece | str]:
    """What ``fewest`` gives, from the distinct sizes, the largest first; nothing if one is over ``most``, an error if no number will do."""
    held = [array("q"), array("q"), array("q")]
    for row in sizes:
        for column, x in zip(held, row, strict=True):
            column.append(x)
        if row[0] > most:
            return
    records, total, content, signed = sum(held[2]), *(sum(f(x) * n for x, n in zip(held[k], held[2], strict=True)) for k, f in ((0, int), (1, abs), (1, int)))
    for count in _counts(records, total, signed, most, envelope):
        used = np.full(count, envelope - 1)
        for size, _, _, shard in balanced_counted(zip(*held, strict=True), count, content, records):
            np.add.at(used, shard, size + 1)
        if used.max() <= most:
            yield from balanced_counted(zip(*held, strict=True), count, content, records)
            return
    yield "envelope_too_large"


def fewest(records: list[Record], most: int, envelope: int) -> list[int] | None:
    """Balanced shards of the least number at which each, with its envelope and commas, has ``most`` bytes or fewer; None if no number will do."""
    order = _largest_first(records)
    for count in _counts(len(records), sum(r[1] for r in records), sum(r[2] for r in records), most, envelope):
        shard = balanced(records, count, order=order)
        sizes = [envelope - 1] * count
        for r, k in zip(records, shard, strict=True):
            sizes[k] += r[1] + 1
        if max(sizes) <= most:
            return shard
    return None


class Bins:
    """Open bins in a tournament tree of their free bytes, so that the first that fits is found without trying all."""

    def __init__(self, most_bytes: int, most_records: int, records: int):
        self.most, self.limit = most_bytes, most_records
        self.width = 1 << max(records - 1, 0).bit_length()
        self.free, self.held, self.n = [-1] * (2 * self.width), [0] * records, 0

    def _set(self, k: int, free: int) -> None:
        at = k + self.width
        self.free[at] = free
        while at > 1:
            at //= 2
            self.free[at] = max(self.free[2 * at], self.free[2 * at + 1])

    def place(self, size: int) -> int:
        """The first bin with room, else a new one; a record larger than a bin has one for itself."""
        at = 1
        if self.free[1] < size:
            k, free = self.n, self.most
            self.n += 1
        else:
            while at < self.width:
                at = 2 * at if self.free[2 * at] >= size else 2 * at + 1
            k, free = at - self.width, self.free[at]
        self.held[k] += 1
        self._set(k, free - size if self.held[k] < self.limit else -1)
        return k


def first_fit(records: list[Record], most_bytes: int, most_records: int) -> list[int]:
    """The bin of each record, the largest first (then by id), each to the first bin with room for its bytes."""
    bins, at = Bins(most_bytes, most_records, len(records)), [0] * len(records)
    for i in sorted(range(len(records)), key=lambda i: (-records[i][1], records[i][0])):
        at[i] = bins.place(records[i][1])
    return at


def first_fit_counted(sizes: Iterable[Size], most_bytes: int, most_records: int) -> Iterator[Piece]:
    """What ``first_fit`` gives, from the distinct sizes alone, the largest first.

    Neighbouring bins that hold the same are one run, and a size splits only the last run that it reaches: runs
    grow with the sizes, not with the bins. Those with room for the present size lie by number, the others by
    free bytes, until a size is small enough.
    """
    room: list[tuple[int, int, int, int]] = []
    waiting: list[tuple[int, int, int, int]] = []
    made = 0
    for size, content, n in sizes:
        while waiting and -waiting[0][0] >= size:
            free, first, bins, held = heapq.heappop(waiting)
            heapq.heappush(room, (first, bins, -free, held))
        rank = 0
        while rank < n:
            first, bins, free, held = heapq.heappop(room) if room else (made, 0, most_bytes, 0)
            each = most_records - held if size <= 0 else min(free // size, most_records - held)
            if not bins:
                # new bins; a record larger than a bin has one for itself
                each = max(each, 1)
                bins = -(-(n - rank) // each)
                made += bins
            taken = min(n - rank, bins * each)
            for a in range(0, taken, PIECE):
                yield size, content, rank + a, first + np.arange(a, min(a + PIECE, taken)) // each
            rank += taken
            full, part = divmod(taken, each)
            rest = full + (part > 0)
            for at, count, left, has in ((first, full, free - each * size, held + each), (first + full, rest - full, free - part * size, held + part), (first + rest, bins - rest, free, held)):
                if count and has < most_records:
                    heapq.heappush(*((room, (at, count, left, has)) if left >= size else (waiting, (-left, at, count, has))))


PLACED = "id string, shard int, place int, error string"


TURNS = "group string, bytes long, content_bytes long, rank int, shard int, error string"
#: Places the sizes of a group, given the sum of its bytes, of its absolute content bytes, and its records.
Counted = Callable[[Iterator[Size], int, int, int], Iterator[Piece | str]]


def _turns(sizes: DataFrame, how: Counted) -> DataFrame:
    """The shard of the record of each rank among those of one size, from the sizes and their counts; one row for a group with an error."""
    made = pa.schema(list(zip(("group", "bytes", "content_bytes", "rank", "shard", "error"), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)))

    def batch(name: str, pieces: list[Piece]) -> pa.RecordBatch:
        counts = [len(p[3]) for p in pieces]
        columns = [np.repeat(np.array([p[k] for p in pieces], np.int64), counts) for k in (0, 1)]
        ranks, shard = (np.concatenate(x) for x in ([p[2] + np.arange(n) for p, n in zip(pieces, counts, strict=True)], [p[3] for p in pieces]))
        return pa.RecordBatch.from_arrays([pa.repeat(name, sum(counts)), *map(pa.array, columns), pa.array(ranks, pa.int32()), pa.array(shard, pa.int32()), pa.nulls(sum(counts), pa.string())], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (name, *sums), own in groupby(rows, itemgetter(0, 4, 5, 6)):
            held, n = [], 0
            for piece in how((row[1:4] for row in own), *sums):
                if isinstance(piece, str):
                    yield pa.RecordBatch.from_pylist([{"group": name, "error": piece}], schema=made)
                    continue
                held.append(piece)
                n += len(piece[3])
                if n >= PIECE:
                    yield batch(name, held)
                    held, n = [], 0
            if held:
                yield batch(name, held)

    of = lambda c: F.sum(c).over(Window.partitionBy("group"))
    summed = sizes.repartition("group").select("group", "bytes", "content_bytes", "n", of(F.col("bytes") * F.col("n")), of(F.abs("content_bytes") * F.col("n")), of(F.col("n")))
    return in_batches(summed.sortWithinPartitions("group", F.desc("bytes"), F.desc("content_bytes"))).mapInArrow(run, TURNS)


def _counted(records: DataFrame, how: Counted) -> DataFrame:
    """Groups of any number of records: their sizes are placed, then the records told by size and rank."""
    size = ("group", "bytes", "content_bytes")
    turns = _turns(records.groupBy(*size).agg(F.count("*").alias("n")), how)
    ranked = records.withColumn("rank", F.row_number().over(Window.partitionBy(*size).orderBy("id")) - 1)
    place = F.row_number().over(Window.partitionBy("group", "shard").orderBy("id")) - 1
    # an error has no record
    return turns.join(ranked, [*size, "rank"], "left").select("group", "id", "shard", F.when(F.col("shard").isNotNull(), place).alias("place"), "error")


def _placed(records: DataFrame, group: str, how: Callable[[list[Record]], list[int] | str], counted: Counted, second: bool = True) -> DataFrame:
    """(group, id, shard, place, error): place counts within a shard by id; a group that can't be placed gives one row with its error, or one per faulty record.

    ``counted`` does what ``how`` does, from sizes and their counts; content bytes are 0 there, unless ``second``.
    """

    def run(name: str, rows: list[tuple]) -> Iterator[tuple]:
        # rows come by id
        found = how([(i.encode(), b, c) for _, i, b, c in rows])
        if isinstance(found, str):
            yield name, None, None, None, found
            return
        seen: dict[int, int] = {}
        for (_, i, _, _), k in zip(rows, found, strict=True):
            seen[k] = place = seen.get(k, -1) + 1
            yield name, i, k, place, None

    sized = records.filter(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("group"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("bytes"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.col("content_bytes"), F.lit(0)).cast("long").alias("content_bytes"))
    beyond = lambda n: F.broadcast(sized.groupBy("group").count().filter(F.col("count") > n).select("group"))
    refused = None
    if MOST is not None:
        refused = beyond(MOST)
        sized = sized.join(refused, "group", "left_anti")
    # one row a large group, of which there are at most all rows / HELD
    large = beyond(HELD)
    rest = sized.join(large, "group", "left_semi")
    found = folded(sized.join(large, "group", "left_anti"), "group", run, f"group string, {PLACED}", order=("id",))
    found = found.unionByName(_counted(rest if second else rest.withColumn("content_bytes", F.lit(0).cast("long")), counted))
    if refused is None:
        return found
    return found.unionByName(refused.select("group", F.lit("too_many_records").alias("error")), allowMissingColumns=True)


def semantic_shards(records: DataFrame, group: str, most: int, envelope: int) -> DataFrame:
    """Shards of the records (group, id, bytes, content_bytes) of each group: as few as keep each shard within ``most`` bytes, balanced.

    Returns group, id, shard, place, error. A record of more than ``most`` bytes is a row of its own with
    error record_too_large, and its group has no shards; a group that no number of shards fits has one row
    with error envelope_too_large. Null ids are empty, null sizes 0, rows without group are left out.
    """

    def how(rows: list[Record]) -> list[int] | str:
        return "record_too_large" if any(r[1] > most for r in rows) else fewest(rows, most, envelope) or "envelope_too_large"

    found = _placed(records, group, how, lambda sizes, *_: fewest_counted(sizes, most, envelope))
    over = records.filter((F.col("bytes") > most) & F.col(group).isNotNull()).select(F.col(group).cast("string").alias("group"), F.col("id").cast("string").alias("id"), F.lit("record_too_large").alias("error"))
    return found.filter(F.coalesce(F.col("error") != "record_too_large", F.lit(True))).unionByName(over, allowMissingColumns=True)


def balanced_groups(records: DataFrame, group: str, identities: int, target_bytes: int) -> DataFrame:
    """Groups cut to parts of about ``target_bytes`` and at most about ``identities`` records, balanced by bytes, then by records."""
    up = lambda a, b: -(-a // b)
    parts = lambda n, total: min(n, max(1, up(n, identities), up(total, target_bytes)))

    def how(rows: list[Record]) -> list[int]:
        return balanced(rows, parts(len(rows), sum(r[1] for r in rows)), second=False)

    return _placed(records, group, how, lambda sizes, total, content, n: balanced_counted(sizes, parts(n, total), content, n), second=False)


def bins(records: DataFrame, group: str, most_bytes: int = BIN_BYTES, most_records: int = BIN_TARGETS) -> DataFrame:
    """Bins of each group's records by first fit, the largest first; a record larger than a bin has one for itself."""
    return _placed(records, group, lambda rows: first_fit(rows, most_bytes, most_records), lambda sizes, *_: first_fit_counted(sizes, most_bytes, most_records), second=False)
