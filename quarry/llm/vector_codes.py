"""Vectors as short codes: one codebook per part of the vector, trained on all vectors.

Components are integers, floor(SCALE * x), so that sums, distances and ties are exact and do not
depend on the order of rows. In each round every codebook is broadcast as a kd-tree; tasks find
the nearest entries of their rows by branch and bound and add up the parts of each entry; the
sums of all tasks meet in Spark, and the driver sees one row per entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_batches, written
from quarry.llm.ranges import with_totals

SCALE = 1024
#: Components of at most this size have squared distances within 64 bits, for parts of up to 4096 components; larger ones are Python's integers.
NARROW = 1 << 24
#: A sum travels as digits to this base, the last one signed: one digit for narrow components, else enough for any double.
BASE, DIGITS = 1 << 62, 20
#: Entries in a leaf of a tree.
LEAF = 12


@dataclass
class Tree:
    """Entries within a box; an inner node has two trees. ``index`` ascends in a leaf."""

    low: np.ndarray
    high: np.ndarray
    index: np.ndarray | None = None
    entries: np.ndarray | None = None
    sides: tuple[Tree, Tree] | None = None

    def bound(self, parts: np.ndarray) -> np.ndarray:
        """No entry of the box is nearer."""
        out = np.maximum(np.maximum(self.low - parts, parts - self.high), 0)
        return (out * out).sum(axis=1)


def grown(entries: np.ndarray, index: np.ndarray) -> Tree:
    low, high = entries.min(axis=0), entries.max(axis=0)
    width = high - low
    if len(index) <= LEAF or not width.any():
        return Tree(low, high, index, entries)
    axis = int(width.argmax())
    order = np.argsort(entries[:, axis], kind="stable")
    half = len(order) // 2
    left, right = np.sort(order[:half]), np.sort(order[half:])
    return Tree(low, high, sides=(grown(entries[left], index[left]), grown(entries[right], index[right])))


def _search(tree: Tree, parts: np.ndarray, rows: np.ndarray, bound: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
    """Improve (best, at) of ``rows``. A box whose bound equals the best is opened: it may hold a lower index."""
    open_ = bound <= best[rows]
    rows, bound = rows[open_], bound[open_]
    if not len(rows):
        return
    if tree.sides is None:
        gap = parts[rows][:, None, :] - tree.entries[None, :, :]
        far = (gap * gap).sum(axis=2)
        # the first of equal ones, and indexes ascend
        mine = far.argmin(axis=1)
        far, index = far[np.arange(len(rows)), mine], tree.index[mine]
        better = (far < best[rows]) | ((far == best[rows]) & (index < at[rows]))
        best[rows[better]], at[rows[better]] = far[better], index[better]
        return
    bounds = [side.bound(parts[rows]) for side in tree.sides]
    first = bounds[0] <= bounds[1]
    for which, near in ((first, 0), (~first, 1)):
        for k in (near, 1 - near):
            _search(tree.sides[k], parts, rows[which], bounds[k][which], best, at)


def nearest(tree: Tree | None, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part's nearest entry; of equally near ones the lowest index."""
    n = len(parts)
    if tree is None or not parts.shape[1]:
        return np.zeros(n, dtype=int), np.zeros(n, dtype=parts.dtype)
    at, best = np.full(n, np.iinfo(int).max), np.full(n, np.iinfo(np.int64).max, dtype=parts.dtype)
    if parts.dtype == object:
        best[:] = math.inf
    _search(tree, parts, np.arange(n), tree.bound(parts), best, at)
    return at, best


def _whole(flat: np.ndarray, wide: bool) -> np.ndarray:
    """floor(SCALE * x) of each component, exactly."""
    if wide:
        return np.array([math.floor(Fraction(float(x)) * SCALE) for x in flat], dtype=object)
    return np.floor(flat.astype(np.float64) * SCALE).astype(np.int64)


def _cut(matrix: np.ndarray, n_parts: int) -> list[np.ndarray]:
    return np.array_split(matrix, n_parts, axis=1)


def _matrix(column: pa.Array, size: int, wide: bool) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return _whole(flat, wide).reshape(len(column), size)


def usable(vector: Column) -> Column:
    """A vector without null, infinite or undefined components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    return vector.isNotNull() & F.forall(vector, finite)


def _digits(total: int, n: int) -> list[int]:
    found = []
    for _ in range(n - 1):
        total, digit = divmod(total, BASE)
        found.append(digit)
    return [*found, total]


def _sums(trees, size: int, n_parts: int, wide: bool) -> Callable:
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for k, part in enumerate(_cut(_matrix(batch.column(0), size, wide), n_parts)):
                at, _ = nearest(trees.value[k], part)
                order = np.argsort(at, kind="stable")
                used, starts = np.unique(at[order], return_index=True)
                counts = np.diff([*starts, len(order)])
                added = np.add.reduceat(part[order], starts, axis=0) if part.shape[1] else np.zeros((len(used), 0), dtype=part.dtype)
                for e, n, s in zip(used.tolist(), counts.tolist(), added, strict=True):
                    had = total.get((k, e))
                    total[k, e] = [n, s] if had is None else [had[0] + n, had[1] + s]
        if total:
            keys = list(total)
            sums = [[d for x in total[k][1].tolist() for d in _digits(x, DIGITS if wide else 1)] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()), pa.array(sums, schema.field("sums").type)], schema=schema)

    return run


def _codes(trees, size: int, n_parts: int, wide: bool) -> Callable:
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, error = [""] * batch.num_rows, np.zeros(batch.num_rows, dtype=object)
            for k, part in enumerate(_cut(_matrix(batch.column(0), size, wide), n_parts)):
                at, far = nearest(trees.value[k], part)
                code = [c + f"{e:02x}" for c, e in zip(code, at.tolist(), strict=True)]
                error = error + far
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(code), pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], schema=schema)

    return run


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", n_parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """Train codebooks on all vectors and code them: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are left out, and so are those
    of another length than most of the lowest ids' vectors have. Parts are equal; where the length
    is not a multiple of ``n_parts`` the first parts have one component more. Codebooks start with
    the vectors of the ``entries`` lowest distinct ids (of rows that share an id the smallest
    vector; the null id is the highest); fewer vectors make smaller codebooks. Repeated rows count
    each time. label_error adds up the errors of equal labels, null labels together. An error or a sum
    beyond 64 bits is null. An empty table gives no rows. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vector_col).alias("vector"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label")).filter(usable(F.col("vector")))
    # of one id the smallest vector, then the lowest ids: as many rows as a codebook has
    lowest = kept.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    lengths = [len(r["vector"]) for r in lowest]
    size = max(set(lengths), key=lambda n: (lengths.count(n), -n), default=0)
    kept = kept.filter(F.size("vector") == size)
    if len(set(lengths)) > 1:
        lowest = kept.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    largest = kept.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0
    wide = largest * SCALE >= NARROW or size > 4096 * n_parts
    books = [[[int(x) for x in row] for row in part] for part in _cut(_whole(np.array([x for r in lowest for x in r["vector"]]), wide).reshape(len(lowest), size), n_parts)]

    def broadcast():
        trees = [grown(np.array(b, dtype=object if wide else np.int64).reshape(len(b), -1), np.arange(len(b))) if b and b[0] else None for b in books]
        return spark.sparkContext.broadcast(trees)

    read, digits = in_batches(kept), DIGITS if wide else 1
    for _ in range(rounds):
        trees = broadcast()
        partial = read.select("vector").mapInArrow(_sums(trees, size, n_parts, wide), "part int, entry int, n bigint, sums array<bigint>")
        added = partial.select("part", "entry", "n", F.posexplode_outer("sums").alias("j", "s")).groupBy("part", "entry", "j").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        totals: dict[tuple[int, int, int], list[int]] = {}
        for r in added.filter("j is not null").collect():
            total = totals.setdefault((r["part"], r["entry"], r["j"] // digits), [0, int(r["n"])])
            total[0] += int(r["s"]) * BASE ** (r["j"] % digits)
        for (part, entry, j), (total, n) in totals.items():
            books[part][entry][j] = total // n
        trees.unpersist()
    trees = broadcast()
    coded = written(read.mapInArrow(_codes(trees, size, n_parts, wide), "vec_id long, label string, code string, error long"), "vector-codes")
    trees.unpersist()
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long")
    of_label = written(coded.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n_label")), "label-errors")
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return with_totals(coded, of_label, "label", "n_label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
