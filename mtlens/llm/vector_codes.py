"""Vector code compression: product codes by Lloyd rounds, with norm-of-sum bounds that spare exact scans.

A vector is cut into parts; each part position has a codebook. The codebooks of all rounds are kept. Per vector, part
and group of entries, the state holds a lower bound of the distance to the group's entries (but the assigned
one) and the round in which it was measured. In a later round the bound falls by how far the entries of the group
have moved between the two codebooks: the norm of the sum of their moves, not the sum of the norms
of the moves, so that an entry that comes back costs nothing. Only groups whose bound does not exceed the exact
distance to the assigned entry are scanned again, exactly and in integers.

A round is one pass over the table: each task assigns its vectors, writes them with their new state to
the shared folder and adds one row per entry with the sum and number of the parts it assigned. Only these sums are shuffled,
and one row per entry reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free, materialize, small

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
GROUPS = 8  # of entries that share a bound
ROWS = 4096  # vectors per numpy step
EXACT = 2.0**53  # sums of integers below it are exact as doubles
SLACK = 1e-6  # relative; covers the rounding of bounds to 32 bits


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    inf = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))


def cuts(width: int) -> list[int]:
    """Bounds of the parts of a vector: equal ones if the width allows it."""
    return [width * k // PARTS for k in range(PARTS + 1)]


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component, as doubles (scaling by a power of two is exact)."""
    return np.floor(vectors.astype(np.float64) * SCALE)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all entries, exact: doubles while they are, Python integers beyond."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * most * most * max(1, x.shape[1]) < EXACT:
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    exact = np.vectorize(int, otypes=[object])
    big, entries = exact(x), exact(c)
    return np.stack([((big - e) ** 2).sum(1) for e in entries], 1)


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Codebooks:
    """The codebooks of one part position in all rounds so far, and how far their groups have moved in between."""

    def __init__(self, history: list[np.ndarray]):
        self.history = history
        start = history[0]
        axis = np.linalg.svd(start - start.mean(0), full_matrices=False)[2][0] if start.size else np.zeros(start.shape[1])
        rank = np.argsort(np.argsort(start @ axis, kind="stable"), kind="stable")
        self.group = rank * GROUPS // max(1, len(start))
        self.members = [np.flatnonzero(self.group == g) for g in range(GROUPS)]
        now = history[-1]
        moved = [_roots(((now - before) ** 2).sum(1)) for before in history]
        #: [round of the bound, group]: the net move of the group's entry that moved most since then
        self.moves = np.array([[m[members].max(initial=0) for members in self.members] for m in moved])

    def assign(self, x: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(code, bounds, stamps, squared distance, scanned groups) of the rows of ``x`` in the latest round.

        Ties go to the lower index: a group that could hold an entry as near as the assigned one is scanned.
        """
        now, stamp = self.history[-1], len(self.history) - 1
        n = len(x)
        if state is None:
            code = np.zeros(n, np.int64)
            low, stamps = np.zeros((n, GROUPS), np.float32), np.full((n, GROUPS), stamp, np.uint8)
        else:
            code, low, stamps = state[0].astype(np.int64), state[1].copy(), state[2].copy()
        own = self._to_assigned(x, now, code)
        present = low * (1 - SLACK) - self.moves[stamps, np.arange(GROUPS)] * (1 + SLACK)
        todo = present <= (_roots(own) * (1 + SLACK))[:, None]
        best, winner = own.copy(), code.copy()
        scans = []
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(todo[:, g])
            if not len(rows) or not len(members):
                continue
            d = _distances(x[rows], now[members])
            first = d.argmin(1)
            least = np.take_along_axis(d, first[:, None], 1)[:, 0]
            scans.append((g, rows, d, members))
            if d.dtype == object:
                best = best.astype(object)
            index = members[first]
            wins = (least < best[rows]) | ((least == best[rows]) & (index < winner[rows]))
            best[rows[wins]], winner[rows[wins]] = least[wins], index[wins]
        left = np.flatnonzero((winner != code) & ~todo[np.arange(n), self.group[code]]) if n else np.empty(0, int)
        old = self.group[code[left]]  # the entry left behind joins the others of its group, which was not scanned
        low[left, old] = np.maximum(0, np.minimum(present[left, old], _roots(own[left])) * (1 - SLACK))
        stamps[left, old] = stamp
        for g, rows, d, members in scans:
            mine = np.searchsorted(members, winner[rows])
            here = self.group[winner[rows]] == g
            others = d.astype(np.float64)
            others[np.flatnonzero(here), mine[here]] = np.inf
            low[rows, g] = np.minimum(_roots(others.min(1)) * (1 - SLACK), np.finfo(np.float32).max)
            stamps[rows, g] = stamp
        return winner, low, stamps, best, sum(len(rows) for _, rows, _, _ in scans)

    @staticmethod
    def _to_assigned(x: np.ndarray, now: np.ndarray, code: np.ndarray) -> np.ndarray:
        gap = x - now[code]
        if gap.size and np.abs(gap).max() ** 2 * gap.shape[1] >= EXACT:
            return np.array([sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for v, c in zip(x, now[code], strict=True)], dtype=object)
        return (gap * gap).sum(1)


def _state_schema(vectors: DataFrame) -> str:
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return (
        f"vec_id {types['vec_id']}, label {types['label']}, embedding {types['embedding']}, codes binary, bounds binary, stamps binary, "
        "part int, entry int, n long, sums array<decimal(38,0)>"
    )


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, which of them have ``width`` components, the integers of those)."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows = batch.slice(start, ROWS)
            lists = rows.column("embedding")
            fits = pc.equal(pc.list_value_length(lists), width).to_numpy(zero_copy_only=False).astype(bool)
            flat = pc.list_flatten(lists.filter(pa.array(fits))).to_numpy(zero_copy_only=False)
            yield rows, fits, integers(flat.reshape(int(fits.sum()), width))


def _read_state(rows: pa.RecordBatch, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def flat(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(name).filter(pa.array(fits)).to_pylist()), kind)

    return flat("codes", np.uint8).reshape(-1, PARTS), flat("bounds", np.float32).reshape(-1, PARTS, GROUPS), flat("stamps", np.uint8).reshape(-1, PARTS, GROUPS)


def _packed(values: np.ndarray, fits: np.ndarray) -> pa.Array:
    cells = iter([v.tobytes() for v in values])
    return pa.array([next(cells) if fit else None for fit in fits], pa.binary())


def _assigned(books: list[Codebooks], x: np.ndarray, old: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    at = cuts(x.shape[1])
    codes = np.empty((len(x), PARTS), np.uint8)
    bounds, stamps = np.empty((len(x), PARTS, GROUPS), np.float32), np.empty((len(x), PARTS, GROUPS), np.uint8)
    error = np.zeros(len(x), object)
    scanned = 0
    for k, book in enumerate(books):
        state = None if old is None else (old[0][:, k], old[1][:, k], old[2][:, k])
        codes[:, k], bounds[:, k], stamps[:, k], d, groups = book.assign(x[:, at[k] : at[k + 1]], state)
        error = error + d
        scanned += groups
    return codes, bounds, stamps, error, scanned


def _round(rows: DataFrame, history: list[list[np.ndarray]], width: int, schema: str) -> DataFrame:
    """The rows with their new state, and per task and entry the sum of its parts (rows with an ``entry``)."""
    first = len(history) == 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebooks([books[k] for books in history]) for k in range(PARTS)]
        at = cuts(width)
        # Python integers hold sums of any size; a block's own sums are exact doubles or integers
        sums = [np.zeros((len(b.history[0]), at[k + 1] - at[k]), object) for k, b in enumerate(books)]
        counts = np.zeros((PARTS, len(books[0].history[0])), np.int64)
        names = None
        for block, fits, x in _blocks(batches, width):
            codes, bounds, stamps, _, _ = _assigned(books, x, None if first else _read_state(block, fits))
            for k in range(PARTS):
                part, code = x[:, at[k] : at[k + 1]], codes[:, k]
                counts[k] += np.bincount(code, minlength=counts.shape[1])
                if np.abs(part).max(initial=0) * max(1, len(x)) < EXACT:
                    for j in range(part.shape[1]):
                        sums[k][:, j] += np.bincount(code, weights=part[:, j], minlength=counts.shape[1]).astype(np.int64)
                else:
                    np.add.at(sums[k], code, np.vectorize(int, otypes=[object])(part))
            n = block.num_rows
            empty = pa.nulls(n, pa.int32())
            columns = [*(block.column(c) for c in ("vec_id", "label", "embedding")), _packed(codes, fits), _packed(bounds, fits), _packed(stamps, fits),
                       empty, empty, pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.decimal128(38, 0)))]
            names = [c.type for c in columns]
            yield pa.RecordBatch.from_arrays(columns, FIELDS)
        if names is None:
            return
        for k in range(PARTS):
            used = np.flatnonzero(counts[k])
            cells = [[Decimal(int(v)) for v in sums[k][e]] for e in used]
            columns = [pa.nulls(len(used), t) for t in names[:6]]
            columns += [pa.array([k] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[k][used], pa.int64()), pa.array(cells, names[9])]
            yield pa.RecordBatch.from_arrays(columns, FIELDS)

    return rows.mapInArrow(task, schema)


FIELDS = ["vec_id", "label", "embedding", "codes", "bounds", "stamps", "part", "entry", "n", "sums"]


def _moved(state: DataFrame, last: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The next codebooks: each entry the floor of the mean of its parts, in integers; unused entries stay."""
    at = cuts(width)
    most = max(at[k + 1] - at[k] for k in range(PARTS))
    totals = state.where(F.col("entry").isNotNull()).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(most))
    )
    books = [b.copy() for b in last]
    for row in totals.collect():  # PARTS * ENTRIES rows at most
        k = row["part"]
        books[k][row["entry"]] = [float(int(row[f"s{j}"]) // row["n"]) for j in range(at[k + 1] - at[k])]
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray]]:
    """(table of vec_id, label, code, error; the final codebooks by part position).

    ``vectors`` has vec_id, embedding and label. Rows whose vector is null or holds a component that is null or not
    finite are dropped. Components are taken as floor(1024 x), exact for any finite value below 2^1014; sums of them
    may have 38 digits, and an error beyond 64 bits is an error of the job. The vector of the smallest vec_id (nulls last, ties by the vector itself)
    gives the width; vectors of another width have a null code and error and are learnt from by nothing. A width that
    is no multiple of 4 is cut as evenly as it goes; an empty vector has the code 00000000 and error 0.
    Repeated ids are rows of their own, each may be an entry; fewer than 256 rows start as many entries. An empty table gives an
    empty one. Ties in distance go to the lower index. Columns beside the three are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    vectors = vectors.select("vec_id", "label", "embedding").where(finite(F.col("embedding")))
    out_types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    out_schema = f"vec_id {out_types['vec_id']}, label {out_types['label']}, code string, error long"
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    head = vectors.orderBy(*order).limit(entries).collect()
    if not head:
        return spark.createDataFrame([], out_schema), [np.empty((0, 0))] * PARTS
    width = len(head[0]["embedding"])
    if any(len(r["embedding"]) != width for r in head):
        head = vectors.where(F.size("embedding") == width).orderBy(*order).limit(entries).collect()
    start = integers(np.array([r["embedding"] for r in head]).reshape(len(head), width))
    at = cuts(width)
    history = [[start[:, at[k] : at[k + 1]] for k in range(PARTS)]]
    schema, rows, before = _state_schema(vectors), vectors, None
    for t in range(rounds):
        state = materialize(_round(rows, history, width, schema), f"round-{t}")
        history.append(_moved(state, history[-1], width))
        if before is not None:
            free(before)
        before, rows = state, state.where(F.col("entry").isNull())
    last = rounds > 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebooks([books[k] for books in history]) for k in range(PARTS)]
        for block, fits, x in _blocks(batches, width):
            codes, _, _, error, _ = _assigned(books, x, _read_state(block, fits) if last else None)
            cells, errors = iter([c.tobytes().hex() for c in codes]), iter([int(e) for e in error])
            yield pa.RecordBatch.from_arrays(
                [block.column("vec_id"), block.column("label"), pa.array([next(cells) if f else None for f in fits], pa.string()),
                 pa.array([next(errors) if f else None for f in fits], pa.int64())], ["vec_id", "label", "code", "error"])

    coded = materialize(rows.mapInArrow(task, out_schema), "codes")
    if before is not None:
        free(before)
    return coded, history[-1]


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of ``error`` over its label (nulls are one label)."""
    totals = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(small(totals), coded.label.eqNullSafe(F.col("__label")), "left").drop("__label")
