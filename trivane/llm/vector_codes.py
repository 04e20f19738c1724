"""Product codes of vectors: k-means in each part of the vectors by Lloyd's rounds with Hamerly's bounds.

Each row keeps, for each part, its entry, an upper bound on the distance to it and one lower bound on the distance to the
second nearest. When entries move, the upper bound grows by its entry's move and the lower bound falls by the
largest move of another entry. A part whose upper bound is strictly less than its lower bound, or than half the distance from its entry to
the nearest other entry, has one nearest entry and keeps it; all others are compared with every entry in whole numbers, where
the lower index wins ties. Bounds carry more slack than their roundings can be.

Codebooks hold at most 256 entries a part and are all that passes through the driver; rows and bounds stay in tables of the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivane.llm.common import discard, materialise
from trivane.operators.steps import join_same

#: What the roundings of distances and bounds are less than, as a share.
SLACK = 1e-9


@dataclass(frozen=True)
class CodeParams:
    """parts: equal consecutive parts of a vector. entries: of a part's codebook, 256 at most. scale: a component x becomes floor(scale * x)."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


def limit(width: int) -> int:
    """Largest whole number as a component, so that a squared distance of ``width`` components fits 62 bits."""
    return int(((1 << 62) / max(width, 1)) ** 0.5 / 2)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (whole numbers) of the rows of x to those of c."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 1 << 53:  # every sum is exact in doubles then
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, entry in enumerate(c):
        gap = x - entry
        out[:, j] = (gap * gap).sum(1)
    return out


def _own(x: np.ndarray, c: np.ndarray, code: np.ndarray) -> np.ndarray:
    gap = x - c[code]
    return (gap * gap).sum(1)


@dataclass(frozen=True)
class Moves:
    """What a round's assignment needs of one part: entries, half the distance to the nearest other entry, how far each entry went, and the two farthest moves."""

    entries: np.ndarray
    half: np.ndarray
    moved: np.ndarray
    most: float
    by: int
    second: float

    @staticmethod
    def of(entries: np.ndarray, before: np.ndarray | None) -> Moves:
        n = len(entries)
        d = _squared(entries, entries).astype(float)
        np.fill_diagonal(d, np.inf)
        half = np.sqrt(d.min(1, initial=np.inf)) / 2 * (1 - SLACK) if n else np.zeros(0)
        moved = np.sqrt(_own(entries, before, np.arange(n)).astype(float)) * (1 + SLACK) if before is not None else np.zeros(n)
        rank = np.argsort(-moved, kind="stable")
        return Moves(entries, half, moved, float(moved[rank[0]]) if n else 0.0, int(rank[0]) if n else 0, float(moved[rank[1]]) if n > 1 else 0.0)


def assign(x: np.ndarray, moves: Moves, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, upper, lower, rows compared with every entry) of the rows of one part after the entries have moved. Without a code, all rows are compared."""
    if code is None:
        todo = np.arange(len(x))
        code, upper, lower = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x))
    else:
        code, upper = code.astype(np.int64), upper + moves.moved[code]
        lower = lower - np.where(code == moves.by, moves.second, moves.most)
        safe = np.maximum(lower, moves.half[code])
        near = np.flatnonzero(~(upper < safe))
        exact = np.sqrt(_own(x[near], moves.entries, code[near]).astype(float)) * (1 + SLACK)
        upper[near] = exact
        todo = near[~(exact < safe[near])]
    for lo in range(0, len(todo), 2048):
        at = todo[lo : lo + 2048]
        d = _squared(x[at], moves.entries)
        best = d.argmin(1)
        rows = np.arange(len(at))
        code[at], upper[at] = best, np.sqrt(d[rows, best].astype(float)) * (1 + SLACK)
        if d.shape[1] > 1:
            d[rows, best] = np.iinfo(np.int64).max
            lower[at] = np.sqrt(d.min(1).astype(float)) * (1 - SLACK)
        else:
            lower[at] = np.inf
    return code, upper, lower, len(todo)


def _bytes(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _by_part(x: np.ndarray, parts: int, width: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(x[:, p * width : (p + 1) * width]) for p in range(parts)]


def _assigned(state: DataFrame, moves: list[Moves], width: int, first: bool) -> DataFrame:
    """``state`` with its codes and bounds after the entries have moved."""
    parts = len(moves)
    shared = state.sparkSession.sparkContext.broadcast(moves)  # parts * entries * (width + 2) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            xs = _by_part(_rows(batch.column(2), parts * width), parts, width)
            code = None if first else _bytes(batch.column(3), np.uint8, parts)
            bound = None if first else _bytes(batch.column(4), np.float64, 2 * parts)
            codes, bounds = np.empty((batch.num_rows, parts), np.uint8), np.empty((batch.num_rows, 2 * parts))
            for p, m in enumerate(shared.value):
                codes[:, p], bounds[:, p], bounds[:, parts + p], _ = assign(xs[p], m, *((None,) * 3 if first else (code[:, p], bound[:, p].copy(), bound[:, parts + p])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([r.tobytes() for r in bounds], pa.binary())], names=["vec_id", "label", "x", "codes", "bounds"])

    schema = T.StructType([*state.schema.fields[:3], T.StructField("codes", T.BinaryType()), T.StructField("bounds", T.BinaryType())])
    return state.mapInArrow(run, schema)


def _sums(state: DataFrame, parts: int, entries: int, width: int) -> dict[int, int]:
    """Sum of each component, and the count, of each entry's parts, by slot: (part * entries + entry) * (width + 1) + component. A task sums first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                code = _bytes(batch.column(1), np.uint8, parts)
                for p, x in enumerate(_by_part(_rows(batch.column(0), parts * width), parts, width)):
                    total[p, :, width] += np.bincount(code[:, p], minlength=entries)
                    for j in range(width):  # exact: less than 2^31 times the rows of a batch
                        total[p, :, j] += np.bincount(code[:, p], x[:, j], entries).astype(np.int64)
        used = np.flatnonzero((total[:, :, width:] > 0).repeat(width + 1, 2).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total.ravel()[used], pa.int64())], names=["slot", "n"])

    found = state.select("x", "codes").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    return {r["slot"]: int(r["n"]) for r in found.collect()}  # parts * entries * (width + 1) rows at most


def _moved(books: list[np.ndarray], sums: dict[int, int], entries: int, width: int) -> list[np.ndarray]:
    out = []
    for p, book in enumerate(books):
        new = book.copy()
        for e in range(len(book)):
            slot = (p * entries + e) * (width + 1)
            if n := sums.get(slot + width, 0):
                new[e] = [sums[slot + j] // n for j in range(width)]
        out.append(new)
    return out


def product_codes(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", params: CodeParams = CodeParams()) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows: id_col, label, code string, error long; codebooks by part) of the rows whose vector has finite components only.

    A codebook begins with the parts of the ``entries`` smallest ids (an id with several vectors gives the least one in whole numbers; null ids give none), so there may be fewer
    entries. Each round assigns every part to the nearest entry (ties: the lower index) and moves each entry to the componentwise
    floor(sum / count) of its parts; at the end parts are assigned once more. code has two hex digits a part, error is the sum of the
    last squared distances. Repeated rows are rows; other columns are not read; null labels stay null. Components beyond +-limit(width) are held to it. Rows whose
    vector is as long as that of the smallest id, and divisible by the parts, take part; others have a null code and error. An empty table gives no rows.
    """
    kept = df.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    kept = kept.where(~F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    far = float(1 << 60)
    kept = kept.withColumn("v", F.transform("v", lambda v: F.floor(F.greatest(F.least(v * params.scale, F.lit(far)), F.lit(-far))).cast("double")))
    ids = kept.select("vec_id").where("vec_id is not null").distinct().orderBy("vec_id").limit(params.entries)
    seeds = kept.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()  # params.entries rows at most
    long = len(seeds[0]["v"]) if seeds else 0
    width, most = long // params.parts, limit(long // params.parts)
    fits = (F.size("v") == long) & F.lit(long % params.parts == 0 and bool(seeds))
    state = kept.where(fits).select("vec_id", "label", F.transform("v", lambda v: F.greatest(F.least(v, F.lit(float(most))), F.lit(float(-most))).cast("int")).alias("x"))
    odd = kept.where(~fits).select(F.col("vec_id").alias(id_col), F.col("label").alias(label), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    start = np.array([np.clip(np.array(r["v"]), -most, most) for r in seeds if len(r["v"]) == long], np.int64).reshape(-1, long) if seeds and long % params.parts == 0 else np.zeros((0, 0), np.int64)
    if not len(start):
        return odd, []
    books, before, previous = _by_part(start, params.parts, width), None, None
    for r in range(params.rounds):
        moves = [Moves.of(b, None if before is None else before[p]) for p, b in enumerate(books)]
        state = materialise(_assigned(state, moves, width, r == 0), "codes")
        if previous is not None:
            discard(previous)
        previous = state
        before, books = books, _moved(books, _sums(state, params.parts, params.entries, width), params.entries, width)
    moves = [Moves.of(b, None if before is None else before[p]) for p, b in enumerate(books)]
    shared = df.sparkSession.sparkContext.broadcast(books)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = _bytes(batch.column(3), np.uint8, params.parts)
                error = sum(_own(x, shared.value[p], code[:, p]) for p, x in enumerate(_by_part(_rows(batch.column(2), long), params.parts, width)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code]), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    last = _assigned(state, moves, width, params.rounds == 0)
    schema = T.StructType([*last.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    out = last.mapInArrow(finish, schema).select(F.col("vec_id").alias(id_col), F.col("label").alias(label), "code", "error")
    return out.unionByName(odd), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def with_label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """``codes`` with label_error long: error summed over the rows of the same label, nulls together. ``codes`` is read twice: write it first."""
    return join_same(codes, codes.groupBy(label).agg(F.sum("error").alias("label_error")), [label])
