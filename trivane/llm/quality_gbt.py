"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts in numpy, chunk by chunk. The trees are grown
on a bounded sample of labelled rows, one histogram a feature and node, and
flattened into arrays that all rows of a chunk walk through together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivane.llm.wordhash import Words, mix, text_chunks

STATISTICS = [
    "bytes", "words", "lines", "word_length", "long_words", "upper", "digits", "symbols", "marks", "exclaims", "bars", "other_bytes", "stops_per_word",
    "same_as_previous", "distinct", "top_word", "distinct_pairs", "distinct_triples", "distinct_lines", "line_length",
]


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[list(chars.encode())] = 1
    return out


_UPPER, _DIGIT, _SYMBOL = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table("#*$%&<>@^~=+_{}[]\\/")
_MARK, _BANG, _BAR, _STOP = _table(".,;:!?'\"()-"), _table("!"), _table("|"), _table(".")
_HIGH = np.zeros(256, np.int8)
_HIGH[128:] = 1


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct values, count of the most frequent) by owner."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))))
    runs = np.diff(np.concatenate((new, [len(h)])))
    top = np.zeros(n)
    np.maximum.at(top, owner[new], runs)
    return np.bincount(owner[new], minlength=n).astype(float), top


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of STATISTICS for each text; a null or empty text has zeros."""
    n = len(texts)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    size = np.fromiter((len(x) for x in raw), np.int64, n)
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    w = Words(texts)
    owner = np.repeat(np.arange(n), w.counts)
    words, length = np.maximum(w.counts, 1), np.maximum(size, 1)
    per = lambda table: np.add.reduceat(table[data], start, dtype=np.int64) if n else np.zeros(0)
    by = lambda x: np.bincount(owner, x, n)
    span = (w.ends - w.starts).astype(float)
    again = np.concatenate(([False], (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1]))) if len(owner) else np.zeros(0, bool)
    distinct, top = _distinct(w.hashes, owner, n)
    out = [size, w.counts]
    ends = np.flatnonzero(data == 10)
    text = np.searchsorted(start, ends, "right") - 1
    lines = np.bincount(text, minlength=n)
    line_start = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    up = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)), out=up[1:])
    # Lines are told apart by their length and the sum of their hashed bytes.
    line_hash = mix(up[ends] - up[line_start] + (ends - line_start).astype(np.uint64))
    lines_distinct, _ = _distinct(line_hash, text, n)
    out += [lines, by(span) / words, by((span > 9).astype(float)) / words]
    out += [per(x) / length for x in (_UPPER, _DIGIT, _SYMBOL, _MARK, _BANG, _BAR, _HIGH)]
    out += [per(_STOP) / words, by(again.astype(float)) / words, distinct / words, top / words]
    for k in (2, 3):
        grams, first = w.grams(k)
        many = np.diff(first)
        out.append(_distinct(grams, np.repeat(np.arange(n), many), n)[0] / np.maximum(many, 1))
    out += [lines_distinct / np.maximum(lines, 1), size / np.maximum(lines, 1)]
    values = np.stack([np.asarray(x, float) for x in out], 1)
    values[size == 0] = 0
    return values


@dataclass(frozen=True)
class Params:
    """rows: labelled rows that training uses at most, those with the least hash of their id."""

    rows: int = 20_000
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    least: int = 10
    penalty: float = 1.0


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays: node i tests value <= threshold[i] of feature[i] (-1: a leaf), going to left[i] or left[i] + 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(inner, self.left[at] + right, at)
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, p: Params = Params()) -> Forest:
    """Grow the trees level by level on logistic loss. No rows give the score 0.5, one class its smoothed share."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if len(x) else np.zeros(x.shape, int)
    feature, threshold, left, value, roots = [], [], [], [], []
    score = np.full(len(x), base)
    grow = p.trees if len(x) >= 2 * p.least and 0 < y.sum() < len(y) else 0
    for _ in range(grow):
        prob = 1 / (1 + np.exp(-score))
        g, h = y - prob, prob * (1 - prob)
        roots.append(len(feature))
        level = [(len(feature), np.arange(len(x)))]
        feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
        for depth in range(p.depth + 1):
            below = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = p.rate * gs / (hs + p.penalty)
                best = (1e-6, -1, 0)
                if depth < p.depth and len(rows) >= 2 * p.least:
                    for j in range(x.shape[1]):
                        b = binned[rows, j]
                        m = len(edges[j]) + 1
                        gl, hl, nl = np.cumsum(np.bincount(b, g[rows], m))[:-1], np.cumsum(np.bincount(b, h[rows], m))[:-1], np.cumsum(np.bincount(b, minlength=m))[:-1]
                        if not len(gl):
                            continue
                        gain = gl**2 / (hl + p.penalty) + (gs - gl) ** 2 / (hs - hl + p.penalty) - gs**2 / (hs + p.penalty)
                        gain[(nl < p.least) | (len(rows) - nl < p.least)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), j, k)
                if best[1] < 0:
                    score[rows] += value[node]
                    continue
                _, j, k = best
                feature[node], threshold[node], left[node] = j, float(edges[j][k]), len(feature)
                for side in (binned[rows, j] <= k, binned[rows, j] > k):
                    below.append((len(feature), rows[side]))
                    feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
            level = below
    return Forest(np.array(feature or [-1]), np.array(threshold or [0.0]), np.array(left or [0]), np.array(value or [0.0]), np.array(roots, int), base, p.depth)


def held_out(doc_id: str):
    """The fold that no label is learnt from: crc32 of the id as text divisible by 5. A null id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, labels) of at most p.rows labelled documents outside the held-out fold."""
    use = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).where(f"__id is not null and __y is not null and not ({_fold('__id')})")
    use = use.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(p.rows)
    joined = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(use), "__id").select("__y", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_chunks(batch.column(1)):
                x = statistics(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(x[:, j]) for j in range(x.shape[1])]], names=["__y", *STATISTICS])

    schema = ", ".join(f"`{c}` double" for c in ["__y", *STATISTICS])
    # Ids that repeat give more rows; which of them stay hangs on a hash and not on the label.
    columns = ["__y", *STATISTICS]
    rows = joined.mapInArrow(run, schema).orderBy(F.xxhash64(*columns), *columns).limit(p.rows).toPandas().to_numpy(float).reshape(-1, len(columns))
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[:, 1:], rows[:, 0]


def _fold(column: str) -> str:
    return f"crc32(cast(cast({column} as string) as binary)) % 5 = 0"


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3, params: Params = Params()) -> DataFrame:
    """One row for each row of ``docs``: id_col, held_out boolean, score double (0 to 1), predicted int (1 if score >= cut).

    Only whole texts are scored; ids and labels choose the training rows and nothing else. Null
    texts count as empty and are scored too; repeated rows get equal scores; an empty
    table gives no rows; labels without documents, and null labels, teach nothing. A very long text is scored
    whole; of splits with equal gain the first feature and edge count; other columns are neither read nor returned.
    """
    forest = train(*labelled_statistics(docs, labels, id_col, text_col, label_col, params), params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [forest.score(statistics(texts)) for _, _, texts in text_chunks(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["__id", "held_out", "score"])

    read = docs.select(F.col(id_col).alias("__id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    schema = T.StructType([read.schema["__id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return read.mapInArrow(run, schema).select(F.col("__id").alias(id_col), "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
