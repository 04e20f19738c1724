"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of 0 to ``order`` bytes with the counts of the bytes that follow them. A byte is coded in the
longest context that the tree has; a context that lacks the byte escapes to the next shorter one (escape method C: as many escapes as
different bytes), where the bytes that were possible before are excluded. Statistics are frozen, so that the cost of a byte hangs on
its last ``order + 1`` bytes only. The trees are therefore flattened once: a table of all strings of order + 1 bytes has the exact cost in each
language, and a string that no tree has adds its context's escape and is looked up with one byte less. A text's code length is the sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trivane.llm.common import materialise
from trivane.llm.wordhash import text_chunks

#: Costs are whole numbers of 2^-16 nats, so that sums do not depend on their order.
UNIT = 1 << 16
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class PpmParams:
    """order: bytes of the longest context. rows: about as many training rows a language at most, chosen by a hash (the fit is on a bounded sample).
    strings: strings kept a language over all lengths, the most frequent ones. cells: costs in the flat tables at most. languages: the most frequent ones are learnt."""

    order: int = 4
    rows: int = 20_000
    strings: int = 200_000
    cells: int = 1 << 24
    languages: int = 64

    def each(self, languages: int) -> int:
        """Strings of one of so many languages; all flat tables then have at most ``cells`` costs."""
        return max(256, min(self.strings, self.cells // max(languages, 1) ** 2))


class Table:
    """Finds the place of 64-bit keys (ascending, different ones) by open addressing; -1: not there."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(3 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.place = keys, np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = np.flatnonzero(self.place[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.place[at[won]] = left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.place[at]
        if not len(self.keys):
            return out
        more = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[more]
        while len(more):
            at = (at + 1) & self.mask
            out[more] = self.place[at]
            on = (out[more] >= 0) & (self.keys[out[more]] != keys[more])
            more, at = more[on], at[on]
        return out


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in ascending ``keys``; -1: not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Trees:
    """The context trees of all languages as flat tables.

    counts[language][k - 1]: (keys, counts) of the strings of k bytes, the last byte lowest, for k = 1 to order + 1. Each string's last k - 1 bytes are among the shorter
    ones, with at least its count. ``counts`` is used up.
    """

    def __init__(self, languages: list[str], counts: list[list[tuple[np.ndarray, np.ndarray]]], order: int):
        self.languages, self.order = languages, order
        own = [self._costs(levels) for levels in counts]
        n = len(languages)
        bytes_ = np.arange(256, dtype=np.uint64)
        self.first = np.zeros((256, n))
        for i, levels in enumerate(counts):
            self.first[:, i] = self._first(levels[0], bytes_)
        self.tables: list[Table | None] = [None]
        self.costs: list[np.ndarray] = [np.round(self.first * UNIT).astype(np.int32)]
        self.contexts: list[Table | None] = [None]
        self.escapes: list[np.ndarray] = [np.zeros((1, n), np.int32)]
        keys_before, cost_before = bytes_, self.first
        for k in range(2, order + 2):
            contexts = self._union([own[i][k - 2][1] for i in range(n)])
            escapes = np.zeros((len(contexts), n))
            keys = self._union([counts[i][k - 1][0] for i in range(n)])
            for i in range(n):
                escapes[_at(contexts, own[i][k - 2][1]), i] = own[i][k - 2][2]
            # A string that a language lacks costs the escape of its context there, and what it costs without its first byte.
            cost = cost_before[_at(keys_before, keys & np.uint64((1 << 8 * (k - 1)) - 1))]
            if len(keys):
                cost += escapes[_at(contexts, keys >> np.uint64(8))]  # some language has the string, and so its context
            for i in range(n):
                cost[_at(keys, counts[i][k - 1][0]), i] = own[i][k - 2][0]
                own[i][k - 2] = counts[i][k - 1] = None
            keys_before, cost_before = keys, cost
            self.tables.append(Table(keys))
            self.costs.append(np.round(cost * UNIT).astype(np.int32))
            self.contexts.append(Table(contexts))
            self.escapes.append(np.round(escapes * UNIT).astype(np.int32))

    @staticmethod
    def _union(keys: list[np.ndarray]) -> np.ndarray:
        return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)

    @staticmethod
    def _first(level: tuple[np.ndarray, np.ndarray], bytes_: np.ndarray) -> np.ndarray:
        """Cost of each byte without any context; bytes that the language lacks share the escape alike."""
        keys, n = level
        total, kinds = n.sum() + len(n), max(len(n), 1)
        at = _at(keys, bytes_)
        missing = np.log(max(total, 1) / kinds) + np.log(max(256 - len(n), 1)) if len(n) else np.log(256)
        return np.where(at >= 0, np.log(max(total, 1)) - np.log(n[np.maximum(at, 0)]) if len(n) else 0.0, missing)

    @staticmethod
    def _costs(levels: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For k = 2 and on: costs of the strings of k bytes in their context, the contexts, and what escaping from each costs, exclusions included."""
        out = []
        totals = np.array([levels[0][1].sum() + len(levels[0][1])], float)
        contexts_before = np.zeros(1, np.uint64)
        for k in range(2, len(levels) + 1):
            keys, n = levels[k - 1]
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            kinds = np.bincount(of, minlength=len(contexts)).astype(float)
            total = np.bincount(of, n, len(contexts)) + kinds
            keys_before, n_before = levels[k - 2]
            # What the shorter context has counted for the bytes that are excluded there.
            shorter = n_before[_at(keys_before, keys & np.uint64((1 << 8 * (k - 1)) - 1))] if len(keys) else np.zeros(0)
            excluded = np.bincount(of, shorter, len(contexts))
            parent = totals[_at(contexts_before, contexts & np.uint64((1 << 8 * (k - 2)) - 1))] if len(contexts) else np.zeros(0)
            out.append((np.log(total[of]) - np.log(n), contexts, np.log(total / kinds) + np.log((parent - excluded) / parent)))
            totals, contexts_before = total, contexts
        return out

    def code_lengths(self, raw: list[bytes]) -> np.ndarray:
        """Cost of each text in each language, in 2^-16 nats."""
        n, order = len(self.languages), self.order
        lengths = np.fromiter((len(r) for r in raw), np.int64, len(raw))
        out = np.zeros((len(raw), n), np.int64)
        if not lengths.sum() or not n:
            return out
        keys = _strings(raw, lengths, order)
        cost = self._lookup(keys, order + 1)
        some = np.flatnonzero(lengths)
        out[some] = np.add.reduceat(cost, np.concatenate(([0], np.cumsum(lengths)[:-1]))[some], axis=0, dtype=np.int64)
        return out

    def _lookup(self, keys: np.ndarray, k: int) -> np.ndarray:
        if k == 1:
            return self.costs[0][keys.astype(np.int64)]
        at = self.tables[k - 1].find(keys)
        cost = self.costs[k - 1].take(np.maximum(at, 0), axis=0, mode="clip") if len(self.costs[k - 1]) else np.zeros((len(keys), len(self.languages)), np.int32)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            left = keys[missing]
            rest = self._lookup(left & np.uint64((1 << 8 * (k - 1)) - 1), k - 1)
            if len(self.escapes[k - 1]):
                context = self.contexts[k - 1].find(left >> np.uint64(8))
                rest = rest + np.where(context[:, None] >= 0, self.escapes[k - 1][np.maximum(context, 0)], 0)
            cost[missing] = rest
        return cost

    def best(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of the shortest code, ties to the first name, and its score; "und" and 0 without a letter or a language."""
        raw = [fold(t) for t in texts]
        length = self.code_lengths(raw)
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, score
        size = np.fromiter((max(len(r), 1) for r in raw), float, len(raw))
        # Bytes of a text are far from independent: the evidence counts with the root of their number.
        nats = (length - length.min(1, keepdims=True)) / UNIT / np.sqrt(size)[:, None]
        share = 1 / np.exp(-nats).sum(1)
        for i, at in enumerate(length.argmin(1)):
            if has_letter(texts[i]):
                names[i], score[i] = self.languages[at], share[i]
        return names, score


def fold(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _strings(raw: list[bytes], lengths: np.ndarray, order: int) -> np.ndarray:
    """For each byte of each text, it and the ``order`` bytes before it as one number; a text begins after zero bytes."""
    gap = bytes(order)
    data = np.frombuffer(gap + gap.join(raw), np.uint8).astype(np.uint64)
    whole = np.zeros(len(data) - order, np.uint64)
    for j in range(order + 1):
        whole |= data[j : len(data) - order + j] << np.uint64(8 * (order - j))
    # whole[i] ends at data[order + i]; text t begins at order * (t + 1) + the bytes before it.
    keep = np.repeat(np.arange(len(raw)) * order, lengths) + np.arange(int(lengths.sum()))
    return whole[keep]


def count_strings(rows: DataFrame, order: int) -> DataFrame:
    """language, string long, n: how often each run of order + 1 bytes occurs in ``rows(language, text)``; a task sums before anything travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            kinds, of = np.unique(keys, return_inverse=True)
            return kinds, np.bincount(of, n, len(kinds)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                keys, n = merged(parts)
                for lo in range(0, len(keys), 1 << 16):
                    k = keys[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(n[lo : lo + (1 << 16)])], names=["language", "string", "n"])
            held.clear()

        for batch in batches:
            names = batch.column(0)
            for lo, hi, texts in text_chunks(batch.column(1)):
                of = names.slice(lo, hi - lo).to_pylist()
                for name in sorted(set(of)):
                    raw = [fold(t) for t, x in zip(texts, of, strict=True) if x == name]
                    keys, n = np.unique(_strings(raw, np.fromiter((len(r) for r in raw), np.int64, len(raw)), order), return_counts=True)
                    held.setdefault(name, []).append((keys, n))
                    if len(held[name]) == 32:
                        held[name] = [merged(held[name])]
            if sum(len(k) for parts in held.values() for k, _ in parts) > 2_000_000:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "language string, string long, n long").groupBy("language", "string").agg(F.sum("n").alias("n"))


def held_out(doc_id: str):
    """The fold that no language is learnt from: crc32 of the id as text leaves 2 when divided by 4. A null id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", params: PpmParams = PpmParams()) -> Trees:
    """Context trees of the languages of ``docs`` outside the held-out fold. Null languages and texts teach nothing."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    rows = rows.select(F.col(lang_col).cast("string").alias("language"), F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    found = rows.groupBy("language").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "language").limit(params.languages)
    sizes = {r["language"]: r["rows"] for r in found.collect()}  # at most params.languages rows
    names = sorted(sizes)
    levels = params.order + 1
    if not names:
        return Trees([], [], params.order)
    spark = docs.sparkSession
    share = spark.createDataFrame([(x, min(1.0, params.rows / sizes[x])) for x in names], "language string, share double")
    chosen = rows.join(F.broadcast(share), "language").where(F.pmod(F.xxhash64("__id", "text"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("language", "text")
    longest = count_strings(chosen, params.order)
    each = F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("k")
    short = F.when(F.col("k") >= 8, F.col("string")).otherwise(F.col("string").bitwiseAND(F.expr("shiftleft(1L, 8 * k) - 1")))
    every = longest.select("language", each, "string", "n").select("language", "k", short.alias("string"), "n").groupBy("language", "k", "string").agg(F.sum("n").alias("n"))
    # The most frequent strings stay, down to a count (in steps of an eighth of a doubling). A string's end is never rarer than the string, so it stays too.
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    every = materialise(every.select("language", "k", "string", "n", step), "ppm")
    down = Window.partitionBy("language").orderBy(F.desc("step"))
    limits = every.groupBy("language", "step").agg(F.count("*").alias("strings")).withColumn("strings", F.sum("strings").over(down)).where(F.col("strings") <= params.each(len(names)))
    limits = limits.groupBy("language").agg(F.min("step").alias("least"))
    kept = every.join(F.broadcast(limits), "language").where("step >= least")
    counts = []
    for name in names:
        own = kept.where(F.col("language") == name).select("k", "string", "n").toArrow()  # at most params.each() rows
        k, string, n = (own.column(c).to_numpy() for c in ("k", "string", "n"))
        order = np.lexsort((string, k))
        k, string, n = k[order], string[order].astype(np.uint64), n[order].astype(float)
        cut = np.searchsorted(k, np.arange(1, levels + 2))
        counts.append([(string[lo:hi], n[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)])
    return Trees(names, counts, params.order)


def languages(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id_col, held_out boolean, lang_pred string, score double (0 to 1). Only the whole text decides.

    lang_pred has the shortest code (ties: the first name); score is its share when each language counts with e^(-nats / root of bytes). A null text, and one
    without a letter, is "und" with score 0. A very long text is coded whole, in a chunk of its own. Repeated rows get equal results, an
    empty table gives no rows, other columns of ``docs`` are not returned. Without any learnt language all rows are "und".
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # at most PpmParams.cells costs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for _, _, texts in text_chunks(batch.column(2)):
                a, b = model.best(texts)
                names += a
                scores.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["__id", "held_out", "lang_pred", "score"])

    read = docs.select(F.col(id_col).alias("__id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    schema = T.StructType([read.schema["__id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return read.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
