"""Strings of a given length that an earlier document holds too, by blockwise sorting of suffixes with a difference cover.

1. Every suffix belongs to the bucket of the least-hashed gram among its first
   ``length`` bytes, so equal strings share a bucket. Suffixes that follow each other
   mostly share it too, and travel as one run: its bucket and where it is. A run whose bytes an earlier
   document of the same lot has too goes whole before the shuffle, bytes against bytes.
2. The bytes of the runs in buckets of several documents are fetched. A bucket of more than MOST_RUNS runs
   is split by more leading bytes: each suffix goes on alone, under a hash of all its ``length`` bytes.
3. One block of buckets at a time is sorted: equal runs are one kind, and the suffixes of different kinds are sorted by
   their first 32 bytes. Longer ties are resolved by the ranks of a difference-cover
   sample: any two suffixes have an offset at which both lie in the sample.

Hashes choose buckets and pick what to compare. What goes is decided by bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivane.llm.common import discard, materialise
from trivane.llm.wordhash import _BYTE, mix, powers, text_chunks

#: Bytes of a gram; the position bits of an ordering value; runs settled together before the shuffle;
#: runs of a bucket that is not split; bytes of a block; bytes compared at once.
GRAM, POSITION, LOT, MOST_RUNS, BLOCK, COMPARED = 20, 28, 1 << 18, 1 << 16, 1 << 21, 1 << 20
#: Shares of the buckets that are sorted one after the other.
SHARES = 2
#: Hot buckets that go to all tasks at once (16 bytes each); more are joined.
FEW = 1 << 20
#: Where a run is: 24 bits that tell texts under one id apart, 31 of its first byte, 8 of its number of suffixes.
TEXT, START = 39, 8
#: A perfect difference set modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
_MASK = np.uint64((1 << POSITION) - 1)


def _cover_offsets() -> np.ndarray:
    """offset[a, b] < PERIOD with (a + offset) and (b + offset) both in the cover."""
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return out


OFFSET = _cover_offsets()


class Runs:
    """Runs of suffixes of joined texts: text, start (byte in the text), count (suffixes), key (bucket), hash (of its bytes), begin (byte in data)."""

    def __init__(self, raw: list[bytes], length: int):
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        size = np.fromiter((len(x) for x in raw), np.int64, len(raw))
        first = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        n, wide = len(data), length - GRAM + 1
        strings = np.maximum(size - length + 1, 0)
        self.data = data
        self.text = self.start = self.count = self.begin = np.zeros(0, np.int64)
        self.key = self.hash = np.zeros(0, np.uint64)
        if not strings.sum():
            return
        up, down = powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up, out=sums[1:])
        gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n + 1 - GRAM])
        low = (gram & ~_MASK) | np.arange(len(gram), dtype=np.uint64)
        done = 1
        while done < wide:
            step = min(done, wide - done)
            low = np.minimum(low[:-step], low[step:])
            done += step
        text = np.repeat(np.arange(len(raw)), strings)
        at = np.arange(len(text)) - np.repeat(np.cumsum(strings) - strings, strings) + first[text]
        anchor = (low[at] & _MASK).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
        self.text, self.begin = text[new], at[new]
        begin = self.begin
        self.start, self.count = begin - first[self.text], np.diff(np.concatenate((new, [len(text)])))
        self.key = mix(gram[anchor[new]] ^ np.uint64(0x5851F42D4C957F2D))
        self.hash = mix((sums[begin + self.count + length - 1] - sums[begin]) * down[begin] + self.count.astype(np.uint64))


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a + size] equals data[b:b + size], for each row."""
    out = np.zeros(len(a), bool)
    ends = np.cumsum(size)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED)))
        n = size[at:to]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = data[np.repeat(a[at:to], n) + inside] == data[np.repeat(b[at:to], n) + inside]
        out[at:to] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        at = to
    return out


def _settle_lot(lot: list[tuple], length: int) -> pa.RecordBatch:
    """The runs of a lot (data, key, hash, doc, at, begin): those that go whole as intervals under keys of their own, the others as they are."""
    shift = np.cumsum([0, *[len(x[0]) for x in lot]])[:-1]
    data = np.concatenate([x[0] for x in lot])
    key, kind, doc, at = (np.concatenate([x[i] for x in lot]) for i in range(1, 5))
    begin = np.concatenate([x[5] + s for x, s in zip(lot, shift, strict=True)])
    order = np.lexsort((doc, kind, key))
    new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (kind[order][1:] != kind[order][:-1])))
    first = np.empty(len(key), np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.flatnonzero((doc > doc[first]) & (at & 255 == at[first] & 255))
    gone = np.zeros(len(key), bool)
    gone[later] = _same_bytes(data, begin[later], begin[first[later]], (at[later] & 255) + length - 1)
    out, g = np.flatnonzero(~gone), np.flatnonzero(gone)
    start = at[g] >> START
    end = start + (at[g] & 255)
    turn = np.flatnonzero(np.concatenate(([True], (np.diff(g) > 1) | (start[1:] != end[:-1]) | (doc[g][1:] != doc[g][:-1])))) if len(g) else g
    last = np.concatenate((turn[1:], [len(g)]))[: len(turn)] - 1
    a, stop = g[turn], (end[last] & ((1 << TEXT - START) - 1)) + length - 1
    spread = mix(at[a].view(np.uint64) ^ mix(doc[a].view(np.uint64))).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x)) for x in ((key[out], spread), (doc[out], doc[a]), (at[out], at[a]), (np.zeros(len(out), np.int64), stop))], names=["key", "doc", "at", "end"]
    )


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """key, doc, at, end (0, or of an interval that goes) of documents(doc, text, mark)."""
    most = 1 << (POSITION - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[tuple] = []
        size = 0
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for first, end, texts in text_chunks(batch.column(1)):
                rows, raw = range(first, end), [(t or "").encode("utf-8", "surrogatepass") for t in texts]
                # A text too long for the position bits is cut in overlapping parts.
                cut = [(r, a, b[a : a + most + length - 1]) for r, b in zip(rows, raw, strict=True) for a in range(0, max(1, len(b)), most)]
                for lo in range(0, len(cut), len(cut) if len(cut) == len(rows) else 1):
                    own = cut[lo:] if len(cut) == len(rows) else cut[lo : lo + 1]
                    x = Runs([b for _, _, b in own], length)
                    row, shift = np.array([r for r, _, _ in own])[x.text], np.array([a for _, a, _ in own])[x.text]
                    lot.append((x.data, x.key.view(np.int64), x.hash.view(np.int64), ids[row], marks[row] << TEXT | (x.start + shift) << START | x.count, x.begin))
                    size += len(x.text)
                    if size >= LOT:
                        yield _settle_lot(lot, length)
                        lot, size = [], 0
        if size:
            yield _settle_lot(lot, length)

    return docs.mapInArrow(run, "key bigint, doc bigint, at bigint, end bigint")


def _open(runs: DataFrame) -> DataFrame:
    """The rows of ``runs`` that go already, and those whose bucket has several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = [np.zeros(0, np.int64)] * 4, None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
            key, doc, _, end = held
            if not len(key):
                continue
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((cut, [len(key)])))
            several = doc[cut] != doc[cut + size - 1]
            several[0] |= key[0] == passing
            # The last key may go on: its rows wait as long as they are of one document.
            stop = cut[-1] if batch is not None and not several[-1] else len(key)
            passing = key[-1] if several[-1] else None
            out = np.flatnonzero((np.repeat(several, size) | (end > 0))[:stop])
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in held], names=["key", "doc", "at", "end"])
            held = [x[stop:] for x in held]

    return runs.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(run, "key bigint, doc bigint, at bigint, end bigint")


def equal_strings(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A class for each data[at:at + length]; ``data`` ends with 64 bytes of padding. length is 45 to 50.

    Sorted by 32 bytes; ties of more are resolved against the first of their group
    by cover ranks of 32 bytes at an offset of length - 32 up to 31, and by the bytes left if the ranks differ. What
    is not equal to the first is sorted by the bytes left, so that a group of many classes takes no more rounds than one of two.
    """
    eight = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    columns = lambda p, *offsets: tuple(eight[p + o].astype(np.uint64) for o in offsets)

    def sort(*by):
        """(order, whether each of that order differs from the one before) by the last column first."""
        order = np.lexsort(by)
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in by:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        return order, new

    order, new = sort(*columns(at, 24, 16, 8, 0))
    out = order.copy()
    out[order] = order
    tied = np.flatnonzero(~new | np.concatenate((~new[1:], [False])))
    if not len(tied):
        return out
    todo, group, start = order[tied], np.cumsum(new)[tied], np.flatnonzero(new[tied])
    leader = np.repeat(todo[start], np.diff(np.concatenate((start, [len(todo)]))))
    i, j = at[todo], at[leader]
    near, far = length - 32, length - 8
    d = near + OFFSET[(i + near) % PERIOD, (j + near) % PERIOD]
    # Of the sample only what the ties ask for is ranked.
    sample, asked = np.unique(np.concatenate((i + d, j + d)), return_inverse=True)
    order, new = sort(*columns(sample, 24, 16, 8, 0))
    cover = np.empty(len(sample), np.int64)
    cover[order] = np.cumsum(new)
    same = cover[asked[: len(i)]] == cover[asked[len(i) :]]
    rest = np.flatnonzero(~same)
    same[rest] = np.logical_and.reduce([x == y for x, y in zip(columns(i[rest], 32, far - 4, far), columns(j[rest], 32, far - 4, far), strict=True)])
    out[todo[same]] = leader[same]
    todo, group = todo[~same], group[~same]
    order, new = sort(*columns(at[todo], far, far - 4, 32), group)
    todo, start = todo[order], np.flatnonzero(new)
    out[todo] = np.repeat(todo[start], np.diff(np.concatenate((start, [len(todo)]))))
    return out


def _kinds(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(kind, whole) of runs sorted by document: equal bytes are one kind, all but those of its first document go whole."""
    seen: dict[bytes, int] = {}
    kind = np.fromiter((seen.setdefault(b, len(seen)) for b in table["bytes"].to_pylist()), np.int64, table.num_rows)
    doc = table["doc"].to_numpy()
    first = np.unique(kind, return_index=True)[1]
    return kind, doc > doc[first][kind]


def _intervals(doc: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at >> TEXT), pa.array(start), pa.array(end)], names=["doc", "mark", "start", "end"])


def _whole(table: pa.Table, whole: np.ndarray, length: int) -> pa.RecordBatch:
    doc, at = table["doc"].to_numpy()[whole], table["at"].to_numpy()[whole]
    start = at >> START & (1 << TEXT - START) - 1
    return _intervals(doc, at, start, start + (at & 255) + length - 1)


def _block_intervals(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """What goes of all runs (key, doc, at, bytes) of some whole buckets, sorted by key and doc."""
    kind, whole = _kinds(table)
    yield _whole(table, whole, length)
    rest = np.flatnonzero(~whole)
    kind, first = kind[rest], np.unique(kind, return_index=True)[1]
    key, doc, at = (table[c].to_numpy() for c in ("key", "doc", "at"))
    # Kinds of a bucket that has no kind of another document have nothing to be sorted with.
    buckets = np.flatnonzero(np.concatenate(([True], key[first][1:] != key[first][:-1])))
    n = np.diff(np.concatenate((buckets, [len(first)])))
    sort = np.flatnonzero(np.repeat(np.minimum.reduceat(doc[first], buckets) != np.maximum.reduceat(doc[first], buckets), n))
    if not len(sort):
        return
    own = first[sort]
    raw = table["bytes"].take(pa.array(own)).to_pylist()
    count = at[own] & 255
    data = np.frombuffer(b"".join([*raw, bytes(64 + length)]), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(x) for x in raw])))[:-1]
    run = np.repeat(np.arange(len(own)), count)
    shift = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    same = equal_strings(data, begin[run] + shift, length)
    least = np.full(len(run), np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc[own][run])
    gone = np.flatnonzero(doc[own][run] > least[same])
    if not len(gone):
        return
    new = np.flatnonzero(np.concatenate(([True], (np.diff(gone) > 1) | (run[gone][1:] != run[gone][:-1]))))
    last = gone[np.concatenate((new[1:] - 1, [len(gone) - 1]))]
    a = gone[new]
    # Each row of a kind loses what the kind loses.
    of_kind = np.full(len(first), -1)
    of_kind[sort] = np.arange(len(sort))
    member = of_kind[kind]
    rows = rest[member >= 0][np.argsort(member[member >= 0], kind="stable")]
    many = np.bincount(member[member >= 0], minlength=len(sort))
    each = many[run[a]]
    row = rows[np.repeat((np.cumsum(many) - many)[run[a]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
    start = at[row] >> START & (1 << TEXT - START) - 1
    yield _intervals(doc[row], at[row], start + np.repeat(shift[a], each), start + np.repeat(shift[last], each) + length)


def _sorted_blocks(runs: DataFrame, length: int) -> DataFrame:
    """doc, mark, start, end that go, from runs(key, doc, at, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.nbytes
                if size < BLOCK:
                    continue
            if not held:
                return
            table = pa.Table.from_batches(held)
            key = table["key"].to_numpy()
            keep = 0
            if batch is not None and len(key):
                keep = len(key) - int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
            if len(key) > keep:
                yield from _block_intervals(table.slice(0, len(key) - keep), length)
            table = table.slice(len(key) - keep)
            if keep and len(key) == keep:  # one bucket and more of it to come: later copies go, so that only its kinds are held
                whole = _kinds(table)[1]
                yield _whole(table, whole, length)
                table = table.filter(pa.array(~whole))
            held = table.combine_chunks().to_batches() if keep else []
            size = 0 if not keep else min(sum(x.nbytes for x in held), BLOCK // 2)

    ordered = runs.repartition("key").sortWithinPartitions("key", "doc")
    return ordered.mapInArrow(run, "doc bigint, mark bigint, start bigint, end bigint")


def _fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """key, doc, at, bytes of the runs in wanted(doc, mark, runs array<struct<key, at, hot>>); a hot run as one row a suffix under its own key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_chunks(batch.column(1)):
                own = batch.column(2).slice(lo, hi - lo)
                n = own.value_lengths().to_numpy(zero_copy_only=False)
                flat = own.flatten()
                key, at, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                doc = np.repeat(batch.column(0).slice(lo, hi - lo).to_numpy(), n)
                start, count = at >> START & (1 << TEXT - START) - 1, at & 255
                if hot.any():
                    each = np.where(hot, count, 1)
                    shift = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    hot, doc, key = (np.repeat(x, each) for x in (hot, doc, key))
                    start, count = np.repeat(start, each) + shift, np.where(hot, 1, np.repeat(count, each))
                    at, n = np.repeat(at, each) >> TEXT << TEXT | start << START | count, np.add.reduceat(each, np.cumsum(n) - n)
                raw: list[bytes] = []
                ends = np.cumsum(n)
                for t, a, b in zip(texts, ends - n, ends, strict=True):
                    data = (t or "").encode("utf-8", "surrogatepass")
                    raw += [data[i:j] for i, j in zip(start[a:b].tolist(), (start[a:b] + count[a:b] + (length - 1)).tolist(), strict=True)]
                if hot.any():
                    joined = np.frombuffer(b"".join([r for r, h in zip(raw, hot.tolist(), strict=True) if h]), np.uint8).reshape(-1, length)
                    key = key.copy()
                    key[hot] = mix((_BYTE[joined] * powers(length)[0]).sum(1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(at), pa.array(raw, pa.binary())], names=["key", "doc", "at", "bytes"])

    joined = docs.join(wanted.withColumnsRenamed({"doc": "__doc", "mark": "__mark"}), (F.col("doc") == F.col("__doc")) & (F.col("mark") == F.col("__mark"))).select("doc", "text", "runs")
    return joined.mapInArrow(run, "key bigint, doc bigint, at bigint, bytes binary")


def _mark(text_col: str):
    """24 bits of the text's hash."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit((1 << 24) - 1))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc long, text, mark long."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), _mark(text_col).alias("mark"))


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """doc long, mark long, start long, end long: byte ranges, which may overlap, covered by strings of ``length`` bytes that also start in a document with a smaller id.

    mark (24 bits of the text's hash) tells texts under one id apart.
    """
    if not 45 <= length <= 50:
        raise ValueError("length is 45 to 50")
    read = _marked(docs, id_col, text_col).where("doc is not null and text is not null")
    opened = materialise(_open(_runs(read, length)), "open")
    some = opened.where("end = 0")
    hot = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_RUNS).select("key", F.lit(True).alias("hot"))
    hot = materialise(hot, "hot")
    some = some.join(F.broadcast(hot) if hot.count() <= FEW else hot, "key", "left").select("key", "doc", "at", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = some.groupBy("doc", F.shiftright("at", TEXT).alias("mark")).agg(F.collect_list(F.struct("key", "at", "hot")).alias("runs"))
    fetched = materialise(_fetch(read, wanted, length), "runs")
    first = F.shiftright("at", START).bitwiseAND(F.lit((1 << TEXT - START) - 1))
    whole = opened.where("end > 0").select("doc", F.shiftright("at", TEXT).alias("mark"), first.alias("start"), "end")
    found = materialise(whole, "found")
    for share in range(SHARES):  # one after the other, so that the shuffle of one is gone before the next
        own = fetched.where(F.pmod("key", F.lit(SHARES)) == share)
        found = found.union(materialise(_sorted_blocks(own, length), "found"))
    for done in (opened, hot, fetched):
        discard(done)
    return found


def _union(start: np.ndarray, end: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the intervals."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    a, reach = start[order], np.minimum(np.maximum.accumulate(end[order]), size)
    new = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
    return list(zip(a[new].tolist(), reach[np.concatenate((new[1:] - 1, [len(reach) - 1]))].tolist(), strict=True))


def without_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row for each row of ``docs``: id_col, n_bytes long, spans array<struct<start, end>> (maximal removed byte runs), kept binary.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a
    smaller id; all is judged on the input. Null texts count as empty. Rows with a null
    id have no place in the order: they lose nothing and nothing is lost for them. Rows that
    repeat an id are one document, whose texts lose nothing for each other; each text has its own spans (texts under one id are told
    apart by 24 bits of their hash). An empty table gives no rows. Very long texts are taken whole; other columns are
    neither read nor returned, whatever their names.
    """
    found = repeated_strings(docs, id_col, text_col, length)
    spans = found.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for lo, hi, texts in text_chunks(batch.column(1)):
                lists = batch.column(2).slice(lo, hi - lo)
                flat, offsets = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
                start, end = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                size, out, kept = [], [], []
                for i, text in enumerate(texts):
                    b = (text or "").encode("utf-8", "surrogatepass")
                    size.append(len(b))
                    spans = _union(start[offsets[i] : offsets[i + 1]], end[offsets[i] : offsets[i + 1]], len(b))
                    out.append([{"start": x, "end": y} for x, y in spans])
                    kept.append(b"".join([b[x:y] for x, y in zip([0, *[y for _, y in spans]], [*[x for x, _ in spans], len(b)], strict=True)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(out, kind), pa.array(kept, pa.binary())], names=["__id", "n_bytes", "spans", "kept"])

    read = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    own = read.withColumn("__mark", _mark("__text"))
    joined = own.join(spans, (F.col("__id").cast("long") == F.col("doc")) & (F.col("__mark") == F.col("mark")), "left").select("__id", "__text", "found")
    schema = T.StructType([read.schema["__id"], *T.StructType.fromDDL("n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary").fields])
    return joined.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
