"""Benchmark passages in documents, found by a CGK embedding and bit-sampling LSH.

From a window of words a cursor walks through a random function of (step, word): each step
writes the word under the cursor and moves on or stays. Two windows at a small
edit distance write sequences at a small Hamming distance, whatever the kind of
edits, so sampled coordinates of the sequence are a hash for edit distance. The
walk is repeated with other functions, and each is sampled several times. The hashes of the items' windows
are the index; windows of the documents are looked up in it, and what collides is verified by
exact edit distance against the item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trivane.llm.wordhash import Words, mix, text_chunks

#: Items whose index goes to the tasks at once (more items take more passes over the documents), and words of them.
ITEMS_PER_PASS, WORDS_PER_PASS = 4000, 400_000
#: Words from one window of a document to the next (no more than the least item has); an item has windows at as many offsets in a row.
STRIDE = 4
#: Windows of an item: from about every fourth word, eight starts at most.
APART, STARTS = 4, 8
#: Item sizes (from) of one form of window, its steps, and the coordinates of a sample; items of under 20 words, with few windows, are sampled twice as often.
FORMS = ((20, 20, 6), (10, 18, 5), (7, 10, 4), (5, 7, 3), (3, 4, 2), (1, 1, 1))
#: Item sizes (from) and the hashes that a text must share with an item: a longer item has more windows and meets more often.
MEETINGS = ((50, 8), (32, 4), (12, 2), (0, 1))


@dataclass(frozen=True)
class Params:
    """similarity: 1 - edits / words of the item. walks, samples: repeats of the embedding, and hashes taken from each.

    At the largest distance of 0.8 the defaults find 0.99 and more of the windows (10 to 200 words).
    """

    similarity: float = 0.8
    walks: int = 6
    samples: int = 13
    seed: int = 11

    def edits(self, n: int) -> int:
        return int(math.floor((1 - self.similarity) * n + 1e-9))


def substring_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of ``text`` nearest to ``item``, None if it needs more than ``most`` edits.

    Of the parts with the fewest edits, the one that ends first, then the longest.
    Edit distance in words, by bit-parallel columns.
    """
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    up, down, score, full, top = (1 << m) - 1, 0, m, (1 << m) - 1, 1 << (m - 1)
    best = (most + 1, -1)
    for j, w in enumerate(text.tolist()):
        eq = masks.get(w, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq | down) & full
        ph, mh = (down | ~(d | up)) & full, up & d
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = (mh | ~(x | ph)) & full, ph & x
        if score < best[0]:
            best = (score, j + 1)
    if best[1] < 0:
        return None
    end = best[1]
    back = text[max(0, end - m - most) : end][::-1].tolist()
    rev = item[::-1].tolist()
    column = list(range(m + 1))
    start = end
    for j, w in enumerate(back):
        last, column = column, [j + 1]
        for i in range(m):
            column.append(min(last[i] + (rev[i] != w), last[i + 1] + 1, column[i] + 1))
        if column[m] == best[0]:
            start = end - j - 1
    return best[0], start, end


class Form:
    """Windows of items of similar size: owner (item), offset, and for each walk the samples with their hashes in order."""

    def __init__(self, index: Index, members: list[int], least: int, steps: int, coordinates: int):
        self.steps, self.stride = steps, min(STRIDE, least)
        owner, offset, begin = [], [], []
        texts = []
        at = 0
        for i in members:
            n = len(index.items[i])
            last = max(0, n - steps * 2 // 3)
            starts = range(0, last + 1, max(APART, -(-last // (STARTS - 1)) if last else APART))
            for o in sorted({o + p for o in starts for p in range(self.stride) if o + p < n}):
                owner.append(i)
                offset.append(o)
                begin.append(at + o)
            texts += [index.items[i], np.zeros(steps + 1, np.uint64)]
            at += n + steps + 1
        words = np.concatenate(texts)
        self.owner, self.offset = np.array(owner, np.int32), np.array(offset, np.int32)
        self.walks = []
        known = index.known(words)
        for r in range(index.params.walks):
            rng = np.random.default_rng((index.params.seed, steps, r))
            seed = rng.integers(1, 1 << 63, dtype=np.uint64)
            path = walk(words, np.array(begin), steps, seed)
            samples = []
            for c in {tuple(sorted(rng.permutation(steps)[:coordinates].tolist())) for _ in range(index.params.samples * (1 if least >= 20 else 2))}:
                # A window whose walk leaves the item before a coordinate has no hash there.
                inside = np.flatnonzero(np.logical_and.reduce([known[path[t]] > 0 for t in c]))
                key = _hash([known[path[t][inside]] for t in c])
                order = np.argsort(key, kind="stable")
                samples.append((c, key[order], inside[order].astype(np.int32)))
            self.walks.append((seed, samples))


class Index:
    """The items of one pass and the hashes of the walks of their windows."""

    def __init__(self, ids: list, texts: list[str], params: Params):
        self.params, self.ids = params, ids
        words = Words(texts)
        self.items = [words.hashes[words.first[i] : words.first[i + 1]] for i in range(len(ids))]
        self.edits = [params.edits(len(x)) for x in self.items]
        self.vocabulary = np.unique(words.hashes)
        self.sets = [Counter(x.tolist()) for x in self.items]
        self.meetings = np.array([next(m for least, m in MEETINGS if len(x) >= least) for x in self.items], np.int64)
        self.forms, upper = [], float("inf")
        for least, steps, coordinates in FORMS:
            if members := [i for i, x in enumerate(self.items) if least <= len(x) < upper]:
                self.forms.append(Form(self, members, least, steps, coordinates))
            upper = least

    def known(self, h: np.ndarray) -> np.ndarray:
        """Number of each word in the items' vocabulary from 1, 0 if it is in none."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.uint64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0).astype(np.uint64)

    def candidates(self, h: np.ndarray, text_first: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(text, item, places in ``h`` where the item may begin): windows that share hashes with its windows."""
        texts, owners, places = ([np.zeros(0, np.int64)] for _ in range(3))
        words = self.known(h)
        for form in self.forms:
            padded = np.concatenate((h, np.zeros(form.steps + 1, np.uint64)))
            known = np.concatenate((words, np.zeros(form.steps + 1, np.uint64)))
            starts = np.arange(0, len(h), form.stride)
            for seed, samples in form.walks:
                path = walk(padded, starts, form.steps, seed)
                word = [known[p] for p in path]
                use = [w > 0 for w in word]
                for c, keys, windows in samples:
                    both = use[c[0]]
                    for t in c[1:]:
                        both = both & use[t]
                    at = np.flatnonzero(both)
                    if not len(at) or not len(keys):
                        continue
                    key = _hash([word[t][at] for t in c])
                    lo = np.searchsorted(keys, key, "left")
                    met = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == key)
                    if not len(met):
                        continue
                    n = np.searchsorted(keys, key[met], "right") - lo[met]
                    window = windows[np.repeat(lo[met], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    place = np.repeat(starts[at[met]], n)
                    texts.append(np.searchsorted(text_first, place, "right") - 1)
                    owners.append(form.owner[window].astype(np.int64))
                    places.append(place - form.offset[window])
        text, owner, place = (np.concatenate(x) for x in (texts, owners, places))
        order = np.lexsort((place, owner, text))
        text, owner, place = text[order], owner[order], place[order]
        cut = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (owner[1:] != owner[:-1]), [True]))) if len(text) else np.zeros(1, np.int64)
        enough = np.flatnonzero(np.diff(cut) >= self.meetings[owner[cut[:-1]]])
        for a, b in zip(cut[enough].tolist(), cut[enough + 1].tolist(), strict=True):
            yield int(text[a]), int(owner[a]), np.unique(place[a:b]).tolist()

    def search(self, h: np.ndarray, text_first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, word after the last) by text and item with a verified match."""
        for t, i, starts in self.candidates(h, text_first):
            item, most = self.items[i], self.edits[i]
            lo, hi, n = int(text_first[t]), int(text_first[t + 1]), len(item)
            done = -1
            for s in starts:
                if s <= done:
                    continue
                a, b = max(lo, s - 2 * most), min(hi, s + n + 4 * most)
                done = s + most  # those that begin up to there lie in this neighbourhood too
                # Words that no edit touches are the item's own, as often as it has them.
                if sum((Counter(h[a:b].tolist()) & self.sets[i]).values()) < n - most or substring_distance(item, h[a:b], most) is None:
                    continue
                # The whole text, so that the result does not depend on which window met first.
                found = substring_distance(item, h[lo:hi], most)
                yield t, i, found[0], found[1], found[2]
                break


def walk(words: np.ndarray, starts: np.ndarray, steps: int, seed: np.uint64) -> list[np.ndarray]:
    """The cursor's place at each step of the walks from ``starts``: a bit of a word's hash for each step says whether it moves on."""
    bits = mix(words ^ seed)
    at, out = starts, []
    for t in range(steps):
        out.append(at)
        at = at + (bits[at] >> np.uint64(t) & np.uint64(1)).astype(np.int64)
    return out


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(columns[0]), np.uint64)
    for j, x in enumerate(columns):
        total += x * np.uint64(pow(0xA0761D6478BD642F, j + 1, 1 << 64))
    return mix(total)


def find_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", params: Params = Params()) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, edits int, n_words int (of the item), similarity double, start, end.

    A document holds an item when some run of its words is within
    floor((1 - similarity) * n) word edits of the item's n words (lower case,
    punctuation ignored). start and end are code points of the first nearest run in the
    lower-case text. Null, empty and wordless texts and items match nothing; repeated rows
    of either table each give their matches, and rows with null ids take part (ids of any type). Very long texts are searched whole, in a chunk of their own; of ties
    between runs the first counts. Only the columns named here are read and returned. Candidates come from the
    hashes alone (recall: see Params). The index of the benchmark goes to the tasks in blocks of ITEMS_PER_PASS items
    or WORDS_PER_PASS words, however many it has; documents are not shuffled.
    """
    left = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("__text"))
    id_type, item_type = left.schema["doc_id"].dataType, items.schema[item_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", item_type)] + [T.StructField(c, T.IntegerType()) for c in ("edits", "n_words")] + [T.StructField("similarity", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    held: list[tuple] = []
    words = 0
    out: DataFrame | None = None
    for row in items.select(item_id, item_text).toLocalIterator():
        held.append(tuple(row))
        words += len((row[1] or "").split())
        if len(held) == ITEMS_PER_PASS or words >= WORDS_PER_PASS:
            part = _one_pass(left, held, params, schema)
            out, held, words = part if out is None else out.unionByName(part), [], 0
    if held or out is None:
        part = _one_pass(left, held, params, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _one_pass(docs: DataFrame, held: list[tuple], params: Params, schema: T.StructType) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Index([x[0] for x in held], [x[1] for x in held], params))
    item_type = to_arrow_type(schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple] = []
            for lo, _, texts in text_chunks(batch.column(1)):
                words = Words(texts)
                for t, i, edits, a, b in index.search(words.hashes, words.first):
                    data, begin = words.data, words.offset[t]
                    s, e = words.starts[words.first[t] + a], words.ends[words.first[t] + b - 1] if b > a else words.starts[words.first[t] + a]
                    before = len(data[begin:s].tobytes().decode("utf-8", "surrogatepass"))
                    n = len(index.items[i])
                    rows.append((lo + t, index.ids[i], edits, n, 1 - edits / n, before, before + len(data[s:e].tobytes().decode("utf-8", "surrogatepass"))))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0])), pa.array(cols[1], item_type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.int64())],
                    names=["doc_id", "item_id", "edits", "n_words", "similarity", "start", "end"],
                )

    return docs.mapInArrow(run, schema)
