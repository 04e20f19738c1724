"""Near-duplicate texts by Jaccard similarity of word shingles, with a MinHash LSH forest.

Each tree of the forest orders the texts by a sequence of MinHash values; sorted, the sequences are a trie
whose nodes are prefixes. Long prefixes come first: a node is matched at the longest prefix,
and shortened to its parent as long as that has few texts, so that small nodes are matched at the shortest prefix and
hot ones stay deep. A text whose prefixes are then too long for the target recall, by the chance of a pair
at the threshold to meet in one of its trees, has its cheapest nodes shortened until it is met. Texts below one
matched node are compared exactly. Nodes with many texts are cut in blocks, and tasks compare block with block, so no node is ever
held whole; a pair is counted only in the first tree where it meets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.common import connected_components, materialise
from trivane.llm.wordhash import Words, by_group, lists_of, mix, text_chunks

#: Texts, and shingles, of one block of a node.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1 << 20
#: Texts of a node that is shortened for free; rows of a subtree held in a task (a larger one is hot at every depth).
SMALL, HELD = 64, 1 << 18


def forest_depth(threshold: float, trees: int, target: float, max_depth: int) -> int:
    """Longest prefix at which, matched in all trees, a pair at the threshold still meets with the target probability."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def signatures(docs: DataFrame, text_col: str, keep: list[str], words: int, trees: int, depth: int, seed: int = 7) -> DataFrame:
    """keep..., key binary (MD5 of the text), n_shingles int, signature binary (16 bits of each value, tree by tree); null for a text without words."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, (trees, depth), dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, (trees, depth), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, values, keys = [], [], []
            for lo, hi, texts in text_chunks(batch.column(batch.schema.get_field_index("__text"))):
                keys += [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
                grams, first = Words(texts).grams(words)
                n = np.diff(first)
                some = np.flatnonzero(n)
                out = np.zeros((hi - lo, trees, depth), np.uint16)
                for t in range(trees if len(some) else 0):
                    for d in range(depth):
                        low = np.minimum.reduceat(grams * a[t, d] + b[t, d], first[some])
                        out[some, t, d] = (mix(low) >> np.uint64(48)).astype(np.uint16)
                counts.append(n)
                values += [x.tobytes() if m else None for x, m in zip(out, n.tolist(), strict=True)]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(k)) for k in keep], pa.array(keys, pa.binary()), pa.array(n.astype(np.int32)), pa.array(values, pa.binary())],
                names=[*keep, "key", "n_shingles", "signature"],
            )

    read = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join([f"`{k}` {read.schema[k].dataType.simpleString()}" for k in keep] + ["key binary", "n_shingles int", "signature binary"])
    return read.mapInArrow(run, schema)


def _prefixes(texts: DataFrame, trees: int, depth: int, shortest: int) -> DataFrame:
    """tree int, key, p<d> long for each depth d from ``shortest``: the label of the text's prefix of that length."""
    depths = range(shortest, depth + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, trees, depth).astype(np.uint64)
            label, out = np.broadcast_to(np.arange(trees, dtype=np.uint64), values.shape[:2]), []
            for d in range(depth):
                label = mix(label * np.uint64(0x9E3779B97F4A7C15) + values[:, :, d] + np.uint64(1))
                if d + 1 >= shortest:
                    out.append(pa.array(label.view(np.int64).ravel()))
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), batch.column(0).take(pa.array(np.repeat(np.arange(n), trees))), *out], names=["tree", "key", *[f"p{d}" for d in depths]])

    return texts.select("key", "signature").mapInArrow(run, "tree int, key binary, " + ", ".join(f"p{d} bigint" for d in depths))


def _tries(prefixes: DataFrame, depth: int, shortest: int) -> DataFrame:
    """The rows of ``prefixes`` that share their shortest prefix, in trie order, with s<d> int: the texts below the prefix of each length."""
    names = [f"p{d}" for d in range(shortest, depth + 1)]
    sizes = [f"s{d}" for d in range(shortest, depth + 1)]
    huge = np.iinfo(np.int32).max

    def sized(table: pa.Table, hot: bool) -> pa.RecordBatch:
        tree = table["tree"].to_numpy()
        new, out = np.concatenate(([True], tree[1:] != tree[:-1])), []
        for p in names:
            label = table[p].to_numpy()
            new = new | np.concatenate(([True], label[1:] != label[:-1]))
            at = np.flatnonzero(new)
            n = np.diff(np.concatenate((at, [len(tree)])))
            out.append(np.full(len(tree), huge, np.int32) if hot else np.repeat(n, n).astype(np.int32))
        whole = table.combine_chunks().to_batches()[0]
        shared = pa.array(out[0] > 1)
        return pa.RecordBatch.from_arrays([*whole.columns, *[pa.array(x) for x in out]], names=[*whole.schema.names, *sizes]).filter(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        passing = None  # the shortest prefix of a subtree that is not held
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None or not held.num_rows else pa.concat_tables([held, table])
            if held is None or not held.num_rows:
                continue
            tree, label = held["tree"].to_numpy(), held[names[0]].to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | (label[1:] != label[:-1]))))
            first = 0
            if passing == (tree[0], label[0]):
                first = len(tree) if len(cut) == 1 else int(cut[1])
                yield sized(held.slice(0, first), True)
            last = len(tree) if batch is None else int(cut[-1])
            if last > first:
                yield sized(held.slice(first, last - first), False)
            last = max(last, first)
            if batch is not None and len(tree) - last > HELD:
                passing = tree[-1], label[-1]
                yield sized(held.slice(last), True)
                last = len(tree)
            held = held.slice(last)

    schema = "tree int, key binary, " + ", ".join([f"{p} bigint" for p in names] + [f"{x} int" for x in sizes])
    return prefixes.repartition("tree", names[0]).sortWithinPartitions("tree", *names).mapInArrow(run, schema)


def shortened(sizes: np.ndarray, trees: int, threshold: float, target: float, depth: int, shortest: int) -> np.ndarray:
    """Depths at which the given trees (rows of sizes by depth) of one text are matched; its other trees are matched at the shortest prefix.

    Each starts at the shortest prefix with at most SMALL texts, else at the longest; then prefixes are shortened by one,
    the one with the fewest texts first, until the chance to miss a pair at the threshold is within the target.
    """
    few = sizes <= SMALL
    at = np.where(few.any(1), few.argmax(1), depth - shortest)
    miss = lambda d: np.log1p(-(threshold ** (d + shortest)))
    need = math.log(1 - target) - (trees - len(at)) * miss(0)
    while miss(at).sum() > need and at.max() > 0:
        cost = np.where(at > 0, np.take_along_axis(sizes, np.maximum(at - 1, 0)[:, None], 1)[:, 0].astype(np.int64), np.iinfo(np.int64).max)
        at[cost.argmin()] -= 1
    return at + shortest


def _matched(tries: DataFrame, trees: int, threshold: float, target: float, depth: int, shortest: int) -> DataFrame:
    """tree, key, label: the node at which each row is matched."""
    depths = list(range(shortest, depth + 1))
    row = F.struct("tree", F.array(*[f"p{d}" for d in depths]).alias("p"), F.array(*[f"s{d}" for d in depths]).alias("s"))
    hot = tries.groupBy("key").agg(F.max(f"s{shortest}").alias("most"), F.collect_list(row).alias("rows")).where(F.col("most") > SMALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, at, label = [], [], []
            for rows in batch.column(0).to_pylist():
                for r, d in zip(rows, shortened(np.array([r["s"] for r in rows]), trees, threshold, target, depth, shortest).tolist(), strict=True):
                    tree.append(r["tree"])
                    at.append(d)
                    label.append(r["p"][d - shortest])
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(at, pa.int32()), pa.array(label, pa.int64())], names=["tree", "depth", "label"])

    wanted = materialise(hot.select("rows").mapInArrow(run, "tree int, depth int, label bigint").where(F.col("depth") < depth).distinct(), "nodes")
    rest = tries.where(F.col(f"s{shortest}") <= SMALL).select("tree", "key", F.col(f"p{shortest}").alias("label"))
    out = tries.where(F.col(f"s{shortest}") > SMALL)
    # A node that one text wants is matched for all texts below it: the shortest wanted prefix counts, else the longest of all.
    for d in depths[:-1]:
        own = wanted.where(F.col("depth") == d).select("tree", F.col("label").alias(f"p{d}"), F.lit(True).alias(f"w{d}"))
        out = out.join(own, ["tree", f"p{d}"], "left")
    label = F.coalesce(*[F.when(F.col(f"w{d}"), F.col(f"p{d}")) for d in depths[:-1]], F.col(f"p{depth}"))
    return rest.union(out.select("tree", "key", label.alias("label")))


def _shingles(texts: DataFrame, words: int) -> DataFrame:
    """key, shingles array<long> (sorted, distinct) of texts(key, __text)."""

    def run(batches):
        for batch in batches:
            for lo, hi, texts in text_chunks(batch.column(1)):
                grams, first = Words(texts).grams(words)
                sets = [np.unique(grams[first[i] : first[i + 1]].view(np.int64)) for i in range(hi - lo)]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["key", "shingles"])

    return texts.mapInArrow(run, "key binary, shingles array<bigint>")


def spanning(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in pairs:
        p, q = find(i), find(j)
        if p != q:
            root[p] = q
            out.append((i, j))
    return out


def _overlaps(values: np.ndarray, offsets: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets."""
    if len(pairs) < 200:
        sets = {i: values[offsets[i] : offsets[i + 1]] for i in np.unique(pairs)}
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    n = len(offsets) - 1
    _, column, seen = np.unique(values, return_inverse=True, return_counts=True)
    use = seen[column] > 1
    row = np.repeat(np.arange(n), np.diff(offsets))[use]
    _, column = np.unique(column[use], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((n, n), np.float32)
    width = 1 << 13
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        block = np.zeros((n, width), np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        total += block @ block.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _verify(cells: DataFrame, threshold: float) -> DataFrame:
    """For each cell: (a, null, links) by text that has links, (a, b, 0) for the edges of a spanning forest."""

    def cell(table: pa.Table) -> Iterator[pa.RecordBatch] | None:
        n = table.num_rows
        if n < 2:
            return
        labels = lists_of(table["labels"])[0].reshape(n, -1)
        tree = table["tree"][0].as_py()
        block = table["block"].to_numpy()
        i, j = np.triu_indices(n, 1)
        if table["cell_a"][0] != table["cell_b"][0]:
            cross = block[i] != block[j]
            i, j = i[cross], j[cross]
        meets = labels[i, tree] == labels[j, tree]
        for t in range(tree):
            meets &= labels[i, t] != labels[j, t]
        size = table["n_shingles"].to_numpy()
        # The smaller set cannot hold more of the larger one than its own size.
        meets &= np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        pairs = np.stack((i[meets], j[meets]), 1)
        if not len(pairs):
            return
        values, offsets = lists_of(table["shingles"])
        both = _overlaps(values, offsets, pairs)
        alike = both >= threshold * (size[pairs[:, 0]] + size[pairs[:, 1]] - both) - 1e-9
        pairs = pairs[alike]
        if not len(pairs):
            return
        copies = table["copies"].to_numpy()
        links = np.zeros(n, np.int64)
        np.add.at(links, pairs[:, 0], copies[pairs[:, 1]])
        np.add.at(links, pairs[:, 1], copies[pairs[:, 0]])
        key = table["key"].to_pylist()
        hit = np.flatnonzero(links)
        tied = spanning(n, pairs.tolist())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key[x] for x in hit] + [key[x] for x, _ in tied], pa.binary()),
                pa.array([None] * len(hit) + [key[y] for _, y in tied], pa.binary()),
                pa.array(links[hit].tolist() + [0] * len(tied), pa.int64()),
            ],
            names=["a", "b", "links"],
        )

    keys = ["tree", "label", "cell_a", "cell_b"]
    sorted_cells = cells.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_cells.mapInArrow(lambda batches: by_group(batches, keys, cell), "a binary, b binary, links bigint")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5, trees: int = 16, target: float = 0.999, max_depth: int = 6) -> DataFrame:
    """One row for each row of ``docs``: id_col, class_id, n_links long.

    Texts are linked when their sets of ``words``-word shingles (lower case,
    punctuation ignored; all words if fewer) have a Jaccard similarity of at
    least ``threshold``. class_id is the least id of the connected group; n_links
    counts linked rows, copies included. Copies of a text are one node until the
    end. Null, empty and wordless texts are linked with nothing and have their own
    id as class. Rows with a null id take part and give it no class. Rows that
    repeat an id are copies, or, with other texts, nodes of their own. An empty table gives no rows. A very long text
    counts with all its shingles. Other columns are neither read nor returned, whatever their names.
    """
    shortest = max(1, min(forest_depth(threshold, trees, target, max_depth) - 1, max_depth))
    sig = materialise(signatures(docs.select(F.col(id_col).alias("__id"), F.col(text_col)), text_col, ["__id"], words, trees, max_depth), "signatures")
    some = sig.where("n_shingles > 0")
    texts = materialise(some.groupBy("key").agg(F.min("__id").alias("first_id"), F.count("*").alias("copies"), F.first("signature").alias("signature")), "texts")
    tries = materialise(_tries(_prefixes(texts, trees, max_depth, shortest), max_depth, shortest), "tries")
    nodes = _matched(tries, trees, threshold, target, max_depth, shortest)
    shared = nodes.groupBy("tree", "label").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(nodes.join(shared, ["tree", "label"]), "members")
    wanted = members.select("key").distinct()
    with_text = docs.select(F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key"), F.col(text_col).alias("__text"))
    held = _shingles(with_text.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("__text").alias("__text")), words)
    held = materialise(held.withColumn("n_shingles", F.size("shingles")), "shingles")
    weight = members.join(held.select("key", "n_shingles"), "key")
    load = weight.groupBy("tree", "label").agg(F.sum("n_shingles").alias("load"), F.max("n").alias("n"))
    load = load.select("tree", "label", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("load") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    spread = members.drop("n").join(load, ["tree", "label"]).withColumn("block", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = spread.select("key", "tree", "label", "block", F.least("block", "other").alias("cell_a"), F.greatest("block", "other").alias("cell_b"))
    # The node of each tree, to tell where a pair meets first; a text alone in a tree has a label of its own there.
    place = F.map_from_entries(F.collect_list(F.struct("tree", "label")))
    labels = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("at", t), F.xxhash64("key", t)))
    placed = members.groupBy("key").agg(place.alias("at")).select("key", labels.alias("labels"))
    cells = cells.join(texts.select("key", "copies"), "key").join(placed, "key").join(held, "key")
    found = materialise(_verify(cells, threshold), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("others"))
    groups = connected_components(found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = texts.select("key", "first_id", "copies").join(groups.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    placed = placed.withColumn("component", F.coalesce("component", "key"))
    least = placed.groupBy("component").agg(F.min("first_id").alias("class_id"))
    placed = placed.join(least, "component").select("key", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = sig.select("__id", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key")).join(placed, "key", "left")
    return out.select(F.col("__id").alias(id_col), F.coalesce("class_id", "__id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
