"""Trie of conversation prefixes, rolled up by pointer jumping.

A node is a distinct sequence of first turns. Its key is a digest of that sequence: each turn and its place give four numbers of 32 bits (of a SHA-256 of role and text),
whose running sums and depth are the digest, so that a prefix's key needs no chain of hashes, a parent's key is a
difference, and a conversation of any length can be cut in ranges. Every node has one edge, to its parent's key.

Subtree sums take logarithmically many rounds: after round k a node knows the sum over its descendants of less than 2^k levels below and the
key of its ancestor 2^k levels above, to which it sends that sum; then each ancestor's own ancestor becomes the new target.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trivane.llm.common import discard, materialise

#: Rows of a range of the order, and ids joined to one text at most.
ROWS, IDS = 1 << 18, 1 << 13
LANES = ["s0", "s1", "s2", "s3"]


def _ranges(df: DataFrame) -> int:
    """Ranges for an order over ``df``, of about ROWS rows or less."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))


def ordered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, rank long (from 1), turn_digest string, bytes long: the turns of each conversation in the order of turn (null first), role, text.

    Null role and text become empty; rows without a conversation are left out; rows that repeat are turns of their own. Conversations are
    dealt to ranges of the whole order and not to tasks by key, so that one of any length is sorted by many tasks.
    """
    clean = rows.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    dealt = clean.repartitionByRange(_ranges(clean), *order).sortWithinPartitions(*order)
    place = dealt.select(
        "conv", F.spark_partition_id().alias("cut"), F.monotonically_increasing_id().alias("place"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("turn_digest"), F.octet_length("text").cast("long").alias("bytes"),
    )
    place = materialise(place, "turns")
    begun = place.groupBy("conv", "cut").agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    before = begun.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    return place.join(before.select("conv", "cut", "begin", "before"), ["conv", "cut"]).select("conv", "cut", (F.col("place") - F.col("begin") + F.col("before") + 1).alias("rank"), "turn_digest", "bytes")


def _lanes(digest: Column, rank: Column) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(digest, rank, F.lit(i)), 32).alias(c) for i, c in enumerate(LANES)]


def _key(depth: Column, sums: list[Column]) -> Column:
    """16 bytes that name a prefix of ``depth`` turns."""
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def _add(sums: list[str], offsets: list[str]) -> list[Column]:
    return [(F.col(a) + F.coalesce(F.col(b), F.lit(0).cast("long"))) for a, b in zip(sums, offsets, strict=True)]


def shared_openings(turns: DataFrame, group: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """(convs: conv, n_turns; rebuilt: conv, depth, cut, turn_digest, bytes): the first h turns of conversation c - c % group, then c's own after its first h.

    h is the unsigned CRC-32 of c's decimal digits, modulo ``modulus``; an opening thus has fewer than ``modulus`` turns, and
    at most ``group`` conversations of one sign take it. ``turns`` is what ordered_turns() gives.
    """
    own = turns.groupBy("conv").agg(F.count("*").alias("n_own"))
    opening = turns.where(F.col("rank") < modulus)
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % modulus
    asked = own.select("conv", "n_own", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    of_base = own.select(F.col("conv").alias("base"), F.col("n_own").alias("n_base"))
    convs = asked.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    first = convs.where("taken > 0").join(opening.select(F.col("conv").alias("base"), "rank", "turn_digest", "bytes"), "base").where("rank <= taken")
    first = first.select("conv", F.col("rank").alias("depth"), F.lit(-1).alias("cut"), "turn_digest", "bytes")
    # Both sides come from one table: rows of the long side are joined by conversation, of which the short side has one row.
    later = turns.join(convs.where("n_own > h").select("conv", "h", "taken"), "conv").where("rank > h")
    later = later.select("conv", (F.col("rank") - F.col("h") + F.col("taken")).alias("depth"), "cut", "turn_digest", "bytes")
    sizes = convs.select("conv", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"))
    return sizes, first.unionByName(later)


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, key, parent, bytes for each turn of conv, depth, cut, turn_digest, bytes; cuts of a conversation are in the order of their depths."""
    tagged = turns.select("conv", "depth", "cut", "bytes", *_lanes(F.col("turn_digest"), F.col("depth")))
    within = Window.partitionBy("conv", "cut").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumns({f"r{c}": F.sum(c).over(within) for c in LANES})
    totals = tagged.groupBy("conv", "cut").agg(*[F.sum(c).alias(f"t{c}") for c in LANES])
    earlier = Window.partitionBy("conv").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "cut", *[F.sum(f"t{c}").over(earlier).alias(f"o{c}") for c in LANES])
    whole = local.join(totals, ["conv", "cut"])
    sums = _add([f"r{c}" for c in LANES], [f"o{c}" for c in LANES])
    before = [s - F.col(c) for s, c in zip(sums, LANES, strict=True)]
    return whole.select("conv", "depth", "bytes", _key(F.col("depth"), sums).alias("key"), _key(F.col("depth") - 1, before).alias("parent"))


def _ids_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the ascending ids of each key, joined by commas, for ends(key, conv).

    Ids are sorted in ranges of the whole order and joined there, up to IDS a text. A key with more than one text is
    hashed text by text, in order, by one task that holds nothing but the state of the hash.
    """
    dealt = ends.repartitionByRange(_ranges(ends), "key", "conv").sortWithinPartitions("key", "conv").select("key", F.col("conv").cast("string").alias("conv"), F.monotonically_increasing_id().alias("place"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, out = None, 0, [], []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["key", "place", "ids"])

        for batch in batches:
            for k, c, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if ids and (k != key or len(ids) == IDS):
                    out.append((key, first, ",".join(ids)))
                    ids = []
                if not ids:
                    key, first = k, p
                ids.append(c)
            if len(out) >= 256:
                yield flush()
        if ids:
            out.append((key, first, ",".join(ids)))
        if out:
            yield flush()

    texts = materialise(dealt.mapInArrow(join, "key binary, place long, ids string"), "ends")
    several = texts.groupBy("key").agg(F.count("*").alias("n"))
    marked = texts.join(several, "key")
    single = marked.where("n = 1").select("key", F.sha2("ids", 256).alias("ends_sha256"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        yield done()
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield done()

    long = marked.where("n > 1").repartition("key").sortWithinPartitions("key", "place").select("key", "ids").mapInArrow(chain, "key binary, ends_sha256 string")
    return single.unionByName(long)


def roll_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """key and ``values``, each now summed over the node's subtree, for nodes(key, parent, depth, values) of trees; a root has depth 0.

    One round for each doubling of the distance; rounds = log2 of the depth. Sums are combined before they travel; a hot
    ancestor is one row of the small side of a join, whose other side Spark can split. Nodes whose next target is above the root take no part in a join.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    state = nodes.select("key", F.when(F.col("depth") > 0, F.col("parent")).alias("jump"), "depth", *values)
    step, last = 1, None
    while step <= deepest:
        sent = state.where(F.col("depth") >= step).groupBy(F.col("jump").alias("key")).agg(*[F.sum(v).alias(f"got_{v}") for v in values])
        summed = state.join(sent, "key", "left").select("key", "jump", "depth", *[(F.col(v) + F.coalesce(f"got_{v}", F.lit(0).cast("long"))).alias(v) for v in values])
        if 2 * step <= deepest:
            far = summed.where(F.col("depth") >= 2 * step).join(state.select(F.col("key").alias("jump"), F.col("jump").alias("next")), "jump").select("key", F.col("next").alias("jump"), "depth", *values)
            summed = far.unionByName(summed.where(F.col("depth") < 2 * step).withColumn("jump", F.lit(None).cast("binary")))
        state = materialise(summed.select("key", "jump", "depth", *values), "rollup")
        if last is not None:
            discard(last)
        step, last = 2 * step, state
    return state.select("key", *values)


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens long, ends_sha256 string.

    convs(conv, n_turns) are the members of the root, turns(conv, depth, cut, turn_digest, bytes) their turns. conv_id is the smallest member and names the node together with
    depth; n_leaves counts the childless nodes of the subtree; saved_tokens sums (n_convs - 1) times the UTF-8 bytes of the last text over it; ends_sha256 is of the
    members that have no further turn. Without conversations there is no node.
    """
    members = materialise(_prefixes(turns), "prefixes")
    root = _key(F.lit(0), [F.lit(0)] * 4)
    inner = members.groupBy("key").agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    top = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(root.alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes"))
    nodes = materialise(inner.unionByName(top), "nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    known = nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    known = materialise(known.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}), "nodes")
    sums = roll_up(known, ["n_leaves", "saved_tokens"])
    last = members.join(convs.select("conv", F.col("n_turns").alias("depth")), ["conv", "depth"]).select("key", "conv").unionByName(convs.where("n_turns = 0").select(root.alias("key"), "conv"))
    ends = _ids_digests(last)
    above = known.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = known.drop("n_leaves", "saved_tokens").join(sums, "key").join(ends, "key", "left").join(above, "parent", "left")
    none = F.sha2(F.lit(""), 256)
    return out.select(
        F.col("conv_id").cast("long").alias("conv_id"), "depth", F.col("parent_conv_id").cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def shared_prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 5, modulus: int = 9) -> DataFrame:
    """prefix_trie() of the conversations in ``rows`` after shared_openings(); ids are integers.

    Ties of turn are ordered by role and text; repeated rows are repeated turns; very long texts travel once and are a digest from there; other columns
    of ``rows`` are not read, whatever their names; empty tables give no rows.
    """
    turns = materialise(ordered_turns(rows, conv, turn, role, text), "ranks")
    convs, rebuilt = shared_openings(turns, group, modulus)
    convs = materialise(convs, "convs")
    return prefix_trie(convs, rebuilt)
