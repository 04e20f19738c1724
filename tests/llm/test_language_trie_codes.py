"""Operators 11 to 13 against their definitions in plain Python, their edge cases, and their queries against SQL or held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, connect
from trivane.llm import ppm, prefix_trie, queries, vector_codes

# ---- 11 language identification ----------------------------------------------------------


def plain_trees(raw, order):
    """context bytes -> counts of the next byte, for all texts."""
    out = defaultdict(Counter)
    for r in raw:
        data = bytes(order) + r
        for i in range(order, len(data)):
            for k in range(order + 1):
                out[data[i - k : i]][data[i]] += 1
    return out


def plain_cost(trees, context, byte):
    """Nats of ``byte`` after ``context`` by the definition: escape method C with exclusions."""
    total, excluded = 0.0, set()
    for k in range(len(context), -1, -1):
        seen = trees.get(context[len(context) - k :])
        if not seen:
            continue
        n = sum(c for b, c in seen.items() if b not in excluded) + len(seen)
        if byte in seen:
            return total + math.log(n / seen[byte])
        total += math.log(n / len(seen))
        excluded = set(seen)
    return total + math.log(256 - len(excluded))


def trees_of(texts_by_language, order):
    counts = []
    for texts in texts_by_language.values():
        grams = [Counter() for _ in range(order + 1)]
        for t in texts:
            data = bytes(order) + ppm.fold(t)
            for i in range(order, len(data)):
                for k in range(1, order + 2):
                    grams[k - 1][int.from_bytes(data[i + 1 - k : i + 1], "big")] += 1
        counts.append([(np.array(sorted(g), np.uint64), np.array([g[x] for x in sorted(g)], float)) for g in grams])
    return ppm.Trees(list(texts_by_language), counts, order)


def small_languages(seed=0):
    rng = random.Random(seed)
    return {name: [" ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 30))) for _ in range(12)] for name, letters in (("aa", "abcde é"), ("bb", "cdefgß"))}


@pytest.mark.parametrize("order", [1, 2, 4])
def test_code_lengths_by_the_definition(order):
    learnt = small_languages()
    trees = trees_of(learnt, order)
    plain = [plain_trees([ppm.fold(t) for t in texts], order) for texts in learnt.values()]
    texts = ["", "abc cde", "éßxyz 12", "a" * 300, "ccc ddd éé", *learnt["aa"][:3], *learnt["bb"][:3]]
    got = trees.code_lengths([ppm.fold(t) for t in texts])
    for t, row in zip(texts, got, strict=True):
        data = bytes(order) + ppm.fold(t)
        for tree, cost in zip(plain, row, strict=True):
            assert cost / ppm.UNIT == pytest.approx(sum(plain_cost(tree, data[i - order : i], data[i]) for i in range(order, len(data))), abs=1e-4 * (1 + len(data)))


def test_probabilities_of_a_context_sum_to_one():
    learnt = small_languages(3)
    trees = trees_of(learnt, 3)
    for before in (b"\0\0\0", b"abc", b"cde", b"zzz", b"a d"):
        keys = np.array([int.from_bytes(before + bytes([b]), "big") for b in range(256)], np.uint64)
        assert np.exp(-trees._lookup(keys, 4) / ppm.UNIT).sum(0) == pytest.approx([1, 1], abs=1e-3)


def test_tables_find_every_key_and_no_other():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    table = ppm.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    other = rng.integers(0, 1 << 40, 5000).astype(np.uint64)
    assert (table.find(other) == ppm._at(keys, other)).all()
    assert (ppm.Table(keys[:0]).find(other) == -1).all()


def test_learnt_counts_are_those_of_all_training_texts(spark):
    learnt = small_languages(5)
    rows = [(i, t, name) for i, (name, t) in enumerate((n, t) for n, texts in learnt.items() for t in texts)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "no language", None)], "doc_id long, text string, lang string")
    mine = ppm.learn(docs, params=ppm.PpmParams(order=2))
    kept = {n: [t for i, t, name in rows if name == n and zlib.crc32(str(i).encode()) % 4 != 2] for n in learnt}
    expected = trees_of(kept, 2)
    probe = [ppm.fold(t) for t in ["abc de", "ßß cde fg", "xyz"]]
    assert mine.languages == ["aa", "bb"] and (mine.code_lengths(probe) == expected.code_lengths(probe)).all()


def test_bounded_trees_keep_every_suffix(spark):
    texts = [" ".join(t) for t in small_languages(7).values()]
    docs = spark.createDataFrame([(i, texts[i % 2], "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    trees = ppm.learn(docs, params=ppm.PpmParams(order=3, strings=300))
    assert sum(len(c) for c in trees.costs[1:]) <= 2 * 300
    before = np.array([int.from_bytes(b"abc" + bytes([b]), "big") for b in range(256)], np.uint64)
    assert np.exp(-trees._lookup(before, 4) / ppm.UNIT).sum(0) == pytest.approx([1, 1], abs=1e-3)


def test_language_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs = queries._read(spark, d, "documents")
    rows = queries.op11_language_id(spark, d).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    flipped = docs.withColumn("lang", F.when(ppm.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    again = {r.doc_id: (r.lang_pred, r.score) for r in ppm.languages(docs, ppm.learn(flipped)).collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in rows}


def test_language_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !? 😀", "en"), (4, "the words " * 60_000, "en"), (8, "les mots et la phrase", "fr"), (8, "les mots et la phrase", "fr"), (None, "the words", "en"), (6, "les mots", None)]
    docs = spark.createDataFrame([(*r, "x", 0.5, True) for r in rows], "doc_id int, text string, lang string, lang_pred string, score double, held_out boolean")
    out = ppm.languages(docs, ppm.learn(docs)).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append((r.lang_pred, r.score))
    assert len(out) == len(rows) and by[1] == by[2] == by[3] == [("und", 0.0)]
    assert by[4][0][0] == "en" == by[None][0][0] and by[8][0] == by[8][1] and by[8][0][0] == "fr"
    empty = ppm.learn(docs.where("false"))
    assert empty.languages == [] and {r.lang_pred for r in ppm.languages(docs, empty).collect()} == {"und"}
    assert ppm.languages(docs.where("false"), ppm.learn(docs)).count() == 0
    assert ppm.languages(docs.withColumn("doc_id", F.col("doc_id").cast("string")), ppm.learn(docs)).count() == len(rows)


# ---- 12 conversation prefix trie -----------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, cs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        childless = [n for n in under if not any(m[:-1] == n for m in members if m)]
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(rebuilt[c]) == len(node)))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(1 for m in members if m and m[:-1] == node), len(childless), sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def random_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-12, 60), 40):
        n = rng.choice([1, 2, 3, 3, 5, 9, 12, 40])
        rows += [(c, rng.choice([None, t, t, t]), rng.choice(["user", "user", "a", None]), rng.choice(["hi", "hé", "", None, "x" * 9])) for t in range(n)]
    return rows


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_trie_by_the_definition(seed, spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ROWS", 16)  # so that ranges cut conversations
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    rows = random_conversations(seed)
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert trie_rows(prefix_trie.shared_prefix_trie(df)) == plain_trie(rows)


def test_trie_of_many_copies_and_one_deep_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 8)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 300) for t in range(3)] + [(1001, t, "user", f"turn {t % 7}") for t in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie_rows(prefix_trie.shared_prefix_trie(df)) == plain_trie(rows)


def test_trie_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string, depth string, parent string, key string, h string, n_own string"
    rows = [(1, 0, "user", "word " * 50_000), (1, 0, "user", "word " * 50_000), (None, 0, "user", "x"), (7, None, None, None), (3, 1, "ab", "c"), (4, 1, "a", "bc")]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], schema)
    assert trie_rows(prefix_trie.shared_prefix_trie(df)) == plain_trie(rows)
    assert prefix_trie.shared_prefix_trie(df.where("false")).count() == 0


def test_roll_up_by_doubling(spark):
    rng = random.Random(4)
    parent = {0: None}
    for i in range(1, 200):
        parent[i] = rng.choice([i - 1, i - 1, i - 1, rng.randrange(i)])
    depth = {0: 0}
    for i in range(1, 200):
        depth[i] = depth[parent[i]] + 1
    key = lambda i: None if i is None else bytearray(f"{i:04d}".encode())
    df = spark.createDataFrame([(key(i), key(p), depth[i], i * i) for i, p in parent.items()], "key binary, parent binary, depth long, v long")
    total = {i: i * i for i in parent}
    for i in range(199, 0, -1):
        total[parent[i]] += total[i]
    assert {int(r["key"].decode()): r["v"] for r in prefix_trie.roll_up(df, ["v"]).collect()} == total


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_vector_codes"])
def test_queries_same_as_sql(name, spark):
    d = "/root/testdata/sf0.01"
    assert_same(queries.QUERIES[name](spark, d), connect(d), queries.ORACLES[name])


# ---- 13 vector codes -----------------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """rows(vec_id, vector, label) with whole lists of finite numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    seeds = sorted({i: v for i, v, _ in sorted(kept, key=lambda r: (r[0], r[1]), reverse=True)}.items())[:entries]
    books = [[v[p * w : (p + 1) * w] for _, v in seeds] for p in range(parts)]

    def near():
        out = []
        for _, v, _ in kept:
            own = []
            for p in range(parts):
                x = v[p * w : (p + 1) * w]
                own.append(min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p])))
            out.append(own)
        return out

    for _ in range(rounds):
        got = near()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p * w : (p + 1) * w] for (_, v, _), own in zip(kept, got, strict=True) if own[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    got = near()
    return sorted((i, "".join(f"{e:02x}" for _, e in own), sum(d for d, _ in own)) for (i, _, _), own in zip(kept, got, strict=True)), books


@pytest.mark.parametrize("seed,scale", [(0, 1.0), (1, 0.004), (2, 3000.0)])
def test_codes_by_the_definition(seed, scale, spark):
    """A small scale makes ties, a large one sums beyond doubles."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(12)] for _ in range(9)]
    rows = [(i if i % 11 else i // 11, [float(np.float32(c + rng.gauss(0, scale / 4))) for c in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(160)]
    rows += [(900, None, 1), (901, [None] * 12, 1), (902, [math.nan] * 12, 2), (903, [math.inf] + [0.0] * 11, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    codes, books = vector_codes.product_codes(df, params=vector_codes.CodeParams(entries=24))
    expected, plain_books = plain_codes(rows, entries=24)
    assert sorted((r.vec_id, r.code, r.error) for r in codes.collect()) == expected
    assert [b.tolist() for b in books] == plain_books


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (20, 8))
    x = centres[rng.integers(0, 20, 3000)] + rng.integers(-30, 30, (3000, 8))
    book, before = x[:20].copy(), None
    code = upper = lower = None
    scans = []
    for _ in range(5):
        code, upper, lower, n = vector_codes.assign(x, vector_codes.Moves.of(book, before), code, upper, lower)
        scans.append(n)
        assert (code == vector_codes._squared(x, book).argmin(1)).all()
        before, book = book, np.array([x[code == e].sum(0) // max((code == e).sum(), 1) if (code == e).any() else book[e] for e in range(20)])
    assert scans[0] == 3000 and sum(scans[1:]) < 0.5 * 4 * 3000


def test_large_components_are_exact():
    x = np.array([[vector_codes.limit(2), 0], [0, 3], [-vector_codes.limit(2), 7]], np.int64)
    assert vector_codes._squared(x, x).tolist() == [[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in x.tolist()] for p in x.tolist()]


def test_codes_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, error string, x string, v string"
    rows = [(5, [1.0] * 4, None), (5, [1.0] * 4, None), (None, [2.0] * 4, 1), (6, [1.0] * 3, 1), (7, [], 1), (8, [1e30] * 4, 2)]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema)
    codes, books = vector_codes.product_codes(df)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.with_label_errors(codes).collect()), key=str)
    assert [len(b) for b in books] == [2] * 4 and len(got) == len(rows)
    assert got[0][:3] == got[1][:3] and got[0][1] == "00000000" and [g[1] for g in got if g[0] in (6, 7)] == [None, None]
    none, books = vector_codes.product_codes(df.where("false"))
    assert none.count() == 0 and books == [] and vector_codes.codebooks_digest(books) == hashlib.sha256(b"").hexdigest()
