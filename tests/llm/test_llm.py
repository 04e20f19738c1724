"""Each operator against brute force on small tables, its edge cases, and its query against SQL where there is any."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import assert_same, connect
from trivane.llm import chat, common, decontaminate, fuzzy_lines, html_text, jaccard, line_hash, pieces, quality_gbt, queries, suffix, weak_rules, wordhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class_id string, spans string, ids string"


def docs_of(spark, texts, first=0):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null and empty texts, a very long line, repeated rows, ties, control and astral characters."""
    long = "word " * 30_000
    rows = [(1, None), (2, ""), (None, "a null id has a text of some words here"), (3, "   \n\n\t"), (4, long), (5, "é😀\u0000x ▁ <s> [INST]\\"), (6, "same words again and again in this line\nb"), (6, "same words again and again in this line\nb"), (7, "same words again and again in this line\nb")]
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in rows], SCHEMA)


def sample(n=160, seed=0):
    """Texts with exact copies, near copies, shared lines and repeats."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)] + ["the", "of", "and"] * 40
    lines = [" ".join(rng.choices(vocab, k=rng.randint(6, 30))) for _ in range(40)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.4:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randint(1, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        else:
            own = [" ".join(rng.choices(vocab, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
            out.append("\n".join(own + rng.choices(lines, k=rng.randint(0, 2))))
    return out


# ---- 1 chat formatting ---------------------------------------------------------------


def test_chat_layouts_by_fingerprint(spark):
    lines = [
        '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}',
        '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": null}]}',
        '{"instruction": "do", "input": "this", "output": "done"}', '{"instruction": "do", "output": "done"}', '{"prompt": "p", "completion": "c"}', '{"system": "s", "prompt": "p", "response": "r"}',
        '{"data": {"prompt": "p", "response": "r"}}', '{"other": 1}', "no json",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    records = chat.read_json_records(df)
    out = chat.format_chats(chat.to_turns(records, [c for c in records.columns if c != "i"])).orderBy("i").collect()
    turns = [[tuple(t) for t in r.turns] for r in out]
    assert turns[0] == [("user", "hi"), ("assistant", "yo")] and turns[1] == [("user", "hi"), ("assistant", "")]
    assert turns[2] == [("user", "do\n\nthis"), ("assistant", "done")] and turns[3] == [("user", "do"), ("assistant", "done")]
    assert turns[5] == [("system", "s"), ("user", "p"), ("assistant", "r")] and turns[6] == [("user", "p"), ("assistant", "r")]
    assert [r.layout for r in out][-2:] == [None, None] and turns[-1] == [] and out[-1].formatted == ""


def test_chat_round_trip_and_mask(spark):
    rng = random.Random(0)
    bits = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "<n>", "\n", "n", "<", "/", "é😀", " "]
    rows = [(i, [(rng.choice(["user", "assistant", "system", "a\nb", "\\", ""]), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for _ in range(rng.randint(0, 5))]) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, turns array<struct<role: string, text: string>>")
    for r in chat.format_chats(df).select("turns", chat.parse_chats(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect():
        assert r.turns == r.back
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")


def test_chat_nulls_ties_and_no_rows(spark):
    rows = spark.createDataFrame([(1, 0, None, None), (1, 0, "user", "b"), (1, None, "user", "a"), (None, 1, "user", "x")], "c long, t long, r string, x string")
    got = {r.conv_id: [tuple(t)[1:] for t in r.turns] for r in chat.turns_from_rows(rows, "c", "t", "r", "x").collect()}
    assert got == {1: [("user", "a"), ("", ""), ("user", "b")], None: [("user", "x")]}
    assert chat.turns_from_rows(rows.where("false"), "c", "t", "r", "x").count() == 0


def test_chat_long_texts_clashing_names_and_no_rows(spark):
    long = "word </s> " * 40_000
    df = spark.createDataFrame([(1, [("user", "q"), ("assistant", long)], "old", "old"), (1, [("user", "q"), ("assistant", long)], "old", "old"), (2, None, "old", "old")], "i int, turns array<struct<role: string, text: string>>, segments string, formatted string")
    out = chat.format_chats(df).select("i", chat.parse_chats(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).orderBy("i").collect()
    assert [r.loss for r in out[:2]] == [long, long] and out[0].back[1].text == long and len(out) == 3
    assert chat.format_chats(df.where("false")).count() == 0 == chat.to_turns(df.where("false"), ["turns"]).count()


# ---- 2 quality classifier --------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op2_quality_classifier(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


def test_classifier_uses_no_label_of_the_held_out_fold(spark):
    texts = sample(60, 5)
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(quality_gbt.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_gbt.quality_scores(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_classifier_edge_cases(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_gbt.quality_scores(odd, none).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_gbt.quality_scores(odd.where("false"), none).count() == 0


def test_classifier_with_repeated_ids_and_a_long_text(spark):
    """More rows than may be learnt from, each id twice: both classes stay."""
    texts = sample(80, 6) + ["long words of a text " * 20_000]
    docs = docs_of(spark, texts).union(docs_of(spark, texts))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(81)], "doc_id long, quality int")
    x, y = quality_gbt.labelled_statistics(docs, labels, "doc_id", "text", "quality", quality_gbt.Params(rows=60))
    assert len(y) == 60 and 0 < y.sum() < 60
    out = quality_gbt.quality_scores(docs, labels, params=quality_gbt.Params(rows=60, trees=5)).collect()
    assert len(out) == 162 and all(0 <= r.score <= 1 for r in out)


def test_statistics_by_plain_counts():
    texts = ["", None, "One two, two.\nThree!\n\nOne two, two.", "AAAA bbbb 1234 ###"]
    x = quality_gbt.statistics(texts)
    assert x.shape == (4, len(quality_gbt.STATISTICS)) and np.isfinite(x).all() and (x[0] == x[1]).all()
    again = quality_gbt.statistics(texts[2:] + texts[:2])
    assert (np.vstack((again[2:], again[:2])) == x).all()


def test_flat_trees_equal_plain_descent():
    rng = np.random.default_rng(0)
    x = rng.random((500, len(quality_gbt.STATISTICS)))
    y = (x[:, 0] + 0.2 * rng.random(500) > 0.6).astype(float)
    f = quality_gbt.train(x, y, quality_gbt.Params(trees=12))

    def one(row):
        total = f.base
        for node in f.roots:
            while f.feature[node] >= 0:
                node = f.left[node] + int(row[f.feature[node]] > f.threshold[node])
            total += f.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x), [one(r) for r in x]) and ((f.score(x) > 0.5) == y).mean() > 0.9


# ---- 3 decontamination -----------------------------------------------------------------


def sellers(item, text):
    col, best = list(range(len(item) + 1)), len(item)
    for w in text:
        last, col = col, [0]
        for i in range(len(item)):
            col.append(min(last[i] + (item[i] != w), last[i + 1] + 1, col[i] + 1))
        best = min(best, col[-1])
    return best


def test_items_by_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 60
    items = [" ".join(rng.choices(vocab, k=k)) for k in (1, 3, 5, 6, 8, 12, 20, 30, 45, 45) for _ in range(2)] + ["", "!!!"]
    texts = []
    for _ in range(250):
        w = rng.choices(vocab, k=rng.randint(0, 120))
        if rng.random() < 0.7:
            it = rng.choice(items).split()
            for _ in range(rng.randint(0, len(it) // 5 + 1)):
                if it:
                    j = rng.randrange(len(it))
                    it[j : j + rng.randint(0, 1)] = rng.choices(vocab, k=rng.randint(0, 2))
            j = rng.randint(0, len(w))
            w[j:j] = it
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else ", ".join(w))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    found = decontaminate.find_items(docs_of(spark, texts), bench).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in found}
    expected = {}
    for a, t in enumerate(texts):
        w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t.lower())
        for b, i in enumerate(items):
            it = i.split() if i != "!!!" else []
            if it and (e := sellers(it, w)) <= int(0.2 * len(it) + 1e-9):
                expected[a, b] = e
    assert all(expected.get(k) == e for k, e in got.items()) and len(got) >= 0.99 * len(expected) > 50
    for r in found:
        part = re.findall(r"\w+", texts[r.doc_id].lower()[r.start : r.end])
        assert abs(len(part) - r.n_words) <= r.edits


def test_items_at_the_largest_distance_are_found():
    """Recall of the hashes at floor(0.2 n) edits of any kind, for 5 to 200 words."""
    rng = random.Random(22)
    for n in (5, 7, 10, 13, 15, 20, 30, 60, 200):
        items = [" ".join(f"i{k}x{j}" for j in range(n)) for k in range(60)]
        index = decontaminate.Index(list(range(60)), items, decontaminate.Params())
        found = 0
        for k, item in enumerate(items):
            w = item.split()
            for e in range(n // 5):
                j, kind = rng.randrange(len(w)), rng.randrange(3)
                w[j : j + (kind < 2)] = [f"n{k}x{e}"] if kind != 1 else []
            words = wordhash.Words([" ".join([f"a{k}x{j}" for j in range(rng.randint(0, 9))] + w + [f"b{j}" for j in range(30)])])
            found += any(i == k for _, i, *_ in index.search(words.hashes, words.first))
        assert found >= (59 if n >= 10 else 55), (n, found)


def test_items_edge_cases(spark, odd):
    bench = spark.createDataFrame([(1, None), (None, "same words again and again in this line"), (2, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.find_items(odd, bench).collect())
    assert got == [(6, None, 0), (6, None, 0), (7, None, 0)]
    assert decontaminate.find_items(odd, bench.where("false")).count() == 0 and decontaminate.find_items(odd.where("false"), bench).count() == 0


# ---- 4 html ----------------------------------------------------------------------------


PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav class=x><ul><li>One<li>Two</ul></nav>
<div class="cookie-notice">We use cookies <button>OK</button></div><div id="sidebar"><p>Side text of many words here</p></div>
<main><article><h1>A  title&nbsp;here</h1><p>First para&shy;graph with <b>bold</b>
 and <a href="/x">link</a> &lt;tag&gt; &#233; &am stays.</p><script>var a="</p>";</script><div class="advert">Buy now this very good thing for less money today only</div><p>Second one<br>with a break.</p><form><input><p>Sign up</p></form>
<ul><li>item one</li><li>item two</li></ul><table><tr><td>a</td><td>b</td></tr></table><p>Last words.</p></article></main>
<section class="comments"><h3>Comments</h3><p>Nice article, I liked all of it very much</p></section><footer>&copy; me</footer></body></html>"""
TEXT = "A title here First para­graph with bold and link <tag> é &am stays. Second one with a break. item one item two a b Last words."


def test_html_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (3, "v", "", "old"), (4, "w", "<p>just words and no page", "old"), (5, "x", "a < b and <", "old"), (1, "u", PAGE, "old")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_text.extract_text(pages).orderBy("page_id").collect()]
    assert got == [(1, TEXT), (1, TEXT), (2, ""), (3, ""), (4, "just words and no page"), (5, "a < b and <")]
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_html_weights_reproduce_their_pages_and_new_ones_without_names():
    weights = html_text.learn()
    for page in html_text.LABELLED:
        parts = re.split(r"\[\[|\]\]", page)
        text = " ".join(re.sub(r"<[^>]*>", " ", " ".join(parts[1::2])).split())
        assert re.sub(r"\s", "", html_text.main_text("".join(parts), weights)) == re.sub(r"\s", "", text)
    links = "".join(f'<div id=c{k}><a href="/{k}">{w}</a> <a href="/{w}">more {w}</a></div>' for k, w in enumerate(["rain", "wind", "sun", "fog"]))
    body = "<div id=c9><h2>Weather of the week</h2><p>It rained on most days and the wind came from the west all week long.</p><p>Then it stopped.</p><ul><li>two dry days</li></ul><p>The sun came out on Sunday for a few hours before the fog was back.</p></div>"
    page = f"<body>{links}{body}{links}<table><tr><td>page 1</td><td>of 9</td></tr></table></body>"
    expected = "Weather of the week It rained on most days and the wind came from the west all week long. Then it stopped. two dry days The sun came out on Sunday for a few hours before the fog was back."
    assert html_text.main_text(page, weights) == expected
    # The scan decides here: everything that is not cut is more than that.
    rest = " ".join(t.text for t in html_text.tokens(page, weights.marks) if t.kind == "text" and not t.outside)
    assert len(rest.split()) > len(expected.split()) + 10
    assert html_text.main_text("", weights) == html_text.main_text(None, weights) == html_text.main_text(links, weights) == ""
    long = "<p>" + "many words of one very long page " * 20_000 + "</p>"
    assert html_text.main_text(links + long + links, weights).count(" ") == 140_000 - 1


def test_html_pages_of_the_table(spark, sf_dir):
    import html as h

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op4_html_extraction(spark, sf_dir).collect():
        m = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|article|li|div)[^>]*>", m[1])]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_best_run_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = html_text.best_run(s)
        assert sum(s[a:b]) == max([0, *[sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)]])


def test_best_region_by_brute_force():
    def best(s, free, cost):
        top = 0.0
        for i in range(len(s)):
            # Sums of runs from i: the last token is in the run or in a gap.
            run, gap = s[i], None
            top = max(top, run)
            for x, f in zip(s[i + 1 :], free[i + 1 :], strict=True):
                run, gap = max(run + x, -1e9 if gap is None else gap + x), max(run - cost, -1e9 if gap is None else gap) if f else None
                top = max(top, run)
        return top

    rng = random.Random(3)
    for _ in range(400):
        s = [rng.randint(-6, 6) for _ in range(rng.randint(0, 14))]
        free = [rng.random() < 0.6 for _ in s]
        a, b, gaps = html_text.best_region(s, free, 2)
        assert all(a < x < y < b and all(free[x:y]) for x, y in gaps)
        assert sum(s[a:b]) - sum(sum(s[x:y]) + 2 for x, y in gaps) == best(s, free, 2)


def test_html_text_is_decided_by_the_scan(spark, sf_dir, monkeypatch):
    """Pages of the table as they are and with all telling names taken out; without the scan none is right."""
    import html as h

    weights = html_text.learn()
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    nameless = [re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", x).replace(' class="ad"', "") for x in pages]
    expected = []
    for x in pages:
        m = re.search(r"<article>(.*?)(</article>|$)", x, re.S)
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|article|li|div)[^>]*>", m[1])]
        expected.append(" ".join(b for b in blocks if b))
    # Without names nothing tells an article of a dozen words from the lines around it.
    wrong = [e for x, e in zip(nameless, expected, strict=True) if html_text.main_text(x, weights) != e]
    assert len(wrong) <= 0.1 * len(pages) and all(len(e.split()) <= 12 for e in wrong)
    notice = "<main><p>The first part of a text that is long enough.</p><div class=advert><p>Buy these very good things for less money today and only today, all of you.</p></div><p>And the second part.</p></main>"
    assert html_text.main_text(notice, weights) == "The first part of a text that is long enough. And the second part."
    plain = notice.replace("main>", "div>").replace("second part.", "end.")
    assert html_text.main_text(plain, weights) == "The first part of a text that is long enough. And the end."
    monkeypatch.setattr(html_text, "best_region", lambda scores, passable: (0, len(scores), []))
    assert not any(html_text.main_text(x, weights) == e for x, e in zip(pages, expected, strict=True))
    assert "Buy" in html_text.main_text(notice, weights)


# ---- 5 n-gram Jaccard join -------------------------------------------------------------


def shingles(text, k=5):
    w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block, small, held", [(256, 64, 1 << 18), (2, 2, 1 << 18), (256, 3, 10)])
def test_classes_by_brute_force(spark, monkeypatch, block, small, held):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", block)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "HELD", held)
    texts = sample(200, 3)
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    links = collections.Counter(x for p in pairs for x in p)
    assert len(pairs) > 20
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_classes(docs_of(spark, texts)).collect()}
    assert got == {i: (c, links[i]) for i, c in enumerate(components(len(texts), pairs))}


def test_classes_edge_cases(spark, odd):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_classes(odd).collect()), key=str)
    assert got == sorted([(1, 1, 0), (2, 2, 0), (None, None, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 2), (6, 6, 2), (7, 6, 2)], key=str)
    assert jaccard.jaccard_classes(odd.where("false")).count() == 0


def test_prefixes_are_shortened_until_the_target_is_met():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = np.sort(rng.integers(1, 500, (rng.integers(1, 17), 4)), axis=1)[:, ::-1]
        d = jaccard.shortened(sizes, 16, 0.8, 0.999, 6, 3)
        miss = np.prod(1 - 0.8**d) * (1 - 0.8**3) ** (16 - len(d))
        assert miss <= 0.001 and all(3 <= x <= 6 for x in d)
    hot = np.full((16, 4), 10_000)
    d = jaccard.shortened(hot, 16, 0.8, 0.999, 6, 3)
    assert 3 < d.mean() < 6 and jaccard.shortened(hot // 1000, 16, 0.8, 0.999, 6, 3).tolist() == [3] * 16
    # One step less of any tree would miss the target.
    assert all(np.prod(1 - 0.8 ** np.where(np.arange(16) == k, d + 1, d)) > 0.001 for k in np.flatnonzero(d < 6)[-1:])


def test_pairs_at_the_threshold_are_found_in_hot_nodes(spark, monkeypatch):
    """Copies of one text with a few changed words: all trees are hot, and links are found all the same."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    rng = random.Random(30)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(120):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2])):
            w[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    pairs = {(i, j) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_classes(docs_of(spark, texts)).collect()}
    assert sum(got.values()) >= 0.995 * 2 * len(pairs) and len(pairs) > 1000


def test_forest_depth_meets_the_target():
    d = jaccard.forest_depth(0.8, 16, 0.999, 8)
    assert 1 - (1 - 0.8**d) ** 16 >= 0.999 and 1 - (1 - 0.8 ** (d + 1)) ** 16 < 0.999


# ---- 6 line and paragraph hashing ------------------------------------------------------


def test_repeats_by_brute_force(spark):
    texts = sample(120, 7) + ["a b c d e\n\nA  B c d E\nf", "x\na b c d e"]
    seen, expected = set(), []
    for t in texts:
        kept, spans, at = [], [], 0
        for line in t.split("\n"):
            form = " ".join(line.split()).lower()
            if form.count(" ") >= 4 and form in seen:
                spans.append((at, at + len(line)))
            else:
                kept.append(line)
                if form.count(" ") >= 4:
                    seen.add(form)
            at += len(line) + 1
        expected.append((spans, "\n".join(kept)))
    got = [([tuple(s) for s in r.spans], r.kept_text) for r in line_hash.without_repeats(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == expected


def test_repeats_edge_cases_and_paragraphs(spark, odd):
    got = [(r.doc_id, r.kept_text, len(r.spans)) for r in line_hash.without_repeats(odd).collect()]
    assert sorted(got, key=str)[0][1] is not None and {(i, n) for i, _, n in got} >= {(1, 0), (2, 0), (6, 0), (7, 1)}
    assert {t for i, t, _ in got if i == 7} == {"b"} and {t for i, t, _ in got if i == 1} == {""}
    assert line_hash.without_repeats(odd.where("false")).count() == 0
    same = docs_of(spark, ["x", "u v w x y z", "u v w x y z\nown line of some five words"]).withColumn("doc_id", F.when(F.col("doc_id") == 2, 1).otherwise(F.col("doc_id")))
    assert sorted(r.kept_text for r in line_hash.without_repeats(same).collect() if r.doc_id == 1) in (["", "u v w x y z\nown line of some five words"], ["own line of some five words", "u v w x y z"])
    two = docs_of(spark, ["p one two three four\nfive\n\nnext", "other\n\n p ONE two three four five \n\nend"])
    assert [r.kept_text for r in line_hash.without_repeats(two, unit="paragraph").orderBy("doc_id").collect()][1] == "other\n\n\nend"


def test_sentences_by_brute_force(spark):
    rng = random.Random(17)
    said = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) + rng.choice([".", "!", "?", "", "..."]) for _ in range(25)]
    texts = ["".join(x + rng.choice([" ", "  ", "\n", "\t", "", "\n\n"]) for x in rng.choices(said, k=rng.randint(0, 12))) for _ in range(80)]
    seen, expected = set(), []
    for t in texts:
        spans, at = [], 0
        for m in re.finditer(r"[^\n]*?[.!?][ \t]+|[^\n]+|\n", t):
            form = " ".join(m[0].split()).lower()
            if form.count(" ") >= 4 and form in seen:
                spans.append(m.span())
            elif form.count(" ") >= 4:
                seen.add(form)
        kept = "".join(c for i, c in enumerate(t) if not any(a <= i < b for a, b in spans))
        expected.append((spans, kept))
    got = [([tuple(s) for s in r.spans], r.kept_text) for r in line_hash.without_repeats(docs_of(spark, texts), unit="sentence").orderBy("doc_id").collect()]
    assert got == expected and any(s for s, _ in expected)


# ---- 7 fuzzy lines ---------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_and_similarity():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 14))) for _ in range(2))
        assert fuzzy_lines.edit_distance(a, b) == edits(a, b)
        a, b = (" ".join(x[i : i + 3] for i in range(0, len(x), 3)) for x in (a, b))
        assert fuzzy_lines.pieces_apart([a, "x"], [b, ""], 0.7)[0] <= 6 or not fuzzy_lines.similar(a, b, 0.7)
        assert fuzzy_lines.word_edits(a.split(" "), b.split(" ")) >= edits(a, b)
        assert fuzzy_lines.similar(a, b, 0.7, True) == fuzzy_lines.similar(a, b, 0.7) == (edits(a, b) <= 0.3 * max(len(a), len(b)) + 1e-9)


def line_groups(texts, least=0.8):
    """({(text, line): keep}, share of the pairs that meet) from all pairs of lines of five words or more: those that are similar and share a block."""
    units = collections.defaultdict(list)
    for t, text in enumerate(texts):
        for n, line in enumerate(text.split("\n")):
            if len((f := fuzzy_lines.normal_form(line)).split()) >= 5:
                units[f].append((t, n))
    forms = list(units)
    x = fuzzy_lines.Lines(forms, 5)
    keys = collections.defaultdict(set)
    for k, line in zip(*x.keys(), strict=True):
        keys[line].add(k)
    pairs = [(i, j) for i in range(len(forms)) for j in range(i) if fuzzy_lines.similar(forms[i], forms[j], least)]
    met = [(i, j) for i, j in pairs if keys[i] & keys[j] and int(x.sim[i] ^ x.sim[j]).bit_count() <= fuzzy_lines.SIM_BITS]
    groups = collections.defaultdict(list)
    for f, c in zip(forms, components(len(forms), met), strict=True):
        groups[c] += units[f]
    return {u: u == min(g) for g in groups.values() if len(g) > 1 for u in g}, len(met) / len(pairs)


@pytest.mark.parametrize("small, cell", [(32, 2048), (2, 4)])
def test_lines_by_brute_force(spark, monkeypatch, small, cell):
    monkeypatch.setattr(fuzzy_lines, "SMALL", small)
    monkeypatch.setattr(fuzzy_lines, "CELL", cell)
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(600)] + ["the", "of", "é1"] * 30
    texts = sample(60, 8)
    for k in range(24):
        w = rng.choices(vocab, k=rng.choice([6, 10, 20, 50]))
        for changed in [0, 1, 1, 2, len(w) // 10] * (4 if k == 3 else 1):
            own = list(w)
            for at in rng.sample(range(len(w)), changed):
                own[at] = rng.choice(vocab)
            texts.append(" ".join(own) + "\nalone " + " ".join(rng.choices(vocab, k=8)) + "\n\nshort line")
    expected, share = line_groups(texts)
    assert share > 0.9
    docs = docs_of(spark, texts)
    assert {(r.doc, r.line): r.keep for r in fuzzy_lines.duplicate_lines(docs).collect()} == expected
    if cell == 2048:
        kept = {r.doc_id: r.text for r in fuzzy_lines.without_duplicate_lines(docs).collect()}
        assert kept == {t: "\n".join(line for n, line in enumerate(texts[t].split("\n")) if expected.get((t, n), True)) for t in range(len(texts))}


def test_blocks_meet_for_nine_in_ten_pairs_of_the_table(sf_dir):
    """Recall of shared blocks and SimHash distance against all pairs of edit similarity 0.8 or more."""
    import duckdb

    texts = [t or "" for (t,) in duckdb.sql(f"select text from '{sf_dir}/documents.parquet'").fetchall()]
    assert line_groups(texts)[1] >= 0.95


def test_edits_of_long_lines_of_few_words_take_no_squared_time():
    rng = random.Random(12)
    v = rng.choices(["la", "do", "re", "mi"], k=60_000)
    for k in range(40):
        v[1_500 * k] = f"single{k}"
    w = list(v)
    for at in rng.sample(range(len(w)), 50):
        w[at] = "changed"
    took = time.process_time()
    assert 50 <= fuzzy_lines.word_edits(v, w) <= 7 * 1_500 * 51
    assert fuzzy_lines.word_edits(v, v) == 0 and fuzzy_lines.word_edits([], ["a"]) == 2
    assert time.process_time() - took < 5


def test_unlike_lines_under_one_block_travel_once(spark):
    """20,000 unlike lines that share a block of words: as many rows for the comparison, and no pair of them."""
    rng = random.Random(13)
    n = 20_000
    shared = spark.createDataFrame([(1, k, rng.getrandbits(64) - (1 << 63)) for k in range(n)], "key long, d1 long, sim long")
    alone = shared.select("d1", F.col("d1").alias("component")).where("false")
    assert fuzzy_lines._cells(shared, alone).count() <= 2 * n
    met = {(r.a, r.b) for r in fuzzy_lines._cross_pairs(shared, alone).collect()}
    sims = [r.sim for r in shared.orderBy("d1").collect()]
    own = np.array(sims).view(np.uint64)
    assert met == {(i, int(j)) for i in range(n) for j in np.flatnonzero(np.bitwise_count(own ^ own[i]) <= fuzzy_lines.SIM_BITS) if i < j}


def test_distances_of_many_pairs_equal_those_of_one(monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "ENOUGH", 1)
    rng = random.Random(14)
    texts = []
    for size in [0, 1, 5, 30, 63, 64, 65, 100, 128, 129, 200, 500, 1_030] * 8:
        texts.append("".join(rng.choices("ab cdeé", k=size)))
        for _ in range(3):
            own = list(texts[-1])
            for _ in range(rng.randint(0, max(1, size // 3))):
                at, kind = rng.randrange(len(own) + 1), rng.random()
                own[at : at + (kind < 0.66)] = rng.choice("abc ") * (kind > 0.33)
            texts.append("".join(own))
    i = np.arange(len(texts) - 1)
    got = fuzzy_lines.Alike(texts, 0.8)(i, i + 1)
    exact = [fuzzy_lines.edit_distance(s, t) <= 0.2 * max(len(s), len(t)) + 1e-9 for s, t in zip(texts, texts[1:], strict=False)]
    assert got.tolist() == exact and 0.1 < got.mean() < 0.9


def test_links_of_near_copies_grow_with_the_lines(spark):
    """500 near copies, none of which is near to all: one link a line at most, and the groups of all their pairs."""
    rng = random.Random(15)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(500)]
    base = rng.choices(vocab, k=40)
    forms = sorted({" ".join(rng.choice(vocab) if rng.random() < 0.1 else w for w in base) for _ in range(500)})
    rows = [(k % 3, d, d, 0, f, [k % 3, 7]) for k, (d, f) in enumerate(zip(range(1, 501), forms, strict=False))]
    rows += [(7, *r[1:]) for r in rows]
    shared = spark.createDataFrame(rows, "key long, d1 long, d2 long, sim long, normal string, keys array<long>")
    alone = shared.select("d1", F.col("d1").alias("component")).where("false")
    links = [(r.src.d1, r.dst.d1) for r in fuzzy_lines._links(shared, alone, 0.8).collect()]
    assert len(links) <= len(rows)

    def groups(pairs):
        least = list(range(len(forms) + 1))

        def root(x):
            while least[x] != x:
                x = least[x]
            return x

        for a, b in pairs:
            x, y = sorted((root(a), root(b)))
            least[y] = x
        return [root(x) for x in range(1, len(forms) + 1)]

    alike = fuzzy_lines.Alike(forms, 0.8)
    a, b = np.triu_indices(len(forms), 1)
    use = alike(a, b)
    assert use.sum() > 20 * len(rows)
    assert groups(links) == groups(zip((a[use] + 1).tolist(), (b[use] + 1).tolist(), strict=True))


def test_forms_of_one_cell_travel_once(spark):
    """A form that asks and is asked in one cell is one row of it; in more cells it asks and is asked once in each."""
    shared = spark.createDataFrame([(1, k, 0) for k in range(100)], "key long, d1 long, sim long")
    alone = shared.select("d1", F.col("d1").alias("component")).where("false")
    assert fuzzy_lines._cells(shared, alone).count() == 100


def test_unlike_lines_of_one_vocabulary_are_left_before_their_end(monkeypatch):
    """2,000 pairs of unlike lines of the same letters: few go through columns of their own, most columns are left out, and none is lost."""
    rng = random.Random(16)
    parts = ["th", "on", "er", "an", "re", "sh", "ble", "tion", " "]
    texts = ["".join(rng.choices(parts, k=300)) for _ in range(2_000)]
    texts += [t[:200] + "xyz" + t[220:] for t in texts[:50]]
    i, j = np.arange(2_050), np.concatenate((np.roll(np.arange(2_000), 1), np.arange(50)))
    alone, looks = [], []
    one, look = fuzzy_lines.edit_distance, fuzzy_lines._least_left
    monkeypatch.setattr(fuzzy_lines, "edit_distance", lambda *a: alone.append(a) or one(*a))
    monkeypatch.setattr(fuzzy_lines, "_least_left", lambda *a: looks.append(np.size(a[2])) or look(*a))
    got = fuzzy_lines.Alike(texts, 0.8).by_distance(i, j)
    assert np.flatnonzero(got).tolist() == list(range(2_000, 2_050))
    assert len(alone) < 100 and sum(looks) < 2_050 * 600 / fuzzy_lines.LOOK / 2
    for a, b, like in [(texts[0], texts[1999], False), (texts[2_000], texts[0], True)]:
        assert (one(a, b, 0.2 * max(len(a), len(b))) <= 0.2 * max(len(a), len(b))) == like == (one(a, b) <= 0.2 * max(len(a), len(b)))


def test_lines_of_texts_under_one_id(spark):
    line = "the same line of seven words here"
    docs = spark.createDataFrame([(1, line), (2, line + "\nother words that stand alone in two"), (2, "wholly unlike text of quite some words\n" + line)], "doc_id long, text string")
    got = sorted(r.text for r in fuzzy_lines.without_duplicate_lines(docs).collect())
    assert got == sorted([line, "other words that stand alone in two", "wholly unlike text of quite some words"])


def test_edit_distance_stops_early_only_above_the_bound():
    rng = random.Random(10)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 14))) for _ in range(2))
        most = rng.randint(0, 8)
        assert (fuzzy_lines.edit_distance(a, b, most) <= most) == (edits(a, b) <= most)


def test_lines_edge_cases(spark, odd):
    got = sorted((r.doc, r.line, r.keep) for r in fuzzy_lines.duplicate_lines(odd).collect())
    assert got == [(6, 0, True), (6, 0, True), (7, 0, False)]
    assert fuzzy_lines.without_duplicate_lines(odd).count() == odd.count()
    assert fuzzy_lines.duplicate_lines(odd.where("false")).count() == 0


# ---- 8 pieces --------------------------------------------------------------------------


def test_best_path_by_brute_force_and_round_trip():
    v = pieces.Vocabulary.load()
    e, d = pieces.Encoder(v), pieces.Decoder(v)
    known = {p.replace(pieces.SPACE, " "): (s, i) for p, s, i in v.pieces}

    def best(w):
        at = {0: (0.0, ())}
        for n in range(1, len(w) + 1):
            c = [(at[k][0] + known[w[k:n]][0], n - k, at[k][1] + (known[w[k:n]][1],)) for k in range(max(0, n - 16), n) if w[k:n] in known]
            c.append((at[n - 1][0] + v.unknown, 1, at[n - 1][1] + tuple(v.byte_ids[b] for b in w[n - 1].encode())))
            m = max(c, key=lambda x: (x[0], x[1]))
            at[n] = m[0], m[2]
        return list(at[len(w)][1])

    rng = random.Random(9)
    for _ in range(1500):
        t = "".join(rng.choices("abcdefghijklmn the▁éñ日本\t\n0123😀ﬁ.,", k=rng.randint(0, 25)))
        assert d.decode(e.encode(t)) == t
        if t and pieces.SPACE not in t:
            assert e.encode(t).tolist() == best(" " + t)


def test_pieces_edge_cases(spark, odd):
    v = pieces.Vocabulary.load()
    out = pieces.decode(pieces.encode(odd, v), v).collect()
    assert len(out) == odd.count() and all(r.decoded == (r.text or "") for r in out)
    assert all(r.ids == [] for r in out if not r.text)
    assert pieces.encode(odd.where("false"), v).count() == 0


# ---- 9 suffixes ------------------------------------------------------------------------


def repeats(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = np.zeros(len(b), bool)
        for k, s in enumerate(own):
            if s in seen:
                gone[k : k + 50] = True
        seen.update(own)
        out[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (len(b) > 0 and gone[0])), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("small", [False, True])
def test_suffixes_by_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(suffix, "LOT", 60)
        monkeypatch.setattr(suffix, "MOST_RUNS", 3)
        monkeypatch.setattr(suffix, "BLOCK", 4000)
    texts = sample(150, 10) + ["ab" * 200, "xab" + "ab" * 150, "é" * 60, "y" + "é" * 60, "z" * 49, "z" * 50, "z" * 51]
    docs = docs_of(spark, texts)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = suffix.without_repeated_strings(docs).select("doc_id", "n_bytes", removed.alias("n"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"))
    assert {r.doc_id: (r.n_bytes, r.n, r.s, r.h) for r in out.collect()} == repeats(list(enumerate(texts)))


def test_suffixes_do_not_rest_on_hashes(spark, monkeypatch):
    """With hashes that nearly always collide, bytes decide the same."""
    monkeypatch.setattr(suffix, "mix", lambda x: x & np.uint64(3))
    texts = sample(60, 21) + ["ab" * 100, "xab" + "ab" * 90]
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    for most in (1 << 16, 50):
        monkeypatch.setattr(suffix, "MOST_RUNS", most)
        out = suffix.without_repeated_strings(docs_of(spark, texts)).select("doc_id", "n_bytes", removed.alias("n"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"))
        assert {r.doc_id: (r.n_bytes, r.n, r.s, r.h) for r in out.collect()} == repeats(list(enumerate(texts)))


def test_suffixes_of_texts_under_one_id(spark):
    a, b = "a text of more than fifty bytes that occurs again, word for word", "another text, unlike the first one in all of its bytes, is here"
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b)], "doc_id long, text string")
    got = sorted((r.doc_id, bytes(r.kept).decode()) for r in suffix.without_repeated_strings(docs).collect())
    assert got == sorted([(1, a), (2, ""), (2, b), (2, b)])


def test_equal_strings_by_brute_force():
    rng = random.Random(11)
    data = "".join(rng.choices("ab", k=30)) * 12 + "".join(rng.choices("abc", k=300))
    data = (data * 2).encode()
    at = np.arange(len(data) - 50)
    got = suffix.equal_strings(np.frombuffer(data + bytes(128), np.uint8), at, 50)
    seen = {}
    for i in at.tolist():
        k = seen.setdefault(data[i : i + 50], got[i])
        assert got[i] == k
    assert len(set(got.tolist())) == len(seen)


def test_many_classes_with_one_beginning_take_no_squared_time():
    rng = np.random.default_rng(5)
    n = 8_000
    rows = np.hstack([np.tile(rng.integers(97, 123, 40, np.uint8), (n, 1)), rng.integers(97, 123, (n, 30), np.uint8)])
    at = (np.arange(n)[:, None] * 70 + np.arange(12)).ravel()
    began = time.process_time()
    got = suffix.equal_strings(np.concatenate([rows.ravel(), np.zeros(128, np.uint8)]), at, 50)
    assert time.process_time() - began < 3
    assert len(np.unique(got)) == len({rows.tobytes()[i : i + 50] for i in at.tolist()})


def test_suffixes_edge_cases(spark, odd):
    out = suffix.without_repeated_strings(odd).collect()
    assert len(out) == odd.count() and all(r.spans == [] for r in out)
    assert suffix.without_repeated_strings(odd.where("false")).count() == 0


# ---- 10 quality rules ------------------------------------------------------------------


def test_rule_features_by_brute_force(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choices(["a", "bb", " ", " ", "\n", "\t", "#", "é", "!", "C", "x|"], k=rng.randint(0, 120))) for _ in range(300)] + ["a b c " * 60, None, ""]
    for r in weak_rules.document_features(docs_of(spark, texts)).collect():
        t = r.text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        wins = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert (r.n_marked, r.n_letters) == (sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w), sum(c.isalpha() for c in t))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_accuracies_of_simulated_rules_are_found(spark):
    """Rules of known error rates vote on documents of known quality."""
    rng = random.Random(20)
    wrong = {f"r{k}": {1: a, 0: b} for k, (a, b) in enumerate([(0.02, 0.7), (0.1, 0.6), (0.05, 0.8), (0.3, 0.35), (0.01, 0.4), (0.15, 0.9)])}
    rows = collections.Counter()
    for _ in range(40_000):
        y = int(rng.random() < 0.75)
        rows[tuple(0 if rng.random() < 0.1 else -1 if rng.random() < wrong[k][y] else 1 for k in wrong)] += 1
    patterns = spark.createDataFrame([(*k, n) for k, n in rows.items()], [*wrong, "n"])
    got = weak_rules.estimate(patterns, list(wrong), rounds=15)
    assert abs(got["prior"] - 0.75) < 0.04
    for k, p in wrong.items():
        assert abs(got[k][1] - p[1]) < 0.05 and abs(got[k][0] - p[0]) < 0.1, (k, got[k])


def test_single_bad_votes_weigh_by_the_accuracy_of_their_rule(spark):
    """Neither all-must-pass nor majority: a careless rule alone rejects nothing, careful ones do."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    v = weak_rules.votes()
    seen = collections.defaultdict(set)
    for r in weak_rules.quality_rules(docs, carry=["doc_id"]).select("posterior", *[c.alias(k) for k, c in v.items()]).distinct().collect():
        seen[tuple(k for k in v if r[k] == -1)].add(r.posterior >= 0.5)
    assert seen[("v_length",)] == {True} and seen[("v_repeats",)] == {True} and False in seen[("v_symbols", "v_marked")]


def test_rules_edge_cases(spark, odd):
    out = weak_rules.quality_rules(odd)
    assert out.count() == odd.count() and "class_id" in out.columns
    assert {r.kept for r in out.where("n_words < 50").collect()} == {False}
    assert weak_rules.quality_rules(odd.where("false")).count() == 0


# ---- all -------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, spark, sf_dir):
    assert_same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name])


def test_components(spark):
    rng = random.Random(13)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    found = {r.node: r.component for r in common.connected_components(spark.createDataFrame(pairs + [(None, 3)], "src long, dst long")).collect()}
    expected = components(500, pairs)
    assert found == {x: expected[x] for p in pairs if p[0] != p[1] for x in p}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_grams_of_short_texts():
    g, first = wordhash.Words(["a b", "", None, "A, B!", "a b c d e f"]).grams(5)
    assert np.diff(first).tolist() == [1, 0, 0, 1, 2] and g[0] == g[1]


def test_pipeline_by_brute_force(spark, sf_dir):
    """Every stage on its own input, against the plain form of what it says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = {r.item_id: r.text.lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = common.materialise(stage(spark, docs, sf_dir), "test")
        if name == "quality rules":
            kept = {r.doc_id for r in weak_rules.quality_rules(docs).where("kept").collect()}
            assert {r.doc_id for r in out.collect()} == kept and out.columns == columns
        elif name == "line dedup":
            after = {r.doc_id: r.text for r in out.collect()}
            assert set(after) == set(before) and all(set(after[i].split("\n")) <= {*before[i].split("\n"), ""} for i in after)
            lines = collections.Counter(f for t in after.values() for line in t.split("\n") if len((f := fuzzy_lines.normal_form(line)).split()) >= 5)
            assert max(lines.values()) == 1
        elif name == "n-gram Jaccard join":
            ids = sorted(before)
            sets = [shingles(before[i]) for i in ids]
            pairs = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
            assert {r.doc_id for r in out.collect()} == {ids[i] for i, c in enumerate(components(len(ids), pairs)) if i == c}
        elif name == "benchmark decontamination":
            left = {r.doc_id for r in out.collect()}
            for i, t in before.items():
                w = t.lower()
                if any(" ".join(x) in " ".join(w.split()) for x in items.values()):
                    assert i not in left
        else:
            assert all(r.restored and r.n_tokens == len(r.ids) for r in out.collect()) and out.count() == len(before)
        docs = out
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


@pytest.mark.parametrize("doc_kind, item_kind", [("int", "int"), ("string", "int"), ("long", "string"), ("int", "short"), ("string", "double")])
def test_items_with_ids_of_any_type(spark, doc_kind, item_kind):
    passage = "seven plain words that stand in both tables here"
    docs = spark.createDataFrame([(1, "before " + passage), (None, passage), (3, "nothing of it"), (4, None)], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(doc_kind))
    items = spark.createDataFrame([(7, passage), (None, passage), (9, None)], "item_id long, text string").withColumn("item_id", F.col("item_id").cast(item_kind))
    out = decontaminate.find_items(docs, items)
    kind = lambda name, df: df.schema[name].dataType
    assert kind("item_id", out) == kind("item_id", items) and kind("doc_id", out) == kind("doc_id", docs)
    got = sorted((str(r.doc_id), str(r.item_id)) for r in out.collect())
    one, seven = str(docs.where("doc_id is not null").first().doc_id), str(items.where("item_id is not null").first().item_id)
    assert got == sorted((a, b) for a in (one, "None") for b in (seven, "None"))
