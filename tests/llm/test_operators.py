"""Each operator against brute force, an exact round trip or held-out accuracy, on small tables and odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, duck_rows, spark_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skarn.llm import bpe_codec, cpsjoin, html_extract, pii_bootstrap, quality_gbt, quality_rules, suffix_decontam, token_counts, toxic_segments, warc_bundles
from skarn.llm.oracles import ORACLES
from skarn.llm.queries import QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", "   \n\t ", "a b c", "a b c", "x" * 200_000, "stupid " * 50_000, "\x00\x01 ￾ é😀 a@b.c", "one\n\none\n \ntwo one", "<|endoftext|> 's  \n\n q", "1.2.3.4 +1 (084) 555-3661 4111 1111 1111 1111"]
PROSE = " ".join(f"word{i % 97} the of and" for i in range(60)) + "."
ROWS = [(1, PROSE), (1, PROSE), (2, None), (None, PROSE), (None, None), (6, PROSE + " tail"), *enumerate(ODD, 10)]
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = connect(SMALL)
    assert spark_rows(QUERIES[name](spark, SMALL)) == duck_rows(con, ORACLES[name])


# html


def test_main_text_without_boilerplate():
    tree = html_extract.trained()
    page = """<!DOCTYPE html><html><head><title>No</title><script>var a="</p>";</script></head><body><nav><a href=x>Home</a></nav><header>Site</header>
    <div class="cookie-notice">We use cookies</div><main><article><header><h1>T &amp; U</h1></header><p class="lead">One <a href=y>two</a>\n  three&nbsp;.<p>Ti.<!-- no --><aside>Related</aside>
    <div id="ad-slot">Buy</div><form>Mail <input></form><ul><li>First<li>Second</ul></article><section class="comments"><article>Nice text from a reader</article></section></main><footer>c</footer></body></html>"""
    assert html_extract.main_texts([page], tree) == ["T & U\nOne two three .\nTi.\nFirst\nSecond"]
    assert html_extract.main_texts([None, "", "<", "<" * 9000, "<div>" * 9000 + "a" + "</p>" * 9000, "<script>x"], tree)[:3] == ["", "", "<"]
    assert html_extract.main_texts(["<div><p>" + "long words here " * 20 + "</p></div><div class=footer>c 2020</div>"], tree)[0].startswith("long words")


def test_pages_as_their_template_says(spark):
    found = {r["page_id"]: r["text"] for r in QUERIES["op1_html_extract"](spark, MIDDLE).collect()}
    for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = (html_extract.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split() for x in re.split(r"</?(?:h1|p)\b[^>]*>", body))
        assert found[r["page_id"]] == "\n".join(" ".join(x) for x in parts if x)


def test_long_and_odd_pages(spark):
    """Time grows with a page's length, and columns that clash or have dots are ignored."""
    tree = html_extract.trained()
    words = "long words here and more of them " * 9
    start = time.perf_counter()
    pages = [f"<p>{words}" + "<br>" * 200_000 + "end</p>", "<p><table>" + "<div>a" * 30_000, "<ul><li>" + "<b>" * 30_000 + "<li>x" * 3, "<h1>" * 30_000 + "</p>" * 30_000, '<a "' * 50_000, "<!--" * 50_000]
    assert html_extract.main_texts(pages[:1], tree) == [words + "end"] and len(html_extract.main_texts(pages, tree)) == 6
    assert time.perf_counter() - start < 20
    rows = spark.createDataFrame([(1, "u", f"<p>{words}", "x", 5, "y"), (1, None, None, "x", 5, "y")], "page_id long, url string, html string, text string, n_chars int, `a.b` string")
    assert sorted((r["n_chars"], r["text"]) for r in html_extract.extract(rows).collect()) == [(0, ""), (len(words) - 1, words.strip())]


# quality rules


def base_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows, covered = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_and_base_verdict(spark, documents):
    found = quality_rules.judged(documents(ROWS), ["doc_id", "text"]).collect()
    assert len(found) == len(ROWS)
    for r in found:
        want = base_statistics(r["doc"]["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


def test_votes_find_the_labelled_junk(spark):
    found = QUERIES["op2_quality_rules"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("not base_failed")
    assert found.where("kept <> (quality = 1)").count() <= 0.01 * found.count()


def test_estimates_follow_agreement(spark):
    """Nine rules agree on good documents; one that votes at random gets no say."""
    n = len(quality_rules.RULES)
    draw = random.Random(3)
    rows = [([(1 if good else -1) if k < n - 1 else draw.choice([1, -1]) for k in range(n)],) for good in [True] * 90 + [False] * 30]
    voted = spark.createDataFrame(rows, "votes array<int>")
    model = quality_rules.fit(voted)
    p = [r["p"] for r in voted.select(quality_rules.posterior(model).alias("p")).collect()]
    assert min(p[:90]) > 0.9 and max(p[90:]) < 0.1
    good, bad = list(model["rules"].values())[-1]
    assert abs(good - bad) < 0.35


def test_estimates_by_force(spark):
    draw, n = random.Random(5), len(quality_rules.RULES)
    rows = [tuple(draw.choice([1, 1, 1, 0, -1]) if k % 3 else draw.choice([1, 0]) for k in range(n)) for _ in range(60)] * 2
    model = quality_rules.fit(spark.createDataFrame([(list(r),) for r in rows], "votes array<int>"))
    prior, good, bad = 0.8, [quality_rules.FIRST_GOOD] * n, [quality_rules.FIRST_BAD] * n
    for _ in range(quality_rules.ITERATIONS):
        odds = [np.log(prior / (1 - prior)) + sum({1: np.log(g / b), -1: np.log((1 - g) / (1 - b)), 0: 0.0}[v] for v, g, b in zip(r, good, bad, strict=True)) for r in rows]
        p = [1 / (1 + np.exp(-x)) for x in odds]
        prior = (sum(p) + 0.8) / (len(rows) + 1)
        share = lambda w, j, first: (sum(x for x, r in zip(w, rows, strict=True) if r[j] == 1) + quality_rules.PRIOR_WEIGHT * first) / (sum(x for x, r in zip(w, rows, strict=True) if r[j]) + quality_rules.PRIOR_WEIGHT)
        good, bad = [share(p, j, quality_rules.FIRST_GOOD) for j in range(n)], [share([1 - x for x in p], j, quality_rules.FIRST_BAD) for j in range(n)]
    assert model["prior"] == pytest.approx(prior) and list(model["rules"].values()) == [pytest.approx(x) for x in zip(good, bad, strict=True)]


# classifiers


def separation(spark, name, label, folder):
    found = QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("score", label).collect()
    score, y = np.array([r[0] for r in found]), np.array([r[1] for r in found])
    order = score.argsort().argsort() + 1
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality_trees_on_the_held_out_fold(spark):
    assert separation(spark, "op3_quality_trees", "quality", MIDDLE) > 0.97


def test_toxicity_on_the_held_out_fold(spark):
    assert separation(spark, "op10_toxicity", "toxic", "/root/testdata/sf0.1") > 0.93


def test_trees_scored_at_once_are_the_trees():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, len(quality_gbt.STATISTICS)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gbt.Boosted.train(x, y)

    def walk(row):
        total = model.start
        for k in model.roots:
            while model.left[k] != k:
                k = model.left[k] if row[model.feature[k]] <= model.limit[k] else model.right[k]
            total += model.value[k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]]) and ((model.score(x) > 0.5) == y).mean() > 0.97


def test_first_tree_by_force():
    """Every split of it gains most among all cuts, and every leaf has the step of its rows."""
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 5))
    y = (x[:, 1] + x[:, 3] ** 2 + 0.3 * draw.normal(size=400) > 1).astype(float)
    model = quality_gbt.Boosted.train(x, y)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality_gbt.BINS + 1)[1:-1])) for f in range(5)]
    g, h = y - y.mean(), np.full(400, y.mean() * (1 - y.mean()))
    part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + quality_gbt.SMOOTH)

    def check(k, rows, depth):
        gains = {}
        for f in range(5):
            for c in cuts[f]:
                low = rows[x[rows, f] <= c]
                if quality_gbt.MIN_LEAF <= len(low) <= len(rows) - quality_gbt.MIN_LEAF:
                    gains[(f, c)] = part(low) + part(rows[x[rows, f] > c]) - part(rows)
        most = max(gains.values(), default=0.0)
        if model.left[k] == k:
            assert depth == quality_gbt.LEAVES_DEPTH or len(rows) < 2 * quality_gbt.MIN_LEAF or most <= 1e-6
            assert model.value[k] == pytest.approx(quality_gbt.RATE * g[rows].sum() / (h[rows].sum() + quality_gbt.SMOOTH))
            return 1
        assert gains[(model.feature[k], model.limit[k])] == pytest.approx(most)
        low = x[rows, model.feature[k]] <= model.limit[k]
        return check(model.left[k], rows[low], depth + 1) + check(model.right[k], rows[~low], depth + 1)

    assert check(model.roots[0], np.arange(400), 0) > 4


def test_token_table_and_law_by_force(spark):
    draw = random.Random(8)
    rows = []
    for i in range(400):
        toxic = i % 8 == 0
        words = [f"w{draw.randrange(300)}" for _ in range(40)] + (["vile", f"scum{draw.choice('abc')}"] if toxic or i % 90 == 1 else [])
        draw.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxic_segments.fit(docs, labels)
    kept = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    n1 = sum(y for _, y in kept)
    share, table, counts = n1 / len(kept), {}, {0: Counter(), 1: Counter()}
    for t, y in kept:
        counts[y].update({k for w in set(t.split()) for k in [w] + [w[:m] + "*" for m in toxic_segments.BEGINNINGS if len(w) > m]})
    for token in counts[0] | counts[1]:
        y1, y0 = counts[1][token], counts[0][token]
        chance = (y1 + toxic_segments.PRIOR * share) / (y1 + y0 + toxic_segments.PRIOR)
        ratio = 2 * sum(y * np.log(y / ((y1 + y0) * p)) for y, p in ((y1, share), (y0, 1 - share)) if y)
        if y1 + y0 >= toxic_segments.MIN_DOCS and chance > share and np.sqrt(max(ratio, 0)) >= toxic_segments.MIN_ROOT:
            table[token] = np.log(chance / (1 - chance)) - np.log(share / (1 - share))
    assert model.table == pytest.approx(table) and {"vile", "scum*"} <= set(table)
    score = lambda w: next((table[k] for k in toxic_segments.tokens_of(w) if k in table), toxic_segments.DRIFT)
    found = [(y, len(t.split()), [s for _, _, s in toxic_segments.segments(np.array([score(w) for w in t.split()]))]) for t, y in kept]
    plain = sorted(s for y, _, f in found if not y for s in f)
    if len(plain) >= 10:
        least = float(np.quantile(plain, 0.5))
        tail = [s for s in plain if s >= least]
        scale = 1 / max(np.mean(tail) - least, 1e-2)
        assert model.scale == pytest.approx(scale) and model.rate == pytest.approx((len(tail) + 1) * np.exp(min(scale * least, 50)) / sum(n for y, n, _ in found if not y))
    evidence = np.array([model.evidence([(0, 0, s) for s in f], n) for _, n, f in found])
    y = np.array([y for y, _, _ in found], dtype=float)
    # at the curve's best place the slopes of the penalised likelihood are nothing
    p = model.chance(evidence)
    assert abs((y - p).sum() - 0.01 * model.base) < 1e-3 and abs(((y - p) * np.log1p(evidence)).sum() - 0.01 * model.slope) < 1e-3


def test_folds_and_empty_texts(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1), (10, None, None), (11, 1, 0)], "doc_id long, quality int, toxic int")
    for run, modulus, held in ((quality_gbt.classify, 5, 0), (toxic_segments.classify, 4, 2)):
        found = run(documents(ROWS), labels).collect()
        assert len(found) == len(ROWS)
        for r in found:
            assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=30))
def test_maximal_segments(scores):
    """Greedy by definition: take the best segment, then go on left and right of it."""
    found = toxic_segments.segments(np.array(scores, dtype=float))

    def best(a, b):
        sums = np.concatenate([[0], np.cumsum(scores[a:b])])
        pairs = [(sums[j] - sums[i], -(j - i), -i, a + i, a + j) for i in range(len(sums)) for j in range(i + 1, len(sums))]
        top = max(pairs, default=(0,))
        return [] if top[0] <= 0 else best(a, top[3]) + [(top[3], top[4], float(top[0]))] + best(top[4], b)

    wanted = best(0, len(scores))
    assert sum(s for _, _, s in found) == pytest.approx(sum(s for _, _, s in wanted))
    assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:], strict=False))
    # the borders: by definition every proper part of a segment scores less, and no longer stretch around it has that property
    sums = np.concatenate([[0], np.cumsum(scores)])
    minimal = lambda a, b: all(sums[j] - sums[i] < sums[b] - sums[a] for i in range(a, b) for j in range(i + 1, b + 1) if (i, j) != (a, b))
    good = [(a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1) if sums[b] > sums[a] and minimal(a, b)]
    assert [(a, b) for a, b, _ in found] == sorted((a, b) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good))


# near-duplicates


def groups_by_force(rows, size, percent):
    sets = [frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if (w := (t or "").lower().split()) else frozenset() for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if group[j] == group[i]) for i in range(len(rows))}


def near_copies(n, seed):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(20, 80))]
        for copy in range(draw.randrange(1, 8)):
            words = list(base)
            for _ in range(copy):
                words[draw.randrange(len(words))] = f"e{draw.randrange(900)}"
            out.append((len(out) + 5, " ".join(words)))
    return out


@pytest.mark.parametrize("leaf,depth,few", [(4096, 8, 500_000), (2, 3, 500_000), (3, 8, 0)])
def test_near_duplicate_groups(spark, documents, monkeypatch, leaf, depth, few):
    """Also with leaves so small that nodes branch down to the last level, and with nothing sent to all executors."""
    monkeypatch.setattr(cpsjoin, "BROADCAST_ROWS", few)
    rows = near_copies(40, 1)
    found = {r["doc_id"]: r["component_id"] for r in cpsjoin.near_duplicates(documents(rows), leaf=leaf, depth=depth).collect()}
    assert found == groups_by_force(rows, 5, 80)


def test_pairs_stay_together_in_large_nodes(spark):
    """Pairs with 51 of 64 equal minwise shingles (0.8) have a common node after five levels on which every node is large."""
    draw, rows = np.random.default_rng(11), []
    for k in range(1000):
        one = draw.integers(-(1 << 31), 1 << 31, 64)
        two = one.copy()
        two[draw.choice(64, 13, replace=False)] ^= 1
        rows += [(k.to_bytes(4) + bytes([side]), 0, x.tolist()) for side, x in enumerate((one, two))]
    sets = cpsjoin.materialise(spark.createDataFrame(rows, "cid binary, sketch long, minwise array<int>"), "sets")
    nodes = cpsjoin._roots(sets)
    for _ in range(5):
        nodes = cpsjoin._children(cpsjoin.materialise(nodes, "nodes"), sets)
    together = nodes.groupBy("key").agg(F.count("*").alias("n"), F.min(F.substring("cid", 1, 4)).alias("pair")).where("n > 1")
    assert together.select("pair").distinct().count() == 1000


def written(monkeypatch):
    """The number of rows of each table that the join writes, by its label."""
    rows, write = Counter(), cpsjoin.materialise

    def counted(df, label):
        out = write(df, label)
        rows[label] += out.count()
        return out

    monkeypatch.setattr(cpsjoin, "materialise", counted)
    return rows


def test_texts_travel_once_however_many_nodes_share_them(spark, documents, monkeypatch):
    rows, counts = near_copies(40, 2), written(monkeypatch)
    cpsjoin.near_duplicates(documents(rows)).collect()
    assert 0 < counts["near"] <= len({t for _, t in rows})


def test_a_cell_reads_each_text_once(monkeypatch):
    """Also where most pairs fail, so that none of them saves another comparison."""
    draw, read, plain = random.Random(5), Counter(), cpsjoin.shingles
    base = [f"w{draw.randrange(400)}" for _ in range(200)]
    texts = [" ".join(f"e{draw.randrange(10**6)}" if draw.randrange(100) < 1 + k % 5 else w for w in [*base, f"u{k}"]) for k in range(120)]
    sets = pd.concat(cpsjoin._sets(4)(iter([pd.DataFrame({"doc_id": [str(k) for k in range(120)], "text": texts})])))

    def counted(data, size, hashes):
        read[data] += 1
        return plain(data, size, hashes)

    monkeypatch.setattr(cpsjoin, "shingles", counted)
    one_cell = sets.assign(node=1, side=True, cross=False)[["node", "side", "cross", "cid", "sketch", "minwise", "packed"]]
    parts = iter([one_cell[:50], one_cell[50:51], one_cell[51:]])
    found = pd.concat(cpsjoin._linked(["side", "cross", "cid", "sketch", "minwise", "packed"], cpsjoin._confirmed(4, 80))(parts))
    assert set(read.values()) == {1} and len(read) == 120
    label = {c: k for k, c in enumerate(sets.cid)}
    for a, b in zip(found.a, found.b, strict=True):
        old, one = label[a], label[b]
        assert old != one
        label = {c: one if g == old else g for c, g in label.items()}
    wanted = groups_by_force(list(enumerate(texts)), 4, 80)
    assert Counter(Counter(label.values()).values()) == Counter(Counter(wanted.values()).values()) and 5 < len(set(wanted.values())) < 115


@pytest.mark.parametrize("blocks,shingles,few", [(1, 2_000_000, 500_000), (1, 50, 0), (16, 150, 500_000)])
def test_near_duplicate_groups_over_cells(spark, documents, monkeypatch, blocks, shingles, few):
    """Nodes that branch and are dealt to cells at the last level, groups dealt to cells by their shingles, wanted rows by bit table."""
    for name, value in (("BLOCKS", blocks), ("BLOCK_SHINGLES", shingles), ("BROADCAST_ROWS", few)):
        monkeypatch.setattr(cpsjoin, name, value)
    rows = near_copies(30, 3)
    found = {r["doc_id"]: r["component_id"] for r in cpsjoin.near_duplicates(documents(rows), leaf=2, depth=2).collect()}
    assert found == groups_by_force(rows, 5, 80)


def test_the_bit_table_keeps_what_is_wanted(spark, monkeypatch):
    monkeypatch.setattr(cpsjoin, "SIEVE_BITS", 1 << 20)
    rows = spark.range(200_000).select("id", F.xxhash64("id").alias("k"))
    kept = {r["id"] for r in cpsjoin._among(rows, F.col("k"), rows.where("id % 100 = 7").select("k")).select("id").collect()}
    assert kept >= set(range(7, 200_000, 100)) and len(kept) < 4_000


def test_near_duplicates_of_odd_rows(spark, documents):
    found = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in cpsjoin.near_duplicates(documents(ROWS), 4).collect()))
    by = Counter(found)
    assert len(found) == len(ROWS) and by[(1, 237, 1, True)] == 2 and by[(0, 237, 1, False)] == 1 and by[(6, 238, 1, False)] == 1
    assert by[(0, 0, 0, True)] == 1 and by[(12, 1, 12, True)] == 1 and by[(13, 1, 12, False)] == 1 and by[(10, 0, 10, True)] == 1


def test_a_long_chain_is_one_group(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)], "a binary, b binary")
    found = cpsjoin.components(edges).collect()
    assert len(found) == 61 and {bytes(r["comp"]) for r in found} == {b"\x00"}


# tokens


def test_ids_and_bytes_as_the_library(spark, documents):
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.load_ranks(RANKS), special_tokens={})
    docs = documents(ROWS)
    for chars in (bpe_codec.BLOCK_CHARS, 300):
        found = bpe_codec.round_trip(docs, RANKS, public_tokenizers.PATTERN, chars).collect()
        wanted = Counter((i, tuple(coder.encode_ordinary(t or "")), (t or "").encode()) for i, t in ROWS)
        assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in found) == wanted
    apart = bpe_codec.decode(bpe_codec.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert Counter(bytes(r["decoded"]) for r in apart.collect()) == Counter((t or "").encode() for _, t in ROWS)


def test_counts_as_the_library(spark, documents, monkeypatch):
    file = public_tokenizers.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(file)
    found = token_counts.token_counts(documents(ROWS), file, public_tokenizers.PATTERN).collect()
    wanted = Counter((i, len((t or "").encode()), n := len(coder.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in ROWS)
    assert Counter(map(tuple, found)) == wanted


def test_the_cache_begins_anew_without_loss():
    coder = token_counts.load_tokenizer(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    import regex

    find, lengths = regex.compile(public_tokenizers.PATTERN).findall, token_counts.Lengths(coder, {" the": 1}, limit=3)
    texts = ["one two three four", "five the six seven", "one two three four"]
    assert token_counts.counts_of(texts, lengths, find, None) == [len(coder.encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_text_with_more_words_than_the_cache():
    coder = token_counts.load_tokenizer(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    import regex

    find, lengths = regex.compile(public_tokenizers.PATTERN).findall, token_counts.Lengths(coder, {}, limit=4)
    texts = ["one two three", "one two three four five", "six one"]
    assert token_counts.counts_of(texts, lengths, find, None) == [len(coder.encode(t, add_special_tokens=False).ids) for t in texts]


def test_frequent_words_are_of_the_whole_table(spark, documents):
    definition = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    docs = documents([(i, "first words" if i < 300 else "other language") for i in range(600)])
    found = token_counts.frequent_lengths(docs, definition, public_tokenizers.PATTERN, 50)
    assert set(found) == {"first", " words", "other", " language"}
    assert token_counts.frequent_lengths(docs.limit(0), definition, public_tokenizers.PATTERN) == {}


# archives


def test_bundles_are_seekable_and_whole(spark, tmp_path):
    rows = [(3, "u3", "p" * 200), (2, None, "p" * 200), (2, None, "p" * 200), (None, "n", "p" * 200), (1, "u1", "short"), (4, "u4", "short"), (5, "u 5", None), (6, "é", "q" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    bundles = warc_bundles.write_bundles(pages)
    found = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_bundles.read_bundles(bundles).collect())
    wanted = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 100 and html[0] == "p" and i != 2
        wanted[(i, len(data), sha(data), "revisit" if revisit else "response", 2 if revisit else None)] += 1
    assert found == wanted
    for r in warc_bundles.export_files(bundles, str(tmp_path)).collect():
        data = (tmp_path / r["bundle"]).read_bytes()
        assert len(data) == r["n_bytes"]
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as whole:
            assert whole.read().startswith(b"WARC/1.1\r\n")


def test_shuffled_when_many_payloads_repeat(spark, monkeypatch):
    monkeypatch.setattr(warc_bundles, "BROADCAST_ROWS", 0)
    con = connect(SMALL)
    columns, wanted = duck_rows(con, ORACLES["op7_warc"])
    assert spark_rows(QUERIES["op7_warc"](spark, SMALL), columns) == (columns, wanted)


# personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def spans_by_force(text):
    out = []
    for k, (name, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "email" or name == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or name == "card" and 14 <= len(digits) <= 19 and luhn(digits) or name == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(out))


PERSONAL = ["a@b.c.d@e.f g@h", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "4111-1111-1111-1111 5", "+1 (084) 555-3661.", "++1 2223334444+1 2223334444", "é😀 a@b.co.uk 😀 10.0.0.1", "x@y.z." * 50, "9" * 40, "a" * 30_000 + "@b.cd", "+1 555 555 5555 4111111111111111", "-a@b.c", "1.2.3.300 4.5.6.7"]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text("a@.+1 ()-_9", max_size=30), min_size=200, max_size=200))
def test_base_spans_by_force(spark, documents, drawn):
    texts = PERSONAL + drawn + ODD + [None]
    for r in pii_bootstrap.report(documents(list(enumerate(texts)))).collect():
        want = spans_by_force(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(want), texts[r["doc_id"]]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [want.count(k) for k, _ in BASE]


def test_contexts_find_more_and_redaction(spark, documents):
    cards = [d for i in range(200) if luhn(d := str(4_000_000_000_000_000 + i * 7919))][:12]
    rows = [(i, f"Dear all, my card number {d} is lost and gone") for i, d in enumerate(cards)]
    rows += [(100, "then card number 4000000000000001 stands here"), (101, "the order code 4000000000000001 is odd"), (102, None)]
    found = {r["doc_id"]: r["spans"] for r in pii_bootstrap.report(documents(rows)).collect()}
    assert found[100] == "card:17:33" and found[101] == "" and found[0].startswith("card:25:")
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii_bootstrap.redacted(documents(rows)).collect()}
    assert clean[100] == ("then card number <CARD> stands here", 35) and clean[101] == (rows[-2][1], len(rows[-2][1])) and clean[102] == (None, None)


def test_contexts_find_unseen_forms(spark, documents):
    """Phones without +, cards in groups and addresses without a dotted host have no seed of their exact form."""
    cards = [d for i in range(200) if luhn(d := str(4_000_000_000_000_000 + i * 7919))][:12]
    rows = [(i, f"their phone number +1 (084) 555-{3000 + i} rings") for i in range(12)] + [(20 + i, f"then card number {d} is gone") for i, d in enumerate(cards)]
    rows += [(40 + i, f"please mail to user{i}@example.com today") for i in range(12)] + [(60 + i, f"from the host 10.0.0.{i} again") for i in range(12)]
    asked = {
        "phone": ["084 555-3661", "(084) 555-3662", "0845553663", "+1 555-3664", "084 555-3665 2 times"],
        "card": ["4000 0000 0000 0001", "4000-0000-0000-0001", "4000 0000 0000 0001 48451"],
        "email": ["root@localhost", "ann (at) example.com", "ann @ localhost"],
        "ip": ["300.1.1.1"],
    }
    stop = {"084 555-3665 2 times": 12, "4000 0000 0000 0001 48451": 19}
    before = {"phone": "their phone number", "card": "then card number", "email": "please mail to", "ip": "from the host"}
    wanted = {}
    for kind, values in asked.items():
        for value in values:
            start = len(before[kind]) + 1
            wanted[100 + len(wanted)] = f"{kind}:{start}:{start + stop.get(value, len(value))}"
            rows.append((99 + len(wanted), f"{before[kind]} {value} so"))
    rows += [(200, "the order code 084 555-3661 is odd"), (201, "their phone number 12345 so"), (202, "then card number 084 555-3661 so"), (203, "their phone number 084 555-36x1 so")]
    found = {r["doc_id"]: r["spans"] for r in pii_bootstrap.report(documents(rows)).collect()}
    assert {i: found[i] for i in wanted} == wanted
    assert [found[i] for i in (200, 201, 202, 203)] == [""] * 4


def planted_contexts():
    """Cards behind a context that seeds make a pattern, and behind one that only accepted values do."""
    cards = [d for i in range(200) if luhn(d := str(4_000_000_000_000_000 + i * 7919))][:12]
    other = [d for i in range(200) if not luhn(d := str(5_000_000_000_000_000 + i * 7919))][:7]
    rows = [(10_000_000 + i, f"my card number {d} is lost") for i, d in enumerate(cards)]
    return rows + [(10_000_100 + i, f"my card number {d} is lost") for i, d in enumerate(other[:6])] + [(10_000_200 + i, f"then charged to {d} again") for i, d in enumerate(other)]


def test_accepted_values_make_patterns(spark, documents):
    """A context with no seed at all becomes a pattern by values that were accepted in the round before."""
    rows = [(i - 10_000_000, t) for i, t in planted_contexts()]
    found = {r["doc_id"]: r["spans"] for r in pii_bootstrap.report(documents(rows)).collect()}
    assert found[100] == "card:15:31" and all(found[200 + i] == "card:16:32" for i in range(7))


def accepted_by_force(rows):
    """What the graph of patterns and values accepts: (row, start, kind, stop), from each row's text, seeds and others."""
    digits = lambda v: re.sub("[^0-9]", "", v)
    layout = lambda v: re.sub("[^9]+", " ", re.sub("[0-9]", "9", v)).strip()
    at = re.compile(pii_bootstrap.ADDRESSES)

    def shapes(v):
        if at.search(v):
            return ["@"]
        dotted = re.sub("[0-9]+", "9", v.replace(" ", ""))
        return [dotted if dotted == "9.9.9.9" else layout(v), f"#{len(digits(v))}"]

    def allowed(kind, v):
        n, groups = len(digits(v)), layout(v).split(" ")
        if kind == 0:
            return {"@"}
        if kind == 1:
            return {"9.9.9.9"}
        if kind == 2:
            return {layout(v), f"#{n}"}
        least = max(pii_bootstrap.PHONE_DIGITS, n - pii_bootstrap.LEFT_OUT)
        return {" ".join(groups[k:]) for k in range(len(groups)) if len("".join(groups[k:])) >= least} | {f"#{k}" for k in range(least, n + 1)}

    known = {(s["kind"], s["value"]) for r in rows for s in r["seeds"]}
    votes = Counter((kind, shape) for kind, v in known for shape in allowed(kind, v))
    fits = {}  # (row, start, kind): (far, -stop, stop, value, context)
    for r in rows:
        for x in r["others"]:
            for far, shape in enumerate(shapes(x["value"])):
                for kind in range(4):
                    if x["context"] and votes[(kind, shape)] >= pii_bootstrap.MIN_SHAPE:
                        here = (far, -x["stop"], x["stop"], x["value"], x["context"])
                        fits[(r["row"], x["start"], kind)] = min(fits.get((r["row"], x["start"], kind), here), here)
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", r["text"].lower()) if w] for r in rows]
    places = Counter(f"{a} {b}" for w in words for a, b in zip(w, w[1:], strict=False))
    seen = Counter((s["context"], s["kind"], s["value"]) for r in rows for s in r["seeds"] if s["context"])
    maybe = Counter((c, kind, v) for (_, _, kind), (_, _, _, v, c) in fits.items())
    accepted = set()
    while True:
        count, values = Counter(), {}
        for source, test in ((seen, lambda k, v: True), (maybe, lambda k, v: (k, v) in {(a, b) for _, a, b in accepted})):
            for (c, k, v), n in source.items():
                if test(k, v):
                    count[(c, k)] += n
                    values.setdefault((c, k), set()).add(v)
        sure = {key: (n / places[key[0]], len(values[key])) for key, n in count.items() if len(values[key]) >= pii_bootstrap.MIN_VALUES and n / places[key[0]] >= pii_bootstrap.MIN_CONFIDENCE}
        score = Counter()
        for c, k, v in maybe:
            if (c, k) in sure:
                score[(k, v)] += sure[(c, k)][0] * np.log(sure[(c, k)][1] + 1)
        now = {(c, k, v) for c, k, v in maybe if (c, k) in sure and score[(k, v)] >= pii_bootstrap.MIN_SCORE}
        if now == accepted:
            return {(row, start, kind, stop) for (row, start, kind), (_, _, stop, v, c) in fits.items() if (c, kind, v) in accepted}
        accepted = now


def test_graph_of_contexts_by_force(spark):
    draw = random.Random(9)
    rows = planted_contexts()
    for i in range(600):
        plus, bare = f"+1 555 {draw.randrange(200, 230)} {draw.randrange(1000, 1030)}", f"555 {draw.randrange(200, 230)} {draw.randrange(1000, 1030)}"
        code, ip, mail = str(draw.randrange(10**15, 10**15 + 40)), f"{draw.randrange(300)}.1.1.{draw.randrange(9)}", f"u{draw.randrange(30)}@host"
        kind, value = draw.choice([("phone at", plus), ("phone at", plus), ("phone at", bare), ("ring me", bare), ("ring me", code), ("room number", draw.choice([bare, code])), ("the server", ip), ("write to", mail + ".de"), ("write to", mail)])
        rows.append((i, f"so {kind} {value} " * draw.randrange(1, 3) + draw.choice(["", "y" * 90 + " " + "z" * 90 + " call +1 555 222 1001"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii_bootstrap.materialise(pii_bootstrap.base_spans(docs, ["doc_id"]).withColumn("row", F.monotonically_increasing_id()), "pii")
    wanted = accepted_by_force(found.collect())
    assert {tuple(r) for r in pii_bootstrap.induced(found, docs).select("row", "start", "kind", "stop").collect()} == wanted and len(wanted) > 13


def test_contexts_are_the_two_words_before(spark):
    """However long these are, and never the rest of a word."""
    texts = ["a@b.cd", "one a@b.cd", "One  TWO\na@b.cd", f"{'x' * 100} {'Y' * 3000} (a@b.cd", f"p {'q' * 79} a@b.cd", f"{'w' * 30_000} v  a@b.cd", "t " * 50_000 + "a@b.cd"]
    found = pii_bootstrap.base_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).select("doc.doc_id", "seeds.context").collect()
    want = {0: "", 1: "", 2: "one two", 3: f"{'x' * 100} {'y' * 3000}", 4: f"p {'q' * 79}", 5: f"{'w' * 30_000} v", 6: "t t"}
    assert {r["doc_id"]: r["context"][0] for r in found} == want


# decontamination


def contamination_by_force(docs, items, size=8):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = Counter()
    for i, text in docs:
        words, hit, names = cut(text), set(), set()
        for name, item in set(items):
            w = cut(item)
            n = min(size, len(w))
            for j in range(len(w) - n + 1 if w else 0):
                for k in range(len(words) - n + 1):
                    if words[k : k + n] == w[j : j + n]:
                        hit |= set(range(k, k + n))
                        names.add(str(name))
        out[(i, len(words), len(hit), len(names), sha(",".join(sorted(names))))] += 1
    return out


def longest_by_force(words, items):
    """Most words that stand in both, for each item by name."""
    out = {}
    for name, w in items:
        out[name] = max((k for i in range(len(words)) for j in range(len(w)) for k in [next((m for m in range(min(len(words) - i, len(w) - j)) if words[i + m] != w[j + m]), min(len(words) - i, len(w) - j))]), default=0)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.lists(st.integers(0, 3), max_size=20), st.integers(1, 3))
def test_suffixes_are_sorted_and_searched_in_full(numbers, other, least):
    numbers, other = np.array([*numbers, 0], dtype=np.int32), np.array([*other, 0], dtype=np.int32)
    runs = lambda row: [(row[i:j].tolist(), i) for i in range(len(row)) for j in [i + int(np.argmax(row[i:] == 0))] if j > i]
    own, asked = runs(numbers), runs(other)
    found = suffix_decontam.Suffixes.sort(numbers, least)
    assert [numbers[a : a + n].tolist() for a, n in zip(found.starts, found.left, strict=True)] == sorted(s for s, _ in own if len(s) >= least)
    assert sorted(found.starts) == sorted(i for s, i in own if len(s) >= least)
    best, where = found.longest(other, np.array([i for _, i in asked], dtype=np.int64), np.array([len(s) for s, _ in asked], dtype=np.int64))
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    for (s, _), n, at in zip(asked, best, where, strict=True):
        assert n == max((common(s, x) for x, _ in own if len(x) >= least), default=0)
        assert not n or common(s, dict((i, x) for x, i in own)[at]) == n


def test_longest_matches_of_items_and_long_texts(spark, documents):
    """In shards smaller than a text, and with a benchmark in blocks."""
    draw = random.Random(2)
    say = lambda n: [draw.choice("abcdefg") for _ in range(n)]
    items = [(f"{k:02d}", say(draw.randrange(8, 40))) for k in range(10)]
    texts = [say(draw.randrange(200)) + items[k % 10][1][k : k + 12] + say(5) for k in range(20)] + [say(3000) + items[3][1] + say(30)]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id string, text string")
    docs = documents([(i, " ".join(w)) for i, w in enumerate(texts)])
    for blocks in (suffix_decontam.BLOCK_WORDS, 60):
        found = {r["item_id"]: r for r in suffix_decontam.item_matches(docs, bench, shard_words=300, block_words=blocks).collect()}
        by = [longest_by_force(w, items) for w in texts[:20]] + [{n: len(w) if n == "03" else 0 for n, w in items}]
        for name, words in items:
            r = found.get(name)
            least = max(x[name] for x in by)
            assert r is None and least < 8 or r["words"] >= least
            if r is not None:
                a, b = r["item_start"], r["doc_start"]
                assert words[a : a + r["words"]] == texts[r["doc_id"]][b : b + r["words"]]
        assert found["03"]["words"] == len(items[3][1])
        for r in suffix_decontam.find_matches(docs, bench, shard_words=300, block_words=blocks).where("doc_id < 20").collect():
            most = max(by[r["doc_id"]].values())
            assert r["longest"] == (most if most >= 8 else 0)
            if r["longest"]:
                words, a = dict(items)[r["longest_item"]], r["longest_start"]
                run = texts[r["doc_id"]][a : a + most]
                assert any(words[j : j + most] == run for j in range(len(words)))


def test_a_benchmark_of_a_million_words(spark, documents):
    """Some blocks of it, one after the other; every planted passage is found, and nothing else."""
    draw = random.Random(4)
    lines = [" ".join(f"w{draw.randrange(5000)}" for _ in range(50)) for _ in range(20_000)]
    bench = spark.createDataFrame(list(enumerate(lines)), "item_id long, text string")
    rows = [(i, " ".join(f"w{draw.randrange(5000)}" for _ in range(40)) + (" " + " ".join(lines[97 * i].split()[5:20]) if i % 2 else "")) for i in range(200)]
    found = suffix_decontam.decontamination_report(documents(rows), bench, block_words=400_000).collect()
    assert {r["doc_id"] for r in found if r["n_hit"]} == set(range(1, 200, 2)) and len(found) == 200
    assert all(r["longest_match"] >= 15 and r["longest_match_item"] == str(97 * r["doc_id"]) for r in found if r["n_hit"])


@pytest.mark.parametrize("blocks", [suffix_decontam.BLOCK_WORDS, 8])
def test_hits_by_force(spark, documents, blocks):
    draw = random.Random(5)
    say = lambda n: " ".join(draw.choice(["a", "b", "The", "é", "x1"]) for _ in range(n))
    items = [(k, say(draw.randrange(0, 14))) for k in range(12)] + [(3, "twice"), (None, "a b")]
    rows = [(k, say(draw.randrange(0, 40)) + ("" if k % 3 else ", " + items[k % 12][1])) for k in range(60)] + [(None, None), (7, ""), (7, "")]
    bench = spark.createDataFrame([(*x, "q") for x in items] + [(99, None, "q")], "item_id long, text string, doc_id string")
    found = suffix_decontam.decontamination_report(documents(rows), bench, shard_words=50, block_words=blocks).collect()
    wanted = contamination_by_force(rows, [x for x in items if x[0] is not None])
    assert Counter(tuple(r[:5]) for r in found) == wanted
    assert all(r["contaminated"] == (r["n_items"] >= 2) and (r["longest_match"] > 0) == (r["n_hit"] > 0) for r in found)


def test_longest_match_and_its_place(spark, documents):
    bench = spark.createDataFrame([(1, "p0 p1 p2 p3 p4 p5 p6 p7 p8 p9 p10"), (2, "p4 p5 p6 p7 p8 p9 p10 q1 q2")], "item_id long, text string")
    r = suffix_decontam.find_matches(documents([(1, "z z p0 p1 p2 p3 p4 p5 p6 p7 p8 p9 q9 p4 p5 p6 p7 p8 p9 p10 q1 q2")]), bench).first()
    assert (r["longest"], r["longest_start"], r["longest_item"]) == (10, 2, "1") and [tuple(s) for s in r["spans"]] == [(2, 12), (13, 22)]


# all of them


def test_empty_tables(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, run in QUERIES.items():
        assert run(spark, str(tmp_path)).collect() == [], name


def test_native_operators_run_no_python(spark, documents, monkeypatch):
    """Nor do the plans of what they write on the way."""
    plans, plan = [], lambda df: df._jdf.queryExecution().toString()
    for module in (quality_rules, pii_bootstrap):
        monkeypatch.setattr(module, "materialise", lambda df, label, real=module.materialise: plans.append((label, plan(df))) or real(df, label))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(planted_contexts(), "doc_id long, text string"))
    plans += [("judged", plan(quality_rules.judged(docs, ["doc_id"]))), ("report", plan(pii_bootstrap.report(docs))), ("kept", plan(quality_rules.kept_documents(docs))), ("redacted", plan(pii_bootstrap.redacted(docs)))]
    assert {"votes", "pii", "fitting", "graph", "places", "linked", "patterns", "accepted"} <= {label for label, _ in plans}
    for label, text in plans:
        assert not re.search("Python|Pandas|MapInArrow|EvalPython", text), label
    assert re.search("Pandas", plan(docs.mapInPandas(lambda b: b, docs.schema)))  # what the search would find


def test_executors_do_not_need_the_package(tmp_path):
    """A task's function loads where the package cannot be imported."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps(lambda texts: suffix_decontam.scan_shard(texts, suffix_decontam.TestSide(**suffix_decontam.TestSide.build([], 8)))))
    code = "import pickle, importlib.util as u; assert u.find_spec('skarn') is None; print(pickle.load(open('f', 'rb'))([[1, 2]]))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.strip() == "[([], [], 0, None, None)]", out.stderr
