"""Each operator against a brute-force version, and on the cases its docstring defines."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat_format, decontaminate, ngram_join, packing, quality, secret_scan, suffix_dedup, telephony, textops, token_files, tokens, toxicity
from millrace.llm.shared import new_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, row_hash long, base string, spans string, ids string, media string, score double, __h long, __id long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + ("." if i % 7 == 0 else "") for i in rng.integers(0, len(WORDS), n))


def table(spark, rows):
    """Documents (id, text) among other columns, some with names that operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None, 7, "b", "s", "i", "m", 0.5, 1, 2) for i, t in rows], DOC)


def edge_rows():
    long = prose(5, 30_000)
    return [(1, None), (2, ""), (3, "word"), (4, "two words"), (5, long), (6, long), (None, prose(8, 60)), (7, prose(8, 60)), (7, prose(8, 60)), (7, prose(9, 60)), (-3, "é漢字 🙂 \x00 x"), (8, "a" * 300), (9, " \n\t ")]


# Word primitives.


def test_words_and_shingles_match_plain_python():
    texts = ["Hello, hello wörld 42", "", "one", "...", "a b c d e f", "İstanbul Σίσυφος"]
    h, o, s, e = textops.words(texts)
    own = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert [len(x) for x in own][:5] == np.diff(o).tolist()[:5]
    assert h[0] == h[1] and len(set(h[o[4] : o[5]].tolist())) == 6
    sh, so = textops.shingles(h, o)
    assert np.diff(so).tolist() == [1, 0, 1, 0, 2, 1]


def thue_morse(n):
    """Two words of n letters on which all polynomial hashes modulo powers of two agree, from some length on."""
    w = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_structured_words_have_hashes_of_their_own():
    texts = [w for n in (512, 1024, 2048, 4096) for w in thue_morse(n)] + ["a" * n for n in range(1, 300)] + ["ab" * n for n in range(1, 300)]
    assert len(set(textops.words(texts)[0].tolist())) == len(set(texts))
    alone = [textops.words([t])[0][0] for t in texts]
    assert alone == textops.words(texts)[0].tolist()


# 1. N-gram Jaccard join.


def brute_links(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= threshold * len(a | b)):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    brute_links.classes = len({root(i) for i in range(len(rows))})
    return Counter((d, least.get(root(i)), links[i]) for i, (d, _) in enumerate(rows))


def near_rows():
    rows, rng, n = [], np.random.default_rng(3), 100
    for g in range(12):
        w = prose(100 + g, 120).split()
        rows.append((n, " ".join(w)))
        n += 1
        for k in range(g):
            c = list(w)
            for p in rng.choice(len(c), k % 5, replace=False):
                c[p] = f"new{n}"
            rows.append((n, " ".join(c).upper() if k % 2 else " ".join(c)))
            n += 1
    return rows


@pytest.mark.parametrize("block", [1_000_000, 600])
def test_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(ngram_join, "SIG_BLOCK", 2048 if block > 1000 else 5)
    rows = edge_rows() + near_rows()
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_classes(table(spark, rows)).collect())
    assert got == brute_links(rows)


def test_dedup_keeps_one_of_each_class(spark):
    rows = edge_rows() + near_rows()
    kept = ngram_join.deduplicate(table(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
    brute_links(rows)
    assert kept.count() == brute_links.classes
    assert ngram_join.deduplicate(table(spark, [])).count() == 0


def test_shortening_follows_the_pairs():
    floor = ngram_join.least_depth()
    assert ngram_join.chance(0.8, floor) >= ngram_join.TARGET_RECALL > ngram_join.chance(0.8, floor + 1)
    told = lambda found, at, d: ngram_join.expected_recall(found, at, d, 0.8, 20, 8)
    assert told({158: 50}, 8, 8) > 0.9999 and told({}, 8, 8) is None and told({100: 9}, 8, 8) is None
    # Pairs at 0.8 are found at full depth with a chance of 0.975: 975 found stand for 1,000.
    assert abs(told({128: 975}, 8, 8) - ngram_join.chance(0.8, 8)) < 1e-9
    mixed = {128: 975, 158: 1000}
    assert told(mixed, 8, 8) < told(mixed, 8, 7) < told(mixed, 8, 6) < told(mixed, 8, 5)


def changed(seed, words, changes):
    """A text of ``words`` words, and one of it with ``changes`` of them replaced."""
    rng = np.random.default_rng(seed)
    a = [f"w{x}" for x in rng.integers(0, 10**6, words)]
    b = list(a)
    for p in rng.choice(words, changes, replace=False):
        b[p] = f"z{rng.integers(0, 10**6)}"
    return " ".join(a), " ".join(b)


@pytest.mark.parametrize("changes, depths", [(0.002, {8}), (0.019, {5, 6})])
def test_forest_depth_depends_on_the_data(spark, changes, depths):
    rows = [(2 * i + k, t) for i in range(150) for k, t in enumerate(changed(i, 500, max(1, int(500 * changes))))]
    sigs = ngram_join.signatures(spark.createDataFrame(rows, "doc_id long, text string"))
    _, depth, recall = ngram_join.search_forest(sigs.select("set_id", "sig"))
    assert depth in depths and (recall >= ngram_join.TARGET_RECALL or depth == ngram_join.least_depth())


def test_forest_recall_against_all_pairs(spark):
    """Pairs from 0.8 on, most of them near it, among many that are not alike."""
    rows = [(2 * i + k, t) for i in range(400) for k, t in enumerate(changed(1000 + i, 200, 1 + i % 6))]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute_links(rows)
    links = sum(k[2] * n for k, n in want.items())
    assert links > 400 and sum(k[2] * n for k, n in got.items()) >= 0.99 * links and sum((got & want).values()) >= 0.99 * len(rows)


def test_structured_documents_are_no_copies(spark):
    rows = [(i, w) for n in (1024, 2048, 4096) for i, w in enumerate(thue_morse(n), n)]
    assert {(r.doc_id, r.n_links) for r in ngram_join.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(i, 0) for i, _ in rows}


def test_components_with_hubs_and_chains(spark):
    from millrace.llm.components import connected_components

    edges = [(0, i) for i in range(1, 500)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(500)}, **{1000 + i: 1000 for i in range(41)}, 2000: 2000, 2001: 2000, 2002: 2000}


def test_skewed_joins_are_joins(spark):
    from millrace.llm.shared import join_salted, join_skewed

    left = spark.createDataFrame([(0 if i < 60 else i % 7, i) for i in range(100)], "k int, v int")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, left.join(right, "k").collect()))
    for got in (join_skewed(left, right, "k", "n", 100, 10, 2), join_skewed(left, right, "k", "n", 100), join_salted(left, right, "k", "v")):
        assert sorted(map(tuple, got.select("k", "v", "n").collect())) == want


# 2. Benchmark decontamination.


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers_is_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        p, t = ("".join(rng.choice(list("abc"), n)) for n in (rng.integers(1, 12), rng.integers(0, 30)))
        want = edit_distance_in(p, t)
        got = decontaminate.myers(p, t, len(p))
        assert got is not None and got[0] == want if want <= len(p) else got is None


def test_leaks_match_brute_force(spark):
    rng, items = np.random.default_rng(7), [(i, prose(200 + i, 25)) for i in range(6)] + [(90, None), (91, ""), (92, "tiny"), (93, prose(200, 25))]
    rows = edge_rows()
    for n in range(40):
        text = list(items[n % 6][1])
        for p in rng.integers(0, len(text), n % 14 * 2):
            text[p] = "q"
        rows.append((1000 + n, prose(n, 40) + " " + "".join(text).upper() + "\n" + prose(n + 1, 40)))
    found = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leak_report(table(spark, rows), found, block_chars=300).collect()}
    want = {}
    for d, t in rows:
        for i, x in items:
            p, text = decontaminate.normal(x or ""), decontaminate.normal(t or "")
            if p and len(text) < 5000 and (dist := edit_distance_in(p, text)) <= decontaminate.budget(len(p)):
                want[d, i] = dist
    assert got == want and len({d for _, d in want}) == 7 and max(want.values()) > 3
    clean = decontaminate.drop_leaks(table(spark, rows), found)
    assert clean.count() == sum(1 for d, _ in rows if not any(k[0] == d for k in want))
    assert decontaminate.leak_report(table(spark, []), found).count() == 0


def test_pieces_are_found_wherever_they_occur(monkeypatch):
    """The lookup of pieces against a plain search, short items and pieces that share their beginning included."""
    monkeypatch.setattr(decontaminate, "HASH_CHARS", 100)
    items = [(i, prose(300 + i % 7, 8 + i % 20)) for i in range(30)] + [(40, "abc"), (41, "a"), (42, None), (43, "  "), (44, "ab ab ab ab ab ab ab ab ab ab")]
    matcher = decontaminate.Matcher(items, 0.15)
    texts = [decontaminate.normal(t) for t in (*(prose(300 + i, 200) for i in range(8)), "", "abc", "ab ab ab ab ab", "xabcx a", items[3][1] + "zz")]
    got = {(int(t), int(p), int(k)) for t, p, k in zip(*matcher.hits(texts), strict=True)}
    want, parts = set(), []
    for i, (_, item, k) in enumerate(matcher.items):
        own = list(decontaminate.halves(len(item), k))
        assert own[0][0] == 0 and own[-1][1] == len(item) and all(x[1] == y[0] for x, y in zip(own, own[1:])) and len(own) == k + 1
        assert k == 0 or min(b - a for a, b in own) >= decontaminate.MIN_PIECE
        parts += [item[a:b] for a, b in own]
        for a, _ in own:
            around = decontaminate.parts_around(len(item), k, a)
            assert all(x <= a < y and e > 0 for x, y, e in around) and all(x[1] - x[0] < y[1] - y[0] for x, y in zip(around, around[1:]))
    for t, text in enumerate(texts):
        for k, piece in enumerate(parts):
            want |= {(t, p, k) for p in range(len(text) - len(piece) + 1) if text.startswith(piece, p)}
    assert got == want and len(want) > 100
    assert [matcher.matches(t) for t in texts] == [dict(matcher.matches_of(texts)).get(i, []) for i in range(len(texts))]
    assert decontaminate.Matcher([], 0.1).matches("abc") == []


def test_a_full_block_of_items_stays_small():
    """4,000,000 characters of items, in a process of its own."""
    import subprocess
    import sys

    code = """
import random, resource
from millrace.llm import decontaminate
r, letters = random.Random(1), "abcdefghijklmnopqrstuvwxyz     "
items = [(i, "".join(r.choices(letters, k=2000))) for i in range(2000)]
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak()
matcher = decontaminate.Matcher(items, 0.1)
print(int(peak() - before), sum(len(t) for _, t, _ in matcher.items) > 3_000_000, matcher.matches("x" * 50 + items[7][1] + "y")[0][:2])
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}, timeout=300, check=True).stdout.split(maxsplit=2)
    assert int(out[0]) < 300 and out[1] == "True" and out[2].strip() == "(7, 0)"


def test_a_process_keeps_one_matcher():
    items = [(1, "some benchmark text"), (2, "another one of them")]
    first = decontaminate._matcher(1, items, 0.1)
    assert decontaminate._matcher(1, items, 0.1) is first and decontaminate._matcher(2, items, 0.1) is not first
    assert decontaminate._matcher(1, items, 0.1) is not first


# 3. and 4. Classifiers.


def labelled(spark, n=600):
    rng, rows, labels = np.random.default_rng(2), [], []
    for i in range(n):
        good, toxic = i % 5 != 0, i % 4 == 1
        t = prose(i, 60)
        if not good:
            t = " ".join(w.upper() + "$$$" for w in t.split()[:20]) * 2
        if toxic:
            t += " " + " ".join(rng.choice(["vile", "nasty", "rotten", "foul"], 3)) if i % 8 == 1 else " " + " ".join(rng.choice(["mies", "fies", "übel"], 2))
        rows.append((i, t))
        labels.append((i, int(good), int(toxic)))
    return rows, spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_quality_ranks_held_out_rows(spark):
    rows, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.score_quality(table(spark, rows), labels).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[i].predicted == (i % 5 != 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_quality_ignores_held_out_labels(spark):
    rows, labels = labelled(spark, 200)
    a = {r.doc_id: r.score for r in quality.score_quality(table(spark, rows), labels).collect()}
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    b = {r.doc_id: r.score for r in quality.score_quality(table(spark, rows), turned).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_quality_edges(spark):
    _, labels = labelled(spark, 10)
    for few in (labels, labels.filter("quality = 1"), labels.filter("false")):
        got = quality.score_quality(table(spark, edge_rows()), few).collect()
        assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(table(spark, []), labels).count() == 0


def test_toxicity_chain(spark):
    rows, labels = labelled(spark)
    chain = toxicity.fit_toxicity(table(spark, rows), labels)
    assert chain.names[-1] == "toxic" and len(chain.names) >= 3
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(table(spark, rows), chain).collect()}
    assert all(got[i] == int(i % 4 == 1) for i in range(600))
    kept = toxicity.drop_toxic(table(spark, rows), labels)
    assert kept.count() == 450 and kept.columns == [c.split()[0] for c in DOC.split(", ")]
    assert len(toxicity.score_toxicity(table(spark, edge_rows()), chain).collect()) == len(edge_rows())


def test_toxicity_edges(spark):
    rows, labels = labelled(spark, 40)
    for few in (labels.filter("toxic = 0"), labels.filter("false")):
        chain = toxicity.fit_toxicity(table(spark, rows), few)
        assert {r.predicted for r in toxicity.score_toxicity(table(spark, rows), chain).collect()} == {0}
    chain = toxicity.fit_toxicity(table(spark, []), labels)
    assert toxicity.score_toxicity(table(spark, []), chain).count() == 0
    given = toxicity.fit_toxicity(table(spark, rows), labels.withColumn("rude", F.col("toxic")), categories=("rude",))
    assert given.names == ("rude", "toxic")


def plain_statistics(t):
    """Some of the statistics by plain Python."""
    w = re.findall(r"[^\W_]+", t.lower())
    lines = [x for x in t.split("\n") if x.strip()]
    return {
        "log_chars": np.log1p(len(t)), "log_words": np.log1p(len(w)), "word_length": np.log1p(np.mean([len(x) for x in w]) if w else 0), "upper": (sum(c.isupper() for c in t) / max(1, len(t))) ** 0.5,
        "digit": (sum(c.isdigit() for c in t) / max(1, len(t))) ** 0.5, "space": sum(c.isspace() for c in t) / max(1, len(t)), "top_word": (max(Counter(w).values(), default=0) / max(1, len(w))) ** 0.5,
        "distinct_words": np.log((len(set(w)) + 1) / (max(1, len(w)) + 1)), "repeated_lines": (1 - len(set(lines)) / len(lines) if lines else 0) ** 0.5, "log_line_words": np.log1p(len(w) / max(1, len(lines))),
    }


def test_statistics_match_plain_python():
    texts = [prose(1, 50), "", "One. Two!\nOne. Two!\n\nTHREE 33", "a", " \n "]
    got = quality.statistics(texts)
    for row, t in zip(got, texts):
        for name, want in plain_statistics(t).items():
            assert abs(row[quality.STATISTICS.index(name)] - want) < 1e-9, (name, t)


def test_quality_is_a_naive_discriminant(spark):
    """Scores from class densities with explicit inverses and determinants, over all rows at once."""
    rows, labels = labelled(spark, 300)
    got = {r.doc_id: r.score for r in quality.score_quality(table(spark, rows), labels).collect()}
    x = quality.statistics([t for _, t in rows])
    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality is not None}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    z = (x - x[train].mean(0)) / (np.sqrt(np.maximum(x[train].var(0), 1e-12)) + 1e-6)
    own = {k: z[[i for i in train if y[i] == k]] for k in (0, 1)}
    cov = {k: np.cov(v.T, bias=True) for k, v in own.items()}
    pooled = sum(len(own[k]) * cov[k] for k in own) / len(train)
    density = []
    for k in (0, 1):
        c = (1 - quality.POOLING) * cov[k] + quality.POOLING * pooled
        c = (1 - quality.SHRINKAGE) * c + quality.SHRINKAGE * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
        d = z - own[k].mean(0)
        density.append(np.log(len(own[k]) / len(train)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / quality.TEMPERATURE, -700, 700)))
    assert max(abs(got[i] - want[i]) for i, _ in rows) < 1e-6


def plain_chain(chain, text):
    """The chain's probabilities of a text, word by word."""
    h, _, _, _ = textops.words([text])
    own = set(h.tolist())
    seen = []
    for w in chain.weights:
        width = len(chain.vocabulary)
        z = w[-1] + sum(w[j] for j, v in enumerate(chain.vocabulary.tolist()) if v in own) + sum(w[width + j] * p for j, p in enumerate(seen))
        seen.append(1 / (1 + np.exp(-z)))
    return seen


def test_toxicity_scores_and_rejections_match_plain_python(spark):
    rows, labels = labelled(spark, 300)
    rows += [(1000, "vile prose"), (1001, ""), (1002, None), (1002, "mies " * 20_000)]
    docs = table(spark, rows)
    chain = toxicity.fit_toxicity(docs, labels)
    want = Counter((d, tuple(round(float(p), 9) for p in plain_chain(chain, t or ""))) for d, t in rows)
    got = Counter((r.doc_id, tuple(round(p, 9) for p in [*r.categories, r.score])) for r in toxicity.score_toxicity(docs, chain).collect())
    assert got == want
    kept = Counter((r.doc_id, r.text) for r in toxicity.drop_toxic(docs, labels).collect())
    assert kept == Counter((d, t) for d, t in rows if plain_chain(chain, t or "")[-1] < toxicity.REJECT)


def test_logistic_fit_is_the_optimum():
    rng = np.random.default_rng(8)
    dense = (rng.random((200, 12)) < 0.3).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(-(dense @ rng.normal(0, 2, 12))))).astype(float)
    row, column = np.nonzero(dense)
    x = toxicity.Rows(column, np.searchsorted(row, np.arange(201)))
    rows = rng.random(200) < 0.8
    w = toxicity.fit_logistic(x, np.zeros((200, 0)), y, rows, 12)
    full, ridge = np.column_stack([dense, np.ones(200)])[rows], np.append(np.full(12, toxicity.L2), 1e-6)
    v = np.zeros(13)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ v))
        v -= np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(ridge), full.T @ (p - y[rows]) + ridge * v)
    assert np.abs(w - v).max() < 0.02


def test_a_fold_is_chosen_without_its_labels(spark):
    rows, _ = labelled(spark, 300)
    words = [np.unique(textops.words([t])[0]).view(np.int64).tolist() for _, t in rows]
    sample = [(int(i % 4 == 1), i % 3, w) for (i, _), w in zip(rows, words)]
    turned = [(1 - y if k == 1 else y, k, w) for y, k, w in sample]
    schema = "label long, fold int, words array<long>"
    a, b = (toxicity.telling_words(spark.createDataFrame(s, schema))[0] for s in (sample, turned))
    assert a[2].tolist() == b[2].tolist() and len(a[2]) and a[0].tolist() != b[0].tolist() and a[1].tolist() != b[1].tolist()


def test_toxicity_sees_wordings_with_few_labels(spark):
    """A wording that five of 44 toxic labelled documents share, and no other, is known afterwards."""
    kinds = ["zorro malo"] * 5 + ["nasty slur"] * 39 + ["talk"] * 356
    rows = [(i, f"{kind}, talk about the town, part {i}") for i, kind in enumerate(kinds)]
    labels = spark.createDataFrame([(i, int(i < 44)) for i in range(400)], "doc_id long, toxic int")
    chain = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    new = spark.createDataFrame([(1000, "zorro malo, talk about the town"), (1001, "nasty slur, talk about the town"), (1002, "talk about the town")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(new, chain).collect()}
    assert got == {1000: 1, 1001: 1, 1002: 0}


# 5. Chat formatting.

CONV = "conv_id long, turn long, role string, text string, record string"
HARD = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|", "\\", "<\\\\|im_end|>", "ends with <", "|starts", "", None, "\x01 é🙂\r\n", '{"a":"b"}', "\\|<|<||"]


def test_chat_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "r") for i, t in enumerate(HARD)] + [(2, 0, None, "x", None), (2, 0, "odd\nrole<%0A", "y", None), (None, 1, "user", "z", None), (3, None, "assistant", "w", None), (3, None, "assistant", "w", None)]
    df = spark.createDataFrame(rows, CONV)
    formatted = chat_format.format_records(chat_format.turns_to_records(df))
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    convs = defaultdict(list)
    for c, n, role, text, _ in rows:
        convs[c].append(((n is not None, n or 0), role or "", text or ""))
    for c, turns in convs.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.turns_to_records(df.filter("false")).count() == 0


def test_layouts_by_fingerprint(spark):
    records = [
        ('{"messages":[{"content":"a","role":"user"},{"role":"assistant","content":"b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"completion":"b","prompt":"a"}', [("user", "a"), ("assistant", "b")]),
        ('{"system":"s","prompt":"a","response":"b"}', [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ('{"instruction":"a","input":"x","output":"b"}', [("user", "a\n\nx"), ("assistant", "b")]),
        ('{"question":"a","answer":"b"}', [("user", "a"), ("assistant", "b")]),
        ('{"unheard":"a"}', None), ("no json", None), (None, None), ("[1]", None), ('{"messages":"a"}', None), ('{"prompt":"a"}', None),
        ('{"id":7,"messages":[{"role":"user","content":"a","name":"n"}],"meta":{"role":"x"}}', [("user", "a")]),
        ('{"messages":[]}', []),
        ('{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image","url":"u"},"b"]},{"role":"assistant","content":"c"}]}', [("user", "a\nb"), ("assistant", "c")]),
        ('{"messages":[{"role":"user","content":[{"type":"text","text":"a"}]}]}', [("user", "a")]),
        ('{"prompt":[{"role":"user","content":"a"}],"completion":"b"}', [("user", "a"), ("assistant", "b")]),
        ('{"prompt":[{"role":"user","content":"a"}],"completion":[{"role":"assistant","content":"b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"instruction":"a","input":"","output":"b","history":[["q","r"],["s","t"]]}', [("user", "q"), ("assistant", "r"), ("user", "s"), ("assistant", "t"), ("user", "a"), ("assistant", "b")]),
        ('{"instruction":"a","output":"b","history":[]}', [("user", "a"), ("assistant", "b")]),
        ('{"prompt":"a","chosen":"b","rejected":"c"}', [("user", "a"), ("assistant", "b")]),
        ('{"chosen":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"rejected":[{"role":"user","content":"a"}],"score":0.5}', [("user", "a"), ("assistant", "b")]),
        ('{"prompt":"a","chosen":[{"role":"assistant","content":"b"}],"rejected":[]}', [("user", "a"), ("assistant", "b")]),
        ('{"prompt":"a","chosen":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"prompt":[{"role":"user","content":"a"}],"chosen":[{"role":"assistant","content":"b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"system":"s","messages":[{"role":"user","content":"a"}]}', [("system", "s"), ("user", "a")]),
        ('{"messages":[{"role":"user","content":null},{"role":"assistant"}]}', [("user", ""), ("assistant", "")]),
        ('{"conversations":[{"from":"human","value":"a","weight":1}],"id":"x"}', [("user", "a")]),
        ('{"question":"a","answer":"b","url":"c"}', [("user", "a"), ("assistant", "b")]),
        ('{"messages":[{"role":"user","content":"a"}],"completion":"x"}', [("user", "a")]),
        ('{"answer":"x","messages":[{"role":"user","content":"a"}],"question":"y"}', [("user", "a")]),
        ('{"conversations":[{"from":"human","value":"a"}],"prompt":"x"}', [("user", "a")]),
        ('{"conversations":[{"from":"human","value":"a"}],"prompt":[{"role":"user","content":"x"}]}', [("user", "a")]),
        ('{"instruction":"a","output":"b","response":"x"}', [("user", "a"), ("assistant", "b")]),
        ('{"instruction":"a","prompt":"x","response":"b"}', [("user", "a"), ("assistant", "b")]),
        ('{"question":"a","response":"b"}', [("user", "a"), ("assistant", "b")]),
        ('{"query":"a","response":"b"}', [("user", "a"), ("assistant", "b")]),
        ('{"query":"a","answer":"b","system":"s"}', [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ('{"output":"b","response":"x"}', None), ('{"messages":"a","question":"b","answer":"c"}', [("user", "b"), ("assistant", "c")]),
        ('{"messages":[{"role":"human","content":"a"}]}', [("human", "a")]),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(records)], "i int, record string")
    got = {r.i: r.turns for r in chat_format.format_records(df).collect()}
    for i, (_, want) in enumerate(records):
        assert (got[i] and [tuple(t) for t in got[i]]) == want, i


def test_fingerprints_select_one_layout_each():
    seen = [frozenset((*x.required, *c)) for x in chat_format.LAYOUTS for n in range(len(x.optional) + 1) for c in chat_format.combinations(x.optional, n)]
    real = [s for s in seen if all(p.split("[].")[0] + "[]" in s for p in s if "[]." in p) and not any(p + "[]" in s for p in s if "[" not in p)]
    assert len(real) == len(set(real)) and len(real) > 200


def test_rows_go_through_several_layouts(spark):
    rows = [(c, n, "assistant" if n % 2 else "user", f"{c} {HARD[(c + n) % len(HARD)]}", "r") for c in range(200) for n in range(2 if c % 3 else 5)] + [(500, 0, "human", "x", "r"), (501, 0, "gpt", "y", "r")]
    df = spark.createDataFrame(rows, CONV)
    plain, mixed = (chat_format.turns_to_records(df, x) for x in (("turns",), ("turns", "messages", "conversations", "prompt_response")))
    assert mixed.select(chat_format.fingerprint(F.col("record"))).distinct().count() == 4
    a, b = (sorted(map(tuple, chat_format.digests(chat_format.format_records(x)).collect())) for x in (plain, mixed))
    assert a == b and len(a) == 202


def test_very_many_turns_stay_cheap(spark):
    import time

    rows = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "cast(id as string) as text")
    began = time.time()
    r = chat_format.digests(chat_format.format_records(chat_format.turns_to_records(rows))).first()
    assert r.n_turns == 20_000 and r.loss_chars == sum(len(str(i)) for i in range(1, 20_000, 2)) and time.time() - began < 60


# 6. Secret scans.


def brute_base(text):
    out = []
    for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


SECRETS = [
    "password = token: abcdefgh", "secret=token=abcdefgh", 'API_KEY": "abc123xyz" and apikey=short', "é🙂 passwd: aaaaaa" + "f" * 30, "AKIAAKIA" + "Z" * 12 + "AKIA1", "AKIA" + "0" * 16 + " AKIA" + "1" * 15,
    "deadbeef" * 3 + "x" + "0" * 23, "user=bob pwd=hunter22 https://db.example.com/x", "pwd=hunter22 alone", "https://lonely.example.com", "x" * 500 + "user=bob" + " " * 400 + "pwd=hunter22", "token:'a=b/c+d.e_f-'",
]


def brute_linked(text, scope):
    """Spans and links by comparing all parts with each other."""
    parts = brute_base(text)
    for rank, (kind, pattern) in enumerate((("identifier", secret_scan.IDENTIFIER), ("weak", secret_scan.WEAK), ("endpoint", secret_scan.ENDPOINT)), 3):
        parts += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text, re.A)]
    parts.sort()
    name = lambda p: f"{p[3]}:{p[0]}:{p[2]}"

    def near(one, kinds):
        own = [p for p in parts if p[3] in kinds and p[0] < one[2] + scope and p[2] > one[0] - scope and p != one]
        before = [p for p in own if p < one]
        return max(before, key=lambda p: (p[2], p)) if before else min(own) if own else None

    spans, links = [], []
    for p in parts:
        access, secret = near(p, ("access", "identifier")), near(p, ("assign", "weak"))
        partners = {"weak": [access], "identifier": [secret], "endpoint": [access, secret]}.get(p[3], [])
        if all(partners):
            spans.append(name(p))
            links += [f"{name(p)}>{name(x)}" for x in partners]
    return ",".join(spans), ",".join(links)


def test_linked_spans_match_brute_force(spark):
    rng = np.random.default_rng(9)
    atoms = ["USERNAME=bob", "db_user: x_y", "login='me@x'", "PWD=hunter22", "pass: aaaaaaa", "AWS_SECRET_ACCESS_KEY=abcdef0", "https://db.example.com/x", "postgres://h/db", "AKIA" + "Q" * 16, "token=zzzzzzzz", "deadbeef" * 4]
    atoms += ["aB3" + "x" * 37, "é🙂", "\n", "word", "superuser=bob", "passing: 1234567"]
    rows = [(i, "".join(atoms[k] + " " * int(rng.integers(1, 60)) for k in rng.integers(0, len(atoms), rng.integers(0, 40)))) for i in range(300)]
    for scope in (0, 20, 200):
        found = secret_scan.scan(table(spark, rows), scope)
        named = lambda c: F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        pairs = F.transform("links", lambda x: F.concat_ws(">", named(F.array(x["part"]))[0], named(F.array(x["partner"]))[0]))
        got = {r.doc_id: (r.a, r.b) for r in found.select("doc_id", F.array_join(named("spans"), ",").alias("a"), F.array_join(pairs, ",").alias("b")).collect()}
        assert got == {i: brute_linked(t, scope) for i, t in rows}, scope
    assert sum(">" in b for _, b in got.values()) > 100


def test_dense_texts_stay_cheap(spark):
    """Very many spans in one text: each is found and masked, in seconds."""
    import time

    text = "".join(f"{i:024x} é user=u{i} " for i in range(20_000))
    began = time.time()
    r = secret_scan.digests(table(spark, [(1, text)])).first()
    assert r.n_hex == 20_000 and r.base_sha256 == hashlib.sha256(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in brute_base(text)).encode()).hexdigest()
    dense = " ".join(f"{i:024x}" for i in range(20_000))
    got = secret_scan.redact(table(spark, [(1, dense)])).first().text
    assert got == " ".join(["[SECRET]"] * 20_000) and time.time() - began < 60


def test_secret_spans(spark):
    rows = edge_rows() + list(enumerate(SECRETS, 500))
    got = sorted((r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secret_scan.digests(table(spark, rows)).collect() if r.doc_id is not None)
    want = []
    for d, t in rows:
        if d is not None:
            b = brute_base(t or "")
            k = Counter(x[3] for x in b)
            want.append((d, hashlib.sha256(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in b).encode()).hexdigest(), k["assign"], k["access"], k["hex"]))
    assert got == sorted(want)
    spans = {r.doc_id: r.spans for r in secret_scan.digests(table(spark, rows)).collect()}
    assert spans[507] == "identifier:0:8,weak:9:21,endpoint:22:46" and spans[508] == "" and spans[509] == "" and spans[510] == ""
    masked = {r.doc_id: r.text for r in secret_scan.redact(table(spark, rows)).collect()}
    assert masked[507] == "[SECRET] [SECRET] [SECRET]" and masked[508] == SECRETS[8] and masked[1] is None
    assert secret_scan.redact(table(spark, rows)).columns == table(spark, []).columns
    assert secret_scan.scan(table(spark, [])).count() == 0


# 7. and 9. Tokens.


class Colliding(tokens.CachedEncoder):
    """All chunks of one length have one key."""

    _keys = staticmethod(lambda cp, start, end: (end - start).astype(np.uint64) % np.uint64(3))


def test_chunks_are_compared_with_the_cache():
    odd = [w for n in (512, 1024, 2048, 4096) for w in thue_morse(n)]
    texts = odd + [" ".join(odd)] + [t or "" for _, t in edge_rows()[5:]] + ODD + [prose(i, 30) for i in range(5)]
    for enc in (tokens.CachedEncoder(tokens.default_tokenizer()), Colliding(tokens.default_tokenizer())):
        for group in (100, 4):
            for a in range(0, len(texts), group):
                ids, at = enc.encode(texts[a : a + group])
                for k, t in enumerate(texts[a : a + group]):
                    assert ids[at[k] : at[k + 1]].tolist() == brute_ids(t, 0)[:-1]


def brute_ids(text, end):
    return tokens.encoder(tokens.default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["  a  b\n\n c \t d ", "x <|endoftext|>  y", "a\n b\n\nc 's don't  ", "'sort 's*'s. can't,x ***the'll 12.5%a ab'.\n'd", "　  a b", "A" * 3000]


def test_cached_encoding_is_exact():
    texts = [t or "" for _, t in edge_rows()] + ODD + [prose(i, 50) for i in range(20)]
    small = tokens.CachedEncoder(tokens.default_tokenizer(), cache_chunks=40)
    for _ in range(2):
        for enc, group in ((small, 3), (tokens.encoder(tokens.default_tokenizer()), 100)):
            for a in range(0, len(texts), group):
                ids, at = enc.encode(texts[a : a + group])
                for k, t in enumerate(texts[a : a + group]):
                    assert ids[at[k] : at[k + 1]].tolist() == brute_ids(t, 0)[:-1]


def test_token_files(spark):
    rows = edge_rows() + list(enumerate(ODD, 300))
    path = new_path(spark, "test-tokens")
    token_files.write_tokens(table(spark, rows), path)
    got = [tuple(r) for r in token_files.token_index(spark, path).orderBy("start").collect()]
    want, start, hashes = [], 0, hashes_of(spark, rows)
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1] or "")):
        ids = brute_ids(t, 2)
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    part = token_files.read_tokens(spark, path, ("doc_id", "n_tokens"), 300, 302)
    assert sorted(r.doc_id for r in part.collect()) == [300, 301, 302]
    assert token_files.tokens_table(spark, table(spark, [])).count() == 0


def test_token_files_lie_in_order_whatever_their_number(spark):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = new_path(spark, "test-many")
    folder = path.removeprefix("file://")
    os.makedirs(folder)
    lists = [brute_ids(prose(i, 3), 2) for i in range(40)]
    for number, a in ((99_999, 0), (100_000, 10), (100_001, 20), (1_000_000, 30)):
        own = lists[a : a + 10]
        made = pa.table({"doc_id": pa.array(range(a, a + 10), pa.int64()), "n_tokens": pa.array(map(len, own), pa.int64()), "ids": pa.array(own, pa.list_(pa.int32()))})
        pq.write_table(made, f"{folder}/part-{number:05d}-x-c000.parquet")
    got = [tuple(r)[:3] for r in token_files.token_index(spark, path).orderBy("start").collect()]
    n = [len(x) for x in lists]
    assert got == [(i, sum(n[:i]), n[i]) for i in range(40)]


def test_token_files_hold_what_their_options_say(spark):
    import pyarrow.parquet as pq

    path = new_path(spark, "test-layout")
    rows = [(i, prose(i, 400)) for i in range(3000)]
    docs = table(spark, rows).coalesce(1)
    token_files.tokenize(docs.orderBy("doc_id").coalesce(1)).write.options(**token_files.parquet_options(1, 16)).parquet(path)
    (name,) = [n for n in os.listdir(path.removeprefix("file://")) if n.startswith("part-")]
    meta = pq.ParquetFile(f"{path.removeprefix('file://')}/{name}").metadata
    assert meta.num_row_groups > 1 and meta.num_rows == 3000
    for g in range(meta.num_row_groups):
        doc, n, ids = (meta.row_group(g).column(k) for k in range(3))
        assert "DELTA_BINARY_PACKED" in doc.encodings and "DELTA_BINARY_PACKED" in n.encodings and not doc.has_dictionary_page
        assert ids.has_dictionary_page and all(c.has_column_index and c.has_offset_index for c in (doc, n, ids))
    plan = token_files.read_tokens(spark, path, ("doc_id", "n_tokens"), 10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,10)" in plan


def hashes_of(spark, rows):
    return {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}


def test_slack_spares_short_documents():
    sizes = np.random.default_rng(6).integers(1, 2000, 4000)
    cut = {}
    for slack in (0, packing.SLACK):
        packer = packing.Packer(2048, packing.OPEN_WINDOWS, slack)
        for i, n in enumerate(sizes.tolist()):
            packer.add(i, 0, n, np.zeros(n, np.int32))
        sequences = [*packer.done, *packer.open]
        assert min(sum(len(p[3]) for p in s) for s in packer.done) >= 2048 - slack
        assert len(packer.open) <= packing.OPEN_WINDOWS and packer.free == sorted(packer.free)
        assert sum(len(p[3]) for s in sequences for p in s) == sizes.sum()
        cut[slack] = sum(v > 1 for v in Counter(p[0] for s in sequences for p in s).values())
    assert cut[packing.SLACK] < 0.5 * cut[0]


@pytest.mark.parametrize("size, windows", [(2048, 16), (64, 3)])
def test_packing(spark, size, windows):
    rows = [(i, t) for i, (_, t) in enumerate(edge_rows() + [(0, prose(i, 40 + i)) for i in range(60)])]
    pieces = packing.piece_digests(packing.pack(table(spark, rows).repartition(5), size=size, windows=windows)).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for d, t in rows:
        ids, own = brute_ids(t, 1), sorted(docs[d], key=lambda p: p.start)
        at = 0
        for p in own:
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    lengths = []
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own[:-1])]).tolist()
        lengths.append(sum(p.length for p in own))
    assert max(lengths) <= size and all(n >= size - size // 32 or n & (n - 1) == 0 for n in lengths)
    assert packing.pack(table(spark, [])).count() == 0


# 8. Suffix-array deduplication.


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(400):
        a = rng.integers(0, rng.integers(1, 6) + 1, rng.integers(0, 60)).tolist()
        assert suffix_dedup.suffix_array(np.array(a, np.int64)).tolist() == sorted(range(len(a)), key=lambda i: a[i:])


def brute_removed(rows, length):
    seen, out = set(), Counter()
    order = sorted({(d if d is not None else suffix_dedup.NULL_ID, h, t or "") for d, h, t in rows})
    done = {}
    for d, h, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if (g := b[i : i + length]) in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(g)
        done[d, h] = (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    for d, h, _ in rows:
        out[(d, *done[d if d is not None else suffix_dedup.NULL_ID, h])] += 1
    return out


@pytest.mark.parametrize("array_bytes, send, hot, sampled", [(400_000, 1_500_000, 20_000, 40), (2_000, 50, 3, 40), (400_000, 1_500_000, 20_000, 2), (2_000, 500, 1, 2)])
def test_repeats_match_brute_force(spark, monkeypatch, array_bytes, send, hot, sampled):
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", array_bytes)
    monkeypatch.setattr(suffix_dedup, "SEND_ROWS", send)
    monkeypatch.setattr(suffix_dedup, "HOT_CONTENTS", hot)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_CONTENTS", sampled)
    rng, shared = np.random.default_rng(4), [prose(700 + i, 60) for i in range(4)]
    rows = edge_rows() + near_rows()[:30] + [(2000 + i, prose(i, 20) + " " + shared[i % 4][int(rng.integers(0, 90)) :] + prose(50 + i, 20)) for i in range(40)] + [(3000, "ab" * 400), (3001, "ba" * 300), (3002, "x" * 99), (3003, "x" * 100), (3004, "x" * 101)]
    df = table(spark, rows).repartition(4)
    hashes = hashes_of(spark, rows)
    got = Counter(tuple(r) for r in suffix_dedup.digests(df).collect())
    assert got == brute_removed([(d, hashes[t], t) for d, t in rows], 100)
    assert suffix_dedup.digests(table(spark, [])).count() == 0


def test_one_phrase_among_thousands_of_neighbours(spark):
    """An anchor with thousands of contents, some of which share windows: split or not, the result is one."""
    rng, phrase = np.random.default_rng(12), prose(41, 12)[:70]
    left, right = [prose(i, 9)[-40:] for i in range(40)], [prose(500 + i, 9)[:40] for i in range(40)]
    rows = []
    for i in range(3000):
        a, b = rng.integers(0, 40, 2)
        rows.append((i, f"{i:07d}{chr(97 + i % 26) * int(rng.integers(0, 3))}{left[a][int(rng.integers(0, 30)):]}{phrase}{right[b][: int(rng.integers(3, 40))]}{i * 7919:09d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashes = hashes_of(spark, rows)
    want = brute_removed([(d, hashes[t], t) for d, t in rows], 100)
    hot = suffix_dedup.hot_anchors(suffix_dedup.keyed(df), 100)
    assert len(hot) and Counter(tuple(r) for r in suffix_dedup.digests(df).collect()) == want
    assert sum(r[2] > 0 for r in want) > 500
    found = suffix_dedup.keyed(df)
    met = suffix_dedup.meet(suffix_dedup.find_runs(found, 100, hot))
    assert met.filter(f"kind = {suffix_dedup.HOT}").count() > 1000


def test_split_runs_cover_all_windows_once():
    whole = [prose(i, 200).encode() for i in range(20)]
    doc, start, count, _, _ = suffix_dedup.runs(whole)
    texts = [whole[d][a : a + n + 99] for d, a, n in zip(doc, start, count)]
    row, first, n, key, _ = suffix_dedup.split_hot(texts, 100)
    got = sorted((int(r), int(f) + k) for r, f, m in zip(row, first, n) for k in range(m))
    assert got == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 99)] and n.max() <= 2


#: Two beginnings of 50 letters whose polynomial hashes (of the base that chooses anchors) are equal
#: modulo 2**64, before an end in which both texts have their anchor.
ALIKE = ("b" * 50, "cdacadcbcabbbaadabccadcbdcbdaaabbddbbaabbcbcdcabbb")
ALIKE_END = "xijmnbafbqisfpeiykynoqovckzimftsexfrzrfecieoavjtucgmdjayjbkkiudjxesahflmlhslgllzfavburhzhapwfckdegkb"


@pytest.mark.parametrize("parts, hot, sampled", [(1, 20_000, 40), (8, 20_000, 40), (8, 1, 40), (8, 1, 1)])
def test_equal_hashes_are_no_equal_bytes(spark, monkeypatch, parts, hot, sampled):
    """In one task, in several, and where the anchor is split: only what is equal goes."""
    monkeypatch.setattr(suffix_dedup, "HOT_CONTENTS", hot)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_CONTENTS", sampled)
    told = [sum((c + 1) * pow(textops._BASE, i, 1 << 64) for i, c in enumerate(a.encode())) % (1 << 64) for a in ALIKE]
    assert told[0] == told[1] and ALIKE[0] != ALIKE[1]
    doc, start, count, anchor, content = suffix_dedup.runs([(a + ALIKE_END).encode() for a in ALIKE])
    assert count.tolist() == [51, 51] and anchor[0] == anchor[1] and content.tolist()[0] != content.tolist()[1]
    rows = [(i, ALIKE[i % 2] + ALIKE_END + more) for i, more in enumerate(("", "", "", "", "z", "zy", "q" * 60, ""))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
    hashes = hashes_of(spark, rows)
    got = Counter(tuple(r) for r in suffix_dedup.digests(df).collect())
    assert got == brute_removed([(d, hashes[t], t) for d, t in rows], 100)
    assert {(r[0], r[2]) for r in got if r[0] < 2} == {(0, 0), (1, 103)}  # the beginnings end alike in three letters


def test_anchors_are_compared_in_parts_of_bounded_size(monkeypatch):
    """Windows of one hash stay together, so parts of any size give the same repeats."""
    rng, phrase = np.random.default_rng(3), prose(5, 12)[:60]
    texts = [f"{''.join(map(chr, rng.integers(97, 99, 30)))}{phrase}{''.join(map(chr, rng.integers(97, 99, 30)))}".encode() for _ in range(300)]
    texts += [t[5:] + b"!" for t in texts[:150]]
    ids, zero = np.arange(len(texts)) // 2, np.zeros(len(texts), np.int64)
    start = np.arange(len(texts)) % 2 * 1000
    longest = []
    made = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda t: longest.append(len(t)) or made(t))
    whole = suffix_dedup.shared_windows(texts, ids, zero, start, zero, 100)
    assert len(whole[0]) > 500 and len(longest) == 1
    seen, want = set(), set()
    for i in np.lexsort((start, ids)).tolist():
        for o in range(len(texts[i]) - 99):
            if (g := texts[i][o : o + 100]) in seen:
                want.add((i, o))
            seen.add(g)
    for most in (longest[0] * 2, 5000, 100):
        longest.clear()
        row, offset = suffix_dedup.shared_windows(texts, ids, zero, start, zero, 100, most)
        assert set(zip(row.tolist(), offset.tolist())) == want == set(zip(*(x.tolist() for x in whole)))
        assert max(longest) <= 2 * most + 101 * 20


# 10. Telephony audio.


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(telephony.STEP[index])
            d = step >> 3
            for bit, s in ((1, step >> 2), (2, step >> 1), (4, step)):
                d += s if n & bit else 0
            value = max(-32768, min(32767, value - d if n & 8 else value + d))
            index = max(0, min(88, index + int(telephony.INDEX_STEP[n])))
            out.append(value)
    return out


def test_tables_and_adpcm():
    assert telephony.MULAW_PCM[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.ALAW_PCM[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    blocks = np.random.default_rng(0).integers(0, 256, (50, 64), dtype=np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [plain_adpcm(bytes(b)) for b in blocks]


def plain_feature(payload):
    """The feature by plain loops over the samples."""
    def told(pcm):
        cross = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        return [int((sum(x * x for x in pcm) // len(pcm)) ** 0.5), max(abs(x) for x in pcm), cross]

    mulaw = [int(telephony.MULAW_PCM[c]) for c in payload]
    alaw = [int(telephony.ALAW_PCM[c]) for c in payload]
    adpcm = [x for a in range(0, len(payload), 64) for x in plain_adpcm(payload[a : a + 64])]
    wide = [y for a, b in zip(mulaw, [*mulaw[1:], mulaw[-1]]) for y in (a, (a + b) >> 1)]
    return ":".join(map(str, [*told(mulaw), *told(alaw), *told(adpcm), zlib.crc32(np.array(wide, "<i2").tobytes())]))


def test_stored_media_are_files_that_hold_both_columns(spark):
    rows = [(i, prose(i, 30)) for i in range(30)] + [(99, None)]
    df = table(spark, rows).withColumns({"__payload": F.lit("p"), "pcm": F.lit("q")})
    kept = telephony.media_table(df)
    assert kept.inputFiles() and {"media", "pcm", "__payload", "text"} <= set(kept.columns)
    for r in kept.collect():
        b = (r.text or "").encode()
        payload = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        assert telephony.read_wav(bytes(r.media)) == (telephony.MULAW, 8000, 1, payload)
        kind, rate, _, data = telephony.read_wav(bytes(r.pcm))
        assert (kind, rate, len(data)) == (telephony.PCM, 16000, 4 * len(payload)) and r["__payload"] == "p"


def test_lifting_is_lossless():
    rng = np.random.default_rng(2)
    clips = [rng.integers(-32768, 32768, n).astype("<i2") for n in (0, 1, 2, 3, 64, 1001)]
    clips += [np.array([-32768, 32767, -32768, 32767], "<i2"), telephony.resample_double(clips[4], np.zeros(1, np.int64)).astype("<i2")]
    for pcm in clips:
        media = telephony.wav(pcm.tobytes(), telephony.PCM, 16000)
        assert telephony.unlift(telephony.lift(media)) == media
    # What a doubling of the rate adds costs nothing.
    assert len(telephony.lift(telephony.wav(clips[-1].tobytes(), telephony.PCM, 16000))) == telephony.LIFTED.size + clips[4].nbytes
    with pytest.raises(ValueError, match="lifted"):
        telephony.unlift(b"RIFF" + b"\0" * 12)


def test_media_round_trip(spark):
    rows = edge_rows()
    got = {}
    for r in telephony.digests(table(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        b = (t or "").encode()
        payload = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        media = telephony.wav(payload)
        want = (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert want in [(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got[d]]
        if len(payload) < 5000:
            assert plain_feature(payload) in {r.feature for r in got[d]}
    assert {r.feature for r in got[5]} == {r.feature for r in got[6]}
    for kind in (telephony.MULAW, telephony.ALAW, telephony.IMA):
        wide = telephony.expand(telephony.store(table(spark, rows), kind=kind)).select("media").collect()
        assert {telephony.expand_wav(bytes(r.media))[0] for r in wide} == {16000}
    assert telephony.digests(table(spark, [])).count() == 0
    with pytest.raises(ValueError, match="WAV"):
        telephony.read_wav(b"nothing")
