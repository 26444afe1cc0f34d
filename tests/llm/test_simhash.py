"""SimHash near copies against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash_dedup

from .test_operators import edge_rows, prose, table


def plain_fingerprint(text):
    low = (text or "").encode().decode("latin-1").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode("latin-1"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, prints, most=2):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                up[root(i)] = root(j)
    least, size = {}, Counter(root(i) for i in range(len(rows)))
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, f"{prints[i]:016x}", least.get(root(i)), size[root(i)]) for i, (d, _) in enumerate(rows))


def near_rows():
    rows = []
    for g in range(8):
        base = prose(300 + g, 400 + 60 * g).split()
        for k in range(10):
            own = list(base)
            if k:
                own[(37 * k) % len(own)] = f"new{k}"
            rows.append((100 * (g + 1) + k, " ".join(own)))
    return rows + [(901, "İ A B\x0bc\x1fd E"), (902, "É é"), (903, "A b"), (904, "a\tB"), (905, " "), (906, "one")]


@pytest.mark.parametrize("key_most", [64, 2])
def test_components_match_plain_python(spark, monkeypatch, key_most):
    monkeypatch.setattr(simhash_dedup, "KEY_MOST", key_most)
    monkeypatch.setattr(simhash_dedup, "HASH_BLOCK", 1000)
    rows = edge_rows() + near_rows()
    prints = [plain_fingerprint(t) for _, t in rows]
    got = Counter((r.doc_id, r.fingerprint, r.component_id, r.component_size) for r in simhash_dedup.components(table(spark, rows)).collect())
    assert got == plain_components(rows, prints)
    assert len({p for p in prints}) > len({c for _, _, c, _ in got})  # some links are between different fingerprints
    assert simhash_dedup.components(table(spark, [])).count() == 0


def test_links_connect_what_is_near(spark, monkeypatch):
    """Random fingerprints around a few centres: one cluster is crowded, others are small."""
    rng = np.random.default_rng(4)
    prints = set()
    for c, n in enumerate((600, 20, 20, 1)):
        centre = int(rng.integers(0, 1 << 63)) * 2 + c % 2
        for _ in range(n):
            p = centre
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                p ^= 1 << b
            prints.add(p)
    prints |= {int(rng.integers(0, 1 << 63)) for _ in range(300)}
    prints = sorted(prints)
    rows = [(i, "") for i in range(len(prints))]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    fps = spark.createDataFrame(signed, "fp long")
    for most, segments in ((2, 7), (2, 5), (4, 9)):
        if most == 4:
            monkeypatch.setattr(simhash_dedup, "KEY_MOST", 10_000)
        got = simhash_dedup.links(fps, most, segments).collect()
        at = {p: i for i, (p,) in enumerate(signed)}
        a, b = (np.array([at[x] for x in own]) for own in zip(*((r.a, r.b) for r in got), strict=True))
        root = simhash_dedup._roots(len(prints), a, b)
        want = plain_components(rows, prints, most)
        sizes = Counter(root.tolist())
        assert Counter((i, f"{p:016x}", int(root[i]), sizes[int(root[i])]) for i, p in enumerate(prints)) == want
        # Links are trees within keys: their number stays near that of the fingerprints.
        assert len(got) <= 7 * segments * len(prints)


def test_chains_keep_every_near_pair():
    """Each way to change two bits passes some chain, and chains pass nothing else at their end."""
    told = simhash_dedup.chains(2, 7)
    for i in range(64):
        for j in range(i + 1):
            differ = (1 << i) | (1 << j)
            assert any(all((differ & m).bit_count() <= b for m, b in c) for c in told)
    assert {c[-1] for c in told} == {((1 << 64) - 1, 2)} and all(c[0][1] == 0 for c in told)
    assert simhash_dedup.chains(0, 4) == [[((1 << 64) - 1, 0)]]
    with pytest.raises(ValueError, match="segments"):
        simhash_dedup.chains(4, 4)


def test_odd_number_of_bits_is_refused(spark):
    with pytest.raises(ValueError, match="even"):
        simhash_dedup.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_one_of_each_component_stays(spark):
    rows = edge_rows() + near_rows()
    docs = table(spark, rows)
    kept = simhash_dedup.deduplicate(docs)
    parts = plain_components(rows, [plain_fingerprint(t) for _, t in rows])
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c, _ in parts}
