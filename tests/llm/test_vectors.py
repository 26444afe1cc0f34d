"""Whitening and vector codes against plain Python and numpy."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import vector_codes, whitening
from millrace.llm.vectors import usable

SCHEMA = "vec_id long, embedding array<float>, label int, y string, codes string, error string, whitened string, `__label` string, `__rows` string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, k, "y", "c", "e", "w", "l", "r") for i, v, k in rows], schema)


def vectors(n, length=8, seed=0, offset=0.0):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, length)) @ np.diag(0.2 + np.arange(length)) + offset
    return [[float(np.float32(c)) for c in v] for v in mixed]


def odd_rows(length=8):
    nan, inf = float("nan"), float("inf")
    good = vectors(70, length, 3)
    rows = [(i, v, i % 4 or None) for i, v in enumerate(good)]
    rows += [(5, good[5], 1), (5, good[6], 1), (None, good[7], 2), (None, good[8], None), (-9, [0.0] * length, 3), (-8, [-0.0] * length, 3)]
    rows += [(100, None, 1), (101, [], 1), (102, [1.0] * (length - 1) + [None], 1), (103, [1.0] * (length - 1) + [nan], None), (104, [-inf] + [1.0] * (length - 1), 1), (105, [1.0] * (length + 1), 1)]
    return rows


def kept_of(rows, length=8):
    return [(i, v, k) for i, v, k in rows if v and len(v) == length and all(c is not None and math.isfinite(c) for c in v)]


def test_usable_takes_the_commonest_length(spark):
    kept, length = usable(table(spark, odd_rows()))
    assert length == 8 and kept.count() == len(kept_of(odd_rows()))
    assert usable(table(spark, [(1, [1.0], 1), (2, [1.0, 2.0], 1)]))[1] == 1
    assert usable(table(spark, [(1, None, 1)]))[1] == 0


# 11. Whitening.


def plain_whitening(rows, length):
    own = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in kept_of(rows, length)]
    fit = sorted({tuple(x) for _, x in own})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    scatter = [[sum((Fraction(x[i]) - Fraction(sums[i], n)) * (Fraction(x[j]) - Fraction(sums[j], n)) for x in fit) / n for j in range(length)] for i in range(length)]
    return own, n, sums, np.array([[float(c) for c in r] for r in scatter])


@pytest.mark.parametrize("offset", [0.0, 3000.0])
def test_whitening_matches_exact_fractions(spark, offset):
    rows = [(i, v and [c if c is None else c + offset for c in v], k) for i, v, k in odd_rows()]
    rows = [(i, v and [c if c is None else float(np.float32(c)) for c in v], k) for i, v, k in rows]
    own, n, sums, v = plain_whitening(rows, 8)
    got = whitening.components(table(spark, rows)).toPandas()
    assert len(got) == 8 * len(own) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    values, q = np.linalg.eigh(v)
    values, q = values[::-1], q[:, ::-1]
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, values / values.sum(), rtol=1e-9)
    want = sorted((-(10**9) if i is None else i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), *(round(abs(w), 6) for w in ((np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums)]) @ q) / values**0.5))) for i, x in own)
    # A row's components come one after another.
    told = sorted((-(10**9) if g.vec_id.isna().iloc[0] else int(g.vec_id.iloc[0]), int(g.deviation.iloc[0]), *(round(abs(w), 6) for w in g.whitened)) for g in (got.iloc[a : a + 8] for a in range(0, len(got), 8)))
    assert np.allclose(np.array(told, float), np.array(want, float), atol=2e-6)
    assert [t[:2] for t in told] == [w[:2] for w in want]


def test_residues_give_whole_numbers_back():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 40), 1 << 40, (9000, 5))
    want = x.astype(object).T @ x.astype(object)
    moduli = whitening.primes(2 * 9000 * (1 << 80))
    into = np.zeros((len(moduli), 5, 5), np.int64)
    whitening.residue_scatter(x, moduli, into)
    assert (whitening.remaindered(list(into), moduli) == want).all()
    assert math.prod(moduli) > 2 * 9000 * (1 << 80) >= math.prod(moduli[:-1]) and len(set(moduli)) == len(moduli)


def test_eigen_keeps_small_values():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    q = q.astype(np.longdouble)
    for _ in range(3):  # orthogonal in extended precision
        q = q @ (1.5 * np.eye(6, dtype=np.longdouble) - 0.5 * q.T @ q)
    values = np.array([1.0, 1e-3, 1e-6, 1e-9, 1e-13, 1e-14], np.longdouble)
    got, x = whitening.eigen(q @ np.diag(values) @ q.T)
    assert np.allclose((got / values).astype(float), 1, atol=1e-3)
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-16


def test_whitening_without_spread(spark):
    # Six dimensions of which four depend on the others.
    base = vectors(40, 2, 5)
    rows = [(i, [a, b, a, b, 1.0, 2.0], 1) for i, (a, b) in enumerate(base)]
    got = whitening.components(table(spark, rows)).toPandas()
    assert got[got.component <= 2].whitened.notna().all() and got[got.component > 2].whitened.isna().all()
    assert got.identity_error.max() < 1e-9 and len(got) == 240
    one = whitening.components(table(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, 0.0)}
    for none in ([], [(1, None, 1)]):
        empty = whitening.components(table(spark, none))
        assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(i) * 1e12, 1.0], 1) for i in range(4)] + [(9, [3e38, 0.0], 1)]
    got = whitening.components(table(spark, rows)).filter("component = 1").collect()
    assert {r.deviation for r in got} == {None} and len(got) == 5
    model = whitening.Whitening(3, [3, 6], np.ones(2), np.eye(2), 2.0, 64, 0)
    y = [[5, -7], [1 << 29, 1], [1012333334, -4], [1 << 30, 1], [1 << 40, 1]]
    exact = [sum((3 * c - s) ** 2 for c, s in zip(v, model.sums)) for v in y]
    value, fits = model.deviations(np.array(y))
    assert fits.tolist() == [e < 1 << 63 for e in exact] == [True, True, True, False, False]
    assert value[:3].tolist() == exact[:3]


def test_whitened_rows_keep_their_columns(spark):
    df = table(spark, odd_rows())
    model = whitening.fit_whitening(df, components=3)
    got = whitening.whiten(df, model)
    assert got.columns == ["vec_id", "embedding", "label", "y", "codes", "error", "__label", "__rows", "whitened", "deviation"]
    assert {len(r.whitened) for r in got.collect()} == {3}


# 12. Vector codes.


def plain_codes(rows, length, parts, entries):
    own = [(i, [math.floor(256 * c) for c in v] + [0] * (-length % parts), k, v) for i, v, k in kept_of(rows, length)]
    wide = -(-length // parts)
    cut = lambda x: [x[p * wide : (p + 1) * wide] for p in range(parts)]
    least = {}
    for i, x, _, v in own:
        if i not in least or v < least[i][0]:
            least[i] = (v, x)
    order = sorted(least, key=lambda i: (i is None, i or 0))[:entries]
    books = [[cut(least[i][1])[p] for i in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, a: min(range(len(books[p])), key=lambda e: (far(a, books[p][e]), e))
    for _ in range(2):
        held = [[[] for _ in order] for _ in range(parts)]
        for _, x, _, _ in own:
            for p, a in enumerate(cut(x)):
                held[p][near(p, a)].append(a)
        books = [[[sum(c) // len(h) for c in zip(*h)] if h else books[p][e] for e, h in enumerate(held[p])] for p in range(parts)]
    out, by = [], {}
    for i, x, k, _ in own:
        code = [near(p, a) for p, a in enumerate(cut(x))]
        error = sum(far(a, books[p][e]) for p, (a, e) in enumerate(zip(cut(x), code)))
        by[k] = by.get(k, 0) + error
        out.append([i, "".join(f"{e:02x}" for e in code), error, k])
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), code, error, by[k], sha) for i, code, error, k in out)


@pytest.mark.parametrize("length", [16, 32, 20])
def test_codes_match_plain_python(spark, length):
    rows = odd_rows(length) + [(200 + i, v, 7) for i, v in enumerate(vectors(30, length, 9))]
    got = vector_codes.codes_table(table(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows, length, 16, 64)


def test_codes_of_few_and_no_rows(spark):
    rows = [(2, [1.0] * 16, None), (1, [2.0] * 16, None), (1, [0.5] * 16, 3), (None, [9.0] * 16, 3)]
    got = vector_codes.codes_table(table(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows, 16, 16, 64)
    for none in ([], [(1, None, 1)]):
        empty = vector_codes.codes_table(table(spark, none))
        assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_huge_components_are_held(spark):
    rows = [(1, [3e38] + [0.0] * 15, 1), (2, [-3e38] + [0.0] * 15, 1), (3, [1.0] * 16, 2)]
    got = {r.vec_id: r for r in vector_codes.codes_table(table(spark, rows)).collect()}
    assert got[3].error == 0 and all(r.error >= 0 and r.label_error >= 0 for r in got.values())


def test_decoding_comes_near(spark):
    rows = odd_rows(16)
    kept, length = usable(table(spark, rows).select("vec_id", "embedding"))
    books = vector_codes.fit_codebooks(kept, length)
    coded = vector_codes.encode(kept.withColumn("own", kept.vec_id), books).collect()
    assert kept.count() == len(coded) and coded[0].asDict().keys() == {"vec_id", "own", "codes", "error"}
    back = books.decode(np.array([r.codes for r in coded]))
    source = {i: v for i, v, _ in rows[:70]}
    for r, b in zip(coded, back, strict=True):
        if r.vec_id in range(5):
            whole = np.floor(256 * np.array(source[r.vec_id]))
            assert ((np.floor(256 * b) - whole) ** 2).sum() == r.error
