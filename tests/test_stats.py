"""Statistics against brute force and properties."""

import hashlib
import random
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.hashing import numbered_picks, seeded_hex
from plumbline.operators import ranks as R
from plumbline.operators import resampling as RS
from plumbline.operators import stats as S


def brute_auroc(y, s):
    p, n = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)) if p and n else None


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    data = [(i % 3, i // 4, rnd.random() < 0.4, float(rnd.randint(0, 12)), rnd.gauss(0, 1)) for i in range(400)]
    return data, spark.createDataFrame(data, "g int, c int, y boolean, s double, v double")


def test_auroc_matches_pairs_and_mirrors(rows):
    data, df = rows
    up = {r.g: r.auroc for r in S.auroc(df, ["g"], F.col("y"), F.col("s")).collect()}
    down = {r.g: r.auroc for r in S.auroc(df, ["g"], F.col("y"), -F.col("s")).collect()}
    for g in range(3):
        sel = [d for d in data if d[0] == g]
        assert up[g] == pytest.approx(brute_auroc([d[2] for d in sel], [d[3] for d in sel]))
        assert up[g] + down[g] == pytest.approx(1.0)


def test_auroc_of_one_class_is_null(spark):
    assert S.auroc(spark.createDataFrame([(True, 1.0)], "y boolean, s double"), [], F.col("y"), F.col("s")).first().auroc is None


def test_exact_quantiles_and_totals(rows):
    data, df = rows
    q = {r.g: r for r in R.exact_quantiles(df, ["g"], F.col("v"), {"a": 0.5, "b": 0.93}).collect()}
    for g in range(3):
        v = np.array([d[4] for d in data if d[0] == g])
        assert q[g].a == pytest.approx(np.quantile(v, 0.5)) and q[g].b == pytest.approx(np.quantile(v, 0.93)) and q[g].n == len(v)
    up = {r.g: r.m for r in R.upper_median(df, ["g"], F.col("v"), "m").collect()}
    assert up[0] == pytest.approx(sorted(d[4] for d in data if d[0] == 0)[len([d for d in data if d[0] == 0]) // 2])


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(1000)
    ranks = [r.rank for r in R.hash_rank(df, "s", ["id"]).orderBy("rank").collect()]
    assert ranks == list(range(1, 1001))
    first = [r.id for r in R.hash_rank(df, "s", ["id"]).filter("rank <= 20").orderBy("rank").collect()]
    assert first == [r.id for r in R.first_by_hash(df, 20, "s", ["id"]).collect()]


def test_intervals_agree_with_a_multinomial_bootstrap(rows):
    data, df = rows
    got = S.rate_ci(df, [], F.col("y"), "c", seed="7", n_resamples=1000).first()
    per = {}
    for d in data:
        per.setdefault(d[1], []).append(d[2])
    groups, rng = list(per.values()), np.random.default_rng(0)
    draws = [np.mean(np.concatenate([groups[i] for i in rng.integers(0, len(groups), len(groups))])) for _ in range(1000)]
    lo, hi = np.percentile(draws, [2.5, 97.5])
    assert got.point == pytest.approx(np.mean([d[2] for d in data]))
    assert got.lo == pytest.approx(lo, abs=0.02) and got.hi == pytest.approx(hi, abs=0.02)
    fixed = S.clustered_bootstrap(df, "c", {"a": F.sum(F.col("y").cast("int")), "b": F.count("*")}, S.ratio_statistic("a", "b"), "7", 1000).first()
    assert fixed.lo == pytest.approx(lo, abs=0.02) and fixed.hi == pytest.approx(hi, abs=0.02)


def test_fixed_resamples_take_n_of_n_without_a_shuffle_of_picks(spark, monkeypatch):
    per = spark.range(97).select(F.concat(F.lit("c"), "id").alias("c"), F.col("id").alias("a"))
    no = {r.c: r.no for r in R.hash_rank(per, "s", ["c"], name="no").collect()}
    want = sorted((d, int(hashlib.md5(f"s:{d}:{k}".encode()).hexdigest()[:15], 16) % 97 + 1) for d in range(1, 6) for k in range(1, 98))
    got = S.resample_fixed(per, "c", "s", 5)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.draw, no[r.c]) for r in got.collect() for _ in range(r.times)) == want
    monkeypatch.setattr(S, "BROADCAST_LIMIT_BYTES", 0)
    got = S.resample_fixed(per, "c", "s", 5)
    assert sorted((r.draw, no[r.c]) for r in got.collect() for _ in range(r.times)) == want


def test_picks_are_md5():
    numbers = np.r_[1:1200, 10**12 : 10**12 + 5]
    for prefix in ("boot:1:", "é:1999:", "x" * 60 + ":"):
        got = np.empty(len(numbers), np.uint64)
        for at, v in numbered_picks([prefix], numbers):
            got[at] = v
        assert got.tolist() == [int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:15], 16) for k in numbers]


@pytest.mark.parametrize("b,c", [(0, 0), (1, 0), (5, 5), (3, 17), (40, 75), (400, 512)])
def test_mcnemar_is_exact(spark, b, c):
    n, k = b + c, min(b, c)
    want = 1.0 if n == 0 else float(min(Fraction(1), 2 * Fraction(sum(comb(n, i) for i in range(k + 1)), 2**n)))
    got = S.mcnemar_exact(spark.createDataFrame([(1, b, c)], "k int, b bigint, c bigint"), ["k"], "b", "c").first().p
    assert got == pytest.approx(want, rel=1e-9)


def test_mcnemar_of_large_counts(spark):
    """Against the sum of all terms, from the largest down; counts that differ by one or not at all are certain."""
    cases = [(2, 1), (20, 0), (1000, 1100), (49_000, 51_000), (499_000, 501_000), (497_000, 503_000), (10, 999_990), (500_000, 500_000), (499_999, 500_000)]
    got = {(r.b, r.c): r.p for r in S.mcnemar_exact(spark.createDataFrame([(1, b, c) for b, c in cases], "k int, b bigint, c bigint"), ["k"], "b", "c").collect()}
    for b, c in cases:
        n, k = b + c, min(b, c)
        # C(n, k) / 2^n with 60 digits, then each term from the one before
        from decimal import Decimal, localcontext

        with localcontext() as x:
            x.prec = 60
            term = Decimal(comb(n, k)) / (Decimal(2) ** n) if n < 5000 else None
            if term is None:
                term = Decimal(1)
                for i in range(1, k + 1):
                    term = term * (n - k + i) / i
                term = term / (Decimal(2) ** n)
            total, t = Decimal(0), term
            for i in range(k, -1, -1):
                total += t
                if t < total * Decimal("1e-40"):
                    break
                t = t * i / (n - i + 1)
            want = float(min(Decimal(1), 2 * total))
        assert got[(b, c)] == pytest.approx(want, rel=1e-12, abs=1e-300), (b, c)


class Variance(RS.Statistic):
    """A user's statistic: no ratio, with a state of three sums per draw."""

    def start(self, draws):
        return np.zeros((3, draws))

    def add(self, state, x, w):
        known = ~np.isnan(x[:, 0])
        v, w = x[known, 0], w[known]
        return state + np.vstack([w.sum(0), v @ w, (v * v) @ w])

    def merge(self, a, b):
        return a + b

    def end(self, state):
        n, s, q = state
        with np.errstate(all="ignore"):
            return {"variance": (np.where(n > 1, (q - s * s / n) / (n - 1), np.nan), n[0])}


def test_user_statistics_are_the_same_for_any_partitioning(rows):
    data, df = rows
    got = []
    for parts, limit in ((1, None), (7, None), (5, 1)):
        with pytest.MonkeyPatch.context() as m:
            if limit:
                m.setattr(RS, "STATES", limit)
            out = RS.bootstrap(df.repartition(parts), ["g"], "c", ["v"], Variance(), "u", 300).orderBy("g").collect()
        got.append([(r.g, r.measure, r.n, r.n_draws) for r in out])
        for r in out:
            v = [d[4] for d in data if d[0] == r.g]
            assert r.point == pytest.approx(np.var(v, ddof=1)) and r.lo < r.point < r.hi and r.n == len(v)
        got.append([(round(r.lo, 9), round(r.hi, 9)) for r in out])
    assert got[0] == got[2] == got[4] and got[1] == got[3] == got[5]


def test_intervals_of_nulls_empty_groups_and_odd_keys(spark):
    rows = [(None, 1, 1.0), (None, 2, 0.0), (float("nan"), 1, None), (float("nan"), 2, 1.0), (2.0, None, 1.0), (2.0, 3, None), (3.0, 4, None)]
    df = spark.createDataFrame(rows, "g double, c int, v double")
    out = {str(r.g): r for r in RS.means(df, ["g"], "c", {"v": F.col("v"), "one": F.lit(1)}, n_resamples=50).where("measure = 'v'").collect()}
    assert {k: (r.n, r.point) for k, r in out.items()} == {"None": (2, 0.5), "nan": (1, 1.0), "2.0": (1, 1.0), "3.0": (0, None)}
    assert out["3.0"].lo is None and out["3.0"].n_draws == 0 and 0 < out["nan"].n_draws < 50
    assert RS.means(df.limit(0), [], "c", {"v": F.col("v")}).count() == 0
    all_ = RS.means(df, [], "c", {"v": F.col("v")}, n_resamples=50).first()
    assert (all_.n, all_.point) == (4, 0.75)


def test_weights_are_poisson_and_independent():
    r = np.random.default_rng(1)
    w = RS.weights(r.integers(0, 2**32, 4000).astype(np.uint32), r.integers(0, 2**32, 4000).astype(np.uint32), 500)
    assert (w[:, 0] == 1).all()
    w = w[:, 1:]
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.01)
    assert [(w == k).mean() for k in range(4)] == pytest.approx([np.exp(-1) / f for f in (1, 1, 2, 6)], abs=0.002)
    c = np.corrcoef(w[:, :60].T)
    assert np.abs(c - np.eye(60)).max() < 0.08
    assert np.abs(np.corrcoef(w[:60]) - np.eye(60)).max() < 0.25


def test_kappas(spark):
    pairs = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15
    df = spark.createDataFrame(pairs, "a string, b string")
    assert S.cohens_kappa(df, [], F.col("a"), F.col("b")).first().kappa == pytest.approx(0.4)
    same = spark.createDataFrame([("a", "a")], "a string, b string")
    assert S.cohens_kappa(same, [], F.col("a"), F.col("b")).first().kappa is None
    # a table with published value 0.210: 10 items, 14 raters, 5 categories
    table = [[0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1], [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7]]
    long = [(i, r, str(c)) for i, row in enumerate(table) for r, c in enumerate([c for c, n in enumerate(row) for _ in range(n)])]
    k = S.fleiss_kappa(spark.createDataFrame(long, "i int, r int, l string"), [], "i", "r", "l").first()
    assert k.kappa == pytest.approx(0.210, abs=5e-4) and k.n_items == 10


def test_forward_fill_crosses_chunks(spark):
    df = spark.createDataFrame([(1, i, f"h{i}" if i in (3, 27) else None) for i in range(40)], "k int, i int, v string")
    got = {r.i: r.f for r in R.forward_fill(df, ["k"], "i", "v", "f", chunk=7).collect()}
    assert [got[i] for i in (2, 3, 26, 27, 39)] == [None, "h3", "h3", "h27", "h27"]


def test_first_rows_in_seeded_order(spark):
    rows = [(k,) for k in range(9000)] + [(None,)]
    df = spark.createDataFrame(rows, "k long").repartition(7)
    order = [x.k for x in df.orderBy(seeded_hex("s", F.col("k")), "k").collect()]
    for n in (0, 1, 700, 9001, 20000):
        assert {x.k for x in R.first_by_hash(df, n, "s", ["k"]).collect()} == set(order[:n])
        assert R.first_by_hash(df, n, "s", ["k"]).count() == min(n, 9001)


def test_auroc_draws_equal_counting_pairs(spark):
    import hashlib

    rows = [(None if k == 4 else f"c{k}", i % 3, bool((i * 7 + k) % 5 < 2), "g" if i % 2 else None) for k in range(6) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, score int, y boolean, g string").repartition(3)
    per = S.score_counts(df, ["g", "k"], F.col("y"), F.col("score"))
    got = {(r.g, r.draw): r.auroc for r in RS.auroc_draws(per, ["g"], "k", "s", 130).collect()}
    cuts = RS.poisson_thresholds()
    for g in ("g", None):
        for b in range(1, 131):
            times = {k: sum(int(hashlib.md5(":".join(["s", str(b), *([k] if k else [])]).encode()).hexdigest()[:8], 16) >= c for c in cuts) for k in {r[0] for r in rows}}
            mine = [(s, y, times[k]) for k, s, y, x in rows if x == g]
            pairs = [((p > n) + (p == n) / 2, a * c) for p, y, a in mine if y for n, z, c in mine if not z]
            total = sum(w for _, w in pairs)
            want = sum(v * w for v, w in pairs) / total if total else None
            assert got[g, b] == (None if want is None else pytest.approx(want, abs=1e-12)), (g, b)
