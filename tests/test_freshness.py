"""Spark estimators against plain folds over small random histories."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catascope.operators import freshness as fr

AS_OF = 1710


def weeks(n, start=dt.date(2015, 10, 1)):
    out = []
    for i in range(n):
        y, w, _ = (start + dt.timedelta(days=7 * i)).isocalendar()
        out.append((y % 100) * 100 + w)
    return out


def thursday(sn):
    return dt.date.fromisocalendar(2000 + sn // 100, sn % 100, 4)


def histories():
    rng = random.Random(7)
    out = {}
    for k in range(12):
        rows, day = [], None
        sns = [s for s in weeks(30) if k % 3 or rng.random() < 0.9]
        for sn in sns:
            if day is None or rng.random() < k / 11:
                day = thursday(sn) - dt.timedelta(days=rng.randint(0, 9))
            rows.append((sn, day))
        out[f"u{k}"] = rows
    out["short"] = out["u5"][:10]
    out["eleven"] = out["u5"][:11]
    return out


def fold(rows):
    """The estimators, one access after the other."""
    N = X = T = 0
    prev_sn = prev_t = None
    flags, ages = [], []
    for sn, t in rows:
        interval = 7 if prev_sn is None else (thursday(sn) - thursday(prev_sn)).days
        age = (thursday(sn) - t).days
        N += 1
        if age < interval:
            X, T = X + 1, T + age
        else:
            T += interval
        flags.append(int(t != prev_t))
        ages.append(age)
        prev_sn, prev_t = sn, t
    dates = sorted({t for _, t in rows})
    gaps = [(b - a).days for a, b in zip(dates, dates[1:])]
    return dict(N=N, X=X, T=T, flags=flags, gaps=gaps, last=rows[-1][1])


def poisson_cdf(t, mu):
    if t < 0:
        return 0.0
    return min(1.0, sum(math.exp(-mu + i * math.log(mu) - math.lgamma(i + 1)) for i in range(int(t) + 1)))


def chain(flags, k):
    freq = Counter("".join(map(str, flags[i - k : i + 1])) for i in range(k, len(flags)))
    def quiet(state):
        total = freq[state + "0"] + freq[state + "1"]
        return freq[state + "0"] / total if total else 0.0
    return quiet


def markov_cdf(flags, k, n):
    quiet, state, p = chain(flags, k), "".join(map(str, flags[-k:])), 1.0
    for _ in range(n):
        p *= quiet(state)
        state = (state + "0")[1:]
    return 1 - p


def markov_quantile(flags, k, q):
    quiet, state, p, n = chain(flags, k), "".join(map(str, flags[-k:])), 1.0, 0
    while 1 - p <= q:
        n += 1
        p *= quiet(state)
        state = (state + "0")[1:]
        if n > 10_000:
            return None
    return n


def percentile(xs, q):
    xs = sorted(xs)
    pos = q * (len(xs) - 1)
    lo = int(pos)
    return xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (pos - lo)


@pytest.fixture(scope="module")
def data(spark):
    rows = [(u, "m", "header", sn, t) for u, hist in histories().items() for sn, t in hist]
    return spark.createDataFrame(rows, "uri string, md5 string, source string, snapshot int, modified date").cache()


@pytest.fixture(scope="module")
def want():
    return {u: fold(r) for u, r in histories().items() if len(r) > 10}


def by_uri(df):
    return {r.uri: r for r in df.collect()}


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_short_histories_have_no_score(data, want):
    got = by_uri(fr.scores(data, AS_OF))
    assert set(got) == set(histories()) and set(want) < set(got)
    assert all(got[u][e] is None for u in set(got) - set(want) for e in fr.ESTIMATES)


def test_rates(data, want):
    got = by_uri(fr.last_modified_rates(fr.accesses(data)))
    for u, w in want.items():
        g, N, X, T = got[u], w["N"], w["X"], w["T"]
        assert (g.accesses, g.changes, g.observed) == (N, X, T)
        assert close(g.rate_naive, X / T if T > 0 and X else None)
        improved = ((X - 1) - X / (N * math.log(1 - X / N))) / T if 0 < X < N and T > 0 else None
        assert close(g.rate_improved, improved)


def test_scores(data, want):
    got = by_uri(fr.scores(data, AS_OF))
    rates = by_uri(fr.last_modified_rates(fr.accesses(data)))
    for u, w in want.items():
        age = (thursday(AS_OF) - w["last"]).days
        g, r = got[u], rates[u]
        for name, rate in (("cho_naive", r.rate_naive), ("cho_impr", r.rate_improved)):
            assert close(g[name], poisson_cdf(age, 1 / rate) if rate and rate > 0 else None)
        emp = sum(x <= age for x in w["gaps"]) / len(w["gaps"]) if w["gaps"] else None
        assert close(g.emp_dist, emp)
        n = max(1, math.floor(age / 7 + 0.5))
        assert close(g.mark1, markov_cdf(w["flags"], 1, n)) and close(g.mark2, markov_cdf(w["flags"], 2, n))


def test_next_step(data, want):
    cols = fr.markov_next(1) | fr.markov_next(2)
    got = by_uri(fr.markov_counts(fr.accesses(data)).withColumns(cols))
    for u, w in want.items():
        for k in (1, 2):
            quiet, state = chain(w["flags"], k), "".join(map(str, w["flags"][-k:]))
            seen = any("".join(map(str, w["flags"][i - k : i])) == state for i in range(k, len(w["flags"])))
            p0 = quiet(state)
            p1 = 1 - p0 if seen else 0.0
            flag, prob = (0, p0) if p0 > p1 else (1, p1)
            assert got[u][f"next_flag{k}"] == flag and close(got[u][f"next_prob{k}"], prob)


def test_comparison_rates(data, want):
    got = by_uri(fr.comparison_rates(fr.accesses(data)))
    for u, w in want.items():
        n, x = w["N"], sum(w["flags"])
        assert close(got[u].rate_intuitive, x / n / 7)
        assert close(got[u].rate_improved, -math.log((n - x + 0.5) / (n + 0.5)) / 7)


def test_access_gaps(data, want):
    got = by_uri(fr.access_gap_distribution(fr.accesses(data), 3, 0.9))
    for u, w in want.items():
        gaps, i = [], 0
        for f in w["flags"]:
            i += 1
            if f:
                gaps.append(i)
                i = 0
        assert close(got[u].cdf, sum(g <= 3 for g in gaps) / len(gaps))
        assert close(got[u].quantile_days, percentile(gaps, 0.9) * 7)


@pytest.mark.parametrize("q", [0.2, 0.5, 0.95])
def test_recrawl_interval(data, want, q):
    got = by_uri(fr.recrawl_interval(fr.accesses(data), q))
    rates = by_uri(fr.last_modified_rates(fr.accesses(data)))
    for u, w in want.items():
        rate = rates[u].rate_naive
        t = None
        if rate:
            t = 0
            while poisson_cdf(t, 1 / rate) < q:
                t += 1
        assert got[u].poisson_days == t
        assert close(got[u].gap_days, percentile(w["gaps"], q) if w["gaps"] else None)
        for k in (1, 2):
            assert got[u][f"markov{k}_weeks"] == markov_quantile(w["flags"], k, q)


@pytest.mark.parametrize("alpha", [0.3, 0.8])
def test_smoothing(data, want, alpha):
    got = by_uri(fr.smoothing(fr.accesses(data), alpha))
    for u, w in want.items():
        y = None
        for d in w["gaps"]:
            y = d if y is None else alpha * y + (1 - alpha) * d
        assert (u not in got) if y is None else close(got[u].smoothed, y)


def test_poisson_cdf_is_monotone(spark):
    rows = spark.range(0, 400).select(F.col("id").alias("t"), fr.poisson_cdf(F.col("id"), F.lit(120.5)).alias("p")).orderBy("t").collect()
    ps = [r.p for r in rows]
    assert all(a <= b + 1e-12 for a, b in zip(ps, ps[1:])) and ps[0] < 1e-40 and ps[-1] > 0.999999


def test_poisson_edges(spark):
    row = spark.range(1).select(
        fr.poisson_cdf(F.lit(3), F.lit(2.0)).alias("a"), fr.poisson_cdf(F.lit(0), F.lit(2.0)).alias("b"),
        fr.poisson_cdf(F.lit(-1), F.lit(2.0)).alias("c"), fr.poisson_cdf(F.lit(3), F.lit(-2.0)).alias("d"),
    ).first()
    assert abs(row.a - 0.857123) < 1e-6 and abs(row.b - math.exp(-2)) < 1e-12 and row.c == 0.0 and row.d is None


def test_short_histories_have_rows_without_estimates(spark):
    rows = [("u1", "m", "header", 2101 + i, dt.date(2021, 1, 1 + i)) for i in range(5)] + [("u2", "m", "header", 2101 + i, dt.date(2021, 1, 1 + i)) for i in range(14)]
    hist = spark.createDataFrame(rows, "uri string, md5 string, source string, snapshot int, modified date")
    got = {r.uri: r for r in fr.score_rows(hist, AS_OF).collect()}
    assert set(got) == {"u1", "u2"}
    assert all(got["u1"][f"{e}_header"] is None for e in fr.ESTIMATES) and got["u2"].mark1_header is not None
    assert fr.accesses(hist).count() == 19


def test_poisson_search_ends_beyond_every_quantile():
    for k in range(-40, 60):
        mu = 1.5**k
        x = 40 * math.sqrt(mu) + 40
        assert x * x / (2 * (mu + x / 3)) >= 60
