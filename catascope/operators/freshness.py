"""Change rates and freshness of resources from their observed modification dates.

A history has one row per (uri, md5, source, snapshot), so a resource has at most one row per
week (YYWW has 5,300 values). It is shuffled once by (uri, md5, source); all estimators are
windows and aggregates over that partitioning, without lists per group and without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catascope.functions.snapshot import thursday_of
from catascope.functions.text import header_date

KEYS = ["uri", "md5", "source"]
WEEK = 7


def history(datasets: DataFrame, resources: DataFrame, lookups: DataFrame) -> DataFrame:
    """Modification dates from the metadata and from the headers of the lookups.

    lookups carries `header` (map of name to values).
    """
    used = datasets.select("snapshot", "md5").distinct()
    mr = resources.select("uri", "md5", "modified").join(used, "md5")
    meta = mr.where(F.col("modified").isNotNull()).select(
        "uri", "md5", "snapshot", F.col("modified").cast("date").alias("modified"), F.lit("metadata").alias("source")
    )
    seen = lookups.select(
        "uri", "snapshot", header_date(F.col("header"), "last-modified").cast("date").alias("found")
    ).where(F.col("found").isNotNull())
    head = mr.join(seen, ["uri", "snapshot"]).select(
        "uri", "md5", "snapshot", F.col("found").alias("modified"), F.lit("header").alias("source")
    )
    return meta.unionByName(head)


def observations(hist: DataFrame) -> DataFrame:
    """One row per resource, source and week: the latest date seen in it."""
    return hist.groupBy(*KEYS, "snapshot").agg(F.max("modified").cast("date").alias("modified"))


def _in_order():
    return W.partitionBy(*KEYS).orderBy("snapshot")


def accesses(hist: DataFrame) -> DataFrame:
    """Interval, age and change flag of every access, for histories of any length."""
    w = _in_order()
    rows = observations(hist).withColumn("access", thursday_of(F.col("snapshot")))
    rows = rows.withColumns(
        {
            "position": F.row_number().over(w),
            "_access": F.lag("access").over(w),
            "_modified": F.lag("modified").over(w),
        }
    )
    interval = F.coalesce(F.datediff("access", "_access"), F.lit(WEEK))
    change = (~F.col("_modified").eqNullSafe(F.col("modified"))).cast("int")
    return rows.withColumns(
        {
            "interval_days": interval,
            "age_days": F.datediff("access", "modified"),
            "changed": change,
        }
    ).drop("_access", "_modified")


def _gap() -> Column:
    """Days since the next older modification date, null for the first and for repeats."""
    w = W.partitionBy(*KEYS).orderBy("modified")
    days = F.datediff("modified", F.lag("modified").over(w))
    return F.when(days > 0, days)


def gaps(acc: DataFrame) -> DataFrame:
    """Days between successive distinct modification dates."""
    return acc.select(*KEYS, "modified").withColumn("gap", _gap()).where(F.col("gap").isNotNull())


def _rate_aggregates() -> list[Column]:
    hit = F.col("age_days") < F.col("interval_days")
    return [
        F.count(F.lit(1)).alias("accesses"),
        F.sum(hit.cast("int")).alias("changes"),
        F.sum(F.least("age_days", "interval_days")).alias("observed"),
        F.max_by("modified", "snapshot").alias("last_modified"),
    ]


def last_modified_rates(acc: DataFrame) -> DataFrame:
    """Changes per day from the ages at the accesses: the plain and the improved estimate."""
    base = acc.groupBy(*KEYS).agg(*_rate_aggregates())
    return base.withColumns({"rate_naive": naive_rate(), "rate_improved": improved_rate()})


def naive_rate() -> Column:
    x, t = F.col("changes"), F.col("observed")
    return F.when((t > 0) & (x > 0), x / t)


def improved_rate() -> Column:
    x, t, n = F.col("changes").cast("double"), F.col("observed").cast("double"), F.col("accesses").cast("double")
    return F.when((x > 0) & (x < n) & (t > 0), ((x - 1) - x / (n * F.log(1 - x / n))) / t)


def poisson_cdf(t: Column, mu: Column) -> Column:
    """P(X <= t) of a Poisson variable with mean mu, terms in log space."""
    k = F.floor(t).cast("int")
    log_mu = F.log(mu)
    start = F.struct((-mu).alias("term"), F.exp(-mu).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + log_mu - F.log(i.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, step, lambda acc: F.least(acc["total"], F.lit(1.0)))
    return F.when(mu > 0, F.when(t < 0, F.lit(0.0)).otherwise(total))


def poisson_quantile(q: Column, mu: Column) -> Column:
    """Smallest t with a Poisson CDF of at least q.

    The search ends at mu + x with x = 40 sqrt(mu) + 40. By Bernstein's inequality the tail beyond
    is below exp(-x^2 / (2 (mu + x / 3))) <= exp(-60) for every mu, so it holds every q that a
    double can tell from 1.
    """
    bound = F.ceil(mu + F.sqrt(mu) * 40 + 40).cast("int")
    log_mu = F.log(mu)
    start = F.struct(
        (-mu).alias("term"), F.exp(-mu).alias("total"), F.when(F.exp(-mu) >= q, 0).otherwise(-1).alias("hit")
    )

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + log_mu - F.log(i.cast("double"))
        total = acc["total"] + F.exp(term)
        hit = F.when((acc["hit"] < 0) & (total >= q), i.cast("int")).otherwise(acc["hit"])
        return F.struct(term.alias("term"), total.alias("total"), hit.alias("hit"))

    found = F.aggregate(F.sequence(F.lit(1), F.greatest(bound, F.lit(1))), start, step, lambda acc: acc["hit"])
    return F.when(mu > 0, F.when(found >= 0, found))


def days_since(snapshot: Column) -> Column:
    """Days from the last modification to the Thursday of the snapshot asked for."""
    return F.datediff(thursday_of(snapshot), F.col("last_modified"))


def gap_distribution(acc: DataFrame, rates: DataFrame, snapshot: int) -> DataFrame:
    """Empirical CDF of the gaps at the days since the last modification."""
    ages = rates.select(*KEYS, days_since(F.lit(snapshot)).alias("age"))
    return gaps(acc).join(ages, KEYS).groupBy(*KEYS).agg(
        (F.count_if(F.col("gap") <= F.col("age")) / F.count(F.lit(1))).alias("emp_dist")
    )


def _states(acc: DataFrame) -> DataFrame:
    w = _in_order()
    return acc.withColumns({"c1": F.lag("changed", 1).over(w), "c2": F.lag("changed", 2).over(w)})


def _markov_aggregates() -> list[Column]:
    c, p, pp = F.col("changed"), F.col("c1"), F.col("c2")
    one = {f"n{a}{b}": F.count_if((p == a) & (c == b)) for a in (0, 1) for b in (0, 1)}
    two = {f"n{a}{b}{d}": F.count_if((pp == a) & (p == b) & (c == d)) for a in (0, 1) for b in (0, 1) for d in (0, 1)}
    last = F.max_by(c * 2 + F.coalesce(p, F.lit(0)), F.col("snapshot"))
    return [v.alias(k) for k, v in (one | two).items()] + [last.alias("_last")]


def _with_last(rows: DataFrame) -> DataFrame:
    """The last two flags, carried as one number so that the sums stay in a hash aggregate."""
    return rows.withColumns({"last1": F.floor(F.col("_last") / 2).cast("int"), "last2": F.col("_last") % 2}).drop("_last")


def markov_counts(acc: DataFrame) -> DataFrame:
    """Transition counts of the chains of order 1 and 2 and the last flags."""
    rows = _states(acc).groupBy(*KEYS).agg(*_markov_aggregates(), F.max_by("modified", "snapshot").alias("last_modified"))
    return _with_last(rows)


def _still(state: str) -> Column:
    """Probability of no change in a state, 0 for a state never seen."""
    zero, one = F.col(f"n{state}0"), F.col(f"n{state}1")
    return F.when(zero + one > 0, zero / (zero + one)).otherwise(F.lit(0.0))


def _first_still(order: int) -> Column:
    last1, last2 = F.col("last1"), F.col("last2")
    if order == 1:
        return F.when(last1 == 0, _still("0")).otherwise(_still("1"))
    pick = [((last2 == a) & (last1 == b), _still(f"{a}{b}")) for a in (0, 1) for b in (0, 1)]
    out = F.lit(0.0)
    for test, p in pick:
        out = F.when(test, p).otherwise(out)
    return out


def markov_quiet(order: int, weeks: Column) -> Column:
    """Probability of no change in the next weeks: after the first steps the state is quiet."""
    first = _first_still(order)
    if order == 1:
        return first * F.pow(_still("0"), weeks - 1)
    second = F.when(F.col("last1") == 0, _still("00")).otherwise(_still("10"))
    return F.when(weeks <= 1, first).otherwise(first * second * F.pow(_still("00"), weeks - 2))


def markov_cdf(order: int, weeks: Column) -> Column:
    return 1.0 - markov_quiet(order, weeks)


def markov_next(order: int) -> dict[str, Column]:
    """The more probable next flag and its probability; a tie counts as a change."""
    seen = _seen_last(order)
    quiet = _first_still(order)
    busy = F.when(seen, 1.0 - quiet).otherwise(F.lit(0.0))
    return {
        f"next_flag{order}": F.when(quiet > busy, 0).otherwise(1),
        f"next_prob{order}": F.when(quiet > busy, quiet).otherwise(busy),
    }


def _seen_last(order: int) -> Column:
    """The last state has been left at least once."""
    n = lambda s: F.col(f"n{s}0") + F.col(f"n{s}1") > 0
    if order == 1:
        return F.when(F.col("last1") == 0, n("0")).otherwise(n("1"))
    out = F.lit(False)
    for a in (0, 1):
        for b in (0, 1):
            out = F.when((F.col("last2") == a) & (F.col("last1") == b), n(f"{a}{b}")).otherwise(out)
    return out


def markov_quantile(order: int, q: float) -> Column:
    """Weeks until a change is more probable than q, null where that never happens."""
    first, steady = _first_still(order), _still("0" * order)
    lead = first
    if order == 2:
        lead = first * F.when(F.col("last1") == 0, _still("00")).otherwise(_still("10"))
    more = F.when(steady <= 0, F.lit(1.0)).when(
        steady < 1, F.floor(F.log((1 - q) / lead) / F.log(steady)).cast("double") + 1
    )
    n = F.when(1 - first > q, 1)
    if order == 2:
        n = n.when(1 - lead > q, 2)
    n = n.otherwise(F.when(more.isNotNull(), order + F.greatest(more, F.lit(1.0))))
    return n.cast("int")


def comparison_rates(acc: DataFrame, interval: float = WEEK) -> DataFrame:
    """Changes per day from the change flags of regular accesses: plain and improved."""
    n, x = F.col("accesses").cast("double"), F.col("changes").cast("double")
    return (
        acc.groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("accesses"), F.sum("changed").alias("changes"))
        .withColumns(
            {
                "rate_intuitive": x / n / interval,
                "rate_improved": -F.log((n - x + 0.5) / (n + 0.5)) / interval,
            }
        )
    )


def access_gaps(acc: DataFrame) -> DataFrame:
    """Number of accesses from one change to the next."""
    hits = acc.where(F.col("changed") == 1)
    return hits.select(
        *KEYS, "snapshot", (F.col("position") - F.coalesce(F.lag("position").over(_in_order()), F.lit(0))).alias("gap")
    )


def access_gap_distribution(acc: DataFrame, t: int, q: float, interval: float = WEEK) -> DataFrame:
    """Share of gaps up to t accesses, and the gap at quantile q in days."""
    return access_gaps(acc).groupBy(*KEYS).agg(
        (F.count_if(F.col("gap") <= t) / F.count(F.lit(1))).alias("cdf"),
        (F.percentile("gap", q) * interval).alias("quantile_days"),
    )


def smoothing(acc: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Exponentially smoothed gap, alpha being the weight of the older value.

    The fold y = alpha * y + (1 - alpha) * gap is a weighted sum: gap i of n has the weight
    (1 - alpha) * alpha^(n - i), the first one alpha^(n - 1).
    """
    w = W.partitionBy(*KEYS)
    g = gaps(acc).withColumns(
        {"i": F.row_number().over(w.orderBy("modified")), "n": F.count(F.lit(1)).over(w)}
    )
    i, n, gap = F.col("i"), F.col("n"), F.col("gap")
    weight = F.when(i == 1, F.pow(F.lit(alpha), n - 1)).otherwise((1 - alpha) * F.pow(F.lit(alpha), n - i))
    return g.groupBy(*KEYS).agg(F.sum(weight * gap).alias("smoothed"))


def _features(acc: DataFrame) -> DataFrame:
    """Accesses with everything the estimators add up, on the one partitioning by key."""
    whole = _in_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return _states(acc).withColumn("newest", F.last("modified").over(whole)).withColumn("gap", _gap())


def recrawl_interval(acc: DataFrame, q: float = 0.5) -> DataFrame:
    """When to look again at confidence q, by Poisson, by the gaps and by the chains."""
    rows = _features(acc).groupBy(*KEYS).agg(
        *_rate_aggregates(), *_markov_aggregates(), F.percentile("gap", q).alias("gap_days")
    )
    rows = _with_last(rows).withColumn("mu", 1 / naive_rate())
    return rows.select(
        *KEYS,
        poisson_quantile(F.lit(q), F.col("mu")).alias("poisson_days"),
        "gap_days",
        markov_quantile(1, q).alias("markov1_weeks"),
        markov_quantile(2, q).alias("markov2_weeks"),
    )


#: A history needs more accesses than this for an estimate of freshness; shorter ones have none.
MIN_HISTORY = 10


def scores(hist: DataFrame, snapshot: int, min_history: int = MIN_HISTORY) -> DataFrame:
    """Probability that a resource has changed since its last known modification, by five
    estimates per source, null for histories of up to min_history accesses. One shuffle:
    windows and sums share the partitioning by key."""
    age = F.datediff(thursday_of(F.lit(snapshot)), F.col("newest"))
    known = F.count("gap")
    emp = F.when(known > 0, F.count_if(F.col("gap") <= age) / known)
    rows = _features(accesses(hist)).groupBy(*KEYS).agg(
        *_rate_aggregates(), *_markov_aggregates(), emp.alias("emp_dist")
    )
    return _estimates(_with_last(rows), snapshot, min_history)


def _estimates(rows: DataFrame, snapshot: int, min_history: int) -> DataFrame:
    rows = rows.withColumns({"rate_naive": naive_rate(), "rate_improved": improved_rate(), "age": days_since(F.lit(snapshot))})
    rows = rows.withColumn("weeks", F.greatest(F.round(F.col("age") / 7.0).cast("int"), F.lit(1)))
    estimates = {
        "cho_naive": poisson_cdf(F.col("age"), 1 / F.col("rate_naive")),
        "cho_impr": poisson_cdf(F.col("age"), 1 / F.col("rate_improved")),
        "emp_dist": F.col("emp_dist"),
        "mark1": markov_cdf(1, F.col("weeks")),
        "mark2": markov_cdf(2, F.col("weeks")),
    }
    known = F.col("accesses") > min_history
    return rows.select(*KEYS, *[F.when(known, x).alias(name) for name, x in estimates.items()])


#: Sums of a summary, which later weeks add to.
SUMS = ["accesses", "changes", "observed", *[f"n{a}{b}" for a in (0, 1) for b in (0, 1)], *[f"n{a}{b}{c}" for a in (0, 1) for b in (0, 1) for c in (0, 1)]]


def fold(summary: DataFrame | None, hist: DataFrame) -> DataFrame:
    """One row per resource and source that stands for its whole history: the summary of the weeks so
    far and the later weeks of `hist`, however many.

    It holds the sums of the estimators, the last two change flags, the last access and date, and the
    distinct dates (one per week at most), from which gaps follow. Earlier weeks are not read again.
    """
    w = _in_order()
    rows = observations(hist).withColumn("access", thursday_of(F.col("snapshot")))
    before = ["last_access", "last_modified", "flag1", "flag2"]
    if summary is None:
        kinds = ("date", "date", "int", "int")
        rows = rows.withColumns({f"_{c}": F.lit(None).cast(kind) for c, kind in zip(before, kinds)})
    else:
        rows = rows.join(summary.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in before]), KEYS, "left")
    rows = rows.withColumn("nr", F.row_number().over(w))
    earlier = lambda c, known: F.when(F.col("nr") == 1, F.col(known)).otherwise(F.lag(c).over(w))
    rows = rows.withColumns({"_access": earlier("access", "_last_access"), "_modified": earlier("modified", "_last_modified")})
    rows = rows.withColumns(
        {
            "interval_days": F.coalesce(F.datediff("access", "_access"), F.lit(WEEK)),
            "age_days": F.datediff("access", "modified"),
            "changed": (~F.col("_modified").eqNullSafe(F.col("modified"))).cast("int"),
        }
    )
    second = F.when(F.col("nr") == 1, F.col("_flag2")).when(F.col("nr") == 2, F.col("_flag1")).otherwise(F.lag("changed", 2).over(w))
    rows = rows.withColumns({"c1": earlier("changed", "_flag1"), "c2": second})
    last = F.max(F.struct("snapshot", "access", "modified", "changed", "c1"))
    counts = _markov_aggregates()[:-1]
    new = rows.groupBy(*KEYS).agg(*_rate_aggregates()[:-1], *counts, last.alias("last"), F.collect_set("modified").alias("dates"))
    new = new.select(
        *KEYS, *SUMS, F.col("last.access").alias("last_access"), F.col("last.modified").alias("last_modified"),
        F.col("last.changed").alias("flag1"), F.col("last.c1").alias("flag2"), F.array_sort("dates").alias("dates"),
    )
    if summary is None:
        return new
    old = summary.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in (*SUMS, *before, "dates")])
    both = old.join(new, KEYS, "full")
    total = lambda c: (F.coalesce(F.col(f"_{c}"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))).alias(c)
    seen = F.col("last_access").isNotNull()
    none = F.array().cast("array<date>")
    dates = F.array_sort(F.array_union(F.coalesce("_dates", none), F.coalesce("dates", none)))
    return both.select(*KEYS, *[total(c) for c in SUMS], *[F.when(seen, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in before], dates.alias("dates"))


def folded_scores(summary: DataFrame, snapshot: int, min_history: int = MIN_HISTORY) -> DataFrame:
    """The scores of whole histories from their summaries; nothing is shuffled."""
    age = days_since(F.lit(snapshot))
    steps = F.transform(F.slice("dates", 2, F.greatest(F.size("dates") - 1, F.lit(0))), lambda d, i: F.datediff(d, F.get("dates", i)))
    rows = summary.withColumns({"gaps": steps, "last1": F.col("flag1"), "last2": F.coalesce("flag2", F.lit(0))})
    emp = F.when(F.size("gaps") > 0, F.size(F.filter("gaps", lambda g: g <= age)) / F.size("gaps"))
    return _estimates(rows.withColumn("emp_dist", emp), snapshot, min_history)


ESTIMATES = ["cho_naive", "cho_impr", "emp_dist", "mark1", "mark2"]


def score_rows(hist: DataFrame, snapshot: int, min_history: int = MIN_HISTORY) -> DataFrame:
    """Wide row per resource, those with short histories included: every estimate for header and
    for metadata dates, null where there is none."""
    return _wide(scores(hist, snapshot, min_history), snapshot)


def folded_rows(summary: DataFrame, snapshot: int, min_history: int = MIN_HISTORY) -> DataFrame:
    """score_rows() from summaries."""
    return _wide(folded_scores(summary, snapshot, min_history), snapshot)


def _wide(long: DataFrame, snapshot: int) -> DataFrame:
    cols = [
        F.max(F.when(F.col("source") == source, F.col(e))).alias(f"{e}_{source}")
        for e in ESTIMATES
        for source in ("header", "metadata")
    ]
    return long.groupBy("uri", "md5").agg(*cols).withColumn("snapshot", F.lit(snapshot))
