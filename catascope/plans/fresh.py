"""Queries over the freshness of resources. v_history has up to 300 weeks per resource, and
resources with seven at most."""

from __future__ import annotations

from pyspark.sql import functions as F

from catascope.operators import freshness as fr
from catascope.plans.registry import query
from catascope.plans.views import Catalogue
from catascope.session import staged

AS_OF = 2201
THURSDAY = "(cast(date_trunc('week', make_date(2000 + {0} // 100, 1, 4)) as date) + ({0} % 100 - 1) * 7 + 3)"
K = "uri, md5, source"

ACC_SQL = f"""
with a as (select *, {THURSDAY.format('snapshot')} as access, count(*) over (partition by {K}) as n, row_number() over w as position,
    lag(modified) over w as before, lag({THURSDAY.format('snapshot')}) over w as access_before
  from v_history window w as (partition by {K} order by snapshot)),
acc as (select {K}, snapshot, modified, cast(position as int) as position, cast(coalesce(access - access_before, 7) as int) as interval_days, cast(access - modified as int) as age_days,
    cast(case when before = modified then 0 else 1 end as int) as changed from a),
rates as (select {K}, count(*) as accesses, cast(count(*) filter (where age_days < interval_days) as bigint) as changes, cast(sum(least(age_days, interval_days)) as bigint) as observed,
    max_by(modified, snapshot) as last_modified from acc group by {K}),
r as (select *, case when changes > 0 and observed > 0 then changes / observed end as rate_naive,
    case when changes > 0 and changes < accesses and observed > 0 then ((changes - 1) - changes / (accesses * ln(1 - changes / accesses))) / observed end as rate_improved,
    cast({THURSDAY.format(str(AS_OF))} - last_modified as int) as age from rates),
dates as (select distinct {K}, modified from acc),
gaps as (select * from (select {K}, modified, cast(modified - lag(modified) over (partition by {K} order by modified) as int) as gap from dates) g where gap > 0),
st as (select {K}, snapshot, modified, changed, lag(changed, 1) over w as c1, lag(changed, 2) over w as c2 from acc window w as (partition by {K} order by snapshot)),
mk as (select {K}, max_by(changed, snapshot) as last1, max_by(c1, snapshot) as last2, max_by(modified, snapshot) as last_modified,
    {', '.join(f"count(*) filter (where c1 = {a} and changed = {b}) as n{a}{b}" for a in (0, 1) for b in (0, 1))},
    {', '.join(f"count(*) filter (where c2 = {a} and c1 = {b} and changed = {d}) as n{a}{b}{d}" for a in (0, 1) for b in (0, 1) for d in (0, 1))}
  from st group by {K}),
pr as (select *, {', '.join(f"case when n{s}0 + n{s}1 > 0 then n{s}0 / (n{s}0 + n{s}1) else 0 end as q{s}" for s in ('0', '1', '00', '01', '10', '11'))},
    greatest(cast(round(({THURSDAY.format(str(AS_OF))} - last_modified) / 7.0) as int), 1) as weeks from mk),
ms as (select *, case last1 when 0 then q0 else q1 end as f1,
    case when last2 = 0 and last1 = 0 then q00 when last2 = 0 and last1 = 1 then q01 when last2 = 1 and last1 = 0 then q10 else q11 end as f2,
    case last1 when 0 then q00 else q10 end as s2 from pr)
"""


def _acc(c: Catalogue):
    return fr.accesses(c.history)


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query("history_rows", """
with used as (select distinct snapshot, md5 from v_dataset),
mr as (select m.uri, m.md5, u.snapshot, m.modified from v_metaresource m join used u on u.md5 = m.md5)
select uri, md5, snapshot, cast(modified as date) as modified, 'metadata' as source from mr where modified is not null
union all select mr.uri, mr.md5, mr.snapshot, cast(r.timestamp as date), 'header' from mr join v_resourceinfo r on r.uri = mr.uri and r.snapshot = mr.snapshot where r.status = 200""")
def history_rows(c: Catalogue):
    text = F.date_format("timestamp", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(F.col("status") == 200, F.create_map(F.lit("Last-Modified"), F.array(text)))
    return fr.history(c.dataset, c.metaresource, c.resourceinfo.withColumn("header", header))


@query("change_flags", ACC_SQL + f"select {K}, snapshot, modified, position, interval_days, age_days, changed from acc")
def change_flags(c: Catalogue):
    return _acc(c).select(*fr.KEYS, "snapshot", "modified", "position", "interval_days", "age_days", "changed")


@query("rate_naive", ACC_SQL + f"select {K}, accesses, changes, observed, round(rate_naive, 9) as rate_naive from r")
def rate_naive(c: Catalogue):
    return fr.last_modified_rates(_acc(c)).select(*fr.KEYS, "accesses", "changes", "observed", _r("rate_naive", 9))


@query("rate_improved", ACC_SQL + f"select {K}, round(rate_improved, 9) as rate_improved from r")
def rate_improved(c: Catalogue):
    return fr.last_modified_rates(_acc(c)).select(*fr.KEYS, _r("rate_improved", 9))


@query("comparison_rates", ACC_SQL + f"""
select {K}, count(*) as accesses, cast(sum(changed) as bigint) as changes, round(sum(changed) / count(*) / 7, 9) as rate_intuitive,
  round(-ln((count(*) - sum(changed) + 0.5::double) / (count(*) + 0.5::double)) / 7, 9) as rate_improved from acc group by {K}""")
def comparison_rates(c: Catalogue):
    return fr.comparison_rates(_acc(c)).select(*fr.KEYS, "accesses", "changes", _r("rate_intuitive", 9), _r("rate_improved", 9))


POISSON_SQL = "case when {1} > 0 then case when {0} < 0 then 0 else least(1, list_sum(list_transform(range(0, {0} + 1), lambda i: exp(-1 / {1} + i * ln(1 / {1}) - lgamma(i + 1))))) end end"


@query("freshness_poisson", ACC_SQL + f"""
select {K}, round({POISSON_SQL.format('age', 'rate_naive')}, 6) as cho_naive, round({POISSON_SQL.format('age', 'rate_improved')}, 6) as cho_impr from r""")
def freshness_poisson(c: Catalogue):
    rates = fr.last_modified_rates(_acc(c))
    age = fr.days_since(F.lit(AS_OF))
    return rates.select(
        *fr.KEYS,
        F.round(fr.poisson_cdf(age, 1 / F.col("rate_naive")), 6).alias("cho_naive"),
        F.round(fr.poisson_cdf(age, 1 / F.col("rate_improved")), 6).alias("cho_impr"),
    )


@query("freshness_ecdf", ACC_SQL + f"""
select g.uri, g.md5, g.source, round(count(*) filter (where gap <= age) / count(*), 6) as emp_dist
from gaps g join r on r.uri = g.uri and r.md5 = g.md5 and r.source = g.source group by all""")
def freshness_ecdf(c: Catalogue):
    acc = _acc(c)
    return fr.gap_distribution(acc, fr.last_modified_rates(acc), AS_OF).select(*fr.KEYS, _r("emp_dist"))


@query("freshness_markov", ACC_SQL + f"""
select {K}, weeks, round(1 - f1 * pow(q0, weeks - 1), 6) as mark1, round(1 - case when weeks <= 1 then f2 else f2 * s2 * pow(q00, weeks - 2) end, 6) as mark2 from ms""")
def freshness_markov(c: Catalogue):
    weeks = F.greatest(F.round(fr.days_since(F.lit(AS_OF)) / 7.0).cast("int"), F.lit(1))
    rows = fr.markov_counts(_acc(c)).withColumn("weeks", weeks)
    return rows.select(
        *fr.KEYS, "weeks",
        F.round(fr.markov_cdf(1, F.col("weeks")), 6).alias("mark1"), F.round(fr.markov_cdf(2, F.col("weeks")), 6).alias("mark2"),
    )


@query("markov_next", ACC_SQL + f"""
select {K}, case when f1 > g1 then 0 else 1 end as next_flag1, round(greatest(f1, g1), 6) as next_prob1, case when f2 > g2 then 0 else 1 end as next_flag2, round(greatest(f2, g2), 6) as next_prob2
from (select *, case when case last1 when 0 then n00 + n01 else n10 + n11 end > 0 then 1 - f1 else 0 end as g1,
  case when case when last2 = 0 and last1 = 0 then n000 + n001 when last2 = 0 and last1 = 1 then n010 + n011 when last2 = 1 and last1 = 0 then n100 + n101 else n110 + n111 end > 0 then 1 - f2 else 0 end as g2 from ms) z""")
def markov_next(c: Catalogue):
    cols = fr.markov_next(1) | fr.markov_next(2)
    rows = fr.markov_counts(_acc(c)).withColumns(cols)
    return rows.select(*fr.KEYS, "next_flag1", _r("next_prob1"), "next_flag2", _r("next_prob2"))


@query("recrawl_interval", ACC_SQL + f"""
, ps as (select {K}, case when rate_naive > 0 then cast(list_filter(range(0, 2000), lambda t: list_sum(list_transform(range(0, t + 1), lambda i: exp(-1 / rate_naive + i * ln(1 / rate_naive) - lgamma(i + 1)))) >= 0.5)[1] as int) end as poisson_days from r),
gp as (select {K}, quantile_cont(cast(gap as double), 0.5) as gap_days from gaps group by {K}),
steps as (select {K}, list_filter(range(1, 10001), lambda n: 1 - f1 * pow(q0, n - 1) > 0.5)[1] as m1,
  list_filter(range(1, 10001), lambda n: 1 - case when n = 1 then f2 else f2 * s2 * pow(q00, n - 2) end > 0.5)[1] as m2 from ms)
select ps.uri, ps.md5, ps.source, poisson_days, gap_days, cast(m1 as int) as markov1_weeks, cast(m2 as int) as markov2_weeks
from ps left join gp on gp.uri = ps.uri and gp.source = ps.source left join steps on steps.uri = ps.uri and steps.source = ps.source""")
def recrawl_interval(c: Catalogue):
    return fr.recrawl_interval(_acc(c), 0.5)


@query("access_gaps", ACC_SQL + f"""
, h as (select {K}, position - coalesce(lag(position) over (partition by {K} order by snapshot), 0) as gap from acc where changed = 1)
select {K}, round(count(*) filter (where gap <= 3) / count(*), 6) as cdf, quantile_cont(cast(gap as double), 0.9) * 7 as quantile_days from h group by {K}""")
def access_gaps(c: Catalogue):
    rows = fr.access_gap_distribution(_acc(c), 3, 0.9)
    return rows.select(*fr.KEYS, _r("cdf"), "quantile_days")


@query("smoothing", ACC_SQL + f"""
, g as (select {K}, list(cast(gap as double) order by modified) as l from gaps group by {K})
select {K}, round(list_reduce(l, lambda y, d: 0.7 * y + 0.3 * d), 6) as smoothed from g""")
def smoothing(c: Catalogue):
    return fr.smoothing(_acc(c), 0.7).select(*fr.KEYS, _r("smoothed"))


SCORES_SQL = ACC_SQL + f"""
, e as (select g.uri, g.md5, g.source, count(*) filter (where gap <= age) / count(*) as emp from gaps g join r on r.uri = g.uri and r.md5 = g.md5 and r.source = g.source group by all),
s as (select r.uri, r.md5, r.source, r.accesses, {POISSON_SQL.format('age', 'rate_naive')} as cho_naive, {POISSON_SQL.format('age', 'rate_improved')} as cho_impr, e.emp as emp_dist,
  1 - f1 * pow(q0, weeks - 1) as mark1, 1 - case when weeks <= 1 then f2 else f2 * s2 * pow(q00, weeks - 2) end as mark2
  from r join ms on ms.uri = r.uri and ms.md5 = r.md5 and ms.source = r.source left join e on e.uri = r.uri and e.md5 = r.md5 and e.source = r.source)
select uri, md5, {AS_OF} as snapshot, """ + ", ".join(
    f"round(max({e}) filter (where source = '{s}' and accesses > 10), 6) as {e}_{s}" for e in fr.ESTIMATES for s in ("header", "metadata")
) + " from s group by uri, md5"


@query("freshness_scores", SCORES_SQL)
def freshness_scores(c: Catalogue):
    rows = fr.score_rows(c.history, AS_OF)
    names = [f"{e}_{s}" for e in fr.ESTIMATES for s in ("header", "metadata")]
    return rows.select("uri", "md5", "snapshot", *[_r(n) for n in names])


@query("freshness_folded", SCORES_SQL)
def freshness_folded(c: Catalogue):
    """The same scores from summaries that were carried on twice, never from a week that is in one."""
    summary = None
    for first, last in ((0, 1400), (1401, 1600), (1601, 9999)):
        summary = staged(fr.fold(summary, c.history.where(F.col("snapshot").between(first, last))), "summary")
    rows = fr.folded_rows(summary, AS_OF)
    names = [f"{e}_{s}" for e in fr.ESTIMATES for s in ("header", "metadata")]
    return rows.select("uri", "md5", "snapshot", *[_r(n) for n in names])
