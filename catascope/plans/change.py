"""Queries over the change between snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from catascope.functions.ratios import change_ratios, safe_ratio
from catascope.operators import dynamics as dy
from catascope.operators import joins as jo
from catascope.operators import windows as wi
from catascope.plans.registry import query
from catascope.plans.views import Catalogue

CHANGE_SQL = """
with r as (select portalid, snapshot, lag(snapshot) over (partition by portalid order by snapshot) as previous from v_portalsnapshot),
cur as (select r.portalid, r.snapshot, d.id, d.md5 from r join v_dataset d on d.portalid = r.portalid and d.snapshot = r.snapshot),
prev as (select r.portalid, r.snapshot, d.id, d.md5 from r join v_dataset d on d.portalid = r.portalid and d.snapshot = r.previous),
x as (select coalesce(c.portalid, p.portalid) as portalid, coalesce(c.snapshot, p.snapshot) as snapshot, coalesce(c.id, p.id) as id, c.md5, p.md5 as md5_previous,
  case when p.md5 is null then 'added' when c.md5 is null then 'deleted' when p.md5 <> c.md5 then 'updated' else 'static' end as change
  from cur c full join prev p on c.portalid = p.portalid and c.snapshot = p.snapshot and c.id = p.id),
counts as (select portalid, snapshot, cast(count(*) filter (where change = 'added') as int) as added, cast(count(*) filter (where change = 'deleted') as int) as deleted,
  cast(count(*) filter (where change = 'updated') as int) as updated, cast(count(*) filter (where change = 'static') as int) as static,
  cast(count(*) filter (where change <> 'deleted') as int) as size, cast(count(*) as int) as union_size from x group by portalid, snapshot),
dyn as (select *, (added + deleted + updated) / union_size as ratio from counts),
freq as (select *, avg(case when added + deleted + updated > 0 then 1 else 0 end) over w as changefrequ, list_reverse_sort(list(ratio) over w) as ratios
  from dyn window w as (partition by portalid order by snapshot rows between unbounded preceding and current row)),
idx as (select *, coalesce(cast(floor(list_filter(ratios, lambda e, i: 100 * (i / len(ratios)) >= floor(e * 100))[1] * 100) as int), 0) as dindex from freq)
"""


def _changes(c: Catalogue):
    return dy.dataset_changes(c.dataset, c.portalsnapshot)


def _dynamicity(c: Catalogue):
    return dy.dynamicity(c.dataset, c.portalsnapshot)


@query("dataset_changes", CHANGE_SQL + "select portalid, snapshot, id, change, md5, md5_previous from x")
def dataset_changes(c: Catalogue):
    return _changes(c)


@query("change_list", CHANGE_SQL + """
select x.portalid, x.snapshot, x.id, x.change, coalesce(c.name, x.id) as name
from x left join v_content c on c.md5 = case x.change when 'added' then x.md5 else x.md5_previous end where change <> 'static'""")
def change_list(c: Catalogue):
    return dy.change_list(_changes(c), c.content)


@query("dynamicity", CHANGE_SQL + """
select portalid, snapshot, added, deleted, updated, static, size, union_size, union_size as intersected, round(changefrequ, 6) as changefrequ, dindex from idx""")
def dynamicity(c: Catalogue):
    rows = _dynamicity(c).withColumn("changefrequ", F.round("changefrequ", 6))
    return rows.select(
        "portalid", "snapshot", "added", "deleted", "updated", "static", "size", "union_size", "intersected", "changefrequ", "dindex"
    )


@query("change_frequency", CHANGE_SQL + "select portalid, snapshot, round(changefrequ, 6) as changefrequ from idx")
def change_frequency(c: Catalogue):
    counts = dy.change_counts(_changes(c), c.portalsnapshot)
    return dy.change_frequency(counts).select("portalid", "snapshot", F.round("changefrequ", 6).alias("changefrequ"))


@query("dynamicity_index", CHANGE_SQL + "select portalid, snapshot, dindex from idx")
def dynamicity_index(c: Catalogue):
    counts = dy.change_counts(_changes(c), c.portalsnapshot)
    return dy.dynamicity_index(counts).select("portalid", "snapshot", "dindex")


@query("running_changes", CHANGE_SQL + """
select portalid, snapshot, cast(count(*) over w as int) as runs, round(max(ratio) over w, 6) as highest, round(min(ratio) over w, 6) as lowest
from dyn window w as (partition by portalid order by snapshot rows between unbounded preceding and current row)""")
def running_changes(c: Catalogue):
    counts = dy.change_counts(_changes(c), c.portalsnapshot)
    ratio = safe_ratio(F.col("added") + F.col("deleted") + F.col("updated"), F.col("union_size"))
    rows = wi.running_changes(counts.withColumn("dyratio", ratio))
    return rows.select(
        "portalid", "snapshot", F.size("ratios").alias("runs"),
        F.round(F.array_max("ratios"), 6).alias("highest"), F.round(F.array_min("ratios"), 6).alias("lowest"),
    )


RATIO_SQL = """round((added + deleted + updated) / union_size, 6) as dyratio,
  round(case when added + deleted > 0 then (added - deleted) / (added + deleted) else 0 end, 6) as adddelratio,
  round(added / union_size, 6) as addratio, round(deleted / union_size, 6) as delratio,
  round(updated / union_size, 6) as updatedratio, round(static / union_size, 6) as staticratio"""


@query("dynamics_series", CHANGE_SQL + f"select portalid, snapshot, dindex, {RATIO_SQL} from idx")
def dynamics_series(c: Catalogue):
    rows = dy.with_ratios(_dynamicity(c))
    names = list(change_ratios(*[F.lit(1)] * 5))
    return rows.select("portalid", "snapshot", "dindex", *[F.round(n, 6).alias(n) for n in names])


@query("portal_dynamics", CHANGE_SQL + f"""
select i.portalid, i.snapshot, p.software, p.iso, i.size, i.dindex, {RATIO_SQL} from idx i join v_portal p on p.id = i.portalid""")
def portal_dynamics(c: Catalogue):
    rows = jo.portal_dynamics(c.portal, _dynamicity(c))
    names = list(change_ratios(*[F.lit(1)] * 5))
    return rows.select("portalid", "snapshot", "software", "iso", "size", "dindex", *[F.round(n, 6).alias(n) for n in names])


SYSTEM_SQL = """
case when status <> status_previous then 'status' when datasetcount <> datasetcount_previous then 'datasets' when resourcecount <> resourcecount_previous then 'resources' end as kind,
  cast(case when status <> status_previous then status_previous when datasetcount <> datasetcount_previous then datasetcount_previous else resourcecount_previous end as bigint) as value_from,
  cast(case when status <> status_previous then status when datasetcount <> datasetcount_previous then datasetcount else resourcecount end as bigint) as value_to"""


@query("system_changes", f"""
with p as (select a.portalid, a.status, a.datasetcount, a.resourcecount, b.status as status_previous, b.datasetcount as datasetcount_previous, b.resourcecount as resourcecount_previous
  from v_portalsnapshot a join v_portalsnapshot b on a.portalid = b.portalid where a.snapshot = 2404 and b.snapshot = 2403),
k as (select portalid, {SYSTEM_SQL} from p)
select *, case when kind <> 'status' then value_to - value_from end as difference from k where kind is not null""")
def system_changes(c: Catalogue):
    return dy.system_changes(c.portalsnapshot, 2404, 2403)


@query("system_change_series", f"""
with p as (select *, lag(snapshot) over w as previous, lag(status) over w as status_previous, lag(datasetcount) over w as datasetcount_previous, lag(resourcecount) over w as resourcecount_previous
  from v_portalsnapshot window w as (partition by portalid order by snapshot)),
k as (select portalid, snapshot, previous, {SYSTEM_SQL} from p where previous is not null)
select *, case when kind <> 'status' then value_to - value_from end as difference from k where kind is not null""")
def system_change_series(c: Catalogue):
    return dy.system_change_series(c.portalsnapshot)
