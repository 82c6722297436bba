"""Queries over joins, distributions, portal statistics and points in time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catascope.operators import joins as jo
from catascope.operators import quality as qu
from catascope.operators import schema_org as so
from catascope.operators import stats as sa
from catascope.operators import timetravel as tt
from catascope.operators import windows as wi
from catascope.plans.registry import query
from catascope.plans.views import Catalogue
from catascope.session import scratch
from catascope.sources.clustered import read_key, write_clustered
from catascope.sources import tables

MR = "v_dataset d join v_metaresource m on m.md5 = d.md5"
RI = MR + " join v_resourceinfo r on r.uri = m.uri and r.snapshot = d.snapshot"
P = "v_portal p on p.id = d.portalid"

QUALITY_SQL = "select d.portalid, d.snapshot, " + ", ".join(
    f"round_even(avg(cast(cast(q.{m} as int) as double)) * 100, 0) / 100 as {m}, cast(count(q.{m}) as int) as \"{m}N\""
    if m in qu.BOOLEAN_METRICS
    else f"round_even(avg(q.{m}) * 100, 0) / 100 as {m}, cast(count(q.{m}) as int) as \"{m}N\""
    for m in qu.PORTAL_METRICS
) + ", cast(count(*) as int) as datasets from v_dataset d join v_datasetquality q on q.md5 = d.md5 group by d.portalid, d.snapshot"


def portal_quality(c: Catalogue):
    return qu.portal_quality(c.dataset, c.datasetquality)


@query("portal_quality", QUALITY_SQL)
def q_portal_quality(c: Catalogue):
    return portal_quality(c)


@query("format_dist", f"select snapshot, format, count(*) as count from {MR} group by all")
def format_dist(c: Catalogue):
    return sa.format_dist(c.dataset, c.metaresource)


@query("format_dist_portal", f"select portalid, snapshot, format, count(*) as count from {MR} group by all")
def format_dist_portal(c: Catalogue):
    return sa.format_dist(c.dataset, c.metaresource, ("portalid", "snapshot"))


@query("format_dist_software", f"select d.snapshot, p.software, p.iso, m.format, count(*) as count from {MR} join {P} group by all")
def format_dist_software(c: Catalogue):
    return sa.format_dist(c.dataset, c.metaresource, ("snapshot", "software", "iso"), portals=c.portal)


@query("status_dist", f"select d.snapshot, r.status, count(*) as count from {RI} group by all")
def status_dist(c: Catalogue):
    return sa.status_dist(c.dataset, c.metaresource, c.resourceinfo)


@query("status_dist_organisation", f"select d.portalid, d.organisation, d.snapshot, r.status, count(*) as count from {RI} group by all")
def status_dist_organisation(c: Catalogue):
    return sa.status_dist(c.dataset, c.metaresource, c.resourceinfo, ("portalid", "organisation"))


@query("organisation_dist", "select portalid, snapshot, organisation, count(*) as count from v_dataset group by all")
def organisation_dist(c: Catalogue):
    return sa.organisation_dist(c.dataset, ("portalid", "snapshot"))


@query("license_dist", "select d.portalid, d.snapshot, c.license, count(*) as count from v_dataset d join v_content c on c.md5 = d.md5 group by all")
def license_dist(c: Catalogue):
    return sa.license_dist(c.dataset, c.content, ("portalid", "snapshot"))


@query("valid_url_dist", f"select d.portalid, d.snapshot, m.valid, count(*) as count, count(m.valid) as judged from {MR} group by all")
def valid_url_dist(c: Catalogue):
    return sa.valid_url_dist(c.dataset, c.metaresource, ("portalid", "snapshot"))


@query("distinct_formats", f"select distinct d.snapshot, m.format from {MR}")
def distinct_formats(c: Catalogue):
    return sa.distinct_formats(c.dataset, c.metaresource)


@query("distinct_licenses", "select distinct d.portalid, d.snapshot, c.license from v_dataset d join v_content c on c.md5 = d.md5")
def distinct_licenses(c: Catalogue):
    return sa.distinct_licenses(c.dataset, c.content, ("portalid", "snapshot"))


@query("distinct_organisations", "select distinct portalid, snapshot, organisation from v_dataset")
def distinct_organisations(c: Catalogue):
    return sa.distinct_organisations(c.dataset, ("portalid", "snapshot"))


@query("distinct_numbers", f"""
select o.portalid, o.snapshot, organisations, formats, licenses
from (select portalid, snapshot, count(*) as organisations from (select distinct portalid, snapshot, organisation from v_dataset) x group by all) o
join (select portalid, snapshot, count(*) as formats from (select distinct d.portalid, d.snapshot, m.format from {MR}) x group by all) f on f.portalid = o.portalid and f.snapshot = o.snapshot
join (select portalid, snapshot, count(*) as licenses from (select distinct d.portalid, d.snapshot, c.license from v_dataset d join v_content c on c.md5 = d.md5) x group by all) l on l.portalid = o.portalid and l.snapshot = o.snapshot""")
def distinct_numbers(c: Catalogue):
    return sa.distinct_numbers(c.dataset, c.metaresource, c.content, ("portalid", "snapshot"))


@query("format_dist_groupings", f"""
select coalesce(format, 'missing') as format, snapshot, portalid as "grouping", 'portal' as level, count(*) as count from {MR} group by all
union all select coalesce(format, 'missing'), snapshot, nullif(iso, 'AS'), 'iso', count(*) from {MR} join {P} group by all
union all select coalesce(format, 'missing'), snapshot, software, 'software', count(*) from {MR} join {P} group by all""")
def format_dist_groupings(c: Catalogue):
    """Some portals have no country."""
    portals = c.portal.withColumn("iso", F.nullif("iso", F.lit("AS")))
    return sa.format_dist_groupings(c.dataset, c.metaresource, portals)


@query("meta_resources", f"select d.portalid, d.snapshot, d.id, d.title, m.uri, m.md5, m.format, m.size from {MR}")
def meta_resources(c: Catalogue):
    rows = jo.meta_resources(c.dataset, c.metaresource)
    return rows.select("portalid", "snapshot", "id", "title", "uri", "md5", "format", "size")


@query("organisation_resources", f"select d.portalid, d.snapshot, d.organisation, count(*) as resources, count(distinct m.uri) as uris from {MR} group by all")
def organisation_resources(c: Catalogue):
    ds = c.dataset.select("portalid", "snapshot", "id", "organisation")
    rows = jo.meta_resources(c.dataset, c.metaresource).join(ds, ["portalid", "snapshot", "id"])
    return rows.groupBy("portalid", "snapshot", "organisation").agg(
        F.count(F.lit(1)).alias("resources"), F.countDistinct("uri").alias("uris")
    )


@query("resource_infos", f"select d.portalid, d.snapshot, d.id, d.title, r.uri, r.status, r.timestamp from {RI}")
def resource_infos(c: Catalogue):
    rows = jo.resource_infos(c.dataset, c.metaresource, c.resourceinfo)
    return rows.select("portalid", "snapshot", "id", "title", "uri", "status", "timestamp")


@query("data_resources", f"select d.portalid, d.snapshot, m.uri, d.id, d.md5 from {MR} where m.valid and m.format = 'json'")
def data_resources(c: Catalogue):
    return jo.data_resources(c.dataset, c.metaresource, format="json")


@query("csv_resources", f"select d.portalid, d.snapshot, d.id, d.title, m.uri, m.size from {MR} where m.format = 'csv'")
def csv_resources(c: Catalogue):
    return jo.csv_resources(c.dataset, c.metaresource)


@query("portals_all", f"""
with q as ({QUALITY_SQL})
select s.portalid, s.snapshot, s.status, s.datasetcount, q.exda, q.opfo, q.datasets, p.software, p.iso
from v_portalsnapshot s left join q on q.portalid = s.portalid and q.snapshot = s.snapshot join v_portal p on p.id = s.portalid""")
def portals_all(c: Catalogue):
    rows = jo.portals_all(c.portalsnapshot, portal_quality(c), c.portal)
    return rows.select("portalid", "snapshot", "status", "datasetcount", "exda", "opfo", "datasets", "software", "iso")


STATS_SQL = "select portalid, count(*) as sn_count, min(snapshot) as sn_first, max(snapshot) as sn_last, max_by(datasetcount, snapshot) as datasetcount, max_by(resourcecount, snapshot) as resourcecount from v_portalsnapshot group by portalid"


@query("portal_stats", f"""
with s as ({STATS_SQL})
select p.id as portalid, p.uri, p.software, p.iso, sn_count, sn_first, sn_last, datasetcount, resourcecount
from v_portal p left join s on s.portalid = p.id where active""")
def portal_stats(c: Catalogue):
    rows = sa.portal_stats(c.portalsnapshot, c.portal)
    return rows.select("portalid", "uri", "software", "iso", "sn_count", "sn_first", "sn_last", "datasetcount", "resourcecount")


@query("portals_quality", f"""
with q as ({QUALITY_SQL}), s as ({STATS_SQL})
select q.portalid, q.snapshot, q.exdi, q.cofo, p.software, s.datasetcount, s.resourcecount
from q join v_portal p on p.id = q.portalid left join s on s.portalid = q.portalid""")
def portals_quality(c: Catalogue):
    rows = jo.portals_quality(portal_quality(c), c.portal, sa.portal_stats(c.portalsnapshot))
    return rows.select("portalid", "snapshot", "exdi", "cofo", "software", "datasetcount", "resourcecount")


@query("dashboard", f"""
with q as ({QUALITY_SQL})
select s.portalid, s.snapshot, p.uri, s.status, s.resourcecount, q.coac, q.datasets,
  round((epoch_us(end_ts) - epoch_us(start_ts)) / 1000000.0, 3) as duration
from v_portalsnapshot s join q on q.portalid = s.portalid and q.snapshot = s.snapshot join v_portal p on p.id = s.portalid""")
def dashboard(c: Catalogue):
    rows = jo.dashboard(c.portal, c.portalsnapshot, portal_quality(c))
    return rows.select(
        "portalid", "snapshot", "uri", "status", "resourcecount", "coac", "datasets", F.round("duration", 3).alias("duration")
    )


@query("document_resources", """
select m.uri, m.md5, m.format, r.status, r.timestamp as looked_up from v_metaresource m
left join v_resourceinfo r on r.uri = m.uri and r.snapshot = 2402""")
def document_resources(c: Catalogue):
    rows = jo.document_resources(c.metaresource, c.resourceinfo, 2402)
    return rows.select("uri", "md5", "format", "status", "looked_up")


@query("license_search", f"select m.uri, d.portalid, d.snapshot, d.id, d.title, c.license from {MR} join v_content c on c.md5 = d.md5")
def license_search(c: Catalogue):
    return jo.license_search(c.dataset, c.metaresource, c.content)


@query("documents", "select d.portalid, d.snapshot, d.id, c.md5, c.license, c.modified from v_dataset d join v_content c on c.md5 = d.md5")
def documents(c: Catalogue):
    rows = jo.documents(c.dataset, c.content)
    return rows.select("portalid", "snapshot", "id", "md5", "license", "modified")


@query("dataset_quality", "select d.portalid, d.snapshot, d.id, d.md5, q.exda, q.coac, q.opli from v_dataset d join v_datasetquality q on q.md5 = d.md5")
def dataset_quality(c: Catalogue):
    rows = jo.dataset_quality(c.dataset, c.datasetquality)
    return rows.select("portalid", "snapshot", "id", "md5", "exda", "coac", "opli")


@query("organisation_content", "select d.portalid, d.snapshot, d.id, d.organisation, d.md5, c.license, q.exdi from v_dataset d join v_content c on c.md5 = d.md5 join v_datasetquality q on q.md5 = d.md5")
def organisation_content(c: Catalogue):
    rows = jo.organisation_content(c.dataset, c.content, c.datasetquality)
    return rows.select("portalid", "snapshot", "id", "organisation", "md5", "license", "exdi")


@query("unfetched_resources", f"""
select distinct d.portalid, d.snapshot, m.uri from {MR} where m.valid
and not exists (select 1 from v_resourceinfo r where r.uri = m.uri and r.snapshot = d.snapshot)""")
def unfetched_resources(c: Catalogue):
    return jo.unfetched_resources(c.dataset, c.metaresource, c.resourceinfo, c.portal)


@query("undownloaded_resources", f"""
select d.portalid, d.snapshot, m.uri, d.id, d.md5 from {MR} where m.valid
and not exists (select 1 from v_crawllog r where r.uri = m.uri and r.snapshot = d.snapshot and r.status = 200)""")
def undownloaded_resources(c: Catalogue):
    return jo.undownloaded_resources(c.dataset, c.metaresource, c.crawllog.where("status = 200"))


@query("portals_to_repair", """
select id as portalid from v_portal where id not in (select portalid from v_portalsnapshot where snapshot = 2403 and status = 200)""")
def portals_to_repair(c: Catalogue):
    return jo.portals_to_repair(c.portal, c.portalsnapshot, 2403)


@query("without_partial", f"""
with q as ({QUALITY_SQL})
select q.portalid, q.snapshot, q.datasets from q where not (snapshot = 2403 and portalid not in (select portalid from v_portalsnapshot where snapshot = 2403 and status = 200))""")
def without_partial(c: Catalogue):
    return tables.without_partial(portal_quality(c), c.portal, c.portalsnapshot, 2403).select("portalid", "snapshot", "datasets")


@query("known_content", "select distinct m.uri, m.md5 from v_metaresource m where exists (select 1 from v_resourceinfo r where r.uri = m.uri)")
def known_content(c: Catalogue):
    return jo.known(c.metaresource.select("uri", "md5"), c.resourceinfo, ["uri"])


@query("snapshot_pairs", """
with d as (select portalid, id, snapshot, case when title is null or (length(id) + snapshot) % 4 = 0 then null else md5 end as md5 from v_dataset)
select coalesce(a.portalid, b.portalid) as portalid, coalesce(a.id, b.id) as id, a.md5, b.md5 as md5_previous,
  case when b.id is null then 'added' when a.id is null then 'deleted' when a.md5 is distinct from b.md5 then 'updated' else 'static' end as change
from (select * from d where snapshot = 2403) a full join (select * from d where snapshot = 2402) b
on a.portalid = b.portalid and a.id = b.id""")
def snapshot_pairs(c: Catalogue):
    """Some documents are empty: they have no hash, and one that stays empty is static."""
    empty = F.col("title").isNull() | ((F.length("id") + F.col("snapshot")) % 4 == 0)
    return jo.snapshot_pairs(c.dataset.withColumn("md5", F.when(~empty, F.col("md5"))), 2403, 2402)


@query("run_pairs", """
select a.portalid, a.status, a.datasetcount, a.resourcecount, b.status as status_previous, b.datasetcount as datasetcount_previous, b.resourcecount as resourcecount_previous
from v_portalsnapshot a join v_portalsnapshot b on a.portalid = b.portalid where a.snapshot = 2403 and b.snapshot = 2402""")
def run_pairs(c: Catalogue):
    return jo.run_pairs(c.portalsnapshot, 2403, 2402)


@query("evolution", f"""
with q as ({QUALITY_SQL})
select s.portalid, s.snapshot, s.datasetcount, s.resourcecount, q.exri, q.opma from v_portalsnapshot s left join q on q.portalid = s.portalid and q.snapshot = s.snapshot""")
def evolution(c: Catalogue):
    return jo.evolution(c.portalsnapshot, portal_quality(c)).select("portalid", "snapshot", "datasetcount", "resourcecount", "exri", "opma")


@query("lookup_history", "select uri, snapshot, status, timestamp from v_resourceinfo order by uri, snapshot")
def lookup_history(c: Catalogue):
    return jo.lookup_history(c.resourceinfo).select("uri", "snapshot", "status", "timestamp").orderBy("uri", "snapshot")


LINK_SQL = f"""
select d.portalid, d.snapshot, r.uri, r.status, d.id, d.title,
  case software when 'CKAN' then concat(apiuri, '/dataset/', d.id) when 'Socrata' then concat(p.uri, 'dataset/', d.id)
  when 'OpenDataSoft' then concat(p.uri, 'explore/dataset/', d.id) else d.id end as dataset_uri,
  case when r.status = 200 then 'ok' when r.status > 400 and r.status < 600 then 'error' else 'other' end as status_class
from {RI} join {P}"""


@query("link_check", LINK_SQL)
def link_check(c: Catalogue):
    return jo.link_check(c.dataset, c.metaresource, c.resourceinfo, c.portal)


@query("link_check_totals", f"""
select portalid, snapshot, count(*) as total, count(*) filter (where status = 200) as ok, count(*) filter (where status = 404) as missing,
  count(*) filter (where status not in (200, 404)) as other from ({LINK_SQL}) x group by all""")
def link_check_totals(c: Catalogue):
    rows = jo.resource_infos(c.dataset, c.metaresource, c.resourceinfo)
    return sa.link_check_totals(rows)


@query("system_evolution", """
select snapshot, software, count(*) as portals, cast(sum(datasetcount) as bigint) as datasets, cast(sum(resourcecount) as bigint) as resources
from v_portalsnapshot join v_portal on id = portalid group by all""")
def system_evolution(c: Catalogue):
    return sa.system_evolution(c.portalsnapshot, c.portal)


@query("harvest_counts", """
select d.portalid, d.snapshot, count(distinct d.id) as datasetsfetched, count(m.uri) as resourcecount
from v_dataset d left join v_metaresource m on m.md5 = d.md5 group by all""")
def harvest_counts(c: Catalogue):
    return sa.harvest_counts(c.dataset, c.metaresource)


@query("closed_runs", """
select s.portalid, s.snapshot, s.status, s.datasetcount, s.datasetcount as datasetsfetched, s.resourcecount from v_portalsnapshot s""")
def closed_runs(c: Catalogue):
    rows = sa.close_runs(c.portalsnapshot, c.dataset, c.metaresource)
    return rows.select("portalid", "snapshot", "status", "datasetcount", "datasetsfetched", "resourcecount")


@query("version_ranges", "select portalid, id, md5, min(snapshot) as sn_min, max(snapshot) as sn_max, count(*) as seen from v_dataset group by all")
def version_ranges(c: Catalogue):
    return sa.version_ranges(c.dataset)


@query("version_islands", """
with f as (select portalid, id, snapshot, md5, case when lag(md5) over w is not distinct from md5 then 0 else 1 end as fresh from v_dataset window w as (partition by portalid, id order by snapshot)),
v as (select *, cast(sum(fresh) over (partition by portalid, id order by snapshot) as int) as version from f)
select portalid, id, version, md5, min(snapshot) as sn_min, max(snapshot) as sn_max from v group by all""")
def version_islands(c: Catalogue):
    return sa.version_islands(c.dataset)


@query("active_portals", "select count(*) filter (where active) as active, count(*) as portals from v_portal")
def active_portals(c: Catalogue):
    return sa.active_portals(c.portal)


@query("element_counts", "select snapshot, title as value, count(*) as count from v_dataset group by all")
def element_counts(c: Catalogue):
    return sa.value_counts(c.dataset, F.col("title"), ("snapshot",))


@query("seeds_per_domain", "select domain, count(*) as count from (select distinct uri, regexp_extract(uri, '://([^/?#]+)', 1) as domain from v_metaresource where valid) x group by domain")
def seeds_per_domain(c: Catalogue):
    return sa.seeds_per_domain(c.metaresource.where("valid").select("uri").distinct())


@query("size_histogram", """
with k as (select software, datasetcount as v from v_portalsnapshot join v_portal on id = portalid),
t as (select software, max(v) as top from k group by software)
select k.software, cast(case when v = top then 9 else least(floor(log10(v) / log10(top) * 9) + 1, 9) end as int) as bin, count(*) as count, min(v) as smallest, max(v) as largest
from k join t on t.software = k.software where v >= 1 group by all""")
def size_histogram(c: Catalogue):
    p = c.portal.select(F.col("id").alias("portalid"), "software")
    counts = c.portalsnapshot.join(p, "portalid").select("software", "datasetcount")
    return sa.size_histogram(counts, "datasetcount")


@query("exceptions_by_type", "select snapshot, exc, count(*) as count from v_resourceinfo where exc is not null group by all")
def exceptions_by_type(c: Catalogue):
    return sa.exceptions_by_type(c.resourceinfo)


@query("distinct_uris", "select distinct uri from v_crawllog")
def distinct_uris(c: Catalogue):
    return c.crawllog.select("uri").distinct()


def _top_sql(dist: str, value: str) -> str:
    return f"""
with dist as ({dist}),
r as (select *, row_number() over (partition by portalid, snapshot order by count desc, {value} asc nulls last) as rank,
  sum(count) over (partition by portalid, snapshot) as total, count(*) over (partition by portalid, snapshot) as distinct_values from dist)
select portalid, snapshot, coalesce({value}, 'missing') as value, count, count / total as perc, cast(rank as int) as rank, distinct_values from r where rank <= 3
union all
select portalid, snapshot, 'Others', cast(sum(count) as bigint), sum(count) / any_value(total), 4, any_value(distinct_values) from r where rank > 3 group by portalid, snapshot"""


@query("top_organisations", _top_sql("select portalid, snapshot, organisation, count(*) as count from v_dataset group by all", "organisation"))
def top_organisations(c: Catalogue):
    return sa.top_n(sa.organisation_dist(c.dataset, ("portalid", "snapshot")), "organisation")


@query("top_licenses", _top_sql("select d.portalid, d.snapshot, c.license, count(*) as count from v_dataset d join v_content c on c.md5 = d.md5 group by all", "license"))
def top_licenses(c: Catalogue):
    return sa.top_n(sa.license_dist(c.dataset, c.content, ("portalid", "snapshot")), "license")


@query("top_formats", _top_sql(f"select d.portalid, d.snapshot, m.format, count(*) as count from {MR} group by all", "format"))
def top_formats(c: Catalogue):
    return sa.top_n(sa.format_dist(c.dataset, c.metaresource, ("portalid", "snapshot")), "format")


def _means_sql(by: str) -> str:
    cols = ", ".join(f"round(avg({m}), 6) as {m}" for m in qu.PORTAL_METRICS)
    return f"with q as ({QUALITY_SQL}) select snapshot, {by}, {cols}, count(*) as count from q join v_portal p on p.id = q.portalid group by all"


def _means(c: Catalogue, by: str):
    rows = sa.quality_means(portal_quality(c), c.portal, by, qu.PORTAL_METRICS)
    return rows.select("snapshot", by, *[F.round(m, 6).alias(m) for m in qu.PORTAL_METRICS], "count")


@query("quality_by_iso", _means_sql("iso"))
def quality_by_iso(c: Catalogue):
    return _means(c, "iso")


@query("quality_by_software", _means_sql("software"))
def quality_by_software(c: Catalogue):
    return _means(c, "software")


@query("run_sequence", "select portalid, snapshot, cast(row_number() over (partition by portalid order by snapshot) as int) as run_no from v_portalsnapshot where end_ts is not null")
def run_sequence(c: Catalogue):
    return wi.run_sequence(c.portalsnapshot).select("portalid", "snapshot", "run_no")


@query("harvest_progress", """
with e as (select snapshot, portalid, (epoch_us(end_ts) - min(epoch_us(start_ts)) over (partition by snapshot)) / 1000000 as elapsed from v_portalsnapshot where end_ts is not null)
select snapshot, portalid, round(elapsed, 3) as elapsed, round(case when count(*) over (partition by snapshot) > 1 then (row_number() over (partition by snapshot order by elapsed, portalid) - 1) / (count(*) over (partition by snapshot) - 1) else 0 end, 6) as progress
from e""")
def harvest_progress(c: Catalogue):
    return wi.harvest_progress(c.portalsnapshot).select(
        "snapshot", "portalid", F.round("elapsed", 3).alias("elapsed"), F.round("progress", 6).alias("progress")
    )


@query("previous_runs", "select portalid, snapshot, lag(snapshot) over (partition by portalid order by snapshot) as previous from v_portalsnapshot")
def previous_runs(c: Catalogue):
    return wi.previous_runs(c.portalsnapshot)


@query("neighbour_weeks", """
with n as (select uri as portalid, snapshot, lag(snapshot) over w as back, lead(snapshot) over w as ahead from (select distinct uri, snapshot from v_history) h window w as (partition by uri order by snapshot)),
d as (select *, cast(date_trunc('week', make_date(2000 + snapshot // 100, 1, 4)) as date) + (snapshot % 100 - 1) * 7 as monday from n)
select portalid, snapshot, case when back = cast((extract(isoyear from (monday - 7)) % 100) * 100 + extract(week from (monday - 7)) as int) then back end as prev,
  case when ahead = cast((extract(isoyear from (monday + 7)) % 100) * 100 + extract(week from (monday + 7)) as int) then ahead end as next from d""")
def neighbour_weeks(c: Catalogue):
    return wi.neighbour_weeks(c.history.withColumnRenamed("uri", "portalid"))


@query("last_digest", "select uri, max_by(digest, event_id) as digest, max(timestamp) as timestamp from v_crawllog where status = 200 group by uri")
def last_digest(c: Catalogue):
    return wi.last_digest(c.crawllog)


@query("crawl_waves", """
with u as (select distinct uri, regexp_extract(uri, '://([^/?#]+)', 1) as domain, cast('0x' || substr(md5(uri), 1, 4) as int) % 1024 as b from v_metaresource where valid),
w as (select domain, uri, row_number() over (partition by domain order by b, uri) as wave from u)
select domain, uri, wave, (wave - 1) * 5 as earliest_start from w""")
def crawl_waves(c: Catalogue):
    return wi.crawl_waves(c.metaresource.where("valid"))


@query("crawl_wave_totals", """
select domain, count(*) as uris, 1 as first_wave, count(*) as last_wave, count(*) as waves, (count(*) - 1) * 5 as last_start
from (select distinct uri, regexp_extract(uri, '://([^/?#]+)', 1) as domain from v_metaresource where valid) x group by domain""")
def crawl_wave_totals(c: Catalogue):
    rows = wi.crawl_waves(c.metaresource.where("valid"))
    return rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("uris"),
        F.min("wave").cast("int").alias("first_wave"),
        F.max("wave").alias("last_wave"),
        F.countDistinct("wave").alias("waves"),
        F.max("earliest_start").alias("last_start"),
    )


@query("unseen_seeds", """
select regexp_extract(uri, '://([^/?#]+)', 1) as domain, uri from (select distinct uri from v_metaresource) m
where not exists (select 1 from v_crawllog c where c.uri = m.uri and c.status = 200 and c.snapshot = 2405)""")
def unseen_seeds(c: Catalogue):
    return wi.crawl_waves(c.metaresource, c.crawllog.where("status = 200 and snapshot = 2405")).select("domain", "uri")


@query("resource_history", "select uri, md5, source, snapshot, modified from v_history order by uri, md5, source, snapshot")
def resource_history(c: Catalogue):
    return wi.resource_history(c.history)


FLAG_SQL = """
with f as (select *, last_value(case when status = 200 then digest end ignore nulls) over (partition by uri order by timestamp, event_id rows between unbounded preceding and 1 preceding) as before from v_crawllog)
select uri, snapshot, timestamp, event_id, status, digest, cast(case when status <> 200 then -1 when before = digest then 0 else 1 end as int) as contentchanged from f"""


def flagged(c: Catalogue):
    return wi.content_changed(c.crawllog)


@query("content_changed", FLAG_SQL)
def content_changed(c: Catalogue):
    return flagged(c).select("uri", "snapshot", "timestamp", "event_id", "status", "digest", "contentchanged")


@query("as_of_dataset", """
select portalid, id, max(snapshot) as snapshot, max_by(md5, snapshot) as md5, max_by(title, snapshot) as title from v_dataset where snapshot <= 2403 group by portalid, id""")
def as_of_dataset(c: Catalogue):
    return tt.as_of(c.dataset, 2403).select("portalid", "id", "snapshot", "md5", "title")


@query("as_of_join", """
with q as (select e.event_id, n.n_name as portalid, concat(cast(e.user_id as varchar), '-', case e.event_type when 'view' then 'click' else e.event_type end) as id, e.snapshot
  from v_event_sn e join customer on user_id = c_custkey join nation n on c_nationkey = n_nationkey)
select q.event_id, q.portalid, q.id, q.snapshot, v.snapshot as found, v.md5 from q asof join v_dataset v on q.portalid = v.portalid and q.id = v.id and q.snapshot >= v.snapshot""")
def as_of_join(c: Catalogue):
    e = c.event_sn.join(c.table("customer"), F.col("user_id") == F.col("c_custkey")).join(
        c.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    kind = F.when(F.col("event_type") == "view", "click").otherwise(F.col("event_type"))
    requests = e.select(
        "event_id", F.col("n_name").alias("portalid"), F.concat(F.col("user_id").cast("string"), F.lit("-"), kind).alias("id"), "snapshot"
    )
    return tt.as_of_join(requests, c.dataset)


@query("latest_download", "select uri, max_by(disklocation, event_id) as disklocation, max(timestamp) as timestamp from v_crawllog group by uri")
def latest_download(c: Catalogue):
    return tt.latest_download(c.crawllog)


@query("first_after", "select uri, min_by(disklocation, event_id) as disklocation, min(timestamp) as timestamp from v_crawllog where timestamp > timestamp '2024-01-15 12:00:00' group by uri")
def first_after(c: Catalogue):
    return tt.first_after(c.crawllog, F.lit(dt.datetime(2024, 1, 15, 12)))


@query("time_map", f"""
with x as ({FLAG_SQL}), y as (select * from x where contentchanged = 1)
select uri, timestamp, event_id, min(timestamp) over (partition by uri) as first, max(timestamp) over (partition by uri) as last, count(*) over (partition by uri) as versions from y""")
def time_map(c: Catalogue):
    return tt.time_map(flagged(c))


@query("portal_as_of", "select portalid, max(snapshot) as snapshot, max_by(datasetcount, snapshot) as datasetcount from v_portalsnapshot where snapshot <= 2404 and status = 200 group by portalid")
def portal_as_of(c: Catalogue):
    return tt.portal_as_of(c.portalsnapshot.where("status = 200"), 2404).select("portalid", "snapshot", "datasetcount")


@query("stored_locations", "select uri, digest, min_by(disklocation, event_id) as disklocation from v_crawllog where status = 200 group by uri, digest")
def stored_locations(c: Catalogue):
    log = c.crawllog.where("status = 200")
    return tt.stored_locations(log, log)


@query("new_content", "select distinct md5 from v_dataset where md5 not in (select md5 from v_dataset where snapshot <= 2402)")
def new_content(c: Catalogue):
    stored = c.dataset.where("snapshot <= 2402").select("md5").distinct()
    return tables.new_content(c.dataset, stored).select("md5")


@query("sitemap", """
select d.portalid, d.snapshot, 'weekly' as changefreq, case when c.modified >= timestamp '1980-01-01' then strftime(c.modified, '%Y-%m-%d') end as lastmod,
  concat('http://example.org/', d.portalid, '/', replace(replace(to_base64(encode(d.id)), '+', '-'), '/', '_')) as loc
from v_dataset d left join v_content c on c.md5 = d.md5""")
def sitemap(c: Catalogue):
    return so.sitemap(c.dataset, c.content, "http://example.org")


@query("sitemap_index", """
select distinct portalid as pid, snapshot, strftime(cast(date_trunc('week', make_date(2000 + snapshot // 100, 1, 4)) as date) + (snapshot % 100 - 1) * 7, '%Y-%m-%d') as lastmod,
  concat('http://example.org/', portalid, '/sitemap.xml') as loc from v_portalsnapshot""")
def sitemap_index(c: Catalogue):
    return so.sitemap_index(c.portalsnapshot, "http://example.org")


@query("site_list", """
select portalid, snapshot, coalesce(title, id) as name, replace(replace(to_base64(encode(id)), '+', '-'), '/', '_') as file from v_dataset""")
def site_list(c: Catalogue):
    return so.site_list(c.dataset)


@query("organisation_links", """
select distinct portalid, snapshot, organisation, concat('http://example.org/portal/', portalid, '/', cast(snapshot as varchar), '/report/', url_encode(organisation)) as link
from v_dataset where organisation is not null""")
def organisation_links(c: Catalogue):
    return so.organisation_links(c.dataset, "http://example.org")



@query("portal_list", "select id, uri, iso from v_portal where software = 'CKAN' and active")
def portal_list(c: Catalogue):
    return jo.portals(c.portal, software="CKAN", active=True).select("id", "uri", "iso")


@query("portal_snapshots", "select distinct portalid, snapshot from v_portalsnapshot")
def portal_snapshots(c: Catalogue):
    return jo.snapshots(c.portalsnapshot)


@query("dataset_list", "select portalid, snapshot, id, organisation, title, md5 from v_dataset")
def dataset_list(c: Catalogue):
    return jo.datasets(c.dataset)


@query("id_union", "select distinct portalid, id from v_dataset where snapshot in (2404, 2405)")
def id_union(c: Catalogue):
    return jo.id_union(c.dataset, 2404, 2405)


@query("id_difference", "select portalid, id from v_dataset where snapshot = 2404 except select portalid, id from v_dataset where snapshot = 2405")
def id_difference(c: Catalogue):
    return jo.id_difference(c.dataset, 2404, 2405)


@query("largest_organisations", """
select organisation, count(*) as count from v_dataset where snapshot = 2403 group by organisation order by count desc, organisation asc nulls first limit 10""")
def largest_organisations(c: Catalogue):
    rows = sa.organisation_dist(c.dataset, ("snapshot",), snapshot=2403).select("organisation", "count")
    return rows.orderBy(F.desc("count"), F.asc_nulls_first("organisation")).limit(10)


@query("status_dist_ordered", f"select d.portalid, d.snapshot, r.status, count(*) as count from {RI} group by all order by count desc, portalid, snapshot, status")
def status_dist_ordered(c: Catalogue):
    return sa.status_dist(c.dataset, c.metaresource, c.resourceinfo, ("portalid", "snapshot"), ordered=True)


@query("as_of_quality", """
with a as (select portalid, id, max(snapshot) as snapshot, max_by(md5, snapshot) as md5 from v_dataset where snapshot <= 2402 group by portalid, id)
select a.portalid, a.id, a.snapshot, q.* from a join v_datasetquality q on q.md5 = a.md5""")
def as_of_quality(c: Catalogue):
    found = tt.as_of(c.dataset, 2402).select("portalid", "id", "snapshot", "md5")
    return found.join(c.datasetquality, "md5")


@query("resources_by_size", """
select portalid, snapshot, count(*) as resources, count(*) filter (where size > 0 and size <= 5000) as known_small from v_dataset d join v_metaresource m on m.md5 = d.md5 where size <= 5000 or size is null group by all""")
def resources_by_size(c: Catalogue):
    rows = jo.meta_resources(c.dataset, c.metaresource, max_size=5000)
    return rows.groupBy("portalid", "snapshot").agg(
        F.count(F.lit(1)).alias("resources"), F.count_if((F.col("size") > 0) & (F.col("size") <= 5000)).alias("known_small")
    )


POINT_SQL = "select uri, timestamp, event_id, status from v_crawllog where uri = (select min(uri) from v_crawllog where status = 404)"


@query("lookup_history_of_uri", POINT_SQL + " and event_type <> 'view'")
def lookup_history_of_uri(c: Catalogue):
    """One resource's lookups, read from files in the order of the resources."""
    path = _clustered_log(c)
    uri = c.crawllog.where("status = 404").agg(F.min("uri")).first()[0]
    rows = read_key(c.spark, path, "uri", uri)
    return rows.where("event_type <> 'view'").select("uri", "timestamp", "event_id", "status")


@query("stored_versions_of_uri", "select uri, timestamp, event_id, digest from v_crawllog where status = 200 and uri = (select min(uri) from v_crawllog where status = 404)")
def stored_versions_of_uri(c: Catalogue):
    """One resource's downloads from the same files."""
    path = _clustered_log(c)
    uri = c.crawllog.where("status = 404").agg(F.min("uri")).first()[0]
    return read_key(c.spark, path, "uri", uri).where("status = 200").select("uri", "timestamp", "event_id", "digest")


def _clustered_log(c: Catalogue) -> str:
    path = scratch(c.spark, "clustered")
    write_clustered(c.crawllog, path, ["uri", "timestamp"], files=16)
    return path
