"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catascope.functions import cells as ce
from catascope.functions import licenses as li
from catascope.functions import ratios as ra
from catascope.functions import snapshot as sn
from catascope.functions import status as st
from catascope.functions import text as tx
from catascope.functions import urls as ur
from catascope.operators import profile as pr
from catascope.plans.registry import query
from catascope.plans.views import Catalogue

YYWW = "cast((extract(isoyear from {0}) % 100) * 100 + extract(week from {0}) as int)"


@query("snapshot_id", f"""
select cast(ts as date) as day, {YYWW.format('ts')} as snapshot,
  {YYWW.format("(ts - interval 7 days)")} as week_before, count(*) as events
from events group by all""")
def snapshot_id(c: Catalogue):
    ts = F.col("ts")
    return c.table("events").groupBy(
        ts.cast("date").alias("day"), sn.snapshot_of(ts).alias("snapshot"), sn.snapshot_of(ts, -7).alias("week_before")
    ).agg(F.count(F.lit(1)).alias("events"))


@query("week_bounds", f"""
with w as (select distinct snapshot from v_history),
m as (select snapshot, cast(date_trunc('week', make_date(2000 + snapshot // 100, 1, 4)) as date) + (snapshot % 100 - 1) * 7 as monday from w)
select snapshot, monday, monday + 6 as sunday, monday + 3 as thursday,
  {YYWW.format("(monday + 7)")} as next_week, {YYWW.format("(monday - 7)")} as previous_week,
  concat('W', cast(snapshot % 100 as varchar), '-''', lpad(cast(snapshot // 100 as varchar), 2, '0')) as label,
  concat(strftime(monday, '%b %-d'), ' - ', strftime(monday + 6, '%b %-d, %Y')) as span
from m""")
def week_bounds(c: Catalogue):
    s = F.col("snapshot")
    return c.history.select("snapshot").distinct().select(
        "snapshot",
        sn.monday_of(s).alias("monday"),
        sn.sunday_of(s).alias("sunday"),
        sn.thursday_of(s).alias("thursday"),
        sn.next_snapshot(s).alias("next_week"),
        sn.previous_snapshot(s).alias("previous_week"),
        sn.week_label(s).alias("label"),
        sn.week_span(s).alias("span"),
    )


@query("snapshot_range", f"""
with o as (select unnest(generate_series(cast(o_orderdate as date), cast(o_orderdate as date) + 29, interval 7 days)) as d from orders)
select {YYWW.format('d')} as snapshot, count(*) as open_orders from o group by all""")
def snapshot_range(c: Catalogue):
    day = F.col("o_orderdate").cast("date")
    weeks = sn.snapshots_between(day, F.date_add(day, 30))
    return c.table("orders").select(F.explode(weeks).alias("snapshot")).groupBy("snapshot").agg(
        F.count(F.lit(1)).alias("open_orders")
    )


@query("last_snapshots", f"""
with w as (select distinct snapshot from v_event_sn),
m as (select snapshot, cast(date_trunc('week', make_date(2000 + snapshot // 100, 1, 4)) as date) + (snapshot % 100 - 1) * 7 as monday from w),
x as (select snapshot, monday, unnest([1, 2, 3, 4, 5]) as i from m)
select snapshot, cast(i as int) as weeks_ago, {YYWW.format("(monday - cast(7 * i as int))")} as earlier from x""")
def last_snapshots(c: Catalogue):
    rows = c.event_sn.select("snapshot").distinct()
    return rows.select("snapshot", F.posexplode(sn.last_snapshots(F.col("snapshot"), 5)).alias("pos", "earlier")).select(
        "snapshot", (F.col("pos") + 1).alias("weeks_ago"), "earlier"
    )


@query("partial_timestamps", """
with t as (select o_orderkey, substr(strftime(o_orderdate, '%Y%m%d%H%M%S'), 1, case substr(o_orderpriority, 1, 1) when '1' then 4 when '2' then 6 when '3' then 8 when '4' then 9 else 14 end) as given from orders),
u as (select o_orderkey, given, substr(given, 1, length(given) - length(given) % 2) as used from t)
select o_orderkey, given, try_strptime(used || substr('00000101000000', length(used) + 1), '%Y%m%d%H%M%S') as parsed from u""")
def partial_timestamps(c: Catalogue):
    n = F.substring("o_orderpriority", 1, 1)
    length = F.when(n == "1", 4).when(n == "2", 6).when(n == "3", 8).when(n == "4", 9).otherwise(14)
    text = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    rows = c.table("orders").select("o_orderkey", F.substring(text, F.lit(1), length).alias("given"))
    return rows.select("o_orderkey", "given", tx.partial_timestamp(F.col("given")).alias("parsed"))


@query("url_parts", """
select page_id, regexp_extract(url, '://([^/?#]+)', 1) as domain,
  regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') as valid,
  case when regexp_matches(url, '^[a-z]+://[^/?#]+($|[?#])') then regexp_replace(url, '^([a-z]+://[^/?#]+)', '\\1/') else url end as normal,
  concat(replace(regexp_extract(url, '://([^/?#]+)', 1), '.', '_'),
    case when length(regexp_extract(url, '://[^/?#]+([^?#]*)', 1)) > 1 then replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/', '_') else '' end) as portal
from pages""")
def url_parts(c: Catalogue):
    url = F.col("url")
    return c.table("pages").select(
        "page_id",
        ur.domain(url).alias("domain"),
        ur.url_valid(url).alias("valid"),
        ur.normalise_url(url).alias("normal"),
        ur.portal_id(url).alias("portal"),
    )


@query("url_repair", """
select page_id, url as repaired from pages""")
def url_repair(c: Catalogue):
    broken = F.when(F.col("url").startswith("http://"), F.concat(F.lit("http:// "), F.col("url"))).otherwise(F.col("url"))
    return c.table("pages").select("page_id", ur.repair_url(broken).alias("repaired"))


@query("contact_validity", r"""
select doc_id, coalesce(regexp_matches(contact_email, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+'), false) as email_valid,
  coalesce(regexp_matches(contact_email, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'), false) as url_valid,
  coalesce(contact_email like 'http://%', false) as uri_valid
from v_doc""")
def contact_validity(c: Catalogue):
    e = F.col("contact_email")
    return c.doc.select(
        "doc_id", ur.email_valid(e).alias("email_valid"), ur.url_valid(e).alias("url_valid"), ur.uri_valid(e).alias("uri_valid")
    )


@query("status_labels", """
select status, case status when 602 then '602' else cast(status as varchar) end as label,
  case when status = 200 then 'ok' when status > 400 and status < 600 then 'error' else 'other' end as status_class, count(*) as results
from v_crawllog group by all""")
def status_labels(c: Catalogue):
    s = F.col("status")
    return c.crawllog.groupBy("status", st.status_label(s).alias("label"), st.status_class(s).alias("status_class")).agg(
        F.count(F.lit(1)).alias("results")
    )


@query("harvest_status", """
select portalid, snapshot, status, case status when 702 then 'Connection Error' else '200' end as label,
  case status when 702 then 'requests.exceptions.ConnectionError' else null end as exc, status as code
from v_portalsnapshot""")
def harvest_status(c: Catalogue):
    exc = F.when(F.col("status") == 702, "requests.exceptions.ConnectionError")
    return c.portalsnapshot.withColumn("exc", exc).select(
        "portalid", "snapshot", "status", st.status_label(F.col("status")).alias("label"), "exc",
        st.harvest_status(F.col("exc")).alias("code"),
    )


CELL_SQL = """
with cells as (
  select 'customer' as file, 'c_name' as col, c_custkey as row, c_name as value from customer
  union all select 'customer', 'c_mktsegment', c_custkey, c_mktsegment from customer
  union all select 'customer', 'c_acctbal', c_custkey, cast(cast(c_acctbal as decimal(18, 2)) as varchar) from customer
  union all select 'customer', 'c_nationkey', c_custkey, cast(c_nationkey as varchar) from customer
  union all select 'orders', 'o_orderdate', o_orderkey, strftime(o_orderdate, '%Y-%m-%d') from orders
  union all select 'orders', 'day', o_orderkey, strftime(o_orderdate, '%Y%m%d') from orders
  union all select 'orders', 'month', o_orderkey, strftime(o_orderdate, '%Y%m') from orders
  union all select 'orders', 'year', o_orderkey, strftime(o_orderdate, '%Y') from orders
  union all select 'orders', 'moment', o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') from orders
  union all select 'orders', 'o_orderstatus', o_orderkey, o_orderstatus from orders
  union all select 'orders', 'o_orderpriority', o_orderkey, o_orderpriority from orders
  union all select 'documents', 'text', doc_id, text from documents
  union all select 'documents', 'contact', doc_id, contact_email from v_doc
  union all select 'documents', 'url', page_id, url from pages)
"""


def text_cells(c: Catalogue):
    """Cells of the text columns of four tables, whole values."""
    name = lambda x: F.col(x)
    orders = c.table("orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("day"),
        F.date_format("o_orderdate", "yyyyMM").alias("month"),
        F.date_format("o_orderdate", "yyyy").alias("year"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("moment"),
        "o_orderstatus",
        "o_orderpriority",
    )
    customers = c.table("customer").withColumn("c_acctbal", name("c_acctbal").cast("decimal(18,2)").cast("string"))
    parts = [
        pr.cells(customers, ["c_name", "c_mktsegment", "c_acctbal", "c_nationkey"], "customer", name("c_custkey")),
        pr.cells(orders, ["o_orderdate", "day", "month", "year", "moment", "o_orderstatus", "o_orderpriority"], "orders", name("o_orderkey")),
        pr.cells(c.table("documents"), ["text"], "documents", name("doc_id")),
        pr.cells(c.doc.withColumnRenamed("contact_email", "contact"), ["contact"], "documents", name("doc_id")),
        pr.cells(c.table("pages"), ["url"], "documents", name("page_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


IS_DATE_SQL = r"""(
    regexp_matches(value, '^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\s*$') or regexp_matches(value, '^\s*[0-9]{4}[0-9]{2}[0-9]{2}\s*$')
    or regexp_matches(value, '^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\s*$'))"""

CELL_TYPE_SQL = rf"""
case when value is null or value = '' or value = 'null' then 'EMPTY'
  when contains(value, '@') and regexp_matches(value, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+') then 'EMAIL'
  when regexp_matches(value, '://|www\.|\.jpg|\.png|\.gif|\.html|\.htm|\.mp3|\.doc|\.pdf|\.ps|\.docx') then 'RESOURCE'
  when regexp_matches(value, '\p{{Nd}}') then
    case when regexp_matches(value, '\p{{L}}') then 'UNKNOWN'
      when regexp_matches(value, '[+ ;\[/\]\\-]') then case when {IS_DATE_SQL} then 'DATE' else 'UNKNOWN' end
      when regexp_matches(value, '[,.]') then 'FLOAT'
      when try_cast(value as bigint) between 1400 and 2100 then 'YEAR'
      when try_cast(value as bigint) >= 197000 and try_cast(value as bigint) < 210000 then 'YEAR_MONTH'
      when length(value) = 8 and {IS_DATE_SQL} then 'DATE' else 'INTEGER' end
  when trim(value) in ('yes', 'no', 'y', 'n', 'j', 'ja', 'nein', 'si', 'oui', 'da', 'njet') then 'YES_NO'
  else 'ALPHA' end"""


@query("cell_type", CELL_SQL + f"select file, col, {CELL_TYPE_SQL} as type, count(*) as cells from cells group by all")
def cell_type(c: Catalogue):
    return text_cells(c).groupBy("file", "col", ce.cell_type(F.col("value")).alias("type")).agg(F.count(F.lit(1)).alias("cells"))


@query("cell_predicates", CELL_SQL + r"""
select file, col, count(*) filter (where regexp_matches(value, '\p{Nd}')) as digits, count(*) filter (where regexp_matches(value, '\p{L}')) as letters,
  count(*) filter (where regexp_matches(value, '[+ ;\[/\]\\-]')) as specials, count(*) filter (where regexp_matches(value, '[,.]')) as commas,
  count(*) filter (where regexp_matches(value, '\p{Nd}') and regexp_matches(value, '\p{L}')) as alphanumeric,
  count(*) filter (where regexp_matches(value, '\p{Nd}') and regexp_matches(value, '[:,/-]')) as separated,
  count(*) filter (where regexp_matches(value, '^\(?\+?\d+\)?(\s?\d+)+$')) as phones,
  count(*) filter (where regexp_matches(value, '^[1|2][0-9][0-9][0-9][\/-]?[0-3][0-9][\/-]?[0-3][0-9]$') or regexp_matches(value, '^((0[1-9])|(1[0-2]))[\/-]((0[1-9])|(1[0-9])|(2[0-9])|(3[0-1]))[\/-](\d{4})')
    or regexp_matches(value, '^([0-9]?[0-9][\.\/-])?([0-3]?[0-9][\.\/-])\s?[1-9][0-9]([0-9][0-9])?$')) as strict_dates
from cells group by file, col""")
def cell_predicates(c: Catalogue):
    v = F.col("value")
    return text_cells(c).groupBy("file", "col").agg(
        F.count_if(ce.has_digit(v)).alias("digits"),
        F.count_if(ce.has_letter(v)).alias("letters"),
        F.count_if(ce.has_special(v)).alias("specials"),
        F.count_if(ce.has_comma(v)).alias("commas"),
        F.count_if(ce.is_alphanumeric(v)).alias("alphanumeric"),
        F.count_if(ce.is_digits_separated(v)).alias("separated"),
        F.count_if(ce.is_phone(v)).alias("phones"),
        F.count_if(ce.is_strict_date(v)).alias("strict_dates"),
    )


@query("format_names", r"""
select format, regexp_replace(lower(trim(format)), '^\.', '') as normal, coalesce(trim(split_part(mimetype, ';', 1)), 'missing') as mime, count(*) as resources
from v_doc_resource group by all""")
def format_names(c: Catalogue):
    return c.doc_resource.groupBy(
        "format", tx.normalise_format(F.col("format")).alias("normal"), tx.mime_or_missing(F.col("mimetype")).alias("mime")
    ).agg(F.count(F.lit(1)).alias("resources"))


@query("clean_titles", r"""
select doc_id, replace(regexp_replace(title, '[^-_.() a-zA-Z0-9]', '', 'g'), ' ', '_') as file_name,
  trim(regexp_replace(title, '\s+', ' ', 'g')) as cleaned,
  title as unquoted
from v_doc""")
def clean_titles(c: Catalogue):
    t = F.col("title")
    quoted = F.concat(F.lit('"'), t, F.lit('"'))
    return c.doc.select(
        "doc_id",
        tx.safe_filename(t).alias("file_name"),
        tx.clean_text(t).alias("cleaned"),
        tx.strip_quotes(quoted).alias("unquoted"),
    )


@query("date_fields", """
select doc_id, try_strptime(created, '%Y-%m-%d') as created, created <> 'unknown' as created_ok,
  case created when 'unknown' then created else concat(created, 'T00:00:00') end as created_text,
  try_strptime(modified, '%Y-%m-%d') as modified
from v_doc""")
def date_fields(c: Catalogue):
    made = F.col("created")
    return c.doc.select(
        "doc_id",
        tx.lenient_datetime(made).alias("created"),
        tx.is_date(made).alias("created_ok"),
        tx.iso_or_text(made).alias("created_text"),
        tx.lenient_datetime(F.col("modified")).alias("modified"),
    )


LICENSE_SQL = """
select doc_id, case license_id when 'cc-by' then 'CC-BY-4.0' when 'cc-zero' then 'CC0-1.0' else coalesce(license_id, case license_title when 'Creative Commons Attribution' then 'CC-BY-4.0' else license_title end, case license_url when 'https://opendatacommons.org/licenses/by' then 'ODC-BY-1.0' end) end as license
from v_doc"""


@query("license_map", f"""
with l as ({LICENSE_SQL})
select doc_id, license, case when license in ('CC-BY-4.0', 'CC0-1.0', 'ODC-BY-1.0') then 'approved' when license = 'other-closed' then 'not reviewed' else 'not found' end as conformance,
  coalesce(license in ('CC-BY-4.0', 'CC0-1.0', 'ODC-BY-1.0'), false) as is_open
from l""")
def license_map(c: Catalogue):
    m = li.map_license(F.col("license_title"), F.col("license_id"), F.col("license_url"))
    rows = c.doc.select("doc_id", m.alias("m"))
    return rows.select(
        "doc_id", F.col("m.id").alias("license"), F.col("m.conformance").alias("conformance"), li.is_open_license(F.col("m.id")).alias("is_open")
    )


@query("license_map_joined", f"""
with l as ({LICENSE_SQL})
select doc_id, license, case when license in ('CC-BY-4.0', 'CC0-1.0', 'ODC-BY-1.0') then 'approved' when license = 'other-closed' then 'not reviewed' else 'not found' end as conformance
from l""")
def license_map_joined(c: Catalogue):
    from catascope.sources.registries import license_table

    rows = c.doc.select("doc_id", "license_title", "license_id", "license_url")
    mapped = li.map_licenses(rows, license_table(c.spark), "license_title", "license_id", "license_url")
    return mapped.select("doc_id", "license", "conformance")


@query("content_hash", """
select doc_id, md5(concat('{"id":', cast(doc_id as varchar), ',"lang":"', lang, '","tags":["', source, '","x"]}')) as md5 from documents""")
def content_hash(c: Catalogue):
    raw = F.concat(
        F.lit('{ "tags" : ["'), F.col("source"), F.lit('", "x"], "lang":"'), F.col("lang"), F.lit('" ,"id": '),
        F.col("doc_id").cast("string"), F.lit("}"),
    )
    return c.table("documents").select("doc_id", ra.content_hash(raw).alias("md5"))


@query("node_ids", """
select doc_id, concat('_:', sha1(concat('<', id, '>', 'license', coalesce(license_id, '')))) as node from v_doc""")
def node_ids(c: Catalogue):
    return c.doc.select("doc_id", ra.node_id(ra.angle(F.col("id")), F.lit("license"), F.col("license_id")).alias("node"))


@query("harvest_duration", """
with d as (select portalid, snapshot, (epoch_us(end_ts) - epoch_us(start_ts)) // 1000000 as seconds from v_portalsnapshot)
select portalid, snapshot, cast(seconds as bigint) as seconds,
  case when seconds is null then null else concat(case when seconds >= 86400 then concat(cast(seconds // 86400 as varchar), 'd ') else '' end,
    cast((seconds // 3600) % 24 as varchar), 'h ', cast((seconds // 60) % 60 as varchar), 'm') end as label
from d""")
def harvest_duration(c: Catalogue):
    s = tx.duration_seconds(F.col("start_ts"), F.col("end_ts"))
    rows = c.portalsnapshot.select("portalid", "snapshot", F.floor(s).alias("seconds"))
    label = F.when(F.col("seconds").isNotNull(), tx.tick_label(F.col("seconds").cast("double")))
    return rows.withColumn("label", label)


@query("header_fields", """
select uri, snapshot, strptime(strftime(timestamp, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') as modified, concat('"', cast(status as varchar), '"') as etag
from v_resourceinfo""")
def header_fields(c: Catalogue):
    text = F.date_format("timestamp", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.create_map(
        F.lit("Last-Modified"), F.array(text), F.lit("ETag"), F.array(F.concat(F.lit('"'), F.col("status").cast("string"), F.lit('"')))
    )
    rows = c.resourceinfo.withColumn("header", header)
    return rows.select(
        "uri", "snapshot", tx.header_date(F.col("header"), "last-modified").alias("modified"), tx.header_value(F.col("header"), "etag").alias("etag")
    )


@query("resource_filters", """
select uri, md5, coalesce(format = 'csv', false) as is_csv, (size <= 4000 or size is null) as small_or_unknown,
  coalesce(size > 0 and size <= 4000, false) as known_small, coalesce(valid = true, false) as is_valid
from v_metaresource""")
def resource_filters(c: Catalogue):
    no = lambda x: F.coalesce(x, F.lit(False))
    return c.metaresource.select(
        "uri",
        "md5",
        no(ra.resource_filter(format="csv")).alias("is_csv"),
        no(ra.resource_filter(max_size=4000)).alias("small_or_unknown"),
        no(ra.resource_filter(max_size=4000, strict_size=True)).alias("known_small"),
        no(ra.resource_filter(valid=True)).alias("is_valid"),
    )


@query("landing_pages", """
select d.portalid, d.snapshot, d.id, case software when 'CKAN' then concat(apiuri, '/dataset/', d.id) when 'Socrata' then concat(uri, 'dataset/', d.id)
  when 'OpenDataSoft' then concat(uri, 'explore/dataset/', d.id) else d.id end as page
from v_dataset d join v_portal p on p.id = d.portalid""")
def landing_pages(c: Catalogue):
    p = c.portal.select(F.col("id").alias("portalid"), "software", "uri", "apiuri")
    page = ur.landing_page(F.col("software"), F.col("uri"), F.col("apiuri"), F.col("id"))
    return c.dataset.join(p, "portalid").select("portalid", "snapshot", "id", page.alias("page"))


@query("flat_rows", """
select d.id, d.snapshot, d.portalid, d.organisation, d.title, d.md5, c.license, c.modified
from v_dataset d join v_content c on c.md5 = d.md5""")
def flat_rows(c: Catalogue):
    d = c.dataset.select("id", "snapshot", "portalid", "organisation", "title", "md5")
    k = c.content.select("md5", "license", "modified")
    joined = d.alias("d").join(k.alias("k"), F.col("d.md5") == F.col("k.md5"))
    return joined.select(*ra.flat_row(("d", d), ("k", k)))


@query("portal_urls", """
select replace(regexp_extract(url, '://([^/?#]+)', 1), '.', '_') as id, url as uri, url as apiuri, 'CKAN' as software, true as active
from (select distinct concat('http://', regexp_extract(url, '://([^/?#]+)', 1)) as url from pages) x""")
def portal_urls(c: Catalogue):
    """A plain list of the pages' servers as portals of one software."""
    from catascope.session import scratch
    from catascope.sources.portals import read_portal_urls

    path = scratch(c.spark, "urls")
    server = F.regexp_extract("url", "://([^/?#]+)", 1)
    c.table("pages").select(F.concat(F.lit("http://"), server).alias("url")).write.csv(path)
    return read_portal_urls(c.spark, path, "CKAN").select("id", "uri", "apiuri", "software", "active")


@query("portal_registry", """
select n_name as id_given, replace(concat(lower(n_name), '.example.org'), '.', '_') as id, uri, apiuri, software, iso, true as active
from v_portal join nation on n_name = id""")
def portal_registry(c: Catalogue):
    from catascope.sources.portals import portal_rows

    rows = c.portal.select(
        F.col("uri").alias("url"), F.col("apiuri").alias("api"), "software", F.col("iso").alias("country")
    )
    out = portal_rows(rows)
    given = F.upper(F.substring_index(F.regexp_extract("uri", "://([^/]+)", 1), ".", 1))
    return out.withColumn("id_given", given)
