"""The catalogue's tables derived from general test tables.

Each text runs on Spark and on the checking engine alike; only the name of the ISO year
differs ({ISOY}). Every view reads its whole input. Keys are derived so that the number of
contents, resources and lookups grows with the tables: a content has three resources, a page
belongs to a handful of contents.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["v_portal"] = """
select n_name as id, concat('http://', lower(n_name), '.example.org/') as uri,
  concat('http://', lower(n_name), '.example.org/api') as apiuri,
  case n_nationkey % 5 when 0 then 'CKAN' when 1 then 'Socrata' when 2 then 'OpenDataSoft' when 3 then 'XMLDCAT' else 'DataGouvFr' end as software,
  substr(r_name, 1, 2) as iso, (n_nationkey % 7 <> 0) as active, n_nationkey
from nation join region on n_regionkey = r_regionkey"""

VIEWS["v_event_sn"] = """
select e.*, cast((extract({ISOY} from ts) % 100) * 100 + extract(week from ts) as int) as snapshot
from events e"""

VIEWS["v_dataset"] = """
select concat(cast(user_id as varchar(20)), '-', event_type) as id, snapshot, n_name as portalid,
  case when user_id % 11 = 0 then null else concat(c_mktsegment, '-', cast(cast(floor(user_id / 20) as bigint) as varchar(20))) end as organisation,
  case when user_id % 13 = 0 then null else c_name end as title,
  md5(concat(cast(cast(floor(user_id / 2) as bigint) as varchar(20)), '-', cast(cast(floor(max(value) / 50) as bigint) as varchar(20)))) as md5,
  cast(floor(user_id / 2) * 997 + floor(max(value) / 50) as bigint) as content_no
from v_event_sn join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey
group by user_id, event_type, snapshot, n_name, c_mktsegment, c_name"""

VIEWS["v_content"] = """
select md5, content_no,
  case content_no % 7 when 0 then 'CC-BY-4.0' when 1 then 'CC0-1.0' when 2 then 'ODbL-1.0' when 3 then 'other-closed' when 4 then 'OGL-UK-3.0' else null end as license,
  case when content_no % 3 = 0 then null else concat('record-', cast(content_no as varchar(20))) end as name,
  cast(date '1976-01-01' + cast(content_no % 18000 as int) as timestamp) as modified,
  cast(date '1975-01-01' + cast(content_no % 18000 as int) as timestamp) as created,
  case when content_no % 5 = 0 then null else concat('contact', cast(content_no % 23 as varchar(20)), '@example.org') end as contact_to
from (select distinct md5, content_no from v_dataset) c"""

VIEWS["v_metaresource"] = """
select url as uri, md5, (url like 'https://%') as valid,
  case page_id % 6 when 0 then 'csv' when 1 then 'json' when 2 then 'pdf' when 3 then 'xlsx' when 4 then 'html' else null end as format,
  case page_id % 6 when 0 then 'text/csv' when 1 then 'application/json' when 2 then 'application/pdf' else null end as media,
  case when page_id % 5 = 0 then null else cast(length(html) as bigint) end as size,
  cast(date '2023-12-01' + cast(page_id % 60 as int) as timestamp) as modified
from (select distinct md5, pid from (
  select md5, content_no % (select count(*) from pages) as pid from v_content
  union all select md5, (content_no * 7 + 3) % (select count(*) from pages) from v_content
  union all select md5, (content_no * 13 + 5) % (select count(*) from pages) from v_content) k) d
join pages on page_id = pid"""

VIEWS["v_datasetquality"] = """
select md5,
  case content_no % 5 when 0 then null when 1 then true else false end as cocu,
  case content_no % 7 when 0 then null when 1 then true when 2 then true else false end as coce,
  case content_no % 6 when 0 then null else cast(content_no % 4 as double) / 4 end as coda,
  case content_no % 9 when 0 then null else cast(content_no % 3 as double) / 2 end as cofo,
  case content_no % 8 when 0 then null when 1 then false else true end as coli,
  content_no % 10 > 1 as coac,
  cast(content_no % 5 as double) / 4 as exda,
  cast(content_no % 2 as double) as exri,
  cast(content_no % 9 as double) / 8 as expr,
  content_no % 12 > 0 as exac,
  cast(content_no % 17 as double) / 16 as exdi,
  cast(0 as double) as exte,
  cast(content_no % 3 as double) / 2 as exsp,
  content_no % 4 > 0 as exco,
  case content_no % 9 when 0 then null else cast(content_no % 3 as double) / 2 end as opfo,
  case content_no % 9 when 0 then null else cast(content_no % 5 as double) / 4 end as opma,
  case content_no % 8 when 0 then null when 1 then false when 2 then false else true end as opli
from v_content"""

VIEWS["v_crawllog"] = """
select url as uri, snapshot, ts as timestamp,
  case event_type when 'view' then 200 when 'click' then 200 when 'signup' then 301 when 'error' then 404 else 602 end as status,
  case event_type when 'view' then md5(cast(cast(floor(value / 50) as bigint) as varchar(20))) when 'click' then md5(cast(cast(floor(value / 50) as bigint) as varchar(20))) else null end as digest,
  regexp_extract(url, '://([^/?#]+)', 1) as domain,
  concat(regexp_extract(url, '://([^/?#]+)', 1), '/', cast(event_id as varchar(20))) as disklocation,
  event_id, event_type
from (select e.*, event_id % (select count(*) from pages) as pid from v_event_sn e) k join pages on page_id = pid"""

# Views of an event are downloads only; every other kind is a header lookup.
VIEWS["v_resourceinfo"] = """
select uri, snapshot, timestamp, status,
  case status when 404 then 'HTTPError' when 602 then 'IgnoreRequest' else null end as exc
from (
  select uri, snapshot, max(timestamp) as timestamp, max_by(status, event_id) as status
  from v_crawllog where event_type <> 'view' group by uri, snapshot) r"""

VIEWS["v_portalsnapshot"] = """
select d.portalid, d.snapshot, d.datasetcount, coalesce(r.resourcecount, 0) as resourcecount,
  case when (d.snapshot + length(d.portalid)) % 9 = 0 then 702 else 200 end as status, t.start_ts,
  case when (d.snapshot + length(d.portalid)) % 9 = 0 then null else t.end_ts end as end_ts
from (select portalid, snapshot, count(*) as datasetcount from v_dataset group by portalid, snapshot) d
left join (
  select portalid, snapshot, cast(sum(w * n) as bigint) as resourcecount
  from (select portalid, snapshot, md5, count(*) as w from v_dataset group by portalid, snapshot, md5) a
  join (select md5, count(*) as n from v_metaresource group by md5) b on a.md5 = b.md5
  group by portalid, snapshot) r on r.portalid = d.portalid and r.snapshot = d.snapshot
join (
  select n_name as portalid, snapshot, min(ts) as start_ts, max(ts) as end_ts
  from v_event_sn join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey
  group by n_name, snapshot) t on t.portalid = d.portalid and t.snapshot = d.snapshot"""

VIEWS["v_history"] = """
select uri, 'content' as md5, source, snapshot, max(modified) as modified from (
  select concat('supplier/', cast(l_suppkey as varchar(20))) as uri,
    case l_returnflag when 'R' then 'header' else 'metadata' end as source,
    cast((extract({ISOY} from l_shipdate + interval 20 years) % 100) * 100 + extract(week from l_shipdate + interval 20 years) as int) as snapshot,
    cast(case l_linestatus when 'F' then l_shipdate + interval 20 years else date_trunc('month', l_shipdate + interval 20 years) end as date) as modified
  from lineitem
  union all select concat('yearly/', cast(l_suppkey as varchar(20))), 'metadata',
    cast((extract({ISOY} from l_shipdate + interval 20 years) % 100) * 100 + 1 as int), cast(date_trunc('year', l_shipdate + interval 20 years) as date)
  from lineitem) h
group by uri, source, snapshot"""

VIEWS["v_doc"] = """
select doc_id, concat('doc-', cast(doc_id as varchar(20))) as id, p.id as portalid, software, uri as portal_uri, apiuri, iso,
  trim(split_part(text, chr(10), 1)) as title, text as notes, lang, source,
  case source when 'src0' then 'cc-by' when 'src1' then 'other-closed' when 'src2' then 'cc-nc' when 'src3' then null when 'src4' then 'own-license' when 'src5' then null when 'src6' then null else 'cc-zero' end as license_id,
  case source when 'src3' then 'Creative Commons Attribution' when 'src5' then 'Some other terms' else null end as license_title,
  case source when 'src6' then 'https://opendatacommons.org/licenses/by' else null end as license_url,
  case when source in ('src7', 'src8') then null else source end as contact_name,
  case when source in ('src7', 'src8') then null when lang = 'en' then concat(source, '@en.example.org') when lang = 'de' then 'http://example.org/contact' else 'none' end as contact_email,
  case when source in ('src8', 'src9') then null else concat('Organisation ', source) end as org_title,
  case lang when 'fr' then 'unknown' else cast(date '2015-01-01' + cast(doc_id % 3000 as int) as varchar(20)) end as created,
  case when source in ('src3', 'src10') then null else cast(date '2016-01-01' + cast(doc_id % 3000 as int) as varchar(20)) end as modified,
  case when lang in ('de', 'fr') then lang else null end as spatial_text,
  case when source in ('src1', 'src2') then '2014-01-01' else null end as temporal_start,
  case when source in ('src4', 'src11') then 'weekly' else null end as frequency
from (select d.*, doc_id % (select count(*) from nation) as nk from documents d) k join v_portal p on n_nationkey = nk"""

VIEWS["v_doc_resource"] = """
select doc_id, pos, url, concat('res-', cast(page_id as varchar(20)), '-', cast(pos as varchar(20))) as res_id,
  case page_id % 6 when 0 then 'CSV' when 1 then ' .json' when 2 then 'pdf' when 3 then 'text/html' when 4 then 'shp' else null end as format,
  case page_id % 6 when 0 then 'text/csv' when 2 then 'application/pdf' else null end as mimetype,
  case when page_id % 5 = 0 then null else cast(length(html) as varchar(20)) end as size,
  case when page_id % 4 = 0 then null else concat(cast(date '2020-01-01' + cast(page_id % 900 as int) as varchar(20)), 'T10:30:00') end as last_modified
from (
  select doc_id, 0 as pos, doc_id % (select count(*) from pages) as pid from documents
  union all select doc_id, 1, (doc_id * 7 + 3) % (select count(*) from pages) from documents) k
join pages on page_id = pid"""


def needed(sql: str) -> list[str]:
    """Views a text depends on, those they read first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEWS and name not in out:
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def oracle(sql: str) -> str:
    """A query over the views as one statement for the checking engine."""
    ctes = [f"{n} as ({VIEWS[n].replace('{ISOY}', 'isoyear')})" for n in needed(sql)]
    head, body = "with ", sql.strip()
    if body.lower().startswith("with "):
        body = ", " + body[5:] if ctes else body[5:]
    else:
        body = "\n" + body
    return (head + ",\n".join(ctes) + body) if ctes else sql.strip()


class Catalogue:
    """Lazy access to the tables and views of one folder; each view is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        names = set(re.findall(r"\b[a-z_]+\b", text.lower()))
        args = {t: self.table(t) for t in TABLES if t in names}
        args |= {v: getattr(self, v[2:]) for v in needed(text) if v in names}
        for name in args:
            text = re.sub(rf"(?<![.\w'{{]){name}\b(?!\s*\()", "{" + name + "}", text)
        return self.spark.sql(text, **args)

    def __getattr__(self, name: str) -> DataFrame:
        view = "v_" + name
        if view not in VIEWS:
            raise AttributeError(name)
        if view not in self._made:
            self._made[view] = self.sql(VIEWS[view].replace("{ISOY}", "yearofweek"))
        return self._made[view]
