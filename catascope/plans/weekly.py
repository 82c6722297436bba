"""The weekly job: records of all portals to content, quality, resources, runs and change.

Tables live below one folder as Parquet. Content is keyed by hash and partitioned by the
snapshot it was first seen in, so mapping and scoring touch new content only. Datasets, runs and
aggregates are partitioned by snapshot. A repeated week replaces its own tables as a whole and in one
step; content that later weeks refer to stays. Of earlier weeks only the week's contents are read.
Summaries of histories go on from the week before: after an older week has been repeated, the weeks
that follow it are repeated too.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catascope.functions.ratios import content_hash, safe_ratio
from catascope.functions.status import harvest_status
from catascope.operators import access as ac
from catascope.operators import dynamics as dy
from catascope.operators import freshness as fr
from catascope.operators import mapping as ma
from catascope.operators import quality as qu
from catascope.operators import stats as sa
from catascope.sources import folders, tables


@dataclass
class Warehouse:
    """Tables of weeks below a folder. Every write of a week goes to a folder of its own, and one small
    file says which folders count: `commit` replaces it last, so readers see a week's tables all as
    they were or all as they are. A job that ends before leaves the old weeks; what it wrote is
    removed when its week is committed the next time. One job writes at a time.
    """

    spark: SparkSession
    path: str
    pending: dict[str, dict[str, str]] = field(default_factory=dict)

    def _weeks(self) -> dict[str, dict[str, str]]:
        return json.loads(folders.get(self.spark, f"{self.path}/_weeks.json") or "{}")

    def _place(self, name: str, week: str, version: str) -> str:
        return f"{self.path}/{name}/snapshot={week}/version={version}"

    def read(self, name: str) -> DataFrame | None:
        """All weeks of a table, those written since the last commit included."""
        weeks = self._weeks().get(name, {}) | self.pending.get(name, {})
        if not weeks:
            return None
        places = [self._place(name, *w) for w in sorted(weeks.items())]
        try:
            return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*places).drop("version")
        except AnalysisException as e:
            if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # empty weeks only
                return None
            raise

    def before(self, name: str, snapshot: int) -> DataFrame | None:
        """Rows of earlier weeks only, so that a repeated week starts from the same state."""
        rows = self.read(name)
        return None if rows is None else rows.where(F.col("snapshot") < snapshot)

    def last(self, name: str, snapshot: int) -> DataFrame | None:
        """The newest week before one."""
        weeks = [int(w) for w in self._weeks().get(name, {}) | self.pending.get(name, {}) if int(w) < snapshot]
        rows = self.read(name)
        return None if rows is None or not weeks else rows.where(F.col("snapshot") == max(weeks)).drop("snapshot")

    def write(self, name: str, rows: DataFrame, snapshot: int, by: tuple[str, ...] = ()) -> DataFrame:
        """Make the rows the whole of a week, which is empty without any; the week as stored."""
        version, rows = "v" + uuid.uuid4().hex, rows.drop("snapshot")
        rows.write.partitionBy(*by).parquet(self._place(name, str(snapshot), version))
        self.pending.setdefault(name, {})[str(snapshot)] = version
        return self.spark.read.schema(rows.schema).parquet(self._place(name, str(snapshot), version)).withColumn("snapshot", F.lit(snapshot))

    def commit(self) -> None:
        """Make everything written since the last commit what readers see, in one step."""
        weeks = self._weeks()
        for name, new in self.pending.items():
            weeks[name] = weeks.get(name, {}) | new
        folders.put(self.spark, f"{self.path}/_weeks.json", json.dumps(weeks))
        for name, new in self.pending.items():
            for week, version in new.items():
                for other in folders.names(self.spark, f"{self.path}/{name}/snapshot={week}"):
                    if other != f"version={version}":
                        folders.remove(self.spark, f"{self.path}/{name}/snapshot={week}/{other}")
        self.pending = {}

    def keep(self, name: str, rows: DataFrame, snapshot: int) -> DataFrame:
        """write() for rows by content: what the week held before and later weeks use is kept."""
        had, used = self.read(name), self.read("datasets")
        if had is not None and used is not None:
            later = used.where(F.col("snapshot") > snapshot).select("md5").distinct()
            had = had.where(F.col("snapshot") == snapshot).join(later, "md5", "left_semi").join(rows.select("md5"), "md5", "left_anti")
            rows = rows.unionByName(had.select(*rows.columns))
        return self.write(name, rows, snapshot)

    def of_content(self, name: str, snapshot: int, week: DataFrame) -> DataFrame:
        """Rows up to a week of the contents that the week's datasets have."""
        used = week.select("md5").distinct()
        return self.read(name).where(F.col("snapshot") <= snapshot).join(used, "md5", "left_semi")


def harvest(wh: Warehouse, records: DataFrame, portals: DataFrame, runs: DataFrame, snapshot: int, lookups: DataFrame | None = None) -> None:
    """Take in one week: records (portalid, id, raw), runs (portalid, start_ts, end_ts, exc), and the
    results of the resource checks (uri, snapshot, header), if there were any."""
    p = portals.select(F.col("id").alias("portalid"), "software", "apiuri")
    rows = records.join(p, "portalid").select(
        "portalid", "id", "software", "apiuri", "raw", F.lit(snapshot).alias("snapshot"), content_hash(F.col("raw")).alias("md5")
    )
    bronze = wh.write("bronze", rows, snapshot, ("software",))

    fresh = tables.new_content(bronze, wh.before("content", snapshot))
    silver = wh.write("silver", ma.to_dcat(fresh.drop("portalid", "id")), snapshot)
    wh.keep("content", _content(silver), snapshot)
    wh.keep("quality", qu.quality(silver, keys=["md5", "snapshot"]), snapshot)
    wh.keep("resources", ac.resources(silver).withColumn("snapshot", F.lit(snapshot)), snapshot)

    content = wh.of_content("content", snapshot, bronze).select("md5", "title", "organisation")
    datasets = bronze.select("id", "snapshot", "portalid", "md5").join(content, "md5", "left")
    week = wh.write("datasets", datasets, snapshot)
    aggregate(wh, week, runs, snapshot)
    resources = wh.of_content("resources", snapshot, week).drop("snapshot")
    placed = portals if "iso" in portals.columns else portals.withColumn("iso", F.lit(None).cast("string"))
    wh.write("format_dist", sa.format_dist_groupings(week, resources, placed, snapshot), snapshot)
    if lookups is None:
        lookups = wh.spark.createDataFrame([], "uri string, snapshot int, header map<string,array<string>>")
    history = wh.write("history", fr.history(week, resources, lookups.where(F.col("snapshot") == snapshot)), snapshot)
    # the week is added to the summary of all weeks before; scores are for the resources that are there now
    summary = wh.write("summary", fr.fold(wh.last("summary", snapshot), history), snapshot)
    now = resources.select("uri", "md5").distinct()
    wh.write("freshness", fr.folded_rows(summary.join(now, ["uri", "md5"], "left_semi"), snapshot), snapshot)
    wh.commit()


def _content(silver: DataFrame) -> DataFrame:
    first = lambda name: F.get(name, F.lit(0)).alias(name)
    return ac.content_rows(silver, extra=[first("title"), first("repository_name"), F.col("snapshot")])


def aggregate(wh: Warehouse, week: DataFrame, runs: DataFrame, snapshot: int) -> None:
    """Run rows, portal quality and change rows of a week of datasets."""
    of_week = lambda name: wh.of_content(name, snapshot, week).drop("snapshot")
    closed = sa.close_runs(
        runs.withColumns({"snapshot": F.lit(snapshot), "status": harvest_status(F.col("exc"))}), week, of_week("resources")
    )
    wh.write("runs", closed, snapshot)
    wh.write("portal_quality", qu.portal_quality(week, of_week("quality")), snapshot)
    wh.write("dynamics", change_of_week(wh, snapshot), snapshot)


def change_of_week(wh: Warehouse, snapshot: int) -> DataFrame:
    """Change of the week against each portal's run before, with the indices over all runs.

    Only the partitions of the runs compared are read.
    """
    runs = wh.read("runs").where(F.col("snapshot") <= snapshot).select("portalid", "snapshot")
    previous = runs.where(F.col("snapshot") < snapshot).groupBy("portalid").agg(F.max("snapshot").alias("snapshot"))
    pair = runs.where(F.col("snapshot") == snapshot).unionByName(previous.select("portalid", "snapshot"))
    datasets = wh.read("datasets").join(pair, ["portalid", "snapshot"], "left_semi")
    counts = dy.change_counts(dy.dataset_changes(datasets, pair), pair).where(F.col("snapshot") == snapshot)
    before = wh.before("dynamics", snapshot)
    cols = ["portalid", "snapshot", "added", "deleted", "updated", "static", "size", "union_size", "intersected"]
    every = counts.select(*cols) if before is None else before.select(*cols).unionByName(counts.select(*cols))
    scored = dy.dynamicity_index(dy.change_frequency(every))
    ratio = safe_ratio(F.col("added") + F.col("deleted") + F.col("updated"), F.col("union_size"))
    return scored.where(F.col("snapshot") == snapshot).withColumn("dyratio", ratio)
