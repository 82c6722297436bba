"""Change between the snapshots of a portal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catascope.functions.ratios import change_ratios, safe_ratio
from catascope.operators.joins import run_pairs
from catascope.operators.windows import previous_runs


def dataset_changes(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Every dataset of every run as added, updated, static, and as deleted after its last.

    The table is shuffled once by (portalid, id), not once per snapshot: a row knows its
    neighbours in the dataset's own history, and whether those belong to the neighbouring run.
    """
    prev = previous_runs(runs)
    w = W.partitionBy("portalid").orderBy("snapshot")
    weeks = prev.withColumn("following", F.lead("snapshot").over(w))
    d = W.partitionBy("portalid", "id").orderBy("snapshot")
    rows = (
        datasets.select("portalid", "id", "snapshot", "md5")
        .withColumns(
            {
                "_sn": F.lag("snapshot").over(d),
                "_md5": F.lag("md5").over(d),
                "_next": F.lead("snapshot").over(d),
            }
        )
        .join(weeks, ["portalid", "snapshot"])
    )
    there = F.coalesce(F.col("_sn") == F.col("previous"), F.lit(False))
    here = F.struct(
        F.col("snapshot").alias("sn"),
        F.when(~there, "added").when(~F.col("_md5").eqNullSafe(F.col("md5")), "updated").otherwise("static").alias("change"),
        F.col("md5").alias("md5"),
        F.when(there, F.col("_md5")).alias("md5_previous"),
    )
    gone = F.col("following").isNotNull() & ~F.col("_next").eqNullSafe(F.col("following"))
    after = F.struct(
        F.col("following").alias("sn"), F.lit("deleted").alias("change"),
        F.lit(None).cast("string").alias("md5"), F.col("md5").alias("md5_previous"),
    )
    both = F.when(gone, F.array(here, after)).otherwise(F.array(here))
    return rows.select("portalid", "id", F.inline(both)).withColumnRenamed("sn", "snapshot")


def change_list(changes: DataFrame, content: DataFrame) -> DataFrame:
    """Added, updated and deleted datasets with the name from the document that tells it."""
    rows = changes.where(F.col("change") != "static").withColumn(
        "md5", F.when(F.col("change") == "added", F.col("md5")).otherwise(F.col("md5_previous"))
    )
    names = content.select("md5", "name")
    return rows.join(names, "md5", "left").select(
        "portalid", "snapshot", "id", "change", F.coalesce("name", "id").alias("name")
    )


def change_counts(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts per portal and snapshot; a run without datasets counts its deletions only."""
    kind = F.col("change")
    counted = changes.groupBy("portalid", "snapshot").agg(
        *[F.count_if(kind == k).cast("int").alias(k) for k in ("added", "deleted", "updated", "static")]
    )
    rows = runs.select("portalid", "snapshot").distinct().join(counted, ["portalid", "snapshot"], "left")
    rows = rows.fillna(0, ["added", "deleted", "updated", "static"])
    size = F.col("added") + F.col("updated") + F.col("static")
    return rows.withColumns(
        {
            "size": size,
            "union_size": size + F.col("deleted"),
            "intersected": size + F.col("deleted"),
        }
    )


def change_frequency(counts: DataFrame) -> DataFrame:
    """Share of the runs so far in which anything changed."""
    changed = ((F.col("added") + F.col("deleted") + F.col("updated")) > 0).cast("int")
    return counts.withColumn("changefrequ", F.avg(changed).over(_so_far()))


def _so_far():
    return W.partitionBy("portalid").orderBy("snapshot").rowsBetween(W.unboundedPreceding, 0)


def index_of(ratios: Column) -> Column:
    """h-index of ratios: the first, in descending order, whose percentage is not above its
    own rank in percent."""
    ordered = F.sort_array(ratios, asc=False)
    n = F.size(ratios)
    bins = F.transform(
        ordered,
        lambda e, i: F.struct(
            F.floor(e * 100).cast("int").alias("bin"), (100 * ((i + 1) / n)).alias("rank")
        ),
    )
    hit = F.filter(bins, lambda b: b["rank"] >= b["bin"])
    return F.coalesce(F.get(hit, F.lit(0))["bin"], F.lit(0))


def dynamicity_index(counts: DataFrame) -> DataFrame:
    """The index over the ratios of all runs so far (at most one run per week)."""
    ratio = safe_ratio(F.col("added") + F.col("deleted") + F.col("updated"), F.col("union_size"))
    rows = counts.withColumn("_ratios", F.collect_list(ratio).over(_so_far()))
    return rows.withColumn("dindex", index_of(F.col("_ratios"))).drop("_ratios")


def dynamicity(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Change row of every portal and snapshot."""
    counts = change_counts(dataset_changes(datasets, runs), runs)
    return dynamicity_index(change_frequency(counts))


def with_ratios(dynamics: DataFrame) -> DataFrame:
    return dynamics.withColumns(
        change_ratios(*[F.col(c) for c in ("added", "deleted", "updated", "static", "intersected")])
    )


def _system_change(rows: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(c + "_previous"))
    kind = (
        F.when(differs("status"), "status")
        .when(differs("datasetcount"), "datasets")
        .when(differs("resourcecount"), "resources")
    )
    def pick(suffix: str) -> Column:
        return (
            F.when(F.col("kind") == "status", F.col("status" + suffix).cast("bigint"))
            .when(F.col("kind") == "datasets", zero("datasetcount" + suffix))
            .otherwise(zero("resourcecount" + suffix))
        )

    rows = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    rows = rows.withColumns({"value_from": pick("_previous"), "value_to": pick("")})
    return rows.withColumn(
        "difference", F.when(F.col("kind") != "status", F.col("value_to") - F.col("value_from"))
    )


def system_changes(runs: DataFrame, current: int, previous: int) -> DataFrame:
    """What changed from one week to the other, the most telling difference per portal."""
    return _system_change(run_pairs(runs, current, previous)).select(
        "portalid", "kind", "value_from", "value_to", "difference"
    )


def system_change_series(runs: DataFrame) -> DataFrame:
    """The same for every run and the run before it."""
    w = W.partitionBy("portalid").orderBy("snapshot")
    cols = ["status", "datasetcount", "resourcecount"]
    rows = runs.withColumns({c + "_previous": F.lag(c).over(w) for c in cols} | {"previous": F.lag("snapshot").over(w)})
    return _system_change(rows.where(F.col("previous").isNotNull())).select(
        "portalid", "snapshot", "previous", "kind", "value_from", "value_to", "difference"
    )
