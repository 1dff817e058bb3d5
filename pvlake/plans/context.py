"""A run context: the shared, persisted intermediate tables of one input.

The labelled point table, the neighbour table, the feature table and the
device-day table are each reused by many operators, so they are computed once
and written as parquet into the shared checkpoint folder (short lineage,
nothing recomputed after an executor loss, pruned scans for later stages).
Contexts are memoised per (application, input, settings) so several reports over
the same input share them.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, partial
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake import config as C
from pvlake.config import Settings
from pvlake.operators.daily import make_daily_frame
from pvlake.operators.history import (DEVICE_FILLED, SLOT_FILLED, device_history, device_slot_history, device_values, enrich,
                                      filled, global_slot_history, own_pairs, stacked, weighted_medians)
from pvlake.operators.neighbours import device_locations, neighbour_pairs, summarise, train_device_table
from pvlake.operators.splits import label_once, train_mask, unseen_in
from pvlake.plans.features import label, scalar_features, target_cap, target_features
from pvlake.session import compiled_stages, materialize
from pvlake.sources.fixture import pv_points, supplier_points

T = TypeVar("T")
_CACHE: dict[tuple, "RunContext"] = {}
#: A device's and its slots' own statistics, in the order of the feature table.
OWN_STATS = ("device_daily_mean", "device_daily_median", "device_daily_p90", "device_daily_max", "device_history_days",
             "device_slot_mean", "device_slot_p90")
#: What labels, history, device-days and their summaries read of a point.
DAY_COLUMNS = {"split", "eval_split", "deviceSn", "date", "slot_id", "pvGenTotal", *[src for _, src, _ in C.DAILY_AGGS], *C.OPTIONAL_WEATHER}
SOURCES = {"events": pv_points, "lineitem": supplier_points}


class RunContext:
    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings = Settings(),
                 source: str = "events", points: DataFrame | None = None, days_only: bool = False):
        compiled_stages(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self.settings = settings
        self.source = source
        self._points = points
        self.days_only = days_only

    @classmethod
    def get(cls, spark: SparkSession, sf_dir: str, settings: Settings = Settings(),
            source: str = "events", days_only: bool = False) -> "RunContext":
        """``days_only``: for readers of device-days and history; of a point only what these read is written and moved,
        unless the whole feature table is there already."""
        key = (spark.sparkContext.applicationId, sf_dir, settings, source, days_only)
        whole = _CACHE.get((*key[:-1], False))
        if days_only and whole is not None and "features" in whole.__dict__:
            return whole
        ctx = _CACHE.get(key)
        if ctx is None:
            ctx = _CACHE[key] = cls(spark, sf_dir, settings, source, days_only=days_only)
        return ctx

    def _kept(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[c for c in rows.columns if c in DAY_COLUMNS]) if self.days_only else rows

    @cached_property
    def points(self) -> DataFrame:
        if self._points is not None:
            return self._points
        return SOURCES[self.source](self.spark, self.sf_dir)

    @cached_property
    def labelled(self) -> DataFrame:
        return label(self.points, self.settings)

    @cached_property
    def scalar(self) -> DataFrame:
        """Labels + row-local features: the base every later step reads."""
        return materialize(self._kept(scalar_features(self.labelled, self.settings, self.points)), "points", ["split"])

    @cached_property
    def row_bound(self) -> int:
        """Rows of the point table: an upper bound on any group derived from it."""
        return self.scalar.count()

    @cached_property
    def train_rows(self) -> DataFrame:
        return self.scalar.filter(train_mask())

    @cached_property
    def neighbour_pairs(self) -> DataFrame:
        approx = self.settings.approx_quantiles
        return materialize(neighbour_pairs(train_device_table(self.train_rows, approx), device_locations(self.scalar, approx)),
                           "neighbour_pairs")

    @cached_property
    def neighbours(self) -> DataFrame:
        return materialize(summarise(self.neighbour_pairs), "neighbours")

    @property
    def own_history(self) -> tuple[DataFrame, DataFrame] | None:
        """Device and (device, slot) statistics that exist already."""
        return None

    @cached_property
    def features(self) -> DataFrame:
        s = self.settings
        enriched = enrich(self.scalar, self.train_rows, self.neighbours, s.approx_quantiles, self.row_bound, self.own_history)
        return materialize(self._kept(target_features(enriched, s, self.row_bound, self.scalar)), "features", ["split"])

    @cached_property
    def by_device(self) -> DataFrame:
        s = self.settings
        return materialize(device_values(self.scalar, self.train_rows, self.neighbours, s.approx_quantiles, self.row_bound, self.own_history), "device_values")

    @cached_property
    def days(self) -> DataFrame:
        """Device-days, planned over their written aggregates: for one reader. Where only days are read, history meets
        the days: all points of a device share what days take of it."""
        if self.days_only:
            return make_daily_frame(self.scalar, self.settings.approx_quantiles, self.by_device)
        return make_daily_frame(self.features, self.settings.approx_quantiles)

    @cached_property
    def daily(self) -> DataFrame:
        return materialize(self.days, "daily")

    def tables_for(self, columns: tuple[str, ...] | None) -> tuple[DataFrame, DataFrame]:
        """Feature and device-day table for a reader of ``columns`` (None: of all). Reports share the whole ones here."""
        return self.features, self.daily


class SharedBase:
    """What all labellings of one input have in common, each written once.

    A labelling only moves devices to ``valid_unseen``. Row-local features don't depend on it, and a
    device that stays has the same training rows in every labelling, so its history, location and
    slot statistics are the same too; a labelling just leaves the unseen devices out.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings, source: str):
        compiled_stages(spark)
        self.spark, self.sf_dir, self.settings, self.source = spark, sf_dir, settings, source

    @cached_property
    def points(self) -> DataFrame:
        return SOURCES[self.source](self.spark, self.sf_dir)

    @cached_property
    def table(self) -> DataFrame:
        s = self.settings
        return materialize(scalar_features(label_once(self.points, s.holdout_days), s, self.points), "shared_base", ["split"])

    @cached_property
    def row_bound(self) -> int:
        return self.table.count()

    @cached_property
    def _train(self) -> DataFrame:
        return self.table.filter(train_mask())

    @cached_property
    def devices(self) -> DataFrame:
        return materialize(self.table.groupBy("deviceSn").agg(F.max("_place").alias("_place"), F.max("_low").alias("_low")), "shared_devices")

    @cached_property
    def n_candidates(self) -> int:
        return self.devices.filter(F.col("_place").isNotNull()).count()

    @cached_property
    def device_stats(self) -> DataFrame:
        return materialize(device_history(self._train, self.settings.approx_quantiles), "shared_history")

    @cached_property
    def slot_stats(self) -> DataFrame:
        return materialize(device_slot_history(self._train, self.settings.approx_quantiles, self.row_bound), "shared_slots")

    @cached_property
    def pairs(self) -> DataFrame:
        """(device, slot) pairs of all points with their own statistics and what tells unseen devices."""
        pairs = own_pairs(self.table, self.device_stats, self.slot_stats)
        return materialize(pairs.join(self.devices, "deviceSn", "left"), "shared_pairs")

    @cached_property
    def n_pairs(self) -> int:
        return self.pairs.count()

    @cached_property
    def device_rows(self) -> DataFrame:
        """The pairs' device statistics, one row a device, with its number of points."""
        kept = [F.first(c).alias(c) for c in (*DEVICE_FILLED, "_place", "_low")]
        return materialize(self.pairs.groupBy("deviceSn").agg(F.sum("_rows").alias("_rows"), *kept), "shared_device_rows")

    @cached_property
    def enriched(self) -> DataFrame:
        """The points with their pair's own statistics, joined once for all labellings."""
        pairs = self.pairs.select(F.col("deviceSn").alias("_device"), F.col("slot_id").alias("_slot"), *OWN_STATS)
        table = self.table
        return materialize(table.join(pairs, table["deviceSn"].eqNullSafe(pairs["_device"]) & table["slot_id"].eqNullSafe(pairs["_slot"]),
                                      "left").drop("_device", "_slot"), "shared_enriched", ["split"])

    @cached_property
    def cap(self):
        """The label's cap where it doesn't depend on the labelling: over all rows of the training split."""
        return target_cap(self.table, self.settings, self.row_bound)

    @cached_property
    def train_devices(self) -> DataFrame:
        return materialize(train_device_table(self._train, self.settings.approx_quantiles), "shared_train_devices")

    @cached_property
    def locations(self) -> DataFrame:
        return materialize(device_locations(self.table, self.settings.approx_quantiles), "shared_locations")

    def prepare(self) -> SharedBase:
        """Everything that labellings share, so several of them can run at the same time over it."""
        for some in (("row_bound",), ("slot_stats", "device_stats", "devices", "cap", "train_devices", "locations"), ("pairs",), ("enriched", "device_rows", "n_pairs", "n_candidates")):
            at_once(*[partial(getattr, self, name) for name in some])
        return self


#: Labellings that run at the same time: most of their jobs are too short or too uneven to keep all cores busy.
AT_ONCE = 4


def at_once(*jobs: Callable[[], T]) -> list[T]:
    """The results of independent jobs, some of them running at the same time."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


_BASES: dict[tuple, SharedBase] = {}


class LabelContext(RunContext):
    """One labelling (fold, stress or default) of a ``SharedBase``: labels are a projection of the written base."""

    def __init__(self, base: SharedBase, settings: Settings):
        super().__init__(base.spark, base.sf_dir, settings, base.source)
        self.base = base
        self._narrow: dict[tuple, tuple[DataFrame, DataFrame]] = {}

    @classmethod
    def get(cls, spark: SparkSession, sf_dir: str, settings: Settings = Settings(), source: str = "events") -> "LabelContext":
        shared = Settings(holdout_days=settings.holdout_days, approx_quantiles=settings.approx_quantiles)
        key = (spark.sparkContext.applicationId, sf_dir, shared, source)
        if key not in _BASES:
            _BASES[key] = SharedBase(spark, sf_dir, shared, source)
        mine = (*key, settings)
        if mine not in _CACHE:
            _CACHE[mine] = cls(_BASES[key], settings)
        return _CACHE[mine]

    @cached_property
    def points(self) -> DataFrame:
        return self.base.points

    @cached_property
    def _unseen(self):
        return unseen_in(self.settings, F.lit(self.base.n_candidates))

    @cached_property
    def scalar(self) -> DataFrame:
        moved = (F.col("split") == "train") & self._unseen
        return self.base.table.withColumn("eval_split", F.when(moved, "valid_unseen").otherwise(F.col("eval_split"))).drop("_place", "_low")

    @cached_property
    def labelled(self) -> DataFrame:
        return self.scalar.select(*self.points.columns, "eval_split")

    @cached_property
    def row_bound(self) -> int:
        return self.base.row_bound

    def _of_seen(self, table: DataFrame, key: str = "deviceSn") -> DataFrame:
        gone = self.base.devices.filter(self._unseen).select(F.col("deviceSn").alias(key))
        return table.join(gone, key, "left_anti")

    @cached_property
    def neighbour_pairs(self) -> DataFrame:
        return materialize(neighbour_pairs(self._of_seen(self.base.train_devices, "t_dev"), self.base.locations), "neighbour_pairs")

    @property
    def own_history(self) -> tuple[DataFrame, DataFrame]:
        return self._of_seen(self.base.device_stats), self._of_seen(self.base.slot_stats)

    @cached_property
    def _enriched(self) -> DataFrame:
        """Features of every point (J1, J2, F16, F17) without another join by slot: unseen devices lose their own statistics."""
        s, base = self.settings, self.base
        gone, moved = self._unseen, (F.col("split") == "train") & self._unseen
        own = {c: F.when(~gone, F.col(c)) for c in OWN_STATS}
        rows = base.enriched.withColumns(own | {"eval_split": F.when(moved, "valid_unseen").otherwise(F.col("eval_split"))}).drop("_place", "_low")
        by_global = materialize(global_slot_history(self.train_rows, s.approx_quantiles, self.row_bound), "global_slots")  # <= 96 rows
        rows = rows.join(F.broadcast(by_global), "slot_id", "left").join(self.neighbours, "deviceSn", "left")
        # the weight of a device's value is its number of points, so its pairs count as one
        seen = stacked(base.device_rows.filter(~gone), DEVICE_FILLED).union(stacked(base.pairs.filter(~gone), SLOT_FILLED))
        rows = filled(rows, weighted_medians(seen, base.n_pairs))
        points = [c for c in base.enriched.columns if c not in {*OWN_STATS, "_place", "_low"}]
        history = [*OWN_STATS, *[c for c in by_global.columns if c != "slot_id"], *[c for c in self.neighbours.columns if c != "deviceSn"]]
        return target_features(rows.select(*points, *history), s, self.row_bound, base.table,
                               base.cap if s.cap_rows == "split_train" else target_cap(self.scalar, s, self.row_bound))

    @cached_property
    def features(self) -> DataFrame:
        return materialize(self._enriched, "features", ["split"])

    def tables_for(self, columns: tuple[str, ...] | None) -> tuple[DataFrame, DataFrame]:
        if columns is None or "features" in self.__dict__:
            return self.features, self.daily
        if columns not in self._narrow:
            rows = materialize(self._enriched.select(*[c for c in self._enriched.columns if c in columns]), "narrow_features", ["split"])
            self._narrow[columns] = rows, materialize(make_daily_frame(rows, self.settings.approx_quantiles), "narrow_daily")
        return self._narrow[columns]
