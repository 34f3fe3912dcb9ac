"""Trips to the dense hourly table of the busiest stations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from hourgrid.functions.time import naive
from hourgrid.operators.counts import hourly_counts, sum_by
from hourgrid.operators.grid import dense_grid
from hourgrid.operators.joins import keep_listed, lookup
from hourgrid.operators.ranking import canonical_label, require_selection, top_entities
from hourgrid.schemas import HOURLY_PICKUPS
from hourgrid.session import materialize
from hourgrid.sources.tables import write_monthly


def named_hourly(trips: DataFrame) -> DataFrame:
    """Counts per hour, station id and name. The trips are read once; everything below reads this."""
    counted = hourly_counts(trips).withColumnsRenamed(
        {"start_station_id": "station_id", "start_station_name": "station_name"}
    )
    return materialize(counted, "hourly")


def station_names(hourly: DataFrame) -> DataFrame:
    """The name with the most pickups over all months; it is a label and not a feature."""
    by_name = sum_by(hourly, ["station_id", "station_name"])
    return canonical_label(by_name, "station_id", "station_name", "pickups")


def select_stations(hourly: DataFrame, cutoff: date, top_n: int) -> DataFrame:
    """The busiest stations before the cutoff, written once because several steps read them."""
    selected = materialize(top_entities(hourly, "station_id", "pickups", top_n, cutoff=naive(cutoff)), "stations")
    require_selection(selected, top_n)
    return selected


def build_dataset(trips: DataFrame, cutoff: date, top_n: int = 25) -> DataFrame:
    """``timestamp, station_id, station_name, pickups`` for every selected station and hour."""
    hourly = named_hourly(trips)
    stations = select_stations(hourly, cutoff, top_n)
    chosen = keep_listed(hourly, stations, "station_id")
    grid = dense_grid(chosen, stations, "station_id", "pickups")
    return lookup(grid, station_names(chosen), "station_id").select(*HOURLY_PICKUPS.names)


def ingest_trips(trips: DataFrame, path: str) -> None:
    """Convert landed trips to Parquet once, partitioned by month, so later runs split and prune them.

    Rows go to their month's partition straight from the reading task; no shuffle gathers a month.
    """
    write_monthly(trips, path, "started_at", rebalance=False)
