"""The model feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation

from hourgrid.functions.time import add_calendar, add_cyclic
from hourgrid.operators.history import add_history
from hourgrid.operators.joins import add_weather, require_weather
from hourgrid.operators.quality import DataQualityError
from hourgrid.schemas import HISTORY_FEATURES


def add_calendar_features(df: DataFrame) -> DataFrame:
    return add_cyclic(add_cyclic(add_calendar(df), "hour", 24), "day_of_week", 7)


def build_features(pickups: DataFrame, weather: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Weather, calendar and history of every station-hour with enough history; 25 columns.

    History comes first, on the four narrow columns, so the window shuffle carries no weather; rows
    without a full history are gone before the join. Their hours must have weather all the same: that is checked
    beforehand, or counted by the job that reads the features if ``seen`` is given, for ``require_weather_seen`` afterwards.
    """
    history = add_history(pickups, "station_id", "pickups")
    complete = list(HISTORY_FEATURES)
    if seen is not None:
        return add_calendar_features(add_weather(history, weather, seen=seen).na.drop(subset=complete))
    require_weather(pickups, weather)
    return add_calendar_features(add_weather(history.na.drop(subset=complete), weather))


def require_weather_seen(seen: Observation) -> None:
    """Raise if the job that ``seen`` observed met facts without weather."""
    counted = seen.get
    if counted["without_weather"]:
        raise DataQualityError(f"{counted['without_weather']:,} of {counted['rows']:,} station-hours lack weather")
