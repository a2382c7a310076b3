"""Review tables of one survey area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .. import schema as S
from ..operators.clean import species_list
from ..operators.reshape import wide_by_year
from ..operators.summaries import prop_stops_detected, routes_per_year, stops_per_route_year, stops_per_year


def quality_tables(df: DataFrame, years: Sequence[int]) -> dict[str, DataFrame]:
    """The review tables, for all data or for any subset of them."""
    return {
        "species": species_list(df),
        "routes_per_year": routes_per_year(df),
        "stops_per_year": stops_per_year(df),
        "stops_per_route_year": wide_by_year(stops_per_route_year(df), [S.ROUTE], "nstops", years),
        "prop_stops_detected": wide_by_year(prop_stops_detected(df), [S.SPECIES], "prop_stop_detected", years),
    }
