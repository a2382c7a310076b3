"""Yearly totals of some species and how two of them go together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..operators.summaries import correlation_test, focal_totals, lagged_correlation, ols_line
from ..operators.trend import with_t_pvalue


def species_correlation(obs: DataFrame, species: Mapping[str, str], x: str, y: str) -> dict[str, DataFrame]:
    """Totals, correlation in the same year and with the year before, and the line through the totals."""
    totals = focal_totals(obs, species)
    return {
        "totals": totals,
        "same_year": with_t_pvalue(correlation_test(totals, x, y)),
        "lagged": with_t_pvalue(lagged_correlation(totals, x, y)),
        "line": ols_line(totals, [], y, x),
    }
