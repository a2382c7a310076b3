"""Zero-filling against the occasions that were sampled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions.nulls import sum_na, sum_rm
from ..functions.scalars import detected
from .joins import event_species_grid, null_safe_join
from .summaries import stops_per_route_year

#: Fixed value: the six keys on which single observations meet their sampling occasion.
OCCASION = (S.STOP, S.YEAR, S.MONTH, S.DAY, S.LAT, S.LON)


def events_frame(df: DataFrame, cols: Sequence[str] = OCCASION) -> DataFrame:
    """Distinct sampling occasions."""
    return df.select(*cols).distinct()


def _fill(events: DataFrame, obs: DataFrame, species: DataFrame | Sequence[str], keys: Sequence[str],
          species_col: str, values: Sequence[str]) -> DataFrame:
    """Records of the listed species at their events, and zeros for every other event and species.

    The same rows as a left join of the whole grid to the records, but the records are joined as the outer
    side, where Spark can split a key that holds very many of them, and the grid only meets distinct keys.
    """
    keys = list(keys)
    records = obs.select(*keys, species_col, *values)
    if isinstance(species, DataFrame):
        found = null_safe_join(records, species, [species_col], "inner")
        extra = [c for c in species.columns if c != species_col]
    else:
        found, extra = records.where(F.col(species_col).isin(list(species))), []
    found = null_safe_join(found, events, keys, "inner")
    grid = event_species_grid(events, species, species_col)
    missing = null_safe_join(grid, records.select(*keys, species_col).distinct(), [*keys, species_col], "left_anti")
    out = [*events.columns, species_col, *extra, *values]
    types = {v: obs.schema[v].dataType for v in values}
    zeros = {v: F.lit(False) if t.typeName() == "boolean" else F.lit(0).cast(t) for v, t in types.items()}
    known = {v: F.coalesce(F.col(v), zeros[v]) for v in values}
    return found.withColumns(known).select(*out).unionByName(missing.withColumns(zeros).select(*out))


def zero_fill(
    df: DataFrame,
    by: str = S.EVENT,
    species: str = S.SPECIES_ID,
    event_cols: Sequence[str] = (S.LAT, S.LON),
    species_cols: Sequence[str] = ("english_name",),
    fill: str = S.COUNT,
    complete: str | None = None,
) -> DataFrame:
    """Every event with every species; ``fill`` is 0 (or false) where the species was not recorded.

    ``event_cols`` are kept per event and ``species_cols`` per species. With ``complete`` only events whose
    flag in that column is ``Yes`` are filled, because an incomplete list says nothing about the others.
    """
    if complete is not None:
        df = df.where(F.col(complete) == "Yes")

    def first_of(rows: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
        # distinct first: it hashes and combines before the shuffle, a minimum over structs has to sort
        kinds = rows.select(key, *cols).distinct()
        if not cols:
            return kinds
        return kinds.groupBy(key).agg(F.min(F.struct(*cols)).alias("__c")).select(key, "__c.*")

    listed = first_of(df.where(F.col(species).isNotNull()), species, species_cols)
    return _fill(first_of(df, by, event_cols), df, listed, [by], species, [fill])


def zero_fill_species(events: DataFrame, obs: DataFrame, species: int | str, keys: Sequence[str] = OCCASION,
                      species_col: str = S.SPECIES_ID, count: str = S.COUNT) -> DataFrame:
    """One species over all events; an event with several records keeps them all."""
    one = obs.where(F.col(species_col) == F.lit(species).cast(obs.schema[species_col].dataType))
    one = one.withColumn(species_col, F.lit(str(species)))
    return _fill(events.select(*keys), one, [str(species)], keys, species_col, [count]).drop(species_col)


def zero_fill_all(events: DataFrame, obs: DataFrame, species: DataFrame | Sequence[str],
                  keys: Sequence[str] = OCCASION, species_col: str = S.SPECIES, count: str = S.COUNT) -> DataFrame:
    """All species over all events; the species is known on the filled rows too."""
    return _fill(events.select(*keys), obs, species, keys, species_col, [count])


def zero_fill_bins(events: DataFrame, obs: DataFrame, species: DataFrame | Sequence[str], keys: Sequence[str],
                   bins: Sequence[str] = ("Obs1", "Obs2", "Obs3", "Obs4"), species_col: str = S.SPECIES) -> DataFrame:
    """The four interval bins of every species over all events."""
    return _fill(events, obs, species, keys, species_col, bins)


@dataclass(frozen=True)
class VisitTotals:
    """What zero-filled route totals are made of."""

    #: Route visits, one row each.
    visits: DataFrame
    #: Stops per route and year.
    effort: DataFrame
    #: ``RouteTotal`` per route visit and detected species.
    totals: DataFrame


def visit_totals(
    obs: DataFrame,
    group: Sequence[str] = (S.ROUTE, S.YEAR, S.PROTOCOL, "doy", S.COLLECTOR),
    occasion: Sequence[str] = (S.ROUTE, S.STOP, S.YEAR, "doy"),
    species_col: str = S.SPECIES,
    count: str = S.COUNT,
    one_row_per_occasion: bool = False,
) -> VisitTotals:
    """Route visits and the totals of the species found on them.

    A stop-day that appears in the events under two protocols or collectors counts under both;
    ``one_row_per_occasion=True`` assigns it to the first of them only.

    Each part reads only its own columns of the records and is reduced before it is shuffled. That moves less
    data than one wide aggregation for all parts, which would have about as many rows as the records.
    """
    occasion, group = list(occasion), list(group)
    event = list(dict.fromkeys([*occasion, *group]))
    events = obs.select(*event).distinct()
    visits = obs.select(*group).distinct()
    if one_row_per_occasion:
        extra = [c for c in event if c not in occasion]
        events = events.groupBy(*occasion).agg(F.min(F.struct(*extra)).alias("__x")).select(*occasion, "__x.*")
        visits = events.select(*group).distinct()
    found = obs.where(F.col(species_col).isNotNull()).groupBy(*occasion, species_col).agg(
        sum_rm(count).alias("__t")
    )
    totals = null_safe_join(events, found, occasion, "inner").groupBy(*group, species_col).agg(
        F.sum("__t").alias("RouteTotal")
    )
    return VisitTotals(visits, stops_per_route_year(obs).withColumnRenamed("nstops", "nstop"), totals)


def route_totals_filled(
    obs: DataFrame,
    species: DataFrame | Sequence[str],
    covariate: DataFrame | None = None,
    group: Sequence[str] = (S.ROUTE, S.YEAR, S.PROTOCOL, "doy", S.COLLECTOR),
    species_col: str = S.SPECIES,
    count: str = S.COUNT,
    one_row_per_occasion: bool = False,
) -> DataFrame:
    """Zero-filled totals per species and route visit, with effort, covariate and detection flag.

    Filling stop by stop and then adding up gives the same totals as adding up the detections and filling
    route visit by route visit. The latter is done here: the grid of zeros has one row per species and route
    visit instead of one per species and stop-day.
    """
    parts = visit_totals(obs, group, species_col=species_col, count=count, one_row_per_occasion=one_row_per_occasion)
    visits = null_safe_join(parts.visits, parts.effort, [S.ROUTE, S.YEAR])
    if covariate is not None:
        visits = null_safe_join(visits, covariate, [S.YEAR])
    out = null_safe_join(event_species_grid(visits, species, species_col), parts.totals, [*group, species_col])
    return out.withColumn("RouteTotal", F.coalesce(F.col("RouteTotal"), F.lit(0))).withColumn(
        "RouteTotal_nb", detected("RouteTotal")
    )


def fill_by_period(df: DataFrame, counts: Sequence[str] = ("count_1", "count_2", "count_3", "count_4"),
                   survey: str = "survey", period: str = "period") -> DataFrame:
    """Missing interval counts to 0 where the protocol covered the interval.

    Surveyed points: intervals 1 and 2 always, 3 and 4 in the morning only. Points that were not surveyed
    stay as they are, and surveyed points without a period drop out.
    """
    done = F.col(survey) == "y"
    morning = done & (F.col(period) == "am")
    rows = df.where((F.col(survey) == "n") | (done & F.col(period).isin("am", "pm")))
    fills = {}
    for k, c in enumerate(counts):
        covered = done if k < 2 else morning
        fills[c] = F.when(covered, F.coalesce(F.col(c), F.lit(0))).otherwise(F.col(c))
    return rows.withColumns(fills)


def presence_absence(counts: DataFrame, points: DataFrame, visits: DataFrame, species: str | None = None,
                     species_col: str = "spcd", key: str = "pointID",
                     names: Mapping[str, str] | None = None) -> DataFrame:
    """Detections per species and point, and zeros for the surveyed points without the species.

    All species at once, or one. The zeros cover four intervals in the morning; in the evening, and where the
    period is unknown, they cover two and leave the other two null. ``visits`` gives the periods in which each
    point was visited; a point visited in two periods has two rows of zeros.
    """
    names = names or {"count_1": "t1", "count_2": "t2", "count_3": "t3", "count_4": "t4"}
    sp = F.col(species_col)
    found = counts.where(sp.isNotNull() if species is None else sp == species)
    present = found.groupBy(key, species_col).agg(*[sum_na(c).cast("int").alias(t) for c, t in names.items()])
    surveyed_points = points.where(F.col("survey") == "y").select(key)
    frame = null_safe_join(surveyed_points, visits.select(key, "period"), [key], "full")
    listed = found.select(species_col).distinct() if species is None else [species]
    grid = event_species_grid(frame, listed, species_col)
    absent = null_safe_join(grid, present.select(key, species_col), [key, species_col], "left_anti")
    zero, late = F.lit(0), F.when(F.col("period") == "am", F.lit(0))
    zeros = absent.select(
        key, species_col,
        *[c.cast("int").alias(t) for c, t in zip([zero, zero, late, late], names.values(), strict=True)],
    )
    return present.unionByName(zeros)
