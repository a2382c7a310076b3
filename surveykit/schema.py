"""Column names, explicit schemas and name normalisation for survey tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

EVENT = "SamplingEventIdentifier"
ROUTE = "RouteIdentifier"
STOP = "SurveyAreaIdentifier"
PROTOCOL = "ProtocolCode"
COLLECTOR = "CollectorNumber"
SPECIES = "CommonName"
SPECIES_ID = "species_id"
SUBREGION = "subnational2_code"
YEAR = "survey_year"
MONTH = "survey_month"
DAY = "survey_day"
COUNT = "ObservationCount"
START = "TimeObservationsStarted"
LAT = "latitude"
LON = "longitude"

#: The second naming scheme of a download, mapped to the first.
ALTERNATE_NAMES = {
    "DecimalLatitude": LAT,
    "DecimalLongitude": LON,
    "YearCollected": YEAR,
    "MonthCollected": MONTH,
    "DayCollected": DAY,
    "SpeciesCode": SPECIES_ID,
}


def _schema(spec: str) -> T.StructType:
    types = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType()}
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, types[code], True) for name, code in fields])


#: Counts stay text here because the download holds text; see ``functions.nulls.to_int``.
OBSERVATION = _schema(
    f"{EVENT}:s {ROUTE}:s {STOP}:s {PROTOCOL}:s {SPECIES_ID}:i {SPECIES}:s {SUBREGION}:s "
    f"{YEAR}:i {MONTH}:i {DAY}:i {START}:d TimeObservationsEnded:d {COUNT}:s "
    + " ".join(f"ObservationCount{k}:i" for k in range(2, 10))
    + f" Collector:s {COLLECTOR}:s {LAT}:d {LON}:d AllSpeciesReported:s"
)
SPECIES_DIM = _schema("species_id:i english_name:s")
STOPS = _schema("pointID:s lat:d long:d survey:s")
STATIONS = _schema("pointID:s obs:s prov:s year:i month:i day:i start_hour:i start_min:i period:s")
INTERVAL_COUNTS = _schema(
    "pointID:s day:i month:i year:i interval:i period:s spcd:s min_d:d max_d:d count:i"
)
VISITS = _schema("site_id:s point_id:s year:i sample:i taxa_code:s")
REPLICATES = _schema("site:i year_idx:i r1:d r2:d r3:d r4:d")


def normalise_names(df: DataFrame) -> DataFrame:
    """Bring the alternate column names to the standard ones; columns already standard win."""
    present = set(df.columns)
    twice = [old for old, new in ALTERNATE_NAMES.items() if old in present and new in present]
    return df.drop(*twice).withColumnsRenamed(ALTERNATE_NAMES)
