"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from slotwise.schemas import HOUR, TRIP_SCHEMA, ZONE_CSV_SCHEMA


def read_trips(spark: SparkSession, path: str, schema=TRIP_SCHEMA) -> DataFrame:
    """A1: raw trip scan, cast to the contract's types.

    The files' own schema is read (integers, longs and doubles occur for the
    same column), the required names are checked, and each column is cast.
    Catalyst prunes unused columns and pushes the cleaning predicates.
    """
    raw = spark.read.parquet(path)
    by_name = {c.lower(): c for c in raw.columns}
    missing = [f.name for f in schema.fields if f.name.lower() not in by_name]
    if missing:
        raise ValueError(f"{path} lacks trip columns {missing}")
    return raw.select(*[F.col(f"`{by_name[f.name.lower()]}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """A2: feature table scan; a missing path is reported with a hint."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"{path} not found: build the feature table first") from exc
        raise
    if HOUR in df.columns:
        df = df.withColumn(HOUR, F.col(HOUR).cast("timestamp_ntz"))
    return df


def read_zone_csv(spark: SparkSession, path: str) -> DataFrame:
    """A3: optional zone lookup CSV (``LocationID, Zone, Borough``).

    A missing file or a file without the required header yields an empty,
    typed frame so joins downstream still work and names degrade to ids.
    """
    empty = spark.createDataFrame([], ZONE_CSV_SCHEMA)
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException:
        return empty
    if not {"LocationID", "Zone", "Borough"}.issubset(header):
        return empty
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        F.col("LocationID").try_cast("int").alias("LocationID"),
        F.col("Zone").cast("string").alias("Zone"),
        F.col("Borough").cast("string").alias("Borough"),
    )


def _nonblank(col) -> F.Column:
    """Python truthiness of one id spelling: null, '' and 0 all count as absent."""
    s = F.trim(col.cast("string"))
    return F.when((s == "") | (s == "0"), F.lit(None)).otherwise(s)


def read_zone_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A4: one row per GeoJSON feature: ``LocationID, Zone, Borough``.

    The id is the first present spelling of ``location_id``, ``LocationID``,
    ``locationid``; absent names default to ``Zone <id>`` / ``Unknown``.
    """
    # properties are kept as raw JSON text: the id spellings differ only in
    # case, which schema inference (case-insensitive) would merge.
    schema = T.StructType(
        [T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", T.StringType())])))]
    )
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    props = raw.select(F.explode("features").alias("f")).select(F.col("f.properties").alias("p"))

    def prop(name):
        return F.get_json_object("p", f"$.{name}")

    loc = F.coalesce(*[_nonblank(prop(n)) for n in ("location_id", "LocationID", "locationid")])
    loc_id = F.floor(loc.try_cast("double")).cast("int")
    return props.select(
        loc_id.alias("LocationID"),
        F.coalesce(prop("zone"), F.concat(F.lit("Zone "), loc_id.cast("string"))).alias("Zone"),
        F.coalesce(prop("borough"), F.lit("Unknown")).alias("Borough"),
    )


def write_table(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    sort_within: list[str] | None = None,
) -> None:
    """Overwrite a Parquet table, optionally partitioned (e.g. by date)."""
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_model(model, path: str) -> None:
    """Persist a fitted ``pyspark.ml`` model (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a model saved with :func:`save_model`."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
