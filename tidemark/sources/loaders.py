"""Named dataset loaders (A12-A18): read files with Spark, shape them with
``tidemark.operators.series``. Dispatch is a dict of functions by name.
"""

from __future__ import annotations

import csv
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.sources.readers import read_csv

LOG = logging.getLogger(__name__)


def load_whitespace_temperature(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """Whitespace text feed with ``%`` comments."""
    return series.whitespace_series(spark.read.text(path))


def load_entity_co2(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """Entity series (default the ``World`` rows) from a wide CSV."""
    columns = config.get("columns") or ["country", "year", "iso_code", "co2", "co2_growth_abs",
                                        "co2_growth_prct", "co2_per_capita", "share_global_co2",
                                        "population"]
    df = read_csv(spark, path).select(*columns)
    out = series.entity_series(df, config.get("entity_column", "country"),
                               config.get("entity_value", "World"), "year", columns)
    if out.isEmpty():
        raise ValueError("the requested entity has no rows in the source")
    return out


def load_page_arrays(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """Numeric arrays embedded in HTML pages (one page per file)."""
    pages = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))
    return series.page_arrays(pages, "html", key_columns=["file"])


def _listed(spark: SparkSession, folder: str) -> set[str]:
    """The file names of a folder, from one listing; none where there is no such folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()


def monthly_paths(spark: SparkSession, folder: str, version: str = "4.0",
                  fallback: str = "4.0") -> tuple[list[str], list[str], list[str]]:
    """The 12 monthly file names with a version fallback, resolved
    through one listing of the folder: (used, fallbacks, skipped)."""
    there, base = _listed(spark, folder), folder.rstrip("/")
    used, fallbacks, skipped = [], [], []
    for month in range(1, 13):
        names = [f"N_{month:02d}_extent_v{v}.csv" for v in dict.fromkeys((version, fallback))]
        found = next((n for n in names if n in there), None)
        if found is None:
            skipped += [f"{base}/{n}" for n in names]
            continue
        if found != names[0]:
            fallbacks.append(f"{base}/{found}")
        used.append(f"{base}/{found}")
    return used, fallbacks, skipped


def read_with_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files of different headers as one table of text columns, from one scan.

    The first line of each file names its columns; the driver gets those lines (one
    per file). A column that a file does not have is NULL for its rows."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().alias("row"))
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "row").alias("head"), F.min("row").alias("row")).collect()
    names = {h["file"]: [n.strip().strip('"') for n in next(csv.reader([h["head"]]))] for h in heads}
    widest = max(map(len, names.values()), default=0)
    # a header's row is the first one of its file, which is known by file and number
    first = F.create_map(*[F.lit(x) for h in heads for x in (h["file"], h["row"])]) if heads else None
    body = lines.where((F.trim("value") != "") & ((F.col("block") > 0) | (F.col("row") > first[F.col("file")]))) if heads else lines
    cells = body.select("file", F.from_csv("value", ", ".join(f"c{i} string" for i in range(widest)),
                                           {"ignoreLeadingWhiteSpace": "true"}).alias("c")) if widest else body
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file, own in names.items():
        layouts.setdefault(tuple(own), []).append(file)
    columns = []
    for name in dict.fromkeys(n for own in names.values() for n in own):
        value = F.lit(None).cast("string")
        for own, files in layouts.items():
            if name in own:
                value = F.when(F.col("file").isin(files), F.col(f"c.c{own.index(name)}")).otherwise(value)
        columns.append(value.alias(name))
    return cells.select(*columns)


def load_monthly_extent(spark: SparkSession, folder: str, config: dict) -> DataFrame:
    """The available monthly files of a folder, or one file by its own path, cleaned."""
    if folder.lower().endswith(".csv"):
        used, fallbacks, skipped = [folder], [], []
    else:
        used, fallbacks, skipped = monthly_paths(spark, folder, str(config.get("version", "4.0")))
    if fallbacks:
        LOG.warning("Some monthly files required a fallback version: %s", ", ".join(fallbacks))
    if skipped:
        LOG.warning("Missing monthly files were skipped: %s", ", ".join(skipped))
    return series.monthly_extent([series.tidy_names(read_with_headers(spark, used))] if used else [])


def load_indicator(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """One country's indicator from CSV or a ``[meta, [records]]`` JSON feed."""
    metric = str(config.get("metric_column") or "").strip()
    if not metric:
        raise ValueError("an indicator series needs metric_column")
    if str(config.get("source_format", "")).lower() == "json" or path.lower().endswith(".json"):
        raw = series.json_feed_records(spark.read.text(path, wholetext=True))
    else:
        raw = read_csv(spark, path).drop("_row_id")
    out = series.indicator_series(raw, metric, config.get("country_column", "Country Name"),
                                  config.get("year_column", "Year"),
                                  config.get("value_column", "Value"),
                                  config.get("country_value", "World"))
    if out.isEmpty():
        raise ValueError("the source has no values for "
                         f"{config.get('country_value', 'World')!r}")
    return out


def load_yearly_aggregate(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """Aggregate a CSV to one value per year."""
    metric = str(config.get("metric_column") or "").strip()
    if not metric:
        raise ValueError("a yearly series needs metric_column")
    df = read_csv(spark, path)
    out = series.yearly_series(df, metric, config.get("time_source_column", "year"),
                               str(config.get("aggregation", "sum")).lower(),
                               config.get("value_column"), config.get("entity_column"),
                               str(config.get("entity_parser", "")).lower() == "python_list",
                               config.get("min_year"), config.get("max_year"))
    if out.isEmpty():
        raise ValueError("the source gave no rows with a year and a value")
    return out


LOADERS = {
    "berkeley_temperature": load_whitespace_temperature,
    "owid_world_co2": load_entity_co2,
    "nasa_sea_level": load_page_arrays,
    "nsidc_monthly_ice_extent": load_monthly_extent,
    "world_indicator_series": load_indicator,
    "aggregated_time_series": load_yearly_aggregate,
}


def load_dataset(spark: SparkSession, config: dict) -> DataFrame:
    """Dispatch a dataset config to its loader."""
    name = config.get("loader")
    if not name:
        raise ValueError("the dataset names no loader")
    loader = LOADERS.get(name)
    if loader is None:
        raise ValueError(f"no loader is called {name}")
    source = config.get("source") or config.get("url") or config.get("path")
    if not source:
        raise ValueError("the dataset names no path")
    return loader(spark, str(source), config)
