"""End-to-end runs (the reference's two entry points), wiring operators and
sinks. Every stage is a Spark job over the data; the driver only passes
names, small statistics and paths between them.

* :func:`run_question` - one table + a question: ingest (snapshot + audit),
  profile, clean (staging written and re-read, which also cuts the lineage),
  resolve, marts (written), anomalies on the question mart, quality scores,
  framing, lineage edges and SQL text export.
* :func:`run_datasets` - several datasets aligned on a time key: load, clean,
  coverage, standardise, integrate (written), generic + specialised marts,
  the primary mart for the question, anomalies on the integrated table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.anomaly import business_summary, detect_anomalies, frame_anomalies
from tidemark.operators.audit import key_checks, lineage_edges
from tidemark.operators.kpis import chart_feeds, kpi_panel, kpi_values, mart_measures, rank_dimensions
from tidemark.operators.cleaning import clean
from tidemark.operators.integrate import coverage, integrate, standardize
from tidemark.operators.quality import dq_overall, dq_scores, profile
from tidemark.plans.mart_sets import available_marts, primary_mart, wide_marts
from tidemark.plans.question import resolve
from tidemark.sources import sinks
from tidemark.sources.loaders import load_dataset
from tidemark.sources.readers import read_source


def run_question(spark: SparkSession, source: str, question: str, root: str,
                 metric: str | None = None, dimension: str | None = None,
                 source_format: str | None = None, read_options: dict | None = None,
                 export_sql: bool = True) -> dict:
    """Entry 1: one table and a question -> marts and their audit tables."""
    raw, manifest = sinks.ingest(spark, source, root, source_format=source_format,
                                 read_options=read_options)
    source_name = manifest["source"]
    profiled = profile(raw)
    cleaned = clean(raw)
    staging_path = sinks.write_staging(cleaned.df, root, source_name)
    staged = spark.read.parquet(staging_path)
    log_table, summary_table = cleaned.log_of(staged), cleaned.summary(staged)
    spec = resolve(staged, question, metric, dimension)
    built, skipped = available_marts(staged, spec)
    written = {name: sinks.write_mart(df, root, name)[1] for name, df in built.items()}
    lead = primary_mart(list(written))
    anomalies = detect_anomalies(written[lead])
    framed = frame_anomalies(anomalies.report, anomalies.total_rows)
    scores = dq_scores(staged)
    out = {
        "manifest": manifest, "profile": profiled, "staging_path": staging_path,
        "staging": staged, "cleaning_log": log_table, "cleaning_summary": summary_table,
        "spec": spec, "marts": written, "skipped_marts": skipped, "primary_mart": lead,
        "anomaly_report": framed,
        "anomaly_summary": business_summary(framed, anomalies.anomaly_row_count(), anomalies.total_rows),
        "flagged_rows": anomalies.flagged_rows, "dq_scores": scores, "dq_overall": dq_overall(scores),
        "lineage": lineage_edges(cleaned, written),
        "kpis": kpi_values(staged, question, spec.metric, spec.dimension, spec.aggregation),
        "suggested_dimensions": rank_dimensions(staged, question),
        "kpi_panel": kpi_panel(staged),
        "chart_feeds": chart_feeds(staged, question),
        "mart_measures": mart_measures(written),
    }
    shared = {name: df for name, df in written.items() if name != "mart_top_entities"}
    try:
        out["mart_key_checks"] = key_checks(shared)
    except ValueError:            # no column shared between marts
        out["mart_key_checks"] = None
    if export_sql:
        out["sql_export"] = sinks.export_sql_text(written, f"{root.rstrip('/')}/sql")
    return out


def run_datasets(spark: SparkSession, datasets: list[dict], root: str,
                 question: str | None = None, output_name: str = "master_dataset") -> dict:
    """Entry 2: several datasets aligned on their time key.

    Each dataset config names ``name``, ``time_column`` and optionally
    ``metric_column``, ``trend_aggregation`` and either ``loader`` (see
    ``tidemark.sources.loaders``) or ``path`` (CSV / Parquet)."""
    standardized, coverages, aggregations = [], {}, {}
    for cfg in datasets:
        if "time_column" not in cfg:
            raise ValueError(f"Dataset {cfg.get('name')!r} needs a time_column.")
        df = load_dataset(spark, cfg) if cfg.get("loader") else read_source(
            spark, cfg["path"], cfg.get("source_format"), cfg.get("read_options"))
        # staging is written once and re-read: the stats pass, the coverage and
        # the integration then read Parquet instead of recomputing the dedup
        result = clean(df)
        staging_path = sinks.write_staging(result.df, root, cfg["name"])
        cleaned = spark.read.parquet(staging_path)
        std = standardize(cleaned, cfg["name"], cfg["time_column"], cfg.get("metric_column"))
        coverages[std.dataset_name] = coverage(cleaned, std.time_column)
        aggregations[std.dataset_name] = cfg.get("trend_aggregation", "average")
        standardized.append(std)
    result = integrate(standardized)
    path = sinks.write_integrated(result.wide, root, output_name)
    wide = spark.read.parquet(path)
    mart_tables = wide_marts(wide, aggregations)
    written = {name: sinks.write_mart(df, root, name)[1] for name, df in mart_tables.items()}
    lead = primary_mart(list(written), question, [d.dataset_name for d in standardized])
    anomalies = detect_anomalies(wide)
    return {"integrated_path": path, "integrated": wide, "datasets": result.datasets,
            "coverage": coverages, "marts": written, "primary_mart": lead,
            "anomaly_report": frame_anomalies(anomalies.report, anomalies.total_rows)}
