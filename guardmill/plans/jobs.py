"""Whole jobs that leave a quality report and a catalogue beside their tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardmill.contracts import Contracts
from guardmill.operators.catalog import build_catalog
from guardmill.operators.quality import WriteChecks, quality_summary
from guardmill.plans import pipeline
from guardmill.sources.io import Entry
from guardmill.sources.tables import write_json_rows


def run_with_report(spark: SparkSession, contracts: Contracts, folder: str,
                    job: Callable[[pipeline.Watch], None],
                    expected: Sequence[str] = ()) -> DataFrame:
    """Runs `job` and writes `report`, `summary` and `catalog` as JSON lines below `folder`.

    The job passes what it writes through the function it is given, so checks are counted by
    the very jobs that write; datasets of `expected` that it did not write are warned about.
    Returns the written report.
    """
    checks = WriteChecks(contracts)
    written = []

    def watch(dataset_id: str, df: DataFrame) -> DataFrame:
        written.append(dataset_id)
        return checks.watch(dataset_id, df)

    job(watch)
    for dataset_id in expected:
        if dataset_id not in written:
            checks.absent(dataset_id)
    write_json_rows(checks.report(spark), f"{folder}/report")
    report = read_report(spark, folder)
    write_json_rows(quality_summary(report), f"{folder}/summary")
    write_json_rows(build_catalog(spark, contracts), f"{folder}/catalog")
    return report


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    from guardmill.operators.quality import REPORT

    return spark.read.schema(REPORT).json(f"{folder}/report")


def gold_job(bronze_with_text: DataFrame, keys: DataFrame,
             settings: pipeline.EmbeddingSettings, readers: dict[str, Entry],
             writers: dict[str, Entry], facts_path: str) -> Callable[[pipeline.Watch], None]:
    """`pipeline.run_gold` as a job for `run_with_report`."""
    def run(watch: pipeline.Watch) -> None:
        pipeline.run_gold(bronze_with_text, keys, settings, readers, writers, facts_path,
                          watch=watch)

    return run


def bronze_job(spark: SparkSession, readers: dict[str, Entry], writers: dict[str, Entry],
               ingested_at: str) -> Callable[[pipeline.Watch], None]:
    def run(watch: pipeline.Watch) -> None:
        pipeline.run_bronze(spark, readers, writers, ingested_at, watch)

    return run


def several(*jobs: Callable[[pipeline.Watch], None]) -> Callable[[pipeline.Watch], None]:
    """One job after the other, with one report."""
    def run(watch: pipeline.Watch) -> None:
        for job in jobs:
            job(watch)

    return run
