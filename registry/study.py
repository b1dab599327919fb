"""Stored steps of the study per application and data folder: extract and cohorts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import records as rec
from spanwise.operators.derive import with_priority_group
from spanwise.operators.features import PERSON
from spanwise.plans.extract import cohort_extract, dose_index, record_tasks
from spanwise.plans.process import derive_cohort, exclude
from spanwise.sources.extract import flags_to_int, normalise_missing
from spanwise.sources.snapshots import snapshot, snapshot_by


@dataclass
class Study:
    spark: SparkSession
    sf_dir: str
    stored: dict[str, DataFrame] = field(default_factory=dict)

    def _store(self, name: str, build) -> DataFrame:
        if name not in self.stored:
            self.stored[name] = snapshot(build(), name)
        return self.stored[name]

    @property
    def codelists(self) -> DataFrame:
        return rec.codelists(self.spark)

    def records(self, name: str) -> DataFrame:
        return getattr(rec, name)(self.spark, self.sf_dir)

    def table(self, name: str) -> DataFrame:
        return rec.table(self.spark, self.sf_dir, name)

    @property
    def doses(self) -> DataFrame:
        """Dose dates, stored because every index-relative query starts from them."""
        return self._store("doses", lambda: dose_index(rec.records(self.spark, self.sf_dir), self.codelists, rec.DATES))

    @property
    def index(self) -> DataFrame:
        """People with both doses."""
        return self.doses.where(F.col("dose_2").isNotNull())

    @property
    def cleaned(self) -> DataFrame:
        return flags_to_int(normalise_missing(self.extract))

    @property
    def extract(self) -> DataFrame:
        return self._store("extract", self.build_extract)

    def build_extract(self) -> DataFrame:
        records = rec.records(self.spark, self.sf_dir)
        tasks = record_tasks(records)
        return cohort_extract(records, self.codelists, rec.DATES, lambda df, label: snapshot_by(df, label, PERSON, tasks), tasks)

    @property
    def cohort_all(self) -> DataFrame:
        return self._store("cohort_all", lambda: derive_cohort(self.extract, rec.STUDY_END))

    @property
    def cohort(self) -> DataFrame:
        """Rows of ``cohort_all`` by plain conditions, which a reader's scan applies to the columns that it needs."""
        return exclude(self.cohort_all)

    @property
    def grouped(self) -> DataFrame:
        return with_priority_group(self.cohort)


_STUDIES: dict[tuple[str, str], Study] = {}


def study(spark: SparkSession, sf_dir: str) -> Study:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STUDIES:
        _STUDIES[key] = Study(spark, sf_dir)
    return _STUDIES[key]
