"""Runs as tables: records, logs and figures by job, written side by side and committed as a whole.

Each kind of result is a Parquet table partitioned by ``job_id``; writing a job replaces its own partitions and no others.
A job counts as done when its partition of the table ``commits`` exists, which is written last. A job that died before is
not read and is run again; its half-written partitions are replaced. All of it goes through Spark's own file systems.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "commits"


@dataclass(frozen=True)
class RunTables:
    """The result tables below a folder that all executors reach."""

    spark: SparkSession
    path: str

    def _at(self, kind: str) -> str:
        return f"{self.path.rstrip('/')}/{kind}"

    def exists(self, kind: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(kind))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def write(self, kind: str, rows: DataFrame) -> None:
        """Rows (with job_id) of one or many jobs, in place of what these jobs have in the table."""
        if kind == COMMITS:
            raise ValueError("commits are written by commit")
        if "job_id" not in rows.columns:
            raise ValueError("rows need a job_id")
        # a file per job and task; a large job is not gathered in one task
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(self._at(kind))

    def commit(self, jobs: DataFrame) -> None:
        """Marks jobs (job_id and figures of any kind) as done, one partition each."""
        done = jobs.withColumn("finished", F.current_timestamp())
        done.repartition("job_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(self._at(COMMITS))

    def done(self) -> DataFrame:
        """The commits: job_id, figures, finished; without any, only an empty job_id."""
        if not self.exists(COMMITS):
            return self.spark.createDataFrame([], "job_id string")
        return self.read_all(COMMITS)

    def read_all(self, kind: str) -> DataFrame:
        """Rows of all jobs, done or not."""
        # job_id stays text, whatever it looks like
        schema = self.spark.read.parquet(self._at(kind)).drop("job_id").schema.add("job_id", "string")
        return self.spark.read.schema(schema).parquet(self._at(kind))

    def remaining(self, jobs: DataFrame) -> DataFrame:
        """The jobs (with job_id) that are not done."""
        return jobs.join(self.done().select("job_id"), "job_id", "left_anti")

    def read(self, kind: str, jobs: Sequence[str] | None = None) -> DataFrame:
        """Rows of jobs that are done, of the named ones if given; partitions of other jobs are not scanned."""
        rows, done = self.read_all(kind), self.done().select("job_id")
        if jobs is not None:
            rows = rows.where(F.col("job_id").isin(list(jobs)))
        return rows.join(done, "job_id", "left_semi")
