"""A log of queries: how long each was analysed, optimised, planned and run, its stages and rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

PHASES = ("analysis", "optimization", "planning", "execution")


class QueryLog:
    """Runs queries for their results and notes where the time went.

    Times of the planning phases are those of Spark's own tracker; execution is wall time of the
    write; stages and tasks are taken from the status tracker by the query's job group.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rows: list[tuple[str, str, float, int, int, int]] = []

    def run(self, name: str, df: DataFrame, format: str = "noop", **options) -> int:
        """Write df (to nowhere by default); the number of rows."""
        from pyspark.sql import Observation
        from pyspark.sql import functions as F

        sc, seen = self.spark.sparkContext, Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
        group = f"brindle-{name}-{time.time_ns()}"
        sc.setJobGroup(group, name)
        try:
            start = time.perf_counter()
            counted.write.format(format).mode("overwrite").options(**options).save()
            took = 1000 * (time.perf_counter() - start)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
            sc.setLocalProperty("spark.job.description", None)
        tracker = sc.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds]
        tasks = sum(info.numTasks for s in stages if (info := tracker.getStageInfo(s)))
        plan = df._jdf.queryExecution()
        plan.executedPlan()  # phases are timed on demand
        phases = plan.tracker().phases()
        n = int(seen.get["n"])
        for phase in PHASES[:-1]:
            found = phases.get(phase)
            self.rows.append((name, phase, float(found.get().durationMs()) if found.isDefined() else 0.0, len(stages), tasks, n))
        self.rows.append((name, "execution", took, len(stages), tasks, n))
        return n

    def frame(self) -> DataFrame:
        """query, phase, ms, stages, tasks, rows for all that was run."""
        return self.spark.createDataFrame(self.rows, "query string, phase string, ms double, stages int, tasks int, rows long")
