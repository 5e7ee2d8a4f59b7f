"""What each stage of a plan took in, gave out, and how long it took: a log line and a row of a table."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import settled

LOGGER = logging.getLogger("quern")
STAGES = "ord int, stage string, rows_in long, rows_out long, ms double"


class StageLog:
    """Stages are written down one by one, so that each is timed by itself; rows are counted by an observation of that write, not by a pass of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []
        self._sizes: dict[int, tuple[DataFrame, int]] = {}

    def stage(self, name: str, rows: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``build(rows)``, written down. The size of ``rows`` is known if they are a stage's, else they are counted."""
        held = self._sizes.get(id(rows))
        n_in = held[1] if held else rows.count()
        began, seen = time.perf_counter(), Observation(name)
        out = settled(build(rows).observe(seen, F.count(F.lit(1)).alias("n")))
        n_out = seen.get["n"]
        self._sizes[id(out)] = out, n_out
        return self.noted(name, n_in, n_out, began, out)

    def noted(self, name: str, n_in: int, n_out: int, began: float, out=None):
        ms = (time.perf_counter() - began) * 1000
        self.rows.append((len(self.rows) + 1, name, n_in, n_out, ms))
        LOGGER.info("%s: %d rows in, %d rows out, %.2f ms", name, n_in, n_out, ms)
        return out

    def table(self) -> DataFrame:
        """ord, stage, rows_in, rows_out, ms, in the order of the stages."""
        return self.spark.createDataFrame(self.rows, STAGES)


def staged(log: StageLog | None, name: str, rows: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return build(rows) if log is None else log.stage(name, rows, build)
