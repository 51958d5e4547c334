"""U7 live form: a ``StreamingQueryListener`` that turns progress events of our
own streams into ``(run, key, step, value)`` metric rows.

Callbacks only buffer rows (one small row per metric per trigger): a Spark
job must not be started from the listener-bus thread. The owner calls
:meth:`MetricsListener.flush` from the driver thread (between triggers or
after the query ends), which appends the buffer with
:func:`textforge.sources.io.append_metrics` in one write.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from textforge.sources import io as IO

PROGRESS_METRICS = ("numInputRows", "inputRowsPerSecond", "processedRowsPerSecond")


class MetricsListener(StreamingQueryListener):
    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path, run
        self.rows: list[tuple[str, str, int, float]] = []

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        name = p.name or str(p.id)
        for k in PROGRESS_METRICS:
            v = getattr(p, k, None)
            if v is not None:
                self.rows.append((self.run, f"stream/{name}/{k}", int(p.batchId), float(v)))

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass

    def flush(self) -> None:
        if not self.rows:
            return
        rows, self.rows = list(self.rows), []
        IO.append_metrics(self.spark.createDataFrame(rows, IO.METRIC_SCHEMA), self.path)
