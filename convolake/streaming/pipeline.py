"""Run the pipeline on session logs as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.distill import ModelFn
from ..plans.pipeline import run_pipeline
from ..sources.ledger import read_changed_logs, read_ledger, write_ledger


def start_pipeline(logs: DataFrame, root: str, checkpoint: str, every: str | None = None,
                   model_fn: ModelFn | None = None, template: str | None = None,
                   render: bool = True, on_error: Callable[[int, Exception], None] | None = None,
                   **options) -> StreamingQuery:
    """Start the pipeline on a stream of logs (``stream_session_logs``).

    ``every`` is the time between runs, the pause that lets a burst of changes
    settle; without it the query takes what is there and ends.  ``options`` go to
    ``run_pipeline`` (``grain``, ``mode``, ``documents``, ``review_template``).  A run that fails
    stops the query, which resumes with the same files.  With ``on_error``, errors of
    distilling, reviewing and rendering are reported and the run goes on; storing messages and
    paths still stops the query, so that no file is passed over.  Spark makes no run while no
    file comes, so batches that failed wait for the next file; ``poll_logs`` asks them again
    on its clock.
    """
    def run(batch: DataFrame, number: int) -> None:
        if on_error is not None:
            def report(step: str, error: Exception) -> None:
                on_error(number, error)
        else:
            report = None
        run_pipeline(batch.sparkSession, root, batch, number, model_fn, template, render, on_error=report, **options)

    writer = logs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def poll_logs(spark: SparkSession, source: str, root: str, checkpoint: str, every: str,
              model_fn: ModelFn | None = None, template: str | None = None, **options) -> StreamingQuery:
    """Run the pipeline on a clock over all log files that changed, also those known before.

    A stream of files hands out each file once, so it misses requests appended to it; here a
    timed stream lists the files anew and reads those that the ledger under ``root`` does not
    hold as they are, message by message.  A file is noted after its messages are stored: a
    restart opens no file that was read, and repeats a run that was cut short.  Runs without
    new files ask the batches that failed again.
    """
    def run(_: DataFrame, number: int) -> None:
        raw, seen = read_changed_logs(spark, source, read_ledger(spark, root))
        run_pipeline(spark, root, raw, number, model_fn, template, grain="message", **options)
        if not seen.isEmpty():
            write_ledger(seen, root, number)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
