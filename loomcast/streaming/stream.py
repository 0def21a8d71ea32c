"""Continuous arrival: every micro-batch runs the plan and appends to the log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from loomcast.config import EngineConfig
from loomcast.operators.infer import run
from loomcast.operators.strategies import Strategy


def infer_stream(items: DataFrame, path: str, checkpoint: str, strategies: dict[str, Strategy], config: EngineConfig = EngineConfig(), once: bool = True) -> StreamingQuery:
    """Items of a stream (item_id, prompt, ...) through the operator into the log at ``path``. Items that the log
    has are not called again, so a batch that runs twice calls only for what is missing."""

    def handle(batch: DataFrame, number: int) -> None:
        run(batch, path, strategies, config)

    writer = items.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class ProgressListener(StreamingQueryListener):
    """Calls ``report(rows so far)`` after each micro-batch; its exceptions are ignored."""

    def __init__(self, report: Callable[[int], None]):
        self.report, self.rows = report, 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        try:
            self.report(self.rows)
        except Exception:  # noqa: S110
            pass

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
