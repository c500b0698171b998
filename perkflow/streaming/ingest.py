"""The whole ingest job: messages -> valid rows -> watermarked summary change log, with a rejects sink.

Two streaming queries read the same source. One keeps the member summary from
the messages that ``wire.is_valid`` accepts; the other writes every message it
refuses, as it came, with the reason. Each has its own checkpoint, so either
can be restarted alone; both overwrite a micro-batch's own folder, so a
repeated batch repeats nothing.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from perkflow import config
from perkflow.sources.wire import decode_transactions, rejected_rows, valid_rows
from perkflow.streaming.summary_stream import _trigger, start_summary_changelog, summary_stream


@dataclass(frozen=True)
class Ingest:
    summary: StreamingQuery
    rejects: StreamingQuery

    @property
    def queries(self) -> tuple[StreamingQuery, StreamingQuery]:
        return self.summary, self.rejects


def start_ingest(messages: DataFrame, root: str, value_col: str = "value", window: str = config.DEFAULT_WINDOW,
                 delay: str = config.WATERMARK_DELAY, trigger: str | None = "availableNow",
                 n_state_partitions: int | None = None) -> Ingest:
    """Start both queries on a stream of messages; ``root`` gets changelog, rejects and checkpoints."""
    tx = valid_rows(decode_transactions(messages, value_col))
    summary = start_summary_changelog(summary_stream(tx, window, delay), f"{root}/changelog",
                                      f"{root}/checkpoints/summary", trigger, n_state_partitions=n_state_partitions)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(f"{root}/rejects", f"batch_id={batch_id}"))

    writer = rejected_rows(messages, value_col).writeStream \
        .option("checkpointLocation", f"{root}/checkpoints/rejects").foreachBatch(write)
    return Ingest(summary, _trigger(writer, trigger).start())
