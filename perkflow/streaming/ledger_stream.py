"""Streaming redemption writer (I8); flags against the ledger are computed when offers are read.

One streaming query is the ledger's single writer: each micro-batch of
redemption requests is de-duplicated on (member_id, offer_type,
redemption_date), anti-joined with the stored ledger and appended. A re-run
batch finds its rows already stored and appends nothing, so the ledger key
stays unique without ``dropDuplicates`` state that grows forever (and without
``dropDuplicatesWithinWatermark``, which forgets keys after the delay).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from perkflow.operators.ledger import append_redemptions
from perkflow.streaming.summary_stream import _trigger


def start_redemption_stream(requests: DataFrame, ledger_path: str, checkpoint: str,
                            trigger: str | None = "availableNow") -> StreamingQuery:
    """Streaming requests (member_id, member_name, offer_type, requested_at) -> ledger (I8)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_redemptions(batch.sparkSession, batch, ledger_path)

    w = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return _trigger(w, trigger).start()
