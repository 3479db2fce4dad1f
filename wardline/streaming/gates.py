"""The gate on a stream of texts: one scan, three sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wardline.operators.gate import gate, proof_record
from wardline.sources.sinks import assert_no_raw


def gate_stream(
    texts: DataFrame, text: str, keys: list[str], folder: str, checkpoint: str, redact: bool = True, denylist: list[str] | None = None
) -> DataStreamWriter:
    """A writer that sends PASS and REDACT payloads, BLOCK decisions and proofs to three Parquet folders.

    Each micro-batch writes its own ``batch`` folder in overwrite mode, so a batch that is replayed
    after a failure replaces what it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # the scan is the expensive part: keep it for the three writes of this batch
        gated = gate(batch, text, redact, denylist).persist()
        try:
            outgoing = F.coalesce("redacted", F.col(text)) if redact else F.col(text)
            passed = gated.where("action <> 'BLOCK'").select(*keys, "action", outgoing.alias(text))
            blocked = gated.where("action = 'BLOCK'").select(*keys, "action", "redaction_map_hash")
            for name, frame in (("passed", passed), ("blocked", blocked), ("proofs", proof_record(gated, keys))):
                assert_no_raw(frame).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        finally:
            gated.unpersist()

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
