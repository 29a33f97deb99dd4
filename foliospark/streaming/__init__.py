"""Documents that keep arriving: the batch plans, applied to each micro-batch.

No operator keeps state between documents, so a stream needs no watermark and no late data exists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators import output
from foliospark.sources import text


def chunk_stream(docs: DataFrame, template: str, path: str, checkpoint: str, elements: Callable[[DataFrame], DataFrame] = text.from_documents, once: bool = False) -> StreamingQuery:
    """Writes the output rows of arriving documents as Parquet. docs: a streaming table of doc_id and text (or what ``elements`` takes).

    A batch that runs again after a failure overwrites its own folder, so rows are neither lost nor doubled."""

    def write(batch: DataFrame, number: int) -> None:
        output.outputs(elements(batch), template).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
