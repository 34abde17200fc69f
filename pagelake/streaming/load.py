"""Records of a stream into the book table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagelake.sources.book_tables import write_book_detail


def load_stream(items: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A3 on a stream: each batch is appended under the unique (book_name, author) rule.

    A batch that runs again after a failure finds its records stored and refuses them, so
    nothing is stored twice.
    """

    def push(batch: DataFrame, _: int) -> None:
        write_book_detail(batch, path)

    writer = items.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()
