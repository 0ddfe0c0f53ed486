"""Sites that keep coming: each is called by itself, so no state, watermark or shuffle is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions import model as M
from ..functions.pedigree import Graph
from ..operators.pedigree_calling import call


def start_calls(stream: DataFrame, graph: Graph, libraries: list[str], folder: str, checkpoint: str, p: M.Parameters = M.Parameters(), least: float = 0.5, once: bool = False) -> StreamingQuery:
    """Calls of a stream of sites, appended to a folder of parquet; once: what is there now, then stop."""
    out = call(stream, graph, libraries, p, least).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
