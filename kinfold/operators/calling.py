"""De novo statistics of trios, batch by batch; cheap filters stay in front as plain expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.model import Parameters, trio_statistics

STATS = ("qual", "mutq", "mutx", "dnp", "lld", "lls", "llh")


def trio_calls(depths: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Rows of `trio_depths` with the statistics; no shuffle."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda who: np.stack([batch.column(f"{who}_{k}").to_numpy(zero_copy_only=False) for k in ("ref", "alt")], 1)  # noqa: E731, B023
            stats = trio_statistics(get("dad"), get("child"), get("mom"), p)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(stats[k]) for k in STATS)], names=[*batch.schema.names, *STATS])

    return depths.mapInArrow(work, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in depths.schema), *(f"{k} double" for k in STATS)]))
