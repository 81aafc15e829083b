"""Time differences on a stream of fields, with a bounded state per channel.

The state is a ring of the newest ``stride`` fields.  Instants that come again, come
too late or are left out are reported as rows of their own; they change no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "channel_idx int, kind string, t_idx long, upto long, field array<double>"
_STATE = "last long, times array<long>, ring array<array<double>>"


def _advance(stride: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ring = None, {}
        if state.exists:
            last, times, held = state.get
            ring = dict(zip(map(int, times), (np.asarray(x, float) for x in held), strict=True))
        rows = [(int(t), x) for b in batches for t, x in zip(b["t_idx"], b["field"], strict=True)]
        rows.sort(key=lambda r: r[0])  # a batch has no order of its own
        out = []
        for t, x in rows:
            x = np.asarray(x, float)
            if last is not None and t <= last:
                out.append(("repeated" if t in ring else "late", t, t, None))
                continue
            if last is not None and t > last + 1:
                out.append(("missing", last + 1, t - 1, None))
            ring = {u: v for u, v in ring.items() if u >= t - stride}
            if t - stride in ring:
                out.append(("change", t - stride, t, x - ring[t - stride]))
            ring[t], last = x, t
        kept = sorted(u for u in ring if u > last - stride) if last is not None else []
        if last is not None:
            state.update((last, kept, [ring[u].tolist() for u in kept]))
        if out:
            yield pd.DataFrame({"channel_idx": np.int32(key[0]), "kind": [o[0] for o in out], "t_idx": [o[1] for o in out], "upto": [o[2] for o in out], "field": [o[3] for o in out]})

    return run


def stream_changes(fields: DataFrame, stride: int) -> DataFrame:
    """channel_idx, kind, t_idx, upto, field of a stream ``fields(t_idx, channel_idx, field)``.

    kind ``change``: field is ``x[t_idx + stride] - x[t_idx]``, emitted when the later one
    arrives (upto).  ``missing``: the instants t_idx to upto were passed over;
    ``repeated``, ``late``: an instant not beyond the newest one, held by the ring or not
    (the first one counts).  Within a micro-batch instants are taken in order.  The
    state of a channel is ``stride`` fields whatever has come.
    """
    if stride < 1:
        raise ValueError("stride must be at least 1")
    rows = fields.where("t_idx IS NOT NULL AND channel_idx IS NOT NULL AND field IS NOT NULL").select(F.col("channel_idx").cast("int").alias("channel_idx"), F.col("t_idx").cast("long").alias("t_idx"), F.col("field").cast("array<double>").alias("field"))
    return rows.groupBy("channel_idx").applyInPandasWithState(_advance(stride), _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def write_changes(fields: DataFrame, stride: int, out: str, checkpoint: str) -> None:
    """Append the rows of everything that is new to the table ``out``, exactly once, and end."""
    stream = stream_changes(fields, stride).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
