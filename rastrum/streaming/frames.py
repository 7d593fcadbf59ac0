"""Frame residuals over a stream: the last frame of each series and pixel is the state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

OUT = "series int, frame int, px int, res int"
STATE = "last int, seen boolean"


def frame_residual_stream(frames: DataFrame) -> DataFrame:
    """series, frame, px, res of a stream of series, frame, px, v whose frames arrive in order.

    The first frame of a series is kept as it is, later ones are differences to the
    frame before, wrapped to 16 bits and zigzagged.
    """

    def run(key, batches, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("frame")
        values = rows["v"].astype("int64").tolist()
        out = []
        for v in values:
            d = None if last is None else ((v - last + 32768) & 65535) - 32768
            out.append(v if d is None else 2 * d if d >= 0 else -2 * d - 1)
            last = v
        state.update((int(last), True))
        yield pd.DataFrame({"series": key[0], "frame": rows["frame"].to_numpy(), "px": key[1], "res": out})

    return frames.select("series", "frame", "px", "v").groupBy("series", "px").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")
