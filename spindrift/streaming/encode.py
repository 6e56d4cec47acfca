"""Packets from a stream of PCM chunks, with the encoder's open blocks as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.functions.encoder import Config, Push
from spindrift.operators.encode import PACKETS, _encoder

CHUNKS = "source string, serial long, chunk long, last boolean, samples array<array<float>>"
STATE = "total long, first long, samples binary, before binary, segment long, energy binary, centre long, is_long boolean, was_long boolean, packet long"


def stream_encode(chunks: DataFrame, config: Config) -> DataFrame:
    """PACKETS of a streaming frame of CHUNKS, the same as encode() of whole signals if
    each stream's chunks arrive in order and the last one is marked. Chunks may have any
    size, also none. State is about 4000 samples a stream; its last chunk drops it."""
    names = [c.split()[0] for c in PACKETS.split(", ")]

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        encoder, rows = _encoder(config), []
        if state.exists:
            live = Push.load(encoder, *state.get)
        else:
            live = Push(encoder)
            rows += [(*key, k, 0, k != 1, h) for k, h in enumerate(encoder.headers())]
        frame = pd.concat(list(frames)).sort_values("chunk")
        for samples, last in zip(frame["samples"], frame["last"], strict=True):
            x = np.stack([np.asarray(c, dtype=np.float32) for c in samples]) if len(samples) else np.zeros((config.channels, 0), dtype=np.float32)
            found = live.push(x) + (live.finish() if last else [])
            rows += [(*key, k, granule, False, data) for k, granule, data in found]
        if live.done:
            state.remove()
        else:
            state.update(live.state())
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return chunks.groupBy("source", "serial").applyInPandasWithState(run, PACKETS, STATE, "append", GroupStateTimeout.NoTimeout)
