"""Packets from a stream of pages, with the packet in progress as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.sources.ogg import EOS, PACKETS, Page, read_packets

STATE = "part binary, due long, packet long"


def stream_packets(pages: DataFrame, strict: bool = False) -> DataFrame:
    """PACKETS of a streaming frame of PAGES, the same as in batch if each source's pages
    arrive in order. State is one unfinished packet a stream; the stream's end drops it,
    and pages after that begin anew."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        serial = int(key[1])
        part, due, packet = state.get if state.exists else (None, None, 0)
        parts = {serial: None if part is None else bytes(part)}
        dues = {} if due is None else {serial: due}
        frame = pd.concat(list(frames)).sort_values("page")
        counts: dict[str, int] = {}
        own = (Page(f, g, s, q, bytes(np.asarray(x).astype(np.uint8)), bytes(b), place=k) for f, g, s, q, x, b, k in zip(frame["flags"], frame["granule"], frame["serial"], frame["sequence"], frame["lacing"], frame["body"], frame["page"], strict=True))
        rows, lost = [], 0
        for p in read_packets(own, strict, counts, parts, dues):
            rows.append((*key, packet, p.granule, p.bos, p.eos, p.data, counts["lost"] - lost, p.page))
            packet, lost = packet + 1, counts["lost"]
        if int(frame["flags"].iloc[-1]) & EOS:
            state.remove()
        else:
            state.update((parts.get(serial), dues.get(serial), packet))
        if rows:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PACKETS.split(", ")])
            out["granule"] = out["granule"].astype("Int64")
            yield out

    return pages.groupBy("source", "serial").applyInPandasWithState(run, PACKETS, STATE, "append", GroupStateTimeout.NoTimeout)
