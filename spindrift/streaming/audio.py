"""PCM from a stream of pages: packets, overlap and place on the time axis as state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.functions import audio, batch, mdct
from spindrift.functions.codebook import Invalid
from spindrift.sources.ogg import EOS, Page, read_packets

PCM = "source string, serial long, chan int, packet long, rate long, position long, samples array<float>"
STATE = "part binary, due long, packet long, heads array<binary>, before binary, raw long, base long, paged boolean, held array<long>, sizes array<long>, waiting binary"


@dataclass
class Live:
    """A stream in progress. Blocks wait for the packet that has a granule position or
    ends the stream; until then held has their packet numbers and samples."""

    packet: int = 0
    heads: list[bytes] = field(default_factory=list)
    before: np.ndarray | None = None
    raw: int = 0  # samples of all packets before the waiting ones
    base: int = 0
    paged: bool = False  # whether a page of audio has ended
    held: list[tuple[int, np.ndarray]] = field(default_factory=list)

    def push(self, data: bytes, granule: int | None, eos: bool, strict: bool) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(channel, packet, position, samples) of what the packet releases."""
        k, self.packet = self.packet, self.packet + 1
        if k < 3:
            self.heads.append(data)
            return
        try:
            own = audio.headers(self.heads[0], self.heads[2])
        except Invalid:
            if strict:
                raise
            return
        block = batch.decode_packets(self.heads[0], self.heads[2], [data])[0] if data else None
        if block is None and strict and data:
            raise Invalid(f"packet {k} is no audio")
        pcm = np.zeros((own[0].channels, 0), dtype=np.float32)
        if block is not None:
            if self.before is not None:
                pcm = np.stack(mdct.overlapped(list(self.before), list(block))).astype(np.float32)
            self.before = block
        self.held.append((k, pcm))
        if granule is None and not eos:
            return
        total = sum(x.shape[1] for _, x in self.held)
        if not self.paged and not eos and granule is not None:
            self.base = granule - total
        self.paged = True
        for n, x in self.held:
            start = self.raw + self.base
            end = start + x.shape[1]
            self.raw += x.shape[1]
            lo, hi = max(start, 0), min(end, granule) if eos and granule is not None else end
            if hi > lo:
                for c, row in enumerate(x):
                    yield c, n, lo, row[lo - start : hi - start]
        self.held = []

    @property
    def rate(self) -> int:
        return audio.headers(self.heads[0], self.heads[2])[0].rate

    def state(self) -> tuple:
        waiting = b"".join(x.tobytes() for _, x in self.held)
        before = None if self.before is None else self.before.astype("<f4").tobytes()
        return self.packet, self.heads, before, self.raw, self.base, self.paged, [k for k, _ in self.held], [x.shape[1] for _, x in self.held], waiting

    @classmethod
    def load(cls, packet, heads, before, raw, base, paged, held, sizes, waiting) -> Live:
        out = cls(packet, [bytes(h) for h in heads], None, raw, base, paged)
        if packet > 3 and len(out.heads) == 3 and (before is not None or len(held)):
            ch = audio.Identification.read(out.heads[0]).channels
            out.before = None if before is None else np.frombuffer(bytes(before), "<f4").reshape(ch, -1)
            flat, at = np.frombuffer(bytes(waiting), "<f4"), 0
            for k, n in zip(held, sizes, strict=True):
                out.held.append((int(k), flat[at : at + ch * n].reshape(ch, n)))
                at += ch * n
        return out


def stream_pcm(pages: DataFrame, strict: bool = False) -> DataFrame:
    """PCM of a streaming frame of PAGES, the same as decode() in batch if each source's
    pages arrive in order. State is one unfinished packet, the headers, the block before
    and the blocks of one page; the stream's end drops it. A stream that is cut before
    its end keeps what its last page has left open in the state."""
    names = [c.split()[0] for c in PCM.split(", ")]

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        serial = int(key[1])
        part, due, *rest = state.get if state.exists else (None, None)
        live = Live.load(*rest) if rest else Live()
        parts = {serial: None if part is None else bytes(part)}
        dues = {} if due is None else {serial: due}
        frame = pd.concat(list(frames)).sort_values("page")
        own = (Page(f, g, s, q, bytes(np.asarray(x).astype(np.uint8)), bytes(b)) for f, g, s, q, x, b in zip(frame["flags"], frame["granule"], frame["serial"], frame["sequence"], frame["lacing"], frame["body"], strict=True))
        rows = []
        for p in read_packets(own, strict, None, parts, dues):
            for c, n, at, x in live.push(p.data, p.granule, p.eos, strict):
                rows.append((*key, c, n, live.rate, at, x))
        if int(frame["flags"].iloc[-1]) & EOS:
            state.remove()
        else:
            state.update((parts.get(serial), dues.get(serial), *live.state()))
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return pages.groupBy("source", "serial").applyInPandasWithState(run, PCM, STATE, "append", GroupStateTimeout.NoTimeout)
