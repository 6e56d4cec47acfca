"""Signals and damage for tests: deterministic, and the same on every machine."""

from __future__ import annotations

import numpy as np

from spindrift.functions.encoder import LFE

#: Fixed values of the linear congruential generator of the noise.
LCG_FACTOR, LCG_STEP, LCG_SEED = 6364136223846793005, 1442695040888963407, 0x12345678


def lcg(n: int, seed: int = LCG_SEED) -> np.ndarray:
    """n numbers of 64 bits, each the one before times the factor plus the step."""
    powers = np.multiply.accumulate(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, LCG_FACTOR, dtype=np.uint64))))
    return powers[1:] * np.uint64(seed) + np.cumsum(powers[:-1], dtype=np.uint64) * np.uint64(LCG_STEP)


def tones(rate: int, channels: int, seconds: float, noise: float = 0.06) -> np.ndarray:
    """(channels x samples): seven harmonics with vibrato and a swelling envelope, low-passed
    noise, a decaying click each 0.6 s, and silence from 40 % to 50 %; the low-frequency
    channel, where there is one, has two low tones and the clicks."""
    n = int(rate * seconds)
    white = ((lcg(n * channels) >> np.uint64(33)).astype(np.float64) / (1 << 31) * 2 - 1).reshape(n, channels).T
    t, turn = np.arange(n) / rate, 2 * np.pi
    fade = 0.1 * 0.9 ** np.arange(min(max(n, 1), 500))
    out = np.zeros((channels, n))
    for c in range(channels):
        f0 = 220 * (1 + 0.25 * c) * (1 + 0.003 * np.sin(turn * 5 * t))
        tone = sum(np.sin(turn * f0 * h * t) / h for h in range(1, 8))
        if LFE.get(channels) == c:
            out[c] = 0.3 * np.sin(turn * 50 * t) + 0.2 * np.sin(turn * 80 * t)
        elif n:
            out[c] = 0.18 * tone * (0.5 + 0.5 * np.abs(np.sin(turn * 0.7 * t))) + noise * np.convolve(white[c], fade)[:n]
    since = np.fmod(t, 0.6)
    out += np.where(since < 0.01, 0.6 * np.exp(-400 * since) * white, 0.0)
    share = np.arange(n) / max(n, 1)
    out[:, (share > 0.4) & (share < 0.5)] = 0
    return out.astype(np.float32)


KINDS = ("flip", "cut", "insert", "remove")


def damaged(data: bytes, seed: int) -> tuple[str, bytes]:
    """(kind, data) with up to 16 bits inverted, the end cut off, up to 256 bytes put in, or
    up to 256 bytes taken out. Numbers come from the generator: the first three give the
    kind, the place and the amount."""
    x = (lcg(3 + 256, seed % (1 << 64)) >> np.uint64(33)).astype(np.int64)
    kind, at, amount, more = KINDS[x[0] % 4], int(x[1] % max(len(data), 1)), int(x[2] % 257), x[3:]
    if kind == "cut":
        return kind, data[:at]
    if kind == "insert":
        return kind, data[:at] + more[:amount].astype(np.uint8).tobytes() + data[at:]
    if kind == "remove":
        return kind, data[:at] + data[at + amount :]
    out = np.frombuffer(data, dtype=np.uint8).copy()
    if len(out):
        places = more[: 1 + amount % 16]
        np.bitwise_xor.at(out, places % len(out), (1 << (places // len(out) % 8)).astype(np.uint8))
    return kind, out.tobytes()
