"""MDCT kernels over batches of blocks (rows), through numpy's FFT."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=32)
def _turn(n: int) -> np.ndarray:
    return np.exp(-1j * np.pi * (np.arange(n // 2) + 0.125) / n)


def dct4(x: np.ndarray) -> np.ndarray:
    """sum x[n] cos(pi/N (n + 1/2)(k + 1/2)) of each row: the even values and, reversed,
    the odd ones make a complex row of half the length, whose turned spectrum holds both."""
    n = x.shape[1]
    if n % 2:
        k = np.arange(n)
        wide = np.zeros((len(x), 2 * n), dtype=complex)
        wide[:, :n] = x * np.exp(-0.5j * np.pi * k / n)
        return (np.fft.fft(wide, axis=1)[:, :n] * np.exp(-0.5j * np.pi * (k + 0.5) / n)).real
    turn = _turn(n)
    y = np.fft.fft((x[:, ::2] + 1j * x[:, ::-2]) * turn, axis=1) * turn
    out = np.empty(x.shape)
    out[:, ::2], out[:, ::-2] = y.real, -y.imag
    return out


def forward(blocks: np.ndarray) -> np.ndarray:
    """X[k] = 4/N sum x[n] cos(2 pi/N (n + 1/2 + N/4)(k + 1/2)) of each row, which is the
    cosine transform of the row's quarters folded onto half its length."""
    n = blocks.shape[1]
    q = n // 4
    half = np.empty((len(blocks), n // 2))
    half[:, :q] = -blocks[:, 3 * q - 1 : 2 * q - 1 : -1] - blocks[:, 3 * q :]
    half[:, q:] = blocks[:, :q] - blocks[:, 2 * q - 1 : q - 1 : -1]
    return 4 / n * dct4(half)


def inverse(spectra: np.ndarray) -> np.ndarray:
    """y[n] = sum X[k] cos(2 pi/N (n + 1/2 + N/4)(k + 1/2)) of each row; N is twice its length."""
    v = dct4(spectra)
    low, high = np.split(v, 2, axis=1)
    return np.concatenate((high, -high[:, ::-1], -low[:, ::-1], -low), axis=1)


@lru_cache(maxsize=64)
def window(n: int, left: int, right: int) -> np.ndarray:
    """Window of a block whose neighbours' sizes, cut to its own, are left and right."""
    i = np.arange(n)

    def slope(k, length):
        return np.sin(np.pi / 2 * np.sin((k + 0.5) / length * np.pi / 2) ** 2)

    up, down = i - (n // 4 - left // 4), i - (n * 3 // 4 - right // 4)
    rise = np.where(up < 0, 0.0, np.where(up < left // 2, slope(up, left / 2), 1.0))
    fall = np.where(down < 0, 1.0, np.where(down < right // 2, slope(right / 2 - 1 - down, right / 2), 0.0))
    return np.where(i < n // 2, rise, fall)


def overlapped(before: list[np.ndarray], blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The second half of each block before plus the first half of its block, aligned at
    their centres; pairs of the same sizes are added at once."""
    out: list[np.ndarray] = [np.zeros(0)] * len(blocks)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(before, blocks, strict=True)):
        kinds.setdefault((len(a), len(b)), []).append(i)
    for (p, n), own in kinds.items():
        shift, total = n // 4 - p // 4, p // 4 + n // 4
        y = np.zeros((len(own), total))
        tail = np.stack([before[i] for i in own])[:, p // 2 : p // 2 + total]
        y[:, : tail.shape[1]] += tail
        lo, hi = max(0, -shift), min(total, n - shift)
        y[:, lo:hi] += np.stack([blocks[i] for i in own])[:, lo + shift : hi + shift]
        for i, row in zip(own, y, strict=True):
            out[i] = row
    return out
