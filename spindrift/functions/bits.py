"""Bit fields, least significant bit first."""

from __future__ import annotations


class EndOfPacket(Exception):
    """A read went past the last bit; the reader stays at its end."""


#: Bytes that a reader and a writer hold as an integer, so that long packets cost no more per bit.
_SPAN = 256


class BitReader:
    """Reads a packet. Once past the end, every read fails, even of 0 bits."""

    def __init__(self, data: bytes):
        self.data, self.size, self.at, self.ended = data, 8 * len(data), 0, False
        self.base, self.value = 0, int.from_bytes(data[:_SPAN], "little")

    def remaining(self) -> int:
        return 0 if self.ended else self.size - self.at

    def peek(self, n: int) -> int:
        """The next n bits; what lies past the end is 0."""
        off = self.at - self.base
        if off + n > 8 * _SPAN:
            first = self.at >> 3
            self.base, self.value = first << 3, int.from_bytes(self.data[first : first + _SPAN], "little")
            off = self.at - self.base
        return self.value >> off & (1 << n) - 1

    def skip(self, n: int) -> None:
        if self.ended or self.at + n > self.size:
            self.ended = True
            raise EndOfPacket
        self.at += n

    def read(self, n: int) -> int:
        if self.ended or self.at + n > self.size:
            self.ended = True
            raise EndOfPacket
        out = self.peek(n)
        self.at += n
        return out

    def flag(self) -> bool:
        return self.read(1) == 1


class BitWriter:
    def __init__(self):
        self.done, self.value, self.size = bytearray(), 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= (value & (1 << n) - 1) << self.size
        self.size += n
        if self.size >= 8 * _SPAN:
            whole = self.size >> 3
            self.done += (self.value & (1 << 8 * whole) - 1).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.size &= 7

    def codeword(self, code: int, n: int) -> None:
        """A Huffman codeword, its first bit first."""
        self.write(int(f"{code:0{n}b}"[::-1], 2) if n else 0, n)

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.size + 7) // 8, "little")


def ilog(x: int) -> int:
    return x.bit_length() if x > 0 else 0
