"""Words, shingles and hashes of many texts at once, over one byte array."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
#: Inverse of BASE modulo 2**64.
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts of about so many bytes are handled together; longer ones piece by piece.
CHUNK = 1 << 19
GAP = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def salts(n: int, seed: int) -> np.ndarray:
    """n odd constants."""
    return mix(np.arange(1, n + 1, dtype=U) * BASE + U(seed)) | U(1)


class Powers:
    """Powers of BASE and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U)
        self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, CHUNK + 1)
            self.up, self.down = np.full(size, BASE, dtype=U), np.full(size, BASE_INV, dtype=U)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)


def prefix_hash(data: np.ndarray, powers: Powers) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * BASE**position over [i, j)."""
    powers.upto(len(data))
    out = np.zeros(len(data) + 1, dtype=U)
    terms = data.astype(U)
    terms += U(1)
    terms *= powers.up[: len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the byte spans [start, end), wherever they stand."""
    return mix((h[ends] - h[starts]) * powers.down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def chunks(texts: list[bytes], size: int = CHUNK):
    """Slices (from, to) of `texts` of about `size` bytes, one text at least."""
    at = total = 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > size:
            yield at, i
            at, total = i, 0
        total += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def pieces(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """A text cut at white space into pieces of about `size` bytes; a longer word stays whole."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


class Words:
    """The words of some texts: their hashes, and the number of the first word of each text (`first`, one more at the end).

    Only a piece of some CHUNK of bytes is spread out at a time, so a very long text costs 8 bytes a word.
    """

    def __init__(self, texts: list[bytes], powers: Powers, lower: bool = False) -> None:
        if sum(map(len, texts)) <= 2 * CHUNK:
            starts, self.hashes = self._hashed(b"\n".join(texts) + b"\n", powers, lower)
            lens = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
            self.first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lens)]))
            return
        parts = [[self._hashed(p + b"\n", powers, lower)[1] for p in pieces(t)] for t in texts]
        self.hashes = np.concatenate([np.empty(0, dtype=U), *(h for part in parts for h in part)])
        self.first = np.cumsum([0, *(sum(map(len, part)) for part in parts)])

    @staticmethod
    def _hashed(blob: bytes, powers: Powers, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(blob, dtype=np.uint8)
        if lower:
            data = LOWER[data]
        space = SPACE[data]
        edge = np.empty(len(data), dtype=bool)
        edge[0] = not space[0]
        np.not_equal(space[1:], space[:-1], out=edge[1:])
        at = np.flatnonzero(edge)
        return at[0::2], span_hash(prefix_hash(data, powers), at[0::2], at[1::2], powers)


def as_bytes(text) -> bytes:
    """UTF-8 of a text; null has none."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
