"""Words and word shingles of whole texts as vectorised 64-bit hashes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Places in a word whose bytes have their values in a table.
_NEAR = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Alphabet:
    """Which bytes part words, and a random value for each other byte at each place of a word; A-Z count as a-z.

    A word's hash is the sum of its bytes' values. As they are drawn anew for every place, no words
    are built to collide, which powers of one multiplier modulo 2**64 don't prevent.
    """

    def __init__(self, separators: Sequence[int]):
        fold = np.arange(256)
        fold[65:91] += 32
        self.parts = np.zeros(256, dtype=bool)
        self.parts[list(separators)] = True
        self.values = mix64((fold.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
        self.near = np.concatenate([self.at(self.values, np.full(256, i)) for i in range(_NEAR)])

    @staticmethod
    def at(values: np.ndarray, place: np.ndarray) -> np.ndarray:
        return mix64(values + place.astype(np.uint64) * _GOLDEN)


#: Words of the contract: blank and the controls 9 to 13 part them.
BLANKS = Alphabet([32, *range(9, 14)])
#: Every ASCII byte but letters and digits parts words.
ALNUM = Alphabet([b for b in range(128) if not chr(b).isalnum()])


class Words:
    """The words of a run of texts: ``hashes`` in order; text i has those from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, texts: Sequence[str | None], alphabet: Alphabet = BLANKS):
        encoded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in encoded])]).astype(np.int64)
        del encoded
        parted = alphabet.parts[data]
        word = np.concatenate([[True], parted])
        starts = np.flatnonzero(word[:-1] & ~parted)
        ends = np.flatnonzero(~word[1:] & np.concatenate([parted[1:], [True]])) + 1
        self.data, self.begins, self.starts, self.ends = data, begins, starts, ends
        self.first = np.searchsorted(starts, begins)
        self.hashes = np.empty(len(starts), dtype=np.uint64)
        at = 0
        while at < len(starts):  # a quarter of a megabyte at a time
            stop = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 18))))
            base, end = starts[at], ends[stop - 1]
            s, e = starts[at:stop] - base, ends[at:stop] - base
            place = np.arange(end - base) - np.repeat(s, np.diff(s, append=end - base))
            own = data[base:end]
            value = alphabet.near[np.minimum(place, _NEAR - 1) * 256 + own]
            far = np.flatnonzero(place >= _NEAR)
            value[far] = alphabet.at(alphabet.values[own[far]], place[far])
            sums = np.zeros(end - base + 1, dtype=np.uint64)
            np.cumsum(value, out=sums[1:])
            self.hashes[at:stop] = mix64(sums[e] - sums[s] + (e - s).astype(np.uint64) * _GOLDEN)
            at = stop

    def __len__(self) -> int:
        return len(self.first) - 1

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``width`` words, in order, and their ``first``; fewer words are one shingle together."""
        counts = np.diff(self.first)
        many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        first = np.concatenate([[0], np.cumsum(many)])
        out = np.empty(first[-1], dtype=np.uint64)
        weights = mix64(np.arange(1, width + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
        if len(self.hashes) >= width:
            span = len(self.hashes) - width + 1
            total = np.zeros(span, dtype=np.uint64)
            for k in range(width):
                total += self.hashes[k : k + span] * weights[k]
            text = np.repeat(np.arange(len(self)), counts)[:span]
            at = np.arange(span) - self.first[:-1][text]
            whole = at <= counts[text] - width
            out[(first[:-1][text] + at)[whole]] = mix64(total[whole])
        for i in np.flatnonzero((counts > 0) & (counts < width)):
            own = self.hashes[self.first[i] : self.first[i + 1]]
            out[first[i]] = mix64(np.array([(own * weights[: len(own)]).sum() ^ np.uint64(len(own))], dtype=np.uint64))[0]
        return out, first


def set_id(tokens: np.ndarray) -> np.int64:
    """A 63-bit hash of a set of distinct 64-bit tokens, never negative."""
    total = mix64(tokens ^ _GOLDEN).sum(dtype=np.uint64, keepdims=True)
    return np.int64(mix64(total)[0] >> np.uint64(1))
