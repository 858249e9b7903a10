"""Whole columns of text as numpy arrays of code points.

Every stage that has to look at each character works on a flat array of code
points with row offsets, so that folding, splitting and hashing cost a few
nanoseconds a character instead of a Python call.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters of other alphabets that look like a Latin letter.
LOOKALIKE = dict(
    zip(
        "АВЕКМНОРСТУХІЈЅԚԜ" "аеорсухіјѕһӏԛԝԁѵк" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "οναικρυχγ",
        "ABEKMHOPCTYXIJSQW" "aeopcyxijshlqwdvk" "ABEZHIKMNOPTYX" "ovaikpuxy",
        strict=True,
    )
)

_SIZE = 0x110000
_UNKNOWN = -2
_MANY = -1
CHUNK_CHARS = 1_500_000


class _Lazy:
    """A table over all code points, filled for those that occur."""

    def __init__(self, dtype, of):
        self.table = np.full(_SIZE, _UNKNOWN, dtype=dtype)
        self.of = of

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = self.table.take(codes)
        if len(out) and out.min() == _UNKNOWN:
            for c in np.unique(codes[out == _UNKNOWN]):
                self.table[c] = self.of(int(c))
            out = self.table.take(codes)
        return out


def fold_char(c: str) -> str:
    """A character without case, accents, compatibility form and alphabet of look-alikes; invisible ones vanish."""
    out = []
    for x in unicodedata.normalize("NFKD", c):
        for y in unicodedata.normalize("NFKD", LOOKALIKE.get(x, x).casefold()):
            y = LOOKALIKE.get(y, y)
            if unicodedata.category(y) not in ("Mn", "Me", "Cf"):
                out.append(y)
    return "".join(out)


_many: dict[int, str] = {}


def _fold_code(c: int) -> int:
    if 0xD800 <= c < 0xE000:
        return 0x20
    s = fold_char(chr(c))
    if len(s) > 1:
        _many[c] = s
        return _MANY
    return ord(s) if s else 0


_fold = _Lazy(np.int32, _fold_code)
#: 1 letter, 2 digit, 0 else (of folded characters)
_kind = _Lazy(np.int8, lambda c: 1 if (k := unicodedata.category(chr(c))[0]) == "L" else 2 if k == "N" else 0)


def fold_text(s: str) -> str:
    """``fold_char`` over a string."""
    return "".join(map(fold_char, s))


def codes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings of an array in a row, and the offsets (one more than rows); nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    if len(array) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    at = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(array.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(codes) == len(raw):
        return codes, at
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return codes, starts[at]


def chunks(array: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each, to bound memory."""
    if len(array) == 0:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(array), 0), np.int64) + 1)
    begin = 0
    while begin < len(array):
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield begin, end
        begin = end


def fold_codes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points and their offsets."""
    f = _fold(codes)
    if len(f) == 0 or (least := f.min()) > 0:
        return f, offsets
    if least == _MANY:
        n = np.ones(len(f), np.int64)
        where = np.flatnonzero(f == _MANY)
        texts = [_many[int(c)] for c in codes[where]]
        n[where] = [len(t) for t in texts]
        first = np.concatenate([[0], np.cumsum(n)])
        g = np.repeat(f, n)
        for w, t in zip(where, texts):
            g[first[w] : first[w] + len(t)] = [ord(x) for x in t]
        f, offsets = g, first[offsets]
    dropped = np.flatnonzero(f == 0)
    if len(dropped) == 0:
        return f, offsets
    return f[f > 0], offsets - np.searchsorted(dropped, offsets)


def kinds(folded: np.ndarray) -> np.ndarray:
    return _kind(folded)


_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(0xD6E8FEB86659FD93))]).cumprod(dtype=np.uint64)
    return _powers


def run_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``values[start:start+length]``; runs are in order, do not overlap, and are not empty."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    total = int(lengths.sum())
    if total == len(values) and starts[0] == 0:
        v, first = values, starts
    else:
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        v = values[np.repeat(starts - first, lengths) + np.arange(total)]
    pos = np.arange(total) - np.repeat(first, lengths)
    power = _power(int(lengths.max()))
    with np.errstate(over="ignore"):
        h = np.add.reduceat(mix(v.astype(np.uint64) + _P) * power[pos], first)
        return mix(h + lengths.astype(np.uint64) * _P)


_noise = np.zeros(_SIZE, np.uint64)
_noise_known = np.zeros(_SIZE, bool)


def char_noise(folded: np.ndarray) -> np.ndarray:
    """A random-looking odd number for each letter or digit, 0 for all else."""
    known = _noise_known.take(folded)
    if not known.all():
        new = np.unique(folded[~known])
        _noise[new] = np.where(kinds(new) > 0, mix(new.astype(np.uint64) + _P) | np.uint64(1), np.uint64(0))
        _noise_known[new] = True
    return _noise.take(folded)


def words_of(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits: hash, row, start and length (in ``folded``)."""
    noise = char_noise(folded)
    is_word = noise != 0
    if not is_word.any():
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1]
    cut = offsets[:-1][offsets[:-1] < len(folded)]
    begin[cut] |= is_word[cut]
    starts = np.flatnonzero(begin)
    span = np.diff(starts, append=len(folded))
    pos = np.arange(starts[0], len(folded)) - np.repeat(starts, span)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(noise[starts[0] :] * _power(int(span.max())).take(pos), starts - starts[0])
        lengths = np.add.reduceat(is_word[starts[0] :], starts - starts[0], dtype=np.int64)
        h = mix(h + lengths.astype(np.uint64) * _P)
    return h, np.searchsorted(offsets, starts, side="right") - 1, starts, lengths


def shingle_hashes(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a row, and their rows. A row of fewer words gives one run of all of them."""
    if len(words) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        m = max(0, len(words) - n + 1)
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9FB21C651E98DF25) + words[k : k + m]
        whole = row[:m] == row[n - 1 :] if m else np.zeros(0, bool)
        h, r = mix(h[whole]), row[:m][whole]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    count = np.diff(np.concatenate([first, [len(row)]]))
    short = count < n
    if short.any():
        hs = run_hashes(words, first, count)[short]
        h, r = np.concatenate([h, hs]), np.concatenate([r, row[first][short]])
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r
