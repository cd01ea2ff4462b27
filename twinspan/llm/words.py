"""Words of a text: runs of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """The words as UTF-8; splitting bytes breaks at exactly these six characters. Null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_array(text: Column) -> Column:
    """The words as an array of strings; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words, as long: breaks with a word behind them, counted without building the words.

    Each break is turned into one space, then all but the spaces is taken away.
    """
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BREAK, " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """`run`, after which a task gives the memory it has freed back to the system: the worker lives on and others need it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim:
            trim(0)

    return tidied


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[ord("A") : ord("Z") + 1] += 32
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_KIND = np.arange(256)  # of characters: small letters and all beyond ASCII, capitals, digits, others as they are
_KIND[ord("a") : ord("z") + 1] = _KIND[128:] = ord("a")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("0") : ord("9") + 1] = ord("0")
_RUNS = np.isin(np.arange(256), [ord("a"), ord("A"), ord("0")])
_P = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at a time, but for words and texts that are longer.
SLICE = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit (the finaliser of a public 64-bit hash)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _polynomials(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each run of `values` that starts at `at`, the sum of its values times powers of an odd number."""
    lengths = np.diff(np.append(at, len(values)))
    place = np.arange(len(values)) - np.repeat(at, lengths)
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(lengths.max()), _P, np.uint64))))
    return mixed(np.add.reduceat(values * power[place], at) + lengths.astype(np.uint64) * _P)


def _hashed(raw: np.ndarray, ends: np.ndarray, shapes: bool, stems: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    word = ~_SPACE[raw]
    first = word.copy()
    new = ~word[:-1]
    new[ends[(ends > 0) & (ends < len(raw))] - 1] = True
    first[1:] &= new
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (1 + shapes + len(stems)), np.zeros(len(ends), np.int64)
    letters = raw[word]
    at = np.flatnonzero(first[word])
    values = _VALUE[_FOLD[letters]]
    found = [_polynomials(values, at)]
    if shapes:
        kind = _KIND[letters]
        keep = np.ones(len(kind), bool)
        keep[1:] = (kind[1:] != kind[:-1]) | ~_RUNS[kind[1:]]
        keep[at] = True
        found.append(_polynomials(_VALUE[kind[keep]], (np.cumsum(keep) - 1)[at]))
    if stems:
        lengths = np.diff(np.append(at, len(letters)))
        place = np.arange(len(letters)) - np.repeat(at, lengths)
    for n in stems:
        keep = place < n
        found.append(_polynomials(values[keep], (np.cumsum(keep) - 1)[at]) ^ np.uint64(n))
    return found, np.searchsorted(starts, ends)


def hashed_words(texts: pa.Array, shapes: bool = False, stems: tuple[int, ...] = ()) -> list[list[np.ndarray]]:
    """Of each text, the 64-bit hashes of its words with A-Z in lower case; then, if asked for, of their
    shapes, and of the first so many bytes of each word for each number in `stems`.

    A shape has one sign for each run of small letters (all beyond ASCII among them), of capitals and of
    digits, and other characters as they are. Works on the bytes of many texts at once, in slices of
    bounded size; null and empty texts have no words.
    """
    out: list[list[np.ndarray]] = [[] for _ in range(1 + shapes + len(stems))]
    group, size = [], 0

    def flush() -> None:
        nonlocal size
        raw = np.frombuffer(b"".join(group), np.uint8)
        ends = np.cumsum([len(x) for x in group])
        found, upto = _hashed(raw, ends, shapes, stems)
        for mine, all_of in zip(out, found, strict=True):
            mine.extend(all_of[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True))
        group.clear()
        size = 0

    for x in texts.cast(pa.large_binary()).to_pylist():
        group.append(x or b"")
        size += len(group[-1])
        if size >= SLICE:
            flush()
    if group:
        flush()
    return out
