"""Texts to token ids by way of their distinct pieces, over whole batches in numpy and Arrow."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .shared import SPACE_BYTES, word_spans


_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True


def script_cuts(data: np.ndarray) -> np.ndarray:
    """For each byte, whether a pre-tokenizer surely begins a piece there: a letter of ASCII or Latin-1 and an ASCII mark
    other than the apostrophe meet."""
    letter, mark = _LETTERS[data], _MARKS[data]
    latin, cut = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut[1:] = ((letter | latin)[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    return cut


def spaced_starts(data: np.ndarray) -> np.ndarray:
    """Starts of the units of one text, which together cover it: a run without ASCII white space with the one blank
    before it, cut where letters and marks meet, and what else there is of white space. White space before a run leaves its last character to itself, or to
    the run if it is a blank; white space at the end stays whole.
    """
    starts, ends = word_spans(data)
    n = len(data)
    blank = np.zeros(len(starts), dtype=bool)
    inner = starts > 0
    blank[inner] = data[starts[inner] - 1] == 32
    before = np.concatenate(([0], ends[:-1])) if len(starts) else np.zeros(0, np.int64)
    gap = starts - before
    parts = [starts - blank, np.flatnonzero(script_cuts(data)), before[(gap >= 2) | ((gap == 1) & ~blank)], starts[(gap >= 2) & ~blank] - 1]
    tail = int(ends[-1]) if len(ends) else 0
    if tail < n:
        parts.append(np.array([tail]))
    out = np.sort(np.concatenate(parts)).astype(np.int64)
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


def binary_array(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The spans from each start to the next (the last to the end of data) as an Arrow array without copying."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def gather(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[b : b + n] for every b and n, one after the other."""
    heads = np.cumsum(lengths) - lengths
    return flat[np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(begins - heads, lengths)]


class Cache:
    """ids (as int32 bytes) of pieces already met, in two generations of at most `most` pieces and about `most_bytes`:
    what was not asked for during a whole generation goes. Pieces over LONG bytes aren't kept."""

    LONG = 1024

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], most: int = 100_000, most_bytes: int = 16 << 20):
        self.encode, self.most, self.most_bytes, self.young, self.old, self.held = encode, most, most_bytes, {}, {}, 0

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        out = list(map(self.young.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        if not missing:
            return out
        found = [self.old.get(pieces[i]) for i in missing]
        unknown = [i for i, x in zip(missing, found, strict=True) if x is None]
        for i, x in zip(missing, found, strict=True):
            out[i] = x
        for at in range(0, len(unknown), 4096):
            part = unknown[at : at + 4096]
            for i, x in zip(part, self.encode([pieces[i] for i in part]), strict=True):
                out[i] = x
        kept = [i for i in missing if len(pieces[i]) <= self.LONG]
        size = sum(len(pieces[i]) + len(out[i]) for i in kept)
        if len(self.young) + len(kept) > self.most or self.held + size > self.most_bytes:
            self.old, self.young, self.held = self.young, {}, 0
        self.young.update((pieces[i], out[i]) for i in kept)
        self.held += size
        return out


def ids_of_spans(spans: pa.Array, ids: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all spans in one array, and how many each span has. Each distinct span is encoded once."""
    if not len(spans):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    coded = spans.dictionary_encode()
    made = ids(coded.dictionary.to_pylist())
    lengths = np.fromiter(map(len, made), np.int64, len(made)) // 4
    flat = np.frombuffer(b"".join(made), np.int32)
    at = coded.indices.to_numpy()
    return gather(flat, (np.cumsum(lengths) - lengths)[at], lengths[at]), lengths[at]
