"""Substring dedup (operator 7) with difference-cover anchors, on words.

Anchors are runs of seven words that start at word numbers 0, 1 or 3 modulo 7.
Every difference modulo 7 is one between two of these, so two equal windows of
13 words, wherever they start, hold an equal anchor at the same place inside
them: anchors at covered places alone find every match. From a common anchor
the comparison extends to all seven windows around it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES
from .passages import STEP, Anchors, covered, mixed, repeated_windows, starts_of, text_digests, without

PERIOD, COVER, ANCHOR, WINDOW = 7, (0, 1, 3), 7, 13
#: Odd, so that powers have inverses modulo 2**64.
BASE = 0x5851F42D4C957F2D
SPACE = np.zeros(256, bool)
SPACE[list(SPACES)] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, number in the row, hash, first byte, end) of all words. No word goes over the end of its row."""
    solid = ~SPACE[buf]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = off[1:-1][off[1:-1] < len(buf)]
    begin[inner] = solid[inner]
    start = np.flatnonzero(begin)
    if not len(start):
        return start, start, start.astype(np.uint64), start, start
    word = np.cumsum(begin) - 1
    at = np.flatnonzero(solid)
    local = at - start[word[at]]
    value = (buf[at].astype(np.uint64) + np.uint64(1)) * powers(BASE, int(local.max()) + 1)[local]
    edge = np.flatnonzero(local == 0)
    size = np.diff(np.append(edge, len(at)))
    h = mixed(np.add.reduceat(value, edge) + size.astype(np.uint64) * STEP)
    row = np.searchsorted(off, start, side="right") - 1
    first = np.flatnonzero(starts_of(row))
    return row, np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))), h, start, start + size


class WordWindows:
    window = WINDOW

    def anchors(self, buf: np.ndarray, off: np.ndarray) -> Anchors:
        row, number, h, start, end = word_hashes(buf, off)
        count = len(h) - WINDOW + 1
        if count <= 0:
            none = np.zeros(0, np.int64)
            return Anchors(none, none, none.astype(np.uint64), none.astype(np.uint64), none, none, ())
        factor = powers(BASE, WINDOW)
        seven = sum(h[i:len(h) - ANCHOR + 1 + i] * factor[i] for i in range(ANCHOR))
        whole = mixed(sum(h[i:count + i] * factor[i] for i in range(WINDOW)))
        whole[row[:count] != row[WINDOW - 1:]] = 0  # windows don't go over the end of a row
        place = np.flatnonzero(np.isin(number[:len(seven)] % PERIOD, COVER) & (row[:len(seven)] == row[ANCHOR - 1:]))
        around = np.zeros((len(place), WINDOW - ANCHOR + 1), np.uint64)
        for back in range(around.shape[1]):
            at = place - back
            good = (at >= 0) & (at < count) & (row[np.maximum(at, 0)] == row[place])
            around[good, back] = whole[at[good]]
        some = (around != 0).any(axis=1)
        place, around = place[some], around[some]
        there = around != 0
        near, far = there.argmax(axis=1), around.shape[1] - 1 - there[:, ::-1].argmax(axis=1)
        span = mixed((around * powers(int(STEP), around.shape[1])).sum(axis=1, dtype=np.uint64) + near.astype(np.uint64) * np.uint64(8) + far.astype(np.uint64))
        return Anchors(row[place], number[place], mixed(seven[place]), span, near, far, (buf, start, end, place))

    def pieces(self, buf: np.ndarray, size: int):
        """Pieces start at every so many words, a multiple of the period, so anchors stand where they do in the whole text."""
        solid = ~SPACE[buf]
        solid[1:] &= ~solid[:-1].copy()
        start = np.flatnonzero(solid)
        step = max(size * len(start) // max(len(buf), 1) // PERIOD, 1) * PERIOD
        for first in range(0, max(len(start) - WINDOW + 1, 1), step):
            last = first + step + WINDOW - 1
            yield int(start[first]) if len(start) else 0, int(start[last]) if last < len(start) else len(buf), first

    def records(self, found: Anchors, at: np.ndarray) -> list[bytes]:
        """The words of all windows of each anchor, joined by one space."""
        buf, start, end, place = found.data
        whole, first, last = buf.tobytes(), start[place[at] - found.far[at]], end[place[at] - found.near[at] + WINDOW - 1]
        return [b" ".join(whole[a:z].split()) for a, z in zip(first.tolist(), last.tolist())]

    def digests(self, found: Anchors, at: np.ndarray) -> np.ndarray:
        return text_digests(self.records(found, at), found.near[at], found.far[at])

    def removable(self, code, ids, near, far, data):
        """(entry, places back) of windows whose words an entry of the same anchor with a smaller id has too."""
        least: dict[tuple[int, bytes], int] = {}
        windows = []
        for at, (anchor, owner, back, text) in enumerate(zip(code.tolist(), ids.tolist(), far.tolist(), data)):
            words = text.split(b" ")
            for i in range(len(words) - WINDOW + 1):
                key = (anchor, b" ".join(words[i:i + WINDOW]))
                windows.append((at, back - i, owner, key))
                if owner < least.get(key, owner + 1):
                    least[key] = owner
        gone = [(at, back) for at, back, owner, key in windows if owner > least[key]]
        return np.array([g[0] for g in gone], np.int64), np.array([g[1] for g in gone], np.int64)


def without_repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row; ``texts`` adds ``kept``, the words left, joined by one space.

    A word goes if a window of 13 words that covers it also starts in a row
    with a smaller id. NULL and empty texts have no words. Rows without an id
    neither remove nor lose words, and rows of one id don't count against each
    other. Other columns are ignored.
    """
    def run(batches):
        for batch in batches:
            total, removed, digest, left = [], [], [], []
            for key, text, runs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words = (text or "").encode().split()
                gone = covered(runs, key, len(words), WINDOW)
                kept = b" ".join([w for part in without(words, gone) for w in part])
                removed.append(sum(z - a for a, z in gone))
                total.append(len(words))
                digest.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    left.append(kept.decode())
            arrays = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(left, pa.string())] if texts else []), ["id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts)

    found = repeated_windows(df, WordWindows(), id_col, text_col)
    return found.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts).withColumnRenamed("id", id_col)
