"""Suffix-array dedup (operator 10) on bytes, by a hash-compared suffix sort.

Which suffixes have to be sorted is settled by anchors: of each 50-byte window
the 18-byte string with the least hash, so equal windows have equal anchors.
Windows around an anchor that stands in several documents are suffixes of the
pieces of text that hold them. Equal ones have equal hashes of their 50 bytes, so
those whose hash only one document has cannot repeat and need no sort. The others
are sorted by merging, one of each hash; two suffixes are
compared through prefix polynomial hashes, with a binary search for the length
of their common start, so a comparison takes a logarithmic number of steps.
Suffixes that share 50 bytes are neighbours afterwards; the bytes of neighbours
are compared, and if a hash misled the sort the bucket is sorted by its bytes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import STEP, Anchors, covered, mixed, repeated_windows, starts_of, text_digests, without
from .substring import BASE, powers

WINDOW, GRAM = 50, 18
#: Starts of grams inside a window.
SPREAD = WINDOW - GRAM + 1
#: Bytes by which suffixes are put in order before the merges.
HEAD = 16
#: Powers that a worker keeps; longer texts make theirs anew.
KEPT_POWERS = 1 << 17
FIRST, SECOND = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


@lru_cache(maxsize=2)
def kept_powers(base: int) -> np.ndarray:
    return powers(base, KEPT_POWERS)


def powers_to(base: int, n: int) -> np.ndarray:
    return kept_powers(base)[:n] if n <= KEPT_POWERS else powers(base, n)


class PrefixHashes:
    """Polynomial hashes of all stretches of a buffer that lie within ``reach`` of a marked start of theirs; without marks it is one stretch."""

    def __init__(self, buf: np.ndarray, local: np.ndarray | None = None):
        reach = (len(buf) if local is None else int(local.max(initial=0))) + 2
        up = powers_to(BASE, reach)
        self.total = np.zeros(len(buf) + 1, np.uint64)
        value = buf.astype(np.uint64)
        value += np.uint64(1)
        value *= up[:len(buf)] if local is None else up[local]
        np.cumsum(value, out=self.total[1:])
        self.back = powers_to(inverse(BASE), reach)
        self.local = local

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.total[start + length] - self.total[start]) * self.back[start if self.local is None else self.local[start]]


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on: eight, the next eight, and the last eight of them, mixed one after another."""
    n = len(buf) - GRAM + 1
    words = np.ndarray((n + GRAM - 8,), "<u8", buf.tobytes(), strides=(1,)).astype(np.uint64)
    h = words[:n] * FIRST
    h ^= h >> np.uint64(32)
    h += words[8:n + 8]
    h *= SECOND
    h ^= h >> np.uint64(29)
    h += words[GRAM - 8:]
    return mixed(h) | np.uint64(1)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or largest of each run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:-rest], values[rest:]) if rest else values


class ByteWindows:
    window = WINDOW

    def anchors(self, buf: np.ndarray, off: np.ndarray) -> Anchors:
        n = len(buf) - WINDOW + 1
        h = gram_hashes(buf) if n > 0 else np.zeros(0, np.uint64)
        low = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # half of a hash tells grams of one window apart
        least = sliding(low, SPREAD, np.minimum) if n > 0 else np.zeros(0, np.uint32)
        over = (off[1:-1, None] - np.arange(1, WINDOW)).ravel()
        least[over[(over >= 0) & (over < n)]] = 0  # windows don't go over the end of a row
        if not least.any():
            none = np.zeros(0, np.int64)
            return Anchors(none, none, none.astype(np.uint64), none.astype(np.uint64), none, none, [])
        padded = np.zeros(n + 2 * (SPREAD - 1), np.uint32)
        padded[SPREAD - 1:SPREAD - 1 + n] = least
        spots = np.flatnonzero(sliding(padded, SPREAD, np.maximum) == low)
        # The anchor of a window is the first one at or behind its start with the window's hash. It changes with the hash, and behind itself.
        edge = np.ones(n, bool)
        np.not_equal(least[1:], least[:-1], out=edge[1:])
        edge[1:] |= least[:-1] == low[:n - 1]
        first = np.flatnonzero(edge)
        last, want = np.append(first[1:], n) - 1, least[first]
        first, last, want = (x[want != 0] for x in (first, last, want))
        owner = np.searchsorted(spots, first)
        off_by = np.flatnonzero(low[spots[owner]] != want)
        while len(off_by):
            owner[off_by] += 1
            off_by = off_by[low[spots[owner[off_by]]] != want[off_by]]
        spot = spots[owner]
        row = np.searchsorted(off, spot, side="right") - 1
        near, far = spot - last, spot - first
        span = mixed(PrefixHashes(buf).of(first, last + WINDOW - first) + mixed((near * 64 + far).astype(np.uint64)))
        return Anchors(row, spot - off[row], mixed(h[spot]), span, near, far, [buf, spot])

    def pieces(self, buf: np.ndarray, size: int):
        for first in range(0, max(len(buf) - WINDOW + 1, 1), size):
            yield first, min(first + size + WINDOW - 1, len(buf)), first

    def records(self, found: Anchors, at: np.ndarray) -> list[bytes]:
        """The bytes of all windows of each anchor."""
        buf, spot = found.data
        whole, place = buf.tobytes(), spot[at]
        return [whole[a:z] for a, z in zip((place - found.far[at]).tolist(), (place - found.near[at] + WINDOW).tolist())]

    def digests(self, found: Anchors, at: np.ndarray) -> np.ndarray:
        """A digest of those bytes and of where the anchor stands in them."""
        return text_digests(self.records(found, at), found.near[at], found.far[at])

    def removable(self, code, ids, near, far, data):
        """(entry, places back) of windows that an entry with a smaller id has too."""
        if not data:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        buf = np.frombuffer(b"".join(data), np.uint8)
        size = np.array([len(d) for d in data])
        begin = np.cumsum(size) - size
        count = far - near + 1
        entry = np.repeat(np.arange(len(data)), count)
        step = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
        start = begin[entry] + step
        local = np.arange(len(buf)) - np.repeat(begin, size)
        again = repeated(PrefixHashes(buf, local).of(start, WINDOW), ids[entry])
        if not len(again):
            return again, again
        entry, step, start = entry[again], step[again], start[again]
        order, group = sorted_suffixes(buf, local, start)
        owner = ids[entry[order]]
        edge = np.flatnonzero(starts_of(group))
        gone = owner > np.repeat(np.minimum.reduceat(owner, edge), np.diff(np.append(edge, len(owner))))
        return entry[order][gone], (far[entry] - step)[order][gone]


def repeated(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The places of values that several ids have."""
    order = np.argsort(h)
    edge = np.flatnonzero(starts_of(h[order]))
    least, most = (np.repeat(pick.reduceat(ids[order], edge), np.diff(np.append(edge, len(h)))) if len(h) else ids for pick in (np.minimum, np.maximum))
    return np.sort(order[least < most])


def sorted_suffixes(buf: np.ndarray, local: np.ndarray, start: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): suffixes in the order of their first ``length`` bytes, and a number for each run of equal ones."""
    hashes = PrefixHashes(buf, local)
    # Suffixes with the same hash stay together: one of them is sorted, the others follow it in their order.
    whole = hashes.of(start, length)
    alike = np.argsort(whole, kind="stable")
    edge = np.flatnonzero(starts_of(whole[alike]))
    size = np.diff(np.append(edge, len(alike)))
    sort = merge_sort(buf, hashes, start[alike[edge]], length)
    begin = np.cumsum(size[sort]) - size[sort]
    order = alike[np.repeat(edge[sort] - begin, size[sort]) + np.arange(len(alike))]
    same = whole[order[1:]] == whole[order[:-1]]
    if not verified(buf, start[order], same, length):
        rows = np.ascontiguousarray(buf[start[:, None] + np.arange(length)]).view(f"V{length}").ravel()
        order = np.argsort(rows, kind="stable")
        same = rows[order[1:]] == rows[order[:-1]]
    return order, np.cumsum(np.concatenate(([True], ~same)))


def verified(buf: np.ndarray, start: np.ndarray, same: np.ndarray, length: int) -> bool:
    """Whether neighbours have equal bytes where hashes say so, and stand in order where they do not. Eight bytes at a time."""
    words = eights(buf)
    open_ = np.ones(len(same), bool)
    for at in [*range(0, length - 8, 8), length - 8]:
        value = words[start + at].reshape(-1).view(">u8")
        less, more = value[:-1], value[1:]
        if (open_ & (less > more)).any():
            return False
        open_ &= less == more
    return bool((open_ == same).all())


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, without a copy of the buffer for each."""
    padded = np.append(buf, np.zeros(8, np.uint8))
    return np.lib.stride_tricks.as_strided(padded, (len(buf), 8), (1, 1))


def heads(buf: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """The first HEAD bytes of each suffix as big-endian numbers of 8 bytes."""
    words = eights(buf)
    return [words[start + i].reshape(-1).view(">u8").astype(np.uint64) for i in range(0, HEAD, 8)]


def before(buf: np.ndarray, hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, length: int, ties: np.ndarray) -> np.ndarray:
    """Whether suffix a sorts before suffix b; equal ones as ``ties`` says. Binary search over the common start."""
    low, high = np.full(len(a), HEAD), np.full(len(a), length)
    while True:
        open_ = low < high
        if not open_.any():
            break
        mid = (low + high + 1) // 2
        same = hashes.of(a, mid) == hashes.of(b, mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    end = low == length
    at = np.minimum(low, length - 1)
    return np.where(end, ties, buf[a + at] < buf[b + at])


def merge_sort(buf: np.ndarray, hashes: PrefixHashes, start: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes: by their first bytes, then runs with equal ones by merges of doubling width, all runs at once.

    In a merge each suffix moves behind those of the other half that sort
    before it; their number is found by binary search.
    """
    head = heads(buf, start)
    order = np.lexsort(head[::-1])
    edge = np.flatnonzero(starts_of(*(h[order] for h in head)))
    size = np.diff(np.append(edge, len(order)))
    base, room = np.repeat(edge, size), np.repeat(size, size)
    width = 1
    while True:
        at = np.flatnonzero(room > width)
        if not len(at):
            return order
        run, total = base[at], room[at]
        local = at - run
        block = local // (2 * width) * (2 * width)
        left = local - block < width
        middle = np.minimum(block + width, total)
        floor = np.where(left, middle, block)
        low, high = floor.copy(), np.where(left, np.minimum(block + 2 * width, total), middle)
        mine = start[order[at]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            other = start[order[run[open_] + mid]]
            # Equal suffixes keep their order: those of the left half come first.
            ahead = before(buf, hashes, other, mine[open_], length, ~left[open_])
            low[open_], high[open_] = np.where(ahead, mid + 1, low[open_]), np.where(ahead, high[open_], mid)
        moved = order.copy()
        moved[run + np.where(left, local, block + local - middle) + low - floor] = order[at]
        order = moved
        width *= 2


def without_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row; ``kept`` holds the bytes left.

    A byte goes if a 50-byte string that covers it also starts in a row with a
    smaller id. NULL and empty texts have no bytes. Rows without an id neither
    remove nor lose bytes, and rows of one id don't count against each other.
    ``key`` is a hash of the text, for joining rows that share an id.
    """
    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for key, text, runs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                data = (text or "").encode()
                gone = covered(runs, key, len(data), WINDOW)
                kept = b"".join(without(data, gone))
                for c, v in zip(cols, (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return repeated_windows(df, ByteWindows(), id_col, text_col).mapInArrow(
        run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The input's rows and columns with the repeated bytes cut out of the text; bytes of cut characters go too.

    ``length_col``, where there is one, becomes the length of the new text.
    Rows that lose everything stay, with an empty text. NULL texts stay NULL.
    """
    others = [c for c in df.columns if c not in (id_col, text_col, length_col)]
    found = repeated_windows(df, ByteWindows(), id_col, text_col, others)

    @F.pandas_udf("string")
    def cut(key: pd.Series, text: pd.Series, runs: pd.DataFrame) -> pd.Series:
        out = []
        for k, t, r in zip(key, text, runs.to_dict("records")):
            data = t.encode()
            out.append(b"".join(without(data, covered(r, k, len(data), WINDOW))).decode(errors="ignore"))
        return pd.Series(out, dtype=object)

    kinds = df.schema
    text = F.when(F.col("text").isNotNull() & F.col("runs").isNotNull(), cut("key", F.coalesce("text", F.lit("")), no_runs("runs"))).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    made = {id_col: F.col("id").cast(kinds[id_col].dataType), text_col: F.col("text"), length_col: F.length("text").cast("long")}
    return out.select(*[made[c].alias(c) if c in made else F.col(f"c_{others.index(c)}").alias(c) for c in df.columns])


def no_runs(column: str):
    """The runs, or none where there are NULLs."""
    empty = F.lit(b"")
    return F.struct(*[F.coalesce(F.col(f"{column}.{n}"), empty).alias(n) for n in ("keys", "c0", "c1")])
