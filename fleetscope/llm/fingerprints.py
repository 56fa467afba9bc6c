"""Document fingerprints (operator 13): SimHash over weighted terms, and permuted block tables for the search.

The terms of a text are its words and pairs of adjacent words. Each occurrence
votes with the number of bytes of its term: for a bit that the term's hash has
set, against it otherwise. The fingerprint has the bits that won.

Fingerprints within ``radius`` of each other agree in at least
``blocks - radius`` of ``blocks`` blocks of their bits. There is a table for
each choice of so many blocks; its key is the fingerprint with the chosen blocks
moved to the front and the rest cut off. Rows that meet under a key are compared
in blocks of bounded size, however many there are, and a pair counts only in the
first table in which it meets, so nothing is counted twice and nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, saved, shuffle_parts
from .ranges import borders, with_part

BITS, RADIUS, BLOCKS = 64, 3, 6
#: Bytes of text that are hashed together; a longer text is taken in pieces of this size, cut at white space.
CHUNK = 1 << 20
#: Rows of one key that a task compares with as many others, rows compared at a time, and rows of a run that is compared by shifts.
RUN, TILE, SMALL = 1 << 14, 1 << 11, 64
#: Documents compared with their next ones at a time.
ROWS = 256
BASE, MIX, PAIR = 0x100000001B3, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Votes are added in lanes of 16 bits: so many of at most 63 fit.
HEAVIEST, LANES, TOGETHER = 63, np.uint64(0x0001000100010001), 1024

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@cache
def powers(count: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2^64, and those of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(count, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(27))) * PAIR
    return x ^ (x >> np.uint64(33))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, length and hash of each word of texts that lie end to end; ASCII letters count as lower-case."""
    inside = ~IS_SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = off[:-1][np.diff(off) > 0]
    first[at] = inside[at]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = off[1:][np.diff(off) > 0] - 1
    last[at] = inside[at]
    end = np.flatnonzero(last) + 1
    size = 1 << max(len(buf) - 1, 1).bit_length()
    up, down = powers(size)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((LOWER[buf].astype(np.uint64) + np.uint64(1)) * up[:len(buf)], out=total[1:])
    length = (end - start).astype(np.uint64)
    h = mixed((total[end] - total[start]) * down[start] + length * MIX)
    return np.searchsorted(off, start, side="right") - 1, length, h


def votes(row: np.ndarray, weight: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Votes for each bit and votes in all, for each row; rows ascend."""
    out, whole = np.zeros((rows, BITS), np.int64), np.bincount(row, weight, rows).astype(np.int64)
    if len(row):
        fresh = np.ones(len(row), bool)
        fresh[1:] = row[1:] != row[:-1]
        begin = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        edge = np.flatnonzero((np.arange(len(row)) - begin[run]) % TOGETHER == 0)
        owner = row[edge]
        for k in range(16):
            lanes = np.add.reduceat(((h >> np.uint64(k)) & LANES) * weight.astype(np.uint64), edge)
            np.add.at(out, (owner[:, None], np.arange(k, BITS, 16)[None, :]), lanes.view(np.uint16).reshape(-1, 4).astype(np.int64))
    return out, whole


def term_votes(buf: np.ndarray, off: np.ndarray, lead: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Votes of the words and pairs of each text. With ``lead``, the first word of all only starts a pair."""
    row, length, h = words(buf, off)
    same = row[1:] == row[:-1]
    pair = mixed(h[:-1] * PAIR + h[1:])[same]
    weight = np.minimum(length, HEAVIEST)
    both = np.minimum(length[:-1] + length[1:] + np.uint64(1), HEAVIEST)[same]
    rows = len(off) - 1
    skip = int(lead)
    once, whole = votes(row[skip:], weight[skip:], h[skip:], rows)
    twice, more = votes(row[:-1][same], both, pair, rows)
    return once + twice, whole + more


def won(for_bit: np.ndarray, whole: np.ndarray) -> np.ndarray:
    bits = (2 * for_bit > whole[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def long_fingerprint(data: bytes) -> int:
    """The fingerprint of a text of any length, in pieces: each is led by the word that ended the one before."""
    for_bit, whole, at, lead = np.zeros((1, BITS), np.int64), np.zeros(1, np.int64), 0, b""
    while at < len(data):
        stop = min(at + CHUNK, len(data))
        while stop < len(data) and not IS_SPACE[data[stop]]:
            stop += 1
        raw = lead + b" " + data[at:stop] if lead else data[at:stop]
        piece = np.frombuffer(raw, np.uint8)
        more, n = term_votes(piece, np.array([0, len(piece)]), bool(lead))
        for_bit, whole, at = for_bit + more, whole + n, stop
        inside = np.flatnonzero(~IS_SPACE[piece])
        if len(inside):
            gaps = np.flatnonzero(IS_SPACE[piece[:inside[-1]]])
            lead = raw[gaps[-1] + 1 if len(gaps) else 0:inside[-1] + 1]
    return int(won(for_bit, whole)[0])


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of whole texts; 0 without a word."""
    out, held, size, where = np.zeros(len(texts), np.uint64), [], 0, []

    def flush() -> None:
        buf = np.frombuffer(b"".join(held), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(t) for t in held]))).astype(np.int64)
        out[where] = won(*term_votes(buf, off))

    for i, text in enumerate(texts):
        if len(text) > CHUNK:
            out[i] = long_fingerprint(text)
            continue
        if size + len(text) > CHUNK and held:
            flush()
            held, size, where = [], 0, []
        held.append(text)
        where.append(i)
        size += len(text)
    if size:
        flush()
    return out


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by as much of the next one's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of bits in which fingerprints agree."""
    return 1.0 - np.bitwise_count(a ^ b) / BITS


RESULT = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.int64()),
                    ("edited_fp", pa.int64()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
RESULT_SQL = "id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"


def compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the one that follows it. Rows are (part, tail, id, text) in order; a part's tail is the next part's first row."""
    held: tuple | None = None
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part, tail, ids, texts = (c.to_pylist() for c in batch.slice(begin, ROWS).columns)
            texts = [t or "" for t in texts]
            fps = fingerprints([t.encode() for t in texts])
            if held:
                part, tail, ids, texts = ([h, *c] for h, c in zip(held, (part, tail, ids, texts)))
                fps = np.concatenate((np.array([held[4]], np.uint64), fps))
            at = [i for i in range(len(part) - 1) if part[i] == part[i + 1] and not tail[i]]
            made = [edited(texts[i], texts[i + 1]) for i in at]
            raw = [t.encode() for t in made]
            changed, own, other = fingerprints(raw), fps[at], fps[[i + 1 for i in at]]
            held = (part[-1], tail[-1], ids[-1], texts[-1], fps[-1])
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()), pa.array(own.view(np.int64)),
                pa.array(changed.view(np.int64)), pa.array(likeness(own, changed)), pa.array(likeness(own, other))], schema=RESULT)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and the next document, by ascending id (RESULT's columns).

    Texts are shuffled once, in parts of the order; the first row of a part
    also goes to the part before it, as what follows its last row.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("order", F.xxhash64("text"))
    parts = shuffle_parts(df.sparkSession)
    edges = borders(docs, ["id", "order"], parts)
    parts = max(len(edges), 1)
    placed = with_part(docs, ["id", "order"], edges, "part", "head")
    place = F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))
    before = F.struct(F.pmod(F.col("part") - 1, F.lit(parts)).alias("part"), F.lit(True).alias("tail"))
    dealt = placed.withColumn("at", F.explode(F.when(F.col("head"), F.array(place, before)).otherwise(F.array(place))))
    rows = dealt.select("at.part", "at.tail", "id", "order", "text").repartitionById(parts, F.col("part"))
    return rows.sortWithinPartitions("part", "tail", F.asc_nulls_first("id"), "order", "text").select(
        "part", "tail", "id", "text").mapInArrow(compare_neighbours, RESULT_SQL)


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """The bits that each table's key takes: ``blocks - radius`` blocks of them."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Near:
    """Counts, for rows of equal keys, how many others stand close; a pair counts in the first table that has it."""

    def __init__(self, table: np.ndarray, fp: np.ndarray, many: np.ndarray, masks: list[int], radius: int):
        self.table, self.fp, self.many, self.masks, self.radius = table, fp, many, masks, radius
        self.found = np.zeros(len(fp), np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        differ = self.fp[i] ^ self.fp[j]
        fresh = np.bitwise_count(differ) <= self.radius
        i, j, differ = i[fresh], j[fresh], differ[fresh]
        fresh = np.ones(len(i), bool)
        for t, mask in enumerate(self.masks):
            fresh &= (self.table[i] <= t) | ((differ & np.uint64(mask)) != 0)
        np.add.at(self.found, i[fresh], self.many[j[fresh]])
        np.add.at(self.found, j[fresh], self.many[i[fresh]])

    def shifts(self, run: np.ndarray, at: np.ndarray, most: int) -> None:
        """All pairs inside short runs: each row with the one d places on."""
        for d in range(1, most):
            same = run[at[:-d]] == run[at[d:]]
            self.add(at[:-d][same], at[d:][same])

    def tiles(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        """All pairs of two sets of rows, or within one."""
        for x in range(0, len(left), TILE):
            for y in range(x if same else 0, len(right), TILE):
                i, j = left[x:x + TILE], right[y:y + TILE]
                a, b = np.nonzero(np.bitwise_count(self.fp[i][:, None] ^ self.fp[j][None, :]) <= self.radius)
                keep = a < b if same and x == y else slice(None)
                self.add(i[a[keep]], j[b[keep]])


def near_in_runs(batches: Iterator[pa.RecordBatch], masks: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    """(fp, near) for the rows of each run of equal (table, key, a, b); runs come sorted and may go over batches."""
    held: list[np.ndarray] | None = None

    def out(cols: list[np.ndarray]) -> pa.RecordBatch:
        table, _, a, b, own, fp, many = cols
        fresh = np.zeros(len(fp), bool)
        fresh[0] = True
        for c in cols[:4]:
            fresh[1:] |= c[1:] != c[:-1]
        run, edges = np.cumsum(fresh) - 1, np.append(np.flatnonzero(fresh), len(fp))
        size, near = np.diff(edges), Near(table, fp.view(np.uint64), many, masks, radius)
        short = (size > 1) & (size <= SMALL) & (a[edges[:-1]] == b[edges[:-1]])
        if short.any():
            near.shifts(run, np.flatnonzero(short[run]), int(size[short].max()))
        for s in np.flatnonzero((size > 1) & ~short):
            at = np.arange(edges[s], edges[s + 1])
            if a[at[0]] == b[at[0]]:
                near.tiles(at, at, True)
            else:
                near.tiles(at[own[at] == a[at]], at[own[at] == b[at]], False)
        hit = near.found > 0
        return pa.RecordBatch.from_arrays([pa.array(fp[hit]), pa.array(near.found[hit])], ["fp", "near"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(p) for p in zip(held, cols)] if held else cols
        if not len(held[0]):
            continue
        last = np.ones(len(held[0]), bool)
        for c in held[:4]:
            last &= c == c[-1]
        cut = int(len(last) - last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield out([c[:cut] for c in held])
            held = [c[cut:] for c in held]
    if held and len(held[0]):
        yield out(held)


def near_counts(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, run: int = RUN) -> DataFrame:
    """(fp, near): how many of ``many`` stand at other fingerprints within ``radius``; rows without any are left out.

    ``nodes`` holds distinct (fp, many). A key with more than ``run`` rows is
    cut into groups by hash, and each two groups meet in a task of their own.
    """
    masks = block_masks(blocks, radius)
    keyed = nodes.select("fp", "many", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("table", "key"))
    crowded = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > run).select(
        "table", "key", F.ceil(F.col("n") / run).cast("int").alias("groups"))
    spread = keyed.join(crowded, ["table", "key"], "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("groups")).cast("int")
    met = spread.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    rows = met.select("table", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp", "many")
    found = (rows.repartition("table", "key", "a", "b").sortWithinPartitions("table", "key", "a", "b")
                 .mapInArrow(lambda it: near_in_runs(it, masks, radius), "fp long, near long"))
    return found.groupBy("fp").agg(F.sum("near").alias("near"))


def hexed(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def document_fingerprints(df: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within) for each row.

    ``near_edited`` and ``near_next`` are shares of equal bits. ``n_within`` is
    the number of other rows whose fingerprint differs in at most ``radius``
    bits. NULL and empty texts have fingerprint 0 and take part like any other;
    a lone row is its own next. Rows without an id come first; rows of one id
    stand in the order of a hash of their texts, then of the texts, so reruns
    agree. Equal texts have equal fingerprints, whatever the length: long texts
    are read in pieces. An empty table gives no rows.
    """
    rows = saved(with_next(df, id_col, text_col), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("many"))
    near = nodes.join(near_counts(nodes, radius), "fp", "left").select("fp", (F.coalesce("near", F.lit(0)) + F.col("many") - 1).alias("n_within"))
    return rows.join(near, "fp").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"),
        hexed("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_within")
