"""SimHash near-dedup (operator 5) with bit-sliced comparison.

Fingerprints take every shingle of a whole text. Distinct fingerprints are
compared where they agree on two of six parts of their bits (four differing
bits can't touch more than four parts). The rows of a part pair lie sorted in a
task; bit plane b holds bit b of all of them, 64 rows to a word. Shifting the
planes by d and comparing them with themselves gives the differences of every
row with the row d places on at once; a carry-save counter adds them up plane
by plane, and words in which every distance is over the radius are dropped on
the way. A task gives back a forest over what it linked, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, per_batch, saved, short_batches, text_buffer

BITS, SEED = 64, 42
PARTS, SAME = 6, 2
LOW = np.uint64(0x0101010101010101)
#: Shingles whose hashes are summed at a time.
BLOCK = 1 << 20


def fingerprint(data: bytes, shingle: int, seed: int = SEED) -> int:
    """Bit set where over half of the shingle hashes have it; 0 without a word."""
    words = data.lower().split()
    if not words:
        return 0
    line, size = b" ".join(words), len(words)
    if size <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:size - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest, total, set_bits = xxhash.xxh64_intdigest, size - shingle + 1, np.zeros(BITS, np.int64)
    for at in range(0, total, BLOCK):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at:at + BLOCK], stops[at:at + BLOCK])], np.uint64)
        set_bits += bit_counts(h)
    return int(np.packbits(set_bits * 2 > total, bitorder="little").view("<u8")[0])


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many hashes have each bit: eight counters of a byte to a word, emptied before they can overflow."""
    out, edges = np.zeros(BITS, np.int64), np.arange(0, len(h), 255)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LOW, edges)
        out[k::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(df: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp): ``fp`` is the fingerprint as a signed long, ``key`` a hash of the text. ASCII letters are lower-cased, words joined by one space."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])

    def columns(batch: pa.RecordBatch) -> dict:
        buf, off = text_buffer(batch.column(2))
        data, borders = buf.tobytes(), off.tolist()
        fp = np.array([fingerprint(data[a:b], shingle) for a, b in zip(borders, borders[1:])], np.uint64)
        return {"id": batch.column(0), "key": batch.column(1), "fp": pa.array(fp.view(np.int64))}

    text = F.col(text_col).cast("string")
    return short_batches(df).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(
        per_batch(columns, schema), "id long, key long, fp long")


def part_masks() -> list[int]:
    """The bits that stay for each pair of parts."""
    edges = [round(i * BITS / PARTS) for i in range(PARTS + 1)]
    parts = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, SAME)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes_of(fp: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word, and two words of zeros at the end."""
    words = -(-len(fp) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:len(fp)] = fp
    out = np.zeros((BITS, words + 2), np.uint64)
    for b in range(BITS):
        bits = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[b, :words] = np.packbits(bits, bitorder="little").view("<u8")
    return out


def close_at(planes: np.ndarray, group_of: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Rows i such that row i + d is of the same group and differs in at most ``radius`` bits."""
    n = len(group_of)
    same = group_of[:n - d] == group_of[d:]
    words = -(-len(same) // 64)
    mask = np.zeros(words * 64, np.uint8)
    mask[:len(same)] = same
    alive = np.packbits(mask, bitorder="little").view("<u8").astype(np.uint64)
    at = np.flatnonzero(alive)
    alive, hop, shift = alive[at], d // 64, np.uint64(d % 64)
    back = np.uint64((64 - d % 64) % 64)
    counters = [np.zeros(len(at), np.uint64) for _ in range(radius.bit_length())]
    for b in range(BITS):
        row = planes[b]
        other = row[at + hop]
        if shift:
            other = (other >> shift) | (row[at + hop + 1] << back)
        carry = row[at] ^ other
        for c, held in enumerate(counters):  # carry-save: one more to 64 distances at once
            counters[c], carry = held ^ carry, held & carry
        alive &= ~carry
        over = np.zeros_like(alive)  # where the counter has passed the radius
        equal = ~over
        for c in range(len(counters) - 1, -1, -1):
            if radius >> c & 1:
                equal &= counters[c]
            else:
                over |= equal & counters[c]
                equal &= ~counters[c]
        alive &= ~over
        if b % 4 == 3:
            keep = alive != 0
            if not keep.any():
                return np.zeros(0, np.int64)
            if not keep.all():
                at, alive, counters = at[keep], alive[keep], [c[keep] for c in counters]
    hits = np.unpackbits(alive.view(np.uint8), bitorder="little").reshape(len(at), 64)
    word, lane = np.nonzero(hits)
    return at[word] * 64 + lane


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Roots after joining the pairs (a, b): each row takes the least root it meets until nothing changes."""
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        low, high = np.minimum(ra[open_], rb[open_]), np.maximum(ra[open_], rb[open_])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) that connect what lies within the radius inside each run of equal keys."""
    size = np.diff(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))))
    keep = np.repeat(size > 1, size)
    key, fp, most = key[keep], fp[keep], int(size.max(initial=1))
    if not len(fp):
        return fp, fp
    planes, root = planes_of(fp), np.arange(len(fp))
    for d in range(1, most):
        i = close_at(planes, key, d, radius)
        if len(i):
            root = forest(len(fp), i, i + d, root)
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def link_runs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted (key, fp) rows; a run of equal keys may go over batches."""
    held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = links(key, fp, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    for batch in batches:
        held_key = np.concatenate((held_key, batch.column(0).to_numpy(zero_copy_only=False)))
        held_fp = np.concatenate((held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        cut = int(np.searchsorted(held_key, held_key[-1])) if len(held_key) else 0
        if cut >= 1 << 16:
            yield out(held_key[:cut], held_fp[:cut])
            held_key, held_fp = held_key[cut:], held_fp[cut:]
    if len(held_key):
        yield out(held_key, held_fp)


def groups(docs: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of all fingerprints; ``component_id`` is the smallest id that links reach."""
    if radius >= PARTS - SAME + 1:
        raise ValueError(f"the parts find up to {PARTS - SAME} bits")
    nodes = docs.groupBy("fp").agg(F.min("id").alias("least"))
    keyed = nodes.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(part_masks())])).alias("key"))
    found = keyed.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(lambda it: link_runs(it, radius), "a long, b long")
    roots = components(found)
    label = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    names = label.groupBy("root").agg(F.min("least").alias("component_id"))
    return label.join(names, "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row; ``component_id`` is the smallest id that links reach.

    NULL and empty texts have fingerprint 0 and link like any other. Equal
    fingerprints are one node, so copies cost one row before the comparison.
    A NULL id gives a row but never names a component; a component of NULL ids
    alone has NULL. Repeated ids stay separate rows. An empty table gives no rows.
    """
    docs = saved(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    return docs.join(groups(docs, radius), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: that with the smallest id. Rows without an id stay.

    A row is known by its id and a hash of its text: where ids repeat, the least
    hash of the smallest id stays, in every run. Of rows equal in both, one stays.
    """
    docs = saved(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    first = (docs.where("id is not null").join(groups(docs, radius), "fp").groupBy("component_id")
                 .agg(F.min(F.struct("id", "key")).alias("kept")).select(F.col("kept.id").alias("_id"), F.col("kept.key").alias("_key")))
    named = df.withColumns({"_own_id": F.col(id_col).cast("long"), "_own_key": F.xxhash64(F.col(text_col).cast("string"))})
    kept = named.join(first, (named["_own_id"] == first["_id"]) & (named["_own_key"] == first["_key"]), "left_semi")
    return kept.dropDuplicates(["_own_id", "_own_key"]).drop("_own_id", "_own_key").union(df.where(F.col(id_col).isNull()))
