"""Passages that documents share: anchors, what their surroundings have in common, and runs of windows to remove.

Both passage operators ask which windows (of words or bytes) also start in a
document with a smaller id. They differ in where anchors stand and in how
windows are compared; the way through Spark is the same.

1. Every document gives its anchors: a hash, and a hash of the span of all
   windows that belong to the anchor. A task sorts what it has; where documents
   agree in the whole span, one entry goes on for all of them. So a passage that
   a third of all documents hold sends an entry for each task, not for each document.
2. Entries meet by anchor. Where a span stands in several documents, all of them
   are told to claim it. Where one anchor stands in different spans of different
   documents, the first document of each span is asked for its windows.
3. Claims carry a digest of the span's own text, made anew where the text is,
   and windows that were asked for lie behind the claims of their bucket in one row.
   Claims and windows meet by anchor: a claim holds if a smaller id claims the
   same digest, windows are compared one by one. The hashes of step 1 only say what is worth
   claiming; nothing is removed on their word.
4. Runs of removable windows go back to their documents.

Entries travel as packed arrays, one row for each task and bucket. A task has
several buckets and takes them one after another. Documents are joined twice by
id; Spark shuffles them once and reads that shuffle again. Long texts are read in
pieces that overlap by a window less one unit: each window lies in one piece, and
spans that a border cuts differ from others around their anchor, which step 3 settles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, shuffle_parts, slices, text_buffer

#: Bits of an anchor hash that travel beside its bucket, and of a span's hash.
CODE_BITS, SPAN_BITS = 40, 47
#: Entries that a task sorts at a time, bytes of text that it looks at together, and bytes that it gathers before it sends them.
ENTRIES, CHUNK, SEND = 1 << 19, 1 << 20, 1 << 24
#: Bytes of short documents that are looked at together: their hashes, 8 bytes a byte, stay in a core's cache.
GROUP = 1 << 16
#: Buckets that a task takes one after another, so that it holds this share of its input.
BUCKETS_A_TASK = 4
#: What a document is told about a span: claim it, or send its windows.
CLAIM, ASK = 0, 1
#: Join key of rows without an id.
NO_ID = -(1 << 63)
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Anchors(NamedTuple):
    """Anchors of a chunk: row and place of each, its hashes, and the first and last window (places back from it)."""

    row: np.ndarray
    place: np.ndarray
    code: np.ndarray
    span: np.ndarray
    near: np.ndarray
    far: np.ndarray
    data: list[bytes] | np.ndarray  # what a window comparison needs, by ``records``


class Shape(Protocol):
    window: int

    def anchors(self, buf: np.ndarray, off: np.ndarray) -> Anchors: ...

    def pieces(self, buf: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
        """(first byte, last byte, units before) of pieces of a long text."""

    def digests(self, found: Anchors, at: np.ndarray) -> np.ndarray: ...

    def records(self, found: Anchors, at: np.ndarray) -> list[bytes]: ...

    def removable(self, code: np.ndarray, ids: np.ndarray, near: np.ndarray, far: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]: ...


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= MIX
    x ^= x >> np.uint64(29)
    return x


def planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of whole numbers, byte plane by byte plane, which the shuffle's compression likes better."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unplanes(data: bytes, size: int) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :size] = flat.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def text_digests(texts: list[bytes], near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """A 64-bit BLAKE2 digest of each text and its anchor's place in it; no relation to the hashes that brought the texts together."""
    blake, place = hashlib.blake2b, np.stack((near, far), axis=1).astype(np.uint8).tobytes()
    return np.frombuffer(b"".join([blake(t + place[i:i + 2], digest_size=8).digest() for i, t in zip(range(0, len(place), 2), texts)]), "<u8")


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Whether a sorted row differs from the one before it in any key."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def order_of(key: np.ndarray, *minor: np.ndarray) -> np.ndarray:
    """The order by ``key``, then by the others as in ``lexsort``, the last one first; only rows that share a key are sorted by those."""
    order = np.argsort(key)
    held = key[order]
    new = starts_of(held)
    shared = ~new
    shared[:-1] |= ~new[1:]
    some = order[shared]
    order[shared] = some[np.lexsort((*(m[some] for m in minor), held[shared]))]
    return order


def tag(bucket: np.ndarray, code: np.ndarray, span: np.ndarray) -> np.ndarray:
    """One number for an anchor and its span; the lowest bit is free for what a document is told."""
    return mixed(mixed((bucket.astype(np.uint64) << np.uint64(CODE_BITS)) | code) + span * STEP) & ~np.uint64(1)


def split_code(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((h >> np.uint64(CODE_BITS)) % np.uint64(buckets)).astype(np.int64), h & np.uint64((1 << CODE_BITS) - 1)


def chunks(ids: np.ndarray, text: pa.Array, shape: Shape) -> Iterator[tuple[int, Anchors]]:
    """(first row, anchors) of runs of documents of about GROUP bytes, and of pieces of CHUNK bytes of long ones."""
    buf, off = text_buffer(text)
    for a, z in slices(off, min(GROUP, CHUNK)):
        own = buf[off[a]:off[z]]
        if len(own) <= 2 * CHUNK:
            yield a, shape.anchors(own, off[a:z + 1] - off[a])
            continue
        for first, last, before in shape.pieces(own, CHUNK):
            found = shape.anchors(own[first:last], np.array([0, last - first]))
            yield a, found._replace(place=found.place + before)


def home_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that gathers what goes back to a document; ids of any pattern spread evenly."""
    return (mixed(ids.view(np.uint64) * STEP) % np.uint64(buckets)).astype(np.int64)


def owners(ids: np.ndarray, keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each (id, key) once, packed, and its number for each row."""
    order = np.lexsort((keys, ids))
    new = starts_of(ids[order], keys[order])
    index = np.empty(len(ids), np.int64)
    index[order] = np.cumsum(new) - 1
    own = order[new]
    return [planes(ids[own].view(np.uint64), 8), planes(keys[own].view(np.uint64), 8)], index


def by_home(ids: np.ndarray, keys: np.ndarray, buckets: int, *columns: tuple[np.ndarray, int]) -> pa.RecordBatch:
    """What goes back to documents, packed for the bucket that gathers it: a row for each home, not for each document."""
    home = home_of(ids, buckets)
    order = np.argsort(home, kind="stable")
    edges = np.append(np.flatnonzero(starts_of(home[order])), len(ids)) if len(ids) else np.zeros(1, np.int64)
    rows = []
    for a, z in zip(edges[:-1], edges[1:]):
        at = order[a:z]
        own, index = owners(ids[at], keys[at])
        rows.append([int(home[at[0]]), planes(index, 4), *own, *(planes(values[at].astype(np.uint64), size) for values, size in columns)])
    names = ["doc", "ids", "keys", *(f"c{i}" for i in range(len(columns)))]
    return rows_batch(rows, pa.schema([("home", pa.int32()), *((n, pa.binary()) for n in names)]))


class Outbox:
    """What goes back to documents, over several buckets of a task, so that a home gets few packed rows and not one a bucket."""

    def __init__(self, homes: int, *sizes: int):
        self.homes, self.sizes, self.held, self.count = homes, sizes, [], 0

    def add(self, ids: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(ids):
            self.held.append((ids, keys, *columns))
            self.count += len(ids)
        if self.count >= ENTRIES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            ids, keys, *columns = (np.concatenate(c) for c in zip(*self.held))
            self.held, self.count = [], 0
            yield by_home(ids, keys, self.homes, *zip(columns, self.sizes))


def gather(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """One row for each document with all that came back to it, and the keys of what came; rows come sorted by home."""
    names = [f"c{i}" for i in range(len(sizes))]
    for _, rows in bucket_runs(batches, "home"):
        doc = [unplanes(r["doc"], 4) for r in rows]
        ids, keys = (np.concatenate([unplanes(r[n], 8).view(np.int64)[d] for r, d in zip(rows, doc)]) for n in ("ids", "keys"))
        order = np.argsort(ids, kind="stable")
        edges = np.flatnonzero(starts_of(ids[order]))
        packed = []
        for name, size in (("keys", 8), *zip(names, sizes)):
            values = (keys if name == "keys" else np.concatenate([unplanes(r[name], size) for r in rows]))[order].astype(f"<{'i' if name == 'keys' else 'u'}{size}")
            packed.append(pa.array([x.tobytes() for x in np.split(values, edges[1:])], pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array(ids[order][edges]), *packed], ["node", "keys", *names])


def gathered(df: DataFrame, tasks: int, sizes: tuple[int, ...]) -> DataFrame:
    columns = ", ".join(f"c{i} binary" for i in range(len(sizes)))
    return df.repartition(tasks, "home").sortWithinPartitions("home").mapInArrow(lambda it: gather(it, sizes), f"node long, keys binary, {columns}")


def packets(count: int) -> str:
    return "home int, doc binary, ids binary, keys binary" + "".join(f", c{i} binary" for i in range(count))


ENTRY = "bucket int, code binary, span binary, doc binary, ids binary"


def entry_rows(bucket: np.ndarray, code: np.ndarray, span: np.ndarray, ids: np.ndarray, code_size: int = 5) -> Iterator[list]:
    """A packed row for each bucket; rows come sorted by bucket."""
    edges = np.append(np.flatnonzero(starts_of(bucket)), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    for a, z in zip(edges[:-1], edges[1:]):
        own, doc = np.unique(ids[a:z], return_inverse=True)
        yield [int(bucket[a]), planes(code[a:z], code_size), planes(span[a:z], 6), planes(doc, 4), planes(own.view(np.uint64), 8)]


def rows_batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def map_anchors(batches: Iterator[pa.RecordBatch], shape: Shape, buckets: int, homes: int) -> Iterator[pa.RecordBatch]:
    """Step 1. A span's lowest bit says whether several documents of the task have it. Rows with a bucket below 0 hold the
    tags that all but the first of those are told, spread by home."""
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("code", "span", "doc", "ids"))])
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ids, h, span = (np.concatenate([x[i] for x in held]) for i in range(3))
        held.clear()
        bucket, code = split_code(h, buckets)
        del h
        order = order_of(bucket.astype(np.uint64) << np.uint64(CODE_BITS) | code, ids, span)
        ids, bucket, code, span = ids[order], bucket[order], code[order], span[order]
        del order
        new = starts_of(bucket, code, span)
        first = np.flatnonzero(new)
        done = (ids > ids[first][np.cumsum(new) - 1]) & starts_of(bucket, code, span, ids)
        several = np.logical_or.reduceat(done, first) if len(first) else done
        rows = list(entry_rows(bucket[first], code[first], span[first] << np.uint64(1) | several, ids[first]))
        tags, owner = tag(bucket[done], code[done], span[done]), ids[done]
        home = -1 - home_of(owner, homes)
        order = np.argsort(home, kind="stable")
        rows += entry_rows(home[order], tags[order], np.zeros(len(order), np.uint64), owner[order], 8)
        return rows_batch(rows, schema)

    for batch in batches:
        ids = batch.column(0).to_numpy()
        for a, found in chunks(ids, batch.column(1), shape):
            held.append((ids[a + found.row], found.code, found.span & np.uint64((1 << SPAN_BITS) - 1)))
            size += len(found.row)
            if size >= ENTRIES:
                yield flush()
                size = 0
    if held:
        yield flush()


def bucket_runs(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[int, list[dict]]]:
    """All packed rows of one bucket after another; rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for i, at in enumerate(batch.column(key).to_pylist()):
            if at != now and held:
                yield now, held
                held = []
            now = at
            held += batch.slice(i, 1).to_pylist()
    if held:
        yield now, held


def meet_anchors(batches: Iterator[pa.RecordBatch], homes: int) -> Iterator[pa.RecordBatch]:
    """Step 2: what each document is told, as tags."""
    out = Outbox(homes, 8)
    for bucket, rows in bucket_runs(batches):
        ids = np.concatenate([unplanes(r["ids"], 8).view(np.int64)[unplanes(r["doc"], 4)] for r in rows])
        if bucket < 0:
            yield from out.add(ids, np.zeros_like(ids), np.concatenate([unplanes(r["code"], 8) for r in rows]))
            continue
        code = np.concatenate([unplanes(r["code"], 5) for r in rows])
        span = np.concatenate([unplanes(r["span"], 6) for r in rows])
        order = order_of(code, ids, span >> np.uint64(1))
        ids, code, span = ids[order], code[order], span[order]
        several, span = (span & np.uint64(1)).astype(bool), span >> np.uint64(1)
        new, run = starts_of(code, span), starts_of(code)
        first = np.flatnonzero(new)
        least = ids[first][np.cumsum(new) - 1]
        # An anchor asks for windows if the first documents of its spans are not all the same.
        edges = np.flatnonzero(starts_of(code[first]))
        asked = np.minimum.reduceat(ids[first], edges) != np.maximum.reduceat(ids[first], edges)
        ask = asked[np.cumsum(run) - 1] & new
        # A span that several documents have is claimed by all of them, by the first one too.
        shared = np.logical_or.reduceat(several | (ids > least), first)[np.cumsum(new) - 1]
        claim = shared & starts_of(code, span, ids)
        tags = tag(np.full(len(ids), bucket), code, span)
        told = np.concatenate((tags[claim] | np.uint64(CLAIM), tags[ask] | np.uint64(ASK)))
        owner = np.concatenate((ids[claim], ids[ask]))
        yield from out.add(owner, np.zeros_like(owner), told)
    yield from out.flush()


RUN = "bucket int, code binary, doc binary, ids binary, keys binary, place binary, near binary, far binary, digest binary, data array<binary>"
#: Bytes of the anchor's code that go with a claim, whose digest says the rest, and with a window that is compared.
CLAIM_CODE, ASK_CODE = 2, 5


def ask_windows(batches: Iterator[pa.RecordBatch], shape: Shape, buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 3, at the documents: claims with their digests, and windows that were asked for, by the anchor's bucket."""
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("code", "doc", "ids", "keys", "place", "near", "far", "digest")), ("data", pa.list_(pa.binary()))])

    def packed_rows(held: dict[int, list[tuple]], ids: np.ndarray, keys: np.ndarray) -> Iterator[list]:
        """A row for each bucket out of (bucket, code, doc, place, near, far, digest or windows) of many chunks: its claims, then its windows."""
        both = [*held[CLAIM], *held[ASK]]
        if not both:
            return
        where, code, doc, place, near, far = (np.concatenate([h[i] for h in both]) for i in range(6))
        digest, data = np.concatenate([np.zeros(0, np.uint64), *(h[6] for h in held[CLAIM])]), [x for h in held[ASK] for x in h[6]]
        claims = len(digest)
        order = np.argsort(where, kind="stable")
        edges = np.append(np.flatnonzero(starts_of(where[order])), len(order))
        for i, j in zip(edges[:-1], edges[1:]):
            at = order[i:j]
            many = int(np.searchsorted(at, claims))
            own, index = owners(ids[doc[at]], keys[doc[at]])
            codes = planes(code[at[:many]], CLAIM_CODE) + planes(code[at[many:]], ASK_CODE)
            yield [int(where[at[0]]), codes, planes(index, 4), *own, planes(place[at], 4), planes(near[at], 1), planes(far[at], 1),
                   planes(digest[at[:many]], 8), [data[x - claims] for x in at[many:].tolist()]]

    held: dict[int, list[tuple]] = {CLAIM: [], ASK: []}
    rows: list[tuple[np.ndarray, np.ndarray]] = []  # ids and keys of the batches that the held ones stand in
    size = 0

    def flush() -> pa.RecordBatch:
        out = rows_batch(list(packed_rows(held, *(np.concatenate(c) for c in zip(*rows)))), schema)
        held[CLAIM].clear()
        held[ASK].clear()
        return out

    for batch in batches:
        if not size:
            rows.clear()
        base = sum(len(ids) for ids, _ in rows)
        rows.append((batch.column(0).to_numpy().copy(), batch.column(1).to_numpy().copy()))  # views would hold the batch's texts
        lists = batch.column(3)
        for a, found in chunks(rows[-1][0], batch.column(2), shape):
            if not len(found.row):
                continue
            bucket, code = split_code(found.code, buckets)
            mine = tag(bucket, code, found.span & np.uint64((1 << SPAN_BITS) - 1))
            last = int(found.row.max()) + 1
            said = [np.frombuffer(x, "<u8") for x in lists.slice(a, last).to_pylist()]
            owner = np.repeat(np.arange(last, dtype=np.uint64), [len(x) for x in said])
            told = np.sort(mixed(np.concatenate(said) ^ (owner * STEP)))
            salt = found.row.astype(np.uint64) * STEP
            for kind in (CLAIM, ASK):
                asked = mixed((mine | np.uint64(kind)) ^ salt)
                at = np.flatnonzero(told[np.minimum(np.searchsorted(told, asked), len(told) - 1)] == asked) if len(told) else told
                if len(at):
                    data = shape.digests(found, at) if kind == CLAIM else shape.records(found, at)
                    held[kind].append((bucket[at], code[at], base + a + found.row[at], found.place[at], found.near[at], found.far[at], data))
                    size += 56 * len(at) + (sum(map(len, data)) if kind == ASK else 0)
            if size >= SEND:
                yield flush()
                size = 0
    if size:
        yield flush()


def unpacked(rows: list[dict], kind: int) -> list[np.ndarray]:
    """Ids, keys, codes, places, nearest and farthest windows of the claims of packed rows, or of the windows behind them, end to end."""
    columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 4]
    for r in rows:
        claims = len(r["digest"]) // 8
        mine, border = (slice(claims), slice(CLAIM_CODE * claims)) if kind == CLAIM else (slice(claims, None), slice(CLAIM_CODE * claims, None))
        doc = unplanes(r["doc"], 4)[mine]
        columns.append([*(unplanes(r[n], 8).view(np.int64)[doc] for n in ("ids", "keys")), unplanes(r["code"][border], CLAIM_CODE if kind == CLAIM else ASK_CODE),
                        *(unplanes(r[n], size)[mine] for n, size in (("place", 4), ("near", 1), ("far", 1)))])
    return [np.concatenate(c) for c in zip(*columns)]


def meet_windows(batches: Iterator[pa.RecordBatch], shape: Shape, homes: int) -> Iterator[pa.RecordBatch]:
    """Step 3, at the anchors, and step 4: c0 first windows, c1 how many, of the removable runs of each document."""
    out = Outbox(homes, 4, 4)
    for _, rows in bucket_runs(batches):
        ids, keys, code, place, near, far = unpacked(rows, CLAIM)
        digest = np.concatenate([unplanes(r["digest"], 8) for r in rows])
        # A claim holds if a smaller id claims the same text around the same anchor.
        order = order_of(digest, ids, code)
        new = starts_of(code[order], digest[order])
        held = np.zeros(len(ids), bool)
        if len(ids):
            held[order] = ids[order] > ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        first, many = place.astype(np.int64) - far.astype(np.int64), far.astype(np.int64) - near.astype(np.int64) + 1
        found = [(ids[held], keys[held], first[held], many[held])]
        data = [x for r in rows for x in r["data"]]
        if data:
            ids, keys, code, place, near, far = unpacked(rows, ASK)
            at, back = shape.removable(code, ids, near.astype(np.int64), far.astype(np.int64), data)
            found.append((ids[at], keys[at], place[at].astype(np.int64) - back, np.ones(len(at), np.int64)))
        ids, keys, first, many = (np.concatenate(x) for x in zip(*found))
        # Runs that touch become one before they travel.
        order = np.lexsort((first, keys, ids))
        ids, keys, first, many = ids[order], keys[order], first[order], many[order]
        if len(ids):
            fresh = starts_of(ids, keys)
            end = np.maximum.accumulate(first + many + np.cumsum(fresh) * (1 << 40)) - np.cumsum(fresh) * (1 << 40)
            fresh[1:] |= first[1:] > end[:-1]
            edge = np.flatnonzero(fresh)
            stop = np.append(edge[1:], len(ids)) - 1
            ids, keys, first, many = ids[edge], keys[edge], first[edge], end[stop] - first[edge]
        yield from out.add(ids, keys, first, many)
    yield from out.flush()


def repeated_windows(df: DataFrame, shape: Shape, id_col: str, text_col: str, others: list[str] = []) -> DataFrame:  # noqa: B006
    """All rows as (id, key, text, runs, c_0, c_1, ...): ``runs`` are packed (keys, c0 first, c1 many) of windows that also start in a smaller id.

    ``key`` is a hash of the text, so that rows which share an id keep their own
    runs; ``c_i`` are the columns named in ``others``. Rows without an id neither remove nor lose anything.
    """
    tasks = shuffle_parts(df.sparkSession)
    buckets = tasks * BUCKETS_A_TASK
    text, row_id = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    kept = [F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(others)]
    # Both joins take the same columns and a key that is never NULL, so that the second one reads the first one's shuffle.
    docs = df.select(F.coalesce(row_id, F.lit(NO_ID)).alias("node"), row_id.alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), *kept)
    names = [f"c_{i}" for i in range(len(others))]
    source = short_batches(df).select(row_id.alias("id"), text.alias("text")).where("id is not null and text is not null")
    entries = source.mapInArrow(lambda it: map_anchors(it, shape, buckets, tasks), ENTRY)
    tags = gathered(entries.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: meet_anchors(it, tasks), packets(1)), tasks, (8,))
    asked = docs.join(tags.select("node", F.col("c0").alias("tags")), "node").select("id", "key", "text", "tags", *names)
    sent = asked.mapInArrow(lambda it: ask_windows(it, shape, buckets), RUN)
    runs = gathered(sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda it: meet_windows(it, shape, tasks), packets(2)), tasks, (4, 4)).select("node", F.struct("keys", "c0", "c1").alias("runs"))
    return docs.join(runs, "node", "left").select("id", "key", "text", "runs", *names)


def covered(runs: dict | None, key: int, units: int, window: int) -> list[tuple[int, int]]:
    """Stretches (first, end) of a row's units (words or bytes) that its removable windows cover, in order and apart."""
    if not runs:
        return []
    own = np.frombuffer(runs["keys"], "<i8") == key
    first, many = (np.frombuffer(runs[n], "<u4").astype(np.int64)[own] for n in ("c0", "c1"))
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.minimum((first + many - 1 + window)[order], units)
    reach = np.maximum.accumulate(end)
    edge = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1])))
    return list(zip(first[edge].tolist(), reach[np.append(edge[1:], len(first)) - 1].tolist()))


def without(units, gone: list[tuple[int, int]]) -> list:
    """What is left of a text or a list between the stretches that go."""
    at, left = 0, []
    for first, end in gone:
        left.append(units[at:first])
        at = end
    return [*left, units[at:]]
