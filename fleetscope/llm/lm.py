"""LM scoring (operator 4) with a log-frequency Bloom filter.

Counts of words and word pairs of all training texts are summed by hash. A
count c is stored as its level 1 + floor(log_b c): the filter gets one entry for
each level up to that. A worker that wants a count probes level after level
until one is missing. The filter is cut into one segment for each bucket of the
hash, so segments are filled where their counts lie and only they are gathered.

p(w | h) = k · c(h, w) / c(h) + (1 - k) · (c(w) + 1) / (N + V + 1), all counts from the filter.

Pairs below a level may stay out of the filter, so that it fits into its bound; of all but
small corpora those seen once do, at every size. A row that was learned from knows that its own
pairs were seen. Any other occurrence whose pair the filter does not hold at that level meets the
pair's count in a shuffle, with the levels of its two words, and comes back as part of a sum.

The plain base score needs exact counts. Frequent words have theirs in a table
of bounded size that goes to all workers; occurrences of other words meet their
counts in the same shuffle and come back as one sum for each document and bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, id_crc32, saved, short_batches, shuffle_parts, slices, text_buffer
from .passages import CHUNK, STEP, mixed, planes, rows_batch, starts_of, unplanes
from .substring import word_hashes

#: Bound of the filter, bits for each entry, and hash functions.
FILTER_BYTES, ENTRY_BITS, HASHES = 1 << 26, 8, 3
#: Up to this size the filter also holds the pairs that were seen once, which are most of them.
WHOLE_BYTES = 1 << 22
#: Base of the levels, and weight of the pair estimate.
LEVEL_BASE, PAIR_WEIGHT = 1.5, 0.3
#: Levels that are told apart in the sizing of the filter; tokens that a task counts at a time.
LEVELS, TOKENS = 96, 1 << 22
#: Hashes that get their bucket at a time.
BLOCK = 1 << 18
#: Words whose exact counts go to all workers at most.
HEAD = 500_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Hashes of the end of a text and of what stands before its first word.
END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
LOW = np.uint64((1 << 48) - 1)
PAIR = np.uint64(1 << 48)


def token_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, hash of the pair with the token before) of all tokens; each row ends in an end token."""
    row, _, h, _, _ = word_hashes(LOWER[buf], off)
    rows = len(off) - 1
    words = np.bincount(row, minlength=rows)
    tok = np.empty(len(h) + rows, np.uint64)
    last = np.cumsum(words + 1) - 1
    tok[last] = END
    tok[np.arange(len(h)) + row] = h
    before = np.concatenate(([BEGIN], tok[:-1]))
    before[last[:-1] + 1] = BEGIN
    return np.repeat(np.arange(rows), words + 1), tok, mixed(before * STEP + tok)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(h) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, and the places of its hashes."""
    bucket = np.empty(len(h), np.min_scalar_type(buckets))  # short numbers take little room and are sorted by their digits
    for i in range(0, len(h), BLOCK):
        bucket[i:i + BLOCK] = bucket_of(h[i:i + BLOCK], buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.append(np.flatnonzero(starts_of(bucket[order])), len(h))
    for a, z in zip(edges[:-1], edges[1:]):
        yield int(bucket[order[a]]), order[a:z]


def in_batches(rows: Iterable[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Packed rows in batches of some BATCH_BYTES; rows are made as they are asked for."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= BATCH_BYTES:
            yield rows_batch(held, schema)
            held, size = [], 0
    if held:
        yield rows_batch(held, schema)


def least_bytes(values: np.ndarray) -> int:
    return max(1, -(-int(values.max()).bit_length() // 8))


def whole_numbers(data: bytes, count: int) -> np.ndarray:
    """Numbers that took the bytes they needed."""
    return unplanes(data, len(data) // count).astype(np.int64)


def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    edge = np.flatnonzero(starts_of(h))
    return h[edge], np.add.reduceat(n, edge) if len(edge) else n


COUNTS = "bucket int, pair boolean, h binary, n binary"
COUNTS_ARROW = pa.schema([("bucket", pa.int32()), ("pair", pa.bool_()), ("h", pa.binary()), ("n", pa.binary())])


def count_task(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of what a task reads, packed by bucket. What is held are the hashes alone, and they are sorted in place."""
    held: dict[bool, list] = {False: [], True: []}

    def rows() -> Iterator[list]:
        for pair, parts in held.items():
            h = np.concatenate(parts)
            parts.clear()
            h.sort()
            edge = np.flatnonzero(starts_of(h)).astype(np.uint32)
            n = np.diff(edge, append=np.uint32(len(h)))
            h = h[edge]
            del edge
            for bucket, at in by_bucket(h, buckets):
                yield [bucket, pair, planes(h[at], 6 if pair else 8), planes(n[at], least_bytes(n[at]))]

    size = 0
    for batch in batches:
        buf, off = text_buffer(batch.column(0))
        for a, z in slices(off, CHUNK):
            _, tok, pair = token_hashes(buf[off[a]:off[z]], off[a:z + 1] - off[a])
            held[False].append(tok)
            held[True].append(pair)
            size += len(tok)
            if size >= TOKENS:
                yield from in_batches(rows(), COUNTS_ARROW)
                size = 0
    if size:
        yield from in_batches(rows(), COUNTS_ARROW)


def levels(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(n) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    return np.where(level > 0, np.maximum(1.0, (LEVEL_BASE ** (level - 1.0) + LEVEL_BASE**level - 1) / 2), 0.0)


TOTALS = "bucket int, word_h binary, word_n binary, pair_h binary, pair_n binary, tokens long, words long, entries long, lengths array<long>, pair_levels array<long>"


def total_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: exact counts of words and counts of pairs, with what sizes the filter and the table of frequent words."""
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("word_h", "word_n", "pair_h", "pair_n")),
                        *((n, pa.int64()) for n in ("tokens", "words", "entries")), ("lengths", pa.list_(pa.int64())), ("pair_levels", pa.list_(pa.int64()))])

    def row(bucket: int, held: list[dict]) -> list:
        none = np.zeros(0, np.uint64)
        both = []
        for pair, size in ((False, 8), (True, 6)):
            mine = [r for r in held if r["pair"] is pair]
            h = [unplanes(r["h"], size) for r in mine]
            n = [whole_numbers(r["n"], len(x)).astype(np.uint64) for x, r in zip(h, mine)]
            both.append(summed(np.concatenate([none, *h]), np.concatenate([none, *n])))
        (wh, wn), (ph, pn) = both
        bits = np.floor(np.log2(np.maximum(wn, 1).astype(float))).astype(np.int64)
        return [bucket, planes(wh, 8), planes(wn, 6), planes(ph, 6), planes(pn, 6), int(wn.sum()), len(wh),
                int(levels(wn).sum()), np.bincount(bits, minlength=48).tolist(), np.bincount(np.minimum(levels(pn), LEVELS - 1), minlength=LEVELS).tolist()]

    now, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != now and held:
                yield rows_batch([row(now, held)], schema)
                held = []
            now = r["bucket"]
            held.append(r)
    if held:
        yield rows_batch([row(now, held)], schema)


def places(key: np.ndarray, bucket: np.ndarray, level: np.ndarray | int, turn: int, segment_bits: int) -> np.ndarray:
    h = mixed(mixed(key * STEP + np.uint64(turn)) + np.asarray(level).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return bucket * segment_bits + (h % np.uint64(segment_bits)).astype(np.int64)


def fill_task(batches: Iterator[pa.RecordBatch], segment_bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """The filter's segment of each bucket: a bit array with all levels of its words and of its pairs from level ``least`` on.

    ``count_rows`` has the counts of the other pairs, which ``meet_task`` looks up.
    """
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            bits = np.zeros(segment_bits, bool)
            for h, n, extra in ((unplanes(r["word_h"], 8) & LOW, unplanes(r["word_n"], 6), np.uint64(0)), (unplanes(r["pair_h"], 6), unplanes(r["pair_n"], 6), PAIR)):
                top = levels(n) if len(n) else np.zeros(0, np.int64)
                if extra:
                    h, top = h[top >= least], top[top >= least]
                key = np.repeat(h | extra, top)
                level = np.arange(len(key)) - np.repeat(np.cumsum(top) - top, top) + 1
                for turn in range(HASHES):
                    bits[places(key, np.zeros(len(key), np.int64), level, turn, segment_bits)] = True
            out.append([r["bucket"], np.packbits(bits, bitorder="little").tobytes()])
        yield rows_batch(out, pa.schema([("bucket", pa.int32()), ("bits", pa.binary())]))


class Model(NamedTuple):
    """What workers need: the filter, exact counts of frequent words, and the totals."""

    buckets: int
    segment_bits: int
    bits: np.ndarray
    head_h: np.ndarray
    head_n: np.ndarray
    tokens: int
    words: int
    top: int = LEVELS
    least: int = 1  # the level from which on pairs are in the filter

    def level(self, h: np.ndarray, pair: bool) -> np.ndarray:
        """Levels by probing: one after another until a bit of one is not set."""
        bucket = bucket_of(h, self.buckets)
        key = (h & LOW) | PAIR if pair else h & LOW
        out, at, level = np.zeros(len(h), np.int64), np.arange(len(h)), 1
        while len(at):
            hit = np.ones(len(at), bool)
            for turn in range(HASHES):
                spot = places(key[at], bucket[at], level, turn, self.segment_bits)
                hit &= (self.bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0
            at = at[hit]
            out[at] = level
            level += 1
            if level > self.top:  # no count is larger, whatever bits are set
                break
        return out


class Trained(NamedTuple):
    model: Model
    totals: DataFrame


def fit(df: DataFrame, train: Column, text_col: str = "text") -> Trained:
    """Counts over all training rows, the filter, and the table of frequent words.

    The filter takes ``ENTRY_BITS`` bits for each entry, so its false hits do
    not grow with the corpus. All words enter it, and the pairs from the least level on
    at which they fit into ``FILTER_BYTES``: all of them up to ``WHOLE_BYTES``, beyond that those
    seen twice or more, and beyond some 60 million entries those seen a few times or more
    (``score`` looks up the counts of rarer ones where they lie). Should the words alone not fit, the
    filter is as large as they need. Frequent words are those with at least 2**i occurrences, for the
    least i that keeps the table within ``HEAD`` words.
    """
    spark = df.sparkSession
    buckets = shuffle_parts(spark)
    counted = short_batches(df).where(train).select(F.col(text_col).cast("string").alias("text")).mapInArrow(lambda it: count_task(it, buckets), COUNTS)
    totals = saved(counted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(total_task, TOTALS), "counts")
    sums = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"),
                      *[F.coalesce(F.sum(F.col("lengths")[i]), F.lit(0)).alias(f"l{i}") for i in range(48)],
                      *[F.coalesce(F.sum(F.col("pair_levels")[i]), F.lit(0)).alias(f"p{i}") for i in range(LEVELS)]).first()
    whole = sums["entries"] + sum(i * sums[f"p{i}"] for i in range(LEVELS))
    first = 1 if whole * ENTRY_BITS <= WHOLE_BYTES * 8 else 2
    entries, least = sums["entries"], LEVELS
    while least > first and (entries + (least - 1) * sums[f"p{least - 1}"]) * ENTRY_BITS <= FILTER_BYTES * 8:
        least -= 1
        entries += least * sums[f"p{least}"]
    segment_bits = max(64, -(-entries * ENTRY_BITS // buckets)) // 8 * 8
    bits = np.zeros(buckets * segment_bits // 8, np.uint8)
    filled = totals.select("bucket", "word_h", "word_n", "pair_h", "pair_n").mapInArrow(lambda it: fill_task(it, segment_bits, least), "bucket int, bits binary")
    for r in filled.toLocalIterator():
        at = r["bucket"] * segment_bits // 8
        bits[at:at + segment_bits // 8] = np.frombuffer(r["bits"], np.uint8)
    cut, held = 48, 0
    while cut > 0 and held + sums[f"l{cut - 1}"] <= HEAD:
        cut -= 1
        held += sums[f"l{cut}"]

    def frequent(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n = unplanes(r["word_n"], 6)
                keep = n >= 1 << cut
                rows.append([unplanes(r["word_h"], 8)[keep].tobytes(), n[keep].tobytes()])
            yield rows_batch(rows, pa.schema([("h", pa.binary()), ("n", pa.binary())]))

    head = totals.select("word_h", "word_n").mapInArrow(frequent, "h binary, n binary").collect()  # HEAD words at most
    h, n = (np.frombuffer(b"".join(bytes(r[c]) for r in head), "<u8") for c in ("h", "n"))
    order = np.argsort(h)
    top = int(levels(np.array([2.0 ** max((i + 1 for i in range(48) if sums[f"l{i}"]), default=1)]))[0])
    return Trained(Model(buckets, segment_bits, bits, h[order], n[order], int(sums["tokens"]), int(sums["words"]), top, least), totals)


#: Kinds of rows that travel by bucket: words, pairs, and what is known of a chunk's documents.
WORDS, PAIRS, TEXTS = range(3)
#: Entries that leave a task together, and documents.
SEND, DOCUMENTS = 1 << 19, 1 << 16
MET = "bucket int, kind int, late boolean, chunk long, h binary, doc binary, n binary, before binary, own binary"
BLOBS = [(n, pa.binary()) for n in ("h", "doc", "n", "before", "own")]
MET_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("late", pa.bool_()), ("chunk", pa.int64()), *BLOBS])
PART = "chunk long, kind int, h binary, doc binary, n binary, before binary, own binary"
PART_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), *BLOBS])


def log_chance(both: np.ndarray, before: np.ndarray, own: np.ndarray, floor: float) -> np.ndarray:
    """log10 p(w | h) out of the counts of the pair, of h and of w."""
    share = np.where(before > 0, np.minimum(both, before) / np.maximum(before, 1.0), 0.0)
    return np.log10(PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * (own + 1) / floor)


def entries_of(kind: int, chunk: int, buckets: int, h: np.ndarray, doc: np.ndarray, *levels: np.ndarray) -> Iterator[list]:
    """Occurrences that meet their counts elsewhere, packed by bucket; ``levels`` are the same wherever a hash and a document are."""
    order = np.lexsort((doc, h))
    edge = np.flatnonzero(starts_of(h[order], doc[order]))
    times = np.diff(np.append(edge, len(order)))
    h, doc, *levels = (x[order][edge] for x in (h, doc, *levels))
    for bucket, at in by_bucket(h, buckets):
        yield [bucket, kind, True, chunk, planes(h[at], 6 if kind == PAIRS else 8), planes(doc[at], least_bytes(doc[at])), planes(times[at], least_bytes(times[at])),
               *([planes(x[at], 1) for x in levels] or (None, None))]


def score_task(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Packed rows of a chunk's documents, of their less frequent words, and of pairs whose counts neither the filter nor the row tells, by bucket.

    A pair of a row that was learned from has been seen once at least: where the filter holds all that were seen more often, its count is 1.
    """
    chunk, floor = TaskContext.get().partitionId() << 36, model.tokens + model.words + 1.0
    counts = middle(np.arange(model.top + 1))
    end = model.level(np.array([END]), False)[0]  # of the count of training texts, which the filter holds like any other
    words, pairs, texts = [], [], []
    docs = size = 0

    def packed_rows() -> Iterator[list]:
        ids, state, *numbers = (np.concatenate([t[i] for t in texts]) for i in range(6))
        texts.clear()
        yield [chunk % model.buckets, TEXTS, True, chunk, planes(ids.view(np.uint64), 8), state.tobytes(), planes(numbers[0], 6), planes(numbers[1], 6),
               np.concatenate(numbers[2:]).tobytes()]
        for kind, held in ((WORDS, words), (PAIRS, pairs)):
            if held:
                columns = [np.concatenate([x[i] for x in held]) for i in range(len(held[0]))]
                held.clear()
                yield from entries_of(kind, chunk, model.buckets, *columns)

    for batch in batches:
        buf, off = text_buffer(batch.column(2))
        id_null, held_null = (np.asarray(batch.column(i).is_null()) for i in (0, 1))
        every_id = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
        held_out = np.asarray(batch.column(1).fill_null(True)).astype(bool)
        states = (id_null + 2 * held_out + 4 * held_null).astype(np.uint8)
        for a, z in slices(off, CHUNK):
            row, tok, pair = token_hashes(buf[off[a]:off[z]], off[a:z + 1] - off[a])
            rows = z - a
            word, at_word = np.unique(tok, return_inverse=True)
            level = model.level(word, False)
            some, at_pair = np.unique(pair, return_inverse=True)
            both = model.level(some, True)[at_pair]
            before = np.concatenate(([0], level[at_word[:-1]]))
            before[starts_of(row)] = end
            away = np.zeros(0, np.int64)
            if model.least > 1:  # a pair of words of which one was never seen has not been seen either
                low = both < model.least
                both[low] = 0
                low &= (before > 0) & (level > 0)[at_word]
                if model.least == 2:
                    once = low & ~held_out[a:z][row]
                    both[once] = 1
                    low &= ~once
                away = np.flatnonzero(low)
            score = log_chance(counts[both], counts[before], counts[level][at_word], floor)
            score[away] = 0.0
            # Exact counts where the table has them; the others leave as entries.
            spot = np.minimum(np.searchsorted(model.head_h, word), max(0, len(model.head_h) - 1))
            known = model.head_h[spot] == word if len(model.head_h) else np.zeros(len(word), bool)
            exact = np.where(known, model.head_n[spot] if len(model.head_h) else 0, 0)
            base = np.bincount(row, np.log10(exact + 1.0)[at_word], rows)
            texts.append((every_id[a:z], states[a:z], np.bincount(row, minlength=rows), np.bincount(row, known[at_word], rows).astype(np.int64), base, np.bincount(row, score, rows)))
            rare = np.flatnonzero(~known[at_word])
            if len(rare):
                words.append((tok[rare], row[rare] + docs))
            if len(away):
                pairs.append((pair[away], row[away] + docs, before[away], level[at_word[away]]))
            size += len(rare) + len(away)
            docs += rows
            if size >= SEND or docs >= DOCUMENTS:
                yield from in_batches(packed_rows(), MET_ARROW)
                chunk += docs
                docs = size = 0
    if docs:
        yield from in_batches(packed_rows(), MET_ARROW)


def count_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The counts of a bucket's words, and of its pairs that are not in the filter, those below level ``least``."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            out.append([r["bucket"], WORDS, False, None, r["word_h"], None, r["word_n"], None, None])
            if least > 1:
                n = unplanes(r["pair_n"], 6)
                keep = levels(n) < least if len(n) else np.zeros(0, bool)
                out.append([r["bucket"], PAIRS, False, None, planes(unplanes(r["pair_h"], 6)[keep], 6), None, planes(n[keep], 6), None, None])
        yield rows_batch(out, MET_ARROW)


def meet_task(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """What a bucket's counts add to the documents of each chunk; the counts of a kind come before its entries.

    Words: known tokens and the sum of log10(c + 1). Pairs: the sum of log10 p(w | h). What is known of documents goes on as it is.
    """
    none = np.zeros(0, np.uint64)
    now, h, count = None, none, none
    for batch in batches:
        for r in batch.to_pylist():
            kind, chunk = r["kind"], r["chunk"]
            if kind == TEXTS:
                yield rows_batch([[chunk, kind, *(r[n] for n, _ in BLOBS)]], PART_ARROW)
                continue
            key = unplanes(r["h"], 6 if kind == PAIRS else 8)
            if not r["late"]:
                n = unplanes(r["n"], 6)
                now, h, count = (r["bucket"], kind), key, middle(levels(n)) if kind == PAIRS and len(n) else n.astype(float)
                continue
            if (r["bucket"], kind) != now:
                now, h, count = (r["bucket"], kind), none, none
            spot = np.minimum(np.searchsorted(h, key), max(0, len(h) - 1))
            c = np.where(h[spot] == key, count[spot], 0.0) if len(h) else np.zeros(len(key))
            doc, index = np.unique(whole_numbers(r["doc"], len(key)), return_inverse=True)
            times = whole_numbers(r["n"], len(key))
            if kind == PAIRS:
                before, own = (middle(unplanes(r[n], 1).astype(np.int64)) for n in ("before", "own"))
                known, each = None, log_chance(c, before, own, floor)
            else:
                known, each = planes(np.bincount(index, times * (c > 0), len(doc)).astype(np.int64), 6), np.log10(c + 1)
            sums = np.bincount(index, times * each, len(doc))
            yield rows_batch([[chunk, kind, None, planes(doc, least_bytes(doc)), known, None, sums.tobytes()]], PART_ARROW)


def sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a chunk, with all that was added to it; what is known of documents comes first."""
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    held = None

    def out() -> pa.RecordBatch:
        ids, state, size, known, base, score = held
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=state & 1 > 0), pa.array(state & 2 > 0, mask=state & 4 > 0), *map(pa.array, (size, known, base, score))], schema=schema)

    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == TEXTS:
                if held:
                    yield out()
                size, known = (unplanes(r[n], 6).astype(np.int64) for n in ("n", "before"))
                base, score = np.frombuffer(r["own"]).reshape(2, -1).copy()
                held = unplanes(r["h"], 8).view(np.int64), np.frombuffer(r["doc"], np.uint8), size, known, base, score
                continue
            sums = np.frombuffer(r["own"])
            doc = whole_numbers(r["doc"], len(sums))  # each once
            if r["kind"] == WORDS:
                held[3][doc] += unplanes(r["n"], 6).astype(np.int64)
                held[4][doc] += sums
            else:
                held[5][doc] += sums
    if held:
        yield out()


def score(df: DataFrame, trained: Trained, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    ``held_out`` is false for rows that were learned from. NULL and empty texts are one end token. Ids may be NULL or
    repeat: rows stay apart. Without a training row every count is 0. An empty table gives no
    rows. Other columns are ignored. Entries go to their counts, and sums of a chunk's
    documents back, in one shuffle each; nothing is written in between.
    """
    model = trained.model
    shared = df.sparkSession.sparkContext.broadcast(model)  # FILTER_BYTES and HEAD words at most
    rows = short_batches(df).select(F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(lambda it: score_task(it, shared.value), MET)
    least, buckets, floor = model.least, model.buckets, model.tokens + model.words + 1.0
    counts = trained.totals.select("bucket", "word_h", "word_n", "pair_h", "pair_n") if least > 1 else trained.totals.select("bucket", "word_h", "word_n")
    met = counts.mapInArrow(lambda it: count_rows(it, least), MET).union(found).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "late")
    parts = met.mapInArrow(lambda it: meet_task(it, floor), PART).repartition(buckets, "chunk").sortWithinPartitions("chunk", F.desc("kind"))
    texts = parts.mapInArrow(sum_task, "id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    return texts.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(floor)).alias("base_score"), "score")


def fold(id_col: str = "doc_id", folds: int = 7, held: int = 2) -> Column:
    """Whether a row is held out."""
    return F.coalesce(id_crc32(id_col) % folds == held, F.lit(False))
