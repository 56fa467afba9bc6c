"""The steps of the passage operators without Spark: forced collisions, long texts, homes, and what a task holds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fleetscope.llm import passages, suffix
from fleetscope.llm.substring import WordWindows
from fleetscope.llm.suffix import ByteWindows
from tests.llm.test_text_operators import first_ids, fuzz, reference_gone

BYTES, WORDS = ByteWindows(), WordWindows()


def sorted_batch(rows, key):
    rows = sorted(rows, key=lambda r: r[key])
    return iter([pa.RecordBatch.from_pylist(rows[i:i + 5], schema=schema_of(rows)) for i in range(0, len(rows), 5)])


def schema_of(rows):
    kind = {int: pa.int64(), bytes: pa.binary(), list: pa.list_(pa.binary())}
    return pa.schema([(n, kind[type(v)]) for n, v in rows[0].items()])


def rows_from(batches):
    return [r for b in batches for r in b.to_pylist()]


def stretches(shape, rows, tasks=2, buckets=3):
    """What each (id, key, text) loses, by the four steps."""
    entries = []
    for part in (rows[i::tasks] for i in range(tasks)):
        if part:
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.string())], ["id", "text"])
            entries += rows_from(passages.map_anchors(iter([batch]), shape, buckets, 2))
    if not entries:
        return {(i, k): [] for i, k, _ in rows}
    told = rows_from(passages.meet_anchors(sorted_batch(entries, "bucket"), 2))
    tags = {r["node"]: r["c0"] for r in rows_from(passages.gather(sorted_batch(told, "home"), (8,)))} if told else {}
    runs = {}
    asked = [r for r in rows if r[0] in tags]
    if asked:
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in asked], pa.int64()), pa.array([r[1] for r in asked], pa.int64()),
                                            pa.array([r[2] for r in asked], pa.string()), pa.array([tags[r[0]] for r in asked], pa.binary())], ["id", "key", "text", "tags"])
        sent = rows_from(passages.ask_windows(iter([batch]), shape, buckets))
        met = rows_from(passages.meet_windows(sorted_batch(sent, "bucket"), shape, 2)) if sent else []
        runs = {r["node"]: r for r in rows_from(passages.gather(sorted_batch(met, "home"), (4, 4)))} if met else {}
    size = (lambda t: len(t.encode())) if shape is BYTES else (lambda t: len(t.split()))
    return {(i, k): passages.covered(runs.get(i), k, size(t), shape.window) for i, k, t in rows}


def data_of(seed):
    return [(i, n, t) for n, (i, t) in enumerate(fuzz(seed)) if i is not None and t is not None]


def units(shape, text):
    return text.encode() if shape is BYTES else text.encode().split()


def expected(shape, rows):
    every = [(i, units(shape, t)) for i, _, t in rows]
    first = first_ids(every, shape.window)
    return {(i, k): reference_gone(u, first, i, shape.window) for (i, k, _), (_, u) in zip(rows, every)}


def flags(spans, size):
    out = [False] * size
    for a, z in spans:
        out[a:z] = [True] * (z - a)
    return out


@pytest.mark.parametrize("shape", [BYTES, WORDS], ids=["bytes", "words"])
@pytest.mark.parametrize("entries, chunk, send", [(1 << 19, 1 << 20, 1 << 23), (64, 100, 1), (1000, 64, 50)])
def test_small_flushes_and_long_texts(monkeypatch, shape, entries, chunk, send):
    """Chunks so small that most texts are read in pieces."""
    for name, value in (("ENTRIES", entries), ("CHUNK", chunk), ("SEND", send)):
        monkeypatch.setattr(passages, name, value)
    rows = data_of(11)
    got, want = stretches(shape, rows), expected(shape, rows)
    assert {k: flags(v, len(want[k])) for k, v in got.items()} == want and any(any(w) for w in want.values())


@pytest.mark.parametrize("shape", [BYTES, WORDS], ids=["bytes", "words"])
def test_hashes_that_collide_remove_nothing_wrongly(monkeypatch, shape):
    """All spans of an anchor look equal: only what a smaller id really has may go; whole copies still go."""
    rows = data_of(12)
    want = expected(shape, rows)
    monkeypatch.setattr(passages, "SPAN_BITS", 0)
    got = {k: flags(v, len(want[k])) for k, v in stretches(shape, rows).items()}
    assert all(w or not g for k in want for g, w in zip(got[k], want[k]))
    assert any(any(g) for g in got.values())


def test_a_common_phrase_is_no_repeat(monkeypatch):
    """Six documents around one phrase of 40 bytes, with and without a span hash."""
    rnd = random.Random(5)
    noise = lambda: "".join(rnd.choice("abcdefghij ") for _ in range(60))
    rows = [(i, i, noise() + "the very same phrase of forty bytes xxxx"[:40] + noise()) for i in range(6)]
    for bits in (47, 0):
        monkeypatch.setattr(passages, "SPAN_BITS", bits)
        assert not any(stretches(BYTES, rows).values())


@pytest.mark.parametrize("shape", [BYTES, WORDS], ids=["bytes", "words"])
def test_anchor_codes_that_collide(monkeypatch, shape):
    """All anchors meet under one code: windows are still told apart by what they hold."""
    rows = data_of(13)[:25]
    want = expected(shape, rows)
    monkeypatch.setattr(passages, "split_code", lambda h, buckets: (np.zeros(len(h), np.int64), np.zeros(len(h), np.uint64)))
    got = {k: flags(v, len(want[k])) for k, v in stretches(shape, rows).items()}
    assert all(w or not g for k in want for g, w in zip(got[k], want[k]))


def test_homes_of_any_ids():
    for step in (1, 8, 1000, 1 << 40):
        homes = passages.home_of(np.arange(20_000, dtype=np.int64) * step, 8)
        assert np.bincount(homes, minlength=8).max() < 3000
    assert passages.home_of(np.array([-1, -2, passages.NO_ID]), 8).min() >= 0


def test_pieces_hold_each_window_once():
    text = " ".join(f"w{i}" for i in range(500)).encode()
    buf = np.frombuffer(text, np.uint8)
    for size in (64, 100, 1000):
        starts = [f + b for first, last, f in BYTES.pieces(buf, size) for b in range(last - first - 49)]
        assert sorted(starts) == list(range(len(text) - 49))
        starts = [f + w for first, last, f in WORDS.pieces(buf, size) for w in range(len(text[first:last].split()) - 12)]
        assert sorted(starts) == list(range(500 - 12)) and all(f % 7 == 0 for _, _, f in WORDS.pieces(buf, size))


def test_covered_joins_stretches():
    runs = {"keys": np.array([1, 1, 1, 2], "<i8").tobytes(), "c0": np.array([5, 0, 30, 9], "<u4").tobytes(), "c1": np.array([2, 3, 1, 1], "<u4").tobytes()}
    assert passages.covered(runs, 1, 33, 10) == [(0, 16), (30, 33)]
    assert passages.covered(runs, 3, 33, 10) == [] == passages.covered(None, 1, 33, 10)
    assert passages.without("abcdef", [(1, 2), (4, 6)]) == ["a", "cd", ""]


@pytest.mark.parametrize("shape", [BYTES, WORDS])
def test_claims_of_many_batches_travel_together(shape):
    """A bucket gets one row from a task, however many batches its texts come in, with the same claims and windows."""
    rows = sorted(data_of(4))
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows])], schema=schema)
    entries = rows_from(passages.map_anchors(iter([batch]), shape, 3, 2))
    told = rows_from(passages.meet_anchors(sorted_batch(entries, "bucket"), 2))
    tags = {r["node"]: r["c0"] for r in rows_from(passages.gather(sorted_batch(told, "home"), (8,)))}
    asked = [r for r in rows if r[0] in tags]
    names = ["id", "key", "text", "tags"]
    whole = pa.RecordBatch.from_pylist([dict(zip(names, (*r, tags[r[0]]))) for r in asked], schema=pa.schema(
        [("id", pa.int64()), ("key", pa.int64()), ("text", pa.string()), ("tags", pa.binary())]))
    one = rows_from(passages.ask_windows(iter([whole]), shape, 3))
    many = rows_from(passages.ask_windows((whole.slice(i, 2) for i in range(0, len(whole), 2)), shape, 3))
    assert len(one) == len(many) == len({r["bucket"] for r in one}) and len(whole) > 4

    def held(sent):
        met = rows_from(passages.meet_windows(sorted_batch(sent, "bucket"), shape, 2))
        return {r["node"]: r for r in rows_from(passages.gather(sorted_batch(met, "home"), (4, 4)))}

    assert held(one) == held(many) and held(one)


def test_equal_windows_have_their_anchor_at_the_same_place():
    """Each window of a row has one anchor, which lies in it; where and which it is depends on the window's bytes alone."""
    rnd = random.Random(5)
    whole = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    texts = [whole, "x" * 170, "ab" * 90, "", whole[40:180], "rested " * 30, "y" + whole[100:], "short", "q" * 49, whole[7:57], "ab" * 40 + "a"]
    off = np.cumsum([0, *map(len, texts)])
    found = BYTES.anchors(np.frombuffer("".join(texts).encode(), np.uint8), off)
    seen, of = {}, {}
    for row, place, code, near, far in zip(*(x.tolist() for x in found[:3]), found.near.tolist(), found.far.tolist()):
        for back in range(near, far + 1):
            first = place - back
            window = texts[row][first:first + BYTES.window]
            assert len(window) == BYTES.window and 0 <= back <= BYTES.window - 18 and (row, first) not in of
            of[row, first] = back, code
            assert seen.setdefault(window, (back, code)) == (back, code)
    assert set(of) == {(i, a) for i, t in enumerate(texts) for a in range(len(t) - BYTES.window + 1)}


def test_windows_that_only_one_document_has_are_not_sorted(monkeypatch):
    """A common anchor in ever different surroundings: the suffix sort gets one window of each that repeats."""
    rnd = random.Random(6)
    anchor, sorted_ = b"common to them all", []
    data = [bytes(rnd.choices(b"abcdefgh", k=32)) + anchor + bytes(rnd.choices(b"abcdefgh", k=32)) for _ in range(200)]
    data[7] = data[3][:60] + data[7][60:]
    n = len(data)
    near, far = np.zeros(n, np.int64), np.full(n, 32)
    sort = suffix.merge_sort
    monkeypatch.setattr(suffix, "merge_sort", lambda buf, hashes, start, length: sorted_.append(len(start)) or sort(buf, hashes, start, length))
    at, back = BYTES.removable(np.zeros(n, np.uint64), np.arange(n), near, far, data)
    assert sorted(zip(at.tolist(), back.tolist())) == [(7, b) for b in range(22, 33)] and sum(sorted_) == 11
    assert not len(BYTES.removable(np.zeros(n, np.uint64), np.full(n, 4), near, far, data)[0])
