"""Document fingerprints against a plain version."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from fleetscope.llm import fingerprints as fpr
from tests.llm.test_text_operators import frame, fuzz


def plain_hash(word: bytes) -> int:
    total = sum((b + 1) * pow(fpr.BASE, i, 1 << 64) for i, b in enumerate(word)) + len(word) * int(fpr.MIX)
    return int(fpr.mixed(np.array([total % (1 << 64)], np.uint64))[0])


def plain(data: bytes) -> int:
    """Votes counted term by term."""
    words, votes = data.lower().split(), [0] * 64
    hashes = [plain_hash(w) for w in words]
    terms = [(h, min(len(w), 63)) for h, w in zip(hashes, words)]
    for i in range(len(words) - 1):
        h = fpr.mixed(np.array([hashes[i] * int(fpr.PAIR) + hashes[i + 1] & (1 << 64) - 1], np.uint64))[0]
        terms.append((int(h), min(len(words[i]) + len(words[i + 1]) + 1, 63)))
    for h, w in terms:
        for b in range(64):
            votes[b] += w if h >> b & 1 else -w
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_fingerprint_counts_weighted_votes(monkeypatch):
    texts = [(t or "").encode() for _, t in fuzz(3)] + [b"", b" \t", b"one", b"A a A a", b"x" * 500, ("é " * 2000).encode()]
    assert fpr.fingerprints(texts).tolist() == [plain(t) for t in texts]
    assert (fpr.fingerprints([b"Aa bB", b"aa  BB"]) == fpr.fingerprints([b"aa bb"])[0]).all()
    whole = fpr.fingerprints(texts)
    monkeypatch.setattr(fpr, "CHUNK", 64)  # every text is long now
    assert fpr.fingerprints(texts).tolist() == whole.tolist()


def test_long_text_in_pieces():
    rnd = random.Random(1)
    line = [rnd.choice(["red", "green", "Blue", "ß", "x" * 40]) for _ in range(400_000)]
    text = (" ".join(line) + "\n" * (2 * fpr.CHUNK) + " ".join(line[:1000])).encode()
    assert len(text) > 3 * fpr.CHUNK
    want = fpr.long_fingerprint(text)
    for_bit, n = fpr.term_votes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert want == int(fpr.won(for_bit, n)[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_against_their_neighbours(spark, seed):
    """NULL and repeated ids too: those stand in the order of their texts' hashes."""
    rows = fuzz(seed)
    got = fpr.document_fingerprints(frame(spark, rows)).collect()
    by_hash = lambda t: (fpr.signed(xxhash.xxh64_intdigest(t.encode(), 42)), t)
    docs = sorted((((i is not None, i or 0), t or "") for i, t in rows), key=lambda d: (d[0], by_hash(d[1])))
    prints = [plain(t.encode()) for _, t in docs]
    want = []
    for n, (key, text) in enumerate(docs):
        follower, half = docs[(n + 1) % len(docs)][1], len(text) // 2
        changed = text[:len(text) - half] + follower[:half]
        fp, other, nxt = prints[n], plain(changed.encode()), prints[(n + 1) % len(docs)]
        want.append((key[1] if key[0] else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), f"{fp:016x}", f"{other:016x}",
                     1 - (fp ^ other).bit_count() / 64, 1 - (fp ^ nxt).bit_count() / 64,
                     sum((fp ^ p).bit_count() <= 3 for p in prints) - 1))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_repeated_ids_agree_between_runs(spark):
    rows = fuzz(5)
    a, b = ({tuple(r) for r in fpr.document_fingerprints(frame(spark, rows, n)).collect()} for n in (1, 7))
    assert a == b


def test_one_document_and_none(spark):
    one = fpr.document_fingerprints(frame(spark, [(4, "a b c d")])).collect()
    assert [(r.doc_id, r.near_next, r.n_within) for r in one] == [(4, 1.0, 0)]
    assert one[0].edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest()
    assert fpr.document_fingerprints(frame(spark, [(4, "a")]).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("run, tile", [(1 << 14, 1 << 11), (16, 8)])
def test_all_fingerprints_within_the_radius(spark, monkeypatch, run, tile):
    """A crowd around one fingerprint, which is cut into groups, beside scattered ones."""
    monkeypatch.setattr(fpr, "TILE", tile)
    rnd = random.Random(7)
    middle = rnd.getrandbits(64)
    prints = {middle ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(250)} | {rnd.getrandbits(64) for _ in range(100)}
    nodes = [(fpr.signed(p), rnd.randint(1, 3)) for p in sorted(prints)]
    got = fpr.near_counts(spark.createDataFrame(nodes, "fp long, many long").repartition(5), run=run).collect()
    want = {a: s for a, _ in nodes if (s := sum(m for b, m in nodes if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3))}
    assert {r.fp: r.near for r in got} == want
