"""Source divergence against plain counting, and against its SQL twin."""

import collections
import re
import string

import pytest

from checks.compare import compare, duck
from fleetscope.llm import divergence, queries
from tests.llm.test_text_operators import frame, fuzz

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows, least, top=50):
    rows = [tuple(v or "" for v in r) for r in rows]  # lang, source, text
    groups, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        found = TERM.findall(text.translate(A_TO_Z))
        groups[lang, source].update(found)
        docs[lang].update(set(found))
    for lang in docs:
        terms = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted({s for g, s in groups if g == lang})
        p = {}
        for name, counts in [*((s, groups[lang, s]) for s in sources), (None, sum((groups[lang, s] for s in sources), collections.Counter()))]:
            total = sum(counts[t] for t in terms)
            p[name] = {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(terms)) for t in terms}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in terms)) for o in sources if o != s]
            marked = [(t, p[s][t] - p[None][t]) for t in terms if groups[lang, s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", marked)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                for rank, (item, value) in enumerate(items[:top] if part == "term" else items, 1):
                    yield lang, s, part, item, value, rank


ODD = [(900, "Ünter über ÜBER é É x_y 日本 a\x00b"), (901, "\x7f\x80\x81 tAb\tTab"), (902, None), (903, "")]


@pytest.mark.parametrize("least, vocabulary, cells", [(3, 1 << 20, 1 << 21), (1, 60, 64), (5, 25, 1 << 21)])
def test_audit(spark, monkeypatch, least, vocabulary, cells):
    """NULLs, copies and repeated ids; the vocabulary in one round and in several."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    df = frame(spark, fuzz(least) + ODD * 2)
    rows = [(r.lang, r.source, r.text) for r in df.collect()]
    got = divergence.audit(df, least, vocabulary=vocabulary).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows, least)))


def test_flushes_keep_everything(spark, monkeypatch):
    """Sums that leave a task early, and terms that go over a flush."""
    df = frame(spark, fuzz(8))
    rows = [(r.lang, r.source, r.text) for r in df.collect()]
    monkeypatch.setattr(divergence, "ENTRIES", 16)
    parts = [b.to_pandas() for b in divergence.source_pairs(iter(batches()))]
    assert sum(p["own"].sum() for p in parts) == 40 * (abs(10 - 1) + 0) + 40 * 0
    got = divergence.audit(df, 2).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows, 2)))


def batches():
    """Two sources, forty terms that the first one has, in batches of seven rows."""
    import pyarrow as pa

    rows = [("en", 0, None, 0, 1), ("en", 0, None, 1, 1)] + [("en", 0, t, 0, 10) for t in range(40)]
    schema = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("term", pa.int64()), ("code", pa.int32()), ("p", pa.int64())])
    for i in range(0, len(rows), 7):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + 7]), schema)], schema=schema)


def test_no_kept_term_and_no_rows(spark):
    df = frame(spark, [(i, f"w{i}") for i in range(9)])
    got = divergence.audit(df).collect()
    assert got and all(r.part == "pair" and r.value == 0 for r in got)
    assert divergence.audit(df.where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("key", ["op11_merkle_manifest", "op12_source_divergence"])
def test_sql_twins(spark, key):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, duck(sf), queries.QUERIES[key], queries.ORACLE[key], sf) is None


def test_terms_of_many_texts_are_cut_together(monkeypatch):
    """Texts that end and begin with letters, empty ones at both ends, NULL, no letters at all; all at once, or a text at a time."""
    import pyarrow as pa

    texts = ["", None, "ab Ab", "cd", "", "c d", "1 2", "Ünter\x00ß x_y 日本", "z", "", None]
    langs = ["en", "de", "en", "en", "de", "de", "en", "de", "", "en", "en"]
    want = [TERM.findall((t or "").translate(A_TO_Z)) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (langs, ["s"] * len(texts), texts)], names=["lang", "source", "text"])
    places = {"en": {b"ab": 0, b"cd": 1}, "de": {"ünter".encode(): 2, "Ünter".encode(): 3, b"d": 4}}
    for send in (1 << 21, 1):
        monkeypatch.setattr(divergence, "SEND", send)
        for part in (batch, batch.slice(2), batch.slice(3, 4), batch.slice(0, 2)):
            begin = next(i for i in range(len(texts)) if batch.slice(i, part.num_rows).equals(part))
            rows = [r for out in divergence.split_terms(iter([part])) for r in out.to_pylist()]
            assert [sorted(r["terms"]) for r in rows] == [sorted({f"{g}\x00{w}" for w in ws}) for g, ws in list(zip(langs, want))[begin:begin + part.num_rows]]
            assert all(set(r["some"]) <= set(r["terms"]) for r in rows)
        sums = collections.Counter()
        for packed in divergence.summed_vectors(iter([batch]), places, 1):
            for r in packed.to_pylist():
                for owner, term, n in zip(*(memoryview(r[c]).cast(k) for c, k in (("owner", "I"), ("term", "I"), ("count", "q")))):
                    sums[r["groups"][owner]["lang"], term] += n
        assert sums == {("en", 0): 2, ("en", 1): 1, ("de", 3): 1, ("de", 4): 1}
