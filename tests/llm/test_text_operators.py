"""Tokens, language ID, mixing, scoring, near-duplicates and shared passages against brute force on small tables."""

import collections
import hashlib
import itertools
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetscope.llm import bpe, common, langid, lm, mixing, passages, queries, simhash, substring, suffix, tokens

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, `key` string, size string, fp string, uid string, runs string"
WORDS = "the quick brown fox jumps over lazy dogs while seven tall birds sing about rain and summer night again".split()


def fuzz(seed: int, rows: int = 60) -> list[tuple]:
    """Documents with NULLs, empty texts, repeated ids, copies and shared passages."""
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdeéf") + rnd.choice(WORDS) for _ in range(200)] for _ in range(4)]
    out = []
    for i in range(rows):
        words: list[str] = []
        for _ in range(rnd.randint(0, 6)):
            b, a = rnd.choice(base), rnd.randint(0, 190)
            words += b[a:a + rnd.randint(1, 40)]
            if rnd.random() < 0.5:
                words += [rnd.choice("XYZ") for _ in range(rnd.randint(1, 5))]
        text = rnd.choice([" ", "\n", "  ", "\t"]).join(words) if rnd.random() < 0.9 else rnd.choice([None, "", "  ", "123 !!"])
        out.append((rnd.choice([None, i, i, i // 2]), text))
    same = "copy of " + " ".join(WORDS) * 3
    out += [(200 + i, same) for i in range(20)] + [(100, "a " * 80), (101, "a " * 70), (5, "é " * 80), (7, "a" * 300), (7, "a" * 300), (3, "a" * 51)]
    return out


def frame(spark, rows, parts=4):
    """With columns whose names clash with those the operators use inside."""
    full = [(i, t, random.Random(str(t)).choice(["en", "de", None]), f"s{(i or 0) % 3}" if i else None, 0, "x", "x", "x", "x", "x", "x") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def key(row):
    return tuple((v is not None, v) for v in row)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(queries.tokenizer_path())


ALPHABET = list("abcTHEinreß éèΣσςİıñǅﬁ'sdlmvt0123½²!?.,<|>-_ \t\n\x0b\x0c\r\x1c\x1f\x85\xa0　̧́가각ᄀ日本🙂Å") + ["<|endoftext|>", "<|startoftext|>", "the", "'ll", "'re"]


def tricky(seed=1, count=600):
    rnd = random.Random(seed)
    out = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 60))) for _ in range(count)]
    return out + ["in" * 3000, "re" * 5000 + "x", "".join(rnd.choices("rers", k=12000)), "!" * 5000, "=-" * 4000, "", "a" * 9000, "word " * 3000]


def test_tokens_as_the_library_gives_them(encoder, library):
    for text in tricky():
        ids = np.frombuffer(encoder.encode(text.encode()), "<u4").tolist()
        want = library.encode(text, add_special_tokens=False).ids
        decoder = bpe.Decoder(encoder)
        assert ids == want, text[:80]
        assert decoder.feed(ids[:3]) + decoder.feed(ids[3:]) + decoder.end() == library.decode(want, skip_special_tokens=False)


def test_window_is_as_good_as_the_whole_word(encoder):
    rnd = random.Random(5)
    for _ in range(20):
        word = "".join(rnd.choices("rethinagou", k=6000))
        parts = [encoder.inner[b] for b in word.encode()]
        assert list(encoder.stream(iter(parts))) == encoder.merge(parts[:])


def test_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2  # bc made or not moves the border before b, and then a's
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([("ab", "c"), ("a", "b")])
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc")])


def test_byte_level_decoder_keeps_open_characters(encoder):
    decoder = bpe.Decoder(encoder)
    decoder.byte_level = True
    ids = [encoder.inner[b] for b in "é日".encode()]
    assert [decoder.feed([i]) for i in ids] == ["", "é", "", "", "日"] and decoder.end() == ""


def test_counts_spliced_from_chunks(encoder, library):
    for text in tricky(2, 300):
        assert tokens.count_spliced(encoder, text, 100, 8) == len(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_bpe_and_counts_queries(spark, library):
    data = fuzz(1)
    df = frame(spark, data)
    want = []
    for i, t in data:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert rows_of(bpe.encode_decode(df, queries.tokenizer_path())) == sorted(want, key=key)
    counts = rows_of(tokens.token_counts(df, queries.tokenizer_path(), limit=40, chunk=64, overlap=8))
    assert counts == sorted(((i, len((t or "").encode()), w[1], w[1] > 40) for (i, t), w in zip(data, want)), key=key)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(found) == docs.count()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    dicts = langid.fit(docs, langid.training_rows())
    odd = langid.identify(frame(spark, [(1, None), (2, "12 !!"), (3, ""), (None, "the of and"), (3, "word " * 100000)]), dicts)
    assert [r.lang_pred for r in odd.orderBy("doc_id", "score").collect()][1:4] == ["und", "und", "und"]
    assert langid.fit(docs.where("false"), F.lit(True)) == {}
    assert {r.lang_pred for r in langid.identify(docs.limit(3), {}).collect()} == {"und"}
    kept = langid.keep_identified(docs, dicts)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in found) > 0.97 * docs.count()


def test_language_sample_below_a_bound(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    monkeypatch.setattr(langid, "DOCS_PER_LANG", 10)
    bounded = langid.fit(docs, langid.training_rows())
    monkeypatch.setattr(langid, "SPARE", 1 << 40)  # every row passes
    assert langid.fit(docs, langid.training_rows()) == bounded and len(bounded) == 4
    monkeypatch.setattr(langid, "SPARE", 1)
    same = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit("le chat dort").alias("text"), F.lit("fr").alias("lang"))
    assert langid.fit(same, F.lit(True)) == {"fr": b" ".join([b"le chat dort"] * 10)}


def test_budgets_share_and_cap():
    got = mixing.budgets([("a", 10), ("b", 100), (None, 100), ("c", 0)])
    assert got["c"] == 0 and got["a"] <= 30 and math.isclose(sum(got.values()), 210)
    assert mixing.budgets([("a", 5)]) == {"a": 5.0} and mixing.budgets([]) == {}


def test_knapsack_against_all_subsets():
    rnd = random.Random(4)
    for _ in range(60):
        lengths = np.array(sorted(rnd.sample(range(1, 30), rnd.randint(1, 4))))
        free, budget = np.array([rnd.randint(0, 3) for _ in lengths]), rnd.randint(0, 80)
        take = mixing.knapsack(lengths, free, budget)
        sums = {int(np.dot(lengths, c)) for c in itertools.product(*(range(n + 1) for n in free))}
        assert (take <= free).all() and int(np.dot(take, lengths)) == max(s for s in sums if s <= budget)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT", 3)
    data = [(i, t) for i, t in fuzz(2, 150)]
    df = frame(spark, data)
    got = mixing.mix(df).collect()
    assert len(got) == len(data) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=key) == sorted(map(tuple, got), key=key)
    target, taken = {}, collections.Counter()
    for r in got:
        taken[r.target, r.source_size] += r.taken
        target[r.target, r.source_size] = r.target
    assert all(abs(taken[k] - target[k]) <= 12 for k in target)
    full = mixing.mixed_documents(df)
    assert full.columns == df.columns
    words = full.select(F.coalesce(F.sum(mixing.word_count()), F.lit(0))).first()[0]
    assert words == sum(r.taken for r in got)
    assert mixing.mix(df.where("false")).count() == 0


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 20)
    data = fuzz(3)
    df = frame(spark, data)
    trained = lm.fit(df, ~lm.fold())
    got = lm.score(df, trained, lm.fold())
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: [*(t or "").encode().lower().split(), None]
    counts = collections.Counter(w for i, t in data if not out(i) for w in split(t))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t in data:
        w = split(t)
        want.append((i, out(i), len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w), 6)))
    rows = got.collect()
    assert sorted((tuple(r)[:5] + (round(r.base_score, 6),) for r in rows), key=key) == sorted(want, key=key)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert trained.model.level(lm.token_hashes(np.frombuffer(b"the", np.uint8), np.array([0, 3]))[1][1:], False)[0] > 0  # the end token
    none = lm.fit(df.where("false"), F.lit(True))
    assert {r.n_known for r in lm.score(df, none, F.lit(True)).collect()} == {0}


def test_filter_never_undercounts():
    n = np.arange(1, 2000)
    level = lm.levels(n)
    assert (lm.LEVEL_BASE ** (level - 1) <= n + 1e-6).all() and (n < lm.LEVEL_BASE**level + 1e-6).all()


def reference_fingerprint(text, size=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark):
    data = fuzz(6, 80)
    rnd = random.Random(1)
    long = [rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(400)]
    for i in range(30):
        words = long[:]
        words[rnd.randrange(400)] = "changed"
        data.append((300 + i, " ".join(words)))
    df = frame(spark, data)
    fp = [reference_fingerprint(t) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(data)), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4:
            root[find(b)] = find(a)
    least = {}
    for x, (i, _) in enumerate(data):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    want = sorted(((i, f"{fp[x]:016x}", least.get(find(x))) for x, (i, _) in enumerate(data)), key=key)
    assert rows_of(simhash.near_duplicates(df)) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_bit_slices_against_pairs():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12).astype(np.uint64)
    fp = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40, 3)).astype(np.uint64), axis=1) for c in centres]))
    group = np.sort(rng.integers(0, 3, len(fp)))
    planes = simhash.planes_of(fp)
    for d in (1, 5, 63, 64, 65, 130):
        want = [i for i in range(len(fp) - d) if group[i] == group[i + d] and int(fp[i] ^ fp[i + d]).bit_count() <= 4]
        assert simhash.close_at(planes, group, d, 4).tolist() == want


def reference_gone(units, first, i, size):
    gone = [False] * len(units)
    if i is not None:
        for p in range(len(units) - size + 1):
            if first[tuple(units[p:p + size])] < i:
                gone[p:p + size] = [True] * size
    return gone


def first_ids(rows, size):
    first = {}
    for i, units in rows:
        if i is not None:
            for p in range(len(units) - size + 1):
                k = tuple(units[p:p + size])
                first[k] = min(i, first.get(k, i))
    return first


@pytest.mark.parametrize("small", [False, True])
def test_repeated_words(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(passages, "ENTRIES", 64)
        monkeypatch.setattr(passages, "CHUNK", 200)
    data = fuzz(8)
    words = [(i, (t or "").encode().split()) for i, t in data]
    first, want = first_ids(words, 13), []
    for i, w in words:
        gone = reference_gone(w, first, i, 13)
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    df = frame(spark, data)
    assert rows_of(substring.without_repeated_words(df)) == sorted(want, key=key)
    assert substring.without_repeated_words(df.where("false")).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_repeated_bytes(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(passages, "ENTRIES", 64)
        monkeypatch.setattr(passages, "CHUNK", 200)
    data = fuzz(9)
    texts = [(i, (t or "").encode()) for i, t in data]
    first, want, kept = first_ids(texts, 50), [], []
    for i, b in texts:
        gone = reference_gone(b, first, i, 50)
        left = bytes(x for x, g in zip(b, gone) if not g)
        kept.append(left.decode(errors="ignore"))
        want.append((i, len(b), sum(gone), sum(k for k, _ in itertools.groupby(gone)), hashlib.sha256(left).hexdigest()))
    df = frame(spark, data)
    assert rows_of(suffix.without_repeated_bytes(df).drop("kept")) == sorted(want, key=key)
    cut = suffix.without_repeats(df)
    assert cut.columns == df.columns
    assert sorted(r.text for r in cut.where("text is not null").collect()) == sorted(k for k, (_, t) in zip(kept, data) if t is not None)
    assert suffix.without_repeats(df.where("false")).count() == 0


def test_suffix_sort_with_hashes_that_mislead(monkeypatch):
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    buf[1000:1200] = buf[:200]
    start, local = np.arange(0, 3900), np.zeros(4000, np.int64) + np.arange(4000)
    rows = [buf[s:s + 50].tobytes() for s in start]
    order, group = suffix.sorted_suffixes(buf, local, start)
    assert [rows[i] for i in order] == sorted(rows) and group[-1] == len(set(rows))
    monkeypatch.setattr(suffix.PrefixHashes, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    order, group = suffix.sorted_suffixes(buf, local, start)
    assert [rows[i] for i in order] == sorted(rows) and group[-1] == len(set(rows))


def test_difference_cover():
    for gap in range(substring.PERIOD):
        assert any((a - b) % substring.PERIOD == gap for a in substring.COVER for b in substring.COVER)
    assert substring.ANCHOR + substring.PERIOD - 1 == substring.WINDOW


@pytest.mark.parametrize("ids", [[None] * 300, [7] * 300, list(range(300))], ids=["none", "repeated", "own"])
@pytest.mark.parametrize("same", [True, False])
def test_mix_comes_near_its_target_whatever_the_ids(spark, ids, same):
    """Three hundred documents of five words in a source that may give 900 of its words, also where all rows are equal."""
    rows = [(i, " ".join(["w"] * 4 + ["x" if same else f"x{n}"]), "a") for n, i in enumerate(ids)] + [(1000 + n, "big " * 30, s) for s in "bc" for n in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for mixed in (mixing.mix(df), mixing.mix(df)):
        got = {(r.source_size, round(r.target, 6)): r.taken for r in mixed.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()}
        assert all(abs(t - taken) <= 5 + 30 for (_, t), taken in got.items() if t < 3 * 1500)
        assert abs(next(t for (size, t) in got if size == 1500) - next(v for (size, _), v in got.items() if size == 1500)) <= 5
    carried = mixing.mixed_documents(df).where("source = 'a'").count() * 5
    assert abs(carried - next(t for (size, t) in got if size == 1500)) <= 5


def test_keep_one_knows_rows_by_id_and_text(spark):
    """Ids 3, 5, 5: the unique text under the repeated id stays, the near copy of 3 goes; the same in every run."""
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(3, base), (5, base + " more"), (5, "something else that nobody has written so far " * 3), (9, base), (9, base), (None, base)]
    for parts in (1, 3):
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
        assert rows_of(kept) == sorted([(3, base), rows[2], (None, base)], key=key)


def test_score_against_counts_that_are_not_quantised(spark):
    """The smoothed formula with exact counts: levels of base 1.5 move a token by less than log10(1.5), and none when all counts are 0."""
    docs = frame(spark, fuzz(21))
    held = lm.fold()
    got = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r for r in lm.score(docs, lm.fit(docs, ~held), held).collect()}
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens_of = lambda t: [*(t or "").encode().translate(lower).split(), None]
    train = [tokens_of(r.text) for r in docs.where(~held).collect()]
    words = collections.Counter(t for d in train for t in d)
    pairs = collections.Counter(p for d in train for p in zip(["begin", *d[:-1]], d))
    total, kinds = sum(words.values()), len(words)
    for r in docs.collect():
        toks, exact = tokens_of(r.text), 0.0
        for before, token in zip(["begin", *toks[:-1]], toks):
            seen = len(train) if before == "begin" else words[before]
            share = pairs[before, token] / seen if seen else 0.0
            exact += math.log10(0.3 * share + 0.7 * (words[token] + 1) / (total + kinds + 1))
        base = sum(math.log10((words[t] + 1) / (total + kinds + 1)) for t in toks)
        near = got[r.doc_id, len(toks), round(base, 6)]
        assert abs(near.score - exact) <= math.log10(1.5) * len(toks) + 1e-9 and near.score <= 0


def test_filter_at_its_bound_stays_a_probability(spark, monkeypatch):
    """Room for few pairs: rare ones count as unseen, words keep their counts, no score is above zero."""
    docs, held = frame(spark, fuzz(22)), lm.fold()
    full = lm.fit(docs, ~held).model
    monkeypatch.setattr(lm, "FILTER_BYTES", len(full.bits) // 3)
    small = lm.fit(docs, ~held)
    assert len(small.model.bits) < len(full.bits) and small.model.tokens == full.tokens
    scores = [r.score for r in lm.score(docs, small, held).collect()]
    assert all(s <= 0 for s in scores) and len(scores) == docs.count()


def test_probing_ends_at_the_largest_count():
    model = lm.Model(1, 64, np.full(8, 255, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.uint64), 10, 5, 4)
    assert model.level(np.arange(5, dtype=np.uint64), True).max() <= 4


@pytest.mark.parametrize("room", [0, 3])
def test_pairs_beyond_the_filter_count_too(spark, monkeypatch, room):
    """No room for pairs, or for the frequent ones only: scores stay as near to exact counts as with all of them in the filter."""
    docs, held = frame(spark, fuzz(21)), lm.fold()
    full = len(lm.fit(docs, ~held).model.bits)
    monkeypatch.setattr(lm, "FILTER_BYTES", full // room if room else 0)
    small = lm.fit(docs, ~held)
    assert len(small.model.bits) < full
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score(docs, small, held).collect()}
    tokens_of = lambda t: [*(t or "").encode().lower().split(), None]
    train = [tokens_of(r.text) for r in docs.where(~held).collect()]
    words = collections.Counter(t for d in train for t in d)
    pairs = collections.Counter(p for d in train for p in zip(["begin", *d[:-1]], d))
    floor, off = sum(words.values()) + len(words) + 1, []
    for r in docs.dropDuplicates(["doc_id"]).where("doc_id is not null").collect():
        toks = tokens_of(r.text)
        seen = lambda t: len(train) if t == "begin" else words[t]
        exact = sum(math.log10(0.3 * (pairs[b, t] / seen(b) if seen(b) else 0.0) + 0.7 * (words[t] + 1) / floor) for b, t in zip(["begin", *toks[:-1]], toks))
        off.append(abs(got[r.doc_id, len(toks)] - exact) / len(toks))
    assert max(off) <= math.log10(1.5) + 1e-9 and len(off) > 10


def test_rows_that_were_learned_from_look_up_no_single_pairs(spark, monkeypatch):
    """Pairs seen once stay out of the filter before it is full; only held out rows send theirs, and no score moves by more than a level a token."""
    monkeypatch.setattr(lm, "WHOLE_BYTES", 0)
    docs, held = frame(spark, fuzz(21)), lm.fold()
    trained = lm.fit(docs, ~held)
    model = trained.model
    assert model.least == 2

    def sent(rows):
        rows = rows.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
        return rows.mapInArrow(lambda it: lm.score_task(it, model), lm.MET).where(F.col("kind") == lm.PAIRS).count()

    assert sent(docs.where(~held)) == 0 < sent(docs.where(held))
    got = sorted(tuple(r) for r in lm.score(docs.where("doc_id is not null"), trained, held).collect())
    monkeypatch.setattr(lm, "FILTER_BYTES", 0)
    every = lm.fit(docs, ~held)
    assert every.model.least > 2
    want = sorted(tuple(r) for r in lm.score(docs.where("doc_id is not null"), every, held).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want] and len(got) > 10
    assert all(abs(a[6] - b[6]) <= math.log10(1.5) * a[2] + 1e-9 for a, b in zip(got, want))


@pytest.mark.parametrize("tokens", [1 << 22, 300_000])
def test_counts_leave_a_task_in_short_batches(monkeypatch, tokens):
    """All counts of a task in one batch are held by Java and Python at once; what is packed is whole, also if it goes in several turns."""
    monkeypatch.setattr(lm, "TOKENS", tokens, raising=False)
    numbers = np.random.default_rng(1).integers(10**6, size=(400, 2000))
    texts = [" ".join(map("w{}".format, line)) for line in numbers.tolist()]
    batches = [pa.record_batch([pa.array(texts[i:i + 40])], ["text"]) for i in range(0, 400, 40)]
    out = list(lm.count_task(iter(batches), 5))
    assert max(b.nbytes for b in out) <= 2 * common.BATCH_BYTES
    got = [r for b in lm.total_task(iter(pa.Table.from_batches(out).sort_by("bucket").to_batches())) for r in b.to_pylist()]
    buf, off = lm.text_buffer(pa.array(texts))
    _, tok, pair = lm.token_hashes(buf, off)
    for name, size, all_of in (("word", 8, tok), ("pair", 6, pair & lm.LOW)):
        h, n = (np.concatenate([passages.unplanes(r[f"{name}_{c}"], s) for r in got]) for c, s in (("h", size), ("n", 6)))
        want = np.unique(all_of, return_counts=True)
        assert all((a == b).all() for a, b in zip(lm.summed(h, n), want))
    assert len(got) == 5 and sum(r["tokens"] for r in got) == len(tok)


def test_model_gets_texts_in_short_batches(spark):
    docs, held = frame(spark, fuzz(23)), lm.fold()
    long = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("plain words "), 1000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    trained = lm.fit(docs, ~held)
    for use in (lambda: lm.fit(docs, ~held), lambda: lm.score(docs, trained, held)):
        spark.conf.unset(common.BATCH_CONF)
        use()
        got = long.mapInArrow(sizes, "rows long, size long").collect()
        assert sum(r.rows for r in got) == 2000 and max(r.size for r in got) <= 2 * common.BATCH_BYTES
    spark.conf.unset(common.BATCH_CONF)
