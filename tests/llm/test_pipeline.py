"""The corpus pipeline, stage by stage, against brute force on whole small tables."""

import collections
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetscope.llm import common, langid, mixing, queries
from tests.llm.test_text_operators import key, reference_fingerprint, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The given documents and odd ones: NULLs, no letters, exact and near copies, shared passages, clashing columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").limit(12).collect()]
    odd = [(9000, None), (9001, ""), (9002, "12 !! 34"), (9003, texts[0]), (9004, texts[0]), (9005, texts[1] + " end"),
           (9006, texts[2][:400] + " " + texts[3][-400:]), (9007, texts[4] + "\n" + texts[5]), (None, texts[6][:300]), (None, None)]
    more = spark.createDataFrame([(i, t, None, None if i is None else "new", 1) for i, t in odd], docs.schema.simpleString()[7:-1].replace(":", " "))
    for name in ("id", "key", "size", "repeats", "fp", "row", "_src", "component_id"):
        docs, more = docs.withColumn(name, F.lit("x")), more.withColumn(name, F.lit("x"))
    out = str(tmp_path_factory.mktemp("corpus"))
    docs.unionByName(more).repartition(5).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.fixture(scope="module")
def staged(spark, folder, tmp_path_factory):
    """What each stage gets, and what the last one returns."""
    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, tables[-1], folder).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=key)


def test_columns_stay(staged):
    assert all(t.columns == staged[0].columns for t in staged[1:-1])
    assert staged[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_language_stage_keeps_what_the_classifier_can_tell(staged):
    packer = langid.Packer(list(langid.fit(staged[0], langid.training_rows()).items()))
    want = [(i, t) for i, t in pairs(staged[0]) if t is not None and not packer.classify(t)[2]]
    assert pairs(staged[1]) == want
    assert not {9000, 9001, 9002} & {i for i, _ in want} and len(want) > 0.9 * staged[0].count()


def test_near_copies_leave_one(staged):
    rows = pairs(staged[1])
    fp, group = [reference_fingerprint(t) for _, t in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4 and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = [(i, t) for g, (i, t) in zip(group, rows) if i is None or i == least[g]]
    assert pairs(staged[2]) == want and not {9003, 9004} & {i for i, _ in want}


def test_repeated_passages_go(staged):
    rows = [(i, t.encode()) for i, t in pairs(staged[2])]
    first, size = {}, 50
    for i, b in rows:
        if i is not None:
            for p in range(len(b) - size + 1):
                first[b[p:p + size]] = min(i, first.get(b[p:p + size], i))
    want = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1 if i is not None else 0):
            if first[b[p:p + size]] < i:
                gone[p:p + size] = True
        want.append((i, bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore")))
    assert pairs(staged[3]) == sorted(want, key=key) and want != [(i, b.decode()) for i, b in rows]
    assert all(r.n_chars == len(r.text) for r in staged[3].collect())


def test_mix_takes_each_source_to_its_target(staged):
    sizes, lengths, taken = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for r in staged[3].collect():
        sizes[r.source].append(len(r.text.encode().split()))
        lengths[r.doc_id, r.text] += 1
    for r in staged[4].collect():
        taken[r.source] += len(r.text.encode().split())
    target = mixing.budgets([(s, sum(n)) for s, n in sizes.items()])
    for s, n in sizes.items():
        total = sum(n)
        whole = min(3, int(target[s] // total)) if total else 0
        rest = round(target[s]) - whole * total
        sums = 1  # bit k: some documents have k words together
        for size in n:
            sums |= sums << size
        best = (sums & ((1 << rest + 1) - 1)).bit_length() - 1
        assert rest < mixing.RESERVE and taken[s] == whole * total + best, (s, target[s], taken[s], best)
    times = collections.Counter(pairs(staged[4]))
    assert set(times) <= set(lengths) and all(n <= 3 * lengths[k] for k, n in times.items())


def test_tokens_of_what_is_left(staged):
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(queries.tokenizer_path()), []
    for i, t in pairs(staged[4]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert rows_of(staged[5]) == sorted(want, key=key)


def test_run_chains_the_stages(spark, folder, staged):
    assert rows_of(corpus_pipeline.run(spark, folder)) == rows_of(staged[5])


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_workers_get_texts_in_short_batches(spark):
    """A task's whole share of the texts in one batch is held by Java and Python several times over, and stays with the executor."""
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("plain words "), 1000).alias("text"))
    spark.conf.unset(common.BATCH_CONF)
    langid.keep_identified(docs, {"en": b"plain words"})

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    got = docs.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r.rows for r in got) == 2000 and max(r.size for r in got) <= 2 * common.BATCH_BYTES
    spark.conf.set(common.BATCH_CONF, "100000")
    assert langid.keep_identified(docs, {"en": b"plain words"}).count() == 2000
    assert spark.conf.get(common.BATCH_CONF) == "100000"
    spark.conf.unset(common.BATCH_CONF)


def test_few_rows_of_the_driver_need_no_worker(spark, staged, monkeypatch):
    """Lists go through Python workers of another kind, which executors keep beside the others."""
    def no(*_, **__):
        raise AssertionError("rows went through Python workers")

    want, taken = langid.fit(staged[0], langid.training_rows()), sorted(map(str, mixing.mix(staged[3]).collect()))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", no)
    assert langid.fit(staged[0], langid.training_rows()) == want and len(want) > 1
    assert langid.fit(staged[0].limit(0), langid.training_rows()) == {}
    assert sorted(map(str, mixing.mix(staged[3]).collect())) == taken and mixing.mix(staged[3].limit(0)).collect() == []
