"""Source divergence audit (operator 12): CountVectorizer per language, group sums, sparse evaluation of pairs.

``CountVectorizer`` takes terms that carry their language, so that one fit
keeps, for each language, the terms in enough of its documents. Its vocabulary
passes through the driver and goes to every worker; so terms are dealt to
rounds by hash, with about ``VOCABULARY`` kept terms each at most (estimated
beforehand from a share of all terms), and every round has its own fit. However
large the vocabulary, none of it is left out and no round's share grows. Each text's
distinct terms, which is all that the fit needs, lie in a written table that all rounds read.

Tasks build each document's sparse vector over the fitted vocabulary, with exact
counts, and sum vectors by (language, source) before they leave. Sources of a language are compared on the terms that at least
one of the two has; terms that neither has add the same amount each. That takes
work in proportion to the entries and the sources, and emits no pairs of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import top_per_key
from .common import saved, shuffle_parts, slices, text_buffer
from .passages import starts_of

LEAST_DOCS, TOP = 30, 50
#: A term is a run of letters and of bytes from 0x80 on; all else becomes a space, and ASCII letters lower-case.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
#: Weights by which a share of all terms is picked.
WEIGHTS = np.array([crc32(bytes([b])) for b in range(256)], np.uint64)
#: What stands between language and term; no term holds it.
MARK = "\x00"
#: Kept terms of a round, the share of all terms that tells how many there are, and the largest vocabulary that Spark's parameter allows.
VOCABULARY, SHARE, NO_LIMIT = 1 << 18, 16, (1 << 31) - 1
#: Bytes of texts whose terms are cut, and leave a task, together.
SEND = 1 << 21
#: Entries that a task sums at a time, and cells of the matrix in which it compares sources.
ENTRIES, CELLS = 1 << 21, 1 << 21
SCALE, SMOOTH = 1_000_000_000, 5


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """The row of each term occurrence, and the terms themselves. No term goes over the end of its row."""
    clean = LETTERS[buf]
    solid = clean != 32
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(buf))]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    start = np.flatnonzero(first)
    borders = np.concatenate(([0], np.cumsum(np.flatnonzero(last) + 1 - start)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(borders), pa.py_buffer(clean[solid])])
    return np.searchsorted(off, start, side="right") - 1, words


def plain(words: pa.LargeBinaryArray) -> list[bytes]:
    """The terms as Python has them, cut out of one buffer: none holds a space or is empty."""
    if not len(words):
        return []
    buf, off = text_buffer(words)
    spaced = np.insert(buf, off[1:-1], 32)
    return spaced.tobytes().split(b" ")


def share_of(words: pa.LargeBinaryArray) -> np.ndarray:
    """Whether a term is among the one in ``SHARE``, by a sum over its bytes."""
    if not len(words):
        return np.zeros(0, bool)
    buf, off = text_buffer(words)
    return (np.add.reduceat(WEIGHTS[buf], off[:-1]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(SHARE) == 0


def split_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, terms, some): the distinct terms of each text, each led by its language and the mark, and those of one in ``SHARE`` words."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("terms", pa.list_(pa.string())), ("some", pa.list_(pa.string()))])
    for batch in batches:
        buf, off = text_buffer(batch.column(2))
        for a, z in slices(off, SEND):
            row, words = words_of(buf[off[a]:off[z]], off[a:z + 1] - off[a])
            coded = words.dictionary_encode()
            key = np.sort(row << 32 | np.asarray(coded.indices))
            key = key[starts_of(key)]
            row, word = key >> 32, key & 0xFFFFFFFF
            leads = pa.array([(lang + MARK).encode() for lang in batch.column(0).slice(a, z - a).to_pylist()], pa.large_binary())
            terms = pc.binary_join_element_wise(leads.take(pa.array(row)), coded.dictionary.take(pa.array(word)), pa.scalar(b"", pa.large_binary()))
            terms = terms.cast(pa.binary()).cast(pa.string())
            some = share_of(coded.dictionary)[word]
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(r, minlength=z - a)))), pa.int32()), t)
                     for r, t in ((row, terms), (row[some], terms.filter(pa.array(some))))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a), *lists], schema=schema)


def rounds_of(docs: DataFrame, least_docs: int, most: int) -> int:
    """How many shares of the terms hold about ``most`` kept ones each, judged by one in ``SHARE``."""
    kept = docs.select(F.explode("some").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs).count() * SHARE
    return max(1, -(-kept // most))


def by_language(vocabulary: list[str]) -> dict[str, dict[bytes, int]]:
    """The place of each term in the vocabulary, for each language."""
    out: dict[str, dict[bytes, int]] = {}
    for i, term in enumerate(vocabulary):
        lang, _, word = term.rpartition(MARK)
        out.setdefault(lang, {})[word.encode()] = i
    return out


PACKED = "bucket int, groups array<struct<lang:string,source:string>>, owner binary, term binary, count binary"


def summed_vectors(batches: Iterator[pa.RecordBatch], places: dict[str, dict[bytes, int]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each document's sparse vector, summed by (lang, source) a share of the input at a time; a packed row for each bucket of terms."""
    names: dict[tuple[str, str], int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        key, count = summed(held)
        groups = [{"lang": g[0], "source": g[1]} for g in names]
        owner, term = key >> 32, key & 0xFFFFFFFF
        bucket = term % buckets
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
        rows = [(int(bucket[at[0]]), groups, owner[at].astype("<u4").tobytes(), (term[at] // buckets).astype("<u4").tobytes(), count[at].astype("<i8").tobytes())
                for at in np.split(order, edge[1:])]
        kinds = (pa.int32(), pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())])), *[pa.binary()] * 3)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["bucket", "groups", "owner", "term", "count"])

    for batch in batches:
        buf, off = text_buffer(batch.column(2))
        owners = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for a, z in slices(off, SEND):
            row, words = words_of(buf[off[a]:off[z]], off[a:z + 1] - off[a])
            langs = {lang: i for i, lang in enumerate(dict.fromkeys(g[0] for g in owners[a:z]))}
            spoken = np.array([langs[g[0]] for g in owners[a:z]])[row]
            code = np.array([names.setdefault(g, len(names)) if g[0] in places else 0 for g in owners[a:z]], np.int64)[row]
            for lang, i in langs.items():
                if lang not in places:
                    continue
                mine = spoken == i
                coded = words.filter(pa.array(mine)).dictionary_encode()
                place = np.fromiter(map(places[lang].get, plain(coded.dictionary), repeat(-1)), np.int64, len(coded.dictionary))[np.asarray(coded.indices)]
                kept = place >= 0
                if kept.any():
                    key = np.sort(code[mine][kept] << 32 | place[kept])
                    edge = np.flatnonzero(starts_of(key))
                    held.append((key[edge], np.diff(np.append(edge, len(key)))))
                    size += len(edge)
            if size >= ENTRIES:
                held = [summed(held)]
                size = len(held[0][0])
                if size >= ENTRIES // 2:
                    yield out()
                    names, held, size = {}, [], 0
    if held:
        yield out()


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts, in whole numbers."""
    key, count = (np.concatenate([h[i] for h in held]) for i in range(2))
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[edge], np.add.reduceat(count, edge)


def group_sums(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count) out of the packed rows; rows come sorted by bucket."""
    now, names, held = None, {}, []

    def out() -> pa.RecordBatch:
        key, count = summed(held)
        groups, owner = list(names), pa.array(key >> 32)
        lang, source = (pa.array([g[i] for g in groups], pa.string()).take(owner) for i in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, pa.array((key & 0xFFFFFFFF) * buckets + now), pa.array(count)], ["lang", "source", "term", "count"])

    for batch in batches:
        for i, bucket in enumerate(batch.column(0).to_pylist()):
            if bucket != now and held:
                yield out()
                names, held = {}, []
            now, row = bucket, batch.slice(i, 1).to_pylist()[0]
            codes = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in row["groups"]], np.int64)
            held.append((codes[np.frombuffer(row["owner"], "<u4")] << 32 | np.frombuffer(row["term"], "<u4"), np.frombuffer(row["count"], "<i8")))
    if held:
        yield out()


def counted(texts: DataFrame, docs: DataFrame, least_docs: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, count) of all kept terms, and (term, item, lang); a term's number holds for one language."""
    spark = docs.sparkSession
    shares, names, buckets = [], [], shuffle_parts(spark)
    rounds = rounds_of(docs, least_docs, most)
    for r in range(rounds):
        own = docs if rounds == 1 else docs.withColumn(
            "terms", F.filter("terms", lambda t: F.pmod(F.shiftright(F.xxhash64(t), 16), F.lit(rounds)) == r))
        vocabulary = CountVectorizer(inputCol="terms", outputCol="vector", minDF=least_docs, vocabSize=NO_LIMIT).fit(own).vocabulary
        number = F.col("term") * rounds + r
        if vocabulary:
            shared = spark.sparkContext.broadcast(by_language(vocabulary))  # about VOCABULARY terms
            packed = texts.mapInArrow(lambda it, b=shared: summed_vectors(it, b.value, buckets), PACKED)
            sums = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
                lambda it: group_sums(it, buckets), "lang string, source string, term long, count long")
            shares.append(sums.withColumn("term", number))
            names.append(spark.createDataFrame(list(enumerate(vocabulary)), "term long, text string").withColumn("term", number))
    if not shares:
        return (spark.createDataFrame([], "lang string, source string, term long, count long"),
                spark.createDataFrame([], "term long, item string, lang string"))
    rows, named = shares[0], names[0]
    for share, more in zip(shares[1:], names[1:]):
        rows, named = rows.union(share), named.union(more)
    # The language ends at the last mark.
    item = F.substring_index("text", MARK, -1)
    named = named.select("term", item.alias("item"), F.col("text").substr(F.lit(1), F.length("text") - F.length(item) - 1).alias("lang"))
    return saved(rows, "divergence-counts"), saved(named, "divergence-names")


def chance(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH kept)) in whole numbers."""
    wide = ((count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"))
    under = (total + SMOOTH * kept).cast("decimal(20,0)")
    # The quotient of whole numbers: the remainder goes first, so that the division is exact.
    return (F.lit(1) + ((wide - wide % under) / under)).cast("long")


def source_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, own, both, shared): over a share of the terms, for each ordered pair of sources (by their numbers)

    ``own``: the sum of |p - q| over a's terms; ``both``: the same over terms that b has too; ``shared``: their number.
    Rows are (lang, block, term, code, p) in this order; those with a NULL term come first and give p of terms not counted.
    """
    lang, block, zero = None, None, []
    base = np.zeros(0, np.int64)
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("own", pa.int64()), ("both", pa.int64()), ("shared", pa.int64())])

    def out() -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        term, code, p = (np.concatenate([r[i] for r in rows]) for i in range(3))
        rows.clear()
        fresh = np.concatenate(([True], term[1:] != term[:-1]))
        line = np.cumsum(fresh) - 1
        step, count = max(1, CELLS // len(base)), int(line[-1]) + 1
        sums = {}
        for begin in range(0, count, step):
            lo, hi = np.searchsorted(line, [begin, min(begin + step, count)])
            at, who = line[lo:hi] - begin, code[lo:hi]
            matrix = np.tile(base, (min(step, count - begin), 1))
            there = np.zeros(matrix.shape, bool)
            matrix[at, who], there[at, who] = p[lo:hi], True
            for a in np.unique(who).tolist():
                mine = np.flatnonzero(there[:, a])
                apart = np.abs(matrix[mine] - matrix[mine, a][:, None])
                with_b = there[mine]
                found = np.stack((apart.sum(axis=0), (apart * with_b).sum(axis=0), with_b.sum(axis=0)))
                sums[a] = sums[a] + found if a in sums else found
        for a, found in sums.items():
            n = len(base)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, a, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                                              *(pa.array(f.astype(np.int64)) for f in found)], schema=schema)

    for batch in batches:
        langs, blocks, term, code, p = batch.columns
        key = np.array([f"{x}\x00{y}" for x, y in zip(langs.to_pylist(), blocks.to_pylist())], dtype=object)
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
        for begin, end in zip(edges[:-1], edges[1:]):
            if (langs[begin].as_py(), blocks[begin].as_py()) != (lang, block):
                yield from out()
                lang, block, base = langs[begin].as_py(), blocks[begin].as_py(), np.zeros(0, np.int64)
            cut = slice(begin, end)
            head = np.array(term.is_null())[cut]
            values, codes = np.array(p)[cut], np.array(code)[cut]
            base = np.concatenate((base, values[head]))
            if not head.all():
                rows.append((np.array(term.fill_null(-1))[cut][~head], codes[~head], values[~head]))
            # What is held stays bounded: whole terms leave, the last one may go on.
            if sum(len(r[0]) for r in rows) >= ENTRIES:
                last = rows[-1][0] == rows[-1][0][-1]
                rest = tuple(c[last] for c in rows[-1])
                rows[-1] = tuple(c[~last] for c in rows[-1])
                if all((r[0] != rest[0][0]).all() for r in rows):
                    yield from out()
                rows.append(rest)
    yield from out()


def audit(df: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, vocabulary: int = VOCABULARY) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and its most marked terms.

    ``pair`` rows hold the sum of differences of smoothed term probabilities to
    each other source, ``term`` rows the ``top`` terms above the language's
    own probability; whole numbers throughout. NULL text, language and source
    are ''. A language without kept terms has pairs of value 0 and no terms; a
    lone source has no pairs; empty texts still make a group; an empty table
    gives no rows. A text of any length is one list of terms. Repeated rows
    count each. Other columns are ignored.
    """
    spark = df.sparkSession
    blank = F.lit("")
    texts = df.select(*[F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("lang", "source", "text")])
    docs = saved(texts.mapInArrow(split_terms, "lang string, source string, terms array<string>, some array<string>"), "divergence-terms")
    counts, names = counted(texts, docs, least_docs, vocabulary)

    kept = names.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("has"))
    every = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("has", F.lit(0)).alias("has"), F.coalesce("v", F.lit(0)).alias("v"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("code"))
    groups = saved(every, "divergence-groups")
    found = saved(counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "code", "term", "count", chance(F.col("count"), F.col("n"), F.col("v")).alias("p")), "divergence-entries")

    # Pairs: each block of terms meets the probabilities of absent terms of all sources of its language.
    blocks = max(1, -(-found.count() // ENTRIES))  # as many as there are shares of entries: each gives a row a pair
    none = chance(F.lit(0).cast("long"), F.col("n"), F.col("v"))
    heads = groups.where("v > 0").select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                                         F.lit(None).cast("long").alias("term"), "code", none.alias("p"))
    rows = heads.union(found.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"), "term", "code", "p"))
    shares = (rows.repartition("lang", "block").sortWithinPartitions("lang", "block", F.asc_nulls_first("term"), "code")
                  .mapInArrow(source_pairs, "lang string, a int, b int, own long, both long, shared long"))
    sums = shares.where("a <> b").groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("own", "both", "shared")])

    def side(name: str, code: str) -> DataFrame:
        absent = F.when(F.col("v") > 0, none).otherwise(0)
        return groups.select("lang", F.col("source").alias(name), F.col("code").alias(code), F.col("has").alias(f"has_{code}"),
                             F.col("v").alias(f"v_{code}"), absent.alias(f"zero_{code}"))

    both = side("source", "a").join(side("item", "b"), "lang").where("a <> b")
    back = sums.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("own").alias("other"))
    full = both.join(sums, ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left").fillna(0, ["own", "both", "shared", "other"])
    absent = F.col("v_a") - F.col("has_a") - F.col("has_b") + F.col("shared")
    value = F.col("own") + F.col("other") - F.col("both") + absent * F.abs(F.col("zero_a") - F.col("zero_b"))
    pair = full.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    ranked = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    whole = counts.groupBy("lang", "term").agg(F.sum("count").alias("all"))
    lang_total = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.max("v").alias("v"))
    own = whole.join(lang_total, "lang").join(names.select("term", "item"), "term").select(
        "lang", "term", "item", chance(F.col("all"), F.col("lang_n"), F.col("v")).alias("q"))
    above = found.join(own, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value"))
    best = top_per_key(above, ["lang", "source"], order, top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return ranked.union(best.select(ranked.columns))
