"""One query for each training-data operator, over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, divergence, fingerprints, langid, lm, merkle, mixing, simhash, substring, suffix, tokens, topk

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = VOCABULARY) -> str:
    """The place of a public vocabulary; every worker has the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.fit(docs, ~lm.fold()), lm.fold())


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeated_words(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, langid.training_rows()))
    return found.select("doc_id", (~langid.training_rows()).alias("held_out"), "lang_pred", "score", "rejected")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_exact_top_k, op2_source_mix, op3_bpe_roundtrip, op4_lm_score, op5_simhash_dedup, op6_nearest_neighbours,
    op7_substring_dedup, op8_token_counts, op9_language_id, op10_suffix_dedup, op11_merkle_manifest, op12_source_divergence,
    op13_document_fingerprints)}

ORACLE: dict[str, str] = {
    "op1_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
            from embeddings
            where embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
        scored as (
            select q.vec_id as query_id, c.vec_id,
              cast(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) as bigint) as score
            from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
        ranked as (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 10""",
    "op11_merkle_manifest": """
        with recursive leaves as (
            select *, row_number() over (order by g, idx) as rid from (
                select doc_id, g, leaf, changed, bits % 3 = 0 and doc_id is not null as touched,
                  row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx
                from (
                    select doc_id, coalesce('=' || lang, '') as g,
                      sha256(start || coalesce(strlen(text) || ':' || text, '-')) as leaf,
                      sha256(start || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) as changed,
                      xor(list_reduce(list_concat([4294967295::ubigint], flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), ''), ''),
                          lambda c: [ord(c)::ubigint, 0, 0, 0, 0, 0, 0, 0]))),
                        lambda crc, byte: case when xor(crc, byte) & 1 = 1 then xor(xor(crc, byte) >> 1, 3988292384::ubigint) else xor(crc, byte) >> 1 end),
                        4294967295::ubigint) as bits
                    from (select *, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as start
                          from documents)))),
        nodes as (
            select 0 as level, g, idx, leaf as h from leaves
            union all
            select level + 1, g, idx // 8, sha256(string_agg(h, '' order by idx))
            from (select *, count(*) over (partition by g) as n from nodes) where n > 1 group by level, g, idx // 8),
        subroots as (select g, h, row_number() over (order by g) - 1 as idx from (select g, arg_max(h, level) as h from nodes group by g)),
        over_ as (
            select 0 as level, idx, h from subroots
            union all
            select level + 1, idx // 8, sha256(string_agg(h, '' order by idx))
            from (select *, count(*) over () as n from over_) where n > 1 group by level, idx // 8),
        kids as (
            select level, g, idx // 8 as run, list(h order by idx) as k
            from (select *, count(*) over (partition by level, g) as n from nodes) where n > 1 group by level, g, idx // 8),
        over_kids as (
            select level, idx // 8 as run, list(h order by idx) as k
            from (select *, count(*) over (partition by level) as n from over_) where n > 1 group by level, idx // 8),
        up as (
            select rid, g, 0 as level, idx, case when touched then changed else leaf end as h, '' as proof from leaves
            union all
            select u.rid, u.g, u.level + 1, u.idx // 8,
              sha256(array_to_string(k[1:u.idx % 8], '') || u.h || array_to_string(k[u.idx % 8 + 2:], '')),
              u.proof || array_to_string(k[1:u.idx % 8], '') || array_to_string(k[u.idx % 8 + 2:], '')
            from up u join kids on kids.g = u.g and kids.level = u.level and kids.run = u.idx // 8),
        top as (
            select l.rid, 0 as level, s.idx, l.h, l.proof
            from (select rid, g, arg_max(h, level) as h, arg_max(proof, level) as proof from up group by rid, g) l join subroots s using (g)
            union all
            select t.rid, t.level + 1, t.idx // 8,
              sha256(array_to_string(k[1:t.idx % 8], '') || t.h || array_to_string(k[t.idx % 8 + 2:], '')),
              t.proof || array_to_string(k[1:t.idx % 8], '') || array_to_string(k[t.idx % 8 + 2:], '')
            from top t join over_kids on over_kids.level = t.level and over_kids.run = t.idx // 8),
        root as (select arg_max(h, level) as root from over_),
        ends as (select rid, arg_max(h, level) as folded_root, arg_max(proof, level) as proof from top group by rid)
        select l.doc_id, l.leaf, s.h as subroot, root.root, sha256(proof) as proof_sha256, folded_root, folded_root = root.root as verified
        from leaves l join ends using (rid) join subroots s using (g), root""",
    "op12_source_divergence": """
        with words as (
            select doc_id, rid, lang, source, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
            from (select doc_id, row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents)),
        kept as (select lang, term from words group by lang, term having count(distinct rid) >= 30),
        v as (select lang, count(*) as v from kept group by lang),
        groups as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
        held as (select w.lang, w.source, w.term, count(*) as c from words w join kept using (lang, term) group by all),
        cells as (select g.lang, g.source, k.term, coalesce(h.c, 0) as c from groups g join kept k using (lang) left join held h using (lang, source, term)),
        total as (select lang, source, sum(c) as n from cells group by all),
        p as (
            select lang, source, term, c, cast(1 + cast(1000000000 as hugeint) * (c + 5) // (n + 5 * v) as bigint) as p
            from cells join total using (lang, source) join v using (lang)),
        whole as (select lang, term, sum(c) as c from cells group by all),
        q as (
            select lang, term, cast(1 + cast(1000000000 as hugeint) * (c + 5) // (n + 5 * v) as bigint) as q
            from whole join (select lang, sum(c) as n from whole group by lang) using (lang) join v using (lang)),
        pair as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(d.value, 0) as value
            from groups a join groups b on a.lang = b.lang and a.source <> b.source
            left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
                       from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) d
              on d.lang = a.lang and d.source = a.source and d.item = b.source),
        term as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where c > 0 and p > q),
        ranked as (
            select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
            from (select * from pair union all select * from term))
        select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
        from ranked where part = 'pair' or rank <= 50""",
}
