"""Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest

from fleetscope.llm import merkle
from tests.llm.test_text_operators import frame, fuzz


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text) -> str:
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(tree, at, arity):
    out = []
    for level in tree[:-1]:
        run = level[at // arity * arity:][:arity]
        out.append(("".join(run[:at % arity]), "".join(run[at % arity + 1:])))
        at //= arity
    return out


def plain(rows, arity=8):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    trees = {}
    for lang, own in langs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[lang] = levels([leaf(r, r[4]) for r in own], arity)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    top = levels([trees[x][-1][0] for x in order], arity)
    root = top[-1][0]
    for n, lang in enumerate(order):
        for i, r in enumerate(langs[lang]):
            steps, h = siblings(trees[lang], i, arity) + siblings(top, n, arity), leaf(r, r[4])
            own = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                h = leaf(r, "".join(c.lower() if c.isascii() else c for c in r[4]))
            for before, behind in steps:
                h = digest(before + h + behind)
            yield r[0], own, trees[lang][-1][0], root, digest("".join(b + a for b, a in steps)), h, h == root


@pytest.mark.parametrize("arity, copies", [(8, 1), (2, 1), (3, 2)])
def test_manifest(spark, arity, copies):
    """NULL ids, texts and languages, repeated ids and rows, one language with a lone document."""
    rows = fuzz(arity) * copies + [(9_000, "Alone Ä"), (9_001, None), (9_002, "")]
    df = frame(spark, rows)
    df = df.replace({"en": "zz"}, subset="lang").withColumn("lang", merkle.F.when(df.doc_id == 9_000, "Ω").otherwise(merkle.F.col("lang")))
    full = [tuple(r[f] for f in merkle.FIELDS) for r in df.collect()]
    got = merkle.manifest(df, arity=arity).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(full, arity)))
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_one_document_and_none(spark):
    lone = frame(spark, [(1, "A b")])
    got, = merkle.manifest(lone).collect()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == digest("")
    assert merkle.manifest(lone.where("doc_id > 1")).collect() == []
    assert merkle.manifest(lone.where("doc_id > 1")).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_any_rows_can_be_tampered_with(spark):
    df = frame(spark, [(i, f"Text {i}") for i in range(30)])
    got = merkle.manifest(df, merkle.F.col("doc_id") == 7).collect()
    assert [r.doc_id for r in got if not r.verified] == [7]
