"""The Merkle manifest against a plain Python version."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
import small
from pyspark.sql import functions as F

from relweave.llm import manifest


def h(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text) -> str:
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def grown(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels: list[list[str]], place: int) -> list[tuple]:
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        out.append((level[other] if other < len(level) else None, place % 2))
        place //= 2
    return out


def brute(rows: list[tuple]) -> list[tuple]:
    """Of rows (doc_id, text, lang, source, n_chars): what the query returns."""
    by_lang = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        claimed = leaf_of(doc_id, source, lang, n_chars, text)
        if doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
            claimed = leaf_of(doc_id, source, lang, n_chars + 1, text)
        by_lang[lang].append(((doc_id is not None, doc_id), leaf_of(doc_id, source, lang, n_chars, text), claimed))
    langs = sorted(by_lang, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort()
        trees[lang] = grown([leaf for _, leaf, _ in by_lang[lang]])
    top = grown([trees[lang][-1][0] for lang in langs])
    out = []
    for g, lang in enumerate(langs):
        for place, (known, leaf, claimed) in enumerate(by_lang[lang]):
            steps = path(trees[lang], place) + path(top, g)
            node = claimed
            for partner, odd in steps:
                node = h(node) if partner is None else h(partner, node) if odd else h(node, partner)
            out.append((known[1], leaf, trees[lang][-1][0], top[-1][0], h(*[p for p, _ in steps if p]), node, node == top[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, node string, position int, total string, group string"


def proved(spark, rows, bits=manifest.BLOCK_BITS):
    documents = spark.createDataFrame([(*r, "a", "b", 1, "c", "d") for r in rows], FIELDS).repartition(3)
    claimed = F.when(
        F.crc32(F.col("doc_id").cast("string")) % 7 == 0, manifest.leaf_hash(n_chars=(F.col("n_chars").cast("decimal(20,0)") + 1).cast("string"))
    ).otherwise(manifest.leaf_hash())
    return manifest.proofs(manifest.leaves(documents, claimed), bits)


def check(spark, rows, bits=manifest.BLOCK_BITS):
    found = proved(spark, rows, bits)
    assert found.columns == COLUMNS
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(rows)))


def test_odd_rows(spark):
    rows = [r[:5] for r in small.odd_rows()] + [
        (50, "x", "", None, 3), (51, "x", "é", "s", None), (52, "y", "𐍈", "s", 1), (53, "y", "ｚ", "s", 1), (None, None, None, None, None),
        (54, "z", "en", "-", (1 << 63) - 1), (55, "z", "en", "", (1 << 63) - 1), (7, "other", "en", "s", 1),
    ]
    check(spark, rows)


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_trees_of_many_superblocks(spark, bits):
    sizes = {"a": 1, "b": 2, "c": 3, None: 4, "d": 33, "e": 1 << 5, "f": 71}
    rows = [(i * 1000 + k, f"t{k}", lang, "s", k) for i, (lang, n) in enumerate(sizes.items()) for k in range(n)]
    check(spark, rows, bits)


def test_many_languages(spark):
    check(spark, [(k, None, f"l{k}", "s", 1) for k in range(45)], 2)


def test_summary_and_empty_table(spark):
    rows = [(k, f"t{k}", "ab"[k % 2], "s", k) for k in range(9)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    expected = {(r[2], r[3]) for r in brute(rows)}
    found = manifest.summary(documents, 2).collect()
    assert {(r.subroot, r.root) for r in found} == expected and {(r.lang, r.n_documents) for r in found} == {("a", 5), ("b", 4)}
    assert proved(spark, []).count() == 0 and manifest.summary(documents.where("false")).count() == 0


def test_no_partner_passes_for_another(spark):
    """A claimed leaf that is not the document's never folds to the root."""
    documents = spark.createDataFrame([(k, "t", "a", "s", k) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = manifest.proofs(manifest.leaves(documents, manifest.leaf_hash(text=F.lit("u"))), 2).collect()
    assert len(rows) == 20 and not any(r.verified or r.folded_root == r.root for r in rows)
