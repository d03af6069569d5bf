"""Ranked lexical search against a plain Python version."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import small

from relweave.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text: str | None) -> list[str]:
    return [t.translate(_LOWER) for t in TERM.findall(text or "")]


def brute(documents: list[tuple], items: list[tuple], k: int) -> set[tuple]:
    bags = [(i, Counter(terms(t))) for i, t in documents]
    held = [sum(b.values()) for _, b in bags]
    n_all, l_all = sum(n > 0 for n in held), sum(held)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = set()
    for item, mine in wanted.items():
        found = []
        for (i, bag), n in zip(bags, held, strict=True):
            m = 50 + 50 * n * n_all // max(l_all, 1)
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in mine if t in bag)
            if score > 0:
                found.append((-score, i is None, i))
        out |= {(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)}
    return out


def found(spark, documents, items, k, **options) -> set[tuple]:
    docs = spark.createDataFrame([(*d, 1, 2) for d in documents], "doc_id long, text string, score int, code int").repartition(3)
    queries = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, rank int")
    rows = lexical.ranked(docs, queries, k, **options)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"] and dict(rows.dtypes)["rank"] == "int"
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len({r[:2] for r in got})
    return set(got)


DOCUMENTS = [(r[0], r[1]) for r in small.odd_rows()] + [(100 + i, small.prose(100 + i % 40, 5 + 7 * (i % 30))) for i in range(150)]
ITEMS = [
    (1, small.prose(1, 60)), (2, "ther TION, one"), (3, None), (4, ""), (5, "?!"), (6, "nothingofthis"), (7, "le"), (8, "é€𐍈"), (None, "two"),
    (9, "one"), (9, "two ther"), (10, small.prose(2, 4000)),
]


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_odd_rows(spark, k):
    assert found(spark, DOCUMENTS, ITEMS, k) == brute(DOCUMENTS, ITEMS, k)


def test_items_in_blocks(spark):
    items = [(i, small.prose(i, 9)) for i in range(30)]
    assert found(spark, DOCUMENTS, items, 3, block_terms=50) == brute(DOCUMENTS, items, 3)


def test_empty_tables(spark):
    assert found(spark, [], ITEMS, 5) == set() and found(spark, DOCUMENTS, [], 5) == set()
    assert found(spark, [(1, None), (2, "")], ITEMS, 5) == set() and found(spark, DOCUMENTS, [(1, None)], 5) == set()


def shard(documents: int, n_terms: int) -> lexical.Vectors:
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(n_terms, rng.integers(0, 12), replace=False)) + (d % 2) * n_terms for d in range(documents)]
    first = np.cumsum([0, *map(len, rows)])
    return lexical.Vectors(np.arange(documents), np.zeros(documents, bool), first, np.concatenate(rows), rng.integers(1, 10**10, int(first[-1])))


@pytest.mark.parametrize("groups", [None, 1, 7])
def test_bounds_hold_and_trees_are_pruned(groups):
    v = shard(900, 60)
    tree = lexical.BallTree(v, 120, leaf=4, groups=groups)
    assert sorted(tree.v.id) == [i for i in range(900) if v.first[i + 1] > v.first[i]]
    rng, opened = np.random.default_rng(4), 0
    for _ in range(20):
        mine = np.sort(rng.choice(60, 6, replace=False))
        wanted = np.isin(np.arange(120), mine).astype(np.int64)
        scores = np.array([int((tree.v.value[a:b] * wanted[tree.v.term[a:b]]).sum()) for a, b in zip(tree.v.first[:-1], tree.v.first[1:], strict=True)])
        bounds = tree.bounds(mine)
        assert all(bounds[n] >= scores[tree.begin[n] : tree.end[n]].max(initial=-1) for n in range(len(bounds)))
        best = lexical.Best(5)
        opened += tree.search(mine, best)
        order = np.lexsort((tree.v.id, -scores))[:5]
        assert best.id.tolist() == tree.v.id[order].tolist() and best.score.tolist() == scores[order].tolist()
    assert opened < 20 * (tree.leaves + 1) * (0.6 if groups is None else 0.95)  # the documents of the other terms are never looked at


def test_long_texts_are_cut_between_terms(monkeypatch):
    import pyarrow as pa

    text = small.prose(9, 400)
    batch = pa.record_batch([pa.array(["a b", text, None, "z" * 300, text])], ["text"])
    counted = Counter()
    for row, texts in lexical.pieces(batch, limit=100):
        words = lexical.words_of(texts)
        for i in range(len(texts.offsets) - 1):
            counted[row + i] += int(words.first[i + 1] - words.first[i])
    assert [counted[i] for i in range(5)] == [2, len(terms(text)), 0, 1, len(terms(text))]
