"""Near duplicates, paragraphs, vectors and repeated substrings against brute force."""

import hashlib
import tempfile
from pathlib import Path

import numpy as np
import pytest
import small

from relweave.llm import embeddings, near_duplicates, paragraphs, repeated_substrings
from relweave.llm.shingles import Bags
from relweave.session import application_folder


def test_signatures_estimate_weighted_similarity():
    pick = np.random.default_rng(5)
    codes = pick.integers(1, 1 << 62, 300).astype(np.uint64)
    left, right = pick.integers(0, 9, 300), pick.integers(0, 9, 300)
    left[:3], right[:3] = (1000, 3, 70), (700, 90, 70)
    text = np.repeat([0, 1], 300)
    both = np.concatenate([left, right])
    bag = Bags(text[both > 0], np.tile(codes, 2)[both > 0], both[both > 0])
    size = 4000
    signature, filled = near_duplicates.signatures(bag, 2, size)
    truth = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    assert filled.all() and abs((signature[0] == signature[1]).mean() - truth) < 4 * np.sqrt(truth * (1 - truth) / size)


def check_classes(rows, texts):
    expected = small.classes(small.near_links(texts), texts)
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == expected
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in rows)


def test_near_duplicates(spark, odd, none):
    texts = {r[0]: r[1] for r in small.odd_rows() if r[0] is not None}
    rows = near_duplicates.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    check_classes(rows, texts)
    left = near_duplicates.deduplicate(odd)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == odd.columns and ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == sorted({c for c in small.classes(small.near_links(texts), texts).values()})
    assert near_duplicates.near_duplicates(none).count() == 0 and near_duplicates.deduplicate(none).count() == 0


def test_graded_copies_lose_no_link(spark):
    """Copies ever further from one text meet in buckets without all being linked."""
    base = small.prose(11, 150)
    pick = np.random.default_rng(1)
    rows = [(i, small.edited(base, pick.choice(150, i % 14, replace=False).tolist())) for i in range(150)]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_classes(found, dict(rows))


def test_documents_table(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    check_classes(near_duplicates.near_duplicates(documents).collect(), texts)


def removed_lines(docs):
    places, sets = [], {}
    for i, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            w = tuple(small.words(line))
            if len(w) >= paragraphs.LEAST_WORDS:
                places.append((i, n, w))
                sets[w] = frozenset(w[k : k + 5] for k in range(len(w) - 4))
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    of, seen, gone = small.classes(links, sets), set(), {}
    for i, n, w in sorted(places, key=lambda p: (p[0] is None, p[0] or 0, p[1])):
        gone.setdefault(i, [])
        if of[w] in seen:
            gone[i].append(n)
        seen.add(of[w])
    return gone


def test_paragraphs_remove_what_is_superseded(spark, odd):
    """The bands and what classes were made from do not stay until the passages are written."""
    paragraphs.repeated_paragraphs(odd).collect()
    left = {path.name.rsplit("-", 1)[0] for path in Path(application_folder(spark).removeprefix("file:")).iterdir()}
    assert "llm-passages" in left and not left & {"llm-paragraph-bands", "llm-paragraph-buckets", "llm-paragraph-texts"}


def test_paragraphs(spark, odd, none):
    docs = [(r[0], r[1]) for r in small.odd_rows() if r[0] != 15] + [(15, small.prose(5, 200))]
    docs = [d for d in docs if d != (None, None)]
    expected = removed_lines(docs)
    rows = paragraphs.repeated_paragraphs(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r.removed for r in rows if r.n_paragraphs or r.doc_id is not None}
    assert got == {i: ",".join(map(str, expected.get(i, []))) for i, _ in docs}
    assert all(r.n_removed == len([x for x in r.removed.split(",") if x]) for r in rows)
    left = {r.doc_id: r.text for r in paragraphs.without_repeats(odd).where("doc_id IN (5, 13, 14)").collect()}
    assert left == {5: None, 13: "\n\n" + small.prose(3, 40), 14: small.prose(4, 30)}
    assert paragraphs.repeated_paragraphs(none).count() == 0


def passages_left(docs, removed):
    """Brute force: the words of every document that are left."""
    size, places, gone = paragraphs.PASSAGE_WORDS, {}, {}
    for i, text in sorted(docs):
        w = [(x, n) for n, line in enumerate(text.split("\n")) for x in small.words(line)]
        lost = [n in removed.get(i, []) for _, n in w]
        gone[i] = (w, lost, [False] * len(w))
        for p in range(len(w) - size + 1):
            places.setdefault(tuple(x for x, _ in w[p : p + size]), []).append((i, p))
    for found in places.values():
        whole = [(i, p) for i, p in found if not any(gone[i][1][p : p + size])]
        for i, p in found:
            if whole and (i > whole[0][0] or i == whole[0][0] and p >= whole[0][1] + size) and not all(gone[i][1][p : p + size]):
                gone[i][2][p : p + size] = [True] * size
    return {i: [x for (x, _), a, b in zip(*g, strict=True) if not (a or b)] for i, g in gone.items()}


def test_passages_wherever_lines_end(spark):
    """A passage inside longer lines, across short lines, with a repeated line in it, and twice in one document."""
    passage, other = small.prose(21, 60), small.prose(22, 70)
    short = "\n".join(" ".join(passage.split(" ")[k : k + 7]) for k in range(0, 60, 7))
    mixed = "\n".join(" ".join(other.split(" ")[a:b]) for a, b in ((0, 8), (8, 30), (30, 38), (38, 60), (60, 70)))
    docs = [
        (1, f"{small.prose(23, 100)} {passage}, {small.prose(24, 90)}"), (2, f"{small.prose(25, 150)} {passage.replace("o", "O")} {small.prose(26, 12)}"),
        (3, f"{small.prose(27, 5)}\n{short}\n{small.prose(28, 6)}"), (4, mixed), (5, f"é {mixed}\nä"), (6, "le " * 400),
        (7, f"{small.prose(29, 30)} {other} {small.prose(30, 30)} {other}"), (8, " ".join(passage.split(" ")[:49])), (9, f"{small.prose(31, 60)} {small.prose(31, 60)}"),
    ]
    frame = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, row long").repartition(3)
    lines = removed_lines(docs)
    rows = {r.doc_id: r for r in paragraphs.repeated_paragraphs(frame).collect()}
    assert {i: r.removed for i, r in rows.items()} == {i: ",".join(map(str, lines.get(i, []))) for i, _ in docs}
    assert {i for i, r in rows.items() if r.n_cut} == {2, 3, 5, 6, 7, 9}
    left = paragraphs.without_repeats(frame).collect()
    expected = passages_left(docs, lines)
    assert {r.doc_id: small.words(r.text) for r in left} == expected and all(r.row == r.doc_id for r in left)
    assert not set(small.words(passage)[:50]) <= set(expected[2]) and len(expected[3]) == 11 and len(expected[2]) == 162


def test_passages_of_documents_table(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["doc_id"]).limit(150).cache()
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    found = paragraphs.repeated_paragraphs(documents).collect()
    lines = {r.doc_id: [int(x) for x in r.removed.split(",") if x] for r in found}
    got = {r.doc_id: small.words(r.text) for r in paragraphs.without_repeats(documents).collect()}
    assert got == passages_left(docs, lines)


def test_bands_are_tuned():
    bands, rows = paragraphs.tuned(0.8, 0.999, 10)
    assert bands <= 10 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def kept_bytes(docs):
    first = {}
    for i, data in docs:
        for p in range(len(data) - 49):
            key = data[p : p + 50]
            first[key] = min(first.get(key, i), i)
    out = []
    for i, data in docs:
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < i:
                gone[p : p + 50] = b"\x01" * 50
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [repeated_substrings.SHARD_BYTES, 20_000])
def test_substrings(odd, shard_bytes):
    last = 1 << 62
    docs = [(last if r[0] is None else r[0], (r[1] or "").encode()) for r in small.odd_rows()]
    rows = repeated_substrings.repeats(odd, shard_bytes).drop("kept").collect()
    assert sorted((last if r[0] is None else r[0], *r[1:]) for r in rows) == sorted(kept_bytes(docs))


def test_substrings_of_empty_tables(none):
    assert repeated_substrings.repeats(none).count() == 0


def test_substrings_of_documents(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, (r.text or "").encode()) for r in documents.collect()]
    got = [tuple(r) for r in repeated_substrings.repeats(documents, 100_000).drop("kept").collect()]
    assert sorted(got) == sorted(kept_bytes(docs))


def test_queue_merges_runs_from_disk():
    pick = np.random.default_rng(2)
    tuples = np.zeros(5_000, repeated_substrings.TUPLE)
    tuples["right"] = [bytes(pick.integers(97, 99, 12).astype(np.uint8)) for _ in range(len(tuples))]
    tuples["id"] = np.arange(len(tuples))
    with tempfile.TemporaryDirectory() as folder:
        queue = repeated_substrings.SuffixQueue(folder, run_tuples=700, block_tuples=50)
        for k in range(0, len(tuples), 130):
            queue.push(tuples[k : k + 130])
        out = np.concatenate(list(queue.batches()))
    assert (out["right"] == np.sort(tuples["right"])).all() and sorted(out["id"]) == list(range(len(tuples)))


def test_vectors(spark):
    pick = np.random.default_rng(4)
    centres = pick.standard_normal((40, 32))
    vectors = [(centres[k % 40] + 0.12 * pick.standard_normal(32)).tolist() for k in range(1500)] + [pick.standard_normal(32).tolist() for _ in range(500)]
    rows = list(enumerate(vectors)) + [(3000, vectors[0]), (3001, vectors[0])]
    odd_vectors = [(4000, None), (4001, [0.0] * 32), (4002, [float("nan")] * 32), (4003, [1.0, None] * 16), (4004, [1.0, 2.0]), (None, vectors[1]), (4005, []), (4006, [float("inf")] * 32)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd_vectors], "vec_id long, embedding array<double>, n_links int, node string")
    found = {r.vec_id: r for r in embeddings.near_vectors(frame).collect()}
    ids = np.array([i for i, _ in rows])
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    true, got = near.sum(axis=1) - 1, np.array([found[i].n_links for i in ids])
    assert (got <= true).all() and got.sum() >= 0.98 * true.sum()
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    assert np.mean([found[i].component_id == c for i, c in small.classes(links, ids.tolist()).items()]) > 0.98
    assert all(found[i].n_links == 0 and found[i].component_id == i for i, _ in odd_vectors)
    assert embeddings.near_vectors(frame.where("false")).count() == 0
    assert embeddings.near_vectors(frame.where("vec_id >= 4000")).count() == 7


def test_a_large_leaf_is_compared_in_blocks(spark, monkeypatch):
    pick = np.random.default_rng(6)
    rows = [(i, (np.ones(16) + 0.05 * pick.standard_normal(16)).tolist()) for i in range(120)]
    monkeypatch.setattr(embeddings, "BLOCK", 25)
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(119, 0)}
