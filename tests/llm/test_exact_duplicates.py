"""Streaming exact deduplication against a plain Python version."""

import re
from collections import defaultdict
from hashlib import sha256

import small

from relweave.llm.exact_duplicates import Deduplicator


def brute(rows: list[tuple]) -> list[tuple]:
    """doc_id, keep_id, group_size, text_sha256 of rows (doc_id, text)."""
    groups = defaultdict(list)
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (i, _), t in zip(rows, texts, strict=True):
        groups[t].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, least[t], len(groups[t]), sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, texts, strict=True)]


def key(row: tuple) -> tuple:
    return tuple((v is None, v) for v in row)


def same(found, rows: list[tuple]) -> None:
    got = [tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()]
    assert sorted((r[:4] for r in got), key=key) == sorted(brute(rows), key=key)
    stays = [r for r in got if r[4]]
    assert len(stays) == len({r[3] for r in got}) and all(r[0] == r[1] for r in stays)


ODD = [(r[0], r[1]) for r in small.odd_rows()] + [
    (30, "a  b"), (29, "a\t\n b"), (31, "a b"), (31, "a b"), (32, "a b"), (33, " "), (34, "\n\r\x0b\x0c"), (35, "A b"), (36, "a b "), (37, None),
]


def write(spark, rows, path, mode="append"):
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, digest string, place int, file int")
    frame.coalesce(1).write.mode(mode).parquet(path)


def test_odd_texts(spark, tmp_path):
    write(spark, ODD, f"{tmp_path}/table")
    same(Deduplicator(spark, f"{tmp_path}/memory").update(f"{tmp_path}/table").rows(), ODD)


def test_one_file_is_a_table(spark, tmp_path):
    write(spark, ODD, f"{tmp_path}/table")
    file = next(tmp_path.glob("table/*.parquet"))
    same(Deduplicator(spark, f"{tmp_path}/memory").update(str(file)).rows(), ODD)


def test_later_files_and_batches(spark, tmp_path):
    """The state lives on in the folder: later rows join earlier groups, a smaller id takes over, nothing counts twice."""
    table, memory, rows = f"{tmp_path}/table", f"{tmp_path}/memory", []
    for round_ in range(3):
        more = [(100 - 10 * round_ + k, f"text  {k % 4}" if round_ else f"text {k % 4}") for k in range(6)]
        write(spark, more, table)
        rows += more
        dedup = Deduplicator(spark, memory, batch_bytes=1).update(table)
        same(dedup.rows(), rows)
    same(Deduplicator(spark, memory, batch_bytes=1).update(table).rows(), rows)
    assert {r.group_size for r in dedup.state().collect()} == {3, 6}


def test_texts_of_one_digest_are_told_apart(spark, tmp_path):
    rows = ODD + [(200 + k, f"text {k % 300}") for k in range(900)]
    write(spark, rows, f"{tmp_path}/table")
    dedup = Deduplicator(spark, f"{tmp_path}/memory", digest_bytes=1).update(f"{tmp_path}/table")
    assert dedup.state().count() <= 256
    same(dedup.rows(), rows)


def test_empty_table(spark, tmp_path):
    write(spark, [], f"{tmp_path}/table")
    found = Deduplicator(spark, f"{tmp_path}/memory").update(f"{tmp_path}/table").rows()
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and found.count() == 0


def test_settings_of_the_session_stay(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    write(spark, ODD[:2], f"{tmp_path}/table")
    Deduplicator(spark, f"{tmp_path}/memory").update(f"{tmp_path}/table")
    assert spark.conf.get(name) == before
