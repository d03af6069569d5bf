"""Batches of token counts: committed once, by one writer, folded, revised."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from relweave.llm import queries, token_counts
from relweave.llm.token_counts import Rollup, differences

COUNTS = "doc_id long, source string, lang string, tokenizer string, n_tokens long"


def counts(spark, *rows):
    return spark.createDataFrame([(i, s, None, "t", n) for i, s, n in rows], COUNTS)


def totals(rollup):
    return {r.source: (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_names_are_used_once(spark, tmp_path):
    one, other = differences(counts(spark, (1, "a", 5), (2, "b", 7))), differences(counts(spark, (1, "a", 6)))
    rollup = Rollup(spark, str(tmp_path))
    assert rollup.commit("x", one) and not rollup.commit("x", one.repartition(5))
    with pytest.raises(ValueError, match="other changes"):
        rollup.commit("x", other)
    again = Rollup(spark, str(tmp_path))  # another run over the same folder
    assert not again.commit("x", one) and totals(again) == {"a": (1, 5), "b": (1, 7)}


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    one = differences(counts(spark, (1, "a", 5)))
    first, second = Rollup(spark, str(tmp_path)), Rollup(spark, str(tmp_path))
    write = Rollup._write

    def overtaken(self, rows, name, **told):
        monkeypatch.setattr(Rollup, "_write", write)
        assert second.commit("x", one)
        return write(self, rows, name, **told)

    monkeypatch.setattr(Rollup, "_write", overtaken)
    assert not first.commit("x", one)
    assert totals(first) == {"a": (1, 5)} and len(list((tmp_path / "data").iterdir())) == 1


def test_folding_changes_nothing(spark, tmp_path):
    rollup = Rollup(spark, str(tmp_path))
    assert rollup.compact() and totals(rollup) == {}
    rollup.commit("x", differences(counts(spark, (1, "a", 5), (2, "b", 7))))
    rollup.commit("y", differences(deleted=counts(spark, (2, "b", 7))))
    before = totals(rollup)
    assert before == {"a": (1, 5)} and rollup.compact() and totals(rollup) == before
    assert not rollup.commit("y", differences(deleted=counts(spark, (2, "b", 7))))  # folded, but known
    rollup.commit("z", differences(inserted=counts(spark, (1, "a", 9)), deleted=counts(spark, (1, "a", 5))))
    assert totals(rollup) == {"a": (1, 9)} and rollup.compact() and totals(Rollup(spark, str(tmp_path))) == {"a": (1, 9)}


def test_query(spark, sf_dir):
    """The query's totals against counting what the documents are in the end."""
    import tiktoken

    encoder = tiktoken.Encoding("plain", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.ranks_of(token_counts.TOKENIZERS["byte-bpe-50k"]), special_tokens={})
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    expected, respelt = defaultdict(lambda: [0, 0]), 0
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        label, text = labels.get(d.doc_id), d.text or ""
        if label is not None and label.toxic == 1:
            continue
        respelt += "License" in text
        text = text.replace("License", "Licence")
        for name, n in (("byte-bpe-50k", len(encoder.encode_ordinary(text))), (token_counts.BYTES, len(text.encode()))):
            row = expected[(d.source, d.lang, name)]
            row[0] += 1
            row[1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in queries.op6_token_counts(spark, sf_dir).collect()}
    assert got == dict(expected) and respelt > 0
