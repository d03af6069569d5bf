"""Versions of a snapshot: made current in one step, refused when stale, safe when a writer fails."""

import pytest
from pyspark.sql import functions as F

from relweave import session
from relweave.sources import snapshot


def parts(spark, n):
    nodes = spark.range(n).select(F.concat(F.lit("t:"), "id").alias("id"), F.lit(n).alias("n"))
    return {"entity_nodes": nodes, "warnings": spark.createDataFrame([("none",)], "warning string")}


def test_the_newest_version_is_read(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(snapshot.NoSnapshot):
        snapshot.open_snapshot(spark, path)
    first = snapshot.commit_snapshot(spark, parts(spark, 3), path, "f1")
    held = first.parts(spark)["entity_nodes"]
    second = snapshot.commit_snapshot(spark, parts(spark, 5), path, "f2")
    assert (first.number, second.number) == (1, 2)
    assert snapshot.open_snapshot(spark, path)["entity_nodes"].count() == 5
    assert held.count() == 3  # a reader of the version before goes on
    assert snapshot.open_snapshot(spark, path, "f2").keys() == {"entity_nodes", "warnings"}
    assert snapshot.remove_old_versions(spark, path, keep=1) == [1]
    assert snapshot.open_snapshot(spark, path)["entity_nodes"].count() == 5 and len(list((tmp_path / "versions").iterdir())) == 1


def test_a_stale_version_is_refused(spark, tmp_path):
    snapshot.commit_snapshot(spark, parts(spark, 3), str(tmp_path), "f1")
    with pytest.raises(snapshot.StaleSnapshot):
        snapshot.open_snapshot(spark, str(tmp_path), "f2")


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_a_failed_write_leaves_the_old_version(spark, tmp_path, format):
    path = str(tmp_path)
    snapshot.commit_snapshot(spark, parts(spark, 3), path, "f1", format)
    broken = {**parts(spark, 5), "warnings": spark.range(4).select(F.raise_error(F.lit("lost")).cast("string").alias("warning"))}
    with pytest.raises(Exception, match="lost"):
        snapshot.commit_snapshot(spark, broken, path, "f2", format)
    found = snapshot.open_snapshot(spark, path, "f1")
    assert found["entity_nodes"].count() == 3 and snapshot.current_version(spark, path).number == 1
    assert len(list((tmp_path / "versions").iterdir())) == 1


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    write = snapshot.write_snapshot

    def overtaken(*args):
        write(*args)
        monkeypatch.setattr(snapshot, "write_snapshot", write)
        snapshot.commit_snapshot(spark, parts(spark, 7), path, "other")

    monkeypatch.setattr(snapshot, "write_snapshot", overtaken)
    with pytest.raises(snapshot.LostCommit):
        snapshot.commit_snapshot(spark, parts(spark, 3), path, "mine")
    assert snapshot.open_snapshot(spark, path, "other")["entity_nodes"].count() == 7
    assert snapshot.commit_snapshot(spark, parts(spark, 3), path, "mine").number == 2


def test_changed_tables_have_another_state(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.range(3).write.parquet(one)
    spark.range(3).coalesce(1).write.parquet(two)
    before = snapshot.tables_state(spark, [one, two])
    assert before == snapshot.tables_state(spark, [two, one])
    spark.range(3).write.mode("append").parquet(two)
    assert before != snapshot.tables_state(spark, [one, two])


def test_empty_parts_keep_their_columns(spark, tmp_path):
    snapshot.commit_snapshot(spark, {"entity_nodes": parts(spark, 0)["entity_nodes"]}, str(tmp_path), "f")
    found = snapshot.open_snapshot(spark, str(tmp_path))["entity_nodes"]
    assert found.columns == ["id", "n"] and found.count() == 0


def test_a_row_is_written_by_one_call_for_a_run_of_plain_columns(spark):
    """Every text used to call Spark's writer twice, and every name too."""
    from relweave.functions.values import encoded_object, typed_json

    odd = ["", "a", 'say "x"}', "back\\slash}}", "two\nlines\t", "\x00\x1f\x7f", "主轴 😀", "}", None]
    rows = [
        (t, t, [(t, True), (None, None), None], 1.5 if t else None, t, [t, None], (t,), {"k}": t}, i if i % 2 else None, t is not None)
        for i, t in enumerate(odd)
    ]
    rows.append((None, "x", [], float("nan"), "", None, None, None, 2**60, None))
    df = spark.createDataFrame(
        rows, "a string, `b \"c` string, proofs array<struct<f:string,g:boolean>>, d double, e string, l array<string>, s struct<f:string>, m map<string,string>, n long, o boolean"
    )
    fields = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), typed_json(f.name, f.dataType))])
    by_value = encoded_object(fields, F.array(*[F.lit(c) for c in df.columns]))
    both = df.select(by_value.alias("value")).collect(), snapshot.public_json(df).collect()
    assert both[0] == both[1]
    assert '"f":"}"' in both[1][7].value and '"proofs":[]' in both[1][9].value
    plain = df.select("a", "e", "proofs", "o")
    assert snapshot.public_json(plain)._jdf.queryExecution().analyzed().toString().count("to_json(") == 1


def test_a_part_in_buckets_is_grouped_where_it_is(spark, tmp_path):
    """Rows used to move for every group by edge."""
    path, of = str(tmp_path), snapshot.Buckets(4, "edge_source", ("edge_source", "edge_target"))
    pairs = spark.createDataFrame([(f"a:{i % 7}", f"b:{i % 11}", f"l{i % 3}") for i in range(200)], "edge_source string, edge_target string, label string")

    def commit(rows, fingerprint):
        return snapshot.commit_snapshot(spark, {"relations": rows.repartition(4, "edge_source")}, path, fingerprint, buckets={"relations": of})

    commit(pairs.limit(3), "f1")
    commit(pairs, "f2")
    found = snapshot.open_snapshot(spark, path, "f2")["relations"]
    assert sorted(found.collect()) == sorted(pairs.collect())
    grouped = session.dealt(found.select("edge_source", "edge_target"), ("edge_source", "edge_target"), found).distinct()
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString() and grouped.count() == 77
    # What is written in another layout is not said to be in buckets.
    assert session.buckets_of(found, "edge_source") == 4 and session.buckets_of(session.materialize(found, "copy"), "edge_source") is None
    assert snapshot.remove_old_versions(spark, path, keep=1) == [1] and found.count() == 200


def test_json_lines_are_compressed(spark, tmp_path):
    """Texts of relations took many times the room of their columns."""
    version = snapshot.commit_snapshot(spark, parts(spark, 3), str(tmp_path), "f", "json")
    assert list((tmp_path / "versions").glob("*/entity_nodes/*.gz")) and version.parts(spark)["entity_nodes"].count() == 3
