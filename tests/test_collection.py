import pytest

from fathomdoc.sources import collection as C


def load(spark, first, texts):
    return spark.createDataFrame([(f"id{first + i}", t, i) for i, t in enumerate(texts)], "id string, chunk_text string, place int")


def texts(spark, folder):
    return sorted((r.id, r.chunk_text) for r in C.read_collection(spark, folder).collect())


@pytest.fixture
def folder(spark, tmp_path):
    folder = str(tmp_path / "collection")
    C.append_collection(load(spark, 0, ["Red fox", "blue whale", None, "RED car"]), folder, "a")
    C.append_collection(load(spark, 10, ["green tree", "redwood", "sea"]), folder, "b")
    C.append_collection(load(spark, 20, ["sky", "sun"]), folder, "7")
    return folder


def test_delete_writes_one_marker_for_each_passage(spark, folder):
    before = texts(spark, folder)
    old = C.read_collection(spark, folder)
    assert C.delete_by_content(spark, folder, "red") == 3
    assert sorted((r["_load"], r.id) for r in C.read_markers(spark, folder).collect()) == [("a", "id0"), ("a", "id3"), ("b", "id11")]
    assert texts(spark, folder) == [r for r in before if r[0] not in ("id0", "id3", "id11")]
    # A reader that began before the delete sees what was there, and a second delete finds nothing.
    assert old.count() == 9 and C.delete_by_content(spark, folder, "red") == 0
    assert C.delete_ids(spark, folder, spark.createDataFrame([("id20",), ("id20",), ("none",)], "id string")) == 1
    assert C.read_collection(spark, folder).columns == ["id", "chunk_text", "place"]


def test_compaction_rewrites_only_loads_with_markers(spark, folder):
    C.delete_by_content(spark, folder, "red")
    after = texts(spark, folder)
    old = C.read_collection(spark, folder)
    assert C.compact_collection(spark, folder) == ["a", "b"]
    names = sorted(n for n in C._children(spark, f"{folder}/v000001") if n.startswith("load="))
    assert names == ["load=7", "load=a", "load=a~1", "load=b", "load=b~1"]
    assert texts(spark, folder) == after and sorted((r.id, r.chunk_text) for r in old.collect()) == after
    assert C.compact_collection(spark, folder) == [] and C.delete_by_content(spark, folder, "whale") == 1
    assert C.compact_collection(spark, folder) == ["a"] and spark.read.parquet(f"{folder}/v000001/load=a~2").count() == 1


def test_a_load_written_again_replaces_all_its_generations(spark, folder):
    C.delete_by_content(spark, folder, "red")
    C.compact_collection(spark, folder)
    C.append_collection(load(spark, 0, ["Red fox", "new"]), folder, "a")
    assert [r for r in texts(spark, folder) if r[0] in ("id0", "id1", "id3")] == [("id0", "Red fox"), ("id1", "new")]
    with pytest.raises(ValueError):
        C.append_collection(load(spark, 0, ["x"]), folder, "a~9")


def test_unfinished_loads_and_markers_are_not_seen(spark, folder, tmp_path):
    before = texts(spark, folder)
    load(spark, 90, ["half"]).write.parquet(f"{folder}/v000001/load=a~1")
    (tmp_path / "collection/v000001/load=a~1/_SUCCESS").unlink()
    spark.createDataFrame([("b", "id10")], C.MARKER).write.parquet(f"{folder}/v000001-deleted/mark=x")
    (tmp_path / "collection/v000001-deleted/mark=x/_SUCCESS").unlink()
    assert texts(spark, folder) == before
    assert C.clear_collection(spark, folder) == 0 and texts(spark, folder) == [] and C.delete_by_content(spark, folder, "red") == 0


def test_refusals(spark, folder):
    with pytest.raises(ValueError):
        C.delete_by_content(spark, folder, "")
    with pytest.raises(RuntimeError):
        C.delete_by_content(spark, folder, "red", max_scan=3)
    assert C.delete_by_content(spark, folder, "red", max_scan=9) == 3
