"""Sinks, the object store and archives; helpers that no query covers."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from spanloom.operators import graph
from spanloom.plans import tables
from spanloom.sources import sinks


def test_quoted_table(spark, tmp_path):
    sinks.write_quoted(spark.createDataFrame([('a"b', "c,d", 1)], "s string, t string, w int").coalesce(1), str(tmp_path / "q"))
    assert [r.value for r in spark.read.text(str(tmp_path / "q")).collect()] == ['"a\'b","c,d","1"']


def test_store_and_archive(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path / "store"))
    assert store.keys() == []
    store.put("run1/a.csv", b"x,y\n1,2\n")
    store.put("run1/deep/b.json", b"{}")
    store.put("run1/c.bin", bytes(range(256)))
    assert store.get("run1/c.bin") == bytes(range(256))
    assert store.keys("run1/") == ["run1/a.csv", "run1/c.bin", "run1/deep/b.json"]
    packed = sinks.export_zip(store, "run1")
    assert zipfile.ZipFile(io.BytesIO(packed)).namelist() == ["run1/a.csv", "run1/deep/b.json"]
    other = sinks.Store(spark, str(tmp_path / "other"))
    assert sinks.import_zip(other, packed) == ["run1/a.csv", "run1/deep/b.json"]
    assert other.get("run1/a.csv") == b"x,y\n1,2\n"
    assert store.delete("run1/a.csv") and not store.delete("run1/a.csv")


@pytest.mark.parametrize("key", ["../x", "a/../../x", "/etc/x", "", "."])
def test_keys_stay_in_the_folder(spark, tmp_path, key):
    with pytest.raises(ValueError, match="not a key"):
        sinks.Store(spark, str(tmp_path)).put(key, b"")


def test_bad_archives(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("fine.txt", "x")
        archive.writestr("../evil.txt", "x")
    store = sinks.Store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="not a key"):
        sinks.import_zip(store, out.getvalue())
    assert store.keys() == []
    with pytest.raises(ValueError, match="too large"):
        sinks.import_zip(store, out.getvalue(), most=1)


def test_large_components_keep_all_without_a_large_one(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, component long")
    assert graph.large_components(members, 5).count() == 3
    assert sorted(r.node for r in graph.large_components(members, 2).collect()) == [1, 2]


def test_ranks_without_a_window_over_all(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7).repartition(9)
    found = tables.ranked(df, F.desc("x"), F.col("id")).collect()
    order = sorted(found, key=lambda r: (-r.x, r.id))
    assert [r.place for r in order] == list(range(1, 1001))
    assert tables.ranked(df.limit(0), "id").collect() == []


def test_a_large_span_is_dealt_to_groups(spark):
    rows = [(1, k) for k in range(60)] + [(2, 3), (2, 5), (2, 5), (3, 9)]
    df = spark.createDataFrame(rows, "s long, x long")
    whole, dealt = (sorted(map(tuple, graph.cooccurrence(df, "s", "x", most=n).collect())) for n in (2_000, 7))
    assert whole == dealt
    assert len(whole) == 60 * 59 // 2 and (3, 5, 2) in whole


def test_triangles_of_a_hub(spark):
    edges = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(1, 39)]
    assert graph.triangles(spark.createDataFrame(edges, "source long, target long")).head()[0] == 38


def test_simulation_export(spark, tmp_path):
    from spanloom.operators import simulation

    state = simulation.init(spark, 10)
    simulation.export(state, str(tmp_path / "sim"))
    back = sinks.read_records(spark, str(tmp_path / "sim"), "agent long, x double, y double, belief double, regime int")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, state.select("agent", "x", "y", "belief", "regime").collect()))
