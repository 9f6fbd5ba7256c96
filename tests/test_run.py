"""Runs of stages, their events, the registry, notes and label files."""

import pytest

from spanloom.operators import service
from spanloom.plans import run as runs
from spanloom.sources import files

TEXT = "The river rose for three days before anyone noticed.\nThe river fell again within three days and nobody noticed.\nBoats were moved to the upper landing of the river."


def test_a_run_and_its_events(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, TEXT.upper()), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "info"), (2, "propaganda")], "doc_id long, label string")
    seen = []
    run = runs.run_stages(runs.Run(spark, docs, labels), lambda *x: seen.append(x[:2]))
    assert {"elements", "stability", "edges", "members", "compounds", "roots", "examples", "signatures"} <= set(run.tables)
    assert seen[0] == ("run_start", "") and seen[-1] == ("run_end", "")
    assert runs.events(run).filter("kind = 'stage_end'").count() == len(runs.STAGES)
    assert run.tables["elements"].count() == run.tables["stability"].count() > 5
    assert run.tables["signatures"].filter("element = 'river'").head().n_disinformation == 1


def test_optional_stages_may_fail(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    run = runs.run_stages(runs.Run(spark, docs), only=("spans", "signatures", "examples"))
    kinds = {(k, s) for k, s, _, _ in run.events}
    assert ("stage_failed", "signatures") in kinds and ("stage_skipped", "examples") in kinds
    assert "tokens" in run.tables


def test_a_required_stage_without_its_needs_ends_the_run(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    run = runs.run_stages(runs.Run(spark, docs), only=("elements", "roots"))
    assert [k for k, *_ in run.events] == ["run_start", "stage_skipped", "run_end"]


def test_seed_benchmark(spark):
    docs = spark.createDataFrame([(k, TEXT) for k in range(5)], "doc_id long, text string")
    r = runs.seed_benchmark(spark, docs, 3).head()
    assert r.n_docs == 3 and r.n_tokens > 0 and r.docs_per_s > 0


def test_registry_outlives_its_session_object(spark, tmp_path):
    first = service.Registry(spark, str(tmp_path / "r"))
    corpus = first.get_or_create_corpus("a", "f" * 20)
    first.create_run("r1", corpus)
    first.create_run("r1", corpus)
    first.create_run("r2", corpus)
    first.set_status("r1", "ok", "runs/r1.zip")
    first.register_artifact("r1", "csv", "edges")
    second = service.Registry(spark, str(tmp_path / "r"))
    assert [(r.run_id, r.status, r.export_key) for r in second.listing("runs").collect()] == [("r2", "running", None), ("r1", "ok", "runs/r1.zip")]
    assert second.get("artifacts", "r1:csv:edges")["kind"] == "csv"
    assert second.get("runs", "none") is None
    with pytest.raises(KeyError):
        second.set_status("none", "ok")


def test_note_links(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/one.md").write_text("---\ntitle: First\n---\nSee [[two]], [[Third]] and [[nowhere]].")
    (tmp_path / "n/two.md").write_text("Back to [[First]] and [[one]].")
    (tmp_path / "n/x.md").write_text("---\ntitle: Third\n---\n")
    base = lambda p: p.rsplit("/", 1)[1]
    assert sorted((base(r.source), base(r.target)) for r in files.note_links(files.notes(spark, str(tmp_path / "n"))).collect()) == [("one.md", "two.md"), ("one.md", "x.md"), ("two.md", "one.md")]


def test_label_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("element,truth_label,class\nx,,misinfo\ny,TRUE,error\n")
    assert {(r.key, r.label) for r in files.labels(spark, str(tmp_path / "l.csv")).collect()} == {("x", "misinformation"), ("y", "information")}
    (tmp_path / "m.csv").write_text("element,other\nx,1\n")
    with pytest.raises(ValueError, match="label file"):
        files.labels(spark, str(tmp_path / "m.csv"))
