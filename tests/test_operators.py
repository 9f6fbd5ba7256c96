import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import scores, text
from spanloom.operators import graph, language, service, simulation, terms, timeline, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


@pytest.mark.parametrize(("word", "stem"), [("studies", "study"), ("running", "runn"), ("boxes", "box"), ("glass", "glass"), ("cars", "car"), ("is", "is")])
def test_stem(spark, word, stem):
    assert one(spark, text.stem(F.lit(word))) == stem


def test_token_rules(spark):
    assert one(spark, text.tokens(F.lit("Figure rhythm the Well-Known xyz table running"))) == ["the", "wellknown", "running"]


def test_short_label_and_slug(spark):
    assert one(spark, text.short_label(F.lit("a label that is rather too long"))) == "a label that is..."
    assert one(spark, text.slug(F.lit("x/y/story-17.txt"))) == "story.txt"


@pytest.mark.parametrize(("h", "bar"), [(0.0, 0.40), (0.1, 0.40), (1.0, 0.15 + 0.25 * math.exp(-1 / 2.8)), (4.0, 0.15), (9.0, 0.15)])
def test_adaptive_threshold(spark, h, bar):
    assert one(spark, scores.adaptive_threshold(F.lit(h))) == pytest.approx(bar)


def test_spectral_entropy(spark):
    assert one(spark, scores.spectral_entropy(F.array(*[F.lit(1.0)] * 4))) == pytest.approx(1.0)
    assert one(spark, scores.spectral_entropy(F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_cooccurrence_and_backbone(spark):
    occ = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "b"), (3, "c")], "span int, e string")
    rows = {(r.source, r.target): r for r in graph.with_scores(graph.cooccurrence(occ, "span", "e")).collect()}
    assert {k: r.weight for k, r in rows.items()} == {("a", "b"): 2, ("b", "c"): 1}
    assert rows["b", "c"].confidence == pytest.approx(math.log(2) / math.log(3))
    assert [k for k, r in rows.items() if r.is_backbone] == [("a", "b")]


def test_components_of_a_path_and_a_pair(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "source long, target long")
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert all(found[i] == 0 for i in range(41))
    assert found[101] == 100


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "source long, target long, weight long")
    assert graph.components(empty).count() == 0
    assert graph.with_scores(empty).count() == 0


def test_signature_of_four_labels(spark):
    rows = spark.createDataFrame([("e", "info")] * 3 + [("e", "misinfo")], "element string, label string")
    r = terms.signatures(rows).head()
    assert (r.p_information, r.p_misinformation, r.p_disinformation) == (0.5, 0.25, 0.125)
    assert r.entropy_bits == pytest.approx(1.75)
    assert r.dominant_label == "information"


def test_smoothing(spark):
    assert one(spark, timeline.smoothed(F.array(F.lit(0.0), F.lit(1.0)), 0.5)) == 0.5


def test_coherence_of_equal_rows(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [2.0, 4.0])], "vec_id long, label int, embedding array<double>")
    assert vectors.coherence(vectors.normalised(rows)).head().coherence == pytest.approx(1.0)
    assert {r.leader for r in vectors.condense(vectors.normalised(rows)).collect()} == {1}


def test_condense_sends_only_leaders_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    kinds = rng.standard_normal((3, 16))
    rows = spark.createDataFrame([(k, (kinds[k % 3] / np.linalg.norm(kinds[k % 3])).tolist()) for k in range(400)], "vec_id long, v array<double>").repartition(6)
    kind = type(rows)
    seen, collect, pandas = [], kind.collect, kind.toPandas
    monkeypatch.setattr(kind, "collect", lambda self: seen.append(found := collect(self)) or found)
    monkeypatch.setattr(kind, "toPandas", lambda self: seen.append((found := pandas(self)).to_numpy().tolist()) or found)
    found = vectors.condense(rows, 100)
    sent = sum(len(x) if isinstance(x, (bytes, list)) else 8 for rows_ in seen for r in rows_ for x in r)
    assert sent <= 3 * (16 + 2) * 8 + 16
    monkeypatch.undo()
    assert {r.vec_id: r.leader for r in found.collect()} == {k: k % 3 for k in range(400)}


def test_condense_against_a_plain_version(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 16))
    raw = [(i, i % 3, [float(x) for x in centres[i % 5] + rng.choice([0.05, 0.3]) * rng.standard_normal(16)]) for i in range(300)]
    units = vectors.normalised(spark.createDataFrame(raw, "vec_id long, label int, embedding array<double>")).cache()
    bars = scores.condensation_threshold(scores.spectral_entropy(F.col("v")))
    plain = units.withColumn("bar", bars).orderBy("vec_id").toPandas()
    x, bar = np.stack(plain["v"].to_list()), plain["bar"].to_numpy()

    def pass_over(rows, bar):
        groups, seen = [], set()
        for i in rows:
            if i not in seen:
                groups.append([i] + [j for j in rows if j > i and j not in seen and round(x[i] @ x[j], 12) >= bar[i]])
                seen.update(groups[-1])
        return groups

    said = {}
    for group in pass_over(range(300), bar):
        sims = np.round(x[group] @ x[group].T, 12)
        few = sims[sims < 0.9999]
        split = [group] if len(group) <= 2 or not few.size else pass_over(group, np.full(300, max(0.85, min(0.98, float(np.median(few))))))
        said |= {i: part[0] for part in split for i in part}
    for block in (64, 4096):
        assert {r.vec_id: r.leader for r in vectors.condense(units, block).collect()} == said


def test_simulation_stays_in_bounds(spark):
    state = simulation.step(simulation.init(spark, 64), seed=3)
    assert state.filter("x < 0 OR x > 1 OR belief < 0 OR belief > 1").count() == 0
    assert 0 <= simulation.metrics(state).head().regime_entropy <= math.log(3)


def test_registry_is_idempotent(spark):
    registry = service.Registry(spark)
    assert registry.get_or_create_corpus("a", "f" * 20) == registry.get_or_create_corpus("b", "f" * 20)
    registry.register_artifact("r", "csv", "edges")
    registry.register_artifact("r", "csv", "edges")
    assert registry.listing("artifacts").count() == 1


def test_verify(spark):
    said = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], "path string, size_bytes int, sha256 string")
    there = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "y")], "path string, size_bytes int, sha256 string")
    assert {r.path: r.status for r in service.verify(said, there).collect()} == {"a": "ok", "b": "size", "c": "hash", "d": "missing"}


def test_sequences_have_marks(spark):
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b a b c".split())], "doc_id long, place int, word string")
    assert language.sequences(words).head().ids == [1, 4, 5, 4, 5, 3, 2]


def test_empty_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert terms.statistics(empty).count() == 0


@pytest.mark.parametrize("cells", [25_000_000, 200])
def test_pair_sums_in_one_pass_and_in_several(spark, cells):
    rng = np.random.default_rng(3)
    made = [(k // 3, k % 3, f"w{e:02d}", float(rng.random())) for k in range(90) for e in rng.choice(40, rng.integers(1, 9), replace=False)]
    weighted = spark.createDataFrame([*made, (None, 0, "w01", 1.0), (None, 0, "w02", 1.0)], "doc_id int, position int, element string, weight double")
    names = sorted({e for *_, e, _ in made})
    plain = {a: dict.fromkeys(names, 0.0) for a in names}
    for d, p, a, _ in made:
        for d2, p2, b, w in made:
            if (d, p) == (d2, p2):
                plain[a][b] += w
    for r in terms.pair_sums(weighted, cells=cells).collect():
        assert r.others == names and r.n == sum(e == r.element for *_, e, _ in made)
        assert r.sums == pytest.approx(list(plain.pop(r.element).values()))
    assert not plain


def test_coherence_shuffles_no_pairs(spark):
    weighted = spark.createDataFrame([(k, 0, f"w{e}", 0.1) for k in range(50) for e in range(100)], "doc_id int, position int, element string, weight double")
    found = terms.coherence(weighted)
    assert {round(r.coherence, 9) for r in found.collect()} == {1.0}
    assert "Join [doc_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_tokens_by_one_pattern(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aAbtTgf-- .\u00e9\u0130\u212a5"), rng.integers(0, 30))) for _ in range(2_000)] + ["Tables Fig-ure ta-b a--bc -abc- xyz Reference ReF", None]
    plain = lambda c: F.filter(F.transform(F.regexp_extract_all(c, F.lit(text.WORD), 0), text.normal_token), lambda t: t != "")
    c = F.col("value")
    found = spark.createDataFrame([(x,) for x in texts], "value string").select(text.tokens(c).alias("tokens"), plain(c).alias("plain"))
    assert found.filter("NOT (tokens <=> plain)").count() == 0
    # Patterns are not tried on each token once more.
    assert found.select("tokens")._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 0


def test_strip_takes_the_same_blanks(spark):
    texts = ["\t\n\v\f\r \x85\xa0a \xa0b\x85 ", "", " \xa0", "a", "\u2003a", "\x1fa", "\u0085\u0105 ", None]
    c = F.col("value")
    found = spark.createDataFrame([(x,) for x in texts], "value string").select(text.strip(c).alias("s"), F.regexp_replace(c, f"^{text.SPACE}+|{text.SPACE}+$", "").alias("plain"))
    assert found.filter("NOT (s <=> plain)").count() == 0


def test_frequencies_are_added_up_before_the_shuffle(spark):
    rows = [(["a", "b", "a"],), ([],), (None,), (["b", None, None],), (["a"],)]
    found = terms.frequencies(spark.createDataFrame(rows, "elements array<string>"))
    assert {(r.element, r.collection_freq, r.span_freq) for r in found.collect()} == {("a", 3, 2), ("b", 2, 2), (None, 2, 1)}
    # A row for each occurrence went on before.
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_weights_of_documents_that_share_an_id(spark):
    lines = ["the running horse jumps over fences and ditches", "many horses were running over the green fences", "nothing here repeats anything whatsoever indeed"]
    rows = [(1, "\n".join(lines)), (1, lines[1] + "\n" + lines[0]), (2, lines[0]), (None, lines[1]), (None, lines[0]), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = [(r.doc_id, r.position, r.elements) for r in terms.tokenised(docs).collect()]
    held = {}
    for doc, at, elements in spans:
        held.setdefault((doc, at), []).extend(elements)
    in_spans = {}
    for elements in held.values():
        for e in set(elements):
            in_spans[e] = in_spans.get(e, 0) + 1
    want = {}
    for key, elements in held.items():
        x = {e: elements.count(e) * (math.log((1 + len(spans)) / (1 + in_spans[e])) + 1) for e in set(elements) if in_spans[e] > 1}
        want |= {(*key, e): (elements.count(e), v / math.sqrt(sum(y * y for y in x.values()))) for e, v in x.items()}
    found = {(r.doc_id, r.position, r.element): (r.tf, r.weight) for r in terms.weights(docs).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_weights_and_coherence_shuffle_no_spans(spark):
    docs = spark.createDataFrame([(k, f"the running horse number{k % 7} jumps over fences\nwhite horses over there were running") for k in range(40)], "doc_id long, text string")
    made = terms.span_weights(docs)
    weighted = terms.exploded(*made)
    assert "hashpartitioning(doc_id" not in weighted._jdf.queryExecution().executedPlan().toString()
    plan = terms.coherence_of(*made)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan and "hashpartitioning(position" not in plan
    a = {r.element: r.coherence for r in terms.coherence_of(*made).collect()}
    assert a and a == pytest.approx({r.element: r.coherence for r in terms.coherence(weighted).collect()})
