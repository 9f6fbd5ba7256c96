"""A corpus run as stages over DataFrames: registered by name and order, with dependencies and events."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import scores
from spanloom.operators import contexts, graph, terms
from spanloom.plans.tables import cut

STAGES: dict[str, Stage] = {}
Tables = dict[str, DataFrame]


@dataclass
class Stage:
    make: Callable[[Run], Tables]
    order: float
    needs: tuple[str, ...] = ()
    required: bool = True


@dataclass
class Run:
    """What a stage sees: the inputs, what earlier stages made, and the parameters."""

    spark: SparkSession
    docs: DataFrame
    labels: DataFrame | None = None
    mode: str = "classic"
    prune: str = "none"
    tables: Tables = field(default_factory=dict)
    events: list[tuple[str, str, int, str]] = field(default_factory=list)


def stage(name: str, order: float, needs: tuple[str, ...] = (), required: bool = True):
    """Registers a function that makes tables."""

    def register(f: Callable[[Run], Tables]) -> Callable[[Run], Tables]:
        STAGES[name] = Stage(f, order, needs, required)
        return f

    return register


@stage("spans", 1.0)
def _spans(run: Run) -> Tables:
    return {"tokens": cut(terms.tokenised(run.docs))}


@stage("elements", 2.0, ("spans",))
def _elements(run: Run) -> Tables:
    made = terms.span_weights(run.docs)
    weighted = terms.exploded(*made)
    return {"weights": weighted, "elements": cut(terms.statistics_of(weighted).join(terms.coherence_of(*made), "element"))}


@stage("stability", 3.0, ("elements",))
def _stability(run: Run) -> Tables:
    return {"stability": cut(scores.with_temperature(scores.with_stability(run.tables["elements"], run.mode)).select("element", "entropy", "coherence", "stability", "temperature"))}


@stage("edges", 4.0, ("elements",))
def _edges(run: Run) -> Tables:
    pairs = graph.cooccurrence(run.tables["weights"].select(F.struct("doc_id", "position").alias("span"), "element"), "span", "element")
    return {"edges": cut(graph.with_scores(cut(graph.top_per_node(pairs, 30))))}


@stage("compounds", 5.0, ("edges",))
def _compounds(run: Run) -> Tables:
    members = cut(graph.named(graph.components(run.tables["edges"])))
    return {"members": members, "compounds": cut(graph.compounds(run.tables["edges"], members))}


@stage("roots", 6.0, ("elements",))
def _roots(run: Run) -> Tables:
    return {"roots": cut(terms.roots(run.tables["elements"].select("element", "collection_freq", "span_freq")))}


@stage("examples", 7.0, ("spans", "elements"), required=False)
def _examples(run: Run) -> Tables:
    targets = run.tables["elements"].orderBy(F.desc("collection_freq"), "element").limit(500).select("element")
    return {"examples": cut(contexts.examples(run.tables["tokens"], targets))}


@stage("signatures", 8.0, ("spans",), required=False)
def _signatures(run: Run) -> Tables:
    """Needs labels: doc_id, label."""
    held = run.tables["tokens"].select("doc_id", F.explode(F.array_distinct("elements")).alias("element")).distinct()
    return {"signatures": cut(terms.signatures(held.join(run.labels, "doc_id").select("element", "label")))}


def run_stages(run: Run, emit: Callable[[str, str, str], None] | None = None, only: tuple[str, ...] | None = None) -> Run:
    """Runs the stages in order. One whose needs were not met, or that fails, ends the run if it is required, else it is left out.

    emit gets (kind, stage, text): run_start, stage_start, stage_end, stage_skipped, stage_failed, run_end.
    """

    def tell(kind: str, name: str, said: str = "") -> None:
        run.events.append((kind, name, time.time_ns() // 1_000_000, said))
        if emit:
            emit(kind, name, said)

    done: set[str] = set()
    tell("run_start", "")
    for name, x in sorted(STAGES.items(), key=lambda s: s[1].order):
        if only is not None and name not in only:
            continue
        if missing := [n for n in x.needs if n not in done]:
            tell("stage_skipped", name, f"needs {', '.join(missing)}")
            if x.required:
                break
            continue
        tell("stage_start", name)
        try:
            run.tables |= x.make(run)
        except Exception as e:  # noqa: BLE001  a stage may be any code; what went wrong is told
            tell("stage_failed", name, f"{type(e).__name__}: {e}"[:500])
            if x.required:
                raise
            continue
        done.add(name)
        tell("stage_end", name)
    tell("run_end", "", ",".join(sorted(done)))
    return run


def events(run: Run) -> DataFrame:
    """kind, stage, at (epoch milliseconds), said: what the run has told."""
    return run.spark.createDataFrame(run.events, "kind string, stage string, at long, said string")


def seed_benchmark(spark: SparkSession, docs: DataFrame, most: int = 50) -> DataFrame:
    """n_docs, n_tokens, seconds, docs_per_s, tokens_per_s of a timed run over the first documents."""
    sample = cut(docs.orderBy("doc_id").limit(most))
    began = time.perf_counter()
    made = run_stages(Run(spark, sample), only=("spans", "elements")).tables
    tokens = made["tokens"].agg(F.coalesce(F.sum(F.size("elements")), F.lit(0))).head()[0]
    took, n = time.perf_counter() - began, sample.count()
    return spark.createDataFrame([(n, tokens, took, n / took, tokens / took)], "n_docs long, n_tokens long, seconds double, docs_per_s double, tokens_per_s double")
