"""Elements, phrases too, found in span texts: a theta join by an automaton of all targets at once.

An Aho-Corasick automaton is built once a task from the targets, whose number is checked, and each span is read once,
however many targets there are. A hit counts if neither neighbour of it is a letter, digit or underscore. A task sends
at most k spans a target, so what is ranked in the end is a few rows for each task and target.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def automaton(targets: list[str]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for number, target in enumerate(targets):
        built.add_word(target.lower(), (number, len(target)))
    built.make_automaton()
    return built


def hits(built: ahocorasick.Automaton, text: str) -> set[int]:
    """Numbers of the targets that a text has as whole words, in any case."""
    low, found = text.lower(), set()
    part = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
    for end, (number, length) in built.iter(low):
        if number not in found and not part(end + 1) and not part(end - length):
            found.add(number)
    return found


def text_examples(spans: DataFrame, targets: DataFrame, k: int = 3, most: int = 10_000) -> DataFrame:
    """element, place, doc_id, position: the first k spans whose text has each target. spans: doc_id, position, span; targets: element.

    Targets of one character are left out. More than `most` of them are an error, since every task holds them all.
    """
    names = sorted({r[0] for r in targets.filter(F.length("element") > 1).select("element").limit(most + 1).collect()})
    if len(names) > most:
        raise ValueError(f"more than {most} targets")
    schema = f"element string, doc_id {spans.schema['doc_id'].dataType.simpleString()}, position {spans.schema['position'].dataType.simpleString()}"
    types = [pa.string(), *(to_arrow_type(spans.schema[c].dataType) for c in ("doc_id", "position"))]
    order = lambda at: (at[0] is not None, at)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, first = automaton(names) if names else None, {}
        for batch in batches:
            for at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "position", "span"))):
                for number in hits(built, at[2] or "") if built else ():
                    own = first.setdefault(number, [])
                    own.append(at[:2])
                    if len(own) > 16 * k:
                        own[:] = sorted(own, key=order)[:k]
        rows = [(names[number], *at) for number, own in first.items() for at in sorted(own, key=order)[:k]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["element", "doc_id", "position"])

    found = spans.select("doc_id", "position", "span").mapInArrow(search, schema)
    place = F.row_number().over(Window.partitionBy("element").orderBy("doc_id", "position"))
    return found.withColumn("place", place).filter(F.col("place") <= k)
