"""Long blocks, both ways of making a lattice, and decoding against the library."""

import resource

import numpy as np
import pytest
import sentencepiece

from spanloom.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.MODEL)


def test_long_and_short_blocks_agree(vocabulary, monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aeinrst é▁\U0001F600"), k)) for k in (0, 1, 7, 40, 300)]
    said = [vocabulary.encode(t, 4) for t in texts]
    monkeypatch.setattr(pieces, "SHORT", 3)
    monkeypatch.setattr(pieces, "LONG", 5)
    found = pieces.Pieces(pieces.MODEL)
    for t, want in zip(texts, said, strict=True):
        got = found.encode(t, 4)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want])
        assert len({ids for _, ids in got}) == len(got)
        assert all(found.decode(ids) == t for _, ids in got)


def test_a_text_without_spaces_in_bounded_memory(vocabulary):
    text = "".join(np.random.default_rng(1).choice(list("abcdefghijklmnop"), 200_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    best = vocabulary.encode(text, 4)
    assert vocabulary.decode(best[0][1]) == text
    assert [s for s, _ in best] == sorted((s for s, _ in best), reverse=True)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB


def test_cached_blocks_are_bounded(vocabulary):
    small = pieces.Pieces(pieces.MODEL, limit=10)
    for k in range(40):
        small.encode(f"{k} " + "x" * 3000 + str(k))
    assert small.held <= 100 * small.limit + 4000


@pytest.mark.parametrize("text", ["hello world", "a  b\nc", "é ü \U0001F600", "x", "Straße, naïve; 12.5%"])
def test_decoding_against_the_library(vocabulary, text):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids = np.frombuffer(vocabulary.encode(text)[0][1], "<u2").tolist()
    # Both drop the space that encoding put first.
    assert library.decode(ids) == vocabulary.decode(vocabulary.encode(text)[0][1]) == text


def test_scores_of_the_model():
    model = pieces.Pieces(pieces.MODEL, scores="model")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    best = model.encode("the other day", 3)
    for score, ids in best:
        assert score == pytest.approx(sum(library.get_score(i) for i in np.frombuffer(ids, "<u2").tolist()))
