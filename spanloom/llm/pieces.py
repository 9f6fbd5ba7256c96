"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a public model span a lattice over a text: an arc for each piece that matches, and where no piece
covers a character an arc of its UTF-8 bytes. The score of a segmentation is the sum of its arcs' log
probabilities. The model at hand ranks its pieces but has no probabilities, so by default a piece of rank r gets
those of Zipf's law, p = 1 / (H (r + 2.7)); `scores="model"` takes the scores in the file instead.

Forward Viterbi scores are computed for all distinct blocks of a batch together. A block is a run of spaces with
what follows up to the next space, line break or character that no piece holds behind another one than its like (the
model decides which; the one at hand has none); no piece crosses its ends, so every path passes through them. A text
without spaces is one block of any length; its memory grows in proportion.
They are the exact heuristic of a backward A-star search, which pops a block's segmentations best first. A text's
N best need alternatives in at most the N - 1 blocks with the smallest loss of a second best path (any other
change has N - 1 better ones); a second search over those blocks' lists, best first, combines them exactly.

Decoding joins the pieces, turns the space mark into spaces and byte pieces into bytes, and drops the first
space, which encoding put before the text. A space mark in the text itself is encoded by its bytes, so that
decode(encode(text)) == text for every text.

Defined cases: null texts are empty; empty texts have no pieces and one segmentation with score 0; repeated rows
are encoded each on its own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import types
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, LITERAL = 0x2581, 0x110000  # the space mark, and a code for one that stands in a text
PRIME = np.uint64(0x9E3779B97F4A7C15)
# Blocks of up to SHORT characters get their arcs from a dict, those over LONG are solved one by one.
SHORT, LONG = 256, 2048


class Pieces:
    """The vocabulary and cached block segmentations of one process."""

    def __init__(self, path: str, scores: str = "zipf", limit: int = 600_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit, self.bytes_at = limit, model.piece_to_id("<0x00>")
        first = self.bytes_at + 256
        n = model.get_piece_size()
        harmonic = float(np.sum(1 / (np.arange(n - first) + 2.7)))
        self.text_of = [model.id_to_piece(i) for i in range(n)]
        self.raw = [bytes([i - self.bytes_at]) if self.bytes_at <= i < first else b"" if i < self.bytes_at else self.text_of[i].replace("▁", " ").encode() for i in range(n)]
        self.score = {i: -float(np.log((i - first + 2.7) * harmonic)) if scores == "zipf" else model.get_score(i) for i in range(first, n)}
        self.unknown = min(self.score.values()) - 10.0
        self.id_of = {self.text_of[i]: i for i in range(first, n)}
        self.longest = max(map(len, self.id_of))
        self.block = re.compile(self.block_pattern())
        table = {}
        for piece, i in self.id_of.items():
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                power = np.uint64(1)
                for c in piece:
                    h = h + (np.uint64(ord(c)) + np.uint64(1)) * power
                    power = power * PRIME
                    table.setdefault(int(h), -1)
            table[int(h)] = i
        self.hashes = np.array(sorted(table), np.uint64)
        self.ids = np.array([table[int(h)] for h in self.hashes], np.int64)
        self.scores = np.full(n, -np.inf)
        self.scores[list(self.score)] = list(self.score.values())
        self.alternatives = lru_cache(maxsize=50_000)(self.nbest)
        self.clear()

    def block_pattern(self) -> str:
        """Blocks end before a character of `leading`: in all pieces these follow the space mark or one another only."""
        leading = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        while drop := {b for piece in self.id_of for a, b in zip(piece, piece[1:], strict=False) if b in leading and a not in leading and a != "▁"}:
            leading -= drop
        own = "".join(map(re.escape, sorted(leading)))
        return rf" +[{own}]*[^ \n{own}]*|\n|[{own}][^ \n]*|[^ \n{own}]+" if own else r" +[^ \n]*|\n|[^ \n]+"

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.held = 0
        self.best: list[bytes] = []
        self.total, self.loss, self.count = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)

    def arcs(self, blocks: list[str]) -> tuple[np.ndarray, ...]:
        """All arcs of the blocks' lattices: first node, length, piece (-1: bytes), score, block; and the first node of each block."""
        lengths = np.array([len(b) for b in blocks], np.int64)
        codes = np.frombuffer("".join(blocks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.where(codes == MARK, LITERAL, np.where(codes == 32, MARK, codes)).astype(np.uint64) + np.uint64(1)
        ends = np.cumsum(lengths)
        block = np.repeat(np.arange(len(blocks)), lengths)
        room = ends[block] - np.arange(len(codes))
        at, h, power = np.arange(len(codes)), np.zeros(len(codes), np.uint64), np.uint64(1)
        out = []
        for length in range(1, self.longest + 1):
            keep = room[at] >= length
            at, h = at[keep], h[keep] + codes[at[keep] + length - 1] * power
            with np.errstate(over="ignore"):
                power = power * PRIME
            where = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[where] == h
            ids = self.ids[where[known]]
            if length == 1:
                lone = np.ones(len(codes), bool)
                lone[at[known][ids >= 0]] = False
                lone = np.flatnonzero(lone)
                out.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1), np.full(len(lone), self.unknown)))
            at, h = at[known], h[known]
            out.append((at[ids >= 0], np.full(int((ids >= 0).sum()), length), ids[ids >= 0], self.scores[ids[ids >= 0]]))
            if not len(at):
                break
        first, length, piece, score = (np.concatenate(x) for x in zip(*out, strict=True))
        starts = ends - lengths + np.arange(len(blocks))
        return first + block[first], length, piece, score, block[first], starts

    def solve(self, blocks: list[str]) -> None:
        """Best segmentation and loss of the second best of new blocks, all at once."""
        first, length, piece, score, block, starts = self.arcs(blocks)
        ends = np.concatenate((starts[1:], [starts[-1] + len(blocks[-1]) + 1])) - 1
        n = int(ends[-1]) + 1
        rel = first - starts[block]
        order = np.lexsort((length, rel))
        first, length, piece, score, block, rel = (x[order] for x in (first, length, piece, score, block, rel))
        last = first + length
        cuts = np.flatnonzero(np.diff(rel * 64 + length, prepend=-1))
        spans = list(zip(cuts, [*cuts[1:], len(first)], strict=True))
        forward, back, via = np.full(n, -np.inf), np.full(n, -np.inf), np.full(n, -1)
        forward[starts], back[ends] = 0.0, 0.0
        for a, b in spans:
            value = forward[first[a:b]] + score[a:b]
            better = value > forward[last[a:b]]
            forward[last[a:b][better]] = value[better]
            via[last[a:b][better]] = np.arange(a, b)[better]
        for a, b in reversed(spans):
            back[first[a:b]] = np.maximum(back[first[a:b]], back[last[a:b]] + score[a:b])
        node, who, path = ends.copy(), np.arange(len(blocks)), []
        while len(node):
            arc = via[node]
            path.append((who, arc))
            node = first[arc]
            going = node > starts[who]
            node, who = node[going], who[going]
        owner = np.concatenate([w for w, _ in path[::-1]])
        taken = np.concatenate([a for _, a in path[::-1]])
        by = np.argsort(owner, kind="stable")
        owner, taken = owner[by], taken[by]
        through = forward[first] + score + back[last]
        through[taken] = -np.inf
        by = np.argsort(block, kind="stable")
        heads = np.flatnonzero(np.diff(block[by], prepend=-1))
        second = np.maximum.reduceat(through[by], heads)
        chosen = piece[taken]
        counts = np.bincount(owner, minlength=len(blocks))
        unknown = np.bincount(owner[chosen < 0], minlength=len(blocks)) > 0
        packed, at = chosen.astype("<u2").tobytes(), np.concatenate(([0], np.cumsum(counts)))
        base = len(self.best)
        for k, b in enumerate(blocks):
            ids = packed[2 * at[k] : 2 * at[k + 1]]
            if unknown[k]:
                offset, ids = 0, b""
                for arc in taken[at[k] : at[k + 1]]:
                    ids += self.spelled(piece[arc], b[offset : offset + length[arc]])
                    offset += length[arc]
            self.row[b] = base + k
            self.best.append(ids)
        counts = np.array([len(x) // 2 for x in self.best[base:]], np.int64)
        self.total = np.concatenate((self.total, forward[ends]))
        self.loss = np.concatenate((self.loss, forward[ends] - second))
        self.count = np.concatenate((self.count, counts))

    def solve_long(self, block: str) -> None:
        """The same for one long block, node by node; its memory is that of its arcs."""
        found = self.nbest(block, 2)
        self.row[block] = len(self.best)
        self.best.append(found[0][1])
        self.total = np.append(self.total, found[0][0])
        self.loss = np.append(self.loss, found[0][0] - found[1][0] if len(found) > 1 else np.inf)
        self.count = np.append(self.count, len(found[0][1]) // 2)

    def spelled(self, piece: int, text: str) -> bytes:
        """The ids of an arc, two bytes each."""
        ids = [piece] if piece >= 0 else [self.bytes_at + x for x in text.encode()]
        return np.array(ids, "<u2").tobytes()

    def lattice(self, block: str) -> tuple:
        """The arcs of one block's lattice by the node they end at: first nodes, pieces (-1: bytes), scores, and where each node's arcs begin."""
        if len(block) > SHORT:
            first, length, piece, score, _, _ = self.arcs([block])
            order = np.lexsort((length, first + length))
            heads = np.searchsorted((first + length)[order], np.arange(len(block) + 2))
            return first[order].astype(np.int32), piece[order].astype(np.int32), score[order], heads
        marked, ids = "".join(chr(0x10FFFF) if c == "▁" else "▁" if c == " " else c for c in block), self.id_of
        first, pieces, scores, heads = [], [], [], [0]
        for b in range(len(block) + 1):
            for a in range(max(0, b - self.longest), b):
                if (piece := ids.get(marked[a:b])) is not None:
                    first.append(a)
                    pieces.append(piece)
                    scores.append(self.score[piece])
            if b and marked[b - 1] not in ids:
                first.append(b - 1)
                pieces.append(-1)
                scores.append(self.unknown)
            heads.append(len(first))
        return first, pieces, scores, heads

    def nbest(self, block: str, n: int) -> list[tuple[float, bytes]]:
        """A block's n best segmentations by backward A-star, the forward Viterbi scores being exact heuristics.

        With exact heuristics a partial path goes on along the best arcs at no cost, so the agenda holds only where
        paths leave them: each entry is its parent's and one more arc, and its cost what that arc loses.
        """
        first, pieces, scores, heads = self.lattice(block)
        end = len(block)
        forward, via = array("d", [0.0]) * (end + 1), array("q", [-1]) * (end + 1)
        for node in range(1, end + 1):
            best, by = -np.inf, -1
            for k in range(heads[node], heads[node + 1]):
                if (value := forward[first[k]] + scores[k]) > best:
                    best, by = value, k
            forward[node], via[node] = best, by

        def leaving(node: int) -> Iterator[tuple[float, int, int]]:
            """What it costs to leave the best path back from a node, at each node on it."""
            while node:
                for k in range(heads[node], heads[node + 1]):
                    if k != via[node]:
                        yield forward[node] - (forward[first[k]] + scores[k]), k, node
                node = first[via[node]]

        def spelled(path: tuple) -> bytes:
            turns, node, ids = {}, end, []
            while path:
                path, arc, at = path
                turns[at] = arc
            while node:
                arc = turns.get(node, via[node])
                ids += [int(pieces[arc])] if pieces[arc] >= 0 else [self.bytes_at + x for x in block[first[arc] : node].encode()[::-1]]
                node = first[arc]
            return np.array(ids[::-1], "<u2").tobytes()

        agenda, out, serial = [(0.0, 0, (), end)], [], 1
        while agenda and len(out) < n:
            cost, _, path, node = heapq.heappop(agenda)
            out.append((float(forward[end] - cost), spelled(path)))
            for more, arc, at in heapq.nsmallest(n - len(out), leaving(node)):
                heapq.heappush(agenda, (cost + more, serial, (path, arc, at), first[arc]))
                serial += 1
        return out

    def encode(self, text: str, n: int = 1) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text: scores and ids (two bytes each, little-endian)."""
        return self.encode_all([text], n)[0]

    def encode_all(self, texts: list[str], n: int = 1) -> list[list[tuple[float, bytes]]]:
        split = [self.block.findall(" " + t) if t else [] for t in texts]
        if len(self.row) > self.limit or self.held > 100 * self.limit:
            self.clear()
        flat = [b for blocks in split for b in blocks]
        known = list(map(self.row.get, flat))
        if None in known:
            fresh = dict.fromkeys(b for b, r in zip(flat, known, strict=True) if r is None)
            self.held += sum(map(len, fresh))
            if short := [b for b in fresh if len(b) <= LONG]:
                self.solve(short)
            for b in fresh:
                if len(b) > LONG:
                    self.solve_long(b)
            known = [self.row[b] if r is None else r for b, r in zip(flat, known, strict=True)]
        every, end = np.array(known, np.int64), 0
        out = []
        for blocks in split:
            end += len(blocks)
            rows = every[end - len(blocks) : end]
            parts = [self.best[r] for r in known[end - len(blocks) : end]]
            found = [(float(self.total[rows].sum()), b"".join(parts))]
            if n > 1 and len(rows):
                loss = self.loss[rows]
                near = np.argpartition(loss, n - 2)[: n - 1] if len(loss) >= n else np.arange(len(loss))
                lists = {int(k): (self.alternatives if len(blocks[k]) <= SHORT else self.nbest)(blocks[k], n) for k in near.tolist() if np.isfinite(loss[k])}
                found += self.combined(found[0][0], parts, lists, n)[1:]
            out.append(found)
        return out

    @staticmethod
    def combined(total: float, parts: list[bytes], lists: dict[int, list[tuple[float, bytes]]], n: int) -> list[tuple[float, bytes]]:
        """The n best choices of one segmentation from each list, best first."""
        keys = sorted(lists)
        agenda, seen, out = [(-total, (0,) * len(keys))], {(0,) * len(keys)}, []
        while agenda and len(out) < n:
            cost, choice = heapq.heappop(agenda)
            whole = list(parts)
            for k, c in zip(keys, choice, strict=True):
                whole[k] = lists[k][c][1]
            out.append((-cost, b"".join(whole)))
            for j, k in enumerate(keys):
                nxt = (*choice[:j], choice[j] + 1, *choice[j + 1 :])
                if nxt[j] < len(lists[k]) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(agenda, (cost + lists[k][nxt[j] - 1][0] - lists[k][nxt[j]][0], nxt))
        return out

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<u2").tolist()]).decode("utf-8", "replace")[1:]


def process_pieces(model: str, scores: str = "zipf") -> Pieces:
    """The Pieces of this worker process, which later tasks find with what they have cached."""
    held = sys.modules.setdefault("_spanloom_process", types.ModuleType("_spanloom_process")).__dict__
    if (model, scores) not in held:
        held[model, scores] = Pieces(model, scores)
    return held[model, scores]


def encode(docs: DataFrame, model: str = MODEL, n: int = 4, scores: str = "zipf", ids: bool = True) -> DataFrame:
    """Per document: n_pieces, ids (if asked for), ids_sha256, nbest_scores, nbest_pieces (how many pieces each has), decoded_sha256, round_trip."""
    fields = ["n_pieces long", *["ids array<int>"] * ids, "ids_sha256 string", "nbest_scores array<double>", "nbest_pieces array<int>", "decoded_sha256 string", "round_trip boolean"]
    names = [f.split()[0] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pieces = process_pieces(model, scores)
        for batch in batches:
            texts, found = [t or "" for t in batch.column(1).to_pylist()], []
            for k in range(0, len(texts), 256):
                found += pieces.encode_all(texts[k : k + 256], n)
            out: dict = {"doc_id": batch.column(0)} | {name: [] for name in names}
            for text, best in zip(texts, found, strict=True):
                decoded = pieces.decode(best[0][1])
                row = {"n_pieces": len(best[0][1]) // 2, "ids_sha256": hashlib.sha256(best[0][1]).hexdigest(), "nbest_scores": [round(s, 6) for s, _ in best], "nbest_pieces": [len(x) // 2 for _, x in best], "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest(), "round_trip": decoded == text}
                row["ids"] = np.frombuffer(best[0][1], "<u2").astype(np.int32) if ids else None
                for name in names:
                    out[name].append(row[name])
            yield out

    return common.arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(fields))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pieces = process_pieces(model)
        for batch in batches:
            yield {"doc_id": batch.column(0), "text": [pieces.decode(np.array(x or [], "<u2").tobytes()) for x in batch.column(1).to_pylist()]}

    return common.arrow_map(encoded.select("doc_id", "ids"), run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def op3_pieces(spark, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), ids=False)
