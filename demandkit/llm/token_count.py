"""Token counts under a unigram model, with forward scores shared in a trie of pre-tokens.

A pre-token is a run without ASCII white space behind a word mark.  The best
segmentation of every prefix of it is one node of a trie, so pre-tokens with a
common beginning share the scores of that beginning, and the node where a
pre-token ends holds its token count.  Distinct pre-tokens that a task has not
met before are sorted and inserted together: the nodes of one depth are where
neighbours begin to differ, and NumPy scores a whole depth at once.  Counts of
whole pre-tokens are kept for the task's later documents; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandkit.llm.text import ship_package

MARK = "▁"
MAX_COUNTS = 1 << 19  # pre-tokens whose counts a task keeps
INSERTED = 1 << 16  # pre-tokens of one trie
LONG = 64  # code points; longer pre-tokens share the first so many, and go on alone
COUNTED_CHARS = 1 << 22  # of texts split at once
BASE = np.uint64(0x9E3779B97F4A7C15)  # of the polynomial hash of a substring


def _codes(words: list[str]) -> np.ndarray:
    """Code points of all words, one after the other, each plus 1."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)


def _tables(endings: dict[str, float | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every length: sorted hashes of the endings, and their scores (NaN for those that are no piece)."""
    by_length: dict[int, list[str]] = {}
    for ending in endings:
        by_length.setdefault(len(ending), []).append(ending)
    out = []
    for length in range(1, max(by_length, default=0) + 1):
        held = by_length.get(length, [])
        hashed = np.zeros(len(held), dtype=np.uint64)
        for column in _codes(held).reshape(len(held), length).T:
            hashed = hashed * BASE + column
        scores = np.array([endings[e] for e in held], dtype=float)  # None becomes NaN
        order = np.argsort(hashed)
        if len(np.unique(hashed)) < len(held):
            raise ValueError("two pieces share a hash; choose another BASE")
        out.append((hashed[order], scores[order]))
    return out


class Unigram:
    """Pieces with log probabilities (below 0); characters outside the vocabulary fall back to their bytes."""

    def __init__(self, pieces: dict[str, float], byte_score: float):
        self.pieces = pieces
        self.byte_score = byte_score
        # Scores of pieces, and None for what a longer piece ends in, so a search backwards knows when to stop.
        self.endings: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(1, len(p))}
        self.endings.update(pieces)
        self.tables = _tables(self.endings)

    @classmethod
    def from_model(cls, path: str) -> Unigram:
        """Pieces of a sentencepiece file; the rank r in the file gives a score of -log(r + 1) (Zipf)."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)]
        skipped = set(special)
        pieces = [model.id_to_piece(i) for i in range(size) if i not in skipped]
        return cls({p: -log(r + 1) for r, p in enumerate(pieces, 1)}, -log(size + 1))


@lru_cache(maxsize=2)
def _unigram(path: str) -> Unigram:
    return Unigram.from_model(path)


class TokenTrie:
    """Best score and token count of every inserted prefix (higher score, then fewer tokens)."""

    def __init__(self, model: Unigram, max_counts: int = MAX_COUNTS, inserted: int = INSERTED):
        self.model = model
        self.max_counts = max_counts
        self.inserted = inserted
        self.terminal: dict[bytes, int] = {}
        self.size = 0  # nodes scored so far, over all tries

    def insert(self, words: list[str]) -> list[int]:
        """Token counts of distinct, sorted pre-tokens; a prefix that several share is scored once."""
        tables, byte_score = self.model.tables, self.model.byte_score
        codes = _codes(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(lengths) - lengths
        counts = np.zeros(len(words), dtype=np.int64)
        node = np.zeros(len(words), dtype=np.int64)  # of each word at the depth before
        active = np.arange(len(words))
        # Of every depth: scores, token counts, hash of the prefix, and the parent's number a depth above.
        score, tokens = [np.zeros(1)], [np.zeros(1, dtype=np.int64)]
        hashed, parents = [np.zeros(1, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)]
        power = [np.uint64(pow(int(BASE), k, 1 << 64)) for k in range(len(tables) + 1)]
        deepest = min(int(lengths.max(initial=0)), LONG)
        for depth in range(1, deepest + 1):
            active = active[lengths[active] >= depth]
            char, above = codes[starts[active] + depth - 1], node[active]
            first = np.ones(len(active), dtype=bool)
            first[1:] = (above[1:] != above[:-1]) | (char[1:] != char[:-1])
            own = np.cumsum(first) - 1
            node[active] = own
            char, parent = char[first], above[first]
            here = hashed[-1][parent] * BASE + char
            best, fewest = np.full(len(parent), -np.inf), np.zeros(len(parent), dtype=np.int64)
            alive, ancestor = np.arange(len(parent)), parent
            for length in range(1, min(depth, len(tables)) + 1):
                if length > 1:
                    ancestor = parents[depth - length + 1][ancestor]
                known, own_scores = tables[length - 1]
                suffix = here[alive] - hashed[depth - length][ancestor] * power[length]
                at = np.searchsorted(known, suffix)
                at[at == len(known)] = 0
                found = known[at] == suffix
                alive, ancestor, at = alive[found], ancestor[found], at[found]
                if not len(alive):  # no piece ends like any of these, nor would a longer one
                    break
                piece = own_scores[at]
                whole = ~np.isnan(piece)
                i, before = alive[whole], ancestor[whole]
                s, n = score[depth - length][before] + piece[whole], tokens[depth - length][before] + 1
                better = (s > best[i]) | (s == best[i]) & (n < fewest[i])
                i = i[better]
                best[i], fewest[i] = s[better], n[better]
            none = np.flatnonzero(np.isneginf(best))
            if len(none):
                width = np.searchsorted(np.array([0x80, 0x800, 0x10000], dtype=np.uint64), char[none] - np.uint64(1), side="right") + 1
                best[none] = score[-1][parent[none]] + width * byte_score
                fewest[none] = tokens[-1][parent[none]] + width
            for kept, new in ((score, best), (tokens, fewest), (hashed, here), (parents, parent)):
                kept.append(new)
                if depth > len(tables):
                    kept[depth - len(tables) - 1] = None  # no piece reaches so far back
            self.size += len(parent)
            done = active[lengths[active] == depth]
            counts[done] = fewest[node[done]]
        for i in np.flatnonzero(lengths > LONG).tolist():
            counts[i] = self._go_on(words[i])
        return counts.tolist()

    def _go_on(self, word: str) -> int:
        """Token count of one long pre-token, character by character."""
        ending, path = self.model.endings.get, [(0.0, 0)]
        for end in range(1, len(word) + 1):
            best = None
            for start in range(end - 1, -1, -1):
                own = ending(word[start:end], 0.0)
                if own is None:
                    continue
                if own == 0.0:  # no piece ends like this, nor would a longer one
                    break
                score, n = path[start][0] + own, path[start][1] + 1
                if best is None or score > best[0] or score == best[0] and n < best[1]:
                    best = score, n
            if best is None:
                n = len(word[end - 1].encode("utf-8", "replace"))
                best = path[-1][0] + n * self.model.byte_score, path[-1][1] + n
            path.append(best)
        return path[-1][1]

    def count_texts(self, texts: list[str]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        split = [t.encode("utf-8", "replace").split() for t in texts]
        met = set(chain.from_iterable(split))
        if len(self.terminal) > self.max_counts:
            self.terminal = {}
        new = sorted(met.difference(self.terminal))  # bytes sort like their code points
        for lo in range(0, len(new), self.inserted):
            part = new[lo : lo + self.inserted]
            self.terminal.update(zip(part, self.insert([MARK + w.decode() for w in part])))
        known = self.terminal.__getitem__
        return [(len(own), sum(map(known, own))) for own in split]


def _groups(texts: list[str], chars: int = COUNTED_CHARS) -> Iterator[list[str]]:
    """The texts in order, in groups of about ``chars`` code points."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def count_tokens(docs: DataFrame, model_path: str, max_counts: int = MAX_COUNTS) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, per input row.

    NULL and empty texts have no tokens.  Repeated rows give repeated results;
    other columns are ignored; an empty table gives an empty result.  The kept
    counts pass ``max_counts`` by one group of texts at most.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = TokenTrie(_unigram(model_path), max_counts)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.pop("text")]
            found = [c for group in _groups(texts) for c in trie.count_texts(group)]
            batch["n_pretokens"], batch["n_tokens"] = [c[0] for c in found], [c[1] for c in found]
            yield batch

    # A NULL doc_id would turn the column into floats in pandas; it travels as text.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = rows.mapInPandas(run, "doc_id string, n_pretokens long, n_tokens long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
