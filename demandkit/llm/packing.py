"""Vector bin packing of tokenised examples into training sequences.

Every sequence has three limits at once: tokens, segments and loss-bearing
tokens.  The open sequence takes, again and again, the example with the largest
dot product of its demand and the room that is left (each dimension scaled by
its limit and weighted by the mean demand), among those that fit.  When none
fits, an example is cut at the end of the sequence if at least ``min_cut``
tokens and one segment are free.

Each Spark partition packs its own rows, in chunks of bounded size, so nothing
is shuffled and a lost task is repeated alone; one unfilled sequence per chunk
is the price.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandkit.llm.text import few_at_a_time, ship_package

END_ID = 1
SEQUENCE_TOKENS = 2048
MAX_SEGMENTS = 64
MIN_CUT = 16
CHUNK_TOKENS = 1 << 20
CHUNK_DOCS = 1 << 13
CACHED_PIECES = 1 << 19
ENCODED_DOCS = 256  # at once, so that their words stay few
# Python's split() takes these for spaces, the tokenizer does not.
ODD_SPACES = re.compile(r"[\x1c-\x1f]")
# Texts of ASCII (no apostrophe, which may begin a contraction) and accented Latin-1 letters, and their pieces.
PLAIN = re.compile(r"[\x00-\x1b !-&(-\x7fÀ-ÖØ-öø-ÿ]*")
WORDS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+")


class Encoder:
    """Token ids of texts by a ``tokenizers`` file that drops white space between words.

    Such a tokenizer treats each run without white space alone, and in plain
    Latin text each word and each string of marks, so the ids of those pieces
    are kept (a bounded number).  New words are encoded many at a time: a word's
    last token ends in the word-end suffix, which tells where it ends among the
    ids.
    """

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.cached = cached
        self.known: dict[str, bytes] = {}

    def _whole(self, encoding) -> bytes:
        return np.array(encoding.ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str], runs: list[str]) -> None:
        """Keep the ids of words (one word end each) and of runs."""
        for lo in range(0, len(words), 4096):
            part = words[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                raw, stops = ids.tobytes(), (4 * ends).tolist()
                self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *stops], stops)]))
            else:
                runs = runs + part
        self.known.update(zip(runs, map(self._whole, self.tokenizer.encode_batch_fast(runs, add_special_tokens=False))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        pieces = [WORDS.findall(t) if easy else None if ODD_SPACES.search(t) else t.split() for t, easy in zip(texts, plain)]
        words = set(chain.from_iterable(p for p, easy in zip(pieces, plain) if easy))
        runs = set(chain.from_iterable(p for p, easy in zip(pieces, plain) if p and not easy))
        if len(self.known) + len(words) + len(runs) > self.cached:
            self.known = {}
        words = words.difference(self.known)
        self._learn(list(words), list(runs.difference(self.known).difference(words)))
        return [
            self._whole(self.tokenizer.encode(t, add_special_tokens=False)) if own is None else b"".join(map(self.known.__getitem__, own))
            for t, own in zip(texts, pieces)
        ]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(
    tokens: np.ndarray,
    loss: np.ndarray,
    max_tokens: int = SEQUENCE_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    min_cut: int = MIN_CUT,
) -> list[tuple[int, int, int, int, int]]:
    """Place examples of ``tokens`` ids, the last ``loss`` of them loss-bearing.

    Returns pieces (example, start, length, sequence, offset).  Every id is in
    exactly one piece; no sequence passes any limit.  Examples without tokens
    have no piece.
    """
    max_loss = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be at least 1")
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    kinds: dict[tuple[int, int], list[tuple[int, int]]] = {}  # equal demands are interchangeable

    def waiting(example: int, start: int) -> None:
        n = int(tokens[example]) - start
        kinds.setdefault((n, min(n, int(loss[example]))), []).append((example, start))

    # An example over a limit gives full sequences first; its rest competes.
    for i in range(len(tokens)):
        start, n, bearing = 0, int(tokens[i]), int(loss[i])
        while n - start > max_tokens or min(n - start, bearing) > max_loss:
            quiet = max(0, n - start - bearing)  # leading ids without loss
            take = min(max_tokens, n - start, quiet + max_loss)
            pieces.append((i, start, take, sequence, 0))
            sequence, start = sequence + 1, start + take
        if n > start:
            waiting(i, start)
    if not kinds:
        return pieces
    limits = np.array([max_tokens, max_segments, max_loss], dtype=float)
    space = 2 * len(kinds) + 16
    demand = np.zeros((space, 3))
    count = np.zeros(space, dtype=np.int64)
    rows: list[list[tuple[int, int]]] = []
    row_of: dict[tuple[int, int], int] = {}
    for (n, bearing), group in kinds.items():
        row_of[n, bearing] = len(rows)
        demand[len(rows)] = n, 1, bearing
        count[len(rows)] = len(group)
        rows.append(group)
    used = len(rows)
    total = (demand[:used] * count[:used, None]).sum(0) / limits
    weights = total / max(total.sum(), 1e-12)
    left = int(count.sum())
    room, offset = limits.copy(), 0
    while left:
        score = demand[:used] @ (weights * room / limits**2)
        score[count[:used] == 0] = -1.0
        fitting = score.copy()
        fitting[(demand[:used, 0] > room[0]) | (demand[:used, 2] > room[2])] = -1.0
        r = int(fitting.argmax())
        if room[1] >= 1 and fitting[r] >= 0:
            n = int(demand[r, 0])
        else:
            n = int(min(room[0], room[2]))
            if offset == 0 or n < min_cut or room[1] < 1:
                sequence, offset, room = sequence + 1, 0, limits.copy()
                continue
            r = int(score.argmax())
            quiet = int(demand[r, 0] - demand[r, 2])
            n = int(min(room[0], quiet + room[2], demand[r, 0] - 1))
        example, start = rows[r].pop()
        count[r] -= 1
        left -= 1
        bearing = max(0, n - max(0, int(demand[r, 0] - demand[r, 2])))
        pieces.append((example, start, n, sequence, offset))
        room -= (n, 1, bearing)
        offset += n
        rest = int(demand[r, 0]) - n
        if rest:
            kind = (rest, min(rest, int(demand[r, 2])))
            at = row_of.get(kind)
            if at is None:
                if used == len(demand):
                    demand, count = np.concatenate([demand, np.zeros_like(demand)]), np.concatenate([count, np.zeros_like(count)])
                at = row_of[kind] = used
                demand[at] = kind[0], 1, kind[1]
                rows.append([])
                used += 1
            rows[at].append((example, start + n))
            count[at] += 1
            left += 1
    return pieces


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = END_ID,
    max_tokens: int = SEQUENCE_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    min_cut: int = MIN_CUT,
    chunk_tokens: int = CHUNK_TOKENS,
    max_loss: int | None = None,
    loss: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, segment.

    A document is its ids and then ``end_id``; every id but the document's first
    bears loss (the first has nothing to be predicted from).  A column ``loss`` may say how many of its last ids
    bear loss instead (NULL: all but the first).  ``max_loss`` limits them in a sequence; without it they have
    no limit but ``max_tokens``.  NULL text counts as empty: one piece that holds
    ``end_id``.  Repeated rows are packed as often as they occur.  ``sequence_id``
    is unique over partitions, with gaps; ``offset`` and ``segment`` count from 0
    in each sequence.  Other columns are ignored; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    few_at_a_time(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def flush(ids: list[int | None], held: list[bytes], given: list[float | None], sequence: int) -> tuple[pa.RecordBatch, int]:
        n = np.array([len(x) // 4 for x in held])
        bears = np.array([np.inf if x is None or np.isnan(x) else x for x in given])
        bearing = np.clip(np.minimum(bears, n - 1), 0, None).astype(np.int64)
        placed = pack(n, bearing, max_tokens, max_segments, max_loss, min_cut)
        out, segments = [], {}
        for i, start, length, seq, offset in placed:
            segment = segments[seq] = segments.get(seq, -1) + 1
            crc = zlib.crc32(memoryview(held[i])[4 * start : 4 * (start + length)])
            own_loss = max(0, start + length - max(start, int(n[i] - bearing[i])))
            out.append((ids[i], start, length, crc, int(n[i]), sequence + seq, offset, own_loss, segment))
        last = max((p[3] for p in placed), default=-1)
        columns = [pa.array(c, pa.int64()) for c in zip(*out)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")]), sequence + last + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        held: list[bytes] = []
        given: list[float | None] = []
        size = 0
        # A few texts at a time become Python strings.
        for part in (batch.slice(lo, ENCODED_DOCS) for batch in batches for lo in range(0, batch.num_rows, ENCODED_DOCS)):
            doc_ids, texts, bears = (part.column(c).to_pylist() for c in ("doc_id", "text", "loss"))
            for doc_id, own, encoded in zip(doc_ids, bears, encoder.encode(["" if t is None else t for t in texts])):
                given.append(own)
                ids.append(doc_id)
                held.append(encoded + end)
                size += len(encoded) // 4 + 1
                if size >= chunk_tokens or len(held) >= CHUNK_DOCS:
                    frame, sequence = flush(ids, held, given, sequence)
                    yield frame
                    ids, held, given, size = [], [], [], 0
        if held:
            yield flush(ids, held, given, sequence)[0]

    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "loss_tokens long, segment long"
    )
    bears = F.lit(None) if loss is None else F.col(loss)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", bears.cast("double").alias("loss"))
    return rows.mapInArrow(run, schema)
