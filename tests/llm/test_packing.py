import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import rows

from demandkit.llm import packing
from demandkit.llm.queries import PACKING_TOKENIZER, tokenizer_path


def check_pieces(pieces, tokens, loss, max_tokens, max_segments, max_loss):
    spans, sequences = defaultdict(list), defaultdict(list)
    for example, start, length, sequence, offset in pieces:
        assert length > 0
        spans[example].append((start, length))
        quiet = tokens[example] - loss[example]
        sequences[sequence].append((offset, length, max(0, start + length - max(start, quiet))))
    for i, n in enumerate(tokens):
        at = 0
        for start, length in sorted(spans[i]):
            assert start == at
            at += length
        assert at == n
    for own in sequences.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= max_tokens and len(own) <= max_segments and sum(x[2] for x in own) <= max_loss
    assert sorted(sequences) == list(range(len(sequences)))


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=30),
    st.integers(1, 20),
    st.integers(1, 6),
    st.integers(1, 20),
    st.integers(1, 6),
)
def test_every_id_once_and_no_limit_passed(examples, max_tokens, max_segments, max_loss, min_cut):
    tokens = np.array([a for a, _ in examples], dtype=int)
    loss = np.array([min(a, b) for a, b in examples], dtype=int)
    pieces = packing.pack(tokens, loss, max_tokens, max_segments, max_loss, min_cut)
    check_pieces(pieces, tokens, loss, max_tokens, max_segments, max_loss)


def test_little_padding():
    rng = random.Random(1)
    tokens = np.array([int(rng.lognormvariate(6, 1)) + 1 for _ in range(3000)])
    pieces = packing.pack(tokens, tokens - 1)
    check_pieces(pieces, tokens, tokens - 1, 2048, 64, 2048)
    sequences = 1 + max(p[3] for p in pieces)
    assert 1 - tokens.sum() / (2048 * sequences) < 0.01


def test_limits_must_be_positive():
    with pytest.raises(ValueError):
        packing.pack(np.array([1]), np.array([1]), max_segments=0)


def test_encoder_is_the_tokenizer(odd_docs):
    from tokenizers import Tokenizer

    path = tokenizer_path(PACKING_TOKENIZER)
    plain = Tokenizer.from_file(path)
    texts = [r.text or "" for r in odd_docs.collect()]
    texts += ["don't 'tis it's' 12a 3.5", "é ́x", "a b c​d\x85e", "<|startoftext|>x<|endoftext|>", "ΣΑΣ ΟΔΟΣ ẞ ﬁ", "a\x1fb"]
    for encoder in (packing.Encoder(path), packing.Encoder(path, cached=3)):
        got = [np.frombuffer(b, dtype="<u4").tolist() for b in encoder.encode(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_rebuild_every_document(odd_docs, clashing, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer_path(PACKING_TOKENIZER)
    plain = Tokenizer.from_file(path)
    got = packing.pack_documents(clashing, path, max_tokens=64, chunk_tokens=500)
    want = defaultdict(int)
    for r in odd_docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got.collect():
        by_doc[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length, r.segment))
    for (doc_id, n), pieces in by_doc.items():
        copies = sum(c for (i, m, _), c in want.items() if (i, m) == (doc_id, n))
        assert sum(p.length for p in pieces) == copies * n
    singles = [r for r in got.filter("start = 0 and length = doc_tokens").collect()]
    assert all((r.doc_id, r.doc_tokens, r.ids_crc32) in want for r in singles) and singles
    for own in sequences.values():
        own.sort()
        assert [s for _, _, s in own] == list(range(len(own)))
        assert [o for o, _, _ in own] == [sum(x[1] for x in own[:k]) for k in range(len(own))]
        assert sum(x[1] for x in own) <= 64
    assert packing.pack_documents(no_docs, path).count() == 0
    assert rows(got, "doc_id")[0][0] is None


def test_loss_limit_binds_in_spark(spark):
    data = [(i, "word " * 20, [5, None, 0][i % 3]) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, bears int")
    got = packing.pack_documents(docs, tokenizer_path(PACKING_TOKENIZER), max_tokens=64, max_loss=12, loss="bears").collect()
    sums, own = defaultdict(int), defaultdict(int)
    for r in got:
        sums[r.sequence_id] += r.loss_tokens
        own[r.doc_id] += r.loss_tokens
    assert max(sums.values()) <= 12
    assert all(own[i] == (20 if b is None else b) for i, _, b in data)
