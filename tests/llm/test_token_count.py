import random
import re

from llm_helpers import rows

from demandkit.llm import token_count as tc
from demandkit.llm.queries import COUNTING_MODEL, tokenizer_path


def pre_tokens(text):
    return [tc.MARK + w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text or "") if w]


def brute(word, model):
    """Best score and fewest tokens by all segmentations, without sharing."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [
            (best[s][0] + model.pieces[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in model.pieces
        ]
        if not options:
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + n * model.byte_score, -(best[end - 1][1] + n))]
        score, n = max(options)
        best.append((score, -n))
    return best[-1][1]


def test_trie_against_plain_dynamic_programming():
    model = tc.Unigram.from_model(tokenizer_path(COUNTING_MODEL))
    rng = random.Random(6)
    syllables = ["th", "er", "ing", "ü", "日本", "x", "zz", "tion", "!", "é", "🙂", "tok", "en"]
    words = [tc.MARK + "".join(rng.choice(syllables) for _ in range(rng.randrange(9))) for _ in range(800)]
    words = sorted({*words, *(w * 20 for w in words[:40])})
    for inserted in (7, 100_000):
        trie = tc.TokenTrie(model, inserted=inserted)
        assert trie.insert(words) == [brute(w, model) for w in words]
    small = tc.TokenTrie(model, max_counts=50, inserted=10)
    texts = [" ".join(words[i : i + 7]).replace(tc.MARK, "") for i in range(0, 800, 7)]
    got = [c for i in range(0, len(texts), 5) for c in small.count_texts(texts[i : i + 5])]
    assert got == [(len(w), sum(brute(x, model) for x in w)) for w in map(pre_tokens, texts)]


def test_ties_take_fewer_tokens_and_a_longer_way_round_wins():
    """Equal scores over different numbers of pieces; pieces reached only through longer endings."""
    model = tc.Unigram({"a": -1.0, "b": -1.0, "ab": -2.0, "abc": -3.0, "c": -1.0, "xabcd": -0.5}, -9.0)
    words = ["abc", "abcabc", "d", "xab", "xabcd", "zxabcdab"]
    assert tc.TokenTrie(model).insert(words) == [brute(w, model) for w in words] == [1, 2, 1, 2, 1, 3]


def test_prefixes_are_scored_once():
    model = tc.Unigram({"a": -1.0, "ab": -1.5, "b": -1.0, "c": -1.0}, -9.0)
    trie = tc.TokenTrie(model)
    assert trie.insert(["ab", "abc", "abcc", "b", "é"]) == [1, 2, 3, 1, 2]
    assert trie.size == len({"a", "ab", "abc", "abcc", "b", "é"})
    long = ["▁" + "ab" * 40, "▁" + "ab" * 40 + "c"]
    assert trie.insert(long) == [brute(w, model) for w in long]


def test_documents(odd_docs, clashing, no_docs):
    path = tokenizer_path(COUNTING_MODEL)
    model = tc.Unigram.from_model(path)
    want = sorted(
        ((r.doc_id, len(w), sum(brute(x, model) for x in set(w) for _ in range(w.count(x)))) for r in odd_docs.collect() if len(r.text or "") < 5000 for w in [pre_tokens(r.text)]),
        key=lambda t: (t[0] is not None, t),
    )
    small = clashing.filter("text is null or length(text) < 5000")
    assert rows(tc.count_tokens(small, path), "doc_id", "n_pretokens", "n_tokens") == want
    long = tc.count_tokens(odd_docs.filter("doc_id = 28"), path).first()
    assert long.n_pretokens == 30_000 and long.n_tokens == 30_000 * brute(tc.MARK + "word", model)
    assert tc.count_tokens(no_docs, path).count() == 0
