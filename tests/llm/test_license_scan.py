import random
from math import ceil

import pytest
from llm_helpers import rows, unordered, words

from demandkit.llm import license_scan as scan

COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def brute(docs, phrases=scan.PHRASES, templates=scan.TEMPLATES, threshold=0.8, block=64):
    out = []
    for r in docs:
        w, places, base = words(r.text), [], set()
        for label, phrase in phrases.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    base.add(label)
        more, best = set(base), 0.0
        vocabulary = {x for t in templates for x in t[1].split() + t[3].split()}
        marked = [x if x in vocabulary else "" for x in w]
        for held in {frozenset(marked[start : start + block]) for start in range(len(w))}:
            for label, wording, deciding, excluded in templates:
                tokens = set(wording.split())
                overlap = len(tokens & held)
                if overlap >= ceil(threshold * len(tokens) - 1e-9) and held.issuperset(deciding.split()) and not held & set(excluded.split()):
                    more.add(label)
                    best = max(best, overlap / len(tokens))
        score = 1.0 if places else best
        first, last = (min(places), max(places)) if places else (None, None)
        out.append((r.doc_id, len(w), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(more)), score))
    return unordered(out)


def make(spark, rng):
    texts = []
    fill = ["lorem", "the", "of", "under", "license", "public", "work", "and", "4", "0", "2"]
    for wording in [t[1] for t in scan.TEMPLATES] + list(scan.PHRASES.values()):
        for dropped in range(min(5, len(wording.split()))):
            w = wording.split()
            for _ in range(dropped):
                w.pop(rng.randrange(len(w)))
            before = [rng.choice(fill) for _ in range(rng.randrange(120))]
            after = [rng.choice(fill) for _ in range(rng.randrange(120))]
            texts.append(" ".join(before + [x.upper() if rng.random() < 0.2 else x for x in w] + after))
    texts += ["CC BY-NC cc by nc, under the MIT License (apache license, version 2.0)", "cc by cc by nc"]
    return spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string")


def test_against_brute_force(spark, odd_docs):
    docs = make(spark, random.Random(4)).unionByName(odd_docs.select("doc_id", "text"))
    want = brute(docs.collect())
    assert rows(scan.scan(docs), *COLUMNS) == want
    labels = {x for r in want for x in r[6].split(",")}
    assert {t[0] for t in scan.TEMPLATES} <= labels
    assert rows(scan.scan(docs, threshold=0.6, block_words=80), *COLUMNS) == brute(docs.collect(), threshold=0.6, block=80)


def test_a_spread_notice_is_found_wherever_it_starts(spark):
    """A notice dealt over 50 words lies in no fixed grid of blocks; every one of 64 offsets finds it, and 70 words are too far."""
    tokens = scan.TEMPLATES[0][1].split()
    for spread, found in ((50, True), (70, False)):
        gap = (spread - len(tokens)) // (len(tokens) - 1) + 1
        notice = [x for t in tokens for x in [t] + ["filler"] * (gap if found else 5)][: None if not found else spread]
        docs = [(k, " ".join(["filler"] * k + notice + ["filler"] * 90)) for k in range(64)]
        got = scan.scan(spark.createDataFrame(docs, "doc_id long, text string"))
        assert {r.labels for r in got.collect()} == {"mit" if found else ""}
        assert rows(got, *COLUMNS) == brute([type("R", (), {"doc_id": i, "text": t}) for i, t in docs])


def test_siblings_keep_their_own_label(spark):
    said = {
        "Licensed under CC BY 4.0": "cc-by",
        "This text is licensed under CC BY-SA 4.0.": "cc-by-sa",
        "Licensed under CC-BY-NC 4.0": "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "This work is licensed under the GNU Lesser General Public License version 3": "",
        "licensed under by 4 0": "",
    }
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    assert [r.labels for r in scan.scan(docs).orderBy("doc_id").collect()] == list(said.values())


def test_word_order_counts_documents(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "A d"), (4, None)], "doc_id long, text string")
    assert scan.word_order(docs, ["a", "b", "c", "zz"]) == ["zz", "b", "c", "a"]


def test_odd_tables(spark, clashing, odd_docs, no_docs):
    assert rows(scan.scan(clashing), *COLUMNS) == brute(odd_docs.collect())
    assert scan.scan(no_docs).count() == 0
    with pytest.raises(ValueError):
        scan.matches(odd_docs, block_words=10)


def test_no_python_in_the_plan(odd_docs):
    plan = scan.scan(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
