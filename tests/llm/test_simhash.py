import random

import xxhash
from llm_helpers import rows

from demandkit.llm import simhash
from demandkit.llm.components import connected_components


def brute_fingerprint(text, k=3):
    spaced = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "")
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in spaced).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, d):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= d:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_against_brute_force(odd_docs):
    for r in odd_docs.collect():
        if len(r.text or "") < 5000:
            assert simhash.fingerprint(r.text) == brute_fingerprint(r.text), r


def test_spark_hash_is_the_same_function(spark):
    got = spark.sql("select xxhash64('a b c') as h").first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def near_texts(rng, n=60):
    """Texts in families that differ in a few words."""
    docs = []
    for _ in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(300)]
        for _ in range(rng.randrange(1, 5)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(300)] = "changed"
            docs.append(" ".join(own))
    return docs


def test_components_against_brute_force(spark, odd_docs):
    texts = near_texts(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [brute_fingerprint(t) for t in texts]
    for d, blocks, hot in ((2, 4, 32), (2, 4, 1), (2, 3, 2), (3, 4, 1), (1, 4, 1), (0, 1, 1)):
        want = brute_components(fps, d)
        smallest = {}
        for i, r in enumerate(want):
            smallest.setdefault(r, i)
        got = simhash.near_duplicates(docs, max_distance=d, blocks=blocks, hot_bucket=hot)
        assert rows(got, "doc_id", "fingerprint", "component_id") == [
            (i, f"{fps[i]:016x}", smallest[r]) for i, r in enumerate(want)
        ], (d, blocks, hot)
    got = {(r.doc_id, r.row_key): r.component_id for r in simhash.near_duplicates(odd_docs).collect()}
    empty = [v for (i, _), v in got.items() if i in (20, 21, 22, 23)]
    assert empty == [20] * len(empty) and empty


def test_hot_bucket_stays_linear(spark):
    """One key shared by a thousand fingerprints: links are found without all pairs."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 1000:
        x = base
        for _ in range(rng.randrange(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    got = connected_components(simhash.links(frame))
    roots = {r.node % (1 << 64): r.root for r in got.collect()}
    want = brute_components(fps, 2)
    by_root, by_want = {}, {}
    for f, w in zip(fps, want):
        by_want.setdefault(w, set()).add(f)
        by_root.setdefault(roots.get(f, f"alone {f}"), set()).add(f)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_want.values()))
    assert simhash.links(frame).count() <= 65 * len(fps)


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.range(300).selectExpr("id as a", "id + 1 as b")
    got = connected_components(path)
    assert got.count() == 301 and [r.root for r in got.select("root").distinct().collect()] == [0]
    assert connected_components(path.filter("a < 0")).count() == 0


def test_keep_one(odd_docs, clashing, no_docs):
    near = simhash.near_duplicates(odd_docs)
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == near.select("root").distinct().count()
    again = simhash.keep_one(clashing)
    assert again.columns == clashing.columns and rows(again, "doc_id", "text") == rows(kept, "doc_id", "text")
    assert simhash.keep_one(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0
