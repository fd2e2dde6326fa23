"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are word stems (the first 4, 5, 6 or 8 characters), and a stem that a text
holds at least 2 or 4 times is a further term each, since a cosine alone does
not see how much of a marker a text holds.  Labelled training rows, equal texts
once, choose the terms that go with the label (chi-square, and Fisher's exact
test, and at least twice as frequent in its rows); stems of one marker that stand in the same training rows are one term.
A term's weight is its TF-IDF times the square root of its chi-square per row
(its association with the label), so that many weak terms do not drown the
strong ones in a cosine; document frequencies are counted over all documents.
The labelled examples, a bounded sample, are an inverted index whose postings
lie in blocks of examples, each with the largest weight of every term in it.  A
document visits blocks by falling upper bound and stops when no block can still
hold a nearer example, so its ``k`` nearest are exact.  Their votes, weighted by similarity and by how many
training rows each example stands for, and shrunk to the base rate, give the
score; the nearest examples and the shared terms are its evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from demandkit.llm.text import few_at_a_time, pin, ship_package, without

STEMS = (4, 5, 6, 8)
TIMES = (2, 4)
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# Bounds of what is fitted on labelled rows and kept as the model.
FIT_PER_CLASS = 16_384  # labelled rows of each class that choose the terms
EXAMPLES_PER_CLASS = 2_048  # of those, indexed as neighbours
MIN_CHI2 = 12.0  # p about 0.0005
MAX_CHANCE = 0.0005  # the same exactly, as chi-square is too kind to terms of few rows
MIN_LIFT = 2.0  # toxic rows must hold a term so many times as often as clean ones: with many rows any small difference is significant
MIN_ROWS = 3  # toxic training rows must hold a term, however many there are: a rare language has few
COUNTED_DOCS = 256
HELD_TERMS = 1 << 17  # counted in a task before they are handed on
NEIGHBOURS = 15
BLOCK = 512
PRIOR_VOTES = 0.5
THRESHOLD = 0.7


def training_row(doc_id: Column) -> Column:
    """Labels may be learnt from this document (the others are held out)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def stem_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def stems(word: str) -> set[str]:
    return {word[:k] for k in STEMS}


def chance(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Probability that at least ``a`` of ``a + b`` rows, drawn from ``n1`` toxic and ``n0`` clean ones, are toxic (Fisher's exact test)."""
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n1 + n0 + 1)))])  # of factorials
    out = np.zeros(len(a))
    for i, (x, held) in enumerate(zip(a.tolist(), (a + b).tolist())):
        k = np.arange(x, min(held, n1, x + 1000) + 1)
        k = k[held - k <= n0]
        ways = log[n1] - log[k] - log[n1 - k] + log[n0] - log[held - k] - log[n0 - held + k]
        out[i] = np.exp(ways - (log[n1 + n0] - log[held] - log[n1 + n0 - held])).sum()
    return out


def one_per_marker(found: list[tuple[str, int]]) -> list[str]:
    """Of (term, mark of the rows that hold it), the shortest stem of those that grow from each other in the same rows."""
    by_rows: dict[tuple[int, str], list[str]] = {}
    for term, rows in sorted(found):
        stem, _, times = term.partition(" ")
        kept = by_rows.setdefault((rows, times), [])
        if not any(stem.startswith(k.partition(" ")[0]) for k in kept):
            kept.append(term)
    return sorted(t for kept in by_rows.values() for t in kept)


def terms_of(counts: Counter) -> Iterator[tuple[str, int]]:
    """Terms and their frequencies of a text whose stems occur ``counts`` times."""
    for stem, n in counts.items():
        yield stem, n
        for times in TIMES:
            if n >= times:
                yield f"{stem} {times}x", n


class TermIds(dict):
    """Which chosen stems a word has, looked up by its longest stem and kept."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.ids = {t: i for i, t in enumerate(terms)}
        self.stems = {t.split(" ")[0] for t in terms}

    def __missing__(self, head: str) -> tuple[str, ...]:
        if len(self) > 1 << 17:
            self.clear()
        found = self[head] = tuple(stems(head) & self.stems)
        return found

    def counts(self, text: str | None) -> dict[int, int]:
        """Frequencies of the chosen terms in a text, by term id, ids ascending."""
        held: Counter[str] = Counter()
        # Counted by their longest stem first, then spread over the chosen stems.
        for head, n in Counter([w[: STEMS[-1]] for w in stem_words(text or "")]).items():
            for stem in self[head]:
                held[stem] += n
        found = ((self.ids[t], n) for t, n in terms_of(held) if t in self.ids)
        return dict(sorted(found))


@dataclass
class Index:
    """Unit TF-IDF vectors of the examples as postings in blocks, with every block's largest weight of every term."""

    terms: list[str]
    idf: np.ndarray
    starts: np.ndarray  # of a block's postings of a term: [block, term], and the end behind the last term
    rows: np.ndarray  # example numbers within their block, of all postings
    weights: np.ndarray
    largest: np.ndarray  # [term, block]
    label: np.ndarray
    votes: np.ndarray  # training rows that the example stands for
    example_id: np.ndarray
    base_rate: float
    silent_rate: float  # of training rows without any chosen term

    def vector(self, ids: list[int], tf: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (as an array) and unit weights of a text's terms, ids ascending."""
        at = np.array(ids, dtype=np.int64)
        w = (1 + np.log(np.array(tf, dtype=float))) * self.idf[at] if len(at) else np.zeros(0)
        return at, w / max(np.sqrt((w * w).sum()), 1e-12)

    def nearest(self, ids: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a shared term (ties: smaller number)."""
        bound = w @ self.largest[ids]
        best_i, best_s = np.zeros(0, dtype=np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best_s) == k and bound[b] < best_s[-1] - 1e-12:
                break
            lo = self.starts[b, ids]
            held = self.starts[b, ids + 1] - lo
            # The block's postings of all terms, one after the other.
            at = np.arange(held.sum()) + np.repeat(lo - np.cumsum(held) + held, held)
            score = np.bincount(self.rows[at], weights=np.repeat(w, held) * self.weights[at], minlength=BLOCK)
            hit = np.flatnonzero(score > (best_s[-1] - 1e-12 if len(best_s) == k else 0))
            i, s = np.concatenate([best_i, hit + b * BLOCK]), np.concatenate([best_s, score[hit]])
            order = np.lexsort((i, -s))[:k]
            best_i, best_s = i[order], s[order]
        return best_i, best_s

    def score(self, ids: list[int], tf: list[int], k: int, prior_votes: float) -> tuple[float, np.ndarray]:
        """Score of a text with these terms, and its nearest examples."""
        if not len(ids):
            return self.silent_rate, np.zeros(0, dtype=np.int64)
        near, sims = self.nearest(*self.vector(ids, tf), k)
        weight = sims * self.votes[near]
        return float((weight @ self.label[near] + prior_votes * self.base_rate) / (weight.sum() + prior_votes)), near


def build_index(
    terms: list[str], idf: np.ndarray, examples: list[tuple[int, int, float, dict[int, int]]], base_rate: float, silent_rate: float
) -> Index:
    """An index over (doc_id, label, votes, term counts by ascending id); examples without terms are left out."""
    examples = [e for e in examples if e[3]]
    n_blocks = -(-len(examples) // BLOCK)
    index = Index(
        terms,
        idf,
        np.zeros((n_blocks, len(terms) + 1), dtype=np.int64),
        np.zeros(0, dtype=np.int64),
        np.zeros(0),
        np.zeros((len(terms), n_blocks)),
        np.array([e[1] for e in examples], dtype=float),
        np.array([e[2] for e in examples], dtype=float),
        np.array([e[0] for e in examples], dtype=np.int64),
        base_rate,
        silent_rate,
    )
    vectors = [index.vector(list(e[3]), list(e[3].values())) for e in examples]
    if not vectors:
        return index
    number = np.repeat(np.arange(len(vectors)), [len(ids) for ids, _ in vectors])
    term, weight = (np.concatenate(part) for part in zip(*vectors))
    order = np.lexsort((number, term, number // BLOCK))
    number, term, weight = number[order], term[order], weight[order]
    index.rows, index.weights = number % BLOCK, weight
    cells = number // BLOCK * (len(terms) + 1) + term
    index.starts = np.searchsorted(cells, np.arange(n_blocks * (len(terms) + 1))).reshape(n_blocks, -1)
    np.maximum.at(index.largest, (term, number // BLOCK), weight)
    return index


def _sampled_labels(labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Training labels (doc_id, y): all, or ``per_class`` of a class by hash order; and each class's full count.

    A doc_id labelled twice counts once, as toxic if any label says so.
    """
    known = (
        labels.select("doc_id", F.col("toxic").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(training_row(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").cast("int").alias("y"))
    )
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit("toxicity sample"))
    taken = known.filter("y = 1").orderBy(order, "doc_id").limit(per_class).unionByName(
        known.filter("y = 0").orderBy(order, "doc_id").limit(per_class)
    )
    return taken, sizes


@dataclass
class Chosen:
    """Terms and their association with the label, and the training rows that chose them."""

    terms: list[str]
    strength: np.ndarray  # chi-square
    train: DataFrame  # row_key, doc_id, y, text: equal texts once
    labelled: dict[int, int]  # labelled training rows of each class
    fitted: dict[int, int]  # of those in ``train``


def choose_terms(
    docs: DataFrame,
    labels: DataFrame,
    fit_per_class: int = FIT_PER_CLASS,
    max_terms: int | None = None,
    min_chi2: float = MIN_CHI2,
) -> Chosen:
    """The terms that go with the label in the training rows among ``docs``.

    Every term that passes the tests is chosen unless ``max_terms`` is given;
    the fitted rows bound how many there are.
    """
    ship_package(docs.sparkSession)
    sample, sizes = _sampled_labels(labels, fit_per_class)
    # At most 2 x fit_per_class small rows, so the broadcast is bounded and texts are not shuffled.
    rows = docs.select("doc_id", "text").join(F.broadcast(pin(sample, "toxicity-labels", few_files=True)), "doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    once = rows.groupBy(F.xxhash64(text).alias("row_key")).agg(
        F.min("doc_id").alias("doc_id"), F.max("y").alias("y"), F.first(text).alias("text")
    )
    train = pin(once, "toxicity-train", few_files=True)
    of = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = of.get(1, 0), of.get(0, 0)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        mark: dict[str, int] = {}  # of the rows that hold a term: the exclusive or of their keys

        def counted() -> pd.DataFrame:
            out = pd.DataFrame([(t, found[0][t], found[1][t], m) for t, m in mark.items()], columns=["term", "n0", "n1", "mark"])
            for c in (*found, mark):
                c.clear()
            return out

        for batch in batches:
            for text, y, key in zip(batch["text"], batch["y"], batch["row_key"].tolist()):
                counts: Counter[str] = Counter()
                for head, n in Counter([w[: STEMS[-1]] for w in stem_words(text)]).items():
                    for stem in stems(head):
                        counts[stem] += n
                held_terms = {t for t, _ in terms_of(counts)}
                found[y].update(held_terms)
                for t in held_terms:
                    mark[t] = mark.get(t, 0) ^ key
                if len(found[0]) + len(found[1]) > HELD_TERMS:
                    yield counted()
        yield counted()

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    table = train.mapInPandas(held, "term string, n0 long, n1 long, mark long").groupBy("term")
    table = table.agg(F.sum("n1").alias("a"), F.sum("n0").alias("b"), F.bit_xor("mark").alias("mark"))
    chi2 = F.try_divide(
        F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2.0)) * float(n0 + n1), (a + b) * (F.lit(float(n0 + n1)) - a - b) * float(max(n1, 1)) * float(max(n0, 1))
    )
    often = F.col("a") * n0 >= MIN_LIFT * F.col("b") * n1
    chosen = table.filter((F.col("a") >= MIN_ROWS) & often).withColumn("chi2", chi2).filter(F.col("chi2") >= min_chi2)
    if max_terms is not None:
        chosen = chosen.orderBy(F.desc("chi2"), "term").limit(max_terms)

    def unlikely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = chance(batch["a"].to_numpy(), batch["b"].to_numpy(), n1, n0)
            yield batch.loc[p <= MAX_CHANCE, ["term", "mark", "chi2"]]

    passed = chosen.select("term", "mark", "a", "b", "chi2").mapInPandas(unlikely, "term string, mark long, chi2 double").collect()
    terms = one_per_marker([(r.term, r.mark) for r in passed])
    strength = {r.term: r.chi2 for r in passed}
    return Chosen(terms, np.array([strength[t] for t in terms], dtype=float), train, sizes, {1: n1, 0: n0})


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, row_key (hash of the text), t (ids of the terms that the text holds, ascending) and tf, per input row."""
    ship_package(docs.sparkSession)
    few_at_a_time(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TermIds(terms)
        for batch in batches:
            text = batch.column("text")
            # A few texts at a time become Python strings.
            found = [ids.counts(t) for lo in range(0, batch.num_rows, COUNTED_DOCS) for t in text.slice(lo, COUNTED_DOCS).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array([list(c) for c in found], pa.list_(pa.int32())),
                    pa.array([list(c.values()) for c in found], pa.list_(pa.int32())),
                ],
                names=["doc_id", "row_key", "t", "tf"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    return keyed.mapInArrow(count, "doc_id long, row_key long, t array<int>, tf array<int>")


def weigh(chosen: Chosen, counts: DataFrame, examples_per_class: int = EXAMPLES_PER_CLASS) -> Index:
    """The index of ``chosen``, its document frequencies taken from ``counts`` (of all documents)."""
    terms, sizes, of = chosen.terms, chosen.labelled, chosen.fitted
    base_rate = sizes.get(1, 0) / max(1, sum(sizes.values()))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(terms), dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            seen += np.bincount(batch.column("t").flatten().to_numpy(), minlength=len(terms))
        found = np.flatnonzero(seen)
        ids, n = np.append(found, -1), np.append(seen[found], rows)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(n, pa.int64())], names=["t", "n"])

    # One row per term and task, and one per term here; -1 counts documents.
    df = {r.t: r.n for r in counts.select("t").mapInArrow(held, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    total = df.get(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([df.get(i, 0) for i in range(len(terms))], dtype=float)))
    # Many weak terms must not drown the strong ones in a cosine.
    idf = np.maximum(idf, 1e-3) * np.sqrt(chosen.strength / max(1, of[1] + of[0]))

    # Of the training rows that hold a term, the first of each class by hash order are indexed.
    rows = term_counts(chosen.train, terms).select("row_key", "t", "tf")
    vectors = pin(chosen.train.select("row_key", "doc_id", "y").join(rows, "row_key").filter("size(t) > 0"), "toxicity-vectors", few_files=True)
    heard = {r.y: r.n for r in vectors.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = {y: sizes.get(y, 0) / max(1, of[y]) for y in (0, 1)}  # labelled rows per fitted row
    examples: list[tuple[int, int, float, dict[int, int]]] = []
    for y in (0, 1):
        order = F.xxhash64("doc_id", F.lit("toxicity example"))
        few: list[Row] = vectors.filter(f"y = {y}").orderBy(order, "doc_id").limit(examples_per_class).collect()
        votes = rate[y] * heard.get(y, 0) / max(1, len(few))
        examples += [(r.doc_id, y, votes, dict(zip(r.t, r.tf))) for r in few]
    silent = [rate[y] * (of[y] - heard.get(y, 0)) for y in (0, 1)]
    silent_rate = (silent[1] + base_rate) / (sum(silent) + 1)
    order = np.random.default_rng(0).permutation(len(examples))
    return build_index(terms, idf, [examples[i] for i in order], base_rate, silent_rate)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    fit_per_class: int = FIT_PER_CLASS,
    examples_per_class: int = EXAMPLES_PER_CLASS,
    max_terms: int | None = None,
    min_chi2: float = MIN_CHI2,
) -> Index:
    """Learn from labelled training rows among ``docs``; the bounds are this module's constants.

    Without rows of both classes no term is chosen and every score is the base
    rate (0 without any label).
    """
    chosen = choose_terms(docs, labels, fit_per_class, max_terms, min_chi2)
    return weigh(chosen, term_counts(docs, chosen.terms), examples_per_class)


def score_counts(counts: DataFrame, index: Index, neighbours: int = NEIGHBOURS, prior_votes: float = PRIOR_VOTES) -> DataFrame:
    """doc_id, row_key, score, evidence_terms, evidence_ids from the rows of ``term_counts``; equal counts are scored once a task."""
    ship_package(counts.sparkSession)
    schema = "doc_id long, row_key long, score double, evidence_terms array<string>, evidence_ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[float, list[int]]] = {}
        for batch in batches:
            scores, terms, examples = [], [], []
            for t, tf in zip(batch.column("t").to_pylist(), batch.column("tf").to_pylist()):
                key = (*t, *tf)
                if key not in known:
                    if len(known) > 1 << 14:
                        known.clear()
                    value, near = index.score(t, tf, neighbours, prior_votes)
                    known[key] = value, index.example_id[near[:3]].tolist()
                value, close = known[key]
                scores.append(value)
                terms.append([index.terms[i] for i in t])
                examples.append(close)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array(scores, pa.float64()),
                    pa.array(terms, pa.list_(pa.string())),
                    pa.array(examples, pa.list_(pa.int64())),
                ],
                names=["doc_id", "row_key", "score", "evidence_terms", "evidence_ids"],
            )

    return counts.mapInArrow(run, schema)


def _learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of ``docs`` by what is learnt from them; their texts are read for terms only once."""
    chosen = choose_terms(docs, labels)
    counts = pin(term_counts(docs, chosen.terms), "toxicity-counts")
    return score_counts(counts, weigh(chosen, counts))


def _decided(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.drop("row_key").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score(docs: DataFrame, index: Index, neighbours: int = NEIGHBOURS, prior_votes: float = PRIOR_VOTES) -> DataFrame:
    """Per input row: doc_id, score, predicted, evidence_terms (shared by document and model), evidence_ids (nearest examples).

    NULL and empty texts hold no term and get the rate of such training rows.
    Labels, lang, source and doc_id do not enter a score; equal texts get equal
    scores.  Repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty result.
    """
    return _decided(score_counts(term_counts(docs, index.terms), index, neighbours, prior_votes))


def fit_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score(docs, fit(docs, labels))``, with the terms of the texts counted once for both."""
    return _decided(_learn_and_score(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose score reaches ``threshold``, all columns kept."""
    found = _learn_and_score(docs, labels).filter(F.col("score") >= threshold)
    bad = pin(found.select("doc_id", "row_key").distinct(), "toxicity-dropped", few_files=True)
    return without(docs, bad)
