"""MinHash near-duplicates: banded minima, b-bit signatures compared by bit counts, links confirmed on full sets.

A text's set holds its distinct word shingles (as 64-bit hashes).  Of every hash
function's minimum, a signature keeps the low ``LOW_BITS`` bits, packed into
longs; rows of minima, hashed together, are the band keys.  Sets that share a
band key are candidates.  A candidate's similarity is estimated by counting the
positions of the two signatures that agree, less those that agree by chance
(1 in ``2 ** LOW_BITS``), and what lies too far below the threshold goes; the
rest is confirmed by intersecting the full sets.

Equal sets are one node.  The members of a bucket form a star around its centre,
the member that shares most (an unedited copy keeps all its band keys, an edited
one loses some), and most of a group is linked by its star at a cost linear in
the group.  Every member is taken apart along its centre's set: its own members,
which the centre lacks, come first and the common ones last.  Two members of a
star that can still be linked, but are in different components, must share one
of the first few members in that order (a prefix filter), and early enough for
the rest to reach the threshold (a positional filter).  What copies have in
common stands last there and common shingles follow rare ones, so neither makes
hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandkit.llm.components import connected_components
from demandkit.llm.text import perhaps_in, pin, ship_package

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
BANDS = 32
ROWS = 4  # minima in a band: a pair at 0.8 shares none of the bands with a chance of 5e-8
LOW_BITS = 4
MISSED = 1e-8  # chance that the estimate drops a pair that reaches the threshold
SIZE_STEP = 1.05  # sizes within this factor are one class
# Any order of shingles gives the same links; rare ones first gives fewer candidates.  Which ones are common is read off a sample.
ORDER_DOCS = 4096
ORDER_SHINGLES = 1 << 17
CHUNK = 1 << 12  # set members whose minima are taken at once
CACHED_WORDS = 1 << 17

U64 = np.uint64
PER_LONG = 64 // LOW_BITS


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """xxHash64 of words, kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: str | None, shingle: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of the whole sequence if it is shorter, nothing without words.

    Words are runs without ASCII white space after lower-casing A-Z.
    """
    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.zeros(0, dtype=U64)
    of_words = np.fromiter(map(hashes.__getitem__, words), dtype=U64, count=len(words))
    length = min(shingle, len(words))
    n = len(words) - length + 1
    out = np.full(n, length, dtype=U64)
    for k in range(length):
        out = _mixed(out * U64(0x9E3779B97F4A7C15) + of_words[k : k + n])
    return np.unique(out)


class Sketcher:
    """Band keys and packed low bits of the minima of a set."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20_240_501)
        self.bands, self.rows = bands, rows
        self.odd = rng.integers(0, 1 << 63, bands * rows, dtype=U64) * U64(2) + U64(1)
        self.plus = rng.integers(0, 1 << 63, bands * rows, dtype=U64) * U64(2) + rng.integers(0, 2, bands * rows, dtype=U64)

    def __call__(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.full(len(self.odd), np.iinfo(U64).max, dtype=U64)
        for lo in range(0, len(members), CHUNK):
            np.minimum(least, (members[lo : lo + CHUNK, None] * self.odd + self.plus).min(axis=0), out=least)
        least = _mixed(least)
        keys = np.arange(self.bands, dtype=U64)
        for column in least.reshape(self.bands, self.rows).T:
            keys = _mixed(keys * U64(0x9E3779B97F4A7C15) + column)
        low = (least & U64((1 << LOW_BITS) - 1)).reshape(-1, PER_LONG)
        packed = (low << (np.arange(PER_LONG, dtype=U64) * U64(LOW_BITS))).sum(axis=1, dtype=U64)
        return keys.view(np.int64), packed.view(np.int64)


def _list_column(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def sketches(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, row_key, n_shingles, set_key, bands, bits, per input row; the last three are NULL for an empty set."""
    ship_package(docs.sparkSession)
    schema = "doc_id long, row_key long, n_shingles long, set_key string, bands array<long>, bits array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketch = WordHashes(), Sketcher(bands, rows)
        for batch in batches:
            sizes, keys, band_lists, bit_lists = [], [], [], []
            for text in batch.column("text").to_pylist():
                members = shingle_set(text, shingle, hashes)
                own = sketch(members) if len(members) else (None, None)
                sizes.append(len(members))
                keys.append(xxhash.xxh3_128_hexdigest(members.tobytes()) if len(members) else None)
                band_lists.append(own[0])
                bit_lists.append(own[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.string()),
                    pa.array(band_lists, pa.list_(pa.int64())),
                    pa.array(bit_lists, pa.list_(pa.int64())),
                ],
                names=["doc_id", "row_key", "n_shingles", "set_key", "bands", "bits"],
            )

    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row_key"), "text"
    )
    return keyed.mapInArrow(run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(id, members): the sets of ``wanted`` (id, doc_id, row_key), made again from the whole texts.

    ``common`` are sorted shingle hashes and how common they are; members come
    in the order of that, then of their hashes.
    """
    ship_package(docs.sparkSession)

    def in_order(members: np.ndarray) -> np.ndarray:
        if common is None or not len(common[0]) or not len(members):
            return members
        at = np.minimum(np.searchsorted(common[0], members), len(common[0]) - 1)
        return members[np.argsort(np.where(common[0][at] == members, common[1][at], 0), kind="stable")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [in_order(shingle_set(t, shingle, hashes)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _list_column(found)], names=["id", "members"])

    keyed = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row_key"), "text")
    # Texts that are not wanted are left where they are, however the join is done.
    near = perhaps_in(keyed, wanted).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.row_key") == F.col("w.row_key"))
    sets = pin(near.join(wanted.alias("w"), same).select("w.id", "d.text").mapInArrow(run, "id long, members array<long>"), "minhash-sets", few_files=True)
    if sets.count() > wanted.count():
        # Rows that repeat a document give the same set again.
        sets = pin(sets.groupBy("id").agg(F.first("members").alias("members")), "minhash-sets", few_files=True)
    return sets


def common_shingles(docs: DataFrame, sketched: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of the most common shingles among a bounded sample of sets, and their counts."""
    order = F.xxhash64("row_key", F.lit("shingle order"))
    sample = sketched.filter("set_key is not null").select("doc_id", "row_key").orderBy(order, "doc_id").limit(ORDER_DOCS)
    sample = pin(sample.distinct().withColumn("id", F.monotonically_increasing_id()), "minhash-sample", few_files=True)
    counts = full_sets(docs, sample, shingle).select(F.explode("members").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    rows = counts.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toPandas()
    hashes, n = rows["h"].to_numpy(dtype=np.int64).view(U64), rows["n"].to_numpy(dtype=np.int64)
    at = np.argsort(hashes)
    return hashes[at], n[at]


def least_agreeing(threshold_percent: int, positions: int, missed: float = MISSED) -> int:
    """Agreeing signature positions that a pair at the threshold has but for a chance of ``missed``.

    Positions agree when the minima do, or else by chance: p = C + (1 - C) * similarity, C = 2 ** -LOW_BITS.
    """
    chance = 2.0**-LOW_BITS
    p = chance + (1 - chance) * threshold_percent / 100
    below = 0.0
    for k in range(positions + 1):
        below += comb(positions, k) * p**k * (1 - p) ** (positions - k)
        if below > missed:
            return k
    return positions


def agreeing(a: str, b: str, longs: int) -> Column:
    """Positions at which two packed signatures agree, by bit counts."""

    def differing(i: int) -> Column:
        x = F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))
        width = 1
        while width < LOW_BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, width))
            width *= 2
        ones = sum(1 << k for k in range(0, 64, LOW_BITS))
        return F.bit_count(x.bitwiseAND(F.lit(ones)))

    return F.lit(longs * PER_LONG) - reduce(lambda x, y: x + y, [differing(i) for i in range(longs)])


def estimate(a: str, b: str, longs: int) -> Column:
    """Similarity that two signatures show, corrected for chance agreement."""
    chance = 2.0**-LOW_BITS
    return (agreeing(a, b, longs) / (longs * PER_LONG) - chance) / (1 - chance)


def _lengths(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _reached(common: Column, a: str, b: str, percent: int) -> Column:
    return common * 100 >= (F.col(a) + F.col(b) - common) * percent


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Least intersection of sets of ``a`` and ``b`` members that reach the threshold."""
    return F.ceil((a + b) * percent / (100 + percent) - 1e-9)


def _stars(nodes: DataFrame) -> DataFrame:
    """(centre, id), distinct: every node with the centre of each bucket it shares."""
    keys = nodes.select("id", F.explode("bands").alias("key"))
    sizes = pin(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "minhash-buckets", few_files=True)
    shared = pin(keys.join(sizes, "key"), "minhash-members", few_files=True)
    weights = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    centres = shared.join(weights, "id").groupBy("key").agg(F.max(F.struct("weight", "id")).alias("c")).select("key", F.col("c.id").alias("centre"))
    return shared.join(centres, "key").filter("id != centre").select("centre", "id").distinct()


def _taken_apart(stars: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(centre, id, n, n_centre, bits, bits_centre, common, own, shared) of every star's members.

    ``common`` counts the members that the centre has too.  ``own`` are the
    first of those it lacks and ``shared`` the first of those it has: as many as
    a prefix filter can ask for.
    """
    about = nodes.select("id", "n", "bits").join(sets, "id")
    centre = about.select(F.col("id").alias("centre"), F.col("n").alias("n_centre"), F.col("bits").alias("bits_centre"), F.col("members").alias("c"))
    both = stars.join(about, "id").join(centre, "centre")
    least = F.ceil(F.col("n") * percent / 100 - 1e-9).cast("int")  # of any set that it can be linked with
    held = F.array_intersect("members", "c")
    own = F.slice(F.array_except("members", "c"), F.lit(1), (F.col("n") - least + 1).cast("int"))
    shared = F.slice(held, F.lit(1), F.greatest(F.size(held) - _needed(F.col("n"), least, percent).cast("int") + 1, F.lit(0)))
    return both.select(
        "centre", "id", "n", "n_centre", "bits", "bits_centre", F.size(held).alias("common"), own.alias("own"), shared.alias("shared")
    )


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(SIZE_STEP))).cast("int")


def _left_over(members: DataFrame, percent: int, longs: int) -> DataFrame:
    """(a, b, na, nb), distinct: pairs of one star, in different components, that sizes, prefixes and signatures allow.

    ``members`` are those of ``_taken_apart`` with ``root`` and ``outside`` (not in
    the centre's component); one of a pair is outside.  Pairs that share a member
    of their own meet on it.  The others can only be linked through what they
    share with the centre, and meet on that if they have enough of it: the size
    that a partner may then have is bounded, and enters the key as a class.
    """
    n, common = F.col("n"), F.col("common")
    side = ["centre", "id", "n", "bits", "common", "root", "outside"]
    least = F.ceil(n * percent / 100 - 1e-9)
    most = F.least(F.floor(common * (100 + percent) / percent - n + 1e-9), F.floor(n * 100 / percent + 1e-9))
    # ``left``: the members of its own (or shared ones) from this place on.
    by_own = members.select(*side, F.lit(-1).alias("size_class"), F.posexplode("own").alias("at", "token"))
    by_own = by_own.withColumn("left", n - common - F.col("at")).drop("at")
    by_shared = members.filter(F.size("shared") > 0).select(*side, _size_class(n).alias("size_class"), F.posexplode("shared").alias("at", "token"))
    by_shared = by_shared.withColumn("left", common - F.col("at")).drop("at")
    # A class begins at the power of the step, rounded down, so its prefix is never too short.
    classes = members.filter("outside").withColumn("least", least).withColumn("most", most).filter("most >= least")
    classes = classes.withColumn("size_class", F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most")))))
    smallest = F.greatest(F.col("least"), F.floor(F.pow(F.lit(SIZE_STEP), F.col("size_class"))))
    prefix = F.greatest((common - _needed(n, smallest, percent) + 1).cast("int"), F.lit(0))
    wanted = classes.select(*side, "size_class", F.posexplode(F.slice("shared", F.lit(1), prefix)).alias("at", "token"))
    wanted = wanted.withColumn("left", common - F.col("at")).drop("at")

    def named(rows: DataFrame, end: str) -> DataFrame:
        names = {"id": end, "n": f"n{end}", **{c: f"{c}_{end}" for c in ("bits", "common", "root", "outside", "left")}}
        return rows.withColumnsRenamed(names)

    probe = named(by_own.filter("outside").unionByName(wanted), "a")
    index = named(by_own.unionByName(by_shared), "b")
    # Two outsiders meet from both sides when they share an own member; by a centre's member only the smaller prefix need match.
    once = ~F.col("outside_b") | (F.col("a") < F.col("b")) | (F.col("size_class") >= 0)
    needed = _needed(F.col("na"), F.col("nb"), percent)
    of_own = F.greatest(needed - F.least("common_a", "common_b"), F.lit(1))
    enough = F.least("left_a", "left_b") >= F.when(F.col("size_class") < 0, of_own).otherwise(needed)
    alike = agreeing("bits_a", "bits_b", longs) >= least_agreeing(percent, longs * PER_LONG)
    met = probe.join(index, ["centre", "size_class", "token"])
    met = met.filter((F.col("root_a") != F.col("root_b")) & once & _lengths("na", "nb", percent) & enough & alike)
    ordered = met.select(
        F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
        F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"),
    )
    return ordered.select(F.col("x").alias("a"), F.col("y").alias("b"), "na", "nb").distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE_WORDS,
    threshold_percent: int = THRESHOLD_PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, n_linked, per input row.

    Two rows are linked when their sets' intersection is at least
    ``threshold_percent`` of their union; ``component_id`` is the smallest doc_id
    that links reach, the row's own included, and ``n_linked`` the distinct
    sets of its component.  A row without words (NULL, empty or blank text) has
    an empty set, is linked with nothing, and has its own doc_id and 0.  A NULL
    doc_id links like any other and is named only if its component has no
    other.  Repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty result.

    Nothing is capped: every pair that shares a band key, whatever the size of
    its bucket, is linked through its star, confirmed, or ruled out.
    """
    longs = bands * rows // PER_LONG
    if longs * PER_LONG != bands * rows or not 0 < threshold_percent <= 100:
        raise ValueError(f"need minima in multiples of {PER_LONG} and a threshold of 1 to 100 percent")
    all_rows = pin(sketches(docs, shingle, bands, rows), "minhash-sketches")
    filled = all_rows.filter("set_key is not null")
    first = filled.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "row_key")).alias("f"), F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"), F.first("bits").alias("bits"),
    )
    # Written before use, so the ids stay what they are.
    nodes = first.select("set_key", "f.doc_id", "f.row_key", "first_id", "n", "bands", "bits", F.monotonically_increasing_id().alias("id"))
    nodes = pin(nodes, "minhash-nodes", few_files=True)
    stars = pin(_stars(nodes), "minhash-stars", few_files=True)
    starred = stars.select(F.explode(F.array("centre", "id")).alias("id")).distinct()
    wanted = pin(nodes.join(starred, "id", "left_semi").select("id", "doc_id", "row_key"), "minhash-wanted", few_files=True)
    sets = full_sets(docs, wanted, shingle, common_shingles(docs, all_rows, shingle))
    apart = pin(_taken_apart(stars, nodes, sets, threshold_percent), "minhash-apart", few_files=True)
    close = agreeing("bits", "bits_centre", longs) >= least_agreeing(threshold_percent, longs * PER_LONG)
    links = apart.filter(close & _reached(F.col("common"), "n", "n_centre", threshold_percent)).select(F.col("centre").alias("a"), F.col("id").alias("b"))
    roots = pin(connected_components(links), "minhash-roots", few_files=True)

    # Stars that are not one component: pairs across components, of which one at least is not in the centre's.
    of_member = roots.select(F.col("node").alias("id"), F.col("root"))
    of_centre = roots.select(F.col("node").alias("centre"), F.col("root").alias("centre_root"))
    named = apart.join(of_member, "id", "left").join(of_centre, "centre", "left").withColumn("root", F.coalesce("root", "id"))
    named = named.withColumn("outside", F.col("root") != F.coalesce("centre_root", "centre"))
    open_stars = named.filter("outside").select("centre").distinct()
    members = pin(named.join(open_stars, "centre", "left_semi").drop("n_centre", "bits_centre", "centre_root"), "minhash-open", few_files=True)
    rest = pin(_left_over(members, threshold_percent, longs), "minhash-rest", few_files=True)
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("set_b"))
    held = F.size(F.array_intersect("set_a", "set_b"))
    more = rest.join(left, "a").join(right, "b").filter(_reached(held, "na", "nb", threshold_percent)).select("a", "b")
    whole = connected_components(links.unionByName(more))

    linked = nodes.select("id", "set_key", "first_id").join(whole.withColumnRenamed("node", "id"), "id", "left")
    linked = linked.withColumn("root", F.coalesce("root", "id"))
    classes = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_linked"))
    of_sets = linked.join(classes, "root").select("set_key", "component_id", "n_linked")
    return all_rows.join(of_sets, "set_key", "left").select(
        "doc_id",
        "row_key",
        "n_shingles",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
