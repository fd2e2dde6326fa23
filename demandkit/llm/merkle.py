"""Merkle manifests: levels as concatenated hex digests, parents cut from them by fixed-width substrings.

The leaves of a group (here: a language) are numbered in order and dealt into
aligned blocks of ``8 ** 3`` consecutive ones.  A block keeps every level as one
string of 64-digit digests side by side, so the 8 children of a parent are one
substring of 512 digits, the parent is its hash, and the siblings of a node are
the two substrings on its flanks within those 512 digits.  A block's last level
is one digest; these digests are the leaves of the next round, so the rounds
grow with log512 of the rows.  The groups' roots, in order, are the leaves of
one last tree.  On the way down every block hands its path to its members.

A block holds at most 512 rows, whatever the group's size, so a group with a
third of all rows is dealt out like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandkit.llm.text import pin
from demandkit.operators.indexing import dense_index

CHILDREN = 8
LEVELS = 3  # made in one block
DIGITS = 64  # of a sha256
BLOCK = CHILDREN**LEVELS
RUN = CHILDREN * DIGITS
PATH = "array<struct<left:binary,right:binary>>"


def framed(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, ``:`` and the value (numbers in decimal)."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    """sha256 (hex) of the framed fields, in order."""
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path of siblings lead to."""
    return F.aggregate(path, leaf, lambda node, at: F.sha2(F.concat(at["left"], node.cast("binary"), at["right"]), 256))


def path_digest(path: Column) -> Column:
    """sha256 of all siblings' hex digits, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"]).cast("string")), ""), 256)


def _parents(level: Column) -> Column:
    """The next level: the hash of every run of ``CHILDREN`` digests (the last run may be shorter)."""
    last = F.floor((F.octet_length(level) - 1) / RUN).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), last), lambda r: F.sha2(F.substring(level, r * RUN + 1, F.lit(RUN)), 256))
    return F.array_join(hashed, "").cast("binary")


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """(k, b, total, members, l0 .. l3) from nodes (k, i, total, node, carry): one row per aligned block.

    A level is NULL where the group is one node before it.
    """
    member = F.struct("i", "node", *carry)
    out = nodes.groupBy("k", F.floor(F.col("i") / BLOCK).cast("long").alias("b")).agg(
        F.first("total").alias("total"), F.array_sort(F.collect_list(member)).alias("members")
    )
    out = out.withColumn("l0", F.array_join("members.node", "").cast("binary"))
    for n in range(LEVELS):
        out = out.withColumn(f"l{n + 1}", F.when(F.col("total") > CHILDREN**n, _parents(F.col(f"l{n}"))))
    return out


def _top(blocks: DataFrame) -> Column:
    """A block's digest: its last level that is there."""
    return F.coalesce(*[F.col(f"l{n}") for n in range(LEVELS, -1, -1)]).cast("string")


def _unfold(blocks: DataFrame, above: DataFrame, carry: list[str]) -> DataFrame:
    """One row per member, (k, i, node, carry, and the columns of ``above``), ``path`` led on to the root.

    ``above`` has (k, b, path, ...) for every block.
    """
    extra = [c for c in above.columns if c not in ("k", "b", "path")]
    rows = blocks.join(above, ["k", "b"]).select("*", F.posexplode("members").alias("at", "m"))
    own = []
    for n in range(LEVELS):
        level = F.col(f"l{n}")
        place = F.floor(F.col("at") / CHILDREN**n).cast("int")
        start = F.floor(place / CHILDREN).cast("int") * RUN
        here = start + place % CHILDREN * DIGITS
        siblings = F.struct(
            F.substring(level, start + 1, here - start).alias("left"),
            F.substring(level, here + DIGITS + 1, start + RUN - here - DIGITS).alias("right"),
        )
        own.append(F.when(F.col(f"l{n + 1}").isNotNull(), siblings))
    path = F.concat(F.array_compact(F.array(*own)).cast(PATH), F.col("path")).alias("path")
    return rows.select("k", "m.i", "m.node", *[f"m.{c}" for c in carry], *extra, path)


def _grow(nodes: DataFrame, carry: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, and (k, node): each group's root."""
    rounds = []
    while True:
        blocks = pin(_blocks(nodes, carry), "merkle-blocks")
        rounds.append(blocks)
        # One block of every group: all levels are done.
        if blocks.filter(F.col("total") > BLOCK).isEmpty():
            return rounds, blocks.select("k", _top(blocks).alias("node"))
        # A group that is done has one node and no further level.
        nodes = blocks.select("k", F.col("b").alias("i"), F.ceil(F.col("total") / BLOCK).cast("long").alias("total"), _top(blocks).alias("node"))
        carry = []


def _descend(rounds: list[DataFrame], above: DataFrame, carry: list[str]) -> DataFrame:
    """Paths of the first round's members; ``above`` has (k, path, ...) for every group."""
    above = above.withColumn("b", F.lit(0).cast("long"))
    for n, blocks in reversed(list(enumerate(rounds))):
        members = _unfold(blocks, above, carry if n == 0 else [])
        if n == 0:
            return members
        above = members.drop("node").withColumnRenamed("i", "b")


def manifest(leaves: DataFrame, carry: list[str]) -> DataFrame:
    """Per input row: ``carry``, group, leaf, subroot, root, path.

    ``leaves`` has group (text), position (what a group's leaves ascend by),
    leaf (64 hex digits), and the columns named in ``carry``, which must not be
    called k, i, b, total, node, subroot, root or path; others are ignored.  A
    NULL group comes first, then groups bytewise; a NULL position comes first in
    its group, and ties go by leaf, so repeated rows are leaves of their own.
    ``path`` lists per level the siblings on both sides as hex digits, from the
    leaf through the subroot to the root; ``fold(leaf, path)`` is the root.
    An empty table gives an empty result.
    """
    # A key that sorts like the group, with NULL before the empty text.
    key = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))
    rows = leaves.select(key.alias("k"), "position", F.col("leaf").alias("node"), *carry)
    placed = dense_index(rows, ["k", "position", "node"], "at")
    groups = pin(placed.groupBy("k").agg(F.min("at").alias("first"), F.count("*").alias("total")), "merkle-groups", few_files=True)
    nodes = placed.join(groups, "k").select("k", (F.col("at") - F.col("first")).alias("i"), "total", "node", *carry)
    rounds, subroots = _grow(nodes, carry)
    ordered = dense_index(subroots.select(F.col("k").alias("group_key"), "node"), ["group_key"], "i")
    total = groups.count()
    tops, root = _grow(ordered.select(F.lit("").alias("k"), "i", F.lit(total).cast("long").alias("total"), "node", "group_key"), ["group_key"])
    start = root.select("k", F.col("node").alias("root"), F.array().cast(PATH).alias("path"))
    of_groups = _descend(tops, start, ["group_key"])
    above = of_groups.select(F.col("group_key").alias("k"), F.col("node").alias("subroot"), "root", "path")
    group = F.when(F.col("k") != "", F.substring("k", 2, 2**31 - 1)).alias("group")
    return _descend(rounds, above, carry).select(*carry, group, F.col("node").alias("leaf"), "subroot", "root", "path")
