"""Merkle dataset manifest with nested-interval labels.

Every document is a leaf; the leaves of a source, in order of their ids, are ranked 0, 1, 2, ...  A node of the tree carries
the interval ``[lo, hi)`` of the leaf ranks it covers, and 16 consecutive nodes become their parent, whose interval is the union
of theirs.  Subroots of sources, in order, are the leaves of one more tree, whose root stands for the whole dataset.

*Ancestors* are attached by containment joins, one for each level: a node's bucket on the next level is its ``lo`` divided by the
width of a node there, so the join is an equality of source and bucket with the containment test on top, and no source's
rows meet in one task however many it holds.  *Siblings* are what a parent's interval leaves of the node's own: members of
the parent that end at or before ``lo``, and those that begin at or after ``hi``.  The joins go from the top downwards; a node hands
its whole way to the root to its members, so a document meets its ancestors in one join of a row per 16 documents.

Only ids, digests and ranks are shuffled, never texts.  Ranks are row numbers inside sorted partitions plus the numbers of rows
that the source has in partitions before.  The number of levels is the logarithm of the largest source, and each level
is a written table a 16th of the one below.  All on DataFrame functions.

A null column counts as ``-``.  Rows without source are one source (the first), rows without id come first in theirs, rows
with equal ids follow each other by their leaves, and equal rows are one leaf each.  Empty texts are texts.  Other columns are
ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import crc_of_id
from ledgerloom.session import materialize

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the texts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def folded_text() -> Column:
    return F.translate("text", _UPPER, _LOWER)


def leaves(documents: DataFrame, tampered: Column, change: Column) -> DataFrame:
    """``doc_id``, ``source``, ``leaf``, and ``shown``: the leaf of the row with ``change`` as its text where ``tampered``."""
    head = F.concat(*[field(F.col(c)) for c in FIELDS[:-1]])
    plain = digest(head, field(F.col("text")))
    shown = F.when(F.coalesce(tampered, F.lit(False)), digest(head, field(change))).otherwise(plain)
    return documents.select("doc_id", "source", plain.alias("leaf"), shown.alias("shown"))


def ranked(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``lo``: place of a row in its tree, from 0; ``n``: rows of the tree.  Written once, so places are fixed."""
    placed = (rows.repartitionByRange(tree, order[0]).sortWithinPartitions(tree, *order)  # cuts need no digests
              .withColumn("at", F.monotonically_increasing_id()))
    placed = materialize(placed, name).withColumn("part", F.shiftright("at", 33))
    own = placed.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("own"))
    before = Window.partitionBy(tree).orderBy("part")
    own = (own.withColumn("before", F.sum("own").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("own"))
           .withColumn("n", F.sum("own").over(Window.partitionBy(tree)))
           .select(F.col(tree).alias("_tree"), F.col("part").alias("_part"), "first", "before", "n"))
    same = F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("part") == F.col("_part"))
    return (placed.join(own, same).withColumn("lo", F.col("at") - F.col("first") + F.col("before"))
            .drop("_tree", "_part", "part", "at", "first", "before"))


def _parents(nodes: DataFrame, tree: str, width: int, members: list[str]) -> DataFrame:
    """Nodes of the next level: interval, digest and members; a tree of one node keeps its digest."""
    run = F.floor(F.col("lo") / F.lit(width * FAN)).cast("bigint")
    grouped = nodes.groupBy(tree, run.alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", *members))).alias("members"),  # at most FAN
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("n").alias("n"))
    alone = F.col("n") <= F.lit(width)
    whole = digest(F.array_join(F.transform("members", lambda m: m["digest"]), ""))
    return grouped.drop("run").withColumn("digest", F.when(alone, F.col("members")[0]["digest"]).otherwise(whole))


def _levels(bottom: DataFrame, tree: str, members: list[str], name: str) -> list[DataFrame]:
    """Written tables of nodes, level by level; the last holds one node a tree."""
    found = [materialize(_parents(bottom, tree, 1, members), f"{name}-1")]
    most = found[0].agg(F.max("n")).first()[0] or 0
    width = FAN
    while width < most:
        taller = found[-1].where(F.col("n") > width).select(tree, "lo", "hi", "n", "digest")
        found.append(materialize(_parents(taller, tree, width, ["digest"]), f"{name}-{len(found) + 1}"))
        width *= FAN
    return found


def _step(members: Column, lo: Column, hi: Column) -> Column:
    """Siblings: what the parent's interval has before and after the node's own."""
    def text(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda m: m["digest"]), "")
    return F.struct(text(F.filter(members, lambda m: m["hi"] <= lo)).alias("left"),
                    text(F.filter(members, lambda m: m["lo"] >= hi)).alias("right"))


def _with_way(levels: list[DataFrame], tree: str, ways: DataFrame | None) -> DataFrame:
    """Nodes of the lowest level with ``way``: their siblings and those of all ancestors, up to the root.

    ``ways`` gives the way of each tree's uppermost node; None: there is nothing above.
    """
    nothing = F.expr("cast(array() as array<struct<left:string,right:string>>)")
    way = None
    for at in range(len(levels) - 1, -1, -1):
        width = FAN ** (at + 1)
        nodes, top = levels[at], F.col("n") <= width
        if ways is None:
            done = nodes.where(top).withColumn("way", nothing)
        else:
            above = ways.select(F.col("source").alias("_tree"), F.col("way"))
            done = nodes.where(top).join(above, F.col(tree).eqNullSafe(F.col("_tree"))).drop("_tree")
        if way is not None:
            bucket = F.floor(F.col("lo") / F.lit(width * FAN))
            up = way.select(F.col(tree).alias("_tree"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("members").alias("_members"),
                            F.col("way").alias("_way"), bucket.alias("_bucket"))
            inside = (F.col(tree).eqNullSafe(F.col("_tree")) & (bucket == F.col("_bucket"))
                      & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
            own = F.array(_step(F.col("_members"), F.col("lo"), F.col("hi")))
            lower = nodes.where(~top).join(up, inside).withColumn("way", F.concat(own, F.col("_way")))
            done = done.unionByName(lower.drop("_tree", "_lo", "_hi", "_members", "_way", "_bucket"))
        way = done
    return way


def build(documents: DataFrame, tampered: Column, change: Column) -> DataFrame:
    """One row a document: ``source``, ``lo``, ``n``, ``leaf``, ``shown``, ``subroot``, ``root`` and ``way``, an array of
    the digests to the left and to the right on each level from the leaf to the root."""
    rows = ranked(leaves(documents, tampered, change), "source", ["doc_id", "leaf"], "leaves")
    rows = rows.withColumn("hi", F.col("lo") + 1).withColumn("digest", F.col("leaf"))
    levels = _levels(rows, "source", ["digest", "doc_id", "shown"], "nodes")
    subroots = None
    for at, nodes in enumerate(levels):
        own = nodes.where(F.col("n") <= FAN ** (at + 1)).select("source", "digest")
        subroots = own if subroots is None else subroots.unionByName(own)
    tops = ranked(subroots.withColumn("dataset", F.lit(0)), "dataset", ["source"], "subroots")
    tops = tops.withColumn("hi", F.col("lo") + 1)
    upper = _levels(tops, "dataset", ["digest", "source"], "upper")
    root = upper[-1].select(F.col("digest").alias("root"))  # one row, none for an empty table
    above = _spread(_with_way(upper, "dataset", None)).select(F.col("m.source").alias("source"), F.col("m.digest").alias("subroot"), "way")
    above = materialize(above.join(F.broadcast(root)), "ways")
    nodes = _with_way(levels, "source", above)
    ends = above.select(F.col("source").alias("_source"), "subroot", "root")
    found = _spread(nodes).join(ends, F.col("source").eqNullSafe(F.col("_source")))
    return found.select("source", F.col("m.doc_id").alias("doc_id"), F.col("m.lo").alias("lo"), "n",
                        F.col("m.digest").alias("leaf"), F.col("m.shown").alias("shown"), "subroot", "root", "way")


def _spread(nodes: DataFrame) -> DataFrame:
    """One row for each member, with its own siblings in front of the way."""
    siblings = F.array(_step(F.col("members"), F.col("m.lo"), F.col("m.hi")))
    whole = F.when(F.col("n") > 1, F.concat(siblings, F.col("way"))).otherwise(F.col("way"))
    return nodes.withColumn("m", F.explode("members")).withColumn("way", whole)


def proof(way: Column) -> Column:
    return digest(F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), ""))


def folded_root(way: Column, leaf: Column) -> Column:
    """The root as it comes out of a leaf and the siblings on its way."""
    return F.aggregate(way, leaf, lambda below, s: digest(s["left"], below, s["right"]))


def manifest(documents: DataFrame) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and the check of a copy with some texts in lower case (see the module)."""
    found = build(documents, crc_of_id() % 5 == 0, folded_text())
    return (found.withColumn("proof_sha256", proof(F.col("way"))).withColumn("folded_root", folded_root(F.col("way"), F.col("shown")))
            .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))
