"""Merkle manifest of a dataset: a digest of each row, a tree over each part, one root.

The tree of a part is built level by level: a node's siblings are the other slots of its run
of `arity` nodes, their indices are computed from its own, and an equijoin of the level with
itself brings their digests together. Rows of slot zero, which then hold their whole run, emit
the parents. A node's siblings are also its share of the proof of every row below it: proofs
are put together from the root down, each level joined with the one above it.

Rows get their places without a window over a part: they are dealt by ranges of (part, id),
sorted, and numbered by place within a range and by the counts of the ranges before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethanode.llm.common import ascii_lower, bucketed, crc_of_id, discard, materialize

ARITY = 8
#: Rows that one task sorts at a time, about.
RANGE_ROWS = 500_000
#: Bits of a row's number within its range, as Spark's increasing ids have them.
_RANGE_BITS = 33


def encoded(c: Column) -> Column:
    """A value as it enters a leaf's digest: its bytes' count, `:` and itself; `-` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after the other, as lower-case hex text."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: Sequence[str], replaced: dict[str, Column] | None = None) -> Column:
    return digest(*[encoded((replaced or {}).get(c, F.col(c))) for c in columns])


def placed(rows: DataFrame, part: str, order: Sequence[str]) -> DataFrame:
    """`rows`, a written table, with tree, n and idx: a number of the part that rises with it, its rows, and the place in it from 0 by `order`.

    Nulls come first. Ties beyond `order` are told apart by the rows' places in the table. No
    task holds more than a range of rows, whatever the part.
    """
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    keyed = rows.withColumn("__row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(ranges, part, *order, "__row").sortWithinPartitions(part, *order, "__row").drop("__row")
    dealt = materialize(ordered.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    dealt = dealt.withColumn("__range", F.shiftright("__at", _RANGE_BITS))
    ranges_of = dealt.groupBy(part, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(part)  # as many rows as there are ranges at most
    before = F.coalesce(F.sum("__n").over(own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(ranges_of.select(F.col(part).alias("__of"), F.col("__range").alias("__in"), "__first", before.alias("__before"), F.min("__first").over(own).alias("tree"), F.sum("__n").over(own).alias("n")), "ranges")
    joined = dealt.join(starts, F.col(part).eqNullSafe(F.col("__of")) & (F.col("__range") == F.col("__in")))
    return joined.withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__range", "__of", "__in", "__first", "__before")


def level(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """(tree, n, idx, run, digest, left, right, row) of the nodes (tree, n, idx, digest, row) of trees of more than one node.

    left and right are the digests of a node's siblings before and after it, one after the
    other. run = tree + idx // arity is unique within the level, as trees are numbered by their
    first rows, and is the number of the parent; the table lies in buckets of it.
    """
    slot = F.pmod("idx", F.lit(arity))
    own = nodes.where("n > 1").withColumns({"slot": slot.cast("int"), "run": F.col("tree") + F.floor(F.col("idx") / arity)})
    shifted = F.col("idx") - F.col("slot") + F.pmod(F.col("slot") + F.col("shift"), F.lit(arity))
    asked = own.select("tree", "n", "run", "slot", "idx", F.explode(F.sequence(F.lit(1), F.lit(arity - 1))).alias("shift")).withColumn("at", shifted).where("at < n")
    siblings = own.select((F.col("tree") + F.col("idx")).alias("__node"), F.struct("slot", "digest").alias("sibling"))
    found = asked.select("tree", "n", "run", "slot", "idx", (F.col("tree") + F.col("at")).alias("__node")).join(siblings, "__node").drop("__node")
    both = own.select("tree", "n", "run", "slot", "idx", F.lit(None).cast(siblings.schema["sibling"].dataType).alias("sibling"), F.struct("digest", "row").alias("own")).unionByName(found, allowMissingColumns=True)
    buckets = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = both.repartition(buckets, "run").groupBy("run", "slot").agg(
        F.first("tree").alias("tree"), F.first("n").alias("n"), F.first("idx").alias("idx"), F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_list("sibling")).alias("siblings")
    )

    def joined(side) -> Column:
        return F.array_join(F.transform(F.filter("siblings", side), lambda s: s["digest"]), "")

    before, after = joined(lambda s: s["slot"] < F.col("slot")), joined(lambda s: s["slot"] > F.col("slot"))
    return bucketed(gathered.select("tree", "n", "idx", "run", F.col("own.digest").alias("digest"), before.alias("left"), after.alias("right"), F.col("own.row").alias("row")), "run", "level", placed=True)


def parents(of: DataFrame, arity: int = ARITY) -> DataFrame:
    """The nodes above a level: rows of slot zero hold the digests of their whole run."""
    first = of.where(F.pmod("idx", F.lit(arity)) == 0)
    return first.select("tree", F.ceil(F.col("n") / arity).alias("n"), F.floor(F.col("idx") / arity).alias("idx"), digest(F.col("digest"), F.col("right")).alias("digest"), F.lit(None).cast("boolean").alias("row"))


def tree_levels(nodes: DataFrame, most: int, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """(levels from the leaves up, (tree, digest) of the roots) for nodes of trees of at most `most` leaves."""
    levels, roots = [], None
    while True:
        done = nodes.where("n = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if most <= 1:
            return levels, roots
        levels.append(level(nodes, arity))
        nodes, most = parents(levels[-1], arity), -(-most // arity)


def proofs(levels: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """(digest, row, tree, steps, *others) of the leaves of more than one; `above` has (tree, steps, *others) of the roots.

    steps: the digests left and right of the way at each level, from the leaf to the top.
    """
    others = [c for c in above.columns if c not in ("tree", "steps")]
    over = above.select(F.col("tree").alias("__node"), "steps", *others)  # a root's number is that of its tree
    for at in reversed(range(len(levels))):
        own = levels[at].withColumn("__step", F.array(F.struct("left", "right")))
        reached = own.join(over, own["run"] == over["__node"]).withColumn("steps", F.concat("__step", "steps"))
        if not at:
            return reached.select("digest", "row", "tree", "steps", *others)
        lower = reached.select((F.col("tree") + F.col("idx")).alias("__node"), "steps", *others)
        # trees that end below this level are joined where they end
        over = lower.unionByName(_ended(above, levels[at - 1], arity, others))
    return above.limit(0).select(F.lit(None).cast("string").alias("digest"), F.lit(None).cast("boolean").alias("row"), "tree", "steps", *others)


def _ended(above: DataFrame, below: DataFrame, arity: int, others: list[str]) -> DataFrame:
    """Roots that stand right above the level `below`: trees of at most `arity` nodes there."""
    last = below.where((F.col("idx") == 0) & (F.col("n") <= arity)).select("tree")
    return above.join(last, "tree").select(F.col("tree").alias("__node"), "steps", *others)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof's steps give."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(df: DataFrame, columns: Sequence[str], part_col: str = "lang", id_col: str = "doc_id", checked: Column | None = None, arity: int = ARITY) -> DataFrame:
    """(id, leaf, subroot, root, steps, checked): each row's digest, those of its part and of all, its proof, and the digest of the row as it is to be checked.

    A leaf is the digest of `columns`; leaves of a part ascend by id (null first, then by
    digest), parts by value, null first. `checked` is the digest that a verifier has of the row
    (by default the leaf). Repeated rows are leaves each; a part of one row has the leaf as its
    subroot, a table of one part the subroot as its root; an empty table gives no rows. Columns
    that are not listed are not read, whatever their names.
    """
    leaf = leaf_digest(columns)
    rows = df.select(F.col(part_col).alias("__part"), F.col(id_col).alias("__id"), leaf.alias("digest"), (leaf if checked is None else checked).alias("checked"))
    leaves = placed(materialize(rows, "leaves", "zstd"), "__part", ["__id", "digest"])
    nodes = materialize(leaves.select("tree", "n", "idx", "digest", F.struct("__id", "checked").alias("row")), "nodes", "zstd")
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, subroots = tree_levels(nodes, most, arity)
    # the parts are numbered by their first rows, so their order is that of the numbers
    tops = placed(materialize(subroots.select(F.lit(0).alias("__all"), F.col("tree").alias("__tree"), F.col("digest")), "subroots"), "__all", ["__tree"])
    tops = materialize(tops.select("tree", "n", "idx", "digest", F.struct("__tree").alias("row")), "tops")
    upper, root = tree_levels(tops, tops.count(), arity)
    above = root.select("tree", F.array().cast("array<struct<left: string, right: string>>").alias("steps"), F.col("digest").alias("root"))
    if upper:
        parts = proofs(upper, above, arity).select(F.col("row.__tree").alias("tree"), "steps", F.col("digest").alias("subroot"), "root")
    else:
        parts = tops.join(above, "tree").select(F.col("row.__tree").alias("tree"), "steps", F.col("digest").alias("subroot"), "root")
    parts = materialize(parts, "parts")
    discard(tops, *upper)
    alone = nodes.where("n = 1").join(parts, "tree").select("digest", "row", "tree", "steps", "subroot", "root")
    every = proofs(levels, parts, arity).unionByName(alone) if levels else alone
    return every.select(F.col("row.__id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "steps", F.col("row.checked").alias("checked"))


def tampered(columns: Sequence[str], id_col: str = "doc_id", text_col: str = "text", modulus: int = 3) -> Column:
    """The leaf of a row whose text's A-Z were lower-cased where `modulus` divides the crc32 of the id, else its own."""
    text = F.when(F.coalesce(F.pmod(crc_of_id(F.col(id_col)), F.lit(modulus)) == 0, F.lit(False)), ascii_lower(F.col(text_col))).otherwise(F.col(text_col))
    return leaf_digest(columns, {text_col: text})
