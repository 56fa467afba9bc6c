"""Merkle dataset manifest (operator 11) by sibling-shift self-joins.

A node is (group, index, digest). At each level the rows at slot zero of a run
of ``arity`` are joined to those at index + 1, + 2, ... by equality of the
computed sibling index, and emit the parent. All joins of a level share the key
(group, index of slot zero), so each node is shuffled once a level. Proofs go
top-down: a run hands the digests beside each child, and what it got itself, to
its children; at the leaves only runs travel, not a proof for each row.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import number_in_slots
from .common import id_crc32, saved, shuffle_parts
from .ranges import borders, with_part

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_STEPS = "cast(array() as array<struct<b:string,a:string>>)"


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add the place (from 0) of each row in its group by ``order``; parts of the order are counted, not whole groups sorted."""
    edges = borders(df, order, shuffle_parts(df.sparkSession))
    placed = with_part(df, order, edges, "_part", "_head").drop("_head")
    return number_in_slots(placed, group, order, F.col("_part"), name).withColumn(name, F.col(name) - 1).drop("_part")


class Tree(NamedTuple):
    """``runs[i]``: (g, run, kids) of level i; ``tops``: (g, level, h), the last node of each group."""

    runs: list[DataFrame]
    tops: DataFrame


def build(nodes: DataFrame, largest: int, arity: int = ARITY) -> Tree:
    """The tree of each group from (g, idx, n, h): ``n`` nodes in the group, ``largest`` in the largest one.

    A group stops at one node; a lone node is its own top. A last run that is
    not full, even of one node, still has a parent.
    """
    runs, tops, level = [], [], 0
    while True:
        tops.append(nodes.where("n = 1").select("g", F.lit(level).alias("level"), "h"))
        if largest <= 1:
            break
        open_ = nodes.where("n > 1").withColumn("slot", F.col("idx") % arity)
        row = open_.where("slot = 0").select("g", "idx", "n", F.col("h").alias("h0"))
        for j in range(1, arity):
            sibling = open_.where(F.col("slot") == j).select("g", (F.col("idx") - j).alias("idx"), F.col("h").alias(f"h{j}"))
            row = row.join(sibling, ["g", "idx"], "left")
        kids = F.array_compact(F.array(*[F.col(f"h{j}") for j in range(arity)]))
        run = saved(row.select("g", F.floor(F.col("idx") / arity).alias("run"), "n", kids.alias("kids")), f"merkle-{level}")
        runs.append(run)
        nodes = run.select("g", F.col("run").alias("idx"), F.ceil(F.col("n") / arity).alias("n"), F.sha2(F.concat_ws("", "kids"), 256).alias("h"))
        largest, level = -(-largest // arity), level + 1
    out = tops[0]
    for top in tops[1:]:
        out = out.union(top)
    return Tree(runs, saved(out, "merkle-tops"))


def beside(kids: Column, slot: Column) -> Column:
    """What stands before and behind one child of a run."""
    return F.struct(F.concat_ws("", F.slice(kids, F.lit(1), slot)).alias("b"),
                    F.concat_ws("", F.slice(kids, slot + 2, F.size(kids))).alias("a"))


def paths(tree: Tree, starts: DataFrame, down_to: int, arity: int = ARITY) -> DataFrame:
    """(g, idx, subroot, root, steps) of all nodes at level ``down_to``, from (g, level, subroot, root, steps) of the groups' tops."""
    def at(level: int) -> DataFrame:
        return starts.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("idx"), "subroot", "root", "steps")

    now = at(len(tree.runs))
    for level in range(len(tree.runs) - 1, down_to - 1, -1):
        run = tree.runs[level].withColumnRenamed("run", "idx").join(now, ["g", "idx"])
        kid = run.select("g", "idx", "kids", "subroot", "root", "steps", F.posexplode("kids").alias("slot", "h"))
        now = kid.select("g", (F.col("idx") * arity + F.col("slot")).alias("idx"), "subroot", "root",
                         F.concat(F.array(beside(F.col("kids"), F.col("slot"))), F.col("steps")).alias("steps")).union(at(level))
    return now


def manifest(df: DataFrame, tampered: Column | None = None, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of documents.

    ``tampered`` says which rows are folded with the ASCII letters of their
    text lower-cased; by default those whose crc32 of the id is divisible by 3.
    Rows with a NULL id come first in their language and are never tampered
    with; rows with equal ids stand in the order of their digests, so reruns
    agree. NULL fields differ from empty ones. Other columns are ignored. An
    empty table has no rows and no root. Texts are hashed where they lie and
    never shuffled, so a very long one costs what its bytes cost.
    """
    spark = df.sparkSession
    if tampered is None:
        tampered = F.coalesce(F.col("doc_id").cast("string").isNotNull() & (id_crc32("doc_id") % 3 == 0), F.lit(False))
    columns = {f: F.col(f) for f in FIELDS}
    changed = columns | {"text": F.translate(F.col("text"), UPPER, LOWER)}
    # NULL languages come first, as their mark is shorter than any other.
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    own = leaf(list(columns.values()))
    leaves = saved(df.select(group.alias("g"), F.col("doc_id").alias("id"), own.alias("h"),
                             F.when(tampered, leaf(list(changed.values()))).alias("given")), "merkle-leaves")
    sizes = saved(leaves.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "merkle-sizes")
    rows = saved(numbered(leaves, ["g"], ["id", "h"], "idx").join(sizes, "g"), "merkle-rows")

    groups, largest = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    tree = build(rows.select("g", "idx", "n", "h"), largest, arity)

    # The same over the subroots, as one group.
    subroots = saved(numbered(tree.tops, [], ["g"], "idx"), "merkle-subroots")
    whole = build(subroots.select(F.lit("").alias("g"), "idx", F.lit(groups).cast("long").alias("n"), "h"), groups, arity)
    end = whole.tops.select("g", "level", F.col("h").alias("subroot"), F.col("h").alias("root"), F.expr(NO_STEPS).alias("steps"))
    above = paths(whole, end, 0, arity).select("idx", "root", "steps")
    starts = saved(subroots.join(above, "idx").select("g", "level", F.col("h").alias("subroot"), "root", "steps"), "merkle-starts")

    # Runs of leaves carry their digests and the path above them; a lone leaf has the path alone.
    ahead = paths(tree, starts, 1, arity).withColumnRenamed("idx", "run")
    lone = starts.where("level = 0").select("g", F.lit(0).cast("long").alias("run"), "subroot", "root", "steps",
                                            F.expr("cast(null as array<string>)").alias("kids"))
    hung = lone
    if tree.runs:
        hung = tree.runs[0].select("g", "run", "kids").join(ahead, ["g", "run"]).select("g", "run", "subroot", "root", "steps", "kids").union(lone)
    slot = (F.col("idx") % arity).cast("int")
    full = F.when(F.col("kids").isNull(), F.col("steps")).otherwise(F.concat(F.array(beside(F.col("kids"), slot)), F.col("steps")))
    joined = rows.withColumn("run", F.floor(F.col("idx") / arity)).join(hung, ["g", "run"]).withColumn("full", full)
    proof = F.sha2(F.concat_ws("", F.transform("full", lambda s: F.concat(s["b"], s["a"]))), 256)
    folded = F.aggregate("full", F.coalesce("given", "h"), lambda h, s: F.sha2(F.concat(s["b"], h, s["a"]), 256))
    return (joined.select(F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root",
                          proof.alias("proof_sha256"), folded.alias("folded_root"))
                  .withColumn("verified", F.col("folded_root") == F.col("root")))
