"""The prefix trie of conversations, its subtree totals by leaf-peeling message passing.

A node is named by the digest of its path, so the members of a node are found by grouping, whatever its depth. Nodes of one
member are complete at once: what lies under them is that member's rest, one leaf and nothing saved. The others hold a
counter of children that are not complete; complete nodes send their subtree's totals to their parents, until the root is
complete. A node that waits for one child alone points to it, and pointers jump over nodes that wait likewise, so that the
rounds grow with the logarithm of the nodes even where the trie is a long path.
"""

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .sequences import in_order, joined_sha256, part_of

ROOT = "0" * 32
WORD = r"[^\x20\x09-\x0D]+"


def turns_in_order(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, no, digest, words) of all turns, no from 1 by turn (null first), of equal turns by role and text; null roles
    and texts are empty. Rows without conv_id belong to no conversation and go."""
    rows = conversations.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))).where("conv_id IS NOT NULL")
    coarse = [F.col("conv_id"), F.col("turn"), F.left("role", F.lit(16))]
    digest = F.left(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256), F.lit(32))
    sorted_rows = in_order(rows, coarse, ["conv_id", "turn", "role", "text"], scratch)
    narrow = scratch.write(sorted_rows.select("conv_id", "at", part_of(F.col("at")).alias("part"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")))
    scratch.drop(sorted_rows)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = narrow.groupBy("conv_id", "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    pieces = pieces.select("conv_id", "part", (F.col("start") - before - 1).alias("zero"))
    return narrow.join(pieces, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("zero")).alias("no"), "digest", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, size) of all conversations and (conv_id, depth, digest, words) of their turns, when each has the first h
    turns of conversation c - c % 20 and its own after its first h; h is crc32 of its id as text, modulo 4."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    own = turns.groupBy("conv_id").agg(F.max("no").alias("n"))
    convs = own.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    there = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(there, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    first = turns.where("no <= 3 AND conv_id % 20 = 0").withColumnRenamed("conv_id", "base")
    heads = convs.join(first, "base").where("no <= head").select("conv_id", F.col("no").alias("depth"), "digest", "words")
    tails = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where("no > h")
    tails = tails.select("conv_id", (F.col("head") + F.col("no") - F.col("h")).alias("depth"), "digest", "words")
    return convs.select("conv_id", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), heads.union(tails)


def _paths(batches: Iterator) -> Iterator:
    """Rows sorted by conv_id and depth get the digest of their path and that of their parent's; one digest is held."""
    import pyarrow as pa

    now, path = None, ROOT
    for batch in batches:
        nodes, parents = [], []
        for conv, digest in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            if conv != now:
                now, path = conv, ROOT
            parents.append(path)
            path = hashlib.sha256((path + digest).encode()).hexdigest()[:32]
            nodes.append(path)
        kept = [batch.column(c) for c in ("conv_id", "depth", "words")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(nodes, pa.string()), pa.array(parents, pa.string())], names=["conv_id", "depth", "words", "node", "parent"])


def subtree_totals(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, n_leaves, saved_tokens) of a forest's nodes (node, parent or null, kids, leaves, saved): kids are children among
    these nodes, leaves those of other children's subtrees (1 for a node without any child), saved its own."""
    waits = F.lit(None).cast(nodes.schema["node"].dataType)
    left = scratch.write(nodes.select("node", "parent", "kids", "leaves", "saved", waits.alias("next")))
    finished = None
    while not left.isEmpty():
        done = left.where("kids = 0").select("node", "parent", "leaves", "saved")
        mine = done.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
        finished = mine if finished is None else finished.union(mine)
        rest = left.where("kids > 0")
        sent = done.groupBy("parent").agg(F.count("*").alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s")).withColumnRenamed("parent", "to")
        got = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0))).alias(c)
        counting = rest.where("next IS NULL").join(sent, F.col("node") == F.col("to"), "left")
        counting = counting.select("node", "parent", (F.col("kids") - F.coalesce("n", F.lit(0))).alias("kids"), got("leaves", F.col("l")), got("saved", F.col("s")), "next")
        ready = done.select(F.col("node").alias("to"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
        pointing = rest.where("next IS NOT NULL").join(ready, F.col("next") == F.col("to"), "left")
        pointing = pointing.select("node", "parent", F.when(F.col("to").isNull(), F.col("kids")).otherwise(0).alias("kids"), got("leaves", F.col("l")), got("saved", F.col("s")), "next")
        now = scratch.write(counting.union(pointing))
        child = now.select(F.col("parent").alias("p"), F.col("node").alias("child"))
        alone = now.where("kids = 1 AND next IS NULL").select("node").join(child, F.col("node") == F.col("p")).select(F.col("node").alias("a"), "child")
        aimed = now.join(alone, F.col("node") == F.col("a"), "left").withColumn("next", F.coalesce("next", "child")).drop("a", "child")
        aimed = scratch.write(aimed)
        over = aimed.where("kids = 1 AND next IS NOT NULL").select(F.col("node").alias("to"), F.col("leaves").alias("l"), F.col("saved").alias("s"), F.col("next").alias("far"))
        waiting = (F.col("kids") == 1) & (F.col("next") == F.col("to"))
        left = aimed.join(over, waiting, "left").select("node", "parent", "kids", got("leaves", F.col("l")), got("saved", F.col("s")), F.coalesce("far", "next").alias("next"))
        left = scratch.write(left)
        scratch.drop(now)
        scratch.drop(aimed)
    return finished if finished is not None else nodes.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie(convs: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a node of the trie of conversations: convs (conv_id, size) and turns (conv_id, depth from 1, digest, words).

    node, parent (digests of paths; the root's parent is null), conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Conversations without turns end at the root; no conversations, no rows.
    """
    small_batches(convs.sparkSession)
    paths = turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(_paths, "conv_id long, depth long, words long, node string, parent string")
    paths = scratch.write(paths.select("node", "parent", "depth", "words", "conv_id"))
    root = convs.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "conv_id")
    nodes = scratch.write(paths.union(root).groupBy("node", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")))

    ends = paths.join(convs, "conv_id").where("depth = size").select("node", "conv_id").union(convs.where("size = 0").select(F.lit(ROOT), "conv_id"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    sorted_ends = in_order(ends, [F.col("node"), F.col("conv_id")], ["node", "conv_id"], scratch)
    pieces = sorted_ends.groupBy("node", part_of(F.col("at")).alias("part")).agg(listed.alias("ids"))
    hashed = joined_sha256(pieces, "node", ["part"], "ids", ",", "ends_sha256")

    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") > 1).alias("kids"))
    known = scratch.write(nodes.join(children, "node", "left").fillna(0, ["n_children", "kids"]))
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_children") - F.col("kids"))
    shared = known.where("n_convs > 1").select("node", "parent", "kids", leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = subtree_totals(shared, scratch)
    full = scratch.write(known.join(totals, "node", "left").join(hashed, "node", "left"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(above, "parent", "left").select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """What the query returns: the nodes of the trie of all rebuilt conversations. Repeated rows are turns of their own; texts
    of any length are read once, for their digests; an empty table gives no rows."""
    scratch = Scratch(conversations.sparkSession)
    turns = scratch.write(turns_in_order(conversations, scratch))
    convs, deep = rebuilt(turns)
    return trie(scratch.write(convs), deep, scratch).drop("node", "parent")
