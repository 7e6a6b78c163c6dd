"""The trie of what conversations begin with, and what sharing those beginnings saves.

A turn is one digest of its role and text, taken where the text lies; only digests move. A node is
keyed by a digest of the turns down to it: inside a block of BLOCK turns a chain, over the blocks
before it their digests joined by doubling, so a conversation of any length is no one task's work.

Leaves and savings go up by pointer jumping. After round k a node holds the sums of its descendants
less than 2^k below it and knows its ancestor 2^k above. A round adds every node's sums to that
ancestor and replaces the pointer by the ancestor's own, so a trie of depth D takes log D rounds. The
sums are partial before the shuffle, and no pointer to the root is ever looked up, as depths say where
it is; a node under which a third of all conversations lie is a hot key of a join that Spark can split.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterglass.llm.common import cut_lineage, ship_package, whole_text

#: Turns whose digests are chained in one row; ids that are one piece of a list; copies of a turn made at once.
BLOCK, PIECE = 128, 4096
ROOT = b""


def digest(*parts: Column) -> Column:
    """16 bytes of SHA-256."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, pos (from 1), said (a digest), n_bytes of every turn; and conv_id, n of every conversation.

    Turns are ordered by turn, null first, then by their digest. Repeated rows are counted before they
    are dealt out by range, so neither they nor a conversation of very many turns meet in one task: a
    part of the range counts its turns, and begins where the parts before it end.
    """
    said = digest(F.sha2(whole_text("role"), 256), whole_text("text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), said.alias("said"), F.octet_length(whole_text()).cast("long").alias("n_bytes"))
    rows = rows.groupBy("conv_id", "turn", "said").agg(F.max("n_bytes").alias("n_bytes"), F.count("*").alias("copies"))
    rows = cut_lineage(rows.repartitionByRange("conv_id", "turn", "said").withColumn("part", F.spark_partition_id()))
    parts = rows.groupBy("conv_id", "part").agg(F.sum("copies").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.withColumn("skip", F.sum("n").over(earlier)).filter("skip > 0")
    begins = begins.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "skip")
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "said").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("copies").over(order))
    # A part of the range begins inside one conversation at most, so there are no more rows than parts.
    rows = rows.join(F.broadcast(begins), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    last = F.col("upto") + F.coalesce("skip", F.lit(0))
    rows = rows.select("conv_id", "said", "n_bytes", last.alias("last"), (last - F.col("copies") + 1).alias("first"))
    rows = rows.withColumn("pos", F.explode(F.sequence("first", "last", F.lit(PIECE).cast("long"))))
    rows = rows.withColumn("pos", F.explode(F.sequence("pos", F.least(F.col("last"), F.col("pos") + PIECE - 1))))
    return rows.select("conv_id", "pos", "said", "n_bytes"), parts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def _chained(turns: DataFrame) -> DataFrame:
    """Each turn's row with block, link (the chain of its block down to it), prior (the link before) and end (of the block)."""
    turn = F.struct("pos", "said", "n_bytes", "length")
    blocks = turns.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK)).groupBy("conv_id", "block")
    blocks = blocks.agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    last = lambda links: F.coalesce(F.get(links, F.size(links) - 1), F.lit(b""))
    links = F.aggregate("turns", F.array().cast("array<binary>"), lambda links, x: F.concat(links, F.array(digest(last(links), x["said"]))))
    return blocks.withColumn("links", links)


def _over_blocks(blocks: DataFrame, most: int) -> DataFrame:
    """conv_id, block, before, above for every block but the first of a conversation.

    ``before`` is a digest of the blocks before it, ``above`` the key of the last node of the one before.
    """
    own = F.element_at("links", -1).alias("own")
    rows = cut_lineage(blocks.filter(F.element_at("turns", -1)["length"] > BLOCK).select("conv_id", "block", own, own.alias("upto")))

    def shifted(by: int, *names: str) -> DataFrame:
        return rows.select(F.col("conv_id").alias("c"), (F.col("block") + by).alias("b"), *[F.col(x).alias(f"earlier_{x}") for x in names])

    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    step = 1
    while step < most:
        joined = rows.join(shifted(step, "upto"), here, "left")
        upto = F.when(F.col("earlier_upto").isNull(), F.col("upto")).otherwise(digest(F.col("earlier_upto"), F.col("upto")))
        rows = cut_lineage(joined.select("conv_id", "block", "own", upto.alias("upto")))
        step *= 2
    joined = rows.join(shifted(1, "upto"), here, "left")
    key = F.when(F.col("block") == 0, F.col("own")).otherwise(digest(F.col("earlier_upto"), F.col("own")))
    return joined.select("conv_id", (F.col("block") + 1).alias("block"), F.col("upto").alias("before"), key.alias("above"))


def _keyed(turns: DataFrame, longest: int) -> DataFrame:
    """conv_id, depth, n_bytes, length, key, parent of every turn."""
    blocks = _chained(turns)
    if longest > BLOCK:
        blocks = cut_lineage(blocks)
    rows = blocks.select("conv_id", "block", "links", F.posexplode("turns").alias("i", "x"))
    link, prior = F.get("links", F.col("i")), F.get("links", F.col("i") - 1)
    rows = rows.select("conv_id", "block", "i", F.col("x.pos").alias("depth"), "x.n_bytes", "x.length", link.alias("link"), prior.alias("prior"))
    first = rows.filter("block = 0").withColumns({"key": F.col("link"), "parent": F.coalesce("prior", F.lit(ROOT))})
    columns = ("conv_id", "depth", "n_bytes", "length", "key", "parent")
    if longest <= BLOCK:
        return first.select(*columns)
    over = _over_blocks(blocks, -(-longest // BLOCK)).withColumnsRenamed({"conv_id": "c", "block": "b"})
    more = rows.filter("block > 0").join(over, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    parent = F.when(F.col("i") == 0, F.col("above")).otherwise(digest(F.col("before"), F.col("prior")))
    more = more.withColumns({"key": digest(F.col("before"), F.col("link")), "parent": parent})
    return first.select(*columns).union(more.select(*columns))


@dataclass(frozen=True)
class Trie:
    """``nodes``: key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. ``ends``: key, conv_id."""

    nodes: DataFrame
    ends: DataFrame


def _summed_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """key, n_leaves, saved_tokens: each node's own sums (leaf, saved) with those of all its descendants."""
    state = nodes.select("key", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("up"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    step = 1
    while step <= deepest:
        none = {"depth": F.lit(None).cast("long"), "up": F.lit(None).cast("binary")}
        to_add = state.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        own = state.withColumn("up", none["up"])
        # An ancestor that is the root has none of its own: only deeper nodes look theirs up.
        far = state.select(F.concat("key", F.lit(b"")).alias("at"), F.col("up").alias("far"))
        jumped = state.filter(F.col("depth") >= 2 * step).select("key", "up").join(far, F.col("up") == F.col("at"))
        jumped = jumped.select("key", none["depth"].alias("depth"), F.col("far").alias("up"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        state = own.unionByName(to_add.withColumns(none)).unionByName(jumped).groupBy("key")
        state = cut_lineage(state.agg(F.max("depth").alias("depth"), F.max("up").alias("up"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        step *= 2
    return state.select("key", "n_leaves", "saved_tokens")


def trie_of(turns: DataFrame, lengths: DataFrame) -> Trie:
    """The trie of numbered ``turns``; ``lengths`` (conv_id, length) has every conversation, also those without turns."""
    lengths = cut_lineage(lengths.select("conv_id", "length"))
    longest, root_conv = lengths.agg(F.coalesce(F.max("length"), F.lit(0)), F.min("conv_id")).first()
    with_length = lengths.select(F.col("conv_id").alias("c"), "length")
    turns = turns.join(with_length, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    rows = cut_lineage(_keyed(turns, longest))
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_bytes"), "n_convs", "conv_id")
    nodes = rows.groupBy("key", "depth").agg(F.max("parent").alias("parent"), F.max("n_bytes").alias("n_bytes"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = cut_lineage(nodes.unionByName(root))
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, F.col("key") == F.col("p"), "left").drop("p").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = {"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}
    nodes = cut_lineage(nodes.withColumns(own))
    sums = _summed_up(nodes, longest)
    # The root is the parent of as many as there are first turns, and known; the others are met by a join.
    above = nodes.filter("depth > 0").select(F.concat("key", F.lit(b"")).alias("k"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(above, F.when(F.col("depth") > 1, F.col("parent")) == F.col("k"), "left")
    nodes = nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root_conv).cast("long")).otherwise(F.col("parent_conv_id")))
    nodes = nodes.join(sums, "key").select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    ends = rows.filter("depth = length").select("key", "conv_id").union(lengths.filter("length = 0").select(F.lit(ROOT), "conv_id"))
    return Trie(nodes, ends)


def prefix_trie(conversations: DataFrame) -> Trie:
    """The trie of conversations (conv_id, turn, role, text); further columns are left alone.

    Turns are ordered by turn, null first, then by a digest of role and text; a null role or text is
    empty, repeated rows are repeated turns, rows with a null conv_id are one conversation, which no
    node is named after but where it is the only one. Each distinct sequence of first turns is a node,
    the root is the empty one; an empty table has no nodes. A very long text is read once, where it lies,
    a very long conversation is a very deep trie, in BLOCK turns a row.
    """
    turns, lengths = numbered(conversations)
    return trie_of(turns, lengths.withColumnRenamed("n", "length"))


def listed_digests(ends: DataFrame) -> DataFrame:
    """key, ids_sha256: SHA-256 of each key's conv_ids in ascending order, joined by commas; a null id is '' and first.

    The ids of one key come in pieces, made wherever a range of them lies; the hash, which can't be
    split, takes a piece for a row, one after the other, and keeps none.
    """
    ship_package(ends.sparkSession)

    def pieces(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            out = []
            for key, own in groupby(rows, lambda r: r[0]):
                ids = [i for _, i in own]
                for k in range(0, len(ids), PIECE):
                    part = ids[k : k + PIECE]
                    out.append((key, part[0], ",".join("" if i is None else str(i) for i in part)))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out) if out else ([], [], []), (pa.binary(), pa.int64(), pa.string()))], ["key", "first", "piece"])

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for own, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own == key and state is not None:
                    state.update(b"," + piece.encode())
                    continue
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256(piece.encode())
            yield _digests(done)
        yield _digests([(key, state.hexdigest())] if state is not None else [])

    def _digests(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "ids_sha256"])

    rows = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = rows.mapInArrow(pieces, "key binary, first long, piece string")
    rows = rows.repartition("key").sortWithinPartitions("key", "first").select("key", "piece")
    return rows.mapInArrow(hashed, "key binary, ids_sha256 string")
