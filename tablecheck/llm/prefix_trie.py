"""Prefix trie of conversations: shared beginnings, counts, and what sharing them saves.

A node is a distinct sequence of first turns.  Its name is a 128-bit digest: the exclusive
or of two 64-bit hashes of (depth, turn) over its turns, so that a running aggregate gives
all prefixes of a conversation at once and its parent's name is one turn less.

1. Turns (32-byte digest of role and text, length of the text) are range-partitioned by
   conversation and depth and written; running digests inside a partition are shifted by
   those of the conversation's earlier partitions.  A conversation of any length is spread.
2. Conversations are cut into segments of at most ``SEGMENT`` turns, and segments are dealt
   to shards by hash, at most about ``SHARD_ROWS`` turns each.  A shard enumerates its distinct digests and
   gives each a slot of a minimal perfect hash (:class:`SlotTable`; the digest kept in a slot
   verifies every lookup), scatters members, ends and smallest members into flat arrays, and
   finds every node's parent slot.  However many conversations share a node, it is one row
   of a shard, and a shard's rows are summed to the corpus's nodes by a grouped aggregate.
3. Every node has one owner: the shard that holds its smallest member.  Each shard scatters
   the values of the nodes it owns into flat arrays again, accumulates them through the
   parent slots from the deepest level up, and sends its partial sums of every node to one
   more grouped aggregate.  As a node's smallest member goes through all nodes above it, all
   values reach all of their ancestors, and no task holds a whole subtree.  What lies below
   a segment is added at its last turn.
4. Identifiers of the conversations that end at a node are range-sorted by (node, id), joined
   into strings a batch at a time, and the strings hashed in order: the hash of a
   node where a third of all conversations end streams through one task, text by text.

Digests are compared by 128 bits of xxHash64 over SHA-256 digests of the turns.

Defined cases: null role and text are empty; turns without conversation id are left out;
equal turn numbers are taken in the order of their digests (repeated rows are turns of
their own), null ones first; a conversation without turns ends at the root; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import with_positions
from .common import shuffle_partitions, written

SEGMENT = 1024
SHARD_ROWS = 200_000
# What sets the name of a segment's head apart from the node itself (as in its own segment).
HEAD_MARK = 0x5BF03635F0E1D2C3
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_SCHEMA = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, ends_sha256 string")


class SlotTable:
    """Minimal perfect hash of distinct 128-bit digests: slots 0 to n - 1, foreign digests told apart.

    Digests alone at their place of a level keep it; the others go on to a smaller level.
    """

    def __init__(self, digests: np.ndarray, spare: float = 2.0):
        self.levels: list[np.ndarray] = []
        self.kept = np.empty_like(digests)
        rest, taken = digests, 0
        while len(rest):
            size = int(spare * len(rest)) + 1
            place = self._place(rest, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            slots = np.where(alone, np.cumsum(alone) - 1 + taken, -1).astype(np.int32)
            self.levels.append(slots)
            here = alone[place]
            self.kept[slots[place[here]]] = rest[here]
            taken += int(here.sum())
            rest = rest[~here]

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        h = digests[:, 0] ^ (digests[:, 1] * np.uint64(2 * level + 1) + np.uint64(level))
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return ((h ^ (h >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of every digest, -1 for one that the table does not hold."""
        out = np.full(len(digests), -1, np.int64)
        open_ = np.arange(len(digests))
        for level, table in enumerate(self.levels):
            found = table[self._place(digests[open_], level, len(table))]
            out[open_[found >= 0]] = found[found >= 0]
            open_ = open_[found < 0]
        held = np.flatnonzero(out >= 0)
        out[held[(self.kept[out[held]] != digests[held]).any(axis=1)]] = -1
        return out


def distinct(digests: np.ndarray) -> np.ndarray:
    """The distinct rows of (n, 2) digests."""
    ordered = digests[np.lexsort((digests[:, 1], digests[:, 0]))]
    new = np.ones(len(ordered), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    return ordered[new]


def accumulate(parents: np.ndarray, levels: np.ndarray, *values: np.ndarray) -> None:
    """Add every node's values to its parent's, in place, from the deepest level up (-1: no parent)."""
    order = np.argsort(-levels, kind="stable")
    order = order[parents[order] >= 0]
    ends = np.flatnonzero(np.diff(levels[order], append=-1)) + 1
    start = 0
    for end in ends:
        at = order[start:end]
        for value in values:
            np.add.at(value, parents[at], value[at])
        start = end


def conversation_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), key, n_chars: the turns of each conversation in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    rows = (df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
                      F.unhex(F.sha2(named, 256)).alias("key"), F.char_length(text).cast("long").alias("n_chars"))
            .filter(F.col("conv_id").isNotNull()))
    ordered = with_positions(rows, [F.col("turn").asc_nulls_first(), F.col("key").asc()], group_cols=["conv_id"])
    return written(ordered.select("conv_id", "pos", "key", "n_chars"), "trie-turns")


def borrow_openings(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with the first h turns of the first one of their block of ids.

    h is the unsigned crc32 of the decimal id, modulo ``most``; a conversation's own turns
    follow after its first h.  Returns (conv_id, depth from 1, key, n_chars, last) and all
    (conv_id, length).
    """
    c = F.col("conv_id")
    openings = (turns.filter((c % block == 0) & (F.col("pos") < most - 1))  # at most most - 1 turns each
                .groupBy(c.alias("base"))
                .agg(F.sort_array(F.collect_list(F.struct("pos", "key", "n_chars"))).alias("opening")))
    convs = (turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("h", F.crc32(c.cast("string")) % most).withColumn("base", c - c % block)
             .join(openings, "base", "left")
             .withColumn("opening", F.slice("opening", F.lit(1), F.col("h").cast("int")))
             .withColumn("m", F.greatest(F.coalesce(F.size("opening"), F.lit(0)), F.lit(0)).cast("long"))
             .withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    opened = (convs.select("conv_id", "length", F.explode("opening").alias("x"))
              .select("conv_id", "length", (F.col("x.pos") + 1).alias("depth"), "x.key", "x.n_chars"))
    own = (turns.join(convs.select("conv_id", "h", "m", "length"), "conv_id").filter(F.col("pos") >= F.col("h"))
           .select("conv_id", "length", (F.col("m") + F.col("pos") - F.col("h") + 1).alias("depth"), "key", "n_chars"))
    rows = opened.unionByName(own).withColumn("last", F.col("depth") == F.col("length")).drop("length")
    return rows, convs.select("conv_id", "length")


def _prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, x1, x2 (the prefix's digest), p1, p2 (its parent's), n_chars, last; written."""
    z = [F.xxhash64(F.lit(seed), F.col("depth"), F.col("key")).alias(f"z{seed}") for seed in (1, 2)]
    ranged = written(
        rows.select("conv_id", "depth", "n_chars", "last", *z)
        .repartitionByRange(shuffle_partitions(rows.sparkSession), "conv_id", "depth")
        .sortWithinPartitions("conv_id", "depth").withColumn("part", F.spark_partition_id()), "trie-steps")
    here = Window.partitionBy("part", "conv_id").orderBy("depth")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Conversations that go over several partitions: at most two for each partition and the long ones.
    shifts = (ranged.groupBy("conv_id", "part").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"))
              .select("conv_id", "part", F.bit_xor("z1").over(earlier).alias("s1"), F.bit_xor("z2").over(earlier).alias("s2"))
              .filter(F.col("s1").isNotNull()))
    shift = lambda k: F.coalesce(F.col(f"s{k}"), F.lit(0))
    running = (ranged.withColumn("r1", F.bit_xor("z1").over(here)).withColumn("r2", F.bit_xor("z2").over(here))
               .join(shifts, ["conv_id", "part"], "left")
               .withColumn("x1", F.col("r1").bitwiseXOR(shift(1))).withColumn("x2", F.col("r2").bitwiseXOR(shift(2))))
    return written(running.select("conv_id", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("z1")).alias("p1"),
                                  F.col("x2").bitwiseXOR(F.col("z2")).alias("p2"), "n_chars", "last"), "trie-prefixes")


def _digests(table: pa.Table, first: str, second: str) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().view(np.uint64) for c in (first, second)], axis=1)


def _enumerate(table: pa.Table) -> pa.Table:
    """A shard's nodes: one row per slot, with the counts of its own members."""
    own, above = _digests(table, "x1", "x2"), _digests(table, "p1", "p2")
    level, head = table.column("level").to_numpy(), table.column("head").to_numpy(zero_copy_only=False)
    mark = np.uint64(HEAD_MARK)
    named = own ^ np.where(head, mark, np.uint64(0))[:, None]
    above = above ^ np.where((level == 1) & (table.column("depth").to_numpy() > 1), mark, np.uint64(0))[:, None]
    slots_of = SlotTable(distinct(named))
    slot, n = slots_of.slots(named), len(slots_of.kept)
    member = slot[~head]

    def scattered(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, values.dtype)
        out[slot] = values
        return out

    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, member, table.column("conv_id").to_numpy()[~head])
    last = table.column("last").to_numpy(zero_copy_only=False) & ~head
    parent = slots_of.slots(np.stack([scattered(above[:, 0]), scattered(above[:, 1])], axis=1))
    parent[scattered(level) == 0] = -1  # what lies above a head is another segment's
    digests = np.stack([scattered(own[:, 0]), scattered(own[:, 1])], axis=1).view(np.int64)
    columns = {"shard": np.full(n, table.column("shard")[0].as_py()), "slot": np.arange(n), "parent_slot": parent,
               "x1": digests[:, 0], "x2": digests[:, 1], "depth": scattered(table.column("depth").to_numpy()),
               "level": scattered(level), "n_chars": scattered(table.column("n_chars").to_numpy()),
               "n": np.bincount(member, minlength=n), "n_ends": np.bincount(slot[last], minlength=n),
               "conv_id": smallest}
    return pa.table({k: pa.array(np.ascontiguousarray(v), pa.int64()) for k, v in columns.items()})


def _fold(table: pa.Table) -> pa.Table:
    """A shard's partial sums for every node it holds, and for the root."""
    table = table.take(pa.array(np.argsort(table.column("slot").to_numpy())))
    value = {c: table.column(c).to_numpy() for c in table.column_names}
    head = value["n"] == 0
    own = (value["owner"] == value["shard"]) & ~head
    parent, depth = value["parent_slot"], value["depth"]
    leaves = (own & (value["all_convs"] == value["all_ends"])).astype(np.int64) + value["more_leaves"]
    saved = np.where(own, (value["all_convs"] - 1) * value["n_chars"], 0) + value["more_saved"]
    accumulate(parent, value["level"], leaves, saved)
    children = np.bincount(parent[own & (parent >= 0)], minlength=len(parent))
    # A node's parent is in its shard: above it in the segment, or the segment's head.
    above = np.where(own & (parent >= 0), value["all_conv_id"][parent], 0)
    top = (depth == 1) & ~head

    def column(numbers: np.ndarray, of_root: int | None, known: np.ndarray | None = None) -> pa.Array:
        missing = None if known is None else np.append(~known, of_root is None)
        return pa.array(np.append(numbers, of_root or 0).astype(np.int64), pa.int64(), mask=missing)

    return pa.table({
        "x1": column(value["x1"], 0), "x2": column(value["x2"], 0),
        "n_children": column(children, int((own & top).sum())),
        "n_leaves": column(np.where(head, 0, leaves), int(leaves[top].sum())),
        "saved_tokens": column(np.where(head, 0, saved), int(saved[top].sum())),
        "conv_id": column(value["all_conv_id"], None, own),
        "parent_conv_id": column(above, None, own & (parent >= 0)),
        "depth": column(depth, None, own), "n_convs": column(value["all_convs"], None, own)})


def _below(prefixes: DataFrame, nodes: DataFrame, shard: Column, segment: int) -> DataFrame:
    """shard, x1, x2, more_leaves, more_saved: what conversations own below the last turn of each segment."""
    totals = (nodes.filter(F.col("all_depth") > segment)
              .groupBy(F.col("all_conv_id").alias("conv_id"), F.expr(f"(all_depth - 1) div {segment}").alias("segment"))
              .agg(F.sum((F.col("all_convs") == F.col("all_ends")).cast("long")).alias("leaves"),
                   F.sum((F.col("all_convs") - 1) * F.col("all_chars")).alias("saved")))
    ends = (prefixes.filter((F.col("depth") % segment == 0) & ~F.col("last"))
            .withColumn("segment", F.expr(f"(depth - 1) div {segment}")).withColumn("shard", shard)
            .withColumn("segment", F.col("segment") + 1))
    later = Window.partitionBy("conv_id").orderBy(F.col("segment").desc())  # one row per segment of a conversation
    amount = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(later).alias(c)
    return (ends.join(totals, ["conv_id", "segment"], "left")
            .select("shard", "x1", "x2", amount("leaves"), amount("saved"))
            .groupBy("shard", "x1", "x2").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))


def _ends(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """x1, x2, ends_sha256 of every node at which conversations end."""
    n = shuffle_partitions(prefixes.sparkSession)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x1, x2, ids = (batch.column(i).to_numpy() for i in range(3))
            starts = np.concatenate([[0], np.flatnonzero((np.diff(x1) != 0) | (np.diff(x2) != 0)) + 1])
            texts = np.split(ids, starts[1:])
            yield pa.RecordBatch.from_pydict({
                "x1": pa.array(x1[starts]), "x2": pa.array(x2[starts]), "first": pa.array(ids[starts]),
                "ids": pa.array([",".join(map(str, t.tolist())) for t in texts], pa.large_string())})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done: list[tuple] = []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for x1, x2, ids in rows:
                if (x1, x2) == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha = (x1, x2), hashlib.sha256(ids.encode())
            yield _named(done)
        if node is not None:
            yield _named([(*node, sha.hexdigest())])

    def _named(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.int64()),
                                           pa.array([r[2] for r in done], pa.string())], ["x1", "x2", "ends_sha256"])

    none = F.lit(0).cast("long")
    ended = (prefixes.filter("last").select("x1", "x2", "conv_id")
             .unionByName(lengths.filter("length = 0").select(none.alias("x1"), none.alias("x2"), "conv_id")))
    strings = (ended.repartitionByRange(n, "x1", "x2", "conv_id").sortWithinPartitions("x1", "x2", "conv_id")
               .mapInArrow(joined, "x1 long, x2 long, first long, ids string"))
    return (strings.repartition(n, "x1", "x2").sortWithinPartitions("x1", "x2", "first")
            .mapInArrow(hashed, "x1 long, x2 long, ends_sha256 string"))


def prefix_trie(rows: DataFrame, lengths: DataFrame, segment: int = SEGMENT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie of all conversations, the root included.

    ``rows`` holds conv_id, depth (from 1, gapless), key (binary: equal turns have equal
    keys), n_chars and last; ``lengths`` every conv_id once, with its number of turns.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, members but one times the node's n_chars) and
    ends_sha256 (of the comma-joined ids that end there).
    """
    spark = rows.sparkSession
    lengths = written(lengths.select("conv_id", "length"), "trie-lengths")
    whole = lengths.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.sum("length").alias("turns")).first()
    if not whole["n"]:
        return spark.createDataFrame([], _SCHEMA)
    prefixes = _prefixes(rows)
    shards = max(-(-whole["turns"] // shard_rows), shuffle_partitions(spark))
    shard = F.pmod(F.xxhash64("conv_id", "segment"), F.lit(shards))
    cut = prefixes.withColumn("segment", F.expr(f"(depth - 1) div {segment}")).withColumn("head", F.lit(False))
    heads = (cut.filter((F.col("depth") % segment == 0) & ~F.col("last"))
             .withColumn("segment", F.col("segment") + 1).withColumn("head", F.lit(True)))
    dealt = cut.unionByName(heads).withColumn("shard", shard).withColumn("level", F.col("depth") - F.col("segment") * segment)
    held = written(dealt.drop("segment").groupBy("shard").applyInArrow(
        _enumerate, "shard long, slot long, parent_slot long, x1 long, x2 long, depth long, level long, n_chars long, "
                    "n long, n_ends long, conv_id long"), "trie-slots")
    nodes = (held.filter("n > 0").groupBy("x1", "x2")
             .agg(F.sum("n").alias("all_convs"), F.sum("n_ends").alias("all_ends"), F.max("depth").alias("all_depth"),
                  F.max("n_chars").alias("all_chars"), F.min(F.struct("conv_id", "shard")).alias("owner"))
             .select("x1", "x2", "all_convs", "all_ends", "all_depth", "all_chars",
                     F.col("owner.conv_id").alias("all_conv_id"), F.col("owner.shard").alias("owner")))
    more = _below(prefixes, nodes, shard, segment)
    at = lambda c: F.when(F.col("n") > 0, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).alias(c)
    known = (held.drop("conv_id", "n_ends").join(nodes.drop("all_depth", "all_chars"), ["x1", "x2"])
             .join(more, ["shard", "x1", "x2"], "left")
             .select("shard", "slot", "parent_slot", "x1", "x2", "depth", "level", "n_chars", "n", "all_convs", "all_ends",
                     "all_conv_id", "owner", at("more_leaves"), at("more_saved")))
    sums = known.groupBy("shard").applyInArrow(
        _fold, "x1 long, x2 long, n_children long, n_leaves long, saved_tokens long, conv_id long, "
               "parent_conv_id long, depth long, n_convs long")
    root = spark.range(1, numPartitions=1).select(*[F.lit(v).cast("long").alias(k) for k, v in {
        "x1": 0, "x2": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "conv_id": whole["first"],
        "parent_conv_id": None, "depth": 0, "n_convs": whole["n"]}.items()])
    found = sums.unionByName(root).unionByName(_ends(prefixes, lengths), allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    childless = (F.col("depth") == 0) & (F.col("n_children") == 0)
    above = F.when(F.col("depth") == 1, F.lit(whole["first"])).otherwise(F.col("parent_conv_id"))
    return (found.groupBy("x1", "x2").agg(
                total("n_children"), total("n_leaves"), total("saved_tokens"), F.max("conv_id").alias("conv_id"),
                F.max("parent_conv_id").alias("parent_conv_id"), F.max("depth").alias("depth"),
                F.max("n_convs").alias("n_convs"), F.max("ends_sha256").alias("ends_sha256"))
            .withColumn("parent_conv_id", above)
            .withColumn("n_leaves", F.when(childless, F.lit(1)).otherwise(F.col("n_leaves")))
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))
            .select(*_NODE))
