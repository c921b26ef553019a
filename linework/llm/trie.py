"""The prefix trie of conversations, by sorted neighbours.

Conversations become arrays of turn digests and are sorted globally by range. The longest common prefix of neighbours opens
and closes nodes on a stack, so each partition is swept once and holds one path. What lies on the path of a partition's
first or last row may go on in its neighbours: such pieces are left open, and a second sweep, over the pieces of all
partitions in order, stitches them together. It reads two paths for each partition, however many rows there are.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.chat_format import turns
from linework.llm.common import stored
from linework.llm.kernels import tidied

#: Conversations of a hundred share the opening of the first of them, of up to SHARED - 1 turns.
HUNDRED, SHARED = 100, 6
#: Parents with more children than one in PARENTS of all nodes are broadcast: there are at most PARENTS, and a name for each piece.
PARENTS = 4096
#: Rows handed on at once, and ids of a piece's members in one row.
BATCH, IDS = 1000, 4096

#: ref and parent: numbers of nodes within a partition. kind: node (closed), first, last or both (a piece on the path of the
#: partition's first row, its last row, or both). A piece's ends, its members of just its depth, come in rows of IDS at most;
#: those after the first (chunk over 0) add nothing else.
SWEPT = (
    "part int, ref long, parent long, kind string, depth int, digest binary, chars long, conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, chunk int, ends array<long>"
)
STITCHED = "part int, ref long, top_part int, top_ref long, up_part int, up_ref long, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, seq array<struct<digest, chars>>): each conversation's turns in order; of equal turn numbers by role, then digest."""
    t = turns(rows).where("conv_id is not null").select("conv_id", "turn", "role", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.length("text").cast("long").alias("chars"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "chars")))  # a null turn comes first
    return t.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("seq"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """sequences() of conversations that open with the first h turns of their hundred's first one, and go on with their own after h."""
    own = sequences(rows)
    base = own.select(F.col("conv_id").alias("base"), F.slice("seq", 1, SHARED - 1).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    met = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED).join(base, "base", "left")
    opening = F.coalesce(F.slice("opening", F.lit(1), h), F.slice("seq", 1, 0))
    rest = F.slice("seq", h + 1, F.greatest(F.size("seq"), F.lit(1)))
    return met.select("conv_id", F.concat(opening, rest).alias("seq"))


class _Open:
    """A node on the stack: what is known of it so far."""

    __slots__ = ("chars", "conv", "convs", "digest", "ends", "kids", "leaves", "ref", "run", "saved", "sha")

    def __init__(self, ref: object, digest: bytes | None, chars: int):
        self.ref, self.digest, self.chars = ref, digest, chars
        self.conv: int | None = None
        self.convs = self.kids = self.leaves = self.saved = 0
        self.sha, self.ends, self.run = hashlib.sha256(), 0, array("q")

    def met(self, conv: int | None, convs: int) -> None:
        self.convs += convs
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv

    def end(self, conv: int) -> None:
        self.sha.update(f",{conv}".encode() if self.ends else str(conv).encode())
        self.ends += 1

    def total(self, depth: int) -> tuple[int, int]:
        """Leaves and saved tokens of the whole subtree, once nothing more comes."""
        return self.leaves or int(not self.kids), self.saved + (self.convs - 1) * self.chars * (depth > 0)

    def grown(self, child: _Open, depth: int) -> None:
        """Takes a closed child of depth in."""
        leaves, saved = child.total(depth)
        self.kids, self.leaves, self.saved = self.kids + 1, self.leaves + leaves, self.saved + saved
        self.met(child.conv, child.convs)


_SWEPT = [("part", pa.int32()), ("ref", pa.int64()), ("parent", pa.int64()), ("kind", pa.string()), ("depth", pa.int32()), ("digest", pa.binary()), ("chars", pa.int64()), ("conv_id", pa.int64())]
_SWEPT += [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string()), ("chunk", pa.int32()), ("ends", pa.list_(pa.int64()))]
_STITCHED = [("part", pa.int32()), ("ref", pa.int64()), ("top_part", pa.int32()), ("top_ref", pa.int64()), ("up_part", pa.int32()), ("up_ref", pa.int64()), ("depth", pa.int32()), ("conv_id", pa.int64())]
_STITCHED += [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string())]


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, conv_id, digests, chars) of one partition, in order: closed nodes and open pieces, children before their parents."""
    stack: list[_Open] = []
    out: list[tuple] = []
    made = part = touch = 0  # touch: how much of the first row's path is still open

    def close(kind: str) -> None:
        depth = len(stack) - 1
        e, up = stack.pop(), stack[-1] if stack else None
        named = (part, e.ref, up.ref if up else None, kind, depth, e.digest, e.chars)
        if kind == "node":
            up.grown(e, depth)
            out.append((*named, e.conv, e.convs, e.kids, *e.total(depth), e.sha.hexdigest(), 0, None))
            return
        out.append((*named, e.conv, e.convs, e.kids, e.leaves, e.saved, None, 0, e.run[:IDS]))
        out.extend((*named, None, 0, 0, 0, 0, None, k, e.run[at : at + IDS]) for k, at in enumerate(range(IDS, len(e.run), IDS), 1))

    for batch in batches:
        for p, conv, digests, chars in zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "digests", "chars")), strict=True):
            shared = 0
            for e, d in zip(stack[1:], digests, strict=False):
                if e.digest != d:
                    break
                shared += 1
            opened = not stack
            if opened:
                part = p
                stack.append(_Open(made, None, 0))
                made += 1
            while len(stack) - 1 > shared:
                close("first" if len(stack) - 1 <= touch else "node")
            for d, n in zip(digests[shared:], chars[shared:], strict=True):
                stack.append(_Open(made, d, n))
                made += 1
            touch = len(digests) if opened else min(touch, shared)
            top = stack[-1]
            top.met(conv, 1)
            top.end(conv)
            top.run.append(conv)
            while len(out) >= BATCH:
                yield _batch(out[:BATCH], _SWEPT)
                out = out[BATCH:]
    while stack:
        close("both" if len(stack) - 1 <= touch else "last")
    for at in range(0, len(out), BATCH):
        yield _batch(out[at : at + BATCH], _SWEPT)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by partition, and in each the path of its first row from the root on, then that of its last. One path is held.

    Gives a row for each piece: the node it belongs to (its first piece's name); and with a node's first piece the node itself.
    """
    stack: list[_Open] = []
    out: list[tuple] = []
    mine: list[list[tuple[int, int]]] = []  # the pieces of each node on the stack

    def close() -> None:
        depth = len(stack) - 1
        e, pieces = stack.pop(), mine.pop()
        up = stack[-1].ref if stack else (None, None)
        leaves, saved = e.total(depth)
        if stack:
            stack[-1].grown(e, depth)
        out.extend((*piece, *e.ref, *up, depth, e.conv, e.convs, e.kids, leaves, saved, e.sha.hexdigest()) for piece in pieces)

    goes_on = False
    for batch in batches:
        for r in batch.to_pylist():
            depth = r["depth"]
            if r["chunk"] == 0:
                goes_on = depth == 0 or goes_on and r["kind"] != "last"
                goes_on = goes_on and len(stack) > depth and stack[depth].digest == r["digest"]
                if not goes_on:
                    while len(stack) > depth:
                        close()
                    stack.append(_Open((r["part"], r["ref"]), r["digest"], r["chars"]))
                    mine.append([])
                mine[depth].append((r["part"], r["ref"]))
            e = stack[depth]
            e.met(r["conv_id"], r["n_convs"])
            e.kids, e.leaves, e.saved = e.kids + r["n_children"], e.leaves + r["n_leaves"], e.saved + r["saved_tokens"]
            for conv in r["ends"] or ():
                e.end(conv)
            if len(out) >= BATCH:
                yield _batch(out, _STITCHED)
                out = []
    while stack:
        close()
    if out:
        yield _batch(out, _STITCHED)


def sweep(seqs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Closed nodes and open pieces of seqs (conv_id, seq), stored. Equal sequences are dealt by conv_id too, so copies spread."""
    n = partitions or int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = seqs.select("conv_id", F.transform("seq", lambda x: x["digest"]).alias("digests"), F.transform("seq", lambda x: x["chars"]).alias("chars"))
    dealt = flat.repartitionByRange(n, "digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    return stored(dealt.select(F.spark_partition_id().alias("part"), "conv_id", "digests", "chars").mapInArrow(tidied(_swept), SWEPT), "swept")


def stitch(swept: DataFrame) -> DataFrame:
    """The pieces' nodes. One task reads them, two paths for each partition."""
    pieces = swept.where("kind <> 'node'").select("part", "ref", "kind", "depth", "digest", "chars", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "chunk", "ends")
    order = ["part", F.when(F.col("kind") == "last", 1).otherwise(0), "depth", "chunk"]
    return pieces.repartition(1).sortWithinPartitions(*order).mapInArrow(tidied(_stitched), STITCHED)


def prefix_trie(seqs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per node of the trie of seqs (conv_id, seq): conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    swept = sweep(seqs, partitions)
    joined = stored(stitch(swept), "stitched")
    closed = swept.where("kind = 'node'")
    tops = joined.where("part = top_part and ref = top_ref")
    nodes = closed.select(F.col("part").alias("up_part"), F.col("parent").alias("up_ref"), *NODE).unionByName(tops.select("up_part", "up_ref", *NODE))
    # A parent is a closed node, or a node by any of its pieces' names.
    parents = closed.select("part", "ref", "conv_id", "n_children").unionByName(joined.select("part", "ref", "conv_id", "n_children"))
    parents = parents.select(F.col("part").alias("up_part"), F.col("ref").alias("up_ref"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    least = max(1, -(-swept.count() // PARENTS))
    many = parents.where(F.col("n_children") > least).drop("n_children")
    few = parents.where(F.col("n_children") <= least).drop("n_children")
    near = nodes.join(F.broadcast(many.withColumnRenamed("parent_conv_id", "_near")), ["up_part", "up_ref"], "left")
    done, rest = near.where("_near is not null or up_ref is null"), near.where("_near is null and up_ref is not null")
    found = done.withColumnRenamed("_near", "parent_conv_id").unionByName(rest.drop("_near").join(few, ["up_part", "up_ref"], "left"))
    return found.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *NODE[2:])


def conversation_trie(rows: DataFrame) -> DataFrame:
    """prefix_trie() of rebuilt() conversations.

    Null roles and texts are empty, null turns come first, turns of one number by role and digest; rows that repeat are turns each.
    Rows of null conv_id belong to no conversation and are left out. A conversation is one row, of 40 bytes a turn. Extra columns
    are ignored; an empty table gives no rows.
    """
    return prefix_trie(rebuilt(rows))
