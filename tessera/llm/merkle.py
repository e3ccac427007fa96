"""Merkle manifest of a dataset by time-forward processing.

Rows become leaves of one 16-ary hash tree per group (source), and the group roots become leaves of
a top tree. Every node has the label (end of the leaf range below it, height): children come before
their parents in label order, so one sweep in that order can evaluate the whole forest. Nodes do not
look each other up; they send messages through a priority queue ordered by the receiver's label.

* Upward sweep: a node receives its children's digests, hashes them and sends the result on to its
  parent's label.
* Reversed sweep: labels are taken from the last to the first. A node receives the proof suffix that
  leads from it to the root, puts each child's siblings in front and sends that to the child; a leaf
  receives its whole proof.

The queue is external. A task takes blocks of 16^3 (``lift``) consecutive leaves and holds the messages to labels
inside the block in a heap, where at most 16 a height wait at a time. A message to a label outside the
block becomes a row; Spark's shuffle sorts such rows by label (spilling to disk as needed) and delivers
them in front of the receiving block in the next round. A round lifts every tree by three levels, so
their number is log_4096 of the largest group. Hot groups are many blocks; no group, no proof list and
no set of digests of the whole dataset meets in one task or on the driver.

Defined cases: null fields count as ``-``; a null group is a group and comes first; equal rows are
leaves of their own, in any order (their proofs differ in position only); rows with a null order key
come first; an empty table gives no rows; texts of any length are hashed whole; further columns
are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tessera.llm.common import crc_mod, lower_ascii, stage
from tessera.llm.sharding import slots

ARITY = 16
#: Levels that one round lifts; a block has ARITY ** LIFT leaves.
LIFT = 3
#: Proofs that leave a task in one Arrow batch (some kilobytes each).
BATCH = 512

LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left string, right string>>"


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ sweeps over one block
def height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def forward_sweep(leaves: Sequence[str], levels: int) -> dict[tuple[int, int], list[str]]:
    """Digests that each inner node of ``levels`` levels above ``leaves`` received, by node label."""
    m, received, queue = len(leaves), {}, []

    def send(end: int, h: int, digest: str) -> None:
        """To the parent of node (end, h); its label ends where its full range or the block ends."""
        span = ARITY ** (h + 1)
        heapq.heappush(queue, (min(-(-end // span) * span, m), h + 1, end, digest))

    for end, digest in enumerate(leaves, 1):
        if levels:
            send(end, 0, digest)
        while queue and queue[0][0] == end:  # every child of the first label has been sent
            h, inbox = queue[0][1], []
            while queue and queue[0][:2] == (end, h):
                inbox.append(heapq.heappop(queue)[3])
            received[end, h] = inbox
            if h < levels:
                send(end, h, _hash("".join(inbox)))
    return received


def top_digest(leaves: Sequence[str], levels: int) -> str:
    return _hash("".join(forward_sweep(leaves, levels)[len(leaves), levels])) if levels else leaves[0]


def reversed_sweep(leaves: Sequence[str], levels: int, suffix: list[tuple[str, str]]) -> Iterator[tuple[int, list]]:
    """(leaf number, proof) from the last leaf to the first. A proof lists, from the leaf up, the digests
    left and right of the node in its run; ``suffix`` is that of the block's top node."""
    received = forward_sweep(leaves, levels)
    m = len(leaves)
    queue = [(-m, -levels, suffix)]  # labels from the last to the first
    while queue:
        end, h, proof = heapq.heappop(queue)
        end, h = -end, -h
        if h == 0:
            yield end - 1, proof
            continue
        inbox = received[end, h]
        span = ARITY ** (h - 1)
        first = (end - 1) // (span * ARITY) * ARITY
        for j in range(len(inbox)):
            siblings = ("".join(inbox[:j]), "".join(inbox[j + 1 :]))
            heapq.heappush(queue, (-min((first + j + 1) * span, m), 1 - h, [siblings, *proof]))


# ------------------------------------------------------------------ rounds over all blocks
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Header and leaves of each block; rows come sorted by block, the header (pos -1) first."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        starts = np.flatnonzero(table["pos"].to_numpy() == -1).tolist()
        opens = set(starts)
        for a, b in zip([0, *starts], [*starts, table.num_rows]):
            if a in opens and held:
                yield pa.concat_tables(held)
                held = []
            if b > a:
                held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def _levels(n: int, lift: int) -> int:
    """Levels of a block of a tree with ``n`` leaves: all blocks of a larger tree are lifted alike."""
    return min(lift, height(n))


def _up(lift: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string())])

    def flush() -> pa.RecordBatch:
        rows = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    for block in _blocks(batches):
        tree, number, n = (block[c][0].as_py() for c in ("tree", "block", "n"))
        out.append((tree, number, top_digest(block["digest"].slice(1).to_pylist(), _levels(n, lift))))
        if len(out) >= 4096:
            yield flush()
    if out:
        yield flush()


def _down(lift: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entry = pa.struct([("left", pa.string()), ("right", pa.string())])

    def proofs(found: list[list[tuple[str, str]]]) -> pa.Array:
        flat = [e for p in found for e in p]
        sides = [pa.array([e[k] for e in flat], pa.string()) for k in (0, 1)]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(sides, fields=list(entry)))

    for block in _blocks(batches):
        head = {c: block[c][0].as_py() for c in ("n", "proof", "subroot", "root")}
        rows = block.slice(1)
        suffix = [(e["left"], e["right"]) for e in head["proof"]]
        found: list = [None] * rows.num_rows
        for i, proof in reversed_sweep(rows["digest"].to_pylist(), _levels(head["n"], lift), suffix):
            found[i] = proof
        for at in range(0, len(found), BATCH):
            part = rows.slice(at, BATCH)
            known = {"proof": proofs(found[at : at + BATCH]), **{c: pa.array([head[c]] * part.num_rows, pa.string()) for c in ("subroot", "root")}}
            cols = [known.get(c, part[c]) for c in part.column_names if c not in ("block", "n")]
            names = [c for c in part.column_names if c not in ("block", "n")]
            yield from pa.Table.from_arrays(cols, names=names).combine_chunks().to_batches()


def _delivered(rows: DataFrame, heads: DataFrame, lift: int) -> DataFrame:
    """Rows and the messages to their blocks, block by block in label order, each message first."""
    block = F.floor(F.col("pos") / ARITY**lift).cast("long")
    sent = rows.withColumn("block", block).unionByName(heads.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    return sent.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def climb(rows: DataFrame, lift: int = LIFT) -> list[tuple[DataFrame, DataFrame]]:
    """Layers (rows: tree, pos, digest...; sizes: tree, n), from the leaves to one root per tree."""
    layers = []
    sizes = stage(rows.groupBy("tree").agg(F.count("*").alias("n")), "merkle-sizes")
    while True:
        layers.append((rows, sizes))
        if (sizes.agg(F.max("n")).first()[0] or 1) == 1:
            return layers
        n_blocks = F.ceil(F.col("n") / ARITY**lift).cast("long")
        heads = sizes.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"), "n")
        lifted = _delivered(rows.select("tree", "pos", "digest"), heads, lift).select("tree", "pos", "digest", "block", "n")
        rows = stage(lifted.mapInArrow(partial(_up, lift), "tree string, pos long, digest string"), "merkle-layer")
        sizes = sizes.select("tree", n_blocks.alias("n"))


def descend(layers: list[tuple[DataFrame, DataFrame]], roots: DataFrame, lift: int = LIFT) -> DataFrame:
    """Leaf rows with proof, subroot and root. ``roots``: tree, proof (of the tree's root), subroot, root."""
    heads = roots.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(layers) - 2, -1, -1):
        rows, sizes = layers[k]
        sent = _delivered(rows, heads.join(sizes, "tree"), lift)
        names = [*rows.columns, "proof", "subroot", "root"]
        types = {f.name: f.dataType for f in sent.schema}
        sent = sent.select(*names, "block", "n")
        out = sent.mapInArrow(partial(_down, lift), T.StructType([T.StructField(c, types[c]) for c in names]))
        heads = stage(out.select("tree", F.col("pos").alias("block"), "proof", "subroot", "root"), "merkle-suffixes") if k else None
    if len(layers) == 1:  # no tree has a second leaf
        return layers[0][0].join(roots, "tree")
    return out


def manifest(rows: DataFrame, group: str, order: Sequence[str], digest: str = "leaf", lift: int = LIFT) -> DataFrame:
    """``rows`` with proof, subroot and root: one tree per value of ``group``, leaves in ``order``
    (nulls first, ties by digest), and a tree over the group roots in bytewise order of the group.

    ``proof`` is array<struct<left, right>>, from the leaf to the root: the concatenated digests before
    and after the node in its run. ``fold`` computes the root from a leaf and its proof."""
    payload = F.struct(*[F.col(c) for c in rows.columns])
    tree = F.concat(F.lit("="), F.col(group).cast("string"))
    leaves = stage(rows.select(F.coalesce(tree, F.lit("")).alias("shard"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(order)],
                               F.col(digest).alias("digest"), payload.alias("row")), "merkle-leaves")
    placed = slots(leaves, [*[f"by{i}" for i in range(len(order))], "digest"])
    layers = climb(stage(placed.select(F.col("shard").alias("tree"), F.col("slot").alias("pos"), "digest", "row"), "merkle-placed"), lift)

    subroots = slots(layers[-1][0].select(F.lit("").alias("shard"), F.col("tree").alias("of"), "digest"), ["of"])
    top = climb(subroots.select(F.col("shard").alias("tree"), F.col("slot").alias("pos"), "digest", "of"), lift)
    no_proof = F.array().cast(PROOF).alias("proof")
    whole = top[-1][0].select("tree", no_proof, F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    roots = descend(top, whole, lift).select(F.col("of").alias("tree"), "proof", F.col("digest").alias("subroot"), "root")
    out = descend(layers, stage(roots, "merkle-roots"), lift)
    return out.select("row.*", "proof", "subroot", "root")


# ------------------------------------------------------------------ columns
def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda run: F.concat(run["left"], run["right"])), ""), 256)


def merkle_manifest(docs: DataFrame, lift: int = LIFT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    The folded root starts from the leaf of the text as found; where crc32(doc_id) is a multiple of 5 that
    text was tampered with (A-Z lower-cased), so a text with capitals there does not verify."""
    fields = {c: F.col(c) for c in LEAF_FIELDS}
    found = fields | {"text": F.when(crc_mod(F.col("doc_id"), 5) == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))}
    leaves = docs.select("doc_id", "source", leaf_digest(list(fields.values())).alias("leaf"), leaf_digest(list(found.values())).alias("found"))
    out = manifest(leaves, "source", ["doc_id"], lift=lift)
    folded = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                        fold(F.col("found"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
