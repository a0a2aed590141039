"""Prefix trie of conversations, built as burst tries.

Every conversation is a suffix in the container of the root.  A container with
more than CONTAINER_IDS turns to come bursts: its suffixes are dealt by their
next turn into a container a turn, under a head that is a node of the trie.  What
all suffixes of a container share is skipped in one step, so a burst always
branches, and conversations that are alike are one suffix with a count.  A
container that is left holds a bounded number of turns: one task sorts its
suffixes and sweeps them into nodes, and a container with a single suffix is a
chain whose nodes follow from running sums.  Then the heads add up what lies
below them, the last bursts first.

A turn is known by the MD5 of its role and text; texts are not shuffled.  The
turns of a conversation are rows from first to last (position and bytes so far
come from ordered slices), so one conversation may hold any share of the table;
so may one text, first turn or group of equal conversations.  Only the digest
of the members that end in a node is sequential by its definition: their ids are
joined where they are sorted, and a task hashes the pieces in order.

Rows without conv_id belong to no conversation.  A null turn comes first, turns
that tie come in the order of their MD5, and repeated rows are turns of their
own.  Null role and text count as empty.  Conversations without a turn end in the
root; an empty table has no node.  Long texts are hashed whole.  Only conv_id,
turn, role and text are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.batches import materialize
from gaugework.operators.hot_keys import lookup
from gaugework.operators.ordered import running_totals

# Turns below a head at which its container bursts.
CONTAINER_IDS = 1024
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, end_rep long"
)
BELOW = "container string, children long, leaves long, saved long, end_rep long"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), tid, bytes and cum, the bytes up to this turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("tid"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("tid")]
    return materialize(running_totals(turns, ["conv_id"], order, "pos", {"cum": "bytes"}).drop("turn"))


def share_openings(turns: DataFrame, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Gives conversations the opening of the one they branch from.

    The first h turns of c come from c - c % every, the rest are its own after
    its first h; h = crc32(c) % (most + 1).  Returns the turns, and (conv_id,
    len) for every conversation, without turns or with.
    """
    opening = F.when(F.col("pos") <= most, F.struct("pos", "tid", "bytes", "cum"))
    heads = materialize(
        turns.groupBy("conv_id").agg(
            F.max("pos").alias("turns"), F.sort_array(F.collect_list(opening)).alias("opening")
        )
    )
    base = heads.select(F.col("conv_id").alias("base"), F.col("opening").alias("theirs"))
    h = lambda conv: F.crc32(F.col(conv).cast("string")) % (most + 1)
    last = lambda opening, n: F.when(n > 0, F.get(opening, (n - 1).cast("int"))["cum"]).otherwise(0)
    k, own = F.col("k"), F.least(F.col("h"), F.col("turns"))
    plan = (
        heads.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
        .join(base, "base", "left")
        .withColumn("h", h("conv_id"))
        .withColumn("k", F.least(F.col("h"), F.coalesce(F.size("theirs"), F.lit(0))))
        .select(
            "conv_id",
            (k - F.col("h")).alias("shift"),
            (last(F.col("theirs"), k) - last(F.col("opening"), own)).alias("more"),
            F.slice(F.coalesce("theirs", F.array()), 1, k.cast("int")).alias("theirs"),
            (k + F.greatest(F.lit(0), F.col("turns") - F.col("h"))).alias("len"),
        )
    )
    plan = materialize(plan)
    mine = lookup(
        turns.where(F.col("pos") > h("conv_id")), plan.select("conv_id", "shift", "more"), ["conv_id"], "inner", ["pos"]
    ).select(
        "conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "tid", "bytes", (F.col("cum") + F.col("more")).alias("cum")
    )
    theirs = plan.select("conv_id", F.explode("theirs").alias("t")).select("conv_id", "t.*")
    return materialize(mine.unionByName(theirs)), plan.select("conv_id", "len")


def _sequences(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, len, k1, k2, total): k1 and k2 tell the sequence, by partial sums only."""
    mixed = turns.groupBy("conv_id").agg(
        F.bit_xor(F.xxhash64("pos", "tid")).alias("k1"),
        F.bit_xor(F.xxhash64(F.lit(1), "tid", "pos")).alias("k2"),
        F.max("cum").alias("total"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("k1", "k2", "total")]
    return materialize(lengths.join(mixed, "conv_id", "left").select("conv_id", "len", *zero))


def member_digests(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256) over the ascending conv_ids of each rep, joined by commas."""

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs: dict[int, list[int]] = {}
            for rep, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs.setdefault(rep, []).append(conv)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(runs)), pa.array([c[0] for c in runs.values()]), pa.array([",".join(map(str, c)) for c in runs.values()])],
                ["rep", "first", "ids"],
            )

    def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        done: list[tuple[int, str]] = []
        for batch in batches:
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if rep != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = rep, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _pairs(done)
            done = []
        yield _pairs([(now, digest.hexdigest())] if now is not None else [])

    def _pairs(rows):
        reps, texts = [r for r, _ in rows], [t for _, t in rows]
        return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(texts, pa.string())], ["rep", "ends_sha256"])

    ordered = members.select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    pieces = ordered.mapInArrow(join_ids, "rep long, first long, ids string")
    dealt = pieces.repartition("rep").sortWithinPartitions("rep", "first")
    return dealt.mapInArrow(hash_pieces, "rep long, ends_sha256 string")


class _Open:
    """A node of the sweep whose subtree is not complete."""

    __slots__ = ("depth", "conv", "convs", "kids", "leaves", "saved", "bytes", "end")

    def __init__(self, depth: int, size: int):
        self.depth, self.bytes = depth, size
        self.conv = self.end = None
        self.convs = self.leaves = self.saved = 0
        self.kids: list[tuple] = []


def _sweep(suffixes: list[tuple], depth: int, owner: int, out: list[tuple]) -> tuple[int, int, int]:
    """Nodes of one container from its sorted suffixes (ids, sizes, rep, members).

    Appends rows of NODE, and returns children, leaves and saved of the head.
    """
    head = _Open(depth, 0)
    stack = [head]

    def close(down_to: int) -> None:
        while stack[-1].depth > down_to:
            node, above = stack.pop(), stack[-1]
            node.saved += (node.convs - 1) * node.bytes
            node.leaves = node.leaves or 1
            out.extend((c, d, node.conv, *rest) for c, d, *rest in node.kids)
            above.kids.append((node.conv, node.depth, node.convs, len(node.kids), node.leaves, node.saved, node.end))
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
            above.convs, above.leaves, above.saved = above.convs + node.convs, above.leaves + node.leaves, above.saved + node.saved

    before: list[bytes] = []
    for ids, sizes, rep, members in sorted(suffixes):
        shared = 0
        while shared < len(before) and shared < len(ids) and before[shared] == ids[shared]:
            shared += 1
        close(depth + shared)
        for place in range(shared, len(ids)):
            stack.append(_Open(depth + place + 1, sizes[place]))
        last = stack[-1]
        last.end, last.convs = rep, last.convs + members
        last.conv = rep if last.conv is None else min(last.conv, rep)
        before = ids
    close(depth)
    out.extend((c, d, owner, *rest) for c, d, *rest in head.kids)
    return len(head.kids), head.leaves, head.saved


def _sweep_containers(rows: DataFrame) -> DataFrame:
    """Sorted rows (container, rep, pos, tid, bytes, members, depth, owner) to nodes and sums of containers.

    A row with `container` set has the head's sums, the others are nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, suffixes, head = None, [], (0, 0)
        nodes: list[tuple] = []
        sums: list[tuple] = []

        def finish() -> None:
            if now is not None:
                sums.append((now, *_sweep(suffixes, *head, nodes)))

        def emit() -> pa.RecordBatch:
            blank = (None,) * 8
            made = [(*n, None, None, None, None) for n in nodes] + [(*blank, *s) for s in sums]
            columns = list(zip(*made)) or [()] * 12
            nodes.clear()
            sums.clear()
            kinds = [pa.int64()] * 8 + [pa.string()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for container, rep, tid, size, members, depth, owner in zip(*(c.to_pylist() for c in batch.columns)):
                if container != now:
                    finish()
                    now, suffixes, head = container, [], (depth, owner)
                if not suffixes or suffixes[-1][2] != rep:
                    suffixes.append(([], [], rep, members))
                suffixes[-1][0].append(tid)
                suffixes[-1][1].append(size)
            yield emit()
        finish()
        yield emit()

    schema = NODE + ", container string, children long, leaves long, saved long"
    names = [f.split()[0] for f in schema.split(", ")]
    ordered = rows.repartition("container").sortWithinPartitions("container", "rep", "pos")
    return ordered.select("container", "rep", "tid", "bytes", "members", "depth", "owner").mapInArrow(run, schema)


def _burst(active: DataFrame, sizes: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round for the containers in `sizes`: (bursts, chain, heads, next active).

    bursts: where each container branches and who ends there; chain: the nodes
    all its suffixes share before that; heads: the containers that come of it.
    """
    mine = active.join(sizes.select("container", "owner", "seqs", "convs"), "container")
    deep = turns.join(mine, "rep").where("pos > depth")
    same = deep.groupBy("container", "pos", "seqs").agg(
        F.count("*").alias("n"), F.min("tid").alias("least"), F.max("tid").alias("most")
    )
    branch = same.where("n < seqs or least <> most").groupBy("container").agg((F.min("pos") - 1).alias("at"))
    placed = materialize(sizes.join(branch, "container"))
    ends = (
        active.join(placed.select("container", "at"), "container")
        .where("len = at")
        .groupBy("container")
        .agg(F.max("rep").alias("end_rep"))
    )
    shared = turns.join(placed.select("container", "at", "depth", "owner", "convs"), F.col("rep") == F.col("owner"))
    chain = materialize(shared.where("pos > depth and pos <= at").select("container", "pos", "owner", "convs", "bytes", "cum"))
    reach = chain.groupBy("container").agg(F.max("cum").alias("cum_at"), F.min(F.col("cum") - F.col("bytes")).alias("cum_head"))
    bursts = materialize(placed.join(ends, "container", "left").join(reach, "container", "left"))
    step = turns.join(active.drop("depth", "cum").join(placed.select("container", "at", "owner"), "container"), "rep")
    new = F.md5(F.concat(F.col("container"), F.hex("tid")))
    dealt = materialize(
        step.where("pos = at + 1").select(
            new.alias("container"), F.col("container").alias("above"), F.col("owner").alias("parent_conv_id"),
            F.col("pos").alias("depth"), "bytes", "cum", "rep", "members", "len", "total",
        )
    )
    heads = materialize(
        dealt.groupBy("container", "above", "parent_conv_id", "depth").agg(
            F.min("rep").alias("conv_id"), F.sum("members").alias("n_convs"), F.max("bytes").alias("bytes")
        )
    )
    return bursts, chain, heads, dealt.select(*active.columns)


def prefix_trie(turns: DataFrame, lengths: DataFrame, container_ids: int = CONTAINER_IDS) -> DataFrame:
    """Nodes of the trie of turn sequences.

    turns: conv_id, pos, tid, bytes, cum; lengths: conv_id, len.  A node is a
    distinct sequence of first turns: conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    convs = _sequences(turns, lengths)
    same = ["k1", "k2", "len"]
    seqs = materialize(
        convs.groupBy(*same).agg(
            F.min("conv_id").alias("rep"), F.count("*").alias("members"), F.max("total").alias("total")
        )
    )
    repeated = seqs.where("members > 1").select(*same, "rep")
    many = member_digests(lookup(convs, repeated, same, "inner", ["conv_id"]))
    one = seqs.where("members = 1").select("rep", F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("ends_sha256"))
    kept = materialize(
        turns.join(seqs.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "rep")
    )
    root = lambda c: F.lit(c).cast("long")
    # Written, so that the root is a key like any other and no constant in the joins.
    active = materialize(
        seqs.select(F.lit("").alias("container"), root(0).alias("depth"), root(0).alias("cum"), "rep", "members", "len", "total")
    )
    top = active.groupBy("container").agg(F.min("rep").alias("conv_id"), F.sum("members").alias("n_convs"))
    heads = [
        top.select(
            "container", F.lit(None).cast("string").alias("above"), F.lit(None).cast("long").alias("parent_conv_id"),
            root(0).alias("depth"), "conv_id", "n_convs", root(0).alias("bytes"),
        )
    ]
    rounds, singles, shared = [], [], []
    while True:
        sizes = materialize(
            active.groupBy("container", "depth").agg(
                F.sum(F.col("len") - F.col("depth")).alias("ids"), F.count("*").alias("seqs"), F.min("rep").alias("owner"),
                F.sum("members").alias("convs"), F.max(F.when(F.col("len") == F.col("depth"), F.col("rep"))).alias("end_rep"),
            )
        )
        small = sizes.where((F.col("seqs") == 1) | (F.col("ids") <= container_ids))
        settled = active.join(small.select("container", "seqs", "owner", "end_rep"), "container")
        singles.append(settled.where("seqs = 1"))
        shared.append((settled.where("seqs > 1"), small.where("seqs > 1").select("container", "end_rep")))
        large = sizes.where((F.col("seqs") > 1) & (F.col("ids") > container_ids)).drop("end_rep")
        if large.isEmpty():
            break
        stay = large.select("container")
        bursts, chain, made, active = _burst(active.join(stay, "container", "left_semi"), large, kept)
        rounds.append((bursts, chain, made))
        heads.append(made)
    nodes, below = _settled(singles, shared, kept)
    for bursts, chain, made in reversed(rounds):
        more, below = _gather(bursts, chain, made, below)
        nodes = nodes.unionByName(more)
    for head in heads:
        nodes = nodes.unionByName(_head_nodes(head, below))
    digests = many.unionByName(one)
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(digests.withColumnRenamed("rep", "end_rep"), "end_rep", "left").select(
        *[f.split()[0] for f in NODE.split(", ")[:-1]], F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    rows = frames[0]
    for more in frames[1:]:
        rows = rows.unionByName(more)
    return rows


def _settled(singles: list[DataFrame], shared: list[tuple[DataFrame, DataFrame]], turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the containers that did not burst, and the sums of their heads."""
    single = materialize(_union(singles))
    last = F.col("pos") == F.col("len")
    chain = (
        turns.join(single.drop("cum"), "rep")
        .where("pos > depth")
        .select(
            F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.col("rep").alias("parent_conv_id"),
            F.col("members").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            ((F.col("members") - 1) * (F.col("total") - F.col("cum") + F.col("bytes"))).alias("saved_tokens"),
            F.when(last, F.col("rep")).alias("end_rep"),
        )
    )
    ended = F.col("len") == F.col("depth")
    alone = single.select(
        "container", F.when(ended, 0).otherwise(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
        ((F.col("members") - 1) * (F.col("total") - F.col("cum"))).alias("saved"), F.when(ended, F.col("rep")).alias("end_rep"),
    )
    rows = turns.join(_union([s for s, _ in shared]).drop("cum"), "rep").where("pos > depth")
    swept = materialize(_sweep_containers(rows))
    sums = swept.where("container is not null").select("container", "children", "leaves", "saved")
    together = sums.join(_union([e for _, e in shared]), "container")
    own = swept.where("container is null").select(*[f.split()[0] for f in NODE.split(", ")])
    return chain.unionByName(own), materialize(alone.unionByName(together))


def _gather(bursts: DataFrame, chain: DataFrame, heads: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums of burst containers from their children, and the nodes before the branch."""
    kids = (
        heads.join(below, "container")
        .groupBy(F.col("above").alias("container"))
        .agg(
            F.count("*").alias("branches"),
            F.sum("leaves").alias("leaves"),
            F.sum(F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        )
    )
    sums = materialize(bursts.join(kids, "container"))
    skipped = F.col("at") > F.col("depth")
    path = F.coalesce(F.col("cum_at") - F.col("cum_head"), F.lit(0))
    own = sums.select(
        "container", F.when(skipped, 1).otherwise(F.col("branches")).cast("long").alias("children"), "leaves",
        (F.col("saved") + (F.col("convs") - 1) * path).alias("saved"), F.when(~skipped, F.col("end_rep")).alias("end_rep"),
    )
    branching = F.col("pos") == F.col("at")
    nodes = chain.join(sums.select("container", "at", "branches", "leaves", "saved", "end_rep", "cum_at"), "container").select(
        F.col("owner").alias("conv_id"), F.col("pos").alias("depth"), F.col("owner").alias("parent_conv_id"), F.col("convs").alias("n_convs"),
        F.when(branching, F.col("branches")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("convs") - 1) * (F.col("cum_at") - F.col("cum") + F.col("bytes"))).alias("saved_tokens"),
        F.when(branching, F.col("end_rep")).alias("end_rep"),
    )
    return nodes, below.unionByName(own)


def _head_nodes(heads: DataFrame, below: DataFrame) -> DataFrame:
    return heads.join(below, "container").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), "end_rep",
    )
