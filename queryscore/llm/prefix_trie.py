"""The prefix trie of conversations, as a burst trie.

A turn is its 128-bit digest, a conversation the sequence of its turns. Equal sequences are one, with a
count. At first all of them lie in one container, that of the root. A container with more than
``CONTAINER`` sequences bursts: every different next turn becomes a node, a trie head, with a container
of its own for the sequences that go on behind it. When no container is too large, each is sorted and
swept once, with the nodes of the current sequence on a stack, and emits the nodes of its part of the
trie. Sums over subtrees then go up the tree of containers, in as many rounds as its depth has bits.

Nothing depends on how long a conversation is: it is cut into segments of ``SEGMENT`` turns. The
sequences of a later segment lie in the container of the node that ends the segment before, known by
a hash of all turns up to there. So a task holds a container, never a whole conversation or group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queryscore.llm.scratch import kept
from queryscore.operators.skew import left_join_skewed

#: Sequences that a container may hold before it bursts.
CONTAINER = 256
#: Turns of a conversation that one row holds.
SEGMENT = 64
ROOT = "root"
#: Conversations of one base share its first turns, at most ``PREFIXES`` - 1 of them.
BASE, PREFIXES = 5, 9
#: Segments of a conversation whose hashes are summed up in one group.
_BLOCK = 4096
_ID = 32
_PART_BYTES = 1 << 16


# --- turns in order -----------------------------------------------------------------------------


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of each row in its conversation, counted from the first row of the task."""
    last, count = None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        new = np.append(True, conv[1:] != conv[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        place = np.arange(len(conv)) - start + 1
        if conv[0] == last:
            place[: np.append(np.flatnonzero(new), len(conv))[1]] += count
        last, count = conv[-1], place[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, size) of all turns, pos from 1 in order of turn (null first).

    A null role or text is empty. Rows of one turn are ordered by their digest. Rows without a
    conv_id belong to no conversation. The order is a range sort, so a conversation may span tasks;
    only the counts of such conversations, one for each border, are looked up.
    """
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(
        "conv_id", "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.octet_length(text).cast("bigint").alias("size"), F.rand(13).alias("any"),
    )
    order = ["conv_id", "turn", "id", "any"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "id", "size")
    placed = placed.mapInArrow(_numbered, "conv_id long, id string, size long, place long")
    placed = kept(placed.withColumn("task", F.spark_partition_id()), "placed")
    spans = placed.groupBy("conv_id").agg(F.min("task").alias("low"), F.max("task").alias("high")).where("low < high")
    counts = placed.join(F.broadcast(spans.select("conv_id")), "conv_id").groupBy("conv_id", "task").agg(F.max("place").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_id", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    joined = placed.join(F.broadcast(kept(before, "before")), ["conv_id", "task"], "left")
    return joined.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "id", "size")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id, size, length) of the rebuilt turns, and (conv_id, length) of all conversations.

    A conversation takes its first h turns from its base and goes on with its own behind its first
    h; h is the CRC-32 of its id modulo ``PREFIXES``, the base is the id rounded to ``BASE``.
    """
    own = kept(turns(conversations), "turns")
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string")) % PREFIXES
    bases = kept(convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE).alias("base")), "bases")
    sizes = bases.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = bases.join(sizes, "base", "left").select(
        "conv_id", "base", "n", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    )
    plan = kept(plan, "plan")
    first = own.where((F.col("pos") < PREFIXES) & (F.col("conv_id") % BASE == 0)).withColumnRenamed("conv_id", "base")
    heads = first.join(plan.select("conv_id", "base", "taken", "length"), "base").where("pos <= taken").select("conv_id", "pos", "id", "size", "length")
    tails = left_join_skewed(own, plan.select("conv_id", "n", "h", "taken", "length"), ["conv_id"], "n").where("pos > h")
    tails = tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "size", "length")
    return kept(heads.unionByName(tails), "rebuilt"), plan.select("conv_id", "length")


# --- sequences ----------------------------------------------------------------------------------


def _hashes(segment: Column, digest: Column) -> tuple[Column, Column]:
    return F.xxhash64(segment, digest), F.xxhash64(digest, segment, F.lit(1))


def _prefix(segments: Column, *hashes: Column) -> Column:
    return F.md5(F.concat_ws("|", segments, *hashes))


def _segments(rows: DataFrame) -> DataFrame:
    """(conv_id, container, cid, base, seq, sizes, last) of the segments of all sequences.

    container is known by the turns before the segment, cid by the turns up to its end: both are
    hashes of hashes, summed up along a conversation in blocks.
    """
    cut = rows.withColumn("segment", F.floor((F.col("pos") - 1) / SEGMENT))
    turn = F.sort_array(F.collect_list(F.struct("pos", "id", "size")))
    whole = cut.groupBy("conv_id", "segment").agg(turn.alias("turns"), F.max("length").alias("length"))
    seq = F.array_join(F.col("turns.id"), "")
    whole = whole.select("conv_id", "segment", "length", seq.alias("seq"), F.col("turns.size").alias("sizes"))
    one, two = _hashes(F.col("segment"), F.md5("seq"))
    whole = kept(whole.withColumns({"one": one, "two": two, "block": F.floor(F.col("segment") / _BLOCK)}), "segments")
    long = whole.where(F.col("length") > SEGMENT)
    blocks = long.groupBy("conv_id", "block").agg(*[F.bit_xor(c).alias(c) for c in ("one", "two")])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}_block") for c in ("one", "two")])
    inside = Window.partitionBy("conv_id", "block").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    summed = long.withColumns({f"{c}_sum": F.bit_xor(c).over(inside) for c in ("one", "two")}).join(blocks, ["conv_id", "block"])
    summed = summed.withColumns({f"{c}_sum": F.col(f"{c}_sum").bitwiseXOR(F.col(f"{c}_block")) for c in ("one", "two")})
    short = whole.where(F.col("length") <= SEGMENT).withColumns({"one_sum": F.col("one"), "two_sum": F.col("two")})
    both = short.unionByName(summed.select(*short.columns))
    earlier = [F.col(f"{c}_sum").bitwiseXOR(F.col(c)) for c in ("one", "two")]
    return both.select(
        "conv_id", F.when(F.col("segment") == 0, ROOT).otherwise(_prefix(F.col("segment"), *earlier)).alias("container"),
        _prefix(F.col("segment") + 1, F.col("one_sum"), F.col("two_sum")).alias("cid"),
        (F.col("segment") * SEGMENT).alias("base"), "seq", "sizes", ((F.col("segment") + 1) * SEGMENT >= F.col("length")).alias("last"),
    )


# --- digests of members -------------------------------------------------------------------------


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the ids of each key, in pieces of bounded size."""
    for batch in batches:
        rows, key, ids, size = [], None, [], 0
        for now, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (now != key or size > _PART_BYTES):
                rows.append({"key": key, "first": ids[0], "part": ",".join(map(str, ids))})
                ids, size = [], 0
            key = now
            ids.append(conv)
            size += 20
        if ids:
            rows.append({"key": key, "first": ids[0], "part": ",".join(map(str, ids))})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("first", pa.int64()), ("part", pa.string())]))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per key, fed piece by piece; keys come one after the other."""
    key, state = None, None
    for batch in batches:
        rows = []
        for now, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist()):
            if now != key:
                if state is not None:
                    rows.append({"cid": key, "ends_sha256": state.hexdigest()})
                key, state = now, hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("cid", pa.string()), ("ends_sha256", pa.string())]))
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"cid": key, "ends_sha256": state.hexdigest()}])


def id_digests(members: DataFrame) -> DataFrame:
    """(cid, ends_sha256) from (key, conv_id): the digest of a key's ids, ascending and joined by commas.

    A digest of one text is sequential, so one task takes in the pieces of a key, one at a time;
    the pieces are sorted and joined by all tasks before.
    """
    parts = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_parts, "key string, first long, part string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digested, "cid string, ends_sha256 string")


# --- containers ---------------------------------------------------------------------------------


def _burst(sequences: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Sequences in containers of at most ``limit``, and the heads that bursting has made, round by round."""
    open_, settled, heads = sequences.withColumn("at", F.lit(0)), [], []
    n = F.length("seq") / _ID
    while True:
        big = kept(open_.groupBy("container").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > limit), "big")
        if big.isEmpty():
            settled.append(open_)
            break
        # the large containers are few: one row for more than ``limit`` sequences
        told = kept(open_.join(big, "container", "left"), "told")
        settled.append(told.where("many IS NULL").drop("many"))
        turn = F.substring(F.col("seq"), F.col("at") * _ID + 1, F.lit(_ID))
        burst = told.where("many IS NOT NULL").drop("many").withColumns({"child": F.md5(F.concat("container", turn)), "at": F.col("at") + 1})
        here = n == F.col("at")
        heads.append(kept(burst.groupBy(F.col("container").alias("up"), "child").agg(
            F.min("conv").alias("conv"), F.sum("n").alias("n"), F.first(F.col("base") + F.col("at")).alias("depth"),
            F.first(F.element_at("sizes", F.col("at"))).alias("size"), F.max(F.when(here & F.col("ends"), F.col("cid"))).alias("cid"),
            F.max(F.when(here & F.col("on"), F.col("cid"))).alias("on"),
        ).withColumn("own", F.coalesce("on", "child")).drop("on", "child"), "heads"))
        open_ = burst.where(~here).withColumn("container", F.col("child")).drop("child")
    whole = settled[0]
    for more in settled[1:]:
        whole = whole.unionByName(more)
    return whole, heads


class _Node:
    __slots__ = ("conv", "n", "size", "children", "leaves", "saved", "cid", "own", "waiting")

    def __init__(self, size):
        self.conv, self.n, self.size, self.children, self.leaves, self.saved = None, 0, size, 0, 0, 0
        self.cid, self.own, self.waiting = None, None, []


_SWEPT = pa.schema([
    ("container", pa.string()), ("top", pa.bool_()), ("own", pa.string()), ("cid", pa.string()), ("conv", pa.int64()), ("depth", pa.int64()),
    ("parent", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
])
_SWEPT_DDL = (
    "container string, top boolean, own string, cid string, conv long, depth long, parent long, n long, size long, "
    "children long, leaves long, saved long"
)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of containers whose sequences come in order; a parent is written before its children."""
    out: list[tuple] = []
    stack: list[_Node] = []
    container, before, above = None, [], 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if not node.children and node.own is None:
                node.leaves = 1
            node.saved += (node.n - 1) * node.size
            at = above + len(stack) + 1
            for child in node.waiting:
                out.append((*child[:6], node.conv, *child[6:]))
            row = (container, not stack, node.own, node.cid, node.conv, at, node.n, node.size, node.children, node.leaves, node.saved)
            if stack:
                parent = stack[-1]
                parent.waiting.append(row)
                parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)
                parent.n += node.n
                parent.children += 1
                parent.leaves += node.leaves
                parent.saved += node.saved
            else:
                out.append((*row[:6], None, *row[6:]))

    def batch_of() -> pa.RecordBatch:
        columns = zip(*out) if out else [[] for _ in _SWEPT]
        found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SWEPT)], schema=_SWEPT)
        out.clear()
        return found

    names = ("container", "seq", "sizes", "base", "at", "cid", "conv", "n", "ends", "on", "more_leaves", "more_saved")
    for batch in batches:
        for now, seq, sizes, base, at, cid, conv, n, ends, on, leaves, saved in zip(*[batch.column(c).to_pylist() for c in names]):
            if now != container:
                close(0)
                container, before = now, []
            above = base + at
            own = [seq[k : k + _ID] for k in range(at * _ID, len(seq), _ID)]
            same = 0
            while same < min(len(own), len(before)) and own[same] == before[same]:
                same += 1
            close(same)
            stack.extend(_Node(size) for size in sizes[at + same :])
            end, before = stack[-1], own
            end.n += n
            end.conv = conv if end.conv is None else min(end.conv, conv)
            end.cid, end.own = cid if ends else None, cid if on else None
            end.leaves += leaves
            end.saved += saved
        yield batch_of()
    close(0)
    yield batch_of()


def _sweep(sequences: DataFrame) -> DataFrame:
    rows = sequences.repartition("container").sortWithinPartitions("container", "seq")
    return kept(rows.mapInArrow(_swept, _SWEPT_DDL), "swept")


def _subtree_sums(containers: DataFrame) -> DataFrame:
    """(own, leaves, saved) summed over all containers below, from (own, up, leaves, saved).

    Each round a container passes its sum to the ancestor it points to, and then points twice as far.
    """
    state = kept(containers, "containers")
    while not state.where("up IS NOT NULL").isEmpty():
        given = state.where("up IS NOT NULL").groupBy(F.col("up").alias("own")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        next_up = state.select(F.col("own").alias("up"), F.col("up").alias("up_up"))
        moved = left_join_skewed(state, next_up, ["up"]).join(given, "own", "left")
        added = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0))).alias(c)
        state = kept(moved.select("own", F.col("up_up").alias("up"), added("leaves", "l"), added("saved", "s")), "containers")
    return state.select("own", "leaves", "saved")


# --- the trie -----------------------------------------------------------------------------------


def trie(rows: DataFrame, conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row per node of the trie of some sequences of turns.

    ``rows`` is (conv_id, pos, id, size, length), pos from 1 without gaps; ``conversations`` is
    (conv_id, length) of all sequences, empty ones too. conv_id is the smallest member of a node and
    with depth names it; saved_tokens sums (n_convs - 1) * size over the subtree; ends_sha256 is the
    digest of the ids of the sequences that end here. Without conversations there is no node.
    """
    segments = kept(_segments(rows), "segments")
    sequences = kept(segments.groupBy("container", "seq").agg(
        F.first("base").alias("base"), F.first("sizes").alias("sizes"), F.first("cid").alias("cid"), F.min("conv_id").alias("conv"),
        F.count(F.lit(1)).alias("n"), F.max("last").alias("ends"), F.max(~F.col("last")).alias("on"),
    ), "sequences")
    ending = segments.where("last").select(F.col("cid").alias("key"), "conv_id")
    digests = id_digests(ending.unionByName(conversations.where("length = 0").select(F.lit(ROOT).alias("key"), "conv_id")))
    settled, rounds = _burst(sequences, container)
    settled = settled.withColumns({"more_leaves": F.lit(0).cast("bigint"), "more_saved": F.lit(0).cast("bigint")})
    swept = _sweep(settled)

    root = conversations.agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit(None).cast("string").alias("up"), "conv", "n", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("size"),
        F.lit(ROOT).alias("cid"), F.lit(ROOT).alias("own"),
    )
    heads = root
    for made in rounds:
        heads = heads.unionByName(made)
    heads = kept(heads, "heads")

    # containers: those of heads, and those behind the end of a segment
    top = swept.where("top")
    goes_on = swept.where("own IS NOT NULL").select("own", F.col("container").alias("up"), F.lit(0).cast("bigint").alias("saved"))
    owners = heads.select("own", "up", ((F.col("n") - 1) * F.col("size")).alias("saved")).unionByName(goes_on)
    below = top.select("container", "leaves", "saved").unionByName(
        heads.where("up IS NOT NULL").select(F.col("up").alias("container"), F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved"))
    )
    below = kept(below.groupBy(F.col("container").alias("own")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("own_leaves"), F.sum("saved").alias("own_saved")), "below")
    leaf = F.when(F.col("children").isNull(), 1).otherwise(F.col("own_leaves")).cast("bigint")
    sums = _subtree_sums(owners.join(below, "own", "left").select(
        "own", "up", leaf.alias("leaves"), (F.col("saved") + F.coalesce("own_saved", F.lit(0))).alias("saved")))

    if not goes_on.isEmpty():
        # nodes before the end of a segment also have what lies behind it
        behind = sums.select(F.col("own").alias("cid"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
        ended = settled.where("on").join(behind, "cid").withColumns({"more_leaves": F.col("l"), "more_saved": F.col("s")}).drop("l", "s")
        swept = _sweep(settled.where("NOT on").unionByName(ended))
        top = swept.where("top")

    above = heads.select(F.col("own").alias("container"), F.col("conv").alias("parent")).unionByName(
        swept.where("own IS NOT NULL").select(F.col("own").alias("container"), F.col("conv").alias("parent")))
    columns = ["conv", "depth", "parent", "n", "children", "leaves", "saved", "cid"]
    counts = below.select("own", F.col("children").alias("behind"))
    inner = swept.where("own IS NULL")
    ended = swept.where("own IS NOT NULL").join(counts, "own").withColumn("children", F.col("behind"))
    nodes = inner.where("NOT top").select(*columns)
    tops = inner.where("top").select("container", *columns).unionByName(ended.where("top").select("container", *columns)).drop("parent")
    nodes = nodes.unionByName(ended.where("NOT top").select(*columns)).unionByName(left_join_skewed(tops, above, ["container"]).select(*columns))
    tall = heads.join(sums, "own").join(counts, "own", "left").withColumns({"children": F.coalesce("behind", F.lit(0)), "container": F.col("up")})
    nodes = nodes.unionByName(left_join_skewed(tall, above, ["container"]).select(*columns))
    nodes = kept(nodes, "nodes")
    final = nodes.where("cid IS NOT NULL").join(digests, "cid", "left").unionByName(
        nodes.where("cid IS NULL").withColumn("ends_sha256", F.lit(None).cast("string")))
    return final.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def shared_prefixes(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuilt(conversations), container)
