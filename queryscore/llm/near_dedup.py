"""Near-duplicates by ProbMinHash.

A text is the multiset of its five-word shingles, each weighted by how often it occurs. Every shingle
sends a Poisson process of arrivals whose rate is its weight, each to a random register; a
register keeps its first arrival. Two texts agree in a register with the probability Jaccard
similarity of their weights. Arrivals are drawn in order of time up to a horizon and drawing ends
early, once every register of the text is taken; later arrivals cannot change it.

Runs of registers form bands; a text that repeats shingles has a second set of bands from weights of
1, so that pairs that only reach the plain Jaccard similarity meet as well. Texts that share a band are
candidates; a candidate pair is a link when its similarity, computed from the shingles themselves, is
at least ``SIMILARITY``. Classes are the connected components of the links between all candidates.

Pairs inside a class cannot change it and are not all formed. At first every text is compared with one
leader, the text of its buckets that has most bucket-mates, which joins most of them. Then all pairs that share a bucket and still lie in two classes are compared, in
blocks: the texts of a bucket's largest class are held against the others, and a task counts the
common shingles of all pairs of a block at once. It returns links, one for each two classes of a
block; pairs that are no links never become rows.

Texts are told apart by 64 bits of their weighted shingles: of N different texts about N^2 / 4e19 pairs
are taken for copies by mistake, one at 6e9 texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscore.llm.graph import components
from queryscore.llm.scratch import Tables, kept
from queryscore.llm.tokens import Words, chunks, mix, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
#: Texts, and bytes of text, of either side of a block.
BLOCK_TEXTS, BLOCK_BYTES = 1024, 16 << 20
#: Common shingles that a task counts at a time.
STEP = 4 << 20
#: Arrivals up to the first horizon, per register; a text that has an empty register goes on.
HORIZON = np.log(REGISTERS) + 1.5


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1], from the upper 53 bits."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight), each shingle once per document.

    A text of fewer words than a shingle has is one shingle; a text without words has none.
    """
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    grams, at = words.grams(SHINGLE)
    owner = doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        own = [words.hashes[words.offsets[d] : words.offsets[d + 1]] for d in short]
        whole = [mix(np.array([len(h), *h.tolist()], np.uint64) * np.arange(1, 2 * len(h) + 2, 2, dtype=np.uint64)).sum() for h in own]
        grams, owner = np.append(grams, np.array(whole, np.uint64)), np.append(owner, short)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], grams[first], np.diff(np.append(first, len(order)))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """The shingle in each register of each document; documents without shingles have zeros."""
    total = np.bincount(doc, weight, n_docs)
    times = np.full(n_docs * REGISTERS, np.inf)
    names = np.zeros(n_docs * REGISTERS, np.uint64)
    state = mix(shingle ^ np.uint64(0x5851F42D4C957F2D))
    clock = -np.log(_uniform(state)) / weight
    with np.errstate(divide="ignore"):
        until = REGISTERS * HORIZON / total
    live = np.arange(len(doc))
    open_ = total > 0
    registers = np.uint64(REGISTERS)
    while len(live):
        # one entry per shingle whose next arrival lies before the horizon of its document
        active = live[clock[live] <= until[doc[live]]]
        at, bits, owner, scale = clock[active], state[active], doc[active], 1 / weight[active]
        base, limit = owner * REGISTERS, until[owner]
        while len(active):
            bits = mix(bits + np.uint64(1))
            slot = base + (bits % registers).astype(np.int64)
            np.minimum.at(times, slot, at)
            first = times[slot] == at
            names[slot[first]] = shingle[active[first]]
            at = at - np.log(_uniform(bits)) * scale
            on = at <= limit
            out = ~on
            clock[active[out]], state[active[out]] = at[out], bits[out]
            active, at, bits, base, limit, scale = (x[on] for x in (active, at, bits, base, limit, scale))
        open_ &= ~np.isfinite(times.reshape(n_docs, REGISTERS)).all(axis=1)
        until = np.where(open_, until * 1.5, until)
        live = live[open_[doc[live]]]
    return names.reshape(n_docs, REGISTERS)


def bands(names: np.ndarray) -> np.ndarray:
    """One key per band; keys of different bands differ."""
    odd = np.arange(1, 2 * ROWS, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    runs = (mix(names.reshape(len(names), BANDS, ROWS)) * odd).sum(axis=2, dtype=np.uint64)
    return mix(runs + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def probability_jaccard(a, b, i: np.ndarray, j: np.ndarray) -> float:
    """sum over common x of 1 / sum_y max(a_y / a_x, b_y / b_x); only the ratio of a_x to b_x matters in the inner sum."""
    only_a = a[1].sum() - a[1][i].sum()
    only_b = b[1].sum() - b[1][j].sum()
    ca, cb = a[1][i].astype(float), b[1][j].astype(float)
    # max(ca_y / ca_x, cb_y / cb_x) is the first when ca_y / cb_y >= ca_x / cb_x
    ratio = ca / cb
    order = np.argsort(ratio, kind="stable")
    r, sa, sb = ratio[order], np.cumsum(ca[order][::-1])[::-1], np.cumsum(cb[order])
    at = np.searchsorted(r, ratio, "left")
    from_a = sa[at] + only_a
    from_b = np.where(at > 0, sb[np.maximum(at, 1) - 1], 0.0) + only_b
    return float((1 / (from_a / ca + from_b / cb)).sum())


def _fingerprints(doc, shingle, weight, n_docs) -> np.ndarray:
    """64 bits of each multiset; equal texts, and texts with the same shingles, are one node."""
    out = np.zeros(n_docs, np.uint64)
    np.add.at(out, doc, mix(shingle + weight.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return mix(out + np.bincount(doc, minlength=n_docs).astype(np.uint64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, behind, data, bounds in chunks(batch.column("text")):
            doc, shingle, weight = shingles(words_of(data, bounds))
            n = behind - first
            keys = bands(signatures(doc, shingle, weight, n))
            # without repetition the bands of both weightings are the same
            repeats = np.bincount(doc, weight > 1, n) > 0
            own = repeats[doc]
            place = np.cumsum(repeats) - 1
            plain = np.zeros_like(keys)
            plain[repeats] = bands(signatures(place[doc[own]], shingle[own], np.ones(own.sum(), np.int64), int(repeats.sum())))
            there = np.repeat(np.column_stack([np.ones(n, bool), repeats]), BANDS, axis=1)
            ends = np.append(0, np.cumsum(there.sum(axis=1)))
            values = np.concatenate([keys, plain], axis=1)[there].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            node = pa.array(_fingerprints(doc, shingle, weight, n).view(np.int64))
            own = batch.slice(first, n).select(["doc_id", "digest"]).columns
            empty = pa.array(np.bincount(doc, minlength=n) == 0)
            yield pa.RecordBatch.from_arrays([*own, node, lists, empty], names=["doc_id", "digest", "node", "bands", "empty"])


class _Sets:
    """The weighted shingles of some texts, with an index by shingle."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.parts = parts
        self.sizes = np.array([len(shingle) for shingle, _ in parts])
        self.repeats = np.array([bool((weight > 1).any()) for _, weight in parts])
        self.shingle = np.concatenate([shingle for shingle, _ in parts])
        self.share = np.concatenate([weight / weight.sum() for _, weight in parts])
        self.owner = np.repeat(np.arange(len(parts)), self.sizes)

    def index(self) -> None:
        order = np.argsort(self.shingle, kind="stable")
        self.keys, self.owners, self.shares = self.shingle[order], self.owner[order], self.share[order]

    def similar_to(self, hubs: _Sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(own, hub) numbers of all pairs that reach ``SIMILARITY`` by plain or by probability Jaccard."""
        low, high = np.searchsorted(hubs.keys, self.shingle, "left"), np.searchsorted(hubs.keys, self.shingle, "right")
        many = high - low
        ends = np.cumsum(self.sizes)
        work = np.cumsum(np.append(0, many))[np.append(0, ends)]
        n, first = len(hubs.parts), 0
        while first < len(self.parts):
            behind = int(np.searchsorted(work, work[first] + STEP, "right")) - 1
            behind = min(max(behind, first + 1), first + max(STEP // n, 1), len(self.parts))
            cut = slice(ends[first] - self.sizes[first], ends[behind - 1])
            count = many[cut]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[cut], count)
            cell = np.repeat(self.owner[cut] - first, count) * n + hubs.owners[at]
            shape = (behind - first, n)
            common = np.bincount(cell, minlength=shape[0] * n).reshape(shape)
            union = self.sizes[first:behind, None] + hubs.sizes[None, :] - common
            yes = common / union >= SIMILARITY
            weighted = self.repeats[first:behind, None] | hubs.repeats[None, :]
            if weighted.any():
                # a pair's probability Jaccard is at most the share of either text that is common
                mine = np.bincount(cell, np.repeat(self.share[cut], count), shape[0] * n).reshape(shape)
                theirs = np.bincount(cell, hubs.shares[at], shape[0] * n).reshape(shape)
                maybe = weighted & ~yes & (np.minimum(mine, theirs) >= SIMILARITY - 1e-9)
                for x, y in zip(*np.nonzero(maybe)):
                    a, b = self.parts[first + x], hubs.parts[y]
                    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
                    yes[x, y] = probability_jaccard(a, b, i, j) >= SIMILARITY
            x, y = np.nonzero(yes)
            yield x + first, y
            first = behind


def _sets_of(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for first, behind, data, bounds in chunks(texts):
        doc, shingle, weight = shingles(words_of(data, bounds))
        cuts = np.searchsorted(doc, np.arange(behind - first + 1))
        out += [(shingle[x:y], weight[x:y]) for x, y in zip(cuts, cuts[1:])]
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of blocks: rows come by block, its hubs before its spokes; only the hubs of one block are held."""
    block, parts, nodes, roots, hubs, seen = None, [], [], [], None, set()
    for batch in batches:
        found: list[tuple[int, int]] = []
        column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "spoke", "node", "root")}
        start = 0
        while start < batch.num_rows:
            now, spoke = column["block"][start], column["spoke"][start]
            alike = (column["block"][start:] == now) & (column["spoke"][start:] == spoke)
            behind = start + (len(alike) if alike.all() else int(np.argmin(alike)))
            behind = min(behind, start + 256)
            if now != block:
                block, parts, nodes, roots, hubs, seen = now, [], [], [], None, set()
            own = _sets_of(batch.column("text").slice(start, behind - start))
            own_nodes, own_roots = column["node"][start:behind], column["root"][start:behind]
            if not spoke:
                parts += own
                nodes += own_nodes.tolist()
                roots += own_roots.tolist()
            elif parts:
                if hubs is None:
                    hubs = _Sets(parts)
                    hubs.index()
                for x, y in _Sets(own).similar_to(hubs):
                    for i, j in zip(x.tolist(), y.tolist()):
                        pair = (own_roots[i], roots[j]) if own_roots[i] < roots[j] else (roots[j], own_roots[i])
                        if pair[0] != pair[1] and pair not in seen:
                            seen.add(pair)
                            found.append((own_nodes[i], nodes[j]))
            start = behind
        a, b = zip(*found) if found else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, bands, empty) of every row; digest tells rows of one id apart."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    return kept(rows.mapInArrow(_signed, "doc_id long, digest long, node long, bands array<long>, empty boolean"), "signatures")


def links(docs: DataFrame, signs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(a, b) of verified links between different nodes, and (node, root) of the nodes that share a bucket."""
    member = signs.where("NOT empty").select("node", F.explode("bands").alias("band")).distinct()
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = tables.keep(member.join(shared, "band"), "members")
    # a text that shares bands with many others, such as an original with its copies, leads
    crowd = tables.keep(members.groupBy("node").agg(F.sum("size").alias("crowd")), "crowds")
    # one row of each node that may have a link stands for its text
    row = F.min(F.struct("doc_id", "digest")).alias("row")
    speakers = signs.join(crowd.select("node"), "node", "left_semi").groupBy("node").agg(row).select(
        "node", F.col("row.doc_id").alias("_id"), F.col("row.digest").alias("_digest")
    )
    texts = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(speakers, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    texts = tables.keep(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    size = texts.select("node", F.octet_length("text").cast("bigint").alias("bytes"))
    roots = tables.keep(crowd.join(size, "node").select("node", F.col("node").alias("root"), "crowd", "bytes"), "roots")

    def compare(hubs: DataFrame, spokes: DataFrame) -> DataFrame:
        """(a, b) of links between hubs and spokes, both (home, node, root, bytes), that have the same home."""
        def parts(side: DataFrame, name: str) -> DataFrame:
            n = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("bytes") / BLOCK_BYTES))
            return side.groupBy("home").agg(F.greatest(n, F.lit(1)).alias(name))

        plan = tables.keep(parts(hubs, "hub_parts").join(parts(spokes, "spoke_parts"), "home"), "plan")
        blocks = plan.agg(F.sum(F.col("hub_parts") * F.col("spoke_parts"))).first()[0] or 0

        def dealt(side: DataFrame, spoke: bool) -> DataFrame:
            own, other = ("spoke_parts", "hub_parts") if spoke else ("hub_parts", "spoke_parts")
            part = F.pmod(F.xxhash64("node", F.lit(spoke)), own)
            each = side.join(plan, "home").select("home", "node", "root", part.alias("_own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias("_other"))
            place = ("_other", "_own") if spoke else ("_own", "_other")
            return each.select(F.xxhash64("home", *place).alias("block"), F.lit(spoke).alias("spoke"), "node", "root")

        rows = dealt(hubs, False).unionByName(dealt(spokes, True)).join(texts, "node")
        # few bytes may be much work: the number of tasks follows the blocks
        tasks = max(1, min(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        rows = rows.repartition(tasks, "block").sortWithinPartitions("block", "spoke")
        found = tables.keep(rows.mapInArrow(_compared, "a long, b long"), "links")
        tables.free(plan)
        return found

    def led() -> DataFrame:
        """(spoke, hub) of texts and the leader, of one of their buckets, that they share most bands with."""
        ranked = members.join(roots, "node")
        leads = ranked.groupBy("band").agg(F.min_by("node", F.struct(-F.col("crowd"), "node")).alias("leader"))
        found = members.join(leads, "band").where("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("bands"))
        best = found.groupBy("node").agg(F.max_by("leader", F.struct("bands", "leader")).alias("hub"))
        return tables.keep(best.select(F.col("node").alias("spoke"), "hub"), "led")

    def merged(links: DataFrame) -> DataFrame:
        side = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
        edges = links.join(side("a"), "a").join(side("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        low = components(edges).select(F.col("node").alias("root"), F.col("root").alias("_low"))
        new = tables.keep(roots.join(low, "root", "left").select("node", F.coalesce("_low", "root").alias("root"), "crowd", "bytes"), "roots")
        tables.free(roots)
        return new

    pairs = led()
    own = roots.select("node", "root", "bytes")
    found = compare(
        pairs.select(F.col("hub").alias("home"), F.col("hub").alias("node")).distinct().join(own, "node"),
        pairs.select(F.col("hub").alias("home"), F.col("spoke").alias("node")).join(own, "node"),
    )
    tables.free(pairs)
    if not found.isEmpty():
        roots = merged(found)

    each = members.join(roots, "node").groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = each.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("home"), F.min("root").alias("_least"), F.max("root").alias("_most"))
    mixed = mixed.where("_least < _most").select("band", "home")
    # pairs that share a bucket share its home, and one of them at least is outside the home's class
    open_ = members.join(roots, "node").join(mixed, "band").select("home", "node", "root", "bytes").distinct()
    open_ = tables.keep(open_, "open")
    if not open_.isEmpty():
        last = compare(open_.where("root <> home"), open_)
        if not last.isEmpty():
            roots = merged(last)
            found = found.unionByName(last)
    return found, roots.select("node", "root")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, class_id, class_digest, copies, links) of every row of ``docs``.

    class_id is the smallest doc_id of the class (nulls are smallest) and class_digest tells the
    row that stands for the class; copies counts the rows with the same shingles, links the links of
    its text that joined classes. Texts without words are copies of each other, a
    null text among them. Rows that are equal are copies.
    """
    tables = Tables(docs.sparkSession)
    signs = signed(docs)
    found, roots = links(docs, signs, tables)
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    nodes = signs.groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.join(roots, "node", "left").join(degree, "node", "left").select(
        "node", "first", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")
    )
    nodes = tables.keep(nodes, "nodes")
    heads = nodes.groupBy("root").agg(F.min("first").alias("head"))
    headed = kept(nodes.join(heads, "root").select("node", "head", "copies", "links"), "heads")
    tables.free()
    return signs.select("doc_id", "digest", "node").join(headed, "node").select(
        "doc_id", "digest", F.col("head.doc_id").alias("class_id"), F.col("head.digest").alias("class_digest"), "copies", "links"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class: of the smallest doc_id; of equal rows one."""
    heads = classes(docs).select(
        F.col("class_id").alias("_id"), F.col("class_digest").alias("_digest")
    ).distinct()
    digest = F.xxhash64("text")
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_own"), digest.alias("_own_digest"))
    first = packed.join(heads, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_digest") == F.col("_digest")))
    once = first.dropDuplicates(["_own", "_own_digest"])
    return once.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
