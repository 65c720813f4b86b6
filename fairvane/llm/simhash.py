"""SimHash fingerprints and near-duplicate groups by deletion-variant signatures.

A fingerprint has 64 bits.  Two fingerprints that differ in at most ``max_bits`` bits
are linked.  The fingerprint is cut into ``ceil((max_bits + 1) / 2)`` segments, so at
least one segment of a linked pair differs in at most one bit.  Every segment is
indexed once per bit position with that bit wildcarded; a linked pair then meets under
an equal key, is verified over all 64 bits, and only a spanning forest of the verified
links of a bucket leaves the task.  Links become groups by rounds of star contraction.

Defined results: a null text counts as empty; texts without words have fingerprint
zero and are linked like any other; repeated rows are kept, each with its group; rows
with a null doc_id take part with their text but lend no id, so a group that holds
only such rows has a null component_id; rows that share a doc_id but not their text are
different documents; an empty table gives an empty result; other columns of the input are
ignored (``near_duplicates``, ``near_copies``) or kept (``deduplicate``), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, row_columns, stored, whole_text

SEED = 42
#: Members of one bucket that are compared within one task; larger buckets are dealt
#: out as pairs of blocks of this size.
BLOCK = 2048


def fingerprint(text: str, width: int = 3) -> int:
    """64-bit SimHash of the ``width``-word shingles, each as often as it occurs."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        last = len(words) - width + 1
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[width - 1 :].tolist())),
            np.uint64,
            last,
        )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""
    fields = docs.select("doc_id", whole_text().alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter(
                (fingerprint(t.as_py(), width) for t in batch.column("text")), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(marks.view(np.int64))], names=["doc_id", "fp"]
            )

    kind = dict(fields.dtypes)["doc_id"]
    return fields.mapInArrow(scan, f"doc_id {kind}, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of every segment."""
    count = (max_bits + 2) // 2
    cuts = [64 * i // count for i in range(count + 1)]
    return list(zip(cuts[:-1], (b - a for a, b in zip(cuts, cuts[1:]))))


def _forest(fps: np.ndarray, nodes: np.ndarray, near, block: int = BLOCK) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that ``near`` accepts, as (smaller, larger) nodes."""
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for a in range(0, len(fps), block):
        for b in range(a, len(fps), block):
            left, right = np.nonzero(near(fps[a : a + block, None], fps[None, b : b + block]))
            for i, j in zip((left + a).tolist(), (right + b).tolist()):
                if i < j and (p := root(i)) != (q := root(j)):
                    parent[q] = p
                    edges.append((int(nodes[i]), int(nodes[j])))
    return [(min(e), max(e)) for e in edges]


def _distance_test(first: int, size: int, wild: int, max_bits: int):
    """Accepts pairs within ``max_bits`` whose segment differs at ``wild`` only, or, for
    the first wildcard, not at all: so that a pair is accepted once for each segment."""
    mask = np.uint64(((1 << size) - 1) << first)
    here = np.uint64(1 << (first + wild))

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a ^ b
        part = x & mask
        owned = (part == here) | (part == 0) if wild == 0 else part == here
        return owned & (np.bitwise_count(x) <= max_bits)

    return near


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], keys: int) -> Iterator[list[np.ndarray]]:
    """Rows in runs of equal leading ``keys`` columns, from batches sorted by them."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [np.asarray(batch.column(n).to_numpy(zero_copy_only=False)) for n in names]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        if not len(cols[0]):
            continue
        change = np.zeros(len(cols[0]), bool)
        for c in cols[:keys]:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.nonzero(change)[0]
        bounds = np.concatenate([[0], cuts, [len(cols[0])]])
        sizes = np.diff(bounds)
        for k in np.nonzero(sizes[:-1] > 1)[0]:
            yield [c[bounds[k] : bounds[k + 1]] for c in cols]
        rest = [c[bounds[-2] :] for c in cols]
    if rest is not None and len(rest[0]) > 1:
        yield rest


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def links(marks: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints differ in at most ``max_bits`` bits.

    ``marks`` has one row for each fingerprint: node, fp.  The links span the same
    groups as all verified pairs do; pairs that others connect already are left out.
    """
    segments = _segments(max_bits)
    tests = {
        (s, w): _distance_test(first, size, w, max_bits)
        for s, (first, size) in enumerate(segments)
        for w in range(size)
    }
    variants = F.array(
        *[
            F.struct(
                F.lit(64 * s + w).alias("slot"),
                F.col("fp").bitwiseAND(F.lit(_signed((((1 << size) - 1) << first) & ~(1 << (first + w))))).alias("key"),
            )
            for s, (first, size) in enumerate(segments)
            for w in range(size)
        ]
    )
    keyed = marks.select("node", "fp", F.inline(variants)).select("slot", "key", "fp", "node")
    partitions = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(partitions, "slot", "key").sortWithinPartitions("slot", "key", "node")

    def small_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of ordinary buckets; members of large ones go on as (slot, key, member)."""
        edges: list[tuple[int, int]] = []
        empty = pa.array([], pa.int64())
        for slot, key, fp, node in _runs(batches, ["slot", "key", "fp", "node"], 2):
            if len(fp) > block:
                n = len(fp)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node),
                        pa.array(fp),
                        pa.array(slot.astype(np.int32)),
                        pa.array(key),
                        pa.array((np.arange(n) // block).astype(np.int32)),
                        pa.array(np.full(n, (n + block - 1) // block, np.int32)),
                    ],
                    names=["a", "b", "slot", "key", "part", "parts"],
                )
                continue
            s, w = divmod(int(slot[0]), 64)
            edges += _forest(fp.view(np.uint64), node, tests[s, w], block)
            if len(edges) > 50_000:
                yield _with_nulls(edges)
                edges = []
        yield _with_nulls(edges)

    found = stored(
        dealt.mapInArrow(small_buckets, "a long, b long, slot int, key long, part int, parts int"), "simhash-links"
    )
    direct = found.where("slot is null").select("a", "b")
    # Buckets over the block size: every pair of blocks is a task's work of its own.
    large = found.where("slot is not null").select(
        "slot",
        "key",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"),
        "part",
        F.col("a").alias("node"),
        F.col("b").alias("fp"),
    )
    large = large.select(
        "slot", "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp", "node"
    )
    large = large.repartition(partitions, "slot", "key", "p", "q").sortWithinPartitions("slot", "key", "p", "q", "node")

    def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, _, _, _, fp, node in _runs(batches, ["slot", "key", "p", "q", "fp", "node"], 4):
            s, w = divmod(int(slot[0]), 64)
            yield _edge_batch(_forest(fp.view(np.uint64), node, tests[s, w], block))

    return direct.unionByName(large.mapInArrow(block_pairs, "a long, b long")).distinct()


def _with_nulls(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    batch = _edge_batch(edges)
    n = batch.num_rows
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), *[pa.nulls(n, k) for k in kinds]],
        names=["a", "b", "slot", "key", "part", "parts"],
    )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a < b) can reach.

    Rounds of large-star and small-star contraction; each round is a table in the
    shared folder, and only a count of changed links comes to the driver.
    """
    edges = stored(edges.select("a", "b").where("a < b").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.where("b > a").join(lowest, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = wide.select(F.col("b").alias("a"), F.col("a").alias("b"))  # a is the larger end
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        narrow = (
            down.join(least, "a")
            .select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
            .where("a < b")
            .distinct()
            .select("a", "b")
        )
        after = stored(narrow, "links")
        if _same(edges, after):
            return after.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = after


def _same(x: DataFrame, y: DataFrame) -> bool:
    digest = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    return x.agg(*digest).first() == y.agg(*digest).first()


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id reachable by links."""
    marks = stored(with_fingerprints(docs, width), "fingerprints")
    kinds = marks.groupBy("fp").agg(F.min("doc_id").alias("node"))
    groups = components(links(kinds.where("node is not null"), max_bits))
    # A fingerprint whose rows all lack an id still belongs to its own group only.
    named = kinds.join(groups, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


#: Independent samples of a text's shingles, and shingles in each.
SAMPLES, SAMPLED = 10, 3
#: Members of a bucket times those before it that each is paired with at first, at most.
BESIDE = 800
_MIX = np.array([xxhash.xxh64_intdigest(f"sample{i}", SEED) | 1 for i in range(SAMPLES)], np.uint64)


def shingles(text: str, width: int) -> np.ndarray:
    """Distinct hashes of the ``width``-word shingles; of the whole text if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = len(words) - width + 1
    pairs = zip(starts[:last].tolist(), ends[width - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, last))


def majority(hashes: np.ndarray) -> int:
    """SimHash of a few hashes: the bits that are set in over half of them."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0) > len(hashes), bitorder="little").view("<u8")[0])


def sampled_fingerprints(hashes: np.ndarray) -> list[int]:
    """A SimHash of each min-wise sample of the shingles, as signed integers."""
    out = []
    for factor in _MIX:
        mixed = hashes * factor
        mixed ^= mixed >> np.uint64(31)
        k = min(SAMPLED, len(hashes))
        chosen = np.argpartition(mixed, k - 1)[:k]
        out.append(_signed(majority(hashes[chosen])))
    return out


def _sketches(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                plain = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
                hashes = shingles(text, width)
                rows.append(
                    (
                        xxhash.xxh3_128_digest(plain),
                        _signed(fingerprint(text, width)),
                        sampled_fingerprints(hashes),
                    )
                )
            keys, fps, tables = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "of_text", "of_row")),
                    pa.array(keys, pa.binary()),
                    pa.array(fps, pa.int64()),
                    pa.array(tables, pa.list_(pa.int64())),
                ],
                names=["doc_id", "of_text", "of_row", "wording", "fp", "tables"],
            )

    return scan


def _neighbours_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each bucket, pairs of each member with the first and with those just before it.

    Small buckets give all their pairs.  Members of larger ones are sorted by another
    sample, which brings copies of one text together, and give only some pairs at first;
    they also go on as (slot, key, member), for ``_rest_of_buckets`` to try all others.
    """
    names = ["a", "b", "slot", "key"]
    for slot, key, _, node in _runs(batches, ["slot", "key", "beside", "node"], 2):
        n = len(node)
        reach = max(2, min(n - 1, BESIDE // n))
        a = [np.full(n - 1, node[0]), *(node[:-d] for d in range(1, reach + 1) if d < n)]
        b = [node[1:], *(node[d:] for d in range(1, reach + 1) if d < n)]
        left, right = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.minimum(left, right)),
                pa.array(np.maximum(left, right)),
                pa.nulls(len(left), pa.int32()),
                pa.nulls(len(left), pa.int64()),
            ],
            names=names,
        )
        if reach < n - 1:
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.nulls(n, pa.int64()), pa.array(slot.astype(np.int32)), pa.array(key)], names=names
            )


def _blocks(comp: np.ndarray, size: np.ndarray, similarity: float, rows: int, hashes: int):
    """Members of a bucket in blocks: (order, block of each in that order, pairs of blocks to compare).

    A group that would fill a block of its own has blocks of its own, the other members
    are mixed.  Each block holds at most ``rows`` members and about ``hashes`` shingles,
    and members are sorted by their number of shingles.  Pairs of blocks are left out
    only where no pair of members can matter: all belong to one group, or their numbers
    of shingles are too far apart for the similarity.
    """
    names, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
    own = np.where(counts[inverse] >= rows, inverse, -1)
    order = np.lexsort((size, own))
    block, at, filled, weight = np.zeros(len(order), np.int32), -1, 0, 0
    last = None
    for i, k in enumerate(order.tolist()):
        if own[k] != last or filled >= rows or weight + size[k] > hashes:
            at, filled, weight, last = at + 1, 0, 0, own[k]
        block[i] = at
        filled, weight = filled + 1, weight + int(size[k])
    starts = np.nonzero(np.diff(block, prepend=-1))[0]
    ends = np.append(starts[1:], len(order))
    least, most = size[order][starts], size[order][ends - 1]
    kinds = comp[order]
    low, high = np.minimum.reduceat(kinds, starts), np.maximum.reduceat(kinds, starts)
    one = low == high
    near = (similarity * least[None, :] <= most[:, None] + 1e-6) & (similarity * least[:, None] <= most[None, :] + 1e-6)
    near &= ~(one[:, None] & one[None, :] & (low[:, None] == low[None, :]))
    return order, block, near


def _mixed_links(similarity: float):
    """Links between members of different groups in each pair of blocks, from their shingle sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, p, q, part, comp, node, sets in _runs(
            batches, ["slot", "key", "p", "q", "part", "comp", "node", "sets"], 4
        ):
            same = p[0] == q[0]
            left = np.nonzero(part == p[0])[0]
            right = left if same else np.nonzero(part == q[0])[0]
            if not len(left) or not len(right):
                continue
            lengths = np.fromiter((len(x) for x in sets), np.int64, len(sets))
            known, inverse = np.unique(np.concatenate(sets[right]), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(lengths[right])[:-1]])
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.get(x, x) != x:
                    parent[x] = parent.get(parent[x], parent[x])
                    x = parent[x]
                return x

            edges = []
            for i, k in enumerate(left.tolist()):
                at = np.minimum(np.searchsorted(known, sets[k]), len(known) - 1)
                held = np.zeros(len(known), np.int64)
                held[at[known[at] == sets[k]]] = 1
                common = np.add.reduceat(held[inverse], starts)
                linked = common + 1e-9 >= similarity * (lengths[k] + lengths[right] - common)
                linked &= comp[right] != comp[k]
                if same:
                    linked[: i + 1] = False
                for j in right[linked].tolist():
                    x, y = root(int(comp[k])), root(int(comp[j]))
                    if x != y:
                        parent[y] = x
                        edges.append((int(min(node[k], node[j])), int(max(node[k], node[j]))))
            yield _edge_batch(edges)

    return compare


#: Members, and shingles, of a block of the exact comparison of large buckets.
BLOCK_ROWS, BLOCK_HASHES = 512, 200_000


def _rest_of_buckets(
    crowded: DataFrame, groups: DataFrame, docs: DataFrame, width: int, similarity: float,
    rows: int = BLOCK_ROWS, hashes: int = BLOCK_HASHES,
) -> DataFrame | None:
    """Verified links (a, b) that join groups whose members share a large bucket; None if no bucket has two groups.

    ``groups`` holds what the pairs tried so far have linked, so members of one group
    need not meet again.  All others of a bucket do, block by block, on whole shingle sets.
    """
    members = stored(
        crowded.join(groups, "node", "left").select("slot", "key", "node", F.coalesce("root", "node").alias("comp")), "crowded"
    )
    several = members.groupBy("slot", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    members = stored(members.join(several.select("slot", "key"), ["slot", "key"], "left_semi"), "crowded")
    if members.isEmpty():
        return None
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                sets = [shingles(t.as_py(), width).view(np.int64) for t in piece.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("node"),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array(sets, pa.list_(pa.int64())),
                    ],
                    names=["node", "size", "sets"],
                )

    texts = docs.select(F.xxhash64(whole_text()).alias("node"), whole_text().alias("text"))
    texts = texts.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    sets = stored(texts.mapInArrow(hashed, "node long, size long, sets array<long>"), "crowded-sets")

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, key, comp, node, size in _runs(batches, ["slot", "key", "comp", "node", "size"], 2):
            order, block, near = _blocks(comp, size, similarity, rows, hashes)
            partners = [np.nonzero(x)[0].astype(np.int32) for x in near]
            for at in range(0, len(order), 1000):
                k, b = order[at : at + 1000], block[at : at + 1000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slot[k].astype(np.int32)),
                        pa.array(key[k]),
                        pa.array(comp[k]),
                        pa.array(node[k]),
                        pa.array(b),
                        pa.array([partners[x] for x in b.tolist()], pa.list_(pa.int32())),
                    ],
                    names=["slot", "key", "comp", "node", "part", "others"],
                )

    sized = members.join(sets.select("node", "size"), "node").select("slot", "key", "comp", "node", "size")
    sized = sized.repartition(partitions, "slot", "key").sortWithinPartitions("slot", "key", "node")
    plan = stored(
        sized.mapInArrow(planned, "slot int, key long, comp long, node long, part int, others array<int>"), "crowded-plan"
    )
    pairs = plan.repartition(partitions, "node").select("slot", "key", "comp", "node", "part", F.explode("others").alias("other"))
    pairs = pairs.select(
        "slot", "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "comp", "node"
    )
    both = pairs.join(sets.select("node", "sets"), "node").select("slot", "key", "p", "q", "part", "comp", "node", "sets")
    both = both.repartition(partitions, "slot", "key", "p", "q").sortWithinPartitions("slot", "key", "p", "q", "node")
    return stored(both.mapInArrow(_mixed_links(similarity), "a long, b long"), "crowded-links")


def _similar(width: int, similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(node: int, text) -> np.ndarray:
            if node not in known:
                if len(known) > 500:
                    known.clear()
                known[node] = shingles(text.as_py(), width)
            return known[node]

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ta"), batch.column("tb")):
                x, y = of(a, ta), of(b, tb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common + 1e-9 >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_bits: int = 3) -> DataFrame:
    """doc_id, component_id (the smallest of the group) and of_row, of groups linked by Jaccard similarity.

    ``of_row`` is a hash of the row's id and text.

    A SimHash of all shingles stays within ``max_bits`` bits for close copies only; at a
    similarity of 0.8 about ten of 64 bits differ.  So besides the deletion-variant index
    of that fingerprint, SimHashes of ten min-wise samples of three shingles are indexed
    by equality: copies at 0.8 share at least one with a chance over 0.99.  Every
    candidate pair is verified on the whole shingle sets of both texts.  Pairs of a large
    bucket are tried in two rounds: first some that link most copies, then all pairs
    between the groups that are left.  Groups come from verified links only.
    """
    text = whole_text()
    fields = docs.select("doc_id", F.xxhash64(text).alias("of_text"), _of_row().alias("of_row"), text.alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    sketches = stored(fields.mapInArrow(
        _sketches(width), f"doc_id {kind}, of_text long, of_row long, wording binary, fp long, tables array<long>"
    ), "sketches")
    # One text, by its hash, stands for all that have the same words.
    texts = stored(sketches.groupBy("wording").agg(
        F.min("of_text").alias("node"), F.first("fp").alias("fp"), F.first("tables").alias("tables")
    ), "wordings")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Texts of one group of near fingerprints are a bucket: links() gives only its spanning forest.
    by_print = texts.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    near_prints = components(links(by_print.select("fp", F.col("first").alias("node")), max_bits))
    of_print = by_print.join(near_prints.withColumnRenamed("node", "first"), "first", "left").where("root is not null or n > 1")
    by_group = texts.join(of_print.select("fp", F.coalesce("root", "first").alias("key")), "fp").select(
        F.lit(SAMPLES).alias("slot"), "key", F.element_at("tables", -1).alias("beside"), "node"
    )
    keyed = texts.select(
        F.posexplode("tables").alias("slot", "key"), F.element_at("tables", -1).alias("last"), F.get("tables", F.lit(0)).alias("start"), "node"
    ).select("slot", "key", F.when(F.col("slot") == SAMPLES - 1, F.col("start")).otherwise(F.col("last")).alias("beside"), "node")
    keyed = keyed.unionByName(by_group)
    dealt = keyed.repartition(partitions, "slot", "key").sortWithinPartitions("slot", "key", "beside", "node")
    found = stored(dealt.mapInArrow(_neighbours_in_buckets, "a long, b long, slot int, key long"), "near-found")
    pairs = stored(found.where("slot is null and a < b").select("a", "b").distinct(), "near-pairs")
    crowded = found.where("slot is not null").select("slot", "key", F.col("a").alias("node"))
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # Only texts that are in a pair, one row for each text.
    wanted = docs.select(F.xxhash64(text).alias("node"), text.alias("text")).join(met, "node", "left_semi")
    wanted = stored(wanted.groupBy("node").agg(F.min("text").alias("text")), "pair-texts")
    both = (
        pairs.join(wanted.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        .join(wanted.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )
    groups = components(both.mapInArrow(_similar(width, similarity), "a long, b long"))
    more = _rest_of_buckets(crowded, groups, docs, width, similarity)
    if more is not None:
        groups = components(more.unionByName(groups.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    named = texts.join(groups, "node", "left").select("wording", F.coalesce("root", "node").alias("root"))
    found = stored(sketches.select("doc_id", "of_row", "wording").join(named, "wording").select("doc_id", "of_row", "root"), "near-groups")
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "root").select("doc_id", "component_id", "of_row", "root")


def _of_row() -> Column:
    return F.xxhash64(F.col("doc_id"), whole_text())


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest doc_id.

    Rows without an id come after those with one; of rows that share their id the one with
    the smaller hash of the text stays, and of repeated rows the one with the smallest hash
    of all columns, so the choice is the same in every run.
    """
    groups = near_copies(docs, width, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "of_row")).alias("first")
    keep = groups.groupBy("root").agg(first).select(F.col("first.of_row").alias("of_row"))
    rows = docs.select(_of_row().alias("of_row"), as_row(docs).alias("row")).join(keep, "of_row", "left_semi")
    one = rows.groupBy("of_row").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select(*row_columns(docs))
