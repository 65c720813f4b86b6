"""Merkle manifest of a dataset, by supersteps of messages between tree vertices.

A tree node of ``span`` consecutive nodes is one vertex: ``height`` levels of runs of ``fan_in``.
In an upward superstep children message their digest to their parent; a parent that has heard all
its children hashes its levels and is itself a child of the next step.  When all groups are
complete, their roots are the leaves of one more tree, whose top is the root of the manifest.
Reverse supersteps carry the path of siblings, the group's root and the root down to the leaves,
which verify themselves: each leaf folds a digest with its siblings and compares with the root.

Messages are keyed by (group, number of the parent), so no key has more than ``span`` of them,
however many rows a group has.  Vertices of each superstep are files in the shared folder; a lost
executor costs a re-read.  Only counts of partitions (one row each) pass the driver.

The place of a leaf in its group needs no global order in one task: rows are range-partitioned by
group and order, counted by partition, and the counts are summed up.

Defined results: a null value is `-` in a leaf, others their number of UTF-8 bytes, `:`, and the
value.  Groups ascend bytewise, null first; a null group is a group of its own.  Rows of equal order
value follow one another by their leaf, so repeated rows need no rule; a null order value comes
first.  A group of one leaf has that leaf as its root, and one group alone is the manifest.  No
siblings at all give the hash of nothing.  An empty table gives an empty table.  Texts of any length
are hashed whole.  Columns that are not named take no part and may have any name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Group number of the tree over the groups' roots.
TOP = -1


def leaf_digest(columns: Iterable[Column]) -> Column:
    """Lowercase hex SHA-256 of the values, each with its length so that no two rows read alike."""
    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[told(x) for x in columns]).cast("binary"), 256)


def joined_hash(digests: Iterable[bytes]) -> bytes:
    """The hash of digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def one_level(nodes: list[bytes], fan_in: int) -> list[bytes]:
    return [joined_hash(nodes[i : i + fan_in]) for i in range(0, len(nodes), fan_in)]


def levels_of(count: int, fan_in: int) -> int:
    """Levels until one of ``count`` nodes remains."""
    n = 0
    while count > 1:
        count, n = -(-count // fan_in), n + 1
    return n


class Shape:
    """How the tree is cut: runs of ``fan_in``, ``height`` levels to a vertex."""

    def __init__(self, fan_in: int = 2, height: int = 8):
        self.fan_in, self.height, self.span = fan_in, height, fan_in**height

    def steps(self, count: int) -> int:
        """Supersteps of a tree of ``count`` leaves."""
        return -(-levels_of(count, self.fan_in) // self.height)

    def levels(self, count: int) -> int:
        """Levels that a vertex does where ``count`` nodes are left in the tree."""
        return min(self.height, levels_of(count, self.fan_in))

    def children(self, count: int, block: int) -> int:
        return min(self.span, count - block * self.span)

    def top(self, children: list[bytes], count: int) -> bytes:
        for _ in range(self.levels(count)):
            children = one_level(children, self.fan_in)
        return children[0]

    def paths(self, children: list[bytes], count: int) -> list[bytes]:
        """For each child the digests of its siblings within the vertex, bottom up, left to right."""
        out, nodes = [[] for _ in children], children
        k = self.fan_in
        for level in range(self.levels(count)):
            for i in range(len(children)):
                at = i // k**level
                first = at - at % k
                out[i] += [d for j, d in enumerate(nodes[first : first + k], first) if j != at]
            nodes = one_level(nodes, k)
        return [b"".join(x) for x in out]

    def fold(self, digest: bytes, path: bytes, place: int, count: int) -> tuple[bytes, bytes]:
        """The root that follows from a digest at ``place`` of ``count``, and what is left of the path."""
        k, used = self.fan_in, 0
        while count > 1:
            first = place - place % k
            others = min(k, count - first) - 1
            run = [path[used + 32 * j : used + 32 * (j + 1)] for j in range(others)]
            used += 32 * others
            run.insert(place - first, digest)
            digest, place, count = joined_hash(run), place // k, -(-count // k)
        return digest, path[used:]


def _placed(leaves: DataFrame) -> tuple[DataFrame, int]:
    """``leaves`` (lead, named, order and more) with group number g, place i, leaves m of the group; and the number of groups.

    A group's rows are consecutive in range-partitioned rows; what the partitions before and after
    hold of a partition's first and last group follows from one row a partition.
    """
    spark = leaves.sparkSession
    rows = leaves.repartitionByRange("named", "lead", "order", "leaf", "row").sortWithinPartitions("named", "lead", "order", "leaf", "row")
    at = F.monotonically_increasing_id()  # the partition's number in the upper bits, then the place in it
    rows = stored(rows.withColumn("part", F.spark_partition_id()).withColumn("pos", at.bitwiseAND(F.lit((1 << 33) - 1))), "sorted")
    segments = stored(rows.groupBy("part", "named", "lead").agg(F.min("pos").alias("pos"), F.count("*").alias("n")), "segments")
    ends = F.struct("pos", "named", "lead", "n")
    parts = segments.groupBy("part").agg(F.min(ends).alias("first"), F.max(ends).alias("last"), F.count("*").alias("segments"))
    known = sorted(parts.collect())  # one row a partition
    carried, groups, last, run = [], 0, None, 0
    for p in known:  # forward: groups so far and rows of the group that goes on
        key = (p["first"]["named"], p["first"]["lead"])
        goes_on = key == last
        before = run if goes_on else 0
        number = groups - 1 if goes_on else groups
        carried.append([p["part"], number, before, 0])
        groups = number + p["segments"]
        last = (p["last"]["named"], p["last"]["lead"])
        run = p["last"]["n"] + (before if p["segments"] == 1 else 0)
    after, behind = None, 0
    for p, c in zip(reversed(known), reversed(carried)):  # backward: rows of the last group that follow
        key = (p["last"]["named"], p["last"]["lead"])
        c[3] = behind if key == after else 0
        after = (p["first"]["named"], p["first"]["lead"])
        behind = p["first"]["n"] + (c[3] if p["segments"] == 1 else 0)
    facts = spark.createDataFrame(carried, "part int, number long, before long, behind long")
    nth = F.row_number().over(_by_part("pos")) - 1
    final = F.row_number().over(_by_part("pos", False)) == 1
    before = F.when(F.col("nth") == 0, F.col("before")).otherwise(0)
    segments = (
        segments.withColumn("nth", nth)
        .withColumn("final", final)
        .join(F.broadcast(facts), "part")
        .select(
            "part",
            "named",
            "lead",
            (F.col("number") + F.col("nth")).alias("g"),
            (before - F.col("pos")).alias("shift"),
            (F.col("n") + before + F.when(F.col("final"), F.col("behind")).otherwise(0)).alias("m"),
        )
    )
    out = rows.join(segments, ["part", "named", "lead"]).withColumn("i", F.col("pos") + F.col("shift"))
    return out.drop("part", "pos", "shift", "named", "lead", "row"), groups


def _by_part(order: str, ascending: bool = True):
    from pyspark.sql import Window

    return Window.partitionBy("part").orderBy(F.col(order).asc() if ascending else F.col(order).desc())


class Tree:
    """Supersteps over the vertices of all groups; their states lie in the shared folder."""

    def __init__(self, spark: SparkSession, shape: Shape):
        self.spark, self.shape = spark, shape
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.states: list[RDD] = []

    def saved(self, rdd: RDD, label: str) -> RDD:
        path = f"{shared_dir(self.spark)}/tables/{label}-{uuid.uuid4().hex}"
        rdd.saveAsPickleFile(path, 512)
        return self.spark.sparkContext.pickleFile(path, 1)

    def climbed(self, nodes: RDD, most: int) -> RDD:
        """The roots (g, leaves of g, digest) of nodes (g, leaves, nodes left, i, digest), step by step upward."""
        shape, roots = self.shape, []
        span = shape.span

        def told(node):  # a child's message to its parent
            g, leaves, left, i, digest = node
            return (g, i // span), (leaves, left, i % span, digest)

        def heard(vertex):
            (g, block), messages = vertex
            children = sorted(messages, key=lambda x: x[2])
            leaves, left = children[0][:2]
            if [x[2] for x in children] != list(range(shape.children(left, block))):
                raise ValueError(f"node {block} of group {g} has not heard of all its children")
            return g, leaves, left, block, b"".join(x[3] for x in children)

        def forwarded(vertex):
            g, leaves, left, block, digests = vertex
            digest = shape.top([digests[x : x + 32] for x in range(0, len(digests), 32)], left)
            return g, leaves, -(-left // span) if left > span else 1, block, digest

        self.states = []
        for _ in range(shape.steps(most)):
            roots.append(nodes.filter(lambda x: x[2] == 1).map(lambda x: (x[0], x[1], x[4])))
            alive = nodes.filter(lambda x: x[2] > 1)
            state = self.saved(alive.map(told).groupByKey(self.parts).map(heard), "vertices")
            self.states.append(state)
            nodes = state.map(forwarded)
        roots.append(nodes.map(lambda x: (x[0], x[1], x[4])))
        return self.spark.sparkContext.union(roots)

    def lowered(self, entries: RDD, down_to: int) -> RDD:
        """Messages ((g, i), (path, facts)) to the nodes of step ``down_to``, from entries (g, leaves, path, facts) at the groups' tops."""
        shape = self.shape

        def enters(step):
            return lambda x: max(0, shape.steps(x[1]) - 1) == step

        def told(vertex):
            (g, block), (states, messages) = vertex
            for left, digests in states:
                children = [digests[x : x + 32] for x in range(0, len(digests), 32)]
                for path, facts in messages:
                    for j, inner in enumerate(shape.paths(children, left)):
                        yield (g, block * shape.span + j), (inner + path, facts)

        messages = None
        for step in range(len(self.states) - 1, down_to - 1, -1):
            entered = entries.filter(enters(step)).map(lambda x: ((x[0], 0), (x[2], x[3])))
            messages = entered if messages is None else messages.union(entered)
            state = self.states[step].map(lambda x: ((x[0], x[3]), (x[2], x[4])))
            messages = self.saved(state.cogroup(messages, self.parts).flatMap(told), "paths")
        if down_to:  # the step below it reads leaves, and groups of that step enter there
            entered = entries.filter(enters(down_to - 1)).map(lambda x: ((x[0], 0), (x[2], x[3])))
            messages = entered if messages is None else messages.union(entered)
        return messages if messages is not None else self.spark.sparkContext.emptyRDD()


def verified_manifest(
    table: DataFrame,
    columns: Iterable[str] = COLUMNS,
    group: str = "lang",
    order: str = "doc_id",
    claimed: Column | None = None,
    fan_in: int = 2,
    height: int = 8,
) -> DataFrame:
    """Leaf, roots, sibling hash and verification of each row.

    ``claimed`` is a digest that someone holds out for the row (by default its leaf): it is folded
    with the siblings of the manifest, and ``verified`` tells whether that gives its root.
    """
    spark, shape = table.sparkSession, Shape(fan_in, height)
    digest = leaf_digest([F.col(f"`{c}`") for c in columns])
    leaf = F.unhex(digest)
    leaves = stored(
        table.select(
            F.col(group).isNotNull().alias("named"),
            F.coalesce(F.col(group).cast("string"), F.lit("")).alias("lead"),
            F.col(order).alias("order"),
            leaf.alias("leaf"),
            (leaf if claimed is None else F.unhex(claimed)).alias("claimed"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    result = T.StructType([T.StructField(order, table.schema[order].dataType)])
    for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        result.add(name, T.StringType())
    result.add("verified", T.BooleanType())
    placed, groups = _placed(leaves)
    if not groups:
        return spark.createDataFrame([], result)
    placed = stored(placed.select("g", "m", "i", "order", "leaf", F.when(F.col("claimed") != F.col("leaf"), F.col("claimed")).alias("claimed")), "placed")
    most = placed.agg(F.max("m")).first()[0]
    base = placed.rdd.map(lambda r: (r["g"], r["m"], r["m"], r["i"], bytes(r["leaf"])))
    inner, outer = Tree(spark, shape), Tree(spark, shape)
    subroots = inner.saved(inner.climbed(base, most), "subroots")
    top = outer.climbed(subroots.map(lambda x: (TOP, groups, groups, x[0], x[2])), groups)
    root = outer.saved(top, "root")
    # Downward: the root, then through the tree of groups, then through each group to its leaves.
    crowned = outer.lowered(root.map(lambda x: (TOP, x[1], b"", x[2])), 0) if groups > 1 else root.map(lambda x: ((TOP, 0), (b"", x[2])))
    entries = subroots.map(lambda x: (x[0], (x[1], x[2]))).join(crowned.map(lambda x: (x[0][1], x[1])), inner.parts)
    entries = inner.saved(entries.map(lambda x: (x[0], x[1][0][0], x[1][1][0], (x[1][0][1], x[1][1][1]))), "entries")
    messages = inner.lowered(entries, 1)
    span = shape.span

    def asked(r):
        return (r["g"], r["i"] // span), (r["i"], r["m"], r["order"], bytes(r["leaf"]), r["claimed"] and bytes(r["claimed"]))

    def settled(vertex) -> Iterator[tuple]:
        (g, _), (rows, heard) = vertex
        rows = sorted(rows, key=lambda x: x[0])
        for above, (subroot, root_) in heard:
            children = [x[3] for x in rows]
            for (i, m, key, own, other), path in zip(rows, shape.paths(children, rows[0][1])):
                path += above
                part, rest = shape.fold(other or own, path, i, m)
                folded, _ = shape.fold(part, rest, g, groups)
                proof = joined_hash(path[x : x + 32] for x in range(0, len(path), 32))
                yield key, own.hex(), subroot.hex(), root_.hex(), proof.hex(), folded.hex(), folded == root_

    final = placed.rdd.map(asked).cogroup(messages, inner.parts).flatMap(settled)
    return spark.createDataFrame(final, result, verifySchema=False)


def tampered(n_chars: str = "n_chars", modulus: int = 7, columns: Iterable[str] = COLUMNS) -> Column:
    """The leaf of rows whose ``n_chars`` grew by one where ``modulus`` divides the id's hash; nulls stay."""
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == 0
    grown = F.when(hit, F.col(n_chars) + 1).otherwise(F.col(n_chars))
    return leaf_digest([grown if c == n_chars else F.col(f"`{c}`") for c in columns])


def sql(levels: int = 24, group_levels: int = 8, modulus: int = 7) -> str:
    """The rows of ``op12_merkle_manifest`` in SQL, one level after the other (runs of two).

    Trees of up to 2**levels leaves a group and 2**group_levels groups.
    """

    def told(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(told(n_chars if c == "n_chars" else c) for c in COLUMNS) + ")"

    # CRC-32, one step a bit: each byte enters with the first of its eight.
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(c, e) & 1 = 1 THEN xor(xor(c, e) >> 1, 3988292384) ELSE xor(c, e) >> 1 END"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, e: {step}), 4294967295)"
    out = [
        f"""w AS MATERIALIZED (SELECT doc_id, lang, {leaf("n_chars")} AS leaf,
          CASE WHEN {crc} % {modulus} = 0 THEN {leaf("n_chars + 1")} ELSE {leaf("n_chars")} END AS claimed FROM documents)""",
        """l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
          count(*) OVER (PARTITION BY lang) AS m, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM w)""",
        "n0 AS MATERIALIZED (SELECT g, i, m, leaf AS d FROM l)",
    ]

    def tree(name: str, depth: int) -> None:
        for k in range(depth):
            out.append(
                f"""{name}{k + 1} AS MATERIALIZED (SELECT g, i // 2 AS i, (m + 1) // 2 AS m,
                CASE WHEN m > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d FROM {name}{k} GROUP BY g, i // 2, m)"""
            )

    def walk(name: str, rows: str, nodes: str, depth: int, g: str, i: str, m: str) -> None:
        """Siblings and folded digest of each row, level by level."""
        last = f"{name}0"
        out.append(f"{last} AS (SELECT *, {m} AS left_ FROM {rows})")
        for k in range(depth):
            at = f"((p.{i} >> {k}) % 2)"
            f = f"""CASE WHEN left_ = 1 THEN f WHEN n.d IS NULL THEN sha256(f) WHEN {at} = 0 THEN sha256(f || n.d) ELSE sha256(n.d || f) END"""
            out.append(
                f"""{name}{k + 1} AS MATERIALIZED (SELECT p.* REPLACE ({f} AS f, (left_ + 1) // 2 AS left_, proof || coalesce(n.d, '') AS proof)
                FROM {last} p LEFT JOIN {nodes}{k} n ON n.g = {g} AND left_ > 1 AND n.i = xor(p.{i} >> {k}, CAST(1 AS BIGINT)))"""
            )
            last = f"{name}{k + 1}"

    tree("n", levels)
    out.append(f"t0 AS MATERIALIZED (SELECT 0 AS g, g AS i, count(*) OVER () AS m, d FROM n{levels})")
    tree("t", group_levels)
    out.append("q AS (SELECT l.doc_id, l.leaf, l.g, l.i, l.m, l.claimed AS f, '' AS proof, (SELECT count(*) FROM t0) AS many FROM l)")
    walk("p", "q", "n", levels, "p.g", "i", "m")
    out.append(f"u AS (SELECT * EXCLUDE (left_) FROM p{levels})")
    walk("r", "u", "t", group_levels, "0", "g", "many")
    return (
        "WITH "
        + ",\n".join(out)
        + f""" SELECT doc_id, leaf, n{levels}.d AS subroot, t{group_levels}.d AS root, sha256(proof) AS proof_sha256, f AS folded_root,
        f = t{group_levels}.d AS verified FROM r{group_levels} r JOIN n{levels} USING (g) CROSS JOIN t{group_levels}"""
    )
