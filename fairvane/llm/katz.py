"""Katz backoff language model over words, trained and evaluated in blocks.

Tokens are words (ASCII letters lower-cased) and one end token a text; before a text stand
begin marks.  The counts of n-grams up to ``order`` words get Good-Turing discounts; the
mass they free goes to unseen words by a backoff weight that is exactly normalised for
each history h (h' is h without its first word):

    P(w | h) = d(c(h,w)) c(h,w) / c(h)               if c(h,w) > 0
             = alpha(h) P(w | h')                    else, if h was seen
             = P(w | h')                             else
    alpha(h) = (1 - sum of seen P(. | h)) / (1 - sum of P(. | h') over words seen after h)
    P(w)     = d(c(w)) c(w) / N, and what that leaves for one unknown word

The work is dealt out in blocks and buckets.  Documents form blocks of tokens; each block
sends its distinct n-grams, as sorted 64-bit hashes with their training counts, to buckets
of the hash range.  The buckets are the partitioned count tables: each sums its n-grams
over all blocks and sends every block the totals of the n-grams it asked for, naming one
block as the owner of each.  The blocks evaluate their tokens; owners add their n-grams to
the sums of those histories that some held-out text has, and every block asks, again by
bucket, for the backoff weights of the histories its unseen events need.  So a history
that a third of all texts share costs one row for each block, in both rounds.

Discounts use the count-of-count table of all n-grams; counts over ``CUTOFF`` lose only
``RESERVE`` of a count, so every history keeps some mass for unseen words.

Defined results: a null or empty text is one end token; repeated rows are trained on and
scored each; ids may be of any type; a row without an id counts as training text; without
training text every token is unknown; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, stored, whole_text

END = np.uint64(xxhash.xxh64_intdigest(b"</s>", 99))
BEGIN = np.uint64(xxhash.xxh64_intdigest(b"<s>", 99))
#: Tokens in a block, the unit of work whose arrays a task holds at once.
BLOCK_TOKENS = 1 << 19
#: N-grams that one bucket of the count tables is asked for, about.
BUCKET_GRAMS = 3_000_000
CUTOFF = 5
RESERVE = 1e-3


def tokens(text: str) -> np.ndarray:
    """Hashes of the words, then the end token's."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hash of (history, word) from their hashes."""
    x = (v * np.uint64(0x9E3779B97F4A7C15)) ^ ((w << np.uint64(31)) | (w >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack(values: np.ndarray, sorted_keys: bool = False) -> bytes:
    """Compressed bytes of an integer array; sorted ones as differences."""
    if sorted_keys:
        values = np.diff(values, prepend=np.zeros(1, values.dtype))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind, sorted_keys: bool = False) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(kind.itemsize, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if sorted_keys else values


_BLOCK_DDL = "block long, doc_ids array<{}>, train binary, lengths binary, words binary, places binary, n_tokens long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ids: list = []
    train: list[bool] = []
    texts: list[np.ndarray] = []
    held, kind = 0, None

    def block() -> pa.RecordBatch:
        words, places = np.unique(np.concatenate(texts), return_inverse=True)
        order = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")  # frequent words first
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        row = [
            [(part << 16) + number],
            [ids],
            [np.array(train, np.uint8).tobytes()],
            [np.array([len(t) for t in texts], np.int32).tobytes()],
            [words[order].tobytes()],
            [pack(rank[places])],
            [len(places)],
        ]
        kinds = [pa.int64(), pa.list_(kind), *[pa.binary()] * 4, pa.int64()]
        names = [x.split()[0] for x in _BLOCK_DDL.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=names)

    for batch in batches:
        kind = batch.column("doc_id").type
        for doc_id, held_out, text in zip(*(batch.column(c) for c in ("doc_id", "held_out", "text"))):
            ids.append(doc_id.as_py())
            train.append(not held_out.as_py())
            texts.append(tokens(text.as_py()))
            held += len(texts[-1])
            if held >= BLOCK_TOKENS:
                yield block()
                number += 1
                ids, train, texts, held = [], [], [], 0
    if ids:
        yield block()


class Block:
    """A block's tokens, with its distinct n-grams of each order, sorted by their hashes.

    ``keys[k]`` are the hashes of the n-grams of k words, ``at[k]`` the place in them of the
    one that ends at each token, ``history[k]`` that of the one before it, ``count[k]`` how
    often each occurs in training texts, and ``asked[k]`` whether a held-out token follows it.
    """

    def __init__(self, row: dict, order: int):
        self.number, self.doc_ids = row["block"], row["doc_ids"]
        lengths = np.frombuffer(row["lengths"], np.int32)
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.n_docs = len(lengths)
        train_docs = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.train = train_docs[self.doc]
        words = np.frombuffer(row["words"], np.uint64)[unpack(row["places"], np.int32)]
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.keys, self.at, self.history, self.count, self.asked = {}, {}, {}, {}, {}
        grams, begin = words, BEGIN
        for k in range(1, order + 1):
            keys, at = np.unique(np.append(grams, begin), return_inverse=True)
            mark, at = at[-1], at[:-1].astype(np.int32)
            self.keys[k], self.at[k] = keys, at
            self.count[k] = np.bincount(at[self.train], minlength=len(keys))
            self.count[k][mark] = train_docs.sum()
            before = np.empty(len(at), np.int32)
            before[1:] = at[:-1]
            before[firsts] = mark
            self.history[k] = before
            self.asked[k] = np.zeros(len(keys), bool)
            if k < order:
                self.asked[k][before[~self.train]] = True
                grams, begin = pair_hash(keys[before], words), pair_hash(begin[None], BEGIN[None])[0]


def begin_marks(order: int) -> dict[int, np.uint64]:
    """The hash of k begin marks, for each k."""
    out = {1: BEGIN}
    for k in range(2, order + 1):
        out[k] = pair_hash(out[k - 1][None], BEGIN[None])[0]
    return out


def _bucket_bounds(buckets: int) -> np.ndarray:
    return np.array([(1 << 64) * i // buckets for i in range(1, buckets)], np.uint64)


def _slices(keys: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, place of its keys) of the sorted ``keys``."""
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    for k in np.nonzero(np.diff(cuts))[0].tolist():
        yield k, slice(int(cuts[k]), int(cuts[k + 1]))


def _questions(buckets: int, order: int):
    """Each block's distinct n-grams and their counts, cut into buckets of the hash range."""
    bounds = _bucket_bounds(buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch.slice(i, 1).to_pylist()[0], order)
                for k in range(1, order + 1):
                    out = [
                        (
                            bucket, b.number, k, pack(b.keys[k][s], True), pack(b.count[k][s].astype(np.uint32)),
                            np.packbits(b.asked[k][s]).tobytes(),
                        )
                        for bucket, s in _slices(b.keys[k], bounds)
                    ]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                        names=["bucket", "block", "gram", "keys", "counts", "asked"],
                    )

    return ask


_ANSWER_DDL = (
    "block long, gram int, bucket long, totals binary, owned binary, asked binary, total long, kinds long, few array<long>"
)


def _answer(order: int):
    """Sum the n-grams of one length in a bucket; answer each block; report counts of counts."""
    begin = begin_marks(order)

    def answer(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        gram, bucket = rows[0]["gram"], rows[0]["bucket"]
        keys = [unpack(r["keys"], np.uint64, True) for r in rows]
        sizes = [len(k) for k in keys]
        counts = np.concatenate([unpack(r["counts"], np.uint32) for r in rows])
        asked = np.concatenate([np.unpackbits(np.frombuffer(r["asked"], np.uint8), count=n) for r, n in zip(rows, sizes)])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        total = np.bincount(at, counts, len(distinct)).astype(np.int64)
        wanted = np.zeros(len(distinct), bool)
        wanted[at[asked.astype(bool)]] = True
        # The owner is the first block that has the n-gram in its training text.
        trained = np.nonzero(counts)[0]
        owner = np.full(len(distinct), -1, np.int64)
        owner[at[trained[::-1]]] = trained[::-1]
        out, start = [], 0
        for r, n in zip(rows, sizes):
            here = at[start : start + n]
            mine = owner[here] == np.arange(start, start + n)
            out.append(
                (
                    r["block"], gram, bucket, pack(total[here]), np.packbits(mine).tobytes(),
                    np.packbits(wanted[here]).tobytes(), None, None, None,
                )
            )
            start += n
        kept = total[(distinct != begin[gram]) & (total > 0)]
        few = np.bincount(np.minimum(kept, CUTOFF + 2), minlength=CUTOFF + 3)[: CUTOFF + 2].tolist()
        out.append((None, gram, bucket, None, None, None, int(kept.sum()), len(kept), few))
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = [x.split()[0] for x in _ANSWER_DDL.split(", ")]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return answer


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Discount factors d(0..CUTOFF); each is between 0 and 1.

    Katz's Good-Turing factors where the counts of counts allow them, else (r - 1/2) / r.
    """
    n = [float(x) for x in counts_of_counts]
    d = np.ones(CUTOFF + 1)
    for r in range(1, CUTOFF + 1):
        d[r] = (r - 0.5) / r
        if n[1] > 0 and n[r] > 0:
            shared = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
            if shared < 1:
                value = ((r + 1) * n[r + 1] / (n[r] * r) - shared) / (1 - shared)
                if 0 < value < 1:
                    d[r] = value
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c."""
    few = counts <= CUTOFF
    return np.where(few, d[np.where(few, counts, 0)] * counts, counts - RESERVE)


_SCORED_DDL = (
    "kind int, row long, doc_id {}, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
    "block long, gram int, bucket long, keys binary, a binary, b binary"
)


def _scored_schema(doc_id: pa.DataType) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "{}": doc_id}
    return pa.schema([(n, types[t]) for n, t in (x.split() for x in _SCORED_DDL.split(", "))])


def _table(schema: pa.Schema, n: int, **columns) -> pa.Table:
    return pa.Table.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
    )


def _evaluate(order: int, buckets: int, n: int, kinds: int, few: dict[int, list[int]]):
    """Scores of a block's tokens but for the backoff weights of unseen events.

    Gives a row for each document (kind 0), and by bucket the block's part of the sums of
    the wanted histories (1) and the histories it needs the weights of (2); last the unseen
    events by document and place among these histories (3).
    """
    factors = {k: discounts(few[k]) for k in few}
    bounds = _bucket_bounds(buckets)
    low = np.arange(CUTOFF + 1)
    n_low = np.array(few[1][: CUTOFF + 1], float)
    mass = (n_low * low * factors[1])[1:].sum() + (n - (n_low * low)[1:].sum() - RESERVE * (kinds - n_low[1:].sum()))
    unknown = max(1e-12, 1 - mass / n) if n else 1.0

    def evaluate(left, right):
        schema = _scored_schema(left.schema.field("doc_ids").type.value_type)
        (row,) = left.to_pylist()
        b = Block(row, order)
        answers = right.to_pylist()
        total, owned, wanted = {}, {}, {}
        for k in range(1, order + 1):
            mine = sorted((r for r in answers if r["gram"] == k), key=lambda r: r["bucket"])
            totals = [unpack(r["totals"], np.int64) for r in mine]
            for out, name in ((owned, "owned"), (wanted, "asked")):
                out[k] = np.concatenate([np.unpackbits(np.frombuffer(r[name], np.uint8), count=len(t)) for r, t in zip(mine, totals)]).astype(bool)
            total[k] = np.concatenate(totals)
        words = total[1][b.at[1]]
        p = np.where(words > 0, discounted(words, factors[1]) / max(n, 1), unknown)
        base = np.log10((words + 1) / (n + kinds + 1))
        tables = []
        log_p, open_events = np.log10(p), {}
        lower = p  # the discounted share of the n-gram that is one word shorter
        for k in range(2, order + 1):
            here, of_history = total[k][b.at[k]], total[k - 1][b.history[k - 1]]
            seen = here > 0
            share = np.where(seen, discounted(here, factors[k]) / np.maximum(of_history, 1), 0.0)
            log_p = np.where(seen, np.log10(np.where(seen, share, 1.0)), log_p)
            for j in open_events:
                open_events[j] &= ~seen
            open_events[k] = ~seen & (of_history > 0)
            # One token for each n-gram that this block owns and whose history is wanted.
            first = np.full(len(total[k]), -1, np.int64)
            first[b.at[k][::-1]] = np.arange(len(b.at[k]) - 1, -1, -1)
            chosen = first[np.nonzero(owned[k] & (total[k] > 0) & (first >= 0))[0]]
            chosen = chosen[wanted[k - 1][b.history[k - 1][chosen]]]
            histories, place = np.unique(b.history[k - 1][chosen], return_inverse=True)
            a = np.bincount(place, share[chosen], len(histories))
            rest = np.bincount(place, lower[chosen], len(histories))
            keys = b.keys[k - 1][histories]
            out = [(bucket, pack(keys[s], True), pack(a[s]), pack(rest[s])) for bucket, s in _slices(keys, bounds)]
            if out:
                at, packed, packed_a, packed_b = zip(*out)
                tables.append(
                    _table(
                        schema, len(out), kind=np.ones(len(out), np.int32), gram=np.full(len(out), k, np.int32),
                        bucket=at, keys=packed, a=packed_a, b=packed_b,
                    )
                )
            lower = share
        for k, open_here in open_events.items():
            at = np.nonzero(open_here)[0]
            if not len(at):
                continue
            histories, place = np.unique(b.history[k - 1][at], return_inverse=True)
            keys = b.keys[k - 1][histories]
            out = [(bucket, pack(keys[s], True)) for bucket, s in _slices(keys, bounds)]
            bucket, packed = zip(*out)
            tables.append(
                _table(
                    schema, len(out), kind=np.full(len(out), 2, np.int32), block=[b.number] * len(out),
                    gram=np.full(len(out), k, np.int32), bucket=bucket, keys=packed,
                )
            )
            tables.append(
                _table(
                    schema, 1, kind=[3], block=[b.number], gram=[k], a=[pack(b.doc[at])], b=[pack(place.astype(np.int32))]
                )
            )

        def by_doc(values):
            return np.bincount(b.doc, values, b.n_docs)

        held_out = np.zeros(b.n_docs, bool)
        held_out[b.doc[~b.train]] = True
        tables.append(
            _table(
                schema,
                b.n_docs,
                kind=np.zeros(b.n_docs, np.int32),
                row=(b.number << 22) + np.arange(b.n_docs),
                doc_id=b.doc_ids,
                held_out=held_out,
                n_tokens=np.bincount(b.doc, minlength=b.n_docs),
                n_known=by_doc((words > 0).astype(float)).astype(np.int64),
                base_score=by_doc(base),
                score=by_doc(log_p),
            )
        )
        return pa.concat_tables(tables)

    return evaluate


def _weights(table):
    """Sum the parts of a bucket's histories, and give each asking block their log10 weights."""
    rows = table.to_pylist()
    parts = [r for r in rows if r["kind"] == 1]
    asking = [r for r in rows if r["kind"] == 2]
    known = [unpack(r["keys"], np.uint64, True) for r in parts]
    keys, at = np.unique(np.concatenate(known) if known else np.zeros(0, np.uint64), return_inverse=True)

    def summed(name: str) -> np.ndarray:
        return np.bincount(at, np.concatenate([unpack(r[name], np.float64) for r in parts]), len(keys)) if parts else np.zeros(0)

    log_alpha = np.log10(np.maximum(1 - summed("a"), 1e-300) / np.maximum(1 - summed("b"), 1e-300))
    out = []
    for r in asking:
        wanted = unpack(r["keys"], np.uint64, True)
        out.append((r["block"], r["gram"], r["bucket"], pack(log_alpha[np.searchsorted(keys, wanted)])))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    columns = list(zip(*out)) or [[]] * 4
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "gram", "bucket", "weights"])


def _backed_off(left, right):
    """What the backoff weights add to each document of a block that has unseen events."""
    events, weights = left.to_pylist(), right.to_pylist()
    more: dict[int, float] = {}
    block = 0
    for e in events:
        block = e["block"]
        mine = sorted((w for w in weights if w["gram"] == e["gram"]), key=lambda w: w["bucket"])
        log_alpha = np.concatenate([unpack(w["weights"], np.float64) for w in mine])
        docs = unpack(e["a"], np.int32)
        sums = np.bincount(docs, log_alpha[unpack(e["b"], np.int32)])
        for d in np.unique(docs).tolist():
            more[d] = more.get(d, 0.0) + float(sums[d])
    return pa.table(
        {"row": pa.array([(block << 22) + d for d in more], pa.int64()), "more": pa.array(list(more.values()), pa.float64())}
    )


def score_documents(
    docs: DataFrame, modulus: int = 7, held_out_remainder: int = 2, order: int = 2, buckets: int | None = None
) -> DataFrame:
    """Train on the documents outside the held-out remainder, and score all of them.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and
    score (the log10 probability of the backoff model of ``order`` words).  ``buckets`` is
    the number of partitions of the count tables; by default it grows with the tokens, so
    that each fits a task's memory.
    """
    spark = docs.sparkSession
    fields = docs.select(
        "doc_id",
        F.coalesce(id_remainder(modulus) == held_out_remainder, F.lit(False)).alias("held_out"),
        whole_text().alias("text"),
    )
    kind = dict(docs.dtypes)["doc_id"]
    blocks = stored(fields.mapInArrow(_blocks, _BLOCK_DDL.format(kind)), "lm-blocks")
    if buckets is None:
        tokens_there = blocks.agg(F.sum("n_tokens")).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens_there * order // BUCKET_GRAMS))
    asked = blocks.mapInArrow(
        _questions(buckets, order), "bucket long, block long, gram int, keys binary, counts binary, asked binary"
    )
    answers = stored(asked.groupBy("bucket", "gram").applyInArrow(_answer(order), _ANSWER_DDL), "lm-counts")
    sums = answers.where("block is null").groupBy("gram").agg(
        F.sum("total").alias("total"),
        F.sum("kinds").alias("kinds"),
        *[F.sum(F.get("few", F.lit(r))).alias(f"n{r}") for r in range(CUTOFF + 2)],
    )
    known = {r["gram"]: r for r in sums.collect()}  # a row for each length of n-gram
    few = {k: [int(known[k][f"n{r}"] or 0) if k in known else 0 for r in range(CUTOFF + 2)] for k in range(1, order + 1)}
    n, kinds = (int(known[1][x] or 0) if 1 in known else 0 for x in ("total", "kinds"))
    scored = stored(
        blocks.groupBy("block")
        .cogroup(answers.where("block is not null").groupBy("block"))
        .applyInArrow(_evaluate(order, buckets, n, kinds, few), _SCORED_DDL.format(kind)),
        "lm-scored",
    )
    weights = (
        scored.where("kind in (1, 2)")
        .select("kind", "block", "gram", "bucket", "keys", "a", "b")
        .groupBy("bucket", "gram")
        .applyInArrow(_weights, "block long, gram int, bucket long, weights binary")
    )
    more = (
        scored.where("kind = 3")
        .select("block", "gram", "a", "b")
        .groupBy("block")
        .cogroup(weights.groupBy("block"))
        .applyInArrow(_backed_off, "row long, more double")
    )
    rows = scored.where("kind = 0").join(more, "row", "left")
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
