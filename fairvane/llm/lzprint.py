"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed unit by unit into dictionary phrases (LZ78: each new phrase is a known
one plus a unit).  Units are words; a run without white space that is longer than
``LONGEST_WORD``, or that holds a letter of a script written without spaces, gives one unit
for each of its code points.  The set of phrases is hashed into a minimum-hash signature of 64
values, 16 bits each; the share of equal values of two signatures estimates how many
phrases their texts share, much as a joint compressor would find them.

``compare_in_order`` sorts the documents by descending doc_id in range partitions, so
each task meets neighbours in turn; only the two rows at each partition bound, a count
that depends on the number of partitions alone, are brought together afterwards.

Defined results: a null text is empty; a text without units has the signature of the
empty phrase; ties of doc_id are ordered by a hash of the text; rows without an id come
last; repeated rows are kept; a single document is its own successor; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_text

VALUES = 64
LONGEST_WORD = 24
#: Scripts written without spaces: Thai, Lao, Burmese, Khmer, kana, Chinese characters.
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")


def units(words: list[str]) -> list[str]:
    """The words, with long and unspaced ones in single code points."""
    if not words or (max(map(len, words)) <= LONGEST_WORD and not UNSPACED.search("".join(words))):
        return words
    out: list[str] = []
    for w in words:
        if len(w) > LONGEST_WORD or UNSPACED.search(w):
            out += w
        else:
            out.append(w)
    return out


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets, drawn from a hash of their index."""
    draw = np.array([xxhash.xxh64_intdigest(f"lz{i}", 7) for i in range(2 * VALUES)], np.uint64)
    return draw[:VALUES] | np.uint64(1), draw[VALUES:]


FACTOR, OFFSET = _multipliers()
FOLD = np.uint64(0x9E3779B97F4A7C15)
ROOT = xxhash.xxh64_intdigest(b"", 7)


class Parse:
    """An LZ78 parse that can be carried on in several ways from a common beginning."""

    def __init__(self, words: list[str]):
        self.trie: dict[tuple[int, str], int] = {}
        self.hashes = [ROOT]
        self.node = self._walk(words, self.trie, {}, self.hashes, 0)

    @staticmethod
    def _walk(words: list[str], into: dict, before: dict, hashes: list[int], node: int) -> int:
        digest = xxhash.xxh64_intdigest
        for w in words:
            step = (node, w)
            child = into.get(step)
            if child is None:
                child = before.get(step)
            if child is None:
                into[step] = len(hashes)
                hashes.append(digest(w, hashes[node]))
                node = 0
            else:
                node = child
        return node

    def tail(self, words: list[str]) -> list[int]:
        """Hashes of the phrases that ``words`` add to this parse."""
        hashes = self.hashes.copy()
        self._walk(words, {}, self.trie, hashes, self.node)
        return hashes[len(self.hashes) :]


def least(hashes: list[int]) -> np.ndarray:
    """Minimum over phrase hashes of each of the 64 hash functions."""
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    all_of_them = np.array(hashes, np.uint64)
    for at in range(0, len(all_of_them), 8192):
        np.minimum(out, (all_of_them[at : at + 8192, None] * FACTOR + OFFSET).min(axis=0), out=out)
    return out


def folded(minima: np.ndarray) -> bytes:
    mixed = (minima ^ (minima >> np.uint64(29))) * FOLD
    return (mixed >> np.uint64(48)).astype(">u2").tobytes()


def _phrases(hashes: list[int]) -> list[int]:
    return hashes[1:] or [ROOT]


def signature(text: str) -> bytes:
    return folded(least(_phrases(Parse(units(text.split())).hashes)))


def likeness(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")).mean())


def edited_text(text: str, other: str) -> str:
    """``text`` whose last third is replaced by as many first characters of ``other``."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def both_signatures(text: str, edited: str) -> tuple[bytes, bytes]:
    """Signatures of a text and its edit; what they begin with alike is parsed once."""
    a, b = units(text.split()), units(edited.split())
    # The last word of what is kept may go on differently, so it is compared unit by unit.
    at, end = len(units(text[: len(text) - len(text) // 3].split()[:-1])), min(len(a), len(b))
    while at < end and a[at] == b[at]:
        at += 1
    common = a[:at]
    parse = Parse(common)
    start = least(parse.hashes[1:])
    out = []
    for rest in (a[len(common) :], b[len(common) :]):
        more = parse.tail(rest)
        if len(parse.hashes) == 1 and not more:
            more = [ROOT]
        out.append(folded(np.minimum(start, least(more))))
    return out[0], out[1]


def _compared(doc_id: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", doc_id), *_COMPARED])


_COMPARED = (
    [
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("print", pa.binary()),
        ("edited_print", pa.binary()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("part", pa.int64()),
        ("text", pa.string()),
        ("head_text", pa.string()),
    ]
)
_DDL = (
    "doc_id {}, n_chars long, edited_sha256 string, print binary, edited_print binary, "
    "near_edited double, near_next double, part long, text string, head_text string"
)


def _compare(doc_id, text: str, following: str, next_print: bytes | None) -> tuple:
    edited = edited_text(text, following)
    own, other = both_signatures(text, edited)
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited.encode("utf-8")).hexdigest(),
        own,
        other,
        likeness(own, other),
        None if next_print is None else likeness(own, next_print),
        None,
        None,
        None,
    )


def _batch(rows: list[tuple], doc_id: pa.DataType) -> pa.RecordBatch:
    schema = _compared(doc_id)
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row with the next; the last is left open, with the partition's first text.

    near_next of a row needs the signature of the next, so a row is given out when the
    next one has been parsed.
    """
    part = TaskContext.get().partitionId()
    head: str | None = None
    waiting: tuple | None = None  # doc_id, text
    done: list | None = None  # the row before, which lacks near_next
    kind = None
    for batch in batches:
        rows, kind = [], batch.column("doc_id").type
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            now = (doc_id.as_py(), text.as_py())
            if head is None:
                head = now[1]
            if waiting is not None:
                row = _compare(*waiting, now[1], None)
                if done is not None:
                    rows.append((*done[:6], likeness(done[3], row[3]), *done[7:]))
                done = row
            waiting = now
        yield _batch(rows, kind)
    if waiting is not None:
        last = []
        if done is not None:
            last.append((*done[:6], likeness(done[3], signature(waiting[1])), *done[7:]))
        last.append((waiting[0], None, None, None, None, None, None, part, waiting[1], head))
        yield _batch(last, kind)


def _at_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch(
            [
                _compare(doc_id, text, following, signature(following))
                for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")))
            ],
            batch.column("doc_id").type,
        )


def compare_in_order(docs: DataFrame) -> DataFrame:
    """Per document: signature, that of its edit with the next document, and likenesses.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal),
    near_edited, near_next.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", whole_text().alias("text"))
    ddl = _DDL.format(dict(docs.dtypes)["doc_id"])
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    sorted_texts = texts.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    compared = stored(sorted_texts.mapInArrow(_in_order, ddl), "lz-compared")
    inner = compared.where("part is null")
    # One row for each partition: its last document, and the first of the partition after.
    bounds = compared.where("part is not null").select("part", "doc_id", "text", "head_text")
    every = Window.orderBy("part")
    first = F.first("head_text").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = bounds.select(
        "doc_id", "text", F.coalesce(F.lead("head_text").over(every), first).alias("next_text")
    ).repartition(partitions, "doc_id")
    rows = inner.unionByName(met.mapInArrow(_at_bounds, ddl))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
