"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

One scan of the texts gives each row's length in bytes and the hash of its prefix, a slim table.
Lengths that only one row has are settled, then prefixes that only one row of a length has.  The
rest is told apart by the SHA-256 of its whole text in a second scan.  Which rows that concerns is
asked of a bit set of the surviving keys, whose size is a parameter and does not follow the data:
when it fills up, more rows are hashed than need be, and the result is the same.

Defined results: a null text is the empty text.  Of equal texts the row with the largest doc_id
stays; null is smaller than any id.  Rows that share the id as well are told apart by their other
columns, and of fully equal rows exactly one stays.  Texts of any length are hashed whole.  An
empty table gives an empty table.  Other columns play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, row_columns, stored, whole_text

#: Characters of a text that its prefix hash covers.
PREFIX = 256
#: Bits of the set of surviving keys: at most 2**18 broadcast rows of 64 bits each.
BITS = 1 << 24
#: A group with at least this share of all rows is joined by broadcast; there can be no more than its inverse.
HEAVY = 1000


def _same(text: Column) -> Column:
    return text


def _bits(keys: DataFrame, bits: int) -> DataFrame:
    """The set of hashed ``key``s as words of 64 bits: at most ``bits``/64 rows, whatever the table holds."""
    at = F.pmod("key", F.lit(bits))
    word = F.shiftrightunsigned(at, 6)
    one = F.expr(f"shiftleft(1L, CAST(pmod(key, {bits}) % 64 AS INT))")
    return keys.groupBy(word.alias("__word")).agg(F.bit_or(one).alias("__mask"))


def _marked(rows: DataFrame, key: Column, words: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` with a flag that is false only where ``key`` is surely not in the set."""
    at = F.pmod(key, F.lit(bits))
    asked = rows.withColumn("__word", F.shiftrightunsigned(at, 6)).withColumn("__bit", (at % 64).cast("int"))
    met = asked.join(F.broadcast(words), "__word", "left")
    hit = F.expr("(shiftrightunsigned(coalesce(__mask, 0L), __bit) & 1L) = 1L")
    return met.withColumn(name, hit).drop("__word", "__mask", "__bit")


def _repeated(slim: DataFrame, *by: str) -> DataFrame:
    """Hashed keys that at least two rows have; counts are added up before they travel."""
    return slim.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64(*by).alias("key"))


def refined(docs: DataFrame, normalise: Callable[[Column], Column] = _same, prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """``docs`` as ``row`` with its ``text`` (normalised) and ``open``: whether only the full hash can settle it."""
    text = normalise(whole_text())
    length, head = F.octet_length("text"), F.xxhash64(F.substring("text", 1, prefix))
    rows = docs.select(as_row(docs).alias("row"), text.alias("text"))
    slim = stored(rows.select(length.cast("long").alias("length"), head.alias("head")), "prefixes")
    by_length = _marked(slim, F.xxhash64("length"), _bits(_repeated(slim, "length"), bits), bits, "open")
    words = stored(_bits(_repeated(by_length.where("open"), "length", "head"), bits), "repeated")
    return _marked(rows, F.xxhash64(length.cast("long"), head), words, bits, "open")


def exact_groups(
    docs: DataFrame,
    normalise: Callable[[Column], Column] = _same,
    digest_all: bool = False,
    prefix: int = PREFIX,
    bits: int = BITS,
) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept and text_sha256.

    Rows that length and prefix settle need no full hash and have none, unless ``digest_all``.
    """
    full = F.sha2(F.col("text").cast("binary"), 256)
    rows = refined(docs, normalise, prefix, bits).select(
        F.col("row.doc_id").alias("doc_id"),
        F.monotonically_increasing_id().alias("place"),
        "open",
        (full if digest_all else F.when(F.col("open"), full)).alias("text_sha256"),
    )
    rows = stored(rows, "hashed")
    total = rows.count()
    best = F.max(F.struct("doc_id", "place"))
    groups = rows.where("open").groupBy("text_sha256").agg(F.count("*").alias("group_size"), best.alias("best"))
    groups = stored(groups.where("group_size > 1"), "groups")
    heavy = F.broadcast(groups.where(F.col("group_size") * HEAVY >= total))  # at most HEAVY rows
    light = groups.where(F.col("group_size") * HEAVY < total)
    met = rows.where("open").join(heavy, "text_sha256")
    # No key of what is left has more than one HEAVYth of all rows.
    rest = rows.where("open").join(heavy.select("text_sha256"), "text_sha256", "left_anti").join(light, "text_sha256", "left")
    alone = rows.where("not open").withColumn("group_size", F.lit(None).cast("long")).withColumn("best", F.lit(None).cast(groups.schema["best"].dataType))
    every = met.unionByName(rest).unionByName(alone)
    single = F.col("group_size").isNull()
    return every.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("place") == F.col("best.place"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, normalise: Callable[[Column], Column] = _same, prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns.

    Only rows that length and prefix leave open are shuffled, and equal ones meet before they travel.
    """
    rows = refined(docs, normalise, prefix, bits)
    order = F.struct(F.col("row.doc_id"), F.sha2(F.col("row").cast("string"), 256))
    full = F.sha2(F.col("text").cast("binary"), 256)
    first = rows.where("open").groupBy(full.alias("full")).agg(F.max_by("row", order).alias("row")).select("row")
    return rows.where("not open").select("row").unionByName(first).select(*row_columns(docs))


#: The same rows as ``op11_exact_dedup`` in SQL.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
