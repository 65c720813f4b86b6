"""Packing of whole documents into token windows by order-preserving dynamic programming.

Documents keep the order of their table.  Every scan partition is one stream of tokens;
windows are cut at document or sentence ends so that padding plus penalties for cuts
inside a document are least.  With S the running token count, the cheapest way to end a
window at cut j is ``min(dp[i] + S[i]) + capacity - S[j] + penalty[j]`` over the cuts i
with ``S[j] - S[i] <= capacity``: a sliding-window minimum, kept by a monotone queue in
time linear in the number of cuts.

The stream is solved in blocks of bounded size; the last window of a block is carried
into the next.  The one open window that each partition ends with is packed again with
those of its neighbours, so padding does not depend on the number of partitions.

Defined results: a null text is empty and has the end token only; repeated rows and
repeated ids are packed as rows of their own; ties between equally good cuts go to the
earliest; an empty table has no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text

END_ID = 2
#: Tokens of a stretch without a sentence end that may be cut; cuts come this far apart.
STRETCH = 128
DOCUMENT_CUT, SENTENCE_CUT, FORCED_CUT = 0, 24, 96
#: Tokens that are solved at once, and words whose ids a task remembers.
BLOCK_TOKENS = 1 << 19
REMEMBERED = 800_000
#: Partitions whose open windows are packed together.
NEIGHBOURS = 16


#: A word of plain or Western accented letters, then ASCII punctuation: two pre-tokens of
#: the tokenizer, whose letters only have to be lower-cased.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> str:
    """The printable character that byte-level pre-tokenizers write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in shown else chr(next(spare)) for b in range(256))


def little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokenizer:
    """Token ids of a text, each word of it (between ASCII white space) tokenized once.

    It suits byte-level tokenizers that lower-case, drop white space, split letters from
    punctuation and let no token cross those bounds.  For every word it remembers the
    ids as little-endian 32-bit integers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, number in vocabulary.items():
            self.closing[number] = piece.removesuffix("</w>")[-1:] in (".", "!", "?")
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _stem(self, stem: str) -> bytes:
        ids = self.stems.get(stem)
        if ids is None:
            shown = stem.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = little_endian([t.id for t in self.model.tokenize(shown)])
            if len(self.stems) >= REMEMBERED:
                self.stems.clear()
            self.stems[stem] = ids
        return ids

    def _whole(self, word: str) -> bytes:
        return little_endian(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        plain = PLAIN.fullmatch(text)
        if plain is None:
            return self._whole(text)
        stem, tail = plain.groups()
        ids = self._stem(stem.lower())
        if tail:
            key = tail.encode()
            more = self.known.get(key)
            if more is None:
                more = self.known[key] = self._whole(tail)
            ids += more
        return ids

    def learn(self, words: list[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = self._word(w)

    def encode(self, text: str) -> bytes:
        words = text.encode("utf-8", "surrogatepass").split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(words)
            return b"".join(map(self.known.__getitem__, words))

    def sentence_ends(self, ids: bytes) -> np.ndarray:
        """The numbers of tokens after which a sentence ends."""
        return np.nonzero(self.closing[np.frombuffer(ids, "<u4")])[0] + 1


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, so its memory serves all tasks there."""
    return WordTokenizer(path)


def cuts_of(n_tokens: int, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in a document of ``n_tokens`` (with the end token) and penalties."""
    ends = np.unique(np.concatenate([sentence_ends[sentence_ends < n_tokens], [n_tokens]]))
    ends = ends[ends > 0]
    gaps = np.diff(np.concatenate([[0], ends]))
    where, cost = [ends], [np.where(ends == n_tokens, DOCUMENT_CUT, SENTENCE_CUT)]
    for k in np.nonzero(gaps > STRETCH)[0]:
        forced = np.arange(ends[k] - gaps[k] + STRETCH, ends[k], STRETCH)
        where.append(forced)
        cost.append(np.full(len(forced), FORCED_CUT))
    at, price = np.concatenate(where), np.concatenate(cost)
    order = np.argsort(at, kind="stable")
    return at[order], price[order]


def choose_windows(ends: np.ndarray, penalty: np.ndarray, capacity: int) -> list[int]:
    """Indexes of the chosen cuts, the last one included.

    ``ends`` are increasing running token counts at which a window may end; no step is
    above ``capacity``.  The last cut is free of a penalty.
    """
    total = [0, *ends.tolist()]
    price = [0, *penalty.tolist()]
    best = [0] * len(total)
    came = [0] * len(total)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (dp[i] + S[i], i), increasing
    for j in range(1, len(total)):
        least = total[j] - capacity
        while total[queue[0][1]] < least:
            queue.popleft()
        value, i = queue[0]
        came[j] = i
        cost = value + capacity + price[j]  # dp[j] + S[j]
        best[j] = cost - total[j]
        while queue and queue[-1][0] > cost:
            queue.pop()
        queue.append((cost, j))
    chosen, j = [], len(total) - 1
    while j:
        chosen.append(j - 1)
        j = came[j]
    return chosen[::-1]


class _Packer:
    """Packs one stream; gives rows of pieces, and keeps the open window at the end."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next_id = capacity, base
        self.docs: deque[list] = deque()  # [doc_id, start, ids, doc_tokens, cuts, penalties]
        self.held = 0

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int, cuts: np.ndarray, price: np.ndarray) -> None:
        self.docs.append([doc_id, start, ids, doc_tokens, cuts, price])
        self.held += len(ids) // 4

    def solve(self, last: bool) -> Iterator[tuple[list, list[tuple]]]:
        """Windows as lists of (doc, from, to); without ``last``, all but the open one."""
        if not self.docs:
            return
        bases = np.cumsum([0, *(len(d[2]) // 4 for d in self.docs)])
        ends = np.concatenate([d[4] + b for d, b in zip(self.docs, bases)])
        price = np.concatenate([d[5] for d in self.docs])
        chosen = choose_windows(ends, price, self.capacity)
        if not last:
            chosen = chosen[:-1]
        begin, k = 0, 0
        for c in chosen:
            end, window = int(ends[c]), []
            while begin < end:
                upto = min(end, int(bases[k + 1]))
                window.append((self.docs[k], begin - int(bases[k]), upto - int(bases[k])))
                begin = upto
                if upto == bases[k + 1]:
                    k += 1
            yield window
        # What is left starts at the last chosen cut.
        for _ in range(k):
            self.docs.popleft()
        if self.docs and (skip := begin - int(bases[k])):
            d = self.docs[0]
            stay = d[4] > skip
            self.docs[0] = [d[0], d[1] + skip, d[2][4 * skip :], d[3], d[4][stay] - skip, d[5][stay]]
        self.held = int(bases[-1]) - begin


PIECE = pa.schema(
    [
        ("doc_id", pa.string()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("open_in", pa.int64()),
        ("ids", pa.binary()),
        ("cuts", pa.binary()),
    ]
)
PIECE_DDL = (
    "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "open_in long, ids binary, cuts binary"
)


class _Rows:
    """Gathers pieces into record batches."""

    def __init__(self):
        self.rows: list[tuple] = []

    def window(self, sequence_id: int, window: list[tuple], open_in: int | None = None) -> None:
        offset = 0
        for doc, a, b in window:
            ids = doc[2][4 * a : 4 * b]
            kept = None
            if open_in is not None:
                inner = (doc[4] > a) & (doc[4] <= b)
                kept = np.stack([doc[4][inner] - a, doc[5][inner]]).astype("<i8").tobytes()
            self.rows.append(
                (
                    doc[0],
                    doc[1] + a,
                    b - a,
                    zlib.crc32(ids),
                    doc[3],
                    sequence_id,
                    offset,
                    open_in,
                    ids if open_in is not None else None,
                    kept,
                )
            )
            offset += b - a

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[] for _ in PIECE]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE)], schema=PIECE)


def _first_pass(path: str, capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokenizer(path)
        part = TaskContext.get().partitionId()
        packer, out, number = _Packer(capacity, 0), _Rows(), part << 36
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = coder.encode(text.as_py())
                ends = coder.sentence_ends(ids)
                ids += END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                packer.add(doc_id.as_py(), 0, ids, n, *cuts_of(n, ends))
                if packer.held >= BLOCK_TOKENS:
                    for window in packer.solve(last=False):
                        out.window(number, window)
                        number += 1
                    yield out.batch()
        windows = list(packer.solve(last=True))
        for window in windows[:-1]:
            out.window(number, window)
            number += 1
        for window in windows[-1:]:
            out.window(number, window, open_in=part)
        yield out.batch()

    return pack


def _second_pass(capacity: int):
    def pack(key, table):
        packer, out = _Packer(capacity, 0), _Rows()
        rows = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        for r in rows:
            at, price = np.frombuffer(r["cuts"], "<i8").reshape(2, -1)
            if not len(at) or at[-1] != r["length"]:
                at, price = np.append(at, r["length"]), np.append(price, FORCED_CUT)
            packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"], at, price)
        number = rows[0]["sequence_id"]
        for window in packer.solve(last=True):
            out.window(number, window)
            number += 1
        return pa.Table.from_batches([out.batch()])

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """One row for each piece of a document that lies in one window.

    doc_id, start (the document's tokens before the piece), length, ids_crc32 (of its
    ids as little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset
    (in the window, without gaps from 0).
    """
    # Ids of any type travel as text.
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text().alias("text"))
    pieces = stored(texts.mapInArrow(_first_pass(tokenizer_path, capacity), PIECE_DDL), "pieces")
    shown = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    closed = pieces.where("open_in is null").select(*shown)
    opened = pieces.where("open_in is not null")
    again = opened.groupBy((F.col("open_in") / NEIGHBOURS).cast("long").alias("near")).applyInArrow(
        _second_pass(capacity), PIECE_DDL
    )
    rows = closed.unionByName(again.select(*shown))
    return rows.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))
