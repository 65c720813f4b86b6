"""Personal data: generated candidate spans, judged by gradient-boosted trees.

Base patterns find e-mail addresses, IPv4 addresses, payment card numbers and phone
numbers; their matches always stay.  High-recall generators propose further, overlapping
spans: obfuscated addresses, and every run of neighbouring digit groups whose number of
digits fits a kind.  Boosted trees score each by its format and context; those over their
kind's threshold, calibrated to a precision on held-out examples, are added, best first,
where they overlap nothing chosen before.

The trees learn from base matches of the corpus, from other written forms of these (other
separators, no plus sign, a mistyped digit, "at" and "dot"), from made-up ones of the same
kinds, from parts of all these (wrong bounds), and from number-like texts that are no
personal data.  What the base patterns leave unmatched in the corpus has no label and is
not learned from.  Equal examples count once, and all distinct ones are used: the trees grow
from histograms that tasks add up (``boost``).  Held-out examples come from other documents
and equal none that was trained on.  Every document is searched over its whole text.

Defined results: a null or empty text has no spans; repeated rows are kept; spans are in
code points, end exclusive; of equally scored candidates the earlier one goes first, then
the shorter; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running
from .common import stored, whole_text

KINDS = ("email", "ip", "card", "phone")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where the run of digits starts: a start within a run that is
# not matched from its beginning doesn't match either, and matches end with their run.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches: the local part is the whole run of its characters before an @."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(_byte(p) for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [
                m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15
            ]
    return out


def _byte(part: str) -> bool:
    significant = part.lstrip("0")
    return len(significant) <= 3 and int(significant or "0") <= 255


# Generators: wide patterns whose matches may overlap.
AT_DOT = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\{at\}|\sat\s)\s?[A-Za-z0-9-]{1,63}"
    r"(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[A-Za-z0-9-]{1,63}){1,5}",
    re.IGNORECASE,
)
AT_SIGN = re.compile(r"@|[(\[{]at[)\]}]|\sat\s[^\n]{1,80}?\sdot\s", re.IGNORECASE)
GROUP = re.compile(r"[0-9]+")
#: What may stand between two digit groups of one number.
GAP = re.compile(r"[ ().\-/_:]{1,3}\Z")
#: Digit groups of one number, and digits of each kind.
MOST_GROUPS = 8
DIGITS = {"phone": (7, 15), "card": (13, 19), "ip": (4, 12)}


def candidates(text: str) -> list[tuple[int, int, str]]:
    out = []
    if AT_SIGN.search(text):
        # Only near a sign of an address: the wide pattern is costly on plain prose.
        for sign in AT_SIGN.finditer(text):
            a = max(0, sign.start() - 70)
            for m in AT_DOT.finditer(text, a, min(len(text), sign.end() + 400)):
                if m.start() <= sign.start() < m.end():
                    out.append((m.start(), m.end(), "email"))
    groups = [m.span() for m in GROUP.finditer(text)]
    joined = [bool(GAP.match(text[a[1] : b[0]])) if b[0] - a[1] <= 3 else False for a, b in zip(groups, groups[1:])]
    for i, (start, _) in enumerate(groups):
        digits = 0
        for j in range(i, min(i + MOST_GROUPS, len(groups))):
            if j > i and not joined[j - 1]:
                break
            digits += groups[j][1] - groups[j][0]
            if digits > 19:
                break
            for kind, (low, high) in DIGITS.items():
                if low <= digits <= high and (kind != "ip" or j - i == 3):
                    first = start
                    while kind == "phone" and first and text[first - 1] in "+(" and start - first < 2:
                        first -= 1
                    out.append((first, groups[j][1], kind))
    return sorted(set(out))


CONTEXT = {
    "email": ("mail", "contact", "write to", "kontakt", "courriel", "correo"),
    "ip": ("ip", "host", "server", "addr", "ping"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "master", "amex"),
    "phone": ("tel", "phone", "call", "mobil", "fax", "cell", "whatsapp"),
}
AGAINST = ("isbn", "version", "page", "order", "figure", "$", "eur", "year", "art.", "vol", "no.", "id", "build", "serial")


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g]
    before = text[max(0, start - 24) : start].lower()
    left, right = text[max(0, start - 3) : start], text[end : end + 3]
    shares = np.bincount(np.frombuffer(digits.encode(), np.uint8) - 48, minlength=10) if digits else np.zeros(10)
    p = shares[shares > 0] / max(1, len(digits))
    return [
        *(float(kind == k) for k in KINDS),
        float(len(span)),
        float(len(digits)),
        float(sum(c.isalpha() for c in span)),
        float(span.count(" ")),
        float(span.count("-")),
        float(span.count(".")),
        float(span.count("/") + span.count(":") + span.count("_")),
        float("(" in span or ")" in span) + float(span.count("(") != span.count(")")),
        float(span.startswith("+")),
        float(digits.startswith("00")) + float(digits.startswith("0")),
        float("@" in span or "(at)" in span.lower() or "[at]" in span.lower()),
        float(len(groups)),
        float(groups[0] if groups else 0),
        float(groups[-1] if groups else 0),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(bool(digits) and luhn(digits)),
        float(len(groups) == 4 and all(_byte(g) for g in re.split(r"[^0-9]+", span.strip("+( )")) if g)),
        float(digits[:2] in ("19", "20") and (groups[0] == 4 if groups else False)),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        float(left[-1:].isalnum() or left[-1:] in ("_", "/", "=", "$")) if left else 0.0,
        float(right[:1].isalnum() or right[:1] in ("_", "/", "%")) if right else 0.0,
        float(any("0" <= c <= "9" for c in left) and " " not in left[-1:] or left[-1:] in tuple("+.-(")),
        float(any("0" <= c <= "9" for c in left)),
        float(any("0" <= c <= "9" for c in right)),
        float(any(w in before for w in CONTEXT[kind])),
        float(any(w in before for w in AGAINST)),
    ]


def written_otherwise(span: str, kind: str) -> list[str]:
    """Other written forms of a base match."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == "email":
        name, _, host = span.partition("@")
        return [f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name}(at){host}", f"{name} at {host.replace('.', ' dot ')}"]
    if kind == "ip":
        return [span.replace(".", "-"), span.replace(".", " . ")]
    if kind == "card":
        # One digit mistyped, so that the checksum fails; in one piece or in fours.
        at = int(digits[-3:]) % (len(digits) - 1)
        typo = digits[:at] + str((int(digits[at]) + 1 + int(digits[-1]) % 8) % 10) + digits[at + 1 :]
        fours = [typo[i : i + 4] for i in range(0, len(typo), 4)]
        return [typo, " ".join(fours), "-".join(fours), ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    country, rest = (digits[:1], digits[1:]) if digits[:1] == "1" else (digits[:2], digits[2:])
    a, b, c = rest[:3], rest[3:6], rest[6:]
    return [
        f"00{country} {a[:2]} {a[2:]}{b}{c}",
        f"00{country}-{a}-{b}{c}",
        f"0{a[:2]}-{a[2:]}{b}{c}",
        f"0{a[:2]}-{a[2:]}{b}{c}"[:11],
        f"0{a} {b}{c}",
        f"({a}) {b}-{c}",
        f"{a}-{b}-{c}",
        f"{a}.{b}.{c}",
        f"{a} {b} {c}",
        f"{country}-{a}-{b}-{c}",
    ]


_AROUND = "the and see then of in to for on la de und que est pour con er sie is was".split()
_NAMES = "jane.doe maria lee_99 o.brien info sales+eu k.meier anna.smith88 j-p.roux ana_lopez".split()
_HOSTS = "example.com mail.example.org acme.co.uk uni-bonn.de correo.es lab.example.net".split()


def made_up(number: int) -> list[tuple[str, str, int, int, str | None]]:
    """(group, text, start, end, kind) of made-up spans; kind is None where a text holds no personal data.

    Everything follows from the number, so the examples are the same each time.
    """
    r = random.Random(number)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    card = r.choice("345") + digits(14)
    card += next(d for d in "0123456789" if luhn(card + d))
    base = {
        "email": f"{r.choice(_NAMES)}@{r.choice(_HOSTS)}",
        "ip": ".".join(str(r.randint(1, 255)) for _ in range(4)),
        "card": card,
        "phone": f"+{r.choice(['1', '44', '49', '33', '34'])} ({r.randint(200, 989)}) {digits(3)}-{digits(4)}",
    }
    none = [
        f"19{digits(2)}-20{digits(2)}",
        f"1.{digits(1)}.{digits(2)}.{digits(5)}",
        f"{digits(2)}.{digits(3)}.{digits(3)}",
        f"20{digits(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)} {r.randint(10, 23)}:{digits(2)}:{digits(2)}",
        f"20{digits(2)}/0{r.randint(1, 9)}/{r.randint(10, 28)} {r.randint(10, 23)}:{digits(2)}",
        f"978-3-{digits(3)}-{digits(5)}-{digits(1)}",
        f"{digits(3)}-{digits(3)} {digits(3)}-{digits(4)}",
        f"3.14{digits(r.randint(5, 14))}",
        f"{r.randint(1, 9)}{digits(r.randint(6, 11))}",
        f"17{digits(8)}",
        f"{digits(1)} {digits(3)} {digits(3)} {digits(3)}",
        f"{r.randint(1, 9)} {r.randint(10, 99)} {r.randint(10, 99)} {r.randint(1, 9)}",
        f"{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
    ]
    tied = [f"x{digits(16)}", f"{digits(9)}ab", f"a{digits(12)}f{digits(14)}", f"/{digits(12)}/", f"run_{digits(10)}", f"0x{digits(13)}"]

    def around(kind: str | None, span: str) -> tuple[int, str]:
        words = " ".join(r.choice(_AROUND) for _ in range(3))
        lead = r.choice(["", "", "", r.choice(CONTEXT[kind]) + r.choice([" ", ": "])] if kind else ["", "", "", r.choice(AGAINST) + " "])
        return len(words) + 1 + len(lead), f"{words} {lead}{span}{r.choice(['', '.', ','])} {r.choice(_AROUND)} {r.choice(_AROUND)}"

    out = []
    for kind, span in base.items():
        for form in [span, r.choice(written_otherwise(span, kind)), r.choice(written_otherwise(span, kind))]:
            at, text = around(kind, form)
            out.append((f"made-up {number}", text, at, at + len(form), kind))
    for kinds in (("phone", "phone"), ("phone", "card"), ("card", "phone"), ("ip", "phone")):  # lists of numbers
        forms = [r.choice([base[kinds[0]], *written_otherwise(base[kinds[0]], kinds[0])])]
        second = base[kinds[1]] if kinds[0] != kinds[1] else f"+49 {digits(3)} {digits(3)}-{digits(4)}"
        forms.append(r.choice([second, *written_otherwise(second, kinds[1])]))
        glue = r.choice([" ", ", ", " / ", "\n"])
        at, text = around(kinds[0], glue.join(forms))
        out.append((f"made-up {number}", text, at, at + len(forms[0]), kinds[0]))
        at += len(forms[0]) + len(glue)
        out.append((f"made-up {number}", text, at, at + len(forms[1]), kinds[1]))
    for span in [*r.sample(none, 6), *r.sample(tied, 2)]:
        at, text = around(None, span)
        out.append((f"made-up {number}", text, at, at + len(span), None))
    return out


def examples(text: str, start: int, end: int, kind: str | None) -> list[tuple[int, list[float]]]:
    """Labelled rows of one span in its text: the span itself (1), and other candidates that touch it (0)."""
    rows = [] if kind is None else [(1, features(text, start, end, kind))]
    for c in candidates(text):
        if c[0] < end and start < c[1] and c != (start, end, kind):
            if kind is None or c[2] == kind:
                rows.append((0, features(text, *c)))
    return rows


@dataclass
class Boosted:
    """Boosted regression trees of depth three on the logistic loss."""

    prior: float = 0.0
    trees: list = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for columns, cuts, leaves in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(3):
                at = 2 * at + 1 + (x[np.arange(len(x)), columns[at]] > cuts[at])
            out += leaves[at - 7]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


#: Cuts of a feature at most, and rows of a block of training examples.
CUTS, BLOCK_ROWS = 31, 50_000
#: Gradients are whole multiples of this, so that sums are exact in any order and partitioning.
UNIT = 2.0**-30
NO_CUT = 255


def _grid(counts: list[tuple[int, float, int]], width: int) -> list[np.ndarray]:
    """Cuts of each feature: quantiles, linear between neighbours, of its values with their counts."""
    out = []
    for j in range(width):
        mine = sorted((v, n) for f, v, n in counts if f == j)
        if not mine:
            out.append(np.array([]))
            continue
        values, upto = np.array([v for v, _ in mine]), np.cumsum([n for _, n in mine])
        at = (upto[-1] - 1) * np.linspace(0, 1, CUTS + 2)[1:-1]
        low = np.floor(at).astype(np.int64)
        here, above = (values[np.searchsorted(upto, np.minimum(k, upto[-1] - 1), side="right")] for k in (low, low + 1))
        out.append(np.unique(here + (above - here) * (at - low)))
    return out


def _leaf(x: np.ndarray, tree: tuple, levels: int = 3) -> np.ndarray:
    """Number of the node (0 is the leftmost of its level) that each column of binned features reaches."""
    columns, cuts = tree[:2]
    at = np.zeros(x.shape[1], np.uint8)
    for level in range(levels):
        right, first = np.zeros(x.shape[1], bool), 2**level - 1
        for node in range(2**level):
            right |= (at == node) & (x[columns[first + node]] > cuts[first + node])
        at = 2 * at + right
    return at


def _sums(x: np.ndarray, negative: np.ndarray, positive: np.ndarray, prior: float, trees: list, growing: tuple, level: int) -> np.ndarray:
    """Sums of gradient, curvature and rows by node of the level, feature and slot."""
    f = np.full(x.shape[1], prior)
    for tree in trees:
        f += tree[2][_leaf(x, tree)]
    p = 1 / (1 + np.exp(-f))
    both = negative.astype(float) + positive
    amounts = [np.rint((positive - both * p) / UNIT), np.rint(both * p * (1 - p) / UNIT), both]
    at = _leaf(x, growing, level).astype(np.int64) * (CUTS + 1)
    slots = 2**level * (CUTS + 1)
    out = np.array([[np.bincount(at + row, a, slots) for row in x] for a in amounts])
    return out.astype(np.int64).reshape(3, len(x), 2**level, CUTS + 1).transpose(0, 2, 1, 3)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
    """The feature and slot of greatest gain, from sums by feature and slot."""
    left_g, left_h = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
    best = int(gain.argmax())
    return divmod(best, gain.shape[1]) if gain.flat[best] > 1e-9 else (0, NO_CUT)


def _binned(grid: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Slots of features, one row for each feature."""
    return np.array([np.searchsorted(cuts, column, side="left") for cuts, column in zip(grid, x.T)], np.uint8)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of features out of a column of their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(float)


def boost(rows: DataFrame, rounds: int = 80, rate: float = 0.3) -> Boosted:
    """Fit on all ``rows`` (x: bytes of 32-bit features, negative and positive: how often with either label).

    Rows stay in blocks of bounded size among the tasks.  Every level of every tree is one pass that adds
    up histograms of gradients; these, and the counts of each feature's values, are all that leaves a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = np.array(batch.column("negative")) + np.array(batch.column("positive"))
            for j, column in enumerate(_matrix(batch.column("x")).T if len(times) else []):
                values, at = np.unique(column, return_inverse=True)
                n = np.bincount(at, times, len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), j, np.int32)), pa.array(values), pa.array(n)], names=["f", "v", "n"])

    total, bad, good = rows.agg(F.count(F.lit(1)), F.sum("negative"), F.sum("positive")).first()
    model = Boosted(float(np.log(((good or 0) + 1) / ((bad or 0) + 1))))
    if not bad or not good:
        return model
    counts = rows.mapInArrow(count, "f int, v double, n long").groupBy("f", "v").agg(F.sum("n")).collect()
    grid = _grid(counts, max(r[0] for r in counts) + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(_binned(grid, _matrix(b.column("x"))), np.array(b.column("negative")), np.array(b.column("positive"))) for b in batches if len(b)]
        if held:
            parts = [np.concatenate(part, axis=-1).astype(np.uint8) for part in zip(*held)]
            yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in parts], names=["x", "negative", "positive"])

    width, trees = len(grid), []
    blocks = rows.coalesce(-(-total // BLOCK_ROWS)).mapInArrow(pack, "x binary, negative binary, positive binary").rdd
    blocks = blocks.map(lambda r: tuple(np.frombuffer(part, np.uint8) for part in r)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(rounds):
            columns, slots, leaves = np.zeros(7, np.int64), np.full(7, NO_CUT, np.int64), np.zeros(8)
            for level in range(3):
                known, growing = list(trees), (columns.copy(), slots.copy())
                sums = blocks.map(
                    lambda b: _sums(b[0].reshape(width, -1), b[1], b[2], model.prior, known, growing, level)  # noqa: B023
                ).treeReduce(np.add)
                for node in range(2**level):
                    g, h = sums[0, node] * UNIT, sums[1, node] * UNIT
                    at = 2**level - 1 + node
                    if sums[2, node, 0].sum() >= 8:
                        columns[at], slots[at] = _best_cut(g, h)
                    if level == 2:
                        left = slice(slots[at] + 1)
                        for side, (a, c) in enumerate(((g[columns[at], left], h[columns[at], left]), (g[columns[at]][slots[at] + 1 :], h[columns[at]][slots[at] + 1 :]))):
                            leaves[2 * node + side] = rate * a.sum() / (c.sum() + 1.0)
            trees.append((columns, slots, leaves))
            cuts = np.array([np.inf if k == NO_CUT or k >= len(grid[j]) else grid[j][k] for j, k in zip(columns, slots)])
            model.trees.append((columns, cuts, leaves))
    finally:
        blocks.unpersist()
    return model


@dataclass
class Judge:
    model: Boosted
    thresholds: dict[str, float]

    def scored(self, text: str, base: dict[str, list[Span]]) -> list[tuple[float, int, int, str]]:
        """(-probability, start, end, kind) of the candidates over their threshold that touch no base span."""
        every = candidates(text)
        taken = _merged(s for spans in base.values() for s in spans)
        if taken:
            every = [c for c in every if not _touches(taken, c[0], c[1])]
        if not every:
            return []
        p = self.model.probability(np.array([features(text, *c) for c in every]))
        return [(-float(q), s, e, k) for q, (s, e, k) in zip(p, every) if q >= self.thresholds[k]]

    def added(self, text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
        """Candidates that are chosen beside the base spans: best first, none overlapping another."""
        out: dict[str, list[Span]] = {k: [] for k in KINDS}
        chosen: list[Span] = []
        for _, s, e, kind in sorted(self.scored(text, base)):
            if not _touches(chosen, s, e):
                insort(chosen, (s, e))
                out[kind].append((s, e))
        return out


def _merged(spans: Iterable[Span]) -> list[Span]:
    """Disjoint sorted spans that cover the same places; matches of different kinds may overlap."""
    out: list[Span] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _touches(spans: list[Span], start: int, end: int) -> bool:
    """Whether any of the sorted spans, of which none overlaps another, overlaps this one."""
    at = bisect_left(spans, (end, -1))
    return at > 0 and spans[at - 1][1] > start


def labelled_examples(docs: DataFrame, made_up_examples: int = 500) -> DataFrame:
    """All distinct examples of the corpus and the made-up ones, stored: x (bytes of its features), and for
    either label how often it trains (0 or 1) and how often it is held out."""
    texts = docs.select(whole_text().alias("text"))
    row = "label int, x binary, made_up int, part long"

    def batch_of(found: dict[tuple, int], made: int) -> pa.RecordBatch:
        labels, xs = zip(*found) if found else ((), ())
        columns = [pa.array(labels, pa.int32()), pa.array(xs, pa.binary()), pa.array([made] * len(labels), pa.int32()), pa.array(list(found.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["label", "x", "made_up", "part"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, int] = {}
            for text in batch.column("text"):
                text = text.as_py()
                spans = base_spans(text)
                if any(spans.values()):
                    group = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
                    for kind, at in spans.items():
                        for s, e in at:
                            for label, x in _of_match(text, s, e, kind):
                                key = (label, np.array(x, np.float32).tobytes())
                                found[key] = min(group, found.get(key, group))
            yield batch_of(found, 0)

    def make_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, int] = {}
            for number in batch.column("id").to_pylist():
                for group, text, s, e, kind in made_up(number):
                    part = xxhash.xxh3_64_intdigest(group) >> 1
                    for label, x in examples(text, s, e, kind):
                        key = (label, np.array(x, np.float32).tobytes())
                        found[key] = min(part, found.get(key, part))
            yield batch_of(found, 1)

    made = docs.sparkSession.range(made_up_examples).mapInArrow(make_up, row)
    rows = texts.mapInArrow(describe, row).unionByName(made)
    # An example's part is the corpus's where it has it.
    part = {y: F.min(F.when(F.col("label") == y, F.struct("made_up", "part")))["part"] % 5 for y in (0, 1)}
    known = rows.groupBy("x").agg(part[0].alias("negative"), part[1].alias("positive"))
    count = lambda y, held: F.coalesce(((F.col(y) == 0) == held).cast("int"), F.lit(0))
    both = ("negative", "positive")
    return stored(known.select("x", *[count(y, False).alias(y) for y in both], *[count(y, True).alias(f"held_{y}") for y in both]), "examples")


def train(docs: DataFrame, made_up_examples: int = 500, precision: float = 0.97) -> Judge:
    """Fit on every distinct example; four fifths train, one fifth sets the thresholds."""
    rows = labelled_examples(docs, made_up_examples)
    model = boost(rows.where("negative + positive > 0").select("x", "negative", "positive"))
    return Judge(model, _thresholds(rows.where("negative + positive = 0"), model, precision))


def _thresholds(rows: DataFrame, model: Boosted, precision: float) -> dict[str, float]:
    """For each kind the lowest score, 0.5 at least, from which on the share of true spans is at least ``precision``."""
    share = Fraction(str(precision))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("x"))
                bad, good = (np.array(batch.column(f"held_{y}")).astype(np.int64) for y in ("negative", "positive"))
                # Not negative as long as the share of true ones is reached.
                over = share.denominator * good - share.numerator * (good + bad)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[:, : len(KINDS)].argmax(1)), pa.array(-model.probability(x)), pa.array(over)], names=["kind", "back", "over"]
                )

    scored = rows.mapInArrow(score, "kind long, back double, over long").groupBy("kind", "back").agg(F.sum("over").alias("over"))
    lowest = running(scored, ["kind"], ["back"], "over").where("upto >= 0").groupBy("kind").agg(F.max("back").alias("back")).collect()
    return dict.fromkeys(KINDS, 2.0) | {KINDS[r.kind]: max(0.5, -r.back) for r in lowest}


def _of_match(text: str, start: int, end: int, kind: str) -> list[tuple[int, list[float]]]:
    """Labelled rows of a base match: as it stands, and in other written forms between the same words."""
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    rows = []
    for form in [text[start:end], *written_otherwise(text[start:end], kind)]:
        rows += examples(before + form + after, len(before), len(before) + len(form), kind)
    return rows


_ROW = "doc_id {}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a digest of them, all spans, and how many were added, per document."""
    judge = train(docs)
    fields = docs.select("doc_id", whole_text().alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                more = judge.added(text, base)
                every = {k: base[k] + more[k] for k in KINDS}
                rows.append(
                    (
                        *(len(base[k]) for k in KINDS),
                        hashlib.sha256(listed(base).encode()).hexdigest(),
                        listed(every),
                        sum(map(len, more.values())),
                        sum(map(len, every.values())),
                    )
                )
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[x.split()[0] for x in _ROW.split(", ")],
            )

    return fields.mapInArrow(find, _ROW.format(dict(fields.dtypes)["doc_id"]))


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """``text`` with every span replaced by its kind in brackets.

    Spans that overlap are cut as one place, which is named by its longest span (of equally long ones, by
    the kind listed first), so that no part of any of them stays.
    """
    named = sorted(((s, e), -(e - s), KINDS.index(k), k) for k in KINDS for s, e in spans[k])
    kinds, at = [], 0
    places = _merged(n[0] for n in named)
    for _, end in places:
        inside = []
        while at < len(named) and named[at][0][0] < end:
            inside.append(named[at][1:])
            at += 1
        kinds.append(min(inside)[2])
    parts, done = [], 0
    for (start, end), kind in zip(places, kinds):
        parts += [text[done:start], f"[{kind}]"]
        done = end
    return "".join(parts) + text[done:]
