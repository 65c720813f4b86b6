"""Document quality from a linear-chain conditional random field over lines.

Every line of a document gets the label good or bad.  Unary scores are linear in
features of the line and of its neighbours, pair scores in the label transition.
Forward-backward gives each line's marginal probability of being good; their mean,
weighted by line length, is the document's raw quality, which a logistic curve fitted
on the same training sample maps to the score.

Labels are of documents, not lines.  All lines of a good document are good.  Of a bad one
those are good (but never its worst line) that a logistic regression on the features of
single lines, with each line's document for its label, holds for good; so the chain meets
good lines inside bad documents and learns where the label changes.

The model is fitted in one task, on a bounded sample of labelled documents: the first
``max_training_docs`` in the order of a hash, of which whole documents are taken, with all
their lines, while these are at most ``MAX_TRAINING_LINES``.  Every document is scored over
its whole text.

Defined results, of scores and of what ``keep_good`` keeps alike: null and empty texts are
one empty line; blank lines are skipped unless the whole text is blank; lines beyond any
length are scored whole; equal texts get equal scores; repeated rows are kept; a document
with several labels takes their rounded mean; without labels of both kinds every score is
the share of good labels (0.5 without any); an empty table gives an empty result; other
columns are ignored (``score_quality``) or kept (``keep_good``), whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, whole_text

LETTERS_UPPER = bytes(range(65, 91))
SYMBOLS = b"!#$%&*+/<=>@\\^_`{|}~"
PUNCT = b".,;:?'\"()-"
N_LINE = 14


def line_features(line: bytes) -> list[float]:
    """Numbers between about 0 and 1 that describe one line."""
    n = len(line)
    words = line.split()
    if not words:
        return [1.0] + [0.0] * (N_LINE - 1)
    k = len(words)
    kinds = len(set(words))
    repeats = sum(map(bytes.__eq__, words, words[1:])) if k > 1 else 0
    symbols = n - len(line.translate(None, SYMBOLS))
    return [
        1.0,
        min(1.0, np.log1p(n) / 10),
        (n - len(line.translate(None, LETTERS_UPPER))) / n,
        min(1.0, 8 * symbols / n),
        (n - len(line.translate(None, PUNCT))) / n,
        (n - len(line.translate(None, b"0123456789"))) / n,
        kinds / k,
        repeats / k,
        min(1.0, n / k / 20),
        float(words[-1][-1:] in (b".", b"!", b"?")),
        float(k < 4),
        min(1.0, line.count(b"|") / k),
        min(1.0, len(zlib.compress(line, 1)) / n),
        float(line[:1].isupper()),
    ]


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with its neighbours' and repeats in the document; lengths."""
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip()] or [b""]
    own = np.array([line_features(x) for x in lines])
    count: dict[bytes, int] = {}
    for x in lines:
        count[x] = count.get(x, 0) + 1
    again = np.array([[1 - 1 / count[x]] for x in lines])
    edge = np.zeros((1, own.shape[1]))
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    size = np.array([len(x) for x in lines], float)
    return np.concatenate([own, before, after, again, own[:, 2:9] ** 2], axis=1), np.maximum(size, 1)


@dataclass
class Crf:
    weights: np.ndarray  # of a line being good
    pair: np.ndarray  # 2 x 2 transition scores
    scale: float  # of the calibration curve
    shift: float
    constant: float | None = None

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """P(line is good) for each line of one document."""
        u = x @ self.weights
        return _marginals(u[None, :], np.ones((1, len(u)), bool), self.pair)[0][0]

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        x, size = document_features(text)
        raw = float((self.marginals(x) * size).sum() / size.sum())
        return float(1 / (1 + np.exp(-np.clip(self.scale * _logit(raw) + self.shift, -500, 500))))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _marginals(u: np.ndarray, mask: np.ndarray, pair: np.ndarray):
    """Batched forward-backward: P(good) per line, pair marginals summed, log partition."""
    docs, lines = u.shape
    unary = np.stack([np.zeros_like(u), u], axis=2)
    forward, backward = np.zeros((lines, docs, 2)), np.zeros((lines, docs, 2))
    forward[0] = unary[:, 0]
    for t in range(1, lines):
        step = np.logaddexp.reduce(forward[t - 1][:, :, None] + pair, axis=1) + unary[:, t]
        forward[t] = np.where(mask[:, t, None], step, forward[t - 1])
    logz = np.logaddexp.reduce(forward[-1], axis=1)
    pairs = np.zeros((2, 2))
    for t in range(lines - 2, -1, -1):
        ahead = unary[:, t + 1] + backward[t + 1]
        step = np.logaddexp.reduce(pair + ahead[:, None, :], axis=2)
        live = mask[:, t + 1]
        both = np.exp(forward[t][:, :, None] + pair + ahead[:, None, :] - logz[:, None, None])
        pairs += both[live].sum(axis=0)
        backward[t] = np.where(live[:, None], step, 0.0)
    good = np.exp(forward[:, :, 1] + backward[:, :, 1] - logz[None, :]).T
    return np.clip(good, 0, 1) * mask, pairs, logz


def _pad(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, xs))
    out, mask = np.zeros((len(xs), longest, xs[0].shape[1])), np.zeros((len(xs), longest), bool)
    for i, x in enumerate(xs):
        out[i, : len(x)], mask[i, : len(x)] = x, True
    return out, mask


#: Lines, padding included, of the documents that one step of the fit handles together.
GROUP_LINES = 16_384


def _groups(lengths: list[int]) -> list[np.ndarray]:
    """Documents in groups of like length, each of about ``GROUP_LINES`` lines or one document."""
    out: list[list[int]] = []
    for i in np.argsort(lengths, kind="stable").tolist():
        if not out or (len(out[-1]) + 1) * lengths[i] > GROUP_LINES:
            out.append([])
        out[-1].append(i)
    return [np.array(g) for g in out]


def fit(features: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, rounds: int = 150) -> Crf:
    """Maximise the conditional likelihood of the lines' labels, each document weighted
    alike, with a small penalty on large weights."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        return Crf(np.zeros(0), np.zeros((2, 2)), 1.0, 0.0, share)
    groups = _groups([len(x) for x in features])
    padded = [_pad([features[i] for i in g]) for g in groups]
    single = _line_weights(padded, [labels[g] for g in groups])
    marks = [line_labels(1 / (1 + np.exp(-_single(x) @ single)), mask, labels[g]) for g, (x, mask) in zip(groups, padded)]
    width = features[0].shape[1]
    theta = np.zeros(width + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    n_steps = max(1, sum(int(np.maximum(mask.sum(axis=1) - 1, 0).sum()) for _, mask in padded))
    for t in range(1, rounds + 1):
        pair = theta[width:].reshape(2, 2)
        slope = 1e-3 * theta
        for (x, mask), y in zip(padded, marks):
            heavy = 1 / np.maximum(mask.sum(axis=1), 1)
            good, expected, _ = _marginals(x @ theta[:width], mask, pair)
            slope[:width] += np.einsum("dlf,dl->f", x, (good - y) * mask * heavy[:, None]) / len(labels)
            slope[width:] += ((expected - _label_pairs(y, mask)) / n_steps).ravel()
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    model = Crf(theta[:width], theta[width:].reshape(2, 2), 1.0, 0.0)
    raw = np.zeros(len(labels))
    for g, (x, mask) in zip(groups, padded):
        good, _, _ = _marginals(x @ model.weights, mask, model.pair)
        for i, row in zip(g, good):
            raw[i] = (row[: len(sizes[i])] * sizes[i]).sum() / sizes[i].sum()
    model.scale, model.shift = _calibrate(_logit(raw), labels)
    return model


def _single(x: np.ndarray) -> np.ndarray:
    """The features of a line that don't depend on its neighbours."""
    return np.concatenate([x[..., :N_LINE], x[..., 3 * N_LINE :]], axis=-1)


def _line_weights(padded: list[tuple[np.ndarray, np.ndarray]], labels: list[np.ndarray]) -> np.ndarray:
    """Logistic regression of the document's label on single lines, by Newton steps."""
    width = _single(padded[0][0]).shape[-1]
    w = np.zeros(width)
    for _ in range(12):
        slope, bend = 1e-2 * w, 1e-2 * np.eye(width)
        for (x, mask), y in zip(padded, labels):
            lines = _single(x)[mask]
            p = 1 / (1 + np.exp(-np.clip(lines @ w, -30, 30)))
            slope += lines.T @ (p - np.repeat(y, mask.sum(axis=1)))
            bend += (lines * (p * (1 - p))[:, None]).T @ lines
        step = np.linalg.solve(bend, slope)
        w = w - step
        if abs(step).max() < 1e-6:
            break
    return w


def line_labels(good: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """A label for each line: 1 in good documents; in bad ones where the model says so, but for its worst line."""
    out = np.where(labels[:, None] == 1, 1.0, (good > 0.5).astype(float))
    worst = np.argmin(np.where(mask, good, np.inf), axis=1)
    rows = np.nonzero(labels == 0)[0]
    out[rows, worst[rows]] = 0.0
    return out


def _label_pairs(y: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """How often each pair of labels follows one another."""
    live = mask[:, 1:]
    kinds = (2 * y[:, :-1] + y[:, 1:])[live].astype(np.int64)
    return np.bincount(kinds, minlength=4).reshape(2, 2).astype(float)


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through (z, y) with smoothed targets, by Newton steps that are halved until they help."""
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)

    def loss(w: np.ndarray) -> float:
        m = x @ w
        return float((np.logaddexp(0, m) - target * m).sum() + 5e-4 * ((w - [1.0, 0.0]) ** 2).sum())

    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0])
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step, now = np.linalg.solve(bend, slope), loss(w)
        for _ in range(30):
            after = w - step
            after[0] = max(after[0], 0.05)
            if loss(after) <= now:
                break
            step = step / 2
        else:
            break
        w = after
    return float(w[0]), float(w[1])


#: Lines of all training documents together.
MAX_TRAINING_LINES = 400_000


def train(docs: DataFrame, labels: DataFrame, max_training_docs: int = 4000, folds: int = 5) -> Crf:
    """Fit on at most ``max_training_docs`` labelled documents outside fold 0."""
    marked = (
        labels.where("quality is not null and doc_id is not null")
        .where(id_remainder(folds) != 0)
        .groupBy("doc_id")
        .agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    )
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training_docs)
    # At most max_training_docs pairs of an id and an integer: a size fixed by the parameter.
    known = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id").select("quality", "text")
    # Rows that share an id can be any number; the bound holds for them too.
    bounded = known.orderBy(F.xxhash64("text"), "quality", "text").limit(max_training_docs)
    row = bounded.mapInArrow(_fitted, "weights array<double>, pair array<double>, curve array<double>").first()
    if row is None:
        return fit([], [], np.zeros(0))
    scale, shift, *constant = row["curve"]
    return Crf(np.array(row["weights"]), np.array(row["pair"]).reshape(2, 2), scale, shift, *constant)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model that fits all rows (quality, text) of the one partition there is."""
    features, sizes, labels, lines = [], [], [], 0
    for batch in batches:
        for text, quality in zip(batch.column("text"), batch.column("quality")):
            x, size = document_features(text.as_py())
            if not features or lines + len(x) <= MAX_TRAINING_LINES:
                features.append(x.astype(np.float32).astype(float))
                sizes.append(size)
                labels.append(quality.as_py())
                lines += len(x)
    if not features:
        return
    model = fit(features, sizes, np.array(labels, float))
    curve = [model.scale, model.shift] + ([] if model.constant is None else [model.constant])
    kind = pa.list_(pa.float64())
    yield pa.RecordBatch.from_arrays(
        [pa.array([x], kind) for x in (model.weights.tolist(), model.pair.ravel().tolist(), curve)], names=["weights", "pair", "curve"]
    )


def score_quality(
    docs: DataFrame, labels: DataFrame, max_training_docs: int = 4000, threshold: float = 0.3, folds: int = 5
) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is at least ``threshold``)."""
    model = train(docs, labels, max_training_docs, folds)
    fields = docs.select("doc_id", (id_remainder(folds) == 0).alias("held_out"), whole_text().alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter((model.score(t.as_py()) for t in batch.column("text")), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(marks),
                    pa.array((marks >= threshold).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return fields.mapInArrow(score, f"doc_id {dict(fields.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, max_training_docs: int = 4000, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with their columns."""
    model = train(docs, labels, max_training_docs)
    names = docs.columns
    at = names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.score(t.as_py() or "") >= threshold for t in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
