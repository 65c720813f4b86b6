"""Mixing documents to target domain weights, in DataFrame expressions only.

A classifier, trained on a bounded sample of a labelled table, gives each document a
posterior over domains (soft membership).  Nonnegative document rates are then fitted so
that the expected tokens of each domain match its target:

    minimise  1/2 sum_d (sum_i w_i r_i p_id - t_d)^2 / s_d + ridge/2 sum_i w_i (r_i - 1)^2
    subject to  0 <= r_i <= max_rate

with w_i the document's share of all tokens, p_id its posterior, t_d the target share and
s_d the larger of the target and the natural share.  Each projected-gradient step is one
distributed aggregation of the residuals; with this scaling no step exceeds the
curvature, so the step length is one.  Documents with the same rounded posterior have the
same rate, so the steps run over sums by posterior.  Targets that no rates within the
bound can reach are lowered to what can be reached.

Defined results: a null or empty text has no tokens and a posterior of its own; equal
texts have equal posteriors and rates; repeated rows count as often as they occur;
labelled documents with several labels are used once for each; without labelled
documents every posterior is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, constants, let, row_columns, stored, whole_text

SYMBOLS = "!#$%&*+/<=>@^_`{|}~"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Residuals, as shares of the larger of target and natural share, that count as met.
TOLERANCE = 1e-4
#: Posteriors are rounded to this many steps.
GRID = 200


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(text), "\n\t\r", "   "), " "), lambda w: w != "")


def labelled_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain (plain, toxic or junk) from quality and toxicity labels."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").otherwise("plain")
    return labels.where("doc_id is not null").select("doc_id", domain.alias("domain"))


def _numbers(text: Column, words: Column, lists: dict[str, list[str]]) -> tuple[list[Column], Column]:
    """Feature columns and the number of tokens."""
    size = F.greatest(F.length(text), F.lit(1))
    tokens = F.size(words)
    listed = F.array(*[F.lit(w) for ws in lists.values() for w in ws]) if any(lists.values()) else None
    out = [
        (F.log1p(tokens) / 8),
        F.least(8 * (size - F.length(F.translate(text, SYMBOLS, ""))) / size, F.lit(1.0)),
        (size - F.length(F.translate(text, CAPITALS, ""))) / size,
        F.size(F.array_distinct(words)) / F.greatest(tokens, F.lit(1)),
    ]
    if listed is not None:
        met = F.array_intersect(words, listed)
        for ws in lists.values():
            mine = F.size(F.array_intersect(met, F.array(*[F.lit(w) for w in ws]))) if ws else F.lit(0)
            out += [F.least(mine, F.lit(5)) / 5, (mine > 0).cast("double"), F.least(mine / F.log1p(tokens + 1), F.lit(2.0))]
    return [c.cast("double") for c in out], tokens.cast("long")


class DomainClassifier:
    """Multinomial logistic regression on shape features and learned word lists."""

    def __init__(self, domains: list[str], lists: dict[str, list[str]], weights: list[list[float]], shifts: list[float]):
        self.domains, self.lists, self.weights, self.shifts = domains, lists, weights, shifts

    @classmethod
    def train(cls, docs: DataFrame, labelled: DataFrame, max_training_docs: int = 4000, list_size: int = 60) -> DomainClassifier:
        chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(max_training_docs)
        # At most max_training_docs narrow rows: a size fixed by the parameter.
        known = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
        sample = stored(known.select("domain", "text", words_of(F.col("text")).alias("words")), "mixing-sample")
        sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
        domains = sorted(sizes)
        if len(domains) < 2:
            return cls(domains or ["all"], {}, [], [])
        lists = cls._word_lists(sample, domains, sizes, list_size)
        numbers, _ = _numbers(F.col("text"), F.col("words"), lists)
        names = [f"f{i}" for i in range(len(numbers))]
        index = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
        rows = sample.select(index.cast("double").alias("label"), *[c.alias(n) for c, n in zip(numbers, names)])
        table = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features")
        model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60).fit(table)
        matrix = model.coefficientMatrix.toArray()
        return cls(domains, lists, [[float(x) for x in row] for row in matrix], [float(x) for x in model.interceptVector])

    @staticmethod
    def _word_lists(sample: DataFrame, domains: list[str], sizes: dict[str, int], list_size: int) -> dict[str, list[str]]:
        """For each domain, the words whose documents are most in excess there."""
        counts = (
            sample.select("domain", F.explode(F.array_distinct("words")).alias("word"))
            .groupBy("word")
            .agg(*[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)])
        )
        total = sum(sizes.values())
        everywhere = sum((F.col(f"n{i}") for i in range(1, len(domains))), F.col("n0"))
        out: dict[str, list[str]] = {}
        for i, d in enumerate(domains):
            rest = total - sizes[d]
            inside = (F.col(f"n{i}") + 0.5) / (sizes[d] + 1)
            outside = (everywhere - F.col(f"n{i}") + 0.5) / (rest + 1)
            excess = inside * F.log(inside / outside)
            strong = counts.where((F.col(f"n{i}") >= 3) & (inside > 3 * outside))
            out[d] = [r["word"] for r in strong.select("word", excess.alias("e")).orderBy(F.desc("e"), "word").limit(list_size).collect()]
        return out

    def described(self, docs: DataFrame) -> DataFrame:
        """``row``, a struct of all columns of ``docs``, with ``n_tokens`` and ``posterior``, the
        rounded probabilities in steps."""
        size = len(self.domains)
        if not self.weights:
            even = F.array(*[F.lit(GRID // size) for _ in self.domains])
            found = let(words_of(whole_text()), lambda w: F.struct(F.size(w).cast("long").alias("n"), even.alias("p")))
        else:
            found = let(
                whole_text(),
                lambda text: let(words_of(text), lambda words: self._posterior(*_numbers(text, words, self.lists))),
            )
        return docs.select(as_row(docs).alias("row"), found.alias("found")).select(
            "row", F.col("found.n").alias("n_tokens"), F.col("found.p").alias("posterior")
        )

    def _posterior(self, numbers: list[Column], tokens: Column) -> Column:
        def scores(x: Column) -> Column:
            return F.array(
                *[
                    sum((F.lit(w) * F.get(x, F.lit(i)) for i, w in enumerate(row) if w), F.lit(shift))
                    for row, shift in zip(self.weights, self.shifts)
                ]
            )

        def total(powers: Column) -> Column:
            return sum((F.get(powers, F.lit(i)) for i in range(len(self.domains))), F.lit(0.0))

        def rounded(powers: Column) -> Column:
            return let(total(powers), lambda t: F.transform(powers, lambda e: F.round(e / t * GRID).cast("int")))

        steps = let(
            F.array(*numbers),
            lambda x: let(
                scores(x),
                lambda s: let(F.array_max(s), lambda top: let(F.transform(s, lambda v: F.exp(v - top)), rounded)),
            ),
        )
        return F.struct(tokens.alias("n"), steps.alias("p"))


def _shares(posterior: Column) -> Column:
    """The rounded posterior as probabilities that add up to one."""

    def divided(steps: Column) -> Column:
        whole = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
        return let(F.greatest(whole, F.lit(1)), lambda t: F.transform(steps, lambda x: x / t))

    return let(posterior, divided)


def rate_of(posterior: Column, steps: list[list[float]], ridge: float, max_rate: float) -> Column:
    """The rate after all projected-gradient steps, each given by its scaled residuals."""
    if not steps:
        return F.lit(1.0)
    size = len(steps[0])
    residuals = constants([float(x) for r in steps for x in r], "double")

    def final(p: Column) -> Column:
        def step(rate: Column, n: Column) -> Column:
            slope = sum((F.get(p, F.lit(i)) * F.get(residuals, n * size + i) for i in range(size)), F.lit(0.0))
            return F.greatest(F.lit(0.0), F.least(F.lit(max_rate), rate - (slope + ridge * (rate - 1)) / (1 + ridge)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.lit(1.0), step)

    return let(_shares(posterior), final)


def fit_rates(
    described: DataFrame, domains: list[str], weights: dict[str, float], max_rate: float, ridge: float = 1e-3, rounds: int = 30
) -> list[list[float]]:
    """Scaled residuals of each projected-gradient step.

    ``described`` has n_tokens and posterior.  Each step is one aggregation over the sums by
    posterior, of which there are at most as many as documents and as ways to share GRID
    steps among the domains.  Steps end when no residual is over ``TOLERANCE`` or when a
    step changes them by less than a tenth of that (what the ridge and the bounds leave).
    """
    cells = stored(described.groupBy("posterior").agg(F.sum("n_tokens").cast("double").alias("tokens")), "mixing-cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    if not total:
        return []
    p = _shares(F.col("posterior"))

    def achieved(rate: Column) -> list[float]:
        row = cells.agg(*[F.sum(F.col("tokens") * rate * F.get(p, F.lit(i))).alias(f"d{i}") for i in range(len(domains))]).first()
        return [float(x or 0.0) / total for x in row]

    natural = achieved(F.lit(1.0))
    whole = sum(weights.get(d, 0.0) for d in domains) or 1.0
    target = [min(weights.get(d, 0.0) / whole, max_rate * n) for d, n in zip(domains, natural)]
    scale = [max(n, t, 1e-12) for n, t in zip(natural, target)]
    steps: list[list[float]] = []
    now = natural
    for _ in range(rounds):
        residual = [(a - t) / s for a, t, s in zip(now, target, scale)]
        if max(map(abs, residual)) < TOLERANCE or steps and sum(abs(x - y) for x, y in zip(residual, steps[-1])) < TOLERANCE / 10:
            break
        steps.append(residual)
        now = achieved(rate_of(F.col("posterior"), steps, ridge, max_rate))
    return steps


def _copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies with the rate as their mean: the rate plus a hash of the row's id, floored."""
    draw = F.pmod(F.xxhash64(doc_id, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + draw).cast("long")


#: Weights of the query: tokens of each domain in the mixture.
WEIGHTS = {"plain": 0.9, "toxic": 0.06, "junk": 0.04}


def mixture(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], max_rate: float = 4.0) -> DataFrame:
    """doc_id, n_tokens, a posterior for each domain, rate and copies of every document."""
    model = DomainClassifier.train(docs, labelled)
    described = stored(model.described(docs.select("doc_id", "text")).select("row.doc_id", "n_tokens", "posterior"), "mixing-posteriors")
    steps = fit_rates(described, model.domains, weights, max_rate)
    p = _shares(F.col("posterior"))
    rated = described.withColumn("rate", rate_of(F.col("posterior"), steps, 1e-3, max_rate))
    return rated.select(
        "doc_id",
        "n_tokens",
        *[F.get(p, F.lit(i)).alias(f"p_{d}") for i, d in enumerate(model.domains)],
        "rate",
        _copies(F.col("rate"), F.col("doc_id")).alias("copies"),
    )


def achieved_shares(rated: DataFrame) -> DataFrame:
    """domain, natural_share and achieved_share of the expected tokens, from ``mixture``'s rows."""
    domains = [c[2:] for c in rated.columns if c.startswith("p_")]
    sums = rated.agg(
        F.sum("n_tokens").alias("before"),
        F.sum(F.col("n_tokens") * F.col("rate")).alias("after"),
        *[F.sum(F.col("n_tokens") * F.col(f"`p_{d}`")).alias(f"n{i}") for i, d in enumerate(domains)],
        *[F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"`p_{d}`")).alias(f"a{i}") for i, d in enumerate(domains)],
    )
    each = [
        F.struct(
            F.lit(d).alias("domain"),
            F.try_divide(F.col(f"n{i}"), F.col("before")).alias("natural_share"),
            F.try_divide(F.col(f"a{i}"), F.col("after")).alias("achieved_share"),
        )
        for i, d in enumerate(domains)
    ]
    return sums.select(F.inline(F.array(*each)))


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], max_rate: float = 1.0) -> DataFrame:
    """``docs`` drawn to the mixture: each row as often as its copies say.

    Nulls, empty texts, repeats and an empty table are as the module says; rows without an
    id are drawn alike.  All columns of ``docs`` are kept, whatever their names.
    """
    model = DomainClassifier.train(docs, labelled)
    described = stored(model.described(docs), "mixing-described")
    steps = fit_rates(described.select("n_tokens", "posterior"), model.domains, weights, max_rate)
    copies = _copies(rate_of(F.col("posterior"), steps, 1e-3, max_rate), F.col("row.doc_id"))
    drawn = described.select("row", copies.alias("copies")).where("copies >= 1")
    if max_rate > 1:
        drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return drawn.select(*row_columns(docs))
