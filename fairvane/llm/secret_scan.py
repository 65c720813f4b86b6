"""Secret scans: wide candidate patterns, judged by a random forest, all in SQL expressions.

Candidates are long tokens with digits, values assigned to secret-sounding names and
private key blocks over several lines.  Their features are length, character transitions,
dictionary coverage, the path and the neighbouring words.  A random forest trained from
labelled findings (a bounded table) removes false positives; its trees are one constant
array that every candidate walks, so scoring is a projection of the scan: no shuffle, no
Python.

Findings are labelled by ``labelled_findings``, generated from known credential formats
and from their lookalikes (digests, identifiers, paths, versions, addresses), or by a
table of the caller's with the columns text, path and label.

Defined results: a null or empty text has no candidates; a null path counts as empty;
every place of a value is judged in its own context, and a value that is a secret at one
place is one at all its places, also where the context alone would not say so; places
that overlap are redacted as one; a value within a longer word is no place of it; values
have no largest length; repeated rows are kept; an empty table gives an empty result;
other columns are ignored (``scan``) or kept (``redact``), whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_row, constants, let, row_columns, stored, whole_text

TOKEN = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*+[0-9])[A-Za-z0-9+/_.-]{14,}+={0,2}"
_NAMES = r"(?i)\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"
ASSIGNED = _NAMES + r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,})"
QUOTED = _NAMES + r"[\"']?\s{0,3}[:=]\s{0,3}[\"']([^\"'\n]{6,})"
KEY_BLOCK = (
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[\sA-Za-z0-9+/=:,.-]*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----|[\sA-Za-z0-9+/=]*)"
)
SECRET_WORDS = "^(.*(pass(word|wd|phrase)?|pwd|secret|token|key|auth|credential|bearer|aws|login).*)$"
HARMLESS_WORDS = "^(commit|sha|sha1|sha256|md5|hash|checksum|digest|revision|rev|etag|uuid|guid|id|version|file|path|see|url|build|card|phone|ip|host)$"
KNOWN_PREFIX = "^(-----BEGIN|AKIA|ASIA|ghp_|gho_|sk[-_]|pk[-_]|xox[bap]-|eyJ|AIza|glpat-)"
FEATURES = [
    "n_length",
    "n_transitions",
    "n_bigrams",
    "n_distinct",
    "n_digits",
    "n_upper",
    "n_hex",
    "n_coverage",
    "n_joints",
    "n_prefix",
    "n_before_secret",
    "n_before_harmless",
    "n_assigned",
    "n_after_harmless",
    "n_path_secret",
    "n_path_harmless",
]


def _located(text: Column, pattern: str, group: int, possible: Column) -> Column:
    """All matches of ``pattern`` as structs of value (the group, which ends its match) and at (from 1).

    ``possible`` is a cheaper test that every text with a match passes.
    """

    def placed(whole: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        steps = F.zip_with(F.split(text, pattern, -1), whole, lambda gap, m: F.length(gap) + F.coalesce(F.length(m), F.lit(0)))
        # The last element after each match is the number of characters before its end.
        ends = F.aggregate(steps, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))
        return F.zip_with(
            values,
            F.slice(ends, F.lit(2), F.size(values)),
            lambda v, end: F.struct(v.alias("value"), (end - F.length(v) + 1).alias("at")),
        )

    nothing = F.array().cast("array<struct<value:string,at:int>>")
    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda whole: F.when(F.size(whole) > 0, placed(whole)).otherwise(nothing)
    )
    return F.when(possible, found).otherwise(nothing)


def occurrences(text: Column) -> Column:
    """Every place of a candidate value in a text, as an array of structs of value and at."""
    assigns = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    found = F.concat(
        _located(text, TOKEN, 0, text.rlike("[0-9]")), _located(text, ASSIGNED, 1, assigns), _located(text, QUOTED, 1, assigns)
    )
    trimmed = F.transform(
        found,
        lambda c: F.struct(
            F.regexp_replace(c.getField("value"), r"^[.\-/]+|[.\-/]+$", "").alias("value"),
            (c.getField("at") + F.length(F.regexp_extract(c.getField("value"), r"^[.\-/]*", 0))).alias("at"),
        ),
    )
    long_enough = F.filter(trimmed, lambda c: F.length(c.getField("value")) >= 6)
    return F.array_distinct(F.concat(long_enough, _located(text, KEY_BLOCK, 0, F.contains(text, F.lit("PRIVATE KEY")))))


def described(occurrence: Column, text: Column, path: Column, dictionary: list[str]) -> Column:
    """A struct of the candidate's value, place and features."""
    candidate, at = occurrence.getField("value"), occurrence.getField("at")
    before = F.substring(text, F.greatest(at - 48, F.lit(1)), F.least(at - 1, F.lit(48)))
    after = F.substring(text, at + F.length(candidate), F.lit(32))
    size = F.length(candidate)

    def share(pattern: str) -> Column:
        return F.regexp_count(candidate, F.lit(pattern)) / size

    runs = F.regexp_extract_all(F.lower(candidate), F.lit("[a-z]{3,}"), F.lit(0))
    words = F.array(*[F.lit(w) for w in dictionary])
    covered = F.aggregate(
        F.filter(runs, lambda r: F.array_contains(words, r)), F.lit(0), lambda n, r: n + F.length(r)
    )
    last_word = F.lower(F.regexp_extract(before, r"([A-Za-z][A-Za-z0-9_]{0,30})[^A-Za-z]{0,6}$", 1))
    next_word = F.lower(F.regexp_extract(after, r"^[^A-Za-z]{0,3}([A-Za-z]+)", 1))

    def flag(condition: Column) -> Column:
        return F.coalesce(condition.cast("double"), F.lit(0.0))

    numbers = {
        "n_length": size.cast("double"),
        "n_transitions": share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"),
        "n_bigrams": share("[aeiouAEIOU](?=[bcdfghjklmnpqrstvwxyz])|[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ](?=[aeiou])"),
        "n_distinct": F.size(F.array_distinct(F.split(candidate, ""))) / size,
        "n_digits": share("[0-9]"),
        "n_upper": share("[A-Z]"),
        "n_hex": flag(candidate.rlike("^[0-9a-fA-F]+$")),
        "n_coverage": covered / size,
        "n_joints": share("[._/-]"),
        "n_prefix": flag(candidate.rlike(KNOWN_PREFIX)),
        "n_before_secret": flag(last_word.rlike(SECRET_WORDS)),
        "n_before_harmless": flag(last_word.rlike(HARMLESS_WORDS)),
        "n_assigned": flag(before.rlike(r"[:=]\s{0,3}[\"']?$")),
        "n_after_harmless": flag(next_word.rlike(HARMLESS_WORDS)),
        "n_path_secret": flag(path.rlike("(?i)(\\.env|config|secret|credential|\\.pem|\\.key)")),
        "n_path_harmless": flag(path.rlike("(?i)(test|example|sample|fixture|docs?/|lock)")),
    }
    return F.struct(candidate.alias("value"), at.alias("at"), *[numbers[n].cast("double").alias(n) for n in FEATURES])


def with_candidates(docs: DataFrame, dictionary: list[str]) -> DataFrame:
    """``docs`` (text, path) with ``found``, an array of described candidates."""
    first = docs.withColumn("values", occurrences(F.col("text")))
    return first.withColumn(
        "found", F.transform("values", lambda c: described(c, F.col("text"), F.col("path"), dictionary))
    ).drop("values")


def common_words(docs: DataFrame, size: int = 1000) -> list[str]:
    """The most frequent words of at least three letters in all texts."""
    words = docs.select(F.explode(F.split(F.lower(whole_text()), "[^a-z]+")).alias("word")).where(F.length("word") >= 3)
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size)
    return sorted({r["word"] for r in top.collect()} | set(PLAIN_WORDS))


#: Words that identifiers and paths are made of.
PLAIN_WORDS = (
    "the and for with file data test main src lib user name value type item list node page index report final "
    "thread pool executor service module class method config build release version update commit branch java python "
    "json yaml html http https www com org net example image photo backup archive draft summary invoice"
).split()


def labelled_findings(spark: SparkSession, rows: int = 7200) -> DataFrame:
    """text, path, label: credentials in known formats (1) and their lookalikes (0).

    Everything follows from hashes of the row number, so the table is the same each time.
    """
    n = F.col("id")

    def pick(words: list[str], salt: int) -> Column:
        return F.element_at(
            F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(words))) + 1).cast("int")
        )

    hexes = F.concat(F.md5(n.cast("string")), F.md5(F.concat(n, F.lit("b"))))
    base64 = F.regexp_replace(F.base64(F.unhex(F.concat(hexes, F.md5(F.concat(n, F.lit("c")))))), "[\r\n=]", "")
    mixed = F.regexp_replace(base64, "[+/]", "x")
    letters = F.upper(F.regexp_replace(mixed, "[01890]", "Q"))
    prose = pick(["see", "onand", "the", "heating", "la", "und", "then", "word", "que"], 1)
    tail = pick(["", " and", " then", " of it", ".", ", with"], 2)
    secret_name = pick(
        ["token", "password", "secret", "api_key", "access_token", "auth", "db_password", "client_secret", "aws_secret_key"], 3
    )
    glue = pick(["=", " = \"", ": ", "=\"", ": '"], 4)
    harmless = pick(["commit", "sha1", "md5", "revision", "checksum", "etag", "hash", "sha256"], 5)
    short = (F.pmod(F.xxhash64(n, F.lit(6)), F.lit(25)) + 8).cast("int")
    secrets = [
        F.concat(prose, F.lit(" AKIA"), F.substring(letters, 1, 16), tail),
        F.concat(secret_name, glue, F.substring(hexes, 1, 40), tail),
        F.concat(secret_name, glue, F.substring(hexes, F.lit(1), short), tail),
        F.concat(secret_name, glue, F.substring(mixed, F.lit(1), short + 8), tail),
        F.concat(prose, F.lit(" ghp_"), F.substring(mixed, 1, 36), tail),
        F.concat(prose, F.lit(" sk-"), F.substring(mixed, 1, 40), tail),
        F.concat(prose, F.lit(" eyJ"), F.substring(mixed, 1, 30), F.lit("."), F.substring(mixed, 4, 36), tail),
        F.concat(prose, F.lit(" "), F.substring(base64, 1, 40), tail),
        F.concat(prose, F.lit("\n-----BEGIN RSA PRIVATE KEY-----\n"), base64, F.lit("\n-----END RSA PRIVATE KEY-----\n"), tail),
    ]
    two = F.pmod(F.xxhash64(n, F.lit(7)), F.lit(90)) + 10
    lookalikes = [
        F.concat(harmless, F.lit(" "), F.substring(hexes, 1, 40), tail),
        F.concat(harmless, F.lit(": "), F.substring(hexes, 1, 32), tail),
        F.concat(
            pick(["id", "uuid", "guid"], 8), F.lit(" "), F.substring(hexes, 1, 8), F.lit("-"), F.substring(hexes, 9, 4),
            F.lit("-"), F.substring(hexes, 13, 4), F.lit("-"), F.substring(hexes, 17, 4), F.lit("-"), F.substring(hexes, 21, 12), tail,
        ),
        F.concat(prose, F.lit(" src/main/java/"), pick(["thread", "user", "report", "data"], 9), F.lit("_service"), two, F.lit(".java"), tail),
        F.concat(prose, F.lit(" report_final_version_20"), two, F.lit("_summary.pdf"), tail),
        F.concat(prose, F.lit(" 20"), two, F.lit("-01-"), two, F.lit("T10"), F.lit(".00.00"), tail),
        F.concat(pick(["card", "visa", "card no"], 10), F.lit(" 41"), two, F.lit("-1"), two, F.lit("1-"), two, F.lit("11-"), two, two, tail),
        F.concat(prose, F.lit(" 1"), two, F.lit("."), two, F.lit(".1"), two, F.lit(".2"), two, tail),
        F.concat(prose, F.lit(" user.name_example"), two, F.lit(".com"), tail),
        F.concat(prose, F.lit(" thread-pool-executor-item-"), two, tail),
        F.concat(prose, F.lit(" mail"), two, F.lit(".example.com"), tail),
        F.concat(prose, F.lit(" "), F.substring(F.regexp_replace(hexes, "[a-f]", "4"), F.lit(1), F.least(short + 6, F.lit(19))), tail),
    ]
    positive = F.pmod(n, F.lit(2)) == 0
    half = F.floor(n / 2)

    def choose(forms: list[Column]) -> Column:
        out = forms[-1]
        for i, form in enumerate(forms[:-1]):
            out = F.when(F.pmod(half, F.lit(len(forms))) == i, form).otherwise(out)
        return out

    return spark.range(rows).select(
        F.when(positive, choose(secrets)).otherwise(choose(lookalikes)).alias("text"),
        pick(["src/app.env", "config/prod.yaml", "docs/a.md", "src1", "test/unit.txt", "src0", "notes"], 11).alias("path"),
        positive.cast("int").alias("label"),
    )


class Forest:
    """A trained forest as two arrays: trees one after the other, each laid out as a heap.

    ``feature`` is the feature a node splits by, or -1 at a leaf; ``number`` is the
    node's threshold, or the leaf's vote.
    """

    def __init__(self, model, depth: int):
        self.depth, self.size, self.trees = depth, 2 ** (depth + 1) - 1, len(model.trees)
        self.feature, self.number = [-1] * self.trees * self.size, [0.0] * self.trees * self.size

        def place(node, tree: int, at: int) -> None:
            i = tree * self.size + at
            if node.getClass().getSimpleName() == "LeafNode":
                self.number[i] = float(node.prediction())
                return
            split = node.split()
            self.feature[i], self.number[i] = split.featureIndex(), float(split.threshold())
            place(node.leftChild(), tree, 2 * at + 1)
            place(node.rightChild(), tree, 2 * at + 2)

        for tree, t in enumerate(model.trees):
            place(t._java_obj.rootNode(), tree, 0)

    def vote(self, numbers: list[float]) -> float:
        """The share of trees that say secret, for one candidate in plain Python."""
        total = 0.0
        for tree in range(self.trees):
            base, at = tree * self.size, 0
            while self.feature[base + at] >= 0:
                at = 2 * at + 1 + (numbers[self.feature[base + at]] > self.number[base + at])
            total += self.number[base + at]
        return total / self.trees

    def score(self, described_one: Column) -> Column:
        """The same share for a described candidate, as an expression."""
        feature, number = constants(self.feature, "int"), constants(self.number, "double")

        def walked(x: Column, base: Column) -> Column:
            def step(at: Column, _: Column) -> Column:
                split = F.get(feature, base + at)
                right = F.get(x, split) > F.get(number, base + at)
                return F.when(split < 0, at).otherwise(2 * at + 1 + right.cast("int"))

            return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), step)

        def votes(x: Column) -> Column:
            trees = F.sequence(F.lit(0), F.lit(self.trees - 1))
            total = F.aggregate(trees, F.lit(0.0), lambda s, t: s + F.get(number, t * self.size + walked(x, t * self.size)))
            return total / self.trees

        return let(F.array(*[described_one.getField(n) for n in FEATURES]), votes)


class SecretScanner:
    """A trained forest and the dictionary its features use."""

    def __init__(self, dictionary: list[str], forest: Forest, threshold: float = 0.6):
        self.dictionary, self.forest, self.threshold = dictionary, forest, threshold

    @classmethod
    def train(cls, docs: DataFrame, findings: DataFrame | None = None, trees: int = 20, depth: int = 6) -> SecretScanner:
        spark = docs.sparkSession
        dictionary = common_words(docs)
        findings = labelled_findings(spark) if findings is None else findings
        rows = stored(with_candidates(findings, dictionary).select("label", F.inline("found")), "findings")
        table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        forest = RandomForestClassifier(
            featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt"
        )
        return cls(dictionary, Forest(forest.fit(table.select("label", "features")), depth))

    def judged(self, text: Column, path: Column) -> Column:
        """A struct of ``candidates``, the number of different values, and ``secrets``.

        Secrets are structs of value, at (from 1) and score, one for each place, in order.
        """

        def scored(values: Column) -> Column:
            return F.transform(
                F.transform(values, lambda c: described(c, text, path, self.dictionary)),
                lambda d: F.struct(
                    d.getField("at").alias("at"), d.getField("value").alias("value"), self.forest.score(d).alias("score")
                ),
            )

        def chosen(places: Column) -> Column:
            sure = F.filter(places, lambda s: s.getField("score") >= self.threshold)
            names = F.array_distinct(F.transform(sure, lambda s: s.getField("value")))
            return let(
                names,
                lambda known: F.struct(
                    F.size(F.array_distinct(F.transform(places, lambda s: s.getField("value")))).alias("candidates"),
                    F.array_sort(F.filter(places, lambda s: F.array_contains(known, s.getField("value")))).alias("secrets"),
                ),
            )

        return let(occurrences(text), lambda values: let(scored(values), chosen))

    def scanned(self, docs: DataFrame, path: Column) -> DataFrame:
        """``row``, a struct of all columns of ``docs``, with ``text`` and ``found``, as ``judged`` gives it."""
        path = F.coalesce(path.cast("string"), F.lit(""))
        prepared = docs.select(as_row(docs).alias("row"), whole_text().alias("text"), path.alias("path"))
        return prepared.select("row", "text", self.judged(F.col("text"), F.col("path")).alias("found"))


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, path, n_candidates, n_secrets (places) and the secrets found in every document."""
    scanner = SecretScanner.train(docs, findings)
    found = scanner.scanned(docs.select("doc_id", "source", "text"), F.col("source"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.source").alias("path"),
        F.col("found.candidates").alias("n_candidates"),
        F.size("found.secrets").alias("n_secrets"),
        F.transform(
            "found.secrets",
            lambda s: F.struct(s.getField("value").alias("value"), s.getField("at").alias("at"), s.getField("score").alias("score")),
        ).alias("secrets"),
    )


def without(text: Column, places: Column, mark: str) -> Column:
    """``text`` with each place (at from 1, value), in their order, replaced by ``mark``; overlapping ones as one."""

    def cut(done: Column, s: Column) -> Column:
        start, end = s.getField("at"), s.getField("at") + F.length(s.getField("value"))
        gap = F.substring(text, done.getField("at"), start - done.getField("at"))
        return F.struct(
            F.when(start < done.getField("at"), done.getField("out")).otherwise(F.concat(done.getField("out"), gap, F.lit(mark))).alias("out"),
            F.greatest(done.getField("at"), end).alias("at"),
        )

    return F.aggregate(
        places,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        cut,
        lambda done: F.concat(done.getField("out"), F.substring(text, done.getField("at"), F.length(text))),
    )


def redact(docs: DataFrame, findings: DataFrame | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every place of a secret in the text replaced by ``mark``, and n_chars to match."""
    scanner = SecretScanner.train(docs, findings)
    has = F.size("found.secrets") > 0
    clean = F.when(has, without(F.col("text"), F.col("found.secrets"), mark)).otherwise(F.col("row.text"))
    cleaned = scanner.scanned(docs, F.col("source")).select("row", has.alias("has"), clean.alias("clean"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("clean").alias("text")
        if name == "n_chars":
            kind = dict(docs.dtypes)["n_chars"]
            return F.when(F.col("has"), F.length("clean").cast(kind)).otherwise(F.col("row.n_chars")).alias("n_chars")
        return F.col("row").getField(name).alias(name)

    return cleaned.select(*[column(c) for c in docs.columns])
