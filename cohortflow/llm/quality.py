"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

One pass reads the texts and keeps a short vector of statistics per document. Class means and covariances come from one
aggregation of sums and products over all labelled vectors. Covariances are shrunk towards the pooled one and towards its
diagonal; their Cholesky factors are made once and shipped with the score function, which takes the difference of the
Mahalanobis log-densities.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, cut, fold, located, query, table

THRESHOLD = 0.3
TOWARDS_POOLED = 0.1  # share of the pooled covariance in each class's
TOWARDS_DIAGONAL = 0.05  # share of a covariance's own diagonal in it
FLOOR = 1e-3  # added to the variance of a statistic
BYTES, WORDS, LINES = 30, 8, 4  # what shares are over besides the text's own

STATISTICS = ("words", "word_length", "upper", "marks", "stops", "shouts", "pipes", "digits", "distinct", "repeats",
              "commonest", "lines", "same_lines", "spread")

_CLASSES = {  # bytes that each count is over
    "letters": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "upper": range(65, 91),
    "ascii": [*range(65, 91), *range(97, 123)],
    "digits": range(48, 58),
    "stops": b".,;:",
    "shouts": b"!?",
    "pipes": b"|",
    "marks": [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?|'\"-()"],
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[list(_bytes), _k] = 1


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of a text; shares by square root, sizes by logarithm. Null counts as empty.

    Shares are over a little more than the text has, so that one mark or line in a short text isn't a large share.
    """
    text = text or b""
    size = len(text) + BYTES
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MEMBER
    of = dict(zip(_CLASSES, counts.tolist()))
    words = text.split()
    n = len(words) + WORDS
    tally = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    root = np.sqrt
    return [
        np.log1p(len(words)),
        np.log1p((of["letters"] + 4 * WORDS) / n),
        root(of["upper"] / (of["ascii"] + BYTES)),
        root(of["marks"] / size),
        root(of["stops"] / size),
        root(of["shouts"] / size),
        root(of["pipes"] / size),
        root(of["digits"] / size),
        np.log1p(len(tally)) / np.log1p(max(1, len(words))),
        root(sum(map(operator.eq, words, words[1:])) / n),
        root(max(tally.values(), default=0) / n),
        np.log1p(len(lines) / n),
        root((len(lines) - len(set(lines))) / (len(lines) + LINES)),
        np.log1p(np.log1p(sum(c * c for c in tally.values()) / n)),
    ]


def features(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row (identity), doc_id and the statistics of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], float)
            x = x.reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(ROW), *map(pa.array, x.T.copy())], names=[ROW, *STATISTICS])

    rows = located(docs, key, text)
    kind = rows.schema[ROW].dataType.simpleString()
    found = rows.mapInArrow(run, f"{ROW} {kind}, " + ", ".join(f"{c} double" for c in STATISTICS))
    return found.select(ROW, F.col(f"{ROW}.doc_id").alias("doc_id"), *STATISTICS)


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor, and the constant of its log-density with the prior."""

    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, priors included."""
        density = []
        for mean, whiten, constant in zip(self.means, self.whiten, self.constants):
            z = (x - mean) @ whiten.T
            density.append(constant - 0.5 * (z * z).sum(1))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def discriminant(n: Sequence[float], sums: np.ndarray, products: np.ndarray, *, towards_pooled: float = TOWARDS_POOLED,
                 towards_diagonal: float = TOWARDS_DIAGONAL) -> Discriminant:
    """The model from the counts, sums and summed outer products of both classes."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 1)
    means = sums / safe[:, None]
    scatter = products - safe[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / max(1.0, n.sum() - 2)
    whiten, constants = [], []
    for k in (0, 1):
        cov = (1 - towards_pooled) * scatter[k] / max(1.0, n[k] - 1) + towards_pooled * pooled
        cov = (1 - towards_diagonal) * cov + towards_diagonal * np.diag(np.diag(cov)) + FLOOR * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        constants.append(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(constants))


def fit(vectors: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality") -> Discriminant:
    """Learn from every labelled vector: one aggregation, two result rows. Labels other than 0 and 1 are left out."""
    p = len(STATISTICS)
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = vectors.join(known, "doc_id").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(STATISTICS)],
        *[F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    n, sums, products = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
    for r in got:
        k = r["label"]
        n[k] = r["n"]
        sums[k] = [r[f"s{i}"] for i in range(p)]
        for i, j in pairs:
            products[k, i, j] = products[k, j, i] = r[f"p{i}_{j}"]
    return discriminant(n, sums, products)


def scored(vectors: DataFrame, model: Discriminant) -> DataFrame:
    """row, doc_id, score."""
    kind = vectors.schema[ROW].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS])
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), pa.array(model.score(x))],
                                             names=[ROW, "doc_id", "score"])

    return vectors.mapInArrow(run, f"{ROW} {kind}, doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, threshold: float = THRESHOLD,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row: row, doc_id, held_out, score, predicted. Learns only from labelled rows that aren't held out.

    Null texts count as empty and get a score like any text; a row without doc_id has no label. Without any label of a class the score
    leans on the prior alone. Repeated rows are scored each. An empty table gives no row.
    """
    vectors = cut(features(docs, key=key, text=text))
    out = fold("doc_id", folds) == held
    model = fit(vectors.where(~out), labels, key="doc_id")
    return scored(vectors, model).select(ROW, "doc_id", out.alias("held_out"), "score",
                                         (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op3_quality_discriminant")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop(ROW)
