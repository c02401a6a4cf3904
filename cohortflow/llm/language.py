"""Language identification, words first.

A word that the model knows adds its log frequency in each language. A word that it doesn't know is read as character
n-grams: at each place the longest n-gram that the model knows counts, from five characters down to one, each step down at a
discount.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, cut, fold, located, query, table
from .encoding import _slices

UNKNOWN = "und"
WORDS = 20_000  # known words per language
SAMPLE = 20_000  # documents per language that a model is fitted on, about; picked by a hash of doc_id
ORDERS = (5, 4, 3, 2, 1)
STEP_DOWN = 0.4  # factor for each character less than the longest n-gram
SMOOTH = 0.5
MEMO = 400_000  # words whose scores one Python worker remembers, about 80 MB

_LETTERS = regex.compile(r"\p{L}+")  # characters whose category is a letter; not such as ½ or Ⅷ
# ASCII letters lowered, other ASCII characters blank, bytes of other characters as they are
_BLANKED = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def stretches(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and other non-ASCII characters, lower case; `words_in` finds the words in them."""
    if not text.isascii():
        text = text.decode().lower().encode()
    return text.translate(_BLANKED).split()


def words_in(stretch: bytes) -> list[str]:
    return _LETTERS.findall(stretch.decode())


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over ``text``; each task adds up its own first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                total[lang].update(stretches(text))
            if sum(map(len, total.values())) > 300_000:
                yield from _counted(total)
                total.clear()
        yield from _counted(total)

    return docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long") \
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counted(total: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, tally in total.items():
        words: Counter = Counter()
        for s, n in tally.items():
            for w in words_in(s):
                words[w] += n
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()),
                                          pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])


class Model:
    """Log frequencies of words and n-grams per language, as rows of one table; at most `WORDS` words a language, and their
    n-grams. A row is less its mean over the languages, an n-gram's also discounted."""

    def __init__(self, langs: Sequence[str], words: dict[str, int], grams: dict[str, int], rows: np.ndarray) -> None:
        self.langs, self.words, self.grams, self.rows = list(langs), words, grams, rows

    def places(self, word: str) -> list[int]:
        """Rows that add up to a word's score: its own, or those of the longest known n-gram at each place."""
        if (known := self.words.get(word)) is not None:
            return [known]
        marked, found, grams = f"<{word}>", [], self.grams
        for i in range(len(marked)):
            for order in ORDERS:
                if (g := grams.get(marked[i:i + order])) is not None:
                    found.append(g)
                    break
        return found

    def unseen(self, word: str) -> tuple[int, int]:
        """Places where an n-gram of four characters fits (at least one a word), and how many of them hold none that the model
        knows. A known word has none."""
        marked, grams = f"<{word}>", self.grams
        places = max(1, len(marked) - 3)
        if word in self.words:
            return places, 0
        if len(marked) < 4:
            return places, 1
        return places, sum(marked[i:i + 5] not in grams and marked[i:i + 4] not in grams for i in range(places))

    def word(self, word: str) -> np.ndarray:
        """Score of a word in each language."""
        return self.rows[self.places(word)].sum(0)


def model_of(counts: Sequence[tuple[str, str, int]]) -> Model:
    """From (lang, word, n) of the known words."""
    langs = sorted({c[0] for c in counts})
    place = {x: k for k, x in enumerate(langs)}
    words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    for lang, word, n in counts:
        words[word][place[lang]] += n
        marked = f"<{word}>"
        for order in ORDERS:
            for i in range(len(marked) - order + 1):
                grams[marked[i:i + order]][place[lang]] += n

    tables = [words, *({g: v for g, v in grams.items() if len(g) == order} for order in ORDERS)]
    weights = [1.0, *(STEP_DOWN ** (ORDERS[0] - order) / order for order in ORDERS)]
    rows, names = [np.zeros((0, len(langs)))], []
    for tallies, weight in zip(tables, weights):
        if tallies:
            x = np.array(list(tallies.values()))
            x = np.log(x + SMOOTH) - np.log(x.sum(0) + SMOOTH * len(x))
            rows.append(weight * (x - x.mean(1, keepdims=True)))
        names += tallies
    known = len(words)
    return Model(langs, {w: k for k, w in enumerate(names[:known])},
                 {g: k + known for k, g in enumerate(names[known:])}, np.concatenate(rows))


def fit(docs: DataFrame, *, lang: str = "lang", text: str = "text", key: str = "doc_id", words: int = WORDS,
        sample: int = SAMPLE) -> Model:
    """Learn from the rows with a language and a text. At most ``words`` rows a language reach the driver; words of equal count
    are taken all or none."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL")
    share = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    counts = cut(word_counts(rows.join(F.broadcast(share), "lang").where(drawn)))
    sizes = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("words"))  # one row per count that occurs
    upto = F.sum("words").over(W.partitionBy("lang").orderBy(F.desc("n")))
    least = sizes.withColumn("upto", upto).where(F.col("upto") <= words).groupBy("lang").agg(F.min("n").alias("least"))
    known = counts.join(least, "lang").where("n >= least")
    return model_of([(r["lang"], r["word"], r["n"]) for r in known.collect()])


class Predictor:
    """Predicts with a memo of word scores."""

    def __init__(self, model: Model, memo: int = MEMO) -> None:
        self.model, self.limit = model, memo
        self.memo: dict[bytes, int] = {}
        self.rows = np.zeros((1024, len(model.langs) + 3))

    def predict(self, texts: Sequence[bytes | None]) -> tuple[list[str], list[float]]:
        best = [self.best(total) for total in self.totals(texts)]
        return [lang for lang, _ in best], [score for _, score in best]

    def totals(self, texts: Sequence[bytes | None]) -> Iterator[np.ndarray]:
        """Per text: its score in each language, its words, the places of its words and how many of them are unseen."""
        for part in _slices(texts):
            found = [stretches(t) if t else [] for t in part]
            fresh: set[bytes] = set()
            for ws in found:
                fresh.update(itertools.filterfalse(self.memo.__contains__, ws))
            if len(self.memo) + len(fresh) > self.limit:
                self.memo = {}
                fresh = set().union(*found)
            self._learn(fresh)
            place = self.memo.__getitem__
            for ws in found:
                yield self.rows[np.fromiter(map(place, ws), np.int64, len(ws))].sum(0)

    def _learn(self, fresh: set[bytes]) -> None:
        need = len(self.memo) + len(fresh)
        if need > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros((need, self.rows.shape[1]))))
        first, places, begins, rows = len(self.memo), [], [], []
        for k, s in enumerate(fresh, first):
            self.memo[s] = k
            words = words_in(s)
            before = len(places)
            seen = np.zeros(2)
            for w in words:
                places += self.model.places(w)
                seen += self.model.unseen(w)
            self.rows[k, -3:] = len(words), *seen
            if len(places) > before:
                begins.append(before)
                rows.append(k)
        self.rows[first:first + len(fresh), :-3] = 0
        if rows:  # each stretch is summed by itself, so its score doesn't depend on what else is new
            self.rows[rows, :-3] = np.add.reduceat(self.model.rows[places], begins, axis=0)

    def best(self, total: np.ndarray) -> tuple[str, float]:
        if not total[-3] or not self.model.langs:
            return UNKNOWN, 0.0
        scores = total[:-3]
        e = np.exp(scores - scores.max())
        k = int(e.argmax())
        return self.model.langs[k], float(e[k] / e.sum())

    def evidence(self, total: np.ndarray) -> tuple[float, float]:
        """Lead of the best language over the next per word, and the share of places that are unseen. Neither grows with the
        text. (0, 1) without a word; with one language its lead counts over 0, which is its mean."""
        if not total[-3] or not self.model.langs:
            return 0.0, 1.0
        first, second = np.sort(np.append(total[:-3], 0.0) if len(total) == 4 else total[:-3])[:-3:-1]
        return float((first - second) / total[-3]), float(total[-1] / total[-2])


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row: row, doc_id, lang_pred, score (its share among the languages), margin and unseen (`Predictor.evidence`).

    A null text, or one without a letter, is ``und`` with score 0; so is every text if no language was learned. Ties go to the
    first language by name. Repeated rows are predicted each. An empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value  # the same object for all tasks of a worker, which so share the memo
        predictor = model.__dict__.setdefault("predictor", Predictor(model))
        for batch in batches:
            found = [(*predictor.best(total), *predictor.evidence(total))
                     for total in predictor.totals(batch.column("text").cast(pa.binary()).to_pylist())]
            langs, *numbers = zip(*found) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(langs, pa.string()),
                                              *(pa.array(x, pa.float64()) for x in numbers)],
                                             names=[ROW, "lang_pred", "score", "margin", "unseen"])

    rows = located(docs, key, text)
    kind = rows.schema[ROW].dataType.simpleString()
    return rows.mapInArrow(run, f"{ROW} {kind}, lang_pred string, score double, margin double, unseen double").select(
        ROW, F.col(f"{ROW}.doc_id").alias("doc_id"), "lang_pred", "score", "margin", "unseen")


@query("op5_language_backoff")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = fold("doc_id", 4) == 2
    found = identify(docs, fit(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
