"""Language identification in two levels: the family first, then one-versus-one linear SVMs within it (operator 9)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import Steps, Texts, batch, columns_of, map_slices

# Which languages are closely related. Fixed values; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk ky uz",
    "indic": "hi mr ne bn gu pa ur",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

UNKNOWN = "und"
BITS = 11
ORDERS = (1, 2, 3)
# Most labelled rows, in expectation, that the machines are fitted on: the bound on the training sample.
SAMPLE_ROWS = 6_000
# Rows of a language, in expectation, that the bound never goes below.
LEAST_ROWS = 32
SCALE = 64.0

_SEED = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)  # odd multipliers, one per gram length
_LETTER = regex.compile(r"\p{L}")


def _plain_bytes(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes in which everything ASCII that is no letter is a space."""
    lut = np.full(256, 32, np.uint8)
    lut[97:123] = np.arange(97, 123)
    lut[65:91] = np.arange(97, 123)
    lut[128:] = np.arange(128, 256)
    out = lut[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) > 1 else np.zeros(0, np.int64)
    upper = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    out[upper] += 0x20
    return out


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Bin of the byte gram that starts at each place (the last order - 1 places have none)."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    code = data[:n].astype(np.uint32)
    for i in range(1, order):
        code |= data[i : n + i].astype(np.uint32) << np.uint32(8 * i)
    code *= np.uint32(_SEED[order - 1])
    code ^= code >> np.uint32(15)
    code *= np.uint32(_SEED[order - 2])
    return code >> np.uint32(32 - BITS)


def _frequencies(texts: Texts) -> np.ndarray:
    """Per text the scaled share of each bin; grams do not reach into the next text."""
    size = 1 << BITS
    out = np.zeros((len(texts.starts), size), np.float32)
    for i, (start, end) in enumerate(zip(texts.starts, texts.ends, strict=True)):
        data = _plain_bytes(texts.data[start:end])
        for order in ORDERS:
            found = _grams(data, order)
            if len(found):
                out[i] += np.bincount(found, minlength=size) * (SCALE / len(found))
    return out


def _margins(texts: Texts, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """weights . features + bias for every text and machine, without building the features."""
    out = np.repeat(bias[None, :], len(texts.starts), axis=0)
    data = _plain_bytes(texts.data)
    for order in ORDERS:
        found = _grams(data, order)
        n = np.maximum(texts.sizes - order + 1, 0)
        known = n > 0
        if not known.any():
            continue
        start = texts.starts[known]
        for m in range(weights.shape[0]):
            upto = np.zeros(len(found) + 1)
            np.cumsum(weights[m][found], out=upto[1:])
            out[known, m] += (upto[start + n[known]] - upto[start]) * (SCALE / n[known])
    return out


@dataclass
class LanguageModel:
    """Machines between families and between the languages of each family; a positive margin means the first of the pair."""

    languages: list[str]
    family: dict[str, str]
    family_pairs: list[tuple[str, str]]
    language_pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def _vote(self, names: Sequence[str], pairs: Sequence[tuple[str, str]], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and its confidence: most duels won, then the larger sum of margins."""
        at = {name: i for i, name in enumerate(names)}
        wins, total = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
        least = np.full((len(margins), len(names)), 30.0)
        for (a, b), m in zip(pairs, margins.T, strict=True):
            for name, sign in ((a, 1.0), (b, -1.0)):
                own = sign * m
                wins[:, at[name]] += (own > 0) + 0.5 * (own == 0)
                total[:, at[name]] += np.tanh(own)
                least[:, at[name]] = np.minimum(least[:, at[name]], own)
        best = np.argmax(wins + total / (4 * max(len(names), 1)), axis=1) if len(names) else np.zeros(len(margins), int)
        return best, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(len(margins)), best], -15, 15)))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = Texts.of(column)
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        margins = _margins(texts, self.weights, self.bias) if len(self.weights) else np.zeros((len(column), 0))
        families = sorted(set(self.family.values()))
        cut = len(self.family_pairs)
        best, sure = self._vote(families, self.family_pairs, margins[:, :cut])
        picked = np.empty(len(column), object)
        for f, family in enumerate(families):
            rows = np.flatnonzero(best == f)
            names = [x for x in self.languages if self.family[x] == family]
            own = [i for i, (a, _) in enumerate(self.language_pairs) if self.family[a] == family]
            winner, within = self._vote(names, [self.language_pairs[i] for i in own], margins[rows][:, [cut + i for i in own]])
            picked[rows] = np.array(names, object)[winner]
            sure[rows] *= within
        letters = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
        picked[~letters] = UNKNOWN
        sure[~letters] = 0.0
        return list(picked), sure


def _level(counts: Sequence[int], rows: int) -> float:
    """Rows to take of each language, or all that it has, so that there are at most ``rows`` in all."""
    left, level = rows, 0.0
    for i, n in enumerate(sorted(counts)):
        level = left / (len(counts) - i)
        if n > level:
            break
        left -= n
    return max(level, LEAST_ROWS)


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit the machines on rows with a language and a letter in the text.

    At most ``sample_rows`` rows are used in expectation, or ``LEAST_ROWS`` of each language if that is
    more, picked by a hash of the id: of every language the same number, or all rows if it has fewer. The
    sample's features are written once and each machine is fitted by Spark on the rows of its two sides.
    """
    spark = docs.sparkSession
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull()
    )
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if sum(counts.values()) > sample_rows:
        level = _level(list(counts.values()), sample_rows)
        most = F.create_map(*(v for x, n in counts.items() for v in (F.lit(x), F.lit(int((1 << 30) * min(level / n, 1.0))))))
        labelled = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < most[F.col("lang")])

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        features = _frequencies(Texts.of(rows.column("text")))
        flat = pa.ListArray.from_arrays(np.arange(len(features) + 1, dtype=np.int32) << BITS, features.ravel())
        return batch(lang=rows.column("lang"), x=flat)

    steps = Steps(spark, "language")
    sample = steps.keep(map_slices(labelled.select("text", "lang"), run, "lang string, x array<float>"))
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    family = {x: FAMILY.get(x, x) for x in languages}
    family_pairs = list(combinations(sorted(set(family.values())), 2))
    language_pairs = [(a, b) for a, b in combinations(languages, 2) if family[a] == family[b]]
    weights, bias = [], []
    for group, pairs in ((family, family_pairs), ({x: x for x in languages}, language_pairs)):
        for a, b in pairs:
            sides = {x: 1.0 if group[x] == a else 0.0 for x in languages if group[x] in (a, b)}
            label = F.create_map(*(v for x, y in sides.items() for v in (F.lit(x), F.lit(y))))[F.col("lang")]
            rows = sample.where(F.col("lang").isin(list(sides))).select(label.alias("label"), array_to_vector("x").alias("features"))
            machine = LinearSVC(maxIter=25, regParam=1e-3).fit(rows)
            weights.append(machine.coefficients.toArray())
            bias.append(machine.intercept)
    steps.drop(sample)
    return LanguageModel(
        languages, family, family_pairs, language_pairs, np.array(weights, np.float32).reshape(-1, 1 << BITS), np.array(bias, np.float64)
    )


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (0 to 1, confidence of the weakest duel won on each level).

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing
    could be learnt. Whole texts are read; repeated rows and null ids give a row each; other
    columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2^BITS weights per pair of languages, whatever the data
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        names, score = shared.value.predict(piece.column("text"))
        return batch(id=piece.column("id"), lang_pred=pa.array(names, pa.string()), score=score)

    return map_slices(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.25) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language can be told: not ``und``, and with a score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        names, score = shared.value.predict(piece.column(text_col))
        return piece.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, score, strict=True)], pa.bool_()))

    return map_slices(docs, run, columns_of(docs), text=text_col)
