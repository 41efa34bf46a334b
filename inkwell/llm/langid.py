"""Language identification by hierarchical discrimination.

First the family of the language is predicted, then one-versus-one linear support vector machines separate the languages
of that family.  Features are byte bigrams and hashed byte trigrams of the whole text (letters lower-cased, all else one
blank), as shares of the text; a linear machine's margin is then the mean of its weights over the text, read off running
sums for many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASHED, free, slices, table, text_bytes

#: Labelled rows that the machines are fitted on, about as many of each language (all of a language that has no more), and
#: the least that a language gets of them when there are very many.  Rows are chosen by a hash; predictions cover all rows.
SAMPLE, LEAST = 2500, 20
UNDETERMINED = "und"
#: Families of languages by ISO 639-1 code; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt rm ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu se".split(),
    "turkic": "az kk ky tr tt uz".split(),
    "indo-aryan": "bn gu hi mr ne pa ur".split(),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

_CLASS = np.zeros(256, np.uint32)  # 0: blank, 1-26: letters, 32-63: bytes of other scripts
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 32 + (np.arange(128, 256) & 31)
PAIRS, TRIPLES = 4096, 8192
SCALE = 12.0


def features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the bigram and of the trigram that start at each byte."""
    c = np.concatenate([_CLASS[raw], np.zeros(2, np.uint32)])
    pair = c[:-2] << np.uint32(6) | c[1:-1]
    triple = ((pair << np.uint32(6) | c[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(19)
    return pair.astype(np.int64), PAIRS + triple.astype(np.int64)


def vectors(column: pa.Array) -> np.ndarray:
    """Feature shares of each text, scaled, with a constant 1 at the end."""
    raw, offsets = text_bytes(column)
    out = np.zeros((len(column), PAIRS + TRIPLES + 1), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b > a:
            pair, triple = features(raw[a:b])
            out[i, :-1] = np.bincount(np.concatenate([pair, triple]), minlength=PAIRS + TRIPLES) * (SCALE / (b - a))
    out[:, -1] = 1
    return out


def fit_svm(x: np.ndarray, of: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 12) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by dual coordinate descent, on the rows ``of`` of ``x`` (read in
    place: a copy would weigh as much as the sample).  y: +1 or -1."""
    weights, alpha = np.zeros(x.shape[1], np.float64), np.zeros(len(of))
    diagonal = np.array([float(x[row] @ x[row]) for row in of]) + 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(of)):
            row = x[of[i]]
            gradient = y[i] * (row @ weights) - 1 + 0.5 / cost * alpha[i]
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * row
                alpha[i] = new
    return weights


class Discriminator:
    """Machines for each pair of classes; a class's confidence is the mean of its pairwise ones."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.classes = sorted(set(labels[rows].tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.weights = np.zeros((len(self.pairs), x.shape[1]), np.float32)
        for k, (i, j) in enumerate(self.pairs):
            of = rows[(labels[rows] == self.classes[i]) | (labels[rows] == self.classes[j])]
            self.weights[k] = fit_svm(x, of, np.where(labels[of] == self.classes[i], 1.0, -1.0))

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best class and its confidence for rows of margins (one column a pair)."""
        confidence = np.zeros((len(margins), len(self.classes)))
        for k, (i, j) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(np.clip(-3.0 * margins[:, k], -60, 60)))
            confidence[:, i] += p
            confidence[:, j] += 1 - p
        if not self.pairs:
            confidence += 1
        best = confidence.argmax(1)
        return best, confidence[np.arange(len(best)), best] / max(1, len(self.classes) - 1)


class Identifier:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        families = np.array([FAMILY.get(x, x) for x in langs.tolist()], dtype=object)
        self.family = Discriminator(x, families, np.arange(len(x)))
        self.within = [Discriminator(x, langs, np.flatnonzero(families == f)) for f in self.family.classes]
        machines = [self.family, *self.within]
        self.starts = np.cumsum([0, *[len(m.pairs) for m in machines]])
        self.weights = np.ascontiguousarray(np.concatenate([m.weights for m in machines]).T)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = text_bytes(column)
        size = np.maximum(1, np.diff(offsets))
        margins = np.tile(self.weights[-1].astype(np.float64), (len(column), 1))
        if len(raw):
            pair, triple = features(raw)
            # Features run over the end of a text; the last two of each are made anew with blanks behind them.
            for back in (1, 2):
                at = offsets[1:] - back
                at = at[at >= np.maximum(offsets[:-1], 0)]
                c0 = _CLASS[raw[at]]
                c1 = _CLASS[raw[at + 1]] if back == 2 else np.zeros(len(at), np.uint32)
                p = c0 << np.uint32(6) | c1
                pair[at] = p
                triple[at] = PAIRS + (((p << np.uint32(6)) * np.uint32(0x9E3779B1)) >> np.uint32(19)).astype(np.int64)
            for k in range(self.weights.shape[1]):
                own = np.ascontiguousarray(self.weights[:, k]).astype(np.float64)
                sums = np.concatenate([[0.0], np.cumsum(own[pair] + own[triple])])
                margins[:, k] += (sums[offsets[1:]] - sums[offsets[:-1]]) * SCALE / size
        family, sure = self.family.decide(margins[:, : self.starts[1]])
        names, score = np.empty(len(column), object), np.zeros(len(column))
        for f, machine in enumerate(self.within):
            of = np.flatnonzero(family == f)
            if len(of):
                best, inner = machine.decide(margins[of, self.starts[f + 1] : self.starts[f + 2]])
                names[of], score[of] = np.array(machine.classes, dtype=object)[best], sure[of] * inner
        return names, score


#: The columns that ``identify`` adds.
ADDED = ("held_out", "lang_pred", "score")


def choose(labelled: DataFrame, text: str, lang: str, key: str) -> DataFrame | None:
    """lang, text and h of about SAMPLE rows, split evenly over the languages; None if there are no rows.

    A row is chosen by a hash of its key and text, with the chance that its language needs, so no language is missed at any
    size of the table; rows that repeat are one.
    """
    held = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}  # a row a language
    if not held:
        return None
    each = max(LEAST, SAMPLE // len(held))
    chance = F.coalesce(*[F.when(F.col(lang) == k, F.lit(min(1.0, each / n))) for k, n in held.items()])
    h = F.xxhash64(F.lit(11), key, text)
    uniform = F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
    picked = labelled.where(uniform < chance).select(h.alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return picked.groupBy("h", "lang").agg(F.min("text").alias("text"))


def fit(labelled: DataFrame, text: str, lang: str, key: str) -> Identifier | None:
    """Fit on the rows that ``choose`` picks; None if there are none."""
    picked = choose(labelled, text, lang, key)
    if picked is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                x = vectors(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("lang"), pa.array([np.flatnonzero(r).astype(np.int32) for r in x], pa.list_(pa.int32())), pa.array([r[r != 0] for r in x], pa.list_(pa.float32()))], names=["key", "lang", "at", "x"])

    # Sparse vectors of the sample, in a fixed order so that the fit is always the same.
    got = picked.mapInArrow(run, "key long, lang string, at array<int>, x array<float>").toArrow().sort_by([("key", "ascending"), ("lang", "ascending")])
    x = np.zeros((got.num_rows, PAIRS + TRIPLES + 1), np.float32)
    for i, (at, values) in enumerate(zip(got["at"], got["x"], strict=True)):
        x[i, at.values.to_numpy()] = values.values.to_numpy()
    return Identifier(x, np.array(got["lang"].to_pylist(), dtype=object)) if got.num_rows else None


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, names: tuple[str, str, str] = ADDED) -> DataFrame:
    """Every row of ``docs`` with three columns added: whether it is held out, its language and a score.

    Learns from rows with a text, a language and a key whose crc32 (as text) modulo ``folds`` is not 0; a row with a null
    key is held out.  ``und`` with score 0: null texts, texts without letters, and all texts if there is nothing to learn
    from.  A text of any length is read whole.  Repeated rows are kept, and an empty table gives no rows.  Columns of the
    names that are added are replaced; others are kept, whatever they are called.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(True))
    held, predicted, sure = names
    (letters,) = free([*docs.columns, *names], "has_letters")
    docs = docs.drop(*names).withColumn(held, held_out).withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    model = fit(docs.where(~F.col(held) & F.col(letters) & F.col(lang).isNotNull()).select(key, text, lang), text, lang, key)
    shared = spark.sparkContext.broadcast(model)  # its size depends on the number of languages only
    kept = [c for c in docs.columns if c != letters]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in kept) + f", `{predicted}` string, `{sure}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, HASHED):  # features take some 50 bytes for each of these
            found = batch.column(letters).to_numpy(zero_copy_only=False).astype(bool)
            if shared.value is None:
                found = np.zeros(batch.num_rows, bool)
                lang_pred, score = np.empty(batch.num_rows, object), np.zeros(batch.num_rows)
            else:
                lang_pred, score = shared.value.predict(batch.column(text))
            lang_pred[~found], score[~found] = UNDETERMINED, 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(lang_pred, pa.string()), pa.array(score)], names=[*kept, predicted, sure])

    return docs.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
