"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters that aren't letters count as one space, letters as their lower case. Every run of 1 to 3 characters of a text, with a space
before and after it, falls into one of `DIM` buckets. Training counts buckets for each language on a bounded sample of
the labelled rows (`PER_LANGUAGE` each, chosen by a hash of their id); smoothed log-probabilities make a matrix of
languages by buckets, which is broadcast. Its size is fixed by the number of languages. Scoring sums matrix rows over a
batch's n-grams in numpy, text by text; all of each text counts.

`keep_identified` rejects on two grounds, from `TELLING` characters on: no language is likelier than all others together (score), or the
best one explains the n-grams no better than equally likely buckets would (gain), as in texts of a language or script that wasn't learned.

Nulls and texts without a letter are `und` with score 0, as is any text when nothing could be learned. Rows with a null id or label aren't
learned from, but are predicted. Repeated rows get equal results. Ties go to the language that sorts first. More than `MOST_LANGUAGES`
labels raise an error: such a column holds no languages. Other columns pass through; result columns of `identify` and
`classify` replace columns of their names, `keep_identified` keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, renamed

BITS = 15
DIM = 1 << BITS
PER_LANGUAGE = 3000
ORDERS = (1, 2, 3)
ALPHA = 0.1
CHUNK = 1 << 19
UNKNOWN = "und"
#: The matrix has a row of DIM doubles for each.
MOST_LANGUAGES = 256
#: Texts of fewer characters are too short for a low score to say anything.
TELLING = 20
#: Least score and gain of longer ones that are kept.
LEAST_SCORE, LEAST_GAIN = 0.5, 0.0

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: list[np.ndarray] = []


def letters(points: np.ndarray) -> np.ndarray:
    """Code points with letters in lower case and all else as a space."""
    if not _letters:
        plane = [ord(c.lower()[0]) if c.isalpha() else 32 for c in map(chr, range(1 << 16))]
        _letters.append(np.array(plane, np.uint32))
    out = _letters[0][np.minimum(points, 0xFFFF)]
    for at in np.flatnonzero(points > 0xFFFF):
        c = chr(points[at])
        out[at] = ord(c.lower()[0]) if c.isalpha() else 32
    return out


def buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: (buckets of all texts' n-grams, DIM where there is none; where each text begins; texts with letters)."""
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 2 for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    own = letters(points)
    some = np.add.reduceat(own != 32, starts) > 0
    total = np.zeros(len(own), np.uint32)
    for n in ORDERS:
        # a space goes with its neighbours, but runs of spaces tell nothing
        total[: len(own) - n + 1] += own[n - 1 :] * _MULTIPLIERS[n - 1]
        x = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        index = (x >> np.uint32(32 - BITS)).astype(np.int32)
        blank = own == 32
        if n > 1:
            blank = blank.copy()
            blank[:-1] &= own[1:] == 32
        index[blank] = DIM
        for back in range(1, n):
            index[ends - back] = DIM
        yield index, starts, some


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    held, size, at = [], 0, 0
    for i, text in enumerate(column):
        text = text.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, priors: np.ndarray):
        self.languages = languages
        smooth = counts + ALPHA
        self.weights = np.zeros((len(languages), DIM + 1))
        self.weights[:, :DIM] = np.log(smooth / smooth.sum(1, keepdims=True)) if languages else 0
        self.priors = np.log(priors / priors.sum()) if languages else priors

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        return self.judge(column)[:2]

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and gain of each text: how much likelier its n-grams are in that language than if all buckets were equally likely, as a mean of logarithms."""
        names, scores, gains = [], np.zeros(len(column)), np.zeros(len(column))
        for at, texts in _parts(column):
            sums = np.repeat(self.priors[:, None], len(texts), 1)
            some = np.zeros(len(texts), bool)
            count = np.zeros(len(texts))
            for index, starts, some in buckets(texts):
                count += np.add.reduceat(index < DIM, starts)
                for row, weights in zip(sums, self.weights, strict=True):
                    row += np.add.reduceat(weights[index], starts)
            if not self.languages:
                names += [UNKNOWN] * len(texts)
                continue
            best = sums.argmax(0)
            share = 1 / np.exp(sums - sums.max(0)).sum(0)
            names += [self.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
            scores[at : at + len(texts)] = np.where(some, share, 0)
            mean = (sums.max(0) - self.priors[best]) / np.maximum(count, 1)
            gains[at : at + len(texts)] = np.where(some, mean + np.log(DIM), 0)
        return names, scores, gains


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """A model from up to about `per_language` labelled rows of each language."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where(
        "id is not null and text is not null and label is not null"
    )
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{label_col} has more than {MOST_LANGUAGES} values")
    if not sizes:
        return Model([], np.zeros((0, DIM)), np.zeros(0))
    languages = sorted(sizes)
    share = F.create_map(*(F.lit(x) for name in languages for x in (name, min(1.0, per_language / sizes[name]))))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < share[F.col("label")] * F.lit(1 << 30)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for at, texts in _parts(batch.column(0)):
                for index, starts, _ in buckets(texts):
                    for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(index)], strict=True)):
                        sums = held.setdefault(labels[at + i], np.zeros(DIM + 1, np.int64))
                        sums += np.bincount(index[s:e], minlength=DIM + 1)
        for label, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([sums[:DIM].tobytes()], pa.binary())], ["label", "counts"])

    counts = np.zeros((len(languages), DIM), np.int64)
    # the sample is bounded, so are its 8 partitions and their sums
    for r in rows.where(drawn).select("text", "label").repartition(8).mapInArrow(count, "label string, counts binary").collect():
        counts[languages.index(r["label"])] += np.frombuffer(r["counts"], np.int64)
    seen = counts.sum(1) > 0
    languages = [x for x, s in zip(languages, seen, strict=True) if s]
    return Model(languages, counts[seen], np.array([sizes[x] for x in languages], float))


def stays(text: str | None, name: str, score: float, least: float, known: bool, gain: float = np.inf, languages: frozenset[str] | None = None) -> bool:
    """Whether a text is kept.

    It has a letter and, if any language is known, is in one of `languages` (all, if None); from `TELLING` characters
    on its score is at least `least` and its gain at least `LEAST_GAIN`.
    """
    if name == UNKNOWN:
        return not known and any(map(str.isalpha, text or ""))
    if languages is not None and name not in languages:
        return False
    return len(text) < TELLING or score >= least and gain >= LEAST_GAIN


def classify(docs: DataFrame, model: Model, text_col: str = "text", least: float | None = None) -> DataFrame:
    """`docs` with lang_pred and score; given `least`, only documents that stay."""
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(_scored(docs, model, text_col, least, None, True), schema)


def _scored(docs: DataFrame, model: Model, text_col: str, least: float | None, languages: frozenset[str] | None, add: bool):
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x DIM

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            names, scores, gains = shared.value.judge(texts)
            out = batch
            if add:
                out = out.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(scores))
            if least is not None:
                known = bool(shared.value.languages)
                out = out.filter(pa.array([stays(t.as_py(), n, s, least, known, g, languages) for t, n, s, g in zip(texts, names, scores, gains, strict=True)], pa.bool_()))
            yield out

    return step


def held_out(id_col: str = "doc_id"):
    """Rows to test on: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Train on what isn't held out, and predict all: `docs` with held_out, lang_pred and score."""
    model = train(docs.where(~held_out(id_col)))
    return classify(docs.withColumn("held_out", held_out(id_col)), model)


def keep_identified(docs: DataFrame, languages: Iterable[str] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """Documents in a language that the model knows, or in one of `languages`, with their columns as they are.

    Those without letters go, and those of `TELLING` characters whose score or gain is too low. All with letters stay where nothing could be
    learned.
    """
    model = train(docs.where(~held_out()))
    slim, names = renamed(docs)
    return slim.mapInArrow(_scored(slim, model, slim.columns[names.index("text")], least, None if languages is None else frozenset(languages), False), slim.schema).toDF(*names)
