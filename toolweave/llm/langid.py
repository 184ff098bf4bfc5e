"""Language identification: averaged hashed subword embeddings, linear softmax.

Trained by stochastic gradient descent in numpy on a bounded sample of labelled
documents, drawn by a hash of the id: of every language about ``per_language``
rows, fewer where there are more than SAMPLE / ``per_language`` languages, whose
texts are read whole whatever their length. Beside the languages the softmax
has a class for texts of no known language, learned from the sample's own texts
with their letters dealt anew. The number of epochs falls with the sample's size.

A fifth of the sample is held back to calibrate: a temperature for the
probabilities, and the probability below which a prediction is rejected. It is
chosen on the held-back texts and as many with their letters dealt anew, so that
of the accepted ones a share of ``precision`` are texts of their language.

Defined cases: a null text, or one without a letter (Unicode category L), is
``und`` with score 0; every other text gets the likeliest language, the first by
name where several are; if nothing can be learned every text is ``und``; a
single language is told from the class without language only; texts are read
whole.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.llm.common import map_batches
from toolweave.llm.subword import SubwordModel, split_words, text_chunks

PER_LANGUAGE = 600
#: Training rows of all languages together, at least one of each.
SAMPLE = 120_000
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is of Unicode category L."""
    return any(map(str.isalpha, text or ""))


def dealt_anew(text: str, seed: int) -> str:
    """The text with its letters in another order, all else in place: a text of no known language."""
    letters = [c for c in text if c.isalpha()]
    random.Random(seed).shuffle(letters)
    rest = iter(letters)
    return "".join(next(rest) if c.isalpha() else c for c in text)


class LanguageModel:
    """Scores of the languages ``names`` and, as the last class, of no known language."""

    def __init__(self, names: list[str], model: SubwordModel | None):
        self.names, self.temperature, self.reject_below = names, 1.0, 0.0
        self.scores, self.bias = (model.scorer(trained_only=True), model.bias) if model else (None, np.zeros(len(names) + 1))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Class scores per text; NaN where a text has no letter."""
        out = np.full((len(texts), len(self.names) + 1), np.nan)
        if self.scores is None:
            return out
        at = 0
        for part in text_chunks([t or "" for t in texts]):
            words = [split_words(t) if has_letter(t) else [] for t in part]
            z, k = self.scores.of([w for ws in words for w in ws]), 0
            for i, w in enumerate(words, at):
                if w:
                    out[i] = z[k : k + len(w)].mean(0, dtype=np.float64) + self.bias
                    k += len(w)
            at += len(part)
        return out

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        z = self.logits(texts) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, calibrated probability, accepted) per text."""
        p = self.probabilities(texts)[:, :-1]
        known = ~np.isnan(p).any(1) & (p.shape[1] > 0)
        if not known.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), known
        p = np.where(known[:, None], p, 0.0)
        best, score = p.argmax(1), p.max(1)
        return [self.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score, known & (score >= self.reject_below)

    def calibrate(self, texts: list[str], truth: np.ndarray, precision: float) -> None:
        z = self.logits(texts)
        if not len(z):
            return

        def loss(t: float) -> float:
            s = z / t - (z / t).max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

        self.temperature = min(np.geomspace(0.02, 20, 60).tolist(), key=loss)
        p = self.probabilities(texts)[:, :-1]
        order = np.argsort(-p.max(1), kind="stable")
        right = np.cumsum((p.argmax(1) == truth)[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        self.reject_below = float(p.max(1)[order][good[-1]]) if len(good) else 1.0


def train_language(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, precision: float = 0.99) -> LanguageModel:
    """Train on rows with a language for which ``learn`` holds."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & learn)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([], None)
    each = max(1, min(per_language, SAMPLE // len(counts)))
    shares = rows.sparkSession.createDataFrame([(lang, int(min(1.0, each / n) * (1 << 20)) + 1) for lang, n in counts.items()], "lang string, share long")
    drawn = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) < F.col("share"))
    drawn = drawn.groupBy("id").agg(F.min(F.struct("text", "lang")).alias("r"))  # one row of an id that repeats
    sample = sorted((r["id"] is None, r["id"] or 0, r["r"]["text"], r["r"]["lang"]) for r in drawn.collect())
    sample = [r for r in sample if has_letter(r[2])]
    names = sorted({r[3] for r in sample})
    if not names:
        return LanguageModel([], None)
    number = {n: i for i, n in enumerate(names)}
    truth = np.array([number[r[3]] for r in sample], np.int64)
    back = np.array([zlib.crc32(f"held {r[1]}".encode()) % 5 == 0 for r in sample], bool)
    back[np.isin(truth, np.setdiff1d(truth, truth[~back]))] = False  # a language all of whose rows would be held back is learned
    texts = [r[2] for r in sample]
    # a share of the texts, as many as a language has on average, stands for no known language
    every = len(names)
    foreign = np.array([zlib.crc32(f"dealt {r[1]}".encode()) % every == 0 for r in sample], bool)
    foreign |= foreign.sum() == 0
    fit = [(t, c) for t, c, b in zip(texts, truth, back, strict=True) if not b]
    fit += [(dealt_anew(t, i), len(names)) for i, (t, b, f) in enumerate(zip(texts, back, foreign, strict=True)) if f and not b]
    model = SubwordModel(len(names) + 1, bits=15, width=8, longest=4)
    model.fit((split_words(t) for t, _ in fit), np.array([c for _, c in fit]), epochs=min(10, max(2, 4000 // len(sample))))
    out = LanguageModel(names, model)
    held = [t for t, b in zip(texts, back, strict=True) if b]
    out.calibrate(held + [dealt_anew(t, -1 - i) for i, t in enumerate(held)], np.append(truth[back], np.full(len(held), len(names))), precision)
    return out


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) per row; ``accepted`` is false where the calibrated rejection applies.

    Rows that repeat get equal results; an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, score, accepted = model.predict(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], ["id", "lang_pred", "score", "accepted"])

        return work

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), start, f"id {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_col)
