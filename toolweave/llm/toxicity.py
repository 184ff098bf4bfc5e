"""Toxicity scores: subword-bag embeddings averaged into a linear softmax.

A text's score is that of its most toxic run of ``window`` words, so that a
few toxic words count alike in short and in long texts; every word of the text
is looked at. The model is trained on a bounded sample of labelled documents
(about ``per_class`` rows of each label, drawn by a hash of the id), whose texts
are read whole whatever their length; few rows take more epochs, and few toxic
ones lower the odds (by 1 + CAUTION / n). n-grams that no training text holds
speak for neither label. Scoring covers all rows.

Defined cases: null text counts as empty; a text without words scores 0; where
one of the two labels has no text with words there is nothing to tell apart and
every score is 0; several labels for one id count as toxic if any is; of equally
toxic runs the first counts, with the same score; rows that repeat get equal
scores; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.llm.common import give_back, map_batches, texts_of
from toolweave.llm.subword import SubwordModel, WordScores, best_run, split_words, text_chunks

#: Chosen by accuracy on a fifth of the training rows (sf0.01, sf0.1), not on the held-out fold.
WINDOW = 3
#: Texts of a step; chosen with the number of epochs by five-fold accuracy on the training rows of sf0.01 (0.933; 0.906 with 64 and up to 40 epochs).
BATCH = 16
PER_CLASS = 2000
#: Rows without a toxic word that count against the toxic training rows: few of these make scores cautious.
CAUTION = 5


def hashed_share(id_col: str, share: float) -> Column:
    """True for about ``share`` of ids, always the same ones."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)) + (share > 0)


class ToxicityModel:
    """What scoring needs: the table of class scores and the bias."""

    def __init__(self, table: WordScores | None, bias: float, window: int):
        self.scores, self.bias, self.window = table, bias, window

    def score(self, texts: list[str]) -> np.ndarray:
        out = []
        for part in text_chunks(texts):
            words = [split_words(t) for t in part]
            if self.scores is None:
                out += [0.0] * len(part)
                continue
            z = self.scores.of([w for ws in words for w in ws])
            z, at = z[:, 1] - z[:, 0], 0
            for w in words:
                logit = best_run(z[at : at + len(w)], self.window)[0] + self.bias if w else -np.inf
                out.append(1 / (1 + np.exp(-max(logit, -700.0))) if w else 0.0)
                at += len(w)
        return np.array(out, np.float64)


def train_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, window: int = WINDOW) -> ToxicityModel:
    """Train on labelled ids for which ``learn`` (a condition on the id column) holds."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = known.filter("label in (0, 1)")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not (counts.get(0) and counts.get(1)):
        return ToxicityModel(None, 0.0, window)
    drawn = known.filter(F.when(F.col("label") == 1, hashed_share("id", per_class / counts[1])).otherwise(hashed_share("id", per_class / counts[0])))
    # at most about 2 x per_class rows of two numbers, so this side may be sent to all executors
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").filter("text is not null")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))  # one row of an id that repeats
    rows = sorted((r["id"], r["text"], r["label"]) for r in texts.collect())
    found = [y for _, t, y in rows if t.strip()]
    if len(set(found)) < 2:
        return ToxicityModel(None, 0.0, window)
    model = SubwordModel(2, window=window)
    # few rows take more rounds, so that training has steps enough
    epochs = min(20, max(5, 20_000 // len(rows)))
    model.fit((split_words(t) for _, t, _ in rows), np.array([y for *_, y in rows]), epochs, BATCH)
    del rows
    give_back()
    bias = float(model.bias[1] - model.bias[0]) - math.log1p(CAUTION / found.count(1))
    return ToxicityModel(model.scorer(trained_only=True), bias, window)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) per row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = model.score(texts_of(batch, 1))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

        return work

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), start, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model does not reject (a score under 0.5).

    Null and empty texts score 0 and stay, rows that repeat stay or go together,
    an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(model.score(texts_of(batch, at)) < 0.5))

        return work

    return map_batches(docs, start, docs.schema)
