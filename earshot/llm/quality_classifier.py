"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a fixed vector of statistics (logarithms and log-odds of shares). Class means and covariances come from
sums over all labelled rows, added up by Spark; a class covariance is shrunk towards the pooled one and its diagonal.
The score compares the two Gaussian log densities; their Cholesky factors are computed once and kept in the model.

Defined cases: a null text is empty; statistics of an empty text are those of no words. Rows without a label teach
nothing; a document with several label rows counts once for each. With one class only, the score is that class's share.
Repeated rows are scored alike. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import id_back, id_text
from earshot.session import materialize

#: Names of the statistics, in the order of the vector.
STATISTICS = ("log_words", "log_word_length", "distinct_share", "top_share", "letter_share", "upper_share",
              "digit_share", "symbol_share", "mark_share", "space_share", "loud_words", "bare_words",
              "repeated_lines", "squeeze", "short_share", "chars_a_line")
SYMBOLS = b"#*$%&|<>@^_~=+\\/"
MARKS = b".,;:!?'\"()-"


def _odds(part: float, total: float) -> float:
    """Log-odds of a share, kept finite by half a case on either side."""
    return float(np.log((part + 0.5) / (total - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The vector of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = len(words), len(text)
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    size = len(raw)
    table = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(table[65:91].sum()), int(table[97:123].sum())
    digits = int(table[48:58].sum())
    symbols, marks = int(table[list(SYMBOLS)].sum()), int(table[list(MARKS)].sum())
    spaces = int(table[[9, 10, 11, 12, 13, 32]].sum())
    high = int(table[128:].sum())
    lines = [x for x in text.split("\n") if x.strip()]
    loud = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    bare = sum(c for w, c in counts.items() if not w[:1].isalnum() and w[0] < 128)
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    squeezed = len(zlib.compress(raw, 1)) if size else 0
    return [float(np.log1p(n)), float(np.log1p((size - spaces) / max(1, n))), _odds(len(counts), n), _odds(top, n),
            _odds(upper + lower + high, size), _odds(upper, upper + lower), _odds(digits, size), _odds(symbols, size),
            _odds(marks, size), _odds(spaces, size), _odds(loud, n), _odds(bare, n),
            _odds(len(lines) - len(set(lines)), len(lines)), float(np.log((squeezed + 20) / (size + 20))),
            _odds(short, n), float(np.log1p(chars / max(1, len(lines))))]


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id` and the vector `x` of each row's whole text."""
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [statistics(t) for t in batch["text"]]})

    rows = docs.select(id_text(doc_id), F.col(text).alias("text"))
    return id_back(rows.mapInPandas(job, "doc_id string, x array<double>"), docs.schema[doc_id].dataType)


@dataclass
class Discriminant:
    """Means, Cholesky factors of the inverse covariances' inverses, log determinants and log priors per class."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        logs = []
        for mean, factor, log_det, prior in zip(self.means, self.factors, self.log_dets, self.log_priors):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(-0.5 * ((z * z).sum(0) + log_det))
        gap = self.temper * (logs[1] - logs[0]) + self.log_priors[1] - self.log_priors[0]
        return 1 / (1 + np.exp(-np.clip(gap, -60, 60)))


def fit(labelled: DataFrame, shrink: float = 0.2, ridge: float = 0.05, temper: float = 0.5) -> Discriminant | float:
    """A model from rows (`x`, `label` 0 or 1), or the share of label 1 if a class has no rows.

    A class covariance is (1 - shrink) times its own plus shrink times the pooled one, then ridge of the pooled
    diagonal is added. `temper` below 1 makes up for statistics that say the same twice.
    """
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = len(STATISTICS)
        sums = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for batch in batches:
            x, y = np.array(batch["x"].tolist()).reshape(-1, d), batch["label"].to_numpy()
            for k, total in sums.items():
                own = x[y == k]
                total += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        rows = [(k, i, v) for k, total in sums.items() for i, v in enumerate(total.tolist())]
        yield pd.DataFrame(rows, columns=["label", "place", "value"])

    d = len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    for r in labelled.select("x", F.col("label").cast("int").alias("label")) \
            .mapInPandas(job, "label int, place int, value double") \
            .groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        total[r["label"], r["place"]] = r["value"]
    counts = total[:, 0]
    if counts.min() < 1:
        return float(counts[1] / counts.sum()) if counts.sum() else 0.5
    means = total[:, 1:1 + d] / counts[:, None]
    scatter = total[:, 1 + d:].reshape(2, d, d) - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / counts.sum()
    own = scatter / counts[:, None, None]
    covariance = (1 - shrink) * own + shrink * pooled + ridge * np.diag(np.diag(pooled) + 1e-6)
    factors = np.linalg.cholesky(covariance)
    log_dets = 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1)
    return Discriminant(means, factors, log_dets, np.log(counts / counts.sum()), temper)


def classify(vectors: DataFrame, model: Discriminant | float, threshold: float = 0.3) -> DataFrame:
    """`vectors` (doc_id, x) with score and predicted."""
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist()).reshape(-1, len(STATISTICS))
            score = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score,
                                "predicted": (score >= threshold).astype(np.int32)})

    scored = vectors.select(id_text("doc_id"), "x").mapInPandas(job, "doc_id string, score double, predicted int")
    return id_back(scored, vectors.schema["doc_id"].dataType)


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def held_out_quality(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; labels of the held fold are never read."""
    vectors = materialize(features(docs))
    held_out = F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False))
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("label_id"),
                                                            F.col("quality").alias("label"))
    model = fit(vectors.where(~held_out).join(known, F.col("doc_id") == F.col("label_id")))
    return classify(vectors, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
