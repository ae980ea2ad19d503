"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (junk: quality 0), 1 (readable but toxic) and 2 (clean). One weight for each hashed text feature is
shared by all grades; ordered thresholds cut the score: P(grade >= k) = sigmoid(score - threshold_k). A document is kept
if P(grade >= 2) is at least ``KEEP``. The model is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of
doc_id; scoring reads every whole text.

Defined cases: a null or empty text has the features of no words and is scored like any other; texts of any length are scored whole; labels
with a null in quality count toxic alone and the reverse, rows with both null are left out; of several labels for a doc_id the
lowest grade counts; of rows that share a labelled doc_id the least text is fitted on; without labelled rows of two grades
there is no model: grades are null and everything is kept. Repeated rows are each scored. ``keep_good`` keeps all columns of the input,
whatever their names; ``rate`` reads doc_id and text alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from millrace.llm.common import documents, release, stored, whole_text

TRAIN_ROWS, KEEP = 8000, 0.8
#: Punctuation taken off words before they are hashed.
MARKS = ".,;:?\"()"
#: Lengths of the word beginnings that are features of their own.
STEMS = (4, 5)
DIMS, GRADES, LEAST_DOCS, STEPS, RIDGE = 1 << 22, 3, 3, 500, 1e-5
#: A feature has a weight if its documents' grades lie so many standard deviations below all documents'. Weights are
#: evidence against a text (never above 0), so that a long text doesn't outweigh its faults by its length.
LEAST_Z = 4.0


def features(text: str) -> np.ndarray:
    """Slots of the distinct words, their beginnings and the text's shape (shares in tenths) below DIMS."""
    raw = text.split()
    words = text.lower().split()
    n = max(1, len(words))
    distinct = {x.strip(MARKS) or x for x in words}
    shape = {
        "again": sum(map(eq, words, words[1:])) / n, "upper": sum(map(str.isupper, raw)) / n, "alpha": sum(map(str.isalpha, raw)) / n,
        "bars": words.count("|") / n, "varied": len(distinct) / n, "pairs": len(set(zip(words, words[1:], strict=False))) / n,
    }
    stems = {f"{x[:k]}\0" for x in distinct for k in STEMS if len(x) > k}
    names = [x.encode() for x in distinct | stems] + [f"\0{k}={int(10 * v)}".encode() for k, v in shape.items()]
    return np.unique(np.fromiter(map(xxh3_64_intdigest, names), np.uint64, len(names)) % np.uint64(DIMS)).astype(np.int32)


@dataclass
class Ordinal:
    """names: the slots that have a weight, ascending; weights: theirs; cuts: ascending thresholds of grades 1 and up."""

    names: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, text: str) -> np.ndarray:
        """P(grade >= k) for k from 1 up."""
        own = features(text)
        at = np.searchsorted(self.names, own)
        at[at == len(self.names)] = 0
        score = self.weights[at[self.names[at] == own]].sum(dtype=np.float64) if len(self.names) else 0.0
        return 1 / (1 + np.exp(-np.clip(score - self.cuts, -40, 40)))


def cuts_of(t: np.ndarray) -> np.ndarray:
    """Ascending thresholds of free numbers: the first, and the logarithms of the steps between them."""
    return np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])


def slope(w: np.ndarray, t: np.ndarray, row: np.ndarray, col: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log likelihood of ``grades`` and its gradient by ``w`` and ``t``; document row[i] has feature col[i]."""
    n, k = len(grades), len(t)
    score = np.bincount(row, weights=w[col], minlength=n)
    p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts_of(t), -40, 40)))  # P(grade >= 1 and up)
    edge = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
    own = np.maximum(edge[np.arange(n), grades] - edge[np.arange(n), grades + 1], 1e-12)
    steep = p * (1 - p) / own[:, None]
    level = np.arange(1, k + 1)[None, :]
    touch = (np.where(level == grades[:, None] + 1, steep, 0) - np.where(level == grades[:, None], steep, 0)) / n
    by_cut = -touch.sum(axis=0)
    by_t = np.concatenate([[by_cut.sum()], [by_cut[j:].sum() * np.exp(t[j]) for j in range(1, k)]])
    return float(-np.log(own).mean()), np.bincount(col, weights=touch.sum(axis=1)[row], minlength=len(w)), by_t


def fit(names: np.ndarray, row: np.ndarray, col: np.ndarray, grades: np.ndarray, steps: int = STEPS) -> Ordinal:
    """Full-batch Adam on the ordinal likelihood; document row[i] has the slot names[col[i]]."""
    w, k = np.zeros(len(names)), GRADES - 1
    share = np.array([np.clip((grades >= g).mean(), 1e-3, 1 - 1e-3) for g in range(1, GRADES)])
    start = -np.log(share / (1 - share))
    t = np.concatenate([start[:1], np.log(np.maximum(1e-3, np.diff(start)))])
    m1, m2 = np.zeros(len(w) + k), np.zeros(len(w) + k)
    for step in range(1, steps + 1):
        _, by_w, by_t = slope(w, t, row, col, grades)
        g = np.concatenate([by_w + RIDGE * w, by_t])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, t = np.minimum(w - move[: len(w)], 0), t - move[len(w) :]
    return Ordinal(names.astype(np.int32), w.astype(np.float32), cuts_of(t))


def graded(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Ordinal | None:
    """The model of at most ``most`` labelled documents.

    Features are counted and chosen on the executors; the driver gets the grades and the chosen features of the sample's
    documents. Of rows that share a doc_id the least text is taken.
    """
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    slots = F.pandas_udf(lambda s: s.map(features), "array<int>")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = read.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    sample = stored(rows.select("doc_id", "grade", slots("text").alias("f")), "sample")
    have = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a grade
    if len(have) < 2:
        release(sample)
        return None
    total = sum(have.values())
    each = sample.select("doc_id", "grade", F.explode("f").alias("slot"))
    high = {g: F.sum((F.col("grade") >= g).cast("long")).alias(f"high{g}") for g in range(1, GRADES)}
    counted = each.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), *high.values()).where(F.col("n") >= LEAST_DOCS)
    means = {g: min(max(sum(n for k, n in have.items() if k >= g) / total, 1e-3), 1 - 1e-3) for g in high}
    z = [(F.col("n") * m - F.col(f"high{g}")) / F.sqrt(F.col("n") * (m * (1 - m))) for g, m in means.items()]
    picked = each.join(counted.where(F.greatest(*z) >= LEAST_Z).select("slot"), "slot").select("doc_id", "slot").toArrow()
    graded_docs = sample.select("doc_id", "grade").toArrow()
    release(sample)
    ids, order = np.unique(graded_docs["doc_id"].to_numpy(), return_index=True)
    names, col = np.unique(picked["slot"].to_numpy(), return_inverse=True)
    return fit(names, np.searchsorted(ids, picked["doc_id"].to_numpy()), col, graded_docs["grade"].to_numpy()[order].astype(np.int64))


def scored(spark: SparkSession, model: Ordinal | None) -> Column:
    """A struct of expected_grade, p_clean and keep, of the column ``text``."""
    if model is None:
        return F.struct(F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("p_clean"), F.lit(True).alias("keep"))
    shared = spark.sparkContext.broadcast(model)  # the weights of the chosen features

    def run(s: pd.Series) -> pd.DataFrame:
        tails = np.array([shared.value.tails(x) for x in s]).reshape(-1, GRADES - 1)
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_clean": tails[:, -1], "keep": tails[:, -1] >= KEEP})

    return F.pandas_udf(run, "expected_grade double, p_clean double, keep boolean")(whole_text())


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade (0 to 2), p_clean (P(grade >= 2)) and keep, per row of ``docs``."""
    model = train(docs, labels)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(docs.sparkSession, model).alias("s")).select("doc_id", "s.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model keeps, as they are."""
    model = train(docs, labels)
    return docs.where(scored(docs.sparkSession, model)["keep"])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
