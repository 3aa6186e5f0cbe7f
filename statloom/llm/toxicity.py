"""Toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import Scratch, fresh_name, table

_WORD = regex.compile(r"\p{L}+")


def features(text: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features: each distinct lower-cased word, hashed,
    with 1 + ln(count). Values aren't scaled by length: a slur in a long text stays one."""
    counts: dict[str, int] = {}
    for w in _WORD.findall(text.lower()):
        counts[w] = counts.get(w, 0) + 1
    at = np.fromiter((xxhash.xxh32_intdigest(w) % dims for w in counts), np.int64, len(counts))
    return at, 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class OrdinalModel:
    """P(grade >= k) = sigmoid(w . x - cut_k) with one w and rising cuts, k = 1 to grades - 1."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, dims: int, grades: int, l2: float = 0.5, rounds: int = 300) -> OrdinalModel:
        """Full-batch Adam on the cumulative-link likelihood with a ridge on w. Cuts are a
        first one and positive steps. Features of one row only get no weight. No rows: no
        weights and cuts that say grade 0."""
        w, first, steps = np.zeros(dims), 2.0, np.zeros(grades - 2)
        if len(rows):
            sizes = np.array([len(a) for a, _ in rows])
            row = np.repeat(np.arange(len(rows)), sizes)
            at = np.concatenate([a for a, _ in rows])
            val = np.concatenate([v for _, v in rows])
            often = np.bincount(at, minlength=dims) > 1
            keep = often[at]
            row, at, val = row[keep], at[keep], val[keep]
            m, v = np.zeros(dims + grades - 1), np.zeros(dims + grades - 1)
            for t in range(1, rounds + 1):
                cuts = first + np.concatenate(([0.0], np.cumsum(np.exp(steps))))
                score = np.bincount(row, val * w[at], minlength=len(rows))
                above = _sigmoid(score[:, None] - cuts)  # P(grade >= 1), ...
                edges = np.concatenate((np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))), axis=1)
                p = np.maximum(edges[np.arange(len(rows)), grade] - edges[np.arange(len(rows)), grade + 1], 1e-9)
                slope = np.concatenate((np.zeros((len(rows), 1)), above * (1 - above), np.zeros((len(rows), 1))), axis=1)
                up, down = slope[np.arange(len(rows)), grade], slope[np.arange(len(rows)), grade + 1]
                d_score = -(up - down) / p
                d_cut = np.zeros(grades - 1)
                for k in range(1, grades):
                    d_cut[k - 1] = (up / p)[grade == k].sum() - (down / p)[grade == k - 1].sum()
                g = np.concatenate((np.bincount(at, val * d_score[row], minlength=dims) + l2 * w, [d_cut.sum()], [np.exp(steps[k]) * d_cut[k + 1 :].sum() for k in range(grades - 2)]))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                w, first, steps = w - move[:dims], first - move[dims], np.clip(steps - move[dims + 1 :], -3, 3)
        return cls(w.astype(np.float32), first + np.concatenate(([0.0], np.cumsum(np.exp(steps)))))

    def score(self, text: str) -> tuple[float, np.ndarray]:
        """(expected severity, P(grade >= k) for each k)."""
        at, val = features(text, len(self.weights))
        above = _sigmoid(float((self.weights[at] * val).sum()) - self.cuts)
        return float(above.sum()), above


def sample(docs: DataFrame, labels: DataFrame, grade: str, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, grade) of at most ``most`` labelled documents: those whose id has the
    smallest hash, half of them of grade 0 where there are enough others. Of several labels
    of a document the highest grade counts; of rows that repeat an id, the least text."""
    known = labels.where(F.col(grade).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(grade).cast("int")).alias("grade"))
    order = [F.xxhash64("id"), F.col("id")]
    # Two orderBy-limits: top-k with a heap per task, never a full sort.
    bad = known.where("grade > 0").orderBy(*order).limit(most // 2)
    good = known.where("grade = 0").orderBy(*order).limit(most // 2)
    ids = bad.unionByName(good)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(ids), "id")  # most rows at most
    return found.groupBy("id", "grade").agg(F.min("text").alias("text")).select("id", "text", "grade")


def train(docs: DataFrame, labels: DataFrame, grade: str = "grade", grades: int = 3, dims: int = 1 << 16, most: int = 6000, most_features: int = 2_000_000, **options) -> OrdinalModel:
    """The model from a bounded sample of labels of grade 0 to ``grades`` - 1: at most
    ``most`` documents, and of these, in order of their ids' hashes, as many as have
    ``most_features`` features (a document's distinct words) together. Features are made on
    the executors; eight bytes each come to the driver."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    given = sample(docs, labels, grade, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [features(t.as_py(), dims) for t in b.column(1)]
            cols = [b.column(0), b.column(2), pa.array([len(a) for a, _ in both], pa.int64()), pa.array([a for a, _ in both], pa.list_(pa.int32())), pa.array([v for _, v in both], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "grade", "size", "at", "val"])

    kind = given.schema["id"].dataType.simpleString()
    rows = scratch.put(given.mapInArrow(run, f"id {kind}, grade int, size long, at array<int>, val array<float>"))
    # At most ``most`` rows: one window over them is a small one.
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    got = rows.withColumn("upto", upto).where(F.col("upto") <= most_features).toArrow().sort_by("id")
    chunks = [(np.asarray(a.values).astype(np.int64), np.asarray(v.values).astype(np.float64)) for a, v in zip(got["at"], got["val"])]
    grade_of = np.clip(got["grade"].to_numpy().astype(np.int64), 0, grades - 1)
    scratch.drop(rows)
    return OrdinalModel.fit(chunks, grade_of, dims, grades, **options)


def score_toxicity(docs: DataFrame, model: OrdinalModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds severity (expected grade), p_toxic (of grade 1 or more) and toxic (that is
    0.5 or more) to the columns ``keep`` (all by default; columns of those names are
    replaced). Null and empty texts have no features: their scores are the cuts'. The
    model is broadcast; its size is the number of dimensions."""
    new = ("severity", "p_toxic", "toxic")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    raw = fresh_name(keep, "raw")
    given = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(raw))
    schema = docs.select(*keep, F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(True).alias("toxic")).schema
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [held.value.score(t.as_py()) for t in b.column(b.num_columns - 1)]
            p = np.array([above[0] for _, above in scores], dtype=np.float64)
            cols = [*b.columns[:-1], pa.array([s for s, _ in scores], pa.float64()), pa.array(p), pa.array(p >= 0.5)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *new])

    return given.mapInArrow(run, schema)


def severity_labels(labels: DataFrame) -> DataFrame:
    """Grades from the tables' labels: 0 clean, 1 toxic, 2 toxic and of low quality."""
    toxic = F.col("toxic") == 1
    return labels.select("doc_id", F.when(toxic & (F.col("quality") == 0), 2).when(toxic, 1).when(F.col("toxic") == 0, 0).alias("grade"))


def op5_query(spark, sf_dir):
    """Expected severity, chance and verdict of each document; see ``score_toxicity``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, severity_labels(table(spark, sf_dir, "labels")))
    out = score_toxicity(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.round("severity", 6).alias("severity"), F.round("p_toxic", 6).alias("p_toxic"), "toxic")
