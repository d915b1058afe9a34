"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - theta_k): all thresholds share the weights w, the thresholds are ordered. Features are the
distinct words of a text (ASCII letters lower-cased) and their beginnings of 4, 5 and 6 bytes. Output: the expected
grade, the chance of each threshold, and the grade itself (how many thresholds are more likely passed than not).

The fit takes at most ``fit_rows`` labelled documents, those with the least hash of their id. Executors count features;
those that are in ``MIN_DF`` of these documents or more and tell toxic texts from others (|z| of ``MIN_Z`` or more) make
up the model, which the driver fits on these features alone. Labels say only whether a text is toxic; grades of toxic texts are graded by how many distinct
telling words they have: more than the median of toxic texts is grade 2, else 1; texts that are not toxic have grade 0.
A column of grades can be given instead.

A null or empty text has no features; with no labels, or of one class only, all weights are 0 and every text has grade
0; rows with a null label are not used, and a document with several labels has the highest. Repeated rows and ties are
scored each for itself; extra columns are not read,
or kept where asked for, but for those named like results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, SEED, U64, Words, chained, documents, mix, slices, tidy

FIT_ROWS, MIN_DF, MIN_Z, L2, STEPS = 40_000, 5, 5.0, 1e-4, 400
#: Texts whose chance of grade 1 or more is this high are rejected.
REJECT_AT = 0.5
PREFIXES = (4, 5, 6)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each) of the distinct features of a slice of texts."""
    w = Words(data, offs, ALNUM, True)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(w.off))
    hashes, rows = [w.hash & ~U64(3)], [row]
    for i, p in enumerate(PREFIXES):
        long = w.ends - w.starts > p
        hashes.append(chained(w.wide, w.starts[long], np.full(int(long.sum()), p), SEED) & ~U64(3) | U64(i + 1))
        rows.append(row[long])
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


@dataclass
class Model:
    """Sorted feature hashes with their weights, and the thresholds in order."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        if not len(self.keys):
            return np.zeros(n)
        h, r = features(data, offs)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        return np.bincount(r[hit], self.weights[at[hit]], n)

    def passed(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def _sums(of: np.ndarray, at: np.ndarray, n: int):
    """A function of values x that gives for each of n groups the sum of x[at] over the cells whose ``of`` is the group."""
    order = np.argsort(of, kind="stable")
    at, size = at[order].astype(np.intp), np.bincount(of, minlength=n)
    some, first = np.flatnonzero(size), (np.cumsum(size) - size)[size > 0]

    def sums(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(some):
            out[some] = np.add.reduceat(x[at], first)
        return out

    return sums


def regress(rows: np.ndarray, cols: np.ndarray, n_cols: int, grade: np.ndarray, n_grades: int, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam on all rows; cells (rows, cols) are 1."""
    n, k = len(grade), n_grades - 1
    p = np.zeros(n_cols + k)
    share = np.array([(grade > i).mean() for i in range(k)])
    theta = -np.log(share / (1 - share))
    p[n_cols] = theta[0]
    p[n_cols + 1 :] = np.log(np.maximum(np.diff(theta), 0.05))
    m, v = np.zeros_like(p), np.zeros_like(p)
    by_row, by_col = _sums(rows, cols, n), _sums(cols, rows, n_cols)
    for step in range(1, steps + 1):
        theta = p[n_cols] + np.concatenate([[0], np.cumsum(np.exp(p[n_cols + 1 :]))])
        s = by_row(p)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        up, lo = (1 / (1 + np.exp(-np.clip(e - s, -40, 40))) for e in (edge[grade + 1], edge[grade]))
        up, lo = np.where(grade == k, 1.0, up), np.where(grade == 0, 0.0, lo)
        prob = np.maximum(up - lo, 1e-9)
        g = np.zeros_like(p)
        g[:n_cols] = by_col(up + lo - 1)
        dt = np.bincount(grade, up * (1 - up) / prob, n_grades)[:k] - np.bincount(grade, lo * (1 - lo) / prob, n_grades)[1:]
        tail = np.cumsum(dt[::-1])[::-1]
        g[n_cols] = tail[0]
        g[n_cols + 1 :] = tail[1:] * np.exp(p[n_cols + 1 :])
        g = -g / n
        g[:n_cols] += l2 * p[:n_cols]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:n_cols], p[n_cols] + np.concatenate([[0], np.cumsum(np.exp(p[n_cols + 1 :]))])


NONE = Model(np.zeros(0, U64), np.zeros(0), np.array([50.0, 51.0]))


def telling(df: np.ndarray, on: np.ndarray, n: float, toxic: float, min_df: int = MIN_DF, min_z: float = MIN_Z) -> np.ndarray:
    """z values of features that are in ``df`` of n texts and ``on`` of the toxic ones; 0 for those not to be used."""
    share = toxic / n
    z = (on - df * share) / np.sqrt(df * share * (1 - share))
    return np.where((df >= min_df) & (np.abs(z) >= min_z), z, 0.0)


def fit_arrays(keys: np.ndarray, z: np.ndarray, row: np.ndarray, cols: np.ndarray, label: np.ndarray, graded: bool) -> Model:
    """Model from labelled texts: feature hashes in order, their z values, cells (row, column), and 0/1 labels or grades."""
    toxic = label > 0
    if not len(keys) or toxic.all() or not toxic.any():
        return NONE
    if graded:
        grade = label
    else:
        hits = np.bincount(row, ((z > 0) & ((keys & U64(3)) == 0))[cols], len(label))
        grade = toxic.astype(int) + (toxic & (hits > np.median(hits[toxic])))
    n_grades = int(grade.max()) + 1
    if len(np.unique(grade)) < n_grades:
        raise ValueError("each grade from 0 to the highest needs a labelled text")
    weights, thresholds = regress(row, cols, len(keys), grade, n_grades)
    return Model(keys, weights, thresholds)


def _counted(batches):
    """Features with how many texts have them, and how many toxic ones; key -1: all texts."""
    for batch in batches:
        toxic = batch.column("_label").to_numpy(zero_copy_only=False) > 0
        for lo, hi, data, offs in slices(batch):
            h, r = features(data, offs)
            keys, cols = np.unique(h, return_inverse=True)
            df, on = np.bincount(cols, minlength=len(keys)), np.bincount(cols, toxic[lo + r], len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(keys.view(np.int64), -1)), pa.array(np.append(df, hi - lo)), pa.array(np.append(on, toxic[lo:hi].sum()).astype(np.int64))], names=["feature", "df", "on"]
            )


def _cells(shared):
    def run(batches):
        keys = shared.value
        for batch in batches:
            for lo, hi, data, offs in slices(batch):
                h, r = features(data, offs)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(r[hit], np.arange(hi - lo + 1)), pa.int32()), pa.array(at[hit].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("_label").slice(lo, hi - lo), lists], names=["label", "cols"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", graded: bool = False, fit_rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """``label`` of ``labels`` is 0/1, or with ``graded`` a grade from 0 on. Executors count features; the driver gets those that tell."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id").select("_label", "text")
    counts = rows.mapInArrow(tidy(_counted), "feature long, df long, on long").groupBy("feature").agg(F.sum("df").alias("df"), F.sum("on").alias("on")).where(F.col("df") >= MIN_DF).toArrow()
    keys, df, on = (counts.column(c).to_numpy() for c in ("feature", "df", "on"))
    every = keys == -1
    if not every.any() or not 0 < on[every][0] < df[every][0]:
        return NONE
    z = np.where(every, 0, telling(df, on, df[every][0], on[every][0]))
    keys, z = keys.view(U64)[z != 0], z[z != 0]
    order = np.argsort(keys)
    keys, z = keys[order], z[order]
    if not len(keys):
        return NONE
    got = rows.mapInArrow(tidy(_cells(docs.sparkSession.sparkContext.broadcast(keys))), "label int, cols array<int>").toArrow()
    sizes = got.column("cols").combine_chunks().value_lengths().to_numpy().astype(int)
    return fit_arrays(keys, z, np.repeat(np.arange(len(sizes)), sizes), got.column("cols").combine_chunks().flatten().to_numpy(), got.column("label").to_numpy().astype(int), graded)


def score(docs: DataFrame, model: Model, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns ``keep`` and severity (expected grade), p_toxic (chance of grade 1 or more), grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("severity", "p_toxic", "grade")]
    name = text if text in keep else "_text"
    src = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("_text"))
    schema = docs.select(*keep).select("*", F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("grade")).schema

    def run(batches):
        model = shared.value
        for batch in batches:
            for lo, hi, data, offs in slices(batch, name):
                p = model.passed(model.scores(data, offs))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(1), pa.int32())], names=[*keep, "severity", "p_toxic", "grade"])

    return src.mapInArrow(tidy(run), schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", "severity", "p_toxic", "grade", (F.col("p_toxic") >= REJECT_AT).alias("toxic"))
