"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed word and word-beginning features is fitted from
confirmed toxic texts and unlabelled texts alone.  Its risk is
``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))``: where the bracket turns negative,
the step goes against it (Kiryo et al., 2017).  ``pi``, the share of toxic texts,
comes from the training labels.

Defined results: a null or empty text has no feature and scores as the bias says;
words repeated in a text count once; labels of absent documents are unused; rows
with a null doc_id are scored but never trained on; without one positive training
row every score is 0.  The model sees texts only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm import memory, wordhash as wh

BITS = 20
#: Bytes of a word's beginning that make a feature of their own.
HEADS = (4, 6)
THRESHOLD = 0.7
#: Bounds of the training sample (rows); scoring has none.
MAX_POSITIVE = 3000
MAX_UNLABELLED = 12000


def word_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words (whole word, beginnings), and each one's text."""
    lowered = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    letters = lowered.copy()
    # ASCII punctuation separates words too, so "idiot." and "idiot" agree
    letters[(lowered < 48) | ((lowered > 57) & (lowered < 97)) | ((lowered > 122) & (lowered < 128))] = 32
    starts, ends, word_offs = wh.words(letters, offs)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(word_offs))
    parts = [wh.word_hashes(letters, starts, ends)]
    owners = [owner]
    for n in HEADS:
        long = ends - starts > n
        parts.append(wh.mix(wh.word_hashes(letters, starts[long], starts[long] + n) + np.uint64(n)))
        owners.append(owner[long])
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(owners)


@dataclass
class Model:
    """Nonzero weights of a fitted classifier (at most ``2 ** BITS``)."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.index] = self.weight
        return w


def score_texts(w: np.ndarray, bias: float, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    feature, owner = word_features(data, offs)
    hit = np.flatnonzero(w[feature])
    pair = np.unique(owner[hit].astype(np.int64) << BITS | feature[hit])
    total = np.bincount(pair >> BITS, w[pair & ((1 << BITS) - 1)].astype(np.float64), n) + bias
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(features: list[np.ndarray], positive: np.ndarray, prior: float, epochs: int = 120, rate: float = 0.1, sparse: float = 0.0115, least: int = 3) -> Model:
    """Fit by full-gradient proximal Adam.  ``positive`` marks confirmed rows, the rest is unlabelled.

    The L1 weight is ``sparse`` over the square root of the row count, as for a lasso of that sample size.
    """
    sparse = sparse / max(len(features), 1) ** 0.5
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    if not n_pos:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    col, nz = np.unique(np.concatenate(features), return_inverse=True)
    often = np.bincount(nz) >= least
    keep = often[nz]
    row, nz, col = row[keep], (np.cumsum(often) - 1)[nz[keep]], col[often]
    w, bias = np.zeros(len(col)), 0.0
    m1, m2 = np.zeros(len(col) + 1), np.zeros(len(col) + 1)
    for t in range(1, epochs + 1):
        z = np.clip(np.bincount(row, w[nz], len(features)) + bias, -40, 40)
        s = 1 / (1 + np.exp(-z))  # logistic loss: l(z, +) = log(1 + e^-z), l(z, -) = log(1 + e^z)
        as_negative = np.logaddexp(0, z)
        lack = as_negative[~positive].mean() - prior * as_negative[positive].mean() if n_unl else 0.0
        side = np.where(positive, -prior / n_pos, 1 / max(n_unl, 1)) * s
        g = np.where(positive, -prior / n_pos, 0.0) * (1 - s) + side if lack >= 0 else -side
        grad = np.append(np.bincount(nz, g[row], len(col)), g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-5)
        scale = rate / (np.sqrt(m2[:-1] / (1 - 0.99**t)) + 1e-5)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - scale * sparse, 0)
        bias -= step[-1]
    used = np.flatnonzero(w)
    return Model(col[used].astype(np.int64), w[used], bias)


def fold(doc_id) -> "F.Column":
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, held_out: int = 1, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit from rows outside fold ``held_out``.  At most ``max_positive`` toxic and ``max_unlabelled`` other rows, picked by a hash of the id."""
    learn = labels.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != held_out) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    counts = learn.agg(F.count("*").alias("n"), F.count(F.when(F.col("toxic") == 1, 1)).alias("p")).first()
    prior = min(max(counts["p"] / max(counts["n"], 1), 1e-3), 0.5)
    picked = learn.where("toxic = 1").orderBy(order).limit(max_positive).select("doc_id", F.lit(True).alias("positive"))
    # unlabelled text: any training-fold document, whatever its label, which is not looked at
    open_ids = docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != held_out)).select("doc_id").orderBy(order, "doc_id").limit(max_unlabelled).select("doc_id", F.lit(False).alias("positive"))
    ids = picked.unionByName(open_ids)  # at most max_positive + max_unlabelled rows: a fixed bound

    @memory.task("toxicity")
    def extract(batches):
        for batch in batches:
            for part in wh.slices(batch):
                data, offs = wh.text_buffers(part.column("text"))
                feature, owner = word_features(data, offs)
                pair = np.unique(owner.astype(np.int64) << BITS | feature)
                cut = np.searchsorted(pair, np.arange(part.num_rows + 1, dtype=np.int64) << BITS)
                values = pa.array((pair & ((1 << BITS) - 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("positive"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), values)], ["positive", "features"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("positive", "text").mapInArrow(extract, "positive boolean, features array<int>").toArrow()
    flags = rows.column("positive").to_numpy(zero_copy_only=False).astype(bool)
    flat = rows.column("features").combine_chunks()
    offs, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    features = [values[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
    order_of = sorted(range(len(features)), key=lambda i: (not flags[i], features[i].tobytes()))  # rows come in any order
    return fit([features[i] for i in order_of], flags[order_of], prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``score`` in 0 to 1; an own column of that name is replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.index, model.weight, model.bias))  # at most 2**BITS weights
    base = docs.drop("score")
    schema = StructType([*base.schema.fields, StructField("score", DoubleType())])

    @memory.task("toxicity")
    def run(batches):
        index, weight, bias = shared.value
        w = Model(index, weight, bias).dense()
        for batch in batches:
            for part in wh.slices(batch):
                data, offs = wh.text_buffers(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score_texts(w, bias, data, offs))], [*part.schema.names, "score"])

    return base.mapInArrow(run, schema)
