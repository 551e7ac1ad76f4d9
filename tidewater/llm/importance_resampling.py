"""Quality by importance resampling (Xie et al., 2023).

Words and word pairs of every text are hashed into buckets. Two bag-of-n-grams generative models are
counted: the raw one over all documents, the target one over labelled good documents. A document's log
importance weight is the mean log ratio of its n-grams under the two, times ``length``: the ratio of a text
of that many n-grams of its kind, so that long texts do not outweigh all others by length alone. ``length`` is an
inverse temperature: at the default the weights of the test tables spread a few times as much as the noise, so that
clear cases are decided by the text and the others drawn. Adding Gumbel noise drawn from the id and the seed and
taking the top ``k`` samples documents without replacement in proportion to their weights; the ``k``-th largest key is
found by distributed histograms, not by a global sort.

The target model learns from at most ``max_target`` labelled documents, chosen by a hash of the id. ``k`` is
``fraction`` of the rows, by default the share of good ones among the labels that may be learnt from.

Defined results: null texts and texts without words have log weight 0; rows of one id draw the same noise,
and equal keys at the threshold are all kept; without target documents every log weight is 0, and without labels
the fraction is a half; very long texts are read whole; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import learn_side, materialize, prepare, text_groups

BUCKETS = 1 << 16
LENGTH = 20.0
MAX_TARGET = 20_000
SMOOTH = 1.0
SEED = 11

_WORDS: dict[bytes, int] = {}
_MAX_WORDS = 500_000


def features(text: str | None) -> np.ndarray:
    """Buckets of the words and word pairs of the whole text."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.empty(0, np.int64)
    if len(_WORDS) > _MAX_WORDS:
        _WORDS.clear()
    for w in set(words):
        if w not in _WORDS:
            _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter((_WORDS[w] for w in words), np.uint64, len(words))
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] >> np.uint64(31))
    both = np.concatenate([h, pair * np.uint64(0xFF51AFD7ED558CCD)])
    return (both >> np.uint64(48)).astype(np.int64)


def _counts(texts: DataFrame) -> np.ndarray:
    """n-grams in each bucket, over all rows: a table of buckets per task, added up by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for i, j in text_groups(b.column("text")):
                held = [features(t.as_py()) for t in b.column("text")[i:j]]
                total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.float64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row per bucket
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_target: int = MAX_TARGET) -> np.ndarray:
    """Log of the target probability over the raw probability of each bucket."""
    raw = _counts(docs.select(F.col(text_col).alias("text")))
    good = labels.where(learn_side(id_col) & (F.col(label_col) == 1)).select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(max_target)
    # A bounded number of ids, so broadcasting them is bounded too.
    own = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    target = _counts(own.join(F.broadcast(good), F.col("_doc") == F.col("_id"), "left_semi").select("text"))
    if not target.sum():
        return np.zeros(BUCKETS)
    # The raw model is the target model's prior, so rare buckets lean to a ratio of one.
    prior = (raw + SMOOTH) / (raw + SMOOTH).sum()
    return np.log((target + BUCKETS * SMOOTH * prior) / (target.sum() + BUCKETS * SMOOTH)) - np.log(prior)


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096, few: int = 4096) -> float | None:
    """The ``k``-th largest value of a column of finite doubles, by histograms that narrow the range around it."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n")).first()
    if not r["n"] or k <= 0:
        return None
    lo, hi, k = r["lo"], r["hi"], min(k, r["n"])
    while True:
        inside = df.where(F.col(col).between(lo, hi))
        if lo == hi:
            return lo
        width = (hi - lo) / bins
        bin_ = F.least(F.floor((F.col(col) - lo) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        got = sorted(((x["b"], x["n"], x["lo"], x["hi"]) for x in inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()), reverse=True)
        for _, n, a, z in got:
            if k <= n:
                break
            k -= n
        lo, hi = a, z
        if n <= few:
            return sorted((x[0] for x in df.where(F.col(col).between(lo, hi)).select(col).collect()), reverse=True)[k - 1]


def _gumbel(id_: Column, seed: Column) -> Column:
    """Standard Gumbel noise from a hash of the id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(id_, seed.cast("int")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(-F.ln(uniform))


def gumbel_keys(ids: DataFrame, seeds: int) -> DataFrame:
    """``doc_id, seed, noise``: what each of ``seeds`` seeds adds to the log weights."""
    d = ids.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    return d.withColumn("noise", _gumbel(F.col("doc_id"), F.col("seed")))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fraction: float | None = None, length: float = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_features, log_weight, key`` and ``kept``, true for the ``fraction`` of rows with the largest keys."""
    prepare(docs.sparkSession)
    ratio = log_ratios(docs, labels, id_col, text_col, label_col)
    d = docs.select(docs[id_col].alias("doc_id"), (~learn_side(id_col)).alias("held_out"), docs[text_col].alias("text"))

    if fraction is None:
        share = labels.where(learn_side(id_col) & F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()[0]
        fraction = 0.5 if share is None else float(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, w = [], []
            for t in b.column("text"):
                f = features(t.as_py())
                n.append(len(f))
                w.append(length * float(ratio[f].mean()) if len(f) else 0.0)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(n, pa.int64()), pa.array(w, pa.float64())], ["doc_id", "held_out", "n_features", "log_weight"])

    scored = d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_features long, log_weight double")
    scored = materialize(scored.withColumn("key", F.col("log_weight") + _gumbel(F.col("doc_id"), F.lit(seed))))
    least = kth_largest(scored, "key", int(fraction * scored.count()))
    return scored.withColumn("kept", F.col("key") >= least if least is not None else F.lit(False))
