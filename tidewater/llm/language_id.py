"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are character n-grams of the letters-only, lower-cased text, hashed into a fixed number of
buckets. Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded sample of
labelled stretches, then multiplied into one table of logits per bucket, so that predicting a whole text is
one mean over table rows. The softmax is calibrated by a temperature on held-back stretches, where the
rejection threshold is also set: at most a stated share of right answers may fall below it.

The sample: of every language the first ``per_lang`` documents in the order of a hash of id and text (fewer where
there are so many languages that ``max_rows`` would be passed), and of each a stretch of at most ``chars`` characters
at a place given by that hash; reruns draw the same.

Defined results: a null text, and one without letters, is ``und`` with score 0; with nothing to learn from
every text is ``und``; repeated rows are predicted row by row; very long texts are read whole; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import learn_side, prepare

#: Labelled documents learnt from: of each language at most so many, and of all languages together (but 50 of each).
PER_LANG = 1200
MAX_ROWS = 80_000
#: Characters of each of them, from a place drawn by its hash; predictions read whole texts.
CHARS = 400
BUCKETS = 1 << 14
DIM = 16
NGRAMS = (2, 3, 4)
#: Share of right answers that calibrated rejection may turn away.
REJECT = 0.005

_LETTERS = re.compile(r"[^\W\d_]+")
_PIECE = 1 << 18


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords of the whole text, a bounded number at a time."""
    words = _LETTERS.findall(text.lower())
    if not words:
        return
    clean = f" {' '.join(words)} "
    for at in range(0, len(clean), _PIECE):
        c = np.frombuffer(clean[at : at + _PIECE + NGRAMS[-1] - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        h = np.full(len(c), 2166136261, np.uint32)
        for n in range(1, NGRAMS[-1] + 1):
            if n > len(c):
                break
            h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * np.uint32(16777619)
            if n in NGRAMS:
                x = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                yield (x >> np.uint32(18)).astype(np.int64)


class Model:
    """Logits of each bucket, the bias, the languages, the temperature and the rejection threshold."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, heat: float = 1.0, least: float = 0.0):
        self.langs, self.table, self.bias, self.heat, self.least = langs, table, bias, heat, least

    def logits(self, text: str | None) -> np.ndarray | None:
        total, n = np.zeros(len(self.langs)), 0
        for ids in subwords(text or ""):
            total += np.bincount(ids, minlength=len(self.table)) @ self.table if len(ids) > len(self.table) else self.table[ids].sum(axis=0)
            n += len(ids)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if self.langs else None
        if z is None:
            return "und", 0.0
        p = np.exp((z - z.max()) / self.heat)
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def train(rows: list[tuple[str, str]], epochs: int = 6, steps_least: int = 200, rate: float = 4.0, seed: int = 7) -> Model:
    """A model of ``(text, language)`` pairs; every fifth is held back for calibration.

    There are as many epochs more as it takes to make ``steps_least`` steps of few pairs.
    """
    bags = [(np.concatenate(ids), lang) for text, lang in rows if (ids := list(subwords(text)))]
    langs = sorted({lang for _, lang in bags})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    number = {lang: i for i, lang in enumerate(langs)}
    held, used = bags[::5], [b for i, b in enumerate(bags) if i % 5] or bags
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    batch, steps = 32, 0
    epochs = max(epochs, -(-steps_least // -(-len(used) // batch)))
    for epoch in range(epochs):
        order = rng.permutation(len(used))
        for at in range(0, len(order), batch):
            part = [used[i] for i in order[at : at + batch]]
            x = np.stack([np.bincount(ids, minlength=BUCKETS) / len(ids) for ids, _ in part]).astype(np.float32)
            mean = x @ emb
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [number[lang] for _, lang in part]] -= 1
            p /= len(part)
            step = rate * (1 - steps / (epochs * -(-len(used) // batch)))
            back = p @ out.T
            out -= step * mean.T @ p
            bias -= 0.05 * step * p.sum(axis=0)
            emb -= step * 20 * x.T @ back
            steps += 1
    model = Model(langs, (emb @ out).astype(np.float64), bias.astype(np.float64))
    z = np.stack([model.table[ids].mean(axis=0) + model.bias for ids, _ in held])
    y = np.array([number[lang] for _, lang in held])

    def probabilities(heat: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / heat)
        return p / p.sum(axis=1, keepdims=True)

    model.heat = min(np.geomspace(0.05, 5, 60), key=lambda t: -np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-12)).mean())
    p = probabilities(model.heat)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.least = float(np.quantile(right, REJECT)) if len(right) else 0.0
    return model


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, max_rows: int = MAX_ROWS, chars: int = CHARS) -> Model:
    known = docs.where(learn_side(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[lang_col]: r["count"] for r in known.groupBy(lang_col).count().collect()}  # a row for each language
    if not counts:
        return train([])
    per_lang = min(per_lang, max(50, max_rows // len(counts)))
    # About twice as many as are wanted by the hash, and of these the first in its order.
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * per_lang / n))))
    h = F.xxhash64(id_col, text_col)
    some = known.where(F.pmod(h, F.lit(1 << 20)) < F.try_element_at(share, F.col(lang_col)) * (1 << 20))
    at = F.pmod(F.shiftrightunsigned(h, 20), F.greatest(F.length(text_col) - chars, F.lit(0)) + 1) + 1
    rows = some.select(F.substring(F.col(text_col), at.cast("int"), F.lit(chars)).alias("t"), F.col(lang_col).alias("l"), h.alias("o")).distinct()
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy(F.shiftrightunsigned("o", 20), "o", "t"))).where(F.col("n") <= per_lang)
    return train([(r["t"], r["l"]) for r in sorted(rows.collect(), key=lambda r: (r["o"], r["t"], r["l"]))])


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score`` and ``rejected``, true where the score is below the calibrated threshold."""
    prepare(docs.sparkSession)
    model = model or learn(docs, id_col, text_col, lang_col)
    d = docs.select(docs[id_col].alias("doc_id"), (~learn_side(id_col)).alias("held_out"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column("text")]
            lang, score = pa.array([x for x, _ in found], pa.string()), np.array([x for _, x in found], float)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), lang, pa.array(score), pa.array(score < model.least)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")
