"""Toxicity by compression distance.

Two zstandard dictionaries are learnt: one that zstandard trains on ordinary labelled texts, and one whose content
is the stretches of words that are over-represented in toxic ones. (Trained by zstandard on whole toxic texts, which
are mostly ordinary, the second tells the two apart hardly better than chance.) A window is compressed with the
ordinary dictionary, and with the toxic one behind it; where the second stands, the first has filler, so that equal
matches cost equal bytes and what differs between the two lengths is what the toxic dictionary explains. Every
window of every whole text is measured so. A document's features, the windows that the toxic dictionary shortens
markedly and by how much, go through a logistic calibration fitted on labelled texts.

Learning is from at most ``max_rows`` labelled texts of each class (chosen by a hash of the id, a stretch
of at most ``max_chars`` characters of each), gathered to the driver; scoring reads everything.

Defined results: null and empty texts get the score of no evidence; without labels of both classes every
score is 0; repeated rows are scored row by row; very long texts are scored whole; an empty table gives an empty
result; labels without a document, and other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import learn_side, plainly_named, prepare

MAX_ROWS = 2000
MAX_CHARS = 8000
#: Words to a window.
WINDOW = 8
#: Shortest match, in bytes: below a short word and the spaces around it.
MIN_MATCH = 5
ORDINARY_BYTES = 4096
SPECIAL_BYTES = 6144
#: Bytes of a unit: words are compared by their byte n-grams, so that inflected forms count together.
UNIT = 5
#: Occurrences of a unit that count in one text.
MOST = 4
#: A unit is over-represented if it occurs in this share of a class's texts, this many times as often as in the other's, by a likelihood ratio (G squared) of at least this share of the largest.
MIN_SHARE, MIN_RATIO, MIN_G2 = 0.02, 6.0, 0.03
CARRIER = 64
#: Bytes saved that make a window count.
MARKS = (1, 2, 3, 4, 5)
THRESHOLD = 0.7

_PUNCTUATION = re.compile(r"[^\w\s]+|_+")


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The whole text, lower-cased and without punctuation, in windows of ``size`` words."""
    words = _PUNCTUATION.sub(" ", text.lower()).encode("utf-8", "surrogatepass").split() if text else []
    return [b" %b " % b" ".join(words[i : i + size]) for i in range(0, len(words), size)]


class Distance:
    """Compressed lengths of windows with the ordinary and with the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.contents = (ordinary, toxic)
        self._both: list = []

    def __getstate__(self):
        return self.contents

    def __setstate__(self, state):
        self.contents, self._both = state, []

    def saved(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves, window by window."""
        if not self._both:
            # A strategy that indexes every position of a dictionary; the fast ones skip some and miss matches.
            how = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_LAZY, min_match=MIN_MATCH, hash_log=16, chain_log=16, search_log=5, window_log=17, write_checksum=0, write_content_size=0, write_dict_id=0)
            ordinary, toxic = self.contents
            for content in (ordinary + bytes(len(toxic)), ordinary + toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                self._both.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
        plain, toxic = self._both
        # Behind each window stands a stretch that both dictionaries hold: without one, zstandard stores a short window
        # as it is unless its matches also pay for the headers of a compressed block.
        carrier = self.contents[0][-CARRIER:]
        return np.array([len(plain(p)) - len(toxic(p)) for p in [p + carrier for p in parts]], np.int64)


def features(saved: np.ndarray) -> tuple[float, ...]:
    """Windows at each mark (as logarithms), the share at the first, and the mean of the two largest savings."""
    if not len(saved):
        return (0.0,) * (len(MARKS) + 2)
    marked = [int((saved >= m).sum()) for m in MARKS]
    return (*map(math.log1p, marked), marked[0] / len(saved), float(np.clip(np.sort(saved)[-2:], 0, 12).mean()))


def _dictionary(samples: list[bytes], size: int, **how) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _g2(n: int, of: int, m: int, others: int) -> float:
    """Twice the log likelihood ratio of two rates against one rate."""
    rate = (n + m) / (of + others)
    term = lambda k, total: sum(x * math.log(x / y) for x, y in ((k, total * rate), (total - k, total * (1 - rate))) if x and y > 0)
    return 2 * (term(n, of) + term(m, others))


def _units(word: bytes) -> list[bytes]:
    padded = b" %b " % word
    return [padded[i : i + UNIT] for i in range(max(1, len(padded) - UNIT + 1))]


def _fragments(word: bytes, picked: set[bytes]) -> list[bytes]:
    """The stretches of a word, with a space at either end, that picked units cover."""
    padded, out, end = b" %b " % word, [], -1
    for i, u in enumerate(_units(word)):
        if u in picked:
            if i > end:
                out.append([i, i])
            out[-1][1] = end = i + UNIT
    return [padded[a:z] for a, z in out]


def _occurrences(texts: list[list[bytes]]) -> Counter:
    """How often each unit occurs, at most ``MOST`` times in one text."""
    total: Counter = Counter()
    for words in texts:
        total.update({u: min(n, MOST) for u, n in Counter(u for w in words for u in set(_units(w))).items()})
    return total


def _special(own: list[list[bytes]], other: list[list[bytes]]) -> bytes:
    """Dictionary of the stretches of over-represented units in the words of ``own``, the most frequent last, where zstandard looks first."""
    a, b = _occurrences(own), _occurrences(other)
    na, nb = MOST * max(1, len(own)), MOST * max(1, len(other))
    least = max(3, MIN_SHARE * len(own))
    strength = {u: _g2(n, na, b[u], nb) for u, n in a.items() if n >= least and n / na >= MIN_RATIO * b[u] / nb}
    picked = {u for u, g in strength.items() if g >= MIN_G2 * max(strength.values())}
    found = Counter(f for words in own for w in words for f in _fragments(w, picked))
    return b"\n".join([b"", *(f for f, _ in sorted(found.items(), key=lambda x: (x[1], x[0]))), b""])[-SPECIAL_BYTES:] if found else b""


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, distance: Distance | None, weights: np.ndarray | None):
        self.distance, self.weights = distance, weights

    def score(self, text: str | None) -> float:
        if self.distance is None:
            return 0.0
        z = float(np.dot(self.weights, (*features(self.distance.saved(windows(text))), 1.0)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(rows: list[tuple[str, int]]) -> Model:
    """A model of ``(text, 1 if toxic)`` pairs."""
    kinds = {y for _, y in rows}
    if kinds != {0, 1}:
        return Model(None, None)
    cut = [([w for p in windows(t) for w in p.split()], y) for t, y in rows]
    toxic, plain = (_unlike([w for w, y in cut if y == k]) for k in (1, 0))
    ordinary = _dictionary([b" %b " % b" ".join(w[i : i + WINDOW]) for w in plain for i in range(0, len(w), WINDOW)], ORDINARY_BYTES, k=200, d=8)
    distance = Distance(ordinary, _special(toxic, plain))
    x = np.array([features(distance.saved(windows(t))) for t, _ in rows])
    return Model(distance, _logistic(x, np.array([y for _, y in rows], float)))


def _unlike(texts: list[list[bytes]]) -> list[list[bytes]]:
    """Without texts that repeat an earlier one or most of it, so that copies don't make a word look frequent."""
    seen: set[int] = set()
    out = []
    for words in texts:
        sketch = sorted({zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))})[:6]
        if sum(x in seen for x in sketch) < max(1, len(sketch) // 2):
            out.append(words)
        seen.update(sketch)
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    known = labels.where(learn_side(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"), F.xxhash64(id_col).alias("_o"))
    # A bounded number of ids, so broadcasting them is bounded too.
    some = known.where("_y = 1").orderBy("_o").limit(max_rows).unionByName(known.where("_y = 0").orderBy("_o").limit(max_rows))
    at = F.pmod(F.col("_o"), F.greatest(F.length(text_col) - max_chars, F.lit(0)) + 1) + 1
    text = F.substring(F.col(text_col), at.cast("int"), F.lit(max_chars))
    own = docs.select(F.col(id_col).alias("_doc"), F.col(text_col)).where(F.col(text_col).isNotNull())
    got = own.join(F.broadcast(some), F.col("_doc") == F.col("_id")).select(text.alias("t"), "_y", "_o").distinct()
    # Of an id with several texts, or several labels, the first texts count, so that the rows are bounded as the ids are.
    first = Window.partitionBy("_y").orderBy("_o", F.xxhash64("t"), "t")
    got = got.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max_rows)
    return train([(r["t"], r["_y"]) for r in sorted(got.collect(), key=lambda r: (r["_o"], r["t"]))])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``."""
    prepare(docs.sparkSession)
    model = model or learn(docs, labels, id_col, text_col)
    d = docs.select(docs[id_col].alias("doc_id"), (~learn_side(id_col)).alias("held_out"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.array([model.score(t.as_py()) for t in b.column("text")], float)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    prepare(docs.sparkSession)
    columns, docs = docs.columns, plainly_named(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) < threshold for t in b.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema).toDF(*columns)
