"""Mixing sources to target weights, in fixed-length blocks of words.

A source's documents, in a fixed order, are one stream of words, cut into blocks of equal length. Output
shards draw how many of their slots each source fills from a multinomial; the slots of a source are
numbered through, and slot ``j`` holds the block that a pseudorandom permutation of the source's block
indices (a keyed Feistel network, another one each time the source is used up) gives to ``j``. Slots and
blocks are then joined by index. A last shard takes up what the draws left short, and slots past a source's
target are left out, so each source's words equal its target rounded to a whole number.

Defined results: a null text has no words; a null source is a source of its own, ordered last; a source
without words has target zero; repeated rows are each part of the stream; the same input and seed give the
same mix whatever the partitioning; very long texts are cut into blocks like any other; an empty table gives an empty
result; other columns, whatever their names, do no harm.
The driver holds a few numbers per source, and none per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import fresh, hashable, materialize, plainly_named, positions, prepare, with_texts

BLOCK = 256
SLOTS = 1024
SEED = 17
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"

_M = (1 << 64) - 1


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> dict[str | None, float]:
    """Each source's share of all sizes by weight, at most ``cap`` times its size; the excess goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: float(cap * n) for s, n in order}
    out: dict[str | None, float] = {}
    rest, free = float(sum(n for _, n in order)), [s for s, _ in order]
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > limit[s]]
        if not over:
            return out | {s: rest * weight[s] / total for s in free}
        for s in over:
            out[s] = limit[s]
        rest -= sum(limit[s] for s in over)
        free = [s for s in free if s not in out]
    return out


class Permutation:
    """A keyed pseudorandom permutation of ``range(n)``: Feistel rounds on the next even number of bits, walked back into the range."""

    def __init__(self, n: int, *key: int, rounds: int = 4):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        k, self.keys = 0x9E3779B97F4A7C15, []
        for x in (*key, *range(rounds)):
            k = ((k ^ x + 0x632BE59BD9B4E019) * 0xFF51AFD7ED558CCD) & _M
            k ^= k >> 31
            self.keys.append(np.uint64(k))
        self.keys = self.keys[-rounds:]

    def _f(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        y = (x + k) * np.uint64(0xC4CEB9FE1A85EC53)
        y ^= y >> np.uint64(29)
        y *= np.uint64(0x9FB21C651E98DF25)
        return (y >> np.uint64(32)) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        h = np.uint64(self.half)
        a, b = x >> h, x & self.mask
        if back:
            for k in reversed(self.keys):
                a, b = b ^ self._f(a, k), a
        else:
            for k in self.keys:
                a, b = b, a ^ self._f(b, k)
        return a << h | b

    def __call__(self, i: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._once(np.asarray(i).astype(np.uint64), back)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)


def _quota(src: int, size: int, want: int, block: int, seed: int) -> dict:
    """How the slots of a source run: blocks, whole uses, words of the last use, its slots and the place of the short block in it."""
    blocks = -(-size // block)
    full, rest = divmod(want, size) if size else (0, 0)
    short = blocks * block - size
    at = int(Permutation(blocks, seed, src, full)(np.array([blocks - 1]), back=True)[0]) if size else 0
    slots = -(-rest // block)
    if rest and slots * block - (short if at < slots else 0) < rest:
        slots += 1
    return {"size": size, "blocks": blocks, "full": full, "rest": rest, "short": short, "at": at, "slots": full * blocks + slots}


def mix_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents with their place, and the mix.

    First: ``doc_id, hash`` (of the row), ``nth`` (among equal rows), ``size, source_size, target, src, pos`` (first word's place in its
    source). Second: ``shard, slot, src, pos, doc_id, hash, nth, uses, at, length``: the words from ``at`` on that a slot takes of a
    document, in the source's ``uses``-th use.
    """
    spark = df.sparkSession
    prepare(spark)
    # Texts are measured where they are read; only ids, hashes and counts are shuffled.
    rows = df.select(df[id_col].alias("doc_id"), row_hash(df).alias("hash"), df[source_col].cast("string").alias("source"), n_words(df[text_col]).alias("size"))
    sized = materialize(rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("size")).cast("int")))
    per = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    want = targets(per, weights, cap)
    order = sorted(want, key=lambda s: (s is None, s or ""))
    sizes = dict(per)
    quota = [_quota(i, sizes[s], round(want[s]), block, seed) for i, s in enumerate(order)]
    facts = spark.createDataFrame([(s, i, sizes[s], want[s]) for i, s in enumerate(order)], "_source string, src int, source_size long, target double")
    docs = sized.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")  # a row per source
    placed = positions(docs, ["src"], ["doc_id", "hash", "nth"], F.col("size"), "pos").select("doc_id", "hash", "nth", "size", "source_size", "target", "src", "pos")
    placed = materialize(placed)

    total = sum(q["slots"] for q in quota)
    shares = np.array([q["slots"] for q in quota], float) / max(1, total)
    shards = -(-total // slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m in b["id"]:
                n = np.random.default_rng([seed, int(m)]).multinomial(min(slots, total - int(m) * slots), shares)
                yield pd.DataFrame({"shard": int(m), "src": np.arange(len(n), dtype=np.int32), "n": n})

    drawn = materialize(spark.range(shards).mapInPandas(draw, "shard long, src int, n long"))
    sums = {r["src"]: r["n"] for r in drawn.groupBy("src").agg(F.sum("n").alias("n")).collect()}
    last = [(shards, i, sums.get(i, 0), q["slots"] - sums.get(i, 0)) for i, q in enumerate(quota) if q["slots"] > sums.get(i, 0)]
    runs = positions(drawn, ["src"], ["shard"], F.col("n"), "first").select("shard", "src", "first", "n")
    runs = runs.unionByName(spark.createDataFrame(last, "shard long, src int, first long, n long"))
    numbered_slots = runs.where("n > 0").select("shard", "src", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for src, rows in b.groupby("src", sort=False):
                q = quota[src]
                rows = rows[rows["slot"] < q["slots"]]
                if not len(rows):
                    continue
                use, i = np.divmod(rows["slot"].to_numpy(), q["blocks"])
                index = np.empty(len(i), np.int64)
                for u in np.unique(use):
                    index[use == u] = Permutation(q["blocks"], seed, src, int(u))(i[use == u])
                take = np.full(len(i), block, np.int64)
                take[index == q["blocks"] - 1] -= q["short"]
                ending = use == q["full"]
                before = i * block - np.where(i > q["at"], q["short"], 0)
                take[ending] = np.minimum(take, q["rest"] - before)[ending]
                yield rows.assign(uses=use.astype(np.int32), block=index, take=take)

    filled = numbered_slots.mapInPandas(fill, "shard long, src int, slot long, uses int, block long, take long")
    parts = placed.where("size > 0").select("doc_id", "hash", "nth", "src", "pos", "size", F.explode(F.expr(f"sequence(pos div {block}, (pos + size - 1) div {block})")).alias("block"))
    lo = F.greatest("pos", F.col("block") * block)
    hi = F.least(F.col("pos") + F.col("size"), F.col("block") * block + F.col("take"))
    mix = filled.join(parts, ["src", "block"]).where(hi > lo).select("shard", "slot", "src", "pos", "doc_id", "hash", "nth", "uses", (lo - F.col("pos")).alias("at"), (hi - lo).alias("length"))
    return placed, mix


def row_hash(df: DataFrame) -> Column:
    """A hash of all of a row's columns, so that only equal rows share an id and a hash."""
    return F.xxhash64(*hashable(df))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per row of ``df``: ``doc_id, size, source_size, target`` (of its source) and ``taken``, the words that the mix takes."""
    placed, mix = mix_blocks(df, id_col, text_col, source_col, **how)
    taken = mix.groupBy("src", "pos").agg(F.sum("length").alias("_taken"))
    some = placed.where("size > 0").join(taken, ["src", "pos"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken"))
    none = placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)


_WORD = re.compile(WORD)


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed corpus, with the columns of ``df``: a row for each stretch of a document that is taken without a gap.

    Whole documents keep their text as it is; a stretch runs from its first word's first character to its
    last word's last.
    """
    names, df = df.columns, plainly_named(df)
    placed, mix = mix_blocks(df, id_col, text_col, source_col, **how)
    key, hash_, list_ = fresh(df, "_id"), fresh(df, "_hash"), fresh(df, "_spans")
    # Bounded by the text's own blocks; equal rows are as good as one another, so one of them stands for all.
    spans = mix.groupBy(F.col("doc_id").alias(key), F.col("hash").alias("_h")).agg(F.collect_list(F.struct("nth", "uses", "at", "length")).alias(list_))
    rows = df.withColumn(hash_, row_hash(df))
    if not placed.where("nth > 1").isEmpty():
        rows = rows.dropDuplicates([id_col, hash_])
    joined = rows.join(spans, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(hash_) == F.col("_h"))).drop(key, hash_, "_h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = [], []
            for k, (text, spans) in enumerate(zip(b.column(text_col).to_pylist(), b.column(list_).to_pylist())):
                for nth in sorted({s["nth"] for s in spans}):
                    for t in stretches(text, [(s["uses"], s["at"], s["length"]) for s in spans if s["nth"] == nth]):
                        at.append(k)
                        texts.append(t)
            yield with_texts(b.drop_columns([list_]).take(pa.array(at, pa.int64())), text_col, texts)

    return joined.mapInArrow(cut, df.schema).toDF(*names)


def stretches(text: str, spans: list[tuple[int, int, int]]) -> Iterator[str]:
    """The texts of word spans ``(use, first word, words)``, those of a use that touch joined."""
    runs: list[list[int]] = []
    for use, at, n in sorted(spans):
        if runs and runs[-1][0] == use and runs[-1][2] == at:
            runs[-1][2] += n
        else:
            runs.append([use, at, at + n])
    ends = None
    for _, a, z in runs:
        if ends is None:
            ends = [m.span() for m in _WORD.finditer(text)]
        yield text if a == 0 and z == len(ends) else text[ends[a][0] : ends[z - 1][1]]
