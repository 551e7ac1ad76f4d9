"""Sharding by a k-d tree over row metadata, with near-equal bytes in every shard.

A node that is to hold several shards is split along its widest metadata dimension at the weighted
quantile that gives each side bytes in proportion to its shards. Quantiles are found by distributed histograms: one
pass over all nodes of a level counts bytes along every dimension, from which the widest is chosen; further passes
look into the bin that holds the cut, until that is a row or less than the tolerance. The driver sees sums of at most
nodes x dimensions x bins. Ties in a dimension are ordered by the text's checksum, so that equal texts stay together
where the bytes allow it, then by the id's hash.

Defined results: null texts weigh nothing but their row's 16 bytes; null metadata counts as zero; repeated
rows each get a place of their own; only a text's size and checksum are kept, however long it is; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, positions, prepare

SHARDS = 40
ROW_BYTES = 16
#: Bins of the histograms along all dimensions of a level's nodes, and of those inside the range that a cut lies in.
COARSE, FINE = 1024, 4096
_FULL = (1 << 32) - 1


def kdtree_shards(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("size", "lang", "text"), tolerance: float = 0.001) -> DataFrame:
    """One row per row of ``df``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``dims`` names the metadata: ``size`` (bytes), ``text`` (checksum), or columns of ``df`` (by checksum
    of their text form; columns that ``df`` lacks are left out). A cut is within ``tolerance`` of a
    shard's bytes, or one row, of the exact quantile.
    """
    prepare(df.sparkSession)
    text = F.coalesce(df[text_col], F.lit(""))
    crc = F.crc32(text)

    def dim(name: str) -> Column:
        if name == "size":
            return F.least(F.octet_length(text).cast("long"), F.lit(_FULL))
        return crc if name == "text" else F.coalesce(F.crc32(df[name].cast("string")), F.lit(0))

    used = [n for n in dims if n in ("size", "text") or n in df.columns]
    meta = materialize(
        df.select(
            df[id_col].alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            crc.alias("text_crc32"),
            F.xxhash64(df[id_col]).bitwiseAND(F.lit(_FULL)).alias("_h"),
            *(dim(n).alias(f"_d{i}") for i, n in enumerate(used)),
        )
    )
    leaf = _grow(meta, shards, len(used), tolerance)
    placed = meta.select("doc_id", "size", "text_crc32", leaf.cast("int").alias("shard"))
    out = positions(placed, ["shard"], ["doc_id", "text_crc32"], F.lit(1), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _grow(meta: DataFrame, shards: int, dims: int, tolerance: float) -> Column:
    """The tree, as an expression that gives a row's shard."""
    tree: dict[tuple[int, int], tuple[int, tuple[int, int, int]]] = {}  # (first shard, shards) -> dimension, cut

    def walk(lo: int, n: int) -> Column:
        if (lo, n) not in tree:
            return F.lit(lo)
        d, cut = tree[lo, n]
        key = F.struct(F.col(f"_d{d}").cast("long"), F.col("text_crc32").cast("long"), F.col("_h").cast("long"))
        return F.when(key < F.struct(*(F.lit(x).cast("long") for x in cut)), walk(lo, n // 2)).otherwise(walk(lo + n // 2, n - n // 2))

    first = meta.agg(F.sum("size").alias("w"), *(f(f"_d{i}").cast("long").alias(f"{a}{i}") for i in range(dims) for f, a in ((F.min, "lo"), (F.max, "hi")))).first()
    if first["w"] is None or shards < 2:
        return walk(0, shards)
    span = [first[f"hi{i}"] - first[f"lo{i}"] for i in range(dims)]
    least = max(1.0, tolerance * first["w"] / shards)
    #: What is known of the range of each dimension in a node: that of the node it was cut from.
    ranges = {(0, shards): [(first[f"lo{i}"], first[f"hi{i}"]) for i in range(dims)]}
    level = [(0, shards)]
    while level:
        live = meta.withColumn("_node", walk(0, shards))
        found = _histograms(live, {lo: ranges[lo, n] for lo, n in level}, dims)
        open_: dict[int, _Cut] = {}
        for lo, n in level:
            bins = found.get(lo)
            if not bins:  # nothing left to divide
                tree[lo, n] = (0, (0, 0, 0))
                own = ranges[lo, n]
            else:
                own = [(min(b[3] for b in x), max(b[4] for b in x)) for x in bins]
                width = [(hi - low) / s if s else 0.0 for (low, hi), s in zip(own, span)]
                dim = max(range(dims), key=lambda i: width[i])
                open_[lo] = _Cut(dim, own[dim], sum(b[1] for b in bins[dim]) * (n // 2) / n, least)
                open_[lo].narrow(bins[dim], _width(*ranges[lo, n][dim], COARSE))
            for child in ((lo, n // 2), (lo + n // 2, n - n // 2)):
                ranges[child] = own
        while any(c.cut is None for c in open_.values()):
            got = _pass(live, {lo: c for lo, c in open_.items() if c.cut is None})
            for lo, c in open_.items():
                if c.cut is None:
                    c.narrow(got[lo], c.width)
        for lo, n in level:
            if lo in open_:
                tree[lo, n] = (open_[lo].dim, open_[lo].cut)
        level = [c for lo, n in level for c in ((lo, n // 2), (lo + n // 2, n - n // 2)) if c[1] > 1]
    return walk(0, shards)


def _width(lo: int, hi: int, bins: int) -> int:
    return max(1, -(-(hi - lo + 1) // bins))


class _Cut:
    """A node's cut on the way: the part of the key that is looked at (value, checksum, hash of the id), the parts before it, and the range the cut lies in."""

    def __init__(self, dim: int, span: tuple[int, int], want: float, least: float):
        self.dim, self.want, self.least = dim, want, least
        self.prefix: tuple[int, ...] = ()
        self.lo, self.hi = span
        self.cut: tuple[int, int, int] | None = None

    @property
    def width(self) -> int:
        return _width(self.lo, self.hi, FINE)

    def narrow(self, bins: list[tuple], width: int) -> None:
        """Go on in the bin ``(bin, weight, rows, smallest, largest)`` that holds the quantile, or settle on one of its ends."""
        before = 0
        for _, w, n, low, high in bins:
            if before + w >= self.want or low == bins[-1][3]:
                break
            before += w
        part = len(self.prefix)
        if w <= self.least or n == 1 or (part == 2 and low == high):
            end = self.want - before > w / 2
            self.cut = (*self.prefix, high + 1 if end else low, 0, 0)[:3]
        elif low == high:
            self.prefix += (low,)
            self.lo, self.hi = 0, _FULL
            self.want -= before
        else:
            self.lo, self.hi = low, high
            self.want -= before


def _histograms(live: DataFrame, ranges: dict[int, list[tuple[int, int]]], dims: int) -> dict[int, list[list[tuple]]]:
    """For each node and dimension the bins that have rows: ``(bin, weight, rows, smallest, largest)``."""
    cells = []
    for i in range(dims):
        v = F.col(f"_d{i}").cast("long")
        low, width = (F.element_at(F.create_map(*(F.lit(x).cast("long") for lo, r in ranges.items() for x in (lo, f(*r[i])))), F.col("_node").cast("long")) for f in (lambda a, z: a, lambda a, z: _width(a, z, COARSE)))
        cells.append(F.struct(F.lit(i).alias("d"), F.floor((v - low) / width).alias("b"), v.alias("v")))
    rows = live.where(F.col("_node").isin(*ranges)).select("_node", "size", F.explode(F.array(*cells)).alias("c"))
    out: dict[int, list[list[tuple]]] = {}
    for r in rows.groupBy("_node", "c.d", "c.b").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("c.v").alias("lo"), F.max("c.v").alias("hi")).collect():
        out.setdefault(r["_node"], [[] for _ in range(dims)])[r["d"]].append((r["b"], r["w"], r["n"], r["lo"], r["hi"]))
    return {lo: [sorted(x) for x in bins] for lo, bins in out.items()}


def _pass(live: DataFrame, open_: dict[int, _Cut]) -> dict[int, list[tuple]]:
    """One more histogram of each open node, inside the range that its cut lies in."""
    bin_, value = F.lit(None).cast("long"), F.lit(None).cast("long")
    for lo, c in open_.items():
        cols = [F.col(f"_d{c.dim}").cast("long"), F.col("text_crc32").cast("long"), F.col("_h").cast("long")]
        v = cols[len(c.prefix)]
        match = (F.col("_node") == lo) & v.between(c.lo, c.hi)
        for x, known in zip(cols, c.prefix):
            match &= x == known
        bin_ = F.when(match, F.floor((v - c.lo) / c.width)).otherwise(bin_)
        value = F.when(match, v).otherwise(value)
    rows = live.select("_node", "size", bin_.alias("b"), value.alias("v")).where("b is not null")
    found: dict[int, list[tuple]] = {lo: [] for lo in open_}
    for r in rows.groupBy("_node", "b").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
        found[r["_node"]].append((r["b"], r["w"], r["n"], r["lo"], r["hi"]))
    return {lo: sorted(bins) for lo, bins in found.items()}
