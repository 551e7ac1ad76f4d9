"""Shared pieces of the training-data operators.

Intermediate tables go to the folder that all machines share (``spark.checkpoint.dir``), so a lost
executor costs a reread and not the work behind it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import ship_package

#: Rows per Arrow batch: whole texts travel in a batch, so the default of 10,000 rows could need gigabytes.
ARROW_ROWS = 2000

_OWN_SCRATCH: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches of texts small.

    The second is a setting of the session, and stays for its later queries: plans run when their results are asked for.
    """
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def plainly_named(df: DataFrame) -> DataFrame:
    """``df`` with other names for columns that Arrow functions cannot name, those with dots or back quotes; ``toDF`` gives them back."""
    for name in [c for c in df.columns if "." in c or "`" in c]:
        safe = fresh(df, name.replace(".", "_").replace("`", "_"))
        df = df.toDF(*(safe if c == name else c for c in df.columns))
    return df


def hashable(df: DataFrame) -> list[Column]:
    """The columns of ``df`` so that any of them can be hashed: those that hold maps or variants as JSON, maps in the order of their keys."""

    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return all(plain(f.dataType) for f in kind.fields)
        return plain(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))

    def entries(c: Column) -> Column:
        return F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(k.alias("k"), F.try_element_at(c, k).alias("v")))

    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, T.MapType) and plain(f.dataType.keyType):
            c = entries(c) if plain(f.dataType.valueType) else F.to_json(entries(c))
        elif not plain(f.dataType):
            c = F.to_json(c) if isinstance(f.dataType, T.VariantType) else F.to_json(F.struct(c.alias("c")))
        out.append(c)
    return out


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only on one machine where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = _OWN_SCRATCH.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidewater-scratch-"))
    return f"{base.rstrip('/')}/tidewater/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it: cuts the lineage, computes once."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def text_groups(texts: pa.Array, limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes of text; a longer text is a range by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    i, total = 0, 0
    for j, n in enumerate(sizes.tolist()):
        if j > i and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns (numbers without nulls) of batches sorted by ``key``, cut so that no value of it is in two of them."""
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        k = rows[key]
        if held and k[0] != held[-1][key][-1]:
            yield {n: np.concatenate([h[n] for h in held]) for n in rows}
            held = []
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield {n: np.concatenate([*(h[n] for h in held), x[:cut]]) for n, x in rows.items()}
            held = []
        held.append({n: x[cut:] for n, x in rows.items()})
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def with_texts(b: pa.RecordBatch, text_col: str, texts: list[str | None]) -> pa.RecordBatch:
    """``b`` with other texts, and ``n_chars``, if there is such a column, counted anew where the text changed."""
    at = b.schema.get_field_index(text_col)
    old = b.column(at).to_pylist()
    b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
    n = b.schema.get_field_index("n_chars")
    if n >= 0 and pa.types.is_integer(b.schema.field(n).type):
        counts = [c if t == o or t is None else len(t) for c, t, o in zip(b.column(n).to_pylist(), texts, old)]
        b = b.set_column(n, b.schema.field(n), pa.array(counts, b.schema.field(n).type))
    return b


def learn_side(id_col: str = "doc_id") -> Column:
    """True for rows that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1


def positions(df: DataFrame, keys: list[str], order: list[str], weight: Column, out: str = "pos", buckets: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over earlier rows of the same ``keys``, without one task per key.

    Rows of a key are dealt into hash buckets of ``order``; a window runs inside each bucket and bucket
    totals, of which there are ``keys x buckets``, are summed on top. Positions of a key are gapless in
    the sense that they tile ``[0, total)``; the order among buckets is that of the hash.
    ``keys`` must not be null. ``df`` should be materialized: it is read twice.
    """
    if buckets is None:
        buckets = max(256, df.count() // 20_000)
    d = df.withColumn("_w", weight.cast("long")).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("_local", F.coalesce(F.sum("_w").over(w), F.lit(0)))
    totals = d.groupBy(*keys, "_b").agg(F.sum("_w").alias("_t"))
    up = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(up), F.lit(0)).alias("_off"))
    return local.join(offsets, [*keys, "_b"]).withColumn(out, F.col("_local") + F.col("_off")).drop("_w", "_b", "_local", "_off")


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under links ``a[i] - b[i]`` (hook and jump)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


#: Links (16 bytes each) that a single task may hold to finish a graph.
LOCAL_LINKS = 200_000


def connected_components(edges: DataFrame, max_rounds: int = 60, local_links: int = LOCAL_LINKS) -> DataFrame:
    """Components of an undirected graph given as long columns ``a, b``: returns ``node, component``.

    Alternates large-star and small-star contraction (Kiveris et al., 2014) until the edges are stars.
    Each round is two pre-aggregated minima and two joins; edges between rounds live in the shared folder. A graph of
    at most ``local_links`` edges is finished in one task, whose memory that bounds.
    ``component`` is the smallest node reachable. Nodes without edges are not returned.
    """
    spark = edges.sparkSession
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = _signature(cur)
    for _ in range(max_rounds):
        if sign[0] <= local_links:
            return _finished(cur)
        # Large-star: every larger neighbour of u is linked to the smallest node in u's neighbourhood.
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = _by_node(both, mins).where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        # Small-star: the smaller neighbours of u, and u, are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = _by_node(large, low).where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        nxt = materialize(small.unionByName(low.select("u", F.col("_m").alias("v"))).distinct())
        old, cur, before, sign = cur, nxt, sign, _signature(nxt)
        discard(old)
        if sign == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _finished(edges: DataFrame) -> DataFrame:
    """Components of a graph of bounded size, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for b in batches:
            u.append(b.column("u").to_numpy())
            v.append(b.column("v").to_numpy())
        a, b = np.concatenate(u), np.concatenate(v)
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_components(len(nodes), at[: len(a)], at[len(a) :])
        yield pa.record_batch([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def _by_node(edges: DataFrame, minima: DataFrame) -> DataFrame:
    """Edges joined with a number for each node, on two names of it: a join by other keys than the aggregate's has
    shuffles of its own on both sides, so that a node with very many edges can be split."""
    return edges.withColumn("_u", F.col("u")).join(minima.withColumn("_u", F.col("u")), ["u", "_u"]).drop("_u")


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return (r["n"], r["h"])
