"""Embedding near-duplicates by an epsilon grid order join (Boehm et al., 2001).

Unit vectors with cosine of at least ``threshold`` are at most ``eps = sqrt(2 - 2 threshold)`` apart. Vectors
are turned to their principal axes, put in the order of their grid cells of width ``eps`` on the leading
axes, and cut along that order into blocks of bounded size. Two blocks are joined only if their boxes on
those axes are within ``eps``; inside a task a block pair is halved again and again, and halves whose boxes
are further apart are skipped, until the rest is compared exactly, in double precision.

Equal vectors of one label are one class and are compared once. Tasks return each class's number of linked
vectors and a spanning forest of the links, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a
null label, link with nothing; vectors of different lengths do not link; repeated rows link as equal vectors, and
vectors of one id are counted each by itself; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import connected_components, local_components, materialize, prepare

THRESHOLD = 0.98
AXES = 6
BLOCK = 1024
LEAF = 64


def _unpack(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by the largest component first, so that squares of very large or small ones stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes(classes: DataFrame, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal axes of all unit vectors, padded to the longest; sums are added up task by task."""
    dim = classes.agg(F.max(F.size("v"))).first()[0] or 1

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = np.zeros((len(b), dim))
            for i, v in enumerate(b["v"]):
                x[i, : len(v)] = v
            x = _unit(x)
            n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        yield pd.DataFrame({"i": np.arange(dim + 1), "row": [*np.vstack([s, q])], "n": n})

    # One row per dimension from each task, added per dimension: the size does not depend on the number of vectors.
    cols = [F.sum(F.element_at("row", j + 1)).alias(f"s{j}") for j in range(dim)]
    got = classes.select("v").mapInPandas(moments, "i int, row array<double>, n long").groupBy("i").agg(F.sum("n").alias("n"), *cols).orderBy("i").collect()
    n = got[0]["n"] if got else 0
    if not n:
        return np.zeros(dim), np.eye(dim)[:, :axes]
    m = np.array([[r[f"s{j}"] for j in range(dim)] for r in got])
    mean = m[0] / n
    w, u = np.linalg.eigh(m[1:] / n - np.outer(mean, mean))
    return mean, u[:, np.argsort(-w)[:axes]]


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(gap @ gap) <= eps * eps


def join_blocks(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray, threshold: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(i, j)`` of rows of ``x`` and ``y`` with a cosine of at least the threshold; ``p``, ``q`` are their places on the axes."""
    left, right = [], []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if not _near(p[a:b], q[c:d], eps):
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= threshold)
            left.append(i + a)
            right.append(j + c)
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def embedding_groups(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: ``vec_id, n_links, component_id, kept``."""
    spark = df.sparkSession
    prepare(spark)
    eps = float(np.sqrt(2 - 2 * threshold)) + 1e-7
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(df[id_col].alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    fine = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda e: e != 0), F.lit(False))
    rows = materialize(rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("class", F.when(F.col("fine"), F.sha2(F.concat_ws("|", "label", F.to_json("v")), 256))))
    # All vectors of a class are equal, so any is its own; counted before the shuffle, copies of one vector do not meet in a task.
    counts = rows.where("fine").groupBy("class").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    numbered = materialize(counts.withColumn("first", F.monotonically_increasing_id()))  # classes, not ids, are linked: two vectors may have one id
    classes = numbered.select("first", "n", "label", "v")
    mean, turn = _axes(classes, axes)
    kind = "long"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.zeros((len(b), len(mean)))
            for i, e in enumerate(b["v"]):
                x[i, : len(e)] = e
            x = _unit(x)
            at = (x - mean) @ turn
            out = b[["first", "n"]].copy()
            out["part"] = [f"{lab}|{len(e)}" for lab, e in zip(b["label"], b["v"])]
            cells = np.floor(at / eps).astype(np.int64)
            for k in range(turn.shape[1]):
                out[f"c{k}"] = cells[:, k]
            out["at"] = [r.astype("<f8").tobytes() for r in at]
            out["x"] = [r.astype("<f8").tobytes() for r in x]
            yield out

    k = turn.shape[1]
    order = ["part", *(f"c{i}" for i in range(k)), "first"]
    placed = classes.mapInPandas(place, f"first {kind}, n long, part string, " + ", ".join(f"c{i} long" for i in range(k)) + ", at binary, x binary")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of the order, of one label each."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: pd.DataFrame | None = None
        for b in _with_end(batches):
            if b is not None:
                held = b if held is None else pd.concat([held, b], ignore_index=True)
            if held is None or not len(held):
                continue
            part = held["part"].to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(held)]
            rest = None
            for lo, hi in zip(edges, edges[1:]):
                for a in range(lo, hi, block):
                    z = min(a + block, hi)
                    if b is not None and z == len(held) and z - a < block:
                        rest = held.iloc[a:]
                        break
                    rows_ = held.iloc[a:z]
                    at = np.concatenate([np.frombuffer(r, "<f8") for r in rows_["at"]]).reshape(-1, k)
                    yield pd.DataFrame({"block": [number], "part": [part[a]], "lo": [at.min(axis=0)], "hi": [at.max(axis=0)], "firsts": [rows_["first"].to_numpy()], "ns": [rows_["n"].to_numpy()], "at": [b"".join(rows_["at"])], "x": [b"".join(rows_["x"])]})
                    number += 1
            held = rest

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialize(placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInPandas(cut, f"block long, part string, lo array<double>, hi array<double>, firsts array<{kind}>, ns array<long>, at binary, x binary"))

    # Boxes meet on the cells of the first axis, then on the distance between the boxes.
    box = blocks.select("block", "part", "lo", "hi", F.floor(F.element_at("lo", 1) / eps).alias("_a"), F.floor(F.element_at("hi", 1) / eps).alias("_z"))
    a = box.select(F.col("block").alias("a"), "part", F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(F.col("_a") - 1, F.col("_z") + 1)).alias("cell"))
    z = box.select(F.col("block").alias("b"), "part", F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(F.sequence("_a", "_z")).alias("cell"))
    gap2 = F.aggregate(F.arrays_zip("alo", "ahi", "blo", "bhi"), F.lit(0.0), lambda s, t: s + F.pow(F.greatest(F.lit(0.0), t["alo"] - t["bhi"], t["blo"] - t["ahi"]), F.lit(2.0)))
    pairs = a.join(z, ["part", "cell"]).where((F.col("a") <= F.col("b")) & (gap2 <= eps * eps)).select("a", "b").distinct()
    left = blocks.select(F.col("block").alias("a"), F.col("firsts").alias("f1"), F.col("ns").alias("n1"), F.col("at").alias("p1"), F.col("x").alias("x1"))
    right = blocks.select(F.col("block").alias("b"), F.col("firsts").alias("f2"), F.col("ns").alias("n2"), F.col("at").alias("p2"), F.col("x").alias("x2"))
    met = pairs.join(left, "a").join(right, "b")
    dim = len(mean)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                i, j = join_blocks(_unpack(r.p1, k), _unpack(r.x1, dim), _unpack(r.p2, k), _unpack(r.x2, dim), threshold, eps)
                same = r.a == r.b
                live = i != j if same else slice(None)
                i, j = i[live], j[live]
                f1, f2 = np.asarray(r.f1), np.asarray(r.f2)
                n1, n2 = np.asarray(r.n1), np.asarray(r.n2)
                m = len(f1)
                links = np.bincount(i, weights=n2[j], minlength=m)
                root = local_components(m + len(f2), i, (j if same else j + m))
                f = np.concatenate([f1, f2])
                away = np.flatnonzero(root != np.arange(len(root)))
                yield pd.DataFrame({"a": f[away], "b": f[root[away]], "m": 0})
                some = np.flatnonzero(links)
                yield pd.DataFrame({"a": f1[some], "b": f1[some], "m": links[some].astype(np.int64)})
                if not same:
                    links = np.bincount(j, weights=n1[i], minlength=len(f2))
                    some = np.flatnonzero(links)
                    yield pd.DataFrame({"a": f2[some], "b": f2[some], "m": links[some].astype(np.int64)})

    found = materialize(met.mapInPandas(compare, f"a {kind}, b {kind}, m long"))
    comp = connected_components(found.where("a <> b").select("a", "b"))
    links = found.where("a = b").groupBy(F.col("a").alias("first")).agg(F.sum("m").alias("m"))
    named = numbered.select("class", "first", "smallest", "n").join(links, "first", "left").join(comp.withColumnRenamed("node", "first"), "first", "left")
    named = named.select("class", "smallest", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("root"))
    named = materialize(named)
    heads = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_class = materialize(named.join(heads, "root").select("class", "n_links", "component_id"))  # written, so that a hot class can be split below
    linked = rows.where("fine").join(by_class, "class").select("vec_id", "n_links", "component_id")
    out = linked.unionByName(rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT vec_id, label, v, list_dot_product(v, v) AS q FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
       AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
      AND list_dot_product(a.v, b.v) / sqrt(a.q * b.q) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
