"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints are dealt into tiles by the bit counts of their segments. Two fingerprints within the radius
have segment counts whose differences add up to at most the radius, so only such tile pairs are compared,
exactly, by numpy exclusive-or and bit counts; all other tile pairs are skipped. A tile pair with many
fingerprints is itself cut into parts of bounded size. Each comparison task returns a spanning forest of
its links, never all pairs. The number of comparisons grows with the square of the number of different
fingerprints; that is the method's price for missing no pair.

:func:`simhash_groups` links fingerprints alone. :func:`without_near_copies` takes wider fingerprints of the set of
five-word shingles to find candidates and links those whose sets have a Jaccard similarity of 0.8 or more: first
each text with its nearest candidate, then, where candidates are still apart, all pairs of these in blocks.

Defined results: null texts and texts without words have fingerprint zero and link like any other; equal
fingerprints link; repeated rows and ids are harmless; very long texts are hashed whole; an empty table gives an
empty result; other columns of the input, whatever their names, are ignored. Of near copies, rows decide and not
ids: of each group the row of smallest id (null ids last), then of smallest text hash, stays, once; a text of fewer
words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import connected_components, discard, fresh, hashable, local_components, materialize, prepare, text_groups, whole_groups
from tidewater.llm.quality_rules import mixed
from tidewater.llm.substring_dedup import shingles

SHINGLE = 3
RADIUS = 2
SEGMENTS = 4
#: Fingerprints on either side of one comparison task.
PART = 8192
#: Fingerprints compared at once.
_CELLS = 1 << 19

# Near copies. Sets of similarity 0.8 differ in 15 % of the bits, 39 of 256 with a deviation of 6 (in 19 % at most, for
# sets of a few shingles), and in 10 of the first 64 with a deviation of 3; unrelated sets differ in 128, deviation 8.
NEAR_SHINGLE = 5
SIMILARITY = 0.8
NEAR_WORDS = 4
NEAR_RADIUS = 72
FIRST_RADIUS = 24
NEAR_PART = 8192
#: Texts on either side of a block that is compared on whole shingle sets.
BLOCK = (256, 1024)
#: Files of tables that have a row for each tile.
FEW = 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles (XXH64, seed 42), as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-shingle]])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())]
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        h = np.array(hashes[i : i + _BLOCK], "<u8")
        count += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a signed long) of every row."""
    prepare(df.sparkSession)
    d = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.record_batch([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def _offsets(segments: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of segment counts within the radius, one of each opposite pair, and zero."""
    near = [v for v in product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, v)) <= radius]
    return [v for v in near if v >= (0,) * segments]


def tiled_links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, part: int = PART) -> DataFrame:
    """A spanning set of links ``a, b`` between distinct fingerprints ``fp`` that differ in at most ``radius`` bits."""
    width = 64 // segments
    base = width + 1 + 2 * radius  # digits of a tile's number, with room for counts outside the range
    mask = (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask))) + radius for i in range(segments)]
    scale = [base**i for i in range(segments)]
    tile = sum((c.cast("long") * s for c, s in zip(counts[1:], scale[1:])), counts[0].cast("long"))
    shifts = [sum(a * s for a, s in zip(v, scale)) for v in _offsets(segments, radius)]
    d = distinct.select("fp", tile.alias("tile"))
    near = d.select(F.explode(F.array(*(F.col("tile") + s for s in shifts))).alias("tile"), "fp")
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(d, near, "fp", part, part)
    return dealt.repartition(n, "g").sortWithinPartitions("g", "side").mapInArrow(_compare(radius), "a long, b long")


def _dealt(left: DataFrame, right: DataFrame, key: str, left_part: int, right_part: int) -> DataFrame:
    """Rows of both sides of each ``tile`` (``side`` 0 and 1) cut into parts by the hash of ``key``; ``g`` is a pair of parts."""
    # A row for each tile: how many rows it has on either side.
    sizes = left.groupBy("tile").agg(F.count("*").alias("l")).join(right.groupBy("tile").agg(F.count("*").alias("r")), "tile")
    parts = materialize(sizes.select("tile", F.ceil(F.col("l") / left_part).cast("long").alias("lp"), F.ceil(F.col("r") / right_part).cast("long").alias("rp")).coalesce(FEW))

    def spread(rows: DataFrame, own: str, other: str, side: int) -> DataFrame:
        """A row goes to its own part, against every part of the other side."""
        mine = F.pmod(F.xxhash64(key), F.col(own))
        x = rows.join(parts, "tile").withColumns({"_m": mine, "_o": F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))})
        a, b = ("_m", "_o") if side == 0 else ("_o", "_m")
        return x.select(F.xxhash64("tile", a, b).alias("g"), F.lit(side).cast("long").alias("side"), *[c for c in rows.columns if c != "tile"])

    return spread(left, "lp", "rp", 0).unionByName(spread(right, "rp", "lp", 1))


def _pairs_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray]]]:
    """Left and right rows of each ``g``, from rows sorted by ``g, side``."""
    for rows in whole_groups(batches, "g"):
        cuts = [0, *(np.flatnonzero(rows["g"][1:] != rows["g"][:-1]) + 1).tolist(), len(rows["g"])]
        for lo, hi in zip(cuts, cuts[1:]):
            mid = lo + int(np.searchsorted(rows["side"][lo:hi], 1))
            if lo < mid < hi:
                yield {n: x[lo:mid] for n, x in rows.items()}, {n: x[mid:hi] for n, x in rows.items()}


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two in _pairs_of_parts(batches):
            fp, cut = np.concatenate([one["fp"], two["fp"]]), len(one["fp"])
            left, right = fp[:cut].view(np.uint64), fp[cut:].view(np.uint64)
            root = np.arange(len(fp))
            step = max(1, _CELLS // len(right))
            for i in range(0, len(left), step):
                x = left[i : i + step, None] ^ right[None, :]
                a, b = np.nonzero(np.bitwise_count(x) <= radius)
                live = left[i + a] != right[b]
                if live.any():
                    root = _joined(root, a[live] + i, b[live] + cut)
            at = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.record_batch([pa.array(fp[at]), pa.array(fp[root[at]])], ["a", "b"])

    return run


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components ``root`` after further links."""
    return local_components(len(root), np.concatenate([np.arange(len(root)), a]), np.concatenate([root, b]))


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``df``: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable by links."""
    fps = materialize(fingerprints(df, id_col, text_col, shingle))
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = connected_components(tiled_links(classes, radius)).withColumnRenamed("node", "fp")
    rooted = classes.join(comp, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(heads, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: list[str | None], size: int = NEAR_SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (of 32 bits) of each text."""
    h, starts = shingles(texts, size)
    h = (h >> np.uint64(32)).astype(np.uint32)
    out = []
    for t, a, z in zip(texts, starts[:-1].tolist(), starts[1:].tolist()):
        words = t.encode("utf-8", "surrogatepass").translate(_LOWER).split() if t and a == z else []
        out.append(np.array([xxhash.xxh32_intdigest(b" ".join(words), 42)], np.uint32) if words else np.unique(h[a:z]))
    return out


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def wide_fingerprints(sets: list[np.ndarray], words: int = NEAR_WORDS) -> np.ndarray:
    """SimHashes of ``64 * words`` bits, a row of ``words`` unsigned longs for each set."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([np.empty(0, np.uint32), *sets]).astype(np.uint64)
    base = np.repeat(np.arange(len(sets)) * 256, sizes)
    out = np.zeros((len(sets), words, 8), np.uint8)
    for w in range(words):
        h = mixed(mixed(flat + np.uint64((w + 1) << 32))).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            # How often each value of this byte occurs in a set gives the counts of its eight bits.
            seen = np.bincount(base + h[:, byte], minlength=256 * len(sets)).reshape(-1, 256)
            out[:, w, byte] = np.packbits(2 * (seen @ _BITS) > sizes[:, None], axis=1, bitorder="little")[:, 0]
    return out.reshape(len(sets), -1).view(np.uint64)


def _columns(rows: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([rows[f"f{w}"].view(np.uint64) for w in range(NEAR_WORDS)], axis=1)


def _candidates(one: dict[str, np.ndarray], two: dict[str, np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of pairs within the radii whose sizes allow the similarity, and their distances."""
    left, right, n, m = _columns(one), _columns(two), one["n"], two["n"]
    step = max(1, _CELLS // len(right))
    for i in range(0, len(left), step):
        near = np.bitwise_count(left[i : i + step, None, 0] ^ right[None, :, 0])
        a, b = np.nonzero(near <= FIRST_RADIUS)
        d = near[a, b].astype(np.int64)
        a += i
        for w in range(1, NEAR_WORDS):
            d += np.bitwise_count(left[a, w] ^ right[b, w])
            some = d <= NEAR_RADIUS
            a, b, d = a[some], b[some], d[some]
        some = (np.minimum(n[a], m[b]) >= similarity * np.maximum(n[a], m[b])) & (one["cls"][a] != two["cls"][b])
        yield a[some], b[some], d[some]


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


_FAR = 1 << 62


def _nearest(similarity: float):
    """Of each text its nearest candidate in a pair of parts, and links that span the candidates: ``a, b, d``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two in _pairs_of_parts(batches):
            cut, cls = len(one["cls"]), np.concatenate([one["cls"], two["cls"]])
            # Of each text the distance of its nearest candidate, above that candidate's place.
            root, best = np.arange(len(cls)), np.full(len(cls), _FAR)
            for a, b, d in _candidates(one, two, similarity):
                b += cut
                np.minimum.at(best, a, d << 32 | b)
                np.minimum.at(best, b, d << 32 | a)
                apart = root[a] != root[b]
                if apart.any():
                    root = _joined(root, a[apart], b[apart])
            at, span = np.flatnonzero(best < _FAR), np.flatnonzero(root != np.arange(len(cls)))
            mate, best = best & 0xFFFFFFFF, best >> 32
            far = np.full(len(span), _FAR >> 32)
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in ((cls[at], cls[span]), (cls[mate[at]], cls[root[span]]), (best[at], far))], ["a", "b", "d"])

    return run


def _verified(similarity: float):
    """Links that span those pairs of a block which are similar enough and not yet in one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two in _pairs_of_parts(batches):
            names, comp = np.unique(np.concatenate([one["c"], two["c"]]), return_inverse=True)
            cut, root, links = len(one["c"]), np.arange(len(names)), []
            for a, b, _ in _candidates(one, two, similarity):
                while True:
                    apart = root[comp[a]] != root[comp[b + cut]]
                    a, b = a[apart], b[apart]
                    at = next((i for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())) if _jaccard(np.frombuffer(one["s"][x], "<u4"), np.frombuffer(two["s"][y], "<u4")) >= similarity), None)
                    if at is None:
                        break
                    links.append((one["cls"][a[at]], two["cls"][b[at]]))
                    root = _joined(root, comp[a[at : at + 1]], comp[b[at : at + 1] + cut])
                    a, b = a[at + 1 :], b[at + 1 :]
            yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return run


def near_links(classes: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, part: int = NEAR_PART, block: tuple[int, int] = BLOCK) -> DataFrame:
    """Links ``a, b`` that span each group of classes (``cls, n, f0..``) linked by the similarity of their shingle sets.

    ``sets`` gives ``cls, s`` (the set's bytes) of the classes in a table with the column ``cls``.
    """
    n_tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["cls", "n", *(f"f{w}" for w in range(NEAR_WORDS))]
    # Sizes of similar sets are in the same band or in neighbouring ones; bit counts differ by no more than the radius.
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / similarity)))
    ones = sum((F.bit_count(f"f{w}") for w in range(1, NEAR_WORDS)), F.bit_count("f0"))
    width = NEAR_RADIUS + 1
    steps = -(-64 * NEAR_WORDS // width) + 3
    tiled = classes.where("n > 0").select((band * steps + F.floor(ones / width) + 1).cast("long").alias("tile"), *columns)
    shifts = [0, 1, steps - 1, steps, steps + 1]
    near = tiled.withColumn("tile", F.explode(F.array(*(F.col("tile") + s for s in shifts))))
    dealt = _dealt(tiled, near, "cls", part, part)
    found = materialize(dealt.repartition(n_tasks, "g").sortWithinPartitions("g", "side").mapInArrow(_nearest(similarity), "a long, b long, d long"))

    groups = materialize(connected_components(found.select("a", "b")).select(F.col("node").alias("cls"), F.col("component").alias("tile")))
    texts = materialize(sets(groups.select("cls")))
    pairs = found.where(F.col("d") <= NEAR_RADIUS).groupBy("a").agg(F.min(F.struct("d", "b"))["b"].alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_jaccard(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")) >= similarity for x, y in zip(b.column("x"), b.column("y"))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = texts.select(F.col("cls").alias("a"), F.col("s").alias("x")), texts.select(F.col("cls").alias("b"), F.col("s").alias("y"))
    links = materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"))

    # Candidates that these links leave apart: all but each group's largest component are held against the whole group.
    comp = connected_components(links).select(F.col("node").alias("cls"), F.col("component").alias("c"))
    named = materialize(groups.join(comp, "cls", "left").select("cls", "tile", F.coalesce("c", "cls").alias("c")))
    parts = named.groupBy("tile", "c").agg(F.count("*").alias("k"))
    main = materialize(parts.groupBy("tile").agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("tile", "main").coalesce(FEW))
    apart = materialize(named.join(main, "tile").join(classes, "cls").join(texts, "cls").select("tile", "main", "c", "s", *columns))
    rest = _dealt(apart.where("c <> main").drop("main"), apart.drop("main"), "cls", *block)
    more = materialize(rest.repartition(n_tasks, "g").sortWithinPartitions("g", "side").mapInArrow(_verified(similarity), "a long, b long"))
    discard(apart)
    return links.unionByName(more)


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``df`` for each group of texts linked by similar sets of shingles."""
    prepare(df.sparkSession)
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"), F.xxhash64(df[text_col]).alias("hash"))
    words = [f"f{w}" for w in range(NEAR_WORDS)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in text_groups(b.column("text")):
                sets = shingle_sets(b.column("text")[i:j].to_pylist(), size)
                cls = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                fp = wide_fingerprints(sets).view(np.int64)
                yield pa.record_batch([b.column("id")[i:j], b.column("hash")[i:j], pa.array(cls), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(fp[:, w]) for w in range(NEAR_WORDS))], ["id", "hash", "cls", "n", *words])

    rows = materialize(docs.mapInArrow(sketch, f"id {docs.schema['id'].dataType.simpleString()}, hash long, cls long, n long, " + ", ".join(f"{w} long" for w in words)))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("first")
    classes = materialize(rows.groupBy("cls").agg(first, *(F.first(c).alias(c) for c in ("n", *words))))

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = some.join(classes, "cls").select("cls", F.col("first.id").alias("_i"), F.col("first.hash").alias("_h"))
        texts = docs.join(wanted, F.col("id").eqNullSafe(F.col("_i")) & (F.col("hash") == F.col("_h"))).groupBy("cls").agg(F.min("text").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j in text_groups(b.column("text")):
                    yield pa.record_batch([b.column("cls")[i:j], pa.array([s.tobytes() for s in shingle_sets(b.column("text")[i:j].to_pylist(), size)], pa.binary())], ["cls", "s"])

        return texts.mapInArrow(run, "cls long, s binary")

    comp = connected_components(near_links(classes, sets_of, similarity)).select(F.col("node").alias("cls"), "component")
    heads = classes.select("cls", "first").join(comp, "cls", "left").groupBy(F.coalesce("component", "cls").alias("root")).agg(F.min("first").alias("first"))
    key, hash_, nth = fresh(df, "_id"), fresh(df, "_head"), fresh(df, "_nth")
    heads = materialize(heads.select(F.col("first.id").alias(key), F.col("first.hash").alias(hash_)))
    kept = df.join(heads, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(hash_)), "left_semi")
    if rows.groupBy("id", "hash").count().where("count > 1").isEmpty():
        return kept  # no row is there twice: the texts need no further shuffle
    equal = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(*(F.xxhash64(c) for c in hashable(df)))
    return kept.withColumn(nth, F.row_number().over(equal)).where(F.col(nth) == 1).drop(nth)
