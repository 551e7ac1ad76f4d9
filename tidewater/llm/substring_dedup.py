"""Near-duplicate passages by compact windows.

A text's tokens are its word shingles, hashed. Under each of several hash functions, the Cartesian tree of a
text's min-hashes groups its subsequences by the position of their minimum: a compact window ``(l, c, r)``
stands for all subsequences within ``[l, r]`` that hold ``c``, which share the min-hash of ``c``; only windows
of at least the passage length are made, about ``2 n / length`` of them. Windows whose min-hash one document
alone has are dropped. An interval join inside each document finds where windows of two hash functions share a
subsequence of passage length: the two minima and their distance are its signature. Documents of equal
signature are candidates, the first and the last standing for all that have it; overlapping windows of one
pair and diagonal become one stretch, verified on the shingles themselves.

Subsequences of passage length for which no standing document of a smaller id is verified are grouped by the hash
of all their shingles. Two texts that share ``passage`` words share the signature of these under every two hash
functions, so they meet there at the latest: verbatim passages are found however many documents have a signature, and
whichever stand for it. Places of a signature that lie in no passage of a smaller document after that are held against
each other where they can have one. A passage of the similarity asked for misses few of its shingles in the other text, so
it shares one of any few more than these: of the rarest, those that no other document left has, which cannot be shared,
first. Places that share such a shingle are held against each other; where these are many, the smallest document first, and
all pairs of what that leaves. So edited passages are found beside any document with about the probability that two of the hash functions agree, 0.9 for one of passage
length at the similarity asked for. In text that repeats itself within a passage's length, some of a document's
repetitions may be left out of its rows.

Defined results: words are runs without ASCII white space, in lower case (A-Z); texts of fewer words than a
passage, and null texts, have none; repeats inside one document do not count; rows of equal id and text are
one document, rows of one id (or of a null id) with other texts are others; very long texts are taken whole, by
themselves; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import discard, fresh, materialize, plainly_named, prepare, text_groups, whole_groups, with_texts
from tidewater.llm.quality_rules import mixed, rolled

SHINGLE = 5
PASSAGE = 50
#: Hash functions, four at most; two of them make a signature.
HASHES = 3
SIMILARITY = 0.8
#: Shingles by which insertions and deletions may move a passage off its diagonal.
GAP = 12
ROUND = 64
#: Places left with a signature and a shingle are all held against each other up to this number; of more the first stands for all, first.
FEW = 16
STRETCH = ("doc", "ref", "lo", "hi", "off", "core_lo", "core_hi", "far_lo", "far_hi")

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
#: Bytes hashed at a time; a longer text is taken by itself.
_BUFFER = 1 << 20
_POWERS: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))
_BITS = np.uint64(24)
_LONG = (1 << 24) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers, up to ``n``, of an odd number and of its inverse modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, _BUFFER), base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        if n > _BUFFER:
            return both[0], both[1]
        _POWERS = (both[0], both[1])
    return _POWERS


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of texts, one text after the other, and the number of words of each.

    Bytes become random numbers, prefix sums of these times rising powers give every word's polynomial at
    once, and a division by the power of its place makes that independent of the place.
    """
    raw = [t.encode("utf-8", "surrogatepass").translate(_LOWER) if t else b"" for t in texts]
    hashes, counts = [], []
    i = 0
    while i < len(raw):
        j, total = i, 0
        while j < len(raw) and (j == i or total + len(raw[j]) + 1 <= _BUFFER):
            total += len(raw[j]) + 1
            j += 1
        buf = np.frombuffer(b"\n".join(raw[i:j]) + b"\n", np.uint8)
        up, down = _powers(len(buf))
        space = _SPACE[buf]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        first, last = edge[::2], edge[1::2]
        total_so_far = np.cumsum(_TABLE[buf] * up[: len(buf)])
        before = np.where(first > 0, total_so_far[first - 1], np.uint64(0))
        hashes.append(mixed((total_so_far[last - 1] - before) * down[first]))
        ends = np.cumsum([len(r) + 1 for r in raw[i:j]])
        counts.append(np.diff(np.searchsorted(first, ends), prepend=0))
        i = j
    none = np.empty(0, np.int64)
    return np.concatenate([none.astype(np.uint64), *hashes]), np.concatenate([none, *counts])


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of whole texts, one text after the other, and where each begins (and the last ends)."""
    one, count = word_hashes(texts)
    each = np.maximum(count - size + 1, 0)
    starts = np.concatenate([[0], np.cumsum(each)])
    if len(one) < size:
        return np.empty(0, np.uint64), starts
    every = mixed(rolled(one, (size,))[size])
    # Shingles that begin in a text's last words would reach into the next text.
    keep = np.arange(starts[-1]) + np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]) - starts[:-1], each)
    return every[keep], starts


def compact_windows(h: np.ndarray, least: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``l, c, r`` of all compact windows of at least ``least`` tokens; of equal values the leftmost is the minimum.

    ``starts`` are the beginnings, and the last end, of the sequences that ``h`` holds one after the other.
    """
    starts = np.array([0, len(h)]) if starts is None else starts
    parts: list[tuple[np.ndarray, ...]] = []
    i = 0
    while i < len(starts) - 1:
        if starts[i + 1] - starts[i] > _LONG:  # positions must fit beside the hash: overlapping stretches, so no passage of up to half of one is lost
            for at in range(int(starts[i]), int(starts[i + 1]), _LONG // 2):
                end = min(at + _LONG, int(starts[i + 1]))
                parts.append(tuple(x + at for x in _windows(h[at:end], least, np.array([0, end - at]))))
                if end == starts[i + 1]:
                    break
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _LONG - len(starts), "right")) - 1)
        parts.append(tuple(x + starts[i] for x in _windows(h[starts[i] : starts[j]], least, starts[i : j + 1] - starts[i])))
        i = j
    if not parts:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.unique(np.stack([np.concatenate(x) for x in zip(*parts)]), axis=1)) if len(parts) > 1 else parts[0]


def _windows(h: np.ndarray, least: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # A zero between sequences is smaller than all tokens, so no window crosses it.
    none = (np.empty(0, np.int64),) * 3
    shift = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    n = len(h) + len(starts) - 2
    if n < least:
        return none
    place = np.arange(len(h)) + shift
    key = np.arange(n, dtype=np.uint64)
    key[place] |= np.maximum(h >> _BITS, np.uint64(1)) << _BITS
    # Minima of all stretches of ``least`` tokens, from prefix and suffix minima of blocks of that length.
    padded = np.full(-(-n // least) * least, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, least)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - least + 1
    low = np.minimum(behind[:m], ahead[least - 1 : least - 1 + m])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    final = np.concatenate([first[1:], [m]]) - 1
    value = low[first]
    c = (value & np.uint64(_LONG)).astype(np.int64)
    # A smaller token within ``least`` of c ends its run of stretches; one further away is itself a minimum here,
    # so the tree of these minima gives the rest.
    before, after, stack = [0] * len(c), [n - 1] * len(c), []
    for i, (k, at) in enumerate(zip(value.tolist(), c.tolist())):
        while stack and stack[-1][0] > k:
            after[stack.pop()[2]] = at - 1
        before[i] = stack[-1][1] + 1 if stack else 0
        stack.append((k, at, i))
    left = np.where(first > np.maximum(0, c - least + 1), first, np.where(first == 0, 0, before))
    right = np.where(final < np.minimum(c, m - 1), final + least - 1, np.where(final == m - 1, n - 1, after))
    token = value >> _BITS > 0
    left, c, right = left[token], c[token], right[token]
    back = np.zeros(n, np.int64)
    back[place] = shift
    off = back[c]
    return left - off, c - off, right - off


def windows(docs: DataFrame, size: int, least: int, hashes: int) -> DataFrame:
    """``key, doc, w`` of all documents' compact windows; a key belongs to one hash function.

    ``w`` holds the place of the minimum, how far the window reaches to its left and right (at most ``2 * least - 1``,
    twice a passage) and the number of the hash function.
    """
    clip = 2 * least - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for i, j in text_groups(texts):
                s, starts = shingles(texts[i:j].to_pylist(), size)
                for k in range(hashes):
                    h = mixed(s ^ np.uint64(0xA24BAED4963EE407 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
                    lo, c, hi = compact_windows(h, least, starts)
                    doc = np.searchsorted(starts, c, "right") - 1
                    w = (c - starts[doc]) << 34 | np.minimum(c - lo, clip) << 18 | np.minimum(hi - c, clip) << 2 | k
                    yield pa.record_batch([pa.array(h[c].view(np.int64)), ids.take(pa.array(doc + i)), pa.array(w)], ["key", "doc", "w"])

    return docs.mapInArrow(run, "key long, doc long, w long")


def signatures(rows: dict[str, np.ndarray], least: int, hashes: int) -> dict[str, np.ndarray]:
    """Interval join of whole documents' windows: where windows of two hash functions share a stretch of ``least`` shingles.

    ``rows`` (``doc``, ``w``, ``key``) are sorted by document and window. The new ``key`` stands for both minima and the
    distance between them; ``place`` holds the first minimum and how far the intersection of the two windows reaches
    to both sides of it. The first place of a key in its document is given as it is, other places as ``-1 - place``.
    """
    doc, w, key = rows["doc"], rows["w"], rows["key"].view(np.uint64)
    k, c = w & 3, w >> 34
    left, right = w >> 18 & 0xFFFF, w >> 2 & 0xFFFF
    base = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 32 if len(doc) else doc
    first, final = base + c - np.minimum(left, least - 1), base + c + np.minimum(0, right - least + 1)
    out: dict[str, list[np.ndarray]] = {"key": [], "doc": [], "place": []}
    for one in range(hashes):
        for two in range(one + 1, hashes):
            a, b = np.flatnonzero(k == one), np.flatnonzero(k == two)
            if not len(a) or not len(b):
                continue
            start = np.union1d(first[a], first[b])
            a, b = (x[np.maximum(np.searchsorted(first[x], start, "right") - 1, 0)] for x in (a, b))
            both = (first[a] <= start) & (first[b] <= start) & (np.minimum(final[a], final[b]) >= start)
            a, b = a[both], b[both]
            reach = np.minimum(left[a], c[a] - c[b] + left[b]), np.minimum(right[a], c[b] - c[a] + right[b])
            out["key"].append(mixed(key[a] * np.uint64(3) + key[b] * np.uint64(5) + (c[b] - c[a]).view(np.uint64)).view(np.int64))
            out["doc"].append(doc[a])
            out["place"].append(c[a] << 32 | reach[0] << 16 | reach[1])
    joined = {n: np.concatenate([np.empty(0, np.int64), *x]) for n, x in out.items()}
    order = np.lexsort((joined["place"], joined["key"], joined["doc"]))
    d, x, place = (joined[n][order] for n in ("doc", "key", "place"))
    again = np.concatenate([[False], (d[1:] == d[:-1]) & (x[1:] == x[:-1])])[: len(d)]
    # In periodic text a signature comes again every few words: places in one quarter of a passage become one, which
    # reaches as far to the right as any of them.
    quarter = (place >> 32) // max(1, least // 4)
    new = ~again
    new[1:] |= quarter[1:] != quarter[:-1]
    start = np.flatnonzero(new)
    if len(start):
        end = np.maximum.reduceat((place >> 32) + (place & 0xFFFF), start)
        d, x, again = d[start], x[start], again[start]
        place = (place[start] >> 16 << 16) | end - (place[start] >> 32)
        place[again] = -1 - place[again]
    return {"key": x, "doc": d, "place": place}


def stretches(rows: dict[str, np.ndarray], least: int) -> dict[str, np.ndarray]:
    """Stretches of two documents to compare: windows of one pair and diagonal that overlap become one.

    ``rows`` are whole documents' ``doc, ref, place, other``. Returns ``doc, ref, lo, hi, off`` (of the other text
    over this one's place), ``core_lo, core_hi``, what lies within a passage of the minima, and ``far_lo, far_hi``, the
    other text's part to look at, rounded so that documents held against one text ask for few different parts.
    """
    at, other = rows["place"], rows["other"]
    c = at >> 32
    off = (other >> 32) - c
    lo = c - np.minimum(at >> 16 & 0xFFFF, other >> 16 & 0xFFFF)
    hi = c + np.minimum(at & 0xFFFF, other & 0xFFFF)
    order = np.lexsort((lo, off, rows["ref"], rows["doc"]))
    doc, ref, off, lo, hi, c = (x[order] for x in (rows["doc"], rows["ref"], off, lo, hi, c))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (off[1:] != off[:-1])])
    # A running maximum within each pair and diagonal: the group's number is the upper part of the value.
    group = np.cumsum(new) << 32
    top = np.maximum.accumulate(group + hi)
    start = np.flatnonzero(new | np.concatenate([[True], group[1:] + lo[1:] > top[:-1]]))
    core_lo, core_hi = np.maximum(lo, c - least + 1), np.minimum(hi, c + least - 1 + least // 4)
    doc, ref, off, lo, hi = doc[start], ref[start], off[start], lo[start], np.maximum.reduceat(hi, start)
    far_lo, far_hi = np.maximum(0, lo + off - GAP) // ROUND * ROUND, (hi + off + GAP) // ROUND * ROUND + ROUND - 1
    return dict(zip(STRETCH, (doc, ref, lo, hi, off, np.minimum.reduceat(core_lo, start), np.maximum.reduceat(core_hi, start), far_lo, far_hi)))


def passages(x: np.ndarray, y: np.ndarray, off: int, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Passages of two shingle sequences that agree near the diagonal ``off``: ``(start, end, other start, other end, similarity)``.

    From left to right the longest stretch is taken that the other sequence holds to the share which that similarity
    needs, edits counted on both sides; where its sets are less similar, shorter ones inside it with a higher share.
    """
    n = len(x)
    if n < least:
        return []
    place = np.arange(n) + off
    inside = (place >= 0) & (place < len(y))
    same = np.zeros(n, bool)
    same[inside] = x[inside] == y[place[inside]]
    where = np.where(same, place, -1)
    missed = np.flatnonzero(~same)
    if len(missed) and len(y):
        order = np.argsort(y, kind="stable")
        rank = y[order]
        value = np.searchsorted(rank, x[missed])
        value[value == len(y)] = 0
        wide = 2 * (n + len(y) + GAP) + abs(off)
        places = np.cumsum(np.concatenate([[0], rank[1:] != rank[:-1]])) * wide + order
        base = places[value] - order[value]
        low = base + np.maximum(place[missed] - GAP, 0)
        at = np.minimum(np.searchsorted(places, low), len(y) - 1)
        ok = (rank[value] == x[missed]) & (places[at] >= low) & (places[at] <= base + place[missed] + GAP)
        where[missed[ok]] = order[at[ok]]
    held = where >= 0

    def measured(a: int, b: int) -> tuple[int, int, int, int, float] | None:
        c, d = int(where[a]), int(where[b - 1]) + 1
        if b - a == d - c and same[a:b].all():
            return a, b, c, d, 1.0
        if d <= c:
            return None
        one, two = np.unique(x[a:b]), np.unique(y[c:d])
        both = len(np.intersect1d(one, two, assume_unique=True))
        found = both / (len(one) + len(two) - both)
        return (a, b, c, d, found) if found >= similarity else None

    def search(lo: int, hi: int, shares: tuple[float, ...]) -> Iterator[tuple[int, int, int, int, float]]:
        while hi - lo >= least:
            total = np.concatenate([[0.0], np.cumsum(held[lo:hi] - shares[0])])
            ends = np.where(np.concatenate([[False], held[lo:hi]]), total, -np.inf)
            best = np.maximum.accumulate(ends[::-1])[::-1]  # of all ends from here on: falls from left to right
            starts = np.flatnonzero(held[lo : hi - least + 1] & (best[least:] >= total[: hi - lo - least + 1] - 1e-9))
            if not len(starts):
                return
            a = int(starts[0])
            b = int(np.searchsorted(-best, -(total[a] - 1e-9), "right")) - 1
            if p := measured(lo + a, lo + b):
                yield p
            elif len(shares) > 1:
                yield from search(lo + a, lo + b, shares[1:])
            lo += b

    share = 2 * similarity / (1 + similarity)
    return list(search(0, n, (share, (1 + 2 * share) / 3, (2 + share) / 3, 1.0)))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, size: int = SHINGLE, hashes: int = HASHES, similarity: float = SIMILARITY) -> DataFrame:
    """One row per passage of a document that another document, ``ref_doc_id``, has too, and that lies in no longer one.

    ``doc_id, start_word, n_words, ref_doc_id, ref_start_word, ref_n_words, similarity``: words count from 0.
    Of the documents that have a passage one is named, so a passage of many gives a row for each and not for every pair.
    """
    docs, names = _documents(df, id_col, text_col)
    found = _with_both_sides(_repeated(docs, passage, size, hashes, similarity), round(similarity * passage))
    if names is None:
        kind = df.schema[id_col].dataType.simpleString()
        return found.withColumns({c: F.col(c).cast(kind) for c in ("doc_id", "ref_doc_id")})
    own = names.select(F.col("row").alias("doc_id"), F.col("id").alias("_d"))
    ref = names.select(F.col("row").alias("ref_doc_id"), F.col("id").alias("_r"))
    return found.join(own, "doc_id").join(ref, "ref_doc_id").select(F.col("_d").alias("doc_id"), "start_word", "n_words", F.col("_r").alias("ref_doc_id"), "ref_start_word", "ref_n_words", "similarity")


def _documents(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``doc_id, text`` with a document's own number as ``doc_id``, and the ``id, hash`` of each number ``row``.

    The numbers are the ids, and there is no table of them, if these are whole numbers of which none is null or has
    two rows; otherwise they count through ids (null last) and hashes of texts.
    """
    prepare(df.sparkSession)
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
            return docs.withColumn("doc_id", F.col("doc_id").cast("long")), None
    hashed = docs.select("doc_id", F.xxhash64("text").alias("hash"))
    # Partitions of a sorted table are in its order, and so are these numbers.
    names = hashed.distinct().orderBy(F.col("doc_id").asc_nulls_last(), "hash")
    names = materialize(names.select(F.col("doc_id").alias("id"), "hash", F.monotonically_increasing_id().alias("row")))
    d = docs.withColumn("_h", F.xxhash64("text"))
    numbered = d.join(names, d["doc_id"].eqNullSafe(names["id"]) & (d["_h"] == names["hash"])).groupBy("row").agg(F.min("text").alias("text"))
    return materialize(numbered.select(F.col("row").alias("doc_id"), "text")), names


_STRETCHES = ", ".join(f"{c} long" for c in STRETCH)
_FOUND = "doc_id long, start_word int, n_words int, ref_doc_id long, ref_start_word int, ref_n_words int, similarity double"


def _repeated(docs: DataFrame, passage: int = PASSAGE, size: int = SHINGLE, hashes: int = HASHES, similarity: float = SIMILARITY) -> DataFrame:
    """The passages of documents (each id once): rows are not yet given for both documents of a pair."""
    least = passage - size + 1
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def by_document(rows: DataFrame, order: list[str], work, schema: str, by: str = "doc") -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in whole_groups(batches, by):
                out = work(g)
                yield pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()], list(out))

        return rows.repartition(n, by).sortWithinPartitions(by, *order).mapInArrow(run, schema)

    # Windows of keys that at least two documents have. Tables of keys are written before they are joined, so that
    # a join has two shuffles of its own and a hot key can be split.
    w = materialize(windows(docs, size, least, hashes))
    ends = [F.min("doc").alias("first"), F.max("doc").alias("last")]
    shared = materialize(w.groupBy("key").agg(*ends).where("first <> last").select("key"))
    met = w.join(shared, "key", "left_semi")
    signed = materialize(by_document(met, ["w"], lambda g: signatures(g, least, hashes), "key long, doc long, place long"))
    discard(w)

    # The documents of smallest and largest id stand for all that have a signature.
    lead = F.when(F.col("place") >= 0, F.col("doc"))
    stand = signed.groupBy("key").agg(*ends, F.min_by("place", lead).alias("first_place"), F.max_by("place", lead).alias("last_place"))
    stand = materialize(stand.where("first <> last"))
    place = F.when(F.col("place") >= 0, F.col("place")).otherwise(-1 - F.col("place")).alias("place")
    held = F.array(F.struct(F.col("first").alias("ref"), F.col("first_place").alias("other")), F.struct(F.col("last").alias("ref"), F.col("last_place").alias("other")))
    # A document is held against both; the first one only with its further places, since the last is held against it.
    pairs = signed.join(stand, "key").select("doc", place, F.explode(F.when((F.col("doc") != F.col("first")) | (F.col("place") < 0), held)).alias("r")).where("doc <> r.ref")
    todo = materialize(by_document(pairs.select("doc", "place", "r.ref", "r.other"), ["ref"], lambda g: stretches(g, least), _STRETCHES))
    checked = _verified(docs, todo, least, size, similarity)
    found = checked.where("hash is null").drop("hash")
    found = materialize(found.unionByName(_verbatim(checked.where("hash is not null").select(F.col("doc_id").alias("doc"), "start_word", "hash"), least, size, by_document)))

    # What no document of a smaller id was found to have: places of a signature that share a shingle which a passage of theirs
    # cannot do without are held against each other. Where many have it, the smallest document stands for it first.
    rest = _left(signed.join(stand.select("key", "first"), "key").select("key", "doc", place.alias("place"), ((F.col("doc") == F.col("first")) & (F.col("place") >= 0)).alias("stood")), found, size)
    wanted = rest.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("place").alias("w"))  # bounded by the text's own places
    texts = materialize(docs.join(wanted, "doc_id").select("doc_id", "text", "w"))
    rest, alike = _parted(rest, texts, least, size, similarity, by_document)
    parts = materialize(rest.groupBy("key").agg(F.count("*").alias("n"), F.max(F.when(F.col("probe"), F.col("doc"))).alias("last"), F.min(F.struct("doc", "place")).alias("f")).where("f.doc < last"))
    several, many = (rest.join(parts.where(w).select("key", "f"), "key") for w in (F.col("n") <= FEW, F.col("n") > FEW))

    def held(pairs: DataFrame) -> DataFrame:
        pairs = alike.join(pairs.where("ref < doc").distinct(), ["sign", "doc", "context"])
        todo = materialize(by_document(_held(pairs, least), [], lambda g: stretches(g, least), _STRETCHES, "pair"))
        return materialize(_verified(texts.drop("w"), todo, least, size, similarity, False).drop("hash"))

    more = held(_beside(several).unionByName(many.where("probe").select("sign", "doc", "context", F.col("f.doc").alias("ref"), F.col("f.place").alias("other"))))
    found = found.unionByName(more)
    rest = _left(many.withColumn("stood", (F.col("doc") == F.col("f.doc")) & (F.col("place") == F.col("f.place"))), more, size, "sign", "context", "probe")
    return found if rest.isEmpty() else found.unionByName(held(_beside(rest)))


def _left(signed: DataFrame, found: DataFrame, size: int, *more: str) -> DataFrame:
    """The places ``key, doc, place`` (and ``more``) over whose minimum no passage lies that a document of a smaller id has,
    of keys that two documents are left with.

    The first place of the first document was held against all (``stood``).
    """
    null = F.lit(None).cast("long")
    spans = found.where("ref_doc_id < doc_id").select(null.alias("key"), F.col("doc_id").alias("doc"), null.alias("place"), *(F.lit(None).cast(signed.schema[c].dataType).alias(c) for c in more), F.col("start_word").cast("long").alias("at"), (F.col("start_word") + F.col("n_words")).cast("long").alias("end"))
    places = signed.where("not stood").select("key", "doc", "place", *more, F.shiftright("place", 32).alias("at"), null.alias("end"))
    reach = Window.partitionBy("doc").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    rest = places.unionByName(spans).withColumn("_z", F.max("end").over(reach)).where(F.col("key").isNotNull() & (F.col("_z").isNull() | (F.col("at") + size > F.col("_z"))))
    rest = materialize(rest.select("key", "doc", "place", *more))
    many = materialize(rest.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("key"))
    return materialize(rest.join(many, "key", "left_semi"))


def roomy(held: np.ndarray, least: int, share: float) -> np.ndarray:
    """Where parts of ``least`` shingles or more begin of which the share is held."""
    if len(held) < least:
        return np.empty(0, np.int64)
    total = np.concatenate([[0.0], np.cumsum(held - share)])
    best = np.maximum.accumulate(total[::-1])[::-1]  # of all ends from here on
    return np.flatnonzero(best[least:] >= total[: len(held) - least + 1] - 1e-9)


def probes(n: np.ndarray, least: int, share: float) -> np.ndarray:
    """Places of shingles, the rarest, such that any passage in a stretch has one of them in common with its other text.

    ``n`` tells how many hold each shingle of the stretch, 0 if no other text does. A passage has ``least`` shingles or more
    of which the other text holds the ``share``; of its parts of ``least`` to ``2 * least - 1`` shingles one has that share too,
    so of the first ``least`` of such a part no more are missed than the share allows the longest that may begin there.
    """
    total = np.concatenate([[0.0], np.cumsum((n > 0) - share)])
    out = np.zeros(len(n), bool)
    for i in roomy(n > 0, least, share).tolist():
        lengths = np.flatnonzero(total[i + least : i + 2 * least] >= total[i] - 1e-9)
        if len(lengths):
            part = n[i : i + least]
            missed = int((least + int(lengths[-1])) * (1 - share) + 1e-9)
            out[i + np.argsort(part, kind="stable")[: missed + 1]] = True
    return np.flatnonzero(out & (n > 0))


def _parted(rest: DataFrame, texts: DataFrame, least: int, size: int, similarity: float, by_document) -> tuple[DataFrame, DataFrame]:
    """``key, sign, doc, place, context, probe`` of the places left that can have a passage, or be what another one's is found in: a
    key for the signature and each shingle around the place that comes again around the places left. ``probe`` tells which
    shingles a passage of the place must share one of. ``context`` is the hash of all that a place is held against others with:
    of a document's places of a signature ``sign`` that are alike in it the first stands for all, which the other table gives.

    ``texts`` hold the places ``w`` of each document. What a passage is found in has the similarity's share of its shingles,
    and as many at least; if one of both repeats itself, as many as lie between the passage's ends moved by a gap.
    """
    share, shortest = 2 * similarity / (1 + similarity), int(np.ceil(similarity * least - 1e-9))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lists, ids = b.column("text"), b.column("w"), b.column("doc_id")
            for i, j in text_groups(texts):
                s, starts = shingles(texts[i:j].to_pylist(), size)
                part = lists[i:j]
                base = np.repeat(np.arange(j - i), pc.list_value_length(part).to_numpy())
                w = part.flatten().to_numpy()
                c = w >> 32
                cover = np.zeros(len(s) + 1, np.int64)
                np.add.at(cover, np.maximum(starts[base] + c - (w >> 16 & 0xFFFF) - GAP, starts[base]), 1)
                np.add.at(cover, np.minimum(starts[base] + c + (w & 0xFFFF) + GAP + 1, starts[base + 1]), -1)
                at = np.flatnonzero(np.cumsum(cover)[:-1])
                doc = np.searchsorted(starts, at, "right") - 1
                yield pa.record_batch([ids.take(pa.array(doc + i)), pa.array(at - starts[doc]), pa.array(s[at].view(np.int64))], ["doc", "at", "hash"])

    near = materialize(texts.mapInArrow(around, "doc long, at long, hash long"))
    shared = materialize(near.groupBy("hash").agg(F.count("*").alias("n"), (F.min("doc") < F.max("doc")).cast("long").alias("others")).where("n > 1"))

    def mark(g: dict[str, np.ndarray]) -> dict[str, pa.Array | np.ndarray]:
        one = g["n"] > 0
        base = np.cumsum(np.concatenate([[0], g["doc"][1:] != g["doc"][:-1]])) << 32
        at, hashes, n, others = (base + g["at"])[one], g["hash"][one], g["n"][one], g["others"][one]
        base, key, doc, place = (x[~one] for x in (base, g["hash"], g["doc"], g["place"]))
        c, left, right = place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF
        lo, hi = np.searchsorted(at, base + np.maximum(0, c - left - GAP)), np.searchsorted(at, base + c + right + GAP + 1)
        known: dict[tuple[int, int], tuple] = {}
        flags: dict[str, list] = {"context": [], "open": [], "near": [], "again": [], "each": [], "probe": []}
        seen: set[tuple[int, int, int]] = set()
        first = np.zeros(len(place), bool)
        for i, (b, k, p, x, y) in enumerate(zip(base.tolist(), key.tolist(), place.tolist(), lo.tolist(), hi.tolist())):
            if (b, p) not in known:
                start, width = b + (p >> 32) - (p >> 16 & 0xFFFF), (p >> 16 & 0xFFFF) + (p & 0xFFFF) + 1
                inside = at[x:y] - start
                counts = np.zeros(width + 2 * GAP, np.int64)
                counts[inside + GAP] = n[x:y]
                own = counts[GAP : GAP + width].copy()
                own[inside[(others[x:y] == 0) & (inside >= 0) & (inside < width)]] = 0
                own = probes(own, least, share)
                context = hashlib.blake2b(hashes[x:y].tobytes() + inside.tobytes() + p.to_bytes(8, "little")[:4], digest_size=8).digest()
                each, which = np.unique(hashes[x:y], return_inverse=True)
                again = len(each) < y - x
                near = [len(roomy(counts > 0, m, similarity)) > 0 for m in (least - 2 * GAP, shortest)]
                known[b, p] = int.from_bytes(context, "little", signed=True), near[not again], near[0], again, each, np.isin(np.arange(len(each)), which[np.isin(inside, own)])
            for name, flag in zip(flags, known[b, p]):
                flags[name].append(flag)
            alike = (b, k, known[b, p][0])
            first[i] = alike not in seen
            seen.add(alike)
        sought = np.array([f.any() for f in flags["probe"]], bool)
        each, probe = ([f if one else f[:0] for f, one in zip(flags[name], first)] for name in ("each", "probe"))
        many = np.array([len(x) for x in each], np.int64)
        parts = mixed(np.concatenate([hashes[:0], *each]).view(np.uint64) ^ mixed(np.repeat(key, many).view(np.uint64))).view(np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
        probe = np.concatenate([np.empty(0, bool), *probe])
        return {"key": key, "doc": doc, "place": place, "context": np.array(flags["context"], np.int64), "open": np.array(flags["open"], bool), "near": np.array(flags["near"], bool), "again": np.array(flags["again"], bool), "sought": sought, "part": pa.ListArray.from_arrays(ends, pa.array(parts)), "probe": pa.ListArray.from_arrays(ends, pa.array(probe))}

    nothing = F.lit(0).cast("long")
    rows = near.join(shared, "hash").select("doc", "at", "hash", "n", "others", nothing.alias("place"))
    rows = rows.unionByName(rest.select("doc", F.shiftright("place", 32).alias("at"), F.col("key").alias("hash"), nothing.alias("n"), nothing.alias("others"), "place"))
    marked = materialize(by_document(rows, ["at"], mark, "key long, doc long, place long, context long, open boolean, near boolean, again boolean, sought boolean, part array<long>, probe array<boolean>"))
    discard(near)
    sought = materialize(marked.where("sought").groupBy("key").agg(F.max("doc").alias("last"), F.bool_or("again").alias("any")))
    parts = marked.join(sought, "key").where("sought or doc < last and (open or any and near)")
    parts = parts.select(F.col("key").alias("sign"), "doc", "place", "context", F.inline(F.arrays_zip("part", "probe")))
    return materialize(parts.select(F.col("part").alias("key"), "sign", "doc", "place", "context", "probe")), marked.where("sought").select(F.col("key").alias("sign"), "doc", "context", "place")


def _held(pairs: DataFrame, least: int) -> DataFrame:
    """Of ``doc, place, ref, other``, each once those whose windows have room for a passage, by pairs of documents."""
    side = lambda bits: F.least(*(F.shiftright(c, bits).bitwiseAND(0xFFFF) for c in ("place", "other")))
    pairs = pairs.where("ref < doc").where(side(16) + side(0) + 1 + GAP >= least).select("doc", "ref", "place", "other").distinct()
    return pairs.select(F.xxhash64("doc", "ref").alias("pair"), "doc", "ref", "place", "other")


def _beside(places: DataFrame) -> DataFrame:
    """Places that seek a key beside those of other documents."""
    others = places.select("key", F.col("doc").alias("ref"), F.col("place").alias("other"))
    return places.where("probe").join(others, "key").where("ref < doc").select("sign", "doc", "context", "ref", "other")


def _verified(docs: DataFrame, todo: DataFrame, least: int, size: int, similarity: float, others: bool = True) -> DataFrame:
    """The passages in stretches; and (``others``), with a ``hash`` and no ``ref_doc_id``, where no document of a smaller id has one."""
    # The stretches' shingles: of a document, each with the one it is held against; of a standing document, each once.
    own = todo.select(F.col("doc").alias("doc_id"), F.struct(F.lit(0).cast("long").alias("role"), *STRETCH[1:]).alias("w"))
    other = todo.select("ref", "far_lo", "far_hi").distinct()
    other = other.select(F.col("ref").alias("doc_id"), F.struct(F.lit(1).cast("long").alias("role"), "ref", *((F.col(c) if c else F.lit(0).cast("long")).alias(n) for n, c in zip(STRETCH[2:], ("far_lo", "far_hi", "", "", "", "far_lo", "far_hi")))).alias("w"))
    wanted = own.unionByName(other).groupBy("doc_id").agg(F.collect_list("w").alias("w"))  # bounded by the text's own stretches

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lists, ids = b.column("text"), b.column("w"), b.column("doc_id").to_numpy()
            for i, j in text_groups(texts):
                s, starts = shingles(texts[i:j].to_pylist(), size)
                s = (s >> np.uint64(32)).astype("<u4")
                part = lists[i:j]
                doc = np.repeat(np.arange(j - i), pc.list_value_length(part).to_numpy())
                fields = part.flatten()
                lo, hi = (fields.field(c).to_numpy() for c in ("lo", "hi"))
                ends = np.minimum(starts[doc] + hi + 1, starts[doc + 1])
                raw = [s[p:q].tobytes() for p, q in zip((starts[doc] + lo).tolist(), ends.tolist())]
                yield pa.record_batch([fields.field("role"), pa.array(ids[i + doc]), *(fields.field(c) for c in STRETCH[1:]), pa.array(raw, pa.binary())], ["role", *STRETCH, "s"])

    joined = docs.join(wanted, "doc_id").select("doc_id", "text", "w")
    cut = materialize(joined.mapInArrow(slices, ", ".join(f"{c} long" for c in ("role", *STRETCH)) + ", s binary"))
    left = cut.where("role = 0").drop("role")
    right = cut.where("role = 1").select("ref", "far_lo", "far_hi", F.col("s").alias("t"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
        names = ["doc_id", "start_word", "n_words", "ref_doc_id", "ref_start_word", "ref_n_words", "similarity", "hash"]
        for b in batches:
            out: list[tuple] = []
            docs, places, picked = ([np.empty(0, np.int64)] for _ in range(3))
            stretched, before = [np.empty(0, np.uint32)], 0
            for r in zip(*(b.column(c).to_pylist() for c in ("doc", "ref", "lo", "far_lo", "off", "core_lo", "core_hi", "s", "t"))):
                doc, ref, lo, far, off, core_lo, core_hi, s, t = r
                n, shift = len(s) // 4, lo + off - far
                whole = n >= least and shift >= 0 and t.startswith(s, 4 * shift)
                if whole:  # verbatim
                    out.append((doc, lo, n + size - 1, ref, far + shift, n + size - 1, 1.0, None))
                    if ref < doc or not others:
                        continue
                x, y = np.frombuffer(s, "<u4"), np.frombuffer(t, "<u4")
                open_ = np.full(max(0, n - least + 1), others)
                open_[: max(0, core_lo - lo)] = False
                open_[max(0, core_hi - lo - least + 2) :] = False
                for a, z, c, d, sim in [] if whole else passages(x, y, shift, least, similarity):
                    out.append((doc, lo + a, z - a + size - 1, ref, far + c, d - c + size - 1, sim, None))
                    if ref < doc:
                        open_[a : z - least + 1] = False
                at = np.flatnonzero(open_)
                if len(at):
                    docs.append(np.full(len(at), doc))
                    places.append(at + lo)
                    picked.append(at - at[0] + before)
                    stretched.append(x[at[0] : at[-1] + least])
                    before += len(stretched[-1])
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names)
            doc, place, pick = map(np.concatenate, (docs, places, picked))
            h = stretch_hashes(np.concatenate(stretched), least)[pick] if before else pick
            yield pa.record_batch([pa.array(doc), pa.array(place.astype(np.int32)), *(pa.nulls(len(doc), k) for k in kinds[2:7]), pa.array(h)], names)

    checked = materialize(left.join(right, ["ref", "far_lo", "far_hi"]).mapInArrow(verify, f"{_FOUND}, hash long"))
    discard(cut)
    return checked


def _verbatim(rest: DataFrame, least: int, size: int, by_document) -> DataFrame:
    """Passages among the stretches that no standing document verified: those whose hash another document has too."""
    rest = materialize(rest.distinct())
    spot = F.struct("doc", "start_word")
    twice = rest.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last")
    twice = materialize(twice)
    places = rest.join(twice, "hash").where("doc = first or doc = last").groupBy("hash", "first", "last").agg(F.min(F.when(F.col("doc") == F.col("first"), spot))["start_word"].alias("a"), F.min(F.when(F.col("doc") == F.col("last"), spot))["start_word"].alias("z"))
    places = materialize(places)
    one = rest.join(places, "hash").select("doc", F.col("start_word").cast("long").alias("at"), F.when(F.col("doc") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("ref"), F.when(F.col("doc") == F.col("first"), F.col("z")).otherwise(F.col("a")).cast("long").alias("far"))

    def runs(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order = np.lexsort((g["at"], g["ref"], g["doc"]))
        doc, ref, at, far = (g[n][order] for n in ("doc", "ref", "at", "far"))
        # A stretch goes on while the other text's part does, or, in periodic text, stays where it is.
        start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (at[1:] != at[:-1] + 1) | (np.abs(far[1:] - far[:-1]) > least)]))
        words = np.diff(np.append(start, len(doc))) + least + size - 2
        low, high = np.minimum.reduceat(far, start), np.maximum.reduceat(far, start)
        number = lambda x: x.astype(np.int32)
        return {"doc_id": doc[start], "start_word": number(at[start]), "n_words": number(words), "ref_doc_id": ref[start], "ref_start_word": number(low), "ref_n_words": number(high - low + least + size - 1), "similarity": np.ones(len(start))}

    return by_document(one, ["ref", "at"], runs, _FOUND)


def stretch_hashes(x: np.ndarray, least: int) -> np.ndarray:
    """A 64-bit hash of every stretch of ``least`` shingles."""
    return mixed(rolled(mixed(x), (least,))[least]).view(np.int64)


def _longest(found: DataFrame) -> DataFrame:
    """Of each document's passages, those that do not lie in another."""
    best = Window.partitionBy("doc_id", "start_word").orderBy(F.desc("n_words"), F.desc("similarity"), "ref_doc_id", "ref_start_word")
    found = found.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    reach = Window.partitionBy("doc_id").orderBy("start_word").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_z", F.max(F.col("start_word") + F.col("n_words")).over(reach)).where("_z is null or start_word + n_words > _z").drop("_z")


def _with_both_sides(found: DataFrame, least: int) -> DataFrame:
    """Add the standing documents' own rows: each of their passages of ``least`` words beside the smallest document that has it."""
    found = materialize(found)
    spot = F.min(F.struct("doc_id", "start_word", "n_words", "similarity")).alias("p")
    back = found.where(F.col("ref_n_words") >= least).groupBy("ref_doc_id", "ref_start_word", "ref_n_words").agg(spot)
    back = back.select(F.col("ref_doc_id").alias("doc_id"), F.col("ref_start_word").alias("start_word"), F.col("ref_n_words").alias("n_words"), F.col("p.doc_id").alias("ref_doc_id"), F.col("p.start_word").alias("ref_start_word"), F.col("p.n_words").alias("ref_n_words"), F.col("p.similarity").alias("similarity"))
    return _longest(found.unionByName(back))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``df`` with each repeated passage cut from all documents but one: words that a document of a smaller id
    (null last; of one id, of a smaller text hash) has too go.

    A document of which nothing is left stays, with an empty text; other texts stay as they are.
    """
    columns, df = df.columns, plainly_named(df)
    docs, names = _documents(df, id_col, text_col)
    key, hash_, list_ = fresh(df, "_id"), fresh(df, "_hash"), fresh(df, "_spans")
    found = materialize(_repeated(docs, **how))
    later = found.where("ref_doc_id < doc_id").select("doc_id", "start_word", "n_words")
    back = found.where("ref_doc_id > doc_id").select(F.col("ref_doc_id").alias("doc_id"), F.col("ref_start_word").alias("start_word"), F.col("ref_n_words").alias("n_words"))
    spans = later.unionByName(back).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_word", "n_words"))).alias(list_))  # bounded by the text's own places
    if names is None:
        spans = spans.withColumnRenamed("doc_id", key)
        joined = df.join(spans, F.col(id_col) == F.col(key), "left").drop(key)
    else:
        spans = names.join(spans, F.col("row") == F.col("doc_id")).select(F.col("id").alias(key), F.col("hash").alias(hash_), list_)
        joined = df.join(spans, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(hash_)), "left").drop(key, hash_)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if s is None or t is None else trimmed(t, [(p["start_word"], p["n_words"]) for p in s]) for t, s in zip(b.column(text_col).to_pylist(), b.column(list_).to_pylist())]
            yield with_texts(b.drop_columns([list_]), text_col, texts)

    return joined.mapInArrow(cut, df.schema).toDF(*columns)


def trimmed(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and the white space behind each span."""
    ends = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, at = [], 0
    for start, n in sorted(spans):
        if start < len(ends):
            a = ends[start][0]
            z = ends[start + n][0] if start + n < len(ends) else len(text)
            out.append(text[at : max(at, a)])
            at = max(at, z)
    return "".join([*out, text[at:]])
