"""Alignment of two tokenizations of each text by a static interval index.

The tokens of B are disjoint byte ranges in order, so their ends, sorted once, are a static index; two bisections (stabbing
queries at a token's first byte and at its end) give the run of B tokens that a token of A overlaps. A place between two
tokens of A that no token of B spans ends a group. All texts of a batch are laid end to end, so one call bisects them all.

Encoding works on units that cannot influence each other: pre-tokens for A, and for B stretches that begin with spaces,
since no piece of its vocabulary holds a space behind another character (checked when it is loaded; where it does not hold,
a text is one unit). New units are encoded once for a worker's table of bounded size.

How often an id pair is linked is counted over all documents. A document's links are kept as its different pairs with their
numbers, so texts are encoded once. The most frequent pairs, ``HEAD`` at most, are looked up in a table of that size which
every task has; all other links are joined with their counts by pair, and none of those pairs is frequent, so no key is hot.
The highest counts of B ids are one row for each entry of B's vocabulary.

Defined results: null and empty texts, and texts whose tokens do not spell a space and the text (B drops or changes some
characters), have zeros and an empty ``groups_sha256``; strings of special tokens are plain text; equal counts are all the
highest; repeated rows count each, and rows with null or equal ids stay rows of their own; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import token_counts
from tidewater.llm.bin_packing import tokenizer_path
from tidewater.llm.common import discard, materialize, prepare, text_groups

#: Id pairs that every task holds (a proven bound: the table is cut there, and the others are joined).
HEAD = 1 << 16
#: Entries of a worker's table of units, and the longest unit that enters it.
KNOWN, LONGEST = 600_000, 128
#: Bytes of text that are aligned at once; a longer text is a batch by itself.
BATCH = 2 << 20

#: Spaces and what follows them, and, where letters touch full stops, commas or line ends, the letters and the signs apart.
_LETTER, _SIGNS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0370-\u052f]", ".,\n"
_UNIT = re.compile(f" *{_LETTER}++(?![^ {_SIGNS}])|[{_SIGNS}]++(?={_LETTER})| *[^ ]+| +")
_MIXED = re.compile(f"{_LETTER}[{_SIGNS}]|[{_SIGNS}]{_LETTER}|[^▁]▁")
_LOADED: dict[str, Pieces] = {}


class Pieces:
    """B: a sentence-piece model, encoded unit by unit."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        # Units are apart where no piece crosses their borders, spaces are neither dropped nor joined, and a line end stays a
        # byte by itself, behind which a unit that has no space before it can be encoded.
        mixed = any(_MIXED.search(p) for i, p in enumerate(names) if not self.model.is_byte(i))
        self.lead = self.model.encode("\n", num_threads=1)
        self.space = self.lead[0] if len(self.lead) == 2 and self.model.is_byte(self.lead[1]) and names[self.lead[0]] == "▁" else None
        self.apart = not mixed and self.space is not None and self.spelled(self.model.encode("a  b", num_threads=1)) == b" a  b"
        self.known: dict[str, bytes | bool] = {}

    def spelled(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def units(self, units: Iterable[str]) -> Iterator[bytes | bool]:
        """Ids of each unit; false where they do not spell it. The model adds the space that a unit begins with."""
        for u in units:
            ids = self.model.encode(u[1:] if u[0] == " " else "\n" + u, num_threads=1)
            if u[0] != " ":
                ids = ids[2:] if ids[:2] == self.lead else []
            elif u == " ":
                ids = [self.space]
            yield array("I", ids).tobytes() if self.spelled(ids) == u.encode() else False

    def encode(self, text: str) -> bytes | None:
        """Ids of a text that begins with a space."""
        if not self.apart:
            ids = self.model.encode(text[1:], num_threads=1)
            return array("I", ids).tobytes() if self.spelled(ids) == text.encode() else None
        units = _UNIT.findall(text)
        try:
            return b"".join(map(self.known.get, units))
        except TypeError:  # a unit is not known yet, or known not to be spelled
            new = {u for u in units if u not in self.known}
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = set(units)
        self.known.update(zip(new, self.units(new)))
        found = list(map(self.known.__getitem__, units))
        for u in new:
            if len(u) > LONGEST:
                del self.known[u]
        if len(self.known) > KNOWN:  # a text of more units than that
            self.known.clear()
        return None if any(ids is False for ids in found) else b"".join(found)


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


class Bytes:
    """A: a byte-level tokenizer, special strings taken as plain text."""

    def __init__(self, path: str, doubts: str):
        self.tokens = token_counts.load(path, True, doubts)
        of = token_counts.byte_alphabet()
        vocab = self.tokens.tok.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes: list[bytes] = [b""] * len(self.lengths)
        for s, i in vocab.items():
            b = bytes(of[c] for c in s) if all(c in of for c in s) else s.encode()
            self.bytes[i], self.lengths[i] = b, len(b)

    def encode(self, text: str) -> bytes | None:
        """Ids of a text; none where they do not spell it."""
        t, out = self.tokens, []  # ids of the parts, as bytes
        for part in token_counts.stretches(text):
            parts = t.pre_tokens(part)
            if parts is None:
                ids = t.tok.encode(part, add_special_tokens=False).ids
                if b"".join(map(self.bytes.__getitem__, ids)) != part.encode():
                    return None
                out.append(array("I", ids).tobytes())
                continue
            out.append(t.ids_of(parts))
        return b"".join(out)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of A the first token of B that it overlaps and how many there are, and whether a group ends with it.

    Both lists of ends rise and finish at the same byte.
    """
    starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    first = np.searchsorted(ends_b, starts_a, "right")
    behind = np.searchsorted(starts_b, ends_a, "left")
    return first, behind - first, ends_b[behind - 1] == ends_a


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``first[i], first[i] + 1, ...``, ``count[i]`` of them, one after the other."""
    before = np.cumsum(count) - count
    return np.arange(count.sum()) - np.repeat(before - first, count)


def align_batch(texts: list[str | None], a: Bytes, b: Pieces, words: list[bytes]) -> list[tuple]:
    """``n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` of each text; a pair is ``A id * len(B) + B id``."""
    empty = (0, 0, 0, 0, "", [], [])
    rows: list[tuple] = [empty] * len(texts)
    kept, ids_a, ids_b = [], [], []
    for i, t in enumerate(texts):
        if t and (y := b.encode(" " + t)) is not None and (x := a.encode(" " + t)) is not None:
            kept.append(i)
            ids_a.append(x)
            ids_b.append(y)
    if not kept:
        return rows
    n_a, n_b = (np.array([len(x) // 4 for x in ids]) for ids in (ids_a, ids_b))
    ta, tb = (np.frombuffer(b"".join(ids), np.uint32).astype(np.int64) for ids in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(a.lengths[ta]), np.cumsum(b.lengths[tb])
    first, count, closes = overlaps(ends_a, ends_b)
    doc_a = np.repeat(np.arange(len(kept)), n_a)
    # The groups as one run of numbers: of a group first A's tokens, then B's, each with the sign that follows it.
    group_a = np.cumsum(closes) - closes
    last_a = np.flatnonzero(closes)
    last_b = np.searchsorted(ends_b, ends_a[last_a])
    group_b = np.repeat(np.arange(len(last_b)), np.diff(last_b, prepend=-1))
    va, vb = len(a.lengths), len(b.lengths)
    place_a = np.arange(len(ta)) + np.append(0, last_b + 1)[group_a]
    place_b = np.arange(len(tb)) + (last_a + 1)[group_b]
    run = np.empty(len(ta) + len(tb), np.int64)
    run[place_a] = ta + va * closes
    ends_group = np.zeros(len(tb), bool)
    ends_group[last_b] = True
    run[place_b] = 2 * va + tb + vb * ends_group
    # Links, and the different pairs of each document: one sort of numbers that hold both.
    bits = int(va * vb - 1).bit_length()
    codes = np.repeat(doc_a << bits | ta * vb, count) + tb[_expand(first, count)]
    codes.sort()
    at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    pair, times, pair_doc = codes[at] & (1 << bits) - 1, np.diff(np.append(at, len(codes))), codes[at] >> bits
    cuts = np.searchsorted(pair_doc, np.arange(len(kept) + 1))
    n_links = np.bincount(doc_a, count, len(kept))
    n_groups = np.bincount(doc_a[last_a], minlength=len(kept))
    places = np.append(0, np.cumsum(n_a + n_b)).tolist()
    for k, i in enumerate(kept):
        said = b"".join(map(words.__getitem__, run[places[k] : places[k + 1]].tolist()))[:-1]
        rows[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), hashlib.sha256(said).hexdigest(), pair[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]])
    return rows


def aligned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, int]:
    """Each document's own figures and its different id pairs with their numbers (``pairs, times``), and the size of B's vocabulary."""
    prepare(df.sparkSession)
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    doubts = token_counts.doubtful(path_a)
    d = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Bytes(path_a, doubts), pieces(path_b)
        words = [b"%d%s" % (i, sign) for n, signs in ((len(a.lengths), b",|"), (len(b.lengths), b",;")) for sign in (signs[:1], signs[1:]) for i in range(n)]
        for batch in batches:
            for i, j in text_groups(batch.column("text"), BATCH):
                rows = align_batch(batch.column("text")[i:j].to_pylist(), a, b, words)
                yield pa.record_batch([batch.column("doc_id")[i:j], *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], ["doc_id", *names])

    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return d.mapInArrow(run, schema), pieces(path_b).model.get_piece_size()


def rated_pairs(links: DataFrame, size_b: int) -> DataFrame:
    """``pair, count, best``: how many links hold an id pair, and whether no pair of its B id has more."""
    counts = materialize(links.groupBy("pair").agg(F.sum("times").alias("count")))
    highest = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", F.col("pair") % size_b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, head: int = HEAD) -> DataFrame:
    """One row for each document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    own, size_b = aligned(df, id_col, text_col, path_a, path_b)
    stored = materialize(own.withColumn("_row", F.monotonically_increasing_id()))
    links = stored.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_l")).select("_row", F.col("_l.pairs").alias("pair"), F.col("_l.times").alias("times"))
    rated = materialize(rated_pairs(links, size_b))
    frequent = F.broadcast(materialize(rated.orderBy(F.desc("count"), "pair").limit(head)))  # at most ``head`` rows
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    common = links.join(frequent, "pair").groupBy("_row").agg(*sums)
    rare = links.join(frequent.select("pair"), "pair", "left_anti").join(rated, "pair").groupBy("_row").agg(*sums)
    totals = common.unionByName(rare).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = stored.drop("pairs", "times").join(totals, "_row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")


def groups_of(text: str, path_a: str | None = None, path_b: str | None = None) -> list[tuple[list[int], list[int]]]:
    """The groups of one text as A ids and B ids, for a look at them."""
    path_a = path_a or tokenizer_path("byte_bpe_50k.json")
    a, b = Bytes(path_a, token_counts.doubtful(path_a)), pieces(path_b or tokenizer_path("piece_bpe_32k.model"))
    x, y = a.encode(" " + text) if text else None, b.encode(" " + text) if text else None
    if x is None or y is None:
        return []
    ta, tb = (np.frombuffer(v, np.uint32) for v in (x, y))
    ends_a, ends_b = np.cumsum(a.lengths[ta]), np.cumsum(b.lengths[tb])
    cut_a = np.flatnonzero(overlaps(ends_a, ends_b)[2]) + 1
    cut_b = np.searchsorted(ends_b, ends_a[cut_a - 1]) + 1
    return [(u.tolist(), v.tolist()) for u, v in zip(np.split(ta, cut_a[:-1]), np.split(tb, cut_b[:-1]))]
