"""Best-fit packing of tokenized documents by minimum bin slack.

Each sequence starts with the longest remaining piece; a subset-sum dynamic programme over the available
lengths, kept as the bits of one integer, finds the fullest combination that fits beside it, and that
combination is removed. It works on the histogram of piece lengths, of at most ``capacity`` entries
whatever the corpus holds, and removes a combination as many times at once as the counts allow. Pieces then
find their places by their rank among pieces of the same length, so no task sees all pieces of a length.

Defined results: a null or empty text is the end token alone; only documents longer than a sequence are
cut, however long; ids are those of the tokenizer's file as it is, special tokens in a text included; repeated rows
are packed each; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, positions, prepare, text_groups

CAPACITY = 2048
END_ID = 0
#: Entries of a worker's table of word ids.
WORDS = 1_000_000

# Full stops and commas beside other punctuation, with which the tokenizer may join them.
_SIGN = "!-/:-@\\[-`{-~\xa1-\xbf\xd7\xf7"
_RUN = re.compile(f"[.,][{_SIGN}]|[{_SIGN}][.,]")

# A text of these characters alone is normalized (canonical composition, lower case, white space) and split
# at white space in the same way by Python and by the tokenizer; any other text goes to the tokenizer whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ňŊ-ſ]*")
_TOKENIZERS: dict[str, tuple] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str) -> tuple:
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        # Texts that spell a special token, in whatever case, go to the tokenizer whole.
        special = re.compile("|".join(re.escape(x.content) for x in t.get_added_tokens_decoder().values()) or "(?!)", re.IGNORECASE)
        _TOKENIZERS[path] = (t, {}, special)
    return _TOKENIZERS[path]


def token_ids(texts: list[str | None], path: str, group: int = 256) -> Iterator[np.ndarray]:
    """The ids of each text, as the tokenizer gives them. Words of plain texts are looked up; new ones are encoded once."""
    tok, known, special = _tokenizer(path)
    get = known.get
    for at in range(0, len(texts), group):
        found: list[tuple[str | None, list[str] | None, list]] = []
        new: set[str] = set()
        for text in texts[at : at + group]:
            words = _split(text) if text and _PLAIN.fullmatch(text) and not special.search(text) else None
            ids = [get(w) for w in words] if words else []
            if None in ids:
                new.update(w for w, i in zip(words, ids) if i is None)
            found.append((text, words, ids))
        if new:
            if len(known) + len(new) > WORDS:
                known.clear()
            fresh: dict[str, bytes] = {}
            listed = list(new)
            for k in range(0, len(listed), 4096):
                some = listed[k : k + 4096]
                for w, e in zip(some, tok.encode_batch_fast(some, add_special_tokens=False)):
                    fresh[w] = array("I", e.ids).tobytes()
            known.update(fresh)
        for text, words, ids in found:
            if words is None:
                yield np.array(tok.encode(text, add_special_tokens=False).ids if text else [], "<u4")
            else:
                yield np.frombuffer(b"".join([fresh[w] if i is None else i for w, i in zip(words, ids)] if None in ids else ids), "<u4")


def _split(text: str) -> list[str]:
    """Words of a plain text. Lone full stops and commas, which the tokenizer always splits off, become words."""
    if not _RUN.search(text):
        text = text.replace(".", " . ").replace(",", " , ")
    return text.lower().split()


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's pieces, and ``ids`` if asked for."""
    prepare(df.sparkSession)
    path = path or tokenizer_path()
    d = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    names = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in text_groups(b.column("text")):
                rows, row = [], []
                for doc, ids in enumerate(token_ids(b.column("text")[i:j].to_pylist(), path), i):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        p = ids[at : at + capacity]
                        row.append(doc)
                        rows.append((k, at, len(p), zlib.crc32(p.tobytes()), *([p.astype(np.int32)] * with_ids)))
                yield pa.record_batch([b.column("doc_id").take(pa.array(row)), *(pa.array(x, kind) for x, kind in zip(zip(*rows), kinds))], ["doc_id", *names])

    return d.mapInArrow(run, schema)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The longest length, and the lengths that fill what it leaves best: ``(length, how many)``, longest first."""
    lengths = sorted(counts, reverse=True)
    room = capacity - lengths[0]
    reach, steps = 1, []
    within, goal = (1 << room + 1) - 1, 1 << room
    for n in lengths:
        if n > room:
            continue
        left = min(counts[n] - (n == lengths[0]), room // n)
        k = 1
        while left > 0 and not reach & goal:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= reach << n * k & within
            left -= k
            k *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    used = {lengths[0]: 1}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            at -= n * k
            used[n] = used.get(n, 0) + k
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows ``length, first rank, sequences, first sequence, first offset``: one for each length of each combination.

    Of a length's pieces, ``sequences x multiplicity`` from ``first rank`` on go to ``sequences`` sequences.
    """
    counts, taken, rows, seq = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while counts:
        combo = fullest(counts, capacity)
        times = min(counts[n] // k for n, k in combo)
        offset = 0
        for n, k in combo:
            rows.append((n, taken[n], times, seq, offset))
            taken[n] += times * k
            counts[n] -= times * k
            offset += n * k
            if not counts[n]:
                del counts[n]
        seq += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to materialized pieces."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    rows = plan(histogram, capacity)
    # At most a few thousand rows: each combination but the last uses up a length.
    key = rows[:, 0] << 48 | rows[:, 1]
    ranked = positions(cut, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1), "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            r = rows[np.searchsorted(key, n << 48 | rank, "right") - 1]
            nth = rank - r[:, 1]
            b = b.drop_columns(["_rank"])
            yield b.append_column("sequence_id", pa.array(r[:, 3] + nth % r[:, 2])).append_column("offset", pa.array(r[:, 4] + nth // r[:, 2] * n))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.select(*cut.columns, "_rank").mapInArrow(place, schema)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    return packed(materialize(pieces(df, id_col, text_col, capacity, path, with_ids)), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ``ids``: ``sequence_id, ids`` of at most a sequence's tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
