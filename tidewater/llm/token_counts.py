"""Token counts by a whole-token shortcut over a byte-level BPE vocabulary.

Before any text is read, the vocabulary itself is encoded, string by string: those strings that come back as their own
single id are *whole*. A text is cut into the tokenizer's pre-tokens; a whole pre-token counts one, by a look-up, and
only the rest is merged, each new one once for a worker's table of bounded size. Pre-tokens never influence each other,
so the sum is the tokenizer's own count. Texts with a character that the tokenizer may class otherwise than the pattern
used here (found by comparing the two over the basic plane; all characters beyond it) go to the tokenizer whole, and so
does everything where the file describes another kind of tokenizer.

Nothing is shuffled: a text is counted in the task that reads it. Long texts are counted stretch by stretch, cut where a
pre-token always ends, so what is held is bounded by a stretch, or by one word without spaces where that is longer.

Defined results: a null or empty text has no tokens and no bytes; strings of special tokens count as the tokenizer has
them by default (one token each); repeated rows are counted each, and rows with null or equal ids stay rows of their own,
as equal texts have equal counts there are no ties to break; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import filterfalse
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tidewater.llm.bin_packing import tokenizer_path
from tidewater.llm.common import prepare, text_groups

LIMIT = 512
#: Entries of a worker's table of pre-tokens, and the longest merged one that stays in it.
KNOWN, LONGEST = 600_000, 128
#: Characters after which a text is cut at the next safe place.
STRETCH = 1 << 19

# Fixed value: the pre-tokens of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A space before a letter and after a sign begins a pre-token, whatever else the text holds.
_SAFE = re.compile("(?<=[!-~])(?= [A-Za-z])")
_LOADED: dict[tuple[str, bool], ByteBpe] = {}
_DOUBTS: dict[str, str] = {}


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in parts of ``size`` characters or somewhat more, cut where pre-tokens end."""
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are themselves, the others follow from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """A tokenizer file, what was proved of its vocabulary, and a table of what was merged so far.

    ``plain`` takes the strings of special tokens as ordinary text. ``doubtful`` are the characters that :meth:`compare` finds.
    """

    def __init__(self, path: str, plain: bool = False, doubtful: str | None = None):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.split = regex.compile(PRE_TOKEN).findall
        added = [t["content"] for t in spec.get("added_tokens", [])]
        simple = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens", []))
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added and not plain else None
        #: Whether the shortcut holds for this file at all.
        self.applies = (
            simple and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and spec.get("normalizer") is None and spec.get("post_processor") is None and spec.get("truncation") is None and spec.get("padding") is None
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        )
        if not self.applies:
            self.whole, self.ids, self.doubtful = {}, {}, None
            return
        self.whole = self._whole(model["vocab"])
        self.ids = dict(self.whole)
        self.letter = {b: c for c, b in byte_alphabet().items()}.__getitem__
        self.doubtful = re.compile("[" + re.escape(self.compare() if doubtful is None else doubtful) + "\U00010000-\U0010ffff]")

    def _whole(self, vocab: dict[str, int]) -> dict[str, bytes]:
        """The strings of the vocabulary that encode alone as their one token, with their ids as bytes."""
        of = byte_alphabet()
        strings: list[tuple[str, int]] = []
        for s, i in vocab.items():
            try:
                strings.append((bytes(of[c] for c in s).decode(), i))
            except (KeyError, UnicodeDecodeError):  # part of a character: never a pre-token
                continue
        found = self.tok.encode_batch_fast([s for s, _ in strings], add_special_tokens=False)
        return {s: array("I", [i]).tobytes() for (s, i), e in zip(strings, found) if e.ids == [i]}

    def compare(self) -> str:
        """Characters of the basic plane beside which the tokenizer and the pattern cut differently."""
        chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
        cells = [f"1{c}1a{c}a!{c}! {c}{c}\n" for c in chars]
        text = "".join(cells)
        starts = np.cumsum([0] + [len(c) for c in cells])
        mine = {m.span() for m in regex.finditer(PRE_TOKEN, text)}
        its = {tuple(span) for _, span in self.tok.pre_tokenizer.pre_tokenize_str(text)}
        wrong = np.array(sorted({i for span in mine ^ its for i in range(*span)}), dtype=np.int64)
        return "".join(chars[k] for k in np.unique(np.searchsorted(starts, wrong, "right") - 1))

    def pre_tokens(self, text: str) -> list[str] | None:
        """The pre-tokens of a text without special tokens, or none where only the tokenizer itself may cut it."""
        if not self.applies or self.doubtful.search(text):
            return None
        return self.split(text)

    def merge(self, pre_token: str) -> bytes:
        """The ids of one pre-token, by the merges of the model."""
        return array("I", [t.id for t in self.tok.model.tokenize("".join(map(self.letter, pre_token.encode())))]).tobytes()

    def ids_of(self, parts: list[str]) -> bytes:
        """The ids of pre-tokens, as bytes; new ones are merged, and kept unless they are very long."""
        try:
            return b"".join(map(self.ids.get, parts))
        except TypeError:  # there are new ones
            new = {p for p in parts if p not in self.ids}
        if len(self.ids) + len(new) > KNOWN:
            self.ids = dict(self.whole)
            new = {p for p in parts if p not in self.ids}
        self.ids.update((p, self.merge(p)) for p in new)
        found = b"".join(map(self.ids.__getitem__, parts))
        for p in new:
            if len(p) > LONGEST:
                del self.ids[p]
        return found

    def count(self, text: str) -> tuple[int, int]:
        """Tokens of a text, and how many of them were counted without merging."""
        total = direct = 0
        for part in stretches(text):
            at = 0
            for m in self.special.finditer(part) if self.special else ():
                n, d = self._count(part[at : m.start()])
                total, direct, at = total + n + 1, direct + d, m.end()
            n, d = self._count(part[at:] if at else part)
            total, direct = total + n, direct + d
        return total, direct

    def _count(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        parts = self.pre_tokens(text)
        if parts is None:
            return len(self.tok.encode(text, add_special_tokens=False).ids), 0
        rest = list(filterfalse(self.whole.__contains__, parts))
        merged = len(self.ids_of(rest)) // 4
        return len(parts) - len(rest) + merged, len(parts) - len(rest)


def load(path: str, plain: bool = False, doubtful: str | None = None) -> ByteBpe:
    """The tokenizer of a file, once for each process."""
    if (path, plain) not in _LOADED:
        _LOADED[path, plain] = ByteBpe(path, plain, doubtful)
    return _LOADED[path, plain]


def doubtful(path: str) -> str:
    """What the driver tells its tasks: the characters (a handful) beside which a file's tokenizer and the pattern differ."""
    if path not in _DOUBTS:
        known = ByteBpe(path, doubtful="")
        _DOUBTS[path] = known.compare() if known.applies else ""
    return _DOUBTS[path]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text, and ``n_whole``, the tokens counted without merging."""
    prepare(df.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.json")
    doubts = doubtful(path)
    d = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(path, doubtful=doubts)
        for b in batches:
            texts = b.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            counts = [tokens.count(t) if t else (0, 0) for i, j in text_groups(texts) for t in texts[i:j].to_pylist()]
            n, whole = (pa.array(x, pa.int64()) for x in (zip(*counts) if counts else ([], [])))
            yield pa.record_batch([b.column("doc_id"), sizes, n, pc.greater(n, limit), whole], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
