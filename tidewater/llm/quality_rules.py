"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines.

Every whole text is read once in Arrow batches. Words become small integers, n-gram hashes of several
lengths are rolled from shorter ones in numpy, and positions whose hash occurs twice or more in the text
mark the words they cover; a word counts once however many duplicated n-grams cover it.

Defined results: a null text counts as empty; an empty text has zero everywhere and fails the base rule;
repeated rows are scored row by row; very long texts are measured whole; an empty table gives an empty result;
other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import prepare

NGRAMS = (5, 8, 10)
#: Largest share, in percent, of word characters inside duplicated n-grams of each length.
NGRAM_LIMITS = (40, 35, 30)
#: Largest share, in percent, of line characters in lines equal to an earlier line.
LINE_LIMIT = 30

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str, raw: bytes) -> list:
    """Maximal runs without ASCII white space; ``str.split`` also splits at other spaces, so it is used only where there are none."""
    return [w.decode() for w in raw.split()] if _ODD_SPACE.search(text) else text.split()


def mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * _PRIME
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolled(one: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Polynomial hashes (modulo 2**64) of all windows of each length, joined from power-of-two windows."""
    power = {1: _PRIME}
    have = {1: one}

    def window(n: int) -> np.ndarray:
        if n not in have:
            a = 1 << ((n - 1).bit_length() - 1)
            b = n - a
            first, rest = window(a), window(b)
            if b not in power:
                power[b] = np.uint64(pow(int(_PRIME), b, 1 << 64))
            m = len(one) - n + 1
            have[n] = first[:m] * power[b] + rest[a : a + m] if m > 0 else one[:0]
        return have[n]

    return {n: window(n) for n in lengths}


def covered(h: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of ``n`` whose hash occurs twice or more."""
    mark = np.zeros(size + 1, np.int32)
    if len(h) > 1:
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        if same.any():
            dup = np.zeros(len(h), bool)
            dup[order[1:][same]] = True
            dup[order[:-1][same]] = True
            at = np.flatnonzero(dup)
            mark[at] += 1
            mark[at + n] -= 1
    return np.cumsum(mark[:-1]) > 0


def measure(text: str | None, ngrams: tuple[int, ...] = NGRAMS) -> tuple:
    """n_words, word_chars, line_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, then one count of characters per n-gram length."""
    if not text:
        return (0,) * (7 + len(ngrams))
    raw = text.encode("utf-8", "surrogatepass")
    words = words_of(text, raw)
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen: set[str] = set()
    line_chars = dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            line_chars += len(line)
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line)
            else:
                seen.add(line)
    ids: dict[str, int] = {}
    one = mixed(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n))
    hashes = rolled(one, (3, *ngrams))
    repeat = int(covered(hashes[3], 3, n).sum())
    chars = [0] * len(ngrams)
    if repeat:  # a longer window occurs twice only if its 3-word windows do
        lens = np.fromiter(map(len, words), np.int64, n)
        chars = [int(lens[covered(hashes[k], k, n)].sum()) for k in ngrams]
    return (n, word_chars, line_chars, symbols, dup_lines, repeat, dup_line_chars, *chars)


def repetition_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngrams: tuple[int, ...] = NGRAMS,
    ngram_limits: tuple[int, ...] = NGRAM_LIMITS,
    line_limit: int = LINE_LIMIT,
) -> DataFrame:
    """One row per row of ``df``: the id, the measures, ``base_failed`` and ``kept``.

    The base rule fails texts of under 50 words, or with over half of the words in repeated 3-word windows.
    A text is kept if it passes that and no coverage is over its limit.
    """
    prepare(df.sparkSession)
    d = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    names = ["n_words", "word_chars", "line_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{k}gram_chars" for k in ngrams)]
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([measure(t.as_py(), ngrams) for t in b.column("text")], np.int64).reshape(-1, len(names))
            out = dict(zip(names, found.T))
            failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
            good = ~failed & (100 * out["dup_line_chars"] <= line_limit * out["line_chars"])
            for k, limit in zip(ngrams, ngram_limits, strict=True):
                good &= 100 * out[f"dup_{k}gram_chars"] <= limit * out["word_chars"]
            yield pa.record_batch([b.column("doc_id"), *map(pa.array, out.values()), pa.array(failed), pa.array(good)], ["doc_id", *names, "base_failed", "kept"])

    return d.mapInArrow(run, schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS gram FROM w, (SELECT unnest([3, 5, 8, 10]) AS n) k, generate_series(1, len(ws) - n + 1) AS s(i)),
dup AS (SELECT doc_id, n, unnest(a) AS i FROM (SELECT doc_id, n, gram, list(i) AS a FROM g GROUP BY ALL HAVING count(*) > 1)),
cov AS (SELECT DISTINCT doc_id, n, i + j AS p FROM dup, generate_series(0, n - 1) AS s(j)),
c AS (SELECT doc_id, n, count(*) AS words, sum(length(ws[p])) AS chars FROM cov JOIN w USING (doc_id) GROUP BY doc_id, n),
p AS (SELECT doc_id, coalesce(max(words) FILTER (n = 3), 0) AS r3, coalesce(max(chars) FILTER (n = 5), 0) AS c5, coalesce(max(chars) FILTER (n = 8), 0) AS c8, coalesce(max(chars) FILTER (n = 10), 0) AS c10 FROM c GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lg AS (SELECT doc_id, line, count(*) AS n, count(*) * length(line) AS ch FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
ls AS (SELECT doc_id, sum(n - 1) AS dup, sum((n - 1) * length(line)) AS dup_chars, sum(ch) AS ch FROM lg GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(coalesce(ls.ch, 0) AS BIGINT) AS line_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(ls.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.r3, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(ls.dup_chars, 0) AS BIGINT) AS dup_line_chars, CAST(coalesce(p.c5, 0) AS BIGINT) AS dup_5gram_chars,
        CAST(coalesce(p.c8, 0) AS BIGINT) AS dup_8gram_chars, CAST(coalesce(p.c10, 0) AS BIGINT) AS dup_10gram_chars
      FROM w LEFT JOIN ls USING (doc_id) LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= 30 * line_chars AND 100 * dup_5gram_chars <= 40 * word_chars
  AND 100 * dup_8gram_chars <= 35 * word_chars AND 100 * dup_10gram_chars <= 30 * word_chars AS kept FROM f
"""
