"""Token counts and token alignment against the libraries and brute force."""

import hashlib
import random
from collections import Counter

import pytest
from public_tokenizers import path

from tidewater.llm import token_alignment, token_counts


@pytest.fixture(scope="module")
def byte_tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("byte_bpe_50k.json"))


#: Pieces of text on which pre-tokens, special strings, spaces and rare characters depend.
POOL = ["a", "b", "c", "é", "'s", "'ll", "1", "2", "½", "\n", "\n\n", "\t", " ", "  ", "　", "\x85", "\x1c", "​", "<|endoftext|>", "<s>", "<0x41>", "日", "ͅ", "'", ".", ",", "…", "꟎", "😀", "\x0b", "²", "ﬁ", "\x00", " the", " of", "word", "."]


def _texts(n: int, seed: int, extra: tuple = ()) -> list[str]:
    rng = random.Random(seed)
    pool = [*POOL, *extra]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def _expected_count(tok, t):
    return len(tok.encode(t, add_special_tokens=False).ids) if t else 0


def test_counts_equal_the_tokenizers(spark, odd, docs, byte_tok):
    more = spark.createDataFrame(list(enumerate(_texts(2000, 3))), "doc_id long, text string")
    for df in (odd, docs, more):
        got = token_counts.token_counts(df).collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), _expected_count(byte_tok, r["text"])) for r in df.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 512) and 0 <= r["n_whole"] <= r["n_tokens"] for r in got)


def test_whole_strings_are_single_tokens(byte_tok):
    v = token_counts.load(path("byte_bpe_50k.json"))
    for s in random.Random(1).sample(sorted(v.whole), 500):
        assert len(byte_tok.encode(s, add_special_tokens=False).ids) == 1
    assert "<|endoftext|>" not in v.whole and len(v.whole) > 40_000


def test_long_texts_are_cut_where_pre_tokens_end(docs, byte_tok, monkeypatch):
    v = token_counts.load(path("byte_bpe_50k.json"))
    text = "  ".join(r["text"] for r in docs.where("text is not null").limit(20).collect()) + " <|endoftext|> " + "x" * 3000
    parts = list(token_counts.stretches(text, 64))
    assert len(parts) > 100 and "".join(parts) == text
    assert sum(v.count(p)[0] for p in parts) == _expected_count(byte_tok, text)
    monkeypatch.setattr(token_counts, "KNOWN", len(v.whole) + 10)  # the table is emptied again and again
    assert v.count(text)[0] == _expected_count(byte_tok, text)


def test_other_tokenizers_count_too(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = token_counts.token_counts(docs, path=path("word_bpe_49k.json"))
    want = {r["doc_id"]: _expected_count(tok, r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == want


def _brute(df):
    """The digest of every document, token by token and pair by pair."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    of = token_counts.byte_alphabet()

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    rows, total = [], Counter()
    for doc, text in df:
        if not text:
            rows.append((doc, 0, 0, 0, [], ""))
            continue
        a, b, whole = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text), (" " + text).encode()
        ba, bb = [bytes(of[c] for c in tok.id_to_token(i)) for i in a], [piece(i) for i in b]
        if b"".join(ba) != whole or b"".join(bb) != whole:
            rows.append((doc, 0, 0, 0, [], ""))
            continue
        sa, sb = spans(ba), spans(bb)
        links, low = [], 0
        for i, (s, e) in enumerate(sa):
            while sb[low][1] <= s:
                low += 1
            j = low
            while j < len(sb) and sb[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        groups, at = [], 0
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        ia = ib = 0
        for at in ends:
            ga, gb = [], []
            while ia < len(sa) and sa[ia][1] <= at:
                ga.append(a[ia])
                ia += 1
            while ib < len(sb) and sb[ib][1] <= at:
                gb.append(b[ib])
                ib += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        total.update(links)
        rows.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in total.items():
        best[y] = max(best.get(y, 0), n)
    return Counter((doc, na, nb, ng, len(ls), sum(total[x] == best[x[1]] for x in ls), sum(total[x] for x in ls), sha) for doc, na, nb, ng, ls, sha in rows)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("head", [token_alignment.HEAD, 50, 1])
def test_alignment_equals_brute_force(spark, docs, head):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate([None, "", " ", "  ", *_texts(400, 5, ("▁",))])], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(more)
    got = Counter(tuple(r[c] for c in COLUMNS) for r in token_alignment.align_tokens(df, head=head).collect())
    assert got == _brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_alignment_of_odd_rows(spark, odd, empty):
    got = Counter(tuple(r[c] for c in COLUMNS) for r in token_alignment.align_tokens(odd).collect())
    assert got == _brute([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    assert token_alignment.align_tokens(empty).collect() == [] == token_counts.token_counts(empty).collect()


def test_groups_spell_the_text():
    groups = token_alignment.groups_of("Tokenization of naïve 日本 words")
    a, b = token_alignment.Bytes(path("byte_bpe_50k.json"), token_counts.doubtful(path("byte_bpe_50k.json"))), token_alignment.pieces(path("piece_bpe_32k.model"))
    spelled = [(b"".join(a.bytes[i] for i in x), b.spelled(y)) for x, y in groups]
    assert all(x == y for x, y in spelled) and b"".join(x for x, _ in spelled).decode() == " Tokenization of naïve 日本 words"
    assert token_alignment.groups_of("") == []
