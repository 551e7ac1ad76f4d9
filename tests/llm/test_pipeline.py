"""The passages of the whole query, and the pipeline's rows, against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tidewater.llm import bin_packing, source_mixing, substring_dedup, toxicity

from .test_near_copies import _brute_kept

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _shared(texts, n=50):
    """For each text, which of its words lie in a stretch of ``n`` words that another text has; and the same for earlier texts only."""
    lists = [_words(t) for t in texts]
    holders = {}
    for i, w in enumerate(lists):
        for at in range(len(w) - n + 1):
            holders.setdefault(tuple(w[at : at + n]), set()).add(i)
    out = []
    for i, w in enumerate(lists):
        mark = np.zeros((2, len(w)), bool)
        for at in range(len(w) - n + 1):
            h = holders[tuple(w[at : at + n])]
            mark[0, at : at + n] |= len(h) > 1
            mark[1, at : at + n] |= min(h) < i
        out.append(mark)
    return lists, out


def _jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_repeated_passages_of_whole_tables(docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    lists, marks = _shared([r["text"] for r in rows])
    place = {r["doc_id"]: i for i, r in enumerate(rows)}
    got = substring_dedup.repeated_passages(docs).collect()
    found = [np.zeros(len(w), bool) for w in lists]
    for r in got:
        a, b = lists[place[r["doc_id"]]], lists[place[r["ref_doc_id"]]]
        x, y = a[r["start_word"] : r["start_word"] + r["n_words"]], b[r["ref_start_word"] : r["ref_start_word"] + r["ref_n_words"]]
        assert r["doc_id"] != r["ref_doc_id"] and len(x) == r["n_words"] >= 40 and _jaccard(x, y) >= 0.8 - 1e-9
        found[place[r["doc_id"]]][r["start_word"] : r["start_word"] + r["n_words"]] = True
    want = {i for i, m in enumerate(marks) if m[0].any()}
    assert want and want <= {i for i, f in enumerate(found) if f.any()}
    repeated = sum(int(m[0].sum()) for m in marks)
    assert sum(int((m[0] & ~f).sum()) for m, f in zip(marks, found)) <= 0.001 * repeated


def test_passages_behind_standing_documents(spark):
    """The first and the last document hold only a line of the passage that others share, twice over."""
    rng = np.random.default_rng(31)
    words = lambda n: [f"w{int(x)}" for x in rng.integers(0, 9000, n)]
    passage = words(70)
    line = passage[20:45]
    bodies = [[*words(60), *line, *words(60), *line, *words(30)]] + [[*words(30 + i), *passage, *words(50)] for i in range(12)] + [[*words(40), *line, *words(80)]]
    d = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bodies)], "doc_id long, text string")
    got = substring_dedup.repeated_passages(d).collect()
    assert {r["doc_id"] for r in got if r["n_words"] >= 70} == set(range(1, 13))
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(d).collect()}
    assert [i for i, t in cut.items() if " ".join(passage) in t] == [1] and cut[0] == " ".join(bodies[0]) and cut[13] == " ".join(bodies[13])


def _fixture(spark):
    rng = np.random.default_rng(17)
    words = lambda n: [f"w{int(x)}" for x in rng.integers(0, 6000, n)]
    rows, labels = [], []
    for i in range(90):
        body = words(140)
        if i % 5 == 0:  # toxic words in the texts that are labelled so
            for at in range(3, 140, 9):
                body[at] = ["vilewretch", "scumbag", "loathsome"][at % 3]
            labels.append((i, 1, 1))
        elif i % 2:
            labels.append((i, 1, 0))
        rows.append((i, " ".join(body), "en", f"s{i % 3}", 0))
    base = words(150)
    for i in range(100, 108):  # near copies of one text
        copy = list(base)
        copy[3 * (i - 100) + 40] = f"edit{i}"
        rows.append((i, " ".join(copy), "en", "s1", 0))
    passage = words(64)
    for i in range(120, 126):  # texts of their own that share a passage
        rows.append((i, " ".join([*words(90 + i - 120), *passage, *words(80)]), "en", "s2", 0))
    rows += [(None, " ".join(words(70)), None, None, None), ((1 << 53) + 1, " ".join(words(60)), "en", "s0", 1), (200, None, "en", "s0", None), (201, "", "en", "s1", 0), rows[1]]
    return rows, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, docs, labels = _fixture(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d, at = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        d = corpus_pipeline.materialize(stage(spark, d, str(tmp_path)))
        at[name] = d.collect()
    pairs = lambda found: sorted(((r["doc_id"], r["text"]) for r in found), key=repr)

    model = toxicity.learn(docs, labels)
    kept = [(i, t) for i, t, *_ in rows if model.score(t) < toxicity.THRESHOLD]
    assert pairs(at["toxicity"]) == sorted(kept, key=repr)
    assert not {i for i, *_ in rows[:90] if i % 5 == 0} & {i for i, _ in kept} and {i for i, *_ in rows[:90] if i % 5} <= {i for i, _ in kept}

    low = lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1] or "")
    kept = sorted((min(g, key=low) for g in _brute_kept(kept)), key=low)
    assert pairs(at["simhash_dedup"]) == sorted(kept, key=repr) and [i for i, _ in kept if i in range(100, 108)] == [100]

    lists, marks = _shared([t for _, t in kept])
    want = Counter((i, " ".join(w for w, gone in zip(words, m[1]) if not gone)) for (i, _), words, m in zip(kept, lists, marks))
    cut = at["substring_dedup"]
    assert Counter((r["doc_id"], " ".join(_words(r["text"]))) for r in cut) == want and any(m[1].any() for m in marks)
    assert all(r["n_chars"] == len(r["text"]) for r in cut if r["doc_id"] in range(121, 126))

    taken = Counter()
    for r in source_mixing.mix_sources(spark.createDataFrame(cut, SCHEMA)).collect():
        taken[r["doc_id"]] += r["taken"]
    whole = {r["doc_id"]: " ".join(_words(r["text"])) for r in cut}
    mixed = Counter()
    for r in at["mix_sources"]:
        mixed[r["doc_id"]] += len(_words(r["text"]))
        assert " ".join(_words(r["text"])) in whole[r["doc_id"]]
    assert mixed == +taken

    tok = Tokenizer.from_file(bin_packing.tokenizer_path())
    pieces = Counter()
    for r in at["mix_sources"]:
        ids = np.array(tok.encode(r["text"], add_special_tokens=False).ids + [0], "<u4")
        pieces.update((r["doc_id"], k, zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in at["pack"]) == pieces
    places = Counter((r["sequence_id"], k) for r in at["pack"] for k in range(r["offset"], r["offset"] + r["length"]))
    assert max(places.values()) == 1 and max(k for _, k in places) < 2048


def _behind_lines(seed=37):
    """Bodies of six documents that share a passage, by id, the passage, and documents of smaller and larger ids with lines of it."""
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{int(x)}" for x in rng.integers(0, 1 << 40, n)]
    passage = words(70)
    lines = {at + i: [*words(50), *passage[6 * i : 6 * i + 28], *words(60)] for at in (0, 900) for i in range(8)}
    return lambda p: {100 + i: [*words(30 + i), *p(passage, i), *words(50)] for i in range(6)}, passage, lines, words


def _cut(spark, bodies):
    d = spark.createDataFrame([(i, " ".join(b)) for i, b in bodies.items()], "doc_id long, text string")
    return {r["doc_id"]: r["text"].split() for r in substring_dedup.without_repeats(d).collect()}, substring_dedup.repeated_passages(d).collect()


def test_edited_passages_behind_standing_documents(spark):
    """Each holds the passage with a word of its own, and all their signatures begin and end with documents that hold lines of it."""
    made, passage, lines, _ = _behind_lines()
    bodies = made(lambda p, i: [*p[:35], f"own{i}", *p[36:]])
    cut, got = _cut(spark, bodies | lines)
    assert {r["doc_id"] for r in got} == set(bodies) and {r["similarity"] < 1 for r in got} == {True}
    assert cut[100] == bodies[100] and all(cut[i] == b for i, b in lines.items())
    assert all(not set(cut[i]) & set(passage[:30] + passage[40:]) for i in range(101, 106))


def test_copies_of_a_passage_that_only_the_last_document_stands_for(spark):
    """The documents of smallest id hold lines of a passage, the last one all of it: of the others one keeps it."""
    made, passage, lines, words = _behind_lines(41)
    bodies = made(lambda p, i: p)
    lines = {i: b for i, b in lines.items() if i < 900}
    cut, _ = _cut(spark, bodies | lines | {999: [*words(40), *passage, *words(40)]})
    assert [i for i, w in cut.items() if set(w) & set(passage) and i not in lines] == [100]
    assert cut[100] == bodies[100] and all(cut[i] == b for i, b in lines.items())


def test_places_left_of_many_edited_copies(spark, monkeypatch):
    """Copies of a text with very many edits: what is held against what is far below all pairs of these, and an edited
    passage of two of them that no other has is found."""
    rng = np.random.default_rng(43)
    words = lambda n: [f"w{int(x)}" for x in rng.integers(0, 1 << 40, n)]
    text, n = words(150), 120
    bodies = {i: [f"own{i}x{j}" if at else w for j, (w, at) in enumerate(zip(text, rng.random(150) < 0.16))] for i in range(n)}
    for i in (70, 90):
        bodies[i][40:100] = text[40:60] + [f"own{i}"] + text[61:100]
        bodies[i][50] = "both"
    verified, held = substring_dedup._verified, []
    monkeypatch.setattr(substring_dedup, "_verified", lambda docs, todo, *how: (held.append(todo.select("doc", "ref").distinct().count()), verified(docs, todo, *how))[1])
    cut, _ = _cut(spark, bodies)
    assert not set(cut[90]) & set(bodies[90][45:95]) and "both" in cut[70]
    assert max(held[1:]) <= n * (n - 1) / 8


def test_places_left_that_share_a_line_only(spark, monkeypatch):
    """Documents with a line in common and nothing else are not held against each other; two of them with an edited passage are."""
    rng = np.random.default_rng(47)
    words = lambda n: [f"w{int(x)}" for x in rng.integers(0, 1 << 40, n)]
    line, more, n = words(36), words(30), 60
    bodies = {i: [*words(70), *line, *words(70)] for i in range(n)}
    for i in (20, 40):
        bodies[i][106:136] = [*more[:14], f"own{i}", *more[15:]]
    verified, held = substring_dedup._verified, []
    monkeypatch.setattr(substring_dedup, "_verified", lambda docs, todo, *how: (held.append((len(held) > 0, todo.select("doc", "ref").distinct().count())), verified(docs, todo, *how))[1])
    d = spark.createDataFrame([(i, " ".join(b)) for i, b in bodies.items()], "doc_id long, text string")
    cut = {r["doc_id"]: r["text"].split() for r in substring_dedup.without_repeats(d).collect()}
    assert not set(cut[40]) & set(line + more[:14] + more[15:])
    assert all(cut[i] == b for i, b in bodies.items() if i != 40)
    assert sum(k for later, k in held if later) <= n


def test_probes_of_passages():
    """Whatever a passage misses in its other text, one of its probes is held there; what no other text has is none."""
    rng = np.random.default_rng(53)
    share = 2 * 0.8 / 1.8
    for _ in range(300):
        n = int(rng.integers(46, 150))
        counts = rng.integers(1, 9, n)
        a = int(rng.integers(0, n - 45))
        m = int(rng.integers(46, n - a + 1))
        missed = a + 1 + rng.choice(m - 2, int(rng.integers(0, int(m * (1 - share)) + 1)), replace=False)
        counts[missed[rng.random(len(missed)) < 0.5]] = 0
        held = np.zeros(n, bool)
        held[a : a + m] = True
        held[missed] = False
        assert held[substring_dedup.probes(counts, 46, share)].any()
    alone = np.r_[np.zeros(30, int), np.full(36, 500), np.zeros(30, int)]
    assert not len(substring_dedup.probes(alone, 46, share))
