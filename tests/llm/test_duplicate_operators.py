"""Near-duplicate operators and the pipeline."""

import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from tidewater.llm import embedding_dedup, simhash_dedup, substring_dedup
from tidewater.llm.common import connected_components, local_components
from tidewater.llm.quality_rules import mixed

from .conftest import odd_rows

ROWS = odd_rows()


def _roots(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed, local_links", [(0, 0), (1, 0), (2, 0), (0, 40), (1, 10**6)])
def test_components(spark, seed, local_links):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(200, 201 + i) for i in range(50)]
    nodes = {x for p in pairs for x in p}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), local_links=local_links).collect()}
    want = _roots(pairs, nodes)
    assert got == {n: c for n, c in want.items() if any(n in p for p in pairs if p[0] != p[1])}
    a, b = np.array(pairs).T
    local = local_components(300, a, b)
    assert all(local[n] == want[n] for n in nodes)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints():
    for r in ROWS:
        if r[1] is None or len(r[1]) < 20_000:
            assert simhash_dedup.fingerprint(r[1]) == _brute_fingerprint(r[1]), r[0]


@pytest.mark.parametrize("part", [4, 8192])
def test_tiled_links_lose_none(spark, part):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, np.uint64) * np.uint64(2)
    flips = [b ^ np.uint64(1 << int(i) | 1 << int(j)) for b in base for i, j in rng.integers(0, 63, (3, 2))]
    fp = np.unique(np.concatenate([base, np.array(flips, np.uint64), np.array([0, 3, (1 << 64) - 1], np.uint64)]))
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2)
    want = local_components(len(fp), near[:, 0], near[:, 1])
    links = simhash_dedup.tiled_links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), part=part).collect()
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    got = local_components(len(fp), np.array([at[r["a"]] for r in links]), np.array([at[r["b"]] for r in links]))
    assert (got == want).all()


def test_simhash_groups(odd, empty):
    got = simhash_dedup.simhash_groups(odd).toPandas()
    assert len(got) == len(ROWS)
    by = dict(zip(got.doc_id, got.component_id))
    assert by[0] == by[1] == by[2] == 0 and by[6] == by[7] == by[8] == 6
    assert set(got[got.doc_id == 0].fingerprint) == {"0" * 16}
    assert simhash_dedup.simhash_groups(empty).count() == 0


def _vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    rows = [(i, base[i].tolist(), i % 3) for i in range(60)]
    rows += [(100 + i, (base[i % 10] + rng.normal(scale=0.05, size=8)).tolist(), i % 10 % 3) for i in range(40)]
    rows += [(200, base[0].tolist(), 0), (201, base[0].tolist(), 0), (202, (3 * base[0]).tolist(), 0), (203, base[0].tolist(), None), (204, None, 0), (205, [0.0] * 8, 0), (206, [float("nan")] + [1.0] * 7, 0), (207, [None] + [1.0] * 7, 0), (208, [], 0), (209, base[0].tolist()[:4], 0), (200, base[0].tolist(), 0)]
    return rows


@pytest.mark.parametrize("block", [8, 1024])
def test_embedding_groups(spark, block):
    rows = _vectors()
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as n", "'x' as class", "2 as at", "3 as x")
    got = embedding_dedup.embedding_groups(d, block=block).toPandas()
    ok = [(i, v, lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, count = [], {}
    for n, (i, v, a) in enumerate(ok):
        for m, (j, w, b) in enumerate(ok):
            if n != m and a == b and len(v) == len(w) and np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w)) >= 0.98:
                links.append((i, j))
                count[n] = count.get(n, 0) + 1
    root = _roots(links, {r[0] for r in rows})
    assert len(got) == len(rows) and all(root[i] == c and k == (i == c) for i, c, k in zip(got.vec_id, got.component_id, got.kept))
    want = sorted([(r[0], count.get(n, 0)) for n, r in enumerate(ok)] + [(r[0], 0) for r in rows if r not in ok and r[0] != 206] + [(206, 0)])
    assert sorted(zip(got.vec_id, got.n_links)) == want


def test_no_embeddings(spark):
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def _brute_windows(h, least):
    key = [(int(x) >> 24, i) for i, x in enumerate(h)]
    out = []
    for c in range(len(h)):
        lo = hi = c
        while lo > 0 and key[lo - 1] > key[c]:
            lo -= 1
        while hi < len(h) - 1 and key[hi + 1] > key[c]:
            hi += 1
        if hi - lo + 1 >= least:
            out.append((lo, c, hi))
    return out


@pytest.mark.parametrize("least", [1, 3, 8, 40])
def test_compact_windows(least):
    rng = np.random.default_rng(least)
    parts = [mixed(rng.integers(0, 1 << 40, n)) for n in (0, 5, 1, 60, 200, 8, 0)]
    parts[3][10:30] = parts[3][10]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    got = sorted(zip(*(x.tolist() for x in substring_dedup.compact_windows(np.concatenate(parts), least, starts))))
    want = sorted((a + s, c + s, z + s) for p, s in zip(parts, starts.tolist()) for a, c, z in _brute_windows(p, least))
    assert got == want


def test_word_hashes(monkeypatch):
    texts = [r[1] for r in ROWS] + ["a", " lead", "trail "]
    hashes, counts = substring_dedup.word_hashes(texts)
    lists = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower() if (t or "").isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for t in texts]
    assert counts.tolist() == [len(x) for x in lists]
    seen = {}
    for w, h in zip([w for x in lists for w in x], hashes.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    monkeypatch.setattr(substring_dedup, "_BUFFER", 100)
    assert (substring_dedup.word_hashes(texts)[0] == hashes).all()


def _planted(spark, copies=30):
    rng = np.random.default_rng(9)
    words = lambda n: [f"w{int(x)}" for x in rng.integers(0, 5000, n)]
    passage, other = words(60), words(52)
    near = [*passage[:30], "edited", *passage[31:]]
    rows = []
    for i in range(copies):
        body = [*words(40), *passage, *words(40)]
        if i % 10 == 3:
            body = [*words(20), *near, *words(30)]
        if i % 5 == 1:
            body += other
        rows.append((i, " ".join(body)))
    rows += [(1000 + i, " ".join(words(150))) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string"), passage, other


def test_passages_are_found_and_clean_texts_left(spark):
    d, passage, other = _planted(spark)
    got = substring_dedup.repeated_passages(d).toPandas()
    assert set(got.doc_id) == set(range(30)) and set(got.ref_doc_id) <= set(range(30))
    cut = substring_dedup.without_repeats(d).toPandas().set_index("doc_id").text
    assert [i for i, t in cut.items() if " ".join(passage) in t] == [0]
    assert [i for i, t in cut.items() if " ".join(other) in t] == [1]
    before = d.toPandas().set_index("doc_id").text
    assert all(cut[i] == before[i] for i in range(1000, 1020))


def test_near_passage_beside_a_frequent_line():
    rng = np.random.default_rng(11)
    x = rng.integers(0, 1 << 62, 130)
    y = rng.integers(0, 1 << 62, 200)
    y[20:76] = x[10:66]
    y[46:51] += 1  # an edited word
    for gap in (1, 5, 8, 12):
        # A line that the other text holds elsewhere, and another loosely similar stretch.
        z = y.copy()
        z[120:126] = x[66 + gap : 72 + gap]
        z[140:150] = x[82:92]
        got = substring_dedup.passages(x, z, 10, 46, 0.8)
        assert [(a, b, c, d) for a, b, c, d, _ in got] == [(10, 66, 20, 76)], gap
        assert got[0][4] == pytest.approx(51 / 61)


def test_passages_on_odd_and_empty(odd, empty):
    got = substring_dedup.repeated_passages(odd).toPandas()
    assert {(7, 6), (8, 6), (11, 10)} <= set(zip(got.doc_id, got.ref_doc_id))
    out = substring_dedup.without_repeats(odd).toPandas()
    assert len(out) == len(ROWS) and list(out.columns) == odd.columns
    assert substring_dedup.repeated_passages(empty).count() == 0 and substring_dedup.without_repeats(empty).count() == 0


def test_trimmed():
    assert substring_dedup.trimmed(" a b\tc d ", [(1, 2)]) == " a d "
    assert substring_dedup.trimmed("a b", [(0, 2)]) == ""


def test_pipeline(spark, sf, odd, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "pack":
            assert out.columns == docs.columns
        docs = corpus_pipeline.materialize(out)
        counts.append(docs.count())
    assert counts[0] >= counts[1] == counts[2] > 0 and counts[-1] > 0
    for some in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, some, sf).count()


def test_pipeline_keeps_one_of_each_group(spark):
    import corpus_pipeline

    rows = [(i, "one two three four five " * 20 if i < 5 else f"text {i} " * 30, "en", "s", 1) for i in range(8)] + [(0, "one two three four five " * 20, "en", "s", 1)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").toPandas()
    assert sorted(kept.doc_id) == [0, 5, 6, 7] and isinstance(kept, pd.DataFrame)
