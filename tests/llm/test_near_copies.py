"""Near copies of the pipeline's stage, against brute force."""

import numpy as np

import corpus_pipeline
from tidewater.llm import simhash_dedup
from tidewater.llm.quality_rules import mixed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rng = np.random.default_rng(3)
    rows = []
    for g in range(25):
        base = [f"w{int(x)}" for x in rng.integers(0, 4000, 120)]
        rows.append((100 * g + 9, " ".join(base)))
        for i in range(6):
            words = list(base)
            for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
                words[at] = f"e{g}_{i}_{at}"
            rows.append((100 * g + 10 + i, " ".join(words)))
    return rows


def _brute_kept(rows, similarity=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= similarity * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    return groups.values()


def _kept(spark, rows):
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA), "")
    return [(None if i is None else int(i), t) for i, t in ((r["doc_id"], r["text"]) for r in out.collect())]


def test_edited_copies_go(spark):
    rows = _rows()
    want = sorted(min(g) for g in _brute_kept(rows))
    assert 25 < len(want) < len(rows)
    assert sorted(_kept(spark, rows)) == want


def test_fingerprints_are_near_at_the_threshold():
    rng = np.random.default_rng(5)
    for n in (9, 18, 90, 900):
        for _ in range(100):
            x = rng.integers(0, 1 << 32, n // 9 * 10, np.uint64).astype(np.uint32)
            y = rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
            a, b, c = simhash_dedup.wide_fingerprints([np.sort(x[:n]), np.sort(x[n // 9 :]), np.sort(y)])  # Jaccard 0.8, and unrelated
            assert np.bitwise_count(a ^ b).sum() <= simhash_dedup.NEAR_RADIUS < np.bitwise_count(a ^ c).sum()
            assert np.bitwise_count(a[0] ^ b[0]) <= simhash_dedup.FIRST_RADIUS


def test_wide_fingerprints():
    sets = simhash_dedup.shingle_sets(["a b c d e f g h i", None, "one two", " ".join(f"w{i % 70}" for i in range(900))])
    got = simhash_dedup.wide_fingerprints(sets)
    for s, row in zip(sets, got):
        for w in range(simhash_dedup.NEAR_WORDS):
            h = mixed(mixed(s.astype(np.uint64) + np.uint64((w + 1) << 32)))
            want = sum(1 << bit for bit in range(64) if 2 * sum(int(x) >> bit & 1 for x in h) > len(s))
            assert int(row[w]) == want


def test_blocks_find_what_nearest_links_leave_apart(spark):
    """Two groups whose nearest candidates lie inside each group, linked by one pair; parts and blocks of a few texts."""
    rng = np.random.default_rng(21)
    base = rng.integers(0, 1 << 32, 400, np.uint64).astype(np.uint32)

    def changed(x, n):
        return np.unique(np.concatenate([x[n:], rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)]))

    far = changed(base, 41)
    sets = [changed(base, 3) for _ in range(12)] + [changed(far, 3) for _ in range(12)] + [changed(rng.integers(0, 1 << 32, 400, np.uint64).astype(np.uint32), 1) for _ in range(6)]
    fp = simhash_dedup.wide_fingerprints(sets).view(np.int64)
    classes = spark.createDataFrame([(i, len(s), *map(int, f)) for i, (s, f) in enumerate(zip(sets, fp))], "cls long, n long, f0 long, f1 long, f2 long, f3 long")
    texts = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "cls long, s binary")
    for part, block in ((16384, (256, 1024)), (5, (3, 4))):
        links = simhash_dedup.near_links(classes, lambda some: some.join(texts, "cls"), 0.8, part, block).collect()
        root = list(range(len(sets)))
        for r in links:
            assert simhash_dedup._jaccard(sets[r.a], sets[r.b]) >= 0.8
        want = [(i, j) for i in range(len(sets)) for j in range(i) if simhash_dedup._jaccard(sets[i], sets[j]) >= 0.8]
        assert _components(root, [(r.a, r.b) for r in links]) == _components(root, want)


def _components(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_rows_decide_and_not_ids(spark):
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{int(x)}" for x in rng.integers(0, 4000, 80))
    one, two, three, four, five = (text() for _ in range(5))
    rows = [(3, one), (3, two), (None, three), (None, four), (1, one), (7, two), (None, five), (None, five), (3, two)]
    assert sorted(_kept(spark, rows), key=str) == sorted([(1, one), (3, two), (None, three), (None, four), (None, five)], key=str)


def test_passages_of_rows_without_an_id_of_their_own(spark):
    from tidewater.llm import substring_dedup

    rng = np.random.default_rng(12)
    words = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 4000, n))
    passage, clean = words(60), words(150)
    rows = [(3, clean), (3, f"{words(40)} {passage} {words(30)}"), (None, f"{words(20)} {passage} {words(9)}"), (1, f"{passage} {words(50)}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.ref_doc_id) for r in substring_dedup.repeated_passages(d).collect()} >= {(3, 1), (None, 1)}
    cut = {(r.doc_id, r.text) for r in substring_dedup.without_repeats(d).collect()}
    assert rows[3] in cut and rows[0] in cut and len(cut) == 4
    assert sum(passage in t for _, t in cut) == 1
