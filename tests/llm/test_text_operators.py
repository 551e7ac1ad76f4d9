"""Operators that score documents one by one."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import importance_resampling, language_id, quality_rules, toxicity

from .conftest import odd_rows

ROWS = odd_rows()


def _brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def cover(n):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return {i + j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(n)}

    lines = Counter(x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    return (len(words), sum(map(len, words)), sum(len(x) * n for x, n in lines.items()), len(re.findall(r"[#*$%&|<>]", text)), sum(n - 1 for n in lines.values()), len(cover(3)), sum((n - 1) * len(x) for x, n in lines.items()), *(sum(len(words[i]) for i in cover(n)) for n in (5, 8, 10)))


def test_rules_against_brute_force():
    for r in ROWS:
        if r[1] is None or len(r[1]) < 20_000:
            assert quality_rules.measure(r[1]) == _brute_rules(r[1]), r[0]


def test_rules_on_odd_and_empty(odd, empty):
    got = quality_rules.repetition_rules(odd).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"] for r in got if r["base_failed"]} >= {0, 1, 2, 3, 12}
    assert quality_rules.repetition_rules(empty).count() == 0


def test_rolled_hashes_are_of_windows():
    one = quality_rules.mixed(np.arange(20) % 7)
    for n, h in quality_rules.rolled(one, (3, 5, 8, 10)).items():
        assert len(h) == 21 - n and (h[0] == h[7]) and len(set(h[:7].tolist())) == 7
    assert len(quality_rules.rolled(one[:2], (5,))[5]) == 0


def test_language_held_out(docs):
    got = language_id.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) for i in got.doc_id)


def test_language_of_odd_texts(odd, empty):
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify_language(odd).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (13, "und")} <= got
    assert language_id.identify_language(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_language(odd.withColumn("lang", odd["text"].substr(1, 0)).where("false")).collect()} == set()


def test_toxicity_finds_planted_words():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 7))) for _ in range(300)]
    text = lambda bad: " ".join("vilewretch" if bad and i % 17 == 3 else plain[rng.integers(300)] for i in range(120))
    rows = [(text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.train(rows)
    bad, good = [model.score(text(True)) for _ in range(40)], [model.score(text(False)) for _ in range(40)]
    assert min(bad) > 0.7 and max(good) < 0.5
    assert 0 <= model.score(None) == model.score("") < 0.5


def test_toxicity_on_odd_and_without_labels(odd, empty, labels):
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert {r["score"] for r in toxicity.score_toxicity(odd, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, labels).count() == 0
    model = toxicity.Model(None, None)
    assert toxicity.keep_ordinary(odd, model).columns == odd.columns


def _ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=repr)


def test_ids_stay_as_they_are(odd, labels):
    """A null id and one above 2**53 in the same batch."""
    want = sorted((r[0] for r in ROWS), key=repr)
    assert None in want and (1 << 53) + 1 in want
    assert _ids(quality_rules.repetition_rules(odd)) == want
    assert _ids(language_id.identify_language(odd)) == want
    assert _ids(importance_resampling.resample(odd, labels)) == want
    assert _ids(toxicity.score_toxicity(odd, labels)) == want
    rows = odd.collect()
    model = toxicity.learn(odd, labels)
    kept = toxicity.keep_ordinary(odd, model).collect()
    assert sorted(map(repr, kept)) == sorted(repr(r) for r in rows if model.score(r["text"]) < toxicity.THRESHOLD)


def test_language_against_the_model(docs):
    """The query against predictions made one by one, whole texts, by the formula of the model."""
    model = language_id.learn(docs)
    got = {r["doc_id"]: r for r in language_id.identify_language(docs, model=model).collect()}
    for r in docs.limit(60).collect():
        words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        ids = np.concatenate([np.empty(0, np.int64), *language_id.subwords(r["text"] or "")])
        g = got[r["doc_id"]]
        if not words:
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
            continue
        z = (model.table[ids].mean(axis=0) + model.bias) / model.heat
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert g["lang_pred"] == model.langs[int(p.argmax())] and g["score"] == pytest.approx(float(p.max())) and g["rejected"] == (g["score"] < model.least)


def test_every_language_is_learnt(spark):
    alphabet = "abcdefghijklmnopqrst"
    rows = [(i, " ".join(alphabet[i % 80 // 4 :][:3] * (2 + i % 4) for _ in range(30)), f"l{i % 80}") for i in range(1600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.learn(d).langs) == 80


def test_learning_from_rows_of_one_id(spark):
    rows = [(0, f"{'ab cd ef' if i % 2 else 'uv wx yz'} {i}", "x" if i % 2 else "y") for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (language_id.learn(x, per_lang=40) for x in (d, d.repartition(5)))
    assert one.langs == ["x", "y"] and (one.table == two.table).all()


def test_inclusion_frequencies(docs, spark, sf):
    """Over seeds, documents are kept as often as a sampler of the same weights keeps them, which a plain cut does not."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = importance_resampling.resample(docs, labels).select("doc_id", "log_weight").toPandas().sort_values("doc_id")
    w, k = got.log_weight.to_numpy(), int(0.6 * len(got))
    rng = np.random.default_rng(1)
    brute, runs = np.zeros(len(w)), 2000
    for _ in range(runs):
        brute[np.argsort(-(w + rng.gumbel(size=len(w))))[:k]] += 1
    ours, seeds = np.zeros(len(w)), 300
    keys = importance_resampling.gumbel_keys(docs.select("doc_id"), seeds).toPandas().sort_values(["seed", "doc_id"])
    for noise in keys.noise.to_numpy().reshape(seeds, -1):
        ours[np.argsort(-(w + noise))[:k]] += 1
    p, q = brute / runs, ours / seeds
    assert np.abs(p - q).max() < 0.16 and np.abs(p - q).mean() < 0.03
    assert ((p > 0.05) & (p < 0.95)).sum() > 20  # the noise decides about these
    assert (q[np.argsort(-w)[:k]] < 1).sum() > 5


def test_resampling(docs, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = importance_resampling.resample(docs, labels).toPandas()
    learnt = labels.toPandas().loc[lambda x: [zlib.crc32(str(i).encode()) % 3 != 1 for i in x.doc_id]]
    assert got.kept.sum() == int((learnt.quality == 1).mean() * len(got))
    assert set(importance_resampling.resample(docs, labels, fraction=0.0).toPandas().kept) == {False}
    assert got[got.kept].key.min() >= got[~got.kept].key.max()
    x = got.merge(labels.toPandas(), on="doc_id")
    assert x[x.quality == 1].log_weight.median() > x[x.quality == 0].log_weight.median()


def test_resampling_on_odd_and_empty(odd, empty, labels):
    got = importance_resampling.resample(odd, labels).toPandas()
    assert len(got) == len(ROWS) and (got[got.n_features == 0].log_weight == 0).all()
    assert importance_resampling.resample(empty, labels).count() == 0


@pytest.mark.parametrize("k", [1, 5, 500, 1000, 2000])
def test_kth_largest(spark, k):
    d = spark.range(1000).selectExpr("cast(id % 300 as double) / 7 as x")
    want = sorted((i % 300 / 7 for i in range(1000)), reverse=True)[min(k, 1000) - 1]
    assert importance_resampling.kth_largest(d, "x", k, bins=8, few=4) == want
