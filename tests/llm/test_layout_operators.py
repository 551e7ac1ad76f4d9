"""Sharding, packing and mixing."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewater.llm import bin_packing, kdtree_sharding, source_mixing
from tidewater.llm.common import positions

from .conftest import odd_rows

ROWS = odd_rows()


def test_positions_tile_each_key(spark):
    from pyspark.sql import functions as F

    d = spark.range(5000).selectExpr("id % 3 as k", "id as i", "id % 5 as w")
    got = positions(d, ["k"], ["i"], F.col("w"), buckets=7).toPandas()
    for _, g in got.groupby("k"):
        g = g[g.w > 0].sort_values("pos")
        assert (g.pos.to_numpy() == np.concatenate([[0], g.w.cumsum().to_numpy()[:-1]])).all()


def test_shards(docs):
    got = kdtree_sharding.kdtree_shards(docs).toPandas()
    text = docs.select("doc_id", "text").toPandas().set_index("doc_id").text
    assert len(got) == len(text) and set(got.shard) <= set(range(40)) and got.grown_shard.isna().all() and set(got.law) == {"bytes"}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got.itertuples(index=False))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= 2 * got["size"].max()


def test_shards_with_ties_and_nothing(spark, odd, empty):
    got = kdtree_sharding.kdtree_shards(odd).toPandas()
    assert len(got) == len(ROWS)
    same = spark.range(1000).selectExpr("id as doc_id", "'same text' as text", "'x' as lang")
    load = kdtree_sharding.kdtree_shards(same).groupBy("shard").count().toPandas()["count"]
    assert len(load) == 40 and load.max() - load.min() <= 4
    assert kdtree_sharding.kdtree_shards(empty).count() == 0


def test_equal_texts_stay_together(spark):
    d = spark.range(4000).selectExpr("id as doc_id", "repeat(concat('t', cast(id % 500 as string)), 30) as text", "'x' as lang")
    got = kdtree_sharding.kdtree_shards(d).groupBy("text_crc32").agg({"shard": "approx_count_distinct"}).toPandas()
    assert (got.iloc[:, 1] > 1).sum() <= 39


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(0.01, 3000), 512)
    h = {int(k): int(v) for k, v in Counter(lengths.tolist()).items()}
    rows = bin_packing.plan(h, 512)
    fill = Counter()
    for n, first, times, seq, offset in rows.tolist():
        later = [r for r in rows.tolist() if r[0] == n and r[1] > first]
        count = (min(r[1] for r in later) if later else h[n]) - first
        for k in range(count):
            fill[seq + k % times] += n
    assert sum(fill.values()) == lengths.sum() and max(fill.values()) <= 512
    assert len(fill) <= int(np.ceil(lengths.sum() / 512)) + 1


def test_fullest_is_optimal():
    from itertools import product

    counts = {11: 1, 7: 2, 5: 3, 3: 1}
    best = max(sum(n * k for n, k in zip(counts, ks)) for ks in product(*(range(v + 1) for v in counts.values())) if ks[0] >= 1 and sum(n * k for n, k in zip(counts, ks)) <= 27)
    assert sum(n * k for n, k in bin_packing.fullest(counts, 27)) == best


def test_token_ids_are_the_tokenizers():
    path = bin_packing.tokenizer_path()
    texts = [r[1] for r in ROWS] + ["a.b,c", "a._b", "x.. y, ..z", "3.14,5", "ſtraße ß", "don't 'tis it's", "hello\x85world", "\x1cab", "ª. º, c"]
    tok = Tokenizer.from_file(path)  # as the file has it
    assert tok.encode("<|endoftext|> hi", add_special_tokens=False).ids == next(bin_packing.token_ids(["<|endoftext|> hi"], path)).tolist()
    texts += ["<|ENDOFTEXT|>", "x<|endoftext|>y", "plain <|startoftext|> words", "a <|endoftext|>  b"]
    for t, ids in zip(texts, bin_packing.token_ids(texts, path)):
        assert ids.tolist() == (tok.encode(t, add_special_tokens=False).ids if t else [])


def test_packed_pieces_against_brute_force(odd):
    tok = Tokenizer.from_file(bin_packing.tokenizer_path())
    want = Counter()
    for doc, text, *_ in ROWS:
        ids = np.array((tok.encode(text, add_special_tokens=False).ids if text else []) + [0], "<u4")
        want.update((doc, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048)))
    got = bin_packing.pack_documents(odd).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = Counter((r["sequence_id"], at) for r in got for at in range(r["offset"], r["offset"] + r["length"]))
    assert max(places.values()) == 1 and max(at for _, at in places) < 2048
    fill = Counter(s for s, _ in places)
    assert all((s, at) in places for s, n in fill.items() for at in range(n))
    assert len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_packing(odd, empty):
    got = bin_packing.pack_documents(odd, with_ids=True)
    p = got.toPandas()
    assert p.groupby(["sequence_id"]).length.sum().max() <= 2048
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum().to_numpy()[:-1]])).all()
    assert all(zlib.crc32(np.asarray(i, "<u4").tobytes()) == c for i, c in zip(p.ids, p.ids_crc32))
    assert p[p.doc_id == 0].length.tolist() == [1]
    seqs = bin_packing.sequences(got).toPandas()
    assert sum(map(len, seqs.ids)) == p.length.sum()
    assert bin_packing.pack_documents(empty).count() == 0


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000, 1025):
        p = source_mixing.Permutation(n, 5, 6)
        x = p(np.arange(n))
        assert sorted(x.tolist()) == list(range(n)) and (p(x, back=True) == np.arange(n)).all()


def test_targets():
    got = source_mixing.targets([("b", 100), ("a", 1000), (None, 10), ("c", 0)])
    assert sum(got.values()) == pytest.approx(1110) and got["c"] == 0 and got[None] == 30
    assert got["b"] == 300 and got["a"] == pytest.approx(780)


def test_mixing(docs):
    got = source_mixing.mix_sources(docs).toPandas()
    again = source_mixing.mix_sources(docs.repartition(3)).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    x = got.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source").agg(t=("target", "first"), n=("taken", "sum"), s=("size", "sum"), ss=("source_size", "first"))
    assert ((x.t - x.n).abs() <= 0.5).all() and (x.s == x.ss).all() and (got.taken <= 3 * got["size"]).all()


def test_mixed_documents(odd, empty):
    sizes = source_mixing.mix_sources(odd).toPandas()
    assert len(sizes) == len(ROWS) and sizes[sizes["size"] == 0].taken.sum() == 0
    out = source_mixing.mixed_documents(odd).toPandas()
    assert list(out.columns) == odd.columns
    mixed = source_mixing.mixed_documents(odd).collect()
    got, want = Counter(), Counter()
    for r in mixed:
        got[r["doc_id"]] += len(source_mixing._WORD.findall(r["text"]))
    for r in source_mixing.mix_sources(odd).collect():
        want[r["doc_id"]] += r["taken"]
    assert got == want
    rows = {(r["doc_id"], r["text"]) for r in mixed}
    texts = {(r[0], r[1]) for r in ROWS}
    assert rows & texts and all(any(i == d and t in (s or "") for d, s in texts) for i, t in rows) and any(i == (1 << 53) + 1 for i, _ in rows)
    assert source_mixing.mix_sources(empty).count() == 0 and source_mixing.mixed_documents(empty).count() == 0


def test_stretches():
    t = "  a b\tc d  "
    assert list(source_mixing.stretches(t, [(0, 0, 2), (0, 2, 2), (1, 1, 1), (1, 3, 1)])) == [t, "b", "d"]


def test_mix_replayed(spark):
    """Every word of a source is taken as often as the whole uses of its source, or once more, and together they make the target."""
    rows = [(i if i % 9 else None, " ".join(f"w{i}_{k}" for k in range(i * 7 % 90)), f"s{i % 5}" if i % 5 else None) for i in range(300)]
    d = spark.createDataFrame([*rows, rows[4], rows[4]], "doc_id long, text string, source string")
    placed, mix = source_mixing.mix_blocks(d, block=16, slots=8)
    facts = {(r["src"], r["pos"]): r for r in placed.where("size > 0").collect()}
    assert len(facts) == sum(bool(r[1]) for r in [*rows, rows[4], rows[4]])
    taken = {r["src"]: np.zeros(r["source_size"], int) for r in facts.values()}
    slots = {}
    for r in mix.collect():
        n = taken[r["src"]]
        n[r["pos"] + r["at"] : r["pos"] + r["at"] + r["length"]] += 1
        slots.setdefault((r["src"], r["slot"]), []).append(r["length"])
    for src, n in taken.items():
        target = round(next(f["target"] for f in facts.values() if f["src"] == src))
        assert n.sum() == target and set(n) <= {target // len(n), target // len(n) + 1}
    assert max(map(sum, slots.values())) <= 16
    by_document = {}
    for r in source_mixing.mix_sources(d, block=16, slots=8).collect():
        by_document.setdefault((r["doc_id"], r["size"]), []).append(r["taken"])
    for r in facts.values():
        own = int(taken[r["src"]][r["pos"] : r["pos"] + r["size"]].sum())
        assert own in by_document[r["doc_id"], r["size"]] and own <= 3 * r["size"]


def _with_strange_columns(odd):
    """Columns with a dot in the name, maps (one of them of maps), and structures that hold maps."""
    from pyspark.sql import functions as F

    m = F.create_map(F.lit("k"), F.coalesce("source", F.lit("none")), F.lit("a"), F.col("lang"))
    return odd.withColumns({"a.b": F.lit(1), "m": m, "mm": F.create_map(F.lit("x"), m), "s": F.struct(m.alias("m"))})


def test_maps_and_dotted_names(spark, odd):
    from tidewater.llm import simhash_dedup, source_mixing, substring_dedup, toxicity

    d = _with_strange_columns(odd)
    plain = sorted((str(r["doc_id"]), r["size"], r["source_size"]) for r in source_mixing.mix_sources(odd).collect())
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"]) for r in source_mixing.mix_sources(d).collect()) == plain
    mixed = source_mixing.mixed_documents(d)
    assert mixed.columns == d.columns and mixed.count() > 0
    for stage in (substring_dedup.without_repeats, lambda x: toxicity.keep_ordinary(x, toxicity.Model(None, None))):
        out = stage(d)
        assert out.columns == d.columns and out.count() == d.count()
    kept, want = simhash_dedup.without_near_copies(d), simhash_dedup.without_near_copies(odd)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(str(r["doc_id"]) for r in want.select("doc_id").collect())
