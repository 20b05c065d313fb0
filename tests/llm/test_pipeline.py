"""The pipeline's stages and their order, against brute force."""

import zlib

import numpy as np

import corpus_pipeline as P
from tessera.llm import common, packing, registry
from tessera.llm.chunks import load

from .test_dedup import brute_removal
from .test_quality_secrets import measures, spans

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "secret_scans", "best_fit_packing"]
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))


def test_stages_are_brute_force(spark):
    docs = common.documents(spark, SF)
    before = {r.doc_id: r for r in docs.collect()}
    quality, near, suffix, secret, pack = (f for _, f in P.STAGES)

    out = common.materialised(quality(spark, docs, SF), "t")
    assert out.columns == docs.columns
    kept = {r.doc_id: r for r in out.collect()}
    for i, r in before.items():
        n, chars, symbols, lines, dup, repeat = measures(r.text)
        bad = n < 10 or 100 * repeat > 20 * n or 10 * symbols > n or chars < 2 * n or chars > 12 * n or (dup >= 3 and 10 * dup > 6 * lines)
        assert (i in kept) != bad and (bad or kept[i] == r)

    out = common.materialised(near(spark, out, SF), "t")
    assert out.columns == docs.columns
    left = {r.doc_id: r for r in out.collect()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, r in kept.items() for w in [r.text.lower().split()]}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    for i, r in kept.items():
        if i in left:  # nothing that stays has a copy before it that stays
            assert left[i] == r and all(alike(i, j) < 0.8 for j in left if j < i)
        else:  # nothing goes without a like document
            assert max(alike(i, j) for j in kept if j != i) >= 0.8

    found = common.materialised(suffix(spark, out, SF), "t")
    assert found.columns == docs.columns
    order = sorted(left)
    texts = {}
    for i, (b, m) in zip(order, brute_removal([left[i].text for i in order])):
        texts[i] = bytes(x for x, y in zip(b, m) if not y).decode("utf-8", "ignore")
    rows = {r.doc_id: r for r in found.collect()}
    assert {i: r.text for i, r in rows.items()} == texts and all(r.n_chars == len(r.text) for r in rows.values())

    out = common.materialised(secret(spark, found, SF), "t")
    assert out.columns == docs.columns
    masked = {r.doc_id: r.text for r in out.collect()}
    assert set(masked) == set(texts)
    for i, t in texts.items():
        assert (masked[i] == t) == (not spans(t)[1])
        assert not [x for x in spans(masked[i])[0] if x not in spans(t)[0]] or "[SECRET]" in masked[i]

    got = pack(spark, out, SF).collect()
    t = load(common.tokenizer_path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in masked.items()}
    want = sorted((i, k, s, n, zlib.crc32(np.array(x[s : s + n], "<u4").tobytes())) for i, x in ids.items() for k, (s, n) in enumerate(packing.cut(len(x), 2048)))
    assert sorted(tuple(r)[:5] for r in got) == want
    assert sorted(tuple(r)[:5] for r in P.run(spark, SF).collect()) == want


def test_stages_take_empty_tables_and_nulls(spark):
    schema = common.documents(spark, SF).schema
    empty = common.materialised(spark.createDataFrame([], schema), "t")
    nulls = common.materialised(spark.createDataFrame([(None,) * 5, (1, None, None, None, None), (2, "", "en", "s", 0)], schema), "t")
    for name, f in P.STAGES:
        assert f(spark, empty, SF).count() == 0, name
        assert f(spark, nulls, SF).count() == {"quality_rules": 0, "simhash_near_dedup": 2}.get(name, 3), name
