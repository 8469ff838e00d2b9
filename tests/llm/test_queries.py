"""Registered queries on a small table: folds, limits, hex forms and query sets against plain code; op5 and op7 against plain models."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest

from pagewatch.llm import language_id, toxicity
from pagewatch.llm.queries import QUERIES, vocabulary


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def run(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def test_op2_and_op3_digests_and_limits(spark, sf, texts):
    from tokenizers import Tokenizer
    word, byte = (Tokenizer.from_file(vocabulary(f"{n}.json")) for n in ("word_bpe_49k", "byte_bpe_50k"))
    for r in run(spark, sf, "op2_bpe_codec"):
        ids = word.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = word.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    got = run(spark, sf, "op3_token_counts")
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        n = len(byte.encode(text, add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)
    assert {r["over_limit"] for r in got} == {True, False}


def test_op5_and_op7_folds_and_thresholds(spark, sf, texts):
    langs = {r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang").distinct().collect()}
    got = run(spark, sf, "op5_language_id")
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text)) and r["lang_pred"] in langs | {"und"}
    got = run(spark, sf, "op7_toxicity")
    assert len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op6_hex_and_op10_representatives(spark, sf, texts):
    got = run(spark, sf, "op6_simhash")
    assert len(got) == len(texts) and all(len(r["fingerprint"]) == 16 and int(r["fingerprint"], 16) >= 0 for r in got)
    codes = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    comp = {r["doc_id"]: r["component_id"] for r in got}
    for a, b in itertools.combinations(codes, 2):
        assert (codes[a] ^ codes[b]).bit_count() > 2 or comp[a] == comp[b]
    assert all(c <= i and comp[c] == c for i, c in comp.items())
    got = run(spark, sf, "op10_embedding_dedup")
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and (r["n_links"] > 0 or r["kept"]) for r in got)


@pytest.mark.parametrize("name,every,k", [("op8_nearest_neighbours", 20, 20), ("op13_exact_topk", 100, 10)])
def test_searches_ask_for_the_stated_ids(spark, sf, name, every, k):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = run(spark, sf, name)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i for i in vectors if i % every == 0}
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, k + 1)) and q not in [r["vec_id"] for r in rows]
        assert rows == sorted(rows, key=lambda r: (-r["score"], r["vec_id"]))
        if every == 20:
            assert all(r["score"] == pytest.approx(vectors[q] @ vectors[r["vec_id"]], abs=1e-12) for r in rows)


def test_chosen_languages_have_the_best_penalised_likelihood():
    """Against every set of languages, with mixtures fitted by many more rounds."""
    rng = np.random.default_rng(3)
    counts = np.zeros((4, 1 << language_id.BITS))
    for k in range(4):
        counts[k, k * 150:k * 150 + 300] = rng.integers(1, 40, 300)  # neighbours share half of their trigrams
    model = language_id.Model(list("abcd"), counts)
    right = 0
    for _ in range(60):
        mix = rng.choice([[1, 0, 0, 0], [0, 0.7, 0, 0.3], [0.5, 0, 0.5, 0], [0, 0.5, 0.25, 0.25]])
        ids = rng.choice(1 << language_id.BITS, rng.integers(60, 900), p=np.array(mix) @ model.p.T)
        seen, n = np.unique(ids, return_counts=True)
        price, best = language_id.PENALTY * np.log(len(ids)), None
        for size in range(1, 5):
            for chosen in itertools.combinations(range(4), size):
                _, ll = language_id.mixture(model.p[seen][:, chosen], n.astype(float), 3000)
                best = max(best or (-np.inf,), (ll - price * (size - 1), chosen))
        got = language_id.infer(model, ids)
        right += {"abcd"[i] for i in best[1]} == set(got)
        assert sum(got.values()) == pytest.approx(1, abs=1e-6)
    assert right >= 54  # the sets tried are nested by the proportions among all languages


def test_toxicity_equals_a_plain_weighted_regression():
    """The same scaled features as a dense table, with gradients by matrix products."""
    rng = np.random.default_rng(1)
    y = (rng.random(700) < 0.3).astype(float)
    words = [rng.choice(400, 12, replace=False) + 300 * int(t) for t in y]
    features = [np.unique(np.concatenate((w, [7, 11]))).astype("<i4") for w in words]
    share = 0.1
    model = toxicity.fit(features, y, share)
    size = 800
    x = np.zeros((len(y), size))
    for i, f in enumerate(features):
        x[i, f] = 1
    df1, df0 = x[y == 1].sum(0), x[y == 0].sum(0)
    ratio = np.log((df1 + 1) / (y.sum() + 2)) - np.log((df0 + 1) / ((1 - y).sum() + 2))
    used = df1 + df0 >= toxicity.MIN_DOCS
    z = np.append(x[:, used] * ratio[used], np.ones((len(y), 1)), axis=1)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    weight /= weight.sum()
    w = np.append(np.zeros(used.sum()), np.log(share / (1 - share)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, toxicity.ROUNDS + 1):
        g = z.T @ (weight * (1 / (1 + np.exp(-z @ w)) - y)) + toxicity.L2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.02 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-6)
    assert np.allclose(model.weights[:size][used], w[:-1] * ratio[used], atol=1e-5) and not model.weights[:size][~used].any()
    assert model.intercept == pytest.approx(w[-1], abs=1e-6)
