"""BPE codec, token counts, LM scoring, language ID and toxicity on odd tables and against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewatch.llm import bpe_codec, chargrams, language_id, lm_scoring, token_counts, toxicity
from pagewatch.llm.queries import vocabulary

TRICKY = [
    None, "", " ", "\n\t ", "Hello World's  12 o'clock", "ΑΣ ὈΔΥΣΣΕΎΣ Straße İstanbul", "café à́b ́x",
    "a <|endoftext|>b<|startoftext|><|endoftext|> c<|endoftex", "x y z\x1cq\x0bw\x85e​f﻿g　h",
    "a\n\n  b \n c\t\td  ", "日本語のテキスト、空白なし。" * 30, "🙂🙂 zwj 👩‍👩‍👧 end", "'S 'Ve don't I'LL ''s", "٣٤٥ ½ ² x²y _under_score__",
    "ﬁ ﬀ Å Å", "a" * 5000, "ab1$" * 900, " " * 3000 + "x" + " " * 3000, "word " * 4000, "Ünï cödé\r\nnew line\r", "a  b   c    d", "\x00\x01 ctrl \x7f",
]
SCHEMA = "doc_id long, text string, row string, size int, bpe string, tokens int"


def table(spark, texts):
    rows = [(None if i == 3 else i, t, "clash", 1, "x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[4:6], SCHEMA), [r[1] for r in rows + rows[4:6]]


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def test_bpe_equals_the_library(spark, word_tokenizer):
    docs, texts = table(spark, TRICKY)
    got = Counter((r["text"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in
                  bpe_codec.encode_decode(docs.drop("bpe"), vocabulary("word_bpe_49k.json")).select("text", "bpe.*").collect())
    want = Counter()
    for t in texts:
        ids = word_tokenizer.encode(t or "", add_special_tokens=False).ids
        want[t, len(ids), tuple(ids), word_tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert got == want


def test_bpe_digests_and_empty_table(spark, word_tokenizer):
    docs, _ = table(spark, TRICKY[4:7])
    for r in bpe_codec.encode_decode_digests(docs, vocabulary("word_bpe_49k.json")).select("text", "bpe.*").collect():
        e = word_tokenizer.encode(r["text"], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(word_tokenizer.decode(e, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_codec.encode_decode_digests(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_forced_cuts_stand_inside_no_token():
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        codec = bpe_codec.Codec(f.read())
    parts = codec.fragments("qzxjvkqqab")
    assert "".join(parts) == "qzxjvkqqab" and len(parts) > 1
    for a, b in zip(parts, parts[1:], strict=False):
        assert not any(a[-1] + b[0] in t for t in codec.names.values())


@pytest.mark.parametrize("chunk,overlap", [(32_768, 256), (64, 8), (7, 1)])
def test_token_counts_equal_the_library(spark, byte_tokenizer, chunk, overlap):
    docs, texts = table(spark, TRICKY)
    got = token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json"), chunk=chunk, overlap=overlap).select("row.text", "n_bytes", "n_tokens").collect()
    want = Counter((t, len((t or "").encode()), len(byte_tokenizer.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    assert Counter(map(tuple, got)) == want


def test_long_runs_are_counted_by_many_chunks(spark, byte_tokenizer, monkeypatch):
    """Texts without a blank: work stays in proportion to the text where tokens fall into step, and counts are right where they never do."""
    rng = np.random.default_rng(5)
    cjk = "".join(rng.choice(list("日本語中文字的一是不了人我在有他这为之大来以个"), 120_000))
    base64 = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 120_000))
    words = "".join(rng.choice(["token", "isation", "over", "lap", "stream", "ing", "un", "do"], 30_000))
    odd = ["!'sad" * 9000, "<|endoftext|>" * 4000, "ab<|endoftext|>" * 3000, " " * 40_000, "a  b   c    d\n" * 4000, "don't'll've" * 4000, "\u0301é🙂" * 9000, "x" * 30_000]
    encoded = []
    real = token_counts._pieces

    def pieces(texts, spans):
        out = real(texts, spans)
        encoded.append(out.groupBy("digest").agg(F.sum(F.length("piece")).alias("n")).toPandas().set_index("digest")["n"])
        return out

    monkeypatch.setattr(token_counts, "_pieces", pieces)
    texts = [cjk, base64, words, *odd]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: r[1] for r in token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json"), chunk=4096, overlap=64).select("row.doc_id", "n_tokens").collect()}
    assert got == {i: len(byte_tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    work = sum(e.reindex([hashlib.sha256(t.encode()).hexdigest() for t in texts[:3]]).fillna(0).to_numpy() for e in encoded)
    assert (work < 1.3 * np.array([len(t) for t in texts[:3]])).all(), work


def test_spliced_counts_equal_the_library_at_every_cut(byte_tokenizer):
    """The two proofs, straight on the library's encodings: any pair of overlapping pieces, any place named by both."""
    rng = np.random.default_rng(9)
    parts = ["the ", "of", "'s", "'ll", " ", "  ", "\n", "日本", "語", "!!", "!'", "12", "3", "é", "🙂", "<|endoftext|>", "aaaa", "ing", "\t", "token"]
    for _ in range(400):
        text = "".join(rng.choice(parts, 60))
        a, b = sorted(rng.integers(1, len(text), 2))
        lo, hi = int(a), int(min(b + 30, len(text)))
        left, right = (byte_tokenizer.encode(t, add_special_tokens=False) for t in (text[:hi], text[lo:]))
        tail = token_counts.Layout(left, 0).common_places(lo, hi, 13, False)
        head = token_counts.Layout(right, lo).common_places(lo, hi, 13, True)
        n = len(byte_tokenizer.encode(text, add_special_tokens=False))
        if hi - lo < 28:
            continue  # an overlap is twice the longest special string at least
        for place in set(tail) & set(head):
            assert tail[place] + len(right) - head[place] == n, (text, lo, hi, place)


@pytest.mark.parametrize("right", [256, 100, 40])
def test_a_short_last_chunk_without_a_common_boundary_is_joined(right):
    """Its overlap ends with the text and cannot be widened: the rounds would never end."""
    none = {"head": {}, "tail": {}, "total": 9, "digest": "d"}
    rows = [{"start": 0, "stop": 4096, "left": 0, "right": right} | none, {"start": 4096, "stop": 4136, "left": right, "right": 0} | none]
    got = token_counts._splicer(4096)(pd.DataFrame(rows))["spans"][0]
    assert got == [{"start": 0, "stop": 4136, "left": 0, "right": 0, "again": True}]


def test_token_counts_of_a_run_with_a_short_last_chunk(spark, byte_tokenizer, monkeypatch):
    rounds, real = [], token_counts._pieces

    def pieces(*a):
        rounds.append(1)
        assert len(rounds) < 12
        return real(*a)

    monkeypatch.setattr(token_counts, "_pieces", pieces)
    texts = ["ab" + "a" * (2 * 4096 + n) for n in (5, 40, 100, 300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: r[1] for r in token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json"), chunk=4096, overlap=64).select("row.doc_id", "n_tokens").collect()}
    assert got == {i: len(byte_tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_token_counts_of_an_empty_table_and_kept_columns(spark):
    docs, _ = table(spark, TRICKY[:5])
    got = token_counts.count_tokens(docs.limit(0), vocabulary("byte_bpe_50k.json"), keep=["doc_id"])
    assert got.count() == 0 and got.select("row.*").columns == ["doc_id"]


def plain_scores(background, target, texts):
    """Both bigram models as plain dictionaries."""
    def words(t):
        return (t or "").lower().split()
    counts = {}
    for k, corpus in (("n", background), ("t", target)):
        counts[k] = Counter(w for t in corpus for w in words(t)), Counter(p for t in corpus for p in zip([None, *words(t)], words(t), strict=False))
    vocab = set(counts["n"][0]) | set(counts["t"][0])
    total = {k: sum(counts[k][0].values()) for k in "nt"}
    scale = {"n": total["t"] / total["n"], "t": 1.0}
    out = []
    for t in texts:
        loss = {"n": 0.0, "t": 0.0}
        ws = words(t)
        for k in "nt":
            uni, bi = counts[k]
            mass = total[k] * scale[k] + lm_scoring.ADD * (len(vocab) + 1)
            after = Counter()
            for (v, _), c in bi.items():
                after[v] += c * scale[k]
            for v, w in zip([None, *ws], ws, strict=False):
                first = lm_scoring.PRIOR * (uni[w] * scale[k] + lm_scoring.ADD) / mass
                loss[k] -= math.log((bi[v, w] * scale[k] + first) / (after[v] + lm_scoring.PRIOR))
        n = max(len(ws), 1)
        out.append((len(ws), loss["t"] / n, loss["n"] / n))
    return out


def test_lm_scores_equal_plain_models(spark):
    background = ["the cat sat on the mat", "The dog sat", None, "", "a dog and a cat " * 20, "mat the on sat"]
    target = ["the cat sat", "the dog ran home"]
    bg = spark.createDataFrame([(i, t, 1) for i, t in enumerate(background)], "doc_id long, text string, lm int")
    models = lm_scoring.train(bg, spark.createDataFrame([(t,) for t in target], "text string"))
    got = lm_scoring.score(bg.drop("lm"), models).orderBy("doc_id").select("lm.*").collect()
    for r, (n, t, b) in zip(got, plain_scores(background, target, background), strict=True):
        assert r["n_tokens"] == n
        assert r["target_loss"] == pytest.approx(t, abs=1e-4) and r["background_loss"] == pytest.approx(b, abs=1e-4)
        assert r["score"] == pytest.approx(t - b, abs=2e-4)


def test_lm_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    models = lm_scoring.train(docs.limit(0), docs.limit(0))
    assert sorted(r["n_tokens"] for r in lm_scoring.score(docs, models).select("lm.n_tokens").collect()) == [0, 2]
    assert lm_scoring.score(docs.limit(0), lm_scoring.train(docs, docs)).count() == 0


def test_lm_keeps_every_word_and_bigram(spark, monkeypatch):
    """Limits of memory set very low: blocks, buckets and hot words change nothing, and rare words and bigrams count like others."""
    for name, low in (("MAX_WORDS", 4), ("MAX_BIGRAMS", 4), ("BUFFER", 40), ("BLOCK", 30), ("BUCKET", 8), ("MIN_BUCKETS", 3), ("HOT_WORDS", 4)):
        monkeypatch.setattr(lm_scoring, name, low, raising=False)
    background = ["the cat sat on the mat", "The dog sat", None, "", "the cat sat on the mat", "a dog and a cat " * 20, "mat the on sat",
                  *(f"w{i} the w{i * 7 % 40} once{i}" for i in range(40)), "the"]
    target = ["the cat sat", "the dog ran home", "w3 the w21 seen"]
    other = [*background, "never seen words the cat", "the the", " "]
    bg = spark.createDataFrame([(i, t) for i, t in enumerate(background)], "doc_id long, text string")
    models = lm_scoring.train(bg, spark.createDataFrame([(t,) for t in target], "text string"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(other)], "doc_id long, text string")
    for scored, texts in ((bg, background), (docs, other)):
        got = lm_scoring.score(scored, models).orderBy("doc_id").select("lm.*").collect()
        for r, (n, t, b) in zip(got, plain_scores(background, target, texts), strict=True):
            assert (r["n_tokens"], r["target_loss"], r["background_loss"]) == (n, pytest.approx(t, abs=1e-6), pytest.approx(b, abs=1e-6))


def test_most_frequent_keeps_whole_grades(spark):
    counts = spark.createDataFrame([(i, n, 0) for i, n in enumerate([9, 9, 5, 5, 5, 1])], "key long, n long, t long")
    assert lm_scoring._most_frequent(counts, 4).count() == 2
    assert lm_scoring._most_frequent(counts, 5).count() == 5
    assert lm_scoring._most_frequent(counts, 1).count() == 0


LANGS = {"en": "the quick brown fox jumps over the lazy dog and then some other animals", "de": "der schnelle braune fuchs springt über den faulen hund und noch weiter",
         "fr": "le renard brun saute par dessus le chien paresseux et les autres bêtes"}


def test_language_id(spark):
    rows = [(i, LANGS[k], k) for i, k in enumerate(list(LANGS) * 4)]
    rows += [(100, None, "en"), (101, "12 34 -- !!", "de"), (102, "", None), (103, "the lazy dog", None), (104, "DER FAULE HUND", "xx-none"[:0] or None)]
    rows += [(105, " ".join([LANGS["en"]] * 3 + [LANGS["de"]] * 3), None)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string")
    model = language_id.train(docs.filter("doc_id < 100"))
    assert model.langs == ["de", "en", "fr"]
    got = {r["doc_id"]: r["language"] for r in language_id.identify(docs, model).collect()}
    for i, t, k in rows[:12]:
        assert got[i]["lang"] == k and got[i]["score"] > 0.9
    assert [got[i]["lang"] for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "de"]
    assert got[101]["score"] == 0.0
    assert set(got[105]["shares"]) == {"en", "de"} and all(0.3 < x < 0.7 for x in got[105]["shares"].values())
    assert language_id.identify(docs, model).count() == len(rows) + 1


def test_language_id_without_training(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert [r["language"]["lang"] for r in language_id.identify(docs, model).collect()] == ["und"]
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_em_finds_the_likeliest_shares():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(40), 3).T
    counts = rng.multinomial(4000, p @ [0.7, 0.3, 0.0]).astype(float)
    share, ll = language_id.mixture(p, counts, 500)
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1 - a, 41)]
    assert ll >= max(counts @ np.log(p @ np.maximum(g, 1e-12)) for g in grid) - 1.0  # it stops when no share moves by 1e-4
    assert abs(share[0] - 0.7) < 0.08


def test_fold_and_grams_are_per_text():
    texts = ["Ab, c1d", "", None, "ÉÀß--x"]
    letters, starts = chargrams.fold(texts)
    got = ["".join(map(chr, letters[s:e])) for s, e in zip(starts, starts[1:], strict=False)]
    assert got == [" ab c d ", " ", " ", " éàß x "]
    alone, _ = chargrams.fold([texts[3]])
    s, e = starts[3], starts[4]
    assert (chargrams.grams(letters, 3, 16)[s:e - 2] == chargrams.grams(alone, 3, 16)).all()


def test_toxicity_learns_and_scores(spark):
    rng = np.random.default_rng(5)
    syllables = ["an", "er", "ti", "on", "re", "st", "ing", "ou"]

    def prose(n):
        return " ".join("".join(rng.choice(syllables, 3)) for _ in range(n))
    rows = [(i, prose(60) + (" you idiot " + prose(5) if i % 4 == 0 else ""), 0 if i % 4 else 1) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "idiot", "x")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 160] + [(900, None), (None, 1), (777, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= x <= 1 for x in got.values())
    assert all((got[i] >= toxicity.THRESHOLD) == (y == 1) for i, _, y in rows if i >= 160)
    assert got[900] == got[901] < toxicity.THRESHOLD
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_trains_on_one_text_an_id(spark, monkeypatch):
    rows = [(i, f"{'you idiot' if i % 2 else 'a kind word'} number {i}") for i in range(40)]
    rows += [(7, f"copy {i} of an idiot") for i in range(60)] + [(8, None)] * 3 + [(9, rows[9][1])] * 30
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(4, 1)], "doc_id long, toxic int")
    sent, models, columns = [], [], toxicity.columns
    monkeypatch.setattr(toxicity, "columns", lambda df: sent.append(columns(df)) or sent[-1])
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        models.append(toxicity.train(docs, labels))
    assert [len(x["id"]) for x in sent] == [40, 40]
    assert (models[0].weights == models[1].weights).all() and models[0].intercept == models[1].intercept


def test_toxicity_training_holds_the_features_once(spark, monkeypatch):
    import tracemalloc

    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    rng = np.random.default_rng(5)
    letters = np.array([*"abcdefghijklmnopqrstuvwxyz "])
    rows = [(i, "".join(rng.choice(letters, 20000))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    f = toxicity.Features()
    size = 4 * sum(len(x) for _, t in rows for x in f.of([t]))
    tracemalloc.start()
    try:
        model = toxicity.train(docs, labels)
        left, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    print("MB of features, at most, afterwards:", *(x >> 20 for x in (size, peak, left)))
    assert model.weights.any()
    assert peak < 2.5 * size and left < 0.2 * size  # beside the features once: arrays of 2^20 numbers


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(r[0] < 0.01 for r in toxicity.score(docs, model).select("toxicity").collect())


def test_distinct_features():
    f = toxicity.Features()
    for text, got in zip(["abcabcabcabc abcabc", "xyz", ""], f.of(["abcabcabcabc abcabc", "xyz", ""]), strict=True):
        padded = f" {text} " if text else " "
        want = {padded[i:i + n] for n in toxicity.ORDERS for i in range(len(padded) - n + 1)}
        assert len(got) == len(set(got.tolist())) == len(want)
