"""SimHash groups, mixing, WARC, nearest neighbours and the pipeline on odd tables and against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewatch.llm import ann, mixing, simhash, warc
from pagewatch.llm.common import connected_components, hot_join, write_table
from pagewatch.session import scratch_path


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_groups(codes, radius):
    """Smallest position reachable, per position."""
    n, comp = len(codes), list(range(len(codes)))
    near = [[j for j in range(n) if (codes[i] ^ codes[j]).bit_count() <= radius] for i in range(n)]
    while True:
        new = [min(comp[j] for j in near[i]) for i in range(n)]
        if new == comp:
            return comp
        comp = new


def test_fingerprints_and_components(spark):
    texts = ["", None, "one", "One", "one two", "a b c d e f g", "A b\tc\nd e f g", "x y z" * 50, "ÀÉ b c", "  a", "w " * 70000]
    ids = [30, 7, 5, 3, 2, 11, None, 8, 9, 10, 1]
    docs = spark.createDataFrame(list(zip(ids, texts, ids, strict=True)) + [(30, "", 1)], "doc_id long, text string, fp long")
    got = simhash.near_duplicates(docs).collect()
    by = Counter((r["id"], r["fp"] % 2**64, r["component_id"]) for r in got)
    ids, texts = [*ids, 30], [*texts, ""]
    codes = [plain_fingerprint(t) for t in texts]
    comp = plain_groups(codes, 2)
    members = defaultdict(list)
    for i, c in zip(ids, comp, strict=True):
        members[c].append(i)
    want = Counter((i, f, min((x for x in members[c] if x is not None), default=None)) for i, f, c in zip(ids, codes, comp, strict=True))
    assert by == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(members) and simhash.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("node_rows", [4096, 64])
def test_index_finds_all_near_codes(spark, node_rows):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 6)
    codes = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for c in centres for _ in range(150)}
    codes = sorted(codes | {0, 2**64 - 1, 2**63, 1})
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    prints = spark.createDataFrame([(c,) for c in signed], "fp long")
    found = simhash.links(prints, 2, node_rows)
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in found.collect()]
    place = {c: i for i, c in enumerate(codes)}
    comp = plain_groups(codes, 2)
    assert all(comp[place[a]] == comp[place[b]] for a, b in pairs)
    roots = {r["node"] % 2**64: r["root"] for r in connected_components(found).collect()}
    groups = defaultdict(set)
    for c in codes:
        groups[comp[place[c]]].add(roots.get(c, ("alone", c)))
    assert all(len(g) == 1 for g in groups.values())


def test_gray_links_equal_all_pairs():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 1 << 14, 900).astype(np.uint64))
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    i, j = simhash.gray_links(codes, 1)
    labels = np.arange(len(codes))
    labels[i] = j
    want = plain_groups([int(c) for c in codes], 1)
    assert [want[x] for x in labels] == want and len(set(labels.tolist())) == len(set(want))


def test_connected_components_of_a_star_and_a_path(spark):
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3), (3, 0), (0, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{100 + i: 100 for i in range(41)}}


def test_hot_join_keeps_all_rows(spark):
    left = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 50), (3, 51), (None, 52)], "k long, x long")
    right = spark.createDataFrame([(1, "one", 30), (2, "two", 1)], "k long, v string, n long")
    for total in (33, 33_000_000):
        got = Counter(r["v"] for r in hot_join(left, right, ["k"], "n", total).collect())
        assert got == {"one": 30, "two": 1, None: 2}


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(4)
    sources = ["b", "a", None, "c", "tiny", "none"]
    rows = []
    for i in range(400):
        s = sources[min(int(rng.integers(0, 12)), 3)]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 40))), s, "clash"))
    rows += [(900, "one two", "tiny", "x"), (901, None, "none", "x"), (902, "", "none", "x"), (None, "x y z", "a", "x"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).select("row", "id", "size", "source_size", "target", "taken", "wanted").collect()
    assert len(got) == len(rows)
    per = defaultdict(lambda: [0, 0, None])
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["row"]["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        p = per[r["row"]["source"]]
        p[0], p[1], p[2] = p[0] + r["size"], p[1] + r["taken"], r["target"]
        assert r["row"]["size"] in ("clash", "x")
    total = sum(p[0] for p in per.values())
    # The stated rule, step by step.
    order = sorted(k for k in per if k is not None) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, fixed = {}, set()
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(target[s] for s in fixed)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * per[s][0]]
        target.update({s: 3.0 * per[s][0] for s in over})
        fixed.update(over)
        if not over:
            target.update(share)
            break
    for s in order:
        assert per[s][2] == pytest.approx(target[s]) and abs(per[s][1] - target[s]) <= 0.5
    again = mixing.mix(docs.repartition(7)).select("id", "taken").collect()
    assert Counter((r["id"], r["taken"]) for r in got) == Counter(map(tuple, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_curriculum_is_sorted_and_ramps(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    takes = mixing.curriculum(mixing.mix(docs)).collect()
    at = [r["position"] for r in takes]
    assert at == sorted(at) and 0 <= at[0] and at[-1] < 1
    first = Counter(r["row"]["source"] for r in takes[:60])
    last = Counter(r["row"]["source"] for r in takes[-60:])
    assert first["a"] > last["a"] and first["c"] < last["c"]
    assert all(r["words"] == 10 for r in takes)


def test_warc_round_trip(spark):
    big = "<html>" + "é" * 100 + "</html>"
    rows = [(5, "http://a/1", big, "z"), (3, "http://a/2", big, "z"), (9, None, big, "z"), (1, "http://a b/\r\nX: y", "short", "z"), (2, "http://a/3", "short", "z"),
            (4, "http://a/4", None, "z"), (6, "http://a/5", "", "z"), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 50, "z"), (3, "http://a/2", big, "z"), (None, "n", big, "z"),
            (2**60, "far", "x" * 300_000, "z"), (2**60 + 1, "far", "y" * 99, "z"), (2**60 + 2, "far", "y" * 99, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = scratch_path(spark, "warc_test")
    warc.write_warc(pages, folder)
    got = warc.read_warc(spark, folder).collect()
    assert all(r["valid"] for r in got) and len(got) == len(rows)
    kinds = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got)
    n = len(big.encode())
    want = Counter({(3, n, "response", None): 1, (3, n, "revisit", 3): 1, (5, n, "revisit", 3): 1, (9, n, "revisit", 3): 1, (None, n, "revisit", 3): 1,
                    (1, 5, "response", None): 1, (2, 5, "response", None): 1, (4, 0, "response", None): 1, (6, 0, "response", None): 1, (7, 14 * 50, "response", None): 1,
                    (2**60, 300_000, "response", None): 1, (2**60 + 1, 99, "response", None): 1, (2**60 + 2, 99, "response", None): 1})
    assert kinds == want
    bodies = {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert bodies[3] == big.encode() and bodies[7] == rows[7][2].encode() and bodies[4] == b""


def test_warc_files_are_the_same_again_and_roll(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, f"http://h/{i}", rng.bytes(20_000).hex()) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    monkeypatch.setattr(warc, "SHARD_BYTES", 700_000)
    a, b = scratch_path(spark, "warc_a"), scratch_path(spark, "warc_b")
    one = sorted(map(tuple, warc.write_warc(pages, a).collect()))
    two = sorted(map(tuple, warc.write_warc(pages.repartition(3), b).collect()))
    assert one == two and len({x[0] for x in one}) == 4
    ids = [r["page_id"] for r in warc.read_warc(spark, a).orderBy("file", "offset").select("page_id").collect()]
    assert ids == sorted(ids)


def test_warc_empty_table_and_rolling_by_size(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = scratch_path(spark, "warc_none")
    warc.write_warc(pages, folder)
    assert warc.read_warc(spark, folder).count() == 0
    from pyarrow import fs
    shard, rows = warc._Shard(fs.LocalFileSystem(), str(tmp_path), 3), []
    for i in range(5):
        rows += shard.add(np.random.default_rng(i).bytes(warc.ROLL_BYTES // 2 + 1), 1)
    rows.append(shard.close())
    assert [r[1] for r in rows] == ["part-000003-00000.warc.gz", "part-000003-00001.warc.gz", "part-000003-00002.warc.gz"]
    assert [r[2] for r in rows] == [2, 2, 1] and sorted(p.name for p in tmp_path.iterdir()) == [r[1] for r in rows]


def test_multi_index_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 256, (500, 8)).astype(np.uint8)
    index = ann.MultiIndex(code)
    for q in code[:5]:
        d = np.bitwise_count(code ^ q).sum(1)
        growing = index.probe(q)
        for r in (0, 3, 7, 8, 20, 31, 64):
            assert growing.within(r).tolist() == index.probe(q).within(r).tolist() == np.flatnonzero(d <= r).tolist()


def test_nearest_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    x[11] = x[12] = x[13]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2020, [0.0] * 24, 1), (2040, [float("nan")] * 24, 1), (2060, [None] * 24, 1), (None, x[0].tolist(), 1), (2080, [1.0], 1), rows[40]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    queries = vectors.filter(F.col("vec_id") % 20 == 0)
    got = write_table(ann.search(vectors, queries, k=10, retrieve=60, shard_rows=400, query_rows=40), "ann_test").collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["id"], r["score"]))
    assert sorted(by) == list(range(0, 1500, 20))
    hit, full = 0, x.astype(float)
    for q, found in by.items():
        assert len(found) == 10 and found == sorted(found, key=lambda f: (-f[1], f[0])) and q not in [f[0] for f in found]
        assert all(s == (full[i] * full[q]).sum() for i, s in found)
        hit += len({f[0] for f in found} & set(ann.brute_force(full, np.arange(1500), full[q], q, 10).tolist()))
    assert hit / (10 * len(by)) >= 0.9


def test_nearest_neighbours_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [-1.0, 0.0])], schema)
    got = sorted(map(tuple, ann.search(few, few.filter("vec_id % 20 = 0")).collect()))
    assert got == [(0, 1, 20, 1.0), (0, 2, 3, -1.0), (20, 1, 0, 1.0), (20, 2, 3, -1.0)]


def test_nearest_neighbours_of_each_length(spark):
    rng = np.random.default_rng(8)
    x = {i: rng.normal(size=(12, 5, 1)[i % 3]) for i in range(90)}
    x[300] = rng.normal(size=7)  # the only one of its length
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<double>")
    got = ann.search(vectors, vectors.filter("vec_id % 10 = 0"), k=4, shard_rows=12, query_rows=2).collect()
    want = []
    for q in range(0, 90, 10):
        ids = np.array([i for i, v in x.items() if len(v) == len(x[q])])
        want += [(q, rank, i) for rank, i in enumerate(ann.brute_force(np.stack([x[i] for i in ids]), ids, x[q], q, 4).tolist(), 1)]
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got) == want


def test_pipeline_equals_its_stages_by_brute_force(spark, sf):
    import corpus_pipeline as P
    from pagewatch.llm import language_id, toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    kept, seen = docs, {}
    for name, stage in P.STAGES:
        kept = write_table(stage(spark, kept, sf), name)
        seen[name] = kept
    assert all(seen[n].columns == P.COLUMNS for n in names[:-1])
    ids = {n: [r[0] for r in seen[n].select("doc_id").collect()] for n in names}
    toxic = {r[0] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").select("doc_id").collect()}
    assert len(toxic & set(ids["toxicity"])) <= len(toxic) / 3  # this table has a dozen toxic documents to learn from
    assert set(ids["language_id"]) <= set(ids["toxicity"])
    texts = {r["doc_id"]: r for r in docs.collect()}
    left = ids["language_id"]
    comp = plain_groups([plain_fingerprint(texts[i]["text"]) for i in left], 2)
    first = {}
    for i, c in zip(left, comp, strict=True):
        first[c] = min(first.get(c, i), i)
    assert sorted(ids["simhash_near_dedup"]) == sorted(first.values())
    words = Counter()
    for i in ids["curriculum_mix"]:
        words[texts[i]["source"]] += len(texts[i]["text"].split())
    largest = max(len(t["text"].split()) for t in texts.values())
    for r in mixing.mix(seen["simhash_near_dedup"]).select("row.source", "target").distinct().collect():
        assert abs(words[r["source"]] - r["target"]) <= largest / 2 + 1
    assert Counter(ids["bpe_codec"]) == Counter(ids["curriculum_mix"])
    order = [r["id"] for r in mixing.curriculum(mixing.mix(seen["simhash_near_dedup"])).select("id").collect()]
    trained = seen["bpe_codec"].orderBy("shard", "row").collect()
    assert [r["doc_id"] for r in trained] == order and len({(r["shard"], r["row"]) for r in trained}) == len(order)
    loose = P.encode(spark, spark.createDataFrame([(1, "a text")], "doc_id long, text string"), sf).first()
    assert loose["n_tokens"] > 0 and loose["shard"] is None and loose["row"] is None
    assert language_id.UNKNOWN == "und" and toxicity.THRESHOLD == 0.3
