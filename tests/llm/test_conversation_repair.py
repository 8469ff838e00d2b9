"""Conversation repair against all edit scripts of small conversations, cut and uncut, and the registered query against plain code."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagewatch.llm import conversation_repair as R
from pagewatch.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, copies int, audit string, at int"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if blank else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cheapest of all edit scripts with at most two insertions at a place."""
    faults, best = plain_faults(rows), None
    inserts = [(cost, "I" * len(w), tuple((x, "") for x in w)) for cost, w in ((3 * n, w) for n in range(3) for w in itertools.product(("user", "assistant"), repeat=n))]

    def go(i, cost, audit, lines):
        nonlocal best
        initials = "".join(r[:1] or "?" for r, _ in lines)  # an empty role is none that may stay
        if best and cost > best[0] or not re.match(r"(s?(ua)*u?)?\Z", initials):
            return
        for more, letters, added in inserts:
            if i == len(rows):
                if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in lines + added)):
                    found = (cost + more, audit + letters, lines + added)
                    best = min(best, found) if best else found
                continue
            _, role, text = rows[i]
            c, a, kept = cost + more, audit + letters, lines + added
            go(i + 1, c + 4, a + "D", kept)
            if faults[i] in ("", "truncated"):
                c += 3 * (faults[i] == "truncated")
                go(i + 1, c, a + "K", (*kept, (role, text)))
                for x in ("user", "assistant"):
                    go(i + 1, c + 3, a + "R", (*kept, (x, text)))

    go(0, 0, "", ())
    return best


def plain_row(rows):
    """What the query returns for rows of one conversation, in order."""
    faults = plain_faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, lines = plain_repair(rows)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def by_conversation(frame):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in frame.collect()}


def odd_rows(n=70, seed=4):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "What?\n ", "and then", "", " \t", "été.", None, "a ", "."]
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "unknown", "tool"])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 7]), role, rng.choice(texts), rng.choice([1, 1, 1, 1, 2, 0]), "x", 1))
    return rows


@pytest.mark.parametrize("segment_rows", [1024, 1, 2])
def test_repairs_equal_all_edit_scripts(spark, segment_rows):
    rows = odd_rows()
    convs = defaultdict(list)
    for conv, turn, role, text, copies, *_ in rows:
        convs[conv] += [(turn, " " if role is None else role, " " if text is None else text)] * copies
    want = {c: plain_row(ordered(r)) for c, r in convs.items()}
    found = R.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), copies=F.col("copies"), segment_rows=segment_rows)
    assert by_conversation(queries.conversation_digests(found)) == want


def test_empty_table_and_lines(spark):
    none = R.repair(spark.createDataFrame([], SCHEMA))
    assert none.conversations.count() == 0 and none.parts.count() == 0
    rows = [(1, 0, "assistant", "Hi.", 1, "", 1), (1, 1, "user", "And", 1, "", 1), (2, 0, "user", "Hello there. " * 50_000, 1, "", 1),
            (0, 0, "user", "x", 1, "", 1), (3, 0, "user", "x", 1, "", 1)]
    found = R.repair(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    got = {r["conv"]: r for r in found.conversations.collect()}
    parts = {r["conv"]: r["repaired"] for r in found.parts.collect()}
    lines = {c: [tuple(x) for x in (r["repaired"] if r["repaired"] is not None else parts[c])] for c, r in got.items()}
    assert (got[1]["cost"], got[1]["audit"]) == (7, "IKD") and lines[1] == [("I", "user", ""), ("K", "assistant", "Hi.")]
    assert lines[2] == [("K", "user", "Hello there. " * 50_000), ("I", "assistant", "")]


def test_one_long_conversation_is_cut(spark):
    """A conversation of which a hundredth would fill a segment, with a row that stands there very often."""
    rows = [(1, i // 2, "user" if i % 3 else "assistant", f"{i}" + "." * (i % 5 > 0), 1, "", 1) for i in range(3000)]
    rows += [(1, 700, "user", "again.", 100_000, "", 1), (2, 0, "user", "x.", 1, "", 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = R.repair(table, copies=F.col("copies"), segment_rows=30)
    assert found.parts.filter("conv = 1").count() >= 100
    whole = R.repair(table, copies=F.col("copies"), segment_rows=100_000)
    assert by_conversation(queries.conversation_digests(found)) == by_conversation(queries.conversation_digests(whole))
    r = found.conversations.filter("conv = 1").first()
    assert r["audit"].count("D") >= 99_999 and r["duplicate"] == 99_999


def test_superior_functions_give_what_repeated_relaxation_gives():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(i, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", "", f"{i}."])) for i in range(rng.randint(0, 4))]
        units = [R.Row(role, fault) for (_, role, _), fault in zip(rows, plain_faults(rows), strict=True)]
        ((cost, audit),) = R.derive(units, R.EMPTY, True).values()
        want = plain_repair(rows)
        assert (cost, audit) == want[:2]
        assert [(x["role"], x["text"]) for x in R.apply([(r, t, 1) for _, r, t in rows], audit, R.EMPTY)] == list(want[2])


def test_query_on_a_table_with_nulls(spark, tmp_path):
    rows = [r[:4] for r in odd_rows(60, 8)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        convs[conv] += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert by_conversation(queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path))) == {c: plain_row(ordered(r)) for c, r in convs.items()}
