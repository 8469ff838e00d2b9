"""Conversation structure repair by Knuth's lightest derivations.

A conversation is to become one whose roles read (s?(ua)+)?: perhaps a system
turn, then pairs of user and assistant. Items say how far the rows have been
read and what the roles kept so far allow next. A deduction takes two items, a
place and an edit of the row there (or an insertion), and gives the place after
it; its function adds the costs and appends the edit's letter to the audit. In
the order of (cost, audit) such a function is monotone and superior: two audits
of equal cost that lead to the same item never begin one another, as the longer
one would have the cost of an insertion more. So items popped from the agenda
are final, and the repair is known once the goal item is popped.

Rows are folded with their copies, sorted by conversation over range partitions
and read as a stream. A conversation that lies within one partition and is not
very long is repaired where it is read. Others are cut into segments: for each
state before a segment the agenda gives the lightest derivation to each state
after it, these are chained per conversation, and every segment applies its own edits.
No task holds more than a segment and the audit, which is one value of the result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import write_table

COST = {"D": 4, "I": 3, "K": 0, "R": 3}  # delete, insert, keep, give another role
TRUNCATED = 3                            # for a truncated row that stays
BLANKS = " \t\n\x0b\x0c\r"
SEGMENT_ROWS = 1024
SEGMENT_CHARS = 1 << 22

# What the roles so far allow: nothing kept, a system turn, a user turn that waits for its assistant, whole pairs.
EMPTY, SYSTEM, USER, PAIRS = range(4)
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIRS, (PAIRS, "u"): USER}
GOALS = (EMPTY, PAIRS)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

Value = tuple[int, str]


def lightest(axioms: Iterable[tuple], deductions: Callable, goal: tuple | None) -> dict[tuple, Value]:
    """Final values of items: until ``goal`` is final, or of all that can be derived.

    ``axioms``: (item, value); ``deductions(item, final)``: (item, value) of every deduction of which ``item``
    was the last antecedent to become final. Values only grow along deductions, so the least on the agenda is final.
    """
    agenda = [(value, item) for item, value in axioms]
    heapify(agenda)
    final: dict[tuple, Value] = {}
    while agenda:
        value, item = heappop(agenda)
        if item in final:
            continue
        final[item] = value
        if item == goal:
            break
        for found, v in deductions(item, final):
            if found not in final:
                heappush(agenda, (v, found))
    return final


@dataclass
class Row:
    """A row of a conversation, or a run of ``n`` rows that must all go."""

    role: str
    fault: str   # blank, duplicate, truncated or nothing
    n: int = 1

    def edits(self) -> list[tuple[str, str, int]]:
        """(letter, initial of the role it gives, cost)"""
        out = [("D", "", COST["D"] * self.n)]
        if self.fault in ("", "truncated"):
            more = TRUNCATED if self.fault else 0
            out += [("K", self.role[:1], COST["K"] + more)] + [("R", x, COST["R"] + more) for x in ROLES]
        return out


def derive(rows: list[Row], start: int, whole: bool) -> dict[int, Value]:
    """Lightest (cost, audit) to the goal states after ``rows``, from state ``start``; to every state unless ``whole``.

    With ``whole`` only the goal's value is there, under the state that gave it.
    """
    edits = [[(("edit", i, *e[:2]), e) for e in row.edits()] for i, row in enumerate(rows)]
    inserts = [(("insert", 0, "I", x), ("I", x, COST["I"])) for x in ROLES]
    goal = ("goal", 0, "", "")

    def step(at: tuple, place: Value, edit: tuple, i: int):
        letter, x, cost = edit
        state = at[2] if letter == "D" else NEXT.get((at[2], x))
        if state is not None:
            n = rows[i].n if letter == "D" else 1
            return ("at", i if letter == "I" else i + 1, state, ""), (place[0] + cost, place[1] + letter * n)
        return None

    def deductions(item: tuple, final: dict) -> Iterator[tuple]:
        if item[0] == "at":
            i, value = item[1], final[item]
            for known, edit in (edits[i] if i < len(rows) else []) + inserts:
                if known in final and (found := step(item, value, edit, i)):
                    yield found
            if whole and i == len(rows) and item[2] in GOALS:
                yield goal, value
        elif item[0] == "edit":
            edit = next(e for known, e in edits[item[1]] if known == item)
            for state in (EMPTY, SYSTEM, USER, PAIRS):
                at = ("at", item[1], state, "")
                if at in final and (found := step(at, final[at], edit, item[1])):
                    yield found
        elif item[0] == "insert":
            edit = next(e for known, e in inserts if known == item)
            for at, value in list(final.items()):
                if at[0] == "at" and (found := step(at, value, edit, at[1])):
                    yield found

    axioms = [(known, (e[2], "")) for row in [*edits, inserts] for known, e in row]
    final = lightest([*axioms, (("at", 0, start, ""), (0, ""))], deductions, goal if whole else None)
    if whole:
        at = min((final[a], a[2]) for a in (("at", len(rows), s, "") for s in GOALS) if a in final)
        return {at[1]: final[goal]}
    return {s: final[a] for s in range(4) if (a := ("at", len(rows), s, "")) in final}


def apply(rows: list[tuple[str, str, int]], audit: str, state: int) -> list[dict]:
    """The lines that the edits of ``audit`` leave of (role, text, copies), from ``state`` on."""
    out, letters = [], iter(audit)
    expected = {EMPTY: "u", SYSTEM: "u", PAIRS: "u", USER: "a"}

    def put(letter: str, role: str, text: str):
        nonlocal state
        state = NEXT[(state, role[:1])]
        out.append({"edit": letter, "role": role, "text": text})

    for role, text, copies in rows:
        left = copies
        while left:
            letter = next(letters)
            if letter == "I":
                put("I", ROLES[expected[state]], "")
                continue
            left -= 1
            if letter != "D":
                put(letter, role if letter == "K" else ROLES[expected[state]], text)
    for letter in letters:
        put(letter, ROLES[expected[state]], "")
    return out


LINES = "array<struct<edit:string,role:string,text:string>>"
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
PART = ("at long, open boolean, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, "
        "first string, last string, cost long, audit string, repaired " + LINES + ", paths array<struct<start:int,stop:int,cost:long,audit:string>>, "
        "rows array<struct<role:string,text:string,copies:long>>")


class _Part:
    """Rows of one conversation that stand together in a partition."""

    def __init__(self, conv, opens: bool):
        self.conv, self.opens = conv, opens
        self.rows: list[tuple[str, str, int]] = []
        self.units: list[Row] = []
        self.chars = 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.first = self.last = None
        self.turns = 0

    def add(self, turn, role: str, text: str, copies: int, first: bool, blank: bool, truncated: bool):
        fault = "blank" if blank else "duplicate" if not first else "truncated" if truncated else ""
        self.units.append(Row(role, fault))
        again = "blank" if blank else "duplicate"
        if copies > 1:
            self.units.append(Row(role, again, copies - 1))
            self.counts[again] += copies - 1
        if fault:
            self.counts[fault] += 1
        if self.last is not None:
            self.counts["illegal"] += self.last + role[:1] not in LEGAL
        self.counts["illegal"] += (copies - 1) * (role[:1] * 2 not in LEGAL)
        self.first, self.last = role[:1] if self.first is None else self.first, role[:1]
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        self.rows.append((role, text, copies))
        self.chars += len(text)

    def record(self, at: int, closes: bool) -> dict:
        whole = closes and not self.opens
        out = {"at": at, "open": not whole, "first_turn": self.first_turn, "last_turn": self.last_turn, "turns": self.turns,
               "first": self.first, "last": self.last, **self.counts}
        if whole:
            (cost, audit), = derive(self.units, EMPTY, True).values()
            return out | {"cost": cost, "audit": audit, "repaired": apply(self.rows, audit, EMPTY)}
        paths = [{"start": s, "stop": q, "cost": c, "audit": a} for s in range(4) for q, (c, a) in derive(self.units, s, False).items()]
        return out | {"paths": paths, "rows": [dict(zip(("role", "text", "copies"), r, strict=True)) for r in self.rows]}


def _with(conv: StructField, ddl: str) -> StructType:
    return StructType([StructField("conv", conv.dataType), *StructType.fromDDL(ddl).fields])


def _records(schema: StructType):
    """Arrow batches of some hundred records."""
    arrow = to_arrow_schema(schema)

    def batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        held = []
        for r in rows:
            held.append(r)
            if len(held) == 256:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held = []
        yield pa.RecordBatch.from_pylist(held, arrow)

    return batches


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _ordered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies, first, blank, truncated), folded, flagged and sorted over range partitions.

    ``first``: no earlier turn of the conversation has the role and text. The flag comes as a row of its own that meets
    its row by (conv, turn, digest), so neither copies nor a text of very many turns meet in one task.
    """
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    live = rows.filter("copies > 0").withColumn("said", said)
    earliest = live.groupBy("conv", "said").agg(F.when(~F.bool_or(F.col("turn").isNull()), F.min("turn")).alias("turn"))
    none = F.lit(None).cast("string")
    flags = earliest.select("conv", "turn", "said", none.alias("role"), none.alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(True).alias("first"))
    live = live.select("conv", "turn", "said", "role", "text", "copies", F.lit(False).alias("first"))
    folded = live.unionByName(flags).groupBy("conv", "turn", "said").agg(
        F.max("role").alias("role"), F.max("text").alias("text"), F.sum("copies").alias("copies"), F.max("first").alias("first"))
    end = F.rtrim("text", F.lit(BLANKS))
    folded = folded.select("conv", "turn", "role", "text", "copies", "first", (end == "").alias("blank"),
                           (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"))
    order = ["conv", "turn", "role", "text"]
    return folded.repartitionByRange(*order).sortWithinPartitions(*order)


def _read(conv: StructField, segment_rows: int, segment_chars: int):
    schema = _with(conv, PART)
    records = _records(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32

        def parts() -> Iterator[dict]:
            nonlocal at
            part = None
            for conv, *row in _rows(batches):
                if part is not None and conv != part.conv:
                    yield {"conv": part.conv} | part.record(at, True)
                    at += 1
                    part = _Part(conv, False)
                elif part is None:
                    part = _Part(conv, True)  # a partition's first conversation may have begun in the one before
                elif len(part.rows) >= segment_rows or part.chars >= segment_chars:
                    yield {"conv": conv} | part.record(at, False)
                    at += 1
                    part = _Part(conv, True)
                part.add(*row)
            if part is not None:
                yield {"conv": part.conv} | part.record(at, False)  # and its last may go on

        yield from records(parts())

    return read, schema


def _chain(conv: StructField):
    """Chain the segments of each conversation, which come in order: its repair, and the states between which each segment's lies."""
    schema = _with(conv, "at long, start int, stop int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    records = _records(schema)

    def finish(chain: dict) -> Iterator[dict]:
        (cost, tail), state = min((v, s) for s, v in chain["place"].items() if s in GOALS)
        turns = chain["turns"]
        gaps = chain["last_turn"] - chain["first_turn"] + 1 - turns if turns else 0
        yield {"conv": chain["conv"], "gaps": gaps, "cost": cost, "audit": "".join(chain["settled"]) + tail, **chain["counts"]}
        for at, before in reversed(chain["steps"]):
            yield {"conv": chain["conv"], "at": at, "start": before[state], "stop": state}
            state = before[state]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            chain = None
            for conv, at, first_turn, last_turn, turns, first, last, paths, *counts in _rows(batches):
                if chain is None or conv != chain["conv"]:
                    if chain:
                        yield from finish(chain)
                    chain = {"conv": conv, "place": {EMPTY: (0, "")}, "settled": [], "steps": [], "turns": 0, "first_turn": None,
                             "last_turn": None, "last": None, "counts": dict.fromkeys(COUNTS, 0)}
                for k, n in zip(COUNTS, counts, strict=True):
                    chain["counts"][k] += n
                if chain["last"] is not None:
                    chain["counts"]["illegal"] += chain["last"] + first not in LEGAL
                chain["last"] = last
                if turns:
                    chain["turns"] += turns - (first_turn == chain["last_turn"])
                    chain["first_turn"] = first_turn if chain["first_turn"] is None else chain["first_turn"]
                    chain["last_turn"] = last_turn
                best: dict[int, tuple] = {}
                for p in paths:
                    if p["start"] in chain["place"]:
                        cost, audit = chain["place"][p["start"]]
                        found = ((cost + p["cost"], audit + p["audit"]), p["start"])
                        best[p["stop"]] = min(best.get(p["stop"], found), found)
                chain["steps"].append((at, {s: before for s, (_, before) in best.items()}))
                # What all places have in common is settled; only the rest is compared further on.
                common = len(os.path.commonprefix([v[1] for v, _ in best.values()]))
                chain["settled"].append(next(iter(best.values()))[0][1][:common])
                chain["place"] = {s: (v[0], v[1][common:]) for s, (v, _) in best.items()}
            if chain:
                yield from finish(chain)

        yield from records(rows())

    return read, schema


def _repaired(conv: StructField):
    schema = _with(conv, f"at long, repaired {LINES}")
    records = _records(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from records({"conv": conv, "at": at, "repaired": apply([tuple(r.values()) for r in rows], audit, start)}
                           for conv, at, rows, audit, start in _rows(batches))

    return read, schema


@dataclass
class Repaired:
    """``conversations``: a row each, with ``repaired``, its lines, null where they are in ``parts`` (conv, at, repaired)
    because the conversation was cut; the order of its parts is that of ``at``."""

    conversations: DataFrame
    parts: DataFrame


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           copies: Column | None = None, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> Repaired:
    """Counts of faults, cheapest repair and repaired lines of every conversation.

    ``conversations``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired. ``copies``: how often a row
    stands there (once by default); a conversation of which every row stands there 0 times has zeros, no edits and no lines.
    A null role or text is one space; rows with a null conversation are one conversation; null turns come first and count
    for no gap; a row of empty role cannot stay as it is. Rows of equal turn are ordered by role and text. Repeated rows are duplicates. Other columns are not read.
    An empty table gives an empty result. Only a conversation's audit is ever one value, all else is bounded by a segment.
    """
    col = lambda c: F.col(f"`{c}`")
    rows = rows.select(col(conv_col).alias("conv"), col(turn_col).cast("long").alias("turn"), F.coalesce(col(role_col), F.lit(" ")).alias("role"),
                       F.coalesce(col(text_col), F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    conv = rows.schema["conv"]
    read, schema = _read(conv, segment_rows, segment_chars)
    parts = write_table(_ordered(rows).mapInArrow(read, schema), "conversation_parts")
    cut = parts.filter("open")
    chain, chained = _chain(conv)
    chains = write_table(cut.select("conv", "at", "first_turn", "last_turn", "turns", "first", "last", "paths", *COUNTS)
                         .repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(chain, chained), "conversation_chains")
    columns = ["conv", "gaps", *COUNTS, "cost", "audit", "repaired"]
    gaps = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0)
    whole = parts.filter("NOT open").withColumn("gaps", gaps).select(*columns)
    long = chains.filter("at IS NULL").withColumn("repaired", F.lit(None).cast(LINES)).select(*columns)
    zero = F.lit(0).cast("long")
    empty = rows.groupBy("conv").agg(F.max("copies").alias("most")).filter("most <= 0").select(
        "conv", *[zero.alias(k) for k in ("gaps", *COUNTS, "cost")], F.lit("").alias("audit"), F.array().cast(LINES).alias("repaired"))
    chosen = F.filter("paths", lambda p: (p["start"] == F.col("start")) & (p["stop"] == F.col("stop")))[0]["audit"]
    write, lines = _repaired(conv)
    done = cut.select("conv", "at", "rows", "paths").join(chains.filter("at IS NOT NULL").select("at", "start", "stop"), "at")
    return Repaired(whole.unionByName(long).unionByName(empty), done.select("conv", "at", "rows", chosen.alias("audit"), "start").mapInArrow(write, lines))


def sha256_of_parts(parts: DataFrame) -> DataFrame:
    """(conv, sha256) of the newline-joined ``role:text`` lines of each cut conversation.

    A digest is one pass over its text: a conversation's parts go through one task in order, held one batch at a time.
    """
    conv = parts.schema["conv"]
    schema = _with(conv, "sha256 string")
    records = _records(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            seen, of, h, some = False, None, hashlib.sha256(), False
            for conv, lines in _rows(batches):
                if seen and conv != of:
                    yield {"conv": of, "sha256": h.hexdigest()}
                    h, some = hashlib.sha256(), False
                seen, of = True, conv
                for line in lines:
                    h.update(("\n" * some + line["role"] + ":" + line["text"]).encode())
                    some = True
            if seen:
                yield {"conv": of, "sha256": h.hexdigest()}

        yield from records(rows())

    return parts.repartition("conv").sortWithinPartitions("conv", "at").select("conv", "repaired").mapInArrow(read, schema)


def damage(rows: DataFrame) -> DataFrame:
    """The rows of op11's contract: by crc32 of ``conv_id:turn`` modulo 20 dropped (0 copies), emptied, without sentence marks, twice, or of user.

    Nulls are one space, turns and conversations keep theirs.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                       F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
