"""Conversation repair against a search through all edits, on one task and on many small chunks."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rollbook.llm import repair
from rollbook.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def legal_end(roles):
    body = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or (body != "" and body == "ua" * (len(body) // 2))


def legal_start(roles):
    body = roles[1:] if roles[:1] == "s" else roles
    return body == ("ua" * len(body))[: len(body)]


def cheapest(rows, faults):
    """Cost, audit and repaired lines: least-cost search, ties by the audit's letters."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and legal_end(roles):
            return cost, audit, lines
        state = (i, "" if not roles else roles[-1])
        if state in done:
            continue
        done.add(state)

        def go(edit, more, step, initial, line):
            after = roles + initial
            if legal_start(after):
                # only the last role matters to what may follow, so long roles stay short
                heapq.heappush(heap, (cost + more, audit + edit, i + step, after, (*lines, *line)))

        for name in ("user", "assistant"):
            go("I", 3, 0, name[0], (f"{name}:",))
        if i < len(rows):
            _, role, text = rows[i]
            go("D", 4, 1, "", ())
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                if role[:1] in ("s", "u", "a") and role:
                    go("K", extra, 1, role[0], (f"{role}:{text}",))
                for name in ("user", "assistant"):
                    go("R", 3 + extra, 1, name[0], (f"{name}:{text}",))
    raise AssertionError


def brute(rows):
    """Rows (turn, role, text) of a conversation, nulls in place, to what the operator returns."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    rows, faults, seen = sorted(rows, key=key), [], set()
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        faults.append(fault)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = cheapest(rows, faults)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def harm(rows):
    out, lost = {}, set()
    for conv, turn, role, text in rows:
        lost.add(conv)
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        if fate:
            out.setdefault(conv, []).extend([(turn, role, text)] * (2 if fate == 3 else 1))
    return out, lost - set(out)


def random_rows(seed, convs=40, longest=14):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ux"]
    texts = ["Yes.", "No", "Why?  ", " \t", "", None, "Fine!\n", "So on  ", "Ĳ.\U0001f600", "again."]
    rows = []
    for c in range(convs):
        for i in range(rng.randrange(1, longest)):
            turn = None if rng.random() < 0.05 else i + rng.randrange(0, 3)
            rows.append((c if c else None, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"t{i}."))
    rng.shuffle(rows)
    return rows


def as_tuple(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha256)


def check(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(partitions)
    clash = {c: F.lit("clash") for c in ("at", "chunk", "initial", "fate", "row", "said", "kind", "conv_", "blank")}
    got = repair.repair(df.withColumns(clash), "conv", "turn", "role", "text").collect()
    convs = {}
    for c, *row in rows:
        convs.setdefault(c, []).append(tuple(row))
    assert len(got) == len(convs)
    for r in got:
        assert as_tuple(r) == brute(convs[r.conv]), r.conv


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_search(spark, seed):
    check(spark, random_rows(seed))


@pytest.mark.parametrize("rows,size", [(1, 1 << 20), (3, 1 << 20), (50, 9)])
def test_conversations_over_many_chunks(spark, monkeypatch, rows, size):
    monkeypatch.setattr(repair, "ROWS", rows)
    monkeypatch.setattr(repair, "BYTES", size)
    check(spark, random_rows(7, convs=12, longest=20) + [(99, t, "user" if t % 3 else "assistant", f"x{t % 40}.") for t in range(120)])


def test_repaired_rows_make_the_hash(spark, monkeypatch):
    monkeypatch.setattr(repair, "ROWS", 5)
    rows = random_rows(11)
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    edits = repair.repaired_rows(df, "conv", "turn", "role", "text").orderBy("conv", "position").collect()
    for r in repair.repair(df, "conv", "turn", "role", "text").collect():
        own = [e for e in edits if e.conv == r.conv]
        assert "".join(e.edit for e in own) == r.audit
        text = "\n".join(f"{e.role}:{e.text}" for e in own if e.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == r.sha256


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"What {t}? Well.") for c in range(150) for t in range(1 + c % 4)]
    rows += [(None, 1, None, None), (None, None, "user", "Hm."), (500, None, "user", None)]
    df = spark.createDataFrame(rows, "c long, t long, r string, x string")
    got = {r.conv: as_tuple(r) for r in repair.damaged_and_repaired(df, "c", "t", "r", "x").collect()}
    kept, lost = harm(rows)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert lost and got == {c: brute(v) for c, v in kept.items()} | {c: empty for c in lost}


def test_no_rows(spark):
    df = spark.createDataFrame([], "c long, t long, r string, x string")
    assert repair.damaged_and_repaired(df, "c", "t", "r", "x").count() == 0


def test_long_text_and_repeated_rows(spark):
    rows = [(1, 1, "user", "long " * 400_000 + "end."), (1, 2, "assistant", "ok.")] + [(2, 5, "user", "same.")] * 300
    check(spark, rows)


def test_query_equals_search(spark):
    names = ("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select(*names).collect()]
    kept, lost = harm(rows)
    got = QUERIES["op11_conversation_repair"](spark, SF_DIR).withColumnRenamed("repaired_sha256", "sha256").collect()
    assert len(got) == len(kept) + len(lost)
    for r in got:
        if r.conv_id in kept:
            assert as_tuple(r) == brute(kept[r.conv_id])
