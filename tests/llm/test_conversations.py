"""Repair and trie of conversations against plain Python that tries every edit and builds every prefix."""

import hashlib
import heapq
import itertools
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from inkstone.llm import conversation_repair as repair
from inkstone.llm import conversation_trie as trie
from inkstone.llm import queries, sequences
from inkstone.llm.common import Scratch

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, audit, repaired rows) by uniform search over all edits; rows are (role, text, fault)."""
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap = [(0, "", 0, "", ())]
    best = None
    seen = set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if (cost, audit, i, state, out) in seen:
            continue
        seen.add((cost, audit, i, state, out))
        if i == len(rows) and state in ("", "a") and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        if audit[-3:] != "III":
            for name in ("user", "assistant"):
                if name[0] in allowed[state]:
                    heapq.heappush(heap, (cost + 3, audit + "I", i, name[0], (*out, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if role[:1] and role[:1] in allowed[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if name[0] in allowed[state]:
                        heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, name[0], (*out, f"{name}:{text}")))
    return best


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = set()
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in mine:
            inner = text.strip(SPACE)
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, out = cheapest(faulty)
        count = [sum(f == name for _, _, f in faulty) for name in ("blank", "duplicate", "truncated")]
        found.add((conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()))
    return found


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    texts = ["", " ", "\n\t", None, "Yes.", "No?", "cut of", "Well!  ", "a.b", " ", "x" * 3000 + ".", "é."]
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randint(1, most)):
            turn = rng.choice([turn, turn, turn, None, turn + 2])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), rng.choice(texts)))
        if rng.random() < 0.2:
            rows.append(rows[-1])
    return rows


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_like_search(spark):
    rows = random_rows(3, 150, 6)
    got = repair.digests(spark.createDataFrame(rows, SCHEMA).withColumn("a.b", F.lit(1)).withColumn("at", F.lit("x")))
    assert got.columns == COLUMNS
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len({r[0] for r in rows}) and set(found) == expected(rows)


def test_repair_of_test_table(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.QUERIES["op11_conversation_repair"](spark, DATA).collect()} == expected(rows)


def test_repair_of_empty_and_dropped(spark):
    assert repair.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next((c, t) for c in range(99) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    row = repair.digests(spark.createDataFrame([(*gone, "user", "Hello.")], SCHEMA)).collect()
    assert [tuple(r) for r in row] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_every_short_signature():
    letters = "abcdefghijklmnop"
    for n in range(4):
        for signature in itertools.product(letters if n < 3 else "ehijlnp", repeat=n):
            rows = [(("system", "user", "assistant", "tool")[d // 4], "t", (None, "blank", "duplicate", "truncated")[d % 4]) for d in (ord(c) - 97 for c in signature)]
            cost, audit, _ = cheapest(rows)
            assert repair.solve("".join(signature))[:2] == (audit, cost)


def test_long_signature():
    rng = random.Random(1)
    signature = "".join(rng.choice("aeiehil") for _ in range(30_000))
    audit, cost, replay, tail = repair.solve(signature)
    assert len(replay) == 30_000 and len(audit.replace("I", "")) == 30_000
    assert cost >= 4 * audit.count("D") + 3 * audit.count("R") + 3 * audit.count("I")


def test_long_conversation_over_partitions(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t % 700}.") for t in range(2500)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    found = repair.repair(spark.createDataFrame(rows, SCHEMA), Scratch(spark))
    audit = {r["conv_id"]: r for r in found.audits.collect()}
    assert audit[1]["duplicate"] == 1800 and audit[1]["audit"] == "K" * 700 + "D" * 1800 and audit[2]["cost"] == 0
    kept = found.rows.where("conv_id = 1").orderBy("at", "place").collect()
    assert [r["text"] for r in kept] == [f"Turn {t}." for t in range(700)] and {r["edit"] for r in kept} == {"K"}


def test_streamed_digest(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [(k, i, f"v{k}{i}") for k in (None, 1, 2) for i in range(10)]
    got = sequences.joined_sha256(spark.createDataFrame(rows, "k long, i int, v string"), "k", ["i"], "v", "|", "h").collect()
    assert {(r["k"], r["h"]) for r in got} == {(k, hashlib.sha256("|".join(f"v{k}{i}" for i in range(10)).encode()).hexdigest()) for k in (None, 1, 2)}


def expected_trie(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        full = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(full) + 1):
            members.setdefault(tuple(full[:d]), []).append((c, d == len(full)))
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    under = {}
    for path in sorted(members, key=len, reverse=True):
        below = [under[c] for c in children.get(path, [])]
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        under[path] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[path]) - 1) * words)
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c, end in sorted(who) if end)
        out.append((min(who)[0], len(path), min(members[path[:-1]])[0] if path else None, len(who), len(children.get(path, [])), *under[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def shared_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), 5000]:
        for turn in range(rng.choice([1, 2, 3, 9])):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b", "c", None, ""])))
    long = [(turn, "user", f"turn {turn}") for turn in range(60)]
    rows += [(conv, *t) for conv in (6000, 6020, 6040) for t in long[: conv // 100]]
    rows += [(7000 + 20 * k, *t) for k in range(12) for t in long[: 5 * k + 1] + [(99, "user", f"end {k}")]]
    return [*rows, (None, 1, "user", "lost")]


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_like_dictionaries(spark, seed):
    rows = shared_rows(seed, 60)
    got = trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA).withColumn("a.b", F.lit(1)).withColumn("node", F.lit("x")))
    assert got.columns == TRIE
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_trie(rows)


def test_trie_of_test_table(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op13_conversation_trie"](spark, DATA).collect()), key=repr) == expected_trie(rows)


def test_trie_edges(spark):
    assert trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    short = next(c for c in range(1, 999) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    got = trie.rebuilt_trie(spark.createDataFrame([(short, 0, "user", "one two")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]
