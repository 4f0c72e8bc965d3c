"""Repair of conversation structure by signatures.

Every row becomes one letter for its role and fault, a conversation the string of its letters: its signature. Each distinct
signature is solved once by memoised recursion, its audit (the cheapest edits) is joined back to the conversations that have
it, and the edits are replayed on their rows.
"""

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .sequences import in_order, joined_sha256, part_of

#: What counts as white space in the text of a turn.
SPACE = " \t\n\x0b\f\r"
ROLES, FAULTS = ("s", "u", "a"), ("sound", "blank", "duplicate", "truncated")
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
#: The role that may be put after one of this initial; a conversation is `(s?(ua)+)?`.
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}
STATES = ("", "s", "u", "a")
#: What may be put before a row, and what is done to the row: a letter of a replay string names one of each.
PUT, DONE = ("", "u", "a", "ua", "au"), ("D", "K", "u", "a")
#: Recursion goes no deeper than this many rows.
STRIDE = 200


class Repaired(NamedTuple):
    audits: DataFrame
    rows: DataFrame


def solve(signature: str) -> tuple[str, int, str, str]:
    """(audit, cost, replay, tail) of a signature: the cheapest edits' initials, of equal costs the least string; a letter
    for each row; the roles put after the last row."""
    rows = [divmod(ord(c) - 97, 4) for c in signature]
    n, memo = len(rows), {}
    choice = bytearray(4 * (n + 1))

    def after(state: str, inserts: int) -> str:
        for _ in range(inserts):
            state = FOLLOWS[state]
        return state

    def best(i: int, state: str) -> int:
        """The least cost of the rows from i on, when what is kept so far ends in state."""
        if (i, state) in memo:
            return memo[i, state]
        options = []
        for k in range(3):
            here = after(state, k)
            if i == n:
                if here in ("", "a"):
                    options.append((INSERT * k, "I" * k, k))
                continue
            role, fault = rows[i]
            name = ROLES[role] if role < 3 else ""
            options.append((INSERT * k + DELETE + best(i + 1, here), "I" * k + "D", 3 * k))
            if FAULTS[fault] in ("sound", "truncated"):
                paid = INSERT * k + (TRUNCATED if FAULTS[fault] == "truncated" else 0)
                if name and (name == FOLLOWS[here] or name == "s" and not here):
                    options.append((paid + best(i + 1, name), "I" * k + "K", 3 * k + 1))
                if name != FOLLOWS[here]:
                    options.append((paid + RETYPE + best(i + 1, FOLLOWS[here]), "I" * k + "R", 3 * k + 2))
        cost, _, choice[4 * i + STATES.index(state)] = min(options)
        memo[i, state] = cost
        return cost

    cost = 0
    for top in [*range(n - n % STRIDE, 0, -STRIDE), 0]:
        known = {s: best(top, s) for s in (STATES if top else ("",))}
        memo.clear()
        memo.update({(top, s): c for s, c in known.items()})
        cost = known[""]
    audit, replay, state = [], [], ""
    for i in range(n):
        k, done = divmod(choice[4 * i + STATES.index(state)], 3)
        put = "".join(after(state, j) for j in range(1, k + 1))
        state = after(state, k)
        if done == 1:
            state = ROLES[rows[i][0]]
        elif done == 2:
            state = FOLLOWS[state]
        replay.append(chr(65 + 4 * PUT.index(put) + (state and done == 2 and DONE.index(state) or done)))
        audit.append("I" * k + "DKR"[done])
    k = choice[4 * n + STATES.index(state)]
    return "".join(audit) + "I" * k, cost, "".join(replay), "".join(after(state, j) for j in range(1, k + 1))


def _solved(batches: Iterator) -> Iterator:
    import pandas as pd

    names = ("signature", "audit", "cost", "replay", "tail", "blank", "duplicate", "truncated", "illegal")
    for batch in batches:
        found = []
        for signature in batch["signature"]:
            rows = [divmod(ord(c) - 97, 4) for c in signature]
            faults = [FAULTS[f] for _, f in rows]
            roles = [r for r, _ in rows]
            illegal = sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(roles, roles[1:]))
            found.append((signature, *solve(signature), *(faults.count(f) for f in FAULTS[1:]), illegal))
        yield pd.DataFrame(found, columns=names)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its stops, 3 repeats it, 4 makes it the user's. Nulls count as one space in that key, in role and in text."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("kind", kind).where("kind > 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("again")).drop("again")


def _letter(first: Column) -> Column:
    """The letter of a row: four times its role (s, u, a, another) and its first fault."""
    inner = F.rtrim("text", F.lit(SPACE))
    role = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, r in enumerate(ROLES) for x in (r, i))), F.substring("role", 1, 1)), F.lit(3))
    fault = F.when(inner == "", 1).when(~first, 2).when(F.right(inner, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
    return F.char(97 + 4 * role + fault)


def repair(conversations: DataFrame, scratch: Scratch) -> Repaired:
    """Audits of all conversations and their repaired rows.

    Rows are taken by turn (nulls first), of equal turns by role and text; nulls in role and text count as one space. Rows
    of a null conv_id are one conversation. A row's first fault counts: blank, duplicate (its role and text stand earlier in
    the conversation), truncated. A role counts by its initial; an empty one, or another than s, u, a, may stand nowhere.
    audits: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row a conversation. rows: conv_id, at,
    place, role, text, edit (K, R or I), in order by at and place. Repeated rows are duplicates; an empty table gives no rows.
    Nothing gathers a conversation: its rows are sorted over partitions, and its letters come together as strings.
    """
    small_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    coarse = [F.col("conv_id"), F.col("turn"), F.left("role", F.lit(16))]
    texts = in_order(rows, coarse, ["conv_id", "turn", "role", "text"], scratch)
    same = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    narrow = scratch.write(texts.select("conv_id", "turn", "at", same.alias("same"), _letter(F.lit(True)).alias("sound"), _letter(F.lit(False)).alias("again")))
    first = narrow.groupBy("conv_id", "same").agg(F.min("at").alias("first")).select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first")
    letters = narrow.join(first, narrow["conv_id"].eqNullSafe(first["c"]) & (F.col("same") == F.col("s"))).select(
        "conv_id", "at", part_of(F.col("at")).alias("part"), F.when(F.col("at") == F.col("first"), F.col("sound")).otherwise(F.col("again")).alias("letter")
    )
    in_part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "")
    pieces = scratch.write(letters.groupBy("conv_id", "part").agg(F.min("at").alias("start"), F.count("*").alias("n"), in_part.alias("piece")))
    all_pieces = F.array_sort(F.collect_list(F.struct("part", "piece", "start", "n")))
    whole = scratch.write(
        pieces.groupBy("conv_id").agg(all_pieces.alias("pieces")).select("conv_id", "pieces", F.array_join("pieces.piece", "").alias("signature"))
    )
    schema = "signature string, audit string, cost long, replay string, tail string, blank long, duplicate long, truncated long, illegal long"
    solved = scratch.write(whole.select("signature").distinct().mapInPandas(_solved, schema))
    joined = scratch.write(whole.join(solved, "signature"))

    turns = narrow.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")).withColumnRenamed("conv_id", "c")
    counted = ("blank", "duplicate", "truncated", "illegal", "cost", "audit")
    audits = joined.join(gaps, joined["conv_id"].eqNullSafe(gaps["c"])).select("conv_id", "gaps", *counted)

    ends = F.transform("pieces", lambda p, i: F.struct(p["start"].alias("start"), p["n"].alias("n"), F.aggregate(F.slice("pieces.n", 1, i), F.lit(0).cast("long"), lambda a, x: a + x).alias("skip")))
    by_piece = joined.select("replay", "tail", F.explode(ends).alias("p")).select(
        "p.start", F.when(F.col("p.skip") + F.col("p.n") == F.length("replay"), F.col("tail")).otherwise("").alias("tail"),
        F.substring("replay", F.col("p.skip").cast("int") + 1, F.col("p.n").cast("int")).alias("replay"),
    )
    steps = by_piece.select("start", "tail", F.length("replay").alias("n"), F.posexplode(F.split("replay", "")).alias("i", "step")).where("step <> ''")
    steps = steps.select((F.col("start") + F.col("i")).alias("at"), (F.ascii("step") - 65).alias("step"), F.when(F.col("i") + 1 == F.col("n"), F.col("tail")).otherwise("").alias("tail"))
    return Repaired(audits, _replayed(texts.select("conv_id", "at", "role", "text").join(steps, "at")))


def _replayed(rows: DataFrame) -> DataFrame:
    def line(role, text, edit: str) -> Column:
        return F.struct(role.alias("role"), text.alias("text"), F.lit(edit).alias("edit"))

    def put(roles: str) -> Column:
        return F.array(*(line(F.lit(NAMES[r]), F.lit(""), "I") for r in roles))

    none = F.array().cast("array<struct<role:string,text:string,edit:string>>")
    before = F.expr("NULL").cast("array<struct<role:string,text:string,edit:string>>")
    for i, roles in reversed([*enumerate(PUT)]):
        before = F.when(F.floor(F.col("step") / 4) == i, put(roles) if roles else none).otherwise(before)
    done = F.col("step") % 4
    own = F.when(done == 0, none).when(done == 1, F.array(line(F.col("role"), F.col("text"), "K")))
    for i in (2, 3):
        own = own.when(done == i, F.array(line(F.lit(NAMES[DONE[i]]), F.col("text"), "R")))
    behind = none
    for roles in PUT[1:]:
        behind = F.when(F.col("tail") == roles, put(roles)).otherwise(behind)
    return rows.select("conv_id", "at", F.posexplode(F.concat(before, own, behind)).alias("place", "line")).select("conv_id", "at", "place", "line.*")


def digests(conversations: DataFrame) -> DataFrame:
    """What the query returns: the conversations are damaged, repaired, and every original conv_id gets its counts, audit and
    the digest of its repaired rows. Conversations without rows after the damage: zeros, an empty audit, the empty digest."""
    scratch = Scratch(conversations.sparkSession)
    found = repair(damage(conversations), scratch)
    lines = found.rows.select("conv_id", "at", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    hashed = joined_sha256(lines, "conv_id", ["at", "place"], "line", "\n", "repaired_sha256").withColumnRenamed("conv_id", "h")
    audits = found.audits.withColumnRenamed("conv_id", "c")
    every = conversations.select("conv_id").distinct()
    out = every.join(audits, every["conv_id"].eqNullSafe(audits["c"]), "left").join(hashed, every["conv_id"].eqNullSafe(hashed["h"]), "left")
    counts = (F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
