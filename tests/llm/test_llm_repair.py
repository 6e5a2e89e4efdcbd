"""Conversation repair against a plain search over all edits, in one chunk and in many."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from conftest import SMALL
from llm import repair as R

CHATS = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def best(rows):
    """(cost, audit, repaired rows) by the least (cost, audit) for every number of rows read and every last initial."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    seen, codes = set(), []
    for role, text in rows:
        visible = text.strip(BLANKS)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        codes.append(fault)

    def with_inserts(found):
        out = dict(found)
        for _ in range(4):
            for last, (cost, audit, kept) in list(out.items()):
                for to in legal[last].replace("s", ""):
                    new = cost + 5, audit + "I", kept + [(name[to], "")]
                    if to not in out or new[:2] < out[to][:2]:
                        out[to] = new
        return out

    found = with_inserts({"": (0, "", [])})
    for (role, text), fault in zip(rows, codes):
        after = {}

        def offer(last, cost, audit, kept):
            if last not in after or (cost, audit) < after[last][:2]:
                after[last] = cost, audit, kept

        for last, (cost, audit, kept) in found.items():
            offer(last, cost + 2, audit + "D", kept)
            if fault in ("", "truncated"):
                extra = 5 * (fault == "truncated")
                if role[:1] and role[:1] in legal[last]:
                    offer(role[:1], cost + extra, audit + "K", [*kept, (role, text)])
                for to in legal[last].replace("s", ""):
                    offer(to, cost + extra + 1, audit + "R", [*kept, (name[to], text)])
        found = with_inserts(after)
    cost, audit, kept = min((found[s] for s in ("", "a") if s in found), key=lambda v: v[:2])
    return cost, audit, kept, codes


def expected(turns):
    """The report of one conversation's (turn, role, text) rows in order."""
    rows = [(r, t) for _, r, t in turns]
    cost, audit, kept, codes = best(rows)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    faults = [codes.count(f) for f in ("blank", "duplicate", "truncated")]
    return gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def compare(spark, rows, **settings):
    """The report of Spark for (conv_id, turn, role, text) rows is that of the plain search."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    pieces = R.repair(spark.createDataFrame(rows, CHATS).repartition(5), **settings)
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in R.report(pieces).collect()}
    assert got == {c: expected(in_order(v)) for c, v in by.items()}
    return pieces


def random_rows(rng, conv, n, roles=("user", "assistant", "system", "tool", "user", "assistant", "", "uncle")):
    words = ["Yes.", "No!", "Why?", "and then", " ", "", "ok.\n", "cut off ", "日本。", "A.", "B.", "C."]
    out, place = [], 0
    for _ in range(n):
        place += rng.choice([0, 1, 1, 1, 1, 3])
        # one in two turns follows the pattern, so that all edits occur
        role = ("user", "assistant")[place % 2] if rng.random() < 0.6 else rng.choice(roles)
        text = rng.choice(words) if rng.random() < 0.4 else f"Sentence {rng.randrange(40)}{rng.choice('.!?. ')}"
        out.append((conv, None if rng.random() < 0.03 else place, role, text))
    return out


def test_short_conversations(spark):
    rng = random.Random(1)
    rows = [r for c in range(150) for r in random_rows(rng, c, rng.randrange(1, 9))]
    rows += [(None, 1, "user", "No id."), (None, 2, None, None), (900, None, "assistant", "A."), (900, None, "assistant", "A."), (901, 5, "system", "S.")]
    rows += [(902, i, "user", "Same.") for i in range(30)] + [(903, 1, "user", "Same.")] * 30
    pieces = compare(spark, rows)
    assert pieces.filter("not whole").count() == 0


@pytest.mark.parametrize("rows_per_chunk", [1, 3, 7])
def test_conversations_over_many_chunks(spark, rows_per_chunk):
    """Chunks of a few rows: duplicates, pairs of roles, turns and vectors must all pass from chunk to chunk."""
    rng = random.Random(rows_per_chunk)
    rows = [r for c in range(12) for r in random_rows(rng, c, rng.choice([2, 9, 40]))]
    rows += [(50, i, "tool", f"Odd {i}.") for i in range(41)]  # parity is never forgotten: the passes do not end this one
    rows += [(51, i, "user", "Again.") for i in range(30)] + [(51, 40, "assistant", "End.")]
    pieces = compare(spark, rows, chunk_rows=rows_per_chunk)
    assert pieces.filter("not whole").count() > 10
    kept = R.repaired_rows(pieces).filter("conv_id = 50").orderBy("chunk", "place").collect()
    assert [r["role"] for r in kept] == ["user", "assistant"] * 20


def test_passes_meet_what_a_whole_run_finds():
    rng = random.Random(5)
    for _ in range(300):
        codes = [(rng.choice("sua-"), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(1, 30))]
        old, new = rng.sample([(0, 0, 0, 0), R.END, (0, 2, 5, 0), (3, 3, 0, 1)], 2)
        front = R.run_back(codes, old)[0][0]
        got, met = R.fix_up(codes, old, front, new)
        assert got == R.run_back(codes, new)[0][0]
        assert met == (got == front)


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], CHATS)
    assert R.report(R.repair(none)).count() == 0 and R.damage(none).count() == 0
    one = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "assistant", "word " * 100_000 + ".")], CHATS)
    wide = one.withColumns({c: F.lit("x") for c in ("conv", "chunk", "copies", "part", "seen", "next", "audit", "__fault", "__copy")})
    rows = R.report(R.repair(wide)).collect()
    assert [(r["audit"], r["cost"]) for r in rows] == [("KK", 0)]
    assert R.damage(wide).columns == ["conv_id", "turn", "role", "text"]


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if fault == 0:
            continue
        if fault == 1:
            x = ""
        if fault == 2:
            x = x.replace(".", "").replace("!", "").replace("?", "")
        if fault == 4:
            r = "user"
        out += [(c, t, r, x)] * (2 if fault == 3 else 1)
    return out


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, *range(40)) for r, x in [("assistant", "A. B! C?"), (None, None)]]
    got = [tuple(r) for r in R.damage(spark.createDataFrame(rows, CHATS)).collect()]
    assert sorted(got, key=repr) == sorted(damaged(rows), key=repr)


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = defaultdict(list)
    for c, t, r, x in damaged(rows):
        by[c].append((t, r, x))
    want = {c: expected(in_order(by[c])) for c in {r[0] for r in rows}}
    got = entry_point.queries()["op12_conversation_repair"](spark, SMALL).collect()
    assert {r["conv_id"]: tuple(r[c] for c in NAMES) for r in got} == want
