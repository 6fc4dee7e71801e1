"""Conversation repair against enumeration of all edits and against SQL."""

import hashlib
import re
import time
import zlib
from array import array
from itertools import groupby

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from attrition.llm import conversation_repair as R
from attrition.llm.queries import OP11_SQL, op11_conversation_repair

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SOUND = re.compile("(s?(ua)+)?")


def every_edit(turns, inserts):
    """All edit lists with at most so many insertions: (cost, letters, role initials)."""
    if not turns:
        yield 0, "", ""
    else:
        role, demand = "?sua"[turns[0] % 4], turns[0] // 4
        for cost, letters, roles in every_edit(turns[1:], inserts):
            yield cost + 4, "D" + letters, roles
            if demand != R.DELETE:
                extra = 3 * (demand == R.TRUNCATED)
                yield cost + extra, "K" + letters, role + roles
                for new in "ua":
                    yield cost + extra + 3, "R" + letters, new + roles
    if inserts:
        for cost, letters, roles in every_edit(turns, inserts - 1):
            for new in "ua":
                yield cost + 3, "I" + letters, new + roles


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 11), max_size=4))
def test_search_finds_the_cheapest_and_least(turns):
    want = min(x[:2] for x in every_edit(bytes(turns), 3) if SOUND.fullmatch(x[2]))
    assert R.search(bytes(turns)) == want
    assert R.search(bytes(turns), array("i", [0]) * (4 * len(turns) + 4)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 11), max_size=9))
def test_weak_bounds_give_the_same_edits(turns):
    assert R.search(bytes(turns), array("i", [0]) * (4 * len(turns) + 4)) == R.search(bytes(turns))


def test_long_conversations_take_linear_time():
    turns = bytes((k * 7 + k // 3) % 12 for k in range(60000))
    start = time.time()
    cost, audit = R.search(turns)
    assert time.time() - start < 10 and audit.count("I") + len(turns) == len(audit) and cost > 0


def brute(rows):
    """The report from its definition; letters and cost by a plain table over (turn, last role)."""
    out = []
    for conv in {r[0] for r in rows}:
        hurt = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                hurt += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in hurt:
            solid = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {"": (0, "", [])}
        def inserted(states):
            for _ in range(3):
                for last, (cost, letters, lines) in list(states.items()):
                    new = "a" if last == "u" else "u"
                    option = (cost + 3, letters + "I", [*lines, {"u": "user:", "a": "assistant:"}[new]])
                    states[new] = min(states.get(new, option), option)
            return states
        best = inserted(best)
        for (_, role, text), fault in zip(hurt, faults, strict=True):
            options = []
            for last, (cost, letters, lines) in best.items():
                options.append((last, (cost + 4, letters + "D", lines)))
                if fault not in ("blank", "duplicate"):
                    extra, new = 3 * (fault == "truncated"), "a" if last == "u" else "u"
                    options.append((new, (cost + 3 + extra, letters + "R", [*lines, {"u": "user:", "a": "assistant:"}[new] + text])))
                    if role[:1] == new or (last == "" and role[:1] == "s"):
                        options.append((role[:1], (cost + extra, letters + "K", [*lines, f"{role}:{text}"])))
            best = {}
            for last, option in options:
                best[last] = min(best.get(last, option), option)
            best = inserted(best)
        cost, audit, lines = min(best[x] for x in ("", "a") if x in best)
        turns = [t for t, _, _ in hurt if t is not None]
        initials = [r[:1] for _, r, _ in hurt]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def report(found):
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)


ODD = ([(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 5, "user", None)]
       + [(2, None, None, "x"), (2, None, "user", "no end"), (2, 3, "", "?"), (2, 3, "assistant", "Two at one turn."), (2, 3, "assistant", "A second.")]
       + [(None, None, None, None), (None, 4, "user", "Null id."), (None, 5, "assistant", "Yes. \n\t"), (3, 1, "user", "\n \x0b"), (4, -9, "tool", "é。"), (4, 9, "user", "a\x85")]
       + [(5, k, "user" if k % 2 else "assistant", "same text") for k in range(30)] + [(6, k, "user", f"Turn {k}.") for k in range(40)]
       + [(7, 1, "user", "Long. " * 50000), (7, 2, "assistant", "word " * 60000)])


def made(spark, rows, tmp_path, parts=3):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, kind string").repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def test_odd_conversations_with_and_without_second_reading(spark, tmp_path):
    want = brute(ODD)
    table = made(spark, ODD, tmp_path)
    assert report(op11_conversation_repair(spark, str(tmp_path))) == want
    for hold in (0, 60, 1 << 19):
        assert report(R.repair_report(R.damaged(table), hold)) == want
        turns = sorted(((r["conv_id"], r["position"], r["edit"], r["role"], r["text"]) for r in R.repaired_turns(R.damaged(table), hold).collect()), key=str)
        turns.sort(key=lambda r: (str(r[0]), r[1]))
        shas = {conv: hashlib.sha256("\n".join(f"{r[3]}:{r[4]}" for r in of).encode()).hexdigest() for conv, of in groupby(turns, key=lambda r: r[0])}
        assert shas == {r[0]: r[8] for r in want if r[8] != hashlib.sha256(b"").hexdigest()}


def test_empty_table(spark, tmp_path):
    assert report(R.repair_report(R.damaged(made(spark, [], tmp_path, 1)))) == []


def test_query_equals_sql(spark, tmp_path):
    base = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    rows = base + [(None if r[0] is None else r[0] + 1000, r[1] * 3, r[2], r[3]) for r in base if r[1] % 3] + ODD[:-2]
    made(spark, rows, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP11_SQL})").fetchall(), key=str)
    assert report(op11_conversation_repair(spark, str(tmp_path))) == want == brute(rows)
