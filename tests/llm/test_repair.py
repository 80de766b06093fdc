"""Conversation repair against a plain search over whole audits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from mailmill.llm import repair
from mailmill.llm.tables import ship

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain(rows):
    """The contract's row of one conversation, its rows given after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        marks = WORD.findall(text)
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
        faults.append(fault)
        seen.add((role, text))
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    ways = {"": (0, "", ())}

    def offer(to, state, way):
        if state not in to or way < to[state]:
            to[state] = way

    def with_inserts(ways):
        found = {}
        for state, (cost, audit, lines) in ways.items():
            for _ in range(3):
                offer(found, state, (cost, audit, lines))
                state = due[state]
                cost, audit, lines = cost + 3, audit + "I", lines + (name[state] + ":",)
        return found

    for (_, _, role, text), fault in zip(rows, faults):
        found = {}
        for state, (cost, audit, lines) in with_inserts(ways).items():
            offer(found, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            to = due[state]
            offer(found, to, (cost + 3 + more, audit + "R", lines + (f"{name[to]}:{text}",)))
            if role[:1] == to or (role[:1] == "s" and state == ""):
                offer(found, role[:1], (cost + more, audit + "K", lines + (f"{role}:{text}",)))
        ways = found
    ends = [w for s, w in with_inserts(ways).items() if s in ("", "a")]
    cost, audit, lines = min(ends)
    turns = sorted({r[1] for r in rows if r[1] is not None})
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return {
        "gaps": turns[-1] - turns[0] + 1 - len(turns) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": illegal, "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def compare(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = repair.with_untouched(repair.repair_digest(repair.repair(repair.damage(df))), df).collect()
    by = {}
    for r in damaged(rows):
        by.setdefault(r[0], []).append(r)
    want = {c: plain(by.get(c, [])) for c in {r[0] for r in rows}}
    assert {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in got} == want
    assert len(got) == len(want)


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    ship(spark)


def test_crossings_are_the_least_audit_of_all():
    """Costs and letters against every sequence of edits, over all kinds of turns."""
    rng = random.Random(5)
    for _ in range(400):
        codes = [rng.randrange(16) for _ in range(rng.randint(0, 7))]
        rows = [(0, k, ["s", "u", "a", "-"][c // 4], "x.") for k, c in enumerate(codes)]
        ways = {0: (0, "")}
        for c in codes:
            new = {}
            for p, (cost, letters) in ways.items():
                for (a, q), (more, step) in repair.STEPS[c].items():
                    if a == p and (cost + more, letters + step) < new.get(q, (repair.FAR, "")):
                        new[q] = (cost + more, letters + step)
            ways = new
        tail = {0: "", 1: "II", 2: "I", 3: ""}
        want = min((cost + 3 * len(tail[p]), letters + tail[p]) for p, (cost, letters) in ways.items())
        tables = [repair.TABLES[c] for c in codes]
        states = repair.crossings([*tables, repair.END], 0, 0)[:-1]
        letters, before = "", 0
        for c, then in zip(codes, states):
            letters, before = letters + repair.STEPS[c][before, then][1], then
        assert letters + tail[before] == want[1], rows
        # Halves folded first cross at the same states.
        cut = len(tables) // 2
        halves = [repair.folded(tables[:cut]), repair.folded(tables[cut:])]
        ends = repair.crossings([*halves, repair.END], 0, 0)
        assert ends[1] == before and ends[0] == (states[cut - 1] if cut else 0)


def test_small_and_odd_conversations(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = rng.choice(["Yes.", "No", "", None, " \t", "What? ", "One. Two", "é!\n", "same."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows = list({(c, t, r): (c, t, r, x) for c, t, r, x in rows}.values())
    compare(spark, rows)


def test_null_ids_repeated_rows_and_ties(spark):
    rows = [(None, 0, "user", "Hi."), (None, None, "assistant", "Well."), (3, 1, "user", "a."), (3, 1, "user", "b.")]
    rows += [(7, 0, "user", "Again.")] * 700 + [(7, 1, "assistant", "Yes.")] + [(8, k % 3, "assistant", "Yes.") for k in range(300)]
    compare(spark, rows)


def test_a_long_conversation_spans_pieces_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 16)
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), f"Turn {t}" + rng.choice([".", "", "!"])) for t in range(1500)]
    rows += [(6, t, ["user", "assistant"][t % 2], "long " * 40_000 + f"{t}.") for t in range(4)]
    compare(spark, rows)


def test_legal_conversations_stay_as_they_are(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello.")]
    edits = repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("place", "step").collect()
    assert [(e.edit, e.role, e.text) for e in edits] == [("K", r[2], r[3]) for r in rows]


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.with_untouched(repair.repair_digest(repair.repair(none)), none).collect() == []
    odd = spark.createDataFrame([(1, 0, "user", "Hi.", 1, "x", "y")], SCHEMA + ", place int, edit string, said string")
    assert [(e.edit, e.text) for e in repair.repair(odd).orderBy("step").collect()] == [("K", "Hi."), ("I", "")]
