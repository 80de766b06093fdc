"""The trie of conversations against a plain one in memory."""

import hashlib
import random
import re
import zlib

import pytest

from mailmill.llm import burst
from mailmill.llm.tables import ship

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    ship(spark)


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, len(whole) == d))
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = sum(below[k][0] for k in kids) or 1
        saved = sum(below[k][1] for k in kids) + (len(members[node]) - 1) * words
        below[node] = leaves, saved
        ends = ",".join(str(c) for c, ended in sorted(members[node]) if ended)
        parent = min(members[node[:-1]])[0] if node else None
        out.append((min(members[node])[0], len(node), parent, len(members[node]), len(kids), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def compare(spark, rows, most):
    whole = burst.rebuilt(burst.sequences(spark.createDataFrame(rows, SCHEMA)))
    got = burst.trie_digest(burst.build_trie(whole, most), whole)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("most", [3, 40, burst.CONTAINER])
def test_random_conversations(spark, most):
    rng = random.Random(most)
    rows = []
    for c in rng.sample(range(400), 150):
        for t in range(rng.randint(1, 6)):
            text = rng.choice(["a", "a b", "c\td  e", "", None, "x"])
            rows.append((c, rng.choice([t, t, None]) if t else None, rng.choice(["user", "assistant", None]), text))
    rows += [(None, 1, "user", "nobody")]
    compare(spark, rows, most)


def test_copies_near_copies_and_long_conversations(spark):
    rows = []
    for c in range(0, 300):
        # Families share a long beginning; some end in it.
        rows += [(c * 20, t, "user", f"same {t % 7}") for t in range(30 if c % 3 else 12)]
        if c % 4 == 0:
            rows += [(c * 20, 30, "assistant", f"own {c}")]
    rows += [(7, t, "user", f"turn {t}") for t in range(3000)]
    compare(spark, rows, 100)


def test_repeated_rows_are_repeated_turns(spark):
    compare(spark, [(40, 0, "user", "again")] * 500 + [(41, 0, "user", "again")] * 3, 50)


def test_conversations_without_turns_and_empty_table(spark):
    alone = next(c for c in range(21, 39) if zlib.crc32(str(c).encode()) % 4 > 0)
    compare(spark, [(alone, 0, "user", "taken away")], 10)
    compare(spark, [(alone, 0, "user", "taken away"), (45, 0, "a", "b"), (45, None, "a", "b")], 1)
    none = burst.rebuilt(burst.sequences(spark.createDataFrame([], SCHEMA)))
    assert burst.trie_digest(burst.build_trie(none), none).collect() == []


def test_clashing_columns(spark):
    odd = spark.createDataFrame([(1, 0, "user", "Hi.", "k", 3)], SCHEMA + ", key string, words int")
    whole = burst.sequences(odd)
    assert burst.build_trie(whole).count() == 2
