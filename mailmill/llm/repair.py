"""Conversation structure repair: the cheapest edits by divide and conquer in linear space.

A repaired conversation is empty, or an optional system turn followed by pairs of a
user and an assistant turn. A turn may be kept (0), given the role that is due (3),
deleted (4, a must for blank turns and repeats), and empty turns may be put in (3 each);
a truncated turn that stays costs 3 more. Of the cheapest edits those are taken whose
letters D, I, K, R come first in ASCII order.

What may come next depends on one of four states: nothing yet, after the system turn,
after a user turn, after an assistant turn. So a run of turns is a table of 4 x 4 costs
from state to state, and tables of runs that follow each other combine. Reconstruction
is Hirschberg's: a cost vector of four states runs forward to the middle and one runs
back to it; the best sum is where they cross; both halves are then solved alone, with
their ends known. Each forward cost carries the rank of its letters among the four, which
decides between crossings of one cost. That suffices, because letters that end in the
letter of the same turn are never a beginning of one another.

In Spark the halves are pieces: turns are put in order over all tasks by a range of
(conv_id, turn, ...), cut into pieces of at most PIECE turns, and each piece becomes its
table. Tables meet per task of that order and then per conversation, the crossings come
back the same way, and every piece is reconstructed alone. Texts take no part in it; only
those of turns that stay are fetched in the end. A conversation of any length is thus
spread over many tasks.

Rows of one turn stand by role, then by the first 32 characters of the text, then by
its digest. Repeated rows are one row with a count. Null roles and texts are one space;
null turns come first; a null conv_id is a conversation of its own. A role that begins
with none of s, u, a cannot be kept. No rows give no edits. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmill.llm.rows import mapped, named_type, streamed
from mailmill.llm.tables import ship, stored

PIECE = 1024
DELETE, INSERT, KEEP, REROLE = "DIKR"
COSTS = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED_COST = 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60

Table = tuple[tuple[int, int], ...]
"""Cost and order from state p to q at 4 p + q; the order is that of the letters from one p."""

_DUE = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_BLANK, _DUPLICATE, _CUT = "blank", "duplicate", "truncated"
_FAULTS = ("", _CUT, _BLANK, _DUPLICATE)
_SPACES = " \t\n\x0b\x0c\r"


# Costs and crossings, without Spark


def _steps(initial: str, fault: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(state, next state) -> (cost, letters) of empty turns put in and then one turn."""
    found: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(p: int, q: int, cost: int, letters: str) -> None:
        found[p, q] = min(found.get((p, q), (FAR, "")), (cost, letters))

    stays = 0 if fault != _CUT else TRUNCATED_COST
    for p in range(4):
        at, cost, letters = p, 0, ""
        for _ in range(3):
            offer(p, at, cost + COSTS[DELETE], letters + DELETE)
            if fault not in (_BLANK, _DUPLICATE):
                due = _DUE[at]
                offer(p, due, cost + COSTS[REROLE] + stays, letters + REROLE)
                if initial == ("u" if due == USER else "a"):
                    offer(p, due, cost + stays, letters + KEEP)
                if initial == "s" and at == NOTHING:
                    offer(p, SYSTEM, cost + stays, letters + KEEP)
            at, cost, letters = _DUE[at], cost + COSTS[INSERT], letters + INSERT
    return found


def _table(steps: dict[tuple[int, int], tuple[int, str]]) -> Table:
    cells = []
    for p in range(4):
        letters = sorted(steps[p, q][1] for q in range(4) if (p, q) in steps)
        for q in range(4):
            cost, own = steps.get((p, q), (FAR, ""))
            cells.append((cost, letters.index(own) if cost < FAR else 9))
    return tuple(cells)


_INITIALS = "sua-"
STEPS = [_steps(i, f) for i in _INITIALS for f in _FAULTS]
TABLES = [_table(s) for s in STEPS]
_TAIL = {NOTHING: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
"""Empty turns that end a conversation in each state."""
END: Table = tuple((_TAIL[p] * COSTS[INSERT], 0) if q == 0 else (FAR, 9) for p in range(4) for q in range(4))


def repeated(table: Table, more: int) -> Table:
    """The table of a turn that must go, and of `more` repeats of it before that."""
    return tuple((c + COSTS[DELETE] * more if c < FAR else FAR, r) for c, r in table)


Vector = tuple[tuple[int, int], ...]


def _from(state: int) -> Vector:
    return tuple((0, 0) if q == state else (FAR, 9) for q in range(4))


@lru_cache(maxsize=1 << 15)
def _ahead(vector: Vector, table: Table) -> tuple[Vector, int]:
    """Costs and ranks one table further, the least cost taken off and given beside."""
    best = []
    for q in range(4):
        ways = [
            (vector[p][0] + table[4 * p + q][0], vector[p][1], table[4 * p + q][1])
            for p in range(4) if vector[p][0] < FAR and table[4 * p + q][0] < FAR
        ]
        best.append(min(ways, default=(FAR, 9, 9)))
    least = min(b[0] for b in best)
    ranks = sorted(b[1:] for b in best)
    return tuple((b[0] - least, ranks.index(b[1:])) if b[0] < FAR else (FAR, 9) for b in best), least


@lru_cache(maxsize=1 << 15)
def _back(costs: tuple[int, ...], table: Table) -> tuple[int, ...]:
    new = [min(min(table[4 * p + q][0] + costs[q] for q in range(4)), FAR) for p in range(4)]
    least = min(new)
    return tuple(c - least if c < FAR else FAR for c in new)


def _forward(tables: Iterable[Table], state: int) -> tuple[Vector, int]:
    vector, base = _from(state), 0
    for table in tables:
        vector, least = _ahead(vector, table)
        base += least
    return vector, base


def folded(tables: list[Table]) -> Table:
    """The table of a run of tables."""
    cells = []
    for p in range(4):
        vector, base = _forward(tables, p)
        cells += [(base + c, r) if c < FAR else (FAR, 9) for c, r in vector]
    return tuple(cells)


def crossings(tables: list[Table], entry: int, leave: int) -> list[int]:
    """The state after each table, on the cheapest way of the least letters from `entry` to `leave`."""
    states = [leave] * len(tables)
    spans = [(0, len(tables), entry, leave)]
    while spans:
        low, high, first, last = spans.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        there, _ = _forward(tables[low:middle], first)
        back = tuple(0 if q == last else FAR for q in range(4))
        for table in reversed(tables[middle:high]):
            back = _back(back, table)
        _, _, cross = min((there[q][0] + back[q], there[q][1], q) for q in range(4))
        states[middle - 1] = cross
        spans += [(low, middle, first, cross), (middle, high, cross, last)]
    return states


def _put_in(state: int, count: int) -> tuple[list[str], int]:
    roles = []
    for _ in range(count):
        state = _DUE[state]
        roles.append(_ROLE[state])
    return roles, state


# In Spark


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with known faults, chosen by crc32 of `conv_id:turn`: conv_id, turn, role, text."""
    space = F.lit(" ")
    parts = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    name = F.concat_ws(":", *parts)
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    dealt = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_copies"),
    )
    return dealt.select("*", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*dealt.columns[:4])


def _digest(*columns: str) -> Column:
    """Tells apart rows that differ in any of the columns, null from all else."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256))


def _flat(table: Table) -> list[int]:
    return [x for cell in table for x in cell]


def _cells(flat: Iterable[int]) -> Table:
    flat = [int(x) for x in flat]
    return tuple(zip(flat[::2], flat[1::2]))


def _expanded(ats, codes, times) -> list[tuple[int, int, int]]:
    """(place, code, repeats before it) of each turn of a piece, repeats as a turn of their own.

    A place named again with code -1 is where its role and text stand first.
    """
    first = {a for a, c in zip(ats, codes) if c < 0}
    items = []
    for at, code, count in zip(ats, codes, times):
        if code < 0:
            continue
        again = code // 4 * 4 + _FAULTS.index(_DUPLICATE)
        gone = _FAULTS[code % 4] == _BLANK
        items.append((at, code if gone or at in first else again, 0))
        if count > 1:
            items.append((at, code if gone else again, count - 2))
    return items


def _item_tables(items: list[tuple[int, int, int]]) -> list[Table]:
    return [repeated(TABLES[code], more) if more else TABLES[code] for _, code, more in items]


def _piece_rows(piece, ats, codes, times):
    yield piece, _flat(folded(_item_tables(_expanded(ats, codes, times))))


def _fold_rows(run, pieces, tables):
    yield run, _flat(folded([_cells(t) for t in tables]))


def _cross_conversation(runs, tables):
    states = crossings([*map(_cells, tables), END], NOTHING, 0)[:-1]
    for k, run in enumerate(runs):
        yield run, states[k - 1] if k else NOTHING, states[k], k == len(runs) - 1


def _cross_run(pieces, tables, entry, leave, last):
    states = crossings([_cells(t) for t in tables], entry, leave)
    for k, piece in enumerate(pieces):
        yield piece, states[k - 1] if k else entry, states[k], last and k == len(pieces) - 1


def _edit_rows(ats, codes, times, entry, leave, last):
    items = _expanded(ats, codes, times)
    state, step = entry, 0
    for (at, code, more), then in zip(items, crossings(_item_tables(items), entry, leave)):
        fault, letters = _FAULTS[code % 4], STEPS[code][state, then][1]
        if more:
            yield at, step, DELETE, more, fault, None
            step += 1
        roles, due = _put_in(state, len(letters) - 1)
        for role in roles:
            yield at, step, INSERT, 1, "", role
            step += 1
        yield at, step, letters[-1], 1, fault, _ROLE[_DUE[due]] if letters[-1] == REROLE else None
        state, step = then, step + 1
    if last:
        for role in _put_in(state, _TAIL[state])[0]:
            yield at, step, INSERT, 1, "", role
            step += 1


def repair(turns: DataFrame) -> DataFrame:
    """The edits of every conversation, those of turns that go included.

    `place` and `step` give their order in a conversation. `edit` is K, R, D or I;
    `times` rows like it stand there (repeats that go). `fault` is blank, duplicate,
    truncated or empty; `turn` and `old_role` are those of the turn as it came, null where
    one was put in; `role` and `text` are those of the repaired turn, null where it goes.
    """
    ship(turns.sparkSession)
    space = F.lit(" ")
    came = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    came = came.withColumn("said", _digest("role", "text"))
    bare = F.rtrim("text", F.lit(_SPACES))
    fault = F.when(bare == "", _FAULTS.index(_BLANK)).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(_FAULTS.index(_CUT))
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    narrow = came.select("conv_id", "turn", "role", F.substring("text", 1, 32).alias("head"), "said",
                         (initial * 4 + fault).cast("int").alias("code"))
    counted = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("count"))
    order = ["conv_id", "turn", "role", "head", "said"]
    placed = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.select("conv_id", "turn", "role", "said", "code", "count",
                                  F.monotonically_increasing_id().alias("place")), "turns")

    # A place is the number of its task of the order, and its number there.
    run, piece = F.shiftright("place", 33), F.shiftright("place", PIECE.bit_length() - 1)
    firsts = placed.groupBy("conv_id", "said").agg(F.min("place").alias("place"))
    marks = firsts.select("conv_id", "place", F.lit(-1).alias("code"), F.lit(0).cast("long").alias("count"))
    items = placed.select("conv_id", "place", "code", "count").unionByName(marks)
    items = items.select("conv_id", run.alias("_run"), piece.alias("_piece"), F.struct("place", "code", "count").alias("item"))
    pieces = items.groupBy("conv_id", "_run", "_piece").agg(F.array_sort(F.collect_list("item")).alias("items"))
    pieces = stored(pieces.select(
        "conv_id", "_run", F.col("items")[0]["place"].alias("piece"), F.col("items")["place"].alias("places"),
        F.col("items")["code"].alias("codes"), F.col("items")["count"].alias("counts")), "pieces")

    # Up: the table of each piece, of each run of pieces, and where the runs of a conversation cross.
    table = "table array<long>"
    tables = mapped(pieces.select("piece", "places", "codes", "counts"), _piece_rows, f"piece long, {table}")
    in_run = pieces.select("conv_id", "_run", "piece").join(tables, "piece")
    runs = in_run.groupBy("conv_id", "_run").agg(F.array_sort(F.collect_list(F.struct("piece", "table"))).alias("of"))
    runs = stored(runs.select("conv_id", F.col("of")[0]["piece"].alias("run"), F.col("of")["piece"].alias("pieces"),
                              F.col("of")["table"].alias("tables")), "runs")
    run_tables = mapped(runs.select("run", "pieces", "tables"), _fold_rows, f"run long, {table}")
    whole = runs.select("conv_id", "run").join(run_tables, "run").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("run", "table"))).alias("of"))
    ends = "entry int, leave int, last boolean"
    crossed = mapped(whole.select(F.col("of")["run"].alias("runs"), F.col("of")["table"].alias("tables")), _cross_conversation, f"run long, {ends}")

    # Down: where the pieces of a run cross, and the edits of each piece.
    crossed = mapped(runs.select("run", "pieces", "tables").join(crossed, "run").drop("run"), _cross_run, f"piece long, {ends}")
    solved = pieces.join(crossed, "piece").select("places", "codes", "counts", "entry", "leave", "last")
    edits = mapped(solved, _edit_rows, "place long, step int, edit string, times long, fault string, new_role string")

    own = placed.select("place", "conv_id", "turn", "role", "said", _digest("conv_id", "turn", "said").alias("row"))
    edits = edits.join(own, "place")
    put_in, stays = F.col("edit") == INSERT, F.col("edit").isin(KEEP, REROLE)
    edits = edits.select(
        "conv_id", "place", "step", "edit", "times", "fault", F.when(~put_in, F.col("turn")).alias("turn"),
        F.when(~put_in, F.col("role")).alias("old_role"),
        F.when(put_in | stays, F.coalesce("new_role", "role")).alias("role"), F.when(stays, F.col("row")).alias("row"),
    )
    texts = came.groupBy(_digest("conv_id", "turn", "said").alias("row")).agg(F.first("text").alias("text"))
    kept = edits.where("row is not null").join(texts, "row").drop("row")
    gone = edits.where("row is null").select(*kept.columns[:-1], F.when(put_in, F.lit("")).alias("text"))
    return kept.unionByName(gone)


_LEGAL = ("su", "ua", "au")


class _Digest:
    """What is told of one conversation, from its edits in order."""

    def __init__(self, conv_id):
        self.conv_id, self.letters, self.hash, self.lines = conv_id, [], hashlib.sha256(), 0
        self.faults = dict.fromkeys(_FAULTS, 0)
        self.cost = self.illegal = self.turns = 0
        self.first = self.turn = self.before = None

    def take(self, edit, times, fault, turn, old_role, role, text) -> None:
        self.letters.append(edit * times)
        self.cost += COSTS[edit] * times + TRUNCATED_COST * (fault == _CUT and edit != DELETE)
        self.faults[fault] += times
        if edit != INSERT:
            if self.before is not None:
                self.illegal += self.before[:1] + old_role[:1] not in _LEGAL
            self.illegal += times - 1
            self.before = old_role
            if turn is not None and turn != self.turn:
                self.turns += 1
                self.first = turn if self.first is None else self.first
                self.turn = turn
        if edit != DELETE:
            self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode("utf-8"))
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.turn is None else self.turn - self.first + 1 - self.turns
        counts = (self.faults[f] for f in (_BLANK, _DUPLICATE, _CUT))
        return (self.conv_id, gaps, *counts, self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest())


def repair_digest(edits: DataFrame) -> DataFrame:
    """One row per conversation that has turns: its gaps, faults, cost, letters, digest of the repair.

    SHA-256 reads its input in order, so the repaired lines of one conversation pass
    through one task, sorted and as a stream: that task holds a batch of rows and the letters.
    """
    schema = named_type(edits, "conv_id") + ", gaps long, blank long, duplicate long, truncated long, illegal long"
    schema += ", cost long, audit string, repaired_sha256 string"

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, own in groupby(rows, itemgetter(0)):
            one = _Digest(conv_id)
            for _, _, _, *edit in own:
                one.take(*edit)
            yield one.row()

    rows = edits.select("conv_id", "place", "step", "edit", "times", "fault", "turn", "old_role", "role", "text")
    return streamed(rows.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step"), rows_of, schema)


def with_untouched(digest: DataFrame, conversations: DataFrame) -> DataFrame:
    """The digest with a row of zeros for each conversation of which no turn is left."""
    ids = conversations.select("conv_id").distinct()
    both = ids.alias("i").join(digest.alias("d"), F.col("i.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    names = [c for c in digest.columns if c != "conv_id"]
    return both.select("i.conv_id", *[F.coalesce(F.col(f"d.{c}"), F.lit(empty.get(c, 0))).alias(c) for c in names])
