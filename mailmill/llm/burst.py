"""Conversation prefix trie: containers of suffixes that burst, the rest sorted and swept.

A conversation is the sequence of its turns; every distinct beginning is a node of one
trie. A container holds the suffixes of all conversations that pass a head node, equal
ones as one suffix with a count. A container of more than CONTAINER turns bursts: the
beginning that all its suffixes share (that of its least and its greatest suffix) becomes
a path of nodes, and the suffixes go on, by the id of their next turn, to containers of
their own. Each round bursts all oversized containers at once, over all tasks; the rounds
are as many as there are forks above the containers that rest. A container at rest is
sorted and swept into nodes by one call, with what lies below each of them. Sums below the
heads then come back round by round, one row for each burst container and each child.

A node is named by a chain of digests of its turns, so that rows of different containers
meet. Turn ids are digests of role and text; texts are never gathered. A conversation is
one row of turn ids, 32 characters and a count each: a few million turns at most.

Turns of one number stand by role, the first 32 characters of the text, then the id. Null
roles and texts are empty; null turns come first; rows without a conv_id are left out.
Repeated rows are repeated turns. An empty table gives no nodes. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmill.llm.rows import mapped, streamed
from mailmill.llm.tables import ship, stored
from mailmill.operators.bounded import broadcast_if_small

CONTAINER = 2048
"""Turns that a container holds at rest."""
SHARED_TURNS, FAMILY = 3, 20
ROOT = hashlib.md5(b"").hexdigest()
_SALTS = 32
_ENDS_IN_ROW = 10

def _md5(*parts: Column) -> Column:
    return F.md5(F.concat(*parts).cast("binary"))


def _key(head: str, turn_id: str) -> str:
    """The name of the child of `head` by a turn."""
    return hashlib.md5((head + turn_id).encode()).hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation as the ids of its turns in order, with their words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        "turn", role.alias("role"), F.substring(text, 1, 32).alias("head"),
        F.md5(F.to_json(F.struct(role.alias("r"), text.alias("t"))).cast("binary")).alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), turn.alias("turn"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def rebuilt(whole: DataFrame, family: int = FAMILY, most: int = SHARED_TURNS) -> DataFrame:
    """Each conversation with its first turns, up to `most` by a hash, taken from the first of its family."""
    whole = whole.withColumn("_h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int"))
    heads = whole.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    own = whole.withColumn("_base", F.col("conv_id") - F.col("conv_id") % family)
    both = own.join(heads, "_base", "left")
    first = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return both.select("conv_id", F.concat(first, rest).alias("turns"))


# Containers


def sweep(head: str, depth: int, head_first: int, suffixes: list) -> Iterator[tuple]:
    """The nodes of a container, and last what lies below its head, as a row of depth -1."""
    nodes: list[list] = []  # key, parent's place, depth, first, n, words, children
    path: list[int] = []
    before: list[str] = []
    heads_children = 0
    for ids, words, n, first in sorted(suffixes, key=itemgetter(0)):
        same = 0
        while same < len(path) and same < len(ids) and before[same] == ids[same]:
            same += 1
        del path[same:]
        for k in range(same, len(ids)):
            parent = path[-1] if path else -1
            name = _key(nodes[parent][0] if path else head, ids[k])
            nodes.append([name, parent, depth + k + 1, first, 0, words[k], 0])
            if path:
                nodes[parent][6] += 1
            else:
                heads_children += 1
            path.append(len(nodes) - 1)
        for place in path:
            nodes[place][3] = min(nodes[place][3], first)
            nodes[place][4] += n
        before = ids
    # Children stand behind their parents.
    leaves, saved = [0] * len(nodes), [0] * len(nodes)
    all_leaves = all_saved = 0
    for place in reversed(range(len(nodes))):
        name, parent, at, first, n, words, children = nodes[place]
        leaves[place] += children == 0
        saved[place] += (n - 1) * words
        if parent >= 0:
            leaves[parent] += leaves[place]
            saved[parent] += saved[place]
            parent_first = nodes[parent][3]
        else:
            all_leaves += leaves[place]
            all_saved += saved[place]
            parent_first = head_first
        yield name, first, at, parent_first, n, children, leaves[place], saved[place]
    yield head, head_first, -1, head_first, 0, heads_children, all_leaves, all_saved


def path_nodes(head, head_first, depth, ids, words, n, first, children, leaves, saved) -> Iterator[tuple]:
    """The nodes of the path of a burst container, given what lies below its end; last as in `sweep`."""
    names = [head]
    for turn_id in ids:
        names.append(_key(names[-1], turn_id))
    for k in range(len(ids), 0, -1):
        leaves, saved = leaves + (children == 0), saved + (n - 1) * words[k - 1]
        yield names[k], first, depth + k, first if k > 1 else head_first, n, children, leaves, saved
        children = 1
    yield head, head_first, -1, head_first, 0, children, leaves, saved


_NODE = "key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _below(rows: DataFrame) -> DataFrame:
    """What lies below each head, from the last rows of `sweep` and `path_nodes`."""
    return rows.where("depth = -1").select("key", "n_children", "n_leaves", "saved_tokens")


def _burst(suffixes: DataFrame, big: DataFrame) -> DataFrame:
    """The suffixes of the containers `big`, one turn past the path, with the child they went to."""
    at = big.select("head", "tail", F.size("path").alias("_past"))
    known = broadcast_if_small(at)
    if known is at:
        # Many containers, some of them hot: each is spread over several tasks.
        salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt")
        joined = suffixes.withColumn("_salt", F.pmod(F.hash("first"), F.lit(_SALTS))).join(
            at.select("*", salts), ["head", "_salt"])
    else:
        joined = suffixes.join(known, "head")
    turn = F.get("turns", F.col("_past"))
    return joined.where(F.size("turns") > F.col("_past")).select(
        _md5(F.col("tail"), turn["id"]).alias("key"), F.col("tail").alias("parent"),
        (F.col("depth") + F.col("_past") + 1).alias("depth"), turn["words"].alias("words"), "n", "first",
        F.slice("turns", F.col("_past") + 2, F.size("turns")).alias("turns"),
    )


def build_trie(whole: DataFrame, most: int = CONTAINER) -> DataFrame:
    """The nodes of the trie of (conv_id, turns), named by `key`."""
    ship(whole.sparkSession)
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))
    equal = whole.groupBy("turns").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    equal = stored(equal.select(F.lit(ROOT).alias("head"), F.lit(0).cast("long").alias("depth"), "turns", "n", "first"), "suffixes")
    root = equal.agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 0")
    root = stored(root.select(F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("words"), "n", "first"), "root")

    heads, suffixes = root.select("key", "first"), equal.where(F.size("turns") > 0)
    rounds, rest = [], None
    while True:
        sizes = suffixes.groupBy("head", "depth").agg(
            F.sum(F.size("turns")).alias("held"), F.min("turns").alias("low"), F.max("turns").alias("high"),
            F.sum("n").alias("n"), F.min("first").alias("first"))
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a["id"] == b["id"], F.lit(False))), False)
        big = sizes.where(F.col("held") > most).select(
            "head", "depth", "n", "first", F.slice("low", F.lit(1), F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int")).alias("path"))
        big = big.withColumn("tail", F.aggregate("path", F.col("head"), lambda k, t: _md5(k, t["id"])))
        big = stored(big, "burst")
        at_rest = suffixes
        done = big.isEmpty()
        if not done:
            names = broadcast_if_small(big.select("head"))
            at_rest = suffixes.join(names, "head", "left_anti")
        held = at_rest.join(heads.select(F.col("key").alias("head"), F.col("first").alias("head_first")), "head")
        packed = held.groupBy("head").agg(
            F.max("depth").alias("depth"), F.max("head_first").alias("head_first"),
            F.collect_list(F.struct(F.col("turns")["id"], F.col("turns")["words"], "n", "first")).alias("suffixes"))
        swept = mapped(packed, lambda head, depth, first, some: sweep(head, depth, first, [tuple(s.values()) for s in some]), _NODE)
        rest = swept if rest is None else rest.unionByName(swept)
        if done:
            break
        children = stored(_burst(suffixes, big), "children")
        kids = children.groupBy("key", "parent", "depth", "words").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        kids = stored(kids, "kids")
        rounds.append((big.join(heads.select(F.col("key").alias("head"), F.col("first").alias("head_first")), "head"), kids))
        heads = kids.select("key", "first")
        suffixes = children.where(F.size("turns") > 0).select(F.col("key").alias("head"), "depth", "turns", "n", "first")

    rest = stored(rest, "swept")
    below, found = _below(rest), [rest.where("depth >= 0")]
    own = (F.col("n") - 1) * F.col("words")
    sums = (F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (own + F.coalesce("saved_tokens", F.lit(0))).cast("long").alias("saved_tokens"))
    for big, kids in reversed(rounds):
        done_kids = stored(kids.join(below, "key", "left").select("key", "parent", "depth", "n", "first", *sums), "kids")
        at_tail = done_kids.groupBy(F.col("parent").alias("tail")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        of_tail = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
        paths = big.join(at_tail, "tail", "left").select(
            "head", "head_first", "depth", F.col("path")["id"].alias("ids"), F.col("path")["words"].alias("words"), "n", "first", *of_tail)
        paths = stored(mapped(paths, path_nodes, _NODE), "paths")
        # The parent of a child is the end of the path, or the head where the path is empty.
        parents = big.select(F.col("tail").alias("parent"), F.when(F.size("path") > 0, F.col("first")).otherwise(F.col("head_first")).alias("parent_conv_id"))
        found.append(paths.where("depth >= 0"))
        found.append(done_kids.join(broadcast_if_small(parents), "parent").select(
            "key", F.col("first").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
            "n_children", "n_leaves", "saved_tokens"))
        below = _below(paths).unionByName(_below(rest))
    top = root.join(below, "key", "left").select(
        "key", F.col("first").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), *sums)
    for some in found:
        top = top.unionByName(some)
    return top


def end_digests(whole: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end.

    Ids are joined in order in groups of 1,024 numbers first; SHA-256 then reads the
    groups of a node as a stream, because it takes its input in order.
    """
    ship(whole.sparkSession)
    ends = whole.select(F.aggregate("turns", F.lit(ROOT), lambda k, t: _md5(k, t["id"])).alias("key"), "conv_id")
    groups = ends.groupBy("key", F.shiftright("conv_id", _ENDS_IN_ROW).alias("group")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, own in groupby(rows, itemgetter(0)):
            digest = hashlib.sha256()
            for k, (_, _, ids) in enumerate(own):
                digest.update(("," * (k > 0) + ids).encode())
            yield key, digest.hexdigest()

    ordered = groups.repartition("key").sortWithinPartitions("key", "group")
    return streamed(ordered, rows_of, "key string, ends_sha256 string")


def trie_digest(nodes: DataFrame, whole: DataFrame) -> DataFrame:
    """The nodes with the digest of the conversations that end at each."""
    none = F.lit(hashlib.sha256().hexdigest())
    told = nodes.join(end_digests(whole), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
