"""N-gram Jaccard join by chosen paths.

    classes   texts with the same bytes are one class; its smallest id stands for it
    sketches  COORDINATES smallest hashes of each class's word shingles
    paths     a run starts with all classes in one bucket. Each bucket chooses
              coordinates by a hash of its path, on average 1 / similarity of
              them and never fewer than that cut to a whole number, and each class
              goes on to the bucket of the value it has there. The first buckets of
              all runs choose different ones. Buckets of SMALL classes or fewer are compared at once, the
              others are split again, up to DEEPEST times, but for those whose members
              all agree with one of them
    compared  small buckets give all their pairs, larger ones the pairs with two of
              their members; pairs whose sketches are too far apart are left
              out, the others are compared by their exact shingle sets
    components of the links, by rounds of smallest neighbours; larger buckets
              that hold more than one are compared whole, block against block
    links     counted exactly within each component, block against block

Runs repeat until a pair at the threshold is missed with a probability below
1 - RECALL: a path of depth k survives as a branching process whose chance is
worked out for the depth reached. As a bucket chooses one or two coordinates, and
not now and then none, 12 runs do where buckets go to the deepest. Nothing is capped: a bucket that stays large is
a group of near copies, which the components hold together and the block count
then covers pair by pair, each block pair in a task of its own.

Shingles are of WORDS lower-case words; a text of fewer words is one shingle of all
its words, and texts without words link to nothing but their copies. Null text is
empty text. Repeated rows are copies like others. An id names one text; a row
without an id stands under a negative number made from its text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmill.llm.lines import mixed, slices, word_hashes, words_of
from mailmill.llm.tables import ship, stored, tidy

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
COORDINATES = 64
SMALL, DEEPEST = 48, 3
BLOCK = 512
SLACK = 0.17
"""Pairs whose sketches agree in fewer than SIMILARITY - SLACK of the coordinates are not compared: over three deviations."""


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts on end, sorted within each, and where each text begins."""
    texts = [t.lower() for t in texts]
    raw, _, starts, ends, owner = words_of(texts)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    hashes = word_hashes(raw, starts, ends)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    position = np.arange(len(starts)) - first[owner]
    # A text of fewer words has one shingle that begins at its first word.
    begins = np.flatnonzero((position + words <= counts[owner]) | ((position == 0) & (counts[owner] < words)))
    room = np.minimum(counts[owner[begins]] - position[begins], words)
    key = np.zeros(len(begins), np.uint64)
    for k in range(words):
        at = np.minimum(begins + k, len(hashes) - 1)
        key = np.where(k < room, mixed(key * np.uint64(0x9E3779B97F4A7C15) + hashes[at] + np.uint64(k + 1)), key)
    text = owner[begins]
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
    return key[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def sketches_of(sets: np.ndarray, bounds: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """(texts, coordinates): the smallest of 32-bit hashes of each set; sets must not be empty."""
    out = np.empty((len(bounds) - 1, coordinates), np.uint32)
    low = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 1 << 32, (coordinates, 2), dtype=np.uint32) | np.uint32(1)
    for c, (a, b) in enumerate(odd):
        x = (low ^ b) * a
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out[:, c] = np.minimum.reduceat(x, bounds[:-1])
    return out


def survival(depth: int, similarity: float, coordinates: int, agreement: float | None = None) -> float:
    """Chance that a pair shares a bucket of a depth in one run, if it agrees in a share of the coordinates: the similarity, if not given."""
    agreement = similarity if agreement is None else agreement
    whole, rest = divmod(min(1 / similarity, coordinates), 1)
    alive = 1.0
    for _ in range(depth):
        miss = 1 - agreement * alive
        alive = 1 - miss**whole * (1 - rest + rest * miss)
    return alive


def runs_for(depth: int, similarity: float, recall: float, coordinates: int) -> int:
    """Runs choose among the same coordinates, so the chance is taken over how many of them a pair agrees in."""
    share = [math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k) for k in range(coordinates + 1)]
    lost = [1 - survival(depth, similarity, coordinates, k / coordinates) for k in range(coordinates + 1)]
    runs = 1
    while sum(p * miss**runs for p, miss in zip(share, lost)) > 1 - recall:
        runs += 1
    return runs


def _as_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x.as_py() or b"" for x in batch.column(name).cast(pa.binary())]


@tidy
def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("class")
        for at, some in slices(_texts(batch)):
            sets, bounds = shingle_sets(some)
            full = np.flatnonzero(np.diff(bounds) > 0)
            if not len(full):
                continue
            sketch = sketches_of(sets, np.append(bounds[full], bounds[-1]))
            yield _as_batch({"class": ids.take(pa.array(at + full)), "sketch": pa.array([row.tobytes() for row in sketch], pa.binary())})


_ODD, _EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _path_rows(depth: int, each: float):
    """Buckets of one step: for each row those of the coordinates, `each` on average, that its path chooses."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest = divmod(each, 1)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(n, -1)
            salt = mixed(batch.column("path").to_numpy().view(np.uint64) + np.array([depth], np.uint64) * _ODD)
            chosen = int(whole) + (mixed(salt + np.uint64(1)) < np.uint64(int(rest * (1 << 64))))
            # An odd step through a power of two of coordinates meets none twice.
            begin, step = mixed(salt + np.uint64(2)), mixed(salt + np.uint64(3)) | np.uint64(1)
            for k in range(int(chosen.max())):
                on = np.flatnonzero(chosen > k)
                at = ((begin[on] + np.uint64(k) * step[on]) % np.uint64(sketch.shape[1])).astype(np.int64)
                path = mixed(mixed(salt[on] + np.uint64(4 + k)) + sketch[on, at].astype(np.uint64) * _EVEN)
                rows_on = pa.array(on)
                yield _as_batch({"class": batch.column("class").take(rows_on), "path": pa.array(path.view(np.int64)), "sketch": batch.column("sketch").take(rows_on)})

    return rows


def _first_paths(runs: range, each: float):
    """Buckets of the first step of several runs, without sketches: each run goes on in one order of the coordinates."""
    draws = range(math.ceil(each * runs.start), math.ceil(each * runs.stop))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.random.default_rng(7).permutation(COORDINATES)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(n, -1)
            for k in draws:
                salt = mixed(np.array([k + 1], np.uint64) * _ODD)
                path = mixed(salt + sketch[:, order[k % COORDINATES]].astype(np.uint64) * _EVEN)
                yield _as_batch({"class": batch.column("class"), "path": pa.array(path.view(np.int64))})

    return rows


def _agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of coordinates in which two sketches agree."""
    if not len(a):
        return pa.array([], pa.float64())
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(len(c), -1) for c in (a, b))
    return pa.array((x == y).mean(axis=1))


def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    """Exact similarity of the shingle sets of two texts."""
    out = []
    for i in range(0, len(a), 256):
        left, right = ([x.as_py() or b"" for x in c[i : i + 256].cast(pa.binary())] for c in (a, b))
        sets, bounds = shingle_sets(left + right)
        n = len(left)
        for j in range(n):
            x, y = sets[bounds[j] : bounds[j + 1]], sets[bounds[n + j] : bounds[n + j + 1]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            whole = len(x) + len(y) - common
            out.append(common / whole if whole else 0.0)
    return pa.array(out, pa.float64())


def classes_of(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, class) of every row; the class is the smallest id of the rows with the same bytes."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    # A row without an id takes a negative number made from its text.
    own = F.coalesce(F.col(doc_id).cast("long"), -F.shiftrightunsigned(F.xxhash64(body), 1) - 1)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), own.alias("own"), F.sha2(body, 256).alias("digest"))
    least = keyed.groupBy("digest").agg(F.min("own").alias("class"))
    return stored(keyed.join(least, "digest").select("doc_id", "own", "class"), "classes")


def buckets(sketches: DataFrame, runs: range, similarity: float) -> tuple[DataFrame, int]:
    """(path, class) of the buckets at which paths end, without those of one class, and the depth reached."""
    each = min(1 / similarity, COORDINATES)
    level = stored(sketches.mapInArrow(_first_paths(runs, each), "class long, path long"), "paths")
    ended, depth = [], 1
    while True:
        sizes = level.groupBy("path").agg(F.count("*").alias("count"), F.min("class").alias("hub")).where("count > 1")
        if depth >= DEEPEST:
            ended.append(level.join(sizes.select("path"), "path"))
            break
        small, large = sizes.where(F.col("count") <= SMALL).select("path"), stored(sizes.where(F.col("count") > SMALL).select("path", "hub"), "large")
        ended.append(level.select("path", "class").join(small, "path"))
        if large.isEmpty():
            break
        # A bucket all of whose members agree with one of them is a group as it is. Its star is
        # compared, and all of it where links do not hold it together.
        hubs = large.join(sketches.select(F.col("class").alias("hub"), F.col("sketch").alias("own")), "hub")
        inside = stored(level.select("path", "class").join(hubs, "path").join(sketches, "class").select("class", "path", "sketch", (F.arrow_udf(_agreement, "double")("sketch", "own") >= similarity - SLACK).alias("agrees")), "inside")
        settled = inside.groupBy("path").agg(F.min("agrees").alias("settled"))
        ended.append(inside.select("path", "class").join(settled.where("settled").select("path"), "path"))
        split = inside.drop("agrees").join(settled.where("not settled").select("path"), "path").select("class", "path", "sketch")
        level = stored(split.mapInArrow(_path_rows(depth, each), "class long, path long, sketch binary").select("class", "path"), "paths")
        if level.isEmpty():
            break
        depth += 1
    out = ended[0].select("path", "class")
    for more in ended[1:]:
        out = out.unionByName(more.select("path", "class"))
    return stored(out.distinct(), "buckets"), depth


def candidate_pairs(members: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: all pairs of small buckets, stars of large ones, whose sketches are near enough."""
    sizes = members.groupBy("path").agg(F.count("*").alias("n"), F.min("class").alias("hub"), F.max("class").alias("hub2"))
    sized = members.join(sizes, "path")
    small = sized.where(F.col("n") <= SMALL).groupBy("path").agg(F.sort_array(F.collect_list("class")).alias("all"))
    pairs = small.select(F.posexplode("all").alias("i", "a"), "all").select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    large = sized.where(F.col("n") > SMALL)
    stars = large.select(F.explode(F.array("hub", "hub2")).alias("h"), "class").where("h != class")
    star_pairs = stars.select(F.least("h", "class").alias("a"), F.greatest("h", "class").alias("b"))
    pairs = stored(pairs.unionByName(star_pairs).distinct(), "pairs")
    left = sketches.select(F.col("class").alias("a"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("class").alias("b"), F.col("sketch").alias("sb"))
    near = F.arrow_udf(_agreement, "double")("sa", "sb") >= similarity - SLACK
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets are similar enough; `texts` has class and text."""
    pairs = stored(pairs, "near")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    own = stored(texts.join(involved, "class"), "near-texts")
    left = own.select(F.col("class").alias("a"), F.col("text").alias("ta"))
    right = own.select(F.col("class").alias("b"), F.col("text").alias("tb"))
    alike = F.arrow_udf(_jaccard, "double")("ta", "tb") >= similarity
    return pairs.join(left, "a").join(right, "b").where(alike).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(class, component): the smallest class that links lead to, for every class with a link."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("class"), F.least("a", "m").alias("component")), "labels")
    while True:
        # The smallest label of the neighbours, then that label's own label.
        seen = edges.join(labels, edges.a == labels["class"]).select(F.col("b").alias("class"), "component")
        least = labels.unionByName(seen).groupBy("class").agg(F.min("component").alias("component"))
        own = labels.select(F.col("class").alias("component"), F.col("component").alias("root"))
        new = stored(least.join(own, "component", "left").select("class", F.coalesce("root", "component").alias("component")), "labels")
        before = labels.select("class", F.col("component").alias("was"))
        settled = new.join(before, "class").where("component != was").isEmpty()
        labels = new
        if settled:
            return labels


def _linked(table: pa.Table, similarity: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of the left block are linked to which of the right one, from whole sets; and the rows."""
    side = table.column("side").to_numpy()
    texts = [x.as_py() or b"" for x in table.column("text").cast(pa.binary())]
    sets, bounds = shingle_sets(texts)
    sizes = np.diff(bounds)
    values, column = np.unique(sets, return_inverse=True)
    row = np.repeat(np.arange(len(texts)), sizes)
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    common = np.zeros((len(left), len(right)), np.float32)
    # Columns in stretches, so that a block's matrix stays small.
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, len(values), 4096):
        inside = slice(*np.searchsorted(column, [low, low + 4096]))
        matrix = np.zeros((len(texts), 4096), np.float32)
        matrix[row[inside], column[inside] - low] = 1
        common += matrix[left] @ matrix[right].T
    whole = sizes[left][:, None] + sizes[right][None, :] - common
    linked = (whole > 0) & (common >= similarity * whole - 1e-6)
    if same:
        np.fill_diagonal(linked, False)
    return linked, left, right


def _block_counts(similarity: float):
    """Per class, the rows of the other block that it is linked to."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        same = key[1].as_py() == key[2].as_py()
        linked, left, right = _linked(table, similarity, same)
        ids, copies = table.column("class"), table.column("copies").to_numpy()
        n, at = linked @ copies[right], left
        if not same:
            n, at = np.concatenate([n, linked.T @ copies[left]]), np.concatenate([left, right])
        return pa.table({"class": ids.take(pa.array(at)), "n": pa.array(n, pa.int64())})

    return count


def _block_joins(similarity: float):
    """A star around the first class of each set of classes that links of the block pair hold together."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        linked, left, right = _linked(table, similarity, key[1].as_py() == key[2].as_py())
        label = np.arange(table.num_rows)
        while linked.size:
            far = np.where(linked, label[left][:, None], len(label)).min(axis=0)
            label[right] = np.minimum(label[right], far)
            near = np.where(linked, label[right][None, :], len(label)).min(axis=1)
            after = np.minimum(label[left], near)
            if (after == label[left]).all():
                break
            label[left] = after
        at = np.flatnonzero(label != np.arange(len(label)))
        ids = table.column("class")
        return pa.table({"a": ids.take(pa.array(label[at])), "b": ids.take(pa.array(at))})

    return join


def block_pairs(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows for tasks that compare two blocks of a group: x and y name them, side tells in which a row is.

    `placed` has class, block and limit: a block meets those numbered below its limit.
    """
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("limit") - 1)))
    meet = each.withColumns({
        "x": F.least("block", "other"), "y": F.greatest("block", "other"), "side": (F.col("block") > F.col("other")).cast("int"),
    })
    return meet.drop("block", "other", "limit").join(texts, "class")


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("class"), blocks).cast("int")


def mixed_buckets(members: DataFrame, groups: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): what links hold together in large buckets of more than one component.

    The largest component of a bucket is not compared with itself again.
    """
    known = members.join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    parts = known.groupBy("path", "component").agg(F.count("*").alias("n"))
    whole = parts.groupBy("path").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("largest"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    torn = whole.where((F.col("n") > SMALL) & (F.col("n") > F.col("most"))).select(
        "path", "largest", blocks(F.col("n") - F.col("most")).alias("rest"), blocks(F.col("most")).alias("own")
    )
    rows = known.join(torn, "path")
    placed = rows.select(
        "path", "class",
        F.when(F.col("component") == F.col("largest"), F.col("rest") + _dealt(F.col("own"))).otherwise(_dealt(F.col("rest"))).alias("block"),
        F.when(F.col("component") == F.col("largest"), F.col("rest")).otherwise(F.col("rest") + F.col("own")).alias("limit"),
    )
    return block_pairs(placed, texts).groupBy("path", "x", "y").applyInArrow(_block_joins(similarity), "a long, b long").distinct()


def count_links(grouped: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(class, n): rows of other classes of the component whose sets are similar enough.

    `grouped` has class, component and copies.
    """
    sizes = grouped.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("limit"))
    placed = grouped.join(sizes, "component").withColumn("block", _dealt(F.col("limit")))
    counted = block_pairs(placed, texts).groupBy("component", "x", "y").applyInArrow(_block_counts(similarity), "class long, n long")
    return counted.groupBy("class").agg(F.sum("n").alias("n"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, recall: float = RECALL, links: bool = True) -> DataFrame:
    """(doc_id, class_id, copy_class, n_links) for every row.

    class_id is the smallest id that links lead to; n_links counts the other rows
    that are copies or similar enough (without `links` it is left out).
    """
    ship(docs.sparkSession)
    copies = classes_of(docs, text, doc_id)
    counts = copies.groupBy("class").agg(F.count("*").alias("copies"))
    # One row stands for its class: that of the smallest id. Repeated rows are one here.
    body = F.coalesce(F.col(text), F.lit(""))
    own = F.coalesce(F.col(doc_id).cast("long"), -F.shiftrightunsigned(F.xxhash64(body.cast("binary")), 1) - 1)
    first = copies.where("own = class").select("class").distinct()
    texts = docs.select(own.alias("class"), body.alias("text")).join(first, "class").dropDuplicates(["class"])
    sketches = stored(texts.mapInArrow(_sketch_rows, "class long, sketch binary"), "sketches")
    need = runs_for(1, similarity, recall, COORDINATES)
    members, depth = buckets(sketches, range(need), similarity)
    more = runs_for(depth, similarity, recall, COORDINATES)
    if more > need:
        # Deeper paths survive less often: the missing runs follow.
        again, _ = buckets(sketches, range(need, more), similarity)
        members = members.unionByName(again)
    found = stored(confirmed(candidate_pairs(members, sketches, similarity), texts, similarity), "links")
    groups = components(found)
    rest = stored(mixed_buckets(members, groups, texts, similarity), "mixed")
    if not rest.isEmpty():
        groups = components(found.unionByName(rest))
    out = copies.join(groups, "class", "left").join(counts, "class")
    out = out.withColumn("class_id", F.coalesce("component", "class"))
    if not links:
        return out.select("doc_id", "class_id", F.col("class").alias("copy_class"))
    n = count_links(groups.join(counts, "class"), texts, similarity)
    whole = out.join(n, "class", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n", F.lit(0)))
    return whole.select("doc_id", "class_id", F.col("class").alias("copy_class"), "n_links")
