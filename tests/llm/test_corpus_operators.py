"""Operators that compare texts with each other, against plain versions on small tables."""

import collections
import glob
import math
import random
import re
import tempfile
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailmill.llm import decontaminate, jaccard, lines, ngrams, urls
from mailmill.llm.tables import stored

ODD = [(901, None), (902, ""), (903, " \n\t "), (None, "a text without an id"), (904, "é　日本 🎉 x"), (904, "é　日本 🎉 x")]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rnd, n, size=900):
    return " ".join(f"w{min(int(rnd.expovariate(0.01)), size)}" + ("\n" if rnd.random() < 0.05 else "") for _ in range(n))


@pytest.fixture(scope="module")
def copies():
    """Texts with exact copies, near copies, a common passage and a common first line."""
    rnd = random.Random(4)
    passage, first = prose(rnd, 70, 10_000), "a very common first line of seven\n"
    rows, i = [], 0
    for _ in range(60):
        text = first + prose(rnd, rnd.randint(30, 120), 20_000)
        if rnd.random() < 0.3:
            text += "\n" + passage + "\n" + prose(rnd, 30, 20_000)
        rows.append((i, text))
        i += 1
        if rnd.random() < 0.2:
            for _ in range(rnd.randint(1, 12)):
                words = text.split(" ")
                if rnd.random() < 0.7:
                    words[rnd.randrange(len(words))] = f"new{i}"
                rows.append((i, " ".join(words)))
                i += 1
    return rows, passage


# N-gram Jaccard join


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(rows):
    sets = [(i, t or "", shingles(t)) for i, t in rows]
    parent, links = {i: i for i, _, _ in sets}, collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, t, s) in enumerate(sets):
        for j, u, v in sets[:a]:
            if t == u or (s and v and len(s & v) >= 0.8 * len(s | v)):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i, _, _ in sets}


@pytest.mark.parametrize("small,block", [(48, 512), (3, 4)])
def test_jaccard_against_all_pairs(spark, docs_of, copies, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = [*copies[0], (901, None), (902, ""), (905, "two words"), (906, "two words")]
    got = jaccard.near_duplicates(docs_of(rows).withColumnRenamed("lang", "class")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == plain_groups(rows)
    assert len(got) == len(rows)


def test_jaccard_odd_rows(spark, docs_of):
    got = jaccard.near_duplicates(docs_of(ODD)).collect()
    assert len(got) == len(ODD)
    assert len({r.class_id for r in got if r.doc_id in (901, 902)}) == 1
    assert [r.n_links for r in got if r.doc_id == 904] == [1, 1]
    assert jaccard.near_duplicates(docs_of(ODD).limit(0)).collect() == []


def test_where_nothing_is_split_no_deeper_runs_follow(spark):
    """All of a large bucket agree with its smallest class."""
    rnd = np.random.default_rng(2)
    hub = np.arange(jaccard.COORDINATES, dtype=np.uint32)

    def like(share):
        other = rnd.integers(1 << 20, 1 << 32, len(hub), dtype=np.uint32)
        return np.where(rnd.random(len(hub)) < share, hub, other).astype(np.uint32).tobytes()

    rows = [(0, hub.tobytes())] + [(i, like(0.95)) for i in range(1, 100)]
    sketches = spark.createDataFrame([(i, bytearray(s)) for i, s in rows], "class long, sketch binary")
    members, depth = jaccard.buckets(sketches, range(10), jaccard.SIMILARITY)
    assert depth == 1
    assert {r["class"] for r in members.collect()} >= set(range(100))


def test_survival_of_paths():
    assert jaccard.survival(1, 0.8, 64) > jaccard.survival(2, 0.8, 64) > jaccard.survival(3, 0.8, 64) > 0.3
    assert jaccard.runs_for(1, 0.8, 0.9999, 64) <= 12


# Line dedup


def test_lines_keep_one_copy_of_each_passage(spark, docs_of, copies):
    rows, passage = copies
    got = {r.doc_id: r for r in lines.dedup_lines(docs_of([*rows, *ODD])).collect()}
    assert sum(passage in r.text for r in got.values() if r.text) == 1
    words = lambda t: t.split()
    holders, left = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in rows:
        for j in range(len(words(t)) - 49):
            holders[tuple(words(t)[j : j + 50])].add(i)
    for i, r in got.items():
        for j in range(len(words(r.text or "")) - 49):
            left[tuple(words(r.text)[j : j + 50])].add(i)
    assert sum(len(v) > 1 for v in left.values()) <= 0.02 * sum(len(v) > 1 for v in holders.values())
    shorter = collections.defaultdict(set)
    for i, t in rows:
        for j in range(len(words(t)) - lines.LEAST_WORDS + 1):
            shorter[tuple(words(t)[j : j + lines.LEAST_WORDS])].add(i)
    clean = {i for i, _ in rows} - {i for v in shorter.values() if len(v) > 1 for i in v}
    assert clean
    texts = dict(rows)
    short = {i for i in clean if got[i].text != texts[i]}
    assert not short, short
    # Every word pair of the input is still somewhere.
    pairs = lambda ts: {p for t in ts for p in zip(words(t), words(t)[1:])}
    inner = {p for p in pairs([passage])}
    assert inner <= pairs(r.text for r in got.values() if r.text)


def test_lines_leave_no_passage_of_least_words_twice(spark, docs_of):
    rnd = random.Random(7)
    some = lambda n: [f"w{int(rnd.expovariate(0.002))}" for _ in range(n)]
    told = lambda ws: "".join(w + ("\n" if rnd.random() < 0.05 else " ") for w in ws)
    passages, rows = [told(some(rnd.randint(25, 45))) for _ in range(60)], []
    for i in range(200):
        text = told(some(rnd.randint(20, 90)))
        for passage in rnd.sample(passages, rnd.randint(0, 3)):
            # Some texts repeat a passage within themselves.
            text += passage * rnd.choice([1, 1, 2]) + told(some(rnd.randint(5, 40)))
        rows.append((i, text))

    def shared(rows):
        holders = collections.defaultdict(set)
        for i, t in rows:
            words = t.split()
            for j in range(len(words) - lines.LEAST_WORDS + 1):
                holders[tuple(words[j : j + lines.LEAST_WORDS])].add(i)
        return sum(len(v) > 1 for v in holders.values())

    assert shared(rows) > 500
    got = [(r.doc_id, r.text) for r in lines.dedup_lines(docs_of(rows)).collect()]
    assert shared(got) == 0


@pytest.mark.parametrize("unit", [["same"], ["one", "two"], ["a", "b", "b", "c"]])
def test_chunks_of_short_and_periodic_texts(unit):
    rnd = random.Random(2)
    for n in (0, 1, 7, 8, 9, 26, 400):
        body = " ".join(unit * n)
        text, hashes, _, starts, ends, *_ = lines.chunks_of([f"w{rnd.random()} x {body}".encode(), b"", b"x", f"y {body}".encode()])
        assert (starts < ends).all() and set(text.tolist()) <= {0, 3}
        if n * len(unit) >= lines.LEAST_WORDS:
            assert set(hashes[text == 0].tolist()) & set(hashes[text == 3].tolist())


def test_lines_odd_rows(spark, docs_of):
    got = lines.dedup_lines(docs_of(ODD).withColumnRenamed("lang", "n_removed_words")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(ODD)
    assert lines.dedup_lines(docs_of(ODD).limit(0)).collect() == []
    long = "word " * 100_000
    got = lines.dedup_lines(docs_of([(1, long), (2, "x " + long)])).collect()
    assert len(got) == 2


def test_chunks_do_not_depend_on_what_stands_before():
    rnd = random.Random(9)
    body = prose(rnd, 400, 5000).encode()
    whole = lines.chunks_of([b"other words in front of it " + body, body])
    hashes = [set(whole[1][whole[0] == k].tolist()) for k in (0, 1)]
    assert len(hashes[0] & hashes[1]) >= len(hashes[1]) - 3
    alone = lines.chunks_of([body])
    assert (alone[1] == whole[1][whole[0] == 1]).all()


def test_bytes_of_a_slice_are_summed_once(monkeypatch):
    summed, plain = [], lines.byte_sums
    monkeypatch.setattr(lines, "byte_sums", lambda raw: summed.append(len(raw)) or plain(raw))
    text = prose(random.Random(3), 200).encode()
    assert len(lines.chunks_of([text])[0]) > 2 and summed == [len(text) + 1]


def test_common_start():
    for a, b, n in ((b"", b"x", 0), (b"ab", b"ab", 2), (b"ab", b"abc", 2), (b"abx", b"aby", 2), (b"\x00a", b"\x00b", 1), (b"b", b"a", 0)):
        assert lines._common(a, b) == lines._common(b, a) == n


def test_grown_stops_at_words():
    assert lines.grown(b"aa bb ", b" cc dd", b"xx bb ", b" cc de") == (4, 3)
    assert lines.grown(b"", b"", b"a ", b" b") == (0, 0)
    # As much as is looked at agrees, and it begins and ends inside characters.
    word = "\u0434\u0430 ".encode()
    left, right = (word * lines.CONTEXT + b"xx ")[-lines.CONTEXT :], (b" x" + word * lines.CONTEXT)[: lines.CONTEXT]
    n, m = lines.grown(left, right, left, right)
    assert 0 < n < lines.CONTEXT and left[len(left) - n :][:1].isspace()
    assert 0 < m < lines.CONTEXT and right[m : m + 1].isspace()


# Benchmark decontamination


def test_decontamination_against_plain_search(spark, docs_of):
    rnd = random.Random(6)
    items = [(k, prose(rnd, rnd.randint(25, 60), 3000) + ". " + prose(rnd, 6, 3000) + ".") for k in range(30)]
    rows, planted = [], set()
    for i in range(120):
        text = prose(rnd, rnd.randint(20, 200), 3000)
        if i % 4 == 0:
            k = rnd.randrange(30)
            words = items[k][1].split(" ")
            for _ in range(len(words) // 10):
                words[rnd.randrange(len(words))] = "changed"
            text = text + " " + " ".join(words) + " " + prose(rnd, rnd.randint(0, 100), 3000)
            planted.add((i, k))
        rows.append((i, text))
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (None, "x y z")], "item_id long, text string")
    found = decontaminate.find_contaminated(docs_of([*rows, *ODD]), bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(got & planted) >= 0.9 * len(planted)
    assert {i for i, _ in got} <= {i for i, _ in planted}
    kept = decontaminate.without_contaminated(docs_of([*rows, *ODD]), bench)
    assert kept.count() == len(rows) + len(ODD) - len({i for i, _ in got})
    assert decontaminate.find_contaminated(docs_of(rows).limit(0), bench).collect() == []
    assert decontaminate.find_contaminated(docs_of(rows), bench.limit(0)).collect() == []


def plain_pairs(texts, items):
    """Terms, and how often two of them stand in one half passage, by counting."""
    terms = np.unique(np.concatenate(items.words)).tolist()
    place = {t: i for i, t in enumerate(terms)}
    want, held = np.zeros((len(terms), len(terms)), int), np.zeros(len(terms), int)
    half = decontaminate.PASSAGE // 2
    for text in texts:
        words = decontaminate.tokens([text.encode()])[0].tolist()
        held[[place[w] for w in {*words} if w in place]] += 1
        for i in range(0, len(words), half):
            t = np.zeros(len(terms), int)
            np.add.at(t, [place[w] for w in words[i : i + half] if w in place], 1)
            want += np.outer(t, t)
    return want, held


@pytest.mark.parametrize("cells, met", [(1 << 24, 1 << 25), (700, 300)])
def test_the_basis_is_of_all_documents(spark, docs_of, monkeypatch, cells, met):
    monkeypatch.setattr(decontaminate, "MOST_CELLS", cells)
    monkeypatch.setattr(decontaminate, "STRIPE_CELLS", 200)
    monkeypatch.setattr(decontaminate, "MOST_MET", met)
    rnd = random.Random(12)
    # More documents than a sample had, and one longer than it took.
    texts = [prose(rnd, rnd.randint(1, 30), 150) for _ in range(2300)] + [prose(rnd, 5000, 150)]
    assert len(texts[-1]) > 20_000
    items = decontaminate.read_items([(1, prose(rnd, 40, 150)), (2, prose(rnd, 30, 150))])
    docs = docs_of([(i, t) for i, t in enumerate(texts)] + [(None, None), (-1, "")])
    want, held = plain_pairs(texts, items)
    got = np.zeros(want.shape, int)
    for row in decontaminate.count_terms(docs, np.unique(np.concatenate(items.words))).collect():
        numbers = np.frombuffer(row.cells, np.int64)
        if row.stripe < 0:
            assert numbers.tolist() == [*held, len(texts) + 2]
        else:
            some = numbers.reshape(-1, len(want))
            got[row.stripe : row.stripe + len(some)] = some
    assert (got == want).all()


def test_covered():
    low, high = np.array([0, 2, 2, 9, 9, 20]), np.array([3, 3, 6, 9, 12, 21])
    assert decontaminate.covered(low, high).tolist() == [0, 1, 2, 3, 4, 5, 9, 10, 11, 20]
    assert len(decontaminate.covered(low[:0], high[:0])) == 0


def test_products_come_to_the_driver_one_by_one(spark, docs_of, monkeypatch):
    rnd = random.Random(9)
    docs = docs_of([(i, prose(rnd, 200)) for i in range(40)])
    items = decontaminate.read_items([(1, prose(rnd, 40)), (2, prose(rnd, 30))])
    kind, taken = type(docs), []
    plain = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: taken.append(self.columns) or plain(self))
    index = decontaminate.build_index(docs, items)
    assert len(index.matrix) == 2 and ["product"] not in taken


def test_lcs():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randint(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs(a, b) == table[-1][-1]


def test_buckets_choose_close_to_the_mean_of_coordinates(spark):
    """No bucket chooses none, none more than one above the mean; alike sketches meet, and few runs do."""
    rnd = np.random.default_rng(4)
    n = 4000
    one = rnd.integers(0, 1 << 32, (n, jaccard.COORDINATES), dtype=np.uint32)
    other = np.where(rnd.random(one.shape) < 0.8, one, rnd.integers(0, 1 << 32, one.shape, dtype=np.uint32)).astype(np.uint32)

    def paths(sketches, runs, depth):
        blobs = pa.array([row.tobytes() for row in sketches], pa.binary())
        ids = pa.array(np.arange(n))
        out = list(jaccard._first_paths(runs, 1.25)(iter([pa.RecordBatch.from_arrays([ids, blobs], names=["class", "sketch"])])))
        for step in range(1, depth):
            table = pa.Table.from_batches([b.select(["class", "path"]) for b in out]).combine_chunks()
            table = table.append_column("sketch", blobs.take(table.column("class")))
            out = list(jaccard._path_rows(step, 1.25)(iter(table.to_batches())))
        return [(c, p) for b in out for c, p in zip(b.column("class").to_pylist(), b.column("path").to_pylist())]

    first = paths(one, range(1), 1)
    assert collections.Counter(collections.Counter(c for c, _ in first).values()) == {2: n}
    second = collections.Counter(collections.Counter(c for c, _ in paths(one, range(4), 2)).values())
    assert min(second) >= 5 and max(second) <= 10
    runs = range(jaccard.runs_for(3, 0.8, 0.9999, jaccard.COORDINATES))
    assert len(runs) <= 12
    met = set(paths(one, runs, 3)) & set(paths(other, runs, 3))
    assert len({c for c, _ in met}) >= n - 4


# Language model


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 5), (1000, 10**12), (5000, 6000), (3000, 100), (200, 2**40)):
        values = np.sort(rng.integers(0, top, n))
        packed = ngrams.EliasFano.of(values)
        assert (packed[np.arange(n)] == values).all()
        bounds = np.concatenate([rng.integers(0, top + 5, 2000), values, values + 1, [0]])
        assert (packed.successor(bounds) == np.searchsorted(values, bounds)).all()


def test_scores_look_back_over_more_than_one_word(spark, docs_of):
    """A word is likelier after the two words that training has before it than after the last of them alone."""
    learned = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "a x c" if k % 2 else "b x d") for k, i in enumerate(learned)] + [(held[0], "a x c"), (held[1], "a x d")]
    got = {r.doc_id: r.score for r in ngrams.score_texts(docs_of(rows), ngrams.trained()).collect()}
    assert got[held[0]] > got[held[1]] + 0.2


@pytest.mark.parametrize("order", [2, 3])
def test_scores_against_counted_ngrams(spark, docs_of, copies, monkeypatch, order):
    monkeypatch.setattr(ngrams, "BLOCK_WORDS", 500)
    rows = [*copies[0], (901, None), (902, ""), (903, " \n\t ")]
    got = {r.doc_id: r for r in ngrams.score_texts(docs_of(rows), ngrams.trained(), order=order).collect()}
    counts = [collections.Counter() for _ in range(order + 1)]
    contexts = [collections.Counter() for _ in range(order + 1)]
    texts = {i: ["<s>", *WORD.findall((t or "").encode().lower()), "</s>"] for i, t in rows}
    learned = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    for i in learned:
        for k in range(1, len(texts[i])):
            counts[1][texts[i][k]] += 1
            for n in range(2, order + 1):
                if k - n + 1 >= 0:
                    gram = tuple(texts[i][k - n + 1 : k + 1])
                    counts[n][gram] += 1
                    contexts[n][gram[:-1]] += 1
    types, total = len(counts[1]), sum(counts[1].values())
    for i, words in texts.items():
        score = base = known = 0
        for k in range(1, len(words)):
            c = counts[1][words[k]]
            known += c > 0
            base += math.log10((c + 1) / (total + types + 1))
            p = (c or types) / (total + types)
            for n in range(2, order + 1):
                if k - n + 1 >= 0:
                    gram = tuple(words[k - n + 1 : k + 1])
                    p = (counts[n][gram] + ngrams.STRENGTH * p) / (contexts[n][gram[:-1]] + ngrams.STRENGTH)
            score += math.log10(p)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words) - 1, known, total, i not in learned)
        assert abs(r.base_score - base) < 1e-6
        # Probabilities and weights are rounded to half a step each.
        assert abs(r.score - score) <= order * (len(words) - 1) / ngrams.SCALE


def test_keys_of_a_block_take_less_than_six_bytes():
    rng = np.random.default_rng(3)
    words = rng.integers(1 << 60, 1 << 62, 1_000_000).astype(np.uint64)
    row = {"block": "b", "doc_ids": [1], "learned": [True], "counts": [len(words)]}
    row["words"], row["places"] = (a[0].as_py() for a in ngrams._pack_words(words))
    batch = pa.RecordBatch.from_pylist([row])
    keys = ngrams.distinct_grams(words, np.array([len(words)]), [2])[0].keys
    out = [r for b in ngrams._dealt_rows((2,), 5)(iter([batch])) for r in b.to_pylist()]
    assert sum(len(r["keys"]) for r in out) < 6 * len(keys)
    assert (np.concatenate([ngrams._unpacked_keys(r["keys"]) for r in out]) == keys).all()
    assert sum(ngrams._large(r["n"]).sum() for r in out) == len(words)
    for few in (keys[:1], keys[:3], np.array([0, 1, (1 << 64) - 1], np.uint64)):
        assert (ngrams._unpacked_keys(ngrams._packed_keys(few)) == few).all()


def test_what_was_shuffled_leaves_the_disk_once_the_rows_are_stored(spark):
    def files():
        return set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, asked = files(), spark.conf.get(setting)
    some = stored(spark.range(100_000).repartition(3, "id"), "numbers")
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before and some.count() == 100_000
    assert spark.conf.get(setting) == asked


def test_scores_of_odd_and_no_rows(spark, docs_of):
    got = ngrams.score_texts(docs_of(ODD), ngrams.trained()).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) for r in got)
    assert ngrams.score_texts(docs_of(ODD).limit(0), ngrams.trained()).collect() == []


# URL filters


def plain_judge(url):
    host, path = "", ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    best = None
    for r in urls.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.host + r.path) > len(best.host + best.path)):
            best = r
    return host, path, best and best.host + best.path, best and best.verdict


def test_rules_and_ranks_against_plain_ones(spark):
    pages = [
        (1, "http://A.example.org/es/1?q", '<a href="http://x.net/">'), (2, "https://b.example.org/en/12", None), (3, "http://x.net/p", '<a HREF=//y.net/z><a href="/local">'),
        (4, "http://y.net", ""), (5, "http://c.com/de/", "<a href='http://bad.net/'>"), (6, "http://bad.net/a", '<a href="http://c.com/de/">'), (7, None, None), (8, "no scheme", None),
        (9, "ftp://d.com/fr/x#y", '<a href="http://good.net/">'), (10, "http://good.net/", ""), (10, "http://good.net/", ""), (None, "http://comcom/fr/", None), (11, "http://É.COM/fr/", None),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = urls.judge_urls(table).collect()
    assert len(got) == len(pages)
    want = collections.Counter((i, *plain_judge(u)[:3]) for i, u, _ in pages)
    assert collections.Counter((r.page_id, r.host, r.path, r["rule"]) for r in got) == want
    verdict = {r.page_id: r.verdict for r in got}
    assert all(r.verdict == plain_judge(u)[3] for i, u, _ in pages for r in got if r.page_id == i and r["rule"])
    assert verdict[6] == "block" and verdict[10] == "allow" and verdict[7] == verdict[8] == "allow"

    # The ranks, step by step.
    links = {(r.src, r.dst): r.n for r in urls.host_links(table).collect()}
    ruled = [plain_judge(u) for _, u, _ in pages]
    seeds = {k: collections.Counter(h for h, _, _, v in ruled if v == k) for k in ("allow", "block")}
    rank = {}
    for kind, ahead in (("allow", True), ("block", False)):
        start = {h: 0.15 * n / sum(seeds[kind].values()) for h, n in seeds[kind].items()}
        edges = [(a, b, n) if ahead else (b, a, n) for (a, b), n in links.items()]
        out = collections.Counter()
        for a, _, n in edges:
            out[a] += n
        now = dict(start)
        for _ in range(6):
            new = collections.Counter(start)
            for a, b, n in edges:
                new[b] += 0.85 * now.get(a, 0) * n / out[a]
            now = new
        rank[kind] = now
    for r in got:
        assert abs(r.trust - rank["allow"].get(r.host, 0)) < 1e-9 and abs(r.distrust - rank["block"].get(r.host, 0)) < 1e-9
    assert urls.judge_urls(table.limit(0)).collect() == []
    plan = urls.judge_urls(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# The pipeline


def test_pipeline_stages(spark, docs_of, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = docs_of(ODD)
    for name, stage in pipeline.STAGES[1:]:
        docs_out = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert docs_out.columns == docs.columns and docs_out.dtypes == docs.dtypes
        docs = docs_out if name != "bpe" else docs
    assert docs.count() >= 3


def test_repeated_rows_are_compared_once(spark, docs_of):
    """Two texts with a passage in common, each a thousand times over, give the spans of one of each."""
    rnd = random.Random(4)
    passage = "\n".join(" ".join(f"w{rnd.randrange(5000)}" for _ in range(9)) for _ in range(12))
    pair = [(1, "first own line\n" + passage), (2, passage + "\nsecond own line of it")]
    once = lines.repeated_spans(docs_of(pair)).count()
    assert 0 < lines.repeated_spans(docs_of(pair * 1000)).count() == once
    cut = lines.dedup_lines(docs_of(pair * 20)).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_removed_words").alias("cut")).collect()
    assert sorted((r.n, r.cut > 100) for r in cut) in ([(20, False), (20, True)], [(20, True)])
