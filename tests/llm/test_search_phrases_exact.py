"""Ranked lexical search, phrase collocations and the digest index against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from messy import LONG, PASSAGE, SCHEMA, TEXTS, docs, plain
from loanlens.llm import exact, lexical, phrases


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- search
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, items, k=10):
    held = [(r[0], Counter(TERM.findall(lower(r[1])))) for r in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    N, L = len(held), sum(n for *_, n in held)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(TERM.findall(lower(t)))
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, terms in wanted.items():
        scored = []
        for d, c, n in held:
            m = 10 + (90 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def search_case():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(30)] + ["Ärger", "ÄRGER", "ñ"]
    rows = TEXTS + [(100 + i, " ".join(rnd.choices(words, weights=[100 // (j + 1) + 1 for j in range(33)], k=rnd.randint(1, 40))),
                     "en", "s") for i in range(300)]
    rows += [rows[-1]] * 15 + [(None, rows[-1][1], None, None)]
    items = [(1, "w0 w1 W2 w3 ärger"), (2, " ".join(words * 3)), (3, None), (4, ""), (5, "nowhere at all"), (6, PASSAGE),
             (7, " ".join(f"x{i} w{i % 30} w{i}" for i in range(200))), (1, "w7 ñ"), (None, "w0 w29"), (8, LONG), (9, "w1 w2")]
    return rows, items


@pytest.mark.parametrize("block,pairs", [(4096, 200_000), (16, 200_000), (7, 60)])
def test_search_equals_brute_force(spark, monkeypatch, block, pairs):
    """Small blocks let the k-th score prune masks; small PAIRS deal the items over several passes."""
    monkeypatch.setattr(lexical, "DOCS", block)
    rows, items = search_case()
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash"))
    got = lexical.search(docs(spark, rows).coalesce(2), it, pairs=pairs).collect()
    assert Counter(tuple(r) for r in got) == brute_search(rows, items)


def test_search_edges(spark):
    none = plain(spark, TEXTS).limit(0)
    it = spark.createDataFrame([(1, "the fox")], "item_id long, text string")
    assert lexical.search(none, it).collect() == []
    assert lexical.search(plain(spark), it.limit(0)).collect() == []
    assert lexical.search(plain(spark).where("text is null"), it).collect() == []
    weight, one = np.array([5, 3], np.int64), np.array([1], np.int64)
    with pytest.raises(OverflowError):
        list(lexical._searcher([np.array([0])], weight, 1 << 50, 1 << 50, 10)(iter([_counts(1 << 40)])))
    block = lexical._Block(one * 4, one, np.array([1], np.int32), one, weight, 1, 4)
    assert block.search(np.array([0]), 10, 0) is None


def _counts(n):
    import pyarrow as pa
    return pa.record_batch([pa.array([1], pa.int64()), pa.array([n], pa.int64()), pa.array([[0]], pa.list_(pa.int32())),
                            pa.array([[1]], pa.list_(pa.int64()))], ["doc_id", "n", "ids", "tfs"])


# ---------------------------------------------------------------- phrases
def brute_phrases(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], a)
        scored = []
        for p, a in found.items():
            if 100 * longer[p] >= 80 * a:
                continue
            s, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def phrase_rows():
    rnd = random.Random(12)
    words = ["the", "of", "a", "x\x1cy", "Über", "é", "𝔘", *(f"w{i}" for i in range(40))]
    rows = list(TEXTS)
    for i in range(400):
        w = rnd.choices(words, weights=[400 // (j + 1) + 1 for j in range(len(words))], k=rnd.randint(0, 60))
        marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "! "]
        rows.append((200 + i, "".join(x + rnd.choice(marks) for x in w), rnd.choice(["en", "en", "de", None]), "s"))
    return rows + [(900 + i, "Of the same OF THE same. " * 3, "en", "s") for i in range(40)]


@pytest.mark.parametrize("least,hot,buffer,bits", [(30, 500, 1_000_000, 1 << 25), (3, 500, 50, 1 << 25), (5, 8, 200, 1 << 25),
                                                   (5, 500, 300, 1 << 6)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, hot, buffer, bits):
    """Few hot words, many hot words, routes longer than a buffer, a full bit table."""
    for name, value in (("HOT", hot), ("BUFFER", buffer), ("BITS", bits), ("BYTES", 20_000)):
        monkeypatch.setattr(phrases, name, value)
    rows = phrase_rows()
    got = [tuple(r) for r in phrases.collocations(docs(spark, rows), least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, least)


def test_phrases_top_and_empty(spark):
    rows = phrase_rows()
    got = {tuple(r) for r in phrases.collocations(plain(spark, rows), 3, top=7).collect()}
    assert got == brute_phrases(rows, 3, 7)
    assert phrases.collocations(plain(spark).limit(0)).collect() == []
    assert phrases.collocations(plain(spark, [(1, None, "en", "s"), (2, "", None, "s")])).collect() == []


def test_quicksort_counts():
    rnd = np.random.default_rng(5)
    keys = rnd.integers(0, 6, (3000, 4)) ** 2 // 3
    stop = rnd.integers(1, 5, 3000)
    keys[np.arange(4)[None, :] >= stop[:, None]] = -1
    weight = rnd.integers(1, 4, 3000)
    order = np.lexsort((keys[:, 0] % 2,))
    keys, weight = keys[order], weight[order]
    bounds = np.r_[0, np.flatnonzero(np.diff(keys[:, 0] % 2)) + 1]
    want = Counter()
    for k, w in zip(keys, weight):
        for d in range(1, 5):
            if k[d - 1] < 0:
                break
            want[tuple(k[:d])] += int(w)
    got = Counter()
    for row, depth, w in phrases.quicksort(keys, weight, bounds, 20):
        for r, d, x in zip(row, depth, w):
            assert tuple(keys[r, :d]) not in got
            got[tuple(keys[r, :d])] = int(x)
    assert got == Counter({p: c for p, c in want.items() if c >= 20})


# ---------------------------------------------------------------- digest index
def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact_rows():
    rnd = random.Random(13)
    rows = TEXTS + [(300 + i, rnd.choice(["a b", "ab", " a\tb ", "a  b", "c\x0bd", "cd", "Cd", " cd", ""]), "en", "s") for i in range(80)]
    return rows + [(500, "a b", "en", "s")] * 20 + [(None, "ab      ", None, None)] * 2 + [(None, None, None, None)]


def brute_members(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[norm(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0, i))
    out = Counter()
    for t, g in groups.items():
        keep = rows[min(g)[3]][0]
        h = hashlib.sha256(t.encode()).hexdigest()
        out.update((rows[i][0], keep, len(g), i == min(g)[3], h) for *_, i in g)
    return out


@pytest.mark.parametrize("deliveries,share", [(1, 10_000), (3, 10_000), (2, 4)])
def test_members_equal_brute_force(spark, monkeypatch, tmp_path, deliveries, share):
    monkeypatch.setattr(exact, "HOT_SHARE", share)
    rows = exact_rows()
    index = exact.DigestIndex(spark, f"{tmp_path}/index", buckets=4)
    narrow = exact.digest_rows(docs(spark, rows).coalesce(3), F.pmod(F.col("row"), F.lit(deliveries)))
    for b in range(deliveries):
        index.add(narrow.where(F.col("batch") == b), b)
    got = exact.members(narrow, index).withColumn("h", F.lower(F.hex("digest")))
    # rows equal in id and text are one or the other: count them
    assert Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "h").collect()) == brute_members(rows)


def test_index_outlives_session_objects_and_repeats(spark, tmp_path):
    rows, place = exact_rows(), f"{tmp_path}/index"
    first, second = docs(spark, rows[:60]), docs(spark, rows[60:])
    index = exact.DigestIndex(spark, place, buckets=4)
    one = exact.new_documents(first, index, 0).collect()
    assert Counter(norm(r.text) for r in one) == Counter({norm(r[1]): 1 for r in rows[:60]})
    assert one[0].asDict().keys() == set(first.columns)
    again = exact.DigestIndex(spark, place, buckets=16)         # keeps the 4 it was made with
    assert again.buckets == 4
    two = exact.new_documents(second, again, 1).collect()
    assert Counter(norm(r.text) for r in two) == Counter({t: 1 for t in {norm(r[1]) for r in rows[60:]} - {norm(r[1]) for r in rows[:60]}})
    size = again.entries().count()
    assert len(exact.new_documents(second, again, 1).collect()) == len(two) and again.entries().count() == size
    assert len(exact.new_documents(first, again, 0).collect()) == len(one)
    assert exact.new_documents(first.limit(0), again, 2).count() == 0
    assert exact.new_documents(second, again, 3).count() == 0
    plan = again.entries().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Initial Plan")[-1]


def test_exact_empty(spark, tmp_path):
    index = exact.DigestIndex(spark, f"{tmp_path}/index")
    narrow = exact.digest_rows(plain(spark).limit(0))
    index.add(narrow, 0)
    assert exact.members(narrow, index).count() == 0


def test_pairs_pass_the_shuffle_as_differences(spark, monkeypatch):
    """Pair sums cross the shuffle as a few rows of packed differences; counts are those of all neighbours, also in many hand-overs."""
    P = phrases
    x = np.array([0, 1, 127, 128, 16_383, 16_384, (1 << 44) - 1, 1 << 55])
    assert (P._undo(P._deltas(x)) == x).all() and len(P._undo(P._deltas(x[:0]))) == 0
    monkeypatch.setattr(P, "PAIRS", 40)
    words = [f"w{i * i % 23}" for i in range(700)]
    docs = spark.createDataFrame([(i, "aa", " ".join(words[i:i + 7])) for i in range(0, 700, 7)], "doc_id long, lang string, text string")
    bits = spark.sparkContext.broadcast(np.full(P.BITS // 64, -1))
    found = P.pair_counts(docs.repartition(3), bits)
    want = {}
    for i in range(0, 700, 7):
        for a, b in zip(words[i:i + 7], words[i + 1:i + 7]):
            want[a, b] = want.get((a, b), 0) + 1
    assert sorted(r.c for r in found.collect()) == sorted(want.values())
    assert sorted(r.c for r in P.pair_counts(docs, bits, 700, 20).collect()) == sorted(c for c in want.values() if c >= 20)
    assert "pairs#" in found._jdf.queryExecution().executedPlan().toString()
