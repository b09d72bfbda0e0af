"""Quality rules, SimHash, substring dedup and personal data against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from messy import LONG, PASSAGE, SCHEMA, TEXTS, docs, plain
from loanlens.llm import pii, quality, simhash, substring
from loanlens.llm.graph import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- quality
def brute_counts(text):
    w = WORDS.findall(text or "")
    grams = defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i:i + 5])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    rnd = random.Random(3)
    more = [(100 + i, " ".join(rnd.choice("a b c dd|#".split()) for _ in range(rnd.randint(0, 60))).replace("dd", "x\n"),
             "en", "s") for i in range(40)]
    df, names = quality.add_counts(docs(spark, TEXTS + more))
    rows = df.select("text", *[names[c] for c in quality.COUNTS]).collect()
    assert len(rows) == len(TEXTS) + 40
    for r in rows:
        assert tuple(r[1:]) == brute_counts(r[0]), r[0]


def test_binomial_tail(spark):
    cases = [(100, 0, 0.01), (1000, 3, 0.01), (5000, 40, 0.01), (20, 1, 0.2)]
    df = spark.createDataFrame([(n, k) for n, k, _ in cases], "n long, k long")
    for n, k, p in cases:
        got = df.where((F.col("n") == n) & (F.col("k") == k)).select(
            quality._log_binomial_tail(F.col("n"), F.col("k"), p)).first()[0]
        want = math.log(sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)))
        assert got == pytest.approx(want, rel=1e-9)
    big = spark.createDataFrame([(2_000_000, 100)], "n long, k long").select(
        quality._log_binomial_tail(F.col("n"), F.col("k"), 0.01)).first()[0]
    assert -20_200 < big < -19_000         # no underflow to certainty


def test_quality_certifies_only_with_evidence(spark):
    clean = "these are plain words of a clean text number %d with some length in it for the rule"
    bad = "these |||| are #### words of ||| a bad text $$$ number %d with &&& marks in <<<< it for ||| rule"
    rows = [(i, clean % i, "en", "s") for i in range(2000)] + [(5000 + i, bad % i, "en", "s") for i in range(50)]
    rows += [(9000 + i, bad % i, "fr", "s") for i in range(20)]       # too few labels in this stratum
    d = plain(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2000)] + [(5000 + i, 0, 0) for i in range(50)]
                                   + [(9000 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0), (0, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.quality_filter(d, labels).collect()}
    assert set(range(2000)) <= kept and not kept & set(range(5000, 5050)) and set(range(9000, 9020)) <= kept
    none = quality.quality_filter(d, labels.limit(0))
    assert none.count() == len(rows) and none.columns == d.columns


def test_quality_messy(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark)
    out = quality.quality_filter(d, labels)
    assert out.columns == d.columns
    want = sorted((t[0] or -1) for t in TEXTS if (b := brute_counts(t[1]))[0] >= 10 and 100 * b[4] <= 20 * b[0])
    assert sorted((r.doc_id or -1) for r in out.collect()) == want
    assert quality.quality_filter(d.limit(0), labels).count() == 0


def test_quality_equals_the_sql_where_cutoffs_certify(spark):
    """sf0.1 holds enough labels for the cutoffs of one language."""
    import duckdb
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(quality.ORACLE).fetchall()
    got = quality.op8_quality_rules(spark, sf)
    assert got.columns == [d[0] for d in con.execute(quality.ORACLE + " LIMIT 0").description]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    rejected = [r for r in want if not r[-1] and not r[-2]]
    assert rejected                                             # by a certified cutoff alone


# ---------------------------------------------------------------- simhash
def brute_fingerprint(text, k=3):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=2):
    keys = list(fps)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    return {k: find(k) for k in keys}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark):
    got = simhash.fingerprints(docs(spark)).collect()
    want = Counter((t[0], signed(brute_fingerprint(t[1]))) for t in TEXTS)
    assert Counter((r.doc_id, r.fp) for r in got) == want


@pytest.mark.parametrize("group,bits", [(4096, 2), (8, 2), (8, 0), (16, 3)])
def test_trie_join_equals_all_pairs(spark, monkeypatch, group, bits):
    """Small groups force the descent on the cluster; the components must not change."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rnd = random.Random(group + bits)
    centres = [rnd.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = set(centres)
    for c in centres[:6]:
        for _ in range(40):
            x = c
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(60)}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = simhash.link_fingerprints(df, bits)
    for r in links.collect():
        assert ((r.a & (1 << 64) - 1) ^ (r.b & (1 << 64) - 1)) >= 0
    got = {r.node: r.root for r in components(links).collect()}
    got = {f: got.get(signed(f), signed(f)) for f in fps}
    want = brute_components(fps, bits)
    classes = defaultdict(set)
    for f in fps:
        classes[want[f]].add(got[f])
    assert all(len(c) == 1 for c in classes.values())
    assert len({min(c) for c in classes.values()}) == len(classes)


def test_components_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}
    assert components(edges.limit(0)).count() == 0


def test_near_dedup(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(i, base, "en", "s") for i in range(3, 9)] + [(20, base + " tail", "en", "s"), (21, "other text of few words", "en", "s")]
    d = docs(spark, rows + TEXTS)
    out = simhash.near_dedup(d)
    assert out.columns == d.columns
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.text) for r in out.collect() if r.text)
    fps = {}
    for t in rows + TEXTS:
        fps.setdefault(brute_fingerprint(t[1]), []).append(t)
    comp = brute_components(fps)
    groups = defaultdict(list)
    for f, ts in fps.items():
        groups[comp[f]] += ts
    assert len(out.collect()) == len(groups)
    for ts in groups.values():
        ids = [t[0] for t in ts if t[0] is not None]
        if any(t[1] for t in ts) and len(ids) == len(ts):
            kept = [g for g in got if g in [(t[0], t[1]) for t in ts]]
            assert all(k[0] == min(ids) for k in kept)
    assert simhash.near_dedup(d.limit(0)).count() == 0


# ---------------------------------------------------------------- substring
M64 = (1 << 64) - 1


def mix64(x):
    x = (x ^ x >> 32) * 0x94D049BB133111EB & M64
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & M64
    return x ^ x >> 32


def word_hash(word):
    power, total = 1, len(word)
    for c in word:
        total += mix64(ord(c) + 0x9E3779B97F4A7C15 & M64) * power
        power = power * 0xD6E8FEB86659FD93 & M64
    return mix64(total & M64)


def two(a, b):
    return mix64(a * 0x9E3779B97F4A7C15 + (b ^ b >> 31) & M64)


def brute_units(text):
    """Sentences and chosen windows in plain Python: (first word, word behind, start, end, content)."""
    low, origin = [], []
    for i, c in enumerate(text):        # letters may grow in lower case
        low.append(c.lower())
        origin += [i] * len(c.lower())
    low = text.lower() if len(text.lower()) == len(text) else "".join(low)
    words = [(origin[m.start()], origin[m.end() - 1] + 1, m[0]) for m in re.finditer(r"\w+", low)]
    marks = [m.span() for m in re.finditer(r"(?<=[.!?])[ \t]+|\n+", text)]
    out = []
    for s, e in zip([0] + [e for _, e in marks], [s for s, _ in marks] + [len(text)]):
        inside = [k for k, w in enumerate(words) if s <= w[0] < e]
        if inside:
            out.append((inside[0], inside[-1] + 1, s, e, ("unit", *(words[k][2] for k in inside))))
    W, S = substring.WINDOW, substring.SPREAD
    h = [word_hash(w[2]) for w in words]
    pairs = [two(a, b) for a, b in zip(h, h[1:])]
    fours = [two(pairs[i], pairs[i + 2]) for i in range(len(pairs) - 2)]
    least = [two(two(fours[i], fours[i + 4]), fours[i + 8]) for i in range(len(words) - W + 1)]
    chosen = {i + k for i in range(len(least) - S + 1) for k in range(S) if least[i + k] == min(least[i:i + S])}
    if 0 < len(least) < S:
        chosen = {least.index(min(least))}
    return out + [(i, i + W, words[i][0], words[i + W - 1][1], ("window", *(w[2] for w in words[i:i + W]))) for i in sorted(chosen)]


def brute_repeats(rows, min_words=substring.MIN_WORDS):
    """Removed spans per (id, text), rows that share an id being one document."""
    first, out = {}, {}
    rank = lambda i: math.inf if i is None else i
    units = {(t[0], t[1] or ""): brute_units(t[1] or "") for t in rows}
    for (i, _), found in units.items():
        for *_, content in found:
            first[content] = min(first.get(content, math.inf), rank(i))
    for (i, text), found in units.items():
        covered, seen = [], set()
        for w0, w1, s, e, content in found:
            if rank(i) > first[content] or (content[0] == "unit" and content in seen):
                covered.append((w0, w1, s, e))
            seen.add(content)
        runs = []
        for w0, w1, s, e in sorted(covered):
            if runs and w0 <= runs[-1][1]:
                r = runs[-1]
                runs[-1] = (r[0], max(r[1], w1), min(r[2], s), max(r[3], e))
            else:
                runs.append((w0, w1, s, e))
        out[(i, text)] = [(s, e) for w0, w1, s, e in runs if w1 - w0 >= min_words]
    return out


def test_substring_dedup(spark):
    rnd = random.Random(1)
    vocabulary = [f"v{i}" for i in range(300)]
    shared = [" ".join(rnd.choice(vocabulary) for _ in range(60)) + "." for _ in range(3)]
    rows = []
    for i in range(40):
        own = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 30))).capitalize() + rnd.choice([".", "!", ""])
               for _ in range(5)]
        own.insert(rnd.randrange(6), rnd.choice(shared + ["Short line.", "Short line."]))
        rows.append((50 + i, "\n".join(own), "en", "s"))
    rows += TEXTS
    d = docs(spark, rows)
    out, spans = substring.remove_repeats(d)
    want = brute_repeats(rows)
    got = out.select("doc_id", "text", spans).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, s.start, s.end) for r in got for s in r[2] or []} == {(i, s, e) for (i, _), c in want.items() for s, e in c}
    assert "both" in {s.by for r in got for s in r[2] or []} <= {"unit", "window", "both"}
    texts = Counter()
    for (i, text), cut in want.items():
        n = sum(1 for t in rows if t[0] == i and (t[1] or "") == text)
        left, at = "", 0
        for s, e in cut:
            left, at = left + text[at:s], e
        texts[(i, left + text[at:])] += n
    assert Counter((r.doc_id, r.text or "") for r in got) == texts
    repeats = sum(len(c) > 0 for c in want.values())
    assert repeats >= 15 and out.columns[:len(d.columns)] == d.columns
    one = [r for r in got if r.doc_id == 7]
    assert len(one) == 2 and all(PASSAGE.split(".")[1] not in r.text for r in one)     # 1 keeps the passage, 7 loses it
    assert substring.remove_repeats(d.limit(0))[0].count() == 0
    assert substring.substring_dedup(d).columns == d.columns


def test_substring_dedup_inside_sentences(spark):
    """Passages that begin and end inside a sentence, with and without whole sentences in them."""
    rnd = random.Random(11)
    own = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=7)) for _ in range(n))
    rows, want = [], {}
    for k, (words, stops) in enumerate([(50, (24,)), (60, ()), (55, (10, 30)), (120, (59,)), (20, ())]):
        w = own(words).split()
        passage = " ".join(x + "." if i in stops else x for i, x in enumerate(w))
        for copy in range(3):
            i = 100 + 10 * k + copy
            rows.append((i, f"İ {own(9)} {passage} {own(8)}. {own(30)}.", "en", "s"))
            want[i] = (words, passage, copy)
    out, spans = substring.remove_repeats(docs(spark, rows))
    text = {r[0]: r[1] for r in rows}
    for r in out.select("doc_id", "text", F.col(spans).alias("s")).collect():
        words, passage, copy = want[r.doc_id]
        if copy == 0 or words < substring.MIN_WORDS:
            assert r.s is None and r.text == text[r.doc_id]
            continue
        (s,) = r.s
        at = text[r.doc_id].index(passage)
        assert at <= s.start < s.end <= at + len(passage)
        assert s.words > words - 2 * substring.SPREAD and r.doc_id - copy <= s.source < r.doc_id
        assert s.by == ("window" if "." not in passage else "both" if passage.count(".") > 1 else s.by)
        assert r.text == text[r.doc_id][:s.start] + text[r.doc_id][s.end:]


# ---------------------------------------------------------------- personal data
def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute_base(text):
    text = text or ""
    out = []
    for n, (kind, p) in enumerate([
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII = ["a@b.c_d@e.f", "x@y", "x@y.z.", "a@b.c@d.e.f", "é.a@b.com 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255",
       "4539 1488 0343 6467 4539-1488-0343-6467 12 4539148803436467 1", "45391488034364671 6011000990139424--5",
       "+1 (202) 555-0100 +12 +1++49 30 1234567. +1-", "1" * 5000, "1 " * 5000, "a" * 50_000 + "@b.cd", "@" * 3000,
       "+1" + " " * 3000 + "2", "𝔘 a@b.cd 𝔘 10.0.0.1", "5 4 3 2 1 5 4 3 2 1 5 4 3 2 1 5 4 3 2 1 9",
       "DE89 3704 0044 0532 0130 00 and DE89370400440532013001 ssn 123-45-6789, forty characters or more behind it plain 123-45-6789"]


def test_pii_base(spark):
    rnd = random.Random(5)
    soup = ["".join(rnd.choice("0123456789  --..@+ab()é\n") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    rows = [(100 + i, t, "en", "s") for i, t in enumerate(PII + soup)] + TEXTS
    df, spans = pii.add_spans(docs(spark, rows))
    got = df.select("text", F.col(spans).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        base = [f"{pii.KINDS[x.kind]}:{x.start}:{x.end}" for x in r.s if x.kind < 4]
        assert base == brute_base(r.text), r.text[:200]


def test_pii_added_and_redacted(spark):
    d = docs(spark, [(1, PII[-1], "en", "s"), (2, None, "en", "s"), (3, "mail me: a@b.cd, bye", "en", "s"),
                     (4, "+4539148803436467", "en", "s")])
    df, spans = pii.add_spans(d)
    got = {r.doc_id: [pii.KINDS[x.kind] for x in r[spans]] for r in df.collect()}
    assert got[1].count("iban") == 1 and got[1].count("ssn") == 1 and got[2] == []
    red = pii.redact(d)
    text = {r.doc_id: r.text for r in red.collect()}
    assert red.columns == d.columns
    assert text[2] is None and text[3] == "mail me: <EMAIL>, bye"
    assert text[1] == "<IBAN> and DE89370400440532013001 ssn <SSN>, forty characters or more behind it plain 123-45-6789"
    assert text[4] == "+<CARD>"
    assert pii.redact(d.limit(0)).count() == 0


def test_pii_iban_ends(spark):
    """Capitals, digits and further IBANs behind an IBAN; the country's length decides its end."""
    de, gb, no = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    body = "370400440532013"
    other = f"ZZ{98 - int(''.join(str(int(c, 36)) for c in body + 'ZZ00')) % 97:02d}{body}"    # a country not listed
    cases = [(de + " Please call", [de]), (de + " 12 May", [de]), (de, [de]), (de + ".", [de]), (de + "X", []),
             ("DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
             (f"{gb} {de} {no} A1 B2", [gb, de, no]), (f"é𝔘 {no} {'9 ' * 40}", [no]),
             (other + " AND MORE", [other]), ("DE89370400440532013001 Please call", []), (de[:-2] + " 00", [de[:-2] + " 00"]),
             ("AB12 " * 2000, None)]
    d = docs(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(cases)])
    df, spans = pii.add_spans(d)
    got = {r.doc_id: [r.text[x.start:x.end] for x in r[spans] if pii.KINDS[x.kind] == "iban"] for r in df.collect()}
    red = {r.doc_id: r.text for r in pii.redact(d).collect()}
    for i, (text, want) in enumerate(cases):
        if want is not None:
            assert got[i] == want, text
    assert red[0] == "<IBAN> Please call" and red[5] == "<IBAN> BIC COBADEFF" and red[6] == "<IBAN> <IBAN> <IBAN> A1 B2"


def test_pii_query_digest(spark, tmp_path):
    plain(spark, [(1, PII[4], "en", "s"), (2, None, "en", "s")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.op4_pii_spans(spark, str(tmp_path)).collect()}
    base = ",".join(brute_base(PII[4]))
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[1].spans == base
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].n_ip == 0


def test_links_of_a_dense_group():
    """All leaves within one bit of a centre: a spanning forest, not all pairs."""
    rot = np.sort(np.array([0, *[1 << b for b in range(40)]], np.uint64))
    start = np.zeros(len(rot), bool)
    start[0] = True
    i, j = simhash.trie_links(rot, start, np.zeros(len(rot), np.int64), 0, 2)
    assert len(i) == len(rot) - 1 and set(j.tolist()) == {0}
    assert LONG and SCHEMA


def test_pii_query_counts_every_kind(spark, tmp_path):
    """Several spans of a kind, and kinds that are not at the place of their number, are all counted."""
    rows = [(0, "a@b.co, c@d.org and e@f.net"), (1, "call +1 555 123 4567 or +1 555 123 4568"), (2, "1.2.3.4 x@y.zz 10.0.0.1"),
            (3, "4111 1111 1111 1111"), (4, ""), (5, None)]
    plain(spark, [(*r, "en", "s") for r in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in pii.op4_pii_spans(spark, str(tmp_path)).collect()}
    for i, text in rows:
        base = brute_base(text or "")
        assert got[i] == (*(sum(x.startswith(f"{k}:") for x in base) for k in ("email", "ip", "card", "phone")), ",".join(base))
