"""Operator 12: phrase collocations by multikey three-way quicksort of suffixes.

Texts are lower-cased (A-Z), split into pieces and words; everything is per language. A suffix
is a word with up to three words that follow it in its piece. Each batch sums equal suffixes
and hands them on with the number of leading words that route them: all suffixes that begin
with the same words meet in one task. That number is 2; suffixes that begin with a hot word
(more than a ``HOT`` part of all words, so at most ``HOT`` words) are routed by three words, those that
begin with two hot words by all four, and the counts of the shorter phrases go apart,
summed per batch: no phrase leads more than a ``HOT`` part of all suffixes into one task.

A task receives its suffixes sorted by route and takes them in buffers. Routes with fewer than
``LEAST`` occurrences are abandoned unread. The suffix pointers of the rest are sorted by multikey
three-way quicksort down to the maximum depth, all open partitions in step: each is cut at
a pivot word into smaller, equal and greater; equal partitions go one word deeper and their
sizes are the counts of the phrases they spell; partitions below LEAST are abandoned.
A route longer than a buffer is counted part by part without abandoning, and the parts are summed.

No candidate holds a rare word or a rare pair of neighbours. Words are counted exactly, pairs by 44-bit
hashes (a sum of collided pairs is only too high); bit tables of fixed size (``BITS``) over the frequent words and
pairs end the suffixes at the first rare one before the shuffle. What a table lets pass is counted all
the same, so a table that is full costs time, not results.

Scores are exact (38-digit decimals). Defined results: null texts are empty, a null language is "und"; ids
are not used, so repeated rows count each; languages without a candidate have no rows; an empty table has
none. Very long texts are cut into words in batches of their own; a piece ends with its text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, table, text_of

LEAST, DEPTH, TOP = 30, 4, 2000
#: A word is hot beyond this part of all words.
HOT = 500
#: Bytes of text cut at once (a longer text alone), rows of a buffer, suffixes planned for a task.
BYTES, BUFFER, TASK = 4_000_000, 1_000_000, 1_000_000
#: Bits of each table, of the frequent words and of the frequent pairs.
BITS = 1 << 25
#: Bits of a pair's hash.
HASH = 44
#: Pairs summed in a task before they are handed on.
PAIRS = 4_000_000
#: Capitals lowered; marks and line ends become the end of a piece (10), tabs blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
UND = "und"


def cut_words(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts and the number of each one's piece."""
    buf = np.frombuffer(b"\n".join(texts).translate(FOLD), np.uint8)
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = (buf != 32) & (buf != 10)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [
        None, pa.py_buffer(offsets), pa.py_buffer(buf[inside[1:-1]].tobytes())])
    return words.dictionary_encode(), np.cumsum(buf == 10)[start] if len(start) else start


def _parts(batch: pa.RecordBatch):
    """(lang, texts) of a batch with columns lang and text, in parts of at most BYTES."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        by_lang.setdefault(lang, []).append(text)
    for lang, texts in by_lang.items():
        part, size = [], 0
        for t in texts:
            if part and size + len(t) > BYTES:
                yield lang, part
                part, size = [], 0
            part.append(t)
            size += len(t) + 1
        yield lang, part


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"),
                       text_of().cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, c."""
    def run(batches):
        for b in batches:
            for lang, texts in _parts(b):
                words, _ = cut_words(texts)
                c = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.record_batch([pa.array([lang] * len(c), pa.string()), words.dictionary.cast(pa.string()),
                                       pa.array(c, pa.int64())], ["lang", "word", "c"])

    return (_texts(docs).mapInArrow(run, "lang string, word string, c long")
            .groupBy("lang", "word").agg(F.sum("c").alias("c")))


def _bit_table(place, rows: DataFrame) -> np.ndarray:
    """Bits of the places (a column of longs), BITS / 64 longs at most."""
    at = place.bitwiseAND(F.lit(BITS - 1))
    found = (rows.select(F.shiftright(at, 6).alias("at"), at.bitwiseAND(F.lit(63)).cast("int").alias("low"))
             .select("at", F.expr("shiftleft(1L, low)").alias("bit"))
             .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow())
    bits = np.zeros(BITS // 64, np.int64)
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return bits


def _has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    place = place & (len(bits) * 64 - 1)
    return ((bits[place >> 6] >> (place & 63)) & 1).astype(bool)


def _neighbours(lang: str, texts: list[bytes], bits: np.ndarray):
    """Words of the texts, their codes, whether each one and the next are frequent and of one piece, and the
    hash of the two."""
    words, piece = cut_words(texts)
    code = words.indices.to_numpy().astype(np.int64)
    start = zlib.crc32(lang.encode() + b"\n")
    place = np.array([zlib.crc32(w, start) for w in words.dictionary.to_pylist()], np.int64)
    often = _has(bits, place)[code] if len(code) else np.zeros(0, bool)
    x = place.astype(np.uint64)[code]
    h = (x[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ ((x[1:] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))).view(np.int64)
    return words, code, (piece[1:] == piece[:-1]) & often[1:] & often[:-1], h


def _deltas(x: np.ndarray) -> bytes:
    """Whole numbers of 0 or more as bytes of 7 bits, the lowest first, 128 added to all bytes of a number but its last."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 9):
        size += x >= np.uint64(1 << 7 * k)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(x) else 0, np.uint8)
    for k in range(int(size.max()) if len(x) else 0):
        some = size > k
        low = (x[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[(end - size)[some] + k] = low + np.where(size[some] > k + 1, np.uint64(128), np.uint64(0))
    return out.tobytes()


def _undo(data: bytes) -> np.ndarray:
    """The numbers of ``_deltas``."""
    b = np.frombuffer(data, np.uint8)
    last = b < 128
    end = np.flatnonzero(last) + 1
    start = np.r_[0, end[:-1]]
    out = np.zeros(len(end), np.uint64)
    for k in range(int((end - start).max()) if len(end) else 0):
        some = end - start > k
        out[some] += (b[start[some] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def _summed(parts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts, of (keys, counts) pairs."""
    keys, group = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    c = np.zeros(len(keys), np.int64)
    np.add.at(c, group, np.concatenate([c for _, c in parts]))
    return keys, c


def pair_counts(docs: DataFrame, bits, total: int = 0, least: int = 1) -> DataFrame:
    """pair (hash of HASH bits), c: neighbouring frequent words that occur ``least`` times or more; ``bits``: broadcast
    table of the frequent words. Tasks hand on their sums by ranges of the hash, ascending, as differences of a few bytes."""
    spark = docs.sparkSession
    # a range holds about TASK of the pairs (``total``: all words)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))

    def packed(keys, c):
        at = keys * ranges >> HASH
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(keys) else at
        stop = np.r_[first[1:], len(keys)]
        return pa.record_batch([
            pa.array(at[first], pa.int32()),
            pa.array([_deltas(np.diff(keys[i:j], prepend=0)) for i, j in zip(first, stop)], pa.binary()),
            pa.array([_deltas(c[i:j]) for i, j in zip(first, stop)], pa.binary())], ["part", "pairs", "counts"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for lang, texts in _parts(b):
                _, _, ok, h = _neighbours(lang, texts, bits.value)
                held.append(np.unique(h[ok] & ((1 << HASH) - 1), return_counts=True))
                size += len(held[-1][0])
                if size >= PAIRS:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size >= PAIRS // 2:
                        yield packed(*held[0])
                        held, size = [], 0
        if held:
            yield packed(*_summed(held))

    def total_of(t: pa.Table) -> pa.Table:
        keys, c = _summed([(np.cumsum(_undo(p)), _undo(n)) for p, n in zip(t.column("pairs").to_pylist(), t.column("counts").to_pylist())])
        return pa.table({"pair": keys[c >= least], "c": c[c >= least]})

    return (_texts(docs).mapInArrow(run, "part int, pairs binary, counts binary")
            .groupBy("part").applyInArrow(total_of, "pair long, c long"))


def _equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and group number of equal rows of small integer columns."""
    group = keys[0].astype(np.int64)
    for k in keys[1:]:
        _, group = np.unique(group * (int(k.max()) + 1 if len(k) else 1) + k, return_inverse=True)
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    return first, group


def _phrases(words: pa.DictionaryArray, codes: np.ndarray, size: np.ndarray) -> pa.Array:
    """The first ``size`` words of each row of ``codes``, with blanks between."""
    take = np.arange(codes.shape[1])[None, :] < size[:, None]
    flat = words.dictionary.take(pa.array(codes[take]))
    cut = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(cut, flat.cast(pa.string())), " ")


def suffixes(docs: DataFrame, bits, pairs, hot: dict[str, set[bytes]], depth: int = DEPTH) -> DataFrame:
    """lang, phrase, lead, c: the suffixes of two words or more, summed within batches. A row counts for the
    phrases of ``lead`` words and more that it begins with. ``bits``, ``pairs``: broadcast tables of the frequent
    words and pairs."""
    def run(batches):
        for b in batches:
            for lang, texts in _parts(b):
                words, code, ok, h = _neighbours(lang, texts, bits.value)
                if not ok.any():
                    continue
                ok &= _has(pairs.value, h)
                names = words.dictionary.to_pylist()
                is_hot = np.array([w in hot.get(lang, ()) for w in names])
                # each word with those that follow it over frequent pairs, up to depth
                n = len(code)
                codes = np.zeros((n, depth), np.int64)
                codes[:, 0] = code
                go, size = np.ones(n, bool), np.ones(n, np.int64)
                for k in range(1, depth):
                    go[:n - k] &= ok[k - 1:]
                    go[n - k:] = False
                    codes[:n - k, k] = code[k:]
                    size += go
                some = np.flatnonzero(size >= 2)
                codes, size = codes[some], size[some]
                codes[np.arange(depth)[None, :] >= size[:, None]] = 0
                h1 = is_hot[codes[:, 0]]
                lead = 2 + h1 + (h1 & is_hot[codes[:, 1]])
                lead = np.minimum(lead, depth)
                # (rows, words they hold, words that route them)
                sets = [(np.flatnonzero(size >= lead), None, None)]
                sets += [(np.flatnonzero((lead > k) & (size >= k)), k, k) for k in range(2, depth)]
                for rows, held, fixed in sets:
                    if not len(rows):
                        continue
                    s = size[rows] if held is None else np.full(len(rows), held)
                    x = codes[rows][:, :held]
                    # words beyond the suffix count as another code than the first word
                    keys = [np.where(k < s, x[:, k] + 1, 0) for k in range(x.shape[1])]
                    first, group = _equal(*keys)
                    yield pa.record_batch([
                        pa.array([lang] * len(first), pa.string()), _phrases(words, x[first], s[first]),
                        pa.array(lead[rows][first] if fixed is None else np.full(len(first), fixed), pa.int32()),
                        pa.array(np.bincount(group), pa.int64())], ["lang", "phrase", "lead", "c"])

    return _texts(docs).mapInArrow(run, "lang string, phrase string, lead int, c long")


def quicksort(keys: np.ndarray, weight: np.ndarray, bounds: np.ndarray, least) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of the rows of ``keys`` (-1: the suffix has ended), all partitions in step.

    ``bounds`` are the first rows of the partitions at the start, in order. Returns (row, depth, weight) of every
    equal partition that weighs ``least`` (one number for each partition at the start) or more."""
    found = []
    rows = np.arange(len(keys))
    part = np.repeat(np.arange(len(bounds)), np.diff(np.r_[bounds, len(keys)]))
    depth, need = np.zeros(len(bounds), np.int64), np.broadcast_to(least, len(bounds))
    while len(rows):
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        size = np.diff(np.r_[first, len(rows)])
        key = keys[rows, depth[part]]
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]    # the median of three
        side = part * 3 + (key >= pivot) + (key > pivot)
        order = np.argsort(side, kind="stable")
        rows, side = rows[order], side[order]
        first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
        w, old, kind = np.add.reduceat(weight[rows], first), side[first] // 3, side[first] % 3
        equal = kind == 1
        ended = equal & (keys[rows[first], depth[old]] < 0)
        heavy = (w >= need[old]) & ~ended
        deep = depth[old] + equal
        said = heavy & equal
        found.append((rows[first[said]], deep[said], w[said]))
        live = heavy & (deep < keys.shape[1])
        stay = np.repeat(live, np.diff(np.r_[first, len(rows)]))
        part = np.repeat(np.cumsum(live) - 1, np.diff(np.r_[first, len(rows)]))[stay]
        rows, depth, need = rows[stay], deep[live], need[old][live]
    return found


def _count(batch: pa.Table, least: np.ndarray, bounds: np.ndarray):
    """Counted phrases of a buffer: its routes begin at ``bounds``; ``least`` of each."""
    weight = batch.column("c").to_numpy()
    total = np.add.reduceat(weight, bounds)
    size = np.diff(np.r_[bounds, len(weight)])
    keep = total >= least
    if not keep.any():
        return None
    batch = batch.filter(pa.array(np.repeat(keep, size)))
    weight, bounds, least = batch.column("c").to_numpy(), np.r_[0, np.cumsum(size[keep])[:-1]], least[keep]
    lists = pc.split_pattern(batch.column("phrase").combine_chunks(), " ")
    words = lists.flatten().dictionary_encode()
    count = lists.value_lengths().to_numpy()
    lang = batch.column("lang").combine_chunks().dictionary_encode()
    lead = batch.column("lead").to_numpy()
    # language and lead before the words: routes whose hashes are equal by chance stay apart
    keys = np.full((len(count), DEPTH + 2), -1, np.int64)
    keys[:, 0], keys[:, 1] = lang.indices.to_numpy(), lead
    row = np.repeat(np.arange(len(count)), count)
    keys[row, 2 + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = words.indices.to_numpy()
    found = quicksort(keys, weight, bounds, least)
    at, depth, w = (np.concatenate(x) for x in zip(*found))
    good = depth - 2 >= lead[at]
    at, depth, w = at[good], depth[good] - 2, w[good]
    return pa.record_batch([lang.dictionary.take(pa.array(lang.indices.to_numpy()[at])),
                            _phrases(words, keys[at, 2:], depth), pa.array(w, pa.int64())], ["lang", "phrase", "a"])


def _counter(min_count: int):
    """mapInArrow function over suffixes sorted by route."""
    def run(batches):
        held, open_route = [], None     # open_route: a route that is counted in parts

        def flush(last: bool):
            nonlocal held, open_route
            if not held:
                return
            buffer = pa.Table.from_batches(held)
            route = buffer.column("route").to_numpy()
            bounds = np.flatnonzero(np.r_[True, route[1:] != route[:-1]])
            least = np.full(len(bounds), min_count)
            if open_route is not None and route[0] == open_route:
                least[0] = 1
            if not last and len(bounds) > 1:        # the last route may go on
                stop = int(bounds[-1])
                held = buffer.slice(stop).combine_chunks().to_batches()
                buffer, bounds, least = buffer.slice(0, stop), bounds[:-1], least[:-1]
            elif not last:
                open_route, least[0], held = route[0], 1, []
            else:
                held = []
            out = _count(buffer, least, bounds)
            if out is not None and out.num_rows:
                yield out

        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= BUFFER:
                yield from flush(False)
                rows = sum(x.num_rows for x in held)
        yield from flush(True)
    return run


def phrase_counts(docs: DataFrame, words: DataFrame, total: int, min_count: int = LEAST) -> DataFrame:
    """lang, phrase, a of the phrases of 2 to DEPTH words that occur ``min_count`` times or more; ``words``: counted words."""
    spark = docs.sparkSession
    hot: dict[str, set[bytes]] = {}
    for r in words.where(F.col("c") * HOT > total).collect():       # HOT words at most
        hot.setdefault(r["lang"], set()).add(r["word"].encode())
    often = words.where(F.col("c") >= min_count)
    bits = spark.sparkContext.broadcast(_bit_table(F.crc32(F.concat("lang", F.lit("\n"), "word").cast("binary")), often))
    pairs = spark.sparkContext.broadcast(_bit_table(F.col("pair"), pair_counts(docs, bits, total, min_count)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    route = F.xxhash64("lang", "lead", F.expr("substring_index(phrase, ' ', lead)"))
    # the route is computed on both sides of the shuffle: its 8 bytes a suffix do not pass it
    routed = (suffixes(docs, bits, pairs, hot).repartition(tasks, route).withColumn("route", route)
              .sortWithinPartitions("route").select("route", "lang", "phrase", "lead", "c"))
    return (routed.mapInArrow(_counter(min_count), "lang string, phrase string, a long")
            .groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count))


def collocations(docs: DataFrame, min_count: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases."""
    words = table(word_counts(docs))
    sizes = words.groupBy("lang").agg(F.sum("c").alias("n"))
    total = words.agg(F.sum("c")).first()[0] or 0
    found = table(phrase_counts(docs, words, total, min_count)
                  .withColumn("size", F.size(F.split("phrase", " "))))
    known = found.select("lang", "phrase", "a").unionByName(
        words.where(F.col("c") >= min_count).select("lang", F.col("word").alias("phrase"), F.col("c").alias("a")))
    part = F.split("phrase", " ")
    cuts = (found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .withColumns({"head": F.array_join(F.slice(part, F.lit(1), F.col("k")), " "),
                          "tail": F.array_join(F.slice(part, F.col("k") + 1, F.col("size")), " ")}))
    left = known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    wide = "decimal(38,0)"
    scored = (cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"])
              .withColumn("score", F.expr(f"cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as {wide}) + r)"))
              .groupBy("lang", "phrase", "a", "size").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
              .select("lang", "phrase", "a", "size", "low.score", "low.l", "low.r"))
    # the strongest longer candidate that holds a phrase
    inner = (found.where(F.col("size") > 2)
             .withColumn("held", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
             .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("held") + 1)))
             .select("lang", F.array_join(F.slice(part, F.col("at"), F.col("held")), " ").alias("phrase"),
                     F.col("a").alias("longer"))
             .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(19,0)") < 80 * F.col("a").cast("decimal(19,0)"))))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # first within parts of a language, so that no task sorts a whole one
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    best = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    return (best.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= top)
            .join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op12_multikey_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, '{UND}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, ws[i:i+k-1] AS x FROM (
        SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {DEPTH + 1})) AS k))),
f AS (SELECT lang, k, x, count(*) AS a FROM g GROUP BY lang, k, x),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= {LEAST}),
cut AS (SELECT c.*, j, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * c.a) // (l.a + r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.x = c.x[1:c.j] JOIN f r ON r.lang = c.lang AND r.x = c.x[c.j+1:c.k]),
s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, j) = 1),
inner_ AS (SELECT lang, x[i:i+h-1] AS x, max(a) AS longer FROM (
    SELECT lang, x, a, k, h, unnest(range(1, k - h + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS h FROM c WHERE k > 2)) GROUP BY 1, 2)
SELECT s.lang, row_number() OVER o AS rank, array_to_string(s.x, ' ') AS phrase, s.a, s.l, s.r, n.n, s.score
FROM s JOIN n ON n.lang = s.lang LEFT JOIN inner_ i ON i.lang = s.lang AND i.x = s.x
WHERE i.longer IS NULL OR 100 * i.longer < 80 * s.a
WINDOW o AS (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, array_to_string(s.x, ' ')) QUALIFY row_number() OVER o <= {TOP}"""
