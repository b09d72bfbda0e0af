"""Operator 3: repeated passages by line hashing, extended by word windows.

Texts are cut into units (sentences within lines by default; whole lines or
paragraphs on request). A unit is normalised (lower case, words only) and hashed to 96
bits. Over all documents the digests are grouped and the earliest occurrence in
rank (smallest doc_id, then position) keeps its place; every other occurrence is a
repeat. Repeats within a document are seen where it is cut into units.

Windows of ``WINDOW`` words extend the units to passages that begin or end inside one:
of every ``SPREAD`` windows that follow each other the one with the smallest hash is
hashed too (winnowing), so equal words choose equal windows wherever they stand. A window
is a repeat if an earlier document holds it. At each end of a passage fewer than
``SPREAD`` words that belong to no whole unit can stay; repeats of MIN_WORDS + 2 *
(SPREAD - 1) words are always found. Repeats within one document are found as whole
units only.

Stretches of words that repeated units and windows cover without a gap and that hold ``MIN_WORDS``
words or more are removed. Offsets are those of the original text (code points, end
exclusive), each with an earlier document that holds a unit of the stretch (the document itself
for repeats within it) and with the stage that found it: unit, window or both.

Texts are cut once. Of the occurrences that are cut together all but the earliest are known
repeats; only the earliest meets the other batches, so that a digest that every document
holds is one row a batch. One exchange of narrow rows by digest, sorted by rank, finds the
repeats with a running first value; they alone go on to their documents. Texts without a repeat are
not shuffled: a bit table of ``DOC_BITS`` bits tells most of them (the rest meet the spans and find none).

Short repeated units alone ("Of.") stay, as do single short boilerplate lines.
Defined results: null and empty texts have no units and stay as they are; rows that
share a doc_id are one document, so units that only they hold are no repeats of each
other; rows without id are one document that ranks last; an empty table stays empty. Very long texts
are cut alone, whole.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, read_table, table, text_of

MIN_WORDS = 25
#: Words of a window; one of every SPREAD windows in a row is chosen (at most WINDOW, so that windows leave no gap).
WINDOW, SPREAD = 12, 12
#: Bits of the table of documents with repeats: it only spares texts the shuffle.
DOC_BITS = 1 << 24
#: Characters that are cut at once (a longer text is cut alone).
CHARS = 2_000_000
#: Rank of documents without id: behind all others.
NO_ID = (1 << 63) - 1
SEPARATOR = {
    "sentence": re.compile(r"(?<=[.!?])[ \t]+|\n+"),
    "line": re.compile(r"\n+"),
    "paragraph": re.compile(r"\n[ \t]*\n\s*"),
}
#: The sentence separators with the mark before them: begins with a set of characters, so that it is found fast.
AFTER_MARK = re.compile(r"[.!?\n](?:(?<=\n)\n*|(?<=[.!?])[ \t]+)")
WORD = re.compile(r"\w+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair; pairs are not empty, in order, and do not overlap."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    part = values[np.repeat(start, size) + at] * _powers(base, int(size.max()))[at]
    return _mixed(np.add.reduceat(part, np.cumsum(size) - size) + size.astype(np.uint64))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    return _mixed(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))))


@functools.cache
def _is_word() -> np.ndarray:
    return np.array([WORD.match(chr(c)) is not None for c in range(0x110000)])


def words_in(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of the text in lower case, given in ``text``, and its hash."""
    low = text.lower()
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.zeros(len(code) + 2, np.int8)
    word[1:-1] = _is_word()[code]
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    h = _sums(_mixed(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), start, end, 0xD6E8FEB86659FD93)
    if len(low) != len(text):           # a letter that grows in lower case
        origin = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
        start, end = origin[start], origin[end - 1] + 1
    return start, end, h


def windows(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each chosen window; ``owner`` has the text of each word, in order."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    two = _join(h[:-1], h[1:])
    four = _join(two[:-2], two[2:])
    w = _join(_join(four[:n], four[4:4 + n]), four[8:8 + n])
    own = owner[:n] == owner[WINDOW - 1:]
    chosen = np.zeros(n, bool)
    m = n - SPREAD + 1
    if m > 0:       # a window is chosen if it is the smallest of any SPREAD in a row of its text
        low = np.lib.stride_tricks.sliding_window_view(w, SPREAD)
        least = functools.reduce(np.minimum, (low[:, k] for k in range(SPREAD)))
        whole = owner[:m] == owner[SPREAD + WINDOW - 2:]
        for k in range(SPREAD):
            chosen[k:k + m] |= whole & (w[k:k + m] == least)
    # texts of fewer than SPREAD windows
    at = np.flatnonzero(own)
    first = np.flatnonzero(np.r_[True, owner[at][1:] != owner[at][:-1]]) if len(at) else at
    for lo, hi in zip(first, [*first[1:], len(at)]):
        if hi - lo < SPREAD:
            chosen[at[lo] + w[at[lo]:at[lo] + hi - lo].argmin()] = True
    at = np.flatnonzero(chosen)
    return at, w[at]


def _breaks(text: str, unit: str):
    """Start and end of the separators."""
    if unit != "sentence":
        return [m.span() for m in SEPARATOR[unit].finditer(text)]
    return [(m.start() + (text[m.start()] != "\n"), m.end()) for m in AFTER_MARK.finditer(text)]


def cut(texts: list[str], unit: str = "sentence") -> list[np.ndarray]:
    """Columns of the units and chosen windows of all texts: text, first word, word behind, start, end,
    digest (a long and an int), 1 for repeats in a text, 1 for windows."""
    spans, units, hashes, owner, before = [], [], [], [], [0]
    for i, text in enumerate(texts):
        start, end, h = words_in(text)
        cuts = np.array([(0, 0), *_breaks(text, unit), (len(text), len(text))], np.int64)
        s, e = cuts[:-1, 1], cuts[1:, 0]
        w0, w1 = np.searchsorted(start, s), np.searchsorted(start, e)
        some = w1 > w0
        units.append(np.stack([np.full(len(s), i), w0, w1, s, e])[:, some])
        spans.append(np.stack([start, end]))
        hashes.append(h)
        owner.append(np.full(len(h), i))
        before.append(before[-1] + len(h))
    h, owner, spans, units = (np.concatenate(x, -1) for x in (hashes, owner, spans, units))
    before = np.array(before)
    lo, hi = units[1] + before[units[0]], units[2] + before[units[0]]
    h1, h2 = _sums(h, lo, hi, 0xA0761D6478BD642F).view(np.int64), _second(h, lo, hi)
    order = np.lexsort((units[1], h2, h1, units[0]))
    a, b = order[1:], order[:-1]
    again = np.zeros(len(h1), np.int64)
    again[a[(units[0][a] == units[0][b]) & (h1[a] == h1[b]) & (h2[a] == h2[b])]] = 1
    at, w = windows(h, owner)
    i = owner[at]
    first = at - before[i]
    none = np.zeros(len(at), np.int64)
    more = (i, first, first + WINDOW, spans[0][at], spans[1][at + WINDOW - 1], w.view(np.int64),
            _second(h, at, at + WINDOW), none, none + 1)
    return [np.concatenate(x) for x in zip((*units, h1, h2, again, np.zeros(len(h1), np.int64)), more)]


def _second(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """32 further bits of a digest."""
    return (_sums(h, lo, hi, 0xE7037ED1A0B428DB) >> np.uint64(32)).astype(np.int64) - (1 << 31)


def _parts(texts: list[str]):
    """Ranges of texts of at most CHARS characters."""
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if texts:
        yield lo, len(texts)


def unit_table(docs: DataFrame, unit: str = "sentence") -> DataFrame:
    """One row per unit and chosen window: its document, first word, number of words (0: a window), start, length,
    digest, and for known repeats the document they repeat (source) and a key of their own."""
    def run(batches):
        for b in batches:
            texts, ranks = b.column(2).to_pylist(), b.column(0).fill_null(NO_ID).to_numpy()
            hashes = b.column(1).to_numpy()
            for lo, hi in _parts(texts):        # bounds the rows built at once
                # repeated rows are cut once
                _, once = np.unique(np.stack([ranks[lo:hi], hashes[lo:hi]]), axis=1, return_index=True)
                once = lo + np.sort(once)
                row, w0, w1, start, end, h1, h2, again, window = cut([texts[i] for i in once], unit)
                rank = ranks[once][row]
                source = np.where(again == 1, rank, -1)
                known = again == 1
                order = np.lexsort((rank, h2, h1, known))
                order = order[:len(order) - int(known.sum())]
                if len(order):
                    a, z = order[1:], order[:-1]
                    new = np.r_[True, (h1[a] != h1[z]) | (h2[a] != h2[z])]
                    least = rank[order][np.flatnonzero(new)][np.cumsum(new) - 1]
                    later = rank[order] > least
                    source[order[later]] = least[later]
                    known[order[later]] = True
                key = np.where(known, hashes[once][row], 0)
                yield pa.record_batch([
                    pa.array(key), pa.array(h1), pa.array(h2, pa.int32()), pa.array(rank), pa.array(hashes[once][row]),
                    pa.array(w0, pa.int32()), pa.array(np.where(window == 1, 0, w1 - w0), pa.int32()), pa.array(start, pa.int32()),
                    pa.array(end - start, pa.int32()), pa.array(source, mask=~known)],
                    ["key", "h1", "h2", "rank", "text_hash", "w0", "n", "start", "length", "source"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       text_of().alias("text"))
    return rows.mapInArrow(run, "key long, h1 long, h2 int, rank long, text_hash long, w0 int, n int, start int, "
                                "length int, source long")


def repeated_spans(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """rank (doc_id, NO_ID for none), text_hash, spans: sorted array of (start, end, words, source, by) to remove, for
    documents with any. Written, as two joins read it."""
    same = Window.partitionBy("key", "h1", "h2").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    again = (unit_table(docs, unit).withColumn("first", F.first("rank").over(same))
             .where(F.col("source").isNotNull() | (F.col("rank") > F.col("first")))
             .select("rank", "text_hash", "w0", "start", F.coalesce("source", "first").alias("source"), (F.col("n") == 0).alias("window"),
                     (F.col("w0") + F.when(F.col("n") == 0, WINDOW).otherwise(F.col("n"))).alias("w1"),
                     (F.col("start") + F.col("length")).alias("end")))
    order = Window.partitionBy("rank", "text_hash").orderBy("w0", "w1")
    before = F.max("w1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    by = F.when(F.bool_and("window"), "window").when(F.bool_or("window"), "both").otherwise("unit")
    runs = (again.withColumn("new", F.when(F.col("w0") <= before, 0).otherwise(1))
            .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("rank", "text_hash", "run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"),
                 (F.max("w1") - F.min("w0")).cast("long").alias("words"),
                 F.nullif(F.min("source"), F.lit(NO_ID)).alias("source"), by.alias("by"))
            .where(F.col("words") >= min_words))
    return table(runs.groupBy("rank", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "words", "source", "by"))).alias("spans")))


def remove_repeats(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> tuple[DataFrame, str]:
    """``docs`` with the repeats cut out of ``text`` and the removed spans (null: none)
    in a further column; returns the frame and that column's name."""
    spans, h, rank, at, bits, sid, sh = fresh(docs, "removed_spans", "text_hash_", "span_rank", "span_at", "span_bits",
                                              "span_id", "span_hash")
    found = repeated_spans(docs, unit, min_words)

    def place(i, t):
        return F.xxhash64(i, t).bitwiseAND(F.lit(DOC_BITS - 1))

    # DOC_BITS / 64 rows at most
    few = (found.select(place("rank", "text_hash").alias("p"))
           .select(F.shiftright("p", 6).alias(at), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
           .groupBy(at).agg(F.bit_or("bit").alias(bits)))
    known = docs.withColumns({h: F.xxhash64("text"), rank: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))})
    known = known.withColumn(at, F.shiftright(place(rank, h), 6)).join(F.broadcast(few), at, "left")
    bit = F.call_function("shiftright", F.col(bits), place(rank, h).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    may = F.coalesce(bit == 1, F.lit(False))
    held = found.select(F.col("rank").alias(sid), F.col("text_hash").alias(sh), F.col("spans").alias(spans))
    t = F.col("text")
    n = F.size(spans)
    # the text before each span and behind the last
    left = F.transform(F.sequence(F.lit(0), n), lambda i: F.substr(
        t, F.when(i > 0, F.get(F.col(spans), F.greatest(i - 1, F.lit(0)))["end"]).otherwise(0) + 1,
        F.when(i < n, F.get(F.col(spans), i)["start"]).otherwise(F.length(t))
        - F.when(i > 0, F.get(F.col(spans), F.greatest(i - 1, F.lit(0)))["end"]).otherwise(0)))
    text = F.when(F.col(spans).isNull(), t).otherwise(F.array_join(left, ""))
    hit = known.where(may).join(held, (F.col(rank) == F.col(sid)) & (F.col(h) == F.col(sh)), "left")
    out = hit.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.col(spans))
    rest = known.where(~may).select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(None).cast(found.schema["spans"].dataType).alias(spans))
    return out.unionByName(rest), spans


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages; a document of which nothing but white space stays goes,
    unless it had none before."""
    out, spans = remove_repeats(docs)
    return out.where(F.col(spans).isNull() | F.col("text").rlike(r"\S")).drop(spans)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, spans = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.coalesce(F.col(spans), F.array().cast("array<struct<start:int,end:int,words:bigint,source:bigint,by:string>>"))
    return out.select(
        "doc_id", F.size(s).cast("long").alias("n_removed"),
        F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("removed_words"),
        F.array_join(F.transform(s, lambda x: F.concat_ws(
            ":", x["start"].cast("string"), x["end"].cast("string"), x["source"].cast("string"))), ",").alias("removed"),
        "text")
