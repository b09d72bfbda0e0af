"""Operator 10: language identification by words first, character n-grams after.

A known word scores with its log frequency in every language. An unseen word falls
back to its longest character n-grams that any language knows (5 down to 1, with
word marks), averaged. A text's score is the posterior of its best language under
equal priors. The model is fitted to at most ``PER_LANG`` documents of each
language (those with the smallest id hash) and keeps at most ``ENTRIES`` words and
n-grams in all, so that it can be broadcast; scoring reads every word of every text.
Every language gives its most frequent ones in turn, so that a small language keeps its
own. Counts are smoothed with one vocabulary size, and what a language has not seen
has one probability in all of them: little learning text is no evidence.

Defined results: a null text or one without letters is "und" with score 0;
without any labelled text all are; equal scores go to the language first in
order; repeated rows are scored alike; null ids count as empty text for the split.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, read_table, text_of

PER_LANG, ENTRIES, LONGEST = 2000, 400_000, 5
WORD_LENGTH = 64
CELLS = 20_000_000      # of the score table a worker keeps, words x languages
WORD = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def training_sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """lang and text of at most ``per_lang`` learning documents of each language: those
    with the smallest hashes. A language's count sets a hash limit that leaves about
    four times as many, so that the exact choice never sorts a whole language."""
    own = (docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 4, 2))
           .select("lang", "doc_id", F.xxhash64("text").alias("h"),
                   F.xxhash64(F.coalesce("doc_id", F.lit(0)), "text").alias("draw")))
    size = own.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.lit(4.0 * per_lang) / F.col("rows")
    near = own.join(size, "lang").where(
        (share >= 1) | (F.shiftrightunsigned("draw", 1).cast("double") < share * F.lit(2.0 ** 63)))
    w = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("draw", 1), "doc_id", "h")
    chosen = (near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_lang)
              .select(F.col("lang").alias("l"), F.col("doc_id").alias("d"), F.col("h").alias("k")).distinct())
    rows = docs.select("lang", "doc_id", "text", F.xxhash64("text").alias("h"))
    # at most ``per_lang`` narrow rows of each language: bounded, so that no text is shuffled
    return rows.join(F.broadcast(chosen), (F.col("lang") == F.col("l")) & F.col("doc_id").eqNullSafe(F.col("d"))
                     & (F.col("h") == F.col("k"))).select("lang", "text")


def _counts(batches):
    for b in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words[lang].update(WORD.findall(text.lower()))
        for lang, counter in words.items():
            found: dict[int, Counter] = {n: Counter() for n in range(LONGEST + 1)}
            for w, c in counter.items():
                if len(w) <= WORD_LENGTH:
                    found[0][w] = c
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        found[n][g] += c
            for n, f in found.items():
                if f:
                    yield pa.record_batch([pa.array([lang] * len(f)), pa.array([n] * len(f), pa.int32()),
                                           pa.array(list(f)), pa.array(list(f.values()), pa.int64())],
                                          ["lang", "n", "token", "c"])


def fit(docs: DataFrame, per_lang: int = PER_LANG, entries: int = ENTRIES):
    """languages and {n: {token: log posterior per language}}; n = 0 are whole words."""
    counted = (training_sample(docs, per_lang).mapInArrow(_counts, "lang string, n int, token string, c long")
               .groupBy("lang", "n", "token").agg(F.sum("c").alias("c")))
    total = counted.groupBy("lang", "n").agg(F.sum("c").alias("total"))
    place = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "token")
    by_token = (counted.withColumn("place", F.row_number().over(place)).join(total, ["lang", "n"])
                .groupBy("n", "token").agg(F.min("place").alias("place"), F.sum("c").alias("all"),
                                           F.collect_list(F.struct("lang", "c", "total")).alias("by")))
    each = entries // (LONGEST + 1)
    every = Window.partitionBy("n")
    top = every.orderBy("place", F.desc("all"), "token")
    kept = (by_token.withColumn("r", F.row_number().over(top)).withColumn("distinct", F.count("*").over(every))
            .withColumn("most", F.max(F.array_max("by.total")).over(every))
            .where(F.col("r") <= each).select("n", "token", "by", "distinct", "most"))
    rows = kept.toArrow().to_pylist()           # bounded by ``entries``
    langs = sorted({e["lang"] for r in rows for e in r["by"]})
    at = {lang: i for i, lang in enumerate(langs)}
    model: dict[int, dict[str, np.ndarray]] = {n: {} for n in range(LONGEST + 1)}
    for r in rows:
        more = 0.5 * r["distinct"]
        # unseen: half a count of the language with the most text, for all languages
        v = np.full(len(langs), np.log(0.5 / (r["most"] + more)))
        for e in r["by"]:
            v[at[e["lang"]]] = np.log((e["c"] + 0.5) / (e["total"] + more))
        model[r["n"]][r["token"]] = (v - np.logaddexp.reduce(v)).astype(np.float32)
    return langs, model


class Scorer:
    def __init__(self, langs, model):
        self.langs, self.model = langs, model
        self.words = list(model[0])
        room = max(1000, CELLS // max(1, len(langs)) - len(self.words))
        self.table = np.zeros((len(self.words) + room, len(langs)), np.float32)
        if self.words:
            self.table[:len(self.words)] = [model[0][w] for w in self.words]
        self.reset()

    def reset(self):
        self.at = {w: i for i, w in enumerate(self.words)}

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            known = [v for v in map(self.model[n].get, grams(word, n)) if v is not None]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(self.langs), np.float32)

    def score(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall((text or "").lower())
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        total = np.zeros(len(self.langs))
        for lo in range(0, len(words), 500):
            part = words[lo:lo + 500]
            if len(self.at) + len(part) > len(self.table):
                self.reset()                    # unseen words found so far are found again
            at = self.at
            for w in part:
                if w not in at:
                    self.table[len(at)] = self.unseen(w)
                    at[w] = len(at)
            total += self.table[[at[w] for w in part]].sum(0, dtype=np.float64)
        best = int(total.argmax())
        return self.langs[best], float(np.exp(total[best] - np.logaddexp.reduce(total)))


def identify(docs: DataFrame, per_lang: int = PER_LANG, entries: int = ENTRIES) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs, per_lang, entries))

    def run(batches):
        scorer = Scorer(*fitted.value)
        for b in batches:
            found = [scorer.score(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()),
                                   pa.array([f[1] for f in found], pa.float64())],
                                  ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 4, 2).alias("held_out"),
                       text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_word_first_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
