"""Operator 2: scoring texts with a log-bilinear language model.

Tokens are lower-cased words and one end per text. Every word of every learning
document is counted. The ``MODEL`` most frequent words (end included) are tokens
of the neural model; the others belong to one of ``CLASSES`` classes by their last
characters. The model predicts a token from the two before it: q = C1 r1 + C2 r2,
s(w) = q t_w + b_w. It is trained in numpy by noise-contrastive estimation: the learning
documents are dealt by a hash of their id and text to blocks of about ``BLOCK`` tokens, the
blocks to rounds (two, and one more for each doubling of the blocks). The blocks of a round
train from the same weights, and their weights are averaged by tokens, so that each learning
document is used once. A block is read in the order of the hashes and draws its noise by
its number: the model does not depend on files, partitions or cores. Repeated rows get
successive numbers in the hash, so that they spread over the blocks; a block is streamed,
its size is never held. Normalisers of all context pairs come from one matrix product, as
exp(s) factors into exp(r1 C1 t) exp(r2 C2 t + b). A word of a class adds its share in
the class: (count + 1) / (class total + distinct words + 1).

Exact counts at scale: the ``HEAD`` most frequent words (up to 64 bytes, so bounded) go to
every worker; only other words leave a text as rows and meet their counts in a
shuffle join, where no word is frequent any more.

Defined results: null and empty texts are the end alone; repeated rows are scored
each; null ids count as empty text for the split; without learning documents the base
score is 0 and the model is uniform.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import held_out, read_table, table, text_of

MODEL, CLASSES, HEAD, WORD_BYTES = 1024, 64, 200_000, 64
DIM, NOISE, BATCH, RATE, BLOCK = 16, 64, 4096, 0.1, 1 << 18
CHUNK = 16 * BATCH      # tokens of a block in hand
END = b""
FLUSH, SLICE = 300_000, 400


def tokens(text: bytes) -> list[bytes]:
    """Lower-case A-Z, words without ASCII white space (bytes methods know ASCII alone)."""
    return text.lower().split()


def word_class(word: bytes) -> int:
    """Class of a word outside the model: its last characters, without punctuation."""
    return xxhash.xxh32_intdigest((word.rstrip(b".,;:!?") or word)[-3:]) % CLASSES


def count_words(learn: DataFrame) -> DataFrame:
    """word, c over the learning texts; the end token is the empty word."""
    def run(batches):
        seen: Counter = Counter()

        def rows():
            words = list(seen)
            out = pa.record_batch([pa.array(words, pa.binary()).cast(pa.string()),
                                   pa.array([seen[w] for w in words], pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for b in batches:
            texts = b.column(0).cast(pa.binary())
            for lo in range(0, b.num_rows, SLICE):
                for t in texts.slice(lo, SLICE).to_pylist():
                    seen.update(tokens(t))
                    seen[END] += 1
                if len(seen) > FLUSH:
                    yield rows()
        if seen:
            yield rows()

    return learn.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What every worker knows of the counts: head words, model tokens, class totals."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        """words: by descending count, at most ``HEAD``, the end among them if it occurs."""
        model = [END, *[w for w in words if w != END][:MODEL - 1]]
        self.n_model = len(model)
        self.size = self.n_model + CLASSES          # tokens of the model
        self.start = self.size                      # context before a text
        self.at = {w: i for i, w in enumerate(words)}
        self.counts = counts
        ids = {w: i for i, w in enumerate(model)}
        self.token = np.array([ids[w] if w in ids else self.n_model + word_class(w) for w in words], np.int32)
        self.of_class = np.zeros(CLASSES)           # sum of counts, number of words
        self.class_words = np.zeros(CLASSES)
        self.model_counts = np.zeros(self.n_model)
        for w, i in ids.items():
            if w in self.at:
                self.model_counts[i] = counts[self.at[w]]
        self.model_words = set(model)

    def split(self, texts: list[bytes]):
        """Words of the texts in a row: head index (-1: not in the head), model token, lengths, words."""
        lists = [tokens(t) for t in texts]
        flat = [w for ws in lists for w in ws]
        get = self.at.get
        head = np.fromiter((get(w, -1) for w in flat), np.int64, len(flat))
        token = np.empty(len(flat), np.int64)
        known = head >= 0
        token[known] = self.token[head[known]]
        rest = np.flatnonzero(~known)
        token[rest] = [self.n_model + word_class(flat[i]) for i in rest]
        return head, token, np.array([len(ws) for ws in lists], np.int64), flat

    def sequences(self, token: np.ndarray, lengths: np.ndarray):
        """Contexts (one before, two before) and targets, each text with its end."""
        ends = np.cumsum(lengths + 1) - 1
        w = np.zeros(len(token) + len(lengths), np.int64)
        is_end = np.zeros(len(w), bool)
        is_end[ends] = True
        w[~is_end] = token                          # the end is token 0
        first = np.concatenate([[0], ends[:-1] + 1])[:len(lengths)]
        one = np.concatenate([[self.start], w[:-1]]) if len(w) else w
        one[first] = self.start
        two = np.concatenate([[self.start], one[:-1]]) if len(w) else w
        two[first] = self.start
        return one, two, w, first


class LogBilinear:
    """r: contexts (start included), c1, c2: matrices, t and b: targets."""

    def __init__(self, size: int, noise: np.ndarray, dim: int = DIM, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.r = rng.normal(0, 0.3, (size + 1, dim))
        self.t = rng.normal(0, 0.05, (size, dim))
        self.c1, self.c2 = np.eye(dim), np.eye(dim) * 0.5
        self.b = np.log(noise)
        self.noise = noise

    def copy(self) -> LogBilinear:
        own = LogBilinear.__new__(LogBilinear)
        own.__dict__ = {k: v.copy() for k, v in self.__dict__.items()}
        return own

    def step(self, one, two, w, draws, squares):
        """One update by noise-contrastive estimation, the noise shared in the batch."""
        k, n = len(draws), len(w)
        r1, r2 = self.r[one], self.r[two]
        q = r1 @ self.c1.T + r2 @ self.c2.T
        log_k = np.log(k * self.noise)
        data = (q * self.t[w]).sum(1) + self.b[w] - log_k[w]
        false = q @ self.t[draws].T + (self.b - log_k)[draws]
        gd = -1 / (1 + np.exp(np.clip(data, -30, 30)))
        gf = 1 / (1 + np.exp(np.clip(-false, -30, 30)))
        gq = gd[:, None] * self.t[w] + gf @ self.t[draws]
        gt = _rows(w, gd[:, None] * q, len(self.t))
        gb = np.bincount(w, gd, len(self.b))
        np.add.at(gt, draws, gf.T @ q)
        np.add.at(gb, draws, gf.sum(0))
        gr = _rows(one, gq @ self.c1, len(self.r)) + _rows(two, gq @ self.c2, len(self.r))
        for name, g in (("t", gt), ("b", gb), ("r", gr), ("c1", gq.T @ r1), ("c2", gq.T @ r2)):
            g = g / n * 100
            squares[name] = squares.get(name, 1e-2) + g * g
            p = getattr(self, name)
            p -= RATE * g / np.sqrt(squares[name])

    def tables(self):
        """s = g1[one, w] + g2[two, w]; z[one, two]: log normalisers."""
        g1 = (self.r @ self.c1.T) @ self.t.T
        g2 = (self.r @ self.c2.T) @ self.t.T + self.b
        m1, m2 = g1.max(1, keepdims=True), g2.max(1, keepdims=True)
        z = np.log(np.exp(g1 - m1) @ np.exp(g2 - m2).T) + m1 + m2.T
        return g1, g2, z

    def rows(self, weight: float):
        """Weights as table rows: name, row, weight, values times weight (a target's bias last)."""
        for name in ("r", "t", "c1", "c2"):
            for i, v in enumerate(getattr(self, name)):
                yield name, i, weight, [*(v * weight).tolist(), self.b[i] * weight if name == "t" else 0.0]


def _rows(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, j], n) for j in range(values.shape[1])], 1)


def deal(learn: DataFrame, shared, blocks: int, rounds: int) -> DataFrame:
    """round, block, key and model tokens (16 bits each) of every learning text, as a table."""
    def run(batches):
        vocabulary, repeats = shared.value, Counter()
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for lo in range(0, b.num_rows, SLICE):
                _, token, lengths, _ = vocabulary.split(texts.slice(lo, SLICE).to_pylist())
                keys = []
                for k in b.column(0).slice(lo, SLICE).to_pylist():
                    n = repeats[k]
                    repeats[k] += 1
                    keys.append(xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), n))
                if len(repeats) > FLUSH:
                    repeats.clear()
                at = np.cumsum(lengths) - lengths
                token = token.astype("<u2")
                block = np.array(keys, np.uint64) % np.uint64(blocks)
                yield pa.record_batch([
                    pa.array((block % np.uint64(rounds)).astype(np.int32)), pa.array(block.astype(np.int64)),
                    pa.array(np.array(keys, np.uint64).view(np.int64)),
                    pa.array([token[i:i + n].tobytes() for i, n in zip(at, lengths)], pa.binary())],
                    ["round", "block", "key", "tokens"])

    rows = learn.select(F.xxhash64("doc_id", "text_hash").alias("key"), "text").mapInArrow(
        run, "round int, block long, key long, tokens binary")
    return stored(rows.repartition("round", "block"), "lm-blocks", "round")


def train(learn: DataFrame, shared, model: LogBilinear, n_tokens: int, block: int = BLOCK) -> LogBilinear:
    """Data-parallel training; the driver holds only the averaged weights, whose size
    is set by the vocabulary and dimension."""
    if not n_tokens:
        return model
    spark = learn.sparkSession
    blocks = -(-n_tokens // block)
    rounds = min(blocks, 1 + blocks.bit_length())
    dealt = deal(learn, shared, blocks, rounds)
    tasks = min(-(-blocks // rounds), max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                          spark.sparkContext.defaultParallelism))
    dim = model.r.shape[1]
    for r in range(rounds):
        weights = spark.sparkContext.broadcast(model)

        def run(batches, r=r, weights=weights):
            vocabulary, noise = shared.value, np.cumsum(weights.value.noise)
            own, squares, rng, current, seen, held, size = None, {}, None, None, 0, [], 0

            def learn_held():
                nonlocal seen, held, size
                if not held:
                    return
                lengths = np.array([len(t) for t in held], np.int64)
                one, two, w, _ = vocabulary.sequences(np.concatenate(held).astype(np.int64), lengths)
                for s in range(0, len(w), BATCH):
                    part = slice(s, s + BATCH)
                    draws = np.searchsorted(noise, rng.random(NOISE) * noise[-1])
                    own.step(one[part], two[part], w[part], np.minimum(draws, len(noise) - 1), squares)
                seen += len(w)
                held, size = [], 0

            def finished():
                learn_held()
                names, rows, ws, vs = zip(*own.rows(float(seen)))
                return pa.record_batch([pa.array(names), pa.array(rows, pa.int32()), pa.array(ws), pa.array(
                    vs, pa.list_(pa.float64()))], ["name", "row", "weight", "v"])

            for b in batches:
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if k != current:
                        if own is not None:
                            yield finished()
                        own, squares, rng, current, seen = weights.value.copy(), {}, np.random.default_rng([r, k]), k, 0
                    held.append(np.frombuffer(t, "<u2"))
                    size += len(held[-1]) + 1
                    if size >= CHUNK:
                        learn_held()
            if own is not None:
                yield finished()

        own = (dealt.where(F.col("round") == r).select("block", "tokens", "key").repartition(tasks, "block")
               .sortWithinPartitions("block", "key").select("block", "tokens"))
        parts = own.mapInArrow(run, "name string, row int, weight double, v array<double>")
        # vectors are summed by place on the cluster
        found = parts.groupBy("name", "row").agg(
            F.sum("weight").alias("w"), *[F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(dim + 1)])
        model = model.copy()
        for x in found.toArrow().to_pylist():
            getattr(model, x["name"])[x["row"]] = [x[f"v{j}"] / x["w"] for j in range(dim)]
            if x["name"] == "t":
                model.b[x["row"]] = x[f"v{dim}"] / x["w"]
    return model


def fit_vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    short = counts.where(F.octet_length("word") <= WORD_BYTES)
    # how many words occur at least 2, 4, 8, ... times tells below which count none is
    # in the head, so that choosing it does not sort the whole vocabulary
    octave = F.floor(F.log2("c"))
    enough, least = 0, 1
    for o in sorted(short.groupBy(octave.alias("o")).agg(F.count("*").alias("n")).collect(), reverse=True):
        enough += o["n"]
        if enough >= head:
            least = 1 << o["o"]
            break
    top = (short.where((F.col("c") >= least) | (F.col("word") == ""))
           .orderBy(F.desc(F.col("word") == ""), F.desc("c"), "word").limit(head).toArrow())
    v = Vocabulary(top.column("word").cast(pa.binary()).to_pylist(), top.column("c").to_numpy())
    model_words = v.model_words

    def totals(batches):
        c, n = np.zeros(CLASSES), np.zeros(CLASSES)
        for b in batches:
            words = b.column(0).cast(pa.binary()).to_pylist()
            keep = np.array([w not in model_words for w in words], bool)
            cls = np.array([word_class(w) for w in words], np.int64)
            c += np.bincount(cls[keep], b.column(1).to_numpy()[keep], CLASSES)
            n += np.bincount(cls[keep], minlength=CLASSES)
        yield pa.record_batch([pa.array(range(CLASSES), pa.int32()), pa.array(c), pa.array(n)], ["k", "c", "n"])

    for x in counts.mapInArrow(totals, "k int, c double, n double").groupBy("k").agg(
            F.sum("c").alias("c"), F.sum("n").alias("n")).collect():
        v.of_class[x["k"]], v.class_words[x["k"]] = x["c"], x["n"]
    return v


SCORED = ("rid long, doc_id long, held_out boolean, word string, tf long, n_tokens long, n_known long, "
          "base double, model double")


def _score(shared, weights):
    def run(batches):
        v, m = shared.value, weights.value
        g1, g2, z = m.tables()
        log_c = np.log10(v.counts + 1.0)
        share = np.log10(v.of_class + v.class_words + 1)      # of a class word's probability
        in_class = v.token >= v.n_model
        head_share = np.where(in_class, log_c - share[np.maximum(v.token - v.n_model, 0)], 0.0)
        end_c = log_c[v.at[END]] if END in v.at else 0.0
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            for lo in range(0, b.num_rows, SLICE):
                ids, out = b.column(0).slice(lo, SLICE), b.column(1).slice(lo, SLICE)
                head, token, lengths, flat = v.split(texts.slice(lo, SLICE).to_pylist())
                one, two, w, first = v.sequences(token, lengths)
                lp = (g1[one, w] + g2[two, w] - z[one, two]) / np.log(10)
                model = np.add.reduceat(lp, first) if len(first) else lp
                known = head >= 0
                doc = np.repeat(np.arange(len(lengths)), lengths)
                n = len(lengths)
                extra = np.where(known, head_share[np.maximum(head, 0)] if len(head_share) else 0.0,
                                 -share[np.maximum(token - v.n_model, 0)])
                model = model + np.bincount(doc, extra, n)
                base = end_c + np.bincount(doc, np.where(known, log_c[np.maximum(head, 0)] if len(log_c) else 0.0, 0.0), n)
                n_known = np.bincount(doc, known, n).astype(np.int64) + (END in v.at)
                rid = row + np.arange(n)
                row += n
                # words of no text hold a blank, so these keys meet no count and spread evenly
                keys, tf, of = [f" {r}" for r in rid], [0] * n, list(range(n))
                rest = np.flatnonzero(~known)
                for (d, word), c in Counter((doc[i], flat[i]) for i in rest).items():
                    keys.append(word.decode())
                    tf.append(c)
                    of.append(int(d))
                take, pad = pa.array(of, pa.int64()), len(of) - n
                zero, none = np.zeros(pad, np.int64), np.zeros(pad)
                yield pa.record_batch([
                    pa.array(rid[of]), ids.take(take), out.take(take), pa.array(keys), pa.array(tf, pa.int64()),
                    pa.array(np.concatenate([lengths + 1, zero])), pa.array(np.concatenate([n_known, zero])),
                    pa.array(np.concatenate([base, none])), pa.array(np.concatenate([model, none]))],
                    ["rid", "doc_id", "held_out", "word", "tf", "n_tokens", "n_known", "base", "model"])
    return run


def score_texts(docs: DataFrame, head: int = HEAD, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 7, 2).alias("held_out"),
                       text_of().alias("text"))
    learn = rows.where(~F.col("held_out")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    counts = table(count_words(learn))
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    sc = docs.sparkSession.sparkContext
    vocabulary = fit_vocabulary(counts, head)
    shared = sc.broadcast(vocabulary)
    noise = np.concatenate([vocabulary.model_counts, vocabulary.of_class]) + 1
    model = train(learn, shared, LogBilinear(vocabulary.size, noise / noise.sum()), size["n"], block)
    scored = rows.mapInArrow(_score(shared, sc.broadcast(model)), SCORED)
    met = scored.join(counts, "word", "left").withColumn(
        "more", F.when(F.col("c").isNotNull(), F.col("tf") * F.log10(F.col("c") + 1)).otherwise(0.0))
    found = F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)
    out = met.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + found).alias("n_known"), F.sum(F.col("base") + F.col("more")).alias("base"),
        F.sum(F.col("model") + F.col("more")).alias("score"))
    per_token = float(np.log10(size["n"] + size["v"] + 1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(size["n"])).cast("long").alias("train_tokens"),
                      (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"), "score")


def op2_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
