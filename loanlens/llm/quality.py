"""Operator 8: quality rules with risk-controlled cutoffs (native).

Every document gets counts (words, symbols, repeated lines, repeated 5-word
windows) and from them five rule scores, each larger for worse text. A rule
rejects a document whose score exceeds the rule's cutoff. Cutoffs are not
hand-set: for every stratum (language) and rule a fixed grid of cutoffs,
lenient first, is tested on the labelled documents. With k of n good labelled
documents rejected, a cutoff is certified when the exact binomial tail
P(Bin(n, alpha / rules) <= k) is at most delta / (strata x rules): the
false-rejection rate of the stratum is then below alpha with confidence
1 - delta for all strata and rules together (Bonferroni). The tail grows as
cutoffs get stricter, so the certified cutoffs are a prefix of the grid
(fixed-sequence testing costs nothing more). Of the certified cutoffs the one
rejecting most bad labelled documents is taken, the most lenient on ties, and
none where no bad document is caught. Strata without enough labels certify
nothing and keep all that pass the base rules.

Defined results: a null text counts as empty (base_failed); null languages are a
stratum of their own; several label rows of one document count once, good if
any of them says 1; null labels are ignored; repeated documents are judged row by
row; an empty labels table certifies nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import SPACE, fresh, read_table, table, text_of, words_of

#: Rule -> cutoffs, lenient first (parameters of the search, not of the data).
GRID = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "repeat_share": [0.2, 0.175, 0.15, 0.125, 0.1, 0.075, 0.05],
    "word_length": [20.0, 15.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0],
    "upper_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
}
ALPHA, DELTA = 0.05, 0.05
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _window_hash(words: str, i: Column, fn) -> Column:
    return fn(*[F.get(F.col(words), i + k) for k in range(5)])


def add_counts(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the counts and rule scores under names that clash with none
    of its columns; returns the frame and count or rule -> column name.

    A text whose 5-word windows all hash differently has no repeated window;
    only the others sort their (hash, position) pairs to mark repeated words.
    """
    made = [*COUNTS, "n_lines", "n_upper", *GRID]
    steps = ["words", "lines", "hashes", "pairs", "starts"]
    names = dict(zip(made + steps, fresh(df, *[f"q_{n}" for n in made + steps])))
    c = {k: F.col(f"`{v}`") for k, v in names.items()}
    t = text_of(text)
    out = df.select("*", words_of(t).alias(names["words"]),
                    F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias(names["lines"]),
                    (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias(names["n_symbols"]),
                    (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long").alias(names["n_upper"]))
    out = out.withColumns({
        names["n_words"]: F.size(c["words"]).cast("long"),
        names["word_chars"]: F.length(F.array_join(c["words"], "")).cast("long"),
        names["n_lines"]: F.size(c["lines"]).cast("long"),
        names["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
        names["hashes"]: F.when(F.size(c["words"]) >= 5, F.transform(
            F.sequence(F.lit(0), F.size(c["words"]) - 5),
            lambda i: _window_hash(names["words"], i, F.xxhash64)))})
    repeated = F.size(F.array_distinct(c["hashes"])) < F.size(c["hashes"])
    out = out.withColumn(names["pairs"], F.when(repeated, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(c["words"]) - 5),
        lambda i: F.struct(_window_hash(names["words"], i, F.xxhash64).alias("h"),
                           _window_hash(names["words"], i, F.hash).alias("g"), i.alias("p"))))))

    def same(x, other):
        return F.coalesce((other["h"] == x["h"]) & (other["g"] == x["g"]), F.lit(False))

    # get() wants an index of 0 or more under ANSI; index 0 has no neighbour before it
    out = out.withColumn(names["starts"], F.sort_array(F.transform(F.filter(
        c["pairs"], lambda x, i: same(x, F.get(c["pairs"], i + 1)) |
        ((i > 0) & same(x, F.get(c["pairs"], F.greatest(i - 1, F.lit(0)))))), lambda x: x["p"])))
    covered = F.aggregate(
        c["starts"], F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"])
    out = out.withColumn(names["n_repeat_words"], F.coalesce(covered, F.lit(0).cast("long"))).drop(
        *[names[s] for s in steps])

    def share(num: str, den: str) -> Column:
        return c[num].cast("double") / F.greatest(c[den], F.lit(1)).cast("double")

    out = out.withColumns({
        names["symbol_share"]: share("n_symbols", "word_chars"),
        names["dup_line_share"]: share("n_dup_lines", "n_lines"),
        names["repeat_share"]: share("n_repeat_words", "n_words"),
        names["word_length"]: share("word_chars", "n_words"),
        names["upper_share"]: share("n_upper", "word_chars")})
    # a column that differs by row keeps later filters from being moved below, where
    # they would hold all the expressions above in place of the column names
    [b] = fresh(out, "q_row")
    out = out.withColumn(b, F.monotonically_increasing_id()).where(F.col(b) >= 0).drop(b)
    return out, {k: names[k] for k in made}


def base_failed(names: dict[str, str]) -> Column:
    n, r = F.col(f"`{names['n_words']}`"), F.col(f"`{names['n_repeat_words']}`")
    return (n < 10) | (100 * r > 20 * n)


def stratum(column: str) -> Column:
    return F.when(F.col(column).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def _log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), summed in logarithms (no underflow for large n)."""
    first = n.cast("double") * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)

    def step(a, j):
        term = a["term"] + F.log((n - j + 1).cast("double") / j.cast("double")) + F.lit(odds)
        hi = F.greatest(a["total"], term)
        return F.struct(term.alias("term"),
                        (hi + F.log1p(F.exp(F.least(a["total"], term) - hi))).alias("total"))

    return F.when(k == 0, first).otherwise(F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))),
        F.struct(first.alias("term"), first.alias("total")), step, lambda a: a["total"]))


def calibrate(scored: DataFrame, names: dict[str, str], labels: DataFrame, key: str = "doc_id",
              lang: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with certified cutoffs (null: none) in columns cut_<rule>."""
    truth = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("good")))
    judged = (scored.where(~base_failed(names))
              .select(F.col(key).alias("label_id"), stratum(lang).alias("stratum"),
                      *[F.col(f"`{names[r]}`").alias(r) for r in GRID])
              .join(truth, "label_id"))
    good = F.col("good") == 1
    tests = [(r, g) for r in GRID for g in GRID[r]]
    wide = judged.groupBy("stratum").agg(
        F.count(F.when(good, 1)).alias("n_good"),
        *[F.count(F.when(good & (F.col(r) > g), 1)).alias(f"g{i}") for i, (r, g) in enumerate(tests)],
        *[F.count(F.when(~good & (F.col(r) > g), 1)).alias(f"b{i}") for i, (r, g) in enumerate(tests)])
    strata = judged.where(good).agg(F.countDistinct("stratum").alias("strata"))
    # one row of one number: the count of tests for the correction
    long = (wide.select("stratum", "n_good", F.explode(F.array(*[
                F.struct(F.lit(r).alias("rule"), F.lit(g).alias("cutoff"), F.col(f"g{i}").alias("k_good"),
                         F.col(f"b{i}").alias("k_bad")) for i, (r, g) in enumerate(tests)])).alias("t"))
            .select("stratum", "n_good", "t.*")
            .withColumn("strata", F.lit(max(1, strata.first()["strata"]))))
    p = alpha / len(GRID)
    # k at or above n p cannot be certified; this also bounds the sum's length
    certified = (long.where((F.col("k_good") < F.col("n_good") * p) & (F.col("k_bad") > 0))
                 .where(_log_binomial_tail(F.col("n_good"), F.col("k_good"), p)
                        <= F.log(F.lit(delta) / (F.col("strata") * len(GRID)))))
    best = certified.groupBy("stratum", "rule").agg(
        F.max(F.struct("k_bad", "cutoff"))["cutoff"].alias("cutoff"))
    return best.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in GRID])


def judge(scored: DataFrame, names: dict[str, str], cutoffs: DataFrame, lang: str = "lang") -> tuple[DataFrame, str]:
    """``scored`` with a boolean verdict column; returns the frame and its name."""
    cuts = {r: f"cut_{r}" for r in GRID}
    taken = fresh(scored, "q_stratum", "q_kept", *[f"q_{v}" for v in cuts.values()])
    st, kept, cut_names = taken[0], taken[1], dict(zip(GRID, taken[2:]))
    small = cutoffs.select(F.col("stratum").alias(st), *[F.col(cuts[r]).alias(cut_names[r]) for r in GRID])
    rejected = F.lit(False)
    for r in GRID:
        rejected = rejected | F.coalesce(F.col(f"`{names[r]}`") > F.col(cut_names[r]), F.lit(False))
    out = (scored.withColumn(st, stratum(lang)).join(small, st, "left")
           .withColumn(kept, ~base_failed(names) & ~rejected))
    return out.drop(st, *cut_names.values()), kept


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. The documents are written with their
    counts as Parquet: one pass counts, calibration reads the counts' columns only, the
    filter the whole rows."""
    scored, names = add_counts(docs)
    scored = stored(scored, "quality")
    cutoffs = table(calibrate(scored, names, labels))
    out, kept = judge(scored, names, cutoffs)
    return out.where(F.col(f"`{kept}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored, names = add_counts(docs)
    # the narrow counts are read twice (calibration, verdict): write them, not the texts
    scored = table(scored.drop("text"))
    cutoffs = calibrate(scored, names, read_table(spark, sf_dir, "labels"))
    out, kept = judge(scored, names, cutoffs)
    return out.select("doc_id", *[F.col(names[n]).alias(n) for n in COUNTS],
                      base_failed(names).alias("base_failed"), F.col(kept).alias("kept"))


def _oracle() -> str:
    tests = " UNION ALL ".join(
        f"SELECT stratum, '{r}' AS rule, {g}::DOUBLE AS cutoff, count(*) FILTER (good = 1) AS n_good, "
        f"count(*) FILTER (good = 1 AND {r} > {g}) AS k_good, count(*) FILTER (good = 0 AND {r} > {g}) AS k_bad "
        f"FROM judged GROUP BY stratum" for r in GRID for g in GRID[r])
    p = ALPHA / len(GRID)
    rejects = " OR ".join(
        f"coalesce({r} > (SELECT cutoff FROM best WHERE best.stratum = f.stratum AND rule = '{r}'), false)" for r in GRID)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(*) AS n_repeat_words FROM (
        SELECT DISTINCT rid, i + k AS p FROM again, (SELECT unnest(range(0, 5)) AS k)) GROUP BY rid),
c AS (SELECT w.rid, doc_id, CASE WHEN lang IS NULL THEN 'null' ELSE '=' || lang END AS stratum,
        len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.rid = w.rid),
f AS (SELECT *, n_symbols::DOUBLE / greatest(word_chars, 1) AS symbol_share,
        n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_share,
        n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_share,
        word_chars::DOUBLE / greatest(n_words, 1) AS word_length,
        n_upper::DOUBLE / greatest(word_chars, 1) AS upper_share,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
truth AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
judged AS (SELECT f.*, good FROM f JOIN truth USING (doc_id) WHERE NOT base_failed),
tests AS ({tests}),
certified AS (SELECT * FROM tests WHERE k_good < n_good * {p} AND k_bad > 0
  AND list_sum(list_transform(range(0, k_good + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1)
      - lgamma(n_good - j + 1) + j * ln({p}) + (n_good - j) * ln(1 - {p}))))
      <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM judged WHERE good = 1) * {len(GRID)})),
best AS (SELECT stratum, rule, cutoff FROM certified
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY k_bad DESC, cutoff DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({rejects}) AS kept FROM f"""


ORACLE = _oracle()
