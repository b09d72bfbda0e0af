"""Operator 4: personal data by pattern, checksum and context (native).

Regular expressions propose spans. Validators confirm them: Luhn for cards,
mod-97 for IBANs, ranges for IP parts, phone digits and US social security
numbers. Each span has a score: the kind's prior, plus a checksum's share, plus
a share for a context word of its kind shortly before. The four base kinds are
always kept; spans of the added kinds (iban, ssn) need a score of ``MIN_SCORE``.
An IBAN is proposed at its start only. Of a country in ``IBAN_LENGTH`` it has that
country's length; else it is the longest text of 15 to 34 characters from there that
ends before a blank or mark and passes mod-97. A start inside an IBAN found is none.

Positions come from the texts between matches: ``split`` and
``regexp_extract_all`` walk the same matches, so a match starts where the lengths
before it end. The patterns match what the plain ones match, written so that no
input makes them backtrack: possessive repeats, and starts only where a run
starts. Offsets are code points, ends exclusive.

Defined results: a null text counts as empty and has no span; repeated rows give
repeated results; overlapping spans of several kinds are all reported, and
redaction replaces their union by the mark of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read_table, text_of

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn"]
PATTERN = {
    # a match may start right behind another one (\G), else only at the start of a run
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # chains of 13 digits or more, whole: shorter ones fail in any case
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # the start only: iban_in finds the end
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Characters of an IBAN by country (ISO 13616 registry).
IBAN_LENGTH = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in countries.split()}
#: Priors, shares of a passed checksum and of a context word, threshold, context length.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.3, "phone": 0.5, "iban": 0.2, "ssn": 0.3}
CHECKSUM = {"card": 0.5, "iban": 0.6}
CONTEXT_SHARE, MIN_SCORE, CONTEXT = 0.2, 0.5, 40
WORDS = {
    "email": "e-?mail|mail|contact|write",
    "ip": r"ip|address|host|server",
    "card": "card|credit|visa|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon|tel[ée]fono",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security",
}
SPANS = "array<struct<kind:int,start:int,end:int,score:double>>"
MARK = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "iban": "<IBAN>", "ssn": "<SSN>"}


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """True for digit strings that pass Luhn's check."""
    def step(total, i):
        d = F.substr(v, F.length(v) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), step) % 10 == 0


def mod97(v: Column) -> Column:
    """True for IBANs (no blanks) whose number is 1 modulo 97."""
    turned = F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4)))

    def step(rest, c):
        n = F.when(c >= "A", F.ascii(c) - F.lit(55)).otherwise(F.ascii(c) - F.lit(48))
        return F.when(n > 9, rest * 100 + n).otherwise(rest * 10 + n) % 97
    return F.aggregate(F.split(turned, "", -1), F.lit(0),
                       lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def iban_in(near: Column) -> Column:
    """The IBAN that a text starts with, null where there is none."""
    run = F.regexp_extract(near, "^[A-Z0-9]+(?: [A-Z0-9]+)*", 0)
    known = F.create_map(*[F.lit(x) for pair in IBAN_LENGTH.items() for x in pair])

    def ends(n):
        d = F.replace(F.substr(near, F.lit(1), n), F.lit(" "), F.lit(""))
        size = F.coalesce(F.try_element_at(known, F.substr(near, F.lit(1), F.lit(2))), F.length(d))
        return F.when(F.length(d).between(15, 34) & (F.length(d) == size)
                      & ~F.substr(near, n, F.lit(2)).rlike("^ |^.[A-Za-z0-9]"), mod97(d)).otherwise(False)
    return F.substr(near, F.lit(1), F.array_max(F.filter(F.sequence(F.lit(1), F.length(run)), ends)))


def _apart(spans: Column) -> Column:
    """``spans``, in order of their starts, without those that start inside one kept before."""
    return F.aggregate(
        spans, F.struct(F.array().cast(SPANS).alias("out"), F.lit(0).alias("at")),
        lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(
            F.concat(a["out"], F.array(x)).alias("out"), x["end"].alias("at"))),
        lambda a: a["out"])


def _valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        d = _digits(v)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "iban":
        return v.isNotNull()
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return ~F.substr(v, F.lit(1), F.lit(3)).rlike("^(000|666|9)") & ~v.rlike("-00-|-0000$")


def add_spans(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with one array column of spans (kind number, start, end, score),
    sorted by kind as listed, then start; returns the frame and its name."""
    names = fresh(df, "pii_spans", *[f"pii_{x}_{k}" for k in KINDS for x in ("found", "starts", "kept")])
    out, found, starts, kept = names[0], names[1::3], names[2::3], names[3::3]
    t = text_of(text)
    step = df.withColumns({f: F.regexp_extract_all(t, F.lit(PATTERN[k]), F.lit(0)) for k, f in zip(KINDS, found)})

    def begin(k, f):
        gaps = F.split(t, PATTERN[k], -1)
        walked = F.aggregate(
            F.arrays_zip(F.transform(gaps, F.length).alias("g"), F.transform(f, F.length).alias("m")),
            F.struct(F.array().cast("array<int>").alias("s"), F.lit(0).alias("at")),
            lambda a, x: F.struct(F.concat(a["s"], F.array(a["at"] + x["g"])).alias("s"),
                                  (a["at"] + x["g"] + F.coalesce(x["m"], F.lit(0))).alias("at")),
            lambda a: a["s"])
        return F.when(F.size(f) > 0, walked)

    step = step.withColumns({s: begin(k, F.col(f"`{f}`")) for k, f, s in zip(KINDS, found, starts)})

    # 34 characters, blanks between and one behind
    f, s = (F.col(f"`{x[KINDS.index('iban')]}`") for x in (found, starts))
    near = F.transform(F.slice(s, 1, F.size(f)), lambda at: F.substr(t, at + 1, F.lit(68)))
    step = step.withColumn(found[KINDS.index("iban")], F.when(F.size(f) > 0, F.transform(near, iban_in)).otherwise(f))

    def spans(n, k, f, s):
        def span(x):
            v, at = x["v"], x["at"]
            before = F.lower(F.substr(t, F.greatest(at - CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT))))
            near = F.when(before.rlike(rf"(?<![\p{{L}}])(?:{WORDS[k]})"), CONTEXT_SHARE).otherwise(0.0)
            return F.struct(F.lit(n).alias("kind"), at.alias("start"), (at + F.length(v)).alias("end"),
                            F.round(F.lit(PRIOR[k] + CHECKSUM.get(k, 0.0)) + near, 3).alias("score"), v.alias("v"))
        pairs = F.arrays_zip(F.col(f"`{f}`").alias("v"), F.slice(F.col(f"`{s}`"), 1, F.size(F.col(f"`{f}`"))).alias("at"))
        all_ = F.filter(F.transform(pairs, span), lambda x: _valid(k, x["v"]))
        if k not in BASE:
            all_ = F.filter(all_, lambda x: x["score"] >= MIN_SCORE)
        all_ = F.transform(all_, lambda x: x.dropFields("v"))
        return F.when(F.size(F.col(f"`{f}`")) > 0, _apart(all_) if k == "iban" else all_).otherwise(
            F.array().cast(SPANS))

    step = step.withColumns({y: spans(n, k, f, s) for n, (k, f, s, y) in enumerate(zip(KINDS, found, starts, kept))})
    return step.withColumn(out, F.concat(*[F.col(f"`{y}`") for y in kept])).drop(*found, *starts, *kept), out


def _listed(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(kind, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind's mark; all rows stay."""
    found, spans = add_spans(docs)
    t = F.col("text")
    marks = F.array(*[F.lit(MARK[k]) for k in KINDS])
    ordered = F.sort_array(F.transform(F.col(f"`{spans}`"), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    cut = F.aggregate(
        ordered, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")),
        lambda a, x: F.when(x["start"] < a["at"], F.struct(
            a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))).otherwise(F.struct(
                F.concat(a["out"], F.array(F.substr(t, a["at"] + 1, x["start"] - a["at"]),
                                           F.get(marks, x["kind"]))).alias("out"), x["end"].alias("at"))),
        lambda a: F.array_join(F.concat(a["out"], F.array(F.substr(t, a["at"] + 1))), ""))
    new = F.when(t.isNull() | (F.size(f"`{spans}`") == 0), t).otherwise(cut)
    return found.select(*[new.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _count(spans: Column, kind: int) -> Column:
    # the lambda takes the span only: a second argument would be its index
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = add_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    all_ = F.col(spans)
    base = F.filter(all_, lambda x: x["kind"] < len(BASE))
    return found.select(
        "doc_id",
        *[_count(all_, n).alias(f"n_{k}") for n, k in enumerate(BASE)],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(all_).alias("spans"),
        F.array_join(F.transform(all_, lambda x: x["score"].cast("string")), ",").alias("scores"))
