"""Small fixtures: nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977} and" for i in range(20_000))
PASSAGE = ("The quick brown fox jumps over the lazy dog near the river bank today. "
           "A second sentence follows with enough words to matter for the whole run. "
           "Then a third one closes the passage with a number of further plain words.")
TEXTS = [
    (1, "Hello World, write to a.b@mail.example.com or +1 (202) 555-0100 now.\n" + PASSAGE, "en", "s"),
    (2, None, "en", "s"),
    (3, "", None, None),
    (None, "no id here but words enough for a text of some length at all", "en", "s"),
    (4, LONG, "en", "s"),
    (5, "Über die Straße geht der Bär und sagt ja zu allem was er sieht heute", "de", "s"),
    (6, "!!! ??? ...", "de", None),
    (7, "x\n\n" + PASSAGE + "\ntail line of this text.", "en", "s"),
    (7, "x\n\n" + PASSAGE + "\ntail line of this text.", "en", "s"),
    (8, "a\tb\x0bc\x0cd\re  f", "en", "s"),
    (9, "z" * 30_000, "en", "s"),
    (10, "𝔘𝔫𝔦 ▁ 日本語 текст <|endoftext|> é Σίσυφος ΟΔΥΣΣΕΥΣ İstanbul ﬁ ½ ²", "en", "s"),
    (11, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2 3 " * 30, "es", "s"),
    (12, "the same five words here the same five words here the same five words here", "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows=None):
    """documents with columns whose names operators might use themselves."""
    df = spark.createDataFrame(TEXTS if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in (
        "n_chars", "words", "q_words", "q_kept", "n_words", "pii_spans", "text_hash_", "removed_spans", "span_id",
        "keep_id", "ids", "piece", "word", "c", "fp", "stratum", "idx")})


def plain(spark, rows=None):
    return spark.createDataFrame(TEXTS if rows is None else rows, SCHEMA)
