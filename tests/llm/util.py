"""Small tables and brute-force versions for the operator tests."""

import re
from collections import Counter

from pyspark.sql import types as T

GAP = "\x20\x09-\x0D"
LOREM = "der die das und the of and la le de en que a to in is un una les des ein it on for as at by be or".split()


def words(text):
    return re.findall(f"[^{GAP}]+", text or "")


def prose(seed, n):
    """Deterministic invented words."""
    out, x = [], seed * 2654435761 % 2**32
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(LOREM[x // 7 % len(LOREM)] + LOREM[x // 1009 % len(LOREM)] + (str(x % 7) if x % 5 == 0 else ""))
    return " ".join(out)


PASSAGE = prose(99, 70)
ODD_TEXTS = [
    (1, prose(1, 120)), (2, prose(1, 120)), (3, prose(3, 40) + "\n" + PASSAGE + " " + prose(4, 30)), (4, None), (5, ""),
    (6, " \t\n "), (7, PASSAGE), (8, prose(3, 20)), (9, "a"), (9, "a"), (10, "x y z w"), (10, "other text"), (None, prose(7, 60)),
    (11, "word " * 3000), (12, prose(12, 9000)), (13, "Ä́ été ñ 你好\U0001f600 İ\x1cb\x85c\xa0d"), (14, PASSAGE + "  \n" + PASSAGE),
    (15, prose(15, 200) + " " + PASSAGE),
    (16, prose(15, 200).replace(" ", "\n", 3)), (17, "<|endoftext|> a\x01b don't I'LL 123!!! x.\x01"),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def odd_docs(spark, extra=()):
    """Null ids and texts, empty, blank and very long texts, ties, repeated rows, and
    extra columns named like those the operators add."""
    fields = [*SCHEMA.fields, *(T.StructField(c, T.StringType()) for c in extra)]
    return spark.createDataFrame([(*r, *("extra" for _ in extra)) for r in ODD_TEXTS], T.StructType(fields)).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def same_rows(got, want):
    assert Counter(map(str, got)) == Counter(map(str, want))
