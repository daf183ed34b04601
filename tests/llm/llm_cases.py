"""Odd documents that every operator must take: nulls, empty, very long and repeated rows, names that clash."""

import os

SF = "/root/testdata/sf0.001"
HERE = os.path.isdir(SF)

# Columns named like those that operators work with.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "doc string, id long, node long, row long, fp long, key long, rank long, n long, _lookup long, _salt long, score double"
)
EXTRA = ("x", 1, 2, 3, 4, 5, 6, 7, 8, 9, 0.5)

TEXTS = [
    (1, None, "en", "src0"),
    (2, "", "en", None),
    (3, " \t\r\n", None, "src0"),
    (4, "One two three four five six", "en", "src0"),
    (4, "One two three four five six", "en", "src0"),
    (5, "one  two\nthree four five six", None, None),
    (6, "Onetwothreefourfivesix", "en", "src1"),
    (None, "no id at all", "en", "src0"),
    (None, None, None, None),
    (7, "no id at all", "en", "src0"),
    (8, "Grüße, señor! ça va? 日本 😀 ▁ <s> <|endoftext|>", "fr", "src0"),
    (9, "word " * 30_000 + "end", "en", "src0"),
    (10, "x" * 50_000, "de", "src0"),
    (11, "A.", "en", "src0"),
    (12, "́     \x1c á", "es", "src0"),
]


def odd_documents(spark):
    rows = [(doc_id, text, lang, source, len(text or ""), *EXTRA) for doc_id, text, lang, source in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]
