"""Small tables that every training-data operator has to survive."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD_TEXTS = [
    None,
    "",
    " \t\n\x0b\r ",
    "one",
    "Licensed under the MIT License. SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR (MIT AND Apache-2.0)",
    "mit license apache license mit LICENSE",
    "<|endoftext|> hello<|startoftext|>x Ünï code é Σας 12345 it's",
    "\x1c\x1d odd \U0001f600 spaces here",
    "word " * 30_000,
    "a b c d e f g h i j k l m n o p q r s t u v w x y z\n" * 3,
    "same text twice",
    "same text twice",
]


def odd_documents(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id", None, None, None), (3, "one", "en", "s0", 3), (3, "one", "en", "s0", 3)]
    return spark.createDataFrame(rows, DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def sf(spark, name="documents", scale="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{scale}/{name}.parquet")
