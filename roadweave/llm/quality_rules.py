"""Quality rules (operator 1), DataFrame functions only.

Method: host-level rules. Every document is tried by a few rules; failures are summed by
host, rates are shrunk with an empirical beta prior fitted to the hosts' own rates, and the
hosts' verdicts are joined back to their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.shared import WORD, stored, without, words_of

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Shrunk failure rate from which a host is suspect, and from which it is condemned.
SUSPECT, CONDEMNED = 0.05, 0.5
#: More symbols a hundred words than this fail a document; so do more repeated lines a hundred lines.
MOST_SYMBOLS, MOST_DUP_LINES = 10, 30


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long).

    Null text has no words. Existing columns of these names are replaced; the text column
    and all others stay. n_repeat_words counts words that lie in any repeated 3-word window.
    """
    held = without(docs.columns, MEASURES)
    body = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(
        *held,
        words_of(F.col(text)).alias("_words"),
        F.size(F.regexp_extract_all(body, F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
    )
    hashed = cut.select(
        *held,
        "n_symbols",
        "_words",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_words") > 2,
            F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")).alias("_hashes"),
    )
    # Texts without two equal hashes need no sorting.
    sorted_ = hashed.select(
        *held,
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        "_words",
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    )
    near = sorted_.select(
        *held,
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        "_words",
        F.transform(
            F.filter("_sorted", lambda x, k: (F.coalesce(F.get("_sorted", k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get("_sorted", k + 1)["h"] == x["h"], F.lit(False)))),
            lambda x: F.struct(F.array_join(F.slice("_words", x["i"] + 1, 3), " ").alias("w"), x["i"].alias("i")),
        ).alias("_near"),
    ).withColumn("_near", F.sort_array("_near"))
    starts = near.withColumn(
        "_starts",
        F.sort_array(
            F.transform(
                F.filter("_near", lambda x, k: (F.coalesce(F.get("_near", k - 1)["w"] == x["w"], F.lit(False))) | (F.coalesce(F.get("_near", k + 1)["w"] == x["w"], F.lit(False)))),
                lambda x: x["i"],
            )
        ),
    )
    # A start covers three words, less what the next start covers again.
    covered = F.aggregate(
        F.transform("_starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - p, F.lit(3)))), F.lit(0), lambda total, n: total + n
    )
    return starts.select(
        *held,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def rule_columns(measured: DataFrame) -> DataFrame:
    """Adds base_failed, rule_failed (any rule) and host ('' for null) to measured documents."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    more = (
        (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"))
        | ~F.col("word_chars").between(2 * F.col("n_words"), 20 * F.col("n_words"))
    )
    return measured.withColumns({"base_failed": base, "rule_failed": base | more})


def host_verdicts(judged: DataFrame, host: str) -> DataFrame:
    """One row a host (null is no host): host, host_docs, host_failed, shrunk_rate, suspect, condemned.

    The prior Beta(a, b) has the mean and variance of the hosts' failure rates, by moments
    over hosts weighted alike; a strength below 1 or one that cannot be told (one host, or
    rates all alike) becomes 1 or the mean number of documents a host. shrunk_rate is the
    posterior mean (failed + a) / (docs + a + b).
    """
    hosts = (
        judged.filter(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("host_failed"))
    )
    rate = F.col("host_failed") / F.col("host_docs")
    moments = hosts.agg(F.avg(rate).alias("_m"), F.var_samp(rate).alias("_v"), F.avg("host_docs").alias("_n"))  # one row
    strength = F.greatest(F.lit(1.0), F.coalesce(F.when(F.col("_v") > 0, F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1), F.col("_n")))
    with_prior = hosts.join(F.broadcast(moments.select("_m", strength.alias("_s"))), F.lit(True))  # a single row
    shrunk = (F.col("host_failed") + F.col("_m") * F.col("_s")) / (F.col("host_docs") + F.col("_s"))
    return with_prior.select("host", "host_docs", "host_failed", shrunk.alias("shrunk_rate"), (shrunk >= SUSPECT).alias("suspect"), (shrunk >= CONDEMNED).alias("condemned"))


def judge_documents(docs: DataFrame, host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its measures, base_failed, shrunk_rate and kept.

    kept is false if base_failed; else if the host is condemned; else if the host is suspect
    and the document fails any other rule (many symbols, repeated lines, odd word lengths).
    Documents without a host answer for themselves, as those of a suspect host do. Columns
    ``keep`` (default: all) stay. Null and empty texts have no words and fail. Repeated rows
    count and return as often as they occur; an empty table gives no rows. Texts are measured
    whole, in one task each. Columns named like the new ones, in any case, are replaced; all
    other names may occur. The measures are stored once in the shared folder, so the second
    reading does not measure again.
    """
    keep = without(docs.columns if keep is None else keep, (*MEASURES, "base_failed", "shrunk_rate", "kept"))
    source = docs.select(F.struct(*keep).alias("_row"), F.col(host).cast("string").alias("_host"), F.col("text").alias("text"))
    judged = rule_columns(text_measures(source, "text"))
    judged = stored(judged.select("_row", "_host", *MEASURES, "base_failed", "rule_failed"), "rule-failures")
    verdicts = host_verdicts(judged, "_host").select(
        F.col("host").alias("_at"), F.col("shrunk_rate").alias("_rate"), F.col("suspect").alias("_suspect"), F.col("condemned").alias("_condemned")
    )
    # A plain join: the engine sends the hosts to all tasks only if their measured size is small.
    return (
        judged.join(verdicts, F.col("_host") == F.col("_at"), "left")
        .withColumn("kept", ~(F.col("base_failed") | F.coalesce("_condemned", F.lit(False)) | (F.col("rule_failed") & F.coalesce("_suspect", F.lit(True)))))
        .select("_row.*", *MEASURES, "base_failed", F.col("_rate").alias("shrunk_rate"), "kept")
    )
