"""Benchmark decontamination (operator 7), DataFrame functions only.

Method: spaced-seed hashing. Fixed masks pick some words of every window and ignore the
rest; test and training windows with equal hashes of the picked words are hits, and around
each hit the words are compared in place, so substituted words are tolerated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word places that each mask picks. Any two substituted words in 13 leave one of the masks
#: whole at some place (all 78 placements are tried in the tests).
MASKS = ((0, 1, 3, 5, 8, 9), (0, 3, 4, 5, 6, 7))
#: Words of a window that is compared, and of them so many may differ.
WINDOW, SUBSTITUTIONS = 13, 2
#: Texts under WINDOW words are sought whole: from FREE_WORDS words on with one word substituted,
#: which leaves the first or the last ANCHOR words as they are; shorter ones word for word.
FREE_WORDS, ANCHOR = 8, 4
#: Benchmark windows that are sent to every task at once; a larger benchmark is met in blocks.
BROADCAST_ROWS = 300_000
#: Bits of the first filter for each benchmark window, and its most 64-bit words.
BITS_EACH, MOST_BIT_WORDS = 32, 1 << 14

_REACH = WINDOW - 1


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words; a word is a run of letters, digits and non-ASCII characters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed_hash(hashes: Column, at: Column, mask: tuple[int, ...]) -> Column:
    number = MASKS.index(mask) if mask in MASKS else len(MASKS) + len(mask)
    return F.xxhash64(F.lit(number), *(F.get(hashes, at + k) for k in mask))


def _starts(n: Column, mask: tuple[int, ...]) -> Column:
    """Places where the mask fits into n words."""
    last = n - (mask[-1] + 1)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _context(hashes: Column, at: Column) -> Column:
    """The words from ``_REACH`` before a place to ``_REACH`` after it; null beyond the ends."""
    return F.transform(F.sequence(at - _REACH, at + _REACH), lambda k: F.get(hashes, k))


def masks_for(items: DataFrame) -> list[tuple[int, ...]]:
    """The masks that a benchmark's lengths (n_item) need: MASKS for texts of WINDOW words or more,
    runs of ANCHOR words for texts of FREE_WORDS or more, runs of all words for shorter ones."""
    kind = F.when(F.col("n_item") >= WINDOW, WINDOW).when(F.col("n_item") >= FREE_WORDS, ANCHOR).otherwise(F.col("n_item"))
    kinds = {r[0] for r in items.select(kind.alias("kind")).distinct().collect()}  # at most nine
    return [*(MASKS if WINDOW in kinds else ()), *(tuple(range(k)) for k in sorted(kinds - {WINDOW}))]


def benchmark_seeds(items: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """Every masked window by which a benchmark text is sought: item_id, n_item, seed, item_context.

    ``items`` has item_id, _h (word hashes) and n_item.
    """
    n = F.col("n_item")

    def of_mask(mask: tuple[int, ...]) -> Column:
        at = F.when(n >= WINDOW, _starts(n, mask)) if mask in MASKS else F.when(n == len(mask), F.array(F.lit(0)))
        if mask == tuple(range(ANCHOR)):
            at = F.when(n.between(FREE_WORDS, WINDOW - 1), F.array(F.lit(0), n - ANCHOR)).otherwise(at)
        at = F.coalesce(at, F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(_seed_hash(F.col("_h"), i, mask).alias("seed"), _context(F.col("_h"), i).alias("item_context")))

    return items.select("item_id", "n_item", F.explode(F.concat(*map(of_mask, masks))).alias("s")).select("item_id", "n_item", "s.seed", "s.item_context")


def _bit_table(seeds: DataFrame, words: int) -> Column:
    """The set slots of all seeds as one array of 64-bit words, a scalar subquery; it only spares
    rows that no seed can match, and is at most MOST_BIT_WORDS long."""
    slot = F.pmod("seed", F.lit(words * 64).cast("long"))
    bits = seeds.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63L as int)))").alias("b"))
    every = seeds.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(bits, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("table")).scalar()


def _candidates(docs: DataFrame, seeds: DataFrame, n_seeds: int, masks: list[tuple[int, ...]]) -> DataFrame:
    """(doc_id, seed, context) of the windows whose bit is set."""
    words = min(MOST_BIT_WORDS, 1 << max(4, (n_seeds * BITS_EACH // 64).bit_length()))
    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("_h"), _bit_table(seeds, words).alias("_t"))

    def of_mask(mask: tuple[int, ...]) -> Column:
        every = F.transform(_starts(F.size("_h"), mask), lambda i: F.struct(i.alias("i"), _seed_hash(F.col("_h"), i, mask).alias("seed")))

        def is_set(x: Column) -> Column:
            slot = F.pmod(x["seed"], F.lit(words * 64).cast("long"))
            return F.getbit(F.get("_t", F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

        return F.filter(every, is_set)

    found = hashed.select("doc_id", "_h", F.concat(*map(of_mask, masks)).alias("_c"))
    around = F.transform("_c", lambda x: F.struct(x["seed"].alias("seed"), _context(F.col("_h"), x["i"]).alias("context")))
    # The outer form infers no filter on the array, which would be worked out twice.
    return found.select("doc_id", F.explode_outer(around).alias("c")).select("doc_id", F.col("c.seed").alias("_seed"), F.col("c.context").alias("context"))


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_hits, matched, window) for each document that holds part of a benchmark text.

    A pair is reported if some window of 13 words (of all words, for shorter items) agrees in
    place in all but 2 of them (1 for items of 8 to 12 words, none for shorter ones). n_hits
    counts the seed hits that led to such a window, matched is the most words that agree in
    one. Null texts and texts without words give nothing on either side; rows with equal
    doc_id (or null) are reported as one; empty tables give no rows. Texts of any length are
    read whole, in one task each. Only columns doc_id, text and item_id, text are read.
    """
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("_h")).withColumn("n_item", F.size("_h")).filter(F.col("n_item") > 0)
    masks = masks_for(items) or list(MASKS)
    seeds = benchmark_seeds(items, masks)
    n_seeds = seeds.count()
    blocks = max(1, -(-n_seeds // BROADCAST_ROWS))
    found = []
    for k in range(blocks):
        block = seeds if blocks == 1 else seeds.filter(F.pmod("seed", F.lit(blocks).cast("long")) == k)
        tried = _candidates(docs, block, n_seeds // blocks + 1, masks)
        found.append(tried.join(F.broadcast(block), F.col("_seed") == F.col("seed")))  # about BROADCAST_ROWS rows
    # The row number keeps the filter below from being moved into the join and written out there.
    hits = reduce(DataFrame.unionByName, found).select("doc_id", "item_id", "n_item", "item_context", "context", F.monotonically_increasing_id().alias("_hit"))
    agree = F.transform(F.zip_with("context", "item_context", lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False)).cast("int"))
    window = F.least(F.lit(WINDOW), F.col("n_item"))
    most = F.when(F.size("_agree") > 0, F.array_max(F.transform(F.sequence(F.lit(0), window - 1), lambda s: F.aggregate(F.slice("_agree", _REACH + 1 - s, window), F.lit(0), lambda t, x: t + x))))
    allowed = F.when(F.col("n_item") >= WINDOW, SUBSTITUTIONS).when(F.col("n_item") >= FREE_WORDS, 1).otherwise(0)
    scored = hits.select("doc_id", "item_id", "n_item", "_hit", agree.alias("_agree")).select("doc_id", "item_id", "_hit", window.alias("window"), most.alias("matched"), allowed.alias("_allowed"))
    return (
        scored.filter(F.col("matched") >= F.col("window") - F.col("_allowed"))
        .groupBy("doc_id", "item_id")
        .agg(F.count("_hit").alias("n_hits"), F.max("matched").cast("long").alias("matched"), F.max("window").cast("long").alias("window"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text ``benchmark_overlaps`` reports.

    Rows are judged by their own texts, also where doc_id is null or repeats. Null and empty
    texts stay; columns stay as they are; an empty table gives no rows.
    """
    own = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")).alias("doc_id"), "text")
    bad = benchmark_overlaps(own, benchmark).select(F.col("doc_id.id").alias("_bad"), F.col("doc_id.text").alias("_bad_text")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")) & (F.xxhash64("text") == F.col("_bad_text")), "left_anti")
