"""The corpus pipeline, each stage against brute force on its own input."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from roadweave.llm import mixing, oracles, sharding
from roadweave.llm.shared import stored
from tests.llm import cases
from tests.llm.cases import no_documents, odd_documents
from tests.llm.test_other_ops import brute_join, brute_overlaps
from tests.llm.test_python_ops import check_shards

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    stages = dict(corpus_pipeline.STAGES)
    kept = {d for d, k in db.sql(f"SELECT doc_id, kept FROM ({oracles.OP1})").fetchall() if k}

    good = stored(stages["quality_rules"](spark, docs, SF), "t")
    assert good.columns == list(corpus_pipeline.COLUMNS) and {r.doc_id for r in good.collect()} == kept

    single = stored(stages["near_duplicates"](spark, good, SF), "t")
    assert single.columns == good.columns and Counter(r.doc_id for r in single.collect()) == Counter({c for _, _, c in brute_join(good.collect())})

    clean = stored(stages["benchmark_decontamination"](spark, single, SF), "t")
    rows = single.collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    leaked = {d for d, _ in brute_overlaps([(r.doc_id, r.text) for r in rows], [(r.item_id, r.text) for r in items])}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - leaked

    mixed = stored(stages["source_mixing"](spark, clean, SF), "t")
    assert mixed.columns == good.columns and Counter(mixed.collect()) == Counter(clean.collect())

    check_shards(mixed, stages["sharding"](spark, mixed, SF).collect(), 16)


def good_documents(spark):
    """Odd rows, none of which the rules keep, and good texts: plain, alike, leaked, without doc_id or source."""
    text = lambda tag, n=80: " ".join(f"{tag}word{i}" for i in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(100 + i, text(f"d{i}"), "en", f"g{i % 2}", 0) for i in range(6)]
    rows += [(200, text("d0"), "en", "g0", 0), (201, text("d1") + " more", "en", "g1", 0), (202, f"{text('x')} {item}", "en", "g0", 0)]
    rows += [(None, text("n"), None, None, None), (None, text("m"), "en", "g1", None), (103, text("again"), "en", "g1", 0), (300, text("long", 40_000), "en", "g1", 0)]
    return odd_documents(spark).unionByName(spark.createDataFrame(rows, cases.DOCS))


def test_odd_and_empty(spark, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    good_documents(spark).write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    want = [(100 + i, f"d{i}word0") for i in range(6)] + [(None, "nword0"), (None, "mword0"), (103, "againword0"), (300, "longword0")]
    assert Counter((r.doc_id, r.text.split()[0]) for r in rows) == Counter(want)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    no_documents(spark).write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


def test_shards_keep_the_mix(spark):
    """Two thirds of the rows are hot; by bytes to the power 1 / 1.4 it has 62 % until the others run dry."""
    rows = [(i, f"{i:04d} " + "x" * 2_995, "en", "hot" if i % 3 else "rare", 3_000) for i in range(6_000)]
    docs = stored(spark.createDataFrame(rows, cases.DOCS).repartition(5), "t")
    mixed = corpus_pipeline.mixture(spark, docs, SF)
    want = [r.doc_id for r in mixing.mix(docs).orderBy("position", "place").collect()]
    got = sorted(corpus_pipeline.shards(spark, stored(mixed, "t"), SF).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in got] == want
    share = 2 ** (1 / 1.4) / (1 + 2 ** (1 / 1.4))
    first = [r.source for r in got if r.shard < 4]  # less than two blocks of 87 documents from the target
    assert abs(first.count("hot") - share * len(first)) < 2 * 88


def test_shards_of_many_files(spark):
    docs = stored(spark.range(0, 5_000, 1, 37).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text")), "t")
    got = sharding.shard_by_bytes(docs, 16, order=sharding.stored_place(), part_bytes=4096).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == list(range(5_000))
    check_shards(docs, got, 16)
