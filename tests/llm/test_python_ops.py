"""Operators 3, 4, 8 and 10 against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadweave.llm import encoding, licenses, queries, sharding, token_counts, token_files
from tests.llm.cases import no_documents, odd_documents, sf


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def whole_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@given(st.integers(1, 32), st.data())
@settings(max_examples=60, deadline=None)
def test_pack_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=70)), dtype="<u4")
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert token_files.unpack(packed, bits, len(ids)).tolist() == ids.tolist()


def test_random_access():
    ids = np.arange(1000, dtype="<u4")
    held = token_files.TokenFile(token_files.file_bytes([5, None], [ids[:400], ids[400:]], 10, block=64))
    assert held.read(63, 65).tolist() == [63, 64] and held.read(990, 1000).tolist() == list(range(990, 1000))
    assert held.document(1).tolist() == list(range(400, 1000)) and held.valid.tolist() == [1, 0]


def expected_token_rows(tokenizer, docs):
    rows, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = np.array([*whole_ids(tokenizer, r.text), 2], "<u4")
        rows.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return rows


@pytest.mark.parametrize("make", [odd_documents, sf])
def test_token_files(spark, tokenizer, make):
    docs = make(spark)
    got = token_files.token_files(docs, queries.tokenizer_path()).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected_token_rows(tokenizer, docs)


def test_token_files_many_files(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 2000)
    monkeypatch.setattr(token_files, "PARTITION_BYTES", 100_000)
    docs = sf(spark)
    got = token_files.token_files(docs, queries.tokenizer_path()).orderBy("start").collect()
    assert len({r.file for r in got}) > 20
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected_token_rows(tokenizer, docs)


def test_token_files_empty(spark):
    assert token_files.token_files(no_documents(spark), queries.tokenizer_path()).collect() == []


def test_token_counts(spark, tokenizer):
    docs = odd_documents(spark).withColumn("n_tokens", F.lit("clash"))
    lengths = [len(whole_ids(tokenizer, r.text)) for r in docs.collect()]
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(docs, queries.tokenizer_path())).cache()
    rows = {r.n_tokens: r for r in histogram.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(lengths)
    for k, r in rows.items():
        assert r.truncated_total == sum(min(k, x) for x in lengths) and r.total_tokens == sum(lengths)
        assert r.docs_at_least == sum(x >= k for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= k)
        assert r.dropped_tokens == r.total_tokens - r.truncated_total and r.rank_below == sum(x < k for x in lengths)
    for limit in (0, 1, 3, 10, 10**6):
        assert token_counts.truncated_total(histogram, limit).first()[0] == sum(min(limit, x) for x in lengths)
    for share in (0.01, 0.5, 0.9, 1.0):
        assert token_counts.length_quantile(histogram, share).first()[0] == sorted(lengths)[-int(-share * len(lengths) // 1) - 1]
    empty = token_counts.length_histogram(token_counts.encoded_lengths(no_documents(spark), queries.tokenizer_path()))
    assert empty.collect() == [] and token_counts.truncated_total(empty, 5).first()[0] == 0


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for i in range(len(words)) for phrase, label in licenses.BASE.items() if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


@pytest.mark.parametrize("make", [odd_documents, sf, no_documents])
def test_licenses_base(spark, make):
    docs = make(spark)
    got = licenses.scan_licenses(docs.withColumn("labels", F.lit("clash"))).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got))) == sorted(
        map(repr, ((r.doc_id, *brute_base(r.text)) for r in docs.collect()))
    )
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize(
    "expression, postfix, labels, freedom",
    [
        ("MIT", "MIT", {"mit"}, 1.0),
        ("MIT OR Apache-2.0", "MIT Apache-2.0 or", {"mit", "apache"}, 1.0),
        ("GPL-2.0-only AND MIT OR MPL-2.0", "GPL-2.0-only MIT and MPL-2.0 or", {"gpl", "mit", "mpl"}, 0.7),
        ("GPL-2.0-only AND (MIT OR MPL-2.0)", "GPL-2.0-only MIT MPL-2.0 or and", {"gpl", "mit", "mpl"}, 0.4),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR AGPL-3.0+", "GPL-2.0-only Classpath-exception-2.0 with AGPL-3.0+ or", {"gpl", "agpl"}, 0.6),
        ("MIT and", "MIT", {"mit"}, 1.0),
        ("(MIT", "MIT", {"mit"}, 1.0),
        ("MIT) or", "MIT", {"mit"}, 1.0),
        ("or MIT", "", set(), None),
        ("MIT this is prose", "MIT", {"mit"}, 1.0),
        ("", "", set(), None),
    ],
)
def test_expressions(expression, postfix, labels, freedom):
    got = licenses.to_postfix(expression)
    assert [x.lower() for x in got] == postfix.lower().split()
    named, free = licenses.evaluate(got)
    assert named == labels and (free == freedom or free == pytest.approx(freedom))


def test_labels_of_method(spark):
    docs = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0."), (2, "// SPDX-License-Identifier: MIT OR GPL-3.0-only\ncode"), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score, r.expressions) for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: ("cc-by-nc", 0.1, []), 2: ("gpl,mit", 1.0, ["mit gpl-3.0-only or"]), 3: ("", 0.0, [])}


def test_prose_after_a_tag_is_no_expression():
    scan = licenses.LicenseScanner().scan
    assert scan("license identifier: the quick brown fox")[5:] == ("", 0.0, [])
    assert scan("license identifier: WTFPL")[5:] == ("wtfpl", licenses.UNKNOWN, ["wtfpl"])
    assert scan("license identifier: MIT or the other")[5:] == ("mit", 1.0, ["mit"])


def test_many_hits_take_linear_time():
    n_words, n_base, first, last, *_ = licenses.LicenseScanner().scan("mit license " * 200_000)
    assert (n_words, n_base, first, last) == (400_000, 200_000, 0, 399_998)


def test_other_tokenizer_files_take_whole_texts(tmp_path):
    import json

    config = json.load(open(queries.tokenizer_path()))
    assert encoding.encodes_by_piece(config)
    config["normalizer"]["normalizers"] = config["normalizer"]["normalizers"][:2]  # keeps case
    (tmp_path / "t.json").write_text(json.dumps(config))
    coder = encoding.PieceEncoder(str(tmp_path / "t.json"))
    texts = ["Hello, World. It's A <|endoftext|> TEST", None, ""]
    assert not coder.by_piece
    assert [x.tolist() for x in coder.encode(texts)] == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_go_to_the_library_in_lots(tokenizer):
    """New words share texts and leave their punctuation behind; ids stay those of whole texts."""

    class Counted:
        texts = 0

        def encode_batch_fast(self, texts, **kw):
            self.texts += len(texts)
            return tokenizer.encode_batch_fast(texts, **kw)

    def check(texts):
        coder = encoding.PieceEncoder(queries.tokenizer_path())
        coder.tokenizer = counted = Counted()
        assert [x.tolist() for x in coder.encode(texts, group=3)] == [whole_ids(tokenizer, t) for t in texts]
        return counted.texts

    words = ["".join(chr(97 + (k * m) % 26) for m in (1, 3, 5, 7, 11)) + chr(97 + k % 26) for k in range(1000)]
    assert check([" ".join(w + ("$$$", ".", ",!!", "")[k % 4] for k, w in enumerate(words))] * 2) < 30
    odd = ["don't!' 're'' x's.' ll'll, a×. ÷, é... É, ÿ!? ſ. ǅa. ª. µ, e\u0301. e\u0301a, ΑΣ. ΑΣ, ß? İ.", "a<|endoftext|>. <|endoftext|>, b<| c|>! A<|ENDOFTEXT|>.", "</w> a</w> a</w>. </ w> \u00a0x.\u2003y,\u0338 a<\u0338 z\x00. z\x1c."]
    check([*odd, None, "", *odd, "é" * 100 + "!!", "x" * 100 + "."] * 2)


def test_expression_to_the_end_of_its_line():
    names = [f"lib{i}-license" for i in range(300)]
    line = "SPDX-License-Identifier: (" + " AND ".join(names) + " OR MIT) AND GPL-3.0-only"
    *_, labels, score, expressions = licenses.LicenseScanner().scan(f"{line}\nAND AGPL-3.0-only\nlicense-expression: MIT")
    assert set(labels.split(",")) == {*names, "mit", "gpl"} and score == licenses.FREEDOM["gpl"]
    assert expressions == [" ".join([names[0], *(f"{x} and" for x in names[1:]), "mit or gpl-3.0-only and"]), "mit"]


def check_shards(docs, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()
    )
    sizes = [0] * shards
    for s in range(shards):
        mine = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        sizes[s] = sum(r.size for r in mine)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in rows)
    mean, most = sum(sizes) / shards, max((r.size for r in rows), default=0)
    assert all(abs(x - mean) <= 0.002 * mean + most for x in sizes), sizes


@pytest.mark.parametrize("make, shards, part", [(odd_documents, 4, 1 << 20), (sf, 16, 1 << 26), (sf, 16, 4096), (no_documents, 16, 1 << 26)])
def test_shards(spark, make, shards, part):
    docs = make(spark)
    check_shards(docs, sharding.shard_by_bytes(docs, shards, part_bytes=part).collect(), shards)


def test_shards_of_one_hot_id(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same words").alias("text"), F.lit("x").alias("slot"))
    check_shards(docs, sharding.shard_by_bytes(docs, 8, carry=["doc_id"], part_bytes=500).collect(), 8)
