"""Operators 1, 2, 5, 6, 7 and 9 against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import chat_format, components, decontamination, mixing, ngram_join, quality_classifier, quality_rules, queries, sharding
from tests.llm.cases import no_documents, odd_documents, sf

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    words, lines = SPACE_WORDS.findall(text or ""), [x for x in (text or "").split("\n") if SPACE_WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("make", [odd_documents, sf, no_documents])
def test_quality_rules(spark, make):
    docs = make(spark).withColumn("n_words", F.lit("clash")).withColumn("suspect", F.lit("clash"))
    got = quality_rules.judge_documents(docs).collect()
    rows = docs.collect()
    key = lambda r: repr((r.doc_id, r.text))
    for r, g in zip(sorted(rows, key=key), sorted(got, key=key), strict=True):
        n, chars, symbols, dup_lines, repeat = brute_measures(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, dup_lines, repeat), r.doc_id
        assert g.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (g.base_failed and g.kept)


def test_host_verdicts(spark):
    rows = [(f"h{h}", i < fails) for h, (n, fails) in enumerate([(1000, 10), (1000, 900), (4, 4), (40, 1)]) for i in range(n)]
    judged = spark.createDataFrame([*rows, (None, True)], "source string, rule_failed boolean")
    got = {r.host: r for r in quality_rules.host_verdicts(judged, "source").collect()}
    rates = np.array([0.01, 0.9, 1.0, 0.025])
    m, v = rates.mean(), rates.var(ddof=1)
    s = max(1.0, m * (1 - m) / v - 1)
    for host, n, k in (("h0", 1000, 10), ("h1", 1000, 900), ("h2", 4, 4), ("h3", 40, 1)):
        assert got[host].shrunk_rate == pytest.approx((k + m * s) / (n + s))
    assert got["h1"].condemned and not got["h0"].suspect and set(got) == {"h0", "h1", "h2", "h3"}


def brute_sets(rows):
    out = []
    for r in rows:
        words = SPACE_WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    return out


def brute_components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute_links(rows):
    """Pairs of rows (by place) at similarity 3/4 or more, and all sets."""
    sets = brute_sets(rows)
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for t in s:
            at[t].append(k)
    shared = Counter(p for ks in at.values() for p in itertools.combinations(ks, 2))
    return [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)], sets


def brute_rows(rows):
    """(doc_id, n_shingles, component_id, n_links) of each row, and each row's component by place."""
    links, sets = brute_links(rows)
    part = brute_components(range(len(rows)), links)
    least = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[part[k]] = min(least.get(part[k], r.doc_id), r.doc_id)
    n_links = Counter(k for pair in links for k in pair)
    return [(r.doc_id, len(sets[k]), least.get(part[k]), n_links[k]) for k, r in enumerate(rows)], part


def brute_join(rows):
    return Counter(x[:3] for x in brute_rows(rows)[0])


def near_copies(spark):
    """Chains and stars of near copies around the threshold, many sharing a passage."""
    random = np.random.default_rng(5)
    rows, passage = [], " ".join(f"p{i}" for i in range(60))
    for base in range(12):
        words = [f"b{base}w{i}" for i in range(int(random.integers(6, 120)))]
        for copy in range(12):
            edited = list(words)
            for _ in range(int(random.integers(0, max(2, len(words) // 18)))):
                edited[int(random.integers(len(edited)))] = f"x{len(rows)}"
            text = " ".join(edited) + (f" {passage}" if copy % 2 else "")
            rows.append((1000 - len(rows), text, "en", "s", 0))
            words = edited if base % 3 == 0 else words
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("make, lot, often", [(odd_documents, 256, 12), (sf, 256, 12), (near_copies, 256, 12), (near_copies, 3, 2), (no_documents, 256, 12)])
def test_ngram_join(spark, monkeypatch, make, lot, often):
    monkeypatch.setattr(ngram_join, "LOT", lot)
    monkeypatch.setattr(ngram_join, "VISITORS", lot)
    monkeypatch.setattr(ngram_join, "LEAST_COUNT", often)
    docs = make(spark)
    got = ngram_join.ngram_components(docs)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id", "n_links").collect())) == Counter(brute_rows(docs.collect())[0])


@pytest.mark.parametrize("make, lot", [(odd_documents, 256), (near_copies, 3), (near_copies, 2048)])
def test_ngram_links(spark, monkeypatch, make, lot):
    """Every pair of linked rows, expanded from the pairs of classes."""
    monkeypatch.setattr(ngram_join, "LOT", lot)
    monkeypatch.setattr(ngram_join, "LEAST_COUNT", 2 if lot == 3 else 12)
    docs = make(spark)
    rows = docs.collect()
    links, sets = brute_links(rows)
    want = Counter((frozenset((rows[a].doc_id, rows[b].doc_id)), frozenset((len(sets[a]), len(sets[b]))), len(sets[a] & sets[b])) for a, b in links)
    held = defaultdict(list)
    for r in ngram_join.ngram_classes(docs).collect():
        held[r["class"]].append(r.doc_id)
    got, seen = Counter(), set()
    for r in ngram_join.ngram_links(docs).collect():
        assert (r.class_a, r.class_b) not in seen and r.class_a <= r.class_b
        seen.add((r.class_a, r.class_b))
        least = [min((x for x in held[c] if x is not None), default=None) for c in (r.class_a, r.class_b)]
        assert (r.doc_a, r.docs_a, r.doc_b, r.docs_b) == (least[0], len(held[r.class_a]), least[1], len(held[r.class_b]))
        pairs = itertools.combinations(held[r.class_a], 2) if r.class_a == r.class_b else itertools.product(held[r.class_a], held[r.class_b])
        got.update((frozenset(p), frozenset((r.n_a, r.n_b)), r.n_common) for p in pairs)
    assert got == want and want


@pytest.mark.parametrize("make, lot, often", [(near_copies, 256, 12), (near_copies, 3, 2), (odd_documents, 256, 12), (sf, 2048, 12), (no_documents, 256, 12)])
def test_keep_one_each(spark, monkeypatch, make, lot, often):
    monkeypatch.setattr(ngram_join, "LOT", lot)
    monkeypatch.setattr(ngram_join, "LEAST_COUNT", often)
    docs = make(spark) if make is sf or make is no_documents else make(spark).unionByName(odd_documents(spark))
    kept = ngram_join.keep_one_each(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    found, part = brute_rows(rows)
    assert Counter(r.doc_id for r in kept.collect()) == Counter({c: found[c][2] for c in set(part.values())}.values())


def test_same_id_two_texts(spark):
    """Rows with one doc_id and different texts are told apart, and so are rows without doc_id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame([(5, a), (5, b), (7, b + " c"), (3, a + " c"), (9, "z"), (None, c), (None, c + " d"), (None, a), (None, None)], "doc_id long, text string")
    got = Counter(map(tuple, ngram_join.ngram_components(docs).collect()))
    assert got == Counter([(5, 26, 3, 2), (5, 26, 5, 1), (7, 27, 5, 1), (3, 27, 3, 2), (9, 1, 9, 0), (None, 26, None, 1), (None, 27, None, 1), (None, 26, 3, 2), (None, 0, None, 0)])
    kept = Counter((r.doc_id, (r.text or "")[:1]) for r in ngram_join.keep_one_each(docs).collect())
    assert kept == Counter([(5, "b"), (3, "a"), (9, "z"), (None, "c"), (None, "")])


def test_prefixes_of_random_sets_share_enough():
    """The bound that the join rests on, for sets around the threshold and any order of tokens."""
    random = np.random.default_rng(1)
    order = ngram_join.Order(np.arange(40, 80, dtype=np.uint64), random.permutation(40))
    for _ in range(3000):
        base = random.permutation(100)[: random.integers(1, 60)]
        a, b = (np.sort(base[random.random(len(base)) < 0.93]).astype(np.uint64) for _ in range(2))
        if len(a) and len(b) and 7 * len(np.intersect1d(a, b)) >= 3 * (len(a) + len(b)):
            (ra, fa), (rb, fb) = (order.prefix(x, order.places(x)) for x in (a, b))
            c = len(np.intersect1d(np.r_[ra, fa], np.r_[rb, fb]))
            assert c >= max(1, -(-3 * (len(a) + len(b)) // 7) - -(-3 * max(len(a), len(b)) // 4) + 1)


def test_short_items_and_one_substitution(spark):
    """Items of 1 to 14 words, copied with a word replaced at each place in turn."""
    docs, items, k = [], [], 0
    for n in range(1, 15):
        words = [f"i{n}w{j}" for j in range(n)]
        items.append((n, " ".join(words)))
        for lost in range(-1, n):
            for pad in ("", "before it "):
                docs.append((k, pad + " ".join("other" if j == lost else w for j, w in enumerate(words)) + (" after" if k % 3 else "")))
                k += 1
    table, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontamination.benchmark_overlaps(table, benchmark).collect()}
    assert got == brute_overlaps(docs, items) and len({i for _, i in got}) == 14


def test_decontaminate_by_text(spark):
    """Rows with null or repeated doc_id go by their own texts."""
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item), (None, "clean"), (4, item), (4, "clean too"), (5, None), (4, item)], "doc_id long, text string")
    kept = decontamination.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(None, "clean"), (4, "clean too"), (5, None)])


def test_names_that_clash(spark):
    """Columns of any name survive; those named like results, in any case, are replaced."""
    docs = sf(spark).limit(40)
    odd = docs.withColumns({c: F.lit("odd") for c in ("_row", "_size", "_words", "_lines", "_source", "_block", "_order", "_rate", "_key", "_part", "_kept", "h")})
    for columns, run in (
        (("Kept", "N_WORDS"), quality_rules.judge_documents),
        (("POSITION", "Release"), mixing.mix),
        (("SIZE", "Shard"), sharding.shard_by_bytes),
    ):
        rows = run(odd.withColumns({c: F.lit("old") for c in columns}))
        lower = [c.lower() for c in rows.columns]
        assert len(set(lower)) == len(lower) and not {c for c in columns if c in rows.columns}
        got = rows.collect()
        assert len(got) == docs.count() and {r["_row"] + r["_size"] + r["_words"] + r["h"] for r in got} == {"odd" * 4}


def test_rings_of_replies(spark):
    """Replies in a ring, and what hangs on them, have no path; a string conv_id null is a conversation of its own."""
    nodes = [("t", 1, None), ("t", 2, 1), ("r", 5, 6), ("r", 6, 5), ("r", 7, 6)]
    messages = spark.createDataFrame([(t, n, p, 1.0, "user", str(n)) for t, n, p in nodes], "tree string, node long, parent long, score double, role string, text string")
    assert [r.tree for r in chat_format.format_trees(messages).collect()] == ["t"]
    rows = spark.createDataFrame([("null", 0, "user", "a"), (None, 0, "user", "b")], "conv_id string, turn long, role string, text string")
    assert {r.conv_id: r.n_turns for r in chat_format.read_back(chat_format.format_trees(chat_format.conversation_messages(rows))).collect()} == {"null": 1, None: 1}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 150), (150, 200), (150, 170)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 150: 150, 170: 150, 200: 150}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def digests(turns):
    said = "".join(f"{role or ''}\n{text or ''}\n" for role, text in turns)
    loss = "".join(text or "" for role, text in turns if role == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


ODD_CHATS = [
    (1, 0, "user", "a\\<|im_end|>\nb"),
    (1, 1, "assistant", "\\<|im_start|>\\\\<\\|x <| \U0001f600\n"),
    (2, 0, "sys\ntem\\n<|", None),
    (2, 5, "assistant", ""),
    (2, 5, "assistant", ""),
    (2, None, None, "first"),
    (None, 0, "user", "<|im_end|>"),
    *((3, i, "assistant" if i % 2 else "user", f"turn {i} é") for i in range(70)),
]


def test_chat_format(spark):
    rows = spark.createDataFrame(ODD_CHATS, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("clash"))
    messages = chat_format.conversation_messages(chat_format.with_hostile_conversation(rows))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(chat_format.format_trees(messages)).collect()}
    by = defaultdict(list)
    for c, t, role, text in ODD_CHATS + [(-1, 0, "user", chat_format.HOSTILE), (-1, 1, "assistant", chat_format.HOSTILE)]:
        by[c].append((t is not None, t or 0, role or "", role, text))
    expected = {c: digests([(role, text) for *_, role, text in sorted(v, key=lambda x: x[:3])]) for c, v in by.items()}
    assert got == expected
    assert chat_format.format_trees(messages.limit(0)).collect() == []


def test_conversations_query(spark):
    got = queries.op5_chat_format(spark, "/root/testdata/sf0.001").collect()
    by = defaultdict(list)
    for r in sf(spark, "conversations").orderBy("conv_id", "turn").collect():
        by[r.conv_id].append((r.role, r.text))
    by[-1] = [("user", chat_format.HOSTILE), ("assistant", chat_format.HOSTILE)]
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {c: digests(v) for c, v in by.items()}


def test_reply_tree_branches(spark):
    #   1 -> 2 -> 4, 1 -> 3 -> 5 -> 6; scores make 1-2-4 the best branch of tree t; u is one message whose parent is lost
    nodes = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 4, 2, 0.0), ("t", 3, 1, 1.0), ("t", 5, 3, 1.0), ("t", 6, 5, None), ("u", 9, 77, 2.0)]
    messages = spark.createDataFrame([(t, n, p, s, "user", str(n)) for t, n, p, s in nodes], "tree string, node long, parent long, score double, role string, text string")
    best = {r.tree: r.formatted for r in chat_format.format_trees(messages).collect()}
    whole = lambda *ids: "".join(f"<|im_start|>user\n{i}<|im_end|>\n" for i in ids)
    assert best == {"t": whole(1, 2, 4), "u": whole(9)}
    every = {(r.tree, r.branch): r.formatted for r in chat_format.format_trees(messages, most=None).collect()}
    assert every == {("t", 1): whole(1, 2, 4), ("t", 2): whole(1, 3, 5, 6), ("u", 1): whole(9)}


def check_plan(plan, weights):
    """One block a position, all blocks placed, windows kept, and less than one block from the ideal."""
    order = [r.source for r in sorted(plan, key=lambda r: r.position)]
    assert sorted(r.position for r in plan) == list(range(len(plan)))
    supply = Counter(order)
    assert sorted((r.source, r.block) for r in plan) == sorted((s, k) for s, n in supply.items() for k in range(n))
    for r in plan:
        assert r.release <= r.position < r.deadline
    ideal, taken, left = Counter(), Counter(), dict(supply)
    for source in order:  # the fluid ideal, slot by slot, with sources leaving as they run dry
        step = 1.0
        while step > 1e-9 and any(left[s] > 1e-9 for s in left):
            live = [s for s in left if left[s] > 1e-9]
            total = sum(weights[s] for s in live)
            span = min([step, *(left[s] * total / weights[s] for s in live)])
            for s in live:
                ideal[s] += span * weights[s] / total
                left[s] -= span * weights[s] / total
            step -= span
        taken[source] += 1
        assert all(abs(ideal[s] - taken[s]) < 1 + 1e-6 for s in supply), (ideal, taken)


def plan_of(spark, supply, weights):
    table = spark.createDataFrame(list(supply.items()), "source string, blocks long")
    return mixing.schedule(table, spark.createDataFrame(list(weights.items()), "source string, weight double")).collect()


@pytest.mark.parametrize("supply, weights", [
    ({"a": 7, "b": 5, "c": 9}, {"a": 1.0, "b": 1.0, "c": 1.0}),
    ({"a": 100, "b": 3, "c": 40, "d": 1}, {"a": 0.4, "b": 0.05, "c": 0.5, "d": 0.05}),
    ({f"s{i}": 5 + 11 * i for i in range(12)}, {f"s{i}": (i + 1) ** 0.5 for i in range(12)}),
    ({"a": 1}, {"a": 0.1}),
])
def test_schedule(spark, supply, weights):
    check_plan(plan_of(spark, supply, weights), weights)


@pytest.mark.parametrize("make, block", [(sf, 2000), (sf, 20_000), (odd_documents, 100), (odd_documents, 1 << 20)])
def test_mixing(spark, make, block):
    docs = make(spark).withColumn("position", F.lit("clash"))
    rows = mixing.mix(docs, block_bytes=block).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(r.release <= r.position < r.deadline for r in rows)
    assert len({(r.source, r.place) for r in rows}) == len(rows)
    for source in {r.source for r in rows}:  # blocks are cut by the running count of bytes
        before = 0
        for r in sorted((r for r in rows if r.source == source), key=lambda r: r.place):
            assert r.place == before and r.source_block == before // block
            before += len((r.text or "").encode()) + 1


def test_mixing_given_weights(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    weights = spark.createDataFrame([("s0", 0.7), ("s1", 0.2), ("s2", 0.1), ("none", 5.0)], "source string, weight double")
    start = [r.source for r in sorted(mixing.mix(docs, weights, block_bytes=10).collect(), key=lambda r: r.position)[:100]]
    assert abs(start.count("s0") - 70) <= 1 and abs(start.count("s1") - 20) <= 1
    rows = mixing.mix(docs, weights.filter("source = 's0'"), block_bytes=10).collect()  # the others follow
    assert {r.source for r in rows if r.position < 200} == {"s0"} and len(rows) == 600
    assert mixing.mix(docs.limit(0)).collect() == []


@pytest.mark.parametrize("supply, weights", [
    ({"a": 100, "b": 3, "c": 40, "d": 1}, {"a": 0.4, "b": 0.05, "c": 0.5}),
    ({f"s{i}": 5 + 11 * i for i in range(12)}, {f"s{i}": (i + 1) ** 0.5 for i in range(12)}),
])
def test_schedules_agree(spark, supply, weights):
    table = spark.createDataFrame(list(supply.items()), "source string, blocks long")
    targets = spark.createDataFrame(list(weights.items()), "source string, weight double")
    assert Counter(map(tuple, mixing.schedule_many(table, targets).collect())) == Counter(map(tuple, mixing.schedule(table, targets).collect()))


def test_mixing_many_sources(spark):
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.concat(F.lit("s"), F.least(F.pmod("id", F.lit(3_000)), F.lit(1_500)).cast("string")).alias("source"))
    rows = mixing.mix(docs, block_bytes=20).collect()
    assert sorted(r.doc_id for r in rows) == list(range(9_000)) and len({r.source for r in rows}) == 1_501
    plan = list({(r.source, r.source_block): r for r in rows}.values())
    assert sorted(r.position for r in plan) == list(range(len(plan)))
    assert all(r.release <= r.position < r.deadline for r in rows)


def test_masks_find_any_two_substitutions():
    span = range(decontamination.WINDOW)
    for lost in itertools.combinations(span, decontamination.SUBSTITUTIONS):
        assert any(all(p + k not in lost for k in mask) for mask in decontamination.MASKS for p in span if p + mask[-1] in span)


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_overlaps(docs, items):
    out = {}
    for d, text in docs:
        words = WORDS.findall((text or "").lower())
        for i, item in items:
            sought = WORDS.findall((item or "").lower())
            if not sought:
                continue
            window = min(13, len(sought))
            need, best = window - (2 if len(sought) >= 13 else 1 if len(sought) >= 8 else 0), 0
            for shift in range(-len(sought), len(words)):
                same = [0 <= shift + k < len(words) and words[shift + k] == w for k, w in enumerate(sought)]
                if sum(same) >= need:
                    best = max(best, *(sum(same[k : k + window]) for k in range(len(sought) - window + 1)))
            if best >= need:
                out[(d, i)] = best
    return out


def test_decontamination(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wise owls watch from above"
    words = item.split()
    docs = [(0, item), (1, "Before. " + item.upper() + "! after"), (2, " ".join(w if k not in (3, 9) else "x" for k, w in enumerate(words))), (3, " ".join(w if k % 3 else "x" for k, w in enumerate(words)))]
    docs += [(4, " ".join(words[:11])), (5, " ".join(words[2:15])), (6, None), (7, ""), (8, "one"), (None, item), (9, "alpha beta gamma delta epsilon zeta eta theta"), (10, "alpha beta gamma x epsilon zeta eta theta"), (0, "nothing")]
    items = [(0, item), (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "too short to seek"), (3, None), (4, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("seed", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontamination.benchmark_overlaps(d, b).collect()}
    expected = brute_overlaps(docs, items)
    assert got == expected and {(9, 1), (10, 1)} <= set(got)
    assert {k[0] for k in got} >= {0, 1, 2, 5, None} and not {3, 6, 7, 8} & {k[0] for k in got}
    left = Counter(r.doc_id for r in decontamination.decontaminate(d, b).collect())
    assert None not in left and left[0] == 1 and left[3] == 1  # of two rows with doc_id 0 the clean one stays
    assert decontamination.benchmark_overlaps(d.limit(0), b).collect() == [] and decontamination.benchmark_overlaps(d, b.limit(0)).collect() == []


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, items = sf(spark), sf(spark, "benchmark")
    whole = Counter(map(tuple, decontamination.benchmark_overlaps(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 700)
    assert Counter(map(tuple, decontamination.benchmark_overlaps(docs, items).collect())) == whole
    expected = brute_overlaps([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert {(d, i): m for d, i, _, m, _ in whole} == expected


def test_classifier_held_out(spark):
    docs, labels = sf(spark, scale="0.1"), sf(spark, "labels", "0.1")
    got = quality_classifier.classify(docs, labels)
    rows = got.join(labels, "doc_id").collect()
    tested = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len(tested) > 500 and sum(r.predicted == r.quality for r in tested) / len(tested) > 0.97
    good, bad = ([r.score for r in tested if r.quality == q] for q in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97


def test_classifier_odd_rows(spark):
    docs = odd_documents(spark).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, 0, 0), (77, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(docs.limit(0), labels).collect() == []


def test_compiled_rules_agree(spark):
    random = np.random.default_rng(3)
    x = random.random((3000, len(quality_classifier.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.7)).astype(np.int64)
    model = quality_classifier.fit(x, y)
    assert 0 < len(model.rules) < 200
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:200]], list(quality_classifier.STATISTICS))
    compiled = np.array([r[0] for r in frame.select(model.score()).collect()])
    logit = model.intercept + sum(w * quality_classifier.holds(rule, x[:200]) for rule, w in model.rules)
    assert np.allclose(compiled, 1 / (1 + np.exp(-logit))) and ((compiled > 0.5) == (y[:200] == 1)).mean() > 0.97
