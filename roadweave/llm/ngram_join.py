"""N-gram Jaccard join (operator 2).

Method: token-group matrix. Classes of equal sets are partitioned into groups of similar
documents: of its prefix tokens (see below) that another class has too, a class takes the
least as its key, and a group has one key and sizes within a factor of 4/3. The matrix joins
these tokens of every class with the groups whose token union holds them; the sum over tokens
bounds the overlap of a class with a whole group, and only groups whose bound admits a link
are opened. An opened group keeps its members'
tokens as one sorted union with the members of each token; a visitor is first tested against
that union, then counted against all members at once.

Every pair is tried in one place: classes visit groups with lesser keys, and their own group,
whose members lie in lots of bounded size, their own and lesser lots. A lot is opened twice:
with prefix tokens, which leaves the members and visitors that may link, then with their texts.

Exactness. Let J = 3/4. With tokens in any fixed global order, two linked sets a, b share
c tokens among the first n - ceil(3n/4) + 1 of each, and c >= ceil(3(a+b)/7) -
ceil(3 max(a,b)/4) + 1 (all common tokens beyond the shorter of both prefixes lie in the
rest of one set). The order puts frequent tokens last, so that passages many documents
share do not make candidates; frequencies only choose the order, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.components import connected_components
from roadweave.llm.shared import small_batches, stored
from roadweave.llm.shingles import print_of, shingle_sets

#: Members and their tokens that a lot of a group has at most, about; visitors that one task of an opened lot takes, about.
LOT, LOT_TOKENS, VISITORS = 2048, 2_000_000, 512
#: Counters of the frequency summary in each task, and those it reports; tokens that the order
#: puts last; least summed count for it.
COUNTERS, REPORTED, FREQUENT, LEAST_COUNT = 1 << 20, 1 << 16, 1 << 17, 12
#: Bits of the map that keeps texts outside all opened groups from being moved; with more keys than a quarter of it, no map is made.
FILTER_BITS = 1 << 25
#: Matrix rows that one task sorts, about.
MATRIX_ROWS = 1_000_000
#: Fingerprints that a task remembers, so that copies which it reads make rows only once.
SEEN = 1 << 20


class _Frequencies:
    """Misra-Gries summary of the tokens of all documents that a task reads."""

    def __init__(self) -> None:
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        self.held += len(tokens)
        if self.held > COUNTERS:
            self.flush()

    def flush(self) -> None:
        new = np.concatenate([*self.waiting, np.zeros(0, np.uint64)])
        self.waiting, self.held = [], 0
        new, counts = np.unique(new, return_counts=True)
        at = np.searchsorted(self.tokens, new)  # the old ones are sorted: they are merged, not sorted again
        known = at < len(self.tokens)
        known[known] = self.tokens[at[known]] == new[known]
        self.counts[at[known]] += counts[known]
        every, total = (np.insert(old, at[~known], more[~known]) for old, more in ((self.tokens, new), (self.counts, counts)))
        if len(every) > COUNTERS:
            total = total - np.partition(total, len(total) - COUNTERS - 1)[len(total) - COUNTERS - 1]
        self.tokens, self.counts = every[total > 0], total[total > 0]

    def report(self) -> None:
        """Leaves the REPORTED greatest counts over 1."""
        keep = np.flatnonzero(self.counts > 1)
        if len(keep) > REPORTED:
            keep = keep[np.argpartition(self.counts[keep], len(keep) - REPORTED)[len(keep) - REPORTED :]]
        self.tokens, self.counts = self.tokens[keep], self.counts[keep]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document its set's size and fingerprint; at the end the frequent tokens."""
    often = _Frequencies()
    for batch in batches:
        sizes, prints = [np.zeros(0, np.int64)], []
        for _, tokens, bounds in shingle_sets(batch.column("text")):
            often.add(tokens)
            sizes.append(np.diff(bounds))
            prints += [print_of(tokens[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.concatenate(sizes)), pa.array(prints, pa.binary()), pa.nulls(len(prints), pa.int64()), pa.array([False] * len(prints), pa.bool_())],
            names=["doc_id", "n", "print", "token", "summary"],
        )
    often.flush()
    often.report()
    k = len(often.tokens)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(k, pa.int64()), pa.array(often.counts, pa.int64()), pa.nulls(k, pa.binary()), pa.array(often.tokens.view(np.int64)), pa.array([True] * k, pa.bool_())],
        names=["doc_id", "n", "print", "token", "summary"],
    )


class Order:
    """The order of tokens: rare ones by hash, then ``frequent`` ones by their rank."""

    def __init__(self, frequent: np.ndarray, rank: np.ndarray) -> None:
        self.frequent, self.rank = frequent, rank

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token among the frequent ones, -1 for rare ones."""
        if not len(self.frequent):
            return np.full(len(tokens), -1)
        at = np.searchsorted(self.frequent, tokens)
        at[at == len(self.frequent)] = 0
        return np.where(self.frequent[at] == tokens, at, -1)

    def prefix(self, tokens: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rare and frequent tokens among the first n - ceil(3n/4) + 1 of a set that is not empty."""
        length = len(tokens) - (3 * len(tokens) + 3) // 4 + 1
        rare = tokens[places < 0][:length]
        if len(rare) == length:
            return rare, tokens[:0]
        at = places[places >= 0]
        return rare, self.frequent[at[np.argsort(self.rank[at])][: length - len(rare)]]


def _order(survey: DataFrame) -> Order:
    often = survey.filter("summary").groupBy("token").agg(F.sum("n").alias("k")).filter(F.col("k") >= LEAST_COUNT).orderBy(F.col("k").desc(), "token").limit(FREQUENT)
    found = often.collect()  # at most FREQUENT
    tokens = np.array([r.token for r in found], dtype=np.int64).view(np.uint64)
    by_hash = np.argsort(tokens)
    return Order(tokens[by_hash], (len(tokens) - 1 - np.arange(len(tokens)))[by_hash])


#: Bits of a group that hold its size class, the logarithm of the size to the base 4/3.
SIZE_BITS = 6


def _size_class(n: Column) -> Column:
    """Sets that link are in the same size class or the next."""
    return F.least(F.floor(F.log(n) / math.log(4 / 3) + 1e-9), F.lit((1 << SIZE_BITS) - 1)).cast("long")


def _prefixes(slim: DataFrame, order: Order) -> DataFrame:
    """Classes (owner, print, rare, often) with their prefix tokens, once for each task that meets one.

    An owner is the first half of a fingerprint.
    """
    sent = slim.sparkSession.sparkContext.broadcast(order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = sent.value, set()
        for batch in batches:
            for _, tokens, bounds in shingle_sets(batch.column("text")):
                places, prints, rare, often = order.places(tokens), [], [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    name = print_of(tokens[a:b])
                    if name is None or name in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    first = order.prefix(tokens[a:b], places[a:b])
                    prints.append(name)
                    rare.append(first[0])
                    often.append(first[1])
                if prints:
                    owners = np.array([x[:8] for x in prints], "S8").view(">i8").astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(prints, pa.binary()), _lists(rare), _lists(often)], names=["owner", "print", "rare", "often"])

    return stored(slim.select("text").mapInArrow(cut, "owner long, print binary, rare array<long>, often array<long>"), "ngram-prefixes")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    bounds = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(arrays).view(np.int64)))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (owner, token) of the tokens that several owners have, each once."""
    held = [(b.column("owner").to_numpy(), b.column("token").to_numpy()) for b in batches]
    if not held:
        return
    owners, tokens = (np.concatenate(x) for x in zip(*held))
    held.clear()
    for _ in range(2):  # copies that several tasks have met are one owner
        order = np.argsort(tokens, kind="stable")
        owners, tokens = owners[order], tokens[order]
        shared = np.zeros(len(tokens), bool)
        same = tokens[1:] == tokens[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        owners, tokens = owners[shared], tokens[shared]
        order = np.lexsort((owners, tokens))
        owners, tokens = owners[order], tokens[order]
        once = np.ones(len(tokens), bool)
        once[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
        owners, tokens = owners[once], tokens[once]
    for i in range(0, len(tokens), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(owners[i : i + 50_000]), pa.array(tokens[i : i + 50_000])], names=["owner", "token"])


def _touched(prefixes: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """Classes (owner, print, rep, docs, n, tokens, group) that share prefix tokens with others, and those tokens.

    Rare tokens meet in tasks by token. Of frequent ones, one may stand in a third of all
    rows: these are counted with map-side sums and joined, which the engine can split.
    """
    rare = prefixes.select("owner", F.explode("rare").alias("token")).repartition(max(1, -(-rows // MATRIX_ROWS)), "token").mapInArrow(_meet, "owner long, token long")
    often = prefixes.select("owner", F.explode("often").alias("token")).distinct()
    several = often.groupBy(F.col("token").alias("_token")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("_token")
    shared = rare.unionByName(often.join(several, F.col("token") == F.col("_token"), "left_semi"))
    held = shared.groupBy(F.col("owner").alias("_owner")).agg(F.collect_list("token").alias("tokens"))
    names = prefixes.select("owner", F.col("print").alias("_print")).distinct()
    whole = held.join(names, F.col("_owner") == F.col("owner")).join(classes, F.col("_print") == F.col("print")).drop("_owner", "_print")
    key = F.array_min("tokens")
    return stored(whole.withColumn("group", key - F.pmod(key, F.lit(1 << SIZE_BITS)) + _size_class(F.col("n"))), "ngram-touched")


def _matrix(touched: DataFrame) -> DataFrame:
    """(owner, home, c) for each class and each group, not above its own, whose union holds c of its tokens.

    Only groups of a size class that the class may link to come. A class's own group counts
    the tokens that other members have, and 0 makes a member that others may visit. Classes
    join the groups of each token, not each other; the rows of a hot token meet the same few.
    """
    rows = touched.select("owner", "group", F.explode("tokens").alias("token"))
    entries = rows.groupBy(F.col("token").alias("_token"), F.col("group").alias("home")).agg(F.count(F.lit(1)).alias("_members"))
    near = F.abs(F.pmod("home", F.lit(1 << SIZE_BITS)) - F.pmod("group", F.lit(1 << SIZE_BITS))) <= 1
    met = rows.join(entries, (F.col("token") == F.col("_token")) & (F.col("home") <= F.col("group")) & near)
    alone = (F.col("home") == F.col("group")) & (F.col("_members") == 1)
    return met.groupBy("owner", "home").agg(F.sum(F.when(alone, 0).otherwise(1)).alias("c"))


def _needed(least_a: Column, most_a: Column, least_b: Column, most_b: Column) -> Column:
    """A lower bound of the c that a link between members of two groups needs.

    Without rounding, c >= 3(a+b)/7 - 3b/4 + 1/4 for sizes a <= b, which is least for the
    smallest a and the largest b that it can link to.
    """

    def least_c(small: Column, large: Column) -> Column:
        larger = F.least(large, F.floor(small * 4 / 3))
        return F.when(larger >= small, F.ceil(3 * small / 7 - 9 * larger / 28 + 0.25 - 1e-6))

    return F.greatest(F.lit(1), F.coalesce(F.least(least_c(least_a, most_b), least_c(least_b, most_a)), F.lit(1)))


def _visits(slim: DataFrame, survey: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Touched classes, hosts (home, lot, owner, print, rep, docs, n) and visits (the same, and own).

    A visit is one class before one lot of an opened group; ``own`` marks its own lot.
    """
    rows = survey.filter("not summary").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 4
    touched = _touched(_prefixes(slim, _order(survey)), classes, rows)
    own = touched.select(*CLASS, "group")
    lots = F.greatest(F.ceil(F.count(F.lit(1)) / LOT), F.ceil(F.sum("n") / LOT_TOKENS)).cast("long")
    groups = own.groupBy(F.col("group").alias("_home")).agg(F.min("n").alias("_least"), F.max("n").alias("_most"), lots.alias("_lots"))
    met = _matrix(touched).filter("c > 0").withColumnRenamed("owner", "_owner").join(own, F.col("_owner") == F.col("owner")).drop("_owner")
    reach = (4 * F.col("_most") >= 3 * F.col("n")) & (4 * F.col("n") >= 3 * F.col("_least"))
    enough = F.col("c") >= _needed(F.col("n"), F.col("n"), F.col("_least"), F.col("_most"))
    paid = stored(met.join(groups, F.col("home") == F.col("_home")).filter(reach & enough), "ngram-visits")
    lot_of = F.pmod(F.xxhash64("owner"), F.col("_lots")).cast("int")
    mine = paid.withColumn("_own", F.col("home") == F.col("group")).withColumn("_last", F.when(F.col("_own"), lot_of).otherwise(F.col("_lots") - 1).cast("int"))
    visits = mine.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("_last")))).select("home", "lot", (F.col("_own") & (F.col("lot") == F.col("_last"))).alias("own"), *CLASS)
    opened = groups.join(paid.select(F.col("home").alias("_open")).distinct(), F.col("_home") == F.col("_open"), "left_semi")
    hosts = own.join(opened, F.col("group") == F.col("_home")).select(F.col("group").alias("home"), lot_of.alias("lot"), *CLASS)
    return touched, stored(hosts, "ngram-hosts"), visits


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Bit map over the low bits of long keys, FILTER_BITS long at any size of input.

    A clear bit proves that the key is absent; a set bit proves nothing.
    """
    words = (
        keys.select(F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("s"))
        .groupBy(F.shiftright("s", 6).alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(s & 63L as int)))").alias("b"))
        .groupBy(F.shiftright("w", 12).alias("page"))
        .agg(F.collect_list(F.struct("w", "b")).alias("held"))
    )
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.select(F.col("held.w").alias("w"), F.col("held.b").alias("b")).collect():  # at most FILTER_BITS / 64 words in all
        table[row.w] = row.b
    return table


def _admitted(df: DataFrame, column: str, table: np.ndarray) -> DataFrame:
    """Rows of ``df`` whose key's bit is set; the map goes to every task (FILTER_BITS / 8 bytes)."""
    sent = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def passes(keys: pd.Series) -> pd.Series:
        slots = keys.to_numpy() & (FILTER_BITS - 1)
        return pd.Series((sent.value[slots >> 6] >> (slots & 63)) & 1 == 1)

    return df.filter(F.col(column).isNotNull() & passes(F.coalesce(F.col(column), F.lit(0)).cast("long")))


class Lot:
    """Members of one lot of a group: their token union, and the members of each token.

    A member is (print, docs, n, tokens, visit); tokens are its set or its prefix.
    """

    def __init__(self, members: list[tuple]) -> None:
        self.prints = [m[0] for m in members]
        self.place = {p: i for i, p in enumerate(self.prints)}
        self.docs, self.sizes = (np.array([m[k] for m in members], np.int64) for k in (1, 2))
        tokens, owner = np.concatenate([m[3] for m in members]), np.repeat(np.arange(len(members), dtype=np.int32), [len(m[3]) for m in members])
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        self.union, self.bounds = tokens[first], np.r_[first, len(tokens)]
        self.label = np.arange(len(members))
        self.links, self.met = np.zeros(len(members), np.int64), np.zeros(len(members), bool)

    def shared(self, tokens: np.ndarray, least: int) -> np.ndarray | None:
        """Tokens in common with each member; none if fewer than ``least`` are in the union."""
        at = np.searchsorted(self.union, tokens)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == tokens]
        if len(at) < max(1, least):
            return None
        begin, length = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(length)
        return np.bincount(self.owner[np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)], minlength=len(self.sizes))

    def join(self, found: np.ndarray, member: int | None) -> list[int]:
        """Connects the members that one set links to; returns one of each part that was not connected."""
        parts, first = np.unique(self.label[found], return_index=True)
        if member is not None:
            other = parts != self.label[member]
            parts, first = np.r_[parts[other], self.label[member]], first[other]
        if len(parts) > 1:
            self.label[np.isin(self.label, parts)] = parts.min()
        return found[first].tolist()


UNIT = ("home", "lot", "part")
CLASS = ("owner", "print", "rep", "docs", "n")
ASKED = "home long, lot int, part int, owner long, print binary, rep long, docs long, n long, host boolean, visit boolean"
LINKS = "print_a binary, print_b binary, n_common long"
FOUND = "a binary, b binary, links long"


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Opens lots with the shared prefix tokens of their members: rows (ASKED) of one unit, hosts first.

    Leaves visitors that share enough prefix tokens with some host for a link of their two
    sizes, and those hosts.
    """
    names = [x.split()[0] for x in ASKED.split(", ")]
    here, rows, members, lot, waiting, out = None, [], [], None, [], []

    def call(row: list, tokens: np.ndarray) -> bool:
        n = row[7]
        c = lot.shared(tokens, 1)
        if c is None:
            return False
        small, large = np.minimum(n, lot.sizes), np.maximum(n, lot.sizes)
        need = np.maximum(1, -(-3 * (n + lot.sizes) // 7) - (3 * large + 3) // 4 + 1)
        found = (c >= need) & (4 * small >= 3 * large)
        if row[4] in lot.place:
            found[lot.place[row[4]]] = False
        lot.met |= found
        return bool(found.any())

    def close() -> None:
        nonlocal lot
        if not members:
            return
        lot = lot or Lot(members)
        visiting = {row[4] for row, tokens in waiting if call(row, tokens)}
        for row, met in zip(rows, lot.met):
            if met or row[4] in visiting:
                out.append([*row[:8], True, row[4] in visiting])

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))], names=names)
        out.clear()
        return made

    for batch in batches:
        lists = batch.column("tokens")
        values, bounds = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
            if row[:3] != here:
                close()
                here, rows, members, lot, waiting = row[:3], [], [], None, []
            tokens = values[bounds[k] : bounds[k + 1]]
            if row[8]:
                rows.append(row)
                members.append((row[4], row[6], row[7], tokens))
                if row[9]:
                    waiting.append((row, tokens))
                continue
            if lot is None and members:
                lot = Lot(members)
            if lot is not None and call(row, tokens):
                out.append([*row[:8], False, True])
        if len(out) > 20_000:
            yield flush()
    close()
    yield flush()


def _visit(batches: Iterator[pa.RecordBatch], each: bool) -> Iterator[pa.RecordBatch]:
    """Opens lots with the whole sets of their members: rows of one unit with their texts, hosts first.

    Gives FOUND: pairs of classes that connect all that the links connect, and for each class
    the documents it links to here; with ``each`` all links (LINKS) instead.
    """
    out: tuple[list, list, list] = ([], [], [])
    here, members, lot, waiting, seen = None, [], None, [], set()

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.binary(), pa.int64()))], names=[x.split()[0] for x in (LINKS if each else FOUND).split(", ")])
        for x in out:
            x.clear()
        return made

    def put(a: bytes, b: bytes | None, n: int | None) -> None:
        out[0].append(a)
        out[1].append(b)
        out[2].append(n)

    def call(name: bytes, docs: int, tokens: np.ndarray) -> None:
        shared = lot.shared(tokens, -(-3 * len(tokens) // 4))  # a link needs three quarters of the set
        if shared is None:
            return
        found, member = np.flatnonzero(7 * shared >= 3 * (len(tokens) + lot.sizes)), lot.place.get(name)
        found = found[found != member] if member is not None else found
        if not len(found):
            return
        if each:
            for k, n in zip(found.tolist(), shared[found].tolist()):
                if member is None or name < lot.prints[k]:
                    put(min(name, lot.prints[k]), max(name, lot.prints[k]), n)
            return
        put(name, None, int(lot.docs[found].sum()))
        if member is None:  # a member of this lot makes the same visit itself
            lot.links[found] += docs
        for k in lot.join(found, member):
            put(name, lot.prints[k], None)

    def close() -> None:
        nonlocal lot
        if members and lot is None:
            lot = Lot(members)
        for x in waiting:
            call(*x)
        if lot is not None and not each:
            for k in np.flatnonzero(lot.links).tolist():
                put(lot.prints[k], None, int(lot.links[k]))

    for batch in batches:
        columns = list(zip(*(batch.column(c).to_pylist() for c in (*UNIT, "print", "docs", "host", "visit"))))
        for first, tokens_, bounds in shingle_sets(batch.column("text")):
            for k, (*unit, name, docs, host, visit) in enumerate(columns[first : first + len(bounds) - 1]):
                if unit != here:
                    close()
                    here, members, lot, waiting, seen = unit, [], None, [], set()
                tokens = tokens_[bounds[k] : bounds[k + 1]]
                if name in seen or print_of(tokens) != name:  # another row, or another text, of the same doc_id
                    continue
                seen.add(name)
                if host:
                    members.append((name, docs, len(tokens), tokens))
                    if visit:
                        waiting.append((name, docs, tokens))
                    continue
                if lot is None:
                    if not members:
                        continue
                    lot = Lot(members)
                call(name, docs, tokens)
            if len(out[0]) > 50_000:
                yield flush()
    close()
    yield flush()


def _open(slim: DataFrame, touched: DataFrame, hosts: DataFrame, visits: DataFrame, each: bool = False) -> DataFrame:
    """What ``_visit`` finds when the lots of ``hosts`` are opened for ``visits``."""
    parts = visits.groupBy(F.col("home").alias("_home"), F.col("lot").alias("_lot")).agg(F.ceil(F.count(F.lit(1)) / VISITORS).alias("_parts"))
    here = (F.col("home") == F.col("_home")) & (F.col("lot") == F.col("_lot"))
    name = (*UNIT, *CLASS)
    asking = visits.join(parts, here).withColumn("part", F.pmod(F.xxhash64("owner", F.lit(1)), "_parts").cast("int")).select(*name, F.lit(False).alias("host"), F.lit(True).alias("visit"))
    placed = hosts.join(parts, here).withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("_parts") - 1).cast("int")))).select(*name, F.lit(True).alias("host"), F.lit(False).alias("visit"))
    asked = placed.unionByName(asking).groupBy(*name).agg(F.max("host").alias("host"), F.max("visit").alias("visit"))
    known = touched.select(F.col("owner").alias("_owner"), F.col("print").alias("_print"), "tokens")
    in_units = lambda df: df.repartition(*UNIT).sortWithinPartitions(*UNIT, F.col("host").desc())
    near = in_units(asked.join(known, (F.col("owner") == F.col("_owner")) & (F.col("print") == F.col("_print"))).drop("_owner", "_print"))
    asked = stored(near.mapInArrow(_narrow, ASKED), "ngram-asked")

    ids = stored(asked.filter(F.col("rep").isNotNull()).select(F.col("rep").alias("_wanted")).distinct(), "ngram-wanted")
    n = ids.count()
    kept = _admitted(slim, "doc_id", key_filter(ids, "_wanted")) if n <= FILTER_BITS // 4 else slim
    moved = asked.join(kept.withColumnRenamed("doc_id", "_id"), F.col("rep") == F.col("_id")).select(*UNIT, "print", "docs", "host", "visit", "text")
    nameless = asked.filter(F.col("rep").isNull())
    if nameless.limit(1).count():
        unnamed = slim.filter(F.col("doc_id").isNull()).select("text", _fingerprint()("text").alias("_print"))
        moved = moved.unionByName(nameless.join(unnamed, F.col("print") == F.col("_print")).select(*UNIT, "print", "docs", "host", "visit", "text"))
    found = in_units(moved).mapInArrow(lambda batches: _visit(batches, each), LINKS if each else FOUND)
    return stored(found, "ngram-found")


def _fingerprint():
    """The fingerprint of a text's set, null for none, as a function on columns."""

    @F.pandas_udf("binary")
    def fingerprint(texts: pd.Series) -> pd.Series:
        found = shingle_sets(pa.Array.from_pandas(texts, type=pa.string()))
        return pd.Series([print_of(t[a:b]) for _, t, bounds in found for a, b in zip(bounds[:-1], bounds[1:])], dtype=object)

    return fingerprint


def _classes(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The survey, and the classes of equal sets (print, rep, docs, n); rep is the least doc_id, null if none has one."""
    survey = stored(slim.mapInArrow(_survey, "doc_id long, n long, print binary, token long, summary boolean"), "ngram-survey")
    with_set = survey.filter("not summary").filter(F.col("print").isNotNull())
    return survey, stored(with_set.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("docs"), F.first("n").alias("n")), "ngram-classes")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def ngram_links(docs: DataFrame) -> DataFrame:
    """Every link, between classes of equal sets: class_a, class_b, doc_a, doc_b, docs_a, docs_b, n_a, n_b, n_common.

    Sets and links are those of ``ngram_components``. doc_ is the least doc_id of a class, docs_
    its number of rows, n_ its set's size; a row of two classes stands for docs_a * docs_b
    links. A class of several rows has a row with itself, for the links among them.
    Classes are named by their set's fingerprint, as in ``ngram_classes``.
    """
    slim = _slim(docs)
    survey, classes = _classes(slim)
    found = _open(slim, *_visits(slim, survey, classes), each=True)
    equal = classes.filter("docs > 1").select(F.col("print").alias("print_a"), F.col("print").alias("print_b"), F.col("n").alias("n_common"))
    of = lambda x: classes.select(F.col("print").alias(f"print_{x}"), F.col("rep").alias(f"doc_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("docs", "n")))
    sized = found.unionByName(equal).join(of("a"), "print_a").join(of("b"), "print_b")
    return sized.select(
        F.lower(F.hex("print_a")).alias("class_a"), F.lower(F.hex("print_b")).alias("class_b"), "doc_a", "doc_b", "docs_a", "docs_b", "n_a", "n_b", "n_common"
    )


def ngram_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class) of every row with a set: which documents a class of ``ngram_links`` holds."""
    survey = _slim(docs).mapInArrow(_survey, "doc_id long, n long, print binary, token long, summary boolean")
    return survey.filter("not summary").filter(F.col("print").isNotNull()).select("doc_id", F.lower(F.hex("print")).alias("class"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.filter(F.col("b").isNotNull()).select("a", "b")


def _connect(slim: DataFrame, touched: DataFrame, hosts: DataFrame, visits: DataFrame) -> DataFrame:
    """Components (node, component) of classes, without visits between what is already connected.

    First every lot is opened for its own members; then for one member of each component that
    has other visits to make; then for the rest whose component still differs.
    """
    visits = stored(visits, "ngram-all-visits")
    pairs = _pairs(_open(slim, touched, hosts, visits.filter("own")))
    reached, left = connected_components(pairs), visits.filter("not own")

    def apart(left: DataFrame) -> DataFrame:
        """Visits to lots that are not of the visitor's component alone."""
        label = reached.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        named = lambda df: df.join(label, F.col("print") == F.col("_node"), "left").withColumn("_at", F.coalesce("_component", "print")).drop("_node", "_component")
        whole = named(hosts).groupBy(F.col("home").alias("_home"), F.col("lot").alias("_lot")).agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
        asked = named(left).join(whole, (F.col("home") == F.col("_home")) & (F.col("lot") == F.col("_lot")))
        return stored(asked.filter((F.col("_from") != F.col("_at")) | (F.col("_to") != F.col("_at"))).select(*left.columns, "_at"), "ngram-left")

    left = apart(left)
    if left.limit(1).count():
        turn = Window.partitionBy("home", "lot", "_at").orderBy("print")
        ranked = stored(left.withColumn("_turn", F.row_number().over(turn)), "ngram-left")
        pairs = stored(pairs.unionByName(_pairs(_open(slim, touched, hosts, ranked.filter("_turn = 1").select(*visits.columns)))), "ngram-pairs")
        reached = connected_components(pairs)
        left = apart(ranked.filter("_turn > 1").select(*visits.columns))
        if left.limit(1).count():
            reached = connected_components(pairs.unionByName(_pairs(_open(slim, touched, hosts, left.select(*visits.columns)))))
    return reached


def _placed(survey: DataFrame, classes: DataFrame, reached: DataFrame, links: DataFrame | None) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, print, component, n_links (if ``links`` are given)."""
    nodes = classes.join(reached.withColumnRenamed("node", "_node"), F.col("print") == F.col("_node"), "left").select("print", "rep", "docs", F.coalesce("component", "print").alias("component"))
    least = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    nodes = nodes.join(least, "component")
    if links is not None:
        counted = links.filter(F.col("links").isNotNull()).groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("_links"))
        nodes = nodes.join(counted, F.col("print") == F.col("_a"), "left").withColumn("n_links", F.col("docs") - 1 + F.coalesce("_links", F.lit(0)))
    made = [F.col("component_id"), F.col("component"), *([F.col("n_links")] if links is not None else [])]
    rows = survey.filter("not summary")
    held = rows.filter(F.col("print").isNotNull()).join(nodes.select(F.col("print").alias("_print"), *made), F.col("print") == F.col("_print")).drop("_print")
    bare = rows.filter(F.col("print").isNull()).withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("binary"), **({"n_links": F.lit(0).cast("long")} if links is not None else {})})
    return held.unionByName(bare).drop("token", "summary").withColumnRenamed("n", "n_shingles")


def ngram_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row.

    A document's set holds its distinct 5-word shingles over A-Z-lowered words (of fewer
    words, the whole sequence); two rows link at Jaccard similarity 3/4 or more. component_id
    is the least doc_id that links reach (null if they reach rows without doc_id only), n_links
    the number of other rows that a row links to. Null and blank texts have no set and link
    with nothing. Rows are documents of their own, also those with equal or null doc_id. Texts
    of any length are read whole, piece by piece; an empty table gives no rows. Other columns
    are not read.
    """
    slim = _slim(docs)
    survey, classes = _classes(slim)
    found = _open(slim, *_visits(slim, survey, classes))
    return _placed(survey, classes, connected_components(_pairs(found)), found).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of linked rows: that with the least doc_id (null last), of several the first by text.

    Rows without a set (null or blank text) are components of their own and stay. Rows with
    equal doc_id are told apart by their texts; rows alike in both are one.
    """
    slim = _slim(docs)
    with small_batches(docs.sparkSession):
        survey, classes = _classes(slim)
        placed = _placed(survey, classes, _connect(slim, *_visits(slim, survey, classes)), None)
        linked = placed.filter(F.col("print").isNotNull())
        first = stored(
            linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "print")).alias("k")).select(F.col("k.doc_id").alias("_doc"), F.col("k.print").alias("_print")),
            "ngram-kept",
        )
    if not survey.filter("not summary").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter((F.col("k") > 1) | F.col("doc_id").isNull()).limit(1).count():
        bare = placed.filter(F.col("print").isNull()).select(F.col("doc_id").alias("_doc"))
        return docs.join(first.select("_doc").unionByName(bare), F.col("doc_id") == F.col("_doc"), "left_semi")

    named = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), "text", _fingerprint()("text").alias("_own"))
    chosen = named.join(first, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_print")))
    once = chosen.groupBy("_id", "_own").agg(F.min_by("_row", "text").alias("_row"))
    return once.select("_row.*").unionByName(named.filter(F.col("_own").isNull()).select("_row.*"))
