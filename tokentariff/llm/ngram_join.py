"""N-gram Jaccard self-join: a size-aware join of heavy and light sets, and its components.

A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets are one node;
its id is a 64-bit mix of a 128-bit digest, and mixes are tried until all nodes differ.

Two sets of n and m shingles link at ``percent`` if they share at least ceil(percent * max(n, m)
/ 100), so in one order of all shingles their first n - ceil(percent * n / 100) + c ones share c.
*Light* sets, up to a boundary, list all subsets of c = 2 of that prefix, and two of them meet in
the bucket of a subset. *Heavy* sets, and light ones that may link with them by their size, are put
on the inverted lists of their prefix for c = 1. The boundary makes the estimated cost least:
a subset costs one row, a place on a list one row and the verification of the false candidates
that lists bring, by the share of repeated shingles found in the corpus. The order puts
shingles that blocks of the corpus hold repeatedly (at most ``hot_size`` of them, broadcast) last,
the most frequent at the end, and all others by hash; it decides speed, not results.

Pairs of buckets of up to ``LARGE`` sets are counted, and the places of the shingles they share bound
what they can share in all. Every set has a signature, the parity of its shingles in each of SIGNATURE
classes; where two signatures differ, one set has a shingle that the other lacks, which bounds what they
share once more. Pairs that may link are verified on whole sets, each set
with one partner first, and then only pairs that are not connected yet. Whole sets are made for the sets in such
pairs and in large buckets, from one document of each. Large buckets are never
expanded into all their pairs: in each of a few rounds one member leads, and those that aren't
connected with it and fit by size are compared with it; what remains unconnected in a bucket
after that is compared pair by pair. No link between different components is lost.

Null, empty and blank texts have empty sets and link with nothing; so do rows without a
doc_id. Repeated rows and rows that share a doc_id are treated row by row; they are linked if
their texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentariff.llm.components import components
from tokentariff.llm.shingles import WordHashes, mixed, shingle_set, words_of
from tokentariff.llm.text import bucketed, prepare_workers, work_folder, written

SHINGLE, PERCENT = 5, 75
HOT_SIZE = 131_072
BLOCK = 1 << 21
ROUNDS, LEADERS = 1, 4
CANDIDATE_COST = 20.0
BITMAP_BITS = 1 << 27
GIVEN = 200_000
LARGE = 64
STAR = 512
SIGNATURE = 1_024


def least_shared(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int, shared: int) -> int:
    return min(n, n - least_shared(n, percent) + shared)


def _sets(texts, size: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingle_set(hashes.of(words_of(text)), size)


def survey(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, hi, lo, signature) of every document, and (shingle, n) of those repeated in a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        held: list[np.ndarray] = []
        seen: set[bytes] = set()

        def repeated():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            held.clear()
            seen.clear()
            return pd.DataFrame({"shingle": values[often].view(np.int64),
                                 "n": counts[often].astype(np.int64)})

        count = 0
        for batch in batches:
            rows = []
            for doc_id, values in zip(batch["doc_id"], _sets(batch["text"], size, hashes)):
                digest = xxhash.xxh3_128_digest(values.tobytes())
                rows.append((doc_id, len(values), int.from_bytes(digest[:8], "big", signed=True),
                             int.from_bytes(digest[8:], "big", signed=True), signature(values)))
                if len(values) and digest not in seen:
                    seen.add(digest)
                    held.append(values)
                    count += len(values)
                if count >= BLOCK:
                    yield repeated()
                    count = 0
            frame = pd.DataFrame(rows, columns=["doc_id", "n", "hi", "lo", "signature"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame
        if held:
            yield repeated()

    def padded(batches):
        numbers = ["doc_id", "n", "hi", "lo", "shingle"]
        for frame in run(batches):
            out = frame.reindex(columns=numbers).astype("Int64")
            out["signature"] = frame["signature"] if "signature" in frame else None
            yield out

    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        padded, "doc_id long, n long, hi long, lo long, shingle long, signature array<long>")


def signature(values: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each class, as packed longs."""
    odd = np.bincount((values & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def node_id(turn: int) -> Column:
    """64 bits of the digest: its low half xor its high half turned by ``turn`` places."""
    hi = F.col("hi")
    turned = F.shiftleft(hi, turn).bitwiseOR(F.shiftrightunsigned(hi, 64 - turn)) if turn else hi
    return F.col("lo").bitwiseXOR(turned)


def distinct_turn(nodes: DataFrame) -> int:
    """The first turn for which different digests have different ids."""
    digests = nodes.select("hi", "lo").distinct()
    for turn in range(64):
        n, ids = digests.agg(F.count("*"), F.count_distinct(node_id(turn))).first()
        if n == ids:
            return turn
    raise ValueError("no mix of the digests tells all sets apart")


def _turned(digest: bytes, turn: int) -> int:
    hi, lo = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big")
    return lo ^ ((hi << turn | hi >> (64 - turn)) & (2**64 - 1) if turn else hi)


def boundary(histogram: list[tuple[int, int]], repeated_share: float, percent: int) -> int:
    """Largest size of a light set, at the least estimated cost."""
    per_list_row = 1 + CANDIDATE_COST * repeated_share
    sizes = sorted((n, count) for n, count in histogram if n > 2)
    one = {n: prefix_length(n, percent, 1) for n, _ in sizes}
    two = {n: prefix_length(n, percent, 2) for n, _ in sizes}
    best, best_cost = 2, sum(count * one[n] * per_list_row for n, count in sizes)
    for limit, _ in sizes:
        if two[limit] > 64:
            break
        low = least_shared(limit + 1, percent)
        cost = sum(count * ((two[n] * (two[n] - 1) // 2 + (one[n] if n >= low else 0))
                            if n <= limit else one[n] * per_list_row) for n, count in sizes)
        if cost < best_cost:
            best, best_cost = limit, cost
    return best


def size_histogram(nodes: DataFrame) -> list[tuple[int, int]]:
    """Sets by size; sizes over 256 by their leading eight bits, so that there are few rows."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest("n", F.lit(1)))) - 8, F.lit(0)))
    size = (F.floor(F.col("n") / step) * step).cast("long")
    return [(r.size, r.sets) for r in
            nodes.groupBy(size.alias("size")).agg(F.count("*").alias("sets")).collect()]


def bucket_rows(documents: DataFrame, size: int, percent: int, limit: int, turn: int,
                hot) -> DataFrame:
    """(key, id, n, place, hot): every set in its buckets, of single shingles or of subsets.

    ``place`` counts a shingle's place in the order of its set from 1; it is 0 for a subset. A task gives
    the rows of equal sets once.
    """
    low = least_shared(limit + 1, percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, ranked, given = WordHashes(), hot.value, set()
        names, ranks = ranked["shingle"], ranked["rank"]
        for batch in batches:
            keys, ids, ns, hots, places = [], [], [], [], []
            for values in _sets(batch["text"], size, hashes):
                n = len(values)
                node = _turned(xxhash.xxh3_128_digest(values.tobytes()), turn)
                if n < 3 or node in given:
                    continue
                if len(given) < GIVEN:
                    given.add(node)
                last = np.zeros(n, dtype=np.int64)
                if len(names):
                    at = np.searchsorted(names, values)
                    at[at == len(names)] = 0
                    found = names[at] == values
                    last[found] = ranks[at[found]]
                # Sorted by hash already: a stable sort by rank leaves the rest in that order.
                longest = prefix_length(n, percent, 2)
                order = np.argsort(last, kind="stable")[:longest]
                prefix, is_hot = values[order], last[order] > 0
                out, flags = [], []
                if n <= limit:
                    i, j = np.triu_indices(len(prefix), 1)
                    out.append(mixed(prefix[i] * np.uint64(3) + mixed(prefix[j])))
                    flags.append(is_hot[i] & is_hot[j])
                    places.append(np.zeros(len(i), dtype=np.int32))
                if n > limit or n >= low:
                    one = prefix_length(n, percent, 1)
                    out.append(prefix[:one])
                    flags.append(is_hot[:one])
                    places.append(np.arange(1, one + 1, dtype=np.int32))
                count = sum(map(len, out))
                keys += out
                hots += flags
                ids.append(np.full(count, node, dtype=np.uint64))
                ns.append(np.full(count, n, dtype=np.int32))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64),
                                    "id": np.concatenate(ids).view(np.int64),
                                    "n": np.concatenate(ns), "place": np.concatenate(places),
                                    "hot": np.concatenate(hots)})

    return documents.select("text").mapInPandas(
        run, "key long, id long, n int, place int, hot boolean")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(key, id, n, place, large) of buckets with two sets or more.

    Buckets of hot shingles, or of over ``LARGE`` rows, are large. Rows of a hot shingle are dealt
    out by id as well, so no task gets a hot bucket whole.
    """
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(1024))).otherwise(0)
    bucket = Window.partitionBy("key", "part")
    several = F.min("id").over(bucket) != F.max("id").over(bucket)
    return (rows.withColumn("part", part).withColumn("several", several)
            .withColumn("large", F.col("hot") | (F.count("*").over(bucket) > LARGE))
            .where(F.col("hot") | F.col("several"))
            .select("key", "id", "n", "place", "large").distinct())


def shared_least(n: Column, m: Column, percent: int) -> Column:
    """What two sets of these sizes share at least if they link."""
    return F.ceil((n + m).cast("long") * percent / F.lit(float(100 + percent)) - 1e-9)


def small_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of buckets that aren't large, by size and by the places they share.

    All shingles up to the last one that a pair shares in such buckets lie in both prefixes. So they
    share no more than those counted, those of large buckets, and what follows in the shorter rest.
    """
    small = buckets.where(~F.col("large"))
    one = small.select("key", F.col("id").alias("a"), F.col("n").alias("n_a"),
                       F.col("place").alias("p_a"))
    other = small.select("key", F.col("id").alias("b"), F.col("n").alias("n_b"),
                         F.col("place").alias("p_b"))
    # A light set on lists has the subsets as well, where places are 0.
    met = one.join(other, "key").where((F.col("a") < F.col("b"))
                                       & ((F.col("p_a") > 0) == (F.col("p_b") > 0))
                                       & fits(F.col("n_a"), F.col("n_b"), percent))
    pairs = met.groupBy("a", "b").agg(
        F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"),
        F.max(F.col("p_a") == 0).alias("by_subset"), F.count_if(F.col("p_a") > 0).alias("shared"),
        F.max("p_a").alias("p_a"), F.max("p_b").alias("p_b"))
    hidden = buckets.where(F.col("large")).groupBy("id").agg(F.count("*").alias("hidden"))
    rest = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    unseen = F.least(F.coalesce("h_a", F.lit(0)), F.coalesce("h_b", F.lit(0)))
    return (pairs.join(hidden.select(F.col("id").alias("a"), F.col("hidden").alias("h_a")),
                       "a", "left")
            .join(hidden.select(F.col("id").alias("b"), F.col("hidden").alias("h_b")), "b", "left")
            .where(F.col("by_subset") | (F.col("shared") + unseen + rest >= shared_least(
                F.col("n_a"), F.col("n_b"), percent)))
            .select("a", "b"))


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by their signatures. ``sets`` are (id, n, signature) by id."""
    def side(name):
        return sets.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"),
                           F.col("signature").alias(f"s_{name}"))

    differ = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                         F.lit(0), lambda total, bits: total + bits)
    n, m = F.col("n_a"), F.col("n_b")
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(differ <= n + m - 2 * shared_least(n, m, percent)).select("a", "b"))


def needed_sets(documents: DataFrame, size: int, turn: int, ids: DataFrame,
                nodes: DataFrame) -> DataFrame:
    """(id, shingles) for the ids in need, from one document of each; shingles as packed longs."""
    wanted = ids.count()
    chosen = nodes.select(node_id(turn).alias("id"), "doc_id").join(ids, "id").groupBy("id").agg(
        F.min("doc_id").alias("doc_id")).select(F.col("doc_id").alias("id"))
    bits = 1 << 15
    while bits < 16 * wanted and bits < BITMAP_BITS:
        bits *= 2
    marks = documents.sparkSession.sparkContext.broadcast(_bitmap_of(chosen, bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, bitmap, given = WordHashes(), marks.value, set()
        for batch in batches:
            found = []
            places = batch["doc_id"].to_numpy(np.int64) & np.int64(bits - 1)
            wanted = bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1
            for values in _sets(batch["text"][wanted > 0], size, hashes):
                node = _turned(xxhash.xxh3_128_digest(values.tobytes()), turn)
                if len(values) > 2 and node not in given:
                    if len(given) < GIVEN:
                        given.add(node)  # copies in one task are given out once
                    found.append((node - 2**64 if node >= 2**63 else node, values.tobytes()))
            yield pd.DataFrame(found, columns=["id", "shingles"])

    sets = documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        run, "id long, shingles binary")
    return sets.join(ids, "id", "left_semi").groupBy("id").agg(
        F.any_value("shingles").alias("shingles"))


def _bitmap_of(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for every id, at its low bits. Tasks build blocks of 4 KB; ``bits`` bounds the whole."""
    place = F.col("id").bitwiseAND(F.lit(bits - 1))
    number = F.shiftright(place, 15)
    within = place.bitwiseAND(F.lit(32767)).cast("long")
    rows = (ids.select(number.alias("block"), within.alias("p")).groupBy("block")
            .agg(F.bitmap_construct_agg("p").alias("bits")).collect())
    whole = np.zeros(bits // 8, dtype=np.uint8)
    for row in rows:
        part = np.frombuffer(bytes(row.bits), dtype=np.uint8)
        whole[row.block * 4096:row.block * 4096 + len(part)] |= part
    return whole


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link.

    Pairs are stars of a centre ``a`` and its partners: the centre's set goes to its star once, or once for each
    STAR of them, and partners stream past it. ``sets`` are in buckets of their id, so finding
    the sets of pairs moves the pairs only.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(
        F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    partners = dealt.join(sets, F.col("b") == F.col("id")).select(
        "a", "part", F.lit(1).alias("kind"), "b", "shingles")
    centres = dealt.select("a", "part").distinct().join(sets, F.col("a") == F.col("id")).select(
        "a", "part", F.lit(0).alias("kind"), F.col("a").alias("b"), "shingles")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, held = None, None
        for batch in batches:
            found = []
            for a, kind, b, packed in zip(batch["a"], batch["kind"], batch["b"], batch["shingles"]):
                values = np.frombuffer(packed, np.uint64)
                if kind == 0:
                    centre, held = a, values
                elif a == centre:
                    at = np.searchsorted(held, values)
                    at[at == len(held)] = 0
                    both = int((held[at] == values).sum())
                    if 100 * both >= percent * (len(held) + len(values) - both):
                        found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"])

    return (centres.unionByName(partners).repartition("a", "part")
            .sortWithinPartitions("a", "part", "kind").mapInPandas(run, "a long, b long"))


def fits(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m).cast("long") * 100 >= F.greatest(n, m).cast("long") * percent


def _led(members: DataFrame, turn: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of every bucket's leader with members of other components, and what is left to do.

    ``members`` (key, id, n, component, central). The set that is in most large buckets leads, as
    the least changed of near copies is. It has met its whole bucket then and goes.
    """
    rank = F.struct((-F.col("central")).alias("order"), F.xxhash64("id", F.lit(turn)).alias("tie"),
                    "id", "n", "component")
    leaders = members.groupBy("key").agg(F.min(rank).alias("lead"))
    joined = members.join(leaders, "key").where(F.col("id") != F.col("lead.id"))
    pairs = joined.where((F.col("component") != F.col("lead.component"))
                         & fits(F.col("n"), F.col("lead.n"), percent)).select(
        F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()
    return pairs, joined.select("key", "id", "n", "central")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their component, of the buckets that still hold several components."""
    named = members.join(labels, "id", "left").select(
        "key", "id", "n", "central", F.coalesce("component", "id").alias("component"))
    several = named.groupBy("key").agg(F.min("component").alias("low"),
                                       F.max("component").alias("high"))
    return named.join(several.where(F.col("low") != F.col("high")).select("key"), "key")


def linked_sets(documents: DataFrame, size: int, percent: int, folder: str, turn: int,
                nodes: DataFrame, survey_rows: DataFrame, hot_size: int, rounds: int,
                leaders: int) -> DataFrame:
    """(id, component) of the sets that link with another."""
    spark = documents.sparkSession
    often = survey_rows.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(
        F.sum("n").alias("n"))
    totals = nodes.agg(F.sum("n")).first()[0] or 0
    repeated = often.agg(F.sum("n")).first()[0] or 0
    top = often.where(F.col("n") > 3).orderBy(F.desc("n"), "shingle").limit(hot_size).collect()
    names = np.array([r.shingle for r in top], dtype=np.int64).view(np.uint64)
    ranks = np.arange(len(top), 0, -1, dtype=np.int64)  # the most frequent has the last place
    order = np.argsort(names)
    hot = spark.sparkContext.broadcast({"shingle": names[order], "rank": ranks[order]})
    limit = boundary(size_histogram(nodes), repeated / max(totals, 1), percent)
    rows = bucket_rows(documents, size, percent, limit, turn, hot)
    buckets = written(shared_buckets(rows), f"{folder}/buckets")
    signatures = bucketed(nodes.select(node_id(turn).alias("id"), "n", "signature").groupBy("id").agg(
        F.first("n").alias("n"), F.first("signature").alias("signature")), f"{folder}/signatures", "id")
    pairs = written(likely(small_pairs(buckets, percent), signatures, percent), f"{folder}/pairs")
    members = buckets.where("large").select("key", "id", "n")
    members = members.join(members.groupBy("id").agg(F.count("*").alias("central")), "id")
    ids = pairs.select(F.col("a").alias("id")).unionByName(
        pairs.select(F.col("b").alias("id"))).unionByName(members.select("id")).distinct()
    sets = bucketed(needed_sets(documents, size, turn, written(ids, f"{folder}/ids"), nodes),
                    f"{folder}/sets", "id")
    links = Links(spark, sets, percent, folder)
    # Candidates of small buckets: every set with its smallest partner, then what stays apart.
    for turn in range(rounds + 1):
        if turn:
            pairs = links.apart(pairs)
            if pairs.isEmpty():
                break
        if turn < rounds:
            chosen = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
            links.add(chosen)
            pairs = pairs.join(chosen, ["a", "b"], "left_anti")
        else:
            links.add(pairs)
    # Large buckets: a few members lead, then what stays apart meets pair by pair.
    for turn in range(leaders + 1):
        still = written(_open(members, links.labels), f"{folder}/open-{turn}")
        if still.isEmpty():
            break
        if turn < leaders:
            led, members = _led(still, turn, percent)
            links.add(likely(led, signatures, percent))
        else:
            links.add(likely(_remaining(still, buckets, percent), signatures, percent))
    return links.labels


def _remaining(still: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in large buckets, each at the first list that both are on.

    Past the prefix that ends first, a pair shares no more than the longer of the two rests. So the
    lists that both are on, and places in small buckets, have to make up for the difference.
    """
    lists = buckets.groupBy("id").agg(
        F.collect_set(F.when(F.col("large") & (F.col("place") > 0), F.col("key"))).alias("lists"),
        F.count_if(~F.col("large") & (F.col("place") > 0)).alias("small"))
    rows = still.join(lists, "id")

    def side(name):
        return rows.select("key", F.col("id").alias(name), F.col("n").alias(f"n_{name}"),
                           F.col("component").alias(f"c_{name}"), F.col("lists").alias(f"l_{name}"),
                           F.col("small").alias(f"s_{name}"))

    def rest(n):
        return F.ceil(F.col(n) * percent / F.lit(100.0) - 1e-9) - 1

    both = F.array_intersect("l_a", "l_b")
    listed = F.array_contains("l_a", F.col("key")) & F.array_contains("l_b", F.col("key"))
    enough = (F.size(both) + F.least("s_a", "s_b") + F.greatest(rest("n_a"), rest("n_b"))
              >= shared_least(F.col("n_a"), F.col("n_b"), percent))
    return side("a").join(side("b"), "key").where(
        (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b"))
        & fits(F.col("n_a"), F.col("n_b"), percent)
        & (~listed | ((F.array_min(both) == F.col("key")) & enough))).select("a", "b").distinct()


class Links:
    """Verified links, as tables, and the components they make so far."""

    def __init__(self, spark, sets: DataFrame, percent: int, folder: str):
        self.sets, self.percent, self.folder = sets, percent, folder
        self.labels = spark.createDataFrame([], "id long, component long")
        self.tables: list[DataFrame] = []

    def add(self, pairs: DataFrame) -> None:
        n = len(self.tables)
        self.tables.append(written(verified(pairs, self.sets, self.percent),
                                   f"{self.folder}/links-{n}"))
        if not self.tables[-1].isEmpty():
            # Earlier links are stood for by the stars of their components.
            stars = self.labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
            self.labels = components(self.tables[-1].unionByName(stars),
                                     f"{self.folder}/components-{n}")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are not connected yet."""
        def named(side):
            return self.labels.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}"))
        return written(
            pairs.join(named("a"), "a", "left").join(named("b"), "b", "left").where(
                F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b"),
            f"{self.folder}/apart-{len(self.tables)}")


def ngram_components(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT,
                     hot_size: int = HOT_SIZE, rounds: int = ROUNDS,
                     leaders: int = LEADERS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = documents.sparkSession
    prepare_workers(spark)
    folder = work_folder(spark, "ngrams")
    rows = written(survey(documents, size), f"{folder}/survey")
    docs = rows.where(F.col("shingle").isNull())
    nodes = docs.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    turn = distinct_turn(nodes)
    labels = linked_sets(documents.where(F.col("doc_id").isNotNull()), size, percent, folder, turn,
                         nodes, rows, hot_size, rounds, leaders)
    placed = (docs.withColumn("id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(),
                                           node_id(turn)))
              .join(labels, "id", "left")
              .select("doc_id", "n", F.coalesce("component", "id").alias("component")))
    firsts = placed.where(F.col("component").isNotNull()).groupBy("component").agg(
        F.min("doc_id").alias("first"))
    return (placed.join(firsts, "component", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("first", "doc_id").alias("component_id")))
