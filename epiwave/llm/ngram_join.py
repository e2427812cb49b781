"""Exact Jaccard join of documents on word n-grams, by vertical partitioning.

All n-grams have one global order, that of their hashes, and it is cut into fragments. A document is one segment in each.
Pairs of documents get partial overlaps, counted for each fragment on its own and summed per pair.

Which pairs are counted: sets of the wanted similarity differ in few n-grams, so when the order is cut into more fragments
than that, some of their segments are equal. Sets that merely share a passage hardly ever have an equal segment, however
many there are. First every set meets one leader it shares most segments with; pairs that then are in one component need
no count of their own.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiwave.llm.common import arrow_rows, dropped, memory_returned, stored
from epiwave.llm.components import components

SLOTS = 512
#: Words of texts that are handled at once.
GROUP_WORDS = 250_000
#: Words whose hashes a worker keeps; beyond it the store starts anew.
KEPT_WORDS = 250_000
#: Remaining pairs of a set, on average, beyond which one partner of each set is counted first, to thin the others.
DENSE = 64
#: Parts that the signatures are met in, one after the other, so that the disk holds the shuffle of one at a time.
ROUNDS = 4
SKETCH = [f"s{k}" for k in range(SLOTS // 64)]


@dataclass(frozen=True)
class JaccardJoin:
    """words: of an n-gram. percent: least 100 * intersection / union of a link. fragments: that overlaps are counted in."""

    words: int = 5
    percent: int = 80
    fragments: int = 4


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, with A-Z lower-cased."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """word -> place of its hash, filled as words come."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return k


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_sets(texts: list[str | None], n: int, known: WordHashes) -> Iterator[np.ndarray]:
    """The distinct n-grams of each text as sorted 64-bit hashes.

    A text with fewer words is one n-gram, one without words has none.
    """
    at = 0
    while at < len(texts):
        flat: list[bytes] = []
        ends = [0]
        while at < len(texts) and len(flat) < GROUP_WORDS:
            flat += words_of(texts[at])
            ends.append(len(flat))
            at += 1
        if len(known) > KEPT_WORDS:
            known.clear()
            known.hashes = []
        place = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        h = np.array(known.hashes, np.uint64)[place] if len(flat) else np.zeros(0, np.uint64)
        size = max(0, len(flat) - n + 1)
        keys = np.zeros(size, np.uint64)
        for k in range(n):
            keys = mixed(keys + h[k : k + size])
        for a, b in zip(ends, ends[1:], strict=False):
            if b - a >= n:
                yield np.unique(keys[a : b - n + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for x in h[a:b]:
                    whole = mixed(whole + x)
                yield whole
            else:
                yield np.zeros(0, np.uint64)


@lru_cache(maxsize=256)
def band_ends(percent: int, size: int) -> list[int]:
    """The largest size of each band, up to the band of ``size``.

    What is as large as the largest of a band times 100 / percent ends the next one, so sets that link lie in one band or in
    neighbouring ones.
    """
    ends = [1]
    while ends[-1] < size:
        ends.append(max(ends[-1] + 1, ends[-1] * 100 // percent))
    return ends


@lru_cache(maxsize=4096)
def fragments_of(band: int, percent: int, size: int) -> tuple[int, int]:
    """How many fragments a band's sets are compared in, and how many of a set's may be empty.

    Of two linked sets the smaller has at most ``end`` n-grams, so at most end * (100 - percent) / percent lie in one of
    them alone. With more fragments than that by 1 + spare, at least 1 + spare are equal, so one that isn't empty is,
    unless both sets have more than ``spare`` empty ones.
    """
    ends = band_ends(percent, size)
    apart, least = ends[band] * (100 - percent) // percent, ends[band - 1] + 1 if band else 1
    spare = 0
    for _ in range(3):
        count = apart + 1 + spare
        empty = count * math.exp(-least / count) if count > 1 else 0.0
        spare = math.ceil(empty + 3 * math.sqrt(empty)) if empty > 0.01 else 0
    return apart + 1 + spare, spare


def signatures(keys: np.ndarray, percent: int) -> np.ndarray:
    """One hash for each fragment of a set, in the fragments of its band and of the band of smaller sets.

    Empty fragments are named only where a set has more of them than its band spares.
    """
    top = 1 << len(keys).bit_length()
    own = bisect_left(band_ends(percent, top), len(keys))
    out = []
    values = mixed(keys ^ np.uint64(0x9E3779B97F4A7C15))
    for band in (own, own - 1) if own else (own,):
        count, spare = fragments_of(band, percent, top)
        place = (keys >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        sums = np.add.reduceat(values, starts)
        at = place[starts]
        if count - len(starts) > spare:
            none = np.setdiff1d(np.arange(count, dtype=np.uint64), at)
            at, sums = np.append(at, none), np.append(sums, np.zeros(len(none), np.uint64))
        out.append(mixed(sums + mixed(at + (np.uint64(band) << np.uint64(40)))))
    return np.concatenate(out)


def described(docs: DataFrame, how: JaccardJoin) -> DataFrame:
    """doc, n (set size), digest of the set, signatures of its fragments, parities.

    ``wide`` has the parities of n-grams per slot for at least two slots per n-gram, s0, s1, ... the same folded to
    ``SLOTS`` slots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            n, digest, signed, parity, wide = [], [], [], [], []
            for keys in gram_sets(batch.column(1).to_pylist(), how.words, known):
                n.append(len(keys))
                digest.append(xxhash.xxh3_128_digest(keys.tobytes()))
                signed.append(signatures(keys, how.percent).view(np.int64) if len(keys) else np.zeros(0, np.int64))
                slots = max(SLOTS, 1 << (2 * len(keys)).bit_length())
                odd = np.bincount((keys & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
                bits = np.packbits(odd.astype(np.uint8))
                wide.append(bits.tobytes())
                parity.append(np.bitwise_xor.reduce(bits.reshape(-1, SLOTS // 8), axis=0).view(np.int64))
            narrow = np.array(parity, np.int64).reshape(-1, len(SKETCH))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(signed, pa.list_(pa.int64())),
                 pa.array(wide, pa.binary()), *(pa.array(narrow[:, k]) for k in range(len(SKETCH)))],
                names=["doc", "n", "digest", "signatures", "wide", *SKETCH],
            )
        del known
        memory_returned()

    schema = "doc long, n int, digest binary, signatures array<long>, wide binary, " + ", ".join(f"{s} long" for s in SKETCH)
    return docs.select("doc", "text").mapInArrow(run, schema)


def segments(docs: DataFrame, pairs: DataFrame, reps: DataFrame, how: JaccardJoin) -> DataFrame:
    """set, frag, grams (sorted hashes as bytes) of the sets in ``pairs`` (a, b), each read from one of its documents.

    Spark sends the wanted ids to the texts while they are few, and else joins both by id.
    """
    bounds = np.array([(k << 64) // how.fragments for k in range(1, how.fragments)], np.uint64)
    sets = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    wanted = stored(sets.join(reps.select("set", "doc"), "set").groupBy("doc").agg(F.collect_set("set").alias("sets")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows = []
            for keys in gram_sets(batch.column(0).to_pylist(), how.words, known):
                digest = xxhash.xxh3_128_digest(keys.tobytes())
                rows += [(digest, f, part.tobytes()) for f, part in enumerate(np.split(keys, np.searchsorted(keys, bounds))) if len(part)]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            types = [pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["digest", "frag", "grams"])
        del known
        memory_returned()

    found = docs.join(wanted, "doc").select("text").mapInArrow(run, "digest binary, frag int, grams binary")
    with arrow_rows(docs.sparkSession, 2000):
        return stored(found.select(F.xxhash64("digest").alias("set"), "frag", "grams"))


def common(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many keys two sorted segments share."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        at = np.searchsorted(y, x)
        out.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()))
    return pa.array(out, pa.int64())


def similar_size(a: Column, b: Column, percent: int) -> Column:
    return (a.cast("long") * 100 >= b.cast("long") * percent) & (b.cast("long") * 100 >= a.cast("long") * percent)


def few_parities(x: str, y: str, percent: int) -> Column:
    """Whether the parities leave room for a link: each one that differs is an n-gram in one set alone."""
    differ = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in SKETCH), F.lit(0))
    return differ.cast("long") * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")).cast("long") * (100 - percent)


def room_left(percent: int):
    """Whether the wide parities of two sets leave room for a link; the wider table is folded to the other's slots."""

    def run(wa: pa.Array, wb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        out = []
        for x, y, n in zip(wa, wb, (na.to_numpy().astype(np.int64) + nb.to_numpy()).tolist(), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            size = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(t.reshape(-1, size), axis=0) for t in (x, y))
            out.append(int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= n * (100 - percent))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")


def promising(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose wide parities leave room for a link."""
    x, y = (reps.select(F.col("set").alias(k), F.col("wide").alias(f"w{k}")) for k in ("a", "b"))
    close = pairs.join(x, "a").join(y, "b").filter(room_left(percent)("wa", "wb", "na", "nb"))
    with arrow_rows(pairs.sparkSession, 2000):
        return stored(close.select("a", "b", "na", "nb"))


def links_of(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that are similar enough: partial overlaps of the fragments, summed per pair.

    ``parts`` has the segments of their sets. Rows of documents with the same id and text give the same segments twice,
    hence the largest of equal counts.
    """
    left, right = (parts.select(F.col("set").alias(k), "frag", F.col("grams").alias(f"g{k}")) for k in ("a", "b"))
    partial = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "b", "na", "nb", "frag", F.arrow_udf(common, "long")("ga", "gb").alias("shared"))
    overlap = partial.groupBy("a", "b", "na", "nb", "frag").agg(F.max("shared").alias("shared")).groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    enough = F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent
    with arrow_rows(pairs.sparkSession, 500):
        return stored(overlap.filter(enough).select("a", "b"))


def shared_signatures(named: DataFrame) -> DataFrame:
    """sig, set, lead: the signatures that several sets have, with the leader of these sets. Of equal sets one row speaks.

    A signature's leader is the set that shares its signatures with most others: the one in the middle of a group of near
    copies, which links to more of them than any other. Counts come with partial aggregation, so a signature of very
    many sets is no large group anywhere; the joins with them are ones that Spark splits where they are skewed.
    """
    copies = named.groupBy("set").agg(F.count("*").alias("m"), F.min("doc").alias("first")).filter("m > 1").select("set", "first")
    lone = named.select("set", "doc", "signatures").join(stored(copies), "set", "left").filter(F.col("doc") == F.coalesce("first", "doc"))
    found = []
    for part in range(ROUNDS):
        signed = lone.select("set", F.explode("signatures").alias("sig")).filter(F.pmod("sig", F.lit(ROUNDS)) == part)
        several = signed.groupBy("sig").agg(F.min("set").alias("a"), F.max("set").alias("z"), F.count("*").alias("m")).filter("a < z").select("sig", "m")
        found.append(stored(signed.join(several, "sig")))
    several = reduce(DataFrame.union, found)
    known = stored(several.groupBy("set").agg(F.sum("m").alias("known")))
    lead = several.join(known, "set").groupBy("sig").agg(F.max(F.struct("known", "set")).alias("l")).select("sig", F.col("l.set").alias("lead"))
    return stored(several.select("sig", "set").join(lead, "sig"))


def leader_pairs(shared: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb: each set with the leader of similar size it shares most signatures with."""
    met = shared.filter("set <> lead").groupBy("lead", "set").agg(F.count("*").alias("k"))
    sizes = reps.select("set", "n")
    sized = met.join(sizes, "set").join(sizes.select(F.col("set").alias("lead"), F.col("n").alias("lead_n")), "lead")
    best = sized.filter(similar_size(F.col("lead_n"), F.col("n"), percent)).groupBy("set").agg(F.max(F.struct("k", "lead", "lead_n", "n")).alias("m"))
    return best.select(F.col("m.lead").alias("a"), F.col("set").alias("b"), F.col("m.lead_n").alias("na"), F.col("m.n").alias("nb"))


def jaccard_components(docs: DataFrame, how: JaccardJoin = JaccardJoin(), id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links, itself included) for each row of ``docs``.

    Two documents link when 100 * intersection >= percent * union of their sets of word n-grams. Equal sets are one
    class, of which one document is compared. A text without words, empty or null, has an empty set and no links. Rows
    with the same id are one document with several sets, each of which links; a row without an id has no component.
    Columns other than id and text aren't read.
    """
    mine = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    with arrow_rows(docs.sparkSession, 2000):
        sets = stored(described(mine, how).withColumn("set", F.xxhash64("digest")))
    named = sets.filter("n > 0 AND doc IS NOT NULL")
    reps = stored(named.groupBy("set").agg(F.min(F.struct("doc", "n", *SKETCH, "wide")).alias("r")).select("set", "r.*"))
    shared = shared_signatures(named)
    tested = promising(leader_pairs(shared, reps, how.percent), reps, how.percent)
    parts = segments(mine, tested, reps, how)
    links = links_of(tested, parts, how.percent)
    dropped(parts)

    # All other pairs that share a segment, but for those that a component holds already.
    joined = components(links).select(F.col("node").alias("set"), "component")
    member = stored(shared.select("sig", "set").join(joined, "set", "left").withColumn("component", F.coalesce("component", "set")))
    several = member.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("sig")
    several = stored(member.join(several, "sig", "left_semi").join(reps.select("set", "n", *SKETCH), "set"))
    near = (
        (F.col("x.sig") == F.col("y.sig")) & (F.col("x.set") < F.col("y.set")) & (F.col("x.component") != F.col("y.component"))
        & similar_size(F.col("x.n"), F.col("y.n"), how.percent) & few_parities("x", "y", how.percent)
    )
    rest = several.alias("x").join(several.alias("y"), near)
    rest = rest.select(F.col("x.set").alias("a"), F.col("y.set").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = promising(rest.join(done, ["a", "b"], "left_anti"), reps, how.percent)
    if not rest.isEmpty():
        parts = segments(mine, rest, reps, how)
        while True:
            pairs, ends = rest.agg(F.count("*"), F.count_distinct("b")).first()
            if pairs <= DENSE * ends:
                break
            # One partner of each set; what its links put into one component needs no count of its own.
            first = rest.groupBy("b").agg(F.min(F.struct("a", "na", "nb")).alias("p"))
            picked = stored(first.select(F.col("p.a").alias("a"), "b", F.col("p.na").alias("na"), F.col("p.nb").alias("nb")))
            links = links.union(links_of(picked, parts, how.percent))
            joined = stored(components(links).select("node", "component"))
            x, y = (joined.select(F.col("node").alias(f"node_{k}"), F.col("component").alias(f"c{k}")) for k in ("a", "b"))
            placed = rest.join(x, F.col("a") == F.col("node_a"), "left").join(y, F.col("b") == F.col("node_b"), "left")
            apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
            rest = stored(placed.filter(apart).select("a", "b", "na", "nb").join(picked.select("a", "b"), ["a", "b"], "left_anti"))
        links = links.union(links_of(rest, parts, how.percent))

    # Sets of one id belong together, as do linked sets; the smallest id of a component is its name.
    own = named.groupBy("doc").agg(F.min("set").alias("a"), F.max("set").alias("z")).filter("a < z").select("doc", "a")
    own = named.select("doc", F.col("set").alias("b")).join(own, "doc").select("a", "b")
    found = components(links.union(own)).select(F.col("node").alias("set"), "component")
    of_set = stored(named.select("doc", "set").join(found, "set", "left").select("doc", "set", F.coalesce("component", "set").alias("component")))
    least = stored(of_set.groupBy("component").agg(F.min("doc").alias("component_id")))
    by_set = of_set.select("set", "component").distinct().join(least, "component").select("set", F.col("component_id").alias("least"))
    by_set = stored(by_set)
    none = F.col("n") == 0
    return sets.join(by_set, "set", "left").select(
        F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(none | F.col("doc").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id"),
    )


def keep_one(docs: DataFrame, how: JaccardJoin = JaccardJoin(), id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; rows without an id stay.

    Repeated rows of the document that stays all stay.
    """
    found = jaccard_components(docs, how, id_col, text_col)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
