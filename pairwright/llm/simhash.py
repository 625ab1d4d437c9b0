"""SimHash near-duplicate detection with pigeonhole blocks.

Two kinds of links. :func:`near_groups` links fingerprints of 64 bits that differ in a few bits; all of them, as
such a pair must agree in most of its blocks. :func:`similar_groups` links texts whose sets of shingles are alike, where
fingerprints differ in a seventh of their bits: there blocks of long fingerprints find most links, and the rarest shingles
of every text all that are left.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.components import connected_components, stars
from pairwright.llm.frames import row_key, sheltering, table
from pairwright.plans.storage import Scratch

SEED = 42
MAX_BITS = 3
WORDS = 3
#: Rows of a bucket that are compared in one unit of work; larger buckets are cut into pairs of chunks.
CHUNK = 1024


def simhash64(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text``; 0 where it has no word."""
    found = (text or b"").lower().split()  # bytes.lower() and .split() know ASCII only, as asked
    if not found:
        return 0
    grams = [b" ".join(x) for x in zip(*(found[i:] for i in range(words)))] if len(found) >= words else [b" ".join(found)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64, len(grams))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the memory that a very long text takes
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text, words: int = WORDS, seed: int = SEED):
    """Column of SimHash fingerprints (long) of a text column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash64(t, words, seed) for t in texts], dtype="int64")

    return of(text.cast("binary"))


def blocks_for(n: int, max_bits: int = MAX_BITS) -> int:
    """How many blocks to cut 64 bits into, so that the part of a fingerprint that a close pair
    must share has at least log2(n) bits: the candidates of random fingerprints then stay linear in n."""
    for blocks in range(max_bits + 1, max_bits + 6):
        if 64 * (blocks - max_bits) // blocks >= max(n, 2).bit_length():
            return blocks
    return max_bits + 5


def block_masks(blocks: int, max_bits: int = MAX_BITS) -> list[int]:
    """A mask for each choice of blocks: two values that differ in ``max_bits`` bits agree under one of them."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    part = [(1 << cut[i + 1]) - (1 << cut[i]) for i in range(blocks)]
    return [sum(x) for x in combinations(part, blocks - max_bits)]


def _pairs(fp: np.ndarray, starts: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs within the runs of ``fp`` that begin at ``starts``."""
    sizes = np.diff(np.append(starts, len(fp)))
    left, right = [], []
    run = np.repeat(np.arange(len(starts)), sizes)
    short = np.repeat(sizes <= 64, sizes)
    at = np.flatnonzero(short)
    for d in range(1, int(sizes[sizes <= 64].max(initial=1))):
        at = at[at + d < len(fp)]
        at = at[run[at] == run[at + d]]
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= max_bits]
        left.append(fp[near])
        right.append(fp[near + d])
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64]):
        own = fp[s : s + n]
        for i in range(0, n, 256):
            x, y = np.nonzero(np.bitwise_count(own[i : i + 256, None] ^ own[None, :]) <= max_bits)
            x += i
            x, y = x[x < y], y[x < y]
            # one star a slice instead of all its pairs
            star = stars(own[x].view(np.int64), own[y].view(np.int64))
            left.append(star.column("a").to_numpy().view(np.uint64))
            right.append(star.column("b").to_numpy().view(np.uint64))
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _links(max_bits: int):
    def run(batches):
        """Rows arrive sorted by unit; what is left of the last unit waits for the next batch."""
        rest = None
        for batch in batches:
            rows = np.stack([batch.column("unit").to_numpy(), batch.column("fp").to_numpy()])
            rows = rows if rest is None else np.concatenate([rest, rows], 1)
            last = int(np.searchsorted(rows[0], rows[0][-1])) if rows.shape[1] else 0
            yield from emit(rows[:, :last])
            rest = rows[:, last:]
        if rest is not None:
            yield from emit(rest)

    def emit(rows):
        if rows.shape[1] > 1:
            starts = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
            a, b = _pairs(np.ascontiguousarray(rows[1]).view(np.uint64), starts, max_bits)
            if len(a):
                yield stars(a.view(np.int64), b.view(np.int64))

    return run


def close_links(prints: DataFrame, n: int, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` within ``max_bits`` bits.

    Blocks: fingerprints meet where all but ``max_bits`` of their blocks agree. Buckets of one are
    dropped by a count. A bucket over ``chunk`` rows is cut into chunks by a hash, and each pair of
    chunks is a unit of its own, so no task holds a whole hot bucket. A unit returns stars, not pairs.
    """
    masks = block_masks(blocks_for(n, max_bits), max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "k"))
    counts = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    cut = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    met = keyed.join(counts, ["t", "k"]).withColumn("g", cut).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    other = F.expr("explode(transform(sequence(0, g - 1), x -> struct(least(c, x) as i, greatest(c, x) as j)))")
    units = met.select("t", "k", "fp", other.alias("o")).select(F.xxhash64("t", "k", "o.i", "o.j").alias("unit"), "fp")
    # A unit is named by a hash; two units that share one are merely compared together.
    dealt = units.repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(_links(max_bits), "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, row_key, fp, component_id, rep``.

    ``fp`` is the fingerprint as a signed long, ``component_id`` the smallest id that links reach
    (null ids only count where a component has no other), ``rep`` whether the row is the one of its
    component to keep (rows that repeat both id and text are all marked).

    Null and empty texts have fingerprint zero and link like any other. An empty table gives an
    empty result. Extra columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.write(docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), fingerprint(F.col(text_col)).alias("fp")), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    classes = scratch.write(prints.groupBy("fp").agg(first), "classes")
    links = scratch.write(close_links(classes.select("fp"), classes.count(), max_bits), "links")
    found = scratch.write(connected_components(links), "found")
    of = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # Classes in a component of their own need no second aggregation, but it is one row a class.
    firsts = of.groupBy("component").agg(F.min("first").alias("lead"))
    of = scratch.write(of.join(firsts, "component").select("fp", F.col("lead.doc_id").alias("component_id"), F.col("lead.row_key").alias("lead_key")), "of")
    scratch.drop(classes, links, found)
    return prints.join(of, "fp").select("doc_id", "row_key", "fp", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("lead_key"))).alias("rep"))


SIMILARITY, SIMILAR_WORDS = 0.8, 5
#: 64-bit words of a long fingerprint that are compared, and those of them that are looked at first.
CHECK_WORDS, FIRST_WORDS = 16, 4
#: Rows that share a block, on average.
BUCKET = 1024
#: Probability that two texts at the similarity agree in no block.
MISS = 0.02
#: A worker forgets its words beyond so many.
MEMO = 1 << 15
#: Rows that the order of shingles is found on, and how many frequent ones it tells apart.
ORDER_ROWS, COMMON = 8192, 1 << 16
#: First shingles that are dealt to one unit of work (28 bytes each), and units at least; pairs that wait for their neighbours.
DEALT, UNITS, HELD = 1 << 19, 48, 1 << 20
#: Rows that are compared with all others of a block at a time, and so many of those.
FRONT, SLICE = 64, 4096
#: Bits of the parities that go to every unit of work, at most.
SHORT = 1 << 13


def bits_apart(similarity: float) -> float:
    """Share of bits that differ where sets of one size overlap so far: the angle of their indicator vectors over pi. For sets
    of different sizes it is less."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def cut_for(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """Bits of a block and number of blocks: so long that ``BUCKET`` of ``n`` unlike rows share one, and so many that
    a pair at the similarity agrees in one but for ``MISS``."""
    bits = max(0, math.ceil(math.log2(max(1, n / BUCKET))))
    agree = (1 - bits_apart(similarity)) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - agree))) if bits else 1


def most_apart(similarity: float = SIMILARITY, words: int = CHECK_WORDS, deviations: float = 1.5) -> int:
    """Bits of the check that a linked pair may differ in: what is expected at the similarity, and some standard deviations."""
    share, bits = bits_apart(similarity), 64 * words
    return int(share * bits + deviations * math.sqrt(share * (1 - share) * bits))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= 64:
            self[word] = got
        return got


def grams_of(text: bytes | None, hashes: WordHashes, words: int) -> np.ndarray:
    """The set of word shingles, as sorted 64-bit hashes."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    each, width = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)), min(words, len(found))
    grams = np.full(len(found) - width + 1, width, np.uint64)
    for i in range(width):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + each[i : i + len(grams)]
    return np.unique(grams)


def long_print(grams: np.ndarray, size: int) -> np.ndarray:
    """SimHash of a set of shingles in ``size`` 64-bit words; all ones where there is none."""
    if not len(grams):
        return np.full(size, -1, np.int64)
    counts = np.zeros(64 * size, np.int64)
    for at in range(0, len(grams), 1 << 10):  # bounds the memory that a very long text takes
        x = grams[at : at + (1 << 10), None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * counts > len(grams), bitorder="little").view(np.int64)


def parity(grams: np.ndarray) -> np.ndarray:
    """At least 1,024 bits and as many as shingles, each the parity of the shingles that fall on it: two sets differ in at least as
    many shingles as bits. A power of two: a longer row of bits becomes a shorter one by folding."""
    bits = max(64 * CHECK_WORDS, 1 << (len(grams) - 1).bit_length() if len(grams) else 0)
    return np.packbits(np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def parities_apart(x: bytes, y: bytes) -> int:
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)).sum(dtype=np.int64))


def prefix_of(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set in an order that all sets share: so many that two sets at the similarity have one of them in
    common. ``common`` are hashes, sorted, and their places at the end of the order; before them are all others, by hash."""
    size = len(grams) - math.ceil(similarity * len(grams) - 1e-9) + 1 if len(grams) else 0
    values, places = common
    if not len(values):
        return grams[:size]
    at = np.minimum(np.searchsorted(values, grams), len(values) - 1)
    hit = values[at] == grams
    rare = grams[~hit]
    return rare[:size] if len(rare) >= size else np.append(rare, grams[hit][np.argsort(places[at[hit]])])[:size]


def _described(text, words: int, similarity: float, bits: int, blocks: int, common: tuple[np.ndarray, np.ndarray]):
    """Column of what a text is compared by: a digest of its set of shingles, how many there are, the words of the check and the
    blocks, the parities, and the first shingles."""
    per = 64 // bits if bits else 1
    size = CHECK_WORDS + (-(-blocks // per) if bits else 0)

    @F.pandas_udf("digest binary, n long, fp array<long>, parity binary, prefix binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        hashes, out = _hashes(), []
        for text in texts:
            grams = grams_of(text, hashes, words)
            whole = long_print(grams, size)
            rest = whole[CHECK_WORDS:].view(np.uint64)
            cut = [(rest[b // per] >> np.uint64(b % per * bits)) & np.uint64((1 << bits) - 1) for b in range(blocks)] if bits else [0]
            fp = np.append(whole[:CHECK_WORDS], np.array(cut, np.int64))
            out.append((hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), len(grams), fp, parity(grams).tobytes(), prefix_of(grams, common, similarity).tobytes()))
        return pd.DataFrame(out, columns=["digest", "n", "fp", "parity", "prefix"])

    return of(text.cast("binary"))


def _grams(words: int, batches):
    """Rows (cls, text): the shingles of each."""
    for batch in batches:
        sets = [grams_of(t, _hashes(), words).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["cls", "grams"])


def _each_gram(words: int, batches):
    for batch in batches:
        for t in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(grams_of(t, _hashes(), words).view(np.int64))], ["gram"])


def common_grams(docs: DataFrame, text_col: str, words: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts share, and their order, from the rarer to the more frequent. They are found on about ``ORDER_ROWS`` rows: any order
    gives the same links, this one few candidates."""
    text = F.col(text_col).cast("binary")
    some = docs.select(text.alias("text")).filter(F.pmod(F.xxhash64(text), F.lit(max(1, n // ORDER_ROWS))) == 0)
    seen = some.mapInArrow(partial(_each_gram, words), "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter("n > 3")
    rows = seen.orderBy(F.desc("n"), "gram").limit(COMMON).collect()
    values = np.array([x.gram for x in rows], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], -order


@lru_cache(1)
def _hashes() -> WordHashes:
    """The word hashes of a Python worker."""
    return WordHashes()


def _near(x: np.ndarray, y: np.ndarray, first: int, most: int) -> np.ndarray:
    """Which rows of ``x`` and ``y`` differ in at most ``most`` bits; only pairs with at most ``first`` in the first words are looked at whole."""
    out = sum(np.bitwise_count(x[:, None, w] ^ y[None, :, w]).astype(np.uint16) for w in range(FIRST_WORDS)) <= first
    i, j = np.nonzero(out)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        out[p, q] = np.bitwise_count(x[p] ^ y[q]).sum(1, dtype=np.uint16) <= most
    return out


def _forest(own: np.ndarray, first: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of one block that connect whatever is at most so many bits apart.

    A row is compared with those that nothing reached yet: in a group of near copies the first row reaches most, and
    what is left is little.
    """
    a, b, left = [], [], np.arange(len(own))
    while len(left):
        front, left = left[:FRONT], left[FRONT:]
        x, y = np.nonzero(np.triu(_near(own[front], own[front], first, most), 1))
        a.append(front[x])
        b.append(front[y])
        while len(front) and len(left):
            part, front, rest = front[:FRONT], front[FRONT:], []
            for at in range(0, len(left), SLICE):
                some = left[at : at + SLICE]
                near = _near(own[part], own[some], first, most)
                hit = near.any(0)
                a.append(part[near[:, hit].argmax(0)])
                b.append(some[hit])
                front = np.append(front, some[hit])
                rest.append(some[~hit])
            left = np.concatenate(rest)
    return np.concatenate(a), np.concatenate(b)


def _block_links(first: int, most: int, batches):
    """Rows arrive sorted by block; what is left of the last block waits for the next batch."""
    rest = None
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns], 1)
        rows = rows if rest is None else np.concatenate([rest, rows])
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0])) if len(rows) else 0
        yield from _links_of(rows[:last], first, most)
        rest = rows[last:]
    if rest is not None:
        yield from _links_of(rest, first, most)


def _links_of(rows: np.ndarray, first: int, most: int):
    """Of the links of a block one for each row: what that leaves out is found by the first shingles."""
    a, b = [], []
    borders = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])) if len(rows) else []
    for s, e in zip(borders, [*borders[1:], len(rows)]):
        if e - s > 1:
            x, y = _forest(np.ascontiguousarray(rows[s:e, 2:]).view(np.uint64), first, most)
            y, at = np.unique(y, return_index=True)
            a.append(rows[s:e, 1][x[at]])
            b.append(rows[s:e, 1][y])
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        yield _pair_batch(np.minimum(a, b), np.maximum(a, b))


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _deal(units: int, batches):
    """Rows (cls, component, prefix, n): a row for each unit, with the shingles that fall to it (32 bits of each), their classes, components, sizes and
    places in the order."""
    for batch in batches:
        prefixes = batch.column(2).to_pylist()
        n = np.array([len(x) // 8 for x in prefixes], np.int64)
        grams = np.frombuffer(b"".join(prefixes), np.uint64)
        unit = (grams % np.uint64(units)).astype(np.int64)
        order = np.argsort(unit, kind="stable")
        place = np.arange(len(grams)) - np.repeat(np.cumsum(n) - n, n)
        each = [np.repeat(batch.column(i).to_numpy(), n) for i in (0, 1, 3)]
        columns = [((grams // np.uint64(units)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), *each[:2], each[2].astype(np.uint32), place.astype(np.uint32)]
        columns = [c[order] for c in columns]
        found, at = np.unique(unit[order], return_index=True)
        ends = np.append(at[1:], len(unit))
        blobs = [pa.array([c[s:e].tobytes() for s, e in zip(at, ends)], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *blobs], ["unit", "gram", "cls", "component", "n", "place"])


def _may(similarity: float, component: np.ndarray, n: np.ndarray, place: np.ndarray):
    """Whether rows with one shingle are of different components and may have the similarity, if that shingle is the first that they
    share: all that they share are at its place or after it in both."""

    def may(x, y):
        m, k = n[x], n[y]
        fit = (component[x] != component[y]) & (np.minimum(m, k) >= similarity * np.maximum(m, k) - 1e-9)
        return fit & (np.minimum(m - place[x], k - place[y]) >= (m + k) * (similarity / (1 + similarity)) - 1e-9)

    return may


def _within(run: np.ndarray, may):
    """Pairs of rows of one run that ``may`` allows, some at a time; rows are sorted by run."""
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    sizes = np.diff(np.append(starts, len(run)))
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 64), sizes))
    for d in range(1, int(sizes[sizes <= 64].max(initial=1))):
        at = at[at + d < len(run)]
        at = at[run[at] == run[at + d]]
        x = at[may(at, at + d)]
        yield x, x + d
    for s, e in zip(starts[sizes > 64], (starts + sizes)[sizes > 64]):
        for i in range(s, e, 64):
            for j in range(i, e, 1 << 14):  # bounds the memory that a frequent shingle takes
                x, y = np.nonzero(may(np.arange(i, min(i + 64, e))[:, None], np.arange(j, min(j + (1 << 14), e))[None]))
                x, y = x + i, y + j
                yield x[x < y], y[x < y]


def _meet(similarity: float, units: int, batches):
    """Rows arrive sorted by unit: of the first shingles those that may be the first one that two classes of different components share, with
    the classes, their places and the number of classes that share it. These are rows of the input, not pairs."""
    own, held = None, []
    for batch in batches:
        for unit, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            if unit != own and held:
                yield _met_of(own, held, similarity, units)
                held = []
            own = unit
            held.append(blobs)
    if held:
        yield _met_of(own, held, similarity, units)


def _met_of(unit: int, held: list, similarity: float, units: int) -> pa.RecordBatch:
    gram, cls, component, n, place = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held), (np.uint32, np.int64, np.int64, np.uint32, np.uint32)))
    order = np.argsort(gram, kind="stable")
    gram, cls, component, n, place = (c[order].astype(np.int64) for c in (gram, cls, component, n, place))
    sizes = _counts(gram)
    hit = sizes > 2 * CHUNK  # of those all stay
    some = np.flatnonzero((sizes > 1) & ~hit)
    for x, y in _within(gram[some], _may(similarity, component[some], n[some], place[some])) if len(some) else ():
        hit[some[x]] = hit[some[y]] = True
    gram, cls, place = gram[hit], cls[hit], place[hit]
    return pa.RecordBatch.from_arrays([pa.array(gram * units + unit), pa.array(cls), pa.array(place), pa.array(_counts(gram))], ["gram", "cls", "place", "met"])


def _counts(run: np.ndarray) -> np.ndarray:
    """The length of the run that each row is in."""
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(run)))
    return np.repeat(sizes, sizes)


def short_parity(bits: bytes) -> bytes:
    """Half as many bits as :func:`parity`, but 1,024 at least and ``SHORT`` at most. That tells unlike sets apart up to twice as many shingles as bits."""
    x = np.frombuffer(bits, np.uint64)
    return np.bitwise_xor.reduce(x.reshape(-1, max(CHECK_WORDS, min(len(x) // 2, SHORT // 64))), 0).tobytes()


def _shortened(batches):
    for batch in batches:
        *others, bits = batch.columns
        yield pa.RecordBatch.from_arrays([*others, pa.array([short_parity(x) for x in bits.to_pylist()], pa.binary())], ["cls", "component", "n", "parity"])


def _close(similarity: float, nearest: bool, batches):
    """Rows arrive sorted by unit: pairs of classes that may be compared (see :func:`_may`) and whose parities allow the similarity,
    all of them or, with ``nearest``, for each row of a unit the nearest one."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        unit = rows.column("unit").to_numpy()
        last = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
        yield from _close_of(rows.slice(0, last), similarity, nearest)
        rest = rows.slice(last)
    if rest is not None:
        yield from _close_of(rest, similarity, nearest)


def _close_of(rows: pa.Table, similarity: float, nearest: bool):
    if len(rows) < 2:
        return
    unit, cls, component, n, place, side = (rows.column(c).to_numpy() for c in ("unit", "cls", "component", "n", "place", "side"))
    bits = rows.column("parity").to_pylist()
    words = np.array([len(x) // 8 for x in bits])
    allowed, tables, found, waiting = _may(similarity, component, n, place), {}, [], 0

    def may(x, y):
        return allowed(x, y) & ((side[x] != side[y]) | (side[x] < 0))

    def table(size):
        """The rows with parities of that size and, folded, of twice that size, and where they are."""
        if size not in tables:
            at = np.flatnonzero((words == size) | (words == 2 * size))
            where = np.zeros(len(words), np.int64)
            where[at] = np.arange(len(at))
            tables[size] = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, size), 0) for i in at]), where
        return tables[size]

    def apart(x, y):
        """Sizes of such pairs are so alike that parities have one size or one has twice the other's."""
        size, out = np.minimum(words[x], words[y]), np.empty(len(x), np.int64)
        for s in np.unique(size):
            own, where = table(int(s))
            of = np.flatnonzero(size == s)
            for i in range(0, len(of), 1 << 14):
                k = of[i : i + (1 << 14)]
                out[k] = np.bitwise_count(own[where[x[k]]] ^ own[where[y[k]]]).sum(1, dtype=np.int64)
        return out

    def pairs():
        a, b = np.concatenate([cls[x] for x, _ in found]), np.concatenate([cls[y] for _, y in found])
        found.clear()
        return _pair_batch(*np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0).T)

    best = np.full(len(cls), np.iinfo(np.int64).max)
    for x, y in _within(unit, may):
        far, most = apart(x, y), n[x] + n[y]
        keep = far <= most * ((1 - similarity) / (1 + similarity)) + 1e-9
        x, y, far, most = x[keep], y[keep], far[keep], most[keep]
        if nearest:
            for one, other in ((x, y), (y, x)):
                np.minimum.at(best, one, ((far << 20) // most) * len(cls) + other)
            continue
        found.append((x, y))
        waiting += len(x)
        if waiting > HELD:
            yield pairs()
            waiting = 0
    if nearest and len(x := np.flatnonzero(best < np.iinfo(np.int64).max)):
        found.append((x, best[x] % len(cls)))
        waiting = len(x)
    if waiting:
        yield pairs()


def _placed(classes: DataFrame, components: DataFrame) -> DataFrame:
    return classes.join(components.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))


def _first_shared(classes: DataFrame, components: DataFrame, similarity: float) -> DataFrame:
    """Rows ``(gram, cls, place, met)`` of :func:`_meet`."""
    grams = (classes.agg(F.sum(F.length("prefix"))).first()[0] or 0) // 8
    count = max(UNITS, grams // DEALT)
    units = _placed(classes, components).select("cls", "component", "prefix", "n").mapInArrow(partial(_deal, count), "unit long, gram binary, cls binary, component binary, n binary, place binary")
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(partial(_meet, similarity, count), "gram long, cls long, place long, met long")


def _compared(met: DataFrame, classes: DataFrame, components: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """Pairs ``(a, b)`` of classes in different components whose parities allow the similarity. Classes that share a first shingle are
    compared within a unit of work, where they are many in pairs of chunks; only pairs that pass become rows."""
    told = _placed(classes, components).select("cls", "component", "n", "parity").mapInArrow(_shortened, "cls long, component long, n long, parity binary")
    parts = met.withColumn("g", F.ceil(F.col("met") / F.lit(CHUNK)).cast("int")).withColumn("c", F.pmod(F.xxhash64("cls"), F.col("g")).cast("int"))
    other = F.expr("explode(transform(sequence(0, g - 1), x -> struct(least(c, x) as i, greatest(c, x) as j)))")
    side = F.when(F.expr("o.i = o.j"), -1).otherwise(F.col("c"))
    rows = parts.select("gram", "cls", "place", "c", other.alias("o")).select(F.xxhash64("gram", "o.i", "o.j").alias("unit"), "cls", "place", side.alias("side"))
    dealt = rows.join(told, "cls").select("unit", "cls", "component", "n", "place", "side", "parity").repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(partial(_close, similarity, nearest), "a long, b long").distinct()


def _possible(similarity: float, batches):
    """Pairs whose sizes and parities allow the similarity."""
    for batch in batches:
        a, b, m, n = (batch.column(c).to_numpy() for c in ("a", "b", "m", "n"))
        keep, most = np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-9, (m + n) * ((1 - similarity) / (1 + similarity)) + 1e-9
        x, y = batch.column("x"), batch.column("y")
        for i in np.flatnonzero(keep):
            keep[i] = parities_apart(x[i].as_py(), y[i].as_py()) <= most[i]
        yield _pair_batch(a[keep], b[keep])


def _alike(similarity: float, batches):
    """Pairs whose sets of shingles have the similarity."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both / max(1, len(x) + len(y) - both) >= similarity)
        yield _pair_batch(*(batch.column(c).to_numpy()[np.array(keep, bool)] for c in ("a", "b")))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key, text, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Those of ``pairs (a, b)`` of classes that have the similarity, by all their shingles."""
    side = lambda df, c, *names: df.select(F.col("cls").alias(c), *[F.col(x).alias(y) for x, y in names])
    sized = pairs.join(side(classes, "a", ("n", "m"), ("parity", "x")), "a").join(side(classes, "b", ("n", "n"), ("parity", "y")), "b")
    possible = scratch.write(sized.mapInArrow(partial(_possible, similarity), "a long, b long"), "possible")
    asked = possible.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    first = classes.join(asked, "cls", "left_semi").select("cls", F.col("first.row_key").alias("row_key"))
    met = docs.select(key.alias("row_key"), text.cast("binary").alias("text")).join(first, "row_key").select("cls", "text")
    sets = scratch.write(met.mapInArrow(partial(_grams, words), "cls long, grams binary").dropDuplicates(["cls"]), "sets")
    both = possible.join(side(sets, "a", ("grams", "x")), "a").join(side(sets, "b", ("grams", "y")), "b")
    links = scratch.write(both.select("a", "b", "x", "y").mapInArrow(partial(_alike, similarity), "a long, b long"), "links")
    scratch.drop(possible, sets)
    return links


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, row_key, component_id, rep``, as :func:`near_groups` has them.

    Links are between all texts whose sets of ``words``-word shingles (lower-cased as op2 does) have that Jaccard similarity or
    more, and no others. Rows with the same set are one class. Pairs of classes are found in two ways, and every pair is
    verified by all its shingles. First by fingerprints of 1,024 bits that are near and agree in a block of further bits, which
    finds most (:func:`cut_for`, :func:`most_apart`). Then, between the components of that, by :func:`prefix_of`: two
    sets at the similarity share one of their first shingles, a fifth of each, so none is left out. Most near copies are one component by
    then and don't meet.

    What is left costs a row for each first shingle that may be the first one that two texts share (:func:`_may`), and one for each pair that passes the
    parities: of those the nearest of each text come first, and the others only if they are in different components still. Comparisons of parities within a
    unit of work are as many as pairs of texts that share such a shingle: that number grows with the square of a group that stays apart;
    frequent ones come last. Nothing is capped. Null and empty texts are alike and like nothing else. An empty table gives an
    empty result. Extra columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    total = docs.count()
    bits, blocks = cut_for(total, similarity)
    common = common_grams(docs, text_col, words, total)
    key, text = row_key(id_col, text_col), F.col(text_col)
    prints = scratch.write(docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("row_key"), _described(text, words, similarity, bits, blocks, common).alias("d")).select("doc_id", "row_key", "d.*"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    same = F.first(F.struct("n", "fp", "parity", "prefix")).alias("s")
    classes = scratch.write(prints.groupBy("digest").agg(first, same).select("digest", "first", "s.*").withColumn("cls", F.monotonically_increasing_id()), "classes")
    verified = partial(_verified, classes=classes, docs=docs, key=key, text=text, words=words, similarity=similarity, scratch=scratch)
    keyed = classes.select("cls", "fp", F.posexplode(F.slice("fp", CHECK_WORDS + 1, blocks)).alias("t", "k"))
    block = F.shiftleft(F.col("t").cast("long"), 48) + F.col("k")
    dealt = keyed.select(block.alias("block"), "cls", *[F.element_at("fp", i + 1).alias(f"c{i}") for i in range(CHECK_WORDS)]).repartition("block").sortWithinPartitions("block")
    near = scratch.write(dealt.mapInArrow(partial(_block_links, most_apart(similarity, FIRST_WORDS, 4), most_apart(similarity)), "a long, b long").distinct(), "near")
    links = verified(near)
    before = scratch.write(connected_components(links), "before")
    scratch.drop(near)
    met = scratch.write(_first_shared(classes, before, similarity), "met")
    # First everybody's nearest, which joins most of what is to be joined, then all pairs between what is still apart.
    for nearest in (True, False):
        close = scratch.write(_compared(met, classes, before, similarity, nearest), "close")
        rest = verified(close)
        both = scratch.write(links.unionByName(rest), "both")
        scratch.drop(close, links, rest, before)
        links, before = both, scratch.write(connected_components(both), "found")
    found = before
    of = classes.select("digest", "cls", "first").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    firsts = of.groupBy("component").agg(F.min("first").alias("lead"))
    of = scratch.write(of.join(firsts, "component").select("digest", F.col("lead.doc_id").alias("component_id"), F.col("lead.row_key").alias("lead_key")), "of")
    scratch.drop(classes, links, met, found)
    return prints.join(of, "digest").select("doc_id", "row_key", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("lead_key"))).alias("rep"))


@sheltering
def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of :func:`similar_groups`: the one with the smallest id. Rows with a null id stay only
    where a group has no other; of rows that repeat id and text one stays. Columns of any name stay; an empty table gives an empty result."""
    # Keys without nulls: the join then deals the texts by the very columns that the last step groups by, and they travel once.
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    keep = similar_groups(docs, id_col, text_col, words, similarity).filter("rep").select(name(F.col("doc_id")).alias("__id"), F.col("row_key").alias("__key")).distinct()
    keyed = docs.withColumn("__id", name(F.col(id_col).cast("long"))).withColumn("__key", row_key(id_col, text_col))
    return keyed.join(keep, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"]).select(*docs.columns)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
