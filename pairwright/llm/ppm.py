"""Language-model scores by prediction by partial matching over bytes."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.frames import table
from pairwright.plans.storage import Scratch

ORDER = 5
#: Bytes that no UTF-8 text has: what stands before a text, and what ends it.
PAD, END = 0xFE, 0xFF
SYMBOLS = 255  # every byte but PAD
#: Text bytes of a chunk: the rows whose n-grams and words are looked up together.
CHUNK_BYTES = 32 << 20
#: Text bytes that are turned into n-grams at a time.
SLICE_BYTES = 1 << 20
FOLDS, HELD_OUT = 7, 2
OWN = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # ASCII only, both


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of the texts, ends included: its context, most recent byte first, and itself, as
    one number; and how many symbols each text has."""
    stream = np.frombuffer(b"".join(bytes([PAD]) * ORDER + t + bytes([END]) for t in texts), np.uint8)
    back = np.append(stream[::-1], np.zeros(8, np.uint8))
    windows = np.ndarray((len(stream) - ORDER,), ">u8", back.data, 1, (1,))  # the context of a symbol, read backwards
    context = windows.astype(np.int64) >> (64 - 8 * ORDER) & ((1 << 8 * ORDER) - 1)
    symbol = stream[ORDER:]
    keys = (context[::-1] << 8) | symbol
    return keys[symbol != PAD], np.array([len(t) + 1 for t in texts])


def _tally(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.diff(np.append(first, len(keys)))


def _gather(batches):
    """Rows (chunk, learn, text), sorted by chunk, to the chunk's distinct n-grams and words with their counts in training rows."""
    chunk, words, seen, kept, pending, size = None, Counter(), set(), [], {True: [], False: []}, 0

    def settle():
        nonlocal size
        for learn, texts in pending.items():
            if texts:
                keys, n = _distinct(grams(texts)[0])
                kept.append((keys, n if learn else np.zeros(len(keys), np.int64)))
                texts.clear()
        size = 0
        if len(kept) > 8:
            kept[:] = [_tally(np.concatenate([k for k, _ in kept]), np.concatenate([n for _, n in kept]))]

    def close():
        settle()
        if kept:
            keys, n = _tally(np.concatenate([k for k, _ in kept]), np.concatenate([n for _, n in kept]))
            for at in range(0, len(keys), 1 << 17):
                k = keys[at : at + (1 << 17)]
                yield _rows(chunk, len(k), key=pa.array(k), n=pa.array(n[at : at + (1 << 17)].astype(np.int64)))
        names = [*words, *(seen - words.keys())]
        for at in range(0, len(names), 1 << 17):
            part = names[at : at + (1 << 17)]
            yield _rows(chunk, len(part), word=pa.array(part, pa.binary()), n=pa.array([words.get(w, 0) for w in part], pa.int64()))

    def _rows(c, rows, key=None, word=None, n=None):
        columns = [pa.array(np.full(rows, c, np.int32)), key if key is not None else pa.nulls(rows, pa.int64()), word if word is not None else pa.nulls(rows, pa.binary()), n]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "key", "word", "n"])

    for batch in batches:
        for c, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if c != chunk:
                if chunk is not None:
                    yield from close()
                chunk, words, seen, kept = c, Counter(), set(), []
            found = tokens_of(text)
            if learn:
                words.update(found)
                words[b""] += 1  # the end
            else:
                seen.update(found)
                seen.add(b"")
            low = (text or b"").lower()
            pending[learn].append(low)
            size += len(low)
            if size >= SLICE_BYTES:
                settle()
    if chunk is not None:
        yield from close()


def shorter(keys: np.ndarray) -> np.ndarray:
    """The same n-grams without the oldest byte of their contexts."""
    return (keys >> 16 << 8) | (keys & 255)


class Level:
    """The children of all contexts of one order: counts, and of each context the sum, the number of children and
    what they weigh one order below."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        first = np.flatnonzero(np.append(True, keys[1:] >> 8 != keys[:-1] >> 8)) if len(keys) else np.zeros(0, int)
        self.first, self.contexts = first, keys[first] >> 8
        self.sums = np.add.reduceat(n, first) if len(keys) else n
        self.children = np.diff(np.append(first, len(keys)))
        self.below = np.zeros(len(first), np.int64)

    def link(self, lower: Level) -> None:
        if len(self.keys):
            self.below = np.add.reduceat(lower.n[np.searchsorted(lower.keys, shorter(self.keys))], self.first)


def lower_levels(keys: np.ndarray, n: np.ndarray) -> dict[int, Level]:
    """The trie's orders 0 to 2 from the counts of all symbols after two bytes (``keys`` distinct, sorted)."""
    levels = {2: Level(keys, n)}
    for order in (1, 0):
        levels[order] = Level(*_tally(shorter(levels[order + 1].keys), levels[order + 1].n))
        levels[order + 1].link(levels[order])
    return levels


def log_probabilities(keys: np.ndarray, n: np.ndarray, lower: dict[int, Level]) -> np.ndarray:
    """log10 probability of each n-gram's symbol after its context.

    ``keys`` (distinct, sorted) with their training counts ``n`` are all n-grams of whole groups that share the three
    most recent bytes; ``lower`` has the orders below for all training rows.

    From the longest context down: a context that was seen gives its children count / (sum + children),
    and what is left to an escape. After an escape the children of the longer context are excluded:
    they count neither in the sum nor as children. Below order 0 all symbols that are left are equal.
    """
    learned = n > 0
    levels = {**lower, ORDER: Level(keys[learned], n[learned])}
    for order in range(ORDER - 1, 2, -1):
        levels[order] = Level(*_tally(shorter(levels[order + 1].keys), levels[order + 1].n))
    for order in range(3, ORDER + 1):
        levels[order].link(levels[order - 1])
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    q, less, fewer = keys, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for order in range(ORDER, -1, -1):
        level = levels[order]
        if len(level.keys):
            at = np.minimum(np.searchsorted(level.contexts, q >> 8), len(level.contexts) - 1)
            seen = level.contexts[at] == q >> 8
            left = np.where(seen, level.children[at] - fewer, 0)
            whole = np.where(seen, level.sums[at] - less + left, 0)
            child = np.minimum(np.searchsorted(level.keys, q), len(level.keys) - 1)
            hit = open_ & (level.keys[child] == q)
            out[hit] += np.log10(level.n[child[hit]] / whole[hit])
            miss = open_ & ~hit & (whole > 0)
            out[miss] += np.log10(left[miss] / whole[miss])
            open_ &= ~hit
            less, fewer = np.where(seen, level.below[at], 0), np.where(seen, level.children[at], 0)
        q = shorter(q)
    out[open_] -= np.log10(SYMBOLS - len(levels[0].keys))
    return out


def _trie(triples):
    def run(batches):
        """Rows (key, n) sorted by key; a pass takes whole groups of the three most recent bytes."""
        rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        low = lower_levels(*triples.value)
        for batch in batches:
            keys, n = np.append(rest[0], batch.column(0).to_numpy()), np.append(rest[1], batch.column(1).to_numpy())
            cut = np.searchsorted(keys, keys[-1] >> 24 << 24) if len(keys) > 300_000 else 0
            if cut:
                yield emit(keys[:cut], n[:cut], low)
            rest = keys[cut:], n[cut:]
        if len(rest[0]):
            yield emit(*rest, low)

    def emit(keys, n, low):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(log_probabilities(keys, n, low))], ["key", "p"])

    return run


#: Rows that a task packs at a time.
PACK_ROWS = 1 << 20


def _pack(kind: int):
    """Rows (chunk, key or word, value) to one row a chunk with two blobs: what a chunk asked for, small enough to exchange again."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PACK_ROWS:
                yield from emit(held)
                held, rows = [], 0
        if rows:
            yield from emit(held)

    def emit(held):
        t = pa.Table.from_batches(held)
        order = np.argsort(t.column(0).to_numpy(), kind="stable")
        chunks, names = t.column(0).to_numpy()[order], t.column(1).take(pa.array(order))
        values = t.column(2).to_numpy()[order]
        borders = np.append(np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])), len(chunks))
        for a, b in zip(borders, borders[1:]):
            part = names.slice(a, b - a)
            data = b" ".join(part.to_pylist()) if kind else part.to_numpy().tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunks[a]], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary()), pa.array([values[a:b].tobytes()], pa.binary())], ["chunk", "kind", "data", "vals"])

    return run


class Lookup:
    """Values by n-gram in an open hash table that numpy searches for many at once; every n-gram asked for is there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (3 * len(keys) // 2).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        rest = np.arange(len(keys))
        at = self._home(keys)
        while len(rest):
            _, one = np.unique(at, return_index=True)  # of those that want a place one gets it, if it is free
            one = one[self.keys[at[one]] == -1]
            self.keys[at[one]], self.values[at[one]] = keys[rest[one]], values[rest[one]]
            left = np.ones(len(rest), bool)
            left[one] = False
            rest, at = rest[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.values[at]
        bad = np.flatnonzero(self.keys[at] != keys)
        at, keys = at[bad], keys[bad]
        while len(bad):
            at = (at + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at] == keys
            out[bad[hit]] = self.values[at[hit]]
            bad, at, keys = bad[~hit], at[~hit], keys[~hit]
        return out


def _score(total: int, distinct: int, slice_bytes: int = SLICE_BYTES):
    """Rows of a chunk in the order n-grams, words, documents: the first two are the tables for the third."""
    floor = math.log10(total + distinct + 1)
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        chunk, keys, ps, known, tables = None, [], [], {}, None
        for batch in batches:
            chunks, kinds = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            borders = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *borders], [*borders, len(chunks)]):
                if a == b:
                    continue
                if chunks[a] != chunk:
                    chunk, keys, ps, known, tables = chunks[a], [], [], {}, None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    keys += [np.frombuffer(x, np.int64) for x in part.column("data").to_pylist()]
                    ps += [np.frombuffer(x, np.float64) for x in part.column("vals").to_pylist()]
                elif kinds[a] == 1:
                    for names, n in zip(part.column("data").to_pylist(), part.column("vals").to_pylist()):
                        known.update(zip(names.split(b" "), np.frombuffer(n, np.int64).tolist()))
                else:
                    if tables is None:
                        tables, keys, ps = Lookup(np.concatenate(keys), np.concatenate(ps)), [], []
                    yield from score(part, tables, known)

    def score(part, tables, known):
        rows, texts, size = [], [], 0
        for i, held, text in zip(part.column("id").to_pylist(), part.column("held").to_pylist(), part.column("data").to_pylist()):
            words = [*tokens_of(text), b""]
            c = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            low = (text or b"").lower()
            rows.append([i, held, len(words), int((c > 0).sum()), float(np.log10(c + 1.0).sum()) - floor * len(words), 0.0])
            if len(low) < slice_bytes:
                texts.append((rows[-1], low))
                size += len(low)
            else:  # a long text goes through in slices, each with the bytes before it as context
                rows[-1][-1] = sum(float(tables(_slice_keys(low, at, slice_bytes)).sum()) for at in range(0, len(low) + 1, slice_bytes))
            if size >= slice_bytes or len(rows) == 4096:
                together(texts, tables)
                yield out(rows)
                rows, texts, size = [], [], 0
        if rows:
            together(texts, tables)
            yield out(rows)

    def together(texts, tables):
        if texts:
            keys, sizes = grams([t for _, t in texts])
            for (row, _), total in zip(texts, np.add.reduceat(tables(keys), np.cumsum(sizes) - sizes).tolist()):
                row[-1] = total

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _slice_keys(low: bytes, at: int, size: int) -> np.ndarray:
    end = min(len(low) + 1, at + size)
    lead = low[max(0, at - ORDER) : at]
    keys, _ = grams([lead + low[at:end]])
    keys = keys[len(lead) :]
    return keys if end == len(low) + 1 else keys[:-1]  # but for the last slice, the end is not there yet


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model is the trie of all byte contexts up to order 5 of all training rows (crc32 of the id mod 7 is
    not 2; null ids are training rows), with escape method C and symbol exclusion. What is scored is
    every byte of the lower-cased text, white space as it stands, and an end symbol. ``base_score`` is the
    add-one unigram score of its words and the end.

    No table is broadcast or collected but the counts of symbols after two bytes, at most 2 ** 24: rows are dealt into
    chunks of bounded bytes, each chunk sends its distinct n-grams and words once, sums and
    probabilities are found per n-gram and word, and come back to the chunks that asked. The trie is worked out in
    groups of its three most recent context bytes, over distinct n-grams only.

    Null and empty texts have one token, the end. Repeated rows are scored alike and each counted in training; rows that repeat
    both id and text lie in one chunk.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    size = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(chunks)).cast("int").alias("chunk"), F.col(id_col).cast("long").alias("id"), held.alias("held"), text.cast("binary").alias("data"))
    dealt = rows.select("chunk", ~F.col("held"), "data").repartitionById(chunks, "chunk").sortWithinPartitions("chunk")
    found = scratch.write(dealt.mapInArrow(_gather, "chunk int, key long, word binary, n long"), "found")
    grams_, words = found.filter("key is not null").select("chunk", "key", "n"), found.filter("word is not null").select("chunk", "word", "n")

    counts = scratch.write(grams_.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    # At most 2 ** 24 rows of 16 bytes; text has a few hundred thousand.
    after_two = F.shiftleft(F.shiftright("key", 32), 8) + F.col("key").bitwiseAND(F.lit(255).cast("long"))
    triples = counts.filter("n > 0").groupBy(after_two.alias("k")).agg(F.sum("n").alias("n")).toArrow().sort_by("k")
    triples = tuple(triples[c].to_numpy().astype(np.int64) for c in ("k", "n"))
    grouped = counts.repartition(F.shiftright("key", 24)).sortWithinPartitions("key")
    chances = scratch.write(grouped.mapInArrow(_trie(spark.sparkContext.broadcast(triples)), "key long, p double"), "chances")
    totals = scratch.write(words.groupBy("word").agg(F.sum("n").alias("n")), "totals")
    known = totals.filter("n > 0").agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()

    packed = "chunk int, kind int, data binary, vals binary"
    asked = scratch.write(grams_.join(chances, "key").select("chunk", "key", "p").mapInArrow(_pack(0), packed), "asked")
    named = scratch.write(words.drop("n").join(totals, "word").select("chunk", "word", "n").mapInArrow(_pack(1), packed), "named")
    scratch.drop(found, counts, chances, totals)

    tables = asked.unionByName(named).select("*", F.lit(None).cast("long").alias("id"), F.lit(None).cast("boolean").alias("held"))
    texts = rows.select("chunk", F.lit(2).alias("kind"), "data", F.lit(None).cast("binary").alias("vals"), "id", "held")
    together = tables.unionByName(texts).repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "kind")
    out = together.mapInArrow(_score(known.n, known.v, slice_bytes), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = scratch.write(out, "scores")
    scratch.drop(asked, named)
    return out.withColumn("train_tokens", F.lit(known.n).cast("long"))


def op5_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id").select("doc_id", *OWN)
