"""Benchmark decontamination with suffix arrays over the training documents."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.frames import sheltering, sheltering_also, table, without

WINDOW = 10
OWN = ["n_words", "n_hit", "spans", "items", "longest"]
#: Bytes of benchmark text that are searched for in one pass; more text takes more passes. A pass takes about 40 times as
#: much of the driver's memory and of each Python worker's, at most.
BLOCK_BYTES = 4 << 20
#: Words of documents in one suffix array.
SHARD_WORDS = 1 << 18
#: Bytes to word bytes: A-Z become a-z, other ASCII but letters and digits separates words, all else stays.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def deep_keys(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The next ``depth`` word numbers from each position as a string that sorts as they do. Nothing counts behind a
    zero: a foreign word, or the end of a text."""
    deep = ids[at[:, None] + np.arange(depth)]
    deep[np.logical_or.accumulate(deep == 0, axis=1)] = 0
    return np.ascontiguousarray(deep.astype(">u4")).view(f"S{4 * depth}").ravel()


def sorted_suffixes(ids: np.ndarray) -> np.ndarray:
    """Positions of words in the order of the suffixes there, each up to its text's end, by prefix doubling."""
    at = np.flatnonzero(ids)
    end = np.flatnonzero(ids == 0)
    left = end[np.searchsorted(end, at)] - at if len(at) else at  # words until the text's end
    rank = np.zeros(len(ids), np.int64)
    rank[at] = ids[at]
    depth, kinds = 1, 0
    while len(at):
        far = np.minimum(at + depth, len(ids) - 1)
        key = rank[at] * (len(ids) + 1) + np.where(left > depth, rank[far], 0)
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.append(1, np.diff(key[order]) != 0))
        rank[at[order]] = new
        if new[-1] in (kinds, len(at)):
            return at[order].astype(np.int32)
        depth, kinds = 2 * depth, new[-1]
    return at.astype(np.int32)


@dataclass
class Tests:
    """A block of the benchmark as arrays: its words, and its suffixes in order."""

    window: int
    words: bytes  # the vocabulary, joined by blanks; a word's number is its place from 1
    ids: np.ndarray  # word numbers of all texts, zeros behind each
    starts: np.ndarray  # where each text begins
    item: np.ndarray  # of each text the place of its id among ``names``, or -1
    names: list[str]  # sorted
    order: np.ndarray  # sorted_suffixes(ids)

    @cached_property
    def vocabulary(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.split(), 1)}

    @cached_property
    def suffixes(self) -> np.ndarray:
        """All suffixes as strings of ``window`` words, sorted."""
        return deep_keys(self.ids, self.order, self.window)

    @cached_property
    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows as sorted strings, for each the largest string that it begins, its length, and where its items
        begin in the last array. An item shorter than a window is one window."""
        text = np.searchsorted(self.starts, self.order, "right") - 1
        sizes = np.diff(np.append(self.starts, len(self.ids) - self.window)) - 1
        left = self.starts[text] + sizes[text] - self.order
        is_one = (left >= self.window) | (self.order == self.starts[text]) & (sizes[text] < self.window)
        keys, of = np.unique(self.suffixes[is_one], return_inverse=True)
        lengths = np.zeros(len(keys), np.int64)
        lengths[of] = np.minimum(left[is_one], self.window)
        width = 4 * self.window
        whole = np.frombuffer(keys.astype(f"S{width}").tobytes(), np.uint8).reshape(-1, width) if len(keys) else np.zeros((0, width), np.uint8)
        ends = np.ascontiguousarray(np.where(np.arange(width) < 4 * lengths[:, None], whole, 255).astype(np.uint8)).view(f"S{width}").ravel()
        n = len(self.names) + 1
        pairs = np.unique(of.astype(np.int64) * n + self.item[text[is_one]] + 1)
        pairs = pairs[pairs % n > 0]
        return keys, ends, lengths, np.searchsorted(pairs // n, np.arange(len(keys) + 1)), pairs % n - 1

    @cached_property
    def window_heads(self) -> np.ndarray:
        """The first two words of each window, as pairs; of a window of one word that and 0."""
        first, second = _numbers(self.windows[0], self.window)[:, :2].T.astype(np.int64)
        return first * (len(self.vocabulary) + 1) + second

    @cached_property
    def heads(self) -> np.ndarray:
        """Sorted pairs of words that follow each other, and the words that are a text of their own, as pairs with 0."""
        base, first = len(self.vocabulary) + 1, self.ids[self.order].astype(np.int64)
        second = self.ids[self.order + 1]
        alone = self.starts[(self.ids[self.starts] > 0) & (self.ids[self.starts + 1] == 0)] if len(self.starts) else self.starts
        return np.union1d((first * base + second)[second > 0], self.ids[alone].astype(np.int64) * base)


def prepare(texts: Iterable[tuple[str | None, bytes | None]], window: int = WINDOW) -> Tests:
    """``texts``: (item id as a string, text). An item shorter than a window is one window; one without words is none."""
    vocabulary: dict[bytes, int] = {}
    parts, starts, items, at = [], [], [], 0
    for item, text in texts:
        words = words_of(text)
        if words:
            parts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in words), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
            starts.append(at)
            items.append(item)
            at += len(words) + 1
    ids = np.concatenate([*parts, np.zeros(window, np.int32)])
    names = sorted({x for x in items if x is not None})
    place = {x: i for i, x in enumerate(names)}
    return Tests(window, b" ".join(vocabulary), ids, np.array(starts, np.int64), np.array([place.get(x, -1) for x in items], np.int64), names, sorted_suffixes(ids))


def suffix_array(ids: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``ids`` where a verbatim match can begin, in the order of the suffixes there,
    and these suffixes to the depth of a window. Suffixes whose first two words don't follow each other in the benchmark
    match in one word at most, so the array leaves them out.
    """
    base = len(tests.vocabulary) + 1
    inside = np.flatnonzero(ids)
    first = ids[inside].astype(np.int64) * base
    at = inside[_among(first + ids[inside + 1], tests.heads) | _among(first, tests.heads)]  # ids ends in zeros
    keys = deep_keys(ids, at, tests.window)
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def search(texts: list[bytes | None], tests: Tests) -> list[tuple[int, np.ndarray, list[str], int]]:
    """For each text its number of words, hit spans (flat starts and ends, in words), items found and
    the length in words of the longest verbatim match."""
    get, out, at = tests.vocabulary.get, [], 0
    while at < len(texts):
        parts, total = [], 0
        while at < len(texts) and (not parts or total < SHARD_WORDS):
            words = words_of(texts[at])
            parts.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
            total += len(words) + 1
            at += 1
        out += _shard(parts, tests)
    return out


def _shard(parts: list[np.ndarray], tests: Tests) -> list:
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    ids = np.zeros(int(sizes.sum()) + len(parts) + tests.window, np.int32)
    for s, p in zip(starts, parts):
        ids[s : s + len(p)] = p
    where, keys = suffix_array(ids, tests)
    doc_of = lambda at: np.searchsorted(starts, at, "right") - 1
    longest = np.zeros(len(parts), np.int64)
    np.maximum.at(longest, doc_of(where), match_lengths(ids, where, keys, tests))
    windows, ends, lengths, first, items = tests.windows
    pairs = ids[where].astype(np.int64) * (len(tests.vocabulary) + 1)
    begun = np.flatnonzero(_among(tests.window_heads, np.union1d(pairs, pairs + ids[where + 1])))  # the others can't be here
    low, high = np.searchsorted(keys, windows[begun], "left"), np.searchsorted(keys, ends[begun], "right")
    there = high > low
    seen, low, counts = begun[there], low[there], (high - low)[there]
    window = np.repeat(seen, counts)
    rank = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    place = where[rank]
    doc = doc_of(place)
    out = [(int(n), np.zeros(0, np.int32), [], int(best)) for n, best in zip(sizes, longest)]
    order = np.argsort(doc, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
        d = int(doc[own[0]])
        at, which = place[own] - starts[d], window[own]
        found = np.unique(np.concatenate([items[first[w] : first[w + 1]] for w in np.unique(which)]))
        out[d] = (int(sizes[d]), merge(at, at + lengths[which]), [tests.names[i] for i in found], int(longest[d]))
    return out


def match_lengths(ids: np.ndarray, where: np.ndarray, keys: np.ndarray, tests: Tests) -> np.ndarray:
    """Of each suffix in the array how many words it shares with the benchmark suffix that is most like it: one of its
    neighbours among the sorted ones. Where a window agrees, the search goes on a window deeper within what does."""
    out, depth, rows = np.zeros(len(where), np.int64), 0, np.arange(len(where))
    low, high = np.searchsorted(tests.suffixes, keys, "left"), np.searchsorted(tests.suffixes, keys, "right")
    floor, ceiling = np.zeros(len(rows), np.int64), np.full(len(rows), len(tests.order))
    while len(rows):
        mine = _numbers(keys, tests.window)
        for near, there in ((low - 1, low > floor), (low, low < ceiling)):
            at = np.minimum(tests.order[np.where(there, near, 0)] + depth, len(tests.ids) - tests.window)
            same = (_numbers(deep_keys(tests.ids, at, tests.window), tests.window) == mine) & (mine > 0)
            shared = np.logical_and.accumulate(same, axis=1).sum(1)
            out[rows] = np.maximum(out[rows], np.where(there, depth + shared, 0))
        on = (high > low) & (mine[:, -1] > 0)
        rows, floor, ceiling = rows[on], low[on], high[on]
        depth += tests.window
        keys = deep_keys(ids, where[rows] + depth, tests.window)
        low, high = (_bisect(tests, keys, floor, ceiling, depth, right) for right in (False, True))
    return out


def _numbers(keys: np.ndarray, depth: int) -> np.ndarray:
    return np.frombuffer(keys.astype(f"S{4 * depth}").tobytes(), ">u4").reshape(len(keys), depth)


def _bisect(tests: Tests, keys: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, right: bool) -> np.ndarray:
    """Where each key belongs between its ``low`` and ``high`` among the suffixes, from their word ``depth`` on."""
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        there = deep_keys(tests.ids, tests.order[mid] + depth, tests.window)
        before = there <= keys[open_] if right else there < keys[open_]
        low[open_[before]] = mid[before] + 1
        high[open_[~before]] = mid[~before]
    return low


def merge(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Union of spans, flat."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1]) if len(s) else np.zeros(0, bool)
    last = np.append(new[1:], True) if len(s) else new
    return np.stack([s[new], e[last]], 1).astype(np.int32).ravel()


def _first_pass(tests):
    @F.pandas_udf("n_words long, spans array<int>, items array<string>, longest long")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [(n, s.tolist(), x, best) for n, s, x, best in search(texts.tolist(), tests.value)]
        return pd.DataFrame(rows, columns=["n_words", "spans", "items", "longest"])

    return of


def _next_pass(tests, text_col: str):
    """A later block of the benchmark: what it finds joins what the column __m already has."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("__m")
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            rows = []
            for old, (_, spans, items, longest) in zip(batch.column(at).to_pylist(), search(texts, tests.value)):
                both = np.concatenate([np.array(old["spans"], np.int32), spans])
                rows.append(old | {"spans": merge(both[::2], both[1::2]).tolist(), "items": sorted({*old["items"], *items}), "longest": max(old["longest"], longest)})
            yield batch.set_column(at, batch.schema.field(at), pa.array(rows, batch.schema.field(at).type))

    return run


@sheltering
def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words, n_hit, spans, items, longest``, which replace columns of those names.

    ``spans``: hit words as flat [start, end, ...]; ``items``: ids (as strings, sorted) whose windows occur;
    ``longest``: words of the longest verbatim match with any item, also where it is shorter than a window (0: less than two
    words, and no item of one word).

    The benchmark is the query set: it goes to all tasks in blocks of a checked size, one narrow pass
    over the documents a block, so no document is shuffled. Each task builds suffix arrays over its
    documents and binary-searches every benchmark window in them. A block holds whole items: more than ``block_bytes``
    only if its last one does.

    Null and empty texts have no words and no hits. Null and empty items have no window; an item with a
    null id hits words but is not listed. Repeated ids are one item in the list. Empty tables are fine.
    """
    spark = docs.sparkSession
    item = F.col(item_col).cast("string").alias("item")
    wanted = benchmark.select(item, F.col(item_text).cast("binary").alias("text")).filter(F.octet_length("text") > 0).distinct()
    wanted = wanted.withColumn("size", F.octet_length("text") + 64)
    total = wanted.agg(F.sum("size")).first()[0] or 0
    buckets = 16 * max(1, -(-total // block_bytes))
    bucket = F.pmod(F.xxhash64("item", "text"), F.lit(buckets))
    sizes = {x.b: x.n for x in wanted.groupBy(bucket.alias("b")).agg(F.sum("size").alias("n")).collect()}
    out = without(docs, *OWN)
    kept = out.columns
    for i, (low, high) in enumerate(_blocks([sizes.get(b, 0) for b in range(buckets)], block_bytes)):
        part = wanted.filter(bucket.between(low, high)).select("item", "text")
        tests = spark.sparkContext.broadcast(prepare(((x.item, bytes(x.text)) for x in part.toLocalIterator()), window))
        if i == 0:
            out = out.withColumn("__m", _first_pass(tests)(F.col(text_col).cast("binary")))
        else:
            out = out.mapInArrow(_next_pass(tests, text_col), out.schema)
    n_hit = F.expr("aggregate(sequence(0, size(__m.spans) div 2 - 1), 0L, (n, i) -> n + __m.spans[2 * i + 1] - __m.spans[2 * i])")
    hits = F.when(F.size("__m.spans") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return out.select(*kept, "__m.n_words", hits.alias("n_hit"), "__m.spans", "__m.items", "__m.longest")


def _blocks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """First and last bucket of each block: as many as fit."""
    out, held = [[0, 0]], 0
    for b, n in enumerate(sizes):
        if held + n > most and held:
            out.append([b, b])
            held = 0
        out[-1][1] = b
        held += n
    return [tuple(x) for x in out]


@sheltering_also(*OWN)
def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """``docs`` less those with a hit. Documents without words stay, and all of them with an empty benchmark; repeated rows
    stay or go together. Columns of any name stay; an empty table gives an empty result."""
    return find_matches(docs.select(*docs.columns), benchmark, text_col, **more).filter("n_hit = 0").select(*docs.columns)


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_matches(docs, table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed, (F.col("n_hit") > 0).alias("contaminated"))


SQL9 = r"""
with d as (select doc_id, row_number() over () as rid,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bn as (select item_id, w, least(10, len(w)) as n from b where len(w) > 0),
bp as (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from bn),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as k from bp),
lens as (select distinct n from bw),
dp as (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n),
hit as (select rid, i, dp.n as n, item_id from dp join bw on dp.n = bw.n and array_to_string(dp.w[i:i + dp.n - 1], ' ') = bw.k),
pos as (select rid, unnest(range(i, i + n)) as p from (select distinct rid, i, n from hit)),
nh as (select rid, count(distinct p) as n_hit from pos group by rid),
it as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as l
       from (select distinct rid, cast(item_id as varchar) as item from hit where item_id is not null) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join nh using (rid) left join it using (rid)
"""
