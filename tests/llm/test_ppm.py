import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairwright.llm.ppm import ORDER, score_texts

SCHEMA = "doc_id long, text string, score string, chunk int"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Brute:
    """The same model from its definition: a dictionary of contexts, and one symbol at a time."""

    def __init__(self, rows):
        self.trie, self.words = defaultdict(Counter), Counter()
        for i, text in rows:
            if not held(i):
                self.words.update([*words(text), None])
                stream = [0xFE] * ORDER + list((text or "").encode().lower()) + [0xFF]
                for at in range(ORDER, len(stream)):
                    for order in range(ORDER + 1):
                        self.trie[tuple(stream[at - order : at])][stream[at]] += 1

    def symbol(self, context, x):
        out, excluded = 0.0, set()
        for order in range(ORDER, -1, -1):
            children = {k: n for k, n in self.trie.get(tuple(context[ORDER - order :]), {}).items() if k not in excluded}
            if not children:
                continue
            whole = sum(children.values()) + len(children)
            if x in children:
                return out + math.log10(children[x] / whole)
            out += math.log10(len(children) / whole)
            excluded |= set(children)
        return out - math.log10(255 - len(self.trie.get((), {})))

    def score(self, text):
        stream = [0xFE] * ORDER + list((text or "").encode().lower()) + [0xFF]
        return sum(self.symbol(stream[at - ORDER : at], stream[at]) for at in range(ORDER, len(stream)))

    def base(self, text):
        n, v, own = sum(self.words.values()), len(self.words), [*words(text), None]
        return len(own), sum(self.words[w] > 0 for w in own), n, sum(math.log10((self.words[w] + 1) / (n + v + 1)) for w in own)


def data():
    r = random.Random(6)
    parts = ["the", "of", "Tion", "ére", "a", "ing", "xÿ", "Qz"]
    say = lambda n: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))
    texts = [None, "", " \t", "a", "A a", "new 日本 words!", "tabs\tand\n\nline  ends \r\n"] + [say(r.randint(1, 60)) for _ in range(60)]
    return list(enumerate(texts)) + [(70, texts[20]), (70, texts[20]), (None, "null id"), (None, None), (9, "same id")]


@pytest.mark.parametrize("chunk_bytes,slice_bytes", [(1 << 20, 1 << 20), (1500, 40)])
def test_scores_equal_the_definition(spark, chunk_bytes, slice_bytes):
    rows, brute = data(), Brute(data())
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = score_texts(df, chunk_bytes=chunk_bytes, slice_bytes=slice_bytes).collect()
    key = lambda x: tuple(round(v, 6) if isinstance(v, float) else -1 if v is None else v for v in x)
    want = sorted(key((i, held(i), *brute.base(t), brute.score(t))) for i, t in rows)
    assert sorted(key((x.id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score)) for x in got) == want


def test_probabilities_sum_to_one():
    brute = Brute(data())
    for context in ([0xFE] * 5, list(b"the o"), list(b"\xe6\x97\xa5zz")):
        assert abs(sum(10 ** brute.symbol(context, x) for x in range(256) if x != 0xFE) - 1) < 1e-9


def test_nothing_to_learn_and_empty(spark):
    only = next(i for i in range(100) if held(i))
    x = score_texts(spark.createDataFrame([(only, "a b", "", 1)], SCHEMA)).first()
    assert (x.n_tokens, x.n_known, x.train_tokens) == (3, 0, 0) and abs(x.score + 4 * math.log10(255)) < 1e-9 and x.base_score == 0
    assert score_texts(spark.createDataFrame([(only, "a b", "", 1)], SCHEMA).filter(F.lit(False))).count() == 0


def test_better_than_the_base_on_held_out_rows(spark):
    got = score_texts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.98 * got[1] > got[0] * 1.5
