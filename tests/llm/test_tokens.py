import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairwright.llm.tokens import VOCABULARY, Counter, count_tokens

PATH = public_tokenizers.path(VOCABULARY)
ODD = [
    None, "", " ", "\n\t", "Hello, world!", "it's WE'RE you'll 'stupid I'd've", "a<|endoftext|>b<|startoftext|>", "<|endoftext|", "<|ENDOFTEXT|>",
    "ΟΔΟΣ ΣΑΣ Σ", "İstanbul ß ẞ ŉ", "é é Å", "½ ² 12345 ٣٤ Ⅷ", "日本語テキスト 中文", "a\x1cb\x1fc\x85d\xa0e f​g", "😀👩‍👩‍👧 ok!!!???", "x" * 3000, "#" * 500 + "é" * 400, "한국어 à́",
    "don't'tre 'S'T", "\x00\x01 null", "ﬁ ﬂ ①", "ǅ ǆ Ǆ",
]


def library():
    t = Tokenizer.from_file(PATH)
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


def test_same_counts_as_the_library():
    mine, theirs, r = Counter(PATH), library(), random.Random(2)
    alphabet = "aAbzZ 09.,'-stredvml\n\tñÉßüê½σΣ<|>日𝒳"
    made = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(4000)]
    for text in [*ODD, *made]:
        assert mine.count(text) == theirs(text), repr(text)


def test_every_low_code_point():
    mine, theirs = Counter(PATH), library()
    for c in [*range(0x20, 0x600), *range(0x1670, 0x1690), *range(0x1E00, 0x2200), *range(0x3000, 0x3100)]:
        text = f"a{chr(c)}b {chr(c)}1"
        assert mine.count(text) == theirs(text), hex(c)


def test_every_assigned_code_point():
    """Letters younger than Python's tables among them."""
    mine, theirs = Counter(PATH), Tokenizer.from_file(PATH)
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        want = [len(e.ids) for e in theirs.encode_batch(part, add_special_tokens=False)]
        assert [(t, mine.count(t)) for t in part] == list(zip(part, want))


def test_files_of_other_kinds_are_an_error(spark):
    for name in ("byte_bpe_50k.json",):
        with pytest.raises(ValueError, match="another kind"):
            count_tokens(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path(name))


def test_cache_is_bounded_and_whole_tokens_are_proven(monkeypatch):
    monkeypatch.setattr("pairwright.llm.tokens.CACHE", 5)
    mine, theirs = Counter(PATH), library()
    text = " ".join(f"zq{i}xv" for i in range(50))
    assert mine.count(text) == theirs(text) and len(mine) <= len(mine.whole) + 6
    assert mine.whole["the"] == 1 and all(v == 1 for v in mine.whole.values())


def test_frame(spark):
    rows = [(i if i else None, t, 7, "x") for i, t in enumerate(ODD + ODD[:3])]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens int, other string")
    got, theirs = count_tokens(df, PATH, 10), library()
    assert got.columns == ["doc_id", "text", "other", "n_bytes", "n_tokens", "over_limit"]
    for x in got.collect():
        assert (x.n_bytes, x.n_tokens, x.over_limit) == (len((x.text or "").encode()), theirs(x.text), theirs(x.text) > 10)
    assert got.count() == len(rows)
    assert count_tokens(df.filter(F.lit(False)), PATH).count() == 0
