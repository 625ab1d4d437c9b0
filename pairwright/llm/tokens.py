"""Token counts with a whole-token shortcut."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.frames import table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: A worker forgets its merged words beyond so many.
CACHE = 400_000
#: White space as Unicode has it; Python's own classes also count \x1c-\x1f.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Below this code point the letters and digits are listed for the faster of the two regular expression libraries.
PLAIN = 0x250
#: Capital letters that are younger than Python's tables, and what they are in lower case.
YOUNG = {"\ua7cb": "\u0264", "\ua7dc": "\u019b"}

#: The normaliser, the splitting pattern and the model of the one kind of tokenizer file that is understood here.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SUFFIX = "</w>"


def check_kind(path: str) -> None:
    """ValueError unless the file is of that kind: any other would be counted wrongly without a sign."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    normalizer, splitter, model = (told.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = splitter.get("pretokenizers") or [{}, {}]
    split, level = steps[0], steps[-1]
    fits = [
        normalizer.get("normalizers") == NORMALIZERS,
        len(steps) == 2 and split.get("type") == "Split" and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed" and split.get("invert"),
        level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex"),
        model.get("type") == "BPE" and model.get("end_of_word_suffix") == SUFFIX and not model.get("continuing_subword_prefix") and not model.get("dropout"),
        all(t.get("special") and not (t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in told.get("added_tokens", [])),
    ]
    if not all(fits):
        raise ValueError(f"{path} is a tokenizer of another kind than this counter knows")


def byte_alphabet() -> dict[int, int]:
    """Byte (as a Latin-1 character) to the printable character that byte-level vocabularies use for it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class Counter(dict):
    """Tokens of a pre-token. It starts with the whole tokens; the others are merged when first met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        check_kind(path)
        self.library = Tokenizer.from_file(path)
        self.bytes = byte_alphabet()
        self.whole = prove_whole_tokens(self.library, self.bytes)
        super().__init__(self.whole)
        plain = [chr(c) for c in range(PLAIN)]
        letters = "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == "L")
        digits = "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == "N")
        contractions = "'s|'t|'re|'ve|'m|'ll|'d"
        self.plain = re.compile(f"{contractions}|[{letters}]+|[{digits}]|[^{SPACE}{letters}{digits}]+").findall
        self.wide = regex.compile(rf"{contractions}|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+").findall
        self.is_plain = re.compile(f"[^\x00-{chr(PLAIN - 1)}]").search
        specials = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE + len(self.whole):
            self.clear()
            self.update(self.whole)
        n = len(self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.bytes)))
        if len(piece) <= 64:  # junk of any length is counted, but not remembered
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.specials.split(text) if self.specials else [text]
        return len(parts) - 1 + sum(map(self.part, parts))

    def part(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            for capital, small in YOUNG.items():
                text = text.replace(capital, small)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        pieces = self.wide(text) if self.is_plain(text) else self.plain(text)
        return sum(map(self.__getitem__, pieces))


def prove_whole_tokens(library, alphabet: dict[int, int]) -> dict[str, int]:
    """Vocabulary strings that, as a text of their own, the library encodes as exactly that one token.

    Encoding works on each pre-token by itself, so such a string counts as one token wherever it is
    a pre-token. The others (no word end, several pre-tokens, unreachable by merges) are left out.
    """
    back = {chr(v): k for k, v in alphabet.items()}
    strings, ids = [], []
    for token, i in library.get_vocab(with_added_tokens=False).items():
        name = token.removesuffix(SUFFIX)
        try:
            strings.append(bytes(back[c] for c in name).decode())
            ids.append(i)
        except (KeyError, UnicodeDecodeError):
            continue
    encoded = library.encode_batch(strings, add_special_tokens=False)
    return {s: 1 for s, i, e in zip(strings, ids, encoded) if e.ids == [i]}


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_count(text, path: str):
    """Column of token counts (long) of a text column; null counts as empty. ``path`` must be there on every executor."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        count = counter(path).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    return of(text)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes, n_tokens, over_limit``, which replace columns of those names.

    A narrow pass: no shuffle, one text at a time, and per worker a bounded table of words. A tokenizer file of another kind
    than :func:`check_kind` knows is an error, here as on the executors.
    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and rows with null ids stay as they are; an empty table gives an empty result.
    """
    check_kind(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = ["n_bytes", "n_tokens", "over_limit"]
    rest = [c for c in docs.columns if c.lower() not in own]
    counted = docs.select(*rest, F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
