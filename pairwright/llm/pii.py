"""Personal data: candidate spans, boosted trees over them, calibrated thresholds."""

from __future__ import annotations

import random
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.frames import sheltering, table, without

KINDS = ("email", "ip", "card", "phone")
OWN = ["n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"]
SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, found array<struct<kind:string,start:int,end:int,probability:double>>"
#: Of the candidates that a threshold selects in the calibration set, so many must be right.
PRECISION = 0.995
SEED = 11

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a dotted domain, from each @ outwards: linear in any text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans that always count, by kind and start, in code points."""
    out = [("email", *x) for x in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# Candidates: generous patterns, whose spans may overlap each other.
_CHAIN = re.compile(r"[0-9]++(?:[ ()./_-]{1,2}[0-9]++)*+")
_GROUP = re.compile("[0-9]++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}(?![0-9])")
_HIDDEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}| at |@) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]{2,}+)++", re.I
)
_HINT = re.compile(r"\[at\]|\(at\)|\{at\}| dot |@ | @|\[dot\]|\(dot\)", re.I)


def _proposed(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Candidates, each with the words before it."""
    if _HINT.search(text):
        yield from (("email", *m.span(), _lead(text, m.start())) for m in _HIDDEN.finditer(text))
    if _DIGIT.search(text):
        yield from (("ip", *m.span(), _lead(text, m.start())) for m in _DOTTED.finditer(text))
        for m in _CHAIN.finditer(text):
            yield from _runs(text, *m.span())


def _lead(text: str, start: int) -> str:
    """The last words before a place; numbers that stand in between don't count."""
    return text[max(0, start - 4096) : start].rstrip("0123456789 ()./_+-")[-28:]


def _runs(text: str, start: int, end: int) -> Iterator[tuple[str, int, int, str]]:
    """Every run of neighbouring groups in a chain with as many digits as a phone or card: at most 19 runs a group."""
    groups, lead = deque(), _lead(text, start)
    for m in _GROUP.finditer(text, start, end):
        groups.append(m.span())
        while len(groups) > 19:
            groups.popleft()
        n = 0
        for s, e in reversed(groups):
            n += e - s
            if n > 19:
                break
            s -= s > 0 and text[s - 1] in "+("
            if 7 <= n <= 15:
                yield "phone", s, m.end(), lead
            if 13 <= n <= 19:
                yield "card", s, m.end(), lead


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [x[:3] for x in _proposed(text)]


_NEAR = {
    "email": re.compile(r"mail|contact|write|reach|kontakt|courriel|correo", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|login|client|adresse|direcc", re.I),
    "card": re.compile(r"card|visa|master|credit|amex|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|\btel|fax|mobile|cell|dial|whatsapp|anruf|appel|llam|handy", re.I),
}
_OTHER = re.compile(r"order|invoice|version|isbn|serial|ref|id|section|chapter|page|date|price|build|ticket|no\.|#|\$|€", re.I)


@lru_cache(4096)
def _context(words: str) -> tuple[tuple[bool, ...], bool]:
    """Of the words before some numbers: which kinds they speak of, and whether of other things."""
    return tuple(bool(_NEAR[k].search(words)) for k in KINDS), bool(_OTHER.search(words))


# The group of digits next to a candidate and what stands between.
_LEFT = re.compile(r"([0-9]+)([ ()./_-]{1,2})$")
_RIGHT = re.compile(r"([ ()./_-]{1,2})([0-9]+)")


def features(text: str, kind: str, start: int, end: int, lead: str | None = None) -> tuple[float, ...]:
    """Format and context of a candidate."""
    return _features(kind, text[start:end], text[max(0, start - 28) : start], text[end : end + 12], _lead(text, start) if lead is None else lead)


@lru_cache(1 << 14)
def _features(kind: str, span: str, before: str, after: str, words: str) -> tuple[float, ...]:
    digits, groups = _digits(span), re.findall("[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    marks = re.sub("[A-Za-z0-9]", "", span)
    left, right = _LEFT.search(before), _RIGHT.match(after)
    own = KINDS.index(kind)
    near, other = _context(words)
    return (
        own,
        len(span),
        len(digits),
        len(groups),
        max(sizes),
        min(sizes),
        sizes[0],
        sizes[-1],
        marks.count(" "),
        marks.count("."),
        marks.count("-"),
        marks.count("(") + marks.count(")"),
        marks.count("/") + marks.count("_"),
        len(set(marks)),
        span.startswith("+"),
        span.startswith("(") and ")" in span[:6],
        bool(digits) and luhn(digits),
        bool(digits) and len(set(digits)) / len(digits),
        int(digits[:1] or 0),
        len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        any(len(g) > 1 and g[0] == "0" for g in groups),
        bool(re.search(r"[\[({](?:at|dot|\.)", span, re.I)),
        " at " in span.lower(),
        bool(re.search(r"(?:com|org|net|edu|info|io|de|fr|es)$", span, re.I)),
        near[own],
        any(near[:own]) or any(near[own + 1 :]),
        other,
        before[-1:].isalnum() or before[-1:] in (".", "-", "/", "_", "$", "€"),
        after[:1].isalnum() or after[:2].rstrip().endswith(("%", "/", "_")),
        len(left[1]) if left else 0,
        bool(left) and left[2] in (" ", "  "),
        bool(left) and before[: left.start()].endswith("+"),
        len(right[2]) if right else 0,
        bool(right) and right[1] in (" ", "  "),
    )


@dataclass
class Trees:
    """Gradient boosting of shallow regression trees on the log loss. Nodes: feature, border, left, right, value."""

    trees: list[list[tuple]]
    start: float
    rate: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for nodes in self.trees:
            at = np.zeros(len(x), int)
            table_ = np.array([n[:4] for n in nodes], float)
            values = np.array([n[4] for n in nodes])
            for _ in range(8):
                split = table_[at, 0] >= 0
                if not split.any():
                    break
                f, b = table_[at, 0].astype(int), table_[at, 1]
                left = x[np.arange(len(x)), np.maximum(f, 0)] <= b
                at = np.where(split, np.where(left, table_[at, 2], table_[at, 3]).astype(int), at)
            out += self.rate * values[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: int = 8) -> Trees:
    mean = y.mean()
    model = Trees([], float(np.log(mean / (1 - mean))), rate)
    raw = np.full(len(x), model.start)
    borders = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower")) for c in x.T]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        slope, bend, nodes = y - p, p * (1 - p), []

        def grow(rows, level):
            at = len(nodes)
            g, h = slope[rows].sum(), bend[rows].sum()
            nodes.append((-1, 0, 0, 0, g / (h + 1)))
            best = (1e-3, None)
            for f in range(x.shape[1]) if level else ():
                below = x[rows, f][:, None] <= borders[f]
                n, gl, hl = below.sum(0), slope[rows] @ below, bend[rows] @ below
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain = np.where((n >= least) & (len(rows) - n >= least), gain, 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, borders[f][gain.argmax()]))
            if best[1]:
                f, b = best[1]
                low = x[rows, f] <= b
                left = grow(rows[low], level - 1)
                nodes[at] = (f, b, left, grow(rows[~low], level - 1), 0.0)
            return at

        grow(np.arange(len(x)), depth)
        model.trees.append(nodes)
        raw = raw + rate * (Trees([nodes], 0.0, 1.0).raw(x))
    return model


def examples(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """Invented candidates: (text, kind, start, end, is personal data). Formats and contexts come from the lists below."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    words = ["tion", "erel", "anst", "ouv", "que", "der", "lich", "mente", "las", "the", "of", "and", "reha", "blen"]
    word = lambda: "".join(r.choice(words) for _ in range(r.randint(1, 3)))
    say = lambda: " ".join(word() for _ in range(r.randint(0, 5)))
    cue = {
        "email": ["email", "mail me", "contact", "write to", "reach me"],
        "ip": ["ip", "from host", "server", "client addr", "login from"],
        "card": ["card", "visa", "credit card", "paid with card", "mastercard"],
        "phone": ["call", "phone", "tel", "fax", "mobile", "cell"],
    }
    other = ["order", "invoice", "version", "isbn", "serial", "ref", "section", "page", "date", "price", "build", "ticket", ""]

    def card():
        body = r.choice("3456") + digits(r.choice([14, 12, 13]))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def true(kind):
        if kind == "email":
            at, dot = r.choice([("[at]", "[dot]"), (" [at] ", "."), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), ("{at}", "."), (" @ ", ".")])
            return f"{word()}{r.choice(['', '.', '_'])}{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'info'])}"
        if kind == "ip":
            return r.choice(["[.]", "(.)", " . ", "."]).join(str(r.randint(1, 255)) for _ in range(4))
        if kind == "card":
            c = card()
            s = r.choice([".", "_", "/", "  ", " - "][:3])
            return s.join(c[i : i + 4] for i in range(0, len(c), 4)) if r.random() < 0.6 else c
        return r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(3)} {digits(4)}", f"0{digits(3)}/{digits(6)}", f"00{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"])  # the base pattern has the last one too, but for where a number follows

    def false(kind):
        if kind == "email":
            return r.choice([f"{word()} at {word()} dot {word()}", f"{word()} @ {word()}.{word()}", f"{word()} at {word()}.{word()}", f"{digits(2)} @ {digits(1)}.{digits(2)}"])
        if kind == "ip":
            return r.choice([".", " . "]).join([str(r.randint(0, 20)), str(r.randint(0, 30)), str(r.randint(0, 999)), str(r.choice([r.randint(256, 999), r.randint(0, 9)]))])
        if kind == "card":
            d = digits(r.choice([13, 14, 16, 16, 16, 17, 19]))
            while luhn(d):
                d = digits(len(d))
            return d if r.random() < 0.6 else r.choice(["-", " ", ".", "/"]).join(d[i : i + 4] for i in range(0, len(d), 4))
        return r.choice([digits(r.randint(7, 15)), f"20{digits(2)}-{digits(2)}-{digits(2)} {digits(2)}", f"{digits(2)}.{digits(2)}.20{digits(2)}", f"{digits(4)}/{digits(4)}", f"{digits(1)}.{digits(3)}.{digits(3)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(4)}-{digits(4)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(3)} {digits(3)}", " ".join(digits(r.randint(1, 3)) for _ in range(5))])

    def beside(kind):
        """A neighbour: another number of the kind if that is personal data, or a date, a count or a time."""
        if kind and r.random() < 0.6:
            return kind, true(kind)
        return "", r.choice([".".join(str(r.randint(1, 255)) for _ in range(4)), f"{r.randint(1, 12):02}/{r.randint(1, 28):02}/20{digits(2)}", f"20{digits(2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{digits(2)}", digits(r.randint(1, 4))])

    out = []
    while len(out) < n:
        kind, good = r.choice(KINDS), r.random() < 0.5
        span = true(kind) if good else false(kind)
        if kind == "phone" and good and span[0] == "+":
            lead = r.choice([*cue["phone"], *[""] * 6])
        elif kind in ("ip", "phone", "card") and good:
            lead = r.choice(cue[kind])
        elif kind == "email" and good:
            lead = r.choice([*cue[kind], "", ""])
        else:
            lead = r.choice([r.choice(other), "", *(cue[r.choice(KINDS)] if r.random() < 0.15 else [])])
        head = f"{say()} {lead}{r.choice([' ', ': ', ' = ', ' is '])}" if lead else f"{say()} "
        pieces = [(kind if good else "", span)]
        if kind in ("card", "phone"):  # numbers may stand next to each other
            for side in (0, 1):
                while r.random() < 0.35:
                    pieces.insert(len(pieces) * side, beside(kind if good else ""))
        real, text = {}, head
        for k, piece in pieces:
            if k:
                real[k, len(text), len(text) + len(piece)] = True
            text += piece + r.choice([" ", " ", " ", "  "])
        text, last = text.rstrip(" "), len(text.rstrip(" "))
        text += f"{r.choice(['', '.', ',', ' '])} {say()}"
        base = base_spans(text)  # what overlaps these is never asked
        inside = [c for c in candidates(text) if c[0] == kind and c[1] < last and len(head) < c[2] and not any(s < c[2] and c[1] < e for _, s, e in base)]
        if kind in ("email", "ip"):
            out += [(text, *c, int(good)) for c in inside[:1]]
        else:
            exact, parts = [c for c in inside if c in real], [c for c in inside if c not in real]
            out += [(text, *c, 1) for c in r.sample(exact, min(2, len(exact)))]
            out += [(text, *c, 0) for c in r.sample(parts, min(1 + (not good), len(parts)))]
    return out[:n]


@dataclass
class Model:
    trees: Trees
    slope: float
    shift: float
    thresholds: dict[str, float]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.raw(x) + self.shift)))


@lru_cache(2)
def trained(seed: int = SEED, n: int = 3000, precision: float = PRECISION) -> Model:
    """Trees from invented candidates; their probabilities calibrated, and thresholds chosen, on others."""
    x, y = _matrix(examples(n, seed))
    trees = boost(x, y)
    cx, cy = _matrix(examples(n, seed + 1))
    raw, slope, shift = trees.raw(cx), 1.0, 0.0
    for _ in range(200):  # Platt's scaling
        p = 1 / (1 + np.exp(-(slope * raw + shift)))
        slope -= 0.5 * float(((p - cy) * raw).mean()) / float((raw**2 * p * (1 - p)).mean() + 1e-3)
        shift -= 0.5 * float((p - cy).mean()) / float((p * (1 - p)).mean() + 1e-3)
    p = 1 / (1 + np.exp(-(slope * raw + shift)))
    thresholds = {}
    for i, kind in enumerate(KINDS):
        own = cx[:, 0] == i
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(cy[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        thresholds[kind] = max(0.9, float(p[own][order][good[-1]])) if len(good) else 1.1
    return Model(trees, slope, shift, thresholds)


def _matrix(rows) -> tuple[np.ndarray, np.ndarray]:
    return np.array([features(*x[:4]) for x in rows], float), np.array([x[4] for x in rows], float)


def find(text: str | None, model: Model) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and those that the model adds: (kind, start, end, probability). Added spans
    overlap neither base spans nor each other; of overlapping ones the likelier counts.

    The work is linear in the text: a digit group ends at most 19 candidates, and whether a candidate is clear of
    the spans so far is a look at its own characters."""
    if not text:
        return [], []
    base = base_spans(text)
    taken = bytearray(len(text))
    for _, s, e in base:
        taken[s:e] = b"\1" * (e - s)
    clear = lambda s, e: taken.find(1, s, e) < 0
    rest, likely = (c for c in _proposed(text) if clear(*c[1:3])), []
    while part := list(islice(rest, 4096)):  # bounds the memory that a text full of digits takes
        rows, at = np.unique(np.array([features(text, *c) for c in part], float), axis=0, return_inverse=True)
        p = model.probabilities(rows)[at]
        likely += [(q, c[:3]) for q, c in zip(p.tolist(), part) if q >= model.thresholds[c[0]]]
    added = []
    for q, (kind, s, e) in sorted(likely, key=lambda x: (-x[0], x[1][1], x[1][0])):
        if clear(s, e):
            added.append((kind, s, e, q))
            taken[s:e] = b"\1" * (e - s)
    return base, added


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def pii_columns(text: Column, model: Model, spark: SparkSession) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(SCHEMA)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, added = find(text, shared.value)
            count = [sum(k == kind for k, *_ in base) for kind in KINDS]
            everything = [(*b, 1.0) for b in base] + added
            rows.append((*count, _joined(base), _joined([x[:3] for x in everything]), [{"kind": k, "start": s, "end": e, "probability": q} for k, s, e, q in sorted(everything, key=lambda x: x[1])]))
        return pd.DataFrame(rows, columns=[*OWN, "found"])

    return of(text)


@sheltering
def find_pii(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with ``n_email, n_ip, n_card, n_phone`` (base spans), ``base_spans, spans`` (kind:start:end, by
    kind and start, in code points) and ``found`` (all spans in the order of the text, with probabilities).

    These replace columns of their names; all others stay. Null and empty texts have no spans. A narrow pass over whole
    texts; the model is small and fixed, so equal texts have equal spans wherever they are, and repeated rows the same. Of
    equally likely overlapping candidates the first counts. An empty table gives an empty result.
    """
    rest = without(docs, *OWN, "found")
    own = rest.withColumn("__pii", pii_columns(F.col(text_col), model or trained(), docs.sparkSession))
    return own.select(*rest.columns, "__pii.*")


def redact(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in brackets. Spans that overlap become one, named after the first.
    Null texts stay null and empty ones empty; ids are not read, repeated rows stay, other columns are as they were, and an
    empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redacted(t, shared.value))

    return docs.withColumn(text_col, of(F.col(text_col)))


def redacted(text: str, model: Model) -> str:
    base, added = find(text, model)
    out, at = [], 0
    for kind, s, e in sorted([*base, *(x[:3] for x in added)], key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op6_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
