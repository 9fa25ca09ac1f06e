"""Personal data in whole texts: four patterns, and what a character tagger adds to them.

The patterns' spans are the labels that the tagger learns from, in their own surroundings
and written in other ways (a phone number without its plus, a card with other separators, an
address with accented letters). Its spans count where no pattern has one and a check of the
kind holds: so many digits, a Luhn sum, an address's parts, four numbers of at most 255.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.char_tagger import KINDS, Tagger, TaggerParams, classes, spans_of
from panelforge.llm.common import arrow_map, bounded_batches, fresh

Span = tuple[str, int, int]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match starts where a run of digits does: were one to start inside, so would one at the start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: An address whose parts aren't joined by plain dots: one separator, three times.
_OTHER_IP = re.compile(r"([0-9]{1,3})( ?[\[({] ?(?:\.|dot) ?[\])}] ?| ?\. ?| dot |-)([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})", re.I)
_GATE = re.compile(r"[0-9@]")


@dataclass(frozen=True)
class PiiParams:
    sample: int = 1500  #: texts that the tagger learns from, at most
    windows: int = 4000  #: training windows, at most
    margin: int = 24  #: characters around a digit or @ in a training window; decoding reads whole texts
    tagger: TaggerParams = field(default_factory=TaggerParams)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def pattern_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed; time grows with the text's length alone."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)  # no local part crosses this @
        at = text.find("@", max(free, at + 1))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = digits_of(m[0]) if m.end() - m.start() <= 37 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def regions(text: str, margin: int) -> list[tuple[int, int]]:
    """Stretches to learn from, around each digit or @."""
    out: list[tuple[int, int]] = []
    for m in re.finditer(r"[0-9@]+", text):
        lo, hi = max(0, m.start() - margin), min(len(text), m.end() + margin)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def holds(kind: str, s: str) -> bool:
    """Whether a stretch that no pattern has is of a kind all the same."""
    d = digits_of(s)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\W\d_]{2,}", s))
    if kind == "card":
        return 14 <= len(d) <= 19 and bool(re.fullmatch(r"[0-9][0-9 ./_-]*[0-9]", s)) and luhn(d)
    if kind == "phone":
        return 10 <= len(d) <= 15 and len(re.findall(r"[0-9]+", s)) >= 3 and bool(re.fullmatch(r"\(?[0-9][0-9 ().-]*[0-9]", s))
    if kind == "ip":
        m = _OTHER_IP.fullmatch(s)
        return m is not None and all(int(m[i]) <= 255 for i in (1, 3, 4, 5))
    return False


def added_spans(text: str, base: list[Span], found: list[Span]) -> list[Span]:
    out: list[Span] = []
    for kind, start, end in found:
        while start < end and text[start].isspace():
            start += 1
        while end > start and (text[end - 1].isspace() or text[end - 1] in ",;:"):
            end -= 1
        outside = all(end <= s or start >= e for _, s, e in [*base, *out])
        apart = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
        if outside and apart and holds(kind, text[start:end]):
            out.append((kind, start, end))
    return out


def rewritten(kind: str, s: str, rng: np.random.Generator) -> str:
    """The same datum as others might write it."""
    way = int(rng.integers(0, 3))
    d = digits_of(s)
    if kind == "phone":
        body = d[-10:]
        return (f"({body[:3]}) {body[3:6]}-{body[6:]}", f"{body[:3]}.{body[3:6]}.{body[6:]}", f"{body[:3]}-{body[3:6]}-{body[6:]}")[way]
    if kind == "card":
        return ("-", " ", ".")[way].join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == "email":
        return (s.upper(), "é" + s, s.replace(".", "_", 1) if s.index(".") < s.index("@") else s)[way]
    return ("[.]", " . ", "-")[way].join(s.split("."))


def invented(kind: str, rng: np.random.Generator) -> str:
    word = lambda n: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, n))))
    num = lambda n: "".join(str(int(c)) for c in rng.integers(0, 10, n))
    if kind == "email":
        return f"{word(9)}{('.', '_', '')[int(rng.integers(0, 3))]}{num(2)}@{word(8)}.{word(8)}.com"
    if kind == "ip":
        return ".".join(str(int(x)) for x in rng.integers(0, 256, 4))
    if kind == "phone":
        return f"+{int(rng.integers(1, 99))} ({num(3)}) {num(3)}-{num(4)}"
    body = "4" + num(14)
    return body + next(c for c in "0123456789" if luhn(body + c))


def training_windows(texts: list[str], p: PiiParams) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and tags: spans as found, rewritten, invented, and digits that are none."""
    rng, n = np.random.default_rng(p.tagger.seed), p.tagger.window
    samples: list[tuple[str, list[Span]]] = []
    for text in texts:
        base = pattern_spans(text)
        for lo, hi in regions(text, p.margin):
            inside = [s for s in base if s[1] < hi and s[2] > lo]
            samples.append((text[lo:hi], [(k, max(s, lo) - lo, min(e, hi) - lo) for k, s, e in inside]))
            for k, s, e in inside:
                before, after, new = text[lo:s], text[e:hi], rewritten(k, text[s:e], rng)
                samples.append((before + new + after, [(k, len(before), len(before) + len(new))]))
    for t in texts:  # and words as they stand anywhere
        cut = int(rng.integers(0, max(1, len(t) - n)))
        samples.append((t[cut : cut + n], [(k, max(s - cut, 0), min(e - cut, n)) for k, s, e in pattern_spans(t) if s < cut + n and e > cut]))
    plain = [t for t in texts if len(t) >= 2 * p.margin] or ["a few words of no account stand here, and then some more of them."]
    for i in range(p.windows // 4):
        t, kind = plain[int(rng.integers(0, len(plain)))], KINDS[i % len(KINDS)]
        cut = int(rng.integers(0, len(t) - p.margin))
        before, after = t[max(0, cut - p.margin) : cut] + " ", " " + t[cut : cut + p.margin]
        new = invented(kind, rng)
        new = rewritten(kind, new, rng) if rng.random() < 0.5 else new
        samples.append((before + new + after, [(kind, len(before), len(before) + len(new))]))
    keep = rng.permutation(len(samples))[: p.windows]
    x, y = np.zeros((len(keep), n), np.uint8), np.zeros((len(keep), n), np.uint8)
    for row, i in enumerate(keep):
        text, spans = samples[i]
        tag = np.zeros(len(text), np.uint8)
        for kind, s, e in spans:
            tag[s:e] = 2 + 2 * KINDS.index(kind)
            tag[s] = 1 + 2 * KINDS.index(kind)
        shift = int(rng.integers(0, max(1, len(text) - n + 1)))
        piece = classes(text)[shift : shift + n]
        x[row, : len(piece)], y[row, : len(piece)] = piece, tag[shift : shift + n]
    return x, y


def fit(texts: list[str], p: PiiParams = PiiParams()) -> Tagger:
    tagger = Tagger(p.tagger)
    tagger.fit(*training_windows(texts, p))
    return tagger


def find_all(texts: list[str], tagger: Tagger, slab: int = 2_000_000) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans, of each text; the tagger reads every character, some texts at a time."""
    out: list[tuple[list[Span], list[Span]]] = []
    order = lambda s: (s[1], KINDS.index(s[0]))
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= slab:
            size, stop = size + len(texts[stop]), stop + 1
        some = texts[at:stop]
        for t, found in zip(some, tagger.decode([classes(t) for t in some]), strict=True):
            base = pattern_spans(t) if _GATE.search(t) else []
            out.append((base, sorted(base + added_spans(t, base, [(KINDS[k], s, e) for k, s, e in found]), key=order)))
        at = stop
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Each stretch that spans cover becomes the name of its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def fitted(docs: DataFrame, p: PiiParams = PiiParams()) -> Tagger:
    """A tagger from texts whose ids have the smallest hashes: ids are chosen first, so that few texts travel."""
    order = F.xxhash64("doc_id", F.lit(23))
    rows = docs.filter("text is not null and doc_id is not null")
    ids = rows.select("doc_id").orderBy(order, "doc_id").limit(p.sample)
    chosen = rows.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")  # sample ids
    return fit([r["text"] for r in chosen.orderBy(order, "doc_id", F.xxhash64("text")).limit(p.sample).collect()], p)


def find_personal_data(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, all spans, and the text without them.

    A null or empty text has none (the digest is that of an empty string). Each row is read
    alone, so repeated rows agree; an empty table gives no rows; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    tagger = fitted(docs, params)

    def find(batches):
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            got = find_all(texts, tagger)
            yield {
                "doc_id": batch["doc_id"],
                **{f"n_{k}": [sum(s[0] == k for s in b) for b, _ in got] for k in KINDS},
                "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in got],
                "spans": [joined(a) for _, a in got],
                "redacted": [None if t is None else redacted(t, a) for t, (_, a) in zip(batch["text"], got, strict=True)],
            }

    return arrow_map(docs.select("doc_id", "text"), find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")


def redact_documents(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """docs with personal data replaced in text, and n_chars, if there, of the new text.

    A null text stays null, an empty one empty; each row is read alone, so repeated rows agree;
    texts may be of any length; columns of any name stay; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    tagger = fitted(docs, params)

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        texts = [t or "" for t in text]
        return pd.Series([None if t is None else redacted(t, a) for t, (_, a) in zip(text, find_all(texts, tagger), strict=True)], dtype=object)

    name = fresh(docs, "clean")
    new: Column = F.col(name)
    named = [new.alias("text") if c == "text" else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return docs.withColumn(name, clean("text")).select(*named)
