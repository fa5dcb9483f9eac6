"""Personal data in texts: mail and network addresses, payment cards and phone numbers, disguised ones too.

Plain identifiers are found as they stand. Disguises are undone by transducers that keep offsets: characters that look like others become
those, invisible ones go; runs of spelled digits become digits; "at" and "dot" in words or brackets become signs. Each
gives the new text and the segments it is made of, so that what is found there is mapped back, through all of them, to the characters
of the source. Only rows that can hold a disguise are rewritten: whole batches are searched for its words by hash first.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Words, buffers, shielded, steps, word_hash

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


# Fixed patterns, written so that no text takes more than a number of steps in proportion to its length.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OTHER = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost mail addresses: a domain after an @, and before it what can belong to a name, back to the last address or @."""
    since = 0
    for m in _DOMAIN.finditer(text):
        low = max(since, text.rfind("@", since, m.start()) + 1)
        name = _LOCAL.match(text[low : m.start()][::-1]).end()
        if name:
            yield Span("email", m.start() - name, m.end())
            since = m.end()
        else:
            since = m.start() + 1


def _addresses(text: str) -> Iterator[Span]:
    """Leftmost network addresses: of numbers joined by dots, four after four."""
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in own):
                yield Span("ip", at, end)
            at = end + 1


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    return (sum(map(int, digits[-1::-2])) + sum(int("0246813579"[int(d)]) for d in digits[-2::-2])) % 10 == 0


def identifiers(text: str) -> list[Span]:
    """All plain identifiers, by kind, then start; a match that fails its check is dropped and not tried again."""
    found = list(_emails(text)) if "@" in text else []
    found += _addresses(text)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _OTHER.sub("", m[0])) <= 19 and luhn(digits):
            found.append(Span("card", *m.span()))
    if "+" in text:
        found += [Span("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_OTHER.sub("", m[0])) <= 15]
    return found


class Rewritten:
    """A text made of another, and the segments that tell which characters each part came from."""

    def __init__(self, source: str, pattern: re.Pattern, output: Callable[[re.Match], str]):
        parts: list[str] = []
        #: Where each segment begins here and in the source, and how long it is there if it was rewritten, else -1.
        self.here, self.there, self.size = [], [], []
        at = done = 0
        for m in pattern.finditer(source):
            new = output(m)
            if new == m[0]:
                continue
            if m.start() > done:
                self._segment(at, done, -1)
                parts.append(source[done : m.start()])
                at += m.start() - done
            if new:
                self._segment(at, m.start(), m.end() - m.start())
                parts.append(new)
                at += len(new)
            done = m.end()
        self._segment(at, done, -1)
        parts.append(source[done:])
        self.text = "".join(parts)

    def _segment(self, here: int, there: int, size: int) -> None:
        self.here.append(here)
        self.there.append(there)
        self.size.append(size)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The characters of the source that a span (not empty) came from, and whether any was rewritten."""
        a, b = bisect_right(self.here, start) - 1, bisect_right(self.here, end - 1) - 1
        first = self.there[a] + (start - self.here[a] if self.size[a] < 0 else 0)
        last = self.there[b] + (end - self.here[b] if self.size[b] < 0 else self.size[b])
        # Characters that were taken out between two copied segments count as rewritten too.
        return first, last, b > a or self.size[a] >= 0


# Letters of other scripts that look like Latin ones, and signs that look like those of identifiers.
_LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝһ", "ABEKMHOPCTXaeopcyxijsdqwh", strict=True))
_LOOKALIKES |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν", "ABEZHIKMNOPTYXoiv", strict=True))
_LOOKALIKES |= dict(zip("﹫․‧﹒。‐‑‒–—−﹣⁺﹢", "@....------" + "-++", strict=True))
_LOOKALIKES |= {chr(c): " " for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
_INVISIBLE = [chr(c) for c in (0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF)]


def _alike() -> dict[str, str]:
    """What every character that looks like another becomes: the values above, full-width forms, letters and digits in mathematical styles, digits of all scripts."""
    out = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x1D400, 0x1D7CE) if unicodedata.normalize("NFKC", chr(c)).isascii()}
    out |= {chr(c): str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) is not None}
    return {k: v for k, v in (out | _LOOKALIKES).items() if len(v) == 1} | dict.fromkeys(_INVISIBLE, "")


ALIKE = _alike()
#: Characters among which those are.
_ODD = re.compile("[\xa0\xad\u0100-\U0010ffff]")

# The digits 0 to 9 spelled in the languages of the corpus; words for the signs of identifiers; usual top-level domains.
DIGITS = {
    "en": "zero one two three four five six seven eight nine", "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf", "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
AT, DOT, DASH, PLUS = "at arobase arroba klammeraffe", "dot punkt point punto", "dash hyphen tiret guion bindestrich", "plus más"
TOP = "com org net edu gov info biz io dev app eu uk us de fr es at ch it nl be pt ru pl se no fi dk ca au jp cn in br mx example test"
SPELLED = {w: str(i) for line in DIGITS.values() for i, w in enumerate(line.split())}


def _words(text: str) -> str:
    return "|".join(sorted(map(re.escape, text.split()), key=len, reverse=True))


_NO_LETTER, _NO_MORE = r"(?<![^\W\d_])", r"(?![^\W\d_])"
_DIGIT = f"{_NO_LETTER}(?:{_words(' '.join(SPELLED))}){_NO_MORE}"
_SPELLED = re.compile(rf"(?P<plus>{_NO_LETTER}(?:{_words(PLUS)})\s+(?=[0-9]|{_DIGIT}))|(?P<digit>{_DIGIT})(?:(?:\s{{1,2}}|\s?[-,]\s?)(?={_DIGIT}))?", re.IGNORECASE)


def _bracketed(words: str, sign: str) -> str:
    return rf"\s?[\[({{<]\s?(?:{_words(words)}|{re.escape(sign)})\s?[\])}}>]\s?"


_LABEL = r"[A-Za-z0-9-]+"
_DOTS = rf"(?:{_bracketed(DOT, '.')}|\s(?:{_words(DOT)})\s)"
_ENDS = rf"{_LABEL}(?:\.{_LABEL})*+{_DOTS}(?:{_LABEL}{_DOTS})*(?:{_words(TOP)})(?![A-Za-z0-9])"
_SIGNS = re.compile(
    rf"(?P<at>{_bracketed(AT, '@')}|&#0*64;|&#x40;|&commat;|(?<=[A-Za-z0-9])\s(?:{_words(AT)})\s(?={_ENDS})|(?<=[0-9])\s(?:{_words(AT)})\s(?=(?:{_LABEL}\.)+(?:{_words(TOP)})(?![A-Za-z0-9]))|(?<=[A-Za-z0-9])\s@\s(?={_LABEL}\s\.\s{_LABEL}))"
    rf"|(?P<dot>{_bracketed(DOT, '.')}|&#0*46;|&#x2e;|&period;|(?<=[A-Za-z0-9])\s(?:{_words(DOT)})\s(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])\s\.\s(?=[A-Za-z0-9]))"
    rf"|(?P<dash>{_bracketed(DASH, '-')})",
    re.IGNORECASE,
)


def _sign(m: re.Match) -> str:
    return {"at": "@", "dot": ".", "dash": "-"}[m.lastgroup]


def _look(m: re.Match) -> str:
    return ALIKE.get(m[0], m[0])


def _digit(m: re.Match) -> str:
    return "+" if m["plus"] else SPELLED[m["digit"].lower()]


def disguised(text: str, words: bool) -> list[Span]:
    """Identifiers that only show once disguises are undone, as spans of the text; words: whether it may hold spelled ones."""
    layers: list[Rewritten] = []
    now = text
    if not now.isascii() and not ALIKE.keys().isdisjoint(_ODD.findall(now)):
        layers.append(Rewritten(now, _ODD, _look))
        now, words = layers[-1].text, True
    if words:
        for pattern, output in ((_SPELLED, _digit), (_SIGNS, _sign)):
            if pattern.search(now):
                layers.append(Rewritten(now, pattern, output))
                now = layers[-1].text
    if not layers:
        return []
    out = []
    for kind, start, end in identifiers(now):
        changed = False
        for layer in reversed(layers):
            start, end, here = layer.back(start, end)
            changed |= here
        if changed:
            out.append(Span(kind, start, end))
    return out


def all_spans(text: str, words: bool = True) -> list[tuple[Span, bool]]:
    """Plain identifiers (True) and disguised ones (False). A disguised one that meets a plain one is left out, unless it is an address that
    reaches further than the plain one it holds."""
    plain = identifiers(text)
    out = [(s, True) for s in plain]
    for s in disguised(text, words):
        meets = [p for p in plain if p.start < s.end and s.start < p.end]
        if all(s.kind == p.kind == "email" and s.start <= p.start and p.end <= s.end and s != p for p in meets):
            out.append((s, False))
    return sorted(out, key=lambda x: (KINDS.index(x[0].kind), x[0].start, x[0].end))


_DIGIT_HASHES = np.array(sorted({word_hash(w) for w in SPELLED}), dtype=np.uint64)
_SIGN_HASHES = np.array(sorted({word_hash(w) for w in f"{DOT} arobase arroba klammeraffe".split()}), dtype=np.uint64)
# Each begins with a small set of characters, so that most of a text is passed over quickly.
_HINTS = [re.compile(rf"[\[({{<]\s?(?:{_words(AT)}|{_words(DASH)}|[@.-])\s?[\])}}>]", re.IGNORECASE), re.compile(r"[@.](?=\s)(?<=\s.)"), re.compile(r"[0-9]\sat\s", re.IGNORECASE), re.compile(r"&(?:#|commat|period)")]


def hinted(text: str) -> bool:
    """Whether a text may hold signs in disguise that aren't words of their own."""
    return any(h.search(text) for h in _HINTS)


def may_be_spelled(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Which rows hold a word for a sign, or three words and numbers in a row that spell digits."""
    own = Words(data, offsets, lo, hi)
    out = np.zeros(hi - lo, dtype=bool)
    if len(own.hash):
        out[own.row[np.isin(own.hash, _SIGN_HASHES)]] = True
        spelled = np.isin(own.hash, _DIGIT_HASHES)
        if spelled.any():
            first = data[offsets[lo:hi][own.row] + own.start]
            digit = spelled | ((first >= 48) & (first <= 57))
            three = digit[:-2] & digit[1:-1] & digit[2:] & (spelled[:-2] | spelled[1:-1] | spelled[2:]) & (own.row[:-2] == own.row[2:])
            out[own.row[:-2][three]] = True
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))


def _found(text: str, masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            data, offsets = buffers(column)
            for lo, hi in steps(offsets):
                spelled = may_be_spelled(data, offsets, lo, hi)
                part = batch.slice(lo, hi - lo)
                spans, masks = [], []
                for raw, words in zip(part.column(text).to_pylist(), spelled.tolist(), strict=True):
                    own = raw or ""
                    found = all_spans(own, words or hinted(own))
                    spans.append([{"kind": s.kind, "start": s.start, "end": s.end, "plain": plain} for s, plain in found])
                    if masked:
                        masks.append(None if raw is None else mask(own, [s for s, _ in found]))
                columns = [c for n, c in zip(part.schema.names, part.columns, strict=True) if n != text] + [pa.array(spans, type=_SPANS)] + ([pa.array(masks, type=pa.string())] if masked else [])
                yield pa.RecordBatch.from_arrays(columns, names=[n for n in part.schema.names if n != text] + ["spans"] + ["masked"] * masked)

    return run


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or what overlapping ones cover together, replaced by the kind of the first."""
    parts, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            parts += [text[done : s.start], f"[{s.kind.upper()}]"]
        done = max(done, s.end)
    return "".join([*parts, text[done:]])


def find_personal_data(documents: DataFrame, keep: list[str] | None = None, text: str = "text", masked: bool = False) -> DataFrame:
    """The columns to keep (all but the text), then spans: array of (kind, start, end, plain), and with `masked` the text without them.

    Spans are of code points, ends exclusive, by kind (email, ip, card, phone), then start; plain ones stand in the text as they are,
    the others disguised. A null or empty text has none, and a null one stays null when masked; repeated rows each get their own; an
    empty table gives no rows. No row is joined with another, so no shuffle takes place. Columns named like the results give way to them.
    """
    keep = [c for c in documents.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c.lower() not in ("spans", "masked")]
    frame, at = shielded(documents)
    own = frame.select(*[at[c] for c in keep], frame[at[text]].cast("string").alias(at[text]))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("plain", T.BooleanType())])
    fields = [f for f in own.schema.fields if f.name != at[text]] + [T.StructField("spans", T.ArrayType(span))] + [T.StructField("masked", T.StringType())] * masked
    found = own.mapInArrow(_found(at[text], masked), T.StructType(fields))
    return found.toDF(*keep, "spans", *["masked"] * masked)
