"""Personal data with offset-preserving deobfuscation (operator 3).

Base spans come from the text as it is. Then a chain of transducers rewrites a copy: homoglyphs, forms of letters and foreign
digits fold one to one, zero-width characters vanish, disguised "at" and "dot" become their signs (in brackets, between
blanks, hyphens or underscores, as codes of HTML and URLs), blanks round the points of a host close up, and spelled digits
beside others become digits. A sign that may be plain prose (" at ", " @ ", "_at_") counts before a spelled point or a known ending. Every rewrite records where its output came from, identifiers are detected in the normalised copy, and
their spans are mapped back to source characters. A mapped span is added unless it lies within a base span of its kind.

Cases: null text is empty; scanning is linear in the text, however long; ties and repeated rows are scanned row by
row; an empty table gives an empty result; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, pick

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits that fails as a whole fails from within too, hence the look-behind and the possessive runs.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Led by each @: the local part is read leftwards, so that long runs without one cost nothing."""
    out, last, before, at = [], 0, -1, text.find("@")
    while at >= 0:
        left = text[max(last, before + 1) : at]
        local = len(left) - len(left.rstrip(LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            out.append((at - local, last := m.end()))
        before, at = at, text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(p := part.lstrip("0")) < 3 or len(p) == 3 and p <= "255"
    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15] if "+" in text else []


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detect(text: str) -> list[tuple[int, int, str]]:
    found = [(a, b, kind) for kind, f in DETECTORS.items() for a, b in f(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# Characters of other scripts that look like an ASCII one.
LOOK_ALIKE = {
    "a": "\u0430\u03b1", "c": "\u0441\u03f2", "d": "\u0501", "e": "\u0435", "g": "\u0261", "h": "\u04bb", "i": "\u0456\u03b9\u0131", "j": "\u0458", "k": "\u043a\u03ba",
    "m": "\u043c", "n": "\u0578", "o": "\u043e\u03bf\u0585", "p": "\u0440\u03c1", "q": "\u051b", "s": "\u0455", "t": "\u0442", "u": "\u057d", "v": "\u03bd\u0475", "w": "\u051d",
    "x": "\u0445\u03c7", "y": "\u0443\u03b3", "A": "\u0410\u0391", "B": "\u0412\u0392", "C": "\u0421\u03f9", "E": "\u0415\u0395", "H": "\u041d\u0397", "I": "\u0406\u0399",
    "J": "\u0408", "K": "\u041a\u039a", "M": "\u041c\u039c", "N": "\u039d", "O": "\u041e\u039f", "P": "\u0420\u03a1", "S": "\u0405", "T": "\u0422\u03a4", "X": "\u0425\u03a7",
    "Y": "\u04ae\u03a5", "Z": "\u0396",
    "-": "\u2010\u2011\u2012\u2013\u2014\u2212", ".": "\u2024\u3002\uff61", " ": "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u3000",
}
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
SPELLED = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


#: Kinds of compatibility decomposition that keep a letter's looks: mathematical, wide, narrow and circled forms.
_FORMS = ("<font>", "<wide>", "<narrow>", "<circle>")


def _fold_table() -> dict[int, str]:
    """One character for one: look-alikes, forms that decompose into one ASCII character, and digits of all scripts."""
    table = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0] in _FORMS and 0x21 <= int(parts[1], 16) < 0x7F:
            table[ord(c)] = chr(int(parts[1], 16))
        elif unicodedata.category(c) == "Nd":
            table[ord(c)] = str(unicodedata.digit(c))
    return table | {ord(c): latin for latin, others in LOOK_ALIKE.items() for c in others}


_FOLD = _fold_table()
# Separators are a grammar: in brackets, between blanks of any number, between hyphens or underscores, or as a code of HTML or URLs.
_OPEN, _CLOSE = r"(?<!\s)\s*+[\[({<]\s*+", r"\s*+[\])}>]\s*+"
_DASHED = r"(?<=[a-z0-9])\s*+[-_]++{}[-_]++\s*+(?=[a-z0-9])"
_DOT = rf"{_OPEN}(?:dot|\.){_CLOSE}|(?<=[a-z0-9])\s++dot\s++(?=[a-z0-9])|{_DASHED.format('dot')}|&#0{{0,5}}46;|&#x0{{0,5}}2e;|&period;|%2e"
# Endings of hosts, those that are no English words and those that are.
_ENDING = r"(?:com|org|net|edu|gov|mil|info|biz|name|io|co|ai|app|dev|tv|xyz|online|site|test|example|museum|uk|de|fr|es|nl|ch|pt|pl|se|dk|fi|ie|gr|cz|ru|ua|tr|ca|mx|br|ar|cl|au|nz|jp|kr|cn|za|il|eu)(?![a-z0-9-])"
_WORD_ENDING = r"(?:at|in|is|me|no|be|it|us|to|so|am|as)(?![a-z0-9-]|\s++[a-z])"
# After a plain "at" these words make "dot" a noun ("at the dot there"), unless a common ending follows.
_NOUN = r"(?:the|an?|this|that|each|every|my|your|his|her|its|our|their)\s++dot\s++(?!(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|eu)\b)"
# Words before a plain "at" that make it a place, not an address.
PLACED = frozenset("""am and are arrive arrived arrives arriving available be been being built found hang held here hosted is it live lives look looked looking looks me meet meeting
meets met not online only or page seen site sold stay stayed stop stopped there us was website were work worked works""".split())
# A host after a doubtful sign: points in plain need a known ending; a spelled point leads to any label. A blank after a point
# needs one before it: a sentence ends without.
_HOST = rf"(?:(?:[a-z0-9-]{{1,255}}+(?:\.|\s++\.\s*+)){{1,6}}{_ENDING}|(?:[a-z0-9-]{{1,255}}+\.){{1,6}}{_WORD_ENDING})"
_SURE = rf"{_OPEN}(?:at|@){_CLOSE}|&#0{{0,5}}64;|&#x0{{0,5}}40;|&commat;|%40"
_DOUBTFUL = rf"(?:(?<=[a-z0-9])(?:\s++at\s++|\s++@\s*+|@\s++)|{_DASHED.format('at')})(?!{_NOUN})(?=[a-z0-9][a-z0-9-]{{0,254}}?(?:{_DOT})|{_HOST})"
_AT = rf"{_SURE}|{_DOUBTFUL}"
_DIGIT = "|".join(SPELLED)
# Spelled digits and single numerals; a run without a spelled one stays as it is.
_ONE = rf"(?:(?:{_DIGIT})\b|[0-9](?![0-9a-z]))"
_RUN = rf"(?<![0-9a-z_]){_ONE}(?:[\s-]{{1,3}}{_ONE})*+"
#: One pass of the multi-character transducer; the named group that matches says which rewrite applies.
_REWRITE = re.compile(rf"(?P<gone>[{ZERO_WIDTH}]+)|(?P<at>{_AT})|(?P<dot>{_DOT})|(?P<plus>\bplus\s{{1,3}}(?=(?:{_DIGIT}|[0-9]+)\b))|(?P<run>{_RUN})", re.I)
_SPELLED = re.compile(_DIGIT, re.I)
# What stands beside a run: digits by a gap, or by a point, plain or disguised, as between octets.
_POINT = r"(?:\.|\s{0,20}[\[({<]\s{0,20}(?:dot|\.)\s{0,20}[\])}>]\s{0,20}|\s{1,20}dot\s{1,20}|[-_]dot[-_])"
_LEFT, _RIGHT = re.compile(r"[0-9][\s-]{1,3}\Z"), re.compile(r"[\s-]{1,3}[0-9]")
_LEFT_POINT, _RIGHT_POINT = re.compile(rf"(?:[0-9]|\b(?:{_DIGIT})){_POINT}\Z", re.I), re.compile(rf"{_POINT}(?:[0-9]|(?:{_DIGIT})\b)", re.I)
#: Characters before a run that decide: the longest disguised point and the longest spelled digit.
_BEFORE, _OCTET = 100, 3
_ONE_DIGIT = re.compile(rf"{_DIGIT}|[0-9]", re.I)
_SPACED, _LABEL, _WORD = re.compile(_HOST, re.I), re.compile("[a-z0-9-]+", re.I), re.compile(r"[a-z]+\Z")


class Mapped:
    """Normalised text, and for stretches of it where they came from: equal lengths map one to one."""

    def __init__(self) -> None:
        self.parts, self.at, self.source, self.n = [], [], [], 0

    def put(self, text: str, start: int, end: int) -> None:
        if text:
            self.at.append(self.n)
            self.source.append((start, end, len(text) == end - start))
            self.parts.append(text)
            self.n += len(text)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a, b = self.source[i], self.source[j]
        return (a[0] + start - self.at[i] if a[2] else a[0]), (b[0] + end - self.at[j] if b[2] else b[1])


def normalise(text: str) -> Mapped | None:
    """None if no rewrite applies anywhere."""
    folded = text if text.isascii() else text.translate(_FOLD)  # one character for one: offsets stay
    out, last, changed = Mapped(), 0, folded != text
    for m in _REWRITE.finditer(folded):
        start, end = m.span()
        if start < last:  # within a host that has been put
            continue
        if m.lastgroup == "at" and m[0].strip().lower() == "at" and (word := _WORD.search(folded[max(0, start - 12) : start].lower())) and word[0] in PLACED:
            continue
        out.put(folded[last:start], last, start)
        if m.lastgroup == "run":
            digits = list(_ONE_DIGIT.finditer(folded, start, end)) if _SPELLED.search(folded, start, end) else []
            before = folded[max(0, start - _BEFORE) : start] if digits else ""
            head, tail = bool(digits and _LEFT_POINT.search(before)), bool(digits and _RIGHT_POINT.match(folded, end))
            if not (len(digits) > 1 or head or tail or digits and (_LEFT.search(before) or _RIGHT.match(folded, end))):
                out.put(folded[start:end], start, end)
                last = end
                continue
            at = start
            for i, d in enumerate(digits):
                gap = folded[at : d.start()]
                octet = head and i < _OCTET or tail and i > len(digits) - _OCTET  # digits of one octet close up
                out.put("" if octet else gap if gap == "-" else " " * bool(gap), at, d.start())
                word = d[0].lower()
                out.put(str(SPELLED.index(word)) if word in SPELLED else word, d.start(), at := d.end())
                changed = True
        elif m.lastgroup != "gone":
            out.put({"at": "@", "dot": ".", "plus": "+"}[m.lastgroup], start, end)
            if m.lastgroup == "at" and (host := _SPACED.match(folded, end)):
                for label in _LABEL.finditer(folded, end, host.end()):  # points close up with the blanks round them
                    out.put("." if label.start() > end else "", end, label.start())
                    out.put(label[0], label.start(), end := label.end())
        changed |= m.lastgroup != "run"
        last = end
    if not changed:
        return None
    out.put(folded[last:], last, len(folded))
    return out


def find(text: str) -> list[tuple[int, int, str, bool]]:
    """Spans (start, end, kind, base) ordered by start and then kind."""
    base = detect(text)
    found = [(a, b, k, True) for a, b, k in base]
    if (mapped := normalise(text)) is not None:
        taken = {k: [(a, b) for a, b, kind in base if kind == k] for k in KINDS}
        for a, b, k in detect("".join(mapped.parts)):
            a, b = mapped.back(a, b)
            i = bisect_right(taken[k], (a, len(text) + 1)) - 1
            if i < 0 or taken[k][i][1] < b:
                found.append((a, b, k, False))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and found, an array of (kind, start, end, base)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [[{"kind": k, "start": a, "end": b, "base": base} for a, b, k, base in find(t or "")] for t in batch.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "found"])

    return arrow_map(pick(df, id_col, text_col), run, "doc_id long, found array<struct<kind:string,start:long,end:long,base:boolean>>")
