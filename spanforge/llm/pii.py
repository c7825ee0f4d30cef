"""Personal data, disguised or not, with spans in the source text.

Plain identifiers come from patterns over the text as it is. Disguised ones come from the same patterns
over a normalised text: a chain of transducers replaces look-alike characters, spelled digits and written
at/dot signs, and keeps for each normalised character the source characters that it stands for.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm import words

#: Kinds in the order that settles equal starts.
KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits is matched whole, so a match can only start where a run starts: possessive forms of the
# plain patterns, which match the same and never go back over a long run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """From each @ back over the local part and on over the domain: linear, however long a run is."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield "email", start, free
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)


def plain(text: str) -> list[Span]:
    """(kind, start, end) of every plain identifier, by start, then kind."""
    found: list[Span] = list(_emails(text)) if "@" in text else []
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Letters of other scripts that look like Latin ones, in the order of the Latin letter.
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уγ",
    ".": "。․﹒", "@": "﹫", "-": "‐‑‒–—−﹣", "+": "﹢",
}
# Characters that don't show.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c"
    "\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff"
)
# The ten digits in words, by language.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
# Words for the signs.
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "punto", "point")

_LOOKS = {c: latin for latin, others in LOOKALIKES.items() for c in others}
_DIGITS = {w: str(i) for names in DIGIT_WORDS.values() for i, w in enumerate(names.split())}
_GAP = r"[ \t\n\x0b\f\r]"
_ODD = re.compile("[\\u00a0\\u00ad\\u00b2\\u00b3\\u00b9\\u0250-\\U0010ffff]")
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_ANY_DIGIT = "|".join(sorted(_DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:{_ANY_DIGIT})(?!\w)")
_SPELLED_LOW = re.compile(rf"\b(?:{_ANY_DIGIT})[ ,.-]{{1,3}}(?:{_ANY_DIGIT}|[0-9])")
_BETWEEN = re.compile(r"(?:[ -]|, )?")
_MIXED = re.compile(r"(?<=[0-9])[OoIl|](?=[ -]?[0-9])|(?<=[0-9][ -])[OoIl|](?=[0-9])")
_ZERO = re.compile(r"(?<=[0-9])[Oo](?=[ -]?[0-9])|(?<=[0-9][ -])[Oo](?=[0-9])")
_ONE = re.compile(r"(?<=[0-9])[Il|](?=[ -]?[0-9])|(?<=[0-9][ -])[Il|](?=[0-9])")
_WRAPPED_AT = re.compile(rf"(?i)(?:(?<!\s){_GAP}++)?[\[({{<_]{_GAP}{{0,2}}(?:{_AT}|@){_GAP}{{0,2}}[\])}}>_]{_GAP}{{0,3}}")
_WRAPPED_DOT = re.compile(rf"(?i)(?:(?<!\s){_GAP}++)?[\[({{<_]{_GAP}{{0,2}}(?:{_DOT}|\.){_GAP}{{0,2}}[\])}}>_]{_GAP}{{0,3}}")
_SPACED_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9_-]){_GAP}(?:{_DOT}){_GAP}(?=[A-Za-z0-9])")
_SPACED_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9_%-]){_GAP}(?:(?:{_AT}){_GAP}|@{_GAP}?)(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,24}}(?![A-Za-z0-9-]))|(?<=[A-Za-z0-9_%-])@{_GAP}(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,24}}(?![A-Za-z0-9-]))")
_PLUS = re.compile(rf"(?i)(?<!\w)plus{_GAP}(?=[0-9(])")
# What each pattern above needs, quick to look for; those with words read lower-cased text.
_FOLD = {0x17F: "s", 0x130: "i", 0x131: "i"}
_WRAPPED = re.compile(rf"(?i)[\[({{<_]{_GAP}{{0,2}}(?:{_AT}|{_DOT}|@|\.){_GAP}{{0,2}}[\])}}>_]")
_AT_BY_GAP = re.compile(rf"@(?:(?<={_GAP}@)|{_GAP})")
_AT_THEN_DOT = [(w, re.compile(rf"{w}{_GAP}[a-z0-9-]++\.")) for w in AT_WORDS]
_AFTER_DIGIT = re.compile(rf"[0-9][ -](?:{_ANY_DIGIT})(?!\w)")
_TOP = re.compile(r"\.[A-Za-z]{2,24}\Z")


@lru_cache(maxsize=1 << 16)
def _plain_char(c: str) -> str:
    """What a character looks like, in ASCII where it looks like ASCII; itself otherwise."""
    if c in _LOOKS:
        return _LOOKS[c]
    if c in INVISIBLE:
        return ""
    folded = unicodedata.normalize("NFKC", c)
    folded = "".join(_LOOKS.get(x, x) for x in folded)
    digit = unicodedata.decimal(folded, None) if len(folded) == 1 else None
    if digit is not None:
        return str(int(digit))
    return folded if folded.isascii() else c


class Mapped:
    """A normalised text and, for each piece of it, the source characters that it stands for.

    Pieces are (normalised start, source start, source end, whether changed). An unchanged piece maps
    character by character; a changed one as a whole.
    """

    def __init__(self, text: str):
        self.text, self.starts, self.pieces = text, [0], [(0, len(text), False)]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source start and end of a normalised span, and whether it holds anything changed."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, b = self.pieces[i], self.pieces[j]
        first = a[0] if a[2] else a[0] + start - self.starts[i]
        last = b[1] if b[2] else b[0] + end - self.starts[j]
        return first, last, last - first != end - start or any(p[2] for p in self.pieces[i : j + 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the normalised text (in order, not overlapping) and keep the map."""
        if not edits:
            return
        out, starts, pieces, at, size = [], [], [], 0, 0

        def same(to: int) -> None:
            nonlocal at, size
            i = bisect_right(self.starts, at) - 1
            while at < to:
                end = min(to, self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text))
                s, e, changed = self.pieces[i]
                if end > at:
                    starts.append(size)
                    pieces.append((s, e, True) if changed else (s + at - self.starts[i], s + end - self.starts[i], False))
                    out.append(self.text[at:end])
                    size += end - at
                    at = end
                i += 1

        for a, b, new in edits:
            same(a)
            s, e, _ = self.source(a, b)
            if new:
                starts.append(size)
                pieces.append((s, e, True))
                out.append(new)
                size += len(new)
            at = b
        same(len(self.text))
        self.text, self.starts, self.pieces = "".join(out), starts or [0], pieces or [(0, 0, False)]


def _characters(m: Mapped) -> None:
    if not m.text.isascii():
        m.rewrite([(x.start(), x.end(), p) for x in _ODD.finditer(m.text) if (p := _plain_char(x[0])) != x[0]])


def _low(text: str) -> str:
    """Lower case, with the letters that case-blind patterns take for an i or an s as these."""
    return text.lower() if text.isascii() else text.translate(_FOLD).lower()


def _digits(m: Mapped) -> None:
    """Spelled digits in runs: each becomes its digit, and a single space, hyphen or comma between two goes."""
    found = [(x.start(), x.end(), _DIGITS[_low(x[0])]) for x in _SPELLED.finditer(m.text)]
    edits: list[tuple[int, int, str]] = []
    joined = set()
    for k, ((_, e, _), (s, _, _)) in enumerate(pairwise(found)):
        if _BETWEEN.fullmatch(m.text, e, s):
            joined |= {k, k + 1}
    for k, (s, e, d) in enumerate(found):
        near = (s >= 2 and m.text[s - 2].isdigit() and m.text[s - 1] in " -") or (e + 1 < len(m.text) and m.text[e + 1].isdigit() and m.text[e] in " -")
        if k in joined or near:
            edits.append((s, e, d))
            if k + 1 in joined and k in joined and found[k + 1][0] > e and _BETWEEN.fullmatch(m.text, e, found[k + 1][0]):
                edits.append((e, found[k + 1][0], ""))
    m.rewrite(edits)


def _replace(pattern: re.Pattern, new: str) -> Callable[[Mapped], None]:
    return lambda m: m.rewrite([(x.start(), x.end(), new) for x in pattern.finditer(m.text)])


#: The chain, in order; each reads what the one before has written.
TRANSDUCERS: tuple[Callable[[Mapped], None], ...] = (
    _characters,
    _replace(_WRAPPED_AT, "@"),
    _replace(_WRAPPED_DOT, "."),
    _digits,
    _replace(_ZERO, "0"),
    _replace(_ONE, "1"),
    _replace(_SPACED_DOT, "."),
    _replace(_SPACED_AT, "@"),
    _replace(_PLUS, "+"),
)


def suspicious(text: str) -> bool:
    """Whether the chain could change anything in the text; cheap enough to ask of every text.

    The first transducer that changes anything reads the text as it is, so it is enough that no pattern finds
    anything there. Each is asked for only where what it needs is there.
    """
    if not text.isascii() and _ODD.search(text):
        return True
    low = _low(text)
    if any(b in text for b in "[({<_") and _WRAPPED.search(text):
        return True
    if any(w in low for w in DOT_WORDS) and _SPACED_DOT.search(text):
        return True
    if ("@" in text and _AT_BY_GAP.search(text) or any(w in low and cue.search(low) for w, cue in _AT_THEN_DOT)) and _SPACED_AT.search(text):
        return True
    if "plus" in low and _PLUS.search(text):
        return True
    return bool(_SPELLED_LOW.search(low)) or bool(_AFTER_DIGIT.search(low)) or bool(_MIXED.search(text))


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only the normalised text shows, as source spans; those equal to or inside plain ones are left out."""
    if not suspicious(text):
        return []
    m = Mapped(text)
    for step in TRANSDUCERS:
        step(m)
    found = set()
    for kind, a, b in plain(m.text):
        start, end, changed = m.source(a, b)
        if not changed or kind == "email" and not _TOP.search(m.text[a:b]):
            continue
        if not any(k == kind and s <= start and end <= e for k, s, e in base):
            found.add((kind, start, end))
    return list(found)


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, added) of all identifiers of a whole text, by start, then kind; null as empty."""
    base = plain(text or "")
    extra = disguised(text or "", base)
    known = set(extra)
    return [(*s, s in known) for s in ordered(base + extra)]


def mask(text: str | None) -> str | None:
    """The text with each stretch of identifiers replaced by the kind of the one that starts it."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:long,end:long,added:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and spans of every row's whole text, each span with whether the method added it.

    Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows are each
    searched; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.frugal(batches):
            rows = [[dict(zip(("kind", "start", "end", "added"), s, strict=True)) for s in find(x)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN_TYPE)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(f"`{text}`")).mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with identifiers masked in the text, and n_chars, if there is one, as long as the new text. Rows and other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.frugal(batches):
            i = batch.schema.get_field_index(text)
            new = pa.array([mask(x) for x in batch.column(i).to_pylist()], batch.schema.field(i).type)
            yield batch.set_column(i, batch.schema.field(i), new)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
