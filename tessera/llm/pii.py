r"""Personal data with offset-preserving deobfuscation.

Base spans are found in the text as it stands, leftmost and non-overlapping for each kind:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``, parts at most 255
* card ``[0-9]([\x20-]?[0-9])+``, 14 to 19 digits passing Luhn
* phone ``\+[0-9][\x20().0-9-]+[0-9]``, 10 to 15 digits

A failing match is dropped, not retried. Then a chain of transducers rewrites the text: homoglyphs and wide forms become
ASCII, at/dot disguises become ``@`` and ``.``, spelled digits become digits. Each carries, for every character it emits,
the source range it came from, so a span found in the normal form is mapped back to source characters. Spans that touch
a base span of their kind are left out: the base spans stay, the method only adds.

A transducer is passed over only in texts where it cannot match, by a sign that each of its matches has; whether a span is
found never depends on other disguises in the text. All searches are linear in the
text. A disguise has blanks of up to three characters, host labels of up to 63 and runs of up to 201 digits. Offsets count code points, the end is exclusive. Defined results: a null or empty text has no spans; a null doc_id
is kept; repeated rows are scanned each; other columns pass through ``find_spans`` (columns named like a result column
are replaced).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table, with_workers

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Where one digit run does not begin a match, no later digit of that run does, so only the first is tried.
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


# ---- fixed values: characters that look like ASCII ones, spelled digits, disguises
_ALIKE = (
    ("аᴀɑα", "a"), ("ԁ", "d"), ("еҽ", "e"), ("ɡ", "g"), ("һ", "h"), ("іıι", "i"), ("ј", "j"), ("ӏⅼ", "l"), ("ո", "n"), ("оοօ", "o"),
    ("рρ", "p"), ("ԛ", "q"), ("ѕ", "s"), ("ս", "u"), ("ѵν", "v"), ("ԝ", "w"), ("хχ", "x"), ("уү", "y"), ("сϲ", "c"), ("ᴢ", "z"), ("ⅿ", "m"), ("к", "k"), ("т", "t"),
    ("АΑ", "A"), ("ВΒ", "B"), ("СϹ", "C"), ("ЕΕ", "E"), ("НΗ", "H"), ("ІΙ", "I"), ("Ј", "J"), ("КΚ", "K"), ("МΜ", "M"), ("ΝՆ", "N"),
    ("ОΟ", "O"), ("РΡ", "P"), ("Ѕ", "S"), ("ТΤ", "T"), ("ХΧ", "X"), ("ΥҮ", "Y"), ("ΖZ", "Z"),
    ("﹫", "@"), ("․。｡﹒‧∙•·٫", "."), ("‐‑‒–—−﹣", "-"), ("﹢", "+"), ("      　", " "),
)
_NOTHING = "​‌‍⁠﻿­"
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
# ---- end of fixed values

_MAP: dict[str, str] = {c: to for chars, to in _ALIKE for c in chars} | {chr(0xFEE0 + k): chr(k) for k in range(0x21, 0x7F)}
for _zero in (0x0660, 0x06F0, 0x0966, 0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # other scripts' digits
    _MAP |= {chr(_zero + k): str(k) for k in range(10)}
_MAP |= dict.fromkeys(_NOTHING, "")
_STRANGE = re.compile("[" + re.escape("".join(k for k in _MAP if not k.isascii())) + "]")
_ODD = frozenset(k for k in _MAP if not k.isascii())
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# Every repeat is bounded, so that no search goes back and forth over a long text.
_B = r"[ \t]{0,3}"
_DOT_AHEAD = rf"(?:{_B}{_OPEN}{_B}(?:dot|\.){_B}{_CLOSE}|[ \t]{{1,3}}dot[ \t])"
_AT = re.compile(
    rf"{_B}{_OPEN}{_B}(?:at|@){_B}{_CLOSE}{_B}"
    rf"|(?<=[\w-])[ \t]{{1,3}}(?:at|@)[ \t]{{1,3}}(?=[A-Za-z0-9.-]{{1,63}}{_DOT_AHEAD})"
    rf"|(?<=\w)[_-]at[_-](?=[A-Za-z0-9.]{{1,63}}(?:[_-]dot[_-]|\.))",
    re.I,
)
_DOT = re.compile(rf"{_B}{_OPEN}{_B}(?:dot|\.|point){_B}{_CLOSE}{_B}|(?<=\w)[ \t]{{1,3}}(?:dot|point)[ \t]{{1,3}}(?=\w)|(?<=\w)[_-]dot[_-](?=\w)", re.I)
_WORD_DIGIT = rf"(?:{'|'.join(_SPELLED)}|[0-9])"
_DIGIT_RUN = re.compile(rf"(?:(?<![A-Za-z])plus[\s,-]{{0,3}}|\+\s{{0,3}})?(?<![A-Za-z0-9]){_WORD_DIGIT}(?:[\s,.()-]{{0,3}}(?:(?:dot|point)\s{{1,3}})?{_WORD_DIGIT}){{3,200}}(?![A-Za-z0-9])", re.I)
_PIECE = re.compile(rf"{'|'.join(_SPELLED)}|dot|point|plus", re.I)
# Signs, in lower case: each transducer needs one of its own to match anywhere, so texts without it are left alone by it.
_BRACKETED = re.compile(rf"{_OPEN}{_B}(?:at|@|dot|\.|point){_B}{_CLOSE}")
_BARE = re.compile(r"(?:dot(?<=[ \t_-]dot)|point(?<=[ \t]point))(?=[ \t_-])")
_JOINED_AT = ("_at_", "_at-", "-at_", "-at-")
_SEP = r"[\s,.()-]{0,3}"
_ANY_SPELLED = rf"(?:{'|'.join(_SPELLED)})"
_LINK = re.compile(
    rf"{_ANY_SPELLED}{_SEP}(?:(?:dot|point)\s{{1,3}})?{_WORD_DIGIT}"
    rf"|[0-9]{_SEP}(?:(?:dot|point)\s{{1,3}}{_WORD_DIGIT}|{_ANY_SPELLED})"
    rf"|plus[\s,-]{{0,3}}{_WORD_DIGIT}"
)


def _low(s: str) -> str:
    """Lower case as patterns that ignore case compare it."""
    return s.lower() if s.isascii() else s.lower().replace("i̇", "i").replace("ſ", "s").replace("ı", "i")


def signs(text: str) -> tuple[bool, bool, bool]:
    """Whether ``_AT``, ``_DOT`` and a digit run with words can match in a text (in it as it is, before any of them rewrites it)."""
    low = _low(text)
    bracketed = any(x in low for x in "[({<") and bool(_BRACKETED.search(low))
    bare = ("dot" in low or "point" in low) and bool(_BARE.search(low))
    return bracketed or bare or any(x in low for x in _JOINED_AT), bracketed or bare, bool(_LINK.search(low))


class Tape:
    """A rewritten text; character k comes from source[start[k]:end[k]]."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, found: Iterator[tuple[int, int, str]]) -> None:
        """Replaces the found slices (in order, apart) by other strings."""
        text, start, end, at = [], [], [], 0
        for a, b, to in found:
            text += [self.text[at:a], to]
            start += self.start[at:a] + [self.start[a]] * len(to)
            end += self.end[at:a] + [self.end[b - 1]] * len(to)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = start + self.start[at:], end + self.end[at:]


def _spelled(m: re.Match) -> str:
    out = _PIECE.sub(lambda p: {"dot": ".", "point": ".", "plus": "+"}.get(w := _low(p[0]), _SPELLED.get(w, "")), m[0])
    return re.sub(r"[\s,]+|(?<=[0-9])[().-]*\s*(?=\.)|(?<=\.)\s+", "", out) if _PIECE.search(m[0]) else m[0]


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    tape = Tape(text)
    if not text.isascii() and not _ODD.isdisjoint(set(text)):
        tape.rewrite((m.start(), m.end(), _MAP[m[0]]) for m in _STRANGE.finditer(tape.text))
    at, dot, digits = signs(tape.text)
    if at:
        tape.rewrite((m.start(), m.end(), "@") for m in _AT.finditer(tape.text))
    if dot:
        tape.rewrite((m.start(), m.end(), ".") for m in _DOT.finditer(tape.text))
    if digits or (at or dot) and _LINK.search(_low(tape.text)):
        tape.rewrite((m.start(), m.end(), _spelled(m)) for m in _DIGIT_RUN.finditer(tape.text))
    if tape.text == text:
        return []
    taken = {k: ([x[0] for x in base if x[2] == k], [x[1] for x in base if x[2] == k]) for k in KINDS}  # in order and apart
    out = []
    for a, b, kind in base_spans(tape.text):
        s, e = tape.start[a], tape.end[b - 1]
        starts, ends = taken[kind]
        before = bisect_left(starts, e)
        if not before or ends[before - 1] <= s:
            out.append((s, e, kind))
    return out


def _text(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in order)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a text."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, disguised_spans(text, base)


_RESULT = [(f"n_{k}", T.LongType()) for k in KINDS] + [("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_added", T.LongType())]


def find_spans(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``docs`` with the counts of base spans, their digest, all spans and the number of added ones."""
    with_workers(docs.sparkSession)
    docs = docs.drop(*[c for c, _ in _RESULT])
    out = [c for c in docs.columns if with_text or c != "text"]
    schema = T.StructType([docs.schema[c] for c in out] + [T.StructField(c, t) for c, t in _RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, added = scan(text.as_py())
                counts = [sum(x[2] == k for x in base) for k in KINDS]
                digest = hashlib.sha256(_text(base).encode()).hexdigest()
                rows.append((*counts, digest, _text(base + added), len(added)))
            cols = [pa.array([r[k] for r in rows], pa.string() if t == T.StringType() else pa.int64()) for k, (_, t) in enumerate(_RESULT)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), *cols], names=[*out, *(c for c, _ in _RESULT)])

    return docs.mapInArrow(run, schema)


def op3_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
