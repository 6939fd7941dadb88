"""Personal data with offset-preserving deobfuscation.

Identifiers are first found in the source text itself (the base spans). A cascade of small transducers then rewrites
the text - invisible characters vanish, homoglyphs and foreign digits become ASCII, spelled digits become digits,
at/dot disguises become ``@`` and ``.`` - and every stage keeps, for each rewritten piece, where it stood in its input.
The same detectors run over the normalised text, and their spans are mapped back through all stages to source
characters. A mapped span is added when it covers a rewritten piece and meets no base span of its kind.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import map_rows, words

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# ---- detectors: leftmost non-overlapping matches; failing candidates are dropped without retries ----

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behind only skips starts inside a run of digits, where the match from the run's start would succeed or fail alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE_HEAD = re.compile(r"\+[0-9]")
_PHONE_TAIL = re.compile(r"[\x20().0-9-]++")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> Iterator[Span]:
    """Every ``@domain`` with the longest local part before it that no earlier match has taken: linear in the text."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def is_card(s: str) -> bool:
    digits = _NOT_DIGIT.sub("", s)
    return 13 <= len(digits) <= 19 and luhn(digits)


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if is_card(m[0]):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    """``\\+[0-9][\\x20().0-9-]+[0-9]``: the tail is taken whole and cut back to its last digit."""
    at = 0
    while m := _PHONE_HEAD.search(text, at):
        at = m.end()
        tail = _PHONE_TAIL.match(text, at)
        if not tail:
            continue
        end = tail.end()
        while end > at and not "0" <= text[end - 1] <= "9":
            end -= 1
        if end < at + 2:  # one character of the class and one digit at least
            continue
        if 9 <= len(_NOT_DIGIT.sub("", text[m.start() : end])) <= 15:
            yield m.start(), end
        at = end


DETECTORS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


_DIGIT = re.compile("[0-9]")


def detect(text: str) -> dict[str, list[Span]]:
    """Spans by kind; a text without digits can only hold e-mail addresses."""
    some = _DIGIT.search(text) is not None
    return {kind: list(find(text)) if some or kind == "email" else [] for kind, find in DETECTORS.items()}


# ---- transducers ----


class Edited:
    """A text with the edits that made it: positions map back to the text it was made from."""

    def __init__(self, source: str, edits: Iterable[tuple[int, int, str]]):
        self.pieces: list[tuple[int, int, int, int]] = []  # start and end in the new text, start and end in the source
        parts, at, size = [], 0, 0
        for start, end, new in edits:
            if start < at or source[start:end] == new:
                continue
            parts += [source[at:start], new]
            size += start - at
            self.pieces.append((size, size + len(new), start, end))
            size += len(new)
            at = end
        parts.append(source[at:])
        self.text = "".join(parts)
        self._starts = [p[0] for p in self.pieces]
        self._ends = [p[1] for p in self.pieces]

    def back(self, span: Span) -> Span:
        """Source span: an edge inside a rewritten piece moves out to that piece's own edge."""
        return self._edge(span[0], first=True), self._edge(span[1], first=False)

    def _edge(self, at: int, first: bool) -> int:
        if first:  # the last piece that begins at or before the first character
            k = bisect_right(self._starts, at) - 1
            if k < 0:
                return at
            a, b, s, e = self.pieces[k]
            return s if a <= at < b else e + at - b
        k = bisect_left(self._starts, at) - 1  # the last piece that begins before the end
        if k < 0:
            return at
        a, b, s, e = self.pieces[k]
        return e if at <= b else e + at - b

    def touched(self, span: Span) -> bool:
        """Whether the span (of the new text) covers an edit, deletions inside it included."""
        k = bisect_right(self._ends, span[0])
        return k < len(self.pieces) and self.pieces[k][0] < span[1]


#: Letters of other scripts that look like ASCII letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "ι": "i",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "․": ".", "。": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
#: The digits as spelled in the languages of the corpus.
SPELLED = (
    ("zero", "oh", "zéro", "cero", "null"), ("one", "un", "une", "uno", "eins"), ("two", "deux", "dos", "zwei"), ("three", "trois", "tres", "drei"),
    ("four", "quatre", "cuatro", "vier"), ("five", "cinq", "cinco", "fünf"), ("six", "seis", "sechs"), ("seven", "sept", "siete", "sieben"),
    ("eight", "huit", "ocho", "acht"), ("nine", "neuf", "nueve", "neun"),
)
DIGIT_OF = {w: str(d) for d, ws in enumerate(SPELLED) for w in ws}
#: Words for the two signs.
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase"), ("dot", "punkt", "point", "punto")

_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]+")
_ODD = re.compile("[^\\x00-\\u02ff]|ı")
_DIGIT_WORD = "(?:" + "|".join(sorted(DIGIT_OF, key=len, reverse=True)) + ")"
_DOT_WORD, _AT_WORD = "(?:" + "|".join(DOT_WORDS) + ")", "(?:" + "|".join(AT_WORDS) + ")"
_NUMBER_ITEM = rf"(?:{_DIGIT_WORD}\b|[0-9]+)"
_SEP = rf"(?:[\s,\-]{{1,3}}|\s{{0,3}}\.\s{{0,3}}|\s{{1,3}}{_DOT_WORD}\s{{1,3}})"
#: A run that begins with a spelled digit, or with digits (perhaps after plus) straight before one.
_NUMBER_RUN = re.compile(rf"(?<!\w)(?:(?:plus\s{{1,3}}|\+\s?)?[0-9]{{1,4}}{_SEP})?(?:plus\s{{1,3}})?{_DIGIT_WORD}\b(?:{_SEP}{_NUMBER_ITEM})+", re.I)
_RUN_ITEM = re.compile(rf"(?P<plus>plus\s+|\+\s?)|(?P<word>{_DIGIT_WORD}\b)|(?P<digits>[0-9]+)|(?P<dot>\s*\.\s*|\s+{_DOT_WORD}\s+)|(?P<sep>[\s,\-]+)", re.I)
_LOOKALIKE = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OoIl](?:[\x20-]?[0-9OoIl]){8,22}(?![A-Za-z0-9])")
_LOOKALIKE_DIGIT = {"O": "0", "o": "0", "I": "1", "l": "1"}
_OPEN, _CLOSE = r"\s{0,3}[(\[{<]\s{0,3}", r"\s{0,3}[)\]}>]\s{0,3}"
_BRACKET_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-]){_OPEN}(?:{_AT_WORD}|@){_CLOSE}(?=[A-Za-z0-9])", re.I)
_BRACKET_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}(?=[A-Za-z0-9])", re.I)
_LABEL = r"[A-Za-z0-9-]{1,63}"
_SPELLED_DOMAIN = rf"{_LABEL}(?:(?:\s{{1,3}}{_DOT_WORD}\s{{1,3}}|\.){_LABEL})+"
#: ``name at host dot tld``: both signs spelled, or an at-sign before a host with spelled dots.
_SPELLED_EMAIL = re.compile(rf"(?:\s{{1,3}}{_AT_WORD}\s{{1,3}}|\s?@\s?)(?={_LABEL}\s{{1,3}}{_DOT_WORD}\s{{1,3}}[A-Za-z])|\s{{1,3}}{_AT_WORD}\s{{1,3}}(?={_LABEL}\.{_LABEL}\s{{1,3}}{_DOT_WORD}\s{{1,3}}[A-Za-z])", re.I)
#: ``j.smith42 at mail.example.com``: a spelled at-sign before a written host, after a name that is no plain word.
_AT_HOST = re.compile(rf"(?<=[A-Za-z0-9])\s{{1,3}}{_AT_WORD}\s{{1,3}}(?=(?:[A-Za-z0-9-]{{1,63}}\.){{1,5}}[a-z]{{2,6}}\b(?![@.\w]))", re.I)
_SPELLED_DOT = re.compile(rf"\s{{1,3}}{_DOT_WORD}\s{{1,3}}", re.I)
_HOST_AFTER = re.compile(rf"\s?@\s?({_SPELLED_DOMAIN})", re.I)
_NAME_BEFORE = re.compile(rf"(?:[A-Za-z0-9_%+-]{{1,64}}\s{{1,3}}{_DOT_WORD}\s{{1,3}}){{1,4}}[A-Za-z0-9_%+-]{{1,64}}\Z", re.I)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?:\x20{1,2}@\x20{0,2}|@\x20{1,2})(?=(?:[A-Za-z0-9-]{1,63}\.){1,5}[A-Za-z]{2,6}\b)")
_IDENTIFIER = re.compile(r"[0-9._%+-]")
_HINT_AT = re.compile(r"@\s|\s@")
_HINT_BRACKET = re.compile(rf"[(\[{{<]\s{{0,3}}(?:{_AT_WORD}|{_DOT_WORD}|@|\.)\s{{0,3}}[)\]}}>]", re.I)
_HINT_HOST = re.compile(rf"\s{_AT_WORD}\s{{1,3}}[A-Za-z0-9-]{{1,63}}\.[A-Za-z0-9-]", re.I)
_HINT_DIGITS = re.compile(rf"(?<!\w){_DIGIT_WORD}{_SEP}{_NUMBER_ITEM}{_SEP}{_NUMBER_ITEM}", re.I)
_FOLDED_WORD = re.compile(r"[^\W_]+")
_DOT_SET, _DIGIT_SET = frozenset(w.encode() for w in DOT_WORDS), frozenset(w.encode() for w in DIGIT_OF)


def plain_characters(text: str) -> list[tuple[int, int, str]]:
    """Invisible characters vanish; homoglyphs, full-width forms and digits of any script become ASCII."""
    out = [(m.start(), m.end(), "") for m in _INVISIBLE.finditer(text)]
    for m in _ODD.finditer(text):
        c = m[0]
        new = HOMOGLYPHS.get(c)
        if new is None:
            d = unicodedata.decimal(c, None)
            new = str(d) if d is not None else unicodedata.normalize("NFKC", c)
        if len(new) == 1 and new.isascii() and not new.isspace():
            out.append((m.start(), m.end(), new))
    return sorted(out)


def digits(text: str) -> list[tuple[int, int, str]]:
    """Runs with three spelled digits or more, and long numbers in which letters stand for digits."""
    out = []
    for m in _NUMBER_RUN.finditer(text):
        items = [(i, i.lastgroup) for i in _RUN_ITEM.finditer(text, m.start(), m.end())]
        if sum(kind == "word" for _, kind in items) < 3:
            continue
        for i, kind in items:
            new = {"plus": "+", "word": DIGIT_OF.get(i[0].lower(), ""), "digits": i[0], "dot": ".", "sep": ""}[kind]
            out.append((i.start(), i.end(), new))
    taken = [(a, b) for a, b, _ in out]
    for m in _LOOKALIKE.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 6 and not any(a < m.end() and m.start() < b for a, b in taken):
            out += [(m.start() + k, m.start() + k + 1, _LOOKALIKE_DIGIT[c]) for k, c in enumerate(m[0]) if c in _LOOKALIKE_DIGIT]
    return sorted(out)


def at_signs(text: str) -> list[tuple[int, int, str]]:
    """Bracketed and spelled at-signs, and spaces around a written one."""
    out = [(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(text)]
    out += [(m.start(), m.end(), "@") for m in _SPELLED_EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(text)]
    for m in _AT_HOST.finditer(text):
        name = _LOCAL.search(text, max(0, m.start() - 64), m.start())
        if name and _IDENTIFIER.search(name[0].strip(".")):
            out.append((m.start(), m.end(), "@"))
    return sorted(out)


def dots(text: str) -> list[tuple[int, int, str]]:
    """Bracketed dots, and spelled ones beside an at-sign."""
    out = [(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(text)]
    for m in _HOST_AFTER.finditer(text):
        out += [(d.start(), d.end(), ".") for d in _SPELLED_DOT.finditer(text, m.start(1), m.end(1))]
        name = _NAME_BEFORE.search(text, max(0, m.start() - 330), m.start())
        if name:
            out += [(d.start(), d.end(), ".") for d in _SPELLED_DOT.finditer(text, name.start(), name.end())]
    return sorted(out)


def number_groups(text: str) -> Iterator[Span]:
    """Cards written side by side: groups between separators of a run that is no card as a whole."""
    for m in _CARD.finditer(text):
        if not is_card(m[0]):
            yield from ((m.start() + g.start(), m.start() + g.end()) for g in re.finditer("[0-9]+", m[0]) if is_card(g[0]))


def disguised(text: str) -> bool:
    """Cheap look for anything that a transducer could rewrite."""
    if not text.isascii() and (_ODD.search(text) or _INVISIBLE.search(text)):
        return True
    if ("@" in text and _HINT_AT.search(text)) or (any(c in text for c in "([{<") and _HINT_BRACKET.search(text)) or _HINT_HOST.search(text):
        return True
    # Beyond ASCII, capitals, blanks and quotes are to be told apart from letters as the transducers do.
    ws = words(text) if text.isascii() else [w.encode() for w in _FOLDED_WORD.findall(text.replace("İ", "i").casefold())]
    if not _DOT_SET.isdisjoint(ws) or (sum(map(_DIGIT_SET.__contains__, ws)) >= 2 and _HINT_DIGITS.search(text)):
        return True
    return bool(_DIGIT.search(text) and _LOOKALIKE.search(text))


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the normalised text shows, as source positions, none of which meets a base span of its kind."""
    found: dict[str, set[Span]] = {kind: set() for kind in KINDS}
    if _DIGIT.search(text):
        found["card"].update(number_groups(text))
    if disguised(text):
        stages, now = [], text
        for rewrite in (plain_characters, at_signs, dots, digits):
            stages.append(Edited(now, rewrite(now)))
            now = stages[-1].text
        for kind, spans in detect(now).items():
            for span in spans:
                touched = False
                for stage in reversed(stages):
                    touched = touched or stage.touched(span)
                    span = stage.back(span)
                if touched:
                    found[kind].add(span)
    out: dict[str, list[Span]] = {}
    for kind, spans in found.items():
        out[kind], end = [], -1
        starts = [a for a, _ in base[kind]]
        for a, b in sorted(spans):
            k = bisect_left(starts, b) - 1
            if a >= end and not (k >= 0 and base[kind][k][1] > a):
                out[kind].append((a, b))
                end = b
    return out


def spans_of(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base and added spans by kind; a null text counts as empty."""
    base = detect(text or "")
    return base, added_spans(text, base) if text else {kind: [] for kind in KINDS}


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


SCHEMA = "doc_id long, base struct<email:long,ip:long,card:long,phone:long>, base_spans string, spans string, n_added long"


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data of every document: doc_id, base (counts by kind), base_spans, spans (kind:start:end, code points), n_added.

    One row per row of ``docs``; only doc_id and text are read, so extra columns never clash. Null and empty texts have
    no spans; an empty table gives an empty table; repeated rows are answered alike. Every detector and transducer is
    linear in the text, so very long texts need no cut.
    """

    def find(batches):
        for b in batches:
            ids, base, first, every, added = b["doc_id"].to_pylist(), [], [], [], []
            for text in b["text"].to_pylist():
                own, more = spans_of(text)
                base.append({kind: len(own[kind]) for kind in KINDS})
                first.append(joined(own))
                every.append(joined({kind: own[kind] + more[kind] for kind in KINDS}))
                added.append(sum(map(len, more.values())))
            yield {"doc_id": ids, "base": base, "base_spans": first, "spans": every, "n_added": added}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), find, SCHEMA)
