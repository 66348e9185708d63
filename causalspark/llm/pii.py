"""Personal data, also where it is disguised, with offsets in the source text.

Plain detectors find e-mail addresses, IP addresses, payment cards and telephone numbers. Where a text shows signs of
disguise, transducers rewrite it: look-alike characters to ASCII, invisible characters to nothing, spelled digits to
digits, and bracketed or spelled "at" and "dot" to their signs. A transducer's output carries, for every character, the
source span it came from, so transducers compose and what the detectors find in the rewritten text maps back to source
characters. Such a span is added where no plain span of its kind overlaps it.

All detectors are linear in the text. Defined cases: null and empty texts have no spans; a null doc_id stays null;
repeated rows give repeated results; an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalspark.llm.frames import map_rows

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# An address lies in one run of digits and points; starting inside a run of digits finds nothing that its head does not.
_DOTTED = re.compile(r"[0-9][0-9.]{6,}")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def plain_spans(text: str) -> list[Span]:
    """The spans of undisguised data: leftmost and without overlap in each kind."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in (m for run in _DOTTED.finditer(text) for m in _IP.finditer(text, run.start(), run.end())):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# ---------------------------------------------------------------- transducers

@dataclass
class Traced:
    """A text and, for each of its characters, the source span that it stands for."""

    text: str
    starts: list[int]
    ends: list[int]

    @classmethod
    def source(cls, text: str) -> Traced:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, pattern: re.Pattern, output: Callable[[re.Match], list[tuple[str, int, int]]]) -> Traced:
        """Each match becomes output characters (character, start, end in this text); the rest is copied."""
        parts, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            parts.append(self.text[at:m.start()])
            starts += self.starts[at:m.start()]
            ends += self.ends[at:m.start()]
            for char, s, e in output(m):
                parts.append(char)
                starts.append(self.starts[s])
                ends.append(self.ends[e - 1])
            at = m.end()
        return Traced("".join([*parts, self.text[at:]]), starts + self.starts[at:], ends + self.ends[at:])


    def replace(self, table: dict[str, str]) -> Traced:
        """Each character becomes what the table says (one character or nothing)."""
        chars = [table.get(c, c) for c in self.text]
        kept = [i for i, c in enumerate(chars) if c]
        return Traced("".join(chars), [self.starts[i] for i in kept], [self.ends[i] for i in kept])


# Letters of other scripts that look like ASCII letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z", "ı": "i", "․": ".", "。": ".", "٫": ".", "﹫": "@",
}
#: Characters that are not seen: soft hyphen, zero-width ones, direction marks, joiners, byte order mark.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\ufeff"
#: Last labels that an address with a bare spoken "at" must end in, as "at" and "dot" are words too (fixed values): all
#: country codes, and common longer ones.
TOP_DOMAINS = frozenset("""
    ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv
    cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie
    il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt
    mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl
    sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw
    com org net edu gov mil int info biz dev app xyz online site website shop store tech club top name pro mobi jobs travel cat asia coop aero museum tel
    post arpa blog cloud email live news page wiki work world zone agency digital media network systems solutions group company academy space host press
    fun life link click design studio services support global center city berlin london nyc paris tokyo bank law health care school foundation""".split())
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def _lookalike_table() -> dict[str, str]:
    """LOOKALIKES, and by rule: decimal digits of other scripts, compatibility forms of one ASCII character, dashes, spaces."""
    table = dict(LOOKALIKES) | dict.fromkeys(INVISIBLE, "")
    for code in [*range(0x2000, 0x2070), *range(0x0660, 0x066A), *range(0x06F0, 0x06FA), *range(0x0966, 0x0970), *range(0x2460, 0x2474), *range(0xFE50, 0xFE6C),
                 *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        char = chr(code)
        if char in table:
            continue
        plain, kind = unicodedata.normalize("NFKC", char), unicodedata.category(char)
        if kind == "Nd":
            table[char] = str(unicodedata.digit(char))
        elif len(plain) == 1 and plain.isascii() and plain != char:
            table[char] = plain
        elif kind == "Pd":
            table[char] = "-"
        elif kind == "Zs":
            table[char] = " "
    return table | {"\u00a0": " "}


_TABLE = _lookalike_table()
_LOOKS = frozenset(_TABLE)
_NARROW = tuple(c for c in _TABLE if c < "\u0100")  # those that a text in Latin letters may hold
_WORD = "|".join(DIGITS) + "|oh"
_SPELLED = re.compile(rf"(?<![^\W_])(?:(plus)[\s,-]+)?(?:{_WORD})(?:[\s,.-]{{1,3}}(?:{_WORD})){{6,}}(?![^\W_])", re.I)
_ONE = re.compile(_WORD, re.I)
_BRACKETED = re.compile(r"\s?[\[({<]\s?(at|dot|@|\.)\s?[\])}>]\s?", re.I)
_BRACKETED_SIGN = re.compile(r"[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]", re.I)
_DIGIT_WORDS = frozenset((*DIGITS, "oh"))
_GAPS = str.maketrans(",.-", "   ")
_AT_HOST = re.compile(r"\sat\s[a-z0-9-]++\.[a-z0-9-]")
_SPOKEN = re.compile(r"(?<=[A-Za-z0-9_%+-])\sat\s(?=[A-Za-z0-9-]+(?:\sdot\s|\.)[A-Za-z0-9-])|(?<=[A-Za-z0-9-])\sdot\s(?=[A-Za-z0-9-])", re.I)


def _digits(m: re.Match) -> list[tuple[str, int, int]]:
    out, at = [], m.start()
    if m[1]:
        out.append(("+", m.start(1), m.end(1)))
        at = m.end(1)
    for w in _ONE.finditer(m.string, at, m.end()):
        word = w[0].lower()
        out.append((str(DIGITS.index(word)) if word != "oh" else "0", w.start(), w.end()))
    return out


def _sign(m: re.Match) -> list[tuple[str, int, int]]:
    word = (m[1] if m.re is _BRACKETED else m[0].strip()).lower()
    return [("@" if word in ("at", "@") else ".", m.start(), m.end())]


def _has_looks(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _LOOKS.isdisjoint(text)
    return any(c in text for c in _NARROW)


def _has_spelled(low: str) -> bool:
    """Whether seven digit words may follow each other: the five inner ones have only gaps beside them."""
    if sum(map(low.count, _DIGIT_WORDS)) < 7:
        return False
    return b"\1" * 5 in bytes(map(_DIGIT_WORDS.__contains__, low.translate(_GAPS).split()))


def _has_signs(text: str, low: str) -> bool:
    return ("dot" in low and bool(re.search(r"\sdot\s", low)) or any(c in text for c in "[({<") and bool(_BRACKETED_SIGN.search(text))
            or bool(_AT_HOST.search(low)))


def disguised_spans(text: str) -> list[Span]:
    """Spans found after rewriting, in source offsets; none where the text shows no sign of disguise."""
    low = text.lower()
    looks = _has_looks(text)
    signs = not looks and _has_signs(text, low)
    spelled = looks or (_has_spelled(low) and bool(_SPELLED.search(text)))
    if not (looks or signs or spelled):
        return []
    traced = Traced.source(text)
    if looks:
        traced = traced.replace(_TABLE)
        signs = _has_signs(traced.text, traced.text.lower())  # "dot" and brackets may be disguised themselves
    runs: list[Span] = []
    if spelled:
        for m in _SPELLED.finditer(traced.text):
            said = "".join(c for c, _, _ in _digits(m)).lstrip("+")
            if 8 <= len(said) <= 15 or (16 <= len(said) <= 19 and luhn(said)):
                runs.append(("phone" if len(said) <= 15 else "card", traced.starts[m.start()], traced.ends[m.end() - 1]))
        traced = traced.rewrite(_SPELLED, _digits)
    written = {traced.starts[m.start()]: m[0].strip()[0] for m in _BRACKETED.finditer(traced.text)}  # bracket of each sign, by its source
    traced = traced.rewrite(_BRACKETED, _sign)
    if signs:
        written |= {traced.starts[m.start()]: "word" for m in _SPOKEN.finditer(traced.text)}
        traced = traced.rewrite(_SPOKEN, _sign)
    return runs + [(k, traced.starts[s], traced.ends[e - 1]) for k, s, e in plain_spans(traced.text)
                   if k != "email" or not written or _is_address(traced, written, s, e)]


def _is_address(traced: Traced, written: dict[int, str], s: int, e: int) -> bool:
    """Whether the signs of an address are no prose: bare words, and brackets of different kinds, need a known last label."""
    at = traced.text.index("@", s, e)
    sign = written.get(traced.starts[at], "")
    points = {written.get(traced.starts[i], "") for i in range(at + 1, e) if traced.text[i] == "."}
    brackets = points - {"", "word"}
    if sign == "word":
        sure = bool(brackets)
    else:
        sure = not sign or not brackets or sign in brackets
    host = traced.text[at + 1:e]
    label = host.rpartition(".")[2]
    if sign == "word" and points == {""} and (host[:4].lower() == "www." or traced.text[e:e + 1] == "/" or label.istitle()):
        return False  # "see it at www.example.com", "at example.com/page", "at home.It was"
    return sure or label.lower() in TOP_DOMAINS


def _order(spans) -> list[Span]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find_pii(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans and all spans, each by kind and start."""
    base = _order(plain_spans(text))
    found = list(base)
    for kind, s, e in _order(disguised_spans(text)):
        if not any(k == kind and s < be and bs < e for k, bs, be in found):
            found.append((kind, s, e))
    return base, _order(found)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (plain spans), base_sha256, spans (all), n_added."""
    def make():
        def step(columns):
            out = []
            for text in columns[1]:
                base, found = find_pii(text)
                kinds = [k for k, _, _ in base]
                out.append([*map(kinds.count, KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), len(found) - len(base)])
            return [columns[0], *map(list, zip(*out, strict=True))]
        return step
    rows = docs.select(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return map_rows(rows, make, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets (of overlapping spans the first)."""
    def clean(text: str) -> str:
        parts, at = [], 0
        for kind, s, e in sorted(find_pii(text)[1], key=lambda x: (x[1], -x[2])):
            if s >= at:
                parts += [text[at:s], f"[{kind}]"]
                at = e
        return "".join([*parts, text[at:]])
    rows = docs.select(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return map_rows(rows, lambda: lambda columns: [columns[0], list(map(clean, columns[1]))], "doc_id bigint, text string")
