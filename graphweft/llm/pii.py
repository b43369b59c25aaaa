"""Personal data, found through disguises and reported where it stands in the source.

Base identifiers are found in the text as it is. Then transducers rewrite a copy: look-alike
letters and digits to ASCII, invisible characters to nothing; spelled digits to digits;
``at`` and ``dot`` in their disguises to the signs. Each keeps the map to what it read, so
what is found in the copy is reported as a span of the source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import dealt, map_batches, quoted
from .spans import Mapped, joined, sha256

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Letters of other scripts that look like ASCII ones, and the letters they look like.
LOOK_ALIKE = dict(zip("АВЕКМНОРСТХаеосрхуіјѕԁӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναρ", "ABEKMHOPCTXaeocpxyijsdlABEZHIKMNOPTYXovap", strict=True))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
SIGNS = {"\ufe6b": "@", "\u2024": ".", "\u3002": ".", "\uff61": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " "}
#: Digits as words: English, German, French, Spanish.
DIGITS = {w: str(i) for i, ws in enumerate(("zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")) for w in ws.split()}
#: Grouped by first letter, longest first, so that most words are passed by after one comparison.
_DIGIT = "(?:" + "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in DIGITS if w[0] == c), key=len, reverse=True))})" for c in sorted({w[0] for w in DIGITS})) + ")"
_SPELLED = re.compile(rf"\b(?:plus[ -]{{1,3}})?(?:{_DIGIT}|[0-9]{{1,4}})(?:(?:[ ,.()-]{{1,3}}|[ ]{{1,2}}(?:dot|point|punkt|punto)[ ]{{1,2}})(?:{_DIGIT}|[0-9]{{1,4}})\b)++")
_UNIT = re.compile(rf"plus|dot|point|punkt|punto|{_DIGIT}|[0-9]+|[ ,.()-]+")
_ODD = re.compile("[^\x00-\u024f]|[\u00ad\u00a0]")
_SIGN = r"[ \t]{0,3}[\[({<][ \t]{0,3}%s[ \t]{0,3}[\])}>][ \t]{0,3}"
_AT = "(?:" + _SIGN % "(?:at|@|arroba|ät)" + "|&#0{0,3}64;|&commat;)"
_DOT = "(?:" + _SIGN % r"(?:dot|\.|punkt|point|punto)" + "|&#0{0,3}46;|&period;)"
_BARE_DOT = r"[ \t]{1,3}(?:dot|punkt|punto)[ \t]{1,3}"
_DISGUISED = re.compile(
    rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+(?:(?:{_DOT}|{_BARE_DOT})[a-z0-9_%+-]{{1,64}}+){{0,4}}+"
    rf"(?:(?:{_AT}|[ \t]{{1,3}}@[ \t]{{1,3}})[a-z0-9-]{{1,63}}+(?:(?:{_DOT}|{_BARE_DOT}|\.)[a-z0-9-]{{1,63}}+){{1,6}}+"
    rf"|(?:@|[ \t]{{1,3}}at[ \t]{{1,3}})[a-z0-9-]{{1,63}}+(?:\.[a-z0-9-]{{1,63}}+){{0,4}}+(?:(?:{_DOT}|{_BARE_DOT})[a-z0-9-]{{1,63}}+)(?:(?:{_DOT}|{_BARE_DOT}|\.)[a-z0-9-]{{1,63}}+){{0,4}}+)"
)
_GLUED = re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9.+]{1,64}+(?:[_-](?!at[_-])[a-z0-9.+]{1,64}+){0,3}+([_-]at[_-])[a-z0-9]{1,63}+(?:[_-]dot[_-][a-z0-9]{1,63}+){1,4}+")
_GLUED_DOT = re.compile(r"(?i)[_-]dot[_-]")
_SPLIT_IP = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}+(?:(?:{_DOT}|{_BARE_DOT}|\.)[0-9]{{1,3}}+){{3}}+(?![0-9])")
_ANY_DOT = re.compile(rf"(?i){_DOT}|{_BARE_DOT}")
#: Letters that stand for digits among digits.
_DIGIT_LETTERS = str.maketrans("OoIl", "0011")
_NUMBER = re.compile("[0-9]")
_LETTERED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OoIl](?:[ .()-]{0,2}[0-9OoIl]){8,24}(?![A-Za-z0-9])")
_HINT = re.compile(rf"(?i){_AT}|{_DOT}|\bdot\b|\bpunkt\b|\bpunto\b|[ \t]@[ \t]")
_PARTS = re.compile(rf"(?i)({_AT}|[ \t]{{1,3}}@[ \t]{{1,3}}|[ \t]{{1,3}}at[ \t]{{1,3}})|({_DOT}|{_BARE_DOT})")


#: One of these is in every disguise of a sign: what is searched for first.
_SIGN_HINTS = ("dot", "punkt", "punto", "[", "(", "{", "<", "&", " @", "\t@")


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Of each dotted run of numbers, the first four, the next four and so on."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_small, four)):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def _look_alikes(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ODD.finditer(text):
        c = m[0]
        if c in INVISIBLE:
            new = ""
        elif "\uff01" <= c <= "\uff5e":
            new = chr(ord(c) - 0xFEE0)
        elif (n := unicodedata.decimal(c, None)) is not None:
            new = str(n)
        else:
            new = LOOK_ALIKE.get(c) or SIGNS.get(c)
        if new is not None:
            yield m.start(), m.end(), new


def _lowered(text: str) -> str:
    """Lower case at the same positions."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _SPELLED.finditer(_lowered(text)):
        out, words, digits, between = [], 0, 0, ""
        for unit in _UNIT.findall(m[0]):
            low = unit.lower()
            if low == "plus":
                out.append("+")
            elif low in ("dot", "point", "punkt", "punto"):
                between = "."
            elif low in DIGITS or unit.isdigit():
                if out and between == "." and out[-1] != "+":
                    out.append(".")
                out.append(DIGITS.get(low, unit))
                words += low in DIGITS
                digits += len(DIGITS.get(low, unit))
                between = ""
            elif "." in unit:
                between = "."
        if digits >= 4 and words >= 3 or digits >= 9 and out[0] == "+":
            yield m.start(), m.end(), "".join(out)


def _lettered(text: str) -> Iterator[tuple[int, int, str]]:
    if not _NUMBER.search(text):
        return
    for m in _LETTERED.finditer(text):
        letters = sum(c in "OoIl" for c in m[0])
        if letters and 3 * letters <= sum(c in "OoIl0123456789" for c in m[0]):
            yield m.start(), m.end(), m[0].translate(_DIGIT_LETTERS)


def _signs(text: str) -> Iterator[tuple[int, int, str]]:
    low = text.lower()
    if not any(x in low for x in _SIGN_HINTS) or not _HINT.search(text) and not _ANY_DOT.search(text):
        return
    found = [(p.start(), p.end(), "@" if p[1] else ".") for m in _DISGUISED.finditer(text) for p in _PARTS.finditer(text, m.start(), m.end())]
    found += [(p.start(), p.end(), ".") for m in _SPLIT_IP.finditer(text) for p in _ANY_DOT.finditer(text, m.start(), m.end())]
    last = 0
    for s, e, new in sorted(found):
        if s >= last:
            yield s, e, new
            last = e


def _glued(text: str) -> Iterator[tuple[int, int, str]]:
    low = text.lower()
    if not any(x in low for x in ("_at_", "_at-", "-at_", "-at-")):
        return
    for m in _GLUED.finditer(text):
        yield m.start(1), m.end(1), "@"
        for p in _GLUED_DOT.finditer(text, m.end(1), m.end()):
            yield p.start(), p.end(), "."


def normalise(text: str) -> Mapped:
    """The text with its disguises undone."""
    out = Mapped(text)
    for transducer in (_look_alikes, _spelled, _lettered, _signs, _glued):
        if edits := list(transducer(out.text)):
            out = out.edit(edits)
    return out


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and those found only in the normalised text, by kind and start, in code points."""
    base = {k: list(f(text)) for k, f in FINDERS.items()}
    added, plain = [], normalise(text)
    if plain.below is not None:
        for kind, finder in FINDERS.items():
            known, at = base[kind], 0
            for s, e in finder(plain.text):
                span = plain.source(s, e)
                while at < len(known) and known[at][1] < span[1]:
                    at += 1
                within = at < len(known) and known[at][0] <= span[0]
                if text[span[0] : span[1]] != plain.text[s:e] and not within:
                    added.append((kind, *span))
    return [(k, s, e) for k in KINDS for s, e in base[k]], added


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row.

    Counts and digest are of the base spans; ``spans`` holds them and the ``n_added`` found
    through disguises, ``kind:start:end`` in code points, by kind and start. A null text is
    empty; repeated rows give equal rows; an empty table gives an empty result. Work is in
    proportion to a text's length, runs of one character included.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans, more = [[] for _ in KINDS], [], [], []
        for text in batch.column(1).to_pylist():
            base, added = find(text or "")
            for c, k in zip(counts, KINDS, strict=True):
                c.append(sum(b[0] == k for b in base))
            digests.append(sha256(joined(base)))
            spans.append(joined(sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
            more.append(len(added))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    return map_batches(dealt(source), run, f"id {kind}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, n_added long").withColumnRenamed("id", id_col)
