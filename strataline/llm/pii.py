"""Personal data in texts, also behind look-alike letters, spelled digits and written-out signs (operator 8)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import batch, columns_of, map_slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Base patterns. Fixed values; possessive where that changes no match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From every @ the domain after it, matched once, then the local part back to the end of the match before: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL_LETTERS:
                start -= 1
            if start < at:
                done = domain.end()
                yield start, done
        at = text.find("@", max(done, at + 1))


def find_plain(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, without those that fail their check."""
    found: list[Span] = [("email", s, e) for s, e in _emails(text)]
    if _has_digit(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _digits(m.group())
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    found.append(("phone", *m.span()))
    return found


_DIGIT = re.compile(r"[0-9]")


def _has_digit(text: str) -> bool:
    return _DIGIT.search(text) is not None


# Look-alikes of ASCII letters in Cyrillic and Greek, in the order of the ASCII letters under them. Fixed values.
_LOOK = dict(
    zip(
        "АВСЕНІЈКМОРЅТХУасеһіјорѕхуԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα",
        "ABCEHIJKMOPSTXYacehijopsxydqwABEZHIKMNOPTYXoa",
        strict=True,
    )
)
# Characters that show nothing, and signs that stand for ASCII ones. Fixed values.
_HIDDEN = "".join(map(chr, (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
_SIGNS = dict.fromkeys(map(chr, (0x2024, 0x3002, 0xFF61, 0x00B7)), ".")
_SIGNS |= dict.fromkeys(map(chr, (0x2010, 0x2011, 0x2012, 0x2013, 0x2212)), "-")
_SIGNS |= dict.fromkeys(map(chr, (0x00A0, 0x2007, 0x202F)), " ")
_ALIKE: dict[str, str] = _LOOK | dict.fromkeys(_HIDDEN, "") | _SIGNS | {chr(0xFEE0 + c): chr(c) for c in range(33, 127)}
_ALIKE |= {chr(base + d): chr(48 + d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_ALIKE_AT = re.compile("[" + re.escape("".join(_ALIKE)) + "]")

# Digit words by value, in the languages handled. Fixed values.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
# A run of spelled digits long enough for an identifier part; groups may be set apart by signs or "dot".
_PLUS = "(?:plus|più|piu|más|mas)"  # before a run: the sign of a phone number
_DIGIT_RUN = re.compile(rf"(?<!\w)(?P<plus>{_PLUS}[ ,.()-]{{1,3}})?{_DIGIT_WORD}(?:(?:[ ,.()-]{{1,3}}|[ ]?(?:dot|point)[ ]?){_DIGIT_WORD}){{3,}}(?!\w)", re.IGNORECASE)
_ONE_DIGIT_WORD = re.compile(rf"(?<!\w){_DIGIT_WORD}(?!\w)", re.IGNORECASE)
_DIGIT_HINT = re.compile(r"(?:ero|two|ree|our|ive|six|eve|igh|ine|ins|wei|rei|ier|ünf|sechs|sie|acht|neun|éro|deux|trois|quatre|cinq|sept|huit|neuf|uno|dos|tres|cuat|cinco|seis|iete|ocho|nuev)", re.IGNORECASE)

# at and dot written out: in brackets, or as words of their own. The hint finds all that the rules for addresses accept.
_AT = r"(?:[ ]?[(\[{<][ ]?(?:at|@|arroba|ät)[ ]?[)\]}>][ ]?|[ ](?:at|arroba|ät)[ ]|[ ]?@[ ]?)"
_DOT = r"(?:[ ]?[(\[{<][ ]?(?:dot|punkt|point|punto|\.)[ ]?[)\]}>][ ]?|[ ](?:dot|punkt|point|punto)[ ]|\.)"
_LOCAL = r"[A-Za-z0-9_%+-]++(?:(?:[ ]?[(\[{<][ ]?(?:dot|punkt|point|punto)[ ]?[)\]}>][ ]?|[ ](?:dot|punkt|point|punto)[ ]|\.)[A-Za-z0-9_%+-]++)*+"
_WRITTEN_LOCAL = re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}", re.IGNORECASE)
_WRITTEN_AT = re.compile(_AT, re.IGNORECASE)
_WRITTEN_DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++", re.IGNORECASE)
_WRITTEN_IP = re.compile(rf"(?<![A-Za-z0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![A-Za-z0-9])", re.IGNORECASE)
_DOT_AT = re.compile(_DOT, re.IGNORECASE)
_WRITTEN_HINT = re.compile(r"[(\[{<][ ]?(?:at|@|arroba|ät|dot|punkt|point|punto|\.)[ ]?[)\]}>]|[ ](?:dot|punkt|point|punto)[ ]|[ ](?:at|arroba|ät)[ ](?=[A-Za-z0-9-]++\.[A-Za-z0-9-])|[ ]@|@[ ]", re.IGNORECASE)


@dataclass
class Tape:
    """A rewritten text; character i stands for source characters start[i] to end[i]."""

    text: str
    start: list[int]
    end: list[int]

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace ranges (in order, not overlapping); every new character stands for its whole range."""
        text, start, end, done = [], [], [], 0
        for s, e, new in edits:
            text += [self.text[done:s], new]
            start += self.start[done:s]
            end += self.end[done:s]
            start += [self.start[s]] * len(new)
            end += [self.end[e - 1]] * len(new)
            done = e
        text.append(self.text[done:])
        return Tape("".join(text), start + self.start[done:], end + self.end[done:])

    def source(self, s: int, e: int) -> tuple[int, int]:
        return self.start[s], self.end[e - 1]


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Digit words of a run become digits, what stands between them goes or becomes a full stop, a plus word before them a sign."""
    out = []
    for run in _DIGIT_RUN.finditer(text):
        first = run.start()
        if run["plus"]:
            first = run.end("plus")
            out.append((*run.span("plus"), "+"))
        words = list(_ONE_DIGIT_WORD.finditer(text, first, run.end()))
        for i, word in enumerate(words):
            if i:
                between = text[words[i - 1].end() : word.start()]
                sign = "." if re.search(r"\.|dot|point", between, re.IGNORECASE) else ""
                out.append((words[i - 1].end(), word.start(), sign))
            out.append((*word.span(), _SPELLED[word.group().lower()]))
    return out


def _windows(text: str, hits: list[tuple[int, int]], reach: int = 160) -> list[tuple[int, int]]:
    """Ranges around the hits, merged. A disguise reaches no further than the reach and the word that stands there, however long."""
    out: list[list[int]] = []
    for s, e in hits:
        s, e = max(0, s - reach), min(len(text), e + reach)
        before = out[-1][1] if out else 0
        while s > before and not text[s - 1].isspace():
            s -= 1
        if out and s <= before:
            out[-1][1] = max(before, e)
        else:
            out.append([s, e])
        while out[-1][1] < len(text) and not text[out[-1][1]].isspace():
            out[-1][1] += 1
    return [(s, e) for s, e in out]


def _written_addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """Addresses with written-out signs: each chain of words and dots is walked once, as a local part that a sign and a domain follow."""
    local = _WRITTEN_LOCAL.search(text)
    while local:
        done = local.end()
        sign = _WRITTEN_AT.match(text, done)
        domain = _WRITTEN_DOMAIN.match(text, sign.end()) if sign else None
        if domain and _is_address(text, local, sign.group(), domain.group()):
            done = domain.end()
            yield local.start(), done, re.sub(_DOT_AT, ".", local.group()) + "@" + re.sub(_DOT_AT, ".", domain.group())
        local = _WRITTEN_LOCAL.search(text, done)


def find_disguised(text: str) -> list[Span]:
    """Identifiers that show only after normalising; spans in characters of the source."""
    hits = [m.span() for m in _WRITTEN_HINT.finditer(text)]
    if not text.isascii():
        hits += [m.span() for m in _ALIKE_AT.finditer(text)]
    hits += [m.span() for m in _DIGIT_RUN.finditer(text)] if _DIGIT_HINT.search(text) else []
    found: list[Span] = []
    for first, last in _windows(text, sorted(hits)):
        tape = Tape.of(text[first:last])
        tape = tape.rewrite([(m.start(), m.end(), _ALIKE[m.group()]) for m in _ALIKE_AT.finditer(tape.text)])
        tape = tape.rewrite(_spelled_edits(tape.text))
        tape = tape.rewrite(list(_written_addresses(tape.text)))
        tape = tape.rewrite([(*m.span(), re.sub(_DOT_AT, ".", m.group())) for m in _WRITTEN_IP.finditer(tape.text)])
        for kind, s, e in find_plain(tape.text):
            s, e = tape.source(s, e)
            found.append((kind, first + s, first + e))
    return found


# Words before an address, and words after which "at" tells a place, in the languages handled. Fixed values.
_CUE = re.compile(
    r"(?<!\w)(?:e-?mail\w*|mail\w*|contact\w*|kontakt\w*|address\w*|adress\w*|correo|write|writing|schreib\w*|écri\w*|escrib\w*|reach|ask)(?!\w)"
    r"[ :,;=-]{1,3}(?:(?:to|an|à|a|is|ist|est|es|for|für|with|me|us|him|her|them)[ :]{1,2}){0,2}$",
    re.IGNORECASE,
)
_NO_NAMES = frozenset("me us it him her them you i we they he she that this now here there uns mich ihn sie moi nous lui mí nos".split())


def _is_address(text: str, local: re.Match[str], sign: str, domain: str) -> bool:
    """A sign in brackets or an @ tells an address, as does a written-out dot in its domain. A bare "at" before plain full
    stops is mostly prose ("we met at example.com"): there a word such as "mail" or "write to" must stand before the name."""
    end = re.split(_DOT_AT, domain)[-1]
    if not 2 <= len(end) <= 12 or not end.isalpha():
        return False
    if any(c in sign for c in "([{<@") or re.search(r"[(\[{<]|[ ]", domain):
        return True
    return local.group().lower() not in _NO_NAMES and _CUE.search(text, max(0, local.start() - 40), local.start()) is not None


def find_private(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and spans that the disguises hide: those that no base span of their kind covers, the longest first of any that overlap."""
    if not text:
        return [], []
    base = find_plain(text)
    added: list[Span] = []
    for kind, s, e in sorted(set(find_disguised(text)), key=lambda x: (x[0], x[1] - x[2], x[1])):
        covered = any(k == kind and s2 <= s and e <= e2 for k, s2, e2 in base)
        if not covered and all(k != kind or e <= s2 or e2 <= s for k, s2, e2 in added):
            added.append((kind, s, e))
    return base, added


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Replace spans by their labels; overlapping ones become one, with the label of the first."""
    out, done = [], 0
    for s, e, label in sorted(spans):
        if s < done:
            if e > done:
                done = e
            continue
        out += [text[done:s], label]
        done = e
    return "".join([*out, text[done:]])


def _masked(text: str | None, base: list[Span], added: list[Span]) -> str | None:
    return mask(text, [(s, e, f"<{k}>") for k, s, e in (*base, *added)]) if base or added else text


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span that ``find_pii`` finds in the text replaced by its kind; all else unchanged."""
    names = docs.columns

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        masked = pa.array([_masked(t, *find_private(t)) for t in piece.column(text_col).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([masked if n == text_col else piece.column(n) for n in names], names=names)

    return map_slices(docs, run, columns_of(docs), text=text_col)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, masked.

    The counts and the digest are of the base patterns in the text as it stands. Transducers then rewrite
    look-alike letters and digits, spelled digits and written-out "at" and "dot", remembering for every
    character the source range it stands for; identifiers found there are mapped back and added to
    ``spans`` where no base span of their kind covers them. Offsets are code points, ends exclusive.
    ``masked`` is the text with every span replaced by its kind in angle brackets.

    Null and empty texts have no spans (null stays null); repeated rows and null ids give a row each; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = piece.column("text").to_pylist()
        found = [find_private(t) for t in texts]
        counts = {f"n_{k}": np.array([sum(s[0] == k for s in b) for b, _ in found], np.int64) for k in KINDS}
        return batch(
            id=piece.column("id"),
            **counts,
            base_sha256=pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], pa.string()),
            spans=pa.array([_joined([*b, *a]) for b, a in found], pa.string()),
            n_added=np.array([len(a) for _, a in found], np.int64),
            masked=pa.array([_masked(t, b, a) for t, (b, a) in zip(texts, found, strict=True)], pa.string()),
        )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    kind = rows.schema["id"].dataType.simpleString()
    return map_slices(rows, run, f"id {kind}, {counts}, base_sha256 string, spans string, n_added long, masked string").withColumnRenamed("id", id_col)
