r"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds and their spans follow fixed rules (leftmost, non-overlapping per kind, failing
matches dropped without another try):

* ``email``, ``ip`` (four parts of at most 255), ``card`` (13 to 19 digits that pass Luhn),
  ``phone`` (``+`` and 9 to 15 digits).

Further kinds add spans and never remove base ones:

* ``iban``: country, check digits and 11 to 30 characters that pass mod 97;
* ``phone_local``: a number in the form ``(ddd) ddd-dddd`` or ``ddd-ddd-dddd``;
* ``national_id``: ``ddd-dd-dddd`` outside the ranges that are never issued;
* ``secret``: the value that a name like ``token`` or ``api_key`` is set to, of 16 or more characters whose
  entropy is at least ``ENTROPY`` bits each; strings with a published key prefix; the header of a private key.

Score of a span: the start value of its kind, raised by a passed checksum and by a word that
names such data within ``NEAR`` characters before it, lowered by a word that speaks for other
numbers (order, version, ...).  Added kinds count from ``KEEP`` on; base kinds always.

Edge cases: a null or empty text has no spans; a null ``doc_id`` is kept as it is; repeated rows
are scanned one by one; an empty table gives an empty result; columns other than the two named
ones are ignored.  A text is searched as a whole, however long; every pattern runs in time that
is linear in the text (the e-mail rule walks back from each ``@``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "iban", "phone_local", "national_id", "secret")
BASE_KINDS = KINDS[:4]
NEAR = 40
KEEP = 0.5
ENTROPY = 2.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACKWARDS = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9-])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SET = re.compile(
    r"(?ai)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer)[\"']?"
    r"(?:\s{0,9}[:=]\s{0,9}|\s)[\"']?([A-Za-z0-9+/_.~-]{16,}=*)")
_PREFIXED = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{16,}"
    r"|AIza[A-Za-z0-9_-]{35})|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
#: A text without any of these holds no secret.
_TELLING = ("token", "secret", "passw", "pwd", "key", "credential", "bearer")
_KEY_STARTS = ("AKIA", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "sk_", "xox", "AIza", "-----BEGIN ")
_DIGITS = re.compile(r"[0-9]")

START = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.5, "phone_local": 0.5, "national_id": 0.4, "secret": 0.5}
CONTEXT = {
    "email": "mail email contact write",
    "ip": "ip address host server login",
    "card": "card credit visa payment pay account",
    "phone": "phone call tel mobile fax reach",
    "iban": "iban bank account transfer",
    "phone_local": "phone call tel mobile fax reach",
    "national_id": "ssn social security national identity id",
    "secret": "token secret password key login auth",
}
AGAINST = frozenset("order version invoice isbn issn sku model item ticket page lines".split())
_WORD = re.compile(r"[a-z]+")
_CONTEXT = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float
    checked: bool


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of an international account number, blanks removed."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def entropy(value: str) -> float:
    """Bits per character by the frequencies of the characters."""
    counts = [value.count(c) / len(value) for c in set(value)]
    return -sum(c * log2(c) for c in counts)


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values set to a telling name, and strings with the prefix of a key; the first of overlapping ones."""
    small, found = text.lower(), []
    if any(name in small for name in _TELLING):
        found = [m.span(1) for m in _SET.finditer(text) if _DIGITS.search(m.group(1)) and entropy(m.group(1)) >= ENTROPY]
    if any(mark in text for mark in _KEY_STARTS):
        found += [m.span() for m in _PREFIXED.finditer(text)]
    done = -1
    for start, end in sorted(found):
        if start >= done:
            yield start, end
            done = end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern ``local@label.label...``; the local part reaches back to the previous match at most."""
    done = seen = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        # characters of the local part contain no @, so each is looked at once
        back = _LOCAL_BACKWARDS.match(text[max(done, seen):at][::-1]).end()
        seen = at + 1
        if back:
            yield at - back, m.end()
            done = m.end()


def _matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e, False
    for s, e in _secrets(text):
        yield "secret", s, e, True
    if not _DIGITS.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            yield "ip", m.start(), m.end(), False
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() <= 37 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end(), True
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                yield "phone", m.start(), m.end(), False
    for m in _IBAN.finditer(text):
        found = m.group()  # may run on into following words: those are taken off one by one
        while found and not (15 <= len(a := found.replace(" ", "")) <= 34 and mod97(a)):
            found = found.rpartition(" ")[0]
        if found:
            yield "iban", m.start(), m.start() + len(found), True
    if "-" in text:
        for m in _LOCAL_PHONE.finditer(text):
            yield "phone_local", m.start(), m.end(), False
        for m in _NATIONAL.finditer(text):
            yield "national_id", m.start(), m.end(), False


def find_spans(text: str | None) -> list[Span]:
    """All spans of one text, ordered by kind as listed, then start."""
    out = []
    for kind, start, end, checked in _matches(text or ""):
        near = set(_WORD.findall(text[max(0, start - NEAR):start].lower()))
        score = START[kind] + 0.4 * checked + 0.3 * bool(near & _CONTEXT[kind]) - 0.3 * bool(near & AGAINST)
        if kind in BASE_KINDS or score >= KEEP:
            out.append(Span(kind, start, end, round(min(1.0, max(0.0, score)), 3), checked))
    return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start))


SPAN_SCHEMA = "array<struct<kind:string,start:bigint,end:bigint,score:double,checked:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                 ("score", pa.float64()), ("checked", pa.bool_())]))


def pii_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, spans)``: the scored spans of every whole text, in code points, end exclusive."""
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s.__dict__ for s in find_spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_TYPE)], ["key", "spans"])

    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        scan, f"key {kind}, spans {SPAN_SCHEMA}")
    return out.withColumnRenamed("key", key)


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()
