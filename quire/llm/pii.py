"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in a text: at-signs, address schemes and identifier cues. From each
anchor a deterministic local parser grows outwards to the boundaries of what it stands for and validates it:

* ``@``: an e-mail address to both sides;
* ``://``, ``mailto:``, ``tel:``: an address whose authority has user data or a numeric host, a mailbox, a phone;
* cues (``iban``, ``account``, ``token``, ``ssn``, ...): the account or identifier behind ``=`` or ``:``;
* beginnings of keys (``AKIA``, ``ghp_``, ...): the key.

Dots behind a digit and plus signs anchor the numeric kinds ip and phone, runs of digits the kind card; the base rules
define these. Every parser reads a stretch of the text once, so the work follows the text's length whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices, with_texts

#: The base kinds, in the order of the contract, then those that the parsers add.
KINDS = ("email", "ip", "card", "phone", "address", "account", "secret")
RANK = {k: i for i, k in enumerate(KINDS)}
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")  # matched at the first digit of a run only
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:", "tel:")
CUES = ("iban", "account", "acct", "ssn", "passport", "licence no", "license no", "customer id", "user id", "tax id", "token", "api_key", "apikey", "api key", "secret", "password", "passwd")
SECRET_CUES = frozenset(("token", "api_key", "apikey", "api key", "secret", "password", "passwd"))
#: Keys that their own beginning gives away, by the anchor in small letters.
KEYS = {p.lower(): re.compile(p + rest + r"(?![A-Za-z0-9])") for p, rest in (("AKIA", "[A-Z0-9]{16}"), ("ASIA", "[A-Z0-9]{16}"), ("ghp_", "[A-Za-z0-9]{36}"), ("xoxb-", "[A-Za-z0-9-]{20,}"))}
VALUE = re.compile(r"(?:\s?(?:no|nr|number|num|key))?\.?\s{0,2}[:=#]\s{0,2}([\"']?)")
ACCOUNT = re.compile(r"[A-Za-z0-9](?:[ /-]?[A-Za-z0-9]){4,39}")
SECRET = re.compile(r"[A-Za-z0-9_+/=.~-]{8,}")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
IBAN_LEAD = re.compile(r"(?:\s?(?:no|nr|number)\.?)?\s{0,2}[:=#]?\s{0,2}")
HOST = re.compile(r"[^\s/?#\"'<>]*")
NUMERIC_HOST, PORT = re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}|\[[0-9a-fA-F:.]+\]"), re.compile(r":[0-9]*$")
MAILBOX, REST, TELEPHONE = re.compile(r"[^\s\"'<>?]*"), re.compile(r"[^\s\"'<>]*"), re.compile(r"\+?[0-9][0-9().-]{5,}")

Span = tuple[int, int, int]  # start, rank of kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return len(s) >= 15 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, grown from the at-signs in order: what the base expression finds."""
    out, done, n = [], 0, len(text)
    for at in ats:
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start == at:
            continue
        end, labels = at + 1, 0
        while True:
            stop = end
            while stop < n and text[stop] in LABEL:
                stop += 1
            if stop == end:  # an empty label: the dot before it isn't part
                end -= labels > 0
                break
            labels, end = labels + 1, stop
            if stop < n and text[stop] == ".":
                end = stop + 1
            else:
                break
        if end <= n and labels >= 2:
            out.append((start, end))
            done = end
    return out


def base_ips(text: str, dots: list[int]) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, grown from the dots that follow a digit: runs of digits joined by single dots, in fours."""
    out, done = [], 0
    for dot in dots:
        if dot < done:
            continue
        start = dot - 1
        while start > done and text[start - 1] in DIGITS:
            start -= 1
        m = DOTTED.match(text, start)
        if not m:
            continue
        done, at = m.end(), start
        parts = m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def base_spans(text: str, hits: list[tuple[int, int, str, str]]) -> list[Span]:
    found: list[Span] = [(s, 0, e) for s, e in base_emails(text, [s for s, _, sort, _ in hits if sort == "@"])]
    found += [(s, 1, e) for s, e in base_ips(text, [e - 1 for _, e, sort, _ in hits if sort == "dot"])]
    if DIGIT.search(text):
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    done = 0
    for start, _, sort, _ in hits:
        if sort == "plus" and start >= done and (m := PHONE.match(text, start)):
            done = m.end()
            if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                found.append((start, 3, done))
    return sorted(found)


class Anchors:
    """The automaton; lower-cased ASCII keeps positions those of the text."""

    FOLD = {i: i + 32 for i in range(65, 91)}

    def __init__(self) -> None:
        self.auto = ahocorasick.Automaton()
        self.auto.add_word("@", ("@", ""))
        self.auto.add_word("+", ("plus", "+"))
        for d in "0123456789":
            self.auto.add_word(f"{d}.", ("dot", f"{d}."))
        for s in SCHEMES:
            self.auto.add_word(s, ("scheme", s))
        for c in CUES:
            self.auto.add_word(c, ("cue", c))
        for k in KEYS:
            self.auto.add_word(k, ("key", k))
        self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, sort, anchor) in order of their ends."""
        return [(end + 1 - max(1, len(a)), end + 1, sort, a) for end, (sort, a) in self.auto.iter(text.translate(self.FOLD))]


def wide_email(text: str, at: int) -> tuple[int, int] | None:
    """An address with letters beyond ASCII: letters, digits and the usual marks to both sides, a dotted domain."""
    start, end = at, at + 1
    while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "._%+-'"):
        start -= 1
    while end < len(text) and (text[end].isalnum() or text[end] in ".-"):
        end += 1
    start += len(text[start:at]) - len(text[start:at].lstrip(".'-"))
    end -= len(text[at + 1 : end]) - len(text[at + 1 : end].rstrip(".-"))
    domain = text[at + 1 : end].split(".")
    return (start, end) if start < at and len(domain) >= 2 and all(domain) and len(domain[-1]) >= 2 and domain[-1].isalpha() else None


def expand(text: str, start: int, end: int, sort: str, anchor: str, seen: dict[str, int]) -> tuple[int, int, int] | None:
    """The span (start, rank, end) that an anchor stands for, or None if nothing valid is there.

    ``seen``: how far the last look from an anchor of each sort went. What a later anchor inside that stretch stands for lies
    inside it too, so no stretch is read twice.
    """
    if sort == "@":
        hit = wide_email(text, start)
        return hit and (hit[0], RANK["email"], hit[1])
    if sort == "scheme":
        if start < seen.get(anchor if anchor == "mailto:" else "address", 0):
            return None
        if anchor == "mailto:":
            stop = MAILBOX.match(text, end).end()
            seen[anchor] = stop
            return (start, RANK["address"], stop) if "@" in text[end:stop] else None
        if anchor == "tel:":
            m = TELEPHONE.match(text, end)
            return (start, RANK["address"], m.end()) if m else None
        authority = HOST.match(text, end)[0]
        user, at, host = authority.rpartition("@")
        numeric = NUMERIC_HOST.fullmatch(PORT.sub("", host))
        if not (at and user and host) and not numeric:
            return None
        seen["address"] = stop = REST.match(text, end + len(authority)).end()
        return start, RANK["address"], stop
    if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        return None
    if sort == "key":
        if anchor == "xoxb-" and start < seen.get(anchor, 0):
            return None
        m = KEYS[anchor].match(text, start)
        seen[anchor] = m.end() if m else 0
        return (start, RANK["secret"], m.end()) if m else None
    if anchor == "iban":
        m = IBAN_LEAD.match(text, end)
        if hit := IBAN.match(text, m.end()):
            for stop in range(hit.end(), hit.start() + 14, -1):  # the longest valid one
                if iban_valid(text[hit.start() : stop]) and text[stop - 1] != " ":
                    return hit.start(), RANK["account"], stop
        return None
    m = VALUE.match(text, end)
    if not m:
        return None
    if anchor in SECRET_CUES:
        if m.end() < seen.get("secret", 0):  # inside a value that is already told: the rest of it is
            return None
        hit = SECRET.match(text, m.end())
        if hit:
            seen["secret"] = hit.end()
        if hit and (m[1] or (DIGIT.search(hit[0]) and len(hit[0]) >= 12)):
            return hit.start(), RANK["secret"], hit.end()
        return None
    hit = ACCOUNT.match(text, m.end())
    if not hit:
        return None
    words, stop = re.split(r"([ /-])", hit[0]), 0
    for i in range(0, len(words), 2):  # groups with a digit belong to it, up to the first that has none
        if not DIGIT.search(words[i]) and i:
            break
        stop = sum(map(len, words[: i + 1]))
    return (hit.start(), RANK["account"], hit.start() + stop) if sum(map(str.isdigit, hit[0][:stop])) >= 5 else None


def find_spans(text: str, anchors: Anchors) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and then kind. Spans that a base span covers aren't added."""
    hits, seen = anchors.find(text), {}
    base = base_spans(text, hits)
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # how far the spans up to each go
    extra = set()
    for hit in hits:
        if hit[2] not in ("plus", "dot") and (span := expand(text, *hit, seen)):
            at = bisect_right(starts, span[0])
            if not at or reach[at - 1] < span[2]:
                extra.add(span)
    added, far = [], -1
    for span in sorted(extra, key=lambda x: (x[0], -x[2], x[1])):  # what a span covers comes after it
        if span[2] > far:
            added.append(span)
            far = span[2]
    return base, sorted({*base, *added})


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as ``kind:start:end``.

    Offsets are code points, end exclusive. A null text is empty: no spans, the digest of the empty string.
    Map only; memory is that of one slice of texts. Repeated rows and null ids are taken one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for big in batches:
            for part in slices(big):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    base, spans = find_spans(text, anchors)
                    kinds = [k for _, k, _ in base]
                    rows.append((doc, *(kinds.count(k) for k in range(4)), hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans)))
                yield _batch(rows, [pa.int64()] * 5 + [pa.string()] * 2, SCHEMA)

    return id_text(docs).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple], types: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], [x.split()[0] for x in schema.split(", ")])


def redact_text(text: str, anchors: Anchors) -> str:
    """Every span (overlapping ones together) becomes ``<KIND>``, the kind of its first span."""
    out, at = [], 0
    for s, k, e in find_spans(text, anchors)[1]:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in their texts; all columns, n_chars as the new length. Map only."""

    def make():
        anchors = Anchors()
        return lambda texts: [redact_text(t, anchors) for t in texts]

    return with_texts(docs, make)
