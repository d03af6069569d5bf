"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, plus signs, digits and identifier
cues.  A local parser expands each anchor to the boundaries of an e-mail address, network address, card,
phone number, URL, account or secret, and validates it.  Work is a pass over the text and a few steps
for each anchor; no pattern is searched through the text.

Base kinds have these definitions, leftmost and not overlapping within a kind; a match that fails its
check is dropped and not tried again from a later place:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 16 to 19 digits that pass the Luhn check
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 8 to 15 digits

Every place where such a match can start is an anchor, or is reached from one (the local part of an
address), so expansion from the anchors in order gives exactly the leftmost matches.

The method's own kinds: url (a scheme and a host), account (an identifier cue followed by a number of 6
to 34 characters, or an IBAN that passes its check) and secret (``password=`` and access keys).

A null text counts as empty.  Spans are counted in code points, the end exclusive.  Equal rows each get
a row; an empty table gives none; other columns are ignored, and ``redact`` returns them as they are.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")

#: Words that announce an account number, in the languages of the texts; matched in lower, title and upper case.
CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "kontonummer", "cuenta", "compte")
SECRETS = ("password=", "passwd=", "secret=", "api_key=", "AKIA", "ASIA")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'{}|\\^`\x00-\x1f]+")
_ACCOUNT = re.compile(r"(?:[ \t]?(?:no|nr|number)\b)?[ \t.:#=]{0,3}([A-Z]{0,4}[0-9](?:[ -]?[A-Z0-9]){5,33})")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_SECRET = re.compile(r"[^\s\"'<>]{4,}")
_KEY = re.compile(r"[A-Z0-9]{16}(?![A-Z0-9])")


def automaton() -> ahocorasick.Automaton:
    anchors = ahocorasick.Automaton()
    for digit in "0123456789":
        anchors.add_word(digit, ("digit", 1))
    anchors.add_word("@", ("at", 1))
    anchors.add_word("+", ("plus", 1))
    anchors.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in (cue, cue.title(), cue.upper()):
            anchors.add_word(form, ("cue", len(form)))
    for cue in SECRETS:
        anchors.add_word(cue, ("key" if cue.isupper() else "secret", len(cue)))
    anchors.make_automaton()
    return anchors


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(text: str) -> bool:
    if not _IBAN.fullmatch(text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _plain(text: str) -> str:
    return text.replace(" ", "").replace("-", "")


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of one text, by kind and then start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)
    no_quad_before = 0
    for last, (anchor, size) in anchors.iter(text):
        at = last - size + 1
        if anchor == "digit":
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = _plain(m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
            if at >= done["ip"] and at >= no_quad_before:
                if m := _QUAD.match(text, at):
                    done["ip"] = m.end()
                    if all(len(q) <= 3 and int(q or "0") <= 255 for q in (p.lstrip("0") for p in m.groups())):
                        found["ip"].append(m.span())
                else:  # no later digit of the same run can start a match either
                    no_quad_before = _DIGITS.match(text, at).end()
        elif anchor == "at":
            begin = at
            while begin > done["email"] and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at and (m := _DOMAIN.match(text, at + 1)):
                found["email"].append((begin, m.end()))
                done["email"] = m.end()
        elif anchor == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "scheme":
            begin = at
            while begin > done["url"] and text[begin - 1] in _SCHEME:
                begin -= 1
            while begin < at and not text[begin].isalpha():
                begin += 1
            if begin < at and (m := _URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]"))
                if end > last + 1:
                    found["url"].append((begin, end))
                    done["url"] = end
        elif anchor == "cue":
            if last + 1 >= done["account"] and (m := _ACCOUNT.match(text, last + 1)):
                number = _plain(m[1])
                if sum(c.isdigit() for c in number) >= 6 and (not number[:2].isalpha() or iban(number) or len(number) <= 12):
                    found["account"].append(m.span(1))
                    done["account"] = m.end()
        elif at >= done["secret"]:
            m = (_KEY if anchor == "key" else _SECRET).match(text, last + 1)
            if m:
                found["secret"].append((at, m.end()))
                done["secret"] = m.end()
    return [(kind, *span) for kind in KINDS for span in found[kind]]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a mark in place of each span; of overlapping spans the first names the mark."""
    out, reached = [], 0
    for begin, end, kind in sorted((b, -e, KINDS.index(k)) for k, b, e in spans):
        end = -end
        if begin >= reached:
            out += [text[reached:begin], f"[{KINDS[kind].upper()}]"]
        reached = max(reached, end)
    return "".join([*out, text[reached:]])


def _joined(spans) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def find(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = documents.select("doc_id", "text")

    def look(batches):
        anchors = automaton()
        for batch in batches:
            every = [spans_of(t or "", anchors) for t in batch.column("text").to_pylist()]
            base = [[s for s in spans if s[0] in BASE_KINDS] for spans in every]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                **{f"n_{k}": pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS},
                "base_sha256": pa.array([hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base], pa.string()),
                "spans": pa.array(map(_joined, every), pa.string()),
            })

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(look, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(documents: DataFrame) -> DataFrame:
    """The documents with a mark in place of every span, and n_chars after that if they have it.

    Rows and columns stay; a null text stays null.
    """
    text = documents.columns.index("text")

    def look(batches):
        anchors = automaton()
        for batch in batches:
            texts = [t and redacted(t, spans_of(t, anchors)) for t in batch.column("text").to_pylist()]
            yield batch.set_column(text, "text", pa.array(texts, batch.schema.field("text").type))

    columns = documents.columns
    hidden = documents.mapInArrow(look, documents.schema)
    if "n_chars" in columns:
        count = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType)
        hidden = hidden.withColumn("n_chars", count)
    return hidden.select(*[f"`{c}`" for c in columns])
