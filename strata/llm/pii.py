"""Personal data by anchor expansion.

An Aho-Corasick automaton passes once over a whole text and stops at anchors only: at-signs, plus signs, digits, schemes and
cue words.  From an anchor a deterministic parser expands both ends of a span and validates it.  For the base kinds the parsers
give what leftmost, non-overlapping searches with these patterns give, each kind by itself:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, no part above 255
* card ``[0-9]([\\x20-]?[0-9])+``, 13 to 19 digits that pass the Luhn check
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

Further kinds need their own cue: ``account`` (a number after words such as IBAN, account, SSN; IBANs must pass modulo 97) and
``address`` (after mailto:, sip:, xmpp: or as user information in a URL).  Each is expanded as far as its characters go and validated
as a whole: what is too long for its kind is no span, and no span ends inside of a run of letters, digits and hyphens; a blank may end a number
that words follow (``account 123456 7th floor``).  Work is in proportion to the text, whatever it holds.

Defined results: null text counts as empty, which has no spans; spans count code points, end exclusive; repeated rows each
give a row; an empty table gives no rows; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import columns, give_back

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address")
SCHEMES = ("mailto:", "sip:", "xmpp:", "://")
CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "compte", "cuenta")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CUED = re.compile(r"(?i:\s*(?:no|nr|number|num)\b\.?)?[\s:#=]{1,4}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])*(?![A-Za-z0-9]|-[A-Za-z0-9])")
_GOES_ON = re.compile(r"-?[A-Za-z0-9]")
_USER = re.compile(r"([A-Za-z0-9._%+-]+)(?::[^\s/@]+)?@")


@functools.cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, "0" if sign.isdigit() else sign)
    for scheme in SCHEMES:
        found.add_word(scheme, scheme)
    for cue in CUES:
        for form in {cue, cue.title(), cue.upper()}:
            found.add_word(form, "cue")
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def account_at(text: str, start: int) -> tuple[int, int] | None:
    """The whole number after a cue, 6 to 19 digits of it, or the longest valid IBAN; a longer number is none.

    An IBAN has 34 letters and digits at most, so its ends are sought in so many; both kinds end before a blank or mark, where no letter or digit
    goes on, also not after a hyphen.
    """
    cue = _CUED.match(text, start)
    if cue and (m := _NUMBER.match(text, cue.end())):
        return m.span() if 6 <= sum(map(str.isdigit, m[0])) <= 19 else None
    if cue and (m := _IBAN.match(text, cue.end())):
        for end in range(m.end(), m.start() + 14, -1):
            if text[end - 1] != " " and not _GOES_ON.match(text, end) and iban(text[m.start() : end]):
                return m.start(), end
    return None


def address_at(text: str, start: int) -> tuple[int, int] | None:
    """The whole address from ``start`` on, if its local part has at most 64 characters and its domain 253, 63 in each label."""
    end = start
    while end < len(text) and text[end] in _LOCAL:
        end += 1
    if not start < end <= start + 64 or not text.startswith("@", end) or not (m := _DOMAIN.match(text, end + 1)):
        return None
    return (start, m.end()) if len(m[0]) <= 253 and max(map(len, m[0].split("."))) <= 63 else None


def user_at(text: str, start: int) -> tuple[int, int] | None:
    """User information in a URL, up to the at-sign."""
    m = _USER.match(text, start)
    return (start, m.end() - 1) if m else None


def _is_ip(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail_to = ip_to = card_to = phone_to = 0
    for last, anchor in automaton().iter(text):
        if anchor == "0":
            if last >= card_to:
                m = _CARD.match(text, last)
                card_to = m.end() if m else last + 1
                if m and m.end() - last >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                    out["card"].append(m.span())
            if last >= ip_to:
                end = _DIGITS.match(text, last).end()
                m = _IP.match(text, last) if text.startswith(".", end) else None
                ip_to = m.end() if m else end
                if m and _is_ip(m[0]):
                    out["ip"].append(m.span())
        elif anchor == "@":
            start = last
            while start > mail_to and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                mail_to = m.end()
                out["email"].append((start, mail_to))
        elif anchor == "+":
            if last >= phone_to and (m := _PHONE.match(text, last)):
                phone_to = m.end()
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out["phone"].append(m.span())
        else:
            kind, parser = ("account", account_at) if anchor == "cue" else ("address", user_at if anchor == "://" else address_at)
            if span := parser(text, last + 1):
                out[kind].append(span)
    return out


def _joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_<kind> for each kind, base_sha256, spans)."""

    def run(batches):
        for batch in batches:
            keys, texts = columns(batch, key, text)
            found = [find(x.as_py() or "") for x in texts]
            yield pa.RecordBatch.from_arrays(
                [keys, *(pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS),
                 pa.array([hashlib.sha256(_joined(f, BASE).encode()).hexdigest() for f in found], pa.string()),
                 pa.array([_joined(f, KINDS) for f in found], pa.string())],
                [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {counts}, base_sha256 string, spans string")


def mask(text: str) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one, as in ``[EMAIL]``."""
    spans = sorted((a, -b, k) for k, some in find(text).items() for a, b in some)
    if not spans:
        return text
    out, to = [], 0
    for a, b, kind in spans:
        if a >= to:
            out += [text[to:a], f"[{kind.upper()}]"]
        to = max(to, -b)
    return "".join([*out, text[to:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` masked; all rows and columns stay, null texts stay null."""

    @F.pandas_udf("string")
    def masked(texts):
        out = texts.map(mask, na_action="ignore")
        give_back()
        return out

    return docs.withColumn(text, masked(F.col(text)))
