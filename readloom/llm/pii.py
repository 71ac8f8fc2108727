"""Operator 9: personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors in a text in one pass: at-signs, plus signs, digits, URL schemes and cue
words.  A deterministic parser for the kind then expands from the anchor and validates what it has found.

Base kinds, each leftmost and non-overlapping, a match that fails its test dropped without another try:

* email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip     ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, every part at most 255
* card   ``[0-9]([ -]?[0-9])+``, 16 to 19 digits with a right Luhn sum
* phone  ``\\+[0-9][ ().0-9-]+[0-9]``, 8 to 15 digits

Added kinds, which never take a base span's place: ``iban`` (a cue, then an account number whose check digits hold),
``account`` (a cue, then 8 to 17 digits), ``secret`` (the quoted or assigned value after a cue such as ``token =``, or
what follows ``Bearer``, at least 16 characters with a digit among them), ``login`` (user and password of a URL) and
``key`` (what shows by its own beginning that it is a credential: keys with a vendor's prefix, signed web tokens, private
key blocks).  A cue or prefix must not follow a letter or digit.  URLs without a login and postal addresses are no spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import arrow_map, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "account", "secret", "login", "key")
KINDS = BASE + ADDED

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_digits = re.compile(r"[0-9]+").match
_ip = re.compile(r"[0-9]+(?:\.[0-9]+){3}").match
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_iban = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?))?[ \t]*[:=#]?[ \t]*([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})", re.I).match
_account = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?)[ \t]*[:=#]?|[ \t]*[:=#])[ \t]*([0-9](?:[ -]?[0-9]){7,16})(?![0-9])", re.I).match
_secret = re.compile(r"""["']?[ \t]*[:=][ \t]*(["']?)([A-Za-z0-9_/+.=-]{16,})(?![A-Za-z0-9_/+.=-])\1""").match
_bearer = re.compile(r"""(?:["']?[ \t]*[:=][ \t]*|[ \t]+)(["']?)([A-Za-z0-9_/+.~=-]{16,})(?![A-Za-z0-9_/+.~=-])\1""").match
_login = re.compile(r"([^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+)@[A-Za-z0-9.-]+").match

_key = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{22,}|sk[-_](?=[0-9A-Za-z_-]*[0-9])[0-9A-Za-z_-]{20,}|xox[abeoprs]-[0-9A-Za-z-]{10,}"
    r"|AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"
    r"|-----BEGIN (?:[0-9A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\s+[0-9A-Za-z+/=]{16,})*(?:(?:\s+[0-9A-Za-z+/=]{1,15})?\s*-----END [0-9A-Z ]+-----)?"
).match

#: Cue words and prefixes, in lower case and found in any; what may follow says more.  Fixed values.
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "cuenta", "compte"),
    "secret": ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key", "access_key", "bearer"),
    "login": ("://",),
    "key": ("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "sk_", "xox", "aiza", "eyj", "-----begin "),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i & 1:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, "#")
    found.add_word("@", "@")
    found.add_word("+", "+")
    for kind, words in CUES.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


_automaton = anchors()
_lower = {c: c + 32 for c in range(65, 91)}


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by kind as listed, then by start."""
    out: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)  # where the search for a kind goes on
    seen = -2  # the last digit; the next one may be of the same run
    for last, kind in _automaton.iter(text.lower() if text.isascii() else text.translate(_lower)):
        if kind == "#":
            first_of_run, seen = last != seen + 1, last
            if last >= past["ip"] and (first_of_run or last == past["ip"]):
                if m := _ip(text, last):
                    past["ip"] = m.end()
                    if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                        out["ip"].append(("ip", last, m.end()))
            if last >= past["card"]:
                m = _card(text, last)
                past["card"] = m.end() if m else last + 1
                if m:
                    d = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(d) <= 19 and luhn(d):
                        out["card"].append(("card", last, m.end()))
        elif kind == "@":
            start, low = last, past["email"]
            while start > low and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := _domain(text, last + 1)):
                out["email"].append(("email", start, m.end()))
                past["email"] = m.end()
        elif kind == "+":
            if last >= past["phone"] and (m := _phone(text, last)):
                past["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out["phone"].append(("phone", last, m.end()))
        else:
            kind, length = kind
            start = last + 1 - length
            if start < past[kind] or (kind != "login" and start and text[start - 1].isalnum()):
                continue
            if kind == "key":
                if m := _key(text, start):
                    out["key"].append(("key", start, m.end()))
                    past["key"] = m.end()
                continue
            parse = _bearer if text[start : last + 1].lower() == "bearer" else {"iban": _iban, "account": _account, "secret": _secret, "login": _login}[kind]
            m = parse(text, last + 1)
            if not m:
                continue
            g = 2 if kind == "secret" else 1
            start, end, value = m.start(g), m.end(g), m[g]
            if kind == "iban":
                # spaces may join the words that follow: the longest run whose check digits hold
                ends = [i for i in range(15, len(value) + 1) if i == len(value) or value[i] == " "]
                end = next((start + i for i in reversed(ends) if iban_ok(value[:i].replace(" ", ""))), -1)
                if end < 0:
                    continue
            elif kind == "secret" and not any(c.isdigit() for c in value):
                continue
            out[kind].append((kind, start, end))
            past[kind] = end
    return [s for k in KINDS for s in out[k]]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span, overlapping ones joined, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and spans, one row for each row of ``docs``.

    A null or empty text has no spans (base_sha256 is that of the empty string).  Repeated rows are repeated; other
    columns are not read.  No row depends on another: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t) if t else [] for t in batch.column(1).to_pylist()]
            base = [[s for s in spans if s[0] in BASE] for spans in found]
            out = {"doc_id": batch.column(0)}
            out |= {f"n_{k}": pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE}
            out |= {"base_sha256": pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b in base], pa.string()), "spans": pa.array([digest(s) for s in found], pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).transform(arrow_map, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_pii(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the spans of ``text`` replaced by their kinds, and ``n_chars``, if there, brought up to date.

    Null texts stay null; a row without spans stays as it is; the order and types of the columns stay.
    """
    at = docs.columns.index(text)
    count = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            clean = [redact(t, s) if t and (s := find(t)) else t for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, columns[at].type)
            if count is not None:
                old = columns[count].to_pylist()
                columns[count] = pa.array([n if a is b else len(b) for n, a, b in zip(old, texts, clean)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.transform(arrow_map, run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    return find_pii(table(spark, sf_dir, "documents"))
