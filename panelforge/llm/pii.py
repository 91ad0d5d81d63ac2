"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, scheme marks, plus
signs before a digit, digits and identifier cues. A local parser expands each
anchor to the left or right and validates the span; nothing else of the text is
looked at again. Spans are in code points, end exclusive; within a kind they do
not overlap, leftmost first. A candidate that fails validation is dropped and not
tried again from inside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import column, text_slices, tidy

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: Words that announce an identifier; matched in lower, Title and UPPER case.
CUES = ("iban", "account", "acct", "passport", "ssn", "token", "api_key", "apikey", "password")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"""[^\s"'<>\\^`{|}]+""")
_ACCOUNT = re.compile(r"""(?:[ \t]*(?:number|no\.?|id))?[ \t]*[:=#]?[ \t]*["']?([A-Za-z0-9](?:[A-Za-z0-9_-]|[ ](?=[A-Z0-9]{4}\b)){5,63})""")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in sorted(_DIGITS):
        a.add_word(d, ("digit", 1))
        a.add_word("+" + d, ("plus", 2))
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.title(), cue.upper()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def find_pii(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind's place in KINDS, end), sorted."""
    out: list[tuple[int, int, int]] = []
    email = ip = card = phone = url = account = 0  # where each kind's last candidate ended
    for last, (what, size) in _automaton().iter(text):
        at = last - size + 1
        if what == "digit":
            if at and text[at - 1] in _DIGITS:
                continue
            if at >= ip and (m := _IP.match(text, at)):
                ip = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    out.append((at, 1, ip))
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, 2, card))
        elif what == "at":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append((start, 0, email))
        elif what == "plus":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append((at, 3, phone))
        elif what == "scheme":
            start = at
            while start > url and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not ("a" <= text[start].lower() <= "z"):
                start += 1
            if start < at and (m := _URL_REST.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]"))
                if end > last + 1:
                    url = end
                    out.append((start, 4, url))
        elif at >= account and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            m = _ACCOUNT.match(text, last + 1)
            if m and m.start(1) > last + 1 and not _DIGITS.isdisjoint(m[1]):
                account = m.end()
                out.append((m.start(1), 5, account))
    out.sort()
    return out


def mask_pii(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span replaced by <KIND>; overlapping spans are one, named by the first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def pii_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", text: bool = False) -> DataFrame:
    """Personal data of each whole text.

    doc_id; n_email, n_ip, n_card, n_phone; base_sha256 (hex SHA-256 of the base
    spans ``kind:start:end`` by start, then kind, joined by commas); spans (all
    spans, joined likewise); with ``text`` also masked (each span replaced by its kind).
    A null text is empty (masked stays null). Rows keep their number; null ids and
    repeated rows stay; other columns are ignored.
    """
    form = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string" + (", masked string" if text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, _, _ in text_slices(b, "text"):
                texts = column(rows, "text").to_pylist()
                found = [find_pii(t) if t else [] for t in texts]
                base = [[x for x in spans if x[1] < len(BASE)] for spans in found]
                cols = [column(rows, "doc_id"), *(pa.array([sum(x[1] == k for x in spans) for spans in base], pa.int64()) for k in range(len(BASE)))]
                cols += [pa.array([hashlib.sha256(_written(s).encode()).hexdigest() for s in base]), pa.array([_written(s) for s in found])]
                if text:
                    cols.append(pa.array([mask_pii(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "masked"][:len(cols)])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), form)


def mask_column(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` masked; other columns and rows as they are."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for rows, _, _ in text_slices(b, text_col):
                texts = [mask_pii(t, s) if t and (s := find_pii(t)) else t for t in rows.column(at).to_pylist()]
                cols = list(rows.columns)
                cols[at] = pa.array(texts, rows.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, schema=rows.schema)

    return docs.mapInArrow(tidy(run), schema)
