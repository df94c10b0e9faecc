"""Secret scan with structural confirmation.

Base patterns (assignments, access keys, hex strings) are always reported. Besides them, base64 and hex candidates are
decoded and reported only when their contents parse: nested type-length-value encodings whose lengths add up exactly (DER),
length-prefixed key blobs, armoured key blocks whose body is one of these, signed tokens whose header and payload are
JSON, and encoded text that itself holds a base assignment or access key. Encodings wrapped over lines are decoded whole too.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_columns, read

# The base patterns. ASCII letters only are matched in either case.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?((?-i:[A-Za-z0-9+/_.=-]+))", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run is leftmost and maximal, so 20 in all is the same as dropping shorter runs
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "token", "der", "keyblob", "nested")
ORDER = {k: i for i, k in enumerate(KINDS)}

ARMOUR = re.compile(
    r"-----BEGIN ([A-Z0-9 ]{1,64})-----((?:\s*[A-Za-z-]{1,32}:[^\n]*\n)*[A-Za-z0-9+/=\s]+)-----END \1-----"
)
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
# the shortest base match but hex is token= with six characters, 12 bytes
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{24,}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
_NO_BLANKS = dict.fromkeys([0x20, *range(0x09, 0x0E)])
MAX_DEPTH = 32

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def unbase64(text: str) -> bytes | None:
    body = text.replace("-", "+").replace("_", "/").rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the element at ``at``; None unless it fits in ``end``."""
    if at + 2 > end or data[at] & 0x1F == 0x1F:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def is_der(data: bytes) -> bool:
    """One sequence that fills the data, whose nested lengths add up at every level, with an integer or bit string inside."""
    outer = _tlv(data, 0, len(data))
    if len(data) < 24 or outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    todo, keyed = [(outer[1], outer[2], 1)], False
    while todo:
        at, end, depth = todo.pop()
        if depth > MAX_DEPTH:
            return False
        while at < end:
            element = _tlv(data, at, end)
            if element is None:
                return False
            tag, start, stop = element
            keyed |= tag in (0x02, 0x03, 0x04) and stop - start >= 8
            if tag & 0x20:
                todo.append((start, stop, depth + 1))
            at = stop
    return keyed


def is_key_blob(data: bytes) -> bool:
    """Length-prefixed fields that fill the data, the first an algorithm name; or a private key of the same making."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at < len(data):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        if size > len(data) - at - 4:
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]{2,60}", fields[0]) is not None


def _json_object(text: str) -> dict | None:
    data = unbase64(text)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(header: str, payload: str) -> bool:
    head = _json_object(header)
    return head is not None and isinstance(head.get("alg"), str) and _json_object(payload) is not None


def confirm(data: bytes | None) -> str | None:
    """The kind of a decoded candidate, or None when nothing in it parses."""
    if not data:
        return None
    if is_der(data):
        return "der"
    if is_key_blob(data):
        return "keyblob"
    try:
        inner = data.decode("ascii")
    except UnicodeDecodeError:
        return None
    if inner.translate(_NO_BLANKS).isprintable() and any(kind != "hex" for _, _, kind in base_spans(inner)):
        return "nested"
    return None


def unhex(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 and LONG_HEX.fullmatch(text) else None


def wrapped_spans(text: str) -> list[Span]:
    """Encodings over several lines: lines of one length, with or without the rest of the line before and a shorter last one."""
    spans = []
    for m in WRAPPED.finditer(text):
        pieces = [p.span() for p in PIECE.finditer(text, m.start(), m.end())]
        sizes = [b - a for a, b in pieces]
        edges = [0, *(i for i in range(1, len(sizes)) if sizes[i] != sizes[i - 1]), len(sizes)]
        tried = set()
        for a, b in zip(edges, edges[1:]):
            ends = [b, b + 1] if b < len(sizes) and sizes[b] < sizes[a] else [b]
            for i in [a - 1, a] if a else [a]:
                for j in ends:
                    if j - i < 2 or (i, j) in tried or sum(sizes[i:j]) < 16:
                        continue
                    tried.add((i, j))
                    joined = "".join(text[u:v] for u, v in pieces[i:j])
                    if kind := confirm(unbase64(joined)) or confirm(unhex(joined)):
                        spans.append((pieces[i][0], m.end() if j == len(pieces) else pieces[j - 1][1], kind))
    return spans


def added_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    if "-----BEGIN " in text:
        for m in ARMOUR.finditer(text):
            body = re.sub(r"(?m)^\s*[A-Za-z-]{1,32}:.*$", "", m[2])
            data = unbase64(re.sub(r"\s+", "", body))
            if data and (is_der(data) or is_key_blob(data) or "ENCRYPTED" in m[2]):
                spans.append((m.start(), m.end(), "pem"))
    for m in SIGNED.finditer(text):
        if is_signed_token(m[1], m[2]):
            spans.append((m.start(), m.end(), "token"))
    seen = set()
    for m in BASE64.finditer(text):
        if kind := confirm(unbase64(m[0])):
            spans.append((m.start(), m.end(), kind))
            seen.add((m.start(), m.end()))
    for m in LONG_HEX.finditer(text):
        if m.span() not in seen and (kind := confirm(unhex(m[0]))):
            spans.append((m.start(), m.end(), kind))
    return spans + wrapped_spans(text) if "\n" in text else spans


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, by start, then kind as listed; code points, end exclusive."""
    if not text:
        return [], []
    by = lambda s: (s[0], ORDER[s[2]], s[1])
    base = sorted(base_spans(text), key=by)
    return base, sorted(base + added_spans(text), key=by)


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``secret_base`` and ``secret_spans``: arrays of (start, end, kind).

    Null and empty texts have none. Rows are independent, so repeated ids and extra columns pass through; columns named like
    the results are replaced.
    """
    kept = docs.drop("secret_base", "secret_spans")

    def scan(rows):
        found = [find_spans(t) for t in rows[text]]
        as_rows = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]
        return {"secret_base": [as_rows(b) for b, _ in found], "secret_spans": [as_rows(a) for _, a in found]}

    schema = T.StructType([*kept.schema, T.StructField("secret_base", SPANS), T.StructField("secret_spans", SPANS)])
    return map_columns(kept, scan, schema)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each run of overlapping secrets in ``text`` replaced by ``mark``; ``n_chars``, where present, follows.

    Rows without secrets are unchanged, null and empty texts among them; no row is dropped.
    """
    counted = "n_chars" in docs.columns

    def clean(rows):
        texts = rows[text]
        spans = [find_spans(t)[1] for t in texts]
        made = {text: [redact(t, s, mark) if s else t for t, s in zip(texts, spans)]}
        if counted:
            made["n_chars"] = [len(t) if s else n for t, s, n in zip(made[text], spans, rows["n_chars"])]
        return made

    return map_columns(docs, clean, docs.schema)


DIGEST = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def op2_secret_scan(spark, sf_dir):
    found = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(rows):
        base = [[(s["start"], s["end"], s["kind"]) for s in spans] for spans in rows["secret_base"]]
        made = {f"n_{k}": [sum(kind == k for _, _, kind in spans) for spans in base] for k in BASE}
        made["base_sha256"] = [hashlib.sha256(join_spans(spans).encode()).hexdigest() for spans in base]
        made["spans"] = [join_spans([(s["start"], s["end"], s["kind"]) for s in spans]) for spans in rows["secret_spans"]]
        return made

    return map_columns(found.drop("text"), digest, DIGEST)


QUERIES = {"op2_secret_scan": (op2_secret_scan, None)}
