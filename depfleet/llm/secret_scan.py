"""Secret scans with structural confirmation.

Three pattern kinds are reported as they match (assignments, access keys, long hex).  Further candidates, runs of base64 (of either alphabet, also over
lines) or hex and armoured blocks (also with escaped line ends or headers), are decoded and reported only if what they hold parses: nested lengths of a DER private or
public key, the length-prefixed fields of an OpenSSH key, or the JSON header and claims of a signed token.

Spans are ``(kind, start, end)`` in code points, end exclusive.  Defined results: a null or empty text has no spans; equal
spans of different kinds are listed in the order of KINDS; texts of any length are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame

from .common import map_texts

# fixed values: the kinds in their order, and the patterns of the first three
KINDS = ("assign", "access", "hex", "token", "block", "key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]{9,})\.(e[A-Za-z0-9_-]{5,})\.([A-Za-z0-9_-]*)")
BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*(?:PRIVATE|PUBLIC) KEY)-----((?:(?!-----BEGIN ).)+?)-----END \1-----", re.S)
PACKED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
URL_SAFE = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}={0,2}")
# runs over lines, real or escaped: lines of 40 signs or more, and a last one of any length
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}(?:\r?\n[ \t]*|(?:\\r)?\\n))+[A-Za-z0-9+/_-]+={0,2}")
LINE_END = re.compile(r"\r?\n[ \t]*|(?:\\r)?\\n")
HEADERS = re.compile(r"^[\w-]+:.*(?:\n[ \t]+.*)*$", re.M)
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of consecutive DER values; None unless their lengths fill ``data`` exactly."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_der_key(data: bytes) -> bool:
    """A key in one of the usual encodings: PKCS#1, PKCS#8 (plain or encrypted), SEC1 or SubjectPublicKeyInfo."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(outer[0][1]) or []
    tags = [t for t, _ in items]
    if len(tags) < 2:
        return False
    if all(t == 0x02 for t in tags):
        return len(tags) in (2, 9) and len(items[0 if len(tags) == 2 else 1][1]) >= 32
    named = next((body for tag, body in items[:2] if tag == 0x30), None)
    if named is not None:  # an algorithm, then the key in a string
        inner = der_items(named)
        return bool(inner) and inner[0][0] == 0x06 and any(t in (0x03, 0x04) and len(b) >= 16 for t, b in items)
    return tags[0] == 0x02 and items[0][1] == b"\x01" and tags[1] == 0x04 and len(items[1][1]) >= 16


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH key: its magic word, or a public blob, with length-prefixed fields that fit."""
    magic = b"openssh-key-v1\0"
    private = data.startswith(magic)
    at, fields = (len(magic) if private else 0), []
    while at + 4 <= len(data) and len(fields) < 3:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    if private:
        return len(fields) == 3 and all(re.fullmatch(rb"[a-z0-9@.-]+", f) for f in fields[:2])
    return len(fields) >= 2 and re.match(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+$", fields[0]) is not None


def unpack(text: str, alphabet: bytes | None = None) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=alphabet, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_key(text: str) -> bool:
    """Whether base64 of either alphabet holds a key."""
    body = unpack(text, b"-_" if "-" in text or "_" in text else None)
    return bool(body) and (is_der_key(body) or is_ssh_key(body))


def is_locked(body: str) -> bool:
    """An armoured key encrypted as a whole: its headers name a cipher, and the rest is whole base64 blocks."""
    if "DEK-Info:" not in body or "ENCRYPTED" not in body:
        return False
    data = unpack(re.sub(r"\s", "", HEADERS.sub("", body)))
    return data is not None and len(data) >= 32 and len(data) % 8 == 0


def wrapped_key(run: str) -> int:
    """Where the key ends that a run of base64 lines starts with, or 0.  The length its first bytes tell says how many signs belong to it."""
    signs = LINE_END.sub("", run)
    head = unpack(signs[:8], b"-_" if "-" in signs or "_" in signs else None) or b""
    if head[:1] == b"\x30" and len(head) > 5 and head[1] in (0x81, 0x82, 0x83):
        width = head[1] & 0x7F
        size = 2 + width + int.from_bytes(head[2 : 2 + width], "big")
    elif head[:1] == b"\x30" and len(head) > 1 and head[1] < 0x80:
        size = 2 + head[1]
    else:
        return len(run) if is_key(signs) else 0
    need = -(-size * 4 // 3)
    if len(signs.rstrip("=")) < need or not is_key(signs[:need]):
        return 0
    at = left = 0
    for m in re.finditer(r"[^\r\n\\ \t]+", LINE_END.sub(lambda e: " " * len(e[0]), run)):
        if left + len(m[0]) >= need:
            at = m.start() + need - left
            break
        left += len(m[0])
    while run[at : at + 1] == "=":
        at += 1
    return at


def is_signed_token(head: str, claims: str) -> bool:
    """Header and claims decode to JSON objects and the header names its algorithm."""
    parts = []
    for part in (head, claims):
        raw = unpack(part, b"-_")
        try:
            parts.append(json.loads(raw) if raw is not None else None)
        except (ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text, by start and then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "." in text and "e" in text:
        found += [("token", *m.span()) for m in SIGNED.finditer(text) if is_signed_token(m[1], m[2])]
    if "-----BEGIN " in text:
        for m in BLOCK.finditer(text):
            lines = re.sub(r"\\[rn]", "\n", m[2]).replace("\r\n", "\n")
            if is_locked(lines) or is_key(re.sub(r"\s", "", HEADERS.sub("", lines))):
                found.append(("block", *m.span()))
    wrapped = []
    for m in WRAPPED.finditer(text):
        if end := wrapped_key(m[0]):
            wrapped.append((m.start(), m.start() + end))
    for pattern in (PACKED, URL_SAFE):
        found += [("key", *m.span()) for m in pattern.finditer(text) if is_key(m[0])]
    found += [("key", *x) for x in wrapped]
    for m in LONG_HEX.finditer(text):
        body = bytes.fromhex(m[0]) if len(m[0]) % 2 == 0 else b""
        if body and (is_der_key(body) or is_ssh_key(body)):
            found.append(("key", *m.span()))
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int]], sign: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``sign``."""
    out, done = [], 0
    for _, start, end in spans:
        if start >= done:
            out += [text[done:start], sign]
        done = max(done, end)
    return "".join(out) + text[done:]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, col: str = "text") -> DataFrame:
    """Adds ``found`` (array of kind, start, end) and ``redacted`` to every row."""

    def per_text():
        def work(texts):
            spans = [find_spans(t) for t in texts]
            return {"found": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans],
                    "redacted": [redact(t, x) for t, x in zip(texts, spans, strict=True)]}
        return work

    return map_texts(docs, per_text, "found array<struct<kind:string,start:int,end:int>>, redacted string", col)


def summarise(docs: DataFrame, col: str = "text") -> DataFrame:
    """Adds counts per pattern kind, the digest of the pattern spans, and all spans as text."""

    def per_text():
        def work(texts):
            spans = [find_spans(t) for t in texts]
            base = [[s for s in x if s[0] in KINDS[:3]] for x in spans]
            out = {f"n_{kind}": [sum(s[0] == kind for s in x) for x in base] for kind in KINDS[:3]}
            out["base_sha256"] = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
            out["spans"] = [joined(x) for x in spans]
            out["n_confirmed"] = [len(x) - len(y) for x, y in zip(spans, base, strict=True)]
            return out
        return work

    return map_texts(docs, per_text, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long", col)
