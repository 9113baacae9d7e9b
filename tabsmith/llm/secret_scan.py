"""Secrets in texts: patterns first, then confirmation by structure.

Candidates that may encode a key are decoded (base64, base64url, hex) and parsed before they are reported: DER by its
nested lengths (PKCS#1, PKCS#8, encrypted PKCS#8, SEC 1), OpenSSH keys by their length-prefixed fields, PEM blocks by
their body (escaped line breaks and header lines are understood; an encrypted body must fill the blocks of its cipher), and signed
tokens by the JSON of their header and claims. What only looks like a key is not reported.
Base64 may be wrapped over lines, real or escaped: the lengths inside a key tell where it ends.

Edge cases: a null or empty text has no spans; equal rows give equal rows; texts of any length are searched whole;
other columns are not read. Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in the order of reports, and their patterns.
KINDS = ["assign", "access", "hex", "jwt", "pem", "der", "ssh"]
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----)[\s\S])+)-----END \1-----")
ESCAPED = re.compile(r"\\+(?:[nrt]|(?=\s))")
HEADER = re.compile(r"^[ \t]*([A-Za-z][A-Za-z0-9-]*):[ \t]*(.*?)[ \t\r]*$", re.M)
CIPHER = re.compile(r"[A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})")
ENCODED = re.compile(
    r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n)|(?<=\\r))(?:M[A-Za-z0-9+/_-]{31,}|b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/_-]{20,})={0,2}")
WRAP = re.compile(r"[ \t]*(?:\\+r)?(?:\r?\n|\\+n)[ \t]*([A-Za-z0-9+/_-]+={0,2})")
LONGEST = 1 << 16
"""Bytes of the longest key that is looked for over line breaks."""
ENCODED_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[fF]70656[eE])[0-9A-Fa-f]{46,}")
OPENSSH = b"openssh-key-v1\0"

SCHEMA = "doc_id long, kind string, start long, end long"

INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER elements that fill ``data`` to the last byte; None if the lengths do not add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_private_der(data: bytes) -> bool:
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    parts = elements(outer[0][1])
    if not parts:
        return False
    tags = [t for t, _ in parts]
    if tags[:2] == [SEQUENCE, OCTETS] or tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # PKCS#8, encrypted or plain
        algorithm = elements(parts[tags.index(SEQUENCE)][1])
        return bool(algorithm) and algorithm[0][0] == OID and len(parts[tags.index(OCTETS)][1]) >= 16
    if tags == [INTEGER] * 9:  # PKCS#1
        return parts[0][1] in (b"\0", b"\1") and len(parts[1][1]) >= 32
    if tags[:2] == [INTEGER, OCTETS]:  # SEC 1
        return parts[0][1] == b"\1" and 16 <= len(parts[1][1]) <= 66
    return False


def is_openssh(data: bytes) -> bool:
    if not data.startswith(OPENSSH):
        return False
    at, fields = len(OPENSSH), 0
    while at < len(data):
        if fields == 3:  # the number of keys
            at, fields = at + 4, fields + 1
            continue
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        fields += 1
    return at == len(data) and fields >= 6


def from_base64(text: str) -> bytes:
    body = re.sub(r"\s+", "", text).rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return b""


def key_kind(data: bytes) -> str | None:
    return "der" if is_private_der(data) else "ssh" if is_openssh(data) else None


def is_private_pem(body: str) -> bool:
    """A PEM body, with its header lines and escapes."""
    body = ESCAPED.sub("\n", body).replace("\\/", "/")
    headers = {m[1].lower(): m[2] for m in HEADER.finditer(body)}
    data = from_base64(HEADER.sub("", body) if headers else body)
    if "ENCRYPTED" in headers.get("proc-type", ""):
        cipher = CIPHER.fullmatch(headers.get("dek-info", ""))
        return bool(cipher) and len(data) >= 32 and len(data) % (len(cipher[1]) // 2) == 0
    return key_kind(data) is not None


def least_size(data: bytes) -> int:
    """Bytes that a key has at least, by the lengths at its beginning; 0 if it is none."""
    if data.startswith(OPENSSH):
        at, left = len(OPENSSH), 3
        while left:
            if at + 4 > len(data):
                return at + 4
            at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
        if at + 4 > len(data):
            return at + 4
        left, at = int.from_bytes(data[at : at + 4], "big") + 1, at + 4
        while left and at + 4 <= len(data):
            at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
        return at + 4 * left
    if len(data) < 6 or data[0] != SEQUENCE or data[1] & 0x7F > 4 and data[1] & 0x80:
        return 0
    n = data[1] & 0x7F
    return 2 + n + int.from_bytes(data[2 : 2 + n], "big") if data[1] & 0x80 else 2 + n


def wrapped_key(text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """The key that begins with the run of base64 and goes on in the next lines."""
    parts, count = [text[start:end]], len(text[start:end].rstrip("="))
    while True:
        body = "".join(parts)
        size = least_size(from_base64(body[: count // 4 * 4]))
        if not size or size > LONGEST:
            return None
        asked = -(-size * 4 // 3)
        if count >= asked:
            kind = key_kind(from_base64(body)) if count == asked else None
            return kind and (kind, start, end)
        while count < asked:
            line = WRAP.match(text, end)
            if not line or parts[-1].endswith("="):
                return None
            parts.append(line[1])
            count, end = count + len(line[1].rstrip("=")), line.end()


def is_signed_token(token: str) -> bool:
    parts = token.split(".")
    try:
        header, claims = (json.loads(from_base64(p)) for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str):
        return False
    return bool(from_base64(parts[2])) or header["alg"].lower() == "none"


def spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of each secret in one text."""
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        yield from (("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6)
    if "AKIA" in text:
        yield from (("access", *m.span()) for m in ACCESS.finditer(text))
    yield from (("hex", *m.span()) for m in HEX.finditer(text))
    if "eyJ" in text:
        yield from (("jwt", *m.span()) for m in TOKEN.finditer(text) if is_signed_token(m[0]))
    blocks = []
    if "PRIVATE KEY-----" in text:
        blocks = [m.span() for m in BLOCK.finditer(text) if is_private_pem(m[2])]
        yield from (("pem", *b) for b in blocks)
    done = 0
    for m in ENCODED.finditer(text):
        if m.start() < done:
            continue
        if kind := key_kind(from_base64(m[0])):
            yield kind, *m.span()
        elif not any(a <= m.start() < b for a, b in blocks) and (key := wrapped_key(text, *m.span())):
            done = key[2]
            yield key
    for m in ENCODED_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(m[0]))):
            yield kind, *m.span()


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id`` and ``found``, its spans (kind, start, end) by start, then kind."""
    order = {k: i for i, k in enumerate(KINDS)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                each = sorted(spans(text.as_py() or ""), key=lambda s: (s[1], order[s[0]], s[2]))
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in each])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, found array<struct<kind string, start long, end long>>")


def summary(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and digests of the spans."""
    line = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    base = "filter(found, s -> s.kind in ({}))".format(", ".join(f"'{k}'" for k in BASE))
    count = "cast(size(filter(found, s -> s.kind = '{}')) as long)"
    return found.select(
        "doc_id",
        *[F.expr(count.format(k)).alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(line.format(base)).cast("binary"), 256).alias("base_sha256"),
        F.expr(line.format("found")).alias("spans"),
    )
