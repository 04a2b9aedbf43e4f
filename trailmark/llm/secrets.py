"""Secret scans: assignments, access keys and hex runs by pattern; keys and signed tokens by their decoded structure."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and least lengths of the base kinds, in their order; all kinds in order of report.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters
HEX = r"[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "armor", "key", "token", "wrapped")

# Object identifiers of key formats, as the DER bytes behind tag 6.
OID_RSA = bytes.fromhex("2a864886f70d010101")
OID_EC = bytes.fromhex("2a8648ce3d0201")
OID_EDWARDS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
OID_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
OID_PKCS7 = bytes.fromhex("2a864886f70d0107")
# Signature bytes by signing algorithm of a token.
SIGNATURES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114)}
RSA_SIGNATURE = (128, 2048)
OPENSSH = b"openssh-key-v1\0"

DEPTH = 3  # encodings inside encodings
_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS, _HEX = re.compile(ACCESS), re.compile(HEX)
_ARMOR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----")
# A run of base64 in either alphabet, then whole lines of it; 40 characters are the shortest private key but a few.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[A-Za-z0-9+/_-]++={0,2}(?![^\r\n]))*+={0,2}")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}+")
_HEX_PAIRS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){31,}+")
# Three dotted parts from any part that can begin with { in base64.
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])(?=(e[yw3][A-Za-z0-9_-]{6,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]{8,}+))")
_STANDARD = str.maketrans("-_", "+/")


class Finding(NamedTuple):
    kind: str
    start: int
    end: int
    detail: str


# -- DER: nested lengths --


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first byte, end) of the value at ``at``; None unless its length is definite, shortest and inside ``end``."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n >= 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n = int.from_bytes(data[at : at + size])
        at += size
        if n < 0x80 or n >> (8 * (size - 1)) == 0:
            return None
    return (tag, at, at + n) if at + n <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All values between two bytes, which they must fill."""
    out = []
    while at < end:
        found = element(data, at, end)
        if found is None:
            return None
        out.append(found)
        at = found[2]
    return out


def _number(data: bytes, part: tuple[int, int, int]) -> int:
    return int.from_bytes(data[part[1] : part[2]], signed=True) if part[2] > part[1] else -1


def der_key(data: bytes, at: int = 0, end: int | None = None) -> tuple[str, int] | None:
    """(format, end) of the private key in DER at ``at``; every nested length must fit and fill its parent."""
    end = len(data) if end is None else end
    top = element(data, at, end)
    if top is None or top[0] != 0x30:
        return None
    parts = elements(data, top[1], top[2])
    if not parts:
        return None
    name = _layout(data, parts, "".join({0x02: "i", 0x03: "b", 0x04: "o", 0x06: "d", 0x30: "s", 0xA0: "0", 0xA1: "1"}.get(p[0], "?") for p in parts))
    return (name, top[2]) if name else None


def _layout(data: bytes, parts: list[tuple[int, int, int]], shape: str) -> str | None:
    """Which private key a sequence with these parts is: one letter a part."""
    body = lambda p: data[p[1] : p[2]]
    if shape == "i" * 9 or shape == "i" * 9 + "s":
        version, n, e, d, p, q, *_ = (_number(data, x) for x in parts[:9])
        return "pkcs1" if version in (0, 1) and min(e, d) > 1 and 1 < min(p, q) <= max(p, q) < n and n % 2 else None
    if shape == "i" * 6:
        version, p, q, g, y, x = (_number(data, x) for x in parts)
        return "dsa" if version == 0 and 0 < x < q < p and 1 < g < p and 1 < y < p else None
    if shape in ("io", "io0", "io1", "io01"):
        return "sec1" if _number(data, parts[0]) == 1 and 16 <= parts[1][2] - parts[1][1] <= 72 else None
    if shape in ("iso", "iso0", "iso1", "iso01"):
        named = elements(data, parts[1][1], parts[1][2])
        if _number(data, parts[0]) not in (0, 1) or not named or named[0][0] != 0x06:
            return None
        oid, (_, first, last) = body(named[0]), parts[2]
        if oid in OID_EDWARDS:
            inner = element(data, first, last)
            return "pkcs8 edwards" if inner and inner[0] == 0x04 and inner[2] == last and inner[2] - inner[1] == OID_EDWARDS[oid] else None
        if oid in (OID_RSA, OID_EC):
            inner = der_key(data, first, last)
            return f"pkcs8 {inner[0]}" if inner and inner[1] == last and inner[0] == ("pkcs1" if oid == OID_RSA else "sec1") else None
        inner = element(data, first, last)
        return "pkcs8" if inner and inner[2] == last and inner[0] in (0x02, 0x04, 0x30) else None
    if shape == "so":
        named = elements(data, parts[0][1], parts[0][2])
        encrypted = named and named[0][0] == 0x06 and body(named[0]).startswith(OID_PBE) and parts[1][2] > parts[1][1]
        return "pkcs8 encrypted" if encrypted else None
    if shape in ("is", "iss"):
        named = elements(data, parts[1][1], parts[1][2])
        return "pkcs12" if _number(data, parts[0]) == 3 and named and named[0][0] == 0x06 and body(named[0]).startswith(OID_PKCS7) else None
    return None


# -- other structures --


def openssh_key(data: bytes) -> tuple[str, int] | None:
    """(format, end) of an OpenSSH private key: length-prefixed strings, and in plain keys the two equal check numbers."""
    if not data.startswith(OPENSSH):
        return None
    at = len(OPENSSH)

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4])
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    cipher, kdf, options = string(), string(), string()
    if cipher is None or kdf is None or options is None or at + 4 > len(data):
        return None
    count = int.from_bytes(data[at : at + 4])
    at += 4
    if not 1 <= count <= 16:
        return None
    for _ in range(count):
        public = string()
        if public is None or int.from_bytes(public[:4]) + 4 > len(public):
            return None
    secret = string()
    if secret is None or len(secret) < 8 or (cipher == b"none" and secret[:4] != secret[4:8]):
        return None
    return ("openssh" if cipher == b"none" else "openssh encrypted"), at


def pgp_key(data: bytes) -> bool:
    """Whether bytes are packets of OpenPGP whose first one is a secret key; its length must fit."""
    if len(data) < 3 or not data[0] & 0x80:
        return False
    if data[0] & 0x40:
        tag, first = data[0] & 0x3F, data[1]
        n, head = (first, 2) if first < 192 else ((first - 192 << 8) + data[2] + 192, 3) if first < 224 else (int.from_bytes(data[2:6]), 6) if first == 255 else (-1, 0)
    else:
        tag, size = data[0] >> 2 & 0x0F, (1, 2, 4, 0)[data[0] & 3]
        n, head = int.from_bytes(data[1 : 1 + size]), 1 + size
    return tag in (5, 7) and 6 < n <= len(data) - head and data[head] in (3, 4, 5, 6)


def decoded(text: str) -> bytes:
    """What base64 in either alphabet stands for; a last character that completes no byte is left out."""
    text = re.sub(r"[\s=]", "", text).translate(_STANDARD)
    text = text[: len(text) - (len(text) % 4 == 1)]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def signed_token(head: str, body: str, signature: str) -> str | None:
    """The algorithm of a signed token: a JSON header that names it, a JSON object, a signature of its length."""
    try:
        header, claims = json.loads(decoded(head)), json.loads(decoded(body))
    except (ValueError, RecursionError):
        return None
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str):
        return None
    name = header["alg"]
    low, high = RSA_SIGNATURE if name[:2] in ("RS", "PS") else SIGNATURES.get(name, (16, 4096))
    return name if name.lower() != "none" and low <= len(decoded(signature)) <= high else None


def _armor(label: str, body: str) -> str | None:
    """The format of an armored private key, from its decoded body."""
    lines = body.replace("\\r", "").replace("\\n", "\n").splitlines()
    headers = [x for x in lines if ":" in x]
    data = decoded("".join(x.strip() for x in lines if ":" not in x and not x.startswith("=")))
    if "BLOCK" in label:
        return "pgp" if pgp_key(data) else None
    if any(x.startswith("DEK-Info:") for x in headers):
        return "encrypted" if len(data) >= 16 and len(data) % 8 == 0 else None
    found = der_key(data) or openssh_key(data)
    return found[0] if found and found[1] == len(data) else None


# -- scan --


def base_findings(text: str) -> Iterator[Finding]:
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                yield Finding("assign", m.start(), m.end(), m[1].lower())
    if "AKIA" in text:
        yield from (Finding("access", m.start(), m.end(), "") for m in _ACCESS.finditer(text))
    yield from (Finding("hex", m.start(), m.end(), "") for m in _HEX.finditer(text))


def _key(data: bytes) -> tuple[str, int] | None:
    return der_key(data) if data[:1] == b"\x30" else openssh_key(data)


def _wrapped(data: bytes, depth: int) -> str | None:
    """What secret a decoded text holds, if it is one: a structure, or a base pattern other than plain hex."""
    if not data or depth >= DEPTH:
        return None
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    if re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text):
        return None
    inner = next(structures(text, depth + 1), None) or next((f for f in base_findings(text) if f.kind != "hex"), None)
    return f"{inner.kind} {inner.detail}".strip() if inner else None


def structures(text: str, depth: int = 0) -> Iterator[Finding]:
    """Candidates whose decoded form is a private key, a signed token or a text that holds one."""
    covered = []
    heads = list(_ARMOR.finditer(text)) if "-----BEGIN " in text else []
    for m, after in zip(heads, [*heads[1:], None]):
        tail = f"-----END {m[1]}-----"
        stop = text.find(tail, m.end(), after.start() if after else len(text))
        if stop >= 0 and (name := _armor(m[1], text[m.end() : stop])):
            covered.append((m.start(), stop + len(tail)))
            yield Finding("armor", *covered[-1], name)
    if "." in text:
        for m in _DOTTED.finditer(text):
            if name := signed_token(*m.groups()):
                yield Finding("token", m.start(), m.end(3), name)

    def inside(m: re.Match) -> bool:
        at = bisect_right(covered, (m.start(), len(text))) - 1
        return at >= 0 and m.end() <= covered[at][1]

    runs = [m for m in _RUN.finditer(text) if not inside(m)]
    # Plain hex lies in runs of base64, whose characters include its own.
    digits = [h for m in runs for h in _HEX_RUN.finditer(text, m.start(), m.end())]
    if ":" in text:
        digits += [h for h in _HEX_PAIRS.finditer(text) if not inside(h)]
    for m in digits:
        step = 3 if ":" in m[0] else 2
        data = bytes.fromhex(m[0].replace(":", "") if step == 3 else m[0][: len(m[0]) & ~1])
        if found := _key(data):
            yield Finding("key", m.start(), m.start() + found[1] * step - (step == 3), found[0])
        elif name := _wrapped(data, depth):
            yield Finding("wrapped", m.start(), m.end(), name)
    for m in runs:
        data = decoded(m[0])
        if found := _key(data):
            yield Finding("key", m.start(), _run_end(m, found[1]), found[0])
        elif name := _wrapped(data, depth):
            yield Finding("wrapped", m.start(), m.end(), name)


def _run_end(m: re.Match, size: int) -> int:
    """Where in a base64 run its first ``size`` bytes end, with the padding that belongs to them."""
    signs = -(-size * 4 // 3)
    for at, c in enumerate(m[0]):
        signs -= c not in "\r\n="
        if not signs:
            end = m.start() + at + 1
            pad = re.compile("={0,2}").match(m.string, end)
            return min(m.end(), pad.end())
    return m.end()


def findings(text: str) -> list[Finding]:
    """All findings by start, then kind; code points, ends exclusive."""
    found = {*base_findings(text), *structures(text)}
    return sorted(found, key=lambda f: (f.start, KINDS.index(f.kind), f.end, f.detail))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its secrets: ``findings``, an array of ``kind``, ``start``, ``end`` (code points, end exclusive), ``detail``.

    Base kinds are matched leftmost without overlap, each by itself: ``assign`` (a value of 12 or more characters after a
    telling name), ``access`` and ``hex``; a match that is too short is dropped, and what it covered stays passed over.
    Other kinds are reported only when the decoded candidate has the structure:

    * ``armor``: a private key between BEGIN and END lines (DER, OpenSSH, OpenPGP, or encrypted with a cipher header);
    * ``key``: a private key in a bare run of base64 (both alphabets, over lines) or hex (with or without colons): PKCS#1,
      PKCS#8, SEC1, DSA, PKCS#12 in DER, whose nested lengths must all fit, or OpenSSH;
    * ``token``: a signed token, whose header names an algorithm and whose signature has that algorithm's length;
    * ``wrapped``: base64 or hex of a text that holds one of these, an assignment or an access key, up to three encodings deep.

    Public keys, certificates and unsigned tokens are none. Null and empty texts have no findings. One narrow pass with
    patterns linear in the text; repeated rows each give a row, a null id stays null, other columns are not read.
    """
    shape = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())])

    def run(batches):
        for batch in batches:
            found = [[f._asdict() for f in findings(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(shape))], names=["id", "findings"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, findings array<struct<kind:string,start:bigint,end:bigint,detail:string>>")
    return out.select(F.col("id").alias(id_col), "findings")


def of_kind(kind: str) -> Column:
    """How many findings of one kind a row of ``scan`` has."""
    return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")


def listed(*kinds: str) -> Column:
    """The findings (of these kinds, all if none is named) as ``kind:start:end``, joined with commas."""
    those = F.filter("findings", lambda f: f["kind"].isin(*kinds)) if kinds else F.col("findings")
    return F.array_join(F.transform(those, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
