"""Secret scans: base patterns against a plain version, structures built byte by byte."""

import base64
import hashlib
import hmac
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import awkward, prose, shown
from trailmark.llm import secrets
from trailmark.llm.queries import op11_secrets
from trailmark.llm.secrets import findings


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8))
    return bytes([tag]) + size + body


def number(x):
    return der(2, x.to_bytes(x.bit_length() // 8 + 1))


def oid(hexed):
    return der(6, bytes.fromhex(hexed))


P, Q = (1 << 521) - 1, (1 << 607) - 1
RSA = der(0x30, *(number(x) for x in (0, P * Q, 65537, 12345678901, P, Q, 11, 13, 17)))
PKCS8 = der(0x30, number(0), der(0x30, oid("2a864886f70d010101"), b"\5\0"), der(4, RSA))
SEC1 = der(0x30, number(1), der(4, bytes(range(32))), der(0xA0, oid("2a8648ce3d030107")))
EDWARDS = der(0x30, number(0), der(0x30, oid("2b6570")), der(4, der(4, bytes(range(1, 33)))))
PUBLIC = der(0x30, der(0x30, oid("2a864886f70d010101"), b"\5\0"), der(3, b"\0" + der(0x30, number(P * Q), number(65537))))
ENCRYPTED = der(0x30, der(0x30, oid("2a864886f70d01050d"), der(0x30, number(1))), der(4, bytes(96)))


def string(x):
    return len(x).to_bytes(4) + x


def openssh(check=b"abcdabcd"):
    public = string(string(b"ssh-ed25519") + string(bytes(32)))
    return b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4) + public + string(check + string(b"ssh-ed25519") + bytes(40))


def b64(data, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(data).decode()


def part(value):
    return b64(value if isinstance(value, bytes) else json.dumps(value).encode(), True).rstrip("=")


def token(head=None, body=None, size=32):
    signed = f"{part(head or {'alg': 'HS256', 'typ': 'JWT'})}.{part(body or {'sub': 'x'})}"
    return f"{signed}.{part(hmac.new(b'k', signed.encode(), hashlib.sha512).digest()[:size])}"


def armor(label, data, width=64):
    lines = b64(data)
    return f"-----BEGIN {label}-----\n" + "\n".join(lines[i : i + width] for i in range(0, len(lines), width)) + f"\n-----END {label}-----"


def more(text):
    return [(f.kind, text[f.start : f.end], f.detail) for f in findings(text) if f.kind not in secrets.BASE_KINDS]


def plain(text):
    """The base kinds, written once more: whole matches first, lengths after."""
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for k, (pattern, least) in enumerate((("AKIA[A-Z0-9]+", 18), ("[0-9a-f]+", 16)), 1):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def base(text):
    return ",".join(f"{f.kind}:{f.start}:{f.end}" for f in findings(text) if f.kind in secrets.BASE_KINDS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "ToKeN", "api_key", "apikey", "secret", "ſecret", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12", "deadbeef", "0123456789abcdef", "a", "é😀", ".", "-", "\n", "xyz012345678"]), max_size=25))
def test_base_kinds(parts):
    assert base("".join(parts)) == plain("".join(parts))


def test_short_matches_cover_what_they_took():
    assert base("token: secret: abcdefghijklmnop") == ""
    assert base("token=secret=abcdefghijklmnop") == "assign:0:29"


@pytest.mark.parametrize(
    "data, name",
    [(RSA, "pkcs1"), (PKCS8, "pkcs8 pkcs1"), (SEC1, "sec1"), (EDWARDS, "pkcs8 edwards"), (ENCRYPTED, "pkcs8 encrypted"), (openssh(), "openssh")],
)
def test_keys_in_every_encoding(data, name):
    for text in (b64(data), b64(data, True), b64(data).rstrip("=")):
        assert more(f"see {text}, there") == [("key", text, name)]
    lines = "\n".join(b64(data)[i : i + 64] for i in range(0, len(b64(data)), 64))
    assert more(f"see {lines}\nand more words") == [("key", lines, name)]
    for text in (data.hex(), data.hex().upper(), data.hex(":")):
        assert [x for x in more(f"x {text} y") if x[0] == "key"] == [("key", text, name)]
    block = armor("PRIVATE KEY", data)
    assert more(f"a\n{block}\nb") == [("armor", block, name)]
    assert more("a " + block.replace("\n", "\\n"))[0][0] == "armor"
    wrapped = b64(block.encode())
    assert more(f"data: {wrapped}") == [("wrapped", wrapped, f"armor {name}")]
    assert more(f"data: {b64(wrapped.encode())}")[0][0] == "wrapped"


def test_a_key_followed_by_other_bytes_ends_where_its_length_says():
    text = b64(SEC1 + bytes(30))
    (found,) = more(text)
    assert found[0] == "key" and text.startswith(found[1]) and base64.b64decode(found[1] + "=" * (-len(found[1]) % 4))[: len(SEC1)] == SEC1
    assert len(found[1]) == -(-len(SEC1) * 4 // 3)


def test_what_only_looks_like_a_key():
    for data in (PUBLIC, RSA[:-1], PKCS8[:-3], SEC1[:-1] + b"", b"\x30" + bytes(80), openssh(b"abcdabce"), bytes(range(100)), der(0x30, number(0), PKCS8)):
        assert more(b64(data)) == []
        assert more(data.hex()) == []
        assert more(armor("PRIVATE KEY", data)) == []
    long_form = b"\x30\x81" + SEC1[1:]  # not the shortest length
    assert more(b64(long_form)) == []
    nested = der(0x30, number(0), der(0x30, oid("2a864886f70d010101"), b"\5\0"), der(4, RSA + b"\0"))
    assert more(b64(nested)) == []
    assert more("-----BEGIN PRIVATE KEY-----\nno end " * 50) == []


def test_signed_tokens():
    for text, name in ((token(), "HS256"), (token({"alg": "HS512"}, size=64), "HS512"), (token({"alg": "ES256"}, size=64), "ES256"), (token({"alg": "own"}), "own")):
        assert more(f"Bearer {text}.") == [("token", text, name)]
        assert more(f"a.bcd.{text}") == [("token", text, name)]
    for head, size in (({"alg": "none"}, 32), ({"alg": "HS256"}, 31), ({"alg": "RS256"}, 64), ({"typ": "JWT"}, 32), ({"alg": 5}, 32), ([1, 2, 3], 32)):
        assert more(token(head, size=size)) == []
    assert more(f"{part(b'{not json at all')}.{part({})}.{part(bytes(32))}") == []
    assert more(f"{part({'alg': 'HS256'})}.{part(b'[1, 2]')}.{part(bytes(32))}") == []
    assert more("www.example.com eyes.on.prizes eyJhbGciOi.eyJ.x") == []


def test_armor_with_headers_and_openpgp():
    block = armor("RSA PRIVATE KEY", bytes(64)).replace("-----\n", "-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n", 1)
    assert more(block) == [("armor", block, "encrypted")]
    packet = bytes([0x95, 0, 40, 4]) + bytes(39)
    block = armor("PGP PRIVATE KEY BLOCK", packet).replace("-----\n", "-----\nVersion: 1\n\n", 1).replace("\n-----END", "\n=abcd\n-----END")
    assert more(block) == [("armor", block, "pgp")]
    assert more(armor("PGP PRIVATE KEY BLOCK", bytes([0x99, 0, 40, 4]) + bytes(39))) == []  # a public key


def test_wrapped_texts():
    inner = b64(b"user: me\npassword = hunter2hunter2hunter2\n")
    assert more(inner) == [("wrapped", inner, "assign password")]
    assert more(b64(b"just a longer text without any secret inside it")) == []
    assert more(b64(b"0123456789abcdef0123456789abcdef0123456789")) == []


def test_positions_are_code_points():
    text = "😀é " + token() + " 😀 AKIA" + "Q" * 16
    found = findings(text)
    assert [(f.kind, text[f.start : f.end]) for f in found] == [("token", token()), ("access", "AKIA" + "Q" * 16)]


def test_long_texts_are_linear():
    for text in ("a" * 400_000, "a.b-" * 100_000, "-----BEGIN PRIVATE KEY-----" * 15_000, "ey" * 200_000, "AKIA" * 100_000, "eyaaaaaaa." * 40_000, ("A" * 60 + "\n") * 6_000, "token=" * 60_000, "12:" * 130_000):
        findings(text)


def test_rows(spark):
    docs = awkward(spark)
    found = {(r["doc_id"], str(r["findings"])) for r in shown(secrets.scan(docs))}
    assert len(shown(secrets.scan(docs))) == docs.count()
    assert (4, "[]") in found and (None, "[]") in found
    assert secrets.scan(docs.where("1 = 0")).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in shown(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
    got = shown(op11_secrets(spark, sf_dir))
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        want = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [want.count(k + ":") for k in ("assign", "access", "hex")]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    assert sum(r["n_assign"] + r["n_access"] for r in got) > 0


def test_planted_in_prose(spark):
    rng = random.Random(5)
    planted = [b64(PKCS8), token(), armor("OPENSSH PRIVATE KEY", openssh()), SEC1.hex()]
    rows = [(i, prose(i, 60) + " " + rng.choice(planted) + " " + prose(i + 99, 60) if i % 2 else prose(i, 120)) for i in range(40)]
    got = shown(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r["doc_id"] for r in got if any(f["kind"] not in secrets.BASE_KINDS for f in r["findings"])} == {i for i in range(40) if i % 2}
