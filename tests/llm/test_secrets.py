"""Secret scans: plain rules against the patterns as stated, keys and tokens built by hand and damaged in many ways."""

import base64
import json
import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from muniframe.llm import secrets
from muniframe.llm.queries import QUERIES

RULES = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def base_spans(text):
    out = [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(RULES.items()) for m in re.finditer(p, text or "") if ok(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def tlv(tag, *content):
    body = b"".join(content)
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def number(rng, size):
    return tlv(2, bytes([rng.randint(1, 127)]) + rng.randbytes(size - 1))


def rsa(rng, size=128):
    return tlv(0x30, tlv(2, b"\0"), number(rng, size), tlv(2, b"\1\0\1"), number(rng, size), *(number(rng, size // 2) for _ in range(5)))


def pkcs8(rng):
    return tlv(0x30, tlv(2, b"\0"), tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101")), tlv(5)), tlv(4, rsa(rng)))


def ed25519(rng):
    return tlv(0x30, tlv(2, b"\0"), tlv(0x30, tlv(6, b"\x2b\x65\x70")), tlv(4, tlv(4, rng.randbytes(32))))


def sec1(rng):
    return tlv(0x30, tlv(2, b"\1"), tlv(4, rng.randbytes(32)), tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))), tlv(0xA1, tlv(3, b"\0\4" + rng.randbytes(64))))


def encrypted(rng):
    return tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")), tlv(0x30, tlv(5))), tlv(4, rng.randbytes(64)))


def openssh(rng):
    s = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(rng.randbytes(51)) + s(rng.randbytes(136))


def public(rng):
    return tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101")), tlv(5)), tlv(3, b"\0" + tlv(0x30, number(rng, 128), tlv(2, b"\1\0\1"))))


KEYS = [rsa, pkcs8, ed25519, sec1, encrypted, openssh]


def b64(data, url=False):
    return (base64.urlsafe_b64encode(data).rstrip(b"=") if url else base64.b64encode(data)).decode()


def pem(data, label, width=64, mark="\n"):
    body = b64(data)
    return f"-----BEGIN {label}-----{mark}" + mark.join(body[k : k + width] for k in range(0, len(body), width)) + f"{mark}-----END {label}-----"


def jwt(rng, header=None, body=None, signature=32):
    dumped = [json.dumps(x).encode() for x in (header or {"alg": "HS256", "typ": "JWT"}, body or {"sub": "é", "n": 1})]
    return ".".join([*(b64(x, True) for x in dumped), b64(rng.randbytes(signature), True)])


def added(text):
    return [(k, text[a:b]) for k, a, b in secrets.secrets_of(text) if k in ("jwt", "key")]


@pytest.mark.parametrize("make", KEYS)
def test_keys(make):
    rng = random.Random(make.__name__)
    for _ in range(20):
        key = make(rng)
        wrapped = "\n".join(re.findall(".{1,76}", b64(key)))
        for form in (b64(key), b64(key, True), key.hex(), key.hex().upper(), ":".join(re.findall("..", key.hex())), wrapped, pem(key, "PRIVATE KEY"), pem(key, "X PRIVATE KEY", 76, "\\n")):
            text = f"é prose before {form} and prose after it"
            assert added(text) == [("key", form)], form
        assert added(f"key: {b64(key)}") == [("key", b64(key))]
        assert added(f"{b64(b'plain text of some length that is no key at all')}\n{b64(key)}") == [("key", b64(key))]
        assert added(b64(pem(key, "PRIVATE KEY").encode())) == [("key", b64(pem(key, "PRIVATE KEY").encode()))]
        whole = json.dumps({"type": "account", "private_key": pem(key, "PRIVATE KEY")}).encode()
        assert added(f"config={b64(whole)} end") == [("key", b64(whole))]
        assert len(added(pem(key, "PRIVATE KEY") + "\n\n" + pem(key, "PRIVATE KEY"))) == 2


@pytest.mark.parametrize("make", KEYS)
def test_damaged_keys(make):
    """What does not parse is not reported: cut, wrong lengths, other types, armour without its end."""
    rng = random.Random(make.__name__)
    for _ in range(20):
        key = make(rng)
        cut = key[: -rng.randint(1, 20)]
        for bad in (cut, b"\x31" + key[1:], key[:1] + bytes([key[1] ^ 4]) + key[2:], bytes(len(key)), rng.randbytes(len(key)), public(rng)):
            assert added(f"x {b64(bad)} y") == [] == added(f"x {bad.hex()} y")
            assert added(pem(bad, "PRIVATE KEY")) == []
        assert all(form != pem(key, "A PRIVATE KEY") for _, form in added(pem(key, "A PRIVATE KEY").replace("END A", "END B")))
    assert added("-----BEGIN PRIVATE KEY-----\n" * 2000) == [] == added("-----BEGIN PRIVATE KEY-----\n-----END PRIVATE KEY-----")


def test_locked_and_pgp():
    rng = random.Random(3)
    locked = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011\n\n" + b64(rng.randbytes(640)) + "\n-----END RSA PRIVATE KEY-----"
    assert added(f"a {locked} b") == [("key", locked)]
    packet = b"\x95" + (200).to_bytes(2, "big") + b"\4" + rng.randbytes(199)
    block = "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: 1\n\n" + b64(packet) + "\n=abcd\n-----END PGP PRIVATE KEY BLOCK-----"
    assert added(f"a {block} b") == [("key", block)]
    assert added(block.replace(b64(packet), b64(packet[:90]))) == []


def test_tokens():
    rng = random.Random(5)
    for signature in (32, 64, 256):
        token = jwt(rng, signature=signature)
        for text in (token, f"Bearer {token}.", f"é token={token}, and", f"({token})", f"{token} {token}"):
            assert added(text)[0] == ("jwt", token)
    sealed = ".".join([b64(b'{"alg":"dir","enc":"A128GCM"}', True), "", b64(rng.randbytes(12), True), b64(rng.randbytes(40), True), b64(rng.randbytes(16), True)])
    assert added(sealed) == [("jwt", sealed)]
    head, body, sign = jwt(rng).split(".")
    for bad in (f"{head}.{body}", f"{body}.{body}.{sign}", f"{head}.{sign}.{sign}", f"{head}.{body}.abc", jwt(rng, {"alg": "none"}), jwt(rng, {"typ": "JWT"}), f"x{head}.{body}.{sign}", "word.other.third", f"{b64(b'[' * 60_000, True)}.a.b"):
        assert added(bad) == [], bad
    jwk = b64(json.dumps({"kty": "OKP", "d": "x" * 43}).encode())
    assert added(jwk) == [("key", jwk)] and added(b64(json.dumps({"kty": "OKP", "x": "x" * 43}).encode())) == []


ODD = [
    None, "", "token", "token=short", "TOKEN = 'abc.def'", "toKen=ſecret", "toKen=abcdefgh", "password:\"s3cretpass\" passwd = abcdef", "api_key=abcdef apikey: abcde api__key=abcdef", "token=token:abcdefgh",
    "AKIA" + "A1" * 8, "AKIAAKIA" + "A1" * 6, "AKIAX AKIA" + "B" * 30, "é" * 30 + "0123456789abcdef" * 3, "f" * 23, "f" * 24 + "g" + "0" * 25, "a\x00token=abcdef\x00", "token=" + "a" * 2_000_000,
    "M" * 300_000, "MIIB" * 100_000, "eyJ" * 50_000, "a." * 200_000, "\n".join(["MIIE" + "A" * 60] * 5000), "secret:\n abcdef", "secret=  abcdef=", "a:" * 100_000,
]


def test_query(spark):
    for directory in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = brute.table("documents", directory)
        got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_secret_scan"](spark, directory).collect()}
        assert len(got) == len(docs)
        for d in docs:
            base = base_spans(d["text"])
            assert got[d["doc_id"]] == (*(sum(s[0] == k for s in base) for k in RULES), brute.sha(listed(base)), listed(base))
    assert any(g[0] for g in got.values()) and any(g[2] for g in got.values())


def test_odd_rows(spark):
    rng = random.Random(9)
    texts = [*ODD, f"token={jwt(rng)} {pem(rsa(rng), 'PRIVATE KEY')}", "x" * 5 + jwt(rng)]
    rows = [(k, t, "clash", None) for k, t in enumerate(texts)] + [(1, "token=abcdef", None, None)] * 2 + [(None, "token=abcdef", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int")
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.find_secrets(docs).collect()), key=str)
    assert [(k, [s for s in spans if s[0] in RULES]) for k, spans in got] == sorted(((r[0], base_spans(r[1])) for r in rows), key=str)
    assert [s[0] for s in dict(got)[len(ODD)]] == ["assign", "jwt", "key"]
    assert secrets.find_secrets(docs.limit(0)).count() == 0
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(docs.where("doc_id > 1")).collect()}
    assert masked[len(ODD)] == "<secret> <secret>" and masked[2] == "token" and masked[3] == "token=short"
    assert secrets.mask_secrets(docs).columns == docs.columns and secrets.mask_secrets(docs.where("doc_id = 0")).first().text is None
