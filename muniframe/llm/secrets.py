"""Secrets in texts: plain rules, and encoded keys and signed tokens that are reported only once their structure is confirmed.

The plain kinds (assign, access, hex) are the leftmost non-overlapping matches of their patterns that are long enough.

The method adds two kinds. Candidates are runs of base64 (also over line breaks), base64url or hex, armoured blocks and dotted
tokens. Each is decoded, and what comes out has to parse:

* ``key``: a DER private key (PKCS#1, DSA, SEC1, PKCS#8 plain or encrypted, PKCS#12): definite lengths, nested elements that
  fill their parents exactly, the right types in the right order; an OpenSSH key, whose nested strings have to fit; an OpenPGP secret-key packet; a
  JSON object with private key members; or a text that itself holds an armoured key. The outer length says where a key ends, so text
  glued to a run is left out. Certificates and public keys parse as well, but are no secrets.
* ``jwt``: a header that decodes to a JSON object with an algorithm, a decodable body and a signature (three segments),
  or a header with an encryption (five).

One linear filter over a batch's column finds the texts that have any candidate; only those are looked at one by one.
Texts are never shuffled.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "jwt", "key"]

#: Pattern, group and least length of the plain kinds.
RULES = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
#: A text without a match of this has neither a plain secret nor a candidate.
ANY = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[A-Za-z0-9+/_-]{24}|-----BEGIN |([0-9a-f]{2}:){16}|[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]"""

RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+(?:\r?\n[\x20\t]*+(?!--)[A-Za-z0-9+/_-]++)*+={0,2}")
HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{48,}+|[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){23,}+)(?![0-9A-Za-z])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]*+){2,}+")
ARMOUR = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*)PRIVATE KEY( BLOCK)?-----")
BREAK = re.compile(r"\s+|\\r|\\n")

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Object identifiers, or their first bytes: password-based encryption (PKCS#5, PKCS#12) and content types (PKCS#7).
PBES, PBE, CONTENT = (bytes.fromhex(x) for x in ("2a864886f70d0105", "2a864886f70d010c01", "2a864886f70d0107"))
DEEP = 2


def unbased(text: str) -> bytes | None:
    """Bytes of base64 or base64url text, not of both mixed; a character at its end that makes no byte is left out."""
    if ("-" in text or "_" in text) and ("+" in text or "/" in text):
        return None
    plain = text.rstrip("=").translate({0x2D: "+", 0x5F: "/"})
    try:
        return base64.b64decode(plain[: len(plain) - (len(plain) % 4 == 1)] + "=" * (-len(plain) % 4 % 3), validate=True)
    except (binascii.Error, ValueError):
        return None


Element = tuple[int, int, int]  # tag, first and last + 1 byte of the content


def element(data: bytes, at: int, end: int) -> Element | None:
    """The element at ``at``, if its length is in shortest form and fits before ``end``."""
    if end - at < 2:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or end - at < more:
            return None
        size, at = int.from_bytes(data[at : at + more]), at + more
        if size < 0x80 or size >> (8 * (more - 1)) == 0:
            return None
    return (tag, at, at + size) if at + size <= end else None


def members(data: bytes, outer: Element) -> list[Element] | None:
    """The elements inside another one, if they fill it exactly."""
    out, at = [], outer[1]
    while at < outer[2]:
        inner = element(data, at, outer[2])
        if inner is None or len(out) > 16:
            return None
        out.append(inner)
        at = inner[2]
    return out


def _identified(data: bytes, inner: Element) -> bytes | None:
    """The object identifier that opens a sequence."""
    parts = members(data, inner) if inner[0] == SEQUENCE else None
    return data[parts[0][1] : parts[0][2]] if parts and parts[0][0] == OID else None


def der_key(data: bytes) -> int | None:
    """Bytes of the private key that ``data`` begins with."""
    outer = element(data, 0, len(data))
    parts = members(data, outer) if outer is not None and outer[0] == SEQUENCE else None
    if not parts or len(parts) < 2:
        return None
    tags, sizes = [p[0] for p in parts], [p[2] - p[1] for p in parts]
    first = data[parts[0][1] : parts[0][2]]
    oid = _identified(data, parts[1]) if len(parts) > 2 else None
    fits = (
        tags == [INTEGER] * 9 and first == b"\0" and sizes[1] >= 32 and 2 * sizes[4] <= sizes[1] + 4  # PKCS#1: modulus, exponents, primes
        or tags == [INTEGER] * 9 + [SEQUENCE] and first == b"\1"
        or tags == [INTEGER] * 6 and first == b"\0" and sizes[1] >= 64  # DSA: p, q, g, y, x
        or tags[:2] == [INTEGER, OCTETS] and first == b"\1" and 16 <= sizes[1] <= 66 and set(tags[2:]) <= {0xA0, 0xA1}  # SEC1
        or tags[:3] == [INTEGER, SEQUENCE, OCTETS] and first in (b"\0", b"\1") and bool(oid) and sizes[2] >= 16 and set(tags[3:]) <= {0xA0, 0xA1, 0x81}  # PKCS#8
        or tags == [SEQUENCE, OCTETS] and sizes[1] >= 16 and (_identified(data, parts[0]) or b"").startswith((PBES, PBE))  # PKCS#8, encrypted
        or tags[:2] == [INTEGER, SEQUENCE] and first == b"\3" and (oid or _identified(data, parts[1]) or b"").startswith(CONTENT)  # PKCS#12
    )
    return outer[2] if fits else None


def openssh_key(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key that ``data`` begins with: nested strings, each behind its length."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, left = len(magic), [3, None, 0]  # cipher, kdf, kdf options; then the number of public keys; then these and the private part
    while left[0] or left[1] is None or left[2]:
        if len(data) - at < 4:
            return None
        size, at = int.from_bytes(data[at : at + 4]), at + 4
        if not left[0] and left[1] is None:
            if not 1 <= size <= 16:
                return None
            left[1], left[2] = size, size + 1
            continue
        if size > len(data) - at:
            return None
        at += size
        left[0 if left[0] else 2] -= 1
    return at


def pgp_key(data: bytes) -> int | None:
    """Bytes of the OpenPGP secret-key packet (version 3 to 6) that ``data`` begins with."""
    if len(data) < 8 or data[0] not in (0x94, 0x95, 0xC5):
        return None
    if data[0] == 0xC5:
        begin, size = (2, data[1]) if data[1] < 192 else (3, ((data[1] - 192) << 8) + data[2] + 192) if data[1] < 224 else (6, int.from_bytes(data[2:6]))
    else:
        begin, size = (2, data[1]) if data[0] == 0x94 else (3, int.from_bytes(data[1:3]))
    return begin + size if size >= 16 and begin + size <= len(data) and data[begin] in (3, 4, 5, 6) else None


def _object(data: bytes | None) -> dict | None:
    if not data or not data.lstrip()[:1] == b"{":
        return None
    try:
        found = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _private_members(found: dict) -> bool:
    """A JSON web key with its private part, or a member that is an armoured key."""
    if isinstance(found.get("kty"), str) and any(isinstance(found.get(c), str) and len(found[c]) >= 16 for c in ("d", "k")):
        return True
    return any(isinstance(v, str) and "PRIVATE KEY" in v and bool(armoured(v)) for v in found.values())


def key_bytes(data: bytes | None, deep: int = 0) -> int | None:
    """How many bytes at the start of ``data`` are a confirmed key."""
    if not data:
        return None
    for parse in (der_key, openssh_key):
        size = parse(data)
        if size is not None:
            return size
    found = _object(data)
    if found is not None:
        return len(data) if _private_members(found) else None
    if deep < DEEP and b"PRIVATE KEY" in data:
        try:
            return len(data) if armoured(data.decode(), deep + 1) else None
        except UnicodeDecodeError:
            return None
    return None


def armoured(text: str, deep: int = 0) -> list[tuple[int, int]]:
    """Spans of the armoured blocks whose body is a key. Blocks end at the next marker, which has to be their own end."""
    out, begun = [], None
    for mark in ARMOUR.finditer(text):
        if mark[1] == "BEGIN":
            begun = mark
        elif begun is not None:
            if begun[2] == mark[2] and begun[3] == mark[3] and _confirmed(text[begun.end() : mark.start()], begun[3] is not None, deep):
                out.append((begun.start(), mark.end()))
            begun = None
    return out


def _confirmed(body: str, pgp: bool, deep: int) -> bool:
    locked = "ENCRYPTED" in body and ":" in body
    lines = [x for x in BREAK.sub("\n", body).split("\n")] if not locked and not pgp else re.split(r"\r?\n|\\n", body)
    lines = [x.strip() for x in lines if ":" not in x and not x.startswith("=")]  # headers; a checksum line
    data = unbased("".join(lines))
    if not data:
        return False
    if pgp:
        return pgp_key(data) is not None
    return locked and len(data) >= 32 and len(data) % 8 == 0 or key_bytes(data, deep) == len(data)


def signed_token(text: str) -> int | None:
    """Characters of the token that a dotted run begins with."""
    parts = text.split(".")
    header = _object(unbased(parts[0]))
    if header is None:
        return None
    if isinstance(header.get("enc"), str) and isinstance(header.get("alg"), str) and len(parts) >= 5 and parts[2] and parts[3]:
        return len(".".join(parts[:5]))
    if not isinstance(header.get("alg"), str) or header["alg"].lower() == "none" or len(parts) < 3 or "enc" in header:
        return None
    body, signature = unbased(parts[1]), unbased(parts[2])
    known = bool(parts[1]) and body is not None and ("b64" in header or _object(body) is not None)
    return len(".".join(parts[:3])) if known and signature is not None and len(signature) >= 16 else None


#: What the base64 text of a key begins with: a DER sequence, the OpenSSH magic, a JSON object, an armour.
OPENINGS = ("M", "b3BlbnNzaC1r", "ey", "ew", "LS0t")


def _keys_in_run(run: str, lines: list[int]) -> Iterator[tuple[int, int]]:
    """(start, end) of the keys in a base64 run without its line breaks; a key begins where a line does. ``lines`` ends with the run's length."""
    at = 0
    for start in lines[:-1]:
        if start < at or not run.startswith(OPENINGS, start):
            continue
        room = len(run) - start
        if run[start] == "M":  # the outer length says how much to decode
            head = unbased(run[start : start + 12])
            outer = element(head, 0, 1 << 40) if head else None
            if outer is None or (outer[2] * 4 - 2) // 3 > room:
                continue
            room = min(room, outer[2] * 4 // 3 + 4)
        size = key_bytes(unbased(run[start : start + room]))
        if size is not None:
            at = start + -(-size * 4 // 3)
            while at < len(run) and run[at] == "=":  # padding belongs to the key
                at += 1
            yield start, at


def structured(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the confirmed keys and tokens of a text."""
    blocks = armoured(text)
    out = [("key", *span) for span in blocks]
    for found in TOKEN.finditer(text):
        size = signed_token(found[0])
        if size is not None:
            out.append(("jwt", found.start(), found.start() + size))
    for found in RUN.finditer(text):
        while blocks and blocks[0][1] <= found.start():
            blocks.pop(0)
        if blocks and blocks[0][0] <= found.start():
            continue
        parts = [m.span() for m in re.finditer(r"\S+", found[0])]
        lines = [0]
        for begin, end in parts:
            lines.append(lines[-1] + end - begin)
        place = lambda k: next(b + k - n for (b, e), n in zip(parts, lines) if k < n + e - b)
        out += [("key", found.start() + place(a), found.start() + place(b - 1) + 1) for a, b in _keys_in_run("".join(found[0].split()), lines)]
    for found in HEX.finditer(text):
        digits = found[0].replace(":", "")
        size = key_bytes(bytes.fromhex(digits[: len(digits) // 2 * 2]))
        if size is not None:
            out.append(("key", found.start(), found.start() + (3 * size - 1 if ":" in found[0] else 2 * size)))
    return out


def secrets_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed, then end."""
    out = set(structured(text))
    for kind, (pattern, group, least) in RULES.items():
        out.update((kind, m.start(), m.end()) for m in pattern.finditer(text) if len(m[group]) >= least)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _searched(column: pa.Array) -> list[list[dict]]:
    """The spans of every text of a column."""
    hit = pc.match_substring_regex(column, ANY).fill_null(False).to_pylist()
    return [[dict(zip(("kind", "start", "end"), s)) for s in secrets_of(column[k].as_py())] if h else [] for k, h in enumerate(hit)]


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_assign, n_access, n_hex and spans (kind, start, end; code points, end exclusive; by start, then kind as listed), one row per
    input row.

    Null and empty texts have no spans. Spans of one kind may overlap those of others, as a signed token behind ``token=`` does. A null key
    stays null, a repeated row is searched again, other columns are left out. Time is linear in a text's length; a run is decoded whole."""
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                rows = batch.slice(begin, 1000)
                spans = _searched(rows.column(1))
                counts = [pa.array([sum(s["kind"] == kind for s in found) for found in spans], pa.int64()) for kind in BASE]
                yield pa.RecordBatch.from_arrays([rows.column(0), *counts, pa.array(spans, pa.list_(SPAN))], names=["key", *(f"n_{k}" for k in BASE), "spans"])

    kind = own.schema["key"].dataType.simpleString()
    found = own.mapInArrow(run, f"key {kind}, {', '.join(f'n_{k} long' for k in BASE)}, spans array<struct<kind: string, start: long, end: long>>")
    return found.withColumnRenamed("key", key)


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, every stretch of ``text`` covered by spans replaced by ``<secret>``. Null stays null."""
    where = docs.columns.index(text)

    def masked(value: str, spans: list[dict]) -> str:
        out, at = [], 0
        for span in spans:
            if span["start"] >= at:
                out += [value[at : span["start"]], "<secret>"]
            at = max(at, span["end"])
        return "".join([*out, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            column = rows.column(where)
            new = [masked(column[k].as_py(), s) if s else column[k].as_py() for k, s in enumerate(_searched(column))]
            arrays = [pa.array(new, column.type) if k == where else rows.column(k) for k in range(rows.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=rows.schema.names)

    plain = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
