"""Secret scans: base patterns, and encoded keys and tokens confirmed by their structure.

The method looks at long runs of base64, base64url or hex characters and reports one only if it
decodes to something whose structure holds to the last byte:

* ``jwt``: three base64url parts; a JSON header with an ``alg``, a JSON object as payload and a
  signature (empty only for ``none``);
* ``pem``: armour whose labels match and whose body decodes to a key (DER or the OpenSSH format);
* ``der``: base64 or hex of a private key in DER. Every length of the nested elements must fit the
  bytes around it, and the outer sequence must be that of PKCS #1, PKCS #8 or SEC 1;
* ``ssh``: base64 of the OpenSSH private key format, its length-prefixed fields parsed in turn.

Base spans stay whatever the method finds. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltatlas.llm.tables import row_struct, with_row

# The base kinds in order, and their patterns.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
METHOD_KINDS = ("jwt", "pem", "der", "ssh")
KINDS = BASE_KINDS + METHOD_KINDS

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(ACCESS)
# Runs too short to pass are skipped at once: a maximal run of 24 is a match, a shorter one is not.
_HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")
# Any run that can hold an access key, a hex string or a candidate of the method.
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
# Starts at the beginning of a part only, so that a long run is not scanned from each character.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_PEM_EDGE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
# What cannot stand inside an armoured key; a backslash is part of an escaped line end.
_NOT_PEM = re.compile(r"[^A-Za-z0-9+/=\s:,>\\-]")
_QUOTE = re.compile(r"(?m)^[> \t]+")
_WRAPPED = re.compile(r"[> \t]*([A-Za-z0-9+/]{1,128}={0,2})[ \t\r]*")
_LEAST_WIDTH = 32  # of the first lines of a wrapped key
_OPENSSH = b"openssh-key-v1\0"
_MAX_DEPTH = 32


def decode_base64(run: str) -> bytes | None:
    """Bytes of a base64 or base64url string with or without padding; None if it is neither."""
    core = run.rstrip("=")
    if len(core) % 4 == 1 or (("+" in core or "/" in core) and ("-" in core or "_" in core)):
        return None
    try:
        return base64.b64decode(
            core.replace("-", "+").replace("_", "/") + "=" * (-len(core) % 4), validate=True)
    except binascii.Error:
        return None


def der_elements(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple] | None:
    """``(tag, content start, content end, children)`` that fill ``data[start:end]`` exactly.

    None if a length runs over its container, is not in its shortest form, or nesting is too deep.
    """
    if depth > _MAX_DEPTH:
        return None
    out = []
    at = start
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at:at + n])
            if size < 0x80 or size >> (8 * (n - 1)) == 0:
                return None
            at += n
        if at + size > end:
            return None
        children = None
        if tag & 0x20:
            children = der_elements(data, at, at + size, depth + 1)
            if children is None:
                return None
        out.append((tag, at, at + size, children))
        at += size
    return out


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are one DER sequence laid out as a private key."""
    top = der_elements(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = top[0][3]
    tags = [p[0] for p in parts]
    if len(tags) < 2 or tags[0] != 0x02:
        return False
    version = int.from_bytes(data[parts[0][1]:parts[0][2]], signed=True)
    if version == 0 and len(tags) == 9 and set(tags) == {0x02}:  # PKCS #1: version and 8 integers
        return True
    if version in (0, 1) and len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:  # PKCS #8
        algorithm = parts[1][3]
        return bool(algorithm) and algorithm[0][0] == 0x06
    # SEC 1: version 1, the private number, then tagged parameters and public key.
    return version == 1 and tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16 and all(
        t in (0xA0, 0xA1) for t in tags[2:])


def is_openssh_key(data: bytes) -> bool:
    """Whether the bytes follow the OpenSSH private key format, field by field."""
    if not data.startswith(_OPENSSH):
        return False
    at = len(_OPENSSH)

    def field():
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at:at + 4])
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size:at]

    for _ in range(3):  # cipher, derivation, its options
        if field() is None:
            return False
    if at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at:at + 4])
    at += 4
    if not 1 <= keys <= 64:
        return False
    return all(field() is not None for _ in range(keys + 1)) and at == len(data)


def _json_object(part: str) -> dict | None:
    data = decode_base64(part)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(run: str) -> bool:
    """Whether ``header.payload.signature`` is a signed token."""
    header, payload, signature = run.split(".")
    head = _json_object(header)
    if head is None or not isinstance(head.get("alg"), str) or _json_object(payload) is None:
        return False
    if head["alg"].lower() == "none":
        return True
    return len(signature) >= 16 and decode_base64(signature) is not None


def _armoured(text: str) -> list[tuple[int, int, str]]:
    """Confirmed PEM keys: each END with the last BEGIN of its label before it, in one pass.

    Line ends may be written as backslash and n, and lines quoted with ``>``.
    """
    spans, begun, bad = [], {}, -1
    for m in _PEM_EDGE.finditer(text):
        if m.group(1) == "BEGIN":
            begun[m.group(2)] = m
            continue
        begin = begun.pop(m.group(2), None)
        if begin is None or (spans and begin.start() < spans[-1][1]):
            continue
        if bad < begin.end():  # else the last one found still is the first from here on
            other = _NOT_PEM.search(text, begin.end())
            bad = other.start() if other else len(text)
        if bad < m.start():
            continue
        body = text[begin.end():m.start()].replace("\\r", "").replace("\\n", "\n").replace("\r\n", "\n")
        body = _QUOTE.sub("", body)
        if "\\" in body or ">" in body:
            continue
        # Headers of an encrypted key end with an empty line.
        core = body.split("\n\n")[-1] if ":" in body else body
        data = decode_base64("".join(core.split()))
        if data and (is_private_key(data) or is_openssh_key(data) or ":" in body):
            spans.append((begin.start(), m.end(), "pem"))
    return spans


def _key_kind(run: str) -> str | None:
    """``der`` or ``ssh`` if the base64 or hex run is a whole private key."""
    tries = [decode_base64(run)]
    if len(run) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", run):
        tries.append(bytes.fromhex(run))
    for data in tries:
        if data and data[0] == 0x30 and is_private_key(data):
            return "der"
        if data and is_openssh_key(data):
            return "ssh"
    return None


def _wrapped(text: str) -> list[tuple[int, int, str]]:
    """Keys over lines of one width, the last of which may be shorter; after a line of armour the
    rule for armoured keys decides."""
    spans, block, at, before = [], [], 0, ""

    def close() -> None:
        # A shorter line at the end may be the next word of the text.
        for n in (len(block), len(block) - 1):
            if n > 1 and (kind := _key_kind("".join(x for _, _, x in block[:n]))):
                spans.append((block[0][0], block[n - 1][1], kind))
                break
        block.clear()

    for line in text.split("\n"):
        m = _WRAPPED.fullmatch(line) if len(line) <= 200 else None
        width = len(m.group(1)) if m else 0
        if block and (not m or width > len(block[-1][2])):
            close()
        if m and (block or (width >= _LEAST_WIDTH and "-----BEGIN " not in before)):
            block.append((at + m.start(1), at + m.end(1), m.group(1)))
            if width < len(block[0][2]):
                close()  # a shorter line is the last
            before = ""
        elif not block:
            before = line
        at += len(line) + 1
    close()
    return spans


def _confirmed(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    spans = _armoured(text) if "-----BEGIN " in text else []
    if len(runs) > 1 and "\n" in text:
        spans += [w for w in _wrapped(text) if not any(a <= w[0] and w[1] <= b for a, b, _ in spans)]
    covered, k = sorted((a, b) for a, b, _ in spans), 0
    for lo, hi in runs:
        while k < len(covered) and covered[k][1] <= lo:
            k += 1
        if k < len(covered) and covered[k][0] <= lo and hi <= covered[k][1]:
            continue
        for m in _JWT.finditer(text, lo, hi):
            if is_signed_token(m.group()):
                spans.append((m.start(), m.end(), "jwt"))
        for m in _ENCODED.finditer(text, lo, hi):
            if kind := _key_kind(m.group()):
                spans.append((m.start(), m.end(), kind))
    return spans


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)``, by start and then kind in the order of ``KINDS``."""
    spans = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text)
                  if len(m.group(2)) >= MIN_ASSIGN]
    runs = [m.span() for m in _RUN.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)
                  if m.end() - m.start() >= MIN_ACCESS]
    for lo, hi in runs:
        if hi - lo >= MIN_HEX:
            spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text, lo, hi)]
    if runs or "-----BEGIN " in text:
        spans += _confirmed(text, runs)
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: Sequence[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of carried columns), counts, hash and spans.

    ``n_assign, n_access, n_hex`` count base spans, ``n_confirmed`` those of the method;
    ``base_sha256`` is the hash of the joined base spans, ``spans`` an array of ``kind, start, end``
    with all spans in order. NULL and empty texts have none (the hash is that of the empty
    string). Each text is scanned whole and once, a long one as well as a short one; spans of
    different kinds may overlap. Rows are independent: no shuffle, and repeats agree.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1_000):
                batch = whole.slice(i, 1_000)
                found = [secret_spans(t) if t else [] for t in batch.column("text").to_pylist()]
                base = [[s for s in spans if s[2] in BASE_KINDS] for spans in found]
                counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in BASE_KINDS]
                more = pa.array([len(a) - len(b) for a, b in zip(found, base, strict=True)], pa.int64())
                hashes = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
                lists = pa.array(
                    [[{"kind": k, "start": a, "end": b} for a, b, k in spans] for spans in found],
                    pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), *counts, more, hashes, lists],
                    names=["row", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"])

    return docs.select(row_struct(docs, carry), docs[text_col].alias("text")).mapInArrow(
        run, with_row(
            docs, carry, **{f"n_{k}": T.LongType() for k in (*BASE_KINDS, "confirmed")},
            base_sha256=T.StringType(), spans=T.ArrayType(T.StructType([
                T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                T.StructField("end", T.LongType())]))))
