import base64
import hashlib
import json
import random
import re

from tests.llm.fixtures import awkward, awkward_rows, empty
from voltatlas.llm import secret_scan as ss

RNG = random.Random(6)


def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8))
    return bytes([tag]) + size + content


def integer(bits):
    return der(2, b"\x01" + RNG.randbytes(bits // 8))


PKCS1 = der(0x30, der(2, b"\0") + b"".join(integer(n) for n in (512, 24, 512, 256, 256, 256, 256, 256)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(5, b"")) + der(4, PKCS1))
SEC1 = der(0x30, der(2, b"\x01") + der(4, RNG.randbytes(32)) + der(0xA0, der(6, b"\x2a\x86\x48")))
PUBLIC = der(0x30, der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(3, b"\0" + RNG.randbytes(64)))
OPENSSH = b"openssh-key-v1\0" + b"".join(
    len(f).to_bytes(4) + f for f in (b"none", b"none", b"")) + (1).to_bytes(4) + b"".join(
    len(f).to_bytes(4) + f for f in (RNG.randbytes(51), RNG.randbytes(136)))


def b64(x, url=False):
    return (base64.urlsafe_b64encode(x).rstrip(b"=") if url else base64.b64encode(x)).decode()


def jwt(header, payload, signature=b"s" * 32):
    return ".".join([b64(json.dumps(header).encode(), True), b64(json.dumps(payload).encode(), True), b64(signature, True)])


def kinds(text):
    return [k for _, _, k in ss.secret_spans(text) if k in ss.METHOD_KINDS]


def test_structures_are_confirmed():
    good = jwt({"alg": "HS256", "typ": "JWT"}, {"sub": "1"})
    assert kinds(f"see {good} here") == ["jwt"]
    assert kinds(jwt({"typ": "JWT"}, {"sub": "1"})) == []  # no algorithm
    assert kinds(jwt({"alg": "HS256"}, {"sub": "1"}, b"s")) == []  # no room for a signature
    assert kinds(b64(json.dumps({"alg": 1}).encode()) + ".abcd.efgh") == []
    for key in (PKCS1, PKCS8, SEC1):
        assert kinds("key " + b64(key) + ", end") == ["der"]
        assert kinds("key " + key.hex()) == ["der"]
        assert kinds(b64(key[:-1])) == [] and kinds(b64(key + b"\0")) == []
    assert kinds(b64(PUBLIC)) == []  # a public key is no secret
    assert kinds(b64(OPENSSH)) == ["ssh"] and kinds(b64(OPENSSH[:-3])) == []
    body = "\n".join(re.findall(".{1,64}", b64(PKCS8)))
    pem = f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----"
    assert kinds(f"x\n{pem}\ny") == ["pem"]
    assert ss.secret_spans(f"é\n{pem}")[0][:2] == (2, 2 + len(pem))
    assert kinds(pem.replace("END PRIVATE", "END RSA PRIVATE")) == []
    assert kinds(pem.replace(body, b64(RNG.randbytes(300)))) == []
    assert kinds(" ".join(b64(RNG.randbytes(60)) for _ in range(200))) == []


def test_nested_lengths():
    assert ss.der_elements(PKCS8, 0, len(PKCS8)) is not None
    assert ss.der_elements(b"\x30\x82\x00\x05" + b"\x02\x01\x00\x05\x00", 0, 9) is None  # not the shortest length
    deep = b"\x05\x00"
    for _ in range(50):
        deep = der(0x30, deep)
    assert ss.der_elements(deep, 0, len(deep)) is None


def base_brute(text):
    out = []
    for k, p, ok in (
            ("assign", re.compile(ss.ASSIGN, re.I | re.A), lambda m: len(m.group(2)) >= 6),
            ("access", re.compile(ss.ACCESS), lambda m: len(m.group()) >= 20),
            ("hex", re.compile(ss.HEX), lambda m: len(m.group()) >= 24)):
        out += [(m.start(), ss.KINDS.index(k), m.end(), k) for m in p.finditer(text) if ok(m)]
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(9)
    parts = ["PassWord", "passwd", "SECRET", "token", "api_key", "ApiKey", "=", ": ", '"', "'", "abc", "AKIA", "A1B2C3D4E5F6G7H8",
             "deadbeef", "0123456789abcdef01234567", "é", " ", "\n", "x" * 30, "pa\u017fsword=abcdefgh", ".", "/", "AKIA" * 6]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        assert [s for s in ss.secret_spans(text) if s[2] in ss.BASE_KINDS] == base_brute(text), text


def test_awkward_rows(spark):
    got = ss.scan_secrets(awkward(spark)).collect()
    assert len(got) == len(awkward_rows())
    nothing = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in got if not r.spans} == {nothing}
    assert ss.scan_secrets(empty(spark)).count() == 0
    text = f'token = "abcdef0123456789abcdef01" é {b64(PKCS8)}'
    row = ss.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_assign, row.n_access, row.n_hex, row.n_confirmed) == (1, 0, 1, 1)
    assert row.base_sha256 == hashlib.sha256(ss.joined(base_brute(text)).encode()).hexdigest()
    assert [s.kind for s in row.spans] == ["assign", "hex", "der"]


def wrapped(key, width=64, quote="", end="\n"):
    return end.join(quote + x for x in re.findall(f".{{1,{width}}}", key))


def test_escaped_quoted_and_wrapped_keys():
    for key in (PKCS1, PKCS8, SEC1):
        for end, quote in (("\\n", ""), ("\\r\\n", ""), ("\n", "> "), ("\r\n", ""), ("\n", "  ")):
            begin, close = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
            pem = f"{begin}{end}{wrapped(b64(key), 64, quote, end)}{end}{quote}{close}"
            text = f'{{"private_key": "{pem}\\n", "x": 1}}'
            spans = [s for s in ss.secret_spans(text) if s[2] == "pem"]
            assert [text[a:b] for a, b, _ in spans] == [pem], (end, quote)
        for width in (64, 76):
            for quote in ("", "> "):
                body = wrapped(b64(key), width, quote)
                text = f"é key:\n{body}\nafter it"
                assert [text[a:b] for a, b, k in ss.secret_spans(text) if k == "der"] == [body[len(quote):]]
        assert kinds("\n".join(re.findall(".{1,64}", key.hex()))) == ["der"]
        assert kinds(wrapped(b64(key)) + "\nafter") == ["der"]
    assert kinds(wrapped(b64(OPENSSH), 70)) == ["ssh"]
    assert kinds(wrapped(b64(PKCS8)[:-8])) == [] and kinds(wrapped(b64(PUBLIC))) == []
    assert kinds("\n".join([b64(PKCS8)[:64], "other words", b64(PKCS8)[64:]])) == []
    # A key after a BEGIN line that leads nowhere.
    pem = f"-----BEGIN PRIVATE KEY-----\n{wrapped(b64(PKCS8))}\n-----END PRIVATE KEY-----"
    assert kinds(f"-----BEGIN PRIVATE KEY-----\n{pem}") == ["pem"]


def test_long_hostile_texts_take_linear_time():
    import time

    line, key = "-----BEGIN PRIVATE KEY-----\n", wrapped(b64(PKCS8))
    size = 10_000_000
    for text in (line * (size // len(line)), "a" * size, "A1_-" * (size // 4), "eyJhbGciOiJ9." * (size // 13),
                 (line + key[:40] + "!\n") * (size // 70), ("password" + " " * 50) * (size // 58),
                 ("f" * 64 + "\n") * (size // 65)):
        began = time.perf_counter()
        ss.secret_spans(text)
        assert time.perf_counter() - began < 30
