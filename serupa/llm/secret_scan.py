"""Secret scan with structural confirmation.

Base kinds are patterns. Beyond them, runs of base64, base64url or hex characters are candidates: each is
decoded, and reported only if what it decodes to has the structure of a secret:

* ``key``: a DER private key (PKCS#1, PKCS#8, encrypted PKCS#8, SEC 1) whose nested lengths fill the bytes exactly,
  or an OpenSSH private key blob whose length-prefixed fields do; as bare text or inside PEM armour. The armour
  may be quoted, indented, in string literals, or have its line ends escaped; of an encrypted one with headers the
  body must be whole cipher blocks of its initial vector's size,
* ``jwt``: three dot-joined parts, the first a JSON header with "alg", the second a JSON object,
* ``wrapped``: printable UTF-8 text, tabs and line ends included, that itself holds an ``assign`` or ``access`` span
  or a confirmed one; texts are decoded up to ``DEPTH`` levels deep.

Runs that are broken over lines of ``LINE`` or more characters are candidates as a whole, with and without the
last line, and line by line. Spans are in code points of the text, end exclusive; of a PEM block, the whole block.

Defined results: null and empty texts have no spans. A text of any length is scanned whole, in time linear in
its length but for failed candidates. Repeated rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serupa.llm.batches import map_text
from serupa.llm.spans import FIELD, count, digest, ordered, to_arrow

KINDS = ("assign", "access", "hex", "key", "jwt", "wrapped")
DEPTH = 3
LINE = 40

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")  # maximal runs, so the same as runs of any length that are 24 or longer

_MARKS = ("passw", "secret", "token", "api")  # every assignment holds one of them, in either case
_LONG = 19  # every other base span, run and token has as many characters of _RUNS in a row
_RUNS = bytes(c if chr(c).isalnum() and c < 0x80 or chr(c) in "+/_=.-" else 32 for c in range(256))
_PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*)PRIVATE KEY-----")
_PEM_BREAK = re.compile(r"(?:\\+[rn]|[\r\n])+")
_PEM_LEFT, _PEM_RIGHT = " \t>|#*\"'\\", " \t\"'\\.,;"  # around a line that is quoted, a comment or a string literal
_PEM_HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*):\s*(.*)")
_PEM_CIPHER = re.compile(r"[A-Z0-9-]+,([0-9A-Fa-f]+)")
_BASE64 = re.compile(r"[A-Za-z0-9+/]+={0,2}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]+)(?![A-Za-z0-9_-]|\.[A-Za-z0-9_-])")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_BREAK = r"(?:\\+r)?(?:\\+n|\r?\n|\r)[\x20\t>]*+"
_BLOCK = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{{LINE},}}+{_BREAK})+[A-Za-z0-9+/_-]++={{0,2}}(?![A-Za-z0-9+/_=-])")
_BLOCK_BREAK = re.compile(_BREAK)
_HEX_ONLY = re.compile("(?:[0-9a-f]+|[0-9A-F]+)")
_LINE_CHARS = dict.fromkeys(map(ord, "\t\r\n"))
_OPENSSH = b"openssh-key-v1\0"
# Object identifiers of password-based encryption, PKCS#5 and PKCS#12.
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def decoded(run: str) -> list[bytes]:
    """What a run of characters may stand for: hex, base64 or base64url, padding optional."""
    out = []
    if len(run) % 2 == 0 and _HEX_ONLY.fullmatch(run):
        out.append(bytes.fromhex(run))
    body = run.rstrip("=")
    if len(body) % 4 != 1 and not ("+" in body or "/" in body) & ("-" in body or "_" in body):
        try:
            out.append(base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True))
        except binascii.Error:
            pass
    return out


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end of the content) of the DER element at ``at``, if it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n]), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _sequence(data: bytes) -> list[tuple[int, bytes]] | None:
    """Elements of a SEQUENCE that fills ``data`` exactly."""
    whole = _element(data, 0, len(data))
    if not whole or whole[0] != 0x30 or whole[2] != len(data):
        return None
    out, at = [], whole[1]
    while at < whole[2]:
        found = _element(data, at, whole[2])
        if not found:
            return None
        out.append((found[0], data[found[1] : found[2]]))
        at = found[2]
    return out


def is_private_key(data: bytes) -> bool:
    if data.startswith(_OPENSSH):
        return _openssh(data[len(_OPENSSH) :])
    parts = _sequence(data)
    if not parts or len(parts) < 2:
        return False
    if [t for t, _ in parts] == [0x30, 0x04]:  # encrypted PKCS#8: algorithm with parameters and cipher text
        return _password_based(parts[0][1]) and len(parts[1][1]) >= 16
    if parts[0][0] != 0x02 or len(parts[0][1]) != 1:
        return False
    tags, version = [t for t, _ in parts], parts[0][1][0]
    if version in (0, 1) and len(parts) >= 9 and tags[:9] == [0x02] * 9:  # PKCS#1: nine integers
        return len(parts[1][1]) >= 32
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:  # PKCS#8: algorithm and wrapped key
        first = _element(parts[1][1], 0, len(parts[1][1]))
        return bool(first) and first[0] == 0x06 and len(parts[2][1]) >= 16
    return version == 1 and tags[1] == 0x04 and 16 <= len(parts[1][1]) <= 80  # SEC 1


def _password_based(algorithm: bytes) -> bool:
    """A digest has the same outer form as an encrypted key, so the algorithm decides."""
    name = _element(algorithm, 0, len(algorithm))
    if not name or name[0] != 0x06 or not algorithm[name[1] : name[2]].startswith(_PASSWORD_BASED):
        return False
    parameters = _element(algorithm, name[2], len(algorithm))
    return bool(parameters) and parameters[0] == 0x30 and parameters[2] == len(algorithm)


def _openssh(data: bytes) -> bool:
    """Cipher, derivation, its options, number of keys, public key, private keys: each with its length."""
    at = 0
    for field in range(6):
        if at + 4 > len(data):
            return False
        value = int.from_bytes(data[at : at + 4])
        at += 4
        if field == 3:
            if not 1 <= value <= 16:
                return False
        elif at + value > len(data):
            return False
        else:
            at += value
    return at == len(data)


def _json(part: str):
    for data in decoded(part):
        try:
            found = json.loads(data)
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict):
            return found
    return None


def _armoured_key(body: str) -> bool:
    """Whether the lines between the marks of a PEM block hold a private key."""
    headers, run = {}, []
    for line in _PEM_BREAK.split(body):
        line = line.strip()
        if line.endswith("+") and line[:-1].rstrip().endswith(('"', "'")):  # literals that are added up
            line = line[:-1]
        line = line.lstrip(_PEM_LEFT).rstrip(_PEM_RIGHT)
        header = _PEM_HEADER.fullmatch(line)
        if header and not run:
            headers[header[1]] = header[2]
        elif line:
            run.append("".join(line.split()))
    joined = "".join(run)
    if not _BASE64.fullmatch(joined):
        return False
    if "ENCRYPTED" not in headers.get("Proc-Type", ""):
        return any(map(is_private_key, decoded(joined)))
    cipher = _PEM_CIPHER.fullmatch(headers.get("DEK-Info", ""))
    block = len(cipher[1]) // 2 if cipher else 0
    return block in (8, 16) and any(len(d) >= 48 and len(d) % block == 0 for d in decoded(joined))


def _printed(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text.translate(_LINE_CHARS).isprintable() else None


def _confirm(run: str, depth: int) -> str | None:
    """The kind of secret that a run of characters decodes to."""
    for data in decoded(run):
        if is_private_key(data):
            return "key"
        text = _printed(data)
        if text and (any(k != "hex" for k, *_ in base_spans(text)) or confirmed_spans(text, depth + 1)):
            return "wrapped"
    return None


def _has_long_run(text: str) -> bool:
    return max(map(len, text.encode().translate(_RUNS).split()), default=0) >= _LONG


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out, low = [], text.lower()
    if any(mark in low for mark in _MARKS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if _has_long_run(text):
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(out, KINDS)


def confirmed_spans(text: str, depth: int = 1) -> list[tuple[str, int, int]]:
    out = []
    if "-----BEGIN" in text:
        marks = list(_PEM_MARK.finditer(text))
        for begin, end in zip(marks, marks[1:]):
            if (begin[1], end[1]) == ("BEGIN", "END") and begin[2] == end[2] and _armoured_key(text[begin.end() : end.start()]):
                out.append(("key", begin.start(), end.end()))
    if not _has_long_run(text):
        return out
    for m in _TOKEN.finditer(text):
        if "alg" in (_json(m[1]) or ()) and _json(m[2]) is not None:
            out.append(("jwt", *m.span()))
    if depth > DEPTH:
        return out
    free = _outside(out)
    for m in _BLOCK.finditer(text):
        lines = [(0, 0), *(b.span() for b in _BLOCK_BREAK.finditer(m[0]))]
        for end in (len(m[0]), lines[-1][0]):
            kind = _confirm(_BLOCK_BREAK.sub("", m[0][:end]), depth) if free(m.start(), m.start() + end) else None
            if kind:
                out.append((kind, m.start(), m.start() + end))
                break
    free = _outside(out)
    for m in _RUN.finditer(text):
        kind = _confirm(m[0], depth) if free(*m.span()) else None
        if kind:
            out.append((kind, *m.span()))
    return out


def _outside(spans: list[tuple[str, int, int]]):
    """Whether a stretch lies in none of the spans, which do not overlap."""
    found = sorted((a, b) for _, a, b in spans)
    starts = [a for a, _ in found]

    def free(start: int, end: int) -> bool:
        at = bisect_right(starts, start) - 1
        return at < 0 or found[at][1] < end

    return free


def _scan():
    def fn(texts):
        base, every = [], []
        for raw in texts:
            text = raw.decode() if raw else ""
            base.append(base_spans(text))
            every.append(ordered(base[-1] + confirmed_spans(text), KINDS))
        return [to_arrow(base), to_arrow(every)]

    return fn


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with base_spans and spans, by start, then kind."""
    return map_text(docs, f"base_{FIELD}, {FIELD}", _scan, keep, text)


def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"])
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(digest("base_spans"), 256).alias("base_sha256"), digest("spans").alias("spans"),
        (F.size("spans") - F.size("base_spans")).cast("long").alias("n_confirmed"),
    )
