"""Secret scans with structural confirmation.

Base kinds are plain patterns. What the method adds must prove itself by its structure: runs of
base64 or hexadecimal digits are decoded and the bytes are parsed as key encodings whose nested
lengths must add up exactly (DER sequences of private keys, encrypted ones too, and public keys, the OpenSSH private key
container, SSH public key blobs), and three dot-joined base64url parts must start with a JSON
header that names a signing algorithm. Runs that do not parse are not reported.

Each text is scanned where it lies: an Arrow batch at a time, no shuffle, memory bounded by the
batch. Searches for a kind are skipped if a literal that every match holds does not occur.

Defined results: null and empty texts have no spans. Rows are judged one by one, so repeated
rows agree; other columns are ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from granary.llm.common import in_parts, text_of

#: The base patterns.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}
#: Every assignment holds one of these, in lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Candidates of the method: long runs of one alphabet, and signed tokens.
#: Lines may be wrapped, also by escaped line ends as in JSON and source code.
LINE_END = r"[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*"
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}(?:" + LINE_END + r"[A-Za-z0-9+/_-]+={0,2})*+")
PIECE = re.compile(r"\\+[rn]|[A-Za-z0-9+/_-]+={0,2}")
ARMOURED = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY|PUBLIC KEY)-----((?:[A-Za-z0-9+/=\s]|\\++[nrt/]|[\"'](?:[ \t]*+[+.,])?+\s*+[\"'])++)-----END \1-----")
#: What is no part of the base64 text in an armour: blanks, escaped ones, joints of string literals.
BETWEEN = re.compile(r"[\"'](?:[ \t]*+[+.,])?+\s*+[\"']|\\+[nrt]|\\+(?=/)|\s+")
#: Where a key can begin: 0x30 with a length, the container's name, a length below 256 and a name.
STARTS = re.compile(r"M[A-P]|b3BlbnNzaC1rZXkt|AAAA[A-D]")
HEX_STARTS = re.compile(r"30|6f70656e7373682d|000000(?=[0-9a-f]{2}(?:737368|6563647361|736b))", re.IGNORECASE)
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
HEX_KEY = re.compile(r"(?i:[0-9a-f]{64,})")
KINDS = ("assign", "access", "hex", "jwt", "pem", "ssh", "der")
ORDER = {k: i for i, k in enumerate(KINDS)}

Span = tuple[int, int, str]


def unbase64(text: str) -> bytes | None:
    """Bytes of a base64 or base64url run, padded or not; None if it is neither."""
    body = text.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of consecutive DER items that fill ``data`` exactly, else None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at:at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        items.append((tag, data[at:at + size]))
        at += size
    return items


#: Object identifiers 1.2.840.113549.1.5 and 1.2.840.113549.1.12.1.
PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def der_size(data: bytes) -> int | None:
    """Bytes of the DER sequence that begins with ``data`` (six bytes or more), else None."""
    if data[:1] != b"\x30":
        return None
    if not data[1] & 0x80:
        return 2 + data[1]
    n = data[1] & 0x7F
    return 2 + n + int.from_bytes(data[2:2 + n], "big") if 1 <= n <= 4 else None


def is_der_key(data: bytes) -> bool:
    """A DER sequence shaped like a private key (PKCS#1, PKCS#8 plain or encrypted, SEC1) or a public key info."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = der_items(outer[0][1])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _ in parts]
    if tags[0] == 0x02 and len(parts[0][1]) == 1:
        if len(tags) >= 9 and set(tags[:9]) == {0x02}:
            return True
        if tags[1] == 0x04 and len(parts[1][1]) >= 16:
            return True
        if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04:
            return is_algorithm(parts[1][1])
    if tags == [0x30, 0x04]:  # encrypted PKCS#8: a password scheme of PKCS#5 or PKCS#12
        return is_algorithm(parts[0][1]) and der_items(parts[0][1])[0][1].startswith(PASSWORD_SCHEMES) and len(parts[1][1]) >= 16
    return tags == [0x30, 0x03] and is_algorithm(parts[0][1]) and parts[1][1][:1] == b"\0" and len(parts[1][1]) > 16


def is_algorithm(data: bytes) -> bool:
    items = der_items(data)
    return bool(items) and items[0][0] == 0x06 and len(items[0][1]) >= 3


def ssh_fields(data: bytes) -> list[bytes] | None:
    """Length-prefixed fields that fill ``data`` exactly, else None."""
    fields, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at:at + 4], "big")
        at += 4
        if at + size > len(data):
            return None
        fields.append(data[at:at + size])
        at += size
    return fields


def is_ssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        at, left = len(magic), 3
        while left:  # cipher, key derivation and its options
            size = int.from_bytes(data[at:at + 4], "big")
            at, left = at + 4 + size, left - 1
            if at + 4 > len(data):
                return False
        count, rest = int.from_bytes(data[at:at + 4], "big"), ssh_fields(data[at + 4:])
        return rest is not None and count >= 1 and len(rest) == count + 1
    fields = ssh_fields(data)
    return bool(fields) and len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]+", fields[0]) is not None


def is_token_header(text: str) -> bool:
    data = unbase64(text)
    try:
        header = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def key_kind(data: bytes | None) -> str | None:
    if not data or len(data) < 24:
        return None
    if data[0] == 0x30:
        return "der" if is_der_key(data) else None
    return "ssh" if is_ssh_key(data) else None


def confirmed(text: str) -> Iterator[Span]:
    """Spans of the method's own kinds."""
    if "eyJ" in text:
        for m in JWT.finditer(text):
            if is_token_header(m[1]) and unbase64(m[2]) is not None and unbase64(m[3]) is not None:
                yield m.start(), m.end(), "jwt"
    if "-----BEGIN " in text:
        for m in ARMOURED.finditer(text):
            if key_kind(unbase64(BETWEEN.sub("", m[2]))):
                yield m.start(), m.end(), "pem"
    for m in ENCODED.finditer(text):
        yield from encoded_keys(m[0], m.start())
    for m in HEX_KEY.finditer(text):
        yield from hex_keys(m[0], m.start())


def encoded_keys(run: str, offset: int) -> Iterator[Span]:
    """Keys in lines of base64: each begins anywhere and ends with a line."""
    if not STARTS.search(run):
        return
    pieces = [(p.start(), p.end()) for p in PIECE.finditer(run) if p[0][0] != "\\"]
    body = "".join(run[a:b] for a, b in pieces)
    ends, places, size = [], [], 0
    for a, b in pieces:
        places.append((size, a))
        size += b - a
        ends.append((size, b))
    done, read = 0, Peek(body)
    for m in STARTS.finditer(body):
        at = m.start()
        if at < done:
            continue
        for size in key_sizes(read, at):
            # The key ends with a line, after up to two characters of padding.
            least = at + -(-4 * size // 3)
            end, place = next(iter(ends[bisect.bisect_left(ends, (least,)):][:1]), (None, None))
            if end is None or end > least + 2 or not key_kind(unbase64(body[at:end])):
                continue
            base, first = places[bisect.bisect_right(places, (at, len(run))) - 1]
            yield offset + first + at - base, offset + place, key_kind(unbase64(body[at:end]))
            done = end
            break


class Peek:
    """Single bytes out of a base64 body, without decoding the rest."""

    def __init__(self, body: str):
        self.body = body

    def __call__(self, start: int, at: int, n: int) -> bytes | None:
        """``n`` bytes from byte ``at`` of what is encoded from character ``start`` on; None beyond the body."""
        first = start + at // 3 * 4
        quads = self.body[first:first + (at % 3 + n + 2) // 3 * 4]
        data = unbase64(quads[:len(quads) - (len(quads) % 4 == 1)]) or b""
        data = data[at % 3:at % 3 + n]
        return data if len(data) == n else None

    def number(self, start: int, at: int) -> int | None:
        data = self(start, at, 4)
        return None if data is None else int.from_bytes(data, "big")


#: Fields of a public or private SSH blob, and keys in one container, at most; real ones have under ten, and one.
SSH_FIELDS = 16


def key_sizes(read: Peek, start: int) -> Iterator[int]:
    """Bytes that a key beginning at ``start`` may have, by the lengths it states itself, ascending."""
    head = read(start, 0, 6)
    if head is None:
        return
    total = der_size(head)
    if total is not None:
        yield total
        return
    container = head == b"openss"
    if not container and not (head[:3] == b"\0\0\0" and head[4:] in (b"ss", b"ec", b"sk")):
        return
    at, left = 15 if container else 0, 3 if container else SSH_FIELDS
    for field in range(left):
        size = read.number(start, at)
        if size is None or size > len(read.body):
            return
        at += 4 + size
        if not container and field:
            yield at
    if not container:
        return
    count = read.number(start, at)
    if count is None or not 1 <= count <= SSH_FIELDS:
        return
    at += 4
    for _ in range(count + 1):
        size = read.number(start, at)
        if size is None or size > len(read.body):
            return
        at += 4 + size
    yield at


def hex_keys(run: str, offset: int) -> Iterator[Span]:
    """Keys in a run of hexadecimal digits: each begins anywhere and ends with the run."""
    for m in HEX_STARTS.finditer(run):
        left = len(run) - m.start()
        if left % 2 or left < 64:
            continue
        if m[0] == "30" and 2 * (der_size(binascii.unhexlify(run[m.start():m.start() + 12])) or 0) != left:
            continue
        kind = key_kind(binascii.unhexlify(run[m.start():]))
        if kind:
            yield offset + m.start(), offset + len(run), kind
            return


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each base kind that are long enough."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start, then kind."""
    key = lambda s: (s[0], ORDER[s[2]], s[1])
    base = sorted(base_spans(text), key=key)
    return base, sorted({*base, *confirmed(text)}, key=key)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))


def with_spans(docs: DataFrame, keep: list[str], base_only: bool = False) -> DataFrame:
    """The kept columns and ``__spans`` of each row's text: start, end and kind."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("__spans", SPANS)])
    source = docs.select(*keep, text_of().alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t)[0 if base_only else 1]] for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(spans, kind)], names=[*keep, "__spans"])

    return source.mapInArrow(run, schema)


REPORT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    source = docs.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in batch.column(1).to_pylist():
                base, every = scan(text)
                for kind in KINDS[:3]:
                    rows["n_" + kind].append(sum(s[2] == kind for s in base))
                rows["base_sha256"].append(hashlib.sha256(shown(base).encode()).hexdigest())
                rows["spans"].append(shown(every))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, (rows[k] for k in list(rows)[:3])),
                                              pa.array(rows["base_sha256"], pa.string()), pa.array(rows["spans"], pa.string())], names=["doc_id", *rows])

    return source.mapInArrow(run, REPORT)


def redacted(docs: DataFrame) -> DataFrame:
    """Every row, its columns unchanged but for the text, in which each secret becomes ``[kind]``.

    Overlapping spans become one mark, named after the first of them; a null text stays null.
    """
    names, at = docs.columns, docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        _, spans = scan(text)
        while spans:
            start, end, kind = spans.pop(0)
            while spans and spans[0][0] < end:
                end = max(end, spans.pop(0)[1])
            out += [text[done:start], f"[{kind}]"]
            done = end
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
