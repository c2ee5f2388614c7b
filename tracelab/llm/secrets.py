"""Secret scans: keyword automaton, anchored expressions near hits, checksums.

One Aho-Corasick pass over a text finds the keywords; expressions are tried
only at a hit (``match`` at its offset), and token formats that carry a
checksum are kept only if it holds.  Runs of hexadecimal digits have no
keyword: a scan for runs of 16 finds them.  Texts are scanned as bytes; span
offsets are code points.

Defined cases: a null or empty text has no spans (and stays null under
``redact``); repeated rows are scanned each; an empty table gives an empty
result; other columns pass through ``redact``, which also sets ``n_chars`` if
there is such a column.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import text_bytes

# The base kinds' patterns and least lengths, keywords that start
# them, and the public formats of the added kinds.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "pem")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "pem": ("-----begin",),
}
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
PLACEHOLDER = "[secret]"


def base62_crc32(body: str) -> str:
    """CRC-32 of the token's body as six base-62 digits."""
    n, digits = zlib.crc32(body.encode("latin-1")), []
    for _ in range(6):
        n, d = divmod(n, 62)
        digits.append(BASE62[d])
    return "".join(reversed(digits))


def _checked(m: re.Match) -> bool:
    return base62_crc32(m[1]) == m[2]


#: kind -> expression tried at a hit, and whether a match counts.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= ASSIGN_VALUE),
    "access": (ACCESS, lambda m: m.end() - m.start() >= ACCESS_LENGTH),
    "github": (GITHUB, _checked),
    "npm": (NPM, _checked),
    "pem": (PEM, lambda m: True),
}


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def find_spans(data: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then by order of kinds."""
    hits: dict[str, list[int]] = {}
    for end, (kind, length) in _automaton().iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(end - length + 1)
    text = data.decode("latin-1")  # one character a byte: offsets stay
    spans = [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    for kind, starts in hits.items():
        (expression, counts), free = RULES[kind], 0
        for at in sorted(starts):
            if at >= free and (m := expression.match(text, at)):
                free = m.end()
                if counts(m):
                    spans.append((at, kind, free))
    if not spans:
        return []
    points: dict[int, int] = {}
    last = seen = 0
    for at in sorted({x for s, _, e in spans for x in (s, e)}):
        seen += len(data[last:at].decode("utf-8", "replace"))
        last = at
        points[at] = seen
    return sorted(((points[s], kind, points[e]) for s, kind, e in spans), key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, kind, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find_spans(x.as_buffer().to_pybytes()) for x in b.column(1)]
            base = [[x for x in spans if x[1] in BASE_KINDS] for spans in found]
            counts = [pa.array([sum(x[1] == k for x in spans) for spans in base], pa.int64()) for k in BASE_KINDS]
            digest = pa.array([hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base], pa.string())
            added = pa.array([len(a) - len(k) for a, k in zip(found, base, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, digest, pa.array([_joined(s) for s in found], pa.string()), added],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"],
            )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"))
    return kept.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redacted(text: str, placeholder: str = PLACEHOLDER) -> str:
    """The text with every secret (overlapping spans together) replaced."""
    out, upto, done = [], 0, 0
    for s, _, e in find_spans(text.encode("utf-8", "replace")):
        if s >= done:
            out += [text[upto:s], placeholder]
        done = upto = max(done, e)
    return "".join([*out, text[upto:]])


def redact(docs: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """The documents, secrets in ``text`` replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = [None if x is None else redacted(x, placeholder) for x in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            if (n := b.schema.get_field_index("n_chars")) >= 0:
                cols[n] = pa.array([None if x is None else len(x) for x in texts], b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
