"""Fill-in-middle transformation with a Roaring-style set of token boundaries.

The boundaries of a text's tokens are code-point offsets, kept by their upper
bits in containers of 65 536 offsets: a sorted array of few, a bitmap of many,
or runs where these are smaller.  The running sums of the containers'
cardinalities tell which one holds the k-th boundary; a select inside it gives
the offset.  Two selects cut a text into prefix, middle and suffix.

Defined cases: a null or empty text is plain with no tokens; a null doc_id
hashes as if it had no digits; repeated rows are cut alike; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import text_bytes

# Fixed values of the contract: marks, and the shares (in percent) of rewritten texts and of suffix-first ones among them.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
REWRITTEN, SUFFIX_FIRST = 90, 20
SEED = 1

CONTAINER_BITS = 16
ARRAY_MOST = 4096  # more offsets than this are smaller as a bitmap
WORD_BITS = 64
#: Texts are handed on in batches of about this many bytes.
SLICE_BYTES = 8 << 20


class Array:
    """Sorted offsets."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    """One bit an offset, with the running sums of bits by word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << CONTAINER_BITS, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, "right"))
        word, left = int(self.words[at]), k - (int(self.upto[at - 1]) if at else 0)
        for _ in range(left):
            word &= word - 1  # drop the lowest bit
        return at * WORD_BITS + (word & -word).bit_length() - 1


class Runs:
    """First offsets of runs of neighbours, with the running sums of their lengths."""

    def __init__(self, first: np.ndarray, length: np.ndarray):
        self.first, self.upto = first.astype(np.uint16), np.cumsum(length, dtype=np.int64)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, "right"))
        return int(self.first[at]) + k - (int(self.upto[at - 1]) if at else 0)


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest of the three for sorted offsets below 65 536."""
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    starts = np.concatenate([[0], breaks])
    if 4 * len(starts) < min(2 * len(low), 1 << (CONTAINER_BITS - 3)):
        return Runs(low[starts], np.diff(np.concatenate([starts, [len(low)]])))
    return Array(low) if len(low) <= ARRAY_MOST else Bitmap(low)


class BoundarySet:
    """A set of offsets that answers which is the k-th (from 0)."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> CONTAINER_BITS
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(high)) + 1, [len(offsets)]])
        self.keys = high[cuts[:-1]]
        mask = (1 << CONTAINER_BITS) - 1
        self.containers = [container(offsets[a:b] & mask) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.upto = cuts[1:]

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, "right"))
        before = int(self.upto[at - 1]) if at else 0
        return (int(self.keys[at]) << CONTAINER_BITS) + self.containers[at].select(k - before)


def boundaries(data: np.ndarray) -> tuple[BoundarySet, np.ndarray]:
    """The token boundaries (0 and the end included) of UTF-8 bytes, as
    code-point offsets, and whether a byte starts a code point."""
    starts = (data & 0xC0) != 0x80
    letter = (((data | 0x20) - ord("a")) < 26)[starts]
    inside = letter[1:] & letter[:-1]
    end = [len(letter)] if len(letter) else []
    return BoundarySet(np.concatenate([[0], np.flatnonzero(~inside) + 1, end]).astype(np.int64)), starts


def _cut(data: bytes, h: list[int]) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    ends, starts = boundaries(np.frombuffer(data, np.uint8))
    n = len(ends) - 1
    if not data or h[2] % 100 >= REWRITTEN or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    first, second = sorted(x % (n + 1) for x in h[:2])
    a, b = ends.select(first), ends.select(second)
    if starts.all():
        at, to = a, b
    else:
        of = np.append(np.flatnonzero(starts), len(data))
        at, to = int(of[a]), int(of[b])
    prefix, middle, suffix = data[:at], data[at:to], data[to:]
    if h[3] % 100 < SUFFIX_FIRST:
        form, parts = "spm", ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle))
    else:
        form, parts = "psm", ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle))
    return n, form, a, b - a, b"".join(mark.encode() + part for mark, part in parts)


def draws(seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers from the digest of the seed and the doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, first, size = [], 0, 0
            for i, (t, h) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                held.append(_cut(t.as_py(), h.as_py()))
                size += len(held[-1][4])
                if size >= SLICE_BYTES or i == b.num_rows - 1:
                    n, form, a, m, out = zip(*held, strict=True)
                    ids = b.column(0).slice(first, len(held))
                    longs = [pa.array(x, pa.int64()) for x in (n, a, m)]
                    yield pa.RecordBatch.from_arrays(
                        [ids, longs[0], pa.array(form, pa.string()), longs[1], longs[2], pa.array(out, pa.binary())],
                        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                    )
                    held, first, size = [], i + 1, 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"), draws(seed).alias("h"))
    cut = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return cut.withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text that gave an output.  No mark overlaps another, and a rewritten
    text holds none, so each mark is found once."""
    after = lambda mark: F.substring_index(output, mark, -1)
    until = lambda part, mark: F.substring_index(part, mark, 1)
    middle = after(MIDDLE)
    psm = F.concat(until(after(PREFIX), SUFFIX), middle, until(after(SUFFIX), MIDDLE))
    spm = F.concat(until(after(PREFIX), MIDDLE), middle, until(after(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``transform`` with SHA-256 digests of the output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    cut = transform(docs, seed)
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"),
    )


TRANSFORM_SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
         sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents
),
drawn AS (
  SELECT *, len(tokens)::BIGINT AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
         ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM cut
),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {REWRITTEN} THEN 'plain'
              WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn
),
parts AS (
  SELECT *, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:], '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
