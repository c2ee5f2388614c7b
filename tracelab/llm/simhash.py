"""SimHash near-dedup: bit-sliced comparison of fingerprints.

Documents whose 64-bit fingerprints differ in at most ``radius`` bits are
linked; a class is what links connect.  Only distinct fingerprints are
compared.  Any two within the radius agree on some set of key bits (pigeonhole
over bit blocks), so they meet in a bucket.  In a bucket, fingerprints lie in
blocks of 64 lanes stored as vertical bit planes; one fingerprint is compared
with a whole block by XOR per plane, the 64 distances growing in carry-save
counter planes, and the block is abandoned once every lane is over the radius.
A bucket gives a spanning forest of its links, never all pairs.

Defined cases: null or empty text, or one without a word, has fingerprint
zero; fewer words than the shingle length form one shingle; repeated rows
share their class; rows with a null doc_id are linked but do not name a class
(a class of such rows alone has a null component_id); empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import few, stash, text_bytes
from tracelab.llm.components import connected_components

#: Seed of the shingle hash (fixed value).
SEED = 42
SHINGLES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 17
#: Fingerprints that one task compares within one bucket; larger buckets are
#: compared piece by piece, every pair of pieces in a group of its own.
BUCKET_ROWS = 20_000


def fingerprint(data: bytes, words_per_shingle: int = 3) -> int:
    """64-bit SimHash (unsigned) of the ASCII-lower-cased words of a text."""
    words = data.lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    total = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, SHINGLES_AT_ONCE):
        part = words[at : at + SHINGLES_AT_ONCE + k - 1]
        hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(k)))), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, digests: bool = False) -> DataFrame:
    """(doc_id, fp): ``fp`` is the fingerprint as a signed long; with
    ``digests`` also ``h``, the SHA-256 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_buffer().to_pybytes(), words_per_shingle) for x in b.column(1)), np.uint64, b.num_rows)
            columns = {"doc_id": b.column(0), "fp": pa.array(fps.view(np.int64))}
            if digests:
                columns["h"] = pa.array([hashlib.sha256(x.as_buffer()).digest() for x in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, fp long" + ", h binary" * digests
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t")).mapInArrow(run, schema)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """planes[block, bit]: bit ``bit`` of the 64 fingerprints of the block, one per lane."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def close_lanes(planes: np.ndarray, blocks: np.ndarray, queries: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (block, query) pair, the lanes (of those in ``lanes``) within
    the radius: (index of the pair, word of lanes), only pairs that have some.

    The counters start so that they overflow at radius + 1.
    """
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius
    alive = np.arange(len(blocks))
    over = ~lanes
    counter = [np.full(len(blocks), np.uint64(0xFFFFFFFFFFFFFFFF) if start >> i & 1 else np.uint64(0)) for i in range(width)]
    for bit in range(64):
        carry = planes[blocks, bit] ^ (np.uint64(0) - (queries >> np.uint64(bit) & np.uint64(1)))
        for c in counter:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if bit % 8 == 7:  # abandon blocks whose lanes are all over the radius
            left = np.flatnonzero(~over)
            if len(left) < len(alive):
                alive, over, blocks, queries = alive[left], over[left], blocks[left], queries[left]
                counter = [c[left] for c in counter]
            if not len(alive):
                break
    return alive, ~over


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest position that links (a, b) and earlier labels connect to each position."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bucket_links(bucket: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows come sorted by bucket.  Links (fp, root) that connect what lies
    within the radius in the same bucket."""
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    keep = np.repeat(sizes > 1, sizes)
    bucket, fps = bucket[keep], fps[keep]
    n = len(fps)
    if not n:
        return fps, fps
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    planes, label = bit_planes(fps), np.arange(n)
    first, blocks_each = np.arange(n) // 64, (ends - 1) // 64 - np.arange(n) // 64 + 1
    upto = np.cumsum(blocks_each)
    at = 0
    while at < n:  # each row against the rows after it in its bucket
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        each = blocks_each[at:to]
        row = np.repeat(np.arange(at, to), each)
        block = np.repeat(first[at:to], each) + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        low = np.clip(row + 1 - block * 64, 0, 64)
        high = np.clip(ends[row] - block * 64, 0, 64)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask = lambda k: np.where(k >= 64, full, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
        pair, found = close_lanes(planes, block, fps[row], mask(high) & ~mask(low), radius)
        if len(pair):
            which, lane = np.nonzero(np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            label = forest(n, row[pair[which]], block[pair[which]] * 64 + lane, label)
        at = to
    linked = label != np.arange(n)
    return fps[linked], fps[label[linked]]


def _links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Batches come sorted by bucket; a bucket may span several."""
    held: list[pd.DataFrame] = []

    def out(frames: list[pd.DataFrame]) -> pd.DataFrame:
        x = pd.concat(frames)
        change = (x[["t", "key", "p", "q"]] != x[["t", "key", "p", "q"]].shift()).any(axis=1).to_numpy()
        a, b = bucket_links(np.cumsum(change), x["fp"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    for x in batches:
        if x.empty:
            continue
        last = (x[["t", "key", "p", "q"]] == x[["t", "key", "p", "q"]].iloc[-1]).all(axis=1).to_numpy()
        cut = len(x) if not last.any() else int(len(x) - last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield out([*held, x.iloc[:cut]])
            held = []
        held.append(x.iloc[cut:])
    if held:
        yield out(held)


def key_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks, one for each choice of blocks - radius of the bit blocks: two
    values within the radius agree on at least one."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [sum(part[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def near_links(fps: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``fps`` (fp, distinct, stashed) -> links (a, b) whose components are
    those of all pairs within the radius.

    More distinct fingerprints get longer keys (more tables), so that buckets
    stay small; the result is the same.
    """
    n, blocks = fps.count(), radius + 1
    while blocks < radius + 4 and n >> (64 * (blocks - radius) // blocks) > 2000:
        blocks += 1
    signed = [m - (1 << 64) if m >> 63 else m for m in key_masks(radius, blocks)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)])
    keyed = fps.select("fp", F.inline(keys))
    size = keyed.groupBy("t", "key").count()
    dealt = keyed.withColumn("p", F.lit(0)).withColumn("q", F.lit(0))
    large = stash(size.where(F.col("count") > bucket_rows), "simhash-large")
    if large.limit(1).count():
        pieces = keyed.join(few(large), ["t", "key"], "left").withColumn("c", F.coalesce(F.ceil(F.col("count") / (bucket_rows // 2)).cast("int"), F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
        dealt = pieces.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select(
            "fp", "t", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")
        )
    dealt = dealt.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q")
    return dealt.mapInPandas(lambda batches: _links(batches, radius), "a long, b long")


def classes(marked: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp), stashed -> (fp, root, component_id) for every distinct
    fingerprint; ``root`` names its class whatever the ids are."""
    distinct = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-fps")
    roots = stash(connected_components(near_links(distinct.select("fp"), radius, bucket_rows), "simhash-links"), "simhash-roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_dedup(docs: DataFrame, words_per_shingle: int = 3, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document row."""
    marked = stash(fingerprints(docs, words_per_shingle), "simhash-docs")
    found = stash(classes(marked, radius, bucket_rows), "simhash-classes")
    return marked.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_per_shingle: int = 3, radius: int = 3) -> DataFrame:
    """The documents with one row of each class: that of the least doc_id (nulls
    last), then of the least SHA-256 of the text.

    Rows that repeat both are dropped, too.  Other columns pass.
    """
    marked = stash(fingerprints(docs, words_per_shingle, digests=True), "simhash-docs")
    found = stash(classes(marked, radius), "simhash-classes").select("fp", "root")
    copies = marked.groupBy("fp", "doc_id", "h").agg(F.count("*").alias("kept_rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h"), "kept_rows")).alias("first")
    least = copies.groupBy("fp").agg(first).join(found, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = stash(least.select("first.kept_id", "first.kept_h", "first.kept_rows"), "simhash-kept")
    # The row travels as one column, so no name of the documents' can clash.
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("whole")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(text_bytes(), 256)).alias("digest"))
    chosen = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_h")))
    single = chosen.where("kept_rows = 1").select("whole.*")
    if not kept.where("kept_rows > 1").limit(1).count():
        return single
    return single.union(chosen.where("kept_rows > 1").dropDuplicates(["id", "digest"]).select("whole.*"))
