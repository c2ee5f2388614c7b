"""Suffix-array dedup: every byte covered by a string of ``LENGTH`` bytes that
also starts earlier is removed.

Strings of LENGTH bytes that are equal choose the same anchor: the short gram
of lowest hash in them.  Neighbouring strings with one anchor form a segment,
so each string lies in exactly one segment and equal strings lie in segments
of the same gram.  Segments equal as a whole are settled by their hashes: all
but the first are covered.  Where a gram has several different segments, their
texts are fetched and their suffixes sorted by a merge sort that compares two
suffixes by the longest common extension, a binary search over prefix
polynomial hashes; neighbours found equal are verified byte by byte, and in
each class of equal strings all but the first are covered.  Grams with more
than ``HOT`` segments are settled by grouping digests of their strings
instead, which no single task gathers.  Only covered ranges travel back.

Defined cases: null and empty texts have no bytes; texts shorter than LENGTH
stay; a text of any length is treated whole; rows that share a doc_id count as
one document (starts are compared), so repeated rows do not remove each other;
null doc_ids come last, as one document; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import stash, text_bytes

LENGTH, GRAM = 100, 24
WINDOW = LENGTH - GRAM + 1  # grams in a string, and the most strings in a segment
BATCH_BYTES = 3 << 20
BUCKET_BYTES = 4 << 20
BUCKET_SEGMENTS = 10_000
HOT = BUCKET_SEGMENTS // 10  # more of one gram would make a task uneven
RUNS = (16, 4, 1)  # lengths of runs of strings, each a multiple of the next
LAST_ID = (1 << 63) - 1
#: One segment: hash of its text, gram, packed numbers (see _packed), document, row, start of its first string.
SEGMENT = np.dtype([("text", "<u8"), ("gram", "<u4"), ("packed", "<u2"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4")])
#: Base of the polynomial hashes modulo 2^64 (odd, so that it has an inverse).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class PrefixHashes:
    """Hash of any substring in constant time from prefix polynomial hashes."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.back = _powers(INVERSE, n + 1)
        self.upto = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers(BASE, max(n, 1))[:n], out=self.upto[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.upto[start + length] - self.upto[start]) * self.back[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _packed(strings: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Strings in the segment (7 bits), offset of the anchor (7 bits)."""
    return (strings | anchor << 7).astype(np.uint16)


def segments(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments (SEGMENT) of documents that lie one after the other in ``text``, and each one's full gram hash."""
    long_enough = ends - starts >= LENGTH
    starts, ends, docs, numbers = (x[long_enough] for x in (starts, ends, docs, numbers))
    if not len(starts):
        return np.zeros(0, SEGMENT), np.zeros(0, np.uint64)
    hashes = PrefixHashes(text)
    n = len(text) - GRAM + 1
    gram = (hashes.upto[GRAM:] - hashes.upto[:n]) * hashes.back[:n]
    gram = mixed(gram)
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - width)], low[WINDOW - width :])
    anchors = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    count = ends - starts - LENGTH + 1
    doc = np.repeat(np.arange(len(starts)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[doc]
    anchor = anchors[at]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    strings = np.diff(np.r_[first, len(at)])
    at, anchor, doc = at[first], anchor[first], doc[first]
    out = np.zeros(len(first), SEGMENT)
    full = gram[anchor]
    out["text"] = mixed(hashes.of(at, strings + LENGTH - 1) + strings.astype(np.uint64))
    out["gram"] = (full >> np.uint64(16)).astype(np.uint32)
    out["packed"] = _packed(strings, anchor - at)
    out["doc"], out["row"], out["start"] = docs[doc], numbers[doc], at - starts[doc]
    return out, full


def settle(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments sorted by gram and text, and for each whether an equal one
    starts earlier and how many different texts its gram has."""
    shape = found["packed"]
    order = np.lexsort((found["start"], found["doc"], shape, found["text"], found["gram"]))
    found, shape = found[order], shape[order]
    if not len(found):
        return found, np.zeros(0, bool), np.zeros(0, np.int64)
    new_gram = np.r_[True, found["gram"][1:] != found["gram"][:-1]]
    new = new_gram | np.r_[True, (found["text"][1:] != found["text"][:-1]) | (shape[1:] != shape[:-1])]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (found["doc"] != found["doc"][head]) | (found["start"] != found["start"][head])
    each = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_gram))
    return found, later, each[np.cumsum(new_gram) - 1]


def _blobs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(doc, row, t) -> (bucket, data): a bucket's segments; buckets below 0 hold covered ones."""

    def out(texts: list[bytes], docs: list[int], numbers: list[int]) -> pa.RecordBatch:
        ends = np.cumsum([len(x) for x in texts])
        starts = ends - [len(x) for x in texts]
        found, full = segments(np.frombuffer(b"".join(texts), np.uint8), starts, ends, np.array(docs, np.int64), np.array(numbers, np.int64))
        bucket = (full % np.uint64(buckets)).astype(np.int64)
        # What repeats in the batch need not travel: only the first goes on.
        order = np.argsort(bucket, kind="stable")
        names, data = [], []
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        covered = []
        for part in np.split(order, cut) if len(order) else []:
            rows, later, _ = settle(found[part])
            names.append(int(bucket[part[0]]))
            data.append(rows[~later].tobytes())
            covered.append(rows[later])
        if covered and len(rows := np.concatenate(covered)):
            names.append(-1 - int(rows["row"][0] % buckets))
            data.append(rows.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    texts, docs, numbers, size = [], [], [], 0
    for b in batches:
        for doc, number, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            data = x.as_buffer().to_pybytes()
            if len(data) < LENGTH:
                continue
            texts.append(data)
            docs.append(doc)
            numbers.append(number)
            size += len(data)
            if size >= BATCH_BYTES:
                yield out(texts, docs, numbers)
                texts, docs, numbers, size = [], [], [], 0
    if texts:
        yield out(texts, docs, numbers)


SETTLED = "doc long, row long, start int, strings int, anchor int, gram long, texts int"


def _settled(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
    """A bucket's covered segments (texts 0) and those whose gram has other texts."""
    found = np.frombuffer(b"".join(blobs["data"]), SEGMENT)
    if key[0] < 0:
        keep, texts = found, np.zeros(len(found), np.int64)
    else:
        found, later, each = settle(found)
        chosen = later | (each > 1)
        keep, texts = found[chosen], np.where(later, 0, each)[chosen]
    packed = keep["packed"].astype(np.int64)
    gram = (keep["gram"].astype(np.int64) << 24) + max(0, key[0])
    return pd.DataFrame({"doc": keep["doc"], "row": keep["row"], "start": keep["start"], "strings": packed & 127, "anchor": packed >> 7, "gram": gram, "texts": texts})


def common_extension(text: np.ndarray, hashes: PrefixHashes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length (at most LENGTH) that the suffixes at a and b have in common."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
    for _ in range(LENGTH.bit_length()):
        mid = (low + high + 1) // 2
        same = hashes.of(a, mid) == hashes.of(b, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_sort(text: np.ndarray, hashes: PrefixHashes, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of suffixes by their first LENGTH bytes within each group (groups
    come together): a merge sort that does all merges of a round at once."""
    n = len(at)
    new = np.r_[True, group[1:] != group[:-1]]
    base = np.flatnonzero(new)[np.cumsum(new) - 1]
    size = np.diff(np.r_[np.flatnonzero(new), n])[np.cumsum(new) - 1]
    order, width = np.arange(n), 1
    while width < size.max(initial=0):
        place = np.arange(n) - base
        run = place // width
        other = (run ^ 1) * width
        act = np.flatnonzero(other < size)
        x, left = at[order[act]], run[act] % 2 == 0
        low = other[act].copy()
        high = np.minimum(low + width, size[act])
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            y, mine = at[order[base[act[open_]] + mid]], x[open_]
            same = common_extension(text, hashes, mine, y)
            end = np.minimum(same, LENGTH - 1)
            below = (same < LENGTH) & (text[y + end] < text[mine + end])  # y before mine
            goes = np.where(left[open_], below, below | (same == LENGTH))
            low[open_], high[open_] = np.where(goes, mid + 1, low[open_]), np.where(goes, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        new_place = np.arange(n)
        new_place[act] = base[act] + (run[act] // 2) * 2 * width + (place[act] - run[act] * width) + (low - other[act])
        after = np.empty_like(order)
        after[new_place] = order
        order, width = after, width * 2
    return order


def _strings(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts one after the other, and for each string its start in them, its row, and its number in the row."""
    text = np.frombuffer(b"".join(rows["s"]), np.uint8)
    count = rows["strings"].to_numpy(np.int64)
    row = np.repeat(np.arange(len(rows)), count)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    length = count + LENGTH - 1
    return text, (np.cumsum(length) - length)[row] + j, row, j


RUN_COLUMNS = "digest binary, core binary, doc long, row long, start int, strings int, anchor int, s binary"
COVERED = "row long, start int, n int"


def _sorted_segments(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Strings of the rows' segments that also start earlier in another row."""
    text, at, row, j = _strings(rows)
    gram, doc, start, anchor = (rows[c].to_numpy() for c in ("gram", "doc", "start", "anchor"))
    offset = anchor[row] - j  # equal strings have the anchor at the same place
    order = np.lexsort((offset, gram[row]))
    at, row, j, offset = at[order], row[order], j[order], offset[order]
    new = np.r_[True, (gram[row][1:] != gram[row][:-1]) | (offset[1:] != offset[:-1])]
    several = ~(new & np.r_[new[1:], True])  # a group of one string has no equal
    at, row, j, group = at[several], row[several], j[several], np.cumsum(new)[several]
    if not len(at):
        return pd.DataFrame({"row": row, "start": row, "n": row})
    hashes = PrefixHashes(text)
    order = suffix_sort(text, hashes, at, group)
    at, row, j, group = at[order], row[order], j[order], group[order]
    same = np.zeros(len(at), bool)
    near = np.flatnonzero(group[1:] == group[:-1]) + 1
    same[near] = common_extension(text, hashes, at[near], at[near - 1]) == LENGTH
    where, step = np.flatnonzero(same), 1 << 16
    for i in range(0, len(where), step):  # verify what the hashes call equal
        w = where[i : i + step]
        across = np.arange(LENGTH)
        same[w] = (text[at[w][:, None] + across] == text[at[w - 1][:, None] + across]).all(1)
    kind = np.cumsum(~same)
    begin = start[row] + j
    order = np.lexsort((begin, doc[row], kind))
    kind, row, j, begin = kind[order], row[order], j[order], begin[order]
    new = np.r_[True, kind[1:] != kind[:-1]] if len(kind) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.flatnonzero((doc[row] != doc[row][head]) | (begin != begin[head]))
    return pd.DataFrame({"row": rows["row"].to_numpy()[row[later]], "start": begin[later], "n": 1})


def _digests(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """Runs of up to ``step`` strings (cut where the anchor's offset is a
    multiple of it, so that equal strings lie in like runs) by their digest,
    with the digest of the bytes that any string at such offsets has."""
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    for b in batches:
        out: list[tuple] = []
        for doc, number, start, strings, anchor, s in zip(*(b.column(c).to_pylist() for c in ("doc", "row", "start", "strings", "anchor", "s")), strict=True):
            j = 0
            while j < strings:
                n = min(strings - j, (anchor - j) % step + 1)
                part = s[j : j + n + LENGTH - 1]
                past = (anchor - j) % step
                core = b"%d:" % ((anchor - j) // step) + part[past : LENGTH - (step - 1 - past)]
                out.append((hashlib.blake2b(part, digest_size=16).digest(), hashlib.blake2b(core, digest_size=16).digest(), doc, number, start + j, n, anchor - j, part))
                j += n
        cols = list(zip(*out, strict=True)) if out else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["digest", "core", "doc", "row", "start", "strings", "anchor", "s"])


def by_digests(found: DataFrame) -> DataFrame:
    """What _sorted_segments finds, by grouping: runs of strings first, then
    ever shorter ones of the runs that are not covered as a whole but share
    their core with another such run (first occurrences are among these)."""
    covered = None
    for step in RUNS:
        runs = stash(found.select("doc", "row", "start", "strings", "anchor", "s").mapInArrow(lambda b, step=step: _digests(b, step), RUN_COLUMNS), "suffix-runs")
        first = runs.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("times"))
        if step > 1:
            judged = stash(runs.join(first.drop("times"), "digest").withColumn("later", F.expr("struct(doc, start) > first")), "suffix-judged")
            rest = judged.where("NOT later")
            shared = rest.groupBy("core").agg(F.count("*").alias("sharing")).where("sharing > 1").select("core")
            found = rest.join(shared, "core")
        else:
            judged = runs.join(first.where("times > 1"), "digest").withColumn("later", F.expr("struct(doc, start) > first"))
        part = judged.where("later").select("row", "start", F.col("strings").alias("n"))
        covered = covered.union(part) if covered is not None else part
    return covered


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, doc, row, wanted) -> the texts of the segments wanted of each document."""
    names = ["start", "strings", "anchor", "gram", "texts"]

    def out(doc: list, number: list, wanted: list[pa.StructArray], texts: list[bytes]) -> pa.RecordBatch:
        each = [len(w) for w in wanted]
        owners = [pa.array(np.repeat(np.array(x, np.int64), each)) for x in (doc, number)]
        return pa.RecordBatch.from_arrays(
            [*owners, *(pa.concat_arrays([w.field(i) for w in wanted]) for i in range(len(names))), pa.array(texts, pa.binary())],
            names=["doc", "row", *names, "s"],
        )

    for b in batches:
        held, texts, size = [], [], 0
        for t, doc, number, w in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            data, w = t.as_buffer(), w.values
            start, strings = w.field(0).to_numpy().astype(np.int64), w.field(1).to_numpy()
            texts += [data[s:e].to_pybytes() for s, e in zip(start.tolist(), (start + strings + LENGTH - 1).tolist(), strict=True)]
            held.append((doc, number, w))
            size += int((strings + LENGTH - 1).sum())
            if size >= BATCH_BYTES:
                yield out(*zip(*held, strict=True), texts)
                held, texts, size = [], [], 0
        if held:
            yield out(*zip(*held, strict=True), texts)


def cut(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left without the ranges, and the number of maximal runs removed."""
    kept, runs, upto = [], 0, 0
    end = -1
    for s, e in sorted(ranges):
        if s > end:
            runs += 1
            kept.append(data[upto:s])
        upto = end = max(end, e)
    return b"".join([*kept, data[upto:]]), runs


def covered_ranges(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (doc, row, t; stashed, ``row`` unique) -> (row, start, n): n strings from ``start`` on also start earlier."""
    blobs = docs.select("doc", "row", "t").mapInArrow(lambda b: _blobs(b, buckets), "bucket int, data binary")
    settled = stash(blobs.groupBy("bucket").applyInPandas(_settled, SETTLED), "suffix-settled")
    wanted = settled.where("texts > 0").groupBy("row").agg(F.collect_set(F.struct("start", "strings", "anchor", "gram", "texts")).alias("wanted"))
    schema = "doc long, row long, start int, strings int, anchor int, gram long, texts int, s binary"
    fetched = stash(docs.join(wanted, "row").select("t", "doc", "row", "wanted").mapInArrow(_fetched, schema), "suffix-texts")
    groups = max(1, -(-fetched.where(f"texts <= {HOT}").count() // BUCKET_SEGMENTS))
    few_texts = fetched.where(f"texts <= {HOT}").withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(groups)))
    by_sort = few_texts.groupBy("part").applyInPandas(_sorted_segments, COVERED)
    by_digest = by_digests(fetched.where(f"texts > {HOT}"))
    return settled.where("texts = 0").select("row", "start", F.col("strings").alias("n")).union(by_sort).union(by_digest)


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and what
    is left of its text (kept binary) unless that is not wanted."""
    # Rows may share an id (and a null one): each is known by a number of its own, fixed by writing it.
    rows = stash(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
            F.monotonically_increasing_id().alias("row"),
            text_bytes().alias("t"),
        ),
        "suffix-rows",
    )
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    found = covered_ranges(rows, max(16, -(-total // BUCKET_BYTES)))
    each = found.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for x, ranges in zip(b.column(1), b.column(2), strict=True):
                data, runs = x.as_buffer().to_pybytes(), 0
                kept = data
                if ranges.is_valid:
                    start, n = (ranges.values.field(i).to_numpy() for i in range(2))
                    kept, runs = cut(data, list(zip(start.tolist(), (start + n + LENGTH - 1).tolist(), strict=True)))
                out.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 1 + len(kinds)])

    return rows.join(each, "row", "left").select("doc_id", "t", "ranges").mapInArrow(run, schema)
