"""SentencePiece encoding and decoding with a unigram Viterbi search.

Pieces with log scores lie in a double-array trie over UTF-8 bytes.  A text
(one space marker in front, spaces as markers) is cut where no piece can
cross, each part is segmented by the path of the highest total score, and
characters without a piece fall back to byte pieces.  Decoding joins pieces
and bytes and turns markers to spaces.

The vocabulary (some ten thousand pieces, about 1 MB) is read by the driver
and broadcast; a vocabulary over ``MAX_PIECES`` is refused.

Defined cases: a null text gives null ids and decodes to null; an empty text
gives no ids; a text of any length is encoded whole; a marker character in
the text decodes to a space (round_trip false); invalid bytes cannot occur in
a string column; repeated rows are encoded each; an empty table gives an empty
result; other columns pass through ``encode``.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

MARKER = "▁"
#: What an unknown character scores below the lowest piece (fixed value of the format).
UNKNOWN_PENALTY = 10.0
MAX_PIECES = 1_000_000
#: A worker's cache of parts: bytes of a generation (two are kept) as estimated by ENTRY_BYTES and lengths, longest part.
CACHE_BYTES, ENTRY_BYTES, CACHE_PART_CHARS = 16 << 20, 200, 64
#: Texts are encoded and handed on in slices of about this many bytes.
SLICE_BYTES = 1 << 20
#: Parts up to PART_BYTES are searched together, TOGETHER_BYTES of them at a time.
PART_BYTES, TOGETHER_BYTES = 256, 1 << 17


def double_array(keys: list[bytes]) -> tuple[array, array]:
    """(base, check) for sorted distinct keys: the child of node s by byte c is
    base[s] + c + 1 if check there is s; base[s] + 0 is s's end node, whose
    base is -1 - the key's index."""
    base, check = array("i", [0]) * 1024, array("i", [-1]) * 1024
    check[0] = 0
    free = 1
    todo = [(0, 0, len(keys), 0)]
    while todo:
        node, lo, hi, depth = todo.pop()
        codes: list[tuple[int, int, int]] = []
        at = lo
        if at < hi and len(keys[at]) == depth:
            codes.append((0, at, at + 1))
            at += 1
        while at < hi:
            c, start = keys[at][depth], at
            while at < hi and keys[at][depth] == c:
                at += 1
            codes.append((c + 1, start, at))
        if not codes:
            continue
        while check[free] >= 0:
            free += 1
            if free + 512 >= len(check):
                base.extend([0] * len(base))
                check.extend([-1] * len(check))
        b = max(1, free - codes[0][0])
        while True:
            if b + 512 >= len(check):
                base.extend([0] * len(base))
                check.extend([-1] * len(check))
            if all(check[b + c] < 0 for c, _, _ in codes):
                break
            b += 1
        base[node] = b
        for c, _, _ in codes:
            check[b + c] = node
        for c, start, end in codes:
            if c:
                todo.append((b + c, start, end, depth + 1))
            else:
                base[b] = -1 - start
    return base, check


class PartCache:
    """Ids (packed as int32) of parts seen lately: two generations of at most CACHE_BYTES."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def put(self, part: str, ids: bytes) -> None:
        if len(part) <= CACHE_PART_CHARS:
            size = ENTRY_BYTES + 2 * len(part) + len(ids)
            if self.size + size > CACHE_BYTES:
                self.new, self.old, self.size = {}, self.new, 0
            self.new[part] = ids
            self.size += size


#: By worker process: tasks that follow one another with one vocabulary share what they have seen.
_CACHES: dict[str, PartCache] = {}


def _cache_of(key: str) -> PartCache:
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = PartCache()
    return _CACHES[key]


@dataclass
class Vocabulary:
    """Pieces by id: text, log score, kind (normal, byte, unknown or control)."""

    pieces: list[str]
    scores: list[float]
    kinds: list[str]
    dummy_prefix: bool = True

    @cached_property
    def key(self) -> str:
        return hashlib.sha256(repr((self.pieces, self.scores, self.kinds, self.dummy_prefix)).encode()).hexdigest()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        if n > MAX_PIECES:
            raise ValueError(f"{n} pieces; at most {MAX_PIECES} are broadcast")
        kind = lambda i: "byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i) or m.is_unused(i) else "normal"
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], [kind(i) for i in range(n)])

    @cached_property
    def normal(self) -> list[int]:
        return sorted((i for i, k in enumerate(self.kinds) if k == "normal"), key=lambda i: self.pieces[i].encode())

    @cached_property
    def trie(self) -> tuple[array, array]:
        return double_array([self.pieces[i].encode() for i in self.normal])

    @cached_property
    def walk(self) -> tuple[list[int], list[int], list[int]]:
        """The trie as lists, with the id of the piece that ends at each node (else -1)."""
        base, check = (x.tolist() for x in self.trie)
        ends = [-1] * len(base)
        for end, node in enumerate(check):
            if base[end] < 0 and node >= 0 and base[node] == end:
                ends[node] = self.normal[-1 - base[end]]
        return base, check, ends

    @cached_property
    def bytes_at(self) -> dict[int, int]:
        return {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == "byte"}

    @cached_property
    def unknown(self) -> int:
        return next((i for i, k in enumerate(self.kinds) if k == "unknown"), 0)

    @cached_property
    def part(self) -> re.Pattern | None:
        """Cuts a text (spaces for markers) where no piece can cross: before a
        run of spaces, and around white space that is in no longer piece."""
        inner = [self.pieces[i] for i in self.normal if len(self.pieces[i]) > 1]
        if any(re.search(f"[^{MARKER}]{MARKER}", p) for p in inner):
            return None
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in inner))
        return re.compile(rf"[{alone}]| *[^ {alone}]+| +" if alone else r" *[^ ]+| +")

    @cached_property
    def lowest(self) -> float:
        return min((self.scores[i] for i in self.normal), default=0.0) - UNKNOWN_PENALTY

    def best_path(self, data: bytes) -> list[int]:
        """Ids of the segmentation of the highest total score; on ties the one
        whose last differing piece is longer."""
        base, check, ends = self.walk
        scores, unknown_score = self.scores, self.lowest
        n = len(data)
        best: list[float | None] = [None] * (n + 1)
        came: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            score = best[at]
            if score is None:  # inside a character, or no way to here
                continue
            lead = data[at]
            char_end = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            node, to, single = 0, at, False
            while to < n:
                child = base[node] + data[to] + 1
                if check[child] != node:
                    break
                node, to = child, to + 1
                i = ends[node]
                if i >= 0:
                    value = score + scores[i]
                    if best[to] is None or value > best[to]:
                        best[to], came[to] = value, (at, i)
                    if to == char_end:
                        single = True
            if not single:
                value = score + unknown_score
                if best[char_end] is None or value > best[char_end]:
                    best[char_end], came[char_end] = value, (at, -1)
        ids: list[int] = []
        at = n
        while at:
            start, i = came[at]
            if i >= 0:
                ids.append(i)
            elif len(self.bytes_at) == 256:
                ids += [self.bytes_at[x] for x in reversed(data[start:at])]
            else:
                ids.append(self.unknown)
            at = start
        return ids[::-1]

    @cached_property
    def tables(self) -> tuple[np.ndarray, ...]:
        """The trie (base, check, id that ends at a node), the scores, and the id of each byte (or -1)."""
        of_byte = np.full(256, -1, np.int32)
        for byte, i in self.bytes_at.items():
            of_byte[byte] = i
        return *(np.array(x, np.int32) for x in self.walk), np.array([*self.scores, self.lowest]), of_byte

    def best_paths(self, parts: list[bytes]) -> list[bytes]:
        """``best_path`` of every part (packed as int32), searched together: the
        trie is walked from all characters at once, then the best scores move
        through all parts by the place of a piece's start."""
        base, check, ends, scores, of_byte = self.tables
        sizes = np.array([len(p) for p in parts], np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        first = np.cumsum(sizes) - sizes  # of each part, in bytes
        part = np.repeat(np.arange(len(parts)), sizes)
        start = np.flatnonzero((data & 0xC0) != 0x80)
        left = (first + sizes)[part[start]] - start
        wide = np.where(data[start] < 0x80, 1, np.where(data[start] < 0xE0, 2, np.where(data[start] < 0xF0, 3, 4)))
        wide = np.minimum(wide, left)
        # Pieces at every character: place of the start, length, id.
        at, node, depth = np.arange(len(start)), np.zeros(len(start), np.int64), 0
        alone = np.zeros(len(start), bool)
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        while len(at):
            inside = left[at] > depth
            at, node = at[inside], node[inside]
            child = base[node] + data[start[at] + depth].astype(np.int64) + 1
            ok = check[child] == node
            at, node, depth = at[ok], child[ok], depth + 1
            i = ends[node]
            hit = i >= 0
            found.append((at[hit], depth, i[hit]))
            alone[at[hit][wide[at[hit]] == depth]] = True
        none = np.flatnonzero(~alone)
        who = np.concatenate([*(f[0] for f in found), none])
        length = np.concatenate([*(np.full(len(f[0]), f[1]) for f in found), wide[none]])
        piece = np.concatenate([*(f[2] for f in found), np.full(len(none), -1)])
        # Best score of every place of every part (one more place than bytes).
        slot = start + part[start]
        begin = slot[who]
        place = start[who] - first[part[start[who]]]
        order = np.argsort(place, kind="stable")
        begin, length, piece, place = begin[order], length[order], piece[order], place[order]
        gain = scores[piece]  # the last entry is an unknown character's
        best = np.full(len(data) + len(parts), -np.inf)
        best[first + np.arange(len(parts))] = 0.0
        came, chosen = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # pieces of one start end at different places
            value, end = best[begin[lo:hi]] + gain[lo:hi], begin[lo:hi] + length[lo:hi]
            better = value > best[end]
            end = end[better]
            best[end], came[end], chosen[end] = value[better], begin[lo:hi][better], piece[lo:hi][better]
        # Back from the ends, all parts a piece at a time.
        now, of = first + np.arange(len(parts)) + sizes, np.arange(len(parts))
        steps = []
        while len(of):
            back = came[now]
            steps.append((of, chosen[now], back - of, now - back))  # (a place is its byte plus its part's number)
            going = back > (first + np.arange(len(parts)))[of]
            now, of = back[going], of[going]
        of, ids, byte, size = (np.concatenate([s[i] for s in reversed(steps)]) for i in range(4))
        order = np.argsort(of, kind="stable")
        of, ids, byte, size = of[order], ids[order], byte[order], size[order]
        spelled = (ids < 0) & bool(len(self.bytes_at) == 256)
        count = np.where(spelled, size, 1)
        out = np.repeat(np.where(ids < 0, self.unknown, ids), count).astype(np.int32)
        ends_at = np.cumsum(count)
        if spelled.any():
            rows = np.repeat(spelled, count)
            offset = np.arange(len(out)) - np.repeat(ends_at - count, count) + np.repeat(byte, count)
            out[rows] = of_byte[data[offset[rows]]]
        upto = np.concatenate([[0], np.cumsum(np.bincount(of, count, len(parts)).astype(np.int64))]) * 4
        raw = out.tobytes()
        return [raw[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def packed(self, texts: list[str | None], cache: PartCache) -> list[bytes | None]:
        """The ids of each text as int32 (None for None): every distinct part is
        looked up or searched once."""
        marked = [None if t is None else t.replace(MARKER, " ") for t in texts]
        marked = [" " + t if t and self.dummy_prefix else t for t in marked]
        split = [self.part.findall(t) if t and self.part else [t] if t else [] for t in marked]
        got = {p: cache.new.get(p) or cache.old.get(p) for p in set().union(*split)}
        missing = [p for p, ids in got.items() if ids is None]
        raw = {p: p.replace(" ", MARKER).encode("utf-8", "replace") for p in missing}
        together, size = [], 0
        for p in missing:
            if len(raw[p]) <= PART_BYTES:
                together.append(p)
                size += len(raw[p])
            if together and (size >= TOGETHER_BYTES or p is missing[-1]):
                got.update(zip(together, self.best_paths([raw[q] for q in together]), strict=True))
                together, size = [], 0
        for p in missing:
            if got[p] is None:
                got[p] = array("i", self.best_path(raw[p])).tobytes()
        for p, ids in got.items():
            if p not in cache.new:
                cache.put(p, ids)
        return [None if t is None else b"".join([got[p] for p in parts]) for t, parts in zip(marked, split, strict=True)]

    def encode(self, text: str, cache: PartCache) -> array:
        return array("i", self.packed([text], cache)[0])

    @cached_property
    def surfaces(self) -> list[bytes]:
        """What each id decodes to."""
        by = {"normal": lambda p: p.replace(MARKER, " ").encode(), "byte": lambda p: bytes([int(p[3:5], 16)]), "unknown": lambda p: " ⁇ ".encode(), "control": lambda p: b""}
        return [by[k](p) for p, k in zip(self.pieces, self.kinds, strict=True)]

    def decode(self, ids: array | list[int]) -> str:
        text = b"".join(map(self.surfaces.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _ready(vocabulary: Vocabulary) -> Vocabulary:
    """With the trie built, so that tasks get it by broadcast."""
    _ = vocabulary.key, vocabulary.walk, vocabulary.tables, vocabulary.part, vocabulary.surfaces, vocabulary.bytes_at, vocabulary.lowest
    return vocabulary


def _lists(each: list[bytes | None]) -> pa.Array:
    offsets = np.zeros(len(each) + 1, np.int64)
    np.cumsum([0 if x is None else len(x) // 4 for x in each], out=offsets[1:])
    mask = pa.array([x is None for x in each], pa.bool_())
    values = pa.array(np.frombuffer(b"".join([x for x in each if x is not None]), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows in slices that end once their texts have SLICE_BYTES."""
    for b in batches:
        size = pc.binary_length(b.column(b.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
        upto, first = np.cumsum(size, dtype=np.int64), 0
        while first < b.num_rows:
            done = upto[first - 1] if first else 0
            end = min(b.num_rows, int(np.searchsorted(upto, done + SLICE_BYTES)) + 1)
            yield b.slice(first, end - first)
            first = end


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The documents with ``ids`` array<int> and ``n_pieces`` long in place of
    columns of these names."""
    kept = docs.drop("ids", "n_pieces")
    shared = docs.sparkSession.sparkContext.broadcast(_ready(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        cache = _cache_of(v.key)
        for b in _slices(batches, "text"):
            ids = v.packed(b.column(b.schema.get_field_index("text")).to_pylist(), cache)
            n = pa.array([None if x is None else len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(ids), n], names=[*b.schema.names, "ids", "n_pieces"])

    schema = StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("n_pieces", LongType())])
    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows with ``decoded`` string, the text of ``ids``."""
    kept = encoded.drop("decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(_ready(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = [None if not ok else v.decode(flat[s:e].tolist()) for ok, s, e in zip(ids.is_valid().to_pylist(), offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, n_pieces, n_byte_pieces, ids_sha256, round_trip): each row
    encoded and decoded again."""
    shared = docs.sparkSession.sparkContext.broadcast(_ready(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        cache = _cache_of(v.key)
        is_byte = np.array([k == "byte" for k in v.kinds])
        for b in _slices(batches, "text"):
            texts = b.column(1).to_pylist()
            ids = v.packed(texts, cache)
            flat = [None if x is None else np.frombuffer(x, np.int32) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    _lists(ids),
                    pa.array([None if f is None else len(f) for f in flat], pa.int64()),
                    pa.array([None if f is None else int(is_byte[f].sum()) for f in flat], pa.int64()),
                    pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([None if f is None else v.decode(f.tolist()) == t for f, t in zip(flat, texts, strict=True)], pa.bool_()),
                ],
                names=["doc_id", "ids", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean")
