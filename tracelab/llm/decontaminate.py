"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows of ``WINDOW`` words and these into
shingles of up to ``SHINGLE`` words.  A document contains a window only if it
contains all the window's shingles, so one of them, the rarest of the corpus,
is prefix enough.  The documents' shingles that the benchmark has are found in
one pass and counted; those that are some window's rarest give candidates, of
which the offsets leave only starts that fit the document.  A candidate is
verified over the window's size: the document's shingles from its start on
must be the window's, in order, which is equality word by word.

Shingles meet by a 64-bit hash and are compared as words, so a collision of
hashes changes nothing.  The benchmark's side of a join is broadcast only if
its counted rows (and bytes, where it carries words) are few, else both sides
are shuffled, the documents' rows salted by position.  Everything by document
is sorted and aggregated by a number of the row, so it is bounded by one text.

Defined cases: a null text, document's or item's, has no words; an item
without words has no windows; items that share an item_id are one item, those
without an id another one, written as an empty string; a null doc_id stays
null; repeated rows are judged each; empty tables give zeros or no rows; other
columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.llm.common import BROADCAST_ROWS, few, stash

# Fixed values of the contract: words are runs of digits, letters a to z and anything beyond ASCII; words of a window.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10

SHINGLE = 3
#: A table of shingles with their words is broadcast up to this size.
BROADCAST_BYTES = 32 << 20
SALTS = 16
#: Positions of shingles of different lengths lie this far apart in one ordering.
STRIDE = 1 << 40


def lowered(text: Column) -> Column:
    """A to Z in lower case, everything else as it is."""
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(exact)


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), NO_WORD, -1), "")


def shingles(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (uid, words) -> (uid, n_words, pos, s, h): every ``size`` words in a row, their text and its hash."""
    parts = [F.col("words") if i == 0 else F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))) for i in range(size)]
    zipped = F.arrays_zip(*[p.alias(f"w{i}") for i, p in enumerate(parts)])
    each = rows.select("uid", F.size("words").alias("n_words"), F.posexplode(zipped).alias("pos", "z"))
    each = each.where(F.col(f"z.w{size - 1}").isNotNull())
    names = [F.col(f"z.w{i}") for i in range(size)]
    return each.select("uid", "n_words", "pos", F.concat_ws(" ", *names).alias("s"), F.xxhash64(*names).alias("h"))


def numbered(df: DataFrame, name: str, uid: str) -> DataFrame:
    """The rows with a number each, written out so that it stays."""
    return stash(df.withColumn(uid, F.monotonically_increasing_id()), name)


def windows_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wid, words) of the distinct windows and (wid, item) of the items that have them."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words"))
    last = F.greatest(F.size("words") - WINDOW, F.lit(0))
    cut = items.where(F.size("words") > 0).select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    cut = stash(cut.select("item", F.slice("words", F.col("at") + 1, WINDOW).alias("words")), "windows-cut")
    windows = numbered(cut.select("words").distinct(), "windows", "wid")
    return windows, stash(cut.join(windows, "words").select("wid", "item").distinct(), "windows-items")


def window_shingles(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sid, k, s, h) of the distinct shingles and (wid, length, sids, k), the windows as lists of them."""
    rows = windows.select(F.col("wid").alias("uid"), "words")
    cut = None
    for size in range(1, SHINGLE + 1):
        of_size = rows.where(F.least(F.size("words"), F.lit(SHINGLE)) == size)
        part = shingles(of_size, size).withColumn("k", F.lit(size))
        cut = part if cut is None else cut.union(part)
    cut = stash(cut, "window-shingles")
    known = numbered(cut.select("k", "s", "h").distinct(), "shingles", "sid")
    listed = cut.join(known.select("k", "s", "sid"), ["k", "s"]).groupBy("uid", "k", F.col("n_words").alias("length"))
    lists = listed.agg(F.array_sort(F.collect_list(F.struct("pos", "sid"))).getField("sid").alias("sids"))
    return known, stash(lists.withColumnRenamed("uid", "wid"), "window-lists")


def occurrences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(uid, n_words, pos, k, sid): the documents' shingles that are known.

    The join is by hash alone; the words are compared with two inequalities,
    since an equality would become part of the join's key."""
    sizes = known.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.octet_length("s")).alias("bytes")).collect()
    small = sum(r.n for r in sizes) <= BROADCAST_ROWS and sum(r.bytes for r in sizes) <= BROADCAST_BYTES
    out = None
    for size in sorted(r.k for r in sizes):
        right = known.where(F.col("k") == size).select("k", "sid", F.col("s").alias("known_s"), F.col("h").alias("known_h"))
        left = shingles(docs, size)
        same = (F.col("s") >= F.col("known_s")) & (F.col("s") <= F.col("known_s"))
        if small:
            found = left.join(F.broadcast(right), (F.col("h") == F.col("known_h")) & same)
        else:
            right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            found = left.join(right, (F.col("h") == F.col("known_h")) & (F.pmod("pos", F.lit(SALTS)) == F.col("salt")) & same)
        part = found.select("uid", "n_words", "pos", "k", "sid")
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "uid long, n_words int, pos int, k int, sid long")
    return stash(out, "occurrences")


def prefixes(lists: DataFrame, found: DataFrame) -> DataFrame:
    """(sid, wid, length, offset, sids): for each window whose shingles all occur,
    the rarest by count in the corpus (then by number, first place)."""
    count = found.groupBy("sid").agg(F.count("*").alias("c"))
    each = lists.select("wid", "length", F.posexplode("sids").alias("offset", "sid")).join(few(stash(count, "counts")), "sid", "left")
    rarest = each.groupBy("wid", "length").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "sid", "offset")).alias("p"))
    kept = rarest.where("p.c > 0").select("wid", "length", "p.sid", "p.offset")
    return stash(kept.join(lists.select("wid", "sids"), "wid"), "prefixes")


def hits(found: DataFrame, prefix: DataFrame) -> DataFrame:
    """(uid, wid, start, length) of every occurrence of a window in a document.

    Each shingle found is seen with those up to a window's length around it."""
    reach = WINDOW - 1
    at = (F.col("k") * F.lit(STRIDE) + F.col("pos")).cast("long")
    near = Window.partitionBy("uid").orderBy("at").rangeBetween(-reach, reach)
    seen = found.withColumn("at", at).withColumn("around", F.collect_list(F.struct("at", "sid")).over(near))
    p = prefix.select(F.col("sid").alias("p_sid"), "wid", "length", "offset", "sids")
    # Bounds by position: the window starts and ends inside the document.
    start = F.col("pos") - F.col("offset")
    candidate = seen.join(few(p), F.col("sid") == F.col("p_sid")).where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    first = F.col("at") - F.col("offset")
    own = F.filter("around", lambda e: (e["at"] >= first) & (e["at"] < first + F.size("sids")))
    candidate = candidate.select("uid", "wid", start.alias("start"), "length", "sids", own.getField("sid").alias("own"))
    return candidate.where(F.col("own") == F.col("sids")).select("uid", "wid", "start", "length")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document row."""
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words")), "doc-words", "uid")
    windows, items = windows_of(benchmark)
    known, lists = window_shingles(windows)
    found = occurrences(rows.select("uid", "words"), known)
    hit = stash(hits(found, prefixes(lists, found)), "hits")
    # Words inside any hit: what each hit adds beyond the furthest end before it.
    before = Window.partitionBy("uid").orderBy("start", "length", "wid").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = hit.select("uid", "start", end.alias("end"), F.coalesce(F.max(end).over(before), F.lit(0)).alias("upto"))
    covered = spans.groupBy("uid").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "upto"), F.lit(0))).alias("n_hit"))
    held = hit.select("uid", "wid").distinct().join(few(items), "wid").groupBy("uid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    judged = rows.select("uid", "doc_id", F.size("words").cast("long").alias("n_words"))
    judged = judged.join(covered.join(held, "uid"), "uid", "left")
    listed = F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return judged.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


CONTAMINATION_SQL = rf"""
WITH doc_words AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, w[i + 1:i + {WINDOW}] AS win, least(len(w), {WINDOW}) AS n
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS i FROM items WHERE len(w) > 0)
),
places AS (
  SELECT uid, i, n, w[i + 1:i + n] AS win
  FROM (SELECT uid, w, n, unnest(range(len(w) - n + 1)) AS i FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
found AS (SELECT uid, i, p.n, item FROM places p JOIN windows v ON p.n = v.n AND p.win = v.win),
covered AS (SELECT uid, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS x FROM found) GROUP BY uid),
held AS (SELECT uid, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (uid) LEFT JOIN held USING (uid)
"""
