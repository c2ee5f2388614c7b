"""URL filters by a Bloom filter cascade.

A URL's keys are its host and parent domains, each with the leading parts of
its path that rules may name.  Over the distinct keys of the whole corpus the
first filter encodes the listed keys, the second those others that pass the
first, the third the listed ones that pass the second, and so on until no key
passes wrongly: membership of any key of the corpus is then exact, with no
join.  A filter's bits follow from the list's length and the logarithm of the
corpus's; its words reach the rows as one constant of the plan.  Where a list
needs more than ``MAX_BITS``, the keys are dealt to shards by hash and the
pages pass the shards' cascades in turn.

Defined cases: a null URL or one without ``://`` has an empty host and path
and only the empty key; an empty list blocks nothing; repeated rows are judged
each; a rule listed for both verdicts allows; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import few, let, stash

#: The contract's rules (fixed values): host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words in a host name that put it on the host list of the query.
SPAM_WORDS = ("pills", "casino", "poker", "viagra", "loan", "porn")
MAX_BITS = 1 << 26


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def with_parts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of each row."""
    rest = F.coalesce(_rest(F.col("url")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", host.alias("host"), path.alias("path"))


def keys_of(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Array of (key, n): each of the host and its parent domains with the
    first n characters of the path, for the n in ``lengths`` that it has."""
    labels = F.split(host, r"\.", -1)
    domains = let(labels, lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x)), ".")))
    fits = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(domains, lambda d: F.transform(fits, lambda n: F.struct(F.concat(d, F.substring(path, F.lit(1), n)).alias("key"), n.alias("n")))))


def _positions(key: Column, level: int, bits: int, hashes: int) -> Column:
    h = F.xxhash64(F.lit(level), key)
    at, step = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1).cast("long"))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long")), lambda i: (at + i * step) % bits)


class Cascade:
    """Exact membership in ``listed`` for the keys of ``universe`` (stashed:
    key string, listed boolean; one row a key)."""

    def __init__(self, universe: DataFrame):
        n = universe.agg(F.count_if("listed").alias("p"), F.count("*").alias("n")).first()
        self.levels: list[tuple[Column, int, int]] = []
        into, against = universe.where("listed").select("key"), universe.where("NOT listed").select("key")
        count, others = n.p, n.n - n.p
        while count:
            level = len(self.levels)
            bits, hashes = self.size(count, others, level)
            self.levels.append((self._filter(into, level, bits, hashes), bits, hashes))
            passing = stash(against.where(self._passes(F.col("key"), level)), "cascade-keys")
            into, against = passing, into
            count, others = passing.count(), count

    @staticmethod
    def size(count: int, others: int, level: int = 0) -> tuple[int, int]:
        """(bits, hashes) of a filter of ``count`` keys that ``others`` are asked of:
        the first lets about half as many pass as it has keys, the later ones half."""
        wrong = min(0.5, 0.5 * count / max(1, others)) if not level else 0.5
        hashes = max(1, math.ceil(-math.log2(wrong)))
        return max(64, 64 * math.ceil(count * hashes / math.log(2) / 64)), hashes

    @staticmethod
    def _filter(keys: DataFrame, level: int, bits: int, hashes: int) -> Column:
        """The filter's bits as a constant array of longs (at most MAX_BITS)."""
        at = keys.select(F.explode(_positions(F.col("key"), level, bits, hashes)).alias("at"))
        words = at.select(F.shiftright("at", 6).alias("i"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("w"))
        every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
        merged = words.union(every).groupBy("i").agg(F.bit_or("w").alias("w"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"].cast("string"))
        return F.split(F.lit(merged.agg(F.array_join(ordered, ",")).first()[0]), ",").cast("array<bigint>")

    def _passes(self, key: Column, level: int) -> Column:
        words, bits, hashes = self.levels[level]
        return F.forall(_positions(key, level, bits, hashes), lambda at: F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level it fails decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self._passes(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return out


def rule_rows(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(key, verdict) of rules given as (host, path, verdict)."""
    rows = [F.struct(F.lit(h + p).alias("key"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def spam_hosts(pages: DataFrame, words: Sequence[str] = SPAM_WORDS) -> DataFrame:
    """(key): the corpus's hosts with one of the words in their name."""
    return with_parts(pages).select(F.col("host").alias("key")).where(F.col("key").rlike("|".join(words))).distinct()


def _in_shard(shard_of: Callable[[Column], Column], shard: int) -> Callable[[Column], Column]:
    return lambda k: shard_of(k["key"]) == shard


def judge(pages: DataFrame, rules: DataFrame, path_lengths: Sequence[int], hosts: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict): by the longest of ``rules`` (key,
    verdict; a key is a host and a path's beginning, ``path_lengths`` their
    lengths) that fits, else blocked if the host or a parent is in ``hosts`` (key)."""
    lengths = sorted({0, *path_lengths})
    parts = with_parts(pages)
    keys = parts.select(F.explode(keys_of(F.col("host"), F.col("path"), lengths)["key"]).alias("key")).distinct()
    allow = stash(rules.where("verdict = 'allow'").select("key").distinct(), "cascade-allow")
    block = stash(rules.where("verdict <> 'allow'").select("key").union(hosts.select("key")).distinct(), "cascade-block")
    flagged = keys
    for name, listed in (("allowed", allow), ("blocked", block)):
        flagged = flagged.join(few(listed.withColumn(name, F.lit(True))), "key", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    universe = stash(flagged, "cascade-universe")
    n = universe.agg(F.count_if("allowed").alias("a"), F.count_if("blocked").alias("b"), F.count("*").alias("n")).first()
    shards = max([1, *(-(-Cascade.size(c, n.n - c)[0] // max_bits) for c in (n.a, n.b) if c)])
    shard_of = lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards))
    found = parts
    for shard in range(shards):
        mine = universe if shards == 1 else stash(universe.where(shard_of(F.col("key")) == shard), "cascade-shard")
        allowed, blocked = Cascade(mine.select("key", F.col("allowed").alias("listed"))), Cascade(mine.select("key", F.col("blocked").alias("listed")))

        def marked(k: Column, allowed: Cascade = allowed, blocked: Cascade = blocked) -> Column:
            allows = allowed.holds(k["key"])
            return F.struct(F.length(k["key"]).alias("size"), (F.length(k["key"]) - k["n"]).alias("host_size"), k["n"].alias("n"), allows.alias("allows"), (~allows & blocked.holds(k["key"])).alias("blocks"), k["key"].alias("key"))

        keys = keys_of(F.col("host"), F.col("path"), lengths)
        if shards > 1:
            keys = F.filter(keys, _in_shard(shard_of, shard))
        hits = F.filter(F.transform(keys, lambda k: marked(k)), lambda x: x["allows"] | x["blocks"])
        if shard:
            hits = F.concat(F.col("hits"), hits)
        found = found.select("page_id", "host", "path", F.inline(F.array(F.struct(hits.alias("hits")))))
        if shard < shards - 1:  # the next shard's filters come into a plan of their own
            found = stash(found, "cascade-hits")
    rule = F.array_max(F.filter("hits", lambda x: x["n"] > 0))
    listed = F.exists("hits", lambda x: (x["n"] == 0) & x["blocks"])
    verdict = F.when(rule.isNotNull(), F.when(rule["allows"], "allow").otherwise("block")).when(listed, "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule["key"].alias("rule"), verdict.alias("verdict"))


JUDGE_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*', 0), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
         regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
),
rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
fits AS (
  SELECT DISTINCT page_id, host, path, h || p AS rule, v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
),
best AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM fits GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, b.rule,
       CASE WHEN b.rule IS NOT NULL THEN b.v WHEN regexp_matches(p.host, '{"|".join(SPAM_WORDS)}') THEN 'block' ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id AND p.host = b.host AND p.path = b.path
"""
