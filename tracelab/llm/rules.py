"""Quality rules: a decision list learned by sequential covering.

Statistics of each text are Spark expressions.  From the labelled rows'
statistics a rule is grown condition by condition (threshold with the best
information gain, from counts by feature and bin that Spark aggregates),
pruned on held-out labelled rows, and its rows are removed before the next
rule.  The list is emitted as one conditional expression.

Defined cases: a null or empty text has no words, so it fails the base test
(fewer than 50 words) and is not kept; without labels of both kinds the list
is empty and the base test alone decides; labels that are null or belong to no
document are ignored, several for a document count as the lowest; repeated
rows are judged each; an empty table gives an empty result; other columns pass
through ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from math import log2
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import WORD, let, stash, words_of

#: Base test (fixed values of the contract).
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_punct")
#: What conditions test, from the statistics.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "upper_case": "n_upper / greatest(word_chars, 1)",
    "exclamations_a_word": "n_punct / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


def repeated(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the array.

    Windows are hashed; only texts in which a hash occurs twice go on.  Their
    hashes are sorted with the positions, and neighbours of equal hash count
    if their words are equal.  Short texts pack hash and position in one long,
    which sorts faster.
    """
    last = F.size(words) - width + 1
    same = lambda i, j: reduce(and_, (F.get(words, i + k) == F.get(words, j + k) for k in range(width)))

    def covered(hashes: Column) -> Column:
        packed = F.sort_array(F.transform(hashes, lambda x, i: x.bitwiseAND(F.lit(~0xFFFF).cast("long")).bitwiseOR(i.cast("long"))))
        pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        unpacked = F.transform(packed, lambda x: F.struct(F.shiftright(x, 16).alias("x"), x.bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int").alias("i")))
        tagged = F.when(F.size(hashes) <= 0x10000, unpacked).otherwise(pairs)

        def meets(s: Column, e: Column, j: Column) -> Column:
            other = F.get(s, j)
            return F.coalesce((other["x"] == e["x"]) & same(other["i"], e["i"]), F.lit(False))

        starts = let(tagged, lambda s: F.sort_array(F.transform(F.filter(s, lambda e, j: meets(s, e, j - 1) | meets(s, e, j + 1)), lambda e: e["i"])))
        steps = let(starts, lambda p: F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    hashes = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(last > 1, found).otherwise(F.lit(0))


def statistics(text: Column) -> Column:
    """Struct of STATISTICS of a text, all long."""
    t = F.coalesce(text, F.lit(""))
    length_of = lambda x, pattern: F.length(F.regexp_replace(x, pattern, "")).cast("long")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    word = let(
        words_of(t),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated(w).cast("long").alias("repeat")),
    )
    rare = let(
        F.regexp_replace(t, rf"[^{SYMBOLS}!?\p{{Lu}}]+", ""),
        lambda r: F.struct(length_of(r, f"[^{SYMBOLS}]+").alias("symbols"), length_of(r, r"[^\p{Lu}]+").alias("upper"), length_of(r, "[^!?]+").alias("punct")),
    )
    return let(
        F.struct(word.alias("w"), line.alias("l"), rare.alias("r")),
        lambda p: F.struct(
            p["w"]["n"].alias("n_words"),
            p["w"]["chars"].alias("word_chars"),
            p["r"]["symbols"].alias("n_symbols"),
            p["l"]["dup"].alias("n_dup_lines"),
            p["w"]["repeat"].alias("n_repeat_words"),
            p["r"]["upper"].alias("n_upper"),
            p["l"]["n"].alias("n_lines"),
            p["r"]["punct"].alias("n_punct"),
        ),
    )


def with_statistics(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and STATISTICS (generated once a row, not once a column)."""
    return docs.select(*columns, F.inline(F.array(statistics(F.col("text")))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    @property
    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def rule_sql(rule: Rule) -> str:
    return " AND ".join(f"({c.sql})" for c in rule)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """What a condition gains in information about the rows to reject (FOIL)."""
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def _best(counts: list, cuts: dict[str, list[float]], p0: int, n0: int) -> tuple[float, Condition | None]:
    """The best threshold from counts (feature, bin, bad, good); bin b holds values in (cut b-1, cut b]."""
    best: tuple[float, Condition | None] = (0.0, None)
    names = list(FEATURES)
    for f, name in enumerate(names):
        bins = {r.b: (r.bad, r.good) for r in counts if r.f == f}
        p = n = 0
        for b, cut in enumerate(cuts[name]):
            p, n = p + bins.get(b, (0, 0))[0], n + bins.get(b, (0, 0))[1]
            for above, (x, y) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                best = max(best, (_gain(x, y, p0, n0), Condition(name, above, cut)), key=lambda v: v[0])
    return best


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda t: value > t))


def learn(labelled: DataFrame, bins: int = 32, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.95, min_rows: int = 3) -> list[Rule]:
    """``labelled``: STATISTICS and ``bad`` (boolean), with ``held`` (boolean) for
    the pruning rows.  Rules that tell rows to reject, in order.

    The driver only sees counts by feature and bin, and by prefix of a rule.
    """
    rows = labelled.select("bad", "held", *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    points = [i / bins for i in range(1, bins)] + [0.98, 0.99, 0.995]
    got = rows.agg(*[F.percentile_approx(f, sorted(points), 10_000).alias(f) for f in FEATURES]).first()
    # Cuts lie halfway between neighbouring quantiles, as far from rows of either kind as may be.
    cuts = {f: [(a + b) / 2 for a, b in pairwise(sorted(set(got[f] or [])))] for f in FEATURES}
    if not any(cuts.values()):
        return []
    cells = [F.struct(F.lit(i).alias("f"), _bin(F.col(f), cuts[f]).alias("b")) for i, f in enumerate(FEATURES)]
    rows = stash(rows.withColumn("cells", F.array(*cells)), "rules-cells")
    fires = lambda c: (F.col(c.feature) > c.threshold) if c.above else (F.col(c.feature) <= c.threshold)
    bad, good = F.sum(F.col("bad").cast("int")).alias("bad"), F.sum((~F.col("bad")).cast("int")).alias("good")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grown: list[Condition] = []
        while len(grown) < max_conditions:
            inside = rows.where("NOT held")
            for c in grown:
                inside = inside.where(fires(c))
            counts = inside.select("bad", F.inline("cells")).groupBy("f", "b").agg(bad, good).collect()
            p0, n0 = sum(r.bad for r in counts if r.f == 0), sum(r.good for r in counts if r.f == 0)
            if not p0 or not n0:
                break
            gain, c = _best(counts, cuts, p0, n0)
            if c is None or gain <= 0:
                break
            grown.append(c)
        if not grown:
            break
        # Prune: the prefix that tells held-out rows apart best.
        held, so_far, parts = rows.where("held"), F.lit(True), []
        for i, c in enumerate(grown):
            so_far = so_far & fires(c)
            parts += [F.count_if(so_far & F.col("bad")).alias(f"p{i}"), F.count_if(so_far & ~F.col("bad")).alias(f"n{i}")]
        r = held.agg(*parts).first()
        worth = [((r[f"p{i}"] - r[f"n{i}"]) / max(1, r[f"p{i}"] + r[f"n{i}"]), -i) for i in range(len(grown))]
        k = -max(worth)[1]
        p, n = r[f"p{k}"], r[f"n{k}"]
        if p < min_rows or p < min_precision * (p + n):
            break
        rule = tuple(grown[: k + 1])
        rules.append(rule)
        for i, c in enumerate(rule):
            covered = fires(c) if i == 0 else covered & fires(c)
        rows = rows.where(~covered)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression over STATISTICS: the first rule that fires, else null."""
    out = F.lit(None).cast("string")
    for i, rule in reversed(list(enumerate(rules))):
        out = F.when(F.expr(rule_sql(rule)), F.lit(f"{i + 1}: " + " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule))).otherwise(out)
    return out


def labelled_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics (doc_id, ...) of labelled rows that pass the base test; a third is held for pruning."""
    by_id = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("labelled_id")).agg((F.min("quality") == 0).alias("bad"))
    rows = stats.where(~base_failed()).join(by_id, stats["doc_id"] == by_id["labelled_id"])
    return rows.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).drop("labelled_id")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS, base_failed, kept, rule) of every document row."""
    stats = stash(with_statistics(docs, "doc_id"), "rules-stats")
    rules = learn(labelled_rows(stats, labels))
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that base test and rules keep.  Every row is written once
    beside its statistics; the rules are learned from these and judge them, so no
    statistic is taken twice and no text is shuffled."""
    columns = [docs[c] for c in docs.columns]
    held = stash(docs.select(F.struct(*columns).alias("kept_row"), F.inline(F.array(statistics(docs["text"])))), "rules-rows")
    rules = learn(labelled_rows(held.withColumn("doc_id", F.col("kept_row.doc_id")).drop("kept_row"), labels))
    rejected = F.coalesce(base_failed(), F.lit(True)) | verdict(rules).isNotNull()
    return held.where(~rejected).select("kept_row.*")
