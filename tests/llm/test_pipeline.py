"""The pipeline's stages take effect, one after the other."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tracelab.llm import mixing, pieces, resampling, rules, secrets, simhash
from tracelab.llm.common import stash, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_dedup", "secret_scans", "mix_sources", "encode_pieces"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stash(stage(spark, docs, SF), name)
        kept.append(docs)
        if name != names[-1]:
            assert docs.columns == before.columns
    judged = rules.judge(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert {r.doc_id for r in kept[0].collect()} == {r.doc_id for r in judged.where("kept").collect()}
    groups = simhash.near_dedup(kept[0]).where("doc_id = component_id")
    assert {r.doc_id for r in kept[1].collect()} == {r.doc_id for r in groups.collect()}
    before = {r.doc_id: r.text for r in kept[1].collect()}
    assert {r.doc_id: r.text for r in kept[2].collect()} == {i: secrets.redacted(t) for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in kept[2].collect())
    times = {r.doc_id: r.taken // max(1, r.size) for r in mixing.mixture(kept[2]).collect()}
    assert {r.doc_id: r["count"] for r in kept[3].groupBy("doc_id").count().collect()} == {i: n for i, n in times.items() if n}
    v = pieces.Vocabulary.load(corpus_pipeline.MODEL_PATH)
    after = {r.doc_id: r.text for r in kept[3].collect()}
    cache = pieces.PartCache()
    assert all(r.ids == list(v.encode(after[r.doc_id], cache)) for r in kept[4].collect())
    assert corpus_pipeline.run(spark, SF).count() == kept[4].count()


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF), name)
    assert docs.agg(F.count("*")).first()[0] == 0


#: Names that operators use inside; documents may have columns of these names.
INSIDE = (
    "bad bucket cell copies copy data digest fp h held id ids is_target kept kept_h kept_id kept_row kept_rows label least mix_copies mix_source "
    "mix_source_size mix_target mix_threshold mix_times n_pieces n_words ranges root row score size t target threshold u uid whole words"
).split()


def test_stages_on_odd_rows(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été", "日本"]) + str(rng.randint(0, 400)) for _ in range(n))
    good = [prose(90) for _ in range(12)]
    near = good[0] + " tail"
    texts = [*enumerate(good), (50, good[1]), (50, good[1]), (51, near), (None, prose(80)), (None, prose(80)), (None, good[2])]
    texts += [(60, None), (61, ""), (62, " \n"), (63, "short"), (64, prose(30_000)), (65, prose(70) + " token=abcdefghijklmnop"), (None, None)]
    rows = [(i, t, None if n % 4 == 0 else f"s{n % 3}", *[f"{name}-{n}" for name in INSIDE]) for n, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in INSIDE))
    extra = {r[3]: r for r in rows}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, SF), name)
        assert docs.columns == before.columns
        kept[name] = docs.collect()
        for r in kept[name]:
            want = extra[r.bad]
            assert tuple(r)[3:] == want[3:] and (r.doc_id, r.source) == (want[0], want[2])
    # Nulls, empty and short texts fail the base test; whole texts pass, whatever their length.
    assert {r.doc_id for r in kept["quality_rules"]} <= {*range(12), 50, 51, None, 64, 65}
    assert len(kept["quality_rules"]) >= 15
    # One row of every class: copies, near copies and rows that repeat go, rows without ids stay apart.
    assert Counter(r.text for r in kept["simhash_dedup"]).most_common(1)[0][1] == 1
    assert sum(r.doc_id is None for r in kept["simhash_dedup"]) == sum(r.doc_id is None and r.text not in good for r in kept["quality_rules"])
    assert all("abcdefghijklmnop" not in r.text for r in kept["secret_scans"])
    assert {r.bad for r in kept["mix_sources"]} <= {r.bad for r in kept["secret_scans"]}
    last = stash(corpus_pipeline.STAGES[-1][1](spark, docs, SF), "encoded")
    assert last.columns == ["doc_id", "source", "ids", "n_pieces"] and last.count() == len(kept["mix_sources"])


def test_resampling_on_clashing_columns(spark):
    rows = [(i, f"clean plain prose {i}" if i < 20 else f"spam && junk {i}", *INSIDE) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in INSIDE))
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, quality int")
    assert resampling.resample(docs, labels).count() == 40
