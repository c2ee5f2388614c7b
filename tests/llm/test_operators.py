"""Training-data operators against brute force, and their defined cases."""

import hashlib
import random
import re
import tracemalloc
import zlib
from array import array
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelab.llm import lm, mixing, pieces, queries, resampling, rules, secrets, simhash, suffix_dedup, topk, url_filter

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n_words long, t string"


def docs_of(spark, texts, extra=True):
    """Documents with clashing extra columns."""
    rows = [(i, t, f"s{i % 3}" if i and i % 4 else None, -1, "clash") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "日本", "a&b", "##", "WAIT!"]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, base = prose(60), prose(200)
    out = [None, "", " \t\n", "one", "two words", "X y\nX y\nz", shared, shared, f"{prose(30)} {shared}\n{prose(40)}", base, base.replace("w1 ", "w2 ", 1), base + " tail", prose(3000), "a" * 250, "\u3000 not \u00a0 spaces"]
    return list(enumerate(out)) + [(7, shared), (None, shared), (None, None)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.select(*cols)) == sorted(want.fetchall(), key=repr)


def test_mixing_cases(spark, texts):
    docs = docs_of(spark, texts)
    got = mixing.mixture(docs).collect()
    assert len(got) == len(texts)
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in got)
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(t or "")) for _, t in texts)
    assert rows_of(mixing.mixture(docs)) == rows_of(mixing.mixture(docs.repartition(7)))
    assert sum(r.taken for r in got) == sum(len(WORD.findall(r.text or "")) for r in mixing.mix(docs).collect())
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_url_cases(spark):
    urls = [None, "", "no scheme", "HTTP://A.Net/x", "http://net/", "http://a.net", "x://b.example.net/en/1?q#f", "https://example.com/de/", "https://example.com/de", "http://q.org/fr/ü", "http://cheap-pills.org/", "http://sub.cheap-pills.org?x"]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)], "page_id long, url string, host string").union(spark.createDataFrame([(3, urls[3], "h")], "page_id long, url string, host string"))
    ask = lambda p: url_filter.judge(p, url_filter.rule_rows(spark), [len(r[1]) for r in url_filter.RULES], url_filter.spam_hosts(p))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in ask(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.net", "/x", "net/", "block")
    assert got[5] == ("a.net", "", None, "allow")
    assert got[6] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert got[7][2:] == ("example.com/de/", "block") and got[8][2:] == (None, "allow")
    assert got[9][2:] == ("org/fr/", "allow")
    assert got[10][3] == got[11][3] == "block"
    assert ask(pages).count() == 13 and ask(pages.limit(0)).count() == 0


def test_url_filter_in_shards(spark):
    """A list that is too long for one filter is judged shard by shard, with the same verdicts."""
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h"), F.col("id") % 90, F.lit(".site"), F.col("id") % 7, F.lit(".info/en/x")).alias("url"))
    hosts = spark.range(60).select(F.concat(F.lit("h"), F.col("id") * 2, F.lit(".site"), F.col("id") % 7, F.lit(".info")).alias("key")).union(spark.range(1).select(F.lit("site3.info")))
    ask = lambda **kw: rows_of(url_filter.judge(pages, url_filter.rule_rows(spark), [1, 4], hosts, **kw))
    one = ask()
    assert ask(max_bits=128) == one and len(one) == 400
    listed = {r.key for r in hosts.collect()}
    assert all((verdict == "block") == (host in listed or host.endswith(".site3.info")) for _, host, _, _, verdict in one)
    assert 57 < sum(r[4] == "block" for r in one) < 200


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 37 == 0).alias("listed"))
    c = url_filter.Cascade(keys)
    assert len(c.levels) > 1
    assert keys.where(c.holds(F.col("key")) != F.col("listed")).count() == 0


def brute_spans(text):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))


def test_secret_spans():
    rng = random.Random(3)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", ": ", "=", '"', "é", "日", " ", "AKIA", "ABCDEFGHIJ0123", "0123456789abcdef", "deadbeef", "Zz9+/=_.-", "\n"]
    for _ in range(600):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [x for x in secrets.find_spans(t.encode()) if x[1] in secrets.BASE_KINDS] == brute_spans(t), repr(t)
    body = "a1B2" * 7 + "xy"
    good = f"é ghp_{body}{secrets.base62_crc32(body)} end"
    assert [x[1] for x in secrets.find_spans(good.encode())] == ["github"]
    assert not secrets.find_spans(good.replace("ghp_a", "ghp_b").encode())
    assert secrets.redacted(good) == "é [secret] end"


def test_secret_cases(spark, texts):
    docs = docs_of(spark, [*texts, (90, "token=abcdefghijklmnop")])
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert got[90].n_assign == 1 and got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in clean.collect()}[90] == "[secret]"
    assert secrets.scan(docs.limit(0)).count() == 0


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 340)]
    bad = [(400, None), (450, [float("nan")] + [0.0] * 7), (500, [None] * 8), (None, [1.0] * 8), (550, [1.0]), (50, vecs[50][1])]
    df = spark.createDataFrame(vecs + bad, "vec_id long, embedding array<float>")
    v = topk.integers(df)
    got = rows_of(topk.search(v, v.where("vec_id % 50 = 0"), cells=16, block_bytes=200))
    assert got == rows_of(topk.search(v, v.where("vec_id % 50 = 0")))
    whole = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in [*vecs, (550, [1.0]), (50, vecs[50][1])]]
    want = []
    for q, a in {i: a for i, a in whole if i % 50 == 0}.items():
        best = sorted(((-int(a @ b), i) for i, b in whole if i != q and len(a) == len(b)))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want, key=repr)
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


def test_topk_reads_few_exact_vectors(spark):
    """The bounds leave few candidates, also where a third of the rows are one vector."""
    rng = np.random.default_rng(3)
    data = rng.normal(0, 0.2, (3000, 16)) + rng.normal(0, 1, (10, 16))[rng.integers(0, 10, 3000)]
    vecs = [(i, data[i].tolist() if i % 3 else [1.0] * 16) for i in range(3000)]
    v = topk.integers(spark.createDataFrame(vecs, "vec_id long, embedding array<float>")).repartition(4)
    distinct, cells, lo, hi = topk.va_file(v, 5)
    assert distinct.count() == cells.count() == 2001
    assert [len(r.ids) for r in distinct.where("size(ids) > 1").collect()] == [6]
    q = np.floor(256 * np.array(vecs[1][1], np.float32).astype(float))[None]
    queries = {16: (np.array([1]), q)}
    left = cells.coalesce(1).mapInArrow(lambda b: topk._bounded(b, queries, lo, hi, topk.CELLS, 5), "query_id long, uid long, low double, high double").collect()
    assert 5 <= len(left) < 200
    got = rows_of(topk.search(v, v.where("vec_id % 500 = 0")))
    whole = np.floor(256 * np.array([x for _, x in vecs], np.float32).astype(float)).astype(int)
    want = [(i, r + 1, j, -s) for i in range(0, 3000, 500) for r, (s, j) in enumerate(sorted((-int(whole[i] @ whole[j]), j) for j in range(3000) if j != i)[:5])]
    assert got == sorted(want, key=repr)


def brute_dedup(rows):
    first = {}
    for d, t in rows:
        b, k = (t or "").encode(), suffix_dedup.LAST_ID if d is None else d
        for p in range(len(b) - 99):
            first[b[p : p + 100]] = min(first.get(b[p : p + 100], (k, p)), (k, p))
    out = []
    for d, t in rows:
        b, k = (t or "").encode(), suffix_dedup.LAST_ID if d is None else d
        cov = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] != (k, p):
                cov[p : p + 100] = b"\1" * 100
        kept = bytes(x for x, c in zip(b, cov) if not c)
        out.append((d, len(b), sum(cov), sum(c and (not i or not cov[i - 1]) for i, c in enumerate(cov)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 0])
def test_suffix_dedup(spark, texts, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(8)
    passage = "".join(rng.choice("abc é") for _ in range(400))
    more = [(20 + i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 90))) + passage[rng.randint(0, 150) : rng.randint(240, 400)] + "q" * rng.randint(0, 130)) for i in range(40)]
    docs = docs_of(spark, [*texts, *more])
    got = rows_of(suffix_dedup.dedup(docs).drop("kept"))
    assert got == brute_dedup([*texts, *more])
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def test_suffix_dedup_many_texts_of_one_id(spark):
    rng = random.Random(14)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(130)) for _ in range(900)]
    unlike = lambda: "".join(rng.choice("stuvwxyz") for _ in range(rng.randint(0, 60)))
    rows = [(i, x) for i, x in enumerate(passages)] + [(None if i % 2 else 5000, unlike() + x + unlike()) for i, x in enumerate(passages * 4)]
    rng.shuffle(rows)
    assert rows_of(suffix_dedup.dedup(docs_of(spark, rows)).drop("kept")) == brute_dedup(rows)


def test_suffix_sort_orders_suffixes():
    rng = random.Random(2)
    text = np.frombuffer("".join(rng.choice("ab") for _ in range(1200)).encode(), np.uint8)
    at = np.array(rng.sample(range(1000), 300))
    group = np.repeat([0, 1, 2], 100)
    order = suffix_dedup.suffix_sort(text, suffix_dedup.PrefixHashes(text), at, group)
    raw = text.tobytes()
    for g in range(3):
        part = at[order[100 * g : 100 * g + 100]]
        assert [raw[p : p + 100] for p in part] == sorted(raw[p : p + 100] for p in at[100 * g : 100 * g + 100])


def brute_stats(t):
    t = t or ""
    words = WORD.findall(t)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_rule_statistics(spark, texts):
    rng = random.Random(4)
    more = [(100 + i, "".join(rng.choice(["a", "b", " ", " ", "\n", "é#", "\t", "\u00a0", "a b c "]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    more.append((999, "r s t " * 23_000))  # over the packed size
    rows = [*texts, *more]
    got = rules.with_statistics(docs_of(spark, rows).drop("n_words"), "doc_id").select("doc_id", *rules.STATISTICS[:5]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *brute_stats(t)) for i, t in rows), key=repr)


def test_rules_learn_and_keep(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = [(i, " ".join(word() for _ in range(80))) for i in range(120)]
    bad = [(1000 + i, " ".join(word() + "&&" for _ in range(80))) for i in range(60)]
    docs = docs_of(spark, [*good, *bad, (5000, None), (5001, "short"), (0, good[0][1])])
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:90]] + [(i, 0) for i, _ in bad[:45]] + [(None, 0), (7, None), (123456, 0)], "doc_id long, quality int")
    got = rules.judge(docs, labels)
    assert {r.doc_id for r in got.where("kept").collect()} == {i for i, _ in good}
    assert got.where("base_failed").count() == 2
    kept = rules.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 121
    assert rules.keep(docs, labels.limit(0)).count() == 181
    assert rules.judge(docs.limit(0), labels).count() == 0


def test_lm_scores(spark, texts, monkeypatch):
    rows = [*texts, *[(200 + i, "the cat sat on the mat " * 5) for i in range(30)]]
    docs = docs_of(spark, rows)
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: (t or "").encode().lower().split()
    c = Counter(w for i, t in rows if not fold(i) for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*tokens(t), None])
    want = sorted(((i, fold(i), len(tokens(t)) + 1, sum(c[w] > 0 for w in [*tokens(t), None]), n, round(base(t), 6)) for i, t in rows), key=repr)
    counts, fit = lm.fitted(docs, frequent=10, classes_wanted=16)
    monkeypatch.setattr(lm, "fitted", lambda *_: (counts, fit))
    got = lm.score(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    # The model token by token: softmax over the classes, then the word's share of its class.
    classes, m = fit["classes"], fit["model"]
    context, word = m.context.astype(float), m.word.astype(float)
    known = {w: int(classes.of[i]) for w, i in classes.known.items()}
    assert len(set(known.values())) < len(known)  # some words share a class
    of = lambda w: lm.END if w is None else known.get(w, classes.first_hashed + zlib.crc32(w) % classes.hashed)
    total, kinds = Counter(), Counter()
    for w, k in c.items():
        total[of(w)] += k
        kinds[of(w)] += 1

    def brute(text):
        h1 = h2 = lm.END
        out = 0.0
        for w in [*tokens(text), None]:
            z = word @ (context[h1] * m.position[0] + context[h2] * m.position[1]) + m.bias
            k = of(w)
            out += (z[k] - np.log(np.exp(z).sum())) / np.log(10)
            if w is not None:
                out += log10(c[w] / total[k]) if w in known else log10((c[w] + 0.5) / (total[k] + 0.5 * (kinds[k] + 1)))
            h1, h2 = k, h1
        return out

    key = lambda i, x: (-1 if i is None else i, x)
    have, want = sorted(key(r.doc_id, r.score) for r in got), sorted(key(i, brute(t)) for i, t in rows)
    assert [i for i, _ in have] == [i for i, _ in want]
    assert np.allclose([x for _, x in have], [x for _, x in want], rtol=1e-5, atol=1e-3)
    monkeypatch.undo()
    assert lm.score(docs.limit(0)).count() == 0
    model = lm.Model.start(np.full(9, 1 / 9))
    first, second, z = lm.tables(model)
    assert np.allclose(np.exp(first[3] + second[5] - z[3, 5]).sum(), 1, atol=1e-5)


def test_lm_most_frequent_is_bounded(spark):
    rows = [(f"w{i}".encode(), 1 if i >= 40 else 1000 - i) for i in range(6000)] + [(b"x" * 65, 10**6)]
    counts = spark.createDataFrame(rows, "w binary, c long").repartition(7)
    got = [(bytes(r.w), r.c) for r in lm.most_frequent(counts, 500)]
    assert got[:40] == sorted(rows[:40], key=lambda r: -r[1]) and 450 < len(got) <= 500 and len(set(got)) == len(got)
    assert len(lm.most_frequent(counts, 10)) <= 10
    assert len(lm.most_frequent(counts, 9000)) == 6000
    assert lm.most_frequent(counts.limit(0), 10) == []


def test_lm_learns_order():
    rng = np.random.default_rng(0)
    share = np.r_[0.02, 0.02, np.full(8, 0.12)]
    seq = np.arange(40_000) % 8 + 2  # each class follows one other
    seq = np.where(rng.random(len(seq)) < 0.1, rng.integers(2, 10, len(seq)), seq)
    t = lm.Trainer(lm.Model.start(share), share, 1)
    for at in range(2, 36_000, 500):
        w = np.arange(at, at + 500)
        t.step(seq[w - 1], seq[w - 2], seq[w])
    first, second, z = lm.tables(t.model)
    w = np.arange(36_500, 39_900)
    held = (first[seq[w - 1], seq[w]] + second[seq[w - 2], seq[w]] - z[seq[w - 1], seq[w - 2]]).mean()
    assert held > np.log(share[seq[w]]).mean() + 0.8


def test_lm_step_keeps_its_arrays():
    size, rng = 300, np.random.default_rng(5)
    share = rng.random(size) + 0.1
    share /= share.sum()
    t, plain = (lm.Trainer(lm.Model.start(share), share, 7) for _ in range(2))
    model, sums = plain.model, plain.sums
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for n in (2048, 2048, 50, 1, 700):
        h1, h2, w = rng.integers(0, size, (3, n)).astype(np.uint16)
        # The step as it is defined, pair by pair in doubles.
        noise = np.minimum(np.searchsorted(plain.cum, plain.rng.random(lm.NOISE) * plain.cum[-1]), size - 1)
        c, v, p, b = (x.astype(float) for x in (model.context, model.word, model.position, model.bias))
        guess = c[h1] * p[0] + c[h2] * p[1]
        right = (1 - sigmoid((guess * v[w]).sum(1) + (b - plain.base)[w])) / n
        wrong = sigmoid(guess @ v[noise].T + (b - plain.base)[noise]) / n
        toward = right[:, None] * v[w] - wrong @ v[noise]
        moves = [np.zeros_like(x) for x in (c, v, p, b)]
        np.add.at(moves[0], h1, toward * p[0])
        np.add.at(moves[0], h2, toward * p[1])
        np.add.at(moves[1], w, right[:, None] * guess)
        np.subtract.at(moves[1], noise, wrong.T @ guess)
        moves[2][:] = (toward * c[h1]).sum(0), (toward * c[h2]).sum(0)
        np.add.at(moves[3], w, right)
        np.subtract.at(moves[3], noise, wrong.sum(0))
        for x, s, g in zip((model.context, model.word, model.position, model.bias), (sums.context, sums.word, sums.position, sums.bias), moves, strict=True):
            s += g * g
            x += lm.RATE * g / np.sqrt(s)
        t.step(h1, h2, w)
        assert np.allclose(t.model.flat(), model.flat(), atol=2e-3)
    t.step(*rng.integers(0, size, (3, 2048)).astype(np.uint16))
    batch = rng.integers(0, size, (3, 2048)).astype(np.uint16)
    tracemalloc.start()
    t.step(*batch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 600_000  # arrays of a batch are not made anew: 2 MB and more before


def test_lm_encodes_texts_once(spark):
    texts = ["", "  The cat\x0b\x0csat on\x1cthe mat\x85 \u00c9T\u00c9 \u00e9t\u00e9 ", None, " \n", "cat cat CAT the unknown cat unknown new"]
    docs = docs_of(spark, list(enumerate(texts * 3)))
    counts, fit = lm.fitted(docs, frequent=3, classes_wanted=8)
    classes, got = fit["classes"], fit["texts"].collect()
    assert {"ids", "rare", "sums"} <= set(fit["texts"].columns) and len({r.uid for r in got}) == len(got) == 15
    weights = np.log10((fit["count"] + 0.5) / lm.smoothed_total(fit["n"], fit["v"])), lm.inner(classes, fit["count"])
    for r in got:
        words = (texts[r.doc_id % 5] or "").encode().lower().split()
        at, of = classes.places(words)
        assert np.frombuffer(bytes(r.ids), lm.IDS).tolist() == [lm.END, lm.END, *of.tolist(), lm.END]
        assert r.n_found == (at >= 0).sum() and np.allclose(r.sums, [x[at[at >= 0]].sum() for x in weights])
        assert {bytes(x.w): x.k for x in r.rare} == Counter(w for w, i in zip(words, at, strict=True) if i < 0)


def test_lm_trains_on_every_position(spark):
    rng = random.Random(3)
    chain = lambda at, n: " ".join(f"w{(at + i) % 12}" for i in range(n))
    docs = docs_of(spark, [(i, chain(rng.randrange(12), 60)) for i in range(500)])
    held = lm.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (held[0] - held[1]) / held[2] > 0.5  # each word follows one other
    training = lm.fold(docs).where("NOT held_out").select("t")
    classes = lm.Classes.deal([f"w{i}".encode() for i in range(12)], np.full(12, 9.0), 0, 26)
    _, positions = lm.train(training, classes, np.full(classes.size, 1 / classes.size), rounds=1)
    assert positions == training.count() * 61


def test_lm_classes_hold_every_word():
    words, counts = [f"w{i}".encode() for i in range(500)], 1000.0 / np.arange(1, 501)
    for wanted in (2, 3, 8, 64, 200, 2048):
        c = lm.Classes.deal(words, counts, 4000.0, wanted)
        at, of = c.places([*words, b"never seen", b"w3"])
        assert of.min() >= 1 and of.max() < c.size <= max(wanted, 3) and c.hashed >= 1
        assert (at[-2], of[-1]) == (-1, of[3]) and c.first_hashed <= of[-2]
        assert (np.diff(c.of) >= 0).all() and set(range(1, c.first_hashed)) == set(c.of.tolist())
    assert lm.Classes.deal([], np.zeros(0), 0.0, 64).size == 64
    assert lm.classes_for(0) == lm.LEAST_CLASSES < lm.classes_for(10_000) < lm.classes_for(10**9) == lm.MOST_CLASSES


def test_pieces_best_path():
    v = pieces.Vocabulary.load(MODEL)
    ids = {v.pieces[i]: i for i in v.normal}

    def best(s):
        top = [0.0] + [None] * len(s)
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + 17) + 1):
                got = v.scores[ids[s[i:j]]] if s[i:j] in ids else v.lowest if j == i + 1 else None
                if got is not None and (top[j] is None or top[i] + got > top[j]):
                    top[j] = top[i] + got
        return top[-1]

    rng = random.Random(9)
    cache = pieces.PartCache()
    for _ in range(300):
        t = "".join(rng.choice(["the ", "ing", "é", "日本", "\n", "  ", "x", "Ünder", "\U0001f600", "12"]) for _ in range(rng.randint(1, 12)))
        path = v.best_path(("▁" + t.replace(" ", "▁")).encode())
        at, total = 0, 0.0
        while at < len(path):
            if v.kinds[path[at]] == "byte":
                lead = int(v.pieces[path[at]][3:5], 16)
                at, total = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4), total + v.lowest
            else:
                at, total = at + 1, total + v.scores[path[at]]
        assert abs(total - best("▁" + t.replace(" ", "▁"))) < 1e-6 * abs(total) + 1e-6
        assert v.decode(v.encode(t, cache)) == t
        parts = v.encode(t, cache)
        assert abs(sum(v.scores[i] for i in parts if v.kinds[i] == "normal") - sum(v.scores[i] for i in path if v.kinds[i] == "normal")) < 1e-3


def test_pieces_found_together():
    """The search over many parts gives each part's own best path, with and without byte pieces."""
    rng = random.Random(10)
    v = pieces.Vocabulary.load(MODEL)
    plain = pieces.Vocabulary(v.pieces, v.scores, ["control" if k == "byte" else k for k in v.kinds])
    parts = ["".join(rng.choice(["▁", "the", "ing", "é", "日本", "\n", "x", "Ü", "\U0001f600", "12", "q", "ation"]) for _ in range(rng.randint(1, 25))).encode() for _ in range(1500)]
    for each in (v, plain):
        assert each.best_paths(parts) == [array("i", each.best_path(p)).tobytes() for p in parts]
    texts = [" ".join(rng.choice(["the", "Ünder", "x" * 300, "日本", "\t", "a▁b"]) for _ in range(40)) for _ in range(30)] + [None, "", " "]
    cache = pieces.PartCache()
    got = v.packed(texts, cache)
    assert got == v.packed(texts, cache) and got[-3:-1] == [None, b""]  # searched, then from the cache
    for t, ids in zip(texts[:-3], got):
        want = [i for p in v.part.findall(" " + t.replace("▁", " ")) for i in v.best_path(p.replace(" ", "▁").encode())]
        assert ids == array("i", want).tobytes()


def test_pieces_cases(spark, texts):
    v = pieces.Vocabulary.load(MODEL)
    docs = docs_of(spark, [*texts, (91, "a▁b")])
    got = {(r.doc_id, r.n_pieces): r for r in pieces.round_trip(docs, v).collect()}
    assert got[0, None].ids is None and got[1, 0].ids == []
    assert all(r.round_trip for k, r in got.items() if k[0] not in (0, None, 91))
    enc = pieces.encode(docs, v)
    assert enc.columns == [*docs.columns, "ids", "n_pieces"]
    back = {(r.doc_id, r.text): r.decoded for r in pieces.decode(enc, v).collect()}
    assert back[0, None] is None and back[91, "a▁b"] == "a b" and all(k[1] == d for k, d in back.items() if k[0] != 91)
    assert pieces.round_trip(docs.limit(0), v).count() == 0


def test_resampling(spark, texts):
    rng = random.Random(7)
    values = [rng.choice([rng.gauss(0, 1), 0.5, -1e9, 3e8]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in values], "score double")
    for k in (1, 2, 700, 1500, 2999, 3000):
        assert resampling.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    docs = docs_of(spark, [*texts, *[(300 + i, "clean plain prose " * 9) for i in range(30)], *[(400 + i, "spam && junk " * 9) for i in range(30)]])
    labels = spark.createDataFrame([(300 + i, 1) for i in range(20)] + [(400 + i, 0) for i in range(20)], "doc_id long, quality int")
    got = {r.doc_id: r for r in resampling.resample(docs, labels, share=0.5).collect()}
    assert all(got[300 + i].sampled for i in range(30)) and not any(got[400 + i].sampled for i in range(30))
    assert got[0].log_ratio == 0 and got[0].n_features == 0
    assert resampling.resample(docs, labels.limit(0)).where("sampled").count() == docs.count()
    assert resampling.resample(docs.limit(0), labels).count() == 0


def brute_fingerprint(t):
    words = (t or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, radius=3):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fs}


def test_simhash_cases(spark, texts):
    docs = docs_of(spark, texts)
    got = rows_of(simhash.near_dedup(docs))
    fp = [(i, brute_fingerprint(t)) for i, t in texts]
    comp = brute_components({f for _, f in fp})
    least = {}
    for i, f in fp:
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    assert got == sorted(((i, f"{f:016x}", least.get(comp[f])) for i, f in fp), key=repr)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def test_simhash_keeps_one_row_of_every_class(spark):
    rng = random.Random(12)
    prose = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(80))
    a, b, c, d, e, f = (prose() for _ in range(6))
    rows = [(None, a), (None, a), (None, b), (None, c), (1, c), (2, d), (2, e), (2, e), (3, f), (4, f)]
    got = rows_of(simhash.keep_one(docs_of(spark, rows)).select("doc_id", "text"))
    assert got == sorted([(None, a), (None, b), (1, c), (2, d), (2, e), (3, f)], key=repr)
    only = docs_of(spark, [(None, a), (1, b), (None, b)])  # one class of null ids
    assert rows_of(simhash.keep_one(only).select("doc_id", "text")) == sorted([(None, a), (1, b)], key=repr)


@pytest.mark.parametrize("bucket_rows", [20_000, 8])
def test_simhash_links(spark, bucket_rows):
    rng = random.Random(11)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(f)
            f ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3))) & (2**64 - 1)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    marked = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(sorted(fps))], "doc_id long, fp long")
    comp = brute_components(fps)
    ids = {f: i for i, f in enumerate(sorted(fps))}
    want = {signed(f): min(ids[g] for g in fps if comp[g] == comp[f]) for f in fps}
    assert {r.fp: r.component_id for r in simhash.classes(marked, 3, bucket_rows).collect()} == want


def test_resampling_against_brute_force(spark, texts):
    rows = [*texts, *[(300 + i, "clean plain prose " * (i % 9 + 1)) for i in range(30)], *[(400 + i, f"spam && junk {i} " * 5) for i in range(30)]]
    labels = [(300 + i, 1) for i in range(20)] + [(400 + i, 0) for i in range(20)]
    got = resampling.resample(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), share=0.4).collect()
    mask, top = (1 << 64) - 1, resampling.BUCKETS

    def buckets(t):
        one = [zlib.crc32(w) for w in (t or "").encode().lower().split()]
        mixed = [x * 0x9E3779B97F4A7C15 & mask for x in one]
        mixed += [((a * 0x9E3779B97F4A7C15 & mask) + b) * 0xC2B2AE3D27D4EB4F & mask for a, b in zip(one, one[1:])]
        return [x >> 48 for x in mixed]

    raw = Counter(b for _, t in rows for b in buckets(t))
    target = Counter(b for i, t in rows if i in range(300, 320) for b in buckets(t))
    n_raw, n_target = sum(raw.values()) + top, sum(target.values()) + top
    ratio = lambda t: sum(np.log((target[b] + 1) / n_target) - np.log((raw[b] + 1) / n_raw) for b in buckets(t))

    def noise(i, t):
        h = 42
        for x in ([] if i is None else [i.to_bytes(8, "little", signed=True)]) + ([] if t is None else [t.encode()]):
            h = xxhash.xxh64_intdigest(x, seed=h)
        return -np.log(-np.log(((h >> 12) + 0.5) / 2**52))

    want = sorted(((i, len(buckets(t)), ratio(t), ratio(t) + noise(i, t)) for i, t in rows), key=lambda r: (repr(r[0]), r[3]))
    have = sorted(((r.doc_id, r.n_features, r.log_ratio, r.score) for r in got), key=lambda r: (repr(r[0]), r[3]))
    assert [r[:2] for r in have] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in have], [r[2:] for r in want])
    least = sorted((r[3] for r in want), reverse=True)[round(0.4 * len(rows)) - 1]
    assert [r.sampled for r in got] == [r.score >= least - 1e-9 for r in got]
