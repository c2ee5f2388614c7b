"""Decontamination, whitening and fill-in-middle against brute force, and their defined cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from tracelab.llm import decontaminate, fill_middle, spectrum, whitening

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- fill-in-middle -----------------------------------------------------------


@pytest.mark.parametrize(
    ("offsets", "kinds"),
    [
        (range(0, 500_000, 97), {"Array"}),
        (range(0, 300_000, 3), {"Bitmap"}),
        (range(70_000), {"Runs"}),
        ([*range(0, 9), 65_535, 65_536, 131_071, 131_072, *range(200_000, 260_000), *range(400_000, 450_000, 2)], {"Array", "Bitmap", "Runs"}),
    ],
)
def test_boundary_set_selects(offsets, kinds):
    offsets = np.array(list(offsets), np.int64)
    held = fill_middle.BoundarySet(offsets)
    assert {type(c).__name__ for c in held.containers} >= kinds
    ks = {0, 1, len(offsets) - 1, *np.random.default_rng(1).integers(0, len(offsets), 2000).tolist()}
    assert all(held.select(k) == offsets[k] for k in ks) and len(held) == len(offsets)


def brute_cut(doc_id, text):
    t = text or ""
    tokens = TOKEN.findall(t)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(t)


def test_fill_middle_against_brute_force(spark):
    rng = random.Random(7)
    parts = ["word", "É", "日本", " ", "\n", "<", ">", "S>", "<P", "9", "😀", "aB", "."]
    texts = [None, "", "x", "<P>", "a<S>b", "é<M>", "a" * 70_000, "".join(rng.choice(parts) for _ in range(120_000)), "1" * 66_000 + "é" * 5]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "a b c"), (8, texts[8]), (8, texts[8])]
    docs = spark.createDataFrame([(i, t, "n", "form") for i, t in rows], "doc_id long, text string, n string, output string")
    got = fill_middle.digests(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_cut(i, t) for i, t in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and all(r.restored_sha256 is not None for r in got)
    assert fill_middle.digests(docs.limit(0)).count() == 0


# --- whitening ------------------------------------------------------------------


def spd(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize(
    "values",
    [np.arange(1.0, 41), 10.0 ** -(np.arange(40) / 4), np.r_[np.ones(15), np.full(15, 0.5), np.full(10, 0.1)], 1 + np.arange(40) * 1e-12, np.r_[np.arange(1.0, 9), np.zeros(32)]],
)
def test_contour_integration_finds_all(values):
    a = spd(values)
    want = np.linalg.eigvalsh(a)[::-1]
    floor = len(a) * spectrum.ROUNDING * np.abs(a).sum(1).max()
    e, v = spectrum.largest(a, 20, floor)
    k = min(20, int((want > floor).sum()))
    assert len(e) == k and np.abs(e - want[:k]).max() < 1e-13 * want[0]
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-12 and np.abs(a @ v - v * e).max() < 1e-12 * want[0]


def test_inertia_counts():
    rng = np.random.default_rng(2)
    for _ in range(20):
        m = rng.normal(size=(13, 13))
        a = m + m.T
        e = np.linalg.eigvalsh(a)
        for shift in (*((e[1:] + e[:-1]) / 2), e[0] - 1, e[-1] + 1):
            assert spectrum.count_above(a, shift) == (e > shift).sum()
    assert spectrum.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, n int")


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    data = (rng.normal(size=(400, 40)) @ rng.normal(size=(40, 40)) + 3).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(data)] + [(7, data[7].tolist()), (None, data[8].tolist())]
    bad = [(1000, None), (1001, [None] + [1.0] * 39), (1002, [float("nan")] * 40), (1003, [float("inf")] * 40), (1004, [1.0] * 3), (1005, [])]
    got = whitening.whiten(vectors(spark, rows + bad)).toPandas()
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    c = (n * x - sums) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    white, deviation = c @ u / np.sqrt(e), ((n * x - sums) ** 2).sum(1)
    assert len(got) == 32 * n and set(got.n) == {n} and set(got.component) == set(range(1, 33))
    assert (got.identity_error <= 1e-10).all() and got.identity_error.nunique() == 1
    one = got[(got.vec_id > 7) & (got.vec_id != 7)].sort_values(["vec_id", "component"])
    w = one.whitened.to_numpy().reshape(-1, 32)
    of = one.vec_id.to_numpy().reshape(-1, 32)[:, 0].astype(int)
    sign = np.sign((w * white[of]).sum(0))
    assert np.abs(w * sign - white[of]).max() < 1e-9
    assert (one.deviation.to_numpy().reshape(-1, 32)[:, 0] == deviation[of]).all()
    assert np.abs(one.explained.to_numpy().reshape(-1, 32)[0] - e / np.trace(c.T @ c / n)).max() < 1e-12


def test_whitening_cases(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [float("nan")])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    few = whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (3, [0.5, 9.0, 0.0])])).collect()
    assert {r.component for r in few} == {1, 2} and abs(sum(r.explained for r in few if r.vec_id == 1) - 1) < 1e-12
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 5.0])])).collect()
    assert huge and all(r.deviation is None or r.deviation >= 0 for r in huge)


# --- decontamination --------------------------------------------------------------


def brute_hits(docs, items):
    out = []
    for i, text in docs:
        words = WORDS.findall(low(text))
        hit, found = set(), set()
        for item, t in items:
            w = WORDS.findall(low(t))
            for at in range(max(len(w) - 10, 0) + 1 if w else 0):
                win = w[at : at + 10]
                for p in range(len(words) - len(win) + 1):
                    if words[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add("" if item is None else str(item))
        out.append((i, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


@pytest.fixture(scope="module")
def contaminated():
    rng = random.Random(11)
    vocab = ["a", "b", "Été", "日本", "c9", "THE", "été", "of"]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, prose(rng.choice([1, 2, 3, 9, 10, 11, 14, 30]))) for i in range(24)]
    items += [(100, None), (101, " ,. "), (None, prose(12)), (3, prose(15)), (10, items[5][1]), (11, "z " * 40), (12, prose(14) + " " + "z " * 12)]
    docs = [(i, f"{prose(rng.randint(0, 40))}, {rng.choice(items)[1] or ''}!\n{prose(rng.randint(0, 9))}") for i in range(60)]
    docs += [(70, None), (71, ""), (72, " .;"), (73, items[4][1]), (None, items[6][1]), (73, items[4][1]), (74, "z " * 300), (75, prose(3000))]
    return docs, items


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_against_brute_force(spark, contaminated, monkeypatch, broadcast):
    docs, items = contaminated
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    d = spark.createDataFrame([(i, t, 5, ["w"], "h") for i, t in docs], "doc_id long, text string, uid int, words array<string>, h string")
    b = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, wid string")
    got = decontaminate.contamination(d, b)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_hits(docs, items), key=repr)


def test_decontamination_of_empty_tables(spark, contaminated):
    docs, items = contaminated
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    clean = decontaminate.contamination(d, b.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items for r in clean)
