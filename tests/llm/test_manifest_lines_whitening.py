"""Merkle manifest, line dedup and whitening against brute force and hand-made odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faresight.llm import line_dedup, merkle, queries, whitening


@pytest.fixture(autouse=True, scope="module")
def ready(spark):
    queries.prepare(spark)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, arity):
    """(root, for each leaf its siblings as (left, right) lists, level by level)."""
    paths = [[] for _ in nodes]
    spans = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, over = [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at : at + arity]
            for k in range(len(run)):
                for leaf in spans[at + k]:
                    paths[leaf].append((run[:k], run[k + 1 :]))
            above.append(h(*run))
            over.append([x for s in spans[at : at + arity] for x in s])
        nodes, spans = above, over
    return (nodes[0] if nodes else None), paths


def expected(rows, tamper, arity=3):
    """Rows (doc_id, source, lang, n_chars, text) -> sorted results."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0], h(*map(field, r)), h(*map(field, (*r[:4], tamper(r[0], r[4]))))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([x[1] for x in by[s]], arity) for s in order}
    root, tops = tree([trees[s][0] for s in order], arity)
    out = []
    for k, s in enumerate(order):
        for (doc, leaf, later), path in zip(by[s], trees[s][1]):
            whole, now = path + tops[k], later
            for left, right in whole:
                now = h(*left, now, *right)
            out.append((doc, leaf, trees[s][0], root, h(*[x for left, right in whole for x in left + right]), now, now == root))
    return sorted(out, key=str)


def no_feeds(doc, text):
    return text.replace("\n", "") if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text


def verified(df, arity=3):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = merkle.verify(df, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), arity=arity)
    return sorted([tuple(r) for r in out.collect()], key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(11)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "en", i, f"line {i}\nmore {rng.random()}\n") for i in range(130)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (5, None, "é", 3, ""), (5, "hot", "en", 0, "other\n"), (5, "hot", "en", 0, "other\n")]
    rows += [(7, "", "en", 1, "x" * 300_000 + "\n"), (8, "lone", None, 2, "one\n"), (9, "\U0001f600", "en", 2, "日本\n"), (-4, "zz", "en", -1, "\n\n")]
    return rows


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest_equals_brute_force(spark, odd_rows, arity):
    df = spark.createDataFrame(odd_rows, DOCS).repartition(7).select("*", F.lit(1).alias("leaf"), F.lit(2).alias("pos"), F.lit("x").alias("hash"), F.lit(0).alias("part"))
    got = verified(df, arity)
    assert got == expected(odd_rows, no_feeds, arity)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_little(spark, odd_rows):
    for rows in ([], odd_rows[:1], odd_rows[-3:], [(i, f"s{i}", None, None, "\n") for i in range(10)]):
        assert verified(spark.createDataFrame(rows, DOCS)) == expected(rows, no_feeds)


def test_manifest_shows_any_change(spark):
    rows = [(i, f"s{i % 2}", "en", 1, f"text {i}") for i in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    changed = merkle.verify(df, F.when(F.col("doc_id") == 13, F.lit(None).cast("string")).otherwise(F.col("text")))
    assert [r.doc_id for r in changed.filter("not verified").collect()] == [13]


def lines_left(rows, least=40, documents=5):
    """Rows (doc_id, text) -> sorted (doc_id, n_lines, n_dropped, kept)."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    rank = lambda d: (d is not None, d or 0)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(rank(d))
    keeper = {k: max(v) for k, v in held.items() if len(v) >= documents}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), rank(d)) == rank(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def left(df, **how):
    return sorted([tuple(r) for r in line_dedup.drop_lines(df, **how).collect()], key=str)


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(12)
    pool = [f"Shared Line {i} " + "x" * rng.choice([20, 26, 27, 28, 60]) for i in range(30)] + ["é" * 40, "é" * 39, "日" * 41]
    rows = []
    for i in range(300):
        lines = [rng.choice(["", "  ", "\t"]) + (line.upper() if rng.random() < 0.3 else line) + rng.choice(["", " \r", "\x0b"]) for line in rng.choices(pool, k=rng.randint(0, 6))]
        lines += ["the very common line that a third of all documents hold"] * (i % 3 == 0) + [f"own line {i} of this document, long enough to count"] * (i % 5)
        rng.shuffle(lines)
        rows.append((rng.randint(0, 250) if i % 20 else None, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n"), (903, "\n\n" + pool[0] + "\n")] + [(77, "\n".join(pool[:9]))] * 40
    rows += [(950, "\n".join(pool[i % 30] for i in range(9000)))]
    return rows


def test_lines_equal_brute_force(spark, line_rows):
    df = spark.createDataFrame(line_rows, "doc_id long, text string").select("*", *[F.lit(3).alias(c) for c in ("h1", "keep", "doc", "pos", "key", "n_lines")])
    want = lines_left(line_rows)
    assert sum(r[2] for r in want) > 1000
    assert left(df.repartition(9)) == want
    # Few rows to a range and to a batch, so that the common lines go through many of both.
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("7", "61", "false")):
            spark.conf.set(k, v)
        assert left(df) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert left(df, least=10, documents=2) == lines_left(line_rows, 10, 2)


def test_lines_of_little(spark, line_rows):
    same = "a line that is held by every one of the documents here"
    for rows in ([], [(1, None)], [(i, same) for i in range(4)], [(i, same) for i in range(5)], [(1, same)] * 9, [(None, same)] + [(i, f"{same}\n{same}") for i in range(4)]):
        assert left(spark.createDataFrame(rows, "doc_id long, text string")) == lines_left(rows)


def test_bitmap_says_which_lines_stay(spark):
    rows = [(i, "\n".join(["head", "a line that is held by every one of the documents here", f"tail {i}"])) for i in range(6)]
    found = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc for r in found) == [0, 1, 2, 3, 4]
    assert all(np.unpackbits(np.frombuffer(zlib.decompress(bytes(r.keep)), np.uint8))[: r.n_lines].tolist() == [1, 0, 1] for r in found)


def brute_whitening(vectors, k=8):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    cov = np.array((y.T @ y), float) / float(n) ** 3
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, [int(v) for v in (y * y).sum(axis=1)], (np.array(y, float) / n) @ axes / np.sqrt(values), values / np.trace(cov)


def test_whitening_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviation, white, share = brute_whitening([v for _, v in rows])
    out = queries.QUERIES["op13_whitening"](spark, sf).collect()
    assert len(out) == 8 * len(rows) and {r.n for r in out} == {n}
    place = {i: at for at, (i, _) in enumerate(rows)}
    got = np.zeros((len(rows), 8))
    for r in out:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[place[r.vec_id]]
        assert abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got - sign * white).max() < 1e-8


def test_whitening_leaves_out_what_has_no_number(spark):
    rng = np.random.default_rng(5)
    base = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(50)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, float("nan"), 2.0, 3.0]), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    more = [(None, base[0][1]), (3, base[3][1]), (3, base[3][1])]
    df = spark.createDataFrame(base + odd + more, "vec_id long, embedding array<double>").select("*", *[F.lit(9).alias(c) for c in ("n", "component", "w", "key", "whitened")])
    out = whitening.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in out) == sorted((i is None, i or 0) for i, _ in base + more for _ in range(4))
    _, deviation, white, _ = brute_whitening([v for _, v in base + more], 4)
    assert sorted({int(r.deviation) for r in out}) == sorted(set(deviation))
    assert np.allclose(sorted(abs(r.whitened) for r in out), sorted(np.abs(white).ravel()), atol=1e-9)


def test_whitening_of_little(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None), (2, [])])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0])])).count() == 0  # nothing varies
    assert whitening.whiten(make([(1, [1.0, 2.0])] * 5)).count() == 0
    line = whitening.whiten(make([(i, [float(i), float(2 * i), 7.0]) for i in range(6)])).collect()
    assert {r.component for r in line} == {1} and abs(sum(r.whitened**2 for r in line) / 6 - 1) < 1e-12
    wide = whitening.whiten(make([(i, [float(i % 5) * 1e6, float(i % 3) * 1e-3, float(i)]) for i in range(40)])).collect()
    assert len(wide) >= 40 and max(r.identity_error for r in wide) < 1e-4


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64])
@pytest.mark.parametrize("kind", ["random", "repeated", "split", "rank_one", "graded"])
def test_components_of_symmetric_matrices(n, kind):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    values = {
        "random": rng.uniform(1, 9, n), "repeated": np.repeat([5.0, 2.0], [-(-n // 2), n // 2]), "split": rng.uniform(1, 9, n),
        "rank_one": np.eye(1, n)[0] * 7, "graded": 10.0 ** -np.arange(n) if n < 12 else 0.7 ** np.arange(n),
    }[kind]
    a = np.diag(values) if kind == "split" else (q * values) @ q.T
    a = (a + a.T) / 2
    k = min(8, n)
    got, axes = whitening.principal(a, k)
    size = np.abs(values).max()
    assert np.allclose(got, np.sort(values)[::-1][:k], rtol=0, atol=1e-13 * size * n)
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-10
    assert np.abs(a @ axes - axes * got).max() < 1e-11 * size


def test_products_are_exact_beyond_doubles():
    rng = np.random.default_rng(1)
    z = rng.integers(-(2**43), 2**43, size=(700, 3))
    want = z.astype(object).T @ z.astype(object)
    assert (whitening._products(z) == want).all()
