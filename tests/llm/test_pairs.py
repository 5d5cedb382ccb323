"""Operators 11 to 13 against their brute-force versions, with the odd cases of ``make_docs`` and hard ones of their own."""

import random

import numpy as np
import pytest

from tracewright.llm import alignment, bpe, kmeans, tokengroups

from . import brute
from .test_operators import DOCS, check, docs, empty, with_null_id  # noqa: F401

JOINED = ["doc_id", "n_shingles", "component_id"]


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def families():
    """Families of near copies at and around 85 %, some of them chains, documents that share a passage, and single ones."""
    rng, out = random.Random(21), []
    passage = words(rng, 60)
    for _ in range(12):
        base = words(rng, 90)
        for _ in range(rng.randint(2, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "".join(rng.choice("xyz") for _ in range(6))
            out.append(w)
        for _ in range(6):  # a chain: each a few words further
            base = base[3:] + words(rng, 3)
            out.append(base)
    out += [passage + words(rng, rng.randint(5, 70)) for _ in range(40)]
    out += [words(rng, rng.randint(1, 60)) for _ in range(40)]
    rng.shuffle(out)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


def test_jaccard_join(spark, docs):  # noqa: F811
    kept = docs.where("doc_id <> 5")
    df, plain = with_null_id(spark, kept)
    check(tokengroups.digests(df), JOINED, brute.similar([d for d in plain if d[0] != 5]))


@pytest.mark.parametrize("group, split, tokens", [(300, 40, 64), (2000, 100, 500)])
def test_jaccard_join_over_many_groups(spark, monkeypatch, group, split, tokens):
    """Families that are split over groups, for any size of groups and of ranges."""
    monkeypatch.setattr(tokengroups, "GROUP", group)
    monkeypatch.setattr(tokengroups, "SPLIT", split)
    monkeypatch.setattr(tokengroups, "RANGE", tokens)
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.similar(rows)
    assert 60 < len({c for _, _, c in want}) < len(rows) - 60
    check(tokengroups.digests(df), JOINED, want)


def test_groups_are_bounded_though_all_share_their_least_hash(spark):
    nodes = spark.createDataFrame([(bytes([k // 256, k % 256]), 7, 1000) for k in range(2000)], "node binary, low long, n long")
    sizes = [r["count"] for r in tokengroups.grouped(nodes, 50).groupBy("pid").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 800


def test_columns_of_the_matrix_fall_into_ranges():
    column = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000).astype(np.uint64))
    for bits in (0, 1, 6, 12):
        parts = tokengroups.ranges_of(column, bits)
        assert [p[1] for p in parts] == [0, *(p[2] for p in parts)][:-1] and parts[-1][2] == len(column)
        assert all(int(x) >> (48 - bits) == r for r, a, b in parts for x in column[a:b])
    assert (tokengroups.unpacked(tokengroups.packed(column)) == column).all()
    assert tokengroups.ranges_of(column[:0], 3) == []


def make_vectors(n=300):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 64))
    rows = [(k, (centres[k % 6] + rng.normal(scale=0.3, size=64)).astype(np.float32).tolist()) for k in range(n)]
    rows += [(n, None), (n + 1, [0.5] * 63), (n + 2, [0.5] * 63 + [None]), (n + 3, [float("nan")] * 64), (n + 4, [float("inf")] + [0.0] * 63), (n + 5, []), (n + 6, rows[3][1]), (7, rows[7][1]), (8, rows[9][1]), (None, rows[1][1])]
    return rows


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_ball_kmeans(spark):
    rows = [r for r in make_vectors() if r[0] is not None]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, v string").repartition(5)
    check(kmeans.clusters(df), COLUMNS, brute.clusters(rows))


@pytest.mark.parametrize("n", [0, 1, 9])
def test_ball_kmeans_of_few_vectors(spark, n):
    rows = make_vectors()[:n]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(kmeans.clusters(df), COLUMNS, brute.clusters(rows))
    rows = [(k, [float(k // 4)] * 64) for k in range(4 * n)]  # ties and equal centroids
    check(kmeans.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), COLUMNS, brute.clusters(rows))


def test_ball_kmeans_of_odd_rows(spark):
    rows = [(None, [1e30] + [0.0] * 63), (None, [-1e30] + [0.0] * 63), (1, [0.0] * 64)]
    got = kmeans.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted((r.vec_id or 0, r.distance, r.inertia) for r in got.collect()) == [(0, 0, 0), (0, 0, 0), (1, 0, 0)]


def test_stable_members_are_compared_with_nobody():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-2000, 2000, (16, 64))
    own = rng.integers(0, 16, 3000)
    x = centroids[own] + rng.integers(-30, 30, (3000, 64))
    far = np.sqrt([((x[own == k] - centroids[k]) ** 2).sum(1).max() for k in range(16)])
    best, least, asked = kmeans.Balls(centroids, far).assign(x, own)
    assert (best == own).all() and asked == 3000
    start, least_0, asked = kmeans.Balls(centroids, np.full(16, np.inf)).assign(x, np.zeros(3000, np.int64))
    assert (start == own).all() and (least_0 == least).all() and asked <= 16 * 3000


def odd_texts():
    rng = random.Random(5)
    odd = [None, "", " ", "\n", "  two  blanks ", "▁ is a piece mark", "<|endoftext|> and <s></s><unk>", "żółć 漢字 emoji 🙂🙃 é", "a b c​", "\x00\x01 control", "ﬁ ligature ① Å", "x" * 3000, "<0x41> bytes", "﻿mark", "don't we'll 12345 67.8"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x800), rng.randrange(0x4E00, 0x9000), 0x1F600 + rng.randrange(60)])) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return list(enumerate(odd, 1000))


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(alignment, "CALL_BYTES", 1000)
    rows = [d for d in DOCS if len(d[1] or "") < 20_000] + odd_texts() + [(None, "a nameless one")]
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, chunk int, links binary").repartition(3)
    want = brute.alignment(rows, bpe.tokenizer_path("byte_bpe_50k.json"), bpe.tokenizer_path("piece_bpe_32k.model"))
    assert sum(r[1] == 0 for r in want) > 3  # some are not spelled alike
    check(alignment.alignments(df), ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"], want)
    best = alignment.best_links(df).collect()
    assert {r.b for r in best} and all(r["count"] > 0 for r in best)


def test_the_transducer_may_forget(monkeypatch):
    sides = alignment.Sides(bpe.tokenizer_path("byte_bpe_50k.tiktoken"), bpe.tokenizer_path("piece_bpe_32k.model"))
    texts = [t for _, t in odd_texts() if t]
    run = lambda: [(x[:4], sorted(x[4].tolist())) if (x := sides.aligned(*s)) else None for s in sides.encode(texts)]
    first = run()
    known = sides.transducer.known
    for name, value in (("MEMO", 10), ("DEPTH", 1), ("DEPTH", 3)):  # long groups go from state to state
        monkeypatch.setattr(alignment, name, value)
        assert run() == first
    assert sides.transducer.known < known


def test_transducer_by_hand():
    sides = object.__new__(alignment.Sides)
    sides.transducer = t = alignment.Transducer([b"ab", b"c", b"abcd", b"", b"d"], [b"a", b"bc", b"abc", b"d"])
    of = lambda a, b: (x[0], x[1], x[2], sorted(x[4].tolist())) if (x := sides.aligned(a, b)) else None
    assert of([0, 1], [2]) == (2, 1, 1, [2 << 17, 2 << 17 | 1])
    assert of([0, 1], [0, 1]) == (2, 2, 1, [0, 1 << 17, 1 << 17 | 1])
    assert of([2], [2, 3]) == (1, 2, 1, [2 << 17 | 2, 3 << 17 | 2])
    assert of([4, 0, 1, 4], [3, 2, 3]) == (4, 3, 3, [2 << 17, 2 << 17 | 1, 3 << 17 | 4, 3 << 17 | 4])
    assert all(of(a, b) is None for a, b in (([0], [2]), ([1], [3]), ([3], [0]), ([], [0]), ([4], []), ([4, 4], [3]), ([4], [3, 3]), ([0], [0])))
    assert of([], []) == (0, 0, 0, [])
    assert t.state(0, b"") == t.state(1, b"") == 0


def test_planes():
    for n in (0, 1, 5, 300):
        x = np.sort(np.random.default_rng(n).integers(0, 2**31, n))
        assert (alignment.from_planes(alignment.planes(x)) == x).all()


@pytest.mark.parametrize("run", [tokengroups.digests, alignment.alignments])
def test_empty_tables(empty, run):  # noqa: F811
    assert run(empty).collect() == []


@pytest.mark.parametrize("run", [tokengroups.digests, alignment.alignments])
def test_clashing_columns(spark, run):
    names = ["pid", "node", "n", "root", "tokens", "payload", "range", "low", "chunk", "of", "pair", "n_a"]
    df = spark.createDataFrame([(1, "one text of five words", *range(12)), (2, None, *range(12)), (None, None, *range(12))], f"doc_id int, text string, {', '.join(f'{n} int' for n in names)}")
    got = run(df).select("doc_id").collect()
    assert sorted((r.doc_id for r in got), key=repr) == [1, 2, None]
