"""Each operator against its brute-force version on a fixture with the odd cases: null, empty, blank and very long
texts, ties, repeated rows, runs of one word, clashing column names, empty tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import asking, bpe, common, decontaminate, linededup, linking, lm, neardup, pii, quality, recompress, suffix, urls

from . import brute
from .measure_recall import recall

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)] + ["The", "of", "AND"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = text(60), text(25)
    docs = [(k, text(rng.randint(1, 150))) for k in range(30)]
    docs += [(k, f"{text(rng.randint(5, 40))}\n{passage} {text(20)}\n{line}") for k in range(30, 45)]
    base = text(120)
    for k in range(45, 60):  # near copies, each with other words changed
        w = base.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "changed"
        docs.append((k, " ".join(w)))
    docs += [(60, base), (61, base), (62, None), (63, ""), (64, " \t\n \x0b"), (65, "one"), (66, "One two three"), (67, "one TWO three")]
    docs += [(68, "run " * 200), (69, "run " * 17 + text(30)), (70, "a b " * 60), (71, text(10) + " a b" * 40), (72, text(20_000))]
    docs += [(73, line + "\n" + line.upper() + "\n\n" + line[:-3]), (74, "x\u00a0y\u2028z " * 20), (75, "<|endoftext|> a<|endoftext|>"), (60, base), (5, "another text under the same id " * 4)]
    rng.shuffle(docs)
    return docs


DOCS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in DOCS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def check(df, columns, want):
    assert rows(df, columns) == sorted(want, key=repr)


def with_null_id(spark, docs):
    return docs.unionByName(docs.where("doc_id = 60").limit(1).withColumn("doc_id", F.lit(None).cast("long"))), [*DOCS, (None, dict(DOCS)[60])]


def test_line_dedup(docs):
    # rows of one id at other places are one document, which the plain version does not know
    kept = docs.where("doc_id not in (5, 60)")
    check(linededup.digests(kept), ["doc_id", "n_lines", "n_removed", "kept_sha256"], brute.lines([d for d in DOCS if d[0] not in (5, 60)]))


def test_line_dedup_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, "same line here", "s"), (1, "same line here", "s"), (2, "same line here", "s"), (None, "same line here", "s")], "doc_id long, text string, pid string")
    assert sorted(r.doc_id for r in linededup.clean(df).collect()) == [1, 1]
    assert linededup.clean(df).columns == ["doc_id", "text", "pid"]


def test_lines_that_nobody_else_has_send_no_row(spark):
    """Only lines that another group has or that share a band with a different line leave their group."""
    rng = random.Random(14)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(120)).strip()
    near, copied = line(), line()
    rows = [(k, f"{line()}\n{copied}\n{line()}") for k in range(40)] + [(40, near), (41, near[:-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = linededup.lines_of(df, 6, 5).collect()
    wanted = {linededup.node_of(x) for t in (copied, near, near[:-1]) for x in linededup.normal_lines(t)}
    assert {bytes(r.node) for r in got} == wanted and 2 < len(got) <= 6 + 2
    assert {r.keys is None for r in got if bytes(r.node) == linededup.node_of(linededup.normal_lines(copied)[0])} == {True}
    assert sum(r.n_removed for r in linededup.digests(df).collect()) == 39 + 1


def test_normal_lines_of_a_group():
    rng = random.Random(15)
    for _ in range(50):
        texts = [None, "", "\n", " \n a", "a ", " b", "a\tb\r\n c", "é\x85 ", "\x1c a"] + ["".join(rng.choice("aB  \n\t\r\x0b\x0cé漢🙂aaa") for _ in range(rng.randint(0, 12))) for _ in range(30)]
        rng.shuffle(texts)
        k = rng.randint(0, len(texts))
        assert linededup.all_normal_lines(pa.chunked_array([pa.array(texts[:k], pa.string()), pa.array(texts[k:], pa.string())])) == [linededup.normal_lines(t) for t in texts]


@pytest.mark.parametrize("words", [1, 7, 1 << 17])
def test_pairs_of_sets_are_compared_as_one_by_one(monkeypatch, words):
    monkeypatch.setattr(linking, "WORDS", words)
    rng = np.random.default_rng(16)
    for n in range(2, 40):
        pool = rng.integers(0, 1 << 63, rng.integers(3, 500)).astype(np.uint64)
        base = rng.choice(pool, len(pool) // 2 + 1)
        sets = [np.unique(np.append(base[rng.random(len(base)) < rng.choice([0.5, 0.87, 0.93, 1])], rng.choice(pool))) for _ in range(n)]
        a, b = np.triu_indices(n, 1)
        assert linking.similar(sets, a, b, 75).tolist() == [linking.jaccard_at_least(sets[x], sets[y], 75) for x, y in zip(a, b)]
        assert linking.sketches(sets) == list(map(linking.sketch, sets))


def test_line_links_are_found():
    """Of all pairs of lines at 75 % or more, by comparing all pairs, next to none is lost."""
    rng = random.Random(13)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(60, 160))) for _ in range(150)]
    near = ["".join(c if rng.random() > 0.008 else rng.choice("xyz") for c in x) for x in base for _ in range(4)]
    lines = sorted({b for x in base + near for b in linededup.normal_lines(x) if b})
    links, _, _, lost = recall(lines)
    assert links > 200 and lost <= links // 100


def test_substring(spark, docs):
    df, plain = with_null_id(spark, docs)
    check(recompress.digests(df), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.words_removed(plain))


def locally(docs, groups=4, buckets=3):
    """Operator 3 without Spark, for parameters that workers do not see: (doc_id, n_removed) of each row."""
    texts = pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string())})
    tables = [texts.take(pa.array([j for j in range(len(texts)) if j % groups == k], pa.int64())) for k in range(groups)]

    def ask(make, answer, kind, told):
        rows = pa.concat_tables([make(k, t, told[k]) for k, t in enumerate(tables)])
        back = [pa.Table.from_batches(answer(rows.filter(pa.array([x == b for x in rows["bucket"].to_pylist()])).to_batches())) for b in sorted(set(rows["bucket"].to_pylist()))]
        back = pa.concat_tables(back)
        mine = [back.filter(pa.array([p == k for p in back["pid"].to_pylist()])) for k in range(groups)]
        return [m.append_column("kind", pa.array([kind] * len(m), pa.int32())) for m in mine]

    def words(k, t, told):
        g = recompress.Group(t)
        return g.asked(*asking.shared_mask(g.keys, g.doc, asking.blobs_of(told, 0), buckets)).packed(k, buckets)

    keys = ask(lambda k, t, _: asking.ask_shared(k, (g := recompress.Group(t)).keys, g.doc, buckets), lambda b: asking.answer_shared(b, asking.FREQUENT), 0, [None] * groups)
    later = ask(words, recompress._answer, 1, keys)
    out = []
    for k, t in enumerate(tables):
        g, gone = recompress.removed_words(t, pa.concat_tables([keys[k], later[k]]), buckets)
        out += zip(g.texts["doc_id"].to_pylist(), common.per_doc(gone, g.counts).tolist())
    return sorted(out, key=repr)


@pytest.mark.parametrize("name, value", [("none", 0), ("FREQUENT", 1), ("MANY", 0), ("LONG_WORD", 3), ("mix", lambda x: x >> np.uint64(62))])
def test_substring_with_other_parameters(monkeypatch, name, value):
    """Windows of frequent phrases one by one, long words as digests, and names that nearly all collide change nothing."""
    for module in (asking, recompress):
        if hasattr(module, name):
            monkeypatch.setattr(module, name, value)
    assert locally(DOCS) == sorted(((w[0], w[2]) for w in brute.words_removed(DOCS)), key=repr)


def test_suffix(spark, docs):
    df, plain = with_null_id(spark, docs)
    check(suffix.digests(df), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.bytes_removed(plain))


def test_suffix_of_frequent_hashes(docs, monkeypatch):
    monkeypatch.setattr(suffix.asking, "answer_shared", lambda batches, least, f=asking.answer_shared: f(batches, 2))
    check(suffix.digests(docs), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.bytes_removed(DOCS))


def suffix_locally(docs, groups=4, buckets=3, finer=5):
    """Operator 5 without Spark, for parameters that workers do not see: (doc_id, n_removed) of each row."""
    texts = pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string())})
    tables = [texts.take(pa.array([j for j, d in enumerate(docs) if (d[0] or 0) % groups == k], pa.int64())) for k in range(groups)]

    def ask(make, answer, kind, told):
        rows = pa.concat_tables([make(k, t, told[k]) for k, t in enumerate(tables)])
        back = pa.concat_tables([pa.Table.from_batches(answer(rows.filter(pa.array([x == b for x in rows["bucket"].to_pylist()])).combine_chunks().to_batches())) for b in sorted(set(rows["bucket"].to_pylist()))])
        mine = [back.filter(pa.array([p == k for p in back["pid"].to_pylist()])) for k in range(groups)]
        mine = [m.append_column("kind", pa.array([kind] * len(m), pa.int32())) for m in mine]
        return mine if told[0] is None else [pa.concat_tables([t, m]) for t, m in zip(told, mine)]

    def keys(k, t, told):
        g = suffix.Group(t, asking.blobs_of(told, 0), buckets)
        return asking.ask_shared(k, g.keys, g.doc, buckets, g.sorts())

    def windows(k, t, told):
        _, keys, rows, left, right, d = suffix._shared(suffix.Group(t, asking.blobs_of(told, 0), buckets), told, buckets)
        return suffix._ask_bytes(k, keys[d.first], rows[d.first], left[d.first], right[d.first], d.doc, finer)

    told = ask(lambda k, t, _: suffix._ask_chunks(k, suffix.Group(t), buckets), suffix._answer_chunks, 0, [None] * groups)
    told = ask(keys, lambda b: asking.answer_shared(b, suffix.FREQUENT), 1, told)
    told = ask(windows, suffix._answer_bytes, 2, told)
    out = []
    for k, t in enumerate(tables):
        g, gone = suffix.removed_bytes(t, told[k], buckets, finer)
        out += zip(t["doc_id"].to_pylist(), common.per_doc(gone, np.diff(g.offsets)).tolist())
    return sorted(out, key=repr)


@pytest.mark.parametrize("sparse, close, frequent", [(1, 1, 1024), (2, 3, 1), (16, 64, 1024), (1 << 40, 64, 1024)])
def test_suffix_with_other_chunks(monkeypatch, sparse, close, frequent):
    """Chunks of a byte, of some and of whole texts, edited passages, runs of one letter: all remove the same bytes."""
    for name, value in (("SPARSE", sparse), ("CLOSE", close), ("FREQUENT", frequent)):
        monkeypatch.setattr(suffix, name, value)
    rng = random.Random(sparse)
    passage = "".join(rng.choice("abc ") for _ in range(700))
    edited = [(100 + k, "".join(c if rng.random() > 0.004 * k else "?" for c in passage[rng.randrange(90) :])) for k in range(-4, 8)]
    some = [d for d in DOCS if d[0] != 72] + edited + [(120, "a" * 900), (121, "b" + "a" * 700 + "b"), (119, "a" * 99)]
    assert suffix_locally(some) == sorted(((w[0], w[2]) for w in brute.bytes_removed(some)), key=repr)


def test_chunks_hold_each_window_once_and_cut_passages_alike():
    rng = np.random.default_rng(17)
    texts = [rng.integers(97, 123, n).astype(np.uint8) for n in (0, 49, 50, 51, 3000, 5000, 0, 4000)]
    texts[5][1000:4000] = texts[4]
    data, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    use = np.arange(len(texts)) != 7
    starts, ends, row = suffix.chunks(data, offsets, use)
    held = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)])
    assert held.tolist() == [p for k in (2, 3, 4, 5) for p in range(offsets[k], offsets[k + 1] - suffix.WINDOW + 1)]
    first, second = (set(starts[row == k] - offsets[k]) for k in (4, 5))
    inner = {p for p in first if 2 * suffix.CLOSE <= p}
    assert len(inner) > 3 and {p + 1000 for p in inner} == {p for p in second if 1000 + 2 * suffix.CLOSE <= p <= 4000 - suffix.WINDOW}


def test_suffix_moves_texts_once_and_copies_not_at_all(spark, monkeypatch, tmp_path):
    """What is shuffled is little more than the texts, however many copies there are; it stays on disk until the query ends."""
    monkeypatch.setattr(suffix, "GROUP", 1 << 17)
    rng = random.Random(18)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(3000)) for _ in range(60)]
    spark.createDataFrame([(k, texts[k % 60]) for k in range(1200)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))

    before = written()
    got = {r.doc_id: r.n_removed for r in suffix.digests(df).collect()}
    moved = written() - before
    assert got == {k: 0 if k < 60 else 3000 for k in range(1200)}
    assert moved < 1.6 * 1200 * 3000


def test_longest_previous_factors():
    """Lengths up to the rows' ends at every start, against all pairs of rows."""
    rng = np.random.default_rng(2)
    n, columns, width = 200, 5, 70
    rows, doc = rng.integers(0, 2, (n, width)).astype(np.uint8), rng.integers(0, 40, n)
    rows[100:180, 2:67] = rows[20:100, 2:67]
    rows[180:200] = rows[:20]
    ends, ok = rng.integers(55, width + 1, n), rng.random((n, columns)) < 0.8
    for i in range(n):
        rows[i, ends[i] :] = 0
    ok &= np.arange(columns) + suffix.WINDOW <= ends[:, None]
    got = suffix.longest_previous_factors(rows, ends, ok, doc)
    for i in range(n):
        for c in range(columns):
            best = 0
            for j in range(n):
                if doc[j] < doc[i] and ok[i, c] and ok[j, c]:
                    reach = min(ends[i], ends[j]) - c
                    differ = rows[i, c : c + reach] != rows[j, c : c + reach]
                    best = max(best, int(differ.argmax()) if differ.any() else int(reach))
            assert got[i, c] == (best if best >= suffix.WINDOW else 0)
    assert got.max() > suffix.WINDOW


def test_symbols_agree_in_equal_texts():
    """Any window has a symbol start at offsets 2 to 5, the same ones with the same phrases wherever it stands."""
    rng = np.random.default_rng(1)
    random_words = lambda n, size: common.mix(rng.integers(0, size, n).astype(np.uint64) + np.uint64(1))

    def named(words):
        key = np.zeros(len(words), np.uint64)
        place, name = recompress.phrases(words, *recompress.symbols(words, np.zeros(len(words), int)), np.full(len(words), len(words)))
        key[place] = name
        return key

    for size in (1, 2, 5, 1000):
        words = random_words(400, size)
        a, b = named(words), named(np.concatenate([random_words(50, size), words[100:200], random_words(50, size)]))
        for k in range(88):
            assert (a[100 + k + 2 : 100 + k + 6] > 0).any()
            assert (a[100 + k + 2 : 100 + k + 6] == b[50 + k + 2 : 50 + k + 6]).all()


def twins(n=256):
    """Two words of n characters that every polynomial hash modulo a power of two confuses."""
    a = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return a, a.translate({97: 98, 98: 97})


def test_words_that_polynomials_confuse(spark):
    for n in (8, 64, 256, 1024):
        a, b = twins(n)
        data = np.frombuffer((a + b).encode(), np.uint8)
        assert len(set(common.names(data, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
    a, b = twins()
    head = " ".join(f"w{k}" for k in range(12))
    docs = [(1, f"{head} {a}"), (2, f"{head} {b}"), (10, a), (11, b)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(recompress.digests(df), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.words_removed(docs))
    check(neardup.digests(df), ["doc_id", "n_shingles", "component_id", "kept"], brute.near(docs))
    want = sorted(w[5] for w in brute.unigram(docs))
    assert np.allclose(sorted(r.base_score for r in lm.scores(df).collect()), want)


def test_names_are_of_the_bytes_alone():
    rng = random.Random(4)
    words = ["".join(rng.choice("ab\0é") for _ in range(n)).encode() for n in list(range(1, 80)) * 3]
    at = np.cumsum([0, *map(len, words)])
    got = common.names(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:]).tolist()
    back = words[::-1]
    at = np.cumsum([0, *map(len, back)])
    assert common.names(np.frombuffer(b"".join(back), np.uint8), at[:-1], at[1:]).tolist() == got[::-1]
    assert len(set(got)) == len(set(words))


ITEMS = [(1, "Of the and"), (2, None), (3, ""), (None, "a b a b a b a b a b a b")]


def benchmark(spark):
    long_item = dict(DOCS)[35][:300].upper()
    items = [*ITEMS, (4, long_item), (4, long_item)]
    return spark.createDataFrame(items, "item_id long, text string"), items


def test_decontamination(spark, docs, monkeypatch):
    df, items = benchmark(spark)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute.contamination(DOCS, items)
    check(decontaminate.digests(docs, df), columns, want)
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 60)  # several automata
    check(decontaminate.digests(docs, df), columns, want)
    assert sorted(r.doc_id for r in decontaminate.clean(docs, df).collect()) == sorted(w[0] for w in want if not w[5])


def test_byte_spans_map_to_the_original():
    text = "Ö x, THE-quick\u00a0brown"
    a, b = decontaminate.byte_spans(text, [(1, 4)])[0]
    assert text.encode()[a:b].decode() == "x, THE-quick\u00a0brown"


def test_decontamination_without_items(spark, docs):
    got = decontaminate.digests(docs, spark.createDataFrame([], "item_id long, text string"))
    assert got.where("contaminated").count() == 0 and got.count() == len(DOCS)


def test_language_model(spark, docs):
    df, plain = with_null_id(spark, docs)
    got = lm.scores(df)
    want = brute.unigram(plain)
    check(got, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"], [w[:5] for w in want])
    scores = sorted((r.n_tokens, r.n_known, r.base_score) for r in got.collect())
    assert np.allclose([s[2] for s in scores], [w[2] for w in sorted((w[2], w[3], w[5]) for w in want)])


def test_language_model_does_not_depend_on_partitions(spark):
    """The same rows in other partitions and another order get the same scores, and held-out texts are likelier than by
    their words alone."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = []
    for parts in (2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts + 1))
        dealt = rows.repartition(parts).orderBy(F.desc("doc_id")) if parts == 7 else rows.repartition(parts)
        got.append(sorted((r.doc_id, r.held_out, r.score, r.base_score) for r in lm.scores(dealt).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose([r[2] for r in got[0]], [r[2] for r in got[1]], rtol=1e-5)
    held = [r for r in got[0] if r[1]]
    assert sum(r[2] for r in held) > sum(r[3] for r in held)


def test_language_model_learns_order(spark):
    """Held-out texts of a strict order are far likelier than their unigrams say."""
    ring = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(ring[(i + k) % 30] for k in range(200))) for i in range(3000)]
    got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).where("held_out").agg(F.sum("score").alias("lm"), F.sum("base_score").alias("base")).first()
    assert got.lm > 0.8 * got.base


def test_language_model_holds_thousands_of_words(spark, monkeypatch):
    """Words of rank 1601 to 4096 have a place of their own in the model."""
    held = []
    monkeypatch.setattr(lm, "train", lambda docs, words, counts, total: held.append(len(words)) or lm.Model.start(words, counts, total))
    rows = [(i, " ".join(f"w{k}" for k in range(3000))) for i in range(20)]
    lm.scores(spark.createDataFrame(rows, "doc_id long, text string"))
    assert held == [3001]  # and the end token


def test_language_model_trains_on_places_of_tokens(spark):
    """Texts go to their shard as places of tokens, beside them only the texts whose order hangs on the text; the copy is the one that the
    sorted texts themselves train."""
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["b", "a", "c", "rare"]) for _ in range(rng.randrange(30)))
    rows = [(k, text()) for k in range(200)] + [(7, None), (7, ""), (7, "b a"), (None, "c"), (None, None), (None, "a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words, counts = np.sort(lm.tokens(pa.array(["a b c"]))[0]), np.array([5.0, 4, 3, 2])
    start = lm.Model.start(words, counts, 20)
    again = lm.repeated(df)
    assert set(again.to_pylist()) == {7, None}
    sent = spark.sparkContext.broadcast((words, start))
    assert sorted((str(r.doc_id), str(r.tie)) for r in lm.encoded(df, sent, again).collect() if r.tie is not None) == sorted((str(d), t) for d, t in rows if d in (7, None) and t is not None)
    assert [f.dataType.simpleString() for f in lm.encoded(df, sent, again).schema] == ["bigint", "int", "array<smallint>", "string"]
    placed = df.select(F.xxhash64("doc_id", F.lit(17)).alias("place"), "doc_id", "text").toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    trainer = lm.Trainer(lm.Model(words, {k: v.copy() for k, v in start.items()}))
    hashes, n = lm.tokens(placed["text"])
    trainer.learn(trainer.m.ids(hashes), n)
    for known in (again, None):
        got = lm.train_round(df, 1, words, start, known)
        assert all(np.array_equal(got[k], v) for k, v in trainer.m.p.items())


@pytest.mark.parametrize("most", [1 << 16, 4, 0])
def test_language_model_asks_about_other_tokens_alone(spark, docs, monkeypatch, most):
    """Tokens whose counts every task has do not travel, others do: whatever their number, the results are those of all counts; texts are
    dealt once and in no other step."""
    df, plain = with_null_id(spark, docs)
    monkeypatch.setattr(lm, "MOST", most)
    monkeypatch.setattr(lm, "HELD", 50)
    monkeypatch.setattr(asking, "BUCKET_BYTES", 2000)
    dealt = []
    grouped = asking.grouped
    monkeypatch.setattr(asking, "grouped", lambda docs, *columns, groups: dealt.append((docs.columns, grouped(docs, *columns, groups=groups))) or dealt[-1][1])
    got, want = lm.scores(df), brute.unigram(plain)
    check(got, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"], [w[:5] for w in want])
    assert np.allclose([s[2] for s in sorted((r.n_tokens, r.n_known, r.base_score) for r in got.collect())], [w[2] for w in sorted((w[2], w[3], w[5]) for w in want)])
    assert [("text" in c, "tie" in c) for c, _ in dealt] == [(False, True), (False, True), (False, False)]
    others = dealt[2][1].agg(F.sum(F.size("other"))).first()[0]
    assert others > 100 if not most else others < sum(w[2] for w in want) - 100


def test_language_model_gradients():
    rng = np.random.default_rng(0)
    words = np.arange(1, 200, dtype=np.uint64)
    p = lm.Model.start(words, np.ones(199), 300)
    p = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in p.items()}
    p["out_b"] = rng.normal(0, 0.1, p["out_b"].shape)
    m = lm.Model(words, p)
    ids, prev = rng.integers(0, 200, (5, 4)), rng.integers(0, 200, (5, 4))
    keep, h = np.ones((5, 4)), rng.normal(0, 1, (4, lm.HIDDEN))
    keep[2, 1] = 0
    ids[0, 0] = 199  # rare

    def loss():
        state, _, _ = m.run(prev, keep, h)
        return -m.log_prob(state.reshape(-1, lm.HIDDEN).astype(np.float64), ids.ravel())[0].mean()

    g, _ = m.gradients(prev, keep, ids, h)
    for name, at in (("u", (3, 5)), ("v", (2, 2)), ("cls", (1, 0)), ("cls_b", (1,)), ("out", (0, 1, 2)), ("out_b", (0, 3)), ("x", (int(prev[1, 0]), 20))):
        old, got = p[name][at], g[name][1][list(g[name][0]).index(at[0]), at[1]] if name == "x" else g[name][at]
        p[name][at] = old + 1e-2
        up = loss()
        p[name][at] = old - 1e-2
        down = loss()
        p[name][at] = old
        assert abs((up - down) / 2e-2 - got) < 2e-4, name


def test_score_carries_state_through_long_documents():
    rng = np.random.default_rng(0)
    words = np.arange(1, 100, dtype=np.uint64)
    p = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in lm.Model.start(words, np.ones(99), 300).items()}
    m, counts = lm.Model(words, p), np.array([700, 3, 1, 90])
    ids = rng.integers(0, 100, counts.sum()).astype(np.int32)
    together = lm.score(m, ids, counts)
    at = 0
    for n in counts:
        prev = np.concatenate([[m.rare + 1], ids[at : at + n - 1]])[:, None]
        keep = np.ones((n, 1), np.float32)
        state, _, _ = m.run(prev, keep, np.zeros((1, lm.HIDDEN), np.float32))
        assert np.allclose(m.log_prob(state[:, 0], ids[at : at + n])[0], together[at : at + n], atol=1e-3)
        at += n


@pytest.mark.parametrize("most", [500_000, -1])
def test_quality(docs, monkeypatch, most):
    monkeypatch.setattr(quality, "BROADCAST_LINES", most)
    got = quality.digests(docs)
    check(got, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], brute.quality(DOCS))


@pytest.mark.parametrize("most", [500_000, -1])
def test_quality_boilerplate(spark, monkeypatch, most):
    """The same with frequent lines broadcast by host and with lines that meet by document."""
    monkeypatch.setattr(quality, "BROADCAST_LINES", most)
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    line = text(30)
    mine = [(k, text(40) + "\n" + line.upper(), "a", 1) for k in range(20)] + [(20, "few words of its own\n" + line, "a", 1), (21, text(30) + "\n" + line, None, 1)]
    others = [(100 + k, text(40), "a", 1) for k in range(50)]
    again = [(30, text(25) + "\nrows of one document " + text(20), "a", 1)] * 30 + [(None, mine[3][1].split("\n")[0], "a", 1)] * 30
    df = spark.createDataFrame(mine + others + again, "doc_id long, text string, source string, kept int")
    got = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert quality.clean(df).columns == df.columns and {r.kept for r in quality.clean(df).collect()} == {1}
    assert 20 not in got and got[3] == mine[3][1].split("\n")[0]  # depleted; boilerplate left
    assert got[21] == mine[21][1] and len(got) == 73  # one host's lines do not count for another
    assert got[30] == again[0][1] and got[None] == again[-1][1]  # rows of one document, or equal ones without an id, count once


def test_urls(spark):
    urls_ = ["http://a.example.com/en/7x?q", "https://www.a.example.com/en/8", "HTTP://EXAMPLE.NET/de/8/", "x.net/de/1", None, "http://b.org/fr/1#f", "https://m.b.org/fr/1/?a=1", "http://c.org", "s://d.example.org/es/", "http://xcom/en/1", "http://b.org/fr/2", "://h/p", "http://b.org/fr/1#f"]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").withColumn("verdict", F.lit("mine"))
    got = {r.page_id: r for r in urls.verdicts(pages, pages.where("page_id = 5").select("url")).collect()}
    assert [got[k].verdict for k in range(13)] == ["allow", "block", "block", "allow", "allow", "block", "block", "allow", "block", "allow", "allow", "allow", "block"]
    assert (got[0].host, got[0].path, got[0].rule) == ("a.example.com", "/en/7x", "example.com/en/7")
    assert (got[2].host, got[2].rule) == ("example.net", "example.net/de/8") and got[3].host == "" and got[4].path == "" and got[11].host == "h"
    none = urls.verdicts(pages, pages.where("page_id < 0").select("url"))
    assert none.where("listed").count() == 0 and none.count() == 13


@pytest.mark.parametrize("blocks", [1 << 16, 0])
def test_filters_of_any_size(spark, monkeypatch, blocks):
    """The filter grows with the list, broadcast while it is small and dealt by block beyond; few unlisted URLs pass it."""
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", blocks)
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/p/"), "id").alias("url")).union(spark.createDataFrame([(9000, None)], "page_id long, url string"))
    got = urls.verdicts(pages, pages.where("page_id % 3 = 0").select("url"))
    assert 2000 <= got.where("maybe").count() < 2400 and got.count() == 6001
    assert sorted(r.page_id for r in got.where("verdict = 'block'").collect()) == list(range(0, 6000, 3))


def test_bpe(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, x in DOCS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False))))
    check(bpe.digests(docs), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], want)
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {(i, x or "") for i, x in DOCS}


def test_bpe_words_of_all_lengths():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(5)
    t, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.load(bpe.tokenizer_path())
    for n in [*range(1, 60), 300, 3000]:
        x = "".join(rng.choice("aeionrst'é0 \n中😀") for _ in range(n))
        assert own.encode(x) == t.encode(x, add_special_tokens=False).ids
    for x in ("a" * 200_000, "".join(rng.choice("theanor") for _ in range(50_000)), "é" * 5000):
        assert own.encode(x) == t.encode(x, add_special_tokens=False).ids


def test_near_duplicates(spark, docs):
    kept = docs.where("doc_id <> 5")
    df, plain = with_null_id(spark, kept)
    check(neardup.digests(df), ["doc_id", "n_shingles", "component_id", "kept"], brute.near([d for d in plain if d[0] != 5]))
    left = {r.doc_id for r in neardup.clean(kept.withColumn("_id", F.lit(1)).withColumn("node", F.lit("mine"))).collect()}
    assert left == {w[0] for w in brute.near([d for d in DOCS if d[0] != 5]) if w[3]}


@pytest.mark.parametrize("large, block", [(32, 256), (1, 16)])
def test_links_of_large_open_buckets(spark, monkeypatch, large, block):
    """Nodes that share much but not enough, with pairs among them that do: all links are found, by rare items or
    block against block."""
    monkeypatch.setattr(linking, "LARGE", large)
    monkeypatch.setattr(linking, "BLOCK", block)
    rng = np.random.default_rng(4)
    common_part = set(range(60))
    sets = [common_part | set(rng.integers(1000, 10**9, 60).tolist()) for _ in range(120)]
    for k in range(0, 60, 2):
        sets[k + 1] = set(list(sets[k])[:115]) | {k}
    made = [np.sort(common.mix(np.array(sorted(s), np.uint64))) for s in sets]
    node = lambda k: bytes([0, k])
    frame = spark.createDataFrame([(node(k), len(s), linking.sketch(s), s.tobytes()) for k, s in enumerate(made)], "node binary, size long, sketch binary, payload binary")
    buckets = spark.createDataFrame([(1, node(k)) for k in range(120)], "key long, node binary")
    roots = {bytes(r.node): bytes(r.root) for r in linking.link(buckets, frame, neardup._to_sets, 75).collect()}
    for k in range(0, 60, 2):
        assert roots[node(k)] == roots[node(k + 1)]
    assert len(set(roots.values())) == 30


def test_links_at_the_threshold_in_a_large_bucket(spark):
    """Pairs at 0.75 to 0.78 among hundreds of nodes that share a third: strict bands alone miss one in a hundred."""
    rng = np.random.default_rng(5)
    fresh = iter(rng.permutation(10**6).tolist())
    take = lambda n: {1000 + next(fresh) for _ in range(n)}
    common_part, sets = set(range(60)), []
    for k in range(400):
        both, own = common_part | take(36), 16 - k % 3  # 96 of 128, 126 or 124
        sets += [both | take(own), both | take(own)]
    made = [np.sort(common.mix(np.array(sorted(s), np.uint64))) for s in sets]
    node = lambda k: k.to_bytes(2, "big")
    frame = spark.createDataFrame([(node(k), len(s), linking.sketch(s), s.tobytes()) for k, s in enumerate(made)], "node binary, size long, sketch binary, payload binary")
    buckets = spark.createDataFrame([(1, node(k)) for k in range(800)], "key long, node binary")
    roots = {bytes(r.node): bytes(r.root) for r in linking.link(buckets, frame, neardup._to_sets, 75).collect()}
    assert [k for k in range(0, 800, 2) if node(k) not in roots or roots[node(k)] != roots.get(node(k + 1))] == []
    assert len(set(roots.values())) == 400


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(7)
    for n in (3, 8, 40, 400, 4000):
        both, own = round(n * 6 / 7), n - round(n * 6 / 7)
        while 100 * both < 75 * (both + 2 * own):
            both, own = both + 1, own - 1
        draw = lambda k: rng.integers(1, 2**63, (1000, k)).astype(np.uint64) * np.uint64(2)
        c, x, y = draw(both), draw(own), draw(own)
        a, b = (np.array([np.frombuffer(linking.sketch(np.sort(np.concatenate(r))), np.uint8) for r in zip(c, z)]).T.copy() for z in (x, y))
        assert linking.may_be_near(a, b, 75).all()
        if n >= 400:
            assert linking.may_be_near(a, np.roll(b, 1, 1), 75).mean() == 0


def test_minhash_estimates():
    rng = np.random.default_rng(0)
    a = common.mix(rng.integers(0, 10**9, 2000).astype(np.uint64))
    b = np.concatenate([a[:1500], common.mix(rng.integers(0, 10**9, 500).astype(np.uint64))])
    (la, ha), (lb, hb) = neardup.signature(a), neardup.signature(b)
    assert abs(((la == lb).mean() + (ha == hb).mean()) / 2 - 0.6) < 0.12


def test_personal_data(spark, docs):
    odd = ["mail a.b@c-d.com, x@y @z.com a@b.c.", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.03.004 1.1.1.00000000000000000000255 1.1.1.256", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (886) 555-9674 +12 +1234567890123456", "9" * 3000 + " " + "a" * 5000 + "@" + "1." * 3000, "1 " + "a" * 3000, None, "é@x.com user@é.com 😀 a@b.co"]
    df = spark.createDataFrame([*enumerate(odd), (2, odd[2])], "doc_id long, text string")
    check(pii.digests(df), ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"], brute.base_pii([*enumerate(odd), (2, odd[2])]))
    check(pii.digests(docs), ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"], brute.base_pii(DOCS))


def test_long_runs_take_linear_time():
    text = "1 " + "a" * 1_000_000 + " b@c.d " + "7" * 1_000_000
    assert pii.base_spans(text) == [(1_000_003, 0, 1_000_008)] and pii.candidates(text, []) == [(1_000_003, 1_000_008), (1_000_009, 2_000_009)]
    many = "x" * 100_000 + "=12345" * 20_000 + " 1.2.3.4"
    words = pii.Words(many)
    assert len({p for k in range(20_000) for p in pii.patterns_of(words, 100_001 + 6 * k, 100_006 + 6 * k)}) == 20_000


def test_long_contexts_and_identifiers_are_told_apart(spark):
    """Nothing is cut: contexts, seeds and candidates that differ only far from the span are different ones."""
    long = lambda c: "w" * 300 + c + "w" * 300
    rows = [(k, f"{long('a')} call +1 (555) 555-{1000 + k} now") for k in range(12)]
    rows += [(50, f"{long('a')} call 555-0199 now"), (51, f"{long('b')} call 555-0188 or"), (52, f"{long('a')} call {'5550-' * 80}7 or")]
    got = {r.doc_id: r for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[50].n_found, got[51].n_found, got[52].n_found) == (1, 0, 1)
    assert pii.name_of("1" * 300 + "2") != pii.name_of("1" * 300 + "3") and pii.name_of("1" * 64) == "1" * 64


def test_contexts_find_unseen_identifiers(spark):
    """Seeds in a context teach it; a number of no base form in it is found, others are not."""
    rows = [(k, f"please call me at +1 (555) 555-{1000 + k} if you can") for k in range(12)]
    rows += [(50, "please call me at 555-0199 if you can"), (51, "the year 1999-2004 was fine"), (52, "version 2.0.1.x of it"), (53, "Please call me at 555-0188 now")]
    got = {r.doc_id: r for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50].spans == "phone:18:26" and got[53].spans == "phone:18:26"
    assert got[51].n_found == got[52].n_found == 0 and got[3].n_phone == 1 and got[3].n_found == 0


def test_contexts_found_open_others(spark):
    """Numbers found in one context teach a second one, in which no seed stands, and that finds others; one context of few does not."""
    rows = [(k, f"please call me at +1 (555) 555-{1000 + k} if you can") for k in range(40)]
    rows += [(100 + k, f"please call me at 555-02{10 + k} if you can") for k in range(8)]
    rows += [(200 + k, f"the night desk answers 555-02{10 + k} until dawn") for k in range(8)]
    rows += [(300, "the night desk answers 555-0900 until dawn"), (301, "a lone desk takes 555-0901 at noon"), (302, "a lone desk takes 555-0210 at noon")]
    got = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200] == "phone:23:31" and got[300] == "phone:23:31" and got[301] == ""


def no_pages(df):
    return urls.verdicts(df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), df.select(F.col("text").alias("url")))


def no_documents(df):
    return decontaminate.digests(df, df.sparkSession.createDataFrame([(1, "an item of words")], "item_id long, text string"))


@pytest.mark.parametrize("run", [linededup.digests, recompress.digests, suffix.digests, lm.scores, quality.digests, bpe.digests, neardup.digests, pii.digests, linededup.clean, neardup.clean, quality.clean, recompress.clean, suffix.clean, no_pages, no_documents])
def test_empty_tables(empty, run):
    assert run(empty).collect() == []


@pytest.mark.parametrize("run", [linededup.clean, recompress.clean, suffix.clean, neardup.clean, quality.clean, lambda df: decontaminate.clean(df, df.sparkSession.createDataFrame([(1, None)], "item_id long, text string"))])
def test_columns_of_clashing_names_stay(spark, run):
    names = ["pid", "node", "bucket", "blob", "keys", "kept", "place", "root", "c0", "_id", "n_words", "host", "n_chars"]
    df = spark.createDataFrame([(1, "s", "a text of its own " + " ".join(f"w{k}" for k in range(30)), *range(13)), (2, "s", None, *range(13))], f"doc_id int, source string, text string, {', '.join(f'{n} int' for n in names)}")
    got = run(df)
    assert got.columns == df.columns and got.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    first = next(r for r in got.collect() if r.doc_id == 1)
    assert [first[n] for n in names[:-1]] == list(range(12)) and first["source"] == "s"


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing columns, and no rows at all."""
    import corpus_pipeline

    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    own, nameless = text(60), text(60)
    rows = [(1, own, "s", "mine"), (1, own, "s", "mine"), (None, nameless, "s", "mine"), (None, None, None, None), (2, own, "s", "mine"), (3, "", "s", None)]
    for name, data, want in (("some", rows, [(None,), (1,), (1,)]), ("none", [], [])):
        spark.createDataFrame(data, "doc_id long, text string, source string, pid string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert sorted([(r.doc_id,) for r in got.collect()], key=repr) == sorted(want, key=repr)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    clean = [(k, text(80), "en", "s", 1) for k in range(20)]
    leak = text(30)
    bad = [(100, clean[3][1], "en", "s", 1), (101, " ".join(clean[4][1].split()[:-2]), "en", "s", 1), (102, text(50) + " " + leak, "en", "s", 1), (103, "short", "en", "s", 1), (104, None, "en", "s", 1)]
    spark.createDataFrame(clean + bad, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == list(range(20))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "tokens"]


def test_quality_strings_equal_translate(spark):
    """Blanks, symbols and A-Z of odd lines, against one ``translate`` for each, which the plan of an ASCII line no longer needs."""
    blanks = " \t\n\x0b\f\r"
    odd = ["", " ", "\t\x0b", "A  B\tC\r", " \u00c9 \u00c0B  x", "\u0130STANBUL \u212a", "a\x0bb", "\u00a0X", "  Y ", "Ab Cd", "\x0cZ", "#*$ %&|<>\u00e9#", "\U0001f600 A  #", None]
    df, c = spark.createDataFrame([(x,) for x in odd], "x string"), F.col("x")
    pairs = [(quality.has_word(c), F.translate(c, blanks, "") != ""), (quality.without(c, blanks), F.translate(c, blanks, "")), (quality.without(c, "#*$%&|<>"), F.translate(c, "#*$%&|<>", "")), (quality.normal(c), F.trim(F.regexp_replace(F.translate(c, quality._UPPER, quality._LOWER), "[ \\t\\n\\x0B\\f\\r]+", " ")))]
    for r in df.select("x", *[F.struct(a.alias("a"), b.alias("b")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]).collect():
        assert all(p.a == p.b for p in r[1:]), r
