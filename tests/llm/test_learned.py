"""Learned operators on made-up corpora: held-out accuracy, defined results, and the pipeline stage by stage."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunstride.llm import decontaminate, jaccard, labelled, language, mixing, quality, toxicity
from sunstride.llm.labelled import remainder

BAD = ("grumblix", "snorvak", "plodwert", "zankful")


def corpus(n=900, seed=1):
    """Texts of two made-up languages; an eighth has bad words, an eighth is shouted or repeats itself."""
    r = random.Random(seed)
    parts = {"xx": ["ka", "ro", "mi", "tu", "ne", "lo"], "yy": ["schu", "brae", "dorf", "wich", "gell", "pfu"]}
    rows, labels = [], []
    for i in range(n):
        lang = r.choice(("xx", "yy"))
        words = ["".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 120))]
        toxic, good = int(r.random() < 0.125), int(r.random() >= 0.125)
        if toxic:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(("", ".", "s", ",")))
        if not good:
            words = [w.upper() + "!!" for w in words] if r.random() < 0.5 else [w for w in words[:20] for _ in range(6)]
        rows.append((i, " ".join(words), lang, f"s{i % 3}", 1, 0.5))
        labels.append((i, good, toxic))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
ODD = [(10_000, None, "xx", None, None, None), (10_001, "", "yy", "s", 0, None), (10_002, "123 ... !!", "xx", "s", 0, None), (10_003, "x" * 300_000, "xx", "s", 0, None), (None, "karo mi", None, "s", 0, None), (5, "ka ro", "xx", "s", 0, None), (5, "ka ro", "xx", "s", 0, None)]


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + ODD, SCHEMA).repartition(3).cache()
    marks = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None), labels[9], (10_001, 1, 0)], "doc_id long, quality int, toxic int").cache()
    return docs, marks, {i: (q, t) for i, q, t in labels}, {r[0]: r[2] for r in rows}


def held(i, modulus, rest):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus == rest


def check_scores(got, n):
    assert len(got) == n and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_remainder_is_crc32(spark):
    d = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    assert [r[0] for r in d.select(remainder("doc_id", 3)).collect()] == [zlib.crc32(str(i).encode()) % 3 for i in range(50)]


def test_toxicity(spark, tables):
    docs, marks, truth, _ = tables
    got = toxicity.judged(docs, marks).collect()
    check_scores(got, docs.count())
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) for r in got)
    test = [(r["predicted"], truth[r["doc_id"]][1]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in test]) > 0.97
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (10_000, 10_001, 10_002, None))
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns
    bad = {r["doc_id"] for r in got if r["predicted"]}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["doc_id"] not in bad)


def test_toxicity_ignores_held_out_labels(spark, tables):
    docs, marks, *_ = tables
    flipped = marks.withColumn("toxic", F.when(remainder("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((str(r["doc_id"]), r["score"]) for r in toxicity.judged(docs, m).collect()) for m in (marks, flipped))
    assert a == b


def test_learners_without_labels_or_rows(spark, tables):
    docs, marks, *_ = tables
    none = marks.limit(0)
    assert {r["score"] for r in toxicity.judged(docs, none).collect()} == {0.0}
    assert {r["score"] for r in quality.judged(docs, none).collect()} == {0.5}
    for found in (toxicity.judged(docs.limit(0), marks), quality.judged(docs.limit(0), marks), language.identified(docs.limit(0))):
        assert found.collect() == []
    unknown = language.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}


def test_nnpu_risk_and_prior():
    r = np.random.default_rng(0)
    p = [[0] if r.random() < 0.9 else [] for _ in range(300)]
    u = [[0] if r.random() < 0.09 else ([1] if r.random() < 0.5 else []) for _ in range(3000)]
    prior = toxicity.class_prior(np.array([len(s) for s in p], float), np.array([float(0 in s) for s in u]))
    assert 0.08 < prior < 0.14
    p, u = (toxicity.Sparse(x, [[1.0] * len(s) for s in x], 2) for x in (p, u))
    w, bias = toxicity.fit_nnpu(p, u, np.zeros(2), float(np.log(prior / (1 - prior))), prior, 1500, 0.05)
    assert w[0] + bias > 1 and bias < -1 and w[1] + bias < -1


def test_scores_agree_with_vectors():
    features = toxicity._Features()
    text = "Ka ka, karo karos ROT " * 3 + "rot... !!"
    at, value = toxicity.vector(text, features)
    weight = np.random.default_rng(1).normal(size=toxicity._BUCKETS)
    model = toxicity.Model(np.arange(toxicity._BUCKETS), weight, -0.5, 0.1)
    assert model.scorer()([text, None, "", "!!"])["score"] == pytest.approx(toxicity.sigmoid(np.array([weight[at] @ value, 0, 0, 0]) - 0.5))


def test_samples_count_an_identifier_once(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, "other") for k in range(2, 40)] + [(None, "none")], "doc_id long, text string")
    marks = [(1 + k % 39, k % 2) for k in range(400)] + [(1, 0), (2, 1), (2, 0), (None, 1)]
    found = []
    for parts in (1, 3, 7):
        ids = spark.createDataFrame(marks, "doc_id long, quality int").repartition(parts)
        got = sorted(map(tuple, labelled.draw(docs.repartition(parts), ids, 11, "quality").collect()))
        assert len(got) == 11 and len({g[0] for g in got}) == 11
        found.append(got)
    assert found[0] == found[1] == found[2]
    every = {g[0]: g for g in map(tuple, labelled.draw(docs, spark.createDataFrame(marks, "doc_id long, quality int"), 1000, "quality").collect())}
    assert len(every) == 39 and every[2][2] == 0 and every[1][2] == 0 and 0 not in every
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    assert labelled.draw(many, many, 300, None).count() == 300


def test_quality(spark, tables):
    docs, marks, truth, _ = tables
    got = quality.judged(docs, marks).collect()
    check_scores(got, docs.count())
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]][0] for r in got if r["held_out"] and r["doc_id"] in truth]) > 0.95


def test_network_is_calibrated_on_noise():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 3))
    y = (r.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    n = quality.Network(x[:3000], y[:3000])
    p = n(x[3000:])
    for low in (0.0, 0.25, 0.5, 0.75):
        at = (p >= low) & (p < low + 0.25)
        assert abs(p[at].mean() - y[3000:][at].mean()) < 0.12


def test_language(spark, tables):
    docs, _, _, langs = tables
    got = {r["doc_id"]: r for r in language.identified(docs).where("doc_id <> 5").collect()}
    assert all(r["held_out"] == held(i, 3, 1) for i, r in got.items())
    assert np.mean([r["lang_pred"] == langs[i] for i, r in got.items() if i in langs]) > 0.99
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (10_000, 10_001, 10_002)) and got[10_003]["lang_pred"] in ("xx", "yy")


def test_mixture_proportions():
    counts = np.zeros((2, 1 << 16))
    for k, text in enumerate(("karo mitu nelo kami rotu", "schubrae dorfwich gellpfu wichgell")):
        for w in text.split():
            counts[k] += np.bincount(language.trigrams(w), minlength=1 << 16)
    lang, bucket = np.nonzero(counts)
    share, has = language.Model(["xx", "yy"], lang, bucket, counts[lang, bucket])(["karo mitu nelo " * 5 + "schubrae dorfwich " * 5, "karo mitu", None, "12 ..", ""])
    assert has.tolist() == [True, True, False, False, False]
    assert share[:, 0] == pytest.approx([0.6, 0.4], abs=0.05) and share[:, 1].tolist() == [1.0, 0.0] and share[:, 2].tolist() == [0.0, 0.0]


def test_inference_equals_plain_loops():
    """Expectation-maximisation word by word, set by set, for each text on its own."""
    r = np.random.default_rng(6)
    n = [1, 4, 30, 60]
    like, often = r.uniform(0.01, 1, (3, sum(n))) ** 2, r.integers(1, 4, sum(n)).astype(float)
    got = language.infer(like, np.array(n), often)

    def em(words, allowed, rounds):
        pi = [float(a) / sum(allowed) for a in allowed]
        total = sum(k for _, k in words)
        for _ in range(rounds):
            new = [0.0] * 3
            for w, k in words:
                z = sum(p * x for p, x in zip(pi, w))
                for j in range(3):
                    new[j] += k * pi[j] * w[j] / z
            pi = [x / total for x in new]
        return pi, sum(k * np.log(sum(p * x for p, x in zip(pi, w))) for w, k in words)

    at = 0
    for t, m in enumerate(n):
        words = [(like[:, i].tolist(), often[i]) for i in range(at, at + m)]
        total = sum(k for _, k in words)
        pi, _ = em(words, [1, 1, 1], 8)
        order = sorted(range(3), key=lambda j: (-pi[j], j))
        best, fit = em(words, [j == order[0] for j in range(3)], 1)
        for size in (2, 3):
            if pi[order[size - 1]] * total <= 0.5:
                break
            some, ll = em(words, [j in order[:size] for j in range(3)], 16)
            if ll - 0.5 * np.log(total + 1) <= fit:
                break
            best, fit = some, ll - 0.5 * np.log(total + 1)
        assert got[:, t] == pytest.approx(best, abs=1e-9)
        at += m


def test_many_languages_without_a_cap(spark, monkeypatch):
    r, letters = random.Random(8), [chr(0x4E00 + k) for k in range(4000)]
    own = {f"l{k:04d}": letters[3 * k : 3 * k + 3] for k in range(1200)}
    rows = [(k, " ".join("".join(r.choices(own[name], k=4)) for _ in range(12)), name) for k, name in enumerate(list(own) * 2)]
    rows += [(9000 + k, "12 34", "blank") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit(docs, F.lit(True))
    assert len(model.languages) == 1201
    monkeypatch.setattr(language, "_CELLS", 1 << 18)  # many groups of texts
    share, has = model([t for _, t, _ in rows[:150]])
    assert has.all() and [model.languages[k] for k in share.argmax(axis=0)] == [name for *_, name in rows[:150]]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    r = random.Random(4)
    rows, labels = corpus(500, seed=7)
    item = "Which of the brindle vops was grented by marn. The seventh fimble vop."
    rows += [(1000 + k, rows[k][1] + " tail", "xx", "s0", 1, 0.1) for k in range(0, 40)]  # near copies
    rows += [(2000 + k, " ".join(r.choice(("ka", "ro", "mitu")) + str(r.randint(0, 99)) for _ in range(60)) + " " + item, "xx", "s1", 1, 0.1) for k in range(6)]
    rows += [(3000, None, None, None, None, None), (3001, "", "xx", "s1", 0, 0.1)]
    d = f"file://{tmp_path}"
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    marks = spark.read.parquet(f"{d}/labels.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, d)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        out = spark.read.parquet(f"{d}/{name}")
        after = [r.asDict() for r in out.collect()]
        ids = {r["doc_id"] for r in after}
        if name == "toxicity":
            model = toxicity.fit(docs, marks, remainder("doc_id", 3) != 1)
            score = model.scorer()
            assert ids == {i for i, t in before.items() if score([t])["score"][0] < 0.7} and {3000, 3001} <= ids
        elif name == "ngram_jaccard_join":
            assert ids == {r["component_id"] for r in jaccard.joined(docs).collect()}
        elif name == "benchmark_decontamination":
            assert ids == {i for i, t in before.items() if item not in (t or "")} and len(ids) < len(before)
        elif name == "source_mixing":
            words = {x["doc_id"]: x["taken"] for x in mixing.mixed(docs).collect()}
            got = {i: 0 for i in words}
            for r in after:
                got[r["doc_id"]] += len(r["text"].split())
            assert got == words
        else:
            assert len(after) == docs.count() and ids == set(before)
        docs = out
    whole = pipeline.run(spark, d)
    assert whole.count() == docs.count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    from sunstride.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, sf)
        want = con.execute(sql)
        cols = [c[0] for c in want.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want.fetchall())), name


def test_search_and_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] and "pipeline" in names and decontaminate
