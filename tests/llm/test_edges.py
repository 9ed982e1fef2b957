"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import random

import pytest
from pyspark.sql import functions as F

from sunstride.llm import decontaminate, jaccard, mixing, toxicity, training_order, url_filter

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = {c: "int" for c in ("_may", "may", "gone", "_gone", "key", "row", "many", "class", "tie", "n", "score", "taken", "slot", "body", "positive", "item_id", "found_rule", "host", "_h", "_p")}
WORDS = 300_000
ITEM = "Which of the brindle vops was grented by the marn of oolay. The seventh fimble vop of all."


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every kind of oddity; their extra columns hold the row's number."""
    r = random.Random(3)
    long = " ".join(f"w{r.randrange(50_000)}" for _ in range(WORDS))
    near = " ".join(f"n{k}" for k in range(200))
    rows = [
        (1, long, "en", "a", len(long)), (2, long + " " + ITEM, "en", "a", None), (3, near, None, None, 1), (4, near + " x", "en", "b", 1), (4, near + " x", "en", "b", 1), (5, None, None, None, None),
        (None, None, None, None, None), (6, "", "", "", 0), (7, " \n\t", "en", "a", 3), (None, near, "en", "a", 1), (8, "A. b! " + ITEM, "en", "a", 1), (8, "another text under the same number", "en", "c", 1), (9, "!!! ...", "en", "a", 7),
    ]
    df = spark.createDataFrame([(*x, *[k] * len(CLASHES)) for k, x in enumerate(rows)], f"{DOCUMENTS}, " + ", ".join(f"{c} {t}" for c, t in CLASHES.items()))
    return df.repartition(3, F.col("n")).cache(), rows


def same_columns(found, docs, rows, changed=()):
    """Kept rows are rows of the input, extra columns and all."""
    assert found.columns == docs.columns
    got = found.collect()
    for x in got:
        k = x["n"]
        assert all(x[c] == k for c in CLASHES)
        assert all(x[c] == v for c, v in zip(("doc_id", "text", "lang", "source", "n_chars"), rows[k]) if c not in changed)
    return got


def test_stages_keep_odd_rows_and_clashing_columns(spark, odd):
    docs, rows = odd
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, None), (2, "")], "item_id long, text string")
    marks = spark.createDataFrame([(k, None, k % 2) for k in range(10)] + [(None, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    same_columns(toxicity.without_toxic(docs, marks), docs, rows)
    kept = same_columns(jaccard.deduplicated(docs), docs, rows)
    # of the long texts and of the near copies one stays, of the repeated row one; rows without words and others all stay
    assert sorted(((x["doc_id"], x["n"] if x["doc_id"] != 4 else 3) for x in kept), key=repr) == sorted([(1, 0), (3, 2), (5, 5), (None, 6), (6, 7), (7, 8), (8, 10), (8, 11), (9, 12)], key=repr)
    clean = same_columns(decontaminate.without_leaks(docs, bench), docs, rows)
    assert sorted(x["n"] for x in clean) == [0, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12]  # of number 8 only the row that has the item goes
    mix = same_columns(mixing.materialise(docs), docs, rows, changed=("text", "n_chars"))
    taken = {}
    for x in mix:
        assert x["n_chars"] == len(x["text"]) and set(x["text"].split()) <= set((rows[x["n"]][1] or "").split())
        taken[x["n"]] = taken.get(x["n"], 0) + len(x["text"].split())
    want = sorted((x["doc_id"] or 0, x["taken"]) for x in mixing.mixed(docs).collect() if x["taken"])
    assert sorted((rows[k][0] or 0, t) for k, t in taken.items()) == want


def test_whole_texts_however_long(spark, odd):
    docs, rows = odd
    sizes = {(x["doc_id"], x["size"]) for x in mixing.mixed(docs).collect()}
    assert {(1, WORDS), (2, WORDS + len(ITEM.split())), (5, 0), (6, 0), (7, 0)} <= sizes
    joined = jaccard.joined(docs).collect()
    assert {x["component_id"] for x in joined if x["doc_id"] in (1, 2)} == {1} and max(x["n_shingles"] for x in joined) > WORDS - 100
    found = decontaminate.contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in found) == [2, 8] and max(x["first_word"] for x in found) > WORDS - 100
    where = training_order.ordered(docs).collect()
    assert len(where) == len(rows) and sorted(x["n_tokens"] for x in where)[-1] > WORDS and sorted(x["n_tokens"] for x in where)[0] == 0
    url = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "net/" + "p/" * 20_000, 7, 7), (2, None, 7, 7), (3, "no scheme", 7, 7), (4, "http://net?x", 7, 7)], "page_id long, url string, _h int, key int")
    got = {x["page_id"]: x for x in url_filter.judge(url, url_filter.rule_table(spark, [("block", "net", "/"), ("allow", "a.net", "/p/")])).collect()}
    assert got[1]["rule"] == "a.net/p/" and got[1]["verdict"] == "allow" and all(got[k]["rule"] is None and got[k]["verdict"] == "allow" for k in (2, 3, 4)) and all(x["_h"] == x["key"] == 7 for x in got.values())


def test_empty_tables_through_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = f"file://{tmp_path}"
    for name, schema in (("documents", DOCUMENTS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []
