"""Operators with exact answers, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sunstride.llm import archive, components, decontaminate, exact_dedup, jaccard, mixing, toxicity, training_order, url_filter
from sunstride.llm.common import local_table, scratch, settled
from sunstride.llm.labelled import BATCH_BYTES, small_batches

DOC = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, part string, size long"


def docs_of(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or ""), 1, "k", "p", 5) for i, t in enumerate(texts)], DOC)


# mixing ---------------------------------------------------------------------------------------------------------------


def brute_lague(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_sainte_lague_is_highest_quotients():
    r = random.Random(1)
    for _ in range(60):
        votes = [r.choice((0, 1, 5, 5, 40, 1000)) for _ in range(r.randint(1, 7))]
        seats = r.randint(0, 40)
        if sum(votes):
            assert mixing.sainte_lague(votes, seats) == brute_lague(votes, seats)


def test_targets_stop_at_the_cap_and_reshare():
    assert mixing.targets([100, 100, 100]) == [200, Fraction(500, 3), Fraction(250, 3)]
    assert sum(mixing.targets([10, 0, 7, 900])) == Fraction(3, 2) * 917
    assert mixing.targets([]) == []


def test_mix_takes_what_the_targets_ask(spark):
    r = random.Random(2)
    texts = [" ".join("w" * r.randint(1, 5) for _ in range(r.choice((0, 1, 30, 400)))) for _ in range(400)] + [None, "", " \t\n"]
    docs = docs_of(spark, texts, lambda i: None if i % 7 == 0 else f"s{i % 4}")
    got = [x.asDict() for x in mixing.mixed(docs, block=8, shard=2000).collect()]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sizes = {i: len(word.findall(t or "")) for i, t in enumerate(texts)}
    assert {x["doc_id"]: x["size"] for x in got} == sizes and len(got) == len(texts)
    by = defaultdict(int)
    for x in got:
        by[x["source_size"], x["target"]] += x["taken"]
        assert 0 <= x["taken"] <= 2 * x["size"]
    for (size, target), taken in by.items():
        assert abs(taken - target) <= 8 + size / 200
    again = mixing.mixed(docs.repartition(7), block=8, shard=2000)
    assert sorted(map(tuple, again.collect())) == sorted(tuple(x.values()) for x in got)


def test_materialised_mix_has_the_words_taken(spark):
    r = random.Random(3)
    texts = [" ".join(f"d{i}w{j}" for j in range(r.randint(0, 60))) for i in range(120)] + [None]
    docs = docs_of(spark, texts)
    taken = {x["doc_id"]: x["taken"] for x in mixing.mixed(docs, block=16, shard=500).collect()}
    made = mixing.materialise(docs, block=16, shard=500)
    assert made.columns == docs.columns
    words = defaultdict(list)
    for x in made.collect():
        words[x["doc_id"]] += x["text"].split()
        assert x["n_chars"] == len(x["text"]) and x["key"] == "k"
    for i, t in enumerate(texts):
        assert len(words[i]) == taken[i]
        assert all(abs(words[i].count(w) - taken[i] / max(1, len(t.split()))) < 1 + 1e-9 for w in set((t or "").split()))


def test_mix_of_an_empty_table(spark):
    assert mixing.mixed(docs_of(spark, [])).collect() == []
    assert mixing.materialise(docs_of(spark, [])).collect() == []


# Jaccard join ---------------------------------------------------------------------------------------------------------


def brute_components(texts):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    sets = []
    for t in texts:
        w = word.findall((t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    out = [None, "", " \t\n\x0b\x0c\r ", "one", "ONE", "one two three four", "one  two\tthree four", "One two Three four five", "one two three four five", "É é É é É", "é é é é é", "a\xa0b c d e f g"]
    for _ in range(14):
        base = [word() for _ in range(r.choice((6, 20, 80, 300)))]
        if r.random() < 0.5:
            base = passage + base
        out.append(" ".join(base))
        for _ in range(r.choice((0, 1, 6))):
            copy = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 5))):
                at = r.randrange(len(copy))
                copy[at : at + r.choice((0, 1))] = [word()]
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("how", [{}, {"task_members": 3}, {"task_shingles": 50}, {"held": 40, "common": 2}])
def test_jaccard_components_match_brute_force(spark, how):
    texts = near_texts()
    want = brute_components(texts)
    got = jaccard.joined(docs_of(spark, texts), **how)
    assert sorted(map(tuple, got.collect())) == want
    assert len({c for _, _, c in want}) < len(texts)


def test_jaccard_at_the_threshold(spark):
    # 9 shared of 9 + 1 + 1 shingles is above 0.8; 8 of 8 + 1 + 1 is exactly 0.8; 7 of 9 is below
    def pair(k):
        base = [f"w{k}x{i}" for i in range(k + 4)]
        return [" ".join([f"a{k}", *base]), " ".join([*base, f"b{k}"])]

    texts = [*pair(9), *pair(8), *pair(7)]
    got = [r["component_id"] for r in jaccard.joined(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [0, 0, 2, 2, 4, 5]


def test_jaccard_keeps_repeated_rows_and_null_ids(spark):
    d = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None), (1, "x")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.joined(d).collect()), key=repr)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (None, 0, None), (1, 1, 1)], key=repr)
    assert jaccard.joined(d.limit(0)).collect() == []


def test_one_of_each_group_stays(spark):
    texts = near_texts(9)
    docs = docs_of(spark, texts)
    want = [i for i, _, c in brute_components(texts) if i == c]
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want


def test_repeats_nulls_and_clashing_columns_in_dedup(spark):
    rows = [(3, "a b c d e f", 1, 1, 1), (3, "a b c d e f", 1, 1, 1), (None, "A b c d e f", 2, 2, 2), (4, "", 3, 3, 3), (4, None, 3, 3, 3), (5, "q " * 40_000, 4, 4, 4), (5, "r s", 5, 5, 5), (None, "lone words", 6, 6, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _may int, gone int, key int")
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "")[:3], r["_may"], r["gone"], r["key"]) for r in kept.collect()), key=repr) == sorted(
        [(3, "a b", 1, 1, 1), (4, "", 3, 3, 3), (4, "", 3, 3, 3), (5, "q q", 4, 4, 4), (5, "r s", 5, 5, 5), (None, "lon", 6, 6, 6)], key=repr
    )
    assert jaccard.deduplicated(docs.limit(0)).collect() == []


def test_tree_loses_no_pair():
    r = np.random.default_rng(4)
    sizes = r.integers(5, 60, 300)
    sets = [np.unique(r.integers(0, 200, n).astype(np.uint64)) for n in sizes]
    sizes = np.array([len(s) for s in sets])
    points = np.stack([np.bincount((s % 16).astype(int), minlength=16) for s in sets]).astype(np.int32)
    tree = jaccard.Tree(points, sizes)
    for i in range(0, 300, 7):
        found = set(tree(points[i], int(sizes[i])).tolist())
        assert {j for j in range(300) if jaccard.similar(sets[i], sets[j])} <= found


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {199: 199, 200: 199}


# decontamination ------------------------------------------------------------------------------------------------------


def bench_rows():
    r = random.Random(8)
    word = lambda: "".join(r.choice("klmnop") for _ in range(5))
    items = []
    for i in range(40):
        q, a = [word() for _ in range(r.randint(8, 30))], [word() for _ in range(r.randint(2, 8))]
        items.append((i, " ".join(q).capitalize() + ". " + " ".join(a).capitalize() + "."))
    return items + [(40, items[3][1]), (41, None), (42, ""), (43, "...")], word, r


def test_leaks_are_found_and_clean_texts_left(spark):
    items, word, r = bench_rows()
    filler = lambda n: " ".join(word() for _ in range(n))
    texts, want = [None, "", "...", filler(500)], set()
    for k in range(25):
        i = r.randrange(40)
        before = r.choice((0, 3, 100, 900))
        texts.append(f"{filler(before)} {items[i][1]} {filler(r.choice((0, 50)))}")
        want |= {(len(texts) - 1, j) for j in range(41) if items[j][1] in texts[-1]}
    texts.append(items[5][1].split(". ")[0] + " " + filler(30))  # the question without its answer
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for a_part in (20_000, 11, 1):
        got = decontaminate.contaminated(docs_of(spark, texts), bench, items_a_part=a_part).collect()
        assert {(x["doc_id"], x["item_id"]) for x in got} == want
        rows.append(sorted((x["doc_id"], x["item_id"], round(x["bm25"], 9), x["question_overlap"], x["answer_overlap"], x["first_word"]) for x in got))
    assert rows[0] == rows[1] == rows[2]
    kept = decontaminate.without_leaks(docs_of(spark, texts), bench)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})
    assert decontaminate.contaminated(docs_of(spark, texts), bench.limit(0)).collect() == []
    assert decontaminate.contaminated(docs_of(spark, []), bench).collect() == []


def test_wand_returns_all_above_the_threshold():
    items, _, r = bench_rows()
    items = [(i, t) for i, t in items if decontaminate.plain(t)]
    bags = [decontaminate.plain(t) for _, t in items]
    df = Counter(w for b in bags for w in set(b))
    index = decontaminate.Index([(i, t, df) for i, t in items], len(items), sum(map(len, bags)) / len(bags), max(map(len, bags)), block=2)
    for _ in range(300):
        query = sorted(set(r.choices(range(len(index.items)), k=r.randint(0, 60))))
        for threshold in (0.05, 0.2, 0.5):
            score = np.zeros(len(index.ids))
            for t in query:
                score[index.items[t]] += index.share[t]
            want = {int(d): round(float(score[d]), 9) for d in np.flatnonzero(score >= threshold - 1e-9)}
            assert {int(d): round(s, 9) for d, s in index.above(query, threshold)} == want


# exact dedup ----------------------------------------------------------------------------------------------------------


def brute_dedup(texts):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    return sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


COLS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_matches_brute_force(spark, tmp_path, weak):
    texts = [None, "", "a", "A", "a ", "b", "a", "é", "é", None, "x" * 200_000, "x" * 200_000] + ["hot"] * 700 + [f"t{i % 50}" for i in range(90)]
    path = f"file://{tmp_path}/documents.parquet"
    docs_of(spark, texts).repartition(5).write.parquet(path)
    digest = (lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)) if weak else exact_dedup.sha256  # colliding digests are told apart by their bytes
    got = exact_dedup.exact_dedup(spark, path, digest=digest).select(*COLS)
    assert sorted(map(tuple, got.collect())) == brute_dedup(texts)


def test_exact_dedup_goes_on_with_new_files(spark, tmp_path):
    path, state = f"file://{tmp_path}/documents.parquet", scratch(spark, "state")
    docs_of(spark, ["a", "b", "a"]).write.parquet(path)
    exact_dedup.exact_dedup(spark, path, state=state).collect()
    docs_of(spark, [None] * 3 + ["b", "c"]).where("doc_id > 2").write.mode("append").parquet(path)
    got = exact_dedup.exact_dedup(spark, path, state=state, files=1).select(*COLS)
    assert sorted(map(tuple, got.collect())) == brute_dedup(["a", "b", "a", "b", "c"])


def test_exact_dedup_of_repeated_rows_one_file_and_none(spark, tmp_path):
    d = spark.createDataFrame([(4, "q"), (4, "q"), (None, "q"), (None, "z")], "doc_id long, text string")
    d.coalesce(1).write.parquet(f"file://{tmp_path}/d.parquet")
    one = next(tmp_path.glob("d.parquet/*.parquet"))
    got = exact_dedup.exact_dedup(spark, f"file://{one}")
    found = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in got.collect())
    assert found == [(-1, -1, 1, True), (-1, 4, 3, False), (4, 4, 3, False), (4, 4, 3, True)]
    d.limit(0).write.parquet(f"file://{tmp_path}/e.parquet")
    assert exact_dedup.exact_dedup(spark, f"file://{tmp_path}/e.parquet").collect() == []


# URL rules ------------------------------------------------------------------------------------------------------------

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "x.org", ""), ("allow", "dup.io", "/"), ("block", "dup.io", "/"))


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), v == "block", h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)] if rest or True else []
    best = max(fits, default=None)
    return host, path, best and best[2], "block" if best and best[1] else "allow"


def test_urls_match_brute_force(spark):
    urls = [None, "", "example.net/en/", "http://", "://", "http://net", "http://NET/", "https://a.B.Example.NET/en/1?x#y", "http://example.net/en", "http://xexample.net/en/", "ftp://x.example.com/de/",
            "http://example.com?/de/", "http://q.org/fr/", "http://x.org", "http://x.org#/fr/", "http://a.x.org/fr/", "http://dup.io/", "a://b://net/", "http://net:80/", "http://.net/", "http://É.net/", "http://example.net/EN/", "http://net/" + "p/" * 3000]
    pages = spark.createDataFrame([(i, u, "old", 7) for i, u in enumerate(urls * 2)], "page_id long, url string, verdict string, rule int")
    got = url_filter.judge(pages, url_filter.rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(tuple, got.collect())) == [(i, *brute_judge(u)) for i, u in enumerate(urls * 2)]


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, rule_host string, rule_path string")
    assert [tuple(r) for r in url_filter.judge(pages, none).collect()] == [(1, "http://a.net/", "a.net", "/", None, "allow")]
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, RULES)).collect() == []


def test_url_plan_is_native_with_either_join(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.net/en/") for i in range(20)], "page_id long, url string")
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 1)
    wide = url_filter.judge(pages, url_filter.rule_table(spark, RULES))
    assert {r["rule"] for r in wide.collect()} == {"net/"}
    assert not re.search("Python|Pandas|Arrow", wide._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", ""))


# archives -------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 5, "z" * 100_000, "<p>a</p>"] + ["hot"] * 1200
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://h/{i}\r\nX: y", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    for least in (0, 4):
        folder = scratch(spark, "t")
        made = archive.write(pages, folder, least, package=4000)
        assert made.count() > 1
        got = {r["page_id"]: r for r in archive.read(made).collect()}
        last = {}
        for i, h in enumerate(html):
            last[h or ""] = i
        for i, h in enumerate(html):
            body = (h or "").encode()
            keep = last[h or ""] if len(body) >= least else i
            want = (len(body), archive.payload_digest(body), "response" if keep == i else "revisit", None if keep == i else keep)
            assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == want
        assert len(got) == len(html)


def test_archive_of_null_ids_and_of_nothing(spark):
    pages = spark.createDataFrame([(None, "u", "x"), (None, "u", "x"), (5, "u", "x"), (5, "u", "x")], "page_id long, url string, html string")
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in archive.round_trip(spark, pages).collect()]
    assert sorted(got, key=repr) == sorted([(None, "response", None)] * 2 + [(5, "response", None)] * 2, key=repr)
    assert archive.round_trip(spark, pages.limit(0)).collect() == []


def test_zip64_directory_is_read(tmp_path):
    import struct
    import zipfile

    from pyarrow import fs

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one", b"1" * 10)
        z.writestr("two", b"22")
    raw = path.read_bytes()
    end = raw.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack("<10xHII", raw[end : end + 20])
    z64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start)
    locator = struct.pack("<IIQI", 0x07064B50, 0, end, 1)
    path.write_bytes(raw[:end] + z64 + locator + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        found = archive.directory(f)
        assert set(found) == {"one", "two"}
        at, n = archive.stored(f, found["two"])
        f.seek(at)
        assert f.read(n) == b"22"


# training order -------------------------------------------------------------------------------------------------------


def test_feistel_is_a_permutation_and_its_inverse():
    for n in (1, 2, 3, 64, 65, 1000):
        p = training_order.Feistel(n, key=9)
        slots = p.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert p.number(slots).tolist() == list(range(n))
    assert training_order.Feistel(1000, 1).slot(np.arange(1000)).tolist() != training_order.Feistel(1000, 2).slot(np.arange(1000)).tolist()


def test_tokens_are_those_of_the_coder():
    t = training_order.Tokenizer(training_order.load_ranks())
    for text in ("", "Hello, the world.\nAnd so", "a  b", " lead", "tail ", "x\n y", "don't 12 34é", "a\u00a0b c", "\t", "été naïf 'tis we'll"):
        assert np.frombuffer(t(text), "<u2").tolist() == t.coder.encode_ordinary(text)


def test_shards_hold_every_text_in_permuted_order(spark):
    r = random.Random(6)
    texts = [" ".join("abc"[: r.randint(1, 3)] + str(r.randint(0, 99)) for _ in range(r.choice((0, 5, 200)))) for _ in range(80)] + [None, ""]
    docs = docs_of(spark, texts).repartition(3)
    folder = scratch(spark, "order")
    where, shards = training_order.materialised(docs, folder, length=32, shard_bytes=32 * 2 * 10)
    got = {x["doc_id"]: x for x in where.collect()}
    slots = list(training_order.read_sequences(folder))
    assert sum(x["sequences"] for x in shards.collect()) == len(slots) and len(got) == len(texts)
    import json

    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(base + "/order.json") as f:
        about = json.loads(f.read())
    p = training_order.Feistel(about["sequences"], about["key"])
    by_number = np.concatenate([slots[s] for s in p.slot(np.arange(len(slots)))])
    coder = training_order.Tokenizer(training_order.load_ranks())
    for i, t in enumerate(texts):
        x = got[i]
        at = x["sequence"] * 32 + x["at"]
        want = np.frombuffer(coder(t), "<u2")
        assert x["n_tokens"] == len(want) and by_number[at : at + len(want)].tolist() == want.tolist() and by_number[at + len(want)] == training_order.END
        assert x["shard"] * 10 * 64 + x["byte_offset"] == x["slot"] * 64 + x["at"] * 2
    assert [a.tolist() for a in training_order.read_sequences(folder, 7, 25)] == [a.tolist() for a in slots[7:25]]


def test_training_order_of_nothing(spark):
    assert training_order.ordered(docs_of(spark, [])).collect() == []


def test_slots_are_computed_once(spark, capsys):
    training_order.ordered(docs_of(spark, ["a b c", "d e", None])).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_local_tables_without_python_workers(spark, monkeypatch):
    docs = settled(docs_of(spark, [f"w{k} x y" for k in range(40)]), "docs")
    marks = settled(spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int"), "marks")
    monkeypatch.setattr(spark.sparkContext, "parallelize", None)
    assert toxicity.without_toxic(docs, marks).columns == docs.columns
    assert mixing.materialise(docs).agg(F.sum(F.size(F.split("text", " ")))).first()[0] > 100
    assert training_order.ordered(docs).count() == 40


def test_local_tables_keep_their_rows(spark):
    rows = [(1, "a", 0.1, None), (-(1 << 62), None, 1e300, 2), (3, "é\n", -0.0, 1 << 30)]
    found = local_table(spark, rows, "a long, b string, c double, d int")
    assert found.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double"), ("d", "int")] and [tuple(x) for x in found.collect()] == rows
    assert local_table(spark, [], "a long, b string").collect() == []


def test_batches_end_by_bytes(spark):
    small_batches(spark)
    sizes = spark.range(0, 600, 1, 1).select(F.expr("repeat('x', 100000)").alias("t")).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()
    assert max(r["n"] for r in sizes) < BATCH_BYTES + 200_000 and len(sizes) > 10


def test_part_meets_only_hashes_that_are_there_again(monkeypatch):
    r = np.random.default_rng(3)
    part, seen = jaccard._Part(1 << 25, 1 << 17), defaultdict(set)
    classes = np.stack([np.arange(300), np.arange(300)[::-1]], axis=1).astype(np.uint64)
    sizes = r.integers(10, 14, 300).astype(np.int32)
    for _ in range(4):
        k, no = (r.integers(0, 1 << 17, 30_000) * 32_000).astype(np.uint32), r.integers(0, 300, 30_000).astype(np.uint32)
        k[::2] = r.integers(0, 1 << 32, 15_000, dtype=np.uint64).astype(np.uint32)
        list(part.add(k.tobytes() + no.tobytes(), classes.tobytes(), sizes.tobytes()))
        for a, b in zip(k.tolist(), no.tolist()):
            seen[a].add(b)
    sorted_, lexsort = [], np.lexsort
    monkeypatch.setattr(jaccard.np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or lexsort(keys))
    got = Counter((int(k), int(c[0]), int(z), int(d)) for found in part.rest() for k, c, z, d in zip(*found))
    want = Counter()
    for k, own in seen.items():
        for c in own:
            if any(o != c and 4 * max(sizes[o], sizes[c]) <= 5 * min(sizes[o], sizes[c]) for o in own):
                want[k, c, int(sizes[c]), len(own)] += 1
    assert got == want and sum(want.values()) > 1000
    assert sum(sorted_) < 70_000  # of 120,000 that were dealt
