"""The training-text operators against brute force, exact round trips and held-out labels."""

import hashlib
import random
import zlib
from array import array

import duckdb
import numpy as np
import pytest

from lodestrata.llm import bpe, common, decision_list, jaccard, knn_quality, langid, license_scan, media_ts, packing, queries, sharding, warc

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\t \n", "a", "The the the", "x" * 5000, "word " * 9000, "é́ ñ K ſ İ Σς ΑΣ Σ.", "a\x1cb\x85c d e", "don't I'LL they'Re 's 'S", "<|endoftext|>x<|STARTOFTEXT|> <|endoftext|>",
    "日本語のテキスト、空白なし。" * 300, "H̱ẖ Å å", "123 4a5 ½ ² ٣", "!!! ... ,,, a., b,. c.. d,", "\U0001f600\U0001f468‍\U0001f469 ok", "a\nb\nb\nb c", "\0 nul",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, "en" if i % 3 else None, "s", i, i) for i, t in enumerate(ODD)] + [(None, "no id here", None, None, 0, 0), (3, ODD[3], "en", "s", 0, 0), (90, ODD[7], "de", "s", 0, 0), (91, ODD[7], "de", "s", 0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, size int, n_words int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int")


# --- 1


def test_warc_round_trip(spark):
    rows = [(1, "u", "a" * 300_000), (2, None, None), (3, "v", ""), (4, "w", "same"), (9, "x\r\ny", "same"), (7, "z", "same"), (9, "x", "same"), (None, "n", "same"), (11, "q", "\r\n\r\n&é" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    archive = warc.write(warc.with_revisits(pages))
    chunks = warc.read_chunks(archive)
    got = warc.records(chunks).collect()
    assert len(got) == len(rows) and all(r["digest_ok"] for r in got)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        own = html[r["page_id"]]
        assert r["payload_bytes"] == len(own) and r["payload_digest"] == warc.base32_sha1(hashlib.sha1(own).digest())
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {(1, "response", None), (2, "revisit", 3), (3, "response", None), (4, "revisit", 9), (7, "revisit", 9), (9, "response", None), (None, "revisit", 9), (11, "response", None)}
    long = chunks.where("page_id = 1").orderBy("chunk_no").collect()
    assert len(long) == 5 and [r["bytes_so_far"] for r in long] == [65536, 131072, 196608, 262144, 300000]
    assert long[0]["digest_so_far"] == warc.base32_sha1(hashlib.sha1(b"a" * 65536).digest())
    # an archive's data are one WARC file
    data = b"".join(bytes(r["data"]) for r in archive.where("archive = 0").orderBy("record_no", "chunk_no").collect())
    assert data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC/1.1\r\n") == archive.where("archive = 0 and chunk_no = 0").count()


def test_warc_many_copies(spark, monkeypatch):
    """The same records where repeated digests are too many to send, and some have too many copies to be a key; columns clash."""
    rows = [(i, f"u{i}", f"page {i % 7}" if i % 3 else None) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    made = lambda df: sorted(map(tuple, warc.records(warc.read_chunks(warc.write(warc.with_revisits(df)))).collect()))
    want = made(pages)
    assert sum(r[3] == "response" for r in want) == 8 and all(r[5] for r in want)
    assert made(pages.selectExpr("*", "'x' as HTML", "1 as Page_id").toDF("page_id", "url", "html", "HTML", "Page_id")) == want
    for most in (0, 5):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        monkeypatch.setattr(warc, "HOT_COPIES", 30)
        assert made(pages) == want


def test_warc_revisits_are_verified(spark):
    from pyspark.sql import functions as F

    rows = [(1, "u", "same"), (2, "u", "same"), (3, "u", "other"), (4, "u", "other"), (5, "u", "more"), (6, "u", "more")]
    pages = warc.with_revisits(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    archive = warc.write(pages)
    lost = archive.where(~F.contains("data", F.lit(b"<urn:page:2>\r\nWARC-Date")) | F.contains("data", F.lit(b"revisit")))
    changed = lost.withColumn("data", F.when(F.contains("data", F.lit(b"HTTP/1.1")) & F.contains("data", F.lit(b"other")), F.expr("cast(replace(cast(data as string), 'other', 'OTHER') as binary)")).otherwise(F.col("data")))
    got = {r["page_id"]: r["digest_ok"] for r in warc.records(warc.read_chunks(changed)).collect()}
    assert got == {1: False, 3: False, 4: False, 5: True, 6: True}


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.records(warc.read_chunks(warc.write(warc.with_revisits(pages)))).count() == 0


# --- 2


def test_bpe_is_the_librarys(library, docs):
    e = bpe.TreeEncoder(queries.vocabulary_path())
    for t in [*ODD, *docs.values()]:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert e.ids(t) == want
        assert e.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_unknown_runs(library):
    """Runs of every kind side by side, with a table that is soon full."""
    rng = random.Random(7)
    parts = ["a", "Be", "é", "Ñ", "ß", "$", "#!", "'s", "'", "1", " ", "\n", "\u0301", "\u0327", "<|endoftext|>", "×", "÷", "\u00a0", "ſ", "\u212a", "İ", "字", "@", "[", "`", "</w>", "\x1c", "x" * 300]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    e = bpe.TreeEncoder(queries.vocabulary_path(), cache_entries=50)
    assert [array("I", x).tolist() for x in e.encode_many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(e.runs) == 50


def test_bpe_white_space(library):
    e = bpe.TreeEncoder(queries.vocabulary_path())
    for c in range(0x3100):
        if chr(c).isspace() or c < 0x180:
            t = f"ab{chr(c)}cd {chr(c)} x{chr(c)}."
            assert e.ids(t) == library.encode(t, add_special_tokens=False).ids, hex(c)


@pytest.mark.parametrize("leaf", [2, 3, 7, 16, 64])
def test_bpe_tree_concatenation(library, leaf):
    e = bpe.TreeEncoder(queries.vocabulary_path(), leaf=leaf)
    rnd = random.Random(leaf)
    for _ in range(120):
        kind = rnd.choice(["abcde", "etaoinshr", "ab", "zé漢", "!?#", "a1"])
        t = "".join(rnd.choice(kind) for _ in range(rnd.randint(1, 400)))
        assert e.ids(t) == library.encode(t, add_special_tokens=False).ids
    for t in ("internationalization" * 50, "a" * 1000, "the" * 333):
        assert e.ids(t) == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("half", [0, 1, 5, 17, 64, 512])
def test_bpe_halves(library, docs, half):
    """Whole texts cut anywhere and joined again; at the size in use most of the tables' texts are, and words are cut."""
    e = bpe.TreeEncoder(queries.vocabulary_path(), half=half, leaf=64 if half == 17 else bpe.LEAF)
    rng = random.Random(half)
    parts = ["a", "Be", "é", "ß", "$", "#!", "'s", "'", "'ll", "1", " ", "\n", "\t ", "\u0301", "<|endoftext|>", "<|", "\u00a0", "ſ", "İ", "字", "word ", "x" * 70, "\x1c"]
    texts = [*ODD, *docs.values(), *("".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500))]
    assert [array("I", x).tolist() for x in e.encode_many(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    if half == bpe.HALF:
        long = sum(len(t.encode()) > half for t in docs.values())
        assert long > 0.5 * len(docs) and e.joins > long and e.wider > 0.5 * e.joins
        assert not e.runs.keys() & {b"wor", b"wo"}


@pytest.mark.parametrize("size, step", [(1, 1), (50, 7), (5000, 1000)])
def test_bpe_without_halves(library, docs, monkeypatch, size, step):
    """Groups of any size give the same ids: lists and Arrow arrays, also slices, nulls and nothing at all."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "GROUP_BYTES", size)
    monkeypatch.setattr(bpe, "STEP", step)
    e = bpe.TreeEncoder(queries.vocabulary_path(), half=0, cache_entries=50)
    texts = [*ODD, *list(docs.values())[:40], "", None]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for own in (texts, pa.array(texts)):
        assert [array("I", x).tolist() for x in e.encode_many(own)] == want
        assert [array("I", x).tolist() for x in e.encode_many(own[5:9])] == want[5:9]
    assert list(e.encode_many([])) == [] and list(e.encode_many(pa.array([], pa.string()))) == []
    assert list(e.encode_many([None, ""])) == [b"", b""]


def test_bpe_calls_are_bounded(library, monkeypatch):
    """However many runs of a text are new, the library gets few at a time, and the ids are the same."""
    e = bpe.TreeEncoder(queries.vocabulary_path(), half=0)
    text, sizes, own = " ".join(f"{chr(97 + i % 26)}x{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} a{i}" for i in range(12_000)), [], e.encode_pieces
    monkeypatch.setattr(e, "encode_pieces", lambda pieces: sizes.append(len(pieces)) or own(pieces))
    assert e.ids(text) == library.encode(text, add_special_tokens=False).ids
    assert len(sizes) > 1 and max(sizes) <= bpe.CALL


def test_bpe_columns(spark, odd, none, library):
    from pyspark.sql import functions as F

    path = queries.vocabulary_path()
    got = odd.select("text", bpe.encode_column(F.col("text"), path).alias("ids"), bpe.digests_column(F.col("text"), path).alias("d")).withColumn("back", bpe.decode_column(F.col("ids"), path)).collect()
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["back"] == text and r["d"]["n_tokens"] == len(ids)
        assert r["d"]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["d"]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert none.select(bpe.digests_column(F.col("text"), path)).count() == 0


# --- 3


def brute_statistics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def test_statistics(docs, monkeypatch):
    texts = [*ODD[:6], *ODD[8:], "a b c d e f g h " * 4, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8\n\n\nx\nx\n y\n y", *list(docs.values())[:60]]
    for t in texts:
        assert decision_list.statistics(t)[:5] == brute_statistics(t)
    monkeypatch.setattr(decision_list, "LONG_WORDS", 0)
    for t in texts:
        assert decision_list.statistics(t)[:5] == brute_statistics(t)


def test_rules_are_learned():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(600), "b": rng.random(600), "c": rng.random(600)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["c"] > 0.5))
    rules = decision_list.learn(x, bad)
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= decision_list.covers(r, x, 600)
    assert (hit == bad).mean() > 0.96 and rules
    assert decision_list.learn(x, np.zeros(600, bool)) == [] and decision_list.learn(x, np.ones(600, bool)) == []


def test_decision_list(spark, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = decision_list.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels).join(labels, "doc_id").collect()
    good, bad = ([r for r in got if r["quality"] == q and r["n_words"] >= 20] for q in (1, 0))
    assert sum(r["kept"] for r in good) / len(good) > 0.98 and sum(r["kept"] for r in bad) / len(bad) < 0.1
    none_labelled = labels_of(spark, [(1, 1)])
    own = decision_list.judge(odd, none_labelled).collect()
    assert len(own) == odd.count() and all(r["rule"] == 0 and r["kept"] == (not r["base_failed"]) for r in own)
    assert all(r["base_failed"] for r in own if r["n_words"] < 20)
    assert decision_list.judge(none, none_labelled).count() == 0


# --- 4


def brute_links(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)) and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return links, [find(i) for i in range(len(texts))]


def near_copies():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(5, 300))] for _ in range(40)]
    out = []
    for b in base:
        out.append(" ".join(b))
        for _ in range(rnd.randint(0, 6)):
            c = list(b)
            for _ in range(rnd.randint(0, max(1, len(c) // 60))):
                c[rnd.randrange(len(c))] = rnd.choice(words)
            out.append(" ".join(c))
    common = [rnd.choice(words) for _ in range(60)]
    out += [" ".join(common + [rnd.choice(words) for _ in range(30)]) for _ in range(30)]
    big = [rnd.choice(words) for _ in range(120)]
    out += [" ".join([*big[:i], "zz%d" % i, *big[i + 1 :]]) for i in range(100)]
    return out + [None, "", "  ", "one", "one", "one two", out[0], out[0].replace(" ", "  ")]


@pytest.mark.parametrize("block", [600, 7])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", jaccard.BROADCAST_ROWS if block > 10 else 0)
    texts = near_copies()
    links, roots = brute_links(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r for r in jaccard.join(df).collect()}
    assert len(got) == len(texts)
    assert [got[i]["n_links"] for i in range(len(texts))] == links
    assert [got[i]["class_id"] for i in range(len(texts))] == roots


def test_jaccard_parts():
    assert jaccard.prefix_depth(0.8, 24, 8, 0.9999) == 5 and jaccard.prefix_depth(0.8, 1, 8, 0.999) == 1
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(60)]
    pairs = np.array([(i, j) for i in range(60) for j in range(i)])
    assert jaccard.intersections(sets, pairs).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in pairs]
    # a path's key is its first levels, its tail the others in their order
    own = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    forest = jaccard.Forest()
    (keys, tails), (shorter, short_tails) = forest.paths(own), jaccard.Forest(target=0.999).paths(own)
    assert forest.shortest == 5 and jaccard.Forest(target=0.999).shortest == 6 and (tails & 2**32 - 1 == short_tails).all() and (keys != shorter).all()
    assert (tails >> forest.shift(5) == 0).all() and forest.shift(8) == 0


def test_prefixes_are_shortened_by_the_data(spark):
    """Whole paths are enough for very near copies; links at the threshold need shorter ones; a recall not yet reached goes on."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"

    def copies(n, edits):
        out = []
        for _ in range(n):
            base = [word() for _ in range(400)]
            other = list(base)
            for i in range(edits):
                other[20 + i * 20] = word()
            out += [" ".join(base), " ".join(other)]
        return spark.createDataFrame(list(enumerate(out)), "doc_id bigint, text string").repartition(3)

    forest = jaccard.Forest()
    near, far = (jaccard.Search(copies(150, edits), forest) for edits in (1, 8))
    assert near.level == 8 and far.level < 8
    for search, edits in ((near, 1), (far, 8)):
        assert search.groups().groupBy("root").count().where("count = 2").count() >= 149, edits
    assert jaccard.Search(copies(3, 1), forest).level == forest.shortest


@pytest.mark.parametrize("edits", [1, 3])
def test_near_copies_make_rows_in_proportion(spark, monkeypatch, edits):
    """Twice the near copies make twice the rows: those compared, dealt and joined."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 40)
    rnd, made = random.Random(3), []
    base = [f"b{i}" for i in range(300)]

    def texts(n):
        out = []
        for _ in range(n):
            own = list(base)
            for i in rnd.sample(range(300), edits):
                own[i] = f"x{rnd.randrange(10**9)}"
            out.append(" ".join(own))
        return spark.createDataFrame(list(enumerate(out)), "doc_id bigint, text string").repartition(3)

    write, deal = jaccard.written, jaccard.in_groups
    monkeypatch.setattr(jaccard, "written", lambda df: made.append((out := write(df)).count()) or out)
    monkeypatch.setattr(jaccard, "in_groups", lambda df, *a: made.append(df.count()) or deal(df, *a))
    totals = []
    for n in (400, 800, 1600):
        made.clear()
        kept = jaccard.one_of_each(texts(n)).count()
        totals.append(sum(made))
        assert kept == 1
    assert totals[1] < 2.3 * totals[0] and totals[2] < 2.3 * totals[1]


def test_recall_on_documents(spark):
    """Of all pairs of the documents that brute force links, at least 0.9 (the target: 0.9999) are in one group."""
    own = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    links, roots = brute_links(list(own.values()))
    got = {r["doc_id"]: r for r in queries.op4_jaccard_join(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(own) and {r["levels"] for r in got.values()} <= {5, 6, 7, 8}
    found = sum(min(got[i]["n_links"], n) for i, n in zip(own, links))
    assert sum(links) > 100 and found >= 0.9 * sum(links) and all(got[i]["n_links"] <= n for i, n in zip(own, links))
    ids = list(own)
    together = [got[i]["class_id"] == got[ids[r]]["class_id"] for i, r in zip(ids, roots) if i != ids[r]]
    assert sum(together) >= 0.9 * len(together)


def test_jaccard_cases(spark, odd, none):
    got = jaccard.join(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["class_id"] == by_id[1]["class_id"] == by_id[3]["class_id"] == 0 and by_id[90]["class_id"] == by_id[91]["class_id"]
    kept = jaccard.one_of_each(odd).collect()
    assert len(kept) == len({r["class_id"] for r in got}) and jaccard.one_of_each(odd).columns == odd.columns
    assert jaccard.join(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_one_of_each_repeated_and_null_ids(spark):
    """One row stays of every group, also if ids repeat within a group or across groups, or are null."""
    say = lambda k, n=120: " ".join(f"{k}{i * i % 97}" for i in range(n))
    near = lambda t: t + " more"
    a, b, c, d, e = (say(k) for k in "abcde")
    rows = [(5, a), (6, near(a)), (5, near(b)), (2, b), (None, near(c)), (3, c), (None, d), (None, near(d)), (9, e), (9, near(e)), (9, e)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = jaccard.one_of_each(df).collect()
    assert sorted(r["text"][0] for r in got) == list("abcde") and len(got) == 5
    assert {r["text"][0]: r["doc_id"] for r in got} == {"a": 5, "b": 2, "c": 3, "d": None, "e": 9}


# --- 5


def test_window_filling():
    rnd = random.Random(3)
    for _ in range(60):
        counts = {rnd.randint(1, 60): rnd.randint(1, 5) for _ in range(rnd.randint(1, 9))}
        used = packing.fill_window(counts, 64)
        assert max(counts) in used and all(used[k] <= counts[k] for k in used)
        items = [k for k, v in counts.items() for _ in range(v)]
        items.remove(max(items))
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= 64 - max(counts)}
        assert sum(k * v for k, v in used.items()) == max(counts) + max(sums)
        plan = packing.plan_windows(counts, 64)
        spent = {}
        for u, n in plan:
            for k, v in u.items():
                spent[k] = spent.get(k, 0) + v * n
        assert spent == counts


def check_pieces(got, texts, library, capacity):
    ids = {i: array("I", [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts}
    seen, sequences = {}, {}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] > 0 and zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    return seen, sequences


def test_packing(spark, docs, library, none):
    got = queries.op5_packing(spark, SF).collect()
    seen, sequences = check_pieces(got, docs.items(), library, 2048)
    for i, own in seen.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
    assert set(seen) == set(docs)
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 2048) * 1.01 + 1
    assert packing.pack(none, queries.vocabulary_path()).count() == 0


def test_packing_cases(spark, odd, library):
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = packing.pack(odd, queries.vocabulary_path(), capacity=64).collect()
    check_pieces(got, texts, library, 64)
    assert sum(r["length"] for r in got) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)


# --- 6


def test_quality_votes(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op6_quality_knn(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    pos, neg = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) > 0.95
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def test_quality_is_brute_force(spark):
    """Scores of the query from plain loops over the sampled labels' vectors: counts, weights, cosines and votes."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in queries.op6_quality_knn(spark, SF).collect()}
    learned, totals = knn_quality.gather(docs.select("doc_id", "text"), labels, ~knn_quality.held_out(), knn_quality.PER_LABEL)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    assert len(learned) == len(marks) == sum(totals.values()) and sum(marks.values()) == totals[1]
    counts = {i: knn_quality.count_terms(t).astype(float) for i, t in texts.items()}
    seen = sum((c > 0).astype(int) for c in counts.values())
    idf = np.log((len(texts) + 1) / (seen + 1)) + 1e-3
    vector = {i: np.log1p(c) * idf for i, c in counts.items()}
    vector = {i: v / max(np.linalg.norm(v), 1e-12) for i, v in vector.items()}
    own = sorted(marks)
    axes = np.linalg.svd(np.array([vector[i] for i in own]), full_matrices=False)[2][: knn_quality.DIMENSIONS].T
    place = {i: v @ axes for i, v in vector.items()}
    far = 0
    for i in list(texts)[:80]:
        cosines = [float(place[i] @ place[j] / max(np.linalg.norm(place[i]) * np.linalg.norm(place[j]), 1e-12)) for j in own]
        top = sorted(range(len(own)), key=lambda j: -cosines[j])[: knn_quality.NEIGHBOURS]
        w = [max(0.0, cosines[j]) ** knn_quality.POWER for j in top]
        far = max(far, abs(got[i] - sum(x * marks[own[j]] for x, j in zip(w, top)) / sum(w)))
    assert far < 0.02


def test_vote_is_exact():
    rng = np.random.default_rng(4)
    cos, marks = rng.uniform(-1, 1, (9, 40)), rng.integers(0, 2, 40).astype(float)
    got = knn_quality.vote(cos, marks, 0.5, k=5)
    for c, g in zip(cos, got):
        top = np.argsort(-c)[:5]
        w = np.clip(c[top], 0, 1) ** knn_quality.POWER
        assert g == pytest.approx((w * marks[top]).sum() / w.sum())


def test_quality_cases(spark, odd, none):
    labels = labels_of(spark, [(4, 1), (5, 0), (6, 1), (7, 0), (None, 1), (8, None)])
    got = knn_quality.score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (0, 1)} == {0.5}
    assert knn_quality.score(none, labels).count() == 0
    assert all(r["score"] == 0.5 for r in knn_quality.score(odd, labels_of(spark, [])).collect())


# --- 7


@pytest.mark.parametrize("size", [0, 1, 64, 169, 170, 171, 175, 176, 177, 178, 183, 184, 185, 352, 353, 354, 355, 356, 16384, 16385, 70000, 200_001])
def test_transport_stream(size):
    data = random.Random(size).randbytes(size)
    stream = media_ts.mux(data)
    s = media_ts.demux(stream)
    assert s.payload == data and not s.continuity_errors and not s.crc_errors and not s.sync_errors and len(stream) % 188 == 0
    units = -(-size // media_ts.UNIT)
    assert s.stamps == [3600 * (i + 1) for i in range(units)] and s.random_access == list(range(0, units, 4)) and s.programs == s.streams == 1


def test_transport_stream_errors():
    data = random.Random(1).randbytes(50_000)
    packets = [media_ts.mux(data)[i : i + 188] for i in range(0, len(media_ts.mux(data)), 188)]
    again = media_ts.demux(b"".join(p for i, p in enumerate(packets) for _ in range(2 if i == 20 else 1)))
    assert again.payload == data and again.continuity_errors == 0
    assert media_ts.demux(b"".join(packets[:20] + packets[21:])).continuity_errors == 1
    assert media_ts.demux(b"\0" * 188 + b"".join(packets)).sync_errors == 1
    broken = bytearray(b"".join(packets))
    broken[10] ^= 1
    assert media_ts.demux(bytes(broken)).crc_errors >= 1
    assert media_ts.demux(b"").payload == b""


def test_media_columns(spark, odd, none):
    from pyspark.sql import functions as F

    got = odd.select("text", media_ts.media_column(F.col("text")).alias("m")).select("text", "m", media_ts.features_column(F.col("m")).alias("f")).collect()
    for r in got:
        own = media_ts.padded((r["text"] or "").encode())
        assert len(own) % 64 == 0 < len(own)
        assert r["f"]["payload_sha256"] == hashlib.sha256(own).hexdigest() and r["f"]["tail_crc32"] == zlib.crc32(own[-64:]) and r["f"]["media_bytes"] == len(r["m"])
    assert none.select(media_ts.media_column(F.col("text"))).count() == 0


def plain_demux(data):
    """Payload and feature of a stream, packet by packet."""
    counters, units, rap, stamps, payload, errors, tables = {}, 0, [], [], b"", 0, set()
    for at in range(0, len(data), 188):
        p = data[at : at + 188]
        assert p[0] == 0x47
        pid, counter, kind = (p[1] & 31) << 8 | p[2], p[3] & 15, p[3] >> 4 & 3
        errors += pid in counters and counter != (counters[pid] + 1) % 16
        counters[pid] = counter
        body = p[5 + p[4] :] if kind == 3 else p[4:]
        if pid != 0x100:
            tables.add(pid)
            continue
        if p[1] & 0x40:
            assert body[:3] == b"\0\0\1"
            if kind == 3 and p[4] and p[5] & 0x40:
                rap.append(units)
            t = body[9:14]
            stamps.append(int(f"{t[0] >> 1 & 7:03b}{t[1]:08b}{t[2] >> 1:07b}{t[3]:08b}{t[4] >> 1:07b}", 2))
            units += 1
            body = body[14:]
        payload += body
    assert tables == {0, 0x1000}
    shown = f"{stamps[0]}-{stamps[-1]}"
    return payload, f"programs=1;streams=1;packets={len(data) // 188};units={units};pts={shown};rap={','.join(map(str, rap))};cc={errors};crc=0;sync=0"


def test_media_query_is_brute_force(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stored = {r["doc_id"]: (r["text"], bytes(r["m"])) for r in docs.select("doc_id", "text", media_ts.media_column(F.col("text")).alias("m")).collect()}
    got = queries.op7_transport_stream(spark, SF).collect()
    assert len(got) == len(stored)
    for r in got:
        text, media = stored[r["doc_id"]]
        payload, feature = plain_demux(media)
        assert payload == media_ts.padded(text.encode()) and r["feature"] == feature and r["n_bytes"] == len(text.encode()) and r["payload_bytes"] == len(payload)
        assert r["media_sha256"] == hashlib.sha256(media).hexdigest() and r["media_bytes"] == len(media) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()


# --- 8


def test_shards(spark, odd, none):
    got = queries.op8_byte_shards(spark, SF).orderBy("shard", "slot").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(docs)
    sizes = [len((docs[i] or "").encode()) + 16 for i in order]
    total, before, slots = sum(sizes), 0, {}
    assert [r["doc_id"] for r in got] == order
    for r, size in zip(got, sizes):
        shard = min(39, before * 40 // total)
        assert (r["size"], r["shard"], r["slot"], r["grown_shard"], r["law"]) == (size, shard, slots.get(shard, 0), None, "bytes")
        assert r["text_crc32"] == zlib.crc32((docs[r["doc_id"]] or "").encode())
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    own = sharding.shard_by_bytes(odd, shards=3).collect()
    assert len(own) == odd.count()
    for k in {r["shard"] for r in own}:
        assert sorted(r["slot"] for r in own if r["shard"] == k) == list(range(sum(r["shard"] == k for r in own)))
    assert sharding.shard_by_bytes(none).count() == 0


# --- 9


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_language_cases(spark, odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 3)} == {"und"}
    assert langid.identify(none).count() == 0
    one = spark.createDataFrame([(1, "hello there", "en"), (2, "123", "en")], "doc_id bigint, text string, lang string")
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 3)) for r in langid.identify(one).collect()} == {1: ("en", 1.0), 2: ("und", 0.0)}


def test_languages_are_brute_force(spark):
    """Predictions and scores of the query from plain loops over the learned weights."""
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, SF).collect()}
    names, idf, w, t = langid.model_of(docs, ~langid.held_out())
    rows = docs.select("doc_id", "text", "lang").collect()
    taught = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    seen = sum((langid.count_grams(r["text"]) > 0).astype(int) for r in taught)
    assert np.allclose(idf, np.log((len(taught) + 1) / (seen + 1)) + 1e-3, atol=1e-4) and names == sorted({r["lang"] for r in taught})
    for r in rows[:120]:
        c = langid.count_grams(r["text"])
        x = [math.log1p(n) * float(idf[i]) for i, n in enumerate(c)]
        size = math.sqrt(sum(v * v for v in x))
        scores = [sum(v * float(w[i, k]) for i, v in enumerate(x) if v) / size / t for k in range(len(names))]
        e = [math.exp(v - max(scores)) for v in scores]
        best = max(range(len(names)), key=lambda k: scores[k])
        assert got[r["doc_id"]]["lang_pred"] == names[best] and got[r["doc_id"]]["score"] == pytest.approx(e[best] / sum(e), abs=1e-3)


def test_training_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        y = i % 2
        at = np.unique(np.r_[rng.integers(0, 50, 5) + 50 * y, rng.integers(100, 4000, 10)])
        rows.append((y, at, np.full(len(at), 1 / np.sqrt(len(at))), i % 5 == 0))
    w, t = langid.train(rows, 2)
    assert (w == 0).mean() > 0.3 and 0.05 <= t <= 5
    assert np.mean([(x @ w[at]).argmax() == y for y, at, x, _ in rows]) > 0.95


@pytest.mark.parametrize("langs", [("en", "de"), ("en", "de", "es", "fr"), ()])
def test_language_stage(spark, langs):
    """Foreign and garbled texts go, clean and mixed ones stay, for two languages as for four; all stay without a label."""
    import corpus_pipeline

    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 300").orderBy("doc_id").collect() if not langs or r["lang"] in langs]
    rng = random.Random(7)
    garbled = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (20, 60, 400)]
    shuffled = ["".join(rng.sample(t, len(t))) for t in (docs[0]["text"], docs[5]["text"])]
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    ]
    texts = {k: [r["text"] for r in docs if r["lang"] == k] for k in langs}
    mixed = ["\n".join(texts[k][i][:250] for k in langs) for i in range(4)] if langs else []
    rows = [(r["doc_id"], r["text"], r["lang"] if langs else None, "s", 0) for r in docs]
    planted = {1_000_000 + i: t for i, t in enumerate(garbled + shuffled + foreign)}
    fine = {2_000_000 + i: t for i, t in enumerate(mixed)}
    rows += [(i, t, None, "s", 0) for i, t in (planted | fine).items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, df, SF).collect()}
    assert set(fine) <= got and got & set(planted) == (set() if langs else set(planted))
    assert len({r["doc_id"] for r in docs} - got) <= 0.01 * len(docs)


def test_language_bounds():
    scores, labels = np.r_[np.linspace(-6, -5, 101), -9.0], np.r_[np.zeros(101, int), 1]
    a, b = langid.bounds_of(scores, labels, 2)
    assert a == pytest.approx(-6.48) and b < -9
    assert np.isneginf(langid.bounds_of(scores[:5], labels[:5], 2)).all()


def test_familiar_is_of_all_rows(spark):
    """Counts and bounds from plain loops over every labelled row, also when the model's sample is smaller than the table."""
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(400).collect()]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs] + [(1_000_000, "zzq qqz " * 50, docs[0]["lang"]), (1_000_001, "", "en"), (1_000_002, "one of few", "rare"), (None, "no id", "en")]
    table, variance, bounds = langid.familiar_of(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5), sample=50)
    own = [(lang, langid.count_letter_grams(t)) for i, t, lang in rows if i is not None and lang is not None and t is not None]
    names = sorted({x for x, _ in own})
    totals = np.array([sum(c for x, c in own if x == name) for name in names])
    assert np.allclose(table, langid.likelihoods(totals), atol=1e-5)
    scores, labels = [], []
    for lang, c in own:
        if c.any():
            left = totals.copy()
            left[names.index(lang)] -= c
            scores.append(langid.likelihoods(left) @ c / c.sum() + langid.allowance(c.sum(), variance))
            labels.append(names.index(lang))
    assert np.allclose(bounds, langid.bounds_of(np.array(scores), np.array(labels), len(names)), atol=2e-3)
    more = langid.gram_totals(spark.createDataFrame([(i % 700, "ab") for i in range(2100)], "label int, text string").repartition(2), 700)
    assert (more == 3 * langid.count_letter_grams("ab")).all()


def test_weighted_quantiles():
    rng = np.random.default_rng(1)
    values, counts = rng.normal(size=40), rng.integers(1, 9, 40)
    for q in (0, 0.01, 0.37, 0.5, 1):
        assert langid.quantile(values, counts, q) == pytest.approx(np.quantile(np.repeat(values, counts), q))


# --- 10


def test_licences(spark, odd, none):
    wrap = "Copyright (c) 2020 Someone\n\n" + license_scan.MIT.upper().replace("SUBLICENSE", "SUBLICENCE").replace(", ", ",\n ")
    rows = [(1, license_scan.MIT), (2, wrap), (3, license_scan.MIT + " x"), (4, license_scan.BSD_HEAD + license_scan.BSD_TAIL), (5, "© 2021 A\nAll rights reserved.\n" + license_scan.ZLIB.replace("acknowledgment", "acknowledgement")), (6, None), (7, "")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: r["license_id"] for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: None, 4: "BSD-2-Clause", 5: "Zlib", 6: None, 7: None}
    assert got[6]["digest"] is None and got[7]["digest"] == hashlib.sha256(b"").hexdigest()
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(none).count() == 0


def test_one_line_licences(spark):
    """A statement goes without what follows it on its line."""
    flat = lambda t: " ".join(t.split())
    long = lambda w: "Copyright 2020 Acme Inc. " + " ".join(f"{w}{i}" for i in range(200))
    texts = [
        "Copyright (c) 2020 X " + flat(license_scan.MIT), "MIT License Copyright (c) 2020 X, Y and others. All rights reserved. " + flat(license_scan.MIT), "© 2021 A. " + flat(license_scan.ISC),
        "(c) 2019 B " + flat(license_scan.BSD_HEAD + license_scan.BSD_TAIL), "Copyright 2018 C\n" + license_scan.ZLIB, long("a"), long("b"), long("a").replace("Acme", "Other"), "© 2020 X\n", "© 2021 Y, Z",
        "© " + "word " * 200,
    ]
    got = [r for r in sorted(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect(), key=lambda r: r["doc_id"])]
    assert [r["license_id"] for r in got] == ["MIT", "MIT", "ISC", "BSD-2-Clause", "Zlib"] + [None] * 6
    nothing, d = hashlib.sha256(b"").hexdigest(), [r["digest"] for r in got]
    assert d[5] == d[7] and len({d[5], d[6], d[10], nothing}) == 4 and d[8] == d[9] == nothing
    every = license_scan.KNOWN + license_scan.whole_texts()
    again = license_scan.scan(spark.createDataFrame([(i, flat(t)) for i, (_, t) in enumerate(every)], "doc_id bigint, text string")).collect()
    assert all(r["license_id"] == every[r["doc_id"]][0] for r in again)


def test_whole_licences(spark):
    """Longer licences are found by their whole text, reflowed, and without what is appended to their terms; a notice inside
    a longer text is not; added texts are found, up to a bound."""
    folder = license_scan.Path(license_scan.__file__).parent / "licences"
    texts = {p.stem: p.read_text() for p in folder.glob("*.txt")}
    wanted = {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "BSL-1.0", "CC0-1.0", "Unlicense"}
    assert set(texts) == wanted
    rows, want = [], {}
    for name, t in texts.items():
        cut = t.split("END OF TERMS AND CONDITIONS")[0]
        for x in (t, t.upper(), t.replace("\n", "\n\n  "), cut):
            want[len(rows)] = name
            rows.append((len(rows), x))
    for x in ("words before. Licensed under the Apache License, Version 2.0.", "An own licence, free for all.", texts["MPL-2.0"][:5000]):
        want[len(rows)] = None
        rows.append((len(rows), x))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["license_id"] for r in license_scan.scan(docs).collect()} == want
    more = spark.createDataFrame([("Own", "AN OWN LICENSE\nfree for all"), ("Other", texts["MPL-2.0"]), ("None", None)], "license_id string, text string")
    own = next(i for i, x in rows if x.startswith("An own"))
    assert {r["doc_id"]: r["license_id"] for r in license_scan.scan(docs, more).collect()} == want | {own: "Own"}
    with pytest.raises(ValueError):
        license_scan.scan(docs, spark.range(license_scan.MOST_KNOWN + 1).selectExpr("'x' as license_id", "cast(id as string) as text"))


def test_wrapped_and_respelled_licences(spark):
    """Whole texts are found on lines of one or a few words, where their own copyright statements are cut, and with other spellings."""
    texts = dict(license_scan.whole_texts())
    few = lambda t, n: "\n * ".join(" ".join(w[i : i + n]) for w in [t.split()] for i in range(0, len(w), n))
    british = lambda t: t.replace("icense", "icence").replace("rganiz", "rganis").replace("noncomm", "non-comm")
    names = ["Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "CC0-1.0", "Unlicense"]
    forms = [lambda t: few(t, 1), lambda t: few(t, 5), british, lambda t: british(few(t, 1))]
    rows = [(i * 10 + j, form(texts[x]), x) for i, x in enumerate(names) for j, form in enumerate(forms)]
    rows += [(1000 + i, few(texts[x] + " but", 1), None) for i, x in enumerate(names)]
    got = license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["license_id"] for r in got} == {i: x for i, _, x in rows} and len(got) == len(rows)


def test_licence_words(spark):
    """Whole words only are unified; lines that name a holder go, sentences about copyright stay."""
    digest = lambda *t: [r["digest"] for r in sorted(license_scan.scan(spark.createDataFrame(list(enumerate(t)), "doc_id bigint, text string")).collect(), key=lambda r: r["doc_id"])]
    a, b, c, d = digest("a programmer", "a programr", "licence licence sub-license", "license license sublicense")
    assert a != b and c == d
    a, b, c, d, e, f = digest("x", "Copyright The Example Project Developers\nx", "Copyright by Acme\nx", "copyright notice is kept\nx", "Copyright Jane Doe\nx", "copyright law\nx")
    assert a == b == c == e and len({a, d, f}) == 3


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = c.sql(f"select {', '.join(names)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want, key=repr)


# --- the rest


def test_pick_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id bigint, text string, x string").toDF("doc_id", "text", "TEXT")
    assert [tuple(r) for r in common.pick(df, "doc_id", "text").collect()] == [(1, "a")]
    with pytest.raises(ValueError):
        common.pick(df, "lang")


def test_workers_give_memory_back(spark, monkeypatch):
    """When a worker goes on to another operator, and at the end of a task; small tables need no workers of their own."""
    given = []
    monkeypatch.setattr(common, "KEPT", {"one": {1: 2}})
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    assert common.kept("one") and not given
    assert not common.kept("two") and len(given) == 1
    assert list(common.ending(iter)([1, 2])) == [1, 2] and len(given) == 2
    rows = [(1, "a", 0.5), (None, None, None)]
    df = common.local_table(spark, rows, "x bigint, y string, z double")
    assert df.collect() == rows and df.dtypes == [("x", "bigint"), ("y", "string"), ("z", "double")]
    assert common.local_table(spark, [], "x int").count() == 0


@pytest.fixture(scope="module")
def odd_documents(spark, odd):
    """Documents with nulls in every column, empty and very long texts, repeated rows, and columns that differ in case only."""
    own = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = odd.selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "cast(size as bigint) as n_chars")
    more = more.unionByName(spark.createDataFrame([(7, "x" * 200_000, "en", "s", None), (None, None, None, None, None)], own.schema))
    return own.unionByName(own.limit(5)).unionByName(more).selectExpr("*", "'clash' as clash", "'b' as more").toDF("doc_id", "text", "lang", "source", "n_chars", "TEXT", "Doc_Id").repartition(3)


def test_pipeline_cases(spark, odd_documents, none):
    import corpus_pipeline

    names = corpus_pipeline.COLUMNS
    every = {tuple(r) for r in common.pick(odd_documents, *names).collect()}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd_documents, SF).collect()
        if name == "packing":
            assert sum(r["start"] == 0 for r in got) == odd_documents.count()
        else:
            assert got and list(got[0].asDict()) == names and {tuple(r) for r in got} <= every
        left = {r["doc_id"] for r in got}
        if name == "quality_rules":
            assert not {100_000, 100_001, None} & left
        elif name == "language_id":
            assert not {100_000, 100_001} & left
        elif name == "near_duplicates":
            groups = jaccard.join(common.pick(odd_documents, "doc_id", "text")).select("class_id").distinct().count()
            assert len(got) == groups
        empty = stage(spark, none, SF)
        assert empty.count() == 0 and (name == "packing" or empty.columns == names)


def test_pipeline_quality_is_brute_force(spark):
    """What the stage keeps is what the base rules and the learned list keep, worked out in Python."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = decision_list.learn_from(docs, labels)
    assert rules
    want = set()
    for r in docs.collect():
        if not brute_verdict(r["text"], rules)[0]:
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()} == want
    judged = {r["doc_id"]: r for r in queries.op3_decision_list(spark, sf).collect()}
    assert {i for i, r in judged.items() if r["kept"]} == want and len(judged) == docs.count()
    for r in docs.limit(200).collect():
        assert judged[r["doc_id"]]["rule"] == brute_verdict(r["text"], rules)[1]


def brute_verdict(text, rules):
    """Whether a text is rejected, and the number of the first rule that covers it."""
    n_words, word_chars, n_symbols, n_dup, n_repeat = brute_statistics(text) if len((text or "").split()) < 1500 else decision_list.statistics(text)[:5]
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    n_lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n"))
    w, c, lines = max(1, n_words), max(1, word_chars), max(1, n_lines)
    raw = text or ""
    values = {
        "symbols_a_word": n_symbols / w, "chars_a_word": word_chars / w, "dup_lines": n_dup / lines, "repeated_words": n_repeat / w, "distinct_words": len(set(words)) / w,
        "adjacent_words": sum(a == b for a, b in zip(words, words[1:])) / w, "upper_chars": sum("A" <= x <= "Z" for x in raw) / c, "digit_chars": sum("0" <= x <= "9" for x in raw) / c,
        "bangs_a_word": raw.count("!") / w, "words_a_line": n_words / lines,
    }
    holds = lambda x: values[x.name] > x.threshold if x.above else values[x.name] <= x.threshold
    first = next((i for i, rule in enumerate(rules, 1) if all(map(holds, rule))), 0)
    return n_words < 20 or 100 * n_repeat > 30 * n_words or first > 0, first


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, SF))
        if i < 3:
            assert docs.columns == names and 0 < docs.count() < before + 1
            before = docs.count()
            kept = docs
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in kept.collect()}
    links, _ = brute_links([r["text"] for r in kept.collect()])
    assert not any(links)


def test_licence_variants_are_scanned_once(spark, rows):
    """Rewritings that give the same text are scanned once, with the results of scanning each document."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, s) for i in range(600) for s in ("a", "b", None)] + [(None, "a"), (3, "a")], "doc_id bigint, source string")
    own = license_scan.rewritings(docs)
    keys = own.select(*license_scan.REWRITING).distinct().count()
    assert keys < own.count()
    few = docs.where("doc_id is null or doc_id % 7 = 3")
    assert rows(license_scan.scan_variants(few)) == rows(license_scan.scan(license_scan.variants(few)).select("doc_id", "license_id"))
    plain = spark.createDataFrame([(1, "no mark in it"), (2, "Copyright 2020 x\ny"), (3, "ALL RIGHTS RESERVED.\nz"), (4, "© 2020\nw"), (5, None)], "i int, text string")
    got = {r["i"]: r["t"] for r in plain.select("i", license_scan.without_statements(F.lower("text")).alias("t")).collect()}
    assert got == {1: "no mark in it", 2: "\ny", 3: "\nz", 4: "\nw", 5: None}
