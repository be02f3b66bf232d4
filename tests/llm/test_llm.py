"""The training-data operators against brute force, libraries, SQL and edge cases."""

import hashlib
import os
import random
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tidewright.llm import bpe, chat, decontamination, lm_scores, near_duplicates, quality, queries, revisits, sharding, substrings, token_counts  # noqa: E402
from tidewright.llm.common import ready, shared_folder  # noqa: E402
from tools.check import canon, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def word(rng):
    return "".join(rng.choice("abcdeÉü") for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, short, empty and null texts, and one very long word."""
    rng = random.Random(5)
    base = [[word(rng) for _ in range(rng.choice([3, 40, 120, 300]))] for _ in range(14)]
    passage = [word(rng) for _ in range(70)]
    texts = [None, "", " \t\n", "one", "x" * 9000, "One", "one two three four", "A, b.\nA, b.\n"]
    for w in base:
        texts += [" ".join(w), "\n".join(w)]
        near = list(w)
        near[rng.randrange(len(near))] = "changed"
        texts += [" ".join(near), " ".join(w[:60] + passage + w[60:])]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    ready(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words string")


def got(df):
    return sorted(map(tuple, df.collect()))


def test_decontamination(spark, rows, docs):
    items = [(1, " ".join(rows[8][1].split()[:2])), (2, rows[-1][1]), (10, "one"), (3, None), (4, "!!"), (10, "one two")]
    df = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    df = df.selectExpr("doc_id", "n_words", "n_hit", "n_items", "sha2(array_join(items, ','), 256)", "contaminated")
    assert got(df) == sorted(brute.decontamination(rows, items))


def test_substrings(rows, docs):
    df = substrings.remove_repeats(docs.drop("n_words"))
    assert got(df.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256)")) == sorted(brute.substrings(rows))


def test_near_duplicates(rows, docs):
    assert got(near_duplicates.near_duplicates(docs)) == sorted(brute.near_duplicates(rows))


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    sig = near_duplicates.superminhash(np.concatenate([x[:800], x[200:]]), np.array([0, 800, 1600]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08
    parts = sig >> np.uint64(32)
    assert parts.max() < 512 and near_duplicates.superminhash(x[:0], np.array([0, 0]), 8).shape == (1, 8)


def test_odd_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 50, 300, 5000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.concatenate([x[n // 5 :], rng.integers(0, 1 << 63, n // 7).astype(np.uint64)])
        odd = near_duplicates.odd_sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        apart = int(np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum())
        assert apart <= n // 5 + n // 7 and (n != 300 or apart > 85)


def test_shared_folder_without_setting(spark):
    folder = shared_folder(spark)
    assert folder and folder == shared_folder(spark)


def test_encoding_equals_the_library():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(PATH), bpe.load(PATH), random.Random(2)
    parts = ["a", " ", "  ", "\n", "'", "'re", "1", "--", "<|endoftext|>", "<|end", "é", "漢", "　", "🙂", "the", " the", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += ["a" * 30000 + " b", " " * 30000 + "x", "=-" * 9000 + "1" * 9000]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        for chunk in (1, 7, 5000) if len(t) < 100 else (5000,):
            assert bpe.encode_text(own, t, chunk).tolist() == want
        assert bpe.decode_ids(own, np.array(want, np.int32), 3) == library.decode(want, skip_special_tokens=False)
    assert token_counts.counter(PATH).count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pretoken_patterns_agree():
    for c in map(chr, range(0x250)):
        for t in (c, f"a{c}1{c}.{c} {c}{c}a", f"'{c}re"):
            assert bpe.PRETOKEN.findall(t) == bpe.NARROW.findall(t)


def test_lookahead_needs_an_ordered_list():
    assert bpe.sufficient_lookahead([(b"a", b"b"), (b"ab", b"c")]) == 2
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([(b"ab", b"c")])


def test_token_cache(spark, docs, rows):
    cache = f"{shared_folder(spark)}/cache-test"
    few = docs.where("doc_id < 20")
    token_counts.fill_cache(few, cache, PATH)
    first = spark.read.parquet(cache).count()
    df = token_counts.count_tokens(docs, cache, PATH)
    want = {i: len(bpe.encode_text(bpe.load(PATH), t)) for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in df.collect()} == want
    assert first == len({t or "" for i, t in rows if i < 20}) and spark.read.parquet(cache).count() == len({t or "" for _, t in rows})


def joined_columns(df):
    """Names of the columns that the outermost join of a query takes from its left side."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    out = node.children().apply(0).output()
    return {out.apply(i).name() for i in range(out.size())}


def test_texts_do_not_move_to_their_counts(spark):
    df = queries.op10_token_counts(spark, FOLDER)
    assert not {"_given", "text"} & joined_columns(df)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {r.doc_id: r.n_bytes for r in df.collect()} == {i: len(t.encode()) for i, t in texts.items()}


def test_substring_stage_cuts_each_text_once(docs, rows):
    df = corpus_pipeline.substring_dedup(docs.sparkSession, docs, "")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    cut = {d: (n, m) for d, n, m, _ in brute.substrings(rows)}
    assert {r.doc_id: len((r.text or "").split()) for r in df.collect()} == {d: n - m for d, (n, m) in cut.items() if m == 0 or m < n}


def test_sharding(docs, rows):
    out = sharding.shard_documents(docs.union(docs.where("doc_id = 3")), 5).collect()
    assert len(out) == len(rows) + 1
    for s in range(5):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    of = {}
    for r in out:
        assert of.setdefault(rows[r.doc_id][1], r.shard) == r.shard
    assert {r.doc_id: r.size for r in out}[0] == 16


def test_longest_first():
    assert sharding.longest_first([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_quality_counts(docs, rows):
    for r in quality.judge(docs).collect():
        t = rows[r.doc_id][1] or ""
        w = brute.words(t)
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeat = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)}
        lines = [x for x in t.split("\n") if brute.words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(repeat))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (r.base_failed and r.kept)


@pytest.mark.parametrize("lang", ["en", "xx"])
def test_quality_with_a_third_of_junk(spark, lang):
    """Junk in a third of the rows, among it one very long text, is still rejected, and the verdict is that of brute force."""
    rng = random.Random(3)
    shares = {w: n for w, n in zip(quality.COMMON["en"], quality.REFERENCES["en"][1])}
    made = lambda: "".join(rng.choice("bcdfgklmnprstz") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))

    def text(common, n):
        return " ".join(rng.choices(list(shares), shares.values())[0] if rng.random() < common else made() for _ in range(n)) + "."

    texts = [text(0.25, 400) for _ in range(40)] + [text(0.0, 400) for _ in range(19)] + [text(0.0, 60_000)]
    texts += texts[-2:-1] * 30  # copies have one vote
    df = ready(spark).createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.judge(df).where("kept").collect()}
    seen = {r.doc_id: r for r in quality.measure(df).collect()}
    first = {t: i for i, t in reversed(list(enumerate(texts)))}.values()

    def reference(k, h):
        if lang in quality.REFERENCES:
            return quality.REFERENCES[lang][k]
        votes = [[int(x * quality.GRAIN / sum(getattr(seen[i], h)) + 0.5) for x in getattr(seen[i], h)] for i in first]
        return [sorted(v)[(len(v) - 1) // 2] for v in zip(*votes)]

    def distance(a, b):
        p, q = np.array(a) / sum(a), np.array(b) / sum(b)
        half = lambda x: sum(v * np.log2(v / m) for v, m in zip(x, (p + q) / 2) if v)
        return ((half(p) + half(q)) / 2) ** 0.5

    refs = [reference(0, "h_classes"), reference(1, "h_common")]
    good = {i for i, r in seen.items() if distance(r.h_classes, refs[0]) <= quality.MAX_CLASSES and distance(r.h_common, refs[1]) <= quality.MAX_COMMON}
    assert not any(r.base_failed for r in seen.values()) and kept == good
    if lang == "en":
        assert kept == set(range(40))


def test_references_can_be_fitted_again(spark):
    """The fit gives nearly the fixed references; ids of one table, repeated rows and other languages do not count."""
    data = "/root/testdata/sf0.1"
    docs, labels = (ready(spark).read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    more = docs.where("doc_id < 50").withColumn("lang", F.lit("xx")).union(docs.where("doc_id < 50")).union(docs.where("doc_id < 50").withColumn("doc_id", F.lit(None).cast("long")))
    got = {r.lang: (r.n_texts, r.h_classes, r.h_common) for r in quality.fit_references(docs.union(more), labels).collect()}
    assert set(got) == set(quality.REFERENCES) and (got["de"][0], got["es"][0]) == (412, 275)
    for lang, fixed in quality.REFERENCES.items():
        for mine, given in zip(got[lang][1:], fixed):
            assert len(mine) == len(given) and max(abs(a - b) for a, b in zip(mine, given)) <= 50
    assert quality.fit_references(docs.limit(0), labels).count() == 0


def test_bloom_filter_has_no_false_misses():
    bits = np.zeros(decontamination.BLOOM_BITS // 32, np.uint32)
    rng = np.random.default_rng(3)
    held, other = rng.integers(-(1 << 63), 1 << 63, 5000), rng.integers(-(1 << 63), 1 << 63, 5000)
    for b in np.concatenate(decontamination.bloom_bits(held)):
        bits[b // 32] |= np.uint32(1 << (b % 32))
    assert decontamination.bloom_has(bits, held).all() and decontamination.bloom_has(bits, other).sum() < 5


def test_scores_alike_both_ways(spark, docs):
    good = docs.where("doc_id % 2 = 0").select("doc_id")
    a, b = (got(lm_scores.score(docs, good, n)) for n in (10**6, 0))
    for x, y in zip(a, b):
        assert x[:2] == y[:2] and (x[4] is None) == (y[4] is None) and (x[4] is None or abs(x[4] - y[4]) < 1e-9)


def test_scores_equal_plain_counts(spark, rows, docs):
    """Also with repeated rows, a null id, ids that no document has, and no target at all."""
    more = rows + [rows[12], (None, "a bc"), (None, None)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more[len(rows) :], "doc_id long, text string"))
    for good in ({i for i, _ in rows if i % 3}, set()):
        ids = spark.createDataFrame([(i,) for i in [*good, *good, 10**6, None]], "doc_id long")
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        out, want = sorted(map(tuple, lm_scores.score(df, ids).collect()), key=key), sorted(brute.lm_scores(more, good), key=key)
        assert [r[:2] for r in out] == [r[:2] for r in want]
        for a, b in zip(out, want):
            assert all((x is None and y is None) or abs(x - y) < 1e-9 for x, y in zip(a[2:], b[2:]))


def test_scores_of_empty_tables(spark, docs):
    none = docs.limit(0)
    assert lm_scores.score(none, none.select("doc_id")).count() == 0


def test_bpe_query_equals_the_library(spark):
    """Every column of the registered query, over whole texts."""
    from tokenizers import Tokenizer

    library, sha = Tokenizer.from_file(PATH), lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    out = queries.op3_bpe(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_sharding_query_on_whole_texts(spark):
    """Sizes, checksums, whole groups, gapless slots and loads as near as the largest group allows."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    out = queries.op5_sharding(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    group, of = {}, {}
    for r in out:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert of.setdefault(texts[r.doc_id], r.shard) == r.shard
        group[texts[r.doc_id]] = group.get(texts[r.doc_id], 0) + r.size
    load = [sum(r.size for r in out if r.shard == s) for s in range(queries.SHARDS)]
    assert max(load) - min(load) <= max(group.values())
    for s in range(queries.SHARDS):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_chat_edges(spark):
    t = [(1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, None, "b"), (4, 0, None, None), (4, 0, None, None), (None, 0, "user", "z"), (5, None, "user", "z"), (6, 0, None, "")]
    t += [(7, i, "user", str(i)) for i in range(3000)] + [(8, i, "user", str(i)) for i in range(2000)]
    out = chat.format_chats(ready(spark).createDataFrame(t, "conv_id long, turn long, role string, text string"))
    r = {(x.conv_id, x.part): x for x in out.collect()}
    assert {k[0] for k in r} == {1, 4, 6, 7} and r[7, 0].n_parts == 12 and r[4, 0].n_turns == 1
    assert r[1, 0].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>unknown\nb<|im_end|>\n"
    assert "".join(r[7, p].text for p in range(12)).count("im_end") == 3000


def test_revisit_edges(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "response", "http://WWW.a.com/x/?b=1&a=2#f", 1, h(ETag='"e"', Content_Type="t", Date="1"), None),
        (2, "revisit", "https://a.com/x?a=2&b=1&utm_source=q", 2, h(etag='W/"e"', Content_Type="no", Date="2"), None),
        (3, "revisit", "http://a.com/x?a=2&b=1", 1, h(etag='"e"'), None),
        (4, "revisit", "http://a.com/x?a=2&b=1", 5, h(etag='"other"'), None),
        (5, "revisit", "http://a.com/x?a=2&b=1", 5, None, None),
        (6, "revisit", None, 5, h(etag='"e"'), None),
    ]
    df = revisits.resolve(ready(spark).createDataFrame(rows, "record_id long, kind string, url string, ts long, headers map<string,string>, digest string"))
    r = {x.record_id: x for x in df.collect()}
    assert [r[i].status for i in (2, 3, 4, 5, 6)] == ["resolved", "no_response", "mismatch", "no_validator", "no_response"]
    assert r[2].headers == {"etag": 'W/"e"', "content-type": "t", "date": "2"} and r[2].resolved_id == 1


def test_repeated_responses_give_one_row_per_revisit(spark):
    """Copies of a response neither multiply the revisits of its range nor reach one before it."""
    tag = {"etag": "e"}
    rows = [(1, "revisit", "http://a.com/x", 1, tag, None)] + [(2, "response", "http://a.com/x", 2, tag, None)] * 3
    rows += [(3, "revisit", "http://a.com/x", 3, tag, None), (4, "revisit", "http://a.com/x", 4, tag, None)]
    df = revisits.resolve(ready(spark).createDataFrame(rows, "record_id long, kind string, url string, ts long, headers map<string,string>, digest string"))
    assert sorted((r.record_id, r.status, r.resolved_id) for r in df.collect()) == [(1, "no_response", None), (3, "resolved", 2), (4, "resolved", 2)]


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    clean = lambda df: canon(df.astype(object).where(df.notna(), None))
    assert clean(queries.QUERIES[name](spark, FOLDER).toPandas()) == clean(connect(FOLDER).sql(queries.SQL[name]).df())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (near_duplicates.near_duplicates(none), substrings.remove_repeats(none.drop("n_words")), decontamination.contamination(none, items), quality.judge(none), sharding.shard_documents(none)):
        assert df.count() == 0
    assert decontamination.contamination(docs, items).where("n_hit > 0").count() == 0


def test_pipeline(spark):
    data = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    kept = {r.doc_id for r in quality.judge(data).where("kept").collect()}
    docs = [(r.doc_id, r.text) for r in data.collect() if r.doc_id in kept]
    near = {d for d, _, _, k in brute.near_duplicates(docs) if k}
    docs = [d for d in docs if d[0] in near]
    cut = {d: (n, m, s) for d, n, m, s in brute.substrings(docs)}
    assert set(out) <= {d for d in near if cut[d][1] < cut[d][0]} and all(r.round_trip for r in out.values())
    clean = {d: t for d, t in docs if cut[d][1] == 0}
    for d in set(clean) & set(out):
        ids = bpe.encode_text(bpe.load(PATH), clean[d]).tolist()
        assert out[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.decontamination(list(clean.items()), items) if r[5]}
    assert not bad & set(out) and set(clean) - bad <= set(out)
