"""Prefix trie, tokenizer alignment, quality classifier, and exactness of hashes, bands and row keys."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
from tidewright.llm import alignment, bpe, conversation_trie, decontamination, near_duplicates, quality_classifier, substrings, token_counts  # noqa: E402
from tidewright.llm.common import ready, shared_folder  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
THUE = "".join("ab"[i.bit_count() % 2] for i in range(1024))
MORSE = THUE.translate({97: 98, 98: 97})  # a polynomial modulo 2^64 gives both words one value


@pytest.fixture(scope="module")
def spark_(spark):
    return ready(spark)


def order(rows):
    return sorted(rows, key=lambda r: [(v is None, v) for v in r if not isinstance(v, str)] + [r[-1]])


def trie(spark, rows, schema=TURNS, **options):
    df = conversation_trie.prefix_trie(spark.createDataFrame(rows, schema), **options)
    return order([tuple(r) for r in df.collect()])


@pytest.fixture(scope="module")
def turns():
    """Shared beginnings, null turns, roles, texts and ids, repeated rows, turnless rebuilt ones and a hot group of copies."""
    rng, rows = random.Random(4), []
    for c in range(50):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            text = rng.choice(["x y", "x", "", None]) if t < 4 else rng.choice(["p", "q"])
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "a", None]), text))
    rows += [(200 + i, t, "u", "same thing") for i in range(30) for t in range(8)]
    return rows + [(None, 1, "u", "z")] + [(500, 1, "u", "r")] * 9


@pytest.mark.parametrize("options", [{"segment": 3, "shard_rows": 11}, {}])
def test_trie(spark_, turns, options):
    assert trie(spark_, turns, **options) == order(brute.prefix_trie(turns))


def test_trie_edges(spark_):
    assert trie(spark_, []) == []
    alone = [(1, 1, "a", "b")]  # its only turn is replaced by those of a conversation that does not exist
    assert trie(spark_, alone) == order(brute.prefix_trie(alone)) and len(trie(spark_, alone)) == 1
    extra = [(41, 0, "x", "y" * 100_000, "k", 7), (41, 0, "x", "y" * 100_000, "k", 7)]
    assert trie(spark_, extra, TURNS + ", key string, seg int") == order(brute.prefix_trie([r[:4] for r in extra]))


def test_gallop_equals_search():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 5000), (700, 900), (5000, 7)):
        a, b = (np.unique(rng.integers(1, 20_000, k)) for k in (n, m))
        a, b = np.union1d(a, [20_000]), np.union1d(b, [20_000])
        assert (alignment.gallop(a, b) == np.searchsorted(b, a)).all()
        i, j, cut_a, cut_b = alignment.overlaps(a, b)
        both = np.union1d(a, b)  # a link for each piece of the common refinement
        assert sorted(zip(i.tolist(), j.tolist())) == list(zip(np.searchsorted(a, both).tolist(), np.searchsorted(b, both).tolist()))
        assert (a[cut_a - 1] == np.intersect1d(a, b)).all() and (b[cut_b - 1] == np.intersect1d(a, b)).all()


def test_alignment(spark_):
    rng = random.Random(6)
    parts = ["the ", "a", " ", "  ", "\n", "'re", "12", "--", "<s>", "<0x41>", "<|endoftext|>", "é", "漢字", "　", "🙂", "▁", "\t", "\x00", "hello"]
    texts = [None, "", " ", "  ", "▁", "x" * 3000, " " * 999 + "x", "hello world"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    texts += texts[-20:]  # copies
    df = spark_.createDataFrame([(i if i else None, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, keys string, n_a int")
    want = sorted((i, *w) for i, w in enumerate(brute.alignment(texts, alignment.pair_of(*PATHS))))
    for bound in (alignment.BROADCAST_PAIRS, 0):
        got = alignment.align(df, *PATHS, broadcast_pairs=bound)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((r[0] or 0, *r[1:]) for r in got.collect()) == want
    assert alignment.align(df.limit(0), *PATHS).count() == 0


def test_quality_classifier(spark_):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark_.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.train_and_classify(docs, labels)
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in got.collect() if r.doc_id in known]
    assert all(r.held_out == (quality_classifier.crc_mod_5(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out]
    right = [r.predicted == known[r.doc_id] for r in out]
    assert len(out) > 300 and sum(right) / len(right) > 0.97
    assert sum(r.predicted for r in out if known[r.doc_id]) / sum(known[r.doc_id] for r in out) > 0.98


def test_quality_classifier_edges(spark_):
    docs = spark_.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "a " * 50_000, 5), (3, "w", 5)], "doc_id long, text string, score int")
    labels = spark_.createDataFrame([], "doc_id long, quality int, toxic int")
    for some in (labels, labels.union(spark_.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (3, 1, 0)], labels.schema))):
        rows = quality_classifier.train_and_classify(docs, some).collect()
        assert len(rows) == 5 and len({r.score for r in rows}) == 1 and 0 < rows[0].score < 1
        assert {r.held_out for r in rows if r.doc_id is None} == {True}
    assert quality_classifier.train_and_classify(docs.limit(0), labels).count() == 0
    x, y = quality_classifier.training_rows(docs, spark_.createDataFrame([(i, 1, 0) for i in range(1, 4)], labels.schema), max_rows=1)
    assert len(x) == len(y) == 1


def test_pairs_learn_what_single_tables_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)
    alone, both = (quality_classifier.fit(x[:3000], y[:3000], 30, n) for n in (0, 2))
    right = [((m.score(x[3000:]) > 0.5) == y[3000:]).mean() for m in (alone, both)]
    assert right[0] < 0.7 and right[1] > 0.9 and both.pairs[0] == (0, 1)


def test_words_that_a_polynomial_confuses(spark_):
    rows = [(1, " ".join([THUE] * 61)), (2, " ".join([MORSE] * 61)), (3, " ".join([THUE] * 61))]
    docs = spark_.createDataFrame(rows, "doc_id long, text string")
    cut = substrings.remove_repeats(docs).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256)")
    assert sorted(map(tuple, cut.collect())) == sorted(brute.substrings(rows))
    assert sorted(map(tuple, near_duplicates.near_duplicates(docs).collect())) == sorted(brute.near_duplicates(rows))


def test_links_at_a_low_threshold(spark_):
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(200)]
    rows = []
    for i in range(60):
        own = [f"o{i}-{k}" for k in range(rng.choice([90, 100, 110]))]
        rows.append((i, " ".join(shared + own)))
    docs = spark_.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates.near_duplicates(docs, share=50).collect())) == sorted(brute.near_duplicates(rows, 50))
    assert near_duplicates.banding(75) == (50, 5) and near_duplicates.most_different(250, 75) == 88


def test_clashing_columns(spark_):
    docs = spark_.createDataFrame([(1, "a b", "x", 1, 2, 3, 4, 5)], "doc_id long, text string, _key string, n_words int, ranges int, kept int, n_tokens int, ids int")
    cut = substrings.remove_repeats(docs).first()
    assert (cut["_key"], cut.n_words, cut.ranges, cut.kept, cut.n_tokens) == ("x", 2, 2, "a b", 4)
    counted = token_counts.count_tokens(docs, f"{shared_folder(spark_)}/clash", PATHS[0]).first()
    assert (counted["_key"], counted.n_words, counted.n_tokens) == ("x", 1, 2)
    assert bpe.encode(docs, PATHS[0]).first().ids == counted_ids("a b") and decontamination.contamination(docs, docs.selectExpr("doc_id item_id", "text")).first().n_hit == 2


def counted_ids(text):
    return bpe.encode_text(bpe.load(PATHS[0]), text).tolist()


def test_stages_judge_rows_not_ids(spark_):
    rng = random.Random(3)
    common = ["the", "of", "and", "to", "in", "that", "with"]
    good = " ".join(rng.choice(common) if i % 3 == 0 else "".join(rng.choice("aeinrst") for _ in range(5)) for i in range(400))
    rows = [(1, good, "en", "s", 0), (1, "word", "en", "s", 0), (None, good + " more", "en", "s", 0), (0, good, "en", "s", 0)]
    docs = spark_.createDataFrame(rows, DOCS)
    kept = [r.text for r in corpus_pipeline.quality_rules(spark_, docs, "").collect()]
    assert "word" not in kept
    left = corpus_pipeline.near_dedup(spark_, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(0, good), (1, "word")])
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup, corpus_pipeline.tokenize):
        assert stage(spark_, docs.limit(0), "").count() == 0
    assert corpus_pipeline.decontaminate(spark_, docs.limit(0), "/root/testdata/sf0.001").count() == 0
