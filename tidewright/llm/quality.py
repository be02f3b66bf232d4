"""Quality rules by distribution divergence (native).

A document's histogram of character classes and of the common words of its language are compared with references by the
Jensen-Shannon distance. References are fixed for each language with a word list, so that no text of the input moves them.
All other languages share medians over the distinct texts that pass the base rules, with one vote each, which junk or one
very long text moves little. A distance only counts from a minimum length on, since short texts diverge by chance.
Everything is a DataFrame expression; word arrays never leave their row, so no key can be hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, row_key, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
# Frequent function words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "it", "that", "was", "for", "on", "are", "as", "with", "he", "at", "by", "this", "an", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "pas", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
#: Character classes besides white space and all other characters.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": r"[.,;:]", "mark": r"[!?'\"()\-]", "symbol": r"[^\p{L}\p{N}\s.,;:!?'\"()\-]"}
N_COMMON = 20
LONGEST = max(len(w.encode()) for words in COMMON.values() for w in words)
# Mean shares (in 1/100,000) of ``h_classes`` and ``h_common`` over good texts of sf0.1 that pass the base rules (en 1605,
# de 396, fr 407, es 266). ``fit_references`` counts about 4 % more texts there; no share differs by more than 50.
REFERENCES = {
    "en": ([1447, 89, 2436, 5, 3, 16642, 79379], [5011, 2643, 2169, 1564, 1082, 978, 730, 823, 627, 716, 618, 413, 484, 523, 252, 387, 418, 396, 299, 319, 79545]),
    "de": ([1326, 72, 2216, 7, 4, 15469, 80905], [4941, 2604, 2094, 1543, 1370, 1071, 904, 880, 708, 677, 579, 600, 554, 447, 454, 408, 356, 411, 423, 308, 78666]),
    "fr": ([1471, 199, 2434, 16, 9, 16645, 79226], [5084, 2738, 2006, 1513, 1272, 1130, 1014, 891, 719, 634, 616, 561, 597, 451, 488, 394, 406, 411, 383, 339, 78356]),
    "es": ([1424, 89, 2373, 1, 1, 16177, 79935], [5125, 2611, 2050, 1447, 1300, 1041, 3, 949, 825, 656, 754, 628, 642, 517, 473, 480, 399, 407, 396, 421, 78876]),
}
#: Medians of the other languages are exact on shares of this grain.
GRAIN = 10_000
MIN_WORDS_CLASSES, MAX_CLASSES = 50, 0.28
MIN_WORDS_COMMON, MAX_COMMON = 100, 0.29


def _repeat_words(df: DataFrame) -> DataFrame:
    """Words inside three-word windows that occur twice or more in the text.

    Each window becomes one long: its hash in the upper bits and its position in the lower ones. Sorting brings equal
    windows together, and neighbours are compared word by word before they count. Each step looks at all words once.
    """
    zero, n = F.lit(0).cast("long"), F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")
    bits = F.coalesce(F.ceil(F.log2(F.col("n_words") + 1)).cast("int"), F.lit(0))
    df = df.withColumn("_mask", F.coalesce(F.call_function("shiftleft", F.lit(-1).cast("long"), bits), zero))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    cut = lambda start: F.slice("_hashes", start, n)
    windows = F.zip_with(F.zip_with(cut(1), cut(2), lambda a, b: F.xxhash64(a, b)), cut(3), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_packed", F.transform(windows, lambda x, i: F.coalesce(x.bitwiseAND(F.col("_mask")).bitwiseOR(i.cast("long")), zero)))
    df = df.withColumn("_sorted", F.sort_array("_packed"))
    m = F.greatest(F.size("_sorted") - 1, F.lit(0))
    equal = lambda a, b: a.bitwiseXOR(b).bitwiseAND(F.col("_mask")) == 0
    pair = lambda a, b: F.when(equal(a, b), F.struct(_place(a).alias("p"), _place(b).alias("q")))
    df = df.withColumn("_pairs", F.filter(F.zip_with(F.slice("_sorted", 1, m), F.slice("_sorted", 2, m), pair), lambda x: x.isNotNull()))

    def same(x: Column) -> Column:
        words = [F.get("_words", x["p"] + k) == F.get("_words", x["q"] + k) for k in range(3)]
        return words[0] & words[1] & words[2]

    df = df.withColumn("_true", F.filter("_pairs", same))
    at = F.concat(F.col("_true.p"), F.col("_true.q"))
    df = df.withColumn("_at", F.array_distinct(at))
    spread = F.concat(F.col("_at"), F.transform("_at", lambda p: p + 1), F.transform("_at", lambda p: p + 2))
    return df.withColumn("n_repeat_words", F.size(F.array_distinct(spread)).cast("long"))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.bitwise_not(F.col("_mask"))).cast("int")


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts and the two histograms ``h_classes`` and ``h_common``. Null text is empty."""
    lang = F.when(F.col("lang").isin(list(COMMON)), F.col("lang")).otherwise(F.lit("*"))
    common = reduce(lambda c, k: c.when(F.col("_lang") == k, F.array(*map(F.lit, COMMON[k]))), COMMON, F.when(F.lit(False), F.array(*map(F.lit, COMMON["en"]))))
    df = docs.select("doc_id", lang.alias("_lang"), text_or_empty().alias("_text"), row_key("lang").alias("row_key"))
    df = df.withColumn("_common", common.otherwise(F.array(*map(F.lit, COMMON["en"]))))
    df = df.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = _repeat_words(df)
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # What is left without small letters and white space is short, so that each class is counted quickly.
    df = df.withColumn("_marks", F.regexp_replace("_text", r"[\p{Ll}\s]+", ""))
    df = df.withColumn("_hits", F.filter(F.transform("_words", lambda w: F.when(F.octet_length(w) <= LONGEST, F.array_position("_common", w).cast("int"))), lambda x: x > 0))
    counts = [F.regexp_count("_marks", F.lit(p)).cast("long") for p in CLASSES.values()]
    space = F.length("_text").cast("long") - F.col("word_chars")
    hits = [(F.size("_hits") - F.size(F.array_remove("_hits", k + 1))).cast("long") for k in range(N_COMMON)]
    rest = lambda total, parts: total - reduce(lambda a, b: a + b, parts)
    return df.select(
        "doc_id", "row_key", "_lang", F.sha2("_text", 256).alias("_sha"), "n_words", "word_chars",
        F.regexp_count("_marks", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.array(*counts, space, rest(F.length("_text").cast("long"), [*counts, space])).alias("h_classes"),
        F.array(*hits, rest(F.col("n_words"), hits)).alias("h_common"),
    )


def _with_js_distance(df: DataFrame, p: str, q: str, out: str) -> DataFrame:
    """Add the Jensen-Shannon distance (base 2) of two count arrays; null where one of them is empty."""
    total = lambda c: F.nullif(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    df = df.withColumn("_tp", total(p)).withColumn("_tq", total(q))

    def term(x: Column, y: Column) -> Column:
        half = lambda z, m: F.when(z > 0, z * F.log2(z / m)).otherwise(F.lit(0.0))
        return half(x, (x + y) / 2) + half(y, (x + y) / 2)

    df = df.withColumn("_p", F.transform(p, lambda x: x / F.col("_tp"))).withColumn("_q", F.transform(q, lambda x: x / F.col("_tq")))
    terms = F.aggregate(F.zip_with("_p", "_q", term), F.lit(0.0), lambda a, x: a + x)
    distance = F.when(F.col("_tp").isNotNull() & F.col("_tq").isNotNull(), F.sqrt(F.greatest(terms / 2, F.lit(0.0))))
    return df.withColumn(out, distance).drop("_tp", "_tq", "_p", "_q")


def median_reference(seen: DataFrame) -> DataFrame:
    """One row: ``r_h_classes`` and ``r_h_common`` with the lower median of each component's share over the distinct texts of
    ``seen`` that pass the base rules; null arrays where no text counts. ``h_common`` asks for MIN_WORDS_COMMON words."""
    share = lambda h: F.transform(h, lambda x: F.round(x * GRAIN / F.aggregate(h, F.lit(0).cast("long"), lambda a, y: a + y)).cast("int"))
    votes = seen.where(~F.col("base_failed")).select("_sha", "n_words", "h_classes", "h_common").dropDuplicates(["_sha"])
    both = F.array(
        F.struct(F.lit("h_classes").alias("h"), share("h_classes").alias("s")),
        F.struct(F.lit("h_common").alias("h"), F.when(F.col("n_words") >= MIN_WORDS_COMMON, share("h_common")).alias("s")),
    )
    votes = votes.select(F.inline(both)).select("h", F.posexplode("s").alias("i", "x"))
    # At most GRAIN + 1 rows for each component, however many texts vote.
    order = W.partitionBy("h", "i").orderBy("x")
    at = votes.groupBy("h", "i", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("_to", F.sum("n").over(order))
    at = at.withColumn("_all", F.sum("n").over(W.partitionBy("h", "i"))).where(2 * F.col("_to") >= F.col("_all"))
    at = at.groupBy("h", "i").agg(F.min("x").alias("x"))
    found = lambda h: F.array_sort(F.collect_list(F.when(F.col("h") == h, F.struct("i", "x"))))["x"]
    refs = at.agg(*[found(h).alias(f"r_{h}") for h in ("h_classes", "h_common")])
    return refs.select(*[F.when(F.size(c) > 0, F.col(c).cast("array<long>")).alias(c) for c in refs.columns])


def fit_references(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The references of each language with a word list: lang, n_texts, and mean shares (in 1/100,000) ``h_classes`` and ``h_common``.

    The means run over all distinct texts that are labelled good and not toxic and pass the base rules, with one vote each;
    ``h_common`` asks for MIN_WORDS_COMMON words. The result has one row a language, whatever the number of documents. Ids that
    only one of the tables has, null ids and other languages do not count; repeated rows count once.
    """
    good = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("_id")).distinct()
    # Written before filtering, since a filter pushed down would repeat the counting inside its condition.
    seen = materialize(measure(docs.join(good, F.col("doc_id") == F.col("_id"), "left_semi")), "reference-counts")
    seen = seen.where(~F.col("base_failed") & (F.col("_lang") != "*")).select("_lang", "_sha", "n_words", "h_classes", "h_common").dropDuplicates(["_lang", "_sha"])
    total = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x)
    seen = seen.withColumns({"_t": total("h_classes"), "_u": F.when(F.col("n_words") >= MIN_WORDS_COMMON, total("h_common"))})
    mean = lambda h, t, n: F.array(*[F.round(100_000 * F.avg(F.get(h, F.lit(i)) / F.col(t))).cast("long") for i in range(n)])
    refs = [mean("h_classes", "_t", len(CLASSES) + 2).alias("h_classes"), mean("h_common", "_u", N_COMMON + 1).alias("h_common")]
    return seen.groupBy(F.col("_lang").alias("lang")).agg(F.count(F.lit(1)).alias("n_texts"), *refs)


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, both distances and ``kept`` for every row of ``docs``, with its ``row_key``.

    Languages without a word list share one reference of medians and the English list. If no document of theirs passes the
    base rules, they have no reference; then the distance is null and does not reject. Equal rows are judged alike.
    """
    seen = materialize(measure(docs), "quality")
    fixed = lambda k: reduce(lambda c, x: c.when(F.col("_lang") == x, F.array(*[F.lit(v).cast("long") for v in REFERENCES[x][k]])), REFERENCES, F.when(F.lit(False), F.lit(None).cast("array<long>")))
    df = seen.join(F.broadcast(median_reference(seen.where("_lang = '*'"))))  # one row
    df = df.withColumns({f"r_{h}": fixed(k).otherwise(F.col(f"r_{h}")) for k, h in enumerate(("h_classes", "h_common"))})
    df = _with_js_distance(df, "h_classes", "r_h_classes", "js_classes")
    df = _with_js_distance(df, "h_common", "r_h_common", "js_common")
    off = F.coalesce((F.col("n_words") >= MIN_WORDS_CLASSES) & (F.col("js_classes") > MAX_CLASSES), F.lit(False))
    off |= F.coalesce((F.col("n_words") >= MIN_WORDS_COMMON) & (F.col("js_common") > MAX_COMMON), F.lit(False))
    return df.withColumn("kept", ~(F.col("base_failed") | off)).drop("_lang", "_sha", "h_classes", "h_common", "r_h_classes", "r_h_common")
