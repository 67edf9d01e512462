"""Golden mini-corpus: analysis, index, boolean queries, pages."""

import pytest

from textloom.functions import text as X
from textloom.operators import index as I
from textloom.plans import query as Q
from textloom.plans import search as P

CORPUS = [
    (0, "Современная терапия пациентов: результаты исследования."),
    (1, "Лечение пациента и данные COVID-19, 2020 год."),
    (2, "Терапия и лечение — новые данные (результат)."),
    (3, "Cafe café ЁЖ -тире кто-и 123 --- А"),
    (4, "Универсальный университет исследований"),
]
STEMS = """современная современ|терапия терапи|терапию терапию|университет университет|исследование исследован|данные дан|пациентов пациент
Ёлка ёлк|кто-и кто-|дав да|делавшись дел|бегающий бег|сильнейший сильн|новейший нов|длинный длин|деревянный деревян|английский английск|любовь любов
соль сол|рысь рысь|мыть мыть|рисует рисует|читала чит|читавшая чит|читать чит|бежать беж|красивая красив|рука рука|людьми людьми|ая а|я я|Є Є|ЄЛЬ Єл|Эй эй"""
ANSWERS = {
    "терапия": [0, 2], "терапия лечение": [2], "терапия && лечение": [2], "терапия || лечение": [0, 1, 2], "!пациент": [2, 3, 4],
    "терапия && !пациент": [2], "терапия !лечение": [0], "(терапия || лечение) && данные": [1, 2], "терапия || лечение && данные": [0, 1, 2],
    "!(терапия || лечение)": [3, 4], "!терапия лечение": [1], "!(!терапия)": [0, 2], "covid-19": [1], "COVID 19": [], "данных": [1, 2],
    "терапию": [], "!несуществующее": [0, 1, 2, 3, 4], "терапия)": [0, 2], "()": [], "": [], "!!терапия": [0, 2],
}


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(i, t, f"u{i}", f"t{i}") for i, t in CORPUS], "doc_id long, text string, url string, title string")
    return I.build_index(docs)


def test_stems():
    for pair in STEMS.replace("\n", "|").split("|"):
        word, want = pair.split()
        assert X.stem_word(word) == want


def test_column_and_twin_agree(spark):
    from pyspark.sql import functions as F

    words = [p.split()[0] for p in STEMS.replace("\n", "|").split("|")] + ["a" * 300, "ы" * 200, "a" + "ы" * 200, "a" * 253 + "ыb", "ы" * 127 + "a", "", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.stem(X.lowercase(X.truncate(F.col("w")))).alias("s")).collect()
    assert all(s == (None if w is None else X.stem_word(X.truncate_word(w))) for w, s in rows)


def test_answers(index):
    for text, want in ANSWERS.items():
        assert sorted(r[0] for r in P.search(index, text).collect()) == want, text


def test_set_algebra_gives_the_same(index):
    for text in ("терапия && !пациент", "!(терапия || лечение)", "терапия || лечение && данные"):
        tree = Q.parse(Q.preprocess(text))
        assert sorted(r[0] for r in P.search_set_algebra(index, tree).collect()) == ANSWERS[text]


@pytest.mark.parametrize("text", ["123", "терапия && 123", "(терапия", "терапия ()", "&& терапия", "!"])
def test_bad_queries(index, text):
    with pytest.raises(Q.QuerySyntaxError):
        P.search(index, text)


def test_gaps(index):
    rows = {r.term: (r.doc_freq, r.d_gaps) for r in I.gap_arrays(index.postings).collect()}
    assert rows["дан"] == (2, [1, 1]) and rows["терапи"] == (2, [0, 2]) and rows["универсальн"] == (1, [4]) and len(rows) == 19


def test_pages(index):
    page = P.search_page(index, "!несуществующее", 2, per_page=2)
    assert (page.found_count, page.total_pages, [r.doc_id for r in page.rows.collect()]) == (5, 3, [2, 3])
    with pytest.raises(ValueError):
        P.search_page(index, "терапия", 0)
    assert [r.doc_id for r in P.lookup(index, [3, 99, 1]).collect()] == [3, 1]


def test_batch_takes_words_as_they_are(index):
    got = P.search_batch(index, [(1, "терапи && ! пациент"), (2, " "), (3, "Терапия"), (4, "! дан")]).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == [(1, 2), (4, 0), (4, 3), (4, 4)]


def test_saved_index(spark, index, tmp_path):
    index.save(str(tmp_path), buckets=4)
    stored = I.Index.load(spark, str(tmp_path))
    assert sorted(r[0] for r in P.search(stored, "(терапия || лечение) && данные").collect()) == [1, 2]


def test_bucket_on_the_driver(spark):
    from pyspark.sql import functions as F

    terms = ["", "a", "ab", "abc", "abcd", "терапи", "ёж", "covid-19", "x" * 300]
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select("t", I.bucket_of(F.col("t"), 64).alias("b")).collect()
    assert [r.b for r in rows] == [I.term_bucket(r.t, 64) for r in rows]


def test_stemmed_frame_agrees_with_the_column(spark):
    from itertools import product

    from pyspark.sql import functions as F

    from textloom.functions import rules as R

    ends = sorted({x for group in (R.GERUND, R.ADJECTIVE, R.PARTICIPLE, R.VERB, R.NOUN, R.SUPERLATIVE) for x in group.split("|")}) + ["нн", "ь", ""]
    words = [s + a + b for s, a, b in product(["", "б", "ба", "бя", "абя", "бе", "бел", "бау", "ыя", "бяа", "x"], ends, ends)]
    frame = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.col("w").alias("s"))
    for r in X.stemmed(frame, "s").collect():
        assert r.s == X.stem_word(r.w), r.w


def test_batch_equals_single_searches(index):
    texts = [t for t in ANSWERS if t.strip() and t != "()"]
    got = P.search_batch(index, list(enumerate(texts)), analyzed=True).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == sorted((i, d) for i, t in enumerate(texts) for d in ANSWERS[t])


def test_gaps_of_a_term_over_many_partitions(spark):
    posts = spark.createDataFrame([(t, d) for t, n in (("a", 1), ("b", 500), ("c", 3)) for d in range(5, 5 + 7 * n, 7)], "term string, doc_id long")
    gaps = I.encode_gaps(posts)
    assert sorted(map(tuple, gaps.collect())) == sorted((t, d, 5 if d == 5 else 7) for t, d in map(tuple, posts.collect()))
    assert sorted(map(tuple, I.decode_gaps(gaps).collect())) == sorted(map(tuple, posts.collect()))


def test_truncating_looks_at_its_token_once(spark):
    """The rule of a character at a time took 254 looks at the whole expression that gives the token."""
    from pyspark.sql import functions as F

    from textloom import registry
    from textloom.functions import text as X

    plan = registry.QUERIES["token_truncate_255"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("regexp_replace") == 1
    words = ["a" * 254, "a" * 255, "ы" * 127, "ы" * 128, "a" + "ы" * 127, "€" * 90, "a€" * 90, "aa" + "€" * 90, "😀" * 70, "aaa" + "😀" * 70]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.truncate(F.col("w"))).collect()
    assert [b for _, b in rows] == [X.truncate_word(w) for w in words]


def test_terms_of_a_text_agree_with_the_twin(spark):
    """tokens() and doc_terms() run Terms.java, not a chain of expressions for each token."""
    from itertools import product

    from textloom.functions import rules as R
    from textloom.functions import text as X
    from textloom.operators import tokens as T

    ends = sorted({x for group in (R.GERUND, R.ADJECTIVE, R.PARTICIPLE, R.VERB, R.NOUN, R.SUPERLATIVE) for x in group.split("|")}) + ["нн", "ь", ""]
    words = [s + a + b for s, a, b in product(["", "б", "ба", "бя", "абя", "бе", "бел", "бау", "ыя", "бяа", "x", "БЯ", "Єщ"], ends, ends)]
    odd = ["a" * 300, "ы" * 200, "a" + "ы" * 200, "a" * 253 + "ыb", "12", "1a", "-", "--", "-a", "a-", "a-b", "Ѐ", "ѿ", "Ҁ", "é", "İK", "😀x", "ЀЂ", "A" * 250 + "ЫЫЫ", "x\n\ty", ""]
    texts = [*(" ".join(words[i : i + 500]) for i in range(0, len(words), 500)), *odd, " ".join(odd), None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (1, 2):
        want = {i: X.analyze(t or "", least) for i, t in enumerate(texts)}
        got = {i: [] for i in want}
        for r in T.tokens(frame, min_chars=least).orderBy("doc_id", "pos").collect():
            got[r.doc_id].append(r.term)
        assert got == want
        assert sorted(map(tuple, T.doc_terms(frame, min_chars=least).collect())) == sorted((i, t) for i, ts in want.items() for t in set(ts))
    assert [r.term for r in T.tokens(frame.where(f"doc_id = {texts.index('ы' * 200)}"), stemmed=False).collect()] == ["ы" * 127]
    plan = T.tokens(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "textloom_terms" in plan


def test_gaps_of_lists_in_parts(spark):
    """Ids over many parts of a list, some below 0, and postings that repeat, which gave gaps of 0 before."""
    ids = {"a": [-200_000, -3, 0, 1, 65_535, 65_536, 10**9, 10**15], "b": [7], "c": list(range(0, 400_000, 9_999))}
    posts = spark.createDataFrame([(t, d) for t, ds in ids.items() for d in ds] * 2, "term string, doc_id long").repartition(5)
    gaps = I.encode_gaps(posts)
    assert sorted(map(tuple, gaps.collect())) == sorted((t, d, d - b) for t, ds in ids.items() for d, b in zip(ds, [0, *ds], strict=False))
    assert sorted(map(tuple, I.decode_gaps(gaps).collect())) == sorted((t, d) for t, ds in ids.items() for d in ds)
    arrays = {r.term: (r.doc_freq, r.doc_ids) for r in I.posting_arrays(posts).collect()}
    assert arrays == {t: (len(ds), ds) for t, ds in ids.items()}
