"""Quality rules under weak supervision: rules vote, expectation-maximisation weighs them, the posterior decides.

Each rule looks at one measure of a text and calls it good, bad, or abstains between. Documents are good or bad, unseen;
each class has a share, and each rule votes in each class with probabilities of its own. Expectation-maximisation fits
shares and probabilities to the votes of all documents; the posterior from a document's votes is its quality. So a rule
that alone sees a fault decides where its bad votes hardly occur in the good class, and one whose bad votes occur in good
documents as well is outvoted.

Rows: any number per doc_id; each is judged by its own text. A null or empty text has zero words and fails the base
rule. Columns beside doc_id and text are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import BLANK, words_of
from textloom.session import written

MIN_WORDS = 50
ROUNDS = 40
#: Weight of the starting probabilities in the fit, as a share of the documents.
PRIOR_SHARE = 0.002
#: Starting probabilities of a bad vote, an abstention and a good vote in either class, and of the good class.
GOOD_START, BAD_START, SHARE_START = (0.05, 0.15, 0.8), (0.4, 0.3, 0.3), 0.85
#: Measures of a text from its counts, in SQL of any dialect.
MEASURES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "letters": "n_letters / greatest(word_chars, 1)",
    "bare": "n_bare / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    # Distinct words grow like the root of the length at least, so one bound serves texts of all lengths.
    "rich": "n_distinct / sqrt(greatest(n_words, 1))",
    "dup": "n_dup_lines / greatest(n_lines, 1)",
    "ends": "n_ends / greatest(n_words, 1)",
    "length": "word_chars / greatest(n_words, 1)",
}
#: (when bad, when good) of each rule over the measures; else it abstains, as all do below MIN_WORDS words.
RULES = [
    ("symbols > 0.05", "symbols < 0.02"),
    ("letters < 0.8", "letters > 0.92"),
    ("bare > 0.1", "bare < 0.03"),
    ("upper > 0.3 OR upper < 0.001", "upper > 0.005 AND upper < 0.1"),
    ("repeats > 0.2", "repeats < 0.05"),
    ("rich < 4", "rich > 6"),
    ("n_lines > 2 AND dup > 0.15", "n_lines > 2 AND dup < 0.05"),
    ("ends > 0.3 OR ends < 0.015", "ends > 0.04 AND ends < 0.15"),
    ("length < 3.5 OR length > 7", "length > 4.3 AND length < 6.3"),
]


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of each row's text, beside the columns of `keep`.

    A text is split once and only counts leave the row. Three-word windows are compared by 64-bit hashes; the ordering
    that finds their places, n log n, runs only for texts in which a window repeats.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(*keep, text.alias("__t"), words_of(text).alias("__w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"(?s)[^{BLANK[1:-1]}]")).alias("__l"))
    n = F.size("__w")
    window = F.transform(
        F.slice("__w", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2))
    )
    b = a.select(
        *keep, n.cast("bigint").alias("n_words"), F.char_length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        F.size("__l").cast("bigint").alias("n_lines"),
        F.regexp_count("__t", F.lit("\\p{Lu}")).cast("bigint").alias("n_upper"), F.regexp_count("__t", F.lit("\\p{L}")).cast("bigint").alias("n_letters"),
        F.regexp_count("__t", F.lit(f"(?:^|{BLANK})[^\\p{{L}}\\p{{N}}{BLANK[1:-1]}]+(?={BLANK}|\\z)")).cast("bigint").alias("n_bare"),
        F.regexp_count("__t", F.lit("[.!?](?=[\\x20\\x09-\\x0D]|$)")).cast("bigint").alias("n_ends"),
        F.size(F.array_distinct("__w")).cast("bigint").alias("n_distinct"), window.alias("__h"),
    )
    counts = [c for c in b.columns if c != "__h"]
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    c = b.select(*counts, F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed).alias("__p"))
    as_before = lambda x, i: F.get("__p", i - 1)["h"].eqNullSafe(x["h"])
    twice = F.filter("__p", lambda x, i: as_before(x, i) | F.get("__p", i + 1)["h"].eqNullSafe(x["h"]))
    d = c.select(*counts, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("__q"))
    covered = F.aggregate(
        F.transform("__q", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("__q", i + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x
    )
    return d.select(*counts, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def _vote_sql(number: int) -> str:
    """3 * number plus 0 for bad, 1 for abstention, 2 for good: the place of the vote in the fit's state."""
    bad, good = RULES[number]
    return f"CASE WHEN n_words < {MIN_WORDS} THEN {3 * number + 1} WHEN {bad} THEN {3 * number} WHEN {good} THEN {3 * number + 2} ELSE {3 * number + 1} END"


def votes(counted: DataFrame) -> DataFrame:
    """Adds `votes`, an array of one entry a rule."""
    measured = counted.withColumns({k: F.expr(v) for k, v in MEASURES.items()})
    return measured.withColumn("votes", F.array(*(F.expr(_vote_sql(j)) for j in range(len(RULES))))).drop(*MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _start() -> list[float]:
    """The state of the fit: log odds of the good class, then for each vote of each rule its log likelihood ratio."""
    from math import log

    return [log(SHARE_START / (1 - SHARE_START))] + [log(g / b) for g, b in zip(GOOD_START, BAD_START, strict=True)] * len(RULES)


def fit(voted: DataFrame) -> DataFrame:
    """One row with `state`: log odds of the good class, and log likelihood ratios of all votes.

    The corpus is reduced to how many documents show each pattern of votes, 3 ** rules rows at most whatever its size,
    with partial counts before the shuffle. The rounds then run inside that one row as a fold."""
    start = "array(" + ", ".join(f"{x!r}D" for x in _start()) + ")"
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("pats"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("total"))
    odds = "aggregate(p.votes, st[0], (s, i) -> s + st[i + 1])"
    judged = f"transform(pats, p -> struct(p.votes AS votes, p.n / (1D + exp(-({odds}))) AS good, p.n AS n))"
    weight = f"(1D + {PRIOR_SHARE}D * total)"
    sums = "named_struct('r', r, 'good', aggregate(r, 0D, (s, p) -> s + p.good))"
    of = lambda part: f"aggregate(x.r, 0D, (s, p) -> IF(array_contains(p.votes, i), s + {part}, s))"
    prior = lambda start: "array(" + ", ".join(f"{v}D" for v in start) + ")[i % 3]"
    good = f"({of('p.good')} + {weight} * {prior(GOOD_START)}) / (x.good + {weight})"
    bad = f"({of('p.n - p.good')} + {weight} * {prior(BAD_START)}) / (total - x.good + {weight})"
    share = f"ln((x.good + {weight} * {SHARE_START}D) / (total - x.good + {weight} * {1 - SHARE_START}D))"
    new = f"concat(array({share}), transform(sequence(0, {3 * len(RULES) - 1}), i -> ln(({good}) / ({bad}))))"
    step = f"transform(transform(array({judged}), r -> {sums}), x -> {new})[0]"
    return one.select(F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (st, k) -> {step})").alias("state"))


def judge(voted: DataFrame, state: DataFrame) -> DataFrame:
    """Adds base_failed, quality (posterior of the good class) and kept."""
    both = voted.join(F.broadcast(state))  # one row
    odds = F.expr("aggregate(votes, state[0], (s, i) -> s + state[i + 1])")
    out = both.withColumn("base_failed", base_failed()).withColumn("quality", 1 / (1 + F.exp(-odds))).drop("state", "votes")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def assess(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, quality, kept. The text is read once; its counts are
    written to the shared folder, since the fit must see all of them before the first verdict."""
    voted = votes(written(features(docs, ["doc_id"]), "quality"))
    return judge(voted, fit(voted))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns. Rows are written once beside their counts; the fit reads the counts."""
    whole = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text"))
    voted = votes(written(features(whole, ["__row"]), "quality"))
    return judge(voted, fit(voted)).where("kept").select("__row.*")


def oracle() -> str:
    """DuckDB SQL of the counts and verdicts over documents: windows as rows, the fit as a recursive query."""
    last = 3 * len(RULES)
    start = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _start()) + "]"
    vote = ", ".join(_vote_sql(j) for j in range(len(RULES)))
    odds = "(st[1] + list_sum(list_transform(p.v, lambda k: st[k + 2])))"
    weight = f"(1 + {PRIOR_SHARE}::DOUBLE * total)"
    prior = lambda start: "([" + ", ".join(f"{v}::DOUBLE" for v in start) + "])[i % 3 + 1]"
    good = f"(coalesce(list_sum(list_transform(r, lambda p: CASE WHEN list_contains(p.v, i) THEN p.g ELSE 0 END)), 0) + {weight} * {prior(GOOD_START)}) / (gs + {weight})"
    bad = f"(coalesce(list_sum(list_transform(r, lambda p: CASE WHEN list_contains(p.v, i) THEN p.n - p.g ELSE 0 END)), 0) + {weight} * {prior(BAD_START)}) / (total - gs + {weight})"
    share = f"ln((gs + {weight} * {SHARE_START}) / (total - gs + {weight} * {1 - SHARE_START}))"
    measures = ", ".join(f"{v} AS {k}" for k, v in MEASURES.items())
    return f"""
        WITH RECURSIVE a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        b AS MATERIALIZED (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM a),
        win AS MATERIALIZED (SELECT doc_id, i, hash(w[i:i + 2]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
        twice AS (SELECT doc_id, h FROM win GROUP BY ALL HAVING count(*) > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM win JOIN twice USING (doc_id, h), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
        c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_upper,
            length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS n_letters, len(list_filter(w, lambda x: NOT regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) AS n_bare,
            len(regexp_extract_all(t || chr(10), '[.!?]{BLANK}')) AS n_ends, len(list_distinct(w)) AS n_distinct FROM b LEFT JOIN rep USING (doc_id)),
        d AS (SELECT *, {measures} FROM c),
        e AS MATERIALIZED (SELECT *, [{vote}] AS v FROM d),
        p AS MATERIALIZED (SELECT list({{'v': v, 'n': n}}) AS pats, sum(n) AS total FROM (SELECT v, count(*)::DOUBLE AS n FROM e GROUP BY v)),
        em(k, st) AS (SELECT 0, {start} UNION ALL
            SELECT k + 1, list_concat([{share}], list_transform(range(0, {last}), lambda i: ln(({good}) / ({bad})))) FROM (
                SELECT k, total, r, list_sum(list_transform(r, lambda p: p.g)) AS gs FROM (
                    SELECT k, total, list_transform(pats, lambda p: {{'v': p.v, 'n': p.n, 'g': p.n / (1 + exp(-{odds}))}}) AS r FROM em, p WHERE k < {ROUNDS}))),
        fit AS (SELECT st FROM em WHERE k = {ROUNDS}),
        g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, st[1] + list_sum(list_transform(v, lambda k: st[k + 2])) >= 0 AS fine FROM e, fit)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
            n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM g"""
