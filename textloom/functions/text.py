"""Tokenizer and stemmer: pure column expressions, and a driver-side twin for query texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import rules as R


def raw_tokens(text: Column) -> Column:
    """Maximal runs of word characters; null text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(R.TOKEN_SPARK), F.lit(0)), F.array().cast("array<string>"))


def truncate(token: Column) -> Column:
    """A character is kept only while the bytes before it number fewer than the limit."""
    limit = R.MAX_TOKEN_BYTES
    # The bytes before the limit hold the first byte of every character that is kept; a cut last one counts as whole.
    begun = F.char_length(F.substring(F.encode(token, "UTF-8"), F.lit(1), F.lit(limit)).cast("string"))
    return F.when(F.octet_length(token) <= limit, token).otherwise(F.substring(token, F.lit(1), begun))


def is_ascii(token: Column) -> Column:
    return F.octet_length(token) == F.char_length(token)


def lowercase(token: Column) -> Column:
    """Only A-Z, А-Я and Ё change, unlike lower(), which is used where it does the same, as it is faster."""
    return F.when(is_ascii(token), F.lower(token)).otherwise(F.translate(token, R.UPPER, R.LOWER))


def stem(token: Column) -> Column:
    """Suffixes go in cascade. No suffix touches a token without Cyrillic letters, so such tokens skip the chain."""
    t = F.regexp_replace(token, R.S_GERUND, "$1")
    t = F.when(
        t.rlike(R.S_ADJECTIVE), F.regexp_replace(F.regexp_replace(t, R.S_ADJECTIVE, "$1"), R.S_PARTICIPLE, "$1")
    ).otherwise(t)
    for pattern, put in R.TAIL:
        t = F.regexp_replace(t, pattern, f"$1{put}")
    return F.when(is_ascii(token), token).otherwise(t)


def _cut(t: Column, vowel: Column, suffixes: str, after_a: bool, keep: int = 0) -> Column:
    """The token without the one suffix that it has in the right place, else as it is.

    No suffix of a list ends another one that could stand at the same place, so the order of the tests is free. `vowel` is
    the place of the first vowel, 0 without one; what is left of the token must hold it. `keep` characters stay."""
    n = F.char_length(t)
    whole = F
    for size in sorted({len(x) for x in suffixes.split("|")}):
        ends = F.right(t, F.lit(size)).isin([x for x in suffixes.split("|") if len(x) == size])
        if after_a:
            last = F.substring(t, n - size, F.lit(1))
            place = (n > size) & ((last == "а") | ((last == "я") & (vowel < n - size)))
        else:
            place = vowel <= n - size
        short = F.substring(t, F.lit(1), n - size + keep)
        whole = whole.when(ends & place, short)
    return F.when(vowel > 0, whole.otherwise(t)).otherwise(t)


def stemmed(frame: DataFrame, column: str) -> DataFrame:
    """The frame with a column of lower-cased tokens stemmed, as stem() does it; one projection a step and one look for the
    first vowel in all, which the steps leave where it is. The generator at the end holds the optimizer from writing a
    filter on the stems in terms of the tokens, which would copy every step many times over."""
    rest = [c for c in frame.columns if c != column]
    t, v = F.col(column), F.col("__v")
    first = F.when(is_ascii(t), F.lit(0)).otherwise(F.regexp_instr(t, F.lit(f"[{R.VOWELS}]")))
    frame = frame.select(*rest, first.alias("__v"), column)

    def step(frame, to):
        return frame.select(*rest, "__v", to.alias(column))

    frame = step(frame, _cut(t, v, R.GERUND, True))
    frame = frame.select(*rest, "__v", column, _cut(t, v, R.ADJECTIVE, False).alias("__a"))
    frame = step(frame, F.when(F.col("__a") == t, t).otherwise(_cut(F.col("__a"), v, R.PARTICIPLE, True)))
    frame = step(frame, _cut(t, v, R.VERB, True))
    frame = step(frame, _cut(t, v, R.NOUN, False))
    frame = step(frame, _cut(t, v, R.SUPERLATIVE, False))
    frame = step(frame, _cut(t, v, "нн", False, keep=1))
    return frame.select(*rest, F.explode(F.array(_cut(t, v, "ь", False))).alias(column))


def is_valid(token: Column, min_chars: int = 1) -> Column:
    # A token of hyphens also starts with one; only tokens that start with a digit are looked at for other characters.
    digits = (token >= "0") & (token < ":") & token.rlike("^[0-9]+$")
    ok = (token != "") & ~token.startswith("-") & ~token.endswith("-") & ~digits
    return ok & (F.char_length(token) >= min_chars) if min_chars > 1 else ok


def stem_word(token: str) -> str:
    """Twin of lowercase() and stem() for the driver."""
    token = token.translate(str.maketrans(R.UPPER, R.LOWER))
    token = re.sub(R.S_GERUND, r"\1", token)
    if re.search(R.S_ADJECTIVE, token):
        token = re.sub(R.S_PARTICIPLE, r"\1", re.sub(R.S_ADJECTIVE, r"\1", token))
    for pattern, put in R.TAIL:
        token = re.sub(pattern, rf"\g<1>{put}", token)
    return token


def truncate_word(token: str) -> str:
    kept, size = [], 0
    for c in token:
        if size >= R.MAX_TOKEN_BYTES:
            break
        kept.append(c)
        size += len(c.encode())
    return "".join(kept)


def analyze(text: str, min_chars: int = 1) -> list[str]:
    """The stems of a text, as the columns give them."""
    stems = (stem_word(truncate_word(t)) for t in re.findall(R.TOKEN_SPARK, text))
    return [s for s in stems if s and len(s) >= min_chars and not any(re.search(p, s) for p in R.INVALID)]
