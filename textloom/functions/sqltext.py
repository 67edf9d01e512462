"""The text rules as DuckDB SQL fragments, for oracles."""

from __future__ import annotations

from textloom.functions import rules as R


def truncate_sql(t: str) -> str:
    n = R.MAX_TOKEN_BYTES
    return f"(CASE WHEN strlen({t}) <= {n} THEN {t} ELSE {t}[1:list_max(list_filter(range(1, least(length({t}), {n}) + 1), lambda n: strlen({t}[1:n - 1]) < {n}))] END)"


def lower_sql(t: str) -> str:
    return f"translate({t}, '{R.UPPER}', '{R.LOWER}')"


def stem_ctes(source: str, column: str, keep: str) -> str:
    """CTEs s1..s7 over `source`; s7 has the stem in column `term` beside the columns of `keep`."""
    out = [
        f"s1 AS (SELECT {keep}, regexp_replace({column}, '{R.S_GERUND}', '\\1') AS t FROM {source})",
        f"s2 AS (SELECT {keep}, CASE WHEN regexp_matches(t, '{R.S_ADJECTIVE}') THEN regexp_replace(regexp_replace(t, '{R.S_ADJECTIVE}', '\\1'), '{R.S_PARTICIPLE}', '\\1') ELSE t END AS t FROM s1)",
    ]
    for n, (pattern, put) in enumerate(R.TAIL, 3):
        out.append(f"s{n} AS (SELECT {keep}, regexp_replace(t, '{pattern}', '\\1{put}') AS {'term' if n == 7 else 't'} FROM s{n - 1})")
    return ", ".join(out)


def valid_sql(t: str, min_chars: int = 1) -> str:
    return f"({t} <> '' AND NOT regexp_matches({t}, '{R.INVALID[0]}') AND NOT regexp_matches({t}, '{R.INVALID[1]}') AND length({t}) >= {min_chars})"


def tokens_sql(text: str = "text", table: str = "documents", key: str = "doc_id", min_chars: int = 1) -> str:
    """A WITH list ending in tok(key, pos, term): pos counts raw tokens from 0."""
    return (
        f"WITH raw AS (SELECT {key}, unnest(regexp_extract_all({text}, '{R.TOKEN_DUCK}')) AS t, generate_subscripts(regexp_extract_all({text}, '{R.TOKEN_DUCK}'), 1) - 1 AS pos FROM {table}), "
        f"low AS (SELECT {key}, pos, {lower_sql(truncate_sql('t'))} AS w FROM raw), "
        + stem_ctes("low", "w", f"{key}, pos")
        + f", tok AS (SELECT {key}, CAST(pos AS BIGINT) AS pos, term FROM s7 WHERE {valid_sql('term', min_chars)}) "
    )
