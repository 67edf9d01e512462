"""Boolean search over an Index: one filtered read of postings, one aggregation by document, one predicate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.index import Index
from textloom.plans import query as Q
from textloom.session import durable

PER_PAGE = 50


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").distinct().join(b.select("doc_id"), "doc_id", "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def complement(universe: DataFrame, a: DataFrame) -> DataFrame:
    return universe.select("doc_id").join(a.select("doc_id"), "doc_id", "left_anti")


def term_docs(index: Index, term: str) -> DataFrame:
    """Documents of one term; none for an unknown one."""
    return index.lists_of([term]).select("doc_id")


def _tree(text: str, analyzed: bool):
    return Q.parse(Q.preprocess(text) if analyzed else Q.lex(text))


def search_tree(index: Index, tree) -> DataFrame:
    """(doc_id) of the hits. Only a query that a wordless document satisfies reads the list of all documents."""
    terms = Q.words(tree)
    if not terms:
        return index.forward.select("doc_id").limit(0)
    flags = index.lists_of(terms).groupBy("doc_id").agg(*(F.max(F.col("term") == t).alias(f"f{i}") for i, t in enumerate(terms)))
    is_empty_hit = Q.matches_empty(tree)
    at = {t: F.coalesce(F.col(f"f{i}"), F.lit(False)) if is_empty_hit else F.col(f"f{i}") for i, t in enumerate(terms)}
    predicate = Q.evaluate(tree, at.get, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a, F.lit(False))
    rows = index.forward.select("doc_id").join(flags, "doc_id", "left") if is_empty_hit else flags
    return rows.where(predicate).select("doc_id")


def search_set_algebra(index: Index, tree) -> DataFrame:
    """The same hits by semi joins, unions and anti joins."""
    universe = index.forward.select("doc_id")
    return Q.evaluate(tree, lambda t: term_docs(index, t), intersect, union, lambda a: complement(universe, a), universe.limit(0))


def search(index: Index, text: str, analyzed: bool = True) -> DataFrame:
    """(doc_id) of the hits, unordered; the empty query has none, `analyzed=False` takes words as they are."""
    if not text.strip():
        return index.forward.select("doc_id").limit(0)
    return search_tree(index, _tree(text, analyzed))


def lookup(index: Index, ids: list[int] | DataFrame) -> DataFrame:
    """(doc_id, url, title) of ids, in the order given for a list; unknown ids are left out."""
    if isinstance(ids, DataFrame):
        return index.forward.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    spark = index.forward.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos long, doc_id long")
    # A list held by the driver is small; its size is checked by the planner's own threshold.
    return index.forward.where(F.col("doc_id").isin(list(ids))).join(wanted, "doc_id").orderBy("pos").select("doc_id", "url", "title")


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    page: int
    found_count: int
    total_pages: int


def page_rows(hits: DataFrame, page: int, per_page: int = PER_PAGE) -> DataFrame:
    """One page of ids: a top-k of page * per_page rows, no global sort."""
    if page < 1:
        raise ValueError("pages count from 1")
    return hits.orderBy("doc_id").offset((page - 1) * per_page).limit(per_page)


def search_page(index: Index, text: str, page: int = 1, per_page: int = PER_PAGE) -> Page:
    """A result page with counts of all hits and pages; rows are in doc_id order. The search runs once."""
    hits = durable(search(index, text))
    ids = page_rows(hits, page, per_page)
    found = hits.count()
    rows = index.forward.join(F.broadcast(ids), "doc_id").orderBy("doc_id")  # per_page rows
    return Page(rows.select("doc_id", "url", "title"), page, found, -(-found // per_page))


def _program(tree) -> list[str]:
    """The tree in postfix order: =word, !, &, |, and 0 for what matches nothing."""
    return Q.evaluate(tree, lambda t: ["=" + t], lambda a, b: [*a, *b, "&"], lambda a, b: [*a, *b, "|"], lambda a: [*a, "!"], ["0"])


#: Runs `program` on the words in `have`: a fold whose state is a stack of truth values.
_RUN = (
    "aggregate(program, CAST(array() AS ARRAY<BOOLEAN>), (s, op) -> CASE "
    "WHEN left(op, 1) = '=' THEN concat(s, array(array_contains(have, substring(op, 2)))) "
    "WHEN op = '!' THEN concat(slice(s, 1, size(s) - 1), array(NOT s[size(s) - 1])) "
    "WHEN op = '&' THEN concat(slice(s, 1, size(s) - 2), array(s[size(s) - 2] AND s[size(s) - 1])) "
    "WHEN op = '|' THEN concat(slice(s, 1, size(s) - 2), array(s[size(s) - 2] OR s[size(s) - 1])) "
    "ELSE concat(s, array(false)) END)[0]"
)


def search_batch(index: Index, queries: list[tuple[int, str]], analyzed: bool = False) -> DataFrame:
    """(query_id, doc_id) for many queries; blank ones are skipped.

    All words are read in one pass. Their postings meet the queries that have them and are grouped by query and document,
    so work grows with these postings, not with queries times documents. Only queries that a wordless document satisfies
    read the list of all documents, less those with words that do not."""
    spark = index.forward.sparkSession
    trees = {i: _tree(q, analyzed) for i, q in queries if q.strip()}
    pairs = [(i, w) for i, t in trees.items() for w in Q.words(t)]
    if not pairs:
        return index.forward.select(F.lit(0).cast("long").alias("query_id"), "doc_id").limit(0)
    asked = F.broadcast(spark.createDataFrame(pairs, "query_id long, term string"))  # the queries, which the driver holds
    programs = F.broadcast(spark.createDataFrame([(i, _program(t), Q.matches_empty(t)) for i, t in trees.items()], "query_id long, program array<string>, wordless boolean"))
    met = index.lists_of(list(dict.fromkeys(w for _, w in pairs))).join(asked, "term").groupBy("query_id", "doc_id").agg(F.collect_set("term").alias("have"))
    judged = met.join(programs, "query_id").select("query_id", "doc_id", "wordless", F.expr(_RUN).alias("hit"))
    hits = judged.where("hit AND NOT wordless").select("query_id", "doc_id")
    open_ = [i for i, t in trees.items() if Q.matches_empty(t)]
    if not open_:
        return hits
    every = index.forward.select(F.explode(F.array(*(F.lit(i).cast("long") for i in open_))).alias("query_id"), "doc_id")
    return hits.unionByName(every.join(judged.where("wordless AND NOT hit").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"))
