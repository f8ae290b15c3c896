"""Scoped search over chunks: vectors, keywords, their fusion by ranks, and grouping of hits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import contains_ignoring_case, keyword_snippet, occurrences, semantic_snippet
from docmill.operators.checks import plan_summary

#: Added to a rank before it is inverted; hits of each leg; least length of a keyword.
RRF_K, CANDIDATES, MIN_KEYWORD = 60, 30, 2


class SearchError(ValueError):
    """PROJECT_NOT_FOUND or KEYWORD_TOO_SHORT."""


def resolve_scope(members: DataFrame, user_id: int, asked: list[int] | None = None) -> DataFrame:
    """Projects a user may search: all memberships, or the asked ones, of which each must be one."""
    own = members.where(F.col("user_id") == user_id).select("project_id").distinct()
    if asked is None:
        return own
    wanted = members.sparkSession.createDataFrame([(i,) for i in sorted(set(asked))], "project_id int")
    if not wanted.join(own, "project_id", "left_anti").isEmpty():
        raise SearchError("PROJECT_NOT_FOUND")
    return own.join(F.broadcast(wanted), "project_id", "left_semi")  # a request lists a few ids


def other_projects(members: DataFrame, user_id: int, current: int) -> DataFrame:
    return resolve_scope(members, user_id).where(F.col("project_id") != current)


def cosine_similarity(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_topk(
    vectors: DataFrame, query: list[float], model: str, projects: list[int], k: int = CANDIDATES, minimum: float | None = None, document_id: int | None = None
) -> DataFrame:
    """The nearest chunks of one model in a scope, of one document if it is named; the least similarity cuts
    after the limit, before the similarity is rounded. An empty query vector or scope finds nothing."""
    scored = vectors.where((F.col("embedding_model") == model) & F.col("project_id").isin(*projects) & F.lit(bool(query)))
    if document_id is not None:
        scored = scored.where(F.col("document_id") == document_id)
    similarity = cosine_similarity(F.col("embedding"), F.array(*map(F.lit, query)).cast("array<double>"))
    scored = scored.select("chunk_id", "document_id", "project_id", F.least(similarity, F.lit(1.0)).alias("score"))
    top = scored.orderBy(F.desc("score"), "chunk_id").limit(k)
    top = top if minimum is None else top.where(F.col("score") >= minimum)
    return top.select("chunk_id", "document_id", "project_id", F.round("score", 6).alias("similarity"))


def with_names(hits: DataFrame, documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Hits with the names of their documents and of the projects that their chunks belong to."""
    named = hits.join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id")
    return named.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")


def trigrams(text: str) -> list[str]:
    """Three letters at a time of each word in lower case, two blanks before it and one behind."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return [f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)]


def _word_similarity(term: set[str], text: list[str]) -> float:
    """Best share of common trigrams between the term and any stretch of the text."""
    hits = [i for i, t in enumerate(text) if t in term]
    best = 0.0
    for at, first in enumerate(hits):
        common: set[str] = set()
        stretch: set[str] = set()
        seen = first
        for last in hits[at:]:
            stretch.update(text[seen : last + 1])
            seen = last + 1
            common.add(text[last])
            best = max(best, len(common) / (len(term) + len(stretch) - len(common)))
            if len(term) <= best * len(stretch):  # a longer stretch can't score more
                break
    return best


def word_similarity(text: Column, term: str) -> Column:
    """Trigram word similarity: 1.0 for the word itself, 0 without a common trigram."""
    wanted = set(trigrams(term))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _word_similarity(wanted, trigrams(t)) if t else 0.0)

    return score(text)


def keyword_hits(chunks: DataFrame, term: str) -> DataFrame:
    """Chunks (chunk_id, document_id, seq, text) that hold the term, with counts and snippets."""
    term = term.strip()
    if len(term) < MIN_KEYWORD:
        raise SearchError("KEYWORD_TOO_SHORT")
    snippet, offset = keyword_snippet(F.col("text"), term)
    hits = chunks.where(contains_ignoring_case(F.col("text"), term))
    return hits.withColumns({"hits": occurrences(F.col("text"), term), "snippet": snippet, "hit_offset": offset})


def keyword_topk(chunks: DataFrame, term: str, k: int = CANDIDATES, by_count: bool = False) -> DataFrame:
    """The best chunks that hold the term, by trigram word similarity or by occurrences."""
    score = F.col("hits").cast("double") if by_count else word_similarity(F.col("text"), term.strip())
    return keyword_hits(chunks, term).withColumn("score", score).orderBy(F.desc("score"), "document_id", "seq").limit(k)


def fuse(vector: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two lists (chunk_id, document_id, seq, score), best first."""
    ranked = lambda df, order: df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  each list is limited
    a = ranked(vector, [F.desc("score"), "chunk_id"]).select("chunk_id", "document_id", "seq", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    b = ranked(keyword, [F.desc("score"), "document_id", "seq"]).select(
        "chunk_id", F.col("document_id").alias("d"), F.col("seq").alias("s"), F.col("rank").alias("keyword_rank"), F.col("score").alias("keyword_score")
    )
    both = a.join(b, "chunk_id", "full_outer")
    part = lambda c: F.coalesce(1 / (F.lit(float(RRF_K)) + F.col(c)), F.lit(0.0))
    kind = F.when(F.col("keyword_rank").isNull(), "vector").when(F.col("vector_rank").isNull(), "keyword").otherwise("both")
    fused = both.select(
        "chunk_id",
        F.coalesce("document_id", "d").alias("document_id"),
        F.coalesce("seq", "s").alias("seq"),
        (part("vector_rank") + part("keyword_rank")).alias("fused"),
        F.coalesce("vector_score", "keyword_score").alias("similarity"),
        kind.alias("match_kind"),
    )
    return fused.orderBy(F.desc("fused"), "document_id", "seq").limit(k)


def hybrid_search(
    chunks: DataFrame, query: list[float], term: str, model: str, projects: list[int], k: int = 20, candidates: int = CANDIDATES, document_id: int | None = None
) -> DataFrame:
    """The best chunks of a scope by ranks in two lists, by vectors and by words, with the snippet that fits.

    ``chunks`` has chunk_id, document_id, project_id, seq, text, embedding, embedding_model. Each leg is limited to
    ``candidates``. A term that is too short skips the leg of words, an empty vector that of vectors, an empty scope finds
    nothing. A hit by words shows its term, any other its beginning.
    """
    term = term.strip()
    scoped = chunks.where((F.col("embedding_model") == model) & F.col("project_id").isin(*projects))
    if document_id is not None:
        scoped = scoped.where(F.col("document_id") == document_id)
    similarity = F.least(cosine_similarity(F.col("embedding"), F.array(*map(F.lit, query)).cast("array<double>")), F.lit(1.0))
    near = scoped.where(F.lit(bool(query))).withColumn("score", similarity).select("chunk_id", "document_id", "seq", "score")
    near = near.orderBy(F.desc("score"), "chunk_id").limit(candidates)
    if len(term) >= MIN_KEYWORD:
        words = keyword_topk(scoped, term, candidates).select("chunk_id", "document_id", "seq", "score")
    else:
        words = scoped.where("false").select("chunk_id", "document_id", "seq", F.lit(0.0).alias("score"))
    found = fuse(near, words, k)
    texts = scoped.select("chunk_id", "text").join(F.broadcast(found), "chunk_id")  # k rows
    by_words = F.col("match_kind") != "vector"
    snippet, offset = keyword_snippet(F.col("text"), term) if term else (semantic_snippet(F.col("text")), F.lit(None).cast("int"))
    shown = {"snippet": F.when(by_words, snippet).otherwise(semantic_snippet(F.col("text"))), "hit_offset": F.when(by_words, offset)}
    return texts.withColumns(shown).drop("text").orderBy(F.desc("fused"), "document_id", "seq")


# What is said where there is nothing to explain.
EMPTY_SCOPE, EMPTY_QUERY = "검색 범위가 비어 있다 (멤버인 프로젝트가 없음).", "질의 임베딩이 비어 있어 계획을 낼 수 없다."


def explain_search(vectors: DataFrame, query: list[float], model: str, projects: list[int], k: int = CANDIDATES, whole: bool = False) -> str:
    """How the nearest chunks of a scope are found, without the query's numbers; a sentence if there is nothing to look for."""
    if not projects:
        return EMPTY_SCOPE
    if not query:
        return EMPTY_QUERY
    return plan_summary(vector_topk(vectors, query, model, projects, k), whole)


def group_hits(hits: DataFrame) -> DataFrame:
    """Hits (document_id, rank, similarity) by document, in the order of its best hit."""
    return hits.groupBy("document_id").agg(F.min("rank").alias("best_rank"), F.max("similarity").alias("best_similarity"), F.count("*").alias("hits"))


def with_semantic_snippet(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("snippet", semantic_snippet(F.col("text")))
