"""Ranked lexical search: scores, folding of aliases, keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import contains_any, count_terms, query_terms
from tessera.operators.relational import after, once, ordered_set, pick

#: Fixed values of the ranking.
WEIGHTS = {
    "exact_path": 1000,
    "path_suffix": 800,
    "name_exact": 700,
    "name_prefix": 400,
    "path_token": 200,
    "signature_token": 120,
    "summary_token": 80,
    "docs_token": 40,
    "definition_path": 5,
    "subject_exact": 600,
    "subject_token": 150,
    "text_token": 50,
}


def _sum(points: list[tuple[str, Column, Column]]) -> Column:
    """Null where no factor holds, else the sum of the factors' points, with the factors in rule order."""
    factors = F.filter(F.array(*(F.when(c, F.struct(F.lit(n).alias("factor"), p.cast("int").alias("points"))) for n, c, p in points)), lambda x: x.isNotNull())
    return F.when(F.size(factors) > 0, F.struct(F.aggregate(factors, F.lit(0), lambda a, x: a + x["points"]).alias("score"), factors.alias("factors")))


def _fragment_rules(exact: Column, token: Column, hits: Column) -> list[tuple[str, Column, Column]]:
    return [
        ("subject_exact", exact, F.lit(WEIGHTS["subject_exact"])),
        ("subject_token", token, F.lit(WEIGHTS["subject_token"])),
        ("text_token", hits > 0, F.least(hits, F.lit(3)) * WEIGHTS["text_token"]),
    ]


def rank_fragment(query: str, subject: Column, text: Column) -> Column:
    q, wanted = query.strip().lower(), query_terms(query)
    subject = F.lower(subject)
    return _sum(_fragment_rules(F.coalesce(subject == q, F.lit(False)) & F.lit(q != ""), contains_any(subject, wanted), count_terms(F.lower(text), wanted)))


def score_fragments(rows: DataFrame, query: str, subject: str, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``score`` of the rows that rank at all; a text is lowered and looked through once."""
    q, wanted = query.strip().lower(), query_terms(query)
    low = once(rows.select(*keep, F.col(text).alias("__text"), F.col(subject).alias("__subject")), __low=F.lower("__text"), __name=F.lower("__subject")).drop("__text", "__subject")
    name = F.col("__name")
    facts = once(low, __exact=F.coalesce(name == q, F.lit(False)) & F.lit(q != ""), __token=contains_any(name, wanted), __hits=count_terms(F.col("__low"), wanted))
    score = F.lit(0)
    for _, condition, points in _fragment_rules(F.col("__exact"), F.col("__token"), F.col("__hits")):
        score = score + F.when(condition, points).otherwise(0)
    return facts.select(*keep, score.cast("int").alias("score")).where("score > 0")


def rank_symbol(query: str, path: Column, name: Column, signature: Column, summary: Column, docs: Column, reexport: Column) -> Column:
    q, wanted = query.strip().lower(), query_terms(query)
    some = F.lit(q != "")
    path, name, signature, summary, docs = map(F.lower, (path, name, signature, summary, docs))
    is_true = lambda c: F.coalesce(c, F.lit(False))
    exact = is_true(path == q) & some
    suffix = is_true(F.endswith(path, F.lit("::" + q)) | F.endswith(path, F.lit("." + q))) & some & ~exact
    named = is_true(name == q) & some & ~exact & ~suffix
    begins = F.lit(False)
    for term in wanted:
        begins = begins | is_true(F.startswith(name, F.lit(term)))
    rules = [("exact_path", exact), ("path_suffix", suffix), ("name_exact", named), ("name_prefix", begins & ~(exact | named))]
    rules += [(label, contains_any(text, wanted)) for label, text in (("path_token", path), ("signature_token", signature), ("summary_token", summary), ("docs_token", docs))]
    matched = F.lit(False)
    for _, condition in rules:
        matched = matched | condition
    rules.append(("definition_path", matched & ~reexport))
    return _sum([(n, c, F.lit(WEIGHTS[n])) for n, c in rules])


def fold(hits: DataFrame, definition: str, order: list[Column], path: str) -> DataFrame:
    """The best hit of each definition, with the other matching paths in ``also_at``."""
    paths = hits.groupBy(definition).agg(ordered_set(F.col(path)).alias("__paths"))
    best = pick(hits, [definition], order)
    return best.join(paths, definition).withColumn("also_at", F.array_remove(F.col("__paths"), F.col(path))).drop("__paths")


def next_page(hits: DataFrame, position: list[tuple[str, bool, object]] | None, order: list[tuple[str, bool]], size: int) -> DataFrame:
    """Rows after a position (keyset), best first; ``size`` of them."""
    rows = hits.where(after(position)) if position else hits
    return rows.orderBy(*(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order)).limit(size)
