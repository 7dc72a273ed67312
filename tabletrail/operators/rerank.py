"""Final order of hits, with or without judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletrail import settings


def _placed(scored: DataFrame) -> DataFrame:
    """Add place to ranked hits: by falling final score; equal ones keep their order. Ranked hits were cut to a few per
    query; results that were never ranked, such as a listing of a whole corpus, get no place."""
    if "rank" not in scored.columns:
        return scored
    window = Window.partitionBy("query").orderBy(F.desc("final_score"), F.asc("rank"))
    return scored.withColumn("place", F.row_number().over(window))


def judged(
    hits: DataFrame,
    judgements: DataFrame,
    min_score: float = settings.MIN_JUDGED_SCORE,
    limit: int | None = None,
) -> DataFrame:
    """Hits of each query, re-scored; a hit without a judgement scores 0 and goes if `min_score` is above. With `limit`
    only the first hits of each query count."""
    first = hits if limit is None else hits.where(F.col("rank") <= limit)
    joined = first.join(judgements, ["query", "chunk_id"], "left")
    llm_score = F.coalesce("relevance_score", F.lit(0.0))
    scored = joined.withColumns(
        {
            "llm_score": llm_score,
            "operation": F.coalesce("operation", F.lit("UNKNOWN")),
            "explanation": F.coalesce("explanation", F.lit("")),
            "matched_via": F.coalesce("matched_via", F.lit("direct")),
            "final_score": F.round(
                F.col("hybrid_score") * settings.HYBRID_SHARE + llm_score * settings.JUDGED_SHARE, 4
            ),
        }
    )
    return _placed(scored.where(F.col("llm_score") >= min_score).drop("relevance_score"))


def unjudged(hits: DataFrame, per_table: bool = False) -> DataFrame:
    """All hits in hybrid order; operation and way of matching come from the chunk's own references.

    per_table: only names and operations of the table asked for count; needs `refs` on the hits.
    """
    operation = F.try_element_at("operations", F.lit(1))
    via_alias = F.size("aliases_used") > 0
    if per_table:
        own = F.filter("refs", lambda r: F.lower(r["canonical"]) == F.col("matched_canonical"))
        operation = F.try_element_at(F.transform(own, lambda r: r["ref_type"]), F.lit(1))
        via_alias = F.exists(own, lambda r: r["raw"] != r["canonical"])
    scored = hits.withColumns(
        {
            "llm_score": F.lit(0.0),
            "operation": F.coalesce(F.upper(F.trim(operation)), F.lit("UNKNOWN")),
            "explanation": F.lit(settings.UNJUDGED_NOTE),
            "matched_via": F.when(via_alias, "alias").otherwise("direct"),
            "final_score": F.round("hybrid_score", 4),
        }
    )
    return _placed(scored)


def rank_results(hits: DataFrame, judgements: DataFrame | None = None, **options) -> DataFrame:
    """Judged hits (options min_score, limit), or unjudged ones (option per_table); `judged` tells which. Other options raise."""
    if judgements is None:
        return unjudged(hits, **options).withColumn("judged", F.lit(False))
    return judged(hits, judgements, **options).withColumn("judged", F.lit(True))
