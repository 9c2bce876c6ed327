"""The public names. Where others take lists, these take and give DataFrames or columns; records are schemas of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stylograph.functions.text import clean
from stylograph.operators.exemplars import curate
from stylograph.operators.model import GenerationError, extract_facts, generate_candidates, should_interject
from stylograph.operators.model import generate_replies as generate_reply
from stylograph.operators.profile import StyleProfile
from stylograph.operators.profile import collect_profile as analyze
from stylograph.operators.safety import CategoryData, SafetyCategory, SafetyMatch, SafetyScore, is_flagged, load_categories, score_text
from stylograph.plans.render import render_style_guide
from stylograph.sources.archive import own_posts
from stylograph.sources.archive import read_archive as load_archive

#: A row of an archive, in file order by `pos`.
ArchivePost = T.StructType(
    [
        T.StructField("pos", T.LongType(), False), T.StructField("id", T.StringType(), False), T.StructField("text", T.StringType(), False), T.StructField("created_at", T.StringType(), False),
        T.StructField("is_reply", T.BooleanType(), False), T.StructField("is_retweet", T.BooleanType(), False),
    ]
)
#: A row of `curate`.
Exemplar = T.StructType([T.StructField("pos", T.LongType(), False), T.StructField("text", T.StringType(), False), T.StructField("score", T.IntegerType(), False), T.StructField("on_brand", T.BooleanType(), False)])


def own_post_texts(posts: DataFrame, include_replies: bool = False) -> DataFrame:
    """(pos, text) of the posts that are one's own: no retweets, no replies (unless wanted), more than mentions."""
    return own_posts(posts, include_replies).select("pos", "text")


__all__ = [
    "ArchivePost", "CategoryData", "Exemplar", "GenerationError", "SafetyCategory", "SafetyMatch", "SafetyScore", "StyleProfile", "analyze", "clean", "curate", "extract_facts", "generate_candidates",
    "generate_reply", "is_flagged", "load_archive", "load_categories", "own_post_texts", "render_style_guide", "score_text", "should_interject",
]
