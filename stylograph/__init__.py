"""Writing-style analytics on Spark DataFrames."""

from stylograph.api import (
    ArchivePost,
    CategoryData,
    Exemplar,
    GenerationError,
    SafetyCategory,
    SafetyMatch,
    SafetyScore,
    StyleProfile,
    analyze,
    clean,
    curate,
    extract_facts,
    generate_candidates,
    generate_reply,
    is_flagged,
    load_archive,
    load_categories,
    own_post_texts,
    render_style_guide,
    score_text,
    should_interject,
)

__version__ = "0.2.0"
__all__ = [
    "ArchivePost", "CategoryData", "Exemplar", "GenerationError", "SafetyCategory", "SafetyMatch", "SafetyScore", "StyleProfile", "analyze", "clean", "curate", "extract_facts", "generate_candidates",
    "generate_reply", "is_flagged", "load_archive", "load_categories", "own_post_texts", "render_style_guide", "score_text", "should_interject",
]
