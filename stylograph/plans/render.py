"""A style guide in markdown from a measured profile; every number is the profile's own."""

from __future__ import annotations

from stylograph.operators.profile import StyleProfile

SHOWN_WORDS = 20
#: Lines of the guide, filled with the profile's figures; `habit` is one of the two that follow.
LENGTH = "- A post has {sents_per_post_mean} sentences on average; {one_sentence_post_pct}% have just one.\n- Tokens in a sentence: mean {sent_len_mean}, sd {sent_len_sd}; mix short and long alike."
SENTENCES = "- {habit}: {coordinator_per_1k}/1k coordinators against {subordinator_per_1k}/1k subordinators.\n- Commas occur in {comma_sentence_pct}% of sentences.\n- Shares of word classes: {mix}"
MORE_COORDINATION = "Joins clauses with and, but, so more than with because, although, which (coordination)"
MORE_SUBORDINATION = "Joins clauses with because, although, which at least as much as with and, but, so (subordination)"
DICTION = "- Words have {mean_word_len} letters on average; {long_word_pct}% are longer than 6.\n- Different words per word: {type_token_ratio}.\n- Words that come back: {words}."
PUNCTUATION = "Marks per 1,000 words: {marks}."
RULES = "These hold without exception:\n\n{rules}"


def render_style_guide(profile: StyleProfile, persona: str = "", rules: list[str] | None = None) -> str:
    """The guide: persona (if any), length, sentences, diction, punctuation and hard rules (if any)."""
    fields = vars(profile) | {
        "habit": MORE_COORDINATION if profile.coordinator_per_1k > profile.subordinator_per_1k else MORE_SUBORDINATION,
        "mix": ", ".join(f"{name} {share}%" for name, share in profile.pos_mix.items()),
        "words": ", ".join(word for word, _ in profile.top_content_words[:SHOWN_WORDS]),
        "marks": ", ".join(f"{mark!r} {rate}/1k" for mark, rate in profile.punctuation_per_1k.items()),
        "rules": "\n".join(f"- {rule}" for rule in rules or []),
    }
    sections = {"Length": LENGTH, "Sentence construction": SENTENCES, "Diction": DICTION, "Punctuation": PUNCTUATION} | ({"Hard rules": RULES} if rules else {})
    parts = [f"## {title}\n\n{body.format(**fields)}" for title, body in sections.items()]
    return "\n\n".join([persona.strip(), *parts] if persona else parts) + "\n"
