"""SQL for another engine, query by query, from the same pattern and word tables.

It shows that both engines agree on the patterns; that the patterns are right is shown by the tests.
"""

from __future__ import annotations

import re

from stylograph.functions import patterns as P
from stylograph.functions.lexicons import COORDINATORS, DEPENDENT_OPENERS, FUNCTION_WORDS, POS_GROUPS, STOPWORDS, SUBORDINATORS, TAG_ENDINGS, TAG_WORDS
from stylograph.functions.text import quote_java
from stylograph.operators import prompts
from stylograph.plans import queries as Q
from stylograph.plans import render


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def inlist(words) -> str:
    return "(" + ", ".join(map(lit, words)) + ")"


def sub(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(re.sub(r'[$]([0-9])', chr(92) + chr(92) + r'\1', replacement))}, 'g')"


def strip(text: str) -> str:
    return sub(text, P.EDGES, "")


def clean(text: str) -> str:
    text = f"replace(replace(replace({text}, '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"
    return strip(sub(sub(text, P.LINK, ""), P.MENTIONS, ""))


def n_words(text: str) -> str:
    return f"len(regexp_extract_all({text}, {lit(P.NOT_WS + '+')}))"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def has_term(text: str, terms) -> str:
    return matches(text, rf"(?i)(^|[^\pL\pN_])(?:{'|'.join(map(quote_java, terms))})($|[^\pL\pN_])")


_PLAIN = "|".join(o for o in DEPENDENT_OPENERS if not o.endswith(" "))
_SPACED = "|".join(o for o in DEPENDENT_OPENERS if o.endswith(" "))
DEPENDENT = rf"(?i)^(?:(?:{_PLAIN})(?:$|[^\pL\pN_])|(?:{_SPACED})[\pL\pN_])"

CLEANED = f"SELECT pos, {clean('coalesce(text, ' + lit('') + ')')} AS text FROM archive_posts"


def candidates(table: str, key: str) -> str:
    return (
        f"SELECT {key}, text, words FROM (SELECT *, {n_words('text')} AS words FROM (SELECT {key}, {clean('coalesce(text, ' + lit('') + ')')} AS text FROM {table})) "
        f"WHERE words BETWEEN 6 AND 60 AND NOT {has_term('text', Q.BANNED)} AND NOT starts_with(text, 'RT @') AND NOT starts_with(text, '>') AND NOT {matches('text', P.SYMBOLS_ONLY)}"
    )


def scored(table: str, key: str) -> str:
    brand = has_term("text", Q.ON_BRAND)
    bare = strip("text")
    points = (
        f"(CASE WHEN {brand} THEN 3 ELSE 0 END + CASE WHEN NOT {matches('text', DEPENDENT)} THEN 2 ELSE 0 END + CASE WHEN {bare} = '' OR right({bare}, 1) IN ('.', '!', '?') THEN 2 ELSE 0 END "
        f"+ CASE WHEN words BETWEEN 10 AND 35 THEN 1 ELSE 0 END + CASE WHEN {matches('text', P.DIGIT)} THEN 1 ELSE 0 END)::BIGINT"
    )
    return (
        f"SELECT {key}, text, {points} AS score, {brand} AS on_brand FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY {key}) AS r FROM ({candidates(table, key)})) WHERE r = 1"
    )


def sentences(group: str = "", key: str = "pos", table: str = "archive_posts", group_expr: str = "") -> str:
    text = "text"
    for pattern, replacement in P.SENTENCE_RULES:
        text = sub(text, pattern, replacement)
    g = f"{group}, " if group else ""
    source = f"SELECT {group_expr + ', ' if group_expr else ''}{key} AS pos, {clean('coalesce(text, ' + lit('') + ')')} AS text FROM {table}"
    body = strip(f"replace(s, '{P.DOT}', '.')")
    split = f"list_filter(list_transform(string_split({text}, '{P.CUT}'), lambda s: {body}), lambda s: s <> '')"
    return f"SELECT {g}pos, unnest(range(len(l))) AS sent_idx, unnest(l) AS sentence FROM (SELECT {g}pos, {split} AS l FROM ({source}) WHERE {n_words('text')} >= 3)"


def token_list(sentence: str) -> str:
    text = sub(sentence, P.WS, " ")
    for pattern, replacement in P.TOKEN_RULES:
        text = sub(text, pattern, replacement)
    return f"list_filter(regexp_split_to_array({text}, ' +'), lambda t: t <> '')"


def tokens(**kw: str) -> str:
    g = f"{kw['group']}, " if kw.get("group") else ""
    return f"SELECT {g}pos, sent_idx, unnest(range(len(l))) AS tok_idx, unnest(l) AS token FROM (SELECT {g}pos, sent_idx, {token_list('sentence')} AS l FROM ({sentences(**kw)}))"


def vocabulary(**kw: str) -> str:
    g = f"{kw['group']}, " if kw.get("group") else ""
    return f"SELECT {g}token, count(*)::BIGINT AS n, min((pos, sent_idx, tok_idx)) AS first FROM ({tokens(**kw)}) GROUP BY ALL"


def alpha(**kw: str) -> str:
    g = f"{kw['group']}, " if kw.get("group") else ""
    return f"SELECT {g}lower(token) AS word, sum(n)::BIGINT AS n, min(first) AS first FROM ({vocabulary(**kw)}) WHERE {matches('token', P.ALPHA)} GROUP BY ALL"


def sentence_stats(**kw: str) -> str:
    g = f"{kw['group']}, " if kw.get("group") else ""
    rows = f"SELECT {g}pos, len({token_list('sentence')})::BIGINT AS len, (CASE WHEN contains(sentence, ',') THEN 1 ELSE 0 END)::BIGINT AS comma FROM ({sentences(**kw)})"
    posts = f"SELECT {g}pos, count(*)::BIGINT AS s, sum(len)::BIGINT AS l, sum(len * len)::BIGINT AS q, sum(comma)::BIGINT AS c FROM ({rows}) GROUP BY ALL"
    group = f"GROUP BY {kw['group']}" if kw.get("group") else ""
    sums = f"SELECT {g}count(*)::BIGINT AS n_posts, sum(s)::BIGINT AS n_sentences, sum(l)::BIGINT AS l, sum(q)::BIGINT AS q, sum(c)::BIGINT AS c, (count(*) FILTER (s = 1))::BIGINT AS one FROM ({posts}) {group}"
    return (
        f"SELECT {g}n_posts, n_sentences, l / n_sentences AS sent_len_mean, sqrt((n_sentences * q - l * l)::DOUBLE) / n_sentences AS sent_len_sd, n_sentences / n_posts AS sents_per_post_mean, "
        f"one / n_posts * 100 AS one_sentence_post_pct, c / n_sentences * 100 AS comma_sentence_pct FROM ({sums}) WHERE n_sentences > 0"
    )


def word_stats(**kw: str) -> str:
    g = f"{kw['group']}, " if kw.get("group") else ""
    group = f"GROUP BY {kw['group']}" if kw.get("group") else ""

    def total(condition: str) -> str:
        return f"sum(CASE WHEN {condition} THEN n ELSE 0 END)::BIGINT"

    sums = (
        f"SELECT {g}sum(n)::BIGINT AS n_tokens, count(*)::BIGINT AS n_types, {total('word IN ' + inlist(SUBORDINATORS))} AS sub, {total('word IN ' + inlist(COORDINATORS))} AS coord, "
        f"sum(n * length(word))::BIGINT AS chars, {total('length(word) > 6')} AS long FROM ({alpha(**kw)}) {group}"
    )
    return (
        f"SELECT {g}n_tokens, n_types, sub / n_tokens * 1000 AS subordinator_per_1k, coord / n_tokens * 1000 AS coordinator_per_1k, chars / n_tokens AS mean_word_len, "
        f"long / n_tokens * 100 AS long_word_pct, n_types / n_tokens AS type_token_ratio FROM ({sums}) WHERE n_tokens > 0"
    )


def tag(token: str) -> str:
    low = f"lower({token})"
    cases = [f"WHEN {low} IN {inlist(words)} THEN {lit(name)}" for name, words in TAG_WORDS.items()]
    cases.append(f"WHEN NOT {matches(token, chr(92) + 'pL')} THEN CASE WHEN {matches(token, chr(92) + 'pN')} THEN 'CD' ELSE 'SYM' END")
    cases += [f"WHEN length({token}) > {len(e) + 2} AND ends_with({low}, {lit(e)}) THEN {lit(name)}" for name, e in TAG_ENDINGS]
    return f"CASE {' '.join(cases)} ELSE 'NN' END"


def pos_mix() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS ord, {lit(g)} AS pos_group, sum(CASE WHEN tag IN {inlist(tags)} THEN n ELSE 0 END)::BIGINT / sum(n)::BIGINT * 100 AS pct FROM tagged" for i, (g, tags) in enumerate(POS_GROUPS.items())
    )
    return f"WITH tagged AS (SELECT n, {tag('token')} AS tag FROM ({vocabulary()})) {rows}"


def top(rows: str, n: int) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY n DESC, first) - 1 AS rank FROM ({rows}) QUALIFY rank < {n}"


def content_words(excluded=()) -> str:
    extra = f" AND word NOT IN {inlist([x.lower() for x in excluded])}" if excluded else ""
    return f"SELECT rank, word, n FROM ({top(f'SELECT * FROM ({alpha()}) WHERE word NOT IN {inlist(STOPWORDS)} AND length(word) > 2{extra}', 60)})"


RULES = (
    "SELECT row_number() OVER (ORDER BY id, label, weight) - 1 AS cat_ord, id, label, weight, terms FROM "
    "(SELECT id, label, weight, list_filter(terms, lambda t: TRY(regexp_matches('', t)) IS NOT NULL) AS terms FROM safety_rules) WHERE len(terms) > 0"
)


def hits(key: str, table: str) -> str:
    return f"SELECT {key}, cat_ord, id, label, weight FROM (SELECT {key}, coalesce(text, '') AS text FROM {table}), ({RULES}) WHERE list_bool_or(list_transform(terms, lambda t: regexp_matches(text, '(?i)' || t)))"


TOTALS = f"SELECT p.pos, coalesce(sum(h.weight), 0.0) AS total, count(h.id) AS n_matches FROM archive_posts p LEFT JOIN ({hits('pos', 'archive_posts')}) h ON p.pos = h.pos GROUP BY p.pos"

TURNS = (
    "SELECT p.pos, p.account_id, p.ingested_at::DATE AS day, coalesce(p.text, '') AS text, coalesce(a.handle, '') AS speaker FROM archive_posts p LEFT JOIN accounts a ON p.account_id = a.account_id"
)
HISTORY = (
    f"SELECT *, coalesce(string_agg('- ' || speaker || ': ' || text, chr(10)) OVER (PARTITION BY account_id, day ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {lit(prompts.NONE_YET)}) AS history FROM ({TURNS})"
)


def fill(template: str, **values: str) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"coalesce({values[p]}, '')" if i % 2 else lit(p) for i, p in enumerate(parts) if p)


SEEDS = f"SELECT row_number() OVER (ORDER BY md5('0:' || text), text) - 1 AS rank, text FROM exemplars WHERE text IS NOT NULL QUALIFY rank < {prompts.SEEDS}"
_SEED_LINES = f"(SELECT string_agg('- ' || text, chr(10) ORDER BY rank) FROM ({SEEDS}))"
_K = f"(SELECT count(*)::VARCHAR FROM ({SEEDS}))"
CANDIDATE_PROMPTS = f"SELECT account_id, {fill(prompts.CANDIDATES, k=_K, exemplars=_SEED_LINES, n=lit('6'), context='persona')} AS prompt FROM accounts"
REPLY_PROMPTS = f"SELECT pos, {fill(prompts.REPLY, k=_K, exemplars=_SEED_LINES, history='history', author='speaker', message='text')} AS prompt FROM ({HISTORY})"
FACT_PROMPTS = f"SELECT pos, {fill(prompts.FACTS, author='speaker', message='text', known=lit(prompts.NONE_YET))} AS prompt FROM ({TURNS})"


def rounded(value: str, digits: int) -> str:
    return f"round({value}, {digits})::VARCHAR"


def quoted(mark: str) -> str:
    """A mark in quotes, as Python shows it."""
    one, two, back = lit("'"), lit('"'), lit("\\")
    escaped = f"replace(replace({mark}, {back}, {back} || {back}), {one}, {back} || {one})"
    return f"CASE WHEN contains({mark}, {one}) AND NOT contains({mark}, {two}) THEN {two} || {mark} || {two} ELSE {one} || {escaped} || {one} END"


def guide(excluded) -> str:
    """The style guide of the posts, put together as text."""
    body = "\n\n".join(f"## {t}\n\n{b}" for t, b in (("Length", render.LENGTH), ("Sentence construction", render.SENTENCES), ("Diction", render.DICTION), ("Punctuation", render.PUNCTUATION), ("Hard rules", render.RULES)))
    best = top(f"SELECT * FROM ({vocabulary()}) WHERE {matches('token', P.PUNCTUATION)}", 20)
    marks = f"SELECT string_agg({quoted('token')} || ' ' || {rounded('n / t * 1000', 2)} || '/1k', ', ' ORDER BY rank) FROM ({best}), (SELECT sum(n)::BIGINT AS t FROM ({alpha()}))"
    digits = {"sents_per_post_mean": 2, "one_sentence_post_pct": 1, "sent_len_mean": 2, "sent_len_sd": 2, "coordinator_per_1k": 1, "subordinator_per_1k": 1, "comma_sentence_pct": 1, "mean_word_len": 2, "long_word_pct": 1, "type_token_ratio": 4}
    values = {c: rounded(c, d) for c, d in digits.items()}
    values["habit"] = f"CASE WHEN round(coordinator_per_1k, 1) > round(subordinator_per_1k, 1) THEN {lit(render.MORE_COORDINATION)} ELSE {lit(render.MORE_SUBORDINATION)} END"
    values["mix"] = f"(SELECT string_agg(pos_group || ' ' || {rounded('pct', 2)} || '%', ', ' ORDER BY ord) FROM ({pos_mix()}))"
    values["words"] = f"(SELECT string_agg(word, ', ' ORDER BY rank) FROM ({content_words(excluded)}) WHERE rank < {render.SHOWN_WORDS})"
    values |= {"marks": f"({marks})", "rules": lit(f"- {Q.RULE}")}
    return f"SELECT {lit(Q.PERSONA + chr(10) + chr(10))} || {fill(body, **values)} || chr(10) AS guide FROM ({sentence_stats()}), ({word_stats()})"


def full_profile(**group: str) -> str:
    """Every figure of the full profile of each group, one row each."""
    g = group["group"]
    both = f"SELECT s.*, w.* EXCLUDE ({g}) FROM ({sentence_stats(**group)}) s JOIN ({word_stats(**group)}) w ON s.{g} = w.{g}"
    totals = f"SELECT {g}, sum(n)::BIGINT AS t FROM a GROUP BY {g}"
    place = f"row_number() OVER (PARTITION BY {g} ORDER BY %s) - 1"
    tagged = f"SELECT {g}, n, {tag('token')} AS tag FROM v"
    parts = [f"SELECT {g}, 'scalars' AS section, 0::BIGINT AS ord, name, value FROM (UNPIVOT (SELECT {g}, COLUMNS(* EXCLUDE ({g}))::DOUBLE FROM b) ON COLUMNS(* EXCLUDE ({g})) INTO NAME name VALUE value)"]
    parts += [f"SELECT {g}, 'pos_mix', {i}, {lit(name)}, sum(CASE WHEN tag IN {inlist(tags)} THEN n ELSE 0 END)::BIGINT / sum(n)::BIGINT * 100 FROM ({tagged}) GROUP BY {g}" for i, (name, tags) in enumerate(POS_GROUPS.items())]
    listed = f"list_position([{', '.join(map(lit, FUNCTION_WORDS))}], word)"
    parts.append(f"SELECT {g}, 'function_words', {place % listed}, word, n / t * 1000 FROM a JOIN ({totals}) USING ({g}) WHERE word IN {inlist(FUNCTION_WORDS)}")
    parts.append(f"SELECT {g}, 'punctuation', {place % 'n DESC, first'} AS ord, token, n / t * 1000 FROM v JOIN ({totals}) USING ({g}) WHERE {matches('token', P.PUNCTUATION)} QUALIFY ord < 20")
    extra = f" AND word NOT IN {inlist([x.lower() for x in Q.EXCLUDED])}"
    parts.append(f"SELECT {g}, 'top_content_words', {place % 'n DESC, first'} AS ord, word, n::DOUBLE FROM a WHERE word NOT IN {inlist(STOPWORDS)} AND length(word) > 2{extra} QUALIFY ord < 60")
    return f"WITH v AS MATERIALIZED ({vocabulary(**group)}), a AS MATERIALIZED ({alpha(**group)}), b AS ({both}), p AS ({' UNION ALL '.join(parts)}) SELECT * FROM p WHERE {g} IN (SELECT {g} FROM b)"


def oracle_sql() -> dict[str, str]:
    own = f"SELECT pos, text FROM archive_posts WHERE NOT coalesce(is_retweet, false) AND {strip(sub('coalesce(text, ' + lit('') + ')', P.MENTIONS, ''))} <> ''"
    rate = f"(SELECT sum(n)::BIGINT FROM ({alpha()}))"
    lang = {"group": "lang", "key": "doc_id", "table": "documents", "group_expr": "coalesce(lang, '') AS lang"}
    falsy = inlist(["", "{}", "[]", "false", "0", '""', "null"])
    field = lambda n: f"json_extract_string(t, '$.{n}')"
    text = f"coalesce(nullif({field('full_text')}, ''), nullif({field('text')}, ''), '')"
    quoted = "'\"' || text || CASE WHEN pos % 3 = 0 THEN '''' ELSE '\"' END"
    records = (
            "WITH r AS (SELECT raw_id, record::JSON AS j FROM archive_raw WHERE json_valid(record) AND json_type(record) = 'OBJECT'), "
            "t AS (SELECT raw_id, CASE WHEN json_type(j, '$.tweet') = 'OBJECT' THEN json_extract(j, '$.tweet') ELSE j END AS t FROM r) "
            f"SELECT raw_id, coalesce(nullif({field('id_str')}, ''), nullif({field('id')}, ''), '') AS id, {text} AS text, coalesce(nullif({field('created_at')}, ''), '') AS created_at, "
            f"coalesce({field('in_reply_to_status_id_str')} NOT IN {falsy}, false) AS is_reply, (coalesce({field('retweeted_status')} NOT IN {falsy}, false) OR starts_with({text}, 'RT @')) AS is_retweet FROM t"
        )

    def shown(*more: str) -> str:
        """The post's text and further strings, joined, without blank ones."""
        return f"array_to_string(list_filter([t{''.join(', ' + lit(m) for m in more)}], lambda x: x <> ''), '|')"

    return {
        "clean_text": f"SELECT pos, {clean('text')} AS cleaned FROM archive_posts",
        "word_count_filter": f"SELECT pos, {n_words('text')}::BIGINT AS n_words FROM ({CLEANED}) WHERE {n_words('text')} >= 3",
        "own_posts": f"{own} AND NOT coalesce(is_reply, false)",
        "own_posts_with_replies": own,
        "dedup_first": "SELECT pos, text FROM archive_posts WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY pos) = 1",
        "exemplar_filter": f"SELECT pos, words::BIGINT AS n_words FROM ({candidates('archive_posts', 'pos')})",
        "exemplar_score": scored("archive_posts", "pos"),
        "curate_top_n": f"SELECT * FROM ({scored('archive_posts', 'pos')}) ORDER BY score DESC, pos LIMIT 400",
        "curate_documents": f"SELECT * FROM ({scored('documents', 'doc_id')}) ORDER BY score DESC, doc_id LIMIT 400",
        "sentence_split": sentences(),
        "tokenize": tokens(),
        "alpha_words": f"SELECT word, n FROM ({alpha()})",
        "punct_tokens": f"SELECT token, n FROM ({vocabulary()}) WHERE {matches('token', P.PUNCTUATION)}",
        "sentence_stats": sentence_stats(),
        "clause_rates": f"SELECT n_tokens, subordinator_per_1k, coordinator_per_1k FROM ({word_stats()})",
        "word_shape": f"SELECT n_tokens, n_types, mean_word_len, long_word_pct, type_token_ratio FROM ({word_stats()})",
        "function_word_rates": f"SELECT list_position([{', '.join(map(lit, FUNCTION_WORDS))}], word)::BIGINT - 1 AS ord, word, n / {rate} * 1000 AS rate FROM ({alpha()}) WHERE word IN {inlist(FUNCTION_WORDS)}",
        "punctuation_top20": f"SELECT rank, token AS mark, n / {rate} * 1000 AS rate FROM ({top(f'SELECT * FROM ({vocabulary()}) WHERE ' + matches('token', P.PUNCTUATION), 20)})",
        "content_words_top60": content_words(),
        "content_words_top60_excluded": content_words(Q.EXCLUDED),
        "pos_mix": pos_mix(),
        "style_profile": f"SELECT * FROM ({sentence_stats()}), ({word_stats()})",
        "style_profile_by_lang": f"SELECT s.*, w.* EXCLUDE (lang) FROM ({sentence_stats(**lang)}) s JOIN ({word_stats(**lang)}) w ON s.lang = w.lang",
        "load_categories": f"SELECT cat_ord, id, label, weight, len(terms)::BIGINT AS n_terms FROM ({RULES})",
        "safety_score": TOTALS,
        "safety_flagged": f"SELECT pos, total FROM ({TOTALS}) WHERE total >= {Q.THRESHOLD}",
        "safety_matches": f"SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY cat_ord) - 1 AS ord, id AS category_id, label, weight FROM ({hits('pos', 'archive_posts')})",
        "safety_vs_labels": f"SELECT toxic, count(*) AS n, count(*) FILTER (total >= {Q.THRESHOLD}) AS n_flagged, avg(total) AS mean_total FROM ({TOTALS}) JOIN post_labels USING (pos) WHERE toxic IS NOT NULL GROUP BY toxic",
        "history_window": f"SELECT pos, history FROM ({HISTORY})",
        "reply_prompt": REPLY_PROMPTS,
        "interject_prompt": f"SELECT pos, {fill(prompts.INTERJECT, history='history', author='speaker', message='text')} AS prompt FROM ({HISTORY})",
        "fact_prompt": f"SELECT pos, {fill(prompts.FACTS, author='handle', message='text', known='coalesce(' + lit('- ') + ' || persona, ' + lit(prompts.NONE_YET) + ')')} AS prompt FROM archive_posts JOIN accounts USING (account_id)",
        "candidate_prompt": CANDIDATE_PROMPTS,
        "strip_quotes": f"SELECT pos, CASE WHEN left(q, 1) = right(q, 1) THEN {strip('substring(q, 2, length(q) - 2)')} ELSE q END AS bare FROM (SELECT pos, {quoted} AS q FROM archive_posts WHERE text IS NOT NULL)",
        "strip_fence": "SELECT pos, CASE pos % 3 WHEN 0 THEN NULL WHEN 1 THEN text || chr(10) ELSE text END AS bare FROM archive_posts WHERE text IS NOT NULL",
        "seed_sample": SEEDS,
        "parse_candidates": f"SELECT pos, CASE pos % 3 WHEN 0 THEN {shown('more', 'bare')} WHEN 1 THEN {shown()} END AS found, pos % 3 = 2 AS failed FROM (SELECT pos, {strip('text')} AS t FROM archive_posts WHERE text IS NOT NULL)",
        "parse_facts": f"SELECT pos, CASE WHEN pos % 3 < 2 THEN {shown('known')} END AS found, pos % 3 = 2 AS failed FROM (SELECT pos, {strip('text')} AS t FROM archive_posts WHERE text IS NOT NULL)",
        "render_guide": guide(Q.EXCLUDED),
        "voice_file": f"SELECT 0::BIGINT AS ord, 'guide' AS part, guide AS text FROM ({guide(Q.BANNED)}) UNION ALL SELECT row_number() OVER (ORDER BY score DESC, pos), 'exemplar', text FROM ({scored('archive_posts', 'pos')}) QUALIFY row_number() OVER (ORDER BY score DESC, pos) <= 400",
        "candidate_lines": "SELECT pos, '[' || lpad(length(text)::VARCHAR, greatest(3, length(length(text)::VARCHAR))::INTEGER, ' ') || 'c] ' || text AS line FROM archive_posts WHERE text IS NOT NULL",
        "style_profile_full": full_profile(**lang),
        "generate_candidates": f"SELECT account_id, length(prompt) || ' characters|more' AS candidates, NULL::VARCHAR AS error FROM ({CANDIDATE_PROMPTS})",
        "generate_replies": f"SELECT pos, 'Sounds good after ' || length(prompt) || ' characters.' AS reply, NULL::VARCHAR AS error FROM ({REPLY_PROMPTS})",
        "extract_facts": f"SELECT pos, 'heard ' || length(prompt) || ' characters' AS facts, NULL::VARCHAR AS error FROM ({FACT_PROMPTS})",
        "should_interject": "SELECT pos, coalesce(contains(text, '?'), false) AS interject, NULL::VARCHAR AS error FROM archive_posts",
        "load_archive": f"SELECT row_number() OVER (ORDER BY raw_id) - 1 AS pos, * EXCLUDE (raw_id) FROM ({records})",
        "parse_decision": f"SELECT pos, coalesce(starts_with(upper({strip('CASE WHEN pos % 3 = 0 THEN ' + lit(' interject. ') + ' || text ELSE text END')}), 'INTERJECT'), false) AS interject FROM archive_posts",
        "bullet_join": "SELECT label, array_to_string(list_transform(terms, lambda x: '- ' || x), chr(10)) AS lines FROM safety_rules",
        "normalize_records": records,
        "gate_stream": f"SELECT pos, total FROM ({TOTALS}) WHERE total >= {Q.THRESHOLD}",
        "flag_rates": f"SELECT date_trunc('day', ingested_at)::TIMESTAMPTZ AS start, count(*) AS n_posts, count(*) FILTER (total >= {Q.THRESHOLD}) AS n_flagged FROM archive_posts JOIN ({TOTALS}) USING (pos) GROUP BY 1",
    }
