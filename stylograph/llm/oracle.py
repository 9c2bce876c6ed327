"""SQL of the training-data queries that SQL can express; the others are tested against brute force or exact round trips."""

from __future__ import annotations


def canon(text: str) -> str:
    return rf"regexp_replace(replace(replace(lower({text}), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{Nd}}]+', '', 'g')"


def _member(name: str) -> str:
    return f"nullif(json_extract_string(t, '$.{name}'), '')"


_TEXTS = [f"SELECT '{t}' AS tbl, {k} AS rec_id, {canon('text')} AS key FROM {t} WHERE regexp_matches(text, '[\\p{{L}}\\p{{Nd}}]')" for t, k in (("archive_posts", "pos"), ("exemplars", "exemplar_id"))]
_RAW_TEXT = canon(f"coalesce({_member('full_text')}, {_member('text')}, '')")
_RAW = (
    "SELECT 'archive_raw' AS tbl, raw_id AS rec_id, concat_ws(chr(31), "
    f"coalesce({_member('id_str')}, {_member('id')}, ''), coalesce({_member('created_at')}, ''), coalesce({_member('in_reply_to_status_id_str')}, ''), coalesce({_member('lang')}, ''), {_RAW_TEXT}) AS key FROM "
    "(SELECT raw_id, CASE WHEN json_type(j, '$.tweet') = 'OBJECT' THEN json_extract(j, '$.tweet') ELSE j END AS t FROM (SELECT raw_id, record::JSON AS j FROM archive_raw WHERE json_valid(record) AND json_type(record) = 'OBJECT')) "
    f"WHERE {_RAW_TEXT} <> ''"
)
_KEYS = " UNION ALL ".join([*_TEXTS, _RAW])
_GROUPS = f"SELECT tbl, rec_id, min(rec_id) OVER (PARTITION BY tbl, key) AS keep_id, count(*) OVER (PARTITION BY tbl, key) AS n_copies FROM ({_KEYS})"

_SPACES = r"\s\x{85}\p{Z}\x{200b}\x{feff}"
_T = "coalesce(text, '')"
_WORDS = rf"regexp_extract_all(lower({_T}), '\p{{L}}+(?:[''’]\p{{L}}+)*')"
_LINES = rf"list_filter(regexp_split_to_array({_T}, '[\n\r\x{{0b}}\x{{0c}}\x{{85}}\x{{2028}}\x{{2029}}]+'), lambda x: regexp_replace(x, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g') <> '')"


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part}::DOUBLE / {whole}::DOUBLE ELSE 0.0 END"


_VISIBLE = f"length(regexp_replace(t, '[{_SPACES}]+', '', 'g'))"
_STATS = (
    "SELECT pos, length(t)::BIGINT AS n_chars, len(l)::BIGINT AS n_lines, len(w)::BIGINT AS n_words, "
    f"{_share('coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)', 'len(w)')} AS mean_word_len, {_share('len(list_distinct(w))', 'len(w)')} AS type_token_ratio, "
    + _share(f"length(regexp_replace(t, '[\\p{{L}}\\p{{N}}{_SPACES}]+', '', 'g'))", _VISIBLE) + " AS symbol_ratio, " + _share("length(regexp_replace(t, '[^\\p{N}]+', '', 'g'))", _VISIBLE) + " AS digit_ratio, "
    + _share(f"len(list_filter(l, lambda x: regexp_matches(x, '[.!?…。][\"''”’»)\\]_*]*[{_SPACES}]*$')))", "len(l)") + " AS ended_line_share, "
    + _share("len(list_filter(w, lambda x: list_contains(c, x)))", "len(w)") + " AS common_word_share "
    f"FROM (SELECT pos, {_T} AS t, {_WORDS} AS w, {_LINES} AS l, (SELECT list(word) FROM common_words) AS c FROM archive_posts)"
)

#: Brute force, by counting the common words of all pairs that have one.
_WORD_SETS = rf"SELECT pos, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')) AS w FROM archive_posts WHERE pos IS NOT NULL"
_ALIKE = (
    f"WITH s AS MATERIALIZED (SELECT pos, w, len(w) AS n FROM ({_WORD_SETS}) WHERE len(w) >= 8), x AS MATERIALIZED (SELECT pos, n, unnest(w) AS word FROM s) "
    "SELECT a.pos AS pos_a, b.pos AS pos_b FROM x a JOIN x b ON a.word = b.word AND a.pos < b.pos GROUP BY a.pos, b.pos, a.n, b.n HAVING count(*) >= 0.7 * least(a.n, b.n)"
)
#: Classes of equal word sets, links between them, and the smallest class that each can reach.
_GROUPED = (
    f"WITH RECURSIVE c AS MATERIALIZED (SELECT pos, min(pos) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS n_copies FROM (SELECT pos, list_sort(w) AS k FROM ({_WORD_SETS}) WHERE len(w) >= 8)), "
    f"l AS MATERIALIZED (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM ({_ALIKE}) p JOIN c a ON p.pos_a = a.pos JOIN c b ON p.pos_b = b.pos WHERE a.class_id <> b.class_id), "
    "e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT DISTINCT class_id AS node, class_id AS label FROM c UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a AND r.label < e.b), "
    "g AS (SELECT node, min(label) AS group_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a) "
    "SELECT pos, class_id, group_id, n_copies, coalesce(n_links, 0) AS n_links FROM c JOIN g ON class_id = node LEFT JOIN n ON class_id = a"
)
#: Brute force, by every span of 200 characters; spans are told apart by their digests.
_SHARED = (
    "WITH d AS (SELECT doc_id, text, length(text) - 199 AS n FROM documents WHERE length(text) >= 200), g AS (SELECT doc_id, i, md5(substring(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(n)) AS i FROM d)), "
    "m AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING min(doc_id) < max(doc_id))), "
    "o AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT doc_id, i FROM m)), r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o) "
    "SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end FROM r GROUP BY doc_id, run"
)


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"SELECT tbl, keep_id, rec_id AS copy_id FROM ({_GROUPS}) WHERE rec_id <> keep_id",
        "p3_collapsed": f"SELECT tbl, keep_id, n_copies FROM ({_GROUPS}) WHERE rec_id = keep_id",
        "p4_stats": _STATS,
        "p5_found": _ALIKE,
        "p5_groups": _GROUPED,
        "p8_found": _SHARED,
        "p8_shared": (
            f"SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(s, 0)::BIGINT AS shared_chars, CASE WHEN coalesce(length(text), 0) > 0 THEN coalesce(s, 0)::DOUBLE / length(text) ELSE 0.0 END AS shared_share "
            f"FROM documents LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS s FROM ({_SHARED}) GROUP BY doc_id) USING (doc_id)"
        ),
    }
