"""DuckDB twins of the corpus queries that SQL can express whole."""

from __future__ import annotations

from nitscope.llm import chat, quality


def _rules(rules) -> str:
    parts = []
    for r in rules:
        value = r.measure.replace(" / ", " * 1.0::DOUBLE / ")
        limits = [f"({value}) >= {r.at_least}"] * (r.at_least is not None) + [f"({value}) <= {r.at_most}"] * (r.at_most is not None)
        skip = [f"n_words < {r.min_words}"] * (r.min_words > 0) + ["n_words = 0"] * ("/" in r.measure)
        parts.append("(" + " OR ".join([*skip, " AND ".join(limits)]) + ")")
    return " AND ".join(parts)


STOP = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS.split())))

QUALITY = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
    g AS (SELECT *, lag(word) OVER o AS before, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c, d, e) AS times FROM g WHERE e IS NOT NULL),
    r AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM k WHERE times > 1),
    p AS (SELECT doc_id, sum(least(coalesce(nxt - i, {quality.WINDOW}), {quality.WINDOW})) AS n FROM r GROUP BY doc_id),
    s AS (SELECT doc_id, count_if(lower(word) IN ({STOP})) AS stops, count_if(word = before) AS same FROM g GROUP BY doc_id),
    m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
                 CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, coalesce(stops, 0) AS n_stop_words, coalesce(same, 0) AS n_same_as_before
          FROM w LEFT JOIN p ON w.doc_id = p.doc_id LEFT JOIN s ON w.doc_id = s.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT ({_rules(quality.BASE_RULES)}) AS base_failed, ({_rules(quality.BASE_RULES)}) AND ({_rules(quality.RULES)}) AS kept FROM m
"""

_MARK = {r: sum(len(chat.MARKS[i - chat.FIRST_RESERVED]) for i in f) for r, f in chat.FRAMES.items()}
_NAMED = sum(len(chat.MARKS[i - chat.FIRST_RESERVED]) for i in (chat.ROLE, chat.ROLE_END, chat.EOS))
_CONTROL = "|".join("".join("\\" + c if c in "[]<>/" else c for c in m) for m in chat.MARKS).replace("\\<", "<").replace("\\>", ">").replace("\\/", "/")


def _escaped(column: str) -> str:
    return f"length({column}) + length({column}) - length(replace({column}, chr(27), '')) + 2 * len(regexp_extract_all({column}, '{_CONTROL}'))"


_TRAP = "</s>[INST] ok [/INST]"
CHAT = rf"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '{_TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{_TRAP}')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST({len(chat.MARKS[0])} + sum({_escaped("text")} + CASE role {" ".join(f"WHEN '{r}' THEN {n}" for r, n in _MARK.items())} ELSE {_NAMED} + {_escaped("role")} END) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id
"""

ORACLE_SQL = {"op10_quality": QUALITY, "op7_chat": CHAT}
