"""Registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (chat, decontam, deleted_interp, exact_dedup, lang_crf, line_dedup, ngram_join, packing, paragraph_minhash, pfp, repair,
               simhash, stripes)
from .common import table

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public vocabulary file (installed on every machine, never copied)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_crf.language_report(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.substring_report(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_report(table(spark, sf_dir, "documents"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_minhash.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interp.score_texts(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_extra_conversation(spark, table(spark, sf_dir, "conversations"))
    return chat.chat_report(chat.format_chats(chat.message_events(rows)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripes.source_divergences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_decontaminate, op3_substring_dedup, op4_exact_dedup, op5_paragraph_dedup,
                            op6_ngram_join, op7_packing, op8_lm_score, op9_line_dedup, op10_chat_format,
                            op11_conversation_repair, op12_simhash, op13_source_divergence)}

#: CRC-32 of the ASCII string ``s``, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(s, ''), lambda x: ord(x)::BIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, _: xor(r >> 1, (r & 1) * 3988292384))), 4294967295)"""


def _edited(state: str, cost: str, letter: str, line: str = "''") -> str:
    """SQL: a state's (cost, audit, text) after one edit; NULL stays NULL."""
    return (f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', "
            f"'t': {state}.t || {line}}} END")


def _kept(initial: str, states: list[str], role: str) -> str:
    """SQL list: the states after the row is kept (its initial fits) or given the role."""
    kept = ", ".join(_edited(x, "x", "K", "line") for x in states)
    if not role:
        return f"CASE WHEN ok AND k = '{initial}' THEN [{kept}] ELSE [NULL] END"
    given = ", ".join(_edited(x, "x + 2", "R", f"'{role}:' || text || chr(10)") for x in states)
    return f"CASE WHEN ok AND k = '{initial}' THEN [{kept}] WHEN ok THEN [{given}] ELSE [NULL] END"


#: Forward distances over rows; (cost, audit, text) of the four states: nothing, system, user, assistant.
_INSERTED = f"""
    SELECT *, list_min([p[4], {_edited('e3', '2', 'I', "'assistant:' || chr(10)")}]) AS e4
    FROM (SELECT *, p[1] AS e1, p[2] AS e2, list_min([p[3], {', '.join(_edited(f'p[{k}]', '2', 'I', "'user:' || chr(10)") for k in (1, 2, 4))}]) AS e3
          FROM walk)"""
_REPAIR_SQL = rf"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
    src AS (SELECT * EXCLUDE (s), {_CRC} % 20 AS harm FROM keyed),
    hurt AS (
        SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
               CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM src WHERE harm <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
    f AS (
        SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                       WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM n),
    walk AS (
        SELECT conv_id, 0::BIGINT AS i, [{{'c': 0::BIGINT, 'a': '', 't': ''}}, NULL, NULL, NULL] AS p
        FROM (SELECT DISTINCT conv_id FROM f)
        UNION ALL
        SELECT conv_id, i, [{_edited('e1', '3', 'D')},
            list_min(list_concat([{_edited('e2', '3', 'D')}], {_kept('s', ['e1'], '')})),
            list_min(list_concat([{_edited('e3', '3', 'D')}], {_kept('u', ['e1', 'e2', 'e4'], 'user')})),
            list_min(list_concat([{_edited('e4', '3', 'D')}], {_kept('a', ['e3'], 'assistant')}))] AS p
        FROM (SELECT w.conv_id, f.i, f.text, left(f.role, 1) AS k, f.fault IN ('', 'truncated') AS ok,
                     (f.fault = 'truncated')::BIGINT AS x, f.role || ':' || f.text || chr(10) AS line, e1, e2, e3, e4
              FROM ({_INSERTED}) w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1)),
    best AS (
        SELECT conv_id, list_min([e1, e4]) AS b FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS m FROM ({_INSERTED})) WHERE i = m),
    s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
          FROM f GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit,
           sha256(CASE WHEN length(b.t) > 0 THEN b.t[:-2] ELSE '' END) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id"""

SQL: dict[str, str] = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op9_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, i, line, lower_ascii(trim(line, E' \t\n\x0B\f\r')) AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS i FROM documents)),
        hot AS (SELECT key, max(doc_id) AS keep_id FROM lines WHERE length(key) >= 20
                GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (h.key IS NOT NULL AND l.doc_id <> h.keep_id) AS n_dropped,
               sha256(coalesce(string_agg(l.line, E'\n' ORDER BY l.i)
                               FILTER (h.key IS NULL OR l.doc_id = h.keep_id), '')) AS kept_sha256
        FROM lines l LEFT JOIN hot h ON l.key = h.key GROUP BY l.doc_id""".replace(
        "lower_ascii(trim(line, E' \\t\\n\\x0B\\f\\r'))",
        "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").replace(r"E'\n'", "chr(10)"),
    "op10_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows),
        e AS (SELECT *, length(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>)', '<\\\1', 'g'),
                                              '\[(/?INST\])', '[\\\1', 'g')) AS n_role,
                     length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'),
                                           '\[(/?INST\])', '[\\\1', 'g')) AS n_text FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(9 + n_role + 7 + n_text + 4)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_conversation_repair": _REPAIR_SQL,
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
                   FROM documents),
        t AS (SELECT id, lang, source, unnest(regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source)
              GROUP BY lang, source),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                     1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v) AS p
              FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (total + 5 * v) AS q
              FROM p JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term, total, v),
        gaps AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
                 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN gaps x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL
            SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term
            WHERE p.n > 0 AND p.p > q.q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
