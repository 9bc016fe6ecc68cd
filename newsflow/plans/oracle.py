"""What each query must return, as DuckDB SQL over the sample tables."""

from newsflow.plans.tables import CATEGORY_WORDS, CHANNELS, TONALITY_WORDS
from newsflow.schema import CATEGORIES, TONALITIES

# The characters and the phrases that the cleaning and noise rules name.
SPACE = r" \t\n\x0B\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NOT_TEXT = "[^a-zA-Zа-яА-ЯІіЇїЄєҐґ—''/.,!?()\\p{Nd}" + SPACE + "]"
NOISE = "|".join([
    r"(?:Фото|Відео|Джерело|Інфографіка): ?[^\n]*", r"(?:https?://|www\.)[^\s]+",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"\+[0-9][0-9 ().-]{7,}[0-9]", r"[#@][\p{L}\p{N}_]+",
    r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"])
TS = "'%Y-%m-%d %H:%M:%S.%f'"


def ts(value="publish_date"):
    return f"strftime({value}, {TS})"


def f1(value):
    return f"regexp_replace(regexp_replace({value}, '{NOT_TEXT}', '', 'g'), '\\n+', ' ', 'g')"


def f2(value):
    plain = f"regexp_replace({value}, '\\*\\*([^\\n]+?)\\*\\*', '\\1', 'g')"
    plain = f"regexp_replace({plain}, '__([^\\n]+?)__', '\\1', 'g')"
    spaced = f"regexp_replace({plain}, '{NOT_TEXT}', ' ', 'g')"
    lines = f"regexp_replace({spaced}, '\\n+', ' ', 'g')"
    return f"regexp_replace({lines}, '[{SPACE}]{{2,}}', ' ', 'g')"


def strip(value):
    return f"regexp_replace({value}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def rule_clean(value):
    kept = (f"regexp_replace(regexp_replace({value}, '{NOISE}', '', 'g'), "
            r"'[^\p{L}\p{N} \t\n\r\f?!.,\-–—]+', '', 'g')")
    tidy = f"trim(regexp_replace({kept}, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')"
    return f"coalesce(nullif({tidy}, ''), 'повідомлення немає')"


def rule_entities(cleaned):
    runs = (f"regexp_extract_all({cleaned}, "
            r"'[^.!?\n ] +(\p{Lu}[\p{L}\p{N}-]*(?: \p{Lu}[\p{L}\p{N}-]*)*)', 1)")
    return f"list_sort(list_distinct(list_filter({runs}, lambda e: length(e) > 2)))"


def rule_summary(cleaned):
    opening = f"trim(regexp_extract({cleaned}, '^[^.!?]*[.!?]+(?:[^.!?]*[.!?]+)?', 0), ' ')"
    return (f"CASE WHEN {cleaned} = 'повідомлення немає' THEN 'самарі відсутнє' "
            f"WHEN {opening} = '' THEN lower({cleaned}) ELSE lower({opening}) END")


def quoted(value):
    return "'" + value.replace("'", "''") + "'"


def rule_label(entries, values, default, name, source="messages"):
    """Label per message: words joined with the lexicon, summed, the greatest sum wins."""
    lexicon = ", ".join(f"({quoted(w)}, {quoted(v)}, {n})" for w, v, n in entries)
    places = ", ".join(f"({quoted(v)}, {i})" for i, v in enumerate(values))
    return f"""
{name}_words AS (SELECT message_id, unnest(string_split_regex(lower(initial_text),
    '[^\\p{{L}}\\p{{N}}]+')) AS word FROM {source}),
{name}_sums AS (SELECT message_id, value, place, sum(weight) AS score
    FROM {name}_words JOIN (VALUES {lexicon}) l(word, value, weight) USING (word)
    JOIN (VALUES {places}) p(value, place) USING (value) GROUP BY ALL),
{name}_best AS (SELECT message_id, value FROM {name}_sums WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY score DESC, place) = 1),
{name}_labels AS (SELECT message_id, coalesce(value, {quoted(default)}) AS {name}
    FROM {source} LEFT JOIN {name}_best USING (message_id))"""


TONALITY = rule_label(TONALITY_WORDS, TONALITIES, "нейтральна", "tonality")
CATEGORY = rule_label(CATEGORY_WORDS, CATEGORIES, "соціальні питання", "category")

MESSAGES = """messages AS (SELECT CAST(doc_id AS VARCHAR) AS message_id,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS publish_date, source, text AS initial_text
    FROM documents)"""
PART_PROCESSED = MESSAGES + f""", part_processed AS (SELECT m.*,
    CASE WHEN l.doc_id IS NOT NULL THEN {f1('initial_text')} END AS cleared_text
    FROM messages m LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = m.message_id)"""
FEED = """feed AS (SELECT doc_id AS message_id, source,
    CASE WHEN quality = 0 THEN '' ELSE text END AS text,
    CASE WHEN toxic = 1 THEN '' ELSE text END AS message
    FROM documents LEFT JOIN labels USING (doc_id))"""
EVENTS = """events_m AS (SELECT CAST(event_id AS VARCHAR) AS message_id, user_id AS channel_id,
    CAST(ts AS TIMESTAMP) AS publish_date, event_type AS source, props AS initial_text
    FROM events)"""
TURNS = """turns AS (SELECT CAST(conv_id AS VARCHAR) AS source, CAST(turn AS VARCHAR) AS message_id,
    TIMESTAMP '2024-01-01' + to_hours(turn) AS publish_date, text AS initial_text, role
    FROM conversations),
old AS (SELECT source, message_id, publish_date, initial_text, {f1} AS cleared_text
    FROM turns WHERE role <> 'assistant'),
new AS (SELECT source, message_id, publish_date, role || ': ' || initial_text AS initial_text
    FROM turns WHERE role <> 'system')""".replace("{f1}", f1("initial_text"))
VECTORS = """vectors AS (SELECT CAST(vec_id AS VARCHAR) AS message_id,
    'class ' || CAST(label AS VARCHAR) AS tonality, embedding AS embedding_clf FROM embeddings)"""
CHUNKED = MESSAGES + """, placed AS (SELECT *, row_number() OVER (PARTITION BY source
    ORDER BY publish_date, message_id) - 1 AS r FROM messages),
chunked AS (SELECT *, CAST(r // 6 AS BIGINT) AS batch_id, CAST(r % 6 + 1 AS BIGINT) AS n
    FROM placed)"""
CLEANED = MESSAGES + f""", cleaned AS (SELECT *, {rule_clean('initial_text')} AS cleared_text
    FROM messages)"""
WATCHED = ", ".join(str(c) for listed in CHANNELS.values() for c in listed)
UNLABELLED = "message_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"
JUDGED = f"""judged AS (SELECT CAST(quality AS VARCHAR) AS label,
    CASE WHEN length({f1('text')}) >= 1000 THEN '1' ELSE '0' END AS predicted
    FROM documents JOIN labels USING (doc_id))"""
ALL_STEPS = f"""SELECT m.message_id, m.source, tonality, category,
    {rule_summary('cleared_text')} AS summary, cleared_text,
    array_to_string({rule_entities('cleared_text')}, ';') AS named_entities
    FROM cleaned m JOIN tonality_labels USING (message_id) JOIN category_labels USING (message_id)"""
WORDS = "string_split_regex(lower(initial_text), '[^\\p{L}\\p{N}]+')"


def bm25(asked, k):
    tfs = ", ".join(f"CAST(length(list_filter(tokens, lambda t: t = '{w}')) AS BIGINT) AS tf{i}"
                    for i, w in enumerate(asked))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(asked)))
    score = " + ".join(
        f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} / "
        f"(tf{i} + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / avg_len))"
        for i in range(len(asked)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(asked)))
    return f"""WITH {MESSAGES},
t AS (SELECT *, list_filter({WORDS}, lambda t: t <> '') AS tokens FROM messages),
c AS (SELECT message_id, source, CAST(length(tokens) AS BIGINT) AS len, {tfs} FROM t),
s AS (SELECT count(*) AS n, avg(len) AS avg_len, {dfs} FROM c),
r AS (SELECT message_id, source, {score} AS score FROM c CROSS JOIN s WHERE {some})
SELECT message_id, source, round(score, 6) AS score FROM r
ORDER BY r.score DESC, source, message_id LIMIT {k}"""


def selected(ctes, query):
    return f"WITH {ctes}\n{query}"


UPSERT = "source, message_id, " + ts() + " AS publish_date, initial_text, cleared_text"

ORACLE = {
    "scan_jsonl": selected(FEED, """SELECT strftime(TIMESTAMP '1970-01-01' + to_minutes(message_id),
        '%Y-%m-%dT%H:%M:%SZ') AS publish_date, source, text FROM feed"""),
    "parse_message": selected(FEED, f"""SELECT md5(text) AS message_id,
        {ts("TIMESTAMP '1970-01-01' + to_minutes(message_id)")} AS publish_date, source,
        {f1('text')} AS initial_text FROM feed WHERE text <> ''"""),
    "scan_store": selected(PART_PROCESSED, f"""SELECT message_id, {ts()} AS publish_date, source,
        initial_text, cleared_text, CAST(0 AS BIGINT) AS entities,
        strftime(publish_date, '%Y-%m-%d') AS publish_day FROM part_processed"""),
    "dump_by_source": selected(PART_PROCESSED, f"""SELECT message_id,
        {ts()} AS publish_date, source, initial_text, cleared_text FROM part_processed"""),
    "rejected_lines": """SELECT 'no json: ' || doc_id AS line FROM documents WHERE doc_id % 3 = 0
        UNION ALL SELECT '17 ["' || doc_id || '"]'
        FROM documents WHERE doc_id % 3 = 1""",
    "live_source": selected(EVENTS, f"""SELECT message_id, {ts()} AS publish_date, source,
        initial_text FROM events_m WHERE channel_id IN ({WATCHED})"""),
    "backfill": selected(EVENTS, f"""SELECT message_id, {ts()} AS publish_date, source
        FROM events_m WHERE publish_date >= TIMESTAMP '2024-01-21'"""),
    "paged_feed": selected(EVENTS, f"""SELECT message_id, {ts()} AS publish_date, source,
        initial_text FROM events_m WHERE publish_date >= TIMESTAMP '2024-01-21'"""),
    "paged_feed_stream": selected(EVENTS, f"""SELECT message_id, {ts()} AS publish_date, source,
        initial_text FROM events_m"""),
    "ensure_store": "SELECT source, count(*) AS messages FROM documents GROUP BY source",
    "source_catalogue": "SELECT DISTINCT source FROM documents",
    "non_empty_text": selected(FEED, """SELECT message_id, source,
        CASE WHEN text <> '' THEN text ELSE message END AS message_text
        FROM feed WHERE text <> '' OR message <> ''"""),
    "by_source": selected(MESSAGES, f"""SELECT message_id, {ts()} AS publish_date, initial_text
        FROM messages WHERE source = 'src7'"""),
    "by_date_range": selected(EVENTS, f"""SELECT message_id, {ts()} AS publish_date, source
        FROM events_m WHERE publish_date >= TIMESTAMP '2024-01-05'
        AND publish_date < TIMESTAMP '2024-01-13'"""),
    "unprocessed": selected(PART_PROCESSED, f"""SELECT message_id, {ts()} AS publish_date, source,
        initial_text FROM part_processed p WHERE cleared_text IS NULL OR cleared_text = ''
        ORDER BY p.publish_date, source, message_id LIMIT 1000"""),
    "skip_processed": selected(PART_PROCESSED, """SELECT message_id, source FROM part_processed
        WHERE coalesce(cleared_text, '') = ''"""),
    "monitored": selected(EVENTS, f"""SELECT message_id, {ts()} AS publish_date, source, channel_id
        FROM events_m WHERE channel_id IN ({WATCHED})"""),
    "to_body": f"""SELECT CAST(page_id AS VARCHAR) AS message_id,
        {ts("TIMESTAMP '1970-01-01' + to_minutes(page_id)")} AS publish_date,
        {f2('url')} AS source, html AS initial_text FROM pages""",
    "from_stored": f"""SELECT CAST(doc_id AS VARCHAR) AS message_id,
        {ts("TIMESTAMP '1970-01-01' + to_minutes(doc_id)")} AS publish_date, source,
        text AS initial_text, lang || ';' || source AS named_entities,
        CAST(coalesce(length(embedding), 0) AS BIGINT) AS dims,
        coalesce(round(list_sum(CAST(embedding AS DOUBLE[])), 4), 0) AS total
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "training_columns": selected(MESSAGES + ", " + VECTORS, f"""SELECT
        {f1('initial_text')} AS cleared_text, tonality,
        CAST(length(embedding_clf) AS BIGINT) AS dims,
        round(list_sum(CAST(embedding_clf AS DOUBLE[])), 4) AS total
        FROM messages JOIN vectors USING (message_id)"""),
    "limit_chunk": selected(EVENTS, f"""SELECT message_id, {ts()} AS publish_date, source
        FROM events_m e ORDER BY e.publish_date, source, message_id LIMIT 1000"""),
    "newest_first": selected(EVENTS, f"""SELECT message_id, {ts()} AS publish_date, source
        FROM events_m e WHERE e.publish_date >= TIMESTAMP '2024-01-21'
        ORDER BY e.publish_date DESC, source DESC, message_id DESC"""),
    "upsert_merge": selected(TURNS, f"""SELECT source, message_id,
        {ts('coalesce(new.publish_date, old.publish_date)')} AS publish_date,
        CASE WHEN new.message_id IS NOT NULL THEN new.initial_text ELSE old.initial_text END
        AS initial_text, cleared_text FROM old FULL JOIN new USING (source, message_id)"""),
    "upsert_replace": selected(TURNS, f"""SELECT {UPSERT} FROM old
        WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.source = old.source
        AND new.message_id = old.message_id) UNION ALL
        SELECT source, message_id, {ts()}, initial_text, NULL FROM new"""),
    "backfill_union_live": selected(EVENTS, f"""SELECT message_id, {ts()} AS publish_date, source,
        initial_text FROM (SELECT * FROM events_m WHERE publish_date < TIMESTAMP '2024-01-21'
        UNION SELECT * FROM events_m WHERE publish_date >= TIMESTAMP '2024-01-11'
        AND publish_date < TIMESTAMP '2024-02-01')"""),
    "dedup_exact": selected(MESSAGES, f"""SELECT md5(initial_text) AS content_id, message_id,
        {ts()} AS publish_date, source, initial_text FROM messages m
        QUALIFY row_number() OVER (PARTITION BY md5(initial_text)
        ORDER BY m.publish_date DESC, source DESC, message_id DESC) = 1"""),
    "chunk": selected(CHUNKED, "SELECT source, message_id, batch_id, n FROM chunked"),
    "batch_texts": selected(CHUNKED, """SELECT source, batch_id, count(*) AS texts,
        string_agg('Текст #' || n || ': ' || initial_text || chr(10), chr(10) ORDER BY n) AS request
        FROM chunked GROUP BY source, batch_id"""),
    "split_answers": selected(CHUNKED, f"""SELECT source, batch_id, n,
        nullif(lower({strip('initial_text')}), '') AS value FROM chunked WHERE {UNLABELLED}"""),
    "split_blocks": selected(CHUNKED + f""", cleaned AS (SELECT *,
        {rule_clean('initial_text')} AS cleared_text FROM chunked)""", f"""SELECT source, batch_id, n,
        'Текст #' || n || chr(10) || 'Дія 1: ' || cleared_text || chr(10) || 'Дія 2: ' ||
        array_to_string({rule_entities('cleared_text')}, '; ') || chr(10) || chr(10) AS block
        FROM cleaned"""),
    "split_actions": selected(CLEANED, f"""SELECT message_id, cleared_text,
        {strip("array_to_string(" + rule_entities('cleared_text') + ", ';') || ' ; a; ab;'")}
        AS entities FROM cleaned"""),
    "entity_list": selected(CLEANED, f"""SELECT message_id,
        array_to_string({rule_entities('cleared_text')}, ';') AS named_entities FROM cleaned"""),
    "answer_failed": selected(MESSAGES, """SELECT message_id, CAST(coalesce(toxic = 1, false)
        OR coalesce(quality = 0, false) AS BIGINT) AS failed FROM messages
        LEFT JOIN labels ON CAST(doc_id AS VARCHAR) = message_id"""),
    "align_answers": selected(CHUNKED, f"""SELECT message_id, source, batch_id, n,
        CASE WHEN {UNLABELLED} THEN nullif(lower({strip('initial_text')}), '') END AS value
        FROM chunked"""),
    "setup_grid": selected(MESSAGES, """SELECT message_id, source, setup,
        CAST(temperature AS DOUBLE) AS temperature FROM messages
        CROSS JOIN (VALUES ('cold', 0.0), ('warm', 0.4), ('hot', 1.0)) s(setup, temperature)"""),
    "unique_sources": "SELECT DISTINCT event_type AS source FROM events",
    "count_by_source": selected(FEED + f""", texts AS (SELECT CAST(message_id AS VARCHAR)
        AS message_id, source, {f1("CASE WHEN text <> '' THEN text ELSE message END")} AS body
        FROM feed WHERE text <> '' OR message <> ''),
        kept AS (SELECT source FROM texts QUALIFY row_number() OVER (PARTITION BY md5(body)
        ORDER BY source DESC, message_id DESC) = 1)""",
        "SELECT source, count(*) AS messages FROM kept GROUP BY source"),
    "category_distribution": selected(MESSAGES + "," + CATEGORY, """SELECT category,
        count(*) AS messages, round(count(*) / (SELECT count(*) FROM category_labels), 6) AS share
        FROM category_labels GROUP BY category"""),
    "tonality_distribution": selected(MESSAGES + "," + TONALITY, """SELECT source, tonality,
        count(*) AS messages,
        round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY source) AS DOUBLE), 6) AS share
        FROM messages JOIN tonality_labels USING (message_id) GROUP BY source, tonality"""),
    "top_entities": selected(CLEANED, f"""SELECT entity, count(*) AS mentions FROM (SELECT
        unnest({rule_entities('cleared_text')}) AS entity FROM cleaned) GROUP BY entity
        ORDER BY mentions DESC, entity LIMIT 20"""),
    "top_entities_by_days": selected(CLEANED, f"""SELECT entity, count(*) AS mentions FROM (SELECT
        unnest({rule_entities('cleared_text')}) AS entity FROM cleaned
        WHERE CAST(message_id AS BIGINT) % 720 // 24 BETWEEN 4 AND 19) GROUP BY entity
        ORDER BY mentions DESC, entity LIMIT 20"""),
    "count_by_day": """SELECT strftime(DATE '2024-01-01' + CAST(doc_id % 720 // 24 AS INTEGER),
        '%Y-%m-%d') AS day, source, count(*) AS messages FROM documents
        WHERE doc_id % 720 // 24 BETWEEN 4 AND 19 GROUP BY ALL""",
    "date_histogram": selected(EVENTS, """SELECT strftime(publish_date, '%Y-%m-%d') AS day, source,
        count(*) AS messages FROM events_m GROUP BY ALL"""),
    "confusion_matrix": selected(JUDGED, """SELECT label,
        count(*) FILTER (WHERE predicted = '0') AS predicted_0,
        count(*) FILTER (WHERE predicted = '1') AS predicted_1 FROM judged GROUP BY label"""),
    "accuracy": selected(JUDGED, """SELECT count(*) AS messages,
        round(avg(CAST(label = predicted AS INTEGER)), 6) AS accuracy FROM judged"""),
    "clean_text": selected(MESSAGES, f"""SELECT message_id, {f1('initial_text')} AS cleared
        FROM messages"""),
    "clean_text_spaced": selected(MESSAGES, f"""SELECT message_id, {f2('initial_text')} AS cleared
        FROM messages"""),
    "sanitize_name": r"""SELECT page_id, regexp_replace(url, '[/\\:*?"<>|]', '_', 'g') AS name
        FROM pages""",
    "content_id": selected(MESSAGES, "SELECT message_id, md5(initial_text) AS content_id FROM messages"),
    "parse_ts": selected(EVENTS, f"""SELECT message_id, {ts('''CASE source
        WHEN 'click' THEN date_trunc('second', publish_date) - INTERVAL 2 HOUR
        WHEN 'view' THEN date_trunc('second', publish_date) + INTERVAL 210 MINUTE
        WHEN 'purchase' THEN date_trunc('second', publish_date) END''')} AS parsed FROM events_m"""),
    "kyiv_hms": selected(EVENTS, """SELECT message_id, strftime(date_trunc('second', publish_date)
        AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv', '%H:%M:%S') AS hms FROM events_m"""),
    "extract_noise": selected(MESSAGES, f"""SELECT message_id, array_to_string(
        regexp_extract_all(initial_text, '{NOISE}'), ';') AS noise FROM messages"""),
    "enrich_clean_ner": selected(CLEANED, f"""SELECT message_id, cleared_text,
        array_to_string({rule_entities('cleared_text')}, ';') AS named_entities FROM cleaned"""),
    "enrich_summary": selected(CLEANED, f"""SELECT message_id,
        {rule_summary('cleared_text')} AS summary FROM cleaned"""),
    "enrich_tonality": selected(MESSAGES + "," + TONALITY,
                                "SELECT message_id, tonality FROM tonality_labels"),
    "enrich_category": selected(MESSAGES + "," + CATEGORY,
                                "SELECT message_id, category FROM category_labels"),
    "enrich_embeddings": selected(CLEANED, """SELECT message_id, CAST(768 AS BIGINT) AS dims,
        CASE WHEN regexp_matches(cleared_text, '[\\p{L}\\p{N}]') THEN CAST(1 AS DOUBLE)
        ELSE CAST(0 AS DOUBLE) END AS norm_sts, norm_sts AS norm_clf FROM cleaned"""),
    "enrich_all": selected(CLEANED + "," + TONALITY + "," + CATEGORY, ALL_STEPS),
    "enrich_by_source": selected(CLEANED + "," + TONALITY + "," + CATEGORY,
                                 ALL_STEPS + " WHERE m.source = 'src7'"),
    "score_batches": selected(MESSAGES, f"""SELECT message_id, source,
        CAST(length({strip('initial_text')}) AS VARCHAR) AS answer
        FROM messages"""),
    "reply_ledger": selected(MESSAGES, """SELECT message_id, source,
        CASE WHEN length(initial_text) % 3 = 0 THEN 'second:' ELSE 'first:' END
        || length(initial_text) AS answer,
        CASE WHEN initial_text IS NULL THEN 'no request' END AS error FROM messages"""),
    "enrich_by_model": selected(MESSAGES + f""", bodies AS (SELECT message_id, source,
        {strip('initial_text')} AS body FROM messages)""", f"""SELECT message_id, source,
        CASE WHEN length(body) >= 1000 THEN 'позитивна' END AS tonality,
        CASE WHEN length(body) < 1000 THEN 'unknown value: невідома' END AS tonality_error,
        CASE WHEN body LIKE '%.' THEN 'спорт' ELSE 'освіта' END AS category,
        'разом ' || length(body) AS summary, length(body) || ' знаків' AS cleared_text,
        CASE WHEN length({strip("body[-3:]")}) > 2 AND instr(body[-3:], ';') = 0
        THEN 'Київ;' || {strip("body[-3:]")} ELSE 'Київ' END AS named_entities FROM bodies"""),
    "setup_comparison": selected(MESSAGES, """SELECT message_id, source,
        '0.0/' || length(initial_text) AS cold, '0.4/' || length(initial_text) AS warm,
        '1.0/' || length(initial_text) AS hot FROM messages"""),
    "similar_topk": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e
        FROM embeddings),
        parts AS (SELECT label, unnest(e) AS value, generate_subscripts(e, 1) AS place FROM v),
        means AS (SELECT label, place, avg(value) AS value FROM parts GROUP BY label, place),
        centres AS (SELECT label, list(value ORDER BY place) AS centre FROM means GROUP BY label),
        scored AS (SELECT CAST(c.label AS VARCHAR) AS query, vec_id AS message_id,
            list_cosine_similarity(e, centre) AS score FROM v CROSS JOIN centres c)
        SELECT query, message_id, round(score, 6) AS score, row_number() OVER
            (PARTITION BY query ORDER BY scored.score DESC, message_id) AS rank
        FROM scored QUALIFY rank <= 10""",
    "similar_to_each": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        scored AS (SELECT q.vec_id AS query, list_cosine_similarity(q.e, v.e) AS score
            FROM v q CROSS JOIN v)
        SELECT query, round(score, 6) AS score, row_number() OVER
            (PARTITION BY query ORDER BY scored.score DESC) AS rank
        FROM scored QUALIFY rank <= 3""",
    "text_search": bm25(["mail5", "nicht", "que", "the"], 20),
    "text_search_index": bm25(["mail5", "nicht", "que", "the"], 20),
    "stream_ingest": selected(EVENTS, f"""SELECT message_id, {ts()} AS publish_date, source,
        initial_text FROM events_m WHERE initial_text <> ''"""),
    "enrich_incremental": selected(PART_PROCESSED + f""", cleaned AS (SELECT *,
        {rule_clean('initial_text')} AS new_text FROM part_processed)""", f"""SELECT message_id,
        source, CASE WHEN coalesce(cleared_text, '') = '' THEN new_text ELSE cleared_text END
        AS cleared_text, CASE WHEN coalesce(cleared_text, '') = ''
        THEN array_to_string({rule_entities('new_text')}, ';') ELSE '' END AS named_entities
        FROM cleaned"""),
    "stream_dedup": selected(EVENTS, f"""SELECT DISTINCT message_id, {ts()} AS publish_date,
        source, initial_text FROM events_m"""),
    "stream_histogram": selected(EVENTS, """SELECT strftime(publish_date, '%Y-%m-%d') AS day,
        source, count(*) AS messages FROM events_m GROUP BY ALL"""),
    "label_index": selected(VECTORS, """SELECT message_id, tonality,
        dense_rank() OVER (ORDER BY tonality) - 1 AS label FROM vectors"""),
    "predict": selected(VECTORS, """SELECT message_id, tonality, CAST(1 AS BIGINT) AS known
        FROM vectors WHERE CAST('0x' || substr(md5(message_id), 1, 8) AS BIGINT) % 10 >= 8"""),
    "train_classifier": selected(VECTORS, """SELECT CASE WHEN
        CAST('0x' || substr(md5(message_id), 1, 8) AS BIGINT) % 10 < 8 THEN 'training'
        ELSE 'validation' END AS part, count(*) AS messages, count(*) AS predicted
        FROM vectors GROUP BY 1"""),
    "training_curve": selected(VECTORS, """SELECT CAST(1 AS BIGINT) AS loss_falls,
        CAST(1 AS BIGINT) AS beats_majority, CAST(1 AS BIGINT) AS kept_epochs
        FROM vectors HAVING count(*) > 0"""),
    "split": selected(VECTORS, """SELECT message_id, CASE WHEN
        CAST('0x' || substr(md5(message_id), 1, 8) AS BIGINT) % 10 < 8 THEN 'training'
        ELSE 'validation' END AS part FROM vectors"""),
}
ORACLE["model_retry"] = ORACLE["enrich_clean_ner"]
ORACLE["tonality_by_join"] = ORACLE["enrich_tonality"]
ORACLE["enrich_all_vectors"] = ORACLE["enrich_embeddings"]
ORACLE["enrich_by_source_vectors"] = ORACLE["enrich_embeddings"] + " WHERE source = 'src7'"
ORACLE["enrich_by_model_vectors"] = selected(MESSAGES + f""", bodies AS (SELECT message_id, source,
    length({strip('initial_text')}) AS n FROM messages)""", """SELECT message_id, source,
    n || ';' || length(n || ' знаків') AS embedding_sts, n % 7 || ';1' AS embedding_clf FROM bodies""")
