"""Plain SQL over the given tables with the same rows as the registered queries.

Written from the meaning of each operator, with windows and joins where the
Spark side may use another form, so that the two check each other.
"""

from __future__ import annotations

from ..operators.cleaning import FAKE_NAMES, NAME_PATTERN
from ..operators.clustering import SEGMENT_FEATURES
from . import fixtures as fx

ORACLES: dict[str, str] = {}


def _in(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def _label(column: str, rules, default: str) -> str:
    branches = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({column}), '{k}')" for k in keywords) + f" THEN '{name}'"
        for name, keywords in rules
    )
    return f"CASE {branches} ELSE '{default}' END"


def _seconds(start: str, end: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / 1e6)"


VIEWS = {
    "base": """SELECT event_id AS id, user_id AS client_id, ts AS created_at,
        CASE WHEN event_type <> 'error' THEN event_type END AS question,
        CASE WHEN event_type IN ('error', 'view') THEN event_type END AS answer FROM events""",
    "chats": f"""SELECT *, {_label('question', fx.TOPICS, fx.TOPIC_DEFAULT)} AS topic,
        CASE WHEN question IS NOT NULL THEN 'user' WHEN answer IS NOT NULL THEN 'bot' END AS sender FROM base""",
    "clients": "SELECT c_custkey AS client_id, c_name AS name FROM customer",
    "neighbors": """SELECT *, lag(created_at) OVER w AS prev_time, lead(created_at) OVER w AS next_time,
        lead(sender) OVER w AS next_sender FROM chats WINDOW w AS (PARTITION BY client_id ORDER BY created_at, id)""",
    "sessioned": f"""SELECT *, CAST(sum(CASE WHEN prev_time IS NULL OR {_seconds('prev_time', 'created_at')} > 1800
        THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY created_at, id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_id FROM neighbors""",
    "sessions": """SELECT client_id, session_id, min(created_at) AS session_start, max(created_at) AS session_end,
        count(*) AS messages FROM sessioned GROUP BY client_id, session_id""",
    "replies": f"""SELECT *, CASE WHEN sender = 'user' AND next_sender = 'bot'
        THEN {_seconds('created_at', 'next_time')} END AS response_time_sec FROM sessioned""",
    "answered": """SELECT *, lead(created_at) OVER (PARTITION BY client_id ORDER BY created_at, id) AS next_created_at
        FROM chats WHERE answer IS NOT NULL""",
    "pairs": f"""SELECT id, client_id, created_at, next_created_at,
        {_seconds('created_at', 'next_created_at')} AS response_time_sec
        FROM answered WHERE question IS NOT NULL AND next_created_at IS NOT NULL""",
    "lexicon": "SELECT * FROM (VALUES "
    + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in fx.LEXICON)
    + ") AS l(term, valence)",
    # One word per message in the event view, so the score needs no context.
    "event_scores": """SELECT c.*, round(coalesce(l.valence, 0) / sqrt(coalesce(l.valence, 0) ** 2 + 15), 4)
        AS question_sentiment FROM chats c LEFT JOIN lexicon l ON l.term = c.question""",
    "conv": """SELECT conv_id * 4294967296 + turn AS id, conv_id AS client_id, text AS question,
        CASE WHEN next_role = 'assistant' THEN next_text END AS answer
        FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""",
    "texts": "SELECT doc_id AS id, text AS question FROM documents",
    "daily": "SELECT CAST(created_at AS DATE) AS date, count(question) AS volume FROM chats GROUP BY 1",
    "topic_daily": "SELECT topic, CAST(created_at AS DATE) AS date, count(question) AS volume FROM chats GROUP BY 1, 2",
    "features": f"""SELECT r.client_id, count(*) AS total_messages, count(question) AS questions,
        count(DISTINCT CAST(created_at AS DATE)) AS active_days,
        coalesce(avg(length(question)), 0) AS avg_message_length,
        coalesce(avg(response_time_sec), 0) AS avg_response_time,
        count(DISTINCT session_id) AS session_count, count(DISTINCT topic) AS unique_topics,
        any_value(s.avg_sentiment) AS avg_sentiment,
        {_seconds('min(created_at)', 'max(created_at)')} / 3600 AS span_hours
        FROM replies r JOIN (SELECT client_id, avg(question_sentiment) AS avg_sentiment
        FROM event_scores GROUP BY client_id) s ON s.client_id = r.client_id GROUP BY r.client_id""",
    "satisfaction": """SELECT client_id, session_count AS sessions, questions, unique_topics AS topics, avg_sentiment,
        span_hours, questions / session_count AS avg_messages_per_session,
        CASE WHEN questions > 0 THEN unique_topics / questions END AS engagement_diversity, avg_response_time,
        total_messages / session_count AS session_length, questions AS conversation_turns FROM features""",
    "matrix": "SELECT client_id, "
    + ", ".join(f"count(*) FILTER (topic = '{t}') AS \"{t}\"" for t in fx.TOPIC_NAMES)
    + " FROM chats GROUP BY client_id",
}
NEEDS = {
    "chats": ["base"],
    "neighbors": ["chats"],
    "sessioned": ["neighbors"],
    "sessions": ["sessioned"],
    "replies": ["sessioned"],
    "answered": ["chats"],
    "pairs": ["answered"],
    "event_scores": ["chats", "lexicon"],
    "daily": ["chats"],
    "topic_daily": ["chats"],
    "features": ["replies", "event_scores"],
    "satisfaction": ["features"],
    "matrix": ["chats"],
}


def _with(views, sql: str) -> str:
    ordered: list[str] = []

    def add(name):
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in ordered) + "\n" + sql


def oracle(name: str, views: str, sql: str) -> None:
    ORACLES[name] = _with(views.split(), sql)


# Volume
oracle("messages_per_day", "base", "SELECT CAST(created_at AS DATE) AS date, count(question) AS message_count FROM base GROUP BY 1")
oracle(
    "messages_per_week",
    "base",
    "SELECT year(created_at) AS year, week(created_at) AS week, count(question) AS message_count FROM base GROUP BY 1, 2",
)
oracle(
    "messages_per_iso_week",
    "base",
    "SELECT isoyear(created_at) AS year, week(created_at) AS week, count(question) AS message_count FROM base GROUP BY 1, 2",
)
oracle(
    "messages_per_month",
    "base",
    """SELECT CAST(year(created_at) AS INTEGER) AS year, CAST(month(created_at) AS INTEGER) AS month,
    count(question) AS message_count, strftime(any_value(created_at), '%b') AS month_name,
    strftime(any_value(created_at), '%Y-%b') AS year_month FROM base GROUP BY 1, 2""",
)
oracle("messages_per_topic", "chats", "SELECT topic, count(*) AS message_count FROM chats GROUP BY topic")
oracle("messages_per_user", "base", "SELECT client_id, count(*) AS message_count FROM base GROUP BY client_id")
oracle(
    "top_users",
    "base clients",
    """SELECT name, count(*) AS message_count FROM base JOIN clients USING (client_id) WHERE name IS NOT NULL
    GROUP BY name ORDER BY message_count DESC, name LIMIT 10""",
)
PERFORMANCE = """SELECT topic, count(*) AS frequency,
    round_even(count(*) / (SELECT count(*) FROM chats) * 100, 2) AS percentage FROM chats GROUP BY topic"""
oracle("topic_performance", "chats", PERFORMANCE)
oracle("underrepresented_topics", "chats", f"SELECT * FROM ({PERFORMANCE}) WHERE percentage < 25")
oracle(
    "data_bounds",
    "base",
    "SELECT CAST(min(created_at) AS DATE) AS min_date, CAST(max(created_at) AS DATE) AS max_date, count(*) AS row_count FROM base",
)

# Sessions, responses and engagement
ENGAGEMENT = """SELECT e.*, name FROM (SELECT client_id, count(question) AS message_count,
    count(DISTINCT CAST(created_at AS DATE)) AS active_days FROM chats GROUP BY client_id) e
    LEFT JOIN clients USING (client_id)"""
LENGTH_MIN = f"{_seconds('session_start', 'session_end')} / 60"
oracle("user_engagement", "chats clients", ENGAGEMENT)
oracle(
    "client_overview",
    "sessions clients",
    f"""SELECT e.*, sessions, mean_session_min FROM ({ENGAGEMENT}) e LEFT JOIN (SELECT client_id,
    count(*) AS sessions, round(avg({LENGTH_MIN}), 6) AS mean_session_min FROM sessions GROUP BY client_id)
    USING (client_id)""",
)
oracle(
    "sessionized_chats",
    "sessioned",
    f"""SELECT id, client_id, created_at, prev_time, round({_seconds('prev_time', 'created_at')} / 60, 9) AS gap,
    session_id FROM sessioned""",
)
oracle("session_lengths", "sessions", f"SELECT *, round({LENGTH_MIN}, 9) AS session_length_min FROM sessions")
oracle(
    "avg_session_length",
    "sessions",
    f"SELECT round(avg({LENGTH_MIN}), 6) AS avg_session_length_min, count(*) AS sessions FROM sessions",
)
oracle("senders", "chats", "SELECT id, sender FROM chats")
oracle(
    "drop_off_rate",
    "neighbors",
    """SELECT *, round(CASE WHEN bot_messages > 0 THEN dropped / bot_messages * 100 ELSE 0 END, 6) AS drop_off_rate
    FROM (SELECT count(*) AS bot_messages, count(*) FILTER (next_time IS NULL) AS dropped
    FROM neighbors WHERE sender = 'bot')""",
)
oracle("response_times", "pairs", "SELECT * REPLACE (round(response_time_sec, 6) AS response_time_sec) FROM pairs")
oracle(
    "response_time",
    "pairs",
    """SELECT round(avg(response_time_sec), 6) AS avg_response_time_sec, count(*) AS pairs,
    round(avg(response_time_sec) / 60, 6) AS avg_response_time_min FROM pairs""",
)
oracle(
    "reply_times",
    "replies",
    """SELECT id, client_id, created_at, sender, next_time, next_sender,
    round(response_time_sec, 6) AS response_time_sec FROM replies""",
)
TURNS = """SELECT client_id, count(*) AS total_messages, count(question) AS user_messages,
    count(answer) AS bot_messages FROM base GROUP BY client_id"""
oracle("turns", "base", TURNS)
oracle(
    "mean_turns",
    "base",
    "SELECT "
    + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("total_messages", "user_messages", "bot_messages"))
    + f" FROM ({TURNS})",
)
oracle(
    "satisfaction_proxy",
    "chats",
    """SELECT topic, round(avg(n), 6) AS avg_messages_per_conversation, count(DISTINCT client_id) AS unique_users
    FROM (SELECT client_id, topic, count(*) AS n FROM chats GROUP BY 1, 2) GROUP BY topic""",
)
oracle(
    "user_behavior",
    "features clients",
    """SELECT client_id, total_messages, active_days, round(avg_message_length, 4) AS avg_message_length,
    round(avg_response_time, 4) AS avg_response_time, session_count, unique_topics,
    round(avg_sentiment, 10) AS avg_sentiment, name FROM features LEFT JOIN clients USING (client_id)""",
)
ROUNDED = ("span_hours", "avg_messages_per_session", "engagement_diversity", "avg_response_time", "session_length")
oracle(
    "satisfaction_features",
    "satisfaction",
    "SELECT * REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in ROUNDED)
    + ", round(avg_sentiment, 10) AS avg_sentiment) FROM satisfaction",
)
oracle(
    "satisfaction_labels",
    "satisfaction",
    f"""SELECT client_id, CASE WHEN conversation_turns >= {fx.LIMITS.high_turns}
    AND avg_response_time < {fx.LIMITS.high_response_sec} AND session_length > {fx.LIMITS.high_session} THEN 'high'
    WHEN conversation_turns <= {fx.LIMITS.low_turns} OR avg_response_time > {fx.LIMITS.low_response_sec}
    OR session_length < {fx.LIMITS.low_session} THEN 'low' ELSE 'medium' END AS satisfaction FROM satisfaction""",
)

# Filters


def _category(score: str) -> str:
    return f"""CASE WHEN {score} > -1 AND {score} <= -0.05 THEN 'negative'
        WHEN {score} > -0.05 AND {score} <= 0.05 THEN 'neutral'
        WHEN {score} > 0.05 AND {score} <= 1 THEN 'positive' END"""


ANSWER_SCORE = "round(coalesce(a.valence, 0) / sqrt(coalesce(a.valence, 0) ** 2 + 15), 4)"
SCORED_CHATS = f"""SELECT c.id, c.client_id, c.created_at, c.question, c.answer, c.topic,
    c.question_sentiment, {ANSWER_SCORE} AS answer_sentiment,
    {_category('c.question_sentiment')} AS question_sentiment_category,
    {_category(ANSWER_SCORE)} AS answer_sentiment_category, name
    FROM event_scores c LEFT JOIN lexicon a ON a.term = c.answer LEFT JOIN clients USING (client_id)"""
FILTERED = f"""SELECT * FROM ({SCORED_CHATS})
    WHERE CAST(created_at AS DATE) BETWEEN '{fx.FILTERS.first_date}' AND '{fx.FILTERS.last_date}'
    AND topic IN {_in(fx.FILTERS.topics)} AND question_sentiment_category IN {_in(fx.FILTERS.sentiments)}"""
oracle(
    "user_chats",
    "event_scores clients",
    f"""SELECT * FROM ({SCORED_CHATS})
    WHERE CAST(created_at AS DATE) BETWEEN '{fx.USER_FILTERS.first_date}' AND '{fx.USER_FILTERS.last_date}'
    AND name IN {_in(fx.USER_FILTERS.users)}""",
)
oracle("filtered_chats", "event_scores clients", FILTERED)
oracle(
    "sentiment_over_time",
    "event_scores clients",
    f"SELECT created_at, question_sentiment, question_sentiment_category FROM ({FILTERED})",
)
oracle(
    "filter_options",
    "chats clients",
    """SELECT 'user' AS kind, name AS value FROM (SELECT DISTINCT name FROM clients WHERE name IS NOT NULL)
    UNION ALL SELECT 'topic', topic FROM (SELECT DISTINCT topic FROM chats)""",
)

# Sources, cleaning and profiles
ORACLES["custom_query"] = (
    f"WITH chats AS ({VIEWS['base']}), clients AS ({VIEWS['clients']}) " + fx.CUSTOM_QUERY
)
ORACLES["clean_names"] = f"""SELECT * FROM (
    SELECT 'region' AS source, CAST(r_regionkey AS BIGINT) AS client_id, r_name AS name FROM region
    UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation
    UNION ALL SELECT 'part', p_partkey, p_name FROM part
    UNION ALL SELECT 'customer', c_custkey, c_name FROM customer)
    WHERE NOT coalesce(client_id > 0 AND (NOT regexp_matches(name, '{NAME_PATTERN}')
    OR strlen(name) <= 2 OR name IN {_in(FAKE_NAMES)}), false)"""
ORACLES["clean_tables"] = f"""SELECT 'supplier' AS source, s_suppkey AS key, s_name AS name FROM supplier
    UNION ALL SELECT 'customer', c_custkey, c_name FROM customer
    UNION ALL SELECT 'part', p_partkey, p_name FROM part WHERE NOT coalesce(p_partkey > 0
    AND (NOT regexp_matches(p_name, '{NAME_PATTERN}') OR strlen(p_type) <= 5
    OR p_brand IN ('Brand#2', 'Brand#17')), false)"""

# The profiled tables with their columns and types.
PROFILE_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def _profile(table: str, column: str, kind: str) -> str:
    number = kind in ("int", "bigint", "double")
    text = f"strftime({{}}({column}), '%Y-%m-%d %H:%M:%S.%f')" if kind == "timestamp_ntz" else f"{{}}({column})"

    def cell(function, numeric):
        if numeric:
            return f"CAST({function}({column}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
        return "CAST(NULL AS VARCHAR)" if number or kind.startswith("array") else text.format(function)

    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, '{kind}' AS column_type,
        count(*) AS row_count, count(*) - count({column}) AS null_count, count(DISTINCT {column}) AS distinct_count,
        {cell('min', True)} AS min_number, {cell('max', True)} AS max_number,
        {cell('min', False)} AS min_text, {cell('max', False)} AS max_text FROM {table}"""


ORACLES["table_profile"] = "\nUNION ALL ".join(
    _profile(table, *column.split()) for table, columns in PROFILE_COLUMNS.items() for column in columns.split(", ")
)


def _columns():
    return [(table, *c.split()) for table, columns in PROFILE_COLUMNS.items() for c in columns.split(", ")]


ORACLES["column_top_values"] = "\nUNION ALL ".join(
    f"""SELECT * FROM (SELECT '{t}' AS table_name, '{c}' AS column_name,
    {f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if kind == "timestamp_ntz" else f"CAST({c} AS VARCHAR)"} AS value, count(*) AS frequency FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY frequency DESC, value LIMIT 5)"""
    for t, c, kind in _columns()
    if not kind.startswith("array")
)
ORACLES["column_quartiles"] = "\nUNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, {", ".join(f"CAST(min({c}) FILTER (4 * r >= {k} * n) AS DOUBLE) AS q{25 * k}" for k in (1, 2, 3))}
    FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM {t} WHERE {c} IS NOT NULL)"""
    for t, c, kind in _columns()
    if kind in ("int", "bigint", "double")
)

# Labels, sentiment and text
oracle("topic_labels", "chats", "SELECT id, topic FROM chats")
oracle("intent_labels", "texts", f"SELECT id, {_label('question', fx.INTENTS, fx.INTENT_DEFAULT)} AS intent FROM texts")


def _scores(source: str) -> str:
    """CTEs that end in scored(id, side, score), from said(id, side, text)."""
    m = fx.MODIFIERS

    def among(p, words):
        return f"coalesce({p} IN {_in(words)}, false)" if words else "false"

    def loud(t):
        return f"({t} = upper({t}) AND {t} <> lower({t}))"

    def steps(n, damping, never, never_so, doubtless):
        p = f"p{n}"
        counts = f"({p} IS NOT NULL AND {p} NOT IN (SELECT term FROM lexicon))"
        strength = f"CASE WHEN {p} IN {_in(m.strengtheners)} THEN 0.293::DOUBLE WHEN {p} IN {_in(m.weakeners)} THEN -0.293::DOUBLE ELSE 0::DOUBLE END"
        bonus = f"CASE WHEN {among(p, (*m.strengtheners, *m.weakeners))} AND mixed AND {loud(f't{n}')} THEN 0.733::DOUBLE ELSE 0::DOUBLE END"
        moved = f"v + ({strength} + {bonus}) * {damping}::DOUBLE * CASE WHEN v < 0 THEN -1::DOUBLE ELSE 1::DOUBLE END"
        negates = f"({among(p, m.negations)} OR coalesce(ends_with({p}, 'n''t'), false))"
        factor = f"CASE WHEN NOT {counts} THEN 1::DOUBLE WHEN {never} THEN {never_so}::DOUBLE WHEN NOT {doubtless} AND {negates} THEN -0.74::DOUBLE ELSE 1::DOUBLE END"
        return f"""a{n} AS (SELECT * REPLACE (CASE WHEN {counts} THEN {moved} ELSE v END AS v) FROM v{n - 1}),
    v{n} AS (SELECT * REPLACE (v * {factor} AS v) FROM a{n})"""

    def idiom(phrase):
        return "CASE " + phrase + " " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in m.idioms) + " END" if m.idioms else "NULL::DOUBLE"

    phrases = [" || ' ' || ".join(x) for x in (("word", "n1", "n2"), ("word", "n1"), ("p1", "word"), ("p2", "p1", "word"), ("p2", "p1"), ("p3", "p2", "p1"), ("p3", "p2"))]
    never2, sure2 = (f"({among('p2', a)} AND {among('p1', b)})" for a, b in ((m.never, m.so), (m.without, m.doubt)))
    never3, sure3 = (
        f"({among('p3', a)} AND ({among('p2', b)} OR {among('p1', b)}))" for a, b in ((m.never, m.so), (m.without, m.doubt))
    )
    weaker = " OR ".join(among(x, m.weakening_pairs) for x in ("p3 || ' ' || p2", "p2 || ' ' || p1"))
    weightless = f"{among('word', (*m.strengtheners, *m.weakeners))} OR {among(phrases[1], m.unweighted_pairs)}"
    token = "[\\p{L}\\p{N}_'']+"
    return f"""said AS ({source}),
    tokens AS (SELECT id, side, unnest(t) AS token, generate_subscripts(t, 1) AS i
        FROM (SELECT id, side, regexp_extract_all(coalesce(text, ''), '{token}') AS t FROM said)),
    placed AS (SELECT *, lower(token) AS word, {", ".join(f"lag(lower(token), {n}) OVER w AS p{n}, lag(token, {n}) OVER w AS t{n}" for n in (1, 2, 3))},
        lead(lower(token), 1) OVER w AS n1, lead(lower(token), 2) OVER w AS n2
        FROM tokens WINDOW w AS (PARTITION BY id, side ORDER BY i)),
    facts AS (SELECT id, side, min(i) FILTER (word = 'but') AS but_at,
        count(*) FILTER (WHERE {loud('token')}) BETWEEN 1 AND count(*) - 1 AS mixed
        FROM placed GROUP BY id, side),
    v0 AS (SELECT p.*, f.but_at, f.mixed, l.valence + CASE WHEN f.mixed AND {loud('token')}
        THEN 0.733::DOUBLE * CASE WHEN l.valence < 0 THEN -1 ELSE 1 END ELSE 0 END AS v
        FROM placed p JOIN lexicon l ON l.term = p.word JOIN facts f USING (id, side)),
    {steps(1, 1.0, 'false', 1.0, 'false')},
    {steps(2, 0.95, never2, 1.5, sure2)},
    {steps(3, 0.9, never3, 1.25, sure3)},
    v4 AS (SELECT * REPLACE (CASE WHEN p3 IS NOT NULL AND p3 NOT IN (SELECT term FROM lexicon)
        THEN coalesce({", ".join(idiom(x) for x in phrases)}, v) - CASE WHEN {weaker} THEN 0.293::DOUBLE ELSE 0::DOUBLE END ELSE v END AS v) FROM v3),
    v5 AS (SELECT * REPLACE (CASE WHEN {among('p1', m.least)} AND p1 NOT IN (SELECT term FROM lexicon)
        AND NOT {among('p2', m.before_least)} THEN v * -0.74::DOUBLE ELSE v END AS v) FROM v4),
    totals AS (SELECT id, side, sum(CASE WHEN {weightless} THEN 0::DOUBLE ELSE v END * CASE WHEN i < but_at THEN 0.5::DOUBLE WHEN i > but_at THEN 1.5::DOUBLE
        ELSE 1::DOUBLE END) AS s FROM v5 GROUP BY id, side),
    marked AS (SELECT id, side, coalesce(s, 0) AS s,
        least(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')), 4) * 0.292::DOUBLE
        + CASE WHEN q > 3 THEN 0.96::DOUBLE WHEN q > 1 THEN q * 0.18::DOUBLE ELSE 0 END AS marks
        FROM (SELECT *, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '?', '')) AS q FROM said)
        LEFT JOIN totals USING (id, side)),
    summed AS (SELECT id, side, CASE WHEN s > 0 THEN s + marks WHEN s < 0 THEN s - marks ELSE 0 END AS s FROM marked),
    scored AS (SELECT id, side, round(s / sqrt(s * s + 15), 4) AS score FROM summed)"""


def scored_oracle(name: str, view: str, source: str, sql: str) -> None:
    ORACLES[name] = _with([view, "lexicon"], "").rstrip() + ",\n" + _scores(source) + "\n" + sql


QUESTION_SCORES = f"SELECT id, score AS question_sentiment, {_category('score')} AS question_sentiment_category FROM scored"
scored_oracle("sentiment_scores", "texts", "SELECT id, 0 AS side, question AS text FROM texts", QUESTION_SCORES)
scored_oracle(
    "conversation_sentiment",
    "conv",
    "SELECT id, 0 AS side, question AS text FROM conv UNION ALL SELECT id, 1, answer FROM conv",
    f"""SELECT q.id, q.score AS question_sentiment, a.score AS answer_sentiment,
    {_category('q.score')} AS question_sentiment_category, {_category('a.score')} AS answer_sentiment_category
    FROM scored q JOIN scored a ON a.id = q.id AND q.side = 0 AND a.side = 1""",
)
scored_oracle(
    "sentiment_distribution",
    "texts",
    "SELECT id, 0 AS side, question AS text FROM texts",
    f"""SELECT sentiment, count(id) AS count FROM (VALUES ('negative'), ('neutral'), ('positive')) d(sentiment)
    LEFT JOIN ({QUESTION_SCORES}) s ON s.question_sentiment_category = sentiment GROUP BY sentiment""",
)
oracle(
    "term_weights",
    "texts",
    f""", occurring AS (SELECT id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM texts),
    counted AS (SELECT id, term, count(*) AS tf FROM occurring WHERE term NOT IN {_in(fx.STOP_WORDS)} GROUP BY 1, 2),
    kept AS (SELECT term, ln((1 + (SELECT count(*) FROM texts)) / (1 + count(*))) + 1 AS idf FROM counted
        GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 1000),
    weighed AS (SELECT id, term, tf * idf AS w FROM counted JOIN kept USING (term))
    SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM weighed""",
)
ORACLES["term_weights"] = ORACLES["term_weights"].replace("\n, occurring", ",\noccurring")

# Words and pairs of words of the benchmark as rules.
VIEWS["rules"] = """SELECT *, CAST('0x' || substr(md5(keyword), 1, 6) AS BIGINT) AS priority,
    'label ' || CAST('0x' || substr(md5(keyword), 1, 6) AS BIGINT) % 7 AS label FROM (SELECT DISTINCT unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS keyword FROM (SELECT list_filter(
    regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM benchmark))"""
oracle(
    "keyword_labels",
    "texts rules",
    """SELECT id, coalesce('label ' || min(priority) % 7, 'none') AS topic
    FROM texts LEFT JOIN rules ON contains(lower(question), keyword) GROUP BY id""",
)
oracle(
    "keyword_totals",
    "texts rules",
    """SELECT label AS topic, CAST(sum((length(lower(question)) - length(replace(lower(question), keyword, ''))) // length(keyword)) AS BIGINT) AS score
    FROM texts JOIN rules ON contains(lower(question), keyword) GROUP BY label""",
)

# Scaling, encoding, splits, evaluation
oracle(
    "scaled_features",
    "features",
    "SELECT client_id, "
    + ", ".join(f"round(({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER (), 4) AS {f}" for f in SEGMENT_FEATURES if f != "unique_topics")
    + """, round(CASE WHEN stddev_pop(unique_topics) OVER () = 0 THEN 0 ELSE
    (unique_topics - avg(unique_topics) OVER ()) / nullif(stddev_pop(unique_topics) OVER (), 0) END, 4) AS unique_topics
    FROM features""",
)
ORACLES["encoded_labels"] = """SELECT event_id, event_type, code FROM events JOIN (SELECT event_type,
    dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)"""
ORACLES["train_test_split"] = """SELECT doc_id AS id,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 10000 < 2000 AS in_test FROM documents"""
ORACLES["classification_report"] = """WITH p AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS actual,
    CASE WHEN toxic = 0 THEN 'good' ELSE 'poor' END AS predicted FROM labels),
    c AS (SELECT class, count(*) FILTER (actual = class AND predicted = class) AS hits,
    count(*) FILTER (actual = class) AS support, count(*) FILTER (predicted = class) AS called
    FROM p, (VALUES ('good'), ('poor')) k(class) GROUP BY class),
    r AS (SELECT class, support, hits, coalesce(hits / nullif(called, 0), 0) AS precision,
    coalesce(hits / nullif(support, 0), 0) AS recall FROM c),
    f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r),
    t AS (SELECT class, precision, recall, f1, support FROM f
    UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM f
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM f)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
    CAST(support AS BIGINT) AS support FROM t"""


# Forecast
def _forecast(daily: str, by: str, partition: str) -> str:
    lags = ", ".join(f"lag(volume, {n}) OVER (PARTITION BY {partition} ORDER BY date) AS lag_{n}" for n in (1, 2, 3, 7))
    return f"""SELECT {by} date, volume, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
        CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day_of_month,
        CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, lag_1, lag_2, lag_3, lag_7
        FROM (SELECT *, {lags} FROM {daily}) WHERE lag_7 IS NOT NULL"""


oracle("forecast_features", "daily", _forecast("daily", "", "1"))
oracle("topic_forecast_features", "topic_daily", _forecast("topic_daily", "topic,", "topic"))
oracle(
    "forecast_dates",
    "daily",
    "SELECT CAST((SELECT max(date) FROM daily) + CAST(n AS INTEGER) AS DATE) AS date FROM range(1, 8) t(n)",
)

# Recommendation
oracle("client_topic_pivot", "matrix", "SELECT * FROM matrix")
T = fx.TOPIC_NAMES
oracle(
    "topic_similarity",
    "matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS topic_a, '{b}' AS topic_b, round(corr(\"{a}\", \"{b}\"), 6) AS correlation FROM matrix"
        for i, a in enumerate(T)
        for b in T[i + 1 :]
    ),
)
oracle(
    "client_similarity",
    "chats",
    """, ranked AS (SELECT client_id, row_number() OVER (ORDER BY count(*) DESC, client_id) AS r FROM chats
    GROUP BY client_id ORDER BY r LIMIT 10),
    grid AS (SELECT client_id, r, topic, (SELECT count(*) FROM chats c
    WHERE c.client_id = ranked.client_id AND c.topic = k.topic) AS n
    FROM ranked, (SELECT DISTINCT topic FROM chats) k)
    SELECT a.client_id AS client_a, b.client_id AS client_b, round(corr(a.n, b.n), 6) AS correlation
    FROM grid a JOIN grid b ON a.topic = b.topic AND a.r < b.r GROUP BY a.client_id, b.client_id""",
)
ORACLES["client_similarity"] = ORACLES["client_similarity"].replace("\n, ranked", ",\nranked")
MEAN = "(" + " + ".join(f'"{t}"' for t in T) + f") / {len(T)}"
LENGTH = "sqrt(" + " + ".join(f'("{t}" - m) ** 2' for t in T) + ")"
oracle(
    "client_topic_profiles",
    "matrix",
    "SELECT client_id, "
    + ", ".join(f'round(("{t}" - m) / nullif(l, 0), 6) AS {t.lower()}' for t in T)
    + f" FROM (SELECT *, {LENGTH} AS l FROM (SELECT *, {MEAN} AS m FROM matrix))",
)


def _occurrences(keyword: str) -> str:
    return f"(length(lower(question)) - length(replace(lower(question), '{keyword}', ''))) // {len(keyword)}"


oracle(
    "topic_recommendations",
    "texts",
    "SELECT topic, score FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS ord, '{topic}' AS topic, CAST(sum({' + '.join(_occurrences(k) for k in keywords)}) AS BIGINT) AS score FROM texts"
        for i, (topic, keywords) in enumerate(fx.CANDIDATES)
    )
    + f""") WHERE topic NOT IN (SELECT {_label('question', (('Support', ('hour', 'that')),), 'Other')} FROM texts)
    ORDER BY score DESC, ord LIMIT 5""",
)

# Models with given assignments
oracle(
    "given_segment_profiles",
    "features",
    "SELECT CAST(client_id % 4 AS INTEGER) AS segment, " + ", ".join(f"round(avg({f}), 4) AS {f}" for f in SEGMENT_FEATURES)
    + " FROM features GROUP BY 1",
)
ORACLES["given_cluster_terms"] = f"""WITH weights AS ({ORACLES["term_weights"].replace("round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6)", "w / sqrt(sum(w * w) OVER (PARTITION BY id))")}),
    members AS (SELECT CAST(doc_id % 3 AS INTEGER) AS topic_cluster, count(*) AS n FROM documents GROUP BY 1),
    means AS (SELECT m.topic_cluster, term, sum(weight) / any_value(m.n) AS weight FROM weights JOIN members m ON m.topic_cluster = id % 3 GROUP BY 1, 2)
    SELECT topic_cluster, term, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY topic_cluster ORDER BY weight DESC, term) AS INTEGER) AS rank
    FROM means QUALIFY row_number() OVER (PARTITION BY topic_cluster ORDER BY weight DESC, term) <= 10"""
oracle(
    "given_forecast_union",
    "topic_daily",
    f"""SELECT topic, date, volume, 'Historical' AS type FROM ({_forecast("topic_daily", "topic,", "topic")})
    UNION ALL SELECT topic, CAST(last + CAST(n AS INTEGER) AS DATE), day(last + CAST(n AS INTEGER)), 'Forecast'
    FROM (SELECT topic, max(date) AS last FROM topic_daily GROUP BY topic), range(1, 8) t(n)""",
)
oracle(
    "given_hybrid_intent",
    "texts",
    f"""SELECT *, CASE WHEN intent <> '{fx.INTENT_DEFAULT}' THEN intent ELSE predicted_intent END AS hybrid_intent
    FROM (SELECT id, {_label('question', fx.INTENTS[:2], fx.INTENT_DEFAULT)} AS intent,
    {_label('question', fx.INTENTS[2:], fx.INTENT_DEFAULT)} AS predicted_intent FROM texts)""",
)
oracle(
    "recent_volumes",
    "topic_daily",
    """SELECT topic, max(date) AS last_date, string_agg(CAST(volume AS VARCHAR), ',' ORDER BY date DESC) AS volumes
    FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY date DESC) AS n FROM topic_daily) WHERE n <= 7 GROUP BY topic""",
)
oracle(
    "normalized_texts",
    "texts",
    r"SELECT id, md5(regexp_replace(lower(coalesce(question, '')), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', '', 'g')) AS digest FROM texts",
)
ORACLES["cleaned_suppliers"] = "SELECT s_suppkey AS supplier_id, s_name, s_nationkey, 'supplier' AS tables FROM supplier"

# All pairs of topics from long counts, zeros filled in.
ORACLES["word_topic_similarity"] = """WITH c AS (SELECT l_suppkey AS client_id, p_brand || ' ' || p_type AS topic, count(*)::DOUBLE AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    k AS (SELECT count(DISTINCT client_id)::DOUBLE AS k FROM c),
    t AS (SELECT topic, sum(n) AS x, sum(n * n) AS xx FROM c GROUP BY topic),
    p AS (SELECT a.topic AS topic_a, b.topic AS topic_b, sum(a.n * b.n) AS xy FROM c a JOIN c b ON a.client_id = b.client_id AND a.topic < b.topic GROUP BY 1, 2)
    SELECT a.topic AS topic_a, b.topic AS topic_b, round((k * coalesce(xy, 0) - a.x * b.x)
    / nullif(sqrt(greatest((k * a.xx - a.x * a.x) * (k * b.xx - b.x * b.x), 0)), 0), 6) AS correlation
    FROM t a JOIN t b ON a.topic < b.topic LEFT JOIN p ON topic_a = a.topic AND topic_b = b.topic, k"""
oracle(
    "incremental_days",
    "chats",
    """SELECT CAST(created_at AS DATE) AS date, topic, count(*) AS rows, count(question) AS questions, count(answer) AS answers
    FROM chats GROUP BY 1, 2""",
)

# Streams
oracle(
    "streaming_messages_per_day",
    "chats",
    "SELECT topic, CAST(created_at AS DATE) AS date, count(question) AS message_count FROM chats GROUP BY 1, 2",
)
oracle(
    "streaming_sessions",
    "sessions",
    f"""SELECT client_id, session_start, session_end, messages, round({LENGTH_MIN}, 9) AS session_length_min
    FROM sessions""",
)
oracle("streaming_session_ids", "sessioned", "SELECT id, client_id, created_at, session_id, false AS late FROM sessioned")
