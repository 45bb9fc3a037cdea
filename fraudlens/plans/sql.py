"""SQL texts of the catalog, for another engine on the same tables."""

from __future__ import annotations

from fraudlens import constants as C
from fraudlens.sources import adapters as A


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _re(pattern: str) -> str:
    """A pattern as a literal for an engine without look-around."""
    return "'" + pattern.replace("'", "''") + "'"


def risk_label(x: str) -> str:
    return f"CASE WHEN coalesce({x}, 0) >= {C.RISK_LABEL_HIGH} THEN 'High Risk' WHEN coalesce({x}, 0) >= {C.RISK_LABEL_SUSPICIOUS} THEN 'Suspicious' ELSE 'Safe' END"


def score_to_int(x: str) -> str:
    return f"CAST(greatest(0, least(100, round_even(CASE WHEN {x} <= 1 THEN {x} * 100 ELSE {x} END, 0))) AS BIGINT)"


_CHANNEL = "CASE ({n}) % 3 WHEN 0 THEN 'dashboard' WHEN 1 THEN 'whatsapp' ELSE 'extension' END"

REPORTS = f"""reports AS (
  SELECT CAST(event_id AS VARCHAR) AS id, '+91-9' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS scam_phone,
         'k' || k || '@upi' AS upi_id, c_mktsegment || ' ' || CAST(CAST(k AS BIGINT) % 20 AS VARCHAR) AS company_name, event_type AS job_role,
         CAST(NULL AS BIGINT) AS salary, CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS fee, n_name AS location,
         CAST(least(100, floor(value)) AS INT) AS risk_score, CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS trust_weight, ts AS report_time
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) e
  JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)
"""


def with_reports(rest: str) -> str:
    return f"WITH {REPORTS} " + (rest if rest.lstrip().upper().startswith("SELECT") else ", " + rest.lstrip(", "))


_REP = """rep AS (
  SELECT *, CASE WHEN trust_score < 1 THEN 'UNKNOWN' WHEN trust_score <= 3 THEN 'SUSPICIOUS' ELSE 'CONFIRMED_SCAM' END AS reputation
  FROM (SELECT scam_phone, count(*) AS report_count, round(sum(coalesce(trust_weight, 0)), 2) AS trust_score FROM reports GROUP BY 1) t)
"""
REPUTATION = _REP + "SELECT * FROM rep"
STATS = """r AS (SELECT regexp_replace(scam_phone, '[^0-9]', '', 'g') AS phone, trim(upi_id) AS upi, trim(company_name) AS company FROM reports)
SELECT count(*) AS total_reports, count(DISTINCT phone) AS suspicious_numbers,
  (SELECT count(*) FROM (SELECT upi FROM r GROUP BY upi HAVING count(DISTINCT phone) > 1) a) + (SELECT count(*) FROM (SELECT company FROM r GROUP BY company HAVING count(DISTINCT phone) > 1) b) AS detected_syndicates,
  (SELECT count(*) FROM (SELECT company FROM r GROUP BY company HAVING count(*) = 1) c) AS companies_seen_once,
  (SELECT count(*) FROM (SELECT company FROM r GROUP BY company HAVING count(*) = 1) c) AS verified_companies
FROM r"""
RECENT = f"""SELECT id, scam_phone AS phone, company_name || ' | ' || job_role || CASE WHEN fee <> 0 THEN ' | Fee ' || fee ELSE '' END || ' | ' || upi_id AS message,
  {risk_label('risk_score')} AS risk, location, strftime(report_time, '%Y-%m-%d %I:%M %p') AS timestamp
FROM (SELECT * FROM reports ORDER BY report_time DESC, id LIMIT 50) t"""
HEAT_POINTS = """h AS (SELECT trim(location) AS state, count(*) AS count FROM reports GROUP BY 1),
p AS (SELECT r_name AS label, CAST(sum(count) AS BIGINT) AS count, min(n_nationkey * 1.5::DOUBLE) AS lat, min(n_nationkey * 2.5::DOUBLE) AS lng
      FROM h JOIN nation n ON regexp_replace(lower(h.state), '[^a-z]', '', 'g') = regexp_replace(lower(n.n_name), '[^a-z]', '', 'g') JOIN region r ON n.n_regionkey = r.r_regionkey
      WHERE n_nationkey <> 3 GROUP BY 1),
i AS (SELECT *, round(count / greatest(max(count) OVER (), 1), 6) AS intensity FROM p)
SELECT label, count, lat, lng, intensity, CASE WHEN intensity > 0.7 THEN '#ef4444' WHEN intensity > 0.4 THEN '#f59e0b' ELSE '#3b82f6' END AS colour,
  round(8 + intensity * 16, 4) AS radius, round(greatest(4, intensity * 100), 4) AS bar FROM i"""
TREND = """c AS (SELECT CAST(report_time AS DATE) AS day, count(*) AS n FROM reports GROUP BY 1),
s AS (SELECT CAST((SELECT max(day) FROM c) - CAST(i AS INT) AS DATE) AS day FROM range(7) t(i))
SELECT s.day, strftime(s.day, '%m-%d') AS date, coalesce(c.n, 0) AS count FROM s LEFT JOIN c ON s.day = c.day"""
PHONE_LOOKUP = """q AS (SELECT '91-9 ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS number FROM customer),
g AS (SELECT regexp_replace(scam_phone, '[^0-9]', '', 'g') AS k, count(*) AS n, round(sum(coalesce(trust_weight, 0)), 2) AS trust, list_sort(list(DISTINCT company_name)) AS companies,
             list_sort(list(DISTINCT upi_id)) AS upi_ids, max(report_time) AS last FROM reports GROUP BY 1)
SELECT number, regexp_replace(number, '[^0-9]', '', 'g') AS normalized_number, CASE WHEN n IS NULL THEN 'Safe' WHEN trust >= 3 OR n >= 3 THEN 'High Risk' ELSE 'Suspicious' END AS risk,
  coalesce(n, 0) AS report_count, coalesce(trust, 0) AS trust_score, coalesce(companies, []) AS companies, coalesce(upi_ids, []) AS upi_ids,
  coalesce(strftime(last, '%Y-%m-%d %I:%M %p'), 'N/A') AS last_seen
FROM q LEFT JOIN g ON regexp_replace(number, '[^0-9]', '', 'g') = g.k"""
PHONE_RECENT = f"""n AS (SELECT regexp_replace(scam_phone, '[^0-9]', '', 'g') AS normalized_number, row_number() OVER (PARTITION BY scam_phone ORDER BY report_time DESC, id) AS place, * FROM reports)
SELECT normalized_number, place, id, company_name, job_role, {risk_label('risk_score')} AS risk, location, report_time FROM n WHERE place <= 5"""
CHECK_PHONE = _REP + """, q AS (SELECT '+91-9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS number FROM customer)
SELECT number, coalesce(report_count, 0) > 0 AS reported, coalesce(report_count, 0) AS report_count, coalesce(trust_score, 0) AS trust_score, coalesce(reputation, 'UNKNOWN') AS reputation
FROM q LEFT JOIN rep ON q.number = rep.scam_phone"""
LINKS = """p AS (
  SELECT scam_phone AS source, upi_id AS target FROM reports UNION ALL SELECT scam_phone, job_role FROM reports
  UNION ALL SELECT job_role, company_name FROM reports UNION ALL SELECT upi_id, company_name FROM reports)
SELECT source, target, count(*) AS value FROM p WHERE source <> '' AND target <> '' AND source <> target GROUP BY 1, 2"""
NODES = """p AS (
  SELECT scam_phone AS node, 1 AS g, 'Phone Number' AS label FROM reports UNION SELECT upi_id, 2, 'UPI ID' FROM reports
  UNION SELECT job_role, 3, 'Job Role' FROM reports UNION SELECT company_name, 4, 'Company Name' FROM reports)
SELECT node, CAST(min(g) AS BIGINT) AS "group", min_by(label, g) AS label FROM p WHERE node <> '' GROUP BY node"""
TYPED_EDGES = """typed_edges AS (
  SELECT 'phone:' || CAST(user_id AS VARCHAR) AS source_id, 'upi:' || json_extract_string(props, '$.k') AS target_id, ts FROM events WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL)
"""
NETWORK_FROM_EDGES = """, e AS (SELECT source_id AS a, target_id AS b, max(ts) AS last_seen FROM typed_edges GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 300),
n AS (SELECT a AS node, 1 AS g, 'Phone Number' AS label FROM e UNION ALL SELECT b, 2, 'UPI ID' FROM e)
SELECT node, CAST(min(g) AS BIGINT) AS "group", min_by(label, g) AS label, count(*) AS links FROM n GROUP BY node"""

NORMAL = r"trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g'))"
_TIME = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 60)"
MESSAGES = f"""messages AS (
  SELECT doc_id AS msg_id, {_TIME} AS ts, 'u' || CAST(doc_id % 50 AS VARCHAR) AS sender, text, doc_id % 7 = 0 AS forwarded,
         {_CHANNEL.format(n="coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)', 1), '') AS BIGINT), 0)")} AS source_channel
  FROM documents)
"""


def _sentence() -> str:
    words = {
        "salary": "CAST(n_chars * 10 AS VARCHAR)", "fee": "CAST(n_chars AS VARCHAR)", "digits": "lpad(CAST(doc_id AS VARCHAR), 8, '0')", "nine": "lpad(CAST(doc_id AS VARCHAR), 9, '0')",
        "user": "CAST(doc_id % 50 AS VARCHAR)",
    }
    cases = (f"WHEN {share} THEN " + " || ".join(words.get(p, "'" + p.replace("'", "''") + "'") for p in parts) for share, parts in A.SENTENCES)
    return f"CASE doc_id % 6 {' '.join(cases)} END || '.' || chr(10) || text"


JOB_MESSAGES = MESSAGES + f", job_messages AS (SELECT m.msg_id, m.ts, m.source_channel, {_sentence()} AS text FROM messages m JOIN (SELECT doc_id, n_chars FROM documents) d ON m.msg_id = d.doc_id)"


def _canonical(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return (
        f"CASE WHEN length({d}) < 10 OR length({d}) > 15 THEN NULL WHEN regexp_matches({d}, '^91[6-9][0-9]{{9}}$') OR regexp_matches({d}, '^0[6-9][0-9]{{9}}$') OR regexp_matches({d}, '^[6-9][0-9]{{9}}$') "
        f"THEN right({d}, 10) ELSE '+' || {d} END"
    )


PHONE_CANONICAL = f"""SELECT c_custkey, {_canonical("f")} AS phone FROM (
  SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '+91 98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 1 THEN '098' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')
    WHEN 2 THEN '(987) 6-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') WHEN 3 THEN '+971-50-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') ELSE CAST(c_custkey AS VARCHAR) END AS f FROM customer) t"""


def _first_seen(items: str) -> str:
    """Distinct items of a list without nulls, first seen first."""
    return f"list_filter({items}, lambda x, i: x IS NOT NULL AND list_position({items}, x) = i)"


EXTRACT_PHONES = rf"WITH {JOB_MESSAGES}, f AS (SELECT msg_id, list_transform(regexp_extract_all(text, '(?:^|\W)(\+?\d[\d\s()\-]{{8,}}\d)', 1), lambda c: {_canonical('c')}) AS p FROM job_messages) SELECT msg_id, {_first_seen('p')} AS phones FROM f"
EXTRACT_UPIS = rf"WITH {JOB_MESSAGES}, f AS (SELECT msg_id, list_transform(regexp_extract_all(text, '\b[a-zA-Z0-9.\-_]{{2,}}@[a-zA-Z]{{2,}}\b'), lambda c: lower(c)) AS u FROM job_messages) SELECT msg_id, {_first_seen('u')} AS upi_ids FROM f"


def _amount(words) -> str:
    """The number after a word, else before one; written for itself, with this engine's word bounds."""
    key, number = "|".join(words), r"\b(?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d+)?\b"
    found = (
        f"nullif(regexp_extract(text, '{p}', 1), '')"
        for p in (rf"(?i)\b(?:{key})\b\s*(?::|=|is)?\s*(?:rs\.?|inr|aed)?\s*({number})", rf"(?i)({number})\s*(?:rs\.?|inr|aed)?\s*\b(?:{key})\b")
    )
    return f"CAST(trunc(CAST(replace(coalesce({', '.join(found)}), ',', '') AS DOUBLE)) AS BIGINT)"


def _clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^[ \-,:.;]+|[ \-,:.;]+$', '', 'g')"


def _title(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def _found(pattern: str, x: str = "text") -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', 1), '')"


_STOPS = rf"\b(?:{'|'.join(C.STOP_TOKENS)})\b"
_PLACES = (
    r"(?i)\b(?:location|loc|place)\s*[:=-]?\s*([A-Za-z][A-Za-z\s,.-]{2,60})",
    r"(?i)\b(?:based\s+in|posted\s+in|work\s+location)\s*[:=-]?\s*([A-Za-z][A-Za-z\s,.-]{2,60})",
    r"(?i)\b(?:in|at|from|to)\s+([A-Za-z][A-Za-z\s,.-]{2,50})",
)
_NAMED = ", ".join("nullif(" + _clean(f"trim(regexp_replace({_clean(_found(p))}, '(?is){_STOPS}.*$', ''))") + ", '')" for p in _PLACES)
_KNOWN = f"list_filter({_list(sorted(C.LOCATIONS, key=lambda w: -len(w)))}, lambda w: regexp_matches(lower(text), '\\b' || w || '\\b'))[1]"
_FIRM = r"([A-Za-z][A-Za-z0-9&.,''\- \s]{1,60}?)"
_COMPANY = ", ".join(f"nullif({_clean(_found(p))}, '')" for p in (rf"(?i)\b(?:company|organization|firm)\s*[:=-]?\s*{_FIRM}(?:{_STOPS}|$)", rf"(?i)\b(?:at|from)\s+{_FIRM}(?:{_STOPS}|$)"))
_TAGGED = _found(rf"(?i)\b(?:role|position|job|vacancy|opening|designation)\s*(?::|as|for)?\s+([A-Za-z][A-Za-z\s]{{1,50}}?)(?:{_STOPS}|$)")
_HEAD = r"regexp_replace(CASE WHEN location IS NULL THEN text ELSE regexp_replace(text, '(?is)\b' || replace(location, '.', '\.') || '\b.*$', '') END, '(?is)\b(?:salary|fee|registration|call|contact|agent|broker|phone|company|location)\b.*$', '')"
ENTITIES = JOB_MESSAGES + f""", e0 AS (SELECT msg_id, ts, source_channel, text, coalesce({_NAMED}) AS named, {_KNOWN} AS known, {_title(_clean(_found(r"(?i)\b(?:agent|broker|contact(?:\s+person)?)\s*[:=-]?\s*([A-Za-z][A-Za-z.''-]*)")))} AS agent,
  {_title(f"coalesce({_COMPANY})")} AS company, {_amount(C.SALARY_WORDS)} AS salary, {_amount(C.FEE_WORDS)} AS fee, list_filter({_list(C.URGENCY_PHRASES)}, lambda p: contains(lower(text), p)) AS urgency_flags,
  list_transform(regexp_extract_all(text, '(?:^|\\W)(\\+?\\d[\\d\\s()\\-]{{8,}}\\d)', 1), lambda c: {_canonical('c')}) AS p, list_transform(regexp_extract_all(text, '\\b[a-zA-Z0-9.\\-_]{{2,}}@[a-zA-Z]{{2,}}\\b'), lambda c: lower(c)) AS u FROM job_messages),
e1 AS (SELECT *, {_title("coalesce(array_to_string(string_split(named, ' ')[1:5], ' '), known)")} AS location FROM e0),
e2 AS (SELECT *, nullif({_clean(_TAGGED)}, '') AS tagged, nullif({_clean(_HEAD)}, '') AS head FROM e1),
ent AS (SELECT msg_id, ts, source_channel, location, fee, urgency_flags, coalesce(tagged, CASE WHEN len(string_split(head, ' ')) <= 6 AND lower(head) NOT IN ('urgent', 'immediate', 'apply now', 'apply today') THEN head END) AS role,
  {_first_seen('p')} AS phones, {_first_seen('u')} AS upi_ids, salary, agent, company, fee IS NOT NULL AS has_fee, len(urgency_flags) > 0 AS has_urgency FROM e2)"""
ENTITY_TABLE = """, items AS (
  SELECT msg_id, 'phone' AS entity_type, unnest(phones) AS value, generate_subscripts(phones, 1) - 1 AS pos FROM ent
  UNION ALL SELECT msg_id, 'upi', unnest(upi_ids), generate_subscripts(upi_ids, 1) - 1 FROM ent UNION ALL SELECT msg_id, 'urgency', unnest(urgency_flags), generate_subscripts(urgency_flags, 1) - 1 FROM ent
  UNION ALL SELECT msg_id, 'salary', CAST(salary AS VARCHAR), 0 FROM ent UNION ALL SELECT msg_id, 'fee', CAST(fee AS VARCHAR), 0 FROM ent UNION ALL SELECT msg_id, 'role', role, 0 FROM ent
  UNION ALL SELECT msg_id, 'location', location, 0 FROM ent UNION ALL SELECT msg_id, 'agent', agent, 0 FROM ent UNION ALL SELECT msg_id, 'company', company, 0 FROM ent),
entity_table AS (SELECT msg_id, entity_type, value, CAST(pos AS BIGINT) AS pos FROM items WHERE value IS NOT NULL)"""
PREVALENCE = """ SELECT entity_type, value, count(*) AS messages, count(DISTINCT source_channel) AS channels, min(ts) AS first_seen, max(ts) AS last_seen
FROM (SELECT DISTINCT msg_id, entity_type, value FROM entity_table) i JOIN ent USING (msg_id) GROUP BY 1, 2"""
AMOUNT_PROFILE = """ SELECT coalesce(location, 'unknown') AS location, count(*) AS messages, min(salary) AS min_salary, max(salary) AS max_salary, min(fee) AS min_fee, max(fee) AS max_fee,
  round(avg(salary), 4) AS avg_salary, round(avg(fee), 4) AS avg_fee, round(avg(CAST(fee IS NOT NULL AS DOUBLE)), 6) AS fee_share FROM ent GROUP BY 1"""
EXTRACT_AMOUNTS = f"WITH {JOB_MESSAGES} SELECT msg_id, {_amount(C.SALARY_WORDS)} AS salary, {_amount(C.FEE_WORDS)} AS fee FROM job_messages"
URGENCY = f"WITH {JOB_MESSAGES} SELECT msg_id, list_filter({_list(C.URGENCY_PHRASES)}, lambda p: contains(lower(text), p)) AS flags FROM job_messages"
_WORDS = "regexp_extract_all(lower(text), '([a-z'']+)', 1)"


def language(tokens: tuple[str, ...]) -> str:
    hits = f"len(list_filter({_WORDS}, lambda w: w IN {_in(tokens)}))"
    return f"CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'hi' WHEN {hits} >= 2 OR ({hits} >= 1 AND len({_WORDS}) <= 6) THEN 'hi' ELSE 'en' END"


LANGUAGE = language(C.ROMAN_HINDI)
# texts as a user sends them: a few words of which some are of one list only
SENT = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Kripya reply' WHEN 1 THEN 'paise bhejo' WHEN 2 THEN 'kripya apply for the job in the city today' WHEN 3 THEN 'bhejiye kripya the form of the job soon' WHEN 4 THEN 'naukri' ELSE text END AS text FROM documents"
_COUNT = "length(regexp_replace(t, '[^{c}]', '', 'g'))"
SCRIPT_HINT = f"""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'यह नौकरी असली नहीं है और पैसे मत भेजो' WHEN 1 THEN 'இந்த வேலை உண்மை இல்லை நம்பாதே' WHEN 2 THEN 'नौकरी चाहिए salary and fee details ' || text ELSE text END AS t FROM documents),
n AS (SELECT doc_id, {_COUNT.format(c='ऀ-ॿ')} AS d, {_COUNT.format(c='஀-௿')} AS m, {_COUNT.format(c='A-Za-z')} AS a FROM s)
SELECT doc_id, CASE WHEN m > 10 AND d < 5 THEN 'tamil' WHEN m > 10 THEN 'mixed' WHEN d > 20 AND a < 20 THEN 'hindi' WHEN d > 5 THEN 'mixed' ELSE 'english' END AS script FROM n"""
LANGUAGE_COMMAND = """WITH b AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'EN!' WHEN 1 THEN ' language hindi. ' WHEN 2 THEN 'हिंदी' ELSE text END AS t FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, turn, lower(trim(regexp_replace(t, '[^a-zA-Zऀ-ॿ ]+', '', 'g'))) AS v FROM b)
SELECT conv_id, turn, CASE WHEN v IN ('en', 'english', 'lang en', 'language en', 'language english') THEN 'en' WHEN v IN ('hi', 'hindi', 'हिंदी', 'हिन्दी', 'lang hi', 'language hi', 'language hindi') THEN 'hi' END AS command FROM c"""
INBOUND = """SELECT conv_id, turn, 'wa:' || CAST(conv_id % 97 AS VARCHAR) AS from_number, trim(replace(coalesce(text, ''), 'CHECK', '')) AS body_text, conv_id % 3 <> 1 AS forwarded,
  CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END AS media_count, CASE conv_id % 4 WHEN 0 THEN 'extension' WHEN 1 THEN 'whatsapp' ELSE 'dashboard' END AS source
FROM conversations WHERE role = 'user'"""
PAGE_TEXT = r"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '(?is)<(script|style|head)[ >].*?</(script|style|head)>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t, '(?s)<[^>]*>', ' ', 'g') AS t FROM b)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM c"""

_HASHED = MESSAGES + f", hashed AS (SELECT msg_id, ts, sha256(n) AS message_hash, length(n) AS text_length, forwarded, source_channel AS channel FROM (SELECT *, {NORMAL} AS n FROM messages) t)"
FINGERPRINTS = _HASHED + """, fps AS (
  SELECT message_hash, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS seen_count, bool_or(forwarded) AS forwarded_flag, list_sort(list(DISTINCT channel)) AS source_channels, max(text_length) AS text_length
  FROM hashed GROUP BY message_hash)"""


def _score(fwd: str, seen: str, channels: str, n: str) -> str:
    part = lambda test, x: f"CASE WHEN {test} THEN {x}::DOUBLE ELSE 0 END"
    return f"round(least(1.0, {part(fwd, '0.3')} + {part(seen + ' >= 3', '0.2')} + {part(seen + ' >= 10', '0.2')} + {part(channels + ' >= 2', '0.15')} + {part(n + ' < 180', '0.15')}), 2)"


_SCORED = f""", scored AS (SELECT message_hash, seen_count, CAST(len(source_channels) AS BIGINT) AS source_channels_count, {_score('forwarded_flag', 'seen_count', 'len(source_channels)', 'text_length')} AS propagation_score,
  list_filter([CASE WHEN forwarded_flag THEN 'whatsapp_forwarded_many_times' END, CASE WHEN seen_count >= 3 THEN 'seen_in_3_or_more_messages' END, CASE WHEN seen_count >= 10 THEN 'high_repeat_volume' END,
    CASE WHEN len(source_channels) >= 2 THEN 'cross_channel_spread' END, CASE WHEN text_length < 180 THEN 'short_broadcast_style_message' END], lambda x: x IS NOT NULL) AS signals FROM fps)"""
PROPAGATION_SCORE = _SCORED + " SELECT *, propagation_score >= 0.5 AS is_broadcast FROM scored"
FINGERPRINT_TABLE = _SCORED + " SELECT propagation_score >= 0.5 AS is_broadcast, source_channels_count, count(*) AS fingerprints, CAST(sum(seen_count) AS BIGINT) AS messages FROM scored GROUP BY 1, 2"
HISTORY = _HASHED.removeprefix(MESSAGES) + f""", arrivals AS (SELECT *, row_number() OVER (PARTITION BY message_hash, channel ORDER BY ts, msg_id) = 1 AS first FROM hashed),
w AS (SELECT *, row_number() OVER o AS seen_count, CAST(sum(CAST(first AS INT)) OVER o AS BIGINT) AS source_channels_count, bool_or(forwarded) OVER o AS forwarded_flag FROM arrivals
      WINDOW o AS (PARTITION BY message_hash ORDER BY ts, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT msg_id, message_hash, seen_count = 1 AS is_new_message, seen_count, source_channels_count, forwarded_flag, {_score('forwarded_flag', 'seen_count', 'source_channels_count', 'text_length')} AS propagation_score FROM w"""
UPSERT = "SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) t WHERE n = 1"


def _anchored(source: str, span_us: int) -> str:
    """Windows anchored at their first row, one after another, by recursion over each key."""
    return f"""RECURSIVE {source},
nx AS (SELECT r.key, r.us, min(n.us) AS later FROM (SELECT DISTINCT key, us FROM req) r LEFT JOIN (SELECT DISTINCT key, us FROM req) n ON r.key = n.key AND n.us >= r.us + {span_us} GROUP BY 1, 2),
s(key, begin_at) AS (SELECT key, min(us) FROM req GROUP BY key UNION ALL SELECT s.key, nx.later FROM s JOIN nx ON s.key = nx.key AND s.begin_at = nx.us WHERE nx.later IS NOT NULL),
placed AS (SELECT r.key, r.seq, r.us, max(s.begin_at) AS begin_at FROM req r JOIN s ON r.key = s.key AND s.begin_at <= r.us GROUP BY 1, 2, 3),
numbered AS (SELECT *, make_timestamp(us) AS ts, row_number() OVER (PARTITION BY key, begin_at ORDER BY us, seq) AS nth FROM placed)
"""


RATE_LIMIT = "WITH " + _anchored("req AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS seq, epoch_us(ts) AS us FROM events)", 86_400_000_000) + "SELECT key, ts, seq, nth, nth <= 3 AS allowed FROM numbered"
DEDUPE = (
    "WITH "
    + _anchored(MESSAGES + r", req AS (SELECT 'analysis:v1:' || source_channel || ':' || sha256(regexp_replace(text, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')) AS key, msg_id AS seq, epoch_us(ts) AS us FROM messages)", 21_600_000_000)
    + "SELECT seq AS msg_id, key AS cache_key, nth = 1 AS analysed FROM numbered"
)

COMPONENTS = TYPED_EDGES + """, k AS (SELECT DISTINCT source_id AS a, target_id AS b FROM typed_edges), both_ways AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""
SYNDICATES = """, grouped AS (
  SELECT list_sort(list(node)) AS entities, list_sort(list(split_part(node, ':', 2)) FILTER (WHERE node LIKE 'phone:%')) AS phones, list_sort(list(split_part(node, ':', 2)) FILTER (WHERE node LIKE 'upi:%')) AS upis FROM comp GROUP BY component),
synd AS (SELECT sha256(array_to_string(entities, '|')) AS fingerprint, CAST(len(entities) AS BIGINT) AS cluster_size, coalesce(phones, []) AS phones, coalesce(upis, []) AS upis, entities,
  round(least(1.0, 0.35::DOUBLE + CASE WHEN len(phones) >= 2 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(phones) >= 3 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN len(upis) >= 1 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN len(entities) >= 6 THEN 0.1::DOUBLE ELSE 0 END), 2) AS risk_score
  FROM grouped WHERE len(phones) >= 3 OR (len(phones) >= 2 AND len(upis) >= 1))"""
MEMBERSHIP = """, members AS (SELECT DISTINCT unnest(entities) AS k FROM synd)
SELECT event_id AS msg_id, m.k IS NOT NULL AS in_syndicate, CAST(CASE WHEN m.k IS NULL THEN 0 ELSE 1 END AS BIGINT) AS matches FROM events e LEFT JOIN members m ON m.k = 'phone:' || CAST(e.user_id AS VARCHAR)"""
_TRIPLES = """t AS (
  SELECT id, 'company' AS source_type, company_name AS source_value, 'contact_phone' AS relationship_type, 'phone' AS target_type, scam_phone AS target_value FROM reports
  UNION ALL SELECT id, 'company', company_name, 'located_in', 'location', location FROM reports
  UNION ALL SELECT id, 'company', company_name, 'payment_upi', 'upi', upi_id FROM reports
  UNION ALL SELECT id, 'phone', scam_phone, 'uses_upi', 'upi', upi_id FROM reports)
"""
GRAPH_EDGES = _TRIPLES + "SELECT source_type, source_value, relationship_type, target_type, target_value, count(*) AS weight FROM t GROUP BY 1, 2, 3, 4, 5"
GRAPH_VERTICES = """n AS (SELECT 'company' AS entity_type, company_name AS value FROM reports UNION SELECT 'phone', scam_phone FROM reports UNION SELECT 'location', location FROM reports UNION SELECT 'upi', upi_id FROM reports)
SELECT sha256(entity_type || ':' || value) AS id, entity_type, value FROM n"""
CONSISTENCY = """l AS (SELECT p_brand || ' ' || CAST(p_partkey % 20 AS VARCHAR) AS company, lower(p_type) AS role, CAST(p_size % 3 AS VARCHAR) AS licence FROM part),
cl AS (SELECT company_name AS company, count(DISTINCT location) AS n FROM reports GROUP BY 1),
pl AS (SELECT r.scam_phone, count(DISTINCT r2.location) AS n FROM (SELECT DISTINCT scam_phone, company_name FROM reports) r JOIN (SELECT DISTINCT company_name, location FROM reports) r2 ON r.company_name = r2.company_name GROUP BY 1),
rl AS (SELECT company, count(DISTINCT licence) AS n FROM l GROUP BY 1),
cc AS (SELECT DISTINCT company FROM l UNION SELECT DISTINCT company_name FROM reports),
x AS (SELECT (SELECT count(*) FROM cl) + (SELECT count(*) FROM pl) + (SELECT count(*) FROM rl) + (SELECT count(*) FROM cc) AS checks,
  (SELECT count(*) FROM cl WHERE n > 1) + (SELECT count(*) FROM pl WHERE n > 1) + (SELECT count(*) FROM rl WHERE n <> 1) + (SELECT count(*) FROM cc WHERE company NOT IN (SELECT company_name FROM reports)) AS contradictions)
SELECT contradictions, checks, round(contradictions / checks, 4) AS consistency_score FROM x"""

CLAIMS = r"""registry AS (
  SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key, pos, CASE WHEN pos % 2 = 0 THEN 'mumbai' ELSE 'delhi' END AS city,
         CASE WHEN pos % 5 = 0 THEN '' WHEN pos % 2 = 0 THEN 'maharashtra' ELSE 'ncr' END AS state, CASE WHEN pos % 3 = 0 THEN ['uae', 'qatar'] ELSE ['oman'] END AS countries,
         trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS category, p_size % 10 = 0 AS black
  FROM (SELECT p_name AS name, min(p_partkey) AS pos, min(p_type) AS p_type, max(p_size) AS p_size FROM part GROUP BY 1) t),
claims AS (
  SELECT *, trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) AS key FROM (
    SELECT c_custkey AS claim_id, CASE c_custkey % 4 WHEN 0 THEN p_name WHEN 1 THEN left(p_name, length(p_name) - 1) WHEN 2 THEN left(p_name, 1) || p_name ELSE p_name || 'xyz' END AS company,
      CASE c_nationkey % 5 WHEN 0 THEN 'Dubai' WHEN 1 THEN 'Doha, Qatar' WHEN 2 THEN 'New Delhi' WHEN 3 THEN 'Mumbai Maharashtra' END AS location,
      CASE c_custkey % 4 WHEN 0 THEN '98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 1 THEN '+97150' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 2 THEN '+974' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
      CASE c_custkey % 3 WHEN 0 THEN 'Driver' WHEN 1 THEN 'Welder' END AS role
    FROM customer JOIN part ON c_custkey % 200 = p_partkey) t)
"""
FUZZY = """, pairs AS (SELECT k.key, r.name, r.pos, levenshtein(k.key, r.key) AS d FROM (SELECT DISTINCT key FROM claims) k, registry r),
best AS (SELECT key, name, pos, d FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d, pos) AS n FROM pairs WHERE d <= 2) t WHERE n = 1),
typo AS (SELECT key, name, d FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d, pos) AS n FROM pairs WHERE d BETWEEN 1 AND 3) t WHERE n = 1)"""
WORK_COUNTRY = "CASE " + " ".join(f"WHEN contains(lower(location), '{a}') THEN '{c}'" for a, c in C.COUNTRY_ALIASES) + " END"
COUNTRIES = f""", prefixes(prefix, country) AS (VALUES {", ".join(f"('{''.join(ch for ch in p if ch.isdigit())}', '{c}')" for p, c in C.PHONE_PREFIXES)}),
ph AS (SELECT DISTINCT phone, CASE WHEN regexp_matches(phone, '^[6-9][0-9]{{9}}$') THEN '91' || phone ELSE regexp_replace(phone, '[^0-9]', '', 'g') END AS d FROM claims WHERE phone IS NOT NULL),
pc AS (SELECT phone, max_by(country, length(prefix)) AS country FROM ph JOIN prefixes ON prefix <> '' AND starts_with(d, prefix) GROUP BY phone)"""
CHECK = f""", j AS (
  SELECT c.claim_id, c.company, c.location, c.role, c.phone, b.pos IS NOT NULL AS found, t.name AS typo, {WORK_COUNTRY.replace('location', 'c.location')} AS wc, pc.country AS pcn, r.*,
         lower(regexp_replace(c.location, '[^A-Za-z]+', ' ', 'g')) AS loc
  FROM claims c LEFT JOIN best b ON b.key = c.key LEFT JOIN typo t ON t.key = c.key LEFT JOIN pc ON pc.phone = c.phone LEFT JOIN registry r ON r.pos = b.pos),
f AS (
  SELECT *, found AND black AS x_black, found AND location IS NOT NULL AND NOT contains(loc, city) AND NOT contains(city, loc) AND state <> '' AND NOT contains(loc, state) AS x_place,
         found AND role IS NOT NULL AND NOT (lower(role) = 'driver' OR contains(category, lower(role)) OR contains(lower(role), category)) AS x_role,
         found AND wc IS NOT NULL AND NOT list_contains(countries, lower(wc)) AS x_country, phone IS NOT NULL AND wc IS NOT NULL AND pcn IS NOT NULL AND pcn <> wc AS x_phone FROM j),
checked AS (
  SELECT claim_id, company,
    CAST(CAST(NOT found AS INT) + CAST(typo IS NOT NULL AS INT) + 2 * CAST(x_black AS INT) + CAST(x_place AS INT) + CAST(x_role AS INT) + CAST(x_country AS INT) + CAST(x_phone AS INT) AS BIGINT) AS db_contradictions,
    CAST(2 + CAST(found AS INT) + CAST(found AND location IS NOT NULL AS INT) + CAST(found AND role IS NOT NULL AS INT) + CAST(found AND wc IS NOT NULL AS INT) + CAST(phone IS NOT NULL AND wc IS NOT NULL AS INT) AS BIGINT) AS db_checks_run,
    list_filter([CASE WHEN NOT found THEN 'Company not registered in known agency registry.' END, CASE WHEN typo IS NOT NULL THEN 'Company name looks like impersonation of ''' || typo || '''.' END,
      CASE WHEN x_black THEN 'Company is marked as blacklisted in registry.' END, CASE WHEN x_place THEN 'Claimed location ''' || location || ''' does not match registered location.' END,
      CASE WHEN x_role THEN 'Role ''' || role || ''' not listed in company''s allowed job categories.' END, CASE WHEN x_country THEN 'Company has no placement registration for ' || wc || '.' END,
      CASE WHEN x_phone THEN 'Phone country ''' || pcn || ''' conflicts with claimed work location ''' || wc || '''.' END], lambda x: x IS NOT NULL) AS contradiction_details,
    found AS company_found_in_registry, coalesce(x_black, FALSE) AS company_is_blacklisted, typo IS NOT NULL AS typosquatting_suspected, typo AS typosquatting_target, wc AS work_country, pcn AS phone_country FROM f)"""

CENTROIDS = """items AS (SELECT CASE WHEN label <= 4 THEN 'legitimate' ELSE 'scam' END AS cluster, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT cluster, pos, avg(CAST(x AS DOUBLE)) AS x FROM items GROUP BY 1, 2),
packed AS (SELECT cluster, list(x ORDER BY pos) AS mean, sqrt(sum(x * x)) AS norm FROM means GROUP BY cluster),
counts AS (SELECT CASE WHEN label <= 4 THEN 'legitimate' ELSE 'scam' END AS cluster, count(*) AS sample_count FROM embeddings GROUP BY 1),
centroids AS (SELECT p.cluster, c.sample_count, list_transform(mean, lambda m: m / norm) AS centroid FROM packed p JOIN counts c ON p.cluster = c.cluster)"""
POSTINGS = r"""posts AS (SELECT doc_id, text, CASE WHEN label <= 4 THEN 'legitimate' WHEN label > 4 THEN 'scam' WHEN doc_id % 2 = 0 THEN 'legitimate' ELSE 'scam' END AS cluster, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
worded AS (SELECT doc_id, cluster, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM posts WHERE embedding IS NULL),
grams AS (SELECT doc_id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM worded),
slots AS (SELECT doc_id, CAST('0x' || substr(md5(g), 1, 7) AS BIGINT) % 64 AS slot, count(*) AS n FROM grams GROUP BY 1, 2),
lengths AS (SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM slots GROUP BY 1),
encoded AS (SELECT l.doc_id, list(coalesce(s.n, 0) / norm ORDER BY i) AS vector FROM lengths l CROSS JOIN range(64) r(i) LEFT JOIN slots s ON s.doc_id = l.doc_id AND s.slot = i GROUP BY l.doc_id)"""
POSTING_CENTROIDS = """, full_rows AS (SELECT p.cluster, coalesce(p.embedding, CAST(e.vector AS FLOAT[])) AS v FROM posts p LEFT JOIN encoded e ON p.embedding IS NULL AND p.doc_id = e.doc_id),
parts AS (SELECT cluster, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM full_rows WHERE v IS NOT NULL), means AS (SELECT cluster, pos, avg(CAST(x AS DOUBLE)) AS x FROM parts GROUP BY 1, 2),
packed AS (SELECT cluster, list(x ORDER BY pos) AS mean, sqrt(sum(x * x)) AS norm FROM means GROUP BY cluster), counts AS (SELECT cluster, count(*) AS sample_count FROM full_rows WHERE v IS NOT NULL GROUP BY 1)
SELECT cluster, sample_count, list_transform(mean, lambda m: round(m / norm, 4)) AS centroid FROM packed JOIN counts USING (cluster)"""
EMBEDDING_SCORE = """, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (SELECT centroid FROM centroids WHERE cluster = 'legitimate') AS l, (SELECT centroid FROM centroids WHERE cluster = 'scam') AS s FROM embeddings),
sims AS (SELECT vec_id, list_cosine_similarity(e, l) AS l, list_cosine_similarity(e, s) AS s FROM v)
SELECT vec_id, round(l, 4) AS sim_to_legitimate, round(s, 4) AS sim_to_scam, round(abs(s - l), 4) AS boundary_distance, round(greatest(0, least(1, (s - l + 1) / 2)), 4) AS embedding_score, 'ok' AS status FROM sims"""

RAW = r"""made AS (SELECT doc_id AS msg_id, doc_id AS n, n_chars, '{"verdict": "' || CASE doc_id % 7 WHEN 0 THEN 'HIGH_RISK' WHEN 1 THEN 'safe' WHEN 2 THEN 'scam' WHEN 3 THEN 'medium' WHEN 4 THEN 'SUSPICIOUS' WHEN 5 THEN 'odd' ELSE '' END
    || '", "confidence": ' || CASE doc_id % 5 WHEN 0 THEN '"abc"' WHEN 1 THEN '150' WHEN 2 THEN '-5' ELSE CAST(n_chars % 100 AS VARCHAR) END || ', "reasoning": "text of ' || n_chars || ' signs", "key_contradiction": '
    || CASE doc_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"NULL"' ELSE '"salary of ' || n_chars || '"' END || '}' AS answer FROM documents),
raw AS (SELECT msg_id, n, n_chars, trim(CASE n % 11 WHEN 0 THEN NULL WHEN 1 THEN 'no answer' WHEN 2 THEN 'Here:' || chr(10) || '```json' || chr(10) || answer || chr(10) || '```' || chr(10) || 'Done.' WHEN 3 THEN 'I think ' || answer || ' is right.'
    WHEN 4 THEN answer || ' trailing {x}' WHEN 5 THEN answer || ' or ' || answer WHEN 6 THEN '```json' || chr(10) || '{broken}' || chr(10) || '```' || chr(10) || answer ELSE answer END) AS llm_raw FROM made),
picked AS (SELECT *, CASE WHEN json_valid(llm_raw) AND llm_raw LIKE '{%' THEN llm_raw ELSE coalesce(nullif(regexp_extract(llm_raw, '(?is)```(?:json)?\s*(\{.*?\})\s*```', 1), ''), regexp_extract(llm_raw, '(?s)(\{.*\})', 1)) END AS candidate FROM raw),
parsed AS (SELECT msg_id, llm_raw, CASE WHEN json_valid(candidate) THEN candidate END AS j, CASE WHEN json_valid(candidate) THEN json_extract_string(candidate, '$.verdict') END AS word FROM picked)"""
VERDICTS = """, v0 AS (SELECT *, CASE WHEN j IS NULL THEN 'SUSPICIOUS' WHEN word IN ('HIGH_RISK', 'scam') THEN 'HIGH_RISK' WHEN word = 'safe' THEN 'SAFE' ELSE 'SUSPICIOUS' END AS verdict,
    CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.confidence') END AS told, CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.reasoning') END AS why, CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.key_contradiction') END AS against FROM parsed),
verdicts AS (SELECT msg_id, verdict,
  CAST(CASE WHEN j IS NULL THEN 55 ELSE greatest(0, least(100, coalesce(trunc(TRY_CAST(told AS DOUBLE)), 60))) END AS BIGINT) AS confidence,
  CASE WHEN llm_raw IS NULL THEN 'AI investigator unavailable (no answer).' WHEN j IS NULL THEN 'AI investigator unavailable (answer is not valid JSON).' ELSE why END AS reasoning,
  CASE WHEN lower(against) <> 'null' THEN against END AS key_contradiction,
  CASE WHEN j IS NULL THEN 'System busy hai, verification ke bina payment na karein.' WHEN verdict = 'HIGH_RISK' THEN 'Yeh offer high risk lag raha hai, paise mat bhejiye.' WHEN verdict = 'SUSPICIOUS' THEN 'Is offer ko verify kiye bina koi payment mat kijiye.' ELSE 'Offer filhal theek lagta hai, fir bhi details verify kar lijiye.' END AS hindi_worker_message,
  CASE verdict WHEN 'SAFE' THEN 0.12::DOUBLE WHEN 'HIGH_RISK' THEN 0.92::DOUBLE ELSE 0.52::DOUBLE END AS risk_score FROM v0)"""

_FILLED = "lambda x: x IS NOT NULL AND trim(x) <> ''"
_SIGNALS = """list_filter([CASE WHEN forwarded_flag THEN 'whatsapp_forwarded_many_times' END, CASE WHEN seen_count >= 3 THEN 'seen_in_3_or_more_messages' END, CASE WHEN seen_count >= 10 THEN 'high_repeat_volume' END,
    CASE WHEN source_channels_count >= 2 THEN 'cross_channel_spread' END, CASE WHEN text_length < 180 THEN 'short_broadcast_style_message' END], lambda x: x IS NOT NULL)"""
_RUNNING = HISTORY.rsplit("\nSELECT ", 1)[0]
LAYERS = f"""{_RUNNING.removeprefix(", ")}, scores AS ({EMBEDDING_SCORE.removeprefix(", ").replace("v AS (SELECT", "WITH v AS (SELECT", 1)}),
layers AS (SELECT w.msg_id, w.channel AS source_channel, w.ts, seen_count, source_channels_count, forwarded_flag, {_score('forwarded_flag', 'seen_count', 'source_channels_count', 'text_length')} AS propagation_score, {_SIGNALS} AS signals,
  k.contradiction_details, k.db_contradictions AS contradictions, k.db_checks_run AS checks, s.embedding_score, s.sim_to_legitimate, s.sim_to_scam, s.boundary_distance
  FROM w LEFT JOIN checked k ON k.claim_id = w.msg_id LEFT JOIN scores s ON s.vec_id = w.msg_id)"""
RESULTS = f""", r0 AS (SELECT l.*, v.verdict, v.reasoning, v.key_contradiction, v.hindi_worker_message, coalesce(nullif(v.risk_score, 0), {C.DEFAULT_SCORE}::DOUBLE) AS score, CAST(coalesce(nullif(v.confidence, 0), {C.FAILED_CONFIDENCE}) AS BIGINT) AS confidence,
  list_filter([trim(v.reasoning), v.key_contradiction], {_FILLED}) AS head FROM layers l LEFT JOIN verdicts v USING (msg_id)),
r1 AS (SELECT *, list_concat(head, list_transform(list_filter(coalesce(contradiction_details, []), {_FILLED}), lambda x: trim(x))[1:greatest(1, 4 - len(head))]) AS taken FROM r0),
r2 AS (SELECT *, list_concat(taken, list_transform(signals, lambda x: replace(x, '_', ' '))[1:greatest(1, 5 - len(taken))]) AS told FROM r1),
r3 AS (SELECT *, list_filter(told, lambda x, i: list_position(list_transform(told, lambda y: lower(y)), lower(x)) = i)[1:5] AS once FROM r2),
results AS (SELECT msg_id, round(score, 2) AS risk_score, CASE WHEN score < {C.LEVEL_LOW_BELOW} THEN 'LOW' WHEN score <= {C.LEVEL_HIGH_ABOVE} THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level, score >= {C.SCAM_FROM} AS is_scam, coalesce(verdict, 'SUSPICIOUS') AS verdict,
  confidence, CASE WHEN len(once) > 0 THEN once ELSE ['No major contradiction identified.'] END AS reasons, key_contradiction, hindi_worker_message, coalesce(trim(reasoning), '') AS english_summary, embedding_score AS layer_embedding,
  contradictions AS layer_contradictions, propagation_score AS layer_propagation, confidence AS layer_confidence, source_channel AS source FROM r3)"""


def with_results(rest: str, entities: bool = False) -> str:
    """All layers and verdicts of the messages, then ``rest``."""
    parts = [ENTITIES if entities else MESSAGES, CLAIMS + FUZZY + COUNTRIES + CHECK, CENTROIDS, LAYERS, RAW + VERDICTS + RESULTS]
    return "WITH " + ", ".join(x.strip().removeprefix(",") for x in parts) + rest


_PERCENT = score_to_int("risk_score")
REPORT_ROWS = f""" SELECT r.msg_id, nullif(trim(e.phones[1]), '') AS scam_phone, nullif(trim(e.upi_ids[1]), '') AS upi_id, nullif(trim(e.company), '') AS company_name, nullif(trim(e.role), '') AS job_role, nullif(trim(e.location), '') AS location,
  e.salary, e.fee, {_PERCENT} AS risk_score, 0.0::DOUBLE AS trust_weight, e.ts AS report_time, r.source FROM results r JOIN ent e USING (msg_id) WHERE r.risk_score > {C.STORE_ABOVE}"""


def _told(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


def _flag(x: str) -> str:
    return f"CASE WHEN {x} THEN 'True' WHEN NOT {x} THEN 'False' ELSE 'None' END"


def _quoted(x: str) -> str:
    return f"CASE WHEN len({x}) > 0 THEN '[''' || array_to_string({x}, ''', ''') || ''']' ELSE 'N/A' END"


def _na(x: str, none: str) -> str:
    return f"coalesce(CAST(nullif({x}, {none}) AS VARCHAR), 'N/A')"


_EVIDENCE = (
    ("=== MESSAGE ===", None), ("", r"regexp_replace(coalesce(m.text, ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"), ("", None),
    ("=== EXTRACTED ENTITIES ===", None), ("Company: ", _na("company", "''")), ("Phones: ", _quoted("phones")), ("Salary claimed: ", _na("salary", "0")), ("Fee requested: ", _na("fee", "0")), ("Claimed location: ", _na("location", "''")),
    ("Job role: ", _na("role", "''")), ("UPI IDs: ", _quoted("upi_ids")), ("Urgency phrases: ", _quoted("urgency_flags")), ("", None),
    ("=== LAYER 1 - EMBEDDING SIMILARITY ===", None), ("Similarity to legitimate cluster: ", _told("sim_to_legitimate")), ("Similarity to scam cluster: ", _told("sim_to_scam")), ("Boundary distance: ", _told("boundary_distance")),
    ("Embedding scam score: ", _told("embedding_score")), ("", None),
    ("=== LAYER 2 - CROSS-REFERENCE CONSISTENCY ===", None), ("Total contradictions: ", _told("contradictions")), ("Checks run: ", _told("checks")), ("DB details: ", _quoted("contradiction_details")), ("", None),
    ("=== LAYER 3 - PROPAGATION ANALYSIS ===", None), ("Seen count: ", _told("seen_count")), ("Source channels: ", _told("source_channels_count")), ("Forwarded many times: ", _flag("forwarded_flag")), ("Broadcast score: ", _told("propagation_score")),
    ("Broadcast pattern: ", _flag(f"(propagation_score >= {C.BROADCAST_FROM})")),
)
EVIDENCE = (
    " SELECT e.msg_id, " + " || chr(10) || ".join(f"'{name}'" + (f" || {x}" if x else "") for name, x in _EVIDENCE)
    + " || CASE WHEN e.msg_id % 9 = 0 THEN chr(10) || chr(10) || '=== MEDIA CONTEXT ===' || chr(10) || 'kind: image' || chr(10) || 'pages: ' || n.n_chars ELSE '' END AS evidence"
    + " FROM ent e JOIN layers l USING (msg_id) JOIN messages m USING (msg_id) JOIN raw n USING (msg_id)"
)


def _translation(words: dict[str, str]) -> str:
    cases = " ".join("WHEN '{}' THEN '{}'".format(*(x.replace("'", "''") for x in pair)) for pair in words.items())
    return f"lambda r: '* ' || CASE lower(trim(r)) {cases} ELSE trim(r) END"


def _pick(words) -> str:
    a, b, c = (w.replace("'", "''") for w in words)
    return f"CASE WHEN percent >= {C.REPLY_DANGER} THEN '{a}' WHEN percent >= {C.REPLY_SUSPICIOUS} THEN '{b}' ELSE '{c}' END"


def _reply(words: dict, each: str) -> str:
    lines = (
        f"'*{words['title']}*'", "repeat('-', 31)", f"'{words['verdict']}: ' || {_pick(words['verdicts'])}", f"'{words['score']}: ' || percent || '%'", "''", f"'{words['why']}:'",
        f"CASE WHEN len(reasons) > 0 THEN array_to_string(list_transform(reasons[1:3], {each}), chr(10)) ELSE '* {words['none']}' END",
        "''", f"'{words['advice']}: ' || {_pick(words['advices'])}", "''", f"'{words['switch']}'", f"'{words['foot']}'",
    )
    return " || chr(10) || ".join(lines)


REPLY_TABLE = f""", p AS (SELECT r.msg_id, r.reasons, {_PERCENT} AS percent, CASE WHEN j.msg_id % 10 IN (0, 1) THEN 'hi' WHEN j.msg_id % 10 = 2 THEN 'en' ELSE {LANGUAGE} END AS language FROM results r JOIN job_messages j USING (msg_id))
SELECT msg_id, language, percent, CASE WHEN language = 'hi' THEN {_reply(C.REPLY_HI, _translation(C.REASONS_HI))} ELSE {_reply(C.REPLY_EN, "lambda r: '* ' || trim(r)")} END AS reply FROM p"""
REPLY_TEXT = f""", p AS (SELECT *, {_PERCENT} AS percent FROM results)
SELECT msg_id, CASE WHEN risk_level = 'HIGH' OR percent > {C.HEADLINE_HIGH_ABOVE} THEN 'KHATRA!' WHEN risk_level = 'MEDIUM' OR percent >= {C.HEADLINE_MEDIUM} THEN 'SAAVDHAN!' ELSE 'SURAKSHIT' END || chr(10) || chr(10)
  || CASE WHEN percent >= 30 THEN 'Yeh naukri sandesh farzi ho sakta hai.' ELSE 'Yeh naukri sandesh filhal kam jokhim wala lagta hai.' END || chr(10) || chr(10) || 'Risk: ' || percent || '%' || chr(10) || chr(10)
  || 'Karan:' || chr(10) || array_to_string(list_transform(reasons, {_translation(C.REASONS_ROMAN)}), chr(10)) || chr(10) || chr(10)
  || CASE WHEN percent >= 60 THEN 'Paise mat bhejein.' WHEN percent >= 30 THEN 'Pehle company aur offer verify karein.' ELSE 'Phir bhi documents aur company details verify karein.' END AS reply FROM p"""

_OCR_WORDS = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
w0 AS (SELECT doc_id, line, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) - 1 AS pos FROM ln),
w AS (SELECT doc_id, line // 3 AS block, line, pos, word, (length(word) * 17 + pos * 7 + doc_id) % 103 - 2 AS conf FROM w0)"""
OCR_LINES = f"""WITH {_OCR_WORDS},
l AS (SELECT doc_id, block, line, string_agg(trim(word), ' ' ORDER BY pos) AS t FROM w WHERE conf >= 0 AND trim(word) <> '' GROUP BY 1, 2, 3),
m AS (SELECT *, lag(block) OVER (PARTITION BY doc_id ORDER BY block, line) AS before FROM l)
SELECT doc_id, string_agg(CASE WHEN before <> block THEN chr(10) || t ELSE t END, chr(10) ORDER BY block, line) AS text FROM m GROUP BY doc_id"""
OCR_BEST = f"""WITH {_OCR_WORDS},
p AS (SELECT doc_id, CAST((pos + line) % 4 + 1 AS INT) AS rank, avg(conf - CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END) AS mean FROM w WHERE trim(word) <> '' AND conf - CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END > 0 GROUP BY 1, 2),
s AS (SELECT *, min(CASE WHEN mean >= 50 THEN rank END) OVER (PARTITION BY doc_id) AS stop FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mean DESC, rank) AS n FROM s WHERE stop IS NULL OR rank <= stop)
SELECT doc_id, CAST(([6, 11, 3, 4])[rank] AS BIGINT) AS pass, round(mean, 4) AS confidence FROM b WHERE n = 1"""
TWO_COLUMN = """WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n FROM documents),
pairs AS (SELECT doc_id, i, trim(t) AS t, lag(trim(t)) OVER (PARTITION BY doc_id ORDER BY i) AS before, n FROM ln),
kept AS (SELECT * FROM pairs WHERE t <> '' AND NOT (i % 2 = 1 AND t = before)),
joined AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) AS m FROM kept GROUP BY doc_id),
sides AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) FILTER (WHERE i % 2 = 0) AS l, string_agg(t, chr(10) ORDER BY i) FILTER (WHERE i % 2 = 1) AS r FROM ln GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN coalesce(l, '') <> '' AND coalesce(r, '') <> '' THEN coalesce(m, '') ELSE coalesce(nullif(l, ''), r, '') END AS text FROM sides s LEFT JOIN joined j ON s.doc_id = j.doc_id"""
TRANSCRIPTS = f"""tr AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text, avg(-(length(text) % 40) / 100.0::DOUBLE) AS confidence, max((turn + 1) * 1.5::DOUBLE) AS duration_seconds, count(*) AS n FROM conversations GROUP BY 1),
stats AS (SELECT doc_id, round(confidence, 6) AS confidence, duration_seconds, CASE doc_id % 4 WHEN 0 THEN 'Hindi' WHEN 1 THEN 'English' WHEN 2 THEN 'XX' ELSE 'Unknown' END AS language_name,
  len(list_filter({_list(C.TRANSCRIPT_URGENCY)}, lambda x: contains(lower(text), x))) > 0 AS urgency_detected FROM tr)"""
_SUFFIX = r"(?:pvt\.?\s*ltd\.?|private\s+limited|ltd\.?|limited|inc\.?|llp|enterprises?|solutions?|services?|consultanc(?:y|ies)|agenc(?:y|ies)|recruitment|international|intl\.?|overseas|manpower|technologies|tech\.?|group|corp\.?|corporation)"
LETTERS = rf"""letters AS (SELECT doc_id, CASE doc_id % 5 {' '.join(f"WHEN {i} THEN '{A.LETTERS[i]}'" for i in range(4))} ELSE '' END || text AS text FROM documents),
fields AS (SELECT doc_id, trim(regexp_replace(nullif(regexp_extract(text, '(?i)([a-z][a-z0-9 \t\n\r&.\-]{{2,45}}?)\s*{_SUFFIX}', 1), ''), '\s+', ' ', 'g')) AS company,
  nullif(regexp_extract(text, '\b(\d{{2}}[A-Z]{{5}}\d{{4}}[A-Z][1-9A-Z]Z[0-9A-Z])\b', 1), '') AS gst, nullif(regexp_extract(text, '\b([LU]\d{{5}}[A-Z]{{2}}\d{{4}}(?:PLC|PTC|OPC|NPL|GAP|GOI)\d{{6}})\b', 1), '') AS cin,
  regexp_matches(text, '(?i)(?:registration|medical|processing|security|visa|advance|joining)\s*(?:fee|fees|charge|deposit)') AS asks_fee, regexp_matches(text, '(?i)\b(?:urgent|immediately|asap|today only|limited time|act now)\b') AS urgent FROM letters)"""
BRANDS = f""", hits AS (SELECT doc_id, list_filter(list_transform({_list(C.BRANDS)}, lambda b: {{'b': b, 'd': levenshtein(lower(trim(company)), lower(b))}}), lambda x: x.d BETWEEN 1 AND 3) AS h FROM fields),
brands AS (SELECT doc_id, h[1].b AS similar_to, h[1].d AS distance FROM hits)"""
FORGERY = """, tests AS (SELECT f.*, b.similar_to FROM fields f JOIN brands b ON f.doc_id = b.doc_id),
s AS (SELECT doc_id, CAST(least(100, CASE WHEN company IS NULL THEN 25 ELSE 0 END + CASE WHEN gst IS NULL THEN 20 ELSE 0 END + CASE WHEN similar_to IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN asks_fee THEN 40 ELSE 0 END + CASE WHEN urgent THEN 15 ELSE 0 END) AS BIGINT) AS score,
  list_slice(list_filter([CASE WHEN company IS NULL THEN 'No company name found in document' END, CASE WHEN gst IS NULL THEN 'No GST number found' END, CASE WHEN similar_to IS NOT NULL THEN 'Company name resembles a known brand (possible impersonation)' END,
    CASE WHEN asks_fee THEN 'Document asks for upfront fee' END, CASE WHEN urgent THEN 'Urgency language is unusual for formal offer documents' END], lambda x: x IS NOT NULL), 1, 3) AS reasons FROM tests),
forgery AS (SELECT doc_id, score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS risk, reasons FROM s)"""
MEDIA = """SELECT '/in/' || CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.ogg' WHEN 2 THEN '.png' ELSE '.txt' END AS path, n_chars * 4096 AS length,
  CASE doc_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'audio' WHEN 2 THEN 'image' END AS kind, CASE WHEN doc_id % 4 = 0 THEN 'pdf' WHEN doc_id % 8 = 1 THEN 'docx' END AS format,
  coalesce(n_chars * 4096 <= CASE doc_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 10 WHEN 2 THEN 15 END * 1048576, FALSE) AS accepted FROM documents"""
