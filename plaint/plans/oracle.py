"""DuckDB twins of the registered queries (the independent correctness check).

The SQL is generated from the same fixed data (lexicon, domains, templates) by code
that shares nothing with the Spark expression builders, so a bug in one shows up as a
mismatch.  DuckDB's RE2 has no look-around: whole-word tests consume the boundary
character instead, which is equivalent for presence tests.
"""

from __future__ import annotations

from plaint import domains as D
from plaint.operators.evaluate import prompt_char_model
from plaint.sources import fixtures as FX

W = r"[^\p{L}\p{N}_]"           # a non-word character (Python's \W, Unicode)
COMPANY = D.DEFAULT_COMPANY


def lit(s: str) -> str:
    """SQL string literal; newlines become chr(10) so the SQL text stays one-line-safe."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) if len(parts) > 1 \
        else "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


WS = " || ".join(f"chr({ord(c)})" for c in D.WHITESPACE)
WS_RE = "[" + "".join(f"\\x{{{ord(c):04x}}}" for c in D.WHITESPACE) + "]"


def ustrip(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str) -> str:
    return f"regexp_replace({ustrip(x)}, '[ \\t]+', ' ', 'g')"


CARD_RE = (r"\b(?:(?:\d{4}[ -]){3}\d{0,3}(\d{4})|(?:\d{4}[ -]){2}\d(\d{3})[ -](\d)"
           r"|(?:\d{4}[ -]){2}\d{2}(\d{2})[ -](\d{2})|(?:\d{4}[ -]){2}\d{3}(\d)[ -](\d{3})|\d{9,15}(\d{4}))\b")


def mask(x: str) -> str:
    return f"regexp_replace({x}, '{CARD_RE}', 'XXXX-XXXX-XXXX-\\1\\2\\3\\4\\5\\6\\7\\8', 'g')"


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{WS_RE}+'), lambda s: s <> ''))"


def preview(x: str, n: int = 70) -> str:
    return f"(substring({x}, 1, {n}) || CASE WHEN length({x}) > {n} THEN '...' ELSE '' END)"


def error_code(raw: str, c0: str) -> str:
    return (f"CASE WHEN {raw} IS NULL OR {c0} = '' THEN 'empty' WHEN length({c0}) < {D.MIN_LENGTH} THEN 'too_short' "
            f"WHEN length({c0}) > {D.MAX_LENGTH} THEN 'too_long' WHEN {letters(c0)} < {D.MIN_LETTERS} "
            f"THEN 'no_words' END")


def error_msg(code: str, c0: str) -> str:
    return (f"CASE {code} WHEN 'empty' THEN {lit(D.MSG_EMPTY)} WHEN 'too_short' THEN {lit(D.MSG_SHORT)} "
            f"WHEN 'too_long' THEN {lit(D.MSG_LONG_HEAD)} || CAST(length({c0}) AS VARCHAR) || {lit(D.MSG_LONG_TAIL)} "
            f"ELSE '' END")


# --------------------------------------------------------------------------- rules
def hit(lt: str, kw: str, whole: bool) -> str:
    if whole:
        return f"regexp_matches({lt}, '(^|{W}){kw}($|{W})')"
    return f"contains({lt}, {lit(kw)})"


def score(lt: str, cat: str) -> str:
    weight, kws = next((w, k) for c, w, k in D.CATEGORY_KEYWORDS if c == cat)
    terms = " + ".join(f"CAST({hit(lt, kw, len(kw) <= 4 and kw.isalpha())} AS INTEGER)" for kw in kws)
    return f"({dbl(weight)} * ({terms}))"


def category(lt: str) -> str:
    s = {c: score(lt, c) for c in D.CATEGORIES}
    f, lo, b, a = s["fraud"], s["loan"], s["billing"], s["app_issue"]
    return (f"CASE WHEN greatest({f}, {lo}, {b}, {a}) = 0 THEN 'app_issue' "
            f"WHEN {f} >= greatest({lo}, {b}, {a}) THEN 'fraud' WHEN {lo} >= greatest({b}, {a}) THEN 'loan' "
            f"WHEN {b} >= {a} THEN 'billing' ELSE 'app_issue' END")


AMOUNT_RE = "(?i)" + D.AMOUNT_PATTERN


def amount(t: str) -> str:
    p = lit(AMOUNT_RE)
    return (f"coalesce(list_max(list_transform(list_zip(regexp_extract_all({t}, {p}, 1), "
            f"regexp_extract_all({t}, {p}, 2)), lambda z: try_cast(replace(concat(z[1], z[2]), ',', '') AS DOUBLE))), "
            f"{dbl(0.0)})")


def any_cue(lt: str, cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains({lt}, {lit(c)})" for c in cues) + ")"


def priority(cat: str, lt: str, amt: str) -> str:
    return (f"CASE WHEN {cat} = 'fraud' OR {any_cue(lt, D.HIGH_PRIORITY_CUES)} OR {amt} >= {D.HIGH_AMOUNT} "
            f"THEN 'high' WHEN {cat} IN ('billing', 'loan') OR {amt} >= {D.MEDIUM_AMOUNT} THEN 'medium' "
            f"ELSE 'low' END")


def sentiment(lt: str) -> str:
    return (f"CASE WHEN {any_cue(lt, D.ANGRY_CUES)} THEN 'angry' WHEN {any_cue(lt, D.FRUSTRATED_CUES)} "
            f"THEN 'frustrated' WHEN {any_cue(lt, D.POSITIVE_CUES)} THEN 'positive' ELSE 'neutral' END")


def response(cat: str, sen: str, company: str = COMPANY) -> str:
    topics = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in D.TOPICS.items())
    return (f"({lit('Dear Customer,' + chr(10) + chr(10))} || CASE WHEN {sen} IN ('angry', 'frustrated') "
            f"THEN {lit(D.APOLOGY)} ELSE '' END || "
            f"{lit(f'Thank you for contacting {company}. We have received your complaint regarding ')} || "
            f"CASE {cat} {topics} ELSE {lit(D.TOPIC_UNKNOWN)} END || '. ' || "
            f"CASE WHEN {cat} = 'fraud' THEN {lit(D.FRAUD_TEAM_LINE)} ELSE {lit(D.SUPPORT_TEAM_LINE)} END || "
            f"{lit(' ' + D.RESPONSE_CLOSING + chr(10) + chr(10) + 'Regards,' + chr(10) + company)})")


def normalize(raw: str, allowed: list[str]) -> str:
    tok = f"replace(regexp_replace(lower({ustrip(raw)}), '[^a-z_ ]', '', 'g'), ' ', '_')"
    inlist = ", ".join(lit(a) for a in allowed)
    contains = " ".join(f"WHEN contains({tok}, {lit(a)}) THEN {lit(a)}" for a in allowed)
    return f"CASE WHEN {tok} IN ({inlist}) THEN {tok} {contains} END"


def signature(resp: str, company: str = COMPANY) -> str:
    return (f"CASE WHEN contains(lower({resp}), {lit(company.lower())}) THEN {resp} "
            f"ELSE {resp} || {lit(chr(10) + chr(10) + 'Regards,' + chr(10) + company)} END")


def label_of(code: str, domain: str) -> str:
    whens = " ".join(f"WHEN {lit(c)} THEN {lit(lbl)}" for d, _, c, lbl in D.domain_rows() if d == domain)
    return f"coalesce(CASE {code} {whens} END, {code})"


def pct(x: str) -> str:
    return f"(CAST(CAST(round_even({x} * 100, 0) AS BIGINT) AS VARCHAR) || '%')"


# ------------------------------------------------------------------------ CTE chain
AS_OF = FX.AS_OF_SQL


def _values(rows, cols) -> str:
    def v(x):
        if isinstance(x, str):
            return lit(x)
        if isinstance(x, float):
            return dbl(x)
        return str(x)
    body = ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


def status_sql(age: str, k: str) -> str:
    return (f"CASE WHEN {age} > 10 THEN CASE WHEN {k} < 16 THEN 'Closed' WHEN {k} < 19 THEN 'In Progress' ELSE 'Open' END "
            f"WHEN {age} > 3 THEN CASE WHEN {k} < 9 THEN 'Closed' WHEN {k} < 16 THEN 'In Progress' ELSE 'Open' END "
            f"ELSE CASE WHEN {k} < 2 THEN 'Closed' WHEN {k} < 8 THEN 'In Progress' ELSE 'Open' END END")


def age_days(ts: str) -> str:
    return f"CAST(floor(date_diff('second', {ts}, {AS_OF}) / 86400.0) AS BIGINT)"


def quality_sql(resp: str, gold_cat: str, company: str = COMPANY) -> dict[str, str]:
    low = f"lower({resp})"
    promise = D.PROMISE_PATTERN[2:-2]
    nw = r"[^\p{L}\p{N}_.\n]"
    secret = (f"(?i)(^|{W})(share|send|provide|enter|confirm|give)({nw}|{nw}[^.\\n]{{0,38}}{nw})"
              f"(otp|pin|password|cvv|card number)($|{W})")
    return {
        "length_50_60": f"({words(resp)} BETWEEN 50 AND 60)",
        "investigation": f"contains({low}, 'investigat')",
        "support_team": f"(contains({low}, 'support team') OR (contains({low}, 'support') AND contains({low}, 'team')))",
        "no_promise": f"(NOT regexp_matches({resp}, {lit('(?i)(^|' + W + ')' + promise + '($|' + W + ')')}))",
        "signature": f"contains(right(lower({ustrip(resp)}), {len(company) + 20}), {lit(company.lower())})",
        "safe": (f"(NOT regexp_matches({resp}, {lit(secret)}) AND NOT regexp_matches("
                 f"regexp_replace({resp}, '[ -]', '', 'g'), '\\d{{13,19}}'))"),
        "fraud_team": f"CASE WHEN {gold_cat} = 'fraud' THEN contains({low}, 'fraud') END",
    }


def estimate_sql(text: str, cat: str, pri: str, sen: str, raw_resp: str, company: str = COMPANY) -> tuple[str, str]:
    const, counts = prompt_char_model()
    in_chars = (f"({const} + {counts['text']} * length({text}) + {counts['company'] * len(company)} + "
                f"{counts['cat']} * length({cat}) + {counts['priority']} * length({pri}) + "
                f"{counts['sentiment']} * length({sen}))")
    out_chars = f"(length({cat}) + length({pri}) + length({sen}) + length({raw_resp}))"
    return (f"CAST(round_even({in_chars} / 4.0, 0) AS BIGINT)", f"CAST(round_even({out_chars} / 4.0, 0) AS BIGINT)")


def ctes() -> str:
    templates = _values(FX.TEMPLATES, ["tid", "txt", "g_category", "g_priority", "g_sentiment"])
    replies = _values(FX.REPLIES, ["reply_id", "raw_response"])
    providers = " UNION ALL ".join(
        f"SELECT {lit(p)} AS provider, {m} AS m, {k} AS k, {dbl(b)} AS base, {i * 3} AS shift"
        for i, (p, m, k, b) in enumerate(FX.PROVIDERS))
    lt = "lower(complaint)"
    c0 = "c0"
    q = {cn: x for cn, x in quality_sql("response", "g_category").items()}
    est_in, est_out = estimate_sql("text", "category", "priority", "sentiment", "raw_response")
    rlt = "lower(text)"
    err_tail = lit(FX.ERROR_TEXT)
    return f"""
templates AS {templates},
replies AS {replies},
providers AS ({providers}),
complaints_raw AS (
  SELECT e.event_id AS source_id, e.ts, t.tid,
    CASE WHEN e.user_id % 11 = 0 THEN '' ELSE '  User ' || CAST(e.user_id AS VARCHAR) || ' ' END AS customer_name,
    CASE e.event_id % 50 WHEN 0 THEN 'help' WHEN 1 THEN NULL WHEN 2 THEN '1234567890 99'
      WHEN 3 THEN repeat('too long ', 120) WHEN 4 THEN '   '
      ELSE '  ' || t.txt || CASE e.event_type
        WHEN 'purchase' THEN ' Amount ₹' || CAST(CAST(floor(e.value * 200) AS BIGINT) AS VARCHAR)
        WHEN 'error' THEN '   card 4111 1111 1111 ' || lpad(CAST(e.user_id AS VARCHAR), 4, '0')
        ELSE '' END END AS raw_text
  FROM events e JOIN templates t ON t.tid = (e.event_id * 7 + e.user_id) % 20),
validated AS (
  SELECT *, {error_code('raw_text', c0)} AS error_code
  FROM (SELECT *, {clean('raw_text')} AS c0 FROM complaints_raw)),
accepted AS (
  SELECT source_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS created_at,
    {ustrip('customer_name')} AS customer_name, {mask(c0)} AS complaint
  FROM validated WHERE error_code IS NULL),
triaged0 AS (
  SELECT *, {category(lt)} AS category, {sentiment(lt)} AS sentiment, {amount('complaint')} AS amt FROM accepted),
triaged AS (
  SELECT source_id, created_at, customer_name, complaint, category,
    {priority('category', lt, 'amt')} AS priority, sentiment, {response('category', 'sentiment')} AS response,
    {status_sql(age_days('created_at'), 'source_id % 20')} AS status, 'offline' AS mode
  FROM triaged0),
complaints AS (
  SELECT printf('CMP-%d-%03d', year(created_at),
      row_number() OVER (PARTITION BY year(created_at) ORDER BY created_at, source_id)) AS complaint_id, *
  FROM triaged),
status_changes AS (
  SELECT event_id AS change_id,
    CASE WHEN event_id % 10 = 9 THEN lower(printf('CMP-%d-%03d', 2024, (event_id * 13) % 12000))
      ELSE printf('CMP-%d-%03d', 2024, (event_id * 13) % 12000) END AS complaint_id,
    CAST(date_trunc('second', ts) AS TIMESTAMP) AS changed_at,
    (['Closed', 'In Progress', 'Open', 'Nonsense'])[event_id % 4 + 1] AS new_status
  FROM events WHERE event_type = 'click'),
latest_status AS (
  SELECT complaint_id, arg_max(new_status, (changed_at, change_id)) AS status, max(changed_at) AS changed_at
  FROM status_changes WHERE new_status IN ('Open', 'In Progress', 'Closed') GROUP BY complaint_id),
model_runs_raw AS (
  SELECT r.source_id, p.provider, (r.source_id % p.m) <> 0 AS ok, coalesce(r.raw_text, '') AS text,
    t.g_category, t.g_priority, t.g_sentiment,
    CASE r.source_id % 8 WHEN 0 THEN ' ' || upper(t.g_category) || '. '
      WHEN 1 THEN 'category: ' || t.g_category WHEN 2 THEN replace(t.g_category, '_', ' ')
      WHEN 3 THEN 'not sure' ELSE t.g_category END AS raw_category,
    CASE r.source_id % p.k WHEN 0 THEN 'urgent' WHEN 1 THEN 'High' ELSE t.g_priority END AS raw_priority,
    CASE r.source_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Neutral.' ELSE t.g_sentiment END AS raw_sentiment,
    p.base + (r.source_id % 97) / CAST(50.0 AS DOUBLE) AS latency_s,
    CASE WHEN r.source_id % 17 = 0 THEN 0 ELSE 380 + r.source_id % 40 END AS input_tokens,
    CASE WHEN r.source_id % 17 = 0 THEN 0 ELSE 90 + r.source_id % 25 END AS output_tokens,
    rp.raw_response
  FROM complaints_raw r JOIN templates t ON t.tid = r.tid CROSS JOIN providers p
  JOIN replies rp ON rp.reply_id = (r.source_id + p.shift) % 6),
runs0 AS (
  SELECT *, {normalize('raw_category', D.CATEGORIES)} AS n_cat, {normalize('raw_priority', D.PRIORITIES)} AS n_pri,
    {normalize('raw_sentiment', D.SENTIMENTS)} AS n_sen
  FROM model_runs_raw),
runs1 AS (
  SELECT *, coalesce(n_cat, {category(rlt)}) AS category, coalesce(n_sen, {sentiment(rlt)}) AS sentiment
  FROM runs0),
runs2 AS (
  SELECT *, coalesce(n_pri, {priority('category', rlt, amount('text'))}) AS priority,
    CAST(n_cat IS NULL AS INTEGER) + CAST(n_pri IS NULL AS INTEGER) + CAST(n_sen IS NULL AS INTEGER) AS repairs,
    input_tokens = 0 AND output_tokens = 0 AS est
  FROM runs1),
records AS (
  SELECT provider, source_id AS complaint_id, ok, latency_s, g_category, g_priority, g_sentiment, text,
    CASE WHEN ok THEN category ELSE '' END AS category,
    CASE WHEN ok THEN priority ELSE '' END AS priority,
    CASE WHEN ok THEN sentiment ELSE '' END AS sentiment,
    CASE WHEN ok THEN {ustrip('raw_response')} ELSE '' END AS response,
    CAST(CASE WHEN ok AND est THEN {est_in} WHEN ok THEN input_tokens ELSE 0 END AS BIGINT) AS input_tokens,
    CAST(CASE WHEN ok AND est THEN {est_out} WHEN ok THEN output_tokens ELSE 0 END AS BIGINT) AS output_tokens,
    ok AND est AS tokens_estimated,
    CAST(CASE WHEN ok THEN repairs ELSE 0 END AS INTEGER) AS format_repairs,
    CASE WHEN ok THEN '' ELSE 'TimeoutError: ' || substring('complaint ' || CAST(source_id AS VARCHAR) || ': ' ||
      {err_tail} || repeat('retrying; ', 12), 1, 160) END AS error
  FROM runs2),
scored AS (
  SELECT *, {", ".join(f"CASE WHEN ok THEN {x} END AS chk_{k}" for k, x in q.items())}
  FROM records),
scored2 AS (
  SELECT *, CASE WHEN ok THEN ({" + ".join(f"CAST(coalesce(chk_{k}, false) AS INTEGER)" for k in D.CHECK_NAMES)})
      / ({len(D.CHECK_NAMES) - 1} + CASE WHEN chk_fraud_team IS NULL THEN 0 ELSE 1 END) END AS ratio
  FROM scored)
"""


def with_ctes(select: str, extra: str | None = None) -> str:
    more = (",\n" + extra.strip()) if extra else ""
    return "WITH " + ctes().strip() + more + "\n" + select
