"""SQL twins of the catalogue, written for another engine as an independent check.

Texts of the composed tickets are ASCII, so the SQL may use ASCII word boundaries.
"""

from __future__ import annotations

from ..functions import lexicons as lx
from ..operators.evaluation import THRESHOLDS

TICKETS = """WITH subj(sidx, subject) AS (VALUES
 (0,'Small question for the database page'),(1,'Login failed'),(2,'URGENT please help now'),(3,'Routine check'),
 (4,'Feature request'),(5,'SLA BREACH'),(6,'Billing error'),(7,'Hello')),
prob(pidx, problem) AS (VALUES
 (0,'we had a data loss last night'),(1,'the export is not working'),(2,'the page is slow'),
 (3,'how do I change my profile picture'),(4,'there was an outage and a crash'),(5,'the total is incorrect'),
 (6,'the font color looks slightly off'),(7,'our production database is inaccessible'),
 (8,'an emergency failure happened'),(9,'the tooltip has a typo'),(10,'I need information'),
 (11,'the payment failed with an error'),(12,'this issue is a problem'),
 (13,'the server is down, escalate immediately'),(14,'thank you for the nice service')),
ctx(cidx, context) AS (VALUES
 (0,'No rush, tell me when it suits'),(1,'I can''t log in'),(2,'Please fix it'),(3,'It never worked'),
 (4,'We have tried to restart the device and to clear the cache and to read the manual and to ask a friend and then to wait for one more day but the result stays the same as it was before we started with all of that work'),
 (5,'Thanks'),(6,'It is critical for all users'),(7,'I am unable to use it and it doesn''t load'),
 (8,'This broke the welcome email banner'),(9,'Broken on Monday, broken on Tuesday, still broken'),(10,'Not, not and not')),
tickets AS (
 SELECT concat('T', CAST(e.event_id AS VARCHAR)) AS ticket_id, e.event_id AS ticket_num,
  s.subject AS ticket_subject,
  CASE WHEN e.event_id % 97 = 0 THEN NULL ELSE concat(p.problem, '. ', c.context) END AS ticket_description,
  CASE (e.event_id * 7 + e.user_id) % 11 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium'
    WHEN 3 THEN 'Low' WHEN 4 THEN ' high ' WHEN 5 THEN 'CRITICAL' WHEN 6 THEN 'low' WHEN 7 THEN 'P1'
    WHEN 8 THEN NULL WHEN 9 THEN 'Low' ELSE 'Medium' END AS priority_level,
  CASE e.user_id % 6 WHEN 0 THEN 'Email' WHEN 1 THEN 'Chat' WHEN 2 THEN 'Phone' WHEN 3 THEN 'Web Form'
    WHEN 4 THEN 'Social Media' ELSE NULL END AS ticket_channel,
  e.event_type AS issue_category,
  CASE e.event_id % 6 WHEN 0 THEN concat(CAST(CAST(floor(e.value) AS INT) AS VARCHAR),' hours')
    WHEN 1 THEN concat(CAST(CAST(floor(e.value) AS INT) % 9 AS VARCHAR),' days')
    WHEN 2 THEN concat(CAST(CAST(floor(e.value) AS INT) % 24 AS VARCHAR),':30:15')
    WHEN 3 THEN CAST(CAST(floor(e.value) AS INT) AS VARCHAR) WHEN 4 THEN 'unknown' ELSE NULL END AS resolution_time,
  e.value / 10 AS resolution_time_hours, e.ts AS submitted_at
 FROM events e JOIN subj s ON e.event_id % 8 = s.sidx JOIN prob p ON e.event_id % 15 = p.pidx
  JOIN ctx c ON e.event_id % 11 = c.cidx)"""


# --- expression builders ----------------------------------------------------

def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def word(phrase: str) -> str:
    return lit(rf"\b{phrase}\b")


def has(phrase: str) -> str:
    return f"CAST(regexp_matches(txt, {word(phrase)}) AS INT)"


def count(phrase: str) -> str:
    return f"len(regexp_extract_all(txt, {word(phrase)}))"


def distinct(phrases) -> str:
    return "(" + " + ".join(has(p) for p in phrases) + ")"


def total(phrases) -> str:
    return "(" + " + ".join(count(p) for p in phrases) + ")"


def weighted(pairs) -> str:
    return "(" + " + ".join(f"{count(p)} * CAST({w} AS DOUBLE)" for p, w in pairs) + ")"


def stripped(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


def number(col: str) -> str:
    return rf"CASE WHEN regexp_matches({col}, '^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$') THEN TRY_CAST(trim({col}) AS DOUBLE) END"


def minutes(col: str) -> str:
    v = f"lower({col})"
    clock = r"'^(\d+):(\d+):(\d+)'"
    parts = [f"CAST(regexp_extract({v}, {clock}, {i}) AS DOUBLE)" for i in (1, 2, 3)]
    n = f"TRY_CAST(nullif(regexp_extract({v}, '[0-9.]+'), '') AS DOUBLE)"
    return (rf"CASE WHEN regexp_matches({v}, {clock}) THEN CASE WHEN regexp_matches({v}, {clock}) THEN "
            f"TRY_CAST(nullif(regexp_extract({v}, {clock}, 1), '') AS DOUBLE) * 60 "
            f"+ TRY_CAST(nullif(regexp_extract({v}, {clock}, 2), '') AS DOUBLE) "
            f"+ TRY_CAST(nullif(regexp_extract({v}, {clock}, 3), '') AS DOUBLE) / 60 END "
            f"WHEN contains({v}, 'day') THEN {n} * 1440 WHEN contains({v}, 'hour') THEN {n} * 60 ELSE {n} END")


def severity_num(col: str) -> str:
    return f"CASE lower({stripped(col)}) WHEN 'low' THEN 1 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 2 END"


def severity_name(num: str) -> str:
    return f"CASE {num} WHEN 1 THEN 'Low' WHEN 3 THEN 'High' WHEN 4 THEN 'Critical' ELSE 'Medium' END"


def density_name(col: str) -> str:
    return f"CASE WHEN {col} > 0.08 THEN 'Critical' WHEN {col} > 0.05 THEN 'High' WHEN {col} > 0.02 THEN 'Medium' ELSE 'Low' END"


def even(col: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', CAST({col} AS DOUBLE)) AS DOUBLE)"


def rounded(col: str, digits: int = 8) -> str:
    return f"round(CAST({col} AS DOUBLE), {digits})"


def tier_case(short: bool = False) -> str:
    medium = [p for p in lx.TIER_MEDIUM if not (short and p in ("update", "upgrade"))]
    low = [p for p in lx.TIER_LOW if not (short and p == "update me")]
    high, neg = distinct(lx.TIER_HIGH), total(lx.TIER_NEGATIONS)
    return (f"CASE WHEN {distinct(lx.TIER_CRITICAL)} >= 1 THEN 'Critical' "
            f"WHEN {high} >= 2 AND {neg} > 0 THEN 'Critical' WHEN {high} >= 1 THEN 'High' "
            f"WHEN {distinct(medium)} >= 1 AND {neg} > 0 THEN 'High' WHEN {distinct(medium)} >= 1 THEN 'Medium' "
            f"WHEN {distinct(low)} >= 1 THEN 'Low' "
            "WHEN dwords > 80 THEN 'High' WHEN dwords > 15 THEN 'Medium' ELSE 'Low' END")


# --- shared tables ----------------------------------------------------------

WORDS = r"len(regexp_extract_all({}, '\S+'))"

CLEAN = TICKETS + f""", prepared AS (
 SELECT ticket_id, ticket_num, coalesce({stripped('ticket_subject')}, '') AS subject,
  {stripped('ticket_description')} AS description, {stripped('priority_level')} AS priority_raw,
  coalesce({stripped('ticket_channel')}, 'Unknown') AS channel, {stripped('issue_category')} AS category,
  {stripped('resolution_time')} AS resolution_raw
 FROM tickets WHERE ticket_description IS NOT NULL AND priority_level IS NOT NULL),
clean AS (
 SELECT *, {severity_num('priority_raw')} AS assigned_num, {severity_name(severity_num('priority_raw'))} AS assigned_priority,
  {minutes('resolution_raw')} AS resolution_minutes, lower(concat(subject, ' ', description)) AS txt
 FROM prepared),
texted AS (
 SELECT *, CAST({WORDS.format('txt')} AS INT) AS words, CAST({WORDS.format('description')} AS INT) AS dwords FROM clean)"""

FILLED = """, med AS (SELECT quantile_cont(resolution_minutes, 0.5) AS m FROM clean),
filled AS (SELECT texted.*, coalesce(resolution_minutes, m) AS predicted_minutes, CAST(ticket_num % 4 AS INT) AS cluster_id
 FROM texted, med),
ranked AS (SELECT cluster_id, row_number() OVER (ORDER BY avg(predicted_minutes), cluster_id) AS r,
  avg(predicted_minutes) AS mean_minutes, count(*) AS tickets FROM filled GROUP BY cluster_id)"""

LIGHT = CLEAN + FILLED + f""", sig AS (
 SELECT *, {tier_case()} AS llm_severity_score FROM filled),
fused AS (
 SELECT sig.*, {severity_name('r')} AS cluster_severity,
  CAST(least(ceil(({severity_num('llm_severity_score')} + r) / 2.0), 4) AS INT) AS fused_num
 FROM sig JOIN ranked USING (cluster_id)),
gap AS (SELECT max(abs(fused_num - assigned_num)) >= 2 AS wide FROM fused),
light AS (
 SELECT fused.*, CAST(fused_num - assigned_num AS INT) AS severity_delta,
  CAST(abs(fused_num - assigned_num) >= CASE WHEN wide THEN 2 ELSE 1 END AS INT) AS mismatch,
  ((ticket_num * 37) % 100) / 100.0::DOUBLE AS prob_mismatch
 FROM fused, gap),
judged AS (SELECT mismatch AS true_label, prob_mismatch, CAST(prob_mismatch >= 0.5 AS INT) AS predicted_label FROM light)"""

FULL = LIGHT + f""", cuts AS (SELECT quantile_cont(predicted_minutes, 0.25) AS p25, quantile_cont(predicted_minutes, 0.5) AS p50,
  quantile_cont(predicted_minutes, 0.75) AS p75 FROM light),
dens AS (SELECT *, {even(f"({weighted(lx.ESCALATION_16)} + {total(lx.NEGATIONS_11)}) / greatest(words, 1)", 4)} AS keyword_density FROM light),
labelled AS (
 SELECT dens.*, {density_name('keyword_density')} AS rule_nlp_severity,
  CASE WHEN predicted_minutes >= p75 THEN 'Critical' WHEN predicted_minutes >= p50 THEN 'High'
   WHEN predicted_minutes >= p25 THEN 'Medium' ELSE 'Low' END AS regression_severity
 FROM dens, cuts)"""

AUDITED = CLEAN + """, standin AS (
 SELECT *, ((ticket_num * 37) % 100) / 100.0::DOUBLE AS prob_mismatch FROM texted),
labels0 AS (SELECT *, CAST(prob_mismatch >= 0.5 AS INT) AS predicted_label FROM standin),
audited0 AS (
 SELECT *, CASE WHEN predicted_label = 0 THEN assigned_priority WHEN prob_mismatch > 0.80 THEN 'Critical'
  WHEN prob_mismatch > 0.65 THEN 'High' ELSE 'Medium' END AS inferred_severity FROM labels0),
audited1 AS (
 SELECT *, """ + severity_num("inferred_severity") + """ - assigned_num AS delta,
  coalesce(resolution_minutes, 60.0) AS rt,
  """ + even("prob_mismatch * 100", 1) + """ AS pct FROM audited0),
audited AS (
 SELECT *, CASE WHEN delta > 0 THEN 'Hidden Crisis' WHEN delta < 0 THEN 'False Alarm'
   WHEN prob_mismatch >= 0.5 THEN 'Hidden Crisis' ELSE 'False Alarm' END AS kind,
  CAST(delta AS INT) AS severity_delta, concat(printf('%.1f', pct), '%') AS confidence FROM audited1),
typed AS (SELECT *, CASE WHEN predicted_label = 1 THEN kind ELSE 'None' END AS mismatch_type FROM audited)"""


def raw(select: str) -> str:
    return TICKETS + " " + select


def clean(select: str) -> str:
    return CLEAN + " " + select


def light(select: str) -> str:
    return LIGHT + " " + select


SQL: dict[str, str] = {}

SQL["mismatch_by_channel"] = clean(f""", sig AS (SELECT *, {tier_case()} AS s FROM texted),
gaps AS (SELECT channel, {severity_num('s')} - assigned_num AS gap FROM sig)
SELECT channel, count(*) AS tickets, count(*) FILTER (abs(gap) >= 2) AS mismatches,
 count(*) FILTER (gap >= 2) AS under_prioritised,
 {even("avg(CAST(abs(gap) >= 2 AS INT)) * 100", 1)} AS mismatch_percent FROM gaps GROUP BY channel""")

# --- cleaning
SQL["clean_tickets"] = clean("""SELECT ticket_id, subject, description, priority_raw, assigned_priority, assigned_num, channel,
 category, resolution_raw, round(resolution_minutes, 6) AS resolution_minutes FROM clean""")
SQL["dropped_rows"] = raw("""SELECT count(*) AS rows_before,
 count(*) FILTER (ticket_description IS NULL OR priority_level IS NULL) AS rows_dropped,
 count(*) FILTER (ticket_description IS NOT NULL AND priority_level IS NOT NULL) AS rows_kept FROM tickets""")
SQL["parse_resolution_time"] = raw(f"SELECT ticket_id, round({minutes('resolution_time')}, 6) AS resolution_minutes FROM tickets")
SQL["hours_to_minutes"] = raw("SELECT ticket_id, round(resolution_time_hours * 60, 6) AS resolution_minutes FROM tickets")
_num = number("resolution_time")
SQL["fill_median"] = raw(f""", n AS (SELECT ticket_id, {_num} AS v FROM tickets)
SELECT ticket_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM n)), 6) AS filled FROM n""")
SQL["fill_first_token"] = raw(rf""", n AS (SELECT ticket_id, resolution_time AS x, {_num} AS v FROM tickets),
s AS (SELECT count(*) FILTER (v IS NULL) > count(*) * 0.5 AS sparse FROM n),
t AS (SELECT ticket_id, CASE WHEN NOT sparse THEN v WHEN x IS NOT NULL AND regexp_matches(x, '^[0-9]')
  THEN {number(r"regexp_extract(x, '\S+')")} ELSE 30.0 END AS v FROM n, s)
SELECT ticket_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM t)), 6) AS filled FROM t""")
SQL["fill_first_token_when_empty"] = raw(rf""", n AS (SELECT ticket_id, resolution_time || ' min' AS x FROM tickets),
m AS (SELECT ticket_id, x, {number('x')} AS v FROM n),
e AS (SELECT count(v) = 0 AS none FROM m),
t AS (SELECT ticket_id, CASE WHEN none THEN {number(r"regexp_extract(x, '\S+')")} ELSE v END AS v FROM m, e)
SELECT ticket_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM t), 30.0), 6) AS filled FROM t""")
SQL["fill_fixed"] = raw(f"SELECT ticket_id, round(coalesce({_num}, 60.0), 6) AS filled FROM tickets")
SQL["ticket_keys"] = raw("""SELECT ticket_num, CASE WHEN priority_level IS NOT NULL THEN ticket_id
  ELSE printf('ROW-%04d', row_number() OVER (ORDER BY ticket_num) - 1) END AS ticket_id,
 row_number() OVER (ORDER BY ticket_num) - 1 AS row_index FROM tickets""")
SQL["content_keys"] = raw("""SELECT ticket_num, concat('ROW-', md5(concat_ws(chr(1), coalesce(ticket_subject, chr(2)),
 coalesce(ticket_description, chr(2)), coalesce(priority_level, chr(2)), coalesce(ticket_channel, chr(2)),
 coalesce(resolution_time, chr(2))))) AS ticket_id FROM tickets""")
SQL["model_input_text"] = raw(f"""SELECT ticket_id, concat('[SUBJECT] ', coalesce(ticket_subject, ''), ' [DESC] ',
 substring(coalesce(ticket_description, ''), 1, 400), ' [CHANNEL] ', coalesce(ticket_channel, 'Email'), ' [RESTIME] ',
 CAST(coalesce({_num}, 60.0::DOUBLE) AS VARCHAR)) AS input_text FROM tickets""")

# --- profiling
_CANON = [("subject", "ticket_subject", "string"), ("description", "ticket_description", "string"),
          ("priority_raw", "priority_level", "string"), ("channel", "ticket_channel", "string"),
          ("category", "issue_category", "string"), ("resolution_raw", "resolution_time", "string"),
          ("ticket_id", "ticket_id", "string"), ("ticket_num", "ticket_num", "bigint")]
SQL["profile_shape"] = raw("SELECT count(*) AS row_count, CAST(10 AS INT) AS column_count FROM tickets")
SQL["profile_head"] = raw("SELECT " + ", ".join(f"{c} AS {n}" for n, c, _ in _CANON)
                          + " FROM tickets ORDER BY ticket_num LIMIT 5")
SQL["profile_columns"] = raw(" UNION ALL ".join(
    f"SELECT '{n}' AS column_name, '{t}' AS data_type, count({c}) AS non_null FROM tickets" for n, c, t in _CANON))
SQL["profile_missing"] = raw("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, count(*) - count({c}) AS missing FROM tickets" for n, c, _ in _CANON) + ") WHERE missing > 0")
SQL["priority_frequency"] = raw("""SELECT priority_level AS priority, count(*) AS n FROM tickets
 WHERE priority_level IS NOT NULL GROUP BY 1""")
SQL["describe_resolution"] = clean("SELECT count(resolution_minutes) AS n, " + ", ".join(
    f"{even(e, 2)} AS {n}" for e, n in (
        ("avg(resolution_minutes)", "mean"), ("stddev_samp(resolution_minutes)", "std"),
        ("min(resolution_minutes)", "minimum"), ("quantile_cont(resolution_minutes, 0.25)", "p25"),
        ("quantile_cont(resolution_minutes, 0.5)", "p50"), ("quantile_cont(resolution_minutes, 0.75)", "p75"),
        ("max(resolution_minutes)", "maximum"))) + " FROM clean")
SQL["label_distribution"] = clean(f""", sig AS (SELECT {tier_case()} AS s FROM texted),
dom(position, label) AS (VALUES (0,'Critical'),(1,'High'),(2,'Medium'),(3,'Low'))
SELECT position, label, count(s) AS n, {even("count(s) * 100.0 / (SELECT count(*) FROM sig)", 1)} AS percent
FROM dom LEFT JOIN sig ON s = label GROUP BY position, label""")
SQL["class_balance"] = light(f"""SELECT count(*) AS total, count(*) FILTER (mismatch = 1) AS mismatch_count,
 count(*) FILTER (mismatch = 0) AS consistent_count,
 {even("count(*) FILTER (mismatch = 1) * 100.0 / count(*)", 1)} AS mismatch_percent,
 {even("count(*) FILTER (mismatch = 0) * 100.0 / count(*)", 1)} AS consistent_percent FROM light""")

# --- signals
SQL["tiered_severity"] = clean(f""", sig AS (SELECT ticket_id, {tier_case()} AS llm_severity_score FROM texted)
SELECT ticket_id, llm_severity_score, {severity_num('llm_severity_score')} AS llm_severity_num FROM sig""")
SQL["tiered_severity_short"] = clean(f"SELECT ticket_id, {tier_case(True)} AS llm_severity_score FROM texted")
_d159 = f"({weighted(lx.ESCALATION_15)} + {total(lx.NEGATIONS_9)}) / greatest(words, 1)"
SQL["keyword_density_weighted"] = clean(f""", x AS (SELECT ticket_id, words, {_d159} AS r FROM texted)
SELECT ticket_id, words, round(r, 8) AS raw_density, {even('r', 4)} AS keyword_density FROM x""")
_esc13, _neg7 = total([p for p, _ in lx.ESCALATION_13]), total(lx.NEGATIONS_7)
SQL["keyword_density_double_hits"] = clean(f""", x AS (SELECT ticket_id, words, {_esc13} AS e, {_neg7} AS n FROM texted),
y AS (SELECT *, {even('(2 * e + n) / greatest(words, 1)', 4)} AS keyword_density FROM x)
SELECT ticket_id, CAST(e AS INT) AS escalation_hits, CAST(n AS INT) AS negation_hits, keyword_density,
 {density_name('keyword_density')} AS rule_nlp_severity FROM y""")
SQL["density_severity"] = clean(f""", x AS (SELECT ticket_id,
 {even(f"({weighted(lx.ESCALATION_16)} + {total(lx.NEGATIONS_11)}) / greatest(words, 1)", 4)} AS keyword_density FROM texted)
SELECT ticket_id, keyword_density, {density_name('keyword_density')} AS rule_nlp_severity FROM x""")


def top_cases(pairs, empty: str = "NULL") -> tuple[str, str]:
    ordered = sorted(pairs, key=lambda item: -item[1])
    kw = " ".join(f"WHEN {has(p)} = 1 THEN {lit(p)}" for p, _ in ordered)
    wt = " ".join(f"WHEN {has(p)} = 1 THEN CAST({w} AS DOUBLE)" for p, w in ordered)
    return f"CASE {kw} ELSE {empty} END", f"CASE {wt} ELSE CAST(0.0 AS DOUBLE) END"


_kw15, _wt15 = top_cases(lx.ESCALATION_15)
SQL["top_keyword"] = clean(f"SELECT ticket_id, {_kw15} AS top_keyword, {_wt15} AS keyword_weight FROM texted")


# Unicode word boundaries: every non-word character is doubled, so that two
# neighbouring phrases do not compete for the one between them.
def _wide(phrase: str) -> str:
    inner = phrase.replace("'", "''").replace(" ", "  ").replace("''", "''''").replace("-", "--")
    return f"len(regexp_extract_all(wide, '[^\\p{{L}}\\p{{N}}_]{inner}[^\\p{{L}}\\p{{N}}_]'))"


_wide_weighted = " + ".join(f"{_wide(p)} * CAST({w} AS DOUBLE)" for p, w in lx.ESCALATION_16)
_wide_neg = " + ".join(_wide(p) for p in lx.NEGATIONS_11)
_wide_all = " + ".join(_wide(p) for p in lx.ALL_PHRASES)
SQL["document_density"] = rf"""WITH w AS (SELECT doc_id, concat(' ', text) AS joined,
  concat('  ', regexp_replace(lower(text), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), ' ') AS wide FROM documents),
c AS (SELECT doc_id, CAST(len(regexp_extract_all(joined, '[^\s\p{{Z}}]+')) AS INT) AS words,
  CAST({_wide_all} AS INT) AS phrase_hits, {_wide_weighted} + {_wide_neg} AS score FROM w),
x AS (SELECT *, {even('score / greatest(words, 1)', 4)} AS keyword_density FROM c)
SELECT doc_id, phrase_hits, words, keyword_density, {density_name('keyword_density')} AS rule_nlp_severity FROM x"""

_QUART = """, q AS (SELECT quantile_cont(resolution_minutes, 0.25) AS p25, quantile_cont(resolution_minutes, 0.5) AS p50,
  quantile_cont(resolution_minutes, 0.75) AS p75 FROM {})"""


def tier_name(rt: str, a="p25", b="p50", c="p75") -> str:
    return (f"CASE WHEN {rt} IS NULL THEN 'Unknown' WHEN {rt} > {c} THEN 'Critical' WHEN {rt} > {b} THEN 'High' "
            f"WHEN {rt} > {a} THEN 'Medium' ELSE 'Low' END")


def fixed(col: str, digits: int) -> str:
    return f"printf('%.{digits}f', {even(col, digits)})"


def full_message(rt: str, tier: str) -> str:
    return (f"CASE {tier} WHEN 'Critical' THEN concat({fixed(rt, 1)}, ' min — top quartile (P75=', {fixed('p75', 0)}, "
            f"' min), complex case.') WHEN 'High' THEN concat({fixed(rt, 1)}, ' min — above median (', {fixed('p50', 0)}, "
            f"' min), above-average effort.') WHEN 'Medium' THEN concat({fixed(rt, 1)}, "
            "' min — second quartile, moderate complexity.') WHEN 'Low' THEN "
            f"concat({fixed(rt, 1)}, ' min — bottom quartile (<=P25=', {fixed('p25', 0)}, ' min), straightforward.') "
            "ELSE 'Resolution time unavailable.' END")


SQL["resolution_tier_quartile"] = clean(_QUART.format("clean") + f""",
t AS (SELECT *, {tier_name('resolution_minutes')} AS tier FROM clean, q)
SELECT ticket_id, tier AS resolution_tier, {full_message('resolution_minutes', 'tier')} AS message FROM t""")
SQL["resolution_tier_fixed"] = clean(
    f"SELECT ticket_id, {tier_name('resolution_minutes', '30', '60', '120')} AS resolution_tier FROM clean")
SQL["quartile_bucket"] = clean(FILLED + """, c AS (SELECT quantile_cont(predicted_minutes, 0.25) AS p25,
 quantile_cont(predicted_minutes, 0.5) AS p50, quantile_cont(predicted_minutes, 0.75) AS p75 FROM filled)
SELECT ticket_id, CASE WHEN predicted_minutes >= p75 THEN 'Critical' WHEN predicted_minutes >= p50 THEN 'High'
 WHEN predicted_minutes >= p25 THEN 'Medium' ELSE 'Low' END AS regression_severity FROM filled, c""")

# --- fusion
SQL["fuse_ceil_mean"] = clean(FILLED + f""", sig AS (SELECT ticket_id, {tier_case()} AS s FROM texted),
j AS (SELECT f.ticket_id, coalesce(s, 'Medium') AS llm_severity_score, r,
  {severity_name('r')} AS cluster_severity FROM filled f LEFT JOIN sig USING (ticket_id) JOIN ranked USING (cluster_id)),
u AS (SELECT *, CAST(least(ceil(({severity_num('llm_severity_score')} + r) / 2.0), 4) AS INT) AS fused_num FROM j)
SELECT ticket_id, llm_severity_score, cluster_severity, fused_num, {severity_name('fused_num')} AS fused_severity FROM u""")
_VOTES = ("llm_severity_score", "cluster_severity", "regression_severity", "rule_nlp_severity")
SQL["fuse_majority"] = FULL + f""", v AS (SELECT ticket_id, unnest([{", ".join(severity_num(c) for c in _VOTES)}]) AS vote,
  {severity_num('llm_severity_score')} AS first FROM labelled),
c AS (SELECT ticket_id, first, vote, count(*) AS n FROM v GROUP BY ALL),
b AS (SELECT ticket_id, first, max(n) AS best FROM c GROUP BY ALL),
w AS (SELECT b.ticket_id, b.first, count(*) AS ties, min(vote) AS top FROM b JOIN c ON b.ticket_id = c.ticket_id AND c.n = b.best GROUP BY ALL),
z AS (SELECT ticket_id, CAST(CASE WHEN ties > 1 THEN first ELSE top END AS INT) AS fused_num FROM w)
SELECT ticket_id, fused_num, {severity_name('fused_num')} AS fused_severity FROM z"""
SQL["mismatch_label"] = light("SELECT ticket_id, assigned_num, fused_num, severity_delta, mismatch FROM light")
SQL["cluster_rank_by_time"] = clean(FILLED + f""" SELECT cluster_id, round(mean_minutes, 6) AS mean_minutes, tickets,
 {severity_name('r')} AS cluster_severity FROM ranked""")
SQL["cluster_rank_by_size"] = clean(f""", g AS (SELECT CAST(ticket_num % 4 AS INT) AS cluster_id, count(*) AS tickets FROM clean GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY tickets DESC, cluster_id) AS r FROM g)
SELECT cluster_id, tickets, {severity_name('r')} AS cluster_severity FROM o""")
SQL["signal_agreement"] = light(f"""SELECT 'cluster_severity' AS compared_with,
 {even("avg(CAST(llm_severity_score = cluster_severity AS INT)) * 100", 1)} AS agreement FROM light
UNION ALL SELECT 'assigned_priority', {even("avg(CAST(llm_severity_score = assigned_priority AS INT)) * 100", 1)} FROM light""")
SQL["signal_ablation"] = FULL + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS signal, {even(f'avg(CAST(CAST(abs({severity_num(c)} - assigned_num) >= 2 AS INT) = mismatch AS INT)) * 100', 1)} "
    "AS agreement_with_fused FROM labelled" for c in _VOTES)

# --- probabilities, rules, hybrid
SQL["severity_from_prob"] = AUDITED + f""", x AS (SELECT ticket_id, predicted_label, prob_mismatch, assigned_priority,
  {even(f'(2 * {_esc13} + {_neg7}) / greatest(words, 1)', 4)} AS k FROM audited),
y AS (SELECT *, {density_name('k')} AS rule FROM x)
SELECT ticket_id, CASE WHEN predicted_label = 0 THEN rule WHEN prob_mismatch > 0.80 THEN 'Critical'
  WHEN prob_mismatch > 0.65 THEN 'High' ELSE 'Medium' END AS batch_severity,
 CASE WHEN predicted_label = 0 THEN assigned_priority WHEN prob_mismatch > 0.80 THEN 'Critical'
  WHEN prob_mismatch > 0.65 THEN 'High' WHEN prob_mismatch > 0.50 THEN 'Medium' ELSE 'Low' END AS interactive_severity FROM y"""
SQL["mismatch_type"] = AUDITED + """ SELECT ticket_id, CAST(delta AS INT) AS delta, mismatch_type,
 CASE WHEN predicted_label = 0 THEN 'None' WHEN delta < 0 THEN 'False Alarm' ELSE 'Hidden Crisis' END AS interactive_type FROM typed"""


def ruled(interactive: bool) -> str:
    trivial = lx.TRIVIAL_CONTENT_45 if interactive else lx.TRIVIAL_CONTENT_32
    dens = f"({weighted(lx.ESCALATION_15)} + {total(lx.NEGATIONS_11 if interactive else lx.NEGATIONS_9)}) / greatest(words, 1)"
    if interactive:
        dens = even(dens, 4)
    r = {"hidden_crisis": ("assigned_num <= 2 AND c >= 1 AND rt > 60", "least(0.55::DOUBLE + c * 0.08::DOUBLE + rt / 500, 0.95::DOUBLE)"),
         "false_alarm": ("assigned_num >= 3 AND t >= 1 AND rt < 30", "least(0.60::DOUBLE + t * 0.10::DOUBLE, 0.95::DOUBLE)"),
         "trivial_multi": ("t >= 2 AND rt < 20", "least(0.58::DOUBLE + t * 0.08::DOUBLE, 0.90::DOUBLE)"),
         "density_rt": ("assigned_num = 1 AND d > 0.03 AND rt > 90", "0.62::DOUBLE")}
    names = " ".join(f"WHEN {cond} THEN '{n}'" for n, (cond, _) in r.items())
    probs = " ".join(f"WHEN {cond} THEN {p}" for cond, p in r.values())
    return CLEAN + f""", rc AS (SELECT *, coalesce(resolution_minutes, 60.0) AS rt, CAST({distinct(lx.CRITICAL_CONTENT)} AS INT) AS c,
  CAST({distinct(trivial)} AS INT) AS t, {dens} AS d FROM texted),
ruled AS (SELECT *, CASE {names} END AS rule_name, CASE {probs} END AS rule_prob,
  ((ticket_num * 37) % 100) / 100.0::DOUBLE AS ml FROM rc)"""


for _name, _inter in (("rule_override", False), ("rule_override_interactive", True)):
    SQL[_name] = ruled(_inter) + """ SELECT ticket_id, c AS critical_hits, t AS trivial_hits, rule_name,
 round(rule_prob, 8) AS rule_prob FROM ruled"""

_BY_RULE = "rule_prob IS NOT NULL AND rule_prob > ml"
SQL["hybrid_adversarial"] = ruled(False) + f""", m AS (SELECT *, (ml + coalesce(rule_prob, 0)) / 2 AS mean FROM ruled)
SELECT ticket_id, CAST(CASE WHEN {_BY_RULE} OR ml >= 0.64 OR mean >= 0.40 THEN 1 ELSE 0 END AS INT) AS final_pred,
 round(CASE WHEN {_BY_RULE} THEN rule_prob WHEN ml >= 0.64 THEN ml ELSE mean END, 8) AS final_prob,
 CASE WHEN {_BY_RULE} THEN 'rule' WHEN ml >= 0.64 THEN 'ml' ELSE 'combined' END AS source FROM m"""
SQL["hybrid_app"] = ruled(True) + f""", m AS (SELECT *, CASE WHEN rule_prob IS NULL THEN ml ELSE (ml + rule_prob) / 2 END AS mean FROM ruled)
SELECT ticket_id, CAST(CASE WHEN {_BY_RULE} OR ml >= 0.64 OR mean >= 0.40 THEN 1 ELSE 0 END AS INT) AS final_pred,
 round(CASE WHEN {_BY_RULE} THEN rule_prob WHEN ml >= 0.64 THEN ml ELSE mean END, 8) AS final_prob,
 CASE WHEN {_BY_RULE} THEN 'rule' WHEN ml >= 0.64 THEN 'ml' ELSE 'combined' END AS source FROM m"""
SQL["hybrid_notebook"] = ruled(False) + f""" SELECT ticket_id,
 CAST(CASE WHEN {_BY_RULE} OR ml >= 0.64 THEN 1 ELSE 0 END AS INT) AS final_pred,
 round(CASE WHEN {_BY_RULE} THEN rule_prob ELSE ml END, 8) AS final_prob,
 CASE WHEN {_BY_RULE} THEN 'rule' ELSE 'ml' END AS source FROM ruled"""
_phr15 = distinct([p for p, _ in lx.ESCALATION_15])
SQL["keyword_baseline"] = clean(f""", x AS (SELECT ticket_id, CAST({_phr15} AS INT) AS escalation_phrases FROM texted)
SELECT ticket_id, escalation_phrases, CAST(escalation_phrases >= 3 AS INT) AS keyword_pred FROM x""")
SQL["adversarial_eval"] = ruled(False) + f""", {LIGHT[len(CLEAN) + 2:]},
e AS (SELECT l.mismatch AS y, CAST(r.rule_prob IS NOT NULL AS INT) AS p, CAST({_phr15.replace('txt', 'l.txt')} >= 3 AS INT) AS k
 FROM light l JOIN ruled r USING (ticket_id))
SELECT count(*) AS total_tickets, count(*) FILTER (p = y) AS correctly_detected, count(*) FILTER (k = y) AS keyword_baseline_score,
 count(*) FILTER (y = 1 AND p = 1) AS true_detections, count(*) FILTER (y = 0 AND p = 1) AS wrong_detections,
 count(*) FILTER (p = y) - count(*) FILTER (k = y) AS improvement,
 count(*) FILTER (p = y) * 10 >= count(*) * 7 AS bonus_achieved FROM e"""

# --- dossiers
FLAT_TAIL = """SELECT ticket_id, assigned_priority, inferred_severity, mismatch_type, severity_delta, top_keyword, keyword_weight,
 keyword_density, resolution_tier, {note} AS resolution_note, {analysis} AS constraint_analysis, confidence FROM g"""


def flat(pairs, dens: str, cut_source: str, note: str, crisis: str, alarm: str) -> str:
    kw, wt = top_cases(pairs)
    return AUDITED + cut_source + f""", f AS (SELECT *, {kw} AS top_keyword, {wt} AS keyword_weight, {even(dens, 4)} AS keyword_density,
  {tier_name('rt')} AS resolution_tier FROM typed, q WHERE predicted_label = 1),
g AS (SELECT *, CAST(abs(delta) AS VARCHAR) AS gap FROM f) """ + FLAT_TAIL.format(
        note=note, analysis=f"CASE WHEN kind = 'Hidden Crisis' THEN {crisis} ELSE {alarm} END")


def cut(col: str, n: int, dots: str) -> str:
    return f"CASE WHEN length({col}) > {n} THEN concat(substring({col}, 1, {n}), '{dots}') ELSE {col} END"


_subj60, _subj80 = "substring(subject, 1, 60)", "substring(subject, 1, 80)"
_rt0 = fixed("rt", 0)
_d4 = fixed("keyword_density", 4)
_exc, _exc2 = cut("description", 120, "..."), cut("description", 120, "…")


def keyword_note(found_start: str, found_end: str, missing: str) -> str:
    return f"CASE WHEN top_keyword IS NULL THEN '{missing}' ELSE concat('{found_start}''', top_keyword, '''{found_end}') END"


SQL["dossier_flat"] = flat(
    lx.ESCALATION_15, _d159, _QUART.format("audited"), full_message("rt", "resolution_tier"),
    f"""concat('Ticket ''', {_subj60}, ''' describes a ', inferred_severity, '-severity issue but was assigned ', assigned_priority,
  ' — ', gap, ' severity level(s) lower. ',
  {keyword_note('Escalation keyword ', ' detected. ', 'No standard escalation keyword — polite framing may obscure true impact. ')},
  'Resolution time (', {_rt0}, ' min, ', resolution_tier, ' tier) corroborates higher severity. Excerpt: "', {_exc}, '"')""",
    f"""concat('Ticket ''', {_subj60}, ''' was assigned ', assigned_priority, ' but signals infer ', inferred_severity, ' — ', gap,
  ' level(s) lower. Keyword density (', {_d4}, ') and resolution time (', {_rt0}, ' min, ', resolution_tier,
  ' tier) are both consistent with ', inferred_severity, ' severity. Excerpt: "', {_exc}, '"')""")
_FIXED_Q = ", q AS (SELECT 30.0::DOUBLE AS p25, 60.0::DOUBLE AS p50, 120.0::DOUBLE AS p75)"
_rt = "CAST(CAST(rt AS DOUBLE) AS VARCHAR)"
SQL["dossier_flat_batch"] = flat(
    lx.ESCALATION_13, f"(2 * {_esc13} + {_neg7}) / greatest(words, 1)", _FIXED_Q,
    f"""CASE resolution_tier WHEN 'Critical' THEN concat({fixed('rt', 1)}, ' min -- top quartile (P75=120 min), indicative of a complex or escalated case.')
  WHEN 'High' THEN concat({fixed('rt', 1)}, ' min -- above the median (60 min), above-average resolution effort.')
  WHEN 'Medium' THEN concat({fixed('rt', 1)}, ' min -- second quartile (P25=30--P50=60 min), moderate complexity.')
  ELSE concat({fixed('rt', 1)}, ' min -- bottom quartile (≤P25=30 min), straightforward resolution.') END""",
    f"""concat('The ticket ''', {_subj80}, ''' describes a ', inferred_severity, '-severity issue yet was assigned ', assigned_priority,
  ' -- a gap of ', gap, ' severity level(s). ',
  {keyword_note('Escalation keyword ', ' found in ticket text. ', 'No standard escalation keywords detected -- polite framing may obscure true impact. ')},
  'Resolution time (', {_rt}, ' min, ', resolution_tier, ' tier) corroborates severity inference. Excerpt: "', {_exc2}, '"')""",
    f"""concat('The ticket ''', {_subj80}, ''' was assigned ', assigned_priority, ' priority, but multi-signal analysis infers ',
  inferred_severity, ' -- ', gap, ' level(s) lower. Keyword density (', {_d4}, ') ',
  CASE WHEN keyword_density > 0.05 THEN 'is elevated but ' ELSE 'is low and ' END, 'the described issue does not constitute ',
  assigned_priority, '-tier impact. Resolution time (', {_rt}, ' min, ', resolution_tier, ' tier) is consistent with ',
  inferred_severity, ' severity. Excerpt: "', {_exc2}, '"')""")
_d1511 = f"({weighted(lx.ESCALATION_15)} + {total(lx.NEGATIONS_11)}) / greatest(words, 1)"
SQL["dossier_flat_interactive"] = flat(
    lx.ESCALATION_15, _d1511, _FIXED_Q,
    f"""CASE resolution_tier WHEN 'Critical' THEN concat({_rt0}, ' min — top quartile, complex case.')
  WHEN 'High' THEN concat({_rt0}, ' min — above median effort.') WHEN 'Medium' THEN concat({_rt0}, ' min — moderate complexity.')
  ELSE concat({_rt0}, ' min — straightforward resolution.') END""",
    f"""concat('''', {_subj60}, ''' describes a ', inferred_severity, '-severity issue but was assigned ', assigned_priority, ' (', gap,
  ' level(s) lower). ', {keyword_note('Keyword ', ' detected. ', 'Polite framing masks severity. ')},
  'RT (', {_rt0}, ' min, ', resolution_tier, ' tier) corroborates. Excerpt: "', {_exc}, '"')""",
    f"""concat('''', {_subj60}, ''' was assigned ', assigned_priority, ' but signals infer ', inferred_severity, ' (', gap,
  ' level(s) lower). Keyword density (', {_d4}, ') and RT (', {_rt0}, ' min) consistent with ', inferred_severity, '.')""")
_kwn, _ = top_cases(lx.ESCALATION_15, "'[none detected]'")
SQL["dossier_evidence"] = AUDITED + _QUART.format("audited") + rf""", f AS (SELECT *, {_kwn} AS kw, {_wt15} AS wt, {even(_d159, 4)} AS dens,
  {tier_name('rt')} AS tier FROM typed, q WHERE predicted_label = 1)
SELECT ticket_id, 'keyword' AS signal, kw AS value, {fixed('wt', 1)} AS weight, CAST(NULL AS VARCHAR) AS interpretation FROM f
UNION ALL SELECT ticket_id, 'resolution_time', concat({_rt0}, ' min'), NULL, {full_message('rt', 'tier')} FROM f
UNION ALL SELECT ticket_id, 'keyword_density', regexp_replace({fixed('dens', 4)}, '(\.\d+?)0+$', '\1'),
  'combined escalation+negation score', NULL FROM f
UNION ALL SELECT ticket_id, 'classifier', concat('mismatch_prob=', {fixed('prob_mismatch', 3)}), confidence, NULL FROM f"""
SQL["dossier_joined"] = AUDITED + """ SELECT ticket_id, predicted_label, prob_mismatch, channel, subject, description,
 channel AS channel_full FROM audited"""
_COUNTS = """count(*) AS total_tickets, count(*) FILTER (predicted_label = 1) AS mismatch_count,
 count(*) FILTER (mismatch_type = 'Hidden Crisis') AS hidden_crisis_count,
 count(*) FILTER (mismatch_type = 'False Alarm') AS false_alarm_count"""
SQL["dossier_summary"] = AUDITED + f" SELECT {_COUNTS}, 0.5::DOUBLE AS threshold_used FROM typed"
SQL["dossier_examples"] = AUDITED + """, o AS (SELECT *, row_number() OVER (PARTITION BY mismatch_type ORDER BY ticket_id) AS r
 FROM typed WHERE predicted_label = 1)
SELECT mismatch_type, ticket_id, assigned_priority, inferred_severity, severity_delta, confidence FROM o WHERE r = 1"""
_kw13, _ = top_cases(lx.ESCALATION_13, "''")
SQL["batch_predictions"] = AUDITED + f""" SELECT ticket_id, assigned_priority, inferred_severity, predicted_label, mismatch_type,
 confidence, {even('prob_mismatch', 4)} AS prob_mismatch, severity_delta, {_kw13} AS top_keyword,
 {even(f'(2 * {_esc13} + {_neg7}) / greatest(words, 1)', 4)} AS keyword_density, rt AS resolution_time_min FROM typed"""
SQL["mismatch_type_counts"] = AUDITED + " SELECT mismatch_type, count(*) AS n FROM typed WHERE predicted_label = 1 GROUP BY 1"
SQL["overall_counts"] = AUDITED + """ SELECT count(*) FILTER (predicted_label = 0) AS consistent,
 count(*) FILTER (predicted_label = 1) AS mismatch FROM typed"""
SQL["delta_heatmap"] = light("SELECT category, " + ", ".join(
    f"round(avg(severity_delta) FILTER (channel = '{c}'), 6) AS {c.lower().replace(' ', '_')}"
    for c in ("Chat", "Email", "Phone", "Social Media", "Unknown", "Web Form"))
    + ", CAST(round(avg(severity_delta) FILTER (channel IS NULL OR channel NOT IN "
    "('Chat', 'Email', 'Phone', 'Social Media', 'Unknown', 'Web Form')), 6) AS DOUBLE) AS other FROM light GROUP BY category")

# --- measures
_CELLS = "(VALUES (0,0),(0,1),(1,0),(1,1)) AS c(true_label, predicted_label)"
SQL["confusion_matrix"] = light(f"""SELECT c.true_label, c.predicted_label, count(j.true_label) AS n FROM {_CELLS}
 LEFT JOIN judged j ON j.true_label = c.true_label AND j.predicted_label = c.predicted_label GROUP BY 1, 2""")
SQL["confusion_of_labels"] = f"""SELECT c.true_label, c.predicted_label, count(l.doc_id) AS n FROM {_CELLS}
 LEFT JOIN labels l ON l.quality = c.true_label AND l.toxic = c.predicted_label GROUP BY 1, 2"""
_M = """, cm AS (SELECT count(*) FILTER (true_label = 0 AND predicted_label = 0) AS tn,
  count(*) FILTER (true_label = 0 AND predicted_label = 1) AS fp, count(*) FILTER (true_label = 1 AND predicted_label = 0) AS fn,
  count(*) FILTER (true_label = 1 AND predicted_label = 1) AS tp FROM judged),
ms AS (SELECT (tn + tp) / (tn + fp + fn + tp) AS accuracy, coalesce(tn / nullif(tn + fn, 0), 0) AS precision_0,
  coalesce(tn / nullif(tn + fp, 0), 0) AS recall_0, coalesce(tp / nullif(tp + fp, 0), 0) AS precision_1,
  coalesce(tp / nullif(tp + fn, 0), 0) AS recall_1, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f1_0,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_1, tn + fp AS support_0, fn + tp AS support_1 FROM cm),
me AS (SELECT *, (f1_0 + f1_1) / 2 AS macro_f1 FROM ms)"""
SQL["classification_metrics"] = LIGHT + _M + " SELECT " + ", ".join(
    f"round({c}, 8) AS {c}" for c in ("accuracy", "precision_0", "recall_0", "precision_1", "recall_1", "f1_0", "f1_1", "macro_f1")
) + ", support_0, support_1 FROM me"
SQL["quality_gates"] = LIGHT + _M + """ SELECT round(accuracy, 8) AS accuracy, round(macro_f1, 8) AS macro_f1,
 round(recall_0, 8) AS recall_0, round(recall_1, 8) AS recall_1, accuracy >= 0.83 AS accuracy_passed,
 macro_f1 >= 0.82 AS macro_f1_passed, recall_0 >= 0.78 AS recall_0_passed, recall_1 >= 0.78 AS recall_1_passed,
 accuracy >= 0.83 AND macro_f1 >= 0.82 AND recall_0 >= 0.78 AND recall_1 >= 0.78 AS all_passed FROM me"""
SQL["threshold_sweep"] = light(f""", th(t) AS (VALUES {", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)}),
cm AS (SELECT t, count(*) FILTER (true_label = 0 AND prob_mismatch < t) AS tn, count(*) FILTER (true_label = 0 AND prob_mismatch >= t) AS fp,
  count(*) FILTER (true_label = 1 AND prob_mismatch < t) AS fn, count(*) FILTER (true_label = 1 AND prob_mismatch >= t) AS tp
  FROM judged, th GROUP BY t),
s AS (SELECT t, (tn + tp) / (tn + fp + fn + tp) AS accuracy, (coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)
  + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 2 AS macro_f1 FROM cm)
SELECT t AS threshold, round(accuracy, 8) AS accuracy, round(macro_f1, 8) AS macro_f1,
 row_number() OVER (ORDER BY macro_f1 DESC, t) = 1 AS is_best FROM s""")
SQL["class_weights"] = light("""SELECT mismatch AS label, count(*) AS n,
 round((SELECT count(*) FROM light) / (2 * count(*)), 8) AS weight FROM light GROUP BY 1""")

# --- terms and features
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def token_tables(source: str, key: str, text: str) -> str:
    return f"""tk AS (SELECT {key} AS k, {_TOKENS.format(text)} AS w FROM {source}),
tm AS (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS term FROM tk),
tf AS (SELECT k, term, count(*) AS tf FROM tm GROUP BY k, term),
vc AS (SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS texts FROM tf GROUP BY term HAVING count(*) >= 2)"""


_JOINED = "concat(subject, ' ', description)"
SQL["term_counts"] = CLEAN + ", " + token_tables("clean", "ticket_id", _JOINED) + """
SELECT term, occurrences, texts FROM vc ORDER BY occurrences DESC, term LIMIT 5000"""
SQL["document_terms"] = "WITH " + token_tables("documents", "doc_id", "text") + """
SELECT term, occurrences, texts FROM vc ORDER BY occurrences DESC, term LIMIT 3000"""
SQL["frequent_document_terms"] = SQL["document_terms"]
SQL["tfidf_terms"] = CLEAN + ", " + token_tables("clean", "ticket_id", _JOINED) + """,
vo AS (SELECT term, texts FROM vc ORDER BY occurrences DESC, term LIMIT 5000),
wt AS (SELECT k, term, tf, (ln(tf) + 1) * (ln((1 + (SELECT count(*) FROM clean)) / (1 + texts)) + 1) AS raw FROM tf JOIN vo USING (term)),
nm AS (SELECT k, sqrt(sum(raw * raw)) AS norm FROM wt GROUP BY k)
SELECT k AS ticket_id, term, tf, round(raw / norm, 6) AS weight FROM wt JOIN nm USING (k)"""
SQL["stratified_split"] = light("""SELECT ticket_id, mismatch, CASE WHEN r <= n * 70 // 100 THEN 'train' WHEN r <= n * 85 // 100 THEN 'val' ELSE 'test' END AS split
 FROM (SELECT ticket_id, mismatch, row_number() OVER (PARTITION BY mismatch ORDER BY md5(ticket_id)) AS r,
  count(*) OVER (PARTITION BY mismatch) AS n FROM light)""")
SQL["oversample"] = light(""", c AS (SELECT ticket_id, mismatch, row_number() OVER (PARTITION BY mismatch ORDER BY md5(ticket_id)) AS r,
  count(*) OVER (PARTITION BY mismatch) AS n FROM light),
m AS (SELECT max(n) AS big FROM c),
k AS (SELECT ticket_id, mismatch, big // n + CASE WHEN r <= big % n THEN 1 ELSE 0 END AS copies FROM c, m)
SELECT ticket_id, mismatch, CAST(unnest(range(1, copies + 1)) AS INT) AS copy FROM k""")
SQL["label_encode"] = clean("""SELECT ticket_id, channel, CAST(dense_rank() OVER (ORDER BY channel) - 1 AS INT) AS code FROM clean""")
_TF = f"""SELECT ticket_id, CAST({distinct(lx.FEATURE_ESCALATION)} AS INT) AS escalation_count,
 CAST({distinct(lx.TIER_NEGATIONS)} AS INT) AS negation_count, greatest(words, 1) AS w, dwords AS description_words FROM texted"""
SQL["text_features"] = clean(f""", t AS ({_TF}) SELECT ticket_id, escalation_count, negation_count,
 round(escalation_count / w, 8) AS escalation_share, round(negation_count / w, 8) AS negation_share, description_words FROM t""")
_FEATURES = ("escalation_count", "negation_count", "escalation_share", "negation_share", "description_words")
SQL["standardize"] = clean(f""", t AS ({_TF}), f AS (SELECT ticket_id, escalation_count, negation_count,
  escalation_count / w AS escalation_share, negation_count / w AS negation_share, description_words FROM t)
SELECT ticket_id, {", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in _FEATURES)} FROM f""")
