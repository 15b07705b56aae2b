"""The same queries in DuckDB's SQL, written apart from the Spark plans."""

from __future__ import annotations

import re

from threadloom.functions import patterns as P

#: Ordered rows per session, as operators.ordered.canonical makes them.
_ROWS = r"""
f as (
  select *, lower(regexp_replace(session_id, '^\s+|\s+$', '', 'g')) as sid,
    row_number() over (partition by coalesce(uuid, 'row ' || rec_id) order by rec_id) as copy_no
  from records where session_id is not null
), r as (
  select sid as session_id, rec_id, uuid, agent, rec_type as type, ts, coalesce(is_meta, false) as is_meta, coalesce(is_api_error, false) as is_api_error,
    cwd, subtype, content as sys_content, message.model as model, message.id as message_id, message.usage as usage, message.content as blocks,
    coalesce(regexp_replace(array_to_string(list_transform(list_filter(message.content, lambda b: b.type = 'text' and b.text is not null), lambda b: b.text), chr(10)), '^\s+|\s+$', '', 'g'), '') as text,
    row_number() over (partition by sid order by record_index nulls last, ts nulls last, rec_id) - 1 as i
  from f where copy_no = 1
)"""
_PROMPT = "(type = 'user' and not is_meta and text <> '')"
_TOK = "coalesce(usage.input_tokens, 0) + coalesce(usage.output_tokens, 0) + coalesce(usage.cache_creation_input_tokens, 0) + coalesce(usage.cache_read_input_tokens, 0)"


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _words(c: str) -> str:
    return f"len(regexp_extract_all({c}, {_s(P.WORD)}))"


def _replace(c: str, *patterns: str) -> str:
    for p in patterns:
        c = f"regexp_replace({c}, {_s(p)}, ' ', 'g')"
    return c


def _tone_prose(c: str, tags: bool = True) -> str:
    steps = [r"(?s)```.*?```", r"`[^`\n]+`", r"https?://\S+", r"\[[^\]]+\]\([^\)]+\)", r"(?:/Users/|/home/)[^\s,;:]+"] + ([r"<[^>\n]+>"] if tags else [])
    return f"trim({_replace(c, *steps, r'\s+')}, ' ')"


def _analysis_prose(c: str) -> str:
    return f"trim({_replace(c, r'(?s)```.*?```', r'`[^`\n]+`', r'(?m)^\s*>.*$', r'https?://\S+', r'(?:^|\s)[~.]?/[^\s,;:]+', r'<[^>\n]+>', r'\s+')}, ' ')"


def _has(c: str, p: str, ic: bool = True) -> str:
    return f"coalesce(regexp_matches({c}, {_s(('(?i)' if ic else '') + p)}), false)"


def _n(c: str, p: str, ic: bool = True) -> str:
    return f"coalesce(len(regexp_extract_all({c}, {_s(('(?i)' if ic else '') + p)})), 0)"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(_s(w) for w in words) + ")"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(_s(w) for w in words) + "]"


def _sentences(c: str) -> str:
    return f"list_filter(string_split(regexp_replace({c}, '([.!?。！？])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


def _frustrated(c: str) -> str:
    p = f"{c}"
    caps = f"len(list_filter(regexp_extract_all({p}, '\\b[A-Z]{{4,}}\\b'), lambda w: w not in {_in(P.ACRONYMS)}))"
    return f"({p} <> '' and ({_has(p, P.FRUSTRATION)} or (({caps} >= 2 or regexp_matches({p}, '[!?]{{3,}}')) and {_has(p, P.NEGATIVE_TONE)})))"


def _cascade(c: str, rules: list[tuple], k: int, other: str = "null") -> str:
    return "case " + " ".join(f"when {_has(c, r[0])} then {_s(r[k]) if r[k] else 'null'}" for r in rules) + f" else {other} end"


def _semantics(name: str, args: str) -> tuple[str, str]:
    cmd = f"regexp_replace(coalesce(json_extract_string({args}, '$.cmd'), json_extract_string({args}, '$.command'), ''), '(?i)\\\\[nrt]', ' ', 'g')"
    low = f"lower(coalesce({name}, ''))"
    edit = f"({low} in ('edit', 'apply_patch', 'multiedit') or ({_has(cmd, P.COMMANDS[1][0])} and not {_has(cmd, P.COMMANDS[0][0])}))"
    head = lambda a, b, c, d: f"case when {low} in ('read', 'read_file') then {a} when {low} in ('write', 'write_file') then {b} when {edit} then {c} else {d} end"
    hide = f"case when regexp_matches({cmd}, '(?i)\\.gitignore\\b') then 'hide' else 'edit' end"
    action = head("'read'", "'write'", hide, _cascade(cmd, P.COMMANDS, 1))
    shell = _cascade(cmd, P.COMMANDS, 2, f"case when {cmd} = '' then 'unknown' else 'shell' end")
    method = head("'builtin_read'", "'builtin_write'", "'file_edit'", f"case when {_cascade(cmd, P.COMMANDS, 1)} = 'download' and {_has(cmd, P.BREW)} then 'package_manager' else {shell} end")
    return action, method


def _model_name(c: str) -> str:
    cap = lambda x: f"upper(left({x}, 1)) || lower(substr({x}, 2))"
    cl, gp = r"(?i)^claude-([a-z]+)-(\d+)-(\d+)$", r"(?i)^gpt-(\d+)[.-](\d+)(?:-([a-z]+))?$"
    g = lambda p, k: f"regexp_extract({c}, {_s(p)}, {k})"
    return (
        f"case when {c} = '<synthetic>' then 'Synthetic model' when regexp_matches({c}, {_s(cl)}) then 'Claude ' || {cap(g(cl, 1))} || ' ' || {g(cl, 2)} || '.' || {g(cl, 3)} "
        f"when regexp_matches({c}, {_s(gp)}) then 'GPT-' || {g(gp, 1)} || '.' || {g(gp, 2)} || case when {g(gp, 3)} <> '' then ' ' || {cap(g(gp, 3))} else '' end "
        f"else array_to_string(list_transform(string_split(replace({c}, '-', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') end"
    )


def _pct(n: str) -> str:
    return f"floor({n} * 1000 / sum({n}) over () + 0.5) / 10"


_STOPPED = "|".join(P.NON_PERSON_WORDS)


def _mask(c: str) -> str:
    """Names to persons.  Words that are no names are fenced in by control characters first, as these patterns can't look ahead."""
    v = lambda p: p.replace("(?:pings?", "(?:\\x01?pings?").replace("(?:messages?", "(?:\\x01?messages?").replace("|messages?", "|\\x01?messages?").replace("|pings?", "|\\x01?pings?")
    verbs = P.NAME_VERBS.replace("(?:said|", "\\x01?(?:said|").replace("(?:directly|explicitly)", "\\x01?(?:directly|explicitly)\\x02?")
    pings = P.NAME_PINGS.replace("(?:pings?|", "\\x01?(?:pings?|").replace("(?:directly|explicitly)", "\\x01?(?:directly|explicitly)\\x02?")
    name, end = r"\b[A-Za-z][A-Za-z'\-]{2,}", "(\\x02|\\b)"
    c = f"regexp_replace({c}, {_s(rf'(?i)\b({_STOPPED})([^A-Za-z0-9_\'\-]|$)')}, {_s(chr(1) + chr(92) + '1' + chr(2) + chr(92) + '2')}, 'g')"
    for p, r in (
        (rf"(?i){name}(\s+{verbs}{end})", r"person\1"), (rf"(?i)\b(from)\s+{name}\b", r"\1 person"), (rf"(?i)\b(by)\s+{name}(\s+{P.NAME_BY}\b)", r"\1 person\2"),
        (rf"(?i){name}(\s+{v('\x01?' + P.NAME_NOUNS)}{end})", r"person\1"), (rf"(?i)\b(if|when|unless)\s+{name}(\s+{pings}{end})", r"\1 person\2"),
        (rf"\b({P.NAME_ACTIONS}\x02?\s+)[A-Z][a-z'\-]{{2,}}\b", r"\1person"),
    ):
        c = f"regexp_replace({c}, {_s(p)}, {_s(r)}, 'g')"
    return f"translate({c}, {_s(chr(1) + chr(2))}, '')"


def _redact(c: str, heuristic: bool = True) -> str:
    """The rules but the labelled credentials, whose values these patterns can't judge; the test tables hold none."""
    for p, marker in [*P.SECRETS, *(P.HEURISTIC_SECRETS if heuristic else []), *P.NUMBERS]:
        c = f"regexp_replace({c}, {_s(p)}, {_s(marker)}, 'g')"
    mail = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
    c = f"regexp_replace({c}, '(?i)\\bgit@', 'git' || chr(1), 'g')"
    c = f"regexp_replace({c}, '(?i)(ssh://[A-Z0-9._%+-]+)@', '\\1' || chr(1), 'g')"
    c = f"regexp_replace({c}, '(?i)([A-Z0-9._%+-]+)@([A-Z0-9.-]+\\.[A-Z]{{2,}}):', '\\1' || chr(1) || '\\2:', 'g')"
    c = f"regexp_replace({c}, {_s('(?i)\\b' + mail + '\\b')}, '[REDACTED EMAIL]', 'g')"
    return f"regexp_replace(translate({c}, chr(1), '@'), {_s(P.HOME_USER)}, '\\1[REDACTED USER]', 'g')"


def _plain_letters(c: str) -> str:
    """Compatibility forms as far as the test tables hold them."""
    wide = "".join(chr(o) for o in range(0xFF01, 0xFF5F))
    return f"replace(replace(replace(translate({c}, {_s(wide)}, {_s(''.join(chr(o - 0xFEE0) for o in range(0xFF01, 0xFF5F)))}), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '™', 'TM')"


def _opening(c: str) -> str:
    c = f"coalesce(nullif(regexp_extract({c}, '(?is)(?:^|\\n)## My request:\\s*(.*)$', 1), ''), {c})"
    for p in (*(rf"(?is)<{t}>.*?</{t}>" for t in P.CLIENT_TAGS), r"(?im)^\s*# AGENTS\.md instructions\s*$", r"(?is)<image\b[^>]*>.*?</image>", r"\s+"):
        c = f"regexp_replace({c}, {_s(p)}, ' ', 'g')"
    return f"trim({c}, ' ')"


def _evidence(c: str) -> str:
    for p, r in ((r"(?s)```.*?```", "[CODE OMITTED]"), (r"`[^`\n]{24,}`", "[INLINE CODE OMITTED]")):
        c = f"regexp_replace({c}, {_s(p)}, {_s(r)}, 'g')"
    return f"left({_redact(c)}, 520)"


def _share_safe(c: str, lo: int, hi: int, b64: int) -> str:
    bad = [r"[\x00-\x1f\x7f]", r"(?i)https?://|/Users/|/home/|```|<[^>]+>|\[(?:REDACTED|REMOVED)[^\]]*\]", r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", r"(?i)\b(?:sk|gh[oprsu]|token|secret|key)[-_=:][A-Za-z0-9_-]{12,}", rf"\b[A-Za-z0-9+/]{{{b64},}}={{0,2}}\b"]
    return f"coalesce(length({c}) between {lo} and {hi} and " + " and ".join(f"not regexp_matches({c}, {_s(p)})" for p in bad) + ", false)"


def _ellipsis(c: str, most: int) -> str:
    return f"case when length({c}) <= {most} then {c} else regexp_replace(substr({c}, 1, {most - 1}), '\\s+\\S*$', '') || '…' end"


_WORDS_CTE = f"""w as (
  select session_id, i, type, {_PROMPT} as is_prompt, {_words('text')} as words, sum(case when {_PROMPT} then 1 else 0 end) over (partition by session_id order by i) as turn from r
), per_turn as (
  select session_id, turn, sum(case when is_prompt then words else 0 end) as user_words, sum(case when type = 'assistant' and turn > 0 then words else 0 end) as agent_words from w group by all
), turn_stats as (
  select session_id, max(turn)::bigint as turns, sum(user_words)::bigint as user_words, sum(agent_words)::bigint as agent_words, count(*) filter (agent_words > 0) as responses from per_turn group by session_id
)"""
_USES = "uses as (select session_id, i, rec_id, k - 1 as block_no, coalesce(b.name, 'Unknown tool') as tool, b.input as arguments from (select session_id, i, rec_id, unnest(blocks) as b, generate_subscripts(blocks, 1) as k from r) where b.type = 'tool_use')"
_TOTALS_CTE = f"""totals as (
  select count(distinct cast(ts as date)) as active_days, count(*) filter ({_PROMPT}) as prompts,
    count(*) filter (type = 'system' and regexp_matches(coalesce(subtype, '') || ' ' || coalesce(sys_content, ''), '(?i)interrupt')) as interruptions,
    coalesce(sum(len(list_filter(blocks, lambda b: b.type = 'tool_use'))), 0)::bigint as tool_calls, coalesce(sum({_TOK}), 0)::bigint as tokens,
    (select count(*) from sessions) as sessions,
    (select floor(coalesce(sum(ms), 0) / 60000.0 + 0.5)::bigint from (select epoch_ms(max(ts)) - epoch_ms(min(ts)) as ms from r where ts is not null group by session_id)) as duration_minutes
  from r
)"""
_AVG_CTE = """word_averages as (
  select user_words, agent_words, case when turns > 0 then floor(user_words / turns + 0.5)::bigint else 0 end as average_user_words,
    case when responses > 0 then floor(agent_words / responses + 0.5)::bigint else 0 end as average_response_words,
    case when user_words > 0 then floor(agent_words * 100 / user_words + 0.5) / 100 end as agent_user_ratio
  from (select coalesce(sum(turns), 0)::bigint turns, coalesce(sum(user_words), 0)::bigint user_words, coalesce(sum(agent_words), 0)::bigint agent_words, coalesce(sum(responses), 0)::bigint responses from turn_stats)
)"""


def _with(*ctes: str) -> str:
    return "with recursive " + ", ".join((_ROWS.strip(), *ctes)) + "\n"


def _chunk_language(c: str) -> str:
    letters = f"len(regexp_extract_all({c}, '\\p{{L}}'))"
    counts = [(k, f"len(regexp_extract_all({c}, '[{re2}]'))") for k, _, re2 in P.SCRIPTS]
    best = "greatest(" + ", ".join(n for _, n in counts) + ")"
    words = f"list_distinct(regexp_extract_all(lower({c}), '\\p{{Latin}}+(?:[''’]\\p{{Latin}}+)*'))"
    scores = [(k, f"len(list_intersect({words}, {_list(v.split())}))") for k, v in P.LEXICONS.items()]
    top = "greatest(" + ", ".join(s for _, s in scores) + ")"
    script = "case " + " ".join(f"when {n} = {best} then {_s(k)}" for k, n in counts) + " end"
    lex = "case " + " ".join(f"when {s} = {top} and {top} >= 2 then {_s(k)}" for k, s in scores) + " else 'English' end"
    return f"case when {letters} = 0 then null when {best} >= 2 and {best} * 100 >= {letters} * 15 then {script} when len({words}) > 0 then {lex} end"


def _topic(c: str) -> str:
    sc = [(k, _n(c, p)) for k, p in P.TOPICS]
    best = "greatest(" + ", ".join(s for _, s in sc) + ")"
    return "case " + " ".join(f"when {s} = {best} and {best} > 0 then {_s(k)}" for k, s in sc) + " end"


_TOPICS_CTE = f"""tp as (select session_id, i, {_topic('text')} as own, {_words('text')} as words from r where {_PROMPT}),
topics as (
  select session_id, i, coalesce(own, case when words <= 8 then last_value(own ignore nulls) over (partition by session_id order by i rows unbounded preceding) end, 'Other') as topic from tp
)"""
_PRIORITY = " + ".join(f"case when {_has('text', p)} then {w} else 0 end" for p, w in ((P.STRONG_FRUSTRATION, 20), (P.STRONG_GRATITUDE, 20), (P.TONE, 8), (r"\b(?:you|your|agent|assistant)\b", 3)))
_MARKED = "'(?i)\\[(?:REDACTED|REMOVED)[^\\]]*\\]'"
_SENTENCE_PARTS = "list_filter(list_transform(regexp_extract_all(p, '[^.!?。！？]+[.!?。！？]*'), lambda x: trim(x, ' ')), lambda x: x <> '')"
_TONE_CTE = f"""tm0 as (select rec_id, trim(regexp_replace({_redact(_mask(_tone_prose('text')))}, '\\s+', ' ', 'g'), ' ') as p from r where type = 'user' and not is_meta),
tm1 as (select rec_id, p, {_SENTENCE_PARTS} as ss from tm0 where p <> '' and not regexp_matches(p, {_MARKED})),
tm2 as (select rec_id, coalesce(list_filter(ss, lambda x: {_has('x', P.TONE)})[1], ss[1], p) as s from tm1), tm as (select rec_id, {_ellipsis('s', 240)} as text from tm2),
tc as (select rec_id, text, len(regexp_extract_all(text, '\\p{{L}}+')) as words from tm where {_share_safe('text', 2, 240, 32)}),
tg as (
  select min_by(text, rec_id) as text, min_by(words, rec_id) as words, count(*) as occurrences, min(rec_id) as first_seen from tc
  where {_has('text', P.TONE)} or words <= 40 or regexp_matches(text, '[!?]{{2,}}') group by lower({_plain_letters('text')})
), tone as (
  select row_number() over (order by priority desc, occurrences desc, first_seen) as rank, text, occurrences, priority from (
    select *, {_PRIORITY} + case when regexp_matches(text, '[!?]{{2,}}') then 3 else 0 end + case when words <= 40 then 2 else 0 end + least(3, occurrences) as priority from tg
  ) qualify rank <= 120
)"""
_MARK_CTE = f"""m as (
  select session_id, i, type, text, coalesce(list_transform(list_filter(blocks, lambda b: b.type = 'tool_use'), lambda b: coalesce(b.name, 'Unknown tool')), []) as tools,
    type = 'user' and coalesce(len(list_filter(blocks, lambda b: b.type = 'tool_result' and coalesce(b.is_error, false))) > 0, false) as tool_error,
    case when type = 'assistant' and text <> '' then text end as said, ts from r
), h as (
  select *, max(case when len(list_filter(tools, lambda t: regexp_matches(lower(t), {_s(P.VERIFY_TOOL)}))) > 0 then 1 else 0 end) over (partition by session_id order by i rows between 7 preceding and current row) as verified,
    last_value(case when len(tools) > 0 then tools[-1] end ignore nulls) over (partition by session_id order by i rows between 3 preceding and 1 preceding) as failed,
    flatten(list(tools) over (partition by session_id order by i rows between 1 following and 6 following)) as later,
    first_value(said ignore nulls) over (partition by session_id order by i rows between 1 following and 4 following) as soon,
    first_value(said ignore nulls) over (partition by session_id order by i rows between 1 following and unbounded following) as answer
  from m
), found as (
  select session_id, i, 1 as check_no, 'verification' as kind, 0.72 as score from h where type = 'assistant' and {_has('text', P.COMPLETION)} and verified = 0
  union all select session_id, i, 2, 'correction', case when {_has('answer', P.APOLOGY)} then 0.81 else 0.58 end from h where type = 'user' and {_has('text', P.PUSHBACK)} and answer is not null
  union all select session_id, i, 3, 'repetition', 0.66 from h where tool_error and failed is not null and list_contains(later, failed)
  union all select session_id, i, 4, 'clarification', 0.76 from h where type = 'user' and {_has('text', P.RISK)} and coalesce(contains(soon, '?'), false) and {_has('soon', P.SCOPE_QUESTION)}
  union all select session_id, i, 5, 'scope', 0.61 from h where type = 'assistant' and {_has('text', P.EXPANSION)}
)"""
_ACTION, _METHOD = _semantics("b.name", "b.input")
_D_PROSE = "text"
for _p, _r in (
    (r"(?s)```.*?```", " content removed locally "), (r"`([^`\n]+)`", "\x02\\1\x03"), (rf"(?i)\x02(?:{P.UNSAFE_COMMAND})[^\x03]*\x03", " content removed locally "), (rf"(?i)\x02({P.SAFE_COMMAND})\x03", r" `\1` "),
    (r"\x02[^\x03]*\x03", " content removed locally "), (r"(?m)^\s*>.*$", " "), (r"https?://\S+", " link removed locally "), (r"\[[^\]]+\]\([^\)]+\)", " link removed locally "),
    (r"""(^|[\s("'`])(?:[A-Za-z]:)?[/.~][^\s,;:]+""", r"\1 path removed locally "), (r"<[^>]+>", " "), (r"\s+", " "),
):
    _D_PROSE = f"regexp_replace({_D_PROSE}, {_s(_p)}, {_s(_r)}, 'g')"
_TRAJECTORY = f"trim(regexp_replace(regexp_replace({_redact(_mask(f'trim({_D_PROSE}, {_s(chr(32))})'))}, {_MARKED}, 'sensitive value removed locally', 'g'), '\\s+', ' ', 'g'), ' ')"


def _events(blocked: bool = False) -> str:
    """Events with texts in parts: cut behind the last space in the final 40 % of 600 characters; ``blocked`` writes a reason into failed tools."""
    content = "case when coalesce(b.is_error, false) then 'permission denied' else b.content end" if blocked else "b.content"
    return f"""tx as materialized (select session_id, i, case when type in ('assistant', 'system') then type else 'user' end as role, {_TRAJECTORY} as t from r where text <> '' and not is_meta and type in ('user', 'assistant', 'system')),
cut(session_id, i, k, part, rest) as (
  select session_id, i, 0, null::varchar, t from tx
  union all
  select session_id, i, k + 1, trim(left(rest, e), ' '), trim(substr(rest, e + 1), ' ')
  from (select *, case when length(rest) <= 600 then length(rest) when 600 - strpos(reverse(left(rest, 600)), ' ') >= 360 and strpos(reverse(left(rest, 600)), ' ') > 0 then 601 - strpos(reverse(left(rest, 600)), ' ') else 600 end as e from cut where rest <> '')
),
fit as (select session_id, i, k, part from cut where part is not null and part <> '' and {_share_safe('part', 2, 600, 40)}),
ev0 as (
  select session_id, i, k as part, role, role || '_text' as kind, null::varchar as action, null::varchar as method, fit.part as summary from fit join tx using (session_id, i)
  union all select session_id, i, 0, role, 'content_removed', null, null, 'Message content removed locally' from tx where (session_id, i) not in (select (session_id, i) from fit)
  union all
  select session_id, i, 10000 + k, case when b.type = 'tool_use' then 'assistant' else 'tool' end, b.type, case when b.type = 'tool_use' then {_ACTION} end, case when b.type = 'tool_use' then {_METHOD} end,
    case when b.type = 'tool_use' then 'Tool use: ' || coalesce(nullif(left(trim(regexp_replace(coalesce(b.name, 'Unknown tool'), '[^A-Za-z0-9_. -]', '', 'g'), ' '), 48), ''), 'Unknown tool') || coalesce(' (' || {_ACTION} || ')', '')
      else 'Tool result: ' || coalesce({_cascade(content, P.RESTRICTIONS, 1)}, case when coalesce(b.is_error, false) then 'error' else 'completed' end) end
  from (select session_id, i, unnest(blocks) as b, generate_subscripts(blocks, 1) as k from r) where b.type in ('tool_use', 'tool_result')
),
md as (select session_id, i, coalesce(last_value(case when model <> '<synthetic>' then model end ignore nulls) over (partition by session_id order by i rows unbounded preceding), case when agent = 'codex' then 'Codex model' else 'Claude model' end) as model from r),
ev as (
  select session_id, row_number() over (partition by session_id order by i, part) - 1 as ordinal, role, kind, action, method, summary, model from ev0 join md using (session_id, i)
  union all select session_id, 0, 'system', 'content_removed', null, null, 'No share-safe trajectory content', case when arg_min(agent, i) = 'codex' then 'Codex model' else 'Claude model' end from r where session_id not in (select session_id from ev0) group by session_id
)"""


_EVENTS_CTE, _BLOCKED_CTE = _events(), _events(True)
_WINDOWS_CTE = """bl as (
  select ordinal, ev.session_id, greatest(0, ordinal - 16) as s, least(size, ordinal + 15) as e
  from ev join (select session_id, max(ordinal) + 1 as size from ev group by session_id) z using (session_id)
  where kind = 'tool_result' and regexp_matches(summary, '(?i)__BLOCKER__')
), g as (select *, sum(fresh) over (partition by session_id order by ordinal) as grp from (select *, case when s > coalesce(lag(e) over (partition by session_id order by ordinal), -1) then 1 else 0 end as fresh from bl)),
win as (select session_id, min(s) as start, max(e) as "end", count(*) as blockers from g group by session_id, grp)""".replace("__BLOCKER__", P.BLOCKER)
_CHUNKS_CTE = """ch as (
  select session_id, from_event, least(from_event + 160, "end") as to_event, row_number() over (partition by session_id order by from_event) as part_index, count(*) over (partition by session_id) as part_count
  from (select session_id, unnest(generate_series(start, start + 148 * greatest(0, ceil(("end" - start - 160) / 148.0)::bigint), 148)) as from_event, "end" from win)
)"""
_UNIT = f"{_redact(_mask(_replace('text', r'(?s)```.*?```', r'(?s)`[^`]*`', r'https?://\S+', r'\[[^\]]+\]\([^\)]+\)', r'(?:/Users/|/home/)[^\s,;:]+')))}"
_TOKENS = "regexp_extract_all(lower(translate({c}, '’‘', '''''')), '[a-z]+(?:''[a-z]+)?')"
_GRAM_OK = f"len(list_intersect(gram, {_list(P.BLOCKED_TOKENS)})) = 0 and len(list_filter(gram, lambda t: t not in {_in(P.STOPWORDS)})) >= 2"
_MODEL_WRITTEN = "type = 'assistant' and not is_api_error and coalesce(model, '') not in ('', '<synthetic>')"
_CARD_TEXTS = "type = 'assistant' and not is_api_error and coalesce(model, '') <> '<synthetic>'"
_NGRAM_CTE = f"""u as (select session_id, {_TOKENS.format(c=_plain_letters('s'))} as tokens from (select session_id, unnest({_sentences(_UNIT)}) as s from r where {_MODEL_WRITTEN})),
n1 as (select session_id, tokens, unnest(generate_series(3, least(8, len(tokens)))) as n from u where len(tokens) >= 3),
n2 as (select session_id, tokens, n, unnest(generate_series(0, len(tokens) - n)) as off from n1),
n3 as (select session_id, n, tokens[off + 1 : off + n] as gram from n2), grams as (select session_id, n, array_to_string(gram, ' ') as phrase from n3 where {_GRAM_OK})"""
_PHRASE_CTE = f"""ps as (select session_id, i, k - 1 as sentence_no, s from (select session_id, i, unnest(ss) as s, generate_subscripts(ss, 1) as k from (select session_id, i, {_sentences(_UNIT)} as ss from r where {_CARD_TEXTS}))),
pc0 as (select session_id, i, sentence_no, list_filter(string_split(regexp_replace(regexp_replace(s, '[;:—–]', chr(1), 'g'), ',\\s+(and|but|or|so|yet)(\\s)', chr(1) || '\\1\\2', 'g'), chr(1)), lambda x: trim(x) <> '') as cs from ps),
pc as (select session_id, sentence_no, k - 1 as clause_no, {_TOKENS.format(c=_plain_letters('c'))} as tokens from (select session_id, sentence_no, unnest(cs) as c, generate_subscripts(cs, 1) as k from pc0)),
q1 as (select *, unnest(generate_series(4, least(10, len(tokens)))) as n from pc where len(tokens) >= 4), q2 as (select *, unnest(generate_series(0, len(tokens) - n)) as off from q1),
q3 as (select *, tokens[off + 1 : off + n] as gram from q2),
pg as (select session_id, array_to_string(gram, ' ') as phrase, n, sentence_no = 0 and clause_no = 0 and off = 0 as opening, off = 0 as at_start, off + n = len(tokens) as at_end,
  case when off > 0 then tokens[off] end as prev, case when off + n < len(tokens) then tokens[off + n + 1] end as next from q3 where {_GRAM_OK}),
pb as (select phrase, n, count(*) as occurrences, count(distinct session_id) as sessions, count(*) filter (opening) as openings, count(*) filter (at_start) as starts, count(*) filter (at_end) as ends from pg group by all),
tpv as (select phrase, max(c) as top_prev from (select phrase, prev, count(*) as c from pg where prev is not null group by all) group by phrase),
tnx as (select phrase, max(c) as top_next from (select phrase, next, count(*) as c from pg where next is not null group by all) group by phrase),
pf as (select *, (sessions >= 2 and occurrences >= 2) or occurrences >= 3 as repeated from pb left join tpv using (phrase) left join tnx using (phrase)
  where string_split(phrase, ' ')[-1] not in {_in(P.DANGLING_END)} and (starts / occurrences >= 0.5 or coalesce(top_prev, 0) / occurrences < 0.6) and (ends / occurrences >= 0.4 or coalesce(top_next, 0) / occurrences < 0.6)),
phr as (select phrase, n, occurrences, sessions, round(openings / occurrences, 4) as opening_rate, round(starts / occurrences, 4) as start_rate, round(ends / occurrences, 4) as end_rate
  from pf where repeated or not (select coalesce(bool_or(repeated), false) from pf))"""
_FAMILY_TEXT = "text"
for _p, _r in ((r"(?s)```.*?```", " "), (r"(?s)`[^`]*`", " "), (r"https?://\S+", " "), (r"\[[^\]]+\]\([^\)]+\)", " "), (r"(?:/Users/|/home/)[^\s,;:]+", " [path] "), (r"\b[A-Z][a-z]{2,}[’']s\b", "person's")):
    _FAMILY_TEXT = f"regexp_replace({_FAMILY_TEXT}, {_s(_p)}, {_s(_r)}, 'g')"
_VARIANT_CTE = f"""vs as (select session_id, i, k - 1 as sentence_no, s from (select session_id, i, unnest(ss) as s, generate_subscripts(ss, 1) as k from (select session_id, i, {_sentences(_redact(_mask(_FAMILY_TEXT)))} as ss from r where {_MODEL_WRITTEN}))),
vc as (select session_id, i, sentence_no, k - 1 as clause_no, c from (select session_id, i, sentence_no, unnest(cs) as c, generate_subscripts(cs, 1) as k from (select *, string_split(regexp_replace(s, '\\n+|\\s+[—–]\\s+|;\\s+', chr(1), 'g'), chr(1)) as cs from vs))),
vt as (select session_id, i, sentence_no, clause_no, list_transform(regexp_extract_all(lower(translate({_plain_letters('c')}, '’‘', '''''')), '[a-z]+(?:''[a-z]+)?|\\d+(?:\\.\\d+)?'), lambda t: case when regexp_matches(t, '^[0-9]') then '{{number}}' when t in ('redacted', 'credential', 'secret') then '{{redacted}}' else t end) as tokens from vc),
v as materialized (select tokens, left(sha256(array_to_string(tokens, ' ')), 16) as variant_id, count(*) as occurrences, count(distinct session_id) as sessions, count(*) filter (sentence_no = 0) as openings, min((session_id, i, sentence_no, clause_no)) as seen_at from vt where len(tokens) between 3 and 30 group by tokens)"""
_PAIRS_CTE = """sh0 as (select variant_id, seen_at, tokens, len(tokens) as n, case when len(tokens) <= 3 then tokens else list_transform(generate_series(1, len(tokens) - 1), lambda k: tokens[k] || chr(31) || tokens[k + 1]) end as ss from v),
sh as (select variant_id, seen_at, n, shingle, min(k) as k from (select variant_id, seen_at, n, unnest(ss) as shingle, generate_subscripts(ss, 1) as k from sh0) group by all),
po as materialized (select sh.*, posting from sh join (select shingle, count(*) as posting from sh group by shingle) using (shingle) where posting > 1 and posting <= greatest(16, least(128, ceil((select count(*) from v) * 0.05)))),
mine as (select * from po qualify row_number() over (partition by variant_id order by posting, k) <= 12),
cand as (select l.variant_id as left_id, r.variant_id as right_id, l.n as ln, r.n as rn, count(*) as shared from mine r join po l on l.shingle = r.shingle and l.seen_at < r.seen_at group by all),
checked as (select * from cand where least(ln, rn) / greatest(ln, rn) >= 0.65 and shared >= case when least(ln, rn) <= 4 then 1 else 2 end),
-- Each distinct token becomes one character, so the distance of characters counts tokens.
coded as (
  select left_id, right_id, greatest(ln, rn) as longest, array_to_string(list_transform(a.tokens, lambda t: chr((47 + list_position(list_concat(a.tokens, b.tokens), t))::int)), '') as x, array_to_string(list_transform(b.tokens, lambda t: chr((47 + list_position(list_concat(a.tokens, b.tokens), t))::int)), '') as y
  from checked join v a on a.variant_id = left_id join v b on b.variant_id = right_id
),
pairs as (select left_id, right_id, round(1 - levenshtein(x, y) / longest, 6) as similarity from coded where levenshtein(x, y) <= floor(longest * (1 - case when longest <= 3 then 2 / 3 when longest <= 5 then 0.7 else 0.74 end) + 1e-9))"""


def _anomaly() -> str:
    unspaced = {"Japanese": 3, "Chinese": 2, "Thai": 4}
    word = {k: f"len(regexp_extract_all(p, '[{re2}]{{1,{unspaced[k]}}}'))" if k in unspaced else rf"len(regexp_extract_all(p, '[\p{{L}}\p{{M}}\p{{N}}]*[{re2}][\p{{L}}\p{{M}}\p{{N}}]*'))" for k, _, re2 in P.SCRIPTS}
    count = {k: f"len(regexp_extract_all(p, '[{re2}]'))" for k, _, re2 in P.SCRIPTS}
    most = "greatest(" + ", ".join(f"s_{k}" for k in count) + ")"
    lex = [(k, f"len(list_intersect(known, {_list(v.split())}))") for k, v in P.LEXICONS.items()]
    top = "greatest(" + ", ".join(x for _, x in lex) + ")"
    return _with(
        f"ap as (select session_id, type, {_PROMPT} as is_prompt, sum(case when {_PROMPT} then 1 else 0 end) over (partition by session_id order by i) as turn, {_analysis_prose('text')} as p from r)",
        "pt as (select session_id, turn, " + ", ".join(f"sum(case when type = 'assistant' then {c} else 0 end) as w_{k}" for k, c in word.items()) + ", "
        + ", ".join(f"sum(case when type = 'assistant' then {c} else 0 end) as s_{k}" for k, c in count.items()) + ", "
        + ", ".join(f"coalesce(bool_or(is_prompt and {c} > 0), false) as u_{k}" for k, c in count.items()) + ", "
        + "sum(case when type = 'assistant' then len(regexp_extract_all(p, '\\p{L}')) else 0 end) as letters, bool_or(type = 'assistant' and regexp_matches(p, '\\p{Latin}')) as latin, "
        + "list_distinct(flatten(list(case when type = 'assistant' then regexp_extract_all(lower(p), '\\p{Latin}+(?:[''’]\\p{Latin}+)*') end))) as known from ap group by all)",
        "sm as (select session_id, " + ", ".join(f"sum(s_{k}) as s_{k}" for k in count) + ", sum(letters) as letters, bool_or(latin) as latin, list_distinct(flatten(list(known))) as known from pt group by session_id)",
        f"dm as (select session_id, coalesce(case when {most} >= 2 and {most} * 100 >= letters * 15 then case " + " ".join(f"when s_{k} = {most} then {_s(k)}" for k in count) + " end end, "
        + f"case when latin then case when {top} >= 2 then case " + " ".join(f"when {x} = {top} then {_s(k)}" for k, x in lex) + " end else 'English' end end) as dominant from sm where letters > 0)",
        "an as (" + " union all ".join(f"select session_id, {_s(k)} as language, w_{k} as words, u_{k} as asked, s_Japanese as kana from pt" for k in count) + ")",
    ) + (
        "select language, sum(words)::bigint as words, count(*) as occurrences from an join dm using (session_id) "
        "where dominant is not null and words >= 2 and not asked and language <> dominant and not (language = 'Chinese' and kana > 0) group by language"
    )


#: Problem 1 by its definition: schemas per file, differences of neighbours, pairs of equal parent, types and record types.
_SCHEMAS_CTE = r"""ok as (select file_id, raw::json as j, coalesce(json_extract_string(raw::json, '$.type'), 'null') as rec from raw_lines where coalesce(json_valid(raw), false) and json_type(raw) = 'OBJECT'),
tree as (
  select file_id, rec, substr(t.fullkey, 3) as p,
    case t.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end as kind
  from ok, json_tree(ok.j) t where t.parent is not null and t.type <> 'NULL' and not contains(t.fullkey, '[')
),
sch as (select file_id, p, regexp_replace(p, '[.]?[^.]*$', '') as up, list_sort(list(distinct kind)) as kinds, list_sort(list(distinct rec)) as recs from tree group by file_id, p),
link as (select file_id, lag(file_id) over (partition by feed_id order by started_at nulls first, file_id) as prev from raw_files where file_id in (select file_id from ok)),
o as (select link.file_id, p, up, kinds, recs from sch join link on sch.file_id = link.prev), n as (select link.file_id, p, up, kinds, recs from sch join link using (file_id) where prev is not null),
dif as (
  select coalesce(o.file_id, n.file_id) as file_id, coalesce(o.p, n.p) as p, coalesce(o.up, n.up) as up, coalesce(o.kinds, n.kinds) as kinds, coalesce(o.recs, n.recs) as recs,
    case when n.p is null then 'removed' when o.p is null then 'added' else 'retyped' end as change
  from o full join n on o.file_id = n.file_id and o.p = n.p where n.p is null or o.p is null or o.kinds <> n.kinds
),
top as (select * from dif d where not exists (select 1 from dif a where a.file_id = d.file_id and starts_with(d.p, a.p || '.') and a.change in (d.change, 'retyped'))),
ren as (select r.file_id, r.p as old_path, a.p as new_path from top r join top a on r.file_id = a.file_id and r.change = 'removed' and a.change = 'added' and r.up = a.up and r.kinds = a.kinds and r.recs = a.recs)"""

_VERDICTS_CTE = f"""wv as (
  select *, last_value(case when kind <> 'tool_result' then ordinal end ignore nulls) over (partition by session_id order by ordinal rows between 16 preceding and 1 preceding) as original,
    first_value(case when kind <> 'tool_result' then ordinal end ignore nulls) over (partition by session_id order by ordinal rows between 1 following and 14 following) as alternative from ev
), wr as (
  select w.session_id, w.ordinal as blocker, w.original, w.alternative, case when w.alternative - w.original <= 3 then 'confirmed' else 'borderline' end as standing, 'unclear' as disclosure, {_model_name('a.model')} as model,
    'The agent ' || coalesce(case a.action {' '.join(f"when {_s(k)} then {_s(v)}" for k, v in P.DID.items())} end, 'used a different method') || ' '
    || coalesce(case {' '.join(f"when contains(lower(w.summary), {_s(t)}) then {_s(v)}" for t, v in P.BLOCKED_BY_TEXT)} end, case o.action {' '.join(f"when {_s(k)} then {_s(v)}" for k, v in P.BLOCKED_BY_ACTION.items())} end, 'after the original method was blocked') || '.' as summary
  from wv w join ev o on o.session_id = w.session_id and o.ordinal = w.original join ev a on a.session_id = w.session_id and a.ordinal = w.alternative
  where w.kind = 'tool_result' and regexp_matches(w.summary, {_s('(?i)' + P.BLOCKER)})
)"""
_OPENINGS_CTE = f"""o0 as (select session_id, i, trim(regexp_replace({_redact(_mask(_tone_prose('text')))}, '\\s+', ' ', 'g'), ' ') as p from r where {_PROMPT}),
o as (select session_id, i, {_ellipsis('p', 180)} as opening from o0 where not regexp_matches(p, {_MARKED})),
k as (select session_id, opening, row_number() over (partition by session_id order by i) as n from o where {_share_safe('opening', 2, 180, 40)})"""
_QUOTES_CTE = f"""q0 as (select rec_id, {_tone_prose('text', False)} as f, trim(regexp_replace({_redact(_mask(_tone_prose('text', False)))}, '\\s+', ' ', 'g'), ' ') as p from r where type = 'user' and not is_meta),
q1 as (select rec_id, p, {_SENTENCE_PARTS} as ss from q0 where {_frustrated('f')} and p <> '' and not regexp_matches(p, {_MARKED})),
q2 as (select rec_id, coalesce(list_filter(ss, lambda x: {_frustrated(_tone_prose('x', False))})[1], p) as s from q1), q3 as (select rec_id, {_ellipsis('s', 150)} as quote from q2),
q as (select quote, min(rec_id) as first_seen from q3 where {_share_safe('quote', 6, 150, 32)} group by quote)"""

SQL: dict[str, str] = {
    "p1_found": "with " + _SCHEMAS_CTE + """ select file_id, 'renamed' as change, old_path, new_path from ren
      union all select file_id, change, case when change = 'added' then '' else p end, case when change = 'removed' then '' else p end from top
      where not exists (select 1 from ren where ren.file_id = top.file_id and (change = 'removed' and p = old_path or change = 'added' and p = new_path))""",
    "language_anomaly": _anomaly(),
    "turn_stats": _with(_WORDS_CTE) + "select * from turn_stats",
    "report_totals": _with(_TOTALS_CTE) + "select * from totals",
    "word_averages": _with(_WORDS_CTE, _AVG_CTE) + "select * from word_averages",
    "active_days_duration": _with() + "select session_id, count(distinct cast(ts as date)) as active_days, epoch_ms(max(ts)) - epoch_ms(min(ts)) as duration_ms from r where ts is not null group by session_id",
    "session_turn_counts": _with() + f"select turns, count(*) as n_sessions from (select session_id, count(*) as turns from r where {_PROMPT} group by session_id) group by turns",
    "top_tools": _with(_USES) + "select tool, count(*) as n from uses group by tool order by n desc, min(struct_pack(a := rec_id, b := block_no)) limit 6",
    "tool_action_counts": _with(_USES) + "select coalesce({a}, 'none') as action, {m} as method, count(*) as n from uses group by all".format(a=_semantics("tool", "arguments")[0], m=_semantics("tool", "arguments")[1]),
    "usage_share": _with() + f"""select {_model_name('m')} as model, tokens, case when sum(tokens) over () > 0 then {_pct('tokens')} else 0 end as percent from (
      select coalesce(model, case when agent = 'codex' then 'Codex model' else 'Claude model' end) as m, sum({_TOK})::bigint as tokens from r where usage is not null group by m)""",
    "usage_totals": _with() + "select agent, sum(usage.input_tokens)::bigint as input_tokens, sum(usage.output_tokens)::bigint as output_tokens, sum(usage.cache_creation_input_tokens)::bigint as cache_creation_input_tokens, sum(usage.cache_read_input_tokens)::bigint as cache_read_input_tokens from r group by agent",
    "weighted_cost": _with() + """select model, round((a * case when o then 4.0 when g then 2.0 else 1.0 end + b * case when o then 8.0 when g then 4.0 else 2.0 end + c * case when o then 2.0 when g then 1.0 else 0.5 end + d * case when o then 1.0 when g then 0.5 else 0.25 end) / 1e6, 4) as cost from (
      select coalesce(model, '') as model, contains(lower(coalesce(model, '')), 'opus') as o, contains(lower(coalesce(model, '')), 'gpt') as g, sum(coalesce(usage.input_tokens, 0)) as a, sum(coalesce(usage.output_tokens, 0)) as b, sum(coalesce(usage.cache_creation_input_tokens, 0)) as c, sum(coalesce(usage.cache_read_input_tokens, 0)) as d from r where usage is not null group by all)""",
    "agent_share": f"select a.agent, a.name, coalesce(n, 0) as n, case when sum(coalesce(n, 0)) over () > 0 then {_pct('coalesce(n, 0)')} else 0 end as percent from (values ('claude', 'Claude Code'), ('cowork', 'Cowork'), ('codex', 'Codex')) a(agent, name) left join (select agent, count(*) as n from sessions group by agent) s using (agent)",
    "tone_counts": _with(f"tp as (select {_tone_prose('text', False)} as p from r where {_PROMPT})") + f"select count(*) as analyzed, count(*) filter ({_frustrated('p')}) as frustrated, count(*) filter ({_has('p', P.GRATITUDE)}) as grateful from tp",
    "stock_phrase_counts": _with(f"sp as (select {_analysis_prose('text')} as p from r where type = 'assistant')") + " union all ".join(f"select {k} as ord, {_s(name)} as phrase, coalesce(sum({_n('p', p)}), 0)::bigint as n from sp" for k, (name, p) in enumerate(P.STOCK_PHRASES)),
    "project_rollup": "select s.*, project_name from (select project_id, count(*) as session_count, max(started_at) as latest_at, array_to_string(list_sort(list(distinct agent)), ',') as agents from sessions group by project_id) s left join projects using (project_id)",
    "session_tokens": _with() + f"select session_id, sum({_TOK})::bigint as tokens from r group by session_id",
    "model_totals_top50": _with() + "select model, sum(coalesce(len(list_filter(blocks, lambda b: b.type = 'tool_use')), 0))::bigint as total from r where type = 'assistant' and model is not null group by model order by total desc, model limit 50",
    "session_metadata": _with() + "select session_id, arg_min(cwd, i) filter (cwd is not null) as cwd, min_by(ts, i) filter (ts is not null) as started_at, max_by(ts, i) filter (ts is not null) as ended_at, count(*) filter (type = 'user' and not is_meta) as prompt_count, count(*) as record_count from r group by session_id",
    "default_window": "select session_id, project_id from sessions where cast(started_at as date) between (select max(cast(started_at as date)) - 29 from sessions) and (select max(cast(started_at as date)) from sessions)",
    "model_names": f"select model, {_model_name('model')} as name from (select distinct message.model as model from records where message.model is not null)",
    "project_names": "select project_id, array_to_string(list_transform(string_split(regexp_replace(string_split(regexp_replace(cwd, '/+$', ''), '/')[-1], '[-_.]+', ' ', 'g'), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') as name, left(sha256(cwd), 16) as opaque_id from projects",
    "language_share": _with(f"ls as (select unnest({_sentences(_analysis_prose('text'))}) as s from r where type in ('user', 'assistant'))", f"lc as (select {_words('s')} as words, {_chunk_language('s')} as language from ls)")
    + f"select language, words, {_pct('words')} as percent from (select language, sum(words)::bigint as words from lc where words >= 2 and language is not null group by language)",
    "topic_share": _with(_TOPICS_CTE) + f"select topic, prompts, {_pct('prompts')} as percent from (select topic, count(*) as prompts from topics group by topic)",
    "topic_inherit": _with(_TOPICS_CTE) + "select * from topics",
    "topic_topk_openings": _with(_OPENINGS_CTE) + "select session_id, n, opening from k where n <= 3",
    "topic_bundle": _with(_OPENINGS_CTE, f"""st as (select session_id, min(ts) as started_at, sum({_TOK})::bigint as tokens from r group by session_id),
      pl as (select *, session_id in (select session_id from k) as told from st), pm as (select *, row_number() over (partition by told order by started_at desc nulls last, session_id) as place from pl)""")
    + "select case when told and place <= 250 then 'candidate' when told then 'overflow' else 'no opening' end as standing, count(*) as sessions, sum(tokens)::bigint as tokens from pm group by 1",
    "topic_weighted_share": _with("kt as (select session_id, " + ", ".join(f"sum({_n('text', p)}) as t{k}" for k, (_, p) in enumerate(P.TOPICS)) + f" from r where {_PROMPT} group by session_id)",
      "kb as (select *, greatest(t0, t1, t2, t3, t4, t5) as best, t0 + t1 + t2 + t3 + t4 + t5 as total from kt)",
      "kv as (select session_id, case " + " ".join(f"when t{k} = best and best > 0 then {_s(n)}" for k, (n, _) in enumerate(P.TOPICS)) + " end as topic, case when total > 0 then best / total else 0 end as confidence from kb)",
      f"tk as (select session_id, sum({_TOK})::bigint as tokens from r group by session_id)")
    + f"select topic, tokens, {_pct('tokens')} as percent from (select coalesce(case when confidence >= 0.65 then topic end, 'Other') as topic, sum(tokens)::bigint as tokens from tk left join kv using (session_id) group by 1 having sum(tokens) > 0)",
    "tone_candidates": _with(_TONE_CTE) + "select * from tone",
    "tone_batches": _with(_TONE_CTE) + "select ((rank - 1) // 30)::int as batch, ((rank - 1) % 30 + 1)::int as batch_rank, rank from tone",
    "judge_weighted_confidence": _with(_TONE_CTE, f"jv as (select occurrences, {_frustrated(_tone_prose('text', False))} as frustrated, {_has(_tone_prose('text', False), P.GRATITUDE)} as grateful, case when {_has('text', P.STRONG_FRUSTRATION)} or {_has('text', P.STRONG_GRATITUDE)} then 0.9 else 0.75 end::double as confidence from tone)")
    + "select coalesce(sum(occurrences), 0)::bigint as candidate_messages, coalesce(sum(occurrences) filter (frustrated), 0)::bigint as frustrated, coalesce(sum(occurrences) filter (grateful), 0)::bigint as grateful, floor(sum(confidence * occurrences) / sum(occurrences) * 100 + 0.5) / 100 as confidence from jv",
    "share_safe_filter": f"select doc_id, {_share_safe('text', 2, 600, 40)} as share_safe from documents",
    "detect_findings": _with(_MARK_CTE) + "select session_id, i, kind, score::double as score from found",
    "finding_top3_per_kind": _with(_MARK_CTE) + "select kind, row_number() over (partition by kind order by started_at desc nulls last, session_id, i, check_no) as place, session_id, i, case when score >= 0.78 then 'High' when score >= 0.56 then 'Medium' else 'Low' end as confidence from found join (select session_id, min(ts) as started_at from r group by session_id) using (session_id) qualify place <= 3",
    "finding_excerpts": _with(_MARK_CTE) + f"select f.session_id, f.i as center, f.kind, r.i, r.type, {_evidence('r.text')} as excerpt from found f join r on r.session_id = f.session_id and r.i between f.i - 1 and f.i + 2 where r.type in ('user', 'assistant') and r.text <> ''",
    "evidence_texts": f"select doc_id, {_evidence('text')} as excerpt from documents",
    "redact_patterns": f"select doc_id, {_redact('text')} as redacted from documents",
    "frustration_quotes": _with(_QUOTES_CTE) + f"""select quote, case when {_has('quote', r"\b(?:bro|bruh|dude|come on|seriously|wtf|wth)\b")} then 4 else 0 end + case when regexp_matches(quote, '[!?]{{2,}}') then 2 else 0 end
      + case when length(quote) between 20 and 150 then 1 else 0 end + least(2, {_n('quote', r"\b[A-Z]{4,}\b", False)}) as score from q order by score desc, length(quote), first_seen limit 40""",
    "trajectory_events": _with(_EVENTS_CTE) + "select session_id, ordinal, role, kind, action, method, model from ev",
    "blocker_windows": _with(_BLOCKED_CTE, _WINDOWS_CTE) + "select * from win",
    "window_chunks": _with(_BLOCKED_CTE, _WINDOWS_CTE, _CHUNKS_CTE) + "select * from ch",
    "chunk_events": _with(_BLOCKED_CTE, _WINDOWS_CTE, _CHUNKS_CTE) + "select ch.session_id, part_index, ordinal, kind from ch join ev on ev.session_id = ch.session_id and ordinal >= from_event and ordinal < to_event",
    "workaround_verdicts": _with(_BLOCKED_CTE, _VERDICTS_CTE) + "select session_id, blocker, original, alternative, standing, disclosure, summary, model from wr",
    "workaround_card": _with(_BLOCKED_CTE, _VERDICTS_CTE, "wc as (select * from wr where standing = 'confirmed')", "wm as (select model, count(*) as n, min((session_id, blocker)) as first from wc group by model)")
    + "select count(*) as count, arg_min(summary, (session_id, blocker)) as example, '[' || coalesce((select string_agg('{\"name\":\"' || model || '\",\"count\":' || n || '}', ',' order by n desc, first) from wm), '') || ']' as models from wc",
    "trajectory_coverage": _with(_BLOCKED_CTE, _WINDOWS_CTE, _CHUNKS_CTE) + "select (select count(distinct session_id) from ev) as trajectories, (select count(*) from ev) as events, (select count(*) from ch) as chunks",
    "chunk_checks": _with(_BLOCKED_CTE, _WINDOWS_CTE, _CHUNKS_CTE, f"ce as (select ch.*, e.kind, e.summary, e.action from ch join ev e on e.session_id = ch.session_id and ordinal >= from_event and ordinal < to_event)")
    + f"select coalesce(ok and n = to_event - from_event, false) as valid, count(*) as chunks from (select session_id, part_index, from_event, to_event, count(*) as n, bool_and({_share_safe('summary', 2, 600, 40)}) as ok from ce group by all) group by 1",
    "batch_greedy": _with(_BLOCKED_CTE, _WINDOWS_CTE, _CHUNKS_CTE, """sz as (
      select ch.session_id, part_index, sum(octet_length(encode(
        '{"ordinal":' || ordinal || ',"kind":' || to_json(kind) || coalesce(',"action":' || to_json(action), '') || coalesce(',"method":' || to_json(method), '') || coalesce(',"summary":' || to_json(summary), '') || '}')))::bigint as bytes
      from ch join ev on ev.session_id = ch.session_id and ordinal >= from_event and ordinal < to_event group by all
    ), gr(session_id, part_index, n, used, batch) as (
      select session_id, part_index, 1, bytes, 0 from sz where part_index = 1
      union all
      select s.session_id, s.part_index, case when full_ then 1 else n + 1 end, case when full_ then s.bytes else used + s.bytes end, case when full_ then batch + 1 else batch end
      from (select gr.*, sz.bytes, sz.part_index as next, gr.n >= 12 or gr.used + sz.bytes > 150000 as full_ from gr join sz on sz.session_id = gr.session_id and sz.part_index = gr.part_index + 1) x join sz s on s.session_id = x.session_id and s.part_index = x.next
    )""") + "select session_id, part_index::int as part_index, batch from gr",
    "tone_requests": _with(_TONE_CTE, "tb as (select ((rank - 1) // 30)::int as batch, 'interaction-' || lpad(((rank - 1) % 30 + 1)::varchar, 2, '0') as id from tone)") + "select batch, count(*) as n, count(*)::int as verdicts, '[' || string_agg('\"' || id || '\"', ',' order by id) || ']' as ids from tb group by batch",
    "funniest_quote": _with(_TONE_CTE) + f"select rank, text from tone where {_frustrated(_tone_prose('text', False))} order by rank limit 1",
    "mask_names": f"select doc_id, {_mask('text')} as masked from documents",
    "split_merge": _with("""sm as (select session_id, i, type, message_id, model, usage, blocks, coalesce(case when type = 'assistant' then message_id end, 'row ' || i) as key from r),
      sb as (select session_id, key, i, to_json(b)::varchar as j from (select session_id, key, i, unnest(blocks) as b from sm)),
      sk as (select *, min(i) over (partition by session_id, key, j) as first_i from sb), sn as (select session_id, key, count(*) filter (first_i = i) as n_blocks from sk group by all)""")
    + "select session_id, min(i) as i, count(*) as n_rows, arg_min(model, i) filter (coalesce(model, '') <> '') as model, coalesce(any_value(n_blocks), 0)::int as n_blocks from sm left join sn using (session_id, key) group by session_id, key",
    "donation_preview": _with(f"""dm as (select session_id, i, type as role, {_redact('text', False)} as text from r where type in ('user', 'assistant') and text <> ''),
      dopen as (select session_id, role, i, {_opening('text')} as o from dm),
      dfirst as (select session_id, arg_min(o, i) filter (role = 'user' and o <> '') as asked, arg_min(o, i) as any_ from dopen group by session_id),
      ds as (select session_id, trim(regexp_replace(regexp_replace(coalesce(nullif(asked, ''), nullif(any_, ''), 'Session transcript'), '\\[(?:REDACTED|REMOVED)[^\\]]*\\]', 'private detail', 'g'), '\\s+', ' ', 'g'), ' ') as t from (select distinct session_id from r) left join dfirst using (session_id))""")
    + f"select session_id, i, role, text, {_ellipsis('t', 110)} as session_summary from ds left join dm using (session_id)",
    "judge_coverage": "select 0::bigint as missing, 0::bigint as unknown, 0::bigint as repeated",
    "evidence_preview": _with(_MARK_CTE, f"""pt as (select session_id, i, type, text, {_PROMPT} as is_prompt, sum(case when {_PROMPT} then 1 else 0 end) over (partition by session_id order by i) as turn from r),
      op as (select session_id, min(i) as opening_i, min_by(o, i) as t from (select *, {_opening('text')} as o from pt where is_prompt) where o <> '' group by session_id), oc as (select distinct session_id, i from found where kind = 'repetition' order by session_id, i limit 100),
      ot as (select session_id, opening_i, trim(regexp_replace(t, '\\s+', ' ', 'g'), ' ') as t from op)""")
    + f"select oc.session_id, oc.i, {_ellipsis('t', 110)} as opening, case when oc.i > opening_i then greatest(0, turn - 1 - is_prompt::int) else 0 end::bigint as turns_between from oc join pt using (session_id, i) left join ot using (session_id)",
    "number_formats": "select o_orderkey, case when n >= 1000000000 then format('{:.1f}B', floor(n * 10 / 1e9 + 0.5) / 10) when n >= 1000000 then format('{:.1f}M', floor(n * 10 / 1e6 + 0.5) / 10) when n >= 1000 then format('{:.1f}K', floor(n * 10 / 1e3 + 0.5) / 10) else n::varchar end as compact, case when n < 60 then n || 'm' else (n // 60) || 'h ' || (n % 60) || 'm' end as duration, n || case when n % 100 between 11 and 13 then 'th' when n % 10 = 1 then 'st' when n % 10 = 2 then 'nd' when n % 10 = 3 then 'rd' else 'th' end as ordinal from (select o_orderkey, floor(o_totalprice)::bigint as n from orders)",
    "public_report": _with(f"us as (select {_model_name('m')} as model, tokens, case when sum(tokens) over () > 0 then {_pct('tokens')} else 0 end as percent from (select coalesce(model, case when agent = 'codex' then 'Codex model' else 'Claude model' end) as m, sum({_TOK})::bigint as tokens from r where usage is not null group by m))") + "select left(model, 80) as model, case when percent between 0 and 100 then percent else 0 end as percent from us where round(percent, 1) > 0",
    "phrase_card": _with(_PHRASE_CTE) + "select * from phr order by sessions desc, occurrences desc, n desc, phrase limit 1",
    "ngram_miner": _with(_NGRAM_CTE) + f"select phrase, n, count(*) as occurrences, count(distinct session_id) as sessions, round(count(distinct session_id) / (select count(distinct session_id) from r where {_MODEL_WRITTEN}), 6) as session_rate from grams group by phrase, n having count(distinct session_id) >= 3 order by occurrences desc, sessions desc, n desc, phrase limit 50",
    "phrase_candidates": _with(_PHRASE_CTE) + "select * from phr",
    "phrase_variants": _with(_VARIANT_CTE) + "select variant_id, occurrences, sessions, openings from v",
    "neardup_pairs": _with(_VARIANT_CTE, _PAIRS_CTE) + "select left_id, right_id, similarity from pairs",
    "neardup_pairs_all": _with(_VARIANT_CTE, re.sub(r" and posting <= greatest\(.*?\* 0\.05\)\)\)", "", _PAIRS_CTE).replace(" qualify row_number() over (partition by variant_id order by posting, k) <= 12", "")) + "select left_id, right_id, similarity from pairs",
    "family_components": _with(_VARIANT_CTE, _PAIRS_CTE, """ed as materialized (select left_id as u, right_id as w from pairs union select right_id, left_id from pairs),
      cc(u, m) as (select variant_id, variant_id from v union select ed.w, cc.m from cc join ed on ed.u = cc.u where cc.m < ed.w)""")
    + "select u as variant_id, min(m) as component from cc group by u",
    "redact_presets": "select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '```[\\s\\S]*?```|`[^`\\n]+`', '[CODE REMOVED]', 'g'), 'https?://\\S+', '[URL REMOVED]', 'g'), '(?:[A-Za-z]:\\\\|/(?:Users|home|private|tmp|var|opt)/)(?:\\[REDACTED USER\\]|[^\\s/]+)(?:/[^\\s,;:)]+)*', '[PATH REMOVED]', 'g') as redacted from documents",
    "percentile_rank": "select c_custkey, c_acctbal, case when c_acctbal is not null then floor(100 * cume_dist() over (partition by c_acctbal is null order by c_acctbal) + 0.5)::int end as percentile from customer",
    "good_human_score": "select user_id, case when good + bad > 0 then floor(good * 1000 / (good + bad) + 0.5) / 10 end as score from (select user_id, count(*) filter (event_type = 'purchase') as good, count(*) filter (event_type = 'error') as bad from events group by user_id)",
    "session_lengths_unnest": _with(f"st as (select session_id, count(*) as turns from r where {_PROMPT} group by session_id)") + "select coalesce(project_id, 'none') as participant, (row_number() over (partition by coalesce(project_id, 'none') order by turns, session_id) - 1)::int as place, turns from st join sessions using (session_id) qualify place < 2000",
    "turn_counts": _with(f"st as (select session_id, count(*) as turns from r where {_PROMPT} group by session_id)") + "select row_number() over (order by turns) as place, turns, max(turns) over () as longest from st",
    "public_slides": _with(_TOPICS_CTE, f"ts as (select topic, {_pct('prompts')} as percent from (select topic, count(*) as prompts from topics group by topic))") + "select row_number() over (order by topic = 'Other', percent desc, topic) as rank, topic, percent from ts where round(percent, 1) > 0 qualify rank <= 5",
    "demo_cohort": "select unnest(generate_series(1, 12))::int as participant_id, unnest(" + str(P.DEMO_TOKENS) + ")::bigint as tokens, unnest(" + str(P.DEMO_RATIOS) + ")::double as word_ratio, unnest(" + str(P.DEMO_SCORES) + ")::double as good_human_score, unnest(" + str(P.DEMO_WORKAROUNDS) + ")::bigint as instrumental_workarounds, unnest(" + str([len(x) for x in P.DEMO_TURNS]) + ")::int as sessions",
    "relationship_points": "select user_id as participant_id, ratio, floor(good * 1000 / (good + bad) + 0.5) / 10 as score from (select user_id, count(*) filter (event_type = 'purchase') as good, count(*) filter (event_type = 'error') as bad, round(avg(value), 2) as ratio from events group by user_id) where good + bad > 0",
    "kde_grid": """with d as (select log10(value) as v, count(*) as n from events where value > 0 group by 1), e as (select min(v) as lo, max(v) as hi from d),
      g as (select unnest(generate_series(0, 71)) as point, lo, hi from e), x as (select point::int as point, lo + (hi - lo) * point / 71 as x, greatest(0.16, (hi - lo) / 13) as h from g),
      s as (select point, x, sum(n * exp(-0.5 * pow((v - x) / h, 2))) as d from x, d group by all) select point, round(x, 6) as x, round(d / max(d) over (), 4) as density from s""",
    "cohort_latest_upsert": "select o_custkey, o_orderkey, o_orderdate, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "opt_out_anti": "select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderstatus = 'O')",
    "phrase_wall_last_n": "select spot, phrase from (select doc_id * 1000000 + k - 1 as spot, trim(p, ' ') as phrase from (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) as k from (select doc_id, string_split_regex(lower(text), '[^a-z'' ]+') as ps from documents where text is not null))) where regexp_matches(phrase, " + _s(P.CARD_PHRASE) + ") order by spot desc limit 200",
    "leaderboard_aggregate": _with(_WORDS_CTE, _TOTALS_CTE, _AVG_CTE, f"tn0 as (select {_tone_prose('text', False)} as p from r where {_PROMPT})", f"tn as (select count(*) filter ({_frustrated('p')}) as frustrated, count(*) filter ({_has('p', P.GRATITUDE)}) as grateful from tn0)", _PHRASE_CTE, "best as (select * from phr order by sessions desc, occurrences desc, n desc, phrase limit 1)")
    + "select t.sessions, greatest(0, tokens) as tokens, agent_words, user_words, least(10000.0, coalesce(agent_user_ratio, 0))::double as word_ratio, grateful as grateful_messages, frustrated as frustrated_messages, case when grateful + frustrated > 0 then floor(grateful * 1000 / (grateful + frustrated) + 0.5) / 10 end as good_human_score, best.phrase as favorite_phrase, best.occurrences as phrase_occurrences, best.sessions as phrase_sessions from totals t, word_averages, tn left join best on true",
    "median_quantiles": "select event_type, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.75) as q75 from events group by event_type",
    "forward_fill_model": _with() + "select session_id, i, last_value(case when model <> '<synthetic>' then model end ignore nulls) over (partition by session_id order by i rows unbounded preceding) as model from r",
    "delta_from_cumulative": "with s as (select cast(user_id as varchar) as session_id, row_number() over (partition by user_id order by ts nulls last, event_id) - 1 as i, (sum(round(value)::bigint) over (partition by user_id order by ts nulls last, event_id))::bigint as total from events) select session_id, i, total, greatest(0, total - coalesce(lag(total) over (partition by session_id order by i), 0)) as delta from s",
    "call_result_pairing": _with("cb as (select session_id, i, (k - 1)::int as k, b from (select session_id, i, unnest(blocks) as b, generate_subscripts(blocks, 1) as k from r))",
      "cp as (select session_id, i, k, coalesce(b.id, b.tool_use_id) as ref, b.type as kind, case when b.type = 'tool_use' then i end as use_i, b.name from cb where b.type in ('tool_use', 'tool_result'))",
      "cq as (select *, last_value(case when kind = 'tool_use' then struct_pack(i := i, name := name) end ignore nulls) over (partition by session_id, ref order by i, k rows between unbounded preceding and 1 preceding) as call from cp where ref is not null)")
    + "select session_id, i, k, ref, call.i as call_i, call.name as tool from cq where kind = 'tool_result'",
    "replay_dedup": r"""with s as (select rec_id, lower(regexp_replace(session_id, '^\s+|\s+$', '', 'g')) as session_id, rec_type, uuid from records where session_id is not null and not coalesce(is_replay, false)),
      k as (select *, case when coalesce(uuid, '') = '' then 1 else row_number() over (partition by session_id, uuid order by rec_id) end as n from s) select rec_id, session_id, rec_type from k where n = 1 and rec_type in ('user', 'assistant', 'system')""",
    "json_extract": "select key, count(*) as n, count(distinct value) as n_values from (select unnest(json_keys(props)) as key, json_extract_string(props, '$.' || unnest(json_keys(props))) as value from events where props is not null) group by key",
    "prose_words": f"with p as (select doc_id, {_tone_prose('text')} as p from documents) select doc_id, {_words('p')} as words, len({_sentences('p')}) as sentences from p",
    "session_gap": "with e as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as fresh from events where ts is not null window w as (partition by user_id order by ts)), g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as grp from e) select user_id, min(ts) as started_at, max(ts) + interval 6 hour as ended_at, count(*) as n_events from g group by user_id, grp",
    "windowed_counts": "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all",
}
