"""Queries of the corpus problems; name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import conversations, language, mojibake, packing, pii, terms, tokens
from threadloom.session import materialize, read_table

Query = Callable[[SparkSession, str], DataFrame]


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, language.Centroids]:
    docs = read_table(spark, d, "documents")
    return language.items_of(docs, read_table(spark, d, "records")), language.fit(docs)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    items, model = _items(spark, d)
    return language.unstated(language.held_languages(items, model))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every item with its language and confidence."""
    items, model = _items(spark, d)
    return language.item_segments(items, model)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.faults(read_table(spark, d, "sessions"), read_table(spark, d, "records"))


def p3_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(read_table(spark, d, "sessions"), read_table(spark, d, "records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = terms.term_frequencies(terms.block_texts(read_table(spark, d, "records")))
    return found.where("mark <> ''").select("term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(terms.block_texts(read_table(spark, d, "records")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(read_table(spark, d, "records"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(read_table(spark, d, "records"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(read_table(spark, d, "documents"))


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_with_offsets(read_table(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Ids decoded again: one row per document, whether the text came back."""
    docs = read_table(spark, d, "documents")
    back = tokens.decode(tokens.encode(docs)).withColumnRenamed("text", "decoded")
    return docs.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    docs, containers = read_table(spark, d, "documents"), read_table(spark, d, "containers")
    return packing.pack(tokens.count_tokens(docs), containers)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packing(spark, d))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must not be in a packing, counted per kind of container: all noughts."""
    docs, containers = read_table(spark, d, "documents"), read_table(spark, d, "containers")
    sizes = materialize(tokens.count_tokens(docs), "p7-sizes")
    return packing.invariants(materialize(packing.pack(sizes, containers), "p7-packed"), sizes, containers)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(read_table(spark, d, "documents")).where("garbled").select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(read_table(spark, d, "documents")).where("garbled").select("doc_id", "restored")


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p2_found, p2_segments, p3_found, p3_conversations, p4_found, p4_terms, p5_found, p5_redacted, p6_ids, p6_offsets, p6_roundtrip, p7_packing, p7_fill, p7_invariants, p8_found, p8_restored)
}

#: Problem 3 by its definition: rows in order, of one uuid the first, then the faults.
_CONVERSATIONS = r"""
wanted as (select distinct lower(regexp_replace(session_id, '^\s+|\s+$', '', 'g')) as sid from sessions where session_id is not null),
ev as (
  select lower(regexp_replace(session_id, '^\s+|\s+$', '', 'g')) as sid, rec_id, coalesce(uuid, 'row ' || rec_id) as uuid, record_index as ix, ts, message.content as blocks, message.id as message_id,
    case when rec_type = 'user' then 'prompt' when rec_type = 'assistant' then 'reply' end as who,
    coalesce(is_meta, false) or coalesce(is_api_error, false) as hidden,
    coalesce(len(list_filter(message.content, lambda b: b.type = 'text' and regexp_matches(b.text, '[^\s\x0b\x{85}\p{Z}]'))) > 0, false) as has_text,
    rec_type in ('user', 'assistant') and not coalesce(regexp_matches(message.role, '[^\s\x0b\x{85}\p{Z}]'), false) as no_role
  from records where session_id is not null
),
fc as (select sid, uuid, min(ix) as ix, arg_min_null(ts, ix) as ts from ev where ix is not null group by sid, uuid),
stands as (
  select *, ix as pos, -1 as sub from ev where ix is not null
  union all select *, coalesce((select max(fc.ix) from fc where fc.sid = ev.sid and fc.ts <= ev.ts), -1), coalesce(epoch_us(ts), 0) from ev where ix is null
),
msg as (
  select *, count(*) over (partition by sid, uuid) as n_versions from stands where sid in (select sid from wanted)
  qualify row_number() over (partition by sid, uuid order by pos, sub, rec_id) = 1
),
said as (select *, lead(who) over (partition by sid order by pos, sub, rec_id) as after, row_number() over (partition by sid order by pos, sub, rec_id) as n from msg where who is not null and not hidden and has_text),
tool as (select sid, pos, sub, rec_id, k, b from (select sid, pos, sub, rec_id, unnest(blocks) as b, generate_subscripts(blocks, 1) as k from msg)),
used as (select sid, b.id as ref, min((pos, sub, rec_id, k)) as at from tool where b.type = 'tool_use' and b.id is not null group by all),
got as (select sid, b.tool_use_id as ref, min((pos, sub, rec_id, k)) as at from tool where b.type = 'tool_result' and b.tool_use_id is not null group by all),
fault as (
  select sid as session_id, 'empty' as fault from wanted where sid not in (select sid from said)
  union all select sid, 'headless' from said where n = 1 and who = 'reply'
  union all select distinct sid, 'unanswered' from said where who = 'prompt' and coalesce(after, 'prompt') = 'prompt'
  union all select distinct sid, 'broken' from (select sid from msg where no_role union all select got.sid from got left join used using (sid, ref) where used.at is null or used.at > got.at)
)"""

_TERMS = r"""
first as (
  select message.content as blocks, row_number() over (partition by coalesce(uuid, 'row ' || rec_id) order by rec_id) as n from records
), recs as (
  select row_number() over () as id, blocks from first where n = 1
), words as (
  select id, unnest(regexp_extract_all(lower(t.b.text), '[\p{L}\p{N}]+')) as term
  from recs, unnest(blocks) as t(b) where t.b.type = 'text' and t.b.text is not null
), counted as (select term, count(*) as occurrences, count(distinct id) as records from words group by term)"""

#: Only what plain SQL can say; the other problems have brute-force tests.
SQL: dict[str, str] = {
    "p6_roundtrip": "select doc_id, true as same from documents",
    "p7_invariants": "select container_kind, 0::bigint as overfull, 0::bigint as cut, 0::bigint as misplaced, 0::bigint as missing from containers where capacity_tokens > 0",
    "p3_found": "with " + _CONVERSATIONS + " select * from fault",
    "p3_conversations": "with " + _CONVERSATIONS + r""",
good as (
  select *, array_to_string(list_transform(list_filter(blocks, lambda b: b.type = 'text' and b.text is not null), lambda b: b.text), chr(10)) as text,
    coalesce(case when who = 'reply' then message_id end, uuid) as key from said where sid not in (select session_id from fault)
),
turns as (
  select sid, who, min((pos, sub, rec_id)) as spot, arg_min(uuid, (pos, sub, rec_id)) as uuid, arg_min_null(ts, (pos, sub, rec_id)) as ts, sum(n_versions)::bigint as n_versions,
    string_agg(text, chr(10) order by pos, sub, rec_id) as text from good group by sid, key, who
)
select sid as session_id, sum(case when who = 'prompt' then 1 else 0 end) over w as turn_no, row_number() over w as message_no, case when who = 'prompt' then 'user' else 'assistant' end as speaker, uuid, ts, n_versions, text
from turns window w as (partition by sid order by spot rows unbounded preceding)
""",
    "p4_found": "with " + _TERMS + """
select term, case when records < 3 then 'rare' else 'common' end as mark from counted
where records < 3 or records * 25 > (select count(distinct id) from words)
""",
    "p4_terms": "with " + _TERMS + """
select term, occurrences, records, case when records < 3 then 'rare' when records * 25 > (select count(distinct id) from words) then 'common' else '' end as mark from counted
""",
}
