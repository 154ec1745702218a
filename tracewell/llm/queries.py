"""The numbered operators as queries over the driver tables, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from catalog.registry import query
from tracewell.llm import (
    decontaminate,
    hostrules,
    html,
    licenses,
    phrases,
    quality,
    repeats,
    simhash,
    subwords,
    tokenfile,
    toolcalls,
    toxicity,
    turns,
)
from tracewell.llm.text import documents, remainder, small_batches


@query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark, sf_dir):
    """Component of every document: 3-word shingles, 2 differing bits."""
    return simhash.near_duplicates(documents(spark, sf_dir), size=3, radius=2)


RULES_SQL = r"""
with base as (
  select doc_id, source as host, coalesce(text, '') as text from documents
), split as (
  select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws,
    list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) as ls
  from base
), wins as (
  select doc_id, pos, ws[pos] || ' ' || ws[pos + 1] || ' ' || ws[pos + 2] as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as pos from split)
), twice as (
  select doc_id, pos from (select *, count(*) over (partition by doc_id, g) as n from wins) where n > 1
), covered as (
  select doc_id, sum(least(3, coalesce(nxt - pos, 3)))::bigint as n_repeat_words
  from (select *, lead(pos) over (partition by doc_id order by pos) as nxt from twice) group by doc_id
), counted as (
  select s.doc_id, s.host, len(s.ws)::bigint as n_words,
    coalesce(list_sum(list_transform(s.ws, lambda w: length(w))), 0)::bigint as word_chars,
    length(regexp_replace(s.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    len(s.ls)::bigint as n_lines,
    (len(s.ls) - len(list_distinct(s.ls)))::bigint as n_dup_lines,
    coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words
  from split s left join covered c using (doc_id)
), failed as (
  select *, n_words < 50 as short, 100 * n_repeat_words > 50 * n_words as repeats,
    10 * n_symbols > word_chars as symbols, 10 * n_dup_lines > 3 * n_lines as same_lines
  from counted
), hosts as (
  select host, count(*) as n, sum(short::int) as x1, sum(repeats::int) as x2,
    sum(symbols::int) as x3, sum(same_lines::int) as x4
  from failed group by host
), long as (
  select host, n, x1 as x, 1 as r from hosts union all select host, n, x2, 2 from hosts
  union all select host, n, x3, 3 from hosts union all select host, n, x4, 4 from hosts
), prior as (
  select r, avg(x / n) as m, var_pop(x / n) as v from long group by r
), weighed as (
  select r, m, least(greatest(case when v > 0 then m * (1 - m) / v - 1 else 1000 end, 1), 1000) as w from prior
), verdicts as (
  select host, max((x + m * w) / (n + w)) <= 0.5 as host_kept from long join weighed using (r) group by host
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (short or repeats) as base_failed, (not (short or repeats) and host_kept) as kept
from failed join verdicts on failed.host is not distinct from verdicts.host
"""


@query("op8_host_quality_rules", RULES_SQL)
def op8_host_quality_rules(spark, sf_dir):
    """Counts, base rules and the verdict with the host's shrunk failure rates."""
    ruled = hostrules.host_rules(documents(spark, sf_dir))
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: tools of the derived calls; "absent" has no schema
TOOLS = [
    ("search", "n", "integer", True), ("search", "of", "object", False), ("count", "n", "integer", True),
    ("count", "limit", "integer", True),
]

CALLS_SQL = r"""
with base as (
  select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text,
    case when conv_id % 17 = 0 then 'broken' when conv_id % 13 = 0 then 'same' when conv_id % 11 = 0 then 'lost'
      when conv_id % 7 = 0 then 'cycle' else 'chain' end as plan,
    ['search', 'count', 'absent'][conv_id % 3 + 1] as tool
  from conversations
), calls as (
  select *, case when plan = 'same' then 'c1' else 'c' || turn end as id,
    case plan when 'lost' then 'zz' when 'cycle' then 'c' || case when turn % 8 = 1 then turn else turn - 2 end
      when 'chain' then case when turn % 8 <> 1 then 'c' || (turn - 2) end end as ref,
    case when conv_id % 5 = 0 then '"' || length(text) || '"' else length(text)::varchar end as n,
    row_number() over (partition by conv_id order by turn) as nth
  from base where turn % 2 = 1
), results as (select *, 'c' || (turn - 1) as id from base where turn % 2 = 0 and turn > 0),
found as (
  select c.*, '{"n":' || n || case when ref is null then '' else ',"of":{"$ref":"' || ref || '"}' end || '}' as arguments,
    plan = 'same' and nth > 1 as again, concat_ws(',', case when tool = 'count' then 'missing:limit' end,
      case when tool = 'absent' then 'tool:absent' end, case when tool <> 'absent' and conv_id % 5 = 0 then 'type:n' end,
      case when tool = 'count' and ref is not null then 'unknown:of' end) as problems
  from calls c
)
select conv_id, turn, 'message' as kind, 0 as place, role, null::varchar as id, null::varchar as name,
  null::int as level, null::boolean as linked, null::varchar as error,
  '{"content":' || to_json(text) || ',"conv_id":' || conv_id || ',"kind":"message","role":' || to_json(role) ||
    ',"turn":' || turn || '}' as json
from base
union all
select conv_id, turn, 'call', 0, role, null, null, null, false, 'json',
  '{"conv_id":' || conv_id || ',"kind":"call","role":' || to_json(role) || ',"turn":' || turn || '}'
from calls where plan = 'broken'
union all
select conv_id, turn, 'call', 0, role, id, tool,
  case plan when 'chain' then ((turn - 1) // 2 % 4)::int when 'cycle' then null else 0 end,
  not again and exists (select 1 from results r where r.conv_id = f.conv_id and r.id = f.id),
  case when again then 'duplicate' when plan = 'lost' then 'reference' when plan = 'cycle' then 'cycle'
    when problems <> '' then problems end,
  '{"arguments":' || arguments || ',"conv_id":' || conv_id || ',"id":"' || id || '","kind":"call","name":"' || tool ||
    '","role":' || to_json(role) || ',"turn":' || turn || '}'
from found f where plan <> 'broken'
union all
select conv_id, turn, 'result', 0, role, id, null, null,
  exists (select 1 from calls c where c.conv_id = r.conv_id and c.id = r.id and c.plan <> 'broken'), null,
  '{"content":"' || length(text) || '","conv_id":' || conv_id || ',"id":"' || id || '","kind":"result","role":' ||
    to_json(role) || ',"turn":' || turn || '}'
from results r
"""


def with_calls(conversations):
    """Every odd turn of the table makes a call, every later even turn answers the one before it.

    Identifiers, names and arguments follow from conversation, turn and text; some conversations break
    their JSON, repeat an identifier, refer to nothing or in a circle, or miss the tool's schema.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    text = F.coalesce("text", F.lit(""))
    rest = lambda k: conv % k == 0
    length = F.char_length(text).cast("string")
    n = F.when(rest(5), F.concat(F.lit('"'), length, F.lit('"'))).otherwise(length)
    back = F.concat(F.lit("c"), turn - 2)
    ref = (
        F.when(rest(17) | rest(13), F.lit(None)).when(rest(11), "zz")
        .when(rest(7), F.when(turn % 8 == 1, F.concat(F.lit("c"), turn)).otherwise(back)).when(turn % 8 != 1, back)
    )
    of = F.coalesce(F.concat(F.lit(',"of":{"$ref":"'), ref, F.lit('"}')), F.lit(""))
    own = F.when(rest(13) & ~rest(17), "c1").otherwise(F.concat(F.lit("c"), turn))
    tool = F.element_at(F.array(F.lit("search"), F.lit("count"), F.lit("absent")), (conv % 3 + 1).cast("int"))
    call = F.concat(
        F.lit('<tool_call>{"name":"'), tool, F.lit('","id":"'), own, F.lit('","arguments":{"n":'), n, of,
        F.when(rest(17), "}").otherwise("}}"), F.lit("</tool_call>"),
    )
    result = F.concat(F.lit('<tool_result>{"id":"c'), turn - 1, F.lit('","content":"'), length, F.lit('"}</tool_result>'))
    more = F.when(turn % 2 == 1, call).when(turn > 0, result).otherwise("")
    return conversations.select("conv_id", "turn", "role", F.concat(text, more).alias("text"))


@query("op9_tool_call_linking", CALLS_SQL)
def op9_tool_call_linking(spark, sf_dir):
    """Every message, call and result as canonical JSON, calls linked, levelled and checked."""
    schemas = spark.createDataFrame(TOOLS, toolcalls.SCHEMA)
    return toolcalls.link_tool_calls(with_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), schemas)


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark, sf_dir):
    """Bytes of repeated 400-byte windows removed from every document, and those of repeated 50-word windows."""
    return repeats.remove_repeats(documents(spark, sf_dir), words=repeats.WORDS)


@query("op4_token_files")
def op4_token_files(spark, sf_dir):
    """Ids of all documents in token files, and what reading these back gives."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return tokenfile.token_files(documents(spark, sf_dir), vocabulary, end_id=2)


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark, sf_dir):
    """Every document and benchmark item that it holds, with score and place."""
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op7_license_scans")
def op7_license_scans(spark, sf_dir):
    """Places and labels of license phrases in every document."""
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


@query("op5_toxicity_neighbours")
def op5_toxicity_neighbours(spark, sf_dir):
    """Toxicity of every document, learned from the labels whose id's remainder by 5 is not 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(documents(spark, sf_dir), labels, learn=remainder("doc_id", 5) != 0)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op1_quality_classifier")
def op1_quality_classifier(spark, sf_dir):
    """Quality of every document, learned from the labels whose id's remainder by 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents(spark, sf_dir)
    scored = quality.score_quality(docs, quality.learned(docs, labels, learn=remainder("doc_id", 3) != 1))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    """Ids of every document (long ones in chunks), and the checksum of what they decode to."""
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    decoded = subwords.decode(subwords.encode(documents(spark, sf_dir), vocabulary), vocabulary)
    crc = F.crc32("text").alias("decoded_crc32")
    return decoded.select("doc_id", "chunk", "n_chunks", "n_tokens", "ids", "text_crc32", crc)


PHRASES_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), split as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces
), f1 as (
  select lang, w, count(*) as f from (select lang, unnest(ws) as w from split) group by all
), totals as (select lang, sum(f)::bigint as n from f1 group by lang),
f2 as (
  select lang, ws[i] as w1, ws[i + 1] as w2, count(*) as f
  from (select lang, ws, unnest(range(1, len(ws))) as i from split) group by all having count(*) >= 10
), f3 as (
  select lang, ws[i] as w1, ws[i + 1] as w2, ws[i + 2] as w3, count(*) as f
  from (select lang, ws, unnest(range(1, len(ws) - 1)) as i from split) group by all having count(*) >= 10
), inside as (
  select lang, w1, w2, max(f) as longer
  from (select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by all
), two as (
  select lang, w1 || ' ' || w2 as phrase, f2.f as a, x.f as l, y.f as r,
    1000000::hugeint * f2.f * f2.f // (x.f::hugeint * y.f) as score
  from f2 left join inside using (lang, w1, w2)
  join f1 x on x.lang = f2.lang and x.w = f2.w1 join f1 y on y.lang = f2.lang and y.w = f2.w2
  where longer is null or 100 * longer < 50 * f2.f
), cuts as (
  select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 as phrase, f3.f as a,
    x.f as l1, q.f as r1, p.f as l2, z.f as r2,
    1000000::hugeint * f3.f * f3.f // (x.f::hugeint * q.f) as s1, 1000000::hugeint * f3.f * f3.f // (p.f::hugeint * z.f) as s2
  from f3 join f1 x on x.lang = f3.lang and x.w = f3.w1 join f1 z on z.lang = f3.lang and z.w = f3.w3
  join f2 p on p.lang = f3.lang and p.w1 = f3.w1 and p.w2 = f3.w2
  join f2 q on q.lang = f3.lang and q.w1 = f3.w2 and q.w2 = f3.w3
), every as (
  select * from two union all
  select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2)
  from cuts
), best as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from every
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from best join totals using (lang) where rank <= 2000
"""


@query("op11_phrase_collocations", PHRASES_SQL)
def op11_phrase_collocations(spark, sf_dir):
    """Each language's 2000 best phrases of two and three words."""
    return phrases.collocations(documents(spark, sf_dir))


REPAIR_SQL = r"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
  from conversations
), damage as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(k, ''),
      lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384::bigint * (c & 1)) end),
    4294967295::bigint) % 20 as kind
  from keyed
), kept as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from damage where kind <> 0
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last
  from kept
), faulty as (
  select *, left(role, 1) as x, case when last = '' then 'blank'
    when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
    when last not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by i) as before
  from numbered
), facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    sum((fault = 'blank')::int)::bigint as blank, sum((fault = 'duplicate')::int)::bigint as duplicate,
    sum((fault = 'truncated')::int)::bigint as truncated,
    sum((before is not null and before || x not in ('su', 'ua', 'au'))::int)::bigint as illegal, count(*) as rows
  from faulty group by conv_id
), steps(p, x, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), names(x, role) as (values ('u', 'user'), ('a', 'assistant')
), ins(p, r, c, a, t) as (
  select p, p, 0, '', '' from range(4) s(p)
  union all select p, 2, 5, 'I', chr(10) || 'user:' from range(4) s(p) where p <> 2
  union all select p, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:' from range(2) s(p)
  union all select 2, 3, 5, 'I', chr(10) || 'assistant:'
), opts as (
  select conv_id, i, r::bigint as r, r::bigint as q, 2 as c, 'D' as a, '' as t from faulty, range(4) s(r)
  union all
  select conv_id, i, p, q, case when fault = 'truncated' then 5 else 0 end, 'K', chr(10) || role || ':' || text
  from faulty join steps using (x) where fault in ('', 'truncated')
  union all
  select conv_id, i, p, q, case when fault = 'truncated' then 6 else 1 end, 'R', chr(10) || names.role || ':' || text
  from faulty, steps join names using (x) where fault in ('', 'truncated')
), dp as (
  select conv_id, 0::bigint as i, 0::bigint as q, {'c': 0::bigint, 'a': '', 't': ''} as best from facts
  union all
  select d.conv_id, d.i + 1, o.q, min({'c': d.best.c + ins.c + o.c, 'a': d.best.a || ins.a || o.a, 't': d.best.t || ins.t || o.t})
  from dp d join ins on ins.p = d.q
  join opts o on o.conv_id is not distinct from d.conv_id and o.i = d.i + 1 and o.r = ins.r
  group by d.conv_id, d.i + 1, o.q
), final as (
  select f.conv_id, min({'c': d.best.c + ins.c, 'a': d.best.a || ins.a, 't': d.best.t || ins.t}) as best
  from facts f join dp d on d.conv_id is not distinct from f.conv_id and d.i = f.rows
  join ins on ins.p = d.q and (ins.r = 3 or (ins.r = 0 and ins.p = 0))
  group by f.conv_id
), ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost,
  coalesce(best.a, '') as audit, sha256(coalesce(substr(best.t, 2), '')) as repaired_sha256
from ids left join facts on facts.conv_id is not distinct from ids.conv_id
left join final on final.conv_id is not distinct from ids.conv_id
"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(spark, sf_dir):
    """Faults, cheapest repair and its hash of every conversation."""
    return turns.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op13_html_extraction")
def op13_html_extraction(spark, sf_dir):
    """Main text of every page."""
    small_batches(spark)
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
