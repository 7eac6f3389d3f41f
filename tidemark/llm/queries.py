"""The queries of this subpackage, and SQL for those columns of them that SQL can express on whole tables."""

from __future__ import annotations

from tidemark.llm import embed_dedup, fingerprint, html_text, langid, mixing, ngram_join, packing, pii, sharding, toxicity


def queries() -> dict:
    return {
        "op1_embedding_near_dedup": embed_dedup.op1,
        "op2_fingerprints": fingerprint.op2,
        "op3_ngram_jaccard_join": ngram_join.op3,
        "op4_personal_data": pii.op4,
        "op5_source_mixing": mixing.op5,
        "op6_harmonic_packing": packing.op6,
        "op7_jump_sharding": sharding.op7,
        "op8_html_text": html_text.op8,
        "op9_toxicity": toxicity.op9,
        "op10_language_id": langid.op10,
        "part2_edited_texts": lambda s, d: fingerprint.op2(s, d).select("doc_id", "n_chars", "edited_sha256"),
        "part4_base_counts": lambda s, d: pii.op4(s, d).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"),
        "part7_shards": lambda s, d: sharding.op7(s, d).select("doc_id", "size", "law", "shard", "grown_shard"),
        "part7_slots": lambda s, d: _slots(sharding.op7(s, d)),
    }


def _slots(rows):
    from pyspark.sql import functions as F

    return rows.groupBy("shard").agg(F.count("*").alias("documents"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("least"), F.max("slot").alias("greatest"), F.sum("size").alias("bytes"))


_EDITED = """select doc_id, n_chars, sha256(substring(text, 1, n_chars - n_chars // 2) || substring(after, 1, n_chars // 2)) as edited_sha256
  from (select doc_id, text, length(text) as n_chars, coalesce(lead(text) over (order by doc_id desc), first(text) over (order by doc_id desc)) as after from (select doc_id, coalesce(text, '') as text from documents))"""

#: For each kind: every match of its pattern, and whether one counts.
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(string_split(reverse(d), ''), lambda c, i: case when i % 2 = 1 then c::int when c::int < 5 then c::int * 2 else c::int * 2 - 9 end)) % 10 = 0"
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: x::hugeint)) <= 255"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length(d) between 12 and 19 and {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 9 and 15"),
}
#: A match's place is the length of what stands before it: the parts between matches and the matches until then.
_SPANS = " union all ".join(
    f"select doc_id, {k} as kind, '{name}' as name, place as start, place + length(m) as stop from ("
    f"select doc_id, m, d, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) as place from ("
    f"select doc_id, found, gaps, unnest(found) as m, {_DIGITS.replace('m,', 'unnest(found),')} as d, generate_subscripts(found, 1) as i from ("
    f"select doc_id, regexp_extract_all(text, '{pattern}') as found, string_split_regex(text, '{pattern}') as gaps from documents where text is not null))) where {rule}"
    for k, (name, (pattern, rule)) in enumerate(_KINDS.items())
)
_BASE = f"""with spans as ({_SPANS}), sums as (select doc_id, {', '.join(f"count(*) filter (where name = '{n}') as n_{n}" for n in _KINDS)},
  string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) as base from spans group by 1)
  select doc_id, {', '.join(f'coalesce(n_{n}, 0) as n_{n}' for n in _KINDS)}, sha256(coalesce(base, '')) as base_sha256 from documents left join sums using (doc_id)"""

_ALL = "18446744073709551616::uhugeint"


def _jump(shards: int) -> str:
    first = "xor(doc_id::ubigint, doc_id::ubigint >> 30)"
    second = f"(({first})::uhugeint * {int(sharding.MIX[0])}::uhugeint % {_ALL})::ubigint"
    third = f"((xor(k, k >> 27))::uhugeint * {int(sharding.MIX[1])}::uhugeint % {_ALL})::ubigint"
    return f"""start_{shards} as (select doc_id, xor(k, k >> 31) as k, 0::bigint as place, 0::bigint as nxt from (select doc_id, {third} as k from (select doc_id, {second} as k from documents))),
      jump_{shards} as (select * from start_{shards} union all
        select doc_id, k, nxt, floor((nxt + 1) * (2147483648::double / ((k >> 33) + 1)))::bigint from (select doc_id, ((k::uhugeint * {int(sharding.JUMP)}::uhugeint + 1::uhugeint) % {_ALL})::ubigint as k, nxt from jump_{shards} where nxt < {shards}))"""


_SHARDS = f"""with recursive {_jump(8)}, {_jump(9)}
  select doc_id, strlen(coalesce(text, '')) + 1 as size, 'key' as law, a.place::int as shard, b.place::int as grown_shard
  from documents join jump_8 a using (doc_id) join jump_9 b using (doc_id) where a.nxt >= 8 and b.nxt >= 9"""
_SLOTS = f"with rows as ({_SHARDS}) select shard, count(*) as documents, count(*) as slots, 0::bigint as least, count(*) - 1 as greatest, sum(size)::bigint as bytes from rows group by 1"


def oracle_sql() -> dict:
    return {"part2_edited_texts": _EDITED, "part4_base_counts": _BASE, "part7_shards": _SHARDS, "part7_slots": _SLOTS}
