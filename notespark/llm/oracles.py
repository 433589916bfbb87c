"""The queries that SQL can express, as DuckDB SQL."""

_CRC_TABLE = """select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
    lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"""


def _crc(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, byte by byte from its hexadecimal form."""
    return f"""(4294967295 - list_reduce(list_prepend(4294967295::bigint,
      list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


def _bits(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 13))::bigint"


def _place(shards: int) -> str:
    scores = ", ".join(f"{{'u': {_bits(f"name || '/{i}/0'")}, 'shard': {i}}}" for i in range(shards))
    return f"list_max([{scores}]).shard"


ORACLES = {
    "op2_sharding": f"""with crcs as ({_CRC_TABLE}),
 sized as (select doc_id, coalesce(doc_id::varchar, '') as name, strlen(coalesce(text, '')) + 1 as size,
   {_crc("coalesce(text, '')")} as text_crc32 from documents, crcs),
 placed as (select *, {_place(16)} as shard, {_place(17)} as grown_shard,
   {_bits("name || '/' || text_crc32 || '/' || size || '/slot0'")} as h from sized)
select doc_id, size, text_crc32, 'key' as law, shard,
 row_number() over (partition by shard order by h, doc_id, text_crc32, size) - 1 as slot, grown_shard from placed""",
    "op8_exact_dedup": """select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
 doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))""",
    "op1_chat_formatting": """with turns as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as body,
   coalesce('id:' || conv_id, 'row:' || sha256(coalesce(role, 'unknown') || chr(10) || coalesce(text, ''))) as conv from conversations),
 convs as (select conv, min(conv_id) as conv_id, count(*) as n,
   list({'role': role, 'body': body} order by turn nulls first, sha256(role || chr(10) || body)) as said from turns group by conv),
 firsts as (select said, min(n) as n, min(conv_id) as conv_id, count(*) as copies, arg_min(conv, coalesce(conv_id, 9223372036854775807)) as conv
   from convs group by said),
 kept as (select * from firsts a where not exists (
   select 1 from firsts b where b.said[1] = a.said[1] and b.n > a.n and b.said[1:a.n] = a.said))
select t.conv_id, floor(t.turn / 256.0)::bigint as part, any_value(k.n) as n_turns, any_value(k.copies) as copies,
 string_agg('<|im_start|>' || t.role || chr(10) || replace(t.body, '<|im_', '<| im_') || '<|im_end|>' || chr(10), ''
   order by t.turn nulls first, sha256(t.role || chr(10) || t.body)) as chat
from turns t join kept k using (conv) group by conv, t.conv_id, part""",
}
