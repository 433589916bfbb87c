"""DuckDB SQL for every catalog query.

Written from the definitions, on purpose with other means than the Spark side where SQL has them: unnested
lines and windows instead of arrays, recursive packing, pairwise comparison instead of key lists.
"""

from __future__ import annotations

from notespark import params
from notespark.operators import requests as rq
from notespark.plans.catalog import CACHE_NOW, EXCLUSION_SETTING, PENDING_NOW

ORACLES: dict[str, str] = {}

# --- derived views -----------------------------------------------------------------------------------------

EXCLUDED = "(" + ", ".join(f"'{e}'" for e in params.EXCLUDED_EXTENSIONS) + ")"

NOTES = r"""
b as (select doc_id, lang, source,
  (['md','md','md','md','md','md','MD','pdf','PNG','txt'])[doc_id%10+1] extension,
  array_to_string(regexp_extract_all(lower(text), '[\p{L}]+')[1:3],'-')||'-'||lpad(cast(doc_id as varchar),6,'0') basename,
  array_to_string(list_transform(string_split(text,chr(10)), lambda l,i:
    (case when i=1 then '# ' when (i-1)%8=0 then '## ' else '' end)||
    (case when (i-1)%5=3 then replace(l,', ',' , ') else l end)),chr(10)) body
 from documents),
notes as (select b.doc_id, b.lang, b.source||'/'||b.basename||'.'||b.extension path, b.basename, b.extension,
 b.body||(case when b.doc_id%4=0 and p.basename is not null
   then chr(10)||chr(10)||chr(10)||'See [['||p.basename||']] and `code x`.' else '' end) as content
from b left join b p on p.doc_id=b.doc_id-1),
""" + f"""
md as (select * from notes where lower(extension) not in {EXCLUDED} and extension = 'md'),
anchor as (select arg_min(path, doc_id) path from md)"""

WORD = r"[\p{L}\x{064B}-\x{0652}]+"
SPACES = r"chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)||chr(65279)"
NL = "chr(10)"


def lines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


def trim(text: str) -> str:
    return f"trim({text}, {SPACES})"


def pieces(text: str) -> str:
    return (
        f"string_split(replace(replace({text},chr(10)||'## ',chr(1)||'## '),chr(10)||'# ',chr(1)||'# '),chr(1))"
    )


def view(name: str, body: str, *before: str, recursive: bool = False) -> None:
    ORACLES[name] = "with " + ("recursive " if recursive else "") + ",\n".join(before) + "\n" + body


# --- inventory ---------------------------------------------------------------------------------------------

view("vault_scan", "select path, basename, extension from notes", NOTES)
view("note_text", "select path, content, length(content) n_chars from md", NOTES)
view("exclusion_flags", f"select path, extension, lower(extension) in {EXCLUDED} excluded from notes", NOTES)
view(
    "exclusion_setting",
    f"""select path, extension,
  list_contains(list_transform(string_split('{EXCLUSION_SETTING}', ','), lambda e: trim(e)), lower(extension)) excluded
from notes""",
    NOTES,
)
LISTED = """listed as (select unnest(string_split(p_name, ' ')) own from part union all select c_custkey::varchar from customer
  union all select lower(extension) from notes where extension in ('txt', 'PNG'))"""
view("exclusion_table", "select path, extension, lower(extension) in (select own from listed where own is not null) excluded from notes", NOTES, LISTED)
view("included_by_table", "select path, extension from notes where lower(extension) not in (select own from listed where own is not null)", NOTES, LISTED)
view("md_candidates", "select path, basename from md", NOTES)
view(
    "anchor_candidates",
    "select path, basename from md where path <> (select path from anchor) order by path limit 20",
    NOTES,
)
view(
    "request_texts",
    """select path, content[1:5000] check_text, content[1:3000] compare_text, content[1:200] preview,
  length(content) > 5000 truncated from md""",
    NOTES,
)
view("vault_breakdown", "select lower(extension) extension, count(*) n from notes group by 1", NOTES)
view(
    "vault_summary",
    f"""select count(*) filter (where lower(extension) not in {EXCLUDED}) total_files,
  (select count(*) from md) markdown_files from notes""",
    NOTES,
)

# --- names and themes --------------------------------------------------------------------------------------

MEMBERS = """
members as (select path, basename, row_number() over (order by path) - 1 position, (row_number() over (order by path) - 1) // 100 chunk_no from md)"""
CHUNKS = """
chunks as (select chunk_no, count(*) n_names, string_agg(basename, chr(10) order by position) as names from members group by 1)"""
THEME_REPLIES = """
first_name as (select chunk_no, '["'||replace(string_split(names, chr(10))[1], '-', '","')||'"]' a from chunks),
theme_replies as (select chunk_no, case chunk_no % 4 when 0 then a when 1 then '```json'||chr(10)||a||chr(10)||'```'
  when 2 then 'Themes: '||a||'.' else '["cut off' end raw from first_name)"""
PARSED_THEMES = r"""
arr as (select chunk_no, regexp_extract(regexp_replace(raw, '(?s)```[A-Za-z]*\n?(.*?)```', '\1', 'g'), '(?s)\[.*\]') a from theme_replies),
parsed as (select chunk_no, unnest(cast(json(a) as varchar[])) theme, generate_subscripts(cast(json(a) as varchar[]), 1) - 1 pos
  from arr where json_valid(a))"""

view("name_chunks", "select chunk_no, n_names, names from chunks", NOTES, MEMBERS, CHUNKS)
view(
    "vault_themes",
    rf"""select chunk_no, pos, theme, n_names from (
  select *, row_number() over (partition by chunk_no order by n_names desc, theme) pos from (
    select chunk_no, theme, count(*) n_names from (
      select distinct chunk_no, path, unnest(regexp_extract_all(lower(basename), '{WORD}')) theme from members)
    group by 1, 2 having count(*) >= 2))""",
    NOTES,
    MEMBERS,
)
view("parsed_themes", "select chunk_no, pos, theme from parsed", NOTES, MEMBERS, CHUNKS, THEME_REPLIES, PARSED_THEMES)
view(
    "parsed_themes_compat",
    r"""select chunk_no, case when json_valid(a) then cast(json_array_length(a) as bigint) else 0 end n_themes
from (select chunk_no, regexp_extract(regexp_replace(raw, '(?s)```.*?```', '', 'g'), '(?s)\[.*\]') a from theme_replies)""",
    NOTES, MEMBERS, CHUNKS, THEME_REPLIES,
)
view(
    "theme_union",
    "select theme, chunk_no, pos from (select *, row_number() over (partition by theme order by chunk_no, pos) k from parsed) where k = 1",
    NOTES, MEMBERS, CHUNKS, THEME_REPLIES, PARSED_THEMES,
)

view(
    "vault_analysis",
    f"""select (select count(*) from notes where lower(extension) not in {EXCLUDED}) total_files, (select count(*) from md) markdown_files,
  (select count(distinct lower(extension)) from notes) n_file_types,
  (select count(distinct theme) from (select chunk_no, theme from (
    select distinct chunk_no, path, unnest(regexp_extract_all(lower(basename), '{WORD}')) theme from members) group by 1, 2 having count(*) >= 2)) n_themes""",
    NOTES, MEMBERS,
)
view(
    "themes_cached",
    """select theme, chunk_no, pos from (select *, row_number() over (partition by theme order by chunk_no, pos) k
  from parsed where chunk_no % 3 <> 1) where k = 1""",
    NOTES, MEMBERS, CHUNKS, THEME_REPLIES, PARSED_THEMES,
)

# --- sections ----------------------------------------------------------------------------------------------

PACKED = f"""
long as (select path, {pieces("content")} ps from md where length(content) > 4000),
-- one step per piece: section number of the piece and length of the section so far
walk(path, i, sec, cur) as (
  select path, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) from long
  union all
  select w.path, i + 1,
    case when cur + length(ps[i+1]) > 4000 and cur > 0 then sec + 1 else sec end,
    case when cur + length(ps[i+1]) > 4000 and cur > 0 then length(ps[i+1])
         when cur > 0 then cur + 2 + length(ps[i+1]) else length(ps[i+1]) end
  from walk w join long l on l.path = w.path where i < len(ps)),
piece as (select w.path, i, sec, ps[i] txt, {lines("ps[i]")} + 1 n
  from walk w join long l on l.path = w.path where i > 0),
placed as (select *,
    1 + coalesce(sum(n) over (partition by path order by i rows between unbounded preceding and 1 preceding), 0) exact,
    1 + coalesce(sum(n + 1) over (partition by path, sec order by i rows between unbounded preceding and 1 preceding), 0) packed
  from piece),
joined as (select path, sec, string_agg(txt, chr(10)||chr(10) order by i) j from piece group by 1, 2),
packs as (
  select path, sec section_no, {trim("j")} section,
    {lines("j")} - {lines(f"ltrim(j, {SPACES})")} cut from joined
  union all
  select path, 0, content, 0 from md where length(content) <= 4000),
spots as (
  select p.path, p.sec section_no, p.packed - k.cut packed, p.exact
  from placed p join packs k on k.path = p.path and k.section_no = p.sec
  union all
  select path, 0, 1, 1 from md where length(content) <= 4000)"""

FIXED = f"""
cuts as (select path, k section_no, substr(content, k*5000+1, 5000) section,
    {lines("substr(content, 1, k*5000)")} newlines_before
  from (select path, content, unnest(range(0, cast(ceil(length(content)/5000.0) as bigint))) k from md))"""

view(
    "header_pieces",
    f"select path, generate_subscripts(ps, 1) - 1 piece_no, unnest(ps) piece from (select path, {pieces('content')} ps from md)",
    NOTES,
)
view("header_pack", "select path, section_no, section from packs", NOTES, PACKED, recursive=True)
view(
    "fixed_sections", "select path, section_no, section, newlines_before + 1 line_offset from cuts", NOTES, FIXED
)
view("sample_sections", "select path, content[1:5000] section, length(content) <= 5000 whole_note from md", NOTES)

REWRITE = f"""
pieces_of as (select path, lang, case when length(content) > 15000 then {pieces("content")} else [content] end ps,
    length(content) > 15000 cut from md),
rewrite as (
  select 'correct' kind, path, lang, case when cut then list_filter(list_transform(ps, lambda x: {trim("x")}), lambda x: x <> '') else ps end ss from pieces_of
  union all
  select 'enhance', path, lang, case when cut then list_filter(ps, lambda x: {trim("x")} <> '') else ps end from pieces_of),
rewrite_sections as (select kind, path, lang, generate_subscripts(ss, 1) - 1 section_no, unnest(ss) section from rewrite)"""
view("rewrite_sections", "select kind, path, section_no, section from rewrite_sections", NOTES, REWRITE)
view(
    "section_progress",
    """select path, section_no, cast(floor((section_no + 1) * 100.0 / count(*) over (partition by path) + 0.5) as bigint) progress
from packs""",
    NOTES, PACKED, recursive=True,
)


def reply_json(word: str) -> str:
    return (
        """concat('{"corrections":[{"original":"',W,'","suggested":"',W,'x","line":2,"confidence":0.9,"context":""},"""
        """{"original":"","suggested":"y","line":1,"confidence":0.8}],"formattingIssues":[{"issue":"comma spacing","""
        """"line":4,"suggestion":"drop space","fixable":true,"originalText":" , ","suggestedText":", "}]}')"""
    ).replace("W", word)


def reply(kind: str, json: str) -> str:
    return f"""case {kind} when 0 then {json} when 1 then concat('<think>a {{b}}</think>',{json})
  when 2 then concat('Sure: ',{json},' done') when 3 then concat('```json',chr(10),{json},chr(10),'```')
  when 4 then '{{"corrections": [' else '{{}}' end"""


def findings(source: str, raw: str = "raw") -> str:
    """Corrections and issues lists of a reply column, null when unreadable."""
    return f"""
obj_{source} as (select *, regexp_extract(regexp_replace({raw}, '(?s).*?</think>', '', 'g'), '(?s)\\{{.*\\}}') obj from {source}),
parsed_{source} as (select *, coalesce(json_valid(obj), false) and obj <> '' parse_ok,
  case when json_valid(obj) and obj <> '' then coalesce(list_filter(cast(json_extract(obj, '$.corrections') as json[]),
    lambda c: coalesce(c->>'original','') <> '' and coalesce(c->>'suggested','') <> ''), []) end corrections,
  case when json_valid(obj) and obj <> '' then coalesce(list_filter(cast(json_extract(obj, '$.formattingIssues') as json[]),
    lambda c: coalesce(c->>'issue','') <> ''), []) end issues from obj_{source})"""


FIRST_WORD = r"coalesce(nullif(regexp_extract({},'[\p{{L}}]+'),''),'x')"


def answered(sections: str, where: str = "true") -> str:
    """Sections with the reply of their text, or without one where the condition doesn't hold."""
    word = FIRST_WORD.format("section")
    return f"answered as (select *, case when {where} then {reply('length(section) % 6', reply_json(word))} end raw from {sections})"


def exploded(source: str, line_offset: str, line_exact: str) -> str:
    return f"""
flat as (
  select path, section_no, 'correction' kind, unnest(corrections) f, generate_subscripts(corrections, 1) - 1 pos from {source} where parse_ok
  union all
  select path, section_no, 'issue', unnest(issues), generate_subscripts(issues, 1) - 1 from {source} where parse_ok)
select f.path, f.section_no, f.kind, f.pos, coalesce(f.f->>'original', f.f->>'issue') what,
  cast(cast(f.f->>'line' as bigint) + {line_offset} as bigint) line, cast({line_exact} as bigint) line_exact
from flat f join based s on s.path = f.path and s.section_no = f.section_no"""


BASED_FULL = f"""
based as (select *, coalesce(sum(case when parse_ok then {lines("section")} + 1 else 0 end)
  over (partition by path order by section_no rows between unbounded preceding and 1 preceding), 0) line_offset
  from parsed_answered),"""
EXACT_FULL = """(select arg_max(p.exact + cast(f.f->>'line' as bigint) - p.packed, p.packed) from spots p
    where p.path = f.path and p.section_no = f.section_no and p.packed <= cast(f.f->>'line' as bigint))"""

view(
    "check_full_replies",
    "," + BASED_FULL + exploded("based", "s.line_offset", EXACT_FULL),
    NOTES, PACKED, answered("packs"), findings("answered"),
    recursive=True,
)
view(
    "check_full_cached",
    "," + BASED_FULL + exploded("based", "s.line_offset", EXACT_FULL),
    NOTES, PACKED, answered("packs", "length(section) % 3 <> 1"), findings("answered"),
    recursive=True,
)
view(
    "pending_checks",
    """select 'spell:'||lang||':sonar:standard:'||sha256(section) as key, min(path) path from packs join (select path, lang from md) using (path)
where length(section) % 3 <> 0 group by 1""",
    NOTES, PACKED,
    recursive=True,
)
view(
    "applied_findings",
    """, merged as (select path, flatten(list(corrections order by section_no)) c, flatten(list(issues order by section_no)) i
  from parsed_answered where parse_ok group by path having len(c) + len(i) > 0),
corrected as (select m.path, list_reduce(list_prepend(to_json({'t': n.content}), m.c),
  lambda a, c: to_json({'t': replace(a->>'t', c->>'original', c->>'suggested')}))->>'t' content, m.i from merged m join md n on n.path = m.path)
select path, list_reduce(list_prepend(to_json({'t': content}), i),
  lambda a, c: to_json({'t': replace(a->>'t', c->>'originalText', c->>'suggestedText')}))->>'t' as content from corrected""",
    NOTES, PACKED, answered("packs"), findings("answered"),
    recursive=True,
)
for _name, _where in (("check_incremental_replies", ""), ("check_incremental_first", " where section_no = 0")):
    view(
        _name,
        f", based as (select * from parsed_answered{_where}),"
        + exploded("based", "s.newlines_before + 1", "cast(f.f->>'line' as bigint) + s.newlines_before"),
        NOTES, FIXED, answered("cuts"), findings("answered"),
    )
view(
    "check_auto_replies",
    ", based as (select * from parsed_answered)," + exploded("based", "0", "cast(f.f->>'line' as bigint)"),
    NOTES,
    "samples as (select path, cast(0 as bigint) section_no, content[1:5000] section from md)",
    answered("samples"),
    findings("answered"),
)

PROTECTED_BUT_URL = (
    r"""\A---\n[\s\S]*?\n---|```[\s\S]*?```|`[^`\n]+`|\$\$[\s\S]*?\$\$|\$[^$\s][^$\n]*\$|!?\[\[[^\]\n]*\]\]|"""
    r"""\[\^[^\]\n]+\]:?|(?:\A|\n)\|[^\n]*|</?[A-Za-z][^>\n]*>|\s\^[A-Za-z0-9-]+"""
)
PROTECTED = PROTECTED_BUT_URL + r"|https?://[^\s)>\]]+"


def masked(text: str, pattern: str, fill: str) -> str:
    return f"""array_to_string(list_transform(list_zip(regexp_split_to_array({text}, '{pattern}'),
    regexp_extract_all({text}, '{pattern}')), lambda z: z[1] || regexp_replace(coalesce(z[2], ''), '[^\\n]', {fill}, 'g')), '')"""


def lint(source: str) -> str:
    """``lint_rows(path, section_no, line, rule)`` of ``source(path, section_no, section)``."""
    return rf"""
raw_lines as (select path, section_no, generate_subscripts(l, 1) line, unnest(l) raw, unnest(m) t from (
  select path, section_no, string_split(section, chr(10)) l, string_split({masked("section", PROTECTED_BUT_URL, "chr(1)")}, chr(10)) m from {source})),
marked as (select *, trim(t, ' '||chr(9)) = '' blank,
    length(regexp_extract(t, '^(#{{1,6}}) ', 1)) level, regexp_extract(t, '^[ \t]*([-*]) ', 1) mark, starts_with(raw, '```') fence from raw_lines),
heads as (select *, lag(level) over (partition by path, section_no order by line) prev from marked where level > 0),
fences as (select *, row_number() over (partition by path, section_no order by line) k from marked where fence),
bullets as (select *, first_value(mark) over (partition by path, section_no order by line) first_mark from marked where mark <> ''),
around as (select *, lead(blank, 1, false) over w next_blank, lag(blank, 1, false) over w prev_blank from marked window w as (partition by path, section_no order by line)),
lint_rows as (
  select path, section_no, line, 'comma_space' rule, 'space before comma' issue, true fixable from marked where regexp_matches(t, '[^ ] +,')
  union all select path, section_no, line, 'blank_run', 'several blank lines', true from around where blank and next_blank and not prev_blank
  union all select path, section_no, line, 'heading_jump', 'heading level skipped', false from heads where level > prev + 1
  union all select path, section_no, line, 'bare_url', 'bare URL', false from marked where regexp_matches(t, '(^|[^(<\[])https?://')
  union all select path, section_no, line, 'fence_language', 'code fence without a language', false from fences where k % 2 = 1 and trim(raw, ' '||chr(9)) = '```'
  union all select path, section_no, line, 'mixed_bullets', 'mixed list markers', false from bullets where mark <> first_mark)"""


WHOLE = "whole as (select path, 0 section_no, content section from md)"
view("lint_findings", "select path, line, rule, fixable from lint_rows", NOTES, WHOLE, lint("whole"))
view(
    "check_full_lint",
    f""", offsets as (select path, section_no, coalesce(sum({lines("section")} + 1)
  over (partition by path order by section_no rows between unbounded preceding and 1 preceding), 0) line_offset from packs)
select f.path, f.section_no, 'issue' kind, row_number() over (partition by f.path, f.section_no order by f.line, f.rule) - 1 pos,
  f.issue what, cast(f.line + o.line_offset as bigint) line,
  cast((select arg_max(p.exact + f.line - p.packed, p.packed) from spots p
    where p.path = f.path and p.section_no = f.section_no and p.packed <= f.line) as bigint) line_exact
from lint_rows f join offsets o on o.path = f.path and o.section_no = f.section_no""",
    NOTES, PACKED, lint("packs"),
    recursive=True,
)
view(
    "findings_merged",
    """select path, row_number() over (partition by path order by section_no, line, rule) - 1 pos, rule, line section_line
from lint_rows""",
    NOTES, PACKED, lint("packs"),
    recursive=True,
)
SAMPLES = "samples as (select path, cast(0 as bigint) section_no, content[1:5000] section, length(content) <= 5000 whole_note from md)"
VERDICTS = """
counted as (select s.path, s.whole_note, length(s.section) chars, count(l.line) n
  from samples s left join lint_rows l on l.path = s.path group by 1, 2, 3),
verdicts as (select path, n n_findings, round(n / (chars / 1000.0), 4) density,
  case when chars = 0 then n > 0 else n / (chars / 1000.0) >= 3 end suggest_full, whole_note, chars from counted),
reasons as (select *, case when suggest_full then 'Found '||n_findings||' errors in first '||cast(floor(chars/1000.0+0.5) as bigint)
  ||'k characters ('||printf('%.1f', round(n_findings / (chars / 1000.0), 1))||' errors/k). Threshold is 3 errors/k.' end reason from verdicts)"""
view(
    "auto_verdicts",
    "select path, n_findings, density, suggest_full, reason, whole_note from reasons",
    NOTES, SAMPLES, lint("samples"), VERDICTS,
)
view(
    "mode_suggestions",
    "select path, 'auto' mode, 'full' suggested_mode, reason from reasons where suggest_full",
    NOTES, SAMPLES, lint("samples"), VERDICTS,
)
view(
    "request_estimate",
    "select path, cast(ceil(length(content)/4000.0) as bigint) n_full, cast(1 as bigint) n_incremental, cast(1 as bigint) n_auto from md",
    NOTES,
)

# --- text functions ----------------------------------------------------------------------------------------

HASHED = """
folded as (select path, list_reduce(list_transform(string_split(content, ''), lambda c: cast(unicode(c) as bigint)),
   lambda h, c: (h * 31 + c) & 4294967295, cast(0 as bigint)) h from notes),
hashed as (select path, ltrim(array_to_string(list_transform([5,4,3,2,1,0], lambda k:
   substr('0123456789abcdefghijklmnopqrstuvwxyz', cast(v // cast(pow(36, k) as bigint) % 36 as integer) + 1, 1)), ''), '0') hash
   from (select path, case when h >= 2147483648 then 4294967296 - h else h end v from folded))"""
view("text_hashes", "select path, hash from hashed", NOTES, HASHED)
view(
    "compat_cache_keys",
    """select m.path, 'spell:'||m.lang||':'||h.hash||':standard' spell_key,
  'smart-link:'||(select path from anchor)||':'||m.path link_key, 'vault-analysis-chunk-'||c.chunk_no theme_key
from md m join hashed h on h.path = m.path join members c on c.path = m.path""",
    NOTES, HASHED, MEMBERS,
)

MODEL = (
    f"model_replies as (select doc_id, 'k'||doc_id request_key, "
    f"{reply('doc_id % 6', reply_json(FIRST_WORD.format('text')))} raw from documents)"
)
REPLIED = "replied as (select n.*, r.corrections, r.issues from notes n join parsed_model_replies r on r.doc_id = n.doc_id where r.parse_ok)"
view(
    "apply_single",
    """select path, pos, replace(content, c->>'original', c->>'suggested') as content from (
  select path, content, unnest(corrections) c, generate_subscripts(corrections, 1) - 1 pos from replied)""",
    NOTES, MODEL, findings("model_replies"), REPLIED,
)
view(
    "apply_corrections",
    """select path, list_reduce(list_prepend(to_json({'t': content}), corrections),
  lambda a, c: to_json({'t': replace(a->>'t', c->>'original', c->>'suggested')}))->>'t' as content from replied""",
    NOTES, MODEL, findings("model_replies"), REPLIED,
)
view(
    "apply_fixes",
    """select path, list_reduce(list_prepend(to_json({'t': content}), issues),
  lambda a, c: to_json({'t': replace(a->>'t', c->>'originalText', c->>'suggestedText')}))->>'t' as content from replied""",
    NOTES, MODEL, findings("model_replies"), REPLIED,
)
view(
    "highlighted_lines",
    r"""select path, regexp_replace(string_split(content, chr(10))[cast(c->>'line' as bigint)], '(?i)('||regexp_escape(c->>'original')||')',
  '<mark class="error-highlight">\1</mark>', 'g') marked, cast(round(cast(c->>'confidence' as double) * 100) as bigint) confidence_percent
from (select path, content, unnest(corrections) c from replied)""",
    NOTES, MODEL, findings("model_replies"), REPLIED,
)
view(
    "file_sizes",
    """select path, case when n = 0 then '0 Bytes' else rtrim(rtrim(printf('%.2f', round(n / div, 2)), '0'), '.')||' '||unit end size from (
  select path, n, case when n < 1024 then 1.0 when n < 1048576 then 1024.0 when n < 1073741824 then 1048576.0 else 1073741824.0 end div,
    case when n < 1024 then 'Bytes' when n < 1048576 then 'KB' when n < 1073741824 then 'MB' else 'GB' end unit
  from (select path, strlen(content) n from notes))""",
    NOTES,
)
ORACLES["entry_ages"] = """
select event_id, case when s >= 3600 then (s // 3600)||'h '||(s // 60 % 60)||'m' when s >= 60 then (s // 60)||'m '||(s % 60)||'s'
  else s||'s' end age from (select event_id, date_diff('microsecond', ts, timestamp '2024-02-01') // 1000000 s from events)"""
view(
    "derived_paths",
    """select path, regexp_replace(path, '\\.md$', '-corrected.md') corrected_path,
  regexp_replace(path, '\\.md$', '-enhanced.md') enhanced_path, '[['||path||']]' link_text from md""".replace("\\\\", "\\"),
    NOTES,
)
view("trimmed_notes", f"select path, {trim('content')} as content from notes", NOTES)

# --- requests ----------------------------------------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def system(template: str, lang: str = "lang") -> str:
    return f"replace({q(template)}, '{{language}}', {lang}) || case when {lang} = 'ar' then {q(rq.ARABIC_CLAUSE)} else '' end"


def body(kind: str, model: str, sys: str, user: str) -> str:
    tokens, temperature = params.REQUEST_LIMITS[kind]
    return f"""cast(to_json({{'model': {q(model)}, 'messages': [{{'role': 'system', 'content': {sys}}}, {{'role': 'user', 'content': {user}}}],
  'max_tokens': {tokens}, 'temperature': cast({temperature} as double)}}) as varchar)"""


def user(text: str) -> str:
    return q(text).replace("\n", "'||chr(10)||'")


view(
    "check_requests",
    f"""select p.path, section_no, 'spell:'||lang||':{params.CHECK_MODEL}:standard:'||sha256(section) as key, length(section) > 5000 truncated,
  {body("check", params.CHECK_MODEL, system(rq.CHECK_TEMPLATES["standard"]), user(rq.CHECK_USER) + "||section[1:5000]")} body
from packs p join md using (path)""",
    NOTES, PACKED,
    recursive=True,
)
_SHORT, _FRENCH = "Spelling of {language}: JSON only.", "JSON seulement ({language})."
view(
    "template_requests",
    f"""select path, section_no, 'spell:'||lang||':{params.CHECK_MODEL}:'||variant||':'||sha256(section) as key,
  case when variant = 'short' and lang = 'de' then {body("check", params.CHECK_MODEL, "'Nur JSON.'", user(rq.CHECK_USER) + "||section[1:5000]")}
  when variant = 'short' then {body("check", params.CHECK_MODEL, system(_SHORT), user(rq.CHECK_USER) + "||section[1:5000]")}
  when variant = 'standard' and lang = 'fr' then {body("check", params.CHECK_MODEL, system(_FRENCH), user(rq.CHECK_USER) + "||section[1:5000]")}
  when variant = 'standard' then {body("check", params.CHECK_MODEL, system(rq.CHECK_TEMPLATES["standard"]), user(rq.CHECK_USER) + "||section[1:5000]")}
  else {body("check", params.CHECK_MODEL, system(rq.CHECK_TEMPLATES["superprompt"]), user(rq.CHECK_USER) + "||section[1:5000]")} end body
from packs join (select path, lang, (['standard', 'superprompt', 'short'])[doc_id % 3 + 1] variant from md) using (path)""",
    NOTES, PACKED,
    recursive=True,
)
view(
    "theme_requests",
    f"""select chunk_no, 'themes:{params.THEME_MODEL}:'||sha256(names) as key,
  {body("themes", params.THEME_MODEL, q(rq.THEME_TEMPLATE), user(rq.THEME_USER) + "||names")} body from chunks""",
    NOTES, MEMBERS, CHUNKS,
)
_nl = "chr(10)"
view(
    "link_requests",
    f"""select c.path, 'smart-link:{params.LINK_MODEL}:'||sha256(a.content)||':'||sha256(c.content)||':'||a.path||':'||c.path as key,
  {body("link", params.LINK_MODEL, q(rq.LINK_TEMPLATE),
        f"'Compare these files:'||{_nl}||{_nl}||'File A ('||a.basename||'):'||{_nl}||a.content[1:3000]||{_nl}||{_nl}||'File B ('||c.basename||'):'||{_nl}||c.content[1:3000]")} body
from md c, md a where a.path = (select path from anchor) and c.path <> a.path""",
    NOTES,
)
view(
    "rewrite_requests",
    " union all ".join(
        f"""select path, section_no, '{kind}:'||lang||':{model}:'||sha256(section) as key,
  {body(kind, model, system(template), user(head) + "||section")} body from rewrite_sections where kind = '{kind}'"""
        for kind, model, template, head in (
            ("correct", params.CHECK_MODEL, rq.CORRECT_TEMPLATE, rq.CORRECT_USER),
            ("enhance", params.ENHANCE_MODEL, rq.ENHANCE_TEMPLATE, rq.ENHANCE_USER),
        )
    ),
    NOTES,
    REWRITE,
)

# --- replies -----------------------------------------------------------------------------------------------

view(
    "cleaned_replies",
    r"""select request_key, regexp_replace(raw, '(?s).*?</think>', '', 'g') without_reasoning,
  regexp_replace(raw, '(?s)```[A-Za-z]*\n?(.*?)```', '\1', 'g') unfenced, regexp_replace(raw, '(?s)```.*?```', '', 'g') fences_dropped,
  regexp_extract(regexp_replace(raw, '(?s).*?</think>', '', 'g'), '(?s)\{.*\}') "object" from model_replies""",
    MODEL,
)
CORRECTIONS = """
corr as (select request_key, pos, c->>'original' original, c->>'suggested' suggested, cast(c->>'line' as bigint) line,
  cast(c->>'confidence' as double) confidence, coalesce(nullif(c->>'context', ''), 'No context available') context
from (select request_key, unnest(corrections) c, generate_subscripts(corrections, 1) - 1 pos from parsed_model_replies where parse_ok))"""
view("parsed_corrections", "select * from corr", MODEL, findings("model_replies"), CORRECTIONS)
ISSUES = """
iss as (select request_key, pos, c->>'issue' issue, cast(c->>'line' as bigint) line, c->>'suggestion' suggestion,
  cast(c->>'fixable' as boolean) fixable, coalesce(nullif(c->>'originalText', ''), 'No original text available') original_text,
  coalesce(nullif(c->>'suggestedText', ''), 'No suggested text available') suggested_text
from (select request_key, unnest(issues) c, generate_subscripts(issues, 1) - 1 pos from parsed_model_replies where parse_ok))"""
view("parsed_issues", "select * from iss", MODEL, findings("model_replies"), ISSUES)
view("reply_status", "select request_key, parse_ok from parsed_model_replies", MODEL, findings("model_replies"))
view(
    "fixable_issues",
    """select request_key, original_text, suggested_text from iss where fixable
  and original_text not like 'No %text available' and suggested_text not like 'No %text available'""",
    MODEL, findings("model_replies"), ISSUES,
)
view(
    "kept_corrections",
    "select request_key, original, suggested, confidence from corr where confidence >= 0.75 and original <> suggested",
    MODEL, findings("model_replies"), CORRECTIONS,
)
LINK_REPLIES = """link_replies as (select doc_id, 'link:'||doc_id||':'||(doc_id-1) request_key,
 json(concat('{"shouldLink":',case when doc_id%7=0 then 'false' else 'true' end,
  ',"relevance":',cast(cast((doc_id%100)/100.0 as decimal(3,2)) as varchar),
  ',"connectionType":"',case doc_id%4 when 0 then 'conceptual' when 1 then 'sequential' when 2 then 'complementary' else 'reference' end,
  '","reasoning":"r","commonThemes":["t',cast(doc_id%5 as varchar),'"]}')) raw
from documents where doc_id>0)"""
view(
    "parsed_links",
    """select request_key, n.path, n.basename title, cast(raw->>'relevance' as double) relevance,
  cast(round(cast(raw->>'relevance' as double) * 100) as bigint) relevance_percent, raw->>'connectionType' connection_type,
  raw->>'reasoning' reasoning, raw->'commonThemes'->>0 common_themes, n.content[1:200] content_preview
from link_replies r join notes n on n.doc_id = r.doc_id - 1
where raw->>'shouldLink' = 'true' and cast(raw->>'relevance' as decimal(3,2)) > 0.30""",
    NOTES,
    LINK_REPLIES,
)
view(
    "best_reply_links",
    """select n.path, n.basename title, cast(raw->>'relevance' as double) relevance, raw->>'connectionType' connection_type
from link_replies r join notes n on n.doc_id = r.doc_id - 1
where raw->>'shouldLink' = 'true' and cast(raw->>'relevance' as decimal(3,2)) > 0.30 order by relevance desc, n.path limit 20""",
    NOTES,
    LINK_REPLIES,
)
view(
    "findings_counts",
    """, ok as (select path, case when parse_ok then len(corrections) else 0 end c, case when parse_ok then len(issues) else 0 end i,
  case when parse_ok then len(list_filter(issues, lambda x: x->>'fixable' = 'true')) else 0 end x from parsed_answered)
select path, cast(sum(c) as bigint) n_corrections, cast(sum(i) as bigint) n_issues, cast(sum(x) as bigint) n_fixable, sum(c + i) = 0 clean
from ok group by path""",
    NOTES, PACKED, answered("packs"), findings("answered"),
    recursive=True,
)


def rewritten(kind: str, accept: str, suffix: str, name: str, where: str = "true") -> None:
    view(
        name,
        f"""select regexp_replace(path, '.md$', '-{suffix}.md') path, string_agg(out, chr(10)||chr(10) order by section_no) as content
from (select path, section_no, case when {accept} then clean else section end out from cleaned) group by 1""",
        NOTES,
        REWRITE,
        f"""raw_rewrites as (select path, section_no, section, case when {where} then case length(section) % 4 when 0 then '<think>plan</think>'||replace(section, 'e', 'E')
  when 1 then '```md'||chr(10)||'fenced'||chr(10)||'```'||chr(10)||replace(section, 'e', 'E') when 2 then 'too short'
  else '# '||replace(section, 'e', 'E')||chr(10) end end raw from rewrite_sections where kind = '{kind}')""",
        rf"""stripped as (select *, regexp_replace(regexp_replace({trim("raw")}, '(?s).*</think>', ''), '(?s)```.*?```', '', 'g') s from raw_rewrites)""",
        f"cleaned as (select *, {trim('s') if kind == 'correct' else 's'} clean from stripped)",
    )


rewritten("correct", "length(clean) > 50", "corrected", "corrected_notes")
rewritten("enhance", "starts_with(clean, '#')", "enhanced", "enhanced_notes")
rewritten("correct", "length(clean) > 50", "corrected", "corrected_cached", "length(section) % 3 <> 1")

view(
    "links_cached",
    """select path, basename title, relevance, connection_type from (
  select path, basename, code % 101 / 100.0 relevance, case when code % 4 = 0 then 'conceptual' else 'complementary' end connection_type
  from (select path, basename, ('0x' || substr(md5(path), 1, 6))::bigint code from md where path <> (select path from anchor))
  where code % 3 <> 1 and code % 7 <> 0)
where relevance > 0.3 order by relevance desc, path limit 20""",
    NOTES,
)

# --- cache -------------------------------------------------------------------------------------------------

LOG = """
log as (select event_id, ts, 'spell:en:'||user_id||':standard' as key, case when event_type in ('view','click') then 'get' else 'set' end op,
  cast(case when event_type = 'error' then 3600000 else 86400000 end as bigint) ttl_ms, 'v'||event_id as value from events)"""
CACHE = """
cache as (select * from (select *, row_number() over (partition by key order by ts desc, event_id desc) k from log where op = 'set') where k = 1)"""


def live(ts: str, ttl: str, now: str) -> str:
    return f"date_diff('microsecond', {ts}, {now}) <= {ttl} * 1000"


_NOW = f"timestamp '{CACHE_NOW}'"
view(
    "cache_lookup",
    f"""select o_orderkey request_id, 'spell:en:'||o_custkey||':standard' as key,
  case when c.key is null then 'miss' when {live("c.ts", "c.ttl_ms", _NOW)} then 'hit' else 'expired' end status,
  case when {live("c.ts", "c.ttl_ms", _NOW)} then c.value end as value
from orders left join cache c on c.key = 'spell:en:'||o_custkey||':standard'""",
    LOG, CACHE,
)
view(
    "cache_replay",
    f"""select event_id, key, case when s is null then 'miss' when {live("s.ts", "s.ttl_ms", "ts")} then 'hit' else 'expired' end status,
  case when {live("s.ts", "s.ttl_ms", "ts")} then s.value end as value
from (select *, last_value(case when op = 'set' then {{'ts': ts, 'ttl_ms': ttl_ms, 'value': value}} end ignore nulls)
  over (partition by key order by ts, event_id rows between unbounded preceding and current row) s from log) where op = 'get'""",
    LOG,
)
view("cache_saved_twice", "select key, value, ttl_ms from cache", LOG, CACHE)
view("cache_upsert", "select key, event_id, ttl_ms, value from cache", LOG, CACHE)
view(
    "cache_invalidate",
    "select key, value from cache where not regexp_matches(key, '^spell:en:1[0-9]*:')",
    LOG, CACHE,
)
view("cache_purge", f"select key, value from cache where {live('ts', 'ttl_ms', _NOW)}", LOG, CACHE)
view("cache_stats", "select count(*) size from cache", LOG, CACHE)
view("cache_key_list", "select key from cache", LOG, CACHE)
view(
    "cache_store",
    """select key, '{"value":"'||value||'","timestamp":'||(epoch_us(ts) // 1000)||',"ttl":'||ttl_ms||'}' entry from cache""",
    LOG, CACHE,
)
view("cache_reload", "select cast(event_id as varchar) as key, value, ttl_ms from log", LOG)
_PENDING = f"timestamp '{PENDING_NOW}'"
view(
    "pending_requests",
    f"""select key, min(path) path from keyed where key not in (
  select key from reply_cache where {live("ts", f"cast({params.CACHE_TTL_MS} as bigint)", _PENDING)}) group by key""",
    NOTES,
    f"all_keyed as (select *, 'spell:en:{params.CHECK_MODEL}:standard:'||sha256(content) as key from notes)",
    "keyed as (select a.key, a.path from all_keyed a join md on md.path = a.path)",
    """reply_cache as (select key, max(timestamp '2024-01-01' + to_minutes(cast(a.doc_id as integer))) ts
  from all_keyed a join labels l on l.doc_id = a.doc_id group by 1)""",
)

# --- deterministic judgements ------------------------------------------------------------------------------

view(
    "protected_mask",
    f"""select path, {masked("content", PROTECTED, "' '")} masked
from (select path, content from notes union all select url, html from pages)""",
    NOTES,
)
LEXICON = rf"""
note_lines as (select lang, path, h, generate_subscripts(l, 1) line, unnest(l) t
  from (select lang, path, md5(content) h, string_split({masked("content", PROTECTED, "' '")}, chr(10)) l from md)),
tokens as (select lang, path, h, line, unnest(regexp_extract_all(t, '{WORD}')) w from note_lines),
uses as (select lang, path, h, lower(w) word, count(*) c, min(line) line, bool_or(w <> lower(w)) cap from tokens group by all),
lexicon as (select lang, word, sum(c)::bigint n, count(*) n_notes, count(distinct h) > 1 several, max(c) most, min(h) h,
    min(line) first_line, bool_or(cap) cap from uses group by 1, 2),
suspects as (select * from lexicon where not several and most = 1 and not cap and 1 - 1.0/length(word) >= 0.75)"""
# Every pair of words whose lengths differ by at most one and that share a word with a hole is compared.
CANDIDATES = r"""
known as (select lang, word, n from lexicon where several),
forms as (
  select 's' side, lang, word, word form from suspects union all select 'k', lang, word, word from known
  union all select 's', lang, word, substr(word, 1, i-1)||substr(word, i+1) from (select *, unnest(range(1, length(word)+1)) i from suspects)
  union all select 'k', lang, word, substr(word, 1, i-1)||substr(word, i+1) from (select *, unnest(range(1, length(word)+1)) i from known)),
pairs as (select distinct a.lang, a.word original, b.word suggested from forms a join forms b
  on a.side = 's' and b.side = 'k' and a.lang = b.lang and a.form = b.form),
aligned as (select *, list_transform(range(1, length(original)+1), lambda i: original[i] <> suggested[i]) d from pairs),
near as (select * from aligned where
  case length(original) - length(suggested)
    when 0 then len(list_filter(d, lambda x: x)) = 1
    when 1 then len(list_filter(range(1, length(original)+1), lambda i: substr(original, 1, i-1)||substr(original, i+1) = suggested)) > 0
    when -1 then len(list_filter(range(1, length(suggested)+1), lambda i: substr(suggested, 1, i-1)||substr(suggested, i+1) = original)) > 0
    else false end),
chosen as (select * from (select p.lang, original, suggested, k.n frequency,
    row_number() over (partition by p.lang, original order by k.n desc, suggested) r
  from near p join known k on k.lang = p.lang and k.word = p.suggested) where r = 1),
found as (select c.lang, original, suggested, frequency, round(1 - 1.0/length(original), 4) confidence, m.path, s.first_line line
  from chosen c join suspects s on s.lang = c.lang and s.word = c.original join md m on m.lang = s.lang and md5(m.content) = s.h)"""
view("lexicon", "select lang, word, n, n_notes, several from lexicon", NOTES, LEXICON)
view("suspect_words", "select lang, word from suspects", NOTES, LEXICON)
view("spell_candidates", "select * from found", NOTES, LEXICON, CANDIDATES)
# Letters of two bytes become one, for distances are counted in bytes.
_ONE_BYTE = "translate({}, 'ßäçèéêíñóöü', '0123456789+')"
view(
    "spell_candidates_two",
    f""", spelt as (select *, {_ONE_BYTE.format("word")} bare from lexicon),
rest as (select s.* from spelt s join suspects using (lang, word) where 1 - 2.0 / length(word) >= 0.75
  and not exists (select 1 from chosen c where c.lang = s.lang and c.original = word)),
further as (select lang, original, suggested, frequency from (
  select s.lang, s.word original, k.word suggested, k.n frequency, row_number() over (partition by s.lang, s.word order by k.n desc, k.word) r
  from rest s join spelt k on k.several and k.lang = s.lang and abs(length(k.word) - length(s.word)) <= 2 and levenshtein(s.bare, k.bare) = 2) where r = 1)
select f.*, 1::bigint distance from found f union all
select c.lang, original, suggested, frequency, round(1 - 2.0 / length(original), 4), m.path, s.first_line, 2
from further c join suspects s on s.lang = c.lang and s.word = c.original join md m on m.lang = s.lang and md5(m.content) = s.h""",
    NOTES, LEXICON, CANDIDATES,
)
view(
    "spell_contexts",
    "select f.*, string_split(m.content, chr(10))[f.line] context from found f join md m on m.path = f.path",
    NOTES, LEXICON, CANDIDATES,
)
view(
    "safe_fixes",
    rf"""select path, array_to_string(list_transform(list_zip(regexp_split_to_array(content, '{PROTECTED}'),
    regexp_extract_all(content, '{PROTECTED}')), lambda z:
    regexp_replace(regexp_replace(z[1], ' +,', ',', 'g'), '\n{{3,}}', chr(10)||chr(10), 'g') || coalesce(z[2], '')), '') as content from md""",
    NOTES,
)
view(
    "snapshot_updated",
    rf""", fixed as (select path, array_to_string(list_transform(list_zip(regexp_split_to_array(content, '{PROTECTED}'),
    regexp_extract_all(content, '{PROTECTED}')), lambda z:
    regexp_replace(regexp_replace(z[1], ' +,', ',', 'g'), '\n{{3,}}', chr(10)||chr(10), 'g') || coalesce(z[2], '')), '') as content
  from md where doc_id % 200 = 0)
select n.path, coalesce(f.content, n.content) as content from notes n left join fixed f on f.path = n.path""",
    NOTES,
)
view(
    "lint_applied",
    """select m.path, case when coalesce(l.rules, '') = '' then m.content else list_reduce(list_prepend(to_json({'t': m.content}),
    list_transform(string_split(l.rules, ' '), lambda r: to_json({'t': r}))),
    lambda a, r: to_json({'t': case r->>'t' when 'comma_space' then replace(a->>'t', ' ,', ',')
      else replace(a->>'t', chr(10)||chr(10)||chr(10), chr(10)||chr(10)) end}))->>'t' end as content
from md m left join (select path, string_agg(rule, ' ' order by line, rule) rules from lint_rows where fixable group by 1) l on l.path = m.path""",
    NOTES, WHOLE, lint("whole"),
)

view(
    "check_mixed",
    f""", offsets as (select path, section_no, coalesce(sum({lines("section")} + 1)
  over (partition by path order by section_no rows between unbounded preceding and 1 preceding), 0) line_offset from packs)
select f.path, f.section_no, 'issue' kind, row_number() over (partition by f.path, f.section_no order by f.line, f.rule) - 1 pos,
  f.issue what, m.mode, cast(f.line + case mode when 'full' then o.line_offset when 'incremental' then newlines_before + 1 else 0 end as bigint) line,
  cast(case when mode = 'full' then (select arg_max(p.exact + f.line - p.packed, p.packed) from spots p
    where p.path = f.path and p.section_no = f.section_no and p.packed <= f.line) else f.line + newlines_before end as bigint) line_exact
from lint_rows f join mixed m on m.path = f.path and m.section_no = f.section_no
left join offsets o on o.path = f.path and o.section_no = f.section_no and m.mode = 'full'""",
    NOTES, PACKED, FIXED,
    """modes as (select path, content, (['full', 'incremental', 'auto'])[doc_id % 3 + 1] mode from md),
mixed as (select path, cast(section_no as bigint) section_no, section, mode, 0 newlines_before from packs join (select path, mode from modes) using (path) where mode = 'full'
  union all select path, section_no, section, mode, newlines_before from cuts join (select path, mode from modes) using (path) where mode = 'incremental'
  union all select path, 0, content[1:5000], mode, 0 from modes where mode = 'auto')""",
    lint("mixed"),
    recursive=True,
)

# --- links -------------------------------------------------------------------------------------------------

WEIGHTS = rf"""
postings as (select path, term, count(*) n from (
  select path, unnest(regexp_extract_all(lower(content), '{WORD}')) term from md) group by 1, 2),
idf as (select term, count(*) df, round(ln((select count(*) from md) / count(*)), 6) idf from postings group by 1),
weights as (select path, term, df, cast(round(round(1 + ln(n), 6) * idf, 6) as decimal(18,6)) w from postings join idf using (term) where idf > 0)"""
RELEVANCE = """
norms as (select path, sqrt(cast(sum(cast(w * w as decimal(38,12))) as double)) norm from weights group by 1),
dots as (select b.path, cast(sum(cast(a.w * b.w as decimal(38,12))) as double) dot from weights a join weights b on b.term = a.term and b.path <> a.path
  where a.path = (select path from {anchor}) group by 1),
relevance as (select d.path, round(dot / (n.norm * (select norm from norms where path = (select path from {anchor}))), 4) relevance
  from dots d join norms n on n.path = d.path)"""
NUMBERED = r"""regexp_replace({0}.basename, '[0-9]+$', '') {1}stem, try_cast(regexp_extract({0}.basename, '([0-9]+)$', 1) as bigint) {1}no"""
SHOWN = r""", found as (select * from relevance where relevance > 0.3 {more} order by relevance desc, path limit 20),
me as (select *, """ + NUMBERED.format("md", "src_") + r""", regexp_extract_all(content, '\[\[([^\[\]\n]+)\]\]', 1) cites from md
  where path = (select path from {anchor})),
common as (select path, string_agg(term, ', ' order by pos) themes, count(*) n from (
  select b.path, b.term, row_number() over (partition by b.path order by cast(a.w * b.w as decimal(38,12)) desc, b.term) pos
  from weights a join weights b on b.term = a.term where a.path = (select path from {anchor}) and b.path in (select path from found))
  where pos <= 5 group by 1),
other as (select r.path, m.basename title, relevance, m.content, c.themes, c.n, me.basename src_title, me.cites, src_stem, src_no, """ + NUMBERED.format("m", "") + r"""
  from found r join md m on m.path = r.path join common c on c.path = r.path cross join me)
select path, title, relevance, cast(floor(relevance * 100 + 0.5) as bigint) relevance_percent,
  case when list_contains(cites, title) or list_contains(regexp_extract_all(content, '\[\[([^\[\]\n]+)\]\]', 1), src_title) then 'reference'
    when src_stem = stem and abs(src_no - no) = 1 then 'sequential' when n * 2 >= 5 then 'conceptual' else 'complementary' end connection_type,
  themes common_themes, 'Both notes share the themes '||themes reasoning, content[1:200] content_preview, '[['||path||']]' link_text from other"""
view("anchor_relevance", "select path, relevance from relevance", NOTES, WEIGHTS, RELEVANCE.format(anchor="anchor"))
view("smart_links_anchor", "select * from shown", NOTES, WEIGHTS,
     RELEVANCE.format(anchor="anchor"), "shown as (with " + SHOWN.format(anchor="anchor", more="")[2:] + ")")
view(
    "smart_links_many",
    """, sized as (select path, sqrt(cast(sum(cast(w * w as decimal(38,12))) as double)) norm from weights group by 1),
asked as (select path from md where doc_id % 50 = 0),
met as (select a.path src_path, b.path, cast(sum(cast(a.w * b.w as decimal(38,12))) as double) dot
  from weights a join asked on asked.path = a.path join weights b on b.term = a.term and b.path <> a.path group by 1, 2),
scored as (select m.src_path, m.path, round(m.dot / (b.norm * a.norm), 4) relevance
  from met m join sized a on a.path = m.src_path join sized b on b.path = m.path)
select * from (select src_path, row_number() over (partition by src_path order by relevance desc, path) as rank, path, relevance
  from scored where relevance > 0.3) where rank <= 20""",
    NOTES, WEIGHTS,
)
# An open note that bears the name, but for its number, of one of the first 20 notes.
NEAR = """first as (select path, regexp_replace(basename, '[0-9]+$', '') stem from md order by path limit 20),
near as (select coalesce((select arg_min(path, (-length(regexp_replace(basename, '[0-9]+$', '')), doc_id)) from md where regexp_replace(basename, '[0-9]+$', '') in (select stem from first)
  and path not in (select path from first)), (select path from anchor)) path)"""
CURRENT = "and path in (select path from md where path <> (select path from near) order by path limit 20)"
view("smart_links_current", "select * from shown", NOTES, NEAR, WEIGHTS,
     RELEVANCE.format(anchor="near"), "shown as (with " + SHOWN.format(anchor="near", more=CURRENT)[2:] + ")")
THEMES = """
themes as (select path, pos, term theme from (
  select path, term, row_number() over (partition by path order by w desc, term) pos from weights where df > 1) where pos <= 5)"""
view("note_themes", "select path, pos, theme from themes", NOTES, WEIGHTS, THEMES)
# All pairs of notes that share a theme, counted and ranked.
view(
    "theme_partners",
    r""", common as (select a.path src_path, b.path, count(*) n_common, string_agg(a.theme, ', ' order by a.pos) common_themes
  from themes a join themes b on b.theme = a.theme and b.path <> a.path group by 1, 2),
ranked as (select *, round(n_common / 5, 4) theme_share, row_number() over (partition by src_path order by n_common desc, path) rank from common),
cites as (select distinct path, unnest(regexp_extract_all(content, '\[\[([^\[\]\n]+)\]\]', 1)) target from md),
named as (select r.*, s.basename src_title, t.basename title, t.content[1:200] content_preview,
    regexp_replace(s.basename, '[0-9]+$', '') src_stem, regexp_replace(t.basename, '[0-9]+$', '') stem,
    try_cast(regexp_extract(s.basename, '([0-9]+)$', 1) as bigint) src_no, try_cast(regexp_extract(t.basename, '([0-9]+)$', 1) as bigint) no
  from ranked r join md s on s.path = r.src_path join md t on t.path = r.path where rank <= 20)
select src_path, rank, path, title, theme_share, cast(round(theme_share * 100) as bigint) share_percent,
  case when exists (select 1 from cites c where (c.path = n.src_path and c.target = n.title) or (c.path = n.path and c.target = n.src_title)) then 'reference'
    when src_stem = stem and abs(src_no - no) = 1 then 'sequential' when n_common * 2 >= 5 then 'conceptual' else 'complementary' end connection_type,
  common_themes, 'Both notes share the themes '||common_themes reasoning, content_preview, '[['||path||']]' link_text
from named n""",
    NOTES, WEIGHTS, THEMES,
)
ORACLES["embedding_links"] = """
with a as (select cast(embedding as double[]) q from embeddings where vec_id = (select min(vec_id) from embeddings))
select vec_id, cast(label as bigint) label, round(list_cosine_similarity(cast(embedding as double[]), q), 6) similarity
from embeddings, a where vec_id <> (select min(vec_id) from embeddings) order by similarity desc, vec_id limit 20"""
ORACLES["cache_store_lookup"] = ORACLES["cache_lookup"]
