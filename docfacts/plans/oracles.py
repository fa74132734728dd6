"""SQL that DuckDB runs on the given tables to check the registered queries.

Compositions are worked on in long form (one row per element) and texts with list and
regex functions, independently of the map expressions of the library.
"""

from __future__ import annotations

from docfacts.functions.composition import ATOMIC_WEIGHTS
from docfacts.plans import fixtures as fx
from docfacts.plans.queries import DIVISOR, INSTRUCTION, LIST_SIZE, PROMPT

_ALLOYS = fx.duckdb_sql(fx.ALLOYS)
_RESPONSES = fx.duckdb_sql(fx.RESPONSES)
_RECORD_FILES = fx.duckdb_sql(fx.RECORD_FILES)
_GEOMETRY = fx.duckdb_sql(fx.PAGE_GEOMETRY)
_VERDICTS = fx.duckdb_sql(fx.VERDICTS)
_LABELS = fx.duckdb_sql(fx.LABEL_FILE)
_PATHS = fx.duckdb_sql(fx.PATHS)

_W = r"\p{L}\p{N}_"
_WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"

# ---- compositions in long form ----

_SPELLINGS = f"""
alloys as ({_ALLOYS}),
spellings as (
  select rec_id, 'name' as source, name as txt from alloys
  union all select rec_id, 'nominal', nominal_composition from alloys
  union all select rec_id, 'measured', measured_composition from alloys
  union all select rec_id, 'odd', spelling from ({fx.duckdb_sql(fx.ODD_SPELLINGS)}) o
)"""

_CLEAN = f"trim(regexp_replace(translate(txt, ',;|＝：–—', '   =:--'), '[{_WS}]+', ' ', 'g'))"
# The patterns of a formula term and of a number with a unit.
_TERM = r"([A-Z][a-z]?)(-?\d*\.?\d*(?:e[+-]?\d+)?)"
_NUM_UNIT = r"(-?\d*\.?\d+(?:[eE][+-]?\d+)?)([a-zA-Z%]*)"
_WEIGHT_ROWS = ", ".join(f"('{e}', {w})" for e, w in ATOMIC_WEIGHTS.items())


def _formula_terms(cleaned: str) -> str:
    """Elements and amounts of every text of a ``rec_id, source, c`` relation."""
    return f"""
  select rec_id, source, element, sum(coalesce(try_cast(n as double), 1)) as amount
  from (select rec_id, source, unnest(regexp_extract_all(replace(c, '%', ' '), '{_TERM}', 1)) as element,
          unnest(regexp_extract_all(replace(c, '%', ' '), '{_TERM}', 2)) as n
        from {cleaned}) t
  group by all"""


_PARSERS = f"""
{_SPELLINGS},
cleaned as (select rec_id, source, txt, {_CLEAN} as c from spellings),
sides as (
  select rec_id, source,
    regexp_extract_all(c[:instr(c, '=') - 1], '[A-Z][a-z]?') as els,
    regexp_extract_all(c[instr(c, '=') + 1:], '-?\\d*\\.?\\d+(?:e[+-]?\\d+)?') as nums
  from cleaned where contains(c, '=')
),
ratio as (
  select rec_id, source, els[i] as element, cast(arg_max(nums[i], i) as double) as amount
  from (select *, unnest(range(1, len(els) + 1)) as i from sides where len(els) > 0 and len(els) = len(nums)) t
  group by all
),
words as (
  select rec_id, source, string_split(
    regexp_replace(regexp_replace(c, '(at|wt)[.] ?%', '\\1%', 'g'), '[ ,]+', ' ', 'g'), ' ') as t
  from cleaned where contains(c, ' ')
),
pair_words as (
  select rec_id, source, i, t[i] as element,
    case when regexp_full_match(t[i + 1], '{_NUM_UNIT}') then t[i + 1]
      when t[i + 1] = '=' and regexp_full_match(t[i + 2], '{_NUM_UNIT}') then t[i + 2] end as word
  from (select *, unnest(range(1, len(t) + 1)) as i from words) w
  where regexp_full_match(t[i], '[A-Z][a-z]?')
),
pair_values as (
  select rec_id, source, i, element, cast(regexp_extract(word, '{_NUM_UNIT}', 1) as double) as v,
    lower(regexp_extract(word, '{_NUM_UNIT}', 2)) as u
  from pair_words where word is not null
),
pair_units as (
  select rec_id, source,
    arg_min(case when contains(u, 'wt') then 'wt' else 'at' end, i) filter (contains(u, 'wt') or contains(u, 'at')) as unit
  from pair_values group by all
),
pairs as (
  select rec_id, source, unit, element, sum(v) as amount
  from pair_values join pair_units using (rec_id, source) group by all
),
formula as ({_formula_terms("cleaned")}),
formula_units as (
  select rec_id, source, case when abs(sum(amount) - 100) < 1e-3 then 'at' end as unit from formula group by all
),
parsed as (
  select rec_id, source, cast(null as varchar) as unit, element, amount from ratio
  union all
  select rec_id, source, unit, element, amount from pairs anti join ratio using (rec_id, source)
  union all
  select rec_id, source, unit, element, amount
  from formula join formula_units using (rec_id, source) anti join ratio using (rec_id, source)
    anti join pairs using (rec_id, source)
),
weights(element, weight) as (values {_WEIGHT_ROWS}),
moles as (
  select rec_id, source, unit, element,
    case when unit = 'wt' then amount / coalesce(weight, 1) else amount end as v
  from parsed left join weights using (element)
),
totals as (select rec_id, source, any_value(unit) as unit, sum(v) as total from moles group by rec_id, source),
fractions as (
  select m.rec_id, m.source, element, v / total as fraction
  from moles m join totals t using (rec_id, source)
  where total > 0 or (t.unit = 'at' and total <> 0)
),
names as (
  select rec_id, source, element, case when bool_and(abs(amount - 1) <= 1e-9) over w then 1.0 else amount end as v
  from formula window w as (partition by rec_id, source)
),
inferred as (
  select rec_id, source, element, v / total as fraction
  from names join (select rec_id, source, sum(v) as total from names group by all) t using (rec_id, source)
  where total > 0
)"""


def _compositions(rest: str) -> str:
    return f"with {_PARSERS}{rest}"


def _every_row(relation: str, value: str, alias: str, extra: str = "") -> str:
    """Rows of a long relation, and one row of nulls for each text without any."""
    return f"""
select s.rec_id, s.source, {extra}r.element, round(r.{value}, 6) as {alias}
from spellings s left join {relation} r on r.rec_id = s.rec_id and r.source = s.source"""


_COMPARED = f"""{_PARSERS},
nominal as (select rec_id, element, fraction from fractions where source = 'nominal'),
sides2 as (
  select rec_id, 'name' as side, element, fraction from inferred where source = 'name'
  union all select rec_id, 'measured', element, fraction from fractions where source = 'measured'
),
elements as (
  select distinct rec_id, side, element from (
    select rec_id, side, element from sides2
    union all
    select n.rec_id, s.side, n.element from nominal n join (select distinct rec_id, side from sides2) s using (rec_id)) u
),
measures as (
  select e.rec_id, e.side,
    sum(abs(coalesce(n.fraction, 0) - coalesce(s.fraction, 0))) as l1,
    coalesce(sum(coalesce(n.fraction, 0) * coalesce(s.fraction, 0))
      / nullif(sqrt(sum(coalesce(n.fraction, 0) ** 2)) * sqrt(sum(coalesce(s.fraction, 0) ** 2)), 0), 0) as cosine
  from elements e
    left join nominal n on n.rec_id = e.rec_id and n.element = e.element
    left join sides2 s on s.rec_id = e.rec_id and s.side = e.side and s.element = e.element
  group by e.rec_id, e.side
),
compared as (
  select a.rec_id, nn.l1 as l1_nom_vs_name, nm.l1 as l1_nom_vs_measured,
    nn.cosine as cos_nom_vs_name, nm.cosine as cos_nom_vs_measured,
    case when nn.l1 is null and nm.l1 is null then 'unknown'
      when coalesce(nn.l1 > 0.15 + 1e-12 or nn.cosine < 0.95 - 1e-12, false)
        and coalesce(nm.l1 > 0.15 + 1e-12 or nm.cosine < 0.95 - 1e-12, false)
        then 'inconsistent: name,measured'
      else 'OK' end as consistency_check
  from alloys a
    left join (from measures where side = 'name') nn using (rec_id)
    left join (from measures where side = 'measured') nm using (rec_id)
)"""

_NAMED = """,
kept as (select rec_id, element, fraction / min(fraction) over (partition by rec_id) as v from nominal where fraction > 1e-8),
name_order as (
  select rec_id, els[i] as element, i
  from (select rec_id, els, unnest(range(1, len(els) + 1)) as i
        from (select rec_id, regexp_extract_all(name, '[A-Z][a-z]?') as els from alloys where name is not null) t) u
),
ordered as (
  select rec_id, o.i, k.element, k.v from name_order o join kept k using (rec_id, element)
  union all
  select rec_id, 1000 + row_number() over (partition by rec_id order by k.element) as i, k.element, k.v
  from kept k anti join name_order o using (rec_id, element)
),
ratio_texts as (
  select rec_id, string_agg(element || printf('%.1f', v), '' order by i) as t1,
    string_agg(element || printf('%.3f', v), '' order by i) as t3
  from ordered group by all
),
short_names as (
  select a.rec_id,
    case when exists (from nominal n where n.rec_id = a.rec_id) and exists (from name_order o where o.rec_id = a.rec_id)
      then coalesce((select string_agg(o.element, '' order by o.i) from name_order o join nominal n using (rec_id, element)
        where o.rec_id = a.rec_id and n.fraction > 1e-8), '')
      else coalesce(a.name, '') end as name_without_zero
  from alloys a
)"""


def _json_of(relation: str, source: str, value: str) -> str:
    return f"""(select rec_id, '{{' || string_agg('"' || element || '": ' || cast(round({value}, 6) as varchar), ', ' order by element) || '}}' as j
    from {relation} where source = '{source}' group by rec_id)"""


_CHECK = f"""with {_COMPARED}{_NAMED}
select a.rec_id, a.name, a.nominal_composition, a.measured_composition,
  np.j as nominal_parsed, nf.j as nominal_molar_fractions, ni.j as name_inferred_equal_molar,
  mp.j as measured_parsed, mf.j as measured_molar_fractions,
  round(l1_nom_vs_name, 6) as l1_nom_vs_name, round(l1_nom_vs_measured, 6) as l1_nom_vs_measured,
  round(cos_nom_vs_name, 6) as cos_nom_vs_name, round(cos_nom_vs_measured, 6) as cos_nom_vs_measured,
  consistency_check, name_without_zero, t1 as "cleanned composition"
from alloys a join compared using (rec_id) join short_names using (rec_id) left join ratio_texts using (rec_id)
  left join {_json_of("parsed", "nominal", "amount")} np using (rec_id)
  left join {_json_of("fractions", "nominal", "fraction")} nf using (rec_id)
  left join {_json_of("inferred", "name", "fraction")} ni using (rec_id)
  left join {_json_of("parsed", "measured", "amount")} mp using (rec_id)
  left join {_json_of("fractions", "measured", "fraction")} mf using (rec_id)"""

# ---- answers: what comes out of each shape was traced by hand and stands beside it ----

_OUTCOMES = f"""outcomes as (
  select p_partkey as doc_id, {fx.filled_in("template")} as response, v1_status, branch, {fx.filled_in("v1_json")} as v1_json,
    nullif(no, 0) as candidate_no, repaired, {fx.filled_in("v2_json")} as json, string_split({fx.filled_in("candidates")}, '¦') as cs
  from part join ({fx.shape_rows(0, 1, 2, 3, 4, 5, 6, 7)}) as shapes(shape, template, v1_status, branch, v1_json, no, repaired, v2_json, candidates)
    on p_partkey % {len(fx.SHAPES)} = shape)"""


def _candidates(arrays_and_objects: int | None) -> str:
    """All candidates, or those left when only so many balanced chunks of each type are taken."""
    if arrays_and_objects is None:
        return f"""with {_OUTCOMES}
select doc_id, cast(unnest(range(1, len(cs) + 1)) as int) as candidate_no, unnest(cs) as candidate from outcomes"""
    # Only one shape has more than two chunks of a type: its third and fourth array.
    more = next(i for i, shape in enumerate(fx.SHAPES) if shape[7] and shape[7].startswith("[a]¦[b]¦"))
    return f"""with {_OUTCOMES},
taken as (select doc_id, case when doc_id % {len(fx.SHAPES)} = {more} then cs[:{arrays_and_objects}] else cs end as cs from outcomes)
select doc_id, cast(unnest(range(1, len(cs) + 1)) as int) as candidate_no, unnest(cs) as candidate from taken"""


_LIGHT_FIX = f"""with texts as (
  select 'answer' as source, doc_id as row_id, translate(response, '"', '''') as txt from ({_RESPONSES}) r
  union all select 'page', page_id, html from pages)
select source, row_id, regexp_replace(regexp_replace(regexp_replace(txt, ',([{_WS}]*[}}\\]])', '\\1', 'g'),
    '([{{\\[,])[{_WS}]*''([^''\\\\]*?)''[{_WS}]*:', '\\1 "\\2":', 'g'),
  ':[{_WS}]*''([^''\\\\]*?)''([{_WS}]*[,}}\\]])', ': "\\1"\\2', 'g') as fixed
from texts"""

# Records by the shape of their file, straight from the alloys.
_RECORDS = f"""alloys as ({_ALLOYS}),
shaped as (select *, rec_id % 5 as shape, 'paper.' || rec_id as paper from alloys),
entries as (
  select *, 0 as pos from shaped where shape <> 4
  union all select *, 1 from shaped where shape = 0
)"""

_PROFILE = f"""with {_RECORDS}
select field, count(*) as n_records, count(score) as n_scored, count(*) filter (score >= 90) as n_high,
  round(count(*) filter (score >= 90) / count(*), 6) as high_share
from (select unnest(['name', 'nominal_composition', 'measured_composition', 'lattice_constant', 'phases', 'alloy_condition', 'doi']) as field,
    unnest([conf, null, null, 100 - conf, null, null, null]) as score from entries) t
group by field"""

# ---- text and token budgets ----

_DASH = f"regexp_replace(text, '([{_W}])-\\n([{_W}])', '\\1\\2', 'g')"
_NORM = f"""regexp_replace(regexp_replace(regexp_replace({_DASH}, '[\\t\\r\\n]+', ' ', 'g'), '[{_WS}]{{2,}}', ' ', 'g'),
    '^[{_WS}]+|[{_WS}]+$', '', 'g')"""


def _stats() -> str:
    return f"""stats as (
  select doc_id, cast(1 + n_chars // 3000 as int) as pages, length(norm) as characters, words,
    cast(round_even(words / 0.75e0, 0) as bigint) as tokens_word_est,
    cast(round_even(length(norm) / 4e0, 0) as bigint) as tokens_char_est,
    cast(null as bigint) as tokens_tiktoken, 'table' as engine
  from (select *, len(regexp_extract_all(norm, '[{_W}][{_W}''-]*')) as words
        from (select doc_id, n_chars, {_NORM} as norm from documents where text is not null) d) e
)"""


def _budget(size: tuple[float, float] = (8.5, 11.0), image: str = f"image_mp * 1e6 / {DIVISOR}") -> str:
    return f"""{_stats()},
measured as (
  select doc_id, sum((width_in * 150) * (height_in * 150) / 1e6) as mp, count(*) as n from ({_GEOMETRY}) g group by doc_id
),
sized as (
  select s.*, coalesce(mp, ({size[0]}e0 * 150) * ({size[1]}e0 * 150) / 1e6 * greatest(pages, 1)) as image_mp,
    cast(coalesce(n, greatest(pages, 1)) as bigint) as pages_used
  from stats s left join measured using (doc_id)
),
budget as (
  select *, tokens_word_est + image_tokens as total_tokens_word_est, tokens_char_est + image_tokens as total_tokens_char_est,
    tokens_tiktoken + image_tokens as total_tokens_tiktoken
  from (select *, cast(round_even({image}, 0) as bigint) as image_tokens from sized) t
)"""


# ---- prompts, labels, verdicts ----

_SIMILARITY = f"""with history as ({fx.duckdb_sql(fx.PROMPT_HISTORY)}),
steps as (select *, lag(prompt) over (partition by run_id order by version) as previous from history),
pairs as (select * from steps where previous is not null),
terms as (
  select run_id, version, term, count_if(old) as a, count_if(not old) as b from (
    select run_id, version, true as old, unnest(regexp_extract_all(lower(previous), '[{_W}]{{2,}}')) as term from pairs
    union all
    select run_id, version, false, unnest(regexp_extract_all(lower(prompt), '[{_W}]{{2,}}')) from pairs) t
  group by all
),
weighted as (
  select run_id, version, a * idf as x, b * idf as y
  from (select *, ln(3e0 / (1 + (a > 0)::int + (b > 0)::int)) + 1 as idf from terms) t
),
sums as (
  select run_id, version, sum(x * y) as dot, sqrt(sum(x * x)) as nx, sqrt(sum(y * y)) as ny from weighted group by all
)
select p.run_id, p.version, round(case when coalesce(nx, 0) = 0 or coalesce(ny, 0) = 0 then 0 else dot / (nx * ny) end, 6) as similarity
from pairs p left join sums s on s.run_id = p.run_id and s.version = p.version"""

_LOG = """select log_id, version, epoch, step, elapsed_s, seconds_per_step, prompt, similarity from (
  select conv_id || '-' || turn as log_id, 1 as version, 0 as epoch, cast(turn as int) as step,
    cast((turn % 10) * 60 + 25 as int) as elapsed_s, 10 + turn + 0.58e0 as seconds_per_step,
    trim(text, chr(10)) as prompt, cast('0.' || (1000 + turn) as double) as similarity from conversations
  union all
  select conv_id || '-' || turn, 2, 1, cast(turn + 1 as int), cast(3600 + (turn % 10) * 60 + 30 as int), 97.69e0,
    role || ': [x, y]', 0.7723e0 from conversations) t"""

_LABEL_RECORDS = f"""labelled as (
  select rec_id, Paperid, HEAname as name, nominal_compositions as nominal_composition,
    measured_compositions as measured_composition,
    case when isnan(RT_Lattice_Constant_A) then null else RT_Lattice_Constant_A end as lattice_constant,
    Phase as phases, Processing_Method as alloy_condition, Ref as doi
  from ({_LABELS}) l
)"""

_LABEL_SETS = f"""with {_LABEL_RECORDS},
ranked as (select *, (row_number() over (partition by Paperid order by rec_id) - 1) // {LIST_SIZE} as list_no,
    count(*) over (partition by Paperid) as n_all from labelled)
select Paperid, 'papers/' || Paperid || '.pdf' as path, cast(list_no as int) as list_no,
  cast(ceil(any_value(n_all) / {LIST_SIZE}) as int) as n_lists, cast(count(*) as int) as n_items,
  cast(to_json(list({{'name': name, 'nominal_composition': nominal_composition, 'measured_composition': measured_composition,
    'lattice_constant': lattice_constant, 'phases': phases, 'alloy_condition': alloy_condition, 'doi': doi}} order by rec_id)) as varchar) as records
from ranked group by Paperid, list_no"""


def _batches(table: str) -> str:
    return f"""
  select epoch, pos // 3 as batch, cast(pos % 3 as int) as position, doc_id
  from (select epoch, doc_id, row_number() over (partition by epoch order by (doc_id * 7919 + epoch * 104729) % 1000003, doc_id) - 1 as pos
        from (select distinct doc_id from {table}) d, (select cast(unnest([0, 1, 2]) as int) as epoch) e) t"""


_FEEDBACK = f"""with batches as ({_batches("labels")}), judged as ({_VERDICTS})
select epoch, batch, count(*) as n_verdicts, string_agg(verdict_text, chr(10) || chr(10) order by position, verdict_text) as feedback
from batches join judged using (doc_id) group by all"""

_RECONCILE = f"""with alloys as ({_ALLOYS}), {_LABEL_RECORDS},
p as (select paper_id, name, 3000 + lattice_milli as k, count(*) as n from alloys group by all),
l as (select Paperid as paper_id, name, cast(round(lattice_constant * 1000) as bigint) as k, count(*) as n from labelled group by all),
both_sides as (
  select coalesce(p.paper_id, l.paper_id) as paper_id, coalesce(p.n, 0) as np, coalesce(l.n, 0) as nl
  from p full join l on p.paper_id = l.paper_id and p.name is not distinct from l.name and p.k is not distinct from l.k
),
sums as (
  select paper_id, cast(sum(np) as bigint) as n_pred, cast(sum(nl) as bigint) as n_label, cast(sum(least(np, nl)) as bigint) as n_match
  from both_sides group by all
)
select *, n_label - n_match as n_missed, n_pred - n_match as n_extra, n_pred = n_label as same_count,
  n_match = n_label and n_match = n_pred as same_lattice,
  case when n_pred = n_label and n_match = n_label then 'match' else 'no match' end as verdict
from sums"""

_SCORES = f"""with lines as (
  select doc_id, list_filter(string_split(verdict_text, chr(10)), lambda x: trim(x) <> '') as ls from ({_VERDICTS}) v
),
answers as (
  select doc_id, i as question_no, nullif(lower(regexp_extract(ls[i], '(?i)\\b(yes|no)\\b', 1)), '') as answer
  from (select *, unnest(range(1, len(ls) + 1)) as i from lines) t
)
select cast(question_no as int) as question_no, count(*) as n_answers, count(*) filter (answer = 'yes') as n_yes, count(*) filter (answer = 'no') as n_no,
  count(*) filter (answer is null) as n_unclear,
  round(count(*) filter (answer = case when question_no = 9 then 'no' else 'yes' end) / count(answer), 6) as good_rate
from answers group by all"""

# ---- documents and requests ----

_SCAN = f"""with paths as ({_PATHS})
select 'flat' as scan, path, split_part(split_part(path, '/', -1), '.', 1) as doc_id
from paths where regexp_full_match(path, '/in/[^/]*[.]pdf')
union all
select distinct 'recursive', path, cast(null as varchar) from paths where lower(path) like '%.pdf'"""

_KINDS = "case doc_id % 4 when 0 then 'pdf' when 1 then 'jpeg' when 2 then 'png' else 'unsupported' end"
_BASE64 = """to_base64(unhex(case doc_id % 4 when 0 then '255044462D312E37' when 1 then 'FFD8FFE0' else '89504E470D0A1A0A' end) || encode(text))"""
_BLOCK = """case kind when 'pdf' then '{"type":"document","source":{"type":"base64","media_type":"application/pdf","data":"' || b64 || '"}}'
    else '{"type":"image","source":{"type":"base64","media_type":"' || kind || '","data":"' || b64 || '"}}' end"""


def _text_block(value: str) -> str:
    return f"""'{{"type":"text","text":' || {value} || '}}'"""


def _fields(ground_truth: bool) -> str:
    parts = [
        ("Evaluation Instruction", _text_block(f"""'"{INSTRUCTION}"'""")),
        ("Question", _text_block(f"""'"{PROMPT}"'""")),
        ("Image", "block"),
        ("Answer", _text_block("cast(to_json(response) as varchar)")),
    ]
    if ground_truth:
        parts.append(("Ground Truth", _text_block("cast(to_json(records) as varchar)")))
    return "'[' || " + " || ',' || ".join(f"""'{{"field":"{f}","block":' || {b} || '}}'""" for f, b in parts) + " || ']'"


_REQUESTS = f"""with kinds as (select doc_id, text, {_KINDS} as kind from documents),
blocks as (select doc_id, kind, {_BLOCK} as block from (select *, case when kind <> 'unsupported' then {_BASE64} end as b64 from kinds) k),
truth as ({_LABEL_SETS}),
answered as (select b.*, r.response from blocks b join ({_RESPONSES}) r using (doc_id) where response is not null),
requests as (
  select doc_id, kind, 'extract' as request, cast(null as int) as list_no, cast(null as int) as n_lists, '[' || {_text_block(f'''\'"{PROMPT}"\'''')} || ',' || block || ']' as body from blocks
  union all select doc_id, kind, 'judge', null, null, {_fields(False)} from answered
  union all select a.doc_id, kind, 'train', list_no, n_lists, {_fields(True)} from answered a join truth t on t.Paperid = a.doc_id
)
select doc_id, request, list_no, n_lists, case when kind <> 'unsupported' then body end as body,
  case when kind = 'unsupported' then 'unsupported' end as reason from requests"""

_EDITED_STATS = f"""select doc_id, length(norm) as characters, words, cast(round_even(words / 0.75e0, 0) as bigint) as tokens_word_est,
  cast(round_even(length(norm) / 4e0, 0) as bigint) as tokens_char_est
from (select *, len(regexp_extract_all(norm, '[{_W}][{_W}''-]*')) as words
      from (select doc_id, {_NORM} as norm from ({fx.duckdb_sql(fx.EDITED_TEXTS)}) x where text is not null) d) e"""

_NO_IMAGES = """cast(null as double) as image_mp, cast(null as bigint) as image_tokens, cast(null as bigint) as total_tokens_word_est,
  cast(null as bigint) as total_tokens_char_est, cast(null as bigint) as total_tokens_tiktoken"""

_TOTAL_LINE = f"""with {_budget()},
sums as (
  select count(*) as files, sum(words) as words, sum(characters) as chars, sum(image_mp) as mp, sum(image_tokens) as it from budget),
est as (select *, cast(round_even(words / 0.75e0, 0) as bigint) as w, cast(round_even(chars / 4e0, 0) as bigint) as c from sums),
lines as (select *, 'TOTAL' || chr(9) || 'files=' || files || chr(9) || 'words=' || words || chr(9) || 'chars=' || chars || chr(9)
  || 'tokens(word-est)=' || w || chr(9) || 'tokens(char-est)=' || c || chr(9) || 'tokens(tiktoken)=-' as head from est)
select 'plain' as run, head as line from lines
union all select 'images', head || chr(9) || 'image_mp=' || printf('%.2f', mp) || chr(9) || 'image_tokens=' || it || chr(9)
  || 'total_tokens(word-est)=' || (w + it) || chr(9) || 'total_tokens(char-est)=' || (c + it) from lines"""

_AS_WEIGHT = f"""with {_PARSERS},
sums as (select rec_id, source, any_value(unit) as unit, sum(amount) as total from parsed group by rec_id, source),
by_weight as (
  select p.rec_id, p.source, p.element, p.unit, case when s.unit = 'wt' or (s.unit is null and abs(s.total - 100) < 0.1)
      then amount / coalesce(weight, 1) else amount end as v
  from parsed p join sums s on s.rec_id = p.rec_id and s.source = p.source left join weights w on w.element = p.element),
sums2 as (select rec_id, source, any_value(unit) as unit, sum(v) as total from by_weight group by rec_id, source),
weighed as (
  select m.rec_id, m.source, element, v / total as fraction from by_weight m join sums2 t on t.rec_id = m.rec_id and t.source = m.source
  where total > 0 or (t.unit = 'at' and total <> 0))""" + _every_row("weighed", "fraction", "fraction")

_STRICT = f"""select rec_id, {", ".join(f"replace({c}, '@', n) as {c}" for c in ("spelling", "amounts", "unit", "problems"))}
from (select p_partkey as rec_id, cast(cast(p_size as int) as varchar) as n, shapes.* from part
  join ({fx.strict_rows()}) as shapes(shape, spelling, amounts, unit, problems) on p_partkey % {len(fx.STRICT_SHAPES)} = shape) t"""

# Of the spellings in the table of alloys only "Not found" is not understood.
_UNDERSTOOD = f"""alloys as (
  select * replace (nullif(nominal_composition, 'Not found') as nominal_composition, nullif(measured_composition, 'Not found') as measured_composition)
  from ({_ALLOYS}) a)"""
_CHECK_STRICT = f"""with {_COMPARED.replace(f"alloys as ({_ALLOYS})", _UNDERSTOOD)}
select rec_id, consistency_check,
  case a.nominal_composition when 'Not found' then 'Not¦found' else case when a.nominal_composition is not null then '' end end as nominal_problems,
  case a.measured_composition when 'Not found' then 'Not¦found' else case when a.measured_composition is not null then '' end end as measured_problems
from compared join ({_ALLOYS}) a using (rec_id)"""


def _chains(tolerance: str) -> str:
    """Chains of constants and their matches by two pointers, in relation ``chains``."""
    return f"""
recursive reported as ({fx.duckdb_sql(fx.NEAR_CONSTANTS)}),
marked as (
  select *, case when lattice_constant - lag(lattice_constant) over w <= {tolerance} then 0 else 1 end as begins
  from reported where lattice_constant is not null window w as (partition by paper_id, name order by lattice_constant)
),
numbered as (
  select *, sum(begins) over (partition by paper_id, name order by lattice_constant rows unbounded preceding) as chain from marked
),
lists as (
  select paper_id, name, chain, min(lattice_constant) as low, max(lattice_constant) as high,
    coalesce(list(lattice_constant order by lattice_constant) filter (side = 'predicted'), []) as ps,
    coalesce(list(lattice_constant order by lattice_constant) filter (side = 'labelled'), []) as ls
  from numbered group by all
),
walk as (
  select *, 1 as i, 1 as j, 0 as met from lists
  union all
  select * exclude (i, j, met),
    case when abs(ps[i] - ls[j]) <= {tolerance} or ps[i] < ls[j] then i + 1 else i end,
    case when abs(ps[i] - ls[j]) <= {tolerance} or ps[i] >= ls[j] then j + 1 else j end,
    met + case when abs(ps[i] - ls[j]) <= {tolerance} then 1 else 0 end
  from walk where i <= len(ps) and j <= len(ls)
),
chains as (
  select paper_id, name, low, high, len(ps) as n_pred, len(ls) as n_label, cast(met as bigint) as n_match
  from walk where i > len(ps) or j > len(ls)
  union all
  select paper_id, name, null, null, count(*) filter (side = 'predicted'), count(*) filter (side = 'labelled'),
    least(count(*) filter (side = 'predicted'), count(*) filter (side = 'labelled'))
  from reported where lattice_constant is null group by all
)"""


_CHAINS_AGREE = f"""with {_chains('5e-4')}
select *, n_label - n_match as n_missed, n_pred - n_match as n_extra, n_pred = n_label as same_count,
  n_match = n_label and n_match = n_pred as same_lattice,
  case when n_pred = n_label and n_match = n_label and n_match = n_pred then 'match' else 'no match' end as verdict
from (select paper_id, cast(sum(n_pred) as bigint) as n_pred, cast(sum(n_label) as bigint) as n_label, cast(sum(n_match) as bigint) as n_match
  from chains group by paper_id) t"""

_NON_FINITE = f"""select p_partkey as doc_id, {fx.filled_in("v2_json")} as json, {fx.filled_in("lattice")} as lattice
from part join ({fx.non_finite_rows()}) as shapes(shape, template, v2_json, lattice) on p_partkey % {len(fx.NON_FINITE_SHAPES)} = shape"""

ORACLES: dict[str, str] = {
    "text_stats": f"with {_stats()} select * from stats",
    "image_megapixels": f"with {_budget((8.27, 11.69))} select doc_id, pages, round(image_mp, 6) as image_mp, pages_used from sized",
    "token_budget": f"with {_budget()} select * replace (round(image_mp, 6) as image_mp) from budget",
    "token_budget_rate": f"""with {_budget(image="image_mp * 1334")}
select doc_id, image_tokens, total_tokens_word_est, total_tokens_char_est, total_tokens_tiktoken from budget""",
    "token_report": f"""with {_budget()}
select doc_id, doc_id || chr(9) || 'pages=' || pages || chr(9) || 'chars=' || characters || chr(9) || 'words=' || words || chr(9)
  || 'tokens(word-est)=' || tokens_word_est || chr(9) || 'tokens(char-est)=' || tokens_char_est || chr(9) || 'tokens(tiktoken)=-'
  || chr(9) || 'engine=table' || chr(9) || 'image_mp=' || printf('%.2f', image_mp) || chr(9) || 'image_tokens=' || image_tokens || chr(9)
  || 'total_tokens(word-est)=' || total_tokens_word_est || chr(9) || 'total_tokens(char-est)=' || total_tokens_char_est as line
from budget""",
    "token_budget_csv": f"""with {_budget()}
select cast(doc_id as varchar) as file, cast(pages as varchar) as pages, cast(characters as varchar) as characters,
  cast(words as varchar) as words, cast(tokens_word_est as varchar) as tokens_word_est,
  cast(tokens_char_est as varchar) as tokens_char_est, '' as tokens_tiktoken, engine,
  printf('%.4f', image_mp) as image_mp, cast(image_tokens as varchar) as image_tokens,
  cast(total_tokens_word_est as varchar) as total_tokens_word_est,
  cast(total_tokens_char_est as varchar) as total_tokens_char_est, '' as total_tokens_tiktoken
from budget""",
    "token_totals": f"""with {_budget()},
sums as (
  select count(*) as files, cast(sum(words) as bigint) as words, cast(sum(characters) as bigint) as chars,
    cast(sum(tokens_tiktoken) as bigint) as tokens_tiktoken, round(sum(image_mp), 4) as image_mp,
    cast(sum(image_tokens) as bigint) as image_tokens from budget),
est as (select *, cast(round_even(words / 0.75e0, 0) as bigint) as tokens_word_est,
    cast(round_even(chars / 4e0, 0) as bigint) as tokens_char_est from sums)
select *, tokens_word_est + image_tokens as total_tokens_word_est, tokens_char_est + image_tokens as total_tokens_char_est,
  tokens_tiktoken + image_tokens as total_tokens_tiktoken from est""",
    "text_source_pick": """select doc_id,
  case when lang = 'en' or doc_id % 2 = 0 or source <> 'src1' then text end as text,
  case when lang = 'en' then 1 when doc_id % 2 = 0 then 2 when source <> 'src1' then 3 end as pages,
  case when lang = 'en' then 'pypdf' when doc_id % 2 = 0 then 'pdfminer' when source <> 'src1' then 'pdftotext' end as engine
from documents""",
    "parse_formula": f"""with {_SPELLINGS},
all_texts as (select * from spellings union all select doc_id, 'document', text from documents),
cleaned as (select rec_id, source, {_CLEAN} as c from all_texts),
terms as ({_formula_terms("cleaned")})
select s.rec_id, s.source, element, round(amount, 6) as amount
from all_texts s left join terms t on t.rec_id = s.rec_id and t.source = s.source""",
    "parse_ratio_form": _compositions(_every_row("ratio", "amount", "amount")),
    "parse_pairs": _compositions(_every_row("pairs", "amount", "amount", "r.unit, ")),
    "parse_composition": _compositions(_every_row("parsed", "amount", "amount", "r.unit, ")),
    "normalize_composition": _compositions(_every_row("fractions", "fraction", "fraction")),
    "weight_to_mole": _compositions(" select rec_id, source, element, round(v, 6) as moles from moles where unit = 'wt'"),
    "name_inferred": _compositions(_every_row("inferred", "fraction", "fraction")),
    "composition_distance": f"""with {_COMPARED}
select rec_id, round(l1_nom_vs_name, 6) as l1_nom_vs_name, round(l1_nom_vs_measured, 6) as l1_nom_vs_measured,
  round(cos_nom_vs_name, 6) as cos_nom_vs_name, round(cos_nom_vs_measured, 6) as cos_nom_vs_measured from compared""",
    "ratio_string": f"""with {_COMPARED}{_NAMED}
select rec_id, t1 as ratio_text, t3 as ratio_text_3 from alloys left join ratio_texts using (rec_id)""",
    "name_without_zero": f"with {_COMPARED}{_NAMED} select rec_id, name_without_zero from short_names",
    "check_compositions": _CHECK,
    "check_headers": f"select rec_id, consistency_check, name_without_zero, 'x' as Note from ({_CHECK}) c",
    "consistency_summary": f"""with {_COMPARED}
select count(*) filter (consistency_check = 'OK') as n_ok, count(*) filter (consistency_check like 'inconsistent%') as n_inconsistent,
  count(*) filter (consistency_check = 'unknown') as n_unknown from compared""",
    "parse_v1": f"with {_OUTCOMES} select doc_id, v1_status as status, branch, v1_json as json from outcomes",
    "json_candidates": _candidates(None),
    "json_candidates_two": _candidates(2),
    "json_candidates_pages": """select page_id, cast(unnest(range(1, len(cs) + 1)) as int) as candidate_no, unnest(cs) as candidate
from (select page_id, regexp_extract_all(html, '[{][^{}"'']*[}]') as cs from pages) t""",
    "light_fix": _LIGHT_FIX,
    "parse_v2": f"""with {_OUTCOMES}
select doc_id, case when candidate_no is null then 'raw' else 'ok' end as status, candidate_no, repaired,
  case when json like '[%' then 'array' when json like '{{%' then 'object' when json is not null then 'number' end as kind,
  cast(case when json like '[%' then json_array_length(json) when json like '{{%' then len(json_keys(json)) end as int) as size, json from outcomes""",
    "quarantine": f"""with {_OUTCOMES}
select cast(doc_id as varchar) as item, 'raw' as reason, response as raw from outcomes where candidate_no is null
union all
select file_name, case when value like '{{%' then 'not_a_list' else 'bad_json' end, value
from ({_RECORD_FILES}) f where value like '{{%' or value like '%,]'""",
    "flatten_records": f"""with {_RECORDS}
select paper as Paperid, cast(pos as int) as pos, name, nullif(nominal_composition, 'Not found') as nominal_composition,
  nullif(measured_composition, 'Not found') as measured_composition,
  case when rec_id % 4 <> 1 then cast('3.' || lattice_milli as double) end as lattice_constant,
  case when rec_id % 4 <> 1 then regexp_replace('3.' || lattice_milli, '0+$', '') end as lattice_text, 'BCC' as phases,
  cast(null as varchar) as alloy_condition, '10.1/' || paper_id as doi, conf as conf_name,
  cast(null as int) as conf_nominal_composition, cast(null as int) as conf_measured_composition, 100 - conf as conf_lattice_constant,
  cast(null as int) as conf_phases, cast(null as int) as conf_alloy_condition, cast(null as int) as conf_doi
from entries""",
    "confidence_profile": _PROFILE,
    "combine_records": f"""with {_RECORDS}
select paper as Paperid, cast(pos as int) as pos, name, coalesce(nominal_composition, 'Not found') as nominal_composition,
  coalesce(measured_composition, 'Not found') as measured_composition,
  case when rec_id % 4 <> 1 then cast('3.' || lattice_milli as double) end as lattice_constant,
  case when rec_id % 4 <> 1 then regexp_replace('3.' || lattice_milli, '0+$', '') else 'Not found' end as lattice_text, 'BCC' as phases,
  cast(null as varchar) as alloy_condition, '10.1/' || paper_id as doi, conf as conf_name,
  cast(null as int) as conf_nominal_composition, cast(null as int) as conf_measured_composition, 100 - conf as conf_lattice_constant,
  cast(null as int) as conf_phases, cast(null as int) as conf_alloy_condition, cast(null as int) as conf_doi
from entries where shape <> 3""",
    "combine_all_keys": f"""with {_RECORDS},
fields as (
  select paper, pos, unnest(['name', 'nominal_composition', 'measured_composition', 'lattice_constant', 'phases', 'doi', 'confidence_scores']) as key,
    unnest([name, coalesce(nominal_composition, 'Not found'), coalesce(measured_composition, 'Not found'),
      case when rec_id % 4 <> 1 then regexp_replace('3.' || lattice_milli, '0+$', '') else 'Not found' end, 'BCC', '10.1/' || paper_id,
      '{{"lattice_constant":' || (100 - conf) || ',"name":' || conf || '}}']) as value
  from entries where shape <> 3)
select paper as Paperid, cast(pos as int) as pos, key, value from fields""",
    "combine_with_keys": f"""with {_RECORDS}
select paper as Paperid, cast(pos as int) as pos, '10.1/' || paper_id as doi, name, 'BCC' as phases,
  coalesce(nominal_composition, 'Not found') as nominal_composition, coalesce(measured_composition, 'Not found') as measured_composition,
  case when rec_id % 4 <> 1 then regexp_replace('3.' || lattice_milli, '0+$', '') else 'Not found' end as lattice_constant,
  '{{"lattice_constant":' || (100 - conf) || ',"name":' || conf || '}}' as confidence_scores, cast(null as varchar) as is_single_phase
from entries where shape <> 3""",
    "record_keys": """select distinct unnest(['name', 'nominal_composition', 'measured_composition', 'lattice_constant', 'phases', 'doi', 'confidence_scores']) as key
from part""",
    "prompt_similarity": _SIMILARITY,
    "prompt_log": _LOG,
    "label_sets": _LABEL_SETS,
    "mini_batches": f"select * from ({_batches('documents')}) b",
    "batch_feedback": _FEEDBACK,
    "combine_wide": f"""with files as ({fx.duckdb_sql(fx.MIXED_FILES)}),
records as (
  select 'paper.' || rec_id as Paperid, cast(0 as int) as pos, json(value)->0 as r
  from files where rec_id % 6 <> 5
  union all select 'paper.' || rec_id, 1, json(value)->1 from files where rec_id % 6 <> 5
  union all select 'paper.' || rec_id, 2, json(value)->2 from files where rec_id % 6 = 4
)
select Paperid, pos, cast(r->>'whole' as bigint) as whole, cast(r->>'number' as double) as number, r->>'mixed' as mixed,
  cast(r->>'flag' as boolean) as flag, r->>'$."Name"' as "Name", r->>'$."name"' as name_2, r->>'pos' as pos_2,
  cast(r->'list' as varchar) as list, r->>'$."a b''c.d"' as "a b'c.d", r->>'$."only here"' as "only here"
from records""",
    "parse_strict": _STRICT,
    "check_strict": _CHECK_STRICT,
    "label_reconcile": _RECONCILE,
    "label_reconcile_tol": _CHAINS_AGREE,
    "reconcile_chains": f"with {_chains('7e-4')} select * from chains",
    "verdict_scores": _SCORES,
    "scan_docs": _SCAN,
    "classify_docs": f"select doc_id, {_KINDS} as kind, {_KINDS} = 'pdf' as is_pdf from documents",
    "pending_docs": "select doc_id, source from documents where doc_id not in (select doc_id from labels)",
    "pair_outputs": """select '/out/' || l.doc_id || '.v1.json' as path, quality,
  case when d.doc_id is not null then '/out/' || d.doc_id || '.v1.pdf' end as pdf_path
from labels l left join documents d on d.doc_id = l.doc_id and d.lang <> 'fr'""",
    "request_rows": _REQUESTS,
    "stream_ingest": f"""with {_OUTCOMES}
select doc_id, case when candidate_no is null then 'raw' else 'ok' end as status, candidate_no, repaired, json,
  case when candidate_no is null then response end as raw from outcomes""",
    "text_stats_edited": _EDITED_STATS,
    "text_failures": "select doc_id, 'no_text' as reason from documents where doc_id % 5 = 3 or text is null",
    "token_budget_no_images": f"with {_stats()} select *, {_NO_IMAGES} from stats",
    "token_budget_no_rate": f"""with {_stats()},
measured as (
  select doc_id, sum((width_in * 100) * (height_in * 100) / 1e6) as mp, count(*) as n from ({_GEOMETRY}) g group by doc_id)
select s.*, round(coalesce(mp, 500.0e0 * 700.0e0 / 1e6 * greatest(pages, 1)), 6) as image_mp,
  cast(coalesce(n, greatest(pages, 1)) as bigint) as pages_used, cast(null as bigint) as image_tokens,
  cast(null as bigint) as total_tokens_word_est, cast(null as bigint) as total_tokens_char_est, cast(null as bigint) as total_tokens_tiktoken
from stats s left join measured using (doc_id)""",
    "token_total_line": _TOTAL_LINE,
    "normalize_as_weight": _AS_WEIGHT,
    "sorted_pdfs": f"""with paths as ({_PATHS})
select path, row_number() over (order by path) - 1 as position from (select distinct path from paths where lower(path) like '%.pdf') t""",
    "scan_folders": """select 'flat' as scan, '%PDF-' || s_suppkey as found, cast(1 as bigint) as n, true as good from supplier
union all select 'recursive', cast(s_nationkey as varchar), count(*), true from supplier group by all""",
    "record_folder": f"""select 'not_a_list' as issue, cast(0 as int) as pos, name, 3 + lattice_milli / 1000e0 as lattice_constant, cast(paper_id as varchar) as doi
from ({_ALLOYS}) a qualify row_number() over (partition by paper_id order by rec_id) = 1""",
    "outcomes_written": f"""with {_OUTCOMES}
select doc_id, json, case when candidate_no is null then response end as raw, case when candidate_no is null then 'raw' else 'ok' end as kind
from outcomes, range(2)""",
    "csv_split": f"""select id, case when remark in ('', 'NA', 'None') then null else remark end as remark, cast(size as bigint) as size,
  cast(nullif(amount, 'nan') as double) as amount from ({fx.duckdb_sql(fx.TABLE_CELLS)}) t""",
    "verdicts_written": f"select doc_id, verdict_text, 2 * count(*) as n, cast(2 as bigint) as runs from ({_VERDICTS}) v group by all",
    "parse_v2_non_finite": _NON_FINITE,
}

ORACLES["sorted_records"] = f"select *, row_number() over (order by Paperid, pos) - 1 as position from ({ORACLES['combine_records']}) c"
ORACLES["csv_written"] = ORACLES["combine_records"]
ORACLES["prompt_log_files"] = f"""select * exclude (log_id) replace (cast(row_number() over (order by log_id, version) as int) as version)
from ({ORACLES['prompt_log']}) l"""
