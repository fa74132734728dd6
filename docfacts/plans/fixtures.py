"""Input tables of the registered queries, derived from the given tables.

Each is one SELECT that Spark and DuckDB read alike. ``{part}`` and the like stand for the
given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["part", "nation", "supplier", "documents", "pages", "labels", "conversations"]

# Alloys: a name and two compositions in varying spellings, several per paper.
ALLOYS = """
select rec_id, paper_id,
  case when rec_id % 11 = 0 then cast(null as varchar(64)) else e0 || e1 || e2 || e3 end as name,
  case rec_id % 8
    when 0 then e0 || '1.0' || e1 || '1.0' || e2 || '1.0' || e3 || '1.0'
    when 1 then e0 || '25' || e1 || '25' || e2 || '25' || e3 || '25'
    when 2 then e0 || ':' || e1 || ':' || e2 || '=1:1:2'
    when 3 then e0 || ' 20wt%, ' || e1 || ' 30wt%, ' || e2 || ' 50wt%'
    when 4 then e0 || ' ' || sz || 'at.% ' || e1 || ' ' || (100 - sz) || 'at.%'
    when 5 then 'Not found'
    when 6 then cast(null as varchar(64))
    else e0 || e1 || '0.5' || e2 || e3 || case when rec_id % 16 = 15 then 0 else sz end end as nominal_composition,
  case rec_id % 5
    when 0 then e0 || '24' || e1 || '26' || e2 || '25' || e3 || '25'
    when 1 then 'Not found'
    when 2 then cast(null as varchar(64))
    when 3 then e0 || sz || e1 || '1'
    else e0 || '1' || e1 || '1' || e2 || '1' || e3 || '1' end as measured_composition,
  300 + rec_id % 70 as lattice_milli, cast(rec_id % 101 as int) as conf
from (select p_partkey as rec_id, p_partkey % 97 as paper_id, cast(p_size as int) as sz,
    substr('AlCoCrFeNiNbTiMoZrTaHfMn', cast(1 + 2 * ((p_partkey * 7 + 0) % 12) as int), 2) as e0,
    substr('AlCoCrFeNiNbTiMoZrTaHfMn', cast(1 + 2 * ((p_partkey * 7 + 5) % 12) as int), 2) as e1,
    substr('AlCoCrFeNiNbTiMoZrTaHfMn', cast(1 + 2 * ((p_partkey * 7 + 10) % 12) as int), 2) as e2,
    substr('AlCoCrFeNiNbTiMoZrTaHfMn', cast(1 + 2 * ((p_partkey * 7 + 15) % 12) as int), 2) as e3
  from {part}) t
"""

# Spellings that take the less usual ways through the parsers.
ODD_SPELLINGS = """
select p_partkey as rec_id, case p_partkey % 16
    when 0 then 'Al ' || sz || ' wt% Nb 30 wt%'
    when 1 then 'Al=' || sz || ' wt%'
    when 2 then 'Al=' || sz || ', Nb=30'
    when 3 then 'Al = ' || sz || ' Nb = 30'
    when 4 then 'Al ' || sz || ' Nb'
    when 5 then 'Al' || sz || 'CoAl'
    when 6 then '(FeCo)' || sz
    when 7 then 'Al.Co-' || sz
    when 8 then 'Al：Nb：Ti＝1：' || sz || '：2'
    when 9 then 'Al:Al:Nb=1:' || sz || ':5'
    when 10 then 'Al1e-2Nb' || sz || '.5%W.5'
    when 11 then ' Al ' || sz || 'at. %; Nb – 3 | Ti 4WT% '
    when 12 then 'Xx ' || sz || 'wt%  Fe 10wt%'
    when 13 then 'Al -' || sz || 'at% Nb 1at%'
    when 14 then '   '
    else 'none of ' || p_type end as spelling
from (select p_partkey, p_type, cast(p_size as int) as sz from {part}) t
"""

# Spellings for the strict reading, with what comes out, traced by hand: text, amounts as JSON, unit, problems (¦ between them). @ is a number
# from the table.
STRICT_SHAPES = [
    ("Al @ at.% Nb 30 at.%", '{"Al": @.0, "Nb": 30.0}', "at", ""),
    ("Al=@ wt%", '{"Al": @.0}', "wt", ""),
    ("Not found", None, None, "Not¦found"),
    ("Al @ wt%, Nb 30 at%", None, None, "at%"),
    ("Al:Nb:Ti=1:@:2", '{"Al": 1.0, "Nb": @.0, "Ti": 2.0}', None, ""),
    ("Al:Nb=1:@:2", None, None, "Al:Nb=1:@:2"),
    ("AlCo@CrAl", '{"Al": 2.0, "Co": @.0, "Cr": 1.0}', None, ""),
    ("Al @ at% Nb", None, None, "Nb"),
    ("(FeCo)@", None, None, "(¦)"),
    ("Al -@at% Nb 1at%", None, None, "-@¦at%¦Al"),
    ("Xx @wt% Fe 10wt%", None, None, "Xx¦@¦wt%"),
    ("Al = @ mol %; Nb：30mol% | Ti – 1e1 MOL%", '{"Al": @.0, "Nb": 30.0, "Ti": 10.0}', "at", ""),
    ("@Al", None, None, "@"),
    ("Al= Nb@", None, None, "Al="),
    ("Al@% Nb.5%", '{"Al": @.0, "Nb": 0.5}', None, ""),
    ("Al-Co-Cr@", '{"Al": 1.0, "Co": 1.0, "Cr": @.0}', None, ""),
    ("Fe bal. Cr @ wt.%", None, None, "bal¦.¦Fe"),
    ("   ", None, None, None),
    (None, None, None, None),
]


def strict_rows() -> str:
    """``STRICT_SHAPES`` as a list of SQL values, numbered from 0; null where a column has none."""
    quoted = lambda v: "cast(null as varchar(200))" if v is None else f"'{v}'"
    return "values " + ", ".join(f"({i}, {', '.join(map(quoted, shape))})" for i, shape in enumerate(STRICT_SHAPES))


STRICT_SPELLINGS = f"""
select p_partkey as rec_id, replace(spelling, '@', cast(cast(p_size as int) as varchar(12))) as spelling
from {{part}} p join ({strict_rows().replace("{", "{{").replace("}", "}}")}) as shapes(shape, spelling, amounts, unit, problems) on p_partkey % {len(STRICT_SHAPES)} = shape
"""

# Model answers: every shape the two parsers treat differently, next to what comes out of them, traced by hand. In
# all texts ~ is a line end, ^ a backslash, § a single quote, @ a number from the table, ¦ stands between
# candidates. Columns: answer; first parser: status, branch, value; second parser: candidate (0: none), repaired, value; all candidates.
_O = '{"name": "Al@Co", "x": @}'
_V = '{"name":"Al@Co","x":@}'
SHAPES = [
    (f"Result:~```json~[{_O}]~```", "ok", "fence", f"[{_V}]", 1, False, f"[{_V}]", f"[{_O}]¦[{_O}]¦{_O}"),
    (f"```json~{_O}~```", "dropped_not_list", "fence", None, 1, False, _V, f"{_O}¦{_O}"),
    (f"```JSON~[{_O},]~``` done", "invalid", "list", None, 1, True, f"[{_V}]", f"[{_O},]¦[{_O},]¦[{_O},]¦{_O}"),
    (f"Plain list [{_O},{_O}] end", "ok", "list", f"[{_V},{_V}]", 1, False, f"[{_V},{_V}]", f"[{_O},{_O}]¦{_O}¦{_O}"),
    (f"Object {_O} end", "ok", "object", _V, 1, False, _V, _O),
    (f"bad [1,2,,] then [{_O}]", "invalid", "list", None, 2, False, f"[{_V}]", f"[1,2,,]¦[{_O}]¦{_O}"),
    ("No alloy was reported.", "raw", None, None, 0, None, None, None),
    ("x [a] y [b] z [@, 7] and [8]", "invalid", "list", None, 3, False, "[@,7]", "[a]¦[b]¦[@, 7]¦[8]"),
    ('see {"a": "x]} [", "b": [@]} ok', "invalid", "list", None, 1, False, '{"a":"x]} [","b":[@]}', '{"a": "x]} [", "b": [@]}'),
    ('v {"a": "q^"} @"} w', "invalid", "object", None, 1, False, '{"a":"q^"} @"}', '{"a": "q^"} @"}'),
    ("```json~oops~```~and~```json~[@]~```", "invalid", "fence", None, 2, False, "[@]", "oops¦[@]¦and¦[@]"),
    ("```python~{§k§: §v@§,}~```", "invalid", "object", None, 1, True, '{"k":"v@"}', "{§k§: §v@§,}¦{§k§: §v@§,}"),
    ("```json~@~```", "dropped_not_list", "fence", None, 1, False, "@", "@"),
    ('open [1 [2] {"z": @}', "invalid", "list", None, 1, False, '{"z":@}', '{"z": @}'),
    (None, "raw", None, None, 0, None, None, None),
    ("```json~[@] tail~```", "invalid", "fence", None, 2, False, "[@]", "[@] tail¦[@]"),
]


_FLAG = 5  # the column that is true or false


def _sql_value(value: str | int | bool | None, column: int) -> str:
    if value is None:
        return f"cast(null as {'boolean' if column == _FLAG else 'varchar(200)'})"
    return f"'{value}'" if isinstance(value, str) else str(value).lower()


def shape_rows(*columns: int) -> str:
    """The rows of ``SHAPES`` as a list of SQL values, numbered from 0, with some of its columns."""
    rows = (", ".join([str(i), *(_sql_value(shape[c], c) for c in columns)]) for i, shape in enumerate(SHAPES))
    return "values " + ", ".join(f"({row})" for row in rows)


def filled_in(text: str) -> str:
    """A text of ``SHAPES`` with its marks replaced."""
    for mark, value in (("~", "chr(10)"), ("^", "chr(92)"), ("§", "chr(39)"), ("@", "cast(cast(p_size as int) as varchar(12))")):
        text = f"replace({text}, '{mark}', {value})"
    return text


RESPONSES = f"""
select p_partkey as doc_id, {filled_in('template')} as response
from {{part}} p join ({shape_rows(0).replace("{", "{{").replace("}", "}}")}) as shapes(shape, template) on p_partkey % {len(SHAPES)} = shape
"""

# Record files: one JSON text each; lists of one or two full records, an object, a broken list.
RECORD_FILES = """
select rec_id, 'paper.' || rec_id || '.json' as file_name,
  case rec_id % 5
    when 0 then '[' || obj || ', ' || obj || ']'
    when 3 then obj
    when 4 then '[' || obj || ',]'
    else '[' || obj || ']' end as value
from (select rec_id, '{{"name": ' || coalesce('"' || name || '"', 'null')
    || ', "nominal_composition": ' || coalesce('"' || nominal_composition || '"', '"Not found"')
    || ', "measured_composition": ' || coalesce('"' || measured_composition || '"', '"Not found"')
    || ', "lattice_constant": ' || case when rec_id % 4 = 1 then '"Not found"' else '3.' || lattice_milli end
    || ', "phases": "BCC", "doi": "10.1/' || paper_id || '"'
    || ', "confidence_scores": {{"name": ' || conf || ', "lattice_constant": ' || (100 - conf) || '}}}}' as obj
  from ({alloys}) a) t
"""

# Record files whose records have different keys, and keys whose values have different types.
MIXED_FILES = """
select rec_id, 'paper.' || rec_id || '.json' as file_name,
  case rec_id % 6 when 5 then obj when 4 then '[' || obj || ', 7, {{"only here": null}}]' else '[' || obj || ', {{}}]' end as value
from (select rec_id, '{{"whole": ' || rec_id || ', "number": ' || case when rec_id % 2 = 0 then '' || conf else conf || '.25' end
    || ', "mixed": ' || case rec_id % 3 when 0 then '' || conf when 1 then '"text"' else 'true' end
    || case when rec_id % 4 = 0 then ', "flag": ' || case when rec_id % 8 = 0 then 'true' else 'null' end else '' end
    || case when rec_id % 7 = 0 then ', "Name": "upper", "name": "lower", "pos": "p"' else ', "name": "' || paper_id || '"' end
    || ', "list": [' || conf || ', {{"a": null}}], "a b''c.d": "odd"}}' as obj
  from ({alloys}) a) t
"""

# Cells of a table file: line ends, quotes, commas, and words for a missing value.
TABLE_CELLS = """
select p_partkey as id, case p_partkey % 9 when 0 then 'NA' when 1 then 'two' || chr(10) || 'lines, ' || p_type when 2 then 'say "' || chr(10) || chr(10) || '" or ""'
    when 3 then 'a,b' when 4 then '' when 5 then cast(null as varchar(9)) when 6 then '"' || p_type || '"' when 7 then 'None' else 'plain ' || p_type end as remark,
  cast(p_size as int) as size, case when p_partkey % 4 = 0 then 'nan' else p_partkey || '.5' end as amount
from {part}
"""

# Answers with number words that JSON lacks, with what the second parser makes of them, traced by hand: answer, value, lattice constant of the
# first record. In all texts @ is a number from the table.
NON_FINITE_SHAPES = [
    ('[{"lattice_constant": NaN, "n": @}]', '[{"lattice_constant":{"$numberDouble":"NaN"},"n":@}]', "NaN"),
    ('[{"lattice_constant": -Infinity, "name": "NaN, Infinity"}]', '[{"lattice_constant":{"$numberDouble":"-Infinity"},"name":"NaN, Infinity"}]', "-Infinity"),
    ('x [Infinity,NaN,-Infinity,@] y', '[{"$numberDouble":"Infinity"},{"$numberDouble":"NaN"},{"$numberDouble":"-Infinity"},@]', None),
    ('[{"lattice_constant": 3.@5, "a": "q^" NaN"}]', '[{"a":"q^" NaN","lattice_constant":3.@5}]', "3.@5"),
    ("[-NaN]", None, None),
    ("[NaNs, InfinityX]", None, None),
    ('[{"lattice_constant": "NaN"}]', '[{"lattice_constant":"NaN"}]', "NaN"),
    ("{§lattice_constant§: NaN,}", '{"lattice_constant":{"$numberDouble":"NaN"}}', None),
    ("[+Infinity]", None, None),
    (None, None, None),
]


def non_finite_rows() -> str:
    quoted = lambda v: "cast(null as varchar(200))" if v is None else f"'{v}'"
    return "values " + ", ".join(f"({i}, {', '.join(map(quoted, shape))})" for i, shape in enumerate(NON_FINITE_SHAPES))


NON_FINITE = f"""
select p_partkey as doc_id, {filled_in('template')} as response
from {{part}} p join ({non_finite_rows().replace("{", "{{").replace("}", "}}")}) as shapes(shape, template, v2_json, lattice) on p_partkey % {len(NON_FINITE_SHAPES)} = shape
"""

# Page sizes; documents of one source have none, so the default size is used for them.
PAGE_GEOMETRY = """
select doc_id, page_no,
  case doc_id % 3 when 0 then 8.5e0 when 1 then 8.27e0 else 11.0e0 end as width_in,
  case doc_id % 3 when 0 then 11.0e0 when 1 then 11.69e0 else 8.5e0 end as height_in
from (select doc_id, {pages_of_document} as page_no from {documents} where source <> 'src1') t
"""
SPARK_PAGES = "explode(sequence(1, 1 + cast(n_chars as int) div 3000))"
DUCKDB_PAGES = "unnest(range(1, 2 + n_chars // 3000))"

PROMPT_HISTORY = "select conv_id as run_id, turn as version, text as prompt from {conversations}"

# A run log of two steps per conversation turn.
PROMPT_LOGS = """
select conv_id || '-' || turn as log_id,
  'Training step ' || turn || '. Epoch 0: : 1it [0' || (turn % 10) || ':25, ' || (10 + turn) || '.58s/it]' || chr(10)
  || chr(10) || text || chr(10) || 'TF-IDF Cosine Similarity: 0.' || (1000 + turn) || chr(10) || chr(10)
  || 'Training step ' || (turn + 1) || '. Epoch 1: : 2it [1:0' || (turn % 10) || ':30, 97.69s/it]' || chr(10)
  || chr(10) || role || ': [x, y]' || chr(10) || 'TF-IDF Cosine Similarity: 0.7723' || chr(10) as value
from {conversations}
"""

# Judge verdicts: nine lines or twelve, numbered or not, some unclear; some documents have two.
VERDICTS = """
select doc_id, case when quality = 1 then 'Yes' else 'No' end || chr(10)
  || case when toxic = 1 then 'no' else 'yes' end || chr(10)
  || case doc_id % 3 when 0 then '3. YES.' else 'No' end || chr(10) || chr(10)
  || case doc_id % 5 when 0 then '4. not stated' else '4. Yes' end || chr(10)
  || '5. ' || case when quality = 1 then 'yes, it is' else 'No; notes differ' end || chr(10)
  || case doc_id % 2 when 0 then 'Yes' else 'No' end || chr(10)
  || case doc_id % 4 when 0 then 'No' else 'yes' end || chr(10)
  || 'YES' || chr(10)
  || case doc_id % 6 when 0 then 'Yes, one' else '9. No' end
  || case doc_id % 7 when 0 then chr(10) || 'no' || chr(10) || '11. yes' || chr(10) || 'maybe' else '' end as verdict_text
from {labels}
union all select doc_id, 'No' || chr(10) || 'second opinion: yes' from {labels} where doc_id % 4 = 0
"""

# Documents with words split over line ends, runs of blanks, and failed extractions (null).
EDITED_TEXTS = """
select doc_id, n_chars, case doc_id % 5
    when 0 then replace(text, 'e ', 'e-' || chr(10))
    when 1 then '  ' || replace(text, ' ', '  ')
    when 2 then replace(text, '. ', '.' || chr(9) || chr(13) || chr(10))
    when 3 then cast(null as varchar(9))
    else text end as text
from {documents}
"""

# Human labels: the alloys under label-file headers, with names for the unnamed and some
# lattice constants off by 0.001 or missing.
LABEL_FILE = """
select rec_id, paper_id as Paperid, coalesce(name, 'HEA' || rec_id) as HEAname,
  nominal_composition as nominal_compositions, measured_composition as measured_compositions,
  case rec_id % 9 when 8 then cast('NaN' as double)
    else (3000 + lattice_milli + case when rec_id % 4 = 0 then 1 else 0 end) / 1000e0 end as RT_Lattice_Constant_A,
  'BCC' as Phase, 'As-Cast' as Processing_Method, '10.1/' || paper_id as Ref
from ({alloys}) a
"""

# Predicted and labelled lattice constants a few tolerances apart: chains of neighbours, copies, names and constants that are missing.
NEAR_CONSTANTS = """
select paper_id, name, side, case when k % 13 = 0 then cast(null as double) else steps / 10000e0 end as lattice_constant
from (select p_partkey % 97 as paper_id, case when p_partkey % 7 = 0 then cast(null as varchar(9)) else 'HEA' || (p_partkey % 2) end as name,
    'predicted' as side, p_partkey as k, 30000 + (p_partkey * 7) % 41 * 2 as steps from {part}
  union all
  select p_partkey % 97, case when p_partkey % 7 = 0 then cast(null as varchar(9)) else 'HEA' || (p_partkey % 2) end,
    'labelled', p_partkey + 1, 30000 + (p_partkey * 11) % 41 * 2 + case when p_partkey % 3 = 0 then 1 else 0 end from {part}
  union all
  select 1000 + p_partkey, 'edge', 'predicted', 1, 30004 from {part}
  union all
  select 1000 + p_partkey, 'edge', 'labelled', 1, case p_partkey % 3 when 0 then 30006 when 1 then 30009 else 30010 end from {part}
) t
"""

# Text of each document under three extraction backends; null where a backend failed.
BACKEND_TEXTS = """
select doc_id,
  case when lang = 'en' then text end as text_pypdf, 1 as pages_pypdf,
  case when doc_id % 2 = 0 then text end as text_pdfminer, 2 as pages_pdfminer,
  case when source <> 'src1' then text end as text_pdftotext, 3 as pages_pdftotext
from {documents}
"""

# Paths of files: PDFs flat and nested, suffix in both cases, with repeats, and others.
PATHS = """
select case page_id % 5
    when 0 then '/in/d' || page_id || '.v2.pdf'
    when 1 then '/in/sub/d' || page_id || '.PDF'
    when 2 then '/in/d' || (page_id - 2) || '.v2.pdf'
    when 3 then '/in/d' || page_id || '.pdf.txt'
    else '/in/d' || page_id || '.Pdf' end as path
from {pages}
union all
select '/web/' || regexp_replace(url, '^https?://', '') || '.pdf' as path from {pages}
"""


def _fill(sql: str, tables: dict[str, str], pages_of_document: str) -> str:
    names = dict(tables)
    names["pages_of_document"] = pages_of_document
    names["alloys"] = ALLOYS.format(**tables)
    return sql.format(**names)


def duckdb_sql(sql: str) -> str:
    """The derivation over DuckDB's registered views."""
    return _fill(sql, {t: t for t in TABLES}, DUCKDB_PAGES).strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The derivation as a Spark DataFrame over the parquet files of ``sf_dir``."""
    markers = {t: f"{{{t}}}" for t in TABLES}
    text = _fill(sql, markers, SPARK_PAGES)
    used = {t: table(spark, sf_dir, t) for t in TABLES if markers[t] in text}
    # What is left in braces are table names, other braces belong to JSON texts.
    for t in used:
        text = text.replace(markers[t], f"\0{t}\0")
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = text.replace(f"\0{t}\0", markers[t])
    return spark.sql(text, **used)
