"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from docfacts.llm.quality import PHRASES

_ESCAPED = r"replace(replace(replace({0}, '\', '\e'), '<', '\l'), '>', '\g')"

_COMPONENTS = """
reach(doc, top) AS (
  SELECT a, a FROM links UNION SELECT reach.doc, links.b FROM reach JOIN links ON links.a = reach.top
),
tops AS (SELECT doc, least(doc, min(top)) AS top FROM reach GROUP BY doc)"""

#: Levels of eight that the SQL of the manifest goes up, in the trees and over them: enough for two million leaves a tree.
_LEVELS = 7
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LOWERED = "CASE WHEN changed THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"


def _crc32(data: str) -> str:
    """CRC-32 of a text in UTF-8: a fold over its bytes, eight shifts for each."""
    table = "([" + ", ".join(str(_crc_entry(i)) for i in range(256)) + "]::BIGINT[])"
    pairs = f"regexp_extract_all(hex(encode({data})), '..')"
    numbers = f"list_transform({pairs}, lambda p: 16 * (strpos('0123456789ABCDEF', p[1]) - 1) + strpos('0123456789ABCDEF', p[2]) - 1)"
    start = "list_prepend(4294967295::BIGINT, list_transform({0}, lambda b: b::BIGINT))".format(numbers)
    return f"xor(list_reduce({start}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def _crc_entry(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def _tree(leaves: str, name: str) -> str:
    """The levels of trees over the rows ``tree, pos, d, n`` of a relation, and the runs of each level."""
    out = [f"{name}0 AS (SELECT tree, pos, d, n FROM {leaves})"]
    for k in range(_LEVELS):
        out.append(f"{name}runs{k} AS (SELECT tree, pos // 8 AS pos, list(d ORDER BY pos) AS run, n FROM {name}{k} GROUP BY tree, pos // 8, n)")
        joined = "CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END"
        out.append(f"{name}{k + 1} AS (SELECT tree, pos, {joined} AS d, (n + 7) // 8 AS n FROM {name}runs{k})")
    return ",\n".join(out)


def _climbed(rows: str, name: str, tree: str, pos: str) -> list[str]:
    """Steps that carry ``proof`` and ``node`` of the rows of a relation up the levels of ``name``, one after another."""
    out = []
    for k in range(_LEVELS):
        at = f"((x.{pos} // {8**k}) % 8)"
        left, right = f"array_to_string(run[1 : {at}], '')", f"array_to_string(run[{at} + 2 :], '')"
        out.append(
            f"SELECT x.* REPLACE (CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, "
            f"CASE WHEN r.n > 1 THEN sha256({left} || node || {right}) ELSE node END AS node) "
            f"FROM {rows} x JOIN {name}runs{k} r ON r.tree = x.{tree} AND r.pos = x.{pos} // {8 ** (k + 1)}"
        )
        rows = f"{name}climb{k}"
        out[-1] = f"{rows} AS ({out[-1]})"
    return out


ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded
),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),{_COMPONENTS}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(top, doc_id) AS component_id FROM sets LEFT JOIN tops ON tops.doc = doc_id
""",
    "op3_suffix_array_dedup": """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS k FROM bytes WHERE n >= 50) t),
again AS (SELECT doc_id, k FROM windows QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
marked AS (SELECT *, coalesce(k > lag(k) OVER w + 50, true) AS fresh FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM marked),
runs AS (SELECT doc_id, min(k) AS low, max(k) + 50 AS high FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM runs),
lost AS (
  SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans,
    string_agg(substr(any_h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) || substr(any_value(any_h), 2 * max(high) + 1) AS kept
  FROM (SELECT g.*, h AS any_h FROM gaps g JOIN bytes USING (doc_id)) t GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM bytes LEFT JOIN lost USING (doc_id)
""",
    "op8_embedding_near_dedup": f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
sized AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM vectors),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sized x JOIN sized y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE x.size > 0 AND y.size > 0 AND list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.95
),{_COMPONENTS},
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(top, vec_id) AS component_id, coalesce(top, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counted ON counted.a = vec_id LEFT JOIN tops ON tops.doc = vec_id
""",
    "op2_quality_rules": r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
windows AS (
  SELECT doc_id, unnest(range(len(words) - 7)) AS pos, words FROM split WHERE len(words) >= 8
),
keyed AS (SELECT doc_id, pos, array_to_string(words[pos + 1 : pos + 8], ' ') AS w FROM windows),
again AS (SELECT doc_id, pos FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
steps AS (SELECT doc_id, least(8, pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -8)) AS n FROM again),
repeated AS (SELECT doc_id, sum(n) AS n FROM steps GROUP BY doc_id),
numbered AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
judged AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS seen,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_words,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS n_symbols,
    len(regexp_extract_all(line, '[|»·›>]')) AS n_separators,
    len(regexp_extract_all(line, '!')) AS n_marks
  FROM numbered
),
lost AS (
  SELECT doc_id, count(*) FILTER (seen) AS n_dup_lines, sum(length(line)) AS line_chars,
    coalesce(sum(length(line)) FILTER (NOT (seen OR NOT regexp_matches(line, '\p{L}') OR 10 * n_symbols > length(line) OR 2 * n_marks > n_words
      OR (n_separators >= 2 AND 3 * n_separators >= n_words)
      OR regexp_matches(lower(line), '({PHRASES})'))), 0) AS kept_chars
  FROM judged GROUP BY doc_id
),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(kept_chars, 0)::BIGINT AS kept_chars
  FROM split LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (line_chars - kept_chars) <= 30 * line_chars AS kept
FROM counted
""".replace("{PHRASES}", "|".join(PHRASES)),
    "op4_chat_formatting": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn >') + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
""",
    "op5_warc": """
WITH bytes AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
hashed AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM bytes),
largest AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM hashed),
letters AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (CASE k % 4
      WHEN 0 THEN strpos('0123456789abcdef', substr(hex, (k * 5 // 4)::INT + 1, 1)) * 2 - 2 + (strpos('0123456789abcdef', substr(hex, (k * 5 // 4)::INT + 2, 1)) - 1) // 8
      WHEN 1 THEN (strpos('0123456789abcdef', substr(hex, (k * 5 // 4)::INT + 1, 1)) - 1) % 8 * 4 + (strpos('0123456789abcdef', substr(hex, (k * 5 // 4)::INT + 2, 1)) - 1) // 4
      WHEN 2 THEN (strpos('0123456789abcdef', substr(hex, (k * 5 // 4)::INT + 1, 1)) - 1) % 4 * 8 + (strpos('0123456789abcdef', substr(hex, (k * 5 // 4)::INT + 2, 1)) - 1) // 2
      ELSE (strpos('0123456789abcdef', substr(hex, (k * 5 // 4)::INT + 1, 1)) - 1) % 2 * 16 + strpos('0123456789abcdef', substr(hex, (k * 5 // 4)::INT + 2, 1)) - 1
    END)::INT + 1, 1), '' ORDER BY k) AS payload_digest
  FROM hashed, range(32) AS t(k) GROUP BY page_id
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM largest JOIN letters USING (page_id)
""",
    "op11_merkle_manifest": f"""
WITH seen AS (
  SELECT *, coalesce({_crc32("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 AND doc_id IS NOT NULL, false) AS changed FROM documents
),
hashed AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree,
    sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
    sha256({" || ".join(_FIELD.format(c if c != "text" else f"({_LOWERED})") for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS node
  FROM seen
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS d, count(*) OVER (PARTITION BY tree) AS n
  FROM hashed
),
{_tree("leaves", "low")},
groups AS (SELECT 'all' AS tree, tree AS lang, row_number() OVER (ORDER BY tree) - 1 AS pos, d, count(*) OVER () AS n FROM low{_LEVELS}),
{_tree("groups", "top")},
started AS (SELECT doc_id, leaf, tree, pos, '' AS proof, node FROM leaves),
{", ".join(_climbed("started", "low", "tree", "pos"))},
between_trees AS (
  SELECT c.doc_id, c.leaf, c.proof, c.node, g.tree AS gtree, g.pos AS gpos, g.d AS subroot FROM lowclimb{_LEVELS - 1} c JOIN groups g ON g.lang = c.tree
),
{", ".join(_climbed("between_trees", "top", "gtree", "gpos"))}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM topclimb{_LEVELS - 1}, (SELECT d AS root FROM top{_LEVELS}) t
""",
    "op12_fill_in_middle": """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
),
cuts AS (
  SELECT doc_id, text, n,
    ('0x' || h[1:8])::BIGINT % (n + 1) AS one, ('0x' || h[9:16])::BIGINT % (n + 1) AS two,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 AS plain,
    ('0x' || h[25:32])::BIGINT % 100 < 20 AS suffix_first
  FROM drawn
),
parts AS (
  SELECT *, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
    substr(text, 1, least(one, two)) AS prefix, substr(text, least(one, two) + 1, abs(one - two)) AS middle, substr(text, greatest(one, two) + 1) AS suffix
  FROM cuts
)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN least(one, two) END AS prefix_chars, CASE WHEN NOT plain THEN abs(one - two) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
""",
    "op13_sharding": f"""
WITH sized AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(text, '')) AS k FROM documents
),
totals AS (
  SELECT sum(size)::BIGINT AS total, count(*) AS rows, greatest(8 * 128, least(65536, greatest(64, (count(*) + 999) // 1000))) AS share FROM sized
),
placed AS (
  SELECT *, (sum(size) OVER w)::BIGINT - size AS begin, row_number() OVER w - 1 AS place, (sum(size) OVER g)::BIGINT AS group_bytes, count(*) OVER g AS group_rows
  FROM sized WINDOW w AS (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY k)
),
dealt AS (
  SELECT *, least(7, 8 * CASE WHEN group_bytes * share > total OR group_rows * share > rows THEN 2 * begin + size
    ELSE 2 * min(begin) OVER (PARTITION BY k) + group_bytes END // (2 * total)) AS shard
  FROM placed, totals
)
SELECT doc_id, size, {_crc32("text")} AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard, place - min(place) OVER (PARTITION BY shard) AS slot,
  NULL::INTEGER AS grown_shard
FROM dealt
""",
}
