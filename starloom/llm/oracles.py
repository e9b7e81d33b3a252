"""DuckDB SQL for the corpus queries, where SQL can express them; written plainly, for tables small enough for that."""

from __future__ import annotations

import math

from starloom.llm import embedding_dedup, licenses, line_dedup, mixing, near_dedup, quality, url_filter
from starloom.llm.common import LOWER, UPPER

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _rules(rows: tuple[tuple[str, str], ...]) -> str:
    values = ", ".join(f"('{v}', '{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in rows)
    return f"rules(v, r, h, p) AS (VALUES {values})"


URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

_NEAR = f"""w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
 s AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE ['(none)'] END) AS g FROM w) GROUP BY doc_id, g),
 n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
 links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
 GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING sum(least(a.c, b.c)) / (na.n + nb.n - sum(least(a.c, b.c))) >= {near_dedup.SIMILARITY}),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
 classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)"""

_LICENSE_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PHRASES = "phrases(label, p) AS (VALUES " + ", ".join(f"('{label}', {_LIST(p.split())})" for label, p in licenses.PHRASES) + ")"
_TEMPLATES = "templates(label, t, size, run) AS (VALUES " + ", ".join(f"('{label}', {_LIST(dict.fromkeys(t.split()))}, {licenses.block_of(t)}, {licenses.run_of(t)})" for label, t in licenses.TEMPLATES) + ")"


def _one_of(words: str) -> list[str]:
    """Words of which each block that holds enough of the template holds one at least: one more than it may miss, the longest."""
    distinct = sorted(set(words.split()), key=lambda w: (-len(w), w))
    return distinct[: len(distinct) - math.ceil(licenses.CONTAINMENT * len(distinct) - 1e-9) + 1]


_NEEDED = sorted({w for _, words in licenses.TEMPLATES for w in _one_of(words)})

#: CRC-32 of an ASCII string: the table of bytes from its rule, then byte by byte.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


# An edit's way so far is its cost in eight digits, then its audit: the least of such strings is the cheapest, then the least audit.


def _step(way: str, cost: int | str, letter: str) -> str:
    return f"lpad(CAST(CAST(substr({way}, 1, 8) AS INT) + {cost} AS VARCHAR), 8, '0') || substr({way}, 9) || '{letter}'"


def _after(gate: str, way: str) -> str:
    return f"CASE WHEN {gate} THEN {way} END"


_MORE = "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END"
_REROLE = f"2 + {_MORE}"
_STAYS = "fault NOT IN ('blank', 'duplicate')"
_REPAIR = f"""{_CRC_TABLE}, d AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc),
        m AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE k <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role || ':' || text, role, copy) AS i FROM m),
        f AS (SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
        st AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        way AS (SELECT conv_id, 0::BIGINT AS i, '00000000' AS e0, NULL::VARCHAR AS e1, NULL::VARCHAR AS e2, NULL::VARCHAR AS e3 FROM st
        UNION ALL SELECT conv_id, i, {_step("e0", 3, "D")}, least({_step("e1", 3, "D")}, {_after(f"{_STAYS} AND c = 's'", _step("e0", _MORE, "K"))}),
        least({_step("e2", 3, "D")}, {", ".join(x for e in ("e0", "e1", "e3") for x in (_after(f"{_STAYS} AND c = 'u'", _step(e, _MORE, "K")), _after(_STAYS, _step(e, _REROLE, "R"))))}),
        least({_step("e3", 3, "D")}, {_after(f"{_STAYS} AND c = 'a'", _step("e2", _MORE, "K"))}, {_after(_STAYS, _step("e2", _REROLE, "R"))})
        FROM (SELECT conv_id, i, c, fault, e0, e1, e2, least(e3, {_step("e2", 2, "I")}) AS e3 FROM (SELECT w.conv_id, f.i, f.c, f.fault, e0, e1, least(e2, {_step("e0", 2, "I")}, {_step("e1", 2, "I")}, {_step("e3", 2, "I")}) AS e2, e3 FROM way w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
        best AS (SELECT conv_id, CAST(substr(e, 1, 8) AS BIGINT) AS cost, substr(e, 9) AS audit FROM (SELECT conv_id, least(e0, e3, {_step("e2", 2, "I")}, {_step("l2", 2, "I")}) AS e FROM (SELECT way.*, least({_step("e0", 2, "I")}, {_step("e1", 2, "I")}) AS l2 FROM way JOIN st ON st.conv_id IS NOT DISTINCT FROM way.conv_id AND way.i = st.n))),
        l AS (SELECT *, substr(audit, p, 1) AS a FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)),
        q AS (SELECT *, count(*) FILTER (WHERE a <> 'I') OVER w AS i, count(*) FILTER (WHERE a <> 'D') OVER w AS k FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
        z AS (SELECT q.conv_id, k, a, role, text, max(CASE WHEN k = 1 AND a = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS has_s FROM q LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i AND a IN ('K', 'R') WHERE a <> 'D'),
        t AS (SELECT conv_id, sha256(string_agg(CASE WHEN a = 'K' THEN role WHEN (k - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN a = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS h FROM z GROUP BY conv_id)
        SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM g.conv_id"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Levels come one after the other: node lists of each run, then what a row's digest is folded with.
_MERKLE = f"""{_CRC_TABLE}, a AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_crc("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf("text")} END AS tried FROM documents, crc),
        b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, tried) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM a),
        lower_ AS (SELECT source, i, n, 0 AS level, leaf AS node FROM b UNION ALL SELECT source, i // 16, (n + 15) // 16, level + 1, sha256(string_agg(node, '' ORDER BY i)) FROM lower_ WHERE n > 1 GROUP BY source, i // 16, n, level),
        subs AS (SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lower_ WHERE n = 1),
        upper_ AS (SELECT i, n, 0 AS level, node FROM subs UNION ALL SELECT i // 16, (n + 15) // 16, level + 1, sha256(string_agg(node, '' ORDER BY i)) FROM upper_ WHERE n > 1 GROUP BY i // 16, n, level),
        runs AS (SELECT source, level, i // 16 AS run, list(node ORDER BY i) AS nodes FROM lower_ WHERE n > 1 GROUP BY source, level, i // 16), top_runs AS (SELECT level, i // 16 AS run, list(node ORDER BY i) AS nodes FROM upper_ WHERE n > 1 GROUP BY level, i // 16),
        up AS (SELECT b.source, b.i AS w, b.i, 0 AS level, tried AS folded, '' AS proof FROM b UNION ALL
        SELECT up.source, w, i // 16, up.level + 1, sha256(array_to_string(list_slice(nodes, 1, i % 16) || [folded] || list_slice(nodes, i % 16 + 2, 16), '')), proof || array_to_string(list_slice(nodes, 1, i % 16) || list_slice(nodes, i % 16 + 2, 16), '') FROM up JOIN runs ON runs.source IS NOT DISTINCT FROM up.source AND runs.level = up.level AND run = i // 16),
        mid AS (SELECT source, w, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM up GROUP BY source, w),
        high AS (SELECT mid.source, w, s.i, 0 AS level, folded, proof FROM mid JOIN subs s ON s.source IS NOT DISTINCT FROM mid.source UNION ALL
        SELECT high.source, w, i // 16, high.level + 1, sha256(array_to_string(list_slice(nodes, 1, i % 16) || [folded] || list_slice(nodes, i % 16 + 2, 16), '')), proof || array_to_string(list_slice(nodes, 1, i % 16) || list_slice(nodes, i % 16 + 2, 16), '') FROM high JOIN top_runs ON top_runs.level = high.level AND run = i // 16),
        ends AS (SELECT source, w, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM high GROUP BY source, w), root AS (SELECT node AS root FROM upper_ WHERE n = 1)
        SELECT doc_id, leaf, s.node AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM b JOIN ends e ON e.source IS NOT DISTINCT FROM b.source AND e.w = b.i JOIN subs s ON s.source IS NOT DISTINCT FROM b.source, root"""

_EMBEDDINGS = f"""v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        ok AS (SELECT r, e, coalesce(len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0, FALSE) AS good FROM v),
        links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND CASE WHEN a.good AND b.good AND len(a.e) = len(b.e) THEN list_cosine_similarity(list_transform(a.e, lambda x: coalesce(x, 0)), list_transform(b.e, lambda x: coalesce(x, 0))) >= {embedding_dedup.COSINE}::DOUBLE ELSE FALSE END), reach AS (SELECT r AS a, r AS b FROM v UNION SELECT x.a, l.b FROM reach x JOIN links l ON x.b = l.a),
        c AS (SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a), n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)"""

ORACLES: dict[str, str] = {
    "op11_min_plus_repair": f"WITH RECURSIVE {_REPAIR}",
    "op12_merkle_manifest": f"WITH RECURSIVE {_MERKLE}",
    "op13_e8_lattice": f"WITH RECURSIVE {_EMBEDDINGS}",
    "op1_dart_minhash": f"WITH RECURSIVE {_NEAR} SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS n_docs, doc_id = class_id AS keep FROM classes",
    "op3_weighted_url_vocabulary": f"""WITH {_rules(URL_RULES)}, u AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u), hp AS (SELECT *, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        best AS (SELECT page_id, arg_max(r, length(r)) AS rule, arg_max(v, length(r)) AS verdict FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
        t AS (SELECT page_id, list_sort(list_filter({_LIST(url_filter.STRICT)}, lambda x: regexp_matches(low, '(^|[^a-z0-9])' || x || '($|[^a-z0-9])'))) AS strict, list_sort(list_filter({_LIST(url_filter.SOFT)}, lambda x: regexp_matches(low, '(^|[^a-z0-9])' || x || '($|[^a-z0-9])'))) AS soft FROM hp)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN len(strict) > 0 OR len(soft) >= {url_filter.SOFT_NEEDED} THEN 'block' ELSE 'allow' END) AS verdict, array_to_string(strict, ',') AS strict_terms, array_to_string(soft, ',') AS soft_terms
        FROM hp LEFT JOIN best USING (page_id) JOIN t USING (page_id)""",
    "op4_fm_index_repeats": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
        rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1), cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM rep),
        gone AS (SELECT doc_id, list(j) AS js FROM cov GROUP BY doc_id), words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t FROM words LEFT JOIN cov USING (doc_id, j) WHERE cov.doc_id IS NULL GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op5_hash_threshold_mix": f"""WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source), r AS (SELECT *, {list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS w, source_size * {float(mixing.CAP)}::DOUBLE AS cap FROM s),
        l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM r WINDOW b AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        lv AS (SELECT arg_min(level, (cap / w, source)) AS level FROM l WHERE level * w <= cap),
        t AS (SELECT source, source_size, CASE WHEN level * w < cap THEN level * w ELSE cap END AS target FROM (SELECT source, source_size, w, cap FROM r), lv),
        p AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t), q AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS budget FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
        g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h), c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
        e AS (SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN source_size > 0 AND (upto <= budget OR (upto - words <= budget AND (budget - (upto - words)) * 2 >= words AND words > 0)) THEN 1 ELSE 0 END) AS taken FROM q JOIN c ON q.source IS NOT DISTINCT FROM c.source AND q.h = c.h)
        SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM e""",
    "op6_line_runs": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l), o AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
        x AS (SELECT k.*, o.key IS NOT NULL AND doc_id <> last_id AS gone FROM k LEFT JOIN o ON o.key = k.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM x GROUP BY doc_id""",
    "op7_host_quality": f"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, list_slice(ws, i, i + 2) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)), rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
        r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
        ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
        m AS (SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM w LEFT JOIN r USING (doc_id) LEFT JOIN ln USING (doc_id)), j AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS sy, n_dup_lines / greatest(n_lines, 1) AS dl, n_repeat_words / greatest(n_words, 1) AS rp, word_chars / greatest(n_words, 1) AS wl FROM m),
        k AS (SELECT *, base_failed OR sy > {quality.MAX_SYMBOLS_PER_WORD}::DOUBLE OR dl > {quality.MAX_DUP_LINES}::DOUBLE OR rp > {quality.MAX_REPEAT_SHARE}::DOUBLE OR wl NOT BETWEEN {quality.WORD_LENGTH[0]} AND {quality.WORD_LENGTH[1]} AS bad, sy > {quality.SEVERE_SYMBOLS_PER_WORD}::DOUBLE OR dl > {quality.SEVERE_DUP_LINES}::DOUBLE AS severe FROM j),
        h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE bad) AS b FROM k GROUP BY source), a AS (SELECT sum(b) / sum(n) AS mean, sum(n) AS docs, count(*) AS hosts FROM h), q AS (SELECT mean, mean * (1 - mean) AS noise, (sum(n * pow(b / n - mean, 2)) - mean * (1 - mean) * any_value(hosts)) / any_value(docs) AS between_ FROM h, a GROUP BY mean),
        st AS (SELECT mean, between_, greatest(1.0::DOUBLE, noise / between_ - 1) AS s FROM q),
        y AS (SELECT source, (rate - {quality.LIFT}::DOUBLE * mean) / sqrt(rate * (1 - rate) / (n + s + 1)) AS z FROM (SELECT source, n, mean, s, (b + s * mean) / (n + s) AS rate FROM h, st WHERE between_ > 0) WHERE rate * (1 - rate) > 0),
        er AS (SELECT source, 1 / (1 + exp(z * {quality.TAIL[0]}::DOUBLE + z * z * z * {quality.TAIL[1]}::DOUBLE)) AS error FROM y), sp AS (SELECT floor(error * {quality.STEPS}) AS step, sum(error) AS e, count(*) AS c FROM er GROUP BY 1),
        cu AS (SELECT max(step) AS upto FROM (SELECT step, sum(e) OVER (ORDER BY step) AS e, sum(c) OVER (ORDER BY step) AS c FROM sp) WHERE e <= {quality.FALSE_SHARE}::DOUBLE * c),
        z AS (SELECT h.source, coalesce(floor(error * {quality.STEPS}) <= (SELECT upto FROM cu), FALSE) AS bad_host FROM h LEFT JOIN er ON er.source IS NOT DISTINCT FROM h.source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT severe AND NOT (bad AND bad_host) AS kept, bad_host FROM k JOIN z ON k.source IS NOT DISTINCT FROM z.source""",
    "op8_license_blocks": f"""WITH {_PHRASES}, {_TEMPLATES}, w AS (SELECT doc_id, {_LICENSE_WORDS} AS ws FROM documents), pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        b AS (SELECT doc_id, i - 1 AS i, label FROM pos JOIN phrases ON ws[i] = p[1] AND list_slice(ws, i, i + len(p) - 1) = p), base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
        blocks AS (SELECT doc_id, size, list_slice(ws, k * size // 2 + 1, k * size // 2 + size) AS bw FROM (SELECT doc_id, ws, size, unnest(range(0, (len(ws) + size // 2 - 1) // (size // 2))) AS k FROM w, (SELECT DISTINCT size FROM templates) WHERE list_has_any(ws, {_LIST(_NEEDED)}))),
        c0 AS (SELECT doc_id, label, t, run, bw, len(list_intersect(t, bw)) / len(t) AS c, ceil({licenses.CONTAINMENT}::DOUBLE * len(t) - 1e-9) AS needed FROM blocks JOIN templates USING (size) WHERE len(bw) >= 1 AND list_has_any(t, bw) AND len(list_intersect(t, bw)) >= ceil({licenses.CONTAINMENT}::DOUBLE * len(t) - 1e-9)),
        runs AS (SELECT doc_id, label, len(t) AS n, needed, list_prepend(list_transform(t, lambda x: 0), list_transform(list_filter(list_transform(list_slice(bw, k, k + run - 1), lambda x: coalesce(list_position(t, x), 0)), lambda x: x > 0), lambda x: [x])) AS places FROM (SELECT *, unnest(range(1, len(bw) + 1)) AS k FROM c0 WHERE run > 0) WHERE list_position(t, bw[k]) > 0),
        rising AS (SELECT doc_id, label, n, needed, list_max(list_reduce(places, lambda most, x: list_transform(range(1, n + 1), lambda k: CASE WHEN k = x[1] THEN greatest(most[k], 1 + coalesce(list_max(list_slice(most, 1, k - 1)), 0)) ELSE most[k] END))) AS found FROM runs),
        c AS (SELECT doc_id, label, c FROM c0 WHERE run = 0 UNION ALL SELECT doc_id, label, found / n FROM rising WHERE found >= needed),
        every AS (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM c), labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id), score AS (SELECT doc_id, max(c) AS c FROM c GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0) END AS score
        FROM w LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN score USING (doc_id)""",
}
