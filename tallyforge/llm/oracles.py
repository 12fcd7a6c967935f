"""The same results in SQL, where SQL can say them."""

from __future__ import annotations

import math

from tallyforge.llm.percentiles import ERROR, gamma

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')".format
_LINK = lambda c: f"replace(lower({_TRIM(c)}), '_', '-')"
_LABEL = lambda c: rf"regexp_replace(lower({_TRIM(c)}), '[\s-]', '_', 'g')"

_P1 = f"""
WITH RECURSIVE r AS (SELECT record_no, {_LINK('family')} f, {_LINK('source_family')} s, lower({_TRIM('split')}) sp FROM decision_records),
e AS (SELECT f a, s b FROM r WHERE f IS NOT NULL AND s IS NOT NULL UNION SELECT s, f FROM r WHERE f IS NOT NULL AND s IS NOT NULL),
v AS (SELECT f v FROM r WHERE f IS NOT NULL UNION SELECT s FROM r WHERE s IS NOT NULL),
reach AS (SELECT v, v w FROM v UNION SELECT reach.v, e.b FROM reach JOIN e ON e.a = reach.w),
comp AS (SELECT v, min(w) c FROM reach GROUP BY v),
rc AS (SELECT record_no, sp, c FROM r JOIN comp ON v = coalesce(f, s))"""
P1_FOUND = f"""{_P1},
torn AS (SELECT c, min(record_no) set_no FROM rc GROUP BY c HAVING count(DISTINCT CASE WHEN sp IN ('train', 'validation', 'eval', 'test') THEN sp END) > 1)
SELECT record_no, set_no FROM rc JOIN torn USING (c)
"""

P1_KEPT_TOGETHER = f"""{_P1} SELECT (SELECT count(*) FROM r)::BIGINT AS records, (SELECT count(DISTINCT c) FROM rc) + (SELECT count(*) FROM r WHERE f IS NULL AND s IS NULL) AS sets, 0::BIGINT AS torn, true AS named"""
P1_LARGE_SETS = f"""{_P1}, n AS (SELECT min(record_no) set_no, count(*)::BIGINT n_records FROM rc GROUP BY c)
SELECT set_no, n_records, n_records / (SELECT count(*) FROM r) AS share FROM n WHERE n_records >= greatest(2, 0.005 * (SELECT count(*) FROM r))"""

_VALID = "{0} IS NOT NULL AND NOT isnan({0}) AND NOT isinf({0}) AND {0} >= 0"


def _sketch(value: str, by: str, source: str) -> str:
    return f"""SELECT {by}, CASE WHEN {value} > 0 THEN 1 ELSE 0 END AS sign, CASE WHEN {value} > 0 THEN ceil(ln({value}) / {math.log(gamma(ERROR))!r})::INT ELSE 0 END AS bucket, {ERROR}::DOUBLE AS error_bound, count(*) AS n
    FROM {source} WHERE {_VALID.format(value)} GROUP BY ALL"""


def _percentiles(value: str, by: str, source: str) -> str:
    g = gamma(ERROR)
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    marks = ", ".join(f"round(arg_min(mark, (sign, bucket)) FILTER (upto > floor({q} * (total - 1))), 6) AS p{q * 100:g}" for q in (0.5, 0.9, 0.95, 0.99))
    return f"""WITH s AS ({_sketch(value, by or '1 AS one', source)}),
    t AS (SELECT *, sum(n) OVER ({part} ORDER BY sign, bucket) upto, sum(n) OVER ({part}) total, sign * {2 / (g + 1)!r} * pow({g!r}, bucket * sign) mark FROM s)
    SELECT {keys}max(total)::BIGINT AS n, {marks}, {ERROR}::DOUBLE AS error_bound FROM t {f'GROUP BY {by}' if by else ''}"""


_RESULTS = "(SELECT called_at::DATE AS day, raw_response.model AS model, api_url, latency_ms FROM results)"

_WORDS = r"""regexp_extract_all(lower(CASE WHEN regexp_matches(input.state, '^\s*[{\[]') THEN regexp_replace(input.state, '\\[nrtbf]', ' ', 'g') ELSE input.state END), '[\p{L}\p{N}]+')"""
_P3 = f"""
r AS (SELECT record_no, lower({_TRIM('split')}) sp, source_family, list_distinct({_WORDS}) w FROM decision_records WHERE input.state IS NOT NULL),
x AS (SELECT record_no, sp, len(w) n, unnest(w) u FROM r WHERE sp IN ('train', 'validation', 'eval', 'test') AND len(w) > 0),
shared AS (SELECT t.record_no t, h.record_no e, count(*) c, any_value(t.n) nt, any_value(h.n) ne FROM x t JOIN x h ON t.u = h.u AND t.sp = 'train' AND h.sp <> 'train' GROUP BY ALL),
pairs AS (SELECT t, e FROM shared WHERE c >= 0.8 * (nt + ne - c))
"""
P3_FOUND = f"WITH {_P3} SELECT least(t, e) AS record_no_a, greatest(t, e) AS record_no_b FROM pairs"
P3_COUNTS = f"""WITH {_P3}, c AS (SELECT e, count(*) n FROM pairs GROUP BY e)
SELECT lower({_TRIM('split')}) AS split, {_LINK('source_family')} AS source_family, sum(n)::BIGINT AS pairs, count(*) AS records FROM c JOIN decision_records ON e = record_no GROUP BY 1, 2"""

_P5 = f"""
WITH e AS (SELECT DISTINCT d.id, t.domain, t.qtype, t.subtopic FROM decision_records d JOIN category_target t
  ON {_LABEL('d.domain')} = t.domain AND {_LABEL("d.input.questions['decision'].type")} = t.qtype AND {_LABEL('d.subtopic')} = t.subtopic WHERE d.id IS NOT NULL),
s AS (SELECT count(DISTINCT id) // 10 AS s FROM e),
c AS (SELECT domain, qtype, subtopic, count(*) n FROM e GROUP BY ALL)"""
P5_FOUND = f"""{_P5}
SELECT t.domain, t.qtype, t.subtopic FROM category_target t CROSS JOIN s LEFT JOIN c USING (domain, qtype, subtopic)
WHERE coalesce(n, 0) < greatest(min_rows, (target_permille * s + 999) // 1000)
"""

P5_TARGETS_MET = f"""{_P5},
p AS (SELECT m.domain AS domain, m.qtype AS qtype, m.subtopic AS subtopic, count(*) placed FROM (SELECT id, min(struct_pack(domain := domain, qtype := qtype, subtopic := subtopic)) m FROM e GROUP BY id) GROUP BY ALL)
SELECT t.domain, t.qtype, t.subtopic, coalesce(n, 0)::BIGINT AS eligible, greatest(min_rows, (target_permille * s + 999) // 1000)::BIGINT AS needed, greatest(min_rows, target_permille * s // 1000)::BIGINT AS least_rows,
coalesce(placed, 0) >= greatest(min_rows, target_permille * s // 1000) AS met, true AS "within"
FROM category_target t CROSS JOIN s LEFT JOIN c USING (domain, qtype, subtopic) LEFT JOIN p USING (domain, qtype, subtopic)
"""

P7_FOUND = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM eval_items WHERE lang IS DISTINCT FROM 'zh'),
ic AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), '') b FROM eval_items WHERE lang = 'zh'),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) i FROM iw WHERE len(w) >= 12)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 11], ' ') g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) i FROM dw WHERE len(w) >= 12)),
db AS (SELECT doc_id, array_to_string(w, '') b FROM dw),
icg AS (SELECT DISTINCT item_id, substr(b, i, 30) g FROM (SELECT item_id, b, unnest(generate_series(1, length(b) - 29)) i FROM ic WHERE length(b) >= 30)),
dcg AS (SELECT doc_id, substr(b, i, 30) g FROM (SELECT doc_id, b, unnest(generate_series(1, length(b) - 29)) i FROM db WHERE length(b) >= 30))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g) UNION SELECT doc_id, item_id FROM dcg JOIN icg USING (g)
"""

P8_FOUND = f"""
WITH t AS (SELECT source, lower({_TRIM('source')}) c, target_permille, max_repeats FROM mix_target),
d AS (SELECT lower({_TRIM('source')}) c, sum(coalesce(length(text), 0)) tokens FROM documents GROUP BY 1),
j AS (SELECT t.source, target_permille, max_repeats, coalesce(tokens, 0) tokens FROM t LEFT JOIN d USING (c))
SELECT source FROM j WHERE max_repeats * tokens * 1000 < target_permille * (SELECT sum(tokens) FROM j)
"""

P8_CHARACTER_SHARES = f"""
WITH t AS (SELECT source, lower({_TRIM('source')}) c, target_permille, max_repeats FROM mix_target),
d AS (SELECT lower({_TRIM('source')}) c, count(*) documents, sum(coalesce(length(text), 0)) tokens FROM documents GROUP BY 1),
j AS (SELECT t.source, target_permille, max_repeats, coalesce(documents, 0)::BIGINT documents, coalesce(tokens, 0)::BIGINT tokens FROM t LEFT JOIN d USING (c)), a AS (SELECT sum(tokens)::BIGINT total FROM j)
SELECT source, documents, tokens, round(target_permille::DOUBLE * total / 1000, 3) AS target_tokens, max_repeats * tokens * 1000 < target_permille * total AS short, true AS near, true AS within_repeats FROM j, a
"""

_BARE = r"array_to_string(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), '')".format
_COPIES = "SELECT min(no) AS kept_no, count(*) AS copies FROM (SELECT {no} AS no, {bare} AS b FROM {source}) WHERE b <> '' GROUP BY b".format
P6_QUESTION_COPIES = _COPIES(no="gold_no", bare=_BARE("question"), source="gold_template WHERE question IS NOT NULL")
P6_TEXT_COPIES = _COPIES(no="record_no", bare=_BARE("input.state"), source=r"decision_records WHERE input.state IS NOT NULL AND NOT regexp_matches(input.state, '^\s*[{\[]')")

# every node of a JSON state under its path of bare names and places, all of them sorted: equal exactly where the structures are
_FORMS = rf"""WITH RECURSIVE r AS (SELECT 'decision_records' AS t, record_no AS no, input.state AS x FROM decision_records WHERE input.state IS NOT NULL UNION ALL SELECT 'gold_template', gold_no, question FROM gold_template WHERE question IS NOT NULL),
k AS (SELECT row_number() OVER () AS i, t, no, x, regexp_matches(x, '^\s*[{{\[]') AND json_valid(x) AS js FROM r),
n AS (SELECT k.i, j.id, j.parent, j.key, j.type, CASE WHEN j.type = 'VARCHAR' THEN j.atom ->> '$' ELSE j.atom::VARCHAR END AS leaf FROM k, json_tree(CASE WHEN k.js THEN k.x END) j WHERE k.js),
p AS (SELECT i, id, type, leaf, '' AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.i, n.id, n.type, n.leaf, p.path || CASE WHEN p.type = 'ARRAY' THEN '[' || n.key || ']' ELSE '.' || {_BARE("n.key")} END FROM n JOIN p ON n.i = p.i AND n.parent = p.id),
f AS (SELECT k.t, k.no, 'j' || string_agg(path || '|' || CASE WHEN type IN ('OBJECT', 'ARRAY') THEN type ELSE '=' || {_BARE("coalesce(leaf, 'null')")} END, chr(10) ORDER BY path || '|' || CASE WHEN type IN ('OBJECT', 'ARRAY') THEN type ELSE '=' || {_BARE("coalesce(leaf, 'null')")} END) AS form,
    bool_or({_BARE("coalesce(leaf, '')")} <> '' OR type = 'NULL' OR regexp_matches(path, '[^\.\[\]0-9]|\.[0-9]')) AS has_text FROM p JOIN k USING (i) GROUP BY k.t, k.no, k.i
    UNION ALL SELECT t, no, 't' || {_BARE("x")}, {_BARE("x")} <> '' FROM k WHERE NOT js),
g AS (SELECT t, form, min(no) AS kept_no, count(*) AS copies FROM f WHERE has_text GROUP BY t, form)"""
P6_FOUND = f"{_FORMS} SELECT t AS source_table, kept_no, no AS copy_no FROM f JOIN g USING (t, form) WHERE no > kept_no"
P6_RECORDS = f"{_FORMS} SELECT t AS source_table, kept_no, copies FROM g"

P2_BOUNDS_KEPT = f"""WITH v AS (SELECT raw_response.model AS model, list_sort(list(latency_ms)) l, count(*) n FROM results WHERE {_VALID.format('latency_ms')} GROUP BY 1)
SELECT model, n, {', '.join(f"l[floor({q} * (n - 1))::BIGINT + 1] AS exact_p{q * 100:g}, true AS kept_p{q * 100:g}" for q in (0.5, 0.9, 0.95, 0.99))} FROM v"""

_P9 = r"""
WITH w AS (SELECT doc_id, i, substr(text, i, 150) s FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 149)) i FROM documents WHERE length(text) >= 150)),
sh AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
x AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) p FROM w JOIN sh USING (s)),
isl AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 150 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) k FROM x),
sp AS (SELECT doc_id, min(i) b, max(i) + 149 e FROM isl GROUP BY doc_id, k),
c AS (SELECT doc_id, sum(length(regexp_replace(substr(text, b, e - b + 1), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]', '', 'g'))) n, any_value(length(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]', '', 'g'))) t FROM sp JOIN documents USING (doc_id) GROUP BY doc_id)
"""
P9_FOUND = f"""{_P9}
SELECT doc_id, CASE WHEN n = t THEN 'whole' WHEN n * 2 >= t THEN 'most' ELSE 'part' END AS extent FROM c
"""
P9_SHARES = f"""{_P9}
SELECT doc_id, CASE WHEN n = t THEN 'whole' WHEN n * 2 >= t THEN 'most' ELSE 'part' END AS extent, n::BIGINT AS shared_chars, t::BIGINT AS blankless FROM c"""
P9_STRETCHES = r"""
WITH w AS (SELECT doc_id, i, substr(text, i, 150) s FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 149)) i FROM documents WHERE length(text) >= 150)),
sh AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
x AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) k FROM w JOIN sh USING (s))
SELECT doc_id, (min(i) - 1)::INT AS begin, (max(i) + 149)::INT AS "end" FROM x GROUP BY doc_id, k
"""


def oracle_sql() -> dict[str, str]:
    baseline = "(SELECT * FROM disagreements)"
    return {
        "p1_found": P1_FOUND,
        "p1_kept_together": P1_KEPT_TOGETHER,
        "p1_large_sets": P1_LARGE_SETS,
        "p2_bounds_kept": P2_BOUNDS_KEPT,
        "p2_day_sketches": _sketch("latency_ms", "day, model, api_url", _RESULTS),
        "p2_by_model": _percentiles("latency_ms", "model", _RESULTS),
        "p2_by_api_url": _percentiles("latency_ms", "api_url", _RESULTS),
        "p2_by_day": _percentiles("latency_ms", "day", _RESULTS),
        "p2_days_combined": _percentiles("latency_ms", "", _RESULTS),
        "p2_baseline_model": _percentiles("baseline_latency_ms", "baseline_model", baseline),
        "p2_baseline_phase": _percentiles("baseline_latency_ms", "phase", baseline),
        "p3_found": P3_FOUND,
        "p3_counts": P3_COUNTS,
        "p5_found": P5_FOUND,
        "p5_targets_met": P5_TARGETS_MET,
        "p6_found": P6_FOUND,
        "p6_records": P6_RECORDS,
        "p6_question_copies": P6_QUESTION_COPIES,
        "p6_text_copies": P6_TEXT_COPIES,
        "p7_found": P7_FOUND,
        "p7_items": f"SELECT item_id, count(*) AS documents FROM ({P7_FOUND}) GROUP BY item_id",
        "p7_cleaned": f"SELECT doc_id, doc_id IN (SELECT doc_id FROM ({P7_FOUND})) AS cut FROM documents",
        "p8_found": P8_FOUND,
        "p8_character_shares": P8_CHARACTER_SHARES,
        "p9_found": P9_FOUND,
        "p9_shares": P9_SHARES,
        "p9_stretches": P9_STRETCHES,
    }
