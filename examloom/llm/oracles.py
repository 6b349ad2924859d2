"""SQL that gives the same rows as the queries, where SQL can."""

_P1 = """
WITH n AS (SELECT exam_type, question_type, count(DISTINCT sample_id) AS available FROM build_ablation_sets GROUP BY ALL),
r AS (SELECT t.*, greatest(min_rows, ceil(target_share * sample_rows)::BIGINT) AS quota, coalesce(available, 0) AS available,
  least(greatest(min_rows, ceil(target_share * sample_rows)::BIGINT), coalesce(available, 0)) AS selected
  FROM sample_targets t LEFT JOIN n ON t.exam_type IS NOT DISTINCT FROM n.exam_type AND t.question_type IS NOT DISTINCT FROM n.question_type)
"""


def _norm(x: str) -> str:
    """The normalised text of problem 2: a mark that counts is first replaced by a private character, then punctuation goes."""
    t = f"lower(translate({x}, '．，：／～〜－−‐‑–＋＜＞＝％（）', '.,:/~~-----+<>=%()'))"
    for pattern, by in (
        (r"[\p{Z}\p{Cc}\p{Cf}]+", ""), (r"(\p{N})([-.,:/~])(\p{N})", r"\1§\2\3"), (r"(\p{N})([-.,:/~])(\p{N})", r"\1§\2\3"),
        (r"\(-\)", "(§-)"), (r"(^|[^\p{L}\p{N}§]|\p{Han})-(\p{N})", r"\1§-\2"),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    for i, mark in enumerate(("§.", "§,", "§:", "§/", "§~", "§-", "%", "‰")):
        t = f"replace({t}, '{mark}', '{chr(0xE000 + i)}')"
    return f"regexp_replace({t}, '[\\p{{P}}`~]', '', 'g')"


_P2 = f"""
WITH r AS (SELECT row_id, {_norm("question")} AS q,
  list_sort(list_distinct(list_filter(list_transform(options, lambda o: {_norm("coalesce(o.text, '')")}), lambda x: x <> ''))) AS o
  FROM build_ablation_sets WHERE question IS NOT NULL AND options IS NOT NULL),
g AS (SELECT row_id, min(row_id) OVER (PARTITION BY q, o) AS first_row_id, count(*) OVER (PARTITION BY q, o) AS copies FROM r)
"""

_P5 = """
WITH o AS (SELECT b AS bucket, row_number() OVER (ORDER BY md5('perm:' || b), b) - 1 AS place FROM range(4096) t(b)),
k AS (SELECT *, md5(coalesce('s' || sample_id, 'r' || row_id) || '|' || coalesce('u' || unit, '-')) AS h FROM build_ablation_sets),
w AS (SELECT k.*, ((strpos('0123456789abcdef', h[1]) - 1) * 256 + (strpos('0123456789abcdef', h[2]) - 1) * 16 + strpos('0123456789abcdef', h[3]) - 1)::INTEGER AS bucket FROM k)"""

SQL = {
    "p1_found": _P1 + "SELECT plan_name, exam_type, question_type FROM r WHERE quota > available",
    "p1_report": _P1 + """SELECT plan_name, exam_type, question_type, target_share, quota, available, selected, quota - selected AS deficit,
 selected / nullif(sum(selected) OVER (PARTITION BY plan_name), 0) AS actual_share FROM r""",
    "p2_found": _P2 + "SELECT first_row_id, row_id FROM g WHERE row_id <> first_row_id",
    "p2_records": _P2 + "SELECT first_row_id, copies FROM g WHERE row_id = first_row_id",
    "p4_found": """
WITH RECURSIVE e AS (SELECT DISTINCT unit AS u, sample_id AS s FROM build_ablation_sets WHERE sample_id IS NOT NULL AND unit <> ''),
m AS (SELECT s, min(u) AS hub FROM e GROUP BY s HAVING count(*) > 1),
g AS (SELECT DISTINCT u AS a, hub AS b FROM e JOIN m USING (s) WHERE u <> hub),
h AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
r AS (SELECT DISTINCT a AS x, a AS y FROM h UNION SELECT r.x, h.b FROM r JOIN h ON r.y = h.a)
SELECT min(y) AS unit_a, x AS unit_b FROM r GROUP BY x HAVING min(y) <> x""",
    "p5_sample": _P5 + """
SELECT row_id, sample_id, unit, batch, bucket, batch AS chosen_from FROM w WHERE bucket IN (SELECT bucket FROM o WHERE place < 410)""",
    "p5_list": _P5 + """,
n AS (SELECT bucket, place, coalesce(k, 0) AS k, sum(coalesce(k, 0)) OVER () AS total, sum(coalesce(k, 0)) OVER (ORDER BY place) - coalesce(k, 0) AS before
  FROM o LEFT JOIN (SELECT bucket, count(*) AS k FROM w GROUP BY 1) USING (bucket))
SELECT bucket, place::INTEGER AS place, CASE WHEN place >= 410 THEN (SELECT max(batch) FROM w) END AS since FROM n WHERE place < 410 OR before < total * 0.1""",
}
