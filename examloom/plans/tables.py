"""Queries over texts, events, vectors and the star schema: segments, credit, ranks, costs, joins and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from examloom.functions import answers, prompts, segments, stats, text
from examloom.operators import credit, harness
from examloom.plans.registry import load, register
from examloom.plans import sqltext as q


@register("length_percentiles", "WITH d AS (SELECT coalesce(source, '') AS source, list_sort(list(length(text))) AS v FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT source, len(v) AS n, v[1 + floor((len(v)-1)*0.5)::INT] AS p50, v[1 + floor((len(v)-1)*0.95)::INT] AS p95, v[len(v)] AS most, len(list_filter(v, lambda x: x > 450)) AS over_limit FROM d")
def length_percentiles(spark, d):
    """Lower-index percentiles from a histogram of lengths: exact, and as small as the number of different lengths."""
    t = load(spark, d, "documents").filter("text is not null").select(F.coalesce("source", F.lit("")).alias("source"), F.length("text").alias("v"))
    h = t.groupBy("source", "v").agg(F.count("*").alias("k"))
    w = Window.partitionBy("source")
    h = h.withColumn("upto", F.sum("k").over(w.orderBy("v"))).withColumn("n", F.sum("k").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p), F.col("v")))
    return h.groupBy("source").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("v").alias("most"), F.coalesce(F.sum(F.when(F.col("v") > 450, F.col("k"))), F.lit(0)).alias("over_limit"))


@register("explanations", f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[\\p{{Z}}\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x85]+\\n', chr(10), 'g'), '^{q.SPACE}+', ''), '{q.SPACE}+$', '')) AS text_hash FROM documents")
def explanations(spark, d):
    t = load(spark, d, "documents")
    return t.select("doc_id", F.md5(text.explanation_text(F.col("text"))).alias("text_hash"))


@register("text_segments")
def text_segments(spark, d):
    """Clauses of every text; they tile it, which the tests check."""
    t = load(spark, d, "documents").filter("text != ''").select("doc_id", F.col("text").alias("t"), segments.segment_spans(F.col("text")).alias("spans"))
    return t.select("doc_id", F.size("spans").alias("n_segments"), F.element_at("spans", -1)["end"].alias("covered"), F.length("t").alias("n_chars"), F.size(segments.merge_spans(F.col("spans"))).alias("n_probes"))


_RFIND = "CASE WHEN contains(text, '\n答案：') THEN length(text) - strpos(reverse(text), reverse('\n答案：')) - 3 ELSE -1 END"


@register("rationales", f"WITH m AS (SELECT doc_id, text, starts_with(text, '解析：') AS p, {_RFIND} AS m FROM documents WHERE text <> ''), s AS (SELECT *, CASE WHEN p THEN 3 ELSE 0 END AS a FROM m), e AS (SELECT *, CASE WHEN NOT p AND m < 0 THEN 0 WHEN m >= a THEN m ELSE length(text) END AS b FROM s) SELECT doc_id, CASE WHEN NOT p AND m < 0 THEN 0 ELSE a END AS \"start\", b AS \"end\", length(substr(text, 1 + CASE WHEN NOT p AND m < 0 THEN 0 ELSE a END, b - CASE WHEN NOT p AND m < 0 THEN 0 ELSE a END)) AS n_chars FROM e")
def rationales(spark, d):
    t = load(spark, d, "documents").filter("text != ''").select("doc_id", segments.rationale_of(F.col("text")).alias("r"))
    return t.select("doc_id", "r.start", "r.end", F.length("r.rationale").alias("n_chars"))


@register("completion_parse")
def completion_parse(spark, d):
    """Every text read as an output of the three modes."""
    t, v = load(spark, d, "documents").filter("text is not null"), F.lit("ABCDE")
    modes = [answers.parse_completion(F.col("text"), m, v).alias(m) for m in answers.MODES]
    return t.select("doc_id", *modes).select("doc_id", "direct.answer", F.col("cot.strict").alias("cot_strict"), F.col("cot.analysis_chars").alias("analysis_chars"), F.col("adaptive.used_cot").alias("adaptive_cot"))


@register("reference_targets")
def reference_targets(spark, d):
    t = load(spark, d, "documents").filter("text is not null").select(answers.reference_target(F.col("text"), F.lit("ABCDE")).alias("t"))
    return t.groupBy(F.coalesce("t.answer_format", "t.reason").alias("outcome")).agg(F.count("*").alias("n"))


@register("knowledge_points")
def knowledge_points(spark, d):
    return load(spark, d, "documents").select("doc_id", prompts.knowledge_point(F.col("text")).alias("point")).filter("point is not null")


@register("segment_credit", "WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT event_id, user_id, k, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY k), 9) AS credit FROM p QUALIFY credit IS NOT NULL")
def segment_credit(spark, d):
    e = load(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return credit.segment_credit(e, "user_id", "k", "value").select("event_id", "user_id", "k", F.round("credit", 9).alias("credit"))


@register("token_credit", "WITH r AS (SELECT l_orderkey AS id, (l_linenumber - 1) * 3 AS first, (l_linenumber - 1) * 3 + 1 AS last, max(l_discount) AS credit FROM lineitem GROUP BY l_orderkey, l_linenumber), n AS (SELECT o_orderkey AS id, 8 AS length FROM orders), p AS (SELECT id, unnest(range(0, length)) AS position, length FROM n) SELECT p.id, position, round(coalesce(credit, 0.0), 9) AS credit FROM p LEFT JOIN r ON r.id = p.id AND position BETWEEN first AND least(last, length - 1)")
def token_credit(spark, d):
    li = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("credit"))
    r = li.select(F.col("l_orderkey").alias("id"), ((F.col("l_linenumber") - 1) * 3).alias("first"), ((F.col("l_linenumber") - 1) * 3 + 1).alias("last"), "credit")
    n = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(8).alias("length"))
    return credit.token_credit(r, n, "id").withColumn("credit", F.round("credit", 9))


@register("group_advantage", "WITH m AS (SELECT event_type, avg(value) AS group_mean, min(value) = max(value) AS unanimous FROM events GROUP BY 1) SELECT event_id, round(value - group_mean, 6) AS advantage, unanimous FROM events JOIN m USING (event_type)")
def group_advantage(spark, d):
    return credit.group_advantage(load(spark, d, "events"), "event_type", "value").select("event_id", F.round("advantage", 6).alias("advantage"), "unanimous")


@register("letter_probability", "WITH e AS (SELECT user_id, chr(65 + (event_id % 6)::INT) AS letter, abs(value) AS mass FROM events), g AS (SELECT user_id, sum(CASE WHEN letter <= 'E' THEN mass ELSE 0 END) AS letter_mass, sum(CASE WHEN letter = 'B' THEN mass ELSE 0 END) AS gold_mass FROM e GROUP BY 1) SELECT user_id, round(letter_mass, 6) AS letter_mass, round(CASE WHEN letter_mass > 0 THEN gold_mass / letter_mass ELSE 0 END, 9) AS phi FROM g")
def letter_probability(spark, d):
    e = load(spark, d, "events").select("user_id", F.char(65 + F.pmod("event_id", F.lit(6)).cast("int")).alias("letter"), F.abs("value").alias("mass"), F.lit("BD").alias("gold"), F.lit("ABCDE").alias("valid"))
    return credit.letter_probability(e, "user_id", "letter", "mass", "gold", "valid").select("user_id", F.round("letter_mass", 6).alias("letter_mass"), F.round("phi", 9).alias("phi"))


@register("rank_correlation", "WITH v AS (SELECT event_type, round(value) AS x, length(props) + user_id % 7 AS y FROM events), r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY event_type ORDER BY y) + (count(*) OVER (PARTITION BY event_type, y) - 1) / 2 AS ry FROM v) SELECT event_type, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1")
def rank_correlation(spark, d):
    v = load(spark, d, "events").select("event_type", F.round("value").alias("x"), (F.length("props") + F.pmod("user_id", F.lit(7))).alias("y"))
    r = credit.average_ranks(credit.average_ranks(v, ["event_type"], "x", "rx"), ["event_type"], "y", "ry")
    return r.groupBy("event_type").agg(F.count("*").alias("n"), F.round(stats.safe_corr("rx", "ry"), 6).alias("spearman"))


@register("region_loss", "SELECT user_id, round(0.3 * coalesce(avg(value) FILTER (event_id % 3 > 0), 0) + 0.7 * coalesce(avg(value) FILTER (event_id % 3 = 0), 0), 6) AS loss FROM events GROUP BY 1")
def region_loss(spark, d):
    e = load(spark, d, "events").withColumn("region", F.when(F.pmod("event_id", F.lit(3)) > 0, "analysis").otherwise("answer"))
    return credit.region_loss(e, "user_id", "region", "value", {"analysis": 0.3, "answer": 0.7}).withColumn("loss", F.round("loss", 6))


@register("head_metrics", "WITH e AS (SELECT event_type, event_id, user_id, value, value * 0.9 + (event_id % 5) AS guess FROM events), m AS (SELECT event_type, avg(value) AS mean FROM e GROUP BY 1), t AS (SELECT event_type, user_id, arg_max(event_id, {'v': value, 'i': -event_id}) = arg_max(event_id, {'v': guess, 'i': -event_id}) AS hit, count(*) AS k FROM e GROUP BY ALL), h AS (SELECT event_type, avg(hit::INT) FILTER (k > 1) AS top_hit FROM t GROUP BY 1), a AS (SELECT event_type, avg(abs(value - guess)) AS mae, avg(abs(value - mean)) AS constant_mae FROM e JOIN m USING (event_type) GROUP BY 1) SELECT event_type, round(mae, 6) AS mae, round(constant_mae, 6) AS constant_mae, round(top_hit, 6) AS top_hit FROM a JOIN h USING (event_type)")
def head_metrics(spark, d):
    """Error of predicted scores, that of a constant, and how often the top segment is hit; the first of equal ones counts."""
    e = load(spark, d, "events").select("event_type", "event_id", "user_id", "value", (F.col("value") * 0.9 + F.pmod("event_id", F.lit(5))).alias("guess"))
    mean = e.groupBy("event_type").agg(F.avg("value").alias("mean"))
    a = e.join(mean, "event_type").groupBy("event_type").agg(F.avg(F.abs(F.col("value") - F.col("guess"))).alias("mae"), F.avg(F.abs(F.col("value") - F.col("mean"))).alias("constant_mae"))
    top = lambda c: F.max_by("event_id", F.struct(c, -F.col("event_id")))
    t = e.groupBy("event_type", "user_id").agg((top("value") == top("guess")).alias("hit"), F.count("*").alias("k"))
    h = t.groupBy("event_type").agg(F.avg(F.when(F.col("k") > 1, F.col("hit").cast("int"))).alias("top_hit"))
    return a.join(h, "event_type").select("event_type", *[F.round(c, 6).alias(c) for c in ("mae", "constant_mae", "top_hit")])


@register("vector_soup", "WITH v AS (SELECT label, unnest(range(0, len(embedding))) AS position, unnest(embedding) AS x, 1 / (1 + vec_id % 4) AS w FROM embeddings) SELECT label, position, round(sum(w * x), 4) AS x FROM v GROUP BY ALL")
def vector_soup(spark, d):
    e = load(spark, d, "embeddings").select("label", (1 / (1 + F.pmod("vec_id", F.lit(4)))).alias("w"), F.posexplode("embedding").alias("position", "x"))
    return credit.weighted_vectors(e, "label", "position", "w", "x").withColumn("x", F.round("x", 4))


@register("strongest_component", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def strongest_component(spark, d):
    return load(spark, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("best"))


@register("cache_misses", "SELECT user_id, event_type, count(*) AS requests FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_acctbal > 0) GROUP BY ALL")
def cache_misses(spark, d):
    """Requests that a cache of answered keys does not serve."""
    e, c = load(spark, d, "events"), load(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return harness.cache_misses(e, c, "user_id").groupBy("user_id", "event_type").agg(F.count("*").alias("requests"))


@register("request_costs", "SELECT event_type, count(*) AS calls, sum(user_id * 10)::BIGINT AS input_tokens, round(sum((greatest(0, user_id * 10 - user_id * 3) * 2.0 + user_id * 3 * 0.5 + abs(value) * 8.0) / 1e6), 6) AS cost FROM events GROUP BY 1")
def request_costs(spark, d):
    e = load(spark, d, "events").select("event_type", (F.col("user_id") * 10).alias("prompt"), (F.col("user_id") * 3).alias("hit"), F.abs("value").alias("out"))
    cost = harness.request_cost(F.col("prompt"), F.col("hit"), F.col("out"), {"input": 2.0, "input_cache_hit": 0.5, "output": 8.0})
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("prompt").alias("input_tokens"), F.round(F.sum(cost), 6).alias("cost"))


@register("request_hashes", "SELECT doc_id, sha256('{\"max_tokens\": 64, \"messages\": [{\"content\": \"' || source || '\", \"role\": \"user\"}], \"temperature\": 0}') AS request_hash, sha256('{\"max_tokens\": 64, \"messages\": [{\"content\": \"' || source || '\", \"role\": \"user\"}], \"temperature\": 0}')[1:16] AS gen_id FROM documents WHERE source IS NOT NULL")
def request_hashes(spark, d):
    t = load(spark, d, "documents").filter("source is not null")
    h = harness.request_hash(F.array(prompts.turn("user", F.col("source"))), 64, 0)
    return t.select("doc_id", h.alias("request_hash"), F.substring(h, 1, 16).alias("gen_id"))


@register("harness_funnel", "WITH s AS (SELECT doc_id, text, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN n_chars > 450 THEN 'too_long' WHEN NOT starts_with(text, '解析：') THEN 'no_rationale' END AS reason FROM documents) SELECT count(*) AS selected, count(*) FILTER (reason IS NULL) AS requested, count(*) FILTER (reason = 'empty') AS empty, count(*) FILTER (reason = 'too_long') AS too_long, count(*) FILTER (reason = 'no_rationale') AS no_rationale FROM s")
def harness_funnel(spark, d):
    t = load(spark, d, "documents")
    return harness.funnel(t, [("empty", F.coalesce("text", F.lit("")) == ""), ("too_long", F.col("n_chars") > 450), ("no_rationale", ~F.col("text").startswith("解析："))])


@register("revenue_by_nation", "SELECT n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n_name")
def revenue_by_nation(spark, d):
    """Equi-joins of facts and dimensions; which side is broadcast is left to Spark's size estimates."""
    li, o, c, n = (load(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o.filter("o_orderdate >= timestamp_ntz'1995-01-01'"), li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.count_distinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@register("set_operations", "SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25)) AS both, (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)) AS unused, (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)) AS either")
def set_operations(spark, d):
    li, p, s = (load(spark, d, t) for t in ("lineitem", "part", "supplier"))
    used, parts = li.select(F.col("l_partkey").alias("k")), p.select(F.col("p_partkey").alias("k"))
    both = used.intersect(p.filter("p_size > 25").select(F.col("p_partkey").alias("k"))).select(F.lit("both").alias("x"))
    unused = parts.subtract(used).select(F.lit("unused").alias("x"))
    either = li.filter("l_quantity > 45").select(F.col("l_suppkey").alias("k")).union(s.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"))).distinct().select(F.lit("either").alias("x"))
    return both.union(unused).union(either).agg(*[F.count_if(F.col("x") == c).alias(c) for c in ("both", "unused", "either")])
