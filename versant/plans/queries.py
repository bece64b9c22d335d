"""Queries over the bundled tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import costs, similarity
from ..functions import text as T
from ..operators import boundaries, frames, intervals, runs
from . import alignment, report
from .roles import FRAMES_SQL, RESULTS_SQL, SEGMENTS_SQL, SILENCES_SQL, normalized_sql, words_sql
from .roles import frames as frame_rows
from .roles import results, segments, silences, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- text -----------------------------------------------------------------


@query(f"SELECT doc_id, {normalized_sql('text')} AS norm FROM documents")
def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize("text").alias("norm"))


@query("SELECT item_id, regexp_replace(x, '[\\x{064B}-\\x{0652}]', '', 'g') AS bare, regexp_replace(translate(x, 'أإآٱ', 'اااا'), '[^\\x{0621}-\\x{064A}\\s]', '', 'g') AS strict FROM (SELECT item_id, 'بِسْمِ ٱللَّهِ أَعُوذُ ' || text AS x FROM benchmark)")
def text_strip(spark, sf):
    x = F.concat(F.lit("بِسْمِ ٱللَّهِ أَعُوذُ "), F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", T.remove_diacritics(x).alias("bare"), T.normalize_strict(x).alias("strict"))


@query(f"SELECT doc_id, len({words_sql(normalized_sql('text'))})::INTEGER AS n_words FROM documents")
def word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count("text").alias("n_words"))


@query(f"""WITH w AS (SELECT item_id, {words_sql(normalized_sql('text'))} AS ws FROM benchmark)
SELECT item_id, array_to_string(ws[1:3], ' ') AS first3, array_to_string(ws[greatest(len(ws) - 2, 1):len(ws)], ' ') AS last3, least(greatest(len(ws), 1), 3)::INTEGER AS to_check,
CASE WHEN len(ws) < 5 THEN 0.60 WHEN len(ws) <= 15 THEN 0.75 ELSE 0.85 END::DOUBLE AS bar FROM w""")
def first_last_words(spark, sf):
    both = T.first_last_words("text", 3)
    n = T.word_count("text")
    return table(spark, sf, "benchmark").select("item_id", both["first"].alias("first3"), both["last"].alias("last3"), T.words_to_check(n).alias("to_check"), T.adaptive_threshold(n).cast("double").alias("bar"))


_PAIRS_SQL = f"""p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS b FROM conversations),
pairs AS (SELECT conv_id, turn, a, b FROM p WHERE b IS NOT NULL)"""


def _pairs(spark, sf):
    rows = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    found = rows.withColumn("b", F.lead("text").over(w)).filter("b is not null")
    return found.select("conv_id", "turn", F.col("text").alias("a"), "b")


@query(f"""WITH {_PAIRS_SQL}, w AS (SELECT conv_id, turn, {words_sql(normalized_sql('a'))} AS x, {words_sql(normalized_sql('b'))} AS y FROM pairs),
d AS (SELECT *, len(list_intersect(x, y)) AS i, len(list_distinct(list_concat(x, y))) AS u FROM w)
SELECT conv_id, turn, CASE WHEN len(x) > 0 AND len(y) > 0 THEN i / u::DOUBLE ELSE 0 END AS jaccard, CASE WHEN len(y) > 0 THEN len(x) / len(y)::DOUBLE ELSE 0 END AS coverage FROM d""")
def word_overlap(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", T.word_jaccard("a", "b").alias("jaccard"), T.coverage_ratio("a", "b").alias("coverage"))


@query(f"""WITH {_PAIRS_SQL}, n AS (SELECT conv_id, turn, {normalized_sql('a')} AS a, {normalized_sql('b')} AS b FROM pairs),
g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, greatest(length(a), 1)), lambda i: substr(a, i, 2))) AS x, list_distinct(list_transform(range(1, greatest(length(b), 1)), lambda i: substr(b, i, 2))) AS y FROM n)
SELECT conv_id, turn, CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE ELSE 0 END AS jaccard FROM g""")
def bigram_overlap(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", T.bigram_jaccard("a", "b").alias("jaccard"))


@query(f"""WITH {_PAIRS_SQL}, w AS (SELECT conv_id, turn, trim(a) AS a, {words_sql(normalized_sql('a'))} AS x, {words_sql('b')} AS y FROM pairs),
t AS (SELECT *, list_transform(y, lambda v: {normalized_sql('v')}) AS f FROM w),
k AS (SELECT *, list_filter(range(1, len(y) + 1), lambda i: len(list_filter(f[1:i], lambda v: v = f[i])) > len(list_filter(x, lambda v: v = f[i]))) AS keep FROM t)
SELECT conv_id, turn, CASE WHEN len(keep) = 0 THEN a ELSE a || ' ' || array_to_string(list_transform(keep, lambda i: y[i]), ' ') END AS merged, len(keep) = 0 OR len(keep) < len(y) AS overlap FROM k""")
def multiset_append(spark, sf):
    both = T.multiset_append("a", "b")
    return _pairs(spark, sf).select("conv_id", "turn", both["merged"].alias("merged"), both["overlap"].alias("overlap"))


@query()
def indel_similarity(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", similarity.indel("a", "b", normalized=False).alias("ratio"))


@query()
def phonetic_similarity(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", similarity.phonetic("a", "b").alias("phonetic"))


@query()
def boundary_match(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", similarity.boundary_match("a", "b", "start").alias("starts"), similarity.boundary_match("a", "b", "end").alias("ends"))


@query()
def segment_costs(spark, sf):
    rows = _pairs(spark, sf).withColumn("s", similarity.indel("a", "b")).withColumn("c", T.coverage_ratio("a", "b"))
    blank = (F.trim("a") == "") | (F.trim("b") == "")
    return rows.select("conv_id", "turn", costs.segment_cost(F.col("s"), F.col("c"), blank).alias("cost"))


@query("""WITH x AS (SELECT user_id, event_id, floor(value)::BIGINT / 512.0::DOUBLE AS s, (floor(value)::BIGINT % 64) / 32.0::DOUBLE AS c FROM events)
SELECT user_id, event_id, greatest(0.0, 1.0 - s + CASE WHEN c < 0.7 THEN (0.7::DOUBLE - c) * 0.5 WHEN c > 1.3 THEN (c - 1.3::DOUBLE) * 0.3::DOUBLE ELSE 0 END + CASE WHEN s < 0.4 THEN 0.5 * (0.4::DOUBLE - s) / 0.4::DOUBLE ELSE 0 END)::DOUBLE AS cost FROM x""")
def cost_arithmetic(spark, sf):
    s, c = F.floor("value") / 512.0, (F.floor("value") % 64) / 32.0
    return table(spark, sf, "events").select("user_id", "event_id", costs.segment_cost(s, c, F.lit(False)).alias("cost"))


@query("""WITH x AS (SELECT event_id, floor(value)::BIGINT / 512.0::DOUBLE AS s, (floor(value)::BIGINT % 64) / 32.0::DOUBLE AS c, (event_id % 25) / 8.0::DOUBLE AS r, (event_id % 9)::DOUBLE AS d, (event_id % 7)::DOUBLE AS e FROM events),
b AS (SELECT *, 1.0::DOUBLE - s + CASE WHEN c < 0.7 THEN (0.7::DOUBLE - c) * 0.5 WHEN c > 1.3 THEN (c - 1.3::DOUBLE) * 0.3::DOUBLE ELSE 0 END + CASE WHEN s < 0.4 THEN 0.5 * (0.4::DOUBLE - s) / 0.4::DOUBLE ELSE 0 END AS base FROM x)
SELECT event_id, (CASE WHEN event_id % 50 = 0 THEN 1.5 ELSE greatest(0.0, greatest(0.0, base) + CASE WHEN r < 0.5 THEN (0.5 - r) * 0.4::DOUBLE WHEN r > 2 THEN (r - 2) * 0.2::DOUBLE ELSE 0 END + CASE WHEN d > 0 AND e > 0 THEN 0.15::DOUBLE * power(ln(d / e) / 0.8::DOUBLE, 2) ELSE 0 END) END)::DECIMAL(20,12)::DOUBLE AS cost FROM b""")
def span_costs(spark, sf):
    i, v = F.col("event_id"), F.floor("value")
    cost = costs.span_cost(v / 512.0, (v % 64) / 32.0, (i % 25) / 8.0, (i % 9).cast("double"), (i % 7).cast("double"), i % 50 == 0)
    return table(spark, sf, "events").select("event_id", cost.cast("decimal(20,12)").cast("double").alias("cost"))


@query("SELECT event_id, (CASE WHEN (event_id % 20) / 100.0::DOUBLE < 0.05 THEN 0.05 WHEN event_id % 3 = 0 THEN -0.15 ELSE 0.05 END)::DOUBLE AS bonus FROM events")
def silence_bonuses(spark, sf):
    return table(spark, sf, "events").select("event_id", boundaries.silence_bonus((F.col("event_id") % 20) / 100.0, F.col("event_id") % 3 == 0).alias("bonus"))


_TYPES_SQL = f"""x AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'أَعُوذُ بِاللَّهِ مِنَ الشَّيْطَانِ الرَّجِيمِ' WHEN 1 THEN 'بِسْمِ اللَّهِ الرَّحْمَنِ الرَّحِيمِ' WHEN 2 THEN 'أَعُوذُ بِاللَّهِ مِنَ الشَّيْطَانِ الرَّجِيمِ بسم الله الرحمن الرحيم' ELSE text END AS t, CASE WHEN item_id % 5 = 0 THEN 'basmalah' WHEN item_id % 7 = 0 THEN 'istiadha' ELSE 'ayah' END AS kind FROM benchmark),
n AS (SELECT *, {normalized_sql('t')} AS p FROM x),
m AS (SELECT *, regexp_matches(p, '(?:ب\\s*س?م?\\s*)?الله\\s*الرحمن\\s*الرحيم') AS b, regexp_matches(p, '[اأإآٱو]?عوذ\\s*بالله\\s*من\\s*الشيطان\\s*الرجيم') AS i FROM n)"""


def _typed(spark, sf):
    n = F.col("item_id")
    t = F.when(n % 4 == 0, "أَعُوذُ بِاللَّهِ مِنَ الشَّيْطَانِ الرَّجِيمِ").when(n % 4 == 1, "بِسْمِ اللَّهِ الرَّحْمَنِ الرَّحِيمِ").when(n % 4 == 2, "أَعُوذُ بِاللَّهِ مِنَ الشَّيْطَانِ الرَّجِيمِ بسم الله الرحمن الرحيم").otherwise(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", t.alias("t"), F.when(n % 5 == 0, "basmalah").when(n % 7 == 0, "istiadha").otherwise("ayah").alias("kind"))


@query(f"""WITH {_TYPES_SQL} SELECT item_id, CASE WHEN kind = 'basmalah' THEN 'basmala' WHEN kind = 'istiadha' THEN 'istiadha' WHEN b THEN 'basmala' WHEN i THEN 'istiadha' END AS by_segment,
CASE WHEN i THEN 'istiadha' WHEN b THEN 'basmala' ELSE 'ayah' END AS by_text, CASE WHEN i OR b THEN 0 ELSE 1 END AS text_id FROM m""")
def special_types(spark, sf):
    by_text = T.text_type("t")
    return _typed(spark, sf).select("item_id", T.segment_type("kind", "t").alias("by_segment"), by_text["kind"].alias("by_text"), by_text["id"].alias("text_id"))


@query(f"""WITH {_TYPES_SQL}, k AS (SELECT item_id, item_id % 10 AS recording, kind IN ('istiadha', 'basmalah') AS gone FROM m)
SELECT item_id, recording FROM (SELECT *, count(*) FILTER (NOT gone) OVER (PARTITION BY recording) AS kept FROM k) WHERE NOT gone OR kept = 0""")
def special_filter(spark, sf):
    rows = _typed(spark, sf).select("item_id", (F.col("item_id") % 10).alias("recording"), "kind")
    return alignment.drop_formulas(rows, "recording", "kind", F.lit(False)).select("item_id", "recording")


@query("""WITH x AS (SELECT doc_id, '/data/reciter_' || source || '/set.v2/' || lpad((doc_id % 200)::VARCHAR, 3, '0') || '_take9.mp3' AS path FROM documents),
y AS (SELECT doc_id, regexp_extract(regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', ''), '\\d+', 0)::INTEGER AS n FROM x)
SELECT doc_id, CASE WHEN n BETWEEN 1 AND 114 THEN n END AS group_id FROM y""")
def file_group_numbers(spark, sf):
    path = F.concat(F.lit("/data/reciter_"), F.col("source"), F.lit("/set.v2/"), F.lpad((F.col("doc_id") % 200).cast("string"), 3, "0"), F.lit("_take9.mp3"))
    return table(spark, sf, "documents").select("doc_id", T.group_number(path).alias("group_id"))


@query(f"WITH n AS (SELECT item_id, {normalized_sql('text')} AS p FROM benchmark) SELECT item_id, contains(p, 'th') AND contains(p, 'er') AND contains(p, 'on') AS complete FROM n")
def required_tokens(spark, sf):
    tokens = F.array(F.lit("th"), F.lit("er"), F.lit("on"))
    return table(spark, sf, "benchmark").select("item_id", T.has_required("text", tokens).alias("complete"))


@query("SELECT lang, count(*) AS n_docs, sum(len(list_filter(string_split(lower(text), ' '), lambda w: w IN ('the', 'la', 'de', 'und'))))::BIGINT AS n_function_words FROM documents GROUP BY lang")
def coverage_report(spark, sf):
    ws = F.filter(F.split(F.lower("text"), " "), lambda w: w.isin("the", "la", "de", "und"))
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size(ws)).alias("n_function_words"))


# --- reports ----------------------------------------------------------------


@query(f"WITH {RESULTS_SQL} SELECT user_id, unit_no - 1 AS unit_index, round(start_s, 2) AS start_time, round(end_s, 2) AS end_time, round(end_s - start_s, 2) AS duration, round(score, 3) AS similarity_score, score >= 0.8 AS is_high_confidence FROM res")
def result_format(spark, sf):
    return report.format_results(results(spark, sf)).select("user_id", "unit_index", "start_time", "end_time", "duration", "similarity_score", "is_high_confidence")


@query(f"""WITH {RESULTS_SQL} SELECT user_id, count(*) AS total_units, sum(round(end_s - start_s, 2)::DECIMAL(18,2))::DOUBLE AS total_duration, round((sum(round(score, 3)::DECIMAL(18,3)) / count(*))::DECIMAL(18,9), 3)::DOUBLE AS avg_similarity, count(*) FILTER (score >= 0.8) AS high_confidence FROM res GROUP BY user_id""")
def alignment_metadata(spark, sf):
    return report.metadata(report.format_results(results(spark, sf)), "user_id")


@query(f"WITH {RESULTS_SQL} SELECT count(*) AS n_units, round((sum(score::DECIMAL(18,4)) / count(*))::DECIMAL(18,9), 4)::DOUBLE AS avg_score, min(score) AS min_score, count(*) FILTER (event_id % 9 = 0) AS n_overlaps FROM res")
def alignment_stats(spark, sf):
    return report.alignment_stats(results(spark, sf), "score", F.col("event_id") % 9 == 0)


@query(f"WITH {RESULTS_SQL} SELECT CASE WHEN score >= 0.95 THEN 'excellent' WHEN score >= 0.85 THEN 'good' WHEN score >= 0.70 THEN 'acceptable' ELSE 'poor' END AS bucket, count(*) AS n FROM res GROUP BY 1")
def quality_buckets(spark, sf):
    return report.source_counts(results(spark, sf).withColumn("bucket", T.quality_bucket("score")), "bucket")


_STATS_SQL = RESULTS_SQL + """, st AS (SELECT user_id, count(*) AS n_units, round((sum(score::DECIMAL(18,4)) / count(*))::DECIMAL(18,9), 4)::DOUBLE AS avg_score, count(*) FILTER (score >= 0.8) AS high_confidence, round(100.0::DOUBLE * count(*) FILTER (score >= 0.8) / count(*), 4) AS pct_high FROM res GROUP BY user_id)"""


@query(f"WITH {_STATS_SQL} SELECT * FROM st")
def recording_stats(spark, sf):
    return report.recording_stats(results(spark, sf), "user_id")


@query(f"WITH {_STATS_SQL} SELECT count(*) AS n_recordings, sum(n_units)::BIGINT AS n_units, round((sum(avg_score::DECIMAL(18,4)) / count(*))::DECIMAL(18,9), 4)::DOUBLE AS avg_score, (SELECT user_id FROM st ORDER BY avg_score DESC, user_id LIMIT 1) AS best, (SELECT user_id FROM st ORDER BY avg_score, user_id LIMIT 1) AS worst FROM st")
def batch_rollup(spark, sf):
    return report.batch_rollup(report.recording_stats(results(spark, sf), "user_id"), "user_id")


@query("SELECT event_type, count(*) AS n, round((sum(value::DECIMAL(18,2)) / count(*))::DECIMAL(18,9), 4)::DOUBLE AS avg_value, count(*) FILTER (value >= 400) AS n_high FROM events GROUP BY event_type")
def strategy_compare(spark, sf):
    return report.compare_strategies(table(spark, sf, "events"), "event_type", "value", 400)


@query("""WITH a AS (SELECT user_id, event_type, round((sum(value::DECIMAL(18,2)) / count(*))::DECIMAL(18,9), 4)::DOUBLE AS score FROM events GROUP BY ALL)
SELECT user_id, arg_min(event_type, {'a': -score, 'b': event_type}) AS best, arg_min(event_type, {'a': score, 'b': event_type}) AS worst, max(score) AS best_score, min(score) AS worst_score FROM a GROUP BY user_id""")
def strategy_extremes(spark, sf):
    mean = F.round(F.sum(F.col("value").cast("decimal(18,2)")) / F.count("*"), 4).cast("double").alias("score")
    return report.best_and_worst(table(spark, sf, "events").groupBy("user_id", "event_type").agg(mean), ["user_id"], "event_type", "score")


@query(f"WITH {SILENCES_SQL} SELECT user_id, count(*) AS n_silences, (sum(floor(silence_end * 1000)::BIGINT - floor(silence_start * 1000)::BIGINT) / 1000.0::DOUBLE)::DOUBLE AS total_silence FROM sil GROUP BY user_id")
def total_silence(spark, sf):
    ms = silences(spark, sf).select("user_id", F.floor(F.col("silence_start") * 1000).alias("a"), F.floor(F.col("silence_end") * 1000).alias("b"))
    return report.total_silence(ms, "user_id", "a", "b")


@query(f"""WITH {RESULTS_SQL}, nxt AS (SELECT user_id, unit_no, score, lead(score) OVER (PARTITION BY user_id ORDER BY unit_no) AS new FROM res)
SELECT user_id, count(*) FILTER (new > score) AS improved, count(*) FILTER (new = score) AS unchanged, count(*) FILTER (new < score) AS degraded FROM nxt GROUP BY user_id""")
def change_counts(spark, sf):
    w = Window.partitionBy("user_id").orderBy("unit_no")
    return report.change_counts(results(spark, sf).withColumn("new", F.lead("score").over(w)), "score", "new", "user_id")


@query(f"""WITH {RESULTS_SQL}, c AS (SELECT user_id, unit_no, 'base' AS source, 0 AS turn, score, CASE WHEN score >= 0.85 THEN 2 ELSE score END AS rated FROM res WHERE event_id % 2 = 0
UNION ALL SELECT user_id, unit_no - 1, 'greedy', 1, score, score FROM res WHERE event_id % 2 = 1 AND EXISTS (SELECT 1 FROM res b WHERE b.user_id = res.user_id AND b.unit_no = res.unit_no - 1 AND b.event_id % 2 = 0))
SELECT user_id, unit_no, score, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id, unit_no ORDER BY rated DESC, turn) AS k FROM c) WHERE k = 1""")
def prefer_best(spark, sf):
    rows = results(spark, sf)
    base = rows.filter("event_id % 2 = 0").select("user_id", "unit_no", "score")
    other = rows.filter("event_id % 2 = 1").select("user_id", (F.col("unit_no") - 1).alias("unit_no"), "score")
    return report.prefer(base, [("greedy", other)], ["user_id", "unit_no"], "score", good=0.85)


@query(f"WITH {SEGMENTS_SQL} SELECT recording, string_agg(text, ' ' ORDER BY seg_idx, text) AS merged_text FROM seg GROUP BY recording")
def ordered_concat(spark, sf):
    return report.ordered_concat(segments(spark, sf), "recording", "seg_idx", "text")


@query("""SELECT c_custkey, n_name, coalesce(r_name, 'none') AS region FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 3""")
def dim_lookup(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region").filter("r_regionkey <> 3")
    joined = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("c_custkey", "n_name", F.coalesce("r_name", F.lit("none")).alias("region"))


@query("SELECT lang, quality, count(*) AS n, round((sum(n_chars) / count(*))::DECIMAL(18,9), 2)::DOUBLE AS avg_chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def label_confidence(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return joined.groupBy("lang", "quality").agg(F.count("*").alias("n"), F.round(F.sum("n_chars") / F.count("*"), 2).alias("avg_chars"))


@query(f"""WITH {RESULTS_SQL} SELECT user_id, unit_no, unit_no::VARCHAR || ',' || start_s::DECIMAL(18,2)::VARCHAR || ',' || end_s::DECIMAL(18,2)::VARCHAR || ',"' || replace('a "b", c', '"', '""') || '"' AS line FROM res""")
def csv_lines(spark, sf):
    rows = results(spark, sf).withColumn("text", F.lit('a "b", c'))
    return rows.select("user_id", "unit_no", report.csv_line("unit_no", "start_s", "end_s", "text").alias("line"))


@query(f"""WITH {RESULTS_SQL}, f AS (SELECT user_id, unit_no, unit_no - 1 AS unit_index, round(start_s, 2) AS start_time, round(end_s, 2) AS end_time, round(end_s - start_s, 2) AS duration, round(score, 3) AS similarity_score, score >= 0.8 AS is_high_confidence FROM res)
SELECT user_id, to_json({{'metadata': {{'total_units': count(*), 'total_duration': sum(duration::DECIMAL(18,2))::DOUBLE, 'avg_similarity': round((sum(similarity_score::DECIMAL(18,3)) / count(*))::DECIMAL(18,9), 3)::DOUBLE, 'high_confidence': count(*) FILTER (is_high_confidence)}},
'results': list({{'unit_index': unit_index, 'start_time': start_time, 'end_time': end_time, 'duration': duration, 'similarity_score': similarity_score, 'is_high_confidence': is_high_confidence}} ORDER BY unit_no)}})::VARCHAR AS document FROM f GROUP BY user_id""")
def json_documents(spark, sf):
    return report.document(report.format_results(results(spark, sf)), "user_id", "unit_no")


@query(f"""WITH {RESULTS_SQL} SELECT event_id, CASE WHEN NOT end_s - start_s < 4.5 THEN 'too long' WHEN NOT score > 0.02 THEN 'low score' END AS reason FROM res WHERE NOT (end_s - start_s < 4.5 AND score > 0.02)""")
def rejected_rows(spark, sf):
    _, bad = report.validated(results(spark, sf), {"too long": F.col("end_s") - F.col("start_s") < 4.5, "low score": F.col("score") > 0.02})
    return bad.select("event_id", "reason")


@query(f"""WITH {SEGMENTS_SQL}, u AS (SELECT recording, role, text, seg_idx, start_s, end_s FROM seg)
SELECT recording, role, min_by(start_s, seg_idx) AS first_start, max_by(end_s, seg_idx) AS last_end, round(avg(length(text)), 4) AS confidence FROM u GROUP BY ALL""")
def unit_confidence(spark, sf):
    rows = segments(spark, sf).withColumn("size", F.length("text").cast("double"))
    return report.unit_confidence(rows, ["recording", "role"], "seg_idx", "size", "start_s", "end_s")


@query("SELECT doc_id, w AS word, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY ALL")
def word_multiset(spark, sf):
    ws = F.filter(F.split(F.lower("text"), "[ \\n\\t\\r]+"), lambda x: x != "")
    return table(spark, sf, "documents").select("doc_id", F.explode(ws).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


# --- runs -------------------------------------------------------------------

_ISLANDS = "SELECT *, idx - row_number() OVER (PARTITION BY user_id ORDER BY unit_no) AS island FROM"


@query(f"""WITH {RESULTS_SQL}, i AS (SELECT *, unit_no - 1 AS idx FROM res), f AS ({_ISLANDS} i WHERE score < 0.7)
SELECT user_id, min(idx)::INTEGER AS start_idx, (max(idx) + 1)::INTEGER AS end_idx FROM f GROUP BY user_id, island HAVING count(*) >= 2""")
def low_runs(spark, sf):
    return runs.low_runs(results(spark, sf), "user_id", "unit_no", "score")


_ZONE_SQL = "SELECT user_id, min(idx)::INTEGER AS start_idx, (max(idx) + 1)::INTEGER AS end_idx, min(unit_no) AS start_unit, max(unit_no) AS end_unit, avg(score)::DECIMAL(12,6)::DOUBLE AS avg_score, min_by(start_s, idx) AS start_time, max_by(end_s, idx) AS end_time FROM f GROUP BY user_id, island HAVING count(*) >= {}"


def _zone(df):
    return df.withColumn("avg_score", F.col("avg_score").cast("decimal(12,6)").cast("double"))


@query(f"""WITH {RESULTS_SQL}, i AS (SELECT *, unit_no - 1 AS idx FROM res), f AS ({_ISLANDS} i WHERE score < CASE WHEN n_words < 5 THEN 0.60 WHEN n_words <= 15 THEN 0.75 ELSE 0.85 END) {_ZONE_SQL.format(3)}""")
def problem_zones(spark, sf):
    return _zone(runs.problem_zones(results(spark, sf), "user_id", "unit_no", "score", "start_s", "end_s", "n_words"))


_PACE_SQL = RESULTS_SQL + """, p AS (SELECT *, unit_no - 1 AS idx, (end_s - start_s) / greatest(n_words, 1) AS pace FROM res),
m AS (SELECT user_id, list_sort(list(pace))[len(list(pace)) // 2 + 1] AS median_pace FROM p WHERE pace > 0 GROUP BY user_id),
q AS (SELECT p.*, median_pace FROM p LEFT JOIN m USING (user_id))"""


@query(f"WITH {_PACE_SQL} SELECT user_id, median_pace FROM m")
def upper_median(spark, sf):
    return runs.with_pace(results(spark, sf), "user_id", "start_s", "end_s", "n_words").select("user_id", "median_pace").distinct()


@query(f"WITH {_PACE_SQL}, f AS ({_ISLANDS} q WHERE pace <= 0 OR greatest(pace / median_pace, median_pace / pace) > 1.5) {_ZONE_SQL.format(4)}")
def drift_zones(spark, sf):
    return _zone(runs.drift_zones(results(spark, sf), "user_id", "unit_no", "score", "start_s", "end_s", "n_words", least=4, ratio=1.5))


@query(f"WITH {_PACE_SQL}, f AS ({_ISLANDS} q WHERE score < 0.75 OR (pace > 0 AND greatest(pace / median_pace, median_pace / pace) > 2.5)) SELECT user_id, min(idx)::INTEGER AS start_idx, (max(idx) + 1)::INTEGER AS end_idx FROM f GROUP BY user_id, island HAVING count(*) >= 2")
def combined_runs(spark, sf):
    return runs.combined_runs(results(spark, sf), "user_id", "unit_no", "score", "start_s", "end_s", "n_words")


_ANCHOR_SQL = RESULTS_SQL + """, a AS (SELECT *, unit_no - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n, lag(score) OVER w AS ps, lag(end_s) OVER w AS pe, lead(score) OVER w AS ns, lead(start_s) OVER w AS nb FROM (SELECT * REPLACE (score * 8 AS score) FROM res) WINDOW w AS (PARTITION BY user_id ORDER BY unit_no)),
k AS (SELECT * FROM a WHERE score >= 0.5 AND n_words / (end_s - start_s) BETWEEN 0.2 AND 8.0 AND (n <= 2 OR ((ps IS NULL OR (ps >= 0.5 AND pe <= start_s + 1)) AND (ns IS NULL OR (ns >= 0.5 AND nb >= end_s - 1)))))"""


@query(f"WITH {_ANCHOR_SQL} SELECT user_id, unit_no, idx::INTEGER AS idx FROM k")
def anchors(spark, sf):
    return runs.anchors(results(spark, sf).withColumn("score", F.col("score") * 8), "user_id", "unit_no", "score", "start_s", "end_s", "n_words", 0.5, 0.2, 8.0).select("user_id", "unit_no", "idx")


@query(f"""WITH {_ANCHOR_SQL}, g AS (SELECT user_id, idx, n, lead(idx) OVER (PARTITION BY user_id ORDER BY idx) AS nx, count(*) OVER (PARTITION BY user_id) AS c FROM k)
SELECT user_id, (idx + 1)::INTEGER AS gap_start, coalesce(nx, n)::BIGINT AS gap_end FROM g WHERE c >= 2 AND coalesce(nx, n) - idx - 1 >= 3""")
def anchor_gaps(spark, sf):
    rows = results(spark, sf).withColumn("score", F.col("score") * 8)
    found = runs.anchors(rows, "user_id", "unit_no", "score", "start_s", "end_s", "n_words", 0.5, 0.2, 8.0)
    return runs.anchor_gaps(found, rows.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


@query(f"""WITH {RESULTS_SQL} SELECT user_id, unit_no, last_value(CASE WHEN score >= 0.7 AND end_s > start_s THEN end_s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY unit_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS trusted_end,
first_value(CASE WHEN score >= 0.7 AND end_s > start_s THEN start_s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY unit_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS trusted_start FROM res""")
def nearest_trusted(spark, sf):
    return runs.nearest_trusted(results(spark, sf), "user_id", "unit_no", "score", "start_s", "end_s").select("user_id", "unit_no", "trusted_end", "trusted_start")


# --- boundaries -------------------------------------------------------------


@query(f"""WITH {RESULTS_SQL}, g AS (SELECT *, -(start_s - lag(end_s) OVER w) AS lack, -(lead(start_s) OVER w - end_s) AS after FROM res WINDOW w AS (PARTITION BY user_id ORDER BY unit_no)),
s AS (SELECT *, CASE WHEN lack > 0 THEN round(CASE WHEN start_s + lack / 2 > end_s THEN end_s - 0.1::DOUBLE ELSE start_s + lack / 2 END, 2) ELSE start_s END AS ns FROM g)
SELECT user_id, unit_no, ns AS start_s, CASE WHEN after > 0 THEN round(CASE WHEN end_s - after / 2 < ns THEN ns + 0.1::DOUBLE ELSE end_s - after / 2 END, 2) ELSE end_s END AS end_s, coalesce(lack > 0, false) AS repaired FROM s""")
def overlap_repair(spark, sf):
    return boundaries.fix_overlaps(results(spark, sf), "user_id", "unit_no").select("user_id", "unit_no", "start_s", "end_s", "repaired")


@query(f"""WITH {RESULTS_SQL}, g AS (SELECT *, start_s - lag(end_s) OVER w AS b, lead(start_s) OVER w - end_s AS a FROM res WINDOW w AS (PARTITION BY user_id ORDER BY unit_no))
SELECT user_id, unit_no, (CASE WHEN b > 0 THEN start_s - CASE WHEN b <= 0.3 THEN least(b, 0.1::DOUBLE) WHEN b >= 0.4 THEN 0.2::DOUBLE ELSE b / 2 END ELSE start_s END)::DOUBLE AS buffered_start,
(CASE WHEN a > 0 THEN end_s + CASE WHEN a <= 0.3 THEN a - least(a, 0.1::DOUBLE) WHEN a >= 0.4 THEN a - 0.2::DOUBLE ELSE a / 2 END ELSE end_s END)::DOUBLE AS buffered_end FROM g""")
def gap_buffers(spark, sf):
    return boundaries.apply_buffers(results(spark, sf), "user_id", "unit_no").select("user_id", "unit_no", "buffered_start", "buffered_end")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q FROM lineitem),
y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, q) AS line FROM x)
SELECT l_orderkey, line, round(2.0::DOUBLE + 64.0::DOUBLE * ((sum(q) OVER r - q) / sum(q) OVER (PARTITION BY l_orderkey)::DOUBLE), 2) AS alloc_start, round(2.0::DOUBLE + 64.0::DOUBLE * (sum(q) OVER r / sum(q) OVER (PARTITION BY l_orderkey)::DOUBLE), 2) AS alloc_end FROM y WINDOW r AS (PARTITION BY l_orderkey ORDER BY line ROWS UNBOUNDED PRECEDING)""")
def proportional_split(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "q")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q")).withColumn("line", F.row_number().over(w).cast("long"))
    return boundaries.proportional_times(rows, ["l_orderkey"], ["line"], "q", F.lit(2.0), F.lit(64.0)).select("l_orderkey", "line", "alloc_start", "alloc_end")


@query(f"""WITH {SEGMENTS_SQL}, w AS (SELECT recording, seg_idx, start_s, end_s, {words_sql('text')} AS ws FROM seg), u AS (SELECT *, unnest(range(0, len(ws))) AS i FROM w)
SELECT recording, seg_idx, i::INTEGER AS word_idx, ws[i + 1] AS word FROM u""")
def word_stream(spark, sf):
    return boundaries.word_stream(segments(spark, sf), ["recording", "seg_idx"], "text", "start_s", "end_s").select("recording", "seg_idx", "word_idx", "word")


@query(f"""WITH {RESULTS_SQL} SELECT user_id, unit_no, ((sum(n_words) OVER (PARTITION BY user_id ORDER BY unit_no ROWS UNBOUNDED PRECEDING) - n_words) * 1000.0::DOUBLE / sum(n_words) OVER (PARTITION BY user_id))::DECIMAL(18,6)::DOUBLE AS expected FROM res""")
def expected_positions(spark, sf):
    found = boundaries.expected_positions(results(spark, sf), "user_id", "unit_no", "n_words", F.lit(1000.0))
    return found.select("user_id", "unit_no", F.col("expected").cast("decimal(18,6)").cast("double").alias("expected"))


@query(f"""WITH {RESULTS_SQL}, x AS (SELECT user_id, unit_no, CASE WHEN event_id % 4 = 0 THEN end_s END AS known FROM res), r AS (SELECT *, count(known) OVER (PARTITION BY user_id ORDER BY unit_no ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT user_id, unit_no, max(known) OVER (PARTITION BY user_id, g) + (row_number() OVER (PARTITION BY user_id, g ORDER BY unit_no) - 1) * 0.125::DOUBLE AS filled FROM r WHERE g > 0 UNION ALL SELECT user_id, unit_no, NULL FROM r WHERE g = 0""")
def forward_fill(spark, sf):
    rows = results(spark, sf).withColumn("known", F.when(F.col("event_id") % 4 == 0, F.col("end_s")))
    return boundaries.forward_fill(rows, "user_id", "unit_no", "known", 0.125).select("user_id", "unit_no", "filled")


# --- intervals --------------------------------------------------------------


@query(f"WITH {SILENCES_SQL} SELECT r.user_id, unit_no, silence_id FROM res r JOIN sil s ON r.user_id = s.user_id AND silence_start < end_s AND silence_end > start_s")
def interval_overlap(spark, sf):
    return intervals.overlap_join(results(spark, sf), silences(spark, sf), "user_id", ("start_s", "end_s"), ("silence_start", "silence_end")).select("user_id", "unit_no", "silence_id")


@query(f"WITH {SILENCES_SQL} SELECT r.user_id, unit_no, silence_id FROM res r JOIN sil s ON r.user_id = s.user_id AND silence_start >= start_s - 0.5 AND silence_end <= end_s + 0.5")
def range_containment(spark, sf):
    return intervals.containment_join(results(spark, sf), silences(spark, sf), "user_id", ("start_s", "end_s"), ("silence_start", "silence_end"), 0.5).select("user_id", "unit_no", "silence_id")


@query(f"WITH {SILENCES_SQL} SELECT r.user_id, unit_no, silence_id, greatest(start_s, silence_start) AS clip_start, least(end_s, silence_end) AS clip_end FROM res r JOIN sil s ON r.user_id = s.user_id AND silence_start < end_s AND silence_end > start_s WHERE least(end_s, silence_end) - greatest(start_s, silence_start) >= 0.2")
def clipped_silences(spark, sf):
    return intervals.clipped_silences(results(spark, sf), silences(spark, sf), "user_id", ("start_s", "end_s"), ("silence_start", "silence_end")).select("user_id", "unit_no", "silence_id", "clip_start", "clip_end")


@query(f"""WITH {SILENCES_SQL}, b AS (SELECT user_id, unit_no, (end_s + lead(start_s) OVER (PARTITION BY user_id ORDER BY unit_no)) / 2 AS border FROM res), j AS (SELECT b.user_id, unit_no, silence_id, abs(border - (silence_start + silence_end) / 2) AS distance, silence_start FROM b JOIN sil s ON b.user_id = s.user_id AND abs(border - (silence_start + silence_end) / 2) <= 2)
SELECT user_id, unit_no, silence_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY user_id, unit_no ORDER BY distance, silence_start) AS k FROM j) WHERE k = 1""")
def nearest_silence(spark, sf):
    w = Window.partitionBy("user_id").orderBy("unit_no")
    points = results(spark, sf).withColumn("border", (F.col("end_s") + F.lead("start_s").over(w)) / 2).filter("border is not null")
    events = silences(spark, sf).withColumn("middle", (F.col("silence_start") + F.col("silence_end")) / 2)
    return intervals.nearest(points, events, "user_id", "unit_no", "border", "middle", "silence_start", 2.0).select("user_id", "unit_no", "silence_id", "distance")


_ASOF = "SELECT r.user_id, r.unit_no, (SELECT {} FROM sil s WHERE s.user_id = r.user_id AND {}) AS as_of FROM res r"


@query(f"WITH {SILENCES_SQL} " + _ASOF.format("max_by(silence_start, silence_end)", "silence_end <= start_s"))
def asof_before(spark, sf):
    return intervals.as_of(results(spark, sf), silences(spark, sf), "user_id", "start_s", "silence_end", "silence_start").select("user_id", "unit_no", "as_of")


@query(f"WITH {SILENCES_SQL} " + _ASOF.format("min_by(silence_end, silence_start)", "silence_start >= end_s"))
def asof_after(spark, sf):
    return intervals.as_of(results(spark, sf), silences(spark, sf), "user_id", "end_s", "silence_start", "silence_end", forward=True).select("user_id", "unit_no", "as_of")


@query(f"WITH {SILENCES_SQL} SELECT user_id, unit_no FROM res r WHERE EXISTS (SELECT 1 FROM sil s WHERE s.user_id = r.user_id AND abs(r.end_s - silence_start) < 0.3)")
def tolerance_semi(spark, sf):
    return intervals.near_start(results(spark, sf), silences(spark, sf), "user_id", "unit_no", "end_s", "silence_start").select("user_id", "unit_no")


@query(f"""WITH {SILENCES_SQL}, p AS (SELECT user_id, unit_no, start_s - 2 AS a, end_s + 2 AS b FROM res)
SELECT user_id, unit_no, silence_id FROM (SELECT p.user_id, unit_no, silence_id, row_number() OVER (PARTITION BY p.user_id, unit_no ORDER BY silence_start, silence_end) AS k FROM p JOIN sil s ON p.user_id = s.user_id AND silence_start >= a AND silence_end <= b AND silence_end - silence_start >= 0.18) WHERE k = 1""")
def first_contained_gap(spark, sf):
    pairs = results(spark, sf).select("user_id", "unit_no", (F.col("start_s") - 2).alias("a"), (F.col("end_s") + 2).alias("b"))
    return intervals.first_gap_within(pairs, silences(spark, sf), "user_id", "unit_no", "a", "b", ("silence_start", "silence_end")).select("user_id", "unit_no", "silence_id")


@query(f"""WITH {RESULTS_SQL}, n AS (SELECT user_id, unit_no, start_s + 0.25 AS other FROM res WHERE event_id % 3 <> 1) SELECT r.user_id, count(*) AS n, count(*) FILTER (abs(start_s - other) < 0.5) AS n_close FROM res r JOIN n USING (user_id, unit_no) GROUP BY r.user_id""")
def run_comparison(spark, sf):
    rows = results(spark, sf)
    other = rows.filter("event_id % 3 <> 1").select("user_id", "unit_no", (F.col("start_s") + 0.25).alias("other"))
    return report.compare_runs(rows, other, ["user_id", "unit_no"], "user_id", "start_s", "other")


@query(f"WITH {SILENCES_SQL} SELECT r.user_id, unit_no FROM res r WHERE EXISTS (SELECT 1 FROM sil s WHERE s.user_id = r.user_id AND silence_start < end_s AND silence_end > start_s)")
def interval_semi(spark, sf):
    found = intervals.overlap_join(results(spark, sf), silences(spark, sf), "user_id", ("start_s", "end_s"), ("silence_start", "silence_end"), how="left_semi")
    return found.select("user_id", "unit_no")


@query(f"""WITH {RESULTS_SQL}, x AS (SELECT *, unit_no - 1 AS idx, start_s >= 20 AND end_s <= 200 AND score >= 0.2 AS inside FROM res),
b AS (SELECT *, min(idx) FILTER (inside) OVER (PARTITION BY user_id) AS lo, max(idx) FILTER (inside) OVER (PARTITION BY user_id) AS hi FROM x) SELECT user_id, unit_no FROM b WHERE idx BETWEEN lo AND hi AND idx BETWEEN 1 AND 40""")
def contained_slice(spark, sf):
    rows = results(spark, sf).withColumn("idx", F.col("unit_no") - 1)
    inside = (F.col("start_s") >= 20) & (F.col("end_s") <= 200) & (F.col("score") >= 0.2)
    return intervals.contiguous_slice(rows, ["user_id"], "idx", F.lit(1), F.lit(40), inside).select("user_id", "unit_no")


# --- frames -----------------------------------------------------------------

_LEVEL_SQL = FRAMES_SQL + """, l AS (SELECT user_id, t, rms / CASE WHEN max(rms) OVER (PARTITION BY user_id) > 0 THEN max(rms) OVER (PARTITION BY user_id) ELSE 1 END AS level, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nt FROM frames)"""


@query(f"""WITH {_LEVEL_SQL}, q AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id ORDER BY t) AS island FROM l WHERE level < power(10, -0.5))
SELECT user_id, min(t) AS silence_start, max(coalesce(nt, t)) AS silence_end FROM q GROUP BY user_id, island HAVING max(coalesce(nt, t)) - min(t) >= 0.3""")
def silence_runs(spark, sf):
    return frames.silence_runs(frame_rows(spark, sf), "user_id", "t", "rms", threshold_db=-10.0)


@query(f"""WITH {_LEVEL_SQL}, q AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id ORDER BY t) AS island FROM l WHERE NOT level < power(10, -0.5)),
c AS (SELECT user_id, min(t) AS s, max(coalesce(nt, 1000)) AS e FROM q GROUP BY user_id, island), o AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY user_id ORDER BY s) < 0.6 THEN 0 ELSE 1 END AS opens FROM c), g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY s) AS chunk FROM o)
SELECT user_id, min(s) AS chunk_start, max(e) AS chunk_end FROM g GROUP BY user_id, chunk UNION ALL SELECT user_id, 0, 1000 FROM l GROUP BY user_id HAVING bool_and(level < power(10, -0.5))""")
def speech_chunks(spark, sf):
    return frames.speech_chunks(frame_rows(spark, sf), "user_id", "t", "rms", F.lit(1000.0), threshold_db=-10.0, merge_gap=0.6)


@query(f"WITH {FRAMES_SQL} SELECT user_id, t, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rms, t)::INTEGER AS rank FROM frames) WHERE rank <= 3")
def topk_minima(spark, sf):
    return frames.lowest_frames(frame_rows(spark, sf), "user_id", "t", "rms").select("user_id", "t", "rank")


@query(f"WITH {FRAMES_SQL} SELECT user_id, t, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rms, t)::INTEGER AS rank FROM frames WHERE t BETWEEN 2 AND 9) WHERE rank <= 2")
def topk_minima_within(spark, sf):
    return frames.lowest_frames(frame_rows(spark, sf), "user_id", "t", "rms", n=2, first=2.0, last=9.0).select("user_id", "t", "rank")


@query("""WITH e AS (SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS h, value FROM events), x AS (SELECT user_id, h AS frame_start, value FROM e UNION ALL SELECT user_id, h - INTERVAL '1 hour', value FROM e)
SELECT user_id, epoch_ms(frame_start) AS frame_ms, sqrt(avg(value * value))::DECIMAL(12,4)::DOUBLE AS rms FROM x GROUP BY ALL""")
def energy_envelope(spark, sf):
    rows = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = frames.energy_envelope(rows, "user_id", "at", "value", "2 hours", "1 hour")
    return found.select("user_id", F.unix_millis("frame_start").alias("frame_ms"), F.col("rms").cast("decimal(12,4)").cast("double").alias("rms"))


@query(f"WITH {SILENCES_SQL} SELECT user_id, silence_id, floor(silence_start * 1000)::BIGINT / 1000.0::DOUBLE AS start_sec, floor(silence_end * 1000)::BIGINT / 1000.0::DOUBLE AS end_sec, true AS is_breath_boundary FROM sil")
def breath_intervals(spark, sf):
    ms = silences(spark, sf).select("user_id", "silence_id", F.floor(F.col("silence_start") * 1000).alias("a"), F.floor(F.col("silence_end") * 1000).alias("b"))
    return frames.breath_intervals(ms, "a", "b").drop("duration_sec")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, count(*) AS n_events, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM s GROUP BY user_id, sid""")
def sessions(spark, sf):
    found = frames.sessions(table(spark, sf, "events"), "user_id", "ts", "6 hours")
    return found.select("user_id", "n_events", F.unix_micros(F.col("session_start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("session_end").cast("timestamp")).alias("end_us"))


# --- alignment --------------------------------------------------------------


def _units(spark, sf):
    """Each recording's own user turns as the units to be found in all of its turns."""
    return segments(spark, sf).filter("role = 'user'").select("recording", (F.col("seg_idx") + 1).alias("unit_no"), "text")


def _aligned(strategy: str, **options):
    def run(spark, sf):
        rows = segments(spark, sf)
        quiet = rows.select("recording", (F.col("end_s") - 0.125).alias("silence_start"), (F.col("end_s") + 0.125).alias("silence_end"))
        return alignment.align(rows, _units(spark, sf), strategy, quiet, **options)

    return run


for _name, _options in {"align_dp": ("dp", {}), "align_greedy": ("greedy", {}), "align_hybrid": ("hybrid", {}), "align_words": ("words", {}), "align_raw": ("dp", {"fix_drift": False, "snap_energy": False, "snap_silence": False, "repair": False})}.items():
    QUERIES[_name] = _aligned(_options[0], **_options[1])


def _words_in_order(spark, sf):
    """All words of each recording, numbered from 1 on (place)."""
    turn = F.row_number().over(Window.partitionBy("recording").orderBy("seg_idx", "text"))
    words = boundaries.word_stream(segments(spark, sf).withColumn("seg_no", turn), ["recording", "seg_no"], "text", "start_s", "end_s")
    return words.withColumn("place", F.row_number().over(Window.partitionBy("recording").orderBy("seg_no", "word_idx")).cast("long"))


@query()
def word_gap_smoothing(spark, sf):
    numbered = _words_in_order(spark, sf).select("recording", "place", F.col("seg_idx").alias("unit"), F.col("word_start").alias("s"), F.col("word_end").alias("e"))
    return boundaries.smooth_gaps(numbered, "recording", "place", "unit", "s", "e", F.lit(0.0))


@query()
def match_words(spark, sf):
    """The words of each recording's user turns, to be found among those of its other turns."""
    words = _words_in_order(spark, sf).select("recording", "role", F.col("place").alias("word_idx"), "word")
    user = F.col("role").eqNullSafe("user")
    return alignment.match_words(words.filter(user).drop("role"), words.filter(~user).drop("role"))


@query()
def claim_breaths(spark, sf):
    ends = results(spark, sf).select(F.col("user_id").alias("recording"), F.col("unit_no").alias("seg_idx"), "end_s")
    quiet = silences(spark, sf).select(F.col("user_id").alias("recording"), F.col("silence_start").alias("start_sec"), F.col("silence_end").alias("end_sec"))
    return alignment.claim_breaths(ends, quiet)


@query()
def snap_silences(spark, sf):
    rows = results(spark, sf).select(F.col("user_id").alias("recording"), "unit_no", "start_s", "end_s")
    quiet = silences(spark, sf).select(F.col("user_id").alias("recording"), F.col("silence_start").alias("a"), F.col("silence_end").alias("b"))
    return alignment.snap_boundaries(rows, quiet, "silences")


@query()
def snap_energy(spark, sf):
    rows = results(spark, sf).select(F.col("user_id").alias("recording"), "unit_no", "start_s", "end_s")
    frames_ = frame_rows(spark, sf).select(F.col("user_id").alias("recording"), (F.col("t") * 12).alias("a"), F.col("rms").alias("b"))
    return alignment.snap_boundaries(rows, frames_, "energy")
