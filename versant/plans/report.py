"""Reports over aligned rows: rounding, metadata, roll-ups, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH_CONFIDENCE = 0.8


def format_results(rows: DataFrame, unit: str = "unit_no", start: str = "start_s", end: str = "end_s", score: str = "score") -> DataFrame:
    """unit_index, rounded times and score; duration and confidence come from the values before rounding."""
    s, e = F.col(start), F.col(end)
    return rows.select("*", (F.col(unit) - 1).alias("unit_index"), F.round(s, 2).alias("start_time"), F.round(e, 2).alias("end_time"), F.round(e - s, 2).alias("duration"), F.round(score, 3).alias("similarity_score"), (F.col(score) >= HIGH_CONFIDENCE).alias("is_high_confidence"))


def metadata(formatted: DataFrame, *keys: str) -> DataFrame:
    """Counts and means of formatted rows, overall or for each key; zeros without rows."""
    total = F.sum(F.col("duration").cast("decimal(18,2)"))
    mean = F.sum(F.col("similarity_score").cast("decimal(18,3)")) / F.count("*")
    aggregates = [F.count("*").alias("total_units"), F.coalesce(total, F.lit(0)).cast("double").alias("total_duration"), F.coalesce(F.round(mean, 3).cast("double"), F.lit(0.0)).alias("avg_similarity"), F.coalesce(F.count_if("is_high_confidence"), F.lit(0)).alias("high_confidence")]
    return formatted.groupBy(*keys).agg(*aggregates)


def alignment_stats(rows: DataFrame, score: str = "score", overlap: Column | None = None, *keys: str) -> DataFrame:
    """Units, mean and least score, overlaps; zeros without rows."""
    mean = F.sum(F.col(score).cast("decimal(18,4)")) / F.count("*")
    return rows.groupBy(*keys).agg(F.count("*").alias("n_units"), F.coalesce(F.round(mean, 4).cast("double"), F.lit(0.0)).alias("avg_score"), F.coalesce(F.min(score), F.lit(0.0)).alias("min_score"), F.count_if(overlap if overlap is not None else F.lit(False)).alias("n_overlaps"))


def source_counts(rows: DataFrame, source: str) -> DataFrame:
    return rows.groupBy(source).agg(F.count("*").alias("n"))


def change_counts(joined: DataFrame, old: str, new: str, *keys: str) -> DataFrame:
    """How many rows got better, stayed, got worse."""
    return joined.groupBy(*keys).agg(F.count_if(F.col(new) > F.col(old)).alias("improved"), F.count_if(F.col(new) == F.col(old)).alias("unchanged"), F.count_if(F.col(new) < F.col(old)).alias("degraded"))


def recording_stats(rows: DataFrame, key: str, score: str = "score") -> DataFrame:
    """For each recording: units, mean score, share of confident units in percent."""
    mean = F.sum(F.col(score).cast("decimal(18,4)")) / F.count("*")
    confident = F.count_if(F.col(score) >= HIGH_CONFIDENCE)
    return rows.groupBy(key).agg(F.count("*").alias("n_units"), F.round(mean, 4).cast("double").alias("avg_score"), confident.alias("high_confidence"), F.round(100.0 * confident / F.count("*"), 4).alias("pct_high"))


def batch_rollup(stats: DataFrame, key: str) -> DataFrame:
    """Over recordings: the unweighted mean of their rounded means, the best and the worst, first on ties."""
    mean = F.sum(F.col("avg_score").cast("decimal(18,4)")) / F.count("*")
    best = F.max_by(key, F.struct(F.col("avg_score"), -F.col(key)))
    worst = F.min_by(key, F.struct(F.col("avg_score"), F.col(key)))
    return stats.agg(F.count("*").alias("n_recordings"), F.sum("n_units").alias("n_units"), F.round(mean, 4).cast("double").alias("avg_score"), best.alias("best"), worst.alias("worst"))


def unit_confidence(words: DataFrame, keys: list[str], order: str, confidence: str, start: str, end: str) -> DataFrame:
    """Mean confidence of a unit's words, its first start and last end."""
    return words.groupBy(*keys).agg(F.round(F.avg(confidence), 4).alias("confidence"), F.min_by(start, order).alias("first_start"), F.max_by(end, order).alias("last_end"))


def ordered_concat(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Texts of a key in order, one space between."""
    gathered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(gathered, lambda x: x["t"]), " ").alias("merged_text"))


def prefer(base: DataFrame, others: list[tuple[str, DataFrame]], key: list[str], score: str, margin: float = 0.0, good: float | None = None) -> DataFrame:
    """For each row of ``base`` the candidate with the highest score, base first among equals; base stays
    where its score is ``good`` already.  ``source`` says which one won."""
    ranked = base.withColumn("source", F.lit("base")).withColumn("_turn", F.lit(0)).withColumn("_rated", F.when(F.col(score) >= good, 2.0).otherwise(F.col(score) + margin) if good is not None else F.col(score) + margin)
    for turn, (name, rows) in enumerate(others, 1):
        ranked = ranked.unionByName(rows.join(base.select(*key), key, "left_semi").withColumn("source", F.lit(name)).withColumn("_turn", F.lit(turn)).withColumn("_rated", F.col(score)))
    best = F.max_by(F.struct(*[c for c in ranked.columns if c not in ("_turn", "_rated")]), F.struct("_rated", -F.col("_turn")))
    return ranked.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(best.alias("_best")).select("_best.*")


def csv_line(unit: str, start: str, end: str, text: str) -> Column:
    """A line of the csv format: text always quoted, quotes doubled, times with two decimals, ties away from 0."""
    quoted = F.concat(F.lit('"'), F.replace(F.col(text), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", F.col(unit).cast("string"), *[F.col(t).cast("decimal(18,2)").cast("string") for t in (start, end)], quoted)


def text_line(unit: str, start: str, end: str, label: str = "Unit") -> Column:
    return F.format_string(f"{label} %d: %.2fs - %.2fs", F.col(unit), F.col(start), F.col(end))


def document(formatted: DataFrame, key: str, order: str) -> DataFrame:
    """One JSON document a recording: metadata and its rows in order."""
    fields = ["unit_index", "start_time", "end_time", "duration", "similarity_score", "is_high_confidence"]
    rows = formatted.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *fields))).alias("results"))
    joined = rows.join(metadata(formatted, key), key)
    results = F.transform("results", lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    about = F.struct("total_units", "total_duration", "avg_similarity", "high_confidence")
    return joined.select(key, F.to_json(F.struct(about.alias("metadata"), results.alias("results"))).alias("document"))


def full_document(aligned: DataFrame, units: DataFrame, names: DataFrame | None = None, about: dict[str, Column] | None = None) -> DataFrame:
    """recording and its whole JSON document, from what ``align`` returns: about the run (``about`` and the
    time of making, as ISO text), group and its name, totals; of each unit id, group, number, times, score,
    texts, overlap and words.  ``units``: recording, unit_no, text and id if known; ``names``: group_id, name.
    Fields without a value are left out.  Rows of recordings that couldn't be aligned are passed over."""
    known = units.select("recording", "unit_no", F.col("text").alias("original_text"), *([c] if (c := "id") in units.columns else []))
    rows = format_results(aligned.filter("error is null").withColumnRenamed("text", "transcribed_text").join(known, ["recording", "unit_no"], "left"))
    fields = [*(["id"] if "id" in known.columns else []), "group_id", "unit_no", "unit_index", "start_time", "end_time", "duration", "transcribed_text", "original_text", "similarity_score", "is_high_confidence", F.col("overlap").alias("overlap_detected"), "words"]
    unit = F.struct("unit_no", F.struct(*fields).alias("row"))
    gathered = rows.groupBy("recording").agg(F.sort_array(F.collect_list(unit)).alias("units"), F.min("group_id").alias("group_id"))
    joined = gathered.join(metadata(rows, "recording"), "recording")
    if names is not None:
        joined = joined.join(F.broadcast(names.select(F.col("group_id").alias("_g"), F.col("name").alias("group_name"))), F.col("group_id") == F.col("_g"), "left")
    made = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("generated_at")
    group = ["group_id", *(["group_name"] if names is not None else [])]
    head = F.struct(made, *[c.alias(n) for n, c in (about or {}).items()], *group, "total_units", "total_duration", "avg_similarity", "high_confidence")
    return joined.select("recording", F.to_json(F.struct(head.alias("metadata"), F.transform("units", lambda u: u["row"]).alias("results"))).alias("value"))


def validated(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every rule, rows that break one, with the first broken rule as ``reason``)."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def write_batch(documents: DataFrame, path: str, key: str) -> None:
    """One folder a recording: texts where there is nothing but a column ``value`` beside the key, else JSON."""
    rows = documents.write.mode("overwrite").partitionBy(key)
    rows.text(path) if documents.columns == [key, "value"] else rows.json(path)


def compare_runs(rows: DataFrame, other: DataFrame, keys: list[str], by: str, start: str, other_start: str, near: float = 0.5) -> DataFrame:
    """Units that two runs share, and how many of them begin within ``near`` seconds of each other."""
    joined = rows.join(other.select(*keys, other_start), keys)
    return joined.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col(start) - F.col(other_start)) < near).alias("n_close"))


def compare_strategies(rows: DataFrame, strategy: str, score: str, high: float) -> DataFrame:
    """Rows, mean score and confident rows of each strategy."""
    mean = F.sum(F.col(score).cast("decimal(18,2)")) / F.count("*")
    return rows.groupBy(strategy).agg(F.count("*").alias("n"), F.round(mean, 4).cast("double").alias("avg_value"), F.count_if(F.col(score) >= high).alias("n_high"))


def best_and_worst(rows: DataFrame, key: list[str], strategy: str, score: str) -> DataFrame:
    """For each key the strategies with the highest and the lowest score, the first by name among equals."""
    best = F.min_by(strategy, F.struct(-F.col(score), F.col(strategy)))
    worst = F.min_by(strategy, F.struct(F.col(score), F.col(strategy)))
    return rows.groupBy(*key).agg(best.alias("best"), worst.alias("worst"), F.max(score).alias("best_score"), F.min(score).alias("worst_score"))


def total_silence(silences: DataFrame, key: str, start_ms: str, end_ms: str) -> DataFrame:
    """Seconds of silence of each recording, and how many silences."""
    return silences.groupBy(key).agg(F.count("*").alias("n_silences"), (F.sum(F.col(end_ms) - F.col(start_ms)) / 1000.0).alias("total_silence"))
