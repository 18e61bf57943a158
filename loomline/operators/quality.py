"""Transcript quality: token histogram, character classes, means, flags, score and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.fixed import SPACE
from loomline.functions.text import strip

TOKEN = r"[\p{L}\p{N}]+"


def tokens(segments: DataFrame, key: str) -> DataFrame:
    """(key, token_count, distinct_tokens, most_common): a two-phase histogram; a key's tokens never meet in one row."""
    words = segments.select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("token"))
    return words.groupBy(key, "token").agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("token_count"), F.count("*").alias("distinct_tokens"), F.max("n").alias("most_common"))


def _length_of(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, keep, ""))


def report(segments: DataFrame, key: str, facts: DataFrame | None = None) -> DataFrame:
    """One row per key of (key, seq, text, quality): the counts, flags, score and status.

    ``facts``: (key, language_probability, duration) where known.
    """
    text = strip(F.coalesce("text", F.lit("")))
    rows = segments.select(key, text.alias("text"), "quality")
    dense = F.regexp_replace(F.col("text"), f"{SPACE}+", "")
    sums = rows.groupBy(key).agg(
        F.count("*").alias("segment_count"),
        F.count_if(F.col("text") != "").alias("n_texts"),
        F.sum(F.length("text")).alias("chars"),
        F.sum(_length_of(dense, r"[^\p{L}\p{N}]")).alias("letters"),
        F.sum(_length_of(dense, r"\P{M}")).alias("marks"),
        F.sum(F.length(dense)).alias("dense"),
        *[F.avg(f"quality.{c}").alias(f"mean_{c}") for c in ("avg_logprob", "no_speech_prob", "compression_ratio")],
    )
    out = sums.join(tokens(rows, key), key, "left").fillna(0, ["token_count", "distinct_tokens", "most_common"])
    out = out.join(facts, key, "left") if facts is not None else out.withColumns({"language_probability": F.lit(None).cast("double"), "duration": F.lit(None).cast("double")})
    n = F.col("token_count")
    out = out.withColumns(
        {
            "text_chars": F.when(F.col("n_texts") > 0, F.col("chars") + F.col("n_texts") - 1).otherwise(0),
            "unique_ratio": F.coalesce(F.try_divide("distinct_tokens", n), F.lit(0.0)),
            "max_share": F.coalesce(F.try_divide("most_common", n), F.lit(0.0)),
            "symbol_ratio": F.when(F.col("dense") > 0, (F.col("dense") - F.col("letters") - F.col("marks")) / F.col("dense")).otherwise(1.0),
            "wpm": F.when(F.col("duration") >= 90, n / (F.col("duration") / 60)),
        }
    )
    rules = flag_rules(n)
    flags = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond, _ in rules]), lambda x: x.isNotNull())
    lost = sum((F.when(cond, loss).otherwise(0) for _, cond, loss in rules), F.lit(0))
    out = out.withColumn("flags", flags).withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)))
    nothing = (F.col("n_texts") == 0) | (n == 0)
    status = F.when(nothing, "failed").when((F.size("flags") == 0) & (F.col("score") >= 70), "passed").otherwise("review_required")
    return out.withColumn("status", status)


def flag_rules(n: Column) -> list[tuple[str, Column, int]]:
    """(flag, condition, points lost): fixed thresholds."""
    repeated = (n >= 12) & (F.col("max_share") >= 0.70)
    thin = F.col("wpm") < 8
    yes = lambda c: F.coalesce(c, F.lit(False))
    return [
        ("no_recognizable_text", (F.col("n_texts") == 0) | (n == 0), 100),
        ("extreme_token_repetition", repeated, 45),
        ("low_vocabulary_diversity", ~repeated & (n >= 30) & (F.col("unique_ratio") <= 0.12), 30),
        ("symbol_or_punctuation_heavy", (F.col("text_chars") >= 30) & (F.col("symbol_ratio") >= 0.55), 35),
        ("very_low_transcript_density", yes(thin), 35),
        ("low_transcript_density", yes(~thin & (F.col("wpm") < 15)), 15),
        ("low_average_log_probability", yes(F.col("mean_avg_logprob") < -1.0), 20),
        ("high_compression_ratio", yes(F.col("mean_compression_ratio") > 2.4), 20),
        ("high_no_speech_probability", yes(F.col("mean_no_speech_prob") > 0.70), 15),
        ("uncertain_language_detection", yes(F.col("language_probability") < 0.50), 15),
    ]


def choose_source(candidates: DataFrame) -> DataFrame:
    """Of (key, kind, status, score), kind 'manual', 'automatic' or 'asr': the source to use, one row per key.

    A caption that passed wins, or a manual one that only needs review; else speech recognition, unless a caption's score is
    strictly higher. A chosen automatic caption that passed still needs review.
    """
    wins = (F.col("kind") != "asr") & ((F.col("status") == "passed") | ((F.col("kind") == "manual") & (F.col("status") == "review_required")))
    order = F.struct(wins.alias("wins"), (F.col("kind") == "manual").cast("int").alias("manual"))
    asr = F.col("kind") == "asr"
    per = candidates.groupBy("key").agg(
        F.max_by(F.when(wins, F.struct("kind", "status", "score")), order).alias("caption"),
        F.max(F.when(~asr, F.struct("score", (F.col("kind") == "manual").alias("m"), "kind", "status"))).alias("best_caption"),
        F.max(F.when(asr, F.struct("score", "kind", "status"))).alias("asr"),
    )
    better = F.col("asr").isNull() | (F.col("best_caption.score") > F.col("asr.score"))
    pick = lambda f: F.coalesce(F.col(f"caption.{f}"), F.when(better, F.col(f"best_caption.{f}")), F.col(f"asr.{f}"))
    chosen = per.select("key", pick("kind").alias("kind"), pick("status").alias("status"), pick("score").alias("score"))
    return chosen.withColumn("status", F.when((F.col("kind") == "automatic") & (F.col("status") == "passed"), "review_required").otherwise(F.col("status")))


def keep_retry(attempts: DataFrame) -> DataFrame:
    """(key, attempt, status, score) of (key, attempt 0 or 1, status, score): the second attempt where the first didn't pass and the second
    is no worse, else the first."""
    of = lambda n: F.max(F.when(F.col("attempt") == n, F.struct("attempt", "status", "score")))
    per = attempts.groupBy("key").agg(of(0).alias("a"), of(1).alias("b"))
    retry = F.col("a").isNull() | (F.col("b").isNotNull() & (F.col("a.status") != "passed") & (F.col("b.score") >= F.col("a.score")))
    return per.select("key", F.when(retry, F.col("b")).otherwise(F.col("a")).alias("x")).select("key", "x.*")


def batch_exit_code(outcomes: DataFrame) -> DataFrame:
    """(found, ok, failed, exit_code) of (ok boolean): 1 where nothing was found, 3 where any failed, else 0."""
    sums = outcomes.agg(F.count("*").alias("found"), F.count_if("ok").alias("ok"))
    failed = F.col("found") - F.col("ok")
    return sums.select("found", "ok", failed.alias("failed"), F.when(F.col("found") == 0, 1).when(failed > 0, 3).otherwise(0).alias("exit_code"))


def run_summary(statuses: DataFrame) -> DataFrame:
    """Counts over (status): processed is passed and review; with the exit code of the run."""
    n = lambda s: F.count_if(F.col("status") == s)
    sums = statuses.agg(F.count("*").alias("found"), n("passed").alias("completed"), n("review_required").alias("review"), n("skipped").alias("skipped"), n("failed").alias("failed"))
    code = F.when(F.col("failed") > 0, 1).when(F.col("review") > 0, 2).otherwise(0)
    return sums.withColumns({"processed": F.col("completed") + F.col("review"), "exit_code": code})
