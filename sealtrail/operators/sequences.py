"""Sequence and text operators over tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealtrail.functions import residue_arrays as A
from sealtrail.functions import rules as R
from sealtrail.functions import sequence as Q
from sealtrail.functions import text as X


def with_sequence(texts: DataFrame, text: str = "text", name: str = "sequence") -> DataFrame:
    return texts.withColumn(name, Q.sanitize_sequence(F.col(text)))


def peptide_stats(
    sequences: DataFrame, keep: tuple[str, ...], sequence: str = "sequence"
) -> DataFrame:
    """Statistics columns per sequence; row-wise, one pass over its letters."""
    summed = sequences.select(
        *keep, F.length(sequence).cast("long").alias("n"), A.residue_sums(sequence).alias("sums")
    )
    stats = Q.peptide_stats(F.col("n"), F.col("sums"))
    return summed.select(*keep, stats.alias("stats")).select(*keep, "stats.*")


def residue_positions(
    sequences: DataFrame, keep: tuple[str, ...], sequence: str = "sequence"
) -> DataFrame:
    """One row per residue with its 0-based position."""
    return sequences.select(
        *keep, F.posexplode(Q.residues(F.col(sequence))).alias("pos", "residue")
    )


def residue_confidence(
    sequences: DataFrame, keep: tuple[str, ...], sequence: str = "sequence"
) -> DataFrame:
    """One stand-in confidence per residue, by its class and 0-based position."""
    return sequences.select(*keep, F.posexplode(A.confidence_array(sequence)).alias("pos", "value"))


def confidence_mean(
    sequences: DataFrame, keep: tuple[str, ...], sequence: str = "sequence"
) -> DataFrame:
    """Mean confidence per sequence, whole and rounded to one decimal; 0 if empty."""
    means = sequences.select(
        *keep, A.confidence_mean(sequence).alias("mean")
    )
    return means.select(*keep, "mean", X.round_half_up(F.col("mean"), 1).alias("mean_1"))


def risk_sequence(
    sequences: DataFrame,
    keep: tuple[str, ...],
    sequence: str = "sequence",
    rules: R.RiskRules = R.RiskRules(),
) -> DataFrame:
    value = F.col(sequence)
    return sequences.select(
        *keep,
        R.risk_level(value, rules).alias("risk"),
        R.risk_assessment(value, rules).alias("assessment"),
    )


def threat_text(
    texts: DataFrame, keep: tuple[str, ...], text: str = "text", pattern: str = R.THREAT_PATTERN
) -> DataFrame:
    return texts.select(*keep, R.threat_warning(F.col(text), pattern).alias("warning"))


def text_chunks(
    texts: DataFrame,
    keep: tuple[str, ...],
    text: str = "text",
    separator: str = r"\n\n+",
    max_chars: int = 4500,
) -> DataFrame:
    """One row per chunk: chunk_no, chunk, and the text's chars and chunks."""
    body = X.js_trim(F.col(text))
    chunked = texts.select(
        *keep,
        X.utf16_length(body).alias("chars"),
        X.text_chunks(F.col(text), separator, max_chars).alias("parts"),
    )
    return chunked.select(
        *keep,
        "chars",
        F.size("parts").alias("chunks"),
        F.posexplode("parts").alias("chunk_no", "chunk"),
    )


# Turn numbers per block of a history, and at most so many runs of blocks per conversation.
HISTORY_BLOCK = 64
HISTORY_RUNS = 32


def chat_history(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "content",
    block: int = HISTORY_BLOCK,
    most_runs: int = HISTORY_RUNS,
    chars: str | None = None,
) -> DataFrame:
    """For each human turn, the earlier turns of its conversation as lines.

    Turns fall into blocks of ``block`` turn numbers, and the blocks of a conversation into at
    most ``most_runs`` runs of about as many blocks.  Each run's text goes once to every later
    run of its conversation; a turn adds the lines before it in its own run.  So a long
    conversation is dealt over tasks by (conversation, run), what moves is at most
    ``most_runs`` copies of the input, and no text passes through the driver.  The result
    itself grows with the square of a conversation's length, as every row holds all earlier
    turns; a task makes one such row after the other.

    A null turn number comes first.  Turns without text leave no line.
    """
    speaker = F.when(F.col(role) == "human", F.lit("user")).otherwise(F.col(role))
    entry = F.struct(F.col(turn).alias("turn"), speaker.alias("role"), F.col(content).alias("content"))
    number = F.coalesce(F.floor(F.col(turn) / block).cast("long"), F.lit(-(1 << 62)))
    # Inside a struct, a null conversation joins like any other.
    key = F.struct(F.col(conversation).alias("conversation")).alias("_key")
    numbered = turns.select(key, number.alias("_block"), entry.alias("entry"))
    places = (
        numbered.groupBy("_key")
        .agg(F.sort_array(F.collect_set("_block")).alias("known"))
        .select("_key", F.size("known").cast("long").alias("_blocks"), F.posexplode("known").alias("_at", "_block"))
    )
    runs = F.least("_blocks", F.lit(most_runs).cast("long"))
    run = F.floor(F.col("_at") * runs / F.col("_blocks")).cast("long")
    # As a merge join, which sends neither side through the driver whatever its size is taken for.
    own = (
        numbered.join(places.select("_key", "_block", runs.alias("_runs"), run.alias("_from")).hint("merge"), ["_key", "_block"])
        .groupBy("_key", "_runs", "_from")
        .agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    )
    # Text and lines are made once per run, before the row is exploded: beside it, they would be made for each copy.
    texts = own.withColumn("text", X.history_lines(F.col("entries")))
    sent = texts.select("_key", "_from", "_runs", "entries", "text", F.explode(F.sequence("_from", F.col("_runs") - 1)).alias("_run"))
    at_home = F.col("_run") == F.col("_from")
    # Few and heavy groups: as the number of tasks is given, they are not put together by their bytes.
    tasks = 8 * turns.sparkSession.sparkContext.defaultParallelism
    pair = F.least("_run", F.col("_runs") - 1 - F.col("_run"))
    task = F.pmod(F.pmod(F.xxhash64("_key"), F.lit(tasks)) + pair, F.lit(tasks)).cast("int")
    parts = sent.select(
        "_key", "_run", "_from", task.alias("_task"),
        F.when(at_home, F.col("entries")).alias("entries"), F.when(~at_home, F.col("text")).alias("text"),
    )
    told = (
        parts.repartitionById(tasks, F.col("_task"))
        .groupBy("_task", "_key", "_run")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("_from", "text")))).alias("before"),
            F.first("entries", ignorenulls=True).alias("entries"),
        )
        .select("_key", "entries", F.col("before")["text"].alias("before"), X.turn_lines(F.col("entries")).alias("lines"))
    )
    counted = [] if chars is None else [X.joined_length(F.col("before")).alias("_chars")]
    told = told.select("*", *counted).select(
        "_key", "before", "lines", *counted and ["_chars"], F.posexplode("entries").alias("at", "entry")
    )
    told = told.where(F.col("entry")["role"] == "user")
    lines = F.slice("lines", F.lit(1), F.col("at"))
    columns = [
        F.col("_key")["conversation"].alias(conversation),
        F.col("entry")["turn"].alias(turn),
        F.col("entry")["content"].alias("message"),
        F.concat_ws("\n", "before", lines).alias("history"),
    ]
    if chars is not None:
        # No line is empty, so both sides have a text or none.
        own = F.length(F.concat_ws("\n", lines)).cast("long")
        between = ((F.col("_chars") > 0) & (own > 0)).cast("long")
        columns.append((F.col("_chars") + own + between).alias(chars))
    return told.select(*columns)


def prompts(history: DataFrame, keep: tuple[str, ...], system_text: Column) -> DataFrame:
    return history.select(
        *keep,
        X.prompt_text(system_text, F.col("history"), F.col("message")).alias("prompt"),
    )


def coefficient_sums(sequences: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """Per-sequence sums of residue coefficients, in whole hundredths.

    The coefficient table has one row per residue letter, so it is broadcast;
    letters outside it count 0.
    """
    scales = [Q.hundredths(s) for s in Q.SCALES.values()]
    table = sequences.sparkSession.createDataFrame(
        [(letter, *[s[letter] for s in scales]) for letter in scales[0]],
        "residue string, hydropathy int, helix int, sheet int",
    )
    # Without residues a sequence keeps one row, which counts 0.
    letters = sequences.select(key, F.explode_outer(Q.residues(F.col(sequence))).alias("residue"))
    found = letters.join(F.broadcast(table), "residue", "left")
    return found.groupBy(key).agg(
        *[F.sum(F.coalesce(F.col(n), F.lit(0))).alias(f"{n}_sum") for n in Q.SCALES]
    )
