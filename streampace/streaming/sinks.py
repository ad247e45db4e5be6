"""Sinks and triggers of streaming queries, and report files."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from streampace.operators.forecast import to_wide

# Fixed trigger intervals by mode name; an unknown mode gets the default.
MODE_TRIGGERS = {
    "fixed_500ms": "500 milliseconds",
    "fixed_2s": "2 seconds",
    "fixed_5s": "5 seconds",
    "adaptive": "2 seconds",
}
DEFAULT_TRIGGER = "2 seconds"
OUTPUT_MODES = ("append", "complete", "update")


def trigger_for(mode: str) -> str:
    return MODE_TRIGGERS.get(mode, DEFAULT_TRIGGER)


def writer(df: DataFrame, mode: str = "append", trigger: str | None = None,
           checkpoint: str | None = None, name: str | None = None) -> DataStreamWriter:
    """A stream writer. ``trigger`` is an interval, or ``"available"`` to read what is there and stop."""
    if mode not in OUTPUT_MODES:
        raise ValueError(f"output mode {mode!r} is none of {OUTPUT_MODES}")
    out = df.writeStream.outputMode(mode)
    if trigger == "available":
        out = out.trigger(availableNow=True)
    elif trigger:
        out = out.trigger(processingTime=trigger)
    if checkpoint:
        out = out.option("checkpointLocation", checkpoint)
    return out.queryName(name) if name else out


def to_console(df: DataFrame, mode: str = "append", trigger: str | None = "1 second",
               rows: int = 20, truncate: bool = False, **options: Any) -> StreamingQuery:
    return writer(df, mode, trigger, **options).format("console").option(
        "truncate", str(truncate).lower()).option("numRows", rows).start()


def to_memory(df: DataFrame, name: str, mode: str = "append",
              trigger: str | None = None, **options: Any) -> StreamingQuery:
    """Results as an in-memory table of the driver: for small reports and tests."""
    return writer(df, mode, trigger, name=name, **options).format("memory").start()


def to_json(df: DataFrame, path: str, checkpoint: str,
            trigger: str | None = DEFAULT_TRIGGER) -> StreamingQuery:
    return writer(df, "append", trigger, checkpoint).format("json").option("path", path).start()


def to_parquet(df: DataFrame, path: str, checkpoint: str,
               trigger: str | None = DEFAULT_TRIGGER) -> StreamingQuery:
    return writer(df, "append", trigger, checkpoint).format("parquet").option("path", path).start()


def write_predictions_csv(scored: DataFrame, path: str, models: Sequence[str]) -> None:
    """One CSV row per series step with each model's prediction, absolute and percentage error."""
    to_wide(scored, models).write.mode("overwrite").option("header", True).csv(path)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """A benchmark summary ``(approach, elapsed_sec, exit_code, stdout_lines)``: a row per approach."""
    summary.select("approach", "elapsed_sec", "exit_code", "stdout_lines").coalesce(1).write.mode(
        "overwrite").option("header", True).csv(path)
