"""python -m tidewright CONFIG: the cover of a table after each increment, written or compared with what is expected."""

from __future__ import annotations

import sys
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewright.operators.compare import compare
from tidewright.operators.engine import OdEngine
from tidewright.operators.timeline import State, insert_stepwise
from tidewright.operators.violations import delete_by_value
from tidewright.sources.sinks import append_stats, result_path, write_final, write_ods, write_text
from tidewright.sources.tables import Config, load_config, numbered, read_changes, read_ods, start_of


def run(spark: SparkSession, config: Config) -> list[dict]:
    """Runs a configuration; a row of statistics for each phase, or, where statistics are written, for sampled prefixes of inserts too.

    The statistics of deletes go to a file of their own, beside that of the others.
    """
    table, names, ods, free = start_of(spark, config)
    empty = spark.createDataFrame([], "_tid long, " + ", ".join(f"`{n}` long" for n in names))
    began = time.time()
    engine = OdEngine(empty if table is None else table, names, ods)
    stats: list[dict] = []

    def done(phase: str, expected: str | None, source: str, states: Sequence[State] = ()) -> None:
        nonlocal began
        found, path = engine.ods(), result_path(config.output, source, phase)
        elapsed = round(1000 * (time.time() - began))
        if expected:
            write_text(compare(found, read_ods(spark, expected, names)).report(names), path)
        else:
            write_ods(found, names, path)
        for state in states[:-1]:  # the batch is judged whole, so its prefixes have a share of its time
            stats.append({"phase": phase} | engine.statistics(state.operations, elapsed * state.operations // states[-1].operations, state.ods, state.non_ods, state.highest_id))
        stats.append({"phase": phase} | engine.statistics(states[-1].operations if states else 0, elapsed))
        began = time.time()

    done("initial", None if table is None else config.expected_initial, config.initial or "table")
    wanted = dict(enumerate(config.expected_increments))
    if config.deletion_mode != "deleteonly":
        for i, path in enumerate(config.increments):
            changes, states = read_changes(spark, path, config.csv), []
            if config.csv.can_have_deletions:
                engine.apply(changes)
            else:
                rows, free = numbered(changes, names, free)
                if config.stats_path:
                    states = insert_stepwise(engine, rows, F.col("_tid"))
                else:
                    engine.insert(rows)
            done(f"increment_{i}", wanted.get(i), path, states)
    if config.deletion_mode != "none":
        for i in reversed(range(len(config.increments))):
            gone = read_changes(spark, config.increments[i], config.csv).select(*names)
            engine.delete(delete_by_value(engine.rows, gone, names, "_tid"))
            done(f"delete_{i}", wanted.get(i - 1) if i else config.expected_initial, config.increments[i])
    if config.stats_path:
        for rows, path in (([s for s in stats if not s["phase"].startswith("delete")], config.stats_path), ([s for s in stats if s["phase"].startswith("delete")], f"{config.stats_path}_delete")):
            append_stats(spark, rows, path)
    write_final(engine.rows, result_path(config.output, "final", "data"))
    return stats


if __name__ == "__main__":
    session = SparkSession.builder.appName("tidewright").getOrCreate()
    for row in run(session, load_config(sys.argv[1])):
        print(row)
