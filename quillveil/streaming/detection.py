"""Detection on streams of documents: entities once each, counts over time, progress, and restarts from where a run ended."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..config import DetectionConfig
from ..operators.detect import detect
from ..operators.review import config_filter

#: How much later than the latest row a row may be, and the length of a window.
LATE, WINDOW = "10 minutes", "5 minutes"


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a folder that grows, each read once."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)


def stamped(docs: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Documents whose time (`ts`) drives the stream's, whether anything is found in them or not: rows later than `late` don't count in what follows."""
    return docs.withWatermark(ts, late)


def entities(docs: DataFrame, text: str = "text", config: DetectionConfig | None = None, words=(), **options) -> DataFrame:
    """Entities of a stream of documents; without state, since all is found within a row."""
    return config_filter(detect(docs, text, config, words, **options), config or DetectionConfig())


def once(found: DataFrame, keys: Sequence[str] = ("doc_id", "entity_type", "text", "text_index")) -> DataFrame:
    """Rows of `stamped` documents, those of equal keys once: a document that comes again within the lateness allowed is dropped by what is remembered of it, one that comes later by its time."""
    return found.dropDuplicatesWithinWatermark(list(keys))


def counts(found: DataFrame, ts: str = "ts", window: str = WINDOW, late: str | None = LATE) -> DataFrame:
    """Entities by type and window; rows later than `late` are left out (None: the documents are `stamped`). A window comes when no row of it can come any more."""
    rows = found.withWatermark(ts, late) if late else found
    return rows.groupBy(F.window(ts, window), "entity_type").agg(F.count("*").alias("n"))


def started(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What is there now, written as Parquet exactly once. With the checkpoint of a run that ended or broke off it goes on there."""
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """What each batch of a session's queries read, held as state and dropped as late; errors with which queries ended."""

    def __init__(self):
        self.batches: list[dict] = []
        self.errors: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        state = p.get("stateOperators", [])
        self.batches.append({
            "run": p["runId"], "batch": p["batchId"], "rows": p["numInputRows"], "ms": p.get("batchDuration"), "watermark": p.get("eventTime", {}).get("watermark"),
            "state_rows": sum(s["numRowsTotal"] for s in state), "late_rows": sum(s.get("numRowsDroppedByWatermark", 0) for s in state),
        })

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.errors[str(event.runId)] = event.exception

    def total(self, name: str) -> int:
        return sum(b[name] for b in self.batches)
