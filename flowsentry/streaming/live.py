"""The live detection path as one streaming plan (T1 + T2 + T4 + T5):
flow stream -> watermarked windows -> forest scoring -> gauge publication,
polled on the detector's 5-second cadence."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from flowsentry.streaming.committed import CommittedTable
from flowsentry.streaming.score import committed_publisher, publisher, stream_score
from flowsentry.streaming.windows import POLL_TRIGGER, stream_windows


GAUGE_SCHEMA = "metric string, ts double, value double"


def start_live_detector(raw_flows: DataFrame, model: PipelineModel, t0: float, size_s: float,
                        metrics_path: str, checkpoint: str, watermark_s: float,
                        available_now: bool = False, committed: bool = False):
    """Start the query; ``available_now`` drains the input once (tests,
    back-fills), otherwise it triggers every 5 seconds.  With ``committed`` the
    gauges go into a ``CommittedTable`` at ``metrics_path`` (for runs without
    end), else into a folder per micro-batch."""
    if committed:
        publish = committed_publisher(CommittedTable(raw_flows.sparkSession, metrics_path, GAUGE_SCHEMA), size_s)
    else:
        publish = publisher(metrics_path, size_s)
    scored = stream_score(stream_windows(raw_flows, t0, size_s, watermark_s), model)
    w = scored.writeStream.foreachBatch(publish) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=POLL_TRIGGER)
    return w.start()
