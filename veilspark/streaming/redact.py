"""Redaction of chunked streams, as a batch over stored chunks and as a stateful streaming query.

Rows are chunks: a stream id, a sequence number, the chunk, and whether the row closes the stream (its
chunk is then ignored). Rows of a stream are taken in order of their sequence number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from itertools import takewhile

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..codes import REPORT
from ..options import Options, Profile
from .machines import HELD, MACHINES

OUTPUT = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("content", T.StringType()),
        T.StructField("final", T.BooleanType()),
        T.StructField("retained_code_units", T.LongType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("report", REPORT),
    ]
)


def _columns(frame: DataFrame, stream: str, seq: str, chunk: str, close: str) -> DataFrame:
    return frame.select(F.col(stream).cast("string").alias("stream_id"), F.col(seq).cast("long").alias("seq"), F.col(chunk).cast("string").alias("chunk"), F.coalesce(F.col(close).cast("boolean"), F.lit(False)).alias("close"))


def _step(machine, stream_id: str, seq: int, chunk: str | None, close: bool) -> dict:
    row = machine.close() if close else machine.push(chunk)
    return {"stream_id": stream_id, "seq": seq, "ok": row["ok"], "content": row["content"], "final": row["final"], "retained_code_units": row["retained"], "error_code": row["error"]["code"] if row["error"] else None, "report": row["report"]}


def redact_stored_streams(frame: DataFrame, kind: str = "rolling", policy: Options | Profile | Mapping | None = None, stream: str = "stream_id", seq: str = "seq", chunk: str = "chunk", close: str = "is_close") -> DataFrame:
    """One result row per chunk. A stream is read in order, chunk by chunk, and never held as a whole."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(OUTPUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, machine = None, None
        for batch in batches:
            ids, numbers, texts, ends = (c.to_pylist() for c in batch.columns)
            columns: list[list] = [[] for _ in schema]  # the last for places in reports
            known: dict[int, int] = {}
            reports, kept = [], []

            def place(report: dict, known=known, reports=reports, kept=kept) -> int:
                if id(report) not in known:  # chunks that are only held share one report
                    known[id(report)] = len(reports)
                    reports.append(report | {"counts_by_reason": list(report["counts_by_reason"].items())})  # Arrow takes maps as pairs
                    kept.append(report)  # keeps its id taken
                return known[id(report)]

            k = 0
            while k < len(ids):
                if machine is None or ids[k] != at:
                    at, machine = ids[k], MACHINES[kind](policy)
                retained = machine.hold(texts[i] for i in takewhile(lambda i, at=at: ids[i] == at and not ends[i], range(k, len(ids))))
                if n := len(retained):
                    parts = [ids[k : k + n], numbers[k : k + n], [HELD["ok"]] * n, [HELD["content"]] * n, [HELD["final"]] * n, retained, [None] * n, [place(HELD["report"])] * n]
                else:
                    n, row = 1, _step(machine, ids[k], numbers[k], texts[k], ends[k])
                    parts = [[place(row["report"]) if f.name == "report" else row[f.name]] for f in schema]
                for column, part in zip(columns, parts, strict=True):
                    column += part
                k += n
            found = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=False) if f.name != "report"]
            yield pa.RecordBatch.from_arrays([*found, pa.array(reports, schema.field("report").type).take(pa.array(columns[-1], pa.int32()))], schema=schema)

    ordered = _columns(frame, stream, seq, chunk, close).repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return ordered.mapInArrow(run, OUTPUT)


FLAT = "stream_id string, seq bigint, ok boolean, content string, final boolean, retained_code_units bigint, error_code string, report_json string"


def redact_live_streams(frame: DataFrame, kind: str = "rolling", policy: Options | Profile | Mapping | None = None, stream: str = "stream_id", seq: str = "seq", chunk: str = "chunk", close: str = "is_close", idle: str | None = None) -> DataFrame:
    """The same as a streaming query (append mode); the report comes as JSON.

    State by stream: the buffer, the budgets and the last sequence number. A chunk whose number is not above the
    last one came late or again and fails the stream. ``idle`` (such as "10 minutes") closes streams in silence.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(store.get[0]) if store.exists else None
        machine = MACHINES[kind](policy, known["machine"] if known else None)
        last = known["last"] if known else None
        rows = []
        if store.hasTimedOut:
            rows.append(_step(machine, key[0], (last or 0) + 1, None, True))
            store.remove()
        else:
            for row in pd.concat(list(frames)).sort_values("seq").itertuples():
                if last is not None and row.seq <= last and not machine.state["failed"]:
                    machine.fail("stream_closed")
                last = max(row.seq, last if last is not None else row.seq)
                rows.append(_step(machine, key[0], row.seq, row.chunk, bool(row.close)))
            store.update((json.dumps({"machine": machine.state, "last": int(last)}),))
            if idle:
                store.setTimeoutDuration(idle)
        for r in rows:
            r["report_json"] = json.dumps(r.pop("report"))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in FLAT.split(", ")])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return _columns(frame, stream, seq, chunk, close).groupBy("stream_id").applyInPandasWithState(run, FLAT, "state string", "append", timeout)
