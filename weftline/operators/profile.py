"""Self-time of nested profile events. events: thread, event_id, label, start_ns, end_ns; path as well, if events have symbols."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IN = ["thread", "event_id", "label", "start_ns", "end_ns"]


def _nest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by thread, in order of (start, longest first). The parent is the innermost event that contains the whole event and ends after its start.

    Ends fall from the bottom of the stack to its top. An event that ends before a later one does, or by its start, can contain
    none from there on: it leaves, and its self-time is known. So each event is pushed and popped once, and only open ones are held.
    An event without thread, id, start or end is alone.
    """
    thread, stack, done = None, [], []  # rows: thread, event_id, label, parent_id, self_ns, path, end_ns

    def rows(schema: pa.Schema) -> pa.RecordBatch:
        made = [("thread", schema.field("thread").type, 0), ("event_id", pa.int64(), 1), ("label", pa.string(), 2), ("parent_id", pa.int64(), 3), ("self_ns", pa.int64(), 4), ("path", pa.string(), 5)]
        columns = list(zip(*done)) or [()] * 7
        columns[4] = [max(0, x) for x in columns[4]]
        done.clear()
        made = made if "path" in schema.names else made[:-1]
        return pa.RecordBatch.from_arrays([pa.array(columns[k], kind) for _, kind, k in made], [name for name, _, _ in made])

    schema = None
    for batch in batches:
        schema = batch.schema
        columns = [batch.column(c).to_pylist() for c in IN]
        paths = batch.column("path").to_pylist() if "path" in schema.names else [None] * len(batch)
        for t, i, label, s, e, path in zip(*columns, paths):
            if s is None or e is None or t is None or i is None:
                done.append([t, i, label, None, 0 if s is None or e is None else e - s, path, e])
                continue
            if t != thread:
                done += stack
                stack.clear()
                thread = t
            while stack and (stack[-1][6] < e or stack[-1][6] <= s):
                done.append(stack.pop())
            parent = None
            if stack:
                around = stack[-1]
                parent = around[1]
                around[4] -= e - s
                path = around[5] if path is None else path
            stack.append([t, i, label, parent, e - s, path, e])
        yield rows(schema)
    if stack:
        done += stack
        yield rows(schema)


def self_times(events: DataFrame) -> DataFrame:
    """thread, event_id, label, parent_id, self_ns: duration less that of the direct children, 0 at least. If events have a path, also path: their own, else that of the nearest event around them.

    Threads are sorted and read as a stream; none is held as a whole.
    """
    kinds = dict(events.dtypes)
    columns, path = (IN + ["path"], ", path string") if "path" in kinds else (IN, "")
    order = events.select(*columns).repartition("thread").sortWithinPartitions("thread", "start_ns", F.desc("end_ns"), "event_id")
    return order.mapInArrow(_nest, f"thread {kinds['thread']}, event_id long, label string, parent_id long, self_ns long{path}")


def wall(events: DataFrame, times: DataFrame) -> DataFrame:
    """thread, wall_ns: from the first start to the last end, less the self-time of self_profile_ events."""
    own = times.groupBy("thread").agg(F.sum(F.when(F.startswith("label", F.lit("self_profile_")), F.col("self_ns")).otherwise(0)).alias("own"))
    span = events.groupBy("thread").agg((F.max("end_ns") - F.min("start_ns")).alias("span"))
    return span.join(own, "thread").select("thread", F.greatest(F.col("span") - F.col("own"), F.lit(0)).alias("wall_ns"))
