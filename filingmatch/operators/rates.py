"""Trailing-window counts and rate-limit admission over an event log."""

from __future__ import annotations

import heapq
import itertools
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..session import durable, shared_folder
from .skew import salted_join

WINDOW_SECONDS = 900
KEEP_SECONDS = 86_400
#: Rows of a slice of time that one task folds.
SLICE_ROWS = 500_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def trailing_counts(events: DataFrame, key: str, ts: str, seconds: int = WINDOW_SECONDS, name: str = "n") -> DataFrame:
    """Adds how many events of the key lie in the window that ends at each event (open at its far end).

    A key is cut into buckets one window long; an event counts from its instant on and, in the next bucket, until it is a window old. So a
    key that owns a third of all events is spread over as many tasks as it has buckets, and a count is a running sum, however many events a
    window holds.
    """
    span = seconds * 1_000_000
    placed = events.withColumn("_us", micros(ts)).withColumn("_own", F.floor(F.col("_us") / span))
    steps = [F.struct((F.col("_own") + i).alias("bucket"), (F.col("_us") + i * span).alias("at"), F.lit(1 - 2 * i).alias("step")) for i in (0, 1)]
    both = placed.withColumn("_s", F.explode(F.array(*steps))).withColumn("_bucket", F.col("_s.bucket"))
    w = Window.partitionBy(key, "_bucket").orderBy("_s.at")
    earlier = F.count_if(F.col("_s.step") < 0).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    counted = both.withColumn(name, earlier + F.sum("_s.step").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return counted.where("_bucket = _own").drop("_us", "_own", "_bucket", "_s")


def kept(events: DataFrame, ts: str, now: Column, seconds: int = KEEP_SECONDS) -> DataFrame:
    """Events that are not older than a day."""
    return events.where(micros(ts) >= F.unix_micros(now) - seconds * 1_000_000)


def _bursts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Adds `n` (trailing count) and `_burst`: the running number of the burst of its key an event belongs to. A burst starts
    where nothing of the key happened for a whole window, so bursts do not influence each other. The number is summed inside
    buckets and shifted by the bursts of earlier buckets: no task sees a whole key."""
    span = seconds * 1_000_000
    counted = trailing_counts(events, key, ts, seconds).withColumn("_us", micros(ts)).withColumn("_b", F.floor(F.col("_us") / span))
    counted = counted.withColumn("_start", (F.col("n") == 1).cast("long"))
    per_bucket = counted.groupBy(key, "_b").agg(F.sum("_start").alias("_starts"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_bucket.select(key, "_b", F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("_inside", F.sum("_start").over(inside)).join(shift, [key, "_b"]).withColumn("_burst", F.col("_shift") + F.col("_inside"))


def admitted(events: DataFrame, key: str, ts: str, event_id: str, limit: int, seconds: int = WINDOW_SECONDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds `admitted`: an event passes while fewer than `limit` admitted events of its key lie in the window before it; a refused
    one leaves no trace. Events of one key at one instant are taken in id order.

    Bursts that never exceed the limit pass as a whole without any fold. The others are folded in slices of time (`_folded`), so a burst of
    one hot key is many tasks.
    """
    marked = (_bursts(events, key, ts, seconds)
              .withColumn("_group", F.concat_ws("|", F.col(key).cast("string"), F.col("_burst").cast("string"))))
    tight = marked.groupBy("_group").agg(F.max("n").alias("_most")).where(F.col("_most") > limit).select("_group", F.lit(True).alias("_tight"))
    flagged = durable(salted_join(marked, tight, "_group", event_id, how="left"))
    columns = events.columns
    free = flagged.where(F.col("_tight").isNull()).select(*columns, F.lit(True).alias("admitted"))
    contested = flagged.where(F.col("_tight"))
    verdicts = _folded(contested.select(F.col(event_id).alias("_id"), F.array("_group").alias("_keys"), "_us"), lambda k: limit, seconds, slice_rows)
    return free.unionByName(contested.select(*columns).join(verdicts.withColumnRenamed("_id", event_id), event_id))


def _fold_slice(us: np.ndarray, keys: pa.ListArray, start: list[dict], limit_of: Callable[[str], int], span: int) -> tuple[np.ndarray, list[dict]]:
    """Which rows of one slice pass, in its order, and the state it leaves.

    Rows wait in one line per value of the key position with the fewest values. The first rows of the lines are judged in the order of the log;
    a line whose key is at its limit goes on with the first row for which the key has room again, and all rows between are refused.
    """
    coded = keys.flatten().dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    at = np.r_[0, np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False))]
    place = {k: i for i, k in enumerate(names)}
    queues: list[deque] = [deque() for _ in names]
    others: dict[str, list[int]] = {}
    for x in start:
        (queues[place[x["key"]]] if x["key"] in place else others.setdefault(x["key"], [])).append(x["us"])
    limits = [limit_of(k) for k in names]
    passed = np.diff(at) == 0                                   # a row without keys
    keyed = np.flatnonzero(~passed)
    if len(keyed):
        width = int(np.diff(at)[keyed].min())
        line = min((codes[at[keyed] + i] for i in range(width)), key=lambda c: len(np.unique(c)))
        order = np.argsort(line, kind="stable")
        rows, line = keyed[order], line[order]
        when = us[rows]
        cuts = np.r_[0, np.flatnonzero(np.diff(line)) + 1, len(line)].tolist()
        heap: list[tuple[int, int, int, int]] = []

        def wait(key: int, i: int, stop: int) -> None:
            q, limit = queues[key], limits[key]
            if limit > 0 and i < stop:
                if len(q) >= limit and when[i] < (free := q[len(q) - limit] + span):
                    i += int(np.searchsorted(when[i:stop], free))
                if i < stop:
                    heapq.heappush(heap, (int(rows[i]), key, i, stop))

        for i, stop in zip(cuts, cuts[1:]):
            wait(int(line[i]), i, stop)
        while heap:
            row, key, i, stop = heapq.heappop(heap)
            t, mine, free = int(us[row]), codes[at[row]:at[row + 1]].tolist(), True
            for k in mine:
                q = queues[k]
                while q and q[0] <= t - span:
                    q.popleft()
                free = free and len(q) < limits[k]
            if free:
                passed[row] = True
                for k in mine:
                    queues[k].append(t)
            wait(key, i + 1, stop)
    last = int(us[-1])
    left = {**others, **{k: queues[i] for k, i in place.items()}}
    return passed, [{"key": k, "us": t} for k in sorted(left) for t in left[k] if t > last - span]


def _folded(rows: DataFrame, limit_of: Callable[[str], int], seconds: int, slice_rows: int) -> DataFrame:
    """(_id, admitted) of rows (_id, _keys, _us): in order of time, then id, a row passes while each of its keys is under its limit
    among the passed rows of the window before it.

    The log is cut into slices of time, each folded by itself from the state that the slice before it leaves: the instants still in
    the window, at most the limit per key. That state is not known at first, so rounds repeat: all slices start from nothing, then every slice
    whose incoming state turns out to be another one is folded again, until none is. The first k slices are final after k rounds at the
    latest; as a state forgets what is older than a window, the rounds are few unless a window holds very many events. Then states hardly
    ever agree and all later slices would be folded in vain in every round: a round takes half as many slices as the one before when
    that one left another change inside its reach, and twice as many when it did not. A round reads and writes only what it folds, and a slice
    is final in the last round that folded it. No task sees more than one slice at a time.
    """
    spark = rows.sparkSession
    span = seconds * 1_000_000
    parts = max(1, -(-rows.count() // slice_rows))
    dealt = durable(rows.repartitionByRange(parts, "_us", "_id").withColumn("_slice", F.spark_partition_id()))
    kind = dealt.schema["_id"].dataType.simpleString()
    state = "array<struct<key: string, us: long>>"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, start = None, [], None

        def judged() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            keys, us = (x.chunk(0) if isinstance(x := whole.column(c).combine_chunks(), pa.ChunkedArray) else x for c in ("_keys", "_us"))
            if us.null_count or keys.null_count or keys.flatten().null_count:
                raise ValueError("an event to be admitted needs an instant, and keys that are not null")
            passed, left = _fold_slice(us.to_numpy(), keys, start or [], limit_of, span)
            n = whole.num_rows
            ids = whole.column("_id").combine_chunks()
            yield from pa.Table.from_arrays([ids, pa.array(np.full(n, current), pa.int32()), pa.array(passed), pa.nulls(n, arrow[3].type)], schema=arrow).to_batches(10_000)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, arrow[0].type), pa.array([current], pa.int32()), pa.array([None], pa.bool_()), pa.array([left], arrow[3].type)], schema=arrow)

        for b in batches:
            slices = b.column(b.schema.get_field_index("_slice")).to_numpy()
            for i, stop in itertools.pairwise([0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(slices)]):
                if i == stop:
                    continue
                if slices[i] != current:
                    if held:
                        yield from judged()
                    current, held, start = int(slices[i]), [], b.column(b.schema.get_field_index("_start"))[i].as_py()
                held.append(b.select(["_id", "_keys", "_us"]).slice(i, stop - i))
        if held:
            yield from judged()

    schema = f"_id {kind}, _slice int, admitted boolean, _end {state}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    made = shared_folder(spark, "folded")
    starts = durable(dealt.select("_slice").distinct().select("_slice", F.lit(None).cast(state).alias("_start")))
    ends, final, turn, reach = None, {}, 0, parts
    while True:
        now = sorted(r[0] for r in starts.select("_slice").collect())          # one number per slice
        todo = dealt.where(F.col("_slice").isin(now)).join(F.broadcast(starts), "_slice")
        ordered = todo.repartition(4 * len(now) + 1, "_slice").sortWithinPartitions("_slice", "_us", "_id")
        ordered.select("_id", "_keys", "_us", "_slice", "_start").mapInArrow(fold, schema).write.parquet(f"{made}/_turn={turn}")
        final |= dict.fromkeys(now, turn)
        new_ends = (spark.read.schema(schema).parquet(f"{made}/_turn={turn}").where("_end is not null").select("_slice", "_end")
                    .join(F.broadcast(starts), "_slice").select("_slice", "_start", "_end"))
        ends = durable(new_ends if ends is None else ends.where(~F.col("_slice").isin(now)).unionByName(new_ends))
        order = Window.orderBy("_slice")                                        # one row per slice
        changed = ends.select("_slice", "_start", F.lag("_end").over(order).alias("_given")).where(
            F.coalesce("_start", F.array().cast(state)) != F.coalesce("_given", F.array().cast(state)))
        if turn:
            first = changed.agg(F.min("_slice")).first()[0]
            reach = 2 * reach if first is None or first > now[-1] else max(1, len(now) // 2)
        starts = durable(changed.orderBy("_slice").limit(reach).select("_slice", F.col("_given").alias("_start")))
        if parts == 1 or starts.isEmpty():
            break
        turn += 1
    kept = spark.createDataFrame(list(final.items()), "_slice int, _turn int")
    every = spark.read.schema(f"{schema}, _turn int").parquet(made).where("_id is not null")
    return every.join(F.broadcast(kept), ["_slice", "_turn"]).select("_id", "admitted")


def released(events: DataFrame, returned: DataFrame, event_id: str) -> DataFrame:
    """The log without reservations that were given back; judged again, they leave room for others."""
    return events.join(returned.select(event_id), event_id, "left_anti")


def reserved(events: DataFrame, keys: str, ts: str, event_id: str, limits: dict[str, int], seconds: int = WINDOW_SECONDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Admission against several keys at once: an event passes only while every one of its keys (array of `kind:value`) is under the
    limit of its kind, and then counts against all of them. Keys meet in events, so order decides among all of them: the log is folded in
    slices of time until their states agree (`_folded`)."""
    rows = events.select(F.col(event_id).alias("_id"), F.col(keys).alias("_keys"), micros(ts).alias("_us"))
    verdicts = _folded(rows, lambda k: limits[k.split(":", 1)[0]], seconds, slice_rows)
    return events.join(verdicts.withColumnRenamed("_id", event_id), event_id)
