"""Ordered stateful processing: rows of a key in ``seq`` order, gaps held back.

A micro-batch may bring rows of a key in any order and with holes.  Rows that
continue the key's sequence are handled at once, as one frame; rows behind a hole
wait in the state.  Replayed rows (below the next expected number) are ignored, so
a source that sends a row twice changes nothing.

What waits is a map of small blocks (``BLOCK`` order numbers each).  A micro-batch writes
the blocks its own rows fall into and reads those the sequence runs through, so while a
hole stays open the state written grows with the rows that arrive, not with those that wait, and no
value of the state holds more than a block.  The state lies in RocksDB, on disk.

With a timeout a silent key is finished by a timer.  The holes that it passes over are kept
as ranges: a row that arrives for one later on is given out as a late row, once.

A key is one recorder, whose own rate is fixed; what reaches a task at once is
bounded by the source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``step(state, rows)``: the new state and the output columns for a run of rows in order.
Step = Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame | None]]
#: ``close(state)``: the state an idle key goes on with, and its last output.
Close = Callable[[tuple], tuple[tuple, pd.DataFrame | None]]

#: Order numbers of one value of waiting rows.
BLOCK = 64
#: The order number of a late row; NULL in all other rows of a stream with a timeout.
LATE = "late"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata(None)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


class InOrder(StatefulProcessor):
    """The fold of one stream; ``idle_ms`` None means that keys are never finished."""

    def __init__(
        self,
        order: str,
        columns: list[str],
        state: T.StructType,
        initial: tuple,
        names: list[str],
        step: Step,
        what: str,
        close: Close | None,
        idle_ms: int | None,
    ):
        self.order, self.columns, self.state, self.initial = order, columns, state, initial
        self.names, self.step, self.what, self.close_key, self.idle_ms = names, step, what, close, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        own = [T.StructField(n, T.LongType()) for n in ("expected", "n_blocks", "last_seen", "timer")]
        self.handle = handle
        self.counters = handle.getValueState("counters", T.StructType([*own, *self.state.fields]))
        self.waiting = handle.getMapState("waiting", "block bigint", "packed binary")
        self.passed = handle.getMapState("passed", "first bigint", "upto bigint")

    def _load(self) -> tuple[list[int], tuple]:
        held = self.counters.get() or (0, 0, 0, 0, *self.initial)
        return list(held[:4]), tuple(held[4:])

    def _give(self, key: tuple, frame: pd.DataFrame | None, keys: list[str], error: str | None = None) -> Iterator[pd.DataFrame]:
        if frame is not None and len(frame):
            frame = frame.assign(**dict(zip(keys, key, strict=True)), error=error)
            if LATE in self.names and LATE not in frame:
                frame[LATE] = None
            missing = [n for n in self.names if n not in frame]
            yield (frame.assign(**dict.fromkeys(missing)) if missing else frame)[self.names]

    def _held(self, block: int) -> pd.DataFrame:
        return _unpack(self.waiting.getValue((block,))[0])

    def _late(self, numbers: np.ndarray) -> list[int]:
        """Of numbers below the expected one those of holes that were passed over, each given once."""
        found = []
        for number in sorted(set(numbers.tolist())):
            for (first,), (upto,) in list(self.passed.iterator()):
                if first <= number < upto:
                    self.passed.removeKey((first,))
                    if first < number:
                        self.passed.updateValue((first,), (number,))
                    if number + 1 < upto:
                        self.passed.updateValue((number + 1,), (upto,))
                    found.append(number)
                    break
        return found

    def _hold(self, rows: pd.DataFrame, n_blocks: int) -> int:
        """Add waiting rows to their blocks; gives the number of blocks."""
        for block, part in rows.groupby(rows[self.order] // BLOCK):
            block = int(block)
            if n_blocks and self.waiting.containsKey((block,)):
                part = pd.concat([self._held(block), part]).drop_duplicates(self.order, keep="last")
            else:
                n_blocks += 1
            self.waiting.updateValue((block,), (_pack(part),))
        return n_blocks

    def _ready(self, rows: pd.DataFrame, expected: int, n_blocks: int) -> tuple[list[pd.DataFrame], pd.DataFrame, int, int]:
        """Runs of rows that continue the sequence, new ones and those that waited; the rest; the next number."""
        runs = []
        while True:
            rows = rows[rows[self.order] >= expected]
            numbers = rows[self.order].to_numpy()
            n = int((numbers == expected + np.arange(len(numbers))).cumprod().sum())
            if n:
                runs.append(rows.iloc[:n])
                rows, expected = rows.iloc[n:], expected + n
            block = expected // BLOCK
            if not n_blocks or not self.waiting.containsKey((block,)):
                return runs, rows, expected, n_blocks
            held = self._held(block).sort_values(self.order, ignore_index=True)
            held = held[held[self.order] >= expected]
            numbers = held[self.order].to_numpy()
            n = int((numbers == expected + np.arange(len(numbers))).cumprod().sum())
            if n:
                runs.append(held.iloc[:n])
                expected += n
            if n == len(held):
                self.waiting.removeKey((block,))
                n_blocks -= 1
            if not n:
                return runs, rows, expected, n_blocks

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (expected, n_blocks, _, timer), current = self._load()
        parts = list(rows)
        frame = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        keys = self.names[: len(key)]
        numbers = frame[self.order].to_numpy()
        if (numbers[1:] < numbers[:-1]).any():
            place = np.argsort(numbers, kind="stable")
            frame, numbers = frame.take(place).reset_index(drop=True), numbers[place]
        if not n_blocks and (numbers == expected + np.arange(len(numbers))).all():
            # Most batches of most keys: the next rows, without a hole, and nothing waits.
            current, out = self.step(current, frame)
            yield from self._give(key, out, keys)
            self._save(expected + len(numbers), 0, timer, current, timerValues)
            return
        frame = frame[self.columns]
        old = numbers < expected
        if self.idle_ms is not None and old.any():
            late = self._late(frame.loc[old, self.order].to_numpy())
            if late:
                yield from self._give(key, pd.DataFrame({LATE: late}), keys, f"{self.what} came late")
        frame = frame[~old].drop_duplicates(self.order, keep="last").reset_index(drop=True)
        before = expected // BLOCK
        runs, rest, expected, n_blocks = self._ready(frame, expected, n_blocks)
        if runs:
            current, out = self.step(current, pd.concat(runs, ignore_index=True))
            yield from self._give(key, out, keys)
        if n_blocks and expected // BLOCK > before:  # what the sequence has overtaken without reading it
            for (block,) in [k for k in self.waiting.keys() if k[0] < expected // BLOCK]:
                self.waiting.removeKey((block,))
                n_blocks -= 1
        self._save(expected, self._hold(rest, n_blocks), timer, current, timerValues)

    def _save(self, expected: int, n_blocks: int, timer: int, current: tuple, timerValues) -> None:
        """Keep the counters of a key that has just been heard of, with a timer if keys are finished."""
        seen = 0
        if self.idle_ms is not None:
            seen = int(timerValues.getCurrentProcessingTimeInMs())
            if not timer:
                timer = seen + self.idle_ms
                self.handle.registerTimer(timer)
        self.counters.update((expected, n_blocks, seen, timer, *current))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (expected, n_blocks, seen, timer), current = self._load()
        due = seen + self.idle_ms
        if due > int(timerValues.getCurrentProcessingTimeInMs()):  # the key was heard of meanwhile
            self.handle.registerTimer(due)
            self.counters.update((expected, n_blocks, seen, due, *current))
            return
        error, keys = None, self.names[: len(key)]
        for block in sorted(k[0] for k in self.waiting.keys()) if n_blocks else ():
            held = self._held(block).sort_values(self.order, ignore_index=True)
            held = held[held[self.order] >= expected]
            self.waiting.removeKey((block,))
            for number in held[self.order].tolist():
                if number > expected:
                    self.passed.updateValue((expected,), (number,))
                    error = error or f"{self.what} missing before {number}"
                expected = number + 1
            if len(held):
                current, out = self.step(current, held)
                yield from self._give(key, out, keys, error)
        current, out = self.close_key(current)
        yield from self._give(key, out, keys, error)
        self.counters.update((expected, 0, seen, 0, *current))

    def close(self) -> None:
        pass


def process_in_order(
    stream: DataFrame,
    keys: list[str],
    order: str,
    state: list[T.StructField],
    initial: tuple,
    output: T.StructType,
    step: Step,
    what: str,
    close: Close | None = None,
    idle_ms: int | None = None,
) -> DataFrame:
    """Fold ``step`` over each key's rows in ``order`` (0, 1, 2, …).

    ``output`` starts with the keys and has a text ``error``.  With ``idle_ms`` an always-on query
    finishes a key that has been silent for so long: what waits behind holes is folded, its
    ``error`` names the first ``what`` missing, and ``close`` gives its last rows.  The counters stay,
    so that a key that resumes goes on; a row of a hole that was passed over is given out with its
    number in the column ``late`` and no other values.  Leave ``idle_ms`` out for ``availableNow`` runs.
    """
    if idle_ms is not None and close is None:
        raise ValueError("idle_ms needs a close, or what a key still holds would be lost")
    if idle_ms is not None:
        output = T.StructType([*output.fields, T.StructField(LATE, T.LongType())])
    stream.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    columns = [c for c in stream.columns if c not in keys]
    names = [f.name for f in output.fields]
    fold = InOrder(order, columns, T.StructType(state), initial, names, step, what, close, idle_ms)
    mode = "none" if idle_ms is None else "processingTime"
    return stream.groupBy(*keys).transformWithStateInPandas(fold, output, "append", mode)
