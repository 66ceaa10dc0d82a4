"""Keyed state of the polling loop, one instance per task."""

from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = [
    T.StructField("kind", T.StringType()),
    T.StructField("round", T.IntegerType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("review_id", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("stop_reason", T.StringType()),
]
REVIEWS = T.ArrayType(
    T.StructType([T.StructField("review_id", T.StringType()), T.StructField("body", T.StringType())])
)
PROGRESS = T.StructType(
    [
        T.StructField("round", T.IntegerType()),
        T.StructField("look", T.IntegerType()),
        T.StructField("counted", T.BooleanType()),
        T.StructField("loading", T.BooleanType()),
        T.StructField("total", T.LongType()),
        T.StructField("dry", T.IntegerType()),
        T.StructField("spins", T.IntegerType()),
        T.StructField("done", T.BooleanType()),
        T.StructField("timer_ms", T.LongType()),
    ]
)
ROWS_PER_OUTPUT = 4096
KNOWN_IDS = 50_000


@dataclass
class Progress:
    round: int  # the round and the look at it that come next
    look: int = 0
    counted: bool = False  # whether this round had a good page, and one with the indicator
    loading: bool = False
    total: int = 0
    dry: int = 0
    spins: int = 0
    done: bool = False
    timer_ms: int = 0  # when the timer that counts goes off


class LocationCollector(StatefulProcessor):
    def __init__(self, names, max_reviews, first_round, max_dry, spins_per_dry, second_looks, timeout_ms, forget_ms):
        self.names, self.max_reviews, self.first_round = names, max_reviews, first_round
        self.max_dry, self.spins_per_dry, self.second_looks = max_dry, spins_per_dry, second_looks
        self.timeout_ms, self.forget_ms = timeout_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", PROGRESS)
        self.seen = handle.getMapState(
            "seen",
            T.StructType([T.StructField("review_id", T.StringType())]),
            T.StructType([T.StructField("round", T.IntegerType())]),
        )
        self.waiting = handle.getMapState(
            "waiting",
            T.StructType([T.StructField("round", T.IntegerType()), T.StructField("look", T.IntegerType())]),
            T.StructType(
                [
                    T.StructField("ok", T.BooleanType()),
                    T.StructField("loading", T.BooleanType()),
                    T.StructField("reviews", REVIEWS),
                ]
            ),
        )

    def handleInputRows(self, key, rows, timer_values):
        if self.progress.exists():
            at = Progress(*self.progress.get())
        else:
            at = Progress(self.first_round)
            self._wake_after(at, self.timeout_ms, timer_values)
        out, known = [], set()  # known: ids that need no look into the state again
        for frame in rows:
            for row in frame.itertuples(index=False):
                here = (int(row.round), int(row.pass_no))
                if at.done or here < (at.round, at.look):
                    continue
                if here[1] > int(self.second_looks):  # a look that is never taken: this page goes, the stream stays
                    out.append((*key, "rejected", here[0], None, None, None, "unexpected_pass"))
                    continue
                if here != (at.round, at.look):
                    entries = [(r["review_id"], r["body"]) for r in row.reviews]
                    self.waiting.updateValue(here, (bool(row.ok), bool(row.loading), entries))
                    continue
                page = (bool(row.ok), bool(row.loading), row.reviews)
                while page is not None:
                    self._take(key, at, page, known, out)
                    here, page = (at.round, at.look), None
                    if not at.done and self.waiting.containsKey(here):
                        page = self.waiting.getValue(here)
                        self.waiting.removeKey(here)
                if at.done:
                    self._end(at, timer_values)
                if len(out) >= ROWS_PER_OUTPUT:
                    yield pd.DataFrame(out, columns=self.names)
                    out = []
        self.progress.update(astuple(at))
        yield pd.DataFrame(out, columns=self.names)

    def _take(self, key, at, page, known, out):
        """One page: its new reviews, and unless another look follows the end of its round."""
        ok, loading, reviews = page
        new = 0
        for r in reviews if ok else ():
            id_ = r["review_id"]
            if id_ in known:
                continue
            if len(known) >= KNOWN_IDS:
                known.clear()
            known.add(id_)
            if self.seen.containsKey((id_,)):
                continue
            self.seen.updateValue((id_,), (at.round,))
            new, at.total = new + 1, at.total + 1
            out.append((*key, "review", at.round, at.total, id_, r["body"], None))
            if at.total == self.max_reviews:
                self._stop(key, at, "max", out)
                return
        at.counted, at.loading = at.counted or ok, at.loading or (ok and loading)
        if self.second_looks and at.look == 0 and loading and not new:
            at.look = 1
            return
        if new:
            at.dry = at.spins = 0
        elif at.counted and at.loading:
            at.spins += 1
            if at.spins == self.spins_per_dry:
                at.dry, at.spins = at.dry + 1, 0
        elif at.counted:
            at.dry += 1
            if at.dry >= self.max_dry:
                self._stop(key, at, "exhausted", out)
        at.round, at.look, at.counted, at.loading = at.round + 1, 0, False, False

    def _stop(self, key, at, reason, out):
        out.append((*key, "stop", at.round, at.total, None, None, reason))
        at.done = True

    def _wake_after(self, at, wait_ms, timer_values):
        if wait_ms is not None:
            at.timer_ms = timer_values.getCurrentProcessingTimeInMs() + wait_ms
            self.handle.registerTimer(at.timer_ms)

    def _end(self, at, timer_values):
        self.seen.clear()
        self.waiting.clear()
        at.timer_ms = 0
        self._wake_after(at, self.forget_ms, timer_values)

    def handleExpiredTimer(self, key, timer_values, expired):
        out = []
        at = Progress(*self.progress.get()) if self.progress.exists() else None
        if at is not None and expired.getExpiryTimeInMs() == at.timer_ms:
            if at.done:
                self.progress.clear()
            else:
                self._stop(key, at, "timeout", out)
                self._end(at, timer_values)
                self.progress.update(astuple(at))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass
