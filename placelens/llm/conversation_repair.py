"""Conversation structure repair by a survivor-coalescence Viterbi search.

Edits turn a dialogue into ``(s?(ua)+)?`` at the least cost, ties to the least text of
edit initials. The state of a repaired front part says what may follow: nothing yet,
only the system turn, a user's turn, an assistant's. Each state's survivor is a leaf of
a tree of back pointers that counts references; what all survivors share is final and
is given out, and ties compare all that is not.

Long dialogues are cut into blocks. A block's effect is a small table: for each pair of
states at its ends the least cost, and how the edit texts behind compare. Such tables
compose, so only they meet per dialogue; then every block is solved on its own.
"""

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelens.llm.storage import staged

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
AFTER_INSERT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, **{(x, "u"): USER for x in (START, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
# What a state can cost more than another in what follows, by imitating the other's edits:
# inserts where a turn is missing, a deletion where only the other could keep a system turn.
BEHIND = {
    START: {SYSTEM: 0, USER: 3, ASSISTANT: 0},
    SYSTEM: {START: 6, USER: 3, ASSISTANT: 6},
    USER: {START: 7, SYSTEM: 3, ASSISTANT: 3},
    ASSISTANT: {START: 4, SYSTEM: 0, USER: 3},
}
BLOCK_ROWS = 250_000
DECIDED = 9
FIRST_LOOK = 64


class Node:
    """An edit of a survivor, with the number of edits and survivors that lead back to it."""

    __slots__ = ("parent", "op", "depth", "refs")

    def __init__(self, parent, op: str):
        self.parent, self.op, self.refs = parent, op, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1


def _release(node: Node | None) -> None:
    while node is not None and node.refs == 0:
        parent, node.parent = node.parent, None
        if parent:
            parent.refs -= 1
        node = parent


def _tied(x: Node, y: Node) -> tuple[str, str]:
    """All edits of both from their common ancestor on."""
    left, right = [], []
    while x is not y:
        if x.depth >= y.depth:
            left.append(x.op)
            x = x.parent
        else:
            right.append(y.op)
            y = y.parent
    return "".join(reversed(left)), "".join(reversed(right))


class Survivors:
    """The search from one state on. ``step`` takes a turn; ``settled`` gives the edits that all survivors share."""

    def __init__(self, entry: int, opening: bool):
        self.root = Node(None, "")
        self.best: dict[int, tuple[int, Node]] = {}
        self._place(self.best, entry, 0, self.root, None)
        self.fresh, self.look = 0, FIRST_LOOK
        if opening:
            self._insert(self.best)

    @staticmethod
    def _place(best, state: int, cost: int, parent: Node, op: str | None) -> None:
        """Puts a candidate where it beats what its state has: cheaper, or as cheap and of lesser edit text."""
        held = best.get(state)
        if held and held[0] < cost:
            return
        node = parent if op is None else Node(parent, op)
        if held and held[0] == cost:
            ours, theirs = _tied(node, held[1])
            if ours >= theirs:
                _release(node)
                return
        node.refs += 1  # the survivor's own
        best[state] = (cost, node)
        if held:
            held[1].refs -= 1
            _release(held[1])

    def _insert(self, best) -> None:
        for _ in range(2):  # a third insert in a row would lead back
            for state in sorted(best):
                cost, node = best[state]
                self._place(best, AFTER_INSERT[state], cost + INSERT_COST, node, INSERT)

    def step(self, initial: str, fault: str, repeats: int = 1) -> None:
        """A turn, or ``repeats`` copies that all have to go, as one edit."""
        after: dict[int, tuple[int, Node]] = {}
        more = TRUNCATED_COST if fault == "truncated" else 0
        for state in sorted(self.best):
            cost, node = self.best[state]
            self._place(after, state, cost + DELETE_COST * repeats, node, DELETE)
            if fault not in ("blank", "duplicate"):
                to = KEPT.get((state, initial))
                if to is not None:
                    self._place(after, to, cost + more, node, KEEP)
                self._place(after, AFTER_INSERT[state], cost + REROLE_COST + more, node, REROLE)
        self._insert(after)
        lost = [x for x in after if any(y != x and after[y][0] + BEHIND[y][x] < after[x][0] for y in after)]
        for _, node in [*self.best.values(), *[after.pop(x) for x in lost]]:
            node.refs -= 1
            _release(node)
        self.best = after
        self.fresh += 1

    def settled(self) -> str:
        """Edits of the common ancestor of all survivors, given once. Looked for as often as keeps it linear."""
        if self.fresh < self.look:
            return ""
        self.fresh = 0
        chain = []
        node = next(iter(self.best.values()))[1]
        while node is not self.root:
            chain.append(node)
            node = node.parent
        out, held = [], {id(n) for _, n in self.best.values()}
        while chain and self.root.refs == 1 and id(self.root) not in held:
            self.root = chain.pop()
            self.root.parent = None
            out.append(self.root.op)
        self.look = max(FIRST_LOOK, len(chain))
        return "".join(out)

    def text(self, state: int) -> str:
        """The unsettled edits of a state's survivor."""
        return _tied(self.best[state][1], self.root)[0]

    def cheapest(self) -> int:
        """The final state of least cost, ties to the lesser edit text."""
        return min((x for x in FINAL if x in self.best), key=lambda x: (self.best[x][0], self.text(x)))


def order_of(first: str, second: str) -> int:
    """-DECIDED or DECIDED where the texts differ; else how many inserts the second has more."""
    if first.startswith(second) or second.startswith(first):
        return len(second) - len(first)
    return -DECIDED if first < second else DECIDED


class Effect(NamedTuple):
    """What a block does: least costs by (entry, exit), edits behind them, and the order of their texts by (inserts ahead of the second, first, second)."""

    costs: list[float]
    edits: list[int]
    order: list[int]


def block_effect(turns: list[tuple[str, str, int]], opening: bool) -> Effect:
    """Effect of turns (initial, fault, number of copies) on every state that they may meet."""
    costs, texts, edits = [math.inf] * 16, [""] * 16, [0] * 16
    copies = sum(n - 1 for _, _, n in turns)
    for entry in (START,) if opening else (START, SYSTEM, USER, ASSISTANT):
        found = Survivors(entry, opening)
        done = ""
        for initial, fault, n in turns:
            _step(found, initial, fault, n)
            done += found.settled()
        for state, (cost, _) in found.best.items():
            k = entry * 4 + state
            costs[k], texts[k] = cost, done + found.text(state)
            edits[k] = len(texts[k]) + copies - sum(n > 1 for _, _, n in turns)
    order = [0] * 768
    for ahead in range(3):
        for p in range(16):
            for q in range(16):
                if costs[p] < math.inf and costs[q] < math.inf:
                    order[ahead * 256 + p * 16 + q] = order_of(texts[p], INSERT * ahead + texts[q])
    return Effect(costs, edits, order)


def _step(found: Survivors, initial: str, fault: str, n: int) -> None:
    found.step(initial, fault)
    if n > 1:
        found.step(initial, "duplicate", n - 1)


def compose(effects: list[Effect]) -> list[tuple[int, int, int]]:
    """Entry state, exit state and number of edits before, for each block of a dialogue."""
    costs, ahead = {START: 0.0}, {(START, START): 0}
    before: list[dict[int, int]] = []

    def order(effect: Effect, p: int, q: int, x: int, y: int) -> int:
        """Order of the whole edit texts that lead over entry p to exit x, and over q to y."""
        first = ahead[p, q]
        if abs(first) == DECIDED:
            return first
        if first < 0:
            return -effect.order[-first * 256 + (q * 4 + y) * 16 + p * 4 + x]
        return effect.order[first * 256 + (p * 4 + x) * 16 + q * 4 + y]

    for effect in effects:
        chosen: dict[int, int] = {}
        for x in range(4):
            for p in sorted(costs):
                cost = costs[p] + effect.costs[p * 4 + x]
                if cost == math.inf:
                    continue
                held = chosen.get(x)
                least = math.inf if held is None else costs[held] + effect.costs[held * 4 + x]
                if cost < least or cost == least and order(effect, p, held, x, x) < 0:
                    chosen[x] = p
        ahead = {(x, y): order(effect, p, q, x, y) for x, p in chosen.items() for y, q in chosen.items()}
        costs = {x: costs[p] + effect.costs[p * 4 + x] for x, p in chosen.items()}
        before.append(chosen)
    finals = [x for x in FINAL if x in costs]
    best = finals[0]
    for x in finals[1:]:
        if costs[x] < costs[best] or costs[x] == costs[best] and ahead[x, best] < 0:
            best = x
    path = [best]
    for chosen in reversed(before):
        path.append(chosen[path[-1]])
    path.reverse()
    out, done = [], 0
    for effect, entry, exit_ in zip(effects, path, path[1:]):
        out.append((entry, exit_, done))
        done += effect.edits[entry * 4 + exit_]
    return out


EFFECT = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("costs", T.ArrayType(T.DoubleType())), T.StructField("edits", T.ArrayType(T.LongType())), T.StructField("order", T.BinaryType())])
CHOICE = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("entry", "exit", "before")]])


def _block_effects(table: pa.Table) -> pa.Table:
    """Effect of one block of one dialogue."""
    rows = sorted(zip(*(table[n].to_pylist() for n in ("turn", "digest", "initial", "fault", "copies"))), key=lambda r: (r[0] is not None, r[0], r[1]))
    effect = block_effect([r[2:] for r in rows], table["opening"][0].as_py())
    order = np.array(effect.order, np.int8).tobytes()
    columns = [pa.array([table["part"][0].as_py()], pa.int32()), pa.array([table["key"][0].as_py()]), pa.array([effect.costs], pa.list_(pa.float64())), pa.array([effect.edits], pa.list_(pa.int64())), pa.array([order], pa.binary())]
    return pa.Table.from_arrays(columns, names=EFFECT.names)


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Composes the effects of each dialogue; rows come by key and part."""

    def solved(key, held):
        found = compose([e for _, e in held])
        rows = [(p, key, *c) for (p, _), c in zip(held, found)]
        return pa.RecordBatch.from_pylist([dict(zip(CHOICE.names, r)) for r in rows], pa.schema([("part", pa.int32()), ("key", pa.string()), *[(n, pa.int64()) for n in CHOICE.names[2:]]]))

    now, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["key"] != now:
                yield solved(now, held)
                held = []
            now = r["key"]
            held.append((r["part"], Effect(r["costs"], r["edits"], np.frombuffer(r["order"], np.int8).tolist())))
    if held:
        yield solved(now, held)


def _edits_of(schema: T.StructType):
    """Edits of the blocks of a task; rows come by part, key, turn and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.names
        rows: list[tuple] = []
        kinds = None

        class Block:
            def __init__(self, row):
                chosen = next((c for c in row["choices"] or () if c["key"] == row["key"]), None)
                self.id = row["part"], row["key"]
                self.state, self.exit, self.seq = (chosen["entry"], chosen["exit"], chosen["before"]) if chosen else (START, None, 0)
                # Edits in front of the first turn belong to the first block of a dialogue.
                self.found = Survivors(self.state, chosen is None or chosen["opening"])
                self.turns, self.copy = [], False  # turns whose edits are not settled, oldest first
                self.at = 0

            def give(self, ops):
                for op in ops:
                    if op == INSERT:
                        self.state = AFTER_INSERT[self.state]
                        rows.append((*self.id, self.seq, op, None, hashlib.md5(f"{self.id}{self.seq}".encode()).digest(), None, "user" if self.state == USER else "assistant", None, INSERT_COST, 1))
                        self.seq += 1
                        continue
                    row = self.turns[self.at]
                    fault, repeats = row["fault"], 1
                    if self.copy:
                        fault, repeats = "blank" if fault == "blank" else "duplicate", row["copies"] - 1
                    cost, role = DELETE_COST * repeats, None
                    if op != DELETE:
                        cost = (TRUNCATED_COST if fault == "truncated" else 0) + (REROLE_COST if op == REROLE else 0)
                        if op == KEEP:
                            self.state, role = KEPT[self.state, row["initial"]], row["role"]
                        else:
                            self.state = AFTER_INSERT[self.state]
                            role = "user" if self.state == USER else "assistant"
                    rows.append((*self.id, self.seq, op, row["turn"], row["digest"], row["role"], role, fault, cost, repeats))
                    self.seq += repeats
                    self.copy = not self.copy and row["copies"] > 1
                    if not self.copy:
                        self.at += 1
                if self.at > 1024:
                    del self.turns[: self.at]
                    self.at = 0

            def close(self):
                self.give(self.found.text(self.found.cheapest() if self.exit is None else self.exit))

        def flush():
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        block = None
        for batch in batches:
            turn = batch.schema.field("turn").type
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.string(), turn, pa.binary(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            for row in batch.to_pylist():
                if block is None or block.id != (row["part"], row["key"]):
                    if block:
                        block.close()
                    block = Block(row)
                block.turns.append(row)
                _step(block.found, row["initial"], row["fault"], row["copies"])
                block.give(block.found.settled())
            if len(rows) > 20_000:
                yield flush()
        if block:
            block.close()
        if rows:
            yield flush()

    return run


def turn_faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it breaks off before a full stop, mark of exclamation or question."""
    ended = F.rtrim(text, F.lit(BLANKS))
    return ended == "", ~F.coalesce(F.right(ended, F.lit(1)).isin(".", "!", "?"), F.lit(False))


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The cheapest edits that give every dialogue the structure ``(s?(ua)+)?`` of role initials.

    Turns of a dialogue follow their turn number, nulls first, and within a number the MD5
    of role and text. Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert of an
    empty user's or assistant's turn 3, and a truncated turn that stays 3 more. Blank turns
    and repeats of role and text have to be deleted. Of the cheapest the edits of least
    initials count (D, I, K, R).

    One row per edit in order: conv_id, seq (number of edits before), edit (its initial),
    turn, old_role and fault (blank, duplicate, truncated or none) of the turn it takes, role
    and text of the repaired turn (null where it is deleted), cost, and repeats: copies of
    one turn are one row with their number. A null role or text is one space; a null
    conv_id is one dialogue; a dialogue of no turns and an empty table give no rows. Other
    columns are left out. Texts of any length move only as values, never in the search.

    A dialogue may hold any share of the rows: rows are range-partitioned by their place, so
    a long dialogue falls into blocks of about ``block_rows`` turns, and only one effect of
    about a kilobyte per block meets per dialogue.
    """
    spark = turns.sparkSession
    space = F.lit(" ")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
    )
    # Copies of a row are counted before anything moves, so a turn that is stored very often is one row.
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    blank, broken = turn_faults(F.col("text"))
    rows = rows.withColumns({"key": key, "digest": F.unhex(F.md5(F.concat("role", F.lit(":"), "text"))), "initial": F.substring("role", 1, 1), "blank": blank, "broken": broken})
    rows = staged(rows, "turns")

    # The first turn of equal role and text, found with a combinable aggregate.
    firsts = rows.groupBy("key", "digest").agg(F.max(F.col("turn").isNull()).alias("null_first"), F.min("turn").alias("least"))
    first = F.when(F.col("null_first"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    fault = F.when(F.col("blank"), "blank").when(~first, "duplicate").when(F.col("broken"), "truncated").otherwise("none")
    narrow = rows.select("key", "turn", "digest", "role", "initial", "blank", "broken", "copies")
    narrow = narrow.join(firsts, ["key", "digest"]).select("key", "turn", "digest", "role", "initial", fault.alias("fault"), "copies")
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / block_rows))
    place = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("digest")]
    narrow = staged(narrow.repartitionByRange(blocks, *place).withColumn("part", F.spark_partition_id()), "placed-turns")

    # Dialogues that reach over blocks are the first or last of each block that they touch.
    ends = narrow.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    ends = ends.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("key"))
    long = ends.groupBy("key").agg(F.count("*").alias("blocks"), F.min("part").alias("first_part")).where("blocks > 1")
    long = staged(ends.join(long, "key").select("part", "key", (F.col("part") == F.col("first_part")).alias("opening")), "long-dialogues")
    effects = narrow.join(long, ["part", "key"]).groupBy("part", "key").applyInArrow(_block_effects, EFFECT)
    choices = effects.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_choices, CHOICE)
    choices = choices.join(long, ["part", "key"]).groupBy("part").agg(F.collect_list(F.struct("key", "entry", "exit", "before", "opening")).alias("choices"))

    kinds = {"part": T.IntegerType(), "key": T.StringType(), "seq": T.LongType(), "edit": T.StringType(), "turn": turns.schema[turn_col].dataType, "digest": T.BinaryType()}
    kinds |= {n: T.StringType() for n in ("old_role", "role", "fault")} | {"cost": T.LongType(), "repeats": T.LongType()}
    schema = T.StructType([T.StructField(n, t) for n, t in kinds.items()])
    dealt = narrow.join(choices, "part", "left").repartition(blocks, "part").sortWithinPartitions(F.col("part"), *place)
    edits = dealt.mapInArrow(_edits_of(schema), schema)

    # Texts come back by their turn. Inserts carry a digest of their own, so that they spread like the rest.
    texts = rows.select(F.col("key").alias("_key"), F.col("turn").alias("_turn"), F.col("digest").alias("_digest"), F.col("text").alias("_text"))
    same = (F.col("key") == F.col("_key")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("digest") == F.col("_digest"))
    text = F.when(F.col("edit") == INSERT, "").when(F.col("edit") != DELETE, F.col("_text"))
    conv = F.when(F.col("key") != "", F.substr("key", F.lit(2)).cast(turns.schema[conv_col].dataType))
    return edits.join(texts, same, "left").select(conv.alias("conv_id"), "seq", "edit", "turn", "old_role", "role", text.alias("text"), "fault", "cost", "repeats")


SUMMARY = "blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


def _summaries(schema: T.StructType):
    """One row per dialogue; edits come by dialogue and place, and texts are hashed as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(key):
            return {"conv_id": key, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "gaps": 0, "cost": 0, "audit": []}, hashlib.sha256()

        def closed(now, digest):
            return {**now, "audit": "".join(now["audit"]), "repaired_sha256": digest.hexdigest()}

        now = digest = types = last = low = high = None
        kept = distinct = 0
        for batch in batches:
            types = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in schema.names[1:]]])
            done = []
            for row in batch.to_pylist():
                if row["seq"] == 0:
                    if now:
                        done.append(closed(now, digest))
                    now, digest = opened(row["conv_id"])
                    last, low, high, kept, distinct = None, None, None, 0, 0
                now["audit"].append(row["edit"] * row["repeats"])
                now["cost"] += row["cost"]
                if row["role"] is not None:
                    digest.update((("\n" if kept else "") + row["role"] + ":" + row["text"]).encode())
                    kept += 1
                if row["old_role"] is not None:
                    if row["fault"] in now:
                        now[row["fault"]] += row["repeats"]
                    now["illegal"] += row["repeats"] - 1 + (last is not None and last + row["old_role"][:1] not in LEGAL)
                    last, turn = row["old_role"][:1], row["turn"]
                    if turn is not None and turn != high:
                        low, high, distinct = turn if low is None else low, turn, distinct + 1
                        now["gaps"] = high - low + 1 - distinct
            if done:
                yield pa.RecordBatch.from_pylist(done, types)
        if now:
            yield pa.RecordBatch.from_pylist([closed(now, digest)], types)

    return run


def summarise_repairs(edits: DataFrame) -> DataFrame:
    """One row per dialogue that has edits: faults of its turns, adjacent roles that are not su, ua or au, gaps in its turn numbers, cost, audit (the edits' initials) and repaired_sha256 (of ``role:text`` lines).

    A digest of a whole dialogue has to take its texts in order, so one task reads a
    dialogue, as a stream; it holds only the initials.
    """
    schema = T.StructType([edits.schema["conv_id"], *T._parse_datatype_string(SUMMARY).fields])
    ordered = edits.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(_summaries(schema), schema)
