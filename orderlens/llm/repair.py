"""Conversations with a broken turn order, mended by the cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import BLANKS, blocks, written
from orderlens.plans.running import row_numbers

#: Rows of one conversation that are solved in one piece.
SLICE_ROWS = 4096
#: Rows that a task solves at a time.
_PIECE = 1 << 16
#: Costs of the edits; keeping is free.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_FAR = np.int64(1) << 60

# States of a repaired prefix: nothing yet, after system, after user, after assistant.
_STATES = 4
#: The state after adding a row whose role begins with s, u, a; -1 where none.
_AFTER = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
#: The state after adding the one role of user and assistant that may follow.
_NEXT = (2, 2, 3, 2)
#: What the missing end costs, in inserts, from each state.
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
#: Edits in ASCII order, and no edit at the end of a slice.
_EDITS = "DIKR"
_STOP = len(_EDITS)

# A row's code: its role's place in "sua" or 3, then bits.
_DROP_ONLY, _CUT_SHORT = 4, 8


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, each row by its hash.

    Null counts as one space in the hash, the role and the text. Of every 20
    rows one is dropped, one emptied, one loses its sentence ends, one is said
    twice and one is given to the user.
    """
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("_fault", F.crc32(name.cast("binary")) % 20)
    fault = F.col("_fault")
    return rows.filter(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "")
        .when(fault == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _whose() -> Column:
    """What the rows of one conversation share, also where its id is null."""
    return F.struct(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id"),
        F.col("conv_id").isNull().alias("none"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, pos, fault, initial``: each row's place and first fault.

    Rows are ordered by turn (null first), then role and text. A row said again is
    found by one aggregation over role and text, so copies of a text do not meet
    in a task, and a conversation of any length is numbered in slices.
    """
    base = rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    placed = base.withColumns({"_whose": _whose(), "_tie": F.struct("role", "text")})
    numbered = written(
        row_numbers(placed, ["_whose"], "turn", "_tie", "pos").select(
            "conv_id", "_whose", "turn", "role", "text", "pos",
            F.sha2(F.col("text").cast("binary"), 256).alias("_sha"),
        ),
        "numbered-turns",
    )
    first = numbered.groupBy("_whose", "role", "_sha").agg(
        F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    ).filter("_n > 1").drop("_n")
    bare = F.rtrim("text", F.lit(BLANKS))
    return (
        numbered.join(first, ["_whose", "role", "_sha"], "left")
        .withColumn(
            "fault",
            F.when(F.length(bare) == 0, "blank")
            .when(F.col("pos") > F.col("_first"), "duplicate")
            .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
            .otherwise("none"),
        )
        .select("conv_id", "_whose", "turn", "role", "text", "pos", "fault",
                F.substring("role", 1, 1).alias("initial"))
    )


def codes(initial: Column, fault: Column) -> Column:
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (
        role
        + F.when(fault.isin("blank", "duplicate"), _DROP_ONLY).otherwise(0)
        + F.when(fault == "truncated", _CUT_SHORT).otherwise(0)
    ).cast("int")


def _arcs(code: np.ndarray, after: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Edits of rows with these codes in every state, in ASCII order: the edit, its
    cost with what ``after`` (a column per state) says of the rest, and the state."""
    n = len(code)
    every = np.arange(_STATES)
    keeps = np.array([_AFTER["s"], _AFTER["u"], _AFTER["a"], (-1,) * 4])[code & 3]
    keeps[(code & _DROP_ONLY) > 0] = -1
    extra = np.where(code & _CUT_SHORT, TRUNCATED, 0)[:, None]
    rows = np.arange(n)[:, None]
    keep = np.where(keeps < 0, _FAR, extra + after[rows, np.maximum(keeps, 0)])
    to = np.broadcast_to(np.array(_NEXT), (n, _STATES))
    role = np.where((code & _DROP_ONLY)[:, None] > 0, _FAR, extra + REROLE + after[rows, to])
    return [
        (0, np.minimum(DELETE + after, _FAR), np.broadcast_to(every, (n, _STATES))),
        (2, np.minimum(keep, _FAR), np.maximum(keeps, 0)),
        (3, np.minimum(role, _FAR), to),
    ]


def _with_inserts(bare: np.ndarray) -> np.ndarray:
    """Costs when rows may be added first: two in turn at most, as each costs."""
    out = bare.copy()
    user, assistant = bare[:, 2], bare[:, 3]
    out[:, 2] = np.minimum(user, INSERT + assistant)
    out[:, 3] = np.minimum(assistant, INSERT + user)
    out[:, :2] = np.minimum(bare[:, :2], INSERT + out[:, 2:3])
    return np.minimum(out, _FAR)


class Slices:
    """Stretches of conversations, one after another, solved together.

    ``code`` has an entry per row, ``starts`` where each slice begins (one more
    than slices), ``end`` the cost of the rest from each state after a slice,
    ``closing`` which slices end a conversation.
    """

    def __init__(self, code: np.ndarray, starts: np.ndarray, end: np.ndarray, closing: np.ndarray):
        lengths = np.diff(starts)
        # a node is a place (before each row and after the last) in a state
        self.first = starts[:-1] + np.arange(len(lengths))
        self.last = starts[1:] + np.arange(len(lengths))
        self.places = len(code) + len(lengths)
        self.cost = np.full((self.places, _STATES), _FAR)
        self.cost[self.last] = end
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for state, to in ((1, 2), (2, 3)):  # what ends a conversation is inserted
            own = self.last[closing] * _STATES
            self.found.append((own + state, np.ones(len(own), np.int64), own + to))
        order = np.argsort(-lengths, kind="stable")
        longer = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), "right")
        for t, k in enumerate(longer):  # the t-th row from the end of every slice that has one
            own = order[:k]
            at = self.last[own] - 1 - t
            arcs = _arcs(code[starts[1:][own] - 1 - t], self.cost[at + 1])
            best = self.cost[at] = _with_inserts(np.minimum.reduce([c for _, c, _ in arcs]))
            node = at[:, None] * _STATES + np.arange(_STATES)
            after = (at[:, None] + 1) * _STATES
            add = best[:, list(_NEXT)] + INSERT
            arcs = [(label, cost, after + state) for label, cost, state in arcs]
            arcs.append((1, add, at[:, None] * _STATES + np.array(_NEXT)))
            for label, cost, to in arcs:
                hit = (cost == best) & (best < _FAR)
                self.found.append((node[hit], np.full(hit.sum(), label), to[hit]))

    def through(self) -> np.ndarray:
        """Cost from each state before a slice."""
        return self.cost[self.first]

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """The optimal arcs ranked by the least audits that begin with them.

        Returns each arc's edit and target, the arc that the ranks select out of
        every node, for each power of two the arc so many edits further on, and
        the ranks.

        Arcs are ranked by their edit, then by the least audits of 2, 4, 8 edits:
        an arc's rank at twice the length is its rank and that of the arc as many
        edits on. Edits out of one node differ, so an audit leads along one path
        and one pointer an arc is enough. An audit that has ended ranks first.
        """
        node, edit, target = (np.concatenate(c) for c in zip(*self.found))
        idle = np.setdiff1d(np.arange(self.places * _STATES), node)  # where audits end
        node, target = np.concatenate([node, idle]), np.concatenate([target, idle])
        edit = np.concatenate([edit, np.full(len(idle), _STOP)])
        order = np.lexsort((edit, node))
        node, edit, target = node[order], edit[order], target[order]
        first = np.searchsorted(node, np.arange(self.places * _STATES))
        rank = np.where(edit == _STOP, 0, edit + 1)
        steps = [first[target]]
        while True:
            pair = rank * (len(rank) + 1) + rank[steps[-1]]
            rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
            further = steps[-1][steps[-1]]
            if np.array_equal(further, steps[-1]):
                break
            steps.append(further)
        least = np.minimum.reduceat(rank, first)
        hit = np.flatnonzero(rank == least[node])
        selected = hit[np.searchsorted(node[hit], np.arange(self.places * _STATES))]
        return edit, target, selected, steps, rank

    def audits(self) -> tuple[list[list[str]], np.ndarray]:
        """Per slice and state before it the least audit, and the state it ends in.

        The arc after t edits is reached through the pointers of the powers of
        two in t.
        """
        edit, target, selected, steps, _ = self.ranked()
        begin = (self.first[:, None] * _STATES + np.arange(_STATES)).reshape(-1)
        arc = selected[begin]
        final, length = arc.copy(), np.zeros(len(begin), np.int64)
        for k in range(len(steps) - 1, -1, -1):  # the last edit, by the binary digits of its place
            ahead = steps[k][final]
            go = edit[ahead] != _STOP
            length += np.where(go, 1 << k, 0)
            final = np.where(go, ahead, final)
        some = edit[arc] != _STOP
        length = np.where(some, length + 1, 0)
        ends = np.where(some, target[final], begin) % _STATES
        owner = np.repeat(np.arange(len(begin)), length)
        place = np.concatenate([[0], np.cumsum(length)])
        turn = np.arange(len(owner)) - place[owner]
        at = arc[owner]
        for k, step in enumerate(steps):
            at = np.where(turn >> k & 1, step[at], at)
        letters = np.frombuffer(_EDITS.encode(), np.uint8)[edit[at]].tobytes().decode()
        texts = [letters[i:j] for i, j in zip(place, place[1:])]
        return (
            [texts[i : i + _STATES] for i in range(0, len(texts), _STATES)],
            ends.reshape(-1, _STATES),
        )


def _slice_codes(faults: DataFrame, slice_rows: int) -> DataFrame:
    """``_whose, slice, codes``: a row per stretch of ``slice_rows`` rows at most."""
    return (
        faults.select(
            "_whose",
            F.floor((F.col("pos") - 1) / slice_rows).cast("bigint").alias("slice"),
            F.struct("pos", codes(F.col("initial"), F.col("fault")).alias("code")).alias("_c"),
        )
        .groupBy("_whose", "slice")
        .agg(F.sort_array(F.collect_list("_c")).alias("_c"))
        .select("_whose", "slice", F.col("_c.code").alias("codes"))
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some slices at a time, with their codes and where each begins."""
    for batch in batches:
        starts = batch.column(2).offsets.to_numpy().astype(np.int64)
        for i, j in blocks(starts, _PIECE):
            part = batch.slice(i, j - i)
            yield part, part.column(2).flatten().to_numpy().astype(np.int64), starts[i : j + 1] - starts[i]


def _costs_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice the cost from each state before it to each state after it, 16 values."""
    for part, code, starts in _pieces(batches):
        sides = []
        for state in range(_STATES):
            end = np.full((part.num_rows, _STATES), _FAR)
            end[:, state] = 0
            sides.append(Slices(code, starts, end, np.zeros(part.num_rows, bool)).through())
        matrix = np.stack(sides, axis=2).reshape(part.num_rows, -1)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(matrix.tolist(), pa.list_(pa.int64()))],
            ["_whose", "slice", "through"],
        )


def _boundaries(matrices: DataFrame) -> DataFrame:
    """``_whose, slice, rest``: what the rows after each slice cost from each state.

    Slices of a conversation are folded from its end: 16 numbers for
    ``SLICE_ROWS`` rows.
    """
    end = F.array(*[F.lit(int(v)) for v in _END]).cast("array<bigint>")

    def before(rest: Column, through: Column) -> Column:
        return F.array(
            *[
                F.least(
                    F.lit(int(_FAR)),
                    *[F.get(through, F.lit(q * _STATES + r)) + F.get(rest, F.lit(r)) for r in range(_STATES)],
                )
                for q in range(_STATES)
            ]
        )

    all_ = matrices.groupBy("_whose").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("slice")).alias("minus"), "through"))).alias("m")
    )
    folded = F.aggregate(
        F.col("m"),
        F.struct(end.alias("rest"), F.array().cast("array<array<bigint>>").alias("all")),
        lambda acc, m: F.struct(
            before(acc["rest"], m["through"]).alias("rest"),
            F.concat(acc["all"], F.array(acc["rest"])).alias("all"),
        ),
    )["all"]
    return all_.select("_whose", F.size("m").alias("_n"), F.posexplode(folded).alias("_i", "rest")).select(
        "_whose", (F.col("_n") - 1 - F.col("_i")).cast("bigint").alias("slice"), "rest"
    )


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice the least audits from each state, where they end, and their costs."""
    for part, code, starts in _pieces(batches):
        end = [_END if r is None else r for r in part.column(3).to_pylist()]
        closing = np.array(part.column(4).to_pylist(), bool)
        solved = Slices(code, starts, np.array(end, np.int64).reshape(-1, _STATES), closing)
        audits, ends = solved.audits()
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                part.column(1),
                pa.array(audits, pa.list_(pa.string())),
                pa.array(ends.tolist(), pa.list_(pa.int32())),
                pa.array(solved.through().tolist(), pa.list_(pa.int64())),
            ],
            ["_whose", "slice", "audits", "ends", "costs"],
        )


_WHOSE = "_whose struct<id:string,none:boolean>"


def solved_slices(faults: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``_whose, slice, audits, ends, costs`` of every slice, one value per state
    before it. A conversation of one slice needs no other; for longer ones the
    costs behind each slice are folded first."""
    pieces = written(_slice_codes(faults, slice_rows), "slice-codes")
    ends = pieces.groupBy("_whose").agg(F.max("slice").alias("_last"))
    long = ends.filter("_last > 0")
    rest = _boundaries(
        pieces.join(long.select("_whose"), "_whose").select("_whose", "slice", "codes").mapInArrow(
            _costs_through, f"{_WHOSE}, slice bigint, through array<bigint>"
        )
    )
    return (
        pieces.join(ends, "_whose")
        .join(rest, ["_whose", "slice"], "left")
        .select("_whose", "slice", "codes", "rest", (F.col("slice") == F.col("_last")).alias("closing"))
        .mapInArrow(
            _solved,
            f"{_WHOSE}, slice bigint, audits array<string>, ends array<int>, costs array<bigint>",
        )
    )


_STREAM = "conv_id {id}, kind int, pos bigint, role string, text string, audits array<string>, ends array<int>, costs array<bigint>"


class _Repaired:
    """One conversation, read in order: what is kept of it, edit by edit."""

    def __init__(self) -> None:
        self.cost: int | None = None
        self.audit: list[str] = []
        self.start = self.inside = 0
        self.edits: Iterator[str] = iter("")
        self.sha, self.any = hashlib.sha256(), False

    def head(self, audits: list[str], ends: list[int], costs: list[int]) -> None:
        self.tail()
        if self.cost is None:
            self.cost = costs[0]
        self.audit.append(audits[self.start])
        self.edits = iter(audits[self.start])
        self.inside, self.start = self.start, ends[self.start]

    def add(self, role: str, text: str) -> tuple[str, str]:
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True
        return role, text

    def placed(self, role: str | None) -> str:
        """The role of the next row, and the state after it."""
        if role is not None:
            self.inside = _AFTER[role[:1]][self.inside]
            return role
        self.inside = _NEXT[self.inside]
        return "user" if self.inside == 2 else "assistant"

    def row(self, role: str, text: str) -> list[tuple[str, str]]:
        out = []
        for edit in self.edits:
            if edit == "I":
                out.append(self.add(self.placed(None), ""))
                continue
            if edit != "D":
                out.append(self.add(self.placed(role if edit == "K" else None), text))
            break
        return out

    def tail(self) -> list[tuple[str, str]]:
        """The inserts after the last row of a slice."""
        return [self.add(self.placed(None), "") for _ in self.edits]


def _stream(faults: DataFrame, solved: DataFrame, all_ids: DataFrame, slice_rows: int) -> DataFrame:
    """Rows of a conversation in order, the audits of a slice before its rows."""
    kind = all_ids.schema["conv_id"].dataType.simpleString()
    none = {
        "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"),
        "audits": F.lit(None).cast("array<string>"), "ends": F.lit(None).cast("array<int>"),
        "costs": F.lit(None).cast("array<bigint>"), "pos": F.lit(-1).cast("bigint"),
    }
    columns = ["conv_id", "kind", "pos", "role", "text", "audits", "ends", "costs"]
    heads = solved.select(
        F.when(~F.col("_whose.none"), F.col("_whose.id").cast(kind)).alias("conv_id"),
        F.lit(1).alias("kind"),
        (F.col("slice") * slice_rows + 1).alias("pos"),
        "audits", "ends", "costs",
    ).withColumns({c: none[c] for c in ("role", "text")})
    rows = faults.select("conv_id", F.lit(2).alias("kind"), "pos", "role", "text").withColumns(
        {c: none[c] for c in ("audits", "ends", "costs")}
    )
    ids = all_ids.select("conv_id", F.lit(0).alias("kind")).withColumns(none)
    tasks = int(all_ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = heads.select(*columns).unionByName(rows.select(*columns)).unionByName(ids.select(*columns))
    return every.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "pos", "kind")


def _conversations(batches: Iterator[pa.RecordBatch]):
    """``conv_id``, and its events, from sorted batches."""
    def events():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    return groupby(events(), key=lambda e: e[0])


def repaired_turns(conversations: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The mended conversations: ``conv_id, place, role, text`` from place 0 on.

    What ``repair`` describes; conversations of which nothing stays give no row.
    """
    faults = written(with_faults(conversations), "turn-faults")
    ids = conversations.select("conv_id").distinct()
    kind = ids.schema["conv_id"].dataType.simpleString()

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = pa.int64()
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            types = [id_type, pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "place", "role", "text"]
            )

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                yield batch

        for conv_id, events in _conversations(typed()):
            state, place = _Repaired(), 0
            for _, what, _, role, text, audits, ends, costs in events:
                if what == 0:
                    continue
                if what == 1:
                    added = state.tail()
                    state.head(audits, ends, costs)
                else:
                    added = state.row(role, text)
                out += [(conv_id, place + i, *a) for i, a in enumerate(added)]
                place += len(added)
                if len(out) >= 1000:
                    yield flush()
                    out = []
            out += [(conv_id, place + i, *a) for i, a in enumerate(state.tail())]
        if out:
            yield flush()

    return _stream(faults, solved_slices(faults, slice_rows), ids, slice_rows).mapInArrow(
        mend, f"conv_id {kind}, place bigint, role string, text string"
    )


def repair(
    conversations: DataFrame, slice_rows: int = SLICE_ROWS, every: DataFrame | None = None
) -> DataFrame:
    """What is wrong with each conversation, and its cheapest mending.

    ``conversations``: ``conv_id, turn, role, text``; other columns are not
    read. Rows go by turn (null first), equal ones by role and text. A null role
    or text is one space; a null id is a conversation of its own. A row's
    first fault counts: blank, duplicate (role and text said earlier),
    truncated. Edits make the roles ``(s?(ua)+)?``, by their first letter:
    Keep, Rerole, Delete (a must for blank and duplicate rows) or Insert; of
    the cheapest the ASCII-least ``audit``. ``every`` has ids that
    come out even without rows. An empty table gives no rows.

    Cost is a shortest path over (rows done, last role). A conversation is cut into
    slices of ``slice_rows`` rows; costs through a slice compose, so slices are
    solved apart, each from all four states it may be entered in, by pointer
    doubling. Rows then pass one task in order with a running hash; it holds
    one conversation's audit and no texts.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``.
    """
    faults = written(with_faults(conversations), "turn-faults")
    ids = (conversations if every is None else every).select("conv_id").distinct()
    kind = ids.schema["conv_id"].dataType.simpleString()

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        id_type = pa.int64()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            types = [id_type, pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["conv_id", "cost", "audit", "repaired_sha256"],
            )

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                yield batch

        for conv_id, events in _conversations(typed()):
            state = _Repaired()
            for _, what, _, role, text, audits, ends, costs in events:
                if what == 1:
                    state.head(audits, ends, costs)
                elif what == 2:
                    state.row(role, text)
            state.tail()
            out.append((conv_id, state.cost or 0, "".join(state.audit), state.sha.hexdigest()))
            if len(out) >= 1000:
                yield flush()
                out = []
        if out:
            yield flush()

    mended = _stream(faults, solved_slices(faults, slice_rows), ids, slice_rows).mapInArrow(
        mend, f"conv_id {kind}, cost bigint, audit string, repaired_sha256 string"
    )
    # the role before a row: the row of the place before, in any slice
    before = faults.select("_whose", (F.col("pos") + 1).alias("pos"), F.col("initial").alias("_before"))
    pairs = faults.select("_whose", "pos", "initial").join(before, ["_whose", "pos"]).filter(
        ~F.concat("_before", "initial").isin("su", "ua", "au")
    )
    illegal = pairs.groupBy("_whose").agg(F.count(F.lit(1)).alias("illegal"))
    turns = faults.select("_whose", "turn").distinct().groupBy("_whose").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("bigint").alias("gaps")
    )
    counts = faults.groupBy("_whose").agg(
        *[
            F.count(F.when(F.col("fault") == c, 1)).alias(c)
            for c in ("blank", "duplicate", "truncated")
        ]
    )
    out = mended.withColumn("_whose", _whose())
    for part in (turns, counts, illegal):
        out = out.join(part, "_whose", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal")
    return out.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
        "cost",
        "audit",
        "repaired_sha256",
    )
