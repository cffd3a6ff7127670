"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, ending with an assistant turn. Each given turn is put under some role
(RELABEL if not its own) and either opens a turn or is merged into the turn before it
(MERGE, same role); empty turns can be inserted (INSERT each). A shortest path through
the automaton START -> SYSTEM? -> USER <-> ASSISTANT picks the cheapest repair. Of equally
cheap ones that is taken whose last move comes first in MOVES, then whose last but one
does, and so on.

A stretch of turns is summed up by its cheapest cost from each state to each state, a
4 x 4 matrix, with the order in which the ways from the four states to each state come among
equally cheap ones; stretches combine by (min, +) products. Both are exact, so where a
conversation is cut has no influence on its repair. So a conversation of any
length is solved in blocks of BLOCK turn numbers: blocks give matrices, a conversation's
matrices are chained, and each block then retraces its own path. Matrices are made from
roles alone; the texts are shuffled once, each block's way sorted in ahead of its turns.
A task holds a batch of rows and the block that the batch cuts. A block is bounded as
far as turn numbers differ: turns of one number, or without one, share a block.

Less their minimum, the costs of the four states take few values, so a turn is one
look-up in a table of steps.

The result has a row for each given turn and each inserted one; the rendered
conversation is the concatenation of `rendered` in the order of (out_turn, part).
Defined cases: roles are matched in lower case without outer white space, and any other
role or a null has to be relabelled; a null text renders as empty; null turns come
first; turns with the same number go by role and text; a null conv_id is one
conversation; a repeated row is a turn of its own.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

BLOCK = 2048
#: Bytes of text in an output batch.
BATCH = 32 << 20
MERGE, RELABEL, INSERT = 2, 3, 4
ROLES = ("system", "user", "assistant")
#: States: 0 nothing yet, then the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40


def reach(state: int, role: int) -> tuple[int, ...] | None:
    """The empty turns to insert after `state` before a turn of `role` may open; None if it never may."""
    if role in NEXT[state]:
        return ()
    for first in NEXT[state]:
        if role in NEXT[first] and first != SYSTEM:
            return (first,)
    return None


def moves() -> list[tuple[int, int, str, tuple[int, ...], int]]:
    """(from, to, action, inserted, cost without relabelling) in order of preference."""
    out = []
    for state in range(4):
        for role in (SYSTEM, USER, ASSISTANT):
            inserted = reach(state, role)
            if inserted == ():
                out.append((state, role, "keep", (), 0))
            if state == role:
                out.append((state, role, "merge", (), MERGE))
            if inserted:
                out.append((state, role, "keep", inserted, INSERT * len(inserted)))
    return sorted(out, key=lambda m: m[4])


MOVES = moves()
#: Turns that each move opens.
OPENS = [(action != "merge") + len(inserted) for _, _, action, inserted, _ in MOVES]
#: Empty turns that end a conversation legally.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_number(role) -> int:
    name = role.strip().lower() if isinstance(role, str) else None
    return ROLES.index(name) + 1 if name in ROLES else 0


@cache
def step(cost: tuple[int, ...], role: int) -> tuple[tuple[int, ...], int, tuple[int, ...]]:
    """(new costs less their minimum, that minimum, for each state the move that led there or -1)."""
    new, by = [FAR] * 4, [-1] * 4
    for m, (a, b, _, _, price) in enumerate(MOVES):
        total = cost[a] + price + (RELABEL if b != role else 0)
        if total < new[b]:
            new[b], by[b] = total, m
    least = min(new)
    return tuple(c - least if c < FAR else FAR for c in new), least, tuple(by)


def forward(roles: list[int], start: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Cheapest cost of each state after the turns, and for each turn and state the move that led there."""
    cost = tuple(0 if s == start else FAR for s in range(4))
    base, back = 0, []
    for role in roles:
        cost, least, by = step(cost, role)
        base += least
        back.append(by)
    return [c + base if c < FAR else FAR for c in cost], back


#: What a stretch of no turns does: costs from each state to each state, and the order of the starts for each end.
NOTHING = tuple(tuple(0 if s == t else FAR for t in range(4)) for s in range(4)), ((0, 1, 2, 3),) * 4


@cache
def joint_step(costs, ranks, role: int):
    """(costs, ranks, least costs, moves by start and end) of a stretch and one more turn; ranks[end][start]."""
    new, least, by = zip(*(step(cost, role) for cost in costs))
    order = []
    for end in range(4):
        last = [by[s][end] for s in range(4)]
        first = sorted(range(4), key=lambda s: (len(MOVES), 0, s) if last[s] < 0 else (last[s], ranks[MOVES[last[s]][0]][s], s))
        order.append(tuple(first.index(s) for s in range(4)))
    return new, tuple(order), least, by


def measure_block(roles: list[int]) -> tuple[list[list[int]], tuple, list[list[tuple[int, ...]]]]:
    """(cheapest costs from each state to each, ranks[end][start] among equally cheap ways, each start's moves for every turn)."""
    (costs, ranks), base, back = NOTHING, [0] * 4, [[] for _ in range(4)]
    for role in roles:
        costs, ranks, least, by = joint_step(costs, ranks, role)
        for s in range(4):
            base[s] += least[s]
            back[s].append(by[s])
    return [[c + base[s] if c < FAR else FAR for c in costs[s]] for s in range(4)], ranks, back


def openings(back: list[tuple[int, ...]]) -> list[int]:
    """How many turns the cheapest way to each state opens."""
    opened = [0] * 4
    for by in back:
        opened = [opened[MOVES[m][0]] + OPENS[m] if m >= 0 else 0 for m in by]
    return opened


def chain_blocks(measured: list[tuple]) -> list[tuple[int, int]]:
    """The states in which each block starts and ends on the cheapest way through all, from (costs, ranks) of each."""
    cost, back = [0, FAR, FAR, FAR], []
    for m, ranks in measured:
        by = [min(range(4), key=lambda a: (min(FAR, cost[a] + m[a][b]), ranks[b][a])) for b in range(4)]
        cost = [min(FAR, cost[by[b]] + m[by[b]][b]) for b in range(4)]
        back.append(by)
    state = min(range(4), key=lambda s: cost[s] + INSERT * len(CLOSING[s]))
    out = []
    for by in reversed(back):
        out.append((by[state], state))
        state = by[state]
    return out[::-1]


def trace(roles: list[int], start: int, end: int, last: bool) -> list[tuple[int, str, int]]:
    """(given turn or -1, action, role) in order."""
    _, back = forward(roles, start)
    state, picked = end, []
    for by in reversed(back):
        picked.append(by[state])
        state = MOVES[by[state]][0]
    out = []
    for i, m in enumerate(reversed(picked)):
        _, role, action, inserted, _ = MOVES[m]
        out += [(-1, "insert", r) for r in inserted]
        out.append((i, action if action == "merge" or role == roles[i] else "relabel", role))
    return out + [(-1, "insert", r) for r in CLOSING[end]] * last


def whole_groups(batches, keys: int):
    """Tables of whole groups from batches sorted by their first columns, however batches cut them."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = list(zip(*(batch.column(k).to_pylist() for k in range(keys))))
        before = [last if held else key[0], *key[:-1]]
        cut = next((i for i in range(len(key) - 1, -1, -1) if key[i] != before[i]), None)
        if cut is None:
            held.append(batch)
        else:
            done = [*held, batch.slice(0, cut)]
            yield pa.Table.from_batches(done).combine_chunks()
            held = [batch.slice(cut)]
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(*columns: list) -> list[tuple[int, int]]:
    """(first, past the last) place of each run of equal keys."""
    key = list(zip(*columns))
    cuts = [i for i in range(1, len(key)) if key[i] != key[i - 1]]
    return list(zip([0, *cuts], [*cuts, len(key)]))


def repair(spark: SparkSession, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv_id, out_turn, part, turn, action, role, text, rendered)."""
    rows = turns.select(turns[f"`{conv}`"].alias("conv_id"), turns[f"`{turn}`"].cast("long").alias("turn"), turns[f"`{role}`"].cast("string").alias("role"), turns[f"`{text}`"].cast("string").alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long"))
    kind = dict(rows.dtypes)["conv_id"]

    def measure(batches):
        for held in whole_groups(batches, 2):
            convs, blocks, roles = (held.column(c).to_pylist() for c in ("conv_id", "block", "role"))
            runs = bounds(convs, blocks)
            costs, ranks, opens = [], [], []
            for a, b in runs:
                cost, rank, back = measure_block([role_number(r) for r in roles[a:b]])
                costs.append([c for row in cost for c in row])
                ranks.append([r for row in rank for r in row])
                opens.append([n for way in back for n in openings(way)])
            at = pa.array([a for a, _ in runs])
            yield from pa.table({"conv_id": held["conv_id"].take(at), "block": held["block"].take(at), "costs": pa.array(costs, pa.list_(pa.int64())), "ranks": pa.array(ranks, pa.list_(pa.int32())), "opens": pa.array(opens, pa.list_(pa.int64()))}).to_batches()

    def link(batches):
        for held in whole_groups(batches, 1):
            costs, ranks, opens = (held[c].to_pylist() for c in ("costs", "ranks", "opens"))
            enter, leave, last, before = [], [], [], []
            for a, b in bounds(held["conv_id"].to_pylist()):
                ways = chain_blocks([([m[i : i + 4] for i in (0, 4, 8, 12)], [r[i : i + 4] for i in (0, 4, 8, 12)]) for m, r in zip(costs[a:b], ranks[a:b])])
                enter += [x for x, _ in ways]
                leave += [y for _, y in ways]
                last += [False] * (len(ways) - 1) + [True]
                before += list(accumulate((o[4 * x + y] for o, (x, y) in zip(opens[a:b], ways)), initial=0))[:-1]
            yield from pa.table({"conv_id": held["conv_id"], "block": held["block"], "enter": pa.array(enter, pa.int32()), "leave": pa.array(leave, pa.int32()), "last": pa.array(last, pa.bool_()), "before": pa.array(before, pa.int64())}).to_batches()

    def apply(batches):
        for held in whole_groups(batches, 2):
            convs, blocks, roles = (held.column(c).to_pylist() for c in ("conv_id", "block", "role"))
            ways = [held.column(c).to_pylist() for c in ("enter", "leave", "last", "before")]
            source, given, nth, out_turn, action, name = [], [], [], [], [], []
            for a, b in bounds(convs, blocks):  # the way comes first, then the turns
                enter, leave, last, opened = (w[a] for w in ways)
                steps = trace([role_number(r) for r in roles[a + 1 : b]], enter, leave, last)
                for i, did, r in steps:
                    opened += did != "merge"
                    given.append(a + 1 + i if i >= 0 else None)
                    out_turn.append(opened - 1)
                    action.append(did)
                    name.append(ROLES[r - 1])
                source += [a] * len(steps)
                nth += range(len(steps))
            source, given = pa.array(source, pa.int64()), pa.array(given, pa.int64())
            text = held["text"].cast(pa.large_string()).take(given)
            sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
            out = pa.table({"conv_id": held["conv_id"].take(source), "block": held["block"].take(source), "nth": pa.array(nth, pa.int64()), "out_turn": pa.array(out_turn, pa.int64()), "turn": held["turn"].take(given), "action": pa.array(action, pa.string()), "role": pa.array(name, pa.string()), "text": text})
            full = [(total - 1) // BATCH if total else 0 for total in accumulate(sizes)]
            for a, b in bounds(full) if full else []:
                part = out.slice(a, b - a)
                yield from part.set_column(7, "text", part["text"].cast(pa.string())).combine_chunks().to_batches()

    of_block = ["conv_id", "block"]
    narrow = rows.select(*of_block, "turn", "role").repartition(*of_block).sortWithinPartitions(*of_block, "turn", "role")
    matrices = narrow.mapInArrow(measure, f"conv_id {kind}, block long, costs array<long>, ranks array<int>, opens array<long>")
    ways = matrices.repartition("conv_id").sortWithinPartitions(*of_block).mapInArrow(link, f"conv_id {kind}, block long, enter int, leave int, last boolean, before long")
    ready = ways.unionByName(rows, allowMissingColumns=True).repartition(*of_block).sortWithinPartitions(*of_block, F.col("enter").asc_nulls_last(), "turn", "role", "text")
    steps = ready.mapInArrow(apply, f"conv_id {kind}, block long, nth long, out_turn long, turn long, action string, role string, text string")
    out = steps.select("conv_id", "out_turn", F.struct("block", "nth").alias("part"), "turn", "action", "role", "text")
    head = F.when(F.col("action") == "merge", F.lit("\n\n")).otherwise(F.concat(F.lit("<|end|>\n<|"), F.col("role"), F.lit("|>\n")))
    head = F.when((F.col("out_turn") == 0) & (F.col("action") != "merge"), F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))).otherwise(head)
    return out.withColumn("rendered", F.concat(head, F.coalesce("text", F.lit(""))))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair(spark, table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "out_turn", F.col("part.block").alias("part_block"), F.col("part.nth").alias("part_nth"), "turn", "action", "role", "rendered")
