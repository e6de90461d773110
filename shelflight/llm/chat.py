"""Repair the roles of conversations at least cost and render them.

Legal conversations are an optional system turn, then user and assistant in turn, ending with the assistant. A
turn is kept, merged into the one before, given another role, or preceded by empty turns; the cheapest way is
found by dynamic programming over the states of that automaton. The cost of a run of turns is a small matrix, so
a conversation that is spread over many partitions is repaired piece by piece from the matrices of its pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.shared import Runs, ship
from shelflight.session import ensure_checkpoint_dir

ROLES = ("system", "user", "assistant")
UNKNOWN = len(ROLES)
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
MERGE, INSERT, RELABEL = 1, 2, 3  # costs
FAR = 1 << 40
# States: 0 nothing yet, else 1 + the role of the last turn. Legal next roles of each state.
NEXT = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
START, STATES = 0, 4
FRAGMENTS = (
    "conv_id bigint, turn_index bigint, part bigint, turn bigint, role string, original_role string, action string, "
    "text string, rendered string"
)
Move = tuple[int, int, str, tuple[int, ...]]  # cost, state after, action, roles of empty turns before


def _fillers(state: int, role: int) -> tuple[int, ...] | None:
    """Fewest empty user and assistant turns after which `role` is legal."""
    ways: list[tuple[int, tuple[int, ...]]] = [(state, ())]
    for at, path in ways:
        if role in NEXT[at]:
            return path
        if len(path) < 3:
            ways += [(1 + r, (*path, r)) for r in NEXT[at] if r != 0]
    return None


def _moves(role: int, state: int) -> list[Move]:
    """Ways to take a turn, in the order in which equal costs are decided."""
    out: list[Move] = []
    if state != START:
        same = state - 1 == role
        out.append((MERGE + (0 if same else RELABEL), state, "merge" if same else "relabel_merge", ()))
    for target in range(len(ROLES)):
        before = _fillers(state, target)
        if before is not None:
            same = target == role
            out.append(((0 if same else RELABEL) + INSERT * len(before), 1 + target, "keep" if same else "relabel", before))
    return sorted(out, key=lambda m: (m[0], len(m[3])))


MOVES = [[_moves(role, state) for state in range(STATES)] for role in range(len(ROLES) + 1)]
ENDING = [(), (1, 2), (2,), ()]  # empty turns that end a conversation legally, by state
END_COST = tuple(INSERT * len(e) for e in ENDING)


def costs_to_go(roles: tuple[int, ...], after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least cost from each state before each turn to the end, given the costs after the last."""
    out = [after]
    for role in reversed(roles):
        ahead = out[-1]
        out.append(tuple(min((m[0] + ahead[m[1]] for m in MOVES[role][s]), default=FAR) for s in range(STATES)))
    return out[::-1]


def walk(roles: tuple[int, ...], after: tuple[int, ...], state: int) -> tuple[list[Move], int]:
    """The cheapest moves from a state, the first of equal ones at each turn, and the state reached."""
    ahead, moves = costs_to_go(roles, after), []
    for t, role in enumerate(roles):
        move = min(MOVES[role][state], key=lambda m: m[0] + ahead[t + 1][m[1]])
        moves.append(move)
        state = move[1]
    return moves, state


@functools.lru_cache(maxsize=4096)
def whole_walk(roles: tuple[int, ...]) -> tuple[list[Move], int]:
    return walk(roles, END_COST, START)


def matrix(roles: tuple[int, ...]) -> list[int]:
    """Least cost of a run of turns from each state to each state, row by row."""
    ways = [costs_to_go(roles, tuple(0 if s == target else FAR for s in range(STATES)))[0] for target in range(STATES)]
    return [min(ways[target][s], FAR) for s in range(STATES) for target in range(STATES)]


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else UNKNOWN


def _clean(text: str | None) -> str:
    """Text that cannot be taken for a mark of the rendering."""
    return (text or "").replace("<|", "< |")


def fragments(rows: list[dict], moves: list[Move], state: int, offset: int, last: bool) -> Iterator[dict]:
    """Rows of the rendered conversation; in order of turn_index and part, their `rendered` joins up to all of it."""

    def opened(role: int, text: str, state: int) -> str:
        return ("" if state == START else "<|im_end|>\n") + f"<|im_start|>{ROLES[role]}\n{text}"

    out = []
    for i, (row, (_, after, action, before)) in enumerate(zip(rows, moves, strict=True)):
        common = {"conv_id": row["conv_id"], "turn_index": offset + i}
        for k, role in enumerate(before):
            out.append(common | {"part": k, "role": ROLES[role], "action": "insert", "text": "", "rendered": opened(role, "", state)})
            state = 1 + role
        text = _clean(row["text"])
        rendered = f"\n{text}" if "merge" in action else opened(after - 1, text, state)
        out.append(common | {
            "part": len(before), "turn": row["turn"], "role": ROLES[after - 1], "original_role": row["role"], "action": action,
            "text": text, "rendered": rendered,
        })
        state = after
    if last:
        for k, role in enumerate(ENDING[state]):
            out.append({"conv_id": rows[-1]["conv_id"], "turn_index": offset + len(rows), "part": k, "role": ROLES[role], "action": "insert", "text": "", "rendered": opened(role, "", state)})
            state = 1 + role
        out[-1]["rendered"] += "<|im_end|>\n"
    return iter(out)


def _edge_runs(ranged: DataFrame, schema: str, row_of: Callable[[int, pa.Table, tuple[int, ...]], dict | None]) -> list:
    """One row for the first and the last conversation of each partition, so at most two per partition, to the driver."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, first, last = TaskContext.get().partitionId(), None, None
        for run in Runs(batches, ("conv_key",)):
            first, last = (run, None) if first is None else (first, run)
        for run in (first, last):
            if run is not None:
                row = row_of(piece, run, tuple(map(role_number, run["role"].to_pylist())))
                if row is not None:
                    yield pa.RecordBatch.from_pylist([row], schema=_arrow(schema))

    return ranged.mapInArrow(scan, schema).collect()


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def repair_chats(turns: DataFrame) -> DataFrame:
    """The rendered turns of all conversations (conv_id, turn, role, text), repaired at least cost.

    Returns conv_id, turn_index (place of the input turn in its conversation, from 0), part (empty turns before it
    come first), turn, role, original_role, action (keep, merge, relabel, relabel_merge, insert), text and rendered.
    The rendered pieces of a conversation, in order of turn_index and part, join up to its whole text, so no task ever
    holds a conversation of any length.

    Turns are ordered by turn, then by role and text; null turns come first. Roles are read without case and
    blanks, with common other names; any other role, null too, must be relabelled. Null text is empty. Rows without
    conv_id are one conversation. Repeated rows are turns of their own. An empty table gives no rows. Other columns
    are not looked at.
    """
    spark = turns.sparkSession
    ship(spark)
    ensure_checkpoint_dir(spark)
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_key"),
    )
    # The row number only spreads rows that are equal in everything else.
    order = [F.col(c).asc_nulls_first() for c in ("conv_key", "turn", "role", "text")]
    spread = [F.col("conv_key"), F.col("turn"), F.col("role"), F.xxhash64("text"), F.monotonically_increasing_id()]
    ranged = rows.withColumn("part_hash", spread[3]).repartitionByRange("conv_key", "turn", "role", "part_hash", spread[4]).drop("part_hash")
    order[3:] = [F.xxhash64("text").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = ranged.sortWithinPartitions(*order).checkpoint()  # both passes must see the same partitions

    def cost_row(piece: int, run: pa.Table, roles: tuple[int, ...]) -> dict:
        return {"piece": piece, "conv_key": run["conv_key"][0].as_py(), "turns": len(roles), "costs": matrix(roles)}

    pieces: dict[str, list] = {}
    for row in _edge_runs(ranged, "piece bigint, conv_key string, turns bigint, costs array<bigint>", cost_row):
        pieces.setdefault(row["conv_key"], []).append(row)
    known: dict[tuple[str, int], tuple[tuple[int, ...], int, bool]] = {}  # costs after the piece, turns before, last
    for key, of in pieces.items():
        if len(of) > 1:
            after, last = END_COST, True
            before = _sums(of)
            for row in sorted(of, key=lambda r: -r["piece"]):
                known[key, row["piece"]] = (after, before[row["piece"]], last)
                after = tuple(min(FAR, *(row["costs"][s * STATES + t] + after[t] for t in range(STATES))) for s in range(STATES))
                last = False

    def exit_row(piece: int, run: pa.Table, roles: tuple[int, ...]) -> dict | None:
        key = run["conv_key"][0].as_py()
        if (key, piece) not in known:
            return None
        after = known[key, piece][0]
        return {"piece": piece, "conv_key": key, "exits": [walk(roles, after, s)[1] for s in range(STATES)]}

    entry: dict[tuple[str, int], int] = {}
    state: dict[str, int] = {}
    for row in sorted(_edge_runs(ranged, "piece bigint, conv_key string, exits array<bigint>", exit_row), key=lambda r: r["piece"]) if known else []:
        entry[row["conv_key"], row["piece"]] = state.get(row["conv_key"], START)
        state[row["conv_key"]] = row["exits"][entry[row["conv_key"], row["piece"]]]

    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, out, schema = TaskContext.get().partitionId(), [], _arrow(FRAGMENTS)
        for run in Runs(batches, ("conv_key",)):
            key, roles = run["conv_key"][0].as_py(), tuple(map(role_number, run["role"].to_pylist()))
            if (key, piece) in known:
                after, offset, last = known[key, piece]
                first = entry[key, piece]
                moves, _ = walk(roles, after, first)
            else:
                first, offset, last = START, 0, True
                moves, _ = whole_walk(roles) if len(roles) <= 64 else walk(roles, END_COST, START)
            out += fragments(run.to_pylist(), moves, first, offset, last)
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ranged.mapInArrow(render, FRAGMENTS)


def _sums(rows: list) -> dict[int, int]:
    """Turns of a conversation before each of its pieces."""
    out, total = {}, 0
    for row in sorted(rows, key=lambda r: r["piece"]):
        out[row["piece"]] = total
        total += row["turns"]
    return out
