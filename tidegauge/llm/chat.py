"""Chat formatting with minimum-cost role repair.

A conversation is legal if it opens with an optional system turn and then
alternates user and assistant, user first. A turn may keep its role or be
relabelled; it may join the turn before it if both end up with one role; and
an empty turn may be put in where the automaton lacks one. Dynamic programming
over the automaton finds the cheapest repair. The cost of a stretch of turns
is a small matrix over the states before and after it, so long conversations
are cut into chunks whose matrices are multiplied, runs of chunks first and
then all runs, and each chunk is traced back on its own between the states
found for its ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import staged

ROLES = ("system", "user", "assistant")
# A state is the role of the last turn, or START before the first.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
# Costs of the repairs. A turn of unknown role always has to be relabelled.
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
CHUNK_TURNS = 1024
# Turns whose chunks' matrices are multiplied in one task.
RUN_TURNS = CHUNK_TURNS * 1024
FOOT = "<|end|>\n"

# Legal next states, and the empty turn that makes another next state legal.
_LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_VIA = {(START, ASSISTANT): USER, (SYSTEM, ASSISTANT): USER}


def _step(before: int, after: int) -> tuple[float, bool, int]:
    """Cost of a turn taking state ``after``, whether it joins the one before, and the empty turn put in (0 for none)."""
    if before == after and before != START:
        other = ASSISTANT if before == USER else USER
        return min((MERGE, True, 0), (INSERT if before != SYSTEM else np.inf, False, other))
    if (before, after) in _LEGAL:
        return 0.0, False, 0
    if (before, after) in _VIA:
        return INSERT, False, _VIA[before, after]
    return np.inf, False, 0


def _matrix(given: int) -> np.ndarray:
    """Costs from each state to each over one turn of the given role (0 if unknown)."""
    costs = np.full((STATES, STATES), np.inf)
    for before in range(STATES):
        for after in (SYSTEM, USER, ASSISTANT):
            costs[before, after] = _step(before, after)[0] + (RELABEL if after != given else 0.0)
    return costs


_MATRICES = np.stack([_matrix(role) for role in range(STATES)])


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cheapest costs over one stretch and then another."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def chunk_costs(roles: list[int]) -> np.ndarray:
    total = np.where(np.eye(STATES, dtype=bool), 0.0, np.inf)
    for role in roles:
        total = _times(total, _MATRICES[role])
    return total


def _trace(matrices: list[np.ndarray] | np.ndarray, start: int, end: int | None) -> list[int]:
    """States after each step of a cheapest way from ``start`` (to ``end``); of equal ones the lowest, from the end on."""
    costs = [np.where(np.arange(STATES) == start, 0.0, np.inf)]
    for matrix in matrices:
        costs.append((costs[-1][:, None] + matrix).min(axis=0))
    state = int(costs[-1].argmin()) if end is None else end
    states = []
    for cost, matrix in zip(costs[-2::-1], matrices[::-1]):
        states.append(state)
        state = int((cost + matrix[:, state]).argmin())
    return states[::-1]


def repair(roles: list[int], start: int = START, end: int | None = None) -> list[tuple[int, bool, int]]:
    """Per turn: its role, whether it joins the turn before, and the empty turn put in before it (0 for none)."""
    out, before = [], start
    for state in _trace(_MATRICES[roles], start, end):
        _, joins, put_in = _step(before, state)
        out.append((state, joins, put_in))
        before = state
    return out


_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()),
}


def _map_rows(df: DataFrame, function: Callable[..., Iterable[tuple]], columns: dict[str, str]) -> DataFrame:
    """The rows that a function yields for the values of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in zip(*(c.to_pylist() for c in batch.columns)) for out in function(*row)]
            values = list(zip(*rows)) or [()] * len(columns)
            arrays = [pa.array(v, _ARROW[kind]) for v, kind in zip(values, columns.values())]
            yield pa.RecordBatch.from_arrays(arrays, list(columns))

    return df.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in columns.items()))


def _matrices(parts: list[dict]) -> np.ndarray:
    return np.array([p["costs"] for p in parts]).reshape(-1, STATES, STATES)


def _product(chat: int | None, head: int, parts: list[dict]) -> Iterator[tuple]:
    """A run's head and the costs of the stretch its parts make up."""
    total, *others = _matrices(parts)
    for matrix in others:
        total = _times(total, matrix)
    yield chat, head, total.ravel().tolist()


def _ends(parts: list[dict], before: int = START, after: int | None = None, closes: bool = True) -> Iterator[tuple[int, int, int, bool]]:
    """For each part of a stretch the states before and after it, and whether it ends the conversation."""
    for i, (part, state) in enumerate(zip(parts, _trace(_matrices(parts), before, after)), start=1):
        yield part["head"], before, state, closes and i == len(parts)
        before = state


def _repaired(places: list[int], roles: list[int], before: int, after: int, closes: bool) -> Iterator[tuple]:
    """Per turn of a chunk: its place, the states before and after it, how it got there, and whether the chat ends."""
    for place, (state, joins, put_in) in zip(places, repair(roles, before, after)):
        yield place, before, state, joins, put_in, closes and place == places[-1]
        before = state


def format_chats(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per given turn: conv_id, turn, role_given, role, action, inserted, rendered, place.

    ``rendered`` is the turn's part of the chat: the foot ``<|end|>`` of the
    turn before, an inserted empty turn if any, a head ``<|role|>`` and the
    text; a turn that joins the one before is its text on a new line. Read in
    the order of ``place`` the parts of a conversation are the whole chat.
    ``action`` is keep, relabel, merge or both of the latter.

    Turns go by number, then role and text; NULL numbers come first. Rows that
    repeat are turns of their own. A NULL or unknown role has to be relabelled,
    a NULL text is empty, NULL ids are one conversation. Other columns are not kept.
    """
    given = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).cast("string").alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    code = F.array_position(F.array(*map(F.lit, ROLES)), F.lower(F.trim("role"))).cast("int")
    given = given.withColumn("code", F.coalesce(code, F.lit(0)))
    # By range of id and number, so that a conversation of any length is spread over tasks.
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    placed = given.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.monotonically_increasing_id().alias("place")
    )
    placed = staged(placed, "turns")
    # A chunk is known by the place of its first turn.
    chunks = placed.groupBy("conv_id", F.floor(F.col("place") / CHUNK_TURNS).alias("chunk")).agg(
        F.min("place").alias("head"), F.sort_array(F.collect_list(F.struct("place", "code"))).alias("turns")
    )
    chunks = staged(chunks.select("conv_id", "head", F.col("turns")["place"].alias("places"), F.col("turns")["code"].alias("roles")), "chunks")

    costs = {"conv_id": "long", "head": "long", "costs": "array<double>"}
    ends = {"head": "long", "before": "int", "after": "int", "closes": "boolean"}
    parts = F.sort_array(F.collect_list(F.struct("head", "costs"))).alias("parts")
    of_chunks = _map_rows(
        chunks.select("conv_id", "head", "roles"),
        lambda chat, head, roles: [(chat, head, chunk_costs(roles).ravel().tolist())],
        costs,
    )
    runs = of_chunks.groupBy("conv_id", F.floor(F.col("head") / RUN_TURNS).alias("run")).agg(F.min("head").alias("head"), parts)
    runs = staged(runs.drop("run"), "runs")
    chats = _map_rows(runs.select("conv_id", "head", "parts"), _product, costs).groupBy("conv_id").agg(parts)
    run_ends = _map_rows(chats.select("parts"), _ends, ends)
    bounds = _map_rows(runs.join(run_ends, "head").select("parts", "before", "after", "closes"), _ends, ends)
    traced = _map_rows(
        chunks.select("head", "places", "roles").join(bounds, "head").select("places", "roles", "before", "after", "closes"),
        _repaired,
        {"place": "long", "before": "int", "state": "int", "joins": "boolean", "put_in": "int", "closes": "boolean"},
    )
    names = F.array(F.lit("start"), *map(F.lit, ROLES))
    changed, joins = F.col("state") != F.col("code"), F.col("joins")
    put_in = F.when(F.col("put_in") > 0, F.get(names, F.col("put_in")))
    new_role = F.get(names, F.col("state"))
    opening = F.concat(
        F.when(F.col("before") == START, "").otherwise(FOOT),
        F.coalesce(F.concat(F.lit("<|"), put_in, F.lit(f"|>\n{FOOT}")), F.lit("")),
        F.lit("<|"), new_role, F.lit("|>\n"),
    )
    return placed.join(traced, "place").select(
        "conv_id",
        "turn",
        F.col("role").alias("role_given"),
        new_role.alias("role"),
        F.when(changed & joins, "relabel and merge").when(changed, "relabel").when(joins, "merge").otherwise("keep").alias("action"),
        put_in.alias("inserted"),
        F.concat(F.when(joins, "\n").otherwise(opening), "text", F.when(F.col("closes"), FOOT).otherwise("")).alias("rendered"),
        "place",
    )
