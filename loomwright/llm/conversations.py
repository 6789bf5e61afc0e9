"""Conversation structure repair: cost DP, then path ranking by prefix doubling.

A repaired conversation has an optional system turn and then user and assistant in turn. Rows are
sorted over all partitions and cut into chunks of at most ``CHUNK`` rows; of a row only one byte
(role initial, forced deletion, truncation) takes part:

1. For each chunk, the least cost from each state before it to each state behind it. A fold over
   these 4 x 4 tables from a conversation's end gives the cost of each state at each chunk's end.
2. For each chunk, the DP over its rows gives each node (place, state) its least cost; arcs that
   keep it are optimal. Nodes are ranked by the first 1, 2, 4, ... letters of the least audit that
   leaves them; of a node's optimal arcs the one of least (letter, rank of its end) is taken, and
   doubled pointers along these arcs spell the audit. All chunks of a batch are handled at once.
3. A fold of chunk exits from the start tells the state each chunk is entered in.

So a conversation of any length is spread over chunks; only the summaries of its chunks meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomwright.llm.common import SPACE_CLASS, narrow, register
from loomwright.queries.base import table
from loomwright.storage import stage

CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS
SLICE_ROWS = 200_000  # rows that one task ranks at a time

RETITLE, DELETE, INSERT = 2, 3, 2
_FAR = np.int64(1) << 40
# States by what was emitted last: nothing, system, user, assistant. Emitting a role leads on:
_NEXT = np.array([2, 2, 3, 2])
_CLOSE = np.array([0, 4, 2, 0], np.int64)  # inserts that end a conversation in each state
_EDITS = np.frombuffer(b"\0DIKR", np.uint8)  # by letter number, in ASCII order

# A row's byte: the role initial's number (0 other, 1 s, 2 u, 3 a) and two flags.
_FORCED, _TRUNCATED = 4, 8


def damage(turns: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with the test damage by a hash of conv_id and turn."""
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    return (
        turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .select(
            "conv_id", "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "")
            .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        ).drop("copy")
    )


def ordered(turns: DataFrame) -> DataFrame:
    """Rows with their place ``at`` in the order of conversations and turns, written once.

    Order: turn (null first), role, MD5 of the text. Ranges are cut between any two rows, also
    between equal ones, so no conversation and no repeated row is too large for a task.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("print"),
        F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", "turn", "role", "print", "tie"]
    last = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])" + SPACE_CLASS + "*\\z", 1)
    return stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "conv_id", F.monotonically_increasing_id().alias("at"), "turn", "role", "text",
            F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
                  .cast("binary")).alias("print"),
            (last == "").alias("blank"), (~last.rlike("[.!?]")).alias("open"),
            F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2)
            .when(F.col("role").startswith("a"), 3).otherwise(0).alias("initial"),
        ),
        "conversation-rows")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, at, turn, initial and the row's first fault (null, blank, duplicate, truncated)."""
    first = rows.groupBy("conv_id", "print").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = rows.alias("r").join(
        first.alias("f"), F.expr("r.conv_id <=> f.conv_id AND r.print = f.print"), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(
        F.col("open"), "truncated")
    return joined.select("r.conv_id", "at", "turn", "initial", fault.alias("fault"))


# ---- chunks ----


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of at most ``SLICE_ROWS`` bytes of codes (or one chunk), with lengths and codes."""
    for batch in batches:
        column = batch["codes"]
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(column):
            end = int(np.searchsorted(offsets, offsets[at] + SLICE_ROWS, side="right")) - 1
            end = min(len(column), max(end, at + 1))
            yield batch.slice(at, end - at), np.diff(offsets[at:end + 1]), data[offsets[at]:offsets[end]]
            at = end


def _keeps(codes: np.ndarray) -> np.ndarray:
    """The state behind a row that is kept, by state before it; -1 where it can't be kept."""
    after = np.full((len(codes), 4), -1)
    free, initial = (codes & _FORCED) == 0, codes & 3
    after[free & (initial == 1), 0] = 1
    after[np.ix_(free & (initial == 2), [0, 1, 3])] = 2
    after[free & (initial == 3), 2] = 3
    return after


def least_costs(lengths: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost from each node of each chunk to its end.

    ``ends`` has for each chunk k vectors of the costs of its four end states. Nodes lie by
    chunk, place (one more than rows) and state; result: (nodes / 4, k, 4).
    """
    bounds = np.r_[0, np.cumsum(lengths)]
    costs = np.empty((bounds[-1] + len(lengths), ends.shape[1], 4), np.int64)
    last = bounds[1:] + np.arange(len(lengths))  # a chunk's last place
    costs[last] = ends
    order = np.argsort(-lengths, kind="stable")
    falling = -lengths[order]
    keeps = _keeps(codes)
    late = (codes & _TRUNCATED > 0).astype(np.int64)
    forced = (codes & _FORCED) > 0
    for back in range(1, int(lengths.max(initial=0)) + 1):
        chunk = order[:np.searchsorted(falling, -back, side="right")]
        row, place = bounds[chunk + 1] - back, last[chunk] - back
        after = costs[place + 1]
        extra = late[row, None, None]
        rerole = np.where(forced[row, None, None], _FAR, RETITLE + extra + after[:, :, _NEXT])
        to = keeps[row][:, None, :]
        keep = np.where(to < 0, _FAR, extra + np.take_along_axis(after, np.broadcast_to(np.maximum(to, 0), after.shape), 2))
        here = np.minimum(np.minimum(DELETE + after, rerole), keep)
        user, assistant = here[:, :, 2], here[:, :, 3]
        both = np.minimum(user, INSERT + assistant)
        here[:, :, 3] = np.minimum(assistant, INSERT + user)
        here[:, :, 2] = both
        here[:, :, :2] = np.minimum(here[:, :, :2], INSERT + both[:, :, None])
        costs[place] = here
    return costs


def _arcs(lengths: np.ndarray, codes: np.ndarray, costs: np.ndarray, closing: np.ndarray):
    """Ends of the arcs of each node by letter (1 D, 2 I, 3 K, 4 R) and which are optimal."""
    places = len(costs)
    bounds = np.r_[0, np.cumsum(lengths)]
    last = bounds[1:] + np.arange(len(lengths))
    row_of = np.ones(places, bool)
    row_of[last] = False
    node = np.arange(places * 4).reshape(places, 4)
    flat = costs.ravel()
    ends = np.repeat(node[:, :, None], 5, 2)
    best = np.zeros((places, 4, 5), bool)
    at = np.flatnonzero(row_of)
    late = (codes & _TRUNCATED > 0).astype(np.int64)[:, None]
    free = ((codes & _FORCED) == 0)[:, None]
    after, keeps = node[at + 1], _keeps(codes)
    here = costs[at]

    def lay(letter: int, to: np.ndarray, price, allowed) -> None:
        ends[at, :, letter] = to
        best[at, :, letter] = allowed & (price + flat[to] == here)

    lay(1, after, DELETE, True)
    lay(3, np.take_along_axis(after, np.maximum(keeps, 0), 1), late, keeps >= 0)
    lay(4, after[:, _NEXT], RETITLE + late, free)
    inserting = np.concatenate([at, last[closing]])  # behind a conversation's last row, too
    to = node[inserting][:, _NEXT]
    ends[inserting, :, 2] = to
    best[inserting, :, 2] = INSERT + flat[to] == costs[inserting]
    return ends.reshape(-1, 5), best.reshape(-1, 5)


def least_paths(
    lengths: np.ndarray, codes: np.ndarray, ends: np.ndarray, closing: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Audits of all entry states of all chunks: letters, their offsets, exit states, costs.

    ``closing`` marks chunks that end their conversation. The entries lie by chunk and state.
    """
    costs = least_costs(lengths, codes, ends[:, None, :])[:, 0, :]
    to, best = _arcs(lengths, codes, costs, closing)
    letters = np.where(best.any(axis=1), best.argmax(axis=1), 0)
    every = np.arange(len(to))
    # Ranks by 1, 2, 4, ... letters; each letter leaves a node by one arc, so a prefix has one end.
    rank, jump = letters, to[every, letters]
    while True:
        pairs = rank * (int(rank.max()) + 1) + rank[jump]
        _, finer = np.unique(pairs, return_inverse=True)
        jump = jump[jump]
        done = not letters[jump].any()
        rank = finer
        if done:
            break
    # Of the optimal arcs that of the least letter and, behind it, the least rank.
    keys = np.where(best, np.arange(5) * (int(rank.max()) + 1) + rank[to], np.iinfo(np.int64).max)
    choice = np.where(best.any(axis=1), keys.argmin(axis=1), 0)
    jumps, count = [to[every, choice]], (choice > 0).astype(np.int64)
    while choice[jumps[-1]].any():
        count = count + count[jumps[-1]]
        jumps.append(jumps[-1][jumps[-1]])
    bounds = np.r_[0, np.cumsum(lengths)]
    entries = (((bounds[:-1] + np.arange(len(lengths))) * 4)[:, None] + np.arange(4)).ravel()
    sizes = count[entries]
    offsets = np.r_[0, np.cumsum(sizes)]
    node = np.repeat(entries, sizes)
    step = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
    for bit, jump in enumerate(jumps):
        moves = (step >> bit & 1) == 1
        node[moves] = jump[node[moves]]
    return _EDITS[choice[node]], offsets, jumps[-1][entries] % 4, costs.ravel()[entries]


def _chunks(marked: DataFrame) -> DataFrame:
    """conv_id, first (place of the first row), codes: at most CHUNK rows of one conversation."""
    code = F.col("initial") + F.when(F.col("fault").isin("blank", "duplicate"), _FORCED).when(
        F.col("fault") == "truncated", _TRUNCATED).otherwise(0)
    lists = F.array_sort(F.collect_list(F.struct("at", code.alias("code"))))
    grouped = marked.groupBy("conv_id", F.shiftright("at", CHUNK_BITS).alias("chunk")).agg(
        F.min("at").alias("first"), lists.alias("rows"))
    digits = F.transform("rows", lambda x: F.lpad(F.hex(x["code"]), 2, "0"))
    return stage(
        grouped.select("conv_id", "first", F.unhex(F.array_join(digits, "")).alias("codes")), "conversation-chunks")


def _summaries(chunks: DataFrame) -> DataFrame:
    """Chunks with the least costs between their border states, and their initials."""
    unit = np.where(np.eye(4, dtype=bool), 0, _FAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lengths, codes in _slices(batches):
            n = len(lengths)
            costs = least_costs(lengths, codes, np.broadcast_to(unit, (n, 4, 4)))
            bounds = np.r_[0, np.cumsum(lengths)]
            # (chunk, end state, start state); least_costs has the end states as vectors
            tables = costs[bounds[:-1] + np.arange(n)].reshape(n, 16)
            initial = codes & 3
            wrong = np.append(_wrong(initial[:-1], initial[1:]), False) if len(codes) else np.zeros(0, bool)
            wrong[bounds[1:] - 1] = False
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["first"], pa.array(initial[bounds[:-1]].astype(np.int32)),
                 pa.array(initial[bounds[1:] - 1].astype(np.int32)),
                 pa.array(np.add.reduceat(wrong.astype(np.int64), bounds[:-1])),
                 pa.FixedSizeListArray.from_arrays(pa.array(tables.ravel()), 16).cast(pa.list_(pa.int64()))],
                ["conv_id", "first", "head", "tail", "illegal", "costs"])

    kind = chunks.schema["conv_id"].dataType.simpleString()
    return chunks.mapInArrow(
        run, f"conv_id {kind}, first long, head int, tail int, illegal long, costs array<long>")


def _wrong(before, after):
    """Neighbours other than system-user, user-assistant, assistant-user."""
    return ~(((before == 1) & (after == 2)) | ((before == 2) & (after == 3)) | ((before == 3) & (after == 2)))


def _folded(summaries: DataFrame) -> DataFrame:
    """Per conversation: illegal neighbours, least cost, and each chunk's end costs.

    A conversation of n rows has about n / CHUNK summaries of some 200 bytes here.
    """
    collected = summaries.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("first", "head", "tail", "illegal", "costs"))).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            illegal, cost, ends = [], [], []
            for chunks in batch["chunks"].to_pylist():
                vectors, end = [], _CLOSE
                for c in reversed(chunks):
                    vectors.append({"first": c["first"], "ends": end.tolist()})
                    end = (np.array(c["costs"]).reshape(4, 4) + end[:, None]).min(axis=0)
                cost.append(int(end[0]))
                heads, tails = (np.array([c[k] for c in chunks]) for k in ("head", "tail"))
                borders = int(_wrong(tails[:-1], heads[1:]).sum())
                illegal.append(borders + sum(c["illegal"] for c in chunks))
                ends.append(vectors[::-1])
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], pa.array(illegal, pa.int64()), pa.array(cost, pa.int64()),
                 pa.array(ends, pa.list_(pa.struct([("first", pa.int64()), ("ends", pa.list_(pa.int64()))])))],
                ["conv_id", "illegal", "cost", "ends"])

    kind = summaries.schema["conv_id"].dataType.simpleString()
    return stage(collected.mapInArrow(
        run, f"conv_id {kind}, illegal long, cost long, ends array<struct<first:bigint,ends:array<bigint>>>"),
        "conversation-costs")


def _solved(chunks: DataFrame, folded: DataFrame) -> DataFrame:
    """Each chunk's audit and exit state for each entry state."""
    ends = folded.select(F.size("ends").alias("n"), F.posexplode("ends").alias("pos", "e")).select(
        F.col("e.first").alias("first"), F.col("e.ends").alias("ends"), (F.col("pos") == F.col("n") - 1).alias("closing"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lengths, codes in _slices(batches):
            ends_ = np.array(batch["ends"].to_pylist(), np.int64)
            closing = batch["closing"].to_numpy(zero_copy_only=False)
            letters, offsets, exits, _ = least_paths(lengths, codes, ends_, closing)
            audits = pa.StringArray.from_buffers(
                len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))
            four = pa.array(np.arange(0, len(offsets), 4, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["first"], pa.ListArray.from_arrays(four, pa.array(exits.astype(np.int32))),
                 pa.ListArray.from_arrays(four, audits)],
                ["conv_id", "first", "exits", "audits"])

    kind = chunks.schema["conv_id"].dataType.simpleString()
    return stage(
        chunks.join(ends, "first").select("conv_id", "first", "codes", "ends", "closing").mapInArrow(
            run, f"conv_id {kind}, first long, exits array<int>, audits array<string>"),
        "conversation-paths")


def _audits(solved: DataFrame) -> DataFrame:
    """conv_id, first, start state and audit of each chunk."""
    collected = solved.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("first", "exits"))).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, state = [], []
            for chunks in batch["chunks"].to_pylist():
                now = 0
                for c in chunks:
                    first.append(c["first"])
                    state.append(now)
                    now = c["exits"][now]
            yield pa.RecordBatch.from_arrays(
                [pa.array(first, pa.int64()), pa.array(state, pa.int32())], ["first", "state"])

    states = collected.select("chunks").mapInArrow(run, "first long, state int")
    return stage(
        solved.join(states, "first").select(
            "conv_id", "first", "state", F.get("audits", F.col("state")).alias("audit")), "conversation-audits")


def plan_repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For rows of ``ordered``: their faults, per conversation (illegal, cost), and chunk audits."""
    marked = faults(rows)
    chunks = _chunks(marked)
    folded = _folded(_summaries(chunks))
    return marked, folded, _audits(_solved(chunks, folded))


# ---- repaired rows ----


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, at, edit, role, text) of each edit; rows come sorted, a chunk's audit before its rows."""
    names = (None, "system", "user", "assistant")
    state, letters, at_letter, tail = 0, "", 0, 0
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("conv_id", "at", "audit", "state", "role", "text", "initial"))
        for conv_id, at, audit, start, role, text, initial in zip(*columns):
            if audit is not None:
                letters, at_letter, state = audit, 0, start
                tail = len(audit.rstrip("I"))  # inserts from there on stand behind the last row
                continue
            while letters[at_letter] == "I":
                state, at_letter = int(_NEXT[state]), at_letter + 1
                yield conv_id, at, "I", names[state], ""
            edit, at_letter = letters[at_letter], at_letter + 1
            if edit == "K":
                state = initial
                yield conv_id, at, edit, role, text
            elif edit == "R":
                state = int(_NEXT[state])
                yield conv_id, at, edit, names[state], text
            else:
                yield conv_id, at, edit, None, None
            while tail <= at_letter < len(letters):
                state, at_letter = int(_NEXT[state]), at_letter + 1
                yield conv_id, at, "I", names[state], ""


def _in_order(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Chunk audits and rows of each conversation in one partition, sorted: a stream."""
    lead = audits.select("conv_id", F.col("first").alias("at"), "audit", "state")
    both = rows.select("conv_id", "at", "role", "text", "initial").unionByName(lead, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at", F.col("audit").isNull())


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each edit with its row: conv_id, at, step (by conversation), edit, role and text (null: deleted)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, step, now = [], 0, object()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            kinds = [batch_kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "at", "step", "edit", "role", "text"])

        batch_kind, size = None, 0

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal batch_kind
            for batch in batches:
                batch_kind = batch.schema.field("conv_id").type
                yield batch

        for conv_id, at, edit, role, text in _replayed(seen()):
            step, now = (step + 1, now) if conv_id == now else (0, conv_id)
            out.append((conv_id, at, step, edit, role, text))
            size += 100 + len(text or "")
            if size > 4_000_000:
                yield flush()
                size = 0
        if out:
            yield flush()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _in_order(rows, audits).mapInArrow(
        run, f"conv_id {kind}, at long, step long, edit string, role string, text string")


def repaired_hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the lines ``role:text``.

    A conversation's hash is one chain over its lines, so one task reads them, as a sorted
    stream: what it holds at a time is a batch of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, done, now, chain, lines = None, [], None, None, 0

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        for conv_id, _, _, role, text in _replayed(seen()):
            if chain is None or conv_id != now:
                if chain is not None:
                    done.append((now, chain.hexdigest()))
                now, chain, lines = conv_id, hashlib.sha256(), 0
            if role is not None:
                chain.update((("\n" if lines else "") + role + ":" + text).encode())
                lines += 1
        if chain is not None:
            done.append((now, chain.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], ["conv_id", "repaired_sha256"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _in_order(rows, audits).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """One row per conversation: fault counts, least cost, audit and hash of the repaired lines.

    ``turns`` has conv_id, turn, role and text; other columns are not read. Null role and text
    are one space. A null conv_id is a conversation of its own, a null turn comes first and
    counts for no gap; rows of one turn go by role and then the text's MD5. A row is
    blank, else duplicate (role and text seen earlier), else truncated. ``originals`` may name further
    conversations (conv_id); one without rows has zeros, an empty audit and the empty hash.
    """
    rows = ordered(turns)
    marked, folded, audits = plan_repairs(rows)
    counts = [F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    by_turn = marked.groupBy("conv_id", "turn").agg(*counts)
    counted = by_turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(k).cast("long").alias(k) for k in ("blank", "duplicate", "truncated")))
    joined = audits.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("first", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    result = (originals if originals is not None else turns).select("conv_id").distinct()
    for part in (counted, folded.drop("ends"), joined, repaired_hashes(rows, audits)):
        part = part.withColumnRenamed("conv_id", "_conv")
        result = result.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zero = {k: F.coalesce(k, F.lit(0)).cast("long") for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return result.select(
        "conv_id", *(v.alias(k) for k, v in zero.items()), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op13(spark, sf_dir) -> DataFrame:
    turns = narrow(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return repair(damage(turns), turns)


ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM (SELECT *, xor(list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split(k, '')],
          lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)),
          4294967295::BIGINT) % 20 AS kind FROM keyed)
  WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
marked AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(final, '[.!?]') THEN 'truncated' END AS fault FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE fault = 'blank')::BIGINT AS blank,
         count(*) FILTER (WHERE fault = 'duplicate')::BIGINT AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated')::BIGINT AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal,
         max(i) AS n FROM marked GROUP BY conv_id),
inserts(q, q1, price, letters, lines) AS (VALUES
  (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:')),
steps(q1, letter, initial, q2, price, role) AS (VALUES
  (0, 'D', '', 0, 3, ''), (1, 'D', '', 1, 3, ''), (2, 'D', '', 2, 3, ''), (3, 'D', '', 3, 3, ''),
  (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''), (3, 'K', 'u', 2, 0, ''), (2, 'K', 'a', 3, 0, ''),
  (0, 'R', '', 2, 2, 'user'), (1, 'R', '', 2, 2, 'user'), (3, 'R', '', 2, 2, 'user'), (2, 'R', '', 3, 2, 'assistant')),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': ''} AS best, '' AS lines FROM counts
  UNION ALL
  SELECT conv_id, i, q, min(best), arg_min(lines, best) FROM (
    SELECT p.conv_id, m.i, s.q2 AS q,
           {'cost': (p.best.cost + x.price + s.price + CASE WHEN s.letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END)::BIGINT,
            'audit': p.best.audit || x.letters || s.letter} AS best,
           p.lines || x.lines || CASE s.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || m.role || ':' || m.text
             ELSE chr(10) || s.role || ':' || m.text END AS lines
    FROM paths p JOIN marked m ON m.conv_id = p.conv_id AND m.i = p.i + 1
    JOIN inserts x ON x.q = p.q
    JOIN steps s ON s.q1 = x.q1 AND (s.letter <> 'K' OR s.initial = m.initial)
    WHERE s.letter = 'D' OR fault IS NULL OR fault = 'truncated')
  GROUP BY conv_id, i, q),
ended AS (
  SELECT conv_id, min(best) AS best, arg_min(lines, best) AS lines FROM (
    SELECT p.conv_id, {'cost': p.best.cost + x.price, 'audit': p.best.audit || x.letters} AS best, p.lines || x.lines AS lines
    FROM paths p JOIN counts c ON c.conv_id = p.conv_id AND c.n = p.i JOIN inserts x ON x.q = p.q WHERE x.q1 IN (0, 3))
  GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
       coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts USING (conv_id) LEFT JOIN ended e USING (conv_id)"""

register("op13_conversations", op13, ORACLE)
