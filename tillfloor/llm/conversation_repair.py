"""Conversation structure repair: the cheapest edits that make roles read (s?(ua)+)?, ties by the least audit.

Each row is kept, given another role, or deleted, and rows without text are inserted; the initials of these edits, in
order, are the audit. The search goes over rows with four states (the role before: none, s, u, a) and is persistent:
the prefix of edits behind a state is a linked node with its parent, binary-lifting ancestors and a rolling hash, so states share
what they have in common. Two prefixes of equal cost are compared at their longest common prefix, found by lifting on hashes;
where hashes meet in different nodes, the labels behind them are compared too.

Inserts stand right before a kept or renamed row or at the end: before a deleted row the audit would be greater. One insert
before a row is enough, since a second one leads back to where the first started at a higher cost.

Conversations of at most `block` rows and `LONG_BYTES` of text are repaired whole, sorted by Spark and read as a stream. A
longer one is cut into blocks of `block` places. A block's search is run from each state, and gives
cost and rank of the least audit from state to state; the search over blocks is the same, with ranks for labels; each block
then repeats its search between the states chosen. Rows equal in turn, role and text are one row with a count.
What one task holds is a block, or a few numbers a block of one conversation, which is less than its audit. The hash of
one repaired conversation is one stream by definition: its rows pass through one task, sorted, a batch at a time.

Rows are ordered by turn, nulls first, then role and text. A null text or role, or part of the damage key, is one space. A null
conversation id is one conversation. Equal rows are repeats, the first of them counts. An empty table has no
conversations. Columns other than id, turn, role and text are not read. A null turn is no gap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillfloor.llm.common import stage

BLOCK = 4096
LONG_BYTES = 32 << 20
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
LEGAL = {"su", "ua", "au"}
NAMES = {AFTER_U: "user", AFTER_A: "assistant"}
#: What is added at the end, and its cost, to leave a state.
ENDING = {START: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROW = ["conv", "turn", "role", "text"]


# --- one row's edits


def following(state: int) -> int:
    """The state after the only role that may be inserted or given next."""
    return AFTER_A if state == AFTER_U else AFTER_U


def kept(state: int, initial: str) -> int | None:
    """The state after keeping a row of this role, where that is allowed."""
    if initial == "s":
        return AFTER_S if state == START else None
    to = following(state)
    return to if initial == "ua"[to - AFTER_U] else None


def _edits(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """For each state: (state after, cost, label) of the cheapest edits of one row, the least label among equals."""
    out = []
    for state in range(4):
        ways: dict[int, tuple[int, str]] = {state: (DELETE, "D")}
        if not must_go:
            more = TRUNCATED * truncated
            for label, at in (("", state), ("I", following(state))):
                base = more + INSERT * len(label)
                for to, cost, edit in ((kept(at, initial), KEEP, "K"), (following(at), REROLE, "R")):
                    if to is not None:
                        way = (base + cost, label + edit)
                        ways[to] = min(ways.get(to, way), way)
        out.append([(to, cost, label) for to, (cost, label) in ways.items()])
    return out


_known: dict[tuple[str, bool, bool], list] = {}


def edits(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[int, int, str]]]:
    key = (initial if initial in ("s", "u", "a") and not must_go else "", must_go, truncated and not must_go)
    if key not in _known:
        _known[key] = _edits(*key)
    return _known[key]


def deletions(times: int) -> list[list[tuple[int, int, str]]]:
    return [[(state, DELETE * times, "D" * times)] for state in range(4)]


# --- prefixes of edits


class Prefixes:
    """Prefixes as nodes of a tree: parent, label, hash, and ancestors 1, 2, 4, ... steps up."""

    MOD, BASE = (1 << 61) - 1, 0x1F3D5B79A
    ROOT = 0

    def __init__(self) -> None:
        self.ups: list[list[int]] = [[]]
        self.labels: list = [""]
        self.hashes = [0]

    def add(self, parent: int, label) -> int:
        node = len(self.ups)
        ups = [parent]
        while len(ups) <= len(self.ups[ups[-1]]):
            ups.append(self.ups[ups[-1]][len(ups) - 1])
        self.ups.append(ups)
        self.labels.append(label)
        self.hashes.append((self.hashes[parent] * self.BASE + self.code(label)) % self.MOD)
        return node

    @staticmethod
    def code(label) -> int:
        return hash(label) + 7 if isinstance(label, int) else int.from_bytes(label[:8].encode(), "big") * 31 + len(label)

    def first_difference(self, a: int, b: int) -> tuple[int, int] | None:
        """Where two prefixes of equally many labels first differ: the node of each; None if they are equal."""
        if a == b:
            return None
        at, bt = a, b
        if self.hashes[a] != self.hashes[b]:
            for k in reversed(range(len(self.ups[a]))):
                if k < len(self.ups[at]):
                    x, y = self.ups[at][k], self.ups[bt][k]
                    if self.hashes[x] != self.hashes[y]:
                        at, bt = x, y
            found = (at, bt)
            at, bt = self.ups[at][0], self.ups[bt][0]
        else:
            found = None
        while at != bt:  # equal hashes, different nodes: compare what is behind them
            if self.labels[at] != self.labels[bt]:
                found = (at, bt)
            at, bt = self.ups[at][0], self.ups[bt][0]
        return found

    def less(self, a: int, label_a, b: int, label_b) -> bool:
        """Whether prefix a, then label_a, comes before prefix b, then label_b."""
        if differ := self.first_difference(a, b):
            return self.labels[differ[0]] < self.labels[differ[1]]
        return label_a < label_b

    def path(self, node: int) -> list:
        out = []
        while node != self.ROOT:
            out.append(self.labels[node])
            node = self.ups[node][0]
        return out[::-1]


def search(steps: Iterable[list], start: int, prefixes: Prefixes) -> dict[int, tuple[int, int]]:
    """{state: (least cost, node of the least labels)} from one state over steps[state] = (to, cost, label)."""
    best = {start: (0, Prefixes.ROOT)}
    for step in steps:
        found: dict[int, tuple] = {}
        for state, (cost, node) in best.items():
            for to, more, label in step[state]:
                old = found.get(to)
                if old is None or cost + more < old[0] or (
                    cost + more == old[0] and prefixes.less(node, label, old[1], old[2])
                ):
                    found[to] = (cost + more, node, label)
        best = {to: (cost, prefixes.add(node, label)) for to, (cost, node, label) in found.items()}
    return best


def ended(best: dict[int, tuple[int, int]], prefixes: Prefixes) -> tuple[int, int, int]:
    """(cost, node, state) of the cheapest whole audit; its ending follows from the state."""
    out = None
    for state, (cost, node) in best.items():
        cost += INSERT * len(ENDING[state])
        if out is None or cost < out[0] or (cost == out[0] and prefixes.less(node, "", out[1], "")):
            out = (cost, node, state)
    return out


def replay(label: str, state: int, initial: str, role: str) -> tuple[int, str | None, str | None]:
    """(state after, role inserted before, role of the row or None) of one row's edits."""
    inserted = None
    if label[0] == "I":
        state = following(state)
        inserted = NAMES[state]
    if label[-1] == "D":
        return state, None, None
    if label[-1] == "R":
        state = following(state)
        return state, inserted, NAMES[state]
    return kept(state, initial), inserted, role


# --- one conversation, or one block of it


class Tally:
    """Counts over ordered rows (turn, role, n, blank, first, cut): faults, gaps and illegal neighbours, and their steps."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last_turn = self.last = self.first = None
        self.steps: list[list] = []
        #: For each step, the row it belongs to, or None for deleted repeats.
        self.of: list[int | None] = []

    def add(self, i: int, turn: int | None, role: str, n: int, blank: bool, first: bool, cut: bool) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += n - 1  # no role may follow itself
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last_turn
            self.high = self.last_turn = turn
        if blank:
            self.blank += n
        else:
            self.duplicate += n - first
            self.truncated += first and cut
        whole = first and not blank
        self.steps.append(edits(initial, not whole, cut))
        self.of.append(i)
        if n > 1:
            self.steps.append(deletions(n - 1))
            self.of.append(None)

    def counts(self) -> tuple:
        return self.blank, self.duplicate, self.truncated, self.illegal

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def repaired(rows: list[tuple]) -> tuple:
    """The result of one conversation from its ordered rows (turn, role, text, n)."""
    tally, seen = Tally(), set()
    for i, (turn, role, text, n) in enumerate(rows):
        bare = text.strip(SPACE)
        tally.add(i, turn, role, n, not bare, (role, text) not in seen, bare[-1:] not in tuple(".!?"))
        seen.add((role, text))
    prefixes = Prefixes()
    cost, node, last = ended(search(tally.steps, START, prefixes), prefixes)
    labels = prefixes.path(node)
    lines, state = [], START
    for label, i in zip(labels, tally.of, strict=True):
        if i is not None:
            _, role, text, _ = rows[i]
            state, inserted, out = replay(label, state, role[:1], role)
            lines += [f"{inserted}:"] * (inserted is not None) + [f"{out}:{text}"] * (out is not None)
    for _ in ENDING[last]:
        state = following(state)
        lines.append(f"{NAMES[state]}:")
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return tally.gaps(), *tally.counts(), cost, "".join(labels) + ENDING[last], digest


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, rows) of a stream of batches sorted by conversation; rows with n = 0 only name it."""
    name, rows, any_ = None, [], False
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if any_ and conv != name:
                yield name, rows
                rows = []
            name, any_ = conv, True
            if row[-1]:
                rows.append(tuple(row))
    if any_:
        yield name, rows


def _repaired_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, out = None, []
    for batch in batches:
        schema = batch.schema
        break
    else:
        return

    def all_() -> Iterator[pa.RecordBatch]:
        yield batch
        yield from batches

    kinds = [schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv", *(x.split()[0] for x in RESULT.split(","))]

    def flushed() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for conv, rows in conversations(all_()):
        out.append((conv, *repaired(rows)))
        if len(out) == 256:
            yield flushed()
            out.clear()
    if out:
        yield flushed()


# --- damage


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, turn, role, text, n) of every row: n is 0 for a dropped and 2 for a repeated one."""
    blank = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank)
    )
    rows = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("harm"),
    )
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def undamaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The same columns of rows as they are."""
    return rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).cast("long").alias("n"),
    )


def repair(rows: DataFrame, block: int = BLOCK, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row a conversation of (conv, turn, role, text, n): conv and the columns of RESULT."""
    kind = rows.schema["conv"].dataType.simpleString()
    sizes = rows.groupBy("conv").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 0, F.octet_length("text"))).alias("bytes")
    )
    long = stage(sizes.filter((F.col("rows") > block) | (F.col("bytes") > long_bytes)).select(F.col("conv").alias("long")))
    is_long = F.col("conv").eqNullSafe(F.col("long"))
    some = not long.isEmpty()
    short = rows.join(long, is_long, "left_anti") if some else rows
    whole = short.repartition("conv").sortWithinPartitions(*ROW).mapInArrow(_repaired_whole, f"conv {kind}, {RESULT}")
    return whole.union(_repaired_in_blocks(rows.join(long, is_long, "left_semi"), kind, block)) if some else whole


# --- long conversations

SUMMARY = (
    "blank long, duplicate long, truncated long, illegal long, turns long, low string, high string, first string, last string, "
    "costs array<long>, ranks array<long>"
)
FLAGS = ["turn", "timed", "role", "n", "blank", "first", "cut"]


def _tallied(frame) -> Tally:
    tally = Tally()
    for i, (turn, timed, role, n, blank, first, cut) in enumerate(zip(*(frame[c].tolist() for c in FLAGS), strict=True)):
        tally.add(i, turn if timed else None, role, n, blank, first, cut)
    return tally


def _name(key):
    """The conversation of a group; pandas reads a null number as NaN."""
    return None if key[0] != key[0] else key[0]


def _block_summary(key, frame):
    """One block: its counts, and cost and rank of the best way from each state to each (-1: none)."""
    import pandas as pd
    from functools import cmp_to_key

    tally = _tallied(frame.sort_values("pos"))
    costs, ranks = [-1] * 16, [-1] * 16
    for start in range(4):
        prefixes = Prefixes()
        best = search(tally.steps, start, prefixes)
        order = cmp_to_key(lambda x, y: -1 if prefixes.less(best[x][1], "", best[y][1], "") else 1)  # noqa: B023
        for rank, to in enumerate(sorted(best, key=order)):
            costs[4 * start + to], ranks[4 * start + to] = best[to][0], rank
    low, high = (None if x is None else str(x) for x in (tally.low, tally.high))
    row = (_name(key), key[1], *tally.counts(), tally.turns, low, high, tally.first, tally.last, costs, ranks)
    names = ["conv", "block", *(x.split()[0] for x in SUMMARY.split(", "))]
    return pd.DataFrame([dict(zip(names, row, strict=True))], dtype=object)


def _ways(key, frame):
    """The blocks of one conversation: the states before and after each, and the counts over all."""
    import pandas as pd

    frame = frame.sort_values("block")
    steps = [
        [[(to, int(costs[4 * s + to]), int(ranks[4 * s + to])) for to in range(4) if costs[4 * s + to] >= 0] for s in range(4)]
        for costs, ranks in zip(frame["costs"], frame["ranks"], strict=True)
    ]
    prefixes = Prefixes()
    cost, node, last = ended(search(steps, START, prefixes), prefixes)
    turns, illegal = int(frame["turns"].sum()), int(frame["illegal"].sum())
    before_turn = before = None
    low = None
    for first, end, a, b in zip(frame["first"], frame["last"], frame["low"], frame["high"], strict=True):
        illegal += before is not None and before + first not in LEGAL
        before = end
        if isinstance(a, str):  # the turn that ends a block may go on in the next
            turns -= before_turn is not None and int(a) == before_turn
            low, before_turn = int(a) if low is None else low, int(b)
    gaps = 0 if low is None else before_turn - low + 1 - turns
    state, out = START, []
    for step, rank, block in zip(steps, prefixes.path(node), frame["block"], strict=True):
        to = next(to for to, _, r in step[state] if r == rank)
        out.append((_name(key), int(block), state, to, gaps, illegal, cost, False))
        state = to
    out[-1] = (*out[-1][:-1], True)
    return pd.DataFrame(out, columns=["conv", "block", "from_", "to_", "gaps", "illegal", "cost", "end"])


def _block_edits(key, frame):
    """The edits of each row of a block between its two chosen states."""
    import pandas as pd

    frame = frame.sort_values("pos")
    tally = _tallied(frame)
    state, to = int(frame["from_"].iloc[0]), int(frame["to_"].iloc[0])
    prefixes = Prefixes()
    labels = prefixes.path(search(tally.steps, state, prefixes)[to][1])
    out = []
    for label, i in zip(labels, tally.of, strict=True):
        if i is None:
            out[-1][1] += label
        else:
            role = frame["role"].iloc[i]
            state, inserted, kept_as = replay(label, state, role[:1], role)
            out.append([int(frame["pos"].iloc[i]), label, inserted, kept_as])
    if bool(frame["end"].iloc[0]) and ENDING[to]:
        roles = ["user", "assistant"][-len(ENDING[to]):]
        out.append([None, ENDING[to], roles[0] if len(roles) == 2 else None, roles[-1]])
    result = pd.DataFrame(out, columns=["pos", "label", "inserted", "kept_as"])
    result.insert(0, "block", key[1])
    result.insert(0, "conv", [_name(key)] * len(result))
    return result


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, sha256) of lines sorted by conversation and place: a stream, one hash state at a time."""
    name, state, kind = None, None, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or conv != name:
                if state is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([state.hexdigest()])], names=["conv", "sha"])
                name, state = conv, hashlib.sha256(line.encode())
            else:
                state.update(b"\n" + line.encode())
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([state.hexdigest()])], names=["conv", "sha"])


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def _repaired_in_blocks(rows: DataFrame, kind: str, block: int) -> DataFrame:
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = rows.filter("n > 0").groupBy(*ROW).agg(F.sum("n").alias("n"))
    # ranges are dealt in order, so the running id follows the order of the rows
    placed = stage(
        one.repartitionByRange(parts, *ROW).sortWithinPartitions(*ROW).withColumn("pos", F.monotonically_increasing_id())
    )
    firsts = placed.groupBy("conv", "role", F.sha2("text", 256).alias("sha")).agg(F.min("pos").alias("pos"))
    flagged = placed.select(
        "conv", "pos", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("timed"), "role", "n",
        (_bare(F.col("text")) == "").alias("blank"),
        (~F.right(_bare(F.col("text")), F.lit(1)).isin(*".!?")).alias("cut"), F.expr(f"pos div {block}").alias("block"),
    )
    facts = stage(flagged.join(firsts.select("pos", F.lit(True).alias("first")), "pos", "left").fillna(False, ["first"]))
    key = f"conv {kind}, block long"
    summaries = stage(facts.groupBy("conv", "block").applyInPandas(_block_summary, f"{key}, {SUMMARY}"))
    ways = stage(summaries.groupBy("conv").applyInPandas(
        _ways, f"{key}, from_ int, to_ int, gaps long, illegal long, cost long, end boolean"
    ))
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("block") == F.col("block_"))
    chosen = ways.select(F.col("conv").alias("conv_"), F.col("block").alias("block_"), "from_", "to_", "end")
    edited = stage(
        facts.join(chosen, same).drop("conv_", "block_").groupBy("conv", "block")
        .applyInPandas(_block_edits, f"{key}, pos long, label string, inserted string, kept_as string")
    )
    placed_edits = edited.groupBy("conv", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct(F.coalesce("pos", F.lit((1 << 63) - 1)).alias("pos"), "label"))), lambda x: x["label"]), "").alias("label")
    )
    audits = placed_edits.groupBy("conv").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "label"))), lambda x: x["label"]), "").alias("audit")
    )
    texts = edited.filter("kept_as is not null").join(placed.select("pos", "text"), "pos", "left")
    line = F.concat(
        F.coalesce(F.concat("inserted", F.lit(":\n")), F.lit("")), "kept_as", F.lit(":"), F.coalesce("text", F.lit(""))
    )
    shas = (
        texts.select("conv", line.alias("line"), F.coalesce("pos", F.lit((1 << 63) - 1)).alias("pos"))
        .repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "line")
        .mapInArrow(_hashed, f"conv {kind}, sha string")
    )
    totals = summaries.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    out = ways.filter("end").select("conv", "gaps", "illegal", "cost")
    for more in (totals, audits, shas):
        more = more.withColumnRenamed("conv", "conv_")
        out = out.join(more, F.col("conv").eqNullSafe(F.col("conv_")), "left").drop("conv_")
    names = [x.split()[0] for x in RESULT.split(",")]
    return out.withColumn("repaired_sha256", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest()))).select("conv", *names)


def repaired_conversations(rows: DataFrame, block: int = BLOCK, conv_col: str = "conv_id") -> DataFrame:
    """The registered result: damage, then repair, one row a conversation."""
    return repair(damaged(rows, conv_col), block).withColumnRenamed("conv", conv_col)


# DuckDB: checksums by table, then the search as a recursion over rows that keeps the least (cost, audit) of each state
ORACLE = r"""
with recursive crc_table as (
  select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as bytes
  from conversations
), harmed as (
  select * exclude (bytes, t), xor(list_reduce(list_concat([4294967295::bigint], bytes),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as harm
  from given, crc_table
), after_ as (
  select conv_id, turn, if(harm = 4, 'user', role) as role,
    case harm when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from harmed, range(if(harm = 0, 0, if(harm = 3, 2, 1))) as copies(x)
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, substr(role, 1, 1) as initial
  from after_
), faults as (
  select *, case when regexp_full_match(text, '[\x20\x09-\x0D]*') then 'blank'
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' end as fault,
    lag(initial) over (partition by conv_id order by i) || initial as pair
  from placed
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) as n,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id
), edit(s, e, need, cost, label) as (
  values (0, 0, '*', 4, 'D'), (1, 1, '*', 4, 'D'), (2, 2, '*', 4, 'D'), (3, 3, '*', 4, 'D'), (0, 1, 's', 0, 'K'),
    (0, 2, 'u', 0, 'K'), (1, 2, 'u', 0, 'K'), (3, 2, 'u', 0, 'K'), (2, 3, 'a', 0, 'K'), (2, 2, 'u', 3, 'IK'), (0, 3, 'a', 3, 'IK'),
    (1, 3, 'a', 3, 'IK'), (3, 3, 'a', 3, 'IK'), (0, 2, 'r', 3, 'R'), (1, 2, 'r', 3, 'R'), (3, 2, 'r', 3, 'R'), (2, 3, 'r', 3, 'R'),
    (0, 3, 'r', 6, 'IR'), (1, 3, 'r', 6, 'IR'), (3, 3, 'r', 6, 'IR'), (2, 2, 'r', 6, 'IR')
), named(s, label, line, then_) as (
  values (0, 'I', 'user', 'assistant'), (1, 'I', 'user', 'assistant'), (2, 'I', 'assistant', 'user'), (3, 'I', 'user', 'assistant')
), walk as (
  select conv_id, 0::bigint as i, 0 as s, '0000000000' as way, '' as body from counts
  union all
  select f.conv_id, f.i, e.e,
    min(lpad((left(w.way, 10)::bigint + e.cost + if(e.label <> 'D' and fault = 'truncated', 3, 0))::varchar, 10, '0') || substr(w.way, 11) || e.label),
    arg_min(w.body || case e.label when 'D' then '' when 'K' then chr(10) || f.role || ':' || f.text when 'R' then chr(10) || m.line || ':' || f.text
        when 'IK' then chr(10) || m.line || ':' || chr(10) || f.role || ':' || f.text
        else chr(10) || m.line || ':' || chr(10) || m.then_ || ':' || f.text end,
      lpad((left(w.way, 10)::bigint + e.cost + if(e.label <> 'D' and fault = 'truncated', 3, 0))::varchar, 10, '0') || substr(w.way, 11) || e.label)
  from walk w join faults f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1 join edit e on e.s = w.s join named m on m.s = w.s
  where e.need = '*' or (coalesce(fault, '') not in ('blank', 'duplicate') and e.need in ('r', f.initial))
  group by f.conv_id, f.i, e.e
), ended as (
  select c.conv_id, lpad((left(way, 10)::bigint + z.cost)::varchar, 10, '0') || substr(way, 11) || z.label as way, body || z.tail as body
  from walk w join counts c on c.conv_id is not distinct from w.conv_id and c.n = w.i
  join (values (0, 0, '', ''), (3, 0, '', ''), (2, 3, 'I', chr(10) || 'assistant:'), (1, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')) as z(s, cost, label, tail) using (s)
), best as (
  select conv_id, min(way) as way, arg_min(body, way) as body from ended group by conv_id
)
select g.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(left(way, 10)::bigint, 0) as cost,
  coalesce(substr(way, 11), '') as audit, sha256(coalesce(substr(body, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) g
left join counts c on c.conv_id is not distinct from g.conv_id left join best b on b.conv_id is not distinct from g.conv_id
"""
