"""Repair of the order of roles in conversations, at the least cost.

Rows are read one after the other; each is one macro edit: a run of inserted
rows and then Keep, Rerole or Delete. As text (``IIK``) the macro edits form a
prefix-free code whose order is that of the audits, so two audits of the same
rows compare by their first different macro edit. The search therefore keeps,
for each state of the order of roles, a cost and the rank of its audit among
those of the layer in place of the audit, with a pointer to the macro edit and
state before; audits are written afterwards, from the pointers.

The same search from each of the four states gives a block of rows a table of
costs and ranks, and tables combine as blocks follow one another. A
conversation within one block is solved there. One that goes on into other
blocks, however long, is solved from the tables of its blocks, in groups of
FAN at most, and takes its audits from the blocks then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .order import numbered

#: Rows of a block; blocks or groups of blocks that one task combines.
BLOCK, FAN = 4096, 512

#: States of the order ``(s?(ua)+)?``: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: Rows to insert at the end so that a state is a legal end.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
WHITE = " \t\n\x0b\x0c\r"

_TURN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # where an inserted or reroled row leads
_CODES = sorted("I" * k + op for k in range(3) for op in "DKR")
_FAR = 1 << 40
_RANKS, _PLACES = 1 << 5, len(_CODES)


def _moves(initial: str, must_go: bool, cut_off: bool) -> list[list[tuple[int, int, int]]]:
    """For each state, the ways into it: state before, cost and place of the macro edit's code."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(4)]
    for before in range(4):
        for place, code in enumerate(_CODES):
            state, cost = before, INSERT * (len(code) - 1)
            for _ in code[:-1]:
                state = _TURN[state]
            if code[-1] == "D":
                out[state].append((before, cost + DELETE, place))
            elif not must_go:
                kept = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}.get(initial, {})
                to = _TURN[state] if code[-1] == "R" else kept.get(state)
                if to is not None:
                    out[to].append((before, cost + (REROLE if code[-1] == "R" else KEEP) + CUT_OFF * cut_off, place))
    return out


_ways: dict[tuple[str, bool, bool], list] = {}


def _ways_of(initial: str, must_go: bool, cut_off: bool) -> list:
    key = (initial if initial in ("s", "u", "a") else "", must_go, cut_off)
    if key not in _ways:
        _ways[key] = _moves(*key)
    return _ways[key]


def _ranked(keys: list[int]) -> list[int]:
    """Dense ranks."""
    places = {k: i for i, k in enumerate(sorted(set(keys)))}
    return [places[k] for k in keys]


def solve(rows: list[list], entry: int) -> tuple[list[int], list[int], list[list[tuple[int, int]]]]:
    """Costs, ranks and pointers of the search over rows (their ways) from a state on.

    A candidate is one number: cost, then the rank of the audit before, then
    the place of the code. Pointers are state before and place, by layer and state.
    """
    costs, ranks = [_FAR] * 4, [0] * 4
    costs[entry] = 0
    layers = []
    for ways in rows:
        best, back = [], []
        for into in ways:
            least, way = _FAR * _RANKS * _PLACES, (-1, -1)
            for before, cost, place in into:
                n = ((costs[before] + cost) * _RANKS + ranks[before]) * _PLACES + place
                if n < least:
                    least, way = n, (before, place)
            best.append(least)
            back.append(way)
        costs = [min(n // (_RANKS * _PLACES), _FAR) for n in best]
        ranks = _ranked([n % (_RANKS * _PLACES) for n in best])
        layers.append(back)
    return costs, ranks, layers


def audit(layers: list[list[tuple[int, int]]], state: int) -> str:
    """The edits that lead to a state, from the pointers."""
    out = []
    for back in reversed(layers):
        state, place = back[state]
        out.append(_CODES[place])
    return "".join(reversed(out))


def ending(costs: list[int], ranks: list[int]) -> tuple[int, int]:
    """State at the end and cost, with the rows inserted there."""
    cost, _, state = min((costs[s] + INSERT * len(TAIL[s]), ranks[s], s) for s in range(4))
    return state, cost


def chain(tables: list[tuple[list[int], list[int]]], entry: int) -> tuple[list[int], list[int], list[list[int]]]:
    """Like ``solve`` over blocks: tables are costs and ranks by entry and exit (4 x 4, flat); pointers are entries."""
    costs, ranks = [_FAR] * 4, [0] * 4
    costs[entry] = 0
    layers = []
    for by_cost, by_rank in tables:
        ways = [min((costs[s] + by_cost[4 * s + t], ranks[s], by_rank[4 * s + t], s) for s in range(4)) for t in range(4)]
        costs = [min(w[0], _FAR) for w in ways]
        order = sorted({w[1:3] for w in ways})
        ranks = [order.index(w[1:3]) for w in ways]
        layers.append([w[3] for w in ways])
    return costs, ranks, layers


def trace(layers: list[list[int]], state: int) -> list[tuple[int, int]]:
    """Entry and exit of each block."""
    out = []
    for back in reversed(layers):
        out.append((back[state], state))
        state = back[state]
    return out[::-1]


_RUN = "key string, rn long, block long, open boolean, audit string, cost long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, costs array<long>, ranks array<long>, audits array<string>"
_COLUMNS = [x.strip().split(" ")[0] for x in _RUN.split(", ")]


def _runs(key: tuple, rows: pd.DataFrame, firsts: pd.DataFrame) -> pd.DataFrame:
    """The rows of each conversation within a block: faults, and the solution or, at the block's edges, tables."""
    rows = rows.sort_values("rn")
    rows["repeat"] = ~rows["blank"] & ~rows["rn"].isin(firsts["rn"])
    keys, out = rows["key"].to_numpy(), []
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    ghost, *faults = (rows[c].tolist() for c in ("ghost", "blank", "repeat", "off", "initial", "turn"))
    at = rows["rn"].to_numpy()
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        is_open = i == 0 or b == len(keys)
        blank, repeat, off, initials, turns = ([x for x, g in zip(c[a:b], ghost[a:b], strict=True) if not g] for c in faults)
        off = [o and not x and not r for o, x, r in zip(off, blank, repeat, strict=True)]
        ways = [_ways_of(t, x or r, o) for t, x, r, o in zip(initials, blank, repeat, off, strict=True)]
        turns = [int(t) for t in turns if t == t and t is not None]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
        text, cost, tables = None, None, (None, None, None)
        if is_open:
            solved = [solve(ways, s) for s in range(4)]
            audits = [audit(layers, t) if costs[t] < _FAR else None for costs, _, layers in solved for t in range(4)]
            tables = ([c for costs, _, _ in solved for c in costs], [r for _, ranks, _ in solved for r in ranks], audits)
        else:
            costs, ranks, layers = solve(ways, START)
            state, cost = ending(costs, ranks)
            text = audit(layers, state) + TAIL[state]
        low, high = (turns[0], turns[-1]) if turns else (None, None)
        out.append((keys[a], int(at[a]), key[0], is_open, text, cost, sum(blank), sum(repeat), sum(off), illegal, *((initials[0], initials[-1]) if initials else (None, None)), low, high, len(set(turns)), *tables))
    frame = pd.DataFrame(out, columns=_COLUMNS)
    return frame.astype({"cost": "Int64", "low": "Int64", "high": "Int64"})


def _combined(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """The table of a group of blocks."""
    part = part.sort_values("block")
    tables = list(zip(part["costs"], part["ranks"], strict=True))
    solved = [chain(tables, s) for s in range(4)]
    return pd.DataFrame({"key": [key[0]], "block": [key[1]], "costs": [[c for costs, _, _ in solved for c in costs]], "ranks": [[r for _, ranks, _ in solved for r in ranks]]})


_STATES = "key string, block long, entry int, exit int, total long"


def _walk(part: pd.DataFrame, entry: int, end: int | None, total: int | None) -> pd.DataFrame:
    """Entry and exit of each block of a group; the group's total stands at its last block."""
    part = part.sort_values("block")
    costs, ranks, layers = chain(list(zip(part["costs"], part["ranks"], strict=True)), entry)
    if end is None:
        end, total = ending(costs, ranks)
    steps = trace(layers, end)
    frame = pd.DataFrame({"key": part["key"], "block": part["block"], "entry": [a for a, _ in steps], "exit": [b for _, b in steps], "total": [None] * (len(part) - 1) + [total]})
    return frame.astype({"total": "Int64"})


def _states(tables: DataFrame, fan: int) -> DataFrame:
    """``(key, block, entry, exit, total)`` for the blocks of each conversation; total at the last one alone."""
    grouped = tables.select("key", "block", "costs", "ranks").withColumn("above", F.floor(F.col("block") / F.lit(fan)))
    if grouped.groupBy("key").agg((F.min("above") < F.max("above")).alias("several")).where("several").isEmpty():
        return grouped.groupBy("key").applyInPandas(lambda part: _walk(part, START, None, None), _STATES)
    upper = cut(grouped.groupBy("key", "above").applyInPandas(_combined, "key string, block long, costs array<long>, ranks array<long>"), "combined")

    def down(_: tuple, part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        k = known.iloc[0]
        return _walk(part, int(k["entry"]), int(k["exit"]), None if pd.isna(k["total"]) else int(k["total"]))

    return grouped.groupBy("key", "above").cogroup(_states(upper, fan).groupBy("key", "block")).applyInPandas(down, _STATES)


class _Repair:
    """One conversation, row by row: its faults, its audit and the hash of what it is repaired to."""

    def __init__(self, key):
        self.key, self.conv_id, self.hash, self.empty, self.state = key, None, hashlib.sha256(), True, START
        self.audits, self.edits, self.at = [], "", 0
        self.counts, self.cost, self.last, self.low, self.high, self.turns = [0] * 4, 0, None, None, None, 0

    def run(self, r: dict) -> None:
        self.inserts()
        self.audits.append(r["audit"])
        self.edits, self.at = r["audit"], 0
        between = self.last is not None and r["first"] is not None and self.last + r["first"] not in ("su", "ua", "au")
        self.counts = [x + r[c] for x, c in zip(self.counts, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
        self.counts[3] += between
        self.last = self.last if r["last"] is None else r["last"]
        self.cost += r["cost"] or 0
        if r["low"] is not None:
            self.turns += r["turns"] - (self.high == r["low"])
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]

    def write(self, role: str, text: str) -> None:
        if not self.empty:
            self.hash.update(b"\n")
        self.empty = False
        self.hash.update(f"{role}:{text}".encode())

    def turn(self, text: str) -> None:
        """A row of the role that is due."""
        self.state = _TURN[self.state]
        self.write("user" if self.state == USER else "assistant", text)

    def inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            self.turn("")

    def row(self, role: str, text: str) -> None:
        self.inserts()
        op = self.edits[self.at]
        self.at += 1
        if op == "R":
            self.turn(text)
        elif op == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            self.write(role, text)

    def result(self) -> tuple:
        self.inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts, self.cost, "".join(self.audits), self.hash.hexdigest())


_FIELDS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_KINDS = [pa.int64()] * 6 + [pa.string()] * 2


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Faults and cheapest repair of each conversation of ``rows(conv_id, turn, role, text, ghost)``.

    Rows are taken by turn, nulls first, then role and text; a ghost only says
    that its conversation exists. Role and text are not null. A conversation
    without rows but ghosts gives zeros and an empty audit; rows without a
    conv_id are one conversation; repeated rows are rows, found as duplicates.
    No rows give none. Memory: a block's rows without texts, and what the audit
    of a conversation takes; texts pass one after the other through the hash
    of their conversation, which no two tasks can share.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    arrow_kind = pa.string() if kind == "string" else pa.int64()
    keyed = rows.select(F.coalesce(F.concat(F.lit("1"), F.col("conv_id").cast("string")), F.lit("0")).alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "ghost")
    placed = numbered(keyed, "key", "turn", "role", "text", "ghost", name="turns")
    block_of = F.floor(F.col("rn") / F.lit(block)).alias("block")
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    seen = placed.select(block_of, "rn", "key", "ghost", F.substring("role", 1, 1).alias("initial"), "turn", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("off"))
    name = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = placed.where(~F.col("ghost") & (end != "")).groupBy("key", F.unhex(name).alias("name")).agg(F.min("rn").alias("rn")).select(block_of, "rn")
    runs = cut(seen.groupBy("block").cogroup(firsts.groupBy("block")).applyInPandas(_runs, _RUN), "runs")
    states = _states(runs.where("open"), fan)
    tail = F.element_at(F.array(*[F.lit(TAIL[s]) for s in range(4)]), F.col("exit") + 1)
    chosen = F.concat(F.element_at("audits", F.col("entry") * 4 + F.col("exit") + 1), F.when(F.col("total").isNotNull(), tail).otherwise(""))
    plain = ["blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns"]
    opened = runs.where("open").join(states, ["key", "block"]).select("key", "rn", chosen.alias("audit"), F.col("total").alias("cost"), *plain)
    told = runs.where("not open").select("key", "rn", "audit", "cost", *plain).unionByName(opened).withColumn("tag", F.lit(0))
    both = told.unionByName(placed.select("key", "rn", F.lit(1).alias("tag"), "conv_id", "role", "text", "ghost"), allowMissingColumns=True)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for r in b.to_pylist():
                if now is None or now.key != r["key"]:
                    if now is not None:
                        done.append(now.result())
                    now = _Repair(r["key"])
                if r["tag"] == 0:
                    now.run(r)
                else:
                    now.conv_id = r["conv_id"]
                    if not r["ghost"]:
                        now.row(r["role"], r["text"])
            if done:
                yield batch(done)
        if now is not None:
            yield batch([now.result()])

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), [arrow_kind, *_KINDS], strict=True)], _FIELDS)

    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return both.repartition("key").sortWithinPartitions("key", "rn", "tag").mapInArrow(stream, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with damage by crc32 of ``conv_id:turn``, nulls taken as one space.

    Of twenty remainders 0 makes a row a ghost, 1 empties its text, 2 takes
    its ``.``, ``!`` and ``?``, 3 repeats it and 4 makes its role user. Other
    columns are left out.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k").isin(0, 1), "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") == 0).alias("ghost"), copies.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same for DuckDB: a recursion over rows that keeps the least cost and audit for each state, and what it writes."""
    made = {START: ("user:", "assistant:"), SYSTEM: ("user:", "assistant:"), USER: ("assistant:", "user:"), ASSISTANT: ("user:", "assistant:")}
    inserted = lambda state, k: "".join(x + "~" for x in made[state][:k])
    ways = []
    for initial in ("s", "u", "a", ""):
        for must_go in (False, True):
            for off in (False, True):
                for to, into in enumerate(_moves(initial, must_go, off)):
                    for before, cost, place in into:
                        code = _CODES[place]
                        role = {USER: "user", ASSISTANT: "assistant"}.get(to, "") if code[-1] == "R" else ""
                        ways.append(f"('{initial}', {must_go}, {off}, {before}, {to}, {cost}, '{code}', '{inserted(before, len(code) - 1)}', '{code[-1]}', '{role}')")
    ends = ", ".join(f"({s}, {INSERT * len(t)}, '{t}', '{inserted(s, len(t))}')" for s, t in TAIL.items())
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split_regex(regexp_replace(hex(k::blob), '(..)', '\\1 ', 'g').trim(), ' '), lambda h: [('0x' || h)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295)"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    with recursive c as (
      select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce('1' || conv_id, '0') as key, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
    h as (select *, {crc} % 20 as hit from c),
    d as (
      select key, conv_id, turn, case when hit = 4 then 'user' else role end as role,
        case when hit = 1 then '' when hit = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
      from (select *, unnest(case when hit = 0 then [] when hit = 3 then [0, 1] else [0] end) as copy from h)),
    n as (select *, row_number() over (partition by key order by turn nulls first, role, text) as i, right(rtrim(text, {white}), 1) as last, left(role, 1) as initial from d),
    f as (select *, last = '' as blank, last <> '' and row_number() over (partition by key, role, text order by i) > 1 as repeat from n),
    g as (select *, not blank and not repeat and last not in ('.', '!', '?') as off, lag(initial) over (partition by key order by i) || initial as pair from f),
    counts as (
      select key, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (blank) as blank, count(*) filter (repeat) as duplicate,
        count(*) filter (off) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, max(i) as size from g group by key),
    ways(initial, must_go, off, before, state, cost, code, ins, op, role) as (values {", ".join(ways)}),
    layer as (
      select distinct key, 0::bigint as i, 0 as state, {{'cost': 0::bigint, 'audit': '', 'lines': ''}} as best from c
      union all
      select l.key, g.i, w.state, min({{'cost': l.best.cost + w.cost, 'audit': l.best.audit || w.code, 'lines': l.best.lines || replace(w.ins, '~', chr(10)) ||
        case w.op when 'K' then g.role || ':' || g.text || chr(10) when 'R' then w.role || ':' || g.text || chr(10) else '' end}}) as best
      from layer l join g on g.key = l.key and g.i = l.i + 1
        join ways w on w.before = l.state and w.initial = case when g.initial in ('s', 'u', 'a') then g.initial else '' end and w.must_go = (g.blank or g.repeat) and w.off = g.off
      group by l.key, g.i, w.state),
    ends(state, cost, code, ins) as (values {ends}),
    final as (
      select l.key, min({{'cost': best.cost + e.cost, 'audit': best.audit || e.code, 'lines': best.lines || replace(e.ins, '~', chr(10))}}) as best
      from layer l join ends e using (state) left join counts using (key) where l.i = coalesce(counts.size, 0) group by l.key)
    select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
      best.cost as cost, best.audit as audit, sha256(case when best.lines = '' then '' else left(best.lines, -1) end) as repaired_sha256
    from (select distinct key, conv_id from c) left join counts using (key) join final using (key)
    """


ORACLE = _sql()
