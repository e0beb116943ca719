"""Repair of conversations: the cheapest edits that give alternating turns, found by the auction shortest-path algorithm."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructType

from tradewind.llm.store import running, stored

#: States of what has been kept so far: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Fixed costs of the edits.
DELETE, REROLE, INSERT, OPEN_END = 2, 1, 5, 5
NEVER = 1 << 50
#: Cost from each state at the end of a conversation, and the roles that are inserted for it.
END, ENDING = (0, 2 * INSERT, INSERT, 0), ((), (USER, ASSISTANT), (ASSISTANT,), ())

STRETCH = 16  # rows of a lattice
BLOCK_BYTES, ROW_BYTES = 1 << 20, 4 << 10  # text of a block, with so much for each row
WHITE = " \t\n\v\f\r"


def row_edits() -> dict[str, list[list[tuple]]]:
    """For each kind of row and state: (letter, next state, cost, role or None to keep its own), letters in order."""
    table = {}
    for kind in "xdsua-SUA+":
        table[kind] = []
        for state in range(4):
            edits = [("D", state, DELETE, None)]
            if kind not in "xd":
                extra, own = OPEN_END * (kind in "SUA+"), kind.lower()
                target = AFTER[state]
                if own == "s" and state == START:
                    edits.append(("K", SYSTEM, extra, None))
                if own == ROLES[target][0]:
                    edits.append(("K", target, extra, None))
                edits.append(("R", target, REROLE + extra, target))
            table[kind].append(edits)
    return table


EDITS = row_edits()


class Lattice:
    """Nodes (row, state) of a stretch of rows, with a dual price each; what lies behind it is a cost for each last state.

    Prices start at zero and only rise, and never exceed the length of an arc plus the price at its end. The auction
    keeps a path from its origin: the last node's price rises to its best arc and the path contracts, or, if
    the price is there already, the path extends over that arc. When it reaches the end, the origin's price is its distance.
    """

    def __init__(self, kinds: str, goal):
        n = self.n = len(kinds)
        self.price = [[0] * 4 for _ in range(n)] + [list(goal)]
        self.arcs = [None] * n
        open_ahead = [g < NEVER for g in goal]
        for i in range(n - 1, -1, -1):
            level = []
            for state in range(4):
                arcs = [(letter, i + 1, to, cost, role) for letter, to, cost, role in EDITS[kinds[i]][state] if open_ahead[to]]
                level.append(arcs)
            reached = [bool(arcs) for arcs in level]
            for _ in range(3):  # an insertion leads to another state of the same row
                reached = [r or reached[AFTER[s]] for s, r in enumerate(reached)]
            for state in range(4):
                if reached[AFTER[state]]:
                    level[state].insert(bool(level[state]) and level[state][0][0] == "D", ("I", i, AFTER[state], INSERT, AFTER[state]))
                if not reached[state]:
                    self.price[i][state] = NEVER
            self.arcs[i], open_ahead = level, reached

    def auction(self, row: int, state: int) -> int:
        price, path = self.price, [(row, state)]
        if price[row][state] >= NEVER:
            return NEVER
        while True:
            i, s = path[-1]
            if i == self.n:
                return price[row][state]
            least, best = NEVER, None
            for arc in self.arcs[i][s]:
                value = arc[3] + price[arc[1]][arc[2]]
                if value < least:
                    least, best = value, arc
            if price[i][s] < least:
                price[i][s] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append((best[1], best[2]))

    def trace(self, state: int) -> tuple[list[tuple], int]:
        """The shortest path from ``state`` with the least letters: (letter, row, role) each, and the state it ends in.

        An arc lies on a shortest path if it is tight once the price at its end has converged.
        """
        self.auction(0, state)
        steps, i, s = [], 0, state
        while i < self.n:
            for letter, to_row, to, cost, role in self.arcs[i][s]:
                if self.price[i][s] == cost + self.price[to_row][to] and self.price[i][s] == cost + self.auction(to_row, to):
                    break
            steps.append((letter, i, role))
            i, s = to_row, to
        return steps, s


def lattices(kinds: str, goal) -> list[tuple[int, Lattice]]:
    """(first row, lattice) of all stretches, solved from the back: the distances at the head of one are the costs behind the one before."""
    out = []
    for first in range((len(kinds) - 1) // STRETCH * STRETCH, -1, -STRETCH) if kinds else ():
        part = Lattice(kinds[first : first + STRETCH], goal)
        if first:
            goal = [part.auction(0, s) for s in range(4)]
        out.append((first, part))
    return out[::-1]


def crossing(kinds: str) -> list[int]:
    """Cost from each state before these rows to each state behind them, row by row of the matrix."""
    columns = []
    for to in range(4):
        goal = [0 if s == to else NEVER for s in range(4)]
        parts = lattices(kinds, goal)
        columns.append([parts[0][1].auction(0, s) if parts else goal[s] for s in range(4)])
    return [columns[to][s] for s in range(4) for to in range(4)]


def edits_from(kinds: str, goal, state: int, last: bool) -> dict:
    """The edits of these rows from ``state`` on: letters, what they leave as (row or -1, role or ''), cost and the state behind."""
    audit, kept, parts = [], [], lattices(kinds, goal)
    cost = parts[0][1].auction(0, state) if parts else goal[state]
    for first, part in parts:
        steps, state = part.trace(state)
        for letter, row, role in steps:
            audit.append(letter)
            if letter != "D":
                kept.append({"row": -1 if letter == "I" else first + row, "role": ROLES.get(role, "")})
    if last:
        audit += ["I"] * len(ENDING[state])
        kept += [{"row": -1, "role": ROLES[s]} for s in ENDING[state]]
    return {"audit": "".join(audit), "cost": cost, "kept": kept, "behind": state}


#: What the edits of some rows are. As types, not as text: this module is imported before there is a session.
EDITED = StructType().add("audit", "string").add("cost", "long")
EDITED.add("kept", ArrayType(StructType().add("row", "integer").add("role", "string"))).add("behind", "integer")
RESULT = to_arrow_type(EDITED)


@F.arrow_udf(EDITED)
def whole(kinds: pa.Array) -> pa.Array:
    return pa.array([edits_from(k, END, START, True) for k in kinds.to_pylist()], RESULT)


@F.arrow_udf(ArrayType(LongType()))
def crossings(kinds: pa.Array) -> pa.Array:
    return pa.array([crossing(k) for k in kinds.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(ArrayType(EDITED))
def from_all_states(kinds: pa.Array, goal: pa.Array, last: pa.Array) -> pa.Array:
    rows = zip(kinds.to_pylist(), goal.to_pylist(), last.to_pylist(), strict=True)
    return pa.array([[edits_from(k, g, s, end) for s in range(4)] for k, g, end in rows], pa.list_(RESULT))


def prepared(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Named columns, the order of the rows, and the kind of each row apart from its being a repetition."""
    said = rows.select(
        F.col(conversation).alias("conversation"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    visible = F.rtrim("text", F.lit(WHITE))
    own = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("-")
    kind = F.when(visible == "", "x").when(F.right(visible, F.lit(1)).isin(".", "!", "?"), own)
    return said.select(
        "*",
        F.col("turn").isNotNull().alias("has_turn"),
        F.md5(F.concat("role", F.lit("\0"), "text").cast("binary")).alias("same"),
        own.alias("initial"),
        kind.otherwise(F.when(own == "-", "+").otherwise(F.upper(own))).alias("kind"),
    )


def blocks_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block: its rows in order, their kinds and initials as strings, and its turns."""
    fields = ["has_turn", "turn", "same", "again", "initial", "kind", "role", "text"]
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    seen = F.transform("rows", lambda r: r["same"])
    kinds = F.transform("rows", lambda r, i: F.when(r["kind"] == "x", "x").when(r["again"] | (F.array_position(F.col("seen"), r["same"]) <= i), "d").otherwise(r["kind"]))
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    return grouped.withColumn("seen", seen).select(
        *keys,
        "rows",
        F.array_join(kinds, "").alias("kinds"),
        F.array_join(F.transform("rows", lambda r: r["initial"]), "").alias("initials"),
        F.size(F.array_distinct(turns)).cast("long").alias("n_turns"),
        F.get(turns, F.lit(0)).alias("first_turn"),
        F.element_at(F.when(F.size(turns) > 0, turns), -1).alias("last_turn"),
    )


def illegal(initials: Column) -> Column:
    """Neighbours in a string of initials that are none of su, ua, au."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(initials) - 1, F.lit(1))), lambda i: F.substr(initials, i, F.lit(2)))
    return F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au"))).cast("long")


def occurrences(text: Column, letters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def next_to(blocks: DataFrame, other: DataFrame, distance: int, columns: dict[str, str]) -> DataFrame:
    """``blocks`` with ``columns`` (name -> new name) of the block ``distance`` further on in ``other``, NULL where there is none."""
    other = other.select(F.col("conversation").alias("there"), (F.col("block") - distance).alias("before"), *[F.col(c).alias(n) for c, n in columns.items()])
    return blocks.join(other, F.col("conversation").eqNullSafe(F.col("there")) & (F.col("block") == F.col("before")), "left").drop("there", "before")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of long conversations with the edits of each, found without gathering a conversation.

    Each block's costs between the states at its ends are a 4 x 4 matrix. Their products up to the end come from
    doubling: after k rounds a block knows those of the next 2**k. With the costs behind it a block finds its edits for
    each state before it; doubling over the maps from state to state then tells which of them is the case.
    """
    order = ["has_turn", "turn", "same"]
    sized = rows.withColumns({"bytes": (F.octet_length("text") + F.octet_length("role") + ROW_BYTES).cast("long"), "one": F.lit(1).cast("long")})
    placed = stored(running(sized, ["conversation"], order, {"place": "one", "before": "bytes"}))
    first = placed.groupBy(F.col("conversation").alias("c"), F.col("same").alias("s")).agg(F.min("place").alias("first"))
    marked = placed.join(first, F.col("conversation").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s"))).select(
        *rows.columns, (F.col("before") / BLOCK_BYTES).cast("long").alias("block"), (F.col("place") > F.col("first")).alias("again")
    )
    # Numbers of blocks may have gaps behind a very long row: dense ranks close them.
    made = stored(blocks_of(marked, ["conversation", "block"]))
    ranks = running(made.select("conversation", "block", F.lit(1).cast("long").alias("one")), ["conversation"], ["block"], {"rank": "one"})
    ranks = ranks.select(F.col("conversation").alias("c"), F.col("block").alias("b"), "rank")
    blocks = stored(
        made.join(ranks, F.col("conversation").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select(
            "conversation", F.col("rank").alias("block"), "rows", *made.columns[3:], crossings("kinds").alias("matrix")
        )
    )
    last = blocks.agg(F.max("block")).first()[0]
    product = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda k: F.least(F.lit(NEVER), F.array_min(F.array(*[F.get("matrix", F.floor(k / 4).cast("int") * 4 + m) + F.get("next", k % 4 + 4 * m) for m in range(4)]))),
    )
    ahead, step = blocks.select("conversation", "block", "matrix"), 1
    while last is not None and step <= last:
        joined = next_to(ahead, ahead, step, {"matrix": "next"})
        ahead = stored(joined.select("conversation", "block", F.when(F.col("next").isNull(), F.col("matrix")).otherwise(product).alias("matrix")))
        step *= 2
    behind = F.array(*[F.array_min(F.array(*[F.get("next", F.lit(4 * s + m)) + END[m] for m in range(4)])) for s in range(4)])
    joined = next_to(blocks.drop("matrix"), ahead, 1, {"matrix": "next"})
    ends = F.array(*[F.lit(c).cast("long") for c in END])
    solved = stored(
        joined.withColumn("goal", F.when(F.col("next").isNull(), ends).otherwise(behind))
        .withColumn("edits", from_all_states("kinds", "goal", F.col("next").isNull()))
        .drop("next", "goal")
    )
    maps, step = solved.select("conversation", "block", F.transform("edits", lambda e: e["behind"]).alias("map")), 1
    while last is not None and step <= last:
        joined = next_to(maps, maps, -step, {"map": "earlier"})
        composed = F.transform("earlier", lambda s: F.get("map", s))
        maps = stored(joined.select("conversation", "block", F.when(F.col("earlier").isNull(), F.col("map")).otherwise(composed).alias("map")))
        step *= 2
    entered = next_to(solved, maps, -1, {"map": "earlier"})
    edits = F.get("edits", F.coalesce(F.get("earlier", F.lit(START)), F.lit(START)))
    return entered.withColumn("edits", edits).drop("earlier")


@dataclass
class Repaired:
    """``short`` conversations of one block each, and the blocks of ``long`` ones; both with their rows and edits."""

    short: DataFrame
    long: DataFrame

    def blocks(self) -> DataFrame:
        return self.short.unionByName(self.long)

    def rows(self) -> DataFrame:
        """The repaired conversations, row by row: (conversation, block, place in it, edit K, R or I, role, text)."""
        out = self.blocks().select("conversation", "block", "rows", F.posexplode("edits.kept").alias("place", "kept"))
        own = F.get("rows", F.col("kept.row"))
        edit = F.when(F.col("kept.row") < 0, "I").when(F.col("kept.role") == "", "K").otherwise("R")
        role = F.when(F.col("kept.role") == "", own["role"]).otherwise(F.col("kept.role"))
        return out.select("conversation", "block", "place", edit.alias("edit"), role.alias("role"), F.coalesce(own["text"], F.lit("")).alias("text"))

    def report(self) -> DataFrame:
        """One row per conversation: the counts of faults, ``cost``, ``audit`` and ``repaired``.

        The last two are single values, so a conversation's letters and repaired text must fit one row here; ``rows`` has no such bound.
        """

        def line(k):
            own = F.get("rows", F.when(k["row"] >= 0, k["row"]))
            return F.concat(F.when(k["role"] == "", own["role"]).otherwise(k["role"]), F.lit(":"), F.when(k["row"] < 0, "").otherwise(own["text"]))

        def counted(blocks, *more):
            return blocks.select(
                "conversation",
                "block",
                *more,
                "n_turns",
                "first_turn",
                "last_turn",
                *[occurrences(F.col("kinds"), letters).alias(name) for name, letters in (("blank", "x"), ("duplicate", "d"), ("truncated", "SUA+"))],
                illegal(F.col("initials")).alias("illegal"),
                F.col("edits.cost").alias("cost"),
                F.col("edits.audit").alias("audit"),
                F.array_join(F.transform("edits.kept", line), "\n").alias("repaired"),
                (F.size("edits.kept") > 0).alias("some"),
            )

        ends = self.long.select("conversation", "block", "last_turn", F.right("initials", F.lit(1)).alias("last"))
        both = next_to(self.long, ends, -1, {"last": "earlier", "last_turn": "earlier_turn"})
        met = F.concat("earlier", F.left("initials", F.lit(1)))
        parts = counted(both, (F.coalesce(F.col("earlier_turn") == F.col("first_turn"), F.lit(False))).cast("long").alias("shared"), F.coalesce(illegal(met), F.lit(0)).alias("joint"))
        pieces = F.array_sort(F.collect_list(F.struct("block", "audit", "repaired", "some"))).alias("pieces")
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
        long = parts.groupBy("conversation").agg(
            (F.sum("n_turns") - F.sum("shared")).alias("n_turns"),
            F.min("first_turn").alias("first_turn"),
            F.max("last_turn").alias("last_turn"),
            *sums,
            (F.sum("illegal") + F.sum("joint")).alias("illegal"),
            F.min_by("cost", "block").alias("cost"),
            pieces,
        )
        long = long.withColumns(
            {
                "audit": F.array_join(F.transform("pieces", lambda p: p["audit"]), ""),
                "repaired": F.array_join(F.transform(F.filter("pieces", lambda p: p["some"]), lambda p: p["repaired"]), "\n"),
            }
        ).drop("pieces")
        short = counted(self.short).drop("block", "some")
        gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
        return short.unionByName(long).select("conversation", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")


def repair_conversations(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Makes every conversation an optional system turn and alternating user and assistant turns, or nothing, by the cheapest edits.

    Keep costs 0, another role (user or assistant) 1, deletion 2, an inserted empty turn 5; a row that stays although its text
    doesn't end in ``.``, ``!`` or ``?`` costs 5 more. Blank rows and repetitions of an earlier row's role and text have to go.
    Of several cheapest ways the one whose letters D, I, K, R come first is taken.

    Conversations up to 1 MB (4 KB counted for each row besides its text) are solved whole; longer ones in blocks of about that size, so
    that one which holds most of the rows is spread over tasks. Within a block the auction runs on 16 rows at a time, from the back, which
    keeps its number of steps in proportion to the rows.

    Rows are ordered by turn, NULL turns first, rows of one turn by a digest of role and text. NULL roles and texts are one space; only
    roles that begin with s, u or a can be kept, an empty role can't. A NULL conversation is one of its own. Rows that repeat
    are duplicates; very long texts are never cut. Extra columns are ignored; an empty table gives an empty result.
    """
    said = prepared(rows, conversation, turn, role, text)
    weight = F.octet_length("text").cast("long") + F.octet_length("role") + ROW_BYTES
    large = stored(said.groupBy("conversation").agg(F.sum(weight).alias("bytes")).where(F.col("bytes") > BLOCK_BYTES).select(F.col("conversation").alias("large")))
    is_large = F.col("conversation").eqNullSafe(F.col("large"))
    short = blocks_of(said.join(large, is_large, "left_anti").withColumn("again", F.lit(False)), ["conversation"])
    short = short.select("conversation", F.lit(0).cast("long").alias("block"), *short.columns[1:], whole("kinds").alias("edits"))
    if large.isEmpty():
        return Repaired(short, short.where("false"))
    return Repaired(short, in_blocks(said.join(large, is_large, "left_semi")))
