"""Repair of conversations: the cheapest edits that make roles alternate, by an auction algorithm.

After its damage a conversation is a row of messages, some blank, repeated or
truncated. Edits lead through a lattice: a node is a number of messages read and a
state (nothing yet, after the system message, after a user, after an assistant);
arcs delete (3), insert (2), keep (0) or rerole (2) and cost one more where a truncated
message stays. The auction algorithm for shortest paths (Bertsekas, 1991) keeps a
price for each node and one path from the origin. The end of the path is extended
along its cheapest arc where that arc is tight, else its price rises and the path is
contracted by a node. Prices never exceed what an arc allows, so at the end every arc of
every cheapest path is tight, and the least of their edit strings is found by
following tight arcs that lead to the end, the ASCII-least first.

No conversation has to fit in a task. Messages are narrow rows (a digest in place
of the text), sorted over the cluster, and cut into blocks of ``BLOCK``; a block that
is a whole conversation, nearly all of them, is solved at once. Of the others each
block gives the cheapest costs between the four states before and after it. Those
are added up from a conversation's end, each block is solved for the costs that follow
it from all four states, and the states that are really met are looked up from the
start: what a conversation gathers is a few numbers a block. Texts meet their edits
once, at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import drop_stored, so_far, stored, table

#: Messages of a block: prices of a block rise at most by its costs, so work is bounded by messages times this.
BLOCK = 64
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after a system message, a user's, an assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or reroled message leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: State after a kept message, by its role's initial and the state before.
KEPT = {("s", NONE): SYSTEM, ("u", NONE): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
FINE, BLANK, DUPLICATE, CUT = range(4)
FAR = float("inf")
WHITE = " \t\n\x0b\x0c\r"


class Lattice:
    """The edits of one block of messages, ``(initial, fault)`` each, and their prices.

    ``exits`` is the cost that follows each of the four states after the block, None
    where a state leads nowhere. Insertions after the last message belong to the next
    block, or to this one if it is the ``last``.
    """

    def __init__(self, messages: list[tuple[str, int]], exits: list[int | None], last: bool):
        self.n = n = len(messages)
        self.sink = 4 * (n + 1)
        self.prices: list[float] = [0] * (self.sink + 1)
        # Only states from which an exit can be reached: elsewhere prices would rise for ever.
        useful = [last or any(exits[r] is not None for r in ((q, USER, ASSISTANT) if q != NONE else range(4))) for q in range(4)]
        self.arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(self.sink + 1)]
        for i in range(n + 1):
            for q in range(4):
                out = self.arcs[4 * i + q]
                if i < n:
                    initial, fault = messages[i]
                    out.append(("D", DELETE, 4 * (i + 1) + q))
                    extra = TRUNCATED if fault == CUT else 0
                    if fault in (FINE, CUT):
                        if (initial, q) in KEPT:
                            out.append(("K", extra, 4 * (i + 1) + KEPT[initial, q]))
                        out.append(("R", REROLE + extra, 4 * (i + 1) + NEXT[q]))
                if i < n or last:
                    out.append(("I", INSERT, 4 * i + NEXT[q]))
                out[:] = sorted(a for a in out if useful[a[2] % 4])
                if i == n and exits[q] is not None:
                    out.append(("", exits[q], self.sink))

    def distance(self, origin: int) -> float:
        """The cost from a state before the block to the end, by auction; prices of earlier calls stay valid."""
        prices, arcs, path = self.prices, self.arcs, [origin]
        while (i := path[-1]) != self.sink:
            best, to = FAR, -1
            for _, cost, j in arcs[i]:
                if cost + prices[j] < best:
                    best, to = cost + prices[j], j
            if prices[i] < best:
                prices[i] = best
                if best == FAR and len(path) == 1:
                    return FAR
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return prices[origin]

    def traced(self, origin: int) -> tuple[str, int, int]:
        """The ASCII-least cheapest edits from a state, the state they end in and their cost; after ``distance``."""
        tight = lambda i, a: self.prices[i] == a[1] + self.prices[a[2]]
        leads = [False] * self.sink + [True]
        for i in range(self.n, -1, -1):
            for _ in range(3):  # insertions lead from a layer into itself, twice at most
                for k in range(4 * i, 4 * i + 4):
                    leads[k] = leads[k] or any(leads[a[2]] and tight(k, a) for a in self.arcs[k])
        at, edits, spent = origin, [], 0
        while True:
            label, cost, to = next(a for a in self.arcs[at] if leads[a[2]] and tight(at, a))
            if to == self.sink:
                return "".join(edits), at % 4, spent
            edits.append(label)
            at, spent = to, spent + cost


#: States that can follow each state.
REACHED = [(0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3)]


def crossing(messages: list[tuple[str, int]]) -> list[int | None]:
    """The cheapest cost from each state before a block that isn't the last to each after it, None where there is none."""
    out: list[int | None] = [None] * 16
    for end in range(4):
        lattice = Lattice(messages, [0 if q == end else None for q in range(4)], False)
        for begin in range(4):
            if end in REACHED[begin] and (d := lattice.distance(begin)) < FAR:
                out[4 * begin + end] = int(d)
    return out


FINAL = [0, None, None, 0]


def solved(messages: list[tuple[str, int]], exits: list[int | None] = FINAL, last: bool = True, origins: tuple = (NONE,)) -> list[tuple[str, int, int]]:
    """``(edits, state after, cost)`` for each state before the block."""
    lattice, out = Lattice(messages, exits, last), []
    for origin in origins:
        lattice.distance(origin)
        out.append(lattice.traced(origin))
    return out


# On the cluster ----------------------------------------------------------


def facts(rows: DataFrame) -> DataFrame:
    """``c, t, role, h, fault`` of ``rows(c, t, role, text)``, without the texts."""
    bare = F.rtrim("text", F.lit(WHITE))
    out = rows.select("c", "t", "role", F.unhex(F.sha2("text", 256)).alias("h"), F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT).alias("fault"))
    again = F.row_number().over(Window.partitionBy("c", "role", "h").orderBy("t"))
    return out.withColumn("k", again).withColumn("fault", F.when((F.col("fault") != BLANK) & (F.col("k") > 1), DUPLICATE).otherwise(F.col("fault")))


_STATS = "n_blank long, n_duplicate long, n_truncated long, illegal long, t_min long, t_max long, n_turns long, first_t long, last_t long, first string, last string"
_SOLUTION = "entry int, audit string, cost long"


def _stats(ts: list, initials: list[str], faults: list[int]) -> tuple:
    told = [t for t in ts if t is not None]
    wrong = sum(p not in LEGAL for p in pairwise(initials))
    return (faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), wrong, min(told, default=None), max(told, default=None), len(set(told)), ts[0], ts[-1], initials[0], initials[-1])


def blocks(narrow: DataFrame) -> DataFrame:
    """``c, part, no``, the block's messages and facts, and its solution if it is a whole conversation, else its ``crossing``."""
    kind = narrow.schema["c"].dataType.simpleString()
    shape = f"c {kind}, part int, no long, ts array<long>, roles array<string>, hs array<binary>, faults array<int>, {_STATS}, {_SOLUTION}, crossing array<long>"
    arrow = _arrow(shape)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, found = TaskContext.get().partitionId(), 0, []
        held, at, begun, first = [], None, False, True

        def end(whole: bool) -> None:
            nonlocal no, held
            ts, roles, hs, faults = map(list, zip(*held, strict=True))
            initials = [r[:1] for r in roles]
            messages = list(zip(initials, faults, strict=True))
            if whole:
                (audit, _, cost), = solved(messages)
                solution = (NONE, audit, cost, None)
            else:
                solution = (None, None, None, crossing(messages))
            found.append((at, part, no, ts, roles, hs, faults, *_stats(ts, initials, faults), *solution))
            no, held = no + 1, []

        for b in batches:
            for c, *message in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if begun and c != at:
                    end(whole=not first and alone)
                    first = False
                if not begun or c != at:
                    at, begun, alone = c, True, True
                elif len(held) == BLOCK:
                    end(whole=False)
                    alone = False
                held.append(message)
                if len(found) >= 1024:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in found], arrow)
                    found = []
        if begun:
            end(whole=False)  # the conversation may go on in the next task
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in found], arrow)

    ordered = narrow.orderBy("c", "t", "role", "h", "k").select("c", "t", "role", "h", "fault")
    return ordered.mapInArrow(cut, shape)


def _arrow(shape: str) -> pa.Schema:
    """The Arrow schema of a Spark one; made on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(shape))


def _folded(rows: DataFrame, shape: str, fold) -> DataFrame:
    """``fold(rows of one conversation in order)`` for each conversation; a row is a few numbers of one block."""
    schema = _arrow(shape)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        ordered = group.sort_by([("part", "ascending"), ("no", "ascending")]).select([c for c in group.column_names if c != "c"]).to_pylist()
        return pa.Table.from_pylist(fold(ordered), schema)

    return rows.groupBy("c").applyInArrow(run, shape)


def _exits(rows: list[dict]) -> list[dict]:
    """What follows each block: costs from the four states after it to the end."""
    out, after = [], FINAL
    for k in range(len(rows) - 1, -1, -1):
        out.append({"part": rows[k]["part"], "no": rows[k]["no"], "exits": after, "last": k == len(rows) - 1})
        if out[-1]["last"]:
            # Insertions after the last message lead to its end.
            after = [0, 2 * INSERT, INSERT, 0]
        m = rows[k]["crossing"]
        after = [min((m[4 * q + r] + after[r] for r in range(4) if m[4 * q + r] is not None), default=None) for q in range(4)]
    return out


def _entries(rows: list[dict]) -> list[dict]:
    out, state = [], NONE
    for row in rows:
        out.append({"part": row["part"], "no": row["no"], "entry": state})
        state = row["states"][state]
    return out


def in_parts(parts: DataFrame) -> DataFrame:
    """The solutions of conversations in several blocks, ``part, no, entry, audit, cost``."""
    exits = _folded(parts.select("c", "part", "no", "crossing"), "part int, no long, exits array<long>, last boolean", _exits)
    met = parts.select("c", "part", "no", "roles", "faults").join(exits, ["part", "no"])
    shape = f"c {parts.schema['c'].dataType.simpleString()}, part int, no long, states array<int>, audits array<string>, costs array<long>"
    schema = _arrow(shape)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                found = solved(list(zip([x[:1] for x in r["roles"]], r["faults"], strict=True)), r["exits"], r["last"], (0, 1, 2, 3))
                out.append({"c": r["c"], "part": r["part"], "no": r["no"], "states": [x[1] for x in found], "audits": [x[0] for x in found], "costs": [x[2] for x in found]})
            yield pa.RecordBatch.from_pylist(out, schema)

    ways = stored(met.select("c", "part", "no", "roles", "faults", "exits", "last").mapInArrow(solve, shape), "ways")
    entries = _folded(ways.select("c", "part", "no", "states"), "part int, no long, entry int", _entries)
    return ways.join(entries, ["part", "no"]).select("part", "no", "entry", F.get("audits", F.col("entry")).alias("audit"), F.get("costs", F.col("entry")).alias("cost"))


def plan(rows: DataFrame) -> DataFrame:
    """The solved blocks of ``rows(c, t, role, text)``, stored; see ``audits`` and ``repaired``."""
    spark, begin = rows.sparkSession, so_far()
    cut = stored(blocks(stored(facts(rows), "facts")), "blocks")
    whole = cut.where("audit is not null").drop("crossing")
    parts = cut.where("audit is null").drop("entry", "audit", "cost")
    out = stored(whole.unionByName(parts.join(in_parts(parts), ["part", "no"]).drop("crossing")), "solved")
    drop_stored(spark, begin, 1)
    return out


def audits(plan: DataFrame) -> DataFrame:
    """``c, gaps, blank, duplicate, truncated, illegal, cost, audit``: a row for each conversation."""
    order = Window.partitionBy("c").orderBy("part", "no")
    before = lambda name: F.lag(name).over(order)
    legal = F.concat(before("last"), F.col("first")).isin(*["".join(p) for p in LEGAL])
    seen = plan.select("c", "part", "no", "t_min", "t_max", "cost", "audit", "n_blank", "n_duplicate", "n_truncated", (F.col("illegal") + F.when(before("last").isNotNull() & ~legal, 1).otherwise(0)).alias("illegal"), (F.col("n_turns") - F.when(F.col("first_t") == before("last_t"), 1).otherwise(0)).alias("n_turns"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "no", "audit"))), lambda x: x["audit"]), "")
    return seen.groupBy("c").agg(
        F.coalesce(F.max("t_max") - F.min("t_min") + 1 - F.sum("n_turns"), F.lit(0)).alias("gaps"),
        *[F.sum(f"n_{x}").alias(x) for x in ("blank", "duplicate", "truncated")],
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        texts.alias("audit"),
    )


def edited(audit: str, entry: int, roles: list[str]) -> Iterator[tuple[str, str, int | None]]:
    """``(edit, role, message)`` of the messages that stay or are inserted."""
    state, i = entry, 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role = roles[i] if edit == "K" else ROLE[NEXT[state]]
        state = KEPT[role[:1], state] if edit == "K" else NEXT[state]
        yield edit, role, None if edit == "I" else i
        i += edit != "I"


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``c, part, no, ix, turn, role, text, edit``: the repaired messages, in the order of ``part, no, ix``."""
    kind = rows.schema["c"].dataType.simpleString()
    shape = f"c {kind}, part int, no long, ix int, t long, old string, h binary, role string, edit string"
    schema = _arrow(shape)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                for ix, (edit, role, i) in enumerate(edited(r["audit"], r["entry"], r["roles"])):
                    own = {} if i is None else {"t": r["ts"][i], "old": r["roles"][i], "h": r["hs"][i]}
                    out.append({"c": r["c"], "part": r["part"], "no": r["no"], "ix": ix, "role": role, "edit": edit, **own})
            yield pa.RecordBatch.from_pylist(out, schema)

    made = stored(plan.select("c", "part", "no", "entry", "audit", "ts", "roles", "hs").mapInArrow(spread, shape), "edits")
    own = made.where("edit <> 'I'")
    texts = rows.select(F.col("c").alias("c0"), F.col("t").alias("t0"), F.col("role").alias("role0"), F.unhex(F.sha2("text", 256)).alias("h0"), "text").where("text <> ''")
    same = F.col("c").eqNullSafe(F.col("c0")) & F.col("t").eqNullSafe(F.col("t0")) & (F.col("old") == F.col("role0")) & (F.col("h") == F.col("h0"))
    told = own.join(texts.dropDuplicates(["c0", "t0", "role0", "h0"]), same)
    names = ["c", "part", "no", "ix", F.col("t").alias("turn"), "role", F.col("text"), "edit"]
    return told.select(*names).union(made.where("edit = 'I'").withColumn("text", F.lit("")).select(*names))


def as_rows(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``c, t, role, text`` for ``plan`` and ``repaired``: a null role or text is one space.

    Messages of a conversation are taken by turn, nulls first; of one turn, by role
    and then by the SHA-256 of the text. Rows with a null id are one conversation.
    Repeated rows are copies, of which all but the first are deleted. An empty text is
    blank; a very long one moves once, as everything but the last step sees its digest.
    Other columns are ignored. An empty table has no conversations.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return convs.select(F.col(id_col).alias("c"), F.col(turn_col).cast("long").alias("t"), blank(role_col).alias("role"), blank(text_col).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Faults by ``crc32('c:t') % 20``: dropped, emptied, without sentence ends, repeated, role set to user; the rest stays."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.withColumn("fault", F.crc32(F.concat(told("c"), F.lit(":"), told("t"))) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("c", "t", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def digests(messages: DataFrame) -> DataFrame:
    """``c, sha``: the SHA-256 of the repaired ``role:text``, a line each; a task hashes as it reads, whatever the length."""
    shape = f"c {messages.schema['c'].dataType.simpleString()}, sha string"
    schema = _arrow(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, out, begun = None, None, [], False
        for b in batches:
            for k in range(b.num_rows):
                c, role, text = (x[k].as_py() for x in b.columns)
                if not begun or c != at:
                    if begun:
                        out.append({"c": at, "sha": sha.hexdigest()})
                    at, sha, begun = c, hashlib.sha256(), True
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        yield pa.RecordBatch.from_pylist([{"c": at, "sha": sha.hexdigest()}] if begun else [], schema)

    dealt = messages.repartition("c").sortWithinPartitions("c", "part", "no", "ix")
    return dealt.select("c", "role", "text").mapInArrow(run, shape)


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = as_rows(table(spark, sf_dir, "conversations"))
    rows = damaged(source)
    solution = plan(rows)
    ids = source.select(F.col("c").alias("conv_id")).distinct()
    found = audits(solution).join(digests(repaired(rows, solution)).select(F.col("c").alias("c1"), "sha"), F.col("c").eqNullSafe(F.col("c1")), "left").drop("c1")
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(_EMPTY)).alias("repaired_sha256"))


_EMPTY = hashlib.sha256(b"").hexdigest()
