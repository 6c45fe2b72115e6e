"""Chat formatting as a prefix tree: conversations that begin alike share their first turns.

A turn is written ``<|role|>``, a newline, the text, ``</s>`` and a newline. Control
strings inside texts get a backslash after their first character, one more than
stood there, so they can never be read as marks and come back unchanged.

A node of the tree is a turn with all turns before it, named by a chained
128-bit hash. Conversations are sorted by their paths of node names over the
whole cluster; each emits the turns that it doesn't share with the one before it,
so every node is emitted once and the order is depth-first. The emitted
sequence is one line of offsets: a node has its ``start`` there, the
``position`` of its first unit along its own path, and the ``ancestors`` that it
may attend to as ``(begin, end)`` intervals of offsets, its own units aside.
Units are code points, or tokens where a tokenizer file is given.

Nothing is gathered by tree: sorting splits a hot first turn over tasks, the
offsets are sums per partition, and the joins on node names are equi-joins that
adaptive execution splits where they are skewed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import drop_stored, so_far, stored, table

#: What a text must not show as it is: this template's marks and those of common chat templates.
_CONTROL = r"(?=/?s>|\||/?INST\]|<SYS>>|</SYS>>)"
_PLAIN = re.compile(r"([<\[])(\\*)" + _CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)</s>\n", re.S)


def escaped(text: str) -> str:
    return _PLAIN.sub(r"\1\2\\", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def formatted(role: str | None, text: str | None) -> str:
    """One turn; a null role or text is an empty one."""
    name = (role or "").replace("%", "%25").replace("|", "%7C")
    return f"<|{name}|>\n{escaped(text or '')}</s>\n"


def parsed(chat: str) -> list[tuple[str, str]]:
    """The turns ``(role, text)`` of formatted text."""
    return [(role.replace("%7C", "|").replace("%25", "%"), unescaped(text)) for role, text in _TURN.findall(chat)]


def _merged(intervals):
    """Touching intervals of a sorted array column as one."""
    kind = "array<struct<begin: bigint, end: bigint>>"
    return F.aggregate(
        intervals,
        F.array().cast(kind),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] == s["begin"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), s["end"].alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def prefix_tree(turns: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tree of ``turns(conv_id, turn, role, text)``: ``nodes`` and ``conversations``.

    ``nodes``: ``node, parent, root, depth, start, size, position, ancestors, text,
    loss`` (and ``ids`` with a tokenizer). ``text`` is the formatted turn; ``loss`` is
    the ``(begin, end)`` code points in it that the loss covers: an assistant's text.
    ``conversations``: ``row, conv_id, path``, one row per conversation, ``path``
    its node names in order.

    Turns are ordered by ``turn``, then role and text (nulls first); repeated rows are
    turns of their own. Rows with a null id make one conversation. Other columns
    are ignored; very long texts are written whole; an empty table gives empty ones.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    whole = turns.select("conv_id", F.struct("turn", "role", "text").alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    shape = f"conv_id {kind}, path array<string>, sizes array<long>, texts array<string>, roles array<string>, ids array<binary>"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer:
            from siltstone.llm.tokens import encoder

            ids_of = encoder(tokenizer)
        for batch in batches:
            paths, sizes, texts, roles, ids = [], [], [], [], []
            for own in batch.column(1).to_pylist():
                name, path = b"", []
                for t in own:
                    role, text = ((t[c] or "").encode() for c in ("role", "text"))
                    name = hashlib.blake2b(name + len(role).to_bytes(4, "big") + role + text, digest_size=16).digest()
                    path.append(name.hex())
                texts.append([formatted(t["role"], t["text"]) for t in own])
                ids.append(list(ids_of(texts[-1])) if tokenizer else [])
                sizes.append([len(x) // 4 for x in ids[-1]] if tokenizer else [len(x) for x in texts[-1]])
                paths.append(path)
                roles.append([t["role"] or "" for t in own])
            made = [(paths, pa.string()), (sizes, pa.int64()), (texts, pa.string()), (roles, pa.string()), (ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(t)) for x, t in made)], ["conv_id", "path", "sizes", "texts", "roles", "ids"])

    begin = so_far()
    written = stored(whole.mapInArrow(write, shape).withColumn("row", F.monotonically_increasing_id()), "chats")

    # Order by path, texts and all: they move once here and are told where they belong in place. Each task
    # says what a conversation shares with the one before it in the task, and how much it adds.
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list | None = None
        total = 0
        for batch in batches:
            facts = []
            names = batch.schema.names
            for path, sizes in zip(*(batch.column(names.index(c)).to_pylist() for c in ("path", "sizes")), strict=True):
                n = 0
                while before is not None and n < len(path) and n < len(before) and path[n] == before[n]:
                    n += 1
                old = sum(sizes[:n])
                facts.append((None if before is None else n, old, sum(sizes) - old, total))
                total += facts[-1][2]
                before = path
            columns = list(zip(*facts, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], [*names, "shared", "old", "new", "at"])

    sorted_ = written.repartitionByRange("path", "row").sortWithinPartitions("path", "row")
    facts = ", shared long, old long, new long, at long"
    order = sorted_.mapInArrow(share, ", ".join(f"{c} {t}" for c, t in sorted_.dtypes) + facts)
    order = stored(order.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.shiftright("seq", 33)), "order")
    drop_stored(turns.sparkSession, begin, 1)

    # A row per part: what its first conversation shares with the last one of the part before, and where it begins.
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    ends = order.groupBy("part").agg(F.min_by(F.struct("path", "sizes"), "seq").alias("first"), F.max_by("path", "seq").alias("last"), F.min("seq").alias("head"), F.sum("new").alias("n"))
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("part")))
    apart = F.array_position(F.zip_with("first.path", F.coalesce("before", F.array().cast("array<string>")), lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False))
    ends = ends.withColumn("edge", F.when(apart == 0, F.size("first.path")).otherwise(apart - 1).cast("long"))
    ends = ends.withColumn("less", total(F.slice("first.sizes", 1, F.col("edge").cast("int"))))
    ends = ends.select("part", "head", "edge", "less", (F.sum(F.col("n") - F.col("less")).over(Window.orderBy("part")) - (F.col("n") - F.col("less"))).alias("base"))
    # Stored: a table of known size, a row per part, which the planner broadcasts while it is small, so texts stay where they are.
    order = order.join(stored(ends, "parts"), "part")
    first = F.col("seq") == F.col("head")
    placed = order.withColumns(
        {
            "shared": F.when(first, F.col("edge")).otherwise(F.col("shared")),
            "old": F.when(first, F.col("less")).otherwise(F.col("old")),
            "new": F.when(first, F.col("new") - F.col("less")).otherwise(F.col("new")),
            "begin": F.col("base") + F.when(first, F.lit(0)).otherwise(F.col("at") - F.col("less")),
        }
    )

    emitted = placed.select("row", "shared", "old", "begin", "path", F.posexplode(F.arrays_zip("path", "sizes", "texts", "roles", *["ids"] * bool(tokenizer))).alias("k", "t"), "sizes").where(F.col("k") >= F.col("shared"))
    position = total(F.slice("sizes", 1, F.col("k")))
    role = F.regexp_count("t.texts", F.lit(r"(?s)^<\|[^|]*\|>\n")) * (F.instr("t.texts", "|>\n") + 2)
    loss = F.when(F.col("t.roles") == "assistant", F.struct(role.cast("long").alias("begin"), (F.length("t.texts") - F.length(F.lit("</s>\n"))).cast("long").alias("end")))
    nodes = emitted.select(
        F.col("t.path").alias("node"),
        F.get("path", F.col("k") - 1).alias("parent"),
        F.get("path", F.lit(0)).alias("root"),
        (F.col("k") + 1).cast("long").alias("depth"),
        (F.col("begin") + position - F.col("old")).alias("start"),
        F.col("t.sizes").alias("size"),
        position.alias("position"),
        "row",
        "begin",
        F.col("t.texts").alias("text"),
        loss.alias("loss"),
        *[F.col("t.ids").alias("ids")] * bool(tokenizer),
    )
    nodes = stored(nodes, "nodes")
    order = placed.select("row", "path", "shared", "new")

    # Ancestors that other conversations emitted, for each conversation that emits something.
    above = order.where("new > 0 and shared > 0").select("row", F.explode(F.slice("path", 1, F.col("shared").cast("int"))).alias("node"))
    above = above.join(nodes.select("node", F.struct(F.col("start").alias("begin"), (F.col("start") + F.col("size")).alias("end")).alias("at")), "node")
    above = above.groupBy("row").agg(_merged(F.array_sort(F.collect_list("at"))).alias("above"))
    full = nodes.join(above, "row", "left")
    own = F.when(F.col("start") > F.col("begin"), F.array(F.struct("begin", F.col("start").alias("end")))).otherwise(F.array().cast("array<struct<begin: bigint, end: bigint>>"))
    ancestors = _merged(F.concat(F.coalesce("above", F.array().cast("array<struct<begin: bigint, end: bigint>>")), own))
    columns = ["node", "parent", "root", "depth", "start", "size", "position", "ancestors", "text", "loss", *["ids"] * bool(tokenizer)]
    return full.withColumn("ancestors", ancestors).select(*columns), placed.select("row", "conv_id", "path")


def read_back(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, turns, loss, size, n_intervals``: what a conversation's last turn sees in the emitted sequence.

    Of the nodes on the conversation's path those count that lie in the intervals
    its last node may attend to, or are that node, in the order of their position
    ids: their formatted turns, and their text under the loss mask. ``size`` is the
    number of units that the intervals and the last node hold.
    """
    steps = conversations.select("row", "conv_id", F.size("path").alias("depth"), F.explode("path").alias("node"))
    met = steps.join(nodes.select("node", F.col("depth").alias("d"), "start", "size", "position", "ancestors", "text", "loss"), "node")
    masked = F.when(F.col("loss").isNotNull(), F.substring("text", F.col("loss.begin") + 1, F.col("loss.end") - F.col("loss.begin")))
    last = F.col("d") == F.col("depth")
    sees = F.concat("ancestors", F.array(F.struct(F.col("start").alias("begin"), (F.col("start") + F.col("size")).alias("end"))))
    own = F.struct("position", "start", (F.col("start") + F.col("size")).alias("end"), "text", masked.alias("loss"))
    whole = met.groupBy("row", "conv_id").agg(F.array_sort(F.collect_list(own)).alias("all"), F.max(F.when(last, sees)).alias("sees"))
    whole = whole.withColumn("all", F.filter("all", lambda x: F.exists("sees", lambda s: (s["begin"] <= x["start"]) & (x["end"] <= s["end"]))))
    size = F.aggregate("sees", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return whole.select("conv_id", F.col("all.text").alias("turns"), F.filter(F.col("all.loss"), lambda x: x.isNotNull()).alias("loss"), size.alias("size"), F.size(_merged(F.col("sees"))).cast("long").alias("n_intervals"))


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    shape = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_intervals long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for turns, loss, size in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                chat = "".join(turns)
                said = "".join(f"{role}\n{text}\n" for role, text in parsed(chat))
                learnt = "".join(map(unescaped, loss))
                rows.append((len(parsed(chat)), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), size))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_intervals"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column(4)], names)

    return read_back(*prefix_tree(turns)).mapInArrow(digest, shape)
