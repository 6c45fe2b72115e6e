"""First-fit decreasing packing of token pieces, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import each, stored, table
from siltstone.llm.tokens import encoder

SEQUENCE_TOKENS = 2048
#: Pieces that one group holds on average; a group is one task's unit of work.
GROUP_PIECES = 16_384
#: Rows of one output batch.
OUTPUT_ROWS = 4096


class Tournament:
    """A tournament tree of bin capacities: each inner node holds the larger of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.size)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and what it held before."""
        best, node = self.best, 1
        while node < self.size:
            node *= 2
            if best[node] < size:
                node += 1
        room = best[node]
        best[node] = room - size
        first = node - self.size
        node //= 2
        while node:
            top = max(best[2 * node], best[2 * node + 1])
            if best[node] == top:
                break
            best[node] = top
            node //= 2
        return first, room


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of each size; larger sizes are placed first, ties in order."""
    tree = Tournament(max(1, len(sizes)), capacity)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins[i], room = tree.place(sizes[i])
        offsets[i] = capacity - room
    return bins, offsets


def pieces(docs: DataFrame, path: str, end_id: int, length: int = SEQUENCE_TOKENS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of each row: ``doc_id, start, length, ids_crc32, doc_tokens, draw`` and, if asked for, ``ids``.

    A document is its text's ids and then ``end_id``, cut every ``length`` tokens.
    ``draw`` is a random number from 0 to 1, one for each document.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, draw double" + ", ids binary" * with_ids
    names = ["start", "length", "ids_crc32", "doc_tokens", "draw", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), *[pa.binary()] * with_ids]
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)

        def made(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

        for batch in batches:
            rows, found = [], []
            draws = batch.column(2).to_pylist()
            for row, ids in enumerate(ids_of(each(batch.column(1)))):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append(row)
                    found.append((start, len(piece) // 4, zlib.crc32(piece), n, draws[row], *[piece] * with_ids))
                if len(rows) >= OUTPUT_ROWS:
                    yield made(batch, rows, found)
                    rows, found = [], []
            yield made(batch, rows, found)

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.rand().alias("draw")).mapInArrow(cut, shape)


def packed(docs: DataFrame, path: str, end_id: int = 1, length: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``length`` tokens.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` (and ``ids`` as little-endian unsigned 32-bit bytes). Each
    id of a document lies in exactly one piece; pieces of a sequence lie one after
    another from offset 0. A null text is an empty one: one piece, the end id. A
    very long text is many pieces. Repeated rows are packed once each, a null id
    stays null, other columns are ignored, an empty table gives an empty one.

    Documents are dealt to groups by a random number each, drawn when their pieces
    are stored, so neither a hot source nor a set of copies gathers in one group;
    all pieces of a document are in its group. The number of groups follows the
    number of pieces. Within a group larger pieces are placed first; ties go by
    the documents' numbers, then by start. So pieces of ``length`` come first and fill a
    sequence each: a task numbers them as they pass and holds only the others, at
    most one a document, so a very long text is never held.
    """
    cut = stored(pieces(docs, path, end_id, length, with_ids, id_col, text_col), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    kept = [c for c in cut.columns if c != "draw"]
    shape = ", ".join(f"{c} {kind}" for c, kind in cut.dtypes if c != "draw") + ", sequence_id long, offset long"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed(part: pa.RecordBatch, bins: list[int] | range, offsets: list[int]) -> pa.RecordBatch:
            columns = [part.column(c) for c in kept]
            return pa.RecordBatch.from_arrays([*columns, pa.array([(group << 32) + b for b in bins], pa.int64()), pa.array(offsets, pa.int64())], [*kept, "sequence_id", "offset"])

        def rest() -> Iterator[pa.RecordBatch]:
            # The pieces of a group that fill no sequence: at most one a document.
            sizes = [n for part in held for n in part.column("length").to_pylist()]
            bins, offsets = first_fit_decreasing(sizes, length)
            at = 0
            for part in held:
                end = at + part.num_rows
                yield placed(part, [full + b for b in bins[at:end]], offsets[at:end])
                at = end

        group, full, held = None, 0, []
        for batch in batches:
            keys = list(zip(batch.column("grp").to_pylist(), batch.column("short").to_pylist(), strict=True))
            at = 0
            for key, run in groupby(keys):
                part = batch.slice(at, len(list(run)))
                at += part.num_rows
                if key[0] != group:
                    yield from rest()
                    group, full, held = key[0], 0, []
                if key[1]:
                    held.append(part)
                else:
                    yield placed(part, range(full, full + part.num_rows), [0] * part.num_rows)
                    full += part.num_rows
        yield from rest()

    dealt = cut.withColumns({"grp": F.floor(F.col("draw") * groups), "short": F.col("length") < length})
    return dealt.repartition("grp").sortWithinPartitions("grp", "short", "draw", "start").mapInArrow(fill, shape)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
