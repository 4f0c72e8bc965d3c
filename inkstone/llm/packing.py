"""Vector best-fit packing of tokenised documents into sequences.

A sequence has residual capacities of tokens, documents and attention cost. Attention runs over each piece alone, in tiles,
so a piece costs the square of its length in whole tiles: one that fills a sequence costs all there is, while some hundred
short ones use up the tiles, or the documents, before the tokens. A piece goes to the sequence where it fits under all
three and the weighted score is lowest: of what the residual leaves over ("norm", its weighted length), or of demand times
residual ("dot"). Pieces come longest first. Pieces of one length are alike, so the driver plans on
the counts of lengths alone (max_tokens of them at most), in whole runs of equal sequences, and the executors rank the
pieces of each length and read their places off the plan.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec_of, read_vocabulary
from .common import Scratch, small_batches


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    documents: int = 64
    attention: int = 1024 * 1024
    tile: int = 64
    #: Weights of the three residuals, each as a share of its capacity.
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"

    def need(self, length: int) -> np.ndarray:
        """Tokens, documents and attention cost of a piece."""
        padded = min(-(-length // self.tile) * self.tile, max(self.tokens, length))
        return np.array([length, 1, padded * padded], float)


def plan(counts: dict[int, int], room: Capacity) -> pd.DataFrame:
    """Places for pieces by length: rows (length, first, count, sequence, each, offset), without overlap.

    The pieces of a length with ranks first to first + count - 1 go to the sequences from `sequence` on, `each` to one,
    side by side from `offset`.
    """
    whole = np.array([room.tokens, room.documents, room.attention], float)
    weight = np.array(room.weights) / whole
    free = np.zeros((0, 3))  # residuals of the open kinds of sequence
    runs: list[list[tuple[int, int]]] = []  # of each kind: (first sequence, how many)
    where: dict[tuple[float, ...], int] = {}
    out, sequences = [], 0

    def put(residual: np.ndarray, first: int, n: int) -> None:
        nonlocal free
        key = tuple(residual.tolist())
        if key not in where:
            where[key] = len(runs)
            runs.append([])
            free = np.vstack([free, residual])
        runs[where[key]].append((first, n))

    for length in sorted(counts, reverse=True):
        need = room.need(length)
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens fits no empty sequence")
        rank, left = 0, counts[length]
        while left:
            usable = np.fromiter(map(bool, runs), bool, len(runs)) & (free >= need).all(axis=1) if runs else np.zeros(0, bool)
            if usable.any():
                rest = (((free - need) * weight) ** 2).sum(axis=1) if room.score == "norm" else free @ (weight**2 * need)
                kind = int(np.where(usable, rest, np.inf).argmin())
                residual = free[kind].copy()
                first, n = runs[kind].pop()
            else:
                kind, residual, first = None, whole, sequences
                n = max(1, left // int((whole // need).min()))
                sequences += n
            each = min(int((residual // need).min()), left)
            if each * n > left:  # only some of the run are filled
                used = left // each
                put(residual, first + used, n - used)
                n = used
            out.append((length, rank, each * n, first, each, room.tokens - int(residual[0])))
            put(residual - each * need, first, n)
            rank, left = rank + each * n, left - each * n
    return pd.DataFrame(out, columns=["length", "first", "count", "sequence", "each", "offset"], dtype="int64")


def pieces_of(docs: DataFrame, vocabulary: str, max_tokens: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each whole text's token ids and end_id, cut only if longer than
    max_tokens; then all pieces but perhaps the first have max_tokens. Null and empty texts are the end alone; repeated rows
    give their pieces each, null ids are kept, and an empty table gives none."""
    small_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut(texts: pd.Series) -> pd.Series:
        rows = []
        for ids in codec_of(data.value).encode_bytes(texts):
            flat = ids + np.uint32(end_id).tobytes()
            total = len(flat) // 4
            ends = [*range(total % max_tokens or max_tokens, total + 1, max_tokens)]
            rows.append(
                [
                    {"piece": k, "start": b, "length": e - b, "ids_crc32": zlib.crc32(flat[4 * b : 4 * e])}
                    for k, (b, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True))
                ]
            )
        return pd.Series(rows)

    return docs.select("doc_id", F.explode(cut("text")).alias("p")).select("doc_id", "p.*")


def pack(pieces: DataFrame, room: Capacity, scratch: Scratch, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with (sequence_id, offset): as few sequences as vector best-fit makes of their lengths.

    Every row gets a place, repeated rows one each; offsets in a sequence run from 0 without gaps. Only the counts of
    lengths reach the driver. Ranks come from windows over (length, salt), so a length that all pieces have is spread; salts
    come from numbers that the rows are written with, so rows that repeat, or have no id, are spread too.
    """
    rows = scratch.write(pieces.withColumn("_row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(64, sum(counts.values()) // 20_000)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy(*keys, "_row")
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1).join(bases, ["length", "_salt"])
    places = plan(counts, room).sort_values(["length", "first"])
    step = 1 << 40
    begin = (places["length"] * step + places["first"]).to_numpy()
    first, sequence, each, offset = (places[c].to_numpy() for c in ("first", "sequence", "each", "offset"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(begin, n * step + r, side="right") - 1
        r = r - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + r // each[at], "offset": offset[at] + r % each[at] * n})

    placed = ranked.withColumn("_place", place("length", F.col("_base") + F.col("_rank")))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, vocabulary: str, room: Capacity = Capacity()) -> DataFrame:  # noqa: B008
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents; an empty table gives no rows."""
    return pack(pieces_of(docs.select("doc_id", "text"), vocabulary, room.tokens), room, Scratch(docs.sparkSession))
