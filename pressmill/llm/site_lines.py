"""Lines repeated across one source's documents: find repeated blocks of lines and take them out.

Each source's documents are one concatenated sequence of line identifiers (a hash of a line's letters, lower-cased). Its
suffix array is all places in the order of (source, the DEPTH identifiers from there on); ties are in the order of document and
line. The array is built by one range sort of all places of all sources, whose last keys are document and line, so that
a source or line with a third of all rows is spread over as many parts of about PART places as it needs.

Common prefixes of neighbours (LCP) then give the blocks: at each depth m, a run of suffixes whose neighbours have at least m lines in
common is one block of m lines with all its places. A block counts if its run spans enough documents. A run inside a part
is decided there; of the runs at a part's two ends, which may go on in the next part, the rows go to a second, small step that
puts the pieces together by the block they start with. So each place has the length of the longest block that starts there, up to
DEPTH. Longer blocks need no more: each of their windows of DEPTH lines is such a block, and these cover the same lines.

Defined results: lines without letters, null contents and documents without a source are never repeated lines; they end
blocks. Repeated rows of an id count once; rows without an id are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.text_arrays import mix
from pressmill.session import materialize

SOURCE = "nullif(lower(regexp_replace(source, '^\\\\s+|\\\\s+$', '')), '')"
LETTERS = "regexp_replace(line, '[^\\\\p{L}]+', '')"
DEPTH, PART = 4, 500_000
PLACES = "doc long, line_no int, length int, block long, sure boolean"


def line_sequences(docs: DataFrame) -> DataFrame:
    """docs(id, source, content) to (id, source, lines array<long>, doc): the identifiers of each line, null without letters; doc numbers the documents."""
    ids = f"transform(split(content, '\n', -1), line -> if(rlike(line, '\\\\p{{L}}'), xxhash64(lower({LETTERS})), null))"
    own = docs.where("content IS NOT NULL AND id IS NOT NULL").select("id", F.expr(SOURCE).alias("source"), F.expr(ids).alias("lines")).where("source IS NOT NULL")
    return materialize(own.dropDuplicates(["id"]).withColumn("doc", F.monotonically_increasing_id()), "sequences")


def suffix_array(sequences: DataFrame, depth: int) -> DataFrame:
    """(src, k0 .. k<depth - 1>, doc, line_no) of every line with letters, in suffix order; the keys behind a document's end are null."""
    n = sequences.agg(F.sum(F.size("lines")).alias("n")).first()["n"] or 0
    parts = max(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(n / PART))
    keys = [F.get("lines", F.col("line_no") + j).alias(f"k{j}") for j in range(1, depth)]
    places = sequences.select(F.xxhash64("source").alias("src"), "doc", "lines", F.posexplode("lines").alias("line_no", "k0")).where("k0 IS NOT NULL").select("src", "k0", *keys, "doc", "line_no")
    return places.repartitionByRange(parts, *places.columns).sortWithinPartitions(*places.columns)


def prefixes(src: np.ndarray, keys: list[np.ndarray], valid: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in order: how many lines each has, up to the depth, and how many it has in common with the one before."""
    n = len(src)
    size, common = np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole, same = np.ones(n, bool), np.zeros(n, bool)
    same[1:] = src[1:] == src[:-1]
    for k, v in zip(keys, valid):
        whole &= v
        same &= whole
        same[1:] &= whole[:-1] & (k[1:] == k[:-1])
        size += whole
        common += same
    return size, common


def _blocks(min_docs: int, depth: int):
    """For parts of the suffix array: (doc, line_no, length) of the places of decided blocks; with ``block`` set, those at the part's ends."""

    def find(batches):
        t = pa.Table.from_batches(list(batches)) if batches else None
        if t is None or not t.num_rows:
            return
        src, doc, line = (t[c].to_numpy() for c in ("src", "doc", "line_no"))
        columns = [t[f"k{j}"] for j in range(depth)]
        keys, valid = [c.fill_null(0).to_numpy() for c in columns], [c.is_valid().to_numpy() for c in columns]
        size, common = prefixes(src, keys, valid)
        length, ends = np.zeros(len(src), np.int32), []
        name = mix(src)
        for m in range(1, depth + 1):
            name = mix(name + mix(keys[m - 1]))
            inside = size >= m
            run = np.cumsum(common < m) - 1
            often = inside & (np.bincount(run, inside)[run] >= min_docs)
            at = np.flatnonzero(often)
            at = at[np.lexsort((doc[at], run[at]))]
            new = np.append(True, (np.diff(run[at]) != 0) | (np.diff(doc[at]) != 0))[: len(at)]
            sure = inside & (np.bincount(run[at[new]], minlength=run[-1] + 1)[run] >= min_docs)
            length[sure] = m
            for r in {int(run[0]), int(run[-1])}:
                rows = np.flatnonzero((run == r) & inside)
                if len(rows):
                    ends.append((rows[:1] if sure[rows[0]] else rows, m, name[rows[0]], bool(sure[rows[0]])))
        kept = np.flatnonzero(length)
        yield pa.RecordBatch.from_arrays([pa.array(doc[kept]), pa.array(line[kept]), pa.array(length[kept]), pa.nulls(len(kept), pa.int64()), pa.array(np.ones(len(kept), bool))], ["doc", "line_no", "length", "block", "sure"])
        for rows, m, block, sure in ends:
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(line[rows]), pa.array(np.full(n, m, np.int32)), pa.array(np.full(n, block, np.uint64).view(np.int64)), pa.array(np.full(n, sure))], ["doc", "line_no", "length", "block", "sure"])

    return find


def _places(sequences: DataFrame, min_docs: int, depth: int) -> DataFrame:
    """(doc, line_no, length): where blocks that span enough documents start, with the longest up to ``depth``."""
    found = materialize(suffix_array(sequences, depth).mapInArrow(_blocks(min_docs, depth), PLACES), "blocks")
    ends = found.where("block IS NOT NULL")
    enough = ends.groupBy("block").agg(F.max("sure").alias("any"), F.count_distinct("doc").alias("docs")).where(F.col("any") | (F.col("docs") >= min_docs)).select("block")
    late = ends.join(enough, "block").select("doc", "line_no", "length")
    both = found.where("block IS NULL").select("doc", "line_no", "length").unionByName(late)
    return both.repartition("doc").groupBy("doc", "line_no").agg(F.max("length").alias("length"))


def repeated_blocks(docs: DataFrame, min_docs: int = 5, depth: int = DEPTH) -> DataFrame:
    """(id, source, line_no, length, lines): the longest block, up to ``depth`` lines, that starts at a line and spans min_docs documents of the source."""
    sequences = line_sequences(docs)
    return _places(sequences, min_docs, depth).join(sequences, "doc").select("id", "source", "line_no", "length", "lines")


def count_blocks(docs: DataFrame, min_docs: int = 5, depth: int = 2 * DEPTH) -> DataFrame:
    """(source, length, blocks, places): for each length up to ``depth``, how many blocks a source repeats and in how many places."""
    at = repeated_blocks(docs, min_docs, depth).select("source", "line_no", "lines", F.explode(F.sequence(F.lit(1), "length")).alias("length"))
    each = at.groupBy("source", "length", F.xxhash64(F.slice("lines", F.col("line_no") + 1, F.col("length"))).alias("block")).agg(F.count("*").alias("n"))
    return each.groupBy("source", "length").agg(F.count("*").alias("blocks"), F.sum("n").alias("places"))


def covered_lines(docs: DataFrame, min_docs: int = 5, min_block: int = 1) -> DataFrame:
    """(id, line_no) of every line that lies in a block of at least min_block lines spanning min_docs documents."""
    sequences = line_sequences(docs)
    at = _places(sequences, min_docs, max(DEPTH, min_block)).where(F.col("length") >= min_block).join(sequences.select("doc", "id"), "doc")
    if min_block == 1:  # the lines of a longer block are blocks of one line themselves
        return at.select("id", "line_no")
    return at.select("id", F.explode(F.sequence(F.col("line_no"), F.col("line_no") + (min_block - 1))).alias("line_no")).distinct()


def without_repeated_lines(docs: DataFrame, min_docs: int = 5, min_block: int = 1) -> DataFrame:
    """docs without their covered lines: (id, content, removed), a row per id; documents without any are unchanged."""
    gone = covered_lines(docs, min_docs, min_block).groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    kept = "array_join(filter(split(content, '\n', -1), (l, k) -> NOT array_contains(gone, k)), '\n')"
    out = docs.where("id IS NOT NULL").select("id", "content").dropDuplicates(["id"]).join(gone, "id", "left")
    return out.select("id", F.expr(f"if(gone IS NULL OR content IS NULL, content, {kept})").alias("content"), F.expr("coalesce(size(gone), 0)").alias("removed"))
