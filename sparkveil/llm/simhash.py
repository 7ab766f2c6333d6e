"""SimHash near-duplicates: positional byte index, count filter, verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

#: The 64 bits are read as four blocks of two bytes; two blocks make one posting.
BLOCKS = 4
#: Postings with more fingerprints than this are linked through one-bit variants, not pairs.
PAIR_LIMIT = 64


def _fingerprint(text: bytes | None, width: int, seed: int) -> int:
    words = (text or b"").lower().split()  # bytes: A-Z only, blanks \x20 \x09-\x0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        join = b" ".join
        hashes = [digest(join(s), seed) for s in zip(*(words[i:] for i in range(width)))]
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(values), 16384):
        part = values[start : start + 16384]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, row: Column | None = None) -> DataFrame:
    """(id, row long, fp long): the SimHash of every whole text, one row per input row.

    ``row`` is handed on (null without it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_fingerprint(t.as_py(), width, seed) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["id", "row", "fp"])

    row = F.lit(None) if row is None else row
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row.cast("long").alias("row"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, row long, fp long")


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _postings(nodes: DataFrame) -> DataFrame:
    """(key, fp): six postings of a fingerprint, each naming two blocks and their four bytes."""
    fp = F.col("fp")
    keys = [
        F.lit(k << 32).bitwiseOR(F.shiftleft(_block(fp, i), 16)).bitwiseOR(_block(fp, j))
        for k, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def _shared_bytes(a: Column, b: Column) -> Column:
    diff = a.bitwiseXOR(b)
    total = F.lit(0)
    for i in range(8):
        total = total + (F.shiftrightunsigned(diff, 8 * i).bitwiseAND(F.lit(0xFF)) == 0).cast("int")
    return total


def links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """``nodes`` (fp, distinct) to (u, v) edges that connect all fingerprints within ``max_bits``.

    Two fingerprints that differ in at most two bits share at least six of their eight positional
    bytes. Single bytes make useless postings (each holds 1/256 of the corpus), so bytes are indexed
    four at a time: two differing bytes leave two of the four blocks whole, hence one of the six
    postings is shared. For each pair of a posting the shared bytes are tallied, pairs under six are
    dropped, and the rest are verified bit by bit. A posting of more than ``PAIR_LIMIT`` fingerprints
    makes no pairs: its members agree on four bytes, so two of them are within two bits exactly when
    they share a variant that flips at most one of the other 32 bits; each variant links its members
    to the smallest of them, which is exact and linear.
    """
    if max_bits != 2:
        raise ValueError("the index is built for two differing bits")
    postings = _postings(nodes)
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    postings = cut(postings.join(sizes, "key"), "postings")
    few = postings.where(F.col("n") <= PAIR_LIMIT).select("key", "fp")
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("u") < F.col("v")) & (_shared_bytes(F.col("u"), F.col("v")) >= 8 - max_bits) & close)

    many = postings.where(F.col("n") > PAIR_LIMIT)
    flips = None
    for k, (i, j) in enumerate(combinations(range(BLOCKS), 2)):
        free = [bit for block in range(BLOCKS) if block not in (i, j) for bit in range(16 * block, 16 * block + 16)]
        masks = F.array(F.lit(0).cast("long"), *(F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)).cast("long") for bit in free))
        flips = masks if flips is None else F.when(F.shiftright("key", 32) == k, masks).otherwise(flips)
    variants = many.select("key", "fp", F.explode(flips).alias("flip")).select(
        "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant")
    )
    anchors = variants.groupBy("key", "variant").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).where("v < top")
    starred = variants.join(anchors, ["key", "variant"]).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.select("u", "v").union(starred)


def _groups(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id): the group of every fingerprint of ``rows`` (id, fp)."""
    nodes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(links(nodes.select("fp")))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return cut(named.join(names, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows give
    repeated result rows; a null id is never the name of a component (a component of null ids only
    has a null name). Other columns of ``docs`` are ignored, whatever their names. An empty table
    gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col).select("id", "fp"), "fingerprints")
    return rows.join(_groups(rows), "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each near-duplicate group, all columns: that with the smallest id.

    Rows are told apart by their id and a hash of all their columns, not by the id alone: rows that
    repeat an id with other texts are documents of their own, and of wholly equal rows one stays. A
    null id counts as the largest.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.select(*(F.col(c).alias(n) for c, n in names.items())).withColumn("row", F.xxhash64(*names.values()))
    id_name = names[id_col]
    rows = cut(fingerprints(keyed, id_name, names[text_col], row=F.col("row")), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("first")
    kept = rows.join(_groups(rows).select("fp", "root"), "fp").groupBy("root").agg(first).select(F.col("first.id").alias("kept_id"), F.col("first.row").alias("kept_row"))
    same = (keyed["row"] == kept["kept_row"]) & keyed[id_name].cast("long").eqNullSafe(kept["kept_id"])
    one = keyed.join(kept, same, "left_semi").dropDuplicates(["row", id_name])
    return one.select(*(F.col(n).alias(c) for c, n in names.items()))
