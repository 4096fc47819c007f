"""Sharding by extendible hashing, in DataFrame operations only.

A row's hash is read from its first bit on. The directory starts as one bucket; buckets
over the byte limit split on their next bit, all others stay as they are. What is split
are sums by hash prefix, not rows: rows are read once to sum and once to be assigned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwright.llm.common import durable

BITS = 60
#: Of these, the last bits come from the text: rows of one id part on them, and only there.
TEXT_BITS = 16
#: Bits that are summed below the depth that even sizes would need.
AHEAD = 6
#: Directory entries that are small enough to send to every task.
SENT_ROWS = 200_000


def hash_bits(key: Column, text: Column) -> Column:
    """60 bits: the first 44 of the key's MD5, then the first 16 of the text's."""
    part = lambda c, bits: F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, bits // 4)
    return F.conv(F.concat(part(key, BITS - TEXT_BITS), part(text, TEXT_BITS)), 16, 10).cast("long")


def prefix(h: str, depth: int) -> Column:
    return F.shiftright(h, BITS - depth) if depth else F.lit(0).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows, alone): the buckets of rows (h, n_bytes).

    Each bucket fits the limit, or all its rows have one hash (alone), which no bit can split.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(1, (max(0, total - 1) // limit).bit_length() + AHEAD))
    done: list[DataFrame] = []
    first, parents = 0, None
    while True:
        part = rows.select("h", "n_bytes", prefix("h", first).alias("parent"), prefix("h", depth).alias("prefix"))
        if parents is not None:
            part = part.join(parents, "parent", "left_semi")
        cells = durable(part.groupBy("prefix").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")))
        rest = cells
        for d in range(first, depth + 1):
            at = F.shiftright("prefix", depth - d)
            sums = rest.groupBy(at.alias("at")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"), (F.min("lo") == F.max("hi")).alias("alone"))
            sums = durable(sums.withColumn("leaf", (F.col("shard_bytes") <= limit) | F.col("alone")))
            done.append(sums.where("leaf").select(F.lit(d).alias("depth"), F.col("at").alias("prefix"), "shard_bytes", "shard_rows", "alone"))
            over = sums.where("NOT leaf").select("at")
            if not over.limit(1).count():
                break
            rest = rest.withColumn("at", at).join(over, "at", "left_semi").drop("at")
        else:
            first, parents = depth, over.withColumnRenamed("at", "parent")
            depth = min(BITS, depth + 8)
            continue
        break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return durable(out)


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Shard of each row of docs: id, n_bytes (UTF-8), depth, shard (its hash prefix as bits), shard_bytes, shard_rows, oversized.

    Rows of one id go to one shard while they fit the limit; where they don't, their texts
    part them. A shard is over the limit (oversized) only if all its rows have one hash: of
    their ids 44 bits, of their texts 16. That is so for copies of one row, and for texts of
    one id that fall together in 16 bits, which happens where one id has many shards' worth. One row comes out for each row that goes in; a null id hashes as an empty
    one, a null text has no bytes; an empty table has no shards. Columns named in keep are
    passed on; they may not have the names of the result.
    """
    own = {id_col, "n_bytes", "depth", "shard", "shard_bytes", "shard_rows", "oversized"}
    if own & set(keep):
        raise ValueError(f"columns of the result can't be kept: {sorted(own & set(keep))}")
    rows = docs.select(F.col(id_col).alias("id"), hash_bits(F.col(id_col), F.col(text_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), *[F.col(c).alias(f"__{c}") for c in keep])
    leaves = directory(rows, limit)
    size = leaves.count()
    depths = [r[0] for r in leaves.select("depth").distinct().orderBy("depth").collect()]  # at most 61
    key = leaves.withColumnRenamed("prefix", "at")
    key = F.broadcast(key) if size <= SENT_ROWS else key
    places = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix("h", d).alias("at")) for d in depths])) if depths else None
    if places is None:
        return docs.select(F.col(id_col), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).alias("depth"), F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows"), F.lit(False).alias("oversized"), *keep)
    put = rows.withColumn("place", places).select("id", "n_bytes", "place.depth", "place.at", *[f"__{c}" for c in keep]).join(key, ["depth", "at"])
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("at"), F.col("depth"), F.lit("0")))
    return put.select(F.col("id").alias(id_col), "n_bytes", "depth", bits.alias("shard"), "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversized"), *[F.col(f"__{c}").alias(c) for c in keep])


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """One folder with one file per shard, named b and the bits of the shard (readers would take bits alone for a number): id and text. A task holds whole shards, each within the limit."""
    put = assign_shards(docs, limit, id_col, text_col, keep=(text_col,))
    put.select(id_col, text_col, F.concat(F.lit("b"), "shard").alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)


def sql(limit: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 11) || substr(md5(coalesce(text, '')), 1, 4))::BIGINT AS h FROM documents),
lv AS (SELECT d.*, k AS depth, (h >> (60 - k))::BIGINT AS p FROM d, range(0, 61) t(k)),
b AS (SELECT depth, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM lv GROUP BY depth, p HAVING sum(n_bytes) <= {limit} OR min(h) = max(h)),
leaf AS (SELECT lv.doc_id, n_bytes, min_by({{'depth': lv.depth, 'p': lv.p, 'sb': shard_bytes, 'sr': shard_rows}}, lv.depth) AS x FROM lv JOIN b ON b.depth = lv.depth AND b.p = lv.p GROUP BY lv.doc_id, n_bytes, h)
SELECT doc_id, n_bytes, x.depth::INTEGER AS depth, CASE WHEN x.depth = 0 THEN '' ELSE lpad(bin(x.p), x.depth::INTEGER, '0') END AS shard,
  x.sb AS shard_bytes, x.sr AS shard_rows, x.sb > {limit} AS oversized FROM leaf
"""
