"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only.

A window is a run of item words (13, or the whole item where it has fewer). To contain a
window is to contain all its words, so one word of it is a sufficient prefix: the one
that the corpus holds least often. Text words are joined to windows on that word, the
position of the word in the window bounds where the window can start, and the whole
window is compared word by word at that place. Only places travel, never a text's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwright.llm.common import LOWER, UPPER, discard, durable

# What stands between words, and words, in texts whose A-Z are not in lower case yet.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of a table of words or windows that is small enough to send to every task (some 100 bytes each).
SENT_ROWS = 200_000


def split_words(text: Column) -> Column:
    """Words as they are written; A-Z go to lower case where they are compared."""
    return F.array_remove(F.split(text, NO_WORD), "")


def lowered(c: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.translate(c, UPPER, LOWER)


def send(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast what has been counted and is small; otherwise leave the join to shuffles."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def windows_of(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item, window, words): the windows of each item, lower case, words with single spaces between."""
    w = items.select(F.col(id_col).alias("item"), split_words(F.coalesce(text_col, F.lit(""))).alias("words")).where("item IS NOT NULL AND size(words) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1))))
    return w.select("item", "words", at.alias("at")).select("item", F.transform(F.slice("words", F.col("at"), size), lowered).alias("words")).select("item", "words", F.concat_ws(" ", "words").alias("window"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, per: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Words of each row of docs that stand in a window of items: id, n_words, n_hit, n_items, items, contaminated.

    items (array of strings, sorted) are the items with a window in the text. contaminated:
    n_hit > 0 and per * n_hit >= n_words. One row comes out for each row that goes in: null
    ids and repeated rows stay, a null text has no words. Items with a null id, a null text
    or no words have no windows; rows of one item id add up. Columns named in keep are passed on;
    they may not have the names of the result.
    """
    own = {id_col, "n_words", "n_hit", "n_items", "items", "contaminated"}
    if own & set(keep):
        raise ValueError(f"columns of the result can't be kept: {sorted(own & set(keep))}")
    wins = durable(windows_of(items, size, item_col, item_text_col).distinct())
    in_use = wins.select(F.explode("words").alias("w")).select(F.lower("w").alias("w")).distinct()
    in_use = durable(in_use)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    said = texts.select(F.explode(split_words(F.col("t"))).alias("v")).select(F.lower("v").alias("w"))
    held = said.join(send(in_use, in_use.count()), "w").groupBy("w").agg(F.count("*").alias("held"))
    spots = wins.dropDuplicates(["window"]).select("window", F.size("words").alias("m"), F.posexplode("words").alias("j", "v")).select("window", "m", "j", F.lower("v").alias("w"))
    rare = spots.join(held, "w", "left").groupBy("window", "m").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "w", "j")).alias("r"))
    rare = durable(rare.where("r.held > 0").select(F.col("r.w").alias("w"), F.col("r.j").alias("j"), "m", "window"))

    # where a window may stand: only places travel, the words are read again where there are any
    spot = texts.select("id", F.xxhash64("t").alias("mark"), split_words(F.col("t")).alias("words")).select("id", "mark", F.size("words").alias("n"), F.posexplode("words").alias("p", "v")).select("id", "mark", "n", "p", F.lower("v").alias("w"))
    fits = (F.col("p") >= F.col("j")) & (F.col("p") - F.col("j") + F.col("m") <= F.col("n"))
    maybe = spot.join(send(rare, rare.count()), "w").where(fits).select("id", "mark", (F.col("p") - F.col("j")).cast("int").alias("start"), "m", "window")
    whose = wins.groupBy("window").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("named"))
    whose = durable(whose)
    per_text = maybe.join(send(whose, whose.count()), "window").groupBy("id", "mark").agg(F.collect_set(F.struct("start", "m", "window", "named")).alias("__maybe"))
    per_text = durable(per_text.withColumnsRenamed({"id": "__id", "mark": "__mark"}))

    discard(wins, in_use, rare, whose)
    base = docs.select(F.col(id_col).alias("__own"), F.xxhash64(text_col).alias("__text"), F.col(text_col).alias("__t"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    base = base.join(send(per_text, per_text.count()), F.col("__id").eqNullSafe(F.col("__own")) & (F.col("__mark") == F.col("__text")), "left")
    same = lambda words: F.filter("__maybe", lambda c: lowered(F.concat_ws(" ", F.slice(words, c["start"] + 1, c["m"]))) == c["window"])
    found = F.when(F.col("__maybe").isNotNull(), F.transform(F.array(split_words(F.col("__t"))), same)[0])
    n_words = F.coalesce(F.regexp_count("__t", F.lit(WORD)), F.lit(0)).cast("long")
    out = base.select("*", n_words.alias("__words"), found.alias("__found"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("__found", lambda c: F.sequence(c["start"], c["start"] + c["m"] - 1)))))
    n_hit = F.when(F.col("__found").isNull(), 0).otherwise(hit).cast("long")
    items = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("__found", lambda c: c["named"])))), F.array().cast("array<string>"))
    out = out.select("*", n_hit.alias("__hit"), items.alias("__items"))
    dirty = (F.col("__hit") > 0) & (per * F.col("__hit") >= F.col("__words"))
    return out.select(F.col("__own").alias(id_col), F.col("__words").alias("n_words"), F.col("__hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.col("__items").alias("items"), dirty.alias("contaminated"), *[F.col(f"__keep_{c}").alias(c) for c in keep])


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
occ AS (SELECT doc_id, i, win.m, item_id FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM pos, (SELECT DISTINCT m FROM win) WHERE i + m - 1 <= len(w)) p JOIN win ON win.win = p.t AND win.m = p.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM occ GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
