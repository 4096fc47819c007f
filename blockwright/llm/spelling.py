"""Spelling variants by permuterm rotations.

Each word gets a terminator and is rotated. What a rotation says after its last letter is
left out is a key: words that differ in that letter only share it, and a word that lacks
the letter is the key itself as a whole rotation. So the sorted rotations are groups of one
prefix, at most one word for each letter of the alphabet and one shorter word, and one scan
of a group gives each member the number of its neighbours there and the best of them; pairs
are never listed.

Words of more than LONG letters would have rotations of quadratic size. Theirs travel as
127-bit hashes, in words' ranks; two different rotations meet by accident with a probability
of some 2^-120.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockwright.llm.common import LOWER, UPPER, discard, durable, lean, sent

#: Words of more letters are rotated as hashes.
LONG = 64
ALPHABET = "a-zÀ-ÿ"
#: Fixed for all tasks: modulus and base of the rotations' hashes.
MODULUS, BASE = (1 << 127) - 1, 0x5DEECE66D1B3F0A9C3D2E1F70819


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7, least_count: int = 2, slip: int | None = 31) -> DataFrame:
    """word, n: maximal runs of letters of all texts, A-Z in lower case, that are long and frequent enough.

    slip: where it divides the crc32 of "id:run", the run loses the letter at that crc32
    modulo its length (None: no run does). A null id counts as an empty one there; null and
    empty texts have no runs.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"([{ALPHABET}]{{{least_letters},}})"), F.lit(1))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("word"))
    if slip:
        h, size = F.col("h"), F.length("word")
        at = F.pmod(h, size).cast("int")
        found = found.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary")))
        found = found.withColumn("word", F.when(h % slip == 0, F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))).otherwise(F.col("word")))
    counts = found.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= least_count) & (F.length("word") >= least_letters))


def rotations(words: DataFrame) -> DataFrame:
    """who, n, key, edited, first: whole rotations, and rotations without their last letter (edited).

    first: the left-out letter isn't a repetition of the one before it; leaving out any
    letter of a run of equal ones gives the same shorter word, which counts once.
    """
    whole = "transform(sequence(0, length(word)), i -> struct(concat(substring(word, i + 1), '$', substring(word, 1, i)) AS key, false AS edited, false AS first))"
    edited = (
        "transform(sequence(1, length(word)), i -> struct(concat(substring(word, i + 1), '$', substring(word, 1, i - 1)) AS key, true AS edited,"
        " i = 1 OR substring(word, i, 1) <> substring(word, i - 1, 1) AS first))"
    )
    return words.select(F.col("word").alias("who"), "n", F.inline(F.expr(f"concat({whole}, {edited})")))


def hashed_rotations(words: DataFrame) -> DataFrame:
    """The same for long words (rank, word, n), with hashes as keys and ranks as names. Words of just LONG letters come as whole rotations only: they may lack a letter of a longer one."""

    def run(batches):
        schema = pa.schema([("who", pa.int64()), ("n", pa.int64()), ("key", pa.string()), ("edited", pa.bool_()), ("first", pa.bool_())])
        for batch in batches:
            for who, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                heads, powers, size = [0], [1], len(word)
                for c in word:
                    heads.append((heads[-1] * BASE + ord(c)) % MODULUS)
                    powers.append(powers[-1] * BASE % MODULUS)

                def key(tail: int, head: int) -> str:
                    """Of the letters from tail on, the terminator and the first head letters."""
                    end = (heads[size] - heads[tail] * powers[size - tail]) % MODULUS
                    return f"{((end * BASE + 36) * powers[head] + heads[head]) % MODULUS:x}:{size - tail + head}"

                rows = [(key(i, i), False, False) for i in range(size + 1)]
                if size > LONG:
                    rows += [(key(i + 1, i), True, i == 0 or word[i] != word[i - 1]) for i in range(size)]
                for at in range(0, len(rows), 65536):
                    some = rows[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([who] * len(some), pa.int64()), pa.array([n] * len(some), pa.int64()), *(pa.array([r[k] for r in some]) for k in range(3))], schema=schema)

    return words.select("rank", "word", "n").mapInArrow(lean(run), "who long, n long, key string, edited boolean, first boolean")


def neighbours(rotated: DataFrame) -> DataFrame:
    """who, n_near, best (struct of -n and the name) of each word that has neighbours. Groups of one key are scanned in the order of their counts."""
    scan = Window.partitionBy("key").orderBy(F.desc("edited"), F.desc("n"), "who")
    group = scan.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("less"), F.col("who").alias("word"))
    rows = rotated.withColumns({
        "edits": F.count_if("edited").over(group), "shorter": F.min(F.when(~F.col("edited"), me)).over(group),
        "longer": F.min(F.when(F.col("first"), me)).over(group), "longers": F.count_if("first").over(group),
        "top": F.first(me).over(scan), "place": F.row_number().over(scan), "next": F.lead(F.when(F.col("edited"), me)).over(scan),
    })
    other = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top"))
    insertion = F.col("first") & F.col("shorter").isNotNull()
    near = F.when(F.col("edited"), F.col("edits") - 1 + insertion.cast("long")).otherwise(F.col("longers"))
    best = F.when(F.col("edited"), F.least(other, F.when(insertion, F.col("shorter")))).otherwise(F.col("longer"))
    return rows.select("who", near.alias("near"), best.alias("best")).where("near > 0").groupBy("who").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct less, word): how many words differ by one inserted, deleted or replaced letter, and the most frequent of them (ties: the smallest). words: word, n, without repetitions."""
    near = neighbours(rotations(words.where(F.length("word") <= LONG))).withColumnRenamed("who", "word")
    if not words.where(F.length("word") > LONG).limit(1).count():
        return near
    long = durable(words.where(F.length("word") >= LONG).orderBy("word").withColumn("rank", F.monotonically_increasing_id()))
    found = neighbours(hashed_rotations(long))
    name = long.select(F.col("rank").alias("who"), "word")
    best = name.select(F.col("who").alias("best_rank"), F.col("word").alias("best_word"))
    found = found.join(name, "who").join(best, F.col("best.word") == F.col("best_rank"))
    found = found.select("word", "n_near", F.struct(F.col("best.less").alias("less"), F.col("best_word").alias("word")).alias("best"))
    return near.unionByName(found).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variant_roots(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word (word, n).

    form: the most frequent near word (ties: the smallest), where it is at least so many
    times as frequent; form_n its n. root: the last of the forms from the word on. As n
    grows at least so many times with each step, a chain has at most log n links, and they
    are followed by doubling steps. No words give no rows.
    """
    words = durable(words)
    joined = words.join(near_words(words), "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    out = durable(joined.select("word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    links = durable(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    most, hops, reach = words.agg(F.max("n")).first()[0] or 1, 0, 1
    discard(words)
    while most >= times:
        most, hops = most // times, hops + 1
    while reach < hops:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = durable(links.join(sent(further), "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
        discard(links)
        links, reach = longer, 2 * reach
    roots = links.select(F.col("word").alias("__word"), "root")
    return out.join(sent(roots), F.col("word") == F.col("__word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of a table of texts with their spelling variants resolved: see counted_words and variant_roots.

    Null and empty texts and an empty table give no words; rows that are repeated count
    again; other columns of any name are left alone.
    """
    return variant_roots(counted_words(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text"))


#: The same in DuckDB: words meet where deletions at one place give one string, so every pair is listed.
SQL = """
WITH bits AS (
    SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tbl
    FROM (SELECT range::BIGINT AS b FROM range(256))
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL
), coded AS (
    SELECT run, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END)) AS bytes FROM counted
), hashed AS (
    SELECT run, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM coded, bits
), words AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2
), cut AS (
    SELECT word, n, i AS place, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)
), pairs AS (
    SELECT a.word AS word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
    UNION
    SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION
    SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY 1
), forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)
), followed AS (
    WITH RECURSIVE f(word, tip) AS (SELECT word, word FROM forms UNION ALL SELECT f.word, forms.form FROM f JOIN forms ON f.tip = forms.word WHERE forms.form IS NOT NULL)
    SELECT f.word, f.tip AS root FROM f JOIN forms ON f.tip = forms.word WHERE forms.form IS NULL
)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN followed USING (word)
"""
