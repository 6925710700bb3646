"""Threshold-scaled document fingerprints.

A document's shingles are its runs of five words (letters and digits, lower
case); a text of fewer words is one shingle, and a text without words is its own
single shingle.  The fingerprint keeps every shingle hash below a fixed fraction
of the hash range, and always the smallest one, so no fingerprint is empty.  Its
size grows with the document, so documents of very unequal lengths compare
without bias; fingerprints of parts merge by union into the fingerprint of the
whole, and give estimates of resemblance and containment.

A null text counts as empty.  Equal texts have equal fingerprints.  Repeated rows
come back each; an empty table gives no rows.  Other columns are ignored,
whatever their names.  All work is done by built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

SHINGLE = 5
FRACTION = 1 / 8
WORD = r"[\p{L}\p{N}]+"
_POSITIVE = (1 << 63) - 1


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words in order; of the text itself if it has none."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    return F.when(text.rlike(WORD), words).otherwise(F.array(F.xxhash64(text)))


def limit(fraction: float = FRACTION) -> int:
    return min(int(fraction * (1 << 63)), _POSITIVE)


def _sketch(hashes: Column, fraction: float) -> Column:
    # the smallest hash is appended, not looked for inside the filter, where it would
    # be computed anew for every element
    below = F.filter(hashes, lambda x: x < limit(fraction))
    return F.array_sort(F.array_distinct(F.concat(below, F.array(F.array_min(hashes)))))


def with_fingerprint(df: DataFrame, text_col: str, out: str, fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``out``, the sorted array of kept hashes of a text column without nulls."""
    words, hashes = f"{out}__w", f"{out}__h"
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - shingle, F.lit(0)))
    df = df.withColumn(words, word_hashes(F.col(text_col)))
    df = df.withColumn(hashes, F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(words), i + 1, shingle)).bitwiseAND(_POSITIVE)))
    return df.withColumn(out, _sketch(F.col(hashes), fraction)).drop(words, hashes)


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Fingerprint of the union of two documents' shingles."""
    return _sketch(F.concat(a, b), fraction)


def resemblance(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Share of the merged fingerprint that both have."""
    both = merge(a, b, fraction)
    return F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both)


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Share of ``a``'s shingles that ``b`` has too."""
    return F.size(F.array_intersect(a, b)) / F.size(a)


def written(sketch: Column) -> Column:
    """Fingerprint as text: fixed-width hexadecimal hashes in order."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), " ")


KEY = ["doc", "t1", "t2"]
#: equal rows that come out of one row of the join
COPIES = 1 << 16


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null as empty), ``n_chars`` and the row's key, which any
    scan gives alike: the id (null as 0) and 128 bits of hash over the text and whether
    the id is null.  Rows of one key are equal."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.char_length(text).cast("long").alias("n_chars"),
                       F.coalesce(doc_id, F.lit(0)).alias("doc"), F.xxhash64(text, doc_id.isNull()).alias("t1"),
                       F.xxhash64(F.lit("t2"), text, doc_id.isNull()).alias("t2"))


def ordered_rows(rows: DataFrame, partitions: int) -> DataFrame:
    """Adds ``pos``, each row's place (from 0) in descending id order, and the
    number of rows ``total``: a range sort of narrow rows, numbered within each
    partition and shifted by the counts of the partitions before it."""
    by = [F.col("doc_id").desc_nulls_last(), F.col("t1"), F.col("t2")]
    ranged = rows.repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    ranged = cut(ranged.withColumn("at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("part", F.shiftright("at", 33)).withColumn("nth", F.col("at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per range partition
    parts = (ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                     F.sum("n").over(everything).alias("total")))
    return ranged.join(F.broadcast(parts), "part").withColumn("pos", F.col("base") + F.col("nth")).drop("at", "part", "nth", "base")


def compare_with_edits(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of all documents and of their edited texts: the last half of a
    document's characters gives way to as many of the next document, in
    descending id order (null ids last, rows that share an id by text hash), the first
    one following the last.

    Rows are told apart by id and text, so it does not matter how the table is split
    when it is read again.  Equal rows follow each other: all but the last of them have
    a copy of themselves as next document.  They are one row until the end, and texts
    are shuffled once by that key and the borrowed halves once."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = keyed(docs)
    narrow = base.select("doc_id", *KEY, "n_chars").groupBy("doc_id", *KEY, "n_chars").agg(F.count(F.lit(1)).alias("copies"))
    order = cut(ordered_rows(narrow, partitions))
    to = [*[F.col(k).alias(f"to_{k}") for k in KEY], "doc_id", "n_chars"]
    of = [F.col(k).alias(f"from_{k}") for k in KEY]
    here = order.select(*to, ((F.col("pos") + 1) % F.col("total")).alias("next_pos"))
    following = here.join(order.select(*of, F.col("pos").alias("next_pos")), "next_pos").drop("next_pos").withColumn("times", F.lit(1).cast("long"))
    # all but one of equal rows have a copy of themselves as next document; a very large
    # group of them comes in parts
    again = order.filter(F.col("copies") > 1).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 2) / COPIES))))
    again = again.select(*to, *of, F.least(F.col("copies") - 1 - F.col("part") * COPIES, F.lit(COPIES)).cast("long").alias("times"))
    links = following.unionByName(again).withColumn("take", F.floor(F.col("n_chars") / 2).cast("int"))
    # both joins read the same columns by the same key, so one exchange serves both
    own = with_fingerprint(base.select(*KEY, "text"), "text", "fp", fraction).groupBy(*KEY).agg(F.first("text").alias("text"), F.first("fp").alias("fp"))
    lent = own.join(links, [own[k] == links[f"from_{k}"] for k in KEY]).select(
        *[f"to_{k}" for k in KEY], "doc_id", "n_chars", "take", "times", F.col("fp").alias("next_fp"),
        F.substring("text", F.lit(1), F.col("take")).alias("lent"))
    both = own.join(lent, [own[k] == lent[f"to_{k}"] for k in KEY])
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("take")).cast("int")), "lent"))
    both = with_fingerprint(both.select("doc_id", "n_chars", "times", "fp", "next_fp", "edited"), "edited", "edited_fp", fraction)
    rows = both.select(
        "times", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("fp")).alias("fingerprint"),
        written(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp"), fraction).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp"), fraction).alias("near_next"),
        containment(F.col("fp"), F.col("edited_fp"), fraction).alias("contained_in_edited"),
        containment(F.col("fp"), F.col("next_fp"), fraction).alias("contained_in_next"))
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("times")
