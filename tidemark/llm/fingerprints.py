"""Document fingerprints, with DataFrame functions only: SimHash of weighted terms, and search by permuted block tables.

A term is two neighbouring words (a text of one word: that word). Each occurrence votes with the letters of its words, WEIGHT at
most, on each of 128 bits: for a bit that its hash has set, else against. A fingerprint has the bits that won; it depends on
its text alone, so old fingerprints hold as a corpus grows. The share of differing bits estimates the angle between two texts'
term vectors, and `likeness` is its cosine, not under 0.

Votes are counted two bits at a time: 64 sums over the terms of a row, each of the hash's bits j and j + 32 in the halves of one
number. A half holds up to 2^31, and a text's weights add up to less than twice its bytes, so texts may have 2^30 bytes. The sums are those of a hash aggregate over exploded positions, in generated code.

Search: cut into BLOCKS blocks, fingerprints within a radius below BLOCKS agree in at least BLOCKS - radius of them. There's a table for
each choice of that many blocks, keyed by these (the fingerprint permuted so that they stand in front); a search looks up
one key in each table, and a pair that several tables find counts in the first only. Index entries are different
fingerprints with their number of documents, so copies of one text are one entry however many they are.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: Bits of a fingerprint: two hashes of 64.
BITS = 128
#: Most that one term's occurrence weighs.
WEIGHT = 15
#: Blocks of a fingerprint, and documents' fingerprints that differ in at most RADIUS bits are near.
BLOCKS, RADIUS = 4, 3
#: Documents of a range of ids, and ranges at most (their first ids come to the driver and to each task).
RANGE_DOCS, RANGES = 256, 1 << 16
_LOW, _PAIR = 0xFFFFFFFF, (1 << 32) | 1


def words(text: Column) -> Column:
    """The words of a text; one empty word if it has none."""
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")


def _bits(sums: str, weight: str) -> Column:
    """The 64 bits of one hash that won, from 32 sums (columns sums_0 to sums_31) of two bits each."""
    low = [f"if(2 * ({sums}_{j} & {_LOW}) > {weight}, {1 << j}, 0)" for j in range(32)]
    high = [f"if(2 * shiftrightunsigned({sums}_{j}, 32) > {weight}, shiftleft(1L, {32 + j}), 0)" for j in range(32)]
    return F.expr(" | ".join(low + high))


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, f1, f2) for each value of keys, which name a row: the halves of the fingerprint of its text.

    Null text is the empty one; a text without words has fingerprint 0. Rows of equal keys vote together. Names of other columns don't matter.
    """
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - 2, F.lit(0)))).alias("_i")
    terms = rows.select(*keys, words(F.coalesce(F.col(text), F.lit(""))).alias("_w")).select(*keys, "_w", at)
    one, two = F.get("_w", F.col("_i")), F.get("_w", F.col("_i") + 1)
    weight = F.least(F.char_length(one) + F.coalesce(F.char_length(two), F.lit(0)), F.lit(WEIGHT)).cast("long")
    voting = terms.select(*keys, weight.alias("_weight"), F.xxhash64(one, two).alias("_h1")).withColumn("_h2", F.xxhash64("_h1", F.lit(1)))
    sums = [F.expr(f"sum((shiftrightunsigned({h}, {j}) & {_PAIR}) * _weight) AS {h}_{j}") for h in ("_h1", "_h2") for j in range(32)]
    voted = voting.groupBy(*keys).agg(F.sum("_weight").alias("_weight"), *sums)
    return voted.select(*keys, _bits("_h1", "_weight").alias("f1"), _bits("_h2", "_weight").alias("f2"))


def as_text(f1: Column, f2: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (f1, f2)]))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Differing bits."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Cosine of the angle that the share of differing bits estimates, from 0 to 1; equal fingerprints have 1."""
    return F.greatest(F.lit(0.0), F.cos(distance(a, b) * F.lit(3.141592653589793 / BITS)))


# the next document


def _starts(ids: DataFrame, range_docs: int, most: int) -> list[int]:
    """First ids of the ranges that ids fall into, from the largest down; null ids belong to the last range.

    Ids are range-partitioned, and each partition gives its first and every so manieth after it.
    """
    rows = ids.count()
    each, dealt_to = max(range_docs, -(-rows // most)), int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.where("_id IS NOT NULL").repartitionByRange(min(rows // each + 1, dealt_to), F.col("_id").desc())
    inside = Window.partitionBy("_part").orderBy(F.col("_id").desc())
    numbered = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.row_number().over(inside))
    found = numbered.where((F.col("_at") - 1) % each == 0).select("_id").distinct().collect()
    return sorted((r[0] for r in found), reverse=True)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_docs: int = RANGE_DOCS) -> DataFrame:
    """(_id, _body, _next, _range, _guest, _at): each row's id and text (null: empty) with the next row's text.

    The order is by falling id, null ids last, equal ids by a hash of the text; after the last row comes the first. Texts move once, to
    their range of ids; the first document of a range is also a guest at the end of the range before, where it's the next one of
    that range's last. _at is the place in the range. Rows of one id are in one range, whose window spills what memory can't hold.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_body"))
    starts = _starts(base.select("_id"), range_docs, RANGES)
    wide = max(1, round(len(starts) ** 0.5))
    if starts:  # ranges are found in two steps of about the root of their number each
        nested = F.from_json(F.lit(str([starts[at : at + wide] for at in range(0, len(starts), wide)])), "array<array<bigint>>")
        from_here = lambda firsts: F.size(F.filter(firsts, lambda s: s >= F.col("_id")))
        base = base.withColumn("_row", F.greatest(F.lit(1), from_here(F.transform(nested, lambda x: x[0])))).withColumn("_firsts", F.element_at(nested, F.col("_row")))
        last = F.lit(len(starts) - 1)
        base = base.withColumn("_own", F.when(F.col("_id").isNull(), last).otherwise((F.col("_row") - 1) * wide + from_here(F.col("_firsts")) - 1).cast("int"))
        first = F.coalesce(F.element_at("_firsts", F.col("_own") % wide + 1) == F.col("_id"), F.lit(False))
    else:  # no row has an id
        base, first = base.withColumn("_own", F.lit(0)), F.lit(True)
    before = F.pmod(F.col("_own") - 1, F.lit(max(1, len(starts)))).cast("int")
    stays, visits = F.struct(F.col("_own").alias("range"), F.lit(False).alias("guest")), F.struct(before.alias("range"), F.lit(True).alias("guest"))
    placed = base.withColumn("_to", F.explode(F.when(first, F.array(stays, visits)).otherwise(F.array(stays))))
    placed = placed.select("_id", "_body", F.col("_to.range").alias("_range"), F.col("_to.guest").alias("_guest"))
    order = Window.partitionBy("_range").orderBy("_guest", F.col("_id").desc_nulls_last(), F.xxhash64("_body"))
    return placed.withColumns({"_at": F.row_number().over(order), "_next": F.lead("_body").over(order)})


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_docs: int = RANGE_DOCS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, f1, f2, e1, e2, near_edited, near_next), a row for each row of docs.

    The edited text (fingerprint e1, e2) is the text with its last floor(n_chars / 2) code points replaced by the first as many of
    the next document's (all, if it has fewer); with_next states the order. Null text is empty; a lone document is its own next
    one; repeated rows each have a place in the order. Other columns of docs aren't used. An empty table gives no rows.
    """
    half = F.floor(F.col("_n") / 2).cast("int")
    new = F.concat(F.substring(F.col("_body"), F.lit(1), F.col("_n") - half), F.substring(F.coalesce(F.col("_next"), F.lit("")), F.lit(1), half))
    placed = with_next(docs, doc_id, text, range_docs).withColumn("_n", F.char_length("_body")).withColumn("_new", new)
    at = ["_range", "_at"]
    known = placed.select(*at, "_guest", "_id", F.col("_n").cast("long").alias("n_chars"), F.sha2("_new", 256).alias("edited_sha256"))
    both = placed.select(*at, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("_body").alias("t")), F.struct(F.lit(1).alias("which"), F.col("_new").alias("t")))).alias("_x"))
    voted = fingerprints(both.select(*at, F.col("_x.which").alias("_which"), F.col("_x.t").alias("_t")), [*at, "_which"], "_t")
    of = lambda which, f: F.max(F.when(F.col("_which") == which, F.col(f)))
    pairs = voted.groupBy(*at).agg(of(0, "f1").alias("f1"), of(0, "f2").alias("f2"), of(1, "f1").alias("e1"), of(1, "f2").alias("e2"))
    order = Window.partitionBy("_range").orderBy("_at")
    found = known.join(pairs, at).withColumns({"_g1": F.lead("f1").over(order), "_g2": F.lead("f2").over(order)}).where(~F.col("_guest"))
    mine = F.col("f1"), F.col("f2")
    return found.select(
        F.col("_id").alias("doc_id"), "n_chars", "edited_sha256", "f1", "f2", "e1", "e2",
        likeness(mine, (F.col("e1"), F.col("e2"))).alias("near_edited"), likeness(mine, (F.col("_g1"), F.col("_g2"))).alias("near_next"),
    )


# search


def _tables(rows: DataFrame, blocks: int, radius: int) -> DataFrame:
    """rows, once for each table, with _table and _key: the blocks that the table's permutation has in front."""
    width = BITS // blocks
    mask = F.lit((1 << width) - 1) if width < 64 else F.lit(-1)
    block = [F.shiftrightunsigned(f, 64 - width * (i + 1)).bitwiseAND(mask) for f in ("f1", "f2") for i in range(blocks // 2)]
    keys = [F.struct(F.lit(t).alias("t"), F.array(*[block[i] for i in front]).alias("k")) for t, front in enumerate(combinations(range(blocks), blocks - radius))]
    return rows.withColumn("_x", F.explode(F.array(*keys))).select(*rows.columns, F.col("_x.t").alias("_table"), F.col("_x.k").alias("_key"))


def near_counts(index: DataFrame, searches: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(f1, f2, n_near) for each different fingerprint of searches: rows of index within radius of it, itself included.

    All of them are found, whatever their number. Rows of index without a fingerprint match nothing; blocks is 2, 4, 8 or 16 and above
    radius (ValueError if not). More blocks suit larger radii, fewer blocks larger indexes: a key has BITS / blocks * (blocks - radius) bits.
    A bucket that many entries share is split by Spark where its join is skewed, as searches and entries of a key meet by any split.
    """
    if blocks not in (2, 4, 8, 16) or not 0 <= radius < blocks:
        raise ValueError(f"{blocks} blocks can't tell a radius of {radius}: take 2, 4, 8 or 16, and more than the radius")
    entries = index.where("f1 IS NOT NULL").groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("_docs"))
    wanted = cut(searches.where("f1 IS NOT NULL").select("f1", "f2").distinct())
    asked = _tables(wanted, blocks, radius).withColumnsRenamed({"f1": "_s1", "f2": "_s2"})
    width = BITS // blocks
    differ = F.col("f1").bitwiseXOR(F.col("_s1")), F.col("f2").bitwiseXOR(F.col("_s2"))
    mask = F.lit((1 << width) - 1) if width < 64 else F.lit(-1)
    equal = [F.shiftrightunsigned(d, 64 - width * (i + 1)).bitwiseAND(mask) == 0 for d in differ for i in range(blocks // 2)]
    first = F.lit(None)
    for t, front in reversed(list(enumerate(combinations(range(blocks), blocks - radius)))):
        agree = equal[front[0]]
        for i in front[1:]:
            agree = agree & equal[i]
        first = F.when(agree, F.lit(t)).otherwise(first)
    near = (F.bit_count(differ[0]) + F.bit_count(differ[1]) <= radius) & (first == F.col("_table"))
    found = _tables(entries, blocks, radius).join(asked, ["_table", "_key"]).where(near)
    counts = found.groupBy("_s1", "_s2").agg(F.sum("_docs").alias("n_near"))
    return counts.select(F.col("_s1").alias("f1"), F.col("_s2").alias("f2"), "n_near")
