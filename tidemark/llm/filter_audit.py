"""Filter interaction audit: what each filter of a chain removes in any order, by the multilinear extension.

Every document has a mask of the filters that it fails. Of a part's documents, let c(m) be the number with mask m. If filter i
stands in the chain with probability x_i, the expected number removed is the part's removal polynomial

    f(x) = sum over m of c(m) * (1 - product over i in m of (1 - x_i)) = sum over S of a(S) * product over i in S of x_i

with a(S) = (-1)^(|S| + 1) * (number of documents that fail all of S). It answers everything: at the corner where just the
filters T stand f is what T removes, in any order, so what a filter removes after T is the difference of two corners; and a filter's
Shapley value is the integral of its partial derivative along the diagonal, the sum of a(S) / |S| over the S with i, in
exact rationals. Times the number of orders it is a whole number: what the filter removes, summed over all orders.

Spark counts masks: texts never move, only a digest and the mask of each; counts meet pre-aggregated, so one text or part may
hold any share of all rows. A task then takes parts of 2^filters counts each, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed by the contract: letters of the filters and their limits.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, ODD = 200, 50, 2, r"[#$%&*|]"
_SPACES = "\\x20\\x09-\\x0D"
COUNTED = ("n", "good", "toxic")
_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def words(text: Column) -> Column:
    """The words of a text, in order; of one without words, none."""
    bare = F.regexp_replace(text, f"^[{_SPACES}]+|[{_SPACES}]+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{_SPACES}]+"))


def own_failures(text: Column, listed: Column) -> list[Column]:
    """Conditions A to D on a text that isn't null and its words."""
    n = F.size(listed)
    return [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(listed)) < DISTINCT_PERCENT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > UPPER_PERCENT * F.char_length(text),
        text.rlike(ODD),
    ]


def mask_counts(docs: DataFrame, labels: DataFrame | None, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask, bit i for FILTERS[i], and those labelled good and toxic.

    Null text is the empty one, a null part the empty string. A document is a copy (E) if a row of the same text has a smaller
    id; rows without an id are no copies and make none; rows of one id and text aren't copies of each other. Repeated rows
    count each. A document is good (toxic) if any of its labels has quality (toxic) 1. Columns other than the named ones
    aren't used. An empty table gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("_text")).withColumn("_words", words(F.col("_text")))
    bits = [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(own_failures(F.col("_text"), F.col("_words")))]
    narrow = base.select("_id", "part", F.unhex(F.sha2("_text", 256)).alias("_digest"), sum(bits[1:], bits[0]).alias("_mask"))
    if labels is None:
        marked = narrow.withColumns({"_good": F.lit(0), "_toxic": F.lit(0)})
    else:
        known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
        marked = narrow.join(known, F.col("_id") == F.col("_of"), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_good", "_toxic")})
    # a row a document first (its rows are together after the join), then a row a text, part and labels, from partial sums
    key = ["_digest", "part", "_mask", "_good", "_toxic"]
    single = marked.groupBy("_id", *key).agg(F.count(F.lit(1)).alias("_rows"))
    same_text = single.groupBy(*key).agg(F.sum("_rows").alias("_rows"), F.min("_id").alias("_least"), F.min_by("_rows", "_id").alias("_at_least"), F.sum(F.when(F.col("_id").isNull(), F.col("_rows")).otherwise(0)).alias("_nameless"))
    first = F.min("_least").over(Window.partitionBy("_digest"))
    stay = F.col("_nameless") + F.when(F.col("_least") == F.col("_first"), F.col("_at_least")).otherwise(0)
    both = same_text.withColumn("_first", first).select("part", "_mask", "_good", "_toxic", F.explode(F.array(F.struct(F.lit(0).alias("copy"), stay.alias("n")), F.struct(F.lit(16).alias("copy"), (F.col("_rows") - stay).alias("n")))).alias("x"))
    n = F.col("x.n")
    return both.where(n > 0).groupBy("part", (F.col("_mask") + F.col("x.copy")).alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("_good")).alias("good"), F.sum(n * F.col("_toxic")).alias("toxic"))


class Removal:
    """The removal polynomial of counts by mask of failing filters, in monomials: coefficient of each set of filters."""

    def __init__(self, counts: dict[int, int], filters: int) -> None:
        self.filters, self.total = filters, sum(counts.values())
        failing_all = {s: sum(c for m, c in counts.items() if m & s == s) for s in range(1, 1 << filters)}
        self.terms = {s: (1 if s.bit_count() % 2 else -1) * n for s, n in failing_all.items()}

    def at(self, corner: int) -> int:
        """Value where the filters of corner stand and no others: what they remove."""
        return sum(a for s, a in self.terms.items() if s & corner == s)

    def shapley(self, i: int) -> Fraction:
        """Integral over t from 0 to 1 of the partial derivative by x_i at x = (t, ..., t)."""
        return sum((a * Fraction(1, s.bit_count()) for s, a in self.terms.items() if s >> i & 1), Fraction(0))


def part_report(counts: list[tuple[int, int, int, int]], filters: str = FILTERS) -> Iterator[tuple]:
    """Rows (filter_order, step, kept, ..., shapley) of one part's counts (mask, n, good, toxic)."""
    size = len(filters)
    docs, good, toxic = (Removal({m[0]: m[k] for m in counts}, size) for k in (1, 2, 3))
    corners = {name: [p.at(t) for t in range(1 << size)] for name, p in (("docs", docs), ("good", good), ("toxic", toxic))}
    everything = (1 << size) - 1
    scaled = [factorial(size) * docs.shapley(i) for i in range(size)]
    for order in permutations(range(size)):
        done = 0
        for step, i in enumerate(order, 1):
            now = done | 1 << i
            removed, good_lost, toxic_lost = (corners[x][now] - corners[x][done] for x in ("docs", "good", "toxic"))
            failing, alone = corners["docs"][1 << i], corners["docs"][everything] - corners["docs"][everything ^ 1 << i]
            yield "".join(filters[j] for j in order), step, docs.total - corners["docs"][now], removed, failing - removed, alone, good_lost, toxic_lost, int(scaled[i])
            done = now


def _reports(filters: str):
    """Rows (part, counts) -> all orders and steps of each part."""
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(part, *x) for x in part_report([(c["mask"], c["n"], c["good"], c["toxic"]) for c in counts], filters)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of filters and step, from counts (part, mask, n, good, toxic), a row for each part and mask.

    kept: documents left after the step; removed: by it; redundant: failing its filter but removed before; unique_fails:
    failing no other; good_lost, toxic_lost: removed here with the label; shapley: what its filter removes, summed over all orders.
    A part has all its orders, zeros included; no counts give no rows. Beyond a handful of filters the orders are too many to list.
    """
    lists = counts.groupBy("part").agg(F.collect_list(F.struct(F.col("mask").cast("int").alias("mask"), *COUNTED)).alias("counts"))
    return lists.select("part", "counts").mapInArrow(_reports(filters), _OUT)
