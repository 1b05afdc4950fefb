"""Best-fit packing by exact complements over the histogram of piece lengths.

The plan is made from counts per length alone: at most ``size`` numbers, whatever the corpus holds. Full
pieces are sequences of their own. Then, from the longest length down, gaps are closed exactly by one, two
or three shorter lengths whose sum is the gap, and used as often as their counts allow; what finds no exact
complement goes best-fit. As a sum has at most ``size`` values, the index of sums is direct: a bit mask of the
lengths that are left and its mirror, which moved by a sum tell at once all pairs that make it, instead of a hash
table of pairs. The plan is a list of patterns with multiplicities, and every piece finds its place from its rank
within its length, by bisection.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary, word_bpe
from .common import arrow_map, documents, saved

#: Tokens of a sequence; the id that ends a document.
SIZE, END = 2048, 0
#: Slots that a length's ranks are dealt over at least, and rows for which there is one more, so that no task ranks one length alone.
SALTS, SALT_ROWS = 64, 1_000_000


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every whole text; null counts as empty and has the end id alone."""

    def rows(given: Iterator[tuple]):
        bpe, last = word_bpe(path), array("I", [end]).tobytes()
        for doc_id, value in given:
            ids = bpe.encode(value or "") + last
            for n, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at : at + 4 * size]
                yield doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)

    return arrow_map(docs, ["doc_id", text], "doc_id long, piece int, start long, length long, ids_crc32 long", rows)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with sum <= size and how often each is used; together they use every length as often as it is there.

    A single length closes a gap if it equals it, a pair or triple if its sum does; pairs and triples come
    from the index of the lengths that are left. Each step uses a combination as often as the counts allow
    and so empties a length, which bounds the steps by the number of lengths.
    """
    left = {n: c for n, c in counts.items() if c and n}
    out: list[tuple[tuple[int, ...], int]] = []
    if size in left:
        out.append(((size,), left.pop(size)))
    # bit n of `have` tells whether length n is left, bit size - n of `mirror` the same: lengths a and sum - a that
    # are both left are the common bits of `have` and the mirror moved by the sum
    have = sum(1 << n for n in left)
    mirror = sum(1 << (size - n) for n in left)

    def use(pattern: tuple[int, ...]) -> None:
        nonlocal have, mirror
        need = Counter(pattern)
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                have ^= 1 << n
                mirror ^= 1 << (size - n)
        out.append((pattern, times))

    def there(*lengths: int) -> bool:
        return all(left.get(n, 0) >= lengths.count(n) for n in lengths)

    def pair(total: int, most: int, *others: int) -> tuple[int, int] | None:
        """The two lengths left that sum up to ``total``, the longer one as long as can be but ``most``."""
        if total < 2:
            return None
        common = have & (mirror >> (size - total)) & ((1 << (min(most, total) + 1)) - 1)
        while (a := common.bit_length() - 1) >= (total + 1) // 2:
            if there(*others, a, total - a):
                return a, total - a
            common ^= 1 << a
        return None

    def exact(long: int) -> tuple[int, ...] | None:
        gap = size - long
        if there(long, gap):
            return long, gap
        if two := pair(gap, gap, long):
            return long, *two
        firsts = have & ((1 << max(gap - 1, 0)) - 1)
        while (a := firsts.bit_length() - 1) >= max(1, (gap + 2) // 3):
            if two := pair(gap - a, a, long, a):
                return long, a, *two
            firsts ^= 1 << a
        return None

    # from the longest down: the hardest to place choose first, and prefer few and long partners
    for long in sorted(left, reverse=True):
        while long in left and (found := exact(long)):
            use(found)
    # residuals: best fit, still by counts: the longest length opens a sequence, and the longest that fits joins it until none does
    while left:
        first = max(left)
        pattern, gap, taken = [first], size - first, Counter([first])
        for n in sorted(left, reverse=True):
            if n <= gap and (k := min(gap // n, left[n] - taken[n])) > 0:
                pattern += [n] * k
                gap -= n * k
                taken[n] += k
        use(tuple(pattern))
    return out


#: The last place whose first rank is at most the row's: places cover the ranks without gaps, in order.
_BISECT = """_places[aggregate(sequence(1, 16), named_struct('lo', 0, 'hi', size(_places) - 1),
 (s, _) -> if(s.lo >= s.hi, s, if(_places[cast((s.lo + s.hi + 1) div 2 as int)]._from <= _rank, named_struct('lo', cast((s.lo + s.hi + 1) div 2 as int), 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi + 1) div 2 as int) - 1))), s -> s.lo)]"""


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, piece and length (1 to ``size``).

    Gapless from offset 0, no sequence longer than ``size``. Equal lengths are interchangeable, so repeated
    rows and ties are told apart by rank only. No rows give no rows. Columns that are named sequence_id or offset give way.
    """
    parts = saved(parts.drop("sequence_id", "offset"))
    salts = max(SALTS, parts.count() // SALT_ROWS)
    tagged = parts.withColumn("_salt", F.expr(f"pmod(xxhash64(doc_id, piece), {salts})"))
    by_slot = tagged.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    slots = by_slot.select("length", "_salt", "n", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["n"] for r in by_slot.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    use, at, base = [], {}, 0
    for pattern, times in plan(counts, size):
        offset = 0
        for length in pattern:
            use.append((length, at.get(length, 0), at.get(length, 0) + times, base, offset))
            at[length] = at.get(length, 0) + times
            offset += length
        base += times
    # Where a length's ranks go: each step of the plan empties a length, so its rows are bounded by `size`, not by the corpus.
    places = parts.sparkSession.createDataFrame(use, "length long, _from long, _to long, _base long, offset long")
    grouped = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_base", "offset"))).alias("_places"))
    ranked = tagged.join(slots.select("length", "_salt", "_before"), ["length", "_salt"]).withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1 + F.col("_before"))
    placed = ranked.join(F.broadcast(grouped), "length").withColumn("_p", F.expr(_BISECT))
    return placed.select(*parts.columns, (F.col("_p._base") + F.col("_rank") - F.col("_p._from")).alias("sequence_id"), F.col("_p.offset").alias("offset"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")))
