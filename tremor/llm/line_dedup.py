"""Line dedup by a deletion-neighbourhood join, DataFrame functions only.

Lines are compared as sequences of words (the parts between spaces).  A line goes if an equal line comes earlier,
or if an earlier line is one word edit away (a word replaced, inserted or deleted) and the longer of the two has
at least `min_words` words; earlier means smaller (id, row, line number), null ids first.  Lines without words
stay.  What is earliest is looked up among all lines, kept or not, so a decision never depends on another.

Every line emits its deletion variants as hashed keys: with the place of the deletion, two lines that meet differ
by that one word; without it, a line meets the shorter lines it contains.  Only the earliest line of a key is
joined to the others, so a key that many lines share costs as many rows as it has lines, and each joined pair's
edit distance is verified on the words.

Lines that can have no neighbour emit nothing: of two lines one edit apart either the first or the last half (of
the shorter one's length) is equal, so only lines whose half occurs in another line take part.  The halves'
hashes are counted with map-side aggregation; those that two lines share set bits in a table of at most
2048 x 4 KB, which is broadcast.  A bit set by another half only costs a line that finds no partner.  Variants
that only one line has are left out of the joins in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import fresh, written

MIN_WORDS = 5
_BITS, _BUCKET = 1 << 26, 1 << 15
_LONG = 4096
#: Two independent 64-bit hashes name a line.
_LINE = ["h1", "h2"]


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """`df` with a column that is computed once a row: no filter above is pushed below it and computes it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line with words: at (id, row, line number), its words with single spaces and their number, its two hashes."""
    lines = docs.select(F.struct(F.col(key).alias("id"), F.col("row")).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    lines = _once(lines, F.split("raw", " "), "parts")
    words = F.array_remove("parts", "")
    lines = _once(lines, F.when(F.array_contains("parts", ""), F.struct(F.array_join(words, " ").alias("line"), F.size(words).alias("n")))
                  .otherwise(F.struct(F.col("raw").alias("line"), F.size("parts").alias("n"))), "plain")
    lines = lines.select(F.struct("doc.id", "doc.row", "pos").alias("at"), "plain.line", "plain.n").filter("n > 0")
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("line"), F.col("line")))


def _with_halves(lines: DataFrame, min_words: int, *columns: str) -> DataFrame:
    """A row per half key of each line that is long enough to have a neighbour.

    A line of n words has the halves of n words (to meet lines as long, and longer ones) and of n - 1 words (to
    meet shorter ones): n div 2 words of either end, and n div 2 - 1 of the first or n div 2 + 1 of the last.
    """

    def half(count: str, side: int) -> Column:
        """Hash of the first (side 0) or last (side 1) `count` words, taken from the line as one piece."""
        return F.xxhash64(F.lit(side), F.expr(f"substring_index(line, ' ', {'-' * side}({count}))"))

    keys = F.array(half("n div 2", 0), half("n div 2", 1), F.when(F.col("n") % 2 == 0, half("n div 2 - 1", 0)).otherwise(half("n div 2 + 1", 1)))
    return lines.filter(F.col("n") >= min_words - 1).select(*columns, F.explode(keys).alias("half"))


def _bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): a bitmap of 64-bit keys folded to 2**26 bits; at most 2048 rows of 4 KB."""
    bit = F.pmod(key, F.lit(_BITS))
    bits = keys.groupBy(F.floor(bit / _BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(bit % _BUCKET).alias("bits"))
    return written(keys.sparkSession, bits, "bitmap")


def _marked(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """The rows whose key's bit is set (all that have the key, and a few more)."""
    bit = F.pmod(key, F.lit(_BITS))
    asked = rows.withColumn("bucket", F.floor(bit / _BUCKET)).withColumn("place", (bit % _BUCKET).cast("int"))
    byte = "cast(conv(hex(substring(bits, place div 8 + 1, 1)), 16, 10) as int)"
    return asked.join(F.broadcast(bitmap), "bucket").filter(f"shiftright({byte}, place % 8) & 1 = 1").drop("bucket", "place", "bits")


def _shared(rows: DataFrame, key: str, line: str) -> DataFrame:
    """Keys that two different lines have."""
    return rows.groupBy(key).agg(F.min(line).alias("a"), F.max(line).alias("b")).filter("a < b").select(key)


def _live(lines: DataFrame, min_words: int) -> DataFrame:
    """Distinct lines that share a half with another: hashes, earliest place, words."""
    halves = _bitmap(_shared(_with_halves(lines, min_words, "h1"), "half", "h1"), "half")
    hit = _marked(_with_halves(lines, min_words, *_LINE, "at", "line"), "half", halves)
    return hit.groupBy(*_LINE).agg(F.min("at").alias("at"), F.first("line").alias("line")).select(*_LINE, "at", F.split("line", " ").alias("words"))


def _one_edit(a: Column, b: Column) -> Column:
    """Word edit distance of at most one (a is the longer or an equally long array)."""
    same = F.zip_with(F.slice(a, F.lit(1), F.size(b)), b, lambda x, y: x == y)
    first = F.array_position(same, F.lit(False))  # 1-based; 0: b is a prefix of a
    equal_length = F.size(F.filter(same, lambda s: ~s)) <= 1
    rest = (first == 0) | (F.slice(a, (first + 1).cast("int"), F.size(b)) == F.slice(b, F.greatest(first, F.lit(1)).cast("int"), F.size(b)))
    return F.when(F.size(a) == F.size(b), equal_length).when(F.size(a) == F.size(b) + 1, rest).otherwise(False)


def _running(hashes: Column) -> Column:
    """0 and the running xors of an array of hashes."""
    return F.aggregate(hashes, F.array(F.lit(0).cast("long")), lambda seen, x: F.concat(seen, F.array(F.element_at(seen, -1).bitwiseXOR(x))))


def _variants(live: DataFrame, min_words: int) -> DataFrame:
    """(h1, at, drop, swap): every deletion variant's hash, alone and together with its place.

    A sequence's hash is the xor of its (word, place) hashes, so a variant's is the running xor before the place
    and that behind it, of the words moved by one.  Lines beyond `_LONG` words take the running xors from a
    window, for arrays that grow by one are copied.
    """
    n = F.size("words")
    here, left = F.transform("words", lambda w, i: F.xxhash64(w, i)), F.transform("words", lambda w, i: F.xxhash64(w, i - 1))
    ahead, behind = F.slice(_running(here), F.lit(1), n), F.reverse(F.slice(_running(F.reverse(left)), F.lit(1), n))
    drops = F.zip_with(ahead, behind, lambda a, b: a.bitwiseXOR(b))
    short = live.filter((n >= min_words) & (n <= _LONG)).select("h1", "at", F.posexplode(drops).alias("i", "drop"))
    each = (live.filter((n >= min_words) & (n > _LONG)).select("h1", "at", F.posexplode("words").alias("i", "w"))
            .select("h1", "at", "i", F.xxhash64("w", "i").alias("here"), F.xxhash64("w", F.col("i") - 1).alias("left")))
    line = Window.partitionBy("at")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drop = (F.bit_xor("here").over(upto).bitwiseXOR(F.col("here")).bitwiseXOR(F.bit_xor("left").over(upto))
            .bitwiseXOR(F.bit_xor("left").over(line)))
    return short.union(each.select("h1", "at", "i", drop.alias("drop"))).select("h1", "at", "drop", F.xxhash64("i", "drop").alias("swap"))


def _near(live: DataFrame, min_words: int) -> DataFrame:
    """(row, pos): first places of the lines that an earlier line is one edit away from."""
    spark = live.sparkSession
    variants = written(spark, _variants(live, min_words), "variants")
    whole = F.aggregate(F.transform("words", lambda w, i: F.xxhash64(w, i)), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    # one word replaced: everyone against the earliest of the key
    common = written(spark, _marked(variants, "swap", _bitmap(_shared(variants, "swap", "h1"), "swap")).select("at", "swap"), "swaps")
    first = written(spark, common.groupBy("swap").agg(F.min("at").alias("e")), "first")
    swapped = common.join(first, "swap").filter("at > e").select("at", "e")
    # one word deleted: every longer line against the shorter line it contains
    complete = live.select(F.col("at").alias("s"), whole.alias("drop"))
    longer = written(spark, _marked(variants, "drop", _bitmap(complete, "drop")).select("at", "drop"), "drops")
    contained = longer.join(complete, "drop")
    longer_goes = contained.filter("at > s").select("at", F.col("s").alias("e"))
    shorter_goes = contained.filter("s > at").groupBy("s").agg(F.min("at").alias("e")).select(F.col("s").alias("at"), "e")
    pairs = (swapped.union(longer_goes).union(shorter_goes)
             .select(F.col("at.row").alias("row"), F.col("at.pos").alias("pos"), F.col("e.row").alias("e_row"), F.col("e.pos").alias("e_pos")).distinct())
    one = live.select(F.col("at.row").alias("row"), F.col("at.pos").alias("pos"), F.col("words").alias("a"))
    other = live.select(F.col("at.row").alias("e_row"), F.col("at.pos").alias("e_pos"), F.col("words").alias("b"))
    a_longer = F.size("a") >= F.size("b")
    both = pairs.join(one, ["row", "pos"]).join(other, ["e_row", "e_pos"]).select(
        "row", "pos", F.when(a_longer, F.col("a")).otherwise(F.col("b")).alias("long"), F.when(a_longer, F.col("b")).otherwise(F.col("a")).alias("short"))
    return both.filter(_one_edit(F.col("long"), F.col("short"))).select("row", "pos").distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                lines: str | None = None, kept: str | None = None) -> DataFrame:
    """`docs`, every row, with the repeated lines taken out of `text`; `lines` and `kept` add their numbers.

    A null text stays null, a text whose lines all repeat becomes empty.  Rows with equal ids (or identical
    rows) are told apart by their place in the table, which must come out the same when read twice, as that of
    Parquet files does.  Any extra columns pass through.
    """
    if min_words < 3:
        raise ValueError("min_words must be 3 or more")
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    all_lines = _lines(narrow, "id", "text")
    live = written(spark, _live(all_lines, min_words), "live")
    near = written(spark, _near(live, min_words), "near")
    firsts = all_lines.groupBy(*_LINE).agg(F.min("at").alias("at")).select("at.row", "at.pos").join(near, ["row", "pos"], "left_anti")
    keep = firsts.groupBy(F.col("row").alias("kept_row")).agg(F.collect_list("pos").alias("places"))
    row, parts, blank, places = fresh(docs, "row", "parts", "blank", "places")
    split = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(parts, F.split(F.col(f"`{text}`"), "\n"))
    keep = keep.select(F.col("kept_row").alias(f"{row}_kept"), F.col("places").alias(places))
    joined = split.join(keep, F.col(row) == F.col(f"{row}_kept"), "left")
    numbered = F.transform(F.col(parts), lambda line, i: F.when(F.trim(line) == "", i))
    joined = joined.withColumn(blank, F.array_compact(numbered))
    at = F.array_sort(F.concat(F.coalesce(F.col(places), F.array().cast("array<int>")), F.col(blank)))
    out = F.array_join(F.transform(at, lambda i: F.get(F.col(parts), i)), "\n")
    count = {name: F.greatest(F.coalesce(F.size(F.col(c)), F.lit(0)), F.lit(0)).cast("long") for name, c in ((lines, parts), (kept, places)) if name}
    extra = [c.alias(name) for name, c in count.items()]
    named = {(lines or "").lower(), (kept or "").lower()}
    return joined.select(*[(F.when(F.col(f"`{c}`").isNotNull(), out).alias(c) if c == text else F.col(f"`{c}`"))
                           for c in docs.columns if c == text or c.lower() not in named], *extra)
