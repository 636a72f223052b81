"""Fuzzy line dedup by MinHash, with DataFrame functions only.

1. A line is known by the 64-bit hash of its normal form. Its signature has the
   smallest shingle hash in each of ``BINS`` bins (k-partition MinHash); shingles are
   made, hashed and reduced in one generated loop, and equal lines merge in the same
   aggregation.
2. Eight triples of bins are the bands. Each line is compared with the two ends
   (smallest and largest line) of its bands, which joins most of a band; all other
   pairs of a band that are not joined by then are taken as they are in bands of up
   to ``PAIRED`` lines, and meet by prefix filtering in larger ones, which loses no
   similar pair. Sizes and sketches of the shingle sets rule most pairs out, but none
   that is similar. Comparison is exact: the Jaccard similarity of the whole shingle
   sets, made from the texts of the two lines.
3. Connected components of the links, by large-star and small-star rounds; the first
   line of each component stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, scratch
from ._graph import components
from ._joins import BROADCAST_ROWS, small

#: Characters in a shingle (UTF-16 units, so a character outside the basic plane counts twice).
SHINGLE = 8
#: Bins of a signature, and the triples of them that make its bands: every bin is in two.
BINS = 12
BANDS = [(0, 1, 3), (2, 4, 5), (6, 7, 9), (8, 10, 11), (0, 4, 8), (1, 5, 9), (2, 6, 10), (3, 7, 11)]
#: Shingles of a line that are expected to compete for its bins: all whose hash is below a
#: limit that falls with the line's length. Smaller hashes win bins, so the limit changes
#: a signature about once in 400 bins. The first ``FIRST`` compete too, whatever their
#: hashes, so that every line has a signature.
COMPETE, FIRST = 72, 8
#: Lines in a band of which all pairs are taken: at most half as many pairs for each line.
PAIRED = 64
#: Words of 64 bits in the sketch of a line's shingles.
WORDS = 8


def normal(line: Column) -> Column:
    """What makes two lines the same, besides lower case: the trimmed text."""
    return F.trim(line)


def _starts(units: Column) -> Column:
    """Byte positions, from 1, of the shingles in UTF-16 text; a shorter text is one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(units) - 2 * SHINGLE + 1), F.lit(2))


def _shingle(units: Column, at: Column) -> Column:
    return F.xxhash64(F.substr(units, at, F.lit(2 * SHINGLE)))


def _limit(units: Column, n: int) -> Column:
    """The hash that about ``n`` shingles of the text do not exceed (all, if it has fewer)."""
    return (F.least(F.lit(1.0), n / F.greatest(F.octet_length(units) / 2, F.lit(1.0))) * 2.0**64 - 2.0**63).cast("long")


def grams(line: Column) -> Column:
    """The hashes of a line's shingles, with repeats: 8 characters from every character, or the whole of a shorter line."""
    # A one-element array binds the encoded text to a variable, so it is made once.
    return F.flatten(F.transform(F.array(F.encode(line, "UTF-16BE")), lambda units: F.transform(_starts(units), lambda at: _shingle(units, at))))


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, pos, line): the lines that are not blank, in normal form; uid tells texts of one doc_id apart."""
    lines = docs.select("doc_id", F.hash("text").alias("uid"), F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line"))
    return lines.withColumn("line", normal(F.col("line"))).filter("line <> ''")


def signatures(lines: DataFrame) -> DataFrame:
    """(h, k0..k7): each distinct line's band keys.

    An empty bin takes the value of the next one that is not, so short lines have
    whole signatures too. In a simulation the bands miss 1.2 to 1.8 % of pairs at a
    similarity of exactly 0.8 (2 to 3 % of lines of ten shingles or fewer), 0.1 % at 0.9.
    """
    units = lines.select(F.xxhash64("line").alias("h"), F.encode("line", "UTF-16BE").alias("units"))
    each = units.select("h", "units", _limit(F.col("units"), COMPETE).alias("limit"), F.explode(_starts(F.col("units"))).alias("at"))
    hashed = each.select("h", "limit", "at", _shingle(F.col("units"), F.col("at")).alias("g")).filter((F.col("g") <= F.col("limit")) | (F.col("at") <= 2 * FIRST))
    binned = hashed.withColumn("bin", F.pmod("g", F.lit(BINS)).cast("int"))
    least = binned.groupBy("h").agg(*[F.min(F.when(F.col("bin") == i, F.col("g"))).alias(f"m{i}") for i in range(BINS)])
    filled = least.select("h", *[F.coalesce(*[F.col(f"m{(i + k) % BINS}") for k in range(BINS)]).alias(f"f{i}") for i in range(BINS)])
    return filled.select("h", *[F.xxhash64(F.lit(k), *[F.col(f"f{i}") for i in band]).alias(f"k{k}") for k, band in enumerate(BANDS)])


def _members(signed: DataFrame) -> DataFrame:
    return signed.select("h", F.explode(F.array(*[f"k{k}" for k in range(len(BANDS))])).alias("key"))


def band_ends(signed: DataFrame) -> DataFrame:
    """(key, low, high, n): the bands of two lines or more, their first and last line (by hash) and their size."""
    ends = _members(signed).groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("n"))
    return materialize(ends.filter("low < high"), "bands")


def candidates(signed: DataFrame, ends: DataFrame) -> DataFrame:
    """(a, b): distinct lines (by hash) that share a band with the band's first or last line; ``rest`` has the other pairs."""
    met = _members(signed).join(small(ends), "key")
    return met.select(F.col("h"), F.explode(F.array("low", "high")).alias("b")).filter("h <> b").select(F.greatest("h", "b").alias("a"), F.least("h", "b").alias("b")).distinct()


def band_texts(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(h, line, n): the lines in any pair, each once, and how many distinct shingles they have."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "wanted")
    found = lines.select(F.xxhash64("line").alias("h"), "line").join(small(wanted), "h", "left_semi").distinct().dropDuplicates(["h"])
    return materialize(found.withColumn("n", F.size(F.array_distinct(grams(F.col("line"))))), "texts")


def sketches(lines: DataFrame) -> DataFrame:
    """(h, n, bits): a sketch of a line's distinct shingles, in which each turns one bit over."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("g").bitwiseAND(F.lit(63)).cast("int"))
    turned = _shingles(lines, "h", "n").select("h", "n", F.pmod(F.shiftright("g", 6), F.lit(WORDS)).alias("word"), bit.alias("bit"))
    bits = [F.bit_xor(F.when(F.col("word") == i, F.col("bit"))).alias(f"b{i}") for i in range(WORDS)]
    whole = [F.coalesce(f"b{i}", F.lit(0).cast("long")).alias(f"b{i}") for i in range(WORDS)]
    return materialize(turned.groupBy("h", "n").agg(*bits).select("h", "n", F.struct(*whole).alias("bits")), "sketches")


def _least(similarity: float) -> Column:
    """Shingles that similar sets of ``n_x`` and ``n_y`` have in common: a Jaccard similarity of s is an overlap of s / (1 + s) of both sizes."""
    return F.lit(similarity / (1 + similarity)) * (F.col("n_x") + F.col("n_y")) - 1e-9


def _may_share(least: Column) -> Column:
    """Whether the sketches of two lines leave room for ``least`` shingles in common.

    A bit differs only where a shingle of one line alone turned it, so sketches differ
    in no more bits than the lines have shingles alone.
    """
    apart = sum((F.bit_count(F.col("bits_x")[f"b{i}"].bitwiseXOR(F.col("bits_y")[f"b{i}"])) for i in range(WORDS)), F.lit(0))
    return apart <= F.col("n_x") + F.col("n_y") - 2 * least


def verified(texts: DataFrame, known: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles, as 64-bit hashes, have a Jaccard similarity of at least ``similarity``.

    ``known`` has the number of a line's shingles (h, n) and may have its sketch (bits).
    """
    side = lambda line, name: small(known).select(F.col("h").alias(line), *[F.col(c).alias(f"{c}_{name}") for c in known.columns[1:]])
    least = _least(similarity)
    sized = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(F.least("n_x", "n_y") >= least)
    if "bits" in known.columns:
        sized = sized.filter(_may_share(least))
    return _overlapping(texts, materialize(sized.select(*pairs.columns, least.alias("least")), "sized")).drop("least")


def _overlapping(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose texts share at least ``least`` shingles."""
    joined = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    return joined.filter(F.size(F.array_intersect(grams(F.col("x")), grams(F.col("y")))) >= F.col("least")).select(pairs.columns)


def open_bands(signed: DataFrame, ends: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, n, h, root): lines of bands that hold several roots, where pairs other than with the bands' ends are still to be compared."""
    inner = _members(signed).join(small(ends.filter("n > 3")), "key").filter("h <> low and h <> high").select("key", "n", "h").distinct()
    inner = materialize(inner.join(small(roots), "h", "left").select("key", "n", "h", F.coalesce("root", "h").alias("root")), "inner")
    mixed = inner.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    return materialize(inner.join(small(materialize(mixed.select("key"), "mixed")), "key", "left_semi"), "open")


def band_pairs(members: DataFrame) -> DataFrame:
    """(a, b, root_a, root_b): the pairs of two roots in bands of up to ``PAIRED`` lines."""
    few = members.filter(F.col("n") <= PAIRED)
    x = few.select("key", F.col("h").alias("a"), F.col("root").alias("root_a"))
    y = few.select(F.col("key").alias("key_y"), F.col("h").alias("b"), F.col("root").alias("root_b"))
    met = x.join(y, (F.col("key") == F.col("key_y")) & (F.col("a") > F.col("b")) & (F.col("root_a") != F.col("root_b")))
    return materialize(met.select("a", "b", "root_a", "root_b").distinct(), "paired")


def _shingles(lines: DataFrame, *columns: str) -> DataFrame:
    return lines.select(*columns, F.explode(F.array_distinct(grams(F.col("line")))).alias("g"))


def frequent_shingles(lines: DataFrame) -> DataFrame:
    """(g, lines): the shingles of the most lines, as many as can be broadcast, and how many lines have them."""
    counts = materialize(_shingles(lines).groupBy("g").agg(F.count("*").alias("lines")).filter("lines > 1"), "counts")
    above = counts.agg(*[F.count_if(F.col("lines") > 2**k) for k in range(63)]).first()
    return counts.filter(F.col("lines") > 2 ** next(k for k, n in enumerate(above) if n <= BROADCAST_ROWS))


def prefixes(lines: DataFrame, similarity: float) -> DataFrame:
    """(h, root, n, bits, g, before, place, indexed): the shingles by which each open line must meet all that are similar to it.

    The shingles of a line stand in one order for all lines, the frequent ones last;
    ``g`` is that order: how frequent in the upper bits, the shingle's hash in the lower 54
    (two shingles may have one ``g``, which only brings more lines together). ``place`` is
    that in the line, and ``before`` the shingle before it. Two lines that share at least
    ``t`` shingles share one of the first n - t + 1 of both. To a larger or equal line t is
    at least 2s / (1 + s) of the line's n (``indexed``), to a smaller one at least s of it.
    """
    first = lambda part: (F.col("n") - F.ceil(F.col("n") * part - 1e-9) + 1).cast("int")
    kept = ("h", "root", "n", "bits")
    # Dealt by line before lines become shingles: no shingle is shuffled to put a line's in order.
    each = _shingles(lines.repartition("h"), *kept).join(F.broadcast(frequent_shingles(lines)), "g", "left")
    rank = F.coalesce(F.floor(8 * F.log2("lines")), F.lit(0)).cast("long")
    placed = each.withColumn("g", F.shiftleft(rank, 54).bitwiseOR(F.col("g").bitwiseAND(F.lit((1 << 54) - 1))))
    ordered = placed.groupBy(*kept).agg(F.sort_array(F.collect_list("g")).alias("found"))
    probed = ordered.select(*kept, "found", F.posexplode(F.slice("found", F.lit(1), first(similarity))).alias("at", "g"))
    before = F.when(F.col("at") > 0, F.get("found", F.col("at") - 1))
    placed = probed.select(*kept, "g", before.alias("before"), (F.col("at") + 1).alias("place"))
    return materialize(placed.withColumn("indexed", F.col("place") <= first(2 * similarity / (1 + similarity))), "prefixes")


def _meet(x: DataFrame, y: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """(a, b, root_a, root_b): the similar pairs of two roots that a shingle of ``x`` and the same of ``y`` bring together."""
    kept = ("h", "root", "n", "bits", "before", "place")
    x = x.select("g", *[F.col(c).alias(f"{c}_x") for c in kept])
    y = y.select(F.col("g").alias("g_y"), *[F.col(c).alias(f"{c}_y") for c in kept])
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("h_x") < F.col("h_y")))
    least = _least(similarity)
    # Of lines that are similar, the first shingle in common has all others after it.
    still = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) + 1
    # Where the shingle before is the same too, they have met at that one.
    new = ~F.coalesce(F.col("before_x") == F.col("before_y"), F.lit(False))
    met = x.join(y, (F.col("g") == F.col("g_y")) & (F.col("root_x") != F.col("root_y")) & smaller & new & (F.col("n_x") >= least) & (still >= least) & _may_share(least))
    pairs = met.select(F.col("h_x").alias("a"), F.col("h_y").alias("b"), F.col("root_x").alias("root_a"), F.col("root_y").alias("root_b"), least.alias("least")).distinct()
    pairs = materialize(pairs, "met")
    return materialize(_overlapping(lines, pairs).drop("least"), "more")


def rest(lines: DataFrame, joined: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join all similar pairs of open lines (h, root, n, bits, line) that have two roots, and the links ``joined``.

    First each line is compared with the two ends of its shingles' lists, so that most
    of what belongs together has one root; then all pairs that still have two roots
    are compared unless their sizes, their sketches or the places of a shared shingle
    rule the similarity out. No list is cut. Template shingles are frequent, so they come late
    in the order and are hardly ever indexed: lines that have only the template in
    common do not meet.
    """
    found = prefixes(lines, similarity)
    indexed = found.filter("indexed")
    row = F.struct("h", "root", "n", "bits", "before", "place")
    lists = indexed.groupBy("g").agg(F.min(row).alias("low"), F.max(row).alias("high")).select("g", F.inline(F.array("low", "high")))
    first = _meet(materialize(lists.distinct(), "lists"), found, lines, similarity)
    first = first.unionByName(joined)
    now = materialize(components(first.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "now")
    found = found.join(small(now).withColumnRenamed("root", "joined"), F.col("root") == F.col("node"), "left").select("h", F.coalesce("joined", "root").alias("root"), "n", "bits", "g", "before", "place", "indexed")
    second = _meet(found.filter("indexed"), found, lines, similarity)
    return first.unionByName(second).select("a", "b")


def repeats(rows: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, uid, gone): the places of a text's lines that are equal or similar to an earlier one."""
    spark = rows.sparkSession
    with scratch(spark):  # the largest tables go before the next are written
        signed = materialize(signatures(rows), "signed")
        ends = band_ends(signed)
        pairs = materialize(candidates(signed, ends), "pairs")
        texts = band_texts(rows, pairs)
        links = materialize(verified(texts, texts.select("h", "n"), pairs, similarity), "similar", lasting=True)
        roots = materialize(components(links).withColumnRenamed("node", "h"), "roots", lasting=True)
        members = open_bands(signed, ends, roots)
        opened = materialize(texts.join(small(materialize(members.select("h").distinct(), "found")), "h"), "opened")
        sketched = sketches(opened)
        joined = materialize(verified(opened, sketched, band_pairs(members), similarity), "joined", lasting=True)
        crowd = materialize(members.filter(F.col("n") > PAIRED).select("h", "root").distinct(), "crowd")
        lines = materialize(opened.drop("n").join(sketched.join(small(crowd), "h"), "h"), "lines", lasting=True)
    with scratch(spark):
        more = materialize(rest(lines, joined, similarity), "more", lasting=True)
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = materialize(components(links).withColumnRenamed("node", "h"), "roots")
    lines = rows.select("doc_id", "uid", "pos", F.xxhash64("line").alias("h"))
    grouped = lines.join(small(roots), "h", "left").select("doc_id", "uid", "pos", F.coalesce("root", "h").alias("root"))
    # Longs only, so that the aggregations hash and need not sort.
    place = F.shiftleft(F.col("uid").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    grouped = materialize(grouped.withColumn("doc", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("place", place), "grouped")
    # Written first, so that the join has plain inputs: broadcast, or split by AQE where a root is hot.
    several = materialize(grouped.groupBy("root").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1"), "several")
    repeated = materialize(grouped.join(small(several), "root"), "repeated")
    inside = repeated.filter("doc = first")  # lines of the group's first document
    leaders = inside.groupBy("root").agg(F.min("place").alias("lead"))
    gone = repeated.filter("doc > first").select("doc_id", "uid", "pos").unionByName(inside.join(leaders, "root").filter("place > lead").select("doc_id", "uid", "pos"))
    # A row for each document, however common its lines are.
    return gone.groupBy("doc_id", "uid").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Keep the first line of each group of equal or similar lines.

    Lines are split at newlines. Lines are equal if their trimmed, lower-cased texts
    are, and similar if their shingle sets have a Jaccard similarity of at least
    ``similarity``; groups are closed under both. Similar lines are sought by MinHash
    bands: all similar pairs of a band are joined, by its ends or by the prefix filter;
    every link is verified exactly.
    The first line by doc_id (null counts as the largest) and place is kept, blank lines
    always are. Lines are told apart by 64-bit hashes of their normal form.

    Returns the columns of ``docs`` with the remaining lines as text, and n_lines and
    n_removed (columns of these names are replaced), a row for each input row. A null
    text stays null, with 0 lines; a text may become empty. Rows that repeat a doc_id
    and its text count as one.
    """
    docs = docs.drop("n_lines", "n_removed")
    with scratch(docs.sparkSession):
        gone = materialize(repeats(line_rows(docs), similarity), "gone", lasting=True)
    per_doc = gone.select(F.col("doc_id").alias("d"), F.col("uid").alias("u"), "gone")
    # The input row travels as one struct, so its column names cannot clash with ours.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.hash("text").alias("uid0"))
    # Broadcast while few lines go, so that documents are not shuffled for them.
    places = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    joined = rows.join(F.broadcast(per_doc) if places <= BROADCAST_ROWS else per_doc, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.col("uid0") == F.col("u")), "left")
    text = F.col("row.text")
    parts = F.split(text, "\n")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    left = F.array_except(F.sequence(F.lit(0), breaks), "gone")
    # A one-element array binds the lines to a variable, so the text is split once.
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.flatten(F.transform(F.array(parts), lambda lines: F.transform(left, lambda i: F.get(lines, i)))), "\n"))
    columns = [kept.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = dedup_lines(docs)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
