"""Benchmark decontamination with a positional inverted index of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from ._text import alnum_words

#: A benchmark-side table is broadcast only below this many rows; else it is shuffled.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a materialized table if its counted size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_words(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, words, n, span): the items that have words; a window has ``span`` of them."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), alnum_words(F.col("text")).alias("words"))
    return words.withColumn("n", F.size("words")).filter("n > 0").withColumn("span", F.least("n", F.lit(width)))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, pos, term): where the corpus has the benchmark's terms."""
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(alnum_words(F.col("text"))).alias("pos", "term"))
    return tokens.join(_small(vocabulary), "term").select("doc_id", "pos", "term")


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n): how often the corpus has each of the benchmark's terms, counted before any posting is written."""
    tokens = docs.select(F.explode(alnum_words(F.col("text"))).alias("term"))
    return tokens.join(_small(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))


def _by_rarity(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """(item_id, n, span, by): the words of each item in order, as structs (n, at, term) that sort by rarity."""
    terms = items.select("item_id", F.posexplode("words").alias("at", "term"))
    ranked = (
        terms.join(frequency, "term", "left")
        .groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("ranked"))
    )
    by_rarity = F.transform("ranked", lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"), x["term"].alias("term")))
    return ranked.join(items.select("item_id", "n", "span"), "item_id").select("item_id", "n", "span", by_rarity.alias("by"))


def anchors(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """(item_id, at, term, next_at, next_term): of every window its two rarest terms in the corpus, the rarest first.

    A window of one word has no next term (null). Windows with a term that the corpus
    lacks cannot occur and are left out.
    """
    rarest = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("span") + 1), lambda s: F.slice(F.array_sort(F.slice("by", s, F.col("span"))), 1, 2))
    two = _by_rarity(items, frequency).select("item_id", F.explode(F.array_distinct(rarest)).alias("two"))
    first, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    return two.filter(first["n"] > 0).select("item_id", first["at"].alias("at"), first["term"].alias("term"), second["at"].alias("next_at"), second["term"].alias("next_term"))


def candidate_offsets(index: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift): the posting lists of each window's two rarest terms, adjusted by their places in the item and intersected."""
    first = index.join(_small(places), "term").select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift"), "next_at", "next_term")
    alone = first.filter("next_term is null").select("doc_id", "item_id", "shift")
    asked = first.filter("next_term is not null").withColumn("want", F.col("shift") + F.col("next_at"))
    other = index.select(F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.col("term").alias("t"))
    both = asked.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("want") == F.col("p")) & (F.col("next_term") == F.col("t")), "left_semi")
    return both.select("doc_id", "item_id", "shift").union(alone)


def _matches(words: Column, item: Column, shift: Column, span: Column) -> Column:
    """First places (in the document) of the item's windows that occur with this offset."""
    low = F.greatest(F.lit(0), -shift)
    high = F.least(F.size(item), F.size(words) - shift) - 1
    same = F.array_join(F.transform(F.sequence(low, high), lambda i: F.when(F.get(words, i + shift) == F.get(item, i), "1").otherwise("0")), "")
    run = F.repeat(F.lit("1"), span)
    # A one-element array binds the comparison to a variable, so it is made once per offset.
    starts = F.flatten(F.transform(F.array(same), lambda b: F.filter(F.sequence(low, high - span + 1), lambda s: F.substr(b, s - low + 1, span) == run)))
    return F.when(high - low + 1 >= span, F.transform(starts, lambda s: s + shift)).otherwise(F.array().cast("array<int>"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: float = 0.05, carry: bool = False) -> DataFrame:
    """Where documents repeat benchmark items word for word.

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII
    characters. A window is ``width`` consecutive words of an item, or the whole of
    an item that has fewer. Terms are counted first, then the index is written: the
    postings of the terms that are among the two rarest of some window. The lists of
    these two, positions less the terms' places in the item, are intersected; at the
    offsets in both, the words of document and item are compared, so matches are exact.

    Returns doc_id, n_words, n_hit (words inside a matching window), items (sorted
    ids of items with a matching window), offsets (item_id and document position of
    every matching window's first word) and contaminated (n_hit > 0 and at least
    ``share`` of the words), a row for each input row. Null and empty texts have no
    words; items without words match nothing; items with one id count as one item.
    Rows without doc_id, and rows that repeat one, are judged by their own text.
    Columns besides doc_id, text and item_id are ignored, unless ``carry`` asks for
    the whole input row as a struct column named row.
    """
    items = materialize(item_words(benchmark, width), "items")
    vocabulary = materialize(items.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    frequency = materialize(term_counts(docs, vocabulary), "frequency")
    # Items may share an id: from here on each has a number of its own.
    items = materialize(items.withColumn("name", F.col("item_id")).withColumn("item_id", F.sha2(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.array_join("words", " ")), 256)).dropDuplicates(["item_id", "name"]), "items")
    places = materialize(anchors(items, frequency), "anchors")
    used = places.select("term").union(places.filter("next_term is not null").select("next_term")).distinct()
    index = materialize(postings(docs, materialize(used, "used")), "postings")
    offsets = candidate_offsets(index, places)
    texts = items.select("item_id", "name", F.col("words").alias("item"), "span")
    found = (
        offsets.groupBy("doc_id", "item_id").agg(F.collect_set("shift").alias("shifts"))
        .join(_small(texts), "item_id")
        .groupBy("doc_id").agg(F.collect_list(F.struct("name", "item", "span", "shifts")).alias("candidates"))
    )
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(docs.columns if carry else ["text"])).alias("row"))
    joined = base.join(found, base.doc_id.eqNullSafe(found.doc_id), "left").select(base.doc_id, "row", "candidates")
    kept = ["row"] if carry else []
    words = joined.select("doc_id", alnum_words(F.col("row.text")).alias("words"), "candidates", *kept)
    each = F.transform(
        "candidates",
        lambda c: F.struct(
            c["name"].alias("item_id"),
            c["span"].alias("span"),
            F.flatten(F.transform(c["shifts"], lambda d: _matches(F.col("words"), c["item"], d, c["span"]))).alias("starts"),
        ),
    )
    none = F.array().cast("array<struct<item_id:string,span:int,starts:array<int>>>")
    judged = words.select("doc_id", *kept, F.size("words").cast("long").alias("n_words"), F.coalesce(F.filter(each, lambda m: F.size(m["starts"]) > 0), none).alias("matches"))
    hit = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.flatten(F.transform(m["starts"], lambda s: F.sequence(s, s + m["span"] - 1))))))
    spread = F.flatten(F.transform("matches", lambda m: F.transform(m["starts"], lambda s: F.struct(m["item_id"].alias("item_id"), s.alias("at")))))
    counted = judged.select(
        "doc_id", *kept, "n_words", F.size(hit).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))).alias("items"), spread.alias("offsets"),
        F.spark_partition_id().alias("_here"),
    )
    judged = counted.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") / share >= F.col("n_words")))
    # A filter on the result must not be pushed below, where words would be split anew for every comparison.
    return judged.filter("_here >= 0").drop("_here")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    return contamination(docs, benchmark, carry=True).filter("not contaminated").select("row.*")


def near_phrases(docs: DataFrame, phrases: DataFrame, slop: int = 3) -> DataFrame:
    """Proximity matches from the same kind of index.

    ``phrases`` has item_id and text. A document matches if, starting at some posting
    of the phrase's rarest term, every distinct term of the phrase stands within
    ``slop`` words of its place. Returns doc_id, item_id, at (place of the phrase's
    first word, estimated from the rarest term). Null texts match nothing.
    """
    items = materialize(item_words(phrases, 1 << 20), "phrases")
    vocabulary = materialize(items.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    index = materialize(postings(docs.filter("doc_id is not null"), vocabulary), "postings")
    frequency = index.groupBy("term").agg(F.count("*").alias("n"))
    rarest = anchors(items, frequency).select("item_id", "at", "term").distinct()
    needs = items.select("item_id", F.posexplode("words").alias("place", "need"))
    size = needs.groupBy("item_id").agg(F.countDistinct("need").alias("terms"))
    starts = index.join(rarest, "term").select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("start"))
    asked = starts.join(needs, "item_id")
    other = index.select(F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.col("term").alias("t"))
    # Positions are compared inside buckets of the slop's length, so the join stays an equi-join.
    cell = 2 * slop + 1
    asked = asked.withColumn("want", F.col("start") + F.col("place")).withColumn("cell", F.explode(F.array_distinct(F.array(F.floor((F.col("want") - slop) / cell), F.floor((F.col("want") + slop) / cell)))))
    other = other.withColumn("c", F.floor(F.col("p") / cell))
    met = asked.join(other, (F.col("doc_id") == F.col("d")) & (F.col("need") == F.col("t")) & (F.col("cell") == F.col("c"))).filter(F.abs(F.col("want") - F.col("p")) <= slop)
    counted = met.groupBy("doc_id", "item_id", "start").agg(F.countDistinct("need").alias("found"))
    return counted.join(size, "item_id").filter("found = terms").select("doc_id", "item_id", F.col("start").alias("at"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
