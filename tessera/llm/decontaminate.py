"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

A test item is found in a document if at least ``CONTAINMENT`` of the item's distinct word
shingles occur in the document, however long the document is. Plain MinHash estimates the Jaccard
similarity, which is tiny for a short item in a long document. So items are partitioned by size
and only the item is sketched:

* Partition ``p`` holds the items of 2^p to 2^(p+1)-1 distinct shingles. An item's sketch is its
  bottom-k MinHash sketch, its ``k`` smallest shingle hashes. ``k`` follows from the largest size of
  the partition: one more than the number of shingles a contained item may miss. A document
  that contains the item therefore holds at least one hash of its sketch: no link is lost.
* Documents are probed with their shingle hashes. Those that hold any hash of any sketch are set
  aside first (without shuffling texts, see ``with_hits``); their hashes, joined with the sketches and
  filtered by size, give candidate (text, item) pairs.
* Candidates are verified exactly: the words of the shingles, not their hashes, are joined with the
  item's shingles and the distinct matches counted.

Texts are handled by their md5, so copies are verified once and their links come from a join on
that key. Items equal in text are one. The sketch and the items' shingles are written tables:
Spark broadcasts them while their files are small, and otherwise shuffles.

Words are runs of letters, marks and digits, lower-cased; in scripts that are written without
blanks every character is a word. An item with fewer words than a shingle is one shingle of all
its words, and documents are then also probed with windows of that length (at most four lengths
besides five). Null and wordless texts contain nothing and are found nowhere; texts of any length
are searched whole; repeated rows each get their links; without items, or without documents, there
are no links and all documents stay; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import free_name, let, quote, stage

SHINGLE = 5
CONTAINMENT = 0.8
#: Hashes up to which all sketches are compared inside the scan instead of joined.
INLINE = 20_000
#: Scripts written without blanks between words.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
GAPS = r"[^\p{L}\p{M}\p{N}]+"
WORD = rf"[{UNSPACED}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]+"


def _words(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    spaced = F.filter(F.split(t, GAPS), lambda w: w != "")
    return F.when(t.rlike(f"[{UNSPACED}]"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0))).otherwise(spaced)


def _window(words: Column, n: int, of: Callable[[list[Column]], Column]) -> Callable[[Column], Column]:
    return lambda i: of([F.get(words, i + d) for d in range(n)])


def _windows(words: Column, of: Callable[[list[Column]], Column], lengths: Sequence[int], whole: bool) -> Column:
    """``of`` (a window's words -> column) over every window of each length; ``whole``: of the lengths
    under a shingle's, only the one that takes in the whole text."""

    def body(w: Column) -> Column:
        parts = []
        for n in lengths:
            fits = F.size(w) == n if whole and n < SHINGLE else F.size(w) >= n
            parts.append(F.when(fits, F.transform(F.sequence(F.lit(0), F.size(w) - n), _window(w, n, of))))
        return parts[0] if len(parts) == 1 else F.flatten(F.array_compact(F.array(*parts)))

    return let(words, body)


#: The lengths of an item's shingles: five words, or all that it has.
ITEM_LENGTHS = range(1, SHINGLE + 1)


def shingle_hashes(text: Column, lengths: Sequence[int], whole: bool = False) -> Column:
    return _windows(_words(text), lambda ws: F.xxhash64(*ws), lengths, whole)


def shingles(text: Column, lengths: Sequence[int], whole: bool = False) -> Column:
    return _windows(_words(text), lambda ws: F.concat_ws(" ", *ws), lengths, whole)


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def item_tables(items: DataFrame, containment: float = CONTAINMENT) -> tuple[DataFrame, DataFrame, list[int]]:
    """(item shingles, sketches, window lengths) of the test items; the tables are written.

    The first has item_key, n, need, shingle; the second item_key, need, part, hash. Documents are
    probed with windows of the lengths.
    """
    texts = items.select(text_key(F.col("text")).alias("item_key"), "text").groupBy("item_key").agg(F.first("text").alias("text"))
    sets = texts.select("item_key", F.array_distinct(shingles(F.col("text"), ITEM_LENGTHS, whole=True)).alias("set"), F.size(_words(F.col("text"))).alias("n_words")).filter(F.size("set") > 0)
    n = F.size("set")
    need = F.ceil(n * F.lit(containment) - 1e-9).cast("int")
    sized = sets.select("item_key", n.alias("n"), F.greatest(need, F.lit(1)).alias("need"), "set", "n_words", F.floor(F.log2(n.cast("double"))).cast("int").alias("part"))
    exact = stage(sized.select("item_key", "n", "need", F.least("n_words", F.lit(SHINGLE)).alias("length"), F.explode("set").alias("shingle")), "decon-items")
    lengths = sorted({SHINGLE} | {r["length"] for r in exact.select("length").distinct().collect()})  # at most five
    largest = F.pow(F.lit(2), F.col("part") + 1).cast("int") - 1
    k = largest - F.ceil(largest * F.lit(containment) - 1e-9).cast("int") + 1
    hashes = texts.select("item_key", F.array_distinct(shingle_hashes(F.col("text"), ITEM_LENGTHS, whole=True)).alias("hashes")).join(sized.select("item_key", "part", "need"), "item_key")
    sketch = hashes.select("item_key", "part", "need", F.explode(F.slice(F.sort_array("hashes"), F.lit(1), k)).alias("hash"))
    return exact.drop("length"), stage(sketch, "decon-sketch"), lengths


def with_hits(docs: DataFrame, sketch: DataFrame, lengths: Sequence[int], key: str, hit: str, inline: int = INLINE) -> DataFrame:
    """``docs`` with the text's key and whether it holds any hash of any sketch.

    A sketch table of at most ``inline`` hashes is compared row by row, so that no text is shuffled.
    A larger one is joined with the exploded hashes; the keys found are joined back.
    """
    top = sketch.agg(F.max("hash")).first()[0]
    text = F.col("text")
    keyed = docs.withColumn(key, text_key(text))
    if top is None:
        return keyed.withColumn(hit, F.lit(False))
    distinct = sketch.select("hash").distinct()
    if distinct.count() <= inline:
        every = distinct.agg(F.collect_list("hash")).scalar()
        return keyed.withColumn(hit, F.coalesce(F.arrays_overlap(shingle_hashes(text, lengths), every), F.lit(False)))
    probe = keyed.select(F.col(key).alias("found"), F.explode(shingle_hashes(text, lengths)).alias("hash")).filter(F.col("hash") <= F.lit(top))
    found = stage(probe.join(distinct, "hash", "left_semi").select("found").distinct(), "decon-found")
    return keyed.join(found, F.col(key) == F.col("found"), "left").withColumn(hit, F.col("found").isNotNull()).drop("found")


def verified_links(hits: DataFrame, exact: DataFrame, sketch: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(text_key, item_key, n_shared, n_shingles) of (text_key, text) rows with hits; written."""
    texts = stage(hits.groupBy("text_key").agg(F.first("text").alias("text")), "decon-texts")
    probe = texts.select("text_key", shingle_hashes(F.col("text"), lengths).alias("hashes")).select("text_key", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    near = probe.join(sketch, "hash").filter("size >= need")
    pairs = stage(near.groupBy("text_key", "item_key").agg(F.count("*").alias("hits")).select("text_key", "item_key"), "decon-pairs")
    found = texts.select("text_key", F.explode(F.array_distinct(shingles(F.col("text"), lengths))).alias("shingle"))
    shared = found.join(exact, "shingle").groupBy("text_key", "item_key", "n", "need").agg(F.count("*").alias("n_shared")).filter("n_shared >= need")
    verified = shared.join(pairs, ["text_key", "item_key"], "left_semi")
    return stage(verified.select("text_key", "item_key", F.col("n_shared").cast("int").alias("n_shared"), F.col("n").alias("n_shingles")), "decon-links")


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, inline: int = INLINE) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment: a row for each document and item it contains."""
    exact, sketch, lengths = item_tables(items, containment)
    flagged = with_hits(docs.select("doc_id", "text"), sketch, lengths, "text_key", "hit", inline)
    hits = stage(flagged.filter("hit").select("doc_id", "text_key", "text"), "decon-hits")
    links = verified_links(hits.select("text_key", "text"), exact, sketch, lengths)
    ids = items.select("item_id", text_key(F.col("text")).alias("item_key"))
    out = hits.select("doc_id", "text_key").join(links, "text_key").join(ids, "item_key")
    return out.select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, inline: int = INLINE) -> DataFrame:
    """The rows of documents that contain no test item. Rows without hits take part in no shuffle."""
    key = free_name(docs.columns, "text_key")
    hit = free_name([*docs.columns, key], "hit")
    exact, sketch, lengths = item_tables(items, containment)
    flagged = stage(with_hits(docs, sketch, lengths, key, hit, inline), "decon-docs")
    columns = [F.col(quote(c)) for c in docs.columns]
    hits = flagged.filter(F.col(hit))
    links = verified_links(hits.select(F.col(key).alias("text_key"), "text"), exact, sketch, lengths)
    dirty = links.select(F.col("text_key").alias(key)).distinct()
    return flagged.filter(~F.col(hit)).select(*columns).unionByName(hits.join(dirty, key, "left_anti").select(*columns))
