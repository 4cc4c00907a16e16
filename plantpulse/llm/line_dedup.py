"""Line deduplication in content-defined chunks.

A rolling hash over the hashes of neighbouring lines decides where a chunk ends. The decision depends
on these lines alone, so the same passage is cut in the same places in any document, whatever precedes it. Chunks
of several lines that occur more than once in the corpus stay at their first occurrence and are removed elsewhere,
once their bytes have been compared. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.staging import staged

#: Lines whose hashes decide about an end, and lines between ends on average.
WINDOW = 2
MEAN_LINES = 3
#: Chunks with fewer lines are never removed.
LEAST_LINES = 2


def line_hash(line: Column) -> Column:
    """32 bits of a line's checksum."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _rolled(hashes: Column, i: Column) -> Column:
    """Rolling hash at line ``i`` (from 0): hashes of the last lines, each rotated by its age."""
    total = F.get(hashes, i)
    for age in range(1, WINDOW):
        h = F.coalesce(F.get(hashes, i - age), F.lit(0))
        turned = F.shiftleft(h, 7 * age).bitwiseAND((1 << 32) - 1).bitwiseOR(F.shiftright(h, 32 - 7 * age))
        total = total.bitwiseXOR(turned)
    return total


def lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def chunked(docs: DataFrame) -> DataFrame:
    """``docs`` with columns lines, an array of string, and chunks, an array of (start, size) in lines."""
    docs = docs.withColumn("lines", lines_of())
    docs = docs.withColumn("hashes", F.transform("lines", line_hash))
    last = F.size("lines") - 1
    ends = F.filter(
        F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(_rolled(F.col("hashes"), i), F.lit(MEAN_LINES)) == 0)
    )
    docs = docs.withColumn("ends", ends)

    def chunk(end: Column, i: Column) -> Column:
        before = F.coalesce(F.get("ends", i - 1), F.lit(-1))
        return F.struct((before + 1).alias("start"), (end - before).alias("size"))

    return docs.withColumn("chunks", F.transform("ends", chunk)).drop("hashes", "ends")


def _text_of(chunk: Column) -> Column:
    return F.array_join(F.slice(F.col("lines"), chunk["start"] + 1, chunk["size"]), "\n")


def _with_key(docs: DataFrame) -> DataFrame:
    """Adds the identity of a row: a digest of its doc_id and text."""
    parts = F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return docs.withColumn(_KEY, F.unhex(F.md5(parts.cast("binary"))))


_KEY, _SUSPECTS = "__row_key", "__suspects"


def _suspects(docs: DataFrame) -> DataFrame:
    """(row key, chunks) of rows with chunks whose digest occurs earlier in the corpus.

    Digests alone are shuffled. Their least and last place are found before the shuffle, so a
    chunk that a third of all documents have is one row per task; the join back is left to adaptive splitting.
    """
    digest = F.unhex(F.sha1(_text_of(F.col("c")).cast("binary")))
    places = (
        chunked(docs.select("doc_id", _KEY, "text"))
        .select("doc_id", _KEY, "lines", F.explode(F.filter("chunks", lambda c: c["size"] >= LEAST_LINES)).alias("c"))
        .select("doc_id", _KEY, "c.start", "c.size", digest.alias("digest"))
    )
    places = staged(places, "chunk-places")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", _KEY, "start")
    repeated = places.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = staged(
        repeated.where("first <> last").select(
            "digest", F.col(f"first.{_KEY}").alias("first_key"), F.col("first.start").alias("first_start")
        ),
        "chunks-repeated",
    )
    stays = (F.col(_KEY) == F.col("first_key")) & (F.col("start") == F.col("first_start"))
    flagged = places.join(repeated, "digest").select(_KEY, F.struct("start", "size", "digest", stays.alias("stays")).alias("c"))
    # as many as a document has chunks at most; identical rows give the same ones
    return flagged.groupBy(_KEY).agg(F.array_sort(F.collect_set("c")).alias(_SUSPECTS))


def _different(docs: DataFrame) -> DataFrame:
    """(row key, start) of suspects whose bytes are not those of the first chunk with their digest."""
    compared = docs.where(F.col(_SUSPECTS).isNotNull()).select(
        _KEY, lines_of().alias("lines"), F.explode(_SUSPECTS).alias("c")
    )
    compared = compared.select(_KEY, "c.start", "c.digest", "c.stays", _text_of(F.col("c")).alias("chunk"))
    firsts = compared.where("stays").select("digest", F.col("chunk").alias("first_chunk")).dropDuplicates(["digest"])
    firsts = staged(firsts, "chunks-first")  # so that the join below is one of two shuffles, which can be split
    others = compared.where("NOT stays").join(firsts, "digest")
    return others.where("chunk <> first_chunk").select(_KEY, "start").distinct()


def remove_repeated(docs: DataFrame, removed: str = "removed") -> DataFrame:
    """Rows of ``docs`` with all their columns, text without repeated chunks, and column ``removed``: the chunks
    taken out, as an array of (start, size) in lines of the original text.

    Lines are what line feeds separate. The first occurrence of a chunk is that in the smallest doc_id (null
    last), then the least row key and line; repeats within one document go too. Chunks of fewer than
    ``LEAST_LINES`` lines stay. Documents that lose all their lines stay as rows with an empty text.

    Null text: stays null. Identical rows (doc_id and text): count as one occurrence, each is returned.
    Empty table: no rows. A column of the name ``removed`` is replaced.
    """
    names = [c for c in docs.columns if c != removed]
    keyed = _with_key(docs.select(*names))
    # the one shuffle of texts; what follows reads its result
    joined = staged(keyed.join(_suspects(keyed), _KEY, "left"), "chunk-suspects")
    # digests of different bytes are next to never equal: as a table of its own size this is broadcast
    differ = staged(_different(joined), "chunks-different")
    vetoes = differ.groupBy(_KEY).agg(F.collect_set("start").alias("__vetoes"))
    gone = F.filter(
        F.coalesce(_SUSPECTS, F.array()),
        lambda c: ~c["stays"] & ~F.coalesce(F.array_contains("__vetoes", c["start"]), F.lit(False)),
    )
    gone = F.transform(gone, lambda c: F.struct(c["start"].alias("start"), c["size"].alias("size")))
    kept = F.filter(
        F.col("__lines"),
        lambda line, i: ~F.exists(F.col(removed), lambda c: (i >= c["start"]) & (i < c["start"] + c["size"])),
    )
    text = F.when(F.size(removed) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return (
        joined.join(vetoes, _KEY, "left")
        .withColumn(removed, gone)
        .withColumn("__lines", lines_of())
        .withColumn("text", text)
        .select(*names, removed)
    )
