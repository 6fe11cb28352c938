"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, lookup

#: Last bytes of a character of several bytes that a cut stands among: a fifth of them.
_LAST = "[" + "".join(f"\\x{b:02x}" for b in range(0x80, 0xC0) if b % 5 == 2) + "]"
_HEAD = r"[\xc0-\xff][\x80-\xbf]{0,2}"
#: A chunk has 512 to 4096 bytes and ends at the first place past 512 whose neighbours fit, one in a
#: hundred or two of running text: some starts of words of a to z, or two characters of several bytes before and one after
#: that end in certain bytes. The tail and stretches without such places are cut by length. Places are
#: that rare so that the cuts of two texts with a common part meet again soon.
_CUT = rf"(?:(?<=[27ds][ \n])(?=[abcp][a-z])|(?<={_LAST}{_HEAD}{_LAST})(?={_HEAD}{_LAST}(?![\x80-\xbf])))"
CHUNK = rf"(?s).{{512,4096}}?{_CUT}|(?s).{{1,4096}}"
#: Up to so many ambiguous identifiers are spelled out chunk by chunk; with more, longer identifiers are taken.
SPELLED = 1000


def chunks(text: Column) -> Column:
    """The chunks of a text's UTF-8 bytes, each byte a character."""
    single = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1"))
    return F.regexp_extract_all(single, F.lit(CHUNK), F.lit(0))


def chunk_id(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def long_chunk_id(chunk: Column) -> Column:
    return F.sha2(chunk.cast("binary"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify=chunk_id) -> DataFrame:
    """Groups rows whose texts are equal after lower-casing A-Z.

    Returns per row: doc_id, keep_id, group_size, kept, text_sha256. A text becomes a recipe, the ordered
    list of its chunks' identifiers. Chunk contents are shuffled once, deduplicated on the map side, only to
    verify that an identifier stands for one content; recipes of a few bytes per chunk are compared after
    that. Identifiers that stand for several contents are spelled out in the recipes, so equal recipes mean
    equal texts; if there are more than SPELLED of those, all is done again with identifiers of 256 bits.

    Null text counts as empty; empty texts are equal; very long texts are many chunks. The largest id stays; a
    null id loses against any other, and of repeated rows with the same id and text one stays. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    norm = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm"))
    cut = norm.select("doc_id", "norm", chunks(F.col("norm")).alias("cut"))
    named = norm.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(identify(F.col("chunk")).alias("h"), "chunk")
    known = named.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    doubtful = [r.h for r in known.select("h").limit(SPELLED + 1).collect()]
    if len(doubtful) > SPELLED:
        if identify is long_chunk_id:
            raise RuntimeError("identifiers of 256 bits clash")
        return exact_groups(docs, id_col, text_col, long_chunk_id)
    ids = F.transform("cut", identify)
    if not doubtful:
        spelled = F.array().cast("array<string>")
    else:
        spelled = F.filter("cut", lambda c: F.array_contains(F.array(*map(F.lit, doubtful)), identify(c)))
    facts = [F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), ids.alias("ids"), spelled.alias("spelled")]
    recipes = scratch.keep(cut.select("doc_id", *facts, F.monotonically_increasing_id().alias("row")), "recipes")
    scratch.release()
    keys = ["ids", "spelled"]
    # of rows that are equal any one stays; where all ids are null, too
    best = F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row")
    groups = recipes.groupBy(*keys).agg(F.max("doc_id").alias("keep_id"), best, F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    out = lookup(recipes, groups, keys, "group_size", recipes.count())
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), "text_sha256",
    )


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
