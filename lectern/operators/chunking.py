"""Parsed elements to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def _tagged(tag: str, c: str) -> Column:
    return F.when(F.col(c) != "", F.concat(F.lit(f"[{tag}] "), F.col(c)))


def embed_text() -> Column:
    """The element's parts, each on a line with its tag, in a fixed order; absent parts leave no line."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    lines = F.transform("params", lambda p: F.concat(F.lit("  - "), blank(p["name"]), F.when(p["type"] != "", F.concat(F.lit(" ("), p["type"], F.lit(")"))).otherwise(F.lit("")), F.lit(": "), blank(p["desc"])))
    params = F.when(F.size("params") > 0, F.concat(F.lit("[PARAMS]\n"), F.array_join(lines, "\n")))
    head = [_tagged(t, c) for t, c in (("SYMBOL", "symbol_id"), ("CLASS", "class_name"), ("FUNCTION", "function_name"), ("SECTION", "section_title"), ("SIGNATURE", "signature"))]
    tail = [_tagged(t, c) for t, c in (("RETURN", "return_desc"), ("REMARKS", "remarks"), ("EXAMPLE", "example"))]
    return F.concat_ws("\n", *head, params, *tail)


def bm25_fields(max_chars: int) -> Column:
    names = F.concat_ws(" ", *(blank_to_null(F.col(c)) for c in ("symbol_id", "class_name", "function_name")))
    typed = F.transform("params", lambda p: F.when((p["type"] != "") & (p["name"] != ""), F.concat_ws(" ", p["type"], p["name"])).when(p["name"] != "", p["name"]))
    signature = F.concat_ws(" ", blank_to_null(F.col("signature")), F.array_join(F.filter(F.coalesce(typed, F.array().cast("array<string>")), lambda x: x.isNotNull()), " "))
    return F.struct(names.alias("symbol_name"), F.trim(signature).alias("signature"), F.substring(F.coalesce("remarks", F.lit("")), 1, max_chars).alias("remarks"), F.coalesce("example", F.lit("")).alias("example"))


def chunk_id() -> Column:
    """16 hex digits of the element's identity; remarks count by a hash of their own, so that parts of one page differ."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    raw = F.concat_ws(":", blank("source_label"), blank("file_path"), blank("symbol_id"), blank("type"), blank("section_title"), F.when(F.col("remarks") != "", F.substring(F.md5("remarks"), 1, 8)))
    return F.substring(F.md5(raw), 1, 16)


def build_chunks(elements: DataFrame, max_chars: int = 2000) -> DataFrame:
    """Elements with remarks or a signature; several with one id collapse to the one whose text sorts first."""
    some = elements.where((F.coalesce("remarks", F.lit("")) != "") | (F.coalesce("signature", F.lit("")) != ""))
    made = some.select(
        chunk_id().alias("chunk_id"), F.coalesce("type", F.lit("narrative")).alias("type"), "symbol_id", "class_name", "function_name", "signature", "params", "return_desc", "remarks", "example", "see_also", "references",
        F.coalesce("contains_code", F.lit(False)).alias("contains_code"), F.coalesce("source_label", F.lit("")).alias("source_label"), F.coalesce("source_module", F.lit("")).alias("source_module"), F.coalesce("file_path", F.lit("")).alias("source_file"),
        F.substring(embed_text(), 1, max_chars).alias("embed_text"), bm25_fields(max_chars).alias("bm25_fields"),
    )
    return made.withColumn("collection", F.concat_ws(".", "source_label", "source_module"))


def collapse_ids(chunks: DataFrame) -> DataFrame:
    """One row an id."""
    others = [c for c in chunks.columns if c != "chunk_id"]
    return chunks.groupBy("chunk_id").agg(F.min_by(F.struct(*others), F.struct("embed_text", "source_file")).alias("c")).select("chunk_id", "c.*")


STORED = "chunk_id type symbol_id class_name function_name signature return_desc contains_code source_label source_module source_file".split()


def to_metadata(chunks: DataFrame) -> DataFrame:
    """What a store keeps besides the text: absent strings become '', references one string with commas."""
    text = [c for c in STORED if c != "contains_code"]
    return chunks.select(*(F.coalesce(c, F.lit("")).alias(c) for c in text), "contains_code", F.array_join(F.coalesce("references", F.array().cast("array<string>")), ",").alias("references"), "embed_text")


def from_metadata(stored: DataFrame) -> DataFrame:
    """Chunks as read back: a name with a comma comes back as two, absent strings as ''."""
    parts = F.filter(F.transform(F.split("references", ","), lambda x: F.trim(x)), lambda x: x != "")
    return stored.select(*STORED, parts.alias("references"), "embed_text", F.concat_ws(".", "source_label", "source_module").alias("collection"))


def result_rows(results: DataFrame, text_chars: int = 500) -> DataFrame:
    """The columns a caller sees: remarks cut, the score with four decimals."""
    return results.select("chunk_id", "type", "symbol_id", "class_name", "function_name", "signature", "return_desc", F.substring("remarks", 1, text_chars).alias("remarks"), "source_label", "source_module", "source_file", F.round("score", 4).alias("score"))
